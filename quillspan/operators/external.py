"""What is asked of models outside the engine: token scores of experts, and answers of reviewers as JSON (functions.answers
has their schemas).

A model is a function that is given when a worker starts (a factory, so that weights are loaded once a task); it runs in
Arrow batches. Functions that replay recorded scores and answers fit as well as real ones.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import json_repair, prompts
from ..functions import labels as L
from ..functions import text as T
from ..sources.store import apart, stored
from . import candidates, votes

WINDOW, STRIDE = 512, 128
DECIMALS = 4
REPAIR_CHARS = 12_000
REPAIR = "You repair JSON. Return one valid JSON object that matches the schema, and nothing else. Change no ids, decisions, labels or operations."


def windows(n: int, size: int = WINDOW, stride: int = STRIDE) -> list[tuple[int, int]]:
    """First and last (exclusive) piece of each window over n pieces; neighbours share `stride` pieces."""
    out, at = [], 0
    while True:
        out.append((at, min(n, at + size)))
        if at + size >= n:
            return out
        at += size - stride


def probabilities(docs: DataFrame, experts: dict[str, Callable[[], Callable]], text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, expert, label, start, end, prob, special: every token of every window, by all experts.

    An expert's factory gives a function from a text to rows (start, end, special, probabilities in the order of labels);
    tokens of overlapping windows come twice, as they are scored twice."""
    kind, out = docs.schema[key].dataType.simpleString(), None
    for name, factory in experts.items():

        def run(batches: Iterator[pa.RecordBatch], name: str = name, factory: Callable = factory) -> Iterator[pa.RecordBatch]:
            score = factory()
            for part in batches:
                rows = [(k, name, label, a, b, float(p), bool(special)) for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for a, b, special, probs in score(t or "") for label, p in zip(L.LABELS, probs, strict=True)]
                types = (part.schema.field(0).type, pa.string(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.bool_())
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [part.schema.names[0], "expert", "label", "start", "end", "prob", "special"])

        one = docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, expert string, label string, start int, end int, prob double, special boolean")
        out = one if out is None else out.unionByName(one)
    return out


def expert_spans(probs: DataFrame, thresholds: DataFrame, sources: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, ord, label, start, end, text, expert, confidence, threshold, section, origin: the experts' spans in order of
    arrival (expert, label, span), as candidates.registered() takes them. Tokens over the threshold are merged and white
    space at the ends goes."""
    merged = candidates.merged_intervals(candidates.above_threshold(probs, thresholds), [key, "expert", "label"])
    rows = merged.join(apart(sources.select(key, F.col(text).alias("_source"))), key)
    rows = rows.withColumn("_s", T.trim_space(F.struct("start", "end", F.substring("_source", F.col("start") + 1, F.col("end") - F.col("start")).alias("text"))))
    rows = rows.filter("_s.end > _s.start").join(F.broadcast(thresholds), ["expert", "label"])  # a row for each expert and label
    expert = F.array_position(F.array(*(F.lit(e) for e in L.EXPERTS)), F.col("expert"))
    item = F.struct(expert.alias("e"), candidates.label_ord(F.col("label")).alias("l"), F.col("_s.start").alias("start"), F.col("_s.end").alias("end"), F.col("_s.text").alias("text"), "label", "expert", F.round("confidence", DECIMALS).alias("confidence"), "threshold", T.section_of(F.col("_source"), F.col("_s.start")).alias("section"))
    lists = rows.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("spans"))
    return lists.select(key, F.posexplode("spans").alias("ord", "s")).select(key, "ord", "s.label", "s.start", "s.end", "s.text", "s.expert", "s.confidence", "s.threshold", "s.section", F.lit("expert").alias("origin"))


def answer(chat: Callable, system: str, user: str, schema: dict) -> tuple[str | None, str, str | None]:
    """An answer as JSON text, how it came about (structured, repaired, unstructured or failed), and the last error.

    chat(system, user, schema or None, most tokens or None) gives a text. An error that tells the context's limits is
    answered by one more try with the tokens that are left."""

    def asked(system: str, user: str, schema: dict | None) -> str:
        try:
            return chat(system, user, schema, None)
        except Exception as e:
            found = prompts.limits_of(str(e))
            if not found or found[0] - found[1] < 1:
                raise
            return chat(system, user, schema, found[0] - found[1])

    raw, error = "", None
    for how in ("structured", "repaired", "unstructured"):
        try:
            if how == "repaired":
                text = asked(REPAIR, f"INVALID_RESPONSE:\n{raw[:REPAIR_CHARS]}", schema)
            else:
                text = raw = asked(system, user, schema if how == "structured" else None)
            value = json_repair.parsed(text, schema)
            if value is not None:
                return json.dumps(value | ({"_used_unstructured_json_fallback": True} if how == "unstructured" else {}), sort_keys=True), how, None
            error = "no JSON object"
        except Exception as e:
            return None, "failed", str(e)
    return None, "failed", error


def answered(questions: DataFrame, factory: Callable[[], Callable], keys: list[str]) -> DataFrame:
    """keys, answer, how, error of questions (keys, system, user, schema as JSON text)."""
    kinds = ", ".join(f"`{k}` {questions.schema[k].dataType.simpleString()}" for k in keys)
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chat = factory()
        for part in batches:
            rows = [answer(chat, s, u, json.loads(j)) for s, u, j in zip(*(part.column(n + i).to_pylist() for i in range(3)), strict=True)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(n)), *(pa.array(c, pa.string()) for c in columns)], [*keys, "answer", "how", "error"])

    return questions.select(*keys, "system", "user", "schema").mapInArrow(run, f"{kinds}, answer string, how string, error string")


def check_model(wanted: str, served: list[str]) -> None:
    """Raises before any work when a server doesn't serve the wanted model."""
    if wanted not in served:
        raise RuntimeError(f"{wanted} is not served; the server has: {', '.join(served) or 'nothing'}")


def reviewed(assigned: DataFrame, ask: Callable[[DataFrame, int], DataFrame], keys: list[str], retries: int = 3) -> DataFrame:
    """Reviews of all assigned candidates (keys, candidate_id), asked again up to `retries` times for undecided ones.

    ask(candidates, attempt) gives keys, decisions; its answers count where they are valid for what was asked, later ones
    over earlier ones. The result has keys, attempts and the columns of votes.normalized_review() for all candidates."""
    every = assigned.groupBy(*keys).agg(F.array_sort(F.collect_list("candidate_id")).alias("assigned_ids"))
    left, sent = assigned, None
    none = F.array().cast("array<string>")
    for attempt in range(retries + 1):
        if not left.limit(1).count():
            break
        visible = left.groupBy(*keys).agg(F.array_sort(F.collect_list("candidate_id")).alias("assigned_ids"))
        got = ask(left, attempt).join(apart(visible), keys).withColumns({"keep_ids": none, "reject_ids": none})
        one = votes.normalized_review(got).select(*keys, F.lit(attempt).alias("attempt"), F.explode("decided").alias("candidate_id", "decision"))
        sent = stored(one if sent is None else sent.unionByName(one), "reviews")
        left = stored(left.join(apart(sent.select(*keys, "candidate_id").distinct()), [*keys, "candidate_id"], "left_anti"), "left")
    last = votes.merged_decisions(sent, [*keys, "candidate_id"]).groupBy(*keys).agg(F.collect_list(F.struct("candidate_id", "decision")).alias("decisions"))
    tries = sent.groupBy(*keys).agg((F.max("attempt") + 1).alias("attempts"))
    rows = every.join(apart(last), keys, "left").join(apart(tries), keys, "left").withColumn("decisions", F.coalesce("decisions", F.array().cast("array<struct<candidate_id:string,decision:string>>")))
    return votes.normalized_review(rows.withColumns({"keep_ids": none, "reject_ids": none}))


def with_provenance(summaries: DataFrame, documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """Summaries (key, summary) with what they rest on: documents has key, consensus, policy, unresolved_labels."""
    rows = summaries.join(apart(documents), key)
    return rows.withColumns({"summary_based_on_consensus": F.col("consensus"), "summary_based_on_final_spans": F.lit(True), "summary_final_selection_policy": F.col("policy"), "summary_based_on_strict_unanimous_spans": F.col("policy") == "strict"}).drop("consensus", "policy")
