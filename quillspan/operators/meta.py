"""What a meta agent's decision is worth: repeated selections, proofs, searches, and the sentences it should see."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import rules as R
from ..functions import text as T
from ..functions.answers import MOST_CUES, MOST_SEARCHES, SEARCHES
from ..functions.answers import CUE as CUE_CHARS
from ..functions.answers import RATIONALE as PROOF_CHARS
from ..functions.answers import REASON as REASON_CHARS
from ..sources.store import apart

# Heads that a span should not begin with, and signs at its ends.
HEADS = ["intervention ", "design ", "statistical analysis "]
FULL_STOPS, LEADING, DASHES = "[.!?]$", "^[.,;:]", "[-–—]$"


def _starts_with_head(text: Column) -> Column:
    out = F.lit(False)
    for head in HEADS:
        out = out | text.startswith(head)
    return out


def plain(text: Column) -> Column:
    """Lower-case, collapsed, without outer signs and without each of the heads, in their order."""
    out = F.regexp_replace(F.lower(T.clean(text)), r"^[ .,:;-]+|[ .,:;-]+$", "")
    for head in HEADS:
        out = F.when(out.startswith(head), F.substring(out, len(head) + 1, F.length(out))).otherwise(out)
    return out


def boundary_quality(text: Column, start: Column) -> Column:
    """Struct by which the best of several equal selections is taken: score, shorter, earlier."""
    bare = T.trim_space(F.struct(F.lit(0).alias("start"), F.length(text).alias("end"), text.alias("text")))["text"]
    score = 5 * bare.rlike(FULL_STOPS).cast("int") - 5 * bare.rlike(LEADING).cast("int") - 2 * _starts_with_head(F.lower(T.clean(text))).cast("int") - 5 * bare.rlike(DASHES).cast("int")
    return F.struct(score.alias("score"), (-F.length(bare)).alias("size"), (-start).alias("place"))


def near_duplicate(a: Column, b: Column) -> Column:
    """Nearly all of the shorter one lies in the other, and one plain text holds the other."""
    shorter = F.least(a["end"] - a["start"], b["end"] - b["start"])
    shared = T.overlap(a["start"], a["end"], b["start"], b["end"])
    return F.coalesce((shorter > 0) & (shared / shorter >= 0.9) & (a["plain"].contains(b["plain"]) | b["plain"].contains(a["plain"])), F.lit(False))


def without_repeats(items: Column) -> Column:
    """Fold: each item joins the first group that holds a near duplicate; the best of each group stays, in given order.

    items: array of structs with candidate_id, start, end, plain, quality; of equally good ones the first stays."""

    def step(groups: Column, new: Column) -> Column:
        def placed(at: Column) -> Column:
            grown = F.transform(groups, lambda g, k: F.when(k + 1 == at, F.concat(g, F.array(new))).otherwise(g))
            return F.when(at == 0, F.concat(groups, F.array(F.array(new)))).otherwise(grown)

        return T.let(F.coalesce(F.array_position(F.transform(groups, lambda g: F.exists(g, lambda old: near_duplicate(new, old))), True), F.lit(0)), placed)

    groups = F.aggregate(items, F.slice(F.array(items), 1, 0), step)
    best = F.transform(groups, lambda g: F.array_max(F.transform(g, lambda c, k: F.struct(c["quality"].alias("quality"), (-k).alias("back"), c["candidate_id"].alias("id"))))["id"])
    return T.let(best, lambda kept: F.filter(items, lambda c: F.array_contains(kept, c["candidate_id"])))


def pruned(selected: DataFrame, by: list[str]) -> DataFrame:
    """by, pos, candidate_id of selected (by, pos, candidate_id, start, end, text) without near duplicates."""
    item = F.struct("pos", "candidate_id", "start", "end", plain(F.col("text")).alias("plain"), boundary_quality(F.col("text"), F.col("start")).alias("quality"))
    lists = selected.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("items"))
    return lists.select(*by, F.posexplode(F.transform(without_repeats(F.col("items")), lambda c: c["candidate_id"])).alias("pos", "candidate_id"))


def valid_proofs(proofs: DataFrame, selected: DataFrame, units: DataFrame, by: list[str], key: str = "doc_id") -> DataFrame:
    """The first proof of each selected candidate whose quote stands in the sentence that it names; long texts are cut.

    proofs: by, ord, candidate_id, evidence_sentence_id, evidence_quote, label_fit_rationale, boundary_rationale."""
    rows = proofs.join(apart(selected.select(*by, "candidate_id").distinct()), [*by, "candidate_id"], "left_semi")
    rows = rows.join(apart(units.select(key, F.col("sentence_id").alias("evidence_sentence_id"), F.col("text").alias("_unit"))), [key, "evidence_sentence_id"])
    rows = rows.filter((F.trim("evidence_quote") != "") & F.col("_unit").contains(F.col("evidence_quote")))
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by, "candidate_id").orderBy("ord"))).filter("_n = 1")
    cut = {c: F.left(F.coalesce(c, F.lit("")), F.lit(PROOF_CHARS)) for c in ("label_fit_rationale", "boundary_rationale")}
    return first.withColumns(cut).drop("_n", "_unit")


def missing_proofs(selected: DataFrame, proofs: DataFrame, by: list[str]) -> DataFrame:
    """Selected candidates without a proof."""
    return selected.join(apart(proofs.select(*by, "candidate_id").distinct()), [*by, "candidate_id"], "left_anti")


def strict_selected(selected: DataFrame, bank: DataFrame, matrix: DataFrame, by: list[str]) -> DataFrame:
    """selected with reason: null where every role keeps the candidate and its borders are fine, the border's issue where
    they aren't; candidates that are unknown or not unanimous go."""
    from .votes import ROLES

    keys = [*by, "candidate_id"]
    unanimous = matrix.filter(" AND ".join(f"{r} = 'keep'" for r in ROLES)).select(*keys)
    rows = selected.join(apart(unanimous), keys, "left_semi").join(apart(bank.select(*keys, "text")), keys)
    return rows.withColumn("reason", R.boundary_issue(F.col("label"), F.col("text"))).drop("text")


def source_searches(requests: DataFrame, by: list[str], allowed: bool = True) -> DataFrame:
    """Up to three searches of each group: for its own label, with a known operation; long texts are cut.

    requests: by (with label), ord, asked_label, reason, search_cues, requested_operation."""
    rows = requests.filter((F.col("asked_label") == F.col("label")) & F.col("requested_operation").isin(SEARCHES) & F.lit(allowed))
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("ord"))).filter(F.col("_n") <= MOST_SEARCHES)
    cues = F.transform(F.slice(F.coalesce("search_cues", F.array().cast("array<string>")), 1, MOST_CUES), lambda c: F.left(c, F.lit(CUE_CHARS)))
    return rows.withColumns({"reason": F.left(F.coalesce("reason", F.lit("")), F.lit(REASON_CHARS)), "search_cues": cues}).drop("_n")


def _cued(cues: list[str]):
    return lambda u: T.any_cue(u["text"], cues)


def relevant_units(units: Column, items: Column, label: Column, most: int, fallback: bool = True) -> Column:
    """Sentences to show: the first one of each candidate that isn't taken yet, then those with a cue of the label.

    fallback: the first sentences where nothing is relevant."""

    def step(taken: Column, c: Column) -> Column:
        free = F.get(F.filter(units, lambda u: (T.overlap(c["start"], c["end"], u["start"], u["end"]) > 0) & ~F.exists(taken, lambda t: t["sentence_id"] == u["sentence_id"])), F.lit(0))
        return T.let(free, lambda u: F.when(u.isNull(), taken).otherwise(F.concat(taken, F.array(u))))

    cued = F.slice(units, 1, 0)
    for name, cues in L.CUES.items():
        cued = F.when(label == name, F.filter(units, _cued(cues))).otherwise(cued)

    def filled(taken: Column) -> Column:
        more = F.filter(cued, lambda u: ~F.exists(taken, lambda t: t["sentence_id"] == u["sentence_id"]))
        every = F.slice(F.concat(taken, more), F.lit(1), F.lit(most))
        return F.when(F.size(every) == 0, F.slice(units, F.lit(1), F.lit(most))).otherwise(every) if fallback else every

    return T.let(F.aggregate(items, F.slice(units, 1, 0), step), filled)
