"""Reports: modes against each other (ablation), backends side by side, variants of a calibration, and their texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..sources.store import apart
from . import evaluate

METRICS = ("precision", "recall", "f1", "accuracy")


def ablation(tokens: DataFrame, gold: DataFrame, spans_by_mode: DataFrame) -> DataFrame:
    """mode, family, label, tp, fp, fn, precision, recall, f1 of the exact and token families of every mode.

    spans_by_mode: mode, doc_id, label, start, end. All modes go through one pass: a mode's documents are told apart by
    a key of mode and document, and gold is repeated for each mode (a handful)."""
    modes = spans_by_mode.select("mode").distinct()
    by = lambda mode, doc: F.struct(mode.alias("mode"), doc.alias("id"))
    keyed = gold.join(F.broadcast(modes)).select(by(F.col("mode"), F.col("doc_id")).alias("doc_id"), "label", "start", "end", F.lit("g").alias("side"))  # some ten modes
    both = keyed.unionByName(spans_by_mode.select(by(F.col("mode"), F.col("doc_id")).alias("doc_id"), "label", "start", "end", F.lit("p").alias("side")))
    g, p = F.col("side") == "g", F.col("side") == "p"
    keys = both.groupBy("doc_id", "label", "start", "end").agg(F.count_if(g).alias("g"), F.count_if(p).alias("p"))
    exact = keys.groupBy(F.col("doc_id.mode").alias("mode"), "label").agg(F.count_if((F.col("g") > 0) & (F.col("p") > 0)).alias("tp"), F.sum("g").alias("g"), F.sum("p").alias("p"))
    exact = exact.select("mode", "label", "tp", (F.col("p") - F.col("tp")).alias("fp"), (F.col("g") - F.col("tp")).alias("fn"))
    flags = evaluate.flagged_of(tokens.join(F.broadcast(modes)).select(by(F.col("mode"), F.col("doc_id")).alias("doc_id"), "tokens"), both)
    bit = lambda c, k: F.col(c).bitwiseAND(F.lit(1 << k)) != 0
    sums = flags.groupBy(F.col("doc_id.mode").alias("mode")).agg(*(F.count_if(c).alias(f"{n}{k}") for k in range(len(L.LABELS)) for n, c in (("tp", bit("g", k) & bit("p", k)), ("fp", ~bit("g", k) & bit("p", k)), ("fn", bit("g", k) & ~bit("p", k)))))
    rows = F.explode(F.array(*(F.struct(F.lit(x).alias("label"), *(F.col(f"{n}{k}").alias(n) for n in ("tp", "fp", "fn"))) for k, x in enumerate(L.LABELS)))).alias("r")
    token = sums.select("mode", rows).select("mode", "r.*")
    out = [_rolled_up(x, modes).withColumn("family", F.lit(name)) for name, x in (("exact", exact), ("token", token))]
    return out[0].unionByName(out[1]).select("mode", "family", "label", "tp", "fp", "fn", "precision", "recall", "f1")


def _rolled_up(counts: DataFrame, modes: DataFrame) -> DataFrame:
    """Scores of every mode and label, and of all labels together."""
    from ..functions import text as T

    dim = modes.join(F.broadcast(evaluate.label_dim(counts.sparkSession).select("label")))  # seven labels
    each = dim.join(counts, ["mode", "label"], "left").na.fill(0, ["tp", "fp", "fn"])
    every = each.select("mode", "label", "tp", "fp", "fn").unionByName(each.groupBy("mode").agg(F.lit("micro").alias("label"), *(F.sum(c).alias(c) for c in ("tp", "fp", "fn"))))
    return every.select("mode", "label", "tp", "fp", "fn", *T.f_scores(F.col("tp"), F.col("fp"), F.col("fn")))


def backend_summary(metrics: DataFrame, assignment: DataFrame, facts: DataFrame) -> DataFrame:
    """One row a backend: facts, token scores over all labels and their averages, and the scores of each label.

    metrics: backend, label (with micro and macro), precision, recall, f1, accuracy; assignment: backend, accuracy; facts:
    backend and what else is known of it."""
    value = lambda label, m: F.max(F.when(F.col("label") == label, F.col(m)))
    named = [value("micro", m).alias(f"overall_token_{m}") for m in ("precision", "recall", "f1")] + [value("micro", "accuracy").alias("overall_token_one_vs_rest_accuracy")]
    named += [value("macro", m).alias(f"macro_token_{m}") for m in METRICS] + [value(x, m).alias(f"{x.lower()}_{m}") for x in L.LABELS for m in METRICS]
    wide = metrics.groupBy("backend").agg(*named)
    return facts.join(wide, "backend").join(assignment.select("backend", F.col("accuracy").alias("overall_token_accuracy")), "backend", "left")


def backend_lines(summary: DataFrame) -> DataFrame:
    """backend, line: a comparison as fixed-width text."""
    number = lambda c: F.format_string("%.4f", F.col(c).cast("double"))
    line = F.concat(F.rpad("backend", 15, " "), F.rpad(F.col("aligned_record_count").cast("string"), 9, " "), number("overall_token_precision"), F.lit("     "), number("overall_token_recall"), F.lit("  "), number("overall_token_f1"), F.lit("  "), number("overall_token_accuracy"))
    return summary.select("backend", line.alias("line"))


def score_order(prefer: str = "f1") -> list[Column]:
    """By what rows of scores are ranked."""
    order = {"f1": ("f1", "recall", "precision"), "recall": ("recall", "f1", "precision"), "precision": ("precision", "f1", "recall")}[prefer]
    return [F.desc(c) for c in order]


def variant_report(scores: DataFrame, prefer: str = "f1") -> DataFrame:
    """scores (variant, place, part, precision, recall, f1; part is train, holdout or all) with best: the variant whose
    micro scores over all examples are highest, the first of equals."""
    first = scores.filter("part = 'all'").orderBy(*score_order(prefer), "place").limit(1).select("variant", F.lit(True).alias("best"))
    return scores.join(F.broadcast(first), "variant", "left").withColumn("best", F.coalesce("best", F.lit(False)))  # one row


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def readable(metrics: DataFrame) -> DataFrame:
    """family, label, line: scores as text, one line a label, micro and macro last."""
    place = F.when(F.col("label") == "micro", 100).when(F.col("label") == "macro", 101).otherwise(F.array_position(F.array(*(F.lit(x) for x in L.LABELS)), F.col("label")))
    number = lambda c: F.format_string("%s=%.4f", F.lit(c), F.col(c).cast("double"))
    line = F.concat_ws(" ", F.rpad("label", 22, " "), number("precision"), number("recall"), number("f1"), F.format_string("tp=%s fp=%s fn=%s", F.coalesce(F.col("tp").cast("string"), F.lit("-")), F.coalesce(F.col("fp").cast("string"), F.lit("-")), F.coalesce(F.col("fn").cast("string"), F.lit("-"))))
    return metrics.select("family", "label", place.cast("int").alias("place"), line.alias("line"))


def overview(final: DataFrame, state: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, label, spans, termination, consensus_reached, unresolved: what a look at a document's result shows."""
    counts = final.groupBy(key, "label").agg(F.count("*").alias("spans"))
    rows = state.select(key, "label", "termination", "consensus_reached", F.size("unresolved_ids").alias("unresolved"))
    return rows.join(apart(counts), [key, "label"], "left").na.fill(0, ["spans"])
