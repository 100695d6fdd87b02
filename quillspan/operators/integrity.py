"""Integrity rules of final spans, as one table of violations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..sources.store import apart


def violations(final: DataFrame, registry: DataFrame, sources: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """rule, key, label, candidate_id of every broken rule.

    final and registry: key, label, candidate_id, start, end, text. Rules: known label, offsets inside the text, text
    equal to its slice, candidate known, equal to its candidate, identifier of its label, no identifier twice."""
    rows = final.select(key, "label", "candidate_id", "start", "end", "text").join(apart(sources.select(key, F.col(text).alias("_source"))), key, "left")
    known = registry.select(key, "candidate_id", F.col("label").alias("r_label"), F.col("start").alias("r_start"), F.col("end").alias("r_end"), F.col("text").alias("r_text"))
    rows = rows.join(apart(known), [key, "candidate_id"], "left")
    prefix = F.element_at(F.create_map(*(F.lit(x) for kv in L.PREFIX.items() for x in kv)), F.col("label"))
    inside = (F.col("start") >= 0) & (F.col("end") > F.col("start")) & (F.col("end") <= F.length("_source"))
    same = (F.col("label") == F.col("r_label")) & (F.col("start") == F.col("r_start")) & (F.col("end") == F.col("r_end")) & (F.col("text") == F.col("r_text"))
    rules = {
        "unsupported_label": ~F.col("label").isin(L.LABELS),
        "missing_source": F.col("_source").isNull(),
        "invalid_offsets": F.col("_source").isNotNull() & ~inside,
        "text_offset_mismatch": inside & (F.substring("_source", F.col("start") + 1, F.col("end") - F.col("start")) != F.col("text")),
        "unknown_candidate": F.col("r_label").isNull(),
        "differs_from_candidate": F.col("r_label").isNotNull() & ~same,
        "identifier_of_other_label": ~F.coalesce(F.col("candidate_id").startswith(F.concat(prefix, F.lit("-C"))), F.lit(False)),
    }
    broken = F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in rules.items())))
    found = rows.select(F.explode(broken).alias("rule"), key, "label", "candidate_id")
    twice = final.groupBy(key, "label", "candidate_id").count().filter("count > 1").select(F.lit("repeated_candidate").alias("rule"), key, "label", "candidate_id")
    return found.unionByName(twice)


def support_violations(final: DataFrame, matrix: DataFrame, key: str = "doc_id") -> DataFrame:
    """Final candidates under the strict policy that not all roles keep, where their label has votes at all."""
    from .votes import ROLES

    keys = [key, "label", "candidate_id"]
    keeps = sum((F.col(r) == "keep").cast("int") for r in ROLES)
    rows = final.select(*keys).join(apart(matrix.select(key, "label").distinct()), [key, "label"], "left_semi").join(apart(matrix.select(*keys, keeps.alias("_keeps"))), keys, "left")
    return rows.filter(F.coalesce("_keeps", F.lit(0)) < len(ROLES)).select(F.lit("not_supported_by_all_roles").alias("rule"), *keys)


def order_violations(by_label: DataFrame, flat: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents whose flat list of final ids (key, pos, candidate_id) isn't their lists by label (key, label, pos,
    candidate_id) one after the other, in the order of labels."""
    from .candidates import label_ord

    a = by_label.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(label_ord(F.col("label")).alias("o"), "pos", "candidate_id"))), lambda x: x["candidate_id"]).alias("_a"))
    b = flat.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "candidate_id"))), lambda x: x["candidate_id"]).alias("_b"))
    none = F.array().cast("array<string>")
    rows = a.join(apart(b), key, "full").filter(F.coalesce("_a", none) != F.coalesce("_b", none))
    return rows.select(F.lit("lists_differ").alias("rule"), key, F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("candidate_id"))


def status_violations(labels: DataFrame, final: DataFrame, documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """Claims that don't hold. labels: key, label, consensus (one row a label of each document); documents: key,
    overall_consensus, unresolved (ids), summaries (variant-like map of summary names to their fields, null for none)."""
    chosen = final.select(key, "label").distinct().withColumn("_chosen", F.lit(True))
    claimed = labels.join(apart(chosen), [key, "label"], "left").filter(F.col("consensus") & F.col("_chosen").isNull())
    counts = labels.filter(F.col("label").isin(L.LABELS)).groupBy(key).agg(F.count_distinct("label").alias("_n"))
    short = documents.select(key).join(apart(counts), key, "left").filter(F.coalesce("_n", F.lit(0)) < len(L.LABELS))
    early = documents.filter(F.col("overall_consensus") & (F.size("unresolved") > 0))
    spans = documents.filter(F.col("summaries").isNotNull() & F.exists(F.map_values("summaries"), lambda f: F.array_contains(f, "start")))
    declared = F.map_contains_key("summaries", "summary_based_on_final_spans") | F.map_contains_key("summaries", "summary_based_on_strict_unanimous_spans")
    bare = documents.filter(F.col("summaries").isNotNull() & (F.size("summaries") > 0) & ~declared)
    none = F.lit(None).cast("string")
    out = claimed.select(F.lit("consensus_without_selection").alias("rule"), key, "label", none.alias("candidate_id"))
    for rule, rows in (("labels_missing", short), ("consensus_with_unresolved", early), ("summary_holds_spans", spans), ("summary_without_provenance", bare)):
        out = out.unionByName(rows.select(F.lit(rule).alias("rule"), key, none.alias("label"), none.alias("candidate_id")))
    return out
