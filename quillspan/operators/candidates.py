"""Candidates: thresholded token probabilities merged into spans, registry with merged provenance and numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import rules as R
from ..sources.store import apart
from .distinct import once


def label_ord(label: Column) -> Column:
    """0-based place of a label in the fixed order, null for others."""
    out = None
    for k, name in enumerate(L.LABELS):
        out = F.when(label == name, k) if out is None else out.when(label == name, k)
    return out


def above_threshold(probabilities: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Token probabilities that reach the threshold of their expert and label; special and empty tokens go.

    thresholds: expert, label, threshold; a row for each pair (some tens), which is what bounds the broadcast."""
    usable = probabilities.filter("NOT special AND end > start")
    return usable.join(F.broadcast(thresholds), ["expert", "label"]).filter("prob >= threshold")


def merged_intervals(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """Tokens merged while the next starts at most one after the running end; mean and count of their probabilities."""
    by = Window.partitionBy(*keys).orderBy("start", "end")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    marked = tokens.withColumn("reach", F.max("end").over(before)).withColumn("fresh", F.coalesce((F.col("start") > F.col("reach") + 1).cast("int"), F.lit(1)))
    marked = marked.withColumn("island", F.sum("fresh").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    merged = marked.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.avg("prob").alias("confidence"), F.count("*").alias("n_tokens"))
    return merged.drop("island")


def registry(raw: DataFrame, key: str = "doc_id") -> DataFrame:
    """One candidate for each key, label and span, numbered in order of acceptance.

    raw: key, label, start, end, text, origin, origin_ord (experts by their place, then generated spans), expert
    (null for generated ones), confidence. Experts' highest confidences and sorted names are merged; registered() also
    normalises, validates and keeps thresholds and a log."""
    is_expert = F.col("expert").isNotNull()
    pair = F.when(is_expert, F.struct("expert", "confidence"))
    grouped = raw.groupBy(key, "label", "start", "end").agg(
        F.min("text").alias("text"),
        F.min(F.struct("origin_ord", "origin")).alias("first"),
        F.sort_array(F.collect_set(F.col("expert"))).alias("proposed_by_experts"),
        F.collect_list(pair).alias("pairs"),
    )
    return _numbered(grouped, key)


def listed(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """registry() of spans that stand once each and carry what all experts said of them, `pairs`, an array of expert and
    confidence; the other columns are those of raw. Nothing is multiplied by experts or grouped again. Spans of one origin
    may come with their `number` (generate.numbered_spans), which then holds."""
    names, given = F.sort_array(F.array_distinct(F.col("pairs.expert"))), [c for c in ("number",) if c in spans.columns]
    return _numbered(spans.select(key, "label", "start", "end", "text", F.struct("origin_ord", "origin").alias("first"), names.alias("proposed_by_experts"), "pairs", *given), key)


def _id(prefix: Column, number: Column) -> Column:
    """A label's prefix and the number in four digits or more; format_string would parse its pattern for each row."""
    digits = number.cast("string")
    return F.when(prefix.isNull(), F.format_string("%s-C%04d", prefix, number)).otherwise(F.concat(prefix, F.lit("-C"), F.when(number < 10000, F.lpad(digits, 4, "0")).otherwise(digits)))


def _numbered(grouped: DataFrame, key: str) -> DataFrame:
    best = F.map_from_entries(F.transform(F.col("proposed_by_experts"), lambda e: F.struct(e, F.array_max(F.transform(F.filter("pairs", lambda p: p["expert"] == e), lambda p: p["confidence"])))))
    place = Window.partitionBy(key, "label").orderBy("first.origin_ord", "start", "end", "text")
    number = F.col("number") if "number" in grouped.columns else F.row_number().over(place)
    prefix = F.element_at(F.create_map(*(F.lit(x) for kv in L.PREFIX.items() for x in kv)), F.col("label"))
    return grouped.select(
        key, "label", "start", "end", "text", F.col("first.origin").alias("origin"), "proposed_by_experts", best.alias("confidence_by_expert"),
        _id(prefix, number).alias("candidate_id"), number.alias("number"),
    )


def arrivals(raw: DataFrame, sources: DataFrame, normalise: bool = False, key: str = "doc_id") -> DataFrame:
    """Raw spans of registered() with their boundaries set where that is wanted, `normalised`, reason and severity. There is
    no shuffle but that of the texts, and no state: a stream of spans goes through as well."""
    rows = raw
    if normalise:
        fixed = R.repaired(F.col("label"), F.struct("start", "end", "text"))
        rows = rows.withColumn("_r", fixed).withColumn("normalised", (F.col("_r.start") != F.col("start")) | (F.col("_r.end") != F.col("end")))
        rows = rows.withColumns({c: F.col(f"_r.{c}") for c in ("start", "end", "text")}).drop("_r")
    else:
        rows = rows.withColumn("normalised", F.lit(False))
    return validated(rows, sources, key=key)


def registered(raw: DataFrame, sources: DataFrame, normalise: bool = False, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """The registry of raw spans, and the log of what became of each.

    raw: key, ord (order of arrival), label, start, end, text, expert (null for generated spans), confidence, threshold,
    section, origin. normalise: boundaries are first set by label. Valid spans of equal place are one candidate: the
    first one's origin and section, of each expert the highest confidence and the last threshold, all experts by name,
    and how many experts' spans were merged. Later generated spans of the place are logged as duplicates."""
    rows = arrivals(raw, sources, normalise, key)
    place = Window.partitionBy(key, "label", "start", "end", "reason").orderBy("ord")
    first = (F.col("reason") == "accepted") & (F.row_number().over(place) == 1)
    rows = rows.withColumn("first", first)
    decision = F.when(F.col("reason") != "accepted", F.col("reason")).when(F.col("first"), "accepted").when(F.col("expert").isNotNull(), "merged_duplicate").otherwise("duplicate_exact_span")
    log = rows.select(key, "ord", "label", "start", "end", "text", "origin", "normalised", decision.alias("decision"))
    good = rows.filter("reason = 'accepted' AND (first OR expert IS NOT NULL)")
    said = F.when(F.col("expert").isNotNull(), F.struct("expert", "ord", "confidence", "threshold"))
    merged = good.groupBy(key, "label", "start", "end").agg(
        F.min("text").alias("text"), F.min("ord").alias("ord"), F.min_by("origin", "ord").alias("origin"), F.min_by("section", "ord").alias("section"), F.min_by("normalised", "ord").alias("normalised"),
        F.array_sort(F.collect_set("expert")).alias("proposed_by_experts"), F.collect_list(said).alias("said"), (F.count("*") - 1).alias("merged"),
    )
    of = lambda e: F.filter("said", lambda s: s["expert"] == e)
    best = F.map_from_entries(F.transform("proposed_by_experts", lambda e: F.struct(e, F.array_max(F.transform(of(e), lambda s: s["confidence"])))))
    last = F.map_from_entries(F.transform("proposed_by_experts", lambda e: F.struct(e, F.array_max(F.transform(of(e), lambda s: F.struct(s["ord"], s["threshold"])))["threshold"])))
    number = F.row_number().over(Window.partitionBy(key, "label").orderBy("ord"))
    prefix = F.element_at(F.create_map(*(F.lit(x) for kv in L.PREFIX.items() for x in kv)), F.col("label"))
    out = merged.select(
        key, "label", "start", "end", "text", "origin", "section", "normalised", "proposed_by_experts", best.alias("confidence_by_expert"), last.alias("threshold_by_expert"),
        "merged", _id(prefix, number).alias("candidate_id"), number.alias("number"),
    )
    return out, log


def validated(candidates: DataFrame, sources: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """candidates with reason (accepted or why not) and severity; a candidate without source text has invalid offsets.

    What the rules say of a label and text is found first, once for each that is distinct in a batch; beside the source
    only places are judged."""
    label, words = F.col("label"), F.col("text")
    judged = once(candidates, ["label", "text"], {"_by_text": R.reason(label, words, F.lit(False), F.lit(False))})
    joined = judged.join(apart(sources.select(key, F.col(text).alias("_source"))), key, "left")
    outside, other = R.misplaced(F.coalesce("_source", F.lit("")), words, F.col("start"), F.col("end"))
    reason = F.when(F.col("_by_text") == "unsupported_label", "unsupported_label").when(outside, "invalid_offsets").when(other, "text_offset_mismatch").otherwise(F.col("_by_text"))
    return joined.withColumn("reason", reason).withColumn("severity", R.severity(F.col("reason"))).drop("_source", "_by_text")


def capped(new: DataFrame, existing: DataFrame, most: int = 80, key: str = "doc_id") -> DataFrame:
    """The first `most` accepted new spans of each key and label, in order of span and method, that exist not yet."""
    fresh = new.filter("reason = 'accepted'").join(apart(existing.select(key, "label", "start", "end")), [key, "label", "start", "end"], "left_anti")
    order = Window.partitionBy(key, "label").orderBy("start", "end", "method")
    return fresh.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).drop("rank")


def pre_expanded(docs: DataFrame, registry: DataFrame, most: int = 80, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """The registry with up to `most` new spans of each core label, and the new ones alone.

    New spans are pattern matches, cue clauses, and alternatives inside long candidates, each once under its first
    method's name; invalid ones and ones that exist are left out. Their numbers follow the label's last one."""
    from . import generate

    new = capped(validated(generate.deterministic_spans(docs, registry, key=key), docs, key=key), registry, most, key)
    last = registry.groupBy(key, "label").agg(F.max("number").alias("_last"))
    place = Window.partitionBy(key, "label").orderBy("start", "end", "method")
    rows = new.join(apart(last), [key, "label"], "left").withColumn("number", F.coalesce("_last", F.lit(0)) + F.row_number().over(place))
    prefix = F.element_at(F.create_map(*(F.lit(x) for kv in L.PREFIX.items() for x in kv)), F.col("label"))
    rows = rows.select(
        key, "label", "start", "end", "text", F.lit("deterministic_pre_expansion").alias("origin"), F.array().cast("array<string>").alias("proposed_by_experts"), F.create_map().cast("map<string,double>").alias("confidence_by_expert"),
        F.format_string("%s-C%04d", prefix, F.col("number")).alias("candidate_id"), F.col("number").cast("int").alias("number"),
    )
    return registry.select(*rows.columns).unionByName(rows), rows


def spans_of(ids: DataFrame, registry: DataFrame, strict: bool = True, key: str = "doc_id") -> DataFrame:
    """ids (key, label, pos, candidate_id) with start, end and text of their candidates.

    An id that the registry doesn't hold raises when rows are read, or is left out where strict is off."""
    rows = ids.join(apart(registry.select(key, "label", "candidate_id", "start", "end", "text")), [key, "label", "candidate_id"], "left" if strict else "inner")
    if not strict:
        return rows
    unknown = F.raise_error(F.concat(F.lit("no such candidate: "), F.col("candidate_id"))).cast("int")
    return rows.withColumn("start", F.when(F.col("start").isNull(), unknown).otherwise(F.col("start")))
