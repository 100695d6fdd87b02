"""Gold spans put back on their texts, and records of two sources matched by shared keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import intervals as I
from ..functions import quotes
from ..functions import text as T
from ..sources.store import apart


def _repairs(text: str, spans: list[dict]) -> list[tuple]:
    """new_start, new_end, status of each span of a text, and what stands at its offsets where nothing was found."""
    out, lost = [None] * len(spans), []
    for k, s in enumerate(spans):
        start, end = s["start"], s["end"]
        valid = start is not None and end is not None and 0 <= start < end <= len(text)
        there = text[start:end] if valid else None
        if valid and there == s["wanted"]:
            out[k] = (start, end, "unchanged", None)
        else:
            lost.append((k, there))
    exact = quotes.places(text, [spans[k]["wanted"] for k, _ in lost if spans[k]["wanted"]])
    left = []
    for k, there in lost:
        at = quotes.nearest(exact.get(spans[k]["wanted"], []), spans[k]["start"])
        if at is None:
            left.append((k, there))
        else:
            out[k] = (at, at + len(spans[k]["wanted"]), "exact_repair", None)
    loose = quotes.flexible_places(text, [spans[k]["wanted"] for k, _ in left if spans[k]["wanted"]]) if left else {}
    for k, there in left:
        at = quotes.nearest(loose.get(spans[k]["wanted"], []), spans[k]["start"])
        out[k] = (*at, "whitespace_repair", None) if at else (spans[k]["start"], spans[k]["end"], "mismatch" if there is not None else "dropped", there)
    return out


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (key, text, spans): the spans as rows with their repairs."""
    for part in batches:
        many, flat = I.lengths(part.column(2)), part.column(2).flatten()
        found = [r for text, spans in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True) for r in _repairs(text or "", spans or [])]
        columns = [pa.array([r[c] for r in found], t) for c, t in enumerate((pa.int32(), pa.int32(), pa.string(), pa.string()))]
        rows = part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), many)))
        yield pa.RecordBatch.from_arrays([rows, *(flat.field(c) for c in ("label", "start", "end", "text", "wanted")), *columns], [part.schema.names[0], "label", "start", "end", "text", "wanted", "new_start", "new_end", "status", "there"])


def realigned(gold: DataFrame, sources: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """gold (key, label, start, end, text) with new offsets and how they came about.

    Escaped newlines of an annotation's text are newlines. Kept when the offsets give the text; else the nearest exact occurrence, else the nearest one with other white
    space; else the offsets stay when the texts are equivalent or at least valid (mismatch), and go when not.

    A text is read once for all its spans, and is not copied to them."""
    item = F.struct("label", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "text", T.annotated(F.col("text")).alias("wanted"))
    lists = gold.groupBy(key).agg(F.collect_list(item).alias("spans"))
    met = lists.join(apart(sources.select(key, F.col(text).alias("_source"))), key).select(key, "_source", "spans")
    fields = StructType.fromDDL("label string, start int, end int, text string, wanted string, new_start int, new_end int, status string, there string").fields
    rows = met.mapInArrow(_repaired, StructType([gold.schema[key], *fields]))
    equal = (F.col("status") == "mismatch") & (T.comparable(F.col("there")) == T.comparable(F.col("wanted")))
    return rows.select(key, "label", "start", "end", "text", "new_start", "new_end", F.when(equal, "equivalent").otherwise(F.col("status")).alias("status"), T.offset_distance(F.col("start"), F.col("new_start")).alias("moved"))


def gold_keys(file: Column, name: Column, index: Column) -> Column:
    """By what a gold record can be found: its number, its name, its file with and without ending."""
    stem = F.regexp_replace(F.element_at(F.split(file, "/"), -1), r"(?<=.)\.[^.]*$", "")
    return F.array_distinct(F.array(index.cast("string"), name, T.safe_name(file), T.safe_name(stem)))


def prediction_keys(index: Column, name: Column, input_type: Column, file: Column) -> Column:
    """By what a prediction can be found: its number and name, and its file where it didn't come from JSON records."""
    stem = F.regexp_replace(F.element_at(F.split(file, "/"), -1), r"(?<=.)\.[^.]*$", "")
    other = F.coalesce(input_type != "json", F.lit(True))
    values = F.array(index.cast("string"), name, F.when(other, file), F.when(other, stem))
    return F.array_distinct(F.transform(F.filter(values, lambda v: v.isNotNull() & (v != "")), T.safe_name))


def aligned(gold: DataFrame, predicted: DataFrame, gold_key: str, predicted_key: str, keys: str = "keys") -> DataFrame:
    """gold_key, predicted_key (only where exactly one prediction shares a key), matches (how many do).

    Gold of one key meets the key's count of predictions, so that a key which many share makes no pairs. Only gold of
    several keys is paired, since a prediction may share more than one of them."""
    a = gold.select(gold_key, F.explode_outer(keys).alias("k")).groupBy(gold_key).agg(F.collect_set("k").alias("ks"))
    b = predicted.select(predicted_key, F.explode(keys).alias("k")).filter("k IS NOT NULL").distinct()
    found = [F.count(predicted_key).alias("matches"), F.min(predicted_key).alias(predicted_key)]
    one = a.filter("size(ks) < 2").select(gold_key, F.get("ks", F.lit(0)).alias("k")).join(apart(b.groupBy("k").agg(*found)), "k", "left")
    one = one.select(gold_key, F.coalesce("matches", F.lit(0)).alias("matches"), predicted_key)
    pairs = a.filter("size(ks) > 1").select(gold_key, F.explode("ks").alias("k")).join(apart(b), "k", "left").select(gold_key, predicted_key).distinct()
    sums = one.unionByName(pairs.groupBy(gold_key).agg(*found))
    return sums.select(gold_key, F.when(F.col("matches") == 1, F.col(predicted_key)).alias(predicted_key), "matches")


def _taken(batches):
    """For mapInArrow over (gold, found) lists: gold in order takes its only prediction that is left."""
    for part in batches:
        rows = []
        for scope, pairs in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            used: set = set()
            for p in sorted(pairs, key=lambda p: p["place"]):
                left = [f for f in p["found"] or [] if f not in used]
                if len(left) == 1:
                    used.add(left[0])
                rows.append((scope, p["place"], left[0] if len(left) == 1 else None, len(left)))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["scope", "place", "prediction", "matches"])


def aligned_in_order(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """scope, place, prediction, matches: as aligned(), but a prediction that is taken no longer counts for later gold.

    gold: scope (a gold file), place, keys; predicted: prediction, source_file, keys. A scope's gold meets the predictions
    whose source file it is, or all where there is none. Scopes are independent."""
    own = predicted.join(gold.select(F.col("scope").alias("source_file")).distinct(), "source_file", "left_semi").select("source_file").distinct()
    scoped = gold.join(own.select(F.col("source_file").alias("scope"), F.lit(True).alias("own")), "scope", "left")
    a = scoped.select("scope", "place", "own", F.explode_outer("keys").alias("k"))
    b = predicted.select("prediction", "source_file", F.explode("keys").alias("k"))
    fits = F.col("own").isNull() | (F.col("scope") == F.col("source_file"))
    pairs = a.join(apart(b), "k", "left").select("scope", "place", F.when(fits, F.col("prediction")).alias("prediction")).distinct()
    found = pairs.groupBy("scope", "place").agg(F.array_sort(F.collect_set("prediction")).alias("found"))
    lists = found.groupBy("scope").agg(F.collect_list(F.struct(F.col("place").cast("long").alias("place"), F.transform("found", lambda x: x.cast("long")).alias("found"))).alias("pairs"))
    return lists.select("scope", "pairs").mapInArrow(_taken, "scope string, place long, prediction long, matches long")
