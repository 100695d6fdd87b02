"""Audit of how filters interact, for every order in which they could run.

Five filters fail a document for being short (A), repetitive (B), written in capitals (C), holding symbols (D) or being
a copy of a document with a smaller id (E). The failures of a document are a mask of five bits; a part's documents are
a histogram over the 32 masks, and so are its good and its toxic ones. Whatever happens to a document at a step of an
order depends on its mask alone, so outcomes are a matrix product: the histograms of parts, stacked as rows, times 0-1
matrices of 32 masks by 600 (order, step) pairs for kept, removed, redundant and unique.

Texts are read once, by JVM expressions, and never shuffled: a row leaves its task as a digest, its mask and its labels.
Copies are found on SHA-256 digests, first ids are pre-aggregated; digests that more than one in 10,000 rows has (fewer
than 10,000) are looked up by broadcast, the others by a merge join. Histograms are pre-aggregated too, so that a part
with a third of all rows is 32 rows a task. Parts stay dealt out to the end.

Defined cases: null texts are empty and equal to each other; null ids are smaller than none and count as the largest;
rows that repeat with the same id are no copies of each other; null sources are the part ''; several labels of an id
count if any of them says so, labels of null ids belong to nobody; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import itertools
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import durable

FILTERS = "ABCDE"
LEAST_WORDS = 50
LEAST_DISTINCT_PERCENT = 65
MOST_CAPITALS_PERCENT = 5
SYMBOLS = r"[#$%&*|]"
HOT_SHARE = 10_000
LAST = (1 << 63) - 1
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
STEPS = len(ORDERS) * len(FILTERS)


def outcome_matrices() -> dict[str, np.ndarray]:
    """kept, removed, redundant, unique: 32 masks by 600 (order, step) pairs; filter: 600 pairs by 5 filters."""
    bit = {f: 1 << k for k, f in enumerate(FILTERS)}
    own = np.array([bit[f] for order in ORDERS for f in order])
    before = np.array([sum(bit[f] for f in order[:k]) for order in ORDERS for k in range(len(order))])
    mask = np.arange(1 << len(FILTERS))[:, None]
    fails, gone = (mask & own) != 0, (mask & before) != 0
    out = {"kept": ~fails & ~gone, "removed": fails & ~gone, "redundant": fails & gone, "unique": mask == own, "filter": own[:, None] == np.array([bit[f] for f in FILTERS])}
    return {k: v.astype(np.int64) for k, v in out.items()}


def text_failures(text: Column) -> Column:
    """The bits of the filters A to D."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    counts = F.struct(F.size(words).alias("n"), F.size(F.array_distinct(words)).alias("distinct"))
    capitals = F.char_length(text) - F.char_length(F.translate(text, string.ascii_uppercase, ""))
    spaced = F.element_at(F.transform(F.array(counts), lambda c: F.when(c.n < LEAST_WORDS, 1).otherwise(0) + F.when(100 * c.distinct < LEAST_DISTINCT_PERCENT * c.n, 2).otherwise(0)), 1)
    shouted = F.when(100 * capitals.cast("long") > MOST_CAPITALS_PERCENT * F.char_length(text).cast("long"), 4).otherwise(0)
    return spaced + shouted + F.when(text.rlike(SYMBOLS), 8).otherwise(0)


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """doc_id, part, mask of every row."""
    text, doc = F.coalesce(F.col(text_col), F.lit("")), F.col(id_col).cast("long")
    rows = docs.select(doc.alias("doc_id"), F.coalesce(doc, F.lit(LAST)).alias("doc"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("sha"), text_failures(text).alias("bits"))
    rows = durable.stored(rows, "judged")
    groups = rows.groupBy("sha").agg(F.min("doc").alias("first"), F.count("*").alias("n")).filter("n > 1")
    groups = durable.stored(groups, "copied")
    hot = F.col("n") > (groups.agg(F.sum("n")).first()[0] or 0) / HOT_SHARE
    looked = rows.join(F.broadcast(groups.filter(hot).select("sha", F.col("first").alias("hot_first"))), "sha", "left")
    looked = looked.join(groups.filter(~hot).select("sha", "first").hint("merge"), "sha", "left")
    copy = F.coalesce(F.col("doc") > F.coalesce("hot_first", "first"), F.lit(False))
    return looked.select("doc_id", "part", (F.col("bits") + F.when(copy, 16).otherwise(0)).alias("mask"))


def histograms(judged: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents of each part with each mask, and how many of them have the labels."""
    known = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(F.max(F.expr("int(quality <=> 1)")).alias("is_good"), F.max(F.expr("int(toxic <=> 1)")).alias("is_toxic"))
    rows = judged.join(known.hint("merge"), "doc_id", "left")
    total = lambda c: F.sum(F.coalesce(c, F.lit(0))).cast("long")
    return rows.groupBy("part", "mask").agg(F.count("*").alias("n"), total("is_good").alias("good"), total("is_toxic").alias("toxic"))


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (part, masks): the outcomes of every order and step of a part."""
    by = outcome_matrices()
    orders = pa.array(np.repeat(ORDERS, len(FILTERS)).tolist())
    steps = pa.array(np.tile(np.arange(1, 1 + len(FILTERS), dtype=np.int32), len(ORDERS)))
    for part in (b.slice(k, 16) for b in batches for k in range(0, b.num_rows, 16)):
        stacked = np.zeros((part.num_rows, 3, 1 << len(FILTERS)), np.int64)
        for k, found in enumerate(part.column(1).to_pylist()):
            for x in found:
                stacked[k, :, x["mask"]] = x["n"], x["good"], x["toxic"]
        every = stacked[:, 0]
        removed = (stacked.reshape(-1, stacked.shape[2]) @ by["removed"]).reshape(part.num_rows, 3, STEPS)
        out = {"kept": every @ by["kept"], "removed": removed[:, 0], "redundant": every @ by["redundant"], "unique_fails": every @ by["unique"], "good_lost": removed[:, 1], "toxic_lost": removed[:, 2]}
        out["shapley"] = out["removed"] @ by["filter"] @ by["filter"].T
        named = [part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), STEPS))), pa.concat_arrays([orders] * part.num_rows), pa.concat_arrays([steps] * part.num_rows)]
        yield pa.RecordBatch.from_arrays([*named, *(pa.array(v.reshape(-1)) for v in out.values())], ["part", "filter_order", "step", *out])


def interactions(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, filter_order, step and the counts of the step's filter there: 600 rows for each part."""
    found = histograms(failures(docs, id_col, text_col, part_col), labels)
    parts = found.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    return parts.mapInArrow(_products, "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long")


def oracle_sql() -> str:
    """The rows of op12_filter_interaction_audit in DuckDB's SQL."""
    letters = "(VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16))"
    return rf"""
        WITH words AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        firsts AS (SELECT coalesce(text, '') AS t, min(doc_id) AS first FROM documents GROUP BY 1),
        known AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
        masks AS (SELECT part, (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT
                + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
                + 16 * (doc_id > first)::INT AS mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
            FROM words JOIN firsts USING (t) LEFT JOIN known USING (doc_id)),
        hist AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masks GROUP BY part, mask),
        orders AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM {letters} a(f, m), {letters} b(f, m), {letters} c(f, m), {letters} d(f, m), {letters} e(f, m)
            WHERE a.m + b.m + c.m + d.m + e.m = 31 AND len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
        steps AS (SELECT filter_order, step, l.f, l.m AS own, (SELECT coalesce(sum(p.m), 0) FROM {letters} p(f, m) WHERE instr(filter_order, p.f) < step)::INT AS before
            FROM orders, range(1, 6) r(step) JOIN {letters} l(f, m) ON substr(filter_order, step, 1) = l.f),
        counted AS (SELECT part, filter_order, step, f,
                sum(CASE WHEN mask & (own | before) = 0 THEN n ELSE 0 END) AS kept,
                sum(CASE WHEN mask & own != 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
                sum(CASE WHEN mask & own != 0 AND mask & before != 0 THEN n ELSE 0 END) AS redundant,
                sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
                sum(CASE WHEN mask & own != 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost,
                sum(CASE WHEN mask & own != 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
            FROM hist, steps GROUP BY part, filter_order, step, f)
        SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
            good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, sum(removed) OVER (PARTITION BY part, f)::BIGINT AS shapley
        FROM counted"""
