"""Joins of spans that overlap, without comparing each span of a document with each.

Spans live in bins of the smallest width that is no less than their length, so that a span stands in two bins at most.
The shorter span of a pair looks up the other one in the bins that it touches at the other one's width: that is an
equi-join on key, width and bin, which Spark shuffles, sorts and splits like any other; a document with very many spans
is many bins. A pair is reported once, in the bin where its shared part begins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import apart

WIDTHS = [32 * 4**k for k in range(13)]


def _level(size: Column) -> Column:
    """The first width that holds a span; spans beyond the last one share its level, in as many bins as they need."""
    out = F.lit(len(WIDTHS) - 1)
    for k in range(len(WIDTHS) - 2, -1, -1):
        out = F.when(size <= WIDTHS[k], k).otherwise(out)
    return out


def _width(level: Column) -> Column:
    return F.element_at(F.array(*(F.lit(w) for w in WIDTHS)), level + 1)


def _binned(rows: DataFrame, key: str, name: str, levels: Column) -> DataFrame:
    """A row for each bin of each wanted level; name: the span with its columns."""
    placed = rows.select(F.col(key).alias("_key"), name, "own", F.explode(levels).alias("level"))
    first, last = (F.floor(c / _width(F.col("level"))) for c in (F.col(f"{name}.start"), F.col(f"{name}.end") - 1))
    return placed.select("_key", name, "own", "level", F.explode(F.sequence(first, last)).alias("bin"))


def overlap_join(left: DataFrame, right: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, a, b (structs of all columns of a left and a right row): all pairs of the same key whose spans share a character.

    Spans have the columns start and end; empty and inverted ones overlap nothing, nor do null keys."""
    size = (F.col("end") - F.col("start")).cast("long")
    side = lambda df, name: df.filter("end > start").select(key, F.struct("*").alias(name), _level(size).alias("own"))
    a, b = side(left, "a"), side(right, "b")
    # At most as many rows as widths: those that occur.
    used = sorted(r[0] for r in a.select("own").union(b.select("own")).distinct().collect())
    known = F.array(*(F.lit(k) for k in used)).cast("array<int>")
    home = F.array("own")
    parts = []
    # Of equal levels only a looks up b, so that no pair comes twice.
    for (low, lower), (up, upper), least in (((a, "a"), (b, "b"), F.col("own")), ((b, "b"), (a, "a"), F.col("own") + 1)):
        asked = _binned(low, key, lower, F.array_except(known, F.sequence(F.lit(-1), least - 1)))
        met = asked.drop("own").join(apart(_binned(up, key, upper, home).drop("own")), ["_key", "level", "bin"])
        start, end = F.greatest("a.start", "b.start"), F.least("a.end", "b.end")
        met = met.filter((start < end) & (F.floor(start / _width(F.col("level"))) == F.col("bin")))
        parts.append(met.select(F.col("_key").alias(key), "a", "b"))
    return parts[0].unionByName(parts[1])
