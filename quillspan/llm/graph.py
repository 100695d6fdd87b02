"""Connected components of a table of links, by alternating stars.

Each round hangs every node on the least node that it sees, first from its larger neighbours and then from its
smaller ones; a few rounds leave one star for each component. Minima are pre-aggregated, joins are sort-merge joins
of stored tables, which Spark can split at a node with very many links, and nothing is gathered anywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import durable


def _lowest(links: DataFrame) -> DataFrame:
    """u, m: the least of a node and the nodes that it is linked to."""
    return durable.stored(links.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("m")), "low")


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 30))).first())


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) of all nodes that stand in links (src, dst) with another node."""
    pairs = links.filter("src != dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    stars = durable.stored(pairs.distinct(), "stars")
    before = None
    while (now := _state(stars)) != before and now[0]:
        before = now
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.filter("v > u").join(_lowest(both), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = durable.stored(large.distinct(), "large")
        low = _lowest(large)
        moved = large.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = durable.stored(moved.unionByName(low.select("u", F.col("m").alias("v"))).filter("u != v").distinct(), "stars")
    nodes = stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return durable.stored(nodes.unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "components")
