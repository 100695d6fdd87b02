"""What the Jaccard join sends: few copies of a large component's sets, no table that is done with."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import functions as F

from quillspan.llm import durable, jaccard


def test_copies_of_a_large_component_are_bounded(spark):
    """6,000 sets of one component: each is sent about CHUNKS times, and all pairs whose sizes allow a link meet."""
    n = 6_000
    reps = spark.range(n).select(F.col("id").alias("node"), F.col("id").alias("doc_id"), F.lit(b"x").alias("signature"), (F.lit(100) + F.col("id") % 40).cast("long").alias("n_shingles"))
    found = spark.range(n).select(F.col("id").alias("node"), F.lit(0).cast("long").alias("component"))
    got = jaccard.chunked(found, reps, 85).collect()
    assert len(got) == n and max(len(r["others"]) for r in got) <= jaccard.CHUNKS + 3
    at = {r["node"]: r for r in got}
    size = {r["node"]: 100 + r["node"] % 40 for r in got}
    for x in range(0, 400, 7):
        for y in range(0, 400, 3):
            if 100 * min(size[x], size[y]) >= 85 * max(size[x], size[y]):
                assert at[y]["chunk"] in at[x]["others"] and at[x]["chunk"] in at[y]["others"]


def test_sizes_at_the_threshold_lie_in_neighbouring_bands(spark):
    pairs = spark.range(1, 60_000).select(F.col("id").alias("large"), F.ceil(F.col("id") * 85 / 100).alias("small"))
    far = pairs.filter(jaccard.size_band(F.col("large"), 85) - jaccard.size_band(F.col("small"), 85) > 1)
    assert far.count() == 0


def test_prefixes_are_dropped_when_done(spark):
    """When the result is read, the shared folder holds neither sets nor prefixes."""
    folder = Path(durable.shared_folder(spark).removeprefix("file://"))
    before = set(os.listdir(folder)) if folder.exists() else set()
    docs = spark.createDataFrame([(k, f"one two three four five six seven {k % 3}") for k in range(30)], "doc_id long, text string")
    assert jaccard.similar_groups(docs).count() == 30
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before}
    assert "rows" in left and not left & {"sets", "reps", "prefixes"}


def test_repeated_ids_come_once_to_a_comparison(spark):
    docs = spark.createDataFrame([(k % 4, "a b c d e f g h i j k l m n o p q r s t" + " u" * (k % 2)) for k in range(40)], "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"]) for r in jaccard.similar_groups(docs).collect()}
    assert got == {(k, 0) for k in range(4)}
