"""Clauses and tokens of whole texts are cut, placed and counted in batches, and their texts are not shuffled."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillspan.functions import text as T
from quillspan.operators import generate
from quillspan.plans import wider

ODD = [
    "One, two: (three); ‘four’ – fünf-sechs.", "", None, " . ;  ; .x  ", "　a　; b :\n\n(c).", ",;:)", "日本語。x.y\U0001f600.z", "no end", "...", "a.\u0085 b. \u0085",
    "\t\n", "x;", ";x", "“q”; '; \"", " - . -a- ; b-c'd’e ",
]


def test_pieces_are_those_of_the_columns(spark):
    whole = F.struct(F.lit(0).alias("start"), F.length("text").alias("end"), F.col("text").alias("text"))
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(ODD)], "k int, text string")
    rows = docs.select("k", T.clauses(whole).alias("clause"), T.tokens(F.col("text")).alias("token")).collect()
    edges = T.word_edges(spark)
    for texts, at in ((pa.array(ODD), 0), (pa.array(["zz", *ODD, "y"]).slice(1, len(ODD)), 0), (pa.array([], pa.string()), None)):
        for kind, row, found, outside, other in generate.judged_pieces(texts, edges):
            want = [] if at is None else sorted((r.k, s.text) for r in rows for s in r[kind] or [])
            assert sorted(zip(row.tolist(), found.to_pylist(), strict=True)) == want, kind
            assert not outside.any() and not other.any()


def test_another_text_is_seen():
    data = np.frombuffer("abc äbc".encode(), np.uint8)
    at, to = np.array([0, 4, 4, 0, 2]), np.array([3, 6, 6, 3, 2])
    assert generate._different(data, at, to, pa.array(["abc", "ä", "ö", "ab", ""])).tolist() == [False, False, True, True, False]


def test_texts_of_pieces_are_not_shuffled(spark):
    plan = wider.QUERIES["validation_documents"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    shuffled = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    assert shuffled and all("text#" not in line for line in shuffled) and "MapInArrow" in plan
