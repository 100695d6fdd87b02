"""Spans that are numbered where they are found: what sorting, grouping and windows over all matches give, without their shuffles."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspan.functions import text as T
from quillspan.operators import generate
from quillspan.plans import catalogue

SMALL = "/root/testdata/sf0.001"
WORDS = ["Students", "program", "training", "n = 40,", "participants", "children aged 9 to 14", "\n", "(", "coping", "skills", "stress score", "café", "scale", "usual care", "12", T.MARK]


def test_numbered_spans_are_the_deduplicated_ones_in_order(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(WORDS if k % 3 else WORDS[:11]) for _ in range(rng.randrange(40))) for k in range(400)] + [None, "", "café " * 3000 + "12 students"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    place = Window.partitionBy("doc_id", "label").orderBy("start", "end", "text")
    want = generate.deduplicated(generate.pattern_spans(docs)).withColumn("number", F.row_number().over(place)).select("doc_id", "label", "start", "end", "text", "method", "number").collect()
    got = generate.numbered_spans(docs)
    assert got.columns == ["doc_id", "label", "start", "end", "text", "method", "number"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want)) and len(want) > 2000
    assert docs.filter(F.col("text").rlike(T.NOT_PLAIN)).count() > 100
    some = generate.numbered_spans(docs, ["Outcome", "SampleSize"]).collect()
    assert sorted(map(tuple, some)) == sorted(tuple(r) for r in want if r.label in ("Outcome", "SampleSize"))


def test_a_text_is_numbered_whole_wherever_batches_end(spark):
    docs = spark.createDataFrame([(k, "café: 12 students, stress score; " * 30) for k in range(20)], "doc_id long, text string").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        got = generate.numbered_spans(docs).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, got)) == sorted(map(tuple, generate.numbered_spans(docs).collect()))
    assert len({(r.doc_id, r.label, r.number) for r in got}) == len(got) > 1000


def test_candidates_shuffle_keys_only(spark):
    plan = catalogue.pattern_candidates(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Window" not in plan and "hashpartitioning(c_custkey" in plan


def test_customers_that_stand_twice_give_their_candidates_once(spark, tmp_path):
    one = spark.read.parquet(f"{SMALL}/customer.parquet")
    one.unionByName(one).write.parquet(f"{tmp_path}/customer.parquet")
    assert sorted(map(str, catalogue.pattern_candidates(spark, str(tmp_path)).collect())) == sorted(map(str, catalogue.pattern_candidates(spark, SMALL).collect()))
