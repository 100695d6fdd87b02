"""Pattern matches by Arrow batches, and patterns that give nothing back."""

import random
import re
import time

from pyspark.sql import functions as F

from quillspan.functions import labels as L
from quillspan.functions import rules as R
from quillspan.functions import text as T
from quillspan.operators import generate

WORDS = ["the", "a", "Students", "self-esteem", "program", "training", "12", "n = 40,", "B&C", "scale.", "participants", "x9", "aged 9 to 14", "\n", "　", "(", T.MARK, "é", "Index)", "coping", "skills; "]


def texts(rng):
    return ["".join(rng.choice(WORDS) + rng.choice([" ", " ", "  ", "", "-"]) for _ in range(rng.randrange(40))) for _ in range(400)] + [None, "", T.MARK]


def test_possessive_patterns_match_the_same(spark):
    df = spark.createDataFrame(list(enumerate(texts(random.Random(5)))), "doc_id long, text string")
    every = [p for strict in (False, True) for found in L.patterns(strict).values() for _, p in found]
    of = lambda p: F.regexp_extract_all("text", F.lit("(?is)" + p), 0)
    assert any(L.possessive(p) != p for p in every)
    differs = [of(p).eqNullSafe(of(L.possessive(p))) for p in every]
    assert df.filter(~F.forall(F.array(*differs), lambda same: same)).count() == 0


def test_spans_are_those_of_column_expressions(spark):
    df = spark.createDataFrame(list(enumerate(texts(random.Random(6)))), "doc_id long, text string")
    got = {tuple(r) for r in generate.pattern_spans(df).collect()}
    want = set()
    for label, found in L.patterns().items():
        for name, p in found:
            spans = F.filter(F.transform(T.matches(F.col("text"), p), T.trim_span), lambda s: s["end"] > s["start"])
            rows = df.select("doc_id", F.explode(spans).alias("s")).select("doc_id", F.lit(label), "s.*", F.lit(name))
            want |= {tuple(r) for r in rows.collect()}
    assert got == want and len(want) > 500
    whole = {r.doc_id: r.text for r in df.collect()}
    assert all(whole[d][s:e] == t and re.search(r"\S", t) for d, _, s, e, t, _ in got)


def test_long_prose_takes_little(spark):
    """Words of letters could be read in two ways each, 512 ways for nine words."""
    df = spark.createDataFrame([(k, "stress and sleep of many young people " * 12000) for k in range(4)], "doc_id long, text string")
    began = time.monotonic()
    assert generate.pattern_spans(df, ["Intervention"]).count() == 0
    assert time.monotonic() - began < 30


def test_reasons_of_distinct_pieces_are_those_of_places(spark):
    rows = [("two words here", s, e, t) for s, e in ((0, 3), (4, 9), (-1, 3), (3, 3), (10, 40)) for t in ("two", "words", "", "##a", "x", "12")]
    df = spark.createDataFrame(rows, "source string, start int, end int, text string")
    for label in ("Outcome", "SampleSize", "Foreign"):
        at = [F.col(c) for c in ("source", "text", "start", "end")]
        whole = df.withColumn("r", R.validation(at[0], F.lit(label), *at[1:])).groupBy("r").count()
        outside, other = R.misplaced(*at)
        once = df.select("text", outside.alias("outside"), other.alias("other")).groupBy("text", "outside", "other").agg(F.count("*").alias("n"))
        judged = once.withColumn("r", R.reason(F.lit(label), F.col("text"), F.col("outside"), F.col("other"))).groupBy("r").agg(F.sum("n").alias("count"))
        assert {tuple(r) for r in whole.collect()} == {tuple(r) for r in judged.collect()}
