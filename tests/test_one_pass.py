"""Selections by label, validation and presence read their rows once, and judge a text once for each batch."""

import random

import pytest
from pyspark.sql import functions as F

from quillspan.functions import labels as L
from quillspan.functions import rules as R
from quillspan.operators import calibrate, candidates, evaluate, select
from quillspan.plans import catalogue
from quillspan.sources import store
from quillspan.sources.studies import studies

SMALL = "/root/testdata/sf0.001"


def plan_of(df, kind="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


def test_each_label_by_its_rule(spark):
    rows = catalogue._features(spark, SMALL).cache()
    plain = calibrate.default_config(spark).drop("config_id", "source_mode")
    recommended = select.mode(rows, "registry_filtered").filter("doc_id % 2 = 0")
    unknown = recommended.limit(1).withColumn("candidate_id", F.lit("PAR-C9999"))
    names = ["registry_all", "registry_filtered", "pubmedbert_plus_verified", "expert_consensus_verified", None, "some_rule", "recommended"]
    for shift in range(0, len(names), 2):
        named = {x: names[(k + shift) % len(names)] for k, x in enumerate(L.LABELS)}
        rules = plain.join(spark.createDataFrame(list(named.items()), "label string, source_mode string"), "label")
        want = set()
        for label, name in named.items():
            if name == "recommended":
                one = recommended.select("doc_id", "label", "pos", "candidate_id")
            elif name in select.MODES:
                one = select.mode(rows, name)
            else:
                one = select.calibrated(rows, plain.withColumn("config_id", F.lit(0))).drop("config_id")
            want |= {tuple(r) for r in one.filter(F.col("label") == label).select("doc_id", "label", "pos", "candidate_id").collect()}
        got = [tuple(r) for r in select.by_source_mode(rows, rules, recommended.unionByName(unknown)).collect()]
        assert len(got) == len(set(got)) and set(got) == want and want
        assert set(map(tuple, select.by_source_mode(rows, rules).collect())) == {r for r in want if named[r[1]] != "recommended"}


def test_selection_by_source_mode_is_one_pass(spark, monkeypatch):
    monkeypatch.setattr(store, "placed", lambda *a, **k: pytest.fail("stored"))
    plan = plan_of(catalogue.QUERIES["selection_by_source_mode"](spark, SMALL))
    assert plan.count("MapInArrow") == 2 and plan.count("customer.parquet") <= 1 and "Union" not in plan


def test_validation_judges_texts_before_they_meet_their_source(spark):
    spoiled = catalogue._spoiled(spark, SMALL)
    odd = spark.createDataFrame([(1, None, 0, 3, "abc"), (1, "Outcome", None, 3, "abc"), (1, "Outcome", 0, 3, None), (-1, "Outcome", 0, 3, "abc"), (1, "Foreign", 5, 3, "x"), (1, "Outcome", 5, 3, "x")], spoiled.schema)
    every, docs = spoiled.unionByName(odd), studies(spark, SMALL)
    direct = every.join(docs.withColumnRenamed("text", "source"), "doc_id", "left").select(*every.columns, R.validation(F.coalesce("source", F.lit("")), F.col("label"), F.col("text"), F.col("start"), F.col("end")).alias("reason"))
    got = candidates.validated(every, docs)
    assert sorted(map(str, got.select(*direct.columns).collect())) == sorted(map(str, direct.collect()))
    above, below = plan_of(got.filter("reason = 'accepted'")).split("Join", 1)
    assert "broken_subword_fragment" not in above and "broken_subword_fragment" in below


def test_presence_is_one_pass(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(rng.randrange(30), rng.choice(L.LABELS), s, s + 2, rng.choice("gp")) for s in range(150)]
    both = spark.createDataFrame(rows, "doc_id long, label string, start int, end int, side string")
    has = {x: {(r[0], r[1]) for r in rows if r[4] == x} for x in "gp"}
    want = {}
    for label in L.LABELS:
        g, p = ({d for d, x in has[s] if x == label} for s in "gp")
        want[label] = (len(g & p), len(p - g), len(g - p), 40 - len(g | p))
    docs = spark.range(40).select(F.col("id").alias("doc_id"))
    for got in (evaluate.presence_of(docs, both), evaluate.presence_metrics(docs, both.filter("side = 'g'"), both.filter("side = 'p'"))):
        assert {r.label: (r.tp, r.fp, r.fn, r.tn) for r in got.collect()} == want
    monkeypatch.setattr(store, "stored", lambda *a, **k: pytest.fail("stored"))
    assert "FullOuter" not in plan_of(catalogue.QUERIES["presence_metrics"](spark, SMALL))
