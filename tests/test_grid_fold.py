"""The grid of calibration is one fold over documents: no table is stored, and no token becomes a row."""

import pytest
from pyspark.sql import functions as F

from quillspan.functions import text as T
from quillspan.operators import calibrate, select
from quillspan.plans import catalogue
from quillspan.sources import store
from quillspan.sources.studies import distinct_studies

SMALL = "/root/testdata/sf0.001"


def test_tokens_in_batches(spark):
    import pyarrow as pa

    odd = ["", None, "a-b--c 'd' e’f_1-١", "-x-", "x-", "　 a b́ \U0001f600\U00010400-z", "'", "日本語、x²½-Ⅷ\n\t.", "a", "b-", "-c", " "]
    rows = spark.createDataFrame(list(enumerate(odd)), "k int, text string").select("k", T.tokens(F.col("text")).alias("t")).collect()
    want = [(r.k, t.text) for r in sorted(rows, key=lambda r: r.k) for t in r.t or []]
    points, ends, start, end = T.token_places(pa.array(odd), T.word_edges(spark))
    got = [(sum(e <= s for e in ends), points[s:e].tobytes().decode("utf-32-le")) for s, e in zip(start.tolist(), end.tolist(), strict=True)]
    assert got == want
    assert [len(x) for x in T.token_places(pa.array(["", None]), T.word_edges(spark))] == [0, 2, 0, 0]


def test_grid_best_config_is_one_fold(spark, monkeypatch):
    monkeypatch.setattr(store, "placed", lambda *a, **k: pytest.fail("stored"))
    plan = catalogue.QUERIES["grid_best_config"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and plan.count("MapInArrow") == 3


def test_fold_gives_scores_of_modes_and_rules(spark):
    rows = catalogue._features(spark, SMALL).filter("doc_id % 5 = 0").cache()
    docs = distinct_studies(spark, SMALL)
    beside = F.when(catalogue._is_gold(), F.struct(*catalogue._moved()))
    gold = rows.filter(catalogue._is_gold()).select("doc_id", "label", *catalogue._moved())
    tokens = docs.select("doc_id", F.posexplode(T.tokens(F.col("text"))).alias("ord", "t")).select("doc_id", "ord", "t.start", "t.end")
    chosen = select.mode(rows, "registry_all").filter("doc_id % 2 = 0")
    few = calibrate.grid(spark).filter("config_id % 37 = 5")
    score = lambda df: {(r.config_id, r.label): (r.tp, r.fp, r.fn) for r in df.collect()}
    want = score(calibrate.scored(rows, tokens, gold, few, calibrate.fixed_modes(spark), chosen))
    got = score(calibrate.grid_scored(rows, docs, beside, chosen))
    assert len(got) == 772 * 7 and {k: got[k] for k in want} == want
    assert got == score(calibrate.grid_scored(rows, docs, gold, chosen))
    assert got[0, "Outcome"][0] > 0 and score(calibrate.grid_scored(rows, docs, gold))[0, "Outcome"][0] == 0
