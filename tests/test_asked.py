"""Modes are fed what they ask for: nothing else is carried through the rules, and no table is stored for one reading."""

from __future__ import annotations

import pytest

from quillspan.operators import candidates, select
from quillspan.plans import catalogue
from quillspan.sources import store

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("name", "prune"), [("registry_all", True), ("majority_vote", True), ("majority_vote", False), ("pubmedbert_plus_verified", True), ("expert_consensus_verified", True)])
def test_modes_over_what_they_ask_for(spark, name, prune):
    whole = select.mode(catalogue._features(spark, SMALL), name, prune_contained=prune).collect()
    few = catalogue._features(spark, SMALL, *select.asked_by(name, prune))
    assert "confidence_by_expert" not in few.columns and "proposed_by_experts" not in few.columns
    assert whole and sorted(map(tuple, whole)) == sorted(map(tuple, select.mode(few, name, prune_contained=prune).collect()))


def test_a_mode_stores_no_table(spark, monkeypatch):
    monkeypatch.setattr(store, "placed", lambda *a, **k: pytest.fail("stored"))
    plan = catalogue.QUERIES["mode_registry_all"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "map_from_entries" not in plan


def test_ids_beyond_four_digits(spark):
    rows = spark.sql("SELECT 'P' AS p, n FROM VALUES (1), (9999), (10000), (123456) AS t(n)")
    assert [r[0] for r in rows.select(candidates._id(rows["p"], rows["n"])).collect()] == ["P-C0001", "P-C9999", "P-C10000", "P-C123456"]
