"""Tables by document, votes in one aggregate, and schemas of answers."""

import json

import pytest
from pyspark.sql import functions as F

from quillspan.functions import answers
from quillspan.functions import labels as L
from quillspan.operators import votes
from quillspan.sources import store


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_placed_tables_need_no_exchange(spark):
    rows = spark.range(0, 5000, 1, 3).select((F.col("id") % 97).alias("doc_id"), (F.col("id") % 3).cast("string").alias("label"), "id")
    rows = rows.unionByName(spark.createDataFrame([(None, "0", -1), (5, None, -2), (None, None, -3)], "doc_id long, label string, id long"))
    table = store.placed(rows, "rows", ["doc_id", "label"])
    assert table.schema == rows.schema and sorted(table.collect(), key=str) == sorted(rows.collect(), key=str)
    counts = table.groupBy("doc_id", "label").agg(F.count("*").alias("n"))
    assert _exchanges(counts) == 0 and _exchanges(table.groupBy("doc_id", "label", "id").count()) == 0
    other = store.placed(rows.filter("id % 2 = 0"), "others", ["doc_id", "label"])
    met = table.hint("merge").join(other.groupBy("doc_id", "label").agg(F.max("id").alias("most")), ["doc_id", "label"])
    assert _exchanges(met) == 0
    plain = rows.join(rows.filter("id % 2 = 0").groupBy("doc_id", "label").agg(F.max("id").alias("most")), ["doc_id", "label"])
    assert sorted(met.collect()) == sorted(plain.collect())


def test_placed_after_a_shuffle_and_empty(spark):
    rows = spark.range(3000).select((F.col("id") % 50).alias("doc_id"), "id").groupBy("doc_id").agg(F.max("id").alias("most"))
    table = store.placed(rows, "maxima", ["doc_id"], together=True)
    assert sorted(table.collect()) == sorted(rows.collect())
    assert store.placed(rows.filter("false"), "empty", ["doc_id"]).count() == 0


def _voted_plainly(cands, cast, key):
    out = []
    for c in cands:
        said = {}
        for v in cast:
            if key(v) == key(c) and v[2] in votes.ROLES and v[3] in ("keep", "reject"):
                said.setdefault(v[2], set()).add(v[3])
        out.append((*c, *(max(said[r]) if r in said else "missing" for r in votes.ROLES)))
    return sorted(out, key=str)


def test_votes_meet_candidates_in_one_aggregate(spark):
    roles = [*votes.ROLES, "Somebody"]
    cands = [(d, f"C{k}", f"text {d}{k}" if k % 3 else None) for d in range(6) for k in range(5)] + [(None, "C0", "no id")]
    cast = [(d, f"C{k}", roles[(d + k + j) % len(roles)], ["keep", "reject", "unsure", None][(d * k + j) % 4]) for d in range(7) for k in range(6) for j in range(5)] + [(None, "C0", votes.ROLES[0], "keep")]
    left = spark.createDataFrame(cands, "doc_id long, candidate_id string, text string")
    right = spark.createDataFrame(cast, "doc_id long, candidate_id string, role string, decision string")
    got = votes.voted(left, right, ["doc_id", "candidate_id"])
    assert got.columns == ["doc_id", "candidate_id", "text", *votes.ROLES]
    assert sorted((tuple(r) for r in got.collect()), key=str) == _voted_plainly(cands, cast, lambda x: x[:2])
    only = votes.vote_matrix(left, right, ["doc_id", "candidate_id"])
    assert sorted((tuple(r) for r in only.collect()), key=str) == _voted_plainly([c[:2] for c in cands], cast, lambda x: x[:2])
    assert votes.voted(left.filter("false"), right, ["doc_id", "candidate_id"]).count() == 0
    assert {r[3] for r in votes.voted(left, right.filter("false"), ["doc_id", "candidate_id"]).collect()} == {"missing"}
    assert _exchanges(votes.voted(left, right, ["doc_id", "candidate_id"])) == 1


def test_schemas():
    made = answers.review(["B", "A", "B"], "Outcome")
    items = made["properties"]["decisions"]
    assert items["minItems"] == items["maxItems"] == 2 and items["items"]["properties"]["candidate_id"]["enum"] == ["B", "A"]
    assert items["items"]["required"] == ["candidate_id", "decision", "issue_type", "justification"]
    assert made["properties"]["expansion_requests"]["items"]["properties"]["label"]["enum"] == ["Outcome"]
    assert answers.review(["A"])["properties"]["expansion_requests"]["items"]["properties"]["label"]["enum"] == L.LABELS
    none = answers.review([], "Outcome")["properties"]["decisions"]
    assert none["maxItems"] == 0 and "enum" not in none["items"]["properties"]["candidate_id"]
    meta = answers.label_decision(["A"], [], "Outcome", False)["properties"]
    assert meta["expansion_requests"]["maxItems"] == meta["source_search_requests"]["maxItems"] == 0
    assert meta["expansion_requests"]["items"]["properties"]["parent_candidate_id"]["enum"] == ["A"] and "enum" not in meta["expansion_requests"]["items"]["properties"]["sentence_id"]
    assert set(answers.global_decision()["required"]) == {"final_candidate_ids_by_label", "cross_label_conflicts", "unresolved_candidates", "rationale"}
    assert answers.summary()["properties"]["summaries_by_label"] == {"type": "object", "additionalProperties": {"type": "string"}}


@pytest.mark.parametrize("allowed", [True, False])
def test_schema_columns_equal_the_functions(spark, allowed):
    rows = [(["A", "B", "A", None], ["S0001"], "Outcome"), ([], ["S0001", "S0002"], 'odd "label" \\ @ids@ \u00e9'), (["A"], [], "Outcome"), (None, None, "SampleSize"), (["A"], ["S0001"], None)]
    df = spark.createDataFrame(rows, "ids array<string>, sentences array<string>, label string")
    got = df.select(answers.review_column(F.col("ids"), F.col("label")), answers.label_decision_column(F.col("ids"), F.col("sentences"), F.col("label"), allowed)).collect()
    for (ids, sentences, label), (review, meta) in zip(rows, got, strict=True):
        if label is None:
            assert review is None and meta is None
            continue
        ids = [i for i in ids or [] if i is not None]
        assert json.loads(review) == answers.review(ids, label)
        assert json.loads(meta) == answers.label_decision(ids, sentences or [], label, allowed)
