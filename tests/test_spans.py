"""Text, rules, folds and metrics against plain Python models and hand values."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillspan.functions import json_repair
from quillspan.functions import rules as R
from quillspan.functions import text as T
from quillspan.operators import calibrate, candidates, evaluate, generate, realign, select, votes
from quillspan.sources import records

TOKEN = re.compile("\\w+(?:[-’']\\w+)*|[^\\w\\s]")
UNIT = re.compile(r".+?(?:[.!?](?=\s+|$)|\n{2,}|$)", re.DOTALL)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    letters = "ab.!? \n\n-'x1,;:é😀"
    made = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(80)]
    return [*made, "", "No stop", "One. Two! Three?\n\nFour", "word " * 300]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_tokens_and_units(docs, texts):
    got = {}
    for r in generate.tokens(docs).collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["end"], r["text"]))
    for k, t in enumerate(texts):
        assert got.get(k, []) == [(m.start(), m.end(), m[0]) for m in TOKEN.finditer(t)]
    got = {}
    for r in generate.units(docs).collect():
        got.setdefault(r["doc_id"], []).append((r["sentence_id"], r["start"], r["end"], r["text"]))
    for k, t in enumerate(texts):
        wanted = []
        for m in UNIT.finditer(t):
            raw = m[0]
            if raw.strip():
                a = m.start() + len(raw) - len(raw.lstrip())
                b = m.start() + len(raw.rstrip())
                wanted.append((f"S{len(wanted) + 1:04d}", a, b, t[a:b]))
        if not wanted and t:
            wanted = [("S0001", 0, len(t), t)]
        assert got.get(k, []) == wanted


def test_matches_give_offsets(docs, texts):
    got = docs.select("doc_id", T.matches(F.col("text"), "a[bx]*|1+").alias("m")).collect()
    for r in got:
        assert [(m["start"], m["end"], m["text"]) for m in r["m"]] == [(m.start(), m.end(), m[0]) for m in re.finditer("a[bx]*|1+", texts[r["doc_id"]], re.IGNORECASE)]


def test_validation(spark):
    source = "The study included 212 students. (N = 12 people; x ANCO- was used in"
    cases = [("SampleSize", "212 students", "accepted"), ("Outcome", "The", "isolated_stopword"), ("Outcome", "was used in", "incomplete_trailing_word"), ("SampleSize", "(N = 12", "incomplete_sample_size_parenthesis"), ("StatisticalAnalysis", "ANCO-", "broken_subword_fragment"), ("Other", "study", "unsupported_label"), ("Outcome", "x", "one_character_alphabetic_fragment"), ("StatisticalAnalysis", "study", "short_statistical_fragment")]
    rows = [(1, label, text, source.index(text), source.index(text) + len(text), reason) for label, text, reason in cases]
    rows.append((1, "Outcome", "nothing", 0, 7, "text_offset_mismatch"))
    df = spark.createDataFrame(rows, "doc_id long, label string, text string, start int, end int, wanted string")
    out = candidates.validated(df, spark.createDataFrame([(1, source)], "doc_id long, text string")).collect()
    assert all(r["reason"] == r["wanted"] for r in out), [(r["text"], r["reason"]) for r in out if r["reason"] != r["wanted"]]
    span = F.struct(F.lit(0).alias("start"), F.length("text").alias("end"), F.col("text").alias("text"))
    long = spark.createDataFrame([("SampleSize", "The study included 212 students in total"), ("Participant", "recruited high school students,")], "label string, text string")
    assert [r["t"] for r in long.select(R.repaired(F.col("label"), span)["text"].alias("t")).collect()] == ["212 students", "high school students"]


def test_registry_merges_and_numbers(spark):
    raw = [(1, "SampleSize", 5, 9, "12 b", "expert", 0, "SciBERT", 0.6), (1, "SampleSize", 5, 9, "12 b", "expert", 1, "PubMedBERT", 0.9), (1, "SampleSize", 0, 3, "9 a", "pattern", 3, None, None)]
    df = spark.createDataFrame(raw, "doc_id long, label string, start int, end int, text string, origin string, origin_ord int, expert string, confidence double")
    got = {r["candidate_id"]: r for r in candidates.registry(df).collect()}
    assert got["SAM-C0001"]["proposed_by_experts"] == ["PubMedBERT", "SciBERT"] and got["SAM-C0001"]["confidence_by_expert"] == {"PubMedBERT": 0.9, "SciBERT": 0.6}
    assert got["SAM-C0002"]["text"] == "9 a"


def test_agreement(spark):
    rows = [(1, "keep", "keep", "keep"), (2, "reject", "reject", "keep"), (3, "keep", "missing", "keep"), (4, "reject", "reject", "reject")]
    matrix = spark.createDataFrame([("g", *r) for r in rows], "g string, candidate_id int, SciBERT string, PubMedBERT string, ClinicalBERT string")
    pairs = {(r["left_role"], r["right_role"]): r for r in votes.pairwise_agreement(matrix, ["g"]).collect()}
    assert pairs["SciBERT", "PubMedBERT"]["cohen_kappa"] == 1.0 and pairs["SciBERT", "PubMedBERT"]["n"] == 3
    assert pairs["SciBERT", "ClinicalBERT"]["keep_set_jaccard"] == pytest.approx(2 / 3)
    one = votes.consistency(matrix, ["g"]).first()
    assert (one["reviewed_by_all"], one["unanimous_keep"], one["unanimous_reject"], one["conflicted"], one["missing_decision"]) == (3, 1, 1, 1, 1)
    assert votes.fleiss(matrix, ["g"]).first()["fleiss_kappa"] == pytest.approx((7 / 9 - 41 / 81) / (1 - 41 / 81), abs=1e-9)
    reviews = spark.createDataFrame([(["a", "b"], ["b", "z"], ["a", "b", "c"])], "keep_ids array<string>, reject_ids array<string>, assigned_ids array<string>")
    r = votes.review_partition(reviews).first()
    assert (r["unknown_ids"], r["overlap_ids"], r["missing_ids"], r["valid"]) == (["z"], ["b"], ["c"], False)


def greedy(gold, pred, least):
    pairs = sorted(((max(0, min(g[1], p[1]) - max(g[0], p[0])) / (max(g[1], p[1]) - min(g[0], p[0])), i, j) for i, g in enumerate(gold) for j, p in enumerate(pred)), reverse=True)
    used_g, used_p, n = set(), set(), 0
    for s, i, j in pairs:
        if s >= least and i not in used_g and j not in used_p:
            used_g.add(i)
            used_p.add(j)
            n += 1
    return n


def test_metrics(spark):
    rng = random.Random(3)
    schema = "doc_id long, label string, start int, end int"
    spans = lambda: sorted((a, a + rng.randint(1, 9)) for a in (rng.randint(0, 40) for _ in range(6)))
    gold, pred = {k: spans() for k in range(10)}, {k: spans() for k in range(10)}
    g = spark.createDataFrame([(k, "Outcome", a, b) for k, x in gold.items() for a, b in x], schema)
    p = spark.createDataFrame([(k, "Outcome", a, b) for k, x in pred.items() for a, b in x], schema)
    row = {r["label"]: r for r in evaluate.relaxed_metrics(g, p, 0.5).collect()}
    assert row["Outcome"]["tp"] == sum(greedy(gold[k], pred[k], 0.5) for k in gold) and row["Participant"]["f1"] == 0.0
    chars = lambda x: {(k, c) for k, y in x.items() for a, b in y for c in range(a, b)}
    row = {r["label"]: r for r in evaluate.character_metrics(g, p).collect()}["Outcome"]
    assert (row["tp"], row["fp"], row["fn"]) == (len(chars(gold) & chars(pred)), len(chars(pred) - chars(gold)), len(chars(gold) - chars(pred)))


def test_realignment(spark):
    gold = [(1, "Outcome", 0, 3, "mood"), (1, "Outcome", 30, 40, "low  mood"), (1, "Outcome", 4, 8, "mood"), (1, "Outcome", 90, 95, "absent")]
    df = spark.createDataFrame(gold, "doc_id long, label string, start int, end int, text string")
    docs = spark.createDataFrame([(1, "Low mood and mood with low mood.")], "doc_id long, text string")
    got = sorted((r["start"], r["new_start"], r["status"]) for r in realign.realigned(df, docs).collect())
    assert got == [(0, 4, "exact_repair"), (4, 4, "unchanged"), (30, 23, "whitespace_repair"), (90, 90, "dropped")]


def test_grid_and_json(spark):
    assert calibrate.grid(spark, labels=["Outcome"]).count() == 768 and calibrate.fixed_modes(spark).count() == 28
    assert json_repair.parsed('```json\n{"a": [1,2,],}\n```') == {"a": [1, 2]}
    assert json_repair.parsed('say {"a": "}"} now') == {"a": "}"} and json_repair.parsed("[1]") is None
    broken = '{"decisions": [{"candidate_id": "A", "decision": "keep"}, {"candidate_id": "B", "decision": "reje'
    assert json_repair.decisions(broken, {"A", "B"}) == {"A": "keep"}


def test_contained_and_redundant(spark):
    rows = [(1, "Outcome", f"OUT-C000{k}", k, a, b, t, ["PubMedBERT"], {"PubMedBERT": 0.5}) for k, (a, b, t) in enumerate([(0, 22, "the depression symptoms"), (4, 22, "depression symptoms"), (40, 53, "anxiety score")], 1)]
    cands = spark.createDataFrame(rows, "doc_id long, label string, candidate_id string, number int, start int, end int, text string, proposed_by_experts array<string>, confidence_by_expert map<string,double>")
    matrix = votes.vote_matrix(cands, spark.createDataFrame([(1, "Outcome", f"OUT-C000{k}", r, "keep") for k in (1, 2, 3) for r in votes.ROLES], "doc_id long, label string, candidate_id string, role string, decision string"), ["doc_id", "label", "candidate_id"])
    feats = select.features(cands, matrix)
    ids = lambda name: [r["candidate_id"] for r in select.mode(feats, name).orderBy("pos").collect()]
    assert ids("majority_vote") == ["OUT-C0002", "OUT-C0003"] and ids("registry_all") == ["OUT-C0001", "OUT-C0002", "OUT-C0003"]
    assert len(ids("expert_consensus_verified")) == 2


def test_fixed_modes_are_tuned(spark):
    rows = [(1, "Participant", "PAR-C0001", 1, 0, 19, "four school parents", ["PubMedBERT"], {"PubMedBERT": 0.5}), (1, "Participant", "PAR-C0002", 2, 20, 34, "fifth children", [], {})]
    cands = spark.createDataFrame(rows, "doc_id long, label string, candidate_id string, number int, start int, end int, text string, proposed_by_experts array<string>, confidence_by_expert map<string,double>")
    cast = spark.createDataFrame([(1, "Participant", f"PAR-C000{k}", r, v) for k, v in ((1, "keep"), (2, "reject")) for r in votes.ROLES], "doc_id long, label string, candidate_id string, role string, decision string")
    feats = select.features(cands, votes.vote_matrix(cands, cast, ["doc_id", "label", "candidate_id"]))
    tokens = spark.createDataFrame([(1, 0, 0, 10), (1, 1, 11, 19), (1, 2, 20, 27), (1, 3, 28, 34)], "doc_id long, ord int, start int, end int")
    recommended = spark.createDataFrame([(1, "Participant", 0, "PAR-C0002"), (1, "Participant", 1, "PAR-C0009")], "doc_id long, label string, pos int, candidate_id string")
    rules = calibrate.grid(spark, labels=["Participant"], profiles=["equal"])

    def winner(spans, chosen=None):
        gold = spark.createDataFrame([(1, "Participant", a, b) for a, b in spans], "doc_id long, label string, start int, end int")
        best = {r["label"]: (r["config_id"], r["f1"]) for r in calibrate.tuned(feats, tokens, gold, rules, modes=calibrate.fixed_modes(spark), recommended=chosen).collect()}
        assert best["Outcome"] == (0, 0.0)
        return best["Participant"]

    assert winner([(0, 19), (20, 34)]) == (3, 1.0)  # only registry_filtered takes both
    assert winner([(0, 19)]) == (1, 1.0)  # a mode and rules tie: the first of the grid
    assert winner([(20, 34)], recommended) == (0, 1.0)


def test_records(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"tasks": [{"id": 7, "data": {"method_section": "M", "results_section": "R"}, "annotations": [{"was_cancelled": true, "result": []}, {"was_cancelled": false, "result": [{"type": "labels", "value": {"start": 0, "end": 1, "text": "M", "labels": ["Outcome", "x"]}}]}]}, {"method_section": "only"}]}')
    df = records.load_records(spark, str(tmp_path / "a.json"))
    got = df.select(records.model_input(F.col("record")).alias("t"), records.record_name(F.col("record"), F.col("record_index")).alias("n")).collect()
    assert [(r["t"], r["n"]) for r in got] == [("M\n\nR", "7"), ("only\n\n", "rec0001")]
    assert [tuple(r)[2:] for r in records.gold_items(df).collect()] == [("Outcome", 0, 1, "M")]
