"""Models as plugged-in functions, the run from raw spans to final ones, the grid in one row a group, and reports."""

import json

import pytest
from pyspark.sql import functions as F

from quillspan.functions import answers
from quillspan.functions import labels as L
from quillspan.operators import calibrate, candidates, consultation, evaluate, external, generate, reports, select, votes

TEXT = "Middle school students aged 12 to 14 participated. The mindfulness curriculum included 8 weekly sessions. Outcomes included anxiety symptoms and the SDQ scale. N = 63 participants completed the trial."


def test_windows():
    assert external.windows(10) == [(0, 10)] and external.windows(900) == [(0, 512), (384, 896), (768, 900)]


def test_experts_to_registry(spark):
    def by_words():
        """A scorer: words that hold 63 or 'participants' are SampleSize; others are nothing. The first row is special."""

        def score(text):
            out, at = [(0, 0, True, [1.0] * 7)], 0
            for w in text.split(" "):
                p = [0.0] * 7
                p[L.LABELS.index("SampleSize")] = 0.9 if w in ("63", "participants") else 0.1
                out.append((at, at + len(w), False, p))
                at += len(w) + 1
            return out

        return score

    docs = spark.createDataFrame([(1, TEXT), (2, None)], "doc_id long, text string")
    probs = external.probabilities(docs, {e: by_words for e in L.EXPERTS[:2]})
    thresholds = spark.createDataFrame([(e, x, 0.5) for e in L.EXPERTS for x in L.LABELS], "expert string, label string, threshold double")
    raw = external.expert_spans(probs, thresholds, docs)
    got = raw.orderBy("ord").collect()
    assert [(r["expert"], r["text"], r["confidence"], r["section"]) for r in got] == [("SciBERT", "63 participants", 0.9, "unknown"), ("PubMedBERT", "63 participants", 0.9, "unknown")]
    registry, _ = candidates.registered(raw, docs)
    assert [(r["candidate_id"], r["proposed_by_experts"]) for r in registry.collect()] == [("SAM-C0001", ["PubMedBERT", "SciBERT"])]
    grown, new = candidates.pre_expanded(docs, registry)
    by_label = {}
    for r in grown.collect():
        assert r["text"] == TEXT[r["start"] : r["end"]]
        by_label.setdefault(r["label"], []).append(r["text"])
    assert any("mindfulness curriculum" in t for t in by_label["Intervention"]) and "anxiety symptoms" in by_label["Outcome"] and any("N = 63" in t for t in by_label["SampleSize"])
    assert {r["origin"] for r in new.collect()} == {"deterministic_pre_expansion"} and new.filter("number = 1 AND label = 'SampleSize'").count() == 0
    _, two = candidates.pre_expanded(docs, registry, most=2)
    assert max(r["count"] for r in two.groupBy("label").count().collect()) == 2


def test_answers(spark):
    schema = answers.review(["A", "B"], "Outcome")
    said = []

    def chat(system, user, schema, most):
        said.append((system == external.REPAIR, schema is None, most))
        if user == "long" and most is None:
            raise ValueError("maximum context length is 100 tokens but the request has 60 input tokens")
        if user == "down":
            raise ValueError("no server")
        if user == "broken" and system != external.REPAIR and schema is not None or system == external.REPAIR and "never" in user:
            return "no json" if "never" not in user else "still none"
        if user.startswith("never"):
            return "{}" if schema is None else "never"
        return '{"decisions": [{"candidate_id": "A", "decision": "keep"}]}'

    assert external.answer(chat, "s", "plain", schema)[1] == "structured"
    assert external.answer(chat, "s", "long", schema)[1] == "structured" and said[-1] == (False, False, 40)
    assert external.answer(chat, "s", "broken", schema)[1] == "repaired"
    value, how, _ = external.answer(chat, "s", "never", schema)
    assert how == "unstructured" and json.loads(value)["_used_unstructured_json_fallback"]
    assert external.answer(chat, "s", "down", schema) == (None, "failed", "no server")

    def factory():
        return lambda system, user, schema, most: '{"decisions": []}'

    asked = spark.createDataFrame([(1, "s", "u", json.dumps(schema))], "doc_id long, system string, user string, schema string")
    assert [tuple(r) for r in external.answered(asked, factory, ["doc_id"]).collect()] == [(1, '{"decisions": []}', "structured", None)]
    with pytest.raises(RuntimeError):
        external.check_model("m", ["other"])
    external.check_model("m", ["m"])
    meta = answers.label_decision(["A"], ["S0001"], "Outcome", False)
    assert meta["properties"]["expansion_requests"]["maxItems"] == 0


def test_reviews_are_asked_again(spark):
    assigned = spark.createDataFrame([(1, "A"), (1, "B"), (1, "C"), (2, "A")], "doc_id long, candidate_id string")
    pair = "array<struct<candidate_id:string,decision:string>>"

    def ask(left, attempt):
        ids = {(r["doc_id"], r["candidate_id"]) for r in left.collect()}
        if attempt == 0:
            return spark.createDataFrame([(1, [("A", "keep")]), (2, [("A", "reject"), ("X", "keep")])], f"doc_id long, decisions {pair}")
        assert attempt > 1 or ids == {(1, "B"), (1, "C"), (2, "A")}
        return spark.createDataFrame([(1, [("B", "reject")])] + ([(2, [("A", "keep")])] if attempt == 1 else []), f"doc_id long, decisions {pair}")

    got = {r["doc_id"]: r for r in external.reviewed(assigned, ask, ["doc_id"], retries=2).collect()}
    assert got[1]["decided"] == {"A": "keep", "B": "reject"} and got[1]["missing_ids"] == ["C"] and not got[1]["valid"]
    assert got[2]["decided"] == {"A": "keep"} and got[2]["valid"] and got[2]["attempts"] == 2


def test_run(spark):
    docs = spark.createDataFrame([(1, TEXT)], "doc_id long, text string")
    at = TEXT.index("N = 63")
    raw = spark.createDataFrame([(1, 0, "SampleSize", at, at + 19, TEXT[at : at + 19], "PubMedBERT", 0.9, 0.5, "methods", "expert")], "doc_id long, ord int, label string, start int, end int, text string, expert string, confidence double, threshold double, section string, origin string")
    request = consultation._REQUEST
    reviews = spark.createDataFrame([(1, "SampleSize", 1, r, [("SAM-C0001", "keep")], [], [], []) for r in L.EXPERTS], f"doc_id long, label string, round int, role string, decisions array<struct<candidate_id:string,decision:string>>, keep_ids array<string>, reject_ids array<string>, requests array<{request}>")
    meta = spark.createDataFrame([(1, "SampleSize", 1, ["SAM-C0001"], [], ["SAM-C0001"], [])], f"doc_id long, label string, round int, selected array<string>, unresolved array<string>, proofs array<string>, requests array<{request}>")
    out = consultation.run(docs, raw, reviews, meta, max_rounds=1)
    assert [(r["label"], r["text"]) for r in out["final"].collect()] == [("SampleSize", "N = 63 participants")]
    state = {r["label"]: r for r in out["state"].collect()}
    assert state["SampleSize"]["best_round"] == 1 and state["SampleSize"]["final_ids"] == ["SAM-C0001"]
    plain = consultation.run(docs, raw, reviews, meta, policy="pubmedbert_only", max_rounds=1)["final"].collect()
    assert [r["candidate_id"] for r in plain] == ["SAM-C0001"]
    shown = {r["label"]: r["spans"] for r in reports.overview(out["final"], out["state"]).collect()}
    assert shown["SampleSize"] == 1


def test_grid_in_one_row_a_group(spark):
    """The shortcut over sets of votes and experts gives what scoring each configuration gives."""
    import random

    rng = random.Random(3)
    texts = ["63 students in the control group", "anxiety symptoms", "the SDQ scale score", "12 schools", "depression score", "control group n = 20", "mood"]
    rows, cast, at = [], [], 0
    for doc in (1, 2, 3):
        for label in ("SampleSize", "Outcome"):
            for k in range(1, 6):
                t = rng.choice(texts)
                at = (at + rng.randint(0, 9)) % 50
                experts = sorted(rng.sample(L.EXPERTS, rng.randint(0, 3)))
                cid = f"{L.PREFIX[label]}-C{k:04d}"
                rows.append((doc, label, at, at + len(t), t, "x", experts, {e: rng.choice([0.2, 0.55, 0.95]) for e in experts}, cid, k))
                cast += [(doc, label, cid, r, d) for r in L.EXPERTS if (d := rng.choice(["keep", "reject", "missing"])) != "missing"]
    cands = spark.createDataFrame(rows, "doc_id long, label string, start int, end int, text string, origin string, proposed_by_experts array<string>, confidence_by_expert map<string,double>, candidate_id string, number int")
    matrix = votes.vote_matrix(cands, spark.createDataFrame(cast, "doc_id long, label string, candidate_id string, role string, decision string"), ["doc_id", "label", "candidate_id"])
    feats = select.features(cands, matrix)
    docs = generate.token_arrays(spark.createDataFrame([(d, "word " * 20) for d in (1, 2, 3)], "doc_id long, text string"))
    tokens = docs.select("doc_id", F.posexplode("tokens").alias("ord", "t")).select("doc_id", "ord", "t.start", "t.end")
    gold = cands.filter("number % 2 = 0").select("doc_id", "label", "start", "end")
    labels = ["SampleSize", "Outcome"]
    slow = calibrate.scored(feats, tokens, gold, calibrate.grid(spark, labels=labels, profiles=["equal", "pubmedbert_weighted"])).collect()
    fast = {(r["config_id"], r["label"]): (r["tp"], r["fp"], r["fn"]) for r in calibrate.grid_scored(feats, docs, gold).collect()}
    skip = len(L.VOTE_FRACTIONS) * len(L.EXPERT_SUPPORTS) * len(L.CONFIDENCES) * 2
    first = len(L.FIXED_MODES)
    for r in slow:
        k = r["config_id"] - first
        place = first + (k if k < skip else k + skip)  # the second profile here is the third of the whole grid
        assert fast[(place, r["label"])] == (r["tp"], r["fp"], r["fn"])
    assert len(fast) == 772 * 7


def test_readable(spark):
    one = evaluate.rolled_up(spark.createDataFrame([("Outcome", 1, 1, 0)], "label string, tp long, fp long, fn long")).withColumn("family", F.lit("exact"))
    lines = {r["label"]: (r["place"], r["line"]) for r in reports.readable(one).collect()}
    assert lines["Outcome"][1].startswith("Outcome                precision=0.5000 recall=1.0000 f1=0.6667 tp=1") and lines["macro"][0] > lines["micro"][0] > lines["Outcome"][0]
