"""Expansion requests, reviews, replayed consultation, meta decisions, registry, salvage, guidelines, files and reports."""

import json

import pytest
from pyspark.sql import functions as F

from quillspan.functions import json_repair, prompts
from quillspan.functions import labels as L
from quillspan.functions import text as T
from quillspan.operators import candidates, consultation, expansion, generate, guidelines, integrity, meta, realign, reports, select, votes
from quillspan.sources import calibration, records

TEXT = "The wait-list control group continued usual care. N = 63 participants completed the trial."
NONE = "array<string>"


def bank(spark, rows, text=TEXT):
    """Registry rows (label, start, end) of document 1."""
    made, seen = [], {}
    for label, a, b in rows:
        seen[label] = seen.get(label, 0) + 1
        made.append((1, label, a, b, text[a:b], "expert", ["PubMedBERT"], {"PubMedBERT": 0.9}, f"{L.PREFIX[label]}-C{seen[label]:04d}", seen[label]))
    return spark.createDataFrame(made, "doc_id long, label string, start int, end int, text string, origin string, proposed_by_experts array<string>, confidence_by_expert map<string,double>, candidate_id string, number int")


def ask(spark, asked, registry, ledger=None, text=TEXT):
    rows = [(1, k, *(r.get(c) for c in expansion.SIGNATURE)) for k, r in enumerate(asked)]
    df = spark.createDataFrame(rows, "doc_id long, ord int, " + ", ".join(f"{c} string" for c in expansion.SIGNATURE))
    return expansion.outcomes(df, spark.createDataFrame([(1, text)], "doc_id long, text string"), registry, ledger)


def request(operation, label="ComparisonGroup", **more):
    return {"label": label, "requested_operation": operation, **more}


def test_expansion_outcomes(spark):
    a = TEXT.index("wait-list control group")
    registry = bank(spark, [("ComparisonGroup", a, a + 23)])
    first, second = TEXT[:49], TEXT[50:]
    asked = [
        request("exact_quote_proposal", proposed_text="usual care", sentence_id="S0001"),
        request("exact_quote_proposal", proposed_text="regular healthcare"),
        request("exact_quote_proposal", proposed_text="wait-list control group", sentence_id="S0001"),
        request("exact_quote_proposal", proposed_text="wait-list control group", sentence_id="S0001"),
        request("exact_quote_proposal", proposed_text="regular healthcare"),
        request("generate_number_centered_span", "SampleSize"),
        request("expand_to_sentence_start", sentence_id="S0001"),
        request("expand_to_sentence_end", sentence_id="S9999"),
        request("split_by_sentence", parent_candidate_id="COM-C9999"),
        request("exact_quote_proposal", proposed_text="  "),
        request("exact_quote_proposal", proposed_text="usual care", sentence_id="S0009"),
        request("trim_left", parent_candidate_id="COM-C0001"),
        request("exact_quote_proposal", "Nothing", proposed_text="usual care"),
        request("exact_quote_proposal", proposed_text="c"),
        request("expand_to_sentence_end", parent_candidate_id="COM-C0001"),
        request("expand_to_sentence_end", parent_candidate_id="COM-C0001", sentence_id="S0002"),
    ]
    made = ask(spark, asked, registry)
    got = {r["ord"]: r for r in made.collect()}
    assert [got[k]["status"] for k in range(6)] == ["candidate_appended", "unresolved", "already_exists", "previously_resolved", "previously_unresolved", "candidate_appended"]
    assert [c["text"] for c in got[0]["added"]] == ["usual care"] and got[2]["candidate_id"] == got[3]["candidate_id"] == "COM-C0001"
    assert [c["text"] for c in got[5]["added"]] == ["N = 63 participants"] and got[5]["candidate_id"] == "SAM-C0001"
    assert [c["text"] for c in got[6]["added"]] == [first] and got[6]["origin"] == "missing_label_recovery"
    assert [got[k]["reason"] for k in (1, 7, 8, 9, 10, 11, 12, 13)] == ["proposed_text_not_found", "unknown_sentence_id", "unknown_parent_candidate_id", "empty_proposed_text", "proposed_text_not_found", "unsupported_operation", "unsupported_label", "ambiguous_proposed_text"]
    assert [c["text"] for c in got[14]["added"]] == [TEXT[a:49]] and got[15]["reason"] == "parent_not_inside_requested_source_unit"
    again = {r["ord"]: r["status"] for r in ask(spark, asked[:2], registry, made).collect()}
    assert again == {0: "previously_resolved", 1: "previously_unresolved"}
    new = expansion.appended(made).collect()
    assert sorted((r["candidate_id"], r["text"] == TEXT[r["start"] : r["end"]]) for r in new) == [("COM-C0002", True), ("COM-C0003", True), ("COM-C0004", True), ("SAM-C0001", True)]
    names = ["S0001 0:49", "S0001_0", "s0001", str(len(first) + 1)]
    for name, text in zip(names, (first, first, first, second), strict=True):
        one = ask(spark, [request("expand_to_sentence_end", "SampleSize" if text == second else "ComparisonGroup", sentence_id=name)], registry).first()
        assert [c["text"] for c in one["added"]] == [text]


def test_split_and_search(spark):
    text = "The control group, usual care; nothing else. The placebo arm ended."
    registry = bank(spark, [("ComparisonGroup", 0, 44), ("ComparisonGroup", 4, 17)], text)
    got = ask(spark, [request("split_by_clause", parent_candidate_id="COM-C0001"), request("split_by_sentence", parent_candidate_id="COM-C0001"), request("split_by_sentence", parent_candidate_id="COM-C0002"), request("search_missing_label")], registry, text=text).orderBy("ord").collect()
    assert [c["text"] for c in got[0]["added"]] == ["The control group", " usual care", " nothing else."]
    assert got[1]["status"] == "already_exists" and got[2]["reason"] == "no_valid_split_candidate"
    assert got[3]["status"] == "already_exists" and got[3]["candidate_id"] == "COM-C0001"
    none = ask(spark, [request("search_missing_label", "StatisticalAnalysis")], registry, text=text).first()
    assert (none["status"], none["reason"]) == ("unresolved", "no_missing_label_candidate_found")


REVIEW = "doc_id long, label string, round int, role string, decisions array<struct<candidate_id:string,decision:string>>, keep_ids array<string>, reject_ids array<string>, requests array<" + consultation._REQUEST + ">"
META = "doc_id long, label string, round int, selected array<string>, unresolved array<string>, proofs array<string>, requests array<" + consultation._REQUEST + ">"


def replayed(spark, registry, rounds, max_rounds=3, text=TEXT):
    """rounds: for each round the decisions of the three roles, requests of the first one, and the meta decision."""
    reviews, decided = [], []
    for k, (said, asked, selected, more) in enumerate(rounds, 1):
        for role, each in zip(L.EXPERTS, said, strict=True):
            wanted = [tuple(r.get(c) for c in expansion.SIGNATURE) for r in (asked if role == L.EXPERTS[0] else [])]
            reviews.append((1, "ComparisonGroup", k, f"{role}_ComparisonGroup", list(each.items()), [], [], wanted))
        decided.append((1, "ComparisonGroup", k, selected, [], more.get("proofs", selected), [tuple(r.get(c) for c in expansion.SIGNATURE) for r in more.get("requests", [])]))
    sources = spark.createDataFrame([(1, text)], "doc_id long, text string")
    state, after = consultation.replay(registry, sources, spark.createDataFrame(reviews, REVIEW), spark.createDataFrame(decided, META), max_rounds)
    return state.first(), after


def test_consultation_until_all_agree(spark):
    a = TEXT.index("wait-list control group")
    registry = bank(spark, [("ComparisonGroup", a, a + 23)])
    keep, both = {"COM-C0001": "keep"}, {"COM-C0001": "keep", "COM-C0002": "keep"}
    quote = request("exact_quote_proposal", proposed_text="usual care", sentence_id="S0001")
    state, after = replayed(spark, registry, [([keep] * 3, [quote], ["COM-C0001"], {}), ([both] * 3, [], ["COM-C0001", "COM-C0002"], {})])
    assert (state["rounds"], state["termination"], state["final_ids"]) == (2, consultation.AGREED, ["COM-C0001", "COM-C0002"])
    assert state["consensus_reached"] and state["unresolved_ids"] == [] and after.count() == 2
    final = consultation.assembled(consultation_state(spark, state), after).collect()
    assert [(r["pos"], r["text"]) for r in final] == [(0, "wait-list control group"), (1, "usual care")]


def consultation_state(spark, row):
    return spark.createDataFrame([(1, row["label"], row["final_ids"])], "doc_id long, label string, final_ids array<string>")


def test_consultation_without_agreement(spark):
    a = TEXT.index("wait-list control group")
    registry = bank(spark, [("ComparisonGroup", a, a + 23), ("ComparisonGroup", TEXT.index("usual"), 48)])
    keep, no = {"COM-C0001": "keep", "COM-C0002": "keep"}, {"COM-C0001": "reject", "COM-C0002": "keep"}
    state, _ = replayed(spark, registry, [([keep, keep, no], [], ["COM-C0001"], {})] * 3)
    assert (state["rounds"], state["termination"], state["final_ids"], state["unresolved_ids"]) == (3, consultation.UNRESOLVED, [], ["COM-C0001"])
    best, _ = replayed(spark, registry, [([keep] * 3, [], ["COM-C0001", "COM-C0002"], {"proofs": ["COM-C0001"]}), ([keep, keep, no], [], ["COM-C0002"], {"proofs": []}), ([keep, keep, no], [], ["COM-C0001"], {})])
    assert (best["best_round"], best["final_ids"], best["consensus_reached"]) == (1, ["COM-C0001", "COM-C0002"], False)
    same = request("exact_quote_proposal", proposed_text="usual care", sentence_id="S0001")
    done, _ = replayed(spark, registry, [([keep] * 3, [], ["COM-C0001"], {"requests": [same, same]})])
    assert done["termination"] == consultation.AGREED and done["rounds"] == 1
    lost = request("exact_quote_proposal", proposed_text="no such words")
    blocked, _ = replayed(spark, registry, [([keep] * 3, [lost], ["COM-C0001"], {})], 1)
    assert blocked["termination"] == consultation.UNRESOLVED and blocked["final_ids"] == ["COM-C0001"]


def test_one_more_round_reviews_what_the_last_one_appended(spark):
    a = TEXT.index("wait-list control group")
    registry = bank(spark, [("ComparisonGroup", a, a + 23)])
    keep, both = {"COM-C0001": "keep"}, {"COM-C0001": "keep", "COM-C0002": "keep"}
    quote = request("exact_quote_proposal", proposed_text="usual care", sentence_id="S0001")
    state, _ = replayed(spark, registry, [([keep] * 3, [], ["COM-C0001"], {"requests": [quote]}), ([both] * 3, [], ["COM-C0001", "COM-C0002"], {})], 1)
    assert (state["rounds"], state["termination"], state["final_ids"]) == (2, consultation.AGREED, ["COM-C0001", "COM-C0002"])
    unread, _ = replayed(spark, registry, [([keep] * 3, [], ["COM-C0001"], {"requests": [quote]}), ([both, both, keep], [], ["COM-C0001", "COM-C0002"], {})], 1)
    assert unread["termination"] == consultation.UNRESOLVED and unread["final_ids"] == ["COM-C0001"] and unread["unresolved_ids"] == ["COM-C0002"]


def test_reviews(spark):
    decisions = "array<struct<candidate_id:string,decision:string>>"
    rows = [("a", [("C1", "keep"), ("C2", "reject")], [], []), ("b", [("C1", "keep"), ("C1", "reject")], [], []), ("c", [("X", "keep")], [], []), ("d", [], [], []), ("e", [], [" C1 "], ["C2", "C2"]), ("f", [("C2", "keep")], ["C1"], [])]
    df = spark.createDataFrame([(n, d, k, r, ["C1", "C2"]) for n, d, k, r in rows], f"role string, decisions {decisions}, keep_ids {NONE}, reject_ids {NONE}, assigned_ids {NONE}")
    got = {r["role"]: r for r in votes.normalized_review(df).collect()}
    assert got["a"]["decided"] == {"C1": "keep", "C2": "reject"} and got["a"]["valid"]
    assert got["b"]["overlap_ids"] == ["C1"] and got["c"]["unknown_ids"] == ["X"] and got["d"]["empty_review"]
    assert [got[k]["decided"] for k in "bcd"] == [{}, {}, {}] and got["e"]["decided"] == {"C1": "keep", "C2": "reject"}
    assert got["f"]["decided"] == {"C2": "keep"} and got["f"]["missing_ids"] == ["C1"] and not got["f"]["valid"]
    roles = spark.createDataFrame([("PubMedBERT_Outcome",), ("SciBERT",), ("Other_x",)], "r string")
    assert [r[0] for r in roles.select(votes.expert_of_role(F.col("r"))).collect()] == ["PubMedBERT", "SciBERT", "Other"]
    assert spark.range(1).select(votes.vote_threshold(F.lit("two thirds")), votes.vote_threshold(F.lit(0.5))).first()[:] == (2 / 3, 0.5)


def test_label_consensus(spark):
    by, keys = ["doc_id", "label"], ["doc_id", "label", "candidate_id"]
    sent = spark.createDataFrame([(d, "Outcome", r, d != 2, [], []) for d in (1, 2, 3) for r in L.EXPERTS], f"doc_id long, label string, role string, valid boolean, unknown_ids {NONE}, overlap_ids {NONE}")
    matrix = spark.createDataFrame([(d, "Outcome", "C1", "keep", "keep", "keep") for d in (1, 2, 3)], "doc_id long, label string, candidate_id string, " + ", ".join(f"{r} string" for r in L.EXPERTS))
    open_ = spark.createDataFrame([(3, "Outcome")], "doc_id long, label string")
    got = {r["doc_id"]: (r["review_complete"], r["consensus_reached"]) for r in votes.label_consensus(sent, matrix.select(*keys), matrix, by, keys, open_).collect()}
    assert got == {1: (True, True), 2: (False, False), 3: (True, False)}


def test_meta_decisions(spark):
    text = "Design We used a cluster randomized trial. It ended."
    rows = [(1, "DesignDescription", 0, "DES-C0001", 0, 42, text[:42]), (1, "DesignDescription", 1, "DES-C0002", 7, 42, text[7:42]), (1, "DesignDescription", 2, "DES-C0003", 43, 52, text[43:])]
    chosen = spark.createDataFrame(rows, "doc_id long, label string, pos int, candidate_id string, start int, end int, text string")
    by = ["doc_id", "label"]
    assert [r["candidate_id"] for r in meta.pruned(chosen, by).orderBy("pos").collect()] == ["DES-C0002", "DES-C0003"]
    units = generate.units(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    proofs = [(1, "DesignDescription", 0, "DES-C0002", "S0001", "no such quote"), (1, "DesignDescription", 1, "DES-C0002", "S0001", "cluster"), (1, "DesignDescription", 2, "DES-C0002", "S0001", "used"), (1, "DesignDescription", 3, "DES-C0009", "S0001", "used"), (1, "DesignDescription", 4, "DES-C0003", "S0007", "It")]
    df = spark.createDataFrame([(*p, "fits" * 200, None) for p in proofs], "doc_id long, label string, ord int, candidate_id string, evidence_sentence_id string, evidence_quote string, label_fit_rationale string, boundary_rationale string")
    good = meta.valid_proofs(df, chosen, units, by)
    assert [(r["candidate_id"], r["evidence_quote"], len(r["label_fit_rationale"]), r["boundary_rationale"]) for r in good.collect()] == [("DES-C0002", "cluster", 360, "")]
    assert {r["candidate_id"] for r in meta.missing_proofs(chosen, good, by).collect()} == {"DES-C0001", "DES-C0003"}
    searches = [(1, "Outcome", k, a, "because", ["x" * 100] * 10, o) for k, (a, o) in enumerate([("Outcome", "repair_boundary"), ("Participant", "repair_boundary"), ("Outcome", "dance"), *[("Outcome", "verify_consensus")] * 3])]
    asked = spark.createDataFrame(searches, f"doc_id long, label string, ord int, asked_label string, reason string, search_cues {NONE}, requested_operation string")
    got = meta.source_searches(asked, by).orderBy("ord").collect()
    assert [r["ord"] for r in got] == [0, 3, 4] and len(got[0]["search_cues"]) == 8 and len(got[0]["search_cues"][0]) == 80
    assert meta.source_searches(asked, by, False).count() == 0


def test_relevant_units(spark):
    text = "First one. The scale was used. Third one. A score fell. Fifth."
    df = spark.createDataFrame([(1, text)], "doc_id long, text string").withColumn("units", T.source_units(F.col("text")))
    items = F.array(F.struct(F.lit(31).alias("start"), F.lit(36).alias("end")), F.struct(F.lit(32).alias("start"), F.lit(40).alias("end")))
    names = lambda c: [u["sentence_id"] for u in df.select(c.alias("u")).first()["u"]]
    assert names(meta.relevant_units(F.col("units"), items, F.lit("Outcome"), 12)) == ["S0003", "S0002", "S0004"]
    assert names(meta.relevant_units(F.col("units"), F.slice(items, 1, 0), F.lit("StatisticalAnalysis"), 2)) == ["S0001", "S0002"]


def test_registered(spark):
    text = "In all 212 students took part. Mood was low and of"
    sources = spark.createDataFrame([(1, text)], "doc_id long, text string")
    schema = "doc_id long, ord int, label string, start int, end int, text string, expert string, confidence double, threshold double, section string, origin string"
    raw = [(1, 0, "SampleSize", 7, 19, "212 students", "SciBERT", 0.6, 0.5, "methods", "expert"), (1, 1, "SampleSize", 7, 19, "212 students", "PubMedBERT", 0.9, 0.4, "x", "expert"), (1, 2, "SampleSize", 7, 19, "212 students", "SciBERT", 0.5, 0.3, "x", "expert"), (1, 3, "SampleSize", 7, 19, "212 students", None, None, None, "y", "generated"), (1, 4, "Outcome", 31, 35, "Wood", "SciBERT", 0.5, 0.5, "r", "expert"), (1, 5, "Outcome", 31, 50, "Mood was low and of", "SciBERT", 0.5, 0.5, "r", "expert")]
    out, log = candidates.registered(spark.createDataFrame(raw, schema), sources)
    row = out.first()
    assert out.count() == 1 and (row["candidate_id"], row["proposed_by_experts"], row["section"], row["merged"]) == ("SAM-C0001", ["PubMedBERT", "SciBERT"], "methods", 2)
    assert row["confidence_by_expert"] == {"PubMedBERT": 0.9, "SciBERT": 0.6} and row["threshold_by_expert"] == {"PubMedBERT": 0.4, "SciBERT": 0.3}
    assert [r["decision"] for r in log.orderBy("ord").collect()] == ["accepted", "merged_duplicate", "merged_duplicate", "duplicate_exact_span", "text_offset_mismatch", "incomplete_trailing_word"]
    broad = [(1, 0, "SampleSize", 0, 29, text[:29], "SciBERT", 0.6, 0.5, "m", "expert")]
    fixed, _ = candidates.registered(spark.createDataFrame(broad, schema), sources, normalise=True)
    assert [(r["text"], r["start"], r["normalised"]) for r in fixed.collect()] == [("212 students", 7, True)]


SCHEMA = {
    "type": "object",
    "properties": {
        "decisions": {"type": "array", "items": {"properties": {"candidate_id": {"enum": ["A", "B", "A1"]}, "decision": {"enum": ["keep", "reject"]}, "issue_type": {"enum": ["none", "boundary"]}}}},
        "missing_label": {"type": "boolean"},
    },
}


def test_salvage():
    broken = '{"decisions": [{"candidate_id": "A1", "decision": "keep", "issue_type": "none", "justification": "the "best" one"}, {"candidate_id": "B", "decision": "reject", "issue_type": "odd"}], "missing_label": TRUE'
    got = json_repair.parsed(broken, SCHEMA)
    assert [(d["candidate_id"], d["decision"], d["issue_type"]) for d in got["decisions"]] == [("A1", "keep", "none"), ("B", "reject", "unsupported")]
    assert got["missing_label"] and got["_salvaged_from_malformed_json"]
    cut = json_repair.parsed('{"decisions": [{"candidate_id": "A", "decision": "keep"}, {"candidate_id": "B", "deci', SCHEMA)
    assert [d["candidate_id"] for d in cut["decisions"]] == ["A"]
    fields = {"type": "object", "properties": {"selected": {"type": "array"}, "why": {"type": "string"}, "ok": {"type": "boolean"}, "more": {"type": "object"}, "rest": {"type": "array"}}}
    saved = json_repair.parsed('{"selected": ["A", "B",] "why": "so" "ok": true, "more": {"x": 1}, "rest": ["unfinished', fields)
    assert saved == {"selected": ["A", "B"], "why": "so", "ok": True, "more": {"x": 1}, "rest": [], "_salvaged_from_malformed_json": True}
    assert json_repair.parsed("[1, {}]") is None and json_repair.parsed("[{}]", fields) is None and json_repair.parsed("nothing here", fields) is None
    assert json_repair.parsed('```json\n{"a": 1,}\n```') == {"a": 1}


def test_prompts(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("v")).first()["v"]
    assert 256 <= value(prompts.completion_budget(F.lit("s" * 400), F.lit("u" * 50_000), 4096, 16_384, 256, 256)) < 4096
    with pytest.raises(Exception, match="leaves"):
        value(prompts.completion_budget(F.lit("s"), F.lit("u" * 70_000), 4096, 16_384, 256, 256))
    limits = value(prompts.context_limits(F.lit("This model's Maximum context length is 4096 tokens. However your request has 5000 input tokens.")))
    assert tuple(limits) == (4096, 5000) and value(prompts.context_limits(F.lit("no limits"))) is None
    assert len(value(prompts.snippet(F.lit("x" * 5000)))) == 1400 - 18 + len(prompts.CUT_MARK) and value(prompts.snippet(F.lit("x"))) == "x"
    assert [prompts.by_window(prompts.META_CHARS, w) for w in (4096, 8192, 16_384, 32_768)] == [8000, 8000, 12000, 28000]
    assert [prompts.batch_of(F.lit(k), 2) is not None and value(prompts.batch_of(F.lit(k), 2)) for k in range(5)] == [0, 0, 1, 1, 2]
    candidate = F.struct(F.lit("OUT-C0001").alias("candidate_id"), F.lit("Outcome").alias("label"), F.lit(4).alias("start"), F.lit(8).alias("end"), F.lit("mood").alias("text"), F.array(F.lit("SciBERT")).alias("proposed_by_experts"), F.create_map(F.lit("SciBERT"), F.lit(0.5)).alias("confidence_by_expert"))
    line = value(prompts.candidate_line(candidate, F.lit("The mood fell.")))
    assert line.startswith("OUT-C0001 [Outcome] offsets=4:8 experts=SciBERT confidence={SciBERT: 0.5}") and "<<mood>>" in line
    text, context = prompts.candidate_budgets(F.lit(100), 8000)
    assert (value(text), value(context)) == (70, 50)


def test_guidelines(spark):
    lines = ["Outcome", "What was measured.", "Population: pupils", "Inclusion Criteria and more", "Some school-based intervention here", "What was measured."]
    df = spark.createDataFrame([("/x/guide.docx", k, t) for k, t in enumerate(lines)], "file string, ord int, text string")
    got = {r["label"]: r["text"] for r in guidelines.snippets(df).collect()}
    assert got["Participant"] == "Population: pupils" and got["Intervention"] == "Some school-based intervention here"
    assert got["Outcome"] == "Outcome What was measured. Population: pupils Some school-based intervention here"
    files = guidelines.text_files(spark.createDataFrame([("/x/Outcome.txt", "y" * 3000), ("/x/other.txt", "z")], "file string, text string"))
    base = spark.createDataFrame([("Outcome", "common_errors", ["b"]), ("Outcome", "definition", ["d"]), ("Participant", "definition", ["p"])], f"label string, kind string, texts {NONE}")
    rows = [r["text"] for r in guidelines.retrieved(base, files, "Outcome").orderBy("ord").collect()]
    assert rows[:2] == ["[Outcome] definition: d", "[Outcome] common errors: b"] and rows[2].startswith("[local guideline: Outcome.txt] yyy") and len(rows[2]) < 1500
    assert guidelines.retrieved(base, files, "Nothing").count() == 0


def test_calibration_files(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({x: 0.3 for x in L.LABELS}))
    got = calibration.thresholds(spark, {"SciBERT": str(tmp_path / "t.json"), "PubMedBERT": str(tmp_path / "none.json")}, allow_default=True)
    assert {(r["expert"], r["threshold"]) for r in got.collect()} == {("SciBERT", 0.3), ("PubMedBERT", 0.5)} and got.count() == 14
    with pytest.raises(FileNotFoundError):
        calibration.thresholds(spark, {"PubMedBERT": str(tmp_path / "none.json")})
    (tmp_path / "short.json").write_text('{"Outcome": 0.2}')
    with pytest.raises(Exception, match="no threshold"):
        calibration.thresholds(spark, {"SciBERT": str(tmp_path / "short.json")}).collect()
    rules = {x: {"source_mode": "registry_all"} for x in L.LABELS}
    rules["Outcome"] = {"min_vote_fraction": 0.5, "vote_weights": {"PubMedBERT": 2.0}}
    (tmp_path / "c.json").write_text(json.dumps({"labels": rules}))
    conf = {r["label"]: r for r in calibration.configurations(spark, str(tmp_path / "c.json")).collect()}
    assert conf["Outcome"]["vote_weights"] == [1.0, 2.0, 1.0] and conf["Outcome"]["source_mode"] == "calibrated_rule" and conf["Participant"]["min_expert_support"] == 2
    del rules["Outcome"]
    (tmp_path / "d.json").write_text(json.dumps({"labels": rules}))
    with pytest.raises(Exception, match="no rule"):
        calibration.configurations(spark, str(tmp_path / "d.json")).collect()
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "b.labelcentered.json").write_text('{"record_name": "b"}')
    (tmp_path / "p" / "a.labelcentered.json").write_text('[{"record_name": "x"}, {"record_name": "y"}]')
    names = {r["name"] for r in calibration.payloads(spark, folders=[str(tmp_path / "p")]).collect()}
    assert names == {"b.labelcentered.json", "a.labelcentered.json#0", "a.labelcentered.json#1"}
    with pytest.raises(FileNotFoundError):
        calibration.payloads(spark, folders=[str(tmp_path / "nothing")])
    shown = spark.createDataFrame([("a.labelcentered.json",), ("b.json",)], "n string").select(calibration.calibrated_name(F.col("n"), "my run"))
    assert [r[0] for r in shown.collect()] == ["a.my_run.labelcentered.json", "b.my_run.json"]


def test_sections_and_records(spark, tmp_path):
    text = "Intro\n2. Experimental Design\nWe did.\nMore.\n3. Findings\nIt fell.\n4 Limitations\nFew. Results\nAnalysis\n"
    got = records.heading_sections(spark.createDataFrame([(1, text), (2, "Methods\nopen end")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert (got[0]["methods"], got[0]["results"]) == ("We did.\nMore.\n3. Findings\nIt fell.\n4 Limitations\nFew. Results", "It fell.")
    assert (got[1]["methods"], got[1]["results"]) == ("", "")
    assert spark.range(1).select(records.marked_input(F.lit("m"), F.lit(""))).first()[0] == "=== METHODS ===\nm\n\n"
    assert records.distinct_paths(["/tmp/../tmp/a", "/tmp/a", "/b"]) == ["/tmp/a", "/b"]
    rows = spark.createDataFrame([("f", k) for k in range(5)] + [("g", 0)], "source_file string, record_index int")
    assert records.limited(rows, 2).count() == 3
    totals = records.run_totals(spark.createDataFrame([("processed",), ("failed",), ("processed",)], "status string")).first()
    assert tuple(totals) == (2, 0, 1)
    (tmp_path / "a.json").write_text('[{"id": 1, "source_file": "own.json"}, {"id": 2}]')
    named = records.with_source(records.load_records(spark, str(tmp_path / "a.json"))).orderBy("record_index").collect()
    assert [(r["source_file"], r["source_index"]) for r in named] == [("own.json", 0), ("a.json", 1)]
    records.write_splits(records.load_records(spark, str(tmp_path / "a.json")).withColumn("split", F.lit("dev")), str(tmp_path / "splits"))
    assert spark.read.text(str(tmp_path / "splits" / "split=dev")).count() == 2


def test_alignment(spark):
    gold = spark.createDataFrame([("g.json", 0, ["a", "b"]), ("g.json", 1, ["b"]), ("g.json", 2, ["c"]), ("h.json", 0, ["z"])], f"scope string, place int, keys {NONE}")
    predicted = spark.createDataFrame([(10, "g.json", ["a"]), (11, "g.json", ["b", "c"]), (12, "g.json", ["c"]), (13, "other.json", ["z", "a"])], f"prediction int, source_file string, keys {NONE}")
    got = {(r["scope"], r["place"]): (r["prediction"], r["matches"]) for r in realign.aligned_in_order(gold, predicted).collect()}
    assert got == {("g.json", 0): (None, 2), ("g.json", 1): (11, 1), ("g.json", 2): (12, 1), ("h.json", 0): (13, 1)}
    keys = spark.range(1).select(realign.gold_keys(F.lit("in/a b.pdf"), F.lit("rec0003"), F.lit(3)), realign.prediction_keys(F.lit(3), F.lit("rec0003"), F.lit("pdf"), F.lit("in/a b.pdf")), realign.prediction_keys(F.lit(3), F.lit(None).cast("string"), F.lit("json"), F.lit("a.json"))).first()
    assert keys[0] == ["3", "rec0003", "in_a_b.pdf", "a_b"] and keys[1] == ["3", "rec0003", "in_a_b.pdf", "a_b"] and keys[2] == ["3"]


def test_integrity_of_claims(spark):
    final = spark.createDataFrame([(1, "Outcome", 0, "OUT-C0001"), (1, "Participant", 0, "PAR-C0001")], "doc_id long, label string, pos int, candidate_id string")
    matrix = spark.createDataFrame([(1, "Outcome", "OUT-C0001", "keep", "keep", "missing")], "doc_id long, label string, candidate_id string, " + ", ".join(f"{r} string" for r in L.EXPERTS))
    assert [(r["rule"], r["candidate_id"]) for r in integrity.support_violations(final, matrix).collect()] == [("not_supported_by_all_roles", "OUT-C0001")]
    right = spark.createDataFrame([(1, 0, "PAR-C0001"), (1, 1, "OUT-C0001")], "doc_id long, pos int, candidate_id string")
    assert integrity.order_violations(final, right).count() == 0
    assert integrity.order_violations(final, right.filter("pos = 0")).count() == 1
    labels = spark.createDataFrame([(1, x, x in ("Outcome", "SampleSize")) for x in L.LABELS] + [(2, "Outcome", False)], "doc_id long, label string, consensus boolean")
    documents = spark.createDataFrame([(1, True, ["x"], {"Outcome": ["start"]}), (2, False, [], None)], "doc_id long, overall_consensus boolean, unresolved array<string>, summaries map<string,array<string>>")
    got = sorted((r["rule"], r["doc_id"], r["label"]) for r in integrity.status_violations(labels, final, documents).collect())
    assert got == [("consensus_with_unresolved", 1, None), ("consensus_without_selection", 1, "SampleSize"), ("labels_missing", 2, None), ("summary_holds_spans", 1, None), ("summary_without_provenance", 1, None)]


def test_reports(spark):
    schema = "backend string, label string, precision double, recall double, f1 double, accuracy double"
    metrics = spark.createDataFrame([(b, x, p, p, p, 0.9) for b, p in (("one", 0.5), ("two", 0.25)) for x in [*L.LABELS, "micro", "macro"]], schema)
    facts = spark.createDataFrame([("one", 3), ("two", 4)], "backend string, aligned_record_count int")
    summary = reports.backend_summary(metrics, spark.createDataFrame([("one", 0.8), ("two", 0.7)], "backend string, accuracy double"), facts)
    assert len(summary.columns) == 2 + 9 + 28
    lines = {r["backend"]: r["line"] for r in reports.backend_lines(summary).collect()}
    assert lines["one"] == "one            3        0.5000     0.5000  0.5000  0.8000"
    scores = spark.createDataFrame([("a", 0, "all", 0.5, 0.5, 0.5), ("b", 1, "all", 0.6, 0.5, 0.5), ("c", 2, "all", 0.6, 0.5, 0.5), ("a", 0, "train", 0.9, 0.9, 0.9)], "variant string, place int, part string, precision double, recall double, f1 double")
    assert {r["variant"] for r in reports.variant_report(scores).filter("best").collect()} == {"b"}


def test_modes(spark):
    cands = bank(spark, [("ComparisonGroup", 4, 27), ("ComparisonGroup", 38, 48)])
    cast = spark.createDataFrame([(1, "ComparisonGroup", "COM-C0001", r, "keep") for r in L.EXPERTS], "doc_id long, label string, candidate_id string, role string, decision string")
    rows = select.features(cands, votes.vote_matrix(cands, cast, ["doc_id", "label", "candidate_id"]))
    wanted = spark.createDataFrame([(1, "ComparisonGroup", 0, "COM-C0002"), (1, "ComparisonGroup", 1, "COM-C0007")], "doc_id long, label string, pos int, candidate_id string")
    got = {}
    for r in select.by_mode(rows, select.strict(rows), select.known(wanted, rows)).collect():
        got.setdefault(r["mode"], set()).add(r["candidate_id"])
    assert got["strict"] == {"COM-C0001"} and got["recommended"] == {"COM-C0002"} and got["registry_all"] == {"COM-C0001", "COM-C0002"}
    rules = spark.createDataFrame([("ComparisonGroup", "recommended")], "label string, source_mode string").withColumns({"require_label_filter": F.lit(True), "reject_weak_fragments": F.lit(True), "min_vote_fraction": F.lit(0.67), "min_expert_support": F.lit(2), "min_confidence": F.lit(0.0), "use_high_quality_rescue": F.lit(True), "vote_weights": F.array(F.lit(1.0), F.lit(1.0), F.lit(1.0))})
    assert [r["text"] for r in select.applied(rows, rules, wanted).collect()] == ["usual care"]
