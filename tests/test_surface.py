"""SQL functions, sinks, guideline files and the file stream."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quillspan.functions import prompts, sql
from quillspan.operators import calibrate, candidates, generate
from quillspan.sources import calibration, records
from quillspan.streaming import ingest


def test_sql_functions(spark):
    assert "span_iou" in sql.register(spark)
    row = spark.sql("SELECT span_iou(0, 10, 5, 15) AS i, span_overlap(0, 3, 5, 9) AS o, spans_overlap(0, 3, 2, 9) AS y, safe_ratio(1, 0) AS r, f_score(1, 1, 0) AS f, clean_text(' a \\n b ') AS c, rough_tokens('abcdefgh') AS n").first()
    assert (round(row["i"], 6), row["o"], row["y"], row["r"], round(row["f"], 6), row["c"], row["n"]) == (0.333333, 0, True, 0.0, 0.666667, "a b", 2)
    text = "Well-being rose (n=12). It's fine!\n\nEnd"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    docs.createOrReplaceTempView("texts")
    tokens = [tuple(r) for r in spark.sql("SELECT t.start, t.end, t.text FROM texts, LATERAL span_tokens(text) t ORDER BY t.ord").collect()]
    assert tokens == [tuple(r) for r in generate.tokens(docs).orderBy("ord").select("start", "end", "text").collect()]
    units = [tuple(r) for r in spark.sql("SELECT u.* FROM texts, LATERAL source_units(text) u ORDER BY u.start").collect()]
    assert units == [tuple(r) for r in generate.units(docs).orderBy("ord").select("sentence_id", "start", "end", "text").collect()]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "Outcome", "OUT-C0001", 0, 3, "abc"), (1, "Outcome", "OUT-C0002", 4, 5, "d")], "doc_id long, label string, candidate_id string, start int, end int, text string")
    made = json.loads(records.documents_json(rows).first()["final_spans_by_label"])
    assert [s["candidate_id"] for s in made["Outcome"]] == ["OUT-C0001", "OUT-C0002"]
    left = records.not_done(spark.createDataFrame([(1,), (2,)], "doc_id long"), rows, "doc_id")
    assert [r["doc_id"] for r in left.collect()] == [2]
    records.write_csv(spark.createDataFrame([("x", None)], "b string, a string"), str(tmp_path / "csv"), ["a", "b"])
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()] == [(None, "x")]
    assert calibration.write_report(rows, str(tmp_path / "report")) == 2 and spark.read.json(str(tmp_path / "report")).count() == 2
    with pytest.raises(ValueError):
        calibration.write_report(rows.limit(0), str(tmp_path / "nothing"))
    copies = spark.createDataFrame([("a.json", "{}", None), ("b.json", None, "broken")], "name string, value string, error string")
    assert calibration.write_copies(copies, str(tmp_path / "copies")) == (1, 1)
    assert spark.read.text(str(tmp_path / "copies" / "name=a.json")).count() == 1
    calibration.write_examples(rows, str(tmp_path / "examples"))
    assert calibration.examples(spark, str(tmp_path / "examples")).count() == 2


def test_docx(spark, tmp_path):
    space = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>" for t in ("Outcome", "  what   was measured ", ""))
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{space}"><w:body>{body}</w:body></w:document>')
    (tmp_path / "g.docx").write_bytes(held.getvalue())
    got = records.extracted_text(spark, str(tmp_path), records.docx_text, "*.docx").first()
    assert got["text"] == "Outcome\nwhat was measured"


def test_file_stream(spark, tmp_path):
    """Each file is read once: a second run appends the units of the new file only."""
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"doc_id": 1, "text": "One. Two."}\n{"doc_id": 2, "text": ""}\n')
    for name in (None, "b.json"):
        if name:
            (tmp_path / "in" / name).write_text('{"doc_id": 3, "text": "Three!"}\n')
        ingest.ingest(ingest.record_stream(spark, folder), out, checkpoint).awaitTermination(60)
    got = sorted((r["doc_id"], r["sentence_id"], r["text"]) for r in spark.read.parquet(out).collect())
    assert got == [(1, "S0001", "One."), (1, "S0002", "Two."), (3, "S0001", "Three!")]


def test_payloads_are_flattened(spark, tmp_path):
    (tmp_path / "a.labelcentered.json").write_text(json.dumps({
        "label_candidate_registries": {"Outcome": [{"candidate_id": "OUT-C0001", "label": "Outcome", "start": 0, "end": 4, "text": "mood", "proposed_by_experts": ["SciBERT"], "confidence_by_expert": {"SciBERT": 0.5}}], "Other": [{"candidate_id": "X"}]},
        "candidate_vote_matrices_by_label": {"Outcome": {"OUT-C0001": {"SciBERT_Outcome": "keep"}}},
        "recommended_candidate_ids_by_label": {"Outcome": ["OUT-C0001", "OUT-C0009"]},
    }))
    held = calibration.payloads(spark, folders=[str(tmp_path)])
    assert [(r["label"], r["pos"], r["candidate_id"], r["text"], r["confidence_by_expert"]) for r in calibration.payload_spans(held, "label_candidate_registries").collect()] == [("Outcome", 0, "OUT-C0001", "mood", {"SciBERT": 0.5})]
    ids = calibration.payload_ids(held)
    assert [r["candidate_id"] for r in ids.orderBy("pos").collect()] == ["OUT-C0001", "OUT-C0009"]
    assert [tuple(r)[2:] for r in calibration.payload_votes(held).collect()] == [("Outcome", "OUT-C0001", "SciBERT_Outcome", "keep")]
    registry = calibration.payload_spans(held, "label_candidate_registries").withColumn("doc_id", F.col("place"))
    wanted = ids.withColumn("doc_id", F.col("place")).select("doc_id", "label", "pos", "candidate_id")
    assert candidates.spans_of(wanted, registry, strict=False).count() == 1
    with pytest.raises(Exception, match="no such candidate"):
        candidates.spans_of(wanted, registry).collect()


def test_splits_are_fixed_by_seed_and_key(spark):
    rows = spark.range(50).withColumnRenamed("id", "doc_id")
    one = {r["doc_id"]: r["split"] for r in calibrate.split(rows, "doc_id", [("dev", 10), ("check", 5)]).collect()}
    two = {r["doc_id"]: r["split"] for r in calibrate.split(rows.repartition(7), "doc_id", [("dev", 10), ("check", 5)]).collect()}
    assert one == two and sorted(one.values()) == ["check"] * 5 + ["dev"] * 10 + ["test"] * 35
    assert one != {r["doc_id"]: r["split"] for r in calibrate.split(rows, "doc_id", [("dev", 10), ("check", 5)], seed=14).collect()}


def test_prompt_texts(spark):
    lit = lambda t: F.lit(t)
    system, user = prompts.review_prompt(prompts.doctor_role(lit("SciBERT"), lit("Outcome")), lit("Outcome"), lit("g"), lit("c"), lit("u"))
    meta, asked = prompts.meta_prompt(prompts.meta_role(lit("Outcome")), lit("Outcome"), lit("g"), lit("c"), lit("u"), lit("v"), lit(4), False)
    row = spark.range(1).select(system.alias("s"), user.alias("u"), meta.alias("m"), asked.alias("a")).first()
    assert "SciBERT_Outcome_DoctorAgent" in row["s"] and "CANDIDATES:\nc" in row["u"] and "Outcome_MetaAgent" in row["m"]
    assert row["a"].endswith("return no expansion requests.") and "ROUND: 4" in row["a"]
