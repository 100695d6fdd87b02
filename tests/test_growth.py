"""JSON repair, ranges of array files, quotes, and the registry that grows with a stream."""

import json
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from quillspan.functions import json_repair as J
from quillspan.functions import labels as L
from quillspan.functions import quotes
from quillspan.operators import candidates
from quillspan.sources import arrays, records
from quillspan.streaming import registry

SCHEMA = {"type": "object", "properties": {"decisions": {"items": {"properties": {"candidate_id": {"enum": ["A-1", "A-10", "B"]}, "decision": {"enum": ["keep", "reject"]}, "issue_type": {"enum": ["ok", "unsupported"]}}}}}}
FIELDS = {"type": "object", "properties": {"ids": {"type": "array"}, "why": {"type": "string"}, "ok": {"type": "boolean"}, "more": {"type": "object"}}}


def value(rng, depth=0):
    kind = rng.randrange(7 if depth < 3 else 4)
    word = "".join(rng.choice('ab"\\{}[],: \né😀') for _ in range(rng.randrange(6)))
    if kind < 4:
        return [word, rng.randrange(100), rng.random() < 0.5, None][kind]
    if kind == 4:
        return {word + str(k): value(rng, depth + 1) for k in range(rng.randrange(4))}
    return [value(rng, depth + 1) for _ in range(rng.randrange(4))]


def idle_commas(rng, v):
    """JSON of a value with idle commas before some closing brackets."""
    comma = rng.choice(["", ",", " , \n"])
    if isinstance(v, dict):
        return "{" + ", ".join(f"{json.dumps(k)}: {idle_commas(rng, x)}" for k, x in v.items()) + (comma if v else "") + "}"
    if isinstance(v, list):
        return "[" + ",".join(idle_commas(rng, x) for x in v) + (comma if v else "") + "]"
    return json.dumps(v, ensure_ascii=rng.random() < 0.5)


def test_objects_are_read_whatever_stands_around_them():
    rng = random.Random(2)
    for _ in range(400):
        v = {"k": value(rng), "x\"y": value(rng)}
        text = idle_commas(rng, v)
        assert J.parsed(text) == v
        assert J.parsed(f"```JSON\n{text}\n```") == v
        assert J.parsed(f"Here it is: {text} and a }} more") == v
        cut = json.dumps(v)[: rng.randrange(len(json.dumps(v)))]
        got, how, at, around = J.read(cut)
        assert got is None and how == "broken" and (0 <= at <= len(cut)) and around in cut


def test_broken_objects_are_saved_field_by_field():
    rng = random.Random(4)
    for _ in range(300):
        whole = {"ids": [str(k) for k in range(rng.randrange(4))], "why": rng.choice(["so {", 'a "b" ] c', "é"]), "ok": rng.random() < 0.5, "more": {"x": [1, {"y": "]}"}]}}
        names = rng.sample(list(whole), 4)
        parts = [f"{json.dumps(n)} : {json.dumps(whole[n])}" for n in names]
        left = rng.randrange(1, 4)
        text = "{" + " ".join(parts[:left]) + f" {json.dumps(names[left])}: " + {"ids": '["1", "unfin', "why": '"unfin', "ok": "tru", "more": '{"x": ['}[names[left]]
        got = J.parsed(text, FIELDS)
        empty = {"ids": [], "why": "", "ok": False, "more": {}}
        assert got == {n: whole[n] if n in names[:left] else empty[n] for n in whole} | {"_salvaged_from_malformed_json": True}


def test_reviews_are_saved_decision_by_decision():
    item = lambda c, d, i: f'{{"candidate_id" : "{c}", "issue_type": "{i}", "justification": "he said "no" to it", "decision":"{d}"}}'
    text = '{"decisions": [' + ", ".join([item("A-10", "keep", "odd"), item("A-1", "reject", "ok"), item("X", "keep", "ok"), item("A-10", "reject", "ok")]) + ', {"candidate_id": "B", "dec'
    got = J.parsed(text + ' "missing_label": TRUE', SCHEMA)
    assert [(d["candidate_id"], d["decision"], d["issue_type"]) for d in got["decisions"]] == [("A-10", "keep", "unsupported"), ("A-1", "reject", "ok"), ("B", "keep", "ok")][:2]
    assert got["missing_label"] is True and got["expansion_requests"] == []
    assert J.parsed('{"decisions": [{"candidate_id": "B"', SCHEMA) is None
    assert J.read("[" * 100_000, SCHEMA)[0] is None and J.read("", SCHEMA)[1] == "broken" and J.read(None)[0] is None
    assert J.decisions('{"decisions": [{"candidate_id": "A", "n": 1, "decision": "keep"}, {"candidate_id": "B"}, {"decision": "keep"', {"A", "B"}) == {"A": "keep"}


def test_repair_column(spark):
    rows = spark.createDataFrame([('{"a": 1}',), ("x {\"a\": [1,]} y",), ("nothing",), (None,), ("[1]",)], "t string")
    got = [r["r"] for r in rows.select(J.repair_column(F.col("t")).alias("r")).collect()]
    assert [(r["object"], r["how"]) for r in got] == [('{"a": 1}', "whole"), ('{"a": [1]}', "tidied"), (None, "broken"), (None, "broken"), (None, "refused")]
    assert got[2]["error_at"] == 0 and got[2]["error"] == "nothing"


@pytest.mark.parametrize("size", [7, 64, 1 << 20])
def test_array_files_by_ranges(spark, tmp_path, monkeypatch, size):
    rng = random.Random(size)
    files = {f"f{k}.json": [value(rng) for _ in range(rng.randrange(1, 25))] for k in range(4)} | {"empty.json": [], "slashes.json": ["\\" * k for k in range(9)]}
    for k, (name, items) in enumerate(files.items()):
        text = json.dumps(items, ensure_ascii=k % 2 == 0, indent=k % 3 or None)
        (tmp_path / name).write_text(" \n" * (k % 2) + text + "\n", encoding="utf-8")
    monkeypatch.setattr(arrays, "BLOCK_BYTES", 50 if size < 1000 else 1 << 20)
    rows = arrays.array_items(spark, str(tmp_path), range_bytes=size).collect()
    for name, items in files.items():
        own = sorted((r["record_index"], r["value"]) for r in rows if r["source_file"].endswith("/" + name))
        assert [k for k, _ in own] == list(range(len(items)))
        assert [json.loads(v) for _, v in own] == items


def test_array_records_equal_whole_files(spark, tmp_path):
    items = [{"id": k, "data": {"method_section": f"text, [{k}] \"x\""}} for k in range(300)]
    (tmp_path / "all.json").write_text(json.dumps(items))
    wanted = records.load_records(spark, str(tmp_path)).select("record_index", F.to_json("record").alias("v"))
    found = arrays.load_array_records(spark, str(tmp_path), range_bytes=777).select("record_index", F.to_json("record").alias("v"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted.collect()))
    (tmp_path / "object.json").write_text('{"records": [1]}')
    with pytest.raises(Exception, match="no JSON array"):
        arrays.array_items(spark, str(tmp_path)).collect()


def test_quotes_in_one_pass():
    rng = random.Random(6)
    for _ in range(200):
        text = "".join(rng.choice("ab \n\t é") for _ in range(rng.randrange(60)))
        wanted = list({"".join(rng.choice("ab \n é") for _ in range(rng.randrange(1, 4))) for _ in range(rng.choice([2, 12]))})
        assert quotes.places(text, wanted) == {q: [k for k in range(len(text)) if text.startswith(q, k)] for q in wanted}
        import re

        for q, found in quotes.flexible_places(text, wanted).items():
            pattern = r"\s+".join(map(re.escape, q.split()))
            assert found == [m.span() for m in re.finditer(pattern, text)]
    assert quotes.nearest([3, 9, 15], 12) == 9 and quotes.nearest([3, 9], None) == 3 and quotes.nearest([], 1) is None and quotes.nearest([(5, 6)], 99) == (5, 6)


def spans_of(n, texts):
    rng, rows = random.Random(1), []
    for k in range(n):
        doc = rng.choice(list(texts))
        start = rng.randrange(0, 60, 6)
        end = start + rng.choice([12, 18])
        expert = rng.choice([*L.EXPERTS, None])
        rows.append((doc, k, rng.choice(L.LABELS[:2]), start, end, texts[doc][start:end], expert, rng.random() if expert else None, 0.5 if expert else None, f"s{k % 3}", "expert" if expert else "generated"))
    return rows


def test_registry_grows_as_the_batch_one(spark, tmp_path):
    texts = {d: " ".join(f"group{d} has patients{k}" for k in range(6)) for d in (1, 2, 3)}
    sources = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    schema = "doc_id long, ord long, label string, start int, end int, text string, expert string, confidence double, threshold double, section string, origin string"
    rows = spans_of(240, texts)
    for k in range(4):
        folder = tmp_path / f"part{k}"
        spark.createDataFrame(rows[k * 60 : k * 60 + 60], schema).coalesce(1).write.parquet(str(folder))
        (tmp_path / "in").mkdir(exist_ok=True)
        part = next(folder.glob("*.parquet"))
        target = tmp_path / "in" / f"{k}.parquet"
        os.rename(part, target)
        os.utime(target, (1_700_000_000 + 10 * k, 1_700_000_000 + 10 * k))
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        query = registry.grow(raw, sources, str(tmp_path / "out"), str(tmp_path / "check"))
        query.awaitTermination(120)
    versions = spark.read.parquet(str(tmp_path / "out"))
    assert versions.agg(F.max("version")).first()[0] > 1
    found = registry.latest(versions)
    wanted, _ = candidates.registered(spark.createDataFrame(rows, schema), sources)
    as_rows = lambda df: sorted(str([r[c] if not isinstance(r[c], dict) else sorted(r[c].items()) for c in sorted(df.columns)]) for r in df.collect())
    assert as_rows(found.select(*wanted.columns)) == as_rows(wanted)
