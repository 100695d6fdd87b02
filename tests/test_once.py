"""Steps that all queries over candidates share: plain texts searched by RE2, spans listed with their experts, distinct texts judged once."""

import random

from pyspark.sql import functions as F

from quillspan.functions import labels as L
from quillspan.functions import rules as R
from quillspan.functions import text as T
from quillspan.operators import candidates, generate, select
from quillspan.operators.distinct import once

WORDS = ["the", "Students", "self-esteem", "program", "training", "12", "n = 40,", "B&C", "scale.", "participants", "aged 9 to 14", "\n", "\t", "(", "Index)", "coping", "skills; ", "usual  care n=3", "STRESS score"]


def plain(rng):
    return ["".join(rng.choice(WORDS) + rng.choice([" ", " ", "  ", "", "-"]) for _ in range(rng.randrange(60))) for _ in range(500)]


def test_plain_texts_give_what_java_finds(spark):
    df = spark.createDataFrame(list(enumerate(plain(random.Random(8)) + ["a\x0bprogram", None, "café students"])), "doc_id long, text string")
    got = {tuple(r) for r in generate.pattern_spans(df).collect()}
    want = set()
    for label, found in L.patterns().items():
        for name, p in found:
            spans = F.filter(F.transform(T.matches(F.col("text"), p), T.trim_span), lambda s: s["end"] > s["start"])
            want |= {tuple(r) for r in df.select("doc_id", F.explode(spans).alias("s")).select("doc_id", F.lit(label), "s.*", F.lit(name)).collect()}
    assert got == want and len(want) > 1000
    assert df.filter(~F.col("text").rlike(T.NOT_PLAIN)).count() == 500


def test_once_gives_each_row_its_columns(spark):
    rows = [(k, None if k % 7 == 0 else f"t{k % 5}", k % 3 == 0 if k % 4 else None, {"a": float(k)}, [str(k)]) for k in range(300)]
    df = spark.createDataFrame(rows, "id long, text string, flag boolean, m map<string,double>, l array<string>")
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def judged(text, flag):
        seen.add(1)
        return f"{text}/{flag}"

    want = {(r[0], r[1], r[2], r[3]["a"], r[4][0], f"{r[1]}/{r[2]}") for r in rows}
    out = once(df.coalesce(1), ["text", "flag"], {"j": judged("text", "flag")})
    assert {(r.id, r.text, r.flag, r.m["a"], r.l[0], r.j) for r in out.collect()} == want
    assert 0 < seen.value <= 18
    assert once(df.filter("id < 0"), ["text"], {"j": F.col("text")}).count() == 0


def test_described_is_what_the_rules_say_of_each_row(spark):
    found = generate.deduplicated(generate.pattern_spans(spark.createDataFrame(list(enumerate(plain(random.Random(9))[:120])), "doc_id long, text string")))
    experts = F.when(F.col("start") % 4 == 0, F.array()).when(F.col("start") % 4 == 1, F.array(F.lit("PubMedBERT"))).when(F.col("start") % 4 == 2, F.array(F.lit("SciBERT"), F.lit("ClinicalBERT")))
    vote = lambda k: F.element_at(F.array(F.lit("keep"), F.lit("reject"), F.lit("missing")), (F.col("end") + k) % 3 + 1)
    rows = found.withColumns({"proposed_by_experts": experts.cast("array<string>"), "confidence_by_expert": F.create_map().cast("map<string,double>"), **{e: vote(k * (1 + k)) for k, e in enumerate(L.EXPERTS)}}).cache()
    label, text, by = F.col("label"), F.col("text"), F.col("proposed_by_experts")
    keeps = sum((F.col(e) == "keep").cast("int") for e in L.EXPERTS)
    direct = rows.select("doc_id", "label", "start", "end", R.passes_filter(label, text), R.weak_fragment(label, text, by), R.rescue(label, text, by, keeps), R.quality(label, text), R.boundary_score(label, text, F.col("start"), by), R.boundary_issue(label, text), T.normalized(text))
    got = select.described(rows).select("doc_id", "label", "start", "end", "fits", "weak", "rescued", "quality", "boundary", "issue", "plain")
    assert {str(tuple(r)) for r in got.collect()} == {str(tuple(r)) for r in direct.collect()} and direct.count() > 200


def test_listed_is_the_registry_of_exploded_proposals(spark):
    rows = [(d, label, s, s + 2, "t", "pattern", s % 2, [(e, (s * 7 % 5) / 10) for k, e in enumerate(L.EXPERTS) if (s + k) % 3]) for d in (1, 2) for label in ("Outcome", "SampleSize") for s in range(9)] + [(3, "Outcome", 0, 1, "x", "pattern", 0, [])]
    df = spark.createDataFrame(rows, "doc_id long, label string, start int, end int, text string, origin string, origin_ord int, pairs array<struct<expert:string,confidence:double>>")
    raw = df.select("*", F.explode_outer("pairs").alias("p")).select("doc_id", "label", "start", "end", "text", "origin", "origin_ord", "p.expert", "p.confidence")
    assert {str(r) for r in candidates.listed(df).collect()} == {str(r) for r in candidates.registry(raw).collect()}


def test_few_spans_are_pruned_as_many_are():
    rng = random.Random(3)
    for _ in range(400):
        n = rng.randrange(2, 12)
        starts = [rng.randrange(12) for _ in range(n)]
        ends = [s + rng.randrange(1, 8) for s in starts]
        flags = [[rng.random() < 0.5 for _ in range(n)] for _ in range(2)]
        size = [rng.randrange(9) for _ in range(n)]
        far = [1000 + 10 * k for k in range(17)]  # spans that meet none, so that the long way is taken
        for label in ("SampleSize", "ComparisonGroup", "Outcome"):
            short = select._uncontained(label, starts, ends, flags[0], size, flags[1])
            long = select._uncontained(label, starts + far, ends + [x + 1 for x in far], flags[0] + [False] * 17, size + [1] * 17, flags[1] + [False] * 17)
            assert short == [k for k in long if k < n]
