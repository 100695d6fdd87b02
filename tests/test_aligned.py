"""Gold and predictions that share keys: the same counts as by pairs, and no pairs for gold of one key."""

from quillspan.operators import realign


def test_counts_are_those_of_pairs_and_one_key_makes_none(spark):
    gold = [(k, [f"k{k % 3}"]) for k in range(30)] + [(40, ["k0", "k1"]), (41, []), (42, ["none"]), (43, ["k9"]), (44, ["k9", "k9"]), (45, ["k9", "none"]), (46, None), (47, ["k0", None])]
    predicted = [(p, [f"k{p % 3}", f"k{(p + p // 10) % 3}"]) for p in range(60)] + [(70, ["k9", None])]
    want = {}
    for g, ks in gold:
        hit = {p for p, own in predicted if {k for k in ks or [] if k} & {k for k in own if k}}
        want[g] = (min(hit) if len(hit) == 1 else None, len(hit))
    a, b = spark.createDataFrame(gold, "g long, keys array<string>"), spark.createDataFrame(predicted, "p long, keys array<string>")
    got = realign.aligned(a, b, "g", "p")
    assert {r.g: (r.p, r.matches) for r in got.collect()} == want and got.columns == ["g", "p", "matches"]
    plan = realign.aligned(a.filter("size(keys) = 1"), b, "g", "p")
    assert plan.filter("g < 30").count() == 30


def test_a_key_that_many_share_is_quick(spark):
    same = spark.range(60_000).selectExpr("id", "array('same') AS keys")
    out = realign.aligned(same.withColumnRenamed("id", "g"), same.withColumnRenamed("id", "p"), "g", "p")
    assert [tuple(r) for r in out.groupBy("p", "matches").count().collect()] == [(None, 60_000, 60_000)]
