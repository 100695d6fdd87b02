"""Sweeps, matches and range joins against comparisons of each with each, and at sizes where those would not end."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.functions import intervals, labels as L
from quillspan.functions import text as T
from quillspan.operators import evaluate, generate, ranges, select


def spans_of(rng, n, span=60, longest=15):
    return [(s := rng.randrange(span), s + rng.randrange(0, longest)) for _ in range(n)]


def greedy(gold, predicted, threshold):
    pairs = []
    for i, (a, b) in enumerate(gold):
        for j, (c, d) in enumerate(predicted):
            shared, hull = min(b, d) - max(a, c), max(b, d) - min(a, c)
            if shared > 0 and shared / hull >= threshold:
                pairs.append((shared / hull, i, j))
    used_i, used_j, out = set(), set(), []
    for score, i, j in sorted(pairs, reverse=True):
        if i not in used_i and j not in used_j:
            used_i.add(i), used_j.add(j), out.append((i, j, score))
    return out


@pytest.mark.parametrize("threshold", [0.01, 0.5, 0.75])
def test_greedy_matches_equal_brute_force(threshold):
    rng = random.Random(int(threshold * 100))
    groups = [(spans_of(rng, rng.randrange(12)), spans_of(rng, rng.randrange(12), longest=rng.choice([3, 30]))) for _ in range(300)]
    groups[5] = ([(3, 9)] * 7 + [(3, 8)] * 2, [(3, 9)] * 4 + [(2, 9)] * 3 + [(3, 10)])
    flat = []
    for side in (0, 1):
        rows = [(g, s, e) for g, both in enumerate(groups) for s, e in both[side]]
        flat.append(tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)))
    base = [np.cumsum([0] + [len(both[side]) for both in groups]) for side in (0, 1)]
    i, j, score = intervals.greedy_matches(*flat, len(groups), threshold)
    found = [[] for _ in groups]
    for x, y, s in zip(i, j, score, strict=True):
        g = int(flat[0][0][x])
        found[g].append((x - base[0][g], y - base[1][g], s))
    assert found == [greedy(*both, threshold) for both in groups]
    with pytest.raises(ValueError):
        intervals.greedy_matches(*flat, len(groups), 0)


def test_overlapping_gives_every_pair_in_blocks(monkeypatch):
    rng = random.Random(3)
    a, b = spans_of(rng, 80), sorted(spans_of(rng, 90))
    wanted = {(x, y) for x, (s, e) in enumerate(a) for y, (t, u) in enumerate(b) if s < u and t < e and s < e and t < u}
    for limit in (1, 7, 1 << 20):
        monkeypatch.setattr(intervals, "PAIRS_AT_ONCE", limit)
        found = []
        columns = [np.array(c) for c in (*zip(*a, strict=True), *zip(*b, strict=True))]
        for x, y in intervals.overlapping(*columns):
            found += zip(x.tolist(), y.tolist(), strict=True)
        assert len(found) == len(set(found))
        real = {(x, y) for x, y in found if a[x][0] < b[y][1] and b[y][0] < a[x][1] and a[x][0] < a[x][1] and b[y][0] < b[y][1]}
        assert real == wanted


def test_many_spans_of_one_document_are_matched_in_time():
    n = 50_000
    start = np.arange(n, dtype=np.int64) * 10
    zero = np.zeros(n, np.int64)
    began = time.time()
    i, j, _ = intervals.greedy_matches((zero, start, start + 8), (zero, start + 1, start + 8), 1, 0.5)
    assert sorted(zip(i, j, strict=True)) == [(k, k) for k in range(n)]
    i, j, _ = intervals.greedy_matches((zero, zero + 5, zero + 9), (zero, zero + 5, zero + 9), 1, 0.5)
    assert sorted(i) == sorted(j) == list(range(n))
    assert time.time() - began < 10


def test_token_flags_equal_brute_force_and_scale(spark):
    rng = random.Random(7)
    tokens, both = [], []
    for doc in range(40):
        at, own = 0, []
        for _ in range(rng.randrange(30)):
            at += rng.randrange(3)
            own.append((at, at + rng.randrange(1, 5)))
            at = own[-1][1]
        tokens.append((doc, own))
        both += [(doc, rng.choice([*L.LABELS, "Foreign"]), s, e, rng.choice("gp")) for s, e in spans_of(rng, rng.randrange(9))]
    n = 100_000
    tokens.append((99, [(3 * k, 3 * k + 2) for k in range(n)]))
    both += [(99, L.LABELS[k % 3], 30 * k, 30 * k + 5, "gp"[k % 2]) for k in range(10_000)]
    table = spark.createDataFrame(tokens, "doc_id int, tokens array<struct<start:int,end:int>>")
    sides = spark.createDataFrame(both, "doc_id int, label string, start int, end int, side string")
    began = time.time()
    found = {(r["doc_id"], r["ord"]): (r["g"], r["p"]) for r in evaluate.flagged_of(table, sides).collect()}
    assert time.time() - began < 30
    for doc, own in tokens[:-1]:
        for k, (s, e) in enumerate(own):
            bits = [0, 0]
            for d, label, a, b, side in both:
                if d == doc and a < b and a < e and s < b and label in L.LABELS:
                    bits["gp".index(side)] |= 1 << L.LABELS.index(label)
            assert found[doc, k] == tuple(bits)
    assert sum(g > 0 for (d, _), (g, _) in found.items() if d == 99) == 10_000 and len(found) == n + sum(len(t) for _, t in tokens[:-1])


def test_character_confusion_equals_counting(spark):
    rng = random.Random(11)
    docs = [(d, rng.randrange(0, 40)) for d in range(30)]
    both = [(d, rng.choice(L.LABELS[:3]), s - 3, e, rng.choice("gp")) for d, _ in docs for s, e in spans_of(rng, rng.randrange(6), 45)]
    table = spark.createDataFrame(both, "doc_id int, label string, start int, end int, side string")
    out = evaluate.character_confusion(spark.createDataFrame(docs, "doc_id int, length int"), *(table.filter(F.col("side") == s) for s in "gp"))
    wanted = {}
    for d, n in docs:
        for c in range(n):
            at = [min((L.LABELS.index(x[1]) for x in both if x[0] == d and x[4] == s and x[2] <= c < x[3]), default=None) for s in "gp"]
            cell = tuple("NONE" if k is None else L.LABELS[k] for k in at)
            wanted[cell] = wanted.get(cell, 0) + 1
    assert {(r["gold_label"], r["predicted_label"]): r["n"] for r in out.collect() if r["n"]} == wanted


def test_overlap_join_equals_comparing_all(spark):
    rng = random.Random(5)
    rows = [(d, s, e, f"{d}-{k}") for d in range(12) for k, (s, e) in enumerate(spans_of(rng, 25, 300, 90) + [(0, 5000), (10, 140), (130, 9_000_000_000), (7, 7), (-40, -3)])]
    rows += [(None, 1, 5, "none")] * 2
    table = spark.createDataFrame(rows, "doc_id int, start long, end long, name string").repartition(5)
    found = [(r["doc_id"], r["a"]["name"], r["b"]["name"]) for r in ranges.overlap_join(table, table).collect()]
    wanted = [(a[0], a[3], b[3]) for a in rows for b in rows if a[0] is not None and a[0] == b[0] and a[1] < b[2] and b[1] < a[2] and a[1] < a[2] and b[1] < b[2]]
    assert sorted(found) == sorted(wanted)


def test_a_document_of_many_spans_has_its_conflicts(spark):
    n = 50_000
    k = F.col("id")
    rows = spark.range(n).select(F.lit(1).alias("doc_id"), F.when(k % 2 == 0, L.LABELS[0]).otherwise(L.LABELS[1]).alias("label"), F.concat(F.lit("c"), k).alias("candidate_id"), (F.floor(k / 2) * 20).cast("int").alias("start"), (F.floor(k / 2) * 20 + 15 + k % 2).cast("int").alias("end"), F.lit("x").alias("text"))
    rows = rows.unionByName(spark.createDataFrame([(1, L.LABELS[2], "long", 0, n * 10, "y")], rows.schema))
    began = time.time()
    found = select.cross_label_conflicts(rows).groupBy("type", "left_label", "right_label").count().collect()
    assert time.time() - began < 60
    assert sorted((r["left_label"], r["right_label"], r["count"]) for r in found) == sorted([(L.LABELS[0], L.LABELS[1], n // 2), (L.LABELS[0], L.LABELS[2], n // 2), (L.LABELS[1], L.LABELS[2], n // 2)])


def test_contained_spans_go_by_the_rules():
    rng = random.Random(9)
    for label in L.LABELS:
        for _ in range(60):
            spans = spans_of(rng, rng.randrange(14), 20, 12)
            starts, ends = [s for s, _ in spans], [e for _, e in spans]
            issue, single = [rng.random() < 0.3 for _ in spans], [rng.random() < 0.4 for _ in spans]
            size = [e - s for s, e in spans]
            gone = set()
            for a, x in enumerate(spans):
                for b, y in enumerate(spans):
                    if x != y and x[0] <= y[0] and y[1] <= x[1] and a not in gone and b not in gone:
                        gone.add(b if select._stays(label, a, b, issue, size, single) else a)
            assert select._uncontained(label, starts, ends, issue, size, single) == [k for k in range(len(spans)) if k not in gone]
    began, n = time.time(), 4000
    kept = select._uncontained("Outcome", list(range(n)), [2 * n - k for k in range(n)], [False] * n, [2 * (n - k) for k in range(n)], [False] * n)
    assert kept == [n - 1]
    n = 50_000
    kept = select._uncontained("SampleSize", [5 * (k // 2) for k in range(n)], [5 * (k // 2) + 40 + k % 2 for k in range(n)], [False] * n, [40 + k % 2 for k in range(n)], [False] * n)
    assert kept == list(range(1, n, 2))
    assert time.time() - began < 20


def test_long_chains_are_one_token(spark):
    texts = ["a-" * 60_000 + "a", "x'" * 30_000, "word " * 20_000, "é-ß'" * 5000 + "_1"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found = generate.tokens(docs).groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.col("end") - F.col("start")).alias("most"))
    assert sorted(map(tuple, found.collect())) == [(0, 1, 120_001), (1, 2, 59_999), (2, 20_000, 4), (3, 1, 20_002)]
    counts = docs.select("doc_id", T.token_count(F.col("text")).alias("n"))
    assert sorted(map(tuple, counts.collect())) == [(0, 1), (1, 2), (2, 20_000), (3, 1)]
