"""Operators against brute force and the libraries, with nulls, empty and long texts, ties, repeats and odd columns."""

import collections
import hashlib
import math
import random
import re
import textwrap
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")

from quillspan.llm import bpe, counting, durable, encoding, graph, jaccard, language, licences, naming, packing, scan, substrings, toxicity, vectors  # noqa: E402

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, row long, key long"


def sample_texts(seed=3, n=120):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abdeginorst") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    shared = " ".join(rng.choice(vocabulary) for _ in range(60))
    texts = []
    for k in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 120))]
        if k % 5 == 0:
            words[len(words) // 2 : 0] = shared.split()
        texts.append(" ".join(words))
        if k % 7 == 0 and words:
            words[0] = "changed"
            texts.append(" ".join(words))
        if k % 11 == 0:
            texts.append(texts[-1].upper())
    return [*texts, "", None, "Ä É ß 你好 😀", "one two", "a" * 5000, "ab " * 3000, shared, "x<|endoftext|>y"]


@pytest.fixture(scope="module")
def rows():
    return [(3 * k + 1, t) for k, t in enumerate(sample_texts())]


@pytest.fixture(scope="module")
def docs(spark, rows):
    full = [(i, t, "en", "s", 0, 0.5, True, 7, 9) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def vocabulary(name):
    return public_tokenizers.path(name)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_library(name):
    rng = random.Random(5)
    letters = "ab'sStTrRvVeElLmMdD 1 \n\t  é́Σ<|endoftext|>你!?."
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(800)] + [t or "" for t in sample_texts()]
    library = tokenizers.Tokenizer.from_file(vocabulary(name))
    wanted = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for library_merging in (False, True):
        with open(vocabulary(name), "rb") as f:
            encoder = bpe.Encoder(f.read(), library_merging)
        ids, at = encoder.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == wanted
    n, shown, decoded = encoder.shown(pa.array(texts))
    assert n == [len(w) for w in wanted]
    assert [s.decode() for s in shown] == [" ".join(map(str, w)) for w in wanted]
    assert [d.decode() for d in decoded] == [library.decode(w, skip_special_tokens=False) for w in wanted]
    assert [encoder.vocabulary.decoded(w) for w in wanted[:50]] == [library.decode(w, skip_special_tokens=False) for w in wanted[:50]]


def test_encode_decode_operators(spark, docs, rows, empty):
    path = vocabulary("byte_bpe_50k.json")
    made = {r["doc_id"]: r["decoded"] for r in encoding.decode(encoding.encode(docs, path), path).collect()}
    assert made == {i: t or "" for i, t in rows}
    assert encoding.encode_decode(empty, path).count() == 0


def test_token_counts_and_truncation(spark, docs, rows, empty):
    path = vocabulary("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in counting.token_counts(docs, path, 100).collect()}
    for i, t in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert got[i] == (len((t or "").encode()), n, n > 100)
    assert counting.token_counts(empty, path).count() == 0
    with open(path, "rb") as f:
        encoder = bpe.Encoder(f.read())
    text = "the quick brown foxes jumped over lazy dogs"
    table = encoder.prefix_counts(text)
    for end in (3, 9, 15, 21, len(text)):
        assert table[end] == len(library.encode(text[:end], add_special_tokens=False).ids)
    for text in ("a\n\nb  c \n d", "I'll say we've 'tis they're it's 'r", "x!<|endoftext|>y z", "\u00e4\u00f6 \u4f60\u597d  \U0001f600!\t\tend", "", "  ", "12 345!?  "):
        table = encoder.prefix_counts(text)
        borders = [len(text[:k].encode()) for k in range(len(text) + 1)]
        assert [int(table[b]) for b in borders] == [len(library.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
        assert all(table[k] == -1 for k in range(len(table)) if k not in borders)
    text = "the quick brown foxes jumped over lazy dogs"
    broken = counting.truncation(spark.createDataFrame([(1, "a\n\nb"), (1, "a\n\nb")], "doc_id long, text string"), path, 2).collect()
    assert [(r["n_bytes_kept"], r["n_tokens_kept"]) for r in broken] == [(3, 2), (3, 2)]
    kept = counting.truncation(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"), path, 4).orderBy("doc_id").collect()
    assert kept[0]["n_tokens_kept"] <= 4 and kept[1]["n_bytes_kept"] == 0


def test_packing(docs, rows, empty):
    path = vocabulary("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    capacity = 256
    got = packing.pack(docs, path, capacity=capacity, slack=4, fan_in=2).collect()
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t in rows}
    places = collections.defaultdict(list)
    per_doc = collections.defaultdict(list)
    for r in got:
        piece = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(piece, "<u4").tobytes()) and r["length"] <= capacity
        places[r["sequence_id"]].append((r["offset"], r["length"]))
        per_doc[r["doc_id"]].append((r["piece"], r["start"], r["length"]))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    for i, all_ids in ids.items():
        at = 0
        for number, (piece, start, length) in enumerate(sorted(per_doc[i])):
            assert (piece, start) == (number, at)
            at += length
        assert at == len(all_ids)
        assert len(per_doc[i]) == -(-len(all_ids) // capacity)
    total = sum(map(len, ids.values()))
    assert len(places) <= 1.1 * total / capacity + 2
    assert packing.pack(empty, path).count() == 0
    assert packing.best_fit(np.array([5, 5, 3, 2, 4]), 8) == [[0, 3], [1, 2], [4]]


def test_exact_groups(spark, docs, rows, empty):
    text = {i: (t or "").translate(LOWER) for i, t in rows}
    groups = collections.defaultdict(list)
    for i, t in text.items():
        groups[t].append(i)
    for size in (16, 4096):
        got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in naming.exact_groups(docs, size).collect()}
        assert got == {i: (max(groups[t]), len(groups[t]), i == max(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in text.items()}
    assert naming.exact_groups(empty).count() == 0
    twice = spark.createDataFrame([(1, "a"), (1, "a"), (None, "A"), (2, None), (3, "")], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["group_size"], r["kept"]) for r in naming.exact_groups(twice).collect())
    assert got == [("1", 3, False), ("1", 3, True), ("2", 2, False), ("3", 2, True), ("None", 3, False)]
    kept = naming.without_copies(twice).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == [(1, "a"), (3, "")]


def brute_components(sets, percent):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_jaccard(spark, docs, rows, empty):
    sets = {}
    for i, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").translate(LOWER)) if x]
        sets[i] = {tuple(w[j : j + 4]) for j in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()
    wanted = brute_components(sets, 85)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar_groups(docs, 4, 85).collect()}
    assert got == {i: (len(sets[i]), wanted[i]) for i in sets}
    assert jaccard.similar_groups(empty).count() == 0
    kept = jaccard.one_of_each(docs, 4, 85)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(wanted.values()))


def test_forest_equals_brute_force():
    rng = np.random.default_rng(1)
    base = [np.unique(rng.integers(0, 400, 60).astype(np.uint64)) for _ in range(12)]
    sets = [np.unique(np.concatenate((b[rng.random(len(b)) > 0.05], rng.integers(0, 400, 2).astype(np.uint64)))) for b in base for _ in range(6)]
    wanted = brute_components({k: set(s.tolist()) for k, s in enumerate(sets)}, 80)
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    half = len(sets) // 2
    whole = jaccard.forest(sets, 80)
    parts = jaccard.forest(sets[:half], 80) + [(a + half, b + half) for a, b in jaccard.forest(sets[half:], 80)] + jaccard.forest(sets, 80, half)
    for links in (whole, parts):
        root = list(range(len(sets)))
        for a, b in links:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
        assert {k: find(k) for k in range(len(sets))} == wanted


def test_frequent_words_need_no_links(spark):
    common = spark.createDataFrame([(k, "the same short text here " + " ".join(f"w{k}_{j}" for j in range(30))) for k in range(300)], "doc_id long, text string")
    got = jaccard.similar_groups(common).collect()
    assert len(got) == 300 and all(r["component_id"] == r["doc_id"] for r in got)


def test_components(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 205), (205, 203)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(links, "src long, dst long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 200: 200, 203: 200, 205: 200}
    assert graph.components(spark.createDataFrame([], "src long, dst long")).count() == 0


def brute_repeats(rows):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        marked = bytearray(len(b))
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                marked[s : s + 100] = b"\1" * 100
            seen.add(w)
        out[i] = (len(b), sum(marked), sum(marked[j] and not (j and marked[j - 1]) for j in range(len(b))), bytes(x for x, m in zip(b, marked, strict=True) if not m))
    return out


def test_repeated_passages(spark, docs, rows, empty, monkeypatch):
    wanted = brute_repeats(rows)
    for segment in (substrings.SEGMENT, 700):
        monkeypatch.setattr(substrings, "SEGMENT", segment)
        got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"])) for r in substrings.without_repeats(docs).collect()}
        assert got == wanted
    assert substrings.without_repeats(empty).count() == 0
    text = "repeated passage number one with enough different words to be longer than a hundred bytes in total, really"
    twice = spark.createDataFrame([(1, text), (1, text), (None, text), (5, "short"), (6, None)], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_removed"]) for r in substrings.without_repeats(twice).collect())
    assert got == [("1", len(text)), ("1", len(text)), ("5", 0), ("6", 0), ("None", 0)]
    cut = substrings.cut_texts(docs)
    assert cut.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in cut.collect()} == {i: t if t is None else wanted[i][3].decode("utf-8", "ignore") for i, t in rows}


def test_suffix_sort():
    rng = random.Random(2)
    data = np.frombuffer(bytes(rng.choice(b"ab") for _ in range(400)), np.uint8)
    starts = np.array([rng.randrange(0, 300) for _ in range(90)])
    sizes = np.array([rng.randint(1, 100) for _ in range(90)])
    order = substrings.Hashes(data).sorted(starts, sizes)
    raw = data.tobytes()
    keys = [raw[s : s + n] for s, n in zip(starts, sizes, strict=True)]
    assert order.tolist() == sorted(range(90), key=lambda k: (keys[k], k))


def test_vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((40, 32))
    vecs = [b + rng.standard_normal(32) * 0.05 for b in base for _ in range(3)] + [base[0]] * 5 + [base[0] * 3]
    odd = [None, [0.0] * 32, [float("nan")] * 32, [], [1.0, None], [1.0, 2.0], [1.0, 2.0]]
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(vecs)] + [(1000 + k, v) for k, v in enumerate(odd)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_duplicates(df).collect()}
    unit = np.array(vecs) / np.linalg.norm(vecs, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    found = sum(got[k][0] for k in range(len(vecs)))
    assert found <= near.sum() and found >= 0.9 * near.sum()
    assert all(got[1000 + k] == (0, 1000 + k, True) for k in range(5))
    assert got[1005] == (1, 1005, True) and got[1006] == (1, 1005, False)
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_licences(spark):
    text = "Code.\nLicensed under the  Apache License, version 2.0\nnothing here\nReleased under the MIT license!\n\nword"
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, text)], "doc_id long, text string").withColumn("dice", F.lit(1)).withColumn("size", F.lit(2))
    got = sorted(tuple(r) for r in licences.scan(df).collect())
    assert got == [(i, n, x, 1.0) for i in (1, 4) for n, x in ((2, "Apache-2.0/notice"), (4, "MIT/notice"))]
    assert licences.scan(df.limit(0)).count() == 0


def test_licence_passages(spark):
    wrap = lambda text, n: "\n".join(textwrap.wrap(text, n))
    mit, gpl = licences.TEMPLATES["MIT/full"], licences.TEMPLATES["GPL-3.0/header"]
    texts = ["some words\n" + wrap(gpl, 60) + "\nmore words", mit, wrap(mit, 50), "This code is Released under the MIT License. and some more words follow", "A.\nAll rights reserved.", "Released under the MIT License. " * 100]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r["doc_id"], r["line_no"], r["licence"]) for r in licences.scan(df).collect())
    assert got == [(0, 2, "GPL-3.0/header"), (1, 1, "MIT/full"), (2, 1, "MIT/full"), (3, 1, "MIT/notice"), (4, 2, "Proprietary/reserved"), (5, 1, "MIT/notice")]


def test_many_licences_in_one_text(spark):
    mit, isc = licences.TEMPLATES["MIT/full"], licences.TEMPLATES["ISC/full"]
    wide = textwrap.fill(isc, 70)
    df = spark.createDataFrame([(1, "\n".join([mit] * 12)), (2, "\n\n-- next --\n\n".join([wide] * 3)), (3, "since nc-17 encore")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["line_no"], r["licence"], r["dice"]) for r in licences.scan(df).collect())
    assert [g for g in got if g[0] == 1] == [(1, k, "MIT/full", 1.0) for k in range(1, 13)]
    step = wide.count("\n") + 4  # a text, a blank line, a divider, a blank line
    assert [(g[1], g[2]) for g in got if g[0] == 2] == [(1 + k * step, "ISC/full") for k in range(3)]
    assert not [g for g in got if g[0] == 3]


def test_licence_windows_equal_brute_force(spark):
    rng = random.Random(8)
    templates = {"t/long": "alpha bravo carol delta alpha bravo extra", "t/short": "gamma delta omega"}

    def best(words, name):
        wanted = set(licences.bigrams(templates[name]))
        most = int((len(templates[name].split()) - 1) * 1.5)
        windows = [words[a : a + n + 1] for a in range(len(words) - 1) for n in range(1, min(most, len(words) - a - 1) + 1)]
        parts = [set(zip(w[:-1], w[1:], strict=True)) for w in [*windows, words] if len(w) > 1]
        return max((2 * len({f"{a} {b}" for a, b in p} & wanted) / (len(p) + len(wanted)) for p in parts), default=0)

    rows = []
    for k in range(300):
        words = [w for _ in range(2) for t in templates.values() for w in t.split() if rng.random() < 0.85] if k % 2 else []
        words = [w for w in words for w in ([rng.choice(["noise", "delta"])] if rng.random() < 0.1 else [w])]
        rows.append((k, "".join(w + rng.choice([" ", " ", "\n"]) for w in words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in templates:
        got = {r["doc_id"]: 0 for r in licences.scan(df, templates={name: templates[name]}).collect()}
        assert set(got) == {k for k, t in rows if best(t.split(), name) >= 0.8}


def test_maximal_segments():
    def brute(scores):
        if not any(s > 0 for s in scores):
            return []
        best = max(((sum(scores[a : b + 1]), -a, b) for a in range(len(scores)) for b in range(a, len(scores))), key=lambda x: (round(x[0], 9), x[1], -x[2]))
        a, b = -best[1], best[2]
        return brute(scores[:a]) + [(round(best[0], 6))] + brute(scores[b + 1 :])

    rng = random.Random(9)
    for _ in range(200):
        scores = [rng.choice([1.03, 3.17, 2.51, -0.5, -0.5, -0.5]) for _ in range(rng.randint(0, 14))]
        other = [rng.choice([1.0, -0.5]) for _ in range(rng.randint(0, 5))]
        runs, cuts = toxicity.positive_runs(np.array(other + scores), np.array([0, len(other), len(other) + len(scores)]))
        got = toxicity.maximal_segments(runs[cuts[1] : cuts[2]])
        assert sorted(round(s, 6) for _, _, s in got) == sorted(brute(scores))
        for a, b, s in got:
            assert round(sum(scores[a : b + 1]), 6) == round(s, 6)


def test_toxic_scores_equal_brute_force():
    """Evidence of texts by plain loops: the longest known beginning of each word, all segments, lambda S - ln(K n)."""
    known = {b"bad": 4.137, b"bade": 5.571, b"go": -2.039, b"x": 1.217}
    nodes = {}
    for word, odds in known.items():
        found = [int(k[0]) for _, k in toxicity.beginnings(pa.array([word], pa.binary()))]
        nodes[found[len(word) - 1]] = odds
    order = sorted(nodes)
    model = toxicity.Model(np.array(order, np.uint64), np.array([nodes[k] for k in order]), -0.273, 1.5, -1.0, 1.0, -3.0)

    def odds(word):
        best = [known[p] for k in range(1, len(word) + 1) if (p := word[:k].lower()) in known]
        return best[-1] if best else -0.273

    def brute(text):
        words = re.findall(rb"[A-Za-z\x80-\xff]+", (text or "").encode())
        scores = []
        for k, w in enumerate(words):
            s = odds(w)
            if s > 0 and any(words[j].lower() == w.lower() for j in range(max(0, k - toxicity.AGAIN), k)):
                s = 0.0
            scores.append(s)

        def segments(a, b):
            best = max(((round(sum(scores[i : j + 1]), 9), -i, j) for i in range(a, b) for j in range(i, b)), default=(0, 0, 0), key=lambda x: (x[0], x[1], -x[2]))
            if best[0] <= 0:
                return []
            return segments(a, -best[1]) + [best[0]] + segments(best[2] + 1, b)

        return min(toxicity.MOST_EVIDENCE, sum(max(0.0, 1.5 * s + 1.0 - math.log(max(1, len(words)))) for s in segments(0, len(words))))

    rng = random.Random(11)
    words = ["badly", "bade", "BADEN", "good", "xylem", "plain", "and", "x", "\u00e9t\u00e9", "go,go"]
    texts = [None, "", "x", "bad bad bad", *(" ".join(rng.choice(words) for _ in range(rng.randint(1, 30))) for _ in range(60))]
    got = toxicity.Scorer(model).evidence(pa.array(texts, pa.string()))
    assert np.allclose(got, [brute(t) for t in texts])
    assert np.allclose(model.probability(got), [1 / (1 + math.exp(-(brute(t) - 3.0))) for t in texts])


def test_logistic_curve_of_separable_classes():
    """The curve separates what can be separated, wherever the classes lie, and follows the share where nothing can be."""
    for low, high, n in ((0.0, 11.0, 40), (0.0, 50.0, 3), (4.0, 6.0, 500), (0.0, 0.2, 2000)):
        x, y = np.array([low] * 8 + [high]), np.array([0.0] * 8 + [1.0])
        a, b = toxicity._logistic(x, y, np.full(9, n / 3))
        p = 1 / (1 + np.exp(-(a * x + b)))
        assert a > 0 and p[0] < 0.3 and p[-1] > 0.5
    a, b = toxicity._logistic(np.zeros(4), np.array([0.0, 0.0, 0.0, 1.0]), np.full(4, 50.0))
    assert 1 / (1 + math.exp(-b)) == pytest.approx(0.25, abs=0.01)


def test_stems_keep_their_odds_under_any_ending(spark):
    """Compounds of a stem with free endings are found in held-out rows; the stem also stands in a few clean texts."""
    rng = random.Random(8)
    parts = ["la", "ci", "os", "mente", "que", "ra", "do", "es"]
    make = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(2, 4)))
    rows, labels = [], []
    for k in range(900):
        w = [make() for _ in range(rng.randint(20, 120))]
        toxic = k % 8 == 0
        if toxic:
            for _ in range(max(2, len(w) // 25)):
                w.insert(rng.randrange(len(w)), "mentebo" + make())
        elif k % 11 == 0:
            w.append("mentebo" + make())
        rows.append((k, " ".join(w)))
        labels.append((k, int(toxic)))
    docs = spark.createDataFrame(rows + rows[:5], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels + labels[:9], "doc_id long, toxic int"))
    got = toxicity.score(docs, model).collect()
    assert len(got) == 905
    held = [(r["predicted"], dict(labels)[r["doc_id"]]) for r in got if r["held_out"]]
    caught = [p for p, y in held if y]
    assert sum(caught) >= 0.9 * len(caught) and sum(p for p, y in held if not y) <= 0.05 * len(held)


def test_toxicity(spark, empty):
    rng = random.Random(6)
    words = ["w" + "".join(rng.choice("abcdef") for _ in range(4)) for _ in range(200)]
    rows, labels = [], []
    for k in range(600):
        toxic = k % 6 == 0
        w = [rng.choice(words) for _ in range(40)]
        if toxic:
            w[10] = w[14] = w[17] = rng.choice(["badone", "badtwo"])
        rows.append((k, " ".join(w)))
        labels.append((k, int(toxic)))
    rows += [(1000, None), (1001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("toxic", F.lit("clash"))
    marks = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, marks)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    truth = dict(labels)
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i]["predicted"] == truth[i] for i in held) >= 0.97 * len(held)
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in truth)
    assert got[1000]["score"] == got[1001]["score"] < 0.5
    assert toxicity.passages(docs, model).filter("e_value < 0.05").count() > 50
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() < 520
    none = toxicity.fit(docs, marks.limit(0))
    assert {r["score"] for r in toxicity.score(docs, none).collect()} == {0.0}
    assert toxicity.score(empty, model).count() == 0


def test_language_model(spark, docs, rows, empty):
    got = {r["doc_id"]: r for r in language.fit_and_score(docs).collect()}
    words = {i: [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").translate(LOWER)) if x] + [None] for i, t in rows}
    count = collections.Counter()
    for i, w in words.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            count.update(w)
    n, v = sum(count.values()), len(count)
    for i, w in words.items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(count[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(np.log10((count[x] + 1) / (n + v + 1)) for x in w))
        assert np.isfinite(r["score"]) and r["score"] < 0
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert language.fit_and_score(empty).count() == 0


def test_language_model_is_normalised():
    trainer = language.Trainer(np.ones(language.SYMBOLS))
    w = np.random.default_rng(0).integers(1, language.SYMBOLS, 3000)
    trainer.train(w[2:], w[1:-1], w[:-2])
    left, right, bias, norm = language.normalised(language.unpacked(trainer.packed())[0])
    for a, b in ((0, 0), (5, 9), (700, 1000)):
        assert np.exp(left[a] + right[b] + bias - norm[a, b]).sum() == pytest.approx(1, abs=1e-4)


def test_language_scores_equal_brute_force(spark, docs, rows):
    """Scores by plain loops over the trained parameters: symbol by symbol, each distribution summed up."""
    train = docs.filter(~language.held_out(F.col("doc_id"), 7, 2))
    trained = language.fit(train)
    m = trained.model
    got = {r["doc_id"]: r["score"] for r in language.score(docs, trained).collect()}
    split = {i: [x.encode() for x in re.split(r"[\x20\x09-\x0D]+", (t or "").translate(LOWER)) if x] for i, t in rows}
    count = collections.Counter(w for i, ws in split.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)

    def symbol(w):
        return m.short[w] if w in m.short else language.FIRST_CLASS + language.tail_class(w)

    tail = [[c for w, c in count.items() if w not in m.short and language.tail_class(w) == k] for k in range(language.CLASSES)]
    left, right, bias = (x.astype(np.float64) for x in (m.left, m.right, m.bias))
    for i in list(split)[:25]:
        total, seen = 0.0, [language.START, language.START]
        for w in [*split[i], None]:
            x = language.END if w is None else symbol(w)
            z = left[seen[-2]] + right[seen[-1]] + bias
            total += z[x] - math.log(np.exp(z - z.max()).sum()) - z.max()
            if x >= language.FIRST_CLASS:
                counts = tail[x - language.FIRST_CLASS]
                once, twice = counts.count(1), counts.count(2)
                d = min(0.9, max(0.1, once / max(1, once + 2 * twice)))
                mass = (count[w] - d) / sum(counts) if count[w] else d * len(counts) / sum(counts) if counts else 1.0
                total += math.log(mass)
            seen.append(x)
        assert got[i] == pytest.approx(total / math.log(10), rel=1e-4, abs=1e-3)


def test_language_scores_do_not_depend_on_partitions(spark, docs, monkeypatch):
    monkeypatch.setattr(language, "SHARD_TOKENS", 2000)
    twice = docs.unionByName(docs.limit(3))
    one, seven = ({(r["doc_id"], round(r["base_score"], 6)): r["score"] for r in language.fit_and_score(twice.repartition(n)).collect()} for n in (1, 7))
    assert one.keys() == seven.keys()
    assert all(one[k] == pytest.approx(seven[k], rel=1e-6) for k in one)


def test_language_model_without_training_text(spark):
    held = [k for k in range(60) if zlib.crc32(str(k).encode()) % 7 == 2]
    got = language.fit_and_score(spark.createDataFrame([(k, "some words") for k in held], "doc_id long, text string")).collect()
    assert {(r["n_tokens"], r["n_known"], r["train_tokens"], r["score"], r["base_score"]) for r in got} == {(3, 0, 0, 0.0, 0.0)}


def test_noise_samples():
    trainer = language.Trainer(np.ones(language.SYMBOLS))
    assert np.allclose(trainer.log_noise, np.log(32 / language.SYMBOLS), atol=1e-5)


def test_slices_are_bounded():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * k for k in range(200)] + ["y" * 5000, None])], ["text"])
    parts = list(scan.slices(iter([batch]), "text", 1000))
    assert sum(p.num_rows for p in parts) == 202
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column(0).to_pylist()) <= 1000 for p in parts)


def test_pipeline(spark, tmp_path):
    """run() on a small corpus with toxic and clean labels against an independent chain of plain loops."""
    import corpus_pipeline

    rng = random.Random(21)
    words = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    prose = lambda n: [rng.choice(words) for _ in range(n)]
    passage = " ".join(prose(40))
    texts, toxic = {}, {}
    for k in range(1200):
        w = prose(rng.randint(30, 90))
        toxic[k] = int(k % 6 == 0)
        if toxic[k]:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(["zwort", "zwort", "kgift"]) + rng.choice(["en", "er", "a"]))
        texts[k] = " ".join(w)
    for k in range(1200, 1240):
        source = rng.choice([i for i in range(1200) if not toxic[i]])
        kind, w = k % 4, texts[source].split()
        texts[k] = texts[source].upper() if kind == 0 else " ".join([*w[:-1], "altered"]) if kind == 1 else " ".join([*prose(20), passage, *prose(20)]) if kind == 2 else " ".join(w)
    texts |= {1240: "", 1241: None, 1242: "short"}
    rows = [(k, t, "en", "s", len(t or "")) for k, t in texts.items()]
    folder = str(tmp_path)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 1, y) for k, y in toxic.items()], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")

    kept = {k: t for k, t in texts.items() if not toxic.get(k)}
    last = {}
    for k, t in kept.items():
        last[(t or "").translate(LOWER)] = max(k, last.get((t or "").translate(LOWER), k))
    kept = {k: kept[k] for k in last.values()}
    sets = {}
    for k, t in kept.items():
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").translate(LOWER)) if x]
        sets[k] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    kept = {k: kept[k] for k in set(brute_components(sets, 80).values())}
    left = {k: x[3].decode("utf-8", "ignore") for k, x in brute_repeats(list(kept.items())).items()}
    library = tokenizers.Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    ids = {k: [*library.encode(t, add_special_tokens=False).ids, 0] for k, t in left.items()}

    got = corpus_pipeline.run(spark, folder).collect()
    pieces, places = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert {k: sorted(p) for k, p in pieces.items()} == {k: [(0, 0, len(x), zlib.crc32(np.array(x, "<u4").tobytes()))] for k, x in ids.items()}
    for spans in places.values():
        spans.sort()
        assert [a for a, _ in spans] == [sum(n for _, n in spans[:j]) for j in range(len(spans))] and sum(n for _, n in spans) <= 2048
    assert len(places) <= 1.1 * sum(map(len, ids.values())) / 2048 + 2


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline

    folder = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, score double").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_copies_go_whatever_the_columns_are_named(spark):
    schema = "doc_id long, text string, _digest string, _again long, _kept long, _keep long, row long, digest string, again int"
    df = spark.createDataFrame([(1, "A b c d e f", "x", 1, 2, 3, 4, "y", 5), (2, "a B c d e f", None, 1, 2, 3, 4, "y", 5), (2, "a B c d e f", None, 1, 2, 3, 4, "y", 5), (None, "z", "x", 1, 2, 3, 4, "y", 5)], schema)
    kept = naming.without_copies(df)
    assert kept.columns == df.columns and sorted((r["doc_id"] or 0, r["_again"], r["digest"]) for r in kept.collect()) == [(0, 1, "y"), (2, 1, "y")]
    one = jaccard.one_of_each(df)
    assert one.columns == df.columns and sorted((r["doc_id"] or 0) for r in one.collect()) == [0, 1]


def test_repeated_rows_and_missing_ids(spark):
    """Rows stay rows: repeated ids, null ids and null texts are encoded, counted, packed and scanned each."""
    path = vocabulary("byte_bpe_50k.json")
    line = "This project is licensed under the MIT License."
    df = spark.createDataFrame([(1, line, 1), (1, line, 2), (None, None, 3), (None, "", 4)], "doc_id long, text string, n_tokens int")
    assert counting.token_counts(df, path).count() == 4
    assert encoding.encode_decode(df, vocabulary("word_bpe_49k.json")).count() == 4
    packed = packing.pack(df, path).collect()
    assert len(packed) == 4 and sum(r["length"] for r in packed if r["doc_id"] is None) == 2
    assert {r["doc_id"] for r in licences.scan(df).collect()} <= {1}


def test_component_of_several_chunks(spark, monkeypatch):
    """Near copies in one component that is dealt out as chunks give the same groups as plain loops."""
    monkeypatch.setattr(jaccard, "CHUNK", 8)
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdef") for _ in range(5)) for _ in range(60)]
    rows = []
    for k in range(70):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"new{rng.randint(0, 9)}"
        rows.append((k, " ".join(w)))
    sets = {i: {tuple(w[j : j + 4]) for j in range(len(w) - 3)} for i, t in rows for w in [t.split()]}
    got = {r["doc_id"]: r["component_id"] for r in jaccard.similar_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 4, 85).collect()}
    assert got == brute_components(sets, 85)
