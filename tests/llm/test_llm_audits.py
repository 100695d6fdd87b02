"""Line dedup, the filter audit and whitening against brute force, with odd inputs."""

import collections
import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.llm import cuckoo, filters, lines, whitening

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = " \t\n\x0b\x0c\r"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest long, first long, row long, shard int, part string, mask int, sha string, n long"


def made(spark, rows):
    """Rows of (doc_id, text, source), with columns whose names the operators use themselves."""
    full = [(i, t, "en", s, 0, 1, 2, 3, 4, "p", 5, "x", 6) for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3) if full else spark.createDataFrame([], SCHEMA)


def line_rows():
    rng = np.random.default_rng(4)
    shared = [f"shared line number {k} of all" for k in range(12)] + ["Größe äöü €", "ééééééééé", "short"]
    rows = []
    for k in range(150):
        own = [f"own line {k} {j} {rng.integers(1 << 30)}" for j in range(rng.integers(0, 6))]
        some = [shared[j] for j in rng.integers(0, len(shared), rng.integers(0, 5))]
        dressed = [s.upper() if rng.random() < 0.2 else f" {s}\t\r" if rng.random() < 0.3 else s for s in own + some + some[:1]]
        rng.shuffle(dressed)
        rows.append((5 * k + 1, "\n".join(dressed), "s"))
    long = "\n".join(f"{shared[k % 12]}" if k % 9 == 0 else f"a line of the long text {k}" for k in range(200_000))
    return [*rows, (7, "", "s"), (8, None, "s"), (9, "\n\n", "s"), rows[3], rows[3], (None, "no id here at all\nshared line number 1 of all", "s"), (None, "no id here at all", None), (900, long, "s"), (901, long, "s")]


def key_of(line):
    key = line.strip(SPACE).translate(LOWER)
    return key if len(key) >= 10 else None


def dropped_lines(rows):
    """doc_id, lines before, lines dropped and what is kept of every row."""
    place = lambda d: (d is None, d or 0)
    docs_of = collections.defaultdict(set)
    for d, t, _ in rows:
        for line in (t or "").split("\n"):
            docs_of[key_of(line)].add(place(d))
    docs_of.pop(None, None)
    out = []
    for d, t, _ in rows:
        every = (t or "").split("\n")
        kept = [x for x in every if len(docs_of.get(key_of(x), ())) < 2 or min(docs_of[key_of(x)]) == place(d)]
        out.append((d, len(every), len(every) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_cuckoo_filter_keeps_what_it_gets():
    rng = np.random.default_rng(1)
    for keys, buckets in ((3000, cuckoo.buckets_for(3000)), (300, 64), (40, 2)):
        hashes = np.unique(rng.integers(0, 1 << 63, keys, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
        kept = cuckoo.Cuckoo(buckets)
        kept.insert(hashes[: keys // 2])
        kept.insert(hashes[keys // 2 :])
        kept = cuckoo.Cuckoo.load(kept.dump())
        assert kept.contains(hashes).all()
        assert (kept.slots > 0).sum() + len(kept.stash) == len(hashes)
        gone = rng.permutation(len(hashes))[: len(hashes) // 3]
        kept.remove(hashes[gone])
        assert (kept.slots > 0).sum() + len(kept.stash) == len(hashes) - len(gone)
        assert kept.contains(np.delete(hashes, gone)).all()
        if buckets > 100:
            assert not kept.contains(hashes[gone]).mean() > 0.02
        kept.remove(np.delete(hashes, gone))
        assert not (kept.slots > 0).any() and not len(kept.stash)
    assert len(kept.stash) == 0
    kept.insert(np.zeros(30, np.uint64) + np.uint64(77))
    assert len(kept.stash) > 0 and kept.contains(np.array([77], np.uint64)).all()
    kept.remove(np.zeros(30, np.uint64) + np.uint64(77))
    assert not kept.contains(np.array([77], np.uint64)).any()


def cleaned(docs, index):
    return sorted(map(tuple, lines.clean(docs, index).collect()), key=str)


def state(index):
    """Counts of the index, after a check that its filters hold each key once."""
    counts = {bytes(r["digest"]): (r["n"], r["first"], r["last"]) for r in index.counts.collect()}
    halves = lines._halves(list(counts)) if counts else np.zeros((0, 2), np.uint64)
    shards = {r["shard"]: cuckoo.Cuckoo.load(bytes(r["filter"])) for r in index.filters.collect()}
    assert sum(int((f.slots > 0).sum()) + len(f.stash) for f in shards.values()) == len(counts)
    for shard in np.unique(halves[:, 0] % np.uint64(index.shards)).tolist():
        assert shards[shard].contains(halves[halves[:, 0] % np.uint64(index.shards) == shard, 1]).all()
    return counts


def test_line_dedup_equals_brute_force(spark):
    rows = line_rows()
    docs = made(spark, rows)
    index = lines.insert(docs)
    assert cleaned(docs, index) == dropped_lines(rows)
    state(index)


def test_line_index_is_reversible(spark, tmp_path):
    rows = [r for r in line_rows() if r[0] not in (900, 901)]
    docs = made(spark, rows)
    parts = [made(spark, rows[k::3]) for k in range(3)]
    index = lines.insert(parts[0])
    first = state(index)
    for part in parts[1:]:
        index = lines.insert(part, index)
    assert state(index) == state(lines.insert(docs))
    assert cleaned(docs, index) == dropped_lines(rows)
    index.save(str(tmp_path / "index"))
    index = lines.LineIndex.load(spark, str(tmp_path / "index"))
    gone = [r for k in (1, 2) for r in rows[k::3] if r[0] not in {r[0] for r in rows[0::3]}]
    left = lines.delete(index, made(spark, gone))
    kept = [r for r in rows if r[0] not in {g[0] for g in gone}]
    assert state(left) == state(lines.insert(made(spark, kept)))
    assert set(state(left)) == set(first)
    assert cleaned(made(spark, kept), left) == dropped_lines(kept)


def test_line_filters_grow_and_odd_tables(spark):
    assert cleaned(made(spark, []), lines.insert(made(spark, []))) == []
    index = lines.insert(made(spark, [(1, "the first of all lines", "s")]))
    many = [(10 + k, "\n".join(f"text {k} and line {j}" for j in range(60)), "s") for k in range(40)]
    grown = lines.insert(made(spark, many), index)
    assert grown.buckets > index.buckets
    assert len(state(grown)) == 2401
    nothing = lines.delete(grown, made(spark, [*many, (1, "", "s")]))
    assert state(nothing) == {}
    assert state(lines.insert(made(spark, [(1, "the first of all lines", "s")]), nothing)) == state(index)


def audited(rows, labels):
    """The audit by running every order of the filters over every document."""
    firsts = {}
    for d, t, _ in rows:
        place = (d is None, d or 0)
        firsts[t or ""] = min(firsts.get(t or "", place), place)

    def fails(d, t):
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        return {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search("[#$%&*|]", t)),
            "E": (d is None, d or 0) > firsts[t],
        }

    judged = [(s or "", fails(d, t or ""), labels.get(d, (0, 0))) for d, t, s in rows]
    out = collections.Counter()
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    for order in map("".join, itertools.permutations("ABCDE")):
        for part, f, (good, toxic) in judged:
            here = True
            for step, x in enumerate(order, 1):
                was, here = here, here and not f[x]
                lost = was and f[x]
                for name, v in zip(names, (here, lost, f[x] and not was, f[x] and sum(f.values()) == 1, lost and good, lost and toxic), strict=True):
                    out[part, order, step, name] += int(v)
                out[part, x] += int(lost)
    return sorted((p, o, s, *(out[p, o, s, n] for n in names), out[p, o[s - 1]]) for p in {j[0] for j in judged} for o in map("".join, itertools.permutations("ABCDE")) for s in range(1, 6))


def filter_rows():
    rng = np.random.default_rng(8)
    rows = []
    for k in range(120):
        words = [f"w{j}" for j in rng.integers(0, rng.choice([20, 400]), rng.choice([10, 49, 50, 90]))]
        if k % 5 == 0:
            words = [w.upper() for w in words]
        if k % 7 == 0:
            words.append("50% off")
        rows.append((3 * k, "  \t".join(words[:2]) + " " + "\n".join(words[2:]), ["a", "b", None, "a"][k % 4]))
    copies = [(1000 + k, rows[k][1], "b") for k in range(0, 40, 3)] + [(2, rows[30][1], "c")]
    return [*rows, *copies, (4, None, "a"), (5, "", "c"), (6, "A", ""), rows[9], rows[9], (None, rows[12][1], "a"), (None, "nobody's text", "a"), (None, "nobody's text", "a"), (7, "x " * 400_000, "a")]


def test_filter_audit_equals_brute_force(spark):
    rows = filter_rows()
    labels = {d: (k % 2, k % 3 % 2) for k, (d, _, _) in enumerate(rows) if d is not None and k % 4}
    table = [(d, *v, "x") for d, v in labels.items()] + [(None, 1, 1, "x"), (3, None, None, "y"), (999_999, 1, 1, "z")]
    found = filters.interactions(made(spark, rows), spark.createDataFrame(table, "doc_id long, quality int, toxic int, mask string"))
    assert sorted(map(tuple, found.collect())) == audited(rows, labels)


def test_filter_audit_of_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filters.interactions(made(spark, []), none).collect() == []
    rows = [(1, None, None)]
    assert sorted(map(tuple, filters.interactions(made(spark, rows), none).collect())) == audited(rows, {})
    by = filters.outcome_matrices()
    assert all(by[k].shape == (32, 600) for k in ("kept", "removed", "redundant", "unique"))


def whitened(vectors, components=4):
    """The whitening of usable vectors of the most frequent length with numpy alone."""
    usable = []
    for i, v in vectors:
        if v and all(c is not None and np.isfinite(c) for c in v):
            usable.append((i, tuple(int(np.floor(256 * c)) for c in v)))
    sizes = collections.Counter(len(x) for x in {x for _, x in usable})
    if not sizes:
        return None
    size = max(sizes, key=lambda s: (sizes[s], s))
    usable = [(i, x) for i, x in usable if len(x) == size]
    fit = np.array(sorted({x for _, x in usable}), np.int64)
    covariance = np.cov(fit.T, bias=True).reshape(size, size)
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    rows = np.array([x for _, x in usable])
    total = fit.sum(0)
    return [i for i, _ in usable], len(fit), ((len(fit) * rows - total) ** 2).sum(1), (rows - fit.mean(0)) @ axes, values, np.trace(covariance)


def compared(found, vectors):
    ids, n, deviations, projected, values, trace = whitened(vectors)
    rows = collections.defaultdict(list)
    for r in found.collect():
        rows[r["component"]].append(r)
    wanted = sorted(zip(map(str, ids), deviations.tolist(), strict=True))
    for k, e in enumerate(values, 1):
        assert sorted((str(r["vec_id"]), r["deviation"]) for r in rows[k]) == wanted
        assert all(r["n"] == n and r["identity_error"] < 1e-9 for r in rows[k])
        assert np.allclose([r["explained"] for r in rows[k]], e / trace)
        by_id = {r["vec_id"]: r["whitened"] for r in rows[k]}
        mine, own = np.array([by_id[i] for i in ids]), projected[:, k - 1] / np.sqrt(e)
        assert np.allclose(mine, own, atol=1e-8) or np.allclose(mine, -own, atol=1e-8)
    assert set(rows) == set(range(1, len(values) + 1))


def vector_rows():
    rng = np.random.default_rng(2)
    base = rng.normal(0, 1, (300, 7)) @ np.diag([3, 2, 1.5, 1, 0.5, 0.2, 0.1])
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(base)]
    odd = [(500, None), (501, []), (502, [1.0, None] + [0.0] * 5), (503, [float("nan")] * 7), (504, [float("inf")] + [0.0] * 6), (505, [1.0, 2.0]), (None, rows[4][1]), (506, [1e30] * 7)]
    return [*rows, *(rows[3:9] * 3), *((600 + k, [float(c) + 1e-9 for c in base[5]]) for k in range(50)), *odd]


def test_whitening_equals_brute_force(spark):
    rows = vector_rows()
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, n int, packed string").repartition(5)
    compared(whitening.whiten(table), [r for r in rows if r[0] != 506])


def test_whitening_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>"
    make = lambda rows: whitening.whiten(spark.createDataFrame(rows, schema)).collect()
    assert make([]) == [] and make([(1, None), (2, [])]) == []
    one = make([(1, [0.5, 0.25]), (2, [0.5, 0.25])])
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)] * 2
    flat = make([(k, [k / 8, 0.5, 0.5]) for k in range(9)])
    assert {r["component"]: r["whitened"] is None for r in flat} == {1: False, 2: True, 3: True}
    assert all(r["identity_error"] < 1e-12 for r in flat)
    big = whitening.whiten(spark.createDataFrame([(1, [2.0**40]), (2, [-(2.0**40)]), (3, [2.0**54])], "vec_id long, embedding array<double>")).collect()
    assert all(r["deviation"] is None for r in big)


def test_queries_read_whole_tables(spark):
    from quillspan.llm import queries

    small = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    found = lines.clean(docs, lines.insert(docs))
    assert cleaned_rows(found) == dropped_lines(rows)
    vectors = spark.read.parquet(f"{small}/embeddings.parquet")
    compared(queries.op13_embedding_whitening(spark, small), [(r["vec_id"], r["embedding"]) for r in vectors.collect()])
    parts = queries.op12_filter_interaction_audit(spark, small).groupBy("part").agg(F.count("*").alias("n"))
    assert {(r["part"], r["n"]) for r in parts.collect()} == {(r[2] or "", 600) for r in rows}


def cleaned_rows(found):
    return sorted(map(tuple, found.collect()), key=str)
