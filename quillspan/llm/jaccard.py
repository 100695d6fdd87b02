"""Jaccard join of word shingle sets by T-occurrence search.

1. Equal sets are one class; only one row of each class goes on.
2. One global order puts shingles that no other set holds first, then by their count where several documents of a
   slice share them, then by what the counts of their words let expect. Which shingles recur is found by exchanging
   sorted fingerprints of all sets and kept as a bit map of fixed size. All of this covers the whole table and only
   fixes the order (a crowded bit map costs time, never a link), so its tables are bounded. Two sets that reach the threshold share one of the first
   n - ceil(t n) + 1 shingles of that order, whatever the order is.
3. Classes that share such a shingle are linked as a star; its components hold every pair that can match. A slice
   sends each shingle once, so a shingle of a third of all rows stays small.
4. Inside a component the sets are compared by T-occurrence search (DivideSkip): short inverted lists are merged by
   a heap, long ones are probed by binary search. Large components are dealt out as pairs of chunks, but only where sizes
   allow a link: sets lie in bands by size, and links cross no more than one border. Only links that join two parts
   are reported (a forest), never all pairs.
5. The components of those links are the result.

Shingles are 64-bit hashes of word hashes; equal hashes count as equal shingles.

Defined cases: null or empty texts and texts without words have an empty set and link with nothing; a text with
fewer than k words has its whole sequence as one shingle; repeated rows are members of one class; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import durable, graph, scan

FREQUENT_SHINGLES = 500_000
FREQUENT_FROM = 8
FREQUENT_WORDS = 200_000
WORDS_FROM = 4
MAP_BITS = 28
BUCKET_ENTRIES = 500_000
CHUNK = 256
CHUNKS = 6
CHUNK_SHINGLES = 3_000_000
ASKED_BITS = 25
_P = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _hashed(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all texts, where each text's begin, and the hash of the k words from each word on."""
    tokens = scan.words(texts)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens.values.to_pylist()), np.uint64, len(tokens.values))
    h = each[tokens.codes] if len(tokens.codes) else np.zeros(0, np.uint64)
    n = max(0, len(h) - k + 1)
    folded = np.zeros(n, np.uint64)
    for j in range(k):
        folded = folded * _P + h[j : j + n]
    return h, tokens.offsets, _mixed(folded)


def _whole(h: np.ndarray) -> np.ndarray:
    """The one shingle of a text with fewer than k words."""
    one = np.array([len(h)], np.uint64)
    for j in range(len(h)):
        one = one * _P + h[j : j + 1]
    return _mixed(one)


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    h, offsets, folded = _hashed(texts, k)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        out.append(np.unique(folded[a : b - k + 1]) if b - a >= k else _whole(h[a:b]) if b > a else np.zeros(0, np.uint64))
    return out


def signature(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def needed(n: int, percent: int) -> int:
    """The least overlap of a set of n shingles with a set that it is linked to."""
    return -(-percent * n // 100)


def _shared(k: int):
    """For mapInArrow: shingles that several distinct sets of a slice hold and words that recur there, with counts."""

    def make(part: pa.RecordBatch) -> pa.RecordBatch:
        sets = {signature(s): s for s in shingle_sets(part.column(0), k)}
        h, _, _ = _hashed(part.column(0), k)
        found = []
        for values, least in ((np.concatenate(list(sets.values())), 2), (h, WORDS_FROM)):
            values, counts = np.unique(values, return_counts=True)
            found.append((values[counts >= least].view(np.int64), counts[counts >= least].astype(np.int64)))
        word = np.repeat([False, True], [len(v) for v, _ in found])
        return pa.RecordBatch.from_arrays([pa.array(word), *(pa.array(np.concatenate(x)) for x in zip(*found, strict=True)), pa.array(np.where(np.arange(len(word)) == 0, len(h), 0))], ["word", "hash", "n", "tokens"])

    return scan.by_slice(make)


def fingerprints(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(32)).astype(np.uint32)


def _steps(sorted_values: np.ndarray) -> bytes:
    """Sorted numbers as 16-bit steps; the largest step stands for itself and says that the number is not reached yet."""
    steps = np.diff(sorted_values, prepend=0)
    more = steps // 0xFFFF
    out = np.full(len(steps) + int(more.sum()), 0xFFFF, "<u2")
    out[np.arange(len(steps)) + np.cumsum(more)] = steps % 0xFFFF
    return out.tobytes()


def _from_steps(blob: bytes) -> np.ndarray:
    steps = np.frombuffer(blob, "<u2").astype(np.int64)
    return np.cumsum(steps)[steps != 0xFFFF]


def _sent_fingerprints(k: int, bits: int):
    """For mapInArrow: the fingerprints of a slice's distinct sets, by their first bits; ones that recur stand twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in scan.slices(batches, "text", 8 << 20):
            sets = {signature(s): s for s in shingle_sets(part.column(0), k)}
            values, counts = np.unique(fingerprints(np.concatenate(list(sets.values()))), return_counts=True)
            values = np.repeat(values, np.minimum(counts, 2)).astype(np.int64)
            cuts = np.searchsorted(values, np.arange((1 << bits) + 1) << (32 - bits))
            filled = [b for b in range(1 << bits) if cuts[b] < cuts[b + 1]]
            blobs = [_steps(values[cuts[b] : cuts[b + 1]] - (b << (32 - bits))) for b in filled]
            yield pa.RecordBatch.from_arrays([pa.array(filled, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "steps"])

    return run


def _recurring(bits: int):
    """For applyInArrow over a bucket: its part of the bit map of fingerprints that stand more than once."""

    def run(table: pa.Table) -> pa.Table:
        values = np.sort(np.concatenate([_from_steps(x) for x in table["steps"].to_pylist()]))
        cells = np.zeros(1 << (MAP_BITS - bits), bool)
        cells[values[1:][values[1:] == values[:-1]] >> (32 - MAP_BITS)] = True
        return pa.table({"bucket": table["bucket"][:1], "cells": pa.array([np.packbits(cells).tobytes()])})

    return run


def recurring_map(docs: DataFrame, k: int) -> np.ndarray:
    """A bit for each cell of fingerprints that holds one of several sets; 2**MAP_BITS bits, whatever the table."""
    bits = min(12, max(4, int(durable.partitions(docs.sparkSession) * 2 - 1).bit_length()))
    sent = docs.select("text").mapInArrow(_sent_fingerprints(k, bits), "bucket int, steps binary")
    out = np.zeros((1 << bits, 1 << (MAP_BITS - bits - 3)), np.uint8)
    for r in sent.groupBy("bucket").applyInArrow(_recurring(bits), "bucket int, cells binary").collect():
        out[r["bucket"]] = np.frombuffer(bytes(r["cells"]), np.uint8)
    return out.ravel()


@dataclass(frozen=True)
class Order:
    """Cells of recurring shingles, counts of frequent shingles and words (sorted by hash), and of all words."""

    cells: np.ndarray
    shingles: np.ndarray
    shingle_counts: np.ndarray
    words: np.ndarray
    word_counts: np.ndarray
    tokens: int

    def recurs(self, s: np.ndarray) -> np.ndarray:
        cell = s >> np.uint64(64 - MAP_BITS)
        return (self.cells[cell >> np.uint64(3)] >> (np.uint64(7) - (cell & np.uint64(7))).astype(np.uint8)) & 1

    @staticmethod
    def _looked_up(keys: np.ndarray, table: np.ndarray, counts: np.ndarray, other: float) -> np.ndarray:
        if not len(table):
            return np.full(len(keys), other)
        at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        return np.where(table[at] == keys, counts[at], other)

    def prefixes(self, texts: pa.Array, k: int, percent: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The set of each text, and those of its shingles that stand first in the order."""
        h, offsets, folded = _hashed(texts, k)
        share = np.log2(self._looked_up(h, self.words, self.word_counts, 1.0)) - np.log2(max(2, self.tokens))
        total = np.concatenate(([0.0], np.cumsum(share)))
        expected = np.round(total[k:] - total[:-k] if len(h) >= k else np.zeros(0), 3)
        sets, heads = [], []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            if b - a < k:
                sets.append(_whole(h[a:b]) if b > a else np.zeros(0, np.uint64))
                heads.append(sets[-1])
                continue
            s, at = np.unique(folded[a : b - k + 1], return_index=True)
            sets.append(s)
            size = len(s) - needed(len(s), percent) + 1
            own = self._looked_up(s, self.shingles, self.shingle_counts, 0.0)
            heads.append(s[np.lexsort((s, expected[a + at], own, self.recurs(s)))[:size]])
        return sets, heads


def order_of(docs: DataFrame, k: int) -> Order:
    """The global order of the shingles of a table with a column text."""
    counts = durable.stored(docs.select("text").mapInArrow(_shared(k), "word boolean, hash long, n long, tokens long").groupBy("word", "hash").agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens")), "counts")
    tables = []
    for word, least, most in ((False, FREQUENT_FROM, FREQUENT_SHINGLES), (True, FREQUENT_FROM, FREQUENT_WORDS)):
        top = counts.filter((F.col("word") == word) & (F.col("n") >= least)).orderBy(F.desc("n"), "hash").limit(most).select("hash", "n").toPandas()
        values, n = top["hash"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
        at = np.argsort(values)
        tables += [values[at], n[at]]
    return Order(recurring_map(docs, k), *tables, counts.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n")).first()["n"])


_SETS = "row long, doc_id long, n_shingles long, signature binary, prefix binary"


def _prefixes(k: int, percent: int, order):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for part in scan.slices(batches, "text"):
            sets, heads = order.value.prefixes(part.column(1), k, percent)
            rows = pa.array(np.arange(row, row + len(sets)))
            row += len(sets)
            columns = [rows, part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(map(signature, sets), pa.binary()), pa.array([x.tobytes() for x in heads], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "n_shingles", "signature", "prefix"])

    return run


def _stars(tokens: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct tokens with the least node of each, and links from that node to the token's other nodes."""
    order = np.lexsort((nodes, tokens))
    tokens, nodes = tokens[order], nodes[order]
    first = np.ones(len(tokens), bool)
    first[1:] = tokens[1:] != tokens[:-1]
    heads = nodes[np.flatnonzero(first)][np.cumsum(first) - 1] if len(tokens) else nodes
    links = np.unique(np.stack((heads, nodes), 1)[(~first) & (heads != nodes)], axis=0)
    return tokens[first], nodes[first], links[:, 0], links[:, 1]


_STARS = "bucket int, tokens binary, nodes binary, src array<long>, dst array<long>"


def _local_stars(buckets: int, held: int = 400_000):
    """For mapInArrow over (node, prefix): links inside some ten thousand sets, and one entry a token for the rest."""

    def emit(tokens: list[np.ndarray], nodes: list[np.ndarray]) -> pa.RecordBatch:
        values, least, src, dst = _stars(np.concatenate(tokens), np.concatenate(nodes))
        bucket = (values % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        codes, least = (values // np.uint64(buckets)).astype(np.uint32)[order], least[order]
        filled = [b for b in range(buckets) if cuts[b] < cuts[b + 1]]
        rows = [(b, codes[cuts[b] : cuts[b + 1]].tobytes(), least[cuts[b] : cuts[b + 1]].tobytes(), None, None) for b in filled]
        rows.append((None, None, None, src.tolist(), dst.tolist()))
        kinds = (pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["bucket", "tokens", "nodes", "src", "dst"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, nodes, n = [], [], 0
        for part in batches:
            for node, blob in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                tokens.append(np.frombuffer(blob, np.uint64))
                nodes.append(np.full(len(tokens[-1]), node, np.int64))
                n += len(tokens[-1])
                if n > held:
                    yield emit(tokens, nodes)
                    tokens, nodes, n = [], [], 0
        if n:
            yield emit(tokens, nodes)

    return run


def _bucket_stars(table: pa.Table) -> pa.Table:
    tokens = np.concatenate([np.frombuffer(x, np.uint32) for x in table["tokens"].to_pylist()])
    nodes = np.concatenate([np.frombuffer(x, np.int64) for x in table["nodes"].to_pylist()])
    _, _, src, dst = _stars(tokens, nodes)
    return pa.table({"src": src, "dst": dst})


def candidate_links(reps: DataFrame, entries: int) -> DataFrame:
    """src, dst: links whose components hold every pair of sets that can reach the threshold. reps: node, prefix."""
    buckets = max(1, -(-entries // BUCKET_ENTRIES))
    stars = durable.stored(reps.select("node", "prefix").mapInArrow(_local_stars(buckets), _STARS), "prefixes")
    local = stars.filter("src IS NOT NULL").select(F.explode(F.arrays_zip("src", "dst")).alias("e")).select("e.src", "e.dst")
    across = stars.filter("bucket IS NOT NULL").select("bucket", "tokens", "nodes").groupBy("bucket").applyInArrow(_bucket_stars, "src long, dst long")
    links = durable.stored(local.unionByName(across), "candidates")
    durable.dropped(stars)
    return links


class Parts:
    """Union-find over the sets of one comparison, with an array of roots for whole-array questions."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: int, b: int) -> bool:
        a, b = self.root[a], self.root[b]
        if a == b:
            return False
        self.root[self.root == max(a, b)] = min(a, b)
        return True


def merged(lists: list[np.ndarray], least: int) -> list[int]:
    """Numbers that stand in at least `least` of the sorted lists: a heap of the lists' next numbers."""
    if least == 1 and len(lists) == 1:
        return lists[0].tolist()
    out, last, count = [], -1, 0
    for x in heapq.merge(*(x.tolist() for x in lists)):
        if x != last:
            last, count = x, 0
        count += 1
        if count == least:
            out.append(x)
    return out


def forest(sets: list[np.ndarray], percent: int, split: int | None = None) -> list[tuple[int, int]]:
    """Links of a spanning forest of the sets whose Jaccard similarity reaches percent/100.

    split: compare only sets before it with sets from it on. Of a set's inverted lists the longest ones, as many as
    DivideSkip's rule allows, are left to binary probes; a candidate must stand in enough of the others. Sets that
    are connected already are not compared again."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    values, codes = np.unique(np.concatenate(sets), return_inverse=True)
    owners = np.repeat(np.arange(n), sizes)
    order = np.argsort(codes, kind="stable")
    starts = np.searchsorted(codes[order], np.arange(len(values) + 1))
    index = owners[order]
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    parts, out = Parts(n), []
    for x in range(n if split is None else split):
        low, high = (x + 1, n) if split is None else (split, n)
        if not (parts.root[low:high] != parts.root[x]).any():
            continue
        mine = codes[bounds[x] : bounds[x + 1]]
        lengths = starts[mine + 1] - starts[mine]
        by_length = np.argsort(lengths, kind="stable")
        t = needed(len(mine), percent)
        long = min(t - 1, int(t / (0.01 * np.log2(max(2, lengths.max(initial=1))) + 1)))
        short = mine[by_length[: len(mine) - long]]
        lists = [index[starts[c] : starts[c + 1]] for c in short]
        lists = [y for y in (y[(y >= low) & (y < high) & (parts.root[y] != parts.root[x])] for y in lists) if len(y)]
        if len(lists) < t - long:
            continue
        probes = np.sort(values[mine[by_length[len(mine) - long :]]])
        few = np.sort(values[short])
        for y in merged(lists, t - long):
            if parts.root[y] == parts.root[x] or sizes[y] * 100 < percent * sizes[x] or sizes[x] * 100 < percent * sizes[y]:
                continue
            other = sets[y]
            both = 0
            for some in (few, probes):
                at = np.searchsorted(other, some)
                both += int((other[np.minimum(at, len(other) - 1)] == some).sum())
            if 100 * both >= percent * (sizes[x] + sizes[y] - both) and parts.join(x, y):
                out.append((x, y))
    return out


def _compare(percent: int):
    """For applyInArrow: the sets of one task; they hold whole components, or two chunks of one. Rows that repeat an id
    bring a set more than once."""

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.unique(table["node"].to_numpy(), return_index=True)[1]))
        table = table.sort_by([("component", "ascending"), ("chunk", "ascending"), ("node", "ascending")])
        component, chunk = table["component"].to_numpy(), table["chunk"].to_numpy()
        nodes, sets = table["node"].to_numpy(), [np.frombuffer(x, np.uint64) for x in table["shingles"].to_pylist()]
        cuts = [0, *(np.flatnonzero(component[1:] != component[:-1]) + 1).tolist(), len(sets)]
        src, dst = [], []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            split = None if chunk[a] == chunk[b - 1] else int(np.searchsorted(chunk[a:b], chunk[b - 1]))
            for x, y in forest(sets[a:b], percent, split):
                src.append(int(nodes[a + x]))
                dst.append(int(nodes[a + y]))
        return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})

    return run


def _full_sets(k: int):
    """For mapInArrow: shingle sets again, of those rows whose set is the one that is asked for."""

    def make(part: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(part.column(0), k)
        keep = [i for i, s in enumerate(sets) if signature(s) == part.column(1)[i].as_py()]
        rest = part.select(["node", "component", "chunk", "others"]).take(pa.array(keep, pa.int64()))
        return pa.RecordBatch.from_arrays([*rest.columns, pa.array([sets[i].tobytes() for i in keep], pa.binary())], [*rest.schema.names, "shingles"])

    return scan.by_slice(make)


def size_band(n: Column, percent: int) -> Column:
    """A number that differs by 1 at most between sizes of sets that can be linked; bands are wider than that by a
    thousandth, so that rounding does no harm."""
    return F.floor(F.log(n) / (max(math.log(100 / percent), 1e-6) * 1.001))


def _chunk(chunk: Column) -> Column:
    return F.col("band") * (1 << 32) + chunk


def chunked(found: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """node, doc_id, signature, component, chunk of each set that is to be compared, and the chunks `others` that its chunk
    meets, itself included (null where the component is compared as a whole).

    A set is sent once for each of these chunks: a component has about CHUNKS of them, whatever its size, and more only
    where two of them would not fit a task."""
    sets = found.join(reps.select("node", "doc_id", "signature", "n_shingles"), "node").withColumn("band", size_band(F.col("n_shingles"), percent))
    cells = durable.stored(sets.groupBy("component", "band").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles")), "cells")
    whole = cells.groupBy("component").agg(F.sum("n").alias("size"), F.sum("shingles").alias("all"))
    cut = F.greatest(F.least(F.ceil(F.col("size") / CHUNK), F.lit(CHUNKS)), F.ceil(F.col("all") / CHUNK_SHINGLES))
    large = whole.select("component", "size", cut.alias("cut")).filter("cut > 1")
    chunks = F.greatest(F.ceil(F.col("n") * F.col("cut") / F.col("size")), F.ceil(F.col("shingles") / CHUNK_SHINGLES)).cast("int")
    large = durable.stored(cells.join(large.hint("merge"), "component").select("component", "band", chunks.alias("chunks")), "large")
    listed = large.select("component", "band", F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), _chunk).alias("others"))
    near = listed.select("component", F.explode(F.array(*(F.col("band") + d for d in (-1, 0, 1)))).alias("band"), "others")
    near = near.groupBy("component", "band").agg(F.flatten(F.collect_list("others")).alias("others"))
    met = large.join(near.hint("merge"), ["component", "band"])
    asked = sets.join(met.hint("merge"), ["component", "band"], "left")
    return asked.select("node", "doc_id", "signature", "component", F.when(F.col("chunks").isNull(), 0).otherwise(_chunk(F.pmod(F.xxhash64("node"), F.col("chunks")))).cast("long").alias("chunk"), "others")


def _cell(id_col: str) -> Column:
    return F.pmod(F.xxhash64(id_col), F.lit(1 << ASKED_BITS)).cast("int")


def _asked_ids(asked: DataFrame) -> np.ndarray:
    """A bit for each cell of ids that holds an asked one; 2**ASKED_BITS bits, whatever the table."""
    low = 1 << 15
    out = np.zeros((1 << ASKED_BITS) // low * (low // 8), np.uint8).reshape(-1, low // 8)
    cells = asked.select(_cell("doc_id").alias("cell")).groupBy(F.floor(F.col("cell") / low).cast("int").alias("part"))
    for r in cells.agg(F.expr(f"bitmap_construct_agg(cell % {low})").alias("bits")).toLocalIterator():
        out[r["part"]] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out.ravel()


def _only_asked(bits):
    """For mapInArrow: rows whose id may be an asked one, so that few other texts are sent to the join with those ids."""

    def make(part: pa.RecordBatch) -> pa.RecordBatch:
        cell = part.column(2).to_numpy()
        hit = (bits.value[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1
        return part.select(["doc_id", "text"]).filter(pa.array(hit.astype(bool)))

    return scan.by_slice(make)


def similar_groups(docs: DataFrame, k: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links) of every row."""
    spark = docs.sparkSession
    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    order = spark.sparkContext.broadcast(order_of(kept, k))
    sets = durable.stored(kept.mapInArrow(_prefixes(k, percent, order), _SETS), "sets")
    order.destroy()
    durable.release(spark)
    rows = durable.stored(sets.select("row", "doc_id", "n_shingles", "signature"), "rows")
    classes = rows.filter("n_shingles > 0").groupBy("signature").agg(F.min("row").alias("node"), F.min("doc_id").alias("least"))
    classes = durable.stored(classes, "classes")
    reps = durable.stored(sets.filter("n_shingles > 0").join(classes.select(F.col("node").alias("row")).hint("merge"), "row").withColumnRenamed("row", "node"), "reps")
    durable.dropped(sets)
    entries = reps.agg(F.coalesce(F.sum(F.length("prefix") / 8), F.lit(0)).cast("long").alias("n")).first()["n"]
    found = graph.components(candidate_links(reps, entries))
    asked = durable.stored(chunked(found, reps, percent), "asked")
    durable.dropped(reps)
    durable.release(spark)
    bits = spark.sparkContext.broadcast(_asked_ids(asked))
    # The table of candidates has no bound, so it is never broadcast, whatever Spark estimates.
    some = kept.withColumn("cell", _cell("doc_id")).mapInArrow(_only_asked(bits), kept.schema)
    texts = some.join(asked.hint("merge"), some["doc_id"].eqNullSafe(asked["doc_id"])).select("text", "signature", "node", "component", "chunk", "others")
    whole = texts.mapInArrow(_full_sets(k), "node long, component long, chunk long, others array<long>, shingles binary")
    tasks = durable.partitions(spark) * 8
    dealt = whole.withColumn("with", F.explode(F.coalesce("others", F.array("chunk"))))
    small = F.pmod(F.xxhash64("component"), F.lit(tasks))
    dealt = dealt.select("node", "component", "chunk", "shingles", F.when(F.col("others").isNull(), small).otherwise(F.xxhash64("component", F.least("chunk", "with"), F.greatest("chunk", "with"))).alias("task"))
    links = dealt.groupBy("task").applyInArrow(_compare(percent), "src long, dst long")
    final = graph.components(durable.stored(links, "links"))
    bits.destroy()
    named = classes.join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = durable.stored(named, "named")
    least = durable.stored(named.groupBy("component").agg(F.min("least").alias("component_id")), "least")
    by_class = durable.stored(named.join(least, "component").select("signature", "component_id"), "by_class")
    out = rows.join(by_class, "signature", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id is the smallest of its component, with all their columns."""
    keep = similar_groups(docs, k, percent, id_col, text_col).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    keep = durable.stored(keep.select("doc_id").distinct(), "keep").alias("keep").hint("merge")
    return docs.alias("docs").join(keep, F.col(f"docs.`{id_col}`").cast("long").eqNullSafe(F.col("keep.doc_id")), "left_semi")
