"""Line dedup over documents that come and go: sharded cuckoo filters backed by exact reference counts.

A line's key is the line without ASCII white space at both ends and with A-Z lower-cased; keys of at least ten code
points count. Keys are known by 128-bit BLAKE2b digests. An index holds three tables:

- holders: each (key, document row) that stands in the corpus, the exact record that counts are drawn from;
- counts: for each key the number of rows that hold it and its first and last document;
- filters: a cuckoo filter for each shard of the keys.

`insert` adds documents. Each task sums up its own keys, so that a line that everyone holds is sent once a task. In its
shard a key meets the filter first: what the filter has not seen is new, and goes to the counts as it is. Only what it
may have seen is counted by exact digests, inside the batch, and looked up in the counts of earlier batches. `delete`
takes documents out again: counts of their keys are drawn anew from the remaining holders, and keys that nobody holds
leave the filters. So an index after insertions and deletions equals the index of the documents that are left.
`clean` drops from documents the lines whose key a smaller document holds.

Shards follow the number of keys; filters are built anew with more buckets, from the counts, before they are full. Very
frequent keys (more than one in 10,000 of all holders, so fewer than 10,000 keys) are looked up by broadcast, the others
by a merge join, where none is frequent.

Defined cases: null texts are empty, which is one empty line; rows that share a doc_id are one document, null ids too,
which come last; wholly repeated rows are cleaned alike; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cuckoo, durable, scan

LEAST_CHARACTERS = 10
SHARD_KEYS = 400_000
HELD_KEYS = 200_000
HOT_SHARE = 10_000
CHUNK = 1 << 16
LAST = (1 << 63) - 1
SPACE = b" \t\n\x0b\x0c\r"
_COUNTS = "digest binary, n long, first long, last long"


@dataclass(frozen=True)
class LineIndex:
    shards: int
    buckets: int
    holders: DataFrame
    counts: DataFrame
    filters: DataFrame

    def save(self, path: str) -> None:
        """Writes the index to a folder."""
        for name in ("holders", "counts", "filters"):
            getattr(self, name).write.parquet(f"{path}/{name}")
        self.filters.sparkSession.createDataFrame([(self.shards, self.buckets)], "shards int, buckets int").write.parquet(f"{path}/sizes")

    @staticmethod
    def load(spark: SparkSession, path: str) -> LineIndex:
        sizes = spark.read.parquet(f"{path}/sizes").first()
        return LineIndex(sizes["shards"], sizes["buckets"], *(spark.read.parquet(f"{path}/{name}") for name in ("holders", "counts", "filters")))


def _digest(line: bytes) -> bytes | None:
    """The digest of a line's key, none for short keys."""
    key = line.strip(SPACE)
    if len(key) < LEAST_CHARACTERS or (len(key) < 4 * LEAST_CHARACTERS and len(key.decode("utf-8", "replace")) < LEAST_CHARACTERS):
        return None
    return hashlib.blake2b(key.lower(), digest_size=16).digest()


def _halves(digests: pa.Array | list[bytes]) -> np.ndarray:
    """Digests as two 64-bit numbers each: the first one deals out shards, the second one is the filter's hash."""
    joined = b"".join(digests) if isinstance(digests, list) else scan.flat(digests)[0].tobytes()
    return np.frombuffer(joined, "<u8").reshape(-1, 2)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, doc (with a place for null), row (a digest of id and text) and text."""
    doc, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit(""))
    row = F.substring(F.unhex(F.sha2(F.concat_ws(":", F.coalesce(doc.cast("string"), F.lit("-")), text), 256)), 1, 16)
    return docs.select(doc.alias("doc_id"), F.coalesce(doc, F.lit(LAST)).alias("doc"), row.alias("row"), text.alias("text"))


def _held(part: pa.RecordBatch) -> pa.RecordBatch:
    data, at = scan.flat(part.column(2))
    raw, found, sizes = data.tobytes(), [], []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        own = set(map(_digest, raw[a:b].split(b"\n")))
        own.discard(None)
        found.extend(own)
        sizes.append(len(own))
    which = pa.array(np.repeat(np.arange(part.num_rows), sizes))
    return pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), part.column(0).take(which), part.column(1).take(which)], ["digest", "doc", "row"])


def _summed(shards: int):
    """For mapInArrow over holders: each key of some hundred thousand rows once, with its shard."""

    def emit(held: dict[bytes, list]) -> Iterator[pa.RecordBatch]:
        if held:
            digests, counts = list(held), np.array(list(held.values()), np.int64)
            shard = pa.array((_halves(digests)[:, 0] % np.uint64(shards)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([shard, pa.array(digests, pa.binary()), *map(pa.array, counts.T)], ["shard", "digest", "n", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}
        for part in batches:
            for digest, doc in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                known = held.get(digest)
                if known is None:
                    held[digest] = [1, doc, doc]
                else:
                    known[0] += 1
                    known[1] = min(known[1], doc)
                    known[2] = max(known[2], doc)
            if len(held) > HELD_KEYS:
                yield from emit(held)
                held = {}
        yield from emit(held)

    return run


def _met(buckets: int):
    """For a cogroup of a shard's new keys and its filter: the keys, each once, `maybe` where an earlier batch may hold
    them, and the filter with the keys that are surely new."""

    def run(new: pa.Table, old: pa.Table) -> pa.Table:
        kept = cuckoo.Cuckoo.load(old["filter"][0].as_py()) if old.num_rows else cuckoo.Cuckoo(buckets)
        shard = (new if new.num_rows else old)["shard"][0].as_py()
        digests = new["digest"].combine_chunks()
        halves = _halves(digests) if new.num_rows else np.zeros((0, 2), np.uint64)
        hashes = halves[:, 1]
        maybe = kept.contains(hashes) if old.num_rows else np.zeros(len(hashes), bool)
        inserted = np.zeros(len(hashes), bool)
        for a in range(0, len(hashes), CHUNK):
            part = hashes[a : a + CHUNK]
            first = np.zeros(len(part), bool)
            first[np.unique(part, return_index=True)[1]] = True
            fresh = first & ~kept.contains(part)
            kept.insert(part[fresh])
            inserted[a : a + CHUNK] = fresh
        # What the filter took for seen is counted by its digest; the rest stands alone.
        several = np.isin(hashes, hashes[~inserted])
        at = np.flatnonzero(several)
        at = at[np.lexsort((halves[at, 1], halves[at, 0]))]
        edge = np.append(True, (halves[at][1:] != halves[at][:-1]).any(1))[: len(at)]
        heads = np.flatnonzero(edge)
        counts = [new[c].to_numpy() for c in ("n", "first", "last")]
        totals = [f.reduceat(c[at], heads) if len(heads) else c[:0] for f, c in zip((np.add, np.minimum, np.maximum), counts, strict=True)]
        absent = heads[~(np.logical_or.reduceat(inserted[at] | maybe[at], heads) if len(heads) else np.zeros(0, bool))]
        kept.insert(hashes[at[absent]])
        alone = np.flatnonzero(~several)
        picked = np.concatenate((alone, at[heads]))
        out = [digests.take(pa.array(picked)), *(pa.array(np.concatenate((c[alone], t))) for c, t in zip(counts, totals, strict=True)), pa.array(maybe[picked])]
        keys = pa.table([pa.array(np.full(len(picked), shard, np.int32)), *out, pa.nulls(len(picked), pa.binary())], names=["shard", "digest", "n", "first", "last", "maybe", "filter"])
        own = pa.table([pa.array([shard], pa.int32()), *(pa.nulls(1, c.type) for c in out), pa.array([kept.dump()], pa.binary())], names=keys.column_names)
        return pa.concat_tables([keys, own])

    return run


def _changed(add: bool, buckets: int):
    """For a cogroup of digests and a shard's filter: the filter with or without them."""

    def run(keys: pa.Table, old: pa.Table) -> pa.Table:
        kept = cuckoo.Cuckoo.load(old["filter"][0].as_py()) if old.num_rows else cuckoo.Cuckoo(buckets)
        if keys.num_rows:
            hashes = _halves(keys["digest"].combine_chunks())[:, 1]
            (kept.insert if add else kept.remove)(hashes)
        return pa.table({"shard": (keys if keys.num_rows else old)["shard"].slice(0, 1), "filter": pa.array([kept.dump()], pa.binary())})

    return run


def _sharded(keys: DataFrame, shards: int) -> DataFrame:
    """Adds the shard of each digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            shard = (_halves(part.column(0))[:, 0] % np.uint64(shards)).astype(np.int32) if part.num_rows else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(shard), part.column(0)], ["shard", "digest"])

    return keys.select("digest").mapInArrow(run, "shard int, digest binary")


def _refiltered(keys: DataFrame, filters: DataFrame, shards: int, buckets: int, add: bool) -> DataFrame:
    met = _sharded(keys, shards).groupBy("shard").cogroup(filters.groupBy("shard"))
    return durable.stored(met.applyInArrow(_changed(add, buckets), "shard int, filter binary"), "filters")


def insert(docs: DataFrame, index: LineIndex | None = None, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
    """The index with the documents added; without an index a new one."""
    spark = docs.sparkSession
    rows = _rows(docs, id_col, text_col).select("doc", "row", "text")
    holders = durable.stored(rows.mapInArrow(scan.by_slice(_held), "digest binary, doc long, row binary"), "holders")
    if index is None:
        entries = holders.count()
        shards = max(4 * durable.partitions(spark), -(-entries // SHARD_KEYS))
        nothing = [spark.createDataFrame([], s) for s in ("digest binary, doc long, row binary", _COUNTS, "shard int, filter binary")]
        index = LineIndex(shards, cuckoo.buckets_for(-(-entries // shards)), *nothing)
        before = None
    else:
        before = index
    index = _roomy(index, holders if before else None)
    keys = holders.mapInArrow(_summed(index.shards), f"shard int, {_COUNTS}")
    met = keys.groupBy("shard").cogroup(index.filters.groupBy("shard")).applyInArrow(_met(index.buckets), f"shard int, {_COUNTS}, maybe boolean, filter binary")
    met = durable.stored(met, "met")
    filters, found = met.filter("filter IS NOT NULL").select("shard", "filter"), met.filter("filter IS NULL")
    if before is None:
        return replace(index, holders=holders, counts=found.select("digest", "n", "first", "last"), filters=filters)
    looked = found.filter("maybe").select("digest", *(F.col(c).alias(f"new_{c}") for c in ("n", "first", "last")))
    known = durable.stored(index.counts.join(looked.hint("merge"), "digest"), "known")
    merged = known.select("digest", (F.col("n") + F.col("new_n")).alias("n"), F.least("first", "new_first").alias("first"), F.greatest("last", "new_last").alias("last"))
    added = durable.stored(found.join(known.select("digest").hint("merge"), "digest", "left_anti"), "added")
    counts = index.counts.join(known.select("digest").hint("merge"), "digest", "left_anti").unionByName(merged).unionByName(added.select("digest", "n", "first", "last"))
    # Keys that the filter mistook for known ones join it now.
    filters = _refiltered(added.filter("maybe"), filters, index.shards, index.buckets, True)
    return replace(index, holders=index.holders.unionByName(holders), counts=durable.stored(counts, "counts"), filters=filters)


def _roomy(index: LineIndex, coming: DataFrame | None) -> LineIndex:
    """The index with filters of more buckets, built anew from the counts, where the coming keys could fill them."""
    if coming is None:
        return index
    wanted = -(-(index.counts.count() + coming.count()) // index.shards)
    if cuckoo.buckets_for(wanted) <= index.buckets:
        return index
    buckets = cuckoo.buckets_for(2 * wanted)
    return replace(index, buckets=buckets, filters=_refiltered(index.counts, index.filters.limit(0), index.shards, buckets, True))


def delete(index: LineIndex, doc_ids: DataFrame, id_col: str = "doc_id") -> LineIndex:
    """The index without the documents of the given ids; null stands for those without an id."""
    gone_ids = durable.stored(doc_ids.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc")).distinct(), "gone_ids")
    touched = index.holders.join(gone_ids, "doc", "left_semi").select("digest").distinct()
    touched = durable.stored(touched, "touched")
    left = durable.stored(index.holders.join(gone_ids, "doc", "left_anti").select("digest", "doc", "row"), "holders")
    drawn = left.join(touched.hint("merge"), "digest", "left_semi").groupBy("digest").agg(F.count("*").alias("n"), F.min("doc").alias("first"), F.max("doc").alias("last"))
    drawn = durable.stored(drawn, "drawn")
    unheld = touched.join(drawn.hint("merge"), "digest", "left_anti")
    counts = index.counts.join(touched.hint("merge"), "digest", "left_anti").unionByName(drawn)
    return replace(index, holders=left, counts=durable.stored(counts, "counts"), filters=_refiltered(unheld, index.filters, index.shards, index.buckets, False))


def _cut(part: pa.RecordBatch) -> pa.RecordBatch:
    data, at = scan.flat(part.column(1))
    raw, texts, n_lines, n_dropped = data.tobytes(), [], [], []
    for a, b, drops in zip(at[:-1].tolist(), at[1:].tolist(), part.column(2).to_pylist(), strict=True):
        text = raw[a:b]
        n_lines.append(text.count(b"\n") + 1)
        if drops is None:
            n_dropped.append(0)
            texts.append(text)
            continue
        drops = set(drops)
        kept = [line for line in text.split(b"\n") if _digest(line) not in drops]
        n_dropped.append(n_lines[-1] - len(kept))
        texts.append(b"\n".join(kept))
    return pa.RecordBatch.from_arrays([part.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_text"])


def clean(docs: DataFrame, index: LineIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text of every row: lines go whose key a smaller document of the index holds."""
    repeated = durable.stored(index.counts.filter("first < last"), "repeated")
    total = repeated.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") > total / HOT_SHARE
    frequent = index.holders.join(F.broadcast(repeated.filter(hot).select("digest", "first")), "digest")
    rare = index.holders.join(repeated.filter(~hot).select("digest", "first").hint("merge"), "digest")
    drops = frequent.unionByName(rare).filter("doc > first").groupBy("row").agg(F.collect_set("digest").alias("drops"))
    drops = durable.stored(drops, "drops")
    rows = _rows(docs, id_col, text_col).join(drops.hint("merge"), "row", "left").select("doc_id", "text", "drops")
    return rows.mapInArrow(scan.by_slice(_cut), "doc_id long, n_lines long, n_dropped long, kept_text string")


def oracle_sql() -> str:
    """The rows of op11_line_dedup in DuckDB's SQL."""
    space = " || ".join(f"chr({k})" for k in (32, 9, 10, 11, 12, 13))
    key = f"translate(trim(line, {space}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
        WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS all_lines FROM documents),
        numbered AS (SELECT doc_id, unnest(all_lines) AS line, generate_subscripts(all_lines, 1) AS pos FROM split),
        keyed AS (SELECT *, {key} AS key FROM numbered),
        repeated AS (SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING min(doc_id) < max(doc_id)),
        judged AS (SELECT keyed.*, coalesce(doc_id > first, false) AS dropped FROM keyed LEFT JOIN repeated USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
        FROM judged GROUP BY doc_id"""
