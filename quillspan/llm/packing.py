"""Best-fit packing of documents into sequences of fixed capacity.

Each task cuts its documents into pieces and packs them best-fit, longest first. Nearly full bins are done; the
others become items of the next round, in which fewer tasks pack whole bins together, and so on as a tree, until
one task of bounded size has packed what is left. When what is left is too much for one task (pieces that fit
nowhere), the last round keeps several, and bins stay as they are.

Defined cases: a null or empty text is one piece that holds the end id alone; repeated rows are packed each; equal
lengths are taken in order of id and piece; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, durable, scan

CAPACITY = 2048
SLACK = 8
POOL_PIECES = 100_000
ROUND_BYTES = 64 << 20
_FIELDS = ("doc_id", "piece", "start", "length", "ids_crc32", "known")
_BINS = "closed boolean, fill int, members binary"


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of a document's pieces: whole when it fits, else the first takes what is left over."""
    if length <= capacity:
        return [(0, length)]
    first = length % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, length, capacity))]


def pieces(encoder: bpe.Encoder, part: pa.RecordBatch, capacity: int, end_id: int) -> np.ndarray:
    """A row of _FIELDS for each piece of the slice's documents."""
    ids, at = encoder.encode(part.column(1))
    raw, tail = memoryview(np.ascontiguousarray(ids).view(np.uint8)), np.array([end_id], "<u4").tobytes()
    rows = []
    for doc, a, b in zip(part.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
        n = b - a + 1
        for k, (start, length) in enumerate(cut(n, capacity)):
            stop = start + length
            crc = zlib.crc32(raw[4 * (a + start) : 4 * min(b, a + stop)])
            if stop == n:
                crc = zlib.crc32(tail, crc)
            rows.append((doc if doc is not None else 0, k, start, length, crc, doc is not None))
    return np.array(rows, np.int64).reshape(-1, len(_FIELDS))


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Items of each bin: every item, longest first, goes where it leaves the least room.

    Bins are stacked by the room they have; one integer holds a bit for every room that some bin has."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for item in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[item])
        fitting = rooms >> size
        if size < capacity and fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
            bins[at].append(item)
            room -= size
        else:
            at, room = len(bins), capacity - size
            bins.append([item])
        if room > 0:
            if not by_room[room]:
                rooms |= 1 << room
            by_room[room].append(at)
    return bins


def _batch(closed: list[bool], fill: list[int], members: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(closed, pa.bool_()), pa.array(fill, pa.int32()), pa.array(members, pa.binary())], ["closed", "fill", "members"])


def _packed_pieces(rows: np.ndarray, capacity: int, slack: int) -> Iterator[pa.RecordBatch]:
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    for part in scan.chunked(best_fit(rows[:, 3], capacity), 5000):
        fills = [int(rows[x, 3].sum()) for x in part]
        yield _batch([f >= capacity - slack for f in fills], fills, [rows[x].tobytes() for x in part])


def _first_round(shared: bpe.Shared, capacity: int, end_id: int, slack: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool, held = [], 0
        for part in scan.slices(batches, "text"):
            pool.append(pieces(shared.get(), part, capacity, end_id))
            held += len(pool[-1])
            if held >= POOL_PIECES:
                yield from _packed_pieces(np.concatenate(pool), capacity, slack)
                pool, held = [], 0
        if held:
            yield from _packed_pieces(np.concatenate(pool), capacity, slack)

    return run


def _later_round(capacity: int, slack: int, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fills, members = [], []
        for part in batches:
            fills += part.column(0).to_pylist()
            members += part.column(1).to_pylist()
        order = sorted(range(len(fills)), key=lambda k: (-fills[k], members[k]))
        fills, members = [fills[k] for k in order], [members[k] for k in order]
        for part in scan.chunked(best_fit(np.array(fills, np.int64), capacity), 5000):
            sums = [sum(fills[k] for k in x) for x in part]
            yield _batch([last or s >= capacity - slack for s in sums], sums, [b"".join(members[k] for k in x) for x in part])

    return run


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    for part in batches:
        counts = [len(m) // (8 * len(_FIELDS)) for m in part.column(1).to_pylist()]
        rows = np.frombuffer(b"".join(part.column(1).to_pylist()), np.int64).reshape(-1, len(_FIELDS))
        sequence = np.repeat(np.array(part.column(0).to_pylist(), np.int64), counts)
        ends = np.cumsum(rows[:, 3])
        firsts = np.concatenate(([0], np.cumsum(counts)[:-1])).astype(np.int64)
        base = (ends - rows[:, 3])[firsts] if len(rows) else np.zeros(0, np.int64)
        offset = ends - rows[:, 3] - np.repeat(base, counts)
        doc = pa.array(rows[:, 0], mask=rows[:, 5] == 0)
        yield pa.RecordBatch.from_arrays([doc, pa.array(rows[:, 1].astype(np.int32)), *(pa.array(rows[:, k]) for k in (2, 3, 4)), pa.array(sequence), pa.array(offset)], names)


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = 0, slack: int = SLACK, fan_in: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id and its offset there.

    slack: a bin with no more room than this is done. fan_in: how many tasks' bins meet in one task of the next round."""
    shared = bpe.Shared(docs.sparkSession, vocabulary, library=True)
    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    tasks = max(1, kept.rdd.getNumPartitions())
    bins = durable.stored(kept.mapInArrow(_first_round(shared, capacity, end_id, slack), _BINS), "bins")
    done = [bins.filter("closed")]
    while True:
        left = bins.filter("not closed").select("fill", "members")
        held = left.agg(F.coalesce(F.sum(F.length("members") + 64), F.lit(0)).alias("b")).first()["b"]
        if not held:
            break
        fewest = -(-held // ROUND_BYTES)
        last = tasks <= fan_in or tasks <= fewest
        tasks = int(max(fewest, -(-tasks // fan_in)))
        packed = left.repartition(tasks, F.xxhash64("members")).mapInArrow(_later_round(capacity, slack, last), _BINS)
        bins = durable.stored(packed, "bins")
        done.append(bins.filter("closed"))
        if last:
            break
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    out = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return every.select(F.monotonically_increasing_id().alias("sequence_id"), "members").mapInArrow(_unpack, out)
