"""Repeated passages: every byte that a string of fixed length covers which also starts earlier is removed.

Prefix polynomial hashes give the hash of any substring in constant time, and a binary search over them the common
extension of two suffixes; a mergesort that compares suffixes this way brings equal ones together, and bytes are
compared before two are taken as equal.

1. Of each window of 100 bytes the gram with the least hash is its anchor. Equal windows have equal anchors at equal
   places, so only windows with a common anchor gram can be equal. The consecutive windows of one anchor form one
   context; a context is about 35 windows, so the table shrinks by that much.
2. Contexts of a slice whose grams recur there are suffix-sorted; of equal ones the earliest is sent on, the others
   are marked. Over all slices, contexts meet by their gram (in buckets, as packed arrays, each at most once a
   slice): all but the earliest of equal ones are marked whole.
3. Where one gram has several different contexts, they may still share some windows. Only for the earliest of each
   of those, windows are hashed one by one and meet again in the same way.
4. Marks are joined to the texts and cut out.

Across slices, strings are equal when two independent hashes (96 bits) are. Long texts are cut into segments that
overlap by a window, which changes contexts but no result.

Defined cases: null and empty texts have no bytes and lose none; texts shorter than a window lose none; matches
never cross texts; rows that share an id or have none are ordered by id (none first) and text; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import durable, scan

WINDOW = 100
GRAM = 32
SEGMENT = 1 << 20
_BASES = (np.uint64(0x5851F42D4C957F2D), np.uint64(0x2545F4914F6CDD1D))
_C = np.uint64(0x9E3779B97F4A7C15)
_PLACE = np.uint64((1 << 31) - 1)


@functools.cache
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64, for i below size."""
    back = pow(int(base), -1, 1 << 64)
    with np.errstate(over="ignore"):
        return tuple(np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)))) for b in (np.uint64(base), np.uint64(back)))


class Hashes:
    """Prefix polynomial hashes of one byte array, to two bases."""

    def __init__(self, data: np.ndarray):
        self.data = data
        size = 1 << max(16, int(len(data) + 1).bit_length())
        self.back, self.prefix = [], []
        values = data.astype(np.uint64) + np.uint64(1)
        for base in _BASES:
            power, back = _powers(base, size)
            self.back.append(back)
            self.prefix.append(np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * power[: len(data)], dtype=np.uint64))))

    def of(self, start: np.ndarray, size, which: int = 0) -> np.ndarray:
        """The hash of data[start : start + size]."""
        p = self.prefix[which]
        return (p[start + size] - p[start]) * self.back[which][start]

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the common beginning of the suffixes at a and b, at most `most`: binary search over hashes."""
        low, high = np.zeros(len(a), np.int64), most.astype(np.int64).copy()
        while (low < high).any():
            mid = (low + high + 1) >> 1
            same = self.of(a, mid) == self.of(b, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def less(self, a: np.ndarray, size_a: np.ndarray, b: np.ndarray, size_b: np.ndarray) -> np.ndarray:
        """Whether data[a : a + size_a] sorts before data[b : b + size_b]."""
        most = np.minimum(size_a, size_b)
        n = self.common(a, b, most)
        last = len(self.data) - 1
        return np.where(n < most, self.data[np.minimum(a + n, last)] < self.data[np.minimum(b + n, last)], size_a < size_b)

    def sorted(self, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Order of the suffixes at `starts`, cut to `sizes`: a stable bottom-up mergesort.

        In each round all pairs of runs are merged at once; an element's place is its own plus its rank among the
        other run, which a binary search with suffix comparisons finds."""
        n, order, width = len(starts), np.arange(len(starts)), 1
        while width < n:
            at = np.arange(n)
            block = at // width
            left = block % 2 == 0
            low = np.where(left, (block + 1) * width, (block - 1) * width)
            low = np.minimum(low, n)
            first, high = low.copy(), np.minimum(low + width, n)
            mine = order[at]
            while (open_ := np.flatnonzero(low < high)).size:
                mid = (low[open_] + high[open_]) >> 1
                other, own = order[mid], mine[open_]
                ahead = self.less(starts[other], sizes[other], starts[own], sizes[own])
                tie = ~left[open_] & ~ahead
                if tie.any():
                    t = np.flatnonzero(tie)
                    ahead[t] = ~self.less(starts[own[t]], sizes[own[t]], starts[other[t]], sizes[other[t]])
                low[open_], high[open_] = np.where(ahead, mid + 1, low[open_]), np.where(ahead, high[open_], mid)
            base = np.where(left, at, at - width)
            merged = np.empty(n, np.int64)
            merged[base + (low - first)] = mine
            order, width = merged, 2 * width
        return order


def contexts(hashes: Hashes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first window and last window of each context; bounds: where segments begin, and the end."""
    n, span = len(hashes.data), WINDOW - GRAM + 1
    if n < WINDOW:
        return (np.zeros(0, np.int64),) * 3
    at = np.arange(n - GRAM + 1)
    value = (hashes.of(at, GRAM) * _C) & ~_PLACE | at.astype(np.uint64)
    padded = np.concatenate((value, np.full(-len(value) % span + span, ~np.uint64(0)))).reshape(-1, span)
    ahead = np.minimum.accumulate(padded, 1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    windows = n - WINDOW + 1
    least = np.minimum(behind[:windows], ahead[span - 1 : span - 1 + windows])
    anchor = (least & _PLACE).astype(np.int64)
    ends = np.repeat(bounds[1:], np.diff(bounds))[:windows]
    valid = ends - np.arange(windows) >= WINDOW
    differs = anchor[1:] != anchor[:-1]
    first, last = valid.copy(), valid.copy()
    first[1:] &= differs | ~valid[:-1]
    last[:-1] &= differs | ~valid[1:]
    first, last = np.flatnonzero(first), np.flatnonzero(last)
    return anchor[first], first, last


def _equal_classes(hashes: Hashes, starts: np.ndarray, sizes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each string the first one (in the given order) that is equal to it and has the same anchor offset."""
    order = hashes.sorted(starts, sizes)
    a, b = order[:-1], order[1:]
    same = (sizes[a] == sizes[b]) & (offsets[a] == offsets[b])
    same &= hashes.common(starts[a], starts[b], np.where(same, sizes[a], 0)) == sizes[a]
    raw = hashes.data.tobytes()
    for k in np.flatnonzero(same):
        x, y, n = starts[a[k]], starts[b[k]], sizes[a[k]]
        same[k] = raw[x : x + n] == raw[y : y + n]
    group = np.concatenate(([0], np.cumsum(~same)))
    least = np.full(group[-1] + 1, len(starts), np.int64)
    np.minimum.at(least, group, order)
    out = np.empty(len(starts), np.int64)
    out[order] = least[group]
    return out


def segments(keys: list[int], data: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts as segments of bounded size: bytes, bounds, key and place of each segment."""
    parts, sizes, owner, place, held = [], [], [], [], 0
    for key, a, b in zip(keys, at[:-1].tolist(), at[1:].tolist(), strict=True):
        for s in range(a, max(a + 1, b - WINDOW + 1), SEGMENT):
            piece = data[s : min(b, s + SEGMENT + WINDOW - 1)]
            if len(piece) < WINDOW:
                continue
            if held and held + len(piece) > SEGMENT + WINDOW:
                yield np.concatenate(parts), np.cumsum([0, *sizes]), np.array(owner, np.int64), np.array(place, np.int64)
                parts, sizes, owner, place, held = [], [], [], [], 0
            parts.append(piece)
            sizes.append(len(piece))
            owner.append(key)
            place.append(s - a)
            held += len(piece)
    if parts:
        yield np.concatenate(parts), np.cumsum([0, *sizes]), np.array(owner, np.int64), np.array(place, np.int64)


_ENTRY = (("gram", "<u4"), ("hash", "<u8"), ("more", "<u4"), ("step", "<i8"), ("start", "<i4"), ("size", "<u1"))
_SENT = "bucket int, entries binary, marks binary"
_MARK = np.dtype([("key", "<i8"), ("start", "<i4"), ("stop", "<i4")])
_FOUND = "key long, start int, stop int, bucket int"


def _pack(columns: dict[str, np.ndarray]) -> bytes:
    """Column after column; sorted keys as steps, which compress well."""
    keys = columns["key"]
    columns = columns | {"step": np.diff(keys, prepend=np.int64(0))}
    return b"".join(columns[name].astype(kind).tobytes() for name, kind in _ENTRY)


def _unpack(blobs: list[bytes]) -> dict[str, np.ndarray]:
    width = sum(np.dtype(kind).itemsize for _, kind in _ENTRY)
    parts: dict[str, list] = {name: [] for name, _ in _ENTRY}
    for blob in blobs:
        n, at = len(blob) // width, 0
        for name, kind in _ENTRY:
            column = np.frombuffer(blob, kind, n, at)
            parts[name].append(np.cumsum(column) if name == "step" else column)
            at += n * np.dtype(kind).itemsize
    out = {name: np.concatenate(x) if x else np.zeros(0, kind) for (name, kind), x in zip(_ENTRY, parts.values(), strict=True)}
    out["key"] = out.pop("step")
    return out


def _marks(key: np.ndarray, start: np.ndarray, stop: np.ndarray) -> bytes:
    out = np.empty(len(key), _MARK)
    out["key"], out["start"], out["stop"] = key, start, stop
    return out.tobytes()


def _sent(bucket: np.ndarray, columns: dict[str, np.ndarray], marks: bytes, salt: int) -> pa.RecordBatch:
    """A row for each bucket that has entries, and one for what is marked already."""
    order = np.lexsort((columns["start"], columns["key"], bucket))
    bucket, columns = bucket[order], {k: v[order] for k, v in columns.items()}
    cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)] if len(bucket) else [0]
    rows = [(int(bucket[a]), _pack({k: v[a:b] for k, v in columns.items()}), None) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    if marks:
        rows.append((salt, None, marks))
    columns = zip(*rows, strict=True) if rows else ([], [], [])
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["bucket", "entries", "marks"])


def _send_contexts(buckets: int):
    """For mapInArrow over (key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in scan.slices(batches, "text", SEGMENT):
            data, at = scan.flat(part.column(1))
            for raw, bounds, owner, place in segments(part.column(0).to_pylist(), data, at):
                hashes = Hashes(raw)
                anchor, first, last = contexts(hashes, bounds)
                size, offset = last - first + WINDOW, anchor - first
                segment = np.searchsorted(bounds, first, "right") - 1
                key, start = owner[segment], first - bounds[segment] + place[segment]
                rank = np.lexsort((start, key))
                anchor, first, size, offset, key, start = (x[rank] for x in (anchor, first, size, offset, key, start))
                gram = hashes.of(anchor, GRAM) * _C
                _, inverse, counts = np.unique(gram, return_inverse=True, return_counts=True)
                again = np.flatnonzero(counts[inverse] > 1)
                lead = np.arange(len(gram))
                if len(again) > 1:
                    lead[again] = again[_equal_classes(hashes, first[again], size[again], offset[again])]
                keep = lead == np.arange(len(gram))
                marks = _marks(key[~keep], start[~keep], (start + size)[~keep])
                shape = (size.astype(np.uint64) << np.uint64(8) | offset.astype(np.uint64)) * _C
                columns = {"gram": (gram // np.uint64(buckets)).astype(np.uint32), "hash": hashes.of(first, size) ^ shape, "more": ((hashes.of(first, size, 1) ^ shape) * _C) >> np.uint64(32), "key": key, "start": start, "size": size - WINDOW}
                bucket = (gram % np.uint64(buckets)).astype(np.int64)
                yield _sent(bucket[keep], {k: v[keep] for k, v in columns.items()}, marks, int(gram[0] % np.uint64(buckets)) if len(gram) else 0)

    return run


def _passed(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in table["marks"].to_pylist() if x), _MARK)


def _found(marks: list[np.ndarray], asked: dict[str, np.ndarray] | None, bucket: int) -> pa.Table:
    marked = np.concatenate(marks)
    key, start, stop = marked["key"], marked["start"], marked["stop"]
    buckets = pa.nulls(len(key), pa.int32())
    if asked is not None and len(asked["key"]):
        key, start = np.concatenate((key, asked["key"])), np.concatenate((start, asked["start"]))
        stop = np.concatenate((stop, asked["start"] + asked["size"].astype(np.int32) + WINDOW))
        buckets = pa.concat_arrays([buckets, pa.array(np.full(len(asked["key"]), bucket, np.int32))])
    return pa.table({"key": pa.array(key), "start": pa.array(start), "stop": pa.array(stop), "bucket": buckets})


def _meet_contexts(table: pa.Table) -> pa.Table:
    """One bucket: marks all but the earliest of equal contexts; asks for the windows where a gram has several."""
    e = _unpack([x for x in table["entries"].to_pylist() if x])
    order = np.lexsort((e["start"], e["key"], e["more"], e["hash"], e["gram"]))
    e = {k: v[order] for k, v in e.items()}
    gram_first, first = np.ones(len(order), bool), np.ones(len(order), bool)
    gram_first[1:] = e["gram"][1:] != e["gram"][:-1]
    first[1:] = gram_first[1:] | (e["hash"][1:] != e["hash"][:-1]) | (e["more"][1:] != e["more"][:-1])
    again = ~first
    marks = np.frombuffer(_marks(e["key"][again], e["start"][again], e["start"][again] + e["size"][again].astype(np.int32) + WINDOW), _MARK)
    group = np.cumsum(gram_first) - 1
    several = np.bincount(group, first, len(order)) > 1 if len(order) else np.zeros(0, bool)
    chosen = first & several[group] if len(order) else first
    return _found([_passed(table), marks], {k: v[chosen] for k, v in e.items()}, table["bucket"][0].as_py())


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow before a join: the column text as its length and its bytes, compressed; shuffles write less of it."""
    codec = pa.Codec("zstd", 1)
    for part in batches:
        raw = (None if x is None else x.as_buffer() for x in part["text"])
        small = [None if x is None else x.size.to_bytes(4, "little") + codec.compress(x, asbytes=True) for x in raw]
        yield part.set_column(part.schema.get_field_index("text"), "text", pa.array(small, pa.binary()))


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches that _packed took, in parts of bounded size."""
    codec = pa.Codec("zstd")
    for batch in batches:
        sizes = [0 if x is None else int.from_bytes(x[:4], "little") for x in batch["text"].to_pylist()]
        ends, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + scan.SLICE_BYTES, "right")))
            part = batch.slice(at, to - at)
            whole = [None if x is None else codec.decompress(x[4:], n, asbytes=True) for x, n in zip(part["text"].to_pylist(), sizes[at:to], strict=True)]
            yield part.set_column(part.schema.get_field_index("text"), "text", pa.array(whole, pa.binary()))
            at = to


def _send_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (text as _packed gives it, key, asked): the hash of every window of the contexts that were asked for."""
    for part in scan.slices(_unpacked(batches), "text", SEGMENT):
        data, at = scan.flat(part.column(0))
        rows = [(k, a, x["start"], x["stop"], x["bucket"]) for k, a, asked in zip(part.column(1).to_pylist(), at[:-1].tolist(), part.column(2).to_pylist(), strict=True) for x in asked]
        for some in scan.chunked(rows, 6000):
            key, base, start, stop, bucket = (np.array(c, np.int64) for c in zip(*some, strict=True))
            raw = np.concatenate([data[b + s : b + t] for b, s, t in zip(base.tolist(), start.tolist(), stop.tolist(), strict=True)])
            sizes = stop - start
            begin = np.cumsum(sizes) - sizes
            n = sizes - WINDOW + 1
            which = np.repeat(np.arange(len(n)), n)
            step = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            hashes, where = Hashes(raw), begin[which] + step
            own, more = hashes.of(where, WINDOW), (hashes.of(where, WINDOW, 1) * _C) >> np.uint64(32)
            key, start, bucket = key[which], start[which] + step, bucket[which]
            order = np.lexsort((start, key, more, own, bucket))
            own, more, key, start, bucket, where = (x[order] for x in (own, more, key, start, bucket, where))
            first = np.ones(len(own), bool)
            first[1:] = (own[1:] != own[:-1]) | (more[1:] != more[:-1]) | (bucket[1:] != bucket[:-1])
            text = raw.tobytes()
            for k in np.flatnonzero(~first):
                first[k] = text[where[k - 1] : where[k - 1] + WINDOW] != text[where[k] : where[k] + WINDOW]
            marks = _runs(key[~first], start[~first])
            zero = np.zeros(int(first.sum()), np.int64)
            yield _sent(bucket[first], {"gram": zero, "hash": own[first], "more": more[first], "key": key[first], "start": start[first], "size": zero}, marks, int(bucket[0]))


def _runs(key: np.ndarray, start: np.ndarray) -> bytes:
    """Marks of windows; those that start side by side become one."""
    order = np.lexsort((start, key))
    key, start = key[order], start[order]
    first = np.ones(len(key), bool)
    first[1:] = (key[1:] != key[:-1]) | (start[1:] > start[:-1] + WINDOW)
    heads = np.flatnonzero(first)
    ends = np.append(heads[1:], len(key)) - 1 if len(key) else heads
    return _marks(key[heads], start[heads], start[ends] + WINDOW)


def _meet_windows(table: pa.Table) -> pa.Table:
    e = _unpack([x for x in table["entries"].to_pylist() if x])
    order = np.lexsort((e["start"], e["key"], e["more"], e["hash"]))
    e = {k: v[order] for k, v in e.items()}
    again = np.zeros(len(order), bool)
    again[1:] = (e["hash"][1:] == e["hash"][:-1]) & (e["more"][1:] == e["more"][:-1])
    marks = np.frombuffer(_runs(e["key"][again], e["start"][again].astype(np.int64)), _MARK)
    return _found([_passed(table), marks], None, 0)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (doc_id, text, marks): what is left of each text."""
    for part in scan.slices(batches, "text"):
        data, at = scan.flat(part.column(1))
        raw = data.tobytes()
        marks = part.column(2)
        values = marks.flatten()
        start, stop = (values.field(name).to_numpy(zero_copy_only=False) for name in ("start", "stop"))
        counts = np.array([len(x) if x is not None else 0 for x in marks.to_pylist()]) if marks.null_count else np.diff(marks.offsets.to_numpy())
        upto = np.cumsum(counts)
        kept, removed, spans = [], [], []
        for k in range(part.num_rows):
            a, b = int(at[k]), int(at[k + 1])
            pieces, done, runs = [], 0, []
            if counts[k]:
                here = slice(int(upto[k] - counts[k]), int(upto[k]))
                for s, e in sorted(zip(start[here].tolist(), stop[here].tolist(), strict=True)):
                    if runs and s <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], e)
                    else:
                        runs.append([s, e])
            for s, e in runs:
                pieces.append(raw[a + done : a + s])
                done = e
            pieces.append(raw[a + done : b])
            kept.append(b"".join(pieces))
            removed.append(sum(e - s for s, e in runs))
            spans.append([{"start": s, "stop": e} for s, e in runs])
        kinds = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        columns = [part.column(0), pa.array(np.diff(at)), pa.array(removed, pa.int64()), pa.array(spans, kinds), pa.array(kept, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "spans", "kept"])


def _keyed(docs: DataFrame, id_col: str, text_col: str, others: tuple[str, ...] = ()) -> DataFrame:
    """key, doc_id, text and the other columns that are named: keys are the ids where they are unique, else numbers in order of id and text."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *others)
    repeated = rows.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").limit(1).count()
    if not repeated:
        return rows.withColumn("key", F.col("doc_id"))
    ordered = rows.repartitionByRange(durable.partitions(docs.sparkSession), "doc_id", "text").sortWithinPartitions("doc_id", "text")
    return durable.stored(ordered.withColumn("key", F.monotonically_increasing_id()), "keyed")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key, marks (start and stop of bytes to remove, not merged) of every text that has any; see _keyed for keys."""
    return _marked(_keyed(docs, id_col, text_col))


def _marked(rows: DataFrame) -> DataFrame:
    buckets = durable.partitions(rows.sparkSession) * 4
    sent = rows.select("key", "text").mapInArrow(_send_contexts(buckets), _SENT)
    found = durable.stored(sent.groupBy("bucket").applyInArrow(_meet_contexts, _FOUND), "contexts")
    durable.release(rows.sparkSession)
    asked = found.filter("bucket IS NOT NULL").groupBy("key").agg(F.collect_list(F.struct("start", "stop", "bucket")).alias("asked"))
    windows = rows.select("key", "text").mapInArrow(_packed, "key long, text binary").join(asked, "key").select("text", "key", "asked").mapInArrow(_send_windows, _SENT)
    more = durable.stored(windows.groupBy("bucket").applyInArrow(_meet_windows, _FOUND), "windows")
    durable.release(rows.sparkSession)
    marks = found.filter("bucket IS NULL").unionByName(more).groupBy("key")
    return marks.agg(F.collect_list(F.struct("start", "stop")).alias("marks"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (maximal removed runs) and kept (the bytes that are left) of every row."""
    rows = _keyed(docs, id_col, text_col)
    packed = rows.select("key", "doc_id", "text").mapInArrow(_packed, "key long, doc_id long, text binary")
    joined = packed.join(_marked(rows), "key", "left").select("doc_id", "text", "marks")
    schema = "doc_id long, n_bytes long, n_removed long, spans array<struct<start: int, stop: int>>, kept binary"
    return joined.mapInArrow(lambda batches: _cut(_unpacked(batches)), schema)


def cut_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """docs with repeated passages cut out of the texts, and the column of lengths (if there is one) set anew.

    Bytes of characters that a cut leaves incomplete are dropped, so texts stay valid. A null text stays null."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("string")
    def left(texts: pa.Array, marks: pa.Array) -> pa.Array:
        part = pa.RecordBatch.from_arrays([pa.nulls(len(texts), pa.int64()), texts, marks], ["doc_id", "text", "marks"])
        kept = [x for b in _cut(iter([part])) for x in b.column(4).to_pylist()]
        return pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string())

    rest = [c for c in docs.columns if c != text_col]
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    rows = _keyed(row, "_id", "_text", ("_row",))
    joined = rows.join(_marked(rows), "key", "left")
    text = F.when(F.col("marks").isNull(), F.col("text")).otherwise(left(F.col("text"), F.col("marks")))
    joined = joined.select("_row", text.alias("_left"))
    columns = [F.col("_left").alias(c) if c == text_col else F.length("_left").cast(docs.schema[c].dataType).alias(c) if c == length_col else F.col(f"_row.`{c}`").alias(c) for c in docs.columns]
    return joined.select(*columns)
