"""Items of very large JSON array files, read by byte ranges on all executors.

Whether a byte stands inside a string, and how deep, depends on everything before it. So a first pass reads each range
under both assumptions (it begins inside a string, or outside) and reports a few numbers: the parity of its quotes, the
change of depth, and the commas at each relative depth. The rows of a file's ranges, one for each, are composed in order
and give every range its true state and the number of items before it. The second pass reads each range from there and
streams its items; an item belongs to the range in which it begins. Text is never shuffled, no task holds more than a
block and an item, and order and index are those of the file.

Files are listed by Spark and opened by Arrow (local and mounted folders, object stores, HDFS); where only Spark can
open a store, records.load_records() reads whole files instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RANGE_BYTES = 64 << 20
BLOCK_BYTES = 1 << 20
_KINDS = np.zeros(256, np.int8)
_KINDS[[ord(c) for c in "[{"]] = 1
_KINDS[[ord(c) for c in "]}"]] = -1


def _opened(path: str):
    from pyarrow import fs

    where, inner = fs.FileSystem.from_uri(path)
    return where.open_input_file(inner)


class _Scan:
    """Reads bytes from an offset on, block by block: which of them stand outside strings, and their depth."""

    def __init__(self, file, start: int, inside: bool, depth: int):
        self.file, self.at, self.inside, self.depth = file, start, inside, depth
        back = min(start, 1 << 16)
        before = file.read_at(back, start - back)
        self.slashes = len(before) - len(before.rstrip(b"\\"))

    def block(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """The bytes, whether each is outside strings, and the depth behind each; none at the end."""
        raw = self.file.read_at(size, self.at)
        if not raw:
            return None
        data = np.frombuffer(raw, np.uint8)
        places = np.arange(len(data))
        run = places - np.maximum.accumulate(np.where(data != 0x5C, places, -1 - self.slashes))
        escaped = np.append(self.slashes, run[:-1]) % 2 == 1
        quotes = (data == 0x22) & ~escaped
        within = (np.cumsum(quotes) + self.inside) % 2 == 1
        outside = ~within & ~quotes
        depth = self.depth + np.cumsum(np.where(outside, _KINDS[data], 0))
        self.at, self.inside, self.depth, self.slashes = self.at + len(data), bool(within[-1]), int(depth[-1]), int(run[-1])
        return data, outside, depth


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (path, start, end): for both assumptions the change of a range."""
    for part in batches:
        rows = []
        for path, start, end in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True):
            with _opened(path) as file:
                for inside in (False, True):
                    scan, commas = _Scan(file, start, inside, 0), {}
                    while scan.at < end:
                        found = scan.block(min(BLOCK_BYTES, end - scan.at))
                        if found is None:
                            break
                        data, outside, depth = found
                        level, many = np.unique(depth[(data == 0x2C) & outside], return_counts=True)
                        for d, n in zip(level.tolist(), many.tolist(), strict=True):
                            commas[d] = commas.get(d, 0) + n
                    rows.append((path, start, end, inside, scan.inside, scan.depth, list(commas.items())))
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.map_(pa.int64(), pa.int64())]
        names = ["path", "start", "end", "inside", "ends_inside", "deeper", "commas"]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)


def _composed(table: pa.Table) -> pa.Table:
    """For a file: the state in which each range begins, and how many commas between items come before it."""
    rows = {(r["start"], r["inside"]): r for r in table.to_pylist()}
    inside, depth, before, out = False, 0, 0, []
    for start in sorted({s for s, _ in rows}):
        r = rows[start, inside]
        out.append((r["path"], start, r["end"], inside, depth, before))
        before += dict(r["commas"]).get(1 - depth, 0)
        inside, depth = r["ends_inside"], depth + r["deeper"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]
    return pa.table([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["path", "start", "end", "inside", "depth", "before"])


def _items(file, start: int, end: int, inside: bool, depth: int, before: int) -> Iterator[tuple[int, bytes]]:
    """Index and bytes of the items that begin in a range."""
    scan, index, held = _Scan(file, start, inside, depth), before, None
    while True:
        at = scan.at
        found = scan.block(BLOCK_BYTES)
        if found is None:
            break
        data, outside, level = found
        if start == at == 0 and data.tobytes()[:256].strip()[:1] not in (b"[", b""):
            raise ValueError("the file is no JSON array; read it with load_records()")
        opens = outside & (data == 0x5B) & (level == 1)
        cuts = opens | outside & (data == 0x2C) & (level == 1) | outside & (data == 0x5D) & (level == 0)
        last = 0
        for k in np.flatnonzero(cuts).tolist():
            if held is not None:
                yield index, b"".join([*held, data[last:k].tobytes()])
            # An item belongs to the range that holds the sign before it.
            held = [] if at + k < end and data[k] != 0x5D else None
            index += data[k] == 0x2C
            last = k + 1
            if held is None and at + k >= end:
                return
        if held is not None:
            held.append(data[last:].tobytes())
        elif at + len(data) >= end:
            return


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over the composed ranges: their items."""

    def emit(path: str, some: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([path] * len(some), pa.string()), pa.array([int(k) for k, _ in some], pa.int64()), pa.array([t for _, t in some], pa.binary()).cast(pa.string())], ["source_file", "record_index", "value"])

    for part in batches:
        for path, *state in zip(*(part.column(k).to_pylist() for k in range(6)), strict=True):
            some, size = [], 0
            with _opened(path) as file:
                for index, item in _items(file, *state):
                    if item.strip():
                        some.append((index, item))
                        size += len(item)
                    if size > 4 * BLOCK_BYTES:
                        yield emit(path, some)
                        some, size = [], 0
            if some:
                yield emit(path, some)


def array_items(spark: SparkSession, *paths: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """source_file, record_index, value (JSON text) of every item of files that each hold one JSON array.

    Empty arrays and files have no items; an item may be any JSON value; white space around items stays in their text;
    what follows the array is not read. A file must be well-formed: of a cut one the items before the cut are returned."""
    files = spark.read.format("binaryFile").load(list(paths)).select("path", "length").filter("length > 0")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))).alias("start")
    ranges = files.select("path", "length", starts).select("path", "start", F.least(F.col("start") + range_bytes, F.col("length")).alias("end"))
    dealt = ranges.repartition(spark.sparkContext.defaultParallelism, "path", "start")
    found = dealt.mapInArrow(_summaries, "path string, start long, end long, inside boolean, ends_inside boolean, deeper long, commas map<long,long>")
    states = found.groupBy("path").applyInArrow(_composed, "path string, start long, end long, inside boolean, depth long, before long")
    again = states.repartition(spark.sparkContext.defaultParallelism, "path", "start")
    return again.mapInArrow(_read, "source_file string, record_index long, value string")


def load_array_records(spark: SparkSession, *paths: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """source_file, record_index, record (variant), as records.load_records() gives them for array files of any size."""
    rows = array_items(spark, *paths, range_bytes=range_bytes)
    return rows.select("source_file", "record_index", F.parse_json("value").alias("record"))
