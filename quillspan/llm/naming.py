"""Exact duplicates by deterministic block naming.

Normalised texts (A-Z lower-cased) are cut into blocks of fixed size. Blocks are sorted and numbered, so that equal
blocks, and only those, have the same integer name. Then adjacent names are paired, the distinct pairs are numbered
in turn, and so on until each text has one name. Texts are equal exactly when their block counts and names are;
no hash decides anything.

Each task sends each distinct block once with the list of places where it stands, so a text that fills a third of
the table is sent a few times only. Numbering streams over sorted blocks and holds none of them; the pairs' joins
are sort-merge joins that Spark can split where a pair is frequent. Every round is a table in the shared folder.

Defined cases: null texts equal empty ones; of rows with the same text and the same largest id exactly one is kept;
null ids lose to all others; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import durable, scan

BLOCK_BYTES = 4096
HELD_BYTES = 32 << 20
_PLACE = np.dtype([("row", "<i8"), ("doc", "<i8"), ("pos", "<i4"), ("blocks", "<i4"), ("known", "<i1"), ("sha", "V32")])


def _blocks(size: int):
    """For mapInArrow: each distinct block of some tens of megabytes of text, with the places where it stands."""

    def emit(found: dict[bytes, list]) -> Iterator[pa.RecordBatch]:
        for keys in scan.chunked(list(found), 2000):
            places = [np.array(found[k], _PLACE).tobytes() for k in keys]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(places, pa.binary())], ["block", "places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, held, found = TaskContext.get().partitionId() << 33, 0, {}
        for part in scan.slices(batches, "text"):
            data, at = scan.flat(part.column(1))
            raw = scan.lowered(data).tobytes()
            for doc, a, b in zip(part.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                text = raw[a:b]
                n = max(1, -(-len(text) // size))
                sha = hashlib.sha256(text).digest()
                for k in range(n):
                    block = text[k * size : (k + 1) * size]
                    places = found.get(block)
                    if places is None:
                        places = found[block] = []
                        held += len(block)
                    held += 100
                    places.append((row, doc if doc is not None else 0, k, n, doc is not None, sha if k == 0 else b""))
                row += 1
            if held > HELD_BYTES:
                yield from emit(found)
                held, found = 0, {}
        yield from emit(found)

    return run


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over sorted blocks: equal neighbours get the same number, and the places their block's."""
    name, last = (TaskContext.get().partitionId() << 40) - 1, None
    for part in batches:
        keys, blobs = part.column(0).to_pylist(), part.column(1).to_pylist()
        names = np.empty(len(keys), np.int64)
        for k, key in enumerate(keys):
            if key != last:
                name, last = name + 1, key
            names[k] = name
        sizes = [len(b) // _PLACE.itemsize for b in blobs]
        places = np.frombuffer(b"".join(blobs), _PLACE)
        first = places["pos"] == 0
        shas = pa.array([bytes(s).hex() if f else None for s, f in zip(places["sha"], first.tolist(), strict=True)], pa.string())
        doc = pa.array(places["doc"], mask=places["known"] == 0)
        columns = [pa.array(places["row"]), doc, pa.array(places["pos"]), pa.array(places["blocks"]), shas, pa.array(np.repeat(names, sizes))]
        yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "pos", "blocks", "text_sha256", "name"])


def _numbered(pairs: DataFrame) -> DataFrame:
    """Sorts distinct pairs and numbers them."""
    return pairs.select("a", "b").distinct().sortWithinPartitions("a", "b").withColumn("name", F.monotonically_increasing_id())


def identities(docs: DataFrame, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, doc_id, text_sha256, blocks, name: the last two together are the identity of a row's text."""
    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    blocks = kept.mapInArrow(_blocks(block_bytes), "block binary, places binary")
    sorted_blocks = blocks.repartition(durable.partitions(docs.sparkSession), F.xxhash64("block")).sortWithinPartitions("block")
    schema = "row long, doc_id long, pos int, blocks int, text_sha256 string, name long"
    named = durable.stored(sorted_blocks.mapInArrow(_number, schema), "names")
    level = named.filter("blocks > 1").select("row", "pos", "name")
    left = named.agg(F.coalesce(F.max("blocks"), F.lit(1)).alias("n")).first()["n"]
    while left > 1:
        even = F.col("pos") % 2 == 0
        pairs = level.groupBy("row", F.shiftright("pos", 1).alias("pos")).agg(
            F.max(F.when(even, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("b")
        )
        pairs = durable.stored(pairs, "pairs")
        level = durable.stored(pairs.join(durable.stored(_numbered(pairs), "numbers"), ["a", "b"]).select("row", "pos", "name"), "level")
        left = -(-left // 2)
    last = level.select("row", F.col("name").alias("joined"))
    firsts = named.filter("pos = 0").join(last, "row", "left")
    return durable.stored(firsts.select("row", "doc_id", "text_sha256", "blocks", F.coalesce("joined", "name").alias("name")), "identities")


def exact_groups(docs: DataFrame, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row: of equal texts the largest id is kept."""
    rows = identities(docs, block_bytes, id_col, text_col)
    groups = rows.groupBy("blocks", "name").agg(F.max(F.struct("doc_id", "row")).alias("best"), F.count("*").alias("group_size"))
    groups = durable.stored(groups, "groups")
    joined = rows.join(groups, ["blocks", "name"])
    return joined.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "text_sha256")


def without_copies(docs: DataFrame, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_groups keeps, with all their columns; of wholly repeated rows one stays."""
    known, kept_id, text = _unused(docs, "known", "kept_id", "kept_text")
    kept = exact_groups(docs, block_bytes, id_col, text_col).filter("kept").select(F.col("doc_id").alias(kept_id), F.col("text_sha256").alias(text))
    normal = F.translate(F.coalesce(F.col(text_col), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    rows = docs.withColumn(known, F.sha2(normal, 256))
    same = F.col(id_col).cast("long").eqNullSafe(F.col(kept_id)) & (F.col(known) == F.col(text))
    (again,) = _unused(rows, "again")
    once = Window.partitionBy(known, id_col).orderBy(id_col)
    rows = rows.join(durable.stored(kept, "kept").hint("merge"), same, "left_semi").withColumn(again, F.row_number().over(once))
    return rows.filter(F.col(again) == 1).drop(again, known)


def _unused(docs: DataFrame, *names: str) -> list[str]:
    """Names of helper columns that docs doesn't use."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        out.append(name)
    return out
