"""Near-duplicate vectors by Euclidean p-stable hashing and exact cosine checks.

Equal vectors are one class first. Class vectors are normalised and projected on Gaussian directions; projections
are shifted, divided by a width and rounded down, and a few of them together name a bucket of one table. Vectors
that meet in a bucket are compared exactly, as blocks of a matrix product in double precision; a pair counts in the
first table in which it meets. The number of directions follows the number of classes (so that chance meetings stay
few), the number of tables follows from it and the wanted recall at the threshold.

Large buckets are dealt out as pairs of chunks. A task reports link counts of its vectors and a spanning forest of
their links, never pairs.

Defined cases: vectors that are null, zero, empty, or hold null or non-finite components link with nothing; vectors
of different length never link; repeated rows are members of one class; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import durable, graph

WIDTH = 2.0
CHANCE_MEETINGS = 8
RECALL = 0.98
CHUNK = 256
LARGEST_CHUNK = 4096
SEED = 20_240_229


def meeting_chance(distance: float, width: float = WIDTH) -> float:
    """The chance that one quantised projection is the same for two vectors at this distance."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(n: int, cosine: float) -> tuple[int, int]:
    """Directions of a bucket name, and tables: for n vectors and the wanted recall of pairs at the threshold."""
    near, far = meeting_chance(math.sqrt(2 - 2 * cosine)), meeting_chance(math.sqrt(2))
    directions = max(4, math.ceil(math.log(max(2, n / CHANCE_MEETINGS)) / -math.log(far)))
    tables = math.ceil(math.log(1 - RECALL) / math.log(1 - near**directions))
    return directions, tables


def bucket_names(vectors: np.ndarray, directions: int, tables: int) -> np.ndarray:
    """Bucket of each unit vector in each table, as 64-bit names."""
    rng = np.random.default_rng([SEED, vectors.shape[1]])
    axes = rng.standard_normal((vectors.shape[1], directions * tables))
    shift = rng.uniform(0, WIDTH, directions * tables)
    cells = np.floor((vectors @ axes + shift) / WIDTH).astype(np.int64).reshape(len(vectors), tables, directions)
    factors = rng.integers(1, 1 << 62, directions, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    h = (cells.astype(np.uint64) * factors).sum(2, dtype=np.uint64) + np.uint64(vectors.shape[1])
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(29))).view(np.int64)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: a number for each row, and of vectors that can link their bytes and a digest of these."""
    row = TaskContext.get().partitionId() << 33
    for part in batches:
        blobs, digests = [], []
        for x in part.column(1).to_pylist():
            v = np.array(x, np.float64) if x else np.zeros(0)
            usable = len(v) and np.isfinite(v).all() and v.any()
            blobs.append((v + 0.0).tobytes() if usable else None)
            digests.append(hashlib.blake2b(blobs[-1], digest_size=16).digest() if usable else None)
        rows = pa.array(np.arange(row, row + part.num_rows))
        row += part.num_rows
        yield pa.RecordBatch.from_arrays([rows, part.column(0), pa.array(digests, pa.binary()), pa.array(blobs, pa.binary())], ["row", "vec_id", "digest", "vector"])


def _unit(blobs: list[bytes]) -> np.ndarray:
    v = np.frombuffer(b"".join(blobs), np.float64).reshape(len(blobs), -1)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _names(directions: int, tables: int):
    """For mapInArrow over (node, n, vector): adds the names of the vector's bucket in each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (b.slice(k, 256) for b in batches for k in range(0, b.num_rows, 256)):
            blobs = part.column(2).to_pylist()
            for size in sorted({len(b) for b in blobs}):
                at = [k for k, b in enumerate(blobs) if len(b) == size]
                names = bucket_names(_unit([blobs[k] for k in at]), directions, tables)
                yield pa.RecordBatch.from_arrays([*part.take(pa.array(at)).columns, pa.array(list(names), pa.list_(pa.int64()))], ["node", "n", "vector", "names"])

    return run


def _compare(cosine: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("table", "ascending"), ("name", "ascending"), ("chunk", "ascending"), ("node", "ascending")])
        number, name, chunk = (table[c].to_numpy() for c in ("table", "name", "chunk"))
        nodes, n = table["node"].to_numpy(), table["n"].to_numpy()
        blobs = table["vector"].to_pylist()
        names = table["names"].combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
        edge = np.flatnonzero((name[1:] != name[:-1]) | (number[1:] != number[:-1])) + 1
        out_node, out_links, out_other = [], [], []
        for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(name)], strict=True):
            if b - a < 2 or len({len(x) for x in blobs[a:b]}) > 1:
                continue
            unit = _unit(blobs[a:b])
            cos = unit @ unit.T
            if chunk[a] == chunk[b - 1]:
                near = np.triu(cos >= cosine, 1)
            else:
                cut = int(np.searchsorted(chunk[a:b], chunk[b - 1]))
                near = np.zeros(cos.shape, bool)
                near[:cut, cut:] = cos[:cut, cut:] >= cosine
            i, j = np.nonzero(near)
            if t := int(number[a]):
                keys = names[a:b, :t]
                fresh = np.concatenate([~(keys[i[k : k + 8192]] == keys[j[k : k + 8192]]).any(1) for k in range(0, max(1, len(i)), 8192)])
                i, j = i[fresh], j[fresh]
            if not len(i):
                continue
            size = b - a
            links = np.bincount(i, n[a + j], size) + np.bincount(j, n[a + i], size)
            some = np.flatnonzero(links)
            out_node += nodes[a + some].tolist()
            out_links += links[some].astype(np.int64).tolist()
            out_other += [None] * len(some)
            root = np.arange(size)
            for x, y in zip(i.tolist(), j.tolist(), strict=True):
                p, q = root[x], root[y]
                if p != q:
                    root[root == max(p, q)] = min(p, q)
                    out_node.append(int(nodes[a + x]))
                    out_links.append(0)
                    out_other.append(int(nodes[a + y]))
        return pa.table({"node": pa.array(out_node, pa.int64()), "links": pa.array(out_links, pa.int64()), "other": pa.array(out_other, pa.int64())})

    return run


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id (smallest id reachable by links), kept (the id is its component's) of every row."""
    spark = vectors.sparkSession
    kept = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = durable.stored(kept.mapInArrow(_rows, "row long, vec_id long, digest binary, vector binary"), "rows")
    usable = rows.filter("digest IS NOT NULL")
    classes = usable.groupBy("digest").agg(F.min("row").alias("node"), F.min("vec_id").alias("least"), F.count("*").alias("n"))
    classes = durable.stored(classes, "classes")
    reps = durable.stored(classes.join(rows.select(F.col("row").alias("node"), "vector"), "node").select("node", "n", "vector"), "reps")
    directions, tables = plan(reps.count(), cosine)
    # Only names of buckets are dealt out; a vector follows to the buckets where it meets another one.
    reps = durable.stored(reps.mapInArrow(_names(directions, tables), "node long, n long, vector binary, names array<long>"), "bucketed")
    entries = reps.select("node", F.posexplode("names").alias("table", "name"))
    chunks = F.ceil(F.col("size") / F.least(F.greatest(F.col("size") / 16, F.lit(CHUNK)), F.lit(LARGEST_CHUNK))).cast("int")
    sized = entries.groupBy("table", "name").agg(F.count("*").alias("size")).filter("size > 1").select("table", "name", chunks.alias("chunks"))
    met = entries.join(durable.stored(sized, "sized").hint("merge"), ["table", "name"]).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    met = met.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    low, high = F.least("chunk", "with"), F.greatest("chunk", "with")
    task = F.when(F.col("chunks") == 1, F.pmod(F.xxhash64("table", "name"), F.lit(durable.partitions(spark) * 8))).otherwise(F.xxhash64("table", "name", low, high))
    dealt = met.select("table", "name", "chunk", "node", task.alias("task")).join(reps.hint("merge"), "node")
    found = durable.stored(dealt.groupBy("task").applyInArrow(_compare(cosine), "node long, links long, other long"), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = graph.components(found.filter("other IS NOT NULL").select(F.col("node").alias("src"), F.col("other").alias("dst")))
    named = classes.join(links, "node", "left").join(parts, "node", "left")
    named = durable.stored(named.select("digest", "least", "n", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "node").alias("component")), "named")
    least = durable.stored(named.groupBy("component").agg(F.min("least").alias("component_id")), "least")
    by_class = durable.stored(named.join(least, "component").select("digest", (F.col("n") - 1 + F.col("links")).alias("n_links"), "component_id"), "by_class")
    joined = rows.select("vec_id", "digest").join(by_class, "digest", "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
