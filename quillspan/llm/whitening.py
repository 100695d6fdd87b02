"""Whitening of embeddings: exact means, a two-pass covariance, and projection on its leading eigenvectors.

Entries become integers, so that sums don't depend on the order of rows. The fit list holds each distinct integer vector
once; vectors are packed in the smallest integers that hold them, and distinct ones are found by Spark's pre-aggregated
distinct. A first pass adds up the vectors as integers and gives the exact mean. The second pass centres
vectors and adds up their outer products, a block of rows at a time as one matrix product. Partitions hand over one
matrix each, and treeAggregate merges them on executors, so that the driver gets a few. LAPACK's symmetric eigh gives
the eigenvectors; their matrix (dimensions by 4) is broadcast, and every row is projected where it lies. A last pass
over the fit list measures how far the covariance of whitened vectors is from the identity.

Defined cases: rows are dropped whose vector is null or holds null or non-finite entries or entries whose integer
exceeds 63 bits; vectors of another length than the most frequent one (of several the longest) are dropped too, since
they have no place in the covariance; eigenvalues that are zero within rounding give a null `whitened`; without variance
`explained` is null too; a deviation beyond 63 bits is null; fewer than four dimensions give as many components; repeated
rows are returned each; null ids stay null; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import durable

SCALE = 256
COMPONENTS = 4
BLOCK_ROWS = 1024
LONGEST = 1 << 63
_SIZES = (np.int8, np.int16, np.int32, np.int64)


@dataclass(frozen=True)
class Whitening:
    n: int
    total: list[int]
    values: np.ndarray
    axes: np.ndarray
    trace: float
    error: float | None

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.total])

    @property
    def scaled(self) -> np.ndarray:
        """Axes over the roots of their eigenvalues; columns of vanishing ones are not finite."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.values > 0, self.axes / np.sqrt(self.values), np.nan)


def _blocks(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Usable vectors as integers, by length: which rows, and their matrix."""
    sizes = np.diff(vectors.offsets.to_numpy())
    values = vectors.flatten()
    flat = values.fill_null(np.nan).to_numpy(zero_copy_only=False).astype(np.float64)
    known = vectors.is_valid().to_numpy(zero_copy_only=False)
    starts = np.cumsum(np.where(known, sizes, 0)) - np.where(known, sizes, 0)
    for size in np.unique(sizes[known]).tolist():
        at = np.flatnonzero(known & (sizes == size))
        x = np.floor(SCALE * flat[starts[at][:, None] + np.arange(size)])
        usable = (np.isfinite(x) & (x < LONGEST) & (x >= -LONGEST)).all(1)
        yield at[usable], x[usable].astype(np.int64)


def _packed(x: np.ndarray) -> list[bytes]:
    """Rows as bytes of the smallest integer type that holds them; the first byte names the type."""
    most = np.maximum(x.max(1), ~x.min(1)) if x.shape[1] else np.zeros(len(x), np.int64)
    kinds = np.searchsorted([np.iinfo(t).max for t in _SIZES], most)
    return [bytes([k]) + row.astype(_SIZES[k]).tobytes() for k, row in zip(kinds.tolist(), x, strict=True)]


def _unpacked(blobs: pa.Array) -> Iterator[np.ndarray]:
    """Blocks of integer vectors; all are of one length."""
    found = blobs.to_pylist()
    for kind, type_ in enumerate(_SIZES):
        own = [b[1:] for b in found if b[0] == kind]
        for k in range(0, len(own), BLOCK_ROWS):
            some = own[k : k + BLOCK_ROWS]
            yield np.frombuffer(b"".join(some), type_).reshape(len(some), -1).astype(np.int64)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in (b.slice(k, BLOCK_ROWS) for b in batches for k in range(0, b.num_rows, BLOCK_ROWS)):
        for _, x in _blocks(part.column(0)):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), x.shape[1], np.int32)), pa.array(_packed(x), pa.binary())], ["size", "packed"])


def _merged(fit: DataFrame, part_sum, zero):
    """Adds up over the fit list: part_sum of each block within a partition, then treeAggregate over partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        total = zero
        for part in batches:
            for x in _unpacked(part.column(0)):
                total = total + part_sum(x)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], ["part"])

    def add(total, row):
        import pickle

        return total + pickle.loads(row[0])

    parts = fit.select("packed").mapInArrow(run, "part binary")
    return parts.rdd.treeAggregate(zero, add, lambda a, b: a + b, depth=2)


def _integer_sums(x: np.ndarray) -> np.ndarray:
    """The column sums of a block as Python integers, which don't overflow, and the number of rows after them."""
    high, low = x >> 32, x & 0xFFFFFFFF
    sums = [(int(h) << 32) + int(v) for h, v in zip(high.sum(0), low.sum(0), strict=True)]
    return np.array([*sums, len(x)], object)


def fit(vectors: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct vectors; none without a usable one."""
    packed = vectors.select(F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(_pack, "size int, packed binary")
    distinct = durable.stored(packed.distinct(), "distinct_vectors")
    common = distinct.groupBy("size").count().orderBy(F.desc("count"), F.desc("size")).first()
    if common is None or common["size"] == 0:
        return None
    size = common["size"]
    kept = distinct.filter(F.col("size") == size)
    *total, n = _merged(kept, _integer_sums, np.array([0] * (size + 1), object)).tolist()
    mean = np.array([s / n for s in total])

    def outer(x: np.ndarray) -> np.ndarray:
        centred = x - mean
        return centred.T @ centred

    covariance = _merged(kept, outer, np.zeros((size, size))) / n
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    trace = float(np.trace(covariance))
    values = np.where(values > trace * size * np.finfo(float).eps, values, 0.0)
    signs = np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])
    found = Whitening(n, total, values, axes * np.where(signs == 0, 1.0, signs), trace, None)
    some = int((values > 0).sum())
    if not some:
        return found
    scaled = found.scaled[:, :some]

    def moments(x: np.ndarray) -> np.ndarray:
        white = (x - mean) @ scaled
        return np.concatenate((white.T @ white, white.sum(0)[None]))

    sums = _merged(kept, moments, np.zeros((some + 1, some))) / n
    error = float(np.abs(sums[:-1] - np.outer(sums[-1], sums[-1]) - np.eye(some)).max())
    return Whitening(n, total, values, found.axes, trace, error)


def _deviations(x: np.ndarray, n: int, total: list[int]) -> list[int | None]:
    """The sum of (n * x - S) ** 2 of each row, none where it exceeds 63 bits."""
    most = n * max(int(x.max()), -int(x.min())) + max(map(abs, total)) if len(x) else 0
    if most * most * x.shape[1] < LONGEST:
        apart = n * x - np.array(total, np.int64)
        return (apart * apart).sum(1).tolist()
    exact = ((n * x.astype(object) - np.array(total, object)) ** 2).sum(1).tolist()
    return [d if d < LONGEST else None for d in exact]


def project(vectors: DataFrame, model: Whitening | None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every usable row and component."""
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for part in (b.slice(k, BLOCK_ROWS) for b in batches for k in range(0, b.num_rows, BLOCK_ROWS)):
            for at, x in _blocks(part.column(1)) if known else ():
                if x.shape[1] != len(known.total):
                    continue
                white = (x - known.mean) @ known.scaled
                many = white.shape[1]
                again = np.repeat(np.arange(len(at)), many)
                shares = known.values / known.trace if known.trace > 0 else np.full(many, np.nan)
                columns = [
                    part.column(0).take(pa.array(at[again])),
                    pa.array(np.tile(np.arange(1, many + 1, dtype=np.int32), len(at))),
                    pa.array(np.full(len(again), known.n)),
                    pa.array(_deviations(x, known.n, known.total), pa.int64()).take(pa.array(again)),
                    pa.array(white.reshape(-1), from_pandas=True),
                    pa.array(np.tile(shares, len(at)), from_pandas=True),
                    pa.array([known.error] * len(again), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kept = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    return kept.mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    return project(vectors, fit(vectors, vector_col, components), id_col, vector_col)
