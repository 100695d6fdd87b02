"""Columns that follow from few others, computed once for each distinct value of a batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..functions import intervals as I


def once(rows: DataFrame, by: list[str], made: dict[str, Column]) -> DataFrame:
    """rows with the columns of `made`, which follow from the columns `by` alone; equal nulls count as equal.

    The rows of some Arrow batches are folded by `by`, the columns are made where a value stands once, and the rows come
    out again in another order. Nothing is shuffled, and no more is held than I.gathered() takes together."""
    others = [c for c in rows.columns if c not in by]
    fields = StructType([rows.schema[c] for c in others])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in I.gathered(batches):
            code = np.zeros(part.num_rows, np.int64)
            for c in by:
                one = part[c].dictionary_encode(null_encoding="encode")
                _, code = np.unique(code * len(one.dictionary) + one.indices.to_numpy(), return_inverse=True)
            _, first, many = np.unique(code, return_index=True, return_counts=True)
            order = pa.array(np.argsort(code, kind="stable"))
            columns = [part[c].take(order) for c in others]
            folded = pa.StructArray.from_arrays(columns, fields=[part.schema.field(c) for c in others])
            offsets = pa.array(np.concatenate(([0], np.cumsum(many))).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*(part[c].take(pa.array(first)) for c in by), pa.ListArray.from_arrays(offsets, folded)], [*by, "_rows"])

    each = rows.mapInArrow(run, StructType([rows.schema[c] for c in by]).add("_rows", ArrayType(fields)))
    found = each.select(*by, *(c.alias(name) for name, c in made.items()), "_rows")  # names of fields are lost beside a generator
    return found.select(*by, *made, F.explode("_rows").alias("_r")).select(*(c if c in by else F.col(f"_r.`{c}`").alias(c) for c in rows.columns), *made)
