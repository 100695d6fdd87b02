"""Byte-pair encoding and decoding of whole texts.

Merging runs over a doubly linked symbol list with a priority queue of merge ranks; entries that no longer match
their place are skipped. Decoding concatenates vocabulary strings. Results equal the tokenizers library's for the
same file. The operator reads each text once, shuffles nothing, and keeps a slice of a few megabytes at a time.

Defined cases: null and empty texts have no ids, an empty id list and an empty decoded text; repeated rows are
encoded each; an empty table gives an empty result; columns other than the two named ones are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, scan


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids: the token ids of every text. vocabulary: path of a file of the tokenizers library."""
    shared = bpe.Shared(docs.sparkSession, vocabulary)

    def make(part: pa.RecordBatch) -> pa.RecordBatch:
        ids, at = shared.get().encode(part.column(1))
        lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))
        return pa.RecordBatch.from_arrays([part.column(0), lists], ["doc_id", "ids"])

    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return kept.mapInArrow(scan.by_slice(make), "doc_id long, ids array<int>")


def encode_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_text (decimal ids joined by one blank) and decoded: the round trip of every text."""
    shared = bpe.Shared(docs.sparkSession, vocabulary)

    def make(part: pa.RecordBatch) -> pa.RecordBatch:
        n, ids, decoded = shared.get().shown(part.column(1))
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.binary()).cast(pa.string()), pa.array(decoded, pa.binary()).cast(pa.string())], ["doc_id", "n_tokens", "ids_text", "decoded"])

    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return kept.mapInArrow(scan.by_slice(make), "doc_id long, n_tokens long, ids_text string, decoded string")


def decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id, decoded: the text of every id list; a null list decodes to an empty text."""
    shared = bpe.Shared(encoded.sparkSession, vocabulary)

    def run(batches):
        for part in batches:
            voc = shared.get().vocabulary
            texts = [voc.decoded(x or []) for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["doc_id", "decoded"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, decoded string")
