"""Exact token counts of every prefix, and with them of whole texts.

For each distinct pre-token a table gives the token count of each of its prefixes; the entry of a prefix is one
more than that of the prefix before its last token, which is the only token that agrees with what stands before
it. Tables answer truncation and budget questions without encoding again. The operator reads
each text once and shuffles nothing.

Defined cases: null and empty texts have 0 bytes and 0 tokens; repeated rows are counted each; an empty table gives
an empty result; columns other than the two named ones are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, scan


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens, over_limit (more than `limit` tokens) of every text."""
    shared = bpe.Shared(docs.sparkSession, vocabulary)

    def make(part: pa.RecordBatch) -> pa.RecordBatch:
        n = shared.get().count(part.column(1))
        _, at = scan.flat(part.column(1))
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(at)), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return kept.mapInArrow(scan.by_slice(make), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def truncation(docs: DataFrame, vocabulary: str, budget: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes_kept, n_tokens_kept: the longest prefix of whole characters that is at most `budget` tokens long."""
    shared = bpe.Shared(docs.sparkSession, vocabulary)

    def make(part: pa.RecordBatch) -> pa.RecordBatch:
        kept, tokens = [], []
        for text in part.column(1).to_pylist():
            table = shared.get().prefix_counts(text or "")
            at = int(np.flatnonzero((table >= 0) & (table <= budget))[-1])
            kept.append(at)
            tokens.append(int(table[at]))
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(kept, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_bytes_kept", "n_tokens_kept"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(scan.by_slice(make), "doc_id long, n_bytes_kept long, n_tokens_kept long")
