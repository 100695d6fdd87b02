"""Corpus pipeline: toxic documents go, then exact copies, near copies and repeated passages; the rest is packed.

run(spark, sf_dir) applies STAGES to documents. Each stage is written as Parquet to the shared folder and read again as
the next stage's input; all but the last return the columns of documents.

Defined cases: empty tables give an empty result; without usable labels no document is toxic; null and empty texts are
one text to the exact stage and have one piece in the end; rows that repeat wholly are copies; columns of any other name
pass through the stages unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm import durable, jaccard, naming, packing, substrings, toxicity
from quillspan.llm.queries import tokenizer
from quillspan.session import ship_package

# A stage holds models and counts that SQL doesn't express; tests compare run() with a brute-force version.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labelled ones of docs, scores below 0.5."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z, the document with the largest id."""
    return naming.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 on five-word shingles, the one with the smallest id."""
    return jaccard.one_of_each(docs, 5, 80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 100 bytes or more that also start earlier; n_chars follows. Texts whose parts end
    inside a character lose its bytes. A text that is cut whole stays as an empty one."""
    return substrings.cut_texts(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = durable.stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
