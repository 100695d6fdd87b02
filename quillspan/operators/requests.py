"""Requests of reviewers and the meta agent merged, and candidates in batches that fit a prompt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .expansion import SIGNATURE


def merged(doctors: DataFrame, meta: DataFrame, most: int, key: str = "doc_id") -> DataFrame:
    """Distinct requests of one label, reviewers' before the meta agent's, the first `most` of each key and label."""
    every = doctors.withColumn("_side", F.lit(0)).unionByName(meta.withColumn("_side", F.lit(1)))
    once = every.groupBy(key, *SIGNATURE).agg(F.min(F.struct("_side", "ord")).alias("_first"))
    place = Window.partitionBy(key, "label").orderBy("_first", *SIGNATURE)
    return once.withColumn("_n", F.row_number().over(place)).filter(F.col("_n") <= most).drop("_n", "_first")


def batches(items: DataFrame, budget: int, most: int, key: str = "doc_id") -> DataFrame:
    """items (key, ord, text) with a batch number: a batch ends before its estimated tokens or its size would be exceeded."""
    item = F.struct("ord", T.rough_tokens(F.col("text")).alias("n"))
    lists = items.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("items"))
    start = F.struct(F.lit(0).alias("batch"), F.lit(0).alias("sum"), F.lit(0).alias("count"), F.array().cast("array<struct<ord:bigint,batch:int>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        full = (a["count"] > 0) & ((a["sum"] + x["n"] > budget) | (a["count"] >= most))
        number = a["batch"] + full.cast("int")
        one = F.struct(x["ord"].cast("bigint").alias("ord"), number.alias("batch"))
        return F.struct(number.alias("batch"), (F.when(full, 0).otherwise(a["sum"]) + x["n"]).alias("sum"), (F.when(full, 0).otherwise(a["count"]) + 1).alias("count"), F.concat(a["out"], F.array(one)).alias("out"))

    return lists.select(key, F.explode(F.aggregate("items", start, step, lambda a: a["out"])).alias("b")).select(key, "b.*")
