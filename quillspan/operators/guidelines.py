"""Annotation guidelines by label: paragraphs of local files assigned by heading and keyword, behind a given base table."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import prompts

# Lines and keywords that assign a paragraph to a label, and how another section begins.
LINE_LABELS = {"population": "Participant", "interventions": "Intervention", "intervention": "Intervention", "comparison": "ComparisonGroup", "outcomes": "Outcome", "outcome": "Outcome"}
KEYWORDS = {
    "Participant": ["K-12 students", "teachers from any cultural backgrounds"],
    "Intervention": ["school-based intervention", "Mental Health Promotion Programs", "Social-Emotional Learning"],
    "Outcome": ["Mental Health and Well-being", "Social-Emotional Skills", "Behavioral Adjustment", "Resilience and Coping"],
    "DesignDescription": ["randomized controlled trial", "experiment", "quasi-experimental"],
}
NEXT_SECTION = r"^(?:[A-G]\.|General Annotation Rules|Goal:|Source:|Style:|PICO|Inclusion Criteria|Some Definitions)\b"
BASE_KINDS = ["definition", "include", "exclude", "boundary", "examples", "common_errors"]


def heading_of(paragraph):
    """The label whose name a paragraph begins with (after a letter A-G and a dot), null for others."""
    bare, out = F.trim(paragraph), F.lit(None).cast("string")
    for name in reversed(L.LABELS):
        out = F.when(bare.rlike(rf"(?i)^(?:[A-G]\.\s*)?{re.escape(name)}\b"), name).otherwise(out)
    return out


def assigned(paragraphs: DataFrame, key: str = "file", order: str = "ord", text: str = "text") -> DataFrame:
    """key, label, ord, text: a paragraph goes to the label of its heading, of its line, of its keywords, and of the last
    heading before it unless it begins another section."""
    heading = heading_of(F.col(text))
    upto = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = paragraphs.withColumn("_heading", heading).withColumn("_current", F.last("_heading", ignorenulls=True).over(upto))
    low = F.lower(F.trim(F.col(text)))
    line = F.element_at(F.create_map(*(F.lit(x) for kv in LINE_LABELS.items() for x in kv)), F.trim(F.substring_index(low, ":", 1)))
    worded = [F.when(low.rlike("|".join(re.escape(k.lower()) for k in words)), F.lit(name)) for name, words in KEYWORDS.items()]
    kept = F.when(~F.col(text).rlike(NEXT_SECTION), F.col("_current"))
    labels = F.when(F.col("_heading").isNotNull(), F.array(F.col("_heading"))).otherwise(F.array_distinct(F.array_compact(F.array(line, *worded, kept))))
    return rows.select(key, F.explode(labels).alias("label"), F.col(order).alias("ord"), F.col(text).alias("text"))


def snippets(paragraphs: DataFrame, key: str = "file", order: str = "ord", text: str = "text") -> DataFrame:
    """key, label, text: one bounded snippet of each file and label, each paragraph once in its first place."""
    first = assigned(paragraphs, key, order, text).groupBy(key, "label", "text").agg(F.min("ord").alias("ord"))
    lists = first.groupBy(key, "label").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("p"))
    return lists.select(key, "label", prompts.snippet(F.concat_ws(" ", F.transform("p", lambda x: x["text"]))).alias("text"))


def text_files(files: DataFrame) -> DataFrame:
    """file, label, text of plain files that are named after a label."""
    name = F.element_at(F.split("file", "/"), -1)
    return files.withColumn("label", F.regexp_replace(name, r"\.txt$", "")).filter(F.col("label").isin(L.LABELS)).select("file", "label", F.col("text"))


def retrieved(base: DataFrame, local: DataFrame, label: str) -> DataFrame:
    """ord, text of all guidelines of one label: base rows (label, kind, texts) by kind, then local ones by file.

    A label that is unknown has none."""
    kind = F.array_position(F.array(*(F.lit(k) for k in BASE_KINDS)), F.col("kind")).cast("long")
    own = base.filter(F.col("label") == label).select(F.lit(0).alias("side"), kind.alias("n"), F.lit("").alias("file"), F.concat(F.lit(f"[{label}] "), F.translate("kind", "_", " "), F.lit(": "), F.concat_ws("; ", "texts")).alias("text"))
    name = F.element_at(F.split("file", "/"), -1)
    more = local.filter((F.col("label") == label) & (F.col("text") != "")).select(F.lit(1).alias("side"), F.lit(0).cast("long").alias("n"), "file", prompts.local_snippet(name, F.col("text")).alias("text"))
    rows = own.unionByName(more) if label in L.LABELS else own.limit(0)
    return rows.withColumn("ord", F.row_number().over(Window.orderBy("side", "n", "file")) - 1).select("ord", "text")  # one label's rows: some tens
