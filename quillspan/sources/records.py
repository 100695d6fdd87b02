"""Sources and sinks of annotation records: JSON lists and objects, section texts, payload files, resumable output.

Files are read whole as text and parsed as variants, so that records of different shape live in one column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import text as T


def load_records(spark: SparkSession, *paths: str, strict: bool = True) -> DataFrame:
    """source_file, record_index, record (variant) of every record in JSON files.

    A file is a list of records, an object with a list under records, tasks or examples, or one record. An element
    that is no object raises in strict mode and is dropped otherwise."""
    files = spark.read.text(list(paths), wholetext=True).select(F.col("_metadata.file_path").alias("source_file"), F.parse_json("value").alias("v"))
    kind = lambda c: F.schema_of_variant(c)
    inner = [F.try_variant_get("v", f"$.{name}", "array<variant>") for name in ("records", "tasks", "examples")]
    whole = F.when(kind(F.col("v")).startswith("ARRAY"), F.try_variant_get("v", "$", "array<variant>"))
    listed = files.select("source_file", F.posexplode(F.coalesce(whole, *inner, F.array("v"))).alias("record_index", "record"))
    is_object = kind(F.col("record")).startswith("OBJECT")
    if strict:
        return listed.withColumn("record", F.when(is_object, F.col("record")).otherwise(F.parse_json(F.raise_error(F.lit("a record is no JSON object")).cast("string"))))
    return listed.filter(is_object)


def field(record: Column, name: str) -> Column:
    """A text field of a record: under data where there is such an object, else at the top."""
    return F.coalesce(F.try_variant_get(record, f"$.data.{name}", "string"), F.try_variant_get(record, f"$.{name}", "string"))


def model_input(record: Column) -> Column:
    """Methods and results text with an empty line between."""
    return F.concat(F.coalesce(field(record, "method_section"), F.lit("")), F.lit("\n\n"), F.coalesce(field(record, "results_section"), F.lit("")))


def record_name(record: Column, index: Column) -> Column:
    """The first field that names a record, as a safe file name; else its number."""
    names = [F.nullif(field(record, n), F.lit("")) for n in ("file", "filename", "id", "doc_id", "document_id")]
    named = F.coalesce(*names)
    return F.when(named.isNotNull(), T.safe_name(named)).otherwise(F.format_string("rec%04d", index))


def gold_items(records: DataFrame) -> DataFrame:
    """source_file, record_index, label, start, end, text of the first annotation that was not cancelled: its label items.

    Of several labels of an item the first one counts; items whose label is unknown are left out."""
    item = "struct<type: string, value: struct<start: int, end: int, text: string, labels: array<string>>>"
    annotations = F.try_variant_get("record", "$.annotations", f"array<struct<was_cancelled: boolean, result: array<{item}>>>")
    first = F.get(F.filter(annotations, lambda a: ~F.coalesce(a["was_cancelled"], F.lit(False))), F.lit(0))
    rows = records.select("source_file", "record_index", F.explode(first["result"]).alias("r")).filter("r.type = 'labels'")
    rows = rows.withColumn("label", F.get(F.col("r.value.labels"), F.lit(0))).filter(F.col("label").isin(L.LABELS))
    return rows.select("source_file", "record_index", "label", F.col("r.value.start").alias("start"), F.col("r.value.end").alias("end"), F.col("r.value.text").alias("text"))


def sections(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, methods, results: the texts after the section markers, trimmed, empty where there is none."""
    methods = F.regexp_extract(F.col(text), r"(?s)=== METHODS ===\s*(.*?)\s*(?:=== RESULTS ===|\z)", 1)
    return docs.select(key, methods.alias("methods"), F.regexp_extract(F.col(text), r"(?s)=== RESULTS ===\s*(.*?)\s*\z", 1).alias("results"))


# Heads of the sections of a plain text, and what ends each of them.
METHOD_HEAD, METHOD_STOP = r"methods?|methodology|experimental\s+design", r"results?|discussion|analysis|conclusion"
RESULT_HEAD, RESULT_STOP = r"results?|findings|outcomes", r"discussion|conclusion|analysis|limitations"


def _section(text: Column, head: str, stop: str) -> Column:
    """What stands between a head's own line and the next line that begins with a stop; empty without either."""
    found = F.regexp_extract(text, rf"(?is)(?:^|\n)\s*(?:\d+\.?\s*)?(?:{head})\s*\n(.*?)(?=\n\s*(?:\d+\.?\s*)?(?:{stop}))", 1)
    return F.regexp_replace(found, rf"^{T.SPACE}+|{T.SPACE}+$", "")


def heading_sections(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, methods, results of plain texts by their headings. Markers are set by marked_input()."""
    return docs.select(key, _section(F.col(text), METHOD_HEAD, METHOD_STOP).alias("methods"), _section(F.col(text), RESULT_HEAD, RESULT_STOP).alias("results"))


def marked_input(methods: Column, results: Column) -> Column:
    """Section texts behind their markers with an empty line between; an empty section has no marker."""
    part = lambda name, c: F.when(F.trim(c) != "", F.concat(F.lit(f"=== {name} ===\n"), c)).otherwise("")
    return F.concat(part("METHODS", methods), F.lit("\n\n"), part("RESULTS", results))


def extracted_text(spark: SparkSession, path: str, extract, glob: str = "*") -> DataFrame:
    """path, text of binary files by a plugged-in function from bytes to text, in batches on the executors."""
    import pyarrow as pa

    def run(batches):
        for part in batches:
            texts = [extract(x) for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["path", "text"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select("path", "content").mapInArrow(run, "path string, text string")


def docx_text(content: bytes) -> str:
    """Paragraphs of a .docx file, white space collapsed, one a line."""
    import io
    import zipfile
    from xml.etree import ElementTree

    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        tree = ElementTree.fromstring(z.read("word/document.xml"))
    lines = (" ".join("".join(t.text or "" for t in p.iter(f"{space}t")).split()) for p in tree.iter(f"{space}p"))
    return "\n".join(x for x in lines if x)


def not_done(inputs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Inputs whose output does not exist yet."""
    return inputs.join(done.select(key).distinct(), key, "left_anti")


def write_csv(rows: DataFrame, path: str, columns: list[str]) -> None:
    """Columns in a fixed order with a header; missing values are empty."""
    rows.select(*columns).na.fill("").write.option("header", True).option("emptyValue", "").mode("overwrite").csv(path)


def documents_json(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """key and a JSON object of its final spans by label."""
    item = F.struct("candidate_id", "label", "start", "end", "text")
    by_label = spans.groupBy(key, "label").agg(F.array_sort(F.collect_list(item)).alias("items"))
    return by_label.groupBy(key).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "items"))))).alias("final_spans_by_label"))


def distinct_paths(paths: list[str]) -> list[str]:
    """Paths in their order, each resolved one once."""
    import os

    return list(dict.fromkeys(os.path.realpath(os.path.expanduser(p)) for p in paths))


def limited(records: DataFrame, most: int, file: str = "source_file", index: str = "record_index") -> DataFrame:
    """The first records of each file."""
    place = Window.partitionBy(file).orderBy(index)
    return records.withColumn("_n", F.row_number().over(place)).filter(F.col("_n") <= most).drop("_n")


def with_source(records: DataFrame) -> DataFrame:
    """records with source_file (a bare name) and source_index, unless the records hold fields of these names."""
    own = F.coalesce(field(F.col("record"), "source_file"), F.element_at(F.split("source_file", "/"), -1))
    index = F.coalesce(field(F.col("record"), "source_index").try_cast("int"), F.col("record_index"))
    return records.withColumns({"source_file": own, "source_index": index})


def write_splits(records: DataFrame, path: str, column: str = "split") -> None:
    """One folder of JSON lines for each split."""
    records.select(column, F.to_json("record").alias("value")).write.partitionBy(column).mode("overwrite").text(path)


def run_totals(outcomes: DataFrame, status: str = "status") -> DataFrame:
    """One row of how many documents were processed, skipped and failed."""
    return outcomes.agg(*(F.count_if(F.col(status) == s).alias(s) for s in ("processed", "skipped", "failed")))
