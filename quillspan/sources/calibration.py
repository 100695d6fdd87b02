"""Files around calibration: thresholds, predictions, cached examples, configurations, reports and calibrated copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import text as T

DEFAULT_THRESHOLD = 0.5
PREDICTIONS = "*.labelcentered.json"
RULE = "struct<source_mode:string,require_label_filter:boolean,reject_weak_fragments:boolean,min_vote_fraction:double,min_expert_support:int,min_confidence:double,use_high_quality_rescue:boolean,vote_weights:map<string,double>>"


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def thresholds(spark: SparkSession, paths: dict[str, str], allow_default: bool = False) -> DataFrame:
    """expert, label, threshold from one JSON object of label to number for each expert.

    A missing file raises unless defaults are allowed; a label that a file lacks raises (when rows are read)."""
    out = None
    for expert, path in paths.items():
        if _exists(spark, path):
            values = F.from_json("value", "map<string,double>")
            one = spark.read.text(path, wholetext=True).select(F.explode(F.array(*(F.struct(F.lit(x).alias("label"), F.element_at(values, x).alias("threshold")) for x in L.LABELS))).alias("t")).select(F.lit(expert).alias("expert"), "t.*")
            lacking = F.raise_error(F.format_string(f"{path} has no threshold for %s", F.col("label"))).cast("double")
            one = one.withColumn("threshold", F.coalesce("threshold", lacking))
        elif allow_default:
            one = spark.createDataFrame([(expert, x, DEFAULT_THRESHOLD) for x in L.LABELS], "expert string, label string, threshold double")
        else:
            raise FileNotFoundError(f"no thresholds of {expert}: {path}")
        out = one if out is None else out.unionByName(one)
    return out


def payloads(spark: SparkSession, files: list[str] = (), folders: list[str] = ()) -> DataFrame:
    """source_file, place, name, payload (variant) of predictions: an object or a list of objects a file.

    Explicit files come first, then each folder's files by name; each once; none at all raises. The name of a file with
    several predictions gets their place."""
    from .records import distinct_paths

    found = list(distinct_paths(list(files)))
    for folder in folders:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{folder}/{PREDICTIONS}")
        listed = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where)
        found += sorted(str(x.getPath().toUri().getPath()) for x in listed or [])
    found = list(dict.fromkeys(found))
    if not found:
        raise FileNotFoundError("no prediction files")
    rows = spark.read.text(found, wholetext=True).select(F.col("_metadata.file_path").alias("source_file"), F.parse_json("value").alias("v"))
    many = F.schema_of_variant("v").startswith("ARRAY")
    listed = F.when(many, F.try_variant_get("v", "$", "array<variant>")).otherwise(F.array("v"))
    name = F.element_at(F.split("source_file", "/"), -1)
    return rows.select("source_file", many.alias("many"), F.posexplode(listed).alias("place", "payload")).select("source_file", "place", F.when(F.col("many"), F.concat(name, F.lit("#"), F.col("place"))).otherwise(name).alias("name"), "payload")


_SPAN = "struct<candidate_id:string,label:string,start:int,end:int,text:string,proposed_by_experts:array<string>,confidence_by_expert:map<string,double>>"


def payload_spans(predictions: DataFrame, field: str = "final_spans_by_label") -> DataFrame:
    """source_file, place, label, pos and a span's fields from an object of lists by label in each payload; labels that are
    unknown are left out. final_spans_by_label and label_candidate_registries have this shape."""
    lists = F.explode(F.array(*(F.struct(F.lit(x).alias("label"), F.try_variant_get("payload", f"$.{field}.{x}", f"array<{_SPAN}>").alias("spans")) for x in L.LABELS))).alias("l")
    rows = predictions.select("source_file", "place", lists).select("source_file", "place", F.col("l.label").alias("label"), F.posexplode("l.spans").alias("pos", "s"))
    return rows.select("source_file", "place", "label", "pos", *(F.col(f"s.{c}") for c in ("candidate_id", "start", "end", "text", "proposed_by_experts", "confidence_by_expert")))


def payload_ids(predictions: DataFrame, field: str = "recommended_candidate_ids_by_label") -> DataFrame:
    """source_file, place, label, pos, candidate_id from an object of lists of ids by label in each payload."""
    lists = F.explode(F.array(*(F.struct(F.lit(x).alias("label"), F.try_variant_get("payload", f"$.{field}.{x}", "array<string>").alias("ids")) for x in L.LABELS))).alias("l")
    return predictions.select("source_file", "place", lists).select("source_file", "place", F.col("l.label").alias("label"), F.posexplode("l.ids").alias("pos", "candidate_id"))


def payload_votes(predictions: DataFrame) -> DataFrame:
    """source_file, place, label, candidate_id, role, decision from the payloads' vote matrices."""
    kind = "map<string,map<string,string>>"
    lists = F.explode(F.array(*(F.struct(F.lit(x).alias("label"), F.try_variant_get("payload", f"$.candidate_vote_matrices_by_label.{x}", kind).alias("votes")) for x in L.LABELS))).alias("l")
    rows = predictions.select("source_file", "place", lists).select("source_file", "place", F.col("l.label").alias("label"), F.explode("l.votes").alias("candidate_id", "cast"))
    return rows.select("source_file", "place", "label", "candidate_id", F.explode("cast").alias("role", "decision"))


def configurations(spark: SparkSession, path: str) -> DataFrame:
    """label and its rule from a JSON object with an object `labels`; a label that is missing raises."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", f"labels map<string,{RULE}>").alias("c"))
    one = rows.select(F.explode(F.array(*(F.struct(F.lit(x).alias("label"), F.element_at("c.labels", x).alias("rule")) for x in L.LABELS))).alias("x")).select("x.*")
    lacking = F.raise_error(F.format_string("the configuration has no rule for %s", F.col("label"))).cast(RULE)
    return with_defaults(one.withColumn("rule", F.coalesce("rule", lacking)).select("label", "rule.*"))


def with_defaults(rules: DataFrame) -> DataFrame:
    """Rules whose missing fields have their defaults; weights as an array in the order of the roles."""
    plain = {"source_mode": "calibrated_rule", "require_label_filter": True, "reject_weak_fragments": True, "min_vote_fraction": 2 / 3, "min_expert_support": 2, "min_confidence": 0.0, "use_high_quality_rescue": True}
    weights = F.array(*(F.coalesce(F.element_at("vote_weights", e), F.lit(1.0)) for e in L.EXPERTS)) if "map" in rules.schema["vote_weights"].dataType.simpleString() else F.col("vote_weights")
    return rules.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in plain.items()} | {"vote_weights": F.coalesce(weights, F.array(*(F.lit(1.0) for _ in L.EXPERTS)))})


def write_examples(examples: DataFrame, path: str) -> None:
    """Aligned examples as a table that tuning reads again and again."""
    examples.write.mode("overwrite").parquet(path)


def examples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def calibrated_name(name: Column, suffix: str) -> Column:
    """File name of a calibrated copy."""
    safe = T.safe_name(F.lit(suffix))
    known = F.regexp_replace(name, r"\.labelcentered\.json$", "")
    return F.when(known != name, F.concat(known, F.lit("."), safe, F.lit(".labelcentered.json"))).otherwise(F.concat(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), F.lit("."), safe, F.lit(".json")))


def write_report(report: DataFrame, path: str) -> int:
    """The report as one JSON file of lines; how many records it holds. A report of nothing aligned raises before."""
    n = report.count()
    if not n:
        raise ValueError("nothing was aligned")
    report.coalesce(1).write.mode("overwrite").json(path)  # a report has some hundred rows
    return n


def write_copies(copies: DataFrame, path: str) -> tuple[int, int]:
    """Writes calibrated copies (name, value, error) that have no error; how many were written and how many failed."""
    copies.filter("error IS NULL").select("name", "value").write.mode("overwrite").partitionBy("name").text(path)
    sums = copies.agg(F.count_if(F.col("error").isNull()).alias("ok"), F.count_if(F.col("error").isNotNull()).alias("bad")).first()
    return sums["ok"], sums["bad"]
