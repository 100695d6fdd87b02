"""A synthetic corpus of short study reports, one for each customer, as one SQL expression that Spark and DuckDB share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store

K = "c_custkey"


def _pick(divisor: int, *choices: str) -> str:
    cases = " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(choices))
    return f"CASE ({K} % {divisor}) % {len(choices)} {cases} END"


_PARTS = [
    "'=== METHODS ==='", "chr(10)", "'We recruited '", f"40 + {K} % 160", "' '", _pick(7, "students", "adolescents", "teachers", "children"),
    "' aged '", f"9 + {K} % 4", "' to '", f"14 + {K} % 3", "' from '", f"3 + {K} % 11", "' schools. The '", _pick(11, "mindfulness", "Coping Power", "resilience", "social-emotional"),
    "' program had '", f"6 + {K} % 7", "' weekly sessions focused on coping skills; '", _pick(5, "seventh grade students", "high school children", "parents"),
    "' took part. Participants were randomized to the intervention (n = '", f"20 + {K} % 80", "') or the '", _pick(3, "wait-list control group", "usual care control group", "business-as-usual comparison group"),
    "' (n = '", f"20 + {K} % 79", "'). This was a '", _pick(13, "cluster randomized controlled trial", "quasi-experimental study", "cross-sectional cohort study"),
    "'.'", "chr(10)", "chr(10)", "'=== RESULTS ==='", "chr(10)", _pick(17, "Depression symptoms were measured with the CES-D scale", "Anxiety scores were assessed with a self-report questionnaire", "Self-esteem and emotional problems were assessed"),
    "'. Stress decreased: p < 0.0'", f"1 + {K} % 5", "'; the prosocial behavior score improved. '", _pick(19, "ANCOVA and a t-test were used", "Linear regression with imputation was applied", "A mixed-effects model was fitted"),
    "'. The control group received '", _pick(3, "usual care", "no intervention", "normal activities"), "'.'",
]
TEXT = "concat(" + ", ".join(_PARTS) + ")"
CTE = f"studies AS (SELECT {K} AS doc_id, {TEXT} AS text FROM customer)"


def _made(keys: DataFrame) -> DataFrame:
    return keys.select(F.col(K).alias("doc_id"), F.expr(TEXT).alias("text"))


def studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text for every customer."""
    return _made(store.dealt(spark.read.parquet(f"{sf_dir}/customer.parquet").select(K)))


def distinct_studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """studies() with each customer once, for what takes a document's spans together. Only keys are shuffled."""
    keys = spark.read.parquet(f"{sf_dir}/customer.parquet").select(K)
    many = max(4 * spark.sparkContext.defaultParallelism, keys.rdd.getNumPartitions())
    return _made(keys.repartition(many, K).distinct())
