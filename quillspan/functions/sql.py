"""Span helpers for SQL users: scalar functions stated in SQL, which Catalyst inlines, and table functions."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

SCALARS = {
    "span_overlap(a INT, b INT, c INT, d INT) RETURNS INT": "greatest(0, least(b, d) - greatest(a, c))",
    "span_iou(a INT, b INT, c INT, d INT) RETURNS DOUBLE": "CASE WHEN greatest(b, d) = least(a, c) THEN 0D ELSE greatest(0, least(b, d) - greatest(a, c)) / (greatest(b, d) - least(a, c)) END",
    "spans_overlap(a INT, b INT, c INT, d INT) RETURNS BOOLEAN": "least(b, d) > greatest(a, c)",
    "safe_ratio(a DOUBLE, b DOUBLE) RETURNS DOUBLE": "CASE WHEN b = 0 THEN 0D ELSE a / b END",
    "f_score(tp DOUBLE, fp DOUBLE, fn DOUBLE) RETURNS DOUBLE": "CASE WHEN tp = 0 THEN 0D ELSE 2 * tp / (2 * tp + fp + fn) END",
    "clean_text(t STRING) RETURNS STRING": r"trim(regexp_replace(t, '\\s+', ' '))",
    "rough_tokens(t STRING) RETURNS INT": "greatest(1, int(length(t) div 4))",
}


def _tables():
    # Made here and not at the top, so that a session is there when the functions are.
    @F.udtf(returnType="ord int, start int, end int, text string")
    class SpanTokens:
        def eval(self, text: str):
            import re

            for k, m in enumerate(re.finditer("\\w+(?:[-\u2019']\\w+)*|[^\\w\\s]", text or "")):
                yield k, m.start(), m.end(), m[0]

    @F.udtf(returnType="sentence_id string, start int, end int, text string")
    class SourceUnits:
        def eval(self, text: str):
            import re

            n = 0
            for m in re.finditer(r".+?(?:[.!?](?=\s+|$)|\n{2,}|$)", text or "", re.DOTALL):
                bare = m[0].strip()
                if bare:
                    n += 1
                    at = m.start() + m[0].index(bare)
                    yield f"S{n:04d}", at, at + len(bare), bare

    return {"span_tokens": SpanTokens, "source_units": SourceUnits}


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to the session's SQL; their names."""
    for head, body in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    tables = _tables()
    for name, made in tables.items():
        spark.udtf.register(name, made)
    return [*(head.split("(")[0] for head in SCALARS), *tables]
