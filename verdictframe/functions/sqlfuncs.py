"""SQL-callable forms of the shared expressions (no Python at run time)."""

from __future__ import annotations

from pyspark.sql import SparkSession

_DEFINITIONS = (
    "hash_rank(seed STRING, key STRING) RETURNS BIGINT RETURN "
    "CAST(conv(substr(md5(concat_ws(':', seed, key)), 1, 8), 16, 10) AS BIGINT)",
    "wilson_lo(k DOUBLE, n DOUBLE) RETURNS DOUBLE RETURN CASE WHEN n > 0 THEN greatest(0.0D, "
    "((k / n + 3.8416D / (2 * n)) - 1.96D * sqrt((k / n) * (1 - k / n) / n + 3.8416D / (4 * n * n))) "
    "/ (1 + 3.8416D / n)) ELSE 0.0D END",
    "wilson_hi(k DOUBLE, n DOUBLE) RETURNS DOUBLE RETURN CASE WHEN n > 0 THEN least(1.0D, "
    "((k / n + 3.8416D / (2 * n)) + 1.96D * sqrt((k / n) * (1 - k / n) / n + 3.8416D / (4 * n * n))) "
    "/ (1 + 3.8416D / n)) ELSE 0.0D END",
    "detect_d(width DOUBLE) RETURNS INT RETURN CASE WHEN width IS NULL THEN 8 ELSE "
    "CAST(greatest(1, least(9, 8 - floor(greatest(width, 0.0D) / 0.05D))) AS INT) END",
)


def register(spark: SparkSession) -> None:
    """Create the temporary SQL functions in the session."""
    for body in _DEFINITIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {body}")
