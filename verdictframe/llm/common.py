"""Tables written between steps, size estimates and hash helpers shared by the operators."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictframe.session import ensure_checkpoint_dir


#: Spark removes the shuffle files of a finished query at once, instead of when the driver next collects garbage.
FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stash(df: DataFrame, free: bool = False) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it back.

    Cuts the lineage like ``checkpoint()`` but keeps columns, so later steps read only what they need. The files
    live as long as the checkpoint folder's other contents. ``free``: the shuffle files that ``df`` needed go at once.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/stash-{uuid.uuid4().hex}"
    before = spark.conf.get(FREE, "false")
    if free:
        spark.conf.set(FREE, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(FREE, before)
    return spark.read.schema(df.schema).parquet(path)


def text_of(name: str = "text") -> Column:
    """The text, or an empty string for null."""
    return F.coalesce(F.col(name), F.lit(""))


def total_bytes(df: DataFrame, name: str = "text") -> int:
    """UTF-8 bytes of all texts; one number, summed on the executors."""
    return df.agg(F.sum(F.octet_length(F.col(name)).cast("long")).alias("b")).first()["b"] or 0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def inverse(matrix: np.ndarray) -> np.ndarray:
    """Inverse of a small matrix by elimination with row pivots; no threaded linear-algebra library in the driver."""
    n = len(matrix)
    both = np.hstack([matrix.astype(float), np.eye(n)])
    for i in range(n):
        top = i + int(np.argmax(np.abs(both[i:, i])))
        both[[i, top]] = both[[top, i]]
        both[i] /= both[i, i]
        factor = both[:, i].copy()
        factor[i] = 0.0
        both -= factor[:, None] * both[i]
    return both[:, n:]
