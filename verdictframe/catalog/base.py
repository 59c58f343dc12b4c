"""Registry of named queries: a Spark callable and, where SQL can say it, an oracle text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .views import TABLES, VIEWS, with_clause

REGISTRY: dict[str, "Entry"] = {}


@dataclass
class Entry:
    build: Callable[["Source"], DataFrame]
    sql: str | None


class Source:
    """Hands out the raw tables and the derived views of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __call__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.table(name)
        for table in TABLES:
            if table in VIEWS[name][1]:
                self.table(table).createOrReplaceTempView(table)
        return self.spark.sql(VIEWS[name][0])


def flat(df: DataFrame, digits: int = 6) -> DataFrame:
    """Comparable output: doubles rounded, arrays joined with '|'."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), digits)
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(F.transform(c, lambda x: x.cast("string")), "|")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def folded(df: DataFrame, by: list[str], cols: list[str], out: str) -> DataFrame:
    """One row per key: its rows as text, columns joined by commas, rows by semicolons, in order."""
    row = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in cols])
    return df.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list(row)), ";").alias(out))


def folded_sql(cols: list[str], out: str) -> str:
    """The aggregate that says the same in SQL."""
    row = "concat_ws(','" + "".join(f", coalesce(CAST({c} AS VARCHAR), '-')" for c in cols) + ")"
    return f"string_agg({row}, ';' ORDER BY {row}) AS {out}"


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register a query; ``views`` are prepended to the oracle text as CTEs."""

    def wrap(fn: Callable[[Source], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Entry(fn, None if sql is None else with_clause(views, sql))
        return fn

    return wrap


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(REGISTRY[name].build(Source(spark, sf_dir)))
