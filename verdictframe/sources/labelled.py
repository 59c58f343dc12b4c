"""Labelled tables, file sniffing and column profiles."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import first_case, is_missing, strip
from .files import scan_files

# What a file is when it is not a table.
LFS_POINTER = r"^version https://git-lfs\.github\.com/spec/v1\r?\noid sha256:[0-9a-f]{64}\r?\nsize [0-9]+\r?\n?"
_LEADING = "﻿ \t\r\n"


class SourceError(ValueError):
    """A table that cannot be read as declared."""


def read_labelled(spark: SparkSession, path: str, fmt: str = "csv", multi_line: bool = True) -> DataFrame:
    """Read a labelled table; CSV cells stay strings, names are trimmed, duplicate names are refused.

    The header of the first file fixes the schema and every other file's header is checked
    against it by the reader. Without ``multi_line`` no cell may hold a line break, and large files are split.
    """
    if fmt == "parquet":
        return spark.read.parquet(path)
    head = spark.read.text(path).head(1)
    if not head:
        raise SourceError("file has no header row")
    names = [n.strip().lstrip("﻿") for n in next(csv.reader([head[0][0]]))]
    if len(set(names)) != len(names):
        raise SourceError(f"duplicate column names: {names}")
    raw_names = [n.lstrip("﻿") for n in next(csv.reader([head[0][0]]))]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in raw_names])
    df = (
        spark.read.schema(schema).option("header", True).option("multiLine", multi_line).option("quote", '"').option("escape", '"')
        .option("enforceSchema", False).option("encoding", "UTF-8").option("emptyValue", "").csv(path))
    return df.toDF(*names)


def content_verdict(text: Column) -> Column:
    """'table', or why the content is none: Git-LFS pointer, web page, markup or JSON."""
    body = F.ltrim(text, F.lit(_LEADING))
    low = F.lower(F.substring(body, 1, 15))
    return first_case(
        (text.isNull(), "not_utf8"), (body.rlike(LFS_POINTER), "git_lfs_pointer"),
        (low.startswith("<!doctype html") | low.startswith("<html"), "web_page"),
        (F.substring(body, 1, 1).isin("<", "{", "["), "markup_or_json"), default="table")


def classify_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, verdict) for many files of any size; only files that are UTF-8 throughout count as text."""
    return scan_files(spark, path).select("path", "length", content_verdict(F.col("head")).alias("verdict"))


def classify_parts(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """As :func:`classify_files` for files stored in parts: a folder is one file (path, length, verdict), its parts follow by name.

    Parts end at line ends, as Spark writes them, and are read whole, each by one task. The beginning is that of the first
    part that is not blank.
    """
    parts = scan_files(spark, path).filter(F.col("path").endswith(suffix))
    whole = parts.groupBy(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("path")).agg(
        F.sum("length").alias("length"), F.bool_and("is_utf8").alias("_text"),
        F.min_by("head", F.when(F.col("head") != "", F.col("path"))).alias("_head"))
    head = F.when(F.col("_text"), F.coalesce("_head", F.lit("")))
    return whole.select("path", "length", content_verdict(head).alias("verdict"))


def profile_columns(df: DataFrame) -> DataFrame:
    """Non-missing values and inferred kind per column, from all rows.

    A column is numeric when every non-missing value casts to double; '1_000' is not a number here.
    """
    long = df.select(F.posexplode(F.array(*[F.col(f"`{c}`").cast("string") for c in df.columns])).alias("position", "v"))
    present = ~is_missing("v")
    agg = long.groupBy("position").agg(
        F.count_if(present).alias("non_missing"), F.count_if(present & strip("v").try_cast("double").isNotNull()).alias("numeric"))
    name = F.element_at(F.array(*[F.lit(c) for c in df.columns]), F.col("position") + 1)
    return agg.select(name.alias("column"), "position", "non_missing", first_case(
        (F.col("non_missing") == 0, "unknown"), (F.col("numeric") == F.col("non_missing"), "numeric"), default="categorical").alias("inferred_type"))


#: Binary logarithm of a distinct-count sketch's buckets; its relative standard error is 1.04 / sqrt(2^14), below 1 %.
SKETCH_SIZE = 14


def column_sketches(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mergeable profile of every column: non-missing and numeric values, and a sketch of the distinct trimmed values.

    Kept with the registry entry of a content (its hash among ``by``), it stands for the content when ingests are joined:
    see :func:`merge_profiles`. All columns are profiled in one pass; a sketch has at most some 16 kB.
    """
    by = by or []
    names = [c for c in df.columns if c not in by]
    cells = df.select(*by, F.posexplode(F.array(*[F.col(f"`{c}`").cast("string") for c in names])).alias("position", "v"))
    value, present = strip("v"), ~is_missing("v")
    name = F.element_at(F.array(*[F.lit(c) for c in names]), F.col("position") + 1)
    return cells.groupBy(*by, "position").agg(
        F.count_if(present).alias("non_missing"), F.count_if(present & value.try_cast("double").isNotNull()).alias("numeric"),
        F.hll_sketch_agg(F.when(present, value), SKETCH_SIZE).alias("sketch")).withColumn("column", name)


def merge_profiles(stored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Profile of the union of stored contents: non-missing values, kind and estimated distinct values per column name."""
    merged = stored.groupBy(*(by or []), "column").agg(
        F.min("position").alias("position"), F.sum("non_missing").alias("non_missing"), F.sum("numeric").alias("numeric"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_estimate"))
    return merged.select(*(by or []), "column", "position", "non_missing", first_case(
        (F.col("non_missing") == 0, "unknown"), (F.col("numeric") == F.col("non_missing"), "numeric"), default="categorical").alias("inferred_type"), "distinct_estimate")


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("rows"))


def group_values(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """Trimmed values with counts; missing rows form one group with its two causes."""
    by = by or []
    miss = is_missing(column)
    blank = F.coalesce(F.length(strip(column)), F.lit(0)) == 0
    agg = df.groupBy(*by, F.when(miss, "(missing)").otherwise(strip(column)).alias("value"), miss.alias("missing")).agg(
        F.count("*").alias("count"), F.count_if(miss & blank).alias("empty_string"), F.count_if(miss & ~blank).alias("null_token"))
    return agg


def ordered_groups(groups: DataFrame) -> DataFrame:
    """Most frequent first, ties by value, the missing group last."""
    return groups.orderBy("missing", F.col("count").desc(), "value")


def target_values(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    return df.filter(~is_missing(column)).select(*(by or []), strip(column).alias("value")).distinct()
