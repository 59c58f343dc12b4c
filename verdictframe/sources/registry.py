"""Content registry, append-only logs, run documents, sinks and reconciliation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import latest


def register_content(files: DataFrame, registry: DataFrame, content: str = "content", key: str = "file_id") -> DataFrame:
    """New registry rows: one per unseen SHA-256; running it again adds nothing.

    Copies collapse in the partial aggregation, so a body repeated many times is one row
    before the shuffle.
    """
    hashed = files.select(F.sha2(F.col(content), 256).alias("sha256"), F.length(content).alias("size"), F.col(key).alias("_k"))
    fresh = hashed.groupBy("sha256").agg(F.min("size").alias("size"), F.min("_k").alias("first_key"), F.count("*").alias("copies"))
    return fresh.join(registry.select("sha256"), "sha256", "left_anti")


def ingest_outcomes(log: DataFrame, by: list[str], outcome: str = "outcome", ts: str = "at") -> DataFrame:
    """Attempts per outcome and the last one."""
    return log.groupBy(*by, outcome).agg(F.count("*").alias("attempts"), F.max(ts).alias("last_attempt"))


def log_ingest(attempts: DataFrame, path: str) -> None:
    """Append attempts to the log."""
    attempts.write.mode("append").parquet(path)


def latest_records(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last record per key and how many it superseded."""
    return latest(log, keys, order, "superseded")


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """``<model>__run<k>.json`` documents: one row per model, run and dimension."""
    schema = ("status string, final_score struct<total: double, dimension_scores: map<string, double>>, "
              "probes array<struct<dimension: string, status: string, confidence: double, metric_values: string>>")
    docs = spark.read.schema(schema).option("multiLine", True).json(path).select("*", F.col("_metadata.file_name").alias("_f"))
    name = F.regexp_extract("_f", r"^(.*)__run(\d+)\.json$", 1)
    run = F.regexp_extract("_f", r"^(.*)__run(\d+)\.json$", 2).cast("int")
    rows = docs.select(name.alias("model"), run.alias("run"), F.col("status").alias("run_status"), "final_score", F.explode("probes").alias("p"))
    return rows.select("model", "run", "run_status", "p.dimension", "p.status", "p.confidence", "p.metric_values",
                       F.try_element_at("final_score.dimension_scores", F.col("p.dimension")).alias("score"))


def write_documents(docs: DataFrame, folder: str, name: str = "name", doc: str = "doc") -> None:
    """Write every row as a file of its own below a folder that the executors share; a retried task writes the same file."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder if "://" in folder else "file:///" + folder.split(":", 1)[-1].lstrip("/"))
    store.create_dir(root)

    def put(batches):
        for b in batches:
            for n, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with store.open_output_stream(f"{root}/{n}") as f:
                    f.write(d.encode())
            yield b.slice(0, 0)

    docs.select(F.col(name).alias("name"), F.col(doc).alias("doc")).mapInArrow(put, "name string, doc string").write.format("noop").mode("overwrite").save()


def union_tables(tables: list[DataFrame]) -> DataFrame:
    """Union with all columns in first-seen order; absent ones are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write a table; an empty one is refused."""
    if df.isEmpty():
        raise ValueError("refusing to write an empty table")
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path)


def check_table(df: DataFrame, required: list[str], rows: int | None = None) -> DataFrame:
    """One row: missing columns, row count and whether both are as expected."""
    missing = sorted(set(required) - set(df.columns))
    n = F.count("*")
    return df.agg(F.lit(";".join(missing)).alias("missing_columns"), n.alias("rows"),
                  (F.lit(not missing) & (F.lit(True) if rows is None else n == rows)).alias("ok"))


def reconcile(a: DataFrame, b: DataFrame, keys: list[str], value: str, tol: float) -> DataFrame:
    """Keys whose values differ by more than ``tol`` or that exist on one side only; two nulls agree, and so do two NaN."""
    here = F.lit(True)
    j = a.select(*keys, F.col(value).alias("left_value"), here.alias("_l")).join(b.select(*keys, F.col(value).alias("right_value"), here.alias("_r")), keys, "full_outer")
    left, right = F.col("left_value"), F.col("right_value")
    one_sided = F.col("_l").isNull() | F.col("_r").isNull()
    nan = F.isnan(left.cast("double")) & F.isnan(right.cast("double"))
    differs = F.coalesce((F.abs(left - right) > tol) & ~nan, left.isNull() != right.isNull())
    return j.filter(one_sided | differs).select(*keys, "left_value", "right_value", F.when(one_sided, "one_sided").otherwise("differs").alias("problem"))


def differing_buckets(a: DataFrame, b: DataFrame, keys: list[str], value: str, tol: float, buckets: int = 4096) -> DataFrame:
    """Buckets of keys in which the two sides do not have the same digest: bucket, left_rows, right_rows.

    A digest is the row count and the xor of row hashes, so both sides are only aggregated, and at most ``buckets`` rows
    of each meet. Values are hashed on a grid of width ``tol``: values further apart never share a cell, so no difference
    is missed; close values on two sides of a cell's edge only make a bucket be looked into.
    """
    def digests(df: DataFrame, side: str) -> DataFrame:
        number = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
        cell = F.floor(number / F.lit(tol)) if tol else F.col(value)
        row = F.xxhash64(*keys, F.col(value).isNull(), cell)
        return df.groupBy(F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("bucket")).agg(
            F.count("*").alias(f"{side}_rows"), F.bit_xor(row).alias(f"_{side}_x"), F.sum(F.pmod(row, F.lit(1 << 30))).alias(f"_{side}_s"))

    j = digests(a, "left").join(digests(b, "right"), "bucket", "full_outer")
    same = F.col("left_rows").eqNullSafe(F.col("right_rows")) & F.col("_left_x").eqNullSafe(F.col("_right_x")) & F.col("_left_s").eqNullSafe(F.col("_right_s"))
    return j.filter(~same).select("bucket", F.coalesce("left_rows", F.lit(0)).alias("left_rows"), F.coalesce("right_rows", F.lit(0)).alias("right_rows"))


def reconcile_buckets(a: DataFrame, b: DataFrame, keys: list[str], value: str, tol: float, buckets: int = 4096) -> DataFrame:
    """As :func:`reconcile` for large tables that mostly agree: only rows of differing buckets are joined."""
    found = F.broadcast(differing_buckets(a, b, keys, value, tol, buckets).select("bucket"))  # at most ``buckets`` rows
    inside = lambda df: df.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets))).join(found, "bucket", "left_semi").drop("bucket")
    return reconcile(inside(a), inside(b), keys, value, tol)


def flatten_probe(df: DataFrame, document: str, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """Typed columns from JSON documents: {column: (path, type)}; a wrong type or bad JSON gives NULL.

    The document is parsed once into a variant.
    """
    parsed = df.withColumn("_v", F.try_parse_json(document))
    cols = {name: F.try_variant_get("_v", path, dtype) for name, (path, dtype) in fields.items()}
    return parsed.withColumns(cols).drop("_v")


def supplement(runs: DataFrame, extra: DataFrame, keys: list[str], is_fallback: Column) -> DataFrame:
    """Runs whose fallback entries are replaced from a supplementary log; provenance is kept."""
    usable = extra.select(*keys, *[c for c in extra.columns if c not in keys]).withColumn("provenance", F.lit("supplement"))
    gaps = runs.filter(is_fallback)
    filled = usable.join(gaps.select(*keys), keys, "left_semi")
    kept = runs.filter(~is_fallback).unionByName(gaps.join(usable.select(*keys), keys, "left_anti")).withColumn("provenance", F.lit("original"))
    return kept.unionByName(filled)
