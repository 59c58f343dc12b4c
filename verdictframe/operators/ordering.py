"""Exact ranks and order-dependent picks that survive a hot key.

A plain ``row_number() over (partition by key ...)`` sends every row of a key to
one task.  The helpers below split the key first: by the leading bits of a hash
(uniform, so every slice is small), by blocks of a unique integer, or by range
partitions that are materialised once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import join_keys
from ..session import materialize

#: Largest top-k of a whole table, and of a key; the latter is also the limit up to which Spark ranks before a shuffle.
TOP_ROWS, TOP_GROUP = 100_000, 1000
_SLICES_SHIFT = 16  # a 32-bit hash leaves 65,536 slices per key


def lowest_hashes(
    df: DataFrame,
    quota: Column | str,
    hash_col: str,
    by: list[str] | None = None,
    ties: list[str] | None = None,
    bound: int | None = None,
) -> DataFrame:
    """Rows whose (hash, ties) rank within ``by`` is at most ``quota``.

    A small ``bound`` on all quotas makes it a top-k: every task keeps its first ``bound`` rows per key, and only those
    are shuffled, so the rows are read once. Otherwise a histogram over hash slices finds the slice in which the quota is
    reached; lower slices are kept without sorting, and only the boundary slice is ranked.
    """
    if bound is not None and not by and bound <= TOP_ROWS:
        return df.orderBy(hash_col, *(ties or [])).limit(bound)
    if bound is not None and by and bound <= TOP_GROUP:
        first = W.partitionBy(*by).orderBy(hash_col, *(ties or []))
        most = F.col(quota) if isinstance(quota, str) else quota
        ranked = df.withColumn("_rank", F.row_number().over(first)).filter(F.col("_rank") <= bound)
        return ranked.filter(F.col("_rank") <= most).drop("_rank")
    keys = by or ["_all"]
    src = df if by else df.withColumn("_all", F.lit(0))
    quota_col = F.col(quota) if isinstance(quota, str) else quota
    src = src.withColumn("_quota", quota_col.cast("bigint")).withColumn(
        "_slice", F.shiftright(F.col(hash_col), _SLICES_SHIFT)
    )
    hist = src.groupBy(*keys, "_slice").agg(F.count("*").alias("_n"), F.max("_quota").alias("_q"))
    upto = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, W.currentRow)
    cut = (
        hist.withColumn("_cum", F.sum("_n").over(upto))
        .filter(F.col("_cum") - F.col("_n") < F.col("_q"))
        .groupBy(*keys)
        .agg(F.max("_slice").alias("_cut"), F.max_by(F.col("_cum") - F.col("_n"), "_slice").alias("_below"))
    )
    joined = join_keys(src, cut, keys)
    sure = joined.filter(F.col("_slice") < F.col("_cut"))
    rank = W.partitionBy(*keys).orderBy(hash_col, *(ties or []))
    edge = (
        joined.filter(F.col("_slice") == F.col("_cut"))
        .withColumn("_rank", F.row_number().over(rank) + F.col("_below"))
        .filter(F.col("_rank") <= F.col("_quota"))
        .drop("_rank")
    )
    return sure.unionByName(edge).select(*df.columns)


def hash_ranks(df: DataFrame, hash_col: str, by: list[str] | None = None, ties: list[str] | None = None,
               out: str = "rank") -> DataFrame:
    """Exact row number by (hash, ties) within ``by``; every hash slice is ranked on its own."""
    keys = by or ["_all"]
    src = df if by else df.withColumn("_all", F.lit(0))
    src = src.withColumn("_slice", F.shiftright(F.col(hash_col), _SLICES_SHIFT))
    hist = src.groupBy(*keys, "_slice").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = hist.select(*keys, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rank = W.partitionBy(*keys, "_slice").orderBy(hash_col, *(ties or []))
    return (
        join_keys(src.withColumn("_rank", F.row_number().over(rank)), offsets, [*keys, "_slice"])
        .withColumn(out, (F.col("_rank") + F.col("_before")).cast("bigint"))
        .select(*df.columns, out)
    )


def previous_by_id(df: DataFrame, by: list[str], id_col: str, carry: list[str], prefix: str = "prev_",
                   block: int = 1 << 20) -> DataFrame:
    """``lag(carry)`` within ``by`` in order of a unique integer id.

    Rows are grouped by blocks of ``block`` consecutive ids, so a window never holds
    more than ``block`` rows; the last row of each block is handed to the next one.
    """
    src = df.withColumn("_block", F.floor(F.col(id_col) / F.lit(block)).cast("bigint"))
    payload = F.struct(*[F.col(c).alias(c) for c in carry])
    last = src.groupBy(*by, "_block").agg(F.max_by(payload, id_col).alias("_last"))
    over_blocks = W.partitionBy(*by).orderBy("_block")
    handed = last.select(*by, "_block", F.lag("_last").over(over_blocks).alias("_handed"))
    inside = W.partitionBy(*by, "_block").orderBy(id_col)
    out = (
        join_keys(src.withColumn("_prev", F.lag(payload).over(inside)), handed, [*by, "_block"])
        .withColumn("_prev", F.coalesce("_prev", "_handed"))
    )
    return out.select(*df.columns, *[F.col(f"_prev.{c}").alias(f"{prefix}{c}") for c in carry])


def cumulative_counts(hist: DataFrame, by: list[str], value: str, n: str = "n", out: str = "before") -> DataFrame:
    """Number of rows with a smaller value, from one (by, value, n) row per distinct value.

    Range partitions are materialised so that their ids stay fixed, then ranked apart.
    """
    ranged = materialize(
        hist.repartitionByRange(*[F.col(b) for b in by], F.col(value)).withColumn("_part", F.spark_partition_id())
    )
    totals = ranged.groupBy(*by, "_part").agg(F.sum(n).alias("_t"))
    before = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*by, "_part", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_off"))
    inside = W.partitionBy(*by, "_part").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    return (
        join_keys(ranged.withColumn("_in", F.coalesce(F.sum(n).over(inside), F.lit(0))), offsets, [*by, "_part"])
        .withColumn(out, (F.col("_in") + F.col("_off")).cast("bigint"))
        .select(*hist.columns, out)
    )


def latest(df: DataFrame, keys: list[str], order: list[str], count_as: str | None = None) -> DataFrame:
    """Last row per key by ``order``; an aggregate, so it combines before the shuffle."""
    row = F.struct(*[F.col(c) for c in df.columns])
    aggs = [F.max_by(row, F.struct(*[F.col(c) for c in order])).alias("_row")]
    if count_as:
        aggs.append((F.count("*") - 1).alias(count_as))
    out = df.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(*aggs)
    return out.select("_row.*", *([count_as] if count_as else []))


def latest_wide(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """As :func:`latest` for wide rows with a unique order column.

    Only keys and order values are aggregated; the wide columns are read for the winners.
    """
    last = df.groupBy(*keys).agg(F.max(order).alias(order))
    return df.join(last, [*keys, order], "left_semi")
