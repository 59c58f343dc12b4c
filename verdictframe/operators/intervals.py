"""Bootstrap confidence intervals from cell counts.

Resampling n rows with replacement only changes how often each confusion cell is
drawn, so the rows are read once (for the cells) and replicates are built from the
cells.  Two samplers with the same distribution:

* ``multinomial`` (default): counts of a replicate are one multinomial draw; cost
  does not depend on the number of rows.
* ``hash``: n hashed draws per replicate, reproducible in SQL; meant for small n.

All statistics of an evaluation are computed from one replicate table.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import join_keys, ratio
from .metrics import cells, gap_columns, group_stats, rows_of

REPLICATES = 1000
_BLOCK = 4096  # cells per block of a mean
_DRAWS = 1 << 16  # hashed draws per generated row


def _cell_vectors(cell_df: DataFrame, by: list[str], cell_cols: list[str]) -> DataFrame:
    """One row per evaluation: its cells in a fixed order and their running counts."""
    item = F.struct(*cell_cols, F.col("n").cast("bigint").alias("n"))
    packed = cell_df.groupBy(*by).agg(F.sort_array(F.collect_list(item)).alias("_cells"))
    running = F.aggregate(
        F.col("_cells"), F.array().cast("array<bigint>"),
        lambda acc, c: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + c["n"])))
    return packed.withColumn("_cum", running).withColumn("_n", F.element_at("_cum", -1))


def _hash_counts(vectors: DataFrame, by: list[str], b: int, seed: int) -> DataFrame:
    """(evaluation, replicate, cell index, count) from hashed draws: ``hash_rank(seed, b, k) % n`` for k below n.

    Few evaluations make few rows, so blocks of draws are dealt to all cores before they are hashed; a task holds one block
    and hands on its counts.
    """
    rep = vectors.select(*by, "_cum", "_n", F.explode(F.sequence(F.lit(0), F.lit(b - 1))).alias("b"))
    blocks = rep.withColumn("_j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_n") - 1) / _DRAWS))))
    # a given number of partitions: by their bytes, which say nothing of the work, they would all be merged into one
    dealt = blocks.repartition(4 * vectors.sparkSession.sparkContext.defaultParallelism, "b", "_j", *by)
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in vectors.select(*by).schema)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [batch.column(i) for i in range(len(by))]
            for row, (cum, n, rep_no, j) in enumerate(zip(*(batch.column(len(by) + i).to_pylist() for i in range(4)), strict=True)):
                head = hashlib.md5(f"{seed}:{rep_no}:".encode())
                first = []
                for k in range(j * _DRAWS, min(n, (j + 1) * _DRAWS)):
                    h = head.copy()
                    h.update(b"%d" % k)
                    first.append(h.digest()[:4])
                u = np.frombuffer(b"".join(first), ">u4").astype(np.int64) % n
                cell, count = np.unique(np.searchsorted(np.asarray(cum, np.int64), u, side="right"), return_counts=True)
                at = pa.array(np.full(len(cell), row))
                yield pa.RecordBatch.from_arrays(
                    [*(c.take(at) for c in keys), pa.array(np.full(len(cell), rep_no, np.int32)), pa.array(cell, pa.int32()), pa.array(count, pa.int64())],
                    names=[*by, "b", "_cell", "n"])

    drawn = dealt.select(*by, "_cum", "_n", "b", "_j").mapInArrow(draw, f"{fields}b int, _cell int, n bigint")
    return drawn.groupBy(*by, "b", "_cell").agg(F.sum("n").alias("n"))


def _multinomial_counts(vectors: DataFrame, by: list[str], b: int, seed: int) -> DataFrame:
    """(evaluation, replicate, cell index, count); the generator is seeded from (seed, evaluation, block)."""
    step = 50
    key = F.to_json(F.struct(*by))
    src = vectors.select(
        *by, key.alias("_key"), F.transform("_cells", lambda c: c["n"]).alias("_counts"),
        F.explode(F.sequence(F.lit(0), F.lit(b - 1), F.lit(step))).alias("_from"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.select(*by).schema)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                counts = np.asarray(row["_counts"], dtype=np.int64)
                rng = np.random.default_rng([seed, zlib.crc32(row["_key"].encode()), int(row["_from"])])
                size = min(step, b - int(row["_from"]))
                got = rng.multinomial(int(counts.sum()), counts / counts.sum(), size=size)
                yield pd.DataFrame({
                    **{c: [row[c]] * size for c in by}, "b": np.arange(size, dtype=np.int32) + int(row["_from"]),
                    "_drawn": list(got)})

    drawn = src.mapInPandas(draw, f"{fields}, b int, _drawn array<bigint>")
    return drawn.select(*by, "b", F.posexplode("_drawn").alias("_cell", "n")).filter("n > 0")


def replicate_cells(cell_df: DataFrame, by: list[str], cell_cols: list[str], b: int = REPLICATES, seed: int = 42,
                    sampler: str = "multinomial") -> DataFrame:
    """Resampled cells: (evaluation, replicate b, cell columns, n)."""
    vectors = _cell_vectors(cell_df, by, cell_cols)
    draw = {"multinomial": _multinomial_counts, "hash": _hash_counts}[sampler]
    names = vectors.select(*by, F.posexplode("_cells").alias("_cell", "_c")).select(
        *by, "_cell", *[F.col(f"_c.{c}").alias(c) for c in cell_cols])
    return join_keys(draw(vectors, by, b, seed), names, [*by, "_cell"]).select(*by, "b", *cell_cols, "n")


def percentile_bounds(values: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """2.5 % and 97.5 % bounds by sorted index; undefined replicates are ignored.

    The array holds one entry per replicate, so it is bounded by their number.
    """
    arr = values.groupBy(*by).agg(F.sort_array(F.collect_list(value)).alias("_v"))
    m = F.size("_v")
    lo = F.greatest(F.lit(0), F.floor(m * 0.025).cast("int"))
    hi = F.least(m - 1, (F.ceil(m * 0.975) - 1).cast("int"))
    return arr.select(
        *by, m.alias("replicates"),
        F.when(m > 0, F.round(F.get("_v", lo), 6)).alias("ci_lower"),
        F.when(m > 0, F.round(F.get("_v", hi), 6)).alias("ci_upper"))


def _unpivot(df: DataFrame, ids: list[str], names: list[str], value: str) -> DataFrame:
    return df.unpivot([F.col(i) for i in ids], [F.col(n) for n in names], "stat", value)


def _with_point(point: DataFrame, bounds: DataFrame, by: list[str]) -> DataFrame:
    """Point and bounds; without a point or a valid replicate the bounds are NULL."""
    ok = F.col("point").isNotNull()
    return point.join(bounds, [*by, "stat"], "left").select(
        *by, "stat", F.round("point", 6).alias("point"),
        F.when(ok, F.col("ci_lower")).alias("ci_lower"), F.when(ok, F.col("ci_upper")).alias("ci_upper"),
        F.coalesce("replicates", F.lit(0)).alias("replicates"))


def fairness_ci(df: DataFrame, by: list[str], stats: list[str], grp: str = "grp", b: int = REPLICATES, seed: int = 42,
                min_group_n: int = 1, sampler: str = "multinomial", extra_stats: dict[str, Column] | None = None,
                weight: str | None = None) -> DataFrame:
    """Interval per evaluation and statistic; thin groups are dropped inside every replicate.

    ``extra_stats`` adds aggregates over the per-group statistics of a replicate.
    """
    available = {**gap_columns(), **(extra_stats or {})}
    cell_df = cells(df, by, grp, weight=weight)

    def gaps(c: DataFrame, keys: list[str]) -> DataFrame:
        kept = group_stats(c, keys).filter(F.col("n") >= min_group_n)
        wide = kept.groupBy(*keys).agg(*[available[s].cast("double").alias(s) for s in stats])
        return wide

    point = _unpivot(gaps(cell_df, by), by, stats, "point")
    reps = replicate_cells(cell_df, by, ["grp", "label", "y_hat"], b, seed, sampler)
    bounds = percentile_bounds(_unpivot(gaps(reps, [*by, "b"]), [*by, "b"], stats, "value"), [*by, "stat"])
    return _with_point(point, bounds, by)


def accuracy_drop_ci(df: DataFrame, by: list[str], b: int = REPLICATES, seed: int = 42, sampler: str = "multinomial",
                     clean: str = "y_hat", robust: str = "y_robust", label: str = "label", weight: str | None = None) -> DataFrame:
    """Paired interval of clean minus perturbed accuracy."""
    cell_df = df.groupBy(*by, (F.col(clean) == F.col(label)).cast("int").alias("clean_ok"),
                         (F.col(robust) == F.col(label)).cast("int").alias("robust_ok")).agg(rows_of(weight).alias("n"))

    def drop(c: DataFrame, keys: list[str], name: str) -> DataFrame:
        n = F.sum("n")
        return c.groupBy(*keys).agg(
            (ratio(F.sum(F.col("clean_ok") * F.col("n")), n) - ratio(F.sum(F.col("robust_ok") * F.col("n")), n)).alias(name)
        ).withColumn("stat", F.lit("accuracy_drop"))

    reps = replicate_cells(cell_df, by, ["clean_ok", "robust_ok"], b, seed, sampler)
    bounds = percentile_bounds(drop(reps, [*by, "b"], "value"), [*by, "stat"])
    return _with_point(drop(cell_df, by, "point"), bounds, by)


def _block_cells(cell_df: DataFrame, by: list[str], size: int) -> DataFrame:
    """Cells (by, value, n) packed into blocks of about ``size``, dealt by a hash of the value: by, _block, _values, _counts, _total."""
    many = cell_df.groupBy(*by).agg(F.ceil(F.count("*") / size).alias("_blocks"))
    dealt = join_keys(cell_df, many, by).withColumn("_block", F.pmod(F.xxhash64("value"), F.col("_blocks")).cast("int"))
    cell = F.sort_array(F.collect_list(F.struct(F.col("value").cast("double").alias("v"), F.col("n").cast("bigint").alias("n"))))
    packed = dealt.groupBy(*by, "_block").agg(cell.alias("_c"), F.sum("n").alias("_total"))
    return packed.select(*by, "_block", F.transform("_c", lambda c: c["v"]).alias("_values"), F.transform("_c", lambda c: c["n"]).alias("_counts"), "_total")


def _seed_of(seed: int, key: str, *more: int) -> np.random.Generator:
    return np.random.default_rng([seed, zlib.crc32(key.encode()), *more])


def replicate_sums(cell_df: DataFrame, by: list[str], b: int, seed: int, block: int = _BLOCK, step: int = 500) -> DataFrame:
    """(by, replicate b, sum of the resampled values) for keys with any number of distinct values.

    A multinomial draw is made in two levels: first how many draws fall to each block of cells, then the draw inside each
    block, on its own task and summed at once. Only block totals of a key meet, and no array is longer than a block.
    """
    key = F.to_json(F.struct(*by)) if by else F.lit("")
    blocks = _block_cells(cell_df, by, block)
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in blocks.select(*by).schema)
    totals = blocks.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_block", "_total"))).alias("_t"))
    starts = F.explode(F.sequence(F.lit(0), F.lit(b - 1), F.lit(step))).alias("_from")
    first = totals.select(*by, key.alias("_key"), F.transform("_t", lambda t: t["_block"]).alias("_ids"), F.transform("_t", lambda t: t["_total"]).alias("_sizes"), starts)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                sizes = np.asarray(row["_sizes"], dtype=np.int64)
                drawn = _seed_of(seed, row["_key"], int(row["_from"])).multinomial(int(sizes.sum()), sizes / sizes.sum(), size=min(step, b - int(row["_from"])))
                yield pd.DataFrame({**{c: [row[c]] * len(sizes) for c in by}, "_block": np.asarray(row["_ids"], np.int32), "_from": np.int32(row["_from"]), "_drawn": list(drawn.T)})

    def inside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                counts, drawn = np.asarray(row["_counts"], dtype=np.int64), np.asarray(row["_drawn"], dtype=np.int64)
                rng, sums = _seed_of(seed, row["_key"], int(row["_from"]), 1 + int(row["_block"])), []
                for i in range(0, len(drawn), 50):  # replicates held at once
                    sums.append(rng.multinomial(drawn[i : i + 50], counts / counts.sum()) @ np.asarray(row["_values"]))
                out.append({**{c: row[c] for c in by}, "_from": np.int32(row["_from"]), "_sums": np.concatenate(sums)})
            yield pd.DataFrame(out)

    dealt = first.mapInPandas(deal, f"{fields}_block int, _from int, _drawn array<bigint>")
    keyed = join_keys(dealt, blocks, [*by, "_block"]).withColumn("_key", key).select(*by, "_key", "_block", "_from", "_drawn", "_values", "_counts")
    parts = keyed.mapInPandas(inside, f"{fields}_from int, _sums array<double>")
    return parts.select(*by, "_from", F.posexplode("_sums").alias("_i", "_s")).groupBy(*by, (F.col("_from") + F.col("_i")).alias("b")).agg(F.sum("_s").alias("total"))


def mean_ci(df: DataFrame, by: list[str], value: str, b: int = 5000, seed: int = 0, sampler: str = "multinomial") -> DataFrame:
    """Interval of a mean over items; plain index bounds floor(0.025 B) and floor(0.975 B) - 1."""
    cell_df = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("value")).agg(F.count("*").alias("n"))
    if sampler == "multinomial":
        size = cell_df.groupBy(*by).agg(F.sum("n").alias("_n"))
        means = join_keys(replicate_sums(cell_df, by, b, seed), size, by).withColumn("mean", F.col("total") / F.col("_n"))
    else:
        reps = replicate_cells(cell_df, by, ["value"], b, seed, sampler)
        means = reps.groupBy(*by, "b").agg((F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean"))
    arr = means.groupBy(*by).agg(F.sort_array(F.collect_list("mean")).alias("_v"))
    point = cell_df.groupBy(*by).agg((F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean"), F.sum("n").alias("n"))
    return point.join(arr, by).select(
        *by, "n", "mean", F.get("_v", F.lit(int(0.025 * b))).alias("ci_lower"),
        F.get("_v", F.lit(int(0.975 * b) - 1)).alias("ci_upper"))
