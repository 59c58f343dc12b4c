"""Seeded sampling, nested label flips, text perturbation and dataset manifests.

All randomness is a hash of (seed, row key), so results do not depend on how the
rows are partitioned and a lost executor changes nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import hash_rank, let, ratio
from .ordering import lowest_hashes

# Replacement characters of the character-swap perturbation.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789"


def char_swap(df: DataFrame, text: str, key: str, seed: int, max_changes: Column | int, out: str = "attacked") -> DataFrame:
    """Replace up to ``max_changes`` distinct letters or digits by another character of the alphabet.

    Positions are a simple random sample (one hash per changed character); the text
    never leaves its row and is split into characters once.  Upper case stays upper case.
    """
    limit = F.lit(max_changes) if isinstance(max_changes, int) else max_changes
    source = F.coalesce(F.col(text), F.lit(""))

    def draw(taken: Column, j: Column) -> Column:
        # sampling without replacement: step j picks among 0..j, a repeat takes j itself
        pick = (hash_rank(seed, key, F.lit("p"), j) % (j + 1)).cast("int")
        return F.concat(taken, F.array(F.when(F.array_contains(taken, pick), j).otherwise(pick)))

    def choose(spots: Column) -> Column:
        k = F.least(limit, F.size(spots))
        steps = F.when(k > 0, F.sequence(F.size(spots) - k, F.size(spots) - 1)).otherwise(F.array().cast("array<int>"))
        drawn = F.aggregate(steps, F.array().cast("array<int>"), draw)
        return F.transform(drawn, lambda o: F.element_at(spots, o + 1))

    def swap(current: Column, at: Column) -> Column:
        old = F.substr(current, at, F.lit(1))
        same = F.position(F.lower(old), F.lit(ALPHABET))
        h = hash_rank(seed, key, F.lit("c"), at)
        plain = (h % len(ALPHABET)).cast("int")
        skip = (h % (len(ALPHABET) - 1)).cast("int")
        index = F.when(same == 0, plain).when(skip >= same - 1, skip + 1).otherwise(skip)
        char = F.substr(F.lit(ALPHABET), index + 1, F.lit(1))
        char = F.when((old == F.upper(old)) & (old != F.lower(old)), F.upper(char)).otherwise(char)
        return F.overlay(current, char, at, F.lit(1))

    spots = F.filter(F.transform(F.split(source, ""), lambda c, i: F.when(c.rlike(r"[\p{L}\p{N}]"), i + 1)),
                     lambda i: i.isNotNull())
    chosen = let(spots, choose)
    return df.withColumn(out, F.aggregate(chosen, F.col(text), swap))


def perturb_coverage(df: DataFrame, by: list[str], text: str = "text", attacked: str = "attacked") -> DataFrame:
    """Rows whose text really changed, and their share."""
    ok = F.coalesce(F.col(text).rlike(r"[\p{L}\p{N}]") & (F.col(attacked) != F.col(text)), F.lit(False))
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(ok).alias("n_perturbed")).select(
        *by, "n", "n_perturbed", (F.col("n") - F.col("n_perturbed")).alias("n_failed"),
        ratio(F.col("n_perturbed"), F.col("n"), 0.0).alias("coverage"))


def without_texts(df: DataFrame, corpora: DataFrame | None, text: str = "text") -> DataFrame:
    """Rows whose exact text does not occur in ``corpora``; copies there are collapsed first."""
    if corpora is None:
        return df
    seen = corpora.select(F.xxhash64(text).alias("_h"), F.col(text).alias("_t")).distinct()
    return df.join(seen, (F.xxhash64(df[text]) == seen["_h"]) & (df[text] == seen["_t"]), "left_anti")


def overlap_counts(df: DataFrame, corpora: dict[str, DataFrame], text: str = "text") -> DataFrame:
    """Rows of ``df`` whose exact text occurs in each named corpus."""
    parts = []
    for name, corpus in corpora.items():
        seen = corpus.select(F.xxhash64(text).alias("_h"), F.col(text).alias("_t")).distinct()
        hit = df.join(seen, (F.xxhash64(df[text]) == seen["_h"]) & (df[text] == seen["_t"]), "left_semi")
        parts.append(hit.agg(F.count("*").alias("overlap")).select(F.lit(name).alias("corpus"), "overlap"))
    return reduce(DataFrame.unionByName, parts)


def stratified_sample(df: DataFrame, key: str, size: int, pos_rate: float, seed: int, exclude: DataFrame | None = None,
                      text: str = "text", label: str = "label") -> DataFrame:
    """``size`` rows with the target share of positives, in seeded order, none with an excluded text."""
    n_pos = round(size * pos_rate)
    rows = without_texts(df, exclude, text).withColumn("_hash", hash_rank(seed, key))
    quota = F.when(F.col(label) == 1, F.lit(n_pos)).otherwise(F.lit(size - n_pos))
    return lowest_hashes(rows, quota, "_hash", [label], [key], max(n_pos, size - n_pos)).drop("_hash")


def quota_sample(df: DataFrame, key: str, cells: list[str], quotas: dict[tuple, int], seed: int, text: str = "text",
                 exclude: DataFrame | None = None) -> DataFrame:
    """Text-unique rows per cell up to its quota; copies of a text keep the row that comes first in seeded order."""
    cols = df.columns
    rows = without_texts(df, exclude, text).withColumn("_hash", hash_rank(seed, key))
    # copies are told apart on keys alone: the first key of a text stays; bodies are read for the winners only
    first = rows.groupBy(F.sha2(text, 256).alias("_th")).agg(F.min(F.struct("_hash", F.col(key).alias("_k"))).alias("_f"))
    cell = rows.select(key, "_hash", *[c for c in cells if c != key], F.sha2(text, 256).alias("_th"))
    unique = cell.join(first, cell["_th"].eqNullSafe(first["_th"]) & (cell["_hash"] == first["_f._hash"]) & (cell[key] == first["_f._k"]), "left_semi")
    quota = F.lit(0)
    for values, n in quotas.items():
        cond = reduce(lambda a, b: a & b, [F.col(c) == x for c, x in zip(cells, values, strict=True)])
        quota = F.when(cond, n).otherwise(quota)
    chosen = lowest_hashes(unique, quota, "_hash", cells, [key], max(quotas.values(), default=0))
    return rows.join(chosen.select(key, "_hash"), [key, "_hash"], "left_semi").select(*cols)


def quota_shortfall(sample: DataFrame, cells: list[str], quotas: dict[tuple, int]) -> DataFrame:
    """Rows missing per cell (0 = quota met)."""
    spark = sample.sparkSession
    schema = ", ".join(f"{c} {sample.schema[c].dataType.simpleString()}" for c in cells) + ", quota long"
    want = spark.createDataFrame([(*k, n) for k, n in quotas.items()], schema)
    got = sample.groupBy(*cells).agg(F.count("*").alias("drawn"))
    return want.join(got, cells, "left").select(
        *cells, "quota", F.coalesce("drawn", F.lit(0)).alias("drawn"),
        (F.col("quota") - F.coalesce("drawn", F.lit(0))).alias("shortfall"))


def seeded_slice(df: DataFrame, key: str, n: int, seed: int, exclude: DataFrame | None = None, text: str = "text") -> DataFrame:
    """First ``n`` rows in seeded order."""
    rows = without_texts(df, exclude, text).withColumn("_hash", hash_rank(seed, key))
    return lowest_hashes(rows, F.lit(n), "_hash", None, [key], n).drop("_hash")


def flip_labels(df: DataFrame, key: str, where: Column, to: int, rate: float, seed: int, label: str = "label",
                mark: str = "flipped") -> DataFrame:
    """Set ``label`` on the first round(n * rate) candidates in one seeded order.

    Lower rates flip a subset of what higher rates flip.  Only the cut-off of the
    seeded order is computed; every row is then judged on its own, with no join on
    the row key.
    """
    src = df.withColumn("_hash", hash_rank(seed, key)).withColumn("_cand", F.coalesce(where, F.lit(False)))
    cut = _flip_cut(src, key, [rate])
    flip = F.col("_cand") & F.coalesce(
        (F.col("_hash") < F.col("_ch")) | ((F.col("_hash") == F.col("_ch")) & (F.col(key) <= F.col("_ck"))), F.lit(False))
    # the cut is one row
    return src.join(F.broadcast(cut.drop("rate"))).withColumn(mark, flip).withColumn(
        label, F.when(F.col(mark), F.lit(to)).otherwise(F.col(label))).drop("_hash", "_cand", "_ch", "_ck")


def _flip_cut(src: DataFrame, key: str, rates: list[float]) -> DataFrame:
    """(hash, key) of the last flipped candidate per rate: one row per rate."""
    cand = src.filter("_cand").select("_hash", F.col(key).alias("_key"))
    grid = src.sparkSession.createDataFrame([(float(r),) for r in rates], "rate double")
    hist = cand.groupBy(F.shiftright("_hash", 16).alias("_slice")).agg(F.count("*").alias("_c"))
    # at most 65,536 slices; their sum is the number of candidates, so rows are not counted again
    upto = W.orderBy("_slice").rowsBetween(W.unboundedPreceding, W.currentRow)
    cum = hist.withColumns({"_cum": F.sum("_c").over(upto), "_n": F.sum("_c").over(W.partitionBy())})
    each = cum.withColumn("rate", F.explode(F.array(*[F.lit(float(r)) for r in rates])))
    n_flip = F.bround(F.col("_n") * F.col("rate"), 0).cast("bigint")
    edge = each.filter((F.col("_cum") - F.col("_c") < n_flip) & (F.col("_cum") >= n_flip)).select(
        "rate", "_slice", (n_flip - (F.col("_cum") - F.col("_c"))).alias("_within"))
    inside = cand.withColumn("_slice", F.shiftright("_hash", 16)).join(F.broadcast(edge), "_slice")  # a row per rate
    rank = W.partitionBy("rate", "_slice").orderBy("_hash", "_key")
    last = inside.withColumn("_r", F.row_number().over(rank)).filter(F.col("_r") == F.col("_within")).select(
        "rate", F.col("_hash").alias("_ch"), F.col("_key").alias("_ck"))
    return grid.join(F.broadcast(last), "rate", "left")


def flip_chain(df: DataFrame, key: str, specs: list[tuple[str, Column, int, float, int]], label: str = "label") -> DataFrame:
    """Several flips in sequence: (mark, where, to, rate, seed) each on the outcome of the one before.

    Each cut-off is one row; it is fetched and fixed as a literal, so a flip is a column expression, the result is one
    scan, and the cut-offs take two scans a flip, however long the chain is.
    """
    for mark, where, to, rate, seed in specs:
        src = df.withColumn("_hash", hash_rank(seed, key)).withColumn("_cand", F.coalesce(where, F.lit(False)))
        cut = _flip_cut(src, key, [rate]).first()
        last = [F.lit(cut[c]).cast(t) for c, t in (("_ch", src.schema["_hash"].dataType), ("_ck", src.schema[key].dataType))]
        upto = (F.col("_hash") < last[0]) | ((F.col("_hash") == last[0]) & (F.col(key) <= last[1]))
        df = src.withColumn(mark, F.col("_cand") & F.coalesce(upto, F.lit(False))).withColumn(
            label, F.when(F.col(mark), F.lit(to)).otherwise(F.col(label))).drop("_hash", "_cand")
    return df


def severity_grid(df: DataFrame, key: str, where: Column, to: int, rates: list[float], seed: int, label: str = "label") -> DataFrame:
    """The same table at several flip rates; the seeded order is computed once."""
    src = df.withColumn("_hash", hash_rank(seed, key)).withColumn("_cand", F.coalesce(where, F.lit(False)))
    cuts = F.broadcast(_flip_cut(src, key, rates))  # one row per rate
    flip = F.col("_cand") & F.coalesce(
        (F.col("_hash") < F.col("_ch")) | ((F.col("_hash") == F.col("_ch")) & (F.col(key) <= F.col("_ck"))), F.lit(False))
    return src.join(cuts).withColumn("flipped", flip).withColumn(
        label, F.when(F.col("flipped"), F.lit(to)).otherwise(F.col(label))).drop("_hash", "_cand", "_ch", "_ck")


def dataset_manifest(df: DataFrame, by: list[str], key: str, cols: list[str], label: str = "label",
                     flipped: str | None = None) -> DataFrame:
    """Size, positives, rate, flipped rows and an order-free content digest.

    A row's fields are written with their lengths, so no two different rows read alike, and
    hashed with SHA-256.  The digest adds up the hash's eight 32-bit parts apart from each
    other: the sums combine map-side and do not depend on row order.
    """
    def field(c: str) -> Column:
        v = F.col(c).cast("string")
        return F.coalesce(F.concat(F.char_length(v).cast("string"), F.lit(":"), v), F.lit("-"))

    body = F.sha2(F.concat(*[field(c) for c in [key, *cols]]), 256)
    parts = [F.conv(F.substring(body, 1 + 8 * k, 8), 16, 10).cast("bigint") for k in range(8)]
    return df.groupBy(*by).agg(
        F.count("*").alias("size"), F.count_if(F.col(label) == 1).alias("positives"),
        (F.count_if(F.col(flipped)) if flipped else F.sum(F.lit(0))).alias("rows_flipped"),
        *[F.sum(p.cast("decimal(20,0)")).alias(f"_s{k}") for k, p in enumerate(parts)],
    ).select(*by, "size", "positives", ratio(F.col("positives"), F.col("size"), 0.0).alias("positive_rate"),
             "rows_flipped", F.sha2(F.concat_ws(":", *[F.col(f"_s{k}").cast("string") for k in range(8)]), 256).alias("digest"))


def stability_report(df: DataFrame, by: list[str], label: str = "label", clean: str = "y_hat", robust: str = "y_robust",
                     confidence: str = "confidence") -> DataFrame:
    """Predicted and true positive rate, mean and lowest confidence, share of changed predictions."""
    return df.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg((F.col(clean) == 1).cast("double")).alias("predicted_positive_rate"),
        F.avg((F.col(label) == 1).cast("double")).alias("true_positive_rate"),
        F.avg(confidence).alias("mean_confidence"), F.min(confidence).alias("min_confidence"),
        F.avg((F.col(clean) == F.col(label)).cast("double")).alias("clean_accuracy"),
        F.avg((F.col(robust) == F.col(label)).cast("double")).alias("robust_accuracy"),
        F.avg((F.col(clean) != F.col(robust)).cast("double")).alias("flip_rate"))
