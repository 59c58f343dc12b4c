"""Group and classification metrics.

Every metric is a function of confusion cells.  :func:`cells` is the only step
that reads the prediction rows; its output has one row per (evaluation, group,
label, prediction), whatever the number of rows, so all later steps are small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import join_keys, ratio, wilson

COLLAPSE_SHARE = 0.98
MIN_SEVERE = 30


def rows_of(weight: str | None) -> Column:
    """Number of rows: a plain count, or the sum of a weight when rows are pre-counted cells."""
    return F.count("*") if weight is None else F.sum(weight).cast("bigint")


def rows_if(cond: Column, weight: str | None) -> Column:
    return F.count_if(cond) if weight is None else F.coalesce(F.sum(F.when(cond, F.col(weight))), F.lit(0)).cast("bigint")


def cube(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Row counts over the given columns (column ``n``): the one pass over the rows that all
    metrics of an evaluation can share when it is passed on with ``weight='n'``."""
    return df.groupBy(*by, *columns).agg(F.count("*").alias("n"))


def cells(df: DataFrame, by: list[str], grp: str = "grp", label: str = "label", pred: str = "y_hat",
          extra: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """Confusion cells: row counts per evaluation, group, label and prediction."""
    return df.groupBy(
        *by, F.col(grp).cast("string").alias("grp"), F.col(label).alias("label"), F.col(pred).alias("y_hat"),
        *(extra or []),
    ).agg(rows_of(weight).alias("n"))


def _sum_if(cond: Column, n: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, n)), F.lit(0)).cast("bigint")


def group_stats(cell_df: DataFrame, by: list[str], positive: int = 1) -> DataFrame:
    """Per group: counts, selection rate, TPR, FPR, F1, base rate and accuracy; empty ratios are 0."""
    n, pos, hit = F.col("n"), F.col("label") == positive, F.col("y_hat") == positive
    counts = cell_df.groupBy(*by, "grp").agg(
        F.sum(n).cast("bigint").alias("n"),
        _sum_if(pos & hit, n).alias("tp"),
        _sum_if(~pos & hit, n).alias("fp"),
        _sum_if(pos & ~hit, n).alias("fn"),
        _sum_if(~pos & ~hit, n).alias("tn"),
        _sum_if(F.col("label") == F.col("y_hat"), n).alias("correct"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select(
        *by, "grp", "n", "tp", "fp", "fn", "tn", "correct",
        (tp + fn).alias("positives"),
        ratio(tp + fp, F.col("n"), 0.0).alias("positive_rate"),
        ratio(tp, tp + fn, 0.0).alias("tpr"),
        ratio(fp, fp + tn, 0.0).alias("fpr"),
        ratio(2 * tp, 2 * tp + fp + fn, 0.0).alias("f1"),
        ratio(tp + fn, F.col("n"), 0.0).alias("label_rate"),
        ratio(F.col("correct"), F.col("n"), 0.0).alias("accuracy"),
    )


def _gap(c: str) -> Column:
    """max - min over groups, NULL when fewer than two groups exist."""
    return F.when(F.count("*") >= 2, F.max(c) - F.min(c))


def gap_columns() -> dict[str, Column]:
    """Between-group gaps as aggregates over :func:`group_stats` rows."""
    return {
        "acc_gap": _gap("accuracy"),
        "dpd": _gap("positive_rate"),
        "eod": F.greatest(_gap("tpr"), _gap("fpr")),
        "eopp": F.when(F.min("positives") > 0, _gap("tpr")),
        "f1_spread": _gap("f1"),
        "fpr_gap": _gap("fpr"),
        "label_rate_gap": _gap("label_rate"),
    }


def group_gaps(stats: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    cols = gap_columns()
    return stats.groupBy(*by).agg(F.count("*").alias("n_groups"), *[cols[x].alias(x) for x in names])


def fairness_bundle(df: DataFrame, by: list[str], grp: str = "grp", positive: int = 1, weight: str | None = None) -> DataFrame:
    """All group-fairness metrics of an evaluation in one row, from one pass over the rows."""
    stats = group_stats(cells(df, by, grp, weight=weight), by, positive)
    gaps = gap_columns()
    return stats.groupBy(*by).agg(
        F.sum("n").cast("bigint").alias("n"),
        F.count("*").alias("n_groups"),
        *[gaps[x].alias(x) for x in ("dpd", "eod", "eopp", "f1_spread", "fpr_gap", "label_rate_gap")],
        F.greatest(gaps["dpd"] - gaps["label_rate_gap"], F.lit(0.0)).alias("excess_dpd"),
        F.min("n").alias("min_group_n_observed"),
        F.bool_or(F.col("label_rate").isin(0.0, 1.0)).alias("single_class_group"),
    )


def group_accuracy(df: DataFrame, by: list[str], min_n: int, grp: str = "grp") -> DataFrame:
    """Accuracy per group with its interval; groups thinner than ``min_n`` are marked, not dropped."""
    stats = group_stats(cells(df, by, grp), by)
    lo, hi = wilson("correct", "n")
    return stats.select(*by, "grp", "n", "correct", "accuracy", lo.alias("ci_lower"), hi.alias("ci_upper"),
                        (F.col("n") < min_n).alias("excluded"))


def accuracy_gap(df: DataFrame, by: list[str], min_n: int, grp: str = "grp") -> DataFrame:
    """Worst-group accuracy gap over groups with at least ``min_n`` rows; 0 with fewer than two."""
    g = group_accuracy(df, by, min_n, grp)
    acc = F.when(~F.col("excluded"), F.col("accuracy"))
    kept = F.count(acc)
    return g.groupBy(*by).agg(
        kept.alias("compared_groups"),
        F.count(F.when(F.col("excluded"), 1)).alias("excluded_groups"),
        F.when(kept >= 2, F.max(acc) - F.min(acc)).otherwise(F.lit(0.0)).alias("acc_gap"),
    )


def collapse(df: DataFrame, by: list[str], pred: str = "y_hat", threshold: float = COLLAPSE_SHARE,
             weight: str | None = None) -> DataFrame:
    """Share of the most frequent predicted class and whether it reaches the collapse threshold.

    Ties go to the smaller class.
    """
    counts = df.groupBy(*by, F.col(pred).alias("cls")).agg(rows_of(weight).alias("k"))
    top = F.max(F.struct("k", (-F.col("cls")).alias("neg")))
    return counts.groupBy(*by).agg(top.alias("top"), F.sum("k").alias("n")).select(
        *by,
        (-F.col("top.neg")).alias("majority_class"),
        ratio(F.col("top.k"), F.col("n"), 0.0).alias("majority_share"),
        (ratio(F.col("top.k"), F.col("n"), 0.0) >= threshold).alias("collapsed"),
    )


def robustness_metrics(df: DataFrame, by: list[str], clean: str = "y_hat", robust: str = "y_robust",
                       label: str = "label", floor: float = 0.05, weight: str | None = None) -> DataFrame:
    """Clean and perturbed accuracy, their drop, ratios and the share of rows flipped from right to wrong."""
    ok_c, ok_r = F.col(clean) == F.col(label), F.col(robust) == F.col(label)
    agg = df.groupBy(*by).agg(
        rows_of(weight).alias("n_evaluated"),
        rows_if(ok_c, weight).alias("clean_correct"),
        rows_if(ok_r, weight).alias("robust_correct"),
        rows_if(ok_c & ~ok_r, weight).alias("flipped"),
    )
    n = F.col("n_evaluated")
    ca, ra = ratio(F.col("clean_correct"), n), ratio(F.col("robust_correct"), n)
    (c_lo, c_hi), (r_lo, r_hi) = wilson("clean_correct", "n_evaluated"), wilson("robust_correct", "n_evaluated")
    return agg.select(
        *by, "n_evaluated", "clean_correct", "robust_correct",
        ca.alias("clean_accuracy"), ra.alias("robust_accuracy"), (ca - ra).alias("accuracy_drop"),
        (ra / F.greatest(ca, F.lit(floor))).alias("relative_degradation"),
        F.when(ca > 0, ra / F.when(ca > 0, ca)).alias("degradation_ratio"),
        ratio(F.col("flipped"), n).alias("flip_share_all"),
        c_lo.alias("clean_lo"), c_hi.alias("clean_hi"), r_lo.alias("robust_lo"), r_hi.alias("robust_hi"),
    )


def severe_behavior(df: DataFrame, by: list[str], positive: int = 1, min_severe: int = MIN_SEVERE,
                    label: str = "label", pred: str = "y_hat", severe: str = "severe", weight: str | None = None) -> DataFrame:
    """Missed severe-harm rows, overall misses and benign false alarms; abstains without enough rows."""
    pos, hit, sev = F.col(label) == positive, F.col(pred) == positive, F.col(severe) == 1
    agg = df.groupBy(*by).agg(
        rows_if(pos, weight).alias("pos_n"),
        rows_if(pos & ~hit, weight).alias("pos_missed"),
        rows_if(pos & sev, weight).alias("severe_n"),
        rows_if(pos & sev & ~hit, weight).alias("severe_missed"),
        rows_if(~pos, weight).alias("neg_n"),
        rows_if(~pos & hit, weight).alias("neg_hit"),
    )
    ok = (F.col("pos_n") > 0) & (F.col("severe_n") >= min_severe)
    fnr = ratio(F.col("severe_missed"), F.col("severe_n"))
    overall = ratio(F.col("pos_missed"), F.col("pos_n"))
    lo, hi = wilson("severe_missed", "severe_n")
    return agg.select(
        *by,
        F.when(ok, "EVALUATED").otherwise("INSUFFICIENT_EVIDENCE").alias("status"),
        F.when(F.col("pos_n") == 0, "no_positive_rows").when(~ok, "too_few_severe_rows").otherwise("").alias("flag"),
        F.when(F.col("pos_n") == 0, F.lit(0).cast("bigint")).otherwise(F.col("severe_n")).alias("severe_n"),
        F.when(ok, fnr).alias("severe_fnr"), F.when(ok, lo).alias("severe_lo"), F.when(ok, hi).alias("severe_hi"),
        F.when(ok, overall).alias("overall_fnr"),
        F.when(ok & (overall > 0), fnr / F.when(overall > 0, overall)).alias("fnr_ratio"),
        F.when(ok, 1.0 - overall).alias("harmful_recall"),
        F.when(ok, ratio(F.col("neg_hit"), F.col("neg_n"))).alias("benign_fpr"),
    )


def severe_with_collapse(df: DataFrame, by: list[str], positive: int = 1, min_severe: int = MIN_SEVERE,
                         weight: str | None = None) -> DataFrame:
    """Severe-harm behaviour with the collapse gate: always-positive is refused, never-positive only flagged."""
    b = severe_behavior(df, by, positive, min_severe, weight=weight)
    c = collapse(df, by, weight=weight)
    refused = F.col("collapsed") & (F.col("majority_class") == positive)
    measured = [x for x in b.columns if x not in (*by, "status", "flag")]
    return join_keys(b, c, by).select(
        *by,
        F.when(refused, "INSUFFICIENT_EVIDENCE").otherwise(F.col("status")).alias("status"),
        F.when(F.col("collapsed"), F.concat_ws(";", F.when(~refused & (F.col("flag") != ""), F.col("flag")),
                                               F.lit("constant_predictor"))).otherwise(F.col("flag")).alias("flags"),
        F.when(F.col("collapsed"), F.col("majority_share")).alias("majority_class_share"),
        *[F.when(~refused, F.col(x)).alias(x) for x in measured],
    )


def detector_rates(df: DataFrame, by: list[str], flagged: str = "flagged", truth: str = "truth") -> DataFrame:
    """Confusion, precision, recall and F1 of a detector; ``flagged`` NULL means it abstained."""
    f, t = F.col(flagged), F.col(truth)
    agg = df.groupBy(*by).agg(
        F.count_if(f & t).alias("tp"), F.count_if(f & ~t).alias("fp"),
        F.count_if(~f & t).alias("fn"), F.count_if(~f & ~t).alias("tn"),
        F.count_if(f.isNull()).alias("abstained"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return agg.select(
        *by, "tp", "fp", "fn", "tn", "abstained", p.alias("precision"), r.alias("recall"),
        F.when((p > 0) & (r > 0), 2.0 * p * r / F.when(p + r > 0, p + r))
        .when((p == 0) | (r == 0), F.lit(0.0)).alias("f1"),
    )


def base_rates(df: DataFrame, by: list[str], label: str = "label", positive: int = 1) -> DataFrame:
    """Rows, positives and positive rate per group."""
    return df.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if(F.col(label) == positive).alias("positives"),
        F.round(F.avg((F.col(label) == positive).cast("double")), 6).alias("positive_rate"),
    )
