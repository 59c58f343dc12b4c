"""Ordered gate cascades: the first condition that holds decides, and weak evidence abstains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import first_case, is_missing, join_keys, reasons, strip
from ..session import keep
from .intervals import accuracy_drop_ci, fairness_ci
from .metrics import cells, collapse, cube, fairness_bundle, group_stats, robustness_metrics, severe_behavior

# Thresholds of the rules.
EPSILON = 0.02
FAIR_CI_WIDE = 0.15
DROP_EPSILON = 0.05
ROB_CI_WIDE = 0.20
ROB_MIN_N = 100
LABEL_COMPAT_MIN = 0.95
CLEAN_FLOOR = 0.20
SEVERE_TOLERANCE = 0.50
BENIGN_FPR_FLOOR = 0.30
FAIR_RISK, FAIR_PERF_RISK, ROB_RISK, SEVERE_RISK = "F-FAIR-EOPP", "F-FAIR-PERF", "R-ROB-PERT", "S-BEH-SEVERE-MISS"


def eligibility(cell_df: DataFrame, by: list[str], min_group_n: int, positive: int = 1) -> DataFrame:
    """Eligible groups and the first failed gate (too few groups, or a group without positives)."""
    g = group_stats(cell_df, by, positive)
    big = F.col("n") >= min_group_n
    return g.groupBy(*by).agg(
        F.count_if(big).alias("eligible_groups"),
        F.coalesce(F.min(F.when(big, F.col("positives"))), F.lit(0).cast("bigint")).alias("min_positives"),
    ).withColumn("failed_gate", first_case((F.col("eligible_groups") < 2, "G-FAIR-N-GROUP"),
                                           (F.col("min_positives") < 1, "G-FAIR-POSITIVES")))


def finding(point: Column, lower: Column, upper: Column) -> Column:
    """Binary fairness finding from the interval of the opportunity gap."""
    return first_case(
        (point.isNull() | lower.isNull() | upper.isNull(), "INSUFFICIENT_EVIDENCE"),
        (point <= EPSILON, "NO_MATERIAL_DISPARITY"), (lower > EPSILON, "FAIRNESS_RISK"),
        default="DISPARITY_OBSERVED")


def aspect_of(found: Column) -> Column:
    return first_case((found == "INSUFFICIENT_EVIDENCE", "not_scored"), (found == "NO_MATERIAL_DISPARITY", "no_material_risk"),
                      (found == "FAIRNESS_RISK", "risk_detected"), default="disparity_observed")


def fairness_mode(df: DataFrame, by: list[str], label: str = "label") -> DataFrame:
    """Number of target classes and the rule set that applies."""
    return df.groupBy(*by, F.col(label).alias("_l")).agg(F.count("*").alias("_n")).groupBy(*by).agg(
        F.count("_l").alias("n_classes")).withColumn("mode", first_case(
            (F.col("n_classes") < 2, "fail"), (F.col("n_classes") == 2, "binary"), default="multiclass"))


def binary_verdict(df: DataFrame, by: list[str], min_group_n: int, grp: str = "grp", b: int = 1000, seed: int = 42,
                   sampler: str = "multinomial", weight: str | None = None) -> DataFrame:
    """Binary fairness verdict per evaluation: status, finding, gates, flags and confidence."""
    if weight is None:  # rows are counted once and the counts kept; all that follows shares them
        df, weight = keep(cube(df, by, [grp, "label", "y_hat"])), "n"
    names = ["dpd", "eod", "f1_spread", "eopp"]
    wide = fairness_ci(df, by, names, grp, b, seed, min_group_n, sampler, weight=weight).groupBy(*by).agg(*[
        F.first(F.when(F.col("stat") == s, F.col(c)), ignorenulls=True).alias(f"{s}_{c}")
        for s in names for c in ("point", "ci_lower", "ci_upper")])
    base = fairness_bundle(df, by, grp, weight=weight).select(*by, "n", "min_group_n_observed", "single_class_group")
    joined = (
        base.transform(join_keys, eligibility(cells(df, by, grp, weight=weight), by, min_group_n), by)
        .transform(join_keys, collapse(df, by, weight=weight).select(*by, "collapsed"), by).transform(join_keys, wide, by, "left"))
    gate = F.col("failed_gate")
    point, lo, hi = (F.when(gate.isNull(), F.col(f"eopp_{c}")) for c in ("point", "ci_lower", "ci_upper"))
    raw = finding(point, lo, hi)
    too_wide = (hi - lo) > FAIR_CI_WIDE
    abstained = F.col("collapsed") | (raw == "INSUFFICIENT_EVIDENCE")
    wide_of = lambda s: (F.col(f"{s}_ci_upper") - F.col(f"{s}_ci_lower")) > FAIR_CI_WIDE
    thin = F.col("min_group_n_observed") < min_group_n
    measured = ~F.col("collapsed")
    return joined.select(
        *by,
        F.when(abstained, "INSUFFICIENT_EVIDENCE").otherwise("EVALUATED").alias("status"),
        first_case((abstained, "INSUFFICIENT_EVIDENCE"), (too_wide, "INSUFFICIENT_EVIDENCE"), default=raw).alias("finding"),
        first_case((abstained, "not_scored"), (too_wide, "mapping_blocked"), default=aspect_of(raw)).alias("aspect_scoring"),
        F.when(~abstained & ~too_wide & (raw == "FAIRNESS_RISK"), FAIR_RISK).alias("risk"),
        first_case((F.col("collapsed"), "constant_predictor"), (gate.isNotNull(), gate),
                   (raw == "INSUFFICIENT_EVIDENCE", "G-FAIR-CI-MISSING"), (too_wide, "G-FAIR-CI-WIDE")).alias("failed_gate"),
        reasons((F.col("collapsed"), "constant_predictor"), (measured & thin, "thin_groups_excluded"),
                (measured & thin, "insufficient_slice_size"), (measured & wide_of("dpd"), "wide_ci_dp"),
                (measured & wide_of("eod"), "wide_ci_eo"), (measured & wide_of("f1_spread"), "wide_ci_f1"),
                (measured & F.col("single_class_group"), "group_single_label_class"),
                (measured & (raw == "INSUFFICIENT_EVIDENCE"), "insufficient_fairness_evidence"),
                (measured & too_wide, "wide_ci_eopp")).alias("flags"),
        F.when(measured, point).alias("eopp"), F.when(measured, lo).alias("eopp_lower"), F.when(measured, hi).alias("eopp_upper"),
        first_case((abstained, 0.45), (too_wide, 0.75), (thin, 0.75), default=0.85).alias("confidence"))


def multiclass_verdict(df: DataFrame, by: list[str], min_total_n: int, min_group_n: int, grp: str = "grp", b: int = 1000,
                       seed: int = 42, sampler: str = "multinomial") -> DataFrame:
    """Accuracy-gap verdict for more than two classes."""
    df = keep(cube(df, by, [grp, "label", "y_hat"]))
    ci = fairness_ci(df, by, ["acc_gap"], grp, b, seed, min_group_n, sampler, weight="n").drop("stat")
    g = group_stats(cells(df, by, grp, weight="n"), by)
    shape = g.groupBy(*by).agg(F.sum("n").alias("n"), F.count_if(F.col("n") >= min_group_n).alias("compared"),
                               F.count_if(F.col("n") < min_group_n).alias("excluded"))
    j = shape.join(ci, by, "left")
    few, thin = F.col("n") < min_total_n, F.col("compared") < 2
    no_ci = F.col("ci_lower").isNull() | F.col("ci_upper").isNull()
    wide = (F.col("ci_upper") - F.col("ci_lower")) > FAIR_CI_WIDE
    fires = F.coalesce((F.col("point") > EPSILON) & (F.col("ci_lower") > EPSILON), F.lit(False))
    return j.select(
        *by, "n", "compared", "excluded",
        F.when(few | thin | no_ci, "INSUFFICIENT_EVIDENCE").otherwise("EVALUATED").alias("status"),
        first_case((few | thin | no_ci, "not_scored"), (wide, "mapping_blocked"), (fires, "scored_risk"),
                   default="no_material_risk").alias("aspect_scoring"),
        first_case((few, "G-FAIR-N-TOTAL"), (thin, "G-FAIR-N-GROUP"), (no_ci, None), (wide, "G-FAIR-CI-WIDE")).alias("failed_gate"),
        F.when(~few & ~thin & ~no_ci & ~wide & fires, FAIR_PERF_RISK).alias("risk"),
        F.when(~few & ~thin, F.col("point")).alias("acc_gap"),
        F.when(~few & ~thin, F.col("ci_lower")).alias("ci_lower"), F.when(~few & ~thin, F.col("ci_upper")).alias("ci_upper"),
        first_case((few | thin | no_ci, 0.45), (wide, 0.75), (fires, 0.85), default=0.8).alias("confidence"))


def robustness_verdict(df: DataFrame, by: list[str], label_fraction: Column, coverage: Column, domain_mismatch: Column,
                       allow_mismatch: Column, b: int = 1000, seed: int = 42, sampler: str = "multinomial",
                       weight: str | None = None) -> DataFrame:
    """Robustness verdict; the four inputs are aggregates over the rows of an evaluation."""
    side = df.groupBy(*by).agg(label_fraction.alias("label_fraction"), coverage.alias("coverage"),
                               domain_mismatch.alias("mismatch"), allow_mismatch.alias("allowed"))
    if weight is None:
        df, weight = keep(cube(df, by, ["label", "y_hat", "y_robust"])), "n"
    ci = accuracy_drop_ci(df, by, b, seed, sampler, weight=weight).drop("stat", "replicates")
    j = (
        robustness_metrics(df, by, weight=weight).transform(join_keys, side, by)
        .transform(join_keys, collapse(df, by, weight=weight).select(*by, "collapsed"), by).transform(join_keys, ci, by, "left"))
    gates = [
        (F.col("mismatch") & ~F.col("allowed"), "G-ROB-DOMAIN"),
        (F.col("label_fraction") < LABEL_COMPAT_MIN, "G-ROB-LABEL-COMPAT"),
        (F.col("n_evaluated") < ROB_MIN_N, "G-ROB-N-EVAL"),
        (F.col("collapsed"), "G-ROB-CONSTANT-PREDICTOR"),
        (F.col("coverage") < 1.0, "G-ROB-PERT-COVERAGE"),
        (F.col("ci_lower").isNull() | F.col("ci_upper").isNull(), "missing_bootstrap_ci"),
        (F.col("clean_accuracy") < CLEAN_FLOOR, "G-ROB-CLEAN-FLOOR"),
        ((F.col("ci_upper") - F.col("ci_lower")) > ROB_CI_WIDE, "G-ROB-CI-WIDE"),
        (F.col("mismatch"), "domain_override"),
    ]
    stage = first_case(*gates)
    abstain = stage.isin("G-ROB-DOMAIN", "G-ROB-LABEL-COMPAT", "G-ROB-N-EVAL", "G-ROB-CONSTANT-PREDICTOR",
                         "G-ROB-PERT-COVERAGE", "missing_bootstrap_ci")
    fires = F.coalesce((F.col("point") > DROP_EPSILON) & (F.col("ci_lower") > DROP_EPSILON), F.lit(False))
    abstain = F.coalesce(abstain, F.lit(False))
    return j.select(
        *by, "n_evaluated",
        F.when(abstain, "INSUFFICIENT_EVIDENCE").otherwise("EVALUATED").alias("status"),
        first_case((abstain, "not_scored"), (stage.isNotNull(), "mapping_blocked"), (fires, "scored_risk"),
                   default="no_material_risk").alias("aspect_scoring"),
        stage.alias("stage"), reasons(*gates).alias("all_gates"),
        F.when(stage.isNull() & fires, ROB_RISK).alias("risk"),
        F.when(~abstain, F.col("point")).alias("accuracy_drop"),
        F.when(~abstain, F.col("ci_lower")).alias("ci_lower"), F.when(~abstain, F.col("ci_upper")).alias("ci_upper"),
        first_case((abstain, 0.45), (stage.isNotNull(), 0.75), (fires, 0.85), default=0.8).alias("confidence"))


def severe_miss(df: DataFrame, by: list[str], tolerances: list[float] | None = None, weight: str | None = None) -> DataFrame:
    """Severe-miss trigger at one or several tolerances (sensitivity grid)."""
    grid = F.array(*[F.lit(float(t)) for t in (tolerances or [SEVERE_TOLERANCE])])
    b = severe_behavior(df, by, weight=weight).withColumn("tolerance", F.explode(grid))
    suppressed = F.coalesce(F.col("benign_fpr") > BENIGN_FPR_FLOOR, F.lit(False))
    over = F.coalesce((F.col("severe_fnr") > F.col("tolerance")) & (F.col("severe_lo") > F.col("tolerance")), F.lit(False))
    return b.select(*by, "tolerance", "status", "severe_fnr", "severe_lo", "benign_fpr",
                    suppressed.alias("suppressed"), (over & ~suppressed).alias("fires"))


# --- contract validation -----------------------------------------------------


def observed_values(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Distinct non-missing trimmed values."""
    return df.filter(~is_missing(column)).select(*by, strip(column).alias("value")).distinct()


def validate_mapping(mapping: DataFrame, observed: DataFrame, labels: DataFrame, by: list[str]) -> DataFrame:
    """Problems of a label mapping as rows (evaluation, error, detail).

    ``mapping``: by + dataset_value, model_label_index; ``observed``: by + value;
    ``labels``: by + idx (the outputs the model has).
    """
    incomplete = F.col("dataset_value").isNull() | F.col("model_label_index").isNull()
    valid = mapping.filter(~incomplete)
    parts = [
        mapping.filter(incomplete).select(*by, F.lit("missing_keys").alias("error"),
                                          F.coalesce("dataset_value", F.lit("?")).alias("detail")),
        valid.groupBy(*by, "dataset_value").agg(F.count("*").alias("_n")).filter("_n > 1").select(
            *by, F.lit("duplicate_value").alias("error"), F.col("dataset_value").alias("detail")),
        observed.join(valid.select(*by, F.col("dataset_value").alias("value")), [*by, "value"], "left_anti").select(
            *by, F.lit("unmapped_value").alias("error"), F.col("value").alias("detail")),
        valid.join(labels.select(*by, F.col("idx").alias("model_label_index")), [*by, "model_label_index"], "left_anti").select(
            *by, F.lit("unknown_index").alias("error"), F.col("model_label_index").cast("string").alias("detail")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def reachable_indices(mapping: DataFrame, labels: DataFrame, by: list[str]) -> DataFrame:
    """Outputs that the mapping can produce."""
    return mapping.filter(F.col("dataset_value").isNotNull()).select(*by, F.col("model_label_index").alias("idx")).join(
        labels.select(*by, "idx"), [*by, "idx"], "left_semi").distinct()


def validate_fairness(df: DataFrame, mapping: DataFrame, labels: DataFrame, by: list[str], min_group_n: int, positive: int,
                      target: str = "target", grp: str = "grp") -> DataFrame:
    """Mapping problems plus unreachable positive index and too few large groups."""
    errors = validate_mapping(mapping, observed_values(df, target, by), labels, by)
    keys = df.select(*by).distinct()
    reach = reachable_indices(mapping, labels, by).filter(F.col("idx") == positive).select(*by)
    unreachable = keys.join(reach, by, "left_anti").select(
        *by, F.lit("positive_unreachable").alias("error"), F.lit(str(positive)).alias("detail"))
    sizes = group_preview(df, by, min_group_n, grp).groupBy(*by).agg(F.count_if("meets_min_group_n").alias("_k"))
    few = sizes.filter("_k < 2").select(*by, F.lit("too_few_groups").alias("error"), F.col("_k").cast("string").alias("detail"))
    return errors.unionByName(unreachable).unionByName(few)


def group_preview(df: DataFrame, by: list[str], min_group_n: int, grp: str = "grp") -> DataFrame:
    """Observed groups (missing values as one group) and whether each is large enough."""
    value = F.when(is_missing(grp), "(missing)").otherwise(strip(grp))
    return df.groupBy(*by, value.alias("value")).agg(F.count("*").alias("count")).withColumn(
        "meets_min_group_n", F.col("count") >= min_group_n)


def validate_robustness(df: DataFrame, mapping: DataFrame, by: list[str], target: str = "target") -> DataFrame:
    """Rows whose label the mapping covers, and the rest."""
    values = mapping.filter(F.col("dataset_value").isNotNull() & F.col("model_label_index").isNotNull()).select(
        *by, F.col("dataset_value").alias("_v")).distinct().withColumn("_hit", F.lit(1))
    counts = df.groupBy(*by, F.coalesce(strip(target), F.lit("")).alias("_v")).agg(F.count("*").alias("_n"))
    return counts.join(values, [*by, "_v"], "left").groupBy(*by).agg(
        F.coalesce(F.sum(F.when(F.col("_hit") == 1, F.col("_n"))), F.lit(0)).alias("n_label_compatible"),
        F.coalesce(F.sum(F.when(F.col("_hit").isNull(), F.col("_n"))), F.lit(0)).alias("n_excluded"))


def validate_safety(df: DataFrame, by: list[str], severe: str = "severe") -> DataFrame:
    """Values of the severe column other than 0 and 1."""
    return observed_values(df, severe, by).filter(~F.col("value").isin("0", "1"))


def multilabel_view(models: DataFrame, pairs: Column, problem_type: str = "problem_type", target: str = "target_index") -> DataFrame:
    """Check of the multi-label target and the label names validation has to use."""
    multi = F.coalesce(F.col(problem_type) == "multi_label_classification", F.lit(False))
    name = F.get(F.filter(pairs, lambda p: p["idx"] == F.col(target)), F.lit(0))["name"]
    error = first_case(
        (multi & F.col(target).isNull(), "MULTILABEL_TARGET_REQUIRED"),
        (multi & name.isNull(), "target_not_an_output"),
        (~multi & F.col(target).isNotNull(), "target_only_for_multilabel"))
    plain = F.transform(F.array_sort(pairs), lambda p: F.concat(p["idx"].cast("string"), F.lit("="), p["name"]))
    binary = F.array(F.concat(F.lit("0=not "), name), F.concat(F.lit("1="), name))
    return models.withColumn("error", error).withColumn(
        "view_labels", F.when(multi & F.col("error").isNull(), binary).otherwise(plain))


def submission_checks(drafts: DataFrame) -> DataFrame:
    """First reason why a draft cannot be submitted; NULL when it can."""
    return drafts.withColumn("error", first_case(
        (F.col("configured") == 0, "nothing_configured"),
        (F.col("draft_revision").isNotNull() & (F.col("draft_revision") != F.col("current_revision")), "stale"),
        ((F.col("problem_type") == "multi_label_classification") & F.col("target_index").isNull(), "MULTILABEL_TARGET_REQUIRED"),
        (F.col("confirmed") == 0, "not_confirmed")))


def check_verdicts(probes: DataFrame, expected: Column, dimension: str = "dimension", confidence: str = "confidence",
                   refs: str = "has_evidence") -> DataFrame:
    """Probe results that break the verdict contract, with every violation."""
    bad = reasons(
        (F.col(dimension) != expected, "dimension_mismatch"),
        (F.col(confidence).isNull() | ~F.col(confidence).between(0.0, 1.0), "confidence_out_of_range"),
        (F.col(refs) == 0, "missing_evidence_refs"))
    return probes.withColumn("violations", bad).filter(F.size("violations") > 0)
