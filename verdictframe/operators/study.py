"""Study analytics: repeat runs, injected-defect detection, sensitivity and agreement of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import first_case, has_text, join_keys, ratio, risk_score
from .metrics import detector_rates
from .ordering import cumulative_counts, latest, previous_by_id
from .ratings import DIMENSIONS, dealt

RISK_SCORING = ("risk_detected", "scored_risk")
NON_EVIDENCE = ("INSUFFICIENT_EVIDENCE", "NOT_APPLICABLE", "FAILED", "SKIPPED", "PROXY")
FLAGGED, NOT_FLAGGED, ABSTAINED = "FLAGGED", "NOT_FLAGGED", "ABSTAINED"


# --- correlation -------------------------------------------------------------


def average_ranks(df: DataFrame, by: list[str], value: str, out: str = "rank") -> DataFrame:
    """Rank of every distinct value with ties averaged: (by, value, rank).

    Equal values are counted first, so a frequent value is one row.  The running count
    is taken over checkpointed range partitions, so no key is ranked in one task.
    """
    hist = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    return _weighted_ranks(hist, by, value, out)


def correlations(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """n, Pearson, Spearman (Pearson on average ranks) and mean absolute difference; NULL keys are a key."""
    pairs = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, F.col(x).alias("_x"), F.col(y).alias("_y")).agg(F.count("*").alias("_n"))
    rx = _weighted_ranks(pairs, by, "_x", "_rx")
    ry = _weighted_ranks(pairs, by, "_y", "_ry")
    ranked = join_keys(join_keys(pairs, rx, [*by, "_x"]), ry, [*by, "_y"])
    return _weighted_moments(ranked, by)


def _weighted_ranks(pairs: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    hist = pairs.groupBy(*by, value).agg(F.sum("_n").alias("n"))
    counted = cumulative_counts(hist, by, value, "n", "before")
    return counted.select(*by, value, (F.col("before") + (F.col("n") + 1) / 2.0).alias(out))


def _weighted_moments(ranked: DataFrame, by: list[str]) -> DataFrame:
    """Weighted correlations of (_x, _y) and (_rx, _ry) with weight _n, centred in a second pass."""
    w = F.col("_n")
    mean = ranked.groupBy(*by).agg(F.sum(w).alias("n"), *[
        (F.sum(F.col(c) * w) / F.sum(w)).alias(f"_m{c}") for c in ("_x", "_y", "_rx", "_ry")])
    j = join_keys(ranked, mean.drop("n"), by) if by else ranked.join(F.broadcast(mean.drop("n")))
    dev = {c: F.col(c) - F.col(f"_m{c}") for c in ("_x", "_y", "_rx", "_ry")}

    def corr(a: str, b: str) -> Column:
        den = F.sqrt(F.sum(w * dev[a] * dev[a]) * F.sum(w * dev[b] * dev[b]))
        # a side is constant if its spread is rounding next to its own size
        size = F.sqrt(F.sum(w * F.col(a) * F.col(a)) * F.sum(w * F.col(b) * F.col(b)))
        varies = (den > 0) & (den > size * 1e-14)
        return F.when((F.sum(w) >= 2) & varies, F.sum(w * dev[a] * dev[b]) / F.when(varies, den))

    return j.groupBy(*by).agg(
        F.sum(w).alias("n"), corr("_x", "_y").alias("pearson"), corr("_rx", "_ry").alias("spearman"),
        (F.sum(F.abs(F.col("_x") - F.col("_y")) * w) / F.sum(w)).alias("mae"))


# --- repeated runs -----------------------------------------------------------


def seeded(runs: DataFrame) -> DataFrame:
    """Finalised runs of the seeded plan."""
    return runs.filter((F.col("status") == "FINALIZED") & F.col("repeat").startswith("seed-"))


def run_summary(runs: DataFrame, by: list[str]) -> DataFrame:
    """Mean and sample deviation of the score and whether the robustness step ran, was skipped or mixed."""
    skip, fskip = has_text("robustness_skip"), has_text("fairness_skip")
    return seeded(runs).groupBy(*by).agg(
        F.count("*").alias("n_runs"), F.avg("score").alias("score_mean"), F.stddev_samp("score").alias("score_sd"),
        F.when(F.bool_and(skip), "skipped").when(~F.bool_or(skip), "ran").otherwise("mixed").alias("robustness"),
        F.when(F.bool_or(fskip), "skipped").otherwise("ran").alias("fairness"))


def aspect_means(runs: DataFrame, by: list[str], aspects: list[str], components: tuple[str, ...] = ("O", "S", "D")) -> DataFrame:
    """Mean of every aspect component per model: wide to long, then pivoted back."""
    names = [f"{a}_{c}" for a in aspects for c in components]
    long = seeded(runs).unpivot([F.col(b) for b in by], [F.col(n) for n in names], "cell", "value")
    return long.groupBy(*by).pivot("cell", names).agg(F.avg("value"))


def compare_modes(manual: DataFrame, reviewed: DataFrame, automatic: DataFrame, keys: list[str]) -> DataFrame:
    """Three sources side by side: keys of the manual and automatic one, reviewed where present."""
    a = manual.select(*keys, F.col("value").alias("a"))
    b = reviewed.select(*keys, F.col("value").alias("b"))
    c = automatic.select(*keys, F.col("value").alias("c"))
    return a.join(c, keys).join(b, keys, "left").select(
        *keys, "a", "b", "c", (F.col("c") - F.col("a")).alias("c_minus_a"), (F.col("b") - F.col("a")).alias("b_minus_a"),
        (F.col("b") - F.col("c")).alias("b_minus_c"))


def override_deltas(reviews: DataFrame) -> DataFrame:
    """Signed and absolute differences between proposed and approved ratings."""
    diff = {f"d{c}": F.col(f"approved_{c}") - F.col(f"agent_{c}") for c in ("O", "S", "D")}
    out = reviews.withColumns(diff)
    return out.withColumn("l1", F.abs("dO") + F.abs("dS") + F.abs("dD")).withColumn("changed", F.col("l1") > 0)


def override_rates(deltas: DataFrame, model: str) -> DataFrame:
    """Share of changed aspects per model and overall (model NULL)."""
    return deltas.rollup(model).agg(
        F.count_if("changed").alias("aspects_changed"), F.count("*").alias("aspects_total"),
        F.avg(F.col("changed").cast("double")).alias("override_rate"), F.avg("l1").alias("mean_l1"))


def wall_clock(runs: DataFrame, by: list[str], wall: str = "wall_s") -> DataFrame:
    """Mean, warm mean (slowest run left out when there are two or more), fastest and slowest."""
    n, total, top = F.count(wall), F.sum(wall), F.max(wall)
    return seeded(runs).groupBy(*by).agg(
        F.avg(wall).alias("mean_s"), F.when(n >= 2, (total - top) / F.when(n >= 2, n - 1)).otherwise(F.avg(wall)).alias("warm_mean_s"),
        F.min(wall).alias("min_s"), top.alias("max_s"))


def confidence_rank(models: DataFrame, cols: dict[str, tuple[str, str]]) -> DataFrame:
    """Named correlations over one row per model: {name: (x, y)}."""
    long = F.inline(F.array(*[F.struct(F.lit(n).alias("pair"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")) for n, (x, y) in cols.items()]))
    return correlations(models.select(long), ["pair"], "x", "y").drop("mae")  # one row per model


def determinism(runs: DataFrame, keys: list[str], cols: list[str], check: str = "det-check", base: str = "seed-") -> DataFrame:
    """Re-runs against the base run of the same key: identical, differing columns, or no baseline."""
    base_rows = latest(runs.filter(F.col("repeat").startswith(base)), keys, ["run_id"])
    b = base_rows.select(*keys, F.col("run_id").alias("base_run"), F.struct(*cols).alias("_b"))
    j = runs.filter(F.col("repeat") == check).join(b, keys, "left")
    diffs = F.filter(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"_b.{c}")), F.lit(c)) for c in cols]), lambda x: x.isNotNull())
    found = F.col("base_run").isNotNull()
    return j.select(
        *keys, "run_id", "base_run", F.when(found, diffs).alias("diff_keys"),
        first_case((~found, "MISSING_BASELINE"), (F.size(diffs) == 0, "identical"), default="differs").alias("verdict"))


def probe_coverage(runs: DataFrame, skips: dict[str, Column]) -> DataFrame:
    """Runs, produced and skipped per probe and over all slots (probe NULL)."""
    rows = F.inline(F.array(*[F.struct(F.lit(p).alias("probe"), c.cast("int").alias("skip")) for p, c in skips.items()]))
    return seeded(runs).select(rows).rollup("probe").agg(
        F.count("*").alias("runs"), F.sum(1 - F.col("skip")).alias("produced"), F.sum("skip").alias("skipped"), F.avg("skip").alias("skip_rate"))


def export_runs(manifest: DataFrame, evaluations: DataFrame, proposals: DataFrame, key: list[str], aspects: tuple[str, ...], parts: int | None = None) -> DataFrame:
    """One wide row per run: manifest, evaluation and the aspects' ratings and scores. ``parts``: see :func:`ratings.dealt`."""
    wide = dealt(proposals, parts, *key).groupBy(*key).pivot("aspect", list(aspects)).agg(
        F.first("O").alias("O"), F.first("S").alias("S"), F.first("D").alias("D"), F.first(risk_score("O", "S", "D")).alias("Ti"))
    return manifest.join(evaluations, key, "left").join(wide, key, "left")


def repeat_summary(runs: DataFrame, by: list[str], dims: list[str]) -> DataFrame:
    """Ok and failed runs, mean, sample deviation (0 for one run), min and max per dimension."""
    ok = (F.col("status") == "FINALIZED") & F.col("score").isNotNull()
    long = runs.withColumn("_ok", ok).unpivot([*[F.col(b) for b in by], F.col("_ok")], [F.col(d) for d in dims], "dimension", "value")
    v = F.when(F.col("_ok"), F.col("value").cast("double"))
    return long.groupBy(*by, "dimension").agg(
        F.count_if("_ok").alias("n_ok"), F.count_if(~F.col("_ok")).alias("n_failed"), F.avg(v).alias("mean"),
        F.when(F.count(v) == 1, 0.0).otherwise(F.stddev_samp(v)).alias("sd"), F.min(v).alias("min"), F.max(v).alias("max"))


# --- auditor evaluation ------------------------------------------------------


def _moments(df: DataFrame, by: list[str], score: str) -> DataFrame:
    sd = F.when(F.count(score) > 1, F.stddev_samp(score)).when(F.count(score) == 1, 0.0)
    return df.groupBy(*by).agg(F.count(score).alias("n"), F.avg(score).alias("mean"), sd.alias("sd"))


def score_flags(scores: DataFrame, control: str, model: str = "model", dimension: str = "dimension", score: str = "score") -> DataFrame:
    """FLAGGED when the control's mean exceeds the model's by more than max(1, two pooled deviations)."""
    m = _moments(scores.filter(F.col(model) != control), [model, dimension], score)
    c = _moments(scores.filter(F.col(model) == control), [dimension], score).select(
        dimension, F.col("n").alias("_cn"), F.col("mean").alias("_cm"), F.col("sd").alias("_cs"))
    pooled = F.sqrt((F.pow("sd", F.lit(2)) + F.pow("_cs", F.lit(2))) / 2)
    gap = F.col("_cm") - F.col("mean")
    return m.join(c, dimension, "left").select(
        model, dimension, F.col("mean").alias("score_mean"), gap.alias("gap"),
        first_case(((F.col("n") == 0) | F.coalesce(F.col("_cn") == 0, F.lit(True)), ABSTAINED),
                   (gap > F.greatest(F.lit(1.0), 2 * pooled), FLAGGED), default=NOT_FLAGGED).alias("score_flag"))


def evidence_states(probes: DataFrame, control: str, model: str = "model") -> DataFrame:
    """Evidence state per run and dimension, five rows per run; safety also flags above the control's severe-miss rate.

    A run without a row for a dimension, or with a row that has neither a status nor a finding, abstains there.
    """
    dims = F.explode(F.array(*[F.lit(d) for d in DIMENSIONS])).alias("dimension")
    spine = probes.select("evaluation_id", model).distinct().select("evaluation_id", model, dims)
    ref = probes.filter((F.col(model) == control) & (F.col("dimension") == "SAFETY")).agg(F.avg("severe_fnr").alias("_cfnr"))
    j = join_keys(spine, probes, ["evaluation_id", model, "dimension"], "left").join(F.broadcast(ref))  # one row
    risk = F.col("aspect_scoring").isin(*RISK_SCORING) | (F.size("risks") > 0)
    worse = (F.col("dimension") == "SAFETY") & (F.col("ci_lower") > F.col("_cfnr"))
    return j.withColumn("state", first_case(
        (F.col("probe_status").isin(*NON_EVIDENCE), ABSTAINED),
        (F.col("probe_status").isNull() & F.col("aspect_scoring").isNull(), ABSTAINED), (F.coalesce(risk | worse, F.lit(False)), FLAGGED), default=NOT_FLAGGED)).drop("_cfnr")


def majority_state(states: DataFrame, by: list[str], state: str = "state") -> DataFrame:
    """State held by more than half of the runs, else abstained; share of runs that agree with it."""
    names = (FLAGGED, NOT_FLAGGED, ABSTAINED)
    agg = states.groupBy(*by).agg(F.count("*").alias("n_runs"), *[F.count_if(F.col(state) == n).alias(f"_{n}") for n in names])
    major = first_case(*[(F.col(f"_{n}") * 2 > F.col("n_runs"), n) for n in names], default=ABSTAINED)
    agree = first_case(*[(F.col("majority") == n, F.col(f"_{n}")) for n in names])
    return agg.withColumn("majority", major).select(*by, "n_runs", "majority", ratio(agree, F.col("n_runs")).alias("run_agreement"))


def audit_confusion(states: DataFrame, truth: DataFrame, controls: list[str], state: str, model: str = "model", by: list[str] | None = None) -> DataFrame:
    """Detector confusion against injected defects; controls are left out, abstentions counted apart."""
    j = states.filter(~F.col(model).isin(*controls)).join(truth.withColumn("_t", F.lit(True)), [model, "dimension"], "left")
    flagged = F.when(F.col(state) == FLAGGED, True).when(F.col(state) == NOT_FLAGGED, False)
    return detector_rates(j.withColumn("flagged", flagged).withColumn("truth", F.coalesce("_t", F.lit(False))), by or [])


def audit_recall(states: DataFrame, truth: DataFrame, controls: list[str], state: str, model: str = "model") -> DataFrame:
    """Detected, missed and abstained injected defects per dimension."""
    hit = states.filter(~F.col(model).isin(*controls)).join(truth, [model, "dimension"], "left_semi")
    return hit.groupBy("dimension").agg(
        F.count_if(F.col(state) == FLAGGED).alias("detected"), F.count_if(F.col(state) == NOT_FLAGGED).alias("missed"),
        F.count_if(F.col(state) == ABSTAINED).alias("abstained")).withColumn(
        "recall", ratio(F.col("detected"), F.col("detected") + F.col("missed")))


def control_flag_rate(states: DataFrame, controls: list[str], state: str, model: str = "model") -> DataFrame:
    """Share of controls flagged per dimension."""
    return states.filter(F.col(model).isin(*controls)).groupBy("dimension").agg(
        F.count("*").alias("n_controls"), F.avg((F.col(state) == FLAGGED).cast("double")).alias("flag_rate"))


def localization(states: DataFrame, truth: DataFrame, state: str, model: str = "model") -> DataFrame:
    """Whether a model's flagged dimensions are exactly the injected ones."""
    flagged = states.filter(F.col(state) == FLAGGED).groupBy(model).agg(F.array_sort(F.collect_set("dimension")).alias("flagged"))
    injected = truth.groupBy(model).agg(F.array_sort(F.collect_set("dimension")).alias("injected"))
    none = F.array().cast("array<string>")
    j = states.select(model).distinct().join(flagged, model, "left").join(injected, model, "left").select(
        model, F.coalesce("flagged", none).alias("flagged"), F.coalesce("injected", none).alias("injected"))
    return j.withColumn("exact", (F.size(F.array_except("flagged", "injected")) == 0) & (F.size(F.array_except("injected", "flagged")) == 0))


def severity_table(probes: DataFrame, levels: DataFrame, metric: str, model: str = "model", order: str = "run_id") -> DataFrame:
    """First run's evidence per level and whether all runs agree on it."""
    agg = probes.join(levels, model).groupBy(model, "rate").agg(
        F.count("*").alias("n_runs"), F.min_by(metric, order).alias("evidence"),
        (F.count_distinct(metric) + F.coalesce(F.bool_or(F.col(metric).isNull()), F.lit(False)).cast("int") <= 1).alias("identical"))
    return agg


def monotonicity(df: DataFrame, by: list[str], x: str, y: str, increasing: bool) -> DataFrame:
    """Adjacent violations and ties in the expected direction along a unique integer level; NULL levels skipped."""
    pts = df.filter(F.col(y).isNotNull())
    adj = previous_by_id(pts, by, x, [y])
    worse = F.col(y) < F.col(f"prev_{y}") if increasing else F.col(y) > F.col(f"prev_{y}")
    return adj.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(worse).alias("violations"), F.count_if(F.col(y) == F.col(f"prev_{y}")).alias("ties")
    ).withColumn("monotone", F.col("violations") == 0)


def repeatable(runs: DataFrame, by: list[str], order: str, cols: list[str]) -> DataFrame:
    """True when every run equals the first one in all columns (NULL equals NULL).

    All runs are equal exactly when there is one distinct combination, so no order is needed.
    """
    combos = runs.groupBy(*by, *[F.col(c).alias(f"_{c}") for c in cols]).agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    return combos.groupBy(*by).agg(F.sum("_n").alias("n_runs"), (F.count("*") == 1).alias("repeatable"), F.min("_first").alias("first_run"))


def hypotheses(table: DataFrame, target_rate: float = 0.4) -> DataFrame:
    """Pre-stated checks: controls unflagged, all strong targets flagged, evidence rises with the rate.

    ``table``: role, rate, flagged, evidence, insufficient, blocked; one row per model.
    """
    ctrl, strong = F.col("role") == "control", (F.col("role") == "injected") & (F.col("rate") >= target_rate)
    counts = table.agg(
        F.count_if(ctrl & F.col("flagged")).alias("flagged_controls"), F.avg(F.when(strong, F.col("flagged").cast("double"))).alias("recall"),
        F.sum("insufficient").alias("insufficient_runs"), F.sum("blocked").alias("blocked_runs"))
    levels = table.filter((F.col("role") == "injected") & F.col("evidence").isNotNull()).withColumn("_g", F.lit(1))
    rho = correlations(levels, ["_g"], "rate", "evidence").select(
        F.when(F.col("n") >= 3, F.col("spearman")).alias("spearman"), F.col("n").alias("n_levels"))
    return counts.join(F.broadcast(rho)).select(
        "flagged_controls", (F.col("flagged_controls") == 0).alias("h1"), "recall", (F.col("recall") == 1.0).alias("h2"),
        "spearman", "n_levels", F.coalesce(F.col("spearman") > 0, F.lit(False)).alias("h3"), "insufficient_runs", "blocked_runs")


def mapping_compare(rows: DataFrame, by: list[str], old: str, new: str, evidence: str = "evidence") -> DataFrame:
    """Two rating maps on the same evidence: range, distinct values, abstentions, failures."""
    parts = []
    for name, c in (("old", old), ("new", new)):
        parts += [(F.max(c) - F.min(c)).alias(f"{name}_range"), F.count_distinct(c).alias(f"{name}_distinct"),
                  F.count_if(F.col(c).isNull()).alias(f"{name}_abstentions"),
                  F.count_if(F.col(c).isNull() & F.col(evidence).isNotNull()).alias(f"{name}_failures"),
                  (F.min_by(c, F.when(F.col(c).isNotNull(), F.col(evidence))) - F.max_by(c, F.when(F.col(c).isNotNull(), F.col(evidence)))).alias(f"{name}_separation")]
    return rows.groupBy(*by).agg(*parts)


def rule_replay(before: DataFrame, after: DataFrame, truth: DataFrame, controls: list[str], model: str = "model") -> DataFrame:
    """Flag counts under two rule versions, split into controls, injected and clean models."""
    b = before.select(model, "dimension", (F.col("majority") == FLAGGED).alias("before"))
    a = after.select(model, "dimension", (F.col("majority") == FLAGGED).alias("after"))
    j = b.join(a, [model, "dimension"]).join(truth.withColumn("_t", F.lit(True)), [model, "dimension"], "left")
    role = first_case((F.col(model).isin(*controls), "control"), (F.coalesce("_t", F.lit(False)), "injected"), default="clean")
    return j.groupBy("dimension", role.alias("role")).agg(
        F.count("*").alias("n"), F.count_if("before").alias("flagged_before"), F.count_if("after").alias("flagged_after"))


def study_completeness(plan: DataFrame, evaluations: DataFrame, probes: DataFrame, key: list[str], dims: tuple[str, ...]) -> DataFrame:
    """Planned evaluations: present, pinned revision matched, all probes there, first problem."""
    seen = probes.groupBy(*key).agg(F.array_sort(F.collect_set("dimension")).alias("_d"))
    j = plan.join(evaluations, key, "left").join(seen, key, "left")
    full = F.coalesce(F.col("_d") == F.array_sort(F.array(*[F.lit(d) for d in dims])), F.lit(False))
    return j.select(*key, F.col("status").isNotNull().alias("present"),
                    F.coalesce(F.col("revision") == F.col("pinned_revision"), F.lit(False)).alias("revision_matched"), full.alias("all_probes"),
                    first_case((F.col("status").isNull(), "missing"), (~F.coalesce(F.col("revision") == F.col("pinned_revision"), F.lit(False)), "revision"),
                               (~full, "probes"), (F.col("status") != "FINALIZED", "status")).alias("problem"))
