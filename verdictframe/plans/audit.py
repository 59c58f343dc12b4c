"""The whole audit of many evaluations as one lazily built plan.

Prediction rows and model cards go in; verdicts of the probes, evidence strength,
ratings and a score (or its withholding) come out.  Probes are an ordered registry:
each names its dimension and the inputs it needs and returns the columns of
:data:`VERDICT`, and nothing else is read from it.  The ratings cover the five built-in
dimensions; verdicts cover every registered one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import join_keys, reasons
from ..operators import documents as D
from ..operators import gates as G
from ..operators import integrity as I
from ..operators import metrics as M
from ..operators import ratings as S
from ..session import keep

_STRINGS = "array<string>"

# the common verdict row: name -> type
VERDICT = {
    "dimension": "string", "probe_status": "string", "aspect_scoring": "string", "risks": _STRINGS, "failed_gates": _STRINGS, "flags": _STRINGS,
    "has_evidence": "boolean", "has_checks": "boolean", "needs_human_review": "boolean", "dpd": "double", "eod": "double", "excess_dpd": "double",
    "min_group_n_observed": "bigint", "min_group_n": "bigint", "clean_accuracy": "double", "robust_accuracy": "double", "n_evaluated": "bigint",
    "ci_lower": "double", "ci_upper": "double", "pass_count": "int", "fail_count": "int", "artifact_status": "string", "hash_comparison": "string",
    "files_listed": "boolean", "sha_like": "boolean", "card_chars": "int", "coverage_ratio": "double", "high_impact": "boolean", "severe_fnr": "double",
    "fnr_ratio": "double", "benign_fpr": "double", "behavior_status": "string", "rule_version": "string", "confidence": "double"}


NO_INPUT = "G-NO-INPUT"


def verdict_row(df: DataFrame, by: list[str], dimension: str, **columns: Column | str) -> DataFrame:
    """Project a probe's result onto the common verdict row; what it does not measure is NULL."""
    given = {k: (F.col(c) if isinstance(c, str) else c) for k, c in columns.items()}
    defaults = {"dimension": F.lit(dimension), "has_evidence": F.lit(True), "has_checks": F.lit(False), "needs_human_review": F.lit(False), "rule_version": F.lit("current")}
    empty = F.array().cast(_STRINGS)

    def cell(name: str, dtype: str) -> Column:
        c = given.get(name, defaults.get(name, F.lit(None)))
        c = F.coalesce(c.cast(dtype), empty) if dtype == _STRINGS else c.cast(dtype)
        return c.alias(name)

    return df.select(*by, *[cell(n, t) for n, t in VERDICT.items()])


def _one(c: str) -> Column:
    return F.filter(F.array(F.col(c)), lambda x: x.isNotNull())


@dataclass(frozen=True)
class Inputs:
    """What probes work on: the cube of the rows, one row of documentation per evaluation, and optional tables by evaluation.

    ``checks`` holds label_fraction, coverage, domain_mismatch and allow_mismatch; ``artifacts`` holds artifact_status;
    ``extra`` is for probes of your own.
    """

    rows: DataFrame
    models: DataFrame
    by: list[str]
    min_group_n: int = 30
    fallbacks: dict = field(default_factory=dict)
    seed: int = 42
    checks: DataFrame | None = None
    artifacts: DataFrame | None = None
    extra: dict[str, DataFrame] = field(default_factory=dict)


@dataclass(frozen=True)
class Probe:
    """A dimension, what it needs of :class:`Inputs` (a missing need means that the probe does not run), and its verdicts."""

    dimension: str
    run: Callable[[Inputs], DataFrame]
    needs: tuple[str, ...] = ()

    def ready(self, inputs: Inputs) -> bool:
        return all(getattr(inputs, n, None) is not None or n in inputs.extra for n in self.needs)


def with_probe(probes: tuple[Probe, ...], probe: Probe, before: str | None = None) -> tuple[Probe, ...]:
    """The registry with one more probe, last or before a dimension; a dimension is registered once."""
    if any(p.dimension == probe.dimension for p in probes):
        raise ValueError(f"dimension {probe.dimension} is registered already")
    names = [p.dimension for p in probes]
    at = len(probes) if before is None else names.index(before)
    return (*probes[:at], probe, *probes[at:])


def checked(df: DataFrame, by: list[str]) -> DataFrame:
    """Exactly the verdict columns, or an error that names what is wrong with a probe's result."""
    wrong = sorted({*by, *VERDICT} ^ set(df.columns))
    if wrong:
        raise ValueError(f"a probe returns the evaluation key and the verdict columns; differing: {wrong}")
    return df.select(*by, *[F.col(n).cast(t).alias(n) for n, t in VERDICT.items()])


def fairness_probe(x: Inputs) -> DataFrame:
    v = G.binary_verdict(x.rows, x.by, x.min_group_n, seed=x.seed, weight="n").drop("confidence")
    j = v.join(M.fairness_bundle(x.rows, x.by, weight="n").select(*x.by, "n", "dpd", "eod", "excess_dpd", "min_group_n_observed"), x.by)
    return verdict_row(j, x.by, "FAIRNESS", probe_status="status", aspect_scoring="aspect_scoring", risks=_one("risk"), failed_gates=_one("failed_gate"), flags="flags",
                       needs_human_review=F.lit(True), dpd="dpd", eod="eod", excess_dpd="excess_dpd", min_group_n_observed="min_group_n_observed",
                       min_group_n=F.lit(x.min_group_n), n_evaluated="n", ci_lower="eopp_lower", ci_upper="eopp_upper")


def robustness_probe(x: Inputs) -> DataFrame:
    """The perturbation verdict; label compatibility, coverage and domain come from ``checks``, and count as fine where it has no row."""
    given = {"label_fraction": F.lit(1.0), "coverage": F.lit(1.0), "domain_mismatch": F.lit(False), "allow_mismatch": F.lit(False)}
    rows = x.rows if x.checks is None else join_keys(x.rows, x.checks.select(*x.by, *given), x.by, "left")
    told = [F.coalesce(F.first(c), d) if x.checks is not None else d for c, d in given.items()]
    v = G.robustness_verdict(rows, x.by, *told, seed=x.seed, weight="n").select(*x.by, "status", "aspect_scoring", "risk", "all_gates")
    j = v.join(M.robustness_metrics(x.rows, x.by, weight="n").select(*x.by, "n_evaluated", "clean_accuracy", "robust_accuracy", "clean_lo", "clean_hi"), x.by)
    return verdict_row(j, x.by, "ROBUSTNESS", probe_status="status", aspect_scoring="aspect_scoring", risks=_one("risk"), failed_gates="all_gates", n_evaluated="n_evaluated",
                       clean_accuracy=F.round("clean_accuracy", 4), robust_accuracy=F.round("robust_accuracy", 4), ci_lower="clean_lo", ci_upper="clean_hi")


def integrity_probe(x: Inputs) -> DataFrame:
    v = I.integrity_verdict(x.models, x.by[0])
    status = F.lit(None).cast("string")
    if x.artifacts is not None:
        v, status = join_keys(v, x.artifacts.select(*x.by, "artifact_status"), x.by, "left"), F.col("artifact_status")
    return verdict_row(v, x.by, "INTEGRITY", probe_status="status", aspect_scoring="aspect_scoring", risks="risks", failed_gates="failed_gates", flags="flags",
                       has_checks=F.col("pass_count") > 0, pass_count="pass_count", fail_count="fail_count", hash_comparison="hash_state",
                       files_listed="files_listed", sha_like="revision_pinned", artifact_status=status)


def documentation_probe(x: Inputs) -> DataFrame:
    v = D.documentation_verdict(x.models, x.by[0], x.fallbacks)
    return verdict_row(v, x.by, "EXPLAINABILITY", probe_status="status", aspect_scoring="aspect_scoring", risks=_one("risk"), failed_gates=_one("failed_gate"), flags="flags",
                       has_checks=F.col("card_chars") > 0, card_chars="card_chars", coverage_ratio="coverage_ratio")


def safety_probe(x: Inputs) -> DataFrame:
    """Disclosures of the card, with the measured severe-miss rate on top of them."""
    card = D.disclosure_verdict(x.models, x.by[0], x.fallbacks)
    behavior = M.severe_with_collapse(x.rows, x.by, weight="n").select(
        *x.by, F.col("status").alias("behavior_status"), "severe_fnr", "severe_lo", "severe_hi", "fnr_ratio", "benign_fpr")
    miss = G.severe_miss(x.rows, x.by, weight="n").select(*x.by, "fires")
    j = card.join(behavior, x.by, "left").join(miss, x.by, "left")
    fires = F.coalesce("fires", F.lit(False)) & (F.col("behavior_status") == "EVALUATED")
    return verdict_row(j, x.by, "SAFETY", probe_status="status", aspect_scoring=F.when(fires, "risk_detected").otherwise(F.col("aspect_scoring")),
                       risks=reasons((fires, G.SEVERE_RISK)), failed_gates=_one("failed_gate"), flags="flags", has_checks=F.col("card_chars") > 0,
                       card_chars="card_chars", coverage_ratio="coverage_ratio", high_impact=F.size("high_impact_claims") > 0, severe_fnr="severe_fnr",
                       fnr_ratio="fnr_ratio", benign_fpr="benign_fpr", behavior_status="behavior_status", ci_lower="severe_lo", ci_upper="severe_hi")


PROBES = (
    Probe("FAIRNESS", fairness_probe, ("rows",)), Probe("ROBUSTNESS", robustness_probe, ("rows",)), Probe("INTEGRITY", integrity_probe, ("models",)),
    Probe("EXPLAINABILITY", documentation_probe, ("models",)), Probe("SAFETY", safety_probe, ("rows", "models")))


def verdicts(rows: DataFrame, models: DataFrame, key: str, min_group_n: int = 30, fallbacks: dict | None = None, seed: int = 42,
             probes: tuple[Probe, ...] = PROBES, checks: DataFrame | None = None, artifacts: DataFrame | None = None,
             extra: dict[str, DataFrame] | None = None) -> DataFrame:
    """Verdict rows of all registered dimensions for every evaluation.

    The prediction rows are read once: they are counted into a cube whose size does not
    depend on their number, and every probe works on that cube.  Every evaluation of either
    input has one row per probe: one without a card keeps what was measured on its rows, and a
    probe without any input has insufficient evidence.
    """
    by = [key]
    rows = keep(M.cube(rows, by, ["grp", "label", "y_hat", "y_robust", "severe"]))
    every = rows.select(key).union(models.select(key)).distinct()
    inputs = Inputs(rows, join_keys(every, models, by, "left"), by, min_group_n, fallbacks or {}, seed, checks, artifacts, extra or {})
    results = [checked(p.run(inputs), by) for p in probes if p.ready(inputs)]
    spine = every.select(key, F.explode(F.array(*[F.lit(p.dimension) for p in probes])).alias("dimension"))
    found = join_keys(spine, reduce(DataFrame.unionByName, results), [key, "dimension"], "left")
    missing = F.col("probe_status").isNull()
    empty = F.array().cast(_STRINGS)
    filled = found.withColumns({
        **{c: F.coalesce(c, empty) for c, t in VERDICT.items() if t == _STRINGS},
        **{c: F.coalesce(c, F.lit(False)) for c in ("has_evidence", "has_checks", "needs_human_review")},
        "rule_version": F.coalesce("rule_version", F.lit("current")),
        "failed_gates": F.when(missing, F.array(F.lit(NO_INPUT))).otherwise(F.col("failed_gates")),
        "aspect_scoring": F.when(missing, "not_scored").otherwise(F.col("aspect_scoring")),
        "probe_status": F.coalesce("probe_status", F.lit("INSUFFICIENT_EVIDENCE"))})
    graded = S.confidence_factors(filled)
    return graded.withColumn("confidence", F.col("combined"))


def audit(rows: DataFrame, models: DataFrame, key: str, min_group_n: int = 30, fallbacks: dict | None = None, seed: int = 42,
          probes: tuple[Probe, ...] = PROBES, checks: DataFrame | None = None, artifacts: DataFrame | None = None,
          extra: dict[str, DataFrame] | None = None) -> DataFrame:
    """One row per evaluation: aspect ratings, evidence strength and the score or its withholding.

    Dimensions beyond the five built-in ones have verdicts but no rating.
    """
    by = [key]
    graded = keep(verdicts(rows, models, key, min_group_n, fallbacks, seed, probes, checks, artifacts, extra))  # a row per probe, read four times
    graded = graded.filter(F.col("dimension").isin(*S.DIMENSIONS))
    proposed = S.propose(graded, S.bands_v4(graded), by)
    item = F.struct("aspect", "O", "S", "D", "status")
    aspects = proposed.groupBy(*by).agg(F.sort_array(F.collect_list(item)).alias("aspects"))  # five aspects
    return aspects.join(S.score_or_withhold(proposed, by), by).join(S.summarize(graded, by), by).join(
        S.overall_confidence(proposed, by), by).withColumn("aspects", F.to_json("aspects"))
