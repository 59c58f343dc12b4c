"""Group and classification metrics (MET)."""

from pyspark.sql import functions as F

from ..operators import metrics as M
from .base import query

BY = ["evaluation_id"]


def stats_cte(view: str, grp: str = "grp", by: str = "evaluation_id") -> str:
    """SQL for per-group statistics, as a continued CTE list."""
    return f""", gs0 AS (
 SELECT {by}, CAST({grp} AS STRING) AS grp, count(*) AS n,
  count(*) FILTER (WHERE label = 1 AND y_hat = 1) AS tp, count(*) FILTER (WHERE label <> 1 AND y_hat = 1) AS fp,
  count(*) FILTER (WHERE label = 1 AND y_hat <> 1) AS fn, count(*) FILTER (WHERE label <> 1 AND y_hat <> 1) AS tn,
  count(*) FILTER (WHERE label = y_hat) AS correct
 FROM {view} GROUP BY 1, 2), gs AS (
 SELECT *, tp + fn AS positives, (tp + fp)::DOUBLE / n AS positive_rate,
  coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS tpr, coalesce(fp::DOUBLE / nullif(fp + tn, 0), 0) AS fpr,
  coalesce((2 * tp)::DOUBLE / nullif(2 * tp + fp + fn, 0), 0) AS f1, (tp + fn)::DOUBLE / n AS label_rate,
  correct::DOUBLE / n AS accuracy FROM gs0)"""


def wilson_sql(k: str, n: str) -> tuple[str, str]:
    c = f"(({k})::DOUBLE / ({n}) + 3.8416 / (2.0 * ({n})))"
    h = f"1.96 * sqrt(({k})::DOUBLE / ({n}) * (1 - ({k})::DOUBLE / ({n})) / ({n}) + 3.8416 / (4.0 * ({n}) * ({n})))"
    d = f"(1 + 3.8416 / ({n}))"
    return (f"CASE WHEN ({n}) > 0 THEN greatest(0.0::DOUBLE, ({c} - {h}) / {d}) ELSE 0.0::DOUBLE END",
            f"CASE WHEN ({n}) > 0 THEN least(1.0::DOUBLE, ({c} + {h}) / {d}) ELSE 0.0::DOUBLE END")


def _gaps(stats_view: str, col_sql: str, name: str) -> str:
    return (stats_cte(stats_view) + f""" SELECT evaluation_id, count(*) AS n_groups,
    round(CASE WHEN count(*) >= 2 THEN {col_sql} END, 6) AS {name} FROM gs GROUP BY 1""")


@query("met_01_cells", "SELECT evaluation_id, grp, label, y_hat, count(*) AS n FROM v_pred_big GROUP BY ALL", ("v_pred_big",))
def _(v):
    return M.cells(v("v_pred_big"), BY)


@query("met_02_group_stats", stats_cte("v_pred_big", "nation") + """
SELECT evaluation_id, grp, n, tp, fp, fn, tn, correct, positives, round(positive_rate, 6) AS positive_rate,
 round(tpr, 6) AS tpr, round(fpr, 6) AS fpr, round(f1, 6) AS f1, round(label_rate, 6) AS label_rate,
 round(accuracy, 6) AS accuracy FROM gs""", ("v_pred_big",))
def _(v):
    return M.group_stats(M.cells(v("v_pred_big"), BY, "nation"), BY)


def _gap_query(qname, col_sql, name):
    @query(qname, _gaps("v_pred_big", col_sql, name), ("v_pred_big",))
    def _(v):
        return M.group_gaps(M.group_stats(M.cells(v("v_pred_big"), BY), BY), BY, [name])


_gap_query("met_03_demographic_parity", "max(positive_rate) - min(positive_rate)", "dpd")
_gap_query("met_04_equalized_odds", "greatest(max(tpr) - min(tpr), max(fpr) - min(fpr))", "eod")
_gap_query("met_06_f1_spread", "max(f1) - min(f1)", "f1_spread")


@query("met_05_equal_opportunity", stats_cte("v_pred_text") + """
SELECT evaluation_id, count(*) AS n_groups,
 round(CASE WHEN count(*) >= 2 AND min(positives) > 0 THEN max(tpr) - min(tpr) END, 6) AS eopp FROM gs GROUP BY 1""",
       ("v_pred_text",))
def _(v):
    return M.group_gaps(M.group_stats(M.cells(v("v_pred_text"), BY), BY), BY, ["eopp"])


@query("met_07_excess_parity", stats_cte("v_pred_big", "nation") + """
SELECT evaluation_id, round(max(label_rate) - min(label_rate), 6) AS label_rate_gap,
 round(greatest(max(positive_rate) - min(positive_rate) - (max(label_rate) - min(label_rate)), 0), 6) AS excess_dpd
FROM gs GROUP BY 1""", ("v_pred_big",))
def _(v):
    return M.fairness_bundle(v("v_pred_big"), BY, "nation").select("evaluation_id", "label_rate_gap", "excess_dpd")


@query("met_08_fairness_bundle", stats_cte("v_pred_big") + """
SELECT evaluation_id, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_groups,
 round(max(positive_rate) - min(positive_rate), 6) AS dpd,
 round(greatest(max(tpr) - min(tpr), max(fpr) - min(fpr)), 6) AS eod,
 round(CASE WHEN min(positives) > 0 THEN max(tpr) - min(tpr) END, 6) AS eopp,
 round(max(f1) - min(f1), 6) AS f1_spread, round(max(fpr) - min(fpr), 6) AS fpr_gap,
 round(max(label_rate) - min(label_rate), 6) AS label_rate_gap,
 round(greatest(max(positive_rate) - min(positive_rate) - (max(label_rate) - min(label_rate)), 0), 6) AS excess_dpd,
 min(n) AS min_group_n_observed, bool_or(label_rate IN (0, 1)) AS single_class_group
FROM gs GROUP BY 1""", ("v_pred_big",))
def _(v):
    return M.fairness_bundle(v("v_pred_big"), BY)


@query("met_09_fpr_gap", stats_cte("v_pred_text") + """
SELECT evaluation_id, round(max(fpr) - min(fpr), 6) AS fpr_gap, bool_or(label_rate IN (0, 1)) AS single_class_group
FROM gs GROUP BY 1""", ("v_pred_text",))
def _(v):
    return M.fairness_bundle(v("v_pred_text"), BY).select("evaluation_id", "fpr_gap", "single_class_group")


_WLO, _WHI = wilson_sql("correct", "n")


@query("met_10_group_accuracy", stats_cte("v_pred_big", "nation") + f"""
SELECT evaluation_id, grp, n, correct, round(accuracy, 6) AS accuracy, round({_WLO}, 6) AS ci_lower,
 round({_WHI}, 6) AS ci_upper, n < 350 AS excluded FROM gs""", ("v_pred_big",))
def _(v):
    return M.group_accuracy(v("v_pred_big"), BY, 350, "nation")


@query("met_11_accuracy_gap", stats_cte("v_pred_big", "nation") + """
SELECT evaluation_id, count(*) FILTER (WHERE n >= 350) AS compared_groups, count(*) FILTER (WHERE n < 350) AS excluded_groups,
 round(CASE WHEN count(*) FILTER (WHERE n >= 350) >= 2 THEN max(accuracy) FILTER (WHERE n >= 350) - min(accuracy) FILTER (WHERE n >= 350)
 ELSE 0 END, 6) AS acc_gap FROM gs GROUP BY 1""", ("v_pred_big",))
def _(v):
    return M.accuracy_gap(v("v_pred_big"), BY, 350, "nation")


_COLLAPSE = """, cc AS (SELECT {by}, y_hat, count(*) AS k FROM {view} GROUP BY 1, 2),
 co AS (SELECT {by}, first(y_hat ORDER BY k DESC, y_hat) AS majority_class, max(k)::DOUBLE / sum(k) AS majority_share,
  max(k)::DOUBLE / sum(k) >= 0.98 AS collapsed FROM cc GROUP BY 1)"""


@query("met_12_prediction_collapse", _COLLAPSE.format(by="nation", view="v_pred_big") +
       " SELECT nation, majority_class, round(majority_share, 6) AS majority_share, collapsed FROM co", ("v_pred_big",))
def _(v):
    return M.collapse(v("v_pred_big"), ["nation"])


_ROB = """, r0 AS (SELECT {by} AS evaluation_id, count(*) AS n_evaluated, count(*) FILTER (WHERE y_hat = label) AS clean_correct,
 count(*) FILTER (WHERE y_robust = label) AS robust_correct,
 count(*) FILTER (WHERE y_hat = label AND y_robust <> label) AS flipped FROM {view} GROUP BY 1),
 rb AS (SELECT *, clean_correct::DOUBLE / n_evaluated AS ca, robust_correct::DOUBLE / n_evaluated AS ra FROM r0)"""
_CLO, _CHI = wilson_sql("clean_correct", "n_evaluated")
_RLO, _RHI = wilson_sql("robust_correct", "n_evaluated")


@query("met_13_robustness", _ROB.format(by="evaluation_id", view="v_pred_big") + f"""
SELECT evaluation_id, n_evaluated, clean_correct, robust_correct, round(ca, 6) AS clean_accuracy, round(ra, 6) AS robust_accuracy,
 round(ca - ra, 6) AS accuracy_drop, round(ra / greatest(ca, 0.05), 6) AS relative_degradation,
 round(ra / nullif(ca, 0), 6) AS degradation_ratio, round(flipped::DOUBLE / n_evaluated, 6) AS flip_share_all,
 round({_CLO}, 6) AS clean_lo, round({_CHI}, 6) AS clean_hi, round({_RLO}, 6) AS robust_lo, round({_RHI}, 6) AS robust_hi
FROM rb""", ("v_pred_big",))
def _(v):
    return M.robustness_metrics(v("v_pred_big"), BY)


_SEVERE = """, sv AS (SELECT {by}, count(*) FILTER (WHERE label = 1) AS pos_n,
 count(*) FILTER (WHERE label = 1 AND y_hat <> 1) AS pos_missed, count(*) FILTER (WHERE label = 1 AND severe = 1) AS severe_n,
 count(*) FILTER (WHERE label = 1 AND severe = 1 AND y_hat <> 1) AS severe_missed, count(*) FILTER (WHERE label <> 1) AS neg_n,
 count(*) FILTER (WHERE label <> 1 AND y_hat = 1) AS neg_hit FROM {view} GROUP BY 1)"""
_SLO, _SHI = wilson_sql("severe_missed", "severe_n")
_OK = "(pos_n > 0 AND severe_n >= 30)"
_SEV_COLS = f"""CASE WHEN pos_n = 0 THEN 0 ELSE severe_n END AS severe_n,
 round(CASE WHEN {_OK} THEN severe_missed::DOUBLE / severe_n END, 6) AS severe_fnr,
 round(CASE WHEN {_OK} THEN {_SLO} END, 6) AS severe_lo, round(CASE WHEN {_OK} THEN {_SHI} END, 6) AS severe_hi,
 round(CASE WHEN {_OK} THEN pos_missed::DOUBLE / pos_n END, 6) AS overall_fnr,
 round(CASE WHEN {_OK} AND pos_missed > 0 THEN (severe_missed::DOUBLE / severe_n) / (pos_missed::DOUBLE / pos_n) END, 6) AS fnr_ratio,
 round(CASE WHEN {_OK} THEN 1 - pos_missed::DOUBLE / pos_n END, 6) AS harmful_recall,
 round(CASE WHEN {_OK} THEN neg_hit::DOUBLE / nullif(neg_n, 0) END, 6) AS benign_fpr"""


@query("met_14_severe_behavior", _SEVERE.format(by="nation", view="v_pred_big") + f"""
SELECT nation, CASE WHEN {_OK} THEN 'EVALUATED' ELSE 'INSUFFICIENT_EVIDENCE' END AS status,
 CASE WHEN pos_n = 0 THEN 'no_positive_rows' WHEN NOT {_OK} THEN 'too_few_severe_rows' ELSE '' END AS flag, {_SEV_COLS}
FROM sv""", ("v_pred_big",))
def _(v):
    return M.severe_behavior(v("v_pred_big"), ["nation"])


@query("met_15_severe_with_collapse", _SEVERE.format(by="grp", view="v_pred_text") + _COLLAPSE.format(by="grp", view="v_pred_text") + f"""
, j AS (SELECT sv.grp, collapsed, majority_class, majority_share,
 CASE WHEN {_OK} THEN 'EVALUATED' ELSE 'INSUFFICIENT_EVIDENCE' END AS status0,
 CASE WHEN pos_n = 0 THEN 'no_positive_rows' WHEN NOT {_OK} THEN 'too_few_severe_rows' ELSE '' END AS flag0, {_SEV_COLS}
 FROM sv JOIN co USING (grp)), k AS (SELECT *, collapsed AND majority_class = 1 AS refused FROM j)
SELECT grp, CASE WHEN refused THEN 'INSUFFICIENT_EVIDENCE' ELSE status0 END AS status,
 CASE WHEN NOT collapsed THEN flag0 WHEN refused OR flag0 = '' THEN 'constant_predictor' ELSE flag0 || ';constant_predictor' END AS flags,
 CASE WHEN collapsed THEN round(majority_share, 6) END AS majority_class_share,
 {", ".join(f"CASE WHEN NOT refused THEN {c} END AS {c}" for c in ("severe_n", "severe_fnr", "severe_lo", "severe_hi", "overall_fnr", "fnr_ratio", "harmful_recall", "benign_fpr"))}
FROM k""", ("v_pred_text",))
def _(v):
    return M.severe_with_collapse(v("v_pred_text"), ["grp"])


RATES_SQL = """tp, fp, fn, tn, abstained, round(tp::DOUBLE / nullif(tp + fp, 0), 6) AS precision, round(tp::DOUBLE / nullif(tp + fn, 0), 6) AS recall,
 round(CASE WHEN tp > 0 THEN (2 * tp)::DOUBLE / (2 * tp + fp + fn) WHEN tp + fp > 0 OR tp + fn > 0 THEN 0 END, 6) AS f1"""


def confusion_sql(flag: str, truth: str) -> str:
    return f"""count(*) FILTER (WHERE {flag} AND {truth}) AS tp, count(*) FILTER (WHERE {flag} AND NOT {truth}) AS fp,
 count(*) FILTER (WHERE NOT {flag} AND {truth}) AS fn, count(*) FILTER (WHERE NOT {flag} AND NOT {truth}) AS tn,
 count(*) FILTER (WHERE {flag} IS NULL) AS abstained"""


@query("met_16_detector_rates", f""", d AS (SELECT dimension, CASE WHEN probe_status = 'EVALUATED' THEN aspect_scoring IN ('risk_detected', 'scored_risk') END AS flagged,
 risks <> '' AS truth FROM v_probes), c AS (SELECT dimension, {confusion_sql("flagged", "truth")} FROM d GROUP BY 1)
SELECT dimension, {RATES_SQL} FROM c""", ("v_probes",))
def _(v):
    df = v("v_probes").select(
        "dimension",
        F.when(F.col("probe_status") == "EVALUATED", F.col("aspect_scoring").isin("risk_detected", "scored_risk")).alias("flagged"),
        (F.col("risks") != "").alias("truth"))
    return M.detector_rates(df, ["dimension"])


@query("met_17_base_rates", """
SELECT evaluation_id, nation, count(*) AS n, count(*) FILTER (WHERE label = 1) AS positives,
 round(count(*) FILTER (WHERE label = 1)::DOUBLE / count(*), 6) AS positive_rate FROM v_pred_big GROUP BY 1, 2""", ("v_pred_big",))
def _(v):
    return M.base_rates(v("v_pred_big"), ["evaluation_id", "nation"])
