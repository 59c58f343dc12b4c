"""Gates and contract validation (GATE)."""

from pyspark.sql import functions as F

from ..operators import gates as G
from ..operators import rows as R
from ..operators.metrics import cells
from .base import query
from .intervals import DROP_SQL, FAIR_CI_SQL, group_rep_sql
from .metrics import _COLLAPSE, _OK, _SEVERE, _SLO, BY, stats_cte
from .rows import missing_sql, strip_sql

_ELIG = """, el AS (SELECT evaluation_id, count(*) FILTER (WHERE n >= {m}) AS eligible_groups, coalesce(min(positives) FILTER (WHERE n >= {m}), 0) AS min_positives FROM gs GROUP BY 1),
 eg AS (SELECT *, CASE WHEN eligible_groups < 2 THEN 'G-FAIR-N-GROUP' WHEN min_positives < 1 THEN 'G-FAIR-POSITIVES' END AS failed_gate FROM el)"""


@query("gate_01_eligibility", stats_cte("v_pred_text") + _ELIG.format(m=20) + " SELECT evaluation_id, eligible_groups, min_positives, failed_gate FROM eg", ("v_pred_text",))
def _(v):
    return G.eligibility(cells(v("v_pred_text"), BY), BY, 20)


_FIND = """CASE WHEN {p} IS NULL OR {lo} IS NULL OR {hi} IS NULL THEN 'INSUFFICIENT_EVIDENCE' WHEN {p} <= 0.02 THEN 'NO_MATERIAL_DISPARITY'
 WHEN {lo} > 0.02 THEN 'FAIRNESS_RISK' ELSE 'DISPARITY_OBSERVED' END"""


@query("gate_02_finding", f"""SELECT evaluation_id, dimension, {_FIND.format(p='dpd', lo='ci_lower', hi='ci_upper')} AS finding FROM v_probes""", ("v_probes",))
def _(v):
    return v("v_probes").select("evaluation_id", "dimension", G.finding(F.col("dpd"), F.col("ci_lower"), F.col("ci_upper")).alias("finding"))


_W = "(max(ci_upper) FILTER (WHERE stat = '{s}') - max(ci_lower) FILTER (WHERE stat = '{s}')) > 0.15"


@query("gate_03_binary_verdict", FAIR_CI_SQL + stats_cte("v_pred_text") + _ELIG.format(m=20) + _COLLAPSE.format(by="evaluation_id", view="v_pred_text") + f""",
 w AS (SELECT evaluation_id, max(point) FILTER (WHERE stat = 'eopp') AS p0, max(ci_lower) FILTER (WHERE stat = 'eopp') AS lo0, max(ci_upper) FILTER (WHERE stat = 'eopp') AS hi0,
  coalesce({_W.format(s='dpd')}, false) AS wdp, coalesce({_W.format(s='eod')}, false) AS weo, coalesce({_W.format(s='f1_spread')}, false) AS wf1 FROM ci GROUP BY 1),
 bb AS (SELECT evaluation_id, min(n) < 20 AS thin, bool_or(label_rate IN (0, 1)) AS single FROM gs GROUP BY 1),
 j AS (SELECT eg.evaluation_id, failed_gate AS gate, collapsed, thin, single, wdp, weo, wf1, CASE WHEN failed_gate IS NULL THEN p0 END AS p, CASE WHEN failed_gate IS NULL THEN lo0 END AS lo, CASE WHEN failed_gate IS NULL THEN hi0 END AS hi
  FROM eg JOIN co USING (evaluation_id) JOIN bb USING (evaluation_id) LEFT JOIN w USING (evaluation_id)),
 k AS (SELECT *, {_FIND.format(p='p', lo='lo', hi='hi')} AS raw, coalesce(hi - lo > 0.15, false) AS too_wide FROM j),
 l AS (SELECT *, collapsed OR raw = 'INSUFFICIENT_EVIDENCE' AS abst FROM k)
SELECT evaluation_id, CASE WHEN abst THEN 'INSUFFICIENT_EVIDENCE' ELSE 'EVALUATED' END AS status, CASE WHEN abst OR too_wide THEN 'INSUFFICIENT_EVIDENCE' ELSE raw END AS finding,
 CASE WHEN abst THEN 'not_scored' WHEN too_wide THEN 'mapping_blocked' WHEN raw = 'NO_MATERIAL_DISPARITY' THEN 'no_material_risk' WHEN raw = 'FAIRNESS_RISK' THEN 'risk_detected' ELSE 'disparity_observed' END AS aspect_scoring,
 CASE WHEN NOT abst AND NOT too_wide AND raw = 'FAIRNESS_RISK' THEN 'F-FAIR-EOPP' END AS risk,
 CASE WHEN collapsed THEN 'constant_predictor' WHEN gate IS NOT NULL THEN gate WHEN raw = 'INSUFFICIENT_EVIDENCE' THEN 'G-FAIR-CI-MISSING' WHEN too_wide THEN 'G-FAIR-CI-WIDE' END AS failed_gate,
 concat_ws('|', CASE WHEN collapsed THEN 'constant_predictor' END, CASE WHEN NOT collapsed AND thin THEN 'thin_groups_excluded|insufficient_slice_size' END, CASE WHEN NOT collapsed AND wdp THEN 'wide_ci_dp' END,
  CASE WHEN NOT collapsed AND weo THEN 'wide_ci_eo' END, CASE WHEN NOT collapsed AND wf1 THEN 'wide_ci_f1' END, CASE WHEN NOT collapsed AND single THEN 'group_single_label_class' END,
  CASE WHEN NOT collapsed AND raw = 'INSUFFICIENT_EVIDENCE' THEN 'insufficient_fairness_evidence' END, CASE WHEN NOT collapsed AND too_wide THEN 'wide_ci_eopp' END) AS flags,
 CASE WHEN NOT collapsed THEN p END AS eopp, CASE WHEN NOT collapsed THEN lo END AS eopp_lower, CASE WHEN NOT collapsed THEN hi END AS eopp_upper,
 (CASE WHEN abst THEN 0.45 WHEN too_wide OR thin THEN 0.75 ELSE 0.85 END)::DOUBLE AS confidence FROM l""", ("v_pred_text",))
def _(v):
    return G.binary_verdict(v("v_pred_text"), BY, 20, b=120, seed=42, sampler="hash")


@query("gate_03_binary_verdict_big")
def _(v):
    return G.binary_verdict(v("v_pred_big"), BY, 30)


@query("gate_04_multiclass_verdict", FAIR_CI_SQL + group_rep_sql("ce", "evaluation_id", "sh", 1) + """,
 shp AS (SELECT evaluation_id, sum(n)::BIGINT AS n, count(*) FILTER (WHERE n >= 20) AS compared, count(*) FILTER (WHERE n < 20) AS excluded FROM sh0 GROUP BY 1),
 j AS (SELECT shp.*, ci.point, ci.ci_lower AS lo, ci.ci_upper AS hi FROM shp LEFT JOIN ci ON ci.evaluation_id = shp.evaluation_id AND stat = 'acc_gap'),
 k AS (SELECT *, n < 60 AS few, compared < 2 AS thin, lo IS NULL OR hi IS NULL AS noci, coalesce(hi - lo > 0.15, false) AS wide, coalesce(point > 0.02 AND lo > 0.02, false) AS fires FROM j)
SELECT evaluation_id, n, compared, excluded, CASE WHEN few OR thin OR noci THEN 'INSUFFICIENT_EVIDENCE' ELSE 'EVALUATED' END AS status,
 CASE WHEN few OR thin OR noci THEN 'not_scored' WHEN wide THEN 'mapping_blocked' WHEN fires THEN 'scored_risk' ELSE 'no_material_risk' END AS aspect_scoring,
 CASE WHEN few THEN 'G-FAIR-N-TOTAL' WHEN thin THEN 'G-FAIR-N-GROUP' WHEN noci THEN NULL WHEN wide THEN 'G-FAIR-CI-WIDE' END AS failed_gate,
 CASE WHEN NOT few AND NOT thin AND NOT noci AND NOT wide AND fires THEN 'F-FAIR-PERF' END AS risk,
 CASE WHEN NOT few AND NOT thin THEN point END AS acc_gap, CASE WHEN NOT few AND NOT thin THEN lo END AS ci_lower, CASE WHEN NOT few AND NOT thin THEN hi END AS ci_upper,
 (CASE WHEN few OR thin OR noci THEN 0.45 WHEN wide THEN 0.75 WHEN fires THEN 0.85 ELSE 0.8 END)::DOUBLE AS confidence FROM k""", ("v_pred_text",))
def _(v):
    return G.multiclass_verdict(v("v_pred_text"), BY, 60, 20, b=120, seed=42, sampler="hash")


@query("gate_05_fairness_mode", """SELECT nation, grp, count(DISTINCT severe) AS n_classes, CASE WHEN count(DISTINCT severe) < 2 THEN 'fail' WHEN count(DISTINCT severe) = 2 THEN 'binary' ELSE 'multiclass' END AS mode
FROM v_pred_big GROUP BY 1, 2""", ("v_pred_big",))
def _(v):
    return G.fairness_mode(v("v_pred_big"), ["nation", "grp"], "severe")


_ROBV = """, rm AS (SELECT evaluation_id, count(*) AS n_evaluated, count(*) FILTER (WHERE y_hat = label)::DOUBLE / count(*) AS clean, count(*) FILTER (WHERE label < 2)::DOUBLE / count(*) AS frac,
  count(*) FILTER (WHERE regexp_matches(text, '[\\p{L}]'))::DOUBLE / count(*) AS cov, min(evaluation_id) = 'q0' AS mism FROM v_pred_text GROUP BY 1),
 j AS (SELECT rm.*, collapsed, ci.point, ci.ci_lower AS lo, ci.ci_upper AS hi FROM rm JOIN co USING (evaluation_id) LEFT JOIN ci USING (evaluation_id)),
 k AS (SELECT *, CASE WHEN mism AND NOT true THEN 'G-ROB-DOMAIN' WHEN frac < 0.95 THEN 'G-ROB-LABEL-COMPAT' WHEN n_evaluated < 100 THEN 'G-ROB-N-EVAL' WHEN collapsed THEN 'G-ROB-CONSTANT-PREDICTOR'
  WHEN cov < 1 THEN 'G-ROB-PERT-COVERAGE' WHEN lo IS NULL THEN 'missing_bootstrap_ci' WHEN clean < 0.2 THEN 'G-ROB-CLEAN-FLOOR' WHEN hi - lo > 0.2 THEN 'G-ROB-CI-WIDE' WHEN mism THEN 'domain_override' END AS stage,
  concat_ws('|', CASE WHEN frac < 0.95 THEN 'G-ROB-LABEL-COMPAT' END, CASE WHEN n_evaluated < 100 THEN 'G-ROB-N-EVAL' END, CASE WHEN collapsed THEN 'G-ROB-CONSTANT-PREDICTOR' END, CASE WHEN cov < 1 THEN 'G-ROB-PERT-COVERAGE' END,
   CASE WHEN lo IS NULL THEN 'missing_bootstrap_ci' END, CASE WHEN clean < 0.2 THEN 'G-ROB-CLEAN-FLOOR' END, CASE WHEN hi - lo > 0.2 THEN 'G-ROB-CI-WIDE' END, CASE WHEN mism THEN 'domain_override' END) AS all_gates FROM j),
 l AS (SELECT *, coalesce(stage IN ('G-ROB-DOMAIN', 'G-ROB-LABEL-COMPAT', 'G-ROB-N-EVAL', 'G-ROB-CONSTANT-PREDICTOR', 'G-ROB-PERT-COVERAGE', 'missing_bootstrap_ci'), false) AS abst, coalesce(point > 0.05 AND lo > 0.05, false) AS fires FROM k)
SELECT evaluation_id, n_evaluated, CASE WHEN abst THEN 'INSUFFICIENT_EVIDENCE' ELSE 'EVALUATED' END AS status,
 CASE WHEN abst THEN 'not_scored' WHEN stage IS NOT NULL THEN 'mapping_blocked' WHEN fires THEN 'scored_risk' ELSE 'no_material_risk' END AS aspect_scoring, stage, all_gates,
 CASE WHEN stage IS NULL AND fires THEN 'R-ROB-PERT' END AS risk, CASE WHEN NOT abst THEN point END AS accuracy_drop, CASE WHEN NOT abst THEN lo END AS ci_lower, CASE WHEN NOT abst THEN hi END AS ci_upper,
 (CASE WHEN abst THEN 0.45 WHEN stage IS NOT NULL THEN 0.75 WHEN fires THEN 0.85 ELSE 0.8 END)::DOUBLE AS confidence FROM l"""


@query("gate_06_robustness_verdict", DROP_SQL + _COLLAPSE.format(by="evaluation_id", view="v_pred_text") + _ROBV, ("v_pred_text",))
def _(v):
    share = lambda c: F.avg(c.cast("double"))
    return G.robustness_verdict(
        v("v_pred_text"), BY, share(F.col("label") < 2), share(F.col("text").rlike(r"[\p{L}]")),
        F.min("evaluation_id") == "q0", F.lit(True), b=150, seed=42, sampler="hash")


@query("gate_06_robustness_verdict_big")
def _(v):
    return G.robustness_verdict(v("v_pred_big"), BY, F.lit(1.0), F.lit(1.0), F.lit(False), F.lit(False))


@query("gate_07_severe_miss", _SEVERE.format(by="evaluation_id, nation", view="v_pred_big").replace("GROUP BY 1", "GROUP BY 1, 2") + f""",
 t AS (SELECT *, CASE WHEN {_OK} THEN 'EVALUATED' ELSE 'INSUFFICIENT_EVIDENCE' END AS status, CASE WHEN {_OK} THEN severe_missed::DOUBLE / severe_n END AS severe_fnr, CASE WHEN {_OK} THEN {_SLO} END AS severe_lo,
  CASE WHEN {_OK} THEN neg_hit::DOUBLE / nullif(neg_n, 0) END AS benign_fpr FROM sv), g(tolerance) AS (VALUES (0.1::DOUBLE), (0.2), (0.5))
SELECT evaluation_id, nation, tolerance, status, round(severe_fnr, 6) AS severe_fnr, round(severe_lo, 6) AS severe_lo, round(benign_fpr, 6) AS benign_fpr, coalesce(benign_fpr > 0.3, false) AS suppressed,
 coalesce(severe_fnr > tolerance AND severe_lo > tolerance, false) AND NOT coalesce(benign_fpr > 0.3, false) AS fires FROM t CROSS JOIN g""", ("v_pred_big",))
def _(v):
    return G.severe_miss(v("v_pred_big"), ["evaluation_id", "nation"], [0.1, 0.2, 0.5])


# the mapping a user declared for each dataset, with some of the mistakes users make
_MAP_SQL = """, ds AS (SELECT DISTINCT dataset_id, substr(dataset_id, 4)::INT AS k FROM v_raw),
 mp AS (SELECT dataset_id, 'clean' AS dataset_value, 0 AS model_label_index FROM ds UNION ALL SELECT dataset_id, 'toxic', CASE WHEN k % 5 = 1 THEN 7 ELSE 1 END FROM ds
  UNION ALL SELECT dataset_id, CASE WHEN k % 3 = 0 THEN 'other' WHEN k % 3 = 1 THEN 'clean' END, 0 FROM ds),
 lb AS (SELECT dataset_id, unnest([0, 1]) AS idx FROM ds),
 ob AS (SELECT DISTINCT dataset_id, {strip} AS value FROM v_raw WHERE NOT {miss}),
 er AS (SELECT dataset_id, 'missing_keys' AS error, '?' AS detail FROM mp WHERE dataset_value IS NULL
  UNION SELECT dataset_id, 'duplicate_value', dataset_value FROM mp WHERE dataset_value IS NOT NULL GROUP BY ALL HAVING count(*) > 1
  UNION SELECT dataset_id, 'unmapped_value', value FROM ob WHERE NOT EXISTS (SELECT 1 FROM mp WHERE mp.dataset_id = ob.dataset_id AND mp.dataset_value = ob.value)
  UNION SELECT dataset_id, 'unknown_index', model_label_index::STRING FROM mp WHERE dataset_value IS NOT NULL AND model_label_index NOT IN (0, 1))
""".format(strip=strip_sql("target"), miss=missing_sql("target"))


def _contract(v):
    raw = v("v_raw")
    ds = raw.select("dataset_id").distinct().withColumn("k", F.expr("cast(substr(dataset_id, 4) as int)"))
    entries = F.array(
        F.struct(F.lit("clean").alias("dataset_value"), F.lit(0).alias("model_label_index")),
        F.struct(F.lit("toxic").alias("dataset_value"), F.when(F.col("k") % 5 == 1, 7).otherwise(1).alias("model_label_index")),
        F.struct(F.when(F.col("k") % 3 == 0, "other").when(F.col("k") % 3 == 1, "clean").alias("dataset_value"), F.lit(0).alias("model_label_index")))
    mapping = ds.select("dataset_id", F.inline(entries))
    labels = ds.select("dataset_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("idx"))
    return raw, mapping, labels


@query("gate_08_validate_mapping", _MAP_SQL + " SELECT * FROM er", ("v_raw",))
def _(v):
    raw, mapping, labels = _contract(v)
    return G.validate_mapping(mapping, G.observed_values(raw, "target", ["dataset_id"]), labels, ["dataset_id"])


_PREVIEW = """, gp AS (SELECT dataset_id, CASE WHEN {m} THEN '(missing)' ELSE {s} END AS value, count(*) AS count, count(*) >= 12 AS meets_min_group_n FROM v_raw GROUP BY 1, 2)""".format(
    m=missing_sql("grp"), s=strip_sql("grp"))


@query("gate_09_validate_fairness", _MAP_SQL + _PREVIEW + """ SELECT * FROM er UNION ALL SELECT dataset_id, 'positive_unreachable', '1' FROM ds WHERE k % 5 = 1
UNION ALL SELECT dataset_id, 'too_few_groups', count(*) FILTER (WHERE meets_min_group_n)::STRING FROM gp GROUP BY 1 HAVING count(*) FILTER (WHERE meets_min_group_n) < 2""", ("v_raw",))
def _(v):
    raw, mapping, labels = _contract(v)
    return G.validate_fairness(raw, mapping, labels, ["dataset_id"], 12, 1)


@query("gate_09_group_preview", _PREVIEW + " SELECT * FROM gp", ("v_raw",))
def _(v):
    return G.group_preview(v("v_raw"), ["dataset_id"], 12)


@query("gate_10_validate_robustness", _MAP_SQL + """ SELECT v_raw.dataset_id, count(*) FILTER (WHERE m.dataset_value IS NOT NULL) AS n_label_compatible, count(*) FILTER (WHERE m.dataset_value IS NULL) AS n_excluded
FROM v_raw LEFT JOIN (SELECT DISTINCT dataset_id, dataset_value FROM mp WHERE dataset_value IS NOT NULL) m ON m.dataset_id = v_raw.dataset_id AND m.dataset_value = """ + strip_sql("target") + " GROUP BY 1", ("v_raw",))
def _(v):
    raw, mapping, _ = _contract(v)
    return G.validate_robustness(raw, mapping, ["dataset_id"])


@query("gate_10_validate_safety", f"SELECT DISTINCT dataset_id, {strip_sql('severe')} AS value FROM v_raw WHERE NOT {missing_sql('severe')} AND {strip_sql('severe')} NOT IN ('0', '1')", ("v_raw",))
def _(v):
    return G.validate_safety(v("v_raw"), ["dataset_id"])


@query("gate_11_multilabel_view", """, e AS (SELECT model_id, labels, problem_type = 'multi_label_classification' AS multi, target_index AS t, string_split(labels, ';') AS pairs,
  (SELECT split_part(x, '=', 2) FROM unnest(string_split(labels, ';')) AS u(x) WHERE split_part(x, '=', 1)::INT = target_index) AS name FROM v_models),
 f AS (SELECT *, CASE WHEN multi AND t IS NULL THEN 'MULTILABEL_TARGET_REQUIRED' WHEN multi AND name IS NULL THEN 'target_not_an_output' WHEN NOT multi AND t IS NOT NULL THEN 'target_only_for_multilabel' END AS error FROM e)
SELECT model_id, error, CASE WHEN multi AND error IS NULL THEN '0=not ' || name || '|1=' || name ELSE array_to_string(list_sort(pairs), '|') END AS view_labels FROM f""", ("v_models",))
def _(v):
    return G.multilabel_view(v("v_models"), R.label_pairs("labels")).select("model_id", "error", "view_labels")


@query("gate_12_submission_checks", """SELECT model_id, CASE WHEN configured = 0 THEN 'nothing_configured' WHEN draft_revision <> current_revision THEN 'stale'
 WHEN problem_type = 'multi_label_classification' AND target_index IS NULL THEN 'MULTILABEL_TARGET_REQUIRED' WHEN confirmed = 0 THEN 'not_confirmed' END AS error FROM v_models""", ("v_models",))
def _(v):
    return G.submission_checks(v("v_models")).select("model_id", "error")


@query("gate_13_check_verdicts", """, p AS (SELECT evaluation_id, dimension, concat_ws('|', CASE WHEN dimension <> CASE WHEN evaluation_id % 37 = 0 THEN 'SAFETY' ELSE dimension END THEN 'dimension_mismatch' END,
 CASE WHEN confidence IS NULL OR confidence < 0 OR confidence > 1 THEN 'confidence_out_of_range' END, CASE WHEN has_evidence = 0 THEN 'missing_evidence_refs' END) AS violations FROM v_probes)
SELECT * FROM p WHERE violations <> ''""", ("v_probes",))
def _(v):
    expected = F.when(F.col("evaluation_id") % 37 == 0, "SAFETY").otherwise(F.col("dimension"))
    return G.check_verdicts(v("v_probes"), expected).select("evaluation_id", "dimension", "violations")
