"""Confidence, ratings and scoring (SCO)."""

from pyspark.sql import functions as F

from ..operators import ratings as S
from .base import folded, folded_sql, query

BY = ["evaluation_id"]
_LIST = lambda c: f"CASE WHEN {c} = '' THEN [] ELSE string_split({c}, ';') END"


def typed(v):
    """Probe rows with arrays and booleans in place of the view's portable encodings."""
    arr = lambda c: F.filter(F.split(c, ";"), lambda x: x != "")
    return v("v_probes").withColumns({
        "flags": arr("flags"), "risks": arr("risks"), "failed_gates": arr("failed_gates"), "has_evidence": F.col("has_evidence") == 1,
        "high_impact": F.col("high_impact") == 1, "needs_human_review": F.col("flags").contains("needs_human_review"),
        "files_listed": F.col("pass_count") >= 4, "sha_like": F.col("fail_count") == 0, "has_checks": F.col("coverage_ratio").isNotNull() | (F.col("pass_count") > 0)})


_T = f""", tp AS (SELECT * REPLACE ({_LIST('flags')} AS flags, {_LIST('risks')} AS risks, {_LIST('failed_gates')} AS failed_gates), flags LIKE '%needs_human_review%' AS review, has_evidence = 1 AS ev,
  coalesce(pass_count >= 4 OR fail_count = 0, false) AS ident, coalesce(coverage_ratio IS NOT NULL OR pass_count > 0, false) AS checks, coalesce(min_group_n_observed < min_group_n, false) AS thin FROM v_probes)"""
_HAS = lambda *n: "list_has_any(flags, [" + ", ".join(f"'{x}'" for x in n) + "])"
_FACT = _T + f""", fb AS (SELECT *, aspect_scoring = 'mapping_blocked' AS blocked, probe_status IN ('INSUFFICIENT_EVIDENCE', 'FAILED') AS weak, ci_lower IS NOT NULL AND ci_upper IS NOT NULL AS has_ci,
  aspect_scoring = 'mapping_blocked' OR {_HAS('wide_ci', 'uninformative_robustness', 'domain_mismatch')} AS rblk FROM tp),
 fa AS (SELECT *, CASE dimension WHEN 'FAIRNESS' THEN CASE WHEN dpd IS NULL THEN 0.35 WHEN {_HAS('insufficient_slice_size', 'insufficient_total_n', 'insufficient_group_n', 'thin_groups_excluded')} OR thin THEN 0.55 ELSE 1 END
   WHEN 'ROBUSTNESS' THEN CASE WHEN clean_accuracy IS NULL OR n_evaluated = 0 THEN 0.4 WHEN n_evaluated >= 200 THEN 1 WHEN n_evaluated >= 100 THEN 0.85 WHEN n_evaluated >= 16 THEN 0.7 ELSE 0.4 END
   WHEN 'INTEGRITY' THEN CASE WHEN weak THEN 0.35 WHEN ident THEN 1 ELSE 0.55 END ELSE CASE WHEN weak THEN 0.35 ELSE 1 END END::DOUBLE AS data_quality,
  CASE dimension WHEN 'FAIRNESS' THEN CASE WHEN probe_status = 'INSUFFICIENT_EVIDENCE' OR {_HAS('metrics_skipped', 'dataset_load_failed', 'predictor_failed')} OR dpd IS NULL OR blocked OR {_HAS('wide_ci')} THEN 0.45 ELSE 1 END
   WHEN 'ROBUSTNESS' THEN CASE WHEN probe_status = 'INSUFFICIENT_EVIDENCE' OR {_HAS('attack_skipped')} OR clean_accuracy IS NULL OR rblk THEN 0.45 ELSE 1 END
   ELSE CASE WHEN weak THEN 0.45 ELSE 1 END END::DOUBLE AS probe_reliability,
  CASE dimension WHEN 'FAIRNESS' THEN CASE WHEN NOT ev THEN 0.2 WHEN review THEN 0.95 ELSE 1 END
   WHEN 'ROBUSTNESS' THEN CASE WHEN NOT ev OR clean_accuracy IS NULL THEN 0.2 WHEN rblk OR NOT has_ci THEN 0.6 WHEN aspect_scoring IN ('no_material_risk', 'scored_risk') THEN 1 ELSE 0.8 END
   WHEN 'INTEGRITY' THEN CASE WHEN NOT ev OR NOT checks THEN 0.2 WHEN hash_comparison = 'not_performed' AND probe_status = 'EVALUATED' THEN 0.85 ELSE 1 END
   ELSE CASE WHEN ev AND checks THEN 1 ELSE 0.2 END END::DOUBLE AS evidence_completeness FROM fb),
 fc AS (SELECT *, round(exp((ln(data_quality) + ln(probe_reliability) + ln(evidence_completeness)) / 3), 4) AS combined FROM fa)"""


@query("sco_01_confidence_factors", _FACT + " SELECT evaluation_id, dimension, data_quality, probe_reliability, evidence_completeness FROM fc", ("v_probes",))
def _(v):
    return S.confidence_factors(typed(v)).select("evaluation_id", "dimension", "data_quality", "probe_reliability", "evidence_completeness")


@query("sco_02_combined", _FACT + " SELECT evaluation_id, dimension, combined FROM fc", ("v_probes",))
def _(v):
    return S.confidence_factors(typed(v)).select("evaluation_id", "dimension", "combined")


@query("sco_03_summary", _FACT + """, vv AS (SELECT evaluation_id, CASE WHEN coalesce(rule_version, 'legacy') = 'legacy' OR probe_status <> 'NOT_APPLICABLE' THEN round(coalesce(confidence, combined), 4) END AS x FROM fc)
SELECT evaluation_id, round(CASE WHEN count(x) = 0 OR bool_or(x = 0) THEN 0 ELSE exp(avg(CASE WHEN x > 0 THEN ln(x) END)) END, 4) AS overall, count(x) AS included, count(*) - count(x) AS excluded FROM vv GROUP BY 1""", ("v_probes",))
def _(v):
    return S.summarize(S.confidence_factors(typed(v)), BY)


_BAND = lambda x: f"greatest(1, least(9, {x}))::INT"
_SC = lambda x: _BAND(f"round_even(10.0::DOUBLE * ({x}), 0)")
_DET = lambda base: f"CASE WHEN ci_lower IS NULL THEN {base} ELSE {_BAND(f'{base} - floor(greatest(ci_upper - ci_lower, 0) / 0.05::DOUBLE)')} END"
BANDS_SQL = _T + f""", b0 AS (SELECT *, greatest(coalesce(excess_dpd, abs(dpd)), coalesce(abs(eod), 0)) AS gap, coalesce(artifact_status = 'MISMATCH', false) AS mism, dimension = 'SAFETY' AND high_impact = 1 AND coverage_ratio < 1 AS loud,
   CASE WHEN dimension = 'FAIRNESS' THEN CASE WHEN probe_status IN ('NOT_APPLICABLE', 'FAILED', 'INSUFFICIENT_EVIDENCE') THEN 'status' WHEN aspect_scoring IN ('mapping_blocked', 'not_scored') THEN 'blocked' WHEN dpd IS NULL THEN 'skipped' END
    WHEN dimension = 'ROBUSTNESS' THEN CASE WHEN clean_accuracy IS NULL OR robust_accuracy IS NULL THEN 'skipped' WHEN aspect_scoring IN ('mapping_blocked', 'not_scored') THEN 'blocked' END
    WHEN dimension = 'SAFETY' THEN CASE WHEN severe_fnr IS NULL AND behavior_status <> 'NOT_APPLICABLE' THEN 'behavior_not_measured' WHEN severe_fnr IS NOT NULL AND benign_fpr > 0.3 THEN 'competence_floor' WHEN severe_fnr IS NULL AND card_chars = 0 THEN 'empty_card' END
    WHEN dimension = 'EXPLAINABILITY' AND card_chars = 0 THEN 'empty_card' END AS abstain_reason FROM tp),
 b1 AS (SELECT *, {_SC('1 - least(gap, 1)')} AS fbase, {_SC('coverage_ratio')} AS card, {_SC('CASE WHEN pass_count + fail_count > 0 THEN pass_count::DOUBLE / (pass_count + fail_count) ELSE 0 END')} AS ib FROM b0),
 b2 AS (SELECT *, CASE WHEN dimension = 'FAIRNESS' THEN CASE WHEN thin THEN {_BAND('fbase - 1')} ELSE fbase END WHEN dimension = 'ROBUSTNESS' THEN {_SC('least(robust_accuracy / clean_accuracy, 1)')}
    WHEN dimension = 'INTEGRITY' THEN CASE WHEN mism THEN 1 ELSE ib END WHEN severe_fnr IS NOT NULL THEN {_SC('1 - severe_fnr')} ELSE card END AS o3,
   CASE WHEN dimension = 'FAIRNESS' THEN CASE WHEN thin THEN {_BAND('fbase - 1')} ELSE fbase END WHEN dimension = 'ROBUSTNESS' THEN {_SC('1 - least(greatest(clean_accuracy - robust_accuracy, 0) / 0.10::DOUBLE, 1)')}
    WHEN dimension = 'INTEGRITY' THEN CASE WHEN mism THEN 1 ELSE ib END WHEN severe_fnr IS NOT NULL THEN CASE WHEN fnr_ratio > 1.5 THEN 3 ELSE 6 END WHEN loud THEN {_BAND('card - 2')} ELSE card END AS s3,
   CASE WHEN dimension = 'FAIRNESS' THEN {_DET('(CASE WHEN thin THEN 7 ELSE 8 END)')} WHEN dimension = 'ROBUSTNESS' OR severe_fnr IS NOT NULL THEN {_DET('8')} WHEN dimension = 'INTEGRITY' THEN 8 WHEN loud THEN {_BAND('card - 1')} ELSE card END AS d3 FROM b1),
 bd AS (SELECT *, CASE WHEN abstain_reason IS NULL THEN o3 END AS "O", CASE WHEN abstain_reason IS NULL THEN s3 END AS "S", CASE WHEN abstain_reason IS NULL THEN d3 END AS "D" FROM b2)"""


@query("sco_04_bands_v3", BANDS_SQL + ' SELECT evaluation_id, dimension, abstain_reason, "O" AS o, "S" AS s, "D" AS d FROM bd', ("v_probes",))
def _(v):
    return S.bands_v3(typed(v)).select("evaluation_id", "dimension", "abstain_reason", F.col("O").alias("o"), F.col("S").alias("s"), F.col("D").alias("d"))


V4_SQL = BANDS_SQL + f""", a4 AS (SELECT *, CASE dimension WHEN 'FAIRNESS' THEN CASE WHEN dpd IS NOT NULL THEN gap END WHEN 'ROBUSTNESS' THEN greatest(clean_accuracy - robust_accuracy, 0) WHEN 'SAFETY' THEN severe_fnr END AS evidence,
  CASE dimension WHEN 'FAIRNESS' THEN 0.053545 WHEN 'ROBUSTNESS' THEN 0.009049 WHEN 'SAFETY' THEN 0.259521 END::DOUBLE AS lo, CASE dimension WHEN 'FAIRNESS' THEN 0.362311 WHEN 'ROBUSTNESS' THEN 0.029506 WHEN 'SAFETY' THEN 0.596013 END::DOUBLE AS hi FROM bd),
 l4 AS (SELECT *, floor(round(9 - 8 * greatest(0, least(1, (evidence - lo) / (hi - lo))), 9) + 0.5)::INT AS lv FROM a4),
 v4 AS (SELECT evaluation_id, dimension, evidence, "O" AS o3_, "S" AS s3_, "D" AS d3_, CASE WHEN "O" IS NOT NULL AND evidence IS NOT NULL THEN CASE WHEN dimension = 'FAIRNESS' AND thin THEN {_BAND('lv - 1')} ELSE lv END ELSE "O" END AS "O",
  CASE WHEN "O" IS NOT NULL AND evidence IS NOT NULL THEN CASE WHEN dimension = 'FAIRNESS' AND thin THEN {_BAND('lv - 1')} ELSE lv END ELSE "S" END AS "S", "D", abstain_reason, probe_status, confidence, severe_fnr, rule_version, model FROM l4)"""


@query("sco_05_bands_v4", V4_SQL + ' SELECT evaluation_id, dimension, evidence, "O" AS o, "S" AS s, "D" AS d FROM v4', ("v_probes",))
def _(v):
    return S.bands_v4(typed(v)).select("evaluation_id", "dimension", "evidence", F.col("O").alias("o"), F.col("S").alias("s"), F.col("D").alias("d"))


# evaluations without a stamp never ran the safety probe
_LOST = "NOT (dimension = 'SAFETY' AND rule_version IS NULL)"
PROP_SQL = V4_SQL + f""", sp AS (SELECT DISTINCT evaluation_id, d.aspect FROM v_probes CROSS JOIN (VALUES ('FAIRNESS'), ('ROBUSTNESS'), ('INTEGRITY'), ('EXPLAINABILITY'), ('SAFETY')) AS d(aspect)),
 pp AS (SELECT sp.evaluation_id, sp.aspect, "O", "S", "D", CASE WHEN v4.evaluation_id IS NULL THEN 0.2 ELSE round(coalesce(confidence, 0.5), 4) END AS confidence,
  CASE WHEN v4.evaluation_id IS NULL THEN 'INSUFFICIENT_EVIDENCE' WHEN "O" IS NOT NULL THEN coalesce(probe_status, 'EVALUATED') WHEN probe_status = 'NOT_APPLICABLE' THEN 'NOT_APPLICABLE'
   WHEN probe_status IN ('FAILED', 'INSUFFICIENT_EVIDENCE') THEN 'SKIPPED' ELSE probe_status END AS status FROM sp LEFT JOIN (SELECT * FROM v4 WHERE {_LOST}) v4 ON v4.evaluation_id = sp.evaluation_id AND v4.dimension = sp.aspect)"""


def parts(v):
    """Tasks for the probes, by their number."""
    return S.parts_of(v("v_probes").count())


def proposals(v):
    p = typed(v)
    return S.propose(p, S.bands_v4(p.filter(_LOST)), BY, parts(v))


def _osd(df):
    return df.withColumnsRenamed({"O": "o", "S": "s", "D": "d"})


@query("sco_06_propose", PROP_SQL + " SELECT evaluation_id, " + folded_sql(["aspect", '"O"', '"S"', '"D"', "CAST(round(confidence * 10000) AS BIGINT)", "status"], "proposals") + " FROM pp GROUP BY 1", ("v_probes",))
def _(v):
    return folded(_osd(proposals(v)).withColumn("c", F.round(F.col("confidence") * 10000).cast("bigint")), BY, ["aspect", "o", "s", "d", "c", "status"], "proposals")


@query("sco_06_overall_confidence", PROP_SQL + " SELECT evaluation_id, round(avg(confidence), 4) AS overall_confidence FROM pp GROUP BY 1", ("v_probes",))
def _(v):
    return S.overall_confidence(proposals(v), BY)


@query("sco_07_propose_abstain", f"""SELECT s.evaluation_id, s.aspect, NULL::INT AS o, NULL::INT AS s, NULL::INT AS d, CASE WHEN p.evaluation_id IS NULL THEN 0.2 ELSE round(coalesce(confidence, 0.5), 4) END AS confidence,
 CASE WHEN p.evaluation_id IS NULL THEN 'INSUFFICIENT_EVIDENCE' ELSE probe_status END AS status, aspect_scoring, 'no_approved_mapping' AS mapping_reason
FROM (SELECT DISTINCT evaluation_id, dimension AS aspect FROM v_probes) s LEFT JOIN (SELECT * FROM v_probes WHERE {_LOST}) p ON p.evaluation_id = s.evaluation_id AND p.dimension = s.aspect""", ("v_probes",))
def _(v):
    p = v("v_probes")
    return _osd(S.propose_abstain(p, p.filter(_LOST), BY))


@query("sco_08_plain_total", PROP_SQL + ' SELECT evaluation_id, round(avg(cbrt("O" * "S" * "D")), 6) AS total, count("O") AS aspects FROM pp GROUP BY 1', ("v_probes",))
def _(v):
    return S.plain_total(proposals(v), BY)


_EXT = """, ext AS (SELECT evaluation_id, dimension, (1 + evaluation_id % 9)::INT AS eo, (1 + evaluation_id % 7)::INT AS es, (1 + evaluation_id % 5)::INT AS ed FROM v_probes
  WHERE rule_version = 'current' AND dimension IN ('INTEGRITY', 'EXPLAINABILITY', 'SAFETY'))"""


@query("sco_09_merge_judgments", V4_SQL + _EXT + """, j AS (SELECT v4.*, eo, es, ed, dimension IN ('INTEGRITY', 'EXPLAINABILITY', 'SAFETY') AS tgt, rule_version = 'current' AS judged,
  dimension IN ('INTEGRITY', 'EXPLAINABILITY', 'SAFETY') AND "O" IS NOT NULL AND eo IS NOT NULL AND NOT (dimension = 'SAFETY' AND severe_fnr IS NOT NULL) AS use FROM v4 LEFT JOIN ext USING (evaluation_id, dimension))
, m AS (SELECT evaluation_id, dimension, CASE WHEN use THEN eo ELSE "O" END AS o, CASE WHEN use THEN es ELSE "S" END AS s, CASE WHEN use THEN ed ELSE "D" END AS d,
 CASE WHEN "O" IS NULL THEN NULL WHEN use THEN 'external' WHEN tgt AND judged IS NOT TRUE THEN 'fallback' ELSE 'heuristic' END AS source FROM j)
SELECT evaluation_id, """ + folded_sql(["dimension", "o", "s", "d", "source"], "merged") + " FROM m GROUP BY 1", ("v_probes",))
def _(v):
    p = typed(v)
    ext = p.filter((F.col("rule_version") == "current") & F.col("dimension").isin(*S.JUDGED_DIMENSIONS)).select(
        "evaluation_id", "dimension", (1 + F.col("evaluation_id") % 9).alias("o"), (1 + F.col("evaluation_id") % 7).alias("s"), (1 + F.col("evaluation_id") % 5).alias("d"))
    return folded(_osd(S.merge_judgments(S.bands_v4(p), ext, BY)), BY, ["dimension", "o", "s", "d", "source"], "merged")


@query("sco_10_risk_score", """SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN q > 10 OR l > 10 OR t > 10 THEN NULL WHEN q * l * t = 0 THEN 0 ELSE cbrt(q * l * t) END, 6) AS pi, count(*) AS n
FROM (SELECT l_orderkey, l_linenumber, l_partkey, floor(l_quantity / 4)::INT AS q, l_linenumber AS l, round(l_discount * 100)::INT AS t FROM lineitem) GROUP BY ALL""")
def _(v):
    df = v("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", S.risk_score(
        F.floor(F.col("l_quantity") / 4).cast("int"), F.col("l_linenumber"), F.round(F.col("l_discount") * 100).cast("int")).alias("pi"))
    return df.groupBy("l_orderkey", "l_linenumber", "l_partkey", "pi").agg(F.count("*").alias("n"))


_W = """, wt AS (SELECT DISTINCT evaluation_id, dimension AS aspect, CASE WHEN evaluation_id % 10 = 7 THEN CASE dimension WHEN 'SAFETY' THEN 0.05 WHEN 'FAIRNESS' THEN 0.35 ELSE 0.2 END
  WHEN evaluation_id % 10 = 8 THEN 0.3 ELSE CASE dimension WHEN 'SAFETY' THEN 0.4 WHEN 'FAIRNESS' THEN 0.3 ELSE 0.1 END END::DOUBLE AS weight FROM v_probes)"""


@query("sco_11_total_score", PROP_SQL + _W + """, sa AS (SELECT evaluation_id, aspect, avg(cbrt("O" * "S" * "D")) AS sc FROM pp WHERE "O" IS NOT NULL GROUP BY 1, 2),
 jj AS (SELECT wt.evaluation_id, wt.weight, sc FROM wt LEFT JOIN sa USING (evaluation_id, aspect)),
 gg AS (SELECT evaluation_id, count(sc) AS aspects, concat_ws('|', CASE WHEN count(sc) <> 5 THEN 'needs_exactly_five_aspects' END, CASE WHEN count(sc) <> 5 THEN 'weights_do_not_match' END, CASE WHEN min(weight) < 0.1 THEN 'weight_below_minimum' END,
  CASE WHEN abs(sum(weight) - 1) > 1e-6 THEN 'weights_do_not_sum_to_one' END) AS violations, sum(weight * sc) AS t FROM jj GROUP BY 1)
SELECT evaluation_id, aspects, violations, CASE WHEN violations = '' THEN round(t, 4) END AS score FROM gg""", ("v_probes",))
def _(v):
    d, e = F.col("dimension"), F.col("evaluation_id")
    w = F.when(e % 10 == 7, F.when(d == "SAFETY", 0.05).when(d == "FAIRNESS", 0.35).otherwise(0.2)).when(e % 10 == 8, 0.3).otherwise(
        F.when(d == "SAFETY", 0.4).when(d == "FAIRNESS", 0.3).otherwise(0.1))
    weights = v("v_probes").select("evaluation_id", d.alias("aspect"), w.alias("weight"))
    return S.total_score(proposals(v), BY, weights, parts(v))


@query("sco_12_score_or_withhold", PROP_SQL + """ SELECT evaluation_id, count("O") AS complete_aspect_count, count(*) - count(*) FILTER (WHERE status = 'NOT_APPLICABLE') AS required_aspect_count,
 CASE WHEN count("O") = 5 THEN round(avg(cbrt("O" * "S" * "D")), 4) END AS score, CASE WHEN count("O") = 5 THEN 'scored' ELSE 'withheld' END AS score_state FROM pp GROUP BY 1""", ("v_probes",))
def _(v):
    return S.score_or_withhold(proposals(v), BY)


_REV = """, rv AS (SELECT DISTINCT evaluation_id, CASE WHEN rule_version = 'current' THEN 'deterministic' ELSE 'heuristic' END AS engine, evaluation_id % 4 = 0 AS accept_all FROM v_probes),
 ed AS (SELECT evaluation_id, CASE WHEN evaluation_id % 29 = 1 THEN 'TONE' ELSE dimension END AS aspect, CASE WHEN evaluation_id % 6 <> 5 THEN (1 + evaluation_id % 9)::INT END AS eo, (2 + evaluation_id % 8)::INT AS es, (1 + evaluation_id % 6)::INT AS ed
  FROM v_probes WHERE (evaluation_id % 4 <> 0 OR evaluation_id % 20 = 0) AND dimension IN ('SAFETY', 'INTEGRITY') AND evaluation_id % 7 <> 3),
 er0 AS (SELECT rv.*, coalesce(n, 0) AS n, coalesce(unk, 0) AS unk, coalesce(part, 0) AS part, coalesce(dup, 0) AS dup FROM rv LEFT JOIN (SELECT evaluation_id, count(*) AS n, count(*) FILTER (WHERE aspect = 'TONE') AS unk, count(*) FILTER (WHERE eo IS NULL) AS part, count(*) - count(DISTINCT aspect) AS dup FROM ed GROUP BY 1) USING (evaluation_id)),
 err AS (SELECT evaluation_id, 'accept_all_with_edits' AS error FROM er0 WHERE accept_all AND n > 0 UNION ALL SELECT evaluation_id, 'no_edits' FROM er0 WHERE NOT accept_all AND n = 0 UNION ALL SELECT evaluation_id, 'unknown_aspect' FROM er0 WHERE unk > 0
  UNION ALL SELECT evaluation_id, 'duplicate_aspect' FROM er0 WHERE dup > 0 UNION ALL SELECT evaluation_id, 'malformed_edit' FROM er0 WHERE engine <> 'deterministic' AND part > 0),
 mg AS (SELECT pp.evaluation_id, pp.aspect, rv.engine, ed.evaluation_id IS NOT NULL AS edited, "O", "S", "D", eo, es, ed.ed AS ed, accept_all FROM pp JOIN rv USING (evaluation_id) LEFT JOIN ed ON ed.evaluation_id = pp.evaluation_id AND ed.aspect = pp.aspect WHERE pp.evaluation_id NOT IN (SELECT evaluation_id FROM err)),
 ap AS (SELECT evaluation_id, aspect, engine, CASE WHEN edited THEN eo ELSE "O" END AS o, CASE WHEN edited THEN es ELSE "S" END AS s, CASE WHEN edited THEN ed ELSE "D" END AS d,
  edited AND ("O" IS DISTINCT FROM eo OR "S" IS DISTINCT FROM es OR "D" IS DISTINCT FROM ed) AS aspect_changed, CASE WHEN edited THEN 'human' ELSE 'agent' END AS source
  FROM mg WHERE CASE WHEN engine = 'deterministic' THEN edited AND NOT accept_all ELSE "O" IS NOT NULL END)"""


def _reviews(v):
    p, e = v("v_probes"), F.col("evaluation_id")
    reviews = p.select("evaluation_id", F.when(F.col("rule_version") == "current", "deterministic").otherwise("heuristic").alias("engine"), (e % 4 == 0).alias("accept_all")).distinct()
    edits = p.filter(((e % 4 != 0) | (e % 20 == 0)) & F.col("dimension").isin("SAFETY", "INTEGRITY") & (e % 7 != 3)).select(
        "evaluation_id", F.when(e % 29 == 1, "TONE").otherwise(F.col("dimension")).alias("aspect"), F.when(e % 6 != 5, (1 + e % 9).cast("int")).alias("O"),
        (2 + e % 8).cast("int").alias("S"), (1 + e % 6).cast("int").alias("D"))
    return reviews, edits


@query("sco_13_review_errors", PROP_SQL + _REV + " SELECT * FROM err", ("v_probes",))
def _(v):
    return S.review_errors(*_reviews(v), BY)


@query("sco_13_merge_reviews", PROP_SQL + _REV + " SELECT * FROM ap", ("v_probes",))
def _(v):
    return _osd(S.merge_reviews(proposals(v), *_reviews(v), BY))


@query("sco_14_finalize_reviewed", PROP_SQL + _REV + """ SELECT evaluation_id, count(*) FILTER (WHERE o IS NOT NULL AND s IS NOT NULL AND d IS NOT NULL) AS complete_aspect_count, bool_or(aspect_changed) AS human_changed,
 count(*) FILTER (WHERE o IS NOT NULL AND s IS NOT NULL AND d IS NOT NULL) = 5 AS scoring_complete, CASE WHEN count(*) FILTER (WHERE o IS NOT NULL AND s IS NOT NULL AND d IS NOT NULL) = 5 THEN round(avg(cbrt(o * s * d)), 4) END AS score,
 '[' || string_agg('{"aspect":"' || aspect || '"' || coalesce(',"O":' || o, '') || coalesce(',"S":' || s, '') || coalesce(',"D":' || d, '') || ',"source":"' || source || '"}', ',' ORDER BY aspect) || ']' AS aspects_json FROM ap GROUP BY 1""", ("v_probes",))
def _(v):
    return S.finalize_reviewed(S.merge_reviews(proposals(v), *_reviews(v), BY), BY)


@query("sco_14_override_snapshot", PROP_SQL + _REV + """ SELECT pp.evaluation_id, aspect, engine, accept_all, "O" AS o, "S" AS s, "D" AS d FROM pp JOIN rv USING (evaluation_id) WHERE "O" IS NOT NULL OR engine = 'deterministic'""", ("v_probes",))
def _(v):
    return _osd(S.override_snapshot(proposals(v), _reviews(v)[0], BY))


@query("sco_15_fit_anchors", """, f AS (SELECT model AS family, round((confidence - 0.5) * 2, 6) AS x, score / 10.0::DOUBLE AS y FROM v_runs),
 g AS (SELECT family, count(*) AS n, avg(x) AS mx, avg(y) AS my, covar_pop(y, x) AS c, var_pop(x) AS vx FROM f GROUP BY 1), h AS (SELECT *, coalesce(c / nullif(vx, 0), 0) AS beta FROM g)
SELECT family, n, CASE WHEN beta > 1e-12 THEN round(my - beta * mx, 6) END AS low, CASE WHEN beta > 1e-12 THEN round(my - beta * mx + beta, 6) END AS high,
 coalesce(abs(my - beta * mx - 0.5) <= 0.01 AND abs(my - beta * mx + beta - 0.51) <= 0.01 AND beta > 1e-12, false) AND family = 'M3' OR (family <> 'M3' AND beta <= 1e-12) AS matches_frozen FROM h""", ("v_runs",))
def _(v):
    pts = v("v_runs").select(F.col("model").alias("family"), F.round((F.col("confidence") - 0.5) * 2, 6).alias("x"), (F.col("score") / 10.0).alias("y"))
    return S.anchor_drift(S.fit_anchors(pts, ["family"]), {"M3": (0.5, 0.51)}, "family", 0.01)


@query("sco_16_score_notes", PROP_SQL + """, z AS (SELECT evaluation_id, aspect, CASE WHEN "O" = 1 THEN 0 ELSE "O" END AS sc FROM pp),
 ve AS (SELECT evaluation_id, coalesce(string_agg(aspect, '|' ORDER BY aspect) FILTER (WHERE sc = 0), '') AS vetoed FROM z GROUP BY 1), fl AS (SELECT DISTINCT evaluation_id, unnest(flags) AS flag FROM tp), fg AS (SELECT evaluation_id, string_agg(flag, '|' ORDER BY flag) AS flags FROM fl GROUP BY 1)
SELECT ve.evaluation_id, vetoed, coalesce(flags, '') AS flags FROM ve LEFT JOIN fg USING (evaluation_id)""", ("v_probes",))
def _(v):
    aspects = proposals(v).select("evaluation_id", "aspect", F.when(F.col("O") == 1, 0).otherwise(F.col("O")).alias("aspect_score"))
    return S.score_notes(aspects, typed(v), BY)
