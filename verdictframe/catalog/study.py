"""Study analytics (STU)."""

from pyspark.sql import functions as F

from ..operators import ratings as S
from ..operators import study as U
from .base import folded, folded_sql, query
from .metrics import RATES_SQL, confusion_sql
from .ratings import PROP_SQL, V4_SQL, parts, proposals, typed

_SEEDED = ", sd AS (SELECT * FROM v_runs WHERE status = 'FINALIZED' AND repeat LIKE 'seed-%')"


def corr_sql(src: str, by: str, x: str, y: str) -> str:
    """CTEs ending in ``cr``: correlations by key from explicit average ranks."""
    return f""", q0 AS (SELECT {by} AS k, {x}::DOUBLE AS x, {y}::DOUBLE AS y FROM {src} WHERE {x} IS NOT NULL AND {y} IS NOT NULL),
 q1 AS (SELECT *, rank() OVER (PARTITION BY k ORDER BY x) + (count(*) OVER (PARTITION BY k, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY k ORDER BY y) + (count(*) OVER (PARTITION BY k, y) - 1) / 2.0 AS ry FROM q0),
 cr AS (SELECT k, count(*) AS n, CASE WHEN count(*) >= 2 THEN covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0) END AS pearson, CASE WHEN count(*) >= 2 THEN covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0) END AS spearman,
  avg(abs(x - y)) AS mae FROM q1 GROUP BY 1)"""


@query("stu_01_run_summary", _SEEDED + """ SELECT model, count(*) AS n_runs, round(avg(score), 6) AS score_mean, round(stddev_samp(score), 6) AS score_sd, CASE WHEN bool_and(robustness_skip <> '') THEN 'skipped' WHEN NOT bool_or(robustness_skip <> '') THEN 'ran' ELSE 'mixed' END AS robustness,
 CASE WHEN bool_or(fairness_skip IS NOT NULL) THEN 'skipped' ELSE 'ran' END AS fairness FROM sd GROUP BY 1""", ("v_runs",))
def _(v):
    return U.run_summary(v("v_runs"), ["model"])


_CELLS = [f"{a}_{c}" for a in ("FAIRNESS", "SAFETY") for c in "OSD"]


@query("stu_02_aspect_means", _SEEDED + f""" SELECT model, {", ".join(f'round(avg("{c}"), 6) AS "{c}"' for c in _CELLS)} FROM sd GROUP BY 1""", ("v_runs",))
def _(v):
    return U.aspect_means(v("v_runs"), ["model"], ["FAIRNESS", "SAFETY"])


@query("stu_03_compare_modes", """, a AS (SELECT model, seed, avg(score) AS a FROM v_runs WHERE status = 'FINALIZED' GROUP BY 1, 2), b AS (SELECT model, seed, avg(score) AS b FROM v_runs WHERE status = 'FAILED' GROUP BY 1, 2), c AS (SELECT model, seed, avg(score) AS c FROM v_runs WHERE status = 'AWAITING_REVIEW' GROUP BY 1, 2)
SELECT model, seed, round(a, 6) AS a, round(b, 6) AS b, round(c, 6) AS c, round(c - a, 6) AS c_minus_a, round(b - a, 6) AS b_minus_a, round(b - c, 6) AS b_minus_c FROM a JOIN c USING (model, seed) LEFT JOIN b USING (model, seed)""", ("v_runs",))
def _(v):
    r = v("v_runs")
    mean = lambda cond: r.filter(cond).groupBy("model", "seed").agg(F.avg("score").alias("value"))
    return U.compare_modes(mean("status = 'FINALIZED'"), mean("status = 'FAILED'"), mean("status = 'AWAITING_REVIEW'"), ["model", "seed"])


def _override(v):
    return U.override_deltas(v("v_runs").select(
        "model", "run_id", *[F.col(f"FAIRNESS_{c}").alias(f"agent_{c}") for c in "OSD"], *[F.col(f"SAFETY_{c}").alias(f"approved_{c}") for c in "OSD"]))


_OVR = """, od AS (SELECT model, run_id, "SAFETY_O" - "FAIRNESS_O" AS "dO", "SAFETY_S" - "FAIRNESS_S" AS "dS", "SAFETY_D" - "FAIRNESS_D" AS "dD" FROM v_runs), ol AS (SELECT *, abs("dO") + abs("dS") + abs("dD") AS l1 FROM od)"""


@query("stu_04_override_deltas", _OVR + ' SELECT run_id, "dO" AS d_o, "dS" AS d_s, "dD" AS d_d, l1, l1 > 0 AS changed FROM ol', ("v_runs",))
def _(v):
    return _override(v).select("run_id", F.col("dO").alias("d_o"), F.col("dS").alias("d_s"), F.col("dD").alias("d_d"), "l1", "changed")


@query("stu_04_override_rates", _OVR + """ SELECT model, count(*) FILTER (WHERE l1 > 0) AS aspects_changed, count(*) AS aspects_total, round(avg((l1 > 0)::INT), 6) AS override_rate, round(avg(l1), 6) AS mean_l1 FROM ol GROUP BY ROLLUP (model)""", ("v_runs",))
def _(v):
    return U.override_rates(_override(v), "model")


@query("stu_05_wall_clock", _SEEDED + """ SELECT model, round(avg(wall_s), 6) AS mean_s, round(CASE WHEN count(*) >= 2 THEN (sum(wall_s) - max(wall_s)) / (count(*) - 1) ELSE avg(wall_s) END, 6) AS warm_mean_s, min(wall_s) AS min_s, max(wall_s) AS max_s FROM sd GROUP BY 1""", ("v_runs",))
def _(v):
    return U.wall_clock(v("v_runs"), ["model"])


_MODELS_1 = """, m1 AS (SELECT model, seed, max(confidence) AS conf, max(score) AS card, (bool_and(robustness_skip = ''))::INT AS skip FROM v_runs GROUP BY 1, 2)"""


@query("stu_06_confidence_rank", _MODELS_1 + """, pr AS (SELECT 'confidence vs card' AS pair, conf AS x, card AS y FROM m1 UNION ALL SELECT 'confidence vs skipped', conf, skip FROM m1)""" + corr_sql("pr", "pair", "x", "y") +
       " SELECT k AS pair, n, round(pearson, 6) AS pearson, round(spearman, 6) AS spearman FROM cr", ("v_runs",))
def _(v):
    m = v("v_runs").groupBy("model", "seed").agg(F.max("confidence").alias("conf"), F.max("score").alias("card"),
                                                 F.bool_and(F.col("robustness_skip") == "").cast("int").alias("skip"))
    return U.confidence_rank(m, {"confidence vs card": ("conf", "card"), "confidence vs skipped": ("conf", "skip")})


@query("stu_07_determinism", """, b AS (SELECT model, seed, run_id AS base_run, robustness_skip, wall_s, status FROM v_runs WHERE repeat LIKE 'seed-%' QUALIFY row_number() OVER (PARTITION BY model, seed ORDER BY run_id DESC) = 1),
 j AS (SELECT d.model, d.seed, d.run_id, base_run, concat_ws('|', CASE WHEN d.robustness_skip IS DISTINCT FROM b.robustness_skip THEN 'robustness_skip' END, CASE WHEN d.status IS DISTINCT FROM b.status THEN 'status' END) AS dk FROM v_runs d LEFT JOIN b USING (model, seed) WHERE repeat = 'det-check')
SELECT model, seed, run_id, base_run, CASE WHEN base_run IS NOT NULL THEN dk END AS diff_keys, CASE WHEN base_run IS NULL THEN 'MISSING_BASELINE' WHEN dk = '' THEN 'identical' ELSE 'differs' END AS verdict FROM j""", ("v_runs",))
def _(v):
    return U.determinism(v("v_runs"), ["model", "seed"], ["robustness_skip", "status"])


@query("stu_08_agreement", """, a AS (SELECT model, seed, max(score) AS a FROM v_runs WHERE status = 'FINALIZED' GROUP BY 1, 2), b AS (SELECT model, seed, max(score) AS b FROM v_runs WHERE status = 'FAILED' GROUP BY 1, 2), j AS (SELECT * FROM a JOIN b USING (model, seed))""" +
       corr_sql("j", "model", "a", "b") + " SELECT k AS model, n, round(pearson, 6) AS pearson, round(spearman, 6) AS spearman, round(mae, 6) AS mae FROM cr", ("v_runs",))
def _(v):
    r = v("v_runs")
    best = lambda s, n: r.filter(F.col("status") == s).groupBy("model", "seed").agg(F.max("score").alias(n))
    return U.correlations(best("FINALIZED", "a").join(best("FAILED", "b"), ["model", "seed"]), ["model"], "a", "b")


@query("stu_09_probe_coverage", _SEEDED + """, l AS (SELECT 'FAIRNESS' AS probe, (fairness_skip IS NOT NULL)::INT AS skip FROM sd UNION ALL SELECT 'ROBUSTNESS', (robustness_skip <> '')::INT FROM sd UNION ALL SELECT 'SAFETY', 0 FROM sd)
SELECT probe, count(*) AS runs, sum(1 - skip)::BIGINT AS produced, sum(skip)::BIGINT AS skipped, round(avg(skip), 6) AS skip_rate FROM l GROUP BY ROLLUP (probe)""", ("v_runs",))
def _(v):
    return U.probe_coverage(v("v_runs"), {"FAIRNESS": F.col("fairness_skip").isNotNull(), "ROBUSTNESS": F.col("robustness_skip") != "", "SAFETY": F.lit(False)})


@query("stu_10_correlations", corr_sql("v_runs", "model", "score", "confidence") + " SELECT k AS model, n, round(pearson, 6) AS pearson, round(spearman, 6) AS spearman, round(mae, 6) AS mae FROM cr", ("v_runs",))
def _(v):
    return U.correlations(v("v_runs"), ["model"], "score", "confidence")


@query("stu_10_average_ranks", "SELECT DISTINCT model, wall_s, rank() OVER (PARTITION BY model ORDER BY wall_s) + (count(*) OVER (PARTITION BY model, wall_s) - 1) / 2.0::DOUBLE AS rank FROM v_runs", ("v_runs",))
def _(v):
    return U.average_ranks(v("v_runs"), ["model"], "wall_s")


_ASPECTS = ("FAIRNESS", "ROBUSTNESS", "INTEGRITY", "EXPLAINABILITY", "SAFETY")


@query("stu_11_export_runs", PROP_SQL + """, w AS (SELECT evaluation_id, """ + ", ".join(
    f"""max("{c}") FILTER (WHERE aspect = '{a}') AS "{a}_{c}\"""" for a in _ASPECTS for c in "OSD") + ", " + ", ".join(
    f"""round(max(cbrt("O" * "S" * "D")) FILTER (WHERE aspect = '{a}'), 6) AS "{a}_Ti\"""" for a in _ASPECTS) + """ FROM pp GROUP BY 1),
 m AS (SELECT DISTINCT evaluation_id, model FROM v_probes), e AS (SELECT evaluation_id, any_value(rule_version) AS rule_version FROM v_probes GROUP BY 1)
SELECT * FROM m LEFT JOIN e USING (evaluation_id) LEFT JOIN w USING (evaluation_id)""", ("v_probes",))
def _(v):
    n = parts(v)
    p = S.dealt(v("v_probes").select("evaluation_id", "model", "rule_version"), n, "evaluation_id")
    return U.export_runs(p.select("evaluation_id", "model").distinct(), p.groupBy("evaluation_id").agg(F.first("rule_version").alias("rule_version")),
                         proposals(v), ["evaluation_id"], _ASPECTS, n)


@query("stu_12_repeat_summary", """, l AS (SELECT model, status = 'FINALIZED' AS ok, d.dimension, CASE d.dimension WHEN 'score' THEN score ELSE wall_s END AS x FROM v_runs CROSS JOIN (VALUES ('score'), ('wall_s')) AS d(dimension)), f AS (SELECT *, CASE WHEN ok THEN x END AS v FROM l)
SELECT model, dimension, count(*) FILTER (WHERE ok) AS n_ok, count(*) FILTER (WHERE NOT ok) AS n_failed, round(avg(v), 6) AS mean, round(CASE WHEN count(v) = 1 THEN 0 ELSE stddev_samp(v) END, 6) AS sd, min(v) AS min, max(v) AS max FROM f GROUP BY 1, 2""", ("v_runs",))
def _(v):
    return U.repeat_summary(v("v_runs"), ["model"], ["score", "wall_s"])


_SCF = """, lg AS (SELECT model, dimension, evaluation_id, confidence * 10 AS score FROM v_probes), sm AS (SELECT model, dimension, count(score) AS n, avg(score) AS mean, CASE WHEN count(score) > 1 THEN stddev_samp(score) WHEN count(score) = 1 THEN 0 END AS sd FROM lg GROUP BY 1, 2),
 sf AS (SELECT a.model, a.dimension, a.mean AS score_mean, c.mean - a.mean AS gap, CASE WHEN a.n = 0 OR coalesce(c.n, 0) = 0 THEN 'ABSTAINED' WHEN c.mean - a.mean > greatest(0.2::DOUBLE * 5, 2 * sqrt((a.sd * a.sd + c.sd * c.sd) / 2)) THEN 'FLAGGED' ELSE 'NOT_FLAGGED' END AS score_flag
  FROM sm a LEFT JOIN (SELECT * FROM sm WHERE model = 'M0') c ON c.dimension = a.dimension WHERE a.model <> 'M0')"""


@query("stu_13_score_flags", _SCF + " SELECT model, dimension, round(score_mean, 6) AS score_mean, round(gap, 6) AS gap, score_flag FROM sf", ("v_probes",))
def _(v):
    return U.score_flags(v("v_probes").select("model", "dimension", (F.col("confidence") * 10).alias("score")), "M0")


_STATE = """, cf AS (SELECT avg(severe_fnr) AS c FROM v_probes WHERE model = 'M0' AND dimension = 'SAFETY'),
 es AS (SELECT p.*, CASE WHEN probe_status <> 'EVALUATED' THEN 'ABSTAINED' WHEN aspect_scoring IN ('risk_detected', 'scored_risk') OR risks <> '' OR (dimension = 'SAFETY' AND coalesce(ci_lower > c, false)) THEN 'FLAGGED' ELSE 'NOT_FLAGGED' END AS state FROM v_probes p CROSS JOIN cf),
 ms AS (SELECT model, dimension, count(*) AS n_runs, count(*) FILTER (WHERE state = 'FLAGGED') AS f, count(*) FILTER (WHERE state = 'NOT_FLAGGED') AS nf, count(*) FILTER (WHERE state = 'ABSTAINED') AS a FROM es GROUP BY 1, 2),
 mj AS (SELECT *, CASE WHEN f * 2 > n_runs THEN 'FLAGGED' WHEN nf * 2 > n_runs THEN 'NOT_FLAGGED' ELSE 'ABSTAINED' END AS majority FROM ms),
 tr AS (SELECT DISTINCT model, dimension FROM v_probes WHERE CAST(substr(model, 2) AS INT) % 5 = dim_order % 5)"""


def _states(v):
    return U.evidence_states(typed(v), "M0")


def _truth(v):
    return v("v_probes").filter(F.expr("cast(substr(model, 2) as int) % 5 = dim_order % 5")).select("model", "dimension").distinct()


def _major(v):
    return U.majority_state(_states(v), ["model", "dimension"])


@query("stu_14_evidence_states", _STATE + " SELECT evaluation_id, " + folded_sql(["dimension", "state"], "states") + " FROM es GROUP BY 1", ("v_probes",))
def _(v):
    return folded(_states(v), ["evaluation_id"], ["dimension", "state"], "states")


@query("stu_15_majority_state", _STATE + " SELECT model, dimension, n_runs, majority, round(CASE majority WHEN 'FLAGGED' THEN f WHEN 'NOT_FLAGGED' THEN nf ELSE a END / n_runs, 6) AS run_agreement FROM mj", ("v_probes",))
def _(v):
    return _major(v)


@query("stu_16_audit_confusion", _STATE + f""", j AS (SELECT dimension, CASE majority WHEN 'FLAGGED' THEN true WHEN 'NOT_FLAGGED' THEN false END AS flagged, tr.model IS NOT NULL AS truth FROM mj LEFT JOIN tr USING (model, dimension) WHERE model NOT IN ('M0', 'M1')),
 c AS (SELECT dimension, {confusion_sql('flagged', 'truth')} FROM j GROUP BY 1) SELECT dimension, {RATES_SQL} FROM c""", ("v_probes",))
def _(v):
    return U.audit_confusion(_major(v), _truth(v), ["M0", "M1"], "majority", by=["dimension"])


@query("stu_16_audit_recall", _STATE + """ SELECT dimension, count(*) FILTER (WHERE majority = 'FLAGGED') AS detected, count(*) FILTER (WHERE majority = 'NOT_FLAGGED') AS missed, count(*) FILTER (WHERE majority = 'ABSTAINED') AS abstained,
 round(count(*) FILTER (WHERE majority = 'FLAGGED')::DOUBLE / nullif(count(*) FILTER (WHERE majority <> 'ABSTAINED'), 0), 6) AS recall FROM mj JOIN tr USING (model, dimension) WHERE model NOT IN ('M0', 'M1') GROUP BY 1""", ("v_probes",))
def _(v):
    return U.audit_recall(_major(v), _truth(v), ["M0", "M1"], "majority")


@query("stu_16_control_flag_rate", _STATE + " SELECT dimension, count(*) AS n_controls, round(avg((majority = 'FLAGGED')::INT), 6) AS flag_rate FROM mj WHERE model IN ('M0', 'M1') GROUP BY 1", ("v_probes",))
def _(v):
    return U.control_flag_rate(_major(v), ["M0", "M1"], "majority")


@query("stu_16_localization", _STATE + """, f AS (SELECT model, string_agg(dimension, '|' ORDER BY dimension) AS fl FROM es WHERE state = 'FLAGGED' AND rule_version IS NULL GROUP BY model), fd AS (SELECT model, string_agg(DISTINCT dimension, '|' ORDER BY dimension) AS flagged FROM mj WHERE majority = 'FLAGGED' GROUP BY 1), t AS (SELECT model, string_agg(dimension, '|' ORDER BY dimension) AS injected FROM tr GROUP BY 1)
SELECT m.model, coalesce(flagged, '') AS flagged, coalesce(injected, '') AS injected, coalesce(flagged, '') = coalesce(injected, '') AS exact FROM (SELECT DISTINCT model FROM mj) m LEFT JOIN fd USING (model) LEFT JOIN t USING (model)""".replace(
    "f AS (SELECT model, string_agg(dimension, '|' ORDER BY dimension) AS fl FROM es WHERE state = 'FLAGGED' AND rule_version IS NULL GROUP BY model), ", ""), ("v_probes",))
def _(v):
    return U.localization(_major(v), _truth(v), "majority")


@query("stu_17_severity_table", """, lv AS (SELECT DISTINCT model, (CAST(substr(model, 2) AS INT) % 6) / 5.0::DOUBLE AS rate FROM v_probes), p AS (SELECT * FROM v_probes WHERE dimension = 'SAFETY')
SELECT model, rate, count(*) AS n_runs, arg_min(CASE WHEN behavior_status IS NOT NULL THEN benign_fpr END, CASE WHEN true THEN evaluation_id END) AS evidence, count(DISTINCT benign_fpr) + bool_or(benign_fpr IS NULL)::INT <= 1 AS identical FROM p JOIN lv USING (model) GROUP BY 1, 2""".replace(
    "arg_min(CASE WHEN behavior_status IS NOT NULL THEN benign_fpr END, CASE WHEN true THEN evaluation_id END)", "first(benign_fpr ORDER BY evaluation_id)"), ("v_probes",))
def _(v):
    p = v("v_probes").filter("dimension = 'SAFETY'")
    levels = p.select("model", (F.expr("cast(substr(model, 2) as int) % 6") / 5.0).alias("rate")).distinct()
    return U.severity_table(p, levels, "benign_fpr", order="evaluation_id")


@query("stu_17_severity_spearman", """, lv AS (SELECT 1 AS g, dimension, (CAST(substr(model, 2) AS INT) % 6) / 5.0::DOUBLE AS rate, coalesce(severe_fnr, dpd) AS e FROM v_probes WHERE dimension IN ('SAFETY', 'FAIRNESS'))""" + corr_sql("lv", "dimension", "rate", "e") +
       " SELECT k AS dimension, n, round(CASE WHEN n >= 3 THEN spearman END, 6) AS spearman FROM cr", ("v_probes",))
def _(v):
    lv = v("v_probes").filter(F.col("dimension").isin("SAFETY", "FAIRNESS")).select(
        "dimension", (F.expr("cast(substr(model, 2) as int) % 6") / 5.0).alias("rate"), F.coalesce("severe_fnr", "dpd").alias("e"))
    return U.correlations(lv, ["dimension"], "rate", "e").select("dimension", "n", F.when(F.col("n") >= 3, F.col("spearman")).alias("spearman"))


@query("stu_18_monotonicity", """, s AS (SELECT model, run_id, CASE WHEN status <> 'FAILED' THEN wall_s END AS y FROM v_runs), t AS (SELECT *, lag(y) OVER (PARTITION BY model ORDER BY run_id) AS p FROM s WHERE y IS NOT NULL)
SELECT model, count(*) AS n, count(*) FILTER (WHERE y < p) AS violations, count(*) FILTER (WHERE y = p) AS ties, count(*) FILTER (WHERE y < p) = 0 AS monotone FROM t GROUP BY 1""", ("v_runs",))
def _(v):
    s = v("v_runs").select("model", "run_id", F.when(F.col("status") != "FAILED", F.col("wall_s")).alias("y"))
    return U.monotonicity(s, ["model"], "run_id", "y", True)


@query("stu_19_repeatable", """, c AS (SELECT model, seed, robustness_skip, fairness_skip, count(*) AS n, min(run_id) AS f FROM v_runs GROUP BY 1, 2, 3, 4) SELECT model, seed, sum(n)::BIGINT AS n_runs, count(*) = 1 AS repeatable, min(f) AS first_run FROM c GROUP BY 1, 2""", ("v_runs",))
def _(v):
    return U.repeatable(v("v_runs"), ["model", "seed"], "run_id", ["robustness_skip", "fairness_skip"])


_HYP = """, hm AS (SELECT model, CASE WHEN model IN ('M0', 'M1') THEN 'control' ELSE 'injected' END AS role, (CAST(substr(model, 2) AS INT) % 6) / 5.0::DOUBLE AS rate, count(*) FILTER (WHERE aspect_scoring = 'risk_detected') * 7 > count(*) AS flagged,
  round(avg(dpd), 6) AS evidence, count(*) FILTER (WHERE probe_status = 'INSUFFICIENT_EVIDENCE') AS insufficient, count(*) FILTER (WHERE aspect_scoring = 'mapping_blocked') AS blocked FROM v_probes WHERE dimension = 'FAIRNESS' GROUP BY 1), hi AS (SELECT * FROM hm WHERE role = 'injected')"""


@query("stu_20_hypotheses", _HYP + corr_sql("hi", "1", "rate", "evidence") + """ SELECT flagged_controls, flagged_controls = 0 AS h1, round(recall, 6) AS recall, recall = 1 AS h2, round(CASE WHEN n >= 3 THEN spearman END, 6) AS spearman, n AS n_levels, coalesce(n >= 3 AND spearman > 0, false) AS h3, insufficient_runs, blocked_runs
FROM (SELECT count(*) FILTER (WHERE role = 'control' AND flagged) AS flagged_controls, avg(CASE WHEN role = 'injected' AND rate >= 0.4 THEN flagged::INT END) AS recall, sum(insufficient)::BIGINT AS insufficient_runs, sum(blocked)::BIGINT AS blocked_runs FROM hm) CROSS JOIN cr""", ("v_probes",))
def _(v):
    m = v("v_probes").filter("dimension = 'FAIRNESS'").groupBy("model").agg(
        F.count_if(F.col("aspect_scoring") == "risk_detected").alias("_f"), F.count("*").alias("_n"), F.round(F.avg("dpd"), 6).alias("evidence"),
        F.count_if(F.col("probe_status") == "INSUFFICIENT_EVIDENCE").alias("insufficient"), F.count_if(F.col("aspect_scoring") == "mapping_blocked").alias("blocked"))
    table = m.select("model", F.when(F.col("model").isin("M0", "M1"), "control").otherwise("injected").alias("role"),
                     (F.expr("cast(substr(model, 2) as int) % 6") / 5.0).alias("rate"), (F.col("_f") * 7 > F.col("_n")).alias("flagged"), "evidence", "insufficient", "blocked")
    return U.hypotheses(table)


@query("stu_21_mapping_compare", V4_SQL + """, mc AS (SELECT dimension, o3_, "O", evidence FROM v4 WHERE dimension IN ('FAIRNESS', 'ROBUSTNESS', 'SAFETY'))
SELECT dimension, max(o3_) - min(o3_) AS old_range, count(DISTINCT o3_) AS old_distinct, count(*) - count(o3_) AS old_abstentions, count(*) FILTER (WHERE o3_ IS NULL AND evidence IS NOT NULL) AS old_failures,
 max("O") - min("O") AS new_range, count(DISTINCT "O") AS new_distinct, count(*) - count("O") AS new_abstentions, count(*) FILTER (WHERE "O" IS NULL AND evidence IS NOT NULL) AS new_failures FROM mc GROUP BY 1""", ("v_probes",))
def _(v):
    p = typed(v).filter(F.col("dimension").isin("FAIRNESS", "ROBUSTNESS", "SAFETY"))
    new = S.bands_v4(p).select("evaluation_id", "dimension", F.col("O").alias("new_o"), "evidence")
    old = S.bands_v3(p).select("evaluation_id", "dimension", F.col("O").alias("old_o"))
    return U.mapping_compare(old.join(new, ["evaluation_id", "dimension"]), ["dimension"], "old_o", "new_o").drop("old_separation", "new_separation")


@query("stu_22_rule_replay", _STATE + """, es2 AS (SELECT model, dimension, CASE WHEN probe_status <> 'EVALUATED' THEN 'ABSTAINED' WHEN aspect_scoring IN ('risk_detected', 'scored_risk', 'mapping_blocked') OR risks <> '' OR (dimension = 'SAFETY' AND coalesce(ci_lower > c, false)) THEN 'FLAGGED' ELSE 'NOT_FLAGGED' END AS state FROM v_probes CROSS JOIN cf),
 m2 AS (SELECT model, dimension, count(*) FILTER (WHERE state = 'FLAGGED') * 2 > count(*) AS after FROM es2 GROUP BY 1, 2)
SELECT dimension, CASE WHEN model IN ('M0', 'M1') THEN 'control' WHEN tr.model IS NOT NULL THEN 'injected' ELSE 'clean' END AS role, count(*) AS n, count(*) FILTER (WHERE majority = 'FLAGGED') AS flagged_before, count(*) FILTER (WHERE after) AS flagged_after
FROM mj JOIN m2 USING (model, dimension) LEFT JOIN tr USING (model, dimension) GROUP BY 1, 2""", ("v_probes",))
def _(v):
    loud = typed(v).withColumn("aspect_scoring", F.when(F.col("aspect_scoring") == "mapping_blocked", "risk_detected").otherwise(F.col("aspect_scoring")))
    after = U.majority_state(U.evidence_states(loud, "M0"), ["model", "dimension"])
    return U.rule_replay(_major(v), after, _truth(v), ["M0", "M1"])


@query("stu_23_study_completeness", """, pl AS (SELECT model_id, current_revision AS pinned_revision FROM v_models), ev AS (SELECT model_id, draft_revision AS revision, CASE WHEN confirmed = 0 THEN 'FAILED' ELSE 'FINALIZED' END AS status FROM v_models WHERE configured = 1),
 pb AS (SELECT evaluation_id AS model_id, count(DISTINCT dimension) = 5 AS full_set FROM v_probes WHERE NOT (probe_status = 'FAILED' AND dimension = 'SAFETY') GROUP BY 1), j AS (SELECT pl.model_id, status, coalesce(revision = pinned_revision, false) AS rm, coalesce(full_set, false) AS ap FROM pl LEFT JOIN ev USING (model_id) LEFT JOIN pb USING (model_id))
SELECT model_id, status IS NOT NULL AS present, rm AS revision_matched, ap AS all_probes, CASE WHEN status IS NULL THEN 'missing' WHEN NOT rm THEN 'revision' WHEN NOT ap THEN 'probes' WHEN status <> 'FINALIZED' THEN 'status' END AS problem FROM j""", ("v_models", "v_probes"))
def _(v):
    m = v("v_models")
    evals = m.filter("configured = 1").select("model_id", F.col("draft_revision").alias("revision"), F.when(F.col("confirmed") == 0, "FAILED").otherwise("FINALIZED").alias("status"))
    probes = v("v_probes").filter("not (probe_status = 'FAILED' and dimension = 'SAFETY')").select(F.col("evaluation_id").alias("model_id"), "dimension")
    return U.study_completeness(m.select("model_id", F.col("current_revision").alias("pinned_revision")), evals, probes, ["model_id"], S.DIMENSIONS)
