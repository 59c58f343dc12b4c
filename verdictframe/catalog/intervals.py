"""Confidence intervals (UNC)."""

from pyspark.sql import functions as F

from ..functions.columns import detectability, wilson
from ..operators import intervals as U
from ..operators import metrics as M
from .base import query
from .generate import hash_sql
from .metrics import BY, stats_cte, wilson_sql

_LO, _HI = wilson_sql("k", "n")


@query("unc_01_wilson", f"""WITH c AS (SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'R') AS k, count(*) FILTER (WHERE l_discount > 0.055) AS n0 FROM lineitem GROUP BY 1),
 d AS (SELECT l_suppkey, least(k, n0) AS k, n0 AS n FROM c)
SELECT l_suppkey, k, n, round({_LO}, 6) AS lo, round({_HI}, 6) AS hi FROM d""")
def _(v):
    c = v("lineitem").groupBy("l_suppkey").agg(
        F.count_if(F.col("l_returnflag") == "R").alias("k"), F.count_if(F.col("l_discount") > 0.055).alias("n"))
    c = c.withColumn("k", F.least("k", "n"))
    lo, hi = wilson("k", "n")
    return c.select("l_suppkey", "k", "n", lo.alias("lo"), hi.alias("hi"))


_ALO, _AHI = wilson_sql("correct", "n")


@query("unc_02_wilson_table", stats_cte("v_pred_text") + f""" SELECT evaluation_id, grp, round(accuracy, 6) AS point, round({_ALO}, 6) AS ci_lower, round({_AHI}, 6) AS ci_upper FROM gs""", ("v_pred_text",))
def _(v):
    return M.group_accuracy(v("v_pred_text"), BY, 1).select("evaluation_id", "grp", F.col("accuracy").alias("point"), "ci_lower", "ci_upper")


def replicate_sql(view: str, cell: str, b: int, seed: int) -> str:
    """Hashed replicates of ``cell`` counts, as continued CTEs ending in ``rc`` (evaluation_id, b, cell, n)."""
    return f""", ce AS (SELECT evaluation_id, {cell}, count(*) AS n FROM {view} GROUP BY ALL),
 cu AS (SELECT *, sum(n) OVER (PARTITION BY evaluation_id ORDER BY {cell}) AS hi, sum(n) OVER (PARTITION BY evaluation_id) AS total FROM ce),
 tot AS (SELECT DISTINCT evaluation_id, total FROM cu),
 dr AS (SELECT evaluation_id, b, {hash_sql(f"{seed}", 'b', 'k')} % total AS u FROM tot, unnest(range({b})) AS t1(b), unnest(range(total::BIGINT)) AS t2(k)),
 rc AS (SELECT dr.evaluation_id, b, {cell}, count(*) AS n FROM dr JOIN cu ON cu.evaluation_id = dr.evaluation_id AND u < hi AND u >= hi - cu.n GROUP BY ALL)"""


def group_rep_sql(src: str, keys: str, prefix: str, min_n: int) -> str:
    return f""", {prefix}0 AS (SELECT {keys}, grp, sum(n) AS n, coalesce(sum(n) FILTER (WHERE label = 1 AND y_hat = 1), 0) AS tp, coalesce(sum(n) FILTER (WHERE label <> 1 AND y_hat = 1), 0) AS fp,
  coalesce(sum(n) FILTER (WHERE label = 1 AND y_hat <> 1), 0) AS fn, coalesce(sum(n) FILTER (WHERE label <> 1 AND y_hat <> 1), 0) AS tn, coalesce(sum(n) FILTER (WHERE label = y_hat), 0) AS ok
  FROM {src} GROUP BY ALL HAVING sum(n) >= {min_n}),
 {prefix}1 AS (SELECT {keys}, CASE WHEN count(*) >= 2 THEN max(ok::DOUBLE / n) - min(ok::DOUBLE / n) END AS acc_gap,
  CASE WHEN count(*) >= 2 THEN max((tp + fp)::DOUBLE / n) - min((tp + fp)::DOUBLE / n) END AS dpd,
  CASE WHEN count(*) >= 2 THEN greatest(max(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0)) - min(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0)),
   max(coalesce(fp::DOUBLE / nullif(fp + tn, 0), 0)) - min(coalesce(fp::DOUBLE / nullif(fp + tn, 0), 0))) END AS eod,
  CASE WHEN count(*) >= 2 THEN max(coalesce((2 * tp)::DOUBLE / nullif(2 * tp + fp + fn, 0), 0)) - min(coalesce((2 * tp)::DOUBLE / nullif(2 * tp + fp + fn, 0), 0)) END AS f1_spread,
  CASE WHEN count(*) >= 2 AND min(tp + fn) > 0 THEN max(tp::DOUBLE / nullif(tp + fn, 0)) - min(tp::DOUBLE / nullif(tp + fn, 0)) END AS eopp FROM {prefix}0 GROUP BY ALL)"""


def bounds_sql(reps: str, point: str, stats: list[str]) -> str:
    """CTEs ending in ``ci`` (evaluation_id, stat, point, ci_lower, ci_upper, replicates)."""
    long = " UNION ALL ".join(f"SELECT evaluation_id, b, '{x}' AS stat, {x} AS x FROM {reps} WHERE {x} IS NOT NULL" for x in stats)
    points = " UNION ALL ".join(f"SELECT evaluation_id, '{x}' AS stat, {x} AS x FROM {point}" for x in stats)
    return f""", lr AS ({long}),
 lv AS (SELECT evaluation_id, stat, list_sort(list(x)) AS xs, count(*) AS m FROM lr GROUP BY 1, 2),
 lp AS ({points}),
 ci AS (SELECT lp.evaluation_id, lp.stat, round(lp.x, 6) AS point,
  CASE WHEN lp.x IS NOT NULL THEN round(xs[greatest(0, floor(0.025::DOUBLE * m))::INT + 1], 6) END AS ci_lower,
  CASE WHEN lp.x IS NOT NULL THEN round(xs[least(m - 1, ceil(0.975::DOUBLE * m) - 1)::INT + 1], 6) END AS ci_upper,
  coalesce(m, 0)::INT AS replicates FROM lp LEFT JOIN lv ON lv.evaluation_id = lp.evaluation_id AND lv.stat = lp.stat)"""


FAIR_STATS = ["acc_gap", "dpd", "eod", "f1_spread", "eopp"]
FAIR_CI_SQL = (replicate_sql("v_pred_text", "grp, label, y_hat", 120, 42) + group_rep_sql("rc", "evaluation_id, b", "gr", 20)
               + group_rep_sql("ce", "evaluation_id", "gp", 20) + bounds_sql("gr1", "gp1", FAIR_STATS))


@query("unc_03_bootstrap_accuracy_gap", FAIR_CI_SQL + " SELECT * FROM ci WHERE stat = 'acc_gap'", ("v_pred_text",))
def _(v):
    return U.fairness_ci(v("v_pred_text"), BY, ["acc_gap"], b=120, seed=42, min_group_n=20, sampler="hash")


_POINTS_BIG = (", ce AS (SELECT evaluation_id, grp, label, y_hat, count(*) AS n FROM v_pred_big GROUP BY ALL)"
               + group_rep_sql("ce", "evaluation_id", "gp", 20)
               + ", pt AS (" + " UNION ALL ".join(f"SELECT evaluation_id, '{x}' AS stat, {x} AS x FROM gp1" for x in FAIR_STATS) + ")")


@query("unc_03_bootstrap_big", _POINTS_BIG + """ SELECT evaluation_id, stat, round(x, 6) AS point, 1000 AS replicates, true AS in_order, true AS in_range
FROM pt WHERE x IS NOT NULL""", ("v_pred_big",))
def _(v):
    """Bounds are random draws: SQL states the points and what must hold of the bounds."""
    ci = U.fairness_ci(v("v_pred_big"), BY, FAIR_STATS, min_group_n=20).filter("point is not null")
    return ci.select("evaluation_id", "stat", "point", "replicates", (F.col("ci_lower") <= F.col("ci_upper")).alias("in_order"),
                     ((F.col("ci_lower") >= 0) & (F.col("ci_upper") <= 1)).alias("in_range"))


@query("unc_04_bootstrap_all_stats", FAIR_CI_SQL + " SELECT * FROM ci", ("v_pred_text",))
def _(v):
    return U.fairness_ci(v("v_pred_text"), BY, FAIR_STATS, b=120, seed=42, min_group_n=20, sampler="hash")


DROP_SQL = """, g AS (SELECT evaluation_id, (y_hat = label)::INT AS clean_ok, (y_robust = label)::INT AS robust_ok FROM v_pred_text)""" + \
    replicate_sql("g", "clean_ok, robust_ok", 150, 42) + """,
 dr1 AS (SELECT evaluation_id, b, sum(clean_ok * n)::DOUBLE / sum(n) - sum(robust_ok * n)::DOUBLE / sum(n) AS accuracy_drop FROM rc GROUP BY ALL),
 dp1 AS (SELECT evaluation_id, sum(clean_ok * n)::DOUBLE / sum(n) - sum(robust_ok * n)::DOUBLE / sum(n) AS accuracy_drop FROM ce GROUP BY ALL)""" + \
    bounds_sql("dr1", "dp1", ["accuracy_drop"])


@query("unc_05_accuracy_drop", DROP_SQL + " SELECT * FROM ci", ("v_pred_text",))
def _(v):
    return U.accuracy_drop_ci(v("v_pred_text"), BY, b=150, seed=42, sampler="hash")


@query("unc_05_accuracy_drop_big", """, d AS (SELECT evaluation_id, (y_hat = label)::INT - (y_robust = label)::INT AS d FROM v_pred_big),
 m AS (SELECT evaluation_id, count(*) AS n, sum(d)::BIGINT AS s, sum(d * d)::BIGINT AS q FROM d GROUP BY 1)
SELECT evaluation_id, round(s::DOUBLE / n, 6) AS point, round(sqrt((q::DOUBLE / n - (s::DOUBLE / n) * (s::DOUBLE / n)) / n), 6) AS standard_error,
 1000 AS replicates, true AS bounds_near FROM m""", ("v_pred_big",))
def _(v):
    """The bootstrap's bounds against those of the normal law: at 1,000 draws a bound varies by 0.085 standard errors,
    so four of these, and what one row weighs, are allowed."""
    rows = v("v_pred_big")
    d = (F.col("y_hat") == F.col("label")).cast("int") - (F.col("y_robust") == F.col("label")).cast("int")
    m = rows.groupBy(*BY).agg(F.count("*").alias("n"), F.sum(d).alias("s"), F.sum(d * d).alias("q"))
    mean = F.col("s") / F.col("n")
    m = m.select("evaluation_id", "n", F.sqrt((F.col("q") / F.col("n") - mean * mean) / F.col("n")).alias("standard_error"))
    slack = F.col("standard_error") * 0.34 + 2 / F.col("n")
    near = lambda bound, z: F.abs(F.col(bound) - F.col("point") - F.col("standard_error") * z) <= slack
    return U.accuracy_drop_ci(rows, BY).join(m, BY).select(
        "evaluation_id", "point", "standard_error", "replicates", (near("ci_lower", -1.96) & near("ci_upper", 1.96)).alias("bounds_near"))


@query("unc_06_bootstrap_mean", "WITH g AS (SELECT (doc_id % 4)::STRING AS evaluation_id, round(quality * 0.7 + toxic * 0.1, 3)::DOUBLE AS value FROM labels)"
       + replicate_sql("g", "value", 400, 0) + """,
 mr AS (SELECT evaluation_id, b, sum(value * n) / sum(n) AS mean FROM rc GROUP BY ALL), ml AS (SELECT evaluation_id, list_sort(list(mean)) AS xs FROM mr GROUP BY 1)
SELECT ml.evaluation_id, p.n, round(p.mean, 6) AS mean, round(xs[11], 6) AS ci_lower, round(xs[390], 6) AS ci_upper
FROM ml JOIN (SELECT evaluation_id, sum(n)::BIGINT AS n, sum(value * n) / sum(n) AS mean FROM ce GROUP BY 1) p USING (evaluation_id)""")
def _(v):
    df = v("labels").select((F.col("doc_id") % 4).cast("string").alias("evaluation_id"),
                            F.round(F.col("quality") * F.lit(0.7) + F.col("toxic") * F.lit(0.1), 3).alias("value"))
    return U.mean_ci(df, BY, "value", b=400, seed=0, sampler="hash")


@query("unc_07_detectability", """SELECT evaluation_id, dimension, round(ci_upper - ci_lower, 6) AS width,
 CASE WHEN ci_lower IS NULL OR ci_upper IS NULL THEN 8 ELSE greatest(1, least(9, 8 - floor(greatest(ci_upper - ci_lower, 0) / 0.05::DOUBLE)))::INT END AS d FROM v_probes""", ("v_probes",))
def _(v):
    width = F.col("ci_upper") - F.col("ci_lower")
    return v("v_probes").select("evaluation_id", "dimension", width.alias("width"), detectability(width).alias("d"))
