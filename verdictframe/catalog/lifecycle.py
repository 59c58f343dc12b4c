"""Lifecycle, listings and reports (LIFE)."""

from pyspark.sql import functions as F

from ..operators import lifecycle as L
from ..operators import ratings as S
from ..operators.ordering import latest
from .base import query
from .ratings import _T, PROP_SQL, proposals, typed

BY = ["evaluation_id"]

# every state is entered at most once, so the accepted events are chained minima
_REPLAY = """, t1 AS (SELECT evaluation_id, min(id) AS a FROM v_events WHERE event_type = 'created' GROUP BY 1),
 t2 AS (SELECT e.evaluation_id, min(id) AS b FROM v_events e JOIN t1 USING (evaluation_id) WHERE event_type = 'started' AND id > a GROUP BY 1),
 t3 AS (SELECT e.evaluation_id, min(id) AS c, arg_min(event_type, id) AS ce FROM v_events e JOIN t2 USING (evaluation_id) WHERE event_type IN ('probes_completed', 'failed') AND id > b GROUP BY 1),
 t4 AS (SELECT e.evaluation_id, min(id) AS d, arg_min(event_type, id) AS de FROM v_events e JOIN t3 USING (evaluation_id) WHERE ce = 'probes_completed' AND event_type IN ('finalized', 'failed') AND id > c GROUP BY 1),
 rp AS (SELECT e.evaluation_id, e.id, e.event_type, e.created_at, coalesce(e.id IN (a, b, c, d), false) AS accepted, CASE WHEN id >= d THEN CASE WHEN de = 'failed' THEN 'FAILED' ELSE 'FINALIZED' END WHEN id >= c THEN CASE WHEN ce = 'failed' THEN 'FAILED' ELSE 'PROBES_COMPLETED' END
  WHEN id >= b THEN 'RUNNING' WHEN id >= a THEN 'PENDING' ELSE 'NONE' END AS state FROM v_events e LEFT JOIN t1 USING (evaluation_id) LEFT JOIN t2 USING (evaluation_id) LEFT JOIN t3 USING (evaluation_id) LEFT JOIN t4 USING (evaluation_id)),
 fs AS (SELECT evaluation_id, arg_max(state, id) AS state, max(created_at) AS last_event FROM rp GROUP BY 1)"""


@query("life_01_replay_status", _REPLAY + " SELECT evaluation_id, id, event_type, coalesce(accepted, false) AS accepted, state FROM rp", ("v_events",))
def _(v):
    return L.replay_status(v("v_events"), BY, block=500, span=4)


@query("life_01_final_states", _REPLAY + " SELECT evaluation_id, state FROM fs", ("v_events",))
def _(v):
    return L.final_states(v("v_events"), BY)


@query("life_02_timeline", """SELECT evaluation_id, id, event_type, round(epoch_us(created_at - lag(created_at) OVER w) / 1e6, 6) AS gap_s FROM v_events WINDOW w AS (PARTITION BY evaluation_id ORDER BY id)""".replace(
    "epoch_us(created_at - lag(created_at) OVER w)", "(epoch_us(created_at) - epoch_us(lag(created_at) OVER w))"), ("v_events",))
def _(v):
    return L.timeline(v("v_events"), BY).select("evaluation_id", "id", "event_type", "gap_s")


@query("life_03_latest", "SELECT model, run_id, status, score FROM v_runs QUALIFY row_number() OVER (PARTITION BY model ORDER BY created_at DESC, run_id DESC) = 1", ("v_runs",))
def _(v):
    return latest(v("v_runs"), ["model"], ["created_at", "run_id"]).select("model", "run_id", "status", "score")


@query("life_04_page", """SELECT run_id, model, status FROM v_runs WHERE created_at < TIMESTAMP '1999-06-01' OR (created_at = TIMESTAMP '1999-06-01' AND run_id < 5000) ORDER BY created_at DESC, run_id DESC LIMIT 500""", ("v_runs",))
def _(v):
    return L.page(v("v_runs"), "created_at", "run_id", 500, ("1999-06-01 00:00:00", 5000)).select("run_id", "model", "status")


@query("life_05_progress", """SELECT evaluation_id, count(DISTINCT dimension) AS done, 5 AS total, count(DISTINCT dimension) = 5 AS complete FROM v_probes WHERE probe_status <> 'FAILED' GROUP BY 1""", ("v_probes",))
def _(v):
    return L.progress(v("v_probes").filter("probe_status <> 'FAILED'"), BY)


@query("life_06_status_counts", """SELECT model, count(*) FILTER (WHERE status = 'AWAITING_REVIEW') AS awaiting, count(*) FILTER (WHERE status IN ('PENDING', 'RUNNING')) AS active, count(*) FILTER (WHERE status = 'FINALIZED') AS finalized,
 count(*) FILTER (WHERE status = 'FAILED') AS failed, count(*) FILTER (WHERE status NOT IN ('AWAITING_REVIEW', 'FINALIZED', 'FAILED')) AS other, count(*) AS total FROM v_runs GROUP BY ROLLUP (model)""", ("v_runs",))
def _(v):
    return L.status_counts(v("v_runs"), ["model"])


_SC = """, sc AS (SELECT evaluation_id, count("O") AS complete_aspect_count, CASE WHEN count("O") = 5 THEN round(avg(cbrt("O" * "S" * "D")), 4) END AS score, CASE WHEN count("O") = 5 THEN 'scored' ELSE 'withheld' END AS score_state,
  round(avg(confidence), 4) AS overall_confidence FROM pp GROUP BY 1)"""


@query("life_07_detail", PROP_SQL + _SC + """, ev AS (SELECT DISTINCT evaluation_id, model, rule_version FROM v_probes), pg AS (SELECT evaluation_id, count(DISTINCT dimension) AS done FROM v_probes WHERE probe_status <> 'FAILED' GROUP BY 1)
SELECT ev.evaluation_id, model, coalesce(done, 0) AS done, complete_aspect_count, score, overall_confidence, CASE WHEN score IS NOT NULL THEN 'scored' ELSE 'withheld' END AS disclosure FROM ev LEFT JOIN pg USING (evaluation_id) LEFT JOIN sc USING (evaluation_id)""", ("v_probes",))
def _(v):
    p, prop = v("v_probes"), proposals(v)
    detail = L.evaluation_detail(p.select("evaluation_id", "model", "rule_version").distinct(), BY, [
        L.progress(p.filter("probe_status <> 'FAILED'"), BY).select("evaluation_id", "done"), S.score_or_withhold(prop, BY), S.overall_confidence(prop, BY)])
    return detail.select(
        "evaluation_id", "model", F.coalesce("done", F.lit(0).cast("bigint")).alias("done"), "complete_aspect_count", "score", "overall_confidence",
        L.mode_disclosure(F.col("score").isNotNull(), F.col("score_state") == "withheld", F.lit(True)).alias("disclosure"))


@query("life_08_report", _T + """, en AS (SELECT evaluation_id, '[' || string_agg('{"dimension":"' || dimension || '","probe_status":"' || probe_status || '","aspect_scoring":"' || aspect_scoring || '","risks":[' || CASE WHEN len(risks) > 0 THEN '"' || array_to_string(risks, '","') || '"' ELSE '' END
  || '],"failed_gates":[' || CASE WHEN len(failed_gates) > 0 THEN '"' || array_to_string(failed_gates, '","') || '"' ELSE '' END || ']}', ',' ORDER BY dimension) || ']' AS traceability FROM tp GROUP BY 1),
 li AS (SELECT evaluation_id, string_agg(x, '|' ORDER BY x) AS limitations FROM (SELECT DISTINCT evaluation_id, unnest(list_concat(flags, failed_gates)) AS x FROM tp) GROUP BY 1),
 ve AS (SELECT evaluation_id, max(evaluation_id % 4)::INT AS v FROM tp WHERE rule_version = 'current' GROUP BY 1)
SELECT evaluation_id, md5(traceability) AS traceability_md5, coalesce(limitations, '') AS limitations, coalesce(v, 0) + 1 AS version FROM en LEFT JOIN li USING (evaluation_id) LEFT JOIN ve USING (evaluation_id)""", ("v_probes",))
def _(v):
    p = typed(v)
    scores = p.select("evaluation_id").distinct().select("evaluation_id", F.lit(None).cast("double").alias("score"), F.lit("withheld").alias("score_state"))
    reports = p.filter("rule_version = 'current'").select("evaluation_id", (F.col("evaluation_id") % 4).cast("int").alias("version"))
    return L.report_rows(p, scores, reports, BY).select("evaluation_id", F.md5("traceability").alias("traceability_md5"), "limitations", "version")


@query("life_09_publishable", """SELECT run_id, model FROM v_runs WHERE status = 'FINALIZED' AND score > 3""", ("v_runs",))
def _(v):
    r = v("v_runs")
    scores = r.select("run_id", F.when(F.col("score") > 3, F.col("score")).alias("score"))
    return L.publishable(r, scores, ["run_id"]).select("run_id", "model")


@query("life_09_publish", """SELECT run_id, created_at AS published_at FROM v_runs WHERE status = 'AWAITING_REVIEW' OR (status = 'FINALIZED' AND seed = 1998)
UNION ALL SELECT run_id, TIMESTAMP '2020-01-01' FROM v_runs WHERE status = 'FINALIZED' AND seed <> 1998""", ("v_runs",))
def _(v):
    r = v("v_runs")
    done = r.filter("status = 'AWAITING_REVIEW' or (status = 'FINALIZED' and seed = 1998)").select("run_id", F.col("created_at").alias("published_at"))
    return L.publish(r.filter("status = 'FINALIZED'"), done, ["run_id"], F.lit("2020-01-01 00:00:00").cast("timestamp"))


# an evaluation of a day is one of its own, so that some are left in progress; the log's newest entry is its present
_DAYS = ", ve AS (SELECT id, evaluation_id * 100 + day(created_at) AS evaluation_id, created_at, event_type FROM v_events)" + _REPLAY.replace("v_events", "ve")


@query("life_10_stuck_runs", _DAYS + """, nw AS (SELECT max(created_at) AS t FROM v_events)
SELECT evaluation_id, state, round((epoch_us(t) - epoch_us(last_event)) / 1e6, 6) AS idle_s FROM fs CROSS JOIN nw
WHERE state IN ('RUNNING', 'PROBES_COMPLETED') AND (epoch_us(t) - epoch_us(last_event)) / 1e6 > 3600""", ("v_events",))
def _(v):
    e = v("v_events").withColumn("evaluation_id", F.col("evaluation_id") * 100 + F.day("created_at"))
    newest = e.agg(F.max("created_at").cast("string").alias("t")).first()["t"]
    return L.stuck_runs(e, L.final_states(e, BY), BY, F.lit(newest).cast("timestamp"), 3600).select("evaluation_id", "state", "idle_s")


@query("life_11_stamp", """SELECT evaluation_id, dimension, coalesce(rule_version, 'legacy') AS rule_version, CASE WHEN coalesce(rule_version, 'legacy') = 'legacy' THEN 'fixed_five' ELSE 'without_not_applicable' END AS required_aspects_rule FROM v_probes""", ("v_probes",))
def _(v):
    return L.stamp(v("v_probes")).select("evaluation_id", "dimension", "rule_version", "required_aspects_rule")


@query("life_12_todo", """SELECT m.model, s.seed FROM (SELECT DISTINCT model FROM v_runs) m CROSS JOIN (SELECT unnest(range(1995, 2002)) AS seed) s WHERE NOT EXISTS
 (SELECT 1 FROM v_runs r WHERE r.model = m.model AND r.seed = s.seed AND status = 'FINALIZED' AND score > 9.3)""", ("v_runs",))
def _(v):
    r = v("v_runs")
    return L.todo(r, list(range(1995, 2002)), r.filter("status = 'FINALIZED' and score > 9.3"))
