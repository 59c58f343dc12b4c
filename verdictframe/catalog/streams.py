"""Streaming queries (STR): each drains a file stream over the events table and reads the result back."""

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..streaming import operators as T
from .base import query
from .lifecycle import _REPLAY


def _stream(v):
    raw = T.read_events(v.spark, v.sf_dir, "events.parquet", v("events").schema)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def _life(df):
    kind = F.when(F.col("event_type") == "signup", "created").when(F.col("event_type") == "view", "started").when(
        F.col("event_type") == "click", "probes_completed").when(F.col("event_type") == "purchase", "finalized").otherwise("failed")
    return df.select(F.col("user_id").alias("evaluation_id"), F.col("event_id").alias("id"), kind.alias("event_type"), "ts")


def _arrivals(v, batch):
    """The events as a stream of files, one file per micro-batch, in the order of ``batch``."""
    folder = T.scratch(v.spark, "arrivals")
    numbered = v("events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("_batch", batch)
    for k in range(BATCHES):
        numbered.filter(F.col("_batch") == k).drop("_batch").coalesce(1).write.mode("append").parquet(folder)
    return T.read_events(v.spark, folder, "*.parquet", numbered.drop("_batch").schema, files_per_batch=1)


BATCHES = 5
# every seventh event reaches the stream ten days late; a batch holds six days of arrivals
_LATE = f"""WITH a AS (SELECT *, least({BATCHES - 1}, date_diff('day', (SELECT min(ts)::DATE FROM events), (ts + CASE WHEN event_id % 7 = 3 THEN INTERVAL '10 days' ELSE INTERVAL '0 days' END)::DATE) // 6) AS b FROM events),
 top AS (SELECT b, max(max(ts)) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) AS newest FROM a GROUP BY b),
 k AS (SELECT a.*, coalesce(ts <= date_trunc('milliseconds', newest) - INTERVAL '1 hour', false) AS late FROM a JOIN top USING (b)),
 """


def _late_batch(v):
    first = v("events").agg(F.to_date(F.min("ts")).alias("d")).first()["d"]
    arrival = F.col("ts") + F.when(F.col("event_id") % 7 == 3, F.make_dt_interval(F.lit(10))).otherwise(F.make_dt_interval(F.lit(0)))
    return F.least(F.lit(BATCHES - 1), F.floor(F.datediff(F.to_date(arrival), F.lit(first)) / 6))


@query("str_01_windowed_metrics", _LATE + """p AS (SELECT time_bucket(INTERVAL '1 day', ts) AS ws, event_type AS grp, (value > 20)::INT AS label, (user_id % 2)::INT AS y_hat FROM k WHERE NOT late),
 m AS (SELECT max(ts) - INTERVAL '1 hour' AS wm FROM events),
 g AS (SELECT ws, grp, count(*) AS n, count(*) FILTER (WHERE label = 1 AND y_hat = 1) AS tp, count(*) FILTER (WHERE label = 0 AND y_hat = 1) AS fp,
  count(*) FILTER (WHERE label = 1 AND y_hat = 0) AS fn, count(*) FILTER (WHERE label = 0 AND y_hat = 0) AS tn FROM p GROUP BY 1, 2)
SELECT strftime(ws, '%Y-%m-%d') AS window_day, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_groups, round(max((tp + fp)::DOUBLE / n) - min((tp + fp)::DOUBLE / n), 6) AS dpd,
 round(greatest(max(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0)) - min(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0)),
  max(coalesce(fp::DOUBLE / nullif(fp + tn, 0), 0)) - min(coalesce(fp::DOUBLE / nullif(fp + tn, 0), 0))), 6) AS eod,
 (SELECT count(*) FROM k WHERE late) AS late_rows
FROM g CROSS JOIN m WHERE ws + INTERVAL '1 day' <= wm GROUP BY 1""")
def _(v):
    late = T.DroppedRows()
    v.spark.streams.addListener(late)
    try:
        rows = T.once(_arrivals(v, _late_batch(v)), ["event_id"], "ts", "1 hour").select(
            "ts", F.col("event_type").alias("grp"), (F.col("value") > 20).cast("int").alias("label"), (F.col("user_id") % 2).cast("int").alias("y_hat"))
        cells = T.run_to_table(T.windowed_cells(rows, "ts", "1 day", None, []), "append", "cells", late)
    finally:
        v.spark.streams.removeListener(late)
    cells = cells.withColumn("window_day", F.date_format("window_start", "yyyy-MM-dd"))
    stats = M.group_stats(cells, ["window_day", "late_rows"])
    gaps = M.gap_columns()
    return stats.groupBy("window_day", "late_rows").agg(F.sum("n").alias("n"), F.count("*").alias("n_groups"), gaps["dpd"].alias("dpd"), gaps["eod"].alias("eod"))


# batches of uneven size in order of id; every eleventh event comes one batch late and counts as late if its evaluation has moved on
_SPLIT = f"""e AS (SELECT *, least({BATCHES - 1}, CAST(floor(sqrt(id::DOUBLE / (SELECT max(id) + 1 FROM v_events)) * {BATCHES}) AS BIGINT) + CASE WHEN id % 11 = 5 THEN 1 ELSE 0 END) AS batch FROM v_events),
 pr AS (SELECT evaluation_id, batch, max(max(id)) OVER (PARTITION BY evaluation_id ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM e GROUP BY 1, 2),
 el AS (SELECT e.*, coalesce(id < seen, false) AS late FROM e JOIN pr USING (evaluation_id, batch)), eo AS (SELECT id, evaluation_id, created_at, event_type FROM el WHERE NOT late)"""


@query("str_02_lifecycle_stream", ", " + _SPLIT + _REPLAY.replace("v_events", "eo") + """ SELECT evaluation_id, id, event_type, accepted, state, false AS late FROM rp
UNION ALL SELECT evaluation_id, id, event_type, false, NULL, true FROM el WHERE late""", ("v_events",))
def _(v):
    ids = v("events").agg((F.max("event_id") + 1).alias("n")).first()["n"]
    share = F.sqrt(F.col("event_id").cast("double") / F.lit(ids)) * BATCHES
    batch = F.least(F.lit(BATCHES - 1), F.floor(share) + F.when(F.col("event_id") % 11 == 5, 1).otherwise(0))
    out = T.run_to_table(T.lifecycle_stream(_life(_arrivals(v, batch)).drop("ts")), "append", "lifecycle")
    return out.withColumn("state", F.when(~F.col("late"), F.col("state")))


@query("str_03_live_progress", "SELECT user_id, count(*) AS done FROM events GROUP BY 1")
def _(v):
    out = T.run_to_table(T.live_progress(_stream(v), ["user_id"]), "update", "progress")
    return out.groupBy("user_id").agg(F.max_by("done", "epoch").alias("done"))


@query("str_04_distinct_content", """SELECT DISTINCT sha256(props) AS sha256 FROM events
WHERE sha256(props) NOT IN (SELECT sha256(props) FROM events WHERE event_type = 'signup' AND value > 80)""")
def _(v):
    registry = T.scratch(v.spark, "registry")
    known = v("events").filter("event_type = 'signup' and value > 80").select(F.sha2("props", 256).alias("sha256")).distinct()
    known.write.parquet(f"{registry}/epoch=-1")
    fresh = T.distinct_content(_stream(v).select("ts", "props"), "props", "ts", "60 days").select("sha256")
    T.run_into(fresh, T.upsert_registry(registry, lambda batch, held: batch.join(held, "sha256", "left_anti")), "content")
    return v.spark.read.schema("sha256 string, epoch bigint").parquet(registry).filter("epoch >= 0").select("sha256")


@query("str_05_sessions", """WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '6 hours' THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM o),
 g AS (SELECT user_id, sid, min(ts) AS a, max(ts) AS b, count(*) AS n FROM s GROUP BY 1, 2) SELECT user_id, epoch_us(a) AS start_us, epoch_us(b) AS last_us, n AS n_events FROM g WHERE b + INTERVAL '6 hours' <= (SELECT max(ts) - INTERVAL '1 hour' FROM events)""")
def _(v):
    out = T.run_to_table(T.sessions(_stream(v), ["user_id"], "ts", "6 hours", "1 hour"), "append", "sessions")
    return out.select("user_id", F.unix_micros("session_start").alias("start_us"), F.unix_micros("last_event").alias("last_us"), "n_events")
