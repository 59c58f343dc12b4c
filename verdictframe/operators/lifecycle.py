"""Lifecycle tables: status replay, timelines, listings, evaluation detail and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import first_case
from .ordering import latest, previous_by_id

# States, the event that enters each, and the states it may be entered from.
STATES = ("NONE", "PENDING", "RUNNING", "PROBES_COMPLETED", "FINALIZED", "FAILED")
TRANSITIONS = {
    "created": ("PENDING", ("NONE",)),
    "started": ("RUNNING", ("PENDING",)),
    "probes_completed": ("PROBES_COMPLETED", ("RUNNING",)),
    "finalized": ("FINALIZED", ("PROBES_COMPLETED",)),
    "failed": ("FAILED", ("RUNNING", "PROBES_COMPLETED")),
}
IN_PROGRESS = ("RUNNING", "PROBES_COMPLETED")
ACTIVE = ("PENDING", "RUNNING", "PROBES_COMPLETED", "AGENT_COMPLETED")
LEGACY = "legacy"


#: Evaluations with an agent and a reviewer pass two more states; without a reviewer they end after the agent.
ASSISTED_STATES = ("NONE", "PENDING", "RUNNING", "PROBES_COMPLETED", "AGENT_COMPLETED", "AWAITING_REVIEW", "FINALIZED", "FAILED")
ASSISTED_TRANSITIONS = {
    **TRANSITIONS,
    "agent_completed": ("AGENT_COMPLETED", ("PROBES_COMPLETED",)),
    "awaiting_review": ("AWAITING_REVIEW", ("AGENT_COMPLETED",)),
    "finalized": ("FINALIZED", ("AGENT_COMPLETED", "AWAITING_REVIEW")),
    "failed": ("FAILED", ("RUNNING", "PROBES_COMPLETED", "AGENT_COMPLETED")),
}
Legal = dict[str, tuple[str, tuple[str, ...]]]


def _apply(event: Column, state: Column, legal: Legal, states: tuple[str, ...]) -> Column:
    """Next state number of a compare-and-set transition; an event from a wrong state changes nothing."""
    return first_case(*[
        ((event == name) & state.isin(*[states.index(x) for x in sources]), states.index(target))
        for name, (target, sources) in legal.items()], default=state)


def _compose(maps: Column, start: Column) -> Column:
    """State after a sequence of transition maps; a map lists the end state of every start state."""
    return F.aggregate(maps, start, lambda s, m: F.element_at(m, s + 1))


def _blocks(events: DataFrame, by: list[str], order: str, event: str, block: int, span: int, legal: Legal, states: tuple[str, ...]) -> DataFrame:
    """Blocks of consecutive ids with their events in order and their transition map."""
    b = F.floor(F.col(order) / block).cast("bigint")
    item = F.struct(F.col(order).cast("bigint").alias("id"), F.col(event).alias("e"))
    packed = events.groupBy(*by, b.alias("_b")).agg(F.sort_array(F.collect_list(item)).alias("_ev"))
    ends = F.array(*[F.aggregate("_ev", F.lit(s), lambda acc, x: _apply(x["e"], acc, legal, states)) for s in range(len(states))])
    return packed.withColumn("_map", ends).withColumn("_span", F.floor(F.col("_b") / span).cast("bigint"))


def _spans(blocks: DataFrame, by: list[str], states: tuple[str, ...]) -> DataFrame:
    """Transition map of every span of blocks."""
    maps = F.transform(F.sort_array(F.collect_list(F.struct("_b", "_map"))), lambda x: x["_map"])
    packed = blocks.groupBy(*by, "_span").agg(maps.alias("_maps"))
    return packed.select(*by, "_span", F.array(*[_compose(F.col("_maps"), F.lit(s)) for s in range(len(states))]).alias("_smap"))


def _name(state: Column, states: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in states]), state + 1)


def replay_status(events: DataFrame, by: list[str], order: str = "id", event: str = "event_type", block: int = 10_000,
                  span: int = 1_000, legal: Legal = TRANSITIONS, states: tuple[str, ...] = STATES) -> DataFrame:
    """Accepted or rejected per event, and the state after it, in id order.

    ``legal`` names for each event the state it leads to and the states it may come from; the first of ``states`` is the
    start. A block of events is a map from start state to end state.  Blocks hold at most
    ``block`` events and are folded apart; spans of blocks are composed the same way, and
    only their maps are chained, so one busy evaluation is spread over many tasks.
    """
    blocks = _blocks(events, by, order, event, block, span, legal, states)
    earlier = W.partitionBy(*by).orderBy("_span").rowsBetween(W.unboundedPreceding, -1)
    entry = _spans(blocks, by, states).select(*by, "_span", _compose(F.collect_list("_smap").over(earlier), F.lit(0)).alias("_enter"))
    inside = W.partitionBy(*by, "_span").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    started = blocks.withColumn("_before", F.collect_list("_map").over(inside)).join(entry, [*by, "_span"]).withColumn(
        "_start", _compose(F.col("_before"), F.col("_enter")))
    # running states of a block as one character each: a string grows without its parts being copied one by one
    mark = lambda state: F.char(state + 48)
    start = F.struct(mark(F.col("_start")).alias("told"), F.col("_start").alias("now"))

    def step(acc: Column, x: Column) -> Column:
        after = _apply(x["e"], acc["now"], legal, states)
        return F.struct(F.concat(acc["told"], mark(after)).alias("told"), after.alias("now"))

    met = F.transform(F.split(F.aggregate("_ev", start, step)["told"], ""), lambda c: F.ascii(c) - 48)
    rows = started.withColumn("_met", met).select(*by, "_met", F.posexplode("_ev").alias("_i", "_x"))
    before, after = F.element_at("_met", F.col("_i") + 1), F.element_at("_met", F.col("_i") + 2)
    return rows.select(*by, F.col("_x.id").alias(order), F.col("_x.e").alias(event),
                       (before != after).alias("accepted"), _name(after, states).alias("state"))


def final_states(events: DataFrame, by: list[str], order: str = "id", event: str = "event_type", block: int = 10_000,
                 span: int = 1_000, legal: Legal = TRANSITIONS, states: tuple[str, ...] = STATES) -> DataFrame:
    """Last state per evaluation, from the composed maps only."""
    spans = _spans(_blocks(events, by, order, event, block, span, legal, states), by, states)
    maps = F.transform(F.sort_array(F.collect_list(F.struct("_span", "_smap"))), lambda x: x["_smap"])
    return spans.groupBy(*by).agg(maps.alias("_maps")).select(*by, _name(_compose(F.col("_maps"), F.lit(0)), states).alias("state"))


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def timeline(events: DataFrame, by: list[str], order: str = "id", ts: str = "created_at") -> DataFrame:
    """Events in id order with the seconds since the one before."""
    prev = previous_by_id(events, by, order, [ts])
    gap = _micros(F.col(ts)) - _micros(F.col(f"prev_{ts}"))
    return prev.withColumn("gap_s", (gap / F.lit(1e6))).drop(f"prev_{ts}")


def page(df: DataFrame, ts: str, key: str, limit: int, cursor: tuple | None = None) -> DataFrame:
    """One page of a listing, newest first; ``cursor`` is (timestamp, key) of the last row seen.

    Ordering and limit together run as a top-n, never as a full sort.
    """
    if limit < 1:
        raise ValueError("a page has at least one row")
    if cursor is not None:
        at, k = F.lit(cursor[0]).cast("timestamp"), F.lit(cursor[1])
        df = df.filter((F.col(ts) < at) | ((F.col(ts) == at) & (F.col(key) < k)))
    return df.orderBy(F.col(ts).desc(), F.col(key).desc()).limit(limit)


def progress(probes: DataFrame, by: list[str], total: int = 5) -> DataFrame:
    """Finished probes out of five; repeated rows of a dimension count once."""
    done = probes.groupBy(*by, "dimension").agg(F.count("*").alias("_n")).groupBy(*by).agg(F.count("*").alias("done"))
    return done.withColumn("total", F.lit(total)).withColumn("complete", F.col("done") == total)


def status_counts(df: DataFrame, by: list[str], status: str = "status") -> DataFrame:
    """Every status in exactly one bucket, unknown ones in 'other'; one total row per rollup level."""
    s = F.col(status)
    known = ("AWAITING_REVIEW", *ACTIVE, "FINALIZED", "FAILED")
    return df.rollup(*by).agg(
        F.count_if(s == "AWAITING_REVIEW").alias("awaiting"), F.count_if(s.isin(*ACTIVE)).alias("active"),
        F.count_if(s == "FINALIZED").alias("finalized"), F.count_if(s == "FAILED").alias("failed"),
        F.count_if(F.coalesce(~s.isin(*known), F.lit(True))).alias("other"), F.count("*").alias("total"))


def evaluation_detail(evaluations: DataFrame, by: list[str], parts: list[DataFrame]) -> DataFrame:
    """One row per evaluation from keyed parts (each already one row per evaluation)."""
    return reduce(lambda left, right: left.join(right, by, "left"), parts, evaluations)


def mode_disclosure(has_score: Column, withheld: Column, rated: Column) -> Column:
    """State of the score shown to a reader."""
    return first_case((has_score, "scored"), (F.coalesce(withheld, F.lit(False)) | rated, "withheld"), default="not_scored_yet")


def report_rows(probes: DataFrame, scores: DataFrame, reports: DataFrame, by: list[str]) -> DataFrame:
    """Report document per evaluation: traceability entry per dimension, limits, next version."""
    entry = F.struct("dimension", "probe_status", "aspect_scoring", "risks", "failed_gates")
    body = probes.groupBy(*by).agg(F.sort_array(F.collect_list(entry)).alias("_t"))  # five dimensions
    limits = probes.select(*by, F.explode(F.array_union("flags", "failed_gates")).alias("_x")).distinct().groupBy(*by).agg(
        F.array_sort(F.collect_set("_x")).alias("limitations"))
    versions = reports.groupBy(*by).agg(F.max("version").alias("_v"))
    j = scores.join(body, by).join(limits, by, "left").join(versions, by, "left")
    return j.select(*by, "score", "score_state", F.to_json("_t").alias("traceability"),
                    F.coalesce("limitations", F.array().cast("array<string>")).alias("limitations"),
                    (F.coalesce("_v", F.lit(0)) + 1).cast("int").alias("version"))


def publishable(evaluations: DataFrame, scores: DataFrame, by: list[str]) -> DataFrame:
    """Finalised evaluations that have a score; publishing twice keeps the first stamp."""
    scored = scores.filter(F.col("score").isNotNull()).select(*by)
    return evaluations.filter(F.col("status") == "FINALIZED").join(scored, by, "left_semi")


def publish(selected: DataFrame, published: DataFrame, by: list[str], at: Column) -> DataFrame:
    """Publication stamps after (re-)publishing ``selected``: existing stamps stay."""
    fresh = selected.select(*by).join(published.select(*by), by, "left_anti").withColumn("published_at", at)
    return published.select(*by, "published_at").unionByName(fresh)


def stuck_runs(events: DataFrame, states: DataFrame, by: list[str], now: Column, seconds: float, ts: str = "created_at") -> DataFrame:
    """Evaluations in progress without an event for ``seconds``."""
    last = events.groupBy(*by).agg(F.max(ts).alias("last_event"))
    idle = (_micros(now) - _micros(F.col("last_event"))) / F.lit(1e6)
    return states.filter(F.col("state").isin(*IN_PROGRESS)).join(last, by).withColumn("idle_s", idle).filter(F.col("idle_s") > seconds)


def stamp(df: DataFrame, version: str = "rule_version") -> DataFrame:
    """Rule version of every row; unstamped rows get the legacy mark and keep the legacy branch."""
    v = F.coalesce(version, F.lit(LEGACY))
    return df.withColumn(version, v).withColumn("required_aspects_rule", F.when(v == LEGACY, "fixed_five").otherwise("without_not_applicable"))


def todo(models: DataFrame, seeds: list[int], done: DataFrame, keys: tuple[str, str] = ("model", "seed")) -> DataFrame:
    """Planned (model, seed) runs that have not finished; the seeds are part of the plan, so they are literals."""
    planned = F.explode(F.array(*[F.lit(s).cast("bigint") for s in seeds]))
    plan = models.select(keys[0]).distinct().withColumn(keys[1], planned)
    return plan.join(done.select(*keys), list(keys), "left_anti")
