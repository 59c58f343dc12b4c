"""End-to-end plans over the prediction and card tables."""

from pyspark.sql import functions as F

from ..operators.ordering import latest_wide
from ..plans import audit as P
from ..session import materialize
from .base import query


def _inputs(v):
    """Predictions per nation; the newest card of each owner documents the evaluation with its number."""
    rows = v("v_pred_big").drop("evaluation_id").withColumnRenamed("nation", "evaluation_id")
    newest = materialize(latest_wide(v("v_cards"), ["owner"], "card_id"))  # one card per owner, read by three probes
    cards = newest.withColumn("evaluation_id", F.concat(F.lit("N"), F.substring("owner", 4, 10)))
    listed = F.filter(F.split("files", ";"), lambda x: x != "")
    return rows, cards.withColumn("files", listed).withColumn("live_files", F.split("live_files", ";"))


@query("plan_audit")
def _(v):
    rows, cards = _inputs(v)
    return P.audit(rows, cards, "evaluation_id")


@query("plan_verdicts")
def _(v):
    rows, cards = _inputs(v)
    return P.verdicts(rows, cards, "evaluation_id").select(
        "evaluation_id", "dimension", "probe_status", "aspect_scoring", "risks", "failed_gates", "data_quality", "probe_reliability", "evidence_completeness", "combined")
