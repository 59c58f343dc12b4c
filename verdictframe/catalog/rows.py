"""Row preparation, decoding, scoring and screening (ROW)."""

import hashlib

import pandas as pd
from pyspark.sql import functions as F

from ..functions.columns import is_missing
from ..operators import rows as R
from .base import query

WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def strip_sql(x: str) -> str:
    return f"trim({x}, {WS})"


def missing_sql(x: str) -> str:
    return f"(coalesce(lower({strip_sql(x)}), '') IN ('', 'na', 'n/a', 'null', 'nan', 'none'))"


MAPPING = {"toxic": 1, "clean": 0}
_MAP = f"CASE {strip_sql('target')} WHEN 'toxic' THEN 1 WHEN 'clean' THEN 0 END"
FAIR_REASON = f"""CASE WHEN {missing_sql('target')} THEN 'missing_target' WHEN coalesce(length({strip_sql('text')}), 0) = 0 THEN 'missing_text'
 WHEN {missing_sql('grp')} THEN 'missing_group' WHEN {strip_sql('grp')} IN ('xx') THEN 'excluded_group' WHEN {_MAP} IS NULL THEN 'unmapped_label' END"""


@query("row_01_missing", f"""SELECT dataset_id, count(*) FILTER (WHERE {missing_sql('target')}) AS missing_target,
 count(*) FILTER (WHERE {missing_sql('grp')}) AS missing_grp, count(*) FILTER (WHERE {missing_sql('length')}) AS missing_length
FROM v_raw GROUP BY 1""", ("v_raw",))
def _(v):
    return v("v_raw").groupBy("dataset_id").agg(
        *[F.count_if(is_missing(c)).alias(f"missing_{c}") for c in ("target", "grp", "length")])


@query("row_02_prepare_fairness", f"""SELECT row_id, drop_reason, label, group_value FROM (
 SELECT row_id, {FAIR_REASON.replace("'xx'", "'de'")} AS drop_reason, {_MAP} AS label, {strip_sql('grp')} AS group_value FROM v_raw)
WHERE drop_reason IS NULL""", ("v_raw",))
def _(v):
    df = R.prepare_fairness(v("v_raw"), MAPPING, ["de"])
    return df.filter("drop_reason is null").select("row_id", "drop_reason", "label", "group_value")


@query("row_02_exclusion_counts", f"""SELECT dataset_id, coalesce({FAIR_REASON.replace("'xx'", "'de'")}, 'kept') AS reason, count(*) AS n
FROM v_raw GROUP BY 1, 2""", ("v_raw",))
def _(v):
    return R.exclusion_counts(R.prepare_fairness(v("v_raw"), MAPPING, ["de"]), ["dataset_id"])


@query("row_02_labels_seen", f"""SELECT DISTINCT dataset_id, {strip_sql('target')} AS target_value FROM v_raw
WHERE {FAIR_REASON.replace("'xx'", "'de'")} IS NULL""", ("v_raw",))
def _(v):
    return R.labels_seen(R.prepare_fairness(v("v_raw"), MAPPING, ["de"]), ["dataset_id"])


@query("row_03_prepare_robustness", f"""SELECT dataset_id, coalesce(CASE WHEN {missing_sql('target')} THEN 'missing_target'
 WHEN coalesce(length({strip_sql('text')}), 0) = 0 THEN 'missing_text' WHEN {_MAP} IS NULL THEN 'unmapped_label' END, 'kept') AS reason, count(*) AS n
FROM v_raw GROUP BY 1, 2""", ("v_raw",))
def _(v):
    return R.exclusion_counts(R.prepare_robustness(v("v_raw"), MAPPING), ["dataset_id"])


@query("row_04_prepare_safety", f"""SELECT row_id, CASE WHEN {missing_sql('target')} THEN 'missing_target' WHEN {missing_sql('severe')} THEN 'missing_severe'
 WHEN coalesce(length({strip_sql('text')}), 0) = 0 THEN 'missing_text' WHEN {_MAP} IS NULL THEN 'unmapped_label'
 WHEN {strip_sql('severe')} NOT IN ('0', '1') THEN 'invalid_severe' END AS drop_reason, {_MAP} AS label,
 TRY_CAST({strip_sql('severe')} AS INT) AS severe_flag FROM v_raw""", ("v_raw",))
def _(v):
    return R.prepare_safety(v("v_raw"), MAPPING).select("row_id", "drop_reason", "label", "severe_flag")


@query("row_05_normalize", f"""SELECT row_id, {strip_sql('text')} AS text, toxic AS label, {strip_sql('grp')} AS grp
FROM v_raw LEFT JOIN labels ON doc_id = row_id WHERE coalesce(length({strip_sql('text')}), 0) > 0 AND toxic IS NOT NULL
 AND coalesce(length({strip_sql('grp')}), 0) > 0""", ("v_raw",))
def _(v):
    df = v("v_raw").join(v("labels").withColumnRenamed("doc_id", "row_id"), "row_id", "left")
    return R.normalize_rows(df.withColumnRenamed("toxic", "label")).select("row_id", "text", "label", "grp")


@query("row_06_label_compat", """SELECT o_orderpriority, count(*) AS n_requested, count(*) FILTER (WHERE l_linenumber >= 0 AND l_linenumber < 6) AS n_compatible,
 round(count(*) FILTER (WHERE l_linenumber >= 0 AND l_linenumber < 6)::DOUBLE / count(*), 6) AS fraction
FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1""")
def _(v):
    df = v("lineitem").join(v("orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    return R.label_compat(df, 6, ["o_orderpriority"], "l_linenumber")


@query("row_07_perturbable", """SELECT lang, count(*) AS n, count(*) FILTER (WHERE regexp_matches(text, '[\\p{L}\\p{N}]')) AS n_perturbable
FROM documents GROUP BY 1""")
def _(v):
    return v("documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(R.perturbable("text")).alias("n_perturbable"))


@query("row_08_thresholds", """SELECT l_returnflag, CASE WHEN l_discount >= 0.05 THEN 1 ELSE 0 END AS label,
 CASE WHEN l_tax > 0 THEN 1 ELSE 0 END AS identity_ref, CASE WHEN l_quantity > 45 THEN 1 ELSE 0 END AS severe, count(*) AS n
FROM lineitem GROUP BY ALL""")
def _(v):
    df = R.threshold_flags(v("lineitem"), {"label": ("l_discount", ">=", 0.05), "identity_ref": ("l_tax", ">", 0.0),
                                           "severe": ("l_quantity", ">", 45.0)})
    return df.groupBy("l_returnflag", "label", "identity_ref", "severe").agg(F.count("*").alias("n"))


_TERMS = ["the", "thing", "and", "reha", "ionon"]


@query("row_09_mentions", """SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)\\b(?:the|thing|and|reha|ionon)\\b') THEN 1 ELSE 0 END AS mention
FROM documents""")
def _(v):
    return v("documents").select("doc_id", R.mentions("text", _TERMS).alias("mention"))


@query("row_10_decode", """, m AS (SELECT vec_id, embedding[1]::DOUBLE AS z0, list_min(embedding)::DOUBLE AS a0, list_max(embedding)::DOUBLE AS a1, list_transform(embedding, lambda x: x::DOUBLE) AS z FROM embeddings)
SELECT vec_id, (list_position(z, list_max(z)) - 1)::DOUBLE AS y_argmax, CASE WHEN exp(a1) / (exp(a0) + exp(a1)) >= 0.6 THEN 1.0::DOUBLE ELSE 0.0 END AS y_threshold,
 CASE WHEN 1 / (1 + exp(-z[4])) >= 0.52 THEN 1.0::DOUBLE ELSE 0.0 END AS y_multilabel, round(z0, 6) AS y_regression FROM m""".replace(", m AS", "WITH m AS", 1))
def _(v):
    z = F.col("embedding").cast("array<double>")
    return v("embeddings").select(
        "vec_id", R.decode("embedding", "argmax").alias("y_argmax"),
        # two outputs that depend on every component
        R.decode(F.array(F.array_min(z), F.array_max(z)), "threshold", 0.6).alias("y_threshold"),
        R.decode("embedding", "multilabel", 0.52, 3).alias("y_multilabel"), R.decode("embedding", "regression").alias("y_regression"))


def _checksum_model():
    """Deterministic stand-in for a classifier: a bit of the text's MD5, which SQL can state too."""
    return lambda texts: pd.Series([int(hashlib.md5((t or "").encode()).hexdigest()[0], 16) & 1 for t in texts])


@query("row_11_score", """SELECT lang, count(*) AS n, CAST(sum(CAST('0x' || substr(md5(coalesce(text, '')), 1, 1) AS BIGINT) & 1) AS BIGINT) AS positives
FROM documents GROUP BY 1""")
def _(v):
    scored = R.score(v("documents").select("doc_id", "lang", "text"), _checksum_model)
    return scored.groupBy("lang").agg(F.count("*").alias("n"), F.sum("y_hat").alias("positives"))


_POS = """, e AS (SELECT model_id, model, problem_type, labels, x, split_part(x, '=', 1)::INT AS idx,
 replace(lower(trim(split_part(x, '=', 2))), '_', ' ') IN ('toxic', 'toxicity', 'hate', 'hateful', 'hate speech', 'offensive', 'abusive') AS hit
 FROM v_models, unnest(string_split(labels, ';')) AS t(x)),
 p0 AS (SELECT model_id, any_value(problem_type) AS pt, count(*) AS k, count(*) FILTER (WHERE hit) AS hits, min(idx) FILTER (WHERE hit) AS first_hit FROM e GROUP BY 1),
 p AS (SELECT model_id, first_hit, CASE WHEN hits = 0 THEN 'excluded: no label is a positive harm label' WHEN hits > 1 THEN 'excluded: ambiguous positive labels'
 WHEN pt = 'multi_label_classification' THEN 'multi_label' WHEN k <> 2 THEN 'excluded: single-label classes, binary contract not applicable' ELSE 'single_label' END AS positive_reason FROM p0),
 po AS (SELECT model_id, positive_reason, CASE WHEN positive_reason IN ('multi_label', 'single_label') THEN first_hit END AS positive_index FROM p)"""


@query("row_12_positive_output", _POS + " SELECT model_id, positive_reason, positive_index FROM po", ("v_models",))
def _(v):
    return R.positive_output(v("v_models"), R.label_pairs("labels")).select("model_id", "positive_reason", "positive_index")


@query("row_13_snapshot_mismatch", """, w AS (SELECT model_id, split_part(x, '=', 1)::INT AS idx, lower(trim(split_part(x, '=', 2))) AS name FROM v_models, unnest(string_split(labels, ';')) AS t(x)),
 g AS (SELECT model_id, split_part(x, '=', 1)::INT AS idx, lower(trim(split_part(x, '=', 2))) AS name FROM v_models, unnest(string_split(loaded_labels, ';')) AS t(x))
SELECT model_id, w.idx, w.name AS expected, g.name AS got FROM w JOIN g USING (model_id, idx) WHERE w.name <> g.name
UNION ALL SELECT model_id, -1, len(string_split(labels, ';'))::STRING, len(string_split(loaded_labels, ';'))::STRING FROM v_models
WHERE len(string_split(labels, ';')) <> len(string_split(loaded_labels, ';'))""", ("v_models",))
def _(v):
    return R.snapshot_mismatches(v("v_models"), "model_id", R.label_pairs("labels"), R.label_pairs("loaded_labels"))


@query("row_14_strip_keys", """SELECT run_id, 'model=' || model || ';score=' || CAST(seed AS STRING) AS packet FROM v_runs""", ("v_runs",))
def _(v):
    doc = F.create_map(F.lit("model"), F.col("model"), F.lit("status"), F.col("status"),
                       F.lit("score"), F.col("seed").cast("string"), F.lit("flags"), F.col("repeat"))
    kept = R.strip_keys(doc, ["status", "flags", "aspect_scoring"])
    pairs = F.transform(F.array_sort(F.map_entries(kept)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return v("v_runs").select("run_id", F.array_join(pairs, ";").alias("packet"))


_RULES = [("address", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z.]+", "[address]"),
          ("number", r"[0-9]{3,}", "[number]"), ("the", r"\b[Tt]he\b", "")]


@query("row_15_redact", """, a AS (SELECT doc_id, text AS t0, regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\\.[A-Za-z.]+', '[address]', 'g') AS t1 FROM documents),
 b AS (SELECT *, regexp_replace(t1, '[0-9]{3,}', '[number]', 'g') AS t2 FROM a), c AS (SELECT *, regexp_replace(t2, '\\b[Tt]he\\b', '', 'g') AS t3 FROM b)
SELECT doc_id, md5(t3) AS redacted_md5, concat_ws('|', CASE WHEN t1 <> t0 THEN 'address' END, CASE WHEN t2 <> t1 THEN 'number' END, CASE WHEN t3 <> t2 THEN 'the' END) AS redactions FROM c
""".replace(", a AS", "WITH a AS", 1))
def _(v):
    return R.redact(v("documents"), "text", _RULES).select("doc_id", F.md5("redacted").alias("redacted_md5"), "redactions")


@query("row_16_pattern_leaks", """WITH m AS (SELECT doc_id, 'number' AS pattern, unnest(regexp_extract_all(text, '[0-9]{4,}')) AS match FROM documents
 UNION ALL SELECT doc_id, 'address', unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+')) FROM documents
 UNION ALL SELECT doc_id, 'risk id', unnest(regexp_extract_all(text, '[A-Z]{1,3}-[A-Z]{2,}')) FROM documents)
SELECT doc_id, pattern, match, count(*) AS n FROM m GROUP BY ALL""")
def _(v):
    hits = R.pattern_hits(v("documents"), "doc_id", "text", {
        "number": "[0-9]{4,}", "address": "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+", "risk id": "[A-Z]{1,3}-[A-Z]{2,}"})
    return hits.groupBy("doc_id", "pattern", "match").agg(F.count("*").alias("n"))


@query("row_16_literal_leaks", "SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def _(v):
    return R.literal_hits(v("documents"), "doc_id", "text", v("benchmark"), "item_id", "text")


@query("row_17_canonical_hash", """SELECT run_id, sha256('{"fairness_skip":' || coalesce('"' || fairness_skip || '"', 'null') || ',"model":"' || model || '","run_id":' || run_id::STRING || ',"status":"' || status || '"}') AS digest
FROM v_runs""", ("v_runs",))
def _(v):
    return v("v_runs").select("run_id", R.canonical_hash(["status", "run_id", "model", "fairness_skip"]).alias("digest"))


@query("row_18_execution_meta", """, u AS (SELECT evaluation_id, dimension, dim_order, hash_comparison, CASE WHEN n_evaluated % 3 = 0 THEN 'cuda' WHEN dpd > 0.2 THEN 'cpu' END AS execution_device FROM v_probes)
SELECT evaluation_id, first(dimension ORDER BY dim_order) AS dimension, first(execution_device ORDER BY dim_order) AS execution_device
FROM u WHERE execution_device IS NOT NULL AND dimension IN ('FAIRNESS', 'ROBUSTNESS') GROUP BY 1""", ("v_probes",))
def _(v):
    df = v("v_probes").withColumn("execution_device", F.when(F.col("n_evaluated") % 3 == 0, "cuda").when(F.col("dpd") > 0.2, "cpu"))
    return R.execution_meta(df, ["evaluation_id"], ["FAIRNESS", "ROBUSTNESS"])


@query("row_19_eligible", _POS + """, r AS (SELECT m.model_id, CASE WHEN languages <> '' AND NOT list_contains(string_split(languages, ';'), 'en') THEN 'excluded: languages without en'
 WHEN NOT (files LIKE '%.safetensors%' OR files = 'pytorch_model.bin') THEN 'excluded: no PyTorch weights'
 WHEN architecture NOT LIKE '%ForSequenceClassification' THEN 'excluded: not a sequence classifier' ELSE positive_reason END AS reason FROM v_models m JOIN po USING (model_id)),
 q AS (SELECT *, reason NOT LIKE 'excluded%' AS eligible FROM r)
SELECT model_id, reason, eligible, eligible AND sum(CASE WHEN eligible THEN 1 ELSE 0 END) OVER (ORDER BY model_id) <= 50 AS selected FROM q""", ("v_models",))
def _(v):
    m = R.positive_output(v("v_models"), R.label_pairs("labels"))
    return R.eligible(m, "model_id", 50).select("model_id", "reason", "eligible", "selected")
