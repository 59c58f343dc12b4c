"""Derived views of the driver's tables, one SQL text for both engines.

Only functions with the same meaning in Spark SQL and DuckDB are used.  Every view
keeps all rows of its base table; rules on ids pick *values*, never subsets.
"""

from __future__ import annotations

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

DIMENSIONS = ("FAIRNESS", "ROBUSTNESS", "INTEGRITY", "EXPLAINABILITY", "SAFETY")

_PRED_BIG = """
SELECT evaluation_id, grp, nation, label, y_hat,
       CASE WHEN y_hat = 1 AND tax > 0.065e0 THEN 0 ELSE y_hat END AS y_robust, severe
FROM (
  SELECT 'E' || CAST(year(l.l_shipdate) AS STRING) AS evaluation_id,
         l.l_linestatus AS grp,
         'N' || CAST(s.s_nationkey AS STRING) AS nation,
         CASE WHEN l.l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
         CASE WHEN l.l_returnflag = 'R' AND l.l_linestatus = 'F' AND l.l_discount > 0.015e0 THEN 1
              WHEN l.l_returnflag = 'R' AND l.l_linestatus = 'O' AND l.l_discount > 0.035e0 THEN 1
              WHEN l.l_returnflag <> 'R' AND l.l_discount > 0.085e0 THEN 1 ELSE 0 END AS y_hat,
         l.l_tax AS tax,
         CASE WHEN l.l_quantity > 40 THEN 1 ELSE 0 END AS severe
  FROM lineitem l JOIN supplier s ON s.s_suppkey = l.l_suppkey
) p
"""

_PRED_TEXT = """
SELECT d.doc_id AS row_id, 'q' || CAST(l.quality AS STRING) AS evaluation_id, d.text AS text, l.toxic AS label,
       CASE WHEN (d.doc_id * 31 + d.n_chars) % 10 < (CASE WHEN l.toxic = 1 THEN 7 ELSE 2 END)
            THEN 1 ELSE 0 END AS y_hat,
       CASE WHEN (d.doc_id * 31 + d.n_chars) % 10 < (CASE WHEN l.toxic = 1 THEN 5 ELSE 3 END)
            THEN 1 ELSE 0 END AS y_robust,
       d.lang AS grp, CASE WHEN d.n_chars > 1500 THEN 1 ELSE 0 END AS severe
FROM labels l JOIN documents d ON d.doc_id = l.doc_id
"""

# string cells with the missing tokens, padding and odd labels a hand-made file has
_RAW = """
SELECT d.doc_id AS row_id, d.source AS dataset_id,
       CASE WHEN d.doc_id % 37 = 5 THEN '   ' WHEN d.doc_id % 53 = 7 THEN NULL ELSE d.text END AS text,
       CASE WHEN l.toxic IS NULL AND d.doc_id % 3 = 0 THEN ' N/A ' WHEN l.toxic IS NULL THEN 'null'
            WHEN d.doc_id % 19 = 3 THEN 'other' WHEN l.toxic = 1 THEN ' toxic ' ELSE 'clean' END AS target,
       CASE WHEN d.doc_id % 29 = 1 THEN '' WHEN d.doc_id % 31 = 2 THEN 'NaN' ELSE d.lang END AS grp,
       CASE WHEN d.doc_id % 23 = 4 THEN 'maybe' WHEN d.doc_id % 43 = 6 THEN NULL
            WHEN d.n_chars > 1500 THEN '1' ELSE ' 0' END AS severe,
       CASE WHEN d.doc_id % 17 = 0 THEN 'none' ELSE ' ' || CAST(d.n_chars AS STRING) || ' ' END AS length
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
"""

_HEADINGS = (
    # (heading line, rule, body)
    ("# Model ", "1 = 1", "'Overview'"),
    ("## Intended Use", "doc_id % 4 <> 1", "text"),
    ("## Bias, Risks and Limitations", "doc_id % 5 < 3", "text"),
    ("### Training Data!", "doc_id % 3 <> 2", "text"),
    ("## Evaluation results", "doc_id % 7 < 5", "CASE WHEN doc_id % 7 = 2 THEN '[More Information Needed]' ELSE text END"),
    ("## Ethical Considerations", "doc_id % 6 < 4", "text"),
    ("## Privacy & GDPR", "doc_id % 4 < 3", "text"),
    ("## Security considerations", "doc_id % 5 <> 2", "text"),
    ("## Misuse and malicious use", "doc_id % 8 < 5", "CASE WHEN doc_id % 8 = 1 THEN 'TBD' ELSE text END"),
    ("## Limitations", "doc_id % 9 = 4", "'second mention of the limits of this model'"),
    ("## How to use", "doc_id % 10 < 3", "text"),
)

_PHRASES = (
    ("doc_id % 12 = 1", "This model is production ready for clinical teams."),
    ("doc_id % 13 = 2", "Fully open weights under a permissive license for banking."),
    ("doc_id % 14 = 3", "Trained on the dataset with random seed 7, learning rate of one tenth, accuracy reported."),
    ("doc_id % 15 = 4", "Not a source of legal advice."),
)


def _card_text() -> str:
    parts = []
    for heading, rule, body in _HEADINGS:
        title = f"'{heading}' || CAST(doc_id AS STRING)" if heading == "# Model " else f"'{heading}'"
        parts.append(f"CASE WHEN {rule} THEN {title} || chr(10) || {body} || chr(10) ELSE '' END")
    for rule, phrase in _PHRASES:
        parts.append(f"CASE WHEN {rule} THEN '{phrase}' || chr(10) ELSE '' END")
    return "'preamble' || chr(10) || " + " || ".join(parts)


_CARDS = f"""
SELECT doc_id AS card_id, source AS owner,
       CASE WHEN doc_id % 11 = 10 THEN '  ' ELSE {_card_text()} END AS card_text,
       CASE WHEN doc_id % 5 = 0 THEN 'apache-2.0' WHEN doc_id % 5 = 1 THEN 'cc-by-nc-4.0'
            WHEN doc_id % 5 = 2 THEN ' ' WHEN doc_id % 5 = 3 THEN 'Proprietary' ELSE NULL END AS license,
       CASE WHEN doc_id % 11 = 10 AND doc_id % 2 = 0 THEN NULL WHEN doc_id % 4 = 0 THEN md5(text)
            WHEN doc_id % 4 = 1 THEN 'main' WHEN doc_id % 4 = 2 THEN 'ABCDEF1' ELSE NULL END AS revision,
       CASE WHEN doc_id % 6 = 5 OR doc_id % 11 = 10 THEN ''
            WHEN doc_id % 6 = 0 THEN 'config.json;model.safetensors;README.md'
            WHEN doc_id % 6 = 1 THEN 'README.md;LICENSE.txt'
            WHEN doc_id % 6 = 2 THEN 'pytorch_model.bin;config.json'
            ELSE 'vocab.txt;README.md' END AS files,
       CASE WHEN doc_id % 6 = 5 OR doc_id % 9 = 8 THEN NULL
            WHEN doc_id % 6 = 0 THEN 'README.md;config.json;model.safetensors'
            WHEN doc_id % 6 = 1 THEN 'README.md'
            WHEN doc_id % 6 = 2 THEN 'config.json;pytorch_model.bin'
            ELSE 'vocab.txt;README.md;extra.bin' END AS live_files,
       CASE WHEN doc_id % 3 = 0 THEN 'sha256:' || upper(md5(text)) WHEN doc_id % 3 = 1 THEN md5(text || 'x')
            ELSE NULL END AS reference_hash,
       CASE WHEN doc_id % 8 <> 7 THEN md5(text) ELSE NULL END AS local_hash,
       CASE WHEN doc_id % 16 = 3 THEN './models/m' || CAST(doc_id AS STRING)
            ELSE source || '/m' || CAST(doc_id AS STRING) END AS model_ref,
       CASE WHEN doc_id % 6 = 2 THEN 'open-corpus' ELSE NULL END AS datasets_field
FROM documents
"""

_FILES = """
SELECT CAST(floor(doc_id / 5) AS BIGINT) AS set_id, content, name, expected_name,
       CASE WHEN expected_name IS NULL THEN NULL WHEN doc_id % 33 = 5 THEN content || 'x' ELSE content END AS expected_content,
       doc_id
FROM (
  SELECT doc_id, text AS content, name,
         CASE WHEN CAST(floor(doc_id / 5) AS BIGINT) % 7 = 3 THEN NULL
              WHEN name = 'vocab.txt' AND doc_id % 4 = 1 THEN NULL ELSE name END AS expected_name
  FROM (
    SELECT doc_id, text,
           CASE WHEN doc_id % 5 = 0 AND doc_id % 4 = 0 THEN 'weights-00001-of-00002.safetensors'
                WHEN doc_id % 5 = 0 AND doc_id % 9 = 1 THEN 'notes.txt'
                WHEN doc_id % 5 = 0 THEN 'model.safetensors'
                WHEN doc_id % 5 = 1 THEN 'config.json' WHEN doc_id % 5 = 2 THEN 'tokenizer.json'
                WHEN doc_id % 5 = 3 THEN 'vocab.txt' WHEN doc_id % 20 = 4 THEN 'model.safetensors.index.json'
                ELSE 'README.md' END AS name
    FROM documents
  ) a
) b
"""

_RUNS = """
SELECT o.o_orderkey AS run_id, 'M' || CAST(c.c_nationkey AS STRING) AS model,
       CAST(year(o.o_orderdate) AS BIGINT) AS seed,
       CASE WHEN o.o_orderpriority = '5-LOW' THEN 'det-check' ELSE 'seed-' || CAST(year(o.o_orderdate) AS STRING) END AS repeat,
       CASE WHEN o.o_orderstatus = 'F' THEN 'FINALIZED' WHEN o.o_orderstatus = 'O' THEN 'FAILED'
            ELSE 'AWAITING_REVIEW' END AS status,
       round(o.o_totalprice / 53000.0e0, 4) AS score,
       round((o.o_orderkey % 977) / 976.0e0, 4) AS confidence,
       round(1.0e0 + (o.o_orderkey % 389) / 10.0e0, 1) AS wall_s,
       CASE WHEN o.o_orderpriority = '1-URGENT' THEN 'no text classifier' ELSE '' END AS robustness_skip,
       CASE WHEN c.c_mktsegment = 'BUILDING' THEN 'no group column' ELSE NULL END AS fairness_skip,
       CAST(1 + o.o_orderkey % 9 AS INT) AS FAIRNESS_O, CAST(1 + o.o_orderkey % 8 AS INT) AS FAIRNESS_S,
       CAST(1 + o.o_orderkey % 7 AS INT) AS FAIRNESS_D,
       CAST(1 + o.o_orderkey % 6 AS INT) AS SAFETY_O, CAST(2 + o.o_orderkey % 5 AS INT) AS SAFETY_S,
       CAST(3 + o.o_orderkey % 4 AS INT) AS SAFETY_D, o.o_orderdate AS created_at
FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
"""

# one row per (evaluation, dimension) with the typed part of a probe result
_PROBES = """
SELECT o.o_orderkey AS evaluation_id, 'M' || CAST(o.o_custkey % 40 AS STRING) AS model, d.dimension AS dimension,
       d.dim_order AS dim_order,
       CASE WHEN (o.o_orderkey * 7 + d.dim_order * 5) % 13 = 0 THEN 'INSUFFICIENT_EVIDENCE'
            WHEN (o.o_orderkey * 7 + d.dim_order * 5) % 13 = 1 THEN 'NOT_APPLICABLE'
            WHEN (o.o_orderkey * 7 + d.dim_order * 5) % 13 = 2 THEN 'FAILED' ELSE 'EVALUATED' END AS probe_status,
       CASE WHEN (o.o_orderkey + d.dim_order) % 7 = 0 THEN 'mapping_blocked' WHEN (o.o_orderkey + d.dim_order) % 7 = 1 THEN 'not_scored'
            WHEN (o.o_orderkey + d.dim_order) % 7 = 2 AND d.dimension = 'ROBUSTNESS' THEN 'scored_risk'
            WHEN (o.o_orderkey + d.dim_order) % 7 = 2 THEN 'risk_detected' ELSE 'no_material_risk' END AS aspect_scoring,
       CASE WHEN d.dimension = 'FAIRNESS' AND o.o_orderkey % 10 <> 9 THEN round((o.o_orderkey % 400) / 1000.0e0, 4) END AS dpd,
       CASE WHEN d.dimension = 'FAIRNESS' AND o.o_orderkey % 10 <> 9 THEN round((o.o_orderkey % 300) / 1000.0e0, 4) END AS eod,
       CASE WHEN d.dimension = 'FAIRNESS' AND o.o_orderkey % 4 <> 0 THEN round((o.o_orderkey % 200) / 1000.0e0, 4) END AS excess_dpd,
       CASE WHEN d.dimension = 'FAIRNESS' THEN CAST(o.o_orderkey % 60 AS INT) END AS min_group_n_observed,
       CASE WHEN d.dimension = 'FAIRNESS' THEN 30 END AS min_group_n,
       CASE WHEN d.dimension = 'ROBUSTNESS' AND o.o_orderkey % 9 <> 8 THEN round(0.5e0 + (o.o_orderkey % 500) / 1000.0e0, 4) END AS clean_accuracy,
       CASE WHEN d.dimension = 'ROBUSTNESS' AND o.o_orderkey % 9 <> 8 THEN round(0.45e0 + (o.o_orderkey % 500) / 1000.0e0, 4) END AS robust_accuracy,
       CASE WHEN d.dimension = 'ROBUSTNESS' THEN CAST(o.o_orderkey % 320 AS INT) END AS n_evaluated,
       CASE WHEN d.dimension = 'INTEGRITY' THEN CAST(o.o_orderkey % 8 AS INT) END AS pass_count,
       CASE WHEN d.dimension = 'INTEGRITY' THEN CAST(o.o_orderkey % 3 AS INT) END AS fail_count,
       CASE WHEN d.dimension = 'INTEGRITY' AND o.o_orderkey % 15 = 0 THEN 'MISMATCH' WHEN d.dimension = 'INTEGRITY' THEN 'VERIFIED' END AS artifact_status,
       CASE WHEN d.dimension = 'INTEGRITY' AND o.o_orderkey % 5 = 0 THEN 'not_performed' WHEN d.dimension = 'INTEGRITY' THEN 'match' END AS hash_comparison,
       CASE WHEN d.dimension IN ('EXPLAINABILITY', 'SAFETY') THEN CAST((o.o_orderkey % 12) * 100 AS INT) END AS card_chars,
       CASE WHEN d.dimension = 'EXPLAINABILITY' THEN (o.o_orderkey % 6) / 5.0e0 WHEN d.dimension = 'SAFETY' THEN (o.o_orderkey % 5) / 4.0e0 END AS coverage_ratio,
       CASE WHEN d.dimension = 'SAFETY' AND o.o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS high_impact,
       CASE WHEN d.dimension = 'SAFETY' AND o.o_orderkey % 4 <> 1 THEN round((o.o_orderkey % 700) / 1000.0e0, 4) END AS severe_fnr,
       CASE WHEN d.dimension = 'SAFETY' AND o.o_orderkey % 4 <> 1 AND o.o_orderkey % 7 <> 3 THEN round(0.5e0 + (o.o_orderkey % 17) / 8.0e0, 4) END AS fnr_ratio,
       CASE WHEN d.dimension = 'SAFETY' AND o.o_orderkey % 4 <> 1 THEN round((o.o_orderkey % 45) / 100.0e0, 4) END AS benign_fpr,
       CASE WHEN d.dimension = 'SAFETY' AND o.o_orderkey % 4 <> 1 THEN 'EVALUATED' WHEN d.dimension = 'SAFETY' AND o.o_orderkey % 8 = 1 THEN 'FAILED'
            WHEN d.dimension = 'SAFETY' THEN 'NOT_APPLICABLE' END AS behavior_status,
       CASE WHEN o.o_orderkey % 6 <> 5 THEN round((o.o_orderkey % 50) / 100.0e0, 4) END AS ci_lower,
       CASE WHEN o.o_orderkey % 6 <> 5 THEN round((o.o_orderkey % 50) / 100.0e0 + (o.o_orderkey % 23) / 100.0e0 + 0.013e0, 4) END AS ci_upper,
       CASE WHEN o.o_orderkey % 21 = 0 THEN 0 ELSE 1 END AS has_evidence,
       CASE WHEN o.o_orderkey % 5 = 4 THEN NULL ELSE round((o.o_orderkey % 101) / 100.0e0, 4) END AS confidence,
       CASE WHEN o.o_orderkey % 18 = 0 THEN 'thin_groups_excluded;wide_ci' WHEN o.o_orderkey % 18 = 1 THEN 'metrics_skipped'
            WHEN o.o_orderkey % 18 = 2 THEN 'insufficient_slice_size' WHEN o.o_orderkey % 18 = 3 THEN 'attack_skipped'
            WHEN o.o_orderkey % 18 = 4 THEN 'domain_mismatch;needs_human_review' ELSE '' END AS flags,
       CASE WHEN (o.o_orderkey + d.dim_order) % 7 = 2 THEN d.dimension || '-RISK' ELSE '' END AS risks,
       CASE WHEN (o.o_orderkey + d.dim_order) % 11 = 0 THEN d.dimension || '-GATE' ELSE '' END AS failed_gates,
       CASE WHEN o.o_orderstatus = 'F' THEN 'current' WHEN o.o_orderstatus = 'O' THEN NULL ELSE 'legacy' END AS rule_version,
       o.o_orderdate AS created_at
FROM orders o CROSS JOIN (VALUES ('FAIRNESS', 1), ('ROBUSTNESS', 2), ('INTEGRITY', 3), ('EXPLAINABILITY', 4), ('SAFETY', 5)) AS d(dimension, dim_order)
"""

_EVENTS = """
SELECT event_id AS id, user_id AS evaluation_id, ts AS created_at,
       CASE WHEN event_type = 'signup' THEN 'created' WHEN event_type = 'view' THEN 'started'
            WHEN event_type = 'click' THEN 'probes_completed' WHEN event_type = 'purchase' THEN 'finalized'
            ELSE 'failed' END AS event_type
FROM events
"""

_RATINGS = """
SELECT item, rater, base,
       CASE WHEN pick % 3 = 0 THEN 'SUPPORTED' WHEN pick % 3 = 1 THEN 'NOT_SUPPORTED' ELSE 'UNCERTAIN' END AS verdict,
       CASE WHEN pick % 3 = 0 THEN 'YES' WHEN pick % 3 = 1 THEN 'NO' ELSE 'UNCERTAIN' END AS q1,
       CASE WHEN (pick + item) % 4 < 2 THEN 'YES' WHEN (pick + item) % 4 = 2 THEN 'NO' ELSE 'UNCERTAIN' END AS q2,
       CASE WHEN (pick + base) % 5 = 0 THEN 'FAIRNESS' WHEN (pick + base) % 5 = 1 THEN 'ROBUSTNESS'
            WHEN (pick + base) % 5 = 2 THEN 'INTEGRITY' WHEN (pick + base) % 5 = 3 THEN 'EXPLAINABILITY' ELSE 'SAFETY' END AS q3,
       CASE WHEN (item + rater_no) % 6 = 0 THEN 'n/a' ELSE CAST(1 + (base * 2 + pick) % 9 AS STRING) || ' of 9' END AS q4,
       why, submitted, rater_no
FROM (
  SELECT d.doc_id AS item, r.rater AS rater, r.rater_no AS rater_no, (d.doc_id * 7) % 3 AS base,
         CASE WHEN (d.doc_id * 13 + r.rater_no * 29) % 10 < 3 THEN (d.doc_id * 7) % 3 + r.rater_no ELSE (d.doc_id * 7) % 3 END AS pick,
         d.text AS why,
         CAST(r.rater_no * 1000 + d.doc_id AS BIGINT) AS submitted
  FROM documents d CROSS JOIN (VALUES ('R0', 1), ('R1', 2), ('R2', 3), ('R3', 4), ('R4', 5)) AS r(rater, rater_no)
) t
"""

_REVIEWS = """
SELECT packet_id, evaluator, risk_present, sufficient AS evidence_sufficient,
       CASE WHEN risk_present = 'YES' THEN dim WHEN risk_present = 'NO' THEN 'NONE' ELSE 'UNCERTAIN' END AS dimension,
       CASE WHEN risk_present = 'YES' OR k % 17 = 0 THEN CAST(1 + k % 10 AS INT) END AS severity,
       CASE WHEN k % 19 = 0 THEN ' ' ELSE 'because' END AS rationale, failure
FROM (
  SELECT 'P-' || CASE WHEN d.doc_id < 10 THEN '0' ELSE '' END || CAST(d.doc_id AS STRING) AS packet_id, e.evaluator AS evaluator,
         (d.doc_id * 11 + e.no * 7) AS k,
         CASE WHEN (d.doc_id * 3 + e.no * (d.doc_id % 3)) % 5 < 2 THEN 'YES' WHEN (d.doc_id * 3 + e.no * (d.doc_id % 3)) % 5 < 4 THEN 'NO'
              ELSE 'UNCERTAIN' END AS risk_present,
         CASE WHEN (d.doc_id + e.no * (d.doc_id % 2)) % 4 < 2 THEN 'YES' WHEN (d.doc_id + e.no * (d.doc_id % 2)) % 4 = 2 THEN 'NO' ELSE 'UNCERTAIN' END AS sufficient,
         CASE WHEN (d.doc_id + e.no * (d.doc_id % 4)) % 3 = 0 THEN 'INTEGRITY' WHEN (d.doc_id + e.no * (d.doc_id % 4)) % 3 = 1 THEN 'EXPLAINABILITY' ELSE 'SAFETY' END AS dim,
         CASE WHEN e.no = 3 AND d.doc_id % 14 = 0 THEN 'missing' WHEN e.no = 3 AND d.doc_id % 14 = 1 THEN 'unparsed' ELSE 'none' END AS failure
  FROM documents d CROSS JOIN (VALUES ('reference', 1), ('human', 2), ('external', 3)) AS e(evaluator, no)
) t
"""

_JUDGMENTS = """
SELECT packet_id, dimension, run_index, provider, fallback, parse_failures, output_truncated, superseded,
       CASE WHEN fallback = 0 THEN CAST(1 + (packet_id * 5 + dim_order * 2 + (run_index * packet_id) % 3) % 9 AS INT) END AS o,
       CASE WHEN fallback = 0 THEN CAST(1 + (packet_id * 3 + dim_order + (run_index * packet_id) % 2) % 9 AS INT) END AS s,
       CASE WHEN fallback = 0 THEN CAST(1 + (packet_id * 2 + dim_order) % 9 AS INT) END AS d,
       prompt_hash, elapsed_s
FROM (
  SELECT t.doc_id AS packet_id, m.dimension AS dimension, m.dim_order AS dim_order, r.run_index AS run_index,
         CASE WHEN (t.doc_id + r.run_index) % 3 = 0 THEN 'alpha' WHEN (t.doc_id + r.run_index) % 3 = 1 THEN 'beta' ELSE 'gamma' END AS provider,
         CASE WHEN (t.doc_id * 3 + r.run_index) % 8 = 0 OR t.doc_id % 25 = 3 THEN 1 ELSE 0 END AS fallback,
         CASE WHEN (t.doc_id * 3 + r.run_index) % 16 = 0 THEN 1 ELSE 0 END AS parse_failures,
         CASE WHEN (t.doc_id * 3 + r.run_index) % 24 = 8 THEN 1 ELSE 0 END AS output_truncated,
         CASE WHEN (t.doc_id + r.run_index) % 9 = 0 THEN 2 ELSE 0 END AS superseded,
         CASE WHEN t.doc_id % 50 = 7 AND r.run_index = 5 THEN md5(t.text || 'v2') ELSE md5(t.text) END AS prompt_hash,
         round(1.0e0 + (t.doc_id * r.run_index) % 40 / 10.0e0, 1) AS elapsed_s
  FROM documents t
  CROSS JOIN (VALUES ('INTEGRITY', 3), ('EXPLAINABILITY', 4), ('SAFETY', 5)) AS m(dimension, dim_order)
  CROSS JOIN (VALUES (1), (2), (3), (4), (5)) AS r(run_index)
) j
"""

# rated models: id2label as "index=name" pairs
_MODELS = """
SELECT o.o_orderkey AS model_id, 'repo' || CAST(o.o_orderkey AS STRING) AS model,
       CASE WHEN o.o_orderkey % 6 = 0 THEN '0=clean;1=Toxic' WHEN o.o_orderkey % 6 = 1 THEN '0=neutral;1=hate;2=offensive'
            WHEN o.o_orderkey % 6 = 2 THEN '0=obscene;1=hate_speech;2=insult' WHEN o.o_orderkey % 6 = 3 THEN '0=NEG;1=POS'
            WHEN o.o_orderkey % 6 = 4 THEN '0=abusive;1=fine' ELSE '0=a;1=b;2=TOXICITY' END AS labels,
       CASE WHEN o.o_orderkey % 6 = 0 THEN '0=clean;1=toxic' WHEN o.o_orderkey % 9 = 1 THEN '0=neutral;1=offensive;2=hate'
            WHEN o.o_orderkey % 6 = 2 THEN '0=obscene;1=hate_speech' WHEN o.o_orderkey % 6 = 3 THEN '0=NEG;1=POS'
            WHEN o.o_orderkey % 6 = 4 THEN '0=abusive;1=fine' ELSE '0=a;1=b;2=TOXICITY' END AS loaded_labels,
       CASE WHEN o.o_orderkey % 4 = 2 OR o.o_orderkey % 6 = 2 THEN 'multi_label_classification' ELSE 'single_label_classification' END AS problem_type,
       CASE WHEN o.o_orderkey % 7 = 0 THEN NULL WHEN o.o_orderkey % 7 < 3 THEN CAST(o.o_orderkey % 3 AS INT) WHEN o.o_orderkey % 7 = 3 THEN 9 ELSE NULL END AS target_index,
       CASE WHEN o.o_orderkey % 8 = 0 THEN 'ru' WHEN o.o_orderkey % 8 < 4 THEN 'en;de' ELSE '' END AS languages,
       CASE WHEN o.o_orderkey % 5 = 0 THEN 'model.onnx' WHEN o.o_orderkey % 5 < 3 THEN 'config.json;model.safetensors' ELSE 'pytorch_model.bin' END AS files,
       CASE WHEN o.o_orderkey % 10 = 9 THEN 'BertModel' ELSE 'BertForSequenceClassification' END AS architecture,
       CASE WHEN o.o_orderkey % 12 = 5 THEN 0 ELSE 1 END AS configured,
       CASE WHEN o.o_orderkey % 12 = 7 THEN 0 ELSE 1 END AS confirmed,
       'rev' || CAST(o.o_orderkey % 20 AS STRING) AS draft_revision,
       CASE WHEN o.o_orderkey % 11 = 3 THEN 'rev_new' ELSE 'rev' || CAST(o.o_orderkey % 20 AS STRING) END AS current_revision,
       o.o_custkey AS owner_id, o.o_orderdate AS created_at
FROM orders o
"""

def _exact(sql: str) -> str:
    """``round(x, n)`` as a floor: the engines break ties of round() differently, floor() and division agree."""
    while (at := sql.find("round(")) >= 0:
        depth, i = 1, at + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[i], 0)
            i += 1
        x, n = sql[at + 6 : i - 1].rsplit(",", 1)
        unit = f"1{'0' * int(n)}e0"
        sql = f"{sql[:at]}(CAST(floor(({x}) * {unit} + 0.5e0) AS DOUBLE) / {unit}){sql[i:]}"
    return sql


VIEWS: dict[str, tuple[str, str]] = {
    "v_pred_big": (_PRED_BIG, "lineitem supplier"),
    "v_pred_text": (_PRED_TEXT, "labels documents"),
    "v_raw": (_RAW, "documents labels"),
    "v_cards": (_CARDS, "documents"),
    "v_files": (_FILES, "documents"),
    "v_runs": (_RUNS, "orders customer"),
    "v_probes": (_PROBES, "orders"),
    "v_events": (_EVENTS, "events"),
    "v_ratings": (_RATINGS, "documents"),
    "v_reviews": (_REVIEWS, "documents"),
    "v_judgments": (_JUDGMENTS, "documents"),
    "v_models": (_MODELS, "orders"),
}
VIEWS = {name: (_exact(sql), tables) for name, (sql, tables) in VIEWS.items()}


def with_clause(views: tuple[str, ...], sql: str) -> str:
    """``sql`` preceded by the CTEs of ``views``; it may itself continue the list with ', x AS (…)'."""
    if not views:
        return sql
    ctes = ", ".join(f"{v} AS ({VIEWS[v][0]})" for v in views)
    body = sql.strip()
    joiner = "" if body.startswith(",") else " "
    return f"WITH {ctes}{joiner}{body}"
