"""Rater agreement (AGR)."""

from pyspark.sql import functions as F

from ..operators import agreement as A
from ..sources.registry import reconcile_buckets
from .base import query
from .generate import hash_sql
from .ratings import V4_SQL, typed

ITEM = ["item"]
# every document belongs to one study; agreement is computed per study
_RT = """, rt AS (SELECT r.*, CASE WHEN q2 = 'YES' THEN TRY_CAST(nullif(regexp_extract(q4, '^([0-9])', 1), '') AS INT) END AS sev, TRY_CAST(nullif(regexp_extract(q4, '^([0-9])', 1), '') AS INT) AS raw_sev, d.lang AS study, d.source AS source FROM v_ratings r JOIN documents d ON d.doc_id = r.item)"""


def ratings(v):
    sev = A.leading_digit(F.col("q4"))
    return v("v_ratings").withColumn("raw_sev", sev).withColumn("sev", F.when(F.col("q2") == "YES", F.col("raw_sev"))).join(
        v("documents").select(F.col("doc_id").alias("item"), F.col("lang").alias("study"), "source"), "item")


@query("agr_01_melt", """, s AS (SELECT item, CASE WHEN rater_no <= 2 THEN 'R0' ELSE rater END AS rater, submitted, q1, q2, q4 FROM v_ratings), n AS (SELECT *, CASE WHEN rater = 'R0' THEN rater || '-' || row_number() OVER (PARTITION BY item, rater ORDER BY submitted) ELSE rater END AS rid FROM s)
SELECT item, rid AS rater, u.question, upper(CASE u.question WHEN 'q1' THEN q1 WHEN 'q2' THEN q2 ELSE q4 END) AS answer FROM n CROSS JOIN (VALUES ('q1'), ('q2'), ('q4')) AS u(question)""", ("v_ratings",))
def _(v):
    form = v("v_ratings").withColumn("rater", F.when(F.col("rater_no") <= 2, "R0").otherwise(F.col("rater")))
    return A.melt_form(form, ITEM, ["q1", "q2", "q4"], "rater", "submitted", "R0")


def plurality_sql(src: str, item: str, value: str, p: str) -> str:
    return f""", {p}c AS (SELECT {item}, {value} AS category, count(*) AS c FROM {src} WHERE {value} IS NOT NULL GROUP BY ALL),
 {p}t AS (SELECT *, max(c) OVER (PARTITION BY {item}) AS top_n, sum(c) OVER (PARTITION BY {item}) AS n FROM {p}c),
 {p} AS (SELECT {item}, CASE WHEN count(*) = 1 THEN min(category) ELSE 'TIE(' || string_agg(category, '/' ORDER BY category) || ')' END AS majority, min(top_n) AS top_n, min(n)::BIGINT AS n FROM {p}t WHERE c = top_n GROUP BY {item})"""


@query("agr_02_plurality", plurality_sql("v_ratings", "item", "q1", "pl") + " SELECT * FROM pl", ("v_ratings",))
def _(v):
    return A.plurality(v("v_ratings"), ITEM, "q1")


@query("agr_03_pair_agreement", """, p AS (SELECT a.item, count(*) AS pairs, count(*) FILTER (WHERE a.q1 = b.q1) AS same FROM v_ratings a JOIN v_ratings b ON a.item = b.item AND a.rater < b.rater GROUP BY 1)
SELECT item, 5::BIGINT AS m, round(same::DOUBLE / pairs, 6) AS agreement, same = pairs AS unanimous FROM p""", ("v_ratings",))
def _(v):
    return A.pair_agree(v("v_ratings"), ITEM, "q1")


_FLEISS = _RT + """, c AS (SELECT study, item, q1 AS cat, count(*) AS c FROM rt GROUP BY ALL), i AS (SELECT study, item, sum(c) AS k, sum(c * c) AS sq FROM c GROUP BY 1, 2), p AS (SELECT study, count(*) AS n_items, max(k)::BIGINT AS n_raters, avg((sq - k) / (k * (k - 1))) AS pbar FROM i GROUP BY 1),
 s AS (SELECT study, cat, sum(c)::DOUBLE AS c FROM c GROUP BY 1, 2), e AS (SELECT study, sum(c * c) / (sum(c) * sum(c)) AS pe FROM s GROUP BY 1)
SELECT study, n_items, n_raters, round(CASE WHEN n_items >= 8 THEN (pbar - pe) / (1 - pe) END, 6) AS kappa FROM p JOIN e USING (study)"""


@query("agr_04_fleiss", _FLEISS, ("v_ratings",))
def _(v):
    return A.fleiss(ratings(v), ["study"], ITEM, "q1", 8)




@query("agr_05_cohen", _RT + """, pa AS (SELECT a.study, a.rater AS rater_a, b.rater AS rater_b, a.q2 AS a, b.q2 AS b FROM rt a JOIN rt b ON a.item = b.item AND a.rater < b.rater),
 n AS (SELECT study, rater_a, rater_b, count(*) AS n, avg((a = b)::INT) AS po FROM pa GROUP BY 1, 2, 3), ma AS (SELECT study, rater_a, rater_b, a AS cat, count(*) AS x FROM pa GROUP BY 1, 2, 3, 4),
 mb AS (SELECT study, rater_a, rater_b, b AS cat, count(*) AS y FROM pa GROUP BY 1, 2, 3, 4), e AS (SELECT study, rater_a, rater_b, sum(x * y)::DOUBLE AS e FROM ma JOIN mb USING (study, rater_a, rater_b, cat) GROUP BY 1, 2, 3)
SELECT study, rater_a, rater_b, n, CASE WHEN n >= 8 THEN round((po - e / (n * n)) / (1 - e / (n * n)), 4) END AS kappa FROM n JOIN e USING (study, rater_a, rater_b)""", ("v_ratings",))
def _(v):
    return A.cohen(A.rater_pairs(ratings(v), ["study"], ITEM, "rater", "q2"), ["study", "rater_a", "rater_b"], "a", "b")


@query("agr_06_kripp_interval", _RT + """, u AS (SELECT study, item, count(sev) AS m FROM rt GROUP BY 1, 2 HAVING count(sev) >= 2), v AS (SELECT rt.study, rt.item, rater, sev::DOUBLE AS x, m FROM rt JOIN u ON u.item = rt.item WHERE sev IS NOT NULL),
 w AS (SELECT a.study, sum((a.x - b.x) * (a.x - b.x) / (a.m - 1)) AS d FROM v a JOIN v b ON a.item = b.item AND a.rater <> b.rater GROUP BY 1), t AS (SELECT study, count(*) AS n, count(DISTINCT item) AS units, sum(x) AS s, sum(x * x) AS q FROM v GROUP BY 1)
SELECT study, units, n, round(1 - (d / n) / (2 * (n * q - s * s) / (n * (n - 1.0::DOUBLE))), 6) AS alpha FROM t JOIN w USING (study)""", ("v_ratings",))
def _(v):
    return A.kripp_interval(ratings(v), ["study"], ITEM, "sev")


@query("agr_07_closeness", _RT + """, p AS (SELECT a.study, abs(a.sev - b.sev) AS g FROM rt a JOIN rt b ON a.item = b.item AND a.rater < b.rater WHERE a.sev IS NOT NULL AND b.sev IS NOT NULL)
SELECT study, count(*) AS n_pairs, round(avg((g = 0)::INT), 6) AS exact, round(avg((g <= 1)::INT), 6) AS within1, round(avg((g <= 2)::INT), 6) AS within2 FROM p GROUP BY 1""", ("v_ratings",))
def _(v):
    return A.closeness(ratings(v), ["study"], ITEM, "sev")


@query("agr_07_value_range", _RT + " SELECT item, min(sev) AS low, max(sev) AS high FROM rt WHERE sev IS NOT NULL GROUP BY 1", ("v_ratings",))
def _(v):
    return A.value_range(ratings(v), ITEM, "sev")


@query("agr_08_contradictions", _RT + """ SELECT item, rater, CASE WHEN q2 = 'YES' AND raw_sev IS NULL THEN 'risk_without_severity' WHEN q2 <> 'YES' AND raw_sev IS NOT NULL THEN 'severity_without_risk' END AS contradiction FROM rt""", ("v_ratings",))
def _(v):
    return ratings(v).select("item", "rater", A.contradictions(F.col("q2"), F.col("raw_sev")).alias("contradiction"))


@query("agr_08_rater_qc", _RT + """ SELECT rater, count(*) AS n, median(length(why))::DOUBLE AS median_chars, count(*) FILTER (WHERE length(why) <= 10) AS short_answers, count(*) FILTER (WHERE (q2 = 'YES' AND raw_sev IS NULL) OR (q2 <> 'YES' AND raw_sev IS NOT NULL)) AS contradictions,
 count(*) FILTER (WHERE q3 = 'SAFETY') AS matches FROM rt GROUP BY 1""", ("v_ratings",))
def _(v):
    return A.rater_qc(ratings(v), "rater", "why", A.contradictions(F.col("q2"), F.col("raw_sev")), F.col("q3") == "SAFETY")


_REF = """, rf AS (SELECT doc_id AS item, CASE WHEN doc_id % 5 = 0 THEN 'NO' ELSE 'YES' END AS rs, CASE WHEN doc_id % 3 = 0 THEN 'YES' WHEN doc_id % 3 = 1 THEN 'NO' ELSE 'UNCERTAIN' END AS rr, CASE WHEN doc_id % 2 = 0 THEN 'SAFETY' ELSE 'FAIRNESS' END AS rd, (1 + doc_id % 9)::INT AS rv FROM documents)"""


@query("agr_09_vs_reference", _RT + plurality_sql("rt", "item", "q1", "p1") + plurality_sql("rt", "item", "q2", "p2") + plurality_sql("rt", "item", "q3", "p3") + _REF + """,
 j AS (SELECT p1.item, p1.majority AS q1, p2.majority AS q2, p3.majority AS q3, rf.*, CASE WHEN p2.majority = 'YES' THEN md END AS md0, k FROM p1 JOIN p2 USING (item) JOIN p3 USING (item) JOIN rf USING (item) JOIN (SELECT item, count(sev) AS k, median(sev) AS md FROM rt GROUP BY 1) s USING (item)),
 m AS (SELECT *, CASE WHEN k >= 3 THEN (SELECT median(sev) FROM rt WHERE rt.item = j.item) END AS med FROM j)
SELECT item, q1, q2, q3, med AS median_severity, concat_ws('|', CASE WHEN q1 <> rs OR (q2 = 'UNCERTAIN') <> (rr = 'UNCERTAIN') THEN 'insufficient_evidence' END, CASE WHEN (q2 = 'YES' AND rr = 'NO') OR (q2 = 'NO' AND rr = 'YES') THEN 'risk_no_risk' END,
 CASE WHEN q2 = 'YES' AND rr = 'YES' AND q3 <> rd THEN 'classification' END, CASE WHEN q2 = 'YES' AND rr = 'YES' AND abs(med - rv) >= 2 THEN 'severity' END) AS disagreements FROM m""", ("v_ratings",))
def _(v):
    d = F.col("doc_id")
    ref = v("documents").select(
        d.alias("item"), F.when(d % 5 == 0, "NO").otherwise("YES").alias("ref_sufficient"), F.when(d % 3 == 0, "YES").when(d % 3 == 1, "NO").otherwise("UNCERTAIN").alias("ref_risk"),
        F.when(d % 2 == 0, "SAFETY").otherwise("FAIRNESS").alias("ref_dimension"), (1 + d % 9).cast("int").alias("ref_severity"))
    return A.vs_reference(ratings(v).withColumn("severity", F.col("sev")), ref, ITEM)


@query("agr_10_leave_one_out", plurality_sql("v_ratings", "item", "q2", "pl") + """, lo AS (SELECT r.item, r.rater || '@' || r.item AS k, o.q2 FROM v_ratings r JOIN v_ratings o ON o.item = r.item AND o.rater <> r.rater)""" + plurality_sql("lo", "k", "q2", "lp") + """,
 ch AS (SELECT split_part(k, '@', 2)::BIGINT AS item, majority FROM lp) SELECT pl.item, pl.majority, bool_or(ch.majority <> pl.majority) AS unstable FROM pl JOIN ch USING (item) GROUP BY 1, 2""", ("v_ratings",))
def _(v):
    return A.leave_one_out(v("v_ratings"), ITEM, "rater", "q2")


@query("agr_11_themes", """SELECT role, count(*) FILTER (WHERE regexp_matches(text, '[0-9]+')) AS numbers_texts, sum(len(regexp_extract_all(text, '[0-9]+')))::BIGINT AS numbers_matches, count(*) FILTER (WHERE regexp_matches(text, '\\b[Tt]he\\b')) AS article_texts,
 sum(len(regexp_extract_all(text, '\\b[Tt]he\\b')))::BIGINT AS article_matches FROM conversations GROUP BY 1""")
def _(v):
    return A.themes(v("conversations"), ["role"], "text", {"numbers": "[0-9]+", "article": r"\b[Tt]he\b"})


_DIMS = ["FAIRNESS", "ROBUSTNESS", "INTEGRITY", "EXPLAINABILITY", "SAFETY", "NONE", "UNCERTAIN"]


@query("agr_12_validate_reviews", """, e AS (SELECT packet_id, evaluator, concat_ws('|', CASE WHEN NOT regexp_matches(packet_id, '^P-[0-9]{2}$') THEN 'packet_id' END, CASE WHEN severity < 1 OR severity > 9 THEN 'severity_range' END, CASE WHEN risk_present = 'NO' AND severity IS NOT NULL THEN 'severity_without_risk' END,
 CASE WHEN trim(rationale) = '' THEN 'rationale' END) AS errors FROM v_reviews) SELECT * FROM e WHERE errors <> ''""", ("v_reviews",))
def _(v):
    return A.validate_reviews(v("v_reviews"), "^P-[0-9]{2}$", _DIMS).select("packet_id", "evaluator", "errors")


_PAIRS = """, pq AS (SELECT a.packet_id, a.evaluator AS a_evaluator, b.evaluator AS b_evaluator, a.risk_present AS ra, b.risk_present AS rb, a.dimension AS da, b.dimension AS db, a.evidence_sufficient AS sa, b.evidence_sufficient AS sb, a.severity AS va, b.severity AS vb, a.failure AS af, b.failure AS bf
  FROM v_reviews a JOIN v_reviews b ON a.packet_id = b.packet_id AND a.evaluator < b.evaluator),
 pc AS (SELECT *, (ra = 'UNCERTAIN') <> (rb = 'UNCERTAIN') AS abst, sa <> sb AND (sa = 'NO' OR sb = 'NO') AS suff, ra = 'YES' AND rb = 'YES' AND da <> db AS odim, coalesce(abs(va - vb) >= 2, false) AS sv FROM pq),
 ca AS (SELECT *, CASE WHEN bf = 'missing' THEN 'provider_infrastructure' WHEN bf = 'unparsed' THEN 'parser_format' WHEN abst THEN 'abstention_mismatch' WHEN suff THEN 'insufficient_evidence' WHEN odim THEN 'localization' WHEN ra <> rb THEN 'evidence_interpretation' WHEN sv THEN 'severity' ELSE 'agree' END AS category,
  CASE WHEN bf <> 'none' THEN NULL WHEN abst OR suff THEN 'evidence' WHEN ra <> rb OR odim THEN 'risk' WHEN sv THEN 'score' END AS layer FROM pc)"""


@query("agr_13_categorize", _PAIRS + " SELECT packet_id, a_evaluator, b_evaluator, category, layer FROM ca", ("v_reviews",))
def _(v):
    return A.categorize(A.evaluator_pairs(v("v_reviews"))).select("packet_id", "a_evaluator", "b_evaluator", "category", "layer")


@query("agr_14_pair_summary", _PAIRS + """, g AS (SELECT *, af = 'none' AND bf = 'none' AS good FROM ca), k0 AS (SELECT a_evaluator, b_evaluator, ra, rb FROM g WHERE good), kn AS (SELECT a_evaluator, b_evaluator, count(*) AS n, avg((ra = rb)::INT) AS po FROM k0 GROUP BY 1, 2),
 ke AS (SELECT x.a_evaluator, x.b_evaluator, sum(x.c * y.c)::DOUBLE AS e FROM (SELECT a_evaluator, b_evaluator, ra AS cat, count(*) AS c FROM k0 GROUP BY ALL) x JOIN (SELECT a_evaluator, b_evaluator, rb AS cat, count(*) AS c FROM k0 GROUP BY ALL) y USING (a_evaluator, b_evaluator, cat) GROUP BY 1, 2),
 st AS (SELECT a_evaluator, b_evaluator, count(*) FILTER (WHERE good) AS n_common, round(avg((ra = rb)::INT) FILTER (WHERE good), 4) AS risk_agreement, round(avg((da = db)::INT) FILTER (WHERE good), 4) AS dimension_agreement, round(avg((sa = sb)::INT) FILTER (WHERE good), 4) AS sufficiency_agreement,
  count(*) FILTER (WHERE good AND va IS NOT NULL AND vb IS NOT NULL) AS n_severity_pairs, round(avg((va = vb)::INT) FILTER (WHERE good AND va IS NOT NULL AND vb IS NOT NULL), 4) AS severity_exact, round(avg((abs(va - vb) <= 1)::INT) FILTER (WHERE good AND va IS NOT NULL AND vb IS NOT NULL), 4) AS severity_within_1,
  count(*) FILTER (WHERE category = 'agree') AS n_agree FROM g GROUP BY 1, 2)
SELECT st.*, round((po - e / (n * n)) / (1 - e / (n * n)), 4) AS risk_kappa FROM st LEFT JOIN kn USING (a_evaluator, b_evaluator) LEFT JOIN ke USING (a_evaluator, b_evaluator)""", ("v_reviews",))
def _(v):
    return A.pair_summary(v("v_reviews"))


@query("agr_15_verdicts", plurality_sql("v_ratings", "item", "verdict", "pl") + " SELECT item, majority, n, top_n < n AS split, majority = 'SUPPORTED' AS supported FROM pl", ("v_ratings",))
def _(v):
    return A.verdicts(v("v_ratings"), "item")


@query("agr_15_verdict_summary", plurality_sql("v_ratings", "item", "verdict", "pl") + """ SELECT count(*) AS n_findings, round(avg((majority = 'SUPPORTED')::INT), 6) AS supported_rate, count(*) FILTER (WHERE majority = 'NOT_SUPPORTED') AS n_not_supported, count(*) FILTER (WHERE top_n < n) AS n_split FROM pl""", ("v_ratings",))
def _(v):
    return A.verdict_summary(A.verdicts(v("v_ratings"), "item"))


@query("agr_15_blind", f"""SELECT model, printf('Model %02d', row_number() OVER (ORDER BY {hash_sql('17', 'model')}, model)) AS code FROM (SELECT DISTINCT model FROM v_models)""", ("v_models",))
def _(v):
    return A.blind(v("v_models"), "model", 17)


_MODAL = """, md0 AS (SELECT packet_id, dimension, count(*) FILTER (WHERE fallback = 0) AS valid_runs, count(*) FILTER (WHERE fallback <> 0) AS fallbacks, sum(parse_failures)::BIGINT AS parse_failures, sum(output_truncated)::BIGINT AS output_truncated,
  count(*) FILTER (WHERE o <= 5) AS yes, count(*) FILTER (WHERE o > 5) AS no, count(DISTINCT o * 100 + s * 10 + d) AS distinct_triples, """ + ", ".join(
    f"quantile_disc({c}, 0.5) AS {c}, max({c}) - min({c}) AS {c}_range, round(stddev_pop({c}), 4) AS {c}_sd" for c in "osd") + """ FROM {src} GROUP BY 1, 2),
 mdl AS (SELECT *, CASE WHEN valid_runs = 0 THEN NULL WHEN yes = no THEN 'UNCERTAIN' WHEN yes > no THEN 'YES' ELSE 'NO' END AS risk_present, greatest(yes, no)::DOUBLE / nullif(valid_runs, 0) AS risk_agreement FROM md0)"""
_MODAL_COLS = "packet_id, dimension, valid_runs, fallbacks, parse_failures, output_truncated, distinct_triples, o, o_range, o_sd, s, s_range, s_sd, d, d_range, d_sd, risk_present, round(risk_agreement, 6) AS risk_agreement"


@query("agr_16_modal", _MODAL.format(src="v_judgments") + f" SELECT {_MODAL_COLS} FROM mdl", ("v_judgments",))
def _(v):
    return A.modal(v("v_judgments"), ["packet_id", "dimension"])


# the deterministic side of the comparison: ratings of the evaluation with the packet's number
_BASE = """, bs AS (SELECT evaluation_id AS packet_id, dimension, "O" AS bo, "S" AS bs, "D" AS bd, CASE WHEN "O" IS NULL THEN 'UNCERTAIN' WHEN aspect_scoring = 'risk_detected' OR risks <> '' THEN 'YES' ELSE 'NO' END AS br
  FROM v4 JOIN (SELECT evaluation_id, dimension, aspect_scoring, risks FROM v_probes) USING (evaluation_id, dimension) WHERE dimension IN ('INTEGRITY', 'EXPLAINABILITY', 'SAFETY'))"""
_CMP = """, jn AS (SELECT bs.packet_id, bs.dimension, br, bo, bs.bs AS bsv, bd, m.risk_present AS orr, m.o, m.s, m.d, m.parse_failures, m.valid_runs FROM bs JOIN mdl m ON m.packet_id = bs.packet_id AND m.dimension = bs.dimension),
 cp AS (SELECT j.packet_id, j.dimension, br AS base_risk, orr AS other_risk, CASE WHEN orr IS NULL AND parse_failures > 0 THEN 'parser_format_failure' WHEN orr IS NULL THEN 'truncation_fallback' WHEN (br = 'UNCERTAIN') <> (orr = 'UNCERTAIN') THEN 'insufficient_evidence'
   WHEN br = 'NO' AND orr = 'YES' AND EXISTS (SELECT 1 FROM jn x WHERE x.packet_id = j.packet_id AND x.dimension <> j.dimension AND x.br = 'YES' AND x.orr IS DISTINCT FROM 'YES') THEN 'localization'
   WHEN br = 'YES' AND orr = 'NO' AND EXISTS (SELECT 1 FROM jn x WHERE x.packet_id = j.packet_id AND x.dimension <> j.dimension AND x.orr = 'YES' AND x.br <> 'YES') THEN 'localization'
   WHEN br <> orr THEN 'evidence_interpretation' WHEN coalesce(abs(bsv - s) >= 2, false) THEN 'severity' ELSE 'agree' END AS category, abs(bo - o) AS o_diff, abs(bsv - s) AS s_diff, abs(bd - d) AS d_diff, bo = o AND bsv = s AND bd = d AS triple_match FROM jn j)"""
_CMP_ALL = V4_SQL + _MODAL.format(src="v_judgments") + _BASE + _CMP


def _base(v):
    from ..operators import ratings as S

    p = typed(v).filter(F.col("dimension").isin("INTEGRITY", "EXPLAINABILITY", "SAFETY"))
    risky = (F.col("aspect_scoring") == "risk_detected") | (F.size("risks") > 0)
    return S.bands_v4(p).select(
        F.col("evaluation_id").alias("packet_id"), "dimension", F.when(F.col("O").isNull(), "UNCERTAIN").when(risky, "YES").otherwise("NO").alias("risk_present"),
        F.col("O").alias("o"), F.col("S").alias("s"), F.col("D").alias("d"))


def _modal(v):
    return A.modal(v("v_judgments"), ["packet_id", "dimension"])


@query("agr_17_compare_evaluators", _CMP_ALL + " SELECT * FROM cp", ("v_probes", "v_judgments"))
def _(v):
    return A.compare_evaluators(_base(v), _modal(v), ["packet_id"])


_SUMMARY = """ count(*) AS pairs, count(other_risk) AS answered, round(avg((base_risk = other_risk)::INT) FILTER (WHERE other_risk IS NOT NULL), 4) AS status_agreement, count(*) FILTER (WHERE other_risk <> 'UNCERTAIN' AND base_risk <> 'UNCERTAIN') AS definite,
 round(avg((base_risk = other_risk)::INT) FILTER (WHERE other_risk <> 'UNCERTAIN' AND base_risk <> 'UNCERTAIN'), 4) AS definite_agreement, round(avg((s_diff = 0)::INT), 4) AS severity_exact, round(avg((s_diff <= 1)::INT), 4) AS severity_within_1, round(avg(o_diff), 4) AS o_mae, round(avg(s_diff), 4) AS s_mae, round(avg(d_diff), 4) AS d_mae,
 round(avg(triple_match::INT), 4) AS triple_exact"""


@query("agr_17_comparison_summary", _CMP_ALL + f" SELECT dimension, {_SUMMARY} FROM cp GROUP BY 1", ("v_probes", "v_judgments"))
def _(v):
    return A.comparison_summary(A.compare_evaluators(_base(v), _modal(v), ["packet_id"]), ["dimension"])


@query("agr_17_localization", _CMP_ALL + """ SELECT packet_id, count(*) FILTER (WHERE br = 'YES' AND orr = 'YES') = count(*) FILTER (WHERE br = 'YES' OR orr = 'YES') AS exact,
 round(coalesce(count(*) FILTER (WHERE br = 'YES' AND orr = 'YES')::DOUBLE / nullif(count(*) FILTER (WHERE br = 'YES' OR orr = 'YES'), 0), 1), 4) AS jaccard FROM jn GROUP BY 1 HAVING count(orr) = count(*)""", ("v_probes", "v_judgments"))
def _(v):
    return A.localization_overlap(_base(v), _modal(v), ["packet_id"])


@query("agr_17_provider_means", """SELECT dimension, provider, count(*) AS n, round(avg(o), 4) AS o_mean, round(avg(s), 4) AS s_mean, round(avg(d), 4) AS d_mean FROM v_judgments WHERE fallback = 0 GROUP BY 1, 2""", ("v_judgments",))
def _(v):
    return A.provider_means(v("v_judgments"))


_ATT = """, att AS (SELECT packet_id, run_index, dimension, provider, elapsed_s, fallback = 0 AS parsed, CASE WHEN output_truncated = 1 THEN 'TruncatedError: length' WHEN fallback = 1 AND parse_failures = 0 THEN 'HTTPError: 503' END AS error FROM v_judgments)"""


def _attempts(v):
    return v("v_judgments").select(
        "packet_id", "run_index", "dimension", "provider", "elapsed_s", (F.col("fallback") == 0).alias("parsed"),
        F.when(F.col("output_truncated") == 1, "TruncatedError: length").when((F.col("fallback") == 1) & (F.col("parse_failures") == 0), "HTTPError: 503").alias("error"))


@query("agr_18_attempt_stats", _ATT + " SELECT provider, coalesce(split_part(error, ':', 1), 'ok') AS outcome, count(*) AS n, round(avg(elapsed_s), 6) AS mean_s FROM att GROUP BY 1, 2", ("v_judgments",))
def _(v):
    return A.attempt_stats(_attempts(v))


@query("agr_18_run_failures", _ATT + """ SELECT packet_id, run_index, count(*) AS attempts, CASE WHEN bool_or(parsed) THEN 'answered' WHEN NOT bool_or(error IS NULL) AND NOT bool_or(coalesce(error LIKE 'Truncated%', false)) THEN 'provider_unavailable'
 WHEN bool_or(coalesce(error LIKE 'Truncated%', false)) AND NOT bool_or(error IS NULL) THEN 'truncated' ELSE 'parse_failure' END AS outcome FROM att GROUP BY 1, 2""", ("v_judgments",))
def _(v):
    return A.run_failures(_attempts(v), ["packet_id", "run_index"])


@query("agr_19_stratify", """, st AS (SELECT j.* REPLACE (CASE WHEN s.name = 'all' OR (s.name = 'first_two' AND run_index <= 2) OR s.name = provider THEN fallback ELSE 1 END AS fallback), s.name AS stratum FROM v_judgments j CROSS JOIN (VALUES ('all'), ('first_two'), ('alpha')) AS s(name))
SELECT stratum, dimension, count(*) FILTER (WHERE fallback = 0) AS valid_runs, count(*) FILTER (WHERE fallback = 1) AS fallbacks FROM st GROUP BY 1, 2""", ("v_judgments",))
def _(v):
    s = A.stratify(v("v_judgments"), {"all": F.lit(True), "first_two": F.col("run_index") <= 2, "alpha": F.col("provider") == "alpha"})
    return s.groupBy("stratum", "dimension").agg(F.count_if(F.col("fallback") == 0).alias("valid_runs"), F.count_if(F.col("fallback") == 1).alias("fallbacks"))


@query("agr_19_completion", """, pl AS (SELECT DISTINCT packet_id, run_index FROM v_judgments), ok AS (SELECT DISTINCT packet_id, run_index FROM v_judgments WHERE fallback = 0), fr AS (SELECT DISTINCT packet_id, run_index FROM ok WHERE run_index <= 2),
 ph AS (SELECT packet_id, count(DISTINCT prompt_hash) AS p FROM v_judgments WHERE fallback = 0 GROUP BY 1)
SELECT (SELECT count(*) FROM pl) AS planned_runs, (SELECT count(*) FROM ok) AS valid_runs, (SELECT count(*) FROM ok WHERE run_index > 2) AS recovered_runs, (SELECT count(*) FROM pl) - (SELECT count(*) FROM ok) AS unresolved_runs, (SELECT count(*) FROM ph WHERE p > 1) AS packets_with_several_prompts""", ("v_judgments",))
def _(v):
    j, key = v("v_judgments"), ["packet_id", "run_index"]
    return A.completion(j, j.select(*key).distinct(), j.filter("fallback = 0 and run_index <= 2").select(*key).distinct(), key, "packet_id")


@query("agr_21_reference_answer", """, a AS (SELECT *, CASE WHEN probe_status = 'INSUFFICIENT_EVIDENCE' OR aspect_scoring = 'not_scored' THEN 'NO' WHEN aspect_scoring = 'mapping_blocked' OR failed_gates <> '' THEN 'UNCERTAIN' ELSE 'YES' END AS evidence_sufficient FROM v_probes),
 b AS (SELECT *, CASE WHEN risks <> '' OR aspect_scoring IN ('risk_detected', 'scored_risk') THEN 'YES' WHEN evidence_sufficient = 'YES' THEN 'NO' ELSE 'UNCERTAIN' END AS risk_present FROM a)
SELECT evaluation_id, dimension, evidence_sufficient, risk_present, CASE risk_present WHEN 'YES' THEN dimension WHEN 'NO' THEN 'NONE' ELSE 'UNCERTAIN' END AS answer_dimension FROM b""", ("v_probes",))
def _(v):
    return A.reference_answer(typed(v)).select("evaluation_id", "dimension", "evidence_sufficient", "risk_present", "answer_dimension")


@query("agr_22_duplicate_raters", "SELECT conv_id, role AS rater, count(*) AS n FROM conversations GROUP BY 1, 2 HAVING count(*) > 1")
def _(v):
    return A.duplicate_raters(v("conversations").withColumnRenamed("role", "rater"), ["conv_id"], "rater")


@query("agr_22_match_count", plurality_sql("v_ratings", "item", "q3", "pl") + " SELECT count(*) AS items, count(*) FILTER (WHERE majority = CASE WHEN item % 2 = 0 THEN 'SAFETY' ELSE 'FAIRNESS' END) AS matches FROM pl", ("v_ratings",))
def _(v):
    return A.match_count(A.plurality(v("v_ratings"), ITEM, "q3"), F.when(F.col("item") % 2 == 0, "SAFETY").otherwise("FAIRNESS"))


# the published agreement of an item is rounded, and off by a tenth in some; it is recomputed answer pair by answer pair
@query("agr_20_recompute", _RT + """, p AS (SELECT a.item, avg((a.q1 = b.q1)::INT) AS x FROM rt a JOIN rt b ON a.item = b.item AND a.rater < b.rater GROUP BY 1),
 s AS (SELECT item, round(x, 4) + CASE WHEN item % 17 = 0 THEN 0.1::DOUBLE ELSE 0 END AS x FROM p)
SELECT item, round(s.x, 6) AS left_value, round(p.x, 6) AS right_value, 'differs' AS problem FROM s JOIN p USING (item) WHERE abs(s.x - p.x) > 0.001""", ("v_ratings",))
def _(v):
    published = A.pair_agree(ratings(v), ITEM, "q1").select("item", (F.round("agreement", 4) + F.when(F.col("item") % 17 == 0, 0.1).otherwise(0.0)).alias("x"))
    recomputed = A.rater_pairs(ratings(v), [], ITEM, "rater", "q1").groupBy("item").agg(F.avg((F.col("a") == F.col("b")).cast("double")).alias("x"))
    return reconcile_buckets(published, recomputed, ITEM, "x", 0.001)
