"""Model-card queries (DOC)."""

from pyspark.sql import functions as F

from ..operators import documents as D
from .base import query

def _fallbacks(key: str) -> dict:
    """The cards' structured ``datasets`` list satisfies the data section when it is not empty."""
    return {key: [("datasets", F.col("datasets_field").isNotNull())]}


SECTIONS_SQL = """, ln AS (SELECT card_id, unnest(string_split(card_text, chr(10))) AS line, generate_subscripts(string_split(card_text, chr(10)), 1) AS i FROM v_cards),
 hd AS (SELECT *, regexp_matches(line, '^#{1,3}\\s+.+$') AS is_h FROM ln),
 sc AS (SELECT *, sum(is_h::INT) OVER (PARTITION BY card_id ORDER BY i) AS sid FROM hd),
 sg AS (SELECT card_id, sid, max(CASE WHEN is_h THEN trim(regexp_extract(line, '^#{1,3}\\s+(.+?)\\s*$', 1)) END) AS heading,
  trim(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT is_h), ''), ' ' || chr(9) || chr(10) || chr(13)) AS body FROM sc WHERE sid > 0 GROUP BY 1, 2),
 se AS (SELECT * FROM sg QUALIFY row_number() OVER (PARTITION BY card_id, heading ORDER BY sid) = 1),
 sn AS (SELECT *, trim(regexp_replace(regexp_replace(lower(heading), '[^\\p{L}\\p{N}_\\s]+', ' ', 'g'), '\\s+', ' ', 'g')) AS nh,
  length(body) >= 20 AND trim(regexp_replace(regexp_replace(lower(body), '[^\\p{L}\\p{N}_\\s]+', ' ', 'g'), '\\s+', ' ', 'g')) NOT IN
   ('more information needed', 'n a', 'na', 'tbd', 'to be determined', 'coming soon', 'none', 'not available') AS full_body FROM se)"""


def presence_sql(aliases: dict, field_key: str) -> str:
    rows = ", ".join(f"('{k}', '{a}', {i})" for i, (k, names) in enumerate(aliases.items()) for a in names)
    keys = ", ".join(f"('{k}', {i})" for i, k in enumerate(aliases))
    return SECTIONS_SQL + f""", al(key, alias, ko) AS (VALUES {rows}), ky(key, ko) AS (VALUES {keys}),
 am AS (SELECT sn.card_id, sn.sid, sn.heading, al.key FROM sn JOIN al ON contains(sn.nh, al.alias) WHERE full_body
  QUALIFY row_number() OVER (PARTITION BY sn.card_id, sn.sid ORDER BY length(al.alias) DESC, al.ko) = 1),
 pm AS (SELECT card_id, key, first(heading ORDER BY sid) AS heading FROM am GROUP BY 1, 2),
 pr AS (SELECT c.card_id, ky.key, ky.ko, coalesce(pm.heading, CASE WHEN ky.key = '{field_key}' AND datasets_field IS NOT NULL THEN 'card_data.datasets' END) AS matched_heading
  FROM v_cards c CROSS JOIN ky LEFT JOIN pm ON pm.card_id = c.card_id AND pm.key = ky.key)"""


@query("doc_01_sections", SECTIONS_SQL + " SELECT card_id, row_number() OVER (PARTITION BY card_id ORDER BY sid) - 1 AS position, heading, md5(body) AS body_md5 FROM se", ("v_cards",))
def _(v):
    return D.split_sections(v("v_cards"), "card_id").select("card_id", F.col("position").cast("bigint").alias("position"), "heading", F.md5("body").alias("body_md5"))


@query("doc_02_heading_norm", """SELECT page_id, trim(regexp_replace(regexp_replace(lower(html), '[^\\p{L}\\p{N}_\\s]+', ' ', 'g'), '\\s+', ' ', 'g')) AS norm FROM pages""")
def _(v):
    return v("pages").select("page_id", D.normalize_heading(F.col("html")).alias("norm"))


@query("doc_03_nontrivial", SECTIONS_SQL + " SELECT card_id, heading, full_body AS nontrivial FROM sn", ("v_cards",))
def _(v):
    return D.split_sections(v("v_cards"), "card_id").select("card_id", "heading", D.nontrivial(F.col("body")).alias("nontrivial"))


@query("doc_04_alias_match", presence_sql(D.SECTION_ALIASES, "x").replace("WHERE full_body", "") + " SELECT card_id, heading, key FROM am", ("v_cards",))
def _(v):
    s = D.split_sections(v("v_cards"), "card_id")
    return s.select("card_id", "heading", D.match_alias(D.normalize_heading(F.col("heading")), D.SECTION_ALIASES).alias("key")).filter("key is not null")


@query("doc_05_sections_present", presence_sql(D.SECTION_ALIASES, "training_data") + " SELECT card_id, key, matched_heading IS NOT NULL AS present, matched_heading FROM pr", ("v_cards",))
def _(v):
    return D.presence_rows(v("v_cards"), "card_id", D.SECTION_ALIASES, _fallbacks("training_data"))


_REQ = "key IN ('intended_use', 'limitations', 'training_data', 'evaluation', 'ethical_considerations')"
_LOW = "lower(trim(card_text, ' ' || chr(9) || chr(10) || chr(13)))"
_EMPTY = f"length({_LOW}) = 0"


def any_sql(text: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({text}, '{p}')" for p in phrases) + ")"


_DOCV = presence_sql(D.SECTION_ALIASES, "training_data") + f""",
 cv AS (SELECT card_id, count(*) FILTER (WHERE {_REQ} AND matched_heading IS NOT NULL)::INT AS k, bool_or(key = 'limitations' AND matched_heading IS NOT NULL) AS lim,
  string_agg('missing_' || key, '|' ORDER BY ko) FILTER (WHERE {_REQ} AND matched_heading IS NULL) AS missing FROM pr GROUP BY 1),
 ct AS (SELECT c.card_id, k, lim, missing, {_EMPTY} AS empty, length({_LOW})::INT AS chars,
  {any_sql(_LOW, D.OPEN_CLAIMS)} AND (coalesce(trim(license), '') = '' OR {any_sql('lower(license)', D.RESTRICTIVE_LICENSES)}) AS open_bad,
  {any_sql(_LOW, D.PRODUCTION_CLAIMS)} AND NOT lim AS prod_bad FROM v_cards c JOIN cv USING (card_id)),
 cf AS (SELECT *, CASE WHEN empty THEN 'empty_card' ELSE concat_ws('|', CASE WHEN open_bad THEN 'open_claim_vs_restrictive_license' END, CASE WHEN prod_bad THEN 'no_limitations_but_production_claim' END) END AS contradictions FROM ct)"""


@query("doc_06_coverage", _DOCV + " SELECT card_id, CASE WHEN empty THEN 0 ELSE k END AS sections_present, CASE WHEN empty THEN 0 ELSE round(k / 5.0::DOUBLE, 4) END AS coverage_ratio FROM cf", ("v_cards",))
def _(v):
    return D.documentation_verdict(v("v_cards"), "card_id", _fallbacks("training_data")).select("card_id", "sections_present", "coverage_ratio")


@query("doc_07_contradictions", _DOCV + " SELECT card_id, contradictions FROM cf", ("v_cards",))
def _(v):
    return D.documentation_verdict(v("v_cards"), "card_id", _fallbacks("training_data")).select("card_id", "contradictions")


@query("doc_08_documentation_verdict", _DOCV + """ SELECT card_id, chars AS card_chars, CASE WHEN empty THEN 'INSUFFICIENT_EVIDENCE' ELSE 'EVALUATED' END AS status, CASE WHEN empty THEN 0 ELSE k END AS sections_present,
 CASE WHEN empty THEN 0 ELSE round(k / 5.0::DOUBLE, 4) END AS coverage_ratio, CASE WHEN empty THEN 'not_scored' WHEN contradictions <> '' THEN 'risk_detected' WHEN k < 5 THEN 'disclosure_gap' ELSE 'no_material_risk' END AS aspect_scoring,
 CASE WHEN NOT empty AND contradictions <> '' THEN 'E-DOC-CONTRADICTION' END AS risk, CASE WHEN NOT empty AND k < 5 THEN 'E-DOC-INCOMPLETE' END AS gap, CASE WHEN empty THEN 'G-EXP-CARD-EMPTY' END AS failed_gate, contradictions,
 CASE WHEN empty THEN 'empty_card' ELSE concat_ws('|', missing, nullif(contradictions, ''), CASE WHEN round(k / 5.0::DOUBLE, 4) < 0.6 THEN 'needs_human_review' END) END AS flags FROM cf""", ("v_cards",))
def _(v):
    return D.documentation_verdict(v("v_cards"), "card_id", _fallbacks("training_data"))


@query("doc_09_safety_disclosures", presence_sql(D.DISCLOSURE_ALIASES, "data_disclosure") + " SELECT card_id, key, matched_heading IS NOT NULL AS present, matched_heading FROM pr", ("v_cards",))
def _(v):
    return D.presence_rows(v("v_cards"), "card_id", D.DISCLOSURE_ALIASES, _fallbacks("data_disclosure"))


def families_sql(text: str, groups: dict) -> str:
    return "concat_ws('|', " + ", ".join(f"CASE WHEN {any_sql(text, words)} THEN '{name}' END" for name, words in groups.items()) + ")"


@query("doc_10_impact_claims", f"SELECT card_id, {families_sql('lower(card_text)', D.IMPACT_PHRASES)} AS claims FROM v_cards", ("v_cards",))
def _(v):
    return v("v_cards").select("card_id", D.families(F.col("card_text"), D.IMPACT_PHRASES).alias("claims"))


_SREQ = "key IN ('misuse_risks', 'privacy', 'security_warnings', 'data_disclosure')"


@query("doc_11_disclosure_verdict", presence_sql(D.DISCLOSURE_ALIASES, "data_disclosure") + f""",
 cv AS (SELECT card_id, count(*) FILTER (WHERE {_SREQ} AND matched_heading IS NOT NULL)::INT AS k, string_agg('missing_' || key, '|' ORDER BY ko) FILTER (WHERE {_SREQ} AND matched_heading IS NULL) AS missing FROM pr GROUP BY 1),
 cf AS (SELECT c.card_id, k, missing, {_EMPTY} AS empty, length({_LOW})::INT AS chars, {families_sql(_LOW, D.IMPACT_PHRASES)} AS claims, round(k / 4.0::DOUBLE, 4) AS r FROM v_cards c JOIN cv USING (card_id))
SELECT card_id, chars AS card_chars, CASE WHEN empty THEN 'INSUFFICIENT_EVIDENCE' ELSE 'EVALUATED' END AS status, CASE WHEN empty THEN 0 ELSE k END AS checks_present, CASE WHEN empty THEN 0 ELSE r END AS coverage_ratio,
 CASE WHEN empty THEN 'not_scored' WHEN k < 4 THEN 'disclosure_gap' ELSE 'no_material_risk' END AS aspect_scoring, CASE WHEN NOT empty AND k < 4 THEN 'S-GOV-DISCLOSURE-GAP' END AS gap, CASE WHEN empty THEN 'G-SAFE-CARD-EMPTY' END AS failed_gate,
 claims AS high_impact_claims, CASE WHEN empty THEN 'empty_card' ELSE concat_ws('|', missing, CASE WHEN claims <> '' THEN 'high_impact_deployment_claim' END, CASE WHEN claims <> '' AND r < 1 THEN 'high_impact_without_full_disclosure' END,
 CASE WHEN r < 1 OR claims <> '' THEN 'needs_human_review' END) END AS flags FROM cf""", ("v_cards",))
def _(v):
    return D.disclosure_verdict(v("v_cards"), "card_id", _fallbacks("data_disclosure"))


_SIG = families_sql(_LOW, D.REPRO_SIGNALS)


@query("doc_12_reproducibility", f""", s AS (SELECT card_id, {_SIG} AS signal_groups FROM v_cards)
SELECT card_id, signal_groups, contains(signal_groups, '|') AS passes FROM s""", ("v_cards",))
def _(v):
    return D.reproducibility(v("v_cards"), "card_id")


@query("doc_13_refresh_sources", """, ex AS (SELECT owner AS model, CASE WHEN card_id % 3 = 0 THEN 'auto' ELSE 'manual' END AS origin, card_id AS retrieved_at, license AS outcome FROM v_cards),
 fe AS (SELECT owner AS model, 'auto' AS origin, card_id + 100000 AS retrieved_at, revision AS outcome FROM v_cards WHERE revision IS NOT NULL AND owner <> 'src3'),
 ne AS (SELECT * FROM fe QUALIFY row_number() OVER (PARTITION BY model ORDER BY retrieved_at DESC) = 1)
SELECT * FROM ex WHERE NOT (origin = 'auto' AND model IN (SELECT model FROM fe)) UNION ALL SELECT * FROM ne""", ("v_cards",))
def _(v):
    c = v("v_cards")
    existing = c.select(F.col("owner").alias("model"), F.when(F.col("card_id") % 3 == 0, "auto").otherwise("manual").alias("origin"),
                        F.col("card_id").alias("retrieved_at"), F.col("license").alias("outcome"))
    fetched = c.filter(F.col("revision").isNotNull() & (F.col("owner") != "src3")).select(
        F.col("owner").alias("model"), F.lit("auto").alias("origin"), (F.col("card_id") + 100000).alias("retrieved_at"), F.col("revision").alias("outcome"))
    return D.refresh_sources(existing, fetched)
