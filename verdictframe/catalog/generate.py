"""Sampling, flips and perturbation (GEN)."""

from pyspark.sql import functions as F

from ..functions.columns import hash_rank, max_changes
from ..operators import generate as G
from .base import query


def hash_sql(*parts: str) -> str:
    joined = ", ".join(f"CAST({p} AS STRING)" for p in parts)
    return f"CAST('0x' || substr(md5(concat_ws(':', {joined})), 1, 8) AS BIGINT)"


_SWAP = f""", c AS (SELECT doc_id, text, string_split(text, '') AS ch FROM documents),
 p AS (SELECT *, list_filter(range(1, len(ch) + 1), lambda i: regexp_matches(ch[i], '[\\p{{L}}\\p{{N}}]')) AS pos FROM c),
 k AS (SELECT *, least(5, len(pos)) AS k FROM p),
 d AS (SELECT *, CASE WHEN k = 0 THEN []::BIGINT[] ELSE list_reduce(list_prepend([]::BIGINT[], list_transform(range(len(pos) - k, len(pos)), lambda j: [j])),
   lambda acc, x: list_append(acc, CASE WHEN list_contains(acc, {hash_sql('7', 'doc_id', "'p'", 'x[1]')} % (x[1] + 1)) THEN x[1]
   ELSE {hash_sql('7', 'doc_id', "'p'", 'x[1]')} % (x[1] + 1) END)) END AS picks FROM k),
 t AS (SELECT doc_id, text, ch, list_transform(picks, lambda o: pos[o + 1]) AS spots FROM d),
 u AS (SELECT doc_id, text, ch, unnest(spots) AS spot FROM t),
 w AS (SELECT doc_id, spot, ch[spot] AS old, strpos('abcdefghijklmnopqrstuvwxyz0123456789', lower(ch[spot])) AS same, {hash_sql('7', 'doc_id', "'c'", 'spot')} AS h FROM u),
 x AS (SELECT doc_id, spot, old, substr('abcdefghijklmnopqrstuvwxyz0123456789', (CASE WHEN same = 0 THEN h % 36 WHEN h % 35 >= same - 1 THEN h % 35 + 1 ELSE h % 35 END) + 1, 1) AS fresh FROM w),
 y AS (SELECT doc_id, spot, CASE WHEN old = upper(old) AND old <> lower(old) THEN upper(fresh) ELSE fresh END AS fresh FROM x),
 m AS (SELECT doc_id, map_from_entries(list((spot, fresh))) AS mp FROM y GROUP BY 1),
 z AS (SELECT c.doc_id, c.text, CASE WHEN mp IS NULL THEN c.text ELSE array_to_string(list_transform(ch, lambda v, i: coalesce(mp[i], v)), '') END AS attacked FROM c LEFT JOIN m USING (doc_id))
""".replace(", c AS", "WITH c AS", 1)


@query("gen_01_char_swap", _SWAP + "SELECT doc_id, md5(attacked) AS attacked_md5, attacked <> text AS changed FROM z")
def _(v):
    df = G.char_swap(v("documents"), "text", "doc_id", 7, 5)
    return df.select("doc_id", F.md5("attacked").alias("attacked_md5"), (F.col("attacked") != F.col("text")).alias("changed"))


@query("gen_02_perturb_coverage", _SWAP + """SELECT lang, count(*) AS n, count(*) FILTER (WHERE attacked <> z.text) AS n_perturbed,
 count(*) - count(*) FILTER (WHERE attacked <> z.text) AS n_failed, round(count(*) FILTER (WHERE attacked <> z.text)::DOUBLE / count(*), 6) AS coverage
FROM z JOIN documents USING (doc_id) GROUP BY 1""")
def _(v):
    return G.perturb_coverage(G.char_swap(v("documents"), "text", "doc_id", 7, 5), ["lang"])


@query("gen_03_max_changes", """SELECT l_discount, greatest(1, least(8, round_even(l_discount * 100.0::DOUBLE, 0)))::INT AS changes, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def _(v):
    return v("lineitem").groupBy("l_discount", max_changes("l_discount").alias("changes")).agg(F.count("*").alias("n"))


_ANTI = "SELECT p.* FROM v_pred_text p WHERE NOT EXISTS (SELECT 1 FROM benchmark b WHERE b.text = p.text)"


@query("gen_04_stratified_sample", f""", r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {hash_sql('11', 'row_id')}, row_id) AS rn FROM ({_ANTI}))
SELECT row_id, label, grp FROM r WHERE rn <= CASE WHEN label = 1 THEN 30 ELSE 120 END""", ("v_pred_text",))
def _(v):
    return G.stratified_sample(v("v_pred_text"), "row_id", 150, 0.2, 11, v("benchmark")).select("row_id", "label", "grp")


_QUOTAS = {("en", 0): 40, ("en", 1): 10, ("fr", 0): 15, ("fr", 1): 50}
_QUOTA_CASE = "CASE WHEN grp = 'en' AND label = 0 THEN 40 WHEN grp = 'en' AND label = 1 THEN 10 WHEN grp = 'fr' AND label = 0 THEN 15 WHEN grp = 'fr' AND label = 1 THEN 50 ELSE 0 END"
_QUOTA_SQL = f""", f AS (SELECT *, {hash_sql('3', 'row_id')} AS h FROM v_pred_text), u AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY text ORDER BY h, row_id) = 1),
 q AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY grp, label ORDER BY h, row_id) <= {_QUOTA_CASE})"""


@query("gen_05_quota_sample", _QUOTA_SQL + " SELECT row_id, grp, label FROM q", ("v_pred_text",))
def _(v):
    return G.quota_sample(v("v_pred_text"), "row_id", ["grp", "label"], _QUOTAS, 3).select("row_id", "grp", "label")


@query("gen_05_quota_shortfall", _QUOTA_SQL + """, w(grp, label, quota) AS (VALUES ('en', 0, 40), ('en', 1, 10), ('fr', 0, 15), ('fr', 1, 50)),
 g AS (SELECT grp, label, count(*) AS drawn FROM q GROUP BY 1, 2)
SELECT w.grp, w.label, w.quota::BIGINT AS quota, coalesce(drawn, 0) AS drawn, quota - coalesce(drawn, 0) AS shortfall FROM w LEFT JOIN g ON g.grp = w.grp AND g.label = w.label""", ("v_pred_text",))
def _(v):
    s = G.quota_sample(v("v_pred_text"), "row_id", ["grp", "label"], _QUOTAS, 3)
    return G.quota_shortfall(s, ["grp", "label"], _QUOTAS)


@query("gen_06_seeded_slice", f"""SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM benchmark b WHERE b.text = d.text)
ORDER BY {hash_sql('5', 'doc_id')}, doc_id LIMIT 200""")
def _(v):
    return G.seeded_slice(v("documents"), "doc_id", 200, 5, v("benchmark")).select("doc_id", "lang")


_FLIP = f""", a AS (SELECT *, grp = 'en' AND label = 0 AS cand, {hash_sql('9', 'row_id')} AS h FROM v_pred_text),
 b AS (SELECT *, row_number() OVER (PARTITION BY cand ORDER BY h, row_id) AS rn, count(*) OVER (PARTITION BY cand) AS k FROM a)"""


@query("gen_07_flip_labels", _FLIP + """ SELECT row_id, cand AND rn <= round_even(k * 0.4::DOUBLE, 0) AS flipped,
 CASE WHEN cand AND rn <= round_even(k * 0.4::DOUBLE, 0) THEN 1 ELSE label END AS label FROM b""", ("v_pred_text",))
def _(v):
    where = (F.col("grp") == "en") & (F.col("label") == 0)
    return G.flip_labels(v("v_pred_text"), "row_id", where, 1, 0.4, 9).select("row_id", "flipped", "label")


@query("gen_08_flip_severe", f""", a AS (SELECT *, severe = 1 AS cand, {hash_sql('9', 'row_id')} AS h FROM v_pred_text),
 b AS (SELECT *, row_number() OVER (PARTITION BY cand ORDER BY h, row_id) AS rn, count(*) OVER (PARTITION BY cand) AS k FROM a)
SELECT row_id, cand AND rn <= round_even(k * 0.5::DOUBLE, 0) AS flipped, CASE WHEN cand AND rn <= round_even(k * 0.5::DOUBLE, 0) THEN 0 ELSE label END AS label FROM b""", ("v_pred_text",))
def _(v):
    return G.flip_labels(v("v_pred_text"), "row_id", F.col("severe") == 1, 0, 0.5, 9).select("row_id", "flipped", "label")


@query("gen_09_flip_chain", _FLIP + f""", c AS (SELECT row_id, severe, cand AND rn <= round_even(k * 0.7::DOUBLE, 0) AS fair,
 CASE WHEN cand AND rn <= round_even(k * 0.7::DOUBLE, 0) THEN 1 ELSE label END AS label FROM b),
 d AS (SELECT *, severe = 1 AND label = 1 AS cand2, {hash_sql('4', 'row_id')} AS h2 FROM c),
 e AS (SELECT *, row_number() OVER (PARTITION BY cand2 ORDER BY h2, row_id) AS rn, count(*) OVER (PARTITION BY cand2) AS k FROM d)
SELECT row_id, fair AS flipped_fairness, cand2 AND rn <= round_even(k * 0.5::DOUBLE, 0) AS flipped_safety,
 CASE WHEN cand2 AND rn <= round_even(k * 0.5::DOUBLE, 0) THEN 0 ELSE label END AS label FROM e""", ("v_pred_text",))
def _(v):
    fair = (F.col("grp") == "en") & (F.col("label") == 0)
    severe = (F.col("severe") == 1) & (F.col("label") == 1)
    return G.flip_chain(v("v_pred_text"), "row_id", [
        ("flipped_fairness", fair, 1, 0.7, 9), ("flipped_safety", severe, 0, 0.5, 4)]).select(
        "row_id", "flipped_fairness", "flipped_safety", "label")


@query("gen_10_disjoint", "SELECT doc_id, turn_hits FROM (SELECT d.doc_id, 0 AS turn_hits FROM documents d WHERE d.text NOT IN (SELECT text FROM benchmark) AND d.text NOT IN (SELECT text FROM conversations))")
def _(v):
    corpora = v("benchmark").select("text").unionByName(v("conversations").select("text"))
    return G.without_texts(v("documents"), corpora).select("doc_id", F.lit(0).alias("turn_hits"))


@query("gen_10_overlap_counts", """SELECT 'benchmark' AS corpus, count(*) AS overlap FROM documents WHERE text IN (SELECT text FROM benchmark)
UNION ALL SELECT 'conversations', count(*) FROM documents WHERE text IN (SELECT text FROM conversations)
UNION ALL SELECT 'labelled', count(*) FROM documents WHERE text IN (SELECT text FROM documents JOIN labels USING (doc_id))""")
def _(v):
    labelled = v("documents").join(v("labels").select("doc_id"), "doc_id", "left_semi")
    return G.overlap_counts(v("documents"), {"benchmark": v("benchmark"), "conversations": v("conversations"), "labelled": labelled})


@query("gen_11_severity_grid", _FLIP + """, r(rate) AS (VALUES (0.0::DOUBLE), (0.2), (0.5), (1.0))
SELECT rate, row_id, cand AND rn <= round_even(k * rate, 0) AS flipped, CASE WHEN cand AND rn <= round_even(k * rate, 0) THEN 1 ELSE label END AS label FROM b CROSS JOIN r""", ("v_pred_text",))
def _(v):
    where = (F.col("grp") == "en") & (F.col("label") == 0)
    return G.severity_grid(v("v_pred_text"), "row_id", where, 1, [0.0, 0.2, 0.5, 1.0], 9).select("rate", "row_id", "flipped", "label")


@query("gen_12_manifest", """, h AS (
  SELECT lang AS grp, quality AS label,
    sha256(length(d.doc_id::STRING) || ':' || d.doc_id || coalesce(length(text) || ':' || text, '-') || coalesce(length(quality::STRING) || ':' || quality, '-')) AS x
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id
), p AS (SELECT grp, label, list_transform(range(8), lambda k: CAST('0x' || substr(x, 1 + 8 * k, 8) AS BIGINT)) AS p FROM h)
SELECT grp, count(*) AS size, count(*) FILTER (WHERE label = 1) AS positives, round(count(*) FILTER (WHERE label = 1)::DOUBLE / count(*), 6) AS positive_rate,
 0::BIGINT AS rows_flipped,
 sha256(concat_ws(':', sum(p[1])::STRING, sum(p[2])::STRING, sum(p[3])::STRING, sum(p[4])::STRING, sum(p[5])::STRING, sum(p[6])::STRING, sum(p[7])::STRING, sum(p[8])::STRING)) AS digest
FROM p GROUP BY 1""".replace(", h AS", "WITH h AS", 1))
def _(v):
    df = v("documents").join(v("labels"), "doc_id").select("doc_id", "text", F.col("lang").alias("grp"), F.col("quality").alias("label"))
    return G.dataset_manifest(df, ["grp"], "doc_id", ["text", "label"])


@query("gen_13_stability", """SELECT evaluation_id, count(*) AS n, round(avg(y_hat), 6) AS predicted_positive_rate, round(avg(label), 6) AS true_positive_rate,
 round(avg(0.5 + (row_id % 50) / 100.0::DOUBLE), 6) AS mean_confidence, min(0.5 + (row_id % 50) / 100.0::DOUBLE) AS min_confidence,
 round(avg((y_hat = label)::INT), 6) AS clean_accuracy, round(avg((y_robust = label)::INT), 6) AS robust_accuracy, round(avg((y_hat <> y_robust)::INT), 6) AS flip_rate
FROM v_pred_text GROUP BY 1""", ("v_pred_text",))
def _(v):
    df = v("v_pred_text").withColumn("confidence", F.lit(0.5) + (F.col("row_id") % 50) / F.lit(100.0))
    return G.stability_report(df, ["evaluation_id"])
