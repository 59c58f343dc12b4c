"""DuckDB SQL of the queries whose result SQL can state."""

from __future__ import annotations

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM documents
), t AS (
  SELECT r, i, w[i] AS w, CASE WHEN i > 1 THEN w[i - 1] END AS p FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d)
), u AS (SELECT w, count(*) AS n FROM t GROUP BY w),
b AS (SELECT p, w, count(*) AS n FROM t WHERE p IS NOT NULL GROUP BY p, w),
du AS (SELECT r, w, count(*) AS n FROM t GROUP BY r, w),
db AS (SELECT r, p, w, count(*) AS n FROM t WHERE p IS NOT NULL GROUP BY r, p, w),
x AS (
  SELECT t.r, (SELECT count(*) FROM t) - len(d.w) AS others, u.n - du.n AS c1, cu.n - cdu.n AS ctx, coalesce(b.n - db.n, 0) AS c2, t.p IS NULL AS start_word
  FROM t JOIN d USING (r) JOIN u ON u.w = t.w JOIN du ON du.r = t.r AND du.w = t.w
  LEFT JOIN u AS cu ON cu.w = t.p LEFT JOIN du AS cdu ON cdu.r = t.r AND cdu.w = t.p
  LEFT JOIN b ON b.p = t.p AND b.w = t.w LEFT JOIN db ON db.r = t.r AND db.p = t.p AND db.w = t.w
), s AS (
  SELECT r, CASE WHEN c2 > 0 THEN ln(c2 / ctx)
      ELSE CASE WHEN start_word THEN 0 ELSE ln(0.4) END + CASE WHEN c1 > 0 THEN ln(c1 / others) ELSE ln(0.4) - ln(others + 1) END END AS s,
    CASE WHEN start_word THEN c1 <= 0 ELSE c2 <= 0 END AS low
  FROM x
), g AS (SELECT r, sum(s) AS s, count(*) AS n, count(*) FILTER (low) AS low FROM s GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(round(s, 6), 0.0) AS log_score, round(s / n, 6) AS mean_log_score, CAST(coalesce(low, 0) AS BIGINT) AS n_backoff
FROM d LEFT JOIN g USING (r)
"""

OP6 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), marks AS (
  SELECT unnest(['\', '<|', '</s>', '<s>', '<unk>', '<pad>', '[INST]', '[/INST]', '<<SYS>>', '<</SYS>>', '<bos>', '<eos>', '<start_of_turn>', '<end_of_turn>']) AS m
), x AS (
  SELECT t.*,
    -- escaping adds one character for each control string and backslash
    (SELECT sum((length(t.text) - length(replace(t.text, m, ''))) // length(m)
              + (length(t.role) - length(replace(t.role, m, ''))) // length(m)) FROM marks) AS added
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(role) + length(text) + added + 23) AS BIGINT) AS formatted_chars,
  count(*) FILTER (role = 'assistant') AS loss_turns
FROM x GROUP BY conv_id
"""

OP8 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i + 1 : i + least(10, len(w))], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(0, len(w) - least(10, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT k FROM bw),
dw AS (
  SELECT r, i, k, array_to_string(w[i + 1 : i + k], ' ') AS s
  FROM (SELECT r, w, k, unnest(range(0, len(w) - k + 1)) AS i FROM d, sizes WHERE len(w) >= k)
), hit AS (SELECT DISTINCT r, i, k, item_id FROM dw JOIN bw USING (k, s)),
pos AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hit) GROUP BY r),
items AS (
  SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(pos.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items.s, '')) AS items_sha256, coalesce(pos.n, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN items USING (r)
"""

_FACTS = r"""
d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT r, i, hash(w[i + 1]) AS a, array_to_string(w[i + 1 : i + 5], ' ') AS s
  FROM (SELECT r, w, unnest(range(0, len(w) - 4)) AS i FROM d WHERE len(w) > 4)
), twice AS (SELECT r, s FROM win GROUP BY r, s HAVING count(*) > 1),
rep AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM win SEMI JOIN twice USING (r, s)) GROUP BY r
), dup AS (
  SELECT r, count(*) - count(DISTINCT l) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r
), f AS (
  SELECT d.r, doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN dup USING (r) LEFT JOIN rep USING (r)
), g AS (
  SELECT *, greatest(n_words, 1) AS m, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f
), rated AS (
  SELECT *, CAST(n_words < 10 AS INT) + CAST(100 * n_repeat_words > 20 * m AS INT) + CAST(n_symbols * 10 > m AS INT)
    + CAST(n_dup_lines > 10 AND n_dup_lines * 10 > m * 3 AS INT) + CAST(word_chars < m * 2 OR word_chars > m * 15 AS INT) AS n_broken FROM g
), h AS (
  SELECT source, count(*) AS n, count(*) FILTER (n_broken > 0) AS bad FROM rated GROUP BY source
), s AS (
  SELECT sum(n)::DOUBLE AS w, sum(bad)::DOUBLE AS b, count(*) AS hosts, sum(n * (bad / n) * (bad / n)) AS sq FROM h
), p AS (SELECT b / w AS mean, greatest(sq / w - (b / w) * (b / w), 0) - (b / w) * (1 - b / w) * hosts / w AS between_hosts, hosts FROM s),
k AS (SELECT mean, CASE WHEN between_hosts > 1e-12 AND hosts > 1 THEN greatest(mean * (1 - mean) / between_hosts - 1, 2.0) ELSE 2.0 END AS k FROM p),
v AS (SELECT source, (bad + CASE WHEN k > 2.0 THEN mean ELSE 0.5 END * k) / (n + k) AS rate FROM h, k)
"""

OP10 = f"""
WITH {_FACTS}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rate > 0.9 AS kept,
  rated.source AS host, CAST(n_broken AS INTEGER) AS n_broken, round(rate, 6) AS host_rate
FROM rated JOIN v ON rated.source IS NOT DISTINCT FROM v.source
"""

OP11 = r"""
WITH w AS (
  SELECT coalesce(source, '') AS part, doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents
), l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t),
     regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > first, false)] AS bad
  FROM w LEFT JOIN l USING (doc_id)
), g AS (SELECT part, bad, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY part, bad),
f AS (SELECT unnest(range(1, 6)) AS f),
o AS (
  SELECT [a.f, b.f, c.f, d.f, e.f] AS ord FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), s AS (SELECT ord, step, ord[step] AS f, ord[1 : step - 1] AS earlier FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (
  SELECT part, ord, step, s.f,
    CAST(coalesce(sum(n) FILTER (NOT hit), 0) AS BIGINT) AS kept_before,
    CAST(coalesce(sum(n) FILTER (bad[s.f] AND NOT hit), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (bad[s.f] AND hit), 0) AS BIGINT) AS redundant,
    CAST(coalesce(sum(n) FILTER (bad[s.f] AND len(list_filter(bad, lambda x: x)) = 1), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(good) FILTER (bad[s.f] AND NOT hit), 0) AS BIGINT) AS good_lost,
    CAST(coalesce(sum(toxic) FILTER (bad[s.f] AND NOT hit), 0) AS BIGINT) AS toxic_lost
  FROM (SELECT g.*, s.*, len(list_filter(s.earlier, lambda k: g.bad[k])) > 0 AS hit FROM g, s) s GROUP BY ALL
)
SELECT part, array_to_string([substr('ABCDE', CAST(k AS INT), 1) for k in ord], '') AS filter_order, CAST(step AS INTEGER) AS step, substr('ABCDE', CAST(f AS INT), 1) AS filter,
  kept_before - removed AS kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM r
"""

#: DuckDB has no crc32; it is computed bit by bit over the decimal digits.
OP13 = r"""
WITH RECURSIVE t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS txt, row_number() OVER (
    PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) AS p
  FROM conversations WHERE conv_id IS NOT NULL
), crc AS (
  SELECT c, 0 AS i, 4294967295::UBIGINT AS v FROM (SELECT DISTINCT c FROM t)
  UNION ALL
  SELECT c, i + 1, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END
  FROM (SELECT c, i, CASE WHEN i % 8 = 0 THEN xor(v, ascii(substr(c::VARCHAR, i // 8 + 1, 1))::UBIGINT) ELSE v END AS x FROM crc WHERE i < 8 * length(c::VARCHAR))
), h AS (SELECT c, CAST(xor(v, 4294967295::UBIGINT) % 6 AS BIGINT) AS h FROM crc WHERE i = 8 * length(c::VARCHAR)),
b AS (
  SELECT h.c, 0 AS own, p, role, txt FROM h JOIN t ON t.c = h.c - h.c % 100 AND p <= h
  UNION ALL SELECT t.c, 1, p, role, txt FROM t JOIN h USING (c) WHERE p > h
), n AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, p) AS d, sha256(role || chr(0) || txt) AS x, length(txt) AS chars FROM b
), r AS (
  SELECT h.c, coalesce(list(x ORDER BY d) FILTER (x IS NOT NULL), []) AS path, coalesce(list(chars ORDER BY d) FILTER (x IS NOT NULL), []) AS chars
  FROM h LEFT JOIN n USING (c) GROUP BY h.c
), pre AS (
  SELECT c, len(path) AS total, d, path[1 : d] AS path, CASE WHEN d > 0 THEN chars[d] ELSE 0 END AS chars FROM (SELECT *, unnest(range(0, len(path) + 1)) AS d FROM r)
), node AS (
  SELECT path, min(c) AS conv_id, d AS depth, count(*) AS n_convs, max(chars) AS chars, count(*) FILTER (total = d) AS ending,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (total = d), '')) AS ends_sha256
  FROM pre GROUP BY path, d
), sub AS (
  SELECT path[1 : d] AS path, count(*) FILTER (depth = d + 1) AS n_children, count(*) FILTER (ending = n_convs) AS n_leaves, sum((n_convs - 1) * chars) AS saved
  FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM node) GROUP BY path[1 : d]
)
SELECT a.conv_id, a.depth, p.conv_id AS parent_conv_id, a.n_convs, s.n_children, s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, a.ends_sha256
FROM node a JOIN sub s USING (path) LEFT JOIN node p ON a.depth > 0 AND p.path = a.path[1 : a.depth - 1]
"""

ORACLE_SQL: dict[str, str] = {
    "op4_lm_backoff": OP4,
    "op6_chat_format": OP6,
    "op8_suffix_decontamination": OP8,
    "op10_host_rules": OP10,
    "op11_filter_audit_lists": OP11,
    "op13_prefix_trie_rollup": OP13,
}
