"""DuckDB SQL for the results of the operators that SQL can express."""

from __future__ import annotations

from lodestone.llm.license_scan import CONTAINMENT, PHRASES, template_tokens

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM d),
wins AS (SELECT doc_id, s, array_to_string(ws[s : s + 19], ' ') AS k FROM starts),
firsts AS (SELECT k, min({'a': doc_id, 'b': s}) AS f FROM wins GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM wins JOIN firsts USING (k) WHERE {'a': doc_id, 'b': s} > f),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
kept AS (
  SELECT words.doc_id, count(gone.i) AS n, string_agg(word, ' ' ORDER BY words.i) FILTER (WHERE gone.i IS NULL) AS text
  FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.i = gone.i GROUP BY words.doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP6 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, '{WORD}') AS ws FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({LOWER}, '{WORD}') AS ws FROM benchmark),
sized AS (SELECT item, ws, least(10, len(ws)) AS n FROM b WHERE len(ws) > 0),
cut AS (SELECT item, n, ws, unnest(range(1, len(ws) - n + 2)) AS s FROM sized),
wins AS (SELECT DISTINCT item, n, array_to_string(ws[s : s + n - 1], ' ') AS k FROM cut),
sizes AS (SELECT DISTINCT n FROM wins),
places AS (SELECT doc_id, n, ws, unnest(range(1, len(ws) - n + 2)) AS s FROM d, sizes),
found AS (
  SELECT doc_id, s, wins.n, item FROM (SELECT doc_id, n, s, array_to_string(ws[s : s + n - 1], ' ') AS k FROM places) p
  JOIN wins ON p.n = wins.n AND p.k = wins.k),
hit AS (SELECT doc_id, count(DISTINCT i) AS n FROM (SELECT doc_id, unnest(range(s, s + n)) AS i FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, hit.n IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP8 = """
WITH v AS (
  SELECT vec_id::BIGINT AS vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.v, v.v)::BIGINT AS score FROM v q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""

OP12 = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
places AS (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 399)) AS s FROM d),
wins AS (SELECT doc_id, s, md5_number(substring(h, 2 * s + 1, 800)) AS k FROM places),
again AS (SELECT doc_id, s FROM wins JOIN (SELECT k FROM wins GROUP BY k HAVING count(*) > 1) USING (k)),
cut AS (SELECT doc_id, s, CASE WHEN s - lag(s) OVER w <= 400 THEN 0 ELSE 1 END AS new FROM again WINDOW w AS (PARTITION BY doc_id ORDER BY s)),
numbered AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS r FROM cut),
runs AS (SELECT doc_id, r, min(s) AS a, max(s) + 400 AS b FROM numbered GROUP BY doc_id, r),
gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p FROM runs),
per AS (
  SELECT doc_id, sum(b - a) AS removed, count(*) AS n, max(b) AS z, string_agg(substring(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) AS t
  FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(t, '') || substring(h, 2 * coalesce(z, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN per USING (doc_id)
"""

OP13 = r"""
WITH RECURSIVE tab AS (
  SELECT list(list_reduce(list_prepend(n, range(8)::UBIGINT[]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) ORDER BY n) AS t
  FROM (SELECT unnest(range(256))::UBIGINT AS n)),
raws AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
keys AS (SELECT k, list_prepend(4294967295::UBIGINT, list_transform(string_split(k, ''), lambda x: ord(x)::UBIGINT)) AS b FROM (SELECT DISTINCT k FROM raws)),
hashed AS (SELECT k, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[((xor(c, x) & 255) + 1)::BIGINT])), 4294967295::UBIGINT) % 20 AS h FROM keys, tab),
hurt AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM (SELECT raws.*, h, unnest(CASE WHEN h = 0 THEN [] WHEN h = 3 THEN [1, 2] ELSE [1] END) AS copy FROM raws JOIN hashed USING (k))),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM hurt),
t AS (
  SELECT conv_id, turn, i, role, text, left(role, 1) AS r, CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault,
    left(role, 1) || lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) NOT IN ('su', 'ua', 'au') AS wrong FROM placed),
sums AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (wrong) AS illegal, max(i) AS n FROM t GROUP BY conv_id),
-- paths: after i turns, in state s, the best edits; the states are those of (s?(ua)+)?, and `before` inserts come in front of a turn
start AS (SELECT conv_id, 0::BIGINT AS i, s, cost, audit, said FROM sums, (VALUES (0, 0, '', []::VARCHAR[]), (2, 5, 'I', ['user:']), (3, 10, 'II', ['user:', 'assistant:'])) v(s, cost, audit, said)),
steps AS (
  SELECT * FROM start
  UNION ALL
  SELECT conv_id, i, s, m.cost, m.audit, m.said FROM (
    SELECT conv_id, i, s, min({'cost': cost, 'audit': audit, 'said': said}) AS m FROM (
      SELECT conv_id, i, unnest(more, recursive := true) FROM (
        SELECT conv_id, i, list_concat(moved,
            -- one insert behind the turn, and two from a state without u and a
            list_transform(list_filter(moved, lambda x: x.s <> 2), lambda x: {'s': 2, 'cost': x.cost + 5, 'audit': x.audit || 'I', 'said': list_append(x.said, 'user:')}),
            list_transform(list_filter(moved, lambda x: x.s < 2), lambda x: {'s': 3, 'cost': x.cost + 10, 'audit': x.audit || 'II', 'said': list_append(list_append(x.said, 'user:'), 'assistant:')}),
            list_transform(list_filter(moved, lambda x: x.s = 2), lambda x: {'s': 3, 'cost': x.cost + 5, 'audit': x.audit || 'I', 'said': list_append(x.said, 'assistant:')})) AS more
        FROM (
          SELECT p.conv_id, t.i, list_filter([
            {'s': p.s, 'cost': p.cost + 2, 'audit': p.audit || 'D', 'said': p.said},
            CASE WHEN t.fault NOT IN ('blank', 'duplicate') AND CASE t.r WHEN 's' THEN p.s = 0 WHEN 'u' THEN p.s <> 2 WHEN 'a' THEN p.s = 2 ELSE false END
              THEN {'s': CASE t.r WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END, 'cost': p.cost + CASE WHEN t.fault = 'truncated' THEN 5 ELSE 0 END, 'audit': p.audit || 'K', 'said': list_append(p.said, t.role || ':' || t.text)} END,
            CASE WHEN t.fault NOT IN ('blank', 'duplicate')
              THEN {'s': CASE WHEN p.s = 2 THEN 3 ELSE 2 END, 'cost': p.cost + CASE WHEN t.fault = 'truncated' THEN 6 ELSE 1 END, 'audit': p.audit || 'R',
                'said': list_append(p.said, CASE WHEN p.s = 2 THEN 'assistant' ELSE 'user' END || ':' || t.text)} END], lambda x: x IS NOT NULL) AS moved
          FROM steps p JOIN t ON p.conv_id IS NOT DISTINCT FROM t.conv_id AND t.i = p.i + 1))) GROUP BY conv_id, i, s)),
best AS (SELECT sums.conv_id, min({'cost': cost, 'audit': audit, 'said': said}) AS m FROM steps JOIN sums ON steps.conv_id IS NOT DISTINCT FROM sums.conv_id AND steps.i = sums.n WHERE s IN (0, 3) GROUP BY sums.conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(m.cost, 0)::BIGINT AS cost, coalesce(m.audit, '') AS audit, sha256(coalesce(array_to_string(m.said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN sums ON c.conv_id IS NOT DISTINCT FROM sums.conv_id LEFT JOIN best ON c.conv_id IS NOT DISTINCT FROM best.conv_id
"""


def strings(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def op4() -> str:
    starts = []
    for phrase, label in PHRASES.items():
        n = len(phrase.split())
        starts.append(f"SELECT doc_id, s - 1 AS s, '{label}' AS label FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {n - 2})) AS s FROM d) WHERE array_to_string(ws[s : s + {n - 1}], ' ') = '{phrase}'")
    templates = ", ".join(f"('{label}', {strings(own)})" for label, own in template_tokens())
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, '{WORD}') AS ws FROM documents),
base AS ({" UNION ALL ".join(starts)}),
t(label, own) AS (VALUES {templates}),
blocks AS (SELECT doc_id, regexp_extract_all(unnest(string_split({LOWER}, chr(10))), '{WORD}') AS ws FROM documents),
m AS (SELECT doc_id, label, len(list_intersect(ws, own)) AS o, len(own) AS n FROM blocks, t WHERE len(list_intersect(ws, own)) >= ceil({CONTAINMENT} * len(own) - 1e-9)),
per AS (SELECT doc_id, count(*) AS n, min(s) AS a, max(s) AS z, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM base GROUP BY doc_id),
united AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM base UNION ALL SELECT doc_id, label FROM m) GROUP BY doc_id),
best AS (SELECT doc_id, max(o / n) AS score FROM m GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(per.n, 0)::BIGINT AS n_base, per.a::BIGINT AS first_word, per.z::BIGINT AS last_word,
  coalesce(per.labels, '') AS base_labels, coalesce(united.labels, '') AS labels, CASE WHEN per.n > 0 THEN 1.0::DOUBLE ELSE coalesce(best.score, 0.0)::DOUBLE END AS score
FROM d LEFT JOIN per USING (doc_id) LEFT JOIN united USING (doc_id) LEFT JOIN best USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_substring_dedup": OP3, "op4_license_scan": op4(), "op6_decontaminate": OP6, "op8_exact_top_k": OP8, "op12_suffix_array_dedup": OP12, "op13_conversation_repair": OP13}
