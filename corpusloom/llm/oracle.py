"""SQL for the queries that SQL can express, written independently of the operators."""

CHAT = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, length(regexp_replace(replace(text, '\', '\\'), '\[/?SYS\]|\[/?INST\]|</?s>|\[/?TURN\]|\[NAME\]', '\0#', 'g')) AS n FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n + CASE role WHEN 'system' THEN 11 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 19
    + length(regexp_replace(replace(role, '\', '\\'), '\[/?SYS\]|\[/?INST\]|</?s>|\[/?TURN\]|\[NAME\]', '\0#', 'g')) END)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""


def secrets() -> str:
    """Positions from the lengths of the matches and of the text between them."""
    kinds = [
        ("assign", r"""((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
        ("access", r"AKIA[A-Z0-9]+", 0, 16),
        ("hex", r"[0-9a-f]{32,}", 0, 32),
        ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
        ("code_host", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
        ("bearer", r"(?i:bearer)\x20+([A-Za-z0-9+/_.=-]+)", 1, 20),
        ("web_token", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 1),
    ]
    parts = [
        f"""SELECT rid, {place} AS place, '{kind}' AS kind, m[i] AS hit, v[i] AS value, {least} AS least,
          list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start
        FROM (SELECT rid, string_split_regex(text, '{p}') AS gaps, regexp_extract_all(text, '{p}', 0) AS m,
                regexp_extract_all(text, '{p}', {group}) AS v FROM d WHERE regexp_matches(text, '{p}')), unnest(range(1, len(m) + 1)) AS t(i)"""
        for place, (kind, p, group, least) in enumerate(kinds)
    ]
    line = "kind || ':' || start || ':' || (start + length(hit))"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT * FROM ({" UNION ALL ".join(parts)}) WHERE length(value) >= least)
SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
  count(*) FILTER (kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg({line}, ',' ORDER BY start, place) FILTER (place < 3), '')) AS base_sha256,
  coalesce(string_agg({line}, ',' ORDER BY start, place), '') AS spans
FROM d LEFT JOIN s USING (rid) GROUP BY rid, doc_id
"""


MIXING = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
    CASE WHEN regexp_matches(t, '(?i)licen[sc]e|all rights reserved|copyright') THEN 'license'
      WHEN regexp_matches(t, '[A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[A-Za-z]|[0-9]{3}[ .-][0-9]{3}') THEN 'contact'
      WHEN contains(t, ' | ') THEN 'table' WHEN regexp_matches(t, '[0-9]') THEN 'numbers' ELSE 'general' END AS topic,
    len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) + 1 AS n_tokens
  FROM (SELECT *, coalesce(text, '') AS t FROM documents)
), cells AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM d GROUP BY ALL),
s AS (SELECT source, pow(sum(tokens), 0.8) AS a, a / sum(a) OVER () AS share FROM cells GROUP BY source),
l AS (SELECT lang, pow(sum(tokens), 0.9) AS a, a / sum(a) OVER () AS share FROM cells GROUP BY lang),
k AS (SELECT topic, pow(sum(tokens), 0.9) AS a, a / sum(a) OVER () AS share FROM cells GROUP BY topic),
start AS (
  SELECT c.*, s.share AS s_share, l.share AS l_share, k.share AS k_share
  FROM cells c JOIN s USING (source) JOIN l USING (lang) JOIN k USING (topic)
), fit AS (
  SELECT 0 AS i, *, tokens / (SELECT sum(tokens) FROM cells) AS w FROM start
  UNION ALL
  SELECT i + 1, source, lang, topic, tokens, s_share, l_share, k_share,
    w * CASE i % 3 WHEN 0 THEN s_share / sum(w) OVER (PARTITION BY source)
      WHEN 1 THEN l_share / sum(w) OVER (PARTITION BY lang) ELSE k_share / sum(w) OVER (PARTITION BY topic) END
  FROM fit WHERE i < 180
), p AS (SELECT source, lang, topic, w / tokens / max(w / tokens) OVER () AS p FROM fit WHERE i = 180)
SELECT doc_id, source, lang, topic, n_tokens, round(p, 6) AS probability,
  ('0x' || substr(md5(concat_ws(':', doc_id::VARCHAR, '17')), 1, 12))::BIGINT / pow(16, 12) < p AS kept
FROM d JOIN p USING (source, lang, topic)
"""


SEARCH = r"""
WITH w AS (
  SELECT doc_id, term, count(*) AS tf FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')) AS term FROM documents
  ) GROUP BY ALL
), size AS (SELECT doc_id, sum(tf) AS n FROM w GROUP BY doc_id),
total AS (SELECT (SELECT count(*) FROM documents) AS docs, (SELECT sum(n) FROM size) / (SELECT count(*) FROM documents) AS mean),
df AS (SELECT term, count(*) AS df FROM w GROUP BY term),
hit AS (
  SELECT q.doc_id AS query_id, w.doc_id,
    round(sum(q.tf * ln(1 + (docs - df + 0.5) / (df + 0.5)) * w.tf * 2.2 / (w.tf + 1.2 * (0.25 + 0.75 * n / mean))), 6) AS score
  FROM w AS q JOIN w ON w.term = q.term JOIN df ON df.term = q.term JOIN size ON size.doc_id = w.doc_id, total
  WHERE q.doc_id % 100 = 0 GROUP BY ALL
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score
FROM hit QUALIFY rank <= 10
"""


NEGATIVES = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) = len(list_filter(embedding, lambda x: isfinite(x)))
), s AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, list_dot_product(a.e, b.e)::BIGINT AS score
  FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score QUALIFY rank <= 5
"""


REPEATS = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT rid, doc_id, i, array_to_string(w[i:i + 12], ' ') AS words FROM d, unnest(range(1, len(w) - 11)) AS t(i)
), owned AS (SELECT *, min(doc_id) OVER (PARTITION BY words) AS owner FROM windows),
gone AS (SELECT DISTINCT rid, k FROM (SELECT rid, unnest(range(i, i + 13)) AS k FROM owned WHERE owner < doc_id)),
left_over AS (
  SELECT rid, count(g.k) AS n_removed, string_agg(word, ' ' ORDER BY k) FILTER (g.k IS NULL) AS kept
  FROM (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM d) LEFT JOIN gone AS g USING (rid, k) GROUP BY rid
)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN left_over USING (rid)
"""
