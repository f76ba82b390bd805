"""The registered queries in plain SQL, written independently of the operators."""

from __future__ import annotations

import re

from corpusloom.catalog import score_oracle as so

_OTHER = r"[\t-\r\x1C-\x1F\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_NAME = r"\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)*"
_WORD = r"\p{Lu}\p{Ll}+"
_CAPITALIZED = "[A-Z][a-z]{3,}"
_STOP = (
    "'the','a','an','is','are','was','were','in','on','at','to','for','of','and','or','but','has','have','had',"
    "'with','from','by','that','this','it','its','be','been'"
)


def _sub(x: str, pattern: str, replacement: str) -> str:
    return f"regexp_replace({x}, '{pattern}', '{replacement}', 'g')"


def _collapse(x: str) -> str:
    return f"trim({_sub(_sub(x, _OTHER, ' '), '  +', ' ')})"


def _clean_html(x: str) -> str:
    return _collapse(_sub(_sub(_sub(x, "<[^>]+>", ""), "&[a-zA-Z]+;", " "), "&#[0-9]+;", " "))


def _strip_urls(x: str) -> str:
    return _sub(x, r"http[^ ]+|www\.[^ ]+", "")


def _strip_emails(x: str) -> str:
    return f"array_to_string(list_transform(string_split({x}, ' '), lambda t: CASE WHEN t LIKE '_%@_%' THEN '' ELSE t END), ' ')"


def _clean(x: str) -> str:
    return _collapse(_strip_emails(_strip_urls(_clean_html(x))))


def _tokens(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda t: t <> '')"


def _n_tokens(x: str) -> str:
    return f"CAST(len({_tokens(x)}) AS BIGINT)"


def _sentences(x: str) -> str:
    marked = f"regexp_replace({x}, '([.!?]) +', '\\1' || chr(1), 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: trim(s)), lambda s: length(s) > 10)"


def _mentions(x: str, pattern: str) -> str:
    return f"list_sort(list_distinct(list_transform(regexp_extract_all({x}, '{pattern}'), lambda m: lower(m))))"


def _keywords(x: str) -> str:
    kept = f"list_filter({_tokens(x)}, lambda t: length(t) > 3 AND lower(t) NOT IN ({_STOP}))"
    return f"list_sort(list_distinct(list_transform({kept}, lambda t: lower(t))))"


def _grams(tokens: str, n: int) -> str:
    return f"list_transform(range(1, len({tokens}) - {n} + 2), lambda i: array_to_string(list_slice({tokens}, i, i + {n} - 1), ' '))"


def _r(x: str) -> str:
    return f"round({x}, 6)"


_VIEWS: dict[str, str] = {
    "v_raw": f"""
        SELECT doc_id, source AS newspaper_name,
               CASE WHEN doc_id % 11 = 0 THEN 'unknown'
                    ELSE strftime(DATE '2010-01-01' + CAST(doc_id % 4000 AS INTEGER), '%Y-%m-%d') END AS published_date,
               split_part(text, chr(10), 1) AS headline, text AS article_text,
               array_to_string(list_filter(string_split({_collapse("text")}, ' '), lambda w: length(w) >= 8), ' ') AS human_summary,
               CASE WHEN doc_id % 17 <> 0 THEN lang END AS news_category
        FROM documents""",
    "v_std": f"""
        SELECT doc_id, newspaper_name AS source, try_strptime(published_date, '%Y-%m-%d') AS date,
               CAST(year(try_strptime(published_date, '%Y-%m-%d')) AS BIGINT) AS year, headline, article_text AS articles,
               {_clean("article_text")} AS articles_clean, {_clean("human_summary")} AS summary_clean,
               {_clean("headline")} AS headline_clean, news_category AS category
        FROM v_raw""",
    "v_long": "SELECT * FROM v_std WHERE length(articles_clean) > 100 AND length(summary_clean) > 20",
    "v_docs": f"""
        SELECT *, {_n_tokens("articles_clean")} AS article_token_count, {_n_tokens("summary_clean")} AS summary_token_count,
               {_n_tokens("articles_clean")} / CAST({_n_tokens("summary_clean")} AS DOUBLE) AS compression_ratio
        FROM (SELECT *, row_number() OVER (PARTITION BY articles_clean ORDER BY doc_id) AS copy FROM v_long) WHERE copy = 1""",
    "v_cleaned": f"SELECT doc_id, lang, source, {_clean('text')} AS text FROM documents",
    "v_pairs": f"""
        SELECT doc_id AS pair_id, text AS source,
               array_to_string(list_slice(w, len(w) // 3 + 1, len(w)), ' ') AS generated,
               array_to_string(list_slice(w, 1, len(w) - len(w) // 3), ' ') AS reference
        FROM (SELECT doc_id, text, {_tokens("text")} AS w FROM v_cleaned)""",
    "v_chat": f"""
        SELECT u.conv_id || '-' || u.turn AS pair_id, {_clean("u.text")} AS source, {_clean("a.text")} AS generated
        FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
        WHERE u.role = 'user' AND a.role = 'assistant'""",
    "v_gazetteer": f"""
        SELECT entity, (['PERSON','ORG','GPE','LOC','EVENT','DATE','MONEY'])[length(entity) % 7 + 1] AS label
        FROM (SELECT unnest({_mentions("text", _WORD)}) AS entity FROM benchmark
              UNION SELECT unnest({_mentions("text", _WORD + " " + _WORD)}) FROM documents)""",
    "v_pair_entities": f"""
        SELECT pair_id, {_mentions("source", _CAPITALIZED)} AS s, {_mentions("generated", _CAPITALIZED)} AS g,
               {_mentions("reference", _CAPITALIZED)} AS r
        FROM v_pairs""",
    "v_pair_scores": """
        SELECT *, CASE WHEN len(g) = 0 THEN 1.0 ELSE len(list_intersect(g, r)) / CAST(len(g) AS DOUBLE) END AS p,
               CASE WHEN len(r) = 0 THEN 1.0 ELSE len(list_intersect(g, r)) / CAST(len(r) AS DOUBLE) END AS c,
               list_sort(list_filter(g, lambda x: NOT list_contains(r, x))) AS missing
        FROM v_pair_entities""",
    "v_vec": """
        SELECT CAST(label AS BIGINT) AS cluster_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vec,
               vec_id % 7 AS entity
        FROM embeddings""",
    "v_sim": """
        SELECT a.cluster_id, a.pos AS src, b.pos AS dst
        FROM v_vec a JOIN v_vec b ON a.cluster_id = b.cluster_id AND a.pos <> b.pos
        WHERE list_dot_product(a.vec, b.vec) / sqrt(list_dot_product(a.vec, a.vec)) / sqrt(list_dot_product(b.vec, b.vec)) > 0.2""",
    "v_shared": """
        SELECT a.cluster_id, a.pos AS src, b.pos AS dst
        FROM v_vec a JOIN v_vec b ON a.cluster_id = b.cluster_id AND a.entity = b.entity AND a.pos <> b.pos""",
    "v_adj": """
        SELECT * FROM v_sim UNION SELECT * FROM v_shared
        UNION SELECT cluster_id, i, i FROM (SELECT cluster_id, pos AS i FROM v_vec)""",
    "v_logits": """
        SELECT pair_id, exp(l0 - m) / z AS contradiction, exp(l1 - m) / z AS entailment, exp(l2 - m) / z AS neutral
        FROM (SELECT *, exp(l0 - m) + exp(l1 - m) + exp(l2 - m) AS z
              FROM (SELECT *, greatest(l0, l1, l2) AS m
                    FROM (SELECT vec_id AS pair_id, CAST(embedding[1] AS DOUBLE) * 10 AS l0, CAST(embedding[2] AS DOUBLE) * 10 AS l1,
                                 CAST(embedding[3] AS DOUBLE) * 10 AS l2 FROM embeddings)))""",
    "v_cluster_docs": "SELECT doc_id // 3 AS cluster_id, doc_id % 3 AS doc_pos, text FROM v_cleaned",
    "v_cluster_sentences": f"""
        SELECT cluster_id, rn - 1 AS pos, sentence
        FROM (SELECT cluster_id, sentence, row_number() OVER (PARTITION BY cluster_id ORDER BY doc_pos, i) AS rn
              FROM (SELECT cluster_id, doc_pos, unnest(s) AS sentence, generate_subscripts(s, 1) AS i
                    FROM (SELECT cluster_id, doc_pos, {_sentences("text")} AS s FROM v_cluster_docs)))""",
    "v_cluster_slots": "SELECT * FROM v_cluster_sentences WHERE pos < 30",
    "v_cluster_nodes": f"""
        SELECT cluster_id, pos, sentence, e,
               list_transform(range(64), lambda d: CAST(len(list_filter(cells, lambda c: c = d)) AS DOUBLE)) AS vec
        FROM (SELECT cluster_id, pos, sentence, {_mentions("sentence", _CAPITALIZED)} AS e,
                     list_transform({_tokens("sentence")},
                         lambda w: (unicode(left(w, 1)) * 31 + unicode(right(w, 1)) * 7 + length(w)) % 64) AS cells
              FROM v_cluster_sentences)""",
    "v_cluster_adj": """
        SELECT a.cluster_id, a.pos AS src, b.pos AS dst
        FROM v_cluster_nodes a JOIN v_cluster_nodes b ON a.cluster_id = b.cluster_id AND a.pos <> b.pos
        WHERE list_dot_product(a.vec, b.vec) / greatest(sqrt(list_dot_product(a.vec, a.vec)), 1e-12)
              / greatest(sqrt(list_dot_product(b.vec, b.vec)), 1e-12) > 0.75 OR list_has_any(a.e, b.e)
        UNION SELECT cluster_id, i, i FROM (SELECT cluster_id, pos AS i FROM v_cluster_nodes)""",
    "v_vocab": f"""
        SELECT token, CAST(row_number() OVER (ORDER BY n DESC, token) + 2 AS BIGINT) AS token_id
        FROM (SELECT token, count(*) AS n FROM (SELECT unnest({_tokens("lower(text)")}) AS token FROM v_cleaned)
              GROUP BY token)""",
    "v_latency": """
        SELECT event_type AS model, value / 100 AS latency, CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens FROM events""",
    "v_stats": """
        SELECT model, count(*) AS n_samples, avg(latency) AS mean_latency, 1 / avg(latency) AS samples_per_sec,
               sum(tokens) / sum(latency) AS tokens_per_sec, avg(tokens) AS avg_tokens,
               quantile_cont(latency, 0.5) AS median_latency, quantile_cont(latency, 0.95) AS p95_latency
        FROM v_latency GROUP BY model""",
    "v_run": """
        SELECT run, step, (step - 1) // 100 + 1 AS epoch, loss
        FROM (SELECT event_type AS run, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS step, ln(1 + value) AS loss
              FROM events)""",
    "v_epochs": "SELECT run, epoch, count(*) AS n_batches, avg(loss) AS avg_loss FROM v_run GROUP BY run, epoch",
    "v_ranked": """
        SELECT doc_id, n_chars, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS rank,
               row_number() OVER (ORDER BY doc_id) AS place, count(*) OVER () AS n
        FROM documents""",
    "v_split": """
        SELECT *, CASE WHEN rank <= floor(n * CAST(0.8 AS DOUBLE)) THEN 'train'
                       WHEN rank <= floor(n * (CAST(0.8 AS DOUBLE) + CAST(0.1 AS DOUBLE))) THEN 'val' ELSE 'test' END AS split
        FROM v_ranked""",
    "v_tokens": r"""
        SELECT pair_id,
               list_filter(string_split(regexp_replace(lower(generated), '[^a-z0-9]+', ' ', 'g'), ' '), lambda t: t <> '') AS g,
               list_filter(string_split(regexp_replace(lower(reference), '[^a-z0-9]+', ' ', 'g'), ' '), lambda t: t <> '') AS r
        FROM v_pairs""",
}


def _with(body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix the views a statement uses, each after those it uses itself."""
    views = {**_VIEWS, **(extra or {})}
    ordered: list[str] = []

    def need(text: str, inside: str = "") -> None:
        for name in views:
            if name not in ordered and name != inside and re.search(rf"\b{name}\b", text):
                need(views[name], name)
                if name not in ordered:
                    ordered.append(name)

    need(body)
    if not ordered:
        return body
    return "WITH " + ",\n".join(f"{name} AS ({views[name]})" for name in ordered) + "\n" + body


_BENCH_COLUMNS = f"""
    model, n_samples * 1000 AS params_total, 'seq2seq' AS model_type, n_samples AS num_samples,
    {_r("mean_latency")} AS mean_latency_sec, {_r("median_latency")} AS median_latency_sec, {_r("p95_latency")} AS p95_latency_sec,
    {_r("samples_per_sec")} AS throughput_samples_per_sec, {_r("tokens_per_sec")} AS throughput_tokens_per_sec,
    {_r("avg_tokens")} AS avg_generated_tokens, 'none' AS gpu, CAST(0.5 AS DOUBLE) AS peak_vram_gb"""

_SCORED = {
    "v_scored": f"""
        SELECT e.pair_id, p.source, p.generated, p.reference,
               CASE WHEN len(g) = 0 THEN 1.0 ELSE len(list_intersect(g, s)) / CAST(len(g) AS DOUBLE) END AS prec,
               CASE WHEN len(r) = 0 THEN 1.0 ELSE len(list_intersect(g, r)) / CAST(len(r) AS DOUBLE) END AS rec,
               list_sort(list_filter(g, lambda x: NOT list_contains(s, x))) AS hall, len(g) AS n_ent,
               {_keywords("p.generated")} AS gk, {_keywords("p.source")} AS sk, l.entailment, l.contradiction
        FROM v_pair_entities e JOIN v_pairs p USING (pair_id) LEFT JOIN v_logits l USING (pair_id)""",
    "v_scored2": """
        SELECT *, CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0 END AS f1,
               CASE WHEN len(gk) = 0 THEN 0.0 ELSE len(list_intersect(gk, sk)) / CAST(len(gk) AS DOUBLE) END AS topic
        FROM v_scored""",
}


def _histogram(values: str) -> str:
    """``values`` is a view with one column x."""
    return f"""
        SELECT b AS bin, {_r("lo + b * ((hi - lo) / 50)")} AS low, {_r("lo + (b + 1) * ((hi - lo) / 50)")} AS high,
               count(x) AS n, {_r("mean")} AS mean, {_r("median")} AS median
        FROM (SELECT CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS lo,
                     CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END AS hi, avg(x) AS mean,
                     quantile_cont(x, 0.5) AS median FROM {values}) s
        CROSS JOIN range(50) t(b)
        LEFT JOIN {values} v ON x >= lo + b * ((hi - lo) / 50) AND (x < lo + (b + 1) * ((hi - lo) / 50) OR b = 49)
        GROUP BY b, lo, hi, mean, median"""


def _box(column: str) -> str:
    return f"""
        SELECT category, count(*) AS n, {_r("q1")} AS q1, {_r("med")} AS median, {_r("q3")} AS q3,
               {_r("least(min(x) FILTER (x >= q1 - (q3 - q1) * 1.5), q1)")} AS whisker_low,
               {_r("greatest(max(x) FILTER (x <= q3 + (q3 - q1) * 1.5), q3)")} AS whisker_high,
               count(*) FILTER (x < q1 - (q3 - q1) * 1.5 OR x > q3 + (q3 - q1) * 1.5) AS n_outliers
        FROM (SELECT category, CAST({column} AS DOUBLE) AS x FROM v_docs) d
        JOIN (SELECT category, quantile_cont({column}, 0.25) AS q1, quantile_cont({column}, 0.5) AS med,
                     quantile_cont({column}, 0.75) AS q3, count(*) AS c
              FROM v_docs WHERE category IS NOT NULL GROUP BY category ORDER BY c DESC, category LIMIT 6) USING (category)
        GROUP BY category, q1, med, q3"""


def _counts(column: str, top: int) -> str:
    return f"""
        SELECT {column}, count(*) AS n_rows, {_r("count(*) * 100.0 / (SELECT count(*) FROM v_docs)")} AS percent
        FROM v_docs WHERE {column} IS NOT NULL GROUP BY {column} ORDER BY n_rows DESC, {column} LIMIT {top}"""


def _sized(view: str, column: str) -> str:
    return _with(
        f"""
        SELECT count(*) AS n_groups, {_r("avg(n)")} AS mean_size, {_r("quantile_cont(n, 0.5)")} AS median_size,
               min(n) AS min_size, max(n) AS max_size,
               (SELECT {column} FROM v_groups ORDER BY n, {column} LIMIT 1) AS min_name,
               (SELECT {column} FROM v_groups ORDER BY n DESC, {column} LIMIT 1) AS max_name
        FROM v_groups""",
        {"v_groups": f"SELECT {column}, count(*) AS n FROM {view} WHERE {column} IS NOT NULL GROUP BY {column}"},
    )


def _length_stats(column: str) -> str:
    return f"""
        SELECT '{column}' AS "column", count({column}) AS n, {_r(f"avg({column})")} AS mean, {_r(f"quantile_cont({column}, 0.5)")} AS median,
               {_r(f"quantile_cont({column}, 0.99)")} AS p99, CAST(min({column}) AS DOUBLE) AS min, CAST(max({column}) AS DOUBLE) AS max,
               {_r(f"stddev_samp({column})")} AS std FROM v_docs"""


def _vocabulary(part: str, column: str) -> str:
    return f"""
        SELECT '{part}' AS part, CAST(sum(n) AS BIGINT) AS n_tokens, count(*) AS n_types, {_r("count(*) / CAST(sum(n) AS DOUBLE)")} AS type_token_ratio
        FROM (SELECT token, count(*) AS n FROM (SELECT unnest({_tokens(f"lower({column})")}) AS token FROM v_std) GROUP BY token)"""


def _layer(source: str, n_in: int) -> dict[str, str]:
    """Views of one attention layer over ``source`` (cluster_id, pos, vec); the result is ``<source>_out``."""
    product = f"list_transform(range(8), lambda k: list_sum(list_transform(range({n_in}), lambda j: vec[j + 1] * (((31 * k + 17 * j) % 13 - 6) / 10.0))))"
    half = "list_sum(list_transform(range(8), lambda k: wh[k + 1] * (((7 * (k + {0})) % 5 - 2) / 10.0)))"
    return {
        f"{source}_wh": f"SELECT cluster_id, pos, {product} AS wh FROM {source}",
        f"{source}_half": f"SELECT *, {half.format(0)} AS own, {half.format(8)} AS other FROM {source}_wh",
        f"{source}_raw": f"""
            SELECT i.cluster_id, i.pos, j.wh, i.own + j.other AS x
            FROM v_adj e JOIN {source}_half i ON i.cluster_id = e.cluster_id AND i.pos = e.src
            JOIN {source}_half j ON j.cluster_id = e.cluster_id AND j.pos = e.dst""",
        f"{source}_exp": f"""
            SELECT *, exp(s - max(s) OVER (PARTITION BY cluster_id, pos)) AS w
            FROM (SELECT *, CASE WHEN x >= 0 THEN x ELSE 0.2 * x END AS s FROM {source}_raw)""",
        f"{source}_dims": f"""
            SELECT cluster_id, pos, k, greatest(sum(w * wh[k + 1]) / sum(w), 0) AS value
            FROM {source}_exp CROSS JOIN range(8) t(k) GROUP BY cluster_id, pos, k""",
        f"{source}_out": f"SELECT cluster_id, pos, list(value ORDER BY k) AS vec FROM {source}_dims GROUP BY cluster_id, pos",
    }


def _rouge(n: int) -> dict[str, str]:
    return {
        f"v_counts{n}": f"""
            SELECT pair_id, gram, sum(a) AS a, sum(b) AS b
            FROM (SELECT pair_id, unnest({_grams("g", n)}) AS gram, 1 AS a, 0 AS b FROM v_tokens
                  UNION ALL SELECT pair_id, unnest({_grams("r", n)}), 0, 1 FROM v_tokens)
            GROUP BY pair_id, gram""",
        f"v_match{n}": f"""
            SELECT t.pair_id, coalesce(m, 0) AS m, greatest(len(g) - {n - 1}, 0) AS ng, greatest(len(r) - {n - 1}, 0) AS nr
            FROM v_tokens t LEFT JOIN (SELECT pair_id, sum(least(a, b)) AS m FROM v_counts{n} GROUP BY pair_id) USING (pair_id)""",
        f"v_rouge{n}": f"""
            SELECT *, CASE WHEN p + c > 0 THEN 2 * p * c / (p + c) ELSE 0 END AS f
            FROM (SELECT pair_id, CASE WHEN ng > 0 THEN m / CAST(ng AS DOUBLE) ELSE 0 END AS p,
                         CASE WHEN nr > 0 THEN m / CAST(nr AS DOUBLE) ELSE 0 END AS c FROM v_match{n})""",
    }


def _rouge_query(n: int) -> str:
    return _with(f"SELECT pair_id, {_r('p')} AS precision, {_r('c')} AS recall, {_r('f')} AS f1 FROM v_rouge{n}", _rouge(n))


def _bleu_views(pairs: str) -> dict[str, str]:
    def tokens(x: str) -> str:
        line = f"replace(replace(replace({x}, '<skipped>', ''), '-' || chr(10), ''), chr(10), ' ')"
        line = f"replace(replace(replace(replace({line}, '&quot;', '\"'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>')"
        line = f"(' ' || {line} || ' ')"
        line = _sub(line, r"([{-~\[-` -&(-+:-@/])", r" \1 ")
        line = _sub(line, r"([^0-9])([.,])", r"\1 \2 ")
        line = _sub(line, r"([.,])([^0-9])", r" \1 \2")
        line = _sub(line, r"([0-9])(-)", r"\1 \2 ")
        return _tokens(_collapse(line))

    views = {"v_bt": f"SELECT pair_id, {tokens('generated')} AS g, {tokens('reference')} AS r FROM {pairs}"}
    for n in range(1, 5):
        views[f"v_b{n}"] = f"""
            SELECT coalesce(sum(least(a, b)), 0) AS m
            FROM (SELECT pair_id, gram, sum(a) AS a, sum(b) AS b
                  FROM (SELECT pair_id, unnest({_grams("g", n)}) AS gram, 1 AS a, 0 AS b FROM v_bt
                        UNION ALL SELECT pair_id, unnest({_grams("r", n)}), 0, 1 FROM v_bt)
                  GROUP BY pair_id, gram)"""
    return views


def _bleu() -> str:
    views = _bleu_views("v_pairs")
    totals = ", ".join(f"sum(greatest(len(g) - {n - 1}, 0)) AS t{n}" for n in range(1, 5))
    logs = " + ".join(f"ln(m{n} / t{n})" for n in range(1, 5))
    matches = ", ".join(f"CAST(m{n} AS BIGINT) AS match_{n}" for n in range(1, 5))
    return _with(
        f"""
        SELECT {_r(f"100 * bp * exp(({logs}) / 4)")} AS score, {_r("bp")} AS brevity_penalty,
               CAST(gl AS BIGINT) AS gen_len, CAST(rl AS BIGINT) AS ref_len, {matches}
        FROM (SELECT *, CASE WHEN gl >= rl THEN 1.0 ELSE exp(1 - rl / CAST(gl AS DOUBLE)) END AS bp
              FROM (SELECT sum(len(g)) AS gl, sum(len(r)) AS rl, {totals} FROM v_bt)),
             (SELECT v_b1.m AS m1, v_b2.m AS m2, v_b3.m AS m3, v_b4.m AS m4 FROM v_b1, v_b2, v_b3, v_b4)""",
        views,
    )


def _padded(ids: str, length: int, fill: int) -> str:
    return f"list_resize(list_slice({ids}, 1, {length}), {length}, {fill})"


def _mask(ids: str, length: int) -> str:
    return f"list_transform(range(1, {length} + 1), lambda i: CASE WHEN i <= len({ids}) THEN 1 ELSE 0 END)"


def _encoded(source: str, key: str, tokens: str, name: str) -> dict[str, str]:
    """View ``name`` (key, ids): ids of the token list of each row of ``source``."""
    return {
        f"{name}_t": f"SELECT {key}, {tokens} AS t FROM {source}",
        f"{name}_u": f"SELECT {key}, unnest(t) AS token, generate_subscripts(t, 1) AS i FROM {name}_t",
        name: f"""
            SELECT {key}, coalesce(list(x ORDER BY i) FILTER (i IS NOT NULL), []) AS ids
            FROM {name}_t LEFT JOIN (SELECT {key}, i, coalesce(token_id, 1) AS x FROM {name}_u LEFT JOIN v_vocab USING (token)) USING ({key})
            GROUP BY {key}""",
    }


def _join(ids: str, separator: str = " ") -> str:
    return f"array_to_string({ids}, '{separator}')"


def build() -> dict[str, str]:
    q: dict[str, str] = {}
    q["src_raw"] = _with("SELECT * REPLACE (nullif(headline, '') AS headline, nullif(human_summary, '') AS human_summary) FROM v_raw")
    q["src_excel"] = _with(
        "SELECT * REPLACE (nullif(headline, '') AS headline, nullif(article_text, '') AS article_text, nullif(human_summary, '') AS human_summary) FROM v_raw"
    )
    q["src_formats"] = _with("SELECT * EXCLUDE (article_text) FROM v_raw, (VALUES ('json'), ('parquet'), ('orc')) t(format)")
    # The text as JSON, with quotes around it, as Spark writes it; a bad line is the whole line.
    line = """'{"doc_id": ' || CASE WHEN doc_id % 13 = 0 THEN '"no ' || doc_id || '"' ELSE doc_id::VARCHAR END || ', "headline":"'
        || CASE WHEN doc_id % 13 = 0 THEN 'no ' ELSE '' END || doc_id || '"' || coalesce(',"article_text":' || to_json(text)::VARCHAR, '')"""
    q["bad_rows"] = f"""
        SELECT doc_id, CASE WHEN doc_id % 13 = 0 OR doc_id % 17 = 0 THEN 'bad' ELSE 'fits' END AS state,
          CASE WHEN doc_id % 13 = 0 OR doc_id % 17 = 0 THEN length({line}) + CASE WHEN doc_id % 17 = 0 THEN 0 ELSE 1 END ELSE length(text) END AS n_chars
        FROM documents"""
    q["sink_roundtrip"] = _with(f"SELECT doc_id, source, strftime(date, '%Y-%m-%d') AS date, year, headline, articles_clean, summary_clean, category, article_token_count, summary_token_count, {_r('compression_ratio')} AS compression_ratio FROM v_docs")
    q["sink_splits"] = _with("SELECT doc_id, source, d.n_chars, split FROM v_split JOIN documents d USING (doc_id)")
    q["eval_report"] = _with(
        """
        SELECT 'third-overlap' AS model, num_samples, round(p, 4) AS precision, round(r, 4) AS recall, round(f, 4) AS f1,
               round(h, 4) AS hallucination_rate, round(e, 4) AS avg_entailment, round(c, 4) AS avg_contradiction,
               round(pe, 1) AS pct_entailed, round(pc, 1) AS pct_contradicted, round(t, 4) AS avg_overlap, round(po, 1) AS pct_off_topic,
               CASE WHEN p > 0.7 AND e > 0.5 AND t > 0.5 THEN 'GOOD' WHEN p > 0.5 AND e > 0.3 THEN 'FAIR' ELSE 'POOR' END AS verdict,
               CAST(p > 0.7 AS VARCHAR) AS pass_entity_precision, CAST(e > 0.5 AS VARCHAR) AS pass_entailment,
               CAST(t > 0.5 AS VARCHAR) AS pass_topic_overlap, CAST(h < 0.2 AS VARCHAR) AS pass_hallucination_rate,
               (SELECT string_agg(pair_id, ' ' ORDER BY pair_id) FROM (SELECT pair_id FROM v_scored2 ORDER BY pair_id LIMIT 30)) AS sample_ids
        FROM (SELECT count(*) AS num_samples, avg(prec) AS p, avg(rec) AS r, avg(f1) AS f, sum(len(hall)) / greatest(sum(n_ent), 1) AS h,
                     avg(entailment) AS e, avg(contradiction) AS c, count(*) FILTER (entailment > 0.5) * 100.0 / greatest(count(entailment), 1) AS pe,
                     count(*) FILTER (contradiction > 0.5) * 100.0 / greatest(count(entailment), 1) AS pc, avg(topic) AS t,
                     count(*) FILTER (topic < 0.3) * 100.0 / count(*) AS po FROM v_scored2)""",
        _SCORED,
    )
    q["eval_samples"] = _with(
        f"""
        SELECT pair_id AS id, left(source, 500) AS source_excerpt, reference, generated, {_r("prec")} AS entity_precision,
               {_join("list_slice(hall, 1, 5)", "|")} AS hallucinated_entities, {_r("entailment")} AS entailment, {_r("topic")} AS topic_overlap
        FROM v_scored2""",
        _SCORED,
    )
    q["reports_flatten"] = _with(f"SELECT {_BENCH_COLUMNS} FROM v_stats")
    q["standardize"] = _with(
        "SELECT doc_id, newspaper_name AS source, published_date AS date, headline, article_text AS articles, human_summary AS summary, news_category AS category FROM v_raw"
    )
    q["clean_columns"] = _with(
        "SELECT doc_id, coalesce(source, 'nan') AS source, headline, articles_clean, summary_clean, coalesce(category, 'nan') AS category, headline_clean FROM v_std"
    )
    q["date_parse"] = _with("SELECT doc_id, strftime(date, '%Y-%m-%d') AS day, year, CAST(date IS NULL AS VARCHAR) AS is_bad FROM v_std")
    q["compression"] = _with(
        f"SELECT {_r('avg(compression_ratio)')} AS mean_of_ratios, {_r('avg(article_token_count) / avg(summary_token_count)')} AS ratio_of_means, count(compression_ratio) AS n_valid FROM v_docs"
    )
    q["token_counts"] = _with(
        f"SELECT doc_id, {_n_tokens('articles_clean')} AS article_tokens, {_n_tokens('summary_clean')} AS summary_tokens, {_n_tokens(_collapse('articles'))} AS raw_tokens FROM v_std"
    )
    q["word_counts"] = r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS BIGINT) AS n_words FROM documents"
    q["html_strip"] = f"SELECT page_id, {_clean_html('html')} AS text FROM pages"
    q["url_strip"] = f"SELECT page_id, {_strip_urls(_collapse('html'))} AS text FROM pages"
    q["email_strip"] = f"SELECT doc_id, {_strip_emails(_collapse('text'))} AS text FROM documents"
    q["clean_text"] = _with("SELECT doc_id, text, length(text) AS n_chars FROM v_cleaned")
    q["clean_pages"] = f"SELECT page_id, {_clean('html')} AS text FROM pages"
    q["vocab"] = _with(f"{_vocabulary('articles', 'articles_clean')} UNION ALL {_vocabulary('summaries', 'summary_clean')}")
    counted = f"SELECT token, count(*) AS n FROM (SELECT unnest({_tokens('lower(text)')}) AS token FROM v_cleaned) GROUP BY token"
    q["vocab_tokens"] = _with(counted)
    q["vocab_whole"] = _with(
        f"SELECT CAST(sum(n) AS BIGINT) AS n_tokens, count(*) AS n_types, {_r('count(*) / CAST(sum(n) AS DOUBLE)')} AS type_token_ratio FROM ({counted})"
    )
    q["keywords"] = _with(f"SELECT doc_id, {_join('k')} AS keywords, len(k) AS n_keywords FROM (SELECT doc_id, {_keywords('text')} AS k FROM v_cleaned)")
    q["sentences"] = _with(
        f"SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS pos FROM (SELECT doc_id, {_sentences('text')} AS s FROM v_cleaned)"
    )
    q["sentences_topn"] = _with(
        f"SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS pos FROM (SELECT doc_id, list_slice({_sentences('text')}, 1, 30) AS s FROM v_cleaned)"
    )
    packed = f"SELECT doc_id, list_resize(list_slice({_sentences('text')}, 1, 30), 30, '') AS s FROM v_cleaned"
    q["pack_sentences"] = _with(f"SELECT doc_id, {_join('s', '|||')} AS packed FROM ({packed})")
    q["unpack_sentences"] = _with(
        f"""
        SELECT doc_id, n AS n_filled, repeat('1', least(n, 30)) || repeat('0', 30 - least(n, 30)) AS mask, replace(p, '|||', ' ') AS text
        FROM (SELECT doc_id, p, len(list_filter(string_split(p, '|||'), lambda x: trim(x) <> '')) AS n
              FROM (SELECT doc_id, {_join('s', '|||')} AS p FROM ({packed})))"""
    )

    def found(view: str) -> str:
        runs = f"(SELECT doc_id, string_split(lower(run), ' ') AS w FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_NAME}')) AS run FROM {view}))"
        pairs = "list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])"
        return f"SELECT doc_id, unnest(w) AS entity FROM {runs} UNION SELECT doc_id, unnest({pairs}) FROM {runs}"

    q["entities"] = _with(
        f"SELECT doc_id, entity, label FROM ({found('v_cleaned')}) JOIN v_gazetteer USING (entity) WHERE label IN ('PERSON', 'ORG', 'GPE', 'LOC')"
    )
    q["entity_mentions"] = _with(f"SELECT doc_id, unnest({_mentions('text', _NAME)}) AS entity FROM v_cleaned")
    months = "(?:January|February|March|April|May|June|July|August|September|October|November|December)"
    dates = f"{months} [0-9]{{1,2}}, [0-9]{{4}}|[0-9]{{1,2}} {months} [0-9]{{4}}|{months} [0-9]{{4}}|[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}"
    money = r"(?:[$€£₹]|Rs\.?|USD|EUR|INR) ?[0-9][0-9,]*(?:\.[0-9]+)?(?: (?:million|billion|crore|lakh))?"
    q["entities_typed"] = _with(
        f"""
        SELECT doc_id, entity, label FROM ({found('v_dated')}) JOIN v_gazetteer USING (entity)
        UNION SELECT doc_id, unnest({_mentions('text', dates)}), 'DATE' FROM v_dated
        UNION SELECT doc_id, unnest({_mentions('text', money)}), 'MONEY' FROM v_dated""",
        {"v_dated": "SELECT doc_id, concat_ws(' ', strftime(date, '%Y-%m-%d'), '$' || length(articles_clean), articles_clean) AS text FROM v_std"},
    )
    opening = "'Summarize the articles below in a few factual sentences; state nothing they do not state.' || chr(10) || chr(10) || 'Articles:' || chr(10)"
    prompt = f"{opening} || articles_clean || chr(10) || chr(10) || 'Summary:'"
    q["sft_records"] = _with(f"SELECT doc_id, {prompt} AS prompt, {prompt} || ' ' || summary_clean || '[EOS]' AS full_text FROM v_docs")
    q["cluster_concat"] = _with(
        "SELECT cluster_id, count(*) AS n_docs, string_agg(text, ' [DOC] ' ORDER BY doc_pos) AS text FROM v_cluster_docs GROUP BY cluster_id"
    )
    q["vocabulary_ids"] = _with("SELECT * FROM v_vocab")
    q["encode_tokens"] = _with(f"SELECT doc_id, {_join('ids')} AS ids FROM v_ids", _encoded("v_cleaned", "doc_id", _tokens("lower(text)"), "v_ids"))
    slots = {
        "v_sent": f"SELECT doc_id, s.slot, s.sentence FROM (SELECT doc_id, unnest(list_transform(list_resize(list_slice({_sentences('text')}, 1, 30), 30, ''), lambda x, i: {{'slot': i - 1, 'sentence': x}})) AS s FROM v_cleaned)",
        "v_key": "SELECT doc_id * 30 + slot AS k, sentence FROM v_sent",
        **_encoded("v_key", "k", f"list_slice({_tokens('lower(sentence)')}, 1, 64)", "v_slot_ids"),
    }
    q["rec_sentences"] = _with(
        f"""
        SELECT k // 30 AS doc_id, count(*) FILTER (len(ids) > 0) AS n_sentences,
               string_agg({_join(_padded('ids', 64, 0))}, ' ' ORDER BY k) AS input_ids,
               string_agg({_join(_mask('ids', 64))}, ' ' ORDER BY k) AS attention_mask
        FROM v_slot_ids GROUP BY k // 30""",
        slots,
    )
    both = {
        **_encoded("v_std", "doc_id", f"list_slice({_tokens('lower(articles_clean)')}, 1, 1024)", "v_a"),
        **_encoded("v_std", "doc_id", f"list_slice({_tokens('lower(summary_clean)')}, 1, 128)", "v_s"),
    }
    q["rec_seq2seq"] = _with(
        f"""
        SELECT doc_id, {_join(_padded('v_a.ids', 1024, 0))} AS input_ids, {_join(_mask('v_a.ids', 1024))} AS attention_mask,
               {_join(_padded('v_s.ids', 128, -100))} AS labels FROM v_a JOIN v_s USING (doc_id)""",
        both,
    )
    chats = {
        **_encoded("v_chat", "pair_id", f"list_slice({_tokens('lower(source)')}, 1, 2048)", "v_p"),
        **_encoded("v_chat", "pair_id", f"list_slice({_tokens('lower(generated)')}, 1, 2048)", "v_c"),
        "v_full": "SELECT pair_id, len(v_p.ids) AS n, list_slice(list_concat(list_concat(v_p.ids, v_c.ids), [2]), 1, 2048) AS ids FROM v_p JOIN v_c USING (pair_id)",
    }
    q["rec_causal"] = _with(
        f"""
        SELECT pair_id, n AS prompt_len, {_join(_padded('ids', 2048, 0))} AS input_ids, {_join(_mask('ids', 2048))} AS attention_mask,
               {_join(_padded("list_transform(ids, lambda x, i: CASE WHEN i <= n THEN -100 ELSE x END)", 2048, -100))} AS labels FROM v_full""",
        chats,
    )
    q["head_n"] = "SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 500"
    q["batch_manifest"] = """
        SELECT epoch, (rn - 1) // 2 AS batch_id, (rn - 1) // 8 AS step_id, (rn - 1) % 2 AS pos, doc_id
        FROM (SELECT epoch, doc_id, row_number() OVER (PARTITION BY epoch ORDER BY md5('42:' || epoch || ':' || doc_id), doc_id) AS rn
              FROM documents, range(1, 3) t(epoch))"""
    q["len_filter"] = _with("SELECT doc_id, length(articles_clean) AS n_chars FROM v_long")
    q["clean_funnel"] = _with(
        """
        SELECT a AS n_in, a - b AS n_short, b - c AS n_copies, c AS n_out
        FROM (SELECT (SELECT count(*) FROM v_std) AS a, (SELECT count(*) FROM v_long) AS b, (SELECT count(DISTINCT articles_clean) FROM v_long) AS c)"""
    )
    q["trim_p99"] = _with(
        f"SELECT doc_id, {_r('compression_ratio')} AS compression_ratio FROM v_docs WHERE compression_ratio < (SELECT quantile_cont(compression_ratio, 0.99) FROM v_docs)"
    )
    q["no_sentences"] = _with(f"SELECT doc_id FROM v_cleaned WHERE len({_sentences('text')}) = 0")
    q["dedup_apart"] = "SELECT doc_id, source, lang, md5(text) AS text_md5 FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1"
    q["dedup_exact"] = _with("SELECT min(doc_id) AS doc_id, text FROM v_cleaned GROUP BY text")
    q["shuffle_rank"] = _with("SELECT doc_id, rank FROM v_ranked")
    q["split_exact"] = _with("SELECT doc_id, split FROM v_split")
    q["split_report"] = _with(
        f"SELECT split, count(*) AS n_rows, {_r('count(*) / CAST(max(n) AS DOUBLE)')} AS share, {_r('avg(n_chars)')} AS avg_n_chars FROM v_split GROUP BY split"
    )
    q["eval_slice"] = _with(
        """
        SELECT doc_id, n_chars
        FROM (SELECT doc_id, length(articles_clean) AS n_chars, row_number() OVER (ORDER BY doc_id) AS rn, count(*) OVER () AS n FROM v_long)
        WHERE rn > floor(n * CAST(0.9 AS DOUBLE)) AND rn <= floor(n * CAST(0.9 AS DOUBLE)) + 50"""
    )
    q["sample_n"] = "SELECT doc_id, n_chars FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 10000"
    q["sample_lines"] = (
        f"SELECT o_orderkey AS order_id, {_r('CAST(o_totalprice AS DOUBLE)')} AS o_totalprice FROM orders ORDER BY md5('42:' || o_orderkey), o_orderkey LIMIT 10000"
    )
    q["split_leakage"] = _with(
        "SELECT split, count(*) AS n_rows, count(*) FILTER (place > floor(n * CAST(0.9 AS DOUBLE))) AS n_in_eval_slice FROM v_split GROUP BY split"
    )
    q["token_stats"] = _with(f"{_length_stats('article_token_count')} UNION ALL {_length_stats('summary_token_count')}")
    q["category_counts"] = _with(_counts("category", 10))
    q["source_counts"] = _with(_counts("source", 10))
    q["cluster_stats"] = _sized("v_docs", "category")
    q["source_stats"] = _sized("v_raw", "newspaper_name")
    q["temporal"] = _with(
        "SELECT min(year) AS first_year, max(year) AS last_year, max(year) - min(year) AS span, count(year) AS n_valid, count(*) AS n_rows FROM v_docs"
    )
    q["missing"] = _with(
        " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS n_missing, round((count(*) - count({c})) * 100.0 / count(*), 2) AS percent_missing FROM v_raw"
            for c in ("doc_id", "newspaper_name", "published_date", "headline", "article_text", "human_summary", "news_category")
        )
    )
    types = (
        ("doc_id", "bigint"), ("source", "string"), ("date", "timestamp"), ("year", "int"), ("headline", "string"), ("articles_clean", "string"),
        ("summary_clean", "string"), ("category", "string"), ("article_token_count", "bigint"), ("summary_token_count", "bigint"), ("compression_ratio", "double"),
    )
    q["schema_report"] = _with(
        " UNION ALL ".join(
            f"SELECT CAST({i} AS BIGINT) AS position, '{c}' AS \"column\", '{t}' AS type, count({c}) AS n_values FROM v_docs" for i, (c, t) in enumerate(types, 1)
        )
    )
    q["histogram"] = _with(_histogram("v_x"), {"v_x": "SELECT CAST(article_token_count AS DOUBLE) AS x FROM v_docs"})
    q["ratio_histogram"] = _with(
        _histogram("v_x"),
        {"v_x": "SELECT compression_ratio AS x FROM v_docs WHERE compression_ratio < (SELECT quantile_cont(compression_ratio, 0.99) FROM v_docs)"},
    )
    q["cluster_histogram"] = _with(_histogram("v_x"), {"v_x": "SELECT CAST(count(*) AS DOUBLE) AS x FROM v_docs WHERE source IS NOT NULL GROUP BY source"})
    q["top8_share"] = _with(
        f"""
        SELECT source, n_rows, {_r("n_rows * 100.0 / sum(n_rows) OVER ()")} AS percent_shown
        FROM (SELECT source, count(*) AS n_rows FROM v_docs WHERE source IS NOT NULL GROUP BY source ORDER BY n_rows DESC, source LIMIT 8)"""
    )
    q["boxplot"] = _with(_box("article_token_count"))
    q["boxplot_summary"] = _with(_box("summary_token_count"))
    q["length_pairs"] = _with("SELECT doc_id, article_token_count, summary_token_count FROM v_docs ORDER BY md5('42:' || doc_id), doc_id LIMIT 10000")

    def cell(c: str) -> str:
        edge = f"(SELECT min({c}) + CAST(b AS DOUBLE) * ((CAST(max({c}) AS DOUBLE) - min({c})) / 50) AS e, b FROM v_docs, range(1, 50) t(b) GROUP BY b)"
        return f"(SELECT count(*) FROM {edge} WHERE e <= {c})"

    q["length_grid"] = _with(
        f"""
        SELECT x_bin, y_bin, count(*) AS n
        FROM (SELECT {cell("article_token_count")} AS x_bin, {cell("summary_token_count")} AS y_bin
              FROM (SELECT article_token_count, summary_token_count FROM v_docs) d) GROUP BY x_bin, y_bin"""
    ).replace("WHERE e <= article_token_count", "WHERE e <= d.article_token_count").replace(
        "WHERE e <= summary_token_count", "WHERE e <= d.summary_token_count"
    )
    q["corpus_report"] = _with(
        f"""
        SELECT count(*) AS n_rows, CAST(11 AS BIGINT) AS n_columns, {_r("avg(article_token_count)")} AS avg_article_tokens,
               min(article_token_count) AS min_article_tokens, max(article_token_count) AS max_article_tokens,
               {_r("avg(summary_token_count)")} AS avg_summary_tokens, min(summary_token_count) AS min_summary_tokens,
               max(summary_token_count) AS max_summary_tokens, count(DISTINCT category) AS n_categories, count(DISTINCT source) AS n_sources
        FROM v_docs"""
    )
    q["pairs"] = _with("SELECT pair_id, source, generated, reference FROM v_pairs")
    q["entity_overlap"] = _with(
        "SELECT pair_id, len(g) AS n_generated, len(list_intersect(g, s)) AS n_in_source, len(list_intersect(g, r)) AS n_in_reference FROM v_pair_entities"
    )
    q["hallucinated"] = _with(f"SELECT pair_id, len(missing) AS n_hallucinated, {_join('list_slice(missing, 1, 5)')} AS entities FROM v_pair_scores")
    q["sim_edges"] = _with("SELECT * FROM v_sim")
    q["entity_edges"] = _with("SELECT * FROM v_shared")
    q["entity_groups"] = _with("SELECT cluster_id, CAST(entity AS VARCHAR) AS entity, pos, count(*) OVER (PARTITION BY cluster_id, entity) - 1 AS others FROM v_vec")
    q["adjacency"] = _with("SELECT * FROM v_adj")
    q["adjacency_cluster"] = _with("SELECT * FROM v_cluster_adj")
    q["graph_degree"] = _with(
        f"""
        SELECT cluster_id, count(*) AS n_nodes, CAST(sum(d) // 2 AS BIGINT) AS n_edges, {_r("avg(d)")} AS mean_degree, max(d) AS max_degree,
               count(*) FILTER (d = 0) AS n_isolated
        FROM (SELECT cluster_id, src, count(*) - 1 AS d FROM v_adj GROUP BY cluster_id, src) GROUP BY cluster_id"""
    )
    dims = "SELECT cluster_id, pos AS node, k AS dim, {0} AS value FROM {1}"
    q["gat_layer"] = _with(dims.format(_r("value"), "v_vec_dims"), _layer("v_vec", 64))
    second = {k.replace("v_vec_out_", "v_two_"): s for k, s in _layer("v_vec_out", 8).items()}
    q["gat_two_layer"] = _with(
        dims.format(_r("value"), "v_two_dims"), {**_layer("v_vec", 64), **{k: s.replace("v_vec_out_", "v_two_") for k, s in second.items()}}
    )
    q["extract_summary"] = _with(
        """
        SELECT cluster_id, count(*) AS n_sentences, string_agg(sentence, ' ' ORDER BY pos) AS summary
        FROM (SELECT s.cluster_id, pos, sentence, row_number() OVER (PARTITION BY s.cluster_id ORDER BY d DESC, pos) AS rn
              FROM v_cluster_sentences s
              JOIN (SELECT cluster_id, src, count(*) - 1 AS d FROM v_cluster_adj GROUP BY cluster_id, src) g ON g.cluster_id = s.cluster_id AND g.src = s.pos)
        WHERE rn <= 3 GROUP BY cluster_id"""
    )
    q["cluster_inputs"] = _with(
        f"""
        SELECT cluster_id, count(*) AS n_sentences, {_join("list_resize(list(sentence ORDER BY pos), 30, '')", "|||")} AS packed
        FROM v_cluster_slots GROUP BY cluster_id"""
    )
    f1 = "CASE WHEN p + c > 0 THEN 2 * p * c / (p + c) ELSE 0 END"
    q["entity_prf"] = _with(
        f"""
        SELECT pair_id, {_r("p")} AS entity_precision, {_r("c")} AS entity_recall, {_r(f1)} AS entity_f1, len(g) AS n_entities,
               len(missing) AS n_hallucinated FROM v_pair_scores"""
    )
    q["entity_report"] = _with(
        f"""
        SELECT {_r("avg(p)")} AS precision, {_r("avg(c)")} AS recall, {_r(f"avg({f1})")} AS f1, CAST(sum(len(missing)) AS BIGINT) AS n_hallucinated,
               CAST(sum(len(g)) AS BIGINT) AS n_entities, {_r("sum(len(missing)) / greatest(sum(len(g)), 1)")} AS hallucination_rate FROM v_pair_scores"""
    )
    q["nli_softmax"] = _with(f"SELECT pair_id, {_r('contradiction')} AS contradiction, {_r('entailment')} AS entailment, {_r('neutral')} AS neutral FROM v_logits")
    q["nli_report"] = _with(
        f"""
        SELECT {_r("avg(entailment)")} AS avg_entailment, {_r("avg(contradiction)")} AS avg_contradiction,
               count(*) FILTER (entailment > 0.5) AS n_entailed, count(*) FILTER (contradiction > 0.5) AS n_contradicted,
               {_r("count(*) FILTER (entailment > 0.5) * 100.0 / count(*)")} AS pct_entailed,
               {_r("count(*) FILTER (contradiction > 0.5) * 100.0 / count(*)")} AS pct_contradicted FROM v_logits"""
    )
    topic = f"""
        SELECT pair_id, source, generated, CASE WHEN len(gk) = 0 THEN 0.0 ELSE len(list_intersect(gk, sk)) / CAST(len(gk) AS DOUBLE) END AS t
        FROM (SELECT *, {_keywords("generated")} AS gk, {_keywords("source")} AS sk FROM v_chat)"""
    q["topic_overlap"] = _with(f"SELECT pair_id, {_r('t')} AS topic_overlap FROM ({topic})")
    q["topic_report"] = _with(
        f"""
        SELECT {_r("avg(t)")} AS avg_overlap, count(*) FILTER (t < 0.3) AS n_off_topic, {_r("count(*) FILTER (t < 0.3) * 100.0 / count(*)")} AS pct_off_topic
        FROM ({topic})"""
    )
    q["worst_k"] = _with(
        f"""
        SELECT pair_id, {_r("p")} AS entity_precision, {_r("coalesce(entailment, 0)")} AS entailment, {_r("t")} AS topic_overlap,
               {_join("list_slice(list_sort(list_filter(g, lambda x: NOT list_contains(s, x))), 1, 5)", "|")} AS hallucinated,
               left(source, 200) AS source, left(generated, 200) AS generated, left(source, 200) AS reference
        FROM (SELECT *, CASE WHEN len(g) = 0 THEN 1.0 ELSE len(list_intersect(g, s)) / CAST(len(g) AS DOUBLE) END AS p
              FROM (SELECT *, {_mentions("generated", _CAPITALIZED)} AS g, {_mentions("source", _CAPITALIZED)} AS s FROM ({topic})))
        LEFT JOIN (SELECT * REPLACE (pair_id || '-0' AS pair_id) FROM v_logits) USING (pair_id) ORDER BY p, pair_id LIMIT 5"""
    )
    q["verdict"] = _with(
        f"""
        SELECT model, {_r("e")} AS entailment, {_r("p")} AS precision, {_r("t")} AS topic,
               CASE WHEN p > 0.7 AND e > 0.5 AND t > 0.5 THEN 'GOOD' WHEN p > 0.5 AND e > 0.3 THEN 'FAIR' ELSE 'POOR' END AS verdict
        FROM (SELECT pair_id % 10 AS model, avg(entailment) AS e, avg(1 - contradiction) AS p, avg(1 - neutral) AS t FROM v_logits GROUP BY pair_id % 10)"""
    )
    q["rouge1"] = _rouge_query(1)
    # Row by row: the best of the cells above and of a match across, then the running maximum along the row.
    longest = """
        SELECT pair_id, g, r, 0 AS i, list_transform(range(0, len(r)), lambda j: 0) AS row FROM v_chat_tokens
        UNION ALL
        SELECT pair_id, g, r, i + 1, list_transform(range(1, len(r) + 1), lambda j: list_max(cand[1:j])) FROM (
          SELECT *, list_transform(range(1, len(r) + 1),
            lambda j: greatest(row[j], CASE WHEN j > 1 THEN row[j - 1] ELSE 0 END + CASE WHEN g[i + 1] = r[j] THEN 1 ELSE 0 END)) AS cand
          FROM v_longest WHERE i < len(g))"""
    chat_tokens = (
        "SELECT pair_id, "
        + ", ".join(f"list_filter(string_split(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda t: t <> '') AS {n}" for c, n in (("generated", "g"), ("source", "r")))
        + " FROM v_chat"
    )
    q["rouge_l_chat"] = _with(
        f"""
        SELECT pair_id, CAST(l AS BIGINT) AS lcs, {_r("p")} AS precision, {_r("c")} AS recall, {_r("CASE WHEN p + c > 0 THEN 2 * p * c / (p + c) ELSE 0.0 END")} AS f1
        FROM (SELECT *, CASE WHEN len(g) > 0 THEN l / CAST(len(g) AS DOUBLE) ELSE 0.0 END AS p, CASE WHEN len(r) > 0 THEN l / CAST(len(r) AS DOUBLE) ELSE 0.0 END AS c
              FROM (SELECT pair_id, g, r, coalesce(list_max(row), 0) AS l FROM v_longest WHERE i = len(g)))""",
        {"v_chat_tokens": chat_tokens, "v_longest": longest},
    ).replace("WITH ", "WITH RECURSIVE ", 1)
    q["rouge2"] = _rouge_query(2)
    q["rouge_report"] = _with(
        f"SELECT count(*) AS n_pairs, {_r('avg(a.f)')} AS rouge1, {_r('avg(b.f)')} AS rouge2 FROM v_rouge1 a JOIN v_rouge2 b USING (pair_id)",
        {**_rouge(1), **_rouge(2)},
    )
    vector_scores = f"""
        SELECT pair_id, {_r("p")} AS precision, {_r("r")} AS recall, {_r("2 * p * r / (p + r)")} AS f1
        FROM (SELECT pair_id, avg(best) AS p FROM (SELECT pair_id, a, max(x) AS best FROM v_cos GROUP BY pair_id, a) GROUP BY pair_id)
        JOIN (SELECT pair_id, avg(best) AS r FROM (SELECT pair_id, b, max(x) AS best FROM v_cos GROUP BY pair_id, b) GROUP BY pair_id) USING (pair_id)"""
    vector_views = {
        "v_tv": "SELECT vec_id, vec_id // 20 AS pair_id, vec_id % 2 AS side, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vec FROM embeddings",
        "v_cos": """
            SELECT a.pair_id, a.vec_id AS a, b.vec_id AS b,
                   list_dot_product(a.vec, b.vec) / sqrt(list_dot_product(a.vec, a.vec)) / sqrt(list_dot_product(b.vec, b.vec)) AS x
            FROM v_tv a JOIN v_tv b ON a.pair_id = b.pair_id AND a.side = 0 AND b.side = 1""",
    }
    q["rouge_bootstrap"] = _with(
        f"""
        SELECT metric, {_r("real")} AS mean, {_r("quantile_cont(mean, 0.025)")} AS low, {_r("quantile_cont(mean, 0.5)")} AS mid, {_r("quantile_cont(mean, 0.975)")} AS high
        FROM v_means JOIN (SELECT metric, avg(value) AS real FROM v_scores GROUP BY metric) USING (metric) GROUP BY metric, real""",
        {
            **_rouge(1),
            **_rouge(2),
            "v_scores": "SELECT pair_id, 'rouge1' AS metric, f AS value FROM v_rouge1 UNION ALL SELECT pair_id, 'rouge2', f FROM v_rouge2",
            "v_means": so.bootstrap(200),
        },
    )
    of_stems = lambda n: {k: s.replace("v_tokens", "v_stemmed") for k, s in _rouge(n).items()}
    q["rouge_stemmed"] = _with(f"SELECT pair_id, {_r('p')} AS precision, {_r('c')} AS recall, {_r('f')} AS f1 FROM v_rouge1", {**so.stem_views("v_tokens"), **of_stems(1)})
    in_chats = {
        **{k: s.replace("v_pair_entities", "v_chat_entities").replace("v_pairs", "v_chat_pairs").replace("v_logits", "v_chat_logits") for k, s in _SCORED.items()},
        "v_chat_pairs": "SELECT pair_id, source, generated, source AS reference FROM v_chat",
        "v_chat_entities": f"SELECT *, s AS r FROM (SELECT pair_id, {_mentions('source', _CAPITALIZED)} AS s, {_mentions('generated', _CAPITALIZED)} AS g FROM v_chat)",
        "v_chat_logits": "SELECT * REPLACE (pair_id || '-0' AS pair_id) FROM v_logits",
    }
    q["score_report_chat"] = _with(
        f"""
        SELECT 'chat' AS model, (SELECT count(*) FROM v_chat) AS num_samples, (SELECT round(avg(f), 4) FROM v_rouge1) AS rouge1, (SELECT round(avg(f), 4) FROM v_rouge2) AS rouge2,
          (SELECT round(avg(CASE WHEN l > 0 THEN 2.0 * l / (len(g) + len(r)) ELSE 0 END), 4) FROM (SELECT g, r, coalesce(list_max(row), 0) AS l FROM v_longest WHERE i = len(g))) AS "rougeL",
          (SELECT round(score, 2) FROM v_bleu) AS bleu, (SELECT round(avg(latency), 4) FROM v_latency) AS mean_latency_sec,
          (SELECT round(sum(tokens) / sum(latency), 1) FROM v_latency) AS throughput_tokens_per_sec, (SELECT round(avg(f1), 4) FROM v_greedy) AS bertscore_f1,
          round(p, 4) AS precision, round(r, 4) AS recall, round(f, 4) AS f1, round(h, 4) AS hallucination_rate, round(e, 4) AS avg_entailment,
          round(c, 4) AS avg_contradiction, round(pe, 1) AS pct_entailed, round(pc, 1) AS pct_contradicted, round(t, 4) AS avg_overlap, round(po, 1) AS pct_off_topic,
          CASE WHEN p > 0.7 AND e > 0.5 AND t > 0.5 THEN 'GOOD' WHEN p > 0.5 AND e > 0.3 THEN 'FAIR' ELSE 'POOR' END AS verdict
        FROM (SELECT avg(prec) AS p, avg(rec) AS r, avg(f1) AS f, sum(len(hall)) / greatest(sum(n_ent), 1) AS h, coalesce(avg(entailment), 0.0) AS e,
                coalesce(avg(contradiction), 0.0) AS c, count(*) FILTER (entailment > 0.5) * 100.0 / greatest(count(entailment), 1) AS pe,
                count(*) FILTER (contradiction > 0.5) * 100.0 / greatest(count(entailment), 1) AS pc, avg(topic) AS t,
                count(*) FILTER (topic < 0.3) * 100.0 / count(*) AS po FROM v_scored2)""",
        {
            **in_chats,
            "v_chat_tokens": chat_tokens,
            **so.stem_views("v_chat_tokens"),
            **of_stems(1),
            **of_stems(2),
            "v_longest": longest.replace("v_chat_tokens", "v_stemmed"),
            **_bleu_views("v_chat_pairs"),
            "v_bleu": so.bleu_value(),
            **vector_views,
            "v_greedy": vector_scores,
        },
    ).replace("WITH ", "WITH RECURSIVE ", 1)
    q["bleu"] = _bleu()
    q["greedy_vector_f1"] = _with(vector_scores, vector_views)
    q["latency"] = _with(
        f"""
        SELECT model, n_samples, {_r("mean_latency")} AS mean_latency, {_r("samples_per_sec")} AS samples_per_sec, {_r("tokens_per_sec")} AS tokens_per_sec,
               {_r("avg_tokens")} AS avg_tokens, {_r("median_latency")} AS median_latency, {_r("p95_latency")} AS p95_latency FROM v_stats"""
    )
    board = {
        "v_board": """
            SELECT 'mean_latency' AS metric, model, mean_latency AS value, rank() OVER (ORDER BY mean_latency) AS place FROM v_stats
            UNION ALL SELECT 'p95_latency', model, p95_latency, rank() OVER (ORDER BY p95_latency) FROM v_stats
            UNION ALL SELECT 'tokens_per_sec', model, tokens_per_sec, rank() OVER (ORDER BY tokens_per_sec DESC) FROM v_stats"""
    }
    q["leaderboard"] = _with(f"SELECT metric, model, {_r('value')} AS value, place FROM v_board", board)
    q["best_models"] = _with(f"SELECT metric, model, {_r('value')} AS value FROM v_board WHERE place = 1", board)
    rules = (
        ("median <= p95", "median_latency <= p95_latency"), ("median <= mean", "median_latency <= mean_latency"),
        ("rate is 1 / mean", "abs(mean_latency * samples_per_sec - 1) < 1e-9"), ("more than 2000 samples", "n_samples > 2000"),
    )
    q["report_checks"] = _with(
        " UNION ALL ".join(
            f"SELECT '{name}' AS rule, count(*) AS n_rows, count(*) FILTER (NOT ({rule})) AS n_broken, count(*) FILTER (({rule}) IS NULL) AS n_unknown FROM v_stats"
            for name, rule in rules
        )
    )
    languages = {
        "v_languages": """
            SELECT lang AS model, count(*) AS n, sum(d.n_chars) AS chars, avg(a.f) AS rouge1, avg(b.f) AS rouge2
            FROM documents d JOIN v_rouge1 a ON a.pair_id = doc_id JOIN v_rouge2 b ON b.pair_id = doc_id GROUP BY lang""",
        **_rouge(1),
        **_rouge(2),
    }
    q["trainings_flatten"] = _with(
        f"""
        SELECT model, n AS train_samples, 1::BIGINT AS epochs, (n + 7) // 8 AS total_steps, {_r("chars / 1000")} AS training_time_sec, 1::BIGINT AS n_losses,
               n AS eval_samples, {_r("rouge1")} AS rouge1, {_r("rouge2")} AS rouge2 FROM v_languages""",
        languages,
    )
    # No report has a ROUGE-L, so rules on it are unknown, and a range holds only if no known part breaks it.
    q["rouge_rules"] = _with(
        """
        SELECT 'rouge2 <= rouge1' AS rule, count(*) AS n_rows, count(*) FILTER (rouge2 > rouge1) AS n_broken, 0::BIGINT AS n_unknown FROM v_languages
        UNION ALL SELECT 'rougeL <= rouge1', count(*), 0, count(*) FROM v_languages
        UNION ALL SELECT 'scores in [0, 1]', count(*), count(*) FILTER (rouge1 NOT BETWEEN 0 AND 1 OR rouge2 NOT BETWEEN 0 AND 1),
               count(*) FILTER (rouge1 BETWEEN 0 AND 1 AND rouge2 BETWEEN 0 AND 1) FROM v_languages""",
        languages,
    )
    q["quality_board"] = _with(
        f"""
        SELECT 'rouge1' AS metric, model, {_r("rouge1")} AS value, rank() OVER (ORDER BY rouge1 DESC) AS place FROM v_languages
        UNION ALL SELECT 'rouge2', model, {_r("rouge2")}, rank() OVER (ORDER BY rouge2 DESC) FROM v_languages""",
        languages,
    )
    q["run_steps"] = _with(f"SELECT run, step, epoch, {_r('loss')} AS loss FROM v_run")
    q["running_loss"] = _with(
        f"SELECT run, step, epoch, {_r('loss')} AS loss, {_r('avg(loss) OVER (PARTITION BY run ORDER BY step)')} AS running_mean FROM v_run"
    )
    q["running_epoch_loss"] = _with(
        f"SELECT run, step, epoch, {_r('loss')} AS loss, {_r('avg(loss) OVER (PARTITION BY run, epoch ORDER BY step)')} AS running_mean FROM v_run"
    )
    q["epoch_loss"] = _with(f"SELECT run, epoch, n_batches, {_r('avg_loss')} AS avg_loss FROM v_epochs")
    q["best_so_far"] = _with(
        f"""
        SELECT run, epoch, n_batches, {_r("avg_loss")} AS avg_loss
        FROM (SELECT *, min(avg_loss) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM v_epochs)
        WHERE m IS NULL OR avg_loss < m"""
    )
    q["checkpoints"] = _with(f"SELECT run, step, epoch, {_r('loss')} AS loss FROM v_run WHERE step % 50 = 0")
    q["loss_tail"] = _with(
        f"""
        SELECT run || '-' || epoch AS model, back, step, CASE WHEN loss <= 5 THEN {_r("loss")} END AS loss, CAST(loss > 5 AS VARCHAR) AS is_nan
        FROM (SELECT *, row_number() OVER (PARTITION BY run, epoch ORDER BY step DESC) AS back FROM v_run) WHERE back <= 5"""
    )
    q["corpus_by_language"] = _with(
        f"""
        SELECT category, count(*) AS n_docs, CAST(sum(article_token_count) AS BIGINT) AS n_tokens, {_r("avg(article_token_count)")} AS mean_tokens,
               {_r("quantile_cont(article_token_count, 0.5)")} AS median_tokens, max(article_token_count) AS max_tokens,
               {_r("avg(compression_ratio)")} AS mean_ratio, {_r("count(*) * 100.0 / (SELECT count(*) FROM v_docs)")} AS percent
        FROM v_docs GROUP BY category"""
    )
    return q
