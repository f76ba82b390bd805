"""SQL for stemmed scores and the complete score report: the stem rules step by step over the distinct words."""

from __future__ import annotations

from collections.abc import Callable

from corpusloom.operators.stemming import IRREGULAR, STEP_2, STEP_3, STEP_4

#: c or v for each letter of a word, read from its first letter on; y is a vowel after a consonant.
_SHAPE = """list_reduce(list_prepend('', string_split({w}, '')),
  lambda s, x: s || CASE WHEN x = '' THEN '' WHEN x IN ('a', 'e', 'i', 'o', 'u') OR (x = 'y' AND s LIKE '%c') THEN 'v' ELSE 'c' END)"""


def _cut(n: int) -> tuple[str, str]:
    """A word without its last n letters, and the shape of that."""
    return (f"left(w, length(w) - {n})", f"left(s, length(s) - {n})") if n else ("w", "s")


def _measure(shape: str) -> str:
    return f"len(regexp_extract_all({shape}, 'vc'))"


def _short(stem: str, shape: str) -> str:
    return f"({shape} = 'vc' OR ({shape} LIKE '%cvc' AND right({stem}, 1) NOT IN ('w', 'x', 'y')))"


def _rules(rules: list[tuple[str, str, Callable[[str, str], str]]]) -> str:
    """The first suffix that fits decides."""
    cases = []
    for suffix, new, test in rules:
        stem, shape = _cut(len(suffix))
        cases.append(f"WHEN ends_with(w, '{suffix}') THEN CASE WHEN {test(stem, shape)} THEN {stem} || '{new}' ELSE w END")
    return f"CASE {' '.join(cases)} ELSE w END"


def _steps() -> list[str]:
    always = lambda stem, shape: "true"
    positive = lambda stem, shape: f"{_measure(shape)} > 0"
    longer = lambda stem, shape: f"{_measure(shape)} > 1"
    plural = _rules([("sses", "ss", always), ("ies", "i", always), ("ss", "ss", always), ("s", "", always)])
    past = f"""CASE WHEN ends_with(w, 'ied') THEN {_cut(3)[0]} || CASE WHEN length(w) = 4 THEN 'ie' ELSE 'i' END
      WHEN ends_with(w, 'eed') THEN CASE WHEN {_measure(_cut(3)[1])} > 0 THEN {_cut(1)[0]} ELSE w END
      WHEN ends_with(w, 'ed') AND contains({_cut(2)[1]}, 'v') THEN {_cut(2)[0]} || '*'
      WHEN ends_with(w, 'ing') AND contains({_cut(3)[1]}, 'v') THEN {_cut(3)[0]} || '*' ELSE w END"""
    stem, shape = _cut(1)
    repair = f"""CASE WHEN NOT ends_with(w, '*') THEN w WHEN regexp_matches({stem}, '(at|bl|iz)$') THEN {stem} || 'e'
      WHEN length({stem}) > 1 AND right({stem}, 1) = left(right({stem}, 2), 1) AND {shape} LIKE '%c'
        THEN CASE WHEN right({stem}, 1) IN ('l', 's', 'z') THEN {stem} ELSE {_cut(2)[0]} END
      WHEN {_measure(shape)} = 1 AND {_short(stem, shape)} THEN {stem} || 'e' ELSE {stem} END"""
    ending = {s: longer for s in STEP_4} | {"ion": lambda stem, shape: f"{_measure(shape)} > 1 AND right({stem}, 1) IN ('s', 't')"}
    return [
        f"CASE WHEN ends_with(w, 'ies') AND length(w) = 4 THEN left(w, 1) || 'ie' ELSE {plural} END",
        past,
        repair,
        _rules([("y", "i", lambda stem, shape: f"length({stem}) > 1 AND {shape} LIKE '%c'")]),
        _rules([("alli", "al", positive)]),
        _rules([*((a, b, positive) for a, b in STEP_2), ("logi", "log", lambda stem, shape: f"{_measure(_cut(3)[1])} > 0")]),
        _rules([(a, b, positive) for a, b in STEP_3]),
        _rules([(s, "", ending[s]) for s in STEP_4]),
        _rules([("e", "", lambda stem, shape: f"({_measure(shape)} > 1 OR ({_measure(shape)} = 1 AND NOT {_short(stem, shape)}))")]),
        _rules([("ll", "l", lambda stem, shape: f"{_measure(_cut(1)[1])} > 1")]),
    ]


def stem_views(tokens: str) -> dict[str, str]:
    """``v_stem`` (``token``, ``stem``) for all words in the columns g and r of the view ``tokens``, and ``v_stemmed`` with stems in their place."""
    views = {
        "v_stem_0": f"SELECT DISTINCT token, token AS w FROM (SELECT unnest(g) AS token FROM {tokens} UNION ALL SELECT unnest(r) FROM {tokens}) WHERE length(token) > 3"
    }
    for k, step in enumerate(_steps()):
        views[f"v_stem_{k + 1}"] = f"SELECT token, {step} AS w FROM (SELECT token, w, {_SHAPE.format(w='w')} AS s FROM v_stem_{k})"
    own = " ".join(f"WHEN '{word}' THEN '{stem}'" for word, stem in IRREGULAR.items())
    views["v_stem"] = f"SELECT token, CASE token {own} ELSE w END AS stem FROM v_stem_{len(_steps())}"
    side = f"""SELECT pair_id, list(coalesce(stem, token) ORDER BY i) AS {{0}}
        FROM (SELECT pair_id, unnest({{0}}) AS token, generate_subscripts({{0}}, 1) AS i FROM {tokens}) LEFT JOIN v_stem USING (token) GROUP BY pair_id"""
    views["v_stemmed"] = f"""
        SELECT t.pair_id, coalesce(a.g, []) AS g, coalesce(b.r, []) AS r
        FROM {tokens} t LEFT JOIN ({side.format("g")}) a USING (pair_id) LEFT JOIN ({side.format("r")}) b USING (pair_id)"""
    return views


def bleu_value() -> str:
    """BLEU of the views ``v_bt`` and ``v_b1`` to ``v_b4``; the i-th order without a match counts 1 / 2^i matches."""
    zeros = {n: " + ".join(f"CASE WHEN m{k} = 0 THEN 1 ELSE 0 END" for k in range(1, n + 1)) for n in range(1, 5)}
    logs = " + ".join(f"ln(CASE WHEN m{n} > 0 THEN m{n} ELSE pow(0.5, {zeros[n]}) END / t{n})" for n in range(1, 5))
    totals = ", ".join(f"sum(greatest(len(g) - {n - 1}, 0)) AS t{n}" for n in range(1, 5))
    return f"""
        SELECT 100 * CASE WHEN gl >= rl THEN 1.0 ELSE exp(1 - rl / CAST(gl AS DOUBLE)) END * exp(({logs}) / 4) AS score
        FROM (SELECT sum(len(g)) AS gl, sum(len(r)) AS rl, {totals} FROM v_bt),
             (SELECT v_b1.m AS m1, v_b2.m AS m2, v_b3.m AS m3, v_b4.m AS m4 FROM v_b1, v_b2, v_b3, v_b4)"""


def bootstrap(resamples: int) -> str:
    """``v_means`` (``metric``, ``resample``, ``mean``) over the view ``v_scores`` (``pair_id``, ``metric``, ``value``)."""
    limits, term, total = [], 1.0, 0.0
    for k in range(1, 13):
        total += term
        limits.append(f"(u >= exp(-1) * {total!r})::INTEGER")
        term /= k
    return f"""
        SELECT metric, resample, sum(value * weight) / sum(weight) AS mean
        FROM (SELECT metric, value, resample, {" + ".join(limits)} AS weight
              FROM (SELECT metric, value, resample,
                      ('0x' || substr(md5(pair_id || ':' || (resample // 4) || ':0'), 1 + 8 * (resample % 4), 8))::BIGINT / 4294967296.0 AS u
                    FROM v_scores, range({resamples}) t(resample)))
        WHERE weight > 0 GROUP BY metric, resample"""
