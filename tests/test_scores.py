import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom import shared
from corpusloom.catalog import score_oracle
from corpusloom.operators import consistency, lookup, ngram_scores, stemming
from corpusloom.plans import evaluation

PAIRS = [
    (1, "the cat sat on the mat", "the cat sat on the mat"),
    (2, "a b c", "d e f"),
    (3, "", "some reference"),
    (4, "the the the the", "the the cat"),
    (5, "Hello, World! it's 3.5% of U.S. GDP", "hello world: it is 3.5 % of us gdp"),
    (6, "one", "one"),
]


@pytest.fixture(scope="module")
def pairs(spark):
    rng = random.Random(2)
    more = [(100 + i, " ".join(rng.choices("abcdefg", k=rng.randint(0, 60))), " ".join(rng.choices("abcdefg", k=rng.randint(1, 60)))) for i in range(40)]
    return PAIRS + more, spark.createDataFrame(PAIRS + more, "pair_id long, generated string, reference string")


def plain_tokens(text):
    return re.sub(r"[^a-z0-9]+", " ", text.lower()).split()


def grams(tokens, n):
    return Counter(tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1))


def f1(match, a, b):
    p, r = (match / a if a else 0), (match / b if b else 0)
    return p, r, (2 * p * r / (p + r) if p + r else 0)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@pytest.mark.parametrize("n", [1, 2, 3])
def test_rouge_n(pairs, n):
    rows, df = pairs
    got = {r.pair_id: (r.precision, r.recall, r.f1) for r in ngram_scores.rouge_n(ngram_scores.token_pairs(df), n).collect()}
    assert len(got) == len(rows)
    for i, gen, ref in rows:
        a, b = grams(plain_tokens(gen), n), grams(plain_tokens(ref), n)
        assert got[i] == pytest.approx(f1(sum((a & b).values()), sum(a.values()), sum(b.values())))


def test_rouge_l(pairs):
    rows, df = pairs
    tokens = ngram_scores.token_pairs(df)
    got = {r.pair_id: r for r in ngram_scores.rouge_l(tokens).collect()}
    first = {r.pair_id: r.f1 for r in ngram_scores.rouge_n(tokens, 1).collect()}
    for i, gen, ref in rows:
        a, b = plain_tokens(gen), plain_tokens(ref)
        assert got[i].lcs == lcs(a, b)
        assert (got[i].precision, got[i].recall, got[i].f1) == pytest.approx(f1(lcs(a, b), len(a), len(b)))
        assert got[i].f1 <= first[i] + 1e-12


def bleu(rows, split):
    match, total, gl, rl = [0] * 4, [0] * 4, 0, 0
    for _, gen, ref in rows:
        a, b = split(gen), split(ref)
        gl, rl = gl + len(a), rl + len(b)
        for n in range(4):
            x, y = grams(a, n + 1), grams(b, n + 1)
            match[n] += sum((x & y).values())
            total[n] += sum(x.values())
    if not any(match) or not all(total):
        return 0.0
    smooth, logs = 1.0, 0.0
    for m, t in zip(match, total):
        if m == 0:
            smooth *= 2
            logs += math.log(1 / (smooth * t))
        else:
            logs += math.log(m / t)
    return 100 * (1.0 if gl >= rl else math.exp(1 - rl / gl)) * math.exp(logs / 4)


def test_bleu(pairs):
    rows, df = pairs
    tokens = ngram_scores.token_pairs(df, lambda c: F.filter(F.split(c, " "), lambda t: t != ""))
    assert ngram_scores.corpus_bleu(tokens).first().score == pytest.approx(bleu(rows, str.split))
    for some in ([PAIRS[1]], [(1, "a b c d e", "a b x d e")], [(1, "a b", "a b")], [(1, "", "a")], [(1, "a b c d", "a b c d e f")]):
        df = tokens.sparkSession.createDataFrame(some, "pair_id long, generated string, reference string")
        tokens = ngram_scores.token_pairs(df, lambda c: F.filter(F.split(c, " "), lambda t: t != ""))
        assert ngram_scores.corpus_bleu(tokens).first().score == pytest.approx(bleu(some, str.split))


def test_bleu_tokens(spark):
    text = 'He said: "3.5%, U.S.-based" &amp; (5,000) x-y 1990-92.'
    got = spark.createDataFrame([(text,)], "t string").select(ngram_scores.bleu_tokens(F.col("t")).alias("x")).first().x
    assert got == ["He", "said", ":", '"', "3.5", "%", ",", "U", ".", "S", ".", "-based", '"', "&", "(", "5,000", ")", "x-y", "1990", "-", "92", "."]


STEMS = """caresses:caress ponies:poni ties:tie cats:cat feed:feed agreed:agre plastered:plaster motoring:motor sing:sing
conflated:conflat troubled:troubl sized:size hopping:hop falling:fall hissing:hiss fizzed:fizz filing:file happy:happi sky:sky
relational:relat conditional:condit rational:ration digitizer:digit radicalli:radic vietnamization:vietnam operator:oper
decisiveness:decis hopefulness:hope sensibiliti:sensibl triplicate:triplic formative:form electrical:electr goodness:good
revival:reviv adjustable:adjust replacement:replac adoption:adopt communism:commun effective:effect probate:probat rate:rate
controll:control dying:die news:news skies:sky generalizations:gener oscillators:oscil cried:cri enjoy:enjoy geology:geolog
syyygy:syyygi yyes:yye"""


def test_stems(spark):
    want = dict(x.split(":") for x in STEMS.split())
    words = spark.createDataFrame([(w,) for w in [*want, "cat", "the"]], "token string")
    got = {r.token: r.stem for r in stemming.stem_table(words, 3).collect()}
    assert {w: got.get(w, w) for w in want} == want
    assert "the" not in {r.token for r in stemming.stem_table(words).collect()}


def test_stemmed_rouge(spark):
    df = spark.createDataFrame([(1, "running cats agreed", "run cat agree"), (2, "", "x")], "pair_id long, generated string, reference string")
    tokens = {r.pair_id: r for r in evaluation.stemmed_tokens(df).collect()}
    assert tokens[1].gen == ["run", "cat", "agre"] and tokens[1].ref == ["run", "cat", "agre"][:2] + ["agre"]
    assert tokens[2].gen == []


def test_score_report(spark, pairs):
    rows, df = pairs
    cost = spark.createDataFrame([(2.0, 10), (2.0, 30)], "latency double, tokens long")
    row = evaluation.score_report(df, "m", cost, stem=False).first()
    assert row.num_samples == len(rows) and row.inference.throughput_tokens_per_sec == 10.0
    mean = sum(f1(lcs(plain_tokens(g), plain_tokens(r)), len(plain_tokens(g)), len(plain_tokens(r)))[2] for _, g, r in rows) / len(rows)
    assert row.scores.rougeL == pytest.approx(mean, abs=1e-4)


def test_vector_f1_over_many_blocks(spark):
    rng = np.random.default_rng(4)
    data = {1: (rng.normal(size=(150, 4)), rng.normal(size=(90, 4))), 2: (rng.normal(size=(3, 4)), rng.normal(size=(5, 4)))}
    rows = [(p, s, i, [float(x) for x in v]) for p, sides in data.items() for s in (0, 1) for i, v in enumerate(sides[s])]
    rows.append((3, 0, 0, [1.0, 0.0, 0.0, 0.0]))
    df = spark.createDataFrame(rows, "pair_id long, side int, pos int, vec array<double>")
    for block in (4, 64):
        got = {r.pair_id: r for r in ngram_scores.greedy_vector_f1(df, block).collect()}
        for p, (g, r) in data.items():
            cos = (g / np.linalg.norm(g, axis=1, keepdims=True)) @ (r / np.linalg.norm(r, axis=1, keepdims=True)).T
            assert got[p].precision == pytest.approx(cos.max(1).mean())
            assert got[p].recall == pytest.approx(cos.max(0).mean())
        assert got[3].f1 == 0.0


def test_entity_scores(spark):
    schema = "pair_id long, source_entities array<string>, generated_entities array<string>, reference_entities array<string>"
    rows = [(1, ["a"], [], ["a"]), (2, ["a"], ["a", "b"], []), (3, ["a"], ["b"], ["a"]), (4, ["a", "b"], ["a", "b"], ["a", "b", "c", "d"])]
    out = {r.pair_id: r for r in consistency.add_entity_scores(spark.createDataFrame(rows, schema)).collect()}
    assert (out[1].entity_precision, out[1].entity_recall, out[1].entity_f1) == (1.0, 0.0, 0.0)
    assert (out[2].entity_precision, out[2].entity_recall, out[2].hallucinated) == (0.5, 1.0, ["b"])
    assert out[3].entity_f1 == 0.0 and out[4].entity_f1 == pytest.approx(2 / 3)
    report = consistency.entity_report(consistency.add_entity_scores(spark.createDataFrame(rows, schema))).first()
    assert report.hallucination_rate == pytest.approx(2 / 5)


def test_topics_and_verdicts(spark):
    df = spark.createDataFrame([(1, "green apples grow", "apples grow"), (2, "some words", "the of")], "pair_id long, source string, generated string")
    assert [r.topic_overlap for r in consistency.add_topic_overlap(df).orderBy("pair_id").collect()] == [1.0, 0.0]
    scores = spark.createDataFrame([(0.71, 0.51, 0.51), (0.7, 0.51, 0.51), (0.51, 0.31, 0.0), (0.5, 0.9, 0.9)], "p double, e double, t double")
    got = [r.v for r in scores.select(consistency.verdict(F.col("p"), F.col("e"), F.col("t")).alias("v")).collect()]
    assert got == ["GOOD", "FAIR", "FAIR", "POOR"]


def test_entailment_does_not_overflow(spark):
    df = spark.createDataFrame([(1, [1000.0, 1000.0, 0.0])], "pair_id long, logits array<double>")
    row = consistency.add_entailment(df).first()
    assert (row.contradiction, row.entailment, row.neutral) == pytest.approx((0.5, 0.5, 0.0))


def test_zip_pairs(spark):
    s = spark.createDataFrame([(1, "s1"), (2, "s2")], "pair_id long, source string")
    g = spark.createDataFrame([(2, " g2 "), (3, "g3")], "pair_id long, generated string")
    r = spark.createDataFrame([(1, "r1"), (2, "r2")], "pair_id long, reference string")
    assert [tuple(x) for x in consistency.zip_pairs(s, g, r).collect()] == [(2, "s2", "g2", "r2")]


def test_samples_in_order(spark):
    schema = "pair_id long, source string, reference string, generated string, entity_precision double, hallucinated array<string>, entailment double, topic_overlap double"
    rows = [(i, "s" * 600, "r", "g", 1.0, list("abcdefg"), None, 0.5) for i in (5, 3, 9, 1)]
    out = consistency.sample_table(spark.createDataFrame(rows, schema), first=2).collect()
    assert [r.id for r in out] == [1, 3]
    assert len(out[0].source_excerpt) == 500 and out[0].hallucinated_entities == list("abcde") and out[0].entailment is None


def test_bootstrap_means(spark):
    rows = [(i, float(i % 2), None if i % 3 == 0 else float(i % 5)) for i in range(2000)]
    scores = spark.createDataFrame(rows, "pair_id long, a double, b double")
    got = {r.metric: r for r in ngram_scores.bootstrap_means(scores, ("a", "b"), resamples=400).collect()}
    assert got["a"].mean == 0.5 and got["a"].low < got["a"].mid < got["a"].high
    # 95% of the means of 2000 fair coins lie within 2 * 0.5 / sqrt(2000) of one half.
    assert got["a"].high - got["a"].low == pytest.approx(4 * 0.5 / 2000**0.5, rel=0.2)
    real = [r[2] for r in rows if r[2] is not None]
    assert got["b"].mean == pytest.approx(sum(real) / len(real)) and abs(got["b"].mid - got["b"].mean) < 0.02
    again = ngram_scores.bootstrap_means(scores.repartition(7), ("a",), resamples=400).first()
    assert (again.low, again.high) == pytest.approx((got["a"].low, got["a"].high))
    assert ngram_scores.bootstrap_means(scores.limit(0), ("a",), resamples=8).count() == 0


def test_resampling_draws_each_row_once_on_average(spark):
    counts = spark.range(3000).select(F.explode(ngram_scores.resample_weights("id", 10)).alias("w")).groupBy("w").count().collect()
    share = {r.w: r["count"] / 30_000 for r in counts}
    assert sum(w * p for w, p in share.items()) == pytest.approx(1, abs=0.03)
    assert share[0] == pytest.approx(np.exp(-1), abs=0.015) and share[2] == pytest.approx(np.exp(-1) / 2, abs=0.015)


def test_sql_stems_agree(spark):
    """The rules as SQL, written apart from the columns, on words that reach all of them."""
    import duckdb

    words = """caresses ponies ties caress cats feed agreed plastered bled motoring sing conflated troubled sized hopping tanned falling hissing fizzed
        failing filing happy sky enjoy relational conditional rational valenci hesitanci digitizer conformabli radicalli differentli vileli analogousli
        vietnamization predication operator feudalism decisiveness hopefulness callousness formaliti sensitiviti sensibiliti triplicate formative
        formalize electriciti electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable defensible irritant replacement
        adjustment dependent adoption homologou communism activate angulariti homologous effective bowdlerize probate rate cease controll roll dying
        news innings skies lies died spied archaeology apology yyyy syzygy sayyid flies owed being used employed naturally fulfully""".split()
    words = [*words, *(w + "s" for w in words), *(w + "ing" for w in words), *(w + "ed" for w in words)]
    got = {r.token: r.stem for r in stemming.stem_table(spark.createDataFrame([(w,) for w in words], "token string")).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE t AS SELECT 1 AS pair_id, ? AS g, []::VARCHAR[] AS r", [words])
    views = score_oracle.stem_views("t")
    sql = "WITH " + ", ".join(f"{k} AS ({s})" for k, s in views.items() if k != "v_stemmed") + " SELECT token, stem FROM v_stem WHERE token <> stem"
    assert dict(con.execute(sql).fetchall()) == got


def test_rare_tokens_are_stemmed_beside_a_dictionary(spark):
    """Pairs with one id, or none, keep their own texts, however large the table of stems is."""
    rows = [(1, "running cats agreed", "run cat agree"), (1, "ponies", "sized falling"), (None, "hopping", "the"), (None, "happy", ""), (2, "", "x")]
    df = spark.createDataFrame(rows, "pair_id long, generated string, reference string")
    tokens = ngram_scores.token_pairs(df)
    words = tokens.select(F.explode(F.array_union("gen", "ref")).alias("token")).union(spark.createDataFrame([("cats",)] * 9, "token string"))
    stems = stemming.counted_stems(words)
    small, mixed, joined = (sorted(str(tuple(r)) for r in ngram_scores.stem_pairs(tokens, stems, n, 4).collect()) for n in (10**6, 120, 0))
    assert small == mixed == joined and len(joined) == len(rows) and "['run', 'cat', 'agre']" in joined[0] + joined[1] + joined[2] + joined[3] + joined[4]


def test_tokens_of_random_lines(spark):
    def rule(line):
        for entity, char in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
            line = line.replace("<skipped>", "").replace("-\n", "").replace("\n", " ").replace(entity, char)
        line = re.sub(r"([{-~\[-`!-&(-+:-@/])", r" \1 ", f" {line} ")
        line = re.sub(r"([.,])([^0-9])", r" \1 \2", re.sub(r"([^0-9])([.,])", r"\1 \2 ", line))
        return re.sub(r"([0-9])(-)", r"\1 \2 ", line).split()

    draw = random.Random(3)
    lines = ["".join(draw.choice("ab19 .,-$;\t" if i % 2 else "ab19 -x.") for _ in range(draw.randrange(14))) for i in range(3000)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i long, x string")
    found = {r.i: r.t for r in df.select("i", ngram_scores.bleu_tokens(F.col("x")).alias("t")).collect()}
    assert all(found[i] == rule(x) for i, x in enumerate(lines))
    plan = df.select(ngram_scores.rouge_tokens(F.col("x")))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan


def test_resamples_are_summed_where_rows_lie(spark):
    import hashlib

    rows = [(1, 1.0), (1, 3.0), (None, 2.0), (7, None), (8, float("nan")), (9, 0.5)]
    scores = spark.createDataFrame(rows, "pair_id long, a double")

    def drawn(i, k):
        digits = hashlib.md5(f"{'' if i is None else f'{i}:'}{k // 4}:0".encode()).hexdigest()
        number, n, term, total = int(digits[k % 4 * 8 : k % 4 * 8 + 8], 16) / 2**32, 0, np.exp(-1), np.exp(-1)
        while number >= total:
            n, term = n + 1, term / (n + 1)
            total += term
        return n

    real = [(i, x) for i, x in rows if x is not None and x == x]
    means = [sum(x * drawn(i, k) for i, x in real) / n for k in range(30) if (n := sum(drawn(i, k) for i, _ in real))]
    report = ngram_scores.bootstrap_means(scores, ("a",), resamples=30)
    got = report.first()
    assert (got.low, got.mid, got.high) == pytest.approx(tuple(np.percentile(means, [2.5, 50, 97.5])))
    assert "posexplode" not in report._jdf.queryExecution().optimizedPlan().toString()


def test_report_scores_every_pair_once(spark):
    scored_rows = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def precision(x):
        scored_rows.add(1)
        return 1.0 - (x or 0) / 1000

    ids = [None, None, *range(600), 7]
    base = spark.createDataFrame([(i, "Some text") for i in ids], "pair_id long, source string").repartition(4)
    scored = base.select(
        "*", F.col("source").alias("generated"), F.col("source").alias("reference"), precision("pair_id").alias("entity_precision"), F.lit(0.5).alias("entity_recall"),
        F.lit(0.5).alias("entity_f1"), F.lit(1).alias("n_hallucinated"), F.lit(2).alias("n_entities"), F.array(F.lit("x")).alias("hallucinated"), F.lit(0.5).alias("entailment"),
        F.lit(0.5).alias("contradiction"), F.lit(0.5).alias("topic_overlap"),
    )
    row = consistency.consistency_report(scored, "m", 12).collect()[0]
    assert row["num_samples"] == len(ids)
    assert sorted(s["id"] or -1 for s in row["samples"]) == sorted([-1, -1, -1, 1, 2, 3, 4, 5, 6, 7, 7, 8])
    assert scored_rows.value <= len(ids) + 20
    empty = consistency.consistency_report(scored.where("source = 'none'"), "m", 12).collect()[0]
    assert empty["num_samples"] == 0 and not empty["samples"]


def test_few_rows_of_a_batch_are_objects_at_a_time():
    taken = []

    class Column(list):
        def slice(self, start, n):
            taken.append(n)
            return Column(self[start : start + n])

        def to_pylist(self):
            return list(self)

    rows = shared.row_by_row(Column(range(1000)), Column("x" * 1000))
    assert next(rows) == (0, "x") and len(taken) == 2 and max(taken) <= 1000 // 4
    assert list(rows) == [(i, "x") for i in range(1, 1000)]


def test_looked_up_tokens_of_random_lines(spark, monkeypatch):
    """Against a rule a token, with the table as a dictionary, in part, and joined; in parts of a few bytes."""
    monkeypatch.setattr(lookup, "PART_BYTES", 40)
    draw = random.Random(5)
    tokens = ["", "a", "bb", "ccc", "dddd", "äöüß", "日本語", *(f"w{i}" for i in range(60))]
    texts = ["\n".join(" ".join(draw.choices(tokens, k=draw.randrange(5))) for _ in range(draw.randrange(1, 4))) for _ in range(200)]
    df = spark.createDataFrame([(None if i % 9 == 0 else i // 2, x) for i, x in enumerate(texts)], "id long, x string")
    ids = {t: (k, f"s{k}") for k, t in enumerate(tokens) if t and k % 3}
    table = shared.cut_lineage(spark.createDataFrame([(t, *v, v[0]) for t, v in ids.items()], "token string, i int, s string, o int"))
    for value, missing in (("i", lambda t: -len(t)), ("s", lambda t: t)):
        at = "is".index(value)
        lines = [[[ids[t][at] if t in ids else missing(t) for t in line.split(" ")] if line else [] for line in x.split("\n")] for x in texts]
        want = lines if value == "i" else [[" ".join(line) for line in x] for x in lines]
        want = sorted(str((None if i % 9 == 0 else i // 2, x)) for i, x in enumerate(want))
        for most in (10**6, 500, 0):
            got = lookup.looked_up(df, ["id"], {"found": F.col("x")}, table.select("token", value, "o"), missing, most)
            assert sorted(str(tuple(r)) for r in got.collect()) == want


def test_dictionary_in_a_task_takes_no_more_than_its_bytes(spark):
    table = shared.cut_lineage(spark.range(20_000).selectExpr("concat('token', id) AS token", "concat('stem', id) AS stem"))
    known = lookup._known(table).value
    assert sum(column.nbytes for column in known) <= shared.dictionary_bytes(table)
    assert dict(zip(*(column.to_pylist() for column in known), strict=True)) == {f"token{i}": f"stem{i}" for i in range(20_000)}


def test_report_looks_tokens_up_once(spark):
    pairs = spark.createDataFrame([(1, "the cats were running home", "a cat runs home"), (2, "", "x")], "pair_id long, generated string, reference string")
    report = evaluation.score_report(pairs, "m")
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "lcs_length" in plan
    tokens = evaluation.stemmed_tokens(pairs)
    want = ngram_scores.rouge_l(tokens).agg(F.round(F.avg("f1"), 4)).first()[0]
    assert report.first().scores.rougeL == want > 0
