import math

import pytest
from pyspark.sql import functions as F

from corpusloom import shared
from corpusloom.functions import text as tx
from corpusloom.operators import records, runlog
from corpusloom.operators import sentences as so
from corpusloom.sources import readers


@pytest.fixture(scope="module")
def vocabulary(spark):
    counts = spark.createDataFrame([("b", 5), ("a", 5), ("c", 9), ("rare", 1)], "token string, n long")
    return records.vocabulary_ids(counts, 3)


def test_vocabulary(vocabulary):
    assert {r.token: r.token_id for r in vocabulary.collect()} == {"c": 3, "a": 4, "b": 5}


def test_whole_vocabulary(spark):
    counts = spark.createDataFrame([(f"t{i:03d}", 1 + i % 3) for i in range(300)], "token string, n long")
    ids = {r.token: r.token_id for r in records.vocabulary_ids(counts).collect()}
    order = sorted(ids, key=lambda t: (-(1 + int(t[1:]) % 3), t))
    assert [ids[t] for t in order] == list(range(3, 303))


def test_seq2seq(spark, vocabulary):
    df = spark.createDataFrame([(1, "a b rare c", "b"), (2, "", "a a a")], "id long, t string, s string")
    out = {r.id: r for r in records.seq2seq_records(df, "id", "t", "s", vocabulary, 3, 2).collect()}
    assert out[1].input_ids == [4, 5, 1] and out[1].attention_mask == [1, 1, 1] and out[1].labels == [5, -100]
    assert out[2].input_ids == [0, 0, 0] and out[2].attention_mask == [0, 0, 0] and out[2].labels == [4, 4]


def test_causal(spark, vocabulary):
    df = spark.createDataFrame([(1, "a b", "c"), (2, "a b c a b c", "c"), (3, "", "a")], "id long, p string, c string")
    out = {r.id: r for r in records.causal_records(df, "id", tx.tokens(F.col("p")), tx.tokens(F.col("c")), vocabulary, 5).collect()}
    assert out[1].input_ids == [4, 5, 3, 2, 0] and out[1].labels == [-100, -100, 3, 2, -100]
    assert out[2].input_ids == [4, 5, 3, 4, 5] and out[2].labels == [-100] * 5
    assert out[3].input_ids == [4, 2, 0, 0, 0] and out[3].labels == [4, 2, -100, -100, -100]


def test_tokens_are_looked_up_in_place_or_by_a_join(spark, vocabulary):
    df = spark.createDataFrame([(1, "a b rare c. And c a b.", "b"), (2, "", "a"), (3, "c c c c c c c c c.", None)], "id long, t string, s string")
    texts = {"x": tx.tokens(F.col("t")), "y": tx.tokens(F.coalesce("s", F.lit("")))}
    for job in (lambda n: records.encode(df, "id", texts, vocabulary, n), lambda n: records.sentence_records(df, "id", "t", vocabulary, 3, 4, n)):
        one, other = (sorted(map(tuple, job(n).collect())) for n in (10**6, 0))
        assert one == other
    plan = records.encode(df, "id", texts, vocabulary)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_sentence_records(spark, vocabulary):
    df = spark.createDataFrame([(1, "A b c rare. A a a a a a a."), (2, "")], "id long, t string")
    out = {r.id: r for r in records.sentence_records(df, "id", "t", vocabulary, slots=3, length=4).collect()}
    assert out[1].n_sentences == 2 and out[2].n_sentences == 0
    assert out[1].input_ids == [[4, 5, 3, 1], [4, 4, 4, 4], [0, 0, 0, 0]]
    assert out[1].attention_mask == [[1, 1, 1, 1], [1, 1, 1, 1], [0, 0, 0, 0]]


def test_lookup_join_both_ways(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"))
    table = rows.select("k").distinct().withColumn("v", F.length("k"))
    for how in ("inner", "left"):
        small = shared.lookup_join(rows, table, ["k"], F.col("id"), how)
        large = shared.lookup_join(rows, table, ["k"], F.col("id"), how, max_rows=5)
        assert sorted(map(tuple, small.select("id", "k", "v").collect())) == sorted(map(tuple, large.select("id", "k", "v").collect()))
        assert "_salt" in large._jdf.queryExecution().toString() and "_salt" not in small._jdf.queryExecution().toString()


def test_entities_do_not_depend_on_the_join(spark):
    docs = spark.createDataFrame([(1, "Berlin and Paris on 2020-01-01 for $5"), (2, "Berlin")], "id long, t string")
    names = spark.createDataFrame([("berlin", "GPE"), ("paris", "EVENT"), ("2020-01-01", "DATE")], "entity string, label string")
    every = ("GPE", "EVENT", "DATE", "MONEY")
    few = sorted(map(tuple, so.entity_rows(docs, "id", "t", names, every).collect()))
    many = sorted(map(tuple, so.entity_rows(docs, "id", "t", names, every, max_rows=0).collect()))
    assert few == many == [(1, "$5", "MONEY"), (1, "2020-01-01", "DATE"), (1, "berlin", "GPE"), (1, "paris", "EVENT"), (2, "berlin", "GPE")]
    assert sorted(map(tuple, so.entity_rows(docs, "id", "t", names).collect())) == [(1, "berlin", "GPE"), (2, "berlin", "GPE")]


def test_shared_folder_comes_from_the_session(spark):
    assert shared.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert shared.new_folder(spark, "x") != shared.new_folder(spark, "x")


def test_running_mean_over_blocks(spark):
    rows = [("r", i, float(i % 7)) for i in range(1, 101)] + [("q", 1, 5.0), ("q", 2, None)]
    df = spark.createDataFrame(rows, "run string, step long, loss double")
    out = {(r.run, r.step): r.running_mean for r in runlog.running_mean(df, ["run"], "step", "loss", block=8).collect()}
    for i in range(1, 101):
        assert out["r", i] == pytest.approx(sum(j % 7 for j in range(1, i + 1)) / i)
    assert out["q", 2] == 5.0


def test_best_so_far(spark):
    losses = [3.0, 3.0, math.nan, 2.5, 2.6, 2.5, 2.4]
    df = spark.createDataFrame([("r", i, x) for i, x in enumerate(losses)], "run string, epoch long, loss double")
    for block in (2, 100):
        assert sorted(r.epoch for r in runlog.best_so_far(df, ["run"], "epoch", "loss", block).collect()) == [0, 3, 6]


def test_training_reports(spark, tmp_path):
    (tmp_path / "a.json").write_text(
        '{\n "model": "m", "training": {"train_samples": 5, "loss_log": [{"step": 1, "loss": 2.5}, {"step": 9, "loss": NaN}, {"step": 4, "loss": 1.5}]},\n'
        ' "evaluation": {"rouge1": 0.3, "rouge2": 0.4, "rougeL": 0.2}, "inference": {"mean_latency_sec": 0.5}\n}'
    )
    reports = readers.read_reports(spark, str(tmp_path), readers.TRAINING_REPORT_SCHEMA)
    tail = runlog.loss_tail(reports, 2).orderBy("back").collect()
    assert [(r.step, r.loss, r.is_nan) for r in tail] == [(9, None, True), (4, 1.5, False)]
    flat = runlog.flatten_trainings(reports)
    assert flat.first().n_losses == 3 and flat.first().mean_latency_sec == 0.5
    broken = {r.rule: r.n_broken for r in runlog.check_reports(flat, runlog.REPORT_RULES).collect()}
    assert broken == {"rouge2 <= rouge1": 1, "rougeL <= rouge1": 0, "scores in [0, 1]": 0}


def test_leaderboard_ties(spark):
    df = spark.createDataFrame([("a", 1.0, 3.0), ("b", 2.0, 3.0), ("c", 3.0, None)], "model string, score double, cost double")
    board = runlog.leaderboard(df, "model", {"score": True, "cost": False})
    best = sorted((r.metric, r.model) for r in runlog.best_per_metric(board).collect())
    assert best == [("cost", "a"), ("cost", "b"), ("score", "c")]


def test_epoch_mean_without_batches(spark):
    df = spark.createDataFrame([("r", 1, None)], "run string, epoch long, loss double")
    assert runlog.epoch_means(df, ["run", "epoch"], "loss").first().avg_loss == 0.0


def test_large_vocabularies_move_rare_tokens_only(spark):
    """Rows with one id, or none, stay apart; frequent tokens are a dictionary."""
    counts = spark.createDataFrame([(f"w{i}", 1000 - i) for i in range(400)], "token string, n long")
    vocabulary = records.vocabulary_ids(counts)
    rows = [(1, "w1 w399 nowhere w2. W3 w300 w301."), (1, "w399 w5 w6 w7."), (None, "w0 w398 w0."), (None, "w7 w8 w9."), (2, ""), (3, None)]
    df = spark.createDataFrame(rows, "id long, t string")
    texts = {"x": tx.tokens(F.lower(F.col("t"))), "y": tx.tokens(F.upper(F.col("t")))}
    for job in (lambda n: records.encode(df, "id", texts, vocabulary, n), lambda n: records.sentence_records(df, "id", "t", vocabulary, 3, 4, n)):
        in_place, mixed, joined = (sorted((str(tuple(r)) for r in job(n).collect())) for n in (10**6, 4000, 0))
        assert in_place == mixed == joined and len(joined) == len(rows)
    common = shared.common_part(vocabulary.withColumn("o", F.col("token_id")), "o", 4000)
    assert 0 < common.count() < 400 and common.agg(F.max("token_id")).first()[0] < 300
