import datetime

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import filters, profile, quantiles, ranking, splits, standardize
from corpusloom.plans import corpus
from corpusloom.sources import readers, writers

RAW = "doc_id long, newspaper_name string, published_date string, headline string, article_text string, human_summary string, news_category string"


def raw_rows():
    long = "word " * 30
    return [
        (1, "A", "2020-01-02", "h", long + "one", "summary of enough chars", "x"),
        (2, "B", "bad date", "h", long + " one", "summary of enough chars", None),
        (3, "C", None, "h", "x" * 100, "summary of enough chars", "x"),
        (4, "C", "5 May 2021", "h", "x" * 101, "summary of enough chars", "x"),
        (5, "C", "05/06/2021", "h", "y" * 101, "s" * 20, "x"),
        (6, "C", "2020-01-02", "h", "y" * 101, "s" * 21, "x"),
        (7, "C", "2020-01-02", "h", None, "s" * 21, "x"),
    ]


def test_clean_corpus(spark):
    raw = spark.createDataFrame(raw_rows(), RAW).toDF("doc_id", " newspaper_name", "published\n_date", "headline ", "article_text", "human_summary", "news_category")
    clean = {r.doc_id: r for r in corpus.clean_corpus(raw).collect()}
    assert set(clean) == {1, 4, 6}
    assert clean[1].article_token_count == 31 and clean[1].summary_token_count == 4
    assert clean[1].compression_ratio == pytest.approx(31 / 4)
    assert clean[1].year == 2020 and clean[4].date == datetime.datetime(2021, 5, 5)
    assert clean[6].source == "C"
    assert corpus.clean_corpus(raw).columns == ["doc_id", *standardize.CORPUS_COLUMNS]


def test_missing_columns_are_skipped(spark):
    raw = spark.createDataFrame([(1, "t")], "doc_id long, headline string")
    assert standardize.standardize_names(raw).columns == ["doc_id", "headline"]
    assert standardize.add_clean_columns(raw).columns == ["doc_id", "headline", "headline_clean"]


def test_null_label(spark):
    df = spark.createDataFrame([(None,), ("a",)], "source string")
    assert {r.source for r in standardize.strings_only(df, ("source",), "nan").collect()} == {"nan", "a"}
    assert {r.source for r in standardize.strings_only(df, ("source",)).collect()} == {None, "a"}


def test_bad_dates(spark):
    df = spark.createDataFrame([("2020-01-01",), ("no",), (None,)], "date string")
    assert [r.date for r in standardize.bad_dates(df).collect()] == ["no"]


def test_dedup_of_a_hot_text(spark):
    rows = spark.range(9000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("t"))
    kept = filters.drop_exact_copies(rows, "t", "id")
    assert kept.count() == 6001
    assert kept.where("t = 'same'").first().id == 0
    assert "WindowGroupLimit" in kept._jdf.queryExecution().toString()


@pytest.mark.parametrize("n, sizes", [(0, {}), (1, {"test": 1}), (9, {"train": 7, "val": 1, "test": 1}), (10, {"train": 8, "val": 1, "test": 1}), (11, {"train": 8, "val": 1, "test": 2})])
def test_split_sizes(spark, n, sizes):
    out = splits.add_split(spark.range(n), "id")
    assert {r.split: r["count"] for r in out.groupBy("split").count().collect()} == sizes


def test_split_does_not_depend_on_partitions(spark):
    one = splits.add_split(spark.range(0, 500, 1, 1), "id").collect()
    many = splits.add_split(spark.range(0, 500, 1, 13), "id").collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, many))


def test_split_never_shuffles_the_rows(spark):
    wide = spark.range(100).withColumn("text", F.lit("long"))
    plan = splits.add_split(wide, "id")._jdf.queryExecution().executedPlan().toString()
    assert all("text" not in line for line in plan.splitlines() if "Exchange hashpartitioning" in line)


def test_ranges_with_an_outlier(spark):
    ids = spark.range(1000).select(F.when(F.col("id") == 999, F.lit(2**62)).otherwise(F.col("id")).alias("id"))
    assert sorted(r.id for r in splits.head(ids, "id", 5).collect()) == [0, 1, 2, 3, 4]
    assert [r.id for r in splits.position_slice(ids, "id", 0.999).collect()] == [2**62]
    assert splits.head(ids, "id", 5000).count() == 1000
    assert splits.sample(ids, "id", 17).count() == 17
    buckets = ranking.range_bucket(ids, "id", "b", 64).groupBy("b").count()
    assert buckets.agg(F.max("count")).first()[0] < 60


def test_positions_at_the_ends(spark):
    for ids in (spark.range(10), spark.range(10).select(F.format_string("k%02d", "id").alias("id"))):
        assert [splits.head(ids, "id", n).count() for n in (0, 1, 10, 11)] == [0, 1, 10, 10]
        assert [splits.sample(ids, "id", n).count() for n in (0, 1, 10, 11)] == [0, 1, 10, 10]
        assert [splits.position_slice(ids, "id", start, n).count() for start, n in ((0.0, 0), (0.0, None), (0.5, 2), (0.9, 5), (1.0, 3))] == [0, 10, 2, 1, 0]
        assert splits.split_overlap(ids, "id").agg(F.sum("n_in_eval_slice")).first()[0] == 1
    first = spark.range(10).select(F.format_string("k%02d", "id").alias("id"))
    assert sorted(r.id for r in splits.head(first, "id", 3).collect()) == ["k00", "k01", "k02"]


def test_nan_is_missing(spark):
    rows = spark.createDataFrame([(1.0, 1), (2.0, None), (float("nan"), 3), (None, 4)], "x double, n long")
    assert {r.column: r.n_missing for r in profile.missing_values(rows).collect()} == {"x": 2, "n": 1}
    bins = profile.histogram(rows, "x", 2).orderBy("bin").collect()
    assert [(r.low, r.high, r.n) for r in bins] == [(1.0, 1.5, 1), (1.5, 2.0, 1)] and bins[0].mean == 1.5


def test_csv_keeps_blanks(spark, tmp_path):
    text = "  lead, \"quoted\"\n and tail  "
    raw = spark.createDataFrame([(1, "a", None, text, text, " s ", "c")], "doc_id long, newspaper_name string, published_date string, headline string, article_text string, human_summary string, news_category string")
    writers.write_raw(raw, str(tmp_path / "raw"), "csv")
    back = readers.read_raw(spark, str(tmp_path / "raw"), "csv").first()
    assert back.headline == back.article_text == text and back.human_summary == " s "


def test_batch_manifest(spark):
    rows = splits.batch_manifest(spark.range(5), "id", epochs=2, batch_size=2, accumulation=2).collect()
    for epoch in (1, 2):
        mine = [r for r in rows if r.epoch == epoch]
        assert sorted(r.id for r in mine) == list(range(5))
        assert sorted((r.batch_id, r.pos) for r in mine) == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 0)]
        assert {r.step_id for r in mine} == {0, 1}


def test_quantiles_with_a_hot_key_and_a_hot_value(spark):
    np = pytest.importorskip("numpy")
    rng = np.random.default_rng(3)
    data = [("hot", float(x)) for x in np.where(rng.random(3000) < 0.4, 1.5, rng.exponential(9, 3000))]
    data += [("cold", 2.0), ("cold", 4.0), ("single", 7.0), ("none", None)]
    df = spark.createDataFrame(data, "k string, x double")
    out = {r.k: r for r in quantiles.exact_quantiles(df, "x", {"a": 0.5, "b": 0.99, "c": 0.0, "d": 1.0}, ("k",)).collect()}
    hot = [x for k, x in data if k == "hot"]
    for name, p in (("a", 0.5), ("b", 0.99), ("c", 0.0), ("d", 1.0)):
        assert out["hot"][name] == pytest.approx(np.quantile(hot, p))
    assert (out["cold"].a, out["single"].a) == (3.0, 7.0) and "none" not in out


@pytest.mark.parametrize("bits", [1 << 16, 64])
def test_copies_are_found_apart(spark, monkeypatch, bits):
    """With a broadcast, with a bitmap, and with one so full that every text seems to have a copy."""
    monkeypatch.setattr(filters, "BITMAP_BITS", bits)
    texts = [None, "", "a", "b", *[f"text {i % 150}" for i in range(400)], "a", None, "c"]
    rows = spark.createDataFrame([(1000 - k, text, "x") for k, text in enumerate(texts)], "id long, t string, _first string").repartition(5)
    want = sorted(map(str, filters.drop_exact_copies(rows, "t", "id").collect()))
    assert sorted(map(str, filters.drop_copies_apart(rows, "t", "id").collect())) == want
    assert sorted(map(str, filters.drop_copies_apart(rows, "t", "id", max_rows=0).collect())) == want
    assert filters.drop_copies_apart(rows.limit(0), "t", "id", max_rows=0).count() == 0


def test_histogram_edges(spark):
    np = pytest.importorskip("numpy")
    values = [float(x) for x in np.random.default_rng(5).normal(size=400)] + [0.1 * i for i in range(50)]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    counts = [r.n for r in profile.histogram(df, "x", 50).orderBy("bin").collect()]
    assert counts == np.histogram(values, 50)[0].tolist()
    sketch = profile.histogram(df, "x", 50, approx=True).orderBy("bin").collect()
    assert [r.n for r in sketch] == counts and abs(sketch[0]["median"] - np.median(values)) <= np.diff(np.sort(values)).max()
    same = profile.histogram(spark.createDataFrame([(3.0,), (3.0,)], "x double"), "x", 50).where("n > 0").collect()
    assert [(r.bin, r.n) for r in same] == [(25, 2)]


def test_two_ratios_differ(spark):
    df = spark.createDataFrame([(10, 1), (10, 10), (5, 0)], "a long, s long").toDF("article_token_count", "summary_token_count")
    row = profile.compression_stats(df.withColumn("compression_ratio", standardize.ratio(F.col("article_token_count"), F.col("summary_token_count")))).first()
    assert row.n_valid == 2 and row.mean_of_ratios == pytest.approx(5.5) and row.ratio_of_means == pytest.approx(25 / 11)


def test_approximations_are_close(spark):
    df = spark.range(20_000).select(F.col("id").alias("n"), F.concat(F.lit("w"), F.col("id") % 5000, F.lit(" the")).alias("t"))
    exact, approx = profile.vocabulary(df, "t").first(), profile.vocabulary_approx(df, "t").first()
    assert exact.n_tokens == approx.n_tokens == 40_000
    assert exact.n_types == 5001 and abs(approx.n_types - 5001) < 250
    row = profile.length_stats(df, ("n",), approx=True).first()
    assert abs(row["median"] - 9999.5) < 200


@pytest.mark.parametrize("fmt", ["csv", "json", "parquet", "orc"])
def test_raw_formats(spark, tmp_path, fmt):
    rows = [(1, 'quote " and, comma', "2020-01-01", "two\nlines", "é", "s", None)]
    df = spark.createDataFrame(rows, readers.RAW_SCHEMA)
    writers.write_raw(df, str(tmp_path / fmt), fmt)
    assert [tuple(r) for r in readers.read_raw(spark, str(tmp_path / fmt), fmt).collect()] == rows


def test_one_split_is_read_alone(spark, tmp_path):
    path = str(tmp_path / "splits")
    writers.write_splits(splits.add_split(spark.range(100), "id"), path)
    val = spark.read.parquet(path).where("split = 'val'")
    assert val.count() == 10
    assert "PartitionFilters: [isnotnull(split" in val._jdf.queryExecution().executedPlan().toString()


def test_statistics_read_only_their_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = splits.split_report(splits.add_split(docs, "doc_id"), ("n_chars",))._jdf.queryExecution().executedPlan().toString()
    assert "text:string" not in plan


def test_positions_become_a_range_for_the_scan(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = splits.position_slice(docs, "doc_id", 0.5, 10)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(doc_id,99)" in plan and "LessThanOrEqual(doc_id,109)" in plan and "Exchange" not in plan


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "id long, x double")
    assert splits.head(none, "id", 3).count() == splits.sample(none, "id", 3).count() == 0
    assert profile.histogram(none, "x").agg(F.sum("n")).first()[0] == 0
    assert profile.below_quantile(none, "x").count() == 0
    assert profile.length_grid(none, "id", "id").count() == 0


def test_clean_corpus_without_some_columns(spark):
    rows = [(1, "w " * 60), (2, "w " * 60), (3, "short")]
    only_articles = spark.createDataFrame(rows, "doc_id long, article_text string")
    assert [(r.doc_id, r.article_token_count) for r in corpus.clean_corpus(only_articles).collect()] == [(1, 60)]
    no_text = spark.createDataFrame([(1, "a")], "doc_id long, newspaper_name string")
    assert corpus.clean_corpus(no_text).columns == ["doc_id", "source"]


def test_funnel(spark):
    rows = [(1, "x" * 101, "s" * 21), (2, "x" * 101, "s" * 30), (3, "x" * 100, "s" * 21), (4, None, "s" * 21)]
    df = spark.createDataFrame(rows, "doc_id long, articles_clean string, summary_clean string")
    assert tuple(filters.removal_counts(df).first()) == (4, 2, 1, 1)
