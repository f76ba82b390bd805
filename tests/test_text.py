import random
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import entities as en
from corpusloom.functions import sentences as st
from corpusloom.functions import text as tx


def one(spark, function, value):
    return spark.createDataFrame([(value,)], "t string").select(function(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(
    "text, expected",
    [
        ("a<b>c</b>d", "acd"),
        ("x&amp;y", "x y"),
        ("a&#39;b", "a b"),
        ("a&#x27;b", "a&#x27;b"),
        ("go http://a.b/c now", "go now"),
        ("see www.x.y now", "see now"),
        ("to me@x.y now", "to now"),
        ("@name and a@ stay", "@name and a@ stay"),
        ("@@a goes", "goes"),
        ("tab\t\tand\n\nline  end ", "tab and line end"),
        ("<open only", "<open only"),
        ("", ""),
        (None, None),
    ],
)
def test_clean_text(spark, text, expected):
    assert one(spark, tx.clean_text, text) == expected


def plain_clean(text):
    for pattern, by in ((r"<[^>]+>", ""), (r"&[a-zA-Z]+;", " "), (r"&#[0-9]+;", " "), (r"\s+", " ")):
        text = re.sub(pattern, by, text)
    text = text.strip()
    text = re.sub(r"\S+@\S+", "", re.sub(r"http\S+|www\.\S+", "", text))
    return re.sub(r"\s+", " ", text).strip()


def test_clean_text_equals_step_by_step_rules(spark):
    rng = random.Random(7)
    parts = ["a", "b", "@", "<", ">", "&amp;", "&#39;", "&#x27;", " ", "\n", " ", " ", "\x1c", "http", "www.", "&", "#", ";", "é", "/"]
    rows = [("".join(rng.choices(parts, k=rng.randint(0, 25))),) for _ in range(5000)]
    out = spark.createDataFrame(rows, "t string").select("t", tx.clean_text(F.col("t")).alias("c")).collect()
    assert [(r.t, r.c) for r in out if plain_clean(r.t) != r.c] == []


def test_cleaning_is_linear_on_long_runs(spark):
    for text in ("a" * 300_000, "@" * 300_000, "<" * 20_000, "&" + "a" * 300_000, "x@" * 100_000):
        one(spark, lambda c: F.length(tx.clean_text(c)), text)


def test_counts(spark):
    assert one(spark, tx.count_tokens, "  two\twords ") == 2
    assert one(spark, tx.count_tokens, "") == 0
    assert one(spark, tx.count_tokens, "   ") == 0
    assert one(spark, tx.count_tokens, None) == 0
    assert one(spark, tx.count_words, "l'été, 3_4 x") == 4
    assert one(spark, tx.count_words, None) == 0


def test_keywords(spark):
    assert one(spark, tx.keywords, "The cat Cats with From cats, abc Abcd") == ["abcd", "cats", "cats,"]
    assert one(spark, tx.keywords, "the of a") == []


def test_sentences(spark):
    text = "1234567890 1. 123456789. 1234567890. Is it so? Yes! No way out"
    assert one(spark, st.split_sentences, text) == ["1234567890 1.", "1234567890."]
    assert one(spark, lambda c: st.split_sentences(c, 9), "123456789. 12345678.") == ["123456789."]


def test_packing(spark):
    packed = one(spark, lambda c: st.pack(F.split(c, ","), 4), "one,two")
    assert packed == "one|||two||||||"
    assert one(spark, st.unpack, packed) == ["one", "two", "", ""]
    assert one(spark, st.count_filled, packed) == 2
    assert one(spark, lambda c: st.slot_mask(c, 4), packed) == [1, 1, 0, 0]
    assert one(spark, st.packed_to_text, packed) == "one two  "
    assert one(spark, lambda c: st.pack(F.split(c, ","), 2), "a,b,c") == "a|||b"


def test_mentions(spark):
    assert one(spark, en.mentions, "Élan Vital met Bob. Bob left") == ["bob", "élan vital"]
    assert one(spark, lambda c: en.mentions(c, en.DATE_PATTERN), "on May 5, 2020 or 7 June 1999, 2021-01-02 and July 2001") == [
        "2021-01-02", "7 june 1999", "july 2001", "may 5, 2020",
    ]
    assert one(spark, lambda c: en.mentions(c, en.MONEY_PATTERN), "$1,000.50 and Rs. 5 crore; €7") == ["$1,000.50", "rs. 5 crore", "€7"]
    assert one(spark, en.mentions, None) == []
