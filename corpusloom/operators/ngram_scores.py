"""Overlap scores of generated texts: ROUGE-1, ROUGE-2, ROUGE-L, corpus BLEU, greedy vector matching."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions import text as tx
from corpusloom.operators.lookup import looked_up
from corpusloom.shared import DICTIONARY_BYTES, SALTS, computed_once, cut_lineage, dictionary_bytes, row_by_row

BLOCK = 64
_BEST = T.StructType([T.StructField(side, T.ArrayType(T.DoubleType())) for side in ("gen", "ref")])


def rouge_tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits; everything else separates."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]++"), F.lit(0))


def bleu_tokens(text: Column) -> Column:
    """Tokens of the "13a" rule of the machine translation evaluations, upper and lower case kept apart."""
    # Entities decoded and symbols split off by the rule.
    line = F.replace(text, F.lit("<skipped>"), F.lit(""))
    line = F.replace(line, F.lit("-\n"), F.lit(""))
    line = F.replace(line, F.lit("\n"), F.lit(" "))
    for entity, char in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        line = F.replace(line, F.lit(entity), F.lit(char))
    line = F.concat(F.lit(" "), line, F.lit(" "))
    line = F.regexp_replace(line, r"([{-~\[-`!-&(-+:-@/])", " $1 ")
    line = F.regexp_replace(line, r"([^0-9])([.,])", "$1 $2 ")
    line = F.regexp_replace(line, r"([.,])([^0-9])", " $1 $2")
    line = F.regexp_replace(line, r"([0-9])(-)", "$1 $2 ")
    return tx.tokens(tx.blank_space(line))


def token_pairs(pairs: DataFrame, tokenizer=rouge_tokens) -> DataFrame:
    """``(pair_id, gen, ref)`` with token arrays of the generated and the reference text."""

    def split(c: str) -> Column:
        return tokenizer(F.coalesce(F.col(c), F.lit("")))

    return pairs.select("pair_id", split("generated").alias("gen"), split("reference").alias("ref"))


def stem_pairs(tokens: DataFrame, stems: DataFrame, max_bytes: int = DICTIONARY_BYTES, min_len: int = 1) -> DataFrame:
    """Replace tokens by their stem where the table ``(token, stem[, n])`` has one.

    Tokens are replaced where they lie (``lookup.looked_up``). A table of more than ``max_bytes`` should say how frequent its tokens
    are (``n``), also those that are their own stem: the most frequent are a dictionary, and only other tokens, of at least ``min_len``
    characters, become rows.
    """
    order = -F.col("n") if "n" in stems.columns else F.length("token")
    stems = cut_lineage(stems.select("token", "stem", order.alias("_order")))
    changed = stems.where("token <> stem")
    whole = stems if dictionary_bytes(changed) > max_bytes else changed
    found = looked_up(tokens, ["pair_id"], {"_found": F.concat_ws("\n", F.array_join("gen", " "), F.array_join("ref", " "))}, whole, lambda t: t, max_bytes, min_len)
    return found.select("pair_id", *[tx.tokens(F.get("_found", F.lit(part))).alias(side) for part, side in enumerate(("gen", "ref"))])


def _clipped(gen: list[str], ref: list[str], orders: tuple[int, ...]) -> list[int]:
    """Matches of each order, a gram counting at most as often as it occurs on the other side."""
    number: dict[str, int] = {}
    ids = np.array([number.setdefault(t, len(number)) for t in (*gen, *ref)], dtype=np.int64)
    cut = len(gen)
    first, second = ids[:cut], ids[cut:]
    found = []
    for n in range(1, max(orders) + 1):
        if n > 1:
            # A gram is the number of its beginning and the number of its last token; both fit 31 bits.
            first, second = first[: max(cut - n + 1, 0)], second[: max(len(ids) - cut - n + 1, 0)]
            both = np.concatenate([first * len(number) + ids[n - 1 : cut], second * len(number) + ids[cut + n - 1 :]])
            both = np.unique(both, return_inverse=True)[1]
            first, second = both[: len(first)], both[len(first) :]
        if n in orders:
            size = max(first.max(initial=-1), second.max(initial=-1)) + 1
            found.append(int(np.minimum(np.bincount(first, minlength=size), np.bincount(second, minlength=size)).sum()))
    return found


def ngram_matches(tokens: DataFrame, orders: tuple[int, ...], longest: bool = False) -> DataFrame:
    """``(pair_id, gen_len, ref_len, match_<n>...)``: clipped matches of each order, one row per pair; ``longest`` adds ``lcs``.

    Both sides of a pair lie on its row, so all orders are counted there, in Arrow batches, and nothing is shuffled.
    """

    @F.arrow_udf("array<long>")
    def matches(gen: pa.Array, ref: pa.Array) -> pa.Array:
        return pa.array([_clipped(g.split(" ") if g else [], r.split(" ") if r else [], orders) for g, r in row_by_row(gen, ref)], pa.list_(pa.int64()))

    sizes = [F.size(side).cast("bigint").alias(f"{side}_len") for side in ("gen", "ref")]
    texts = F.array_join("gen", " "), F.array_join("ref", " ")
    made = {"_found": matches(*texts)} | ({"lcs": lcs_length(*texts)} if longest else {})
    counted = computed_once(tokens.select("pair_id", *sizes, *[c.alias(name) for name, c in made.items()]), {name: F.col(name) for name in made})
    ordered = sorted(orders)
    found = [F.get("_found", F.lit(ordered.index(n))).alias(f"match_{n}") for n in orders]
    return counted.select("pair_id", "gen_len", "ref_len", *found, *(["lcs"] if longest else []))


def _n_grams(length: Column, n: int) -> Column:
    return F.greatest(length - (n - 1), F.lit(0))


def f_measure(match: Column, n_gen: Column, n_ref: Column) -> dict[str, Column]:
    """Precision, recall and F1; all 0 where a side is empty."""
    precision = F.when(n_gen > 0, match / n_gen).otherwise(0.0)
    recall = F.when(n_ref > 0, match / n_ref).otherwise(0.0)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return {"precision": precision, "recall": recall, "f1": f1}


def rouge_scores(tokens: DataFrame, orders: tuple[int, ...] = (1, 2)) -> DataFrame:
    """``(pair_id, rouge<n>...)``: F1 of each order, counted in one pass."""
    matches = ngram_matches(tokens, orders)
    scores = {n: f_measure(F.col(f"match_{n}"), _n_grams(F.col("gen_len"), n), _n_grams(F.col("ref_len"), n))["f1"] for n in orders}
    return matches.select("pair_id", *[score.alias(f"rouge{n}") for n, score in scores.items()])


def _draws(ids: Iterable[str | None], resamples: int, seed: int) -> np.ndarray:
    """A row for each id: how often each resample draws it."""
    # Probabilities of at most k draws, for k = 0, 1, ...
    limits, term, total = [], math.exp(-1), 0.0
    for k in range(1, 13):
        total += term
        limits.append(total)
        term /= k
    ends = [f"{four}:{seed}".encode() for four in range(-(-resamples // 4))]
    starts = [b"" if x is None else x.encode() + b":" for x in ids]
    digests = b"".join([hashlib.md5(start + end).digest() for start in starts for end in ends])
    numbers = np.frombuffer(digests, dtype=">u4").reshape(len(starts), -1)[:, :resamples] / 2.0**32
    return np.searchsorted(limits, numbers, side="right")


def resample_weights(id_col: str, resamples: int, seed: int = 0) -> Column:
    """For each resample, how often a row is drawn: Poisson counts with mean 1, from a hash of the row's id and the resample.

    A hash gives the counts of four resamples. Whatever task holds the row, and however often, its counts are the same.
    """

    @F.pandas_udf("array<int>")
    def weights(ids: pd.Series) -> pd.Series:
        return pd.Series(list(_draws(ids, resamples, seed).astype(np.int32)), dtype="object")

    return weights(F.col(id_col).cast("string"))


def bootstrap_means(scores: DataFrame, columns: tuple[str, ...], id_col: str = "pair_id", resamples: int = 1000, level: float = 0.95, seed: int = 0) -> DataFrame:
    """``(metric, mean, low, mid, high)``: the mean of each column, and the middle and the ends of the interval that holds ``level`` of its
    means over resamples of the rows.

    Rows are drawn by Poisson counts instead of with replacement, so every row is looked at once, wherever it lies, and a task passes on
    one sum a resample and Arrow batch, whatever the number of rows. Missing scores take part in neither sums nor counts.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = np.column_stack([batch.column(k + 1).to_numpy(zero_copy_only=False).astype(float) for k in range(len(columns))])
            ids = batch.column(0).to_pylist()
            total, drawn = np.zeros((2, len(columns), resamples))
            for start in range(0, len(ids), 1024):
                part = value[start : start + 1024]
                real = ~np.isnan(part)
                weights = _draws(ids[start : start + 1024], resamples, seed).astype(float)
                total += np.where(real, part, 0.0).T @ weights
                drawn += real.astype(float).T @ weights
            found = [np.repeat(np.arange(len(columns)), resamples), np.tile(np.arange(resamples), len(columns)), total.ravel(), drawn.ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["_metric", "_resample", "_total", "_drawn"])

    rows = scores.select(F.col(id_col).cast("string").alias("_id"), *[F.col(c).cast("double").alias(f"_{k}") for k, c in enumerate(columns)])
    drawn = rows.mapInArrow(sums, "_metric long, _resample long, _total double, _drawn double").where("_drawn > 0")
    name = F.get(F.array(*[F.lit(c) for c in columns]), F.col("_metric").cast("int"))
    means = drawn.groupBy(name.alias("metric"), "_resample").agg((F.sum("_total") / F.sum("_drawn")).alias("mean"))
    values = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns])
    ends = F.array(*[F.lit(p) for p in ((1 - level) / 2, 0.5, (1 + level) / 2)])
    spread = means.groupBy("metric").agg(F.percentile("mean", ends).alias("_at"))
    real = scores.select(F.inline(values)).where("not isnan(value)").groupBy("metric").agg(F.avg("value").alias("mean"))
    return real.join(F.broadcast(spread), "metric", "left").select("metric", "mean", *[F.col("_at")[i].alias(name) for i, name in enumerate(("low", "mid", "high"))])


def rouge_n(tokens: DataFrame, n: int) -> DataFrame:
    """``(pair_id, precision, recall, f1)``."""
    matches = ngram_matches(tokens, (n,))
    scores = f_measure(F.col(f"match_{n}"), _n_grams(F.col("gen_len"), n), _n_grams(F.col("ref_len"), n))
    return matches.select("pair_id", *[c.alias(name) for name, c in scores.items()])


def _common_subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence, one bit per element of ``b``; tokens that only one side has are left out."""
    shared = set(a) & set(b)
    a, b = [t for t in a if t in shared], [t for t in b if t in shared]
    places: dict = {}
    for i, token in enumerate(b):
        places[token] = places.get(token, 0) | (1 << i)
    everywhere = (1 << len(b)) - 1
    row = everywhere
    for token in a:
        hits = row & places[token]
        if hits:
            row = ((row + hits) | (row - hits)) & everywhere
    return len(b) - row.bit_count()


@F.arrow_udf(T.LongType())
def lcs_length(gen: pa.Array, ref: pa.Array) -> pa.Array:
    """Of two texts of blank-separated tokens."""
    return pa.array([_common_subsequence(a.split(), b.split()) for a, b in row_by_row(gen, ref)], pa.int64())


def rouge_l(tokens: DataFrame) -> DataFrame:
    """``(pair_id, lcs, precision, recall, f1)`` from the longest common subsequence of the whole texts."""
    measured = tokens.select(
        "pair_id", lcs_length(F.array_join("gen", " "), F.array_join("ref", " ")).alias("lcs"), F.size("gen").alias("gen_len"), F.size("ref").alias("ref_len")
    )
    scores = f_measure(F.col("lcs"), F.col("gen_len"), F.col("ref_len"))
    return measured.select("pair_id", "lcs", *[c.alias(name) for name, c in scores.items()])


def rouge_report(tokens: DataFrame, orders: tuple[int, ...] = (1, 2), longest: bool = False) -> DataFrame:
    """Corpus means of F1, with every order counted in one pass; ``longest`` adds ``rougeL``, counted in the same one."""
    matches = ngram_matches(tokens, orders, longest)
    subsequence = [F.avg(f_measure(F.col("lcs"), F.col("gen_len"), F.col("ref_len"))["f1"]).alias("rougeL")] if longest else []
    return matches.agg(
        F.count("*").alias("n_pairs"),
        *[
            F.avg(f_measure(F.col(f"match_{n}"), _n_grams(F.col("gen_len"), n), _n_grams(F.col("ref_len"), n))["f1"]).alias(f"rouge{n}")
            for n in orders
        ],
        *subsequence,
    )


def corpus_bleu(tokens: DataFrame, max_order: int = 4) -> DataFrame:
    """One row: score, brevity penalty, lengths, matches per order.

    Exponential smoothing: the i-th order without a match counts as 1 / 2^i matches. The score is 0 if no
    order has a match or an order has no n-grams at all.
    """
    orders = tuple(range(1, max_order + 1))
    sums = ngram_matches(tokens, orders).agg(
        F.coalesce(F.sum("gen_len"), F.lit(0)).alias("gen_len"),
        F.coalesce(F.sum("ref_len"), F.lit(0)).alias("ref_len"),
        *[F.coalesce(F.sum(f"match_{n}"), F.lit(0)).alias(f"match_{n}") for n in orders],
        *[F.coalesce(F.sum(_n_grams(F.col("gen_len"), n)), F.lit(0)).alias(f"total_{n}") for n in orders],
    )
    logs = F.lit(0.0)
    zeros = F.lit(0)
    any_match = F.lit(False)
    all_totals = F.lit(True)
    for n in orders:
        match, total = F.col(f"match_{n}"), F.col(f"total_{n}")
        zeros = zeros + F.when(match == 0, 1).otherwise(0)
        counted = F.when(match > 0, match.cast("double")).otherwise(F.pow(F.lit(0.5), zeros))
        logs = logs + F.when(total > 0, F.log(counted / F.greatest(total, F.lit(1)))).otherwise(0.0)
        any_match = any_match | (match > 0)
        all_totals = all_totals & (total > 0)
    brevity = F.when(F.col("gen_len") >= F.col("ref_len"), F.lit(1.0)).otherwise(
        F.when(F.col("gen_len") > 0, F.exp(1 - F.try_divide("ref_len", "gen_len"))).otherwise(0.0)
    )
    score = F.when(any_match & all_totals, 100 * F.col("brevity_penalty") * F.exp(logs / max_order)).otherwise(0.0)
    return sums.withColumn("brevity_penalty", brevity).select(
        score.alias("score"), "brevity_penalty", "gen_len", "ref_len", *[f"match_{n}" for n in orders]
    )


@F.arrow_udf(_BEST)
def _best_matches(gen: pa.Array, ref: pa.Array) -> pa.Array:
    """Best cosine of every vector of a block with the vectors of the other block, both ways."""

    def unit(block) -> np.ndarray:
        matrix = np.stack([np.asarray(v, dtype=np.float64) for v in block])
        return matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)

    found = []
    for g, r in row_by_row(gen, ref):
        cosines = unit(g) @ unit(r).T
        found.append((cosines.max(axis=1), cosines.max(axis=0)))
    sides = [pa.array([pair[side] for pair in found], pa.list_(pa.float64())) for side in (0, 1)]
    return pa.StructArray.from_arrays(sides, ["gen", "ref"])


def greedy_vector_f1(vectors: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(pair_id, precision, recall, f1)`` from ``(pair_id, side, pos, vec)``, side 0 generated, 1 reference.

    Every token takes its most similar token on the other side; precision averages over the generated
    tokens, recall over the reference. ``pos`` numbers the tokens of a side. Tokens are compared in blocks
    of at most ``block`` vectors, and only the best value per token leaves a comparison. The generated
    blocks of a long text go to different tasks, each with its own copy of the reference blocks; a text of
    one block is not copied. A pair with an empty side scores 0.
    """
    number = F.floor(F.col("pos") / block)
    sizes = vectors.groupBy("pair_id").agg(F.max(F.when(F.col("side") == 0, number)).alias("_last"))
    blocks = vectors.groupBy("pair_id", "side", number.alias("block")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "vec"))), lambda t: t["vec"]).alias("vecs")
    )
    gen = blocks.where("side = 0").select(
        "pair_id", F.pmod("block", F.lit(SALTS)).alias("_salt"), F.col("block").alias("gen_block"), F.col("vecs").alias("gen_vecs")
    )
    ref = blocks.where("side = 1").select("pair_id", F.col("block").alias("ref_block"), F.col("vecs").alias("ref_vecs"))
    salts = F.sequence(F.lit(0).cast("bigint"), F.least("_last", F.lit(SALTS - 1)))
    copies = ref.join(sizes.where("_last is not null"), "pair_id").select("*", F.explode(salts).alias("_salt"))
    compared = gen.join(copies, ["pair_id", "_salt"]).select(
        "pair_id", "gen_block", "ref_block", _best_matches("gen_vecs", "ref_vecs").alias("best")
    )

    def tagged(side: int, block_col: str, values: str) -> Column:
        return F.transform(
            values,
            lambda x, i: F.struct(F.lit(side).alias("side"), F.col(block_col).alias("block"), i.alias("i"), x.alias("best")),
        )

    tokens = compared.select("pair_id", F.inline(F.concat(tagged(0, "gen_block", "best.gen"), tagged(1, "ref_block", "best.ref"))))
    per_token = tokens.groupBy("pair_id", "side", "block", "i").agg(F.max("best").alias("best"))
    scored = per_token.groupBy("pair_id").agg(
        F.avg(F.when(F.col("side") == 0, F.col("best"))).alias("p"), F.avg(F.when(F.col("side") == 1, F.col("best"))).alias("r")
    )
    p, r = F.coalesce("p", F.lit(0.0)), F.coalesce("r", F.lit(0.0))
    everyone = sizes.join(scored, "pair_id", "left")
    return everyone.select(
        "pair_id", p.alias("precision"), r.alias("recall"), F.when(p + r != 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1")
    )
