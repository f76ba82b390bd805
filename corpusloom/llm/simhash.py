"""Near duplicates by 64-bit SimHash, linked through a segment-popcount embedding.

A fingerprint is cut into 32 segments of two bits, and its embedding counts the set bits of each. The Manhattan distance of two
embeddings is a lower bound of the Hamming distance. If it is at most 3, it is at most 1 in the first or in the second
half of the dimensions; so a grid with unit cells over the 16 dimensions of a half is joined by range: each fingerprint
sits in its own cell and looks into that cell and the cells one step up in one dimension (the step down is the other
one's step up). Pairs that meet are verified exactly.

Cells where many meet are handled in blocks: each pair of blocks is one group, compared as a whole, and gives only the
links that connect something new, at most one a fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import support

WORDS = 5
DISTANCE = 3
#: A cell where more fingerprints meet is handled in blocks of ``BLOCK``.
CROWD = 64
BLOCK = 1024
#: Masks of the low bits of all segments of half a word, and of half a word.
PAIRS, HALF = 0x55555555, 0xFFFFFFFF
#: Columns that hold two hashes of a whole row.
KEYS = ("_key", "_key2")


def _fingerprint(text: bytes, words: int) -> int:
    """Majority bits of the hashes of all shingles of a text; 0 for a text without words."""
    found = text.lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum([len(word) + 1 for word in found]).tolist()
    size = min(words, len(found))
    cuts = zip([0, *ends], ends[size - 1 :], strict=False)
    hashes = np.array([xxhash.xxh64_intdigest(joined[a : b - 1], 42) for a, b in cuts], "<u8")
    ones = np.zeros(64, np.int64)
    for first in range(0, len(hashes), 1 << 14):
        bits = np.unpackbits(hashes[first : first + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id`` and ``fp``, the fingerprint as a signed 64-bit integer, of every whole text, and the columns ``keep`` of longs.

    A-Z is lower-cased; words lie between ASCII white space; a text of fewer words is one shingle; an empty or null text
    has fingerprint 0.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for batch in batches for part in support.slices(batch, "text", support.BATCH_BYTES)):
            values = np.array([_fingerprint(text, words) for text in support.bytes_of(batch.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values.view(np.int64)), *map(batch.column, keep)], ["doc_id", "fp", *keep])

    texts = support.whole_texts(docs) if not keep else docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *keep)
    return texts.mapInArrow(hashed, ", ".join(f"{name} long" for name in ("doc_id", "fp", *keep)))


def _cells(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Own cells, and the cells each fingerprint looks into: (``half``, ``cell``, ``fp``)."""
    bits = F.array(F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(HALF)))
    counts = F.transform(bits, lambda half: half - F.shiftright(half, 1).bitwiseAND(F.lit(PAIRS)))
    own = points.select("fp", F.posexplode(counts).alias("half", "cell"))
    steps = [F.when(F.shiftright("cell", 2 * i).bitwiseAND(F.lit(3)) < 2, F.col("cell") + (1 << 2 * i)) for i in range(16)]
    look = own.select("half", "fp", F.explode(F.array_compact(F.array(*steps))).alias("cell"))
    return own.select("half", "cell", "fp"), look.select("half", "cell", "fp")


def _links_of_blocks(distance: int):
    def links(group: pd.DataFrame) -> pd.DataFrame:
        """Links of residents of one block with all that look into it from another (or the same) block; those that
        connect two already connected fingerprints are left out."""
        home = group["fp"][group["home"]].drop_duplicates().to_numpy().view(np.uint64)
        guest = group["fp"][~group["home"]].drop_duplicates().to_numpy().view(np.uint64)
        points, label = np.unique(np.concatenate([home, guest]), return_inverse=True)
        mine, theirs = label[: len(home)], label[len(home) :]
        tree = np.arange(len(points))
        out = []
        for at, value in zip(mine.tolist(), home, strict=True):
            near = theirs[np.bitwise_count(guest ^ value) <= distance]
            near = near[tree[near] != tree[at]]
            if len(near):
                roots, first = np.unique(tree[near], return_index=True)
                out += [(points[at], points[other]) for other in near[first]]
                tree[np.isin(tree, roots)] = tree[at]
        found = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
        return pd.DataFrame({"a": found.min(axis=1), "b": found.max(axis=1)})

    return links


def links(points: DataFrame, distance: int = DISTANCE, crowd: int = CROWD, block: int = BLOCK) -> DataFrame:
    """Links (``a``, ``b``), a < b, that connect all of ``points`` (distinct ``fp``) at most ``distance`` (0 to 3) bits apart.

    Pairs from uncrowded cells are all there. From a crowded cell there are enough to connect the same fingerprints.
    """
    own, look = _cells(points)
    own = support.staged(own, "cells")
    # A look into an empty cell meets nobody; the others are as many as the meetings, or fewer.
    homes = own.groupBy("half", "cell").agg(F.count(F.lit(1)).alias("residents"))
    met = look.join(homes, ["half", "cell"]).select("half", "cell", "fp", F.lit(False).alias("home"), "residents")
    met = support.staged(met, "looks")
    guests = met.groupBy("half", "cell").agg(F.count(F.lit(1)).alias("guests"))
    size = homes.join(guests, ["half", "cell"], "left").select("half", "cell", "residents", F.coalesce("guests", F.lit(0)).alias("guests"))
    size = support.staged(size.where("residents > 1 or guests > 0"), "meetings")
    live = support.with_lookup(own, size, ["half", "cell"], "inner")
    few = F.col("residents") + F.col("guests") <= crowd
    near = F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= distance
    here = live.where(few).select("half", "cell", "fp")
    same = F.expr("x.half = y.half and x.cell = y.cell")
    others = support.with_lookup(met, size.drop("residents"), ["half", "cell"], "inner").where(few).select("half", "cell", "fp")
    inside = here.alias("x").join(here.alias("y"), same & (F.col("x.fp") < F.col("y.fp")) & near)
    across = here.alias("x").join(others.alias("y"), same & near)
    pair = [F.least("x.fp", "y.fp").alias("a"), F.greatest("x.fp", "y.fp").alias("b")]
    direct = inside.select(*pair).union(across.select(*pair))

    crowded = support.staged(size.where(~few), "crowded")
    rows = support.with_lookup(own, crowded, ["half", "cell"], "inner")
    blocks, all_blocks = F.ceil(F.col("residents") / block), F.ceil((F.col("residents") + F.col("guests")) / block)
    number = lambda n: F.pmod(F.xxhash64("fp"), n).cast("long")
    spread = lambda n: F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)
    home = rows.select("half", "cell", "fp", F.lit(True).alias("home"), number(blocks).alias("i"), F.explode(spread(all_blocks)).alias("j"))
    looking = support.with_lookup(met.drop("residents"), crowded, ["half", "cell"], "inner")
    seen = rows.unionByName(looking.select(*rows.columns))
    guest = seen.select("half", "cell", "fp", F.lit(False).alias("home"), F.explode(spread(blocks)).alias("i"), number(all_blocks).alias("j"))
    # Dealt here by the whole key: Spark takes a union of joins on a part of it for dealt already, and still runs its sides as tasks of their own.
    dealt = home.unionByName(guest).repartition("half", "cell", "i", "j")
    blocked = dealt.groupBy("half", "cell", "i", "j").applyInPandas(_links_of_blocks(distance), "a long, b long")
    return direct.unionByName(blocked).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(``fp``, ``label``) of every linked fingerprint: the smallest one that can be reached.

    Each round hangs the neighbours of a node to the smallest of them, first the larger and then the smaller ones, until every
    tree is a star. Each round is checkpointed; nothing but the number of changes is gathered.
    """
    edges = support.staged(edges.select("a", "b"), "links")
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
        large = both.where("v > u").join(least, "u").select(F.col("low").alias("a"), F.col("v").alias("b")).where("a <> b")
        large = support.staged(large.distinct(), "large")
        # Now a < b: each node's smaller neighbours, and itself, go to the smallest.
        lowest = large.groupBy("b").agg(F.min("a").alias("low"))
        joined = large.join(lowest, "b")
        small = joined.select(F.col("low").alias("a"), "b").union(joined.select(F.col("low").alias("a"), F.col("a").alias("b")))
        small = support.staged(small.where("a <> b").distinct(), "small")
        # A forest of stars: no node is both a centre and a leaf, and no leaf has two centres.
        centres = small.select(F.col("a").alias("b")).distinct()
        open_ends = small.join(centres, "b", "left_semi").limit(1).count()
        if not open_ends and small.count() == small.select("b").distinct().count():
            stars = small.select(F.col("b").alias("fp"), F.col("a").alias("label"))
            return stars.union(small.select(F.col("a").alias("fp"), F.col("a").alias("label")).distinct())
        edges = small


def _grouped(docs: DataFrame, words: int, distance: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, ``fp``, ``component_id``, ``label`` (a fingerprint that names the component) and ``keep`` of every row."""
    marked = support.staged(fingerprints(docs, words, keep), "fingerprints")
    with support.settings(docs.sparkSession, support.COUNTED):
        classes = support.staged(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
        labels = support.staged(components(links(classes.select("fp"), distance)), "labels")
        members = classes.join(labels, "fp", "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
        lowest = members.join(labels.select("label").distinct(), "label", "left_semi").groupBy("label").agg(F.min("first").alias("lowest"))
        known = support.staged(members.join(lowest, "label", "left").select("fp", F.coalesce("lowest", "first").alias("component_id"), "label"), "components")
    return support.with_lookup(marked, known, ["fp"], "left").select("doc_id", "fp", "component_id", "label", *keep)


def near_duplicates(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id``, the smallest ``doc_id`` that links reach, for every row.

    Rows without ``doc_id`` take part, but name no component unless all of it have none (then null). Repeated rows and
    equal texts share a fingerprint and so a component. An empty table gives no rows.
    """
    return _grouped(docs, words, distance).select("doc_id", "fp", "component_id")


def fingerprint_text() -> Column:
    """16 lowercase hexadecimal digits of ``fp``."""
    return F.lpad(F.lower(F.hex("fp")), 16, "0")


def _row_keys(docs: DataFrame) -> list[Column]:
    """Two hashes of a whole row: together they tell rows apart. Columns with maps, which cannot be hashed, go in as JSON."""
    as_text = lambda column: F.to_json(F.struct(column.alias("v")), {"ignoreNullFields": "false"})
    names = [as_text(F.col(f"`{name}`")) if "map<" in kind or "variant" in kind else F.col(f"`{name}`") for name, kind in docs.dtypes]
    values = [*names, *[F.isnull(name) for name in names]]
    return [F.xxhash64(F.lit(seed), *values).alias(key) for seed, key in enumerate(KEYS)]


def one_of_each(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """One row of ``docs``, all columns, of each component: the one with the smallest ``doc_id``.

    Rows without ``doc_id`` come last. Among rows that share the smallest id, or all without one, the smallest hash of
    the whole row stays. Each row is judged in its own component, so another row with its ``doc_id`` does not remove it.
    """
    row = F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("_row")
    keyed = docs.select(row, *_row_keys(docs))
    texts = keyed.select("_row.doc_id", "_row.text", *KEYS)
    found = support.staged(_grouped(texts, words, distance, KEYS).select("doc_id", "label", *KEYS), "grouped")
    order = F.struct(F.isnull("doc_id").alias("late"), "doc_id", *KEYS)
    best = found.groupBy("label").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    best = support.staged(best.select("label", *[F.col(f"best.{key}").alias(f"{key}_best") for key in KEYS]), "best")
    members = support.with_lookup(found, best, ["label"], "inner")
    stays = F.expr(" and ".join(f"{key} = {key}_best" for key in KEYS))
    counted = support.staged(members.groupBy(*KEYS).agg(F.first(stays).alias("stays"), F.count(F.lit(1)).alias("rows")), "counted")
    gone, again = counted.where("not stays").select(*KEYS), counted.where("stays and rows > 1").select(*KEYS)
    kept = support.with_lookup(keyed, gone, list(KEYS), "left_anti")
    if again.limit(1).count():
        # Only rows that occur several times are shuffled.
        once = support.with_lookup(kept, again, list(KEYS), "left_anti")
        kept = once.unionByName(support.with_lookup(kept, again, list(KEYS), "left_semi").dropDuplicates(list(KEYS)))
    return kept.select("_row.*")
