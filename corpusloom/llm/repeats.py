"""Long passages that documents share, found with prefix-partitioned suffix trees.

A window of ``WINDOW`` words always holds a sampled place: the start of the ``STEM`` words with the smallest hash in it. The
suffixes that start at sampled places are indexed, each with the words in front of it that its windows reach back to. Where
two texts share a window, two of these suffixes share a prefix, and the words in front of them agree:

1. The hashes of the stems are dealt out; only suffixes whose stem starts in more than one text go on.
2. Suffixes are split into groups by prefixes of variable length: by few words where few suffixes share them, by more where many do
   (``PREFIXES``, ``CROWD``), so each group fits a task's memory.
3. Each group becomes a suffix tree, in the form of its sorted suffixes and the lengths of their common prefixes. Its internal nodes
   that lie deep enough, with the agreeing words in front, are the repeats; a node's smallest document owns the passage.
4. The windows found in other documents are put together, so that a repeat is as long as it goes.

Equal texts are one text of the smallest document that has it. Where one text brings the same suffix many times, or a batch of
texts does, one of them goes on. A prefix of the whole stem that is still crowded is split further, by whole windows, and
their owners are counted up with a sum that Spark begins before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import support

WINDOW, STEM = 13, 7
#: Words of the prefixes that split the suffixes, and how many suffixes may share one before a longer one is taken.
PREFIXES, CROWD = (2, 4, 7), 2000
#: Bytes of text that are worked on together, and that one bucket of stems covers; rows of a group's batch. They bound memory.
PIECE_BYTES, BUCKET_BYTES, TREE_ROWS = 2_000_000, 24_000_000, 20_000
#: The place of documents without an id, after all others.
NO_ID = 2**63 - 1
#: Bits of a stem's hash that are compared, and of a text's number in its piece.
HASH_BITS, PLACE_BITS = 48, 16


def text_keys(text: Column) -> list[Column]:
    """Two hashes that tell texts apart."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("second"), text).alias("k2")]


class Sampled:
    """The sampled places of the texts of one piece: windows ``first`` to ``last`` (numbers of their first words) share the
    stem at ``place``, with hash ``stem``, in the text ``text``."""

    def __init__(self, texts: pa.Array) -> None:
        self.words, self.sizes = support.words_of(texts)
        self.begin = np.cumsum(self.sizes) - self.sizes
        coded = self.words.dictionary_encode()
        hashes = np.array([xxhash.xxh64_intdigest(word) for word in coded.dictionary.to_pylist()], np.uint64)
        hashes = hashes[coded.indices.to_numpy()] if len(hashes) else hashes
        n = len(hashes) - WINDOW + 1
        of = np.repeat(np.arange(len(self.sizes)), self.sizes)
        if n <= 0:
            self.text = self.place = self.first = self.last = np.zeros(0, np.int64)
            self.stem = np.zeros(0, np.uint64)
            return
        stems = np.zeros(len(hashes) - STEM + 1, np.uint64)
        for k in range(STEM):
            stems = stems * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + len(stems)]
        stems ^= stems >> np.uint64(31)
        stems *= np.uint64(0xBF58476D1CE4E5B9)
        stems >>= np.uint64(64 - HASH_BITS)
        least, place = stems[:n].copy(), np.arange(n)
        for k in range(1, WINDOW - STEM + 1):
            less = stems[k : k + n] < least
            least[less] = stems[k : k + n][less]
            place[less] = np.flatnonzero(less) + k
        whole = of[:n] == of[WINDOW - 1 :]
        start, place = np.flatnonzero(whole), place[whole]
        new = np.append(True, place[1:] != place[:-1]) if len(place) else np.zeros(0, bool)
        runs = np.flatnonzero(new)
        self.place, self.first = place[runs], start[runs]
        self.last = start[np.append(runs[1:], len(start)) - 1] if len(runs) else start
        self.text, self.stem = of[self.place], stems[self.place]

    def joined(self, first: np.ndarray, last: np.ndarray) -> pa.Array:
        """The words from each ``first`` up to ``last``, joined by blanks."""
        sizes = last - first
        ends = np.cumsum(sizes)
        which = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - sizes - first, sizes)
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), self.words.take(pa.array(which)))
        return pc.binary_join(lists, " ")


def _packed(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Stretches of ``values`` up to each end as binaries."""
    sizes = np.append(0, ends).astype(np.int32) * np.int32(values.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(sizes), pa.py_buffer(np.ascontiguousarray(values))])


def _distinct(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The first of all rows with equal keys, with the smallest document of them."""
    table = pd.DataFrame({name: batch.column(name).to_numpy(zero_copy_only=False) for name in ("k1", "k2", "doc")})
    smallest = table.groupby(["k1", "k2"], sort=False)["doc"].transform("min")
    first = np.flatnonzero(~table.duplicated(["k1", "k2"]).to_numpy())
    out = batch.take(pa.array(first))
    return out.set_column(batch.schema.get_field_index("doc"), "doc", pa.array(smallest.to_numpy()[first], pa.int64()))


def _stems(buckets: int):
    """Rows of (``bucket``, ``known``, ``stems``, ``texts``): the stems of a piece that fall into a bucket, with the place of their
    text in ``texts``, each stem once; and the stems that several texts of the piece have, for all these texts, as ``known``."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in support.slices(_distinct(batch), "text", PIECE_BYTES):
                found = Sampled(part.column("text"))
                keys = part.column("k1").to_numpy()
                marked = np.unique(found.stem << np.uint64(PLACE_BITS) | found.text.astype(np.uint64))
                stem = marked >> np.uint64(PLACE_BITS)
                first = np.append(True, stem[1:] != stem[:-1]) if len(stem) else np.zeros(0, bool)
                several = ~(first & np.append(first[1:], True)) if len(stem) else first
                bucket = (stem % np.uint64(buckets)).astype(np.int64)
                yield rows(marked[first], bucket[first], keys, False)
                spread = keys[(marked & np.uint64(2**PLACE_BITS - 1)).astype(np.int64)] % buckets
                yield rows(marked[several], spread[several], keys, True)

    def rows(marked: np.ndarray, bucket: np.ndarray, keys: np.ndarray, known: bool) -> pa.RecordBatch:
        order = np.argsort(bucket, kind="stable")
        marked, bucket = marked[order], bucket[order]
        ends = np.flatnonzero(np.append(bucket[1:] != bucket[:-1], True)) + 1 if len(bucket) else np.zeros(0, int)
        blobs, texts, numbers = [], [], []
        for a, b in zip([0, *ends[:-1]], ends, strict=False):
            place, mine = np.unique(marked[a:b] & np.uint64(2**PLACE_BITS - 1), return_inverse=True)
            stems = marked[a:b] >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS) | mine.astype(np.uint64)
            blobs.append(stems.tobytes())
            texts.append(keys[place.astype(np.int64)].tobytes())
            numbers.append(int(bucket[a]))
        columns = [pa.array(numbers, pa.int64()), pa.array([known] * len(numbers), pa.bool_()), pa.array(blobs, pa.binary()), pa.array(texts, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["bucket", "known", "stems", "texts"])

    return dealt


def _shared(groups: int):
    """Rows of (``part``, ``stems``, ``texts``) for each group of texts: stems that start in another text too, and the text of each.
    Rows come ordered by bucket."""

    def out(stems: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
        part = keys % groups
        order = np.lexsort((stems, keys, part))
        stems, keys, part = stems[order], keys[order], part[order]
        ends = np.flatnonzero(np.append(part[1:] != part[:-1], True)) + 1 if len(part) else np.zeros(0, int)
        return pa.RecordBatch.from_arrays([pa.array(part[ends - 1], pa.int64()), _packed(stems, ends), _packed(keys, ends)], ["part", "stems", "texts"])

    def unpacked(stems: bytes, texts: bytes) -> tuple[np.ndarray, np.ndarray]:
        marked = np.frombuffer(stems, np.uint64)
        return marked >> np.uint64(PLACE_BITS), np.frombuffer(texts, np.int64)[(marked & np.uint64(2**PLACE_BITS - 1)).astype(np.int64)]

    def compared(held: list, known: list) -> Iterator[pa.RecordBatch]:
        stems, keys = (np.concatenate([*x, np.zeros(0, kind)]) for x, kind in zip(zip(*held, strict=True) if held else ((), ()), (np.uint64, np.int64), strict=True))
        order = np.lexsort((keys, stems))
        stems, keys = stems[order], keys[order]
        if len(stems):
            new = np.append(True, stems[1:] != stems[:-1])
            other = np.append(False, (keys[1:] != keys[:-1]) & ~new[1:])
            several = np.logical_or.reduceat(other, np.flatnonzero(new))[np.cumsum(new) - 1]
            stems, keys = stems[several], keys[several]
        yield out(np.concatenate([stems, *(x[0] for x in known)]), np.concatenate([keys, *(x[1] for x in known)]))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, known, now = [], [], None
        for batch in batches:
            for bucket, sure, stems, texts in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if bucket != now and now is not None:
                    yield from compared(held, known)
                    held, known = [], []
                now = bucket
                (known if sure else held).append(unpacked(stems, texts))
        if now is not None:
            yield from compared(held, known)

    return found


SUFFIX = "k1 long, k2 long, doc long, begins binary, front string, suffix string"
MARK = "k1 long, k2 long, starts binary"


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(``k1``, ``k2``, ``doc``, ``packed``): each text of a batch once, compressed."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        batch = _distinct(batch)
        packed = [pack(text) for text in support.bytes_of(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("k1", "k2", "doc")), pa.array(packed, pa.binary())], ["k1", "k2", "doc", "packed"])


def _marks(k1: np.ndarray, k2: np.ndarray, starts: np.ndarray) -> tuple[pa.Array, pa.Array, pa.Array]:
    """One row for each text, with all first words of its windows that were found elsewhere."""
    order = np.lexsort((starts, k2, k1))
    k1, k2, starts = k1[order], k2[order], starts[order].astype("<i4")
    ends = np.flatnonzero(np.append((k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]), True)) + 1 if len(k1) else np.zeros(0, int)
    return pa.array(k1[ends - 1], pa.int64()), pa.array(k2[ends - 1], pa.int64()), _packed(starts, ends)


LEAF_INPUT = ("part", "k1", "k2", "doc", "packed", "stems", "texts")
LEAVES = f"{SUFFIX}, packed binary, open boolean, starts binary"


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The suffixes of every text that share their stems with another text, and the texts themselves, ``open`` if they have such.

    Rows come ordered by ``part``: first the stems of its texts, then the texts by ``k1``, ``k2`` and ``doc``, of which the first counts.
    Of equal suffixes (with equal words in front) only those of the smallest document go on; the windows of the others are marked.
    """
    unpack = zstandard.ZstdDecompressor().decompress
    now = last = found = None
    rows: list[tuple[bytes, bytes]] = []
    held: list[tuple[int, int, int, bytes, bytes, np.ndarray]] = []
    size = 0
    for batch in batches:
        for part, k1, k2, doc, packed, stems, texts in zip(*(batch.column(k).to_pylist() for k in LEAF_INPUT), strict=True):
            if part != now:
                now, last, found, rows = part, None, None, []
            if k1 is None:
                rows.append((stems, texts))
                continue
            if found is None:
                keys, marks = (np.frombuffer(b"".join(row[side] for row in rows), kind) for side, kind in ((1, np.int64), (0, np.uint64)))
                order = np.argsort(keys, kind="stable")
                found, rows = (keys[order], marks[order]), []
            if (k1, k2) != last:
                last = (k1, k2)
                text = unpack(packed) if len(packed) else b""
                a, b = np.searchsorted(found[0], k1), np.searchsorted(found[0], k1, "right")
                held.append((k1, k2, doc, text, packed, found[1][a:b]))
                size += len(text)
                if size >= PIECE_BYTES or len(held) >= 2**PLACE_BITS:
                    yield from _piece(held)
                    held, size = [], 0
    if held:
        yield from _piece(held)


def _batch(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    n = len(columns["k1"])
    names = {"k1": pa.int64(), "k2": pa.int64(), "doc": pa.int64(), "begins": pa.binary(), "front": pa.string(), "suffix": pa.string(), "packed": pa.binary(), "open": pa.bool_(), "starts": pa.binary()}
    return pa.RecordBatch.from_arrays([columns[name] if name in columns else pa.nulls(n, kind) for name, kind in names.items()], list(names))


def _piece(held: list) -> Iterator[pa.RecordBatch]:
    k1, k2, doc = (np.array([row[k] for row in held], np.int64) for k in range(3))
    packed, some = pa.array([row[4] for row in held], pa.binary()), pa.array([len(row[5]) > 0 for row in held])
    yield _batch({"k1": pa.array(k1), "k2": pa.array(k2), "doc": pa.array(doc), "packed": packed, "open": some})
    if not any(len(row[5]) for row in held):
        return
    found = Sampled(pa.array([row[3] if len(row[5]) else b"" for row in held], pa.binary()).cast(pa.string(), safe=False))
    wanted = [row[5] << np.uint64(PLACE_BITS) | np.uint64(k) for k, row in enumerate(held)]
    here = np.isin(found.stem << np.uint64(PLACE_BITS) | found.text.astype(np.uint64), np.concatenate(wanted))
    text, place, first, last = (x[here] for x in (found.text, found.place, found.first, found.last))
    front, suffix = found.joined(first, place), found.joined(place, last + WINDOW)
    same = pc.binary_join_element_wise(front, suffix, "\n").dictionary_encode().indices.to_numpy()
    least = np.full(int(same.max()) + 1 if len(same) else 0, NO_ID)
    np.minimum.at(least, same, doc[text])
    owned = doc[text] == least[same]
    begin = first - found.begin[text]
    # Windows of the others start at each word from the first one of the stretch to the last one.
    widths = np.where(owned, 0, last - first + 1)
    starts = np.arange(int(widths.sum())) - np.repeat(np.cumsum(widths) - widths - begin, widths)
    of = np.repeat(text, widths)
    marks = _marks(k1[of], k2[of], starts)
    yield _batch(dict(zip(("k1", "k2", "starts"), marks, strict=True)))
    # Of the rest, one row for each text and suffix, with all places where it begins.
    text, begin, kind, row = text[owned], begin[owned], same[owned], np.flatnonzero(owned)
    order = np.lexsort((begin, kind, text))
    text, begin, kind, row = text[order], begin[order], kind[order], row[order]
    ends = np.flatnonzero(np.append((text[1:] != text[:-1]) | (kind[1:] != kind[:-1]), True)) + 1 if len(text) else np.zeros(0, int)
    mine, text = pa.array(row[ends - 1]), text[ends - 1]
    keys = {"k1": pa.array(k1[text]), "k2": pa.array(k2[text]), "doc": pa.array(doc[text])}
    yield _batch({**keys, "begins": _packed(begin.astype("<i4"), ends), "front": front.take(mine), "suffix": suffix.take(mine)})


def _starts(begins: list[bytes], windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words of a window, by its number in a row, at all places where the row's suffix begins; and the row of each."""
    places = [np.frombuffer(b, "<i4") for b in begins]
    sizes = np.array([len(x) for x in places], np.int64)
    return np.concatenate([*places, np.zeros(0, "<i4")]) + np.repeat(windows, sizes), np.repeat(np.arange(len(begins)), sizes)


def repeated_windows(front: pa.Array, suffix: pa.Array, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, number of a window in the row): windows of a group that a smaller document has as well.

    Row i has the words ``front[i]`` before its suffix ``suffix[i]``; its windows are all stretches of ``WINDOW`` words of both that begin
    in the front or at the suffix and end in the suffix.
    """
    front_words, in_front = support.words_of(front)
    suffix_words, in_suffix = support.words_of(suffix)
    numbers = pa.concat_arrays([front_words, suffix_words]).dictionary_encode().indices.to_numpy().astype(np.int64)
    n = len(doc)
    ahead, behind = np.full((n, WINDOW), -1, np.int64), np.full((n, WINDOW - STEM + 1), -1, np.int64)
    row = np.repeat(np.arange(n), in_suffix)
    ahead[row, np.arange(len(row)) - np.repeat(np.cumsum(in_suffix) - in_suffix, in_suffix)] = numbers[len(front_words) :]
    row = np.repeat(np.arange(n), in_front)
    behind[row, np.repeat(np.cumsum(in_front), in_front) - 1 - np.arange(len(row))] = numbers[: len(front_words)]
    # The tree: sorted suffixes, and how many words each shares with the one before it.
    order = np.lexsort(ahead.T[::-1])
    ahead, behind, doc, in_front, in_suffix = ahead[order], behind[order], doc[order], in_front[order], in_suffix[order]
    common = np.append(0, (np.cumprod(ahead[1:] == ahead[:-1], axis=1)).sum(axis=1))
    rows, windows = [], []
    before = np.zeros(n, np.int64)
    size = int(numbers.max(initial=0)) + 2
    for back in range(WINDOW - STEM + 1):
        if back:
            before = pd.factorize(before * size + behind[:, back - 1] + 1)[0]
        depth = WINDOW - back
        node = np.cumsum(common < depth)
        inside = np.flatnonzero((in_front >= back) & (in_suffix >= depth))
        if not len(inside):
            continue
        code, names = pd.factorize(node[inside] * (int(before.max()) + 1) + before[inside])
        least = np.full(len(names), NO_ID)
        np.minimum.at(least, code, doc[inside])
        repeated = inside[doc[inside] > least[code]]
        rows.append(order[repeated])
        windows.append(in_front[repeated] - back)
    return np.concatenate(rows) if rows else np.zeros(0, np.int64), np.concatenate(windows) if windows else np.zeros(0, np.int64)


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks of the windows that groups share. Rows come ordered by ``prefix``; whole groups are worked on together."""
    held: list[pa.RecordBatch] = []

    def grown() -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        k1, k2, doc = (table.column(k).to_numpy() for k in ("k1", "k2", "doc"))
        texts = [table.column(k).combine_chunks() for k in ("front", "suffix")]
        rows, windows = repeated_windows(*(t.chunk(0) if isinstance(t, pa.ChunkedArray) else t for t in texts), doc)
        if len(rows):
            starts, of = _starts(table.column("begins").take(pa.array(rows)).to_pylist(), windows)
            yield pa.RecordBatch.from_arrays([*_marks(k1[rows][of], k2[rows][of], starts)], ["k1", "k2", "starts"])

    for batch in batches:
        while batch.num_rows:
            prefixes = batch.column("prefix").to_numpy()
            if sum(b.num_rows for b in held) + batch.num_rows < TREE_ROWS:
                held.append(batch)
                break
            # Up to the last row of the group that fills the tree.
            want = max(TREE_ROWS - sum(b.num_rows for b in held), 1)
            value = held[-1].column("prefix")[-1].as_py() if want == 1 and held else prefixes[min(want, len(prefixes)) - 1]
            ends = np.flatnonzero(prefixes != value)
            ends = ends[ends >= want] if want > 1 else ends
            if not len(ends):
                held.append(batch)
                break
            if ends[0]:
                held.append(batch.slice(0, int(ends[0])))
            yield from grown()
            held.clear()
            batch = batch.slice(int(ends[0]))
    if held:
        yield from grown()


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each window of crowded suffixes as a row of its own, with all its places in the text. Of equal windows in a batch only those of
    the smallest document go on; the others are marked (``window`` is null)."""
    for batch in batches:
        for part in support.slices(batch, "suffix", PIECE_BYTES):
            whole = pc.binary_join_element_wise(part.column("front"), part.column("suffix"), " ")
            words, sizes = support.words_of(whole)
            begin = np.cumsum(sizes) - sizes
            counts = np.maximum(sizes - WINDOW + 1, 0)
            row = np.repeat(np.arange(len(sizes)), counts)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            which = ((begin[row] + nth)[:, None] + np.arange(WINDOW)).ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1) * WINDOW, pa.int32()), words.take(pa.array(which)))
            window = pc.binary_join(lists, " ")
            k1, k2, doc = (part.column(k).to_numpy()[row] for k in ("k1", "k2", "doc"))
            code = window.dictionary_encode().indices.to_numpy()
            least = np.full(int(code.max()) + 1 if len(code) else 0, NO_ID)
            np.minimum.at(least, code, doc)
            starts, of = _starts(part.column("begins").take(pa.array(row)).to_pylist(), nth)
            order = np.lexsort((starts, k2[of], k1[of], code[of]))
            starts, of = starts[order].astype("<i4"), of[order]
            new = (code[of][1:] != code[of][:-1]) | (k1[of][1:] != k1[of][:-1]) | (k2[of][1:] != k2[of][:-1])
            ends = np.flatnonzero(np.append(new, True)) + 1 if len(of) else np.zeros(0, int)
            first = of[ends - 1]
            owned = pa.array(doc[first] == least[code[first]])
            named = pc.if_else(owned, window.take(pa.array(first)), pa.scalar(None, pa.string()))
            yield pa.RecordBatch.from_arrays([*(pa.array(x[first]) for x in (k1, k2, doc)), _packed(starts, ends), named], ["k1", "k2", "doc", "starts", "window"])


def _grouped(suffixes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Suffixes with the hash of their ``prefix``, the shortest that is not crowded; and those without such a prefix."""
    columns = ["k1", "k2", "doc", "begins", "front", "suffix"]
    rows, prefix, none = suffixes.select(*columns), F.lit(None).cast("long"), None
    left = F.lit(True)
    for n in PREFIXES:
        rows = rows.withColumn(f"p{n}", F.xxhash64(F.lit(n), F.substring_index("suffix", " ", n)))
        counts = rows.where(left).groupBy(f"p{n}").count().where(F.col("count") > CROWD)
        crowded = support.staged(counts.select(f"p{n}", F.lit(True).alias(f"c{n}")), "prefixes", frugal=True)
        if crowded.isEmpty():
            prefix = F.when(left, F.col(f"p{n}")).otherwise(prefix)
            break
        rows = support.with_lookup(rows, crowded, [f"p{n}"])
        prefix = F.when(left & F.col(f"c{n}").isNull(), F.col(f"p{n}")).otherwise(prefix)
        left = left & F.col(f"c{n}").isNotNull()
    else:
        none = rows.where(left).select(*columns)
    return rows.withColumn("prefix", prefix).where("prefix IS NOT NULL").select("prefix", *columns), none


def _marks_of_groups(suffixes: DataFrame) -> DataFrame:
    grouped, crowded = _grouped(suffixes)
    marks = grouped.repartition("prefix").sortWithinPartitions("prefix").mapInArrow(_trees, MARK)
    if crowded is None:
        return marks
    windows = support.staged(crowded.mapInArrow(_windows, "k1 long, k2 long, doc long, starts binary, window string"), "windows", frugal=True)
    named = windows.where("window IS NOT NULL")
    owners = named.groupBy("window").agg(F.min("doc").alias("owner"))
    found = named.join(owners.hint("merge"), "window").where("doc > owner").select("k1", "k2", "starts")
    return marks.union(found).union(windows.where("window IS NULL").select("k1", "k2", "starts"))


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of the texts. Rows come ordered by both keys, the marks of a text before it."""
    unpack = zstandard.ZstdDecompressor().decompress
    now, starts = None, []
    out: list[tuple] = []
    size = 0
    kinds = (*[pa.int64()] * 4, pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64())])), pa.binary())

    def batch_of() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["k1", "k2", "owner", "n_words", "repeats", "kept"])

    for batch in batches:
        for k1, k2, doc, packed, marks in zip(*(batch.column(k).to_pylist() for k in ("k1", "k2", "doc", "packed", "starts")), strict=True):
            if (k1, k2) != now:
                now, starts = (k1, k2), []
            if packed is None:
                starts.append(np.frombuffer(marks, "<i4"))
                continue
            words = unpack(packed).split() if len(packed) else []
            repeats = []
            if starts:
                changes = np.zeros(len(words) + 2, np.int64)
                found = np.unique(np.concatenate(starts)).astype(np.int64) + 1
                np.add.at(changes, found, 1)
                np.add.at(changes, np.minimum(found + WINDOW, len(changes) - 1), -1)
                covered = np.cumsum(changes)[:-1] > 0
                edges = np.flatnonzero(np.diff(np.append(covered, False).astype(np.int8))).reshape(-1, 2)
                repeats = [{"first": int(a), "words": int(b - a)} for a, b in edges]
                kept, end = [], 0
                for a, b in edges.tolist():
                    kept += words[end:a]
                    end = b
                kept += words[end:]
            else:
                kept = words
            out.append((k1, k2, doc, len(words), repeats, b" ".join(kept)))
            size += len(out[-1][-1])
            if size >= PIECE_BYTES:
                yield batch_of()
                out, size = [], 0
    if out:
        yield batch_of()


def _keyed(docs: DataFrame) -> DataFrame:
    plain = docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return plain.select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), *text_keys(F.col("text")), "text")


REPEATS = "array<struct<first: long, words: long>>"


def judged_texts(docs: DataFrame) -> DataFrame:
    """(``k1``, ``k2``, ``owner``, ``n_words``, ``repeats``, ``kept``) for each different text: its smallest document, and what
    other documents leave of it there. ``kept`` holds UTF-8 bytes."""
    source = _keyed(docs).select("doc", "k1", "k2", "text")
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(tasks, -(-size // BUCKET_BYTES))
    groups = max(4 * tasks, buckets)
    stems = source.mapInArrow(_stems(buckets), "bucket long, known boolean, stems binary, texts binary")
    several = stems.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_shared(groups), "part long, stems binary, texts binary")
    texts = source.mapInArrow(_texts, "k1 long, k2 long, doc long, packed binary").withColumn("part", F.pmod("k1", F.lit(groups)))
    both = several.unionByName(texts, allowMissingColumns=True).select(*LEAF_INPUT)
    ordered = both.repartition("part").sortWithinPartitions("part", "k1", "k2", "doc")
    leaves = support.staged(ordered.mapInArrow(_leaves, LEAVES), "leaves", frugal=True)
    marks = support.staged(_marks_of_groups(leaves.where("suffix IS NOT NULL")), "marks", frugal=True)
    marks = marks.union(leaves.where("starts IS NOT NULL").select("k1", "k2", "starts"))
    kept = leaves.where("packed IS NOT NULL").select("k1", "k2", "doc", "packed", "open")
    schema = f"k1 long, k2 long, owner long, n_words long, repeats {REPEATS}, kept binary"
    opened = kept.where("open").drop("open").unionByName(marks, allowMissingColumns=True)
    opened = opened.select("k1", "k2", "doc", "packed", "starts").repartition("k1", "k2").sortWithinPartitions("k1", "k2", "doc")
    closed = kept.where("NOT open").drop("open").withColumn("starts", F.lit(None).cast("binary"))
    return opened.mapInArrow(_judged, schema).unionByName(closed.mapInArrow(_judged, schema))


def remove_repeats(docs: DataFrame, kept: Callable[[Column], Column] = lambda text: text.cast("string")) -> DataFrame:
    """(``doc_id``, ``n_words``, ``repeats``, ``kept``) for each document: stretches of words that lie in windows of ``WINDOW`` words which
    start in a document with a smaller id as well, as (first word, number of words), and the words left, joined by blanks.

    Words lie between ASCII white space. ``kept`` is a function of the bytes left, taken before documents are joined to their
    texts, so that a digest moves no texts. Windows are judged on the input. Texts are compared whole; only the choice
    of suffixes and the key of a text are by hash (48 bits a stem, which can only add suffixes, and 128 bits a text).

    A null or empty text, and one of fewer than ``WINDOW`` words, loses nothing. A document without an id (or whose id is no whole
    number) comes after all others: it loses what any document with an id has, and nothing to another one without.
    Documents with equal ids take nothing from each other; repeated rows are judged one by one.
    """
    texts = judged_texts(docs).withColumn("none", kept(F.lit("").cast("binary"))).withColumn("kept", kept(F.col("kept")))
    texts = support.staged(texts, "texts", frugal=True)
    rows = _keyed(docs).select("doc_id", "doc", "k1", "k2")
    copy = (F.col("doc") > F.col("owner")) & (F.col("n_words") >= WINDOW)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("first"), F.col("n_words").alias("words")))
    return rows.join(texts.hint("merge"), ["k1", "k2"]).select(
        "doc_id", "n_words", F.when(copy, whole).otherwise(F.col("repeats")).alias("repeats"), F.when(copy, F.col("none")).otherwise(F.col("kept")).alias("kept")
    )


def digests(docs: DataFrame) -> DataFrame:
    """One row a document: its words, how many are removed, and a hash of the rest."""
    found = remove_repeats(docs, kept=lambda text: F.sha2(text, 256))
    removed = F.aggregate("repeats", F.lit(0).cast("long"), lambda total, each: total + each["words"])
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.col("kept").alias("kept_sha256"))
