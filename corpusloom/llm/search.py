"""Exact top-k search by BM25 over an inverted index with block maxima.

The index is a table of segments, built where the documents are read: postings by term, ordered by document. Documents are
counted off in blocks; the postings of a term in a block lie together, and the largest of their impacts bounds what the
term can add to any document of the block; the largest of these bounds it anywhere in the segment.

A segment is searched as block-max WAND does it, a group of blocks at a time instead of a document, and by many queries at once. A query whose
term maxima in the segment do not add up to its k-th best score so far skips the segment. Terms that few documents hold are added up by
document; the block maxima of the common ones, and the largest such sum in the block, bound what its documents can score. Blocks are
passed in document order; the pivots of a query are those whose bound reaches its k-th best score, and a group of blocks is scored for
the queries that have a pivot in it: common terms are a matrix, documents by terms, so a group is one product of matrices. The score to
beat is carried on from group to group and from segment to segment.

Segments are dealt to shards and queries to blocks of queries. Blocks take their turns: all tasks hold the same block, which the driver has
sent them, and each opens the segments of its shard one after the other, where they were written. Neither segments nor queries are
shuffled, however many blocks there are. The best of all shards are merged. Document frequencies, the number of documents and
their mean length are those of the whole table.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm import support

K1, B = 1.2, 0.75
#: Documents and postings of a segment at most (one long document may exceed the second), documents of a block and of a shard, and about
#: how many queries, and terms of them, a task holds.
SEGMENT_DOCS, SEGMENT_POSTINGS, BLOCK, SHARD_DOCS, QUERIES, QUERY_TERMS = 8192, 1_000_000, 32, 32768, 4096, 1_250_000
#: Blocks that are passed together: few at first, then more. Terms in one of so many documents of a segment, or more, are common. Postings of
#: other terms that a batch of queries adds up at most (one query may exceed it), and queries of a batch.
FEWEST, MOST, COMMON, BATCH_POSTINGS, BATCH = 4, 64, 12, 500_000, 256
#: Scores count as equal if they agree to so many decimals; then the smaller doc_id comes first.
DECIMALS = 6
NO_ID = np.iinfo(np.int64).max
#: Bytes of terms that are Python objects at one time, and rows of an Arrow batch of terms.
PIECE, TERM_ROWS = 1 << 16, 100_000

SEGMENT = "n_docs long, n_words long, ids array<long>, lengths binary, terms string, starts binary, docs binary, counts binary"


def _words(text: bytes) -> list[bytes]:
    return text.lower().split()


def _narrow(counts: np.ndarray) -> np.ndarray:
    """The smallest unsigned type that holds all counts; readers tell it by the number of bytes."""
    most = counts.max(initial=0)
    return counts.astype("<u1" if most < 256 else "<u2" if most < 65536 else "<u4")


def build_index(docs: DataFrame, segment_docs: int = SEGMENT_DOCS) -> DataFrame:
    """Segments of all rows, of at most ``segment_docs`` (up to 65,536) each, in the shared folder. Null and empty texts are documents without words."""
    names = [part.split()[0] for part in SEGMENT.split(", ")]

    def segment(parts: list[tuple], ids: list[int | None]) -> pa.RecordBatch:
        """``parts``: terms, words of each document, terms of each document, and of each of those its number in the terms and its count."""
        listed = pa.chunked_array([part[0] for part in parts], pa.string()).dictionary_encode().combine_chunks()
        listed = listed.chunk(0) if isinstance(listed, pa.ChunkedArray) else listed
        number, places = listed.indices.to_numpy(zero_copy_only=False), np.cumsum([0, *(len(part[0]) for part in parts)])
        term = np.concatenate([number[first + part[3]] for first, part in zip(places.tolist(), parts, strict=False)])
        lengths, sizes, count = (np.concatenate([part[i] for part in parts]) for i in (1, 2, 4))
        order = np.argsort(term, kind="stable")
        starts = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(listed.dictionary)))])
        doc = np.repeat(np.arange(len(sizes), dtype="<u2"), sizes)[order]
        terms = pc.binary_join(pa.ListArray.from_arrays([0, len(listed.dictionary)], listed.dictionary), " ")
        values = [len(ids), int(lengths.sum()), ids, lengths.astype("<i4").tobytes(), terms[0].as_py(), starts.astype("<i4").tobytes(), doc.tobytes(), _narrow(count[order]).tobytes()]
        types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.string(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names)

    def counted(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Terms, words and terms of each text, and of each of those its number and its count."""
        words, lengths = support.words_of(pc.ascii_lower(texts))
        coded = words.dictionary_encode()
        width = max(len(coded.dictionary), 1)
        key, count = np.unique(np.repeat(np.arange(len(lengths)), lengths) * width + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
        doc, term = np.divmod(key, width)
        return coded.dictionary, lengths, np.bincount(doc, minlength=len(lengths)), term, count

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        ids: list[int | None] = []
        held = 0
        for batch in (part for batch in batches for part in support.slices(batch, "text", support.BATCH_BYTES)):
            terms, lengths, sizes, term, count = counted(batch.column("text"))
            numbers, ends = batch.column("doc_id").to_pylist(), np.concatenate([[0], np.cumsum(sizes)])
            first = 0
            while first < len(numbers):
                # As many documents as the segment still takes; the one that fills it belongs to it.
                full = int(np.searchsorted(ends, ends[first] + SEGMENT_POSTINGS - held, "left"))
                last = min(len(numbers), first + segment_docs - len(ids), max(full, first + 1))
                inside = slice(ends[first], ends[last])
                used, own = np.unique(term[inside], return_inverse=True)
                parts.append((terms.take(pa.array(used)), lengths[first:last], sizes[first:last], own, count[inside]))
                ids += numbers[first:last]
                held += int(ends[last] - ends[first])
                first = last
                if len(ids) == segment_docs or held >= SEGMENT_POSTINGS:
                    yield segment(parts, ids)
                    parts, ids, held = [], [], 0
        if ids:
            yield segment(parts, ids)

    rows = support.whole_texts(docs).mapInArrow(segments, SEGMENT)
    return support.staged(rows.withColumn("segment", F.monotonically_increasing_id()), "segments", frugal=True)


def _frequencies(index: DataFrame) -> DataFrame:
    """(``term``, ``df``): in how many documents of the table each term is."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                terms = pc.split_pattern(batch.column("terms").slice(i, 1), " ").flatten()
                df = pa.array(np.diff(np.frombuffer(batch.column("starts")[i].as_py(), "<i4")).astype(np.int64))
                for first in range(0, len(df), TERM_ROWS):
                    yield pa.RecordBatch.from_arrays([column.slice(first, TERM_ROWS) for column in (terms, df)], ["term", "df"])

    return index.select("terms", "starts").mapInArrow(listed, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))


def _query_rows(queries: DataFrame, frequencies: DataFrame, n_docs: int) -> DataFrame:
    """One row a query: ``query_id``, its ``terms`` that occur in the table, and their weights."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Counter(_words(text)) for text in support.bytes_of(batch.column("text"))]
            of = np.repeat(np.arange(len(found)), [len(c) for c in found])
            terms = [word.decode() for c in found for word in c]
            times = [n for c in found for n in c.values()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(of, pa.int64())), pa.array(terms, pa.string()), pa.array(times, pa.int64())], ["query_id", "term", "times"])

    rows = support.whole_texts(queries).mapInArrow(words, "query_id long, term string, times long")
    idf = F.log1p((F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = rows.groupBy("query_id", "term").agg(F.sum("times").alias("times")).join(frequencies, "term")
    listed = F.sort_array(F.collect_list(F.struct("term", (F.col("times") * idf).alias("weight"))))
    whole = weighed.groupBy("query_id").agg(listed.alias("found"))
    return whole.select("query_id", F.array_join(F.transform("found", lambda x: x["term"]), " ").alias("terms"), F.transform("found", lambda x: x["weight"]).alias("weights"))


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _hashes(terms: str) -> np.ndarray:
    """Two hashes of each of the terms, which blanks part, a row each: together they tell terms apart."""
    raw = terms.encode()
    found = np.empty((2, raw.count(b" ") + 1), np.uint64)
    first = at = 0
    while first <= len(raw):
        last = raw.find(b" ", first + PIECE)
        last = len(raw) if last < 0 else last
        piece = raw[first:last].split(b" ")
        for seed in (0, 1):
            found[seed, at : at + len(piece)] = np.fromiter((xxhash.xxh64_intdigest(t, seed) for t in piece), np.uint64, len(piece))
        first, at = last + 1, at + len(piece)
    return found


class Query:
    """Terms by their hashes, weights, and the best ``k`` scores and ids so far."""

    def __init__(self, number: int, terms: str, weights: list[float]) -> None:
        hashes = _hashes(terms)
        order = np.argsort(hashes[0], kind="stable")  # looked up faster than in any order
        self.number, self.hashes, self.weights = number, hashes[:, order], np.asarray(weights)[order]
        self.scores, self.ids = np.empty(0), np.empty(0, np.int64)

    def floor(self, k: int) -> float:
        return self.scores[k - 1] - 10.0**-DECIMALS if len(self.scores) == k else 0.0


class Segment:
    """A segment opened for search: postings with their impacts, the largest impact of each term in the segment (rounded up), and, of
    common terms, the impacts by document and the largest in each block (rounded up)."""

    def __init__(self, row: dict, mean: float, block: int = BLOCK) -> None:
        self.ids = np.array([NO_ID if i is None else i for i in row["ids"]], np.int64)
        hashes = _hashes(row["terms"])
        self.order = np.argsort(hashes[0], kind="stable")
        self.hashes = hashes[:, self.order]
        starts = np.frombuffer(row["starts"], "<i4")
        self.docs = np.frombuffer(row["docs"], "<u2")
        counts = np.frombuffer(row["counts"], f"<u{len(row['counts']) // max(len(self.docs), 1) or 1}").astype(np.float64)
        norm = (K1 * (1 - B + B * np.frombuffer(row["lengths"], "<i4") / mean))[self.docs]
        norm += counts
        counts *= K1 + 1
        counts /= norm
        self.impacts = counts
        del norm
        self.starts, self.block, self.blocks = starts, block, -(-len(self.ids) // block)
        sizes = np.diff(starts)
        held = sizes > 0
        self.term_most = np.zeros(len(sizes), np.float32)
        if held.any():
            self.term_most[held] = np.nextafter(np.maximum.reduceat(self.impacts, starts[:-1][held]).astype(np.float32), np.float32(np.inf))
        # Common terms: a row each, impacts by document and their largest by block; the others are -1 here.
        common = np.flatnonzero(sizes * COMMON >= len(self.ids))
        self.row_of = np.full(len(sizes), -1)
        self.row_of[common] = np.arange(len(common))
        places = _ranges(starts[common], sizes[common])
        self.matrix = np.zeros((len(common), self.blocks * block))
        self.matrix[np.repeat(np.arange(len(common)), sizes[common]), self.docs[places]] = self.impacts[places]
        most = self.matrix.reshape(len(common), self.blocks, block).max(axis=2, initial=0.0)
        self.most = np.nextafter(most, np.inf)

    def cursors(self, query: Query) -> tuple[np.ndarray, np.ndarray]:
        """Numbers in this segment of the query's terms, and their weights."""
        at = np.minimum(np.searchsorted(self.hashes[0], query.hashes[0]), len(self.order) - 1)
        same = (self.hashes[0][at] == query.hashes[0]) & (self.hashes[1][at] == query.hashes[1])
        return self.order[at[same]], query.weights[same]

    def search(self, query: Query, k: int) -> int:
        """Merge the best documents of this segment into those of ``query``; returns how many blocks were opened."""
        return self.search_all([query], k)

    def search_all(self, queries: list[Query], k: int) -> int:
        """As ``search``, for many queries, in batches whose postings are bounded."""
        opened, batch, held = 0, [], 0
        for query in queries:
            number, weight = self.cursors(query)
            if not len(number) or weight @ self.term_most[number] < query.floor(k):
                continue
            rare = self.row_of[number] < 0
            size = int((self.starts[number[rare] + 1] - self.starts[number[rare]]).sum())
            if batch and (held + size > BATCH_POSTINGS or len(batch) == BATCH):
                opened += self._search_batch(batch, k)
                batch, held = [], 0
            batch.append((query, number, weight, rare))
            held += size
        return opened + (self._search_batch(batch, k) if batch else 0)

    def _search_batch(self, batch: list[tuple[Query, np.ndarray, np.ndarray, np.ndarray]], k: int) -> int:
        queries = [query for query, *_ in batch]
        of = np.repeat(np.arange(len(batch)), [len(number) for _, number, *_ in batch])
        number, weight, rare = (np.concatenate([row[i] for row in batch]) for i in (1, 2, 3))
        weights = np.zeros((len(batch), len(self.matrix)))
        weights[of[~rare], self.row_of[number[~rare]]] = weight[~rare]
        width = self.blocks * self.block
        begin = self.starts[number[rare]]
        sizes = self.starts[number[rare] + 1] - begin
        postings = _ranges(begin, sizes)
        place = np.repeat(of[rare] * width, sizes) + self.docs[postings]
        sums = np.bincount(place, np.repeat(weight[rare], sizes) * self.impacts[postings], len(batch) * width).reshape(len(batch), width)
        bound = weights @ self.most + sums.reshape(len(batch), self.blocks, self.block).max(axis=2)
        floors = np.array([query.floor(k) for query in queries])
        cursor, step, opened = 0, FEWEST, 0
        while cursor < self.blocks:
            end = min(cursor + step, self.blocks)
            pivots = (bound[:, cursor:end] >= floors[:, None]) & (bound[:, cursor:end] > 0)
            asked = np.flatnonzero(pivots.any(axis=1))
            if len(asked):
                opened += int(pivots.sum())
                docs = slice(cursor * self.block, end * self.block)
                scores = weights[asked] @ self.matrix[:, docs] + sums[asked, docs]
                row, doc = np.nonzero((scores > 0) & (scores >= floors[asked, None]))
                cuts = np.append(np.flatnonzero(np.diff(row, prepend=-1)), len(row)).tolist()
                for first, last in zip(cuts, cuts[1:], strict=False):
                    at, found = row[first], doc[first:last]
                    query = queries[asked[at]]
                    query.scores, query.ids = top(np.concatenate([query.scores, scores[at, found]]), np.concatenate([query.ids, self.ids[docs][found]]), k)
                    floors[asked[at]] = query.floor(k)
            cursor, step = end, min(2 * step, MOST)
        return opened


def top(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -np.round(scores, DECIMALS)))[:k]
    return scores[order], ids[order]


def _searched(k: int, mean: float, asked: Broadcast[bytes]):
    def results(queries: list[Query]) -> pa.RecordBatch:
        sizes = [len(q.ids) for q in queries]
        number = np.repeat(np.array([q.number for q in queries], np.int64), sizes)
        ids = np.concatenate([*(q.ids for q in queries), np.empty(0, np.int64)])
        scores = np.concatenate([*(q.scores for q in queries), np.empty(0)])
        return pa.RecordBatch.from_arrays([pa.array(number), pa.array(ids, mask=ids == NO_ID), pa.array(scores)], ["query_id", "doc_id", "score"])

    def held() -> Iterator[Query]:
        for part in pa.ipc.open_stream(asked.value):
            for number, terms, weights in zip(*part.columns, strict=True):
                yield Query(number.as_py(), terms.as_py(), weights.values.to_numpy())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows are the segments of a shard, of which one is open at a time; the queries are held."""
        queries: list[Query] = []
        for batch in batches:
            for i in range(batch.num_rows):
                if batch.column("terms")[i].as_py():
                    queries = queries or list(held())
                    Segment(batch.slice(i, 1).to_pylist()[0], mean).search_all(queries, k)
        yield results(queries)

    return run


def _sent(queries: DataFrame) -> Broadcast[bytes]:
    """Rows of ``queries`` as an Arrow stream that every task can read."""
    rows, sink = queries.toArrow(), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as stream:
        stream.write_table(rows, max_chunksize=1024)
    return queries.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes())


def top_k(docs: DataFrame, queries: DataFrame, k: int = 10, segment_docs: int = SEGMENT_DOCS, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """``query_id``, ``rank``, ``doc_id``, ``score``: the ``k`` best documents of ``docs`` for each row of ``queries`` (``doc_id``, ``text``).

    A query is its whole text, each word as often as it occurs; A-Z is lower-cased and words lie between ASCII white space.
    Only documents that share a word with the query count. Queries of one id are one query; a query without id or words
    has no result. Rows of ``docs`` with equal ids are documents of their own. An empty table gives no rows.
    """
    index = build_index(docs, segment_docs)
    counted = index.agg(F.sum("n_docs"), F.sum("n_words")).first()
    n_docs, mean = counted[0] or 0, max((counted[1] or 0) / max(counted[0] or 0, 1), 1e-9)
    asked = support.staged(_query_rows(queries.where("doc_id is not null"), _frequencies(index), n_docs), "queries", frugal=True)
    n_queries, n_terms = asked.agg(F.count(F.lit(1)), F.sum(F.size("weights"))).first()
    shards, blocks = max(1, math.ceil(n_docs / shard_docs)), max(1, math.ceil(n_queries / QUERIES), math.ceil((n_terms or 0) / QUERY_TERMS))
    parts = []
    for block in range(blocks):
        sent = _sent(asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).select("query_id", "terms", "weights"))
        segments = index.select("ids", "lengths", "terms", "starts", "docs", "counts").coalesce(shards)
        found = segments.mapInArrow(_searched(k, mean, sent), "query_id long, doc_id long, score double")
        parts.append(support.staged(found, "found", frugal=True))
        sent.destroy()
    return ranked(reduce(DataFrame.union, parts), k)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of the shards' results; each shard has sent ``k`` a query at most."""
    score: Column = F.round("score", DECIMALS)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("score", score).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")
