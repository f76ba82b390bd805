"""Quality classifier: a small convolutional network over the bytes of a text, in numpy.

A text is covered by chunks of ``CHUNK`` bytes that overlap by the width of a filter less one, so no window of bytes is
missed. In each chunk every filter keeps its largest response. The mean and the maximum of these over all chunks of the
document, however many, go through one dense layer into a probability. Filters are learned by gradient descent on a
bounded sample of labelled documents; scoring reads whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import support

WIDTH = 6
FILTERS = 16
CHUNK = 96
#: The fit sees at most so many labelled documents of each class, and at most so many chunks of each, spread evenly over
#: the whole document.
PER_CLASS = 1500
CHUNKS = 24
#: Steps of gradient descent, as many for any number of documents, and documents a step.
STEPS = 600
BATCH = 64
RATE = 0.02
DECAY = 1e-4
#: Bytes scored at once; a longer text is read in strides of whole chunks.
STRIDE = CHUNK * 4096


@dataclass(frozen=True)
class ByteNet:
    """``tables``: for each place in a filter's window, its weights by byte; ``dense``: for means, then maxima."""

    tables: np.ndarray  # (WIDTH, 256, FILTERS)
    bias: np.ndarray  # (FILTERS,)
    dense: np.ndarray  # (2 * FILTERS,)
    offset: float


def windows(data: np.ndarray) -> np.ndarray:
    """Bytes of a stretch of text as a row a chunk, each with the first bytes of the next one; blanks fill up the last."""
    n = max(1, -(-len(data) // CHUNK))
    padded = np.full(n * CHUNK + WIDTH - 1, ord(" "), np.uint8)
    padded[: len(data)] = data[: len(padded)]
    return np.lib.stride_tricks.as_strided(padded, (n, CHUNK + WIDTH - 1), (CHUNK, 1))


def responses(net: ByteNet, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest response of each filter in each chunk, cut off at 0, and where it is."""
    total = net.tables[0][chunks[:, :CHUNK]]
    for place in range(1, WIDTH):
        total += net.tables[place][chunks[:, place : place + CHUNK]]
    at = total.argmax(axis=1)
    top = np.take_along_axis(total, at[:, None, :], axis=1)[:, 0, :] + net.bias
    return np.maximum(top, 0), at


def _tops(net: ByteNet, chunks: np.ndarray) -> np.ndarray:
    """As ``responses``, without the places, for scoring: neighbouring bytes are looked up as pairs."""
    out = np.empty((len(chunks), FILTERS), np.float32)
    pairs = pair_tables(net)
    for first in range(0, len(chunks), 256):
        block = chunks[first : first + 256].astype(np.int32)
        double = block[:, :-1] * 256 + block[:, 1:]
        total = pairs[0][double[:, :CHUNK]]
        for i in range(1, WIDTH // 2):
            total += pairs[i][double[:, 2 * i : 2 * i + CHUNK]]
        out[first : first + 256] = total.max(axis=1)
    return np.maximum(out + net.bias, 0)


_pairs: dict[int, tuple[ByteNet, np.ndarray]] = {}


def pair_tables(net: ByteNet) -> np.ndarray:
    """Weights by pair of bytes, for each pair of places; made once a worker."""
    if id(net) not in _pairs:
        _pairs.clear()
        made = [(net.tables[i][:, None, :] + net.tables[i + 1][None, :, :]).reshape(65536, FILTERS) for i in range(0, WIDTH, 2)]
        _pairs[id(net)] = (net, np.stack(made).astype(np.float32))
    return _pairs[id(net)][1]


def probability(net: ByteNet, text: bytes) -> float:
    """Probability of label 1 for a whole text; an empty one is a chunk of blanks."""
    data = np.frombuffer(text, np.uint8)
    total, most, count = np.zeros(FILTERS), np.zeros(FILTERS, np.float32), 0
    for first in range(0, max(1, len(data)), STRIDE):
        last = first + STRIDE >= len(data)
        part = windows(data[first:] if last else data[first : first + STRIDE + WIDTH - 1])
        tops = _tops(net, part if last else part[: STRIDE // CHUNK])
        total += tops.sum(axis=0)
        most = np.maximum(most, tops.max(axis=0))
        count += len(tops)
    score = float(np.concatenate([total / count, most]) @ net.dense + net.offset)
    return 1 / (1 + np.exp(-np.clip(score, -40, 40)))


def fit(texts: list[bytes], labels: list[int], seed: int = 5) -> ByteNet:
    """Adam on the logistic loss, classes weighted equally. ``texts`` are whole chunks of documents, joined."""
    random = np.random.default_rng(seed)
    shapes = {"tables": (WIDTH, 256, FILTERS), "bias": (FILTERS,), "dense": (2 * FILTERS,), "offset": (1,)}
    value = {name: random.normal(0, {"tables": 0.25, "dense": 0.1}.get(name, 0.0), shape).astype(np.float32) for name, shape in shapes.items()}
    value["bias"] += 0.1
    moment = {name: np.zeros(shape, np.float32) for name, shape in shapes.items()}
    spread = {name: np.zeros(shape, np.float32) for name, shape in shapes.items()}
    target = np.array(labels, np.float32)
    share = np.where(target == 1, 0.5 / max(1, target.sum()), 0.5 / max(1, len(target) - target.sum()))
    weight = share / share.mean() if len(share) else share
    parts = [windows(np.frombuffer(text, np.uint8)) for text in texts]
    step = 0
    while step < STEPS:
        order = random.permutation(len(parts))
        for first in range(0, len(order), BATCH):
            step += 1
            chosen = order[first : first + BATCH]
            sizes = np.array([len(parts[i]) for i in chosen])
            chunks = np.concatenate([parts[i] for i in chosen])
            net = ByteNet(value["tables"], value["bias"], value["dense"], float(value["offset"][0]))
            tops, at = responses(net, chunks)
            starts = np.cumsum(sizes) - sizes
            mean = np.add.reduceat(tops, starts, axis=0) / sizes[:, None]
            most = np.maximum.reduceat(tops, starts, axis=0)
            pooled = np.concatenate([mean, most], axis=1)
            guess = 1 / (1 + np.exp(-np.clip(pooled @ net.dense + net.offset, -40, 40)))
            error = ((guess - target[chosen]) * weight[chosen] / len(chosen)).astype(np.float32)
            of = np.repeat(np.arange(len(sizes)), sizes)
            into = error[:, None] * net.dense[None, :]
            slope = (into[:, :FILTERS] / sizes[:, None])[of]
            slope += np.where(tops == most[of], into[of, FILTERS:], 0)
            slope[tops <= 0] = 0
            slopes = {"tables": np.zeros(shapes["tables"], np.float32), "bias": slope.sum(axis=0), "dense": pooled.T @ error, "offset": error.sum(keepdims=True)}
            for place in range(WIDTH):
                found = np.take_along_axis(chunks, at + place, axis=1)
                np.add.at(slopes["tables"][place], (found, np.arange(FILTERS)[None, :]), slope)
            rate = RATE * max(0.01, 1 - step / STEPS)
            for name in shapes:
                moment[name] = 0.9 * moment[name] + 0.1 * slopes[name]
                spread[name] = 0.999 * spread[name] + 0.001 * slopes[name] ** 2
                change = moment[name] / (1 - 0.9**step) / (np.sqrt(spread[name] / (1 - 0.999**step)) + 1e-8)
                value[name] -= rate * (change + DECAY * value[name])
    return ByteNet(value["tables"], value["bias"], value["dense"], float(value["offset"][0]))


def held_out(doc_id: Column) -> Column:
    """Rows that no fit may see: the crc32 of the id as text leaves 1 when divided by 3. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = CHUNKS) -> DataFrame:
    """The bounded sample: ``chunks`` (at most ``most`` chunks, spread over the document, joined) and ``label`` of at most ``PER_CLASS``
    documents a class, those whose ids hash lowest, among labelled rows that are not held out."""
    open_rows = labels.select(F.col("doc_id").try_cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    picked = None
    for value in (0, 1):
        some = open_rows.where(F.col("label") == value).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(PER_CLASS)
        picked = some if picked is None else picked.unionByName(some)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for text in support.bytes_of(batch.column("text")):
                n = max(1, -(-len(text) // CHUNK))
                chosen = np.unique(np.linspace(0, n - 1, min(n, most)).astype(int))
                parts.append(b"".join(text[i * CHUNK : (i + 1) * CHUNK].ljust(CHUNK) for i in chosen.tolist()))
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.binary()), batch.column("label"), batch.column("doc_id")], ["chunks", "label", "doc_id"])

    rows = support.whole_texts(docs).join(F.broadcast(picked), "doc_id")
    return rows.mapInArrow(cut, "chunks binary, label int, doc_id long")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = CHUNKS) -> ByteNet:
    """Fit on the bounded sample, at most ``2 * PER_CLASS`` rows of ``most * CHUNK`` bytes, the only place where less than a whole text is
    seen. More chunks a document bring more of long documents into the fit and cost the driver as much more time. Without
    labelled rows every score is 0.5."""
    rows = sorted({(row.doc_id, row.label, bytes(row.chunks)) for row in training_rows(docs, labels, label, most).collect()})
    if not rows:
        return ByteNet(np.zeros((WIDTH, 256, FILTERS), np.float32), np.zeros(FILTERS, np.float32), np.zeros(2 * FILTERS, np.float32), 0.0)
    return fit([chunks for _, _, chunks in rows], [int(value) for _, value, _ in rows])


def scores(docs: DataFrame, net: ByteNet) -> DataFrame:
    """All columns of ``docs`` and ``score``, from the whole text alone; null texts count as empty, equal texts score alike."""
    names, place = docs.columns, len(docs.columns)
    sent = docs.sparkSession.sparkContext.broadcast(net)  # a few hundred KB, whatever the data

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        text_name = f"c{names.index('text')}"
        for batch in (part for batch in batches for part in support.slices(batch, text_name, support.BATCH_BYTES)):
            found = [probability(model, text or b"") for text in support.bytes_of(batch.column(names.index("text")))]
            fields = [*batch.columns, pa.array(found, pa.float64())]
            yield pa.RecordBatch.from_arrays(fields, [f"c{i}" for i in range(place + 1)])

    plain = ", ".join(f"c{i} {kind}" for i, (_, kind) in enumerate(docs.dtypes))
    scored = docs.toDF(*[f"c{i}" for i in range(place)]).mapInArrow(score, f"{plain}, c{place} double")
    return scored.select(*[F.col(f"c{i}").alias(name) for i, name in enumerate(names)], F.col(f"c{place}").alias("score"))


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` (1 from 0.5 on) of every row."""
    scored = scores(docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), "text"), train(docs, labels, label))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
