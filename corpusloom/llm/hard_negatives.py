"""Hard negatives for embedding training, found by angular triangle filtering.

Each row stores its norm and its angles to a few reference directions. The angle between two vectors is at least the
difference and at most the sum of their angles to a direction, so these angles bound the cosine, and with the norms
the score, from both sides. Rows lie in blocks, ordered by the direction nearest to them and by their angle to it. For an
anchor whose wanted scores lie between two limits, only the stretch of a block whose bounds overlap them is scored,
in whole numbers; all else is left out by two binary searches, or as a whole by the other directions. Angles are stored in
single precision and the bounds are widened by ``SLACK`` radians, far more than rounding can take away.

Anchors, a stated set of rows, are dealt to groups; each pair of a block and a group is one task's work, of bounded size
whatever the number of rows, labels or equal vectors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm import support

#: Rows that are sampled, by a hash of their ids, to choose reference directions, and how many are chosen. They change
#: no result: any directions give safe bounds.
SAMPLE, DIRECTIONS = 2048, 16
#: Rows of a block and anchors of a group.
BLOCK, GROUP = 8192, 4096
SLACK = 1e-5
FOUND = 5
#: Scores are added up as doubles below this, which is exact, and as whole numbers up to ``LIMIT``.
EXACT, LIMIT = 2**53, 2**60


def whole_vectors(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """(``vec_id``, ``label``, ``ints``) of the rows that take part; ``ints`` holds floor(256 x) of each component.

    Left out are rows whose id, label or vector is null, whose id is no whole number, or that have a null or non-finite component.
    Of several rows with one id, the one with the smallest label and vector takes part.
    """
    values = F.transform(F.col(vector), lambda x: x.cast("double"))
    fine = F.forall("_values", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    plain = rows.select(F.col("vec_id").try_cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), values.alias("_values"))
    plain = plain.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("_values").isNotNull() & F.coalesce(fine, F.lit(False)))
    ints = F.transform("_values", lambda x: F.floor(x * 256).cast("long"))
    return plain.groupBy("vec_id").agg(F.min(F.struct("label", ints.alias("ints"))).alias("row")).select("vec_id", "row.label", "row.ints")


def _matrix(lists: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    """Rows of ``dims`` numbers; a shorter vector counts as filled up with zeros."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    out = np.zeros((len(lists), dims), np.int64)
    sizes = np.diff(lists.offsets.to_numpy())
    out[np.arange(dims) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _angles(vectors: np.ndarray, norms: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Angles between rows and directions of length one; a vector of zeros is given a right angle to all."""
    cosines = vectors @ directions.T / np.where(norms > 0, norms, 1)[:, None]
    return np.arccos(np.clip(cosines, -1, 1))


def directions_of(sample: np.ndarray, most: int = DIRECTIONS) -> np.ndarray:
    """Directions of rows that lie far apart: each next one has the smallest cosine to those before it."""
    norms = np.sqrt((sample.astype(float) ** 2).sum(axis=1))
    units = sample[norms > 0] / norms[norms > 0, None]
    if not len(units):
        return np.eye(1, sample.shape[1])
    chosen, near = [0], units @ units[0]
    while len(chosen) < min(most, len(units)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, units @ units[chosen[-1]])
    return units[chosen]


def indexed(vectors: DataFrame) -> DataFrame:
    """``vectors`` with ``norm``, ``angles`` to all directions, ``cell`` (the nearest one) and ``angle`` to it; staged."""
    vectors = support.staged(vectors, "vectors")
    dims, largest = vectors.agg(F.max(F.size("ints")), F.max(F.array_max(F.transform("ints", lambda x: F.abs(x.cast("double")))))).first()
    dims = max(dims or 0, 1)
    if dims * (largest or 0) ** 2 >= LIMIT:
        raise ValueError(f"components of up to {largest / 256:.3g} in {dims} dimensions give scores beyond 60 bits")
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
    chosen = directions_of(_matrix(sample.column("ints"), dims))

    def measured(batches):
        for batch in batches:
            rows = _matrix(batch.column("ints"), dims)
            norms = np.sqrt((rows.astype(float) ** 2).sum(axis=1))
            angles = _angles(rows, norms, chosen).astype("<f4")
            cell = angles.argmin(axis=1) if len(rows) else np.zeros(0, int)
            columns = [pa.array(norms), pa.array([a.tobytes() for a in angles], pa.binary()), pa.array(cell, pa.int32()), pa.array(angles[np.arange(len(rows)), cell], pa.float32())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "norm", "angles", "cell", "angle"])

    added = "norm double, angles binary, cell int, angle float"
    return support.staged(vectors.mapInArrow(measured, f"vec_id long, label string, ints array<long>, {added}"), "angles")


class _Rows:
    """Rows of a block or a group as arrays."""

    def __init__(self, table: pa.Table, dims: int) -> None:
        self.ids = table.column("vec_id").to_numpy()
        self.ints = _matrix(table.column("ints"), dims)
        self.norms = table.column("norm").to_numpy()
        self.angles = np.frombuffer(b"".join(table.column("angles").to_pylist()), "<f4").reshape(len(self.ids), -1).astype(float)
        self.cells = table.column("cell").to_numpy()
        self.labels = table.column("label").to_pandas()


def _dims(*tables: pa.Table) -> int:
    return max(1, *(int(np.diff(t.column("ints").combine_chunks().offsets.to_numpy()).max(initial=0)) for t in tables))


def _stretches(rows: _Rows, anchors: _Rows, low: np.ndarray, high: np.ndarray):
    """(anchor, first, last): stretches of ``rows``, in order, that may hold scores between the limits of each anchor."""
    ends = np.flatnonzero(np.append(np.diff(rows.cells) != 0, True)) + 1
    for first, last in zip([0, *ends[:-1]], ends, strict=True):
        cell, near = rows.cells[first], rows.angles[first:last]
        least, most = rows.norms[first:last].min(), rows.norms[first:last].max()
        with np.errstate(divide="ignore", invalid="ignore"):
            # A score of at least `low` needs a small angle, one of at most `high` a large one, whatever the norm of the row.
            floor = low / (anchors.norms * np.where(low > 0, most, least))
            roof = high / (anchors.norms * np.where(high > 0, least, most))
            reach = np.arccos(np.clip(np.where(np.isfinite(floor), floor, -1), -1, 1)) + SLACK
            away = np.arccos(np.clip(np.where(np.isfinite(roof), roof, 1), -1, 1)) - SLACK
        free = anchors.norms == 0
        gap = np.maximum(near.min(axis=0) - anchors.angles, anchors.angles - near.max(axis=0)).max(axis=1)
        wide = (anchors.angles + near.max(axis=0)).min(axis=1)
        home = anchors.angles[:, cell]
        start = np.searchsorted(near[:, cell], np.where(free, -1, np.maximum(home - reach, away - home)))
        stop = np.searchsorted(near[:, cell], np.where(free, 9, home + reach), "right")
        for k in np.flatnonzero((stop > start) & (free | (gap <= reach) & (wide >= away))):
            yield int(k), first + int(start[k]), first + int(stop[k])


def _scores(rows: _Rows, anchor: np.ndarray, first: int, last: int, exact: bool) -> np.ndarray:
    if exact:
        return (rows.ints_as_doubles[first:last] @ anchor.astype(float)).astype(np.int64)
    return rows.ints[first:last] @ anchor


def _best(scores: np.ndarray, ids: np.ndarray, most: int = FOUND) -> np.ndarray:
    """Places of the highest scores, ties by the smaller id."""
    if len(scores) > 4 * most:
        near = np.flatnonzero(scores >= np.partition(scores, -most)[-most])
        return near[np.lexsort((ids[near], -scores[near]))[:most]]
    return np.lexsort((ids, -scores))[:most]


def _each(left: pa.Table, right: pa.Table, low: np.ndarray, high: np.ndarray):
    """For each anchor of ``right``, its place and the ids, scores and equality of labels of a stretch of ``left`` that may matter."""
    dims = _dims(left, right)
    left = left.sort_by([("cell", "ascending"), ("angle", "ascending"), ("vec_id", "ascending")])
    rows, anchors = _Rows(left, dims), _Rows(right, dims)
    exact = dims * float(np.abs(rows.ints).max()) * float(np.abs(anchors.ints).max()) < EXACT
    rows.ints_as_doubles = rows.ints.astype(float) if exact else None
    codes = pd.factorize(pd.concat([rows.labels, anchors.labels]))[0]
    mine, theirs = codes[: len(rows.ids)], codes[len(rows.ids) :]
    for k, first, last in _stretches(rows, anchors, low, high):
        part = slice(first, last)
        yield k, anchors.ids[k], rows.ids[part], _scores(rows, anchors.ints[k], first, last, exact), mine[part] == theirs[k]


SCORED = pa.schema([("anchor_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
MINED = pa.schema([(n, pa.int64()) for n in ("anchor_id", "positive_id", "negative_id", "positive_score", "negative_score")])


def _table(found: list[np.ndarray], schema: pa.Schema) -> pa.Table:
    every = np.concatenate(found) if found else np.zeros((0, len(schema)), np.int64)
    return pa.Table.from_arrays([pa.array(c) for c in np.ascontiguousarray(every.T)], schema=schema)


def _same_label(left: pa.Table, right: pa.Table, low: np.ndarray) -> pa.Table:
    found = []
    for _, anchor, ids, scores, same in _each(left, right, low, np.full(len(low), np.inf)):
        keep = same & (ids != anchor)
        best = _best(scores[keep], ids[keep])
        found.append(np.stack([np.full(len(best), anchor), ids[keep][best], scores[keep][best]], axis=1))
    return _table(found, SCORED)


def _limits(table: pa.Table) -> np.ndarray:
    return table.column("low").to_pandas().fillna(-np.inf).to_numpy(float)


def _near_positives(left: pa.Table, right: pa.Table) -> pa.Table:
    if not left.num_rows or not right.num_rows:
        return _table([], SCORED)
    return _same_label(left, right, _limits(right))


def _other_label(left: pa.Table, right: pa.Table) -> pa.Table:
    if not left.num_rows or not right.num_rows:
        return _table([], MINED)
    positives = right.column("positives").to_pylist()
    found = []
    high = np.array([float(max(p["score"] for p in each)) for each in positives])
    for k, anchor, ids, scores, same in _each(left, right, _limits(right), high):
        ids, scores = ids[~same], scores[~same]
        for positive in positives[k]:
            score = positive["score"]
            inside = np.flatnonzero((scores <= score) & (5 * scores >= 4 * score))
            best = inside[_best(scores[inside], ids[inside])]
            n = len(best)
            found.append(np.stack([np.full(n, anchor), np.full(n, positive["vec_id"]), ids[best], np.full(n, score), scores[best]], axis=1))
    return _table(found, MINED)


def _first(found: DataFrame, of: list[str], score: str, row: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*of).orderBy(F.desc(score), row))
    return found.withColumn("rank", place).where(F.col("rank") <= FOUND)


def mine(rows: DataFrame, vector: str = "embedding", every: int = 100) -> DataFrame:
    """Negatives of (``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``).

    Anchors are the rows whose id is divisible by ``every``; the positives of one are the ``FOUND`` rows of its label with the highest
    scores (inner products of the whole numbers floor(256 x)), and each has the ``FOUND`` best rows of other labels whose scores
    lie between 80 and 100 percent of its own. Ties go to the smaller id. A positive with a negative score has no such rows.

    Which rows take part says ``whole_vectors``. Vectors of fewer dimensions count as filled up with zeros; a vector of zeros
    scores 0 with all. Scores beyond 60 bits raise ``ValueError``. An empty table gives an empty result.
    """
    index = indexed(whole_vectors(rows, vector))
    order = ["cell", "angle", "vec_id"]
    blocks = support.running_totals(index.withColumn("one", F.lit(1).cast("long")), order, "one")
    blocks = blocks.withColumn("block", F.expr(f"before div {BLOCK}")).drop("before", "one")
    anchors = support.running_totals(index.where(F.col("vec_id") % every == 0).withColumn("one", F.lit(1).cast("long")), order, "one")
    anchors = anchors.withColumn("group", F.expr(f"before div {GROUP}")).drop("before", "one")
    n_blocks, n_groups = (-(-t.count() // size) for t, size in ((index, BLOCK), (anchors, GROUP)))

    def seeds(table: pa.Table) -> pa.Table:
        """Scores of the positives of the anchors of a block within it: a limit that their real ones reach."""
        chosen = table.filter(pa.array(table.column("vec_id").to_numpy() % every == 0))
        return _same_label(table, chosen, np.full(chosen.num_rows, -np.inf)) if chosen.num_rows else _table([], SCORED)

    local = blocks.groupBy("block").applyInArrow(seeds, "anchor_id long, vec_id long, score long")
    limit = local.groupBy("anchor_id").agg(F.count("*").alias("n"), F.min("score").alias("low"))
    limit = limit.select(F.col("anchor_id").alias("vec_id"), F.when(F.col("n") == FOUND, F.col("low")).cast("double").alias("low"))
    anchors = support.staged(anchors.join(limit, "vec_id", "left"), "anchors")

    def meet(anchors: DataFrame, function, schema: str) -> DataFrame:
        """Every block with every group: rows go to each group, anchors to each block."""
        left = blocks.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(n_groups - 1, 0)).cast("long"))))
        right = anchors.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(n_blocks - 1, 0)).cast("long"))))
        return left.groupBy("block", "group").cogroup(right.groupBy("block", "group")).applyInArrow(function, schema)

    positives = _first(meet(anchors, _near_positives, "anchor_id long, vec_id long, score long"), ["anchor_id"], "score", "vec_id")
    listed = positives.where("score >= 0").groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct("vec_id", "score")).alias("positives"))
    listed = listed.withColumn("low", F.array_min(F.col("positives.score")).cast("double") * 0.8 - 1)
    anchors = support.staged(anchors.drop("low").join(listed, "vec_id"), "positives")
    names = [F.col(name) for name in MINED.names]
    negatives = meet(anchors, _other_label, ", ".join(f"{name} long" for name in MINED.names)).select(*names)
    ranked = _first(negatives, ["anchor_id", "positive_id"], "negative_score", "negative_id")
    return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
