"""Nodes of a cluster in blocks of bounded size, and the pairs of blocks that have to meet.

Blocks by position keep neighbours in the text together. Blocks by direction keep similar vectors together: each has a centre and a
radius, the largest angle between its vectors and the centre, and two blocks whose centres lie further apart than
both radii and the wanted angle hold no similar pair. Such pairs are left out before any vector travels.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.vectors import dot

BLOCK = 256
#: Vectors that are sampled to choose directions, how many are chosen, and the steps of the angle to them that order a cluster.
SAMPLE, DIRECTIONS, STEPS = 2048, 16, 64
#: Radians by which all bounds are widened, far more than rounding takes away.
SLACK = 1e-6


def matrix(lists: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Equally long lists of numbers as rows of doubles."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), -1)


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; a row of zeros stays one."""
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)


def directions_of(vectors: np.ndarray, most: int = DIRECTIONS) -> np.ndarray:
    """Directions of rows that lie far apart: each next one has the smallest cosine to those before it."""
    rows = units(vectors[np.any(vectors != 0, axis=1)])
    if not len(rows):
        return np.eye(1, vectors.shape[1])
    chosen, near = [0], rows @ rows[0]
    while len(chosen) < min(most, len(rows)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, rows @ rows[chosen[-1]])
    return rows[chosen]


def by_position(nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """Add ``own``, the block of a node."""
    return nodes.withColumn("own", F.floor(F.col("pos") / block))


def by_direction(nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """Add ``own``: the nodes of a cluster that are nearest to one direction, in order of their angle to it, cut into blocks of up
    to twice ``block``. Where more nodes than that have the same place in this order, they are split by a hash. A cluster
    of at most ``block`` nodes is one block."""
    sample = nodes.where(F.size("vec") > 0).orderBy(F.xxhash64("cluster_id", "pos"), "cluster_id", "pos").limit(SAMPLE).select("vec").toArrow()
    chosen = directions_of(matrix(sample.column("vec"))) if sample.num_rows else None

    def placed(batches):
        for batch in batches:
            rows = units(matrix(batch.column(batch.schema.get_field_index("vec")))) if batch.num_rows and chosen is not None else np.zeros((batch.num_rows, 1))
            cosines = rows @ chosen.T if chosen is not None and batch.num_rows else np.zeros((batch.num_rows, 1))
            cell = cosines.argmax(axis=1)
            step = np.arccos(np.clip(cosines[np.arange(len(cell)), cell], -1, 1)) * (STEPS / math.pi)
            bucket = cell * (STEPS + 1) + step.astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bucket, pa.int64())], [*batch.schema.names, "_bucket"])

    schema = ", ".join(f"`{name}` {kind}" for name, kind in nodes.dtypes)
    rows = nodes.mapInArrow(placed, f"{schema}, _bucket long")
    counts = rows.groupBy("cluster_id", "_bucket").agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_cell", F.floor(F.col("_bucket") / (STEPS + 1)))
    before = Window.partitionBy("cluster_id", "_cell").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumns({"_start": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_all": F.sum("_n").over(Window.partitionBy("cluster_id"))})
    part = F.pmod(F.xxhash64("pos"), F.ceil(F.col("_n") / block)) * block
    number = F.col("_cell") * (1 << 40) + F.floor((F.col("_start") + part) / block)
    own = F.when(F.col("_all") <= block, 0).otherwise(number).cast("long")
    return rows.join(starts, ["cluster_id", "_bucket"]).withColumn("own", own).drop("_bucket", "_n", "_start", "_cell", "_all")


def _ball(group: pa.Table) -> pa.Table:
    rows = units(matrix(group.column("vec")))
    centre = units(rows.mean(axis=0, keepdims=True))[0]
    radius = float(np.arccos(np.clip(rows @ centre, -1, 1)).max())
    # A vector of zeros is similar to nothing, but must not shrink the ball either; it counts as a right angle.
    head = group.slice(0, 1).select(["cluster_id", "own"])
    return head.append_column("centre", pa.array([centre.tolist()], pa.list_(pa.float64()))).append_column("radius", pa.array([radius]))


def block_pairs(placed: DataFrame, threshold: float) -> DataFrame:
    """``(cluster_id, i, j, met)`` for all pairs i <= j of blocks: whether they may hold a pair with a cosine above ``threshold``."""
    key = dict(placed.dtypes)["cluster_id"]
    balls = placed.select("cluster_id", "own", "vec").groupBy("cluster_id", "own").applyInArrow(_ball, f"cluster_id {key}, own long, centre array<double>, radius double")
    a = balls.select("cluster_id", F.col("own").alias("i"), F.col("centre").alias("_a"), F.col("radius").alias("_r"))
    b = balls.select("cluster_id", F.col("own").alias("j"), F.col("centre").alias("_b"), F.col("radius").alias("_s"))
    both = a.join(b, "cluster_id").where("i <= j")
    gap = F.acos(F.least(F.greatest(dot(F.col("_a"), F.col("_b")), F.lit(-1.0)), F.lit(1.0)))
    reach = math.acos(max(-1.0, min(1.0, threshold))) + SLACK
    return both.select("cluster_id", "i", "j", ((F.col("i") == F.col("j")) | (gap <= F.col("_r") + F.col("_s") + reach)).alias("met"))


def pruning_report(placed: DataFrame, threshold: float) -> DataFrame:
    """How many pairs of blocks there are and how many have to meet: ``(n_pairs, n_met, share_pruned)``."""
    found = block_pairs(placed, threshold).agg(F.count("*").alias("n_pairs"), F.count_if("met").alias("n_met"))
    return found.withColumn("share_pruned", 1 - F.try_divide("n_met", "n_pairs"))


def meeting(placed: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Nodes once for each pair (``i``, ``j``), i <= j, of blocks that theirs is part of: all pairs of a cluster, or those in ``pairs``."""
    if pairs is None:
        last = placed.groupBy("cluster_id").agg(F.max("own").alias("_last"))
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last"))).alias("_other")
        rows = placed.join(last, "cluster_id").select(*placed.columns, other)
        return rows.withColumns({"i": F.least("own", "_other"), "j": F.greatest("own", "_other")}).drop("_other")
    first = pairs.select("cluster_id", F.col("i").alias("own"), "i", "j")
    second = pairs.where("i < j").select("cluster_id", F.col("j").alias("own"), "i", "j")
    return placed.join(first.union(second), ["cluster_id", "own"])
