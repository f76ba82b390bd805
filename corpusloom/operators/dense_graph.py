"""Sentence graphs whose edges are never listed: degrees and attention straight from the nodes.

An entity that a third of all nodes share makes a third of all pairs neighbours. Here pairs exist only as bits, inside a task that
holds two blocks of nodes; what leaves it is a number or a partial sum for each node. Nodes are ``(cluster_id, pos, vec,
entities[, sentence])``; nodes with a blank sentence take part in no edge.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators import blocks
from corpusloom.operators.attention import SLOPE, projected
from corpusloom.operators.graph import THRESHOLD, report_of
from corpusloom.shared import cut_lineage

#: Nodes with more entities than this are not counted by subsets, but by the sets they meet.
SUBSETS = 10


def _plain(nodes: DataFrame) -> DataFrame:
    filled = F.coalesce(F.trim(F.col("sentence")) != "", F.lit(False)) if "sentence" in nodes.columns else F.lit(True)
    entities = F.array_sort(F.array_distinct(F.array_compact(F.coalesce("entities", F.array().cast("array<string>")))))
    return nodes.select(
        "cluster_id", F.col("pos").cast("long").alias("pos"), F.transform("vec", lambda x: x.cast("double")).alias("vec"), entities.alias("entities"), filled.alias("filled")
    )


def entity_degrees(nodes: DataFrame, most: int = SUBSETS) -> DataFrame:
    """``(cluster_id, pos, degree)``: how many other nodes share at least one entity with a node, without a pair being made.

    Nodes are first put together by their set of entities. How many nodes hold all of a set is counted for each subset of these
    sets; for a node, the counts of its subsets, added for odd and taken away for even sizes, give the nodes that meet it. A set of
    more than ``most`` entities has too many subsets: its node meets the distinct sets, with their numbers of nodes.
    """
    rows = _plain(nodes).where("filled")
    sets = cut_lineage(rows.where(F.size("entities") > 0).groupBy("cluster_id", "entities").agg(F.count("*").alias("n")))
    small = F.size("entities") <= most
    parts = F.expr("transform(sequence(1, shiftleft(1, size(entities)) - 1), m -> filter(entities, (e, k) -> shiftright(m, k) & 1 = 1))")
    listed = sets.where(small).select("cluster_id", "entities", "n", F.explode(parts).alias("part"))
    held = listed.groupBy("cluster_id", "part").agg(F.sum("n").alias("held"))
    sign = F.when(F.size("part") % 2 == 1, F.col("held")).otherwise(-F.col("held"))
    by_subsets = listed.join(held, ["cluster_id", "part"]).groupBy("cluster_id", "entities").agg(F.sum(sign).alias("met"))
    # What large sets add: to small ones, and all that they meet themselves.
    of = sets.select("cluster_id", "entities", "n", F.explode("entities").alias("entity"))
    large = of.where(~small)
    meets = large.select("cluster_id", "entity", F.col("entities").alias("other"), F.col("n").alias("others"))
    pairs = of.join(meets, ["cluster_id", "entity"]).select("cluster_id", "entities", "n", "other", "others").distinct()
    to_all = pairs.groupBy("cluster_id", "entities").agg(F.sum("others").alias("met"))
    back = pairs.where(F.size("entities") <= most).groupBy("cluster_id", F.col("other").alias("entities")).agg(F.sum("n").alias("met"))
    met = by_subsets.union(to_all).union(back).groupBy("cluster_id", "entities").agg(F.sum("met").alias("met"))
    degree = F.when(F.col("filled"), F.coalesce(F.col("met") - 1, F.lit(0))).otherwise(0).cast("long")
    return _plain(nodes).join(met, ["cluster_id", "entities"], "left").select("cluster_id", "pos", degree.alias("degree"))


def entity_groups(nodes: DataFrame) -> DataFrame:
    """``(cluster_id, entity, pos, others)``: which nodes hold an entity, and how many others do.

    The edges by shared entities in a form that grows with the nodes: any two nodes of a group are neighbours. ``graph.entity_edges``
    lists the pairs, whose number grows with the square of the largest group.
    """
    rows = _plain(nodes).where("filled").select("cluster_id", F.explode("entities").alias("entity"), "pos")
    sizes = rows.groupBy("cluster_id", "entity").agg((F.count("*") - 1).alias("others"))
    return rows.join(sizes, ["cluster_id", "entity"]).select("cluster_id", "entity", "pos", "others")


def _shared(entities: pa.ChunkedArray) -> np.ndarray:
    """Which rows have an entity in common."""
    lists = entities.combine_chunks()
    row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    code = pd.factorize(lists.flatten().to_numpy(zero_copy_only=False))[0]
    out = np.zeros((len(lists), len(lists)), bool)
    order = np.argsort(code, kind="stable")
    for holders in np.split(row[order], np.flatnonzero(np.diff(code[order])) + 1):
        if len(holders) > 1:
            out[np.ix_(holders, holders)] = True
    return out


class _Met:
    """Two blocks (or one) in a task: positions, vectors, and which node is a neighbour of which."""

    def __init__(self, group: pa.Table, threshold: float) -> None:
        self.pos = group.column("pos").to_numpy()
        self.cluster, i, j = (group.column(k)[0].as_py() for k in ("cluster_id", "i", "j"))
        own, filled = group.column("own").to_numpy(), group.column("filled").to_numpy()
        rows = blocks.units(blocks.matrix(group.column("vec")))
        across = (own[:, None] == i) & (own[None, :] == j) | (own[:, None] == j) & (own[None, :] == i)
        usable = across & filled[:, None] & filled[None, :] & ~np.eye(len(own), dtype=bool)
        self.similar = usable & (rows @ rows.T > threshold)
        self.shared = usable & _shared(group.column("entities"))
        self.same = i == j


def similar_pairs(nodes: DataFrame, threshold: float, block: int = blocks.BLOCK) -> DataFrame:
    """``(cluster_id, src, dst)``, both directions: cosine strictly above the threshold. Pairs of blocks that cannot hold one never meet."""
    key = dict(nodes.dtypes)["cluster_id"]
    placed = cut_lineage(blocks.by_direction(_plain(nodes).drop("entities").withColumn("entities", F.array().cast("array<string>")), block))
    pairs = blocks.block_pairs(placed, threshold).where("met").drop("met")

    def edges(group: pa.Table) -> pa.Table:
        met = _Met(group, threshold)
        a, b = np.nonzero(met.similar)
        return pa.table({"cluster_id": pa.array([met.cluster] * len(a), group.schema.field("cluster_id").type), "src": met.pos[a], "dst": met.pos[b]})

    return blocks.meeting(placed, pairs).groupBy("cluster_id", "i", "j").applyInArrow(edges, f"cluster_id {key}, src long, dst long")


def degrees(nodes: DataFrame, threshold: float = THRESHOLD, block: int = blocks.BLOCK) -> DataFrame:
    """``(cluster_id, node, degree)``: neighbours by similarity or by an entity, without self loops. No edge is listed.

    Those by an entity come from ``entity_degrees``; those by similarity alone are counted where blocks meet.
    """
    key = dict(nodes.dtypes)["cluster_id"]
    placed = cut_lineage(blocks.by_direction(_plain(nodes), block))
    pairs = blocks.block_pairs(placed, threshold).where("met").drop("met")

    def alone(group: pa.Table) -> pa.Table:
        met = _Met(group, threshold)
        counts = (met.similar & ~met.shared).sum(axis=1)
        return pa.table({"cluster_id": pa.array([met.cluster] * len(counts), group.schema.field("cluster_id").type), "pos": met.pos, "degree": counts})

    counted = blocks.meeting(placed, pairs).groupBy("cluster_id", "i", "j").applyInArrow(alone, f"cluster_id {key}, pos long, degree long")
    sentences = placed.select("cluster_id", "pos", "vec", "entities", F.when(F.col("filled"), "x").alias("sentence"))
    both = counted.unionByName(entity_degrees(sentences))
    return both.groupBy("cluster_id", F.col("pos").alias("node")).agg(F.sum("degree").alias("degree"))


def degree_report(nodes: DataFrame, threshold: float = THRESHOLD, block: int = blocks.BLOCK) -> DataFrame:
    """As ``graph.degree_report`` over the adjacency of ``nodes``."""
    return report_of(degrees(nodes, threshold, block))


def gat_layers(
    nodes: DataFrame, layers: list[tuple[list[list[float]], list[float]]], threshold: float = THRESHOLD, slope: float = SLOPE, block: int = 2 * blocks.BLOCK
) -> DataFrame:
    """Stacked attention layers over the adjacency of ``nodes``: ``(cluster_id, node, vec)``, as ``attention.gat_layers`` gives them.

    Where two blocks meet, each node's attention to the other block is summed up to its largest score, the sum of the
    exponentials below it, and the weighted vectors. These partial sums are merged by node, so a node with any number of
    neighbours is the work of many tasks.
    """
    key = dict(nodes.dtypes)["cluster_id"]
    placed = cut_lineage(blocks.by_position(_plain(nodes), block))
    state = placed.select("cluster_id", F.col("pos").alias("node"), "vec")
    for depth, (weight, attention) in enumerate(layers):
        size = len(weight[0])
        scored = projected(cut_lineage(state) if depth else state, weight, attention)
        scored = scored.select("cluster_id", F.col("node").alias("pos"), "wh", F.col("own").alias("to"), F.col("other").alias("by"))

        def attend(group: pa.Table) -> pa.Table:
            met = _Met(group, threshold)
            linked = met.similar | met.shared
            if met.same:
                linked |= np.eye(len(met.pos), dtype=bool)
            wh = blocks.matrix(group.column("wh"))
            raw = group.column("to").to_numpy()[:, None] + group.column("by").to_numpy()[None, :]
            scores = np.where(linked, np.where(raw >= 0, raw, raw * slope), -np.inf)
            some = np.flatnonzero(linked.any(axis=1))
            top = scores[some].max(axis=1)
            shares = np.exp(scores[some] - top[:, None])
            sums = pa.array(list(shares @ wh), pa.list_(pa.float64()))
            names = pa.array([met.cluster] * len(some), group.schema.field("cluster_id").type)
            return pa.table({"cluster_id": names, "node": met.pos[some], "top": top, "total": shares.sum(axis=1), "sums": sums})

        features = placed.join(scored, ["cluster_id", "pos"])
        partial = blocks.meeting(features).groupBy("cluster_id", "i", "j").applyInArrow(attend, f"cluster_id {key}, node long, top double, total double, sums array<double>")
        state = merged(partial, size)
    return state


def merged(partial: DataFrame, size: int) -> DataFrame:
    """Partial attention ``(cluster_id, node, top, total, sums)`` put together, divided by its total, negative parts set to zero."""
    highest = F.max("top").over(Window.partitionBy("cluster_id", "node"))
    scaled = partial.withColumn("_scale", F.exp(F.col("top") - highest))

    def part(k: int) -> Column:
        return F.greatest(F.sum(F.get("sums", F.lit(k)) * F.col("_scale")) / F.sum(F.col("total") * F.col("_scale")), F.lit(0.0))

    return scaled.groupBy("cluster_id", "node").agg(F.array(*[part(k) for k in range(size)]).alias("vec"))
