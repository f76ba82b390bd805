"""Sentence graphs: edges by similarity and by shared entities, degrees, extractive summaries.

Nodes of a cluster are cut into blocks by their position; each pair of blocks is one group, so a cluster of any size is
spread over tasks, pairs are formed inside a group, and only edges leave it. A small cluster is one group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators import blocks

THRESHOLD = 0.75
#: Nodes of a block; a node travels once for each block of its cluster.
BLOCK = 1024


def _neighbours(group: pa.Table, i: int, j: int, threshold: float | None, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of linked nodes, the smaller one first, of the blocks ``i`` and ``j``."""
    used = group.filter(group.column("filled"))
    pos = used.column("pos").to_numpy()
    first, second = np.flatnonzero(pos // block == i), np.flatnonzero(pos // block == j)
    linked = np.zeros((len(first), len(second)), bool)
    if threshold is not None and linked.size:
        vectors = used.column("vec").combine_chunks()
        if len(pos) > 1 and (vectors.null_count or len(pc.unique(pc.list_value_length(vectors))) > 1):
            raise ValueError("vectors of a cluster are missing, or differ in length")
        unit = blocks.units(blocks.matrix(vectors)) if len(pos) > 1 else np.zeros((len(pos), 1))
        linked |= unit[first] @ unit[second].T > threshold
    if "entities" in used.column_names:
        lists = used.column("entities").combine_chunks()
        code = lists.flatten().dictionary_encode().indices
        row, code = pc.list_parent_indices(lists).filter(code.is_valid()).to_numpy(), code.drop_null().to_numpy()
        order = np.argsort(code, kind="stable")
        left, right = np.full(len(pos), -1), np.full(len(pos), -1)
        left[first], right[second] = np.arange(len(first)), np.arange(len(second))
        for holders in np.split(row[order], np.flatnonzero(np.diff(code[order])) + 1):
            if len(holders) > 1:
                a, b = left[holders], right[holders]
                linked[np.ix_(a[a >= 0], b[b >= 0])] = True
    a, b = np.nonzero(linked)
    src, dst = pos[first][a], pos[second][b]
    kept = src < dst
    return src[kept], dst[kept]


def _edges(nodes: DataFrame, threshold: float | None, entities: bool, loops: bool, slots: int | None, block: int) -> DataFrame:
    """``(cluster_id, src, dst)``, both directions: what two blocks (or one) of a cluster have in common is found in one task.

    ``nodes`` is ``(cluster_id, pos, vec, entities[, sentence])``; ``pos`` counts from 0. With ``slots``, nodes beyond the
    last slot do not exist. Nodes with a blank sentence take part in no edge. With ``loops``, an edge comes once, and every node
    (or slot) has one to itself.
    """
    used = nodes if slots is None else nodes.where(F.col("pos") < slots)
    filled = F.coalesce(F.trim(F.col("sentence")) != "", F.lit(False)) if "sentence" in nodes.columns else F.lit(True)
    features = [*(["vec"] if threshold is not None else []), *(["entities"] if entities else [])]
    placed = used.select("cluster_id", F.col("pos").cast("long").alias("pos"), filled.alias("filled"), *features, F.floor(F.col("pos") / block).alias("own"))
    one = slots is not None and slots <= block
    met = placed.withColumns({"i": F.lit(0).cast("long"), "j": F.lit(0).cast("long")}) if one else blocks.meeting(placed)

    def linked(group: pa.Table) -> pa.Table:
        cluster, i, j = (group.column(k)[0] for k in ("cluster_id", "i", "j"))
        i, j = i.as_py(), j.as_py()
        src, dst = _neighbours(group, i, j, threshold, block)
        ends = [src, dst]
        if loops:
            pos = group.column("pos").to_numpy()
            if len(np.unique(pos)) < len(pos):
                src, dst = np.unique(np.stack([src, dst]), axis=1)
            own = pos[pos // block == i] if i == j else pos[:0]
            own = own if slots is None else np.arange(slots if j == 0 else 0)
            ends = [src, dst, own]
        table = {"src": np.concatenate(ends), "dst": np.concatenate([dst, src, *ends[2:]])}
        kind = group.schema.field("cluster_id").type
        names = pa.nulls(len(table["src"]), kind) if not cluster.is_valid else pa.repeat(cluster, len(table["src"]))
        return pa.table({"cluster_id": names, **table})

    kind = dict(nodes.dtypes)["cluster_id"]
    return met.groupBy("cluster_id", "i", "j").applyInArrow(linked, f"cluster_id {kind}, src long, dst long")


def similarity_edges(nodes: DataFrame, threshold: float = THRESHOLD, slots: int | None = None, block: int = BLOCK) -> DataFrame:
    """``(cluster_id, src, dst)``, both directions: cosine strictly above the threshold."""
    return _edges(nodes, threshold, False, False, slots, block)


def entity_edges(nodes: DataFrame, slots: int | None = None, block: int = BLOCK) -> DataFrame:
    """``(cluster_id, src, dst)``, both directions: at least one entity in common."""
    return _edges(nodes, None, True, False, slots, block)


def adjacency(nodes: DataFrame, threshold: float = THRESHOLD, slots: int | None = None, block: int = BLOCK) -> DataFrame:
    """``(cluster_id, src, dst)``: similarity and entity edges, each once, and a self loop on every node, or on every
    slot if there are ``slots``."""
    return _edges(nodes, threshold, True, True, slots, block)


def degrees(edges: DataFrame) -> DataFrame:
    """``(cluster_id, node, degree)`` without self loops."""
    return edges.groupBy("cluster_id", F.col("src").alias("node")).agg(
        F.count_if(F.col("src") != F.col("dst")).alias("degree")
    )


def degree_report(edges: DataFrame) -> DataFrame:
    """Per cluster: nodes, undirected edges, mean and largest degree, isolated nodes. ``dense_graph.degree_report`` needs no edges."""
    return report_of(degrees(edges))


def report_of(per_node: DataFrame) -> DataFrame:
    """The same from ``(cluster_id, node, degree)``."""
    return per_node.groupBy("cluster_id").agg(
        F.count("*").alias("n_nodes"),
        F.floor(F.sum("degree") / 2).alias("n_edges"),
        F.avg("degree").alias("mean_degree"),
        F.max("degree").alias("max_degree"),
        F.count_if(F.col("degree") == 0).alias("n_isolated"),
    )


def extract_summaries(sentences: DataFrame, edges: DataFrame, k: int = 3) -> DataFrame:
    """``(cluster_id, n_sentences, summary)``: the ``k`` best connected sentences of a cluster in text order.

    ``sentences`` is ``(cluster_id, pos, sentence)`` of the graph's nodes. Earlier sentences win ties.
    """
    scored = sentences.join(degrees(edges).withColumnRenamed("node", "pos"), ["cluster_id", "pos"])
    best = Window.partitionBy("cluster_id").orderBy(F.desc("degree"), "pos")
    chosen = scored.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= k)
    ordered = F.sort_array(F.collect_list(F.struct("pos", "sentence")))
    return chosen.groupBy("cluster_id").agg(
        F.count("*").alias("n_sentences"),
        F.array_join(F.transform(ordered, lambda s: s["sentence"]), " ").alias("summary"),
    )
