"""Graph attention over sentence graphs as message passing along edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.vectors import dot
from corpusloom.shared import cut_lineage

SLOPE = 0.2


def _leaky(x: Column, slope: float) -> Column:
    return F.when(x >= 0, x).otherwise(x * slope)


def projected(nodes: DataFrame, weight: list[list[float]], attention: list[float]) -> DataFrame:
    """Add ``wh = W . vec`` and the two halves of the attention score, which depend on one node each."""
    size = len(weight[0])
    columns = [[float(row[k]) for row in weight] for k in range(size)]
    parameters = nodes.sparkSession.createDataFrame(
        [(columns, [float(x) for x in attention[:size]], [float(x) for x in attention[size:]])],
        "columns array<array<double>>, own array<double>, other array<double>",
    )
    joined = nodes.crossJoin(F.broadcast(parameters))
    projected = joined.withColumn("wh", F.transform("columns", lambda w: dot(F.col("vec"), w)))
    return projected.select(
        "cluster_id", "node", "wh", dot(F.col("own"), F.col("wh")).alias("own"), dot(F.col("other"), F.col("wh")).alias("other")
    )


def gat_layer(
    nodes: DataFrame,
    edges: DataFrame,
    weight: list[list[float]],
    attention: list[float],
    slope: float = SLOPE,
) -> DataFrame:
    """One attention layer followed by ReLU: ``(cluster_id, node, vec)`` in, the same out.

    ``weight`` is input size x output size, ``attention`` has twice the output size. A node attends to the ``dst`` of its edges;
    one without edges gets zeros. Softmax is two sums that Spark begins before the shuffle, so no task gathers a node's neighbours:
    scores rise with the neighbour's half, so the largest half gives the largest score, which all others are taken relative to.
    """
    size = len(weight[0])
    state = cut_lineage(projected(nodes, weight, attention))
    told = state.select("cluster_id", F.col("node").alias("dst"), "other", "wh")
    messages = edges.select("cluster_id", F.col("src").alias("node"), "dst").join(told, ["cluster_id", "dst"])
    most = edges.join(told.drop("wh"), ["cluster_id", "dst"]).groupBy("cluster_id", F.col("src").alias("node")).agg(F.max("other").alias("_most"))
    asked = state.select("cluster_id", "node", "own").join(most, ["cluster_id", "node"])
    scores = messages.join(asked, ["cluster_id", "node"])
    score = lambda other: _leaky(F.col("own") + F.col(other), slope)
    share = F.exp(score("other") - score("_most"))
    summed = scores.withColumn("_share", share).groupBy("cluster_id", "node").agg(
        F.sum("_share").alias("_total"), *[F.sum(F.get("wh", F.lit(k)) * F.col("_share")).alias(f"_{k}") for k in range(size)]
    )
    parts = F.array(*[F.greatest(F.col(f"_{k}") / F.col("_total"), F.lit(0.0)) for k in range(size)])
    received = state.select("cluster_id", "node").join(summed, ["cluster_id", "node"], "left")
    return received.select("cluster_id", "node", F.when(F.col("_total").isNull(), F.array_repeat(F.lit(0.0), size)).otherwise(parts).alias("vec"))


def gat_layers(
    nodes: DataFrame,
    edges: DataFrame,
    layers: list[tuple[list[list[float]], list[float]]],
    slope: float = SLOPE,
) -> DataFrame:
    """Stacked layers. Edges, which are used several times, are checkpointed. ``dense_graph.gat_layers`` does without them."""
    state, edges = nodes, cut_lineage(edges)
    for weight, attention in layers:
        state = gat_layer(state, edges, weight, attention, slope)
    return state
