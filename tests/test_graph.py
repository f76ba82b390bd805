import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import attention, blocks, dense_graph, graph, hooks
from corpusloom.operators import sentences as so
from corpusloom.plans import evaluation

NODES = "cluster_id long, pos long, vec array<double>, entities array<string>, sentence string"


def edges_of(df):
    return sorted((r.cluster_id, r.src, r.dst) for r in df.collect())


def test_edges(spark):
    rows = [
        (1, 0, [1.0, 0.0], ["a"], "s"),
        (1, 1, [2.0, 0.0], [], "s"),
        (1, 2, [0.0, 1.0], ["a", "b"], "s"),
        (1, 3, [0.0, 0.0], [], "zero vector"),
        (1, 4, [1.0, 0.0], ["a"], "  "),
        (1, 9, [1.0, 0.0], ["a"], "beyond the slots"),
        (2, 0, [1.0, 0.0], ["a"], "alone"),
    ]
    nodes = spark.createDataFrame(rows, NODES)
    assert edges_of(graph.similarity_edges(nodes, 0.75, slots=5)) == [(1, 0, 1), (1, 1, 0)]
    assert edges_of(graph.entity_edges(nodes, slots=5)) == [(1, 0, 2), (1, 2, 0)]
    loops = [(c, i, i) for c in (1, 2) for i in range(5)]
    assert edges_of(graph.adjacency(nodes, 0.75, slots=5)) == sorted([(1, 0, 1), (1, 1, 0), (1, 0, 2), (1, 2, 0), *loops])


def test_threshold_is_strict(spark):
    nodes = spark.createDataFrame([(1, 0, [1.0, 0.0], [], "s"), (1, 1, [3.0, 4.0], [], "s")], NODES)
    assert edges_of(graph.similarity_edges(nodes, 0.6)) == []
    assert edges_of(graph.similarity_edges(nodes, 0.59)) == [(1, 0, 1), (1, 1, 0)]


def test_adjacency_of_slots_has_one_shuffle(spark):
    nodes = spark.createDataFrame([(1, 0, [1.0], ["a"], "s")], NODES)
    plan = graph.adjacency(nodes, slots=30)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("block", [1, 3, 256])
def test_blocks_lose_no_edge(spark, block):
    rng = np.random.default_rng(4)
    rows = [(c, i, [float(x) for x in rng.normal(size=3)], [f"e{x}" for x in rng.integers(0, 9, 2)], "s") for c, n in ((1, 40), (2, 1), (3, 7)) for i in range(n)]
    got = edges_of(graph.adjacency(spark.createDataFrame(rows, NODES), 0.5, block=block))
    want = set()
    for c, i, u, e, _ in rows:
        for d, j, w, f, _ in rows:
            cosine = np.dot(u, w) / np.linalg.norm(u) / np.linalg.norm(w)
            if c == d and (i == j or cosine > 0.5 or set(e) & set(f)):
                want.add((c, i, j))
    assert got == sorted(want)


def test_edges_do_not_look_at_pairs_one_by_one(spark):
    """Missing entities link nothing, rows with one position link once, and no expression runs for each pair."""
    rows = [(1, 0, [1.0, 0.0], ["a", None], "s"), (1, 1, [0.0, 1.0], [None], "s"), (1, 2, [1.0, 0.1], None, "s"), (1, 2, [1.0, 0.1], ["a"], "s"), (1, 3, None, ["a"], None)]
    nodes = spark.createDataFrame(rows, NODES)
    loops = [(1, 0, 0), (1, 1, 1), (1, 2, 2), (1, 2, 2), (1, 3, 3)]
    assert edges_of(graph.entity_edges(nodes)) == [(1, 0, 2), (1, 2, 0)]
    assert edges_of(graph.adjacency(nodes, 0.9)) == sorted([(1, 0, 2), (1, 2, 0), *loops])
    for edges in (graph.entity_edges(nodes), graph.adjacency(nodes, 0.9)):
        plan = edges._jdf.queryExecution().optimizedPlan().toString()
        assert "lambda" not in plan and "arrays_overlap" not in plan
    missing = spark.createDataFrame([(1, 0, None, ["a"], "s"), (1, 1, None, ["a"], "s")], NODES)
    assert edges_of(graph.entity_edges(missing)) == [(1, 0, 1), (1, 1, 0)]
    with pytest.raises(Exception, match="missing"):
        graph.adjacency(missing, 0.9).collect()


def dense_layer(h, adj, w, a, slope=0.2):
    wh = h @ w
    size = wh.shape[1]
    e = (wh @ a[:size])[:, None] + (wh @ a[size:])[None, :]
    e = np.where(e >= 0, e, slope * e)
    e = np.where(adj > 0, e, -np.inf)
    top = np.max(e, axis=1, keepdims=True)
    p = np.where(adj > 0, np.exp(e - np.where(np.isfinite(top), top, 0)), 0)
    p = p / np.maximum(p.sum(1, keepdims=True), 1e-300)
    return np.maximum(p @ wh, 0)


def test_attention_equals_dense_computation(spark):
    rng = np.random.default_rng(1)
    h = rng.normal(size=(6, 5))
    adj = (rng.random((6, 6)) < 0.4).astype(float)
    adj[3] = 0
    layers = [(rng.normal(size=(5, 4)), rng.normal(size=8)), (rng.normal(size=(4, 4)), rng.normal(size=8)), (rng.normal(size=(4, 3)), rng.normal(size=6))]
    nodes = spark.createDataFrame([(7, i, [float(x) for x in h[i]]) for i in range(6)], "cluster_id long, node long, vec array<double>")
    edges = spark.createDataFrame([(7, int(i), int(j)) for i, j in np.argwhere(adj)], "cluster_id long, src long, dst long")
    out = attention.gat_layers(nodes, edges, [(w.tolist(), a.tolist()) for w, a in layers])
    got = np.array([r.vec for r in out.orderBy("node").collect()])
    want = h
    for w, a in layers:
        want = dense_layer(want, adj, w, a)
    assert got == pytest.approx(want)


def awkward_nodes(seed, vocabulary=9, most=5):
    """Clusters of one to 60 nodes; zero vectors, equal vectors, blank sentences, repeated and missing entities."""
    rng = np.random.default_rng(seed)
    rows = []
    for c, n in ((1, 60), (2, 1), (3, 7), (4, 30)):
        for i in range(n):
            vec = [float(x) for x in rng.normal(size=3)] if i % 5 else [1.0, 2.0, 0.0] if i % 10 else [0.0, 0.0, 0.0]
            entities = [f"e{x}" for x in rng.integers(0, vocabulary, rng.integers(0, most))] + ["hub"] * int(c == 4 and i % 2) + [None] * int(i % 7 == 0)
            rows.append((c, i, vec, entities if i % 11 else None, " " if i % 13 == 1 else "s"))
    return rows


def neighbours(rows, threshold):
    near, shared = set(), set()
    for c, i, u, e, s in rows:
        for d, j, w, f, t in rows:
            if c == d and i != j and s.strip() and t.strip():
                norm = np.linalg.norm(u) * np.linalg.norm(w)
                near |= {(c, i, j)} if norm and np.dot(u, w) / norm > threshold else set()
                shared |= {(c, i, j)} if (set(e or ()) & set(f or ())) - {None} else set()
    return near, shared


@pytest.mark.parametrize("block,subsets", [(1, 10), (4, 0), (256, 2)])
def test_degrees_without_edges(spark, monkeypatch, block, subsets):
    monkeypatch.setattr(blocks, "DIRECTIONS", 3)
    rows = awkward_nodes(block)
    near, shared = neighbours(rows, 0.9)
    nodes = spark.createDataFrame(rows, NODES)
    got = {(r[0], r[1]): r[2] for r in dense_graph.entity_degrees(nodes, most=subsets).collect()}
    assert got == {(c, i): sum(e[:2] == (c, i) for e in shared) for c, i, *_ in rows}
    assert edges_of(dense_graph.similar_pairs(nodes, 0.9, block)) == sorted(near)
    got = {(r.cluster_id, r.node): r.degree for r in dense_graph.degrees(nodes, 0.9, block).collect()}
    assert got == {(c, i): sum(e[:2] == (c, i) for e in near | shared) for c, i, *_ in rows}
    plain = spark.createDataFrame([(c, i, u, sorted({x for x in e or [] if x}), s) for c, i, u, e, s in rows], NODES)
    assert sorted(map(tuple, dense_graph.degree_report(nodes, 0.9, block).collect())) == sorted(map(tuple, graph.degree_report(graph.adjacency(plain, 0.9)).collect()))


@pytest.mark.parametrize("block", [3, 512])
def test_attention_without_edges(spark, block):
    rng = np.random.default_rng(2)
    rows = [(c, i, u, sorted({x for x in e or [] if x}), s) for c, i, u, e, s in awkward_nodes(7)]
    layers = [(rng.normal(size=(3, 4)).tolist(), rng.normal(size=8).tolist()), (rng.normal(size=(4, 2)).tolist(), rng.normal(size=4).tolist())]
    nodes = spark.createDataFrame(rows, NODES)
    got = {(r.cluster_id, r.node): r.vec for r in dense_graph.gat_layers(nodes, layers, 0.8, block=block).collect()}
    listed = attention.gat_layers(nodes.select("cluster_id", F.col("pos").alias("node"), "vec"), graph.adjacency(nodes, 0.8), layers)
    want = {(r.cluster_id, r.node): r.vec for r in listed.collect()}
    assert got.keys() == want.keys() and len(got) == len(rows)
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_one_entity_on_half_of_many_nodes(spark):
    """20,000 nodes, one entity on every second one: 50 million neighbours, of which none is listed."""
    nodes = spark.range(20_000).select(
        F.lit(1).alias("cluster_id"), F.col("id").alias("pos"), F.array(F.cos("id"), F.sin("id")).alias("vec"),
        F.array(F.when(F.col("id") % 2 == 0, "hub").otherwise(F.concat(F.lit("e"), F.col("id") % 1000))).alias("entities"),
    )
    found = dense_graph.entity_degrees(nodes)
    assert {(r.even, r.degree) for r in found.select((F.col("pos") % 2 == 0).alias("even"), "degree").distinct().collect()} == {(True, 9999), (False, 19)}
    weight = [[1.0], [0.0]]
    made = dense_graph.gat_layers(nodes.where("pos < 4000"), [(weight, [0.0, 0.0])], threshold=2.0).where("node % 2 = 0 AND node < 10").collect()
    want = max(float(np.cos(np.arange(0, 4000, 2)).mean()), 0)
    assert [r.vec[0] for r in made] == pytest.approx([want] * 5)


def test_blocks_that_cannot_hold_a_pair_do_not_meet(spark):
    angle = F.floor(F.col("id") / 250) * 0.7853981634 + (F.col("id") % 250) * 0.0004
    nodes = spark.range(2000).select(F.lit(1).alias("cluster_id"), F.col("id").alias("pos"), F.array(F.cos(angle), F.sin(angle)).alias("vec"))
    placed = blocks.by_direction(nodes, 100)
    report = blocks.pruning_report(placed, 0.99).first()
    assert placed.groupBy("own").count().agg(F.max("count")).first()[0] <= 200
    assert report.share_pruned > 0.7 and report.n_pairs >= 55


def test_cluster_sentences_of_a_hot_cluster(spark):
    docs = spark.range(3000).select(
        F.when(F.col("id") < 2000, 0).otherwise(F.col("id")).alias("c"), F.col("id").alias("p"), F.format_string("Sentence number %d here. And a second one.", "id").alias("t")
    )
    rows = so.cluster_sentences(docs, "c", "p", "t", slots=30)
    hot = [r.sentence for r in rows.where("c = 0").orderBy("pos").collect()]
    assert len(hot) == 30 and hot[0] == "Sentence number 0 here." and hot[28] == "Sentence number 14 here."
    assert "WindowGroupLimit" in rows._jdf.queryExecution().toString()


def test_cluster_text(spark):
    docs = spark.createDataFrame([(1, i, f"d{i}") for i in (2, 0, 1, 4, 3)], "c long, p long, t string")
    assert [tuple(r) for r in so.cluster_text(docs, "c", "p", "t", " | ").collect()] == [(1, 5, "d0 | d1 | d2 | d3 | d4")]


def test_all_sentences_of_a_cluster(spark):
    docs = spark.createDataFrame([(1, 1, "Third sentence. Fourth sentence."), (1, 0, "First sentence. Second sentence."), (1, 2, None), (2, 0, "Sentence alone.")], "c long, p long, t string")
    rows = so.cluster_sentences(docs, "c", "p", "t").orderBy("c", "pos").collect()
    assert [(r.c, r.pos, r.sentence.split()[0]) for r in rows] == [(1, 0, "First"), (1, 1, "Second"), (1, 2, "Third"), (1, 3, "Fourth"), (2, 0, "Sentence")]


def test_names_of_several_words(spark):
    docs = spark.createDataFrame([(1, "He flew from New York to Paris"), (2, "New York Paris London"), (3, None)], "id long, t string")
    listed = spark.createDataFrame([("new york", "GPE"), ("paris", "GPE"), ("york paris london", "ORG")], "entity string, label string")
    got = sorted(tuple(r) for r in so.entity_rows(docs, "id", "t", listed).collect())
    assert got == sorted(tuple(r) for r in so.entity_rows(docs, "id", "t", listed, max_bytes=0).collect())
    assert so.entity_rows(docs, "id", "t", listed.limit(0)).count() == 0
    both = so.entity_rows(docs, "id", "t", listed.unionByName(spark.createDataFrame([("paris", "ORG"), ("york", "EVENT")], listed.schema)))
    assert {(r.id, r.entity, r.label) for r in both.where("entity IN ('paris', 'york')").collect()} == {(i, "paris", label) for i in (1, 2) for label in ("GPE", "ORG")}
    assert got == [(1, "new york", "GPE"), (1, "paris", "GPE"), (2, "new york", "GPE"), (2, "paris", "GPE"), (2, "york paris london", "ORG")]


def test_summaries(spark):
    docs = spark.createDataFrame([(1, 0, "Alpha beta gamma. Alpha beta delta. Nothing in common."), (1, 1, "Alpha alone again.")], "c long, p long, t string")

    def features(rows):
        return rows.select("*", F.array(F.lit(0.0)).alias("vec"), F.split(F.lower("sentence"), " ").alias("entities"))

    row = evaluation.summarize(docs, "c", "p", "t", features, k=2).first()
    assert row.summary == "Alpha beta gamma. Alpha beta delta."

    def generator():
        def run(batch):
            text = batch.sentences.str.split("|||", regex=False).str[0]
            return batch[["cluster_id"]].assign(generated=text, latency=0.5, n_tokens=3)

        return run

    made = evaluation.summarize(docs, "c", "p", "t", generator=generator).first()
    assert made.generated == "Alpha beta gamma." and made.n_tokens == 3
    with pytest.raises(ValueError):
        evaluation.summarize(docs, "c", "p", "t")


def test_hooks(spark):
    import pandas as pd

    def extractor():
        return lambda batch: pd.DataFrame({"id": batch.id, "entity": batch.text.str.lower(), "label": "ORG"})

    def encoder():
        return lambda batch: batch.assign(vec=[[float(len(s))] for s in batch.sentence])

    def scorer():
        return lambda batch: pd.DataFrame({"pair_id": batch.pair_id, "logits": [[0.0, float(len(s)), 0.0] for s in batch.source]})

    texts = spark.createDataFrame([(1, "Ab")], "id long, text string")
    assert tuple(hooks.extract_entities(texts, extractor).first()) == (1, "ab", "ORG")
    sentences = spark.createDataFrame([(1, 0, "abc")], "cluster_id long, pos long, sentence string")
    assert hooks.encode_sentences(sentences, encoder).first().vec == [3.0]
    pairs = spark.createDataFrame([(1, "abcd", "x")], "pair_id long, source string, generated string")
    assert hooks.score_pairs(pairs, scorer).first().logits == [0.0, 4.0, 0.0]
