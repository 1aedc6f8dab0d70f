"""Components solved whole in tasks against the rounds and the loops on the driver."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import colours, community, metrics, whole
from corpusloom.operators.graph import Graph

from .test_rounds import make, random_edges


def parted(seed: int, parts: int, n: int, p: float) -> list:
    """Edges of ``parts`` graphs side by side."""
    return [(a + 100 * k, b + 100 * k, w) for k in range(parts) for a, b, w in random_edges(seed + k, n, p, True)]


def rows(df) -> set:
    return set(map(tuple, df.collect()))


def test_hash_chain(spark):
    got = spark.range(50).select(F.xxhash64("id").alias("a"), F.xxhash64("id", F.lit(7)).alias("b"), F.xxhash64("id", F.lit(7), F.lit(-3)).alias("c")).toPandas()
    assert (whole.then_int(got["a"].to_numpy(), 7) == got["b"]).all() and (whole.then_int(got["b"].to_numpy(), -3) == got["c"]).all()


@pytest.mark.parametrize("method", [community.label_propagation, colours.label_propagation])
def test_labels_in_tasks_equal_rounds(spark, monkeypatch, method):
    monkeypatch.setattr(whole, "PACK", 60)
    g = make(spark, [*parted(3, 3, 7, 0.3), (500, 501, 1), (501, 502, 2)], nodes=[999])
    expected = rows(method(g, most=3))  # all but the short path in rounds
    assert rows(method(g)) == expected and (999, 999) in expected


def test_communities_of_components(spark, monkeypatch):
    monkeypatch.setattr(whole, "PACK", 60)
    monkeypatch.setattr(whole, "RANKED", 3)
    g = make(spark, parted(5, 3, 16, 0.2), nodes=[999])
    got = colours.louvain(g).cache()
    assert metrics.modularity(g, got).first()[0] >= 0.99 * metrics.modularity(g, community.louvain(g)).first()[0]
    sizes = [r["n"] for r in got.groupBy("cluster").agg(F.count("*").alias("n")).orderBy("cluster").collect()]
    assert sizes == sorted(sizes, reverse=True) and got.agg(F.max("cluster") + 1).first()[0] == len(sizes)
    assert got.where("id < 999").groupBy("cluster").agg(F.count_distinct(F.floor(F.col("id") / 100)).alias("k")).where("k > 1").isEmpty()


def test_no_graph_is_refused(spark, monkeypatch):
    """Beyond ``max_edges`` the same greedy result comes from components, as dicts and as matrices; Louvain and Leiden go on."""
    monkeypatch.setattr(whole, "PACK", 60)
    g = make(spark, parted(9, 3, 16, 0.25), nodes=[999])
    expected = rows(community.greedy_modularity(g))
    assert rows(community.greedy_modularity(g, max_edges=40)) == expected == rows(community.greedy_modularity(g, max_edges=5))
    for method in (community.louvain, community.leiden):
        assert method(g, max_edges=5).count() == 49


def test_dense_greedy_equals_heap():
    rng = np.random.default_rng(1)
    for n, p in ((1, 0), (12, 0.3), (40, 0.5), (60, 0.08)):
        s, d = np.triu_indices(n, 1)
        keep = rng.random(len(s)) < p
        s, d = s[keep], d[keep]
        w = rng.integers(1, 4, len(s)).astype(float)
        m2 = 2 * w.sum() * 1.5  # a part of a larger graph
        near = whole.neighbours(s, d, w, n)
        assert dict(enumerate(community._greedy_dense(s, d, w, n, m2).tolist())) == community._greedy(near, m2)


def test_article_graph_is_stored_once(spark, sf, monkeypatch):
    """The measures of the largest component read a stored graph; the layer and its components are not made for each."""
    from corpusloom.plans import network

    seen = []
    monkeypatch.setattr(network.metrics, "degree_centrality", lambda g: seen.append(g) or g.nodes.withColumn("score", F.lit(1.0)))
    monkeypatch.setattr(network.metrics, "betweenness", lambda g, max_nodes: g.nodes.withColumn("score", F.lit(1.0)))
    monkeypatch.setattr(network.metrics, "closeness", lambda g: g.nodes.withColumn("score", F.lit(1.0)))
    network.article_centralities(spark, sf)
    assert not any(x in g._jdf.queryExecution().toString() for g in (seen[0].nodes, seen[0].edges) for x in ("Window", "Join"))
