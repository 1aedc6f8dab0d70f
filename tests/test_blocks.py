"""Distances as bits in blocks, and what stands on them."""

import random

import pytest

from corpusloom.operators import blocks, graph, metrics
from corpusloom.operators.graph import Graph


def _graph(spark, n, m, seed):
    r = random.Random(seed)
    edges = {tuple(sorted(r.sample(range(n), 2))) for _ in range(m)}
    return Graph(spark.range(n).select("id"), spark.createDataFrame([(a, b, 1) for a, b in edges], "src long, dst long, weight long"))


@pytest.mark.parametrize("n, m", [(90, 300), (40, 30)])
def test_distance_sums_against_all_pairs(spark, n, m):
    """In one block and in many, from all nodes and from some, isolated nodes and several components included."""
    g = _graph(spark, n, m, n)
    pairs = [tuple(r) for r in metrics.distances(g).select("source", "id", "dist").collect()]
    for sources, small in ((None, 1024), (None, 0), (g.nodes.where("id % 3 = 0"), 0)):
        want = {i: (0, 0, 0) for i in range(n)}
        for s, t, d in pairs:
            if d and (sources is None or s % 3 == 0):
                a = want[t]
                want[t] = (a[0] + 1, a[1] + d, max(a[2], d))
        got = {r["id"]: (r["reached"], r["total"], r["far"]) for r in blocks.distance_sums(g, sources, small).collect()}
        assert got == want


def test_no_table_of_pairs(spark, monkeypatch):
    """Closeness and path lengths no longer join every pair with the edges."""

    def refuse(*a, **k):
        raise AssertionError("a table of pairs")

    g = _graph(spark, 50, 120, 5)
    want = {r["id"]: round(r["score"], 9) for r in metrics.closeness(g, metrics.distances(g)).collect()}
    lengths = metrics.path_stats(g, metrics.distances(g)).first()
    monkeypatch.setattr(metrics, "distances", refuse)
    assert {r["id"]: round(r["score"], 9) for r in metrics.closeness(g).collect()} == want
    assert metrics.path_stats(g).first() == lengths


def test_betweenness_three_ways(spark, monkeypatch):
    """By a list of neighbours, by matrix products, and in rounds where the edges are too many to be broadcast."""
    g = _graph(spark, 60, 150, 7)
    score = lambda **k: {r["id"]: round(r["score"], 9) for r in metrics.betweenness(g, max_nodes=None, **k).collect()}
    want = score()
    assert score(max_edges=10) == want
    monkeypatch.setattr(metrics, "DENSE_DEGREE", 0)
    monkeypatch.setattr(metrics, "BAND", 16)
    assert score() == want


def test_pairs_of_a_task_are_bounded(spark, monkeypatch):
    """Layers are built by a number of tasks that grows with the pairs; the edges stay the same."""
    r = random.Random(3)
    rows = spark.createDataFrame([(i, r.randrange(12)) for i in range(40) for _ in range(r.randrange(1, 5))], "i long, x long")
    links = spark.createDataFrame([(i, i + 1) for i in range(39)], "i long, j long")
    made = lambda: [sorted(map(tuple, e.collect())) for e in (graph.coauthor_layer(rows, "i", "x"), graph.related_layer(rows, links, "i", "x", "i", "j"))]
    want = made()
    monkeypatch.setattr(graph, "PAIRS_PER_TASK", 10)
    asked = graph._tasks(rows)
    assert asked == max(spark.sparkContext.defaultParallelism, -(-sum(c["count"] ** 2 for c in rows.groupBy("i").count().collect()) // 10))
    assert made() == want
