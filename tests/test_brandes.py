"""Betweenness by packs of components in tasks: no DataFrame rounds where a component fits, and the same turn ends it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import brandes, metrics, paths

from .test_paths import make, random_edges, scores


def pieces(line=90):
    """A dense part, a line and a pair, and a node alone."""
    return random_edges(2, 25, 0.4) + [(100 + i, 101 + i, 1) for i in range(line)] + [(300, 301, 1)], [50]


@pytest.mark.parametrize("cells", [2_000_000, 300])
def test_components_are_solved_in_tasks(spark, monkeypatch, cells):
    edges, alone = pieces()
    g = make(spark, edges, nodes=alone)
    exact = scores(metrics.betweenness(g))
    monkeypatch.setattr(paths, "_credits", None)  # the rounds
    monkeypatch.setattr(brandes, "CELLS", cells)
    monkeypatch.setattr(brandes, "PACK", 100)
    monkeypatch.setattr(brandes, "PIECE", 64)
    assert scores(paths.betweenness_pivots(g)) == exact


def test_components_too_large_for_a_task_go_through_rounds(spark, monkeypatch):
    edges, alone = pieces(6)
    g = make(spark, edges, nodes=alone)
    exact = scores(metrics.betweenness(g))
    monkeypatch.setattr(brandes, "PART_BYTES", 40)  # the line fits, the dense part does not
    assert scores(paths.betweenness_pivots(g, batch_rows=600)) == exact


def test_waves_end_at_the_first_turn_that_is_good_enough(spark, monkeypatch):
    edges, n = random_edges(3, 90, 0.08), 90
    g = make(spark, edges, nodes=range(n))
    monkeypatch.setattr(paths, "_credits", None)
    turn = {r["id"]: r["t"] for r in g.nodes.select("id", F.pmod(F.xxhash64("id", F.lit(42)), F.lit(9)).alias("t")).collect()}
    matrix = np.zeros((n, n), bool)
    for a, b, *_ in edges:
        matrix[a, b] = matrix[b, a] = True
    bits = np.packbits(matrix, axis=1, bitorder="little")
    some, ratio, score = [], [], []
    for t in range(9):  # turn after turn
        some += [i for i in range(n) if turn[i] == t]
        c = brandes.credits(np.zeros(0, np.int64), bits, n, np.array(some))
        error = np.sqrt(c.var(axis=1, ddof=1) / len(some) * (1 - len(some) / n))
        ratio.append(error.max() / c.mean(axis=1).max())
        score.append(c.mean(axis=1) * n / (n - 1) / (n - 2))
    limit = min(ratio[:5]) * 1.001
    t = next(k for k in range(9) if ratio[k] <= limit)
    assert 0 < t < 5
    got = scores(paths.betweenness_pivots(g, error=limit, least_pivots=10))
    assert [got[i] for i in range(n)] == pytest.approx(score[t], abs=2e-6)


def test_robustness_collects_no_graph(spark, tmp_path, monkeypatch):
    """Neither betweenness nor greedy modularity brings edges or nodes to the driver."""
    from corpusloom.operators import community
    from corpusloom.plans import network

    rows = [(k, x) for k, (a, b, *_) in enumerate(random_edges(5, 30, 0.3)) for x in (a, b)]
    spark.createDataFrame(rows, "l_orderkey long, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    expected = sorted(map(tuple, network.robustness_default(spark, str(tmp_path)).collect()))
    monkeypatch.setattr(community, "_local", None)
    monkeypatch.setattr(metrics, "_adjacency", None)
    monkeypatch.setattr(community.greedy_modularity, "__defaults__", (5, *community.greedy_modularity.__defaults__[1:]))
    assert sorted(map(tuple, network.robustness_default(spark, str(tmp_path)).collect())) == expected
