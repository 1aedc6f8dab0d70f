"""Components too large for one row: their adjacency goes to tasks in pieces."""

import numpy as np
import pytest

from corpusloom.operators import brandes, colours, community, metrics, moves, paths, whole, wide

from .test_brandes import pieces
from .test_components_whole import parted, rows
from .test_paths import make, scores


@pytest.mark.parametrize("span", [1 << 22, 7])
def test_betweenness_of_wide_components_needs_no_rounds(spark, monkeypatch, span):
    edges, alone = pieces(30)
    g = make(spark, edges, nodes=alone)
    exact = scores(metrics.betweenness(g))
    pivots = scores(paths.betweenness_pivots(g, error=0.3, least_pivots=5))
    monkeypatch.setattr(brandes, "PART_BYTES", 40)
    monkeypatch.setattr(wide, "PIECE_EDGES", 50)
    monkeypatch.setattr(wide, "SPAN", span)
    with monkeypatch.context() as m:
        m.setattr(paths, "_credits", None)  # the rounds
        assert scores(paths.betweenness_pivots(g)) == exact
        assert scores(paths.betweenness_pivots(g, error=0.3, least_pivots=5)) == pivots
    monkeypatch.setattr(wide, "WIDE", 100)  # the dense part goes through rounds, the line does not
    assert scores(paths.betweenness_pivots(g, batch_rows=600)) == exact


@pytest.mark.parametrize("span", [1 << 22, 7])
def test_credits_of_a_pivot(monkeypatch, span):
    rng = np.random.default_rng(4)
    monkeypatch.setattr(wide, "SPAN", span)
    for n, p in ((2, 1.0), (30, 0.1), (60, 0.05), (60, 0.4)):
        s, d = np.triu_indices(n, 1)
        keep = (rng.random(len(s)) < p) | (d == s + 1)
        s, d = s[keep], d[keep]
        matrix = np.zeros((n, n), bool)
        matrix[s, d] = matrix[d, s] = True
        expected = brandes.credits(np.zeros(0, np.int64), np.packbits(matrix, axis=1, bitorder="little"), n, np.arange(n))
        graph = wide.Flat.of(s, d, np.ones(len(s)), n)
        assert np.allclose(np.stack([wide.credits(graph, k) for k in range(n)], axis=1), expected)


def test_array_methods_equal_the_loops():
    rng = np.random.default_rng(3)
    first = lambda x: [list(x).index(c) for c in x]
    for trial in range(24):
        n = int(rng.integers(2, 70))
        s, d = np.triu_indices(n, 1)
        keep = (rng.random(len(s)) < (0.05, 0.2, 0.5)[trial % 3]) | (trial % 2 == 1) & (s % 4 == d % 4)
        s, d = s[keep], d[keep]
        w = rng.integers(1, 4, len(s)).astype(float)
        m2 = max(1.0, 2 * w.sum() * (1.5 if trial % 4 else 1))
        ids, adj, flat = list(range(n)), whole.neighbours(s, d, w, n), lambda: wide.Flat.of(s, d, w, n)  # noqa: B023
        for loop, got in (
            (community._levels(ids, adj, 42, 1.0, m2), moves.louvain(flat(), 42, 1.0, m2)),
            (community._leiden(ids, adj, 42, 0.3, True, m2=m2), moves.leiden(flat(), 42, 0.3, True, m2)),
            (community._leiden(ids, adj, 42, 1.0, False, m2=m2), moves.leiden(flat(), 42, 1.0, False, m2)),
            (community._greedy(whole.neighbours(s, d, w, n), m2), moves.greedy(flat(), m2)),
        ):
            assert first([loop[u] for u in ids]) == first(got.tolist())


def test_communities_of_wide_components_need_no_rounds(spark, monkeypatch):
    """The same partitions as of components that fit a row; none is refused for its nodes."""
    g = make(spark, [*parted(5, 2, 16, 0.25), (500, 501, 1)], nodes=[999])
    methods = [lambda: colours.louvain(g, most=most), lambda: colours.leiden(g, resolution=0.3, most=most), lambda: community.greedy_modularity(g, max_edges=5, dense_nodes=8)]
    most = 500
    expected = [rows(m()) for m in methods]
    most = 10
    monkeypatch.setattr(community, "MAX_EDGES", 10)
    monkeypatch.setattr(colours, "_rounds", None)
    monkeypatch.setattr(wide, "PIECE_EDGES", 15)
    assert [rows(m()) for m in methods] == expected
