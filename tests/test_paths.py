"""Triangles by blocks, sketched distances, bounded diameters and sampled betweenness against plain Python."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import blocks, metrics, paths, triangles

from .test_graph import make, scores


def random_edges(seed, n, p, weights=False):
    rng = np.random.default_rng(seed)
    return [(a, b, int(rng.integers(1, 9)) if weights else 1) for a in range(n) for b in range(a + 1, n) if rng.random() < p]


def neighbours(edges, nodes=()):
    near = {i: {} for i in nodes}
    for a, b, w in edges:
        near.setdefault(a, {})[b] = w
        near.setdefault(b, {})[a] = w
    return near


def plain_clustering(near, weighted):
    top = max((w for x in near.values() for w in x.values()), default=1)
    out = {}
    for u, x in near.items():
        s = 0.0
        for a in x:
            for b in x:
                if a < b and b in near[a]:
                    s += (x[a] * x[b] * near[a][b] / top**3) ** (1 / 3) if weighted else 1
        d = len(x)
        out[u] = round(2 * s / (d * (d - 1)), 6) if d > 1 else 0.0
    return out


@pytest.mark.parametrize("ranges", [1, 2, 5])
@pytest.mark.parametrize("weighted", [False, True])
def test_clustering_by_blocks(spark, ranges, weighted):
    edges = random_edges(ranges, 40, 0.3, True) + [(100, i, 3) for i in range(40)] + [(200, 201, 1)]
    g = make(spark, edges, nodes=[300])
    assert scores(metrics.local_clustering(g, weighted, ranges)) == plain_clustering(neighbours(edges, [300]), weighted)
    got = {r["id"]: r["triangles"] for r in metrics.triangles(g).collect()}
    near = neighbours(edges)
    want = {u: sum(a < b and b in near[a] for a in x for b in x) for u, x in near.items()}
    assert got == {u: k for u, k in want.items() if k}


def test_clustering_without_edges(spark):
    g = make(spark, [(1, 2)])
    empty = metrics.Graph(g.nodes, g.edges.limit(0))
    assert scores(metrics.local_clustering(empty)) == {1: 0.0, 2: 0.0} == scores(metrics.local_clustering(empty, weighted=True))


@pytest.mark.parametrize("dense, columns", [(2048, 8192), (2, 8192), (2, 16)])
def test_corners_in_pieces(monkeypatch, dense, columns):
    monkeypatch.setattr(triangles, "DENSE", dense)
    monkeypatch.setattr(triangles, "COLUMNS", columns)
    monkeypatch.setattr(triangles, "PAIRS", 40)
    rng = np.random.default_rng(columns)
    a = np.triu(rng.random((70, 70)) < 0.3, 1) * rng.random((70, 70))
    u, v = np.nonzero(a)
    block = (u, v, a[u, v])
    for weighted in (False, True):
        total = np.zeros(70)
        for n, s in triangles.corner_sums(block, block, block, weighted):
            np.add.at(total, n, s)
        m = a + a.T if weighted else ((a + a.T) > 0).astype(float)
        assert np.allclose(total, np.diag(m @ m @ m) / 2)


def all_distances(near):
    out = {}
    for s in near:
        seen, todo = {s: 0}, collections.deque([s])
        while todo:
            u = todo.popleft()
            for v in near[u]:
                if v not in seen:
                    seen[v] = seen[u] + 1
                    todo.append(v)
        out[s] = seen
    return out


def test_balls_of_a_small_graph(spark):
    edges = random_edges(4, 60, 0.05) + [(70, 71, 1)]
    g = make(spark, edges, nodes=[99])
    far = all_distances(neighbours(edges, [99]))
    for r in paths.hyperball(g).collect():
        assert r["reached"] == pytest.approx(len(far[r["id"]]) - 1, abs=0.01) and r["total"] == pytest.approx(sum(far[r["id"]].values()), abs=0.1)
    exact = scores(metrics.closeness(g))
    assert {i: round(x, 3) for i, x in scores(paths.closeness_estimate(g)).items()} == {i: round(x, 3) for i, x in exact.items()}
    want = metrics.path_stats(g).first()["avg_path"]
    assert paths.average_path_estimate(g).first()[0] == pytest.approx(want, rel=1e-3)


def test_balls_within_the_stated_error(spark):
    """A circle with chords of 3,000 nodes and counters of 64 registers: the errors are as large as stated."""
    rng = np.random.default_rng(6)
    n = 3000
    edges = {(i, (i + 1) % n) for i in range(n)} | {tuple(x) for x in rng.integers(0, n, (n, 2)).tolist() if x[0] != x[1]}
    edges = sorted({(min(e), max(e), 1) for e in edges})
    g = make(spark, edges)
    far = all_distances(neighbours(edges))
    lg_k = 6
    got = {r["id"]: (r["reached"], r["total"]) for r in paths.hyperball(g, lg_k).collect()}
    off = np.array([got[i][0] / (n - 1) - 1 for i in got])
    assert np.abs(off).max() < 4 * paths.relative_error(lg_k)
    total = np.array([got[i][1] / sum(far[i].values()) - 1 for i in got])
    assert np.sqrt((total**2).mean()) < 2 * paths.relative_error(lg_k)
    mean = np.mean([d for x in far.values() for d in x.values() if d])
    assert paths.average_path_estimate(g, lg_k=12).first()[0] == pytest.approx(mean, rel=0.03)


@pytest.mark.parametrize(
    "edges",
    [
        [(i, i + 1, 1) for i in range(5)],
        [(i, (i + 1) % 7, 1) for i in range(7)],
        [(0, i, 1) for i in range(1, 6)],
        [(0, 1, 1), (1, 2, 1), (2, 3, 1), (2, 4, 1), (4, 5, 1), (5, 6, 1), (1, 7, 1), (7, 8, 1)],
    ],
)
def test_diameter(spark, edges):
    assert paths.diameter(make(spark, edges)) == max(max(x.values()) for x in all_distances(neighbours(edges)).values())


def test_diameter_of_random_graphs(spark, monkeypatch):
    monkeypatch.setattr(paths, "FRINGE", 3)
    for seed in range(2):
        edges = [(i, int(np.random.default_rng(seed * 100 + i).integers(0, i)), 1) for i in range(1, 25)]  # a random tree
        g = make(spark, [(min(e[:2]), max(e[:2]), 1) for e in edges])
        assert paths.diameter(g) == max(max(x.values()) for x in all_distances(neighbours(edges)).values())
    lone = make(spark, [(1, 2)])
    assert paths.diameter(metrics.Graph(lone.nodes, lone.edges.limit(0))) == 0


def test_betweenness_in_rounds(spark):
    edges = random_edges(2, 25, 0.12) + [(40, 41, 1), (41, 42, 1)]
    g = make(spark, edges, nodes=[50])
    exact = scores(metrics.betweenness(g))
    for rows in (10**6, 300):  # one batch, and some
        got = paths.betweenness_pivots(g, batch_rows=rows).collect()
        assert {r["id"]: round(r["score"], 6) for r in got} == exact and all(r["std_error"] < 1e-9 for r in got)
    empty = metrics.Graph(g.nodes, g.edges.limit(0))
    assert set(scores(paths.betweenness_pivots(empty)).values()) == {0.0}


def test_betweenness_stops_within_its_error(spark):
    edges = random_edges(3, 150, 0.04)
    g = make(spark, edges)
    exact = scores(metrics.betweenness(g))
    got = {r["id"]: (r["score"], r["std_error"]) for r in paths.betweenness_pivots(g, error=0.3, least_pivots=40).collect()}
    top = max(s for s, _ in got.values())
    assert 0 < max(e for _, e in got.values()) <= 0.3 * top
    most = max(e for _, e in got.values())  # a node that few pivots meet knows little of its own spread
    assert all(abs(got[i][0] - exact[i]) <= 3.5 * most for i in exact)
    assert sum(s for s, _ in got.values()) == pytest.approx(sum(exact.values()), rel=0.1)
    assert np.mean([abs(got[i][0] - exact[i]) <= 3 * got[i][1] + 1e-9 for i in exact]) > 0.8


def test_distances_are_never_cut_unasked(spark):
    line = make(spark, [(i, i + 1) for i in range(8)])
    assert metrics.distances(line, line.nodes.where("id = 0")).agg(F.max("dist")).first()[0] == 8
    assert metrics.distances(line, line.nodes.where("id = 0"), max_depth=4).agg(F.max("dist")).first()[0] == 4


def test_balls_of_components_in_ranges(spark, monkeypatch):
    """Rows in several ranges and registers in several columns: components are counted exactly, a sketch never leaves its own."""
    monkeypatch.setattr(blocks, "SMALL", 16)
    monkeypatch.setattr(blocks, "COLUMN_BYTES", 64)
    edges = random_edges(7, 700, 0.006) + [(1000 + i, 1001 + i, 1) for i in range(12)] + [(2000, 2001, 1)]
    edges = [(min(a, b), max(a, b), w) for a, b, w in edges]
    g = make(spark, edges, nodes=[3000])
    far = all_distances(neighbours(edges, [3000]))
    got = {r["id"]: (r["reached"], r["total"]) for r in paths.hyperball(g, 7).collect()}
    assert {i: x for i, (x, _) in got.items()} == {i: len(x) - 1 for i, x in far.items()}
    assert got[3000] == (0, 0) and got[2000] == (1, 1)
    off = np.array([got[i][1] / sum(far[i].values()) - 1 for i in far if len(far[i]) > 2])
    assert np.sqrt((off**2).mean()) < paths.relative_error(7)


@pytest.mark.parametrize("wedges", [1 << 20, 50])
def test_corners_by_wedges(monkeypatch, wedges):
    monkeypatch.setattr(triangles, "WEDGE_COST", 0)
    monkeypatch.setattr(triangles, "WEDGES", wedges)
    rng = np.random.default_rng(wedges)
    a = np.triu(rng.random((70, 70)) < 0.3, 1) * rng.random((70, 70))
    a[0, 1:] = 0.5  # a hub
    u, v = np.nonzero(a)
    block = (u, v, a[u, v])
    for weighted in (False, True):
        total = np.zeros(70)
        for n, s in triangles.corner_sums(block, block, block, weighted):
            np.add.at(total, n, s)
        m = a + a.T if weighted else ((a + a.T) > 0).astype(float)
        assert np.allclose(total, np.diag(m @ m @ m) / 2)
