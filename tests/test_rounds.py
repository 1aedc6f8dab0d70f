"""Communities over colours, random graphs and rewirings, against loops, invariants and planted groups."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import colours, community, metrics, randomize
from corpusloom.operators.graph import Graph
from corpusloom.scratch import Scratch

from .test_graph import connected, make
from .test_paths import neighbours, random_edges


def planted(n, seed, inside=0.8, across=0.04):
    rng = random.Random(seed)
    return [(a, b, rng.randint(1, 2)) for a in range(n) for b in range(a + 1, n) if rng.random() < (inside if a % 3 == b % 3 else across)]


def test_colouring_is_proper(spark):
    edges = random_edges(5, 40, 0.15)
    g = make(spark, edges, nodes=[77])
    got, n = colours.colour(g.nodes, g.both(), Scratch(spark, "test"), 3)
    c = {r["id"]: r["colour"] for r in got.collect()}
    near = neighbours(edges, [77])
    assert all(c[a] != c[b] for a, b, _ in edges) and set(c.values()) == set(range(n)) and n <= 1 + max(map(len, near.values()))
    cut, m = colours.colour(g.nodes, g.both(), Scratch(spark, "test"), 3, max_rounds=1)
    c = {r["id"]: r["colour"] for r in cut.collect()}
    assert all(c[a] != c[b] for a, b, _ in edges if c[a] < m) and max(c.values()) >= m


def test_labels_equal_a_plain_loop(spark):
    edges = random_edges(8, 18, 0.12, True)
    g = make(spark, edges, nodes=[50])
    seed = 5
    classes, _ = colours.colour(g.nodes, g.both(), Scratch(spark, "test"), seed)
    order = [r["id"] for r in classes.orderBy("colour", "id").collect()]
    pairs = spark.createDataFrame([(i, k) for i in order for k in range(12)], "id long, k int")
    h = {(r["id"], r["k"]): r["h"] for r in pairs.withColumn("h", F.xxhash64("id", F.lit(seed), "k")).collect()}
    near, label = neighbours(edges, [50]), {i: i for i in order}
    for k in range(12):
        before = dict(label)
        for u in order:
            votes = collections.Counter()
            for v, w in near[u].items():
                votes[label[v]] += w
            if votes:
                label[u] = min(votes, key=lambda x: (-votes[x], x != label[u], h[x, k]))
        if label == before:
            break
    assert {r["id"]: r["cluster"] for r in colours.label_propagation(g, seed).collect()} == label


@pytest.mark.parametrize("method", ["louvain", "leiden", "potts"])
def test_planted_groups(spark, monkeypatch, method):
    monkeypatch.setattr(colours, "MAX_ROUNDS", 2)
    monkeypatch.setattr(colours, "REST", 1)
    edges = planted(15, 2, 0.9)
    g = make(spark, edges, nodes=[90])
    if method == "louvain":
        p = colours.louvain(g)
    elif method == "leiden":
        p = colours.leiden(g, objective="modularity")
    else:
        p = colours.leiden(g, resolution=0.4)
    got = {r["id"]: r["cluster"] for r in p.collect()}
    assert all(got[a] == got[a % 3] for a in range(15)) and len(set(got.values())) == 4 and got[90] == 3
    groups = collections.defaultdict(set)
    for u, c in got.items():
        groups[c].add(u)
    near = neighbours(edges, [90])
    assert all(connected(x, near) for x in groups.values())
    if method != "potts":
        mine = metrics.modularity(g, spark.createDataFrame(list(got.items()), "id long, cluster int")).first()[0]
        assert mine >= 0.99 * metrics.modularity(g, community.louvain(g, 1)).first()[0]


def test_communities_of_nothing(spark):
    g = make(spark, [(1, 2)])
    none = Graph(g.nodes, g.edges.limit(0))
    assert sorted(map(tuple, colours.louvain(none).collect())) == [(1, 0), (2, 1)]
    assert sorted(map(tuple, colours.leiden(none).collect())) == [(1, 0), (2, 1)]


def test_rewiring_keeps_degrees(spark):
    edges = random_edges(3, 60, 0.1)
    g = make(spark, edges)
    e, done = randomize.rewire(g, 7, swaps_per_edge=2)
    new = {(r["src"], r["dst"]) for r in e.collect()}
    assert done >= 2 * len(edges) and len(new) == len(edges) == e.count() and all(a < b for a, b in new)
    degree = lambda es: collections.Counter(x for a, b in es for x in (a, b))
    old = {(a, b) for a, b, _ in edges}
    assert degree(new) == degree(old) and len(new & old) < 0.5 * len(old)
    again, _ = randomize.rewire(g, 7, swaps_per_edge=2)
    assert {(r["src"], r["dst"]) for r in again.collect()} == new


def test_graphs_that_cannot_swap(spark):
    for edges in ([(0, 1)], [(a, b) for a in range(4) for b in range(a + 1, 4)], [(0, i) for i in range(1, 5)]):
        e, done = randomize.rewire(make(spark, edges), 1, swaps_per_edge=1)
        assert done == 0 and {(r["src"], r["dst"]) for r in e.collect()} == set(edges)


def test_numbers_of_pairs():
    k = np.concatenate([np.arange(3000), [j * (j - 1) // 2 + d for j in (94_906_266, 3 * 10**8) for d in (-1, 0, 1)]])
    i, j = randomize.pair_of(k)
    assert (i >= 0).all() and (i < j).all() and (j * (j - 1) // 2 + i == k).all()
    rng = np.random.default_rng(1)
    assert list(randomize.skips(rng, 5, 10, 1.0)) == [5, 6, 7, 8, 9] and not len(randomize.skips(rng, 5, 10, 0.0))
    hits = np.concatenate([randomize.skips(np.random.default_rng(s), 0, 1000, 0.05) for s in range(400)])
    assert abs(np.bincount(hits, minlength=1000).mean() - 20) < 1 and np.bincount(hits, minlength=1000).max() < 50


def test_random_graph(spark, monkeypatch):
    monkeypatch.setattr(randomize, "PART_EDGES", 50)
    monkeypatch.setattr(randomize, "NODES_A_BUCKET", 7)
    edges = random_edges(1, 80, 0.2)
    names = spark.createDataFrame([(f"n{i}",) for i in range(80)], "id string")
    e = spark.createDataFrame([(f"n{a}", f"n{b}", w) for a, b, w in edges], "src string, dst string, weight long")
    x = randomize.random_graph(Graph(names, e.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight")), 4).edges
    rows = [tuple(r) for r in x.collect()]
    assert len(rows) == len(set(rows)) and all(a < b and w == 1 for a, b, w in rows)
    assert abs(len(rows) - len(edges)) < 4 * len(edges) ** 0.5
    assert community.small_world(make(spark, edges), 1).count() == 1


def test_rewiring_in_blocks(spark, monkeypatch):
    """Edges in blocks of node groups: two rounds make two swaps an edge, however dense the graph is."""
    monkeypatch.setattr(randomize, "BLOCK_EDGES", 100)
    rng = np.random.default_rng(3)
    old = {(a, b) for a in range(60) for b in range(a + 1, 60) if rng.random() < 0.5}
    rounds = []
    save = randomize.Scratch.save
    monkeypatch.setattr(randomize.Scratch, "save", lambda self, df, table, **o: rounds.append(table) or save(self, df, table, **o))
    e, done = randomize.rewire(make(spark, sorted(old)), 5, swaps_per_edge=2)
    new = {(r["src"], r["dst"]) for r in e.collect()}
    degree = lambda es: collections.Counter(x for x2 in es for x in x2)
    assert degree(new) == degree(old) and len(new) == len(old) == e.count() and all(a < b for a, b in new)
    assert done >= 2 * len(old) and len(rounds) <= 5
    assert 0.3 < len(new & old) / len(old) < 0.7  # half of all pairs are edges
