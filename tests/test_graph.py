"""Graphs with known answers, hazards of building them, and invariants of seeded algorithms."""

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import community, graph, metrics, randomize
from corpusloom.operators.components import connected_components
from corpusloom.operators.graph import Graph


def make(spark, edges, nodes=None):
    ids = sorted({x for e in edges for x in e[:2]} | set(nodes or ()))
    rows = [(min(a, b), max(a, b), w[0] if w else 1) for a, b, *w in edges]
    return Graph(spark.createDataFrame([(i,) for i in ids], "id long"), spark.createDataFrame(rows, "src long, dst long, weight long"))


@pytest.fixture(scope="module")
def p4(spark):
    return make(spark, [(1, 2), (2, 3), (3, 4)])


@pytest.fixture(scope="module")
def star(spark):
    return make(spark, [(1, i) for i in range(2, 7)])


@pytest.fixture(scope="module")
def k4(spark):
    return make(spark, [(a, b) for a in range(1, 5) for b in range(a + 1, 5)])


@pytest.fixture(scope="module")
def tail(spark):
    return make(spark, [(1, 2), (2, 3), (1, 3), (3, 4)], nodes=[9])


def scores(df):
    return {r["id"]: round(r["score"], 6) for r in df.collect()}


def test_betweenness(p4, star):
    assert scores(metrics.betweenness(p4)) == {1: 0.0, 2: 0.666667, 3: 0.666667, 4: 0.0}
    assert scores(metrics.betweenness(star))[1] == 1.0
    with pytest.raises(ValueError):
        metrics.betweenness(star, max_nodes=3)


def test_closeness(p4, tail):
    assert scores(metrics.closeness(p4)) == {1: 0.5, 2: 0.75, 3: 0.75, 4: 0.5}
    got = scores(metrics.closeness(tail))
    assert got[9] == 0.0 and got[3] == round(3 / 3 * 3 / 4, 6)


def test_paths(p4, star, k4):
    for g, want in ((p4, (1.666667, 3)), (star, (1.666667, 2)), (k4, (1.0, 1))):
        r = metrics.path_stats(g).first()
        assert (round(r["avg_path"], 6), r["diameter"]) == want


def test_degree_and_stats(star, tail):
    assert scores(metrics.degree_centrality(star))[1] == 1.0
    r = metrics.global_stats(tail).first()
    assert (r["n_nodes"], r["n_edges"], r["isolated"], r["density"]) == (5, 4, 1, 0.4)


def test_eigenvector(k4, spark):
    assert set(scores(metrics.eigenvector(k4)).values()) == {0.5}


def test_clustering(k4, tail, spark):
    assert set(scores(metrics.local_clustering(k4)).values()) == {1.0}
    assert scores(metrics.local_clustering(tail)) == {1: 1.0, 2: 1.0, 3: 0.333333, 4: 0.0, 9: 0.0}
    w = make(spark, [(1, 2, 8), (2, 3, 1), (1, 3, 8)])
    assert scores(metrics.local_clustering(w, weighted=True))[1] == 0.5


def test_assortativity_needs_variance(k4, star):
    assert metrics.degree_assortativity(k4).first()["r"] is None
    assert round(metrics.degree_assortativity(star).first()["r"], 6) == -1.0


def test_modularity(spark):
    g = make(spark, [(1, 2), (2, 3), (1, 3), (4, 5), (5, 6), (4, 6), (3, 4)])
    part = g.nodes.withColumn("cluster", (F.col("id") > 3).cast("int"))
    assert round(metrics.modularity(g, part).first()[0], 6) == 0.357143
    for found in (community.louvain(g, 1), community.leiden(g, 1, objective="modularity"), community.greedy_modularity(g)):
        assert len({tuple(sorted(r["ids"])) for r in found.groupBy("cluster").agg(F.collect_list("id").alias("ids")).collect()} ^ {(1, 2, 3), (4, 5, 6)}) == 0
    assert community.label_propagation(g).count() == 6


def test_seeds_give_one_result(k4, tail):
    assert community.louvain(tail, 3).collect() == community.louvain(tail, 3).collect()
    n = community.null_model(tail, 5)
    assert n.count() == 4 and n.collect() == community.null_model(tail, 5).collect()
    assert community.small_world(tail, 1).count() == 1


def test_components(spark):
    e = spark.createDataFrame([(5, 1), (1, 9), (7, 8), (3, 3), (None, 2)] + [(i, i + 1) for i in range(100, 160)], "src long, dst long")
    got = {r["id"]: r["component"] for r in connected_components(e).collect()}
    assert got[5] == got[9] == 1 and got[8] == 7 and got[3] == 3 and got[160] == 100 and 2 not in got
    assert connected_components(e.limit(0)).count() == 0


def test_largest_component_tie(spark):
    g = make(spark, [(7, 8), (2, 3)])
    assert [r["id"] for r in g.largest_component().nodes.orderBy("id").collect()] == [2, 3]


def test_layers_count_as_they_should(spark):
    """Co-authors count once an item; related authors count every time, links back and loops too."""
    b = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "c"), (2, "a"), (3, None)], "i long, x string")
    assert [tuple(r) for r in graph.coauthor_layer(b, "i", "x").orderBy("src", "dst").collect()] == [("a", "b", 1), ("a", "c", 1)]
    r = spark.createDataFrame([(1, 2), (1, 2), (2, 1), (1, 1), (1, 77)], "i long, j long")
    got = {(x["src"], x["dst"]): x["weight"] for x in graph.related_layer(b, r, "i", "x", "i", "j").collect()}
    pairs = {("a", "b"): 0, ("a", "c"): 0, ("b", "c"): 0}
    authors = {1: ["a", "a", "b"], 2: ["c", "a"]}
    for s, t in [(1, 2), (1, 2), (2, 1), (1, 1)]:
        for x in authors[s]:
            for y in authors[t]:
                if x != y:
                    pairs[tuple(sorted((x, y)))] += 1
    assert got == pairs


def test_union_rejects_other_modes(k4):
    with pytest.raises(ValueError):
        graph.union_layers({"a": k4.edges}, "mean")


def test_isolates_vanish_only_where_they_should(tail):
    assert tail.binarised().nodes.count() == 4 and tail.heavier(0).nodes.count() == 4 and tail.nodes.count() == 5


def test_upper_median(spark):
    d = spark.createDataFrame([(1,), (2,), (3,), (10,)], "degree long")
    assert metrics.upper_median(d, "degree").first()[0] == 3


def test_percent_change(spark):
    d = spark.createDataFrame([(0.0, 5.0), (4.0, 5.0), (None, 1.0), (1.0, None)], "a double, b double")
    x, p = metrics.percent_change(F.col("a"), F.col("b"))
    assert [tuple(r) for r in d.select(x, p).collect()] == [(5.0, 0.0), (1.0, 25.0), (None, None), (None, None)]


def test_robustness(star):
    drop = star.nodes.where("id = 1")
    got = {r["metric"]: (r["before"], r["after"]) for r in community.robustness(star, drop, ["nodes", "edges", "components", "largest", "avg_path", "clustering"]).collect()}
    assert got["edges"] == (5.0, 0.0) and got["components"] == (1.0, 5.0) and got["largest"] == (6.0, 1.0)


def connected(nodes, adj):
    todo, seen = [min(nodes)], {min(nodes)}
    while todo:
        for v in adj.get(todo.pop(), ()):
            if v in nodes and v not in seen:
                seen.add(v)
                todo.append(v)
    return seen == set(nodes)


def partitions(items):
    if not items:
        yield []
        return
    for rest in partitions(items[1:]):
        for k in range(len(rest)):
            yield rest[:k] + [rest[k] + [items[0]]] + rest[k + 1 :]
        yield rest + [[items[0]]]


def potts(groups, edges, gamma=1.0):
    where = {x: k for k, g in enumerate(groups) for x in g}
    return sum(w for (a, b), w in edges.items() if where[a] == where[b]) - gamma * sum(len(g) * (len(g) - 1) / 2 for g in groups)


def test_leiden_against_brute_force():
    import random

    rng = random.Random(3)
    exact = 0
    for trial in range(25):
        n = rng.randint(3, 7)
        edges = {(a, b): rng.choice((1.0, 1.0, 2.0)) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5}
        adj = {i: {} for i in range(n)}
        for (a, b), w in edges.items():
            adj[a][b] = adj[b][a] = w
        for gamma in (0.3, 1.0):
            best = max(potts(p, edges, gamma) for p in partitions(list(range(n))))
            scores = []
            for seed in range(6):
                got = community._leiden(list(range(n)), adj, seed, gamma, True)
                groups = [[u for u in got if got[u] == c] for c in set(got.values())]
                assert all(connected(set(g), adj) for g in groups)
                scores.append(potts(groups, edges, gamma))
            assert max(scores) >= 0.95 * best and min(scores) >= -1e-9, (trial, gamma)
            exact += max(scores) > best - 1e-9
    assert exact >= 47  # of 50: a heuristic


def test_leiden_finds_planted_groups():
    import random

    rng = random.Random(1)
    n = 60
    adj = {i: {} for i in range(n)}
    for a in range(n):
        for b in range(a + 1, n):
            if rng.random() < (0.6 if a % 3 == b % 3 else 0.02):
                adj[a][b] = adj[b][a] = 1.0
    for potts_model, gamma in ((True, 0.25), (False, 1.0)):
        got = community._leiden(list(range(n)), adj, 42, gamma, potts_model)
        assert len(set(got.values())) == 3 and all(got[a] == got[a % 3] for a in range(n))


def test_ids_may_be_texts(spark):
    names = ["Ada", "Bo", "Cy", "Di", "Ed", "Flo", "Gus"]
    edges = [("Ada", "Bo", 1), ("Ada", "Cy", 1), ("Bo", "Cy", 1), ("Di", "Ed", 2), ("Di", "Flo", 2), ("Ed", "Flo", 2), ("Cy", "Di", 1)]
    g = Graph(spark.createDataFrame([(x,) for x in names], "id string"), spark.createDataFrame(edges, "src string, dst string, weight long"))
    got = {r["id"]: r["cluster"] for r in community.label_propagation(g).collect()}
    assert got["Di"] == got["Ed"] == got["Flo"] and got["Ada"] == got["Bo"] == got["Cy"] and got["Gus"] == "Gus"
    assert community.small_world(g, 3).count() == 1 and dict(randomize.random_graph(g, 2).edges.dtypes)["src"] == "string"
    layers = community.null_layers(g, 5, swaps_per_edge=1)
    assert list(layers) == community.NULL_LAYERS and all(e.count() == 7 for e in layers.values())
    assert layers["random_layer_citations"].collect() == community.null_model(g, 106, swaps_per_edge=1).collect()
    assert len({c["cluster"] for c in community.leiden(g, 1).collect()}) >= 3


def test_labels_settle_on_awkward_graphs(spark):
    for edges in ([(0, 1)], [(i, i + 1) for i in range(9)] + [(9, 0)], [(a, b) for a in range(4) for b in range(4, 8)]):
        nodes = sorted({x for e in edges for x in e})
        g = Graph(spark.createDataFrame([(x,) for x in nodes], "id long"), spark.createDataFrame([(*e, 1) for e in edges], "src long, dst long, weight long"))
        got = {r["id"]: r["cluster"] for r in community.label_propagation(g).collect()}
        near = {u: [b if a == u else a for a, b in edges if u in (a, b)] for u in nodes}
        for u in nodes:
            votes = [got[v] for v in near[u]]
            assert votes.count(got[u]) == max(map(votes.count, votes))
