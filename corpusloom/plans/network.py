"""Network queries: orders stand for articles, the parts or suppliers of their lines for authors.

All lines count.  ``related`` is the next order of the same customer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import colours, community, graph, metrics, paths, randomize
from ..operators.graph import Graph
from ..scratch import Scratch
from .registry import query

#: large lines are a layer of their own in ``ha_union_nodes``
HEAVY = 50

# --- the graphs -----------------------------------------------------------------------------


def _t(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def bylines(spark, sf, who: str, least: int = 0) -> DataFrame:
    l = _t(spark, sf, "lineitem")
    if least:
        l = l.where(F.col("l_quantity") >= least)
    return l.select(F.col("l_orderkey").alias("i"), F.col(who).alias("x"))


def related(spark, sf) -> DataFrame:
    nxt = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return _t(spark, sf, "orders").select(F.col("o_orderkey").alias("i"), nxt.alias("j")).where("j is not null")


def network(spark, sf, who: str = "l_suppkey", least: int = 0) -> Graph:
    b = bylines(spark, sf, who, least)
    return Graph(b.select(F.col("x").alias("id")).distinct(), graph.coauthor_layer(b, "i", "x"))


def _stored(g: Graph, name: str) -> Graph:
    """The graph in scratch tables, so that a layer is built once."""
    work = Scratch(g.edges.sparkSession, name)
    return Graph(work.save(g.nodes, "nodes"), work.save(g.edges, "edges"))


def related_network(spark, sf, who: str = "l_suppkey", least: int = 0) -> Graph:
    b = bylines(spark, sf, who, least)
    return Graph(b.select(F.col("x").alias("id")).distinct(), graph.related_layer(b, related(spark, sf), "i", "x", "i", "j"))


def m_sql(who="l_suppkey", least=0):
    return f"SELECT l_orderkey AS i, {who} AS x FROM lineitem" + (f" WHERE l_quantity >= {least}" if least else "")


def g_sql(who="l_suppkey", least=0):
    """CTEs ``m`` bylines, ``n`` nodes, ``e`` edges, ``b`` both directions, ``dg`` degrees."""
    return f"""m AS ({m_sql(who, least)}), n AS (SELECT DISTINCT x AS id FROM m), dm AS (SELECT DISTINCT i, x FROM m),
e AS (SELECT p.x AS src, q.x AS dst, count(*) AS weight FROM dm p JOIN dm q ON p.i = q.i AND p.x < q.x GROUP BY ALL),
b AS (SELECT src AS u, dst AS v, weight FROM e UNION ALL SELECT dst, src, weight FROM e),
dg AS (SELECT n.id, count(b.u) AS degree, CAST(COALESCE(sum(b.weight), 0) AS BIGINT) AS strength FROM n LEFT JOIN b ON b.u = n.id GROUP BY n.id)"""


RELATED_SQL = "(SELECT i, j FROM (SELECT o_orderkey AS i, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS j FROM orders) WHERE j IS NOT NULL)"


def r_sql(who="l_suppkey", least=0):
    """CTE ``re``: the related layer's edges (after ``m``)."""
    return f"""re AS (SELECT least(p.x, q.x) AS src, greatest(p.x, q.x) AS dst, count(*) AS weight
FROM m p JOIN {RELATED_SQL} r ON r.i = p.i JOIN m q ON q.i = r.j WHERE p.x <> q.x GROUP BY ALL)"""


REACH = "reach AS (SELECT id, id AS c FROM n UNION SELECT b.v, reach.c FROM reach JOIN b ON b.u = reach.id WHERE reach.c < b.v), comp AS (SELECT id, min(c) AS component FROM reach GROUP BY id)"
LARGEST = "best AS (SELECT component FROM comp GROUP BY component ORDER BY count(*) DESC, component LIMIT 1), lc AS (SELECT id FROM comp JOIN best USING (component))"
BFS = "bfs AS (SELECT id AS source, id, 0 AS dist FROM n UNION SELECT source, b.v, dist + 1 FROM bfs JOIN b ON b.u = bfs.id WHERE dist < 6), d AS (SELECT source, id, min(dist) AS dist FROM bfs GROUP BY ALL)"


# --- building -------------------------------------------------------------------------------


@query("coauthor_topk", f"WITH {g_sql('l_partkey')}, k AS (SELECT id, strength FROM dg ORDER BY strength DESC, id LIMIT 10) SELECT id, strength, CAST(row_number() OVER (ORDER BY strength DESC, id) AS INTEGER) AS rank FROM k")
def coauthor_topk(spark, sf):
    g = network(spark, sf, "l_partkey")
    return graph.top_k(g.degrees().select("id", "strength"), "strength", "id", 10)


@query("d1_coauthor_edges", f"WITH {g_sql('l_partkey')} SELECT * FROM e")
def coauthor_edges(spark, sf):
    return network(spark, sf, "l_partkey").edges


@query("d2_related_edges", f"WITH m AS ({m_sql()}), {r_sql()} SELECT * FROM re")
def related_edges(spark, sf):
    return related_network(spark, sf).edges


@query("d3_article_edges", f"SELECT DISTINCT least(i, j) AS src, greatest(i, j) AS dst, CAST(1 AS BIGINT) AS weight FROM {RELATED_SQL} r JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') a ON a.o_orderkey = r.i JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') c ON c.o_orderkey = r.j WHERE i <> j")
def article_edges(spark, sf):
    return graph.article_edges(related(spark, sf), _t(spark, sf, "orders").where("o_orderstatus = 'F'"), "i", "j", "o_orderkey")


@query("d3_orphan_references", f"SELECT count(*) AS orphan_references FROM {RELATED_SQL} WHERE j NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def orphan_references(spark, sf):
    return graph.orphan_count(related(spark, sf), _t(spark, sf, "orders").where("o_orderstatus = 'F'"), "j", "o_orderkey")


@query("d4_article_nodes", f"SELECT id, id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') AS in_table FROM (SELECT i AS id FROM {RELATED_SQL} UNION SELECT j FROM {RELATED_SQL})")
def article_nodes(spark, sf):
    return graph.article_nodes(related(spark, sf), _t(spark, sf, "orders").where("o_orderstatus = 'F'"), "i", "j", "o_orderkey")


def _layers(spark, sf):
    return network(spark, sf), related_network(spark, sf)


@query("ha_union_nodes", f"WITH m AS ({m_sql()}), k AS (SELECT DISTINCT x AS id, 'coauthor' AS layer FROM m UNION SELECT DISTINCT l_suppkey, 'heavy' FROM lineitem WHERE l_quantity >= 50) SELECT id, string_agg(layer, ',' ORDER BY layer) AS layers FROM k GROUP BY id")
def union_nodes(spark, sf):
    return graph.union_nodes({"coauthor": network(spark, sf).nodes, "heavy": network(spark, sf, least=HEAVY).nodes})


for _how in ("sum", "max"):

    @query(f"hb_union_edges_{_how}", f"WITH {g_sql()}, {r_sql()}, k AS (SELECT *, 'coauthor' AS layer FROM e UNION ALL SELECT *, 'related' FROM re) SELECT src, dst, CAST({_how}(weight) AS BIGINT) AS weight, string_agg(layer, ',' ORDER BY layer) AS layers FROM k GROUP BY src, dst")
    def union_edges(spark, sf, how=_how):
        a, b = _layers(spark, sf)
        return graph.union_layers({"coauthor": a.edges, "related": b.edges}, how)


@query("c9_heavier_edges", f"WITH {g_sql()} SELECT * FROM e WHERE weight > 1")
def heavier_edges(spark, sf):
    return network(spark, sf).heavier(1).edges


@query("c9_heavier_nodes", f"WITH {g_sql()} SELECT src AS id FROM e WHERE weight > 1 UNION SELECT dst FROM e WHERE weight > 1")
def heavier_nodes(spark, sf):
    return network(spark, sf).heavier(1).nodes


@query("e10_degrees", f"WITH {g_sql('l_partkey')} SELECT * FROM dg")
def degrees(spark, sf):
    return network(spark, sf, "l_partkey").degrees()


@query("l19_binarised", f"WITH {g_sql()} SELECT src, dst, CAST(1 AS BIGINT) AS weight FROM e WHERE weight > 0")
def binarised(spark, sf):
    return network(spark, sf).binarised().edges


@query("l23_multilayer", f"WITH {g_sql()}, {r_sql()}, k AS (SELECT *, 'coauthor' AS layer FROM e UNION ALL SELECT *, 'related' FROM re), c AS (SELECT src, dst FROM k GROUP BY ALL) SELECT (SELECT count(*) FROM e) AS coauthor_edges, (SELECT count(*) FROM re) AS related_edges, (SELECT count(*) FROM c) AS combined_edges, (SELECT count(*) FROM n) AS n_nodes")
def multilayer(spark, sf):
    a, b = _layers(spark, sf)
    c = graph.union_layers({"coauthor": a.edges, "related": b.edges})
    one = lambda df, name: df.agg(F.count("*").alias(name))
    return one(a.edges, "coauthor_edges").crossJoin(one(b.edges, "related_edges")).crossJoin(one(c, "combined_edges")).crossJoin(one(a.nodes, "n_nodes"))


@query("l24_degree_profile", f"WITH {g_sql()}, {r_sql()}, c AS (SELECT src, dst FROM e UNION SELECT src, dst FROM re), q AS (SELECT src AS id FROM c UNION ALL SELECT dst FROM c), k AS (SELECT n.id, count(q.id) AS degree FROM n LEFT JOIN q USING (id) GROUP BY n.id) SELECT count(*) AS n_nodes, max(degree) AS max_degree, min(degree) AS min_degree, round(avg(degree), 6) AS avg_degree FROM k")
def degree_profile(spark, sf):
    a, b = _layers(spark, sf)
    g = Graph(a.nodes, graph.union_layers({"coauthor": a.edges, "related": b.edges}).select("src", "dst", F.lit(1).cast("long").alias("weight")))
    return g.degrees().agg(F.count("*").alias("n_nodes"), F.max("degree").alias("max_degree"), F.min("degree").alias("min_degree"), F.round(F.avg("degree"), 6).alias("avg_degree"))


# --- components -----------------------------------------------------------------------------


@query("l1_components", f"WITH RECURSIVE {g_sql('l_partkey')}, {REACH} SELECT * FROM comp")
def components(spark, sf):
    return network(spark, sf, "l_partkey").components()


@query("l2_largest_component", f"WITH RECURSIVE {g_sql('l_partkey')}, {REACH}, {LARGEST} SELECT e.* FROM e JOIN lc a ON a.id = e.src JOIN lc c ON c.id = e.dst")
def largest_component(spark, sf):
    return network(spark, sf, "l_partkey").largest_component().edges


@query("hc_nodes_outside_largest", f"WITH RECURSIVE {g_sql('l_partkey')}, {REACH}, {LARGEST} SELECT id FROM n WHERE id NOT IN (SELECT id FROM lc)")
def outside_largest(spark, sf):
    g = network(spark, sf, "l_partkey")
    return g.nodes.join(g.largest_component().nodes, "id", "left_anti")


@query("c12_highest_degree", f"WITH {g_sql('l_partkey')} SELECT id, degree FROM dg ORDER BY degree DESC, id LIMIT 1")
def highest_degree(spark, sf):
    return network(spark, sf, "l_partkey").degrees().select("id", "degree").orderBy(F.desc("degree"), "id").limit(1)


@query("c12_component_of_node", f"WITH RECURSIVE {g_sql('l_partkey')}, {REACH} SELECT id FROM comp WHERE component = (SELECT component FROM comp JOIN (SELECT id FROM dg ORDER BY degree DESC, id LIMIT 1) USING (id))")
def component_of_node(spark, sf):
    g = network(spark, sf, "l_partkey")
    c = g.components()
    one = g.degrees().orderBy(F.desc("degree"), "id").limit(1).select("id")
    return c.join(c.join(one, "id").select("component"), "component", "left_semi").select("id")


@query("e14_component_sizes", f"WITH RECURSIVE {g_sql('l_partkey')}, {REACH}, s AS (SELECT count(*) AS size FROM comp GROUP BY component) SELECT size, count(*) AS components FROM s GROUP BY size ORDER BY size DESC LIMIT 10")
def component_sizes(spark, sf):
    return metrics.size_summary(network(spark, sf, "l_partkey").components()).orderBy(F.desc("size")).limit(10)


@query("g5_components_with_samples", f"WITH RECURSIVE {g_sql('l_partkey')}, {REACH}, r AS (SELECT component, id, row_number() OVER (PARTITION BY component ORDER BY id) AS k, count(*) OVER (PARTITION BY component) AS size FROM comp) SELECT component, size, string_agg(CAST(id AS VARCHAR), ', ' ORDER BY id) AS sample FROM r WHERE k <= 5 GROUP BY component, size")
def components_with_samples(spark, sf):
    c = network(spark, sf, "l_partkey").components()
    k = F.row_number().over(Window.partitionBy("component").orderBy("id"))
    few = c.withColumn("k", k).where("k <= 5").groupBy("component").agg(F.array_join(F.transform(F.sort_array(F.collect_list("id")), lambda x: x.cast("string")), ", ").alias("sample"))
    return c.groupBy("component").agg(F.count("*").alias("size")).join(few, "component")


# --- measures -------------------------------------------------------------------------------


@query("e22_global_stats", f"WITH {g_sql('l_partkey')} SELECT count(*) AS n_nodes, CAST(sum(degree) / 2 AS BIGINT) AS n_edges, round(sum(degree) / (count(*) * (count(*) - 1)), 9) AS density, CAST(sum(CASE WHEN degree = 0 THEN 1 ELSE 0 END) AS BIGINT) AS isolated, round(sum(degree) / count(*), 9) AS avg_degree FROM dg")
def global_stats(spark, sf):
    return metrics.global_stats(network(spark, sf, "l_partkey"))


@query("e13_degree_histogram", f"WITH {g_sql('l_partkey')} SELECT degree, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM dg), 6) AS percent FROM dg GROUP BY degree ORDER BY degree DESC LIMIT 20")
def degree_histogram(spark, sf):
    d = network(spark, sf, "l_partkey").degrees().groupBy("degree").agg(F.count("*").alias("n"))
    total = d.agg(F.sum("n").alias("t"))
    return d.crossJoin(F.broadcast(total)).select("degree", "n", F.round(100.0 * F.col("n") / F.col("t"), 6).alias("percent")).orderBy(F.desc("degree")).limit(20)


@query("e13_degree_summary", f"WITH {g_sql('l_partkey')}, o AS (SELECT degree, row_number() OVER (ORDER BY degree) AS k, count(*) OVER () AS n FROM dg) SELECT min(degree) AS min_degree, max(degree) AS max_degree, max(degree) FILTER (k = n // 2 + 1) AS median_degree FROM o")
def degree_summary(spark, sf):
    d = network(spark, sf, "l_partkey").degrees()
    return d.agg(F.min("degree").alias("min_degree"), F.max("degree").alias("max_degree")).crossJoin(metrics.upper_median(d, "degree").withColumnRenamed("median", "median_degree"))


@query("e11_activity", f"WITH {g_sql()}, {r_sql()}, q AS (SELECT src AS id FROM e UNION ALL SELECT dst FROM e UNION ALL SELECT src FROM re UNION ALL SELECT dst FROM re), a AS (SELECT n.id, count(q.id) AS activity FROM n LEFT JOIN q USING (id) GROUP BY n.id) SELECT id, activity, round(activity / 2, 6) AS per_layer, round((SELECT avg(activity) FROM a), 6) AS mean_activity FROM a ORDER BY activity DESC, id LIMIT 15")
def activity(spark, sf):
    a, b = _layers(spark, sf)
    d = a.degrees().unionByName(b.degrees()).groupBy("id").agg(F.sum("degree").alias("activity"))
    mean = d.agg(F.round(F.avg("activity"), 6).alias("mean_activity"))
    return d.crossJoin(F.broadcast(mean)).select("id", "activity", F.round(F.col("activity") / 2, 6).alias("per_layer"), "mean_activity").orderBy(F.desc("activity"), "id").limit(15)


@query("l3_degree_centrality", f"WITH {g_sql()} SELECT id, round(degree / ((SELECT count(*) FROM n) - 1), 6) AS score FROM dg")
def degree_centrality(spark, sf):
    return metrics.degree_centrality(network(spark, sf)).select("id", F.round("score", 6).alias("score"))


CLOSENESS = "cl AS (SELECT source AS id, CASE WHEN sum(dist) = 0 THEN 0.0 ELSE (count(*) - 1) / sum(dist) * (count(*) - 1) / ((SELECT count(*) FROM n) - 1) END AS score FROM d GROUP BY source)"


@query("l5_closeness", f"WITH RECURSIVE {g_sql()}, {BFS}, {CLOSENESS} SELECT id, round(score, 6) AS score FROM cl")
def closeness(spark, sf):
    return metrics.closeness(network(spark, sf)).select("id", F.round("score", 6).alias("score"))


@query("l17_path_lengths", f"WITH RECURSIVE {g_sql()}, {REACH}, {LARGEST}, {BFS} SELECT round(avg(dist), 9) AS avg_path, CAST(max(dist) AS BIGINT) AS diameter FROM d JOIN lc ON lc.id = d.source WHERE dist > 0")
def path_lengths(spark, sf):
    return metrics.path_stats(network(spark, sf).largest_component())


@query("l5_closeness_estimate", f"WITH RECURSIVE {g_sql()}, {BFS}, {CLOSENESS} SELECT id, round(score, 3) AS score FROM cl")
def closeness_estimate(spark, sf):
    """From HyperLogLog counters, without a table of pairs; exact while the nodes are no more than a counter's bits."""
    return paths.closeness_estimate(_stored(network(spark, sf), "l5")).select("id", F.round("score", 3).alias("score"))


@query("l17_average_path_estimate", f"WITH RECURSIVE {g_sql()}, {REACH}, {LARGEST}, {BFS} SELECT round(avg(dist), 3) AS avg_path FROM d JOIN lc ON lc.id = d.source WHERE dist > 0")
def average_path_estimate(spark, sf):
    return paths.average_path_estimate(_stored(network(spark, sf), "l17").largest_component()).select(F.round("avg_path", 3).alias("avg_path"))


@query("l18_diameter", f"WITH RECURSIVE {g_sql()}, {REACH}, {LARGEST}, {BFS} SELECT CAST(max(dist) AS BIGINT) AS diameter, count(DISTINCT source) AS n_nodes FROM d JOIN lc ON lc.id = d.source")
def diameter(spark, sf):
    """Exact, by bounds instead of all pairs."""
    g = network(spark, sf).largest_component()
    return g.nodes.agg(F.count("*").alias("n_nodes")).select(F.lit(paths.diameter(g)).cast("long").alias("diameter"), "n_nodes")


def _sigma(levels: int = 5) -> str:
    """CTEs ``p``: shortest paths between pairs, level by level."""
    out = ["p0 AS (SELECT id AS s, id AS t, 0 AS dist, 1.0::DOUBLE AS k FROM n)"]
    for x in range(1, levels + 1):
        out.append(f"p{x} AS (SELECT q.s, b.v AS t, {x} AS dist, sum(q.k) AS k FROM p{x - 1} q JOIN b ON b.u = q.t JOIN d ON d.source = q.s AND d.id = b.v AND d.dist = {x} GROUP BY q.s, b.v)")
    return ", ".join(out) + ", p AS (" + " UNION ALL ".join(f"SELECT * FROM p{x}" for x in range(levels + 1)) + ")"


BETWEEN = f"{_sigma()}, bt AS (SELECT a.t AS id, sum(a.k * c.k / w.k) AS s FROM p a JOIN p c ON c.s = a.t JOIN p w ON w.s = a.s AND w.t = c.t AND w.dist = a.dist + c.dist WHERE a.s <> a.t AND a.t <> c.t AND a.s <> c.t GROUP BY a.t), bw AS (SELECT n.id, COALESCE(bt.s, 0) / (((SELECT count(*) FROM n) - 1) * ((SELECT count(*) FROM n) - 2)) AS score FROM n LEFT JOIN bt USING (id))"


@query("l4_betweenness", f"WITH RECURSIVE {g_sql()}, {BFS}, {BETWEEN} SELECT id, round(score, 6) AS score FROM bw")
def betweenness(spark, sf):
    return metrics.betweenness(_stored(network(spark, sf), "l4"), max_nodes=None).select("id", F.round("score", 6).alias("score"))


@query("l4_betweenness_rounds", f"WITH RECURSIVE {g_sql()}, {BFS}, {BETWEEN} SELECT id, round(score, 6) AS score FROM bw")
def betweenness_rounds(spark, sf):
    """In DataFrame rounds with all nodes as pivots: exact, without an adjacency list in any task."""
    return paths.betweenness_pivots(network(spark, sf)).select("id", F.round("score", 6).alias("score"))


@query("l4_betweenness_pivots")
def betweenness_pivots(spark, sf):
    """From sampled pivots, until the standard errors are within a twentieth of the largest score."""
    return paths.betweenness_pivots(network(spark, sf), error=0.05)


def _power(rounds: int) -> str:
    out = ["y0 AS (SELECT id, 1.0 / (SELECT count(*) FROM n) AS x FROM n)"]
    for k in range(1, rounds + 1):
        out.append(f"z{k} AS (SELECT y.id, y.x + COALESCE(s.s, 0) AS x FROM y{k - 1} y LEFT JOIN (SELECT b.u, sum(w.x) AS s FROM b JOIN y{k - 1} w ON w.id = b.v GROUP BY b.u) s ON s.u = y.id), y{k} AS (SELECT id, x / (SELECT sqrt(sum(x * x)) FROM z{k}) AS x FROM z{k})")
    return ", ".join(out)


@query("l6_eigenvector_10_rounds", f"WITH {g_sql()}, {_power(10)} SELECT id, round(x, 6) AS score FROM y10")
def eigenvector_rounds(spark, sf):
    return metrics.eigenvector(network(spark, sf), fixed=10).select("id", F.round("score", 6).alias("score"))


@query("l6_eigenvector")
def eigenvector(spark, sf):
    """Until it settles (tolerance ``n * 1e-6``); the number of rounds is beyond SQL."""
    return metrics.eigenvector(network(spark, sf))


@query("l7_ranking", f"WITH {g_sql()}, k AS (SELECT id, degree FROM dg ORDER BY degree DESC, id LIMIT 10) SELECT CAST(row_number() OVER (ORDER BY degree DESC, id) AS INTEGER) AS rank, id, round(degree / ((SELECT count(*) FROM n) - 1), 6) AS score, COALESCE(s_name, 'Unknown') AS role FROM k LEFT JOIN supplier ON s_suppkey = id")
def ranking(spark, sf):
    best = graph.top_k(metrics.degree_centrality(network(spark, sf)), "score", "id", 10)
    names = _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("role"))
    return best.join(names, "id", "left").select("rank", "id", F.round("score", 6).alias("score"), F.coalesce("role", F.lit("Unknown")).alias("role"))


TOPS = "tops AS (SELECT * FROM (SELECT id, 'degree' AS m FROM dg ORDER BY degree DESC, id LIMIT 10) UNION ALL SELECT * FROM (SELECT id, 'closeness' FROM (SELECT id, round(score, 9) AS score FROM cl) ORDER BY score DESC, id LIMIT 10) UNION ALL SELECT * FROM (SELECT id, 'betweenness' FROM (SELECT id, round(score, 9) AS score FROM bw) ORDER BY score DESC, id LIMIT 10))"


@query("e12_hub_frequency", f"WITH RECURSIVE {g_sql()}, {BFS}, {CLOSENESS}, {BETWEEN}, {TOPS} SELECT id, count(*) AS measures, CASE WHEN count(*) >= 2 THEN 'hub' ELSE 'specialist' END AS kind FROM tops GROUP BY id")
def hub_frequency(spark, sf):
    g = _stored(network(spark, sf), "e12")  # three measures read it
    tops = [graph.top_k(m.select("id", F.round("score", 9).alias("score")), "score", "id", 10).select("id") for m in (metrics.degree_centrality(g), metrics.closeness(g), metrics.betweenness(g, max_nodes=None))]
    rows = tops[0].unionByName(tops[1]).unionByName(tops[2])
    return rows.groupBy("id").agg(F.count("*").alias("measures")).withColumn("kind", F.when(F.col("measures") >= 2, "hub").otherwise("specialist"))


TRI = "tri AS (SELECT x.src AS a, x.dst AS c, z.dst AS k, x.weight AS w1, y.weight AS w2, z.weight AS w3 FROM e x JOIN e z ON z.src = x.dst JOIN e y ON y.src = x.src AND y.dst = z.dst), corner AS (SELECT a AS id, w1, w2, w3 FROM tri UNION ALL SELECT c, w1, w2, w3 FROM tri UNION ALL SELECT k, w1, w2, w3 FROM tri)"
LOCAL = "loc AS (SELECT dg.id, CASE WHEN degree < 2 THEN 0.0 ELSE count(corner.id) / (degree * (degree - 1) / 2) END AS score FROM dg LEFT JOIN corner USING (id) GROUP BY dg.id, degree)"
WLOCAL = "wloc AS (SELECT dg.id, degree, CASE WHEN degree < 2 THEN 0.0 ELSE 2 * COALESCE(sum(cbrt(w1 / mw * w2 / mw * w3 / mw)), 0) / (degree * (degree - 1)) END AS score FROM dg LEFT JOIN corner USING (id), (SELECT max(weight) AS mw FROM e) GROUP BY dg.id, degree)"


@query("l14_local_clustering", f"WITH {g_sql()}, {TRI}, {WLOCAL} SELECT id, round(score, 6) AS score FROM wloc")
def local_clustering(spark, sf):
    return metrics.local_clustering(network(spark, sf), weighted=True).select("id", F.round("score", 6).alias("score"))


@query("l15_average_clustering", f"WITH {g_sql()}, {TRI}, {LOCAL} SELECT round(avg(score), 6) AS clustering FROM loc")
def average_clustering(spark, sf):
    return metrics.local_clustering(network(spark, sf)).agg(F.round(F.avg("score"), 6).alias("clustering"))


@query("l13_modularity", f"WITH {g_sql()}, w AS (SELECT src % 4 AS cs, dst % 4 AS cd, weight AS w FROM e), t AS (SELECT sum(w) AS m FROM w), k AS (SELECT cs AS c, w FROM w UNION ALL SELECT cd, w FROM w), s AS (SELECT c, sum(w) AS d FROM k GROUP BY c), l AS (SELECT cs AS c, sum(w) AS l FROM w WHERE cs = cd GROUP BY cs) SELECT round(sum(COALESCE(l.l, 0) / m - (d / (2 * m)) ** 2), 6) AS modularity FROM s LEFT JOIN l USING (c), t")
def modularity(spark, sf):
    g = network(spark, sf)
    return metrics.modularity(g, g.nodes.withColumn("cluster", F.col("id") % 4)).select(F.round("modularity", 6).alias("modularity"))


@query("l13_modularity_unweighted", f"WITH {g_sql()}, w AS (SELECT src % 4 AS cs, dst % 4 AS cd, 1 AS w FROM e), t AS (SELECT sum(w) AS m FROM w), k AS (SELECT cs AS c, w FROM w UNION ALL SELECT cd, w FROM w), s AS (SELECT c, sum(w) AS d FROM k GROUP BY c), l AS (SELECT cs AS c, sum(w) AS l FROM w WHERE cs = cd GROUP BY cs) SELECT round(sum(COALESCE(l.l, 0) / m - (d / (2 * m)) ** 2), 6) AS modularity FROM s LEFT JOIN l USING (c), t")
def modularity_unweighted(spark, sf):
    g = network(spark, sf)
    return metrics.modularity(g, g.nodes.withColumn("cluster", F.col("id") % 4), weighted=False).select(F.round("modularity", 6).alias("modularity"))


@query("l16_cluster_profile", f"WITH {g_sql()}, {TRI}, {WLOCAL}, c AS (SELECT id, id % 4 AS cluster, score FROM wloc), i AS (SELECT src % 4 AS cluster, count(*) AS m FROM e WHERE src % 4 = dst % 4 GROUP BY 1) SELECT c.cluster, count(*) AS n, round(avg(score), 6) AS clustering, round(COALESCE(max(i.m), 0) * 2 / (count(*) * (count(*) - 1)), 6) AS density FROM c LEFT JOIN i USING (cluster) GROUP BY c.cluster")
def cluster_profile(spark, sf):
    g = network(spark, sf)
    part = g.nodes.withColumn("cluster", F.col("id") % 4)
    return community.cluster_profile(g, part)


@query("g7_top_degree_per_cluster", f"WITH {g_sql()}, r AS (SELECT id % 4 AS cluster, id, degree, row_number() OVER (PARTITION BY id % 4 ORDER BY degree DESC, id) AS rank FROM dg) SELECT cluster, id, degree, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5")
def top_degree_per_cluster(spark, sf):
    d = network(spark, sf).degrees().withColumn("cluster", F.col("id") % 4)
    return d.withColumn("rank", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("degree"), "id"))).where("rank <= 5").select("cluster", "id", "degree", "rank")


@query("l21_assortativity", f"WITH {g_sql('l_partkey')}, k AS (SELECT p.degree AS x, q.degree AS y, p.strength AS sx, q.strength AS sy FROM b JOIN dg p ON p.id = u JOIN dg q ON q.id = v) SELECT round(corr(x, y), 6) AS by_degree, round(corr(sx, sy), 6) AS by_strength FROM k")
def assortativity(spark, sf):
    g = network(spark, sf, "l_partkey")
    a, b = metrics.degree_assortativity(g), metrics.degree_assortativity(g, weighted=True)
    return a.select(F.round("r", 6).alias("by_degree")).crossJoin(b.select(F.round("r", 6).alias("by_strength")))


@query("l22_layer_correlation", f"WITH {g_sql('l_partkey')}, {r_sql()}, q AS (SELECT src AS id FROM re UNION ALL SELECT dst FROM re), rd AS (SELECT n.id, count(q.id) AS degree FROM n LEFT JOIN q USING (id) GROUP BY n.id) SELECT round(corr(dg.degree, rd.degree), 6) AS r FROM dg JOIN rd USING (id)")
def layer_correlation(spark, sf):
    a, b = network(spark, sf, "l_partkey"), related_network(spark, sf, "l_partkey")
    return metrics.layer_correlation(a.nodes, a, b).select(F.round("r", 6).alias("r"))


@query("l26_hubs", f"WITH RECURSIVE {g_sql()}, {REACH}, {LARGEST}, {BFS}, {CLOSENESS} SELECT id, round(score, 6) AS score FROM (SELECT id, round(score, 9) AS score FROM cl JOIN lc USING (id)) ORDER BY score DESC, id LIMIT 5")
def hubs(spark, sf):
    c = metrics.closeness(network(spark, sf).largest_component()).select("id", F.round("score", 9).alias("score"))
    return graph.top_k(c, "score", "id", 5).select("id", F.round("score", 6).alias("score"))


ROBUST = "t AS (SELECT id FROM dg ORDER BY degree DESC, id LIMIT 3), a2 AS (SELECT * FROM e WHERE src NOT IN (SELECT id FROM t) AND dst NOT IN (SELECT id FROM t))"


@query("l27_robustness", f"WITH {g_sql()}, {ROBUST}, k AS (SELECT 'edges' AS metric, CAST((SELECT count(*) FROM e) AS DOUBLE) AS before, CAST((SELECT count(*) FROM a2) AS DOUBLE) AS after UNION ALL SELECT 'nodes', (SELECT count(*) FROM n), (SELECT count(*) FROM n) - 3 UNION ALL SELECT 'avg_degree', 2.0 * (SELECT count(*) FROM e) / (SELECT count(*) FROM n), 2.0 * (SELECT count(*) FROM a2) / ((SELECT count(*) FROM n) - 3)) SELECT metric, round(before, 6) AS before, round(after, 6) AS after, round(after - before, 6) AS change, round((after - before) / before * 100, 6) AS percent FROM k")
def robustness(spark, sf):
    g = network(spark, sf)
    drop = graph.top_k(g.degrees().select("id", "degree"), "degree", "id", 3).select("id")
    return community.robustness(g, drop, ["nodes", "edges", "avg_degree"])


@query("l27_robustness_default")
def robustness_default(spark, sf):
    """The survey's L27: the largest component without its three nodes of highest betweenness."""
    work = Scratch(spark, "l27")
    g = network(spark, sf).largest_component()
    g = Graph(work.save(g.nodes, "nodes"), work.save(g.edges, "edges"))
    one = g.nodes.crossJoin(F.broadcast(g.nodes.agg(F.min("id").alias("component"))))
    drop = work.save(graph.top_k(paths.betweenness_pivots(g, components=one), "score", "id", 3).select("id"), "drop")
    return community.robustness(g, drop, ["nodes", "edges", "components", "largest", "avg_path", "clustering", "modularity", "density", "avg_degree"])


@query("l28_subgraph_centrality", f"WITH {g_sql()}, s AS (SELECT e.* FROM e WHERE src % 4 IN (1, 2) AND dst % 4 IN (1, 2)), q AS (SELECT src AS id FROM s UNION ALL SELECT dst FROM s), k AS (SELECT id FROM n WHERE id % 4 IN (1, 2)) SELECT k.id, round(count(q.id) / ((SELECT count(*) FROM k) - 1), 6) AS score FROM k LEFT JOIN q USING (id) GROUP BY k.id")
def subgraph_centrality(spark, sf):
    g = network(spark, sf)
    return metrics.degree_centrality(g.induced(g.nodes.where("id % 4 in (1, 2)"))).select("id", F.round("score", 6).alias("score"))


@query("l12_partition_extended", f"WITH RECURSIVE {g_sql('l_partkey')}, {REACH}, {LARGEST} SELECT n.id, CASE WHEN lc.id IS NULL THEN -1 ELSE n.id % 3 END AS cluster FROM n LEFT JOIN lc USING (id)")
def partition_extended(spark, sf):
    g = network(spark, sf, "l_partkey")
    part = g.largest_component().nodes.withColumn("cluster", F.col("id") % 3)
    return community.extend(g, part)


@query("g6_largest_clusters", f"WITH {g_sql()}, r AS (SELECT id % 7 AS cluster, id, row_number() OVER (PARTITION BY id % 7 ORDER BY id) AS k, count(*) OVER (PARTITION BY id % 7) AS size FROM n) SELECT cluster, size, string_agg(CAST(id AS VARCHAR), ', ' ORDER BY id) AS sample FROM r WHERE k <= 3 GROUP BY cluster, size ORDER BY size DESC, cluster LIMIT 10")
def largest_clusters(spark, sf):
    return community.largest_clusters(network(spark, sf).nodes.withColumn("cluster", F.col("id") % 7))


@query("l30_edge_flags", f"WITH {g_sql()} SELECT src, dst, src % 4 = dst % 4 AS intra_cluster, round(CASE WHEN hi = lo THEN 5.0 ELSE 5 + 95.0 * (weight - lo) / (hi - lo) END, 6) AS width FROM e, (SELECT min(weight) AS lo, max(weight) AS hi FROM e)")
def edge_flags(spark, sf):
    g = network(spark, sf)
    return community.drawing_edges(g, g.nodes.withColumn("cluster", F.col("id") % 4))


@query("l30_ring_positions", f"WITH {g_sql()}, p AS (SELECT id, CASE WHEN id % 9 = 0 THEN -1 ELSE id % 4 END AS cluster FROM n), s AS (SELECT cluster, count(*) AS size, row_number() OVER (ORDER BY cluster) - 1 AS place, count(*) OVER () AS c FROM p WHERE cluster >= 0 GROUP BY cluster), k AS (SELECT p.id, p.cluster, row_number() OVER (PARTITION BY cluster ORDER BY id) - 1 AS i FROM p) SELECT k.id, k.cluster, round(CASE WHEN k.cluster < 0 THEN 0 ELSE 100 * cos(2 * pi() * place / c) + least(30, 5 * sqrt(size)) * cos(2 * pi() * i / size) END, 6) AS x, round(CASE WHEN k.cluster < 0 THEN 0 ELSE 100 * sin(2 * pi() * place / c) + least(30, 5 * sqrt(size)) * sin(2 * pi() * i / size) END, 6) AS y FROM k LEFT JOIN s USING (cluster)")
def ring_positions(spark, sf):
    """Where a drawing of clusters starts."""
    part = network(spark, sf).nodes.withColumn("cluster", F.expr("CASE WHEN id % 9 = 0 THEN -1 ELSE id % 4 END"))
    near = lambda c: (F.round(c, 6) + F.lit(0.0)).alias(c)
    return community.ring_positions(part).select("id", "cluster", near("x"), near("y"))


@query("i25_node_sizes", f"WITH {g_sql()} SELECT id, CAST(least(10 + 2 * degree, 50) AS DOUBLE) AS size_in_table, CAST(least(5 + 1.5 * degree, 30) AS DOUBLE) AS size_orphan FROM dg")
def node_sizes(spark, sf):
    d = network(spark, sf).degrees()
    return d.select("id", F.least(10 + 2 * F.col("degree"), F.lit(50)).cast("double").alias("size_in_table"), F.least(5 + 1.5 * F.col("degree"), F.lit(30.0)).cast("double").alias("size_orphan"))


@query("g4_most_connected", f"WITH e AS (SELECT DISTINCT least(i, j) AS src, greatest(i, j) AS dst FROM {RELATED_SQL} WHERE i <> j), q AS (SELECT src AS id FROM e UNION ALL SELECT dst FROM e), k AS (SELECT id, count(*) AS degree, id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') AS in_table FROM q GROUP BY id) SELECT id, degree FROM k WHERE in_table ORDER BY degree DESC, id LIMIT 10")
def most_connected(spark, sf):
    r = related(spark, sf)
    orders = _t(spark, sf, "orders")
    nodes = graph.article_nodes(r, orders.where("o_orderstatus = 'F'"), "i", "j", "o_orderkey")
    g = Graph(nodes.select("id"), graph.article_edges(r, orders, "i", "j", "o_orderkey"))
    return g.degrees().join(nodes.where("in_table"), "id").select("id", "degree").orderBy(F.desc("degree"), "id").limit(10)


@query("l29_article_report", f"WITH RECURSIVE e AS (SELECT DISTINCT least(i, j) AS src, greatest(i, j) AS dst FROM {RELATED_SQL} WHERE i <> j), b AS (SELECT src AS u, dst AS v FROM e UNION ALL SELECT dst, src FROM e), n AS (SELECT o_orderkey AS id FROM orders), deg AS (SELECT n.id, count(b.u) AS degree FROM n LEFT JOIN b ON b.u = n.id GROUP BY n.id), {REACH} SELECT (SELECT count(*) FROM n) AS n_nodes, (SELECT count(*) FROM e) AS n_edges, (SELECT count(*) FROM deg WHERE degree = 0) AS isolated, (SELECT count(DISTINCT component) FROM comp) AS components, (SELECT max(k) FROM (SELECT count(*) AS k FROM comp GROUP BY component)) AS largest")
def article_report(spark, sf):
    orders = _t(spark, sf, "orders")
    g = Graph(orders.select(F.col("o_orderkey").alias("id")), graph.article_edges(related(spark, sf), orders, "i", "j", "o_orderkey"))
    c = g.components().groupBy("component").count().agg(F.count("*").alias("components"), F.max("count").alias("largest"))
    return metrics.global_stats(g).select("n_nodes", "n_edges", "isolated").crossJoin(c)


def _largest_articles(spark, sf) -> Graph:
    return _stored(_articles(spark, sf), "articles").largest_component()


@query("l29_article_paths")
def article_paths(spark, sf):
    """The survey's L29 on the largest component: path lengths and clustering, exact at any size."""
    g = _stored(_largest_articles(spark, sf), "l29")
    return metrics.path_stats(g).crossJoin(metrics.local_clustering(g).agg(F.round(F.coalesce(F.avg("score"), F.lit(0.0)), 6).alias("clustering")))


@query("l29_article_centralities")
def article_centralities(spark, sf):
    """The survey's L29 on the largest component: the ten best by degree, betweenness and closeness."""
    g = _stored(_largest_articles(spark, sf), "l29")  # three measures read it
    measures = {"degree": metrics.degree_centrality(g), "betweenness": metrics.betweenness(g, max_nodes=None), "closeness": metrics.closeness(g)}
    tops = [graph.top_k(m.select("id", F.round("score", 9).alias("score")), "score", "id", 10).select(F.lit(k).alias("measure"), "rank", "id", "score") for k, m in measures.items()]
    return tops[0].unionByName(tops[1]).unionByName(tops[2])


# --- seeded or iterative: checked by invariants ---------------------------------------------


@query("l8_louvain")
def louvain(spark, sf):
    return community.louvain(network(spark, sf), seed=42)


@query("l9_leiden")
def leiden(spark, sf):
    return community.leiden(network(spark, sf), seed=42)


def _articles(spark, sf) -> Graph:
    orders = _t(spark, sf, "orders")
    return Graph(orders.select(F.col("o_orderkey").alias("id")), graph.article_edges(related(spark, sf), orders, "i", "j", "o_orderkey"))


@query("l8_louvain_rounds")
def louvain_rounds(spark, sf):
    """In DataFrame rounds over the colours of a graph of any size."""
    return colours.louvain(_articles(spark, sf))


@query("l9_leiden_rounds")
def leiden_rounds(spark, sf):
    return colours.leiden(_articles(spark, sf), resolution=0.2)


@query("l11_label_propagation_asynchronous")
def label_propagation_asynchronous(spark, sf):
    """Node after node, weighted; the nodes of a colour at once."""
    return colours.label_propagation(_articles(spark, sf))


@query("l25_degrees_kept", f"WITH {g_sql('l_partkey')} SELECT id, degree FROM dg")
def degrees_kept(spark, sf):
    """The degrees of a rewired copy are those of the graph."""
    g = _stored(network(spark, sf, "l_partkey"), "l25")
    edges, _ = randomize.rewire(g, 42, swaps_per_edge=1)
    return Graph(g.nodes, edges).degrees().select("id", "degree")


@query("l10_greedy_modularity")
def greedy(spark, sf):
    return community.greedy_modularity(network(spark, sf))


@query("l11_label_propagation")
def label_propagation(spark, sf):
    return community.label_propagation(network(spark, sf))


@query("l20_small_world")
def small_world(spark, sf):
    return community.small_world(_stored(network(spark, sf), "l20"), seed=42)


@query("l25_null_model")
def null_model(spark, sf):
    """The three layers of the random baseline."""
    rows = None
    for name, edges in community.null_layers(_stored(network(spark, sf), "l25"), seed=42).items():
        one = edges.withColumn("layer", F.lit(name))
        rows = one if rows is None else rows.unionByName(one)
    return rows
