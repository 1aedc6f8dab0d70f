"""Measures of graphs: degrees, paths, centralities, clustering, assortativity, modularity.

Closeness and path lengths come from bits in blocks (:mod:`blocks`); :func:`distances` runs breadth-first search from
all wanted sources at once in DataFrame rounds; or, where exact betweenness over all sources is asked, Brandes' algorithm in
tasks that share a broadcast adjacency list whose size is checked first.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch
from .blocks import distance_sums
from .graph import Graph
from .triangles import triangle_sums

MAX_BROADCAST_EDGES = 20_000_000  # 320 MB through the driver, 160 MB broadcast
MAX_EXACT_NODES = 5_000
DENSE_NODES = 20_000  # a bitset of 50 MB
DENSE_DEGREE = 64
BAND = 256  # rows that are unpacked, and sources of a product, at once


def global_stats(g: Graph) -> DataFrame:
    """``n_nodes, n_edges, density, isolated, avg_degree`` in one row."""
    d = g.degrees().agg(F.count("*").alias("n_nodes"), F.sum("degree").alias("s"), F.sum(F.when(F.col("degree") == 0, 1).otherwise(0)).alias("isolated"))
    n, m = F.col("n_nodes"), F.coalesce("s", F.lit(0)) / 2
    return d.select("n_nodes", m.cast("long").alias("n_edges"), F.round(F.coalesce(F.try_divide(2 * m, n * (n - 1)), F.lit(0.0)), 9).alias("density"), F.coalesce("isolated", F.lit(0)).cast("long").alias("isolated"), F.round(F.coalesce(F.try_divide(2 * m, n), F.lit(0.0)), 9).alias("avg_degree"))


def degree_centrality(g: Graph) -> DataFrame:
    """Degree over ``n - 1``; 1 for a single node."""
    n = g.nodes.agg(F.count("*").alias("n"))
    return g.degrees().crossJoin(F.broadcast(n)).select("id", F.when(F.col("n") <= 1, 1.0).otherwise(F.try_divide(F.col("degree"), F.col("n") - 1)).alias("score"))


def distances(g: Graph, sources: DataFrame | None = None, max_depth: int | None = None) -> DataFrame:
    """``source, id, dist`` of everything reachable; one join and one anti-join a level.

    ``max_depth``: only what lies within it; None for all, as many levels as there are.
    """
    work = Scratch(g.edges.sparkSession, "bfs")
    start = (g.nodes if sources is None else sources).select(F.col("id").alias("source"))
    adj = work.save(g.both().select(F.col("u").alias("id"), "v"), "adjacency")
    seen = work.save(start.select("source", F.col("source").alias("id"), F.lit(0).alias("dist")), "level0")
    levels = [seen]
    frontier = seen
    for depth in itertools.count(1):
        if max_depth is not None and depth > max_depth:
            break
        step = frontier.join(adj, "id").select("source", F.col("v").alias("id")).distinct()
        recent = levels[-1] if len(levels) < 2 else levels[-1].unionByName(levels[-2])  # in an undirected graph nothing older can be met
        frontier = work.save(step.join(recent.select("source", "id"), ["source", "id"], "left_anti").withColumn("dist", F.lit(depth)), f"level{depth}")
        if frontier.isEmpty():
            break
        levels.append(frontier)
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out


def closeness(g: Graph, dist: DataFrame | None = None) -> DataFrame:
    """Closeness scaled by the reachable share (Wasserman and Faust)."""
    if dist is None:
        d = distance_sums(g).select("id", F.col("reached").alias("r"), F.col("total").alias("s"))
    else:
        d = dist.groupBy(F.col("source").alias("id")).agg((F.count("*") - 1).alias("r"), F.sum("dist").alias("s"))
    n = g.nodes.agg(F.count("*").alias("n"))
    r = F.col("r")
    score = F.coalesce(F.try_divide(r, F.col("s")) * F.try_divide(r, F.col("n") - 1), F.lit(0.0))
    return d.crossJoin(F.broadcast(n)).select("id", score.alias("score"))


def path_stats(g: Graph, dist: DataFrame | None = None) -> DataFrame:
    """``avg_path, diameter`` over all reachable pairs of different nodes."""
    if dist is None:
        mean = F.try_divide(F.sum("total"), F.sum("reached"))
        return distance_sums(g).agg(F.round(F.coalesce(mean, F.lit(0.0)), 9).alias("avg_path"), F.coalesce(F.max("far"), F.lit(0)).cast("long").alias("diameter"))
    d = dist.where("dist > 0")
    return d.agg(F.round(F.coalesce(F.avg("dist"), F.lit(0.0)), 9).alias("avg_path"), F.coalesce(F.max("dist"), F.lit(0)).cast("long").alias("diameter"))


def _adjacency(g: Graph, max_edges: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, row starts and neighbours of a graph of checked size."""
    n_edges = g.edges.count()
    if n_edges > max_edges:
        raise ValueError(f"{n_edges} edges are too many for a broadcast adjacency list of {max_edges}")
    rows = g.nodes.select("id").limit(max_edges + 1).collect()
    if len(rows) > max_edges:
        raise ValueError(f"more than {max_edges} nodes are too many for a broadcast adjacency list")
    ids = np.array(sorted(r[0] for r in rows))
    e = g.edges.select("src", "dst").toArrow()
    s, d = (np.searchsorted(ids, e.column(c).to_numpy()) for c in ("src", "dst"))
    u, v = (np.concatenate(x).astype(np.int32) for x in ((s, d), (d, s)))
    order = np.lexsort((v, u))
    return ids, np.concatenate([[0], np.cumsum(np.bincount(u, minlength=len(ids)))]), v[order]


def _credit_sums(bits: np.ndarray, sources: np.ndarray) -> np.ndarray:
    """The sum of all credits (Brandes) of ``sources``; levels are products of the adjacency matrix, unpacked in bands."""
    n = len(bits)

    def product(x: np.ndarray) -> np.ndarray:
        out = np.empty_like(x)
        for at in range(0, n, BAND):
            out[at : at + BAND] = np.unpackbits(bits[at : at + BAND], axis=1, count=n, bitorder="little").astype(float) @ x
        return out

    at = (sources, np.arange(len(sources)))
    dist = np.full((n, len(sources)), -1, np.int32)
    paths = np.zeros((n, len(sources)))
    dist[at], paths[at] = 0, 1
    level, here = 0, paths.copy()
    while here.any():
        level += 1
        here = np.where(dist < 0, product(here), 0.0)
        dist[here > 0] = level
        paths += here
    credit = np.zeros_like(paths)
    for k in range(level - 1, 1, -1):
        share = np.where(dist == k, (1 + credit) / np.where(dist == k, paths, 1.0), 0.0)
        credit += np.where(dist == k - 1, paths * product(share), 0.0)
    return credit.sum(axis=1)


def betweenness(g: Graph, max_nodes: int | None = MAX_EXACT_NODES, max_edges: int = MAX_BROADCAST_EDGES) -> DataFrame:
    """Exact normalised betweenness (Brandes), unweighted; sources are dealt over tasks.

    Its cost is nodes times edges, so graphs over ``max_nodes`` nodes are refused unless it is None.  Of up to ``DENSE_NODES``
    nodes and a degree of ``DENSE_DEGREE`` on average, levels are matrix products over batches of sources.  A graph of more
    than ``max_edges`` edges or nodes goes through :func:`paths.betweenness_pivots` with all pivots, as exact but slower.
    """
    spark = g.edges.sparkSession
    if max_nodes is None and max(g.edges.count(), g.nodes.count()) > max_edges:
        from . import paths

        return paths.betweenness_pivots(g).select("id", "score")
    ids, starts, to = _adjacency(g, max_edges)
    n = len(ids)
    if max_nodes is not None and n > max_nodes:
        raise ValueError(f"exact betweenness over {n} nodes; the limit is {max_nodes}")
    dense = DENSE_DEGREE * n <= len(to) and n <= DENSE_NODES
    if dense:
        bits = np.zeros((n, (n + 7) // 8), np.uint8)
        np.bitwise_or.at(bits, (np.repeat(np.arange(n), np.diff(starts)), to >> 3), (1 << (to & 7)).astype(np.uint8))
        starts = to = None
    else:
        bits = None
    shared = spark.sparkContext.broadcast((starts, to, bits))

    def task(batches):
        starts, to, bits = shared.value
        total = np.zeros(n)
        for batch in batches:
            if bits is not None:
                some = batch.column(0).to_numpy()
                for at in range(0, len(some), BAND):
                    total += _credit_sums(bits, some[at : at + BAND])
                continue
            for s in batch.column(0).to_pylist():
                dist = np.full(n, -1)
                paths = np.zeros(n)
                dist[s], paths[s] = 0, 1
                levels = [np.array([s])]
                while len(levels[-1]):
                    f = levels[-1]
                    size = starts[f + 1] - starts[f]
                    at = np.repeat(starts[f] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))
                    v, u = to[at], np.repeat(f, size)
                    new = np.unique(v[dist[v] < 0])
                    dist[new] = len(levels)
                    ok = dist[v] == len(levels)
                    np.add.at(paths, v[ok], paths[u[ok]])
                    levels.append(new)
                credit = np.zeros(n)
                for f in reversed(levels[1:]):
                    if not len(f):
                        continue
                    size = starts[f + 1] - starts[f]
                    at = np.repeat(starts[f] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))
                    v, u = to[at], np.repeat(f, size)
                    ok = dist[v] == dist[u] - 1
                    np.add.at(credit, v[ok], paths[v[ok]] / paths[u[ok]] * (1 + credit[u[ok]]))
                credit[s] = 0
                total += credit
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], names=["place", "part"])

    parts = spark.range(n).repartition(max(1, min(n, spark.sparkContext.defaultParallelism * 2))).mapInArrow(task, "place long, part double")
    sums = parts.groupBy("place").agg(F.sum("part").alias("b"))
    names = spark.createDataFrame(pa.table({"place": pa.array(np.arange(n)), "id": pa.array(ids.tolist())}))
    scale = 1 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    return names.join(sums, "place", "left").select("id", (F.coalesce("b", F.lit(0.0)) * scale).alias("score"))


def eigenvector(g: Graph, max_iter: int = 1000, tol: float = 1e-6, fixed: int | None = None) -> DataFrame | None:
    """Power iteration on ``A + I``; None if it does not settle.  ``fixed``: so many rounds, no test."""
    work = Scratch(g.edges.sparkSession, "eigen")
    adj = work.save(g.both().select("u", "v"), "adjacency")
    n = g.nodes.count()
    x = work.save(g.nodes.select("id", F.lit(1.0 / max(1, n)).alias("score")), "x0")
    for k in range(1, (fixed or max_iter) + 1):
        pull = adj.join(x.withColumnRenamed("id", "v"), "v").groupBy(F.col("u").alias("id")).agg(F.sum("score").alias("s"))
        y = x.join(pull, "id", "left").select("id", F.col("score").alias("old"), (F.col("score") + F.coalesce("s", F.lit(0.0))).alias("y"))
        norm = y.agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("norm"))
        y = work.save(y.crossJoin(F.broadcast(norm)).select("id", "old", F.coalesce(F.try_divide("y", "norm"), F.lit(0.0)).alias("score")), f"x{k}")
        x = y.select("id", "score")
        if fixed is None and (y.agg(F.sum(F.abs(F.col("score") - F.col("old")))).first()[0] or 0) < n * tol:
            return x
    return x if fixed is not None else None


def triangles(g: Graph) -> DataFrame:
    """``id, triangles`` of the nodes that have any."""
    work = Scratch(g.edges.sparkSession, "triangles")
    edges = work.save(g.edges.select("src", "dst", F.lit(1.0).alias("w")), "edges")
    return triangle_sums(g.nodes.select("id"), edges, work)


def local_clustering(g: Graph, weighted: bool = False, ranges: int | None = None) -> DataFrame:
    """``id, score``; weighted: geometric means of the triangles' weights over the largest weight.

    Triangles are counted by blocks of the adjacency matrix; ``ranges`` fixes their number.
    """
    work = Scratch(g.edges.sparkSession, "clustering")
    g = Graph(work.save(g.nodes.select("id"), "nodes"), work.save(g.edges.select("src", "dst", "weight"), "edges"))
    d = g.degrees().select("id", "degree")
    w = F.lit(1.0)
    edges = g.edges
    if weighted:  # the product of three cube roots is the geometric mean
        edges = edges.crossJoin(F.broadcast(edges.agg(F.max("weight").alias("top"))))
        w = F.cbrt(F.col("weight") / F.col("top"))
    t = triangle_sums(g.nodes, edges.select("src", "dst", w.alias("w")), work, weighted, ranges)
    pairs = F.col("degree") * (F.col("degree") - 1) / 2
    return d.join(t, "id", "left").select("id", F.coalesce(F.try_divide(F.coalesce("triangles", F.lit(0)), pairs), F.lit(0.0)).alias("score"))


def correlation(df: DataFrame, a: str, b: str):
    """Pearson correlation as one row; null for fewer than two rows or without variance."""
    m = df.agg(F.count("*").alias("n"), F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.avg(F.col(a) * F.col(b)).alias("ab"), F.var_pop(a).alias("va"), F.var_pop(b).alias("vb"))
    return m.select(F.when(F.col("n") >= 2, F.try_divide(F.col("ab") - F.col("ma") * F.col("mb"), F.sqrt(F.col("va") * F.col("vb")))).alias("r"))


def degree_assortativity(g: Graph, weighted: bool = False) -> DataFrame:
    """Correlation of the degrees (strengths) at the ends of an edge, over both directions."""
    c = "strength" if weighted else "degree"
    d = g.degrees().select("id", F.col(c).cast("double").alias("x"))
    e = g.both().join(d.select(F.col("id").alias("u"), F.col("x").alias("xu")), "u").join(d.select(F.col("id").alias("v"), F.col("x").alias("xv")), "v")
    return correlation(e, "xu", "xv")


def layer_correlation(nodes: DataFrame, a: Graph, b: Graph) -> DataFrame:
    """Correlation of degrees in two layers over ``nodes(id)``; absent nodes have degree 0."""
    da, db = (x.degrees().select("id", F.col("degree").cast("double").alias(n)) for x, n in ((a, "da"), (b, "db")))
    rows = nodes.join(da, "id", "left").join(db, "id", "left").na.fill(0.0, ["da", "db"])
    return correlation(rows, "da", "db")


def modularity(g: Graph, partition: DataFrame, weighted: bool = True) -> DataFrame:
    """Modularity of ``partition(id, cluster)`` in one row."""
    w = F.col("weight").cast("double") if weighted else F.lit(1.0)
    e = g.edges.select("src", "dst", w.alias("w")).join(partition.select(F.col("id").alias("src"), F.col("cluster").alias("cs")), "src").join(partition.select(F.col("id").alias("dst"), F.col("cluster").alias("cd")), "dst")
    ends = e.select(F.explode(F.array("cs", "cd")).alias("c"), "w").groupBy("c").agg(F.sum("w").alias("d"))
    inside = e.where("cs = cd").groupBy(F.col("cs").alias("c")).agg(F.sum("w").alias("l"))
    m = e.agg(F.sum("w").alias("m"))
    q = ends.join(inside, "c", "left").crossJoin(F.broadcast(m)).select((F.try_divide(F.coalesce("l", F.lit(0.0)), "m") - F.pow(F.try_divide(F.col("d"), 2 * F.col("m")), 2)).alias("q"))
    return q.agg(F.coalesce(F.sum("q"), F.lit(0.0)).alias("modularity"))


def percent_change(before, after):
    """``(difference, percent)``; 0 percent where ``before`` is 0, null where either is."""
    return after - before, F.when(before == 0, F.when(after.isNotNull(), 0.0)).otherwise(F.try_divide(after - before, before) * 100)


def size_summary(components: DataFrame) -> DataFrame:
    """``size, components``: how many components have each size."""
    return components.groupBy("component").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("components"))


def upper_median(df: DataFrame, column: str) -> DataFrame:
    """The value at place ``floor(n / 2)`` of the ascending order, as one row ``median``.

    Found from the value counts, so that only distinct values are ordered.
    """
    c = df.groupBy(F.col(column).alias("x")).agg(F.count("*").alias("k"))
    run = c.select("x", "k", F.sum("k").over(Window.orderBy("x")).alias("upto"), F.sum("k").over(Window.partitionBy(F.lit(1))).alias("n"))
    return run.where(F.col("upto") > F.floor(F.col("n") / 2)).agg(F.min("x").alias("median"))
