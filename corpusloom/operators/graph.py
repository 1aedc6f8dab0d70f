"""Weighted undirected graphs as two frames, and the ways to build them from bylines.

A graph is ``nodes(id)`` and ``edges(src, dst, weight)`` with ``src < dst``.  All builders are
joins and aggregations; nothing is collected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components

PAIRS_PER_TASK = 1_000_000


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame

    def both(self) -> DataFrame:
        """Every edge in both directions: ``u, v, weight``."""
        e = self.edges
        return e.select(F.col("src").alias("u"), F.col("dst").alias("v"), "weight").unionAll(e.select(F.col("dst").alias("u"), F.col("src").alias("v"), "weight"))

    def degrees(self) -> DataFrame:
        """``id, degree, strength`` of every node, isolated ones with 0."""
        d = self.both().groupBy(F.col("u").alias("id")).agg(F.count("*").alias("degree"), F.sum("weight").alias("strength"))
        return self.nodes.join(d, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"), F.coalesce("strength", F.lit(0)).cast("long").alias("strength"))

    def induced(self, keep: DataFrame) -> "Graph":
        """The subgraph on the ids in ``keep(id)``."""
        ids = keep.select("id").distinct()
        e = self.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
        return Graph(self.nodes.join(ids, "id", "left_semi"), e.select("src", "dst", "weight"))

    def without(self, drop: DataFrame) -> "Graph":
        """The subgraph without the ids in ``drop(id)``."""
        return self.induced(self.nodes.join(drop.select("id"), "id", "left_anti"))

    def binarised(self) -> "Graph":
        """Edges of positive weight, all of weight 1; nodes without an edge vanish."""
        e = self.edges.where("weight > 0").select("src", "dst", F.lit(1).cast("long").alias("weight"))
        return Graph(e.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), e)

    def heavier(self, threshold: float) -> "Graph":
        """Edges of more than ``threshold``, and their endpoints only."""
        e = self.edges.where(F.col("weight") > threshold)
        return Graph(e.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), e)

    def components(self) -> DataFrame:
        """``id, component`` of every node; a component is named by its least id."""
        c = connected_components(self.edges)
        return self.nodes.join(c, "id", "left").select("id", F.coalesce("component", "id").alias("component"))

    def largest_component(self, components: DataFrame | None = None) -> "Graph":
        """The subgraph on the largest component; of equal ones, that of the least id."""
        c = self.components() if components is None else components
        best = c.groupBy("component").count().orderBy(F.desc("count"), "component").limit(1)
        return self.induced(c.join(best, "component", "left_semi").select("id"))


def canonical(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """``src, dst, weight`` of unordered pairs, one unit of weight per row."""
    p = pairs.select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")).where("src <> dst")
    return p.groupBy("src", "dst").agg(F.count("*").alias("weight"))


def _tasks(bylines: DataFrame) -> int:
    """So many tasks that each makes about ``PAIRS_PER_TASK`` pairs of authors; 0 where Spark's own number will do."""
    k = bylines.groupBy("i").agg(F.count("*").cast("double").alias("k")).agg(F.sum(F.col("k") * F.col("k")).alias("s")).first()["s"] or 0
    if k <= PAIRS_PER_TASK:
        return 0
    return max(bylines.sparkSession.sparkContext.defaultParallelism, -(-int(k) // PAIRS_PER_TASK))


def coauthor_layer(bylines: DataFrame, item: str, author: str) -> DataFrame:
    """Edges between authors of the same item; an author counts once an item.

    Tasks grow in number with the pairs, so that the pairs one task counts stay bounded.
    """
    m = bylines.select(F.col(item).alias("i"), F.col(author).alias("x")).where("x is not null")
    tasks = _tasks(m)
    m = (m.repartition(tasks, "i") if tasks else m).distinct()
    return m.join(m.withColumnRenamed("x", "y"), "i").where("x < y").groupBy(F.col("x").alias("src"), F.col("y").alias("dst")).agg(F.count("*").alias("weight"))


def related_layer(bylines: DataFrame, related: DataFrame, item: str, author: str, source: str, target: str) -> DataFrame:
    """Edges from each author of an item to each author of its related items.

    Nothing is made distinct: repeated authors, repeated links and links back all add weight.
    """
    m = bylines.select(F.col(item).alias("i"), F.col(author).alias("x")).where("x is not null")
    hop = related.select(F.col(source).alias("i"), F.col(target).alias("j"))
    left, right = m.join(hop, "i"), m.select(F.col("i").alias("j"), F.col("x").alias("y"))
    tasks = _tasks(m)
    if tasks:  # as in coauthor_layer
        left, right = left.repartition(tasks, "j"), right.repartition(tasks, "j")
    pairs = left.join(right, "j").where("x <> y")
    return canonical(pairs, "x", "y")


def article_edges(related: DataFrame, ids: DataFrame, source: str, target: str, key: str) -> DataFrame:
    """Distinct undirected links between items of the table, without loops."""
    known = ids.select(F.col(key).alias("t")).distinct()
    e = related.select(F.col(source).alias("s"), F.col(target).alias("t")).where("s <> t").join(known, "t", "left_semi").join(known.withColumnRenamed("t", "s"), "s", "left_semi")
    return e.select(F.least("s", "t").alias("src"), F.greatest("s", "t").alias("dst")).distinct().withColumn("weight", F.lit(1).cast("long"))


def orphan_count(related: DataFrame, ids: DataFrame, target: str, key: str) -> DataFrame:
    """How many references point outside the table, each occurrence counted."""
    return related.where(F.col(target).isNotNull()).join(ids.select(F.col(key).alias(target)).distinct(), target, "left_anti").agg(F.count("*").alias("orphan_references"))


def article_nodes(related: DataFrame, ids: DataFrame, source: str, target: str, key: str) -> DataFrame:
    """``id, in_table`` of all items that link or are linked to."""
    ends = related.where(F.col(target).isNotNull()).select(F.explode(F.array(source, target)).alias("id")).distinct()
    known = ids.select(F.col(key).alias("id")).distinct().withColumn("known", F.lit(True))
    return ends.join(known, "id", "left").select("id", F.coalesce("known", F.lit(False)).alias("in_table"))


def union_layers(layers: dict[str, DataFrame], how: str = "sum") -> DataFrame:
    """``src, dst, weight, layers`` over all layers; ``layers`` is sorted and comma-joined."""
    if how not in ("sum", "max"):
        raise ValueError(f"weights combine by sum or max, not {how}")
    rows = None
    for name, e in layers.items():
        one = e.select("src", "dst", "weight", F.lit(name).alias("layer"))
        rows = one if rows is None else rows.unionByName(one)
    weight = F.sum("weight") if how == "sum" else F.max("weight")
    return rows.groupBy("src", "dst").agg(weight.alias("weight"), F.array_join(F.sort_array(F.collect_set("layer")), ",").alias("layers"))


def union_nodes(layers: dict[str, DataFrame]) -> DataFrame:
    """``id, layers`` of the nodes that any layer has."""
    rows = None
    for name, n in layers.items():
        one = n.select("id", F.lit(name).alias("layer"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("id").agg(F.array_join(F.sort_array(F.collect_set("layer")), ",").alias("layers"))


def top_k(df: DataFrame, score: str, key: str, k: int) -> DataFrame:
    """The ``k`` (one at least) best rows with ``rank``; equal scores are ordered by ``key``."""
    best = df.orderBy(F.desc(score), F.asc(key)).limit(max(1, k))
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), F.asc(key))))
