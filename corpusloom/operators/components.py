"""Connected components by hooking and contraction.

Each round hooks every node to its least neighbour, flattens the resulting trees by pointer
doubling, relabels the edges and drops those inside a tree.  Labels only ever fall, so a
component ends with its least node id.  Every step is an aggregation (with map-side combine) or
an equi-join that adaptive execution may split, so a node with a third of all edges is no
bottleneck; state is kept in scratch tables, never on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``(id, component)`` for every endpoint of ``edges``; ``component`` is the least id reachable.

    Rows with a null endpoint are ignored; loops make their node a component of its own.
    """
    spark = edges.sparkSession
    work = Scratch(spark, "components")
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    e = work.save(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges0")
    labels = work.save(e.select(F.explode(F.array("u", "v")).alias("id")).distinct().withColumn("component", F.col("id")), "labels0")
    e = e.where("u <> v")
    left_over = ["edges0"]
    for n in range(1, max_rounds + 1):
        if e.isEmpty():
            work.drop(*left_over)
            return labels
        hook = work.save(e.groupBy("u").agg(F.min("v").alias("p")), f"hook{n}_0")
        for k in range(1, 64):
            up = hook.select(F.col("u").alias("p"), F.col("p").alias("g"))
            nxt = work.save(hook.join(up, "p", "left").select("u", F.coalesce("g", "p").alias("p"), F.col("g").isNotNull().alias("moved")), f"hook{n}_{k}")
            hook, moved = nxt.select("u", "p"), nxt.where("moved").isEmpty()
            if moved:
                break
        as_label = hook.select(F.col("u").alias("component"), F.col("p").alias("to"))
        labels = work.save(labels.join(as_label, "component", "left").select("id", F.coalesce("to", "component").alias("component")), f"labels{n}")
        a, b = hook.select("u", F.col("p").alias("pu")), hook.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        left_over += [f"labels{n - 1}", f"edges{n}", *(f"hook{n}_{i}" for i in range(k + 1))]
        moved_edges = e.join(a, "u", "left").join(b, "v", "left").select(F.coalesce("pu", "u").alias("u"), F.coalesce("pv", "v").alias("v")).where("u <> v")
        e = work.save(moved_edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"edges{n}")
    raise RuntimeError("components did not settle")
