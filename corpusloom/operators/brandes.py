"""Brandes' credits of many pivots at once, in tasks that share no state.

Nodes are dealt to packs of whole components (one that is large has a pack of its own) and get places in them.  The
adjacency of a pack is one row: bits where it is dense, else row starts and neighbours, of ``PART_BYTES`` at most; components
that need more go pivot by pivot through :mod:`wide`, and those of over ``wide.WIDE`` edges through the rounds of :mod:`paths`.  A group is a pack and a few of its pivots, as columns of matrices of
``CELLS`` numbers at most: a level of the search is the product of the adjacency and the columns, forward for the numbers of
shortest paths, backward for the credits.  Shortest paths never leave a component, so nothing else is needed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch
from . import wide
from .graph import Graph

PART_BYTES = 1 << 25  # adjacency of a pack
PACK = 250_000  # edges of small components that a pack has, on average
CELLS = 2_000_000  # nodes times pivots of a group
BAND = 256  # rows that are unpacked at once
PIECE = 1 << 21  # numbers that are gathered at once


def _raw(x: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes()], pa.binary())


def packed(g: Graph, nodes: DataFrame, work: Scratch, components: DataFrame | None = None) -> tuple[DataFrame, DataFrame, wide.Wide | None, Graph | None]:
    """The packs, ``id, turn, pack, p, size`` of their nodes, the components too large for a pack, and the graph of those too large for a task.

    ``g`` and ``nodes(id, turn)`` should be stored.  Nodes without an edge are in neither.
    """
    of = g.components() if components is None else components
    of = work.save(of.join(nodes, "id").select("id", "turn", "component"), "components")
    e = g.edges.select("src", "dst").join(of.select(F.col("id").alias("src"), "component"), "src")
    sizes = e.groupBy("component").agg(F.count("*").alias("m")).join(of.groupBy("component").agg(F.count("*").cast("double").alias("n")), "component")
    sizes = work.save(sizes, "sizes")
    fits = F.least(8 * F.col("m"), F.col("n") * F.col("n") / 8) <= PART_BYTES
    packs = max(1, -(-(sizes.where(fits).agg(F.sum("m")).first()[0] or 0) // PACK))
    pack = F.when(F.col("m") > PACK // 4, F.xxhash64("component")).otherwise(F.pmod(F.xxhash64("component"), F.lit(packs)))
    own = Window.partitionBy("pack")
    placed = of.join(sizes.where(fits).select("component", pack.alias("pack")), "component")
    placed = placed.select("id", "turn", "pack", (F.row_number().over(own.orderBy("id")) - 1).cast("int").alias("p"), F.count("*").over(own).alias("size"))
    placed = work.save(placed, "placed")
    a, b = placed.select(F.col("id").alias("src"), "pack", F.col("p").alias("u")), placed.select(F.col("id").alias("dst"), F.col("p").alias("v"))
    rows = g.edges.select("src", "dst").join(a, "src").join(b, "dst").select("pack", "u", "v")
    rows = rows.unionByName(placed.select("pack", F.col("p").alias("u"), (-1 - F.col("turn")).cast("int").alias("v")))  # a node: its turn, below 0
    rows = work.save(rows.groupBy("pack").applyInArrow(_pack, "pack long, turns binary, starts binary, near binary"), "packs")
    held, rest = None, sizes.where(~fits)
    some = rest.where(F.col("m") <= wide.WIDE)
    if not some.isEmpty():
        near = of.join(F.broadcast(some), "component", "left_semi")
        held = wide.Wide(near, g.edges.join(near.select(F.col("id").alias("src")), "src", "left_semi"), work, False)
    rest = rest.where(F.col("m") > wide.WIDE)
    if rest.isEmpty():
        return rows, placed, held, None
    far = of.join(rest, "component", "left_semi")
    large = Graph(work.save(far.select("id", "turn"), "large_nodes"), work.save(g.edges.join(far.select(F.col("id").alias("src")), "src", "left_semi").select("src", "dst", "weight"), "large_edges"))
    return rows, placed, held, large


def _pack(table: pa.Table) -> pa.Table:
    """The adjacency of a pack: ``near`` are bits where ``starts`` is empty."""
    u, v = table.column("u").to_numpy(), table.column("v").to_numpy()
    node = v < 0
    turns = np.zeros(int(node.sum()), np.int32)
    turns[u[node]] = -1 - v[node]
    u, v = u[~node], v[~node]
    n = len(turns)
    if n * n <= 64 * len(u):  # n * n / 8 bytes, and at most 40 products for what a neighbour costs
        matrix = np.zeros((n, n), bool) if n <= BAND else None
        if matrix is None:
            near = np.zeros((n, (n + 7) // 8), np.uint8)
            for x, y in ((u, v), (v, u)):
                np.bitwise_or.at(near, (x, y >> 3), np.uint8(1) << (y & 7).astype(np.uint8))
        else:
            matrix[u, v] = matrix[v, u] = True
            near = np.packbits(matrix, axis=1, bitorder="little")
        starts = np.zeros(0, np.int64)
    else:
        u, v = np.concatenate([u, v]), np.concatenate([v, u])
        starts = np.concatenate([[0], np.cumsum(np.bincount(u, minlength=n))]).astype(np.int64)
        near = v[np.argsort(u, kind="stable")].astype(np.int32)
    return pa.table({"pack": table.column("pack")[:1], "turns": _raw(turns), "starts": _raw(starts), "near": _raw(near)})


def _product(starts: np.ndarray, near: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The adjacency times ``x``; a list of neighbours is read only where ``x`` has something."""
    n, w = x.shape
    out = np.zeros_like(x)
    if not len(starts):
        for at in range(0, n, BAND):
            out[at : at + BAND] = np.unpackbits(near[at : at + BAND], axis=1, count=n, bitorder="little").astype(float) @ x
        return out
    met = np.flatnonzero(x.any(axis=1)[near])
    own = np.searchsorted(starts, met, "right") - 1
    step = max(1, PIECE // w)
    for lo in range(0, len(met), step):
        u = own[lo : lo + step]
        first = np.flatnonzero(np.r_[True, u[1:] != u[:-1]])
        out[u[first]] += np.add.reduceat(x[near[met[lo : lo + step]]], first, axis=0)
    return out


def credits(starts: np.ndarray, near: np.ndarray, n: int, pivots: np.ndarray) -> np.ndarray:
    """``n x pivots``: the share of a pivot's shortest paths that pass each node (Brandes), 0 for the pivot itself."""
    columns = np.arange(len(pivots))
    dist = np.full((n, len(pivots)), -1, np.int32)
    paths = np.zeros((n, len(pivots)))
    dist[pivots, columns], paths[pivots, columns] = 0, 1
    level, here = 0, paths.copy()
    while True:
        if level or len(starts):
            here = _product(starts, near, here)
            here[dist >= 0] = 0
        else:  # the neighbours of the pivots
            here = (near[:, pivots >> 3] >> (pivots & 7).astype(np.uint8) & 1).astype(float)
        if not here.any():
            break
        level += 1
        dist[here > 0] = level
        paths += here
        if (dist >= 0).all():
            break
    credit = np.zeros_like(paths)
    for k in range(level, 1, -1):
        share = np.divide(1 + credit, paths, out=np.zeros_like(paths), where=dist == k)
        got = _product(starts, near, share)
        above = dist == k - 1
        credit[above] = (paths * got)[above]
    return credit


def sums(packs: DataFrame, placed: DataFrame, first: int, last: int) -> DataFrame:
    """``id, turn, c, cc``: the credits of the pivots of each turn from ``first`` to ``last``, and their squares, added up."""
    spark = packs.sparkSession
    some = placed.where(F.col("turn").between(first, last)).groupBy("pack", "size").agg(F.count("*").alias("pivots"))
    total = some.agg(F.sum("pivots")).first()[0] or 0
    wide = max(1, -(-total // (3 * spark.sparkContext.defaultParallelism)))
    width = F.greatest(F.lit(1), F.least(F.lit(wide), F.floor(F.lit(CELLS) / F.col("size")))).cast("int")
    dealt = some.select("pack", width.alias("width"), F.explode(F.sequence(F.lit(0), F.floor((F.col("pivots") - 1) / width).cast("int"))).alias("b"))

    def task(table: pa.Table) -> pa.Table:
        turns, starts, near = (np.frombuffer(table.column(c)[0].as_buffer(), t) for c, t in (("turns", np.int32), ("starts", np.int64), ("near", np.uint8)))
        n = len(turns)
        near = near.view(np.int32) if len(starts) else near.reshape(n, -1)
        width, b = (table.column(c)[0].as_py() for c in ("width", "b"))
        pivots = np.flatnonzero((turns >= first) & (turns <= last))
        pivots = pivots[np.argsort(turns[pivots], kind="stable")][b * width : (b + 1) * width]
        credit, turn = credits(starts, near, n, pivots), turns[pivots]
        at = np.flatnonzero(np.r_[True, turn[1:] != turn[:-1]])
        c = np.add.reduceat(credit, at, axis=1)
        cc = np.add.reduceat(credit * credit, at, axis=1)
        p, k = np.nonzero(c)
        return pa.table({"pack": pa.array(np.full(len(p), table.column("pack")[0].as_py()), pa.int64()), "p": pa.array(p, pa.int32()), "turn": pa.array(turn[at][k], pa.int32()), "c": pa.array(c[p, k]), "cc": pa.array(cc[p, k])})

    found = packs.join(dealt, "pack").groupBy("pack", "b").applyInArrow(task, "pack long, p int, turn int, c double, cc double")
    found = found.groupBy("pack", "p", "turn").agg(F.sum("c").alias("c"), F.sum("cc").alias("cc"))
    return placed.select("id", "pack", "p").join(found, ["pack", "p"]).select("id", "turn", "c", "cc")
