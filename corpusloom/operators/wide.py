"""Components too large for a row, as pieces of an adjacency that one task puts together in flat arrays.

Edges go both ways to pieces of about ``PIECE_EDGES`` by the place of their row, so a piece is bounded and a hub's rows are spread.
A group gets all pieces of a component, a partition of its own, and reads them batch by batch: 4 bytes an edge and
direction, 4 or 8 more with weights.  So a component of at most ``WIDE`` edges fits a task; larger ones are left to the rounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch

WIDE = 75_000_000  # edges of a component; 1.2 GB in a task with weights, 0.6 GB without
PIECE_EDGES = 2_000_000  # directed edges of a piece
PIECES = "k int, first boolean, n int, size long, us binary, counts binary, near binary, ws binary"


def _raw(x: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes()], pa.binary())


class Wide:
    """``placed(id, turn, k, p)`` and the pieces of ``count`` components; ``nodes(id, component, turn)`` have an edge each."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, work: Scratch, weighted: bool):
        spark = nodes.sparkSession
        sizes = edges.join(nodes.select(F.col("id").alias("src"), "component"), "src").groupBy("component").agg(F.count("*").alias("m")).orderBy("component").collect()  # few, by their size
        self.count = len(sizes)
        names = spark.createDataFrame([(r["component"], k, 2 * r["m"], max(1, -(-2 * r["m"] // PIECE_EDGES))) for k, r in enumerate(sizes)], f"component {nodes.schema['component'].dataType.simpleString()}, k int, size long, parts int")
        own = Window.partitionBy("k")
        placed = nodes.join(F.broadcast(names), "component")
        self.placed = work.save(placed.select("id", "turn", "k", (F.row_number().over(own.orderBy("id")) - 1).cast("int").alias("p"), F.count("*").over(own).cast("int").alias("n"), "size", "parts"), "wide_placed")
        a, b = self.placed.select(F.col("id").alias("src"), "k", F.col("p").alias("u"), "n", "size", "parts"), self.placed.select(F.col("id").alias("dst"), F.col("p").alias("v"))
        w = F.col("weight").cast("double") if weighted else F.lit(1.0)
        e = edges.select("src", "dst", w.alias("w")).join(a, "src").join(b, "dst").select("k", "n", "size", "parts", "u", "v", "w")
        both = e.unionAll(e.select("k", "n", "size", "parts", F.col("v").alias("u"), F.col("u").alias("v"), "w"))
        turns = self.placed.select("k", F.lit(-1).alias("piece"), "n", "size", F.col("p").alias("u"), F.col("turn").alias("v"), F.lit(0.0).alias("w"))
        rows = both.select("k", F.pmod("u", F.col("parts")).alias("piece"), "n", "size", "u", "v", "w").unionAll(turns)

        def pack(table: pa.Table) -> pa.Table:
            u, v = (table.column(c).to_numpy() for c in "uv")
            order = np.lexsort((v, u))
            us, counts = np.unique(u, return_counts=True)
            first = table.column("piece")[0].as_py() < 0
            ws = np.zeros(0)
            if weighted and not first:
                ws = table.column("w").to_numpy()[order]
                ws = ws.astype(np.float32) if (ws == ws.astype(np.float32)).all() else ws
            return pa.table({"k": table.column("k")[:1], "first": pa.array([first]), "n": table.column("n")[:1], "size": table.column("size")[:1], "us": _raw(us), "counts": _raw(counts.astype(np.int32)), "near": _raw(v[order]), "ws": _raw(ws)})

        self.pieces = work.save(rows.groupBy("k", "piece").applyInArrow(pack, PIECES), "wide_pieces")

    def solve(self, groups: int, method: Callable, schema: str) -> DataFrame:
        """``method(k, b, graph, turns)`` of each component and each ``b`` below ``groups``; it yields record batches."""
        count = self.count * groups

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            graph = turns = at = None
            for batch in batches:
                for row in range(len(batch)):
                    us, counts, near = (np.frombuffer(batch.column(c)[row].as_buffer(), np.int32) for c in ("us", "counts", "near"))
                    if graph is None:
                        at = batch.column("k")[row].as_py(), batch.column("b")[row].as_py()
                        graph = Flat(batch.column("n")[row].as_py(), batch.column("size")[row].as_py())
                    if batch.column("first")[row].as_py():
                        turns = near
                    else:
                        raw = batch.column("ws")[row].as_buffer()
                        graph.add(us, counts, near, np.frombuffer(raw, np.float32 if raw.size == 4 * len(near) else np.float64))
            if graph is not None:
                yield from method(*at, graph, turns.copy())

        sent = self.pieces.select("*", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("b"))
        return sent.repartitionById(count, F.col("k") * groups + F.col("b")).mapInArrow(task, schema)


class Flat:
    """The neighbours of place ``u`` are ``near[starts[u] : starts[u] + length[u]]``, their weights the same of ``weight``."""

    def __init__(self, n: int, size: int):
        self.n, self.filled = n, 0
        self.starts, self.length = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.near, self.weight = np.empty(size, np.int32), None

    def add(self, us: np.ndarray, counts: np.ndarray, near: np.ndarray, weight: np.ndarray) -> None:
        at = self.filled
        self.starts[us], self.length[us] = at + np.cumsum(counts, dtype=np.int64) - counts, counts
        self.near[at : at + len(near)] = near
        if len(weight):
            if self.weight is None:
                self.weight = np.empty(len(self.near), weight.dtype)
            elif weight.dtype == np.float64 != self.weight.dtype:
                self.weight = self.weight.astype(np.float64)
            self.weight[at : at + len(near)] = weight
        self.filled += len(near)

    @classmethod
    def of(cls, s: np.ndarray, d: np.ndarray, w: np.ndarray, n: int) -> "Flat":
        """From edges, each once."""
        u, v, w = np.concatenate([s, d]), np.concatenate([d, s]), np.concatenate([w, w]).astype(float)
        order = np.lexsort((v, u))
        graph = cls(n, len(u))
        us, counts = np.unique(u, return_counts=True)
        graph.add(us, counts.astype(np.int32), v[order].astype(np.int32), w[order])
        graph.weight = np.zeros(0) if graph.weight is None else graph.weight
        return graph

    def rows(self, us: np.ndarray) -> np.ndarray:
        """The neighbours of all ``us``, row after row."""
        if not len(us):
            return np.zeros(0, np.int32)
        return np.concatenate([self.near[a:b] for a, b in zip(self.starts[us].tolist(), (self.starts[us] + self.length[us]).tolist())])


SPAN = 1 << 22  # neighbours that are looked at at once


def _spans(graph: Flat, us: np.ndarray) -> Iterator[np.ndarray]:
    """``us`` in pieces of about ``SPAN`` neighbours."""
    upto = np.cumsum(graph.length[us])
    lo = 0
    while lo < len(us):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + SPAN, "right")))
        yield us[lo:hi]
        lo = hi


def _pull(graph: Flat, us: np.ndarray, x: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
    """The sum of ``x`` over the neighbours of each of ``us``, which all have some; ``rows`` where they are known."""
    out = [np.zeros(0)]
    for some in _spans(graph, us) if rows is None else [us]:
        out.append(np.add.reduceat(x[graph.rows(some) if rows is None else rows], np.cumsum(graph.length[some]) - graph.length[some]))
    return np.concatenate(out)


def _push(graph: Flat, us: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """For every node the sum of ``x[u]`` over its neighbours ``u`` among ``us``, and the rows of ``us`` if they are few."""
    out, near, k = np.zeros(graph.n), None, 0
    for some in _spans(graph, us):
        near, k = graph.rows(some).astype(np.intp), k + 1
        out += np.bincount(near, None if (x[some] == 1).all() else np.repeat(x[some], graph.length[some]), graph.n)
    return out, near if k == 1 else None


def credits(graph: Flat, pivot: int) -> np.ndarray:
    """The share of the pivot's shortest paths that pass each node (Brandes), 0 for the pivot.

    A level is reached from the level before or from the nodes not yet met, whichever have fewer neighbours, and so on the way back.
    """
    n, length = graph.n, graph.length
    dist, paths = np.full(n, -1, np.int32), np.zeros(n)
    dist[pivot], paths[pivot] = 0, 1
    levels, left, weighs = [np.array([pivot])], n - 1, [int(length[pivot])]
    outside, rows = len(graph.near) - weighs[0], {}
    while left:
        here = levels[-1]
        if weighs[-1] <= outside:
            got, rows[len(levels) - 1] = _push(graph, here, paths)
            new = np.flatnonzero((got > 0) & (dist < 0))
            got = got[new]
        else:
            x = np.zeros(n)
            x[here] = paths[here]
            new = np.flatnonzero(dist < 0)
            got = _pull(graph, new, x)
            new, got = new[got > 0], got[got > 0]
        if not len(new):
            break
        dist[new], paths[new] = len(levels), got
        levels.append(new)
        weighs.append(int(length[new].sum()))
        left, outside = left - len(new), outside - weighs[-1]
    credit = np.zeros(n)
    for k in range(len(levels) - 1, 1, -1):
        here, above = levels[k], levels[k - 1]
        share = np.zeros(n)
        share[here] = (1 + credit[here]) / paths[here]
        got = _pull(graph, above, share, rows.get(k - 1)) if weighs[k - 1] <= weighs[k] else _push(graph, here, share)[0][above]
        credit[above] = paths[above] * got
    return credit


def credit_sums(wide: Wide, first: int, last: int) -> DataFrame:
    """``id, turn, c, cc`` as :func:`brandes.sums`; the pivots of a component are dealt over tasks that each hold its adjacency."""
    groups = max(1, -(-wide.placed.sparkSession.sparkContext.defaultParallelism // wide.count))

    def method(k: int, b: int, graph: Flat, turns: np.ndarray) -> Iterator[pa.RecordBatch]:
        pivots = np.flatnonzero((turns >= first) & (turns <= last))
        pivots = pivots[np.argsort(turns[pivots], kind="stable")][b::groups]
        for turn in np.unique(turns[pivots]):
            c, cc = np.zeros(graph.n), np.zeros(graph.n)
            for s in pivots[turns[pivots] == turn]:
                credit = credits(graph, s)
                c += credit
                cc += credit * credit
            p = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), k, np.int32)), pa.array(p.astype(np.int32)), pa.array(np.full(len(p), turn, np.int32)), pa.array(c[p]), pa.array(cc[p])], names=["k", "p", "turn", "c", "cc"])

    found = wide.solve(groups, method, "k int, p int, turn int, c double, cc double")
    found = found.groupBy("k", "p", "turn").agg(F.sum("c").alias("c"), F.sum("cc").alias("cc"))
    return wide.placed.select("id", "k", "p").join(found, ["k", "p"]).select("id", "turn", "c", "cc")
