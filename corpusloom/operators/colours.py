"""Communities in DataFrame rounds: nodes of one colour move at once.

A colouring (Luby's rounds: the uncoloured node of highest hash among its neighbours takes the least free colour)
turns a loop over nodes into a loop over colours.  Nodes of a colour are not neighbours, so what each of them sees
is what it would see if they moved one after the other; label propagation is then *equal* to the loop
in the order of ``(colour, id)``.  Louvain and Leiden sum the weights of whole communities too, which several movers of a
colour may change at once; their passes end when the quality no longer rises, and the best partition counts.

Dense graphs need as many colours as a node has neighbours.  Louvain and Leiden stop colouring after ``MAX_ROUNDS``
rounds and deal the rest to ``REST`` classes by hash; there half of the nodes keep still each time, and of
two nodes that are alone only the greater joins the lesser, so that neighbours cannot swap for ever.

Components of at most ``whole.WHOLE`` edges need no rounds: tasks solve them whole, with the same loop for labels and with
the sequential Louvain and Leiden of :mod:`community`, which know the weight of the whole graph.  For Louvain and Leiden so do those of
at most ``wide.WIDE`` edges, whose adjacency goes to a task in pieces (:mod:`moves`).

Nothing runs on the driver but counts; every table is written to scratch, and there is no bound on edges.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from . import community, moves, whole
from .graph import Graph
from .randomize import numbered
from .wide import WIDE, Flat

MAX_ROUNDS = 6
REST = 3
MAX_PASSES = 20
LEAST_GAIN = 1e-5  # of the quality (as a share of all weight) that a pass must bring to be followed by another
THETA = 0.01
DENSE_DEGREE = 256  # on average, from which rows are summed as arrays


def colour(nodes: DataFrame, both: DataFrame, work: Scratch, seed: int = 42, max_rounds: int | None = None, name: str = "colour") -> tuple[DataFrame, int]:
    """``id, colour`` and the number of proper colours; with ``max_rounds`` the rest has greater numbers, by hash."""
    c = work.save(nodes.select("id", F.struct(F.xxhash64("id", F.lit(seed)), "id").alias("h"), F.lit(None).cast("int").alias("colour")), f"{name}0")
    k = 0
    while not c.where("colour is null").isEmpty():
        if max_rounds is not None and k >= max_rounds:
            break
        k += 1
        near = both.join(c.select(F.col("id").alias("v"), F.col("h").alias("hv"), F.col("colour").alias("cv")), "v")
        seen = near.groupBy(F.col("u").alias("id")).agg(F.max(F.when(F.col("cv").isNull(), F.col("hv"))).alias("top"), F.collect_set("cv").alias("used"))
        free = F.array_min(F.array_except(F.sequence(F.lit(0), F.coalesce(F.size("used"), F.lit(0))), F.coalesce("used", F.array().cast("array<int>"))))
        wins = F.col("colour").isNull() & (F.col("top").isNull() | (F.col("h") > F.col("top")))
        c = work.save(c.join(seen, "id", "left").select("id", "h", F.when(wins, free).otherwise(F.col("colour")).alias("colour")), f"{name}{k}")
        work.drop(f"{name}{k - 1}")
    n = (c.agg(F.max("colour")).first()[0] or 0) + 1
    rest = n + F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(REST)).cast("int")
    return work.save(c.select("id", F.coalesce("colour", rest).alias("colour")), f"{name}_done"), n


def label_propagation(g: Graph, seed: int = 42, max_passes: int = 1000, most: int = whole.WHOLE) -> DataFrame:
    """``id, cluster``: asynchronous, weighted label propagation.

    Nodes change one after the other, in the order of ``(colour, id)``: each takes the label of most weight around it,
    its own if that is among the best, else the best one of least seeded hash.  It ends when no node would change.  Components of at most ``most`` edges go through the same loop in tasks.
    """
    work = Scratch(g.edges.sparkSession, "labels")
    g = Graph(work.save(g.nodes.select("id"), "nodes"), work.save(g.edges.select("src", "dst", "weight"), "edges"))
    small, large = whole.split(g, most, work)
    found = whole.solve(g, small, lambda s, d, w, h: whole.propagate_in_turn(s, d, w, h, seed, max_passes))
    if large is not None:
        found = found.unionByName(_label_rounds(large, seed, max_passes, work).withColumnRenamed("cluster", "c"))
    return g.nodes.join(found, "id", "left").select("id", F.coalesce("c", "id").alias("cluster"))


def _label_rounds(g: Graph, seed: int, max_passes: int, work: Scratch) -> DataFrame:
    both = work.save(g.both(), "both")
    classes, n = colour(g.nodes, both, work, seed)
    labels = work.save(classes.select("id", "colour", F.col("id").alias("label")), "labels0")
    step = 0
    for k in range(max_passes):
        moved = 0
        for c in range(n):
            step += 1
            now = labels.select(F.col("id").alias("v"), F.col("label").alias("vote"))
            mine = labels.where(F.col("colour") == c).select(F.col("id").alias("u"), F.col("label").alias("own"))
            votes = both.join(mine, "u").join(now, "v").groupBy("u", "own", "vote").agg(F.sum("weight").alias("w"))
            order = F.struct((-F.col("w")).alias("w"), (F.col("own") != F.col("vote")).alias("other"), F.xxhash64("vote", F.lit(seed), F.lit(k)).alias("h"))
            best = votes.groupBy("u").agg(F.min_by("vote", order).alias("best")).withColumnRenamed("u", "id")
            nxt = work.save(labels.join(best, "id", "left").select("id", "colour", F.coalesce("best", "label").alias("label"), (F.coalesce("best", "label") != F.col("label")).alias("moved")), f"labels{step}")
            moved += nxt.where("moved").count()
            work.drop(f"labels{step - 1}")
            labels = nxt.select("id", "colour", "label")
        if not moved:
            return labels.select("id", F.col("label").alias("cluster"))
    raise RuntimeError(f"labels did not settle in {max_passes} passes")


class _Level:
    """A graph of numbered nodes ``id, own`` (degree, or size), edges ``u, v, w`` both ways, and its classes."""

    def __init__(self, nodes: DataFrame, both: DataFrame, gamma: float, total: float, seed: int, work: Scratch, name: str):
        self.nodes, self.both, self.gamma, self.total, self.seed, self.work, self.name = nodes, both, gamma, total, seed, work, name
        self.classes, self.proper = colour(nodes, both, work, seed, MAX_ROUNDS, f"{name}_colour")
        self.n_classes = (self.classes.agg(F.max("colour")).first()[0] or 0) + 1
        self.step = 0

    def save(self, df: DataFrame, what: str) -> DataFrame:
        self.step += 1
        return self.work.save(df, f"{self.name}_{what}{self.step}")

    def quality(self, state: DataFrame) -> float:
        """Ties inside communities less what ``gamma`` expects, as a share of all weight."""
        c = state.select(F.col("id").alias("u"), F.col("c").alias("cu"))
        d = state.select(F.col("id").alias("v"), F.col("c").alias("cv"))
        inside = self.both.join(c, "u").join(d, "v").where("cu = cv").agg(F.sum("w").alias("x"))
        held = state.groupBy("c").agg(F.sum("own").alias("t")).agg((-self.gamma * F.sum(F.col("t") * F.col("t"))).alias("x"))
        return inside.unionByName(held).agg(F.sum("x")).first()[0] or 0.0

    def move(self, state: DataFrame) -> tuple[DataFrame, bool]:
        """``id, own, c`` after passes over the classes, and whether any node moved."""
        state = state.select("id", "own", "c")
        best, score, any_move = state, self.quality(state), False
        for k in range(MAX_PASSES):
            for c in range(self.n_classes):
                state = self.save(self._moved(state, c, k), "state")
            now = self.quality(state)
            if now > score + 1e-12 * abs(self.total):
                any_move = True
                best, gain, score = state, now - score, now
                if gain < LEAST_GAIN * self.total:
                    break
            else:
                break
        return best, any_move

    def _moved(self, state: DataFrame, c: int, k: int) -> DataFrame:
        mine = self.classes.where(F.col("colour") == c).select("id")
        if c >= self.proper:
            mine = mine.where(F.pmod(F.xxhash64("id", F.lit(self.seed), F.lit(k)), F.lit(2)) == 0)
        u = state.join(mine, "id", "left_semi").select(F.col("id").alias("u"), F.col("own").alias("ku"), F.col("c").alias("cu"))
        near = self.both.join(u, "u").join(state.select(F.col("id").alias("v"), F.col("c").alias("to")), "v").select("u", "ku", "cu", "to", "w")
        near = near.unionByName(u.select("u", "ku", "cu", F.col("cu").alias("to"), F.lit(0.0).alias("w")))
        sums = near.groupBy("u", "ku", "cu", "to").agg(F.sum("w").alias("w"))
        held = state.groupBy(F.col("c").alias("to")).agg(F.sum("own").alias("t"), F.count("*").alias("members"))
        j = sums.join(held, "to").withColumn("stay", F.col("to") == F.col("cu"))
        gain = F.col("w") - self.gamma * F.col("ku") * (F.col("t") - F.when(F.col("stay"), F.col("ku")).otherwise(0.0))
        j = j.withColumn("gain", gain)
        if c >= self.proper:  # of two that are alone, the greater joins the lesser
            alone = j.groupBy("u").agg(F.max(F.when(F.col("stay"), F.col("members"))).alias("own_members"))
            j = j.join(alone, "u").where(~((F.col("members") == 1) & (F.col("own_members") == 1) & ~F.col("stay") & (F.col("to") > F.col("cu"))))
        pick = j.groupBy("u").agg(F.max_by("to", F.struct("gain", "stay", -F.col("to"))).alias("to"), F.max("gain").alias("gain"), F.max(F.when(F.col("stay"), F.col("gain"))).alias("own_gain"))
        pick = pick.where(F.col("gain") > F.col("own_gain") + 1e-12 * max(1.0, self.total)).select(F.col("u").alias("id"), "to")
        return state.join(pick, "id", "left").select("id", "own", F.coalesce("to", "c").alias("c"))

    def refine(self, state: DataFrame, norm: float) -> DataFrame:
        """``id, own, c, part``: communities broken up into well-connected parts, by single nodes that join a part.

        A node that is alone and tied well enough to its community joins one of the parts that gain, drawn with odds
        that rise with the gain; the part must be tied well enough to the rest too.
        """
        s = self.save(state.select("id", "own", "c", F.col("id").alias("part")), "parts")
        cu, cv = (state.select(F.col("id").alias(x), F.col("c").alias(f"c{x}")) for x in "uv")
        inner = self.save(self.both.join(cu, "u").join(cv, "v").where("cu = cv").select("u", "v", "w", F.col("cu").alias("c")), "inner")
        whole = self.save(state.groupBy("c").agg(F.sum("own").alias("whole")), "whole")
        ties = inner.groupBy(F.col("u").alias("id")).agg(F.sum("w").alias("ties"))
        for c in range(self.n_classes):
            pu, pv = (s.select(F.col("id").alias(x), F.col("part").alias(f"p{x}")) for x in "uv")
            parts = s.groupBy("part", "c").agg(F.sum("own").alias("weight"), F.count("*").alias("members")).join(whole, "c")
            across = inner.join(pu, "u").join(pv, "v").where("pu <> pv")
            out = across.groupBy(F.col("pu").alias("part")).agg(F.sum("w").alias("out"))
            parts = parts.join(out, "part", "left").na.fill(0.0, ["out"])
            firm = lambda w, out: F.col(out) >= self.gamma * F.col(w) * (F.col("whole") - F.col(w)) - 1e-12
            lone = parts.where("members = 1").select("part", "whole")
            mine = self.classes.where(F.col("colour") == c).select("id")
            mine = s.join(mine, "id", "left_semi").join(lone, "part").join(ties, "id").where(firm("own", "ties"))
            mine = mine.where(F.col("part") == F.col("id")).select(F.col("id").alias("u"), "own")
            near = across.join(mine, "u").groupBy("u", "own", F.col("pv").alias("part")).agg(F.sum("w").alias("w")).join(parts.where(firm("weight", "out")).select("part", "weight"), "part")
            gain = F.col("w") - self.gamma * F.col("own") * F.col("weight")
            draw = (F.pmod(F.xxhash64("u", "part", F.lit(self.seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
            near = near.withColumn("gain", gain).where("gain >= 0").withColumn("luck", F.col("gain") / norm - F.log(-F.log(draw)))
            pick = near.groupBy("u").agg(F.max_by("part", F.struct("luck", -F.col("part"))).alias("to")).withColumnRenamed("u", "id")
            s = self.save(s.join(pick, "id", "left").select("id", "own", "c", F.coalesce("to", "part").alias("part")), "parts")
        return s


def _contract(level: _Level, state: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """Nodes ``id, own, c`` and edges of the graph whose nodes are the groups ``by``."""
    nodes = level.save(state.groupBy(F.col(by).alias("id")).agg(F.sum("own").alias("own"), F.min("c").alias("c")), "nodes")
    a, b = (state.select(F.col("id").alias(x), F.col(by).alias(f"g{x}")) for x in "uv")
    e = level.both.join(a, "u").join(b, "v").where("gu <> gv").groupBy(F.col("gu").alias("u"), F.col("gv").alias("v")).agg(F.sum("w").alias("w"))
    return nodes, level.save(e, "edges")


def _communities(g: Graph, seed: int, resolution: float, objective: str, refined: bool, most: int, held_edges: int | None = None) -> DataFrame:
    if objective not in ("modularity", "cpm"):
        raise ValueError(objective)
    work = Scratch(g.edges.sparkSession, "communities")
    g = Graph(work.save(g.nodes.select("id"), "given_nodes"), work.save(g.edges.select("src", "dst", F.col("weight").cast("double").alias("weight")), "given_edges"))
    total = 2 * g.edges.agg(F.coalesce(F.sum("weight"), F.lit(0.0))).first()[0]
    small, large = whole.split(g, most, work)

    def flat(x: Flat) -> np.ndarray:
        if refined:
            return moves.leiden(x, seed, resolution, objective == "cpm", total)
        return _as_places(moves.louvain(x, seed, resolution, total))

    def method(s, d, w, hashes):
        n = len(hashes)
        if 2 * len(s) >= DENSE_DEGREE * n and (w > 0).all():
            return flat(Flat.of(s, d, w, n))
        adj, ids = whole.neighbours(s, d, w, n), list(range(n))
        if refined:
            found = community._leiden(ids, adj, seed, resolution, objective == "cpm", m2=total)
        else:
            found = community._levels(ids, adj, seed, resolution, total)
        return np.array([found[u] for u in ids])

    found = whole.solve(g, small, method)
    if large is not None and large.edges.where("weight <= 0").isEmpty():
        held, large = whole.held(large, WIDE if held_edges is None else held_edges, work)
        if held is not None:
            found = found.unionByName(whole.solve_wide(held, flat))
    if large is not None:
        found = found.unionByName(_rounds(large, seed, resolution, objective, refined, total, work))
    return whole.numbered_by_size(g.nodes, found, work)


def _as_places(names: np.ndarray) -> np.ndarray:
    """A place of each group in place of its name."""
    _, least, of = np.unique(names, return_index=True, return_inverse=True)
    return least[of]


def _rounds(g: Graph, seed: int, resolution: float, objective: str, refined: bool, total: float, work: Scratch) -> DataFrame:
    """``id, c``; ``total`` is the weight of the whole graph, both ways."""
    ids, _ = numbered(g.nodes.select("id"), work)
    a, b = ids.select(F.col("id").alias("u"), F.col("n").alias("p")), ids.select(F.col("id").alias("v"), F.col("n").alias("q"))
    both = work.save(g.both().join(a, "u").join(b, "v").select(F.col("p").alias("u"), F.col("q").alias("v"), F.col("weight").cast("double").alias("w")), "both")
    own = F.lit(1.0)
    nodes = ids.select(F.col("n").alias("id"))
    if objective == "modularity":
        nodes = nodes.join(both.groupBy(F.col("u").alias("id")).agg(F.sum("w").alias("own")), "id", "left")
        own = F.coalesce("own", F.lit(0.0))
    nodes = work.save(nodes.select("id", own.alias("own"), F.col("id").alias("c")), "nodes")
    gamma = resolution / total if objective == "modularity" and total else resolution
    where = ids.select(F.col("id").alias("name"), F.col("n").alias("at"))
    level = 0
    while total:
        one = _Level(nodes.select("id", "own"), both, gamma, total, seed + level, work, f"level{level}")
        state, moved = one.move(nodes)
        n, n_groups = nodes.count(), state.select("c").distinct().count()
        by = state.withColumn("part", F.col("c"))
        if refined and n_groups < n:
            by = one.refine(state, THETA * (total if objective == "modularity" else 1.0))
            if by.select("part").distinct().count() == n:  # nothing could be joined: merge the communities themselves
                by = by.withColumn("part", F.col("c")) if moved else None
        elif n_groups == n:
            by = None
        if by is None:
            nodes = state
            break
        where = work.save(where.join(by.select(F.col("id").alias("at"), "part"), "at").select("name", F.col("part").alias("at")), f"where{level}")
        nodes, both = _contract(one, by, "part")
        level += 1
        if not refined and not moved:
            break
    last = nodes.select(F.col("id").alias("at"), "c")
    found = where.join(last, "at").select(F.col("name").alias("id"), "c")
    least = found.groupBy("c").agg(F.min("id").alias("least"))
    return found.join(least, "c").select("id", F.col("least").alias("c"))


def louvain(g: Graph, seed: int = 42, resolution: float = 1.0, most: int = whole.WHOLE, held: int | None = None) -> DataFrame:
    """``id, cluster`` by the Louvain method, weighted; clusters are numbered by size, then by least id.

    Components of more than ``most`` and at most ``held`` (``wide.WIDE``) edges go to a task in pieces, larger ones through rounds.
    """
    return _communities(g, seed, resolution, "modularity", False, most, held)


def leiden(g: Graph, seed: int = 42, resolution: float = 1.0, objective: str = "cpm", most: int = whole.WHOLE, held: int | None = None) -> DataFrame:
    """``id, cluster`` by the Leiden method, weighted: as :func:`louvain`, with communities refined before they are merged."""
    return _communities(g, seed, resolution, objective, True, most, held)
