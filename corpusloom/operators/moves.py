"""Louvain, Leiden and greedy modularity of :mod:`community` over flat arrays (:class:`wide.Flat`), with the same moves.

A node's ties are summed over its whole row at once, so dense graphs cost a few array operations a node and 8 or 12 bytes an edge
and direction.  Weights are above 0.  Communities are named by places; of equal gains the least name wins, as in the loops over dicts.
"""

from __future__ import annotations

import math
import random

import numpy as np

from .wide import Flat


def _sums(g: Flat) -> np.ndarray:
    """The weight of each row."""
    some = np.flatnonzero(g.length)
    some = some[np.argsort(g.starts[some])]
    out = np.zeros(g.n)
    if len(some):
        out[some] = np.add.reduceat(g.weight, g.starts[some], dtype=np.float64)
    return out


def _move(g: Flat, loops: np.ndarray, comm: np.ndarray, order: list, gamma: float, size: np.ndarray | None, m2: float) -> bool:
    """As :func:`community._move`; ``comm`` is changed."""
    if m2 == 0:
        return False
    mass = _sums(g) + 2 * loops if size is None else size
    tot, acc = np.bincount(comm, mass, g.n), np.zeros(g.n)
    starts, ends, near, weight = g.starts.tolist(), (g.starts + g.length).tolist(), g.near, g.weight
    any_move, again = False, True
    while again:
        again = False
        for u in order:
            a, b, own, c0 = starts[u], ends[u], mass[u], comm[u]
            cc = comm[near[a:b]]
            acc[cc] = 0.0
            acc[c0] = 0.0
            np.add.at(acc, cc, weight[a:b].astype(np.float64))
            tot[c0] -= own
            cost = gamma * own / m2 if size is None else gamma * own
            best, gain = c0, acc[c0] - cost * tot[c0]
            x = acc[cc] - cost * tot[cc]
            top = x.max(initial=-np.inf)
            if top > gain + 1e-12:
                for c in np.unique(cc[x >= top - 1e-9]).tolist():
                    y = acc[c] - cost * tot[c]
                    if y > gain + 1e-12:
                        best, gain = c, y
            tot[best] += own
            if best != c0:
                comm[u], again, any_move = best, True, True
    return any_move


def _row(g: Flat, us: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(us) == 1:
        a = g.starts[us[0]]
        return g.near[a : a + g.length[us[0]]], g.weight[a : a + g.length[us[0]]]
    spans = list(zip(g.starts[us].tolist(), (g.starts[us] + g.length[us]).tolist()))
    return np.concatenate([g.near[a:b] for a, b in spans]), np.concatenate([g.weight[a:b] for a, b in spans])


def _summed(names: np.ndarray, w: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct names below ``n`` and their weights."""
    if 8 * len(names) > n:
        sums = np.bincount(names, w, n)
        some = np.flatnonzero(sums)
        return some, sums[some]
    some, place = np.unique(names, return_inverse=True)
    return some, np.bincount(place, w, len(some))


def _merge(g: Flat, loops: np.ndarray, part: np.ndarray, k: int) -> tuple[Flat, np.ndarray]:
    """The graph of the parts ``0 .. k - 1`` and their loops."""
    order = np.argsort(part, kind="stable")
    at = np.searchsorted(part[order], np.arange(k + 1))
    inner = np.bincount(part, loops, k)
    new = Flat(k, len(g.near))  # at most
    new.weight = np.empty(len(g.near))
    for c in range(k):
        near, w = _row(g, order[at[c] : at[c + 1]])
        names, sums = _summed(part[near], w, k)
        own = names == c
        if own.any():
            inner[c] += sums[own][0] / 2
            names, sums = names[~own], sums[~own]
        a = new.filled
        new.near[a : a + len(names)], new.weight[a : a + len(names)] = names, sums
        new.starts[c], new.length[c] = a, len(names)
        new.filled += len(names)
    new.near, new.weight = new.near[: new.filled], new.weight[: new.filled]
    return new, inner


def louvain(g: Flat, seed: int, gamma: float, m2: float) -> np.ndarray:
    """The communities of :func:`community._levels`."""
    rng = random.Random(seed)
    loops, where = np.zeros(g.n), np.arange(g.n)
    while True:
        comm, order = np.arange(g.n), list(range(g.n))
        rng.shuffle(order)
        if not _move(g, loops, comm, order, gamma, None, m2):
            return where
        names, part = np.unique(comm, return_inverse=True)
        where, before = part[where], g.n
        g, loops = _merge(g, loops, part, len(names))
        if g.n == before:
            return where


def _refine(g: Flat, loops: np.ndarray, comm: np.ndarray, gamma: float, size: np.ndarray | None, rng: random.Random, m2: float, theta: float = 0.01) -> np.ndarray:
    """As :func:`community._refine`."""
    own = _sums(g) + 2 * loops if size is None else size
    scale = gamma / m2 if size is None else gamma
    whole = np.bincount(comm, own, g.n)
    part, weight, alone = np.arange(g.n), own.copy(), np.ones(g.n, bool)
    outside = np.zeros(g.n)
    starts, ends = g.starts.tolist(), (g.starts + g.length).tolist()
    for u in range(g.n):
        outside[u] = g.weight[starts[u] : ends[u]][comm[g.near[starts[u] : ends[u]]] == comm[u]].sum(dtype=np.float64)
    order = list(range(g.n))
    rng.shuffle(order)
    norm = theta * (m2 if size is None else 1.0)
    for u in order:
        c = comm[u]
        if not alone[u] or outside[u] < scale * own[u] * (whole[c] - own[u]) - 1e-12:
            continue
        near = g.near[starts[u] : ends[u]]
        inside = comm[near] == c
        p, w = _summed(part[near[inside]], g.weight[starts[u] : ends[u]][inside], g.n)
        gain = w - scale * own[u] * weight[p]
        ok = (p != u) & (gain >= 0) & (outside[p] >= scale * weight[p] * (whole[c] - weight[p]) - 1e-12)
        if not ok.any():
            continue
        p, w, gain = p[ok], w[ok], gain[ok]
        k = rng.choices(range(len(p)), [math.exp(x) for x in ((gain - gain.max()) / norm).tolist()])[0]
        to = int(p[k])
        outside[to] += outside[u] - 2 * w[k]
        weight[to] += own[u]
        part[u] = to
        alone[u] = alone[to] = False
    return part


def leiden(g: Flat, seed: int, gamma: float, potts: bool, m2: float, iterations: int = 2) -> np.ndarray:
    """The communities of :func:`community._leiden`."""
    rng = random.Random(seed)
    comm = np.arange(g.n)
    for _ in range(iterations):
        comm = _leiden_pass(g, rng, gamma, potts, comm, m2)
    return comm


def _leiden_pass(g: Flat, rng: random.Random, gamma: float, potts: bool, comm: np.ndarray, m2: float) -> np.ndarray:
    loops, where = np.zeros(g.n), np.arange(g.n)
    size, comm, ids = np.ones(g.n) if potts else None, comm.copy(), np.arange(g.n)  # ids: the names that the loops over dicts keep
    while True:
        order = list(range(g.n))
        rng.shuffle(order)
        moved = _move(g, loops, comm, order, gamma, size, m2)
        if len(np.unique(comm)) == g.n:
            break
        part = _refine(g, loops, comm, gamma, size, rng, m2)
        if len(np.unique(part)) == g.n:
            if not moved:
                break
            part = comm  # nothing could be joined: merge the communities themselves
        names, part = np.unique(part, return_inverse=True)
        where, ids = part[where], ids[names]
        if size is not None:
            size = np.bincount(part, size, len(names))
        above = np.zeros(len(names), np.int64)
        above[part] = comm
        g, loops = _merge(g, loops, part, len(names))
        _, least, of = np.unique(above, return_index=True, return_inverse=True)
        comm = least[of]
    return ids[comm][where]


def greedy(g: Flat, m2: float) -> np.ndarray:
    """The communities of :func:`community._greedy`.

    Neighbours are in order.  A row knows the best of its partners that follow it.  Where that partner was joined, its gain is kept as a bound, and the row is looked
    through when the bound comes first.  Rows name what was joined since by its old name until then.
    """
    n = g.n
    deg, cluster = _sums(g), np.arange(n)
    rows = [(g.near[a:b], g.weight[a:b]) for a, b in zip(g.starts.tolist(), (g.starts + g.length).tolist())]
    best, gain, stale = np.full(n, -1), np.full(n, -np.inf), np.zeros(n, bool)

    def look(a: int, fresh: bool = False) -> None:
        near, w = rows[a]
        if not fresh:
            near, w = _summed(cluster[near], w, n)
            rows[a] = near.astype(np.int32), w
        some = near > a
        best[a], gain[a], stale[a] = -1, -np.inf, False
        if some.any():
            near = near[some]
            x = w[some].astype(np.float64) / m2 - deg[a] * deg[near] / (m2 * m2)
            k = int(x.argmax())
            best[a], gain[a] = near[k], x[k]

    for a in range(n):
        look(a, True)
    while n:
        a = int(gain.argmax())
        if gain[a] <= 1e-15:
            break
        if stale[a]:
            look(a)
            continue
        b = int(best[a])
        cluster[cluster == b] = a
        near, w = (np.concatenate(x) for x in zip(rows[a], rows[b]))
        near, w = _summed(cluster[near], w, n)
        keep = near != a
        near, w = near[keep], w[keep]
        rows[a], rows[b] = (near.astype(np.int32), w), (np.zeros(0, np.int32), np.zeros(0))
        deg[a] += deg[b]
        deg[b] = 0
        best[b], gain[b], stale[b] = -1, -np.inf, False
        stale[:b][(best[:b] == a) | (best[:b] == b)] = True
        low = near < a
        p = near[low]
        x = w[low] / m2 - deg[p] * deg[a] / (m2 * m2)
        up = (x > gain[p]) | (x == gain[p]) & ~stale[p] & (a < best[p])
        best[p[up]], gain[p[up]], stale[p[up]] = a, x[up], False
        look(a, True)
    return cluster
