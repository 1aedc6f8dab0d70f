"""SuperMinHash signatures, vectorised over a batch of sets.

Every element draws a random permutation of the ``m`` slots.  At level ``k`` it offers its
``k``-th slot the value ``k + r`` with ``r`` uniform in ``[0, 1)``; a slot keeps the least
offer.  Because one element visits all slots in *different* levels, the slots of a signature are
negatively correlated and the estimate has less variance than independent minima.  A set stops
after the first level that lies above its largest slot value: nothing later can lower any slot.

The permutation comes from the Fisher-Yates shuffle, run one step per level, so that elements of
stopped sets cost nothing more.  Values are kept as integers ``k * 2**32 + r``.
"""

from __future__ import annotations

import numpy as np

from .common import mix64

EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_LOW = np.uint64(0xFFFFFFFF)


def _draw(elements: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 32-bit draws per element and level."""
    x = mix64(elements + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    return x & _LOW, x >> np.uint64(32)


def superminhash(elements: np.ndarray, bounds: np.ndarray, m: int) -> np.ndarray:
    """Signatures ``[n_sets, m]``; set ``i`` is ``elements[bounds[i]:bounds[i + 1]]`` (distinct).

    An empty set has ``EMPTY`` in every slot.
    """
    n = len(bounds) - 1
    sig = np.full(n * m, EMPTY, dtype=np.uint64)
    owner = np.repeat(np.arange(n, dtype=np.int64), np.diff(bounds))
    r, pick = _draw(elements, 0)
    np.minimum.at(sig, owner * m + (pick * np.uint64(m) >> np.uint64(32)).astype(np.int64), r)
    perm = None
    for level in range(1, m):
        top = sig.reshape(n, m).max(axis=1) >> np.uint64(32)
        go = (top >= level)[owner] if len(owner) else np.zeros(0, bool)
        if not go.any():
            break
        if perm is None:  # the first step again, now with the shuffles' state
            elements, owner, pick = elements[go], owner[go], pick[go]
            perm = np.tile(np.arange(m, dtype=np.uint16), (len(elements), 1))
            j = (pick * np.uint64(m) >> np.uint64(32)).astype(np.int64)
            rows = np.arange(len(elements))
            perm[rows, j], perm[:, 0] = perm[:, 0].copy(), perm[rows, j].copy()
        elif not go.all():
            elements, owner, perm = elements[go], owner[go], perm[go]
        r, pick = _draw(elements, level)
        rows = np.arange(len(elements))
        j = level + (pick * np.uint64(m - level) >> np.uint64(32)).astype(np.int64)
        slot = perm[rows, j].astype(np.int64)
        perm[rows, j] = perm[:, level]
        perm[:, level] = slot
        np.minimum.at(sig, owner * m + slot, r + np.uint64(level << 32))
    return sig.reshape(n, m)


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band of ``rows`` consecutive slots: ``[n_sets, m // rows]``."""
    n, m = sig.shape
    bands = sig.reshape(n, m // rows, rows)
    acc = np.zeros(bands.shape[:2], np.uint64)
    for j in range(rows):
        acc = mix64(acc * np.uint64(0x100000001B3) + bands[:, :, j])
    return acc
