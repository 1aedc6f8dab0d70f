"""Token-id shards compressed by Re-Pair grammars.

A shard holds the ids of consecutive documents.  Round by round the most frequent pairs of
neighbouring symbols become nonterminals and are replaced from left to right; pairs never reach
over a document's end, so each document is a run of symbols of its own.  A round counts the
shard's pairs exactly and replaces up to ``RULES_A_ROUND`` of them at once, the most frequent
first.  Rounds go on until no pair occurs ``MIN_COUNT`` times: a rule takes 12 bytes of the file and
a symbol at least 2, so rarer pairs would not pay.  A pair that a round leaves out (too many rules, or a
clash in its table) is counted anew in the next.  Every round replaces some pair, so they end.

File format of one shard (all numbers little-endian)::

    b"CLRP"  u32 version  u32 n_docs  u32 n_rules  u64 n_symbols  u32 first_nonterminal  u32 width
    i64 doc_ids[n_docs]        u32 symbols_per_doc[n_docs]     u32 tokens_per_doc[n_docs]
    u32 left[n_rules]          u32 right[n_rules]              u32 expansion_length[n_rules]
    n_symbols symbols of ``width`` bytes (2, 3 or 4) each

The expansion lengths let a reader find any token of any document without expanding what comes
before it (:meth:`Shard.slice`).
"""

from __future__ import annotations

import struct

import numpy as np

SHARD_TOKENS = 1 << 20
RULES_A_ROUND = 4096
MIN_COUNT = 12
_HEAD = struct.Struct("<4sIIIQII")
_SLOTS = 18
_BINS = 20
_MUL = np.uint64(0x9E3779B97F4A7C15)


def _slot(keys: np.ndarray) -> np.ndarray:
    return ((keys.astype(np.uint64) * _MUL) >> np.uint64(64 - _SLOTS)).astype(np.int64)


def _round(x: np.ndarray, first: np.ndarray, fresh: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """One round over symbols ``x``; ``first`` marks documents' first symbols."""
    if len(x) < 2:
        return None
    key = (x[:-1].astype(np.int64) << 32) | x[1:]
    key[first[1:]] = -1
    inside = key[key >= 0]
    bins = ((inside.astype(np.uint64) * _MUL) >> np.uint64(64 - _BINS)).astype(np.int64)
    ordered = np.sort(inside[np.bincount(bins, minlength=1 << _BINS)[bins] >= MIN_COUNT])  # no frequent pair stands in a rare bin
    if not len(ordered):
        return None
    edge = np.flatnonzero(ordered[1:] != ordered[:-1]) + 1
    start = np.concatenate([[0], edge])
    count = np.diff(np.concatenate([start, [len(ordered)]]))
    often = count >= MIN_COUNT
    pair, count = ordered[start][often], count[often]
    if not len(pair):
        return None
    best = np.argsort(-count, kind="stable")[:RULES_A_ROUND]
    pair = pair[best]
    slots = _slot(pair)
    _, keep = np.unique(slots, return_index=True)  # of pairs that share a slot, the most frequent
    pair = pair[np.sort(keep)]
    rule_at = np.zeros(1 << _SLOTS, np.int32)
    rule_at[_slot(pair)] = np.arange(1, len(pair) + 1, dtype=np.int32)
    rule = rule_at[_slot(key)]
    hit = np.flatnonzero(rule)
    hit = hit[pair[rule[hit] - 1] == key[hit]]
    if not len(hit):
        return None
    new_run = np.concatenate([[True], np.diff(hit) != 1])
    run_at = np.maximum.accumulate(np.where(new_run, np.arange(len(hit)), 0))
    hit = hit[(np.arange(len(hit)) - run_at) % 2 == 0]  # within a run of overlapping pairs, every other one
    out = x.copy()
    out[hit] = fresh + rule[hit] - 1
    keep = np.ones(len(x), bool)
    keep[hit + 1] = False
    return out[keep], first[keep], (pair >> 32).astype(np.uint32), (pair & 0xFFFFFFFF).astype(np.uint32)


def compress(doc_ids: np.ndarray, ids: np.ndarray, bounds: np.ndarray) -> bytes:
    """One shard's bytes; document ``i`` has ``ids[bounds[i]:bounds[i + 1]]``, at least one id."""
    sizes = np.diff(bounds)
    x = ids.astype(np.uint32)
    first = np.zeros(len(x), bool)
    first[bounds[:-1]] = True
    base = fresh = int(x.max(initial=0)) + 1
    left, right = [], []
    while (step := _round(x, first, fresh)) is not None:
        x, first = step[0], step[1]
        left.append(step[2])
        right.append(step[3])
        fresh += len(step[2])
    l, r = (np.concatenate(s) if s else np.zeros(0, np.uint32) for s in (left, right))
    lengths = np.ones(fresh, np.int64)
    at = base
    for a, b in zip(left, right):  # the rules of a round refer to earlier rounds only
        lengths[at : at + len(a)] = lengths[a] + lengths[b]
        at += len(a)
    per_doc = np.diff(np.append(np.flatnonzero(first), len(x)))
    width = 2 if fresh <= 1 << 16 else 3 if fresh <= 1 << 24 else 4
    raw = x.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width]
    head = _HEAD.pack(b"CLRP", 1, len(doc_ids), len(l), len(x), base, width)
    parts = [doc_ids.astype("<i8"), per_doc.astype("<u4"), sizes.astype("<u4"), l.astype("<u4"), r.astype("<u4"), lengths[base:].astype("<u4"), np.ascontiguousarray(raw)]
    return head + b"".join(p.tobytes() for p in parts)


class Shard:
    """Reader of one shard."""

    def __init__(self, blob: bytes):
        magic, version, n, m, self.n_symbols, self.base, self.width = _HEAD.unpack_from(blob)
        if magic != b"CLRP" or version != 1:
            raise ValueError("not a token shard")
        at = _HEAD.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(blob, kind, count, at)
            at += got.nbytes
            return got

        self.doc_ids = take("<i8", n)
        self.symbol_bounds = np.concatenate([[0], np.cumsum(take("<u4", n), dtype=np.int64)])
        self.token_bounds = np.concatenate([[0], np.cumsum(take("<u4", n), dtype=np.int64)])
        self.left, self.right = take("<u4", m), take("<u4", m)
        self.lengths = np.concatenate([np.ones(self.base, np.int64), take("<u4", m).astype(np.int64)])
        self._packed = np.frombuffer(blob, np.uint8, offset=at)
        self._table: tuple[np.ndarray, np.ndarray] | None = None

    def symbols(self, lo: int, hi: int) -> np.ndarray:
        """Symbols ``lo:hi`` of the shard, without unpacking others."""
        out = np.zeros((hi - lo, 4), np.uint8)
        out[:, : self.width] = self._packed[lo * self.width : hi * self.width].reshape(-1, self.width)
        return out.view("<u4")[:, 0]

    def expand(self, x: np.ndarray) -> np.ndarray:
        """The ids that symbols stand for."""
        if self._table is None:  # each rule's expansion, in order
            ends = np.cumsum(self.lengths[self.base :])
            flat = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint32)
            starts = ends - self.lengths[self.base :]
            for k, (a, b) in enumerate(zip(self.left.tolist(), self.right.tolist())):
                at = int(starts[k])
                for s in (a, b):
                    if s < self.base:
                        flat[at] = s
                        at += 1
                    else:
                        n = int(self.lengths[s])
                        src = int(starts[s - self.base])
                        flat[at : at + n] = flat[src : src + n]
                        at += n
            self._table = np.concatenate([np.arange(self.base, dtype=np.uint32), flat]), np.concatenate([np.arange(self.base), self.base + starts])
        flat, starts = self._table
        n = self.lengths[x]
        total = np.cumsum(n)
        return flat[np.repeat(starts[x] - (total - n), n) + np.arange(int(total[-1]) if len(total) else 0)]

    def document(self, i: int) -> np.ndarray:
        return self.expand(self.symbols(int(self.symbol_bounds[i]), int(self.symbol_bounds[i + 1])))

    def slice(self, i: int, lo: int, hi: int) -> np.ndarray:
        """Tokens ``lo:hi`` of document ``i``: only the symbols that cover them are expanded."""
        x = self.symbols(int(self.symbol_bounds[i]), int(self.symbol_bounds[i + 1]))
        ends = np.cumsum(self.lengths[x])
        a, b = int(np.searchsorted(ends, lo, side="right")), int(np.searchsorted(ends, hi, side="left")) + 1
        skip = lo - (int(ends[a - 1]) if a else 0)
        return self.expand(x[a:b])[skip : skip + max(0, hi - lo)]

    def all_ids(self) -> np.ndarray:
        return self.expand(self.symbols(0, self.n_symbols))
