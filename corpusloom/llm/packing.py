"""Best-fit packing of documents into sequences of ``SIZE`` tokens.

Only lengths decide a packing, and there are at most ``SIZE`` of them, so the plan is made on the
driver from the histogram of piece lengths (``SIZE`` numbers, whatever the corpus) and applied to
the pieces in parallel.

The plan starts from best-fit decreasing over *groups*, sets of bins with equal contents: all
documents of a length go at once into the groups with the least room that still fits them.  A
local search then works on the underfull bins: from the emptiest bin on, it looks for the exchange
with any bin at least as full that raises the sum of squared fills most: a document or two moved
over, one exchanged for a smaller one there, or two for one.  Bins that run empty are saved.  The search
ends at the lower bound ``ceil(tokens / SIZE)``, when no exchange of any bin is left, or when it has
converged: ``WINDOW`` exchanges in a row saved less than ``LEAST_GAIN`` of the bins.

Defined results: a null text is empty and gives one piece, the separator; longer documents than
``SIZE`` are cut, all others stay whole; repeated rows are packed as often as they occur, also those of a
null id; pieces of equal length are told apart by id, place and checksum, and rows equal in all of these are
interchangeable; an empty table gives an empty result; further columns are ignored.  A very long text is
encoded in spans; its ids must fit a task.
"""

from __future__ import annotations

import bisect
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc32_ids, pieces
from .encode import encoder
from .token_output import _with_end

SIZE = 2048
SEPARATOR = 0
RANK_ROWS = 1_000
WINDOW = 1000
LEAST_GAIN = 0.0005
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

Bin = tuple[int, ...]


def best_fit(histogram: dict[int, int], size: int = SIZE) -> Counter[Bin]:
    """Bins by best-fit decreasing: sorted contents and how many bins have them."""
    rooms: dict[int, Counter[Bin]] = {}
    order: list[int] = []  # the rooms that occur, ascending

    def put(room: int, contents: Bin, k: int) -> None:
        if room not in rooms:
            rooms[room] = Counter()
            bisect.insort(order, room)
        rooms[room][contents] += k

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            at = bisect.bisect_left(order, length)
            if at == len(order):
                each = size // length
                if left >= each:
                    put(size - each * length, (length,) * each, left // each)
                if left % each:
                    put(size - left % each * length, (length,) * (left % each), 1)
                left = 0
                continue
            room = order[at]
            contents, n = next(iter(rooms[room].items()))
            k = min(n, left)
            rooms[room][contents] -= k
            if not rooms[room][contents]:
                del rooms[room][contents]
                if not rooms[room]:
                    del rooms[room]
                    order.pop(at)
            put(room - length, (*contents, length), k)
            left -= k
    out: Counter[Bin] = Counter()
    for group in rooms.values():
        out.update(group)
    return out


def _without(contents: Bin, *items: int) -> list[int]:
    rest = list(contents)
    for x in items:
        rest.remove(x)
    return rest


def _as_bin(contents) -> Bin:
    return tuple(sorted(contents, reverse=True))


class _Underfull:
    """All underfull groups as rows ``(taken, room)``: what an exchange may take from a bin, 0 for nothing."""

    def __init__(self, size: int):
        self.size = size
        self.taken, self.room, self.owner = (np.zeros(64, np.int64) for _ in range(3))
        self.rows: dict[Bin, list[int]] = {}
        self.names: dict[int, Bin] = {}
        self.free: list[int] = list(range(63, -1, -1))

    def add(self, contents: Bin) -> None:
        room, own = self.size - sum(contents), []
        if room:
            for x in [0, *sorted(set(contents))]:
                if not self.free:
                    n = len(self.taken)
                    self.free = list(range(2 * n - 1, n - 1, -1))
                    self.taken, self.room, self.owner = (np.concatenate([c, np.zeros(n, np.int64)]) for c in (self.taken, self.room, self.owner))
                row = self.free.pop()
                self.taken[row], self.room[row], self.owner[row] = x, room, own[0] if own else row
                own.append(row)
            self.rows[contents], self.names[own[0]] = own, contents

    def drop(self, contents: Bin) -> None:
        own = self.rows.pop(contents, [])
        if own:
            self.room[own] = 0
            self.free += own
            del self.names[own[0]]

    def best(self, groups: dict[Bin, int]) -> tuple[Bin, Bin, Bin, Bin] | None:
        """The best exchange out of the emptiest bin that has one: ``(from, to, new from, new to)``."""
        for source in sorted(self.rows, key=lambda g: (sum(g), g)):
            limit = self.size - sum(source)
            given: dict[int, tuple] = {}
            for i, x in enumerate(source):
                given.setdefault(x, (x,))
                for y in source[i + 1 :]:
                    given.setdefault(x + y, (x, y))
            ok = (self.room > 0) & (self.room <= limit)
            if groups[source] < 2:
                ok[self.rows[source]] = False
            to = np.flatnonzero(ok)
            moved = np.array(list(given), np.int64)[:, None] - self.taken[to]
            gain = np.where((moved > 0) & (moved <= self.room[to]), moved * (limit - self.room[to] + moved), 0)
            if gain.size and (at := int(gain.argmax())) >= 0 and gain.flat[at] > 0:
                row = to[at % len(to)]
                out, target = given[list(given)[at // len(to)]], self.names[int(self.owner[row])]
                back = (int(self.taken[row]),) if self.taken[row] else ()
                return source, target, _as_bin([*_without(source, *out), *back]), _as_bin([*_without(target, *back), *out])
        return None


def local_search(bins: Counter[Bin], size: int = SIZE) -> Counter[Bin]:
    """Exchange documents between underfull bins until bins run empty; groups move together."""
    groups: dict[Bin, int] = {}
    for contents, n in bins.items():
        groups[_as_bin(contents)] = groups.get(_as_bin(contents), 0) + n
    under = _Underfull(size)
    for g in groups:
        under.add(g)
    least = -(-sum(sum(g) * n for g, n in groups.items()) // size)
    n_bins = before = sum(groups.values())
    step = 0
    while n_bins > least and (found := under.best(groups)):
        source, target, new_source, new_target = found
        k = groups[source] // 2 if source == target else min(groups[source], groups[target])
        n_bins -= 0 if new_source else k
        for g, d in ((source, -k), (target, -k), (new_source, k), (new_target, k)):
            if g:
                if g not in groups:
                    under.add(g)
                groups[g] = groups.get(g, 0) + d
                if not groups[g]:
                    del groups[g]
                    under.drop(g)
        step += 1
        if step % WINDOW == 0:
            if before - n_bins < LEAST_GAIN * before:
                break
            before = n_bins
    return Counter(groups)


def plan(histogram: dict[int, int], size: int = SIZE) -> Counter[Bin]:
    return local_search(best_fit({k: v for k, v in histogram.items() if v}, size), size)


def slots(bins: Counter[Bin]) -> dict[str, np.ndarray]:
    """For the ``k``-th piece of a length: the interval that holds ``k`` names its bin and place.

    Intervals are sorted by ``length << 40 | first rank``; piece ``k`` goes to sequence
    ``base + k - rank`` at ``offset``.
    """
    used: Counter[int] = Counter()
    rows, base = [], 0
    for contents, n in sorted(bins.items(), reverse=True):
        offset = 0
        for length in contents:
            rows.append((length << 40 | used[length], used[length], base, offset))
            used[length] += n
            offset += length
        base += n
    cols = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return {"key": cols[:, 0].copy(), "rank": cols[:, 1].copy(), "base": cols[:, 2].copy(), "offset": cols[:, 3].copy()}


def cut(documents: DataFrame, tokenizer: str, size: int = SIZE, separator: int = SEPARATOR) -> DataFrame:
    """The pieces of all documents: ``doc_id, piece, start, length, ids_crc32``."""

    def task(batches):
        enc = encoder(tokenizer)
        for batch in batches:
            for part in pieces(batch, "text", 2_000_000):
                x, b = _with_end(*enc.encode(part.column(1).to_pylist()), separator)
                n = -(-np.diff(b) // size)
                doc = np.repeat(np.arange(len(n)), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                lo = b[doc] + piece * size
                hi = np.minimum(lo + size, b[doc + 1])
                crc = [crc32_ids(x[i:j]) for i, j in zip(lo.tolist(), hi.tolist())]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(piece * size), pa.array(hi - lo), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, _PIECES)


def pack(cut_pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """``sequence_id`` and ``offset`` for a stored table of pieces (it is read twice).

    Pieces of a length are numbered in salted parts of about ``RANK_ROWS`` rows, however common
    the length is.
    """
    spark = cut_pieces.sparkSession
    histogram = {r["length"]: r["count"] for r in cut_pieces.groupBy("length").count().collect()}
    place = spark.sparkContext.broadcast(slots(plan(histogram, size)))
    parts = spark.createDataFrame([(k, -(-v // RANK_ROWS)) for k, v in histogram.items()], "length long, parts long")  # a row a length
    p = cut_pieces.join(F.broadcast(parts), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.col("parts")))
    sums = p.groupBy("length", "salt").count()
    sums = sums.select(F.col("length").alias("l"), F.col("salt").alias("s"), F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    p = p.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    p = p.join(sums, (p.length == sums.l) & (p.salt == sums.s)).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))

    def task(batches):
        t = place.value
        for b in batches:
            rank, length = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("rank", "length"))
            at = np.searchsorted(t["key"], length.astype(np.int64) << 40 | rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(t["base"][at] + rank - t["rank"][at]), pa.array(t["offset"][at])], names=[*b.schema.names[:5], "sequence_id", "offset"])

    return p.mapInArrow(task, f"{_PIECES}, sequence_id long, offset long")
