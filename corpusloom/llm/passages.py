"""Removal of repeated passages: windows of 50 words, a count-min prefilter, then exact groups.

Texts are packed once into *units* of about ``UNIT_BYTES`` and stored, bucketed by the input partition they came
from.  What later steps learn about a unit comes back to it as a few bits, so texts are never shuffled:
the joins move the answers to the bucketed table.

1. *Sketch.*  A window's key is the least hash of its runs of ``ANCHOR`` words (its minimiser): equal windows have
   equal keys, and neighbouring windows mostly share one, so a unit has about one key for 13 windows.  Each unit
   counts, for every key, the documents that hold it (1, or 2 for more) in the cells of two rows of a
   count-min sketch; the sketches of all units are merged block by block of cells.  A cell's count is never less
   than the documents that hold one of its windows, so a window that two documents share is never lost.
   The sketch grows with the input (at least four cells a key) and no task holds more than a block of it.
2. *Exact groups.*  Only windows that both cells estimate as repeated go on: of each distinct one, two hashes (96
   bits) and the least ``doc_id`` of the unit.  Ranges of hashes are grouped, and a bit says whether another unit
   has the window in a document of lesser id.  A window in a third of all documents is one entry a unit.
3. *Removal.*  Each unit drops the words covered by windows that a document of lesser id has, in the unit or elsewhere.

Words are hashed by keyed tabulation, a window by two independent polynomials of two independent word hashes.

Defined results: a null text has no words; a text under 50 words is kept whole; rows of a null id are
kept whole and remove nothing; rows of one id never remove each other; repeated rows give repeated
results; ids may be of any type with an order; an empty table gives an empty result; other columns are ignored.
A very long text is a unit of its own.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, mix64, pieces, string_buffers, words

WINDOW = 50
ANCHOR = 25
UNIT_BYTES = 2_000_000
CELL_BITS = 24  # of a block of the sketch at most: 16 million cells, about 4 million keys
RANGE_BITS = 22  # so many windows at most in a range of hashes, if every one were estimated as repeated
BLOCKS = 32  # at least so many blocks and ranges, so that small inputs use all tasks
_ROOTS = (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93)  # odd multipliers of the two polynomials
_SECOND = np.uint64(0xA0761D6478BD642F)  # key of the second row of the sketch


def polynomial(hashes: np.ndarray, k: int, lane: int = 0) -> np.ndarray:
    """The hash of every run of ``k`` of all ``hashes``, from running sums modulo 2^64."""
    root = _ROOTS[lane]
    n = len(hashes)
    if n < k:
        return np.zeros(0, np.uint64)
    up, down = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, r, np.uint64)])) for r in (np.uint64(root), np.uint64(pow(root, -1, 1 << 64))))
    total = np.concatenate([[np.uint64(0)], np.cumsum(hashes * up)])
    return mix64((total[k:] - total[:-k]) * down[: n - k + 1])


def _least(values: np.ndarray, k: int) -> np.ndarray:
    """Minimum of every run of ``k`` values."""
    out, size = values, 1
    while size * 2 <= k:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[: len(out) - (k - size)], out[k - size :]) if k > size else out


class Unit:
    """The words of a unit's texts and the windows that lie in one text of a known id."""

    def __init__(self, texts: pa.Array, known: np.ndarray, lanes: int, window: int = WINDOW):
        self.data, self.offsets = string_buffers(texts)
        self.hashes, self.start, self.size = words(self.data, self.offsets, lanes, fold=False)
        self.bounds = np.searchsorted(self.start, self.offsets).astype(np.int64)
        self.n_words = np.diff(self.bounds)
        self.window = window
        counts = np.where(known, np.maximum(self.n_words - window + 1, 0), 0)
        self.doc = np.repeat(np.arange(len(counts)), counts)
        self.at = np.arange(int(counts.sum())) + np.repeat(self.bounds[:-1] - (np.cumsum(counts) - counts), counts)  # first word of each window

    def keys(self, anchor: int) -> np.ndarray:
        """The key of every window: its least run of ``anchor`` words."""
        if not len(self.at):
            return np.zeros(0, np.uint64)
        return _least(polynomial(self.hashes[0], anchor), self.window - anchor + 1)[self.at]

    def counted(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys in order, whether two texts hold them, and each window's place among them."""
        distinct, place = np.unique(keys, return_inverse=True)
        first = np.full(len(distinct), len(self.n_words))
        last = np.full(len(distinct), -1)
        np.minimum.at(first, place, self.doc)
        np.maximum.at(last, place, self.doc)
        return distinct, last > first, place


def _cells(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The cell of every key in the two rows of the sketch."""
    shift = np.uint64(64 - bits)
    return keys >> shift, mix64(keys ^ _SECOND) >> shift


class _Ids:
    """Places of ids in their order; -1 where an id is null."""

    def __init__(self, ids: pa.Array):
        values = ids.to_pylist()
        order = {v: k for k, v in enumerate(sorted({v for v in values if v is not None}))}
        self.rank = np.array([-1 if v is None else order[v] for v in values], np.int64)
        self.values = list(order)


def _binary(rows) -> pa.Array:
    return pa.array([np.ascontiguousarray(r).tobytes() for r in rows], pa.binary())


class Passages:
    """The steps over one table of documents; ``root`` names its stored units."""

    def __init__(self, documents: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, unit_bytes: int = UNIT_BYTES, blocks: int = BLOCKS):
        if not 0 < anchor <= window:
            raise ValueError("an anchor is a part of the window")
        self.spark, self.window, self.anchor = documents.sparkSession, window, anchor
        self.work = Scratch(self.spark, "passages")
        self.id_type = documents.schema["doc_id"].dataType.simpleString()
        self.units = self._store(documents.select("doc_id", F.col("text").alias("_text")), unit_bytes)
        n_bytes = self.units.agg(F.sum("n_bytes")).first()[0] or 0
        least = (blocks - 1).bit_length()
        windows = n_bytes / 6  # about so many, in prose
        self.bits = max(least + 10, min(60, int(4 * windows / ((window - anchor + 2) / 2)).bit_length()))
        self.block_bits = max(least, self.bits - CELL_BITS)
        self.range_bits = max(least, int(windows).bit_length() - RANGE_BITS)

    def _store(self, docs: DataFrame, unit_bytes: int) -> DataFrame:
        """``part, seq, n_bytes, ids, texts``: documents packed in the order and the tasks they are read in."""

        def task(batches):
            part, seq = TaskContext.get().partitionId(), 0
            for batch in batches:
                for rows in pieces(batch, "_text", unit_bytes):
                    ids, texts = rows.column(0), rows.column(1)
                    n = pa.compute.sum(pa.compute.binary_length(texts)).as_py() or 0
                    one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                    yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([seq]), pa.array([n]), one(ids), one(texts.cast(pa.string()))], names=["part", "seq", "n_bytes", "ids", "texts"])
                    seq += 1

        rows = docs.mapInArrow(task, f"part long, seq long, n_bytes long, ids array<{self.id_type}>, texts array<string>")
        least = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        buckets = min(max(docs.rdd.getNumPartitions(), least, 1), int(self.spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000")))
        name = f"corpusloom_{uuid.uuid4().hex}"
        options = {"path": self.work.path("units"), "compression": "zstd", "parquet.block.size": 16 << 20}
        rows.write.bucketBy(buckets, "part").options(**options).format("parquet").saveAsTable(name)
        out = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")  # the name only; the files stay
        return out

    def _ask(self, rows: DataFrame, keys: list[str], answer, name: str) -> DataFrame:
        """``part, answers``: for each group of question records the answers of ``answer``, sent back to their parts."""
        bits = rows.groupBy(*keys).applyInArrow(answer, "part long, seq long, row int, block int, bits binary")
        back = bits.groupBy("part").agg(F.collect_list(F.struct("seq", "row", "block", "bits")).alias("answers"))
        return self.work.save(back, name)

    def _with(self, units: DataFrame, answers: DataFrame, name: str) -> DataFrame:
        """Units with the answers to their own questions."""
        own = F.filter("answers", lambda x: x["seq"] == F.col("seq"))
        return units.join(answers.hint("shuffle_hash"), "part", "left").withColumn(name, F.coalesce(own, F.array())).drop("answers")

    def sketch(self) -> DataFrame:
        """``part, answers``: for each unit and block of the sketch a bit a cell, set where its count is 2 or more."""
        window, anchor, bits, block_bits = self.window, self.anchor, self.bits, self.block_bits

        def task(batches):
            for batch in batches:
                for ids, texts, part, seq in _units(batch):
                    u = Unit(texts, ids.rank >= 0, 1, window)
                    distinct, twice, _ = u.counted(u.keys(anchor))
                    for row, cells in enumerate(_cells(distinct, bits)):
                        order = np.argsort(cells, kind="stable")
                        for block, some in _blocks(cells[order], bits, block_bits):
                            low = (cells[order[some]] & np.uint64((1 << (bits - block_bits)) - 1)).astype(np.uint32)
                            yield _record(part, seq, row, block, [low, twice[order[some]]])

        def answer(table: pa.Table) -> pa.Table:
            table = table.combine_chunks()
            cells = [np.frombuffer(x.as_py(), np.uint32) for x in table.column("a")]
            twice = [np.frombuffer(x.as_py(), bool) for x in table.column("b")]
            every = np.sort(np.concatenate(cells))
            many = np.zeros(1 << (bits - block_bits), bool)
            many[every[1:][every[1:] == every[:-1]]] = True
            for c, t in zip(cells, twice):
                many[c[t]] = True
            return _answers(table, [many[c] for c in cells])

        rows = self.units.select("part", "seq", "ids", "texts").mapInArrow(task, "part long, seq long, row int, block int, a binary, b binary")
        return self._ask(rows, ["row", "block"], answer, "sketch")

    def exact(self, sketch: DataFrame) -> DataFrame:
        """``part, answers``: for each unit and range of hashes a bit a distinct window, set where another unit has a lesser id."""
        window, anchor, bits, block_bits, id_type = self.window, self.anchor, self.bits, self.block_bits, self.id_type
        range_bits = self.range_bits

        def task(batches):
            for batch in batches:
                for ids, texts, part, seq, flags in _units(batch, "flags"):
                    g = _Groups(Unit(texts, ids.rank >= 0, 2, window), ids, anchor, bits, block_bits, flags)
                    for block, some in _blocks(g.h1, 64, range_bits):
                        yield _record(part, seq, 0, block, [g.h1[some], g.h2[some].astype(np.uint32)], [[ids.values[i] for i in g.least[some]]], ids.type)

        def answer(table: pa.Table) -> pa.Table:
            table = table.combine_chunks()
            size = [len(x.as_py()) // 8 for x in table.column("a")]
            h1 = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in table.column("a")])
            h2 = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in table.column("b")])
            rank = _Ids(pa.concat_arrays([x.values for x in table.column("ids")])).rank
            order = np.lexsort((rank, h2, h1))
            new = np.ones(len(order), bool)
            new[1:] = (h1[order[1:]] != h1[order[:-1]]) | (h2[order[1:]] != h2[order[:-1]])
            least = rank[order[np.flatnonzero(new)]][np.cumsum(new) - 1]
            hit = np.zeros(len(order), bool)
            hit[order] = rank[order] > least
            return _answers(table, np.split(hit, np.cumsum(size)[:-1]))

        rows = self._with(self.units.select("part", "seq", "ids", "texts"), sketch, "flags")
        rows = rows.mapInArrow(task, f"part long, seq long, row int, block int, a binary, b binary, ids array<{id_type}>")
        return self._ask(rows, ["block"], answer, "exact")

    def removed(self, sketch: DataFrame, exact: DataFrame) -> DataFrame:
        """``doc_id, n_words, n_removed, kept``; ``kept`` has the remaining words, joined by one space."""
        window, anchor, bits, block_bits, range_bits = self.window, self.anchor, self.bits, self.block_bits, self.range_bits

        def task(batches):
            for batch in batches:
                for ids, texts, _, _, flags, hits in _units(batch, "flags", "hits"):
                    u = Unit(texts, ids.rank >= 0, 2, window)
                    gone = _Groups(u, ids, anchor, bits, block_bits, flags).removed(hits, range_bits)
                    kept, n_removed = _without(u, gone)
                    yield pa.RecordBatch.from_arrays([ids.array, pa.array(u.n_words), pa.array(n_removed), kept], names=["doc_id", "n_words", "n_removed", "kept"])

        rows = self._with(self.units.select("part", "seq", "ids", "texts"), sketch, "flags")
        rows = self._with(rows, exact, "hits")
        return rows.mapInArrow(task, f"doc_id {self.id_type}, n_words long, n_removed long, kept string")


def _units(batch: pa.RecordBatch, *answers: str):
    """The units of a batch: ids, texts, part, seq, and the named answers, each ``{(row, block): bits}``."""
    col = lambda name: batch.column(batch.schema.get_field_index(name))
    for i in range(batch.num_rows):
        array = col("ids")[i].values
        ids = _Ids(array)
        ids.array, ids.type = array, array.type
        said = []
        for name in answers:
            said.append({(x["row"], x["block"]): x["bits"] for x in col(name)[i].as_py()})
        yield (ids, col("texts")[i].values, col("part")[i].as_py(), col("seq")[i].as_py(), *said)


def _blocks(sorted_values: np.ndarray, bits: int, block_bits: int):
    """``(block, slice)`` of sorted values of ``bits`` bits, by their first ``block_bits``."""
    top = (sorted_values >> np.uint64(bits - block_bits)).astype(np.int64)
    cut = np.flatnonzero(np.diff(top)) + 1
    for a, b in zip(np.concatenate([[0], cut]), np.concatenate([cut, [len(top)]])):
        if b > a:
            yield int(top[a]), slice(int(a), int(b))


def _record(part: int, seq: int, row: int, block: int, arrays: list[np.ndarray], lists: list[list] = (), kind=None) -> pa.RecordBatch:
    cols = [pa.array([part]), pa.array([seq]), pa.array([row], pa.int32()), pa.array([block], pa.int32())]
    cols += [_binary([x]) for x in arrays] + [pa.array([x], pa.list_(kind)) for x in lists]
    return pa.RecordBatch.from_arrays(cols, names=["part", "seq", "row", "block", "a", "b", "ids"][: len(cols)])


def _answers(table: pa.Table, bits: list[np.ndarray]) -> pa.Table:
    return pa.table([table.column("part"), table.column("seq"), table.column("row"), table.column("block"), _binary([np.packbits(b) for b in bits])], names=["part", "seq", "row", "block", "bits"])


def _read(said: dict, row: int, sorted_values: np.ndarray, bits: int, block_bits: int) -> np.ndarray:
    """The answers to sorted values, as :func:`_blocks` asked them."""
    out = np.zeros(len(sorted_values), bool)
    for block, some in _blocks(sorted_values, bits, block_bits):
        out[some] = np.unpackbits(np.frombuffer(said[row, block], np.uint8), count=some.stop - some.start).astype(bool)
    return out


class _Groups:
    """The distinct windows of a unit that the sketch estimates as repeated, each with its least id."""

    def __init__(self, unit: Unit, ids: _Ids, anchor: int, bits: int, block_bits: int, flags: dict):
        distinct, _, place = unit.counted(unit.keys(anchor))
        repeated = np.ones(len(distinct), bool)
        for row, cells in enumerate(_cells(distinct, bits)):
            order = np.argsort(cells, kind="stable")
            said = np.zeros(len(distinct), bool)
            said[order] = _read(flags, row, cells[order], bits, block_bits)
            repeated &= said
        some = np.flatnonzero(repeated[place])
        self.at = unit.at[some]
        h1, h2 = (polynomial(unit.hashes[lane], unit.window, lane)[self.at] for lane in (0, 1))
        rank = ids.rank[unit.doc[some]]
        h2 &= np.uint64(0xFFFFFFFF)
        order = np.lexsort((rank, h2, h1))
        new = np.ones(len(order), bool)
        new[1:] = (h1[order[1:]] != h1[order[:-1]]) | (h2[order[1:]] != h2[order[:-1]])
        first = order[np.flatnonzero(new)]
        self.h1, self.h2, self.least = h1[first], h2[first], rank[first]
        self.group = np.empty(len(order), np.int64)
        self.group[order] = np.cumsum(new) - 1
        self.later = rank > self.least[self.group]

    def removed(self, hits: dict, range_bits: int) -> np.ndarray:
        """First words of the windows that start in a document of lesser id."""
        return self.at[self.later | _read(hits, 0, self.h1, 64, range_bits)[self.group]]


def _without(unit: Unit, gone: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The texts without the words that windows starting at ``gone`` cover, and how many words went."""
    n = len(unit.start)
    turn = np.zeros(n + 1, np.int32)
    np.add.at(turn, gone, 1)
    np.add.at(turn, gone + unit.window, -1)
    stays = np.cumsum(turn[:-1]) == 0
    upto = np.concatenate([[0], np.cumsum(stays)])
    n_kept = np.diff(upto[unit.bounds])
    at = np.flatnonzero(stays)
    opens = np.zeros(len(at) + 1, bool)
    opens[upto[unit.bounds[:-1]][n_kept > 0]] = True  # the first kept word of a text; others bring the byte before them
    lead = (~opens[: len(at)]).astype(np.int64)
    data = unit.data.copy()
    data[unit.start[at[lead > 0]] - 1] = 32
    edge = np.zeros(len(data) + 1, np.int8)
    np.add.at(edge, unit.start[at] - lead, 1)
    np.add.at(edge, unit.start[at] + unit.size[at], -1)
    data = data[np.cumsum(edge[:-1], dtype=np.int8) > 0]
    length = np.concatenate([[0], np.cumsum(unit.size[at] + lead)])
    offsets = length[upto[unit.bounds]]
    kept = pa.LargeStringArray.from_buffers(len(unit.n_words), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())
    return kept, unit.n_words - n_kept


def remove_repeats(documents: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, unit_bytes: int = UNIT_BYTES, blocks: int = BLOCKS) -> DataFrame:
    """``doc_id, n_words, n_removed, kept``: texts without the passages that documents of lesser id have."""
    p = Passages(documents, window, anchor, unit_bytes, blocks)
    sketch = p.sketch()
    return p.removed(sketch, p.exact(sketch))
