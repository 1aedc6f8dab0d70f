"""Benchmark decontamination: which documents contain a test item.

An item is found in a document if at least ``PERCENT`` of the item's distinct 5-word shingles
occur among the document's, however long the document is.  Items are partitioned by the size of
their shingle sets (powers of two).  An item's sketch is its bottom-``s`` MinHash, the ``s``
shingles of least hash, where ``s`` follows from the largest size of its partition::

    s = size - ceil(size * PERCENT / 100) + 1

A document that contains the item misses at most ``size - ceil(...)`` of its shingles, so it has at
least one of the sketch: the search loses nothing, whatever the sizes of document and item.
Documents are not sketched: a sketch of a long document would lose the short items in it.  All of
its shingles are looked up instead, behind a bit table that nearly all of them fail.

Documents are read once.  A benchmark of at most ``BLOCK_BYTES`` of text is broadcast as one index and
candidates are confirmed in place, on the words of both.  A larger one stays in tables: the documents'
shingles that pass the bit table (at most ``MAX_BITS`` bits, 64 MB) are joined with the sketches, and
candidates are confirmed by joins on two independent 64-bit hashes of every shingle.  The results are the same.

Defined results: a text of fewer than five words has one shingle, its whole sequence, so a
shorter item is found only in a document that is nothing else; nulls and texts without words have
no shingles and take no part; repeated rows of documents give repeated rows, repeated item ids are
one item each for every text of theirs; an empty table on either side gives an empty result; other
columns are ignored; a text of any length is hashed in spans, and its shingles must fit a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, mix64, pieces, shingle_ids, shingle_runs, shingle_sets, string_buffers, word_hashes, words

SHINGLE = 5
PERCENT = 75
BLOCK_BYTES = 16 << 20
MAX_BITS = 29  # of the bit table of a large benchmark, as a power of two
_FILTER_BITS = 22
_FOUND = "doc_id long, item_id long, n_item_shingles long, n_found long, containment double"


def sketch_size(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """How many shingles the sketch of an item of ``n`` takes: by the largest size of its partition, a power of two."""
    most = (1 << np.frexp(n)[1].astype(np.int64)) - 1
    return np.minimum(n, most - -(-most * percent // 100) + 1)


class ItemIndex:
    """Sketches and full shingle sets of a block of items."""

    def __init__(self, item_ids: list[int], texts: pa.Array, k: int = SHINGLE, percent: int = PERCENT):
        sets = shingle_sets(texts, k)
        has = [i for i, s in enumerate(sets) if len(s)]
        self.item_ids = [item_ids[i] for i in has]
        self.sets = [sets[i] for i in has]
        self.texts = [texts[i].as_py() for i in has]
        sizes = np.array([len(s) for s in self.sets], np.int64)
        keys, owners = [], []
        for i, take in enumerate(sketch_size(sizes, percent)):
            s = self.sets[i]
            sketch = s[np.argsort(mix64(s), kind="stable")[:take]]
            keys.append(sketch)
            owners.append(np.full(len(sketch), i))
        keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        owners = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, first = np.unique(keys[order], return_index=True)
        self.owners, self.first = owners[order], np.append(first, len(keys))
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self.keys >> np.uint64(64 - _FILTER_BITS)] = True
        self.percent = percent

    def search(self, runs: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int, int]]:
        """``(document's place, item's place, item's shingles, found)`` of all containments."""
        near = np.flatnonzero(self.filter[runs >> np.uint64(64 - _FILTER_BITS)])
        if not len(near) or not len(self.keys):
            return []
        at = np.minimum(np.searchsorted(self.keys, runs[near]), len(self.keys) - 1)
        hit = self.keys[at] == runs[near]
        near, at = near[hit], at[hit]
        doc = np.searchsorted(bounds, near, side="right") - 1
        out = []
        for d in np.unique(doc):
            own = np.unique(runs[bounds[d] : bounds[d + 1]])
            items = {int(i) for k in np.unique(at[doc == d]) for i in self.owners[self.first[k] : self.first[k + 1]]}
            for i in sorted(items):
                s = self.sets[i]
                place = np.minimum(np.searchsorted(own, s), len(own) - 1)
                found = int((own[place] == s).sum())
                if 100 * found >= self.percent * len(s):
                    out.append((int(d), i, len(s), found))
        return out


def _confirm(index: ItemIndex, texts: pa.Array, hits: list[tuple[int, int, int, int]], k: int) -> list[tuple[int, int, int, int]]:
    """The hits that hold on words, with exact counts."""
    out = []
    for d in dict.fromkeys(h[0] for h in hits):
        items = [h[1] for h in hits if h[0] == d]
        own, *sets = shingle_ids(pa.array([texts[d].as_py(), *(index.texts[i] for i in items)], pa.large_string()), k)
        for i, s in zip(items, sets):
            found = len(np.intersect1d(own, s, assume_unique=True))
            if 100 * found >= index.percent * len(s):
                out.append((d, i, len(s), found))
    return out


def _by_index(docs: DataFrame, items: DataFrame, k: int, percent: int) -> DataFrame:
    rows = items.toArrow().combine_chunks()
    index = docs.sparkSession.sparkContext.broadcast(ItemIndex(rows.column("item_id").to_pylist(), pa.concat_arrays(rows.column("text").chunks) if rows.num_rows else pa.array([], pa.string()), k, percent))

    def task(batches):
        own = index.value
        for batch in batches:
            for part in pieces(batch, "text"):
                hits = _confirm(own, part.column(1), own.search(*shingle_runs(*word_hashes(*string_buffers(part.column(1))), k)), k)
                d, i, n, f = (np.array([h[j] for h in hits], np.int64) for j in range(4))
                ids = [own.item_ids[x] for x in i]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(d)), pa.array(ids, pa.int64()), pa.array(n), pa.array(f), pa.array(f / np.maximum(n, 1))], names=["doc_id", "item_id", "n_item_shingles", "n_found", "containment"])

    return docs.mapInArrow(task, _FOUND)


def _distinct_shingles(texts: pa.Array, k: int):
    """Per text its distinct shingles by two hashes."""
    data, offsets = string_buffers(texts)
    hashes, start, _ = words(data, offsets, 2)
    bounds = np.searchsorted(start, offsets)
    (a, at), (b, _) = (shingle_runs(h, bounds, k) for h in hashes)
    for lo, hi in zip(at[:-1], at[1:]):
        x, i = np.unique(a[lo:hi], return_index=True)
        yield x, b[lo:hi][i]


def _by_joins(docs: DataFrame, items: DataFrame, k: int, percent: int) -> DataFrame:
    spark = docs.sparkSession
    work = Scratch(spark, "decontaminate")
    items = work.save(items.withColumn("item", F.monotonically_increasing_id()), "items")

    def cut(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                out = [[], [], [], []]
                for x, y in _distinct_shingles(part.column(2), k):
                    order = np.argsort(mix64(x), kind="stable")
                    first = np.zeros(len(x), bool)
                    first[order[: int(sketch_size(np.array([len(x)]), percent)[0])]] = True
                    for c, v in zip(out, (x, y, first, np.full(len(x), len(x)))):
                        c.append(v)
                own = pa.array(np.repeat(np.arange(part.num_rows), [len(x) for x in out[0]]))
                h1, h2, first, n = (np.concatenate(c) for c in out)
                yield pa.RecordBatch.from_arrays([part.column(0).take(own), part.column(1).take(own), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(first), pa.array(n)], names=["item", "item_id", "h1", "h2", "in_sketch", "n"])

    parts = work.save(items.select("item", "item_id", "text").mapInArrow(cut, "item long, item_id long, h1 long, h2 long, in_sketch boolean, n long"), "item_shingles")
    bits = max(16, min(MAX_BITS, int(parts.count() * 64).bit_length()))

    def fill(key, rows):
        flags = np.zeros(1 << 16, bool)
        flags[rows.column("place").to_numpy()] = True
        return pa.table({"chunk": [key[0].as_py()], "flags": [np.packbits(flags).tobytes()]})

    place = F.shiftrightunsigned("h1", 64 - bits)
    places = parts.select(F.shiftright(place, 16).alias("chunk"), place.bitwiseAND(F.lit(0xFFFF)).cast("int").alias("place")).distinct()
    table = np.zeros(1 << (bits - 3), np.uint8)
    for r in places.groupBy("chunk").applyInArrow(fill, "chunk long, flags binary").collect():  # at most 2**(MAX_BITS - 16) rows of 8 kB
        table[r["chunk"] << 13 : (r["chunk"] + 1) << 13] = np.frombuffer(r["flags"], np.uint8)
    shared = spark.sparkContext.broadcast(table)

    def look(batches):
        flags = shared.value
        for batch in batches:
            for part in pieces(batch, "text"):
                found = []
                for x, y in _distinct_shingles(part.column(2), k):
                    at = (x >> np.uint64(64 - bits)).astype(np.int64)
                    ok = (flags[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0
                    found.append((x[ok], y[ok]))
                own = pa.array(np.repeat(np.arange(part.num_rows), [len(x) for x, _ in found]))
                h1, h2 = (np.concatenate([np.zeros(0, np.uint64), *(f[j] for f in found)]) for j in range(2))
                yield pa.RecordBatch.from_arrays([part.column(0).take(own), part.column(1).take(own), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))], names=["row", "doc_id", "h1", "h2"])

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    hits = work.save(numbered.mapInArrow(look, "row long, doc_id long, h1 long, h2 long"), "hits")
    pairs = hits.join(parts.where("in_sketch").select("h1", "h2", "item", "item_id", "n"), ["h1", "h2"]).select("row", "doc_id", "item", "item_id", "n").distinct()
    wanted = pairs.join(parts.select("item", "h1", "h2"), "item").join(hits.select("row", "h1", "h2"), ["row", "h1", "h2"], "left_semi")
    found = wanted.groupBy("row", "doc_id", "item", "item_id", "n").agg(F.count("*").alias("n_found")).where(F.col("n_found") * 100 >= F.col("n") * percent)
    return found.select("doc_id", "item_id", F.col("n").alias("n_item_shingles"), "n_found", (F.col("n_found") / F.col("n")).alias("containment"))


def contaminated(documents: DataFrame, benchmark: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per document and item found in it: ``doc_id, item_id, n_item_shingles, n_found, containment``."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    return (_by_index if size <= BLOCK_BYTES else _by_joins)(docs, items, k, percent)


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that contain no item.  A null id is never dropped."""
    hits = contaminated(documents, benchmark).select("doc_id").distinct()
    return documents.join(hits, "doc_id", "left_anti")
