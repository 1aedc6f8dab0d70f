"""Quality classification by nearest-neighbour voting in a latent semantic space.

A text is a vector of its words and of its character trigrams (lower-cased), each hashed to one of
``WORDS`` or ``TRIGRAMS`` features.  Of pairs of neighbouring words one kind is counted, in feature 0: a word after
itself ("said again", instead of the word and its trigrams), for a bag of words cannot tell a repeated word from
a text about it.  Counts are damped by a square root, weighted by inverse
document frequency and normalised; a truncated singular value decomposition of the labelled texts
gives the latent space (latent semantic analysis).

The labelled vectors are broadcast (``SAMPLE_DOCS`` of ``DIMS`` numbers and the axes at most, under 2 MB)
and every document is compared with all of them by exact cosine products, block by block.  Its
score is the share of label 1 among its ``NEIGHBOURS`` nearest.  A vote weighs a power of the similarity, over the
number of sampled documents of its label: where one label is rare, its few documents are not outvoted by
sheer numbers, however small the sample.
Similarities count to ``DIGITS`` decimals; of equal ones the labelled document of lesser id is nearer.

Fitting takes a bounded sample: the ``SAMPLE_DOCS`` labelled ids of least hash, one row each.  The
driver holds them as one matrix of ``SAMPLE_DOCS`` x ``FEATURES`` numbers, 131 MB.

Defined results: a null text is empty, and an empty text has the zero vector, whose score is the
share of label 1 in the sample; labels may be whole numbers or booleans; without any labelled row every score is 0.5; of a labelled id on several
rows the least text counts, of several labels the least; null ids are not learned from; repeated rows
give repeated results; an empty table gives an empty result; other columns are ignored or, if asked
for, kept under any name.  A very long text is counted in spans.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _LOWER, SPAN_BYTES, keep_and_add, mix64, pieces, string_buffers, words
from .language import held_out

SAMPLE_DOCS = 4000
DIMS = 32
NEIGHBOURS = 9
POWER = 16
DIGITS = 5
THRESHOLD = 0.3
WORDS = 4096
TRIGRAMS = 4096
FEATURES = WORDS + TRIGRAMS
BATCH = 256


def counts(texts: pa.Array) -> np.ndarray:
    """Feature counts ``[text, feature]``."""
    data, offsets = string_buffers(texts)
    n = len(offsets) - 1
    out = np.zeros(n * FEATURES, np.float32)
    if not len(data):
        return out.reshape(n, FEATURES)
    hashes, start, size = words(data, offsets)
    h = hashes[0]
    doc = np.repeat(np.arange(n), np.diff(np.searchsorted(start, offsets)))
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    out += np.bincount(doc * FEATURES + np.where(again, 0, 1 + (h % np.uint64(WORDS - 1)).astype(np.int64)), minlength=len(out))
    turn = np.zeros(len(data) + 1, np.int8)
    np.add.at(turn, start[again], 1)
    np.add.at(turn, start[again] + size[again], -1)
    counted = np.cumsum(turn[:-1], dtype=np.int8) == 0
    for at in range(0, len(data) - 2, SPAN_BYTES):
        stop = min(at + SPAN_BYTES, len(data) - 2)
        low = _LOWER[data[at : stop + 2]].astype(np.uint64)
        key = mix64(low[:-2] << np.uint64(16) | low[1:-1] << np.uint64(8) | low[2:]) % np.uint64(TRIGRAMS)
        place = np.arange(at, stop)
        own = np.searchsorted(offsets, place, side="right") - 1
        ok = counted[at + 1 : stop + 1] & (place + 2 < offsets[own + 1])
        out += np.bincount(own[ok] * FEATURES + WORDS + key[ok].astype(np.int64), minlength=len(out))
    return out.reshape(n, FEATURES)


class Space:
    """Latent space of labelled texts: feature weights, axes, vectors and labels."""

    def __init__(self, x: np.ndarray, labels: np.ndarray, dims: int = DIMS):
        """``x``: feature counts of the labelled texts; it is overwritten."""
        n = len(labels)
        self.labels = labels.astype(np.float32)
        self.prior = float(labels.mean()) if n else 0.5
        self.vote = np.where(self.labels == 1, 1 / max(1, int(self.labels.sum())), 1 / max(1, int(n - self.labels.sum())))
        self.idf = (np.log((1 + n) / (1 + (x > 0).sum(axis=0))) + 1).astype(np.float32)
        self._weigh(x)
        k = min(dims, *x.shape) if x.any() else 0
        if k:  # randomised subspace iteration
            q = np.linalg.qr(x @ np.random.default_rng(7).standard_normal((x.shape[1], min(k + 16, *x.shape))).astype(np.float32))[0]
            for _ in range(4):
                q = np.linalg.qr(x @ (x.T @ q))[0]
            axes = np.linalg.svd(q.T @ x, full_matrices=False)[2][:k]
        else:
            axes = np.zeros((0, x.shape[1]), np.float32)
        self.axes = np.ascontiguousarray(axes.T, dtype=np.float32)
        self.vectors = self._unit(x @ self.axes)

    def _weigh(self, x: np.ndarray) -> np.ndarray:
        """Damped, weighted and normalised counts, in place."""
        np.sqrt(x, out=x)
        x *= self.idf
        x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-12)[:, None]
        return x

    @staticmethod
    def _unit(v: np.ndarray) -> np.ndarray:
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        return np.where(norm > 1e-6, v / np.maximum(norm, 1e-6), 0).astype(np.float32)

    def project(self, x: np.ndarray) -> np.ndarray:
        return self._unit(self._weigh(x) @ self.axes)

    def score(self, vectors: np.ndarray, neighbours: int = NEIGHBOURS, power: int = POWER) -> np.ndarray:
        """Similarity-weighted vote of the nearest labelled vectors; exact, in blocks."""
        out = np.full(len(vectors), self.prior)
        n = len(self.labels)
        k = min(neighbours, n)
        for at in range(0, len(vectors) if k else 0, BATCH):
            cos = np.rint((vectors[at : at + BATCH] @ self.vectors.T).astype(float) * 10**DIGITS).astype(np.int64)
            rank = cos * n - np.arange(n)  # no two are equal
            near = np.argpartition(-rank, k - 1, axis=1)[:, :k] if k < n else np.tile(np.arange(n), (len(cos), 1))
            w = (np.maximum(np.take_along_axis(cos, near, axis=1), 0) / 10**DIGITS) ** power * self.vote[near]
            total = w.sum(axis=1)
            votes = (w * self.labels[near]).sum(axis=1)
            out[at : at + BATCH] = np.where(total > 0, votes / np.where(total > 0, total, 1), self.prior)
        return np.clip(out, 0, 1)


def fit(documents: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Space:
    """Learn from labelled documents that are not held out."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality is not null and doc_id is not null").where(~held_out())
    marks = marks.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)

    def task(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH):
                part = batch.slice(lo, BATCH)
                x = counts(part.column(2))
                found = [np.flatnonzero(r) for r in x]
                raw = [pa.array([np.asarray(v, t).tobytes() for v in rows], pa.binary()) for t, rows in (("<u2", found), ("<f4", [r[i] for r, i in zip(x, found)]))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *raw], names=["doc_id", "quality", "feature", "n"])

    rows = docs.join(F.broadcast(marks), "doc_id").groupBy("doc_id").agg(F.first("quality").alias("quality"), F.min("text").alias("text"))
    got = rows.mapInArrow(task, "doc_id long, quality int, feature binary, n binary").collect()
    got.sort(key=lambda r: r["doc_id"])
    x = np.zeros((len(got), FEATURES), np.float32)
    for row, r in zip(x, got):
        row[np.frombuffer(r["feature"], "<u2")] = np.frombuffer(r["n"], "<f4")
    return Space(x, np.array([r["quality"] for r in got], float))


def predict(documents: DataFrame, space: Space, keep: list[str], score: str = "quality_score") -> DataFrame:
    """``keep`` columns of the documents with the column ``score``, a name that is not among them."""
    shared = documents.sparkSession.sparkContext.broadcast(space)

    def task(texts: pa.Array):
        s = shared.value
        return [pa.array(np.concatenate([np.zeros(0), *(s.score(s.project(counts(texts.slice(lo, BATCH)))) for lo in range(0, len(texts), BATCH))]))]

    return keep_and_add(documents, keep, task, {score: "double"})


def classify(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of all documents."""
    scored = predict(documents, fit(documents, labels), ["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"))
