"""Shared pieces of the training-data operators: byte-level text kernels.

Texts are handled as UTF-8 bytes in numpy.  A *word* is a maximal run of bytes outside
``\\x20\\x09-\\x0D`` after lower-casing ``A-Z``.  A word's 64-bit hash is keyed tabulation: the sum of
a random number for each pair of position and byte, finalised by a mixing function.  Unlike a
polynomial it has no family of words that collide by their structure.  A *shingle* is a run of
``k`` words hashed from the word hashes, so the white space between words never matters.

Hashes find candidates.  Where equality decides a result, :func:`shingle_ids` numbers shingles by
their bytes: it compares every word with the word that it shares a hash with.
"""

from __future__ import annotations

import ctypes
import functools
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute

from ..scratch import Scratch  # noqa: F401

SPAN_BYTES = 500_000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.ones(256, dtype=bool)
_WORD[[32, 9, 10, 11, 12, 13]] = False

_GOLDEN = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
#: Keys of the two independent word hashes.
_KEYS = (0x3C79AC492BA7B653, 0x1D8E4E27C47D124F)
_NEAR = 64  # positions whose random numbers are kept in a table


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def string_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, offsets)`` of an Arrow string array; nulls count as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pa.compute.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


@functools.cache
def _table(lane: int) -> np.ndarray:
    return _random(np.arange(_NEAR * 256, dtype=np.int64), lane)


def _random(code: np.ndarray, lane: int) -> np.ndarray:
    """The random number of a position and byte, ``code = position * 256 + byte``."""
    return mix64(mix64(code.astype(np.uint64) * np.uint64(_GOLDEN) + np.uint64(_KEYS[lane])) + np.uint64(_KEYS[1 - lane]))


def _piece_sums(data: np.ndarray, first: np.ndarray, size: np.ndarray, done: int, lanes: int, fold: bool = True) -> np.ndarray:
    """Tabulation sums ``[lane, run]`` of runs of word bytes; the first run continues a word of ``done`` bytes."""
    before = np.cumsum(size) - size
    n = int(size.sum())
    where = np.arange(n, dtype=np.int64) - np.repeat(before, size)
    code = data[np.repeat(first, size) + where]
    code = (_LOWER[code] if fold else code) + (where << 8)
    if done:
        code[: size[0]] += done << 8
    out = np.zeros((lanes, len(first)), np.uint64)
    far = np.flatnonzero(code >= _NEAR * 256)
    close = np.minimum(code, _NEAR * 256 - 1) if len(far) else code
    for lane in range(lanes if len(first) else 0):
        value = _table(lane)[close]
        if len(far):
            value[far] = _random(code[far], lane)
        out[lane] = np.add.reduceat(value, before)
    return out


def words(data: np.ndarray, offsets: np.ndarray, lanes: int = 1, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes ``[lane, word]``, first byte and length of every word; the lanes are independent.

    ``fold``: ``A-Z`` count as ``a-z``.  Works in spans of ``SPAN_BYTES`` bytes, cut anywhere: a word's sum goes on in the next span.
    Memory is in proportion to a span plus 24 bytes a word, whatever a text's length.
    """
    sums, starts, sizes, inside = [np.zeros((lanes, 0), np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], False
    for at in range(0, len(data), SPAN_BYTES):
        part = data[at : at + SPAN_BYTES]
        lo, hi = np.searchsorted(offsets, [at, at + len(part)])
        edges = offsets[lo:hi] - at
        word = _WORD[part]
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        begins[edges] = word[edges]
        go_on = inside and word[0] and not (len(edges) and edges[0] == 0)
        first = np.flatnonzero(begins)
        ends = word.copy()
        ends[:-1] &= ~word[1:]
        ends[edges[edges > 0] - 1] = word[edges[edges > 0] - 1]
        size = np.flatnonzero(ends) + 1 - first
        value = _piece_sums(part, first, size, int(sizes[-1][-1]) if go_on else 0, lanes, fold)
        if go_on:
            sums[-1][:, -1] += value[:, 0]
            sizes[-1][-1:] += size[:1]
            value, first, size = value[:, 1:], first[1:], size[1:]
        if len(first):
            sums.append(value)
            starts.append(first + at)
            sizes.append(size)
        inside = bool(word[-1])
    start, size = np.concatenate(starts), np.concatenate(sizes)
    return mix64(np.concatenate(sums, axis=1) + size.astype(np.uint64) * np.uint64(_GOLDEN)), start, size


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and ``bounds``: document ``i`` has words ``bounds[i]:bounds[i + 1]``."""
    hashes, start, _ = words(data, offsets)
    return hashes[0], np.searchsorted(start, offsets).astype(np.int64)


def _same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> bool:
    """Whether all words at ``a`` are those at ``b``, without regard to case; long words one by one."""
    for i in np.flatnonzero(size > SPAN_BYTES):
        if a[i] != b[i] and (_LOWER[data[a[i] : a[i] + size[i]]] != _LOWER[data[b[i] : b[i] + size[i]]]).any():
            return False
    check = np.flatnonzero((size <= SPAN_BYTES) & (a != b))
    cuts = np.searchsorted(np.cumsum(size[check]), np.arange(SPAN_BYTES, int(size[check].sum()) + SPAN_BYTES, SPAN_BYTES))
    lo = 0
    for hi in [*(cuts + 1).tolist(), len(check)]:
        some = check[lo:hi]
        lo = max(lo, hi)
        n = size[some]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        if (_LOWER[data[np.repeat(a[some], n) + step]] != _LOWER[data[np.repeat(b[some], n) + step]]).any():
            return False
    return True


def word_ids(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all words, equal if and only if the words are, and ``bounds`` as above."""
    hashes, start, size = words(data, offsets)
    bounds = np.searchsorted(start, offsets).astype(np.int64)
    _, first, ids = np.unique(hashes[0], return_index=True, return_inverse=True)
    like = first[ids]
    if not (size == size[like]).all() or not _same_bytes(data, start, start[like], size):  # different words of one hash
        number: dict[bytes, int] = {}
        ids = np.array([number.setdefault(_LOWER[data[a : a + n]].tobytes(), len(number)) for a, n in zip(start, size)], np.int64)
    return ids.astype(np.int64), bounds


def shingle_ids(texts: pa.Array, k: int = 5) -> list[np.ndarray]:
    """Per text the sorted numbers of its distinct shingles: exact, equal if and only if the shingles are."""
    ids, bounds = word_ids(*string_buffers(texts))
    runs, at = shingle_runs(mix64(ids), bounds, k)
    n_words = np.diff(bounds)
    begin = np.repeat(bounds[:-1], np.diff(at)) + np.arange(len(runs)) - np.repeat(at[:-1], np.diff(at))
    size = np.repeat(np.minimum(n_words, k), np.diff(at))
    _, first, number = np.unique(runs, return_index=True, return_inverse=True)
    like = first[number]
    true = bool((size == size[like]).all())
    for j in range(k if true else 0):
        has = np.flatnonzero(size > j)
        true = true and bool((ids[begin[has] + j] == ids[begin[like[has]] + j]).all())
    if not true:  # different shingles of one hash
        known: dict[tuple, int] = {}
        number = np.array([known.setdefault(tuple(ids[a : a + n]), len(known)) for a, n in zip(begin, size)], np.int64)
    return [np.unique(number[a:b]) for a, b in zip(at[:-1], at[1:])]


_COEFF = mix64(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingle_runs(words: np.ndarray, bounds: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """All shingle hashes in order and their bounds per document.

    A document of ``1..k-1`` words has one shingle, its whole sequence; one without words has none.
    """
    n_words = np.diff(bounds)
    counts = np.where(n_words >= k, n_words - k + 1, (n_words > 0).astype(n_words.dtype))
    out_bounds = np.zeros(len(bounds), np.int64)
    np.cumsum(counts, out=out_bounds[1:])
    out = np.zeros(int(out_bounds[-1]), np.uint64)
    long = n_words >= k
    if long.any():
        m = len(words) - k + 1
        acc = words[:m] * _COEFF[0]
        for j in range(1, k):
            acc += words[j : j + m] * _COEFF[j]
        acc = mix64(acc)
        ok = np.zeros(len(words) + 1, np.int64)
        np.add.at(ok, bounds[:-1][long], 1)
        np.add.at(ok, bounds[1:][long] - k + 1, -1)
        dest = np.zeros(len(out) + 1, np.int64)
        np.add.at(dest, out_bounds[:-1][long], 1)
        np.add.at(dest, out_bounds[1:][long], -1)
        out[np.cumsum(dest[:-1]) > 0] = acc[np.cumsum(ok[:m]) > 0]
    for i in np.flatnonzero((n_words > 0) & ~long):
        w = words[bounds[i] : bounds[i + 1]]
        out[out_bounds[i]] = mix64(np.array([(w * _COEFF[: len(w)]).sum() + np.uint64(len(w))], np.uint64))[0]
    return out, out_bounds


def shingle_sets(texts: pa.Array, k: int = 5) -> list[np.ndarray]:
    """Per text the sorted array of its distinct shingle hashes."""
    runs, bounds = shingle_runs(*word_hashes(*string_buffers(texts)), k)
    return [np.unique(runs[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]


def crc32_ids(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())


def pieces(batch: pa.RecordBatch, column: str, limit: int = 4_000_000):
    """Slices of a record batch whose ``column`` holds about ``limit`` bytes, one row at least."""
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(batch.schema.get_field_index(column))), 0))
    total = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        base = total[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(total, base + limit, side="right")))
        yield batch.slice(at, stop - at)
        at = stop
    give_back()


@functools.cache
def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:  # another C library
        return None


def give_back() -> None:
    """Return memory that is free but held to the system; a worker outlives its tasks."""
    pa.default_memory_pool().release_unused()
    if _libc() is not None:
        _libc().malloc_trim(0)


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(columns, name: str) -> str:
    """``name``, or it with underscores after it until no column bears it (in any case of letters)."""
    used = {c.lower() for c in columns}
    while name.lower() in used:
        name += "_"
    return name


def keep_and_add(documents, keep: list[str], task, added: dict[str, str], limit: int = 1_500_000):
    """``keep`` columns of the documents and new ones, made from ``text`` by ``task(texts) -> arrays``.

    ``added`` names the new columns and their types.  Columns travel by place, so their names do not matter.
    """
    from pyspark.sql import functions as F

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "_text", limit):
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *task(part.column(0))], names=names)

    names = [f"_{i}" for i in range(len(keep) + len(added))]
    rows = documents.select(F.col("text").alias("_text"), *(F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)))
    kinds = [f.dataType.simpleString() for f in rows.schema.fields[1:]] + list(added.values())
    out = rows.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, [*keep, *added])))
