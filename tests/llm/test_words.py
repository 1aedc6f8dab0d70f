"""Spelling variants, repeated passages and importance resampling against plain Python."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm import passages, queries, resample, spelling
from corpusloom.llm.common import Scratch

from .cases import docs, empty

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- spelling variants


def plain_vocabulary(rows):
    n = collections.Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1 :]
            n[w] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(n):
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def edited(rng, w, letters):
    i, kind = int(rng.integers(0, len(w))), rng.integers(0, 3)
    c = letters[rng.integers(0, len(letters))]
    return w[:i] + (c if kind else "") + w[i + (kind != 1) :]


@pytest.mark.parametrize("crowd", [0, 2, 32])
def test_variants_against_all_pairs(spark, crowd):
    rng = np.random.default_rng(crowd)
    letters = "abé"
    base = ["".join(rng.choice(list(letters), int(k))) for k in rng.integers(7, 12, 40)] + ["a" * 7, "a" * 8, "a" * 9, "ab" * 40]
    words = set(base)
    for w in base:
        for _ in range(12):
            w = edited(rng, w, letters)
            words.add(w)
    n = {w: int(10 ** rng.integers(0, 4)) * int(rng.integers(1, 4)) for w in sorted(words) if len(w) >= 7}
    got = spelling.group_variants(spark.createDataFrame(list(n.items()), "word string, n long"), crowd=crowd).collect()
    want = plain_variants(n)
    assert {tuple(r) for r in got} == want and len(got) == len(n)
    assert any(x[1] for x in want) and any(x[1] and x[2] != x[1] for x in want)


def test_common_segments_do_not_pair_all_their_words(spark):
    """5,000 words of one beginning: candidates stay in proportion to the words."""
    rng = np.random.default_rng(1)
    words = sorted({"commonstart" + "".join(rng.choice(list("abcdefghijklmnop"), 9)) for _ in range(5000)})
    work = Scratch(spark, "test")
    frame = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    found = spelling.near_pairs(frame, work)
    assert {(r["a"], r["b"]) for r in found.collect()} == {(a, b) for a, b in _by_deletion(words)}
    level1 = spark.read.parquet(work.path("sides1"))
    assert level1.count() and spark.read.parquet(work.path("sides0")).where("crowded").count()


def _by_deletion(words):
    holes = collections.defaultdict(list)
    for w in words:
        for i in range(len(w)):
            holes[i, w[:i] + w[i + 1 :]].append(w)
    return {(a, b) for ws in holes.values() for a in ws for b in ws if a < b}


def test_vocabulary_cases(spark):
    rows = [(1, "Straßen STRASSEN straßen Ärzteschaft ärzteschaft Ärzteschaft"), (2, None), (3, ""), (None, "nothing nothing"), (4, "x" * 50_000 + " " + "x" * 50_000), (4, "İstanbul ſchönes 123abcdefg_hijklmn"), *[(i, "Wonderful weather") for i in range(5, 60)], (5, "Wonderful weather")]
    got = {r["word"]: r["n"] for r in spelling.vocabulary(docs(spark, rows)).collect()}
    assert got == plain_vocabulary(rows) and "ärzteschaft" not in got and sum(w.startswith("wonderfu") for w in got)
    assert {tuple(r) for r in spelling.spelling_variants(docs(spark, rows)).collect()} == plain_variants(plain_vocabulary(rows))
    assert spelling.spelling_variants(empty(spark)).count() == 0


# --- repeated passages


def plain_removal(rows, window):
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in split:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return collections.Counter(out)


def passage_rows(rng, n=60):
    shared = [[f"s{k}_{j}" for j in range(int(rng.integers(5, 30)))] for k in range(5)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(int(rng.integers(0, 5))):
            words += shared[rng.integers(0, 5)] if rng.random() < 0.5 else [f"w{x}" for x in rng.integers(0, 40, int(rng.integers(1, 20)))]
        rows.append((int(rng.integers(0, 50)), " \n".join(words) if i % 3 else "\t" + " ".join(words) + " "))
    return rows


@pytest.mark.parametrize("unit_bytes", [1, 300, 10**6])
def test_removal_against_brute_force(spark, unit_bytes):
    rows = passage_rows(np.random.default_rng(unit_bytes))
    rows += [(None, rows[3][1]), (None, None), (70, None), (71, ""), (72, " \n"), (73, "Case case"), *[rows[5]] * 3, (80, "a b " * 300), (81, "b a " * 40), (82, rows[7][1].upper())]
    got = passages.remove_repeats(docs(spark, rows).repartition(5), window=6, anchor=3, unit_bytes=unit_bytes, blocks=4)
    assert collections.Counter(map(tuple, got.collect())) == plain_removal(rows, 6)
    assert passages.remove_repeats(empty(spark)).count() == 0


def test_removal_with_few_cells(spark):
    """Where all windows share eight cells, every one is estimated as repeated and the exact step decides alone."""
    rows = passage_rows(np.random.default_rng(5))
    p = passages.Passages(docs(spark, rows), window=6, anchor=3)
    p.bits, p.block_bits = 3, 2
    sketch = p.sketch()
    flags = [np.unpackbits(np.frombuffer(x["bits"], np.uint8)) for r in sketch.collect() for x in r["answers"]]
    assert np.mean(np.concatenate(flags)) > 0.7  # of whole bytes; the rest is padding
    assert collections.Counter(map(tuple, p.removed(sketch, p.exact(sketch)).collect())) == plain_removal(rows, 6)


def test_ids_of_any_type_and_long_texts(spark):
    rng = np.random.default_rng(9)
    long = " ".join(f"w{x}" for x in rng.integers(0, 10**6, 60_000))
    rows = [("b", long), ("a", long[1000:9000]), ("é", long), ("z", "x " + long[:5000]), (None, long)]
    d = spark.createDataFrame([(*r, 1) for r in rows], "doc_id string, text string, n_words int")
    assert collections.Counter(map(tuple, passages.remove_repeats(d).collect())) == plain_removal(rows, 50)


def test_window_hashes():
    rng = np.random.default_rng(2)
    h = rng.integers(0, 2**63, 200).astype(np.uint64)
    h[100:150] = h[20:70]
    for lane in (0, 1):
        p = passages.polynomial(h, 30, lane)
        assert len(p) == 171 and (p[100:121] == p[20:41]).all() and len(set(p.tolist())) == 171 - 21
    assert len(passages.polynomial(h[:5], 6)) == 0
    for k in (1, 2, 3, 26):
        assert (passages._least(h, k) == [h[i : i + k].min() for i in range(200 - k + 1)]).all()


# --- importance resampling


def plain_resample(rows, target, orders, buckets, percent, least):
    def features(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, orders + 1) for i in range(len(w) - k + 1)]

    s, t = collections.Counter(), collections.Counter()
    for _, x in rows:
        s.update(features(x)[1])
    for x in target:
        t.update(features(x)[1])
    ns, nt = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (ns + buckets) / ((s[b] + 1) * (nt + buckets)))) for b in range(buckets)}
    out = []
    for i, x in rows:
        n, f = features(x)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return collections.Counter(tuple(r[:5]) for r in out)


@pytest.mark.parametrize("orders", [1, 3])
def test_resample_against_plain_python(spark, orders):
    rng = np.random.default_rng(orders)
    words = ["One", "two", "dréi", "4", "fünf", "six-seven", "Ünter", "x\x00y", "\U0001f600"]
    rows = [(int(rng.integers(0, 120)), " ".join(rng.choice(words, int(rng.integers(0, 40))))) for _ in range(300)]
    rows += [(7, "one two " * 20)] * 40 + [(None, "one two " * 20), (None, None), (8, ""), (9, "!!"), (10, "word " * 30_000)]
    target = ["one two dréi", "one one 4", None, ""]
    items = spark.createDataFrame([(i, t, "x") for i, t in enumerate(target)], "item_id long, text string, row string")
    d = docs(spark, rows).withColumn("row", resample.F.lit("clash")).repartition(6)
    got = resample.resample(d, items, orders, 50, 2024, 30, 5).collect()
    assert collections.Counter(map(tuple, got)) == plain_resample(rows, target, orders, 50, 30, 5)
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, sum(r["rank"] is not None for r in got) + 1))


def test_resample_of_nothing(spark):
    items = spark.createDataFrame([], "item_id long, text string")
    assert resample.resample(empty(spark), items).count() == 0
    got = resample.resample(docs(spark), items).collect()
    assert len(got) == docs(spark).count() and all(r["rank"] is None for r in got if not r["n_features"])


def test_new_queries_have_their_columns(spark, sf):
    assert queries.op11_spelling(spark, sf).columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert queries.op12_passages(spark, sf).columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert queries.op13_resample(spark, sf).columns == ["doc_id", "n_features", "weight", "score", "rank"]
