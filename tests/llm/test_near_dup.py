import random

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm import near_dup, superminhash

from .cases import docs, empty


def shingles(text):
    w = (text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")).split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()


def brute(rows):
    sets = {}
    for doc_id, text in rows:
        sets.setdefault(doc_id, []).append(shingles(text))
    sets = {k: min(v, key=len) if len(v) > 1 else v[0] for k, v in sets.items()}
    ids = sorted(sets)
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def family(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("small", [2, 32])
def test_against_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(near_dup, "SMALL", small)
    monkeypatch.setattr(near_dup, "BLOCK", 8)
    rng = random.Random(small)
    word = lambda: f"w{rng.randrange(400)}"
    texts = []
    for size, n, edits in ((40, 25, 3), (120, 30, 12), (60, 20, 6), (8, 10, 1)):
        texts += family(rng, [word() for _ in range(size)], n, edits)
    shared = " ".join(word() for _ in range(60))
    texts += [shared + " " + " ".join(word() for _ in range(rng.choice((10, 20, 40)))) for _ in range(40)]
    texts += ["exact copy of a text with several words in it"] * 30 + ["", None, "one", "One", " two  words"]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    want = brute(rows)
    got = {r["doc_id"]: r for r in near_dup.near_duplicates(docs(spark, rows)).collect()}
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_cases(spark):
    got = near_dup.near_duplicates(docs(spark)).collect()
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] != 6}
    assert len(got) == docs(spark).count()
    assert by_id[2]["n_shingles"] == by_id[3]["n_shingles"] == by_id[4]["n_shingles"] == 0
    assert by_id[5]["n_shingles"] == 1 and by_id[8]["n_shingles"] == 5
    assert by_id[None]["component_id"] is None and not by_id[None]["kept"]
    assert all(by_id[i]["kept"] for i in (1, 2, 3, 4, 5, 7, 8))
    assert near_dup.near_duplicates(empty(spark)).count() == 0


def test_superminhash_is_unbiased_and_complete():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(60):
        n = int(rng.integers(3, 300))
        pool = rng.integers(0, 2**63, 2 * n, dtype=np.uint64)
        cut = int(rng.integers(0, n))
        a, b = np.unique(pool[: n + cut]), np.unique(pool[cut:])
        sig = superminhash.superminhash(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 128)
        assert (sig != superminhash.EMPTY).all() and (sig >> np.uint64(32)).max() < 128
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        errors.append((sig[0] == sig[1]).mean() - true)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.045


def test_superminhash_matches_the_sequential_definition():
    m, elements = 16, np.array([5, 77, 12345, 2**60], np.uint64)
    want = np.full(m, superminhash.EMPTY, np.uint64)
    for e in elements:
        perm = list(range(m))
        for level in range(m):
            r, pick = superminhash._draw(np.array([e]), level)
            j = level + (int(pick[0]) * (m - level) >> 32)
            perm[level], perm[j] = perm[j], perm[level]
            want[perm[level]] = min(want[perm[level]], r[0] + np.uint64(level << 32))
    assert (superminhash.superminhash(elements, np.array([0, 4]), m)[0] == want).all()


def thue_morse(n, a="x", b="y"):
    """Two words of ``n`` letters that collide under every polynomial hash modulo 2**64."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join((a, b)[t] for t in bits), "".join((b, a)[t] for t in bits)


def test_words_made_to_collide(spark):
    x, y = thue_morse(2048)
    rows = [(1, f"{x} one two three four five"), (2, f"{y} one two three four five"), (3, x), (4, y), (5, f"{x} {y} {x} {x} {y}"), (6, f"{x} {y} {x} {y} {y}"), (7, x.upper())]
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(docs(spark, rows)).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6, 7: 3}


def test_numbers_of_shingles_are_exact_when_hashes_collide(monkeypatch):
    from corpusloom.llm import common

    texts = ["a b c d e f g", "a b c d e f h", "G b c d e", "", None, "a b", "b a", "x" * 500 + " " + "x" * 499 + "y"]
    want = [shingles(t) for t in texts]
    keyed = common._random
    for bits in (64, 2, 0):  # fewer bits: nearly all words and shingles share a hash
        common._table.cache_clear()
        monkeypatch.setattr(common, "_random", lambda code, lane, bits=bits: keyed(code, lane) & np.uint64(2**bits - 1))
        got = common.shingle_ids(pa.array(texts, pa.string()))
        for a, x in zip(want, got):
            for b, y in zip(want, got):
                assert len(a & b) == len(np.intersect1d(x, y)) and len(a) == len(x)
    monkeypatch.undo()
    common._table.cache_clear()


def test_rows_of_one_id_belong_together(spark):
    rows = [(1, "a b c d e f g"), (2, "q r s t u v w"), (2, "a b c d e f g"), (3, "q r s t u v w"), (3, "q r s t u v w"), (4, None), (4, "z z z z z z")]
    got = near_dup.near_duplicates(docs(spark, rows)).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(1, 1), (2, 1), (2, 1), (3, 1), (3, 1), (4, 4), (4, 4)]


def test_a_common_header_makes_no_pairs(spark, monkeypatch):
    rng = random.Random(9)
    header = " ".join(f"h{i}" for i in range(60))
    texts = [header + " " + " ".join(f"u{rng.randrange(10**9)}" for _ in range(n)) for n in [12] * 120 + [30] * 120]
    rows = list(enumerate(texts))
    seen = []
    block = near_dup._block_links
    monkeypatch.setattr(near_dup, "_block_links", lambda *a: seen.append(1) or block(*a))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(docs(spark, rows)).collect()}
    assert got == brute(rows) and not seen
