import collections
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import packing, queries, repair, token_output
from corpusloom.llm.common import table
from corpusloom.llm.encode import UnitEncoder, tokenizer_path

from .cases import docs, empty


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def units():
    return UnitEncoder(tokenizer_path())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("abcXYZ'st 0!.,\n<|endoftext|>éÉßÿſİŉ×«ΣςH̱\x1c\x85"), st.characters(codec="utf-8"))), max_size=5))
def test_encoder_is_exact(units, plain, texts):
    ids, bounds = units.encode(texts)
    for i, t in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == plain(t)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5), min_size=1, max_size=200), min_size=1, max_size=6), st.data())
def test_repair_round_trip(rows, data):
    ids = np.array(sum(rows, []), np.uint32)
    bounds = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    shard = repair.Shard(repair.compress(np.arange(len(rows)), ids, bounds))
    assert shard.all_ids().tolist() == ids.tolist()
    i = data.draw(st.integers(0, len(rows) - 1))
    lo = data.draw(st.integers(0, len(rows[i])))
    hi = data.draw(st.integers(lo, len(rows[i])))
    assert shard.document(i).tolist() == rows[i] and shard.slice(i, lo, hi).tolist() == rows[i][lo:hi]


def test_repair_shrinks_repeats():
    ids = np.tile(np.arange(50, dtype=np.uint32), 400)
    shard = repair.Shard(repair.compress(np.array([3]), ids, np.array([0, len(ids)])))
    assert shard.n_symbols < len(ids) / 4 and shard.lengths[shard.base :].max() > 4 and shard.all_ids().tolist() == ids.tolist()


def expected_tokens(rows, plain):
    out, at = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*plain(text), 1]
        out.append((doc_id, at, len(ids), crc(ids)))
        at += len(ids)
    return out


def as_rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_token_output_over_the_table(spark, sf, plain):
    rows = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    got = as_rows(queries.op1_token_output(spark, sf), "doc_id", "start", "n_tokens", "ids_crc32")
    assert sorted(got) == expected_tokens(rows, plain)


@pytest.mark.parametrize("shard_tokens", [1, 100, 1 << 20])
def test_token_output_cases(spark, plain, shard_tokens):
    d = docs(spark)
    shards = token_output.encode_shards(d, tokenizer_path(), shard_tokens=shard_tokens).cache()
    got = as_rows(token_output.read_back(shards), "doc_id", "start", "n_tokens", "ids_crc32")
    rows = [(r[0] if r[0] is not None else None, r[1]) for r in d.select("doc_id", "text").collect()]
    want = expected_tokens(rows, plain)
    assert sorted(x[1:] for x in got) == sorted(x[1:] for x in want)


def test_token_output_empty(spark):
    assert token_output.read_back(token_output.encode_shards(empty(spark), tokenizer_path())).count() == 0


def check_packing(rows, got, plain, size=2048):
    by_seq = collections.defaultdict(list)
    for g in got:
        by_seq[g["sequence_id"]].append((g["offset"], g["length"]))
    for parts in by_seq.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= size
    want = collections.Counter()
    for doc_id, text in rows:
        ids = [*plain(text), 0]
        for k, s in enumerate(range(0, len(ids), size)):
            part = ids[s : s + size]
            want[doc_id, k, s, len(part), crc(part)] += 1
    assert collections.Counter((g["doc_id"], g["piece"], g["start"], g["length"], g["ids_crc32"]) for g in got) == want
    return len(by_seq)


def test_packing_over_the_table(spark, sf, plain):
    rows = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    got = queries.op2_packing(spark, sf).collect()
    n = check_packing(rows, got, plain)
    assert n <= -(-sum(g["length"] for g in got) // 2048) + 1


def test_packing_cases(spark, plain, monkeypatch):
    monkeypatch.setattr(packing, "RANK_ROWS", 2)
    d = docs(spark)
    rows = [tuple(r) for r in d.select("doc_id", "text").collect()]
    check_packing(rows, packing.pack(packing.cut(d, tokenizer_path()).cache()).collect(), plain)
    assert packing.pack(packing.cut(empty(spark), tokenizer_path())).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 30), max_size=12))
def test_plan_is_a_packing(histogram):
    first, bins = packing.best_fit(histogram, 20), packing.plan(histogram, 20)
    items = collections.Counter()
    for b, n in bins.items():
        assert sum(b) <= 20 and n > 0
        for x in b:
            items[x] += n
    assert items == collections.Counter(histogram)
    assert sum(bins.values()) <= sum(first.values())


def test_local_search_beats_best_fit():
    improved = 0
    rng = np.random.default_rng(5)
    for _ in range(60):
        h = collections.Counter(rng.integers(5, 50, 60).tolist())
        improved += sum(packing.plan(h, 100).values()) < sum(packing.best_fit(h, 100).values())
    assert improved > 0


def collide(n=2048):
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[t] for t in bits), "".join("ba"[t] for t in bits)


def test_units_made_to_collide(spark, plain):
    a, b = collide()
    texts = [a, b, f"{b} {a}", f"{a}, {b}!"]
    ids, bounds = UnitEncoder(tokenizer_path()).encode(texts)
    assert [ids[x:y].tolist() for x, y in zip(bounds[:-1], bounds[1:])] == [plain(t) for t in texts]
    cut = packing.cut(docs(spark, list(enumerate(texts))), tokenizer_path()).cache()
    check_packing(list(enumerate(texts)), packing.pack(cut).collect(), plain)


def test_units_of_one_hash_keep_their_ids(plain, monkeypatch):
    """With hashes of two bits nearly all units share one; their bytes tell them apart."""
    from corpusloom.llm import encode

    monkeypatch.setattr(encode, "mix64", lambda x: (x & np.uint64(3)) << np.uint64(40))
    enc = UnitEncoder(tokenizer_path())
    for _ in range(2):
        texts = ["It's one two, three; four-five SIX six 7 8.9", "uno dos tres quatro", "ähnlich Ähnlich œuvre", "it's ONE"]
        ids, bounds = enc.encode(texts)
        assert [ids[x:y].tolist() for x, y in zip(bounds[:-1], bounds[1:])] == [plain(t) for t in texts]


def test_long_texts_are_encoded_in_spans(plain, monkeypatch):
    from corpusloom.llm import encode

    monkeypatch.setattr(encode, "SPAN_CHARS", 50)
    enc = UnitEncoder(tokenizer_path())
    texts = ["one two's  three\n\n" * 40, "", "x" * 300, "word " + "y" * 200 + " don't «stop» × " * 9, "一二 " * 60, None]
    ids, bounds = enc.encode(texts)
    assert [ids[x:y].tolist() for x, y in zip(bounds[:-1], bounds[1:])] == [plain(t) for t in texts]


def test_other_vocabularies_go_whole():
    from corpusloom.llm.encode import has_units

    other = tokenizer_path("byte_bpe_50k.json")
    assert has_units(tokenizer_path()) and not has_units(other)
    from tokenizers import Tokenizer

    t, texts = Tokenizer.from_file(other), ["Hello  World's end \n\n x", "a b"]
    ids, bounds = UnitEncoder(other).encode(texts)
    assert [ids[x:y].tolist() for x, y in zip(bounds[:-1], bounds[1:])] == [t.encode(x, add_special_tokens=False).ids for x in texts]
