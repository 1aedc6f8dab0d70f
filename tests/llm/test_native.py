"""Chat formatting, sharding and fingerprints."""

import collections
import hashlib

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import chat, fingerprint, queries, sharding
from corpusloom.llm.common import table

from .cases import docs, empty

TURNS = [
    (1, 0, "system", "be \\ kind # now <b>"),
    (1, 1, "user", "### user: hi </turn>\n"),
    (1, 2, "assistant", "a\\#b \\\\ </turn>"),
    (1, 3, "user", None),
    (1, 4, "assistant", ""),
    (1, 5, "assistant", "ünï\ncode"),
    (2, 0, None, "no role"),
    (2, None, "we:ird\\: ### role", "null turn first"),
    (3, 1, "assistant", "tie"),
    (3, 1, "assistant", "tie"),
    (3, 1, "user", "tie"),
    (None, 0, "assistant", "null conversation"),
    *((9, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(1300)),
]


def turns(spark, rows=TURNS):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, seq int, formatted string")


def digests(rows):
    by = collections.defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is not None, t or 0, r or "", x or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = {}
    for c, v in by.items():
        v.sort()
        loss = "".join(x for _, _, r, x in v if r == "assistant")
        out[c] = (len(v), sha("".join(f"{r}\n{x}\n" for _, _, r, x in v)), len(loss), sha(loss))
    return out


def test_chat_round_trip(spark):
    formatted = chat.format_turns(turns(spark)).cache()
    got = chat.digest(chat.parse_turns(formatted)).collect()
    assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in got} == digests(TURNS)
    rows = sorted(formatted.where("conv_id = 9").collect(), key=lambda r: r["seq"])
    at = 0
    for n, r in enumerate(rows):
        assert (r["seq"], r["start"]) == (n, at)
        at += len(r["formatted"])
    assert [r["example"] for r in rows if r["target"]] == list(range(650))


def test_chat_examples_in_full(spark):
    formatted = chat.format_turns(turns(spark, TURNS[:6]))
    got = sorted(chat.expand(formatted).collect(), key=lambda r: r["example"])
    assert [r["text"][r["target_start"] : r["target_end"]] for r in got] == ["a\\\\\\#b \\\\\\\\ \\</turn>", "", "ünï\ncode"]
    assert all(r["text"].endswith(r["text"][r["target_start"] : r["target_end"]]) and r["text"].startswith("### system: be \\\\ kind \\# now \\<b> </turn>\n") for r in got)


def test_chat_query_has_the_extra_conversation(spark, sf):
    got = {r["conv_id"]: r for r in queries.op9_chat(spark, sf).collect()}
    said = "\\### Assistant: </turn> ok"
    rows = [tuple(r) for r in table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()] + [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    assert {i: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for i, r in got.items()} == digests(rows)


def test_chat_empty(spark):
    assert chat.digest(chat.parse_turns(chat.format_turns(turns(spark).limit(0)))).count() == 0


def brute_shards(rows, limit):
    h = [(int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:8], 16), len((t or "").encode())) for i, t in rows]
    out = []

    def split(members, depth, prefix):
        n = sum(h[m][1] for m in members)
        if n <= limit or len({h[m][0] for m in members}) == 1:
            out.extend((m, "s" + prefix, depth, n, n > limit) for m in members)
            return
        for bit in "01":
            part = [m for m in members if (h[m][0] >> (31 - depth)) & 1 == int(bit)]
            if part:
                split(part, depth + 1, prefix + bit)

    split(list(range(len(rows))), 0, "")
    return sorted((rows[m][0] is not None, rows[m][0] or 0, h[m][1], *rest) for m, *rest in out)


@pytest.mark.parametrize("limit", [1, 200, 5000, 100_000, 1 << 30])
def test_sharding_against_brute_force(spark, sf, limit):
    for d in (docs(spark), table(spark, sf, "documents")):
        rows = [tuple(r) for r in d.select("doc_id", "text").collect()]
        got = sharding.assign_shards(d.select("doc_id", "text", "lang"), limit=limit).collect()
        assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_bytes"], r["shard_id"], r["shard_depth"], r["shard_bytes"], r["oversized"]) for r in got) == brute_shards(rows, limit)


def test_sharding_splits_deep_cells_again(spark):
    rows = [(7, "x" * 50)] * 40 + [(i, "y") for i in range(8, 38)]
    got = sharding.assign_shards(docs(spark, rows), limit=100).collect()
    assert {(r["shard_bytes"], r["oversized"]) for r in got if r["doc_id"] == 7} == {(2000, True)}
    assert sharding.assign_shards(empty(spark)).count() == 0


def test_write_shards(spark, sf, tmp_path):
    out = sharding.assign_shards(table(spark, sf, "documents"), limit=100_000)
    sharding.write_shards(out, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == out.count()
    assert not [r for r in back.groupBy("shard_id").agg({"n_bytes": "sum"}).collect() if r[1] > 100_000]


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()


def likeness(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints_over_the_table(spark, sf, monkeypatch):
    monkeypatch.setattr(fingerprint, "BUCKET_ROWS", 30)
    rows = sorted((r[0], r[1] or "") for r in table(spark, sf, "documents").select("doc_id", "text").collect())
    got = {r["doc_id"]: r for r in queries.op7_fingerprints(spark, sf).collect()}
    assert len(got) == len(rows)
    errors, by_text = [], {}
    for n, (i, x) in enumerate(rows):
        y, r, h = rows[(n + 1) % len(rows)][1], got[i], len(x) // 2
        edited = x[: len(x) - h] + y[:h]
        assert (r["n_chars"], r["edited_sha256"]) == (len(x), hashlib.sha256(edited.encode()).hexdigest())
        assert by_text.setdefault(x, r["fingerprint"]) == r["fingerprint"]
        errors += [r["near_edited"] - likeness(x, edited), r["near_next"] - likeness(x, y)]
    assert abs(sum(errors) / len(errors)) < 0.02 and max(map(abs, errors)) < 0.25


def test_fingerprint_cases(spark):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (3, ""), (4, None), (9, "one"), (9, "one"), (12, " \t"), (None, "none")]
    got = fingerprint.fingerprints(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["fingerprint"] == by[2]["fingerprint"] and by[1]["near_next"] == 1.0
    assert by[3]["fingerprint"] == by[4]["fingerprint"] == by[12]["fingerprint"] == "" and by[3]["near_next"] == 1.0 and by[2]["near_next"] == 0.0
    assert len(by[9]["fingerprint"]) == 2 * fingerprint.BINS
    assert fingerprint.fingerprints(empty(spark)).count() == 0


def test_sharding_keeps_clashing_columns(spark):
    rows = spark.createDataFrame([(1, "ab", "mine", 5, 6, "x"), (2, None, "yours", 7, 8, "y")], "doc_id long, text string, shard_id string, N_BYTES int, _h int, input_shard_id string")
    got = {r["doc_id"]: r.asDict() for r in sharding.assign_shards(rows).collect()}
    assert got[1]["input_input_shard_id"] == "mine" and got[1]["input_shard_id"] == "x" and got[1]["input_N_BYTES"] == 5 and got[1]["_h"] == 6
    assert got[1]["n_bytes"] == 2 and got[2]["n_bytes"] == 0 and got[2]["shard_id"] == "s"


@pytest.mark.parametrize("ids", [[-(2**63), 2**63 - 1, 0, 5, 10**15], [7] * 400 + [9] * 3, [None] * 300 + [1, 2], list(range(200)) + [10**15], [4]])
def test_fingerprint_neighbours_for_any_ids(spark, monkeypatch, ids):
    monkeypatch.setattr(fingerprint, "BUCKET_ROWS", 20)
    rows = [(i, f"text {n} " * (3 + n % 4)) for n, i in enumerate(ids)]
    hashed = {t: spark_hash(t.encode()) for _, t in rows}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashed[r[1]], r[1]))
    want = collections.Counter()
    for n, (i, x) in enumerate(order):
        y, h = order[(n + 1) % len(order)][1], len(x) // 2
        want[i, hashlib.sha256((x[: len(x) - h] + y[:h]).encode()).hexdigest()] += 1
    d = docs(spark, rows)
    assert collections.Counter((r["doc_id"], r["edited_sha256"]) for r in fingerprint.fingerprints(d).collect()) == want
    sizes = [r["count"] for r in fingerprint._buckets(d.select("doc_id", "text")).groupBy("bucket").count().collect()]
    assert max(sizes) <= 60


def test_fingerprints_of_very_many_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "BUCKET_ROWS", 20)
    monkeypatch.setattr(fingerprint, "COPIES", 64)
    rows = [(7, "the same row again")] * 900 + [(7, "another text")] * 70 + [(None, "no id")] * 200 + [(None, None)] * 50 + [(i, f"text {i}") for i in range(30)]
    hashed = {t or "": spark_hash((t or "").encode()) for _, t in rows}
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, hashed[r[1]], r[1]))
    want = collections.Counter()
    for n, (i, x) in enumerate(order):
        y, h = order[(n + 1) % len(order)][1], len(x) // 2
        want[i, hashlib.sha256((x[: len(x) - h] + y[:h]).encode()).hexdigest(), x == y] += 1
    d = docs(spark, rows)
    got = fingerprint.fingerprints(d).collect()
    assert collections.Counter((r["doc_id"], r["edited_sha256"], r["near_next"] == 1.0) for r in got) == want
    cut = fingerprint._buckets(d.na.fill({"text": ""}))
    assert max(r["count"] for r in cut.groupBy("bucket").count().collect()) <= 60


def test_sharding_bounds_its_levels(spark):
    sizes = spark.range(4000).select(sharding._hash("id").alias("_h"), F.when(F.col("id") < 5, 10_000).otherwise(1).cast("long").alias("_bytes"))
    levels = sharding.directory(sizes, 9000)
    assert len(levels) > 1 and levels[-1][1] <= sharding.BROADCAST_CELLS
    assert all(cells.count() <= most <= 2**bits for bits, most, cells in levels)


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def spark_hash(*parts, seed=42):
    """Spark's xxhash64 of byte strings, longs and ``("int", n)``, folded from left to right."""
    import xxhash

    for p in parts:
        raw = p if isinstance(p, bytes) else p[1].to_bytes(4, "little", signed=True) if isinstance(p, tuple) else p.to_bytes(8, "little", signed=True)
        seed = xxhash.xxh64_intdigest(raw, seed % 2**64)
    return signed(seed)


def plain_lanes(text, bins=128, bits=8):
    """One-permutation MinHash with a densifying walk, slot by slot."""
    words = [spark_hash(w.encode()) for w in text.lower().split()]
    hashes = {spark_hash(*words[i : i + 5]) for i in range(len(words) - 4)} if len(words) > 4 else {spark_hash(*words)} if words else set()
    least = {}
    for x in hashes:
        j = (x >> 57) + bins // 2
        least[j] = min(least.get(j, x), x)
    out = []
    for j in range(bins if least else 0):
        at, tries = j, 0
        while at not in least and tries < fingerprint.WALK:
            tries += 1
            at = spark_hash(("int", j), ("int", tries)) % bins
        if at not in least:
            at = min(least, key=lambda y: spark_hash(("int", j), ("int", y), ("int", -1)))
        out.append(least[at] & (2**bits - 1))
    return "".join(f"{x:02x}" for x in out)


def test_lanes_against_a_plain_version(spark):
    texts = ["one", "a b c d e f", "", "ä b ä b ä b", *(" ".join(f"w{(i * n * 7919) % 1000}" for i in range(n)) for n in (5, 12, 40, 90, 200, 900))]
    got = fingerprint.fingerprints(docs(spark, list(enumerate(texts)))).collect()
    assert {r["doc_id"]: r["fingerprint"] for r in got} == {i: plain_lanes(t) for i, t in enumerate(texts)}
