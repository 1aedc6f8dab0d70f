"""What the queries write on their way to a result."""

from corpusloom.llm import chat, extract, language, queries, sharding
from corpusloom.llm.common import table

from .cases import docs
from .test_native import TURNS, brute_shards, digests, turns


class Kept(queries.Scratch):
    """A scratch folder at a place that the test knows."""

    root_of: str

    def __init__(self, spark, name):
        self.spark, self.root = spark, self.root_of


def test_op8_writes_its_shards(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setattr(Kept, "root_of", f"file://{tmp_path}", raising=False)
    monkeypatch.setattr(queries, "Scratch", Kept)
    got = queries.op8_sharding(spark, sf).collect()
    texts = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{tmp_path}/shards").select("doc_id", "text").collect())
    rows = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    assert texts == sorted(rows)
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_bytes"], r["shard_id"], r["shard_depth"], r["shard_bytes"], r["oversized"]) for r in got) == brute_shards(rows, sharding.LIMIT_BYTES)


def test_oversized_shard_is_written_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "FILE_BYTES", 200)
    rows = [(7, "x" * 50)] * 40 + [(i, "y") for i in range(8, 38)]
    d = docs(spark, rows).withColumn("_row", sharding.F.monotonically_increasing_id())
    out = sharding.assign_shards(d, limit=100)
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")  # so small parts would else become one task again
    try:
        sharding.write_shards(out, str(tmp_path / "s"), "_row")
    finally:
        spark.conf.unset(coalesce)
    back = sharding.read_shards(spark, str(tmp_path / "s"), out.drop("_row").schema)
    assert sorted((r["doc_id"], r["text"]) for r in back.collect()) == sorted(rows)
    per_file = back.where("doc_id = 7").groupBy(sharding.F.input_file_name()).count().collect()
    assert len(per_file) > 1 and max(r["count"] for r in per_file) < 40


def test_chat_loss_comes_from_examples(spark):
    formatted = chat.format_turns(turns(spark)).cache()
    e = chat.examples(formatted).cache()
    assert e.count() == sum(r == "assistant" for _, _, r, _ in TURNS)
    stream = formatted.select("conv_id", "seq", "start", "formatted")
    read = lambda x: {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.digest(chat.parse_turns(chat.with_examples(stream, x))).collect()}
    assert read(e) == digests(TURNS)
    assert {r[2] for r in read(e.limit(0)).values()} == {0}
    text = {}
    for r in sorted(formatted.where("conv_id = 9").collect(), key=lambda r: r["seq"]):
        text[9] = text.get(9, "") + r["formatted"]
    for r in e.where("conv_id = 9").collect():
        k = 2 * r["example"] + 1
        assert text[9][r["target_start"] : r["target_end"]] == f"turn {k}" and text[9][: r["context_end"]].endswith(f"turn {k - 1} </turn>\n")


def test_op9_builds_examples(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setattr(Kept, "root_of", f"file://{tmp_path}", raising=False)
    monkeypatch.setattr(queries, "Scratch", Kept)
    queries.op9_chat(spark, sf)
    said = table(spark, sf, "conversations").where("role = 'assistant'").count()
    assert spark.read.parquet(f"{tmp_path}/examples").count() == said + 1


def test_every_language_fills_its_reference(spark, sf, monkeypatch):
    seen = {}
    init = language.Model.__init__
    monkeypatch.setattr(language.Model, "__init__", lambda self, refs, *a: (seen.update(refs), init(self, refs, *a))[1])
    d = table(spark, sf, "documents")
    language.fit(d)
    whole = {}
    for r in d.where(~language.held_out()).where("lang is not null and text is not null").collect():
        reduced = "".join(chr(c) if c else " " for c in language.reduce_text(r["text"]).tolist())
        whole.setdefault(r["lang"], []).append(reduced)
    assert set(seen) == set(whole)
    for k, texts in whole.items():  # fewer than 300 documents each, so all are in the sample
        assert len(texts) < language.SAMPLE_DOCS and set(seen[k]) <= set(texts)
        left = language.REFERENCE_CHARS - sum(map(len, seen[k]))
        unused = [len(t) for t in texts if t and t not in seen[k]]
        assert 0 <= left and (not unused or left < min(unused))


def test_letters_beyond_the_table_are_told_apart():
    """Two languages of the same rhythm in 150 letters each; 62 of all would be columns."""
    a, b = ([chr(lo + i) for i in range(150)] for lo in (0x4E00, 0x5E00))
    speak = lambda v, seed: " ".join("".join(v[(seed * 7 + 11 * i + j * (i % 5)) % 150] for j in range(4)) for i in range(120))
    m = language.Model({"a": [speak(a, 1)], "b": [speak(b, 1)]})
    assert len(m.alphabet) > 250 and len(m.rare_keys)
    assert m.predict([speak(a, 1)[9:99], speak(b, 1)[9:99]])[0] == ["a", "b"]
    n, _ = m.phrases([speak(b, 1)[9:99]])
    assert n[0][1] <= 2 < n[0][0]


def test_rare_letters_parse_as_columns_do():
    refs = {"a": ["the cat sat on the mat and the dog"], "b": ["der hund und die katze auf der matte"]}
    texts = ["the dog and the cat", "die katze und der hund", "qqq the", "", None, "x" * 1300, "the cat " * 200]
    wide, narrow = language.Model(refs, chars=100), language.Model(refs, chars=100, symbols=4)
    assert len(narrow.rare_keys) and not len(wide.rare_keys)
    assert (wide.phrases(texts)[0] == narrow.phrases(texts)[0]).all()


def test_text_beside_teasers_is_kept(spark):
    menu = " ".join(f"menu{j}" for j in range(12))
    own = [" ".join(f"u{i}_{j}" for j in range(30)) for i in range(4)]
    rows = [(i, "https://p.net/x", f"<div>{menu}</div><article>teaser {i}</article><div>{own[i]}</div><article>last</article>") for i in range(4)]
    got = {r["page_id"]: r["text"] for r in extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"teaser {i} {own[i]} last" for i in range(4)}


def test_only_hidden_elements_are_hidden():
    shown = ['style="overflow:hidden"', 'class="overflow-hidden"', "data-x=hidden", 'title="is hidden"', 'aria-hidden="false"', 'style="x-display:none"']
    gone = ["hidden", "HIDDEN", 'hidden=""', "class=a hidden", 'aria-hidden="true"', "aria-hidden=true", 'style="color:red; display: none"', "style=display:none"]
    page = lambda attrs: extract.blocks(f"<article><p>kept</p><p {attrs}>text</p></article>")[0]
    assert [x for x in shown if page(x) != ["kept", "text"]] == [] and [x for x in gone if page(x) != ["kept"]] == []
