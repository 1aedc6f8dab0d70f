"""Language, quality, decontamination, page text and the pipeline."""

import collections
import zlib

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm import decontaminate, extract, language, quality, queries
from corpusloom.llm.common import table

from .cases import docs, empty
from .test_near_dup import brute, shingles
from .test_tokens import check_packing


def longest_matches(text, reference):
    n, at = 0, 0
    while at < len(text):
        k = 1
        while at + k <= len(text) and text[at : at + k] in reference:
            k += 1
        n, at = n + 1, at + max(1, k - 1)
    return n


def test_cross_parsing_against_brute_force():
    refs = {"a": ["the cat sat on the mat and the dog"], "b": ["der hund und die katze auf der matte"]}
    m = language.Model(refs, chars=100)
    texts = ["the dog and the cat", "die katze und der hund", "qqq the", "", None, "12 34", "x" * 1300, "the cat " * 200]
    got, size = m.phrases(texts)
    letters = {chr(c) for c in m.alphabet}
    for t, row in zip(texts, got):
        x = "".join(chr(c) if c else " " for c in language.reduce_text(t or ""))
        x = "".join(c if c == " " or c in letters else "\0" for c in x) + (" " if x else "")
        for j, k in enumerate(m.langs):
            ref = " " + "".join(chr(c) if c else " " for c in language.reduce_text(refs[k][0])) + " "
            assert row[j] == sum(longest_matches(x[i : i + language.LANE], ref) for i in range(0, len(x), language.LANE)), (t, k)
    assert m.predict(texts)[0][:2] == ["a", "b"] and m.predict(texts)[0][3:6] == ["und"] * 3


def test_language_held_out(spark, sf):
    got = {r["doc_id"]: r for r in queries.op6_language(spark, sf).collect()}
    truth = {r["doc_id"]: r["lang"] for r in table(spark, sf, "documents").collect()}
    assert set(got) == set(truth)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    hits = [got[i]["lang_pred"] == truth[i] for i in got if got[i]["held_out"]]
    assert np.mean(hits) > 0.93
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_cases(spark):
    by = collections.defaultdict(list)
    for r in language.identify(docs(spark)).collect():
        by[r["doc_id"]].append(r["lang_pred"])
    assert by[2] == by[3] == by[4] == ["und"] and by[1] == ["en"]
    assert language.identify(empty(spark)).count() == 0
    unlabelled = docs(spark).withColumn("lang", language.F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language.identify(unlabelled).collect()} == {"und"}


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in queries.op3_quality(spark, sf).collect()}
    marks = {r["doc_id"]: r["quality"] for r in table(spark, sf, "labels").collect()}
    held = [i for i in marks if got[i]["held_out"]]
    assert len(got) == 1000 and np.mean([got[i]["predicted"] == marks[i] for i in held]) > 0.95
    assert all(r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in got.values())


def test_quality_finds_poor_documents_from_few_labels(spark):
    """Of the poor documents that were held out, and of those that were not, with 8 and 47 poor ones to learn from."""
    for name, least in (("sf0.001", 2), ("sf0.01", 10)):
        sf = f"/root/testdata/{name}"
        got = {r["doc_id"]: r for r in queries.op3_quality(spark, sf).collect()}
        marks = {r["doc_id"]: r["quality"] for r in table(spark, sf, "labels").collect()}
        assert sum(got[i]["predicted"] == 0 for i, q in marks.items() if q == 0 and got[i]["held_out"]) >= least
        assert all(got[i]["predicted"] == 0 for i, q in marks.items() if q == 0 and not got[i]["held_out"])
        assert all(got[i]["predicted"] == 1 for i, q in marks.items() if q == 1)


@pytest.mark.parametrize("kind", ["bigint", "boolean", "string", "double"])
def test_quality_labels_of_any_type(spark, kind):
    marks = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (8, 1, None)], "doc_id long, quality int, toxic int")
    cast = marks.withColumn("quality", marks["quality"].cast("boolean" if kind == "boolean" else kind))
    want = [r["score"] for r in quality.classify(docs(spark), marks).collect()]
    assert [r["score"] for r in quality.classify(docs(spark), cast).collect()] == want


def plain_counts(text):
    low = (text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))
    words = low.split()
    n_again = sum(a == b for a, b in zip(words, words[1:]))
    return len(words), n_again, len(set(words))


def test_quality_features():
    texts = ["one two two three", "", None, "a", "ab", "x " * 50, "Ünï ünï Ünï"]
    x = quality.counts(pa.array(texts))
    for t, row in zip(texts, x):
        n, again, _ = plain_counts(t)
        assert row[: quality.WORDS].sum() == n and row[0] == again
    assert x[0, quality.WORDS :].sum() == len("one two two three") - 2 - 3 and not x[1].any() and not x[2].any()
    for a, b in ((["the cat sat on the mat."], ["buy now big sale ends x."]), (["ab cd"], ["cd ab"])):
        assert (quality.counts(pa.array(a)) != quality.counts(pa.array(b))).any()


def test_quality_counts_in_spans(monkeypatch):
    texts = pa.array(["lorem ipsum dolor dolor sit " * 30, "amet", "consectetur adipiscing " * 9])
    want = quality.counts(texts)
    monkeypatch.setattr(quality, "SPAN_BYTES", 13)
    assert (quality.counts(texts) == want).all()


def test_quality_votes_against_brute_force():
    rng = np.random.default_rng(3)
    texts = pa.array([" ".join(rng.choice(["abc", "def", "ghi", "jkl"] if n % 2 else ["BUY!!", "now", "sale", "abc"], int(n))) for n in rng.integers(1, 40, 300)])
    labels = np.array([float("sale" not in t) for t in texts.to_pylist()])
    s = quality.Space(quality.counts(texts), labels)
    v = s.project(quality.counts(texts))
    assert np.allclose(v, s.vectors, atol=1e-4)
    got = s.score(v, neighbours=7)
    for i in range(300):
        cos = [round(float(np.dot(s.vectors[j].astype(float), v[i])), quality.DIGITS) for j in range(300)]
        near = sorted(range(300), key=lambda j: (-cos[j], j))[:7]
        w = [max(cos[j], 0) ** quality.POWER / (labels == labels[j]).sum() for j in near]
        assert abs(got[i] - sum(a * labels[j] for a, j in zip(w, near)) / sum(w)) < 1e-3
    zero = s.score(np.zeros((1, v.shape[1]), np.float32))
    assert zero[0] == pytest.approx(labels.mean())


def test_quality_over_the_table_against_brute_force(spark, sf):
    """Every score of the query, from the operator's space by a loop over the labelled vectors."""
    d, marks = table(spark, sf, "documents"), table(spark, sf, "labels")
    s = quality.fit(d, marks)
    rows = d.select("doc_id", "text").collect()
    got = {r["doc_id"]: r["score"] for r in queries.op3_quality(spark, sf).collect()}
    for r in rows:
        v = s.project(quality.counts(pa.array([r["text"]], pa.string())))[0]
        cos = np.rint((s.vectors @ v).astype(float) * 10**quality.DIGITS)
        near = sorted(range(len(cos)), key=lambda j: (-cos[j], j))[: quality.NEIGHBOURS]
        w = [(max(cos[j], 0) / 10**quality.DIGITS) ** quality.POWER / (s.labels == s.labels[j]).sum() for j in near]
        want = sum(a * s.labels[j] for a, j in zip(w, near)) / sum(w) if sum(w) else s.prior
        assert abs(got[r["doc_id"]] - want) < 1e-3


def test_null_and_repeated_ids_do_not_fill_the_samples(spark):
    rows = [(None, f"null id {i} with words") for i in range(400)] + [(1, "a repeated row of words")] * 400 + [(i, f"text number {i}") for i in range(2, 30)]
    marks = spark.createDataFrame([(i, i % 2, 0) for i in [1] * 50 + list(range(2, 30))] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    s = quality.fit(docs(spark, rows), marks, sample_docs=10)
    assert len(s.labels) == 10
    d = docs(spark, rows)
    learned = []
    keep = language.Model
    try:
        language.Model = lambda refs, *a: learned.append(refs) or keep(refs, *a)
        language.fit(d, sample_docs=20)
    finally:
        language.Model = keep
    assert 1 <= len(learned[0]["en"]) <= 60


def test_predictions_under_clashing_names(spark):
    d = docs(spark).withColumns({"lang_pred": language.F.lit(7), "Quality_Score": language.F.lit("q")})
    marks = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (8, 1, None)], "doc_id long, quality int, toxic int")
    a = language.predict(d, language.fit(d), d.columns, "found", "how_sure")
    b = quality.predict(d, quality.fit(d, marks), d.columns, "q2")
    assert a.columns == [*d.columns, "found", "how_sure"] and b.columns == [*d.columns, "q2"]
    assert {(r["lang_pred"], r["Quality_Score"]) for r in a.collect()} == {(7, "q")} and b.count() == d.count()


def test_language_of_other_scripts(spark):
    base = {"zh": "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏闰余成岁律吕调阳", "ja": "いろはにほへとちりぬるをわかよたれそつねならむうゐのおくやまけふこえて", "en": "the quick brown fox jumps over the lazy dog and runs away", "ru": "съешь же ещё этих мягких французских булок да выпей чаю"}
    rng = np.random.default_rng(4)
    rows = []
    for k, t in base.items():
        for _ in range(40):
            cut = sorted(rng.integers(0, len(t), 2))
            rows.append((len(rows), t[cut[0] : cut[1]] + " " + t, k))
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language.identify(d).collect()}
    assert all(got[i]["lang_pred"] == k and got[i]["score"] > 0.6 for i, _, k in rows)


def test_choice_of_whole_texts():
    assert language.choose([5, 0, 9, 3, 2], 10) == [0, 3, 4]
    assert language.choose([50, 0, 20], 10) == [2] and language.choose([0], 10) == [] and language.choose([], 10) == []


def test_quality_cases(spark):
    marks = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (8, 1, None), (6, None, 1), (77, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs(spark), marks).collect()
    assert len(got) == docs(spark).count() and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in quality.classify(docs(spark), marks.limit(0)).collect()} == {0.5}
    assert quality.classify(empty(spark), marks).count() == 0


def items(spark, rows):
    return spark.createDataFrame([(*r, 3) for r in rows], "item_id long, text string, doc_id int")


def test_decontaminate_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    text = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 3000, n))
    tests = [(i, text(int(n))) for i, n in enumerate(rng.integers(1, 60, 60))] + [(90, None), (91, ""), (92, "word"), (93, "Word")]
    rows = []
    for i in range(150):
        parts = [text(int(rng.integers(0, 400)))]
        for _ in range(rng.integers(0, 3)):
            w = (tests[rng.integers(0, 60)][1]).split()
            if rng.random() < 0.5:
                w[rng.integers(0, len(w))] = "changed"
            parts.insert(rng.integers(0, 2), " ".join(w))
        rows.append((i, "\n".join(parts)))
    rows += [(200, None), (201, "word"), (202, " \n"), (203, text(60_000) + " " + tests[5][1])]
    want = set()
    for d, t in rows:
        a = shingles(t)
        for i, x in tests:
            b = shingles(x)
            if b and 100 * len(a & b) >= 75 * len(b):
                want.add((d, i, len(b), len(a & b)))
    for size in (1 << 24, 400):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        got = decontaminate.contaminated(docs(spark, rows), items(spark, tests)).collect()
        assert {tuple(r)[:4] for r in got} == want and len(got) == len(want) and len(want) > 50
    kept = {r["doc_id"] for r in decontaminate.clean(docs(spark, rows), items(spark, tests)).collect()}
    assert kept == {d for d, _ in rows} - {w[0] for w in want}
    assert decontaminate.contaminated(empty(spark), items(spark, tests)).count() == 0
    assert decontaminate.contaminated(docs(spark, rows), items(spark, tests).limit(0)).count() == 0


PAGES = [
    (1, "http://h.org/a", "<html><head><title>T</title></head><body><nav><ul><li>Menu</li></ul></nav><div class=\"ad\">Buy</div><article><h1>One &amp;amp; <b>two</b></h1><p>First <b>bold<br><p>Second\n para<script>x='<p>'</script></p><aside>side</aside><div class='comments'><p>nice</p></div></article><footer>foot</footer>"),
    (2, None, None),
    (3, "", ""),
    (4, "x", "plain text only &lt;b&gt; &#233;&nbsp;x"),
    (5, "http://h.org/b", "<article><header><h1>Head</h1></header><p>cut off <em>in the mid"),
    (6, "http://h.org/c", "<main><p class=\"notice\">cookie</p><p>kept <!-- not this --> text</p><form><p>q</p></form></main><p>outside</p>"),
    (7, "http://h.org/d", "<body><p a=\"x>y\">quoted > attr</p><div id=sidebar><p>no</p></div><p>yes"),
]


def test_page_text_cases(spark):
    d = spark.createDataFrame([(*r, "clash") for r in [*PAGES, PAGES[0]]], "page_id long, url string, html string, text string")
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in extract.main_text(d).collect())
    want = {1: "One &amp; two First bold Second para", 2: "", 3: "", 4: "plain text only <b> é x", 5: "Head cut off in the mid", 6: "kept text", 7: "quoted > attr yes"}
    assert got == sorted((i, want[i], len(want[i])) for i in [1, 1, 2, 3, 4, 5, 6, 7])
    assert extract.main_text(d.limit(0)).count() == 0


@pytest.mark.parametrize(
    "html, want",
    [
        ('<div class="site has-sidebar"><article><p>Main text.</p></article></div>', "Main text."),
        ('<div class="sidebar"><article><p>Only text.</p></article></div>', "Only text."),
        ('<article><div class="post-header"><h1>Head</h1></div><p>Body</p></article>', "Head Body"),
        ('<article><section id="discussion"><p>Results are discussed.</p></section></article>', "Results are discussed."),
        ('<article class="x"><div class="content no-comments"><p>Kept</p></div><div class="article-comments"><p>gone</p></div></article>', "Kept"),
        ('<article><p>Long main text of the page.</p></article><article><h2><a href="/x">Teaser of another story</a></h2></article>', "Long main text of the page."),
        ('<aside><article><p>teaser</p></article></aside><main><p>Main</p><div class="cookie-banner">ok?</div><div role="navigation">n</div></main>', "Main"),
        ('<div class="related"><article><p>Other story</p></article></div><article><p>This story</p></article>', "This story"),
        ("<article><h1>Head</h1><div class='content promo'><p>ARTICLE BODY of words</p></div></article>", "Head ARTICLE BODY of words"),
        ("<main><div class='menu text'><p>All of the text</p></div></main>", "All of the text"),
        ("<div class='notice content'><p>All of the text</p></div>", "All of the text"),
        ("<article><p>A text of some words.</p><section id='social'><p>Social matters too.</p></section></article>", "A text of some words. Social matters too."),
        ("<article><p>A text of quite some words here.</p>" + "".join(f"<div class='{x}'><p>{x} no</p></div>" for x in ("comment-thread", "comment-body", "comment-reply", "related-posts", "share-tools", "site-header")) + "</article>", "A text of quite some words here."),
        ("<article><p>Story.</p></article><section class='discussion'><article><p>A reader's long comment on it.</p></article></section>", "Story."),
        ("<article><p>A story of some words.</p><article><p>A reader's comment</p></article></article>", "A story of some words."),
        ("<section class='discussion'><article><p>The only story.</p></article></section>", "The only story."),
        ("<article><p>a <span hidden>b</span><a href=x>c</a> d</p></article>", "a c d"),
        ("<article><p>one</p><div class=ad>buy</div><p>two</p>" + "<p>x</p>" * 3, "one two x x x"),
    ],
)
def test_page_structure(html, want):
    marked, rest, _ = extract.blocks(html)
    assert " ".join(marked or rest) == want


def suffix_array_cover(streams, run, pages):
    """Which words lie in substrings of ``run`` words or more that stand on ``pages`` streams: a plain
    sorted suffix array over all streams, with longest common prefixes of neighbours."""
    suffixes = sorted((s[i:], n, i) for n, s in enumerate(streams) for i in range(len(s)))
    covered = [set() for _ in streams]
    lcp = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    group = []
    for k, one in enumerate([*suffixes, ([], -1, 0)]):
        if group and lcp(group[-1][0], one[0]) < run:
            if len({n for _, n, _ in group}) >= pages:
                for _, n, i in group:
                    covered[n].update(range(i, i + run))
            group = []
        group.append(one)
    return covered


def test_repeats_against_a_suffix_array(spark):
    rng = np.random.default_rng(8)
    parts = [[f"p{k}_{j}" for j in range(int(rng.integers(7, 22)))] for k in range(6)]
    pages = []
    for n in range(14):
        words = []
        for _ in range(int(rng.integers(1, 6))):
            words += parts[rng.integers(0, 6)] if rng.random() < 0.6 else [f"u{rng.integers(0, 30)}" for _ in range(int(rng.integers(1, 6)))]
        pages.append(words)
    pages = [list(x) for x in dict.fromkeys(map(tuple, pages))]
    rows = [(n, "http://one.net/", "<p>" + " ".join(w) + "</p>") for n, w in enumerate(pages)]
    got = {r["page_id"]: r["text"] for r in extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    covered = suffix_array_cover(pages, extract.RUN, extract.PAGES)
    # a text shorter than a window is one window of its own
    short = collections.Counter(tuple(w) for w in pages if len(w) < extract.RUN)
    assert not [s for s, n in short.items() if n >= extract.PAGES]
    assert got == {n: " ".join(x for i, x in enumerate(w) if i not in covered[n]) for n, w in enumerate(pages)}
    assert any(covered) and any(got.values())


def test_pages_of_one_set_of_words(spark):
    """Three pages whose own words are the same in another order are three pages: their common footer goes."""
    foot = "all rights of this page are reserved by the house that made it"
    rng = np.random.default_rng(0)
    own = [" ".join(rng.permutation([f"w{j}" for j in range(20)])) for _ in range(3)]
    rows = [(f"p{i}", "https://o.net/", f"<p>{own[i]}</p><p>{foot}</p>") for i in range(3)]
    got = {r["page_id"]: r["text"] for r in extract.main_text(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()}
    assert got == {f"p{i}": own[i] for i in range(3)}
    few = extract.main_text(spark.createDataFrame([(1, None, "<p>one</p>"), (1, None, "<p>two</p>")], "page_id int, url string, html string"))
    assert sorted(map(tuple, few.collect())) == [(1, None, "one", 3), (1, None, "two", 3)] and dict(few.dtypes)["page_id"] == "int"


def test_host_repeats_leave_unique_runs(spark):
    menu = "welcome to the portal of all things that you may ever want to read today and tomorrow"
    own = [" ".join(f"u{i}_{j}" for j in range(30)) for i in range(5)]
    rows = [(i, "https://p.net/x", f"<div>{menu}</div><p>{own[i]}</p><div>{menu} again{i}</div>") for i in range(5)]
    rows += [(10 + i, "https://q.net/", f"<p>{own[0]} same page</p>") for i in range(4)]  # copies of one page
    rows.append((20, "https://r.net/", f"<p>{menu}</p>"))
    got = {r["page_id"]: r["text"] for r in extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(5)] == [f"{o} again{i}" for i, o in enumerate(own)]
    assert all(got[10 + i] == f"{own[0]} same page" for i in range(4)) and got[20] == menu


def test_pages_table(spark, sf):
    for r in queries.op10_extract(spark, sf).collect():
        assert r["n_chars"] == len(r["text"]) > 0 and "<" not in r["text"] and "track(" not in r["text"] and "©" not in r["text"]


def test_pipeline_against_plain_python(spark, sf):
    pipeline = pytest.importorskip("corpus_pipeline")
    from tokenizers import Tokenizer

    from corpusloom.llm.encode import tokenizer_path

    base = table(spark, sf, "documents")
    extra = spark.createDataFrame([(10_001, None, "en", "x", 0), (10_002, "123 456", "en", "x", 7)], base.schema)
    docs_all = base.unionByName(extra)
    rows = {r["doc_id"]: r["text"] for r in docs_all.collect()}
    one = docs_all
    steps = {}
    for name, f in pipeline.STAGES:
        one = f(spark, one, sf).cache()
        steps[name] = one
        if name != "pack":
            assert one.columns == base.columns
    ids = lambda s: {r["doc_id"] for r in steps[s].select("doc_id").collect()}
    assert ids("language") == {i for i, t in rows.items() if any(c.isalpha() for c in t or "")}
    marks = {r["doc_id"]: r["quality"] for r in table(spark, sf, "labels").collect()}
    wrong = [i for i in ids("language") & set(marks) if (i in ids("quality")) != (marks[i] == 1)]
    assert len(wrong) <= 0.06 * len(marks)
    groups = brute([(i, rows[i]) for i in ids("quality")])
    assert ids("near_dedup") == {i for i, (_, c) in groups.items() if i == c}
    tests = [shingles(r["text"]) for r in table(spark, sf, "benchmark").collect()]
    leaks = {i for i in ids("near_dedup") for b in tests if b and 100 * len(shingles(rows[i]) & b) >= 75 * len(b)}
    assert leaks and ids("decontaminate") == ids("near_dedup") - leaks
    t = Tokenizer.from_file(tokenizer_path())
    check_packing([(i, rows[i]) for i in ids("decontaminate")], steps["pack"].collect(), lambda x: t.encode(x or "", add_special_tokens=False).ids)
    assert pipeline.run(spark, sf).count() > 0


def test_pipeline_cases(spark, sf):
    pipeline = pytest.importorskip("corpus_pipeline")
    for start in (docs(spark), empty(spark)):
        one, seen = start, {}
        for name, f in pipeline.STAGES:
            one = f(spark, one, sf).cache()
            seen[name] = one.collect()
            if name != "pack":
                assert one.columns == start.columns
        if start.count():
            ids = lambda s: sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in seen[s])
            assert ids("language") == [(False, 0), (True, 1), (True, 5), (True, 6), (True, 6), (True, 7), (True, 7), (True, 8)]
            assert ids("near_dedup") == [(False, 0), (True, 1), (True, 5), (True, 6), (True, 7), (True, 8)]
        else:
            assert not any(seen.values())
