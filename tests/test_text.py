"""Scalar functions, bylines, pages and stages on small hand-made cases."""

import difflib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import byline, fuzzy, pages
from corpusloom.functions import text as T
from corpusloom.operators import resolve, stages

PEOPLE = [
    ("Andreas Muster", ["Andreas Muster|None|None"]),
    ("Andreas Müller, Berlin", ["Andreas Müller|Berlin|None"]),
    ("Anna Muster, Berlin und Paris", ["Anna Muster|Berlin|None"]),
    ("Anna Muster und Ben Beispiel", ["Anna Muster|None|None", "Ben Beispiel|None|None"]),
    ("Anna Muster, Ben Beispiel, Cem Demo", ["Anna Muster|None|None", "Ben Beispiel|None|None", "Cem Demo|None|None"]),
    ("Mumbai, Ulrich, von, Schwerin", ["Ulrich von Schwerin|None|None"]),
    ("International, Gordana, Muster", ["Gordana Muster|None|International"]),
    ("Kultur Peer Muster", ["Peer Muster|None|Kultur"]),
    ("Von Tom Beispiel", ["Tom Beispiel|None|None"]),
    ("Michael von Muster", ["Michael von Muster|None|None"]),
    ("Anna C. Muster", ["Anna C. Muster|None|None"]),
    ("Patrizia Muster Claudio Beispiel Jürg Demo", ["Patrizia Muster|None|None", "Claudio Beispiel|None|None", "Jürg Demo|None|None"]),
    ("Feuilletonredaktion", ["Feuilletonredaktion|None|Feuilletonredaktion"]),
    ("Rio de Janeiro", []),
    ("New York", []),
    ("", []),
    (None, []),
]


@pytest.mark.parametrize("line,want", PEOPLE)
def test_bylines(line, want):
    assert [f"{p.name}|{p.location}|{p.department}" for p in byline.Parser().parse(line)] == want


def test_bylines_with_a_gazetteer():
    p = byline.Parser(frozenset({"singapur", "bangkok"}), house="Kurier")
    assert p.parse("Singapur") == []
    assert [(x.name, x.location) for x in p.parse("Bangkok, Andreas, Muster")] == [("Andreas Muster", "Bangkok")]
    assert [x.department for x in p.parse("Kurier-Visuals")] == ["Kurier-Visuals"]


def test_name_parts():
    one = byline.Parser().parse("Hans Peter van der Muster")[0]
    assert (one.first_name, one.middle_name, one.last_name) == ("Hans", "Peter", "van der Muster")


def values(spark, rows, expr, kind="string"):
    d = spark.createDataFrame([(n, r) for n, r in enumerate(rows)], f"n int, x {kind}")
    return [r[0] for r in d.orderBy("n").select(expr).collect()]


def test_lists(spark):
    assert values(spark, ['["a", " b ", ""]', "['x']", "", "plain", None, "[null]"], T.parse_author_list("x")) == [["a", "b"], ["x"], [""], ["plain"], [], []]
    assert values(spark, ['["a"]', "", None, "no", "[1, 2]"], T.parse_related_list("x")) == [["a"], [], [], [], ["1", "2"]]
    assert values(spark, ['[{"id":"1","url":"u"},{"id":null}]', '["7"]', "[]", None, "x"], T.related_ids("x")) == [["1"], ["7"], None, None, None]
    assert values(spark, ['["a"]', "a, b,", "c", " ", None], T.parse_list("x")) == [["a"], ["a", "b"], ["c"], [], []]
    assert values(spark, [["A", "b", "a", "B"], []], T.ci_distinct(F.col("x")), "array<string>") == [["A", "b"], []]


def test_unicode_white_space_and_words(spark):
    assert values(spark, ["  Ä  B ! ", None], T.norm_match("x")) == ["ä b", None]
    assert values(spark, [" x "], T.strip("x")) == ["x"]


def test_departments_and_labels(spark):
    assert values(spark, ["Kurier-Sport", "Kurier Sport", "Sport Kurier", "Kurier", " ", "Kurieren"], T.clean_department("x", "Kurier")) == ["Sport", "Sport", "Sport", None, None, "Kurieren"]
    assert values(spark, ["Text: Anna", "text", "Text Bilder", "INTERVIEW:", "Anna"], T.clean_label("x")) == ["Anna", None, None, None, "Anna"]
    assert values(spark, ["Visuals illustrationen: Anna", "Sport", "Text:"], T.author_in_department("x")) == ["Anna", None, None]


def test_entities_and_escapes(spark):
    assert values(spark, ["a &amp b", "&#252;ber&nbsp;x", "a  b", None], T.clean_entities("x")) == ["a & b", "über x", "a  b", None]
    assert values(spark, ["M\\u00fcller", "x"], T.clean_text("x")) == ["Müller", "x"]


def test_links(spark):
    assert values(spark, ["http://x/y", "/a", "b"], T.absolute_url("x", "https://h.org")) == ["http://x/y", "https://h.org/a", "https://h.org/b"]
    assert values(spark, ["https://h/a/t-ld.123?x", "https://h/a/b.html", "https://h/a/b.htm/"], T.id_from_url("x")) == ["123", "b", "b"]
    assert values(spark, ["https://h/sport/x", "https://h/video/x", "https://h", "/kultur/x"], T.category_from_url("x")) == ["sport", None, None, "kultur"]


def test_fuzzy(spark):
    names = spark.createDataFrame([("Anna Muster",), ("Ana Muster",), ("Zed",)], "name string")
    d = spark.createDataFrame([("Anna Muster", "Sport"), ("Anna Muster", "Kultur"), ("Ben Beispiel", "Inland")], "name string, role string")
    assert {r["name"]: r["role"] for r in fuzzy.best_match(names, d).collect()} == {"Anna Muster": "Kultur, Sport", "Ana Muster": "Kultur, Sport", "Zed": "Unknown"}


ART = "article_id long, authors array<string>, department array<string>, location array<string>"


def art(spark, *rows):
    return spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], ART)


def lists(df):
    return [tuple(r) for r in df.orderBy("article_id").select(*stages.LISTS).collect()]


ROWS = [
    (["Text: Anna", "Kurier-Visuals", "text", "Anna"], ["Kurier-Sport", "SPORT", "genf", "Text: Ben", "A, B"], ["Bern,", "FR", "Video", "bildredaktion", "Cem D."]),
    (None, None, None),
    ([], [], []),
]


def test_stages_and_idempotence(spark):
    a = art(spark, *ROWS)
    f06 = lambda d: stages.stage06_locations(d, "Kurier", ["Cem D."])
    f09 = lambda d: stages.stage09_authors(d, "Kurier")
    f10 = lambda d: stages.stage10_departments(d, "Kurier")
    assert lists(f06(a))[0][2] == ["Bern", "France"] and lists(f06(a))[0][0][-1] == "Cem D." and lists(f06(a))[0][1][-1] == "Bildredaktion"
    assert lists(f09(a))[0][0] == ["Anna"] and lists(f09(a))[0][1][-1] == "Kurier-Visuals"
    assert lists(f10(a))[0][1] == ["Sport", "A", "B"] and lists(f10(a))[0][0][-2:] == ["Genf", "Ben"]
    for f in (f06, f09, f10, stages.stage11_unicode):
        once = f(a)
        assert lists(f(once)) == lists(once) and lists(once)[1] == (None, None, None)


def test_refine_parentheses(spark):
    a = art(spark, (["Anna Muster (Text), Ben Beispiel (Bern)"], None, ["Paris"]), (["Cem Demo"], None, None))
    got = lists(stages.stage05_refine(a, frozenset({"bern"})))
    assert got[0][0] == ["Anna Muster", "Ben Beispiel"] and got[0][2] == ["Paris", "Text", "Bern"] and got[1] == (["Cem Demo"], None, None)


def test_names_and_corrections(spark):
    a = art(spark, (["Anna Muster und Ben Beispiel", "Cem Demo", "bildredaktion"], ["X"], None))
    got = lists(stages.stage07_names(a))[0]
    assert got[0] == ["Anna Muster", "Ben Beispiel", "Cem Demo"] and got[1] == ["X", "bildredaktion"]
    c = spark.createDataFrame([("Cem Demo", "replace", "C. Demo, D. Demo"), ("bildredaktion", "dept", "Bild")], "author string, action string, payload string")
    got = lists(stages.stage08_corrections(a, c))[0]
    assert got[0] == ["Anna Muster und Ben Beispiel", "C. Demo", "D. Demo"] and got[1] == ["X", "Bild"]


def people(spark, rows):
    return spark.createDataFrame(rows, "id long, author_id string, name string, title string, alt_name string, alias string, department string, bio string, has_info int")


def test_match_and_merge(spark):
    p = people(spark, [(1, "7", "Anna Muster", "Dr", None, None, None, None, 1), (2, None, "anna  muster", None, None, None, None, None, 0), (3, "non-imp-4", "Ben B.", None, None, None, None, None, 0), (4, "non-imp-x", "Ben Beispiel", None, None, None, None, None, 0)])
    a = art(spark, (["ANNA MUSTER", "Zoe Neu"], None, None), (["Zoe Neu", "Yan Neu", "Ben B."], None, None))
    new = stages.stage12_match(a, p)
    assert [(r["author_id"], r["name"]) for r in new.where("id is null").orderBy("author_id").collect()] == [("non-imp-5", "Zoe Neu"), ("non-imp-6", "Yan Neu")]
    a13, p13 = stages.stage13_merge_duplicates(a, p)
    assert lists(a13)[0][0] == ["Anna Muster", "Zoe Neu"] and sorted(r["id"] for r in p13.collect()) == [1, 3, 4]
    a15, p15 = stages.stage15_merge_prefixes(a, p)
    assert lists(a15)[1][0] == ["Zoe Neu", "Yan Neu", "Ben Beispiel"] and sorted(r["id"] for r in p15.collect()) == [1, 2, 4]
    a14, _ = stages.stage14_entities(art(spark, (["A &amp; B", "c"], None, None), (None, None, None)), p)
    assert lists(a14)[0][0] == ["A & B", "c"]


def test_propagation_keeps_supersets(spark):
    items = spark.createDataFrame([(1, ["Anna"], ["x"]), (2, ["anna "], None), (3, None, ["q"])], "item long, authors array<string>, v array<string>")
    p = spark.createDataFrame([(1, "Anna", ["X", "y"]), (2, "Ben", None)], "id long, name string, v array<string>")
    i, q = resolve.propagate(items, p, "item", "authors", "v")
    assert {r["item"]: r["v"] for r in i.collect()} == {1: ["x", "y"], 2: ["X", "y"], 3: ["q"]}
    assert {r["id"]: r["v"] for r in q.collect()} == {1: ["X", "y"], 2: []}


PAGE = """<html><head><meta property="og:title" content="og"><meta name="news_keywords" content="a, News, b,,"><meta name="author" content=" Anna Muster "><meta name="description" content="d">
<meta name="last-modified" content="2025-01-02T00:00:00+01:00"></head><body><header>no</header><h1>Head <i>line</i></h1><time datetime="2025-01-01T10:00:00Z">x</time>
<div class="article-content"><p>%s</p><script>no()</script></div><a href="/impressum/anna-ld.12">A</a>
<div data-team-more-to-subject><article><a href="/x/eins-ld.1"></a></article><article><a href="/x/eins-ld.1">Eins</a></article><article><a href="/x/zwei-ld.2">Zwei</a></article></div></body></html>""" % ("word " * 40)


def test_page_fields(spark):
    f = pages.fields(PAGE)
    assert f["title"] == "Head line" and f["tags"] == ["a", "b"] and f["byline"] == "Anna Muster" and f["author_links"] == ["/impressum/anna-ld.12"] and "no()" not in f["content"]
    assert pages.fields(None)["title"] == "Untitled" and pages.fields("<p>x")["content"] == "x"
    d = spark.createDataFrame([(5, "https://h.org/sport/t-ld.5", PAGE)], "page_id long, url string, html string")
    r = pages.extract_fields(d, "html", "url").first()
    assert r["category"] == "sport" and r["article_id"] == "5" and r["article_date"].hour == 10
    links = resolve.first_links(pages.related_links(d, "html", "page_id", "https://h.org"))
    assert [r["id"] for r in links.collect()] == ["2"]  # an untitled first link hides a titled later one


def test_staff_sections(spark):
    html = "<h2>Redaktion Sport</h2><p>Anna Muster, Leitung</p><p>Inland:</p><p>Ben Beispiel – Redaktor</p><p>kurz</p><p>Anna Muster - Autorin</p>"
    d = spark.createDataFrame([(1, html)], "page long, html string")
    assert {r["name"]: r["role"] for r in pages.staff(d, "html", "page").collect()} == {"Anna Muster": "Autorin (Inland)", "Ben Beispiel": "Redaktor (Inland)"}


def test_profiles():
    p = pages.profile('<h1>Anna Muster (am.)</h1><script type="application/ld+json">{"@type":"ProfilePage","mainEntity":{"name":"X","jobTitle":"Redaktorin"}}</script><p>Bio</p>')
    assert p == {"name": "Anna Muster", "title": "Redaktorin", "alt_name": "am.", "bio": "Bio"}


def test_people_of_a_page(spark):
    html = '<meta name="author" content="Ben Beispiel, Bern"><a href="/impressum/anna-ld.1">Anna Muster</a><span class="author">anna muster, Berlin</span><span class="byline">Cem Demo</span>'
    d = spark.createDataFrame([(1, html)], "page long, html string")
    assert [r["name"] for r in pages.byline_people(d, "html", "page").orderBy("pos").collect()] == ["Anna Muster", "Cem Demo", "Ben Beispiel, Bern"]


def test_close_names_equal_a_plain_search(spark):
    import difflib
    import random

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 14)))
    known = sorted({word() for _ in range(120)} | {"Anna Muster", "aaaa", "aaab", "aabb"})
    names = []
    for _ in range(150):
        x = rng.choice(known)
        for _ in range(rng.randint(0, 3)):
            i = rng.randint(0, len(x))
            x = x[:i] + rng.choice("abcz") + x[i + rng.randint(0, 1) :]
        names.append(x)
    names += [word() for _ in range(40)]
    for cutoff in (0.6, 0.85):
        want = {}
        for x in set(names):
            near = [x] if x in known else difflib.get_close_matches(x, known, n=1, cutoff=cutoff)
            want[x] = near[0] if near else None
        d = spark.createDataFrame([(k, "r") for k in known] + [(None, "r")], "name string, role string")
        got = {r["name"]: r["match"] for r in fuzzy.best_match(spark.createDataFrame([(x,) for x in [*names, None]], "name string"), d, cutoff).collect()}
        assert got == want and sum(v is not None and k != v for k, v in want.items()) > 10


def test_contained_names_equal_all_pairs(spark):
    import random

    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abC é") for _ in range(rng.randint(0, n)))
    d = [word(7) for _ in range(40)] + [None, " "]
    n = [word(12) for _ in range(200)] + [x and "xx" + x for x in d] + [None, ""]
    low = lambda x: x.strip(" ").lower()
    keys = {low(x) for x in d if x and low(x)}
    want = sorted(x for x in n if x is not None and any(k in low(x) or low(x) in k for k in keys))
    from corpusloom.operators import resolve

    frame = lambda xs: spark.createDataFrame([(x,) for x in xs], "name string")
    assert sorted(r["name"] for r in resolve.contained_names(frame(n), frame(d)).collect()) == want and 0 < len(want) < len(n)
    assert resolve.contained_names(frame(n), frame([None, ""])).count() == 0


def test_fuzzy_compares_close_names_first(spark, monkeypatch, tmp_path):
    """Numbered names are all alike: a name with a close partner is not compared with every other one."""
    known = [f"Supplier#{i:09d}" for i in range(0, 900, 3)]
    names = [x[:3] + x[4:] for x in known] + ["Supplyer#00000999"]
    plain = fuzzy._ratios

    def counted(names: pd.Series, others: pd.Series) -> pd.Series:
        with open(tmp_path / "compared", "a") as f:
            f.write("x" * len(names))
        return plain(names, others)

    monkeypatch.setattr(fuzzy, "_ratios", counted)
    d = spark.createDataFrame([(x, "r") for x in known], "name string, role string")
    got = {r["name"]: r["match"] for r in fuzzy.best_match(spark.createDataFrame([(x,) for x in names], "name string"), d).collect()}
    assert got == {x: max((difflib.SequenceMatcher(None, y, x).ratio(), y) for y in known)[1] for x in names}
    assert (tmp_path / "compared").stat().st_size < 10 * len(names)
