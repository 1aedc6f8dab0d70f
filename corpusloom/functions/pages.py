"""Fields of article, author and staff pages from their HTML.

One tolerant pass of the standard library's parser builds a light tree of a page; fields are
read from it.  Pages go through ``mapInArrow``-style batches, one page at a time in memory.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from datetime import datetime
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as T

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_SKIP = frozenset("script style nav footer header".split())
# fixed values: keywords that are no tags
NO_TAGS = ("Nachrichten", "News", "Article")
# fixed values: words by which a heading of a staff page is a department's; ``{house}`` is the house's own name
SECTION_WORDS = [
    "International",
    "Meinung",
    "Debatte",
    "Schweiz",
    "Zürich",
    "Wirtschaft",
    "Wissenschaft",
    "Technologie",
    "Mobilität",
    "Feuilleton",
    "Sport",
    "Wochenende",
    "Gesellschaft",
    "Reisen",
    "Reporter",
    "Nachrichten",
    "Video",
    "Social Media",
    "Format",
    "Community",
    "Podcast",
    "Audience Management",
    "Visuals",
    "Editorial Tech",
    "Produktionsredaktion",
    "Art Director",
    "Bildredaktion",
    "Fotografen",
    "Redaktion Deutschland",
    "Korrespondenten",
    "{house} am Sonntag",
    "{house} Folio",
    "{house} Geschichte",
]
# fixed values: headings of a staff page that are no departments
NO_SECTIONS = ["Chefredaktor", "Stellvertreter", "Tagesleitung", "Optimieren Sie Ihre Browsereinstellungen"]


def is_section(heading: str, house: str = "") -> bool:
    """Whether a heading names a department: it holds one of the words as it is written, mail addresses apart."""
    bare = re.sub(r"@.*", "", re.sub(r"\[email.*?\]", "", heading).strip()).strip()
    return bare not in NO_SECTIONS and any(w.format(house=house) in bare for w in SECTION_WORDS if house or "{house}" not in w)


@dataclass
class Node:
    name: str
    attrs: dict[str, str]
    parent: "Node | None" = None
    children: list = field(default_factory=list)

    def walk(self):
        yield self
        for c in self.children:
            if isinstance(c, Node):
                yield from c.walk()

    def find(self, *names: str, **attrs: str):
        for n in self.walk():
            if n.name in names and all(n.attrs.get(k.replace("_", "-")) == v for k, v in attrs.items()):
                yield n

    def texts(self, skip=frozenset()):
        for c in self.children:
            if isinstance(c, str):
                if c.strip():
                    yield c.strip()
            elif c.name not in skip:
                yield from c.texts(skip)

    def text(self, skip=frozenset(), joint: str = " ") -> str:
        return joint.join(self.texts(skip))

    def under(self, test) -> bool:
        n = self.parent
        while n is not None:
            if test(n):
                return True
            n = n.parent
        return False


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {})
        self.depth = 0

    def handle_starttag(self, tag, attrs):
        n = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(n)
        if tag not in _VOID and self.depth < 400:
            self.at, self.depth = n, self.depth + 1

    def handle_endtag(self, tag):
        n, k = self.at, 0
        while n.parent is not None and n.name != tag:
            n, k = n.parent, k + 1
        if n.parent is not None:
            self.at, self.depth = n.parent, self.depth - k - 1

    def handle_data(self, data):
        self.at.children.append(data)


def tree(html: str | None) -> Node:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


def _meta(root: Node, **attrs: str) -> str | None:
    for n in root.find("meta", **attrs):
        if n.attrs.get("content", "").strip():
            return n.attrs["content"].strip()
    return None


def _first(*values):
    return next((v for v in values if v), None)


def _json_ld(root: Node) -> dict:
    for n in root.find("script", type="application/ld+json"):
        try:
            d = json.loads(n.text(joint=""))
        except ValueError:
            continue
        if isinstance(d, dict) and d.get("@type") == "ProfilePage" and isinstance(d.get("mainEntity"), dict):
            return d["mainEntity"]
    return {}


FIELDS = "title string, content string, tags array<string>, published string, updated string, byline string, description string, source string, author_links array<string>"


def fields(html: str | None, no_tags: tuple[str, ...] = NO_TAGS, min_content: int = 100) -> dict:
    """An article page's fields; lists may be empty, other fields null."""
    root = tree(html)
    h1 = next((t for n in root.find("h1") if (t := n.text())), None)
    body = None
    for n in root.walk():
        if re.search(r"article-content|article-body|content", n.attrs.get("class", "")) or n.name == "article":
            t = n.text(_SKIP, "\n")
            if len(t) > min_content:
                body = t
                break
    tags = [t.strip() for t in (_meta(root, name="news_keywords") or "").split(",")]
    when = next((n.attrs["datetime"] for n in root.find("time") if n.attrs.get("datetime")), None)
    src = next((t.removeprefix("Quelle:").strip()[:200] for n in root.find("span") if "metadata__source" in n.attrs.get("class", "") and (t := n.text())), None)
    return {
        "title": re.sub(r"\s+", " ", _first(h1, _meta(root, property="og:title"), _meta(root, name="title"), "Untitled")).strip(),
        "content": body if body is not None else root.text(_SKIP | {"head"}, "\n"),
        "tags": [t for t in tags if t and t not in no_tags],
        "published": _first(when, _meta(root, name="date")),
        "updated": _meta(root, name="last-modified"),
        "byline": _meta(root, name="author"),
        "description": _first(_meta(root, name="description"), _meta(root, property="og:description")),
        "source": src,
        "author_links": [n.attrs["href"] for n in root.find("a") if re.search(r"/impressum/.*-ld\.\d+", n.attrs.get("href", ""))],
    }


def extract_fields(pages: DataFrame, html: str, url: str, no_tags: tuple[str, ...] = NO_TAGS) -> DataFrame:
    """``pages`` with a page's fields, its category and typed dates; the html is dropped."""

    @F.pandas_udf(f"struct<{re.sub(r'(\w+) (string|array<string>)', r'\1:\2', FIELDS)}>")
    def parse(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([fields(x, no_tags) for x in s], columns=[f.split()[0] for f in FIELDS.split(", ")])

    p = pages.withColumn("_f", parse(html)).drop(html)
    p = p.select("*", "_f.*").drop("_f")
    return p.withColumns({"category": T.category_from_url(url), "article_id": T.id_from_url(url), "article_date": F.try_to_timestamp("published"), "article_updated": F.try_to_timestamp("updated")})


def related_links(pages: DataFrame, html: str, page: str, base: str) -> DataFrame:
    """``page, pos, id, url, title`` of the links to related articles, in page order, before de-duplication."""

    @F.pandas_udf("array<struct<url:string,title:string>>")
    def parse(s: pd.Series) -> pd.Series:
        def one(x):
            marks = lambda n: "data-team-more-to-subject" in n.attrs or "max-w-[640px]" in n.attrs.get("class", "")
            return [{"url": n.attrs["href"], "title": n.text()} for n in tree(x).find("a") if n.attrs.get("href") and n.under(lambda p: p.name == "article") and n.under(marks)]

        return s.map(one)

    p = pages.select(F.col(page).alias("page"), F.posexplode(parse(html)).alias("pos", "l"))
    p = p.select("page", "pos", T.absolute_url("l.url", base).alias("url"), F.col("l.title").alias("title"))
    return p.withColumn("id", T.id_from_url("url")).where(F.col("id") != F.col("page").cast("string"))


def _teasers(html: str | None) -> list[dict]:
    out = []
    for n in tree(html).find("article"):
        link = next((x for x in n.find("a") if x.attrs.get("href")), None)
        if link is None:
            continue
        marked = next((x.text(joint="") for x in n.find("span") if "chartbeat-teaser-title" in x.attrs.get("class", "")), "")
        heading = next((x.text(joint="") for x in n.find("h1", "h2", "h3")), "")
        when = next((x.attrs["datetime"] for x in n.find("time") if "datetime" in x.attrs), None)
        out.append({"url": link.attrs["href"], "title": _first(marked, heading, link.text(joint="")), "date": when})
    return out


def listing_links(pages: DataFrame, html: str, page: str, base: str) -> DataFrame:
    """``page, pos, id, url, title, date`` of a listing page's teasers: the first of each url, then of each id."""

    @F.pandas_udf("array<struct<url:string,title:string,date:string>>")
    def parse(s: pd.Series) -> pd.Series:
        return s.map(_teasers)

    p = pages.select(F.col(page).alias("page"), F.posexplode(parse(html)).alias("pos", "l"))
    p = p.select("page", "pos", T.absolute_url("l.url", base).alias("url"), F.col("l.title").alias("title"), F.try_to_timestamp("l.date").alias("date"))
    p = p.withColumn("id", T.id_from_url("url"))
    first = lambda df, key: df.withColumn("_k", F.row_number().over(Window.partitionBy("page", key).orderBy("pos"))).where("_k = 1").drop("_k")
    return first(first(p, "url").where("id is not null"), "id").where("title <> ''").select("page", "pos", "id", "url", "title", "date")


# fixed values: parts of a path by which a link of the second house's index leads to an article, and by which it does not
NEWS_PATHS = ["/news/", "/gesellschaft/", "/politik/", "/wirtschaft/", "/kultur/", "/wissen/", "/sport/", "/digital/", "/gesundheit/", "/familie/", "/campus/", "/feuilleton/", "/mobilität/", "/sinn/", "/hamburg/", "/leben/", "/arbeit/", "/schweiz/", "/österreich/", "/magazin/"]
OTHER_PATHS = ["/index", "/suche", "/impressum", "/datenschutz", "/agb", "/shop", "/abo", "/newsletter", "/login", "/anmelden", "/account", "/kommentare", "/archiv", "/podcast", "/video", "/spiele", "/studiengänge", "/jobs"]


def index_links(pages: DataFrame, html: str, page: str, base: str, site: str) -> DataFrame:
    """``page, pos, url, title`` of the links of an index page that lead to articles of ``site``.

    A title of under ten characters gives way to a heading near the link; ten or fewer are dropped, 200 kept.
    """

    @F.pandas_udf("array<struct<url:string,title:string>>")
    def parse(s: pd.Series) -> pd.Series:
        def one(x):
            out = []
            for n in tree(x).find("a"):
                href = n.attrs.get("href", "")
                if not href or href.startswith(("#", "javascript:")):
                    continue
                title = n.text(joint="")
                if len(title) < 10 and n.parent is not None:
                    title = max(title, n.parent.text(joint=""), key=len)
                box = n.parent
                while len(title) < 10 and box is not None:
                    if box.name in ("article", "div", "li", "section"):
                        title = next((h.text(joint="") for h in box.find("h1", "h2", "h3", "h4")), title)
                        break
                    box = box.parent
                out.append({"url": href, "title": title})
            return out

        return s.map(one)

    p = pages.select(F.col(page).alias("page"), F.posexplode(parse(html)).alias("pos", "l"))
    p = p.select("page", "pos", T.absolute_url("l.url", base).alias("url"), F.substring("l.title", 1, 200).alias("title"), F.length("l.title").alias("n"))
    low = F.lower("url")
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
    path = F.btrim(F.regexp_replace("url", r"^https?://(?:www\.)?" + re.escape(site), ""), F.lit("/"))
    p = p.where(F.contains(low, F.lit(site)) & has(NEWS_PATHS) & ~has(OTHER_PATHS) & (F.length(path) > 3) & (F.col("n") > 10))
    return p.withColumn("_k", F.row_number().over(Window.partitionBy("page", "url").orderBy("pos"))).where("_k = 1").select("page", "pos", "url", "title")


_MONTHS = {m: k + 1 for k, names in enumerate("januar january,februar february,märz march,april,mai may,juni june,juli july,august,september,oktober october,november,dezember december".split(",")) for m in names.split()}


def read_date(text: str | None) -> str | None:
    """A timestamp from an ISO text or a date as people write it, as ISO text; null for anything else."""
    t = (text or "").strip()
    try:
        return datetime.fromisoformat(t.replace("Z", "+00:00")).isoformat()
    except ValueError:
        pass
    clock = re.search(r"\b(\d{1,2})[:.](\d{2})(?::(\d{2}))?\s*(?:Uhr)?\s*$", t)
    m = re.search(r"\b(\d{1,2})\.\s*(\d{1,2})\.\s*(\d{4})\b", t)
    day, month, year = m.groups() if m else (None, None, None)
    if not m and (m := re.search(r"\b(\d{1,2})\.?\s+([A-Za-zä]+)\s+(\d{4})\b", t)):
        day, month, year = m[1], _MONTHS.get(m[2].lower()), m[3]
    if not m and (m := re.search(r"\b([A-Za-z]+)\s+(\d{1,2}),\s*(\d{4})\b", t)):
        day, month, year = m[2], _MONTHS.get(m[1].lower()), m[3]
    try:
        h = [int(x or 0) for x in clock.groups()] if clock and clock.start() >= m.end() else [0, 0, 0]
        return datetime(int(year), int(month), int(day), *h).isoformat()
    except (TypeError, ValueError, AttributeError):
        return None


def _of_class(root: Node, name: str, cls: str | None):
    """The first element of a name and, unless null, of a class."""
    return next((n for n in root.find(name) if cls is None or cls in n.attrs.get("class", "").split()), None)


def _meta_of(root: Node, **attrs: str) -> str | None:
    return next((n.attrs.get("content") for n in root.find("meta", **attrs)), None)


def _chain_date(root: Node, steps: list[tuple], with_text: bool) -> str | None:
    for name, key, value in steps:
        if name == "meta":
            found = read_iso(_meta_of(root, **{key: value}))
        else:
            n = next((x for x in root.find(name) if "datetime" in x.attrs), None) if key == "datetime" else _of_class(root, name, value)
            found = None
            if n is not None:
                found = read_iso(n.attrs.get("datetime")) or (read_date(n.text(joint="")) if with_text else None)
        if found:
            return found
    return None


def read_iso(text: str | None) -> str | None:
    try:
        return datetime.fromisoformat((text or "").replace("Z", "+00:00")).isoformat()
    except ValueError:
        return None


# fixed values: where the second house's pages have their fields, in this order
TITLE_CHAIN = [("h1", "title"), ("h1", "article-title"), ("h1", "post-title"), ("title", None), ("h1", None)]
CONTENT_CHAIN = [("div", "content"), ("div", "article-content"), ("div", "post-content"), ("article", "content"), ("main", None), ("article", None)]
PUBLISHED_CHAIN = [("time", "class", "metadata__date"), ("time", "datetime", None), ("time", "class", None), ("span", "class", "date"), ("div", "class", "date"), ("meta", "property", "article:published_time"), ("meta", "name", "article:published_time"), ("meta", "property", "og:published_time")]
UPDATED_CHAIN = [("meta", "property", "article:modified_time"), ("meta", "name", "article:modified_time"), ("meta", "property", "og:updated_time"), ("time", "class", "updated"), ("time", "class", "modified"), ("time", "class", "metadata__date")]
SOURCE_CHAIN = [("span", "metadata__source"), ("span", "metadata-source"), ("div", "source"), ("div", "quelle"), ("span", "quelle"), ("div", "byline"), ("span", "byline")]
AGENCIES = ["dpa", "AP", "Reuters", "AFP"]
PAYWALL_WORDS = ["subscribe", "paywall", "premium", "members only", "sign in"]


def _source(root: Node, houses: tuple[str, ...]) -> str | None:
    n = _of_class(root, "span", "metadata__source")
    if n is not None and (t := n.text(joint="").replace("Quelle:", "").replace("quelle:", "").strip()):
        return t[:200]
    for name, cls in SOURCE_CHAIN:
        n = _of_class(root, name, cls)
        t = n.text(joint="") if n is not None else ""
        if len(t) > 2:
            for word in ("Von", "von", "Quelle:", "quelle:"):
                t = t.replace(word, "").strip()
            if t:
                return t[:200]
    for value in (_meta_of(root, name="author"), _meta_of(root, property="article:author")):
        if (value or "").strip():
            return value.strip()
    head = root.text()[:2000]
    for pattern in (r"(?:Von|von|Quelle|quelle|Source|source)[:\s]+([A-Z][^\.\n]{2,50})", "(" + "|".join(map(re.escape, [AGENCIES[0], *houses, *AGENCIES[1:]])) + ")"):
        m = re.search(pattern, head)
        if m and len(m[1].strip()) > 2:
            return m[1].strip()[:200]
    return None


METADATA = "title string, content string, published string, updated string, source string, paywalled boolean"


def metadata(html: str | None, houses: tuple[str, ...] = ()) -> dict:
    """The second house's fields of a page, by its own chains; ``houses``: names that count as sources and end titles."""
    root = tree(html)
    n = next((x for x in (_of_class(root, *step) for step in TITLE_CHAIN) if x is not None), None)
    title = n.text(joint="") if n is not None else "Untitled"
    for h in houses:
        title = re.sub(rf"\s*\|\s*{re.escape(h)}\s*$", "", title, flags=re.I).strip()
    body = next((x for x in (_of_class(root, *step) for step in CONTENT_CHAIN) if x is not None), None)
    content = body.text(_SKIP, "\n") if body is not None else root.text(joint="\n")
    return {
        "title": title,
        "content": content,
        "published": _chain_date(root, PUBLISHED_CHAIN, True),
        "updated": _chain_date(root, UPDATED_CHAIN, False),
        "source": _source(root, houses),
        "paywalled": len(content.strip()) < 50 and any(w in root.text().lower() for w in PAYWALL_WORDS),
    }


def extract_metadata(pages: DataFrame, html: str, houses: tuple[str, ...] = ()) -> DataFrame:
    """``pages`` with the second house's fields; pages behind a paywall are dropped, and the html."""

    @F.pandas_udf(f"struct<{METADATA.replace(' string', ':string').replace(' boolean', ':boolean')}>")
    def parse(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([metadata(x, houses) for x in s], columns=[f.split()[0] for f in METADATA.split(", ")])

    return pages.withColumn("_f", parse(html)).drop(html).select("*", "_f.*").where("not paywalled").drop("_f", "paywalled")


PROFILE = "name string, title string, alt_name string, bio string"


def profile(html: str | None) -> dict:
    """An author page: the heading without parentheses, what stands in them, title and text."""
    root, ld = tree(html), {}
    ld = _json_ld(root)
    h1 = next((t for n in root.find("h1") if (t := n.text())), "")
    paras = [t for n in root.find("p") if (t := n.text())]
    alt = re.search(r"\(([^)]*)\)", h1)
    return {
        "name": _first(re.sub(r"\s*\([^)]*\)", "", h1).strip(), ld.get("name")),
        "title": _first(next((n.text() for n in root.find("h2") if n.text()), None), ld.get("jobTitle")),
        "alt_name": _first(alt[1].strip() if alt else None, ld.get("alternateName")),
        "bio": _first(" ".join(paras), ld.get("description")),
    }


def extract_profiles(pages: DataFrame, html: str) -> DataFrame:
    @F.pandas_udf(f"struct<{PROFILE.replace(' string', ':string')}>")
    def parse(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([profile(x) for x in s], columns=["name", "title", "alt_name", "bio"])

    return pages.withColumn("_f", parse(html)).drop(html).select("*", "_f.*").drop("_f")


def staff_lines(html: str | None, house: str = "") -> list[dict]:
    """Headings and people of a staff page in page order: ``pos, section, name, role, link``.

    A line of up to four words that ends with a colon, or a heading with a section's word, opens
    a section; any other line is split once at the first dash or comma and is a person if two
    words stand before it.
    """
    out = []
    for pos, n in enumerate(tree(html).walk()):
        if n.name not in ("h2", "h3", "strong", "b", "p", "li"):
            continue
        t = re.sub(r"\s+", " ", n.text()).strip()
        head = n.name in ("h2", "h3") and is_section(t, house)
        if t.endswith(":") and len(t.split()) <= 4 or head:
            out.append({"pos": pos, "section": t.rstrip(":").strip(), "name": None, "role": None, "link": None})
            continue
        sign = next((s for s in ("–", "-", ",") if s in t), None)
        name, role = (x.strip() for x in t.split(sign, 1)) if sign else (re.sub(r"\s*\([^)]*\)", "", t), "")
        if len(name.split()) >= 2 and n.name not in ("h2", "h3"):
            link = next((a.attrs.get("href") for a in n.find("a")), None)
            out.append({"pos": pos, "section": None, "name": name, "role": role, "link": link})
    return out


def staff(pages: DataFrame, html: str, page: str, house: str = "") -> DataFrame:
    """``page, name, role, department, link``: each name with its section; the last line of a name wins."""

    @F.pandas_udf("array<struct<pos:int,section:string,name:string,role:string,link:string>>")
    def parse(s: pd.Series) -> pd.Series:
        return s.map(lambda x: staff_lines(x, house))

    p = pages.select(F.col(page).alias("page"), F.explode(parse(html)).alias("x")).select("page", "x.*")
    p = p.withColumn("department", F.last("section", ignorenulls=True).over(Window.partitionBy("page").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))).where("name is not null")
    role = F.when(F.col("department").isNull(), F.col("role")).when(F.coalesce("role", F.lit("")) == "", F.col("department")).otherwise(F.concat("role", F.lit(" ("), "department", F.lit(")")))
    best = F.max_by(F.struct(role.alias("role"), "department", "link"), "pos")
    return p.groupBy("page", "name").agg(best.alias("b")).select("page", "name", "b.role", "b.department", "b.link")


def byline_people(pages: DataFrame, html: str, page: str) -> DataFrame:
    """``page, pos, name, link``: linked authors, then unlinked ones, then the meta author.

    Names are compared in lower case up to the first comma; the first one stays.
    """

    @F.pandas_udf("array<struct<name:string,link:string>>")
    def parse(s: pd.Series) -> pd.Series:
        def one(x):
            root = tree(x)
            linked = [{"name": n.text(), "link": n.attrs["href"]} for n in root.find("a") if re.search(r"/impressum/.*-ld\.\d+|/autor", n.attrs.get("href", ""))]
            plain = [{"name": n.text(), "link": None} for n in root.find("span") if re.search(r"\b(?:author|byline)\b", n.attrs.get("class", "")) and not list(n.find("a"))]
            meta = [{"name": _meta(root, name="author"), "link": None}]
            return linked + plain + meta

        return s.map(one)

    p = pages.select(F.col(page).alias("page"), F.posexplode(parse(html)).alias("pos", "x")).select("page", "pos", "x.name", "x.link")
    p = p.withColumn("base", F.lower(T.base_name("name"))).where("base is not null and length(base) > 1 and base not in ('von', 'redaktion', 'agenturen', 'text')")
    return p.groupBy("page", "base").agg(F.min_by(F.struct("pos", "name", "link"), "pos").alias("b")).select("page", "b.*")
