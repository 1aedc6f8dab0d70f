"""Column expressions for names, places, departments, lists, links and labels.

All are built-in functions, inside code generation; the two that need Python's entity table
(:func:`clean_entities`, :func:`clean_text`) run only on rows that hold an entity or escape.
``house`` is the publisher's own short name, which prefixes many department names.
"""

from __future__ import annotations

import html
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

Name = Column | str


def _c(c: Name) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- white space, lists ---------------------------------------------------------------------


#: Unicode's white space
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Name) -> Column:
    """Without white space at the ends, in Unicode's sense."""
    return F.btrim(_c(c), F.lit(WHITE))


def blank_to_null(c: Name) -> Column:
    return F.nullif(strip(c), F.lit(""))


def non_empty(arr: Column) -> Column:
    return F.filter(F.transform(arr, strip), lambda x: x.isNotNull() & (x != ""))


def ci_distinct(arr: Column) -> Column:
    """The first of items that are equal but for case, in order."""
    return F.filter(arr, lambda x, i: ~F.exists(F.slice(arr, 1, i), lambda y: F.lower(y) == F.lower(x)))


def parse_author_list(c: Name) -> Column:
    """Null: empty; a list text: its trimmed, non-empty items; anything else: one item."""
    c = _c(c)
    listed = F.from_json(c, "array<string>")
    return F.when(c.isNull(), F.array().cast("array<string>")).when(listed.isNotNull(), non_empty(listed)).otherwise(F.array(strip(c)))


def parse_related_list(c: Name) -> Column:
    """Null, blank or no list: empty."""
    return F.coalesce(F.filter(F.from_json(_c(c), "array<string>"), lambda x: x.isNotNull()), F.array().cast("array<string>"))


def related_ids(c: Name) -> Column:
    """Ids of a list of ``{"id", "url"}`` or of plain strings; null if there is none."""
    c = _c(c)
    pairs = F.filter(F.transform(F.from_json(c, "array<struct<id:string,url:string>>"), lambda x: x["id"]), lambda x: F.coalesce(x, F.lit("")) != "")
    plain = F.filter(F.from_json(c, "array<string>"), lambda x: (F.coalesce(x, F.lit("")) != "") & ~x.startswith("{"))
    both = F.when(F.size(pairs) > 0, pairs).when(F.size(plain) > 0, plain)
    return both


def parse_list(c: Name) -> Column:
    """A list text, else split at commas, else one item."""
    c = _c(c)
    return F.when(blank_to_null(c).isNull(), F.array().cast("array<string>")).otherwise(F.coalesce(non_empty(F.from_json(c, "array<string>")), non_empty(F.split(c, ","))))


def parse_list_value(c: Name) -> Column:
    """As :func:`parse_list`, with entities and escapes decoded and quotes and brackets around items dropped."""
    items = F.transform(parse_list(clean_text(c)), lambda x: strip(F.regexp_replace(x, r"^[\s'\"\[]+|[\s'\"\]]+$", "")))
    return non_empty(items)


def merge_comma_lists(*columns: Name) -> Column:
    """Items of several comma lists, without repeats in any case, joined again; null if none."""
    items = ci_distinct(non_empty(F.concat(*(F.split(F.coalesce(_c(c), F.lit("")), ",") for c in columns))))
    return F.when(F.size(items) > 0, F.array_join(items, ", "))


def plain_json(c: Name) -> Column:
    """A list text written again with raw characters for escapes; others as they are."""
    c = _c(c)
    return F.coalesce(F.to_json(F.from_json(c, "array<string>")), c)


# --- names ----------------------------------------------------------------------------------


def norm_simple(c: Name) -> Column:
    return F.lower(strip(c))


def norm_match(c: Name) -> Column:
    """For matching: one space, lower case, only word characters, spaces and full stops."""
    one = F.regexp_replace(F.lower(F.regexp_replace(_c(c), r"(?U)\s+", " ")), r"(?U)[^\w\s.]", "")
    return strip(F.regexp_replace(one, r"(?U)\s+", " "))


# fixed values: labels that stand before names, and what is no name
LABELS = ["Text:", "Illustrationen:", "Aufgezeichnet:", "Interview:", "Mitarbeit:"]
NO_NAMES = ["text", "text bilder"]


def clean_label(c: Name) -> Column:
    """Without labels; null for what is no name or nothing else."""
    c = strip(c)
    bare = blank_to_null(F.regexp_replace(c, "(?i)" + "|".join(map(re.escape, LABELS)), ""))
    return F.when(~F.lower(c).isin(NO_NAMES), bare)


def clean_department(c: Name, house: str) -> Column:
    """Without the house's name before or after; null if nothing else is left."""
    q = re.escape(house)
    c = strip(c)
    for pattern in (rf"^{q}-\s*", rf"^{q} \s*", rf"\s* {q}$", rf"^{q}$"):
        c = strip(F.regexp_replace(c, pattern, ""))
    return F.nullif(c, F.lit(""))


def author_in_department(c: Name) -> Column:
    """What follows the first label, in the order of ``LABELS``, that a department contains."""
    found = [blank_to_null(F.regexp_extract(_c(c), f"(?is){re.escape(x)}(.*)$", 1)) for x in (LABELS[1], LABELS[0], *LABELS[2:])]
    return F.when(F.contains(_c(c), F.lit(":")), F.coalesce(*found))


def base_name(c: Name) -> Column:
    """What stands before the first comma."""
    return strip(F.element_at(F.split(_c(c), ","), 1))


def split_byline(c: Name) -> Column:
    """Names of a plain byline: no parentheses, split at commas, semicolons and *und*."""
    bare = F.regexp_replace(F.regexp_replace(_c(c), r"\([^)]*\)", ""), r"(?U)\s+", " ")
    return F.filter(F.transform(F.split(bare, r"(?i)[,;]|\s+und\s+"), strip), lambda x: F.length(x) > 1)


# fixed values: places, sections and ranks that stand first in run-together names; ``{house}`` is the house's own name
FIRST_PLACES = [
    "Bundeshaus",
    "Westschweiz",
    "Berlin",
    "Paris",
    "London",
    "Rom",
    "Madrid",
    "Wien",
    "Warschau",
    "Frankfurt",
    "Brüssel",
    "Tallinn",
    "Tel Aviv",
    "Moskau",
    "Nairobi",
    "Istanbul",
    "Beirut",
    "Mumbai",
    "Bangkok",
    "Taipeh",
    "Peking",
    "Tokio",
    "Sydney",
    "Washington",
    "Chicago",
    "Bahia",
    "Rio de Janeiro",
    "International",
    "Geopolitics",
    "Reisen",
    "Reporter",
    "Social Media",
    "Audience Management",
    "Produktionsredaktion",
    "Art Director",
    "Bildredaktion",
    "Fotografen",
    "Korrespondenten",
    "Chefredaktor",
    "Stellvertreter",
    "Tagesleitung",
    "Format",
    "Community",
    "Podcast",
    "Management",
    "Geschichte",
    "{house}",
    "Folio",
]


def split_joined_name(c: Name, house: str = "") -> Column:
    """A space where a small letter meets a capital; after a first place or rank, commas between words."""
    first = [x.format(house=house).lower() for x in FIRST_PLACES if house or "{house}" not in x]
    spaced = strip(F.regexp_replace(_c(c), "([a-zäöüß])([A-ZÄÖÜ])", "$1 $2"))
    words = F.split(spaced, r"\s+")
    return F.when((F.size(words) > 1) & F.lower(words[0]).isin(first), F.array_join(words, ", ")).otherwise(spaced)


def clean_report_author(c: Name) -> Column:
    """For reports: no line breaks, no place before a name, no noise; null if two letters or fewer."""
    one = strip(F.regexp_replace(F.regexp_replace(_c(c), r"(?i)<br\s*/?>", " "), r"(?U)\s+", " "))
    name = F.when(F.size(F.split(base_name(one), " ")) >= 2, base_name(one)).otherwise(strip(F.regexp_replace(one, r"^[^,]*,", "")))
    noise = name.rlike(r"(?i)^(?:von|text|bild(?:er)?|interview|redaktion|agenturen)$|\d|https?:")
    return F.when(~noise & (F.length(name) > 2), name)


def suspicious_byline(c: Name, departments: list[str]) -> Column:
    """Four words or more without comma or *und*, and no department."""
    c = strip(c)
    return ~c.contains(",") & ~F.lower(c).contains(" und ") & ~F.lower(c).isin([d.lower() for d in departments]) & (F.size(F.split(c, r"\s+")) >= 4)


def word_pairs(c: Name) -> Column:
    """Two words each."""
    w = F.split(strip(c), r"\s+")
    return F.transform(F.filter(w, lambda x, i: i % 2 == 0), lambda x, i: F.array_join(F.slice(w, 2 * i + 1, 2), " "))


# --- places ---------------------------------------------------------------------------------


def split_places(c: Name) -> Column:
    return non_empty(F.split(_c(c), "/"))


def outside_parentheses(c: Name) -> Column:
    return non_empty(F.split(F.regexp_replace(_c(c), r"\([^)]*\)", " "), "[,;]"))


def inside_parentheses(c: Name) -> Column:
    return non_empty(F.regexp_extract_all(_c(c), F.lit(r"\(([^)]+)\)"), 1))


# --- links ----------------------------------------------------------------------------------


def absolute_url(c: Name, base: str) -> Column:
    c, base = _c(c), base.rstrip("/")
    return F.when(c.startswith("http"), c).when(c.startswith("/"), F.concat(F.lit(base), c)).otherwise(F.concat(F.lit(base + "/"), c))


def id_from_url(c: Name) -> Column:
    """The number after ``ld.``, else the last part of the path without ``.html`` or ``.htm``."""
    last = F.element_at(F.split(F.regexp_replace(_c(c), r"/+$", ""), "/"), -1)
    return F.coalesce(F.nullif(F.regexp_extract(_c(c), r"ld\.(\d+)", 1), F.lit("")), F.regexp_replace(F.regexp_replace(last, r"\.html$", ""), r"\.htm$", ""))


# fixed values: first path parts that are no category
NO_CATEGORY = ["neueste-artikel", "visuals", "video", "podcast"]


def category_from_url(c: Name) -> Column:
    part = F.nullif(F.regexp_extract(_c(c), r"^(?:https?://[^/]+)?/([^/?#]+)", 1), F.lit(""))
    return F.when(~part.isin(NO_CATEGORY), part)


# --- other ----------------------------------------------------------------------------------


def strip_nul(c: Name) -> Column:
    return F.replace(_c(c), F.lit("\0"), F.lit(""))


def truncate(c: Name, n: int) -> Column:
    return F.when(F.length(_c(c)) > n, F.concat(F.substring(_c(c), 1, n - 3), F.lit("..."))).otherwise(_c(c))


def placeholder_id(c: Name) -> Column:
    return F.concat(F.lit("no-id-"), F.substring(F.md5(_c(c)), 1, 8))


def keyword_match(term: str, *columns: Name) -> Column:
    """Whether any column holds the term, in any case."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.contains(F.lower(F.coalesce(_c(c).cast("string"), F.lit(""))), F.lit(term.lower()))
    return hit


_ENTITY = r"&[#\w]+;?"
_OPEN = re.compile(r"&(nbsp|amp|lt|gt|quot|apos)(?!;)", re.I)
_ESCAPE = re.compile(r"\\u[0-9a-fA-F]{4}")


def _entities(x: str | None) -> str | None:
    if x is None:
        return None
    return " ".join(html.unescape(_OPEN.sub(r"&\1;", x)).split())


@F.pandas_udf(StringType())
def _entities_udf(s: pd.Series) -> pd.Series:
    return s.map(_entities)


def _escapes(x: str | None) -> str | None:
    if x is None:
        return None

    def one(m: re.Match) -> str:
        try:
            return json.loads(f'"{m[0]}"')
        except ValueError:
            return m[0]

    return _entities(re.sub(r"(?:\\u[0-9a-fA-F]{4})+", one, x))


@F.pandas_udf(StringType())
def _escapes_udf(s: pd.Series) -> pd.Series:
    return s.map(_escapes)


def clean_entities(c: Name) -> Column:
    """Character references decoded and white space made single, where there is a reference."""
    return F.when(_c(c).rlike(_ENTITY), _entities_udf(_c(c))).otherwise(_c(c))


def clean_text(c: Name) -> Column:
    """As :func:`clean_entities`, with ``\\uXXXX`` escapes decoded first."""
    return F.when(_c(c).rlike(_ENTITY) | _c(c).rlike(r"\\u[0-9a-fA-F]{4}"), _escapes_udf(_c(c))).otherwise(_c(c))


def clean_description(c: Name) -> Column:
    """Entities, white space, then tags."""
    return F.regexp_replace(clean_entities(c), "<[^>]+>", "")
