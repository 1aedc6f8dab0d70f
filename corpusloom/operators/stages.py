"""The cleaning pipeline: raw tables to clean ones, stage by stage.

Every stage is a pure ``DataFrame -> DataFrame`` function over articles with three list columns,
``authors``, ``department`` and ``location`` (``array<string>``; null and empty mean nothing), or over
people.  Stages 06, 09, 10, 11 and 14 give the same result when applied twice.

Word lists are parameters with defaults; ``house`` is the publisher's short name.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import byline
from ..functions import text as T
from . import resolve

LISTS = ("authors", "department", "location")

# fixed values: words in location lists that are no places
NO_PLACES = ["text", "bilder", "illustrationen", "grafik", "interview", "infografik", "fotos", "grafiken", "videos", "photos", "mitarbeit", "illustration", "video", "texte", "mountain view", "infografiken"]
# fixed values: country codes
COUNTRIES = {"fr": "France"}
# fixed values: departments that stand among people; ``{house}`` is the house's own name, a parameter
DEPARTMENT_TERMS = [
    "{house}-Bildredaktion",
    "Feuilletonredaktion",
    "{house}-Inlandredaktion",
    "{house}-Feuilletonredaktion",
    "{house} Redaktion",
    "{house} Content Creation",
    "Die Kulturredaktion",
    "{house}-Nachrichtenredaktion",
    "Kulturredaktion",
    "{house} Bildredaktion",
    "Bildredaktion",
    "{house}-Sportredaktion",
    "{house}-Wirtschaftsredaktion",
    "{house}-Visuals",
    "{house}-Auslandredaktion",
    "Feuilleton-Redaktion",
]
# fixed values: departments and people that stand among places
PLACE_DEPARTMENTS = ["Bildredaktion", "{house}-Sportredaktion"]
PLACE_PEOPLE = ["Michael von Ledebur", "Nadine A.", "Gioia da Silva"]


def _of_house(terms: list[str], house: str) -> list[str]:
    """The terms with the house's name; without one, those that need none."""
    return [x.format(house=house) for x in terms if house or "{house}" not in x]


def _list(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.array().cast("array<string>"))


def _none_if_empty(c: Column) -> Column:
    return F.when(F.size(c) > 0, c)


def _among(words) -> callable:
    low = [w.lower() for w in words]
    return lambda x: F.lower(x).isin(low) if low else F.lit(False)


def _spelled(words) -> callable:
    """The list's own spelling of an item that is in it in any case."""
    if not words:
        return lambda x: x
    table = F.create_map(*[F.lit(y) for w in words for y in (w.lower(), w)])
    return lambda x: F.coalesce(F.try_element_at(table, F.lower(x)), x)


def _append(own: Column, found: Column) -> Column:
    """``own`` and the new items of ``found``."""
    return F.concat(own, F.array_distinct(F.filter(found, lambda x: ~F.array_contains(own, x))))


def departments_of(house: str) -> list[str]:
    return _of_house(DEPARTMENT_TERMS, house)


# fixed values: tables that the stages derive, and tables they start from
DERIVED = ["authors", "articles", "related_articles", "article_author_association"]
RAW = ["articles_raw", "authors_raw"]


def reset(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Stage 00: derived tables without rows, raw ones as they are; others stay too, with a warning."""
    for name in tables:
        if name not in DERIVED and name not in RAW:
            warnings.warn(f"{name} is no table of the stages; it is left as it is", stacklevel=2)
    return {name: df.limit(0) if name in DERIVED else df for name, df in tables.items()}


def stage01_authors(old: DataFrame, raw: DataFrame) -> DataFrame:
    """Raw people into people: name and has_info are overwritten, other fields where not empty."""
    keyed = lambda df: df.withColumn("_name_key", F.when(F.col("author_id").isNull(), F.col("name")))
    return resolve.upsert(keyed(old), keyed(raw), ["author_id", "_name_key"], ["name", "has_info"], ["title", "alt_name", "alias", "department", "bio"]).drop("_name_key")


def stage02_articles(old: DataFrame, raw: DataFrame) -> DataFrame:
    """Raw articles into articles: seven columns are overwritten, derived ones are kept."""
    cols = ["title", "content", "description", "tags", "category", "article_date", "article_date_updated"]
    merged = resolve.upsert(old, raw, ["article_id"], cols, [])
    return merged.join(old.select("article_id", *LISTS), "article_id", "left")


def stage03_related(articles: DataFrame, raw: DataFrame) -> DataFrame:
    """Ids of related articles from the raw table; rows without a raw row keep theirs."""
    r = raw.select("article_id", T.related_ids("related_raw").alias("_r"), F.lit(True).alias("_in"))
    return articles.join(r, "article_id", "left").withColumn("related_articles", F.when(F.col("_in"), F.col("_r")).otherwise(F.col("related_articles"))).drop("_r", "_in")


def stage04_extract(articles: DataFrame, raw: DataFrame, gazetteer: frozenset[str] = frozenset(), house: str = "") -> DataFrame:
    """People, places and departments of the raw byline, into columns that are still empty.

    A place is refused if it has brackets, is a department, or has two capitalised words and
    no sign of a place; the department of that person is then left out as well.
    """
    parser = byline.Parser(gazetteer, house)
    p = byline.parse_bylines(raw.select("article_id", "author"), "author", gazetteer, house, "_people")
    low = [x.lower() for x in sorted(byline.DEPARTMENTS)]
    sign = "(?i)" + "|".join(byline.PLACE_WORDS)
    known = F.lower(F.col("x.location")).isin(sorted(parser.places)) if parser.places else F.lit(False)
    refused = F.col("x.location").isNotNull() & (F.col("x.location").rlike(r"[\[\](){}]") | F.lower("x.location").isin(low) | (F.col("x.location").rlike(r"^\p{Lu}\S* \p{Lu}\S*$") & ~F.col("x.location").rlike(sign) & ~known))
    long = p.select("article_id", F.posexplode("_people").alias("pos", "x")).select("article_id", "pos", F.col("x.name").alias("a"), F.when(~refused, F.col("x.department")).alias("d"), F.when(~refused, F.col("x.location")).alias("l"))
    ordered = lambda c: F.array_distinct(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("pos", c))), lambda x: x[c]), lambda x: x.isNotNull()))
    found = long.groupBy("article_id").agg(ordered("a").alias("_a"), ordered("d").alias("_d"), ordered("l").alias("_l"))
    found = found.withColumn("_l", F.flatten(F.transform("_l", T.split_places)))
    j = articles.join(found, "article_id", "left")
    fill = lambda c, f: F.when(F.size(_list(c)) > 0, F.col(c)).otherwise(_none_if_empty(_list(f)))
    return j.withColumns({"authors": fill("authors", "_a"), "department": fill("department", "_d"), "location": fill("location", "_l")}).drop("_a", "_d", "_l")


def stage05_refine(articles: DataFrame, gazetteer: frozenset[str] = frozenset(), house: str = "") -> DataFrame:
    """Items with parentheses are taken apart and their parts put where they belong."""
    low = sorted(byline.DEPARTMENTS)
    places = sorted(x.lower() for x in gazetteer)
    is_dept = lambda x: F.lower(x).isin(low) | F.contains(F.lower(x), F.lit("redaktion")) | (F.startswith(F.lower(x), F.lit(house.lower())) if house else F.lit(False))
    is_place = lambda x: F.lower(x).isin(places) if places else F.lit(False)
    is_name = lambda x: x.rlike(r"^\p{Lu}\S*(?: \S+)* \p{Lu}\S*$")
    both = lambda x: F.contains(x, F.lit("(")) & F.contains(x, F.lit(")"))
    every = F.concat(*(_list(c) for c in LISTS))
    parts = F.flatten(F.transform(F.filter(every, both), lambda x: F.concat(T.outside_parentheses(x), T.inside_parentheses(x))))
    dept = F.filter(parts, is_dept)
    loc = F.filter(parts, lambda x: ~is_dept(x) & (is_place(x) | ~is_name(x)))
    name = F.filter(parts, lambda x: ~is_dept(x) & ~is_place(x) & is_name(x))
    plain = lambda c: F.filter(_list(c), lambda x: ~both(x))
    new = {"authors": _append(plain("authors"), name), "department": _append(plain("department"), dept), "location": _append(plain("location"), loc)}
    touched = F.exists(every, both)
    return articles.withColumns({c: F.when(touched, _none_if_empty(v)).otherwise(F.col(c)) for c, v in new.items()})


def stage06_locations(articles: DataFrame, house: str = "", to_authors: list[str] | None = None, to_departments: list[str] | None = None) -> DataFrame:
    """Places without commas around them and junk; departments and people among them move."""
    depts = _of_house(PLACE_DEPARTMENTS, house) if to_departments is None else to_departments
    to_authors = PLACE_PEOPLE if to_authors is None else to_authors
    bare = F.filter(F.transform(_list("location"), lambda x: T.strip(F.btrim(T.strip(x), F.lit(",")))), lambda x: x.isNotNull() & (x != ""))
    articles, bare = articles.withColumn("_bare", bare), F.col("_bare")
    junk, dept, person = _among(NO_PLACES), _among(depts), _among(to_authors)
    keep = F.transform(F.filter(bare, lambda x: ~junk(x) & ~dept(x) & ~person(x)), _countries)
    return articles.withColumns(
        {
            "location": _none_if_empty(F.array_distinct(keep)),
            "department": _none_if_empty(_append(_list("department"), F.transform(F.filter(bare, lambda x: ~junk(x) & dept(x)), _spelled(depts)))),
            "authors": _none_if_empty(_append(_list("authors"), F.transform(F.filter(bare, lambda x: ~junk(x) & ~dept(x) & person(x)), _spelled(list(to_authors))))),
        }
    ).drop("_bare")


def _countries(x: Column) -> Column:
    out = x
    for code, name in COUNTRIES.items():
        out = F.when(F.lower(x) == code, F.lit(name)).otherwise(out)
    return out


def stage07_names(articles: DataFrame, gazetteer: frozenset[str] = frozenset(), house: str = "") -> DataFrame:
    """Authors as single people: items with several names are split by the parser."""
    long = articles.select("article_id", F.posexplode_outer("authors").alias("pos", "a"))
    p = byline.parse_bylines(long, "a", gazetteer, house, "_p")
    names = F.when(F.size("_p") > 0, F.transform("_p", lambda x: x["name"])).otherwise(F.array("a"))
    dept = F.lower("a") == (f"{house} bildredaktion".strip().lower() if house else "bildredaktion")
    got = p.select("article_id", "pos", F.when(dept, F.array().cast("array<string>")).otherwise(names).alias("n"), F.when(dept, F.col("a")).alias("d"))
    seq = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("pos", c))), lambda x: x[c])
    new = got.groupBy("article_id").agg(F.array_distinct(F.flatten(seq("n"))).alias("_a"), F.filter(seq("d"), lambda x: x.isNotNull()).alias("_d"))
    j = articles.join(new, "article_id", "left")
    return j.withColumns({"authors": _none_if_empty(F.filter(_list("_a"), lambda x: x.isNotNull())), "department": _none_if_empty(_append(_list("department"), _list("_d")))}).drop("_a", "_d")


def stage08_corrections(articles: DataFrame, corrections: DataFrame) -> DataFrame:
    """Reviewed names: ``corrections(author, action, payload)`` with ``replace``, ``dept`` or ``loc``.

    A correction applies to all instances of a name; ``replace`` may give several names, comma-joined.
    """
    long = articles.select("article_id", F.posexplode("authors").alias("pos", "a"))
    j = long.join(corrections.withColumnRenamed("author", "a"), "a", "left")
    pick = lambda kind, other: F.when(F.col("action") == kind, T.non_empty(F.split("payload", ","))).otherwise(other)
    none = F.array().cast("array<string>")
    j = j.withColumns({"n": pick("replace", F.when(F.col("action").isNull(), F.array("a")).otherwise(none)), "d": pick("dept", none), "l": pick("loc", none)})
    seq = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", c))), lambda x: x[c]))
    new = j.groupBy("article_id").agg(F.array_distinct(seq("n")).alias("_a"), seq("d").alias("_d"), seq("l").alias("_l"))
    out = articles.join(new, "article_id", "left")
    return out.withColumns({"authors": _none_if_empty(_list("_a")), "department": _none_if_empty(_append(_list("department"), _list("_d"))), "location": _none_if_empty(_append(_list("location"), _list("_l")))}).drop("_a", "_d", "_l")


def stage09_authors(articles: DataFrame, house: str = "") -> DataFrame:
    """Authors without labels; departments among them move."""
    depts = departments_of(house)
    dept = _among(depts)
    items = T.non_empty(_list("authors"))
    kept = F.filter(F.transform(F.filter(items, lambda x: ~dept(x)), T.clean_label), lambda x: x.isNotNull())
    moved = F.transform(F.filter(items, dept), _spelled(depts))
    return articles.withColumns({"authors": _none_if_empty(F.array_distinct(kept)), "department": _none_if_empty(_append(_list("department"), moved))})


def stage10_departments(articles: DataFrame, house: str = "", to_authors: list[str] = ("Genf",)) -> DataFrame:
    """Departments without the house's name; people among them move; no repeats in any case."""
    person = _among(to_authors)
    items = T.non_empty(_list("department"))
    named = F.transform(items, lambda x: F.struct(x.alias("x"), F.when(person(x), _spelled(list(to_authors))(x)).otherwise(T.author_in_department(x)).alias("name")))
    articles = articles.withColumn("_named", named)  # once, for both uses below
    names = F.transform(F.filter("_named", lambda s: s["name"].isNotNull()), lambda s: s["name"])
    parts = F.flatten(F.transform(F.filter("_named", lambda s: s["name"].isNull()), lambda s: T.non_empty(F.split(s["x"], ","))))
    bare = F.filter(F.transform(parts, lambda x: T.clean_department(x, house)) if house else parts, lambda x: x.isNotNull())
    out = articles.withColumns({"_bare": bare, "authors": _none_if_empty(_append(_list("authors"), names))})
    return out.withColumn("department", _none_if_empty(T.ci_distinct(F.col("_bare")))).drop("_bare", "_named")


def stage11_unicode(articles: DataFrame) -> DataFrame:
    """Escapes in list items become characters; with native lists there is nothing else to rewrite."""
    return articles.withColumns({c: F.when(F.exists(_list(c), lambda x: x.rlike(r"\\u[0-9a-fA-F]{4}")), F.from_json(F.regexp_replace(F.to_json(F.col(c)), r"\\\\u", r"\\u"), "array<string>")).otherwise(F.col(c)) for c in LISTS})


def stage12_match(articles: DataFrame, people: DataFrame, prefix: str = "non-imp-") -> DataFrame:
    """People with new rows for authors whom no name, alias or other name matches."""
    names = articles.select(F.col("article_id").alias("item"), F.posexplode("authors").alias("pos", "name"))
    known = people.select(F.explode(F.array("name", "alias", "alt_name")).alias("name")).where("name is not null")
    first = resolve.next_synthetic_id(people, "author_id", prefix).first()[0]
    new = resolve.create_missing(names, known, prefix, first)
    return people.unionByName(new, allowMissingColumns=True)


def _merge(articles: DataFrame, people: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Names of ``groups(norm, canonical)`` become their canonical row's; the other rows go."""
    name = groups.join(people.select(F.col("id").alias("canonical"), T.strip("name").alias("name")), "canonical").select("norm", "name", "canonical")
    gone = people.withColumn("norm", T.norm_match("name")).join(name.select("norm", "canonical"), "norm").where("id <> canonical").select("id")
    return resolve.rename_in_lists(articles, "article_id", "authors", name.select("norm", "name")), people.join(gone, "id", "left_anti")


def stage13_merge_duplicates(articles: DataFrame, people: DataFrame) -> tuple[DataFrame, DataFrame]:
    return _merge(articles, people, resolve.duplicate_groups(people).select("norm", "canonical"))


def stage14_entities(articles: DataFrame, people: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Character references decoded in names and list items; each distinct item once."""
    out = articles
    for c in LISTS:
        long = out.select("article_id", F.posexplode(c).alias("pos", "x"))
        dirty = long.where(F.col("x").rlike(r"&[#\w]+;?"))
        fixed = dirty.select("x").distinct().withColumn("y", T.clean_entities("x"))
        new = long.join(dirty.select("article_id").distinct(), "article_id", "left_semi").join(fixed, "x", "left").withColumn("x", F.coalesce("y", "x"))
        out = out.join(resolve.regroup(new, "article_id", "pos", "x", "_x"), "article_id", "left").withColumn(c, F.coalesce("_x", c)).drop("_x")
    return out, people.withColumns({c: T.clean_entities(c) for c in ("name", "alias", "alt_name")})


def stage15_merge_prefixes(articles: DataFrame, people: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A name cut off with a full stop becomes the longest name that it begins."""
    m = resolve.prefix_matches(people)
    ids = people.groupBy(T.strip("name").alias("long")).agg(F.min("id").alias("canonical"))
    groups = m.join(ids, "long").select(T.norm_match("short").alias("norm"), "canonical").dropDuplicates(["norm"])
    return _merge(articles, people, groups)


def run_all(tables: dict[str, DataFrame], gazetteer: frozenset[str] = frozenset(), house: str = "") -> dict[str, DataFrame]:
    """Stages 00 to 07 and 09 to 11 from the raw tables: ``articles`` and ``authors`` made anew.

    ``tables`` has ``articles``, ``authors`` (with their lists), ``articles_raw`` and ``authors_raw``; the raw articles
    bring the columns of stage 02 and ``author`` and ``related_raw``.
    """
    t = reset(tables)
    people = stage01_authors(t["authors"], t["authors_raw"])
    articles = stage02_articles(t["articles"], t["articles_raw"])
    none = F.lit(None).cast("array<string>")
    if "related_articles" not in articles.columns:
        articles = articles.withColumn("related_articles", none)
    return {**t, "authors": people, "articles": run(articles, t["articles_raw"].select("article_id", "author", "related_raw"), gazetteer, house)}


def run(articles: DataFrame, raw: DataFrame, gazetteer: frozenset[str] = frozenset(), house: str = "") -> DataFrame:
    """The automatic stages over articles, 03 to 07 and 09 to 11, in order."""
    a = stage03_related(articles, raw)
    a = stage04_extract(a, raw, gazetteer, house)
    a = stage05_refine(a, gazetteer, house)
    a = stage06_locations(a, house)
    a = stage07_names(a, gazetteer, house)
    a = stage09_authors(a, house)
    a = stage10_departments(a, house)
    return stage11_unicode(a)
