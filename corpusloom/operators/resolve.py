"""Entity resolution and table maintenance as joins, windows and aggregations.

List columns are ``array<string>``; their order travels as ``posexplode`` positions, never as the
order of rows.  Windows run over one person's or one item's rows; where a name could gather very
many rows, aggregations with map-side combine (``max_by`` on a struct) are used instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def regroup(df: DataFrame, key: str, pos: str, value: str, out: str) -> DataFrame:
    """``key, out``: the values of each key as an array in the order of their positions."""
    return df.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(pos, value))), lambda x: x[value]).alias(out))


def referential_filter(items: DataFrame, key: str, refs: str, ids: DataFrame) -> DataFrame:
    """``items`` with ``refs_filtered``: references that exist in ``ids(id)``, order and repeats kept; null if none."""
    long = items.select(key, F.posexplode(refs).alias("_pos", "_ref")).join(ids.select(F.col("id").alias("_ref")).distinct(), "_ref", "left_semi")
    return items.join(regroup(long, key, "_pos", "_ref", "refs_filtered"), key, "left")


def filter_statistics(filtered: DataFrame, refs: str) -> DataFrame:
    """``total, kept, removed, percent_removed`` of :func:`referential_filter`."""
    n = lambda c: F.coalesce(F.sum(F.when(F.col(c).isNotNull(), F.size(c)).otherwise(0)), F.lit(0)).cast("long")
    s = filtered.agg(n(refs).alias("total"), n("refs_filtered").alias("kept"))
    removed = F.col("total") - F.col("kept")
    return s.select("total", "kept", removed.alias("removed"), F.round(F.coalesce(F.try_divide(100.0 * removed, "total"), F.lit(0.0)), 6).alias("percent_removed"))


def lookup(keys: DataFrame, people: DataFrame, names: list[str], order: str) -> DataFrame:
    """``key, person`` for ``keys(key)`` that match a person by any of ``names``, later ones first.

    Keys and names are compared trimmed and in lower case; of several matches the row with the
    greatest ``(order, place of the name)`` wins.
    """
    forms = people.select(F.col(order).alias("_o"), F.col("id").alias("person"), F.posexplode(F.array(*names)).alias("_rank", "_n"))
    forms = forms.select(T.norm_simple("_n").alias("_k"), "person", F.struct("_o", "_rank").alias("_p")).where("_k <> ''")
    best = forms.groupBy("_k").agg(F.max_by("person", "_p").alias("person"))
    return keys.withColumn("_k", T.norm_simple("key")).join(best, "_k", "left").drop("_k")


def first_match(keys: DataFrame, forms: DataFrame) -> DataFrame:
    """``key, person`` by ``forms(form, priority, person)``: the least priority, then the least person."""
    best = forms.where("form <> ''").groupBy("form").agg(F.min(F.struct("priority", "person")).alias("b"))
    return keys.join(best, F.col("key") == F.col("form"), "left").select(keys["*"], F.col("b.person").alias("person"))


def existing(keys: DataFrame, people: DataFrame) -> DataFrame:
    """Keys that are a person's name, or one of the aliases, in any case."""
    forms = people.select(F.explode(T.non_empty(F.concat(F.array("name"), F.split(F.coalesce("alias", F.lit("")), ",")))).alias("f")).select(F.lower("f").alias("f")).distinct()
    return keys.join(forms, F.lower("key") == F.col("f"), "left_semi")


def next_synthetic_id(ids: DataFrame, column: str, prefix: str) -> DataFrame:
    """The greatest whole number after ``prefix`` plus one, 1 if there is none; others are ignored."""
    n = F.expr(f"try_cast(substring({column}, {len(prefix) + 1}) as bigint)")
    return ids.where(F.col(column).startswith(prefix)).agg((F.coalesce(F.max(n), F.lit(0)) + 1).alias("next_id"))


def create_missing(names: DataFrame, known: DataFrame, prefix: str, first_id: int) -> DataFrame:
    """``author_id, name`` for names (``name, item, pos``) that are not in ``known(name)``.

    New ids follow the first appearance; only distinct unmatched names are ordered.
    """
    n = names.withColumn("k", T.norm_simple("name")).where("k <> ''")
    new = n.join(known.select(T.norm_simple("name").alias("k")).distinct(), "k", "left_anti")
    first = new.groupBy("k").agg(F.min(F.struct("item", "pos", T.strip("name").alias("name"))).alias("f"))
    no = F.row_number().over(Window.orderBy("f.item", "f.pos")) + (first_id - 1)
    return first.select(F.concat(F.lit(prefix), no.cast("string")).alias("author_id"), F.col("f.name").alias("name"))


def golden_records(people: DataFrame, fields: list[str], lists: list[str], longest: list[str]) -> DataFrame:
    """One row per ``lower(trim(name))``.

    ``fields``: the first non-empty value, rows with ``has_info`` 1 first, then by id; ``lists``:
    comma lists united in that order; ``longest``: the longest value, the first on a tie.
    """
    p = people.withColumns({"key": T.norm_simple("name"), "_o": F.struct((-F.col("has_info")).alias("h"), F.col("id").alias("i"))})
    p = p.select("key", "_o", *(F.col(c).alias(f"_{c}") for c in dict.fromkeys(["id", "name", "has_info", *fields, *lists, *longest])))
    order = F.col("_o")
    aggs: list[Column] = [F.min_by("_id", order).alias("id"), F.min_by("_name", order).alias("name"), F.max("_has_info").alias("has_info"), F.count("*").alias("n_rows")]
    aggs += [F.min_by(f"_{c}", F.when(T.blank_to_null(f"_{c}").isNotNull(), order)).alias(c) for c in fields]
    aggs += [F.min_by(f"_{c}", F.struct((-F.length(F.coalesce(f"_{c}", F.lit("")))).alias("l"), order.alias("o"))).alias(c) for c in longest]
    out = p.groupBy("key").agg(*aggs)
    for c in lists:  # the first of equal items by aggregation, so that a large group costs no more
        items = p.select("key", "_o", F.posexplode(T.non_empty(F.split(F.coalesce(f"_{c}", F.lit("")), ","))).alias("_pos", "_item"))
        first = items.groupBy("key", F.lower("_item").alias("_low")).agg(F.min(F.struct("_o", "_pos", "_item")).alias("_f"))
        joined = first.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list("_f")), lambda x: x["_item"]), ", ").alias(c))
        out = out.join(joined, "key", "left").withColumn(c, F.coalesce(c, F.lit("")))
    return out


def conflicting_ids(people: DataFrame) -> DataFrame:
    """Ids that stand on rows of more than one merge group."""
    return people.where("author_id is not null").groupBy("author_id").agg(F.count_distinct(T.norm_simple("name")).alias("groups")).where("groups > 1").select("author_id")


def duplicate_groups(people: DataFrame) -> DataFrame:
    """``norm, n, canonical``: names equal when normalised; the canonical row has the best score."""
    p = people.withColumn("norm", T.norm_match("name")).withColumn("score", canonical_score())
    return p.groupBy("norm").agg(F.count("*").alias("n"), F.min_by("id", F.struct((-F.col("score")).alias("s"), "id")).alias("canonical")).where("n > 1 and norm <> ''")


def canonical_score(with_length: bool = False) -> Column:
    """The more is known of a person, the better the row."""
    has = lambda c: F.when(T.blank_to_null(c).isNotNull(), 1).otherwise(0)
    own = F.when(F.coalesce(F.col("author_id"), F.lit("non-imp-")).startswith("non-imp-"), 0).otherwise(1)
    s = 1000 * F.coalesce("has_info", F.lit(0)) + 100 * has("title") + 50 * has("bio") + 10 * has("department") + 5 * own
    return s + F.length("name") if with_length else s


def rename_in_lists(items: DataFrame, key: str, authors: str, mapping: DataFrame) -> DataFrame:
    """Names in a list column replaced by ``mapping(norm, name)``; order and length are kept."""
    long = items.select(key, F.posexplode(authors).alias("pos", "a")).withColumn("norm", T.norm_match("a"))
    new = long.join(mapping.select("norm", F.col("name").alias("new")), "norm", "left").withColumn("a", F.coalesce("new", "a"))
    return items.drop(authors).join(regroup(new, key, "pos", "a", authors), key, "left")


def prefix_matches(names: DataFrame, least: int = 3) -> DataFrame:
    """``short, long``: a name that ends with a full stop begins a longer one; the longest one wins.

    Only names with the same first ``least`` letters meet.
    """
    n = names.select(T.strip("name").alias("name")).distinct().withColumn("block", F.lower(F.substring("name", 1, least)))
    short = n.where(F.col("name").endswith(".") & (F.length("name") >= least)).select(F.col("name").alias("short"), "block", F.expr("substring(name, 1, length(name) - 1)").alias("stem"))
    pairs = short.join(n.withColumnRenamed("name", "long"), "block").where("length(long) > length(short) and startswith(lower(long), lower(stem))")
    return pairs.groupBy("short").agg(F.max(F.struct(F.length("long").alias("n"), "long")).alias("b")).select("short", F.col("b.long").alias("long"))


def propagate(items: DataFrame, people: DataFrame, item: str, authors: str, value: str) -> tuple[DataFrame, DataFrame]:
    """A list column shared both ways between items and their people.

    Returns ``(items, people)``, ``item, value`` and ``id, value``: own values first, then those
    of the other side in order, without repeats in any case.  A null side adds nothing.
    Every value travels with its place, and only the first place of each value is kept before a list is made,
    so a person of very many items gathers no more than their different values.
    """
    a = items.select(item, F.posexplode(authors).alias("pos", "a"), F.col(value).alias("iv")).withColumn("k", T.norm_simple("a"))
    p = people.select("id", T.norm_simple("name").alias("k"), F.col(value).alias("pv"))
    both = a.join(p, "k")
    kinds = dict(items.dtypes)[item], dict(people.dtypes)["id"]

    def shared(own: DataFrame, key: str, values: str, order: list[str], types: list[str]) -> DataFrame:
        place = lambda side, cols: F.struct(F.lit(side).alias("side"), *(c.cast(t).alias(f"o{n}") for n, (c, t) in enumerate(zip(cols, types))), "at")
        one = own.select(key, F.posexplode(T.non_empty(F.col(value))).alias("at", "v")).select(key, "v", place(0, [F.lit(None)] * len(order)).alias("o"))
        two = both.select(key, *(F.col(c).alias(f"_{c}") for c in order), F.posexplode(T.non_empty(F.col(values))).alias("at", "v")).select(key, "v", place(1, [F.col(f"_{c}") for c in order]).alias("o"))
        first = one.unionByName(two).groupBy(key, F.lower("v").alias("low")).agg(F.min(F.struct("o", "v")).alias("x"))
        lists = first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["v"]).alias("found"))
        none = F.array().cast("array<string>")
        return own.select(key).join(lists, key, "left").select(key, F.coalesce("found", none).alias(value))

    return shared(items.select(item, value), item, "pv", ["pos", "id"], ["int", kinds[1]]), shared(people.select("id", value), "id", "iv", [item, "pos"], [kinds[0], "int"])


def upsert(old: DataFrame, new: DataFrame, keys: list[str], always: list[str], keep: list[str]) -> DataFrame:
    """Old and new rows by key: ``always`` columns are taken from new rows, ``keep`` columns only where not empty."""
    o = old.select(*(F.col(c).alias(f"o_{c}") for c in [*keys, *always, *keep]), F.lit(True).alias("in_old"))
    n = new.select(*(F.col(c).alias(f"n_{c}") for c in [*keys, *always, *keep]), F.lit(True).alias("in_new"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"o_{k}").eqNullSafe(F.col(f"n_{k}"))
    j = o.join(n, on, "full")
    pick = lambda c: F.when(F.col("in_new"), F.col(f"n_{c}")).otherwise(F.col(f"o_{c}"))
    filled = lambda c: F.coalesce(F.nullif(F.col(f"n_{c}").cast("string"), F.lit("")).cast(old.schema[c].dataType), F.col(f"o_{c}"))
    return j.select(*(F.coalesce(f"n_{k}", f"o_{k}").alias(k) for k in keys), *(pick(c).alias(c) for c in always), *(filled(c).alias(c) for c in keep))


def fill_profiles(known: DataFrame, staff: DataFrame) -> DataFrame:
    """Staff entries into ``known(author_id, name, department, has_info)``: fill what is missing, add who is new."""
    j = known.alias("k").join(staff.alias("s"), "author_id", "full")
    return j.select("author_id", F.coalesce("k.name", "s.name").alias("name"), F.coalesce(T.blank_to_null("k.department"), F.col("s.department")).alias("department"), F.coalesce("k.has_info", "s.has_info").alias("has_info"))


def frontier(links: DataFrame, known: DataFrame) -> DataFrame:
    """``id, url`` of links (``id, url, order``) that are not known yet; the first url of an id wins."""
    new = links.where("id is not null").join(known.select("id").distinct(), "id", "left_anti")
    return new.groupBy("id").agg(F.min_by("url", "order").alias("url"))


def first_links(links: DataFrame) -> DataFrame:
    """Links of a page (``page, pos, id, url, title``) without repeats of url or id.

    A repeated or untitled link is dropped, and an untitled one still counts as seen.
    """
    seen = lambda c: F.row_number().over(Window.partitionBy("page", c).orderBy("pos"))
    once = links.withColumn("u", seen("url")).where("u = 1").withColumn("i", seen("id")).where("i = 1")
    return once.where(T.blank_to_null("title").isNotNull()).drop("u", "i")


def delete(table: DataFrame, ids: DataFrame, key: str, **linked: tuple[DataFrame, str]) -> dict[str, DataFrame]:
    """A table and its link tables without the rows of ``ids``."""
    gone = ids.select(F.col("id").alias("_gone")).distinct()
    drop = lambda df, c: df.join(gone, df[c] == gone["_gone"], "left_anti")
    return {"table": drop(table, key)} | {name: drop(df, c) for name, (df, c) in linked.items()}


def _grams(text: Column, sizes: list[int]) -> Column:
    """The different runs of 1, 2 or 3 letters."""
    n = F.length(text)

    def runs(k: int) -> Column:
        found = F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: text.substr(i, F.lit(k)))
        return F.when(n >= k, found).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*map(runs, sizes)))


def contains_pairs(whole: DataFrame, parts: DataFrame) -> DataFrame:
    """``whole, part``: every pair of ``whole(whole)`` and ``parts(part)``, distinct texts, of which the first contains the second.

    A part is looked up under its rarest run of three letters (of one or two, where it is that short), which every text
    that contains it has too; rare runs are in few texts, so few pairs are compared that do not match.
    """
    runs = whole.select("whole", F.explode(_grams(F.col("whole"), [1, 2, 3])).alias("g"))
    own = F.when(F.length("part") >= 3, _grams(F.col("part"), [3])).otherwise(F.array("part"))
    count = runs.where("length(g) = 3").groupBy("g").agg(F.count("*").alias("c"))
    rare = parts.where("part <> ''").select("part", F.explode(own).alias("g")).join(count, "g", "left")
    rare = rare.groupBy("part").agg(F.min(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "g")).alias("m")).select("part", F.col("m.g").alias("g"))
    return runs.join(rare, "g").where(F.col("whole").contains(F.col("part"))).select("whole", "part")


def contained_names(names: DataFrame, directory: DataFrame) -> DataFrame:
    """Names that equal, contain or are contained in a name of the directory, trimmed and in any case.

    Both ways are equi-joins on runs of letters; neither side is bounded.  A blank name is contained in any.
    """
    d = directory.select(T.norm_simple("name").alias("d")).where("d <> ''").distinct()
    n = names.select(T.norm_simple("name").alias("n")).where("n is not null").distinct()
    up = contains_pairs(n.withColumnRenamed("n", "whole"), d.withColumnRenamed("d", "part")).select(F.col("whole").alias("n"))
    down = contains_pairs(d.withColumnRenamed("d", "whole"), n.withColumnRenamed("n", "part")).select(F.col("part").alias("n"))
    blank = n.where("n = ''").join(d.limit(1), F.lit(True), "left_semi")
    hit = up.unionByName(down).unionByName(blank).distinct()
    return names.join(hit, T.norm_simple("name") == F.col("n"), "left_semi")


def resolve_ids(golden: DataFrame, people: DataFrame) -> DataFrame:
    """``key, author_id`` of merge groups: the primary row's, else the first there is.

    An id that also stands outside the group gives way to the primary row's own, or to none.
    """
    own = golden.join(people.select(F.col("id"), F.col("author_id").alias("primary_id")), "id", "left")
    clash = conflicting_ids(people).select(F.col("author_id").alias("_clash"))
    picked = own.withColumn("picked", F.coalesce(T.blank_to_null("primary_id"), F.col("author_id")))
    j = picked.join(clash, F.col("picked") == F.col("_clash"), "left")
    return j.select("key", F.when(F.col("_clash").isNull(), F.col("picked")).otherwise(T.blank_to_null("primary_id")).alias("author_id"))


def resolve_crawled(found: DataFrame, known: DataFrame) -> DataFrame:
    """``item, pos, author_id, name`` for crawled authors ``found(item, pos, link_id, name)``.

    By id, else by name or alias, else new: a placeholder made from the name.  A real id takes the
    place of a placeholder for the same name everywhere.
    """
    f = found.withColumn("_k", T.norm_simple("name"))
    forms = known.select("author_id", F.explode(T.non_empty(F.concat(F.array("name"), F.split(F.coalesce("alias", F.lit("")), ",")))).alias("n"))
    made = F.col("author_id").startswith("no-id-")
    by_name = forms.groupBy(F.lower("n").alias("_k")).agg(F.min(F.struct(made.alias("p"), "author_id")).alias("b")).select("_k", F.col("b.author_id").alias("known_id"))
    linked = f.where("link_id is not null").groupBy("_k").agg(F.min("link_id").alias("seen_id"))
    j = f.join(by_name, "_k", "left").join(linked, "_k", "left")
    old = F.when(~F.col("known_id").startswith("no-id-"), F.col("known_id"))
    return j.select("item", "pos", F.coalesce("link_id", old, "seen_id", "known_id", T.placeholder_id("name")).alias("author_id"), "name")


def save_aliases(old: DataFrame, new: DataFrame, limit: int = 200) -> DataFrame:
    """``author_id, name, alias``: the own name first, then old and new parts without repeats, cut at ``limit``."""
    j = old.alias("o").join(new.alias("n"), "author_id", "full")
    name = F.coalesce("n.name", "o.name")
    alias = F.array_join(T.ci_distinct(T.non_empty(F.concat(F.array(name), F.split(F.coalesce("o.alias", F.lit("")), ","), F.split(F.coalesce("n.alias", F.lit("")), ",")))), ", ")
    return j.select("author_id", name.alias("name"), F.substring(alias, 1, limit).alias("alias"))


def neighbours(links: DataFrame, source: str, target: str, key) -> DataFrame:
    """Stored links of one item."""
    return links.where(F.col(source) == key).select(target)
