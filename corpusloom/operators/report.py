"""Reports and viewers over article tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def per_day(df: DataFrame, ts: str) -> DataFrame:
    """``day, n, bar`` of every day that occurs; the longest bar has 60 blocks."""
    d = df.where(F.col(ts).isNotNull()).groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("n"))
    top = d.agg(F.max("n").alias("top"))
    return d.crossJoin(F.broadcast(top)).select("day", "n", F.repeat(F.lit("█"), F.floor(F.col("n") * 60 / F.col("top")).cast("int")).alias("bar"))


def per_day_stats(df: DataFrame, ts: str) -> DataFrame:
    d = df.where(F.col(ts).isNotNull()).groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("n"))
    return d.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("days"), F.round(F.avg("n"), 6).alias("avg_per_day"), F.max("n").alias("max_per_day"), F.min("n").alias("min_per_day"))


def author_sections(bylines: DataFrame) -> DataFrame:
    """``author, section, n`` of ``bylines(author, section)``; no section is ``Unspecified``."""
    return bylines.groupBy("author", F.coalesce("section", F.lit("Unspecified")).alias("section")).agg(F.count("*").alias("n"))


def dominant(counts: DataFrame) -> DataFrame:
    """The section of each author with the greatest count, the first in order on a tie."""
    best = F.min(F.struct((-F.col("n")).alias("m"), "section"))
    return counts.groupBy("author").agg(best.alias("b")).select("author", F.col("b.section").alias("section"), (-F.col("b.m")).alias("n"))


def cluster_sections(rows: DataFrame) -> DataFrame:
    """``cluster, section, n`` of authors with a section."""
    return rows.where("section is not null").groupBy("cluster", "section").agg(F.count("*").alias("n"))


def cluster_summary(counts: DataFrame) -> DataFrame:
    """Authors, sections and the most frequent section of each cluster, at most two on a tie."""
    top = counts.withColumn("r", F.rank().over(Window.partitionBy("cluster").orderBy(F.desc("n"))))
    return top.groupBy("cluster").agg(
        F.sum("n").alias("total_authors"),
        F.lit(0).cast("long").alias("without_section"),
        F.array_join(F.slice(F.sort_array(F.collect_list(F.when(F.col("r") == 1, F.col("section")))), 1, 2), ", ").alias("most_frequent"),
        F.count("*").alias("sections"),
    )


def distinct_counts(rows: DataFrame, cluster: str, author: str) -> DataFrame:
    """Different clusters, counting null as one, and different authors."""
    return rows.agg((F.count_distinct(cluster) + F.max(F.when(F.col(cluster).isNull(), 1).otherwise(0))).alias("clusters"), F.count_distinct(author).alias("authors"))


def pivot(rows: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts with one column for each of ``values``, 0 where there are none."""
    return rows.groupBy(row).pivot(column, values).count().na.fill(0, values)


def listing(df: DataFrame, key: str, order: str, limit: int | None = None, description: str = "description") -> DataFrame:
    """For a listing: the text's length for the text, the description cut at 100, newest first."""
    cut = F.when(F.length(description) > 100, F.concat(F.substring(description, 1, 100), F.lit("..."))).otherwise(F.coalesce(description, F.lit("")))
    out = df.orderBy(F.desc(order), F.asc(key))
    out = out.limit(limit) if limit else out
    return out.select(key, F.length(F.coalesce("content", F.lit(""))).cast("long").alias("content_length"), cut.alias("description"), F.date_format(order, "yyyy-MM-dd HH:mm").alias("scraped"))


def format_checks(key: Column, title: Column, url: Column, content: Column, scraped: Column) -> dict[str, Column]:
    """The five conditions that a stored article meets, and all of them together."""
    full = lambda c: T.blank_to_null(c).isNotNull()
    checks = {"has_id": full(key), "has_title": full(title), "has_url": full(url), "has_content": F.coalesce(F.length(T.strip(content)) > 50, F.lit(False)), "has_scraped_at": scraped.isNotNull()}
    every = F.lit(True)
    for c in checks.values():
        every = every & c
    return checks | {"all_valid": every}


def recent(df: DataFrame, ts: str, now: str, days: int = 365) -> DataFrame:
    """Rows of the last ``days`` days before ``now``, and rows without a date."""
    return df.where(F.col(ts).isNull() | (F.col(ts) >= F.lit(now).cast("timestamp") - F.make_interval(days=F.lit(days))))


def oldest(df: DataFrame, ts: str, key: str, n: int) -> DataFrame:
    return df.where(F.col(ts).isNotNull()).orderBy(F.asc(ts), F.asc(key)).limit(n)


def carry_forward(df: DataFrame, group: str, order: str, value: str, out: str) -> DataFrame:
    """``out``: the latest non-null ``value`` up to each row of its group."""
    return df.withColumn(out, F.last(value, ignorenulls=True).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
