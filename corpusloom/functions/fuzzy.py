"""Fuzzy lookup of names by the ratio of matching blocks.

The ratio of two names is twice the letters in matching blocks over all letters, so it is at most twice the letters they
share (each counted as often as both have it) over all letters.  Names are sets of numbered letters
(``a1, a2, n1``), and a set join finds the pairs whose bound reaches the cutoff: letters are ordered from rare to
common, and two sets that share enough must share some (``KEY``) of the first few of each.  Only those pairs are compared.

:func:`best_match` looks for close partners first: of a name that has a partner of some ratio, the best one is among the
pairs that reach it, so only names without one are looked up at the next lower ratio.
"""

from __future__ import annotations

import difflib
import itertools
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch

KEY = 3  # letters that a pair must share to meet
MAX_KEYS = 200  # keys of a name; where there would be more, fewer letters make a key
NAMES_PER_TASK = 1000
FIRST = 0.03  # how far from 1 the first ratio is; the distance doubles from look to look


def _letters(name: Column) -> Column:
    """Every letter of a name with its number among equal ones."""
    parts = F.filter(F.split(name, ""), lambda x: x != "")
    return F.transform(parts, lambda x, i: F.concat(x, F.size(F.filter(F.slice(parts, 1, i + 1), lambda y: y == x)).cast("string")))


def close_pairs(names: DataFrame, known: DataFrame, cutoff: float) -> DataFrame:
    """``name, other``: pairs of ``names(name)`` and ``known(other)`` whose ratio can reach ``cutoff``; no such pair is missing."""
    a = names.select("name", _letters(F.col("name")).alias("s"))
    b = known.select("other", _letters(F.col("other")).alias("s"))
    rank = b.select(F.explode("s").alias("x")).groupBy("x").agg(F.count("*").alias("c"))

    longest = a.select("s").unionByName(b.select("s")).agg(F.max(F.size("s"))).first()[0] or 0
    share = cutoff / (2 - cutoff)
    key = next(k for k in range(KEY, 0, -1) if k == 1 or math.comb(longest - math.ceil(longest * share - 1e-9) + k, k) <= MAX_KEYS)

    def keys(letters: pd.Series) -> pd.Series:
        """Sets of ``key`` of a name's rarest letters: a partner that shares as many letters as it must has one of them too.

        A pair that need not share ``key`` letters has two short names, which meet by single letters as well.
        """
        out = []
        for x in letters:
            least = max(1, math.ceil(len(x) * share - 1e-9))
            most = max(least, key)
            found = ["\0".join(y) for y in itertools.combinations(x[: len(x) - most + key], key)] if len(x) >= key else []
            out.append(found + ([f"\1{y}" for y in x[: len(x) - least + 1]] if least < key else []))
        return pd.Series(out, dtype=object)

    cut = F.pandas_udf(keys, "array<string>")

    def first(df: DataFrame, name: str) -> DataFrame:
        ranked = df.select(name, "s", F.explode("s").alias("x")).join(rank, "x", "left").groupBy(name, "s").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "x"))).alias("o"))
        return ranked.select(name, "s", F.explode(cut(F.col("o.x"))).alias("x"))

    p, q = first(a, "name"), first(b, "other").withColumnRenamed("s", "t")
    size = names.count()
    if size > NAMES_PER_TASK:  # few bytes make many pairs, so the number of tasks is given
        tasks = max(names.sparkSession.sparkContext.defaultParallelism, -(-size // NAMES_PER_TASK))
        p, q = p.repartition(tasks, "x"), q.repartition(tasks, "x")
    n = F.size("s") + F.size("t")
    met = p.join(q, "x").where(2 * F.least(F.size("s"), F.size("t")) >= cutoff * n - 1e-9)
    return met.where(2 * F.size(F.array_intersect("s", "t")) >= cutoff * n - 1e-9).select("name", "other").distinct()


def _ratios(names: pd.Series, others: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, y, x).ratio() for x, y in zip(names, others)], dtype=float)


def best_match(names: DataFrame, directory: DataFrame, cutoff: float = 0.85) -> DataFrame:
    """``name, match, role``: the equal name, else the closest of at least ``cutoff``, else ``Unknown``.

    Each distinct name is looked up once; of equally close ones the greater name counts.  Several roles of a name
    are sorted and joined.  The directory may be of any size.
    """
    roles = directory.where("name is not null").groupBy(F.col("name").alias("match")).agg(F.array_join(F.sort_array(F.collect_set("role")), ", ").alias("role"))
    wanted = names.where("name is not null").select("name").distinct()
    same = wanted.join(roles, F.col("name") == F.col("match")).select("name", "match", "role")
    other = wanted.join(roles, F.col("name") == F.col("match"), "left_anti")
    work = Scratch(names.sparkSession, "fuzzy")
    other = work.save(other, "other")
    known = work.save(roles.select(F.col("match").alias("other")), "known")
    looks = [1 - FIRST * 2**k for k in range(64) if 1 - FIRST * 2**k > cutoff] + [cutoff]
    left, best = other, None
    for k, least in enumerate(looks):
        pairs = close_pairs(left, known, least).repartition(names.sparkSession.sparkContext.defaultParallelism).withColumn("r", F.pandas_udf(_ratios, "double")("name", "other")).where(F.col("r") >= least)
        got = work.save(pairs.groupBy("name").agg(F.max(F.struct("r", "other")).alias("b")).select("name", F.col("b.other").alias("match")), f"best{k}")
        best = got if best is None else best.unionByName(got)
        left = work.save(left.join(got, "name", "left_anti"), f"left{k}")
        if left.isEmpty():
            break
    found = other.join(best, "name", "left").join(roles, "match", "left").select("name", "match", F.coalesce("role", F.lit("Unknown")).alias("role"))
    return same.unionByName(found)
