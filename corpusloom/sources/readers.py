"""Readers: Parquet, CSV, JSON, JDBC, with the tables' schemas and drift made good."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as TT

_S, _L, _I, _TS = "string", "bigint", "int", "timestamp"
SCHEMAS = {
    "articles_raw": f"id {_L}, article_id {_S}, title {_S}, content {_S}, tags {_S}, category {_S}, scraped_at {_TS}, article_url {_S}, article_date {_TS}, article_updated {_TS}, author {_S}, author_links array<{_S}>, description {_S}, related_articles array<struct<id:{_S},url:{_S}>>",
    "authors_raw": f"id {_L}, author_id {_S}, name {_S}, title {_S}, alt_name {_S}, bio {_S}, author_url {_S}, alias {_S}, has_info {_I}, department {_S}, scraped_at {_TS}",
    "articles": f"id {_L}, article_id {_S}, title {_S}, content {_S}, description {_S}, tags {_S}, category {_S}, authors array<{_S}>, department array<{_S}>, location array<{_S}>, related_articles array<{_S}>, related_articles_filtered array<{_S}>, article_date {_TS}, article_date_updated {_TS}",
    "authors": f"id {_L}, author_id {_S}, name {_S}, title {_S}, alt_name {_S}, alias {_S}, department {_S}, location {_S}, tags {_S}, bio {_S}, has_info {_I}",
    "staff": f"organization {_S}, department {_S}, name {_S}",
}


def schema(name: str) -> TT.StructType:
    return TT.StructType.fromDDL(SCHEMAS[name])


def conform(df: DataFrame, wanted: TT.StructType) -> DataFrame:
    """Columns of ``wanted`` in its order: cast, missing ones null, list texts decoded, others dropped."""
    have = {f.name.lower(): f for f in df.schema.fields}
    out = []
    for f in wanted.fields:
        got = have.get(f.name.lower())
        if got is None:
            c = F.lit(None).cast(f.dataType)
        elif isinstance(f.dataType, TT.ArrayType) and isinstance(got.dataType, TT.StringType):
            c = F.from_json(F.col(got.name), f.dataType)
        elif isinstance(got.dataType, TT.StringType) and not isinstance(f.dataType, TT.StringType):
            c = F.col(got.name).try_cast(f.dataType)
        else:
            c = F.col(got.name).cast(f.dataType)
        out.append(c.alias(f.name))
    return df.select(*out)


def read_parquet(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return conform(df, schema(name)) if name else df


def read_csv(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return conform(df, schema(name)) if name else df


def read_json(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """A file that is one JSON array, or many lines of objects."""
    df = spark.read.option("multiLine", True).json(path)
    return conform(df, schema(name)) if name else df


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, lower: int, upper: int, parts: int, **options) -> DataFrame:
    """A warehouse table in key ranges, each read by its own task; never by offset."""
    return spark.read.jdbc(url, table, column=key, lowerBound=lower, upperBound=upper, numPartitions=parts, properties={"fetchsize": "10000", "queryTimeout": "300", **options})


def staff_directory(df: DataFrame) -> DataFrame:
    """``name, departments``: the different departments of each name, in the file's order."""
    d = df.select(F.trim("name").alias("name"), F.trim("department").alias("department"), F.monotonically_increasing_id().alias("_n")).where("name <> ''")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_n", "department"))), lambda x: x["department"])
    return d.groupBy("name").agg(F.array_distinct(F.filter(ordered, lambda x: x != "")).alias("departments"))


#: declared SQL types in the order in which they are tried (fixed values: order decides)
_TYPES = [("INT", "INTEGER"), ("TEXT", "TEXT"), ("VARCHAR", "TEXT"), ("CHAR", "TEXT"), ("REAL", "REAL"), ("FLOAT", "REAL"), ("DOUBLE", "REAL"), ("BLOB", "BYTEA"), ("DATETIME", "TIMESTAMP"), ("TIMESTAMP", "TIMESTAMP"), ("DATE", "DATE"), ("BOOL", "BOOLEAN")]


def warehouse_type(declared: str) -> str:
    """The warehouse's type for a declared column type; character types with a length stay."""
    d = (declared or "").upper()
    for sign, kind in _TYPES:
        if sign in d:
            return d if kind == "TEXT" and "(" in d else kind
    return "TEXT"
