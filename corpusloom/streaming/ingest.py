"""New pages as a stream (an extension: there is no streaming to match).

Pages are de-duplicated by id within a watermark, their fields extracted, old articles dropped,
and each micro-batch merged into a table of articles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pages import extract_fields
from ..operators.resolve import upsert


def pages_stream(spark: SparkSession, path: str, schema: str, late: str = "1 day") -> DataFrame:
    """Rows of Parquet files as they arrive, each ``page_id`` once within ``late`` of ``fetched_at``."""
    return spark.readStream.schema(schema).parquet(path).withWatermark("fetched_at", late).dropDuplicatesWithinWatermark(["page_id"])


def articles_stream(pages: DataFrame, days: int = 365) -> DataFrame:
    """Fields of each page; articles dated more than ``days`` before they were fetched are dropped."""
    a = extract_fields(pages, "html", "url")
    return a.where(F.col("article_date").isNull() | (F.col("article_date") >= F.col("fetched_at") - F.make_interval(days=F.lit(days))))


def merge_into(path: str, keys: list[str], always: list[str], keep: list[str]):
    """A ``foreachBatch`` function that writes the next version of the table under ``path``.

    Versions are folders ``v=<batch>``; a batch that is tried again writes the same version again.
    """

    def write(batch: DataFrame, no: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(*keys, *always, *keep)
        old = spark.read.parquet(f"{path}/v={no - 1}") if no else rows.limit(0)
        upsert(old, rows, keys, always, keep).write.mode("overwrite").parquet(f"{path}/v={no}")

    return write
