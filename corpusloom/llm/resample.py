"""Target-distribution importance resampling over a position table of words.

``posexplode`` lists every word of a text with its position; for each order above the first, ``lead()`` over
the document's positions concatenates the words that follow.  Features are hashed to ``BUCKETS`` buckets
(crc32) and counted over all documents and over all target texts.  A bucket's gain is the logarithm of its
smoothed share in the target over its share in the documents; a document's weight is the mean gain
of its features, joined from the table of gains (one row a bucket, so it is broadcast), and Gumbel noise
from a hash of the id turns the highest scores into a draw without replacement.

Scores are whole numbers of a narrow range (a gain is at most ``1000 * ln`` of the counts, the noise lies between
-3,100 and 22,900), so ranks come from a histogram of the scores: the rows above a score, then the rows of
smaller ids within it, then the row among equal ids.  No window holds more than one score's groups or one
(score, id, input partition); rows of one repeated id are split by input partition.

Defined results: a null text has no words, weight 0 and is never drawn; a null id counts as empty in the noise
and comes first in ties; repeated rows are rows of their own, each with its own rank; an empty target
leaves only the smoothing; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch
from .spelling import LOWER, UPPER

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
ORDERS = 1
SEED = 2024
PERCENT = 10
LEAST_WORDS = 20


def position_table(texts: DataFrame, row: str = "row", orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """``row, order, bucket`` of every run of 1 to ``orders`` words of ``texts(row, text)``; a row without words has one of nulls."""
    found = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(WORD), F.lit(0))
    t = texts.select(row, F.posexplode_outer(found).alias("_pos", "_word"))
    bucket = lambda c: F.when(c.isNotNull(), F.crc32(c) % buckets).cast("int")
    if orders == 1:
        return t.select(row, F.lit(1).alias("order"), bucket(F.col("_word")).alias("bucket"))
    in_text = Window.partitionBy(row).orderBy("_pos")
    runs, run = [F.struct(F.lit(1).alias("order"), F.col("_word").alias("run"))], F.col("_word")
    for k in range(1, orders):
        t = t.withColumn(f"_next{k}", F.lead("_word", k).over(in_text))
        run = F.concat(run, F.lit(" "), F.col(f"_next{k}"))  # null past the end
        runs.append(F.struct(F.lit(k + 1).alias("order"), run.alias("run")))
    t = t.select(row, F.explode(F.array(*runs)).alias("_x")).where("_x.order = 1 or _x.run is not null")
    return t.select(row, F.col("_x.order").alias("order"), bucket(F.col("_x.run")).alias("bucket"))


def gains(documents: DataFrame, target: DataFrame, work: Scratch, orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, gain`` of all ``buckets`` buckets."""
    spark = documents.sparkSession

    def counted(df: DataFrame, name: str) -> DataFrame:
        rows = df.select(F.monotonically_increasing_id().alias("row"), "text")
        return position_table(rows, "row", orders, buckets).where("bucket is not null").groupBy("bucket").agg(F.count("*").alias(name))

    b = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    c = b.join(counted(documents, "s"), "bucket", "left").join(counted(target, "t"), "bucket", "left").na.fill(0, ["s", "t"])
    c = work.save(c, "counts")
    c = c.crossJoin(F.broadcast(c.agg(F.sum("s").alias("ns"), F.sum("t").alias("nt"))))
    num = (F.col("t") + 1).cast("double") * (F.col("ns") + buckets).cast("double")
    den = (F.col("s") + 1).cast("double") * (F.col("nt") + buckets).cast("double")
    return c.select("bucket", F.floor(1000 * F.log(num / den)).alias("gain"))


def weights(documents: DataFrame, gain: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """``row, doc_id, n_features, n_words, weight, score`` of every document; ``gain`` has one row a bucket and is broadcast."""
    docs = documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    t = position_table(docs.select(F.struct("row", "doc_id").alias("key"), "text"), "key", orders, buckets)
    t = t.join(F.broadcast(gain), "bucket", "left")
    counted = F.col("bucket").isNotNull()
    s = t.groupBy("key.row", "key.doc_id").agg(F.sum(counted.cast("long")).alias("n_features"), F.sum((counted & (F.col("order") == 1)).cast("long")).alias("n_words"), F.coalesce(F.sum("gain"), F.lit(0)).alias("g"))
    mean = F.when(F.col("n_features") > 0, F.expr("(g - pmod(g, n_features)) div n_features")).otherwise(0).cast("long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return s.select("row", "doc_id", "n_features", "n_words", mean.alias("weight"), (mean + noise).alias("score"))


def draw(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``row, rank`` of the drawn rows of a stored table ``scored``: the share of those with enough words that scores highest."""
    rows = scored.where(F.col("n_words") >= least_words).select("row", "doc_id", "score", F.shiftright("row", 33).alias("part"))
    per = rows.groupBy("score").agg(F.count("*").alias("c"))  # as many rows as there are scores: bounded, whatever the input
    every = Window.orderBy(F.desc("score"))
    per = per.select("score", (F.sum("c").over(every) - F.col("c")).alias("above"), F.sum("c").over(Window.partitionBy(F.lit(0))).alias("n"))
    per = per.select("score", "above", F.expr(f"{percent} * n div 100").alias("k")).where("above < k")
    rows = rows.join(F.broadcast(per), "score")
    inside = Window.partitionBy("score").orderBy(F.asc_nulls_first("doc_id"), "part")
    groups = rows.groupBy("score", "doc_id", "part").agg(F.count("*").alias("c"))
    groups = groups.select("score", F.col("doc_id").alias("_id"), "part", (F.sum("c").over(inside) - F.col("c")).alias("before"))
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy("score", "doc_id", "part").orderBy("row")))
    j = placed.join(groups.withColumnsRenamed({"score": "_s", "part": "_p"}), (F.col("score") == F.col("_s")) & F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("part") == F.col("_p")))
    return j.select("row", (F.col("above") + F.col("before") + F.col("place")).cast("long").alias("rank"), "k").where("rank <= k").drop("k")


def resample(documents: DataFrame, target: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS, seed: int = SEED, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every document; the rank of those not drawn is null."""
    work = Scratch(documents.sparkSession, "resample")
    gain = work.save(gains(documents, target, work, orders, buckets), "gains")
    scored = work.save(weights(documents, gain, orders, buckets, seed), "scored")
    ranks = draw(scored, percent, least_words)
    return scored.join(ranks, "row", "left").select("doc_id", "n_features", "weight", "score", "rank")
