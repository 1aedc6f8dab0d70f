"""Sharding by extendible hashing (DataFrame functions only).

A document's key is hashed to 32 bits.  The root bucket holds everything; a bucket over the byte
limit splits on one more prefix bit, and only such buckets do, so every shard is the *shortest*
prefix whose documents fit.  Sizes are summed once per directory cell (a prefix a few bits deeper
than an even split would need) and rolled up to all shorter prefixes; only documents of cells that
are still too large are summed again at more bits.  A level of at most ``BROADCAST_CELLS`` cells goes to the
documents, so texts are shuffled only to write the shards; the first level of more than about 4 TB (at
64 MB a shard) is joined with them, one further shuffle.

Defined results: a null text has 0 bytes; a null key hashes as the empty string; documents with
the same hash cannot be told apart by any bit, so a bucket of one hash value stays whole and is
flagged ``oversized`` if it is over the limit (one huge document, or a key repeated very often);
repeated rows are rows of one hash; an empty table gives an empty result; further columns are kept by
:func:`assign_shards`, those that bear the name of one of its own as ``input_<name>``.  A very long
text is never cut: it must fit a row.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT_BYTES = 64 << 20
FILE_BYTES = 8 << 20
BITS = 32
_EXTRA = 4
BROADCAST_CELLS = 1 << 20  # 20 bytes each


def _hash(key: str):
    return F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long")


OUTPUT = ("n_bytes", "shard_id", "shard_depth", "shard_bytes", "oversized")


def _kept(columns: list[str]) -> list:
    """The input's columns out of ``_row``, under names that no column of the result bears."""
    used = {c.lower() for c in columns} | set(OUTPUT)
    out = []
    for c in columns:
        name = c
        if c.lower() in OUTPUT:
            while name.lower() in used:
                name = f"input_{name}"
            used.add(name.lower())
        out.append(F.col("_row").getField(c).alias(name))
    return out


def _prefix(c, depth: int):
    return F.shiftright(c, BITS - depth)


def directory(sizes: DataFrame, limit: int) -> list[tuple[int, int, DataFrame]]:
    """``[(cell bits, most cells, cells)]`` for ``sizes(_h, _bytes)``: each cell's leaf depth and bytes.

    Later entries refine the cells of the earlier ones that have no leaf yet (``depth`` is null), so
    they have at most ``2**(new bits)`` cells for each of those.
    """
    total = sizes.agg(F.sum("_bytes")).first()[0] or 0
    low, bits = 0, min(BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + _EXTRA)
    levels: list[tuple[int, int, DataFrame]] = []
    rest, most = sizes, 1 << bits
    while True:
        cells = rest.groupBy(_prefix(F.col("_h"), bits).alias("cell")).agg(F.sum("_bytes").alias("b"), F.min("_h").alias("lo"), F.max("_h").alias("hi"))
        per = cells.select("cell", F.explode(F.sequence(F.lit(low), F.lit(bits))).alias("d"), "b", "lo", "hi")
        per = per.withColumn("p", F.expr(f"shiftright(cell, {bits} - d)"))
        sums = per.groupBy("d", "p").agg(F.sum("b").alias("bytes"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        fit = sums.where((F.col("bytes") <= limit) | (F.col("lo") == F.col("hi"))).select("d", "p", "bytes")
        leaf = per.select("cell", "d", "p").join(fit, ["d", "p"]).groupBy("cell").agg(F.min(F.struct("d", "bytes")).alias("leaf"))
        found = cells.select("cell").join(leaf, "cell", "left").select("cell", F.col("leaf.d").alias("depth"), F.col("leaf.bytes").alias("bytes"))
        levels.append((bits, most, found))
        if bits == BITS:
            return levels
        open_cells = found.where("depth is null").select("cell")
        n_open = open_cells.count()
        if not n_open:
            return levels
        rest = rest.withColumn("cell", _prefix(F.col("_h"), bits)).join(open_cells, "cell", "left_semi").drop("cell")
        more = min(8, BITS - bits)
        low, bits, most = bits + 1, bits + more, n_open << more


def assign_shards(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT_BYTES) -> DataFrame:
    """``docs`` with ``n_bytes, shard_id, shard_depth, shard_bytes, oversized``."""
    n_bytes = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), _hash(key).alias("_h"), n_bytes.alias("n_bytes"))
    levels = directory(keyed.select("_h", F.col("n_bytes").alias("_bytes")), limit)
    out = keyed.withColumns({"_d": F.lit(None).cast("int"), "_b": F.lit(None).cast("long")})
    for bits, most, cells in levels:
        found = cells.where("depth is not null").select(F.col("cell").alias("_cell"), F.col("depth").alias("_nd"), F.col("bytes").alias("_nb"))
        if most <= BROADCAST_CELLS:
            found = F.broadcast(found)
        out = out.withColumn("_cell", _prefix(F.col("_h"), bits)).join(found, "_cell", "left")
        out = out.withColumns({"_d": F.coalesce("_d", "_nd"), "_b": F.coalesce("_b", "_nb")}).drop("_cell", "_nd", "_nb")
    bits_text = F.expr(f"substring(lpad(bin(_h), {BITS}, '0'), 1, _d)")
    shard = [F.concat(F.lit("s"), bits_text).alias("shard_id"), F.col("_d").alias("shard_depth"), F.col("_b").alias("shard_bytes"), (F.col("_b") > limit).alias("oversized")]
    return out.select(*_kept(docs.columns), "n_bytes", *shard)


def write_shards(assigned: DataFrame, path: str, row: str | None = None) -> None:
    """One folder per shard, in files of about ``FILE_BYTES`` of text, so that no task holds a shard.

    ``row`` names a number of the rows that spreads a shard's rows over its files, also those that
    are equal; it is not written.  Without it, rows spread by the hash of their values.
    """
    files = F.greatest(F.lit(1), F.ceil(F.col("shard_bytes") / FILE_BYTES))
    spread = assigned.withColumn("_file", F.pmod(F.xxhash64(*([row] if row else assigned.columns)), files))
    out = spread.repartition("shard_id", "_file").sortWithinPartitions("shard_id").drop("_file", *([row] if row else []))
    out.write.partitionBy("shard_id").parquet(path)


def read_shards(spark, path: str, schema) -> DataFrame:
    """The rows of :func:`write_shards`; ``schema`` has all columns that were written."""
    return spark.read.schema(schema).parquet(path)
