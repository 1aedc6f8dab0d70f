"""Token-id output: documents in ascending id order, as Re-Pair shards (see :mod:`.repair`).

Documents are dealt by id range; each task encodes its range in order and emits a shard whenever
``SHARD_TOKENS`` ids have gathered.  Shards are rows of a Parquet table ``(part, seq, n_docs,
n_tokens, payload)``, so that Spark's committer makes a retried task harmless; ``(part, seq)`` is
the documents' order.

Defined results: a null text is empty and gives the end id alone; documents with equal ids are
ordered by the first ``TIE_CHARS`` characters of their texts and then by their place in the input, so
that one id on very many rows is dealt over many tasks; an empty table gives an empty table;
further columns are ignored.  A very long text is encoded in spans; its ids must fit a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc32_ids, pieces
from .encode import encoder
from .repair import SHARD_TOKENS, Shard, compress

END = 1
PART_BYTES = 32 << 20
TIE_CHARS = 32
_SHARDS = "part int, seq int, n_docs long, n_tokens long, payload binary"


def _with_end(ids: np.ndarray, bounds: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """``end`` after each document's ids."""
    n = len(bounds) - 1
    out = np.full(len(ids) + n, end, np.uint32)
    keep = np.ones(len(out), bool)
    keep[bounds[1:] + np.arange(n)] = False
    out[keep] = ids
    return out, bounds + np.arange(n + 1)


def n_parts(df: DataFrame, part_bytes: int = PART_BYTES) -> int:
    """Partitions for a full pass over ``df``, from the plan's size estimate."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(1_000_000, -(-size // part_bytes)))


def encode_shards(documents: DataFrame, tokenizer: str, end: int = END, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """The shard table of all documents."""

    def task(batches):
        part, seq = TaskContext.get().partitionId(), 0
        doc_ids, ids, bounds, held = [], [], [np.zeros(1, np.int64)], 0
        enc = encoder(tokenizer)

        def flush():
            nonlocal doc_ids, ids, bounds, held, seq
            x, b = np.concatenate(ids), np.concatenate(bounds)
            row = [part, seq, len(b) - 1, len(x), compress(np.concatenate(doc_ids), x, b)]
            doc_ids, ids, bounds, held, seq = [], [], [np.zeros(1, np.int64)], 0, seq + 1
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names=["part", "seq", "n_docs", "n_tokens", "payload"])

        for batch in batches:
            for piece in pieces(batch, "text", 2_000_000):
                x, b = _with_end(*enc.encode(piece.column(1).to_pylist()), end)
                docs, at = piece.column(0).to_numpy(zero_copy_only=False), 0
                while at < len(docs):  # as many documents as the shard still takes, one at least
                    stop = max(at + 1, int(np.searchsorted(b, b[at] + shard_tokens - held, side="right")) - 1)
                    doc_ids.append(docs[at:stop])
                    ids.append(x[b[at] : b[stop]])
                    bounds.append(b[at + 1 : stop + 1] - b[at] + held)
                    held += int(b[stop] - b[at])
                    at = stop
                    if held >= shard_tokens or at < len(docs):
                        yield flush()
        if doc_ids:
            yield flush()

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keyed = docs.withColumns({"_tie": F.substring("text", 1, TIE_CHARS), "_row": F.monotonically_increasing_id()})
    order = [F.col("doc_id").asc_nulls_first(), F.col("_tie").asc_nulls_first(), F.col("_row")]
    keyed = keyed.repartitionByRange(n_parts(docs), *order).sortWithinPartitions(*order)
    return keyed.select("doc_id", "text").mapInArrow(task, _SHARDS)


def read_back(shards: DataFrame) -> DataFrame:
    """Per document, decoded from the shards: ``doc_id, start, n_tokens, ids_crc32``."""

    def task(batches):
        for batch in batches:
            for part, seq, payload in zip(*(batch.column(c).to_pylist() for c in range(3))):
                s = Shard(payload)
                x, b = s.all_ids(), s.token_bounds
                crc = [crc32_ids(x[i:j]) for i, j in zip(b[:-1], b[1:])]
                n = len(crc)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, seq, np.int32)), pa.array(s.doc_ids), pa.array(b[:-1]), pa.array(np.diff(b)), pa.array(crc, pa.int64())], names=["part", "seq", "doc_id", "within", "n_tokens", "ids_crc32"])

    docs = shards.select("part", "seq", "payload").mapInArrow(task, "part int, seq int, doc_id long, within long, n_tokens long, ids_crc32 long")
    line = shards.select(F.col("part").alias("p"), F.col("seq").alias("s"), "n_tokens")
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    parts = line.groupBy("p").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select(F.col("p").alias("q"), F.coalesce(F.sum("n").over(before(F.lit(0)).orderBy("p")), F.lit(0)).alias("at_part"))
    line = line.withColumn("at", F.coalesce(F.sum("n_tokens").over(before("p").orderBy("s")), F.lit(0))).join(parts, F.col("p") == F.col("q"))
    line = line.select("p", "s", (F.col("at") + F.col("at_part")).alias("base"))
    return docs.join(line, (docs.part == line.p) & (docs.seq == line.s)).select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
