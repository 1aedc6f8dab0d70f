"""The training-data pipeline over ``documents``: language, quality, near-dedup, decontamination, packing.

``STAGES`` lists ``(name, function)``; each function takes ``(spark, docs, sf_dir)`` and returns
the documents it keeps with the columns of ``documents``, the last one the packed pieces.
Between stages the rows are written as Parquet and read again, which cuts lineage and lets a lost
executor cost no more than the stage at hand.

* Language: a document goes if no language can be told (null text, or no letter in it).
* Quality: a document goes if its score is under the threshold (``predicted`` is 0).
* Near-dedup: of each component the document of least id stays, of several rows of that id the one
  of least text (nulls first); documents without words and rows of a null id stay.
* Decontamination: a document that contains a benchmark item goes.
* Packing: all pieces of all remaining documents, with sequence and offset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import decontaminate, language, near_dup, packing, quality
from corpusloom.llm.common import Scratch, free_name, table
from corpusloom.llm.encode import tokenizer_path

ORACLE_SQL = None  # learned models and packing are beyond SQL; tests/llm compares with plain Python


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lang, score = (free_name(docs.columns, x) for x in ("lang_pred", "lang_score"))
    scored = language.predict(docs, language.fit(docs), docs.columns, lang, score)
    return scored.where(F.col(lang) != "und").select(*docs.columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    space = quality.fit(docs, table(spark, sf_dir, "labels"))
    score = free_name(docs.columns, "quality_score")
    scored = quality.predict(docs, space, docs.columns, score)
    return scored.where(F.col(score) >= quality.THRESHOLD).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = near_dup.near_duplicates(docs)
    copies = found.where("doc_id is not null and not kept").select("doc_id").distinct()
    kept = docs.join(copies, "doc_id", "left_anti")
    repeated = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1").select("doc_id")
    row = F.struct("text", *(c for c in docs.columns if c not in ("doc_id", "text")))
    once = kept.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(row).alias("_row")).select("doc_id", "_row.*")
    return kept.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(once.select(*docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    work = Scratch(spark, "pack")
    return packing.pack(work.save(packing.cut(docs, tokenizer_path()), "pieces"))


STAGES = [
    ("language", identify_language),
    ("quality", keep_quality),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("pack", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        docs = work.save(stage(spark, docs, sf_dir), f"{n}_{name}")
    return docs
