"""A corpus from raw documents to a training mix, in five stages over whole tables.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet in the shared folder and
rereads as the next one's docs. All but the last return the columns of documents.

quality          documents that the classifier rejects go
line_dedup       lines that align with an earlier document's go; a document that loses all its text goes
near_duplicates  of each linked group one document stays: that of the least id, and of rows that share it, of the least
                 text hash; of rows that repeat id and text, one
decontamination  rows with any word run of a benchmark item go
mix              a manifest: for each document its words, and how many of them the mix takes

Null texts and empty texts are judged like any other; null ids rank last, and each row is judged by its own text; ties
are rows that repeat id and text; columns beside those of documents are dropped; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.llm import decontam, line_dedup, mix, ngram_join, quality_cnn
from attestor.sources import tables

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Rows that are told by id and text hash are broadcast up to this many.
BROADCAST_ROWS = 1_000_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_cnn.quality(docs, labels, carry=COLUMNS).filter("predicted = 1").select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    got = line_dedup.dedup_lines(docs, carry=("lang", "source", "n_chars"))
    left = (F.col("n_removed") == 0) | (F.trim("text") != "")
    length = F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))
    return got.filter(left).withColumn("n_chars", length).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = ngram_join.similar(docs.select("doc_id", "text")).filter("component is not null")
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    first = found.groupBy("component").agg(F.min(rank).alias("first"))
    gone = found.join(first, "component").filter(rank != F.col("first")).select("doc_id", "text_hash").distinct()
    twice = found.groupBy("doc_id", "text_hash").count().filter("count > 1").select("doc_id", "text_hash")
    told = tables.written(gone.withColumn("gone", F.lit(True)).unionByName(twice.join(gone, ["doc_id", "text_hash"], "left_anti").withColumn("gone", F.lit(False))), "pipeline-near")
    some = told.toDF("gone_id", "gone_hash", "gone")
    some = F.broadcast(some) if told.count() <= BROADCAST_ROWS else some
    hashed = docs.select(*COLUMNS).withColumn("text_hash", F.xxhash64("text"))
    marked = hashed.join(some, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("text_hash") == F.col("gone_hash")), "left")
    kept = marked.filter("gone is null").select(*COLUMNS)
    if told.filter("not gone").isEmpty():
        return kept
    return kept.unionByName(marked.filter("not gone").dropDuplicates(["doc_id", "text_hash"]).select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontam.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), least_items=1, carry=COLUMNS[1:])
    return found.filter("not contaminated").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix.mix(docs, carry=("source", "lang"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("line_dedup", dedup_lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("mix", mix_sources),
]

#: The classifier and the alignment are beyond SQL; tests/llm has brute-force versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, paths = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        docs = tables.written(stage(spark, docs, sf_dir), f"pipeline-{name}", paths)
        for path in paths[:-1]:
            tables.remove(spark, path)
        del paths[:-1]
    return docs
