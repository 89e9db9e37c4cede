"""Runs the catalogued plans on Spark."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.operators import experiments, keyword, lexical, nearest, parsing
from attestor.plans.catalog import PLANS, TOP
from attestor.plans.dialect import Spark
from attestor.sources.tables import exists, written

#: Stages that several queries read, by session, folder, stage, and the state of the files behind it: (path, table).
_STAGES: dict[tuple, tuple[str, DataFrame]] = {}


def _state(spark: SparkSession, paths: list[str]) -> tuple:
    """Names, sizes and times of the files."""
    hadoop, jvm = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm
    out = []
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(hadoop)
        out += sorted((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(p))
    return tuple(out)


def stage(spark: SparkSession, sf_dir: str, name: str, tables: list[str], make: Callable[[], DataFrame]) -> DataFrame:
    """A table that is written once a session, as long as the tables it comes from don't change."""
    key = (spark.sparkContext.applicationId, sf_dir, name, _state(spark, [f"{sf_dir}/{t}.parquet" for t in tables]))
    if key not in _STAGES or not exists(spark, _STAGES[key][0]):
        paths: list[str] = []
        df = written(make(), name, paths)
        _STAGES[key] = (paths[0], df)
    return _STAGES[key][1]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows that take long, over all cores: a small table comes in fewer parts than there are cores, and is dealt out again."""
    parts = 3 * df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= parts else df.repartition(parts)


def query(views: dict[str, DataFrame], text: str) -> DataFrame:
    """SQL over the views, under names that no other query and no user has."""
    return experiments.sql(views, text)


def document_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(spark, sf_dir, "spans", ["documents"], lambda: parsed(spread(table(spark, sf_dir, "documents"))))


def parsed(docs: DataFrame) -> DataFrame:
    return parsing.parse(docs.select(F.col("doc_id").cast("string").alias("document_id"), "text"))


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """claim_id, claim, doc_id, document_id: the documents that hold a claim's text."""
    docs, claims = spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark")
    return stage(spark, sf_dir, "cases", ["documents", "benchmark"], lambda: lexical.holding(docs, claims))


def held_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each claim beside the spans of the documents that hold it."""
    docs, claims = spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark")
    return stage(spark, sf_dir, "held", ["documents", "benchmark"], lambda: lexical.held_spans(docs, claims))


def top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each claim's first 30 spans by keywords, with labels; spans are parsed on the way."""

    def make() -> DataFrame:
        docs = spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").cast("string").alias("document_id"), "text")
        claims = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("claim_id"), F.col("text").alias("claim"))
        met = keyword.first_in_documents(docs, claims)
        return query({"met": met}, f"WITH {TOP} SELECT * FROM top")

    return stage(spark, sf_dir, "top", ["documents", "benchmark"], make)


def spans_at(spark: SparkSession, sf_dir: str, places: DataFrame) -> DataFrame:
    """places (document_id, span_id, and others; a bounded number for each claim) with the spans' kind, text and heading_path: their documents are parsed again."""
    docs = table(spark, sf_dir, "documents").withColumn("document_id", F.col("doc_id").cast("string"))
    wanted = docs.join(F.broadcast(places.select("document_id").distinct()), "document_id", "left_semi")
    spans = parsed(spread(wanted)).select("span_id", "kind", "text", "heading_path")
    return spans.join(F.broadcast(places), "span_id")


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans that hold a claim, of documents that do."""
    return held_spans(spark, sf_dir).filter("gold").select("claim_id", "span_id").distinct()


VIEWS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"spans": document_spans, "cases": cases, "top": top, "gold": gold}


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    make, tables = PLANS[name]
    text = make(Spark())
    wanted = [v for t in tables for v in (("cases", "top", "gold") if t == "ranked" else (t,))]
    # Stages are made where the text reads them.
    views = {v: VIEWS[v](spark, sf_dir) if v in VIEWS else table(spark, sf_dir, v) for v in wanted if v not in VIEWS or re.search(rf"\b{v}\b", text)}
    return query(views, text)


def soft(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sim_soft: texts are turned into bags once, where the relational text counts each item of an array over the whole array."""
    found = lexical.soft(spread(held_spans(spark, sf_dir).select("claim_id", "span_id", "claim", "text")))
    return found.select("claim_id", "span_id", F.round("similarity", 6).alias("similarity"), F.round("exact_phrase", 6).alias("exact_phrase"))


def bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mdl_bm25: all of it lies inside a document, so nothing is shuffled."""
    found = lexical.bm25(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
    return found.withColumn("score", F.round("score", 6))


def embedding_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mdl_embedding_topk: all pairs as products of matrices; vectors that are null, empty, of several lengths or without direction go the relational way."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    if not nearest.regular(vectors):
        return run("mdl_embedding_topk", spark, sf_dir)
    return nearest.nearest(spread(vectors), vectors.filter("vec_id % 20 = 0"))


QUERIES = {name: partial(run, name) for name in PLANS} | {"sim_soft": soft, "mdl_bm25": bm25, "mdl_embedding_topk": embedding_topk}
