"""Files to tables and back: Markdown folders, manifests, JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

PATTERNS = "*.{md,markdown,rst,txt}"

QUEUE = "id string, document_id string, source string, span_id string, kind string, heading_path array<string>, text string, anchor_terms array<string>, suggested_label string, review_status string"
DECISION = "request_id string, label string, confidence double, rationale string, judge_model string, rubric_id string, rubric_version string, source_hash string, pass_id string"
PAIR = "intent_id string, query string, span_id string, text string, label string, score double, metadata map<string,string>"
SCORE = "id string, key struct<version:string,model_name:string,query_sha256:string,document_sha256:string>, score double"


def _name() -> Column:
    """The file's name, whose other characters the metadata has escaped."""
    return F.url_decode(F.regexp_replace(F.col("_metadata.file_name"), r"\+", "%2B"))


def documents_in(spark: SparkSession, path: str) -> DataFrame:
    """document_id, text, source of the text files under a path, ids by name with a number from the second of a name on."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", PATTERNS).text(path, wholetext=True)
    files = files.select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("source"), _name().alias("name"))
    slug = F.regexp_replace(F.lower(F.regexp_replace("name", r"\.[^.]*$", "")), "[^a-z0-9]+", "_")
    number = F.row_number().over(W.partitionBy("slug").orderBy("source"))
    return files.withColumn("slug", slug).withColumn("n", number).select(F.when(F.col("n") == 1, F.col("slug")).otherwise(F.concat_ws("_", "slug", "n")).alias("document_id"), "text", "source")


def manifest_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The documents that a folder's manifest.json names, with their addresses as source."""
    named = spark.read.option("multiLine", True).json(f"{folder}/manifest.json").select(F.explode("sources").alias("s")).select(F.col("s.id").alias("document_id"), F.col("s.filename").alias("name"), F.col("s.raw_url").alias("source"))
    files = spark.read.option("pathGlobFilter", PATTERNS).text(folder, wholetext=True).select(F.col("value").alias("text"), _name().alias("name"))
    return named.join(files, "name").select("document_id", "text", "source")


def json_lines(spark: SparkSession, path: str, schema: str, required: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Rows that fit the schema, and the lines that don't (broken, or without a required field), each with its reason."""
    fields = T.StructType.fromDDL(schema)
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", T.StructType([*fields.fields, T.StructField("_broken", T.StringType())]), {"columnNameOfCorruptRecord": "_broken", "mode": "PERMISSIVE"}).alias("r"))
    reason = F.when(F.col("r._broken").isNotNull() | F.col("r").isNull(), F.lit("broken"))
    for name in required:
        reason = reason.when(F.col(f"r.{name}").isNull(), F.lit(f"no {name}"))
    judged = parsed.withColumn("reason", reason)
    return judged.filter("reason is null").select(*[F.col(f"r.{n}").alias(n) for n in fields.fieldNames()]), judged.filter("reason is not null").select("value", "reason")


def write_json_lines(df: DataFrame, path: str) -> None:
    """JSON lines with their keys in order."""
    df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value")).write.text(path)


def latest_scores(log: DataFrame, order: str) -> DataFrame:
    """The last write of each key."""
    return log.groupBy("id").agg(F.max_by("score", order).alias("score"))


def append_scores(known: DataFrame, new: DataFrame, path: str) -> None:
    """Appends the scores that are new or changed."""
    fresh = new.join(known.select("id", F.col("score").alias("old")), "id", "left").filter(~F.col("score").eqNullSafe(F.col("old"))).drop("old")
    fresh.select(F.to_json(F.struct(*sorted(fresh.columns))).alias("value")).write.mode("append").text(path)


FACET = "struct<name:string,phrases:array<string>,required:boolean,weight:double>"
CASE = (
    "id string, split string, document_id string, label string, description string, positive_examples array<string>, negative_examples array<string>, "
    f"required_facets array<{FACET}>, excluded_facets array<{FACET}>, preferred_span_kinds array<string>, support_span_ids array<string>, near_miss_span_ids array<string>, "
    "contradiction_span_ids array<string>, insufficient_context_span_ids array<string>, forbidden_span_ids array<string>, expect_abstain boolean, min_support_score double, near_miss_ratio double, "
    "curation struct<reviewed:boolean,source:string,difficulty:string,phenomena:array<string>,notes:array<string>>"
)
REQUEST = "id string, case_id string, document_id string, span_id string, intent_label string, intent_description string, candidate_text string, heading_path array<string>, expected_label string, source_hash string"


def queue_items(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A curation queue's items, and the lines that are none."""
    return json_lines(spark, path, QUEUE, ("document_id", "span_id", "kind", "text"))


def reviewed_cases(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Reviewed cases with their defaults, and the lines that are none."""
    good, bad = json_lines(spark, path, CASE, ("id", "document_id", "label", "description"))
    none = F.array().cast("array<string>")
    lists = [f.name for f in good.schema.fields if f.dataType == T.ArrayType(T.StringType())]
    filled = good.withColumns({n: F.coalesce(n, none) for n in lists} | {"expect_abstain": F.coalesce("expect_abstain", F.lit(False)), "min_support_score": F.coalesce("min_support_score", F.lit(0.55)), "near_miss_ratio": F.coalesce("near_miss_ratio", F.lit(0.82))})
    return filled, bad


def judge_requests(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return json_lines(spark, path, REQUEST, ("id", "case_id", "span_id", "source_hash"))


def judge_responses(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return json_lines(spark, path, "request_id string, label string, confidence double, rationale string", ("request_id", "label", "confidence", "rationale"))


def judge_decisions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return json_lines(spark, path, DECISION, ("request_id", "label", "confidence", "judge_model", "pass_id", "source_hash"))


def training_examples(spark: SparkSession, path: str, scores: dict[str, float]) -> tuple[DataFrame, DataFrame]:
    """query, text, score of a file of training pairs by the labels' scores; labels without a score are told with the broken lines."""
    good, bad = json_lines(spark, path, PAIR, ("query", "text", "label"))
    known = F.create_map(*[F.lit(x) for kv in scores.items() for x in kv])
    scored = good.withColumn("score", known[F.col("label")])
    lost = scored.filter("score is null").select(F.to_json(F.struct("query", "label")).alias("value"), F.lit("no score for the label").alias("reason"))
    return scored.filter("score is not null").select("query", "text", "score"), bad.unionByName(lost)


def source_catalog(spark: SparkSession, rows: list[tuple[str, str, str, str, str]]) -> DataFrame:
    """source_id, repository, raw_url, license_name, focus: the pages that may be fetched, each id once."""
    if len({r[0] for r in rows}) < len(rows):
        raise ValueError("a source id is repeated")
    return spark.createDataFrame(rows, "source_id string, repository string, raw_url string, license_name string, focus string")


def fetched(sources: DataFrame, texts: DataFrame) -> DataFrame:
    """Sources with what was fetched for them (raw_url, text): hash, bytes and lines. Fetching is the caller's, so that it can be anything."""
    joined = sources.join(texts, "raw_url")
    lines = F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n")) - F.when(F.col("text").endswith("\n"), 1).otherwise(0))
    return joined.select("*", F.concat("source_id", F.lit(".md")).alias("filename"), F.sha2("text", 256).alias("sha256"), F.octet_length(F.encode("text", "UTF-8")).alias("byte_count"), lines.alias("line_count"))


def write_fetched(found: DataFrame, folder: str) -> int:
    """A folder of one text file a source and its manifest.json, which manifest_documents() reads; the number of sources. Files are written where the rows are."""
    import json
    import os

    os.makedirs(folder, exist_ok=True)

    def write(rows) -> None:
        for r in rows:
            with open(os.path.join(folder, r.filename), "w", encoding="utf-8", newline="") as f:
                f.write(r.text)

    found.select("filename", "text").foreachPartition(write)
    names = {"source_id": "id"}
    listed = [{names.get(k, k): v for k, v in r.asDict().items()} for r in found.drop("text").orderBy("source_id").collect()]
    with open(os.path.join(folder, "manifest.json"), "w", encoding="utf-8") as f:
        json.dump({"source_count": len(listed), "sources": listed}, f, sort_keys=True, indent=2)
    return len(listed)


def markdown_report(measures: DataFrame, columns: list[str], title: str) -> str:
    """A small table of measures (a row an experiment) as Markdown."""
    rows = measures.select(*columns).collect()
    cell = lambda v: f"{v:.4f}" if isinstance(v, float) else str(v)
    lines = [f"# {title}", "", "| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(cell, r)) + " |" for r in rows)]) + "\n"
