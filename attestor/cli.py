"""Commands over files: python -m attestor.cli COMMAND ..."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.operators import claims, curation, experiments, parsing, typed
from attestor.sources import files


def spans_in(spark: SparkSession, path: str) -> DataFrame:
    """Spans of a file, a folder, or a folder with a manifest."""
    import os

    named = os.path.exists(os.path.join(path, "manifest.json"))
    docs = files.manifest_documents(spark, path) if named else files.documents_in(spark, path)
    spans = parsing.parse(docs)
    if spans.isEmpty():
        raise SystemExit(f"no text found in {path}")
    return spans


def candidates(spans: DataFrame, claim: claims.Claim, limit: int) -> DataFrame:
    pairs = spans.withColumn("claim_id", F.lit(claim.claim_id)).withColumn("claim", F.lit(claim.label))
    ranked = experiments.in_order(typed.rank_pairs(pairs, claims={claim.claim_id: claim}), ["claim_id", "document_id"])
    return ranked.filter(F.col("rank") <= (limit or 20))


def extract(spark: SparkSession, a: argparse.Namespace) -> dict:
    claim = claims.compile_claim(a.claim) if a.claim else claims.described_claim(a.label, a.description)
    found = candidates(spans_in(spark, a.document), claim, a.limit).cache()
    chosen = experiments.matches(found, ["claim_id", "document_id"], a.matches)
    keep = ["document_id", "span_id", "kind", "text", "label", "score", "reasons"]
    best = [r.asDict() for r in chosen.orderBy("document_id", "place").select(*keep).collect()]
    return {"claim": claim.label, "abstained": not best, "matches": best, "candidates": [r.asDict() for r in found.orderBy("document_id", "rank").select(*keep).collect()]}


def explain(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Every candidate of a reviewed case, with features, gold kinds and whether it was chosen."""
    cases, _ = files.reviewed_cases(spark, a.cases)
    case = cases.filter(F.col("id") == a.case).first()
    if case is None:
        raise SystemExit(f"no case {a.case}")
    spans = spans_in(spark, a.documents).filter(F.col("document_id") == case.document_id)
    found = candidates(spans, claims.compile_claim(case.label, case.id, tuple(case.positive_examples), tuple(case.negative_examples), case.min_support_score), a.limit).cache()
    won = {r.span_id for r in experiments.matches(found, ["claim_id", "document_id"]).collect()}
    kinds = {k: set(case[f"{k}_span_ids"]) for k in ("support", "near_miss", "contradiction", "insufficient_context", "forbidden")}
    rows = found.orderBy("rank").select("span_id", "rank", "label", "score", "reasons", "features", "text").collect()
    return {"case": case.id, "candidates": [r.asDict() | {"gold": sorted(k for k, ids in kinds.items() if r.span_id in ids), "selected": r.span_id in won} for r in rows]}


def queue(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Sentences, bullets and table rows of 30 to 500 characters, each text once, as items to review."""
    spans = spans_in(spark, a.documents).filter("kind in ('sentence', 'bullet', 'table_row', 'paragraph') and length(text) between 30 and 500")
    same = F.replace(F.trim(F.regexp_replace(F.lower("text"), r"\s+", " ")), F.lit("ß"), F.lit("ss"))
    words = F.slice(F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda w: F.length(w) >= 3)), 1, 8)
    first = spans.withColumn("same", same).groupBy("same").agg(F.min_by(F.struct("document_id", "span_id", "kind", "heading_path", "text"), F.struct("document_id", "ordinal")).alias("s")).select("s.*")
    items = first.withColumn("anchor_terms", words).filter(F.size("anchor_terms") > 0).select(
        F.concat_ws(":", "document_id", "span_id").alias("id"), "document_id", F.lit(None).cast("string").alias("source"), "span_id", "kind", "heading_path", "text", "anchor_terms",
        F.array_join(F.concat("heading_path", F.slice("anchor_terms", 1, 4)), " ").alias("suggested_label"), F.lit("unreviewed").alias("review_status"),
    )
    files.write_json_lines(items, a.out)
    return {"items": spark.read.text(a.out).count()}


def audit_queue(spark: SparkSession, a: argparse.Namespace) -> dict:
    items, bad = files.queue_items(spark, a.queue)
    sizes = items.agg(F.count("*").alias("items"), F.min(F.length("text")).alias("shortest"), F.max(F.length("text")).alias("longest"), F.round(F.avg(F.length("text")), 2).alias("mean"), (F.count("*") - F.countDistinct(F.lower("text"))).alias("surplus")).first().asDict()
    return sizes | {"kinds": {r.kind: r["count"] for r in items.groupBy("kind").count().collect()}, "broken": bad.count()}


def templates(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Cases to review; with --split, by splits of their documents."""
    items, _ = files.queue_items(spark, a.queue)
    if a.split:
        items = items.join(curation.split_documents(items.select("document_id").distinct()), "document_id")
    made = curation.case_templates(items)
    files.write_json_lines(made, a.out)
    return {"cases": made.count(), "splits": {r.split: r["count"] for r in made.groupBy("split").count().collect()}}


def validate(spark: SparkSession, a: argparse.Namespace) -> dict:
    cases, bad = files.reviewed_cases(spark, a.cases)
    found = curation.violations(cases, spans_in(spark, a.documents))
    splits = {r.split: r["count"] for r in cases.groupBy("split").count().collect()}
    return {"cases": cases.count(), "splits": splits, "missing_splits": sorted(set(curation.RATIOS) - set(splits)), "broken": [r.reason for r in bad.collect()], "violations": [r.asDict() for r in found.collect()]}


def _gold(cases: DataFrame) -> DataFrame:
    kinds = ("support", "near_miss", "contradiction", "insufficient_context", "forbidden")
    each = [cases.select(F.col("id").alias("case_id"), F.explode(f"{k}_span_ids").alias("span_id"), F.lit(k).alias("gold")) for k in kinds]
    out = each[0]
    for e in each[1:]:
        out = out.unionByName(e)
    return out


def judge_requests(spark: SparkSession, a: argparse.Namespace) -> dict:
    cases, _ = files.reviewed_cases(spark, a.cases)
    made = curation.judge_requests(cases.withColumnRenamed("id", "case_id").select("case_id", "label", "description"), spans_in(spark, a.documents).select("span_id", "document_id", "text", "heading_path"), _gold(cases))
    files.write_json_lines(made.join(curation.prompts(made), "id"), a.out)
    return {"requests": made.count()}


def judge_decisions(spark: SparkSession, a: argparse.Namespace) -> dict:
    responses, broken = files.judge_responses(spark, a.responses)
    good, bad = curation.decisions(responses, files.judge_requests(spark, a.requests)[0], a.judge, a.pass_id)
    files.write_json_lines(good, a.out)
    return {"decisions": good.count(), "refused": [r.asDict() for r in bad.collect()], "broken": broken.count()}


def judge_audit(spark: SparkSession, a: argparse.Namespace) -> dict:
    report = curation.agreement(files.judge_decisions(spark, a.decisions)[0], a.passes)
    sums = report.agg(F.count("*").alias("requests"), F.count_if("unanimous").alias("unanimous"), F.count_if(~F.col("enough")).alias("too_few_passes")).first().asDict()
    return sums | {"agreements": [r.asDict() for r in report.orderBy("request_id").collect()]}


def rubric(spark: SparkSession, a: argparse.Namespace) -> dict:
    return {"criteria": curation.RUBRIC, "labels": list(curation.LABELS)}


def training(spark: SparkSession, a: argparse.Namespace) -> dict:
    cases, _ = files.reviewed_cases(spark, a.cases)
    spans = spans_in(spark, a.documents)
    pairs = spans.join(cases.select("document_id", F.col("id").alias("claim_id"), F.col("label").alias("claim")), "document_id")
    ranked = experiments.in_order(typed.rank_pairs(pairs), ["claim_id"]).select(F.col("claim_id").alias("case_id"), "span_id", "rank")
    asked = cases.select(F.col("id").alias("case_id"), F.concat_ws("\n", "label", "description", F.array_join("positive_examples", "\n")).alias("query"))
    made = curation.training_pairs(asked, spans, _gold(cases), ranked, a.negatives)
    files.write_json_lines(made, a.out)
    return {"pairs": made.count()}


#: Command: function, what it needs (positional), and options with their defaults.
COMMANDS = {
    "extract": (extract, ["document"], {"claim": None, "label": "claim", "description": "claim", "limit": 20, "matches": 3}),
    "explain-reviewed-case": (explain, ["cases", "documents", "case"], {"limit": 50}),
    "prepare-document-curation-queue": (queue, ["documents", "out"], {}), "audit-curation-queue": (audit_queue, ["queue"], {}),
    "prepare-reviewed-case-template": (templates, ["queue", "out"], {"split": ""}), "prepare-reviewed-series-template": (templates, ["queue", "out"], {"split": "documents"}),
    "validate-reviewed-cases": (validate, ["cases", "documents"], {}), "validate-reviewed-series": (validate, ["cases", "documents"], {}),
    "model-judge-rubric": (rubric, [], {}), "export-model-judge-requests": (judge_requests, ["cases", "documents", "out"], {}),
    "convert-model-judge-responses": (judge_decisions, ["responses", "requests", "out"], {"judge": "judge", "pass_id": "1"}), "audit-model-judge-decisions": (judge_audit, ["decisions"], {"passes": 2}),
    "export-reviewed-training-jsonl": (training, ["cases", "documents", "out"], {"negatives": 3}),
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="attestor")
    commands = top.add_subparsers(dest="command", required=True)
    for name, (_, needed, options) in COMMANDS.items():
        one = commands.add_parser(name)
        for n in needed:
            one.add_argument(n)
        for n, default in options.items():
            one.add_argument(f"--{n.replace('_', '-')}", default=default, type=int if isinstance(default, int) else str)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("attestor").getOrCreate()
    out = COMMANDS[a.command][0](spark, a)
    json.dump(out, sys.stdout, sort_keys=True, indent=2, ensure_ascii=False)
    print()
    return out


if __name__ == "__main__":
    main()
