"""Splits, templates, judge requests and responses, training pairs: the relational part of curating cases."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RATIOS = {"train": 0.7, "dev": 0.15, "test": 0.15}
LABELS = ("supports", "near_miss", "contradicts", "insufficient_context", "reject")
#: By gold kind, the label that a judge should give, the first of a span's kinds deciding.
EXPECTED = {"support": "supports", "near_miss": "near_miss", "contradiction": "contradicts", "insufficient_context": "insufficient_context", "forbidden": "reject"}
SCORES = {"supports": 1.0, "near_miss": 0.35, "insufficient_context": 0.25, "contradicts": 0.0, "reject": 0.0}


def split_sizes(n: int, ratios: dict[str, float] | None = None) -> dict[str, int]:
    """Whole documents by ratio: floors, then one more for the largest remainders, and at least one each, from the largest."""
    ratios = ratios or RATIOS
    if any(r <= 0 for r in ratios.values()) or abs(sum(ratios.values()) - 1) > 1e-6:
        raise ValueError("the ratios must be positive and sum to 1")
    if n < len(ratios):
        raise ValueError("there are fewer documents than splits")
    sizes = {s: int(r * n) for s, r in ratios.items()}
    for s in sorted(ratios, key=lambda s: sizes[s] - ratios[s] * n)[: n - sum(sizes.values())]:
        sizes[s] += 1
    for s in ratios:
        if not sizes[s]:
            sizes[max(sizes, key=sizes.__getitem__)] -= 1
            sizes[s] = 1
    return sizes


def split_documents(docs: DataFrame, ratios: dict[str, float] | None = None, seed: str = "13", bucket_rows: int = 100_000) -> DataFrame:
    """docs (document_id, each once) with `split`: in the order of a seeded hash, cut at the splits' sizes.

    Ranks come from the sizes of hash buckets and a rank inside each, so no task orders all documents.
    """
    n = docs.count()
    bits = min(24, max(0, math.ceil(math.log2(max(n, 1) / bucket_rows)))) if n else 0
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("document_id").cast("string")), 256)
    keyed = docs.withColumn("_key", key).withColumn("_bucket", F.shiftright(F.conv(F.substring("_key", 1, 6), 16, 10).cast("int"), 24 - bits))
    sizes = sorted((r._bucket, r.n) for r in keyed.groupBy("_bucket").agg(F.count("*").alias("n")).collect())
    before, at = [], 0
    for b, k in sizes:
        before.append((b, at))
        at += k
    offsets = docs.sparkSession.createDataFrame(before or [(0, 0)], "_bucket int, _before long")
    rank = F.row_number().over(W.partitionBy("_bucket").orderBy("_key", "document_id")) + F.col("_before")
    split, end = None, 0
    for s, k in split_sizes(n, ratios).items() if n else ():
        end += k
        split = F.when(F.col("_rank") <= end, s) if split is None else split.when(F.col("_rank") <= end, s)
    ranked = keyed.join(F.broadcast(offsets), "_bucket").withColumn("_rank", rank)
    return ranked.withColumn("split", F.lit(None).cast("string") if split is None else split).drop("_key", "_bucket", "_before", "_rank")


def case_templates(queue: DataFrame, split: str = "train") -> DataFrame:
    """A case to be reviewed for each queue item (document_id, span_id, suggested_label, anchor_terms)."""
    none = F.array().cast("array<string>")
    facet = F.struct(F.lit("review_required_anchor").alias("name"), F.col("anchor_terms").alias("phrases"))
    return queue.select(
        F.concat_ws(".", "document_id", "span_id", F.lit("reviewed")).alias("id"), (F.col("split") if "split" in queue.columns else F.lit(split)).alias("split"), "document_id",
        F.col("suggested_label").alias("label"), F.concat(F.lit("Find evidence for: "), "suggested_label").alias("description"), F.array("suggested_label").alias("positive_examples"),
        F.array(facet).alias("required_facets"), F.array("span_id").alias("support_span_ids"), none.alias("near_miss_span_ids"), none.alias("contradiction_span_ids"),
        none.alias("insufficient_context_span_ids"), none.alias("forbidden_span_ids"), F.lit(False).alias("expect_abstain"),
        F.struct(F.lit(False).alias("reviewed"), F.lit("queue_template").alias("source"), F.lit("unreviewed").alias("difficulty"), F.array(F.lit("direct_support")).alias("phenomena"), F.array(F.lit("From the queue, not reviewed yet.")).alias("notes")).alias("curation"),
    )


def violations(cases: DataFrame, spans: DataFrame, need_reviewed: bool = True) -> DataFrame:
    """What forbids reviewed cases (with the columns of case_templates): id and rule, a row each."""
    kinds = [f"{k}_span_ids" for k in ("support", "near_miss", "contradiction", "insufficient_context", "forbidden")]
    named = cases.select("id", "document_id", F.explode(F.flatten(F.array(*[F.coalesce(k, F.array().cast("array<string>")) for k in kinds]))).alias("span_id"))
    lost = named.join(spans.select("document_id", "span_id"), ["document_id", "span_id"], "left_anti").select("id", F.lit("span is not in the document").alias("rule"))
    rules: list[tuple[str, Column]] = [
        ("empty id, label or description", F.exists(F.array("id", "label", "description"), lambda x: F.coalesce(F.trim(x), F.lit("")) == "")),
        ("abstains but has support", F.col("expect_abstain") & (F.size("support_span_ids") > 0)),
        ("neither supports nor abstains", ~F.col("expect_abstain") & (F.size("support_span_ids") == 0)),
        ("unknown split", ~F.coalesce(F.col("split"), F.lit("")).isin(*RATIOS)),
    ] + ([("not reviewed", ~F.coalesce(F.col("curation.reviewed"), F.lit(False)))] if need_reviewed else [])
    told = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(r)) for r, c in rules]), lambda x: x.isNotNull())
    own = cases.select("id", F.explode(told).alias("rule"))
    twice = cases.groupBy("id").count().filter("count > 1").select("id", F.lit("id is repeated").alias("rule"))
    unknown = cases.join(spans.select("document_id").distinct(), "document_id", "left_anti").select("id", F.lit("unknown document").alias("rule"))
    return own.unionByName(twice).unionByName(unknown).unionByName(lost.distinct())


def judge_requests(cases: DataFrame, spans: DataFrame, gold: DataFrame, with_forbidden: bool = True) -> DataFrame:
    """One request for each case and labelled span, with the label that is expected; spans that are only forbidden should be rejected.

    cases (case_id, label, description), spans (span_id, document_id, text, heading_path), gold (case_id, span_id, gold).
    """
    place = F.create_map(*[F.lit(x) for k, v in enumerate(EXPECTED) for x in (v, k)])
    kinds = gold if with_forbidden else gold.filter("gold <> 'forbidden'")
    first = kinds.groupBy("case_id", "span_id").agg(F.array_sort(F.collect_set(F.struct(place[F.col("gold")].alias("k"), "gold"))).alias("all"))
    # Every kind of gold is asked for; forbidden only where it is all there is.
    asked = first.select("case_id", "span_id", F.explode(F.filter("all", lambda x: (x["gold"] != "forbidden") | (F.size("all") == 1))).alias("g"))
    names = F.create_map(*[F.lit(x) for kv in EXPECTED.items() for x in kv])
    return asked.join(cases, "case_id").join(spans, "span_id").select(
        F.concat_ws(":", "case_id", "span_id").alias("id"), "case_id", "document_id", "span_id", F.col("label").alias("intent_label"), F.col("description").alias("intent_description"),
        F.col("text").alias("candidate_text"), "heading_path", names[F.col("g.gold")].alias("expected_label"), F.sha2(F.concat_ws("\n", "document_id", "span_id", "text", "label", "description"), 256).alias("source_hash"),
    )


RUBRIC = {
    "direct_support": "The span alone must show the claim, without what stands elsewhere.", "minimality": "The smallest span that shows the claim is the one to choose.",
    "near_miss": "It is about the same thing but lacks a part, a relation, a scope or a negation.", "contradiction": "It says that the claim is false, or the opposite.",
    "insufficient_context": "It has some of the words but can't settle the claim.",
}


def prompts(requests: DataFrame) -> DataFrame:
    """id and prompt: the rubric, the claim, the span, and the form of the answer."""
    head = "Judge whether the span is evidence for the claim.\n" + "\n".join(f"- {k}: {v}" for k, v in RUBRIC.items())
    tail = f'Answer with JSON: {{"request_id": ..., "label": one of {", ".join(LABELS)}, "confidence": 0 to 1, "rationale": ...}}'
    body = F.concat_ws("\n", F.lit(head), F.concat(F.lit("Claim: "), "intent_label"), F.concat(F.lit("Wanted: "), "intent_description"), F.concat(F.lit("Under: "), F.array_join(F.coalesce("heading_path", F.array().cast("array<string>")), " > ")), F.concat(F.lit("Span: "), "candidate_text"), F.lit(tail))
    return requests.select("id", body.alias("prompt"))


def decisions(responses: DataFrame, requests: DataFrame, judge: str, pass_id: str, rubric: str = "span_judge", version: str = "1") -> tuple[DataFrame, DataFrame]:
    """Decisions, and the responses that make none, each with a reason."""
    joined = responses.join(requests.select(F.col("id").alias("request_id"), "source_hash"), "request_id", "left")
    reason = (
        F.when(F.col("source_hash").isNull(), "unknown request").when(~F.coalesce(F.col("label"), F.lit("")).isin(*LABELS), "unknown label")
        .when(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "confidence is no share").when(F.coalesce(F.trim("rationale"), F.lit("")) == "", "no rationale")
    )
    told = joined.withColumn("reason", reason)
    good = told.filter("reason is null").drop("reason")
    more = {"judge_model": judge, "rubric_id": rubric, "rubric_version": version, "pass_id": pass_id}
    return good.withColumns({k: F.lit(v) for k, v in more.items()}), told.filter("reason is not null").select("request_id", "label", "reason")


def agreement(given: DataFrame, least_passes: int = 2) -> DataFrame:
    """Of each request: passes, the majority (the first seen among equals, by pass), whether all agree, mean confidence, and whether there are enough passes."""
    votes = given.groupBy("request_id", "label").agg(F.count("*").alias("n"), F.min("pass_id").alias("first"))
    best = votes.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "first", "label"))).alias("order"), F.count("*").alias("kinds"))
    whole = given.groupBy("request_id").agg(F.count("*").alias("n_decisions"), F.countDistinct("pass_id").alias("n_passes"), F.round(F.avg("confidence"), 4).alias("confidence"))
    return whole.join(best, "request_id").select("request_id", "n_decisions", "n_passes", "confidence", F.get("order", F.lit(0))["label"].alias("majority"), (F.col("kinds") == 1).alias("unanimous"), (F.col("n_passes") >= least_passes).alias("enough"))


def training_pairs(cases: DataFrame, spans: DataFrame, gold: DataFrame, candidates: DataFrame, negatives: int = 3, scores: dict[str, float] | None = None) -> DataFrame:
    """Gold supports, and of each case the first other candidates (one at least), by their gold label or as rejected, with target scores."""
    scores = scores or SCORES
    support = gold.filter("gold = 'support'").select("case_id", "span_id").distinct()
    places = {"near_miss": 0, "contradiction": 1, "insufficient_context": 2}
    rank = F.create_map(*[F.lit(x) for kv in places.items() for x in kv])
    other = gold.filter(F.col("gold").isin(*places)).groupBy("case_id", "span_id").agg(F.min_by("gold", rank[F.col("gold")]).alias("gold"))
    order = W.partitionBy("case_id").orderBy("rank")
    rest = candidates.join(support, ["case_id", "span_id"], "left_anti").withColumn("k", F.row_number().over(order)).filter(F.col("k") <= max(negatives, 1))
    names = F.create_map(*[F.lit(x) for kv in EXPECTED.items() for x in kv])
    rest = rest.join(other, ["case_id", "span_id"], "left").select("case_id", "span_id", F.coalesce(names[F.col("gold")], F.lit("reject")).alias("label"))
    target = F.create_map(*[F.lit(x) for kv in scores.items() for x in kv])
    both = support.withColumn("label", F.lit("supports")).unionByName(rest)
    return both.join(cases, "case_id").join(spans.select("span_id", "text"), "span_id").select(F.col("case_id").alias("intent_id"), "query", "span_id", "text", "label", target[F.col("label")].alias("score"))
