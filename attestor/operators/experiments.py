"""Ranked candidates to decisions and measures: selection, evaluation, calibration, reranking, holdouts.

Candidates are rows (claim_id, span_id, parent_id, document_id, ordinal, label, score, rank); gold rows are (claim_id,
span_id, gold) with gold one of support, near_miss, contradiction, insufficient_context, forbidden. All of it is relational: cases are few
beside the spans that were scored, and nothing is scored twice.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DIAGNOSTIC = ("contradicts", "near_miss", "insufficient_context")
THRESHOLDS = tuple(x / 20 for x in range(1, 20))


def in_order(scored: DataFrame, by: list[str]) -> DataFrame:
    """With rank: supports first where there are any, else what tells something; then by score, children before parents, and by place."""
    any_support = F.max((F.col("label") == "supports").cast("int")).over(W.partitionBy(*by))
    first = F.when(any_support == 1, F.col("label") == "supports").otherwise(F.col("label").isin(*DIAGNOSTIC))
    order = W.partitionBy(*by).orderBy(F.desc("first"), F.desc("score"), F.col("parent_id").isNull(), "document_id", "ordinal")
    return scored.withColumn("first", first).withColumn("rank", F.row_number().over(order)).drop("first")


def by_score(scored: DataFrame, by: list[str]) -> DataFrame:
    """With rank, by score alone: the order of retrieval models."""
    return scored.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("score"), "document_id", "ordinal")))


def matches(candidates: DataFrame, by: list[str], most: int = 3) -> DataFrame:
    """The first supporting span of each family (a parent and its children), `most` of them."""
    family = W.partitionBy(*by, F.coalesce("parent_id", "span_id")).orderBy("rank")
    first = candidates.filter("label = 'supports'").withColumn("f", F.row_number().over(family)).filter("f = 1").drop("f")
    return first.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy("rank"))).filter(F.col("place") <= (most or 3))


def weak_matches(candidates: DataFrame, by: list[str], most: int = 3) -> DataFrame:
    """Selection by id alone: a parent goes only where a child of it stands before it."""
    own = candidates.filter("label = 'supports'")
    child = own.filter("parent_id is not null").groupBy(*by, F.col("parent_id").alias("span_id")).agg(F.min("rank").alias("child"))
    kept = own.join(child, [*by, "span_id"], "left").filter("child is null or child > rank").drop("child")
    return kept.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy("rank"))).filter(F.col("place") <= (most or 3))


def threshold_label(score: Column, support: Column | float, near: float = 0.82) -> Column:
    support = support if isinstance(support, Column) else F.lit(float(support))
    return F.when(score >= support, "supports").when(score >= support * near, "near_miss").otherwise("reject")


def relabelled(candidates: DataFrame, support: Column | float, near: float = 0.82) -> DataFrame:
    """Labels by a calibrated threshold, in the same order; what contradicts stays so."""
    return candidates.withColumn("label", F.when(F.col("label") == "contradicts", F.col("label")).otherwise(threshold_label(F.col("score"), support, near)))


def reranked(first: DataFrame, scores: DataFrame, by: list[str], support: float = 0.55, near: float = 0.82, keep_labels: bool = False, require_support: bool = False) -> DataFrame:
    """First-stage candidates in a second model's order. scores: (by, span_id, raw), turned to shares by the logistic curve.

    keep_labels: the first stage's labels decide; require_support: only what it supports may be supported. Its features
    stay, under names of their own.
    """
    joined = first.join(scores.select(*by, "span_id", "raw"), [*by, "span_id"])
    score = 1 / (1 + F.exp(-F.col("raw")))
    label = threshold_label(score, support, near)
    label = F.when((label == "supports") & (F.col("label") != "supports"), "near_miss").otherwise(label) if require_support else label
    out = joined.withColumn("first_score", F.col("score")).withColumn("score", score).withColumn("label", F.col("label") if keep_labels else label)
    if "features" in first.columns:
        out = out.withColumn("features", F.transform_keys("features", lambda k, _: F.concat(F.lit("first_stage:"), k)))
    return by_score(out.drop("rank", "raw"), by).withColumn("score", F.round("score", 4))


MATCHES = """fam AS (SELECT *, row_number() OVER (PARTITION BY claim_id, coalesce(parent_id, span_id) ORDER BY rank) AS f FROM cand WHERE label = 'supports'),
sel AS (SELECT claim_id, span_id, row_number() OVER (PARTITION BY claim_id ORDER BY rank) AS place FROM fam WHERE f = 1),"""
#: What is known of each case, from `asked` (claim_id), `cand` and `gold`. A case without gold support should abstain.
CASES = """known AS (SELECT DISTINCT claim_id, span_id, gold FROM gold),
sup AS (SELECT claim_id, count(*) AS n FROM known WHERE gold = 'support' GROUP BY claim_id),
neg AS (SELECT claim_id, count(*) AS n FROM known WHERE gold IN ('near_miss', 'contradiction', 'insufficient_context') GROUP BY claim_id),
firsts AS (SELECT c.claim_id, min(c.rank) AS r FROM cand c JOIN known k ON k.claim_id = c.claim_id AND k.span_id = c.span_id AND k.gold = 'support' GROUP BY c.claim_id),
heads AS (SELECT c.claim_id, c.label, c.score, max(CASE WHEN k.gold = 'forbidden' THEN 1 ELSE 0 END) AS forbidden,
  max(CASE WHEN k.gold = c.label OR (k.gold = 'contradiction' AND c.label = 'contradicts') THEN 1 ELSE 0 END) AS told
  FROM cand c LEFT JOIN known k ON k.claim_id = c.claim_id AND k.span_id = c.span_id WHERE c.rank = 1 GROUP BY c.claim_id, c.label, c.score),
won AS (SELECT s.claim_id, max(CASE WHEN k.span_id IS NOT NULL THEN 1 ELSE 0 END) AS good FROM sel s LEFT JOIN known k ON k.claim_id = s.claim_id AND k.span_id = s.span_id AND k.gold = 'support' WHERE s.place = 1 GROUP BY s.claim_id),
per AS (SELECT a.claim_id, coalesce(p.n, 0) AS n_gold, coalesce(n.n, 0) AS n_neg, f.r, w.claim_id IS NULL AS abstained, coalesce(w.good, 0) = 1 AS good,
  coalesce(h.forbidden, 0) = 1 AS forbidden, coalesce(h.forbidden, 0) = 1 AND h.label = 'supports' AS forbidden_supported, coalesce(h.told, 0) = 1 AS told
  FROM asked a LEFT JOIN sup p ON p.claim_id = a.claim_id LEFT JOIN neg n ON n.claim_id = a.claim_id LEFT JOIN firsts f ON f.claim_id = a.claim_id LEFT JOIN won w ON w.claim_id = a.claim_id LEFT JOIN heads h ON h.claim_id = a.claim_id)"""


def _rate(top: str, of: str, empty: int = 0) -> str:
    return f"round(coalesce(cast(count(CASE WHEN {top} THEN 1 END) as double) / nullif(count(CASE WHEN {of} THEN 1 END), 0), {empty}), 4)"


_EVIDENCE = "CASE WHEN n_gold > 0 THEN good ELSE abstained END"
MEASURES = f"""count(*) AS n_cases, count(CASE WHEN n_gold > 0 THEN 1 END) AS n_support_cases, count(CASE WHEN n_gold = 0 THEN 1 END) AS n_abstain_cases,
round(coalesce(sum(CASE WHEN n_gold > 0 THEN coalesce(cast(1 as double) / r, cast(0 as double)) END) / nullif(count(CASE WHEN n_gold > 0 THEN 1 END), 0), 0), 4) AS mrr,
{_rate('n_gold > 0 AND r <= 1', 'n_gold > 0')} AS recall_1, {_rate('n_gold > 0 AND r <= 3', 'n_gold > 0')} AS recall_3, {_rate('n_gold > 0 AND r <= 5', 'n_gold > 0')} AS recall_5,
{_rate('n_gold > 0 AND good', 'n_gold > 0')} AS top1_support, {_rate('n_gold = 0 AND abstained', 'n_gold = 0', 1)} AS abstain_accuracy,
{_rate('abstained = (n_gold = 0)', 'TRUE')} AS decision_accuracy, {_rate(_EVIDENCE, 'TRUE')} AS evidence_decision_accuracy,
{_rate('n_neg > 0 AND told', 'n_neg > 0', 1)} AS diagnostic_top1, {_rate('n_neg > 0 AND n_gold = 0 AND told', 'n_neg > 0 AND n_gold = 0', 1)} AS abstain_diagnostic_top1,
{_rate('forbidden', 'TRUE')} AS forbidden_top1, {_rate('forbidden_supported', 'TRUE')} AS forbidden_supported_top1"""
EVALUATION = f"{MATCHES} {CASES} SELECT {MEASURES} FROM per"
#: Thresholds replayed over the scored candidates: any candidate that doesn't contradict supports from the threshold on, without regard to families.
REPLAY = f"""grid AS (SELECT step, step / cast(20 as double) AS t FROM steps),
called AS (SELECT g.step, c.claim_id, c.span_id, row_number() OVER (PARTITION BY g.step, c.claim_id ORDER BY c.rank) AS place FROM cand c JOIN grid g ON c.label <> 'contradicts' AND c.score >= g.t),
sel AS (SELECT claim_id, span_id, place FROM called WHERE 1 = 0), {CASES},
best AS (SELECT c.step, c.claim_id, max(CASE WHEN k.span_id IS NOT NULL THEN 1 ELSE 0 END) AS good FROM called c LEFT JOIN known k ON k.claim_id = c.claim_id AND k.span_id = c.span_id AND k.gold = 'support' WHERE c.place = 1 GROUP BY c.step, c.claim_id),
replayed AS (SELECT g.step, g.t, p.n_gold, p.n_neg, p.r, b.claim_id IS NULL AS abstained, coalesce(b.good, 0) = 1 AS good, p.forbidden, p.told,
  p.forbidden AND h.label <> 'contradicts' AND h.score >= g.t AS forbidden_supported
  FROM per p CROSS JOIN grid g LEFT JOIN best b ON b.step = g.step AND b.claim_id = p.claim_id LEFT JOIN heads h ON h.claim_id = p.claim_id),
report AS (SELECT step, t AS threshold, {MEASURES} FROM replayed GROUP BY step, t)"""
CALIBRATION = f"""{REPLAY} SELECT report.*, row_number() OVER (ORDER BY evidence_decision_accuracy DESC, decision_accuracy DESC, top1_support DESC, abstain_accuracy DESC, forbidden_supported_top1, mrr DESC, threshold) = 1 AS best FROM report"""
#: For each diagnostic label: the cases that have gold of it, and how their first candidate fares.
NEGATIVE = f"""{MATCHES} {CASES}, kinds AS (SELECT 'contradicts' AS label UNION ALL SELECT 'near_miss' UNION ALL SELECT 'insufficient_context'),
own AS (SELECT claim_id, span_id, CASE WHEN gold = 'contradiction' THEN 'contradicts' ELSE gold END AS label FROM known),
each AS (SELECT o.label, o.claim_id, count(*) AS n, max(CASE WHEN c.rank = 1 THEN 1 ELSE 0 END) AS top1, max(CASE WHEN c.rank = 1 AND c.label = o.label THEN 1 ELSE 0 END) AS told, max(CASE WHEN c.rank = 1 AND c.label = 'supports' THEN 1 ELSE 0 END) AS supported
  FROM own o LEFT JOIN cand c ON c.claim_id = o.claim_id AND c.span_id = o.span_id GROUP BY o.label, o.claim_id)
SELECT k.label, count(e.claim_id) AS n_cases, cast(coalesce(sum(e.n), 0) as bigint) AS n_spans, {_rate('e.top1 = 1', 'e.claim_id IS NOT NULL')} AS top1_rate, {_rate('e.told = 1', 'e.claim_id IS NOT NULL')} AS labelled_top1_rate, {_rate('e.supported = 1', 'e.claim_id IS NOT NULL')} AS supported_top1_rate
FROM kinds k LEFT JOIN each e ON e.label = k.label GROUP BY k.label"""


def sql(views: dict[str, DataFrame], text: str) -> DataFrame:
    """SQL over the views, under names of their own."""
    spark = next(iter(views.values())).sparkSession
    names = {v: f"attestor_{v}_{uuid.uuid4().hex}" for v in views}
    for v, df in views.items():
        df.createOrReplaceTempView(names[v])
    heads = ", ".join(f"{v} AS (SELECT * FROM {n})" for v, n in names.items())
    own = re.sub(r"^\s*WITH\s+", ", ", text) if re.match(r"\s*WITH\s", text) else " " + text
    try:
        return spark.sql(f"WITH {heads}{own}")
    finally:
        for n in names.values():
            spark.catalog.dropTempView(n)


def evaluate(asked: DataFrame, candidates: DataFrame, gold: DataFrame) -> DataFrame:
    """The fifteen measures, in one row."""
    return sql({"asked": asked, "cand": candidates, "gold": gold}, f"WITH {EVALUATION}")


def steps(spark) -> DataFrame:
    return spark.range(1, 20).select(F.col("id").alias("step"))


def calibrate(asked: DataFrame, candidates: DataFrame, gold: DataFrame) -> DataFrame:
    """The measures at nineteen thresholds, and which is best by seven of them (the lowest threshold of equals)."""
    return sql({"asked": asked, "cand": candidates, "gold": gold, "steps": steps(asked.sparkSession)}, f"WITH {CALIBRATION}")


def holdout(asked: DataFrame, candidates: DataFrame, gold: DataFrame) -> DataFrame:
    """asked has `split`: the threshold that is best on dev, applied to test: one row of measures and the threshold."""
    part = lambda s: asked.filter(F.col("split") == s).select("claim_id")
    own = lambda df, s: df.join(part(s), "claim_id", "left_semi")
    best = calibrate(part("dev"), own(candidates, "dev"), own(gold, "dev")).filter("best").select("threshold")
    test = own(candidates, "test").withColumn("threshold", best.scalar())
    return evaluate(part("test"), relabelled(test, F.col("threshold")), own(gold, "test")).withColumn("threshold", best.scalar())
