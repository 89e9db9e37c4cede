"""Selection, reranking, holdouts, splits, cases, judges and training pairs on small fixtures, by hand."""

import pytest

from attestor.operators import curation as C
from attestor.operators import experiments as E
from attestor.operators import keyword

CAND = "claim_id string, span_id string, parent_id string, document_id string, ordinal int, label string, score double"


@pytest.fixture(scope="module")
def cand(spark):
    rows = [("a", "p", None, "d", 1, "supports", 0.7), ("a", "c1", "p", "d", 2, "supports", 0.7), ("a", "c2", "p", "d", 3, "supports", 0.9), ("a", "q", None, "d", 4, "near_miss", 0.95), ("b", "r", None, "d", 5, "reject", 0.9), ("b", "s", None, "d", 6, "contradicts", 0.4)]
    return E.in_order(spark.createDataFrame(rows, CAND), ["claim_id"])


def ranks(df, column="rank"):
    return {(r.claim_id, r.span_id): r[column] for r in df.collect()}


def test_order_and_matches(cand):
    assert ranks(cand) == {("a", "c2"): 1, ("a", "c1"): 2, ("a", "p"): 3, ("a", "q"): 4, ("b", "s"): 1, ("b", "r"): 2}
    assert ranks(E.matches(cand, ["claim_id"]), "place") == {("a", "c2"): 1}
    assert ranks(E.weak_matches(cand, ["claim_id"]), "place") == {("a", "c2"): 1, ("a", "c1"): 2}
    assert ranks(E.weak_matches(cand, ["claim_id"], 1), "place") == {("a", "c2"): 1}


def test_relabel_and_rerank(spark, cand):
    assert ranks(E.relabelled(cand, 0.92), "label") == {("a", "c2"): "near_miss", ("a", "c1"): "reject", ("a", "p"): "reject", ("a", "q"): "supports", ("b", "s"): "contradicts", ("b", "r"): "near_miss"}
    raw = spark.createDataFrame([("a", "p", 3.0), ("a", "q", 0.0), ("a", "c1", -3.0)], "claim_id string, span_id string, raw double")
    first = cand.filter("claim_id = 'a'")
    got = {r.span_id: (r["rank"], r.label, r.score, r.first_score) for r in E.reranked(first, raw, ["claim_id"]).collect()}
    assert got == {"p": (1, "supports", 0.9526, 0.7), "q": (2, "near_miss", 0.5, 0.95), "c1": (3, "reject", 0.0474, 0.7)}
    assert ranks(E.reranked(first, raw, ["claim_id"], keep_labels=True), "label")["a", "c1"] == "supports"
    assert ranks(E.reranked(first, raw, ["claim_id"], support=0.4, require_support=True), "label")["a", "q"] == "near_miss"


def test_measures(spark, cand):
    asked = spark.createDataFrame([("a", "dev"), ("b", "test"), ("c", "dev")], "claim_id string, split string")
    gold = spark.createDataFrame([("a", "c1", "support"), ("b", "s", "contradiction"), ("b", "s", "forbidden")], "claim_id string, span_id string, gold string")
    r = E.evaluate(asked.select("claim_id"), cand, gold).first()
    assert (r.n_cases, r.n_support_cases, r.n_abstain_cases, r.mrr, r.recall_1, r.recall_3, r.top1_support) == (3, 1, 2, 0.5, 0.0, 1.0, 0.0)
    assert (r.abstain_accuracy, r.decision_accuracy, r.evidence_decision_accuracy, r.diagnostic_top1, r.abstain_diagnostic_top1, r.forbidden_top1, r.forbidden_supported_top1) == (1.0, 1.0, 0.6667, 1.0, 1.0, 0.3333, 0.0)
    points = {r.step: r for r in E.calibrate(asked.select("claim_id"), cand, gold).collect()}
    # From 0.95 on only q of a is called, which is no gold; b's reject is called up to 0.9.
    assert points[19].evidence_decision_accuracy == 0.6667 and points[18].abstain_accuracy == 0.5 and sum(p.best for p in points.values()) == 1
    held = E.holdout(asked, cand, gold).first()
    assert held.n_cases == 1 and 0 < held.threshold < 1


def test_keyword_ties(spark):
    spans = spark.createDataFrame([(f"s{i}", f"d{i % 3}", i, None if i % 2 else "p", "alpha beta" if i < 40 else "alpha") for i in range(50)], "span_id string, document_id string, ordinal int, parent_id string, text string")
    claims = spark.createDataFrame([(1, "alpha beta gamma"), (2, "zeta"), (3, None)], "claim_id int, claim string")
    got = keyword.first_spans(spans.repartition(3), claims, 5).orderBy("rank").collect()
    want = sorted((i for i in range(40)), key=lambda i: (i % 2 == 1, f"d{i % 3}", i))[:5]
    assert [(r.claim_id, r.span_id, r.k, r.n) for r in got] == [(1, f"s{i}", 2, 3) for i in want]


def test_splits(spark):
    assert C.split_sizes(10) == {"train": 7, "dev": 2, "test": 1} and C.split_sizes(3) == {"train": 1, "dev": 1, "test": 1}
    with pytest.raises(ValueError):
        C.split_sizes(2)
    docs = spark.range(500).selectExpr("cast(id as string) AS document_id")
    few, many = (sorted(C.split_documents(docs, bucket_rows=b).collect()) for b in (10, 10_000))
    assert few == many and [sum(r.split == s for r in few) for s in ("train", "dev", "test")] == [350, 75, 75]


def test_cases_and_judges(spark):
    queue = spark.createDataFrame([("d", "d:s1", "Cache works", ["cache"])], "document_id string, span_id string, suggested_label string, anchor_terms array<string>")
    made = C.case_templates(queue)
    assert made.first().id == "d.d:s1.reviewed" and made.first().description == "Find evidence for: Cache works"
    spans = spark.createDataFrame([("d", "d:s1", "Cache works.", None), ("d", "d:s2", "No.", ["H"])], "document_id string, span_id string, text string, heading_path array<string>")
    assert {r.rule for r in C.violations(made, spans).collect()} == {"not reviewed"} and C.violations(made, spans, need_reviewed=False).isEmpty()
    assert {r.rule for r in C.violations(made.union(made), spans.filter("span_id = 'd:s2'"), False).collect()} == {"id is repeated", "span is not in the document"}
    cases = spark.createDataFrame([("k", "Cache works", "Find it", "Cache works\nFind it")], "case_id string, label string, description string, query string")
    gold = spark.createDataFrame([("k", "d:s1", "support"), ("k", "d:s2", "forbidden"), ("k", "d:s1", "forbidden")], "case_id string, span_id string, gold string")
    asked = C.judge_requests(cases, spans, gold)
    assert {(r.id, r.expected_label) for r in asked.collect()} == {("k:d:s1", "supports"), ("k:d:s2", "reject")}
    assert C.judge_requests(cases, spans, gold, with_forbidden=False).count() == 1
    assert "Under: H" in {r.id: r.prompt for r in C.prompts(asked).collect()}["k:d:s2"]
    said = [("k:d:s1", "supports", 0.9, "yes"), ("k:d:s2", "maybe", 0.5, "x"), ("?", "reject", 0.5, "x"), ("k:d:s2", "reject", 1.5, "x"), ("k:d:s2", "reject", 0.5, " ")]
    good, bad = C.decisions(spark.createDataFrame(said, "request_id string, label string, confidence double, rationale string"), asked, "m", "1")
    assert [r.request_id for r in good.collect()] == ["k:d:s1"] and sorted(r.reason for r in bad.collect()) == ["confidence is no share", "no rationale", "unknown label", "unknown request"]
    votes = spark.createDataFrame([("k", "a", "1", 0.5), ("k", "b", "2", 1.0), ("k", "b", "3", 0.0), ("l", "a", "1", 1.0)], "request_id string, label string, pass_id string, confidence double")
    got = {r.request_id: r for r in C.agreement(votes).collect()}
    assert (got["k"].majority, got["k"].unanimous, got["k"].confidence, got["l"].enough) == ("b", False, 0.5, False)


def test_training_pairs(spark):
    spans = spark.createDataFrame([(f"s{i}", f"t{i}") for i in range(5)], "span_id string, text string")
    cases = spark.createDataFrame([("k", "q")], "case_id string, query string")
    gold = spark.createDataFrame([("k", "s0", "support"), ("k", "s2", "contradiction"), ("k", "s2", "near_miss")], "case_id string, span_id string, gold string")
    found = spark.createDataFrame([("k", f"s{i}", i + 1) for i in range(5)], "case_id string, span_id string, rank int")
    got = {(r.span_id, r.label, r.score) for r in C.training_pairs(cases, spans, gold, found, 2).collect()}
    assert got == {("s0", "supports", 1.0), ("s1", "reject", 0.0), ("s2", "near_miss", 0.35)}
    assert C.training_pairs(cases, spans, gold, found, 0).count() == 2
