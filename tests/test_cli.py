"""The commands, one feeding the next, and the sources and sinks they use."""

import json

from attestor import cli
from attestor.sources import files

TEXT = "# Cache\n\nThe cache keeps 3 copies of each record for every tenant. It never stores passwords in plain text anywhere.\n\n- Workers restart after a failure within 20 seconds of it\n"


def test_commands(spark, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "Store.md").write_text(TEXT)
    run = lambda *a: cli.main(list(map(str, a)), spark)
    got = run("extract", docs, "--claim", "The cache keeps 3 copies of each record for every tenant")
    assert not got["abstained"] and got["matches"][0]["text"].startswith("The cache keeps 3")
    assert run("extract", docs, "--claim", "The cache keeps 9 copies of each record for every tenant")["abstained"]
    assert run("prepare-document-curation-queue", docs, tmp_path / "queue")["items"] == 4
    audit = run("audit-curation-queue", tmp_path / "queue")
    assert audit["items"] == 4 and audit["kinds"] == {"sentence": 2, "bullet": 1, "paragraph": 1} and audit["broken"] == 0
    assert run("prepare-reviewed-case-template", tmp_path / "queue", tmp_path / "cases")["cases"] == 4
    told = run("validate-reviewed-cases", tmp_path / "cases", docs)
    assert {v["rule"] for v in told["violations"]} == {"not reviewed"} and told["missing_splits"] == ["dev", "test"]
    case = json.loads(spark.read.text(str(tmp_path / "cases")).filter("value like '%copies%'").first().value)["id"]
    assert any(c["gold"] == ["support"] for c in run("explain-reviewed-case", tmp_path / "cases", docs, case)["candidates"])
    assert run("export-model-judge-requests", tmp_path / "cases", docs, tmp_path / "asked")["requests"] == 4
    asked = [json.loads(r.value)["id"] for r in spark.read.text(str(tmp_path / "asked")).collect()]
    (tmp_path / "said.jsonl").write_text("\n".join(json.dumps({"request_id": i, "label": "supports", "confidence": 1.0, "rationale": "yes"}) for i in [*asked, "?"]))
    made = run("convert-model-judge-responses", tmp_path / "said.jsonl", tmp_path / "asked", tmp_path / "decided")
    assert made["decisions"] == 4 and len(made["refused"]) == 1
    assert run("audit-model-judge-decisions", tmp_path / "decided")["too_few_passes"] == 4
    assert run("model-judge-rubric")["labels"][0] == "supports"
    assert run("export-reviewed-training-jsonl", tmp_path / "cases", docs, tmp_path / "pairs")["pairs"] > 4
    pairs, bad = files.training_examples(spark, str(tmp_path / "pairs"), {"supports": 1.0})
    assert pairs.count() == 4 and {r.reason for r in bad.collect()} == {"no score for the label"}


def test_fetched(spark, tmp_path):
    rows = [("a", "r", "u1", "MIT", "x"), ("b", "r", "u2", "MIT", "y")]
    found = files.fetched(files.source_catalog(spark, rows), spark.createDataFrame([("u1", "# Hé\n\nText."), ("u2", "One line.\n")], "raw_url string, text string"))
    facts = {r.source_id: (r.byte_count, r.line_count) for r in found.collect()}
    assert facts == {"a": (12, 3), "b": (10, 1)}
    assert files.write_fetched(found, str(tmp_path / "f")) == 2
    assert {(r.document_id, r.text, r.source) for r in files.manifest_documents(spark, str(tmp_path / "f")).collect()} == {("a", "# Hé\n\nText.", "u1"), ("b", "One line.\n", "u2")}
    assert files.markdown_report(spark.createDataFrame([("k", 0.5)], "experiment string, mrr double"), ["experiment", "mrr"], "T") == "# T\n\n| experiment | mrr |\n| --- | --- |\n| k | 0.5000 |\n"
