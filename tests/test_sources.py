from attestor.sources import files


def test_documents_and_manifest(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "Read Me.md").write_text("# One\n")
    (tmp_path / "a" / "read-me.txt").write_text("Two")
    (tmp_path / "skip.bin").write_text("x")
    rows = {r.document_id: r.text for r in files.documents_in(spark, str(tmp_path)).collect()}
    assert rows == {"read_me": "# One\n", "read_me_2": "Two"}
    (tmp_path / "manifest.json").write_text('{"source_count": 1, "sources": [{"id": "m", "filename": "Read Me.md", "raw_url": "u"}]}')
    assert [tuple(r) for r in files.manifest_documents(spark, str(tmp_path)).collect()] == [("m", "# One\n", "u")]


def test_json_lines(spark, tmp_path):
    path = str(tmp_path / "q")
    df = spark.createDataFrame([("r", "supports", 0.5), ("s", None, 1.0)], "request_id string, label string, confidence double")
    files.write_json_lines(df, path)
    good, bad = files.json_lines(spark, path, files.DECISION, ("request_id", "label"))
    assert [(r.request_id, r.confidence) for r in good.collect()] == [("r", 0.5)]
    assert [r.reason for r in bad.collect()] == ["no label"]


def test_score_log(spark, tmp_path):
    path = str(tmp_path / "s")
    known = spark.createDataFrame([("a", 1.0)], "id string, score double")
    files.append_scores(known, spark.createDataFrame([("a", 1.0), ("b", 2.0)], "id string, score double"), path)
    assert [r.value for r in spark.read.text(path).collect()] == ['{"id":"b","score":2.0}']
    log = spark.createDataFrame([("a", 1.0, 1), ("a", 3.0, 2)], "id string, score double, n int")
    assert files.latest_scores(log, "n").collect()[0].score == 3.0
