from attestor.operators.parsing import empty_documents, inline_text, parse, sentences, spans_of

TEXT = """# Guide
Intro line one.
goes on. Then more.

### Deep [link](x) ![pic](y)
- first point
  wrapped
| a | b |
|---|---|
| c | d |
```sql
select 1;
```
"""


def test_kinds_and_paths():
    rows = spans_of("d", TEXT)
    assert [(r["kind"], r["text"]) for r in rows] == [
        ("heading", "Guide"), ("paragraph", "Intro line one. goes on. Then more."), ("sentence", "Intro line one. goes on."), ("sentence", "Then more."),
        ("heading", "Deep link pic"), ("bullet", "first point wrapped"), ("table_row", "a | b"), ("table_row", "c | d"), ("code", "select 1;"),
    ]
    assert rows[1]["heading_path"] == ["Guide"] and rows[5]["heading_path"] == ["Guide", "Deep link pic"]
    assert rows[2]["parent_id"] == rows[1]["span_id"] == "d:s0002"
    assert rows[0]["next_id"] == rows[1]["span_id"] and rows[-1]["next_id"] is None


def test_inline():
    assert inline_text("[![Build](b)](c)") == "Build"
    assert inline_text("<b>A</b> &amp; B ·") == "A & B"


def test_sentences_start_at_capitals():
    text = "One. two! Three? 4 five."
    assert [text[a:b] for a, b in sentences(text)] == ["One. two!", "Three?", "4 five."]


def test_nulls_and_empty(spark):
    docs = spark.createDataFrame([("a", None), ("b", ""), ("c", "Hi."), (None, "x")], "document_id string, text string")
    spans = parse(docs)
    assert [r.span_id for r in spans.collect()] == ["c:s0001"]
    assert {r.document_id for r in empty_documents(docs, spans).collect()} == {"a", "b", None}
