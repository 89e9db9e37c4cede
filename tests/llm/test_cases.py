"""Nulls, repeated rows, ties, very long texts and columns with clashing names, for every operator; brute force where SQL can't tell; the pipeline."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestor.llm import decontam, html_extract, line_dedup, lm_score, mix, ngram_join, quality_cnn, rules, substring_dedup, token_count

public_tokenizers = pytest.importorskip("public_tokenizers")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["row", "h", "n", "w", "x", "y", "s", "cls", "ball", "label", "key", "size", "place", "units", "gone", "marks", "first", "rank", "score", "quality", "item_id", "items", "c", "removed", "rid", "text_hash"]


def prose(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(f"w{i}" for i in rng.integers(0, 300, n))


LONG = " ".join(f"{prose(7, 40)}. L{i}\n" for i in range(20_000))
ROWS = [
    (1, prose(1, 60), "en", "a", 1), (1, prose(1, 60), "en", "a", 1), (2, prose(1, 60), None, None, None), (None, prose(2, 50), "en", "a", 1), (None, None, None, None, None), (3, None, "en", "b", 0),
    (4, "", "en", "b", 0), (5, "one", "en", "b", 3), (6, LONG, "en", "b", len(LONG)), (1, prose(3, 40), "en", "a", 1), (7, "a b\n" * 30, "en", "a", 1), (8, "a b\n" * 30, "en", "a", 1),
]
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def docs(spark):
    assert len(LONG.encode()) > 2 << 20
    return spark.createDataFrame(ROWS, SCHEMA).repartition(2)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 0, 0), (None, 1, 0), (5, None, None), (99, 0, 1)], LABELS)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, prose(1, 60)[10:200]), (1, prose(1, 60)[10:200]), (None, prose(2, 50)), (2, None), (3, "one"), (4, "")], "item_id long, text string")


OPERATORS = {
    "op1": lambda d, labels, items: lm_score.lm_scores(d, PIECES), "op2": lambda d, labels, items: substring_dedup.remove_repeats(d), "op4": lambda d, labels, items: line_dedup.dedup_lines(d),
    "op5": lambda d, labels, items: quality_cnn.quality(d, labels), "op6": lambda d, labels, items: mix.mix(d), "op7": lambda d, labels, items: decontam.contamination(d, items),
    "op8": lambda d, labels, items: rules.quality_rules(d, labels), "op9": lambda d, labels, items: token_count.token_counts(d, PIECES), "op10": lambda d, labels, items: ngram_join.similar(d),
}


def plain(df):
    return sorted((tuple(round(v, 4) if isinstance(v, float) else str(v) for v in r) for r in df.select(*sorted(c for c in df.columns if c not in ("component",))).collect()), key=repr)


@pytest.mark.parametrize("name", OPERATORS)
def test_cases(docs, labels, items, name):
    """A row for each row, equal rows equal results, and the same with other columns, whatever their names."""
    run = OPERATORS[name]
    got = plain(run(docs, labels, items))
    assert len(got) == len(ROWS)
    more = docs
    for c in CLASHING:
        more = more.withColumn(c, F.lit(-7))
    assert plain(run(more, labels.withColumn("text", F.lit("x")), items.withColumn("h", F.lit(1)))) == got


def test_pages_cases(spark):
    page = "<body><article><p>" + "real words here " * 20 + "</p></article></body>"
    rows = [(1, "u", page), (1, "u", page), (None, None, page), (2, "v", None), (3, "w", ""), (4, "x", "<p>" + "long text " * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("no")).withColumn("n_chars", F.lit(-1))
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in html_extract.main_text(pages).collect()}
    whole = " ".join(["real words here"] * 20)
    assert got[1, "u"] == got[None, None] == (whole, len(whole)) and got[2, "v"] == got[3, "w"] == ("", 0) and got[4, "x"][1] == 10 * 300_000 - 1
    assert html_extract.main_text(pages).count() == len(rows)


def test_line_dedup_recall(spark):
    """Against the alignment of every document with every earlier one."""
    rng = np.random.default_rng(5)
    lines = [prose(100 + i, 10) for i in range(40)] + ["short one", "tiny"]
    texts = ["\n".join(lines[i] for i in rng.integers(0, len(lines), rng.integers(2, 14))) for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: set(r.removed) for r in line_dedup.dedup_lines(df).collect()}
    want = caught = 0
    for j, b in enumerate(texts):
        own = b.split("\n")
        words = [len(x.split()) for x in own]
        every = set()
        for a in texts[:j]:
            block = []
            for x in [*line_dedup.patience(a.split("\n"), own), (-9, -9)]:
                if block and (x[0] != block[-1][0] + 1 or x[1] != block[-1][1] + 1):
                    if sum(words[k] for _, k in block) >= line_dedup.LEAST_WORDS:
                        every |= {k for _, k in block}
                    block = []
                block.append(x)
        want += len(every)
        caught += len(every & got[j])
    assert want > 100 and caught >= 0.9 * want
    assert not got[0]
    seen = set()
    for j, t in enumerate(texts):
        for k in got[j]:
            line = t.split("\n")[k]
            assert line in seen
        seen |= set(t.split("\n"))


def test_substring_dedup_brute_force(spark):
    rng = np.random.default_rng(8)
    pool = [f"S{i} " + prose(500 + i, 9) + "." for i in range(30)]
    texts = [" ".join([pool[i] for i in rng.integers(0, 30, rng.integers(1, 4))] + [f"Own {k} " + prose(900 + k, 12) + "."]) for k in range(50)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(df, least_run=25).collect()}
    seen = set()
    for i, t in enumerate(texts):
        spans, words = substring_dedup.units(t), t
        gone, here = [], set()
        for a, b, _ in spans:
            u = words[a:b].lower()
            gone.append(u in seen or u in here)
            here.add(u)
        seen |= here
        want, k = set(), 0
        while k < len(spans):
            end = k
            while end < len(spans) and gone[end]:
                end += 1
            if end > k and (sum(n for _, _, n in spans[k:end]) >= 25 or end - k == len(spans)):
                want |= set(range(k, end))
            k = max(end, k + 1)
        assert got[i].n_removed == len(want)
        left = "".join([t[a:b] for a, b in zip([0, *(r.end for r in got[i].removed)], [*(r.start for r in got[i].removed), len(t)])])
        assert left == got[i].text


def test_model_beats_base(spark):
    """On held-out texts, in total."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sums = lm_score.lm_scores(docs, PIECES).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert sums[0] > sums[1]


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    clean = [prose(1000 + i, 80) for i in range(60)]
    item = " ".join(f"q{i}" for i in range(20))
    rows = [(i, t) for i, t in enumerate(clean)] + [(100, clean[0]), (101, clean[1] + " end"), (102, prose(4000, 30) + " " + item), (None, None), (103, "x\n" + clean[2] + "\n" + prose(5000, 60)), (104, prose(6000, 50)), (104, prose(6001, 50))]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in rows], SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    at, kept = spark.read.parquet(f"{tmp_path}/documents.parquet").withColumn("score", F.lit(1)), {}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, at, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        at = spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = Counter(r.doc_id for r in at.collect())
        assert name == "mix" or at.columns == list(pipeline.COLUMNS)
    assert sum(kept["quality"].values()) == len(rows)
    # A line that an earlier document has goes, and with it what was nothing else.
    assert 100 not in kept["line_dedup"] and kept["line_dedup"][103] == 1 and kept["line_dedup"][None] == 1
    assert 101 not in kept["near_duplicates"] and kept["near_duplicates"][1] == 1 and kept["near_duplicates"][104] == 2
    assert 102 not in kept["decontamination"] and all(kept["decontamination"][i] == 1 for i in range(60))
    assert kept["mix"] == kept["decontamination"]
    assert {r.doc_id for r in pipeline.run(spark, str(tmp_path)).collect()} == set(kept["mix"])


def test_near_duplicate_rows_of_one_id(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    t, u = prose(1, 60), prose(2, 60)
    docs = spark.createDataFrame([(1, t, "en", "a", 1), (1, t, "en", "a", 1), (2, t, "en", "a", 1), (2, u, "en", "a", 1), (None, u + " z", "en", "a", 1), (None, "", "en", "a", 1)], SCHEMA)
    got = sorted(((r.doc_id, r.text) for r in pipeline.near_duplicates(spark, docs, "").collect()), key=repr)
    assert got == sorted([(1, t), (2, u), (None, "")], key=repr)


def test_words_of():
    assert re.findall(r"[^\x20\x09-\x0D]+", "a\x0bb\x1fc d") == ["a", "b\x1fc", "d"]
