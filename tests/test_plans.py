"""Every query of the engine against the same, or an independent, text on a second engine."""

import duckdb
import pytest

import __spark_entry__ as entry
from attestor.plans import typed
from attestor.plans.catalog import PLANS

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", [*PLANS, *typed.SQL])
def test_plan(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    columns = sorted(got.columns)
    theirs = duck.sql(entry.oracle_sql()[name])
    assert sorted(theirs.columns) == columns
    a = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    b = sorted((tuple(plain(r[theirs.columns.index(c)]) for c in columns) for r in theirs.fetchall()), key=repr)
    assert a == b


@pytest.mark.parametrize("name", [n for n in typed.QUERIES if n not in typed.SQL])
def test_typed(spark, name):
    # At this scale no claim has a supporting span.
    assert entry.queries()[name](spark, SF).count() > 0 or name == "win_typed_matches"


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_cues_of_odd_texts(spark, tmp_path):
    """A word ends before a letter that isn't ASCII, other blanks stay, and a turn without text is no error."""
    texts = ["Noñasción sin más", None, "was not supported, it owns\0 no source", "mentions x but never shows; CAN'T infer", "İnside: do not  lack\x0bit", "only\tit,\nnot that", None, "not only that", None, "éno lacksé owns"]
    spark.createDataFrame([(1, i, "user", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    theirs = con.sql(entry.oracle_sql()["cue_pairs"])
    got = entry.queries()["cue_pairs"](spark, str(tmp_path)).select(*theirs.columns)
    assert sorted(map(tuple, got.collect())) == sorted(theirs.fetchall())
