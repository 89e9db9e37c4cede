"""Benchmark decontamination by winnowing, in DataFrame functions only.

Words are hashed; of every WINDOW consecutive GRAM-word hashes the least is kept (the leftmost of equal ones), on both
sides, so any shared span of GRAM + WINDOW - 1 = 8 words keeps the same fingerprint at the same place in it. Documents
and benchmark meet on fingerprints; each hit is extended over the words around it, and counts from 8 words on. Items
of fewer than 8 words are one window each, met on the hash of all their words.

Texts are read once: one map pass counts words, winnows, and keeps only the fingerprints (and short runs) whose slot in a
table of SLOTS bytes the benchmark fills, with the words around them. That table has a fixed size and may only keep too
many. What it keeps is written once and joined with the benchmark.

Skew: the benchmark's side is broadcast only when its counted rows are within `broadcast_rows`, else the join shuffles;
items with the same context are one row with their list, so a passage that many items share meets a document once;
positions and items are aggregated in two steps, with partial sums before each shuffle.

Defined results: a null text has no words, an item without words no window; repeated rows of documents get equal
results, whatever their ids; words inside windows of items whose item_id is null are hit, but null is no item; equal
item_ids are one item; ties between equal hashes go to the leftmost; very long texts are winnowed whole; other columns
are ignored, whatever their names; an empty benchmark leaves every document without a hit, an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, stash

SPAN, GRAM, WINDOW = 8, 4, 5
#: Low bits of a fingerprint that hold its place in the text.
PLACE_BITS = 28
#: Bytes of the table that tells which fingerprints can be the benchmark's.
SLOTS = 1 << 20
#: The benchmark's fingerprints are broadcast up to this many rows (about 200 bytes each).
BROADCAST_ROWS = 500_000
#: The results of documents with hits meet all documents in a broadcast up to this many rows (about 150 bytes each).
RESULT_ROWS = 200_000
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BETWEEN = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


def word_hashes(text: Column) -> Column:
    """Hashes of the words, lower-cased: all but ASCII letters, digits and what is beyond ASCII parts words."""
    plain = F.translate(F.coalesce(text, F.lit("")), _UPPER + _BETWEEN, _UPPER.lower() + " " * len(_BETWEEN))
    return F.transform(F.array_remove(F.split(plain, " "), ""), lambda w: F.xxhash64(w))


def _steps(count: Column) -> Column:
    """0 .. count - 1, empty where count is not positive."""
    return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))


def fingerprints(words: str = "h") -> Column:
    """The (fingerprint, place) of each GRAM words of an array of word hashes, packed in one long."""
    h = F.col(words)
    low = (1 << PLACE_BITS) - 1
    return F.transform(_steps(F.size(h) - (GRAM - 1)), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(GRAM)]).bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long")))


def winnowed(grams: str = "g") -> Column:
    """The least of each WINDOW in turn."""
    g = F.col(grams)
    return F.transform(_steps(F.size(g) - (WINDOW - 1)), lambda i: F.least(*[F.get(g, i + k) for k in range(WINDOW)]))


def _slot(fp: Column) -> Column:
    return fp.bitwiseAND(F.lit(SLOTS - 1)).cast("int")


def _filled(fp: Column, table: bytes | None) -> Column:
    return F.lit(True) if table is None else F.substring(F.lit(table), _slot(fp) + 1, F.lit(1)) == F.lit(b"\1")


def slots(fps: DataFrame) -> bytes:
    """SLOTS bytes: 1 where a fingerprint falls."""
    out = bytearray(SLOTS)
    pages = fps.select(_slot(F.col("fp")).alias("s")).distinct().groupBy(F.shiftright("s", 10).alias("page")).agg(F.collect_list(F.col("s").bitwiseAND(F.lit(1023))).alias("own"))
    for r in pages.toLocalIterator():
        for s in r.own:
            out[(r.page << 10) + s] = 1
    return bytes(out)


def marked(df: DataFrame, keep: list[str], table: bytes | None) -> DataFrame:
    """The kept columns, h, and marks: the winnowed fingerprints (fp, place) in filled slots, with c: the 12 word hashes from GRAM before the place to GRAM after its words (null beyond the text)."""
    df = df.select(*keep, "h", fingerprints().alias("g")).select(*keep, "h", winnowed().alias("m"))
    m, fp = F.col("m"), (lambda x: F.shiftright(x, PLACE_BITS))
    # Equal minima of neighbouring windows are one fingerprint.
    df = df.select(*keep, "h", F.filter(m, lambda x, i: ((i == 0) | (x != F.get(m, i - 1))) & _filled(fp(x), table)).alias("x"))
    place = lambda x: x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")
    around = lambda p: F.array(*[F.get(F.col("h"), p + k) for k in range(-GRAM, 2 * GRAM)])
    return df.select(*keep, "h", F.transform("x", lambda x: F.struct(fp(x).alias("fp"), place(x).alias("place"), around(place(x)).alias("c"))).alias("marks"))


def short_runs(lengths: list[int], table: bytes | None) -> Column:
    """The runs (length, fp, place) of so many words of h, in filled slots."""
    h = F.col("h")

    def run(n: int) -> Column:
        every = F.transform(_steps(F.size(h) - (n - 1)), lambda i: F.struct(F.lit(n).alias("length"), F.xxhash64(*[F.get(h, i + k) for k in range(n)]).alias("fp"), i.alias("place")))
        return F.filter(every, lambda x: _filled(x["fp"], table))

    return F.concat(*[run(n) for n in lengths])


def _reach(mine: str, other: str, offsets: range) -> Column:
    """How many of the words at these offsets in turn are equal."""
    out = F.lit(len(offsets))
    for n, k in reversed(list(enumerate(offsets))):
        same = F.coalesce(F.get(F.col(mine), F.lit(k)) == F.get(F.col(other), F.lit(k)), F.lit(False))
        out = F.when(~same, F.lit(n)).otherwise(out)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, least_items: int = 2, broadcast_rows: int = BROADCAST_ROWS, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated (and the carried columns) for each row of docs (doc_id, text)."""
    with Scratch(docs.sparkSession) as scratch:
        read, result = _found(docs, benchmark, broadcast_rows, carry, scratch)
    zero = F.lit(0).cast("long")
    result = F.broadcast(result) if result.count() <= RESULT_ROWS else result
    return read.join(result, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (F.coalesce("n_items", zero) >= least_items).alias("contaminated"),
        *[F.col(f"carried_{c}").alias(c) for c in carry],
    )


def _found(docs: DataFrame, benchmark: DataFrame, broadcast_rows: int, carry: tuple[str, ...], scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Two tables that stay: the rows as they were read, and the results of those that have any."""
    items = benchmark.select("item_id", word_hashes(F.col("text")).alias("h")).select("item_id", "h", F.size("h").alias("size")).filter("size > 0")
    items = scratch(items, "decontam-items")
    long, short = items.filter(F.col("size") >= SPAN), items.filter(F.col("size") < SPAN)
    # Not explode: its filter on the size would be pushed below, and build all arrays again inside each other.
    marks = marked(long, ["item_id"], None).select("item_id", F.explode_outer("marks").alias("x")).select("item_id", "x.fp", F.col("x.c").alias("ic")).filter("fp is not null")
    marks = scratch(marks.groupBy("fp", "ic").agg(F.collect_set("item_id").alias("items")), "decontam-marks")
    lengths = sorted(r["size"] for r in short.select("size").distinct().collect())
    carried = [f"carried_{c}" for c in carry]
    read = docs.select("doc_id", word_hashes(F.col("text")).alias("h"), *[F.col(c).alias(n) for c, n in zip(carry, carried, strict=True)])
    read = marked(read, ["doc_id", *carried], slots(marks))
    found_runs = F.array().cast("array<struct<length:int,fp:bigint,place:int>>")
    if lengths:
        own = short.select("item_id", "size", F.explode_outer(short_runs(lengths, None)).alias("x")).filter("x.length = size")
        runs = scratch(own.groupBy("x.length", "x.fp").agg(F.collect_set("item_id").alias("items")), "decontam-runs")
        found_runs = short_runs(lengths, slots(runs))
    read = read.select(F.monotonically_increasing_id().alias("row"), "doc_id", *carried, F.size("h").cast("long").alias("n_words"), "marks", found_runs.alias("runs"))
    read = stash(read, "decontam-read")
    side = (lambda df: F.broadcast(df) if df.count() <= broadcast_rows else df)
    met = read.select("row", F.explode("marks").alias("x")).select("row", "x.*").join(side(marks), "fp")
    a, b = _reach("c", "ic", range(GRAM - 1, -1, -1)), _reach("c", "ic", range(2 * GRAM, 3 * GRAM))
    same = _reach("c", "ic", range(GRAM, 2 * GRAM)) == GRAM
    found = met.filter(same & (a + b + GRAM >= SPAN)).select("row", "items", (F.col("place") - a).alias("first"), (F.col("place") + GRAM - 1 + b).alias("last"))
    if lengths:
        more = read.select("row", F.explode("runs").alias("x")).select("row", "x.*").join(side(runs), ["length", "fp"])
        found = found.unionByName(more.select("row", "items", F.col("place").alias("first"), (F.col("place") + F.col("length") - 1).alias("last")))
    found = scratch(found, "decontam-hits")
    words = found.select("row", F.explode(F.sequence("first", "last")).alias("w")).distinct().groupBy("row").agg(F.count("*").alias("n_hit"))
    ids = found.select("row", F.explode("items").alias("item")).distinct().groupBy("row").agg(F.sort_array(F.collect_list(F.col("item").cast("string"))).alias("ids"))
    result = words.join(ids, "row", "left").select("row", "n_hit", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "ids"), 256).alias("items_sha256"))
    return read, stash(result, "decontam-result")


CONTAMINATION_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
i AS (
  SELECT item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 8) AS n, w[p:p + least(len(w), 8) - 1] AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 8) + 2)) AS p FROM i WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
found AS (
  SELECT r, p, n, item_id
  FROM (SELECT r, n, p, w[p:p + n - 1] AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, lengths WHERE len(w) >= n)) JOIN windows USING (n, g)),
hit AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS k FROM (SELECT DISTINCT r, p, n FROM found)) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS x FROM found WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""
