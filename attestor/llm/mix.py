"""Mixing sources to target weights.

Every document gets a hash-random key. Within its source, documents are in key order, and a source's budget is spent on
that order: whole epochs first, then the documents from the start until the words reach the budget exactly. The prefix
sums are distributed: the keys are uniform, so their leading bits range-partition a source into buckets of about
`bucket_rows` rows; sums by bucket give each bucket's offset, and a running sum inside the bucket does the rest. No
task ever holds a whole source, so a source with a third of all rows is as cheap a row as any other.

Defined results: a null text has size 0; null sources form one source, last in order; rows that repeat are separate
documents; null ids share one key, and ties of keys go by id, then size; very long texts count like any other; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, stash

KEY_BITS = 60


def key_of(doc_id: Column) -> Column:
    """60 bits of md5, as both Spark and other SQL engines can compute it."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """One row a source: source_key, rows, source_size, target. The targets share all words by weight; what a source can't take (over max_epochs times its size) goes to the others by weight.

    With the sources by ascending limit over weight, the level is the greatest of what is left after the sources before, per weight left.
    """
    by = sizes.groupBy("source").agg(F.count("*").alias("rows"), F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(x) for x in weights])
    by = by.withColumn("weight", F.element_at(cycle, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("long"))
    by = by.withColumn("most", F.col("source_size") * max_epochs)
    before = W.orderBy((F.col("most").cast("double") / F.col("weight")).asc(), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0))).cast("double") / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    by = by.withColumn("level", level)
    target = F.least(F.col("most").cast("double"), F.col("weight") * F.max("level").over(whole))
    return by.select("source", "rows", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, bucket_rows: int = 4096, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken (and the carried columns) for each row of docs (doc_id, text, source)."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    extra = [F.col(c).alias(f"carried_{c}") for c in carry]
    sizes = stash(docs.select("doc_id", "source", size.alias("size"), key_of(F.col("doc_id")).alias("key"), *extra), "mix-sizes")
    targets = source_targets(sizes, weights, max_epochs)
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("rows") / F.lit(float(bucket_rows))))).cast("int")
    tagged = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    budget = F.floor(F.col("target")).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("cast(floor(target) as bigint) div source_size")).otherwise(F.lit(0))
    plan = targets.select(
        tagged.alias("tag"), "source_size", "target", bits.alias("bits"), epochs.cast("long").alias("epochs"), (budget - epochs * F.col("source_size")).alias("rest")
    )
    rows = sizes.withColumn("tag", tagged).join(plan, "tag").withColumn("bucket", F.expr(f"shiftright(`key`, {KEY_BITS} - bits)"))
    sums = rows.groupBy("tag", "bucket").agg(F.sum("size").alias("words"))
    sums = sums.select("tag", "bucket", F.coalesce(F.sum("words").over(W.partitionBy("tag").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    inside = W.partitionBy("tag", "bucket").orderBy("key", F.col("doc_id"), "size").rowsBetween(W.unboundedPreceding, 0)
    before = F.col("offset") + F.sum("size").over(inside) - F.col("size")
    taken = F.col("epochs") * F.col("size") + F.least(F.greatest(F.col("rest") - before, F.lit(0)), F.col("size"))
    return rows.join(sums, ["tag", "bucket"]).select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), *[F.col(f"carried_{c}").alias(c) for c in carry])


MIX_SQL = """
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS k
  FROM documents),
by_source AS (
  SELECT source, sum(size)::BIGINT AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight
  FROM sizes GROUP BY source),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0))::DOUBLE
    / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::DOUBLE AS level
  FROM by_source
  WINDOW before AS (ORDER BY (3 * source_size)::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size, least((3 * source_size)::DOUBLE, weight * max(level) OVER ()) AS target FROM levels),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS epochs FROM targets),
placed AS (
  SELECT s.doc_id, s.size, p.source_size, p.target, p.epochs, floor(p.target)::BIGINT - p.epochs * p.source_size AS rest,
    (sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) - s.size)::BIGINT AS ahead
  FROM sizes s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, (epochs * size + least(greatest(rest - ahead, 0), size))::BIGINT AS taken FROM placed
"""
