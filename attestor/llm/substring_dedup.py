"""Substring dedup by hashed units.

A text's lines are cut further at sentence ends, so that a passage is found whatever line it stands in. Units of
`least_words` words or more are normalised (case and white space) and hashed to 128 bits. The digests are grouped over
the whole corpus; the occurrence of the earliest rank (doc_id, then place) stays, and every other one is removed. A
shorter unit is hashed with its neighbours: the least run of units that starts with it, and the least that ends with
it, of `least_words` words or more; a text with fewer words is one run, which meets whole texts only. Runs that overlap
their own earliest occurrence leave it whole. A short unit also goes when the units on both sides of it go.

Only passages go: a run of neighbouring units that an earlier place has counts from `least_run` words on, or where it
is the whole text. A sentence that two documents happen to share stays.

Digests are written once, pre-aggregated before they are shuffled, and a digest that a third of all rows share is one row
on the grouped side, so its join splits. Rows with equal doc_id and text are one document and get the same result.

Defined results: a null or empty text has no units and comes back empty; null ids rank last, and ties of ids go by a hash
of the text, then by place; very long texts are cut whole, a slice of whole texts at a time; an empty table gives an
empty result; columns beside doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import re
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts, stash

GAP = re.compile(r"(?<=[.!?])\s+|\s*\n\s*")
LEAST_WORDS, LEAST_RUN = 5, 20


def units(text: str) -> list[tuple[int, int, int]]:
    """(start, end, words) of each unit in code points, in order, without the white space around them."""
    out, at = [], len(text) - len(text.lstrip())
    for m in GAP.finditer(text, at):
        if m.start() > at:
            out.append((at, m.start(), len(text[at : m.start()].split())))
        at = m.end()
    end = len(text.rstrip())
    if end > at:
        out.append((at, end, len(text[at:end].split())))
    return out


def digest(run: list[str], mark: str = "") -> bytes:
    return blake2b((mark + "\n".join(run)).encode(), digest_size=16).digest()


def document_key() -> Column:
    """128 bits of id and text."""
    return F.unhex(F.md5(F.concat_ws("\0", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce("text", F.lit("")))))


def runs(words: list[int], least: int) -> set[tuple[int, int]]:
    """(first unit, number of units) of what is hashed: long units, and the least runs that start or end with a short one."""
    if sum(words) < least:
        return {(0, len(words))} if words else set()
    out = set()
    for i, n in enumerate(words):
        if n >= least:
            out.add((i, 1))
            continue
        for step in (1, -1):
            k, held = i, n
            while held < least and 0 <= k + step < len(words):
                k += step
                held += words[k]
            if held >= least:
                out.add((min(i, k), abs(k - i) + 1))
    return out


def _hashed(texts: list[bytes], least: int) -> dict:
    rows = []
    for t in texts:
        text = t.decode()
        found = units(text)
        plain = [" ".join(text[a:b].lower().split()) for a, b, _ in found]
        words = [n for _, _, n in found]
        mark = "\0" if sum(words) < least else ""
        rows.append([{"digest": digest(plain[i : i + k], mark), "place": i, "size": k} for i, k in sorted(runs(words, least))])
    return {"units": pa.array(rows, pa.list_(pa.struct([("digest", pa.binary()), ("place", pa.int32()), ("size", pa.int32())])))}


def _spans(text: str, gone: set[int], least: int, least_run: int) -> list[tuple[int, int]]:
    found = units(text)
    for i in range(1, len(found) - 1):
        if found[i][2] < least and i - 1 in gone and i + 1 in gone:
            gone.add(i)
    for i in sorted(gone):
        if i - 1 in gone:
            continue
        end = next(k for k in range(i + 1, len(found) + 1) if k not in gone)
        if sum(n for _, _, n in found[i:end]) < least_run and end - i < len(found):
            gone.difference_update(range(i, end))
    out: list[tuple[int, int]] = []
    for i in sorted(gone):
        if i - 1 in gone and out:
            out[-1] = (out[-1][0], found[i][1])
        else:
            out.append((found[i][0], found[i][1]))
    return out


def remove_repeats(docs: DataFrame, least_words: int = LEAST_WORDS, least_run: int = LEAST_RUN) -> DataFrame:
    """doc_id, n_units, n_removed, n_removed_chars, removed (start and end offsets in the original text), text (what stays) for each row of docs (doc_id, text)."""
    # Rows are told apart by this and doc_id together.
    row = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce("text", F.lit("")))
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), row.alias("row"))
    marks = map_texts(keyed, ["doc_id", "row"], "text", lambda t: _hashed(t, least_words), "units array<struct<digest:binary,place:int,size:int>>")
    marks = stash(marks, "substring-marks")
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row", "place")
    marks = marks.select("doc_id", "row", F.explode("units").alias("u")).select("doc_id", "row", "u.*")
    first = marks.groupBy("digest").agg(F.min(rank).alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    later = marks.join(first, "digest").filter(rank != F.col("first"))
    end = F.col("place") + F.col("size") - 1
    start = F.when((F.col("first.row") == F.col("row")) & F.col("first.doc_id").eqNullSafe(F.col("doc_id")), F.greatest("place", F.col("first.place") + F.col("size"))).otherwise(F.col("place"))
    later = later.select("row", "doc_id", F.explode(F.when(start <= end, F.sequence(start, end))).alias("place"))
    gone = later.groupBy("row", F.col("doc_id").alias("id")).agg(F.collect_set("place").alias("gone")).withColumnRenamed("row", "key")

    def cut(batches):
        from .common import native_rows

        for piece, texts in native_rows(batches, "text"):
            places = piece.column(piece.schema.get_field_index("gone")).to_pylist()
            counts, removed, left, chars = [], [], [], []
            for raw, p in zip(texts, places, strict=True):
                text = raw.decode()
                own = set(p or ())
                spans = _spans(text, own, least_words, least_run) if own else []
                keep, at = [], 0
                for a, b in spans:
                    keep.append(text[at:a])
                    at = b
                counts.append((len(units(text)), len(own)))
                left.append("".join([*keep, text[at:]]))
                removed.append([{"start": a, "end": b} for a, b in spans])
                chars.append(sum(b - a for a, b in spans))
            yield pa.RecordBatch.from_arrays(
                [piece.column(piece.schema.get_field_index("doc_id")), pa.array([c[0] for c in counts], pa.int64()), pa.array([c[1] for c in counts], pa.int64()), pa.array(chars, pa.int64()),
                 pa.array(removed, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(left, pa.string())],
                ["doc_id", "n_units", "n_removed", "n_removed_chars", "removed", "text"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    joined = keyed.join(gone, (F.col("row") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("id")), "left").select("doc_id", "text", "gone")
    return joined.mapInArrow(cut, f"doc_id {kind}, n_units long, n_removed long, n_removed_chars long, removed array<struct<start:int,end:int>>, text string")
