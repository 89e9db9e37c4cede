"""Line dedup by pairwise alignment.

Lines are hashed to 128 bits, white space around them aside. Documents that share a line of `least_words` words or more,
or a run of shorter lines that has as many together, overlap; each later one is paired with the earliest document that has the line, not with every other one, so the
pairs grow with the repeated lines and no group is expanded: the earliest document is how a line that thousands share
stays as cheap as a rare one, without a cap on either. Each pair is aligned by patience diff over all lines, short ones
included, and by a longest common subsequence where no line is unique; aligned common blocks of `least_words` words or
more are deleted from the later document. Common blocks that no one alignment holds, since the later document repeats
them or has them in another order, are deleted too.

Only hashes travel; the texts are shuffled once, to meet the line numbers that go. Rows with equal doc_id and text are
one document and get the same result. Order is by doc_id, null last, then by text hash.

Defined results: a null or empty text has no lines and stays as it is; very long texts are aligned whole; ties of ids go
by the hash of id and text; an empty table gives an empty result; other columns can be carried, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash
from .substring_dedup import document_key

LEAST_WORDS = 8
#: White space around a line, which doesn't count.
WHITE = " \t\r\x0b\x0c"


def anchors(a: list, b: list, alo: int, ahi: int, blo: int, bhi: int) -> list[tuple[int, int]]:
    """Lines that are unique on both sides, in the longest common order."""
    ca, cb = Counter(a[alo:ahi]), Counter(b[blo:bhi])
    at = {x: i for i, x in enumerate(a[alo:ahi], alo) if ca[x] == 1}
    pairs = [(at[x], j) for j, x in enumerate(b[blo:bhi], blo) if cb[x] == 1 and x in at]
    tops: list[int] = []
    last: list[int] = []
    back: list[int] = []
    for k, (i, _) in enumerate(pairs):
        p = bisect_left(tops, i)
        back.append(last[p - 1] if p else -1)
        if p == len(tops):
            tops.append(i)
            last.append(k)
        else:
            tops[p], last[p] = i, k
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def subsequence(a: list, b: list, alo: int, ahi: int, blo: int, bhi: int) -> list[tuple[int, int]]:
    """A longest common subsequence, a row of the table in the bits of one integer (0: longer here than one line of b before)."""
    both = set(a[alo:ahi]) & set(b[blo:bhi])
    left, right = [i for i in range(alo, ahi) if a[i] in both], [j for j in range(blo, bhi) if b[j] in both]
    places: dict = {}
    for k, j in enumerate(right):
        places[b[j]] = places.get(b[j], 0) | 1 << k
    whole = (1 << len(right)) - 1
    rows, now = [], whole
    for i in left:
        u = now & places[a[i]]
        now = ((now + u) | (now - u)) & whole
        rows.append(now)
    out, x, y = [], len(left), len(right)
    while x and y:
        if rows[x - 1] >> (y - 1) & 1:
            y -= 1
            continue
        x -= 1
        if not x or rows[x - 1] >> (y - 1) & 1:
            y -= 1
            out.append((left[x], right[y]))
    return out


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned equal lines (i, j): equal heads and tails, then unique common lines, then the same between them; a longest common subsequence where none is unique."""
    out: list[tuple[int, int]] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        alo, ahi, blo, bhi = work.pop()
        while alo < ahi and blo < bhi and a[alo] == b[blo]:
            out.append((alo, blo))
            alo, blo = alo + 1, blo + 1
        while alo < ahi and blo < bhi and a[ahi - 1] == b[bhi - 1]:
            ahi, bhi = ahi - 1, bhi - 1
            out.append((ahi, bhi))
        if alo == ahi or blo == bhi:
            continue
        marks = anchors(a, b, alo, ahi, blo, bhi)
        if not marks:
            out += subsequence(a, b, alo, ahi, blo, bhi)
            continue
        for (i, j), (k, m) in zip([(alo - 1, blo - 1), *marks], [*marks, (ahi, bhi)], strict=True):
            if k < ahi:
                out.append((k, m))
            work.append((i + 1, k, j + 1, m))
    return sorted(out)


def seeds(words: list, least: int) -> list[tuple[int, int]]:
    """First and last line of the least blocks of enough words: long lines, and runs that start with each short one; None among words ends a run."""
    out = []
    for j, n in enumerate(words):
        k, held = j, n or 0
        while 0 < held < least and k + 1 < len(words) and words[k + 1] is not None and words[k + 1] < least:
            k += 1
            held += words[k]
        if held >= least:
            out.append((j, k))
    return out


def common_lines(a: list, b: list, words: list[int], least: int) -> list[int]:
    """The lines of b in aligned blocks of enough words, and in common blocks of so many that the alignment leaves."""
    gone: set[int] = set()
    block: list[tuple[int, int]] = []
    for x in [*patience(a, b), (-9, -9)]:
        if block and (x[0] != block[-1][0] + 1 or x[1] != block[-1][1] + 1):
            if sum(words[j] for _, j in block) >= least:
                gone.update(j for _, j in block)
            block = []
        block.append(x)
    rest = [(j, k) for j, k in seeds(words, least) if any(x not in gone for x in range(j, k + 1))]
    if rest:
        size, starts = dict(zip(b, words, strict=True)), {}
        for i, k in seeds([size.get(x) for x in a], least):
            starts.setdefault(tuple(a[i : k + 1]), []).append(i)
        for j, k in rest:
            first = starts.get(tuple(b[j : k + 1]), [])
            if first:
                gone.update(range(j, k + 1))
            for y, step in ((k, 1), (j, -1)):
                at = [i + y - j for i in first]
                while at and 0 <= y + step < len(b) and words[y + step] < least:
                    y += step
                    at = [i + step for i in at if 0 <= i + step < len(a) and a[i + step] == b[y]]
                    if at:
                        gone.add(y)
    return sorted(gone)


def slices(batches: Iterator[pa.RecordBatch], lines: str, most: int = 100_000) -> Iterator[pa.RecordBatch]:
    """Slices of at most so many lines (one row at least)."""
    for batch in batches:
        start, held = 0, 0
        for i, n in enumerate(pc.fill_null(pc.list_value_length(batch.column(batch.schema.get_field_index(lines))), 0).to_pylist()):
            if i > start and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


def keys(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """A row for each distinct long line, and run of short lines, of a document."""
    for part in slices(batches, "h"):
        rows = part.select(["h", "n"]).to_pydict()
        at, found = [], []
        for x, (h, n) in enumerate(zip(rows["h"], rows["n"], strict=True)):
            own = {h[i] if i == e else blake2b(b"".join(h[i : e + 1]), digest_size=16).digest() for i, e in seeds(n, least)}
            at += [x] * len(own)
            found += own
        kept = part.select(["row", "doc_id"]).take(pa.array(at, pa.int64()))
        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(found, pa.binary())], ["row", "doc_id", "h"])


def dedup_lines(docs: DataFrame, least_words: int = LEAST_WORDS, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_lines, n_removed, removed (line numbers from 0), text (what stays), and the carried columns, for each row of docs (doc_id, text)."""
    keyed = docs.select(document_key().alias("row"), "doc_id", "text", *[F.col(c).alias(f"carried_{c}") for c in carry])
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    hashes = F.transform(lines, lambda x: F.unhex(F.md5(F.btrim(x, F.lit(WHITE)))))
    words = F.transform(lines, lambda x: F.regexp_count(x, F.lit(r"\S+")))
    table = stash(keyed.select("row", "doc_id", hashes.alias("h"), words.alias("n")), "line-hashes")
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    kind = docs.schema["doc_id"].dataType.simpleString()
    each = table.mapInArrow(lambda batches: keys(batches, least_words), f"row binary, doc_id {kind}, h binary").select("row", rank.alias("rank"), "h")
    first = each.groupBy("h").agg(F.min("rank").alias("first"), F.count("*").alias("docs")).filter("docs > 1")
    met = each.join(first, "h").filter(F.col("rank") != F.col("first"))
    pairs = met.select("row", F.col("first.row").alias("other")).distinct()
    plain = table.select("row", "h", "n").dropDuplicates(["row"])
    sides = pairs.join(plain.select(F.col("row").alias("other"), F.col("h").alias("earlier")), "other").join(plain, "row").select("row", "earlier", "h", "n")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "earlier"):
            for part in slices(iter([batch]), "h"):
                rows = part.to_pydict()
                gone = [common_lines(a, b, n, least_words) for a, b, n in zip(rows["earlier"], rows["h"], rows["n"], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(rows["row"], pa.binary()), pa.array(gone, pa.list_(pa.int32()))], ["row", "gone"])

    gone = sides.mapInArrow(align, "row binary, gone array<int>").select("row", F.explode("gone").alias("line")).groupBy("row").agg(F.sort_array(F.collect_set("line")).alias("removed"))
    none = F.array().cast("array<int>")
    joined = keyed.join(gone, "row", "left").withColumn("removed", F.coalesce("removed", none))
    rest = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("removed", i)), "\n")
    return joined.select(
        "doc_id", F.when(F.coalesce("text", F.lit("")) == "", 0).otherwise(F.size(lines)).alias("n_lines"), F.size("removed").alias("n_removed"), "removed",
        F.when(F.size("removed") == 0, F.col("text")).otherwise(rest).alias("text"), *[F.col(f"carried_{c}").alias(c) for c in carry],
    )
