"""Each claim's first spans by the share of its terms, in one pass over the spans.

Claims are a stated query set: every worker has the claims of each of their terms. A task counts the terms that its
spans have in common with claims, and only its first `limit` spans for each claim go on, so what is shuffled grows with
the tasks and claims, neither with the spans nor with the pairs of claims and spans.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestor.functions.similarity import term_of, terms, words
from attestor.operators import parsing

#: Spans that are counted at a time, pairs of spans and claims that a table of counts has at most, and words that are remembered.
ROWS, CELLS, WORDS = 4096, 1 << 21, 1 << 18
OWN = pa.schema([("span_id", pa.string()), ("document_id", pa.string()), ("ordinal", pa.int32()), ("parent_id", pa.string())])


def first_spans(spans: DataFrame, claims: DataFrame, limit: int = 30) -> DataFrame:
    """claim_id, span_id, document_id, ordinal, parent_id, k (terms in common), n (the claim's terms), rank: by share, then children first, then document and place.

    spans (span_id, document_id, ordinal, parent_id, text), claims (claim_id, claim). Spans without a common term are no candidates.
    """

    def add(best: _Best, batch: pa.RecordBatch) -> None:
        best.add(batch.drop_columns(["text"]), [best.terms(x or "") for x in batch.column(4).to_pylist()])

    return _first(spans.select(*OWN.names, "text"), claims, limit, add)


def first_in_documents(documents: DataFrame, claims: DataFrame, limit: int = 30) -> DataFrame:
    """The same of the documents' (document_id string, text) spans, which are parsed on the way; a span has the terms of the sentences it is cut into."""

    def add(best: _Best, batch: pa.RecordBatch) -> None:
        rows: list[dict] = []
        found: list[set[int]] = []
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = parsing.spans_of(i, text or "") if i is not None else []
            parts: dict[str, set[int]] = {}
            sets = []
            for s in reversed(own):
                got = parts.pop(s["span_id"], None)
                if got is None:
                    got = best.terms(s["text"])
                if s["parent_id"] is not None:
                    parts[s["parent_id"]] = parts[s["parent_id"]] | got if s["parent_id"] in parts else got
                sets.append(got)
            rows += own
            found += reversed(sets)
            if len(rows) >= ROWS:
                best.add(parsing.columns(rows, OWN), found)
                rows, found = [], []
        best.add(parsing.columns(rows, OWN), found)

    return _first(documents.select("document_id", "text"), claims, limit, add)


def _first(df: DataFrame, claims: DataFrame, limit: int, add: Callable[[_Best, pa.RecordBatch], None]) -> DataFrame:
    asked = [(r.claim_id, sorted(set(terms(r.claim or "")))) for r in claims.select("claim_id", "claim").toLocalIterator()]
    holders: dict[str, list[int]] = {}
    for i, (_, ts) in enumerate(asked):
        for t in ts:
            holders.setdefault(t, []).append(i)
    vocabulary = {t: i for i, t in enumerate(holders)}
    ends = np.cumsum([0, *map(len, holders.values())])
    shared = df.sparkSession.sparkContext.broadcast((vocabulary, ends, np.array([c for cs in holders.values() for c in cs], np.int64), len(asked)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(*shared.value, limit)
        for whole in batches:
            gc.disable()  # rows have no cycles, and looking for some costs more than making them
            for at in range(0, whole.num_rows, ROWS):
                add(best, whole.slice(at, ROWS))
            gc.enable()
        yield from best.result()

    found = df.mapInArrow(run, "claim int, span_id string, document_id string, ordinal int, parent_id string, k int")
    names = df.sparkSession.createDataFrame([(i, c, len(ts)) for i, (c, ts) in enumerate(asked)], f"claim int, claim_id {claims.schema['claim_id'].dataType.simpleString()}, n int")
    order = W.partitionBy("claim").orderBy(F.desc("k"), F.col("parent_id").isNull(), "document_id", "ordinal")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    return ranked.join(F.broadcast(names), "claim").select("claim_id", *OWN.names, "k", "n", "rank")


class _Places(dict[str, int]):
    """Of words that were met, the place of their term among the claims' terms; -1 where no claim has it."""

    def __init__(self, vocabulary: dict[str | None, int]) -> None:
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> int:
        if len(self) >= WORDS:
            self.clear()
        self[word] = at = self.vocabulary.get(term_of(word), -1)
        return at


class _Best:
    """The first spans of each claim among those that were added."""

    def __init__(self, vocabulary: dict[str, int], ends: np.ndarray, holders: np.ndarray, n: int, limit: int) -> None:
        self.ends, self.holders, self.n, self.limit = ends, holders, n, limit
        self.places = _Places(vocabulary)
        #: By claim, the count below which a span can't be among the first any more.
        self.least = np.ones(n, np.int64)
        self.claim, self.k, self.rows = np.zeros(0, np.int64), np.zeros(0, np.int64), None

    def terms(self, text: str) -> set[int]:
        return set(map(self.places.__getitem__, words(text))) - {-1}

    def add(self, batch: pa.RecordBatch, found: list[set[int]]) -> None:
        """The texts stay behind: long ones have the most terms in common."""
        step = max(1, CELLS // max(1, self.n))
        for at in range(0, len(found) if self.n else 0, step):
            part = found[at : at + step]
            row = np.repeat(np.arange(len(part)), [len(f) for f in part])
            word = np.fromiter((w for f in part for w in f), np.int64, len(row))
            size = self.ends[word + 1] - self.ends[word]
            first = np.cumsum(size) - size
            claim = self.holders[np.arange(size.sum()) + np.repeat(self.ends[word] - first, size)]
            common = np.bincount(np.repeat(row, size) * self.n + claim, minlength=len(part) * self.n).reshape(len(part), self.n)
            spans, claim = np.nonzero(common >= self.least)
            if len(spans):
                used, to = np.unique(spans, return_inverse=True)
                self._keep(claim, common[spans, claim], batch.take(pa.array(used + at)), to)

    def _keep(self, claim: np.ndarray, k: np.ndarray, rows: pa.RecordBatch, to: np.ndarray) -> None:
        before = 0 if self.rows is None else self.rows.num_rows
        self.rows = pa.Table.from_batches([rows]) if self.rows is None else pa.concat_tables([self.rows, pa.Table.from_batches([rows])])
        self.at = to if not before else np.concatenate([self.at, to + before])
        self.claim, self.k = np.concatenate([self.claim, claim]), np.concatenate([self.k, k])
        if len(self.k) > 4 * self.limit * self.n:
            self._cut()

    def _cut(self) -> None:
        column = lambda n: self.rows.column(n).combine_chunks()
        document = np.unique(np.array(column("document_id").to_pylist(), object), return_inverse=True)[1][self.at]
        ordinal, whole = column("ordinal").to_numpy(zero_copy_only=False)[self.at], column("parent_id").is_null().to_numpy(zero_copy_only=False)[self.at]
        order = np.lexsort((ordinal, document, whole, -self.k, self.claim))
        claim = self.claim[order]
        starts = np.searchsorted(claim, np.arange(self.n))
        place = np.arange(len(claim)) - starts[claim]
        order, last = order[place < self.limit], order[place == self.limit - 1]
        self.least[self.claim[last]] = self.k[last]
        used, at = np.unique(self.at[order], return_inverse=True)
        self.claim, self.k, self.at, self.rows = self.claim[order], self.k[order], at, self.rows.take(pa.array(used)).combine_chunks()

    def result(self) -> Iterator[pa.RecordBatch]:
        if self.rows is None:
            return
        self._cut()
        rows = self.rows.select(OWN.names).take(pa.array(self.at)).combine_chunks()
        out = pa.table([pa.array(self.claim.astype(np.int32)), *rows.columns, pa.array(self.k.astype(np.int32))], ["claim", *OWN.names, "k"])
        yield from out.to_batches(ROWS)
