"""Documents that hold claims, in one pass over the documents, and lexical scores of their spans."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.functions.similarity import Profile, angle, share_of_terms, terms
from attestor.operators import parsing

#: A document's claims: (id, text), each held by its text.
Held = list[tuple[int, str]]
CASES = "claim_id long, claim string, doc_id long, document_id string"
_CASES = pa.schema([("claim_id", pa.int64()), ("claim", pa.string()), ("doc_id", pa.int64()), ("document_id", pa.string())])
_SPANS = pa.schema([("claim_id", pa.int64()), ("claim", pa.string()), *parsing.TYPES, ("gold", pa.bool_())])
_BM25 = pa.schema([("claim_id", pa.int64()), ("span_id", pa.string()), ("score", pa.float64())])
_BLANK = re.compile(r"[\t\n\f\r ]+")


def holding(docs: DataFrame, claims: DataFrame) -> DataFrame:
    """claim_id, claim, doc_id, document_id: the documents that hold a claim's text."""
    return _of_held(docs, claims, lambda i, _, held: [{"claim_id": c, "claim": t, "doc_id": i, "document_id": None if i is None else str(i)} for c, t in held], CASES, _CASES)


def held_spans(docs: DataFrame, claims: DataFrame) -> DataFrame:
    """claim_id and claim beside each span of the documents that hold it, and whether the span holds it too (gold)."""

    def made(doc_id: int | None, text: str, held: Held) -> list[dict]:
        own = parsing.spans_of(str(doc_id), text) if doc_id is not None else []
        return [s | {"claim_id": c, "claim": t, "gold": t in s["text"]} for c, t in held for s in own]

    return _of_held(docs, claims, made, f"claim_id long, claim string, {parsing.SCHEMA}, gold boolean", _SPANS)


def bm25(docs: DataFrame, claims: DataFrame) -> DataFrame:
    """claim_id, span_id, score: BM25 of each claim over the spans of each document that holds it, as shares of the greatest. Spans without a common term have none."""

    def made(doc_id: int | None, text: str, held: Held) -> list[dict]:
        own = [(s["span_id"], terms(s["text"])) for s in (parsing.spans_of(str(doc_id), text) if doc_id is not None else [])]
        bags = [Counter(ts) for _, ts in own]
        mean = sum(len(ts) for _, ts in own) / len(own) if own else 0.0
        met = Counter(t for bag in bags for t in bag)
        out = []
        for c, claim in held:
            asked = [(t, math.log(1 + (len(own) - met[t] + 0.5) / (met[t] + 0.5))) for t in dict.fromkeys(terms(claim)) if t in met]
            raw = [(span, sum(w * (bag[t] * 2.5) / (bag[t] + 1.5 * (1 - 0.75 + 0.75 * len(ts) / mean)) for t, w in asked if t in bag)) for (span, ts), bag in zip(own, bags, strict=True) if any(t in bag for t, _ in asked)]
            most = max((v for _, v in raw), default=0.0)
            out += [{"claim_id": c, "span_id": span, "score": v / most} for span, v in raw]
        return out

    return _of_held(docs, claims, made, "claim_id long, span_id string, score double", _BM25)


def _of_held(docs: DataFrame, claims: DataFrame, made: Callable[[int | None, str, Held], list[dict]], schema: str, types: pa.Schema) -> DataFrame:
    """What is made of each document that holds claims: docs (doc_id, text), claims (item_id, text).

    A text that holds a claim has each inner word of the claim as a word of its own, so claims are looked up by their
    longest one; claims without inner words are looked for in all texts.
    """
    by_word: dict[str | None, Held] = {}
    for r in claims.filter("text is not null").select("item_id", "text").toLocalIterator():
        inner = r.text.split()[1:-1]
        by_word.setdefault(max(inner, key=len) if inner else None, []).append((r.item_id, r.text))
    shared = docs.sparkSession.sparkContext.broadcast(by_word)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_word = shared.value
        for batch in batches:
            rows: list[dict] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text is None:
                    continue
                asked = [c for w in by_word.keys() & {None, *text.split()} for c in by_word[w]]
                held = [(c, t) for c, t in asked if t in text]
                if held:
                    rows += made(doc_id, text, held)
                if len(rows) > 10_000:
                    yield parsing.columns(rows, types)
                    rows = []
            yield parsing.columns(rows, types)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


class Soft(Profile):
    """A profile whose runs of characters leave white space that isn't ASCII as it is; an empty text has one empty run."""

    __slots__ = ()

    def __init__(self, text: str) -> None:
        super().__init__(text, _BLANK.sub(" ", text.lower()).strip(" "))
        if not self.grams:
            self.grams, self.grams_length = Counter([""]), 1.0


def _cosine(a: Counter, la: float, b: Counter, lb: float) -> float:
    """As in SQL, where the lesser of 1 and an unknown angle is 1: a text without terms is like any other."""
    return angle(a, la, b, lb) if a and b else 1.0


def soft(pairs: DataFrame) -> DataFrame:
    """claim_id, span_id, similarity and exact_phrase of pairs (claim_id, claim, span_id, text): the weighted sum of four likenesses, and the share of the claim's terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claims: dict[str, Soft] = {}
        for batch in batches:
            out: tuple[list, list] = ([], [])
            for claim, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if claim not in claims:
                    if len(claims) > 1 << 10:
                        claims.clear()
                    claims[claim] = Soft(claim)
                a, b = claims[claim], Soft(text or "")
                both = len(a.bag.keys() & b.bag.keys())
                either = len(a.bag) + len(b.bag) - both
                exact = share_of_terms(a, b)
                out[0].append(0.48 * _cosine(a.bag, a.bag_length, b.bag, b.bag_length) + 0.18 * (both / either if either else 0.0) + 0.20 * _cosine(a.grams, a.grams_length, b.grams, b.grams_length) + 0.14 * exact)
                out[1].append(exact)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out[0], pa.float64()), pa.array(out[1], pa.float64())], ["claim_id", "span_id", "similarity", "exact_phrase"])

    return pairs.select("claim_id", "span_id", "claim", "text").mapInArrow(run, "claim_id long, span_id string, similarity double, exact_phrase double")
