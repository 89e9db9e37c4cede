"""Token counts by a map-side two-tier lookup.

No piece of the vocabulary has a word mark inside, or a line end anywhere, so no merge crosses from one unit (a run of
marks with the word after it, or a line end) into the next, and a text's count is the sum over its units. The first
tier is a broadcast table of frequent units' lengths, taken from a bounded random sample of rows; the second is a cache
in each worker, which encodes the units that it misses, in blocks. No unit is ever shuffled except those of the
sample. The sample decides only how many lookups hit the first tier; counts are exact whatever it holds.

Defined results: a null or empty text has 0 bytes and 0 tokens; null ids, ties and repeated rows are counted each; very
long texts are counted whole; an empty table gives an empty result; columns beside doc_id and text are ignored, whatever
their names.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

MARK = "▁"
UNIT = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
#: Rows in the sample that fills the first tier, and its greatest number of units.
SAMPLE_ROWS, TABLE_UNITS = 2_000, 1 << 16
#: Units that a worker's cache holds before it starts afresh.
CACHE_UNITS = 1 << 20


def units_of(text: str) -> list[str]:
    return UNIT.findall((MARK + text).replace(" ", MARK)) if text else []


def splits_exactly(model: str) -> bool:
    """Whether the model's vocabulary and normaliser allow counting by units."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    same = sp.normalize("ﬁ  Ａ\n é ") == f"{MARK}ﬁ{MARK}{MARK}Ａ\n{MARK}é{MARK}"
    return same and not any(re.search(f"[^{MARK}]{MARK}|\n", p) for p in pieces)


class Lengths:
    """Unit lengths: the broadcast tier, then this worker's cache."""

    def __init__(self, model: str, frequent: dict[str, int]) -> None:
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.frequent, self.known = frequent, dict(frequent)
        self.base = len(self.sp.encode("\n"))

    def encode(self, units: list[str]) -> list[int]:
        """A line end before the unit keeps the library's mark away from it."""
        return [len(x) - self.base for x in self.sp.encode(["\n" + u for u in units], num_threads=1)]

    def count(self, texts: list[str]) -> list[int]:
        split = [units_of(t) for t in texts]
        known = self.known
        missing = [u for u in set().union(*split) if u not in known]
        if len(known) + len(missing) > CACHE_UNITS:
            known = self.known = dict(self.frequent)
            missing = [u for u in set().union(*split) if u not in known]
        known.update(zip(missing, self.encode(missing), strict=True))
        return [sum(map(known.__getitem__, units)) for units in split]


_OPEN: dict[str, Lengths] = {}


def token_counts(docs: DataFrame, model: str, limit: int = 4096, sample_rows: int = SAMPLE_ROWS, table_units: int = TABLE_UNITS) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs (doc_id, text)."""
    if not splits_exactly(model):
        raise ValueError("the vocabulary has pieces that cross units; count whole texts instead")
    spark = docs.sparkSession
    rows = docs.count()
    sample = docs.select("text").sample(min(1.0, sample_rows / max(rows, 1)), seed=17)
    marked = F.translate(F.concat(F.lit(" "), F.col("text")), " ", MARK)
    seen = sample.select(F.explode(F.regexp_extract_all(marked, F.lit(UNIT.pattern), F.lit(0))).alias("unit"))
    seen = seen.filter(~F.contains("unit", F.lit("\0")))
    top = [r.unit for r in seen.groupBy("unit").count().orderBy(F.desc("count"), "unit").limit(table_units).collect()]
    lengths = Lengths(model, {}).encode(top)
    shared = spark.sparkContext.broadcast(("\0".join(top), bytes(min(x, 255) for x in lengths)))
    token = f"{model}/{id(shared)}"

    def setup() -> Lengths:
        if token not in _OPEN:
            _OPEN.clear()
            units, sizes = shared.value
            pairs = zip(units.split("\0"), sizes, strict=True) if sizes else ()
            _OPEN[token] = Lengths(model, {u: n for u, n in pairs if 0 < n < 255})
        return _OPEN[token]

    def count(texts: list[bytes], lengths: Lengths) -> dict:
        import numpy as np

        n = np.array(lengths.count([t.decode() for t in texts]), np.int64)
        return {"n_bytes": np.array([len(t) for t in texts], np.int64), "n_tokens": n, "over_limit": n > limit}

    return map_texts(docs, ["doc_id"], "text", count, "n_bytes long, n_tokens long, over_limit boolean", setup)
