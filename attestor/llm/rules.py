"""Quality rules with an isolation forest.

Each whole text gives rule statistics (counts, then ratios of them). A forest of random splits gives each text the mean
length of its paths: unusual texts part from the rest early. It is grown from all rows, level by level: every row is
led to its open node in each tree, and a node's cut is drawn from what its rows span. The score's threshold comes from
all labelled rows: the forest's verdict is a cut where rejecting texts labelled good costs `keep_cost` times as much as
keeping texts labelled bad. Two base rules reject regardless of the forest.

Nothing is sampled. Trees end at DEPTH, where a node of n rows counts as the usual depth of n more; so the forest's size
doesn't grow with the table, nor does what the driver holds (a span for each open node; a sum for each bucket of scores).

Defined results: a null or empty text has no words and fails the base rules; ties and repeated rows get equal results;
null ids are judged and never calibrate; very long texts are measured whole; other columns are ignored, whatever their
names; of labels that repeat an id the greatest counts; without rows labelled either way the forest rejects nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, map_texts, stash

SPACE, SYMBOLS = b"\t\n\v\f\r ", b"#*$%&|<>"
#: CUT_BUCKETS: parts of the scores' range whose sums the driver adds up.
TREES, DEPTH, FEATURES, KEEP_COST, CUT_BUCKETS = 100, 8, 11, 3.0, 4_096
_UPPER, _DIGIT, _PUNCT = re.compile(rb"[A-Z]+"), re.compile(rb"[0-9]+"), re.compile(rb"[!-/:-@\[-`{-~]+")
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_punct", "n_distinct", "n_bytes", "n_ends"]


def repeated_words(words: list[bytes]) -> tuple[int, int]:
    """How many words lie in three-word windows that occur twice or more, and how many words are distinct."""
    ids: dict[bytes, int] = {}
    at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    if len(words) < 4:
        return 0, len(ids)
    size = len(ids)
    windows = (at[:-2] * size + at[1:-1]) * size + at[2:] if size < 2_000_000 else np.unique(np.stack([at[:-2], at[1:-1], at[2:]], 1), axis=0, return_inverse=True)[1]
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    twice = np.zeros(len(windows), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = np.zeros(len(words), bool)
    for k in range(3):
        hit[k : k + len(twice)] |= twice
    return int(hit.sum()), size


def counts(raw: bytes) -> list[int]:
    words = raw.split()
    repeats, distinct = repeated_words(words)
    lines = [x for x in raw.split(b"\n") if x.strip(SPACE)]
    dense = raw.translate(None, SPACE)
    chars = len(dense.decode())
    return [
        len(words), chars, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeats, len(lines),
        sum(map(len, _UPPER.findall(raw))), sum(map(len, _DIGIT.findall(raw))), sum(map(len, _PUNCT.findall(raw))), distinct, len(raw),
        sum(x.rstrip(SPACE).endswith((b".", b"!", b"?", b'"')) for x in lines),
    ]


def features(c: np.ndarray) -> np.ndarray:
    """Ratios of a row's counts."""
    c = c.astype(float)
    words, chars, lines = np.maximum(c[:, 0], 1), np.maximum(c[:, 1], 1), np.maximum(c[:, 5], 1)
    return np.stack([
        np.log1p(c[:, 0]), chars / words, c[:, 2] / words, c[:, 3] / lines, c[:, 4] / words, c[:, 6] / chars, c[:, 7] / chars,
        c[:, 8] / words, c[:, 9] / words**0.8, c[:, 11] / lines, np.log1p(words / lines),
    ], 1)


def path_norm(n: int) -> float:
    return 0.0 if n < 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


class Forest:
    """Trees as flat arrays: feature (-1: none), threshold, left child, path length. Nodes above `first` are open: their rows decide how they part."""

    def __init__(self, total: int, trees: int = TREES, depth: int = DEPTH, seed: int = 7) -> None:
        self.roots, self.depth, self.seed, self.norm = trees if total else 0, depth, seed, max(path_norm(total), 1e-9)
        self.first, self.level = 0, 0
        self.feature, self.cut = np.full(self.roots, -1), np.zeros(self.roots)
        self.left, self.length = np.arange(self.roots), np.zeros(self.roots)

    def place(self, x: np.ndarray, root: int) -> np.ndarray:
        """Each row's node in a tree."""
        at, rows = np.full(len(x), root), np.arange(len(x))
        for _ in range(self.level):
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                break
            at = np.where(inner, self.left[at] + (x[rows, np.maximum(f, 0)] >= self.cut[at]), at)
        return at

    def spans(self, parts: Iterable[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each open node: how many of these rows it has, and their least and greatest features."""
        n = len(self.feature) - self.first
        size, low, high = np.zeros(n, np.int64), np.full((n, FEATURES), np.inf), np.full((n, FEATURES), -np.inf)
        for x in parts:
            for root in range(self.roots):
                at = self.place(x, root) - self.first
                order = np.argsort(at, kind="stable")
                order = order[np.searchsorted(at[order], 0) :]
                if not len(order):
                    continue
                begins = np.flatnonzero(np.r_[True, at[order][1:] != at[order][:-1]])
                node, own = at[order[begins]], x[order]
                size[node] += np.diff(np.r_[begins, len(order)])
                low[node] = np.minimum(low[node], np.minimum.reduceat(own, begins, axis=0))
                high[node] = np.maximum(high[node], np.maximum.reduceat(own, begins, axis=0))
        return size, low, high

    def part(self, size: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """Parts the open nodes by a random cut of a random feature, as their rows span it; at the full depth they stay."""
        rng = np.random.default_rng([self.seed, self.level])
        pick, at = rng.random(len(size)), rng.random(len(size))
        free = high > low
        inner = (size > 1) & free.any(1) & (self.level < self.depth)
        feature = (free.cumsum(1) > np.floor(pick * free.sum(1))[:, None]).argmax(1)
        lo, hi = (np.where(inner, v[np.arange(len(size)), feature], 0.0) for v in (low, high))
        own, new = slice(self.first, None), 2 * int(inner.sum())
        self.feature[own], self.cut[own] = np.where(inner, feature, -1), lo + at * (hi - lo)
        self.length[own] = np.where(inner, 0.0, self.level + np.array([path_norm(int(n)) for n in size]))
        self.first = len(self.feature)
        self.left[own] = np.where(inner, self.first + 2 * (inner.cumsum() - 1), self.left[own])
        self.feature, self.cut = np.r_[self.feature, np.full(new, -1)], np.r_[self.cut, np.zeros(new)]
        self.left, self.length = np.r_[self.left, self.first + np.arange(new)], np.r_[self.length, np.zeros(new)]
        self.level += 1

    def grow(self, spans: Callable[[Forest], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Forest:
        """spans: what spans() makes of all rows."""
        while self.first < len(self.feature):
            self.part(*spans(self))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 to the minus mean path length over the usual one: near 1 for anomalies."""
        total = np.zeros(len(x))
        for root in range(self.roots):
            total += self.length[self.place(x, root)]
        return 2.0 ** (-total / max(self.roots, 1) / self.norm) if self.roots else np.zeros(len(x))


def spans_of(stats: DataFrame) -> Callable[[Forest], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Forest.spans() over a whole table of counts: each task sends what it has of the open nodes."""
    spark = stats.sparkSession
    lows, highs = [f"low{i}" for i in range(FEATURES)], [f"high{i}" for i in range(FEATURES)]
    schema = ", ".join(["node long", "size long", *(f"{c} double" for c in lows + highs)])

    def spans(forest: Forest) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shared = spark.sparkContext.broadcast(forest)

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            size, low, high = shared.value.spans(features(table_of(b)) for b in batches)
            seen = np.flatnonzero(size)
            for k in range(0, len(seen), 4096):
                own = seen[k : k + 4096]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (own, size[own], *low[own].T, *high[own].T)], ["node", "size", *lows, *highs])

        found = stats.select(*COUNTS).mapInArrow(each, schema).groupBy("node")
        found = found.agg(F.sum("size").alias("size"), *[F.min(c).alias(c) for c in lows], *[F.max(c).alias(c) for c in highs]).toArrow()
        shared.destroy()
        n = len(forest.feature) - forest.first
        size, low, high = np.zeros(n, np.int64), np.full((n, FEATURES), np.inf), np.full((n, FEATURES), -np.inf)
        node = found["node"].to_numpy()
        size[node] = found["size"].to_numpy()
        for i in range(FEATURES):
            low[node, i], high[node, i] = found[lows[i]].to_numpy(), found[highs[i]].to_numpy()
        return size, low, high

    return spans


def table_of(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(batch.schema.get_field_index(n)).to_numpy() for n in COUNTS], 1)


def base_failed(c: np.ndarray) -> np.ndarray:
    return (c[:, 0] < 50) | (100 * c[:, 4] > 50 * c[:, 0])


def threshold(scores: np.ndarray, good: np.ndarray, keep_cost: float) -> float:
    """The cut of least cost: `keep_cost` for the share of good rows above it, 1 for the share of bad rows at or below it."""
    if not good.any() or good.all():
        return 1.0
    cuts = np.unique(scores)
    lost = 1 - np.searchsorted(np.sort(scores[good]), cuts, side="right") / good.sum()
    missed = np.searchsorted(np.sort(scores[~good]), cuts, side="right") / (~good).sum()
    best = int(np.argmin(keep_cost * lost + missed))
    return float((cuts[best] + cuts[min(best + 1, len(cuts) - 1)]) / 2)


def threshold_of(known: DataFrame, keep_cost: float) -> float:
    """threshold() over a whole table (anomaly, good). Equal scores are one row; sums run inside buckets of scores, from the buckets' own sums."""
    good, bad = F.sum(F.col("good").cast("long")).alias("g"), F.sum((~F.col("good")).cast("long")).alias("b")
    cuts = known.groupBy("anomaly").agg(good, bad).withColumn("bucket", F.floor(F.col("anomaly") * CUT_BUCKETS))
    sums = sorted(tuple(r) for r in cuts.groupBy("bucket").agg(F.sum("g"), F.sum("b")).collect())
    goods, bads = sum(r[1] for r in sums), sum(r[2] for r in sums)
    if not goods or not bads:
        return 1.0
    before, g, b = [], 0, 0
    for bucket, own_g, own_b in sums:
        before.append((bucket, g, b))
        g, b = g + own_g, b + own_b
    before = F.broadcast(known.sparkSession.createDataFrame(before, "bucket long, before_g long, before_b long"))
    upto = W.partitionBy("bucket").orderBy("anomaly").rowsBetween(W.unboundedPreceding, W.currentRow)
    lost, missed = 1 - (F.col("before_g") + F.sum("g").over(upto)) / goods, (F.col("before_b") + F.sum("b").over(upto)) / bads
    best = cuts.join(before, "bucket").select("anomaly", (keep_cost * lost + missed).alias("cost")).orderBy("cost", "anomaly").first()["anomaly"]
    above = cuts.filter(F.col("anomaly") > best).agg(F.min("anomaly")).first()[0]
    return (best + (best if above is None else above)) / 2


def quality_rules(docs: DataFrame, labels: DataFrame, trees: int = TREES, keep_cost: float = KEEP_COST) -> DataFrame:
    """The rule statistics, anomaly score and verdict of each row of docs (doc_id, text)."""

    def measure(texts: list[bytes]) -> dict:
        got = np.array([counts(t) for t in texts], np.int64).reshape(-1, len(COUNTS))
        return dict(zip(COUNTS, got.T, strict=True))

    with Scratch(docs.sparkSession) as scratch:
        stats = scratch(map_texts(docs, ["doc_id"], "text", measure, ", ".join(f"{n} long" for n in COUNTS)), "rules-stats")
        shared = docs.sparkSession.sparkContext.broadcast(Forest(stats.count(), trees).grow(spans_of(stats)))

        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                got = table_of(batch)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(base_failed(got)), pa.array(shared.value.score(features(got)))], [*batch.schema.names, "base_failed", "anomaly"])

        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in stats.schema.fields), "base_failed boolean, anomaly double"])
        scored = stash(stats.mapInArrow(judge, schema), "rules-scored")
    chosen = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.max("quality") == 1).alias("good"))
    cut = threshold_of(scored.filter("not base_failed").select("doc_id", "anomaly").join(chosen, "doc_id"), keep_cost)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") <= cut))
