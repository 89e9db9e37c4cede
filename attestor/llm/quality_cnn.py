"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded; learned filters of KERNEL bytes, STRIDE apart, run over overlapping chunks that cover the whole
text; each chunk keeps every filter's maximum; the maxima's maximum and mean over the chunks go through one logistic
unit. It is trained on the driver from a bounded sample of labelled rows (`train_rows`, `train_bytes`), by Adam on the
log loss, with gradients through the winning windows only. Scoring is map-only.

Defined results: a null or empty text is scored like any text (one window of padding); equal texts get equal scores, so
ties and repeated rows do; null ids are scored and never learned from; of labels that repeat an id the greatest counts;
very long texts are pooled piece by piece; other columns are ignored, whatever their names; with one class or none among
the labels every score is that class's share (1 where there are no labels); an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, map_texts

DIM, KERNEL, STRIDE, FILTERS, CHUNK = 8, 8, 4, 32, 2048
#: Bounds of the labelled sample that the driver trains on.
TRAIN_ROWS, TRAIN_BYTES = 6_000, 24 << 20
EPOCHS, BATCH, RATE, BLOCK = 5, 16, 0.004, 256 << 10


class Model:
    def __init__(self, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.p = {
            "e": rng.normal(0, 0.5, (256, DIM)).astype(np.float32),
            "w": rng.normal(0, (DIM * KERNEL) ** -0.5, (KERNEL * DIM, FILTERS)).astype(np.float32),
            "b": np.zeros(FILTERS, np.float32),
            "v": rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32),
            "c": np.zeros(1, np.float32),
        }
        self.constant: float | None = None

    def layout(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The padded bytes, [first, last) window rows of each chunk, and each chunk's text."""
        parts, spans, owner, row = [], [], [], 0
        per = CHUNK // STRIDE
        for i, t in enumerate(texts):
            n = max(1, -(-len(t) // STRIDE))
            parts += [t, b"\0" * (n * STRIDE - len(t) + KERNEL)]
            for k in range(0, n, per):
                spans.append((row + k, row + min(k + per, n)))
                owner.append(i)
            row += n + KERNEL // STRIDE
        return np.frombuffer(b"".join(parts) + b"\0" * KERNEL, np.uint8), np.array(spans), np.array(owner)

    def windows(self, raw: np.ndarray, rows: int) -> np.ndarray:
        x = self.p["e"][raw]
        return np.lib.stride_tricks.as_strided(x, (rows, KERNEL * DIM), (STRIDE * DIM * 4, 4))

    def pooled(self, texts: list[bytes]) -> tuple:
        raw, spans, owner = self.layout(texts)
        rows = (len(raw) - KERNEL) // STRIDE
        h = self.windows(raw, rows) @ self.p["w"]
        chunk = np.maximum.reduceat(h, np.minimum(spans.ravel(), rows - 1), axis=0)[::2]
        chunk = np.maximum(chunk + self.p["b"], 0)
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        top = np.maximum.reduceat(chunk, first, axis=0)
        mean = np.add.reduceat(chunk, first, axis=0) / np.diff(np.r_[first, len(owner)])[:, None]
        return np.hstack([top, mean]), h, chunk, raw, spans, owner, first

    def long_features(self, text: bytes) -> np.ndarray:
        """What pooled() makes of one text, from pieces of whole chunks: memory doesn't grow with the text."""
        top, total, chunks = np.zeros(FILTERS, np.float32), np.zeros(FILTERS), 0
        for at in range(0, max(len(text), 1), BLOCK):
            rows = max(1, -(-len(text[at : at + BLOCK]) // STRIDE))
            raw = np.frombuffer(text[at : at + rows * STRIDE + KERNEL].ljust(rows * STRIDE + KERNEL, b"\0"), np.uint8)
            h = self.windows(raw, rows) @ self.p["w"]
            chunk = np.maximum(np.maximum.reduceat(h, np.arange(0, rows, CHUNK // STRIDE), axis=0) + self.p["b"], 0)
            top, total, chunks = np.maximum(top, chunk.max(0)), total + chunk.sum(0), chunks + len(chunk)
        return np.concatenate([top, total / chunks])

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        out, start, held = [], 0, 0
        for i, t in enumerate([*texts, None]):
            if i > start and (t is None or held + len(t) > BLOCK):
                f = self.long_features(texts[start]) if held > BLOCK else self.pooled(texts[start:i])[0]
                z = np.atleast_2d(f) @ self.p["v"] + self.p["c"]
                out.append(1 / (1 + np.exp(-z.astype(float))))
                start, held = i, 0
            held += len(t or b"")
        return np.concatenate(out) if out else np.zeros(0)

    def gradients(self, texts: list[bytes], y: np.ndarray) -> dict:
        f, h, chunk, raw, spans, owner, first = self.pooled(texts)
        p = 1 / (1 + np.exp(-(f @ self.p["v"] + self.p["c"])))
        dz = ((p - y) / len(y)).astype(np.float32)
        df = dz[:, None] * self.p["v"]
        number = np.diff(np.r_[first, len(owner)])
        dchunk = (df[:, FILTERS:] / number[:, None])[owner]
        best = chunk == np.maximum.reduceat(chunk, first, axis=0)[owner]
        dchunk = (dchunk + df[:, :FILTERS][owner] * best / np.add.reduceat(best, first, axis=0)[owner]) * (chunk > 0)
        won = np.stack([a + h[a:b].argmax(0) for a, b in spans])
        at = (won[:, :, None] * STRIDE + np.arange(KERNEL)).reshape(-1, KERNEL)
        codes = raw[at]
        x = self.p["e"][codes].reshape(len(owner), FILTERS, -1)
        de = np.zeros((256, DIM), np.float32)
        back = (dchunk[:, :, None] * self.p["w"].T[None]).reshape(-1, DIM)
        np.add.at(de, codes.ravel(), back)
        return {"e": de, "w": np.einsum("cf,cfk->kf", dchunk, x), "b": dchunk.sum(0), "v": f.T @ dz, "c": dz.sum(keepdims=True)}

    def fit(self, texts: list[bytes], y: np.ndarray, share: float | None = None, epochs: int = EPOCHS, seed: int = 11) -> Model:
        """share: label 1's share among all labels; scores are shifted from the sample's share to it."""
        y = np.asarray(y, np.float32)
        if len(set(y.tolist())) < 2:
            self.constant = float(y[0]) if len(y) else 1.0
            return self
        rng, step = np.random.default_rng(seed), 0
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        for epoch in range(epochs):
            order = rng.permutation(len(texts))
            for k in range(0, len(order), BATCH):
                own = order[k : k + BATCH]
                step += 1
                for name, g in self.gradients([texts[i] for i in own], y[own]).items():
                    first[name] = 0.9 * first[name] + 0.1 * g
                    second[name] = 0.999 * second[name] + 0.001 * g * g
                    rate = RATE * (0.5**epoch) / (1 - 0.9**step) * np.sqrt(1 - 0.999**step)
                    self.p[name] = (self.p[name] - rate * first[name] / (np.sqrt(second[name]) + 1e-8)).astype(np.float32)
        if share and share < 1:
            self.p["c"] = self.p["c"] + np.float32(np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean())))
        return self


def training_rows(docs: DataFrame, labels: DataFrame, rows: int, most_bytes: int) -> tuple[list[bytes], np.ndarray, float | None]:
    """Whole texts of at most so many labelled ids by hash order (twice as many rows, where ids repeat), a third of them of label 0 where there are enough; texts beyond the bytes are left out whole. Last, label 1's share among all labels to learn from."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (crc_mod(F.col("doc_id"), 4) != 2))
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality")).withColumn("h", F.xxhash64("doc_id"))
    bad, good = (known.filter(F.col("quality") == q).orderBy("h", "doc_id").limit(n) for q, n in ((0, rows // 3), (1, rows - rows // 3)))
    picked = F.broadcast(bad.unionByName(good))
    texts, y, held = [], [], 0
    for r in docs.select("doc_id", "text").join(picked, "doc_id").select("h", "doc_id", "quality", "text").orderBy("h", "doc_id", F.xxhash64("text")).limit(2 * rows).toLocalIterator():
        raw = (r.text or "").encode()
        if held + len(raw) <= most_bytes:
            held += len(raw)
            texts.append((r.h, r.doc_id, raw))
            y.append(r.quality)
    order = sorted(range(len(texts)), key=lambda i: texts[i])
    return [texts[i][2] for i in order], np.array([y[i] for i in order], np.float32), known.agg(F.avg("quality")).first()[0]


def quality(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, train_bytes: int = TRAIN_BYTES, cut: float = 0.7, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted (and the carried columns) for each row of docs (doc_id, text)."""
    model = Model().fit(*training_rows(docs, labels, train_rows, train_bytes))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(texts: list[bytes]) -> dict:
        s = shared.value.score(texts)
        return {"score": s, "predicted": (s >= cut).astype(np.int32)}

    scored = map_texts(docs, list(dict.fromkeys(["doc_id", *carry])), "text", judge, "score double, predicted int")
    return scored.withColumn("held_out", crc_mod(F.col("doc_id"), 4) == 2)
