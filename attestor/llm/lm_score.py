"""LM scoring: a causal self-attention model in numpy over subword ids.

A text's ids are cut into blocks of BLOCK. Each block's queries attend, masked causally, to a window of its own block
and the one before; windows overlap and each token is scored once, in batched matrix products. The model gives
probabilities over the HEAD - 1 most frequent ids and the rest together; within the rest, and mixed into all by one
weight, go bigram shares that are counted over every training text. A unit (a word with the space before it, or a line
end) has the product of its ids' probabilities, mixed by a second weight with its share of all units in the training
texts, where it is among the TABLE_UNITS most frequent; other units have the model's, times what the table leaves.

All training texts are learned from. The ids' ranks come from the counts. The attention weights come from all texts but
a tenth, each at least once: a hash of id and text cuts them into parts of about PART_BYTES and ROUNDS rounds, and orders
them; in a round each part goes on from the same weights, and their mean, by ids, is the next round's. Small tables are
gone over up to EPOCHS times. The mixing weights are those of the greatest likelihood on all texts of the tenth, which is
left out of all counts for that. `sample_rows` and `sample_ids`, which are not set by any query, bound what the weights are
fitted from, for trials.

Base scores come from word counts over all training texts. Frequent words' counts (TABLE_WORDS at most) are broadcast;
the other words of a text meet their counts in one join, so no table that grows is ever held by one process.

Defined results: a null or empty text is its end alone; repeated rows and ties are scored each; a null id is an empty one
for the split; very long texts are scored whole, in slices of whole texts; other columns are ignored, whatever their
names; without training texts every count is 0, and the model is the untrained one; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import uuid
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, crc_mod, lower_ascii, map_texts, native_rows, stash
from .token_count import MARK, UNIT  # noqa: F401

BLOCK, DIM, HIDDEN, HEAD, RANKS = 16, 16, 64, 192, 2048
END = 2
#: Places whose HEAD columns are worked on at a time.
PLACES, ONES = 16 * BLOCK, np.ones(HEAD, np.float32)
#: Keys of bigrams among the counts start here, beyond all ids.
PAIRS = 1 << 40
MARK_BYTES = MARK.encode()
#: The sample of a bounded trial, the frequent words that are broadcast, and the words a task counts before it emits.
SAMPLE_ROWS, SAMPLE_IDS = 4_000, 1_200_000
TABLE_WORDS, TABLE_UNITS, TABLE_WORD_BYTES, TASK_WORDS, CACHE_UNITS = 1 << 18, 1 << 17, 64, 1 << 18, 1 << 18
EPOCHS, BATCH_ROWS, RATE = 12, 64, 0.006
#: Text of a part; rounds in all; ids to learn from in all, where texts are gone over again for that; groups in which parts' weights are added up.
PART_BYTES, ROUNDS, LEAST_IDS, GROUPS = 16 << 20, EPOCHS, EPOCHS * SAMPLE_IDS, 8


def cut(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The units of all texts in turn, with spaces for marks, and how many each text has. As UNIT has them: one starts at a line end, after one, and at the first of a run of marks; a text that isn't empty starts with a mark."""
    own = [b" " + t.replace(MARK_BYTES, b" ") if t else b"" for t in texts]
    sizes = np.fromiter(map(len, own), np.int64, len(own))
    data = b"".join(own)
    flat = np.frombuffer(data, np.uint8)
    starts, lines = flat == 32, flat == 10
    starts[1:] &= ~starts[:-1]
    starts |= lines
    starts[1:] |= lines[:-1]
    ends = np.cumsum(sizes)
    starts[(ends - sizes)[sizes > 0]] = True
    at = np.r_[np.flatnonzero(starts), len(flat)]
    bounds = np.searchsorted(at[:-1], np.r_[0, ends])
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)]), np.diff(bounds)


def names_of(units: pa.Array) -> list[str]:
    """Units of cut() as text, with marks."""
    return pc.replace_substring(units.cast(pa.large_string()), " ", MARK).to_numpy(zero_copy_only=False).tolist()


class Subwords:
    """Texts to ids, by units whose ids are cached; exact for vocabularies that split by units."""

    def __init__(self, model: str) -> None:
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.skip = len(self.sp.encode("\n"))
        self.shares: dict[str, float] = {}
        self.logs: dict[bytes, float] = {}
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.first, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.share, self.words, self.known, self.log = np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.rare: dict[int, list[bytes]] = {}
        self.new: list[str] = []

    def trim(self) -> None:
        """Keeps the units of the table of shares."""
        self.facts()
        kept = np.flatnonzero(self.share > 0)
        new = np.full(len(self.share), -1, np.int64)
        new[kept] = np.arange(len(kept))
        self.at = {u: int(new[i]) for u, i in self.at.items() if new[i] >= 0}
        self.rare = {int(new[i]): w for i, w in self.rare.items() if new[i] >= 0}
        sizes = self.size[kept]
        ends = np.cumsum(sizes)
        self.flat = self.flat[np.arange(int(sizes.sum())) + np.repeat(self.first[kept] - ends + sizes, sizes)]
        self.first, self.size = ends - sizes, sizes
        self.share, self.words, self.known, self.log = self.share[kept], self.words[kept], self.known[kept], self.log[kept]

    def full(self) -> bool:
        return len(self.at) > CACHE_UNITS

    def split(self, texts: list[str] | list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The units of all texts by their numbers in the cache, and how many each text has."""
        units, n_units = cut([t.encode() if isinstance(t, str) else t for t in texts])
        units = units.dictionary_encode()
        names = names_of(units.dictionary)
        numbers = list(map(self.at.get, names))
        if missing := [u for u, k in zip(names, numbers, strict=True) if k is None]:
            base = len(self.at)
            flat, sizes = self.once(missing)
            self.at.update(zip(missing, range(base, base + len(missing)), strict=True))
            self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(sizes) - sizes])
            self.size = np.concatenate([self.size, sizes])
            self.flat = np.concatenate([self.flat, flat])
            self.new += missing
            numbers = list(map(self.at.__getitem__, names))
        return np.array(numbers, np.int64)[units.indices.to_numpy()], n_units

    def facts(self) -> None:
        """Sets of each new unit: its share, its words, how many of them the table has, and the sum of their logs. Whoever reads them calls it first."""
        words, known, sums, of = [], [], [], self.logs.get
        for i, u in enumerate(self.new, len(self.share)):
            own = u.replace(MARK, " ").encode().lower().split()
            logs = [x for x in map(of, own) if x is not None]
            if len(logs) < len(own):
                self.rare[i] = [w for w in own if w not in self.logs]
            words.append(len(own))
            known.append(len(logs))
            sums.append(sum(logs))
        self.share = np.concatenate([self.share, [self.shares.get(u, 0.0) for u in self.new]])
        self.words, self.known, self.log = (np.concatenate([x, y]) for x, y in ((self.words, np.array(words, np.int64)), (self.known, np.array(known, np.int64)), (self.log, sums)))
        self.new = []

    def once(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of units, and how many each has, without the cache: for units of which each comes once."""
        own = [x[self.skip :] for x in self.sp.encode(["\n" + u for u in units], num_threads=1)]
        sizes = np.fromiter(map(len, own), np.int64, len(own))
        return np.fromiter(itertools.chain.from_iterable(own), np.int32, int(sizes.sum())), sizes

    def ids(self, units: np.ndarray, n_units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and each text's number."""
        sizes = self.size[units]
        ends = np.cumsum(sizes)
        ids = self.flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.first[units] - ends + sizes, sizes)]
        bounds = np.r_[0, ends][np.r_[0, np.cumsum(n_units)]]
        return ids, np.diff(bounds)

    def encode(self, texts: list[str] | list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if self.full():
            self.clear()
        return self.ids(*self.split(texts))


def layout(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of BLOCK inputs and targets (-1: none), whether a row is scored, and each text's first row. A text starts with a row of ends, which gives its first block a window."""
    blocks = -(-(sizes + 1) // BLOCK) + 1
    first = np.cumsum(blocks) - blocks
    inputs = np.full((int(blocks.sum()), BLOCK), END, np.int32)
    targets = np.full_like(inputs, -1)
    start = (first + 1) * BLOCK
    place = np.arange(len(ids)) + np.repeat(start - np.cumsum(sizes) + sizes, sizes)
    targets.reshape(-1)[place] = ids
    targets.reshape(-1)[start + sizes] = END
    inputs.reshape(-1)[place + 1] = ids
    scored = np.ones(len(inputs), bool)
    scored[first] = False
    return inputs, targets, scored, first


def windows(x: np.ndarray) -> np.ndarray:
    """Each row but the first after the row before it, of an array that has BLOCK places a row one after the other."""
    return np.ndarray((len(x) // BLOCK - 1, 2 * BLOCK, DIM), x.dtype, x, 0, (BLOCK * x.strides[0], *x.strides))


class Model:
    """rank: id to rank by frequency (RANKS - 1: all others); parameters p."""

    def __init__(self, rank: np.ndarray, seed: int = 13) -> None:
        rng = np.random.default_rng(seed)
        n = lambda *s: rng.normal(0, s[0] ** -0.5, s).astype(np.float32)
        self.rank = rank
        self.p = {
            "e": rng.normal(0, 0.3, (RANKS, DIM)).astype(np.float32), "q": n(DIM, DIM), "k": n(DIM, DIM), "v": n(DIM, DIM), "o": n(DIM, DIM) * np.float32(0.3),
            "r": np.linspace(0, -2, 2 * BLOCK, dtype=np.float32), "w1": n(2 * DIM, HIDDEN), "b1": np.zeros(HIDDEN, np.float32), "w2": n(HIDDEN, DIM) * np.float32(0.3), "w3": n(DIM, HEAD), "b3": np.zeros(HEAD, np.float32),
        }
        self.mix, self.unit_mix, self.rare, self.end_share = 0.5, 0.5, 1.0, 0.0
        gap = BLOCK + np.arange(BLOCK)[:, None] - np.arange(2 * BLOCK)[None]
        self.gap, self.mask, self.keep = np.clip(gap, 0, 2 * BLOCK - 1), gap < 0, (gap >= 0).astype(np.float32)

    def attend(self, q: np.ndarray, k: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The attention's shares, and what rows 1 and on get by them. q: scaled queries of these rows; k, v: keys and values of all."""
        a = np.matmul(q.reshape(-1, BLOCK, DIM), windows(k).transpose(0, 2, 1))
        np.exp(np.clip(a, -60, 60, out=a), out=a)
        a *= np.exp(self.p["r"])[self.gap] * self.keep
        a *= 1 / np.matmul(a, np.ones((2 * BLOCK, 1), np.float32))
        return a, np.matmul(a, windows(v)).reshape(-1, DIM)

    def head(self, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """exp of the logits, and its sums; h2 ends with a column of ones. Logits are small numbers; where one isn't, each row's greatest is taken off first."""
        w = np.concatenate([self.p["w3"], self.p["b3"][None]])
        with np.errstate(over="ignore"):
            z = h2 @ w
            sums = np.exp(z, out=z) @ ONES
        if len(sums) and not 1e-25 < float(sums.min()) <= float(sums.max()) < 1e25:
            z = h2 @ w
            z -= z.max(1, keepdims=True)
            sums = np.exp(z, out=z) @ ONES
        return z, sums

    def forward(self, x: np.ndarray) -> tuple:
        """Of rows 1 and on: what the head gets, with a column of ones; row 0 is only a window."""
        p = self.p
        e = p["e"].take(x.reshape(-1), 0)
        own = e[BLOCK:]
        q, k, v = own @ (p["q"] * np.float32(DIM**-0.5)), e @ p["k"], e @ p["v"]
        a, o = self.attend(q, k, v)
        h = np.empty((len(o), 2 * DIM), np.float32)
        h[:, :DIM] = own
        np.matmul(o, p["o"], out=h[:, DIM:])
        r = h @ p["w1"]
        r += p["b1"]
        np.maximum(r, 0, out=r)
        h2 = np.ones((len(o), DIM + 1), np.float32)
        np.add(r @ p["w2"], own, out=h2[:, :DIM])
        return h2, (e, q, k, v, a, o, h, r)

    def gradients(self, x: np.ndarray, y: np.ndarray, g: dict | None = None) -> tuple[float, dict]:
        """The loss, and the gradients of the parameters, in g's arrays where it is given."""
        p, rows = self.p, len(x)
        g = {n: np.empty_like(v) for n, v in p.items()} if g is None else g
        h2, (e, q, k, v, a, o, h, r) = self.forward(x)
        own = e[BLOCK:]
        dh2, right, count = np.empty((len(h2), DIM), np.float32), np.ones(len(h2), np.float32), max(int((y >= 0).sum()), 1)
        g["w3"][:] = g["b3"][:] = 0
        # A few places at a time, whose HEAD columns stay in the processor's cache.
        for b in range(0, len(h2), PLACES):
            piece = slice(b, b + PLACES)
            z, sums = self.head(h2[piece])
            at = np.flatnonzero(y[piece] >= 0)
            top = y[piece][at]
            true, sums = z[at, top], sums[at]
            right[piece][at] = true / sums
            # Rows of z become sums times (probabilities less the targets), of which scale makes the gradients.
            z[at, top] = true - sums
            scale = np.zeros((len(z), 1), np.float32)
            scale[at, 0] = 1 / (sums * np.float32(count))
            np.multiply(z @ p["w3"].T, scale, out=dh2[piece])
            g["w3"] += (h2[piece, :DIM] * scale).T @ z
            g["b3"] += scale[:, 0] @ z
        loss = float(-np.log(right + np.float32(1e-12)).sum()) / count
        dr = dh2 @ p["w2"].T
        dr *= r > 0
        dh = dr @ p["w1"].T
        np.matmul(r.T, dh2, out=g["w2"])
        np.matmul(h.T, dr, out=g["w1"])
        np.matmul(np.ones(len(dr), np.float32), dr, out=g["b1"])
        np.matmul(o.T, dh[:, DIM:], out=g["o"])
        do = dh[:, DIM:] @ p["o"].T
        do3 = do.reshape(rows - 1, BLOCK, DIM)
        ds = np.matmul(do3, windows(v).transpose(0, 2, 1))
        # The shares' mean of what they get is what do has of o.
        ds -= np.einsum("ij,ij->i", do, o).reshape(rows - 1, BLOCK, 1)
        ds *= a
        dq = np.matmul(ds, windows(k)).reshape(-1, DIM)
        dq *= np.float32(DIM**-0.5)
        dk, dv = np.zeros_like(e), np.zeros_like(e)
        for whole, part in ((dk, np.matmul(ds.transpose(0, 2, 1), q.reshape(do3.shape))), (dv, np.matmul(a.transpose(0, 2, 1), do3))):
            whole = whole.reshape(rows, BLOCK, DIM)
            whole[1:] = part[:, BLOCK:]
            whole[:-1] += part[:, :BLOCK]
        np.matmul(own.T, dq, out=g["q"])
        np.matmul(e.T, dk, out=g["k"])
        np.matmul(e.T, dv, out=g["v"])
        de = dk @ p["k"].T
        de += dv @ p["v"].T
        dh2 += dh[:, :DIM]
        dh2 += dq @ p["q"].T
        de[BLOCK:] += dh2
        g["r"][:] = np.bincount(self.gap.reshape(-1), (np.ones(rows - 1, np.float32) @ ds.reshape(rows - 1, -1)) * self.keep.reshape(-1), 2 * BLOCK)
        flat = x.reshape(-1).astype(np.uint16)
        order = np.argsort(flat, kind="stable")
        flat = flat[order]
        begins = np.r_[0, np.flatnonzero(flat[1:] != flat[:-1]) + 1]
        g["e"][:] = 0
        g["e"][flat[begins]] = np.add.reduceat(de.take(order, 0), begins, axis=0)
        return loss, g

    def fit(self, ids: np.ndarray, sizes: np.ndarray, epochs: int = EPOCHS) -> list[float]:
        inputs, targets, scored, _ = layout(ids, sizes)
        x, y = self.rank[inputs], np.where(targets >= 0, np.minimum(self.rank[np.maximum(targets, 0)], HEAD - 1), -1)
        y[~scored] = -1
        m, s, losses, step = ({n: np.zeros_like(v) for n, v in self.p.items()} for _ in range(2)), None, [], 0
        m, s = m
        rng = np.random.default_rng(1)
        starts = np.arange(0, max(len(x) - 1, 0), BATCH_ROWS)
        total = epochs * len(starts)
        for _ in range(epochs):
            for b in rng.permutation(starts):
                own = x[b : b + BATCH_ROWS + 1]
                loss, grads = self.gradients(own, y[b + 1 : b + 1 + BATCH_ROWS].reshape(-1))
                losses.append(loss)
                step += 1
                rate = RATE * (1 - 0.95 * step / total) * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
                for n, g in grads.items():
                    m[n] += 0.1 * (g - m[n])
                    s[n] += 0.01 * (g * g - s[n])
                    self.p[n] -= (rate * m[n] / (np.sqrt(s[n]) + 1e-8)).astype(np.float32)
        return losses

    def state(self) -> np.ndarray:
        """The parameters, and for each its two moments, 0."""
        return np.concatenate([*(v.reshape(-1) for v in self.p.values()), np.zeros(2 * sum(v.size for v in self.p.values()), np.float32)])

    def train(self, state: np.ndarray, step: int, texts: Iterable[tuple[np.ndarray, np.ndarray]], rate: float, seed: int) -> tuple[np.ndarray, int, int]:
        """The state after these texts (ids and sizes, in slices) in turn, the step it is at, and how many targets there were. The parameters become the state's."""
        flat = state.copy()
        size, n = len(flat) // 3, 0
        p, m, s = flat[:size], flat[size : 2 * size], flat[2 * size :]
        at = 0
        for name, v in self.p.items():
            self.p[name] = p[at : at + v.size].reshape(v.shape)
            at += v.size
        g, t = np.empty_like(p), np.empty_like(p)
        grads = dict(zip(self.p, (x.reshape(v.shape) for v, x in zip(self.p.values(), np.split(g, np.cumsum([v.size for v in self.p.values()])[:-1]), strict=True)), strict=True))
        rng = np.random.default_rng(seed)
        for ids, sizes in texts:
            inputs, targets, scored, _ = layout(ids, sizes)
            x, y = self.rank[inputs], np.where(targets >= 0, np.minimum(self.rank[np.maximum(targets, 0)], HEAD - 1), -1)
            y[~scored] = -1
            n += int((y >= 0).sum())
            for b in rng.permutation(np.arange(0, max(len(x) - 1, 0), BATCH_ROWS)):
                self.gradients(x[b : b + BATCH_ROWS + 1], y[b + 1 : b + 1 + BATCH_ROWS].reshape(-1), grads)
                step += 1
                # In place: m += 0.1 (g - m), s += 0.01 (g g - s), p -= rate m / (sqrt(s) + 1e-8).
                np.subtract(g, m, out=t)
                t *= np.float32(0.1)
                m += t
                g *= g
                g -= s
                g *= np.float32(0.01)
                s += g
                np.sqrt(s, out=t)
                t += np.float32(1e-8)
                np.divide(m, t, out=t)
                t *= np.float32(rate * np.sqrt(1 - 0.99**step) / (1 - 0.9**step))
                p -= t
        return flat, step, n

    def set_bigrams(self, pairs: np.ndarray, singles: np.ndarray) -> None:
        """pairs: counts by rank and rank; singles: counts by id. Shares back off to the single ids by the number of ids seen after a rank."""
        one = np.bincount(self.rank, singles, RANKS) + 0.5
        one /= one.sum()
        kinds = (pairs > 0).sum(1, keepdims=True) + 1.0
        self.pairs = ((pairs + kinds * one) / (pairs.sum(1, keepdims=True) + kinds)).astype(np.float32)
        self.rest = self.pairs[:, HEAD - 1 :].sum(1)
        others = np.where(self.rank == RANKS - 1, singles + 0.1, 0)
        self.within = np.where(self.rank == RANKS - 1, others / max(others.sum(), 1e-9), 1.0).astype(np.float32)

    def shares(self, x: np.ndarray, targets: np.ndarray, fresh: np.ndarray, rows: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """The attention model's and the bigrams' probability of each target of rows 1 and on, from the inputs' ranks x; 1 where there is none. fresh: places where a unit starts, or a text ends, which bigrams see after an end."""
        at = np.maximum(targets, 0)
        y, last = self.rank[at], x[1:].reshape(-1).copy()
        last[fresh] = self.rank[END]
        two, within, top = self.pairs.reshape(-1)[last.astype(np.int64) * RANKS + y], self.within[at], np.minimum(y, HEAD - 1)
        model, step = np.empty(len(y), np.float32), np.arange(PLACES) * HEAD
        # What forward() does, with all that depends on a rank alone in tables.
        p = self.p
        tables = [p["e"] @ (p["q"] * np.float32(DIM**-0.5)), p["e"] @ p["k"], p["e"] @ p["v"], p["e"], p["e"] @ p["w1"][:DIM] + p["b1"]]
        down, h2 = p["o"] @ p["w1"][DIM:], np.ones((rows * BLOCK, DIM + 1), np.float32)
        for b in range(0, len(x) - 1, rows):
            every = x[b : b + rows + 1].reshape(-1)
            q, k, v, e, h = (t.take(every[0 if t is tables[1] or t is tables[2] else BLOCK :], 0) for t in tables)
            h += self.attend(q, k, v)[1] @ down
            r = np.maximum(h, 0, out=h)
            np.add(r @ p["w2"], e, out=h2[: len(r), :DIM])
            for k in range(0, len(r), PLACES):
                z, sums = self.head(h2[k : min(k + PLACES, len(r))])
                own = slice(b * BLOCK + k, b * BLOCK + k + len(z))
                model[own] = z.reshape(-1)[step[: len(z)] + top[own]] / sums
        rest = y >= HEAD - 1
        model[rest] *= two[rest] / self.rest[last[rest]]
        model *= within
        two *= within
        none = targets < 0
        model[none] = two[none] = 1.0
        return model, two

    def chances(self, known: Subwords, units: np.ndarray, n_units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """shares() of these units' texts, and the places of their ids and ends."""
        ids, sizes = known.ids(units, n_units)
        inputs, targets, _, first = layout(ids, sizes)
        start = first * BLOCK
        place = np.arange(len(ids)) + np.repeat(start - np.cumsum(sizes) + sizes, sizes)
        own = known.size[units]
        begins = (np.cumsum(own) - own)[own > 0]
        ends = start + sizes
        model, two = self.shares(self.rank[inputs], targets[1:].reshape(-1), np.r_[place[begins], ends])
        return model, two, place, ends

    def unit_logs(self, known: Subwords, units: np.ndarray, n_units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The natural log of the product of each unit's ids, its share, and the log of each text's end."""
        if not len(n_units):
            return np.zeros(0), np.zeros(0), np.zeros(0)
        model, two, place, ends = self.chances(known, units, n_units)
        model *= np.float32(self.mix)
        two *= np.float32(1 - self.mix)
        model += two
        logs = np.log(model)
        sums = np.r_[0.0, np.cumsum(logs[place], dtype=np.float64)][np.r_[0, np.cumsum(known.size[units])]]
        known.facts()
        return np.diff(sums), known.share[units], logs[ends].astype(np.float64)

    def score(self, known: Subwords, units: np.ndarray, n_units: np.ndarray) -> np.ndarray:
        """log10 of each text's probability, its end included."""
        own, share, ends = self.unit_logs(known, units, n_units)
        logs = mixed(own, share, self.unit_mix, self.rare)
        text = np.repeat(np.arange(len(n_units)), n_units)
        return (np.bincount(text, logs, len(n_units)) + mixed(ends, np.full(len(ends), self.end_share), self.unit_mix, self.rare)) / np.log(10)


def mixed(own: np.ndarray, share: np.ndarray, weight: float, rare: float) -> np.ndarray:
    """Logs of weight * own + (1 - weight) * share, where there is a share; of own times what the shares leave elsewhere."""
    out = own + np.log(weight + (1 - weight) * rare)
    at = share > 0
    out[at] = np.logaddexp(own[at] + np.log(weight), np.log(share[at]) + np.log1p(-weight))
    return out


_SUBWORDS: dict[tuple[str, str], Subwords] = {}


def subwords(model: str, owner: str = "", tables: Callable[[], tuple[dict[str, float], dict[bytes, float]]] | None = None) -> Subwords:
    """This worker's, one for each owner, with the owner's shares of units and logs of words. An owner's goes when another comes."""
    if (model, owner) not in _SUBWORDS:
        _SUBWORDS.clear()
        own = _SUBWORDS[model, owner] = Subwords(model)
        own.shares, own.logs = tables() if tables else ({}, {})
    return _SUBWORDS[model, owner]


def bigrams(ids: np.ndarray, sizes: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The cell (rank * RANKS + rank) of each id and the one before it in its unit, where the first comes after an end. sizes: of the units."""
    before = np.r_[END, ids[:-1]] if len(ids) else ids
    begins = (np.cumsum(sizes) - sizes)[sizes > 0]
    before[begins] = END
    return rank[before].astype(np.int64) * RANKS + rank[ids]


def unit_counts(train: DataFrame) -> DataFrame:
    """unit, plain, n over all texts, text ends as a null unit. Units are plain where their words are the text's, as they are in texts without the mark itself; other texts' words come with plain null."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain, other, words, ends = Counter(), Counter(), Counter(), 0
        for _, texts in native_rows(batches, "text"):
            ends += len(texts)
            odd = [raw for raw in texts if MARK_BYTES in raw]
            for counter, own in ((plain, [raw for raw in texts if MARK_BYTES not in raw]), (other, odd)):
                found = cut(own)[0].value_counts()
                for unit, n in zip(names_of(found.field("values")), found.field("counts").to_pylist(), strict=True):
                    counter[unit] = counter.get(unit, 0) + n
            for raw in odd:
                words.update(w.decode() for w in raw.lower().split())
            if len(plain) + len(other) + len(words) > TASK_WORDS:
                for counter, flag in ((plain, True), (other, False), (words, None)):
                    yield from _rows(counter, flag)
                    counter.clear()
        for counter, flag in ((plain, True), (other, False), (words, None)):
            yield from _rows(counter, flag)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.array([None], pa.bool_()), pa.array([ends], pa.int64())], ["unit", "plain", "n"])

    return train.select("text").mapInArrow(count, "unit string, plain boolean, n long").groupBy("unit", "plain").agg(F.sum("n").alias("n"))


def _rows(counts: Counter, flag: bool | None) -> Iterator[pa.RecordBatch]:
    items = list(counts.items())
    for k in range(0, len(items), 50_000):
        own = items[k : k + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in own], pa.string()), pa.array([flag] * len(own), pa.bool_()), pa.array([n for _, n in own], pa.int64())], ["unit", "plain", "n"])


def word_counts(counts: DataFrame) -> DataFrame:
    """word, n from the counts of plain units, and of the words of other texts."""
    plain = F.translate(lower_ascii(F.col("unit")), MARK + "\t\n\x0b\x0c\r", " " * 6)
    own = counts.filter("plain").select(F.explode(F.array_remove(F.split(plain, " "), "")).alias("word"), "n")
    return own.unionByName(counts.filter("plain is null and unit is not null").select(F.col("unit").alias("word"), "n")).groupBy("word").agg(F.sum("n").alias("n"))


def unit_ids(counts: DataFrame, model_file: str) -> DataFrame:
    """ids, sizes, n of slices of all units, as whole numbers of four, four and eight bytes: each unit is encoded once for all its occurrences and all that is counted of them."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Subwords(model_file)
        for batch in batches:
            ids, sizes = known.once(batch.column(0).to_numpy(zero_copy_only=False).tolist())
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (ids, sizes.astype(np.int32), batch.column(1).to_numpy())], ["ids", "sizes", "n"])

    return counts.filter("plain is not null").groupBy("unit").agg(F.sum("n").alias("n")).mapInArrow(encode, "ids binary, sizes binary, n binary")


def pair_counts(coded: DataFrame, rank: object, ids_a_task: int = 8_000_000) -> DataFrame:
    """key, n: id for single ids, and PAIRS + cell for bigrams, over all units; coded: of unit_ids()."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = rank.value
        pairs, singles = np.zeros(RANKS * RANKS, np.int64), np.zeros(len(ranks), np.int64)
        for batch in batches:
            for r in batch.to_pylist():
                ids, sizes = np.frombuffer(r["ids"], np.int32), np.frombuffer(r["sizes"], np.int32)
                times = np.repeat(np.frombuffer(r["n"], np.int64), sizes)
                np.add.at(pairs, bigrams(ids, sizes, ranks), times)
                np.add.at(singles, ids, times)
        for n, base in ((singles, 0), (pairs, PAIRS)):
            seen = np.flatnonzero(n)
            for k in range(0, len(seen), 50_000):
                own = seen[k : k + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(own + base, pa.int64()), pa.array(n[own], pa.int64())], ["key", "n"])

    tasks = max(1, -(-int(coded.agg(F.sum(F.octet_length("ids"))).first()[0] or 0) // (4 * ids_a_task)))
    return coded.coalesce(tasks).mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def sample_model(train: DataFrame, model_file: str, rows: int, most_ids: int) -> tuple[Model, list[str]]:
    """The model, its attention fitted on a bounded random sample of rows, and about a tenth of their texts, left for the mixing weights.

    A hash of id and text chooses the rows, orders them and splits them. In this order, the text that passes most_ids is cut there and is the last.
    """
    place = place_of()
    share = min(1.0, rows / max(train.count(), 1))
    texts = train.select(place.alias("place"), "text").filter(F.col("place") <= min(int(share * 2**63), 2**63 - 1)).orderBy("place").limit(2 * rows)
    ids_of = subwords(model_file)
    kept, places, held, left = [], [], 0, []
    for r in texts.toLocalIterator():
        ids, _ = ids_of.encode([r.text or ""])
        kept.append(ids[: most_ids - held])
        if r.place % 10 == 0 and len(kept[-1]) == len(ids):
            left.append(r.text or "")
        places.append(r.place)
        held += len(kept[-1])
        if held >= most_ids:
            break
    seen = np.bincount(np.concatenate([*kept, np.full(len(kept) + 1, END)]), minlength=ids_of.sp.get_piece_size())
    model = Model(ranked(seen))
    own = [x for p, x in zip(places, kept, strict=True) if p % 10]
    flat = lambda xs: (np.concatenate([*xs, np.zeros(0, np.int32)]).astype(np.int32), np.array([len(x) for x in xs], np.int64))
    model.fit(*flat(own))
    return model, left


def place_of() -> Column:
    """A number from 0 on, by a hash of id and text. Those that ten divides are left out for the mixing weights."""
    return F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce("text", F.lit(""))), 1)


def _digits(parts: int, rounds: int) -> tuple[Column, Column]:
    """The part and the round of a place: digits that the tenth doesn't fix. Whole numbers only, since doubles lose them."""
    return F.expr(f"cast(place div 10 % {parts} as int)").alias("part"), F.expr(f"cast(place div 10 div {parts} % {rounds} as int)").alias("round")


def ranked(singles: np.ndarray) -> np.ndarray:
    """Each id's rank by its count."""
    rank = np.full(len(singles), RANKS - 1, np.int32)
    rank[np.argsort(-singles, kind="stable")[: RANKS - 1]] = np.arange(RANKS - 1)
    return rank


def id_counts(counts: DataFrame, coded: DataFrame, model_file: str) -> np.ndarray:
    """How often each id occurs in all counted texts, ends included."""
    pieces = Subwords(model_file).sp.get_piece_size()
    every = pair_counts(coded, counts.sparkSession.sparkContext.broadcast(np.zeros(pieces, np.int32))).filter(F.col("key") < PAIRS).toArrow()
    singles = np.zeros(pieces)
    singles[every["key"].to_numpy()] = every["n"].to_numpy()
    singles[END] += text_ends(counts)
    return singles


def text_ends(counts: DataFrame) -> int:
    return int(counts.filter("unit is null").agg(F.sum("n")).first()[0] or 0)


def whole_model(train: DataFrame, counts: DataFrame, coded: DataFrame, model_file: str, stash: Callable[[DataFrame, str], DataFrame]) -> Model:
    """The model, its attention fitted on all training texts but a tenth."""
    spark = train.sparkSession
    singles = id_counts(counts, coded, model_file)
    model = Model(ranked(singles))
    epochs = int(min(EPOCHS, max(1, -(-LEAST_IDS // max(int(singles.sum()), 1)))))
    rounds = ROUNDS // epochs
    texts = train.select(place_of().alias("place"), "text").filter("place % 10 <> 0")
    parts = max(1, -(-int(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART_BYTES))
    texts = texts.select(*_digits(parts, rounds), "place", "text")
    table = stash(texts.repartitionById(parts, "part").sortWithinPartitions("round", "part", "place"), "lm-train")
    state, step = model.state(), 0
    for k in range(epochs * rounds):
        shared = spark.sparkContext.broadcast((model.rank, state, step, RATE * (1 - 0.95 * (k + 0.5) / (epochs * rounds))))
        own = table.filter(F.col("round") == k % rounds).select("part", "text")
        done = own.mapInArrow(_trainer(model_file, shared, k), "part int, n long, step long, state binary")
        means = done.repartition(min(parts, GROUPS), "part").sortWithinPartitions("part").mapInArrow(_mean, "part int, n long, step long, state binary").collect()
        if means:
            means.sort(key=lambda r: r.part)
            n = sum(r.n for r in means)
            state = (sum(np.frombuffer(r.state, np.float32).astype(float) * r.n for r in means) / n).astype(np.float32)
            step = max(r.step for r in means)
        shared.destroy()
    model.train(state, step, [], 0.0, 0)
    return model


def _trainer(model_file: str, shared: object, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A part's state after its texts, from the shared one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, state, step, rate = shared.value
        known = subwords(model_file)

        def slices() -> Iterator[tuple[int, list[bytes]]]:
            for piece, texts in native_rows(batches, "text"):
                part = piece.column(piece.schema.get_field_index("part")).to_numpy()
                for own in np.split(np.arange(len(part)), np.flatnonzero(part[1:] != part[:-1]) + 1):
                    yield int(part[own[0]]), [texts[i] for i in own]

        for part, group in itertools.groupby(slices(), key=lambda x: x[0]):
            got, at, n = Model(rank).train(state, step, (known.encode(texts) for _, texts in group), rate, seed * 1_000_003 + part)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n]), pa.array([at]), pa.array([got.tobytes()], pa.binary())], ["part", "n", "step", "state"])

    return run


def _mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The mean of states by their targets, the targets of all, the greatest step, and the first part."""
    total, n, step, part = 0.0, 0, 0, None
    for batch in batches:
        for r in batch.to_pylist():
            part = r["part"] if part is None else part
            total, n, step = total + np.frombuffer(r["state"], np.float32).astype(float) * r["n"], n + r["n"], max(step, r["step"])
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n]), pa.array([step]), pa.array([(total / n).astype(np.float32).tobytes()], pa.binary())], ["part", "n", "step", "state"])


def likeliest(ratios: DataFrame, passes: int = 3, points: int = 16) -> float:
    """The weight w between 0.02 and 0.98 that makes the sum of log(w r + 1 - w) over all ratios r greatest: its slope falls with w, and is looked at in so many points between two others in turn. A half without ratios."""
    low, high = 0.02, 0.98
    for _ in range(passes):
        at = np.linspace(low, high, points + 2)

        def slopes(batches: Iterator[pa.RecordBatch], at: np.ndarray = at) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for raw in batch.column(0).to_pylist():
                    r = np.frombuffer(raw, np.float32).astype(float) - 1
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(at))), pa.array([float((r / (w * r + 1)).sum()) for w in at]), pa.array(np.full(len(at), len(r)))], ["k", "slope", "n"])

        found = sorted(tuple(r) for r in ratios.mapInArrow(slopes, "k long, slope double, n long").groupBy("k").agg(F.sum("slope"), F.sum("n")).collect())
        if not found or not found[0][2]:
            return 0.5
        up = sum(x > 0 for _, x, _ in found)
        low, high = at[max(up - 1, 0)], at[min(up, len(at) - 1)]
    return float((low + high) / 2)


def ratios_of(left: DataFrame, model: Model, model_file: str, shares: dict[str, float] | None = None) -> DataFrame:
    """Slices of ratios, as floats of four bytes: of each id of the texts the attention model's probability to the bigrams'; with shares, of each unit its ids' probability to its share (without one: 1 to what the shares leave)."""
    shared = left.sparkSession.sparkContext.broadcast((model, shares))
    owner = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, shares = shared.value
        known = subwords(model_file, owner, lambda: (shares or {}, {}))
        for _, texts in native_rows(batches, "text"):
            if known.full():
                known.clear()
            units, n_units = known.split(texts)
            if shares is None:
                one, two, place, ends = model.chances(known, units, n_units)
                used = np.r_[place, ends]
                r = one[used] / np.maximum(two[used], np.float32(1e-30))
            else:
                own, share, _ = model.unit_logs(known, units, n_units)
                r = np.where(share > 0, np.exp(own - np.log(np.where(share > 0, share, 1.0))), 1 / model.rare)
            yield pa.RecordBatch.from_arrays([pa.array([np.minimum(r, 1e30).astype(np.float32).tobytes()], pa.binary())], ["r"])

    return left.select("text").mapInArrow(run, "r binary")


def fit_counts(model: Model, counts: DataFrame, coded: DataFrame, model_file: str, left: DataFrame, stash: Callable[[DataFrame, str], DataFrame], table_units: int = TABLE_UNITS) -> tuple[int, dict[str, float]]:
    """Sets the model's bigrams and shares from the counts over all training texts, and its mixing weights from the left texts, taken out of the counts for that; returns the number of text ends, and the shares of the frequent units."""
    rank = counts.sparkSession.sparkContext.broadcast(model.rank)
    end = int(model.rank[END]) * (RANKS + 1)

    def cells(counts: DataFrame, coded: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
        ends, other = text_ends(counts), pair_counts(coded, rank).toArrow()
        key, n = other["key"].to_numpy(), other["n"].to_numpy()
        pairs, singles, big = np.zeros(RANKS * RANKS), np.zeros(len(model.rank)), key >= PAIRS
        pairs[key[big] - PAIRS] = n[big]
        singles[key[~big]] = n[~big]
        pairs[end] += ends
        singles[END] += ends
        return pairs, singles, ends

    pairs, singles, ends = cells(counts, coded)
    own = stash(unit_counts(left), "lm-left-counts")
    own_pairs, own_singles, own_ends = cells(own, stash(unit_ids(own, model_file), "lm-left-ids"))
    model.set_bigrams(np.maximum(pairs - own_pairs, 0).reshape(RANKS, RANKS), np.maximum(singles - own_singles, 0))
    del own_pairs
    model.mix = likeliest(stash(ratios_of(left, model, model_file), "lm-id-ratios"))
    units_of = lambda df: df.filter("plain is not null").groupBy("unit").agg(F.sum("n").alias("n"))
    all_units, own_units = units_of(counts), units_of(own)
    total, own_total = (int(df.agg(F.sum("n")).first()[0] or 0) + e for df, e in ((all_units, ends), (own_units, own_ends)))
    table = all_units.filter((F.col("n") >= frequent_from(all_units, table_units)) & (F.octet_length("unit") <= TABLE_WORD_BYTES))
    table = table.join(own_units.withColumnRenamed("n", "less"), "unit", "left").select("unit", "n", F.coalesce("less", F.lit(0)).alias("less")).toArrow()
    names, n_table = table["unit"].to_pylist(), table["n"].to_numpy().astype(float)
    less = np.maximum(n_table - table["less"].to_numpy(), 0) / max(total - own_total, 1)
    model.rare = max(1 - float(less.sum()) - (ends - own_ends) / max(total, 1), 1e-6)
    model.unit_mix = likeliest(stash(ratios_of(left, model, model_file, {u: x for u, x in zip(names, less.tolist(), strict=True) if x > 0}), "lm-unit-ratios"))
    model.set_bigrams(pairs.reshape(RANKS, RANKS), singles)
    shares, model.end_share = n_table / max(total, 1), ends / max(total, 1)
    model.rare = max(1 - float(shares.sum()) - model.end_share, 1e-6)
    return ends, dict(zip(names, shares.tolist(), strict=True))


def lm_scores(docs: DataFrame, model_file: str, sample_rows: int | None = None, sample_ids: int | None = None, table_words: int = TABLE_WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    held = crc_mod(F.col("doc_id"), 10) == 0
    train = docs.filter(~held)
    counts = stash(unit_counts(train), "lm-counts")
    words = stash(word_counts(counts), "lm-words")
    with Scratch(spark) as scratch:
        coded = scratch(unit_ids(counts, model_file), "lm-ids")
        if sample_rows is None and sample_ids is None:
            model, left = whole_model(train, counts, coded, model_file, scratch), train.filter(place_of() % 10 == 0).select("text")
        else:
            model, left = sample_model(train, model_file, SAMPLE_ROWS if sample_rows is None else sample_rows, SAMPLE_IDS if sample_ids is None else sample_ids)
            left = spark.createDataFrame([(t,) for t in left], "text string")
        ends, units = fit_counts(model, counts, coded, model_file, left, scratch)
    sums = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    total, kinds = sums.n + ends, sums.v + (ends > 0)
    least = frequent_from(words, table_words)
    table = words.filter((F.col("n") >= least) & (F.octet_length("word") <= TABLE_WORD_BYTES)).toArrow()
    scale = total + 0.1 * (kinds + 1)
    shared = spark.sparkContext.broadcast((model, table["word"].cast(pa.binary()).to_pylist(), table["n"].to_numpy(), ends, scale, units))
    owner = uuid.uuid4().hex

    def score(texts: list[bytes]) -> dict:
        model, names, n, ends, scale, units = shared.value
        known = subwords(model_file, owner, lambda: (units, dict(zip(names, np.log10((n + 0.1) / scale).tolist(), strict=True))))
        if known.full():
            known.trim()
        own, n_units = known.split(texts)
        known.facts()
        of = np.repeat(np.arange(len(texts)), n_units)
        total = lambda x: np.bincount(of, x[own], len(texts))
        words, frequent, logs = total(known.words).astype(np.int64), total(known.known).astype(np.int64), total(known.log)
        rare: list[list[bytes]] = [[] for _ in texts]
        for i in np.flatnonzero(known.words[own] != known.known[own]):
            rare[of[i]] += known.rare[own[i]]
        for i, t in enumerate(texts):
            if MARK_BYTES in t:
                every = t.lower().split()
                found = [known.logs[w] for w in every if w in known.logs]
                words[i], frequent[i], logs[i], rare[i] = len(every), len(found), sum(found), [w for w in every if w not in known.logs]
        end = float(np.log10((ends + 0.1) / scale))
        return {
            "n_tokens": words + 1, "n_frequent": frequent + (ends > 0), "frequent": logs + end, "score": model.score(known, own, n_units),
            "rare": pa.array([[w.decode() for w in r] for r in rare], pa.list_(pa.string())),
        }

    scored = map_texts(docs, ["doc_id"], "text", score, "n_tokens long, n_frequent long, frequent double, score double, rare array<string>")
    scored = stash(scored.withColumn("uid", F.monotonically_increasing_id()), "lm-scores")
    tail = scored.select("uid", F.explode("rare").alias("word")).groupBy("uid", "word").agg(F.count("*").alias("times"))
    count = F.coalesce("n", F.lit(0))
    tail = tail.join(words, "word", "left").select("uid", (F.col("times") * F.log10((count + 0.1) / scale)).alias("log"), F.when(count > 0, F.col("times")).otherwise(F.lit(0)).alias("known"))
    tail = tail.groupBy("uid").agg(F.sum("log").alias("log"), F.sum("known").alias("known"))
    zero = F.lit(0)
    return scored.drop("rare").join(tail, "uid", "left").select(
        "doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "n_tokens", (F.col("n_frequent") + F.coalesce("known", zero)).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("frequent") + F.coalesce("log", F.lit(0.0))).alias("base_score"), "score",
    )


def frequent_from(words: DataFrame, most: int) -> int:
    """The least count at which at most so many words remain; counts above 2**12 are looked at by their leading bits."""
    level = F.when(F.col("n") < 4096, F.col("n")).otherwise(F.pow(F.lit(2.0), F.floor(F.log2(F.col("n")))).cast("long"))
    rows = sorted(((r.level, r.k) for r in words.groupBy(level.alias("level")).agg(F.count("*").alias("k")).collect()), reverse=True)
    held, least = 0, 1 << 62
    for lv, k in rows:
        if held + k > most:
            break
        held, least = held + k, lv
    return least
