"""The nearest vectors of a query set among all vectors, exactly, in blocks.

Every task has the queries (in blocks of BLOCK_BYTES; each block is a pass of its own) and multiplies them with its
vectors in single precision. What may be among the first within the error of that is computed again in double precision,
in the order of the dimensions, and only each task's first go on.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK_BYTES = 64 << 20
#: Vectors and queries that are multiplied at a time.
ROWS, QUERIES = 4096, 1024


def regular(vectors: DataFrame) -> bool:
    """All vectors (vec_id, embedding) are there, of one length, without nulls and zero vectors."""
    e = F.col("embedding")
    odd = F.col("vec_id").isNull() | e.isNull() | F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists(e, lambda x: x != 0)
    got = vectors.agg(F.min(F.size(e)).alias("a"), F.max(F.size(e)).alias("b"), F.max(odd.cast("int")).alias("odd")).first()
    return got.odd == 0 and got.a == got.b


def nearest(vectors: DataFrame, queries: DataFrame, limit: int = 10) -> DataFrame:
    """query_id, vec_id, score, rank of the `limit` vectors of the greatest cosine (to six digits), by id where cosines are equal; a vector isn't near its own id."""
    asked = queries.select("vec_id", "embedding").toArrow()
    ids = asked.column(0).to_numpy()
    rows = max(1, BLOCK_BYTES // max(1, 4 * (len(asked.column(1)[0]) if len(ids) else 1)))
    blocks = [(ids[i : i + rows], _matrix(asked.column(1).slice(i, rows).combine_chunks())) for i in range(0, len(ids), rows)]
    found = [_pass(vectors, block, limit) for block in blocks or [(ids, np.zeros((0, 1), np.float32))]]
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = reduce(DataFrame.unionAll, found).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    return ranked.select("query_id", "vec_id", F.greatest("score", F.lit(0.0)).alias("score"), F.col("rank").cast("long").alias("rank"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.float32).reshape(len(column), -1)


def _length(m: np.ndarray) -> np.ndarray:
    return np.sqrt(np.cumsum(m.astype(np.float64) ** 2, axis=1)[:, -1])


def _pass(vectors: DataFrame, block: tuple[np.ndarray, np.ndarray], limit: int) -> DataFrame:
    shared = vectors.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _First(*shared.value, limit)
        for batch in batches:
            for at in range(0, batch.num_rows if len(best.ids) else 0, ROWS):
                part = batch.slice(at, ROWS)
                best.add(part.column(0).to_numpy(), _matrix(part.column(1)))
        best.cut()
        yield pa.RecordBatch.from_arrays([pa.array(best.ids[best.query]), pa.array(best.vec), pa.array(best.score)], ["query_id", "vec_id", "score"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, "query_id long, vec_id long, score double")


class _First:
    """The first vectors of each query among those that were added."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, limit: int) -> None:
        self.ids, self.queries, self.limit = ids, queries, limit
        self.lengths = _length(queries) if len(ids) else np.zeros(0)
        self.units = (queries / self.lengths[:, None]).astype(np.float32)
        #: What single precision and rounding to six digits may hide, and below what a query's vectors can't be first any more.
        self.error = (queries.shape[1] + 32) * 2.4e-7 + 1e-6
        self.least = np.full(len(ids), -np.inf)
        self.query, self.vec, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.by_id = np.argsort(ids, kind="stable")

    def add(self, vec: np.ndarray, m: np.ndarray) -> None:
        lengths = _length(m)
        units = (m / lengths[:, None]).astype(np.float32)
        left, right = (np.searchsorted(self.ids, vec, side, sorter=self.by_id) for side in ("left", "right"))
        own_row = np.repeat(np.arange(len(vec)), right - left)
        own_query = self.by_id[np.concatenate([np.arange(a, b) for a, b in zip(left, right, strict=True)] or [[]]).astype(np.int64)]
        for at in range(0, len(self.ids), QUERIES):
            upto = min(at + QUERIES, len(self.ids))
            near = units @ self.units[at:upto].T
            mine = (own_query >= at) & (own_query < upto)
            near[own_row[mine], own_query[mine] - at] = -np.inf
            least = self.least[at:upto]
            if len(vec) > self.limit and np.isinf(least).any():
                least = np.maximum(least, np.partition(near, len(vec) - self.limit, axis=0)[len(vec) - self.limit] - 2 * self.error)
            row, query = np.nonzero((near >= least) & (near > -np.inf))
            exact = np.cumsum(m[row].astype(np.float64) * self.queries[at + query], axis=1)[:, -1] / (self.lengths[at + query] * lengths[row]) if len(row) else np.zeros(0)
            exact = np.maximum(-1.0, exact)
            self.query = np.concatenate([self.query, query + at])
            self.vec, self.score = np.concatenate([self.vec, vec[row]]), np.concatenate([self.score, np.copysign(np.floor(np.abs(exact) * 1e6 + 0.5) / 1e6, exact)])
            if len(self.query) > 4 * self.limit * max(len(self.ids), QUERIES):
                self.cut()
        self.cut()

    def cut(self) -> None:
        order = np.lexsort((self.vec, -self.score, self.query))
        query = self.query[order]
        place = np.arange(len(query)) - np.searchsorted(query, np.arange(len(self.ids)))[query]
        order, last = order[place < self.limit], order[place == self.limit - 1]
        self.least[self.query[last]] = self.score[last] - self.error
        self.query, self.vec, self.score = self.query[order], self.vec[order], self.score[order]
