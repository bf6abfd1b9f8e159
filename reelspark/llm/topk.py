"""Exact top-k search by distributed histogram selection.

Everything is scored, several times if need be: each pass counts every query's scores in a global
histogram over an interval that holds its k-th best score, and the interval shrinks to the bin in
which that score lies, down to one integer.  A last pass keeps what scores above it and, of the
rows that tie with it, those with the smallest ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries scored at a time; with their vectors and intervals they are what a task is sent.
QUERY_BLOCK = 4096
BINS = 256
#: Candidate rows scored at a time against a block of queries (bounds a task's score matrix).
ROWS = 512


def int_vectors(col: pa.ListArray, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix of floor(scale * x)) per vector length; only vectors all of whose components are finite."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.list_(pa.float64()))
    sizes = np.asarray(col.value_lengths().fill_null(-1))
    off = np.asarray(col.offsets)
    flat = col.values.to_numpy(zero_copy_only=False)          # a null component becomes NaN
    for d in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == d)
        m = flat[off[rows][:, None] + np.arange(d)]
        good = np.isfinite(m).all(axis=1)
        if good.any():
            yield rows[good], np.floor(scale * m[good])


class Block:
    """A block of queries of one vector length, with the interval that holds each one's k-th best score."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, reach: float):
        order = np.argsort(ids)
        self.ids, self.vectors = ids[order], vectors[order]
        bound = np.ceil(np.sqrt((self.vectors ** 2).sum(1)) * reach) + 1
        self.lo, self.hi = -bound, bound                  # the k-th best score lies in [lo, hi]
        self.above = np.zeros(len(ids), np.int64)         # scores over hi

    def scores(self, ids: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Query x row scores; a query's own rows score below everything."""
        s = self.vectors @ m.T
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        own = np.flatnonzero(self.ids[at] == ids)
        s[at[own], own] = -np.inf
        return s

    def width(self) -> np.ndarray:
        return np.ceil((self.hi - self.lo + 1) / BINS)

    def histogram(self, s: np.ndarray, out: np.ndarray) -> None:
        lo, width = self.lo[:, None], self.width()[:, None]
        with np.errstate(invalid="ignore"):
            inside = (s >= lo) & (s <= self.hi[:, None])
        q, j = np.nonzero(inside)
        b = ((s[q, j] - self.lo[q]) // self.width()[q]).astype(np.int64)
        out += np.bincount(q * BINS + b, minlength=len(out))

    def refine(self, counts: np.ndarray, k: int) -> bool:
        """Shrink the intervals by a histogram; True when each holds one score only."""
        from_top = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] + self.above[:, None]
        enough = from_top >= k
        b = np.where(enough.any(1), BINS - 1 - np.argmax(enough[:, ::-1], axis=1), 0)
        row, width = np.arange(len(b)), self.width()
        few = ~enough.any(1)                               # fewer than k candidates: keep them all
        new_lo = np.where(few, self.lo, self.lo + b * width)
        new_hi = np.where(few, self.lo, np.minimum(self.hi, self.lo + (b + 1) * width - 1))
        over = np.where(b + 1 < BINS, from_top[row, np.minimum(b + 1, BINS - 1)], self.above)
        self.above = np.where(few, from_top[:, 0], over)
        self.lo, self.hi = new_lo, new_hi
        return bool((self.lo == self.hi).all())


def exact_top_k(vectors: DataFrame, is_query: Column, *, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
                scale: float = 64.0, query_block: int = QUERY_BLOCK) -> DataFrame:
    """The ``k`` best rows of every query by the inner product of ``floor(scale * x)``.

    Returns ``query_id long, rank int, vec_id long, score long``: all candidates if there are fewer than
    ``k``; ties go to the smaller id.  A query's candidates are the rows with another id and vectors of
    its length.  Vectors that are null, empty or hold a null or non-finite component, and rows with a
    null id, take no part.  Of query rows with equal ids one (the least vector) asks; repeated candidate
    rows count as often as they occur.  An empty table gives an empty result.  Scores are exact while
    they stay under 2**53.

    Queries are dealt in blocks of about ``query_block`` (by id hash), so that what is sent to a task
    is bounded however many queries there are; the rows are only ever read in place.
    """
    def narrow(df: DataFrame) -> DataFrame:
        return df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector")) \
            .where("vec_id IS NOT NULL AND vector IS NOT NULL")

    rows, queries = narrow(vectors), narrow(vectors.where(is_query))
    queries = queries.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    n_blocks = max(1, -(-queries.count() // query_block))

    def longest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, float] = {}
        for batch in batches:
            for _, m in int_vectors(batch.column(1), scale):
                best[m.shape[1]] = max(best.get(m.shape[1], 0.0), float((m ** 2).sum(1).max()))
        yield pa.record_batch([pa.array(list(best), pa.int32()), pa.array(list(best.values()), pa.float64())], names=["d", "n2"])

    reach = {r.d: np.sqrt(r.n2) for r in rows.mapInArrow(longest, "d int, n2 double").groupBy("d").agg(F.max("n2").alias("n2")).collect()}
    found = [_search(rows, queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == b), k, scale, reach) for b in range(n_blocks)]
    out = found[0]
    for df in found[1:]:
        out = out.unionAll(df)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(rows: DataFrame, queries: DataFrame, k: int, scale: float, reach: dict[int, float]) -> DataFrame:
    """Rows at or above each query's k-th best score (of ties per task the ``k`` smallest ids) for one block."""
    asked = queries.toArrow()
    ids = asked.column("vec_id").to_numpy()
    blocks = {m.shape[1]: Block(ids[at], m, reach.get(m.shape[1], 0.0)) for at, m in int_vectors(asked.column("vector"), scale)}

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for batch in batches:
            row_ids = batch.column(0).to_numpy()
            for at, m in int_vectors(batch.column(1), scale):
                if m.shape[1] in blocks:
                    for lo in range(0, len(at), ROWS):
                        yield m.shape[1], row_ids[at[lo:lo + ROWS]], m[lo:lo + ROWS]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hist = {d: np.zeros(len(b.ids) * BINS, np.int64) for d, b in blocks.items()}
        for d, row_ids, m in tiles(batches):
            blocks[d].histogram(blocks[d].scores(row_ids, m), hist[d])
        for d, h in hist.items():
            at = np.flatnonzero(h)
            yield pa.record_batch([pa.array(np.full(len(at), d), pa.int32()), pa.array(at), pa.array(h[at])], names=["d", "slot", "n"])

    done = not blocks
    while not done:
        counted = rows.mapInArrow(count, "d int, slot long, n long").groupBy("d", "slot").agg(F.sum("n").alias("n")).toArrow()
        d, slot, n = (counted.column(c).to_numpy() for c in ("d", "slot", "n"))
        done = True
        for dim, b in blocks.items():
            h = np.zeros(len(b.ids) * BINS, np.int64)
            h[slot[d == dim]] = n[d == dim]
            done &= b.refine(h.reshape(-1, BINS), k)

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ties: dict[int, tuple[np.ndarray, np.ndarray]] = {}    # per length: query numbers and ids that tie so far
        for d, row_ids, m in tiles(batches):
            b = blocks[d]
            s = b.scores(row_ids, m)
            q, j = np.nonzero(s > b.hi[:, None])
            yield pa.record_batch([pa.array(b.ids[q]), pa.array(row_ids[j]), pa.array(s[q, j].astype(np.int64))], names=["query_id", "vec_id", "score"])
            q, j = np.nonzero(s == b.hi[:, None])
            if len(q):
                was = ties.get(d, (np.zeros(0, np.int64),) * 2)
                q, v = np.concatenate([was[0], q]), np.concatenate([was[1], row_ids[j]])
                order = np.lexsort((v, q))
                q, v = q[order], v[order]
                place = np.arange(len(q)) - np.searchsorted(q, q)
                ties[d] = q[place < k], v[place < k]
        for d, (q, v) in ties.items():
            yield pa.record_batch([pa.array(blocks[d].ids[q]), pa.array(v), pa.array(blocks[d].hi[q].astype(np.int64))], names=["query_id", "vec_id", "score"])

    return rows.mapInArrow(select, "query_id long, vec_id long, score long")


ORACLE = """
WITH v AS (
  SELECT vec_id::BIGINT AS vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e))
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 20"""
