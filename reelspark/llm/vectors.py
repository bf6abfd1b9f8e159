"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors at cosine ``c`` or more are within squared distance ``2 - 2c``.  After a fixed rotation
each vector is split into low-dimensional blocks, and a pair within the whole budget must be within a
block's proportional share of it in at least one block.  So every block is range-joined on its own:
vectors are dealt over grid cells of the block's leading coordinates (to each cell their half-radius
box touches; a pair is looked at in the cell of its midpoint only), cells with many vectors are split
into tiles, and inside a tile the block distances are compared.  A pair found in several blocks is
kept in the first, then verified by its exact cosine, and counted where it is found: tasks return
link counts and a spanning forest, never the pairs themselves.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .components import components
from .textops import stream

#: Dimensions of a block, and how many of them span the grid.
BLOCK_DIMS = 8
GRID_DIMS = 2
#: Vectors a tile takes; a cell with more is split.
TILE = 2048
#: Split cells up to which their list is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 10_000
#: Rotated coordinates are compared as integers of this unit, so that every task decides alike.
UNIT = float(1 << 20)


def list_matrix(col) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) per vector length, of the vectors that are finite and not zero."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    col = col.cast(pa.list_(pa.float64()))
    sizes, off = np.asarray(col.value_lengths().fill_null(-1)), np.asarray(col.offsets)
    flat = col.values.to_numpy(zero_copy_only=False)
    for d in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == d)
        m = flat[off[rows][:, None] + np.arange(d)]
        good = np.isfinite(m).all(axis=1) & (m != 0).any(axis=1)
        if good.any():
            yield rows[good], m[good]


def unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)       # no overflow in the squares
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def rotate(u: np.ndarray) -> np.ndarray:
    """Fixed random signs, then a Walsh-Hadamard transform (padded to a power of two), in integer units.

    Only elementwise sums, so a vector's result does not depend on the batch it is in.
    """
    n, d = u.shape
    size = 1 << max(3, (d - 1).bit_length())
    x = np.zeros((n, size))
    x[:, :d] = u * np.where(stream(41, d) >> np.uint64(63), 1.0, -1.0)
    step = 1
    while step < size:
        y = x.reshape(n, -1, 2, step)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(n, size)
        step *= 2
    return np.rint(x * (UNIT / math.sqrt(size)))


def budget(blocks: int, threshold: float) -> float:
    """Squared distance a block may have, in integer units, rounding allowed for."""
    return math.ceil(((2 - 2 * threshold) / blocks + 1e-5) * UNIT * UNIT)


def cells_of(x: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell coordinates) of every cell that a row's half-radius box touches; ``x``: leading coordinates."""
    radius = math.isqrt(int(limit)) + 1
    low, high = np.floor((x - radius / 2) / (2 * radius)), np.floor((x + radius / 2) / (2 * radius))
    rows, cells = [], []
    for corner in itertools.product((0, 1), repeat=x.shape[1]):
        c = np.where(corner, high, low)
        new = ((high > low) | (np.array(corner) == 0)).all(axis=1)   # an unsplit dimension counts once
        rows.append(np.flatnonzero(new))
        cells.append(c[new])
    return np.concatenate(rows), np.concatenate(cells).astype(np.int64)


def pair_links(vec: np.ndarray, ids: np.ndarray, left: np.ndarray, right: np.ndarray, same: bool, block: int, cell: np.ndarray,
               threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked (i, j) rows between two sets of rows of one cell, each pair in its first block and midpoint cell."""
    u = unit(vec)
    r = rotate(u)
    blocks = r.shape[1] // BLOCK_DIMS
    limit = budget(blocks, threshold)
    radius = math.isqrt(int(limit)) + 1
    part = r.reshape(len(r), blocks, BLOCK_DIMS)
    own = part[:, block]
    norm = (own * own).sum(1)
    out_i, out_j = [], []
    for a in range(0, len(left), 1024):
        la = left[a:a + 1024]
        for b in range(a if same else 0, len(right), 1024):
            rb = right[b:b + 1024]
            near = norm[la][:, None] + norm[rb][None, :] - 2 * (own[la] @ own[rb].T) <= limit
            i, j = np.nonzero(near)
            if same and a == b:
                i, j = i[i < j], j[i < j]
            for k in range(0, len(i), 1 << 16):
                x, y = la[i[k:k + (1 << 16)]], rb[j[k:k + (1 << 16)]]
                mid = np.floor((own[x, :GRID_DIMS] + own[y, :GRID_DIMS]) / (4 * radius))
                keep = (mid == cell).all(axis=1) & (ids[x] != ids[y])
                x, y = x[keep], y[keep]
                for first in range(block):
                    if len(x):
                        diff = part[x, first] - part[y, first]
                        keep = (diff * diff).sum(1) > limit
                        x, y = x[keep], y[keep]
                keep = (u[x] * u[y]).sum(1) >= threshold
                out_i.append(x[keep])
                out_j.append(y[keep])
    z = np.zeros(0, np.int64)
    return np.concatenate([z, *out_i]), np.concatenate([z, *out_j])


def forest(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least id of each row's component under the links (minimum propagation with pointer jumps over row numbers)."""
    order = np.argsort(ids, kind="stable")
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    a, b, root = rank[i], rank[j], np.arange(len(ids))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return ids[order[root[rank]]]
        root = new


def near_duplicate_vectors(vectors: DataFrame, *, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding",
                           label_col: str = "label", tile: int = TILE) -> DataFrame:
    """Link vectors of one label at cosine ``threshold`` or more; one row per input row.

    Returns ``vec_id``, ``n_links long``, ``component_id long``, ``kept boolean``.  Rows with a null
    label, and vectors that are null, empty, zero or hold a null or non-finite component, link with
    nothing; so do vectors of different lengths.  A null id links with nothing and is kept.  Rows that
    share an id share its links, and never link with each other.  An empty table gives an empty one.
    """
    spec = F.col(id_col).cast("long")
    rows = vectors.select(spec.alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("vector")) \
        .where("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL")

    def expand(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(vector length, block, row numbers, cells)"""
        for at, m in list_matrix(batch.column(2)):
            r = rotate(unit(m))
            blocks = r.shape[1] // BLOCK_DIMS
            limit = budget(blocks, threshold)
            for block in range(blocks):
                rows_, cells = cells_of(r[:, block * BLOCK_DIMS:block * BLOCK_DIMS + GRID_DIMS], limit)
                yield m.shape[1], block, at[rows_], cells

    def keys(batches: Iterator[pa.RecordBatch], payload: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, block, at, cells in expand(batch):
                take = pa.array(at)
                cols = [batch.column(1).take(take), pa.array(np.full(len(at), d), pa.int32()),
                        pa.array(np.full(len(at), block), pa.int32()),
                        pa.FixedSizeListArray.from_arrays(pa.array(cells.ravel()), GRID_DIMS).cast(pa.list_(pa.int64()))]
                names = ["label", "dims", "block", "cell"]
                if payload:
                    cols += [batch.column(0).take(take), batch.column(2).take(take)]
                    names += ["vec_id", "vector"]
                yield pa.record_batch(cols, names=names)

    key = "label string, dims int, block int, cell array<bigint>"
    cell = ["label", "dims", "block", "cell"]
    big = stored(rows.mapInArrow(lambda it: keys(it, False), key).groupBy(*cell).count().where(F.col("count") > tile)
                 .select(*cell, F.ceil(F.col("count") / tile).cast("int").alias("splits")), "vec-cells")
    n_big = big.count()
    vector_type = vectors.schema[vector_col].dataType.simpleString()
    dealt = rows.mapInArrow(lambda it: keys(it, True), f"{key}, vec_id long, vector {vector_type}")
    dealt = dealt.join(F.broadcast(big) if n_big <= BROADCAST_ROWS else big, cell, "left") \
        .withColumn("splits", F.coalesce("splits", F.lit(1))) \
        .withColumn("side", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.col("splits")).cast("int")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("splits") - 1))) \
        .withColumn("tile_a", F.least("side", "other")).withColumn("tile_b", F.greatest("side", "other")).drop("splits", "other")

    def link(group: pa.Table) -> pa.Table:
        ids = group.column("vec_id").to_numpy()
        (at, vec), = list_matrix(group.column("vector"))
        side, a, b = (group.column(c).to_numpy() for c in ("side", "tile_a", "tile_b"))
        i, j = pair_links(vec, ids, np.flatnonzero(side == a[0]), np.flatnonzero(side == b[0]), a[0] == b[0],
                          group.column("block")[0].as_py(), np.asarray(group.column("cell")[0].as_py(), float), threshold)
        links = np.bincount(i, minlength=len(ids)) + np.bincount(j, minlength=len(ids))
        hit = np.flatnonzero(links)
        return pa.table({"node": ids[hit], "root": forest(ids, i, j)[hit], "links": links[hit].astype(np.int64)})

    found = stored(dealt.groupBy(*cell, "tile_a", "tile_b").applyInArrow(link, "node long, root long, links long"), "vec-links")
    linked = found.groupBy("node").agg(F.sum("links").alias("n_links"))
    comp = components(found.where("node <> root"), "node", "root", "vec-components")
    per = linked.join(comp.withColumnRenamed("node", "node2"), F.col("node") == F.col("node2"), "left") \
        .select(F.col("node"), "n_links", F.coalesce("component", "node").alias("component"))
    out = vectors.select(spec.alias("vec_id")).join(per, F.col("vec_id") == F.col("node"), "left")
    comp_id = F.coalesce("component", "vec_id")
    return out.select(F.col("vec_id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      comp_id.alias("component_id"), F.coalesce(comp_id == F.col("vec_id"), F.lit(True)).alias("kept"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id::BIGINT AS id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.label = b.label AND a.id <> b.id AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON l.a = r.b),
c AS (SELECT a, least(a, min(b)) AS comp FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id::BIGINT AS vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(comp, vec_id)::BIGINT AS component_id,
  coalesce(comp, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id"""
