"""Conversion planning and the table forms of trim / resample / palette
(C1-C3).  The service hands these to an external encoder per file; here they
are bulk operations over request and time-series tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.timecols import epoch_ms
from ..session import reliable_checkpoint
from .ordered import DEFAULT_BUCKET_MS, time_buckets, keyed_running_max
from .usage import exact_percentiles


#: Times of a grid that one row makes.
GRID_BLOCK = 1000


# C1 / F6 - F8 ------------------------------------------------------------
def conversion_plan(requests: DataFrame, *, start: str, end: str, fps: str, width: str, loop: str) -> DataFrame:
    """Normalised parameters and the two filter texts of a conversion request.

    Start and end are float32 as in the request record, the duration is
    their float32 difference, and both print as ``%.2f``.
    """
    f = S.default_fps(F.col(fps))
    w = S.default_width(F.col(width))
    st, en = F.col(start).cast("float"), F.col(end).cast("float")
    return requests.select(
        "*",
        f.alias("plan_fps"), w.alias("plan_width"), S.loop_flag(F.col(loop)).alias("loop_arg"),
        S.fixed2(st).alias("ss"), S.fixed2(en - st).alias("t"),
        S.palette_filter(f, w).alias("palette_filter"), S.gif_filter(f, w).alias("gif_filter"))


# C2 ----------------------------------------------------------------------
def frame_grid(requests: DataFrame, *, start: Column, duration: Column, fps: Column, block: int = 1000) -> DataFrame:
    """One row per output frame: ``frame`` i and its time ``start + i / fps``.

    ``n = ceil(duration * fps)`` frames; zero or negative gives no rows (the
    guard matters: ``sequence(0, -1)`` would run backwards).  Frames are made in
    two steps, blocks and then frames of a block, so no row holds a long request's whole grid.
    """
    n = F.ceil(duration * fps).cast("bigint")
    none = F.array().cast("array<bigint>")
    blocks = F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n - 1, F.lit(block).cast("bigint"))).otherwise(none)
    out = requests.select("*", start.alias("__start"), fps.alias("__fps"), n.alias("__n"), F.explode(blocks).alias("__from"))
    frames = F.sequence(F.col("__from"), F.least(F.col("__n"), F.col("__from") + block) - 1)
    out = out.withColumn("frame", F.explode(frames))
    t = F.col("__start") + F.col("frame") / F.col("__fps")
    return out.withColumn("t_ms", F.floor(t * 1000).cast("bigint")).drop("__start", "__fps", "__n", "__from")


def series_resample(series: DataFrame, keys: DataFrame, *, key: str, ts: str, id_col: str, value: str,
                    grid_start: Column, grid_end: Column, step: str,
                    bucket_ms: int = DEFAULT_BUCKET_MS) -> DataFrame:
    """Sample a per-key time series on a regular grid: the last value at or before each grid time.

    The grid is generated per key in two steps, blocks and then the times of a block (no cross join, and no row
    holds a long grid); grid and samples are one time-ordered stream per key and the as-of value is a
    running max (samples sort before grid points at the same instant).  Sample ids may be of any sortable type.
    """
    every = F.expr(f"INTERVAL {step}")
    if re.search("month|year", step, re.I):         # calendar steps are few, and do not add up
        grid = keys.select(F.col(key).alias("__k"), F.explode(F.sequence(grid_start, grid_end, every)).alias("__t"))
    else:
        grid = keys.select(F.col(key).alias("__k"), grid_end.alias("__end"), F.explode(F.sequence(grid_start, grid_end, every * GRID_BLOCK)).alias("__from")) \
            .select("__k", F.explode(F.sequence("__from", F.least(F.col("__from") + every * (GRID_BLOCK - 1), "__end"), every)).alias("__t"))
    grid = grid.select("__k", "__t", F.lit(1).alias("__kind"), F.lit(None).cast(series.schema[id_col].dataType).alias("__id"))
    pts = (series.filter(F.col(ts) <= grid_end)
                 .select(F.col(key).alias("__k"), F.col(ts).alias("__t"), F.lit(0).alias("__kind"),
                         F.col(id_col).alias("__id"), F.col(value).alias("__v")))
    s = grid.unionByName(pts, allowMissingColumns=True)
    s = time_buckets(s, ["__k"], epoch_ms(F.col("__t")), bucket_ms, "__b", ["__t", "__kind", "__id"])
    s = keyed_running_max(s, ["__k"], "__b", ["__t", "__kind", "__id"],
                          F.when(F.col("__kind") == 0, F.struct(F.col("__t").alias("t"), F.col("__id").alias("id"),
                                                                F.col("__v").alias("v"))), "__last")
    return (s.filter(F.col("__kind") == 1)
             .select(F.col("__k").alias(key), F.col("__t").alias("t"), F.col("__last.v").alias(value),
                     F.col("__last.id").alias("sample_id"), F.col("__last.t").alias("sample_ts")))


# C3 ----------------------------------------------------------------------
def codebook_means(vectors: DataFrame, *, vec: str, group: str) -> DataFrame:
    """``code, center``: the mean vector of each group ((group, position) aggregates, any number of groups)."""
    x = vectors.select(F.col(group).alias("code"), F.posexplode(vec).alias("pos", "x"))
    means = x.groupBy("code", "pos").agg(F.avg("x").alias("m"))
    return means.groupBy("code").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("center"))


def codebook_assign(vectors: DataFrame, codebook: DataFrame, *, vec: str, block_values: int = 1 << 18) -> DataFrame:
    """Nearest code (squared Euclidean, ties to the smaller code) per vector; ``codebook`` is ``code, center``.

    The codebook is dealt into blocks of at most ``block_values`` numbers (2 MB) before any is
    gathered; a block is one row attached by a broadcast, and a running minimum takes the vectors
    from block to block.  So no (vector, code) pairs are made, and neither the number of codes nor
    their length is limited.
    """
    book = reliable_checkpoint(codebook.select("code", "center"))
    n, longest = book.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("center")), F.lit(1))).first()
    per = max(1, block_values // max(1, longest))
    blocks = max(1, -(-n // per))
    numbered = book.withColumn("__block", F.pmod(F.xxhash64("code"), F.lit(blocks))) if blocks > 1 else book.withColumn("__block", F.lit(0))

    def dist(c):
        sq = F.zip_with(F.col(vec), c["center"], lambda a, b: (a - b) * (a - b))
        return F.aggregate(sq, F.lit(0.0).cast("double"), lambda acc, y: acc + y)

    out = vectors
    for k in range(blocks):
        codes = numbered.where(F.col("__block") == k).agg(F.collect_list(F.struct("code", "center")).alias("__codes"))
        out = out.join(F.broadcast(codes), how="cross")
        best = F.array_min(F.transform("__codes", lambda c: F.struct(dist(c).alias("d"), c["code"].alias("code"))))
        best = F.least(F.col("__best"), best) if k else best
        out = out.withColumn("__best", best).drop("__codes")
    return out.withColumn("code", F.col("__best.code")).drop("__best")


def codebook_kmeans(vectors: DataFrame, *, vec: str, k: int, seed: int = 7, max_iter: int = 20) -> DataFrame:
    """Learnt codebook (MLlib k-means, distributed) in the shape of :func:`codebook_means`.

    The palette step learns ``k`` centres instead of taking group means; the
    result plugs into :func:`codebook_assign` unchanged.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    data = vectors.select(array_to_vector(F.col(vec)).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="features").fit(data)
    # clusterCenters() is k vectors, which MLlib itself holds on the driver
    return vectors.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())],
                                                "code int, center array<double>")


def median_cut(vectors: DataFrame, *, vec: str, codes: int) -> dict:
    """A palette by median cut: the widest box is cut at the exact median of its widest position, until there are ``codes``.

    A box's width is its greatest extent at any position (ties: the smaller box, then the smaller position).  Rows up to the
    median stay in the box and the others make the next box; where the median is the greatest value, rows of that value are
    the others.  Equal vectors share a box; when no box is wider than nothing, there are fewer codes.  Vectors that are null, or hold a
    null at the cut, stay in the box they are in.

    Returns the cuts as a small tree, at most ``2 * codes`` nodes, for :func:`median_cut_assign`.  Extents are aggregates per (box,
    position), medians exact percentiles from histograms, so no box is gathered.  Each round measures all boxes that may still be cut,
    not one: as many rounds as the tree is deep, about log2(codes).
    """
    tree = {"pos": [None], "cut": [None], "strict": [None], "low": [None], "high": [None]}
    width: dict[int, tuple[float, int, float]] = {}                 # node -> extent, position, greatest value
    while True:
        leaves = [n for n in range(len(tree["pos"])) if tree["pos"][n] is None and n not in width]
        if leaves:
            x = _walk(vectors, tree, vec).where(F.col("__node").isin(leaves)).select("__node", F.posexplode(vec).alias("pos", "x"))
            spans = x.groupBy("__node", "pos").agg((F.max("x") - F.min("x")).cast("double").alias("w"), F.max("x").cast("double").alias("hi"))
            best = spans.where("w IS NOT NULL").groupBy("__node").agg(F.max(F.struct("w", (-F.col("pos")).alias("p"), "hi")).alias("b")).collect()   # a row a box
            width.update({n: (0.0, 0, 0.0) for n in leaves} | {r[0]: (r.b.w, -r.b.p, r.b.hi) for r in best})
        boxes, missing = _greedy(tree, width, codes)
        if not missing:
            for n in boxes:             # cuts that were made ahead and not needed
                tree["pos"][n] = None
            return {**tree, "code": [boxes.index(n) if n in boxes else None for n in range(len(tree["pos"]))]}
        at = F.array(*[F.lit(width[n][1] if n in missing else None).cast("int") for n in range(len(tree["pos"]))])
        inside = _walk(vectors, tree, vec).where(F.col("__node").isin(missing)) \
            .select("__node", F.get(F.col(vec), F.get(at, F.col("__node"))).cast("double").alias("x"))
        for r in exact_percentiles(inside, ["__node"], "x", {"m": 0.5}).select("__node", "m").collect():     # a row a box
            n, size = r[0], len(tree["pos"])
            tree["pos"][n], tree["cut"][n], tree["strict"][n] = width[n][1], r.m, r.m == width[n][2]
            tree["low"][n], tree["high"][n] = size, size + 1
            for column in tree.values():
                column += [None, None]


def _greedy(tree: dict, width: dict, codes: int) -> tuple[list[int], list[int]]:
    """The boxes (tree nodes, by code) after as many cuts as are known, and the nodes to be cut before going on."""
    boxes = [0]
    while len(boxes) < codes:
        order = sorted(range(len(boxes)), key=lambda b: (-width[boxes[b]][0], b))
        if width[boxes[order[0]]][0] <= 0:
            break
        n = boxes[order[0]]
        if tree["pos"][n] is None:
            ahead = [boxes[b] for b in order[:codes - len(boxes)]]
            return boxes, [m for m in ahead if tree["pos"][m] is None and width[m][0] > 0]
        if tree["low"][n] not in width:
            break
        boxes[order[0]] = tree["low"][n]
        boxes.append(tree["high"][n])
    return boxes, []


def _walk(vectors: DataFrame, tree: dict, vec: str) -> DataFrame:
    """Add ``__node``: the leaf of the tree that a vector falls in, found in as many steps as the tree is deep."""
    kinds = {"pos": "int", "cut": "double", "strict": "boolean", "low": "int", "high": "int"}
    a = {c: F.array(*[F.lit(v).cast(kind) for v in tree[c]]) for c, kind in kinds.items()}
    depth = [0] * len(tree["pos"])
    for n, low in enumerate(tree["low"]):
        if low is not None and tree["pos"][n] is not None:
            depth[low] = depth[tree["high"][n]] = depth[n] + 1

    def step(n: Column, _: Column) -> Column:
        x, cut = F.get(F.col(vec), F.get(a["pos"], n)).cast("double"), F.get(a["cut"], n)
        above = F.coalesce((x > cut) | (F.get(a["strict"], n) & (x == cut)), F.lit(False))
        return F.when(F.get(a["pos"], n).isNull(), n).when(above, F.get(a["high"], n)).otherwise(F.get(a["low"], n))
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(max(depth))), F.lit(0), step) if max(depth) else F.lit(0)
    return vectors.withColumn("__node", walk)


def median_cut_assign(vectors: DataFrame, cuts: dict, *, vec: str) -> DataFrame:
    """Add ``code``: the box of :func:`median_cut` that a vector falls in.  ``codebook_means`` over it gives the boxes' colours."""
    code = F.array(*[F.lit(c).cast("int") for c in cuts["code"]])
    return _walk(vectors, cuts, vec).withColumn("code", F.get(code, F.col("__node"))).drop("__node")
