"""Per-key ordered state without putting a key's whole history in one task.

Two building blocks:

``keyed_running_max``
    running ``max`` of a struct per key in time order.  A struct whose first
    fields are the ordering fields makes "running max" equal to "latest
    non-null value at or before this row" (``last_value(...) IGNORE NULLS``),
    i.e. an as-of look-up.  It is computed per ``(key, time bucket)`` with a
    window, plus a carry-in from the key's earlier buckets taken from a small
    per-bucket summary (one row per key and bucket).  A hot key is therefore
    spread over as many tasks as it has buckets, and the only per-key window
    runs over the summary.

``segmented_fold``
    an exact sequential fold per key (token bucket, token reuse).  A fold
    whose state is fully determined at certain rows ("sync points": an idle
    reset, a full refill) is cut there into independent segments; segments
    are hash-partitioned by ``(key, segment)``, sorted inside the partition
    and folded by ``mapInPandas`` with O(1) state, streaming Arrow batches.
    A segment may span batches; the fold carries its state across them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import reliable_checkpoint

DEFAULT_BUCKET_MS = 3_600_000  # one hour of event time per window task


def time_bucket(t_ms: Column, bucket_ms: int) -> Column:
    return F.floor(t_ms / F.lit(bucket_ms)).cast("bigint")


def group_keys(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Non-nullable stand-ins for grouping columns: ``(isnull(c), coalesce(c, zero))``.

    The original column is replaced (restore it with :func:`drop_group_keys`)
    so every branch carries the same columns.  Already non-nullable columns
    are used as they are.  A null key stays its
    own group, and because the stand-ins cannot be null Catalyst infers no
    IS NOT NULL filter on one side of a summary join only - which would make
    the two branches differ and stop Spark from reusing their common
    shuffle.  Create them once per operator so every level shares them.
    """
    out = []
    for c in cols:
        f = df.schema[c]
        if not f.nullable:
            out.append(c)
            continue
        dt = f.dataType
        if isinstance(dt, T.NumericType):
            zero = F.lit(0).cast(dt)
        elif isinstance(dt, T.StringType):
            zero = F.lit("")
        elif isinstance(dt, T.BooleanType):
            zero = F.lit(False)
        elif isinstance(dt, T.DateType):
            zero = F.lit("1970-01-01").cast(dt)
        elif isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
            zero = F.lit("1970-01-01 00:00:00").cast(dt)
        else:
            out.append(c)
            continue
        n, v = f"__gn_{c}", f"__gv_{c}"
        df = df.withColumn(n, F.col(c).isNull()).withColumn(v, F.coalesce(F.col(c), zero)).drop(c)
        out += [n, v]
    return df, out


def drop_group_keys(df: DataFrame, only: Sequence[str] | None = None) -> DataFrame:
    """Restore the original key columns replaced by :func:`group_keys` (all, or ``only`` these)."""
    names = [c[len("__gn_"):] for c in df.columns if c.startswith("__gn_")]
    for c in names:
        if only is not None and c not in only:
            continue
        n = f"__gn_{c}"
        df = df.withColumn(c, F.when(~F.col(n), F.col(f"__gv_{c}"))).drop(n, f"__gv_{c}")
    return df


def keyed_running_max(df: DataFrame, keys: Sequence[str], bucket_col: str,
                      order: Sequence[str], value: Column, out_col: str,
                      inclusive: bool = True, also_exclusive: str | None = None) -> DataFrame:
    """``out_col`` = max of ``value`` over the key's rows before (and at) this one.

    Rows are ordered by ``(bucket_col, *order)``; ``bucket_col`` must be
    monotone in that order and non-null (see :func:`bucket_of`).  The
    per-bucket summary is a partial (map-side) aggregate of the raw values,
    so besides the rows' own shuffle only one row per key and bucket per task
    is shuffled.
    ``also_exclusive`` names a second output: the max over the rows strictly
    before this one, from the same pass.
    """
    nullable = [c for c in keys if df.schema[c].nullable]
    df, keys = group_keys(df, list(keys))  # a null key is its own group in the summary join too
    w = Window.partitionBy(*keys, bucket_col).orderBy(*order)
    tmp, inc, exc = f"__v_{out_col}", f"__i_{out_col}", f"__x_{out_col}"
    df = (df.withColumn(tmp, value)
            .withColumn(inc, F.max(tmp).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))))
    if not inclusive or also_exclusive:
        df = df.withColumn(exc, F.max(tmp).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    # max over a bucket of the running max = max of the raw values; taking it from the raw values
    # lets Spark aggregate partially before the shuffle (one row per key and bucket per task)
    summary = df.groupBy(*keys, bucket_col).agg(F.max(tmp).alias(f"__b_{out_col}"))
    w_b = Window.partitionBy(*keys).orderBy(bucket_col).rowsBetween(Window.unboundedPreceding, -1)
    summary = (summary.withColumn(f"__c_{out_col}", F.max(f"__b_{out_col}").over(w_b))
               .drop(f"__b_{out_col}"))
    df = df.join(summary, [*keys, bucket_col], "left")
    own = inc if inclusive else exc
    out = df.withColumn(out_col, F.greatest(own, f"__c_{out_col}"))
    if also_exclusive:  # the same running max over the rows strictly before (same pass)
        out = out.withColumn(also_exclusive, F.greatest(exc, f"__c_{out_col}"))
    out = out.drop(tmp, inc, exc, f"__c_{out_col}")
    return drop_group_keys(out, only=nullable)


def keyed_latest(df: DataFrame, keys: Sequence[str], bucket_col: str, order: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """Several running maxima at once: each of ``values`` as of every row (rows at or before it), by its name.

    One window over the rows and one over the summary, however many values there are; see :func:`keyed_running_max`.
    """
    nullable = [c for c in keys if df.schema[c].nullable]
    df, keys = group_keys(df, list(keys))
    run = Window.partitionBy(*keys, bucket_col).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumns({f"__v_{n}": v for n, v in values.items()})
    inner = df.withColumns({f"__i_{n}": F.max(f"__v_{n}").over(run) for n in values})
    summary = df.groupBy(*keys, bucket_col).agg(*[F.max(f"__v_{n}").alias(f"__b_{n}") for n in values])
    before = Window.partitionBy(*keys).orderBy(bucket_col).rowsBetween(Window.unboundedPreceding, -1)
    summary = summary.select(*keys, bucket_col, *[F.max(f"__b_{n}").over(before).alias(f"__c_{n}") for n in values])
    out = inner.join(summary, [*keys, bucket_col], "left").withColumns({n: F.greatest(f"__i_{n}", f"__c_{n}") for n in values})
    return drop_group_keys(out.drop(*[f"__{x}_{n}" for x in "vic" for n in values]), only=nullable)


def bucket_of(t: Column, bucket_ms: int) -> Column:
    """Non-nullable time bucket (rows without a time share bucket -1)."""
    return F.coalesce(time_bucket(t, bucket_ms), F.lit(-1).cast("bigint"))


#: Rows of one key in one time bucket above which the bucket is cut into slices, and slices at most.
DENSE_ROWS = 1_000_000
SLICES = 1024
#: Only the densest buckets are cut, so that the table of cuts is bounded (about 10 MB) and may be broadcast: a
#: bucket beyond them holds less than one row in so many.
DENSE_BUCKETS = 256
#: Cuts of a bucket are looked up in two steps, by the first of each run of so many.
RUN = 32


def time_buckets(df: DataFrame, keys: Sequence[str], t_ms: Column, bucket_ms: int, out: str, order: Sequence[str]) -> DataFrame:
    """Add ``out``, a bucket that is monotone in ``order`` per key and holds few rows of any key.

    Rows go by their time, and a time bucket in which a key is dense is cut further by the whole order, ties and all: at
    rows drawn from it.  So a burst at one instant, and rows without a time, spread too.  Which rows share a
    bucket never changes a result, only how the work is dealt out.

    Nothing runs while the plan is built: dense buckets are told from a hashed sample of the rows, about 1000 of
    ``DENSE_ROWS``, of which each of ``SLICES`` hash classes keeps one a bucket before the shuffle; without a dense bucket
    the join finds an empty table, which adaptive execution removes.
    """
    one_in = max(1, DENSE_ROWS // 1000)
    df = df.withColumn(out, bucket_of(t_ms, bucket_ms) * F.lit(SLICES))
    h, place = F.xxhash64(*order), F.struct(*order)
    drawn = df.where(F.pmod(h, F.lit(one_in)) == 0).select(*keys, out, h.alias("__h"), place.alias("__o"))
    drawn = drawn.groupBy(*keys, out, F.pmod(F.shiftright("__h", 20), F.lit(SLICES)).alias("__class")) \
        .agg(F.count(F.lit(1)).alias("__dn"), F.min(F.struct("__h", "__o")).alias("__one"))
    renamed = [F.col(c).alias(f"__d{i}") for i, c in enumerate([*keys, out])]
    dense = drawn.groupBy(*keys, out).agg((F.sum("__dn") * one_in).alias("__dn"), F.array_sort(F.collect_list("__one.__o")).alias("__drawn")) \
        .where(F.col("__dn") > DENSE_ROWS) \
        .select(*renamed, "__dn", "__drawn", F.least(F.lit(SLICES), F.ceil(F.col("__dn") / DENSE_ROWS)).cast("int").alias("__n")) \
        .orderBy(F.col("__dn").desc()).limit(DENSE_BUCKETS)
    cuts = F.transform(F.sequence(F.lit(1), F.col("__n") - 1), lambda i: F.get("__drawn", F.floor(i * F.size("__drawn") / F.col("__n")).cast("int")))
    runs = F.transform(F.sequence(F.lit(1), F.size("__at"), F.lit(RUN)), lambda i: F.slice("__at", i, RUN))
    dense = dense.withColumn("__at", cuts).select(*[f"__d{i}" for i in range(len(renamed))], runs.alias("__cuts"))
    cond = F.lit(True)
    for i, c in enumerate([*keys, out]):
        cond = cond & df[c].eqNullSafe(dense[f"__d{i}"])
    j = df.join(F.broadcast(dense), cond, "left")
    run = F.size(F.filter("__cuts", lambda r: F.get(r, 0) <= place))
    within = F.size(F.filter(F.get("__cuts", run - 1), lambda c: c <= place))
    slice_ = F.when(F.col("__cuts").isNull() | (run == 0), F.lit(0)).otherwise((run - 1) * RUN + within)
    return j.withColumn(out, F.col(out) + slice_).drop("__cuts", *[f"__d{i}" for i in range(len(renamed))])


def segment_rows(df: DataFrame, keys: Sequence[str], t_col: str, id_col: str,
                 is_sync: Callable[[Column], Column], bucket_ms: int = DEFAULT_BUCKET_MS, block: str | None = None) -> DataFrame:
    """Add ``gap_ms`` (null on a key's first row) and ``seg_t`` (and, as ``block``, the bucket that the work was dealt out by).

    ``gap_ms`` is ``t`` minus the previous row's ``t`` in (t, id) order.
    ``seg_t`` is the time of the latest sync row at or before this one;
    ``is_sync(gap_ms)`` says where the fold state is known without history
    (a key's first row always is).  Two sync rows with equal t share a
    ``seg_t``; that is harmless because a fold rebuilds its state at every
    sync row it meets.

    One pass: a window per (key, bucket) gives each row its in-bucket gap and
    the latest in-bucket sync time (the bucket's first row excluded, its gap
    is not known there); a per-bucket summary - taken from the same windowed
    rows, so the shuffle is shared - supplies the previous bucket's last time
    (the first row's gap) and the latest sync time of all earlier buckets.
    """
    b = "__bk_seg"
    df, gk = group_keys(time_buckets(df, keys, F.col(t_col), bucket_ms, b, [t_col, id_col]), keys)
    w = Window.partitionBy(*gk, b).orderBy(t_col, id_col)
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumn("__lag", F.lag(t_col).over(w))
    inner_sync = F.col("__lag").isNotNull() & is_sync(F.col(t_col) - F.col("__lag"))
    df = df.withColumn("__isync", F.max(F.when(inner_sync, F.col(t_col))).over(run))
    summ = df.groupBy(*gk, b).agg(F.min(t_col).alias("__min_t"), F.max(t_col).alias("__max_t"),
                                  F.max("__isync").alias("__last_isync"))
    before = Window.partitionBy(*gk).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    summ = summ.withColumn("__prev_max", F.max("__max_t").over(before))
    first_sync = F.col("__prev_max").isNull() | is_sync(F.col("__min_t") - F.col("__prev_max"))
    summ = (summ.withColumn("__first_sync", F.when(first_sync, F.col("__min_t")))
                .withColumn("__bucket_sync", F.greatest("__last_isync", "__first_sync")))
    summ = (summ.withColumn("__carry", F.max("__bucket_sync").over(before))
                .select(*gk, b, "__prev_max", "__first_sync", "__carry"))
    df = df.join(summ, [*gk, b], "left")
    gap = F.when(F.col("__lag").isNull(), F.col(t_col) - F.col("__prev_max")).otherwise(F.col(t_col) - F.col("__lag"))
    df = (df.withColumn("gap_ms", gap)
            .withColumn("seg_t", F.greatest("__isync", "__first_sync", "__carry"))
            .drop("__lag", "__isync", "__prev_max", "__first_sync", "__carry"))
    df = df.withColumnRenamed(b, block) if block else df.drop(b)
    return drop_group_keys(df)


def keyed_position(df: DataFrame, keys: Sequence[str], t_col: str, id_col: str, out_col: str = "pos",
                   total_col: str | None = None, bucket_ms: int = DEFAULT_BUCKET_MS,
                   t_ms: Column | None = None, summary_from_rows: bool = False) -> DataFrame:
    """1-based position of each row within its key in (t, id) order, and
    optionally the key's row count.

    Counted per (key, time bucket) with a window, plus the counts of the
    key's earlier buckets from a small per-bucket summary, so a hot key is
    never sorted whole in one task.  ``t_ms`` is the millisecond time used
    for bucketing (default: ``t_col`` itself, which must then be integral).
    """
    b = "__pos_b"
    tm = F.col(t_col) if t_ms is None else t_ms
    df, gk = group_keys(time_buckets(df, list(keys), tm, bucket_ms, b, [t_col, id_col]), list(keys))
    w = Window.partitionBy(*gk, b).orderBy(t_col, id_col)
    df = df.withColumn("__pos_in", F.row_number().over(w))
    if summary_from_rows:
        # rows carrying payload cannot share the window's shuffle with a narrow summary; a
        # count of the raw rows aggregates map-side instead of shuffling every row again
        summ = df.groupBy(*gk, b).agg(F.count(F.lit(1)).alias("__pos_n"))
    else:
        summ = df.groupBy(*gk, b).agg(F.max("__pos_in").alias("__pos_n"))
    before = Window.partitionBy(*gk).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    summ = summ.withColumn("__pos_c", F.coalesce(F.sum("__pos_n").over(before), F.lit(0)))
    if total_col:
        summ = summ.withColumn(total_col, F.sum("__pos_n").over(Window.partitionBy(*gk)).cast("bigint"))
    df = df.join(summ.drop("__pos_n"), [*gk, b], "left")
    df = df.withColumn(out_col, (F.col("__pos_in") + F.col("__pos_c")).cast("bigint")).drop(b, "__pos_in", "__pos_c")
    return drop_group_keys(df)


FoldFn = Callable[[pd.DataFrame, list, object], tuple[pd.DataFrame, object]]


def as_long(s: pd.Series) -> pd.Series:
    """A nullable 64-bit integer column for a fold's output."""
    return s.astype("Int64")


def as_is(s: pd.Series):
    """Values of a key or id column for a fold's output: any type, nulls kept (integers with nulls arrive as floats)."""
    if pd.api.types.is_float_dtype(s) and s.isna().any() and (s.dropna() % 1 == 0).all():
        s = s.astype("Int64")
    return s.astype(object).where(s.notna(), None).to_numpy()


def fold_schema(df: DataFrame, key: str, id_col: str, rest: str) -> str:
    """Output schema of a fold: key and id keep the input's types."""
    return f"key {df.schema[key].dataType.simpleString()}, id {df.schema[id_col].dataType.simpleString()}, {rest}"


def segmented_fold(df: DataFrame, keys: Sequence[str], t_col: str, id_col: str,
                   is_sync: Callable[[Column], Column], kernel: FoldFn, out_schema: str,
                   bucket_ms: int = DEFAULT_BUCKET_MS, num_partitions: int | None = None,
                   checkpoint: bool = False) -> DataFrame:
    """Exact ordered fold per key, parallel across keys and segments.

    ``kernel(batch, starts, state) -> (out_batch, state)`` folds one sorted
    pandas batch; ``starts[i]`` is True where a new segment begins.  The
    kernel must rebuild its state at any sync row (from ``gap_ms`` alone),
    and may rely on every segment start being a sync row.  ``state``
    carries a segment that continues from the previous Arrow batch.
    """
    keys = list(keys)
    seg = segment_rows(df, keys, t_col, id_col, is_sync, bucket_ms)
    if checkpoint:  # a lost executor during the fold then restarts from the written segments
        seg = reliable_checkpoint(seg)
    part_cols = [*keys, "seg_t"]
    parted = seg.repartition(num_partitions, *part_cols) if num_partitions else seg.repartition(*part_cols)
    ordered = parted.sortWithinPartitions(*part_cols, t_col, id_col)

    return ordered.mapInPandas(folded(part_cols, kernel), out_schema)


def folded(part_cols: Sequence[str], kernel: FoldFn) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """``kernel`` over batches that are sorted by ``part_cols``, told where each group begins, its state carried from batch to batch."""
    part_cols = list(part_cols)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, None
        for pdf in batches:
            if pdf.empty:
                continue
            sub = pdf[part_cols]
            prev = sub.shift()
            # null-safe "same segment as the previous row" (a null key is one group)
            same = ((sub == prev) | (sub.isna() & prev.isna())).all(axis=1).to_numpy()
            first = tuple(sub.iloc[0].tolist())
            same[0] = last is not None and all(a == b or (pd.isna(a) and pd.isna(b)) for a, b in zip(first, last))
            last = tuple(sub.iloc[-1].tolist())
            out, state = kernel(pdf, (~same).tolist(), state)
            yield out

    return run


def split_fold(df: DataFrame, keys: Sequence[str], t_col: str, id_col: str, is_sync: Callable[[Column], Column],
               block_kernel: FoldFn, kernel_from: Callable[[str], FoldFn], out_schema: str,
               bucket_ms: int = DEFAULT_BUCKET_MS, num_partitions: int | None = None) -> DataFrame:
    """:func:`segmented_fold` for keys that never pause: a segment is many blocks, folded at once wherever that can be.

    1. Every block of a segment is folded by itself.  ``block_kernel`` starts it without a state; from the row on where the state
       is the same whatever it was before, its rows are final (``known``), with the state after each (``tok``).
    2. The rows before it wait for the block ahead.  Of each block only whether it ends in a known state, and which, is gathered; the
       latest known one is where a row's state comes from.
    3. Waiting rows are folded from there (``kernel_from`` names the column with the state), those of neighbouring blocks
       without any known state in one piece.

    The blocks are written to the shared folder before step 2, which runs a job at once; nothing is folded twice.
    """
    keys, block = list(keys), "__block"
    names = {k: f"key{i}" for i, k in enumerate(keys)}
    seg = segment_rows(df, keys, t_col, id_col, is_sync, bucket_ms, block=block)
    part_cols = [*keys, "seg_t", block]
    parted = seg.repartition(num_partitions, *part_cols) if num_partitions else seg.repartition(*part_cols)
    types = {f.name: f.dataType.simpleString() for f in seg.schema.fields}
    held = ", ".join(f"{n} {types[c]}" for c, n in [*names.items(), ("seg_t", "seg_t"), (block, "block"), ("gap_ms", "gap_ms")])
    fields = [c.strip().split()[0] for c in out_schema.split(",")]
    one = reliable_checkpoint(parted.sortWithinPartitions(*part_cols, t_col, id_col).mapInPandas(
        folded(part_cols, block_kernel), f"{out_schema}, {held}, known boolean, tok double"))
    group = [*names.values(), "seg_t"]
    ends = one.groupBy(*group, "block").agg(F.max(F.when(F.col("known"), F.struct("t_ms", "id", "tok"))).alias("end"))
    before = Window.partitionBy(*group).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*[F.col(c).alias(f"e_{c}") for c in [*group, "block"]],
                       F.last(F.when(F.col("end").isNotNull(), F.struct(F.col("block").alias("b"), F.col("end.tok").alias("tok"))), ignorenulls=True).over(before).alias("from"))
    waiting = one.where("NOT known").drop("tok", "known")
    cond = F.lit(True)
    for c in [*group, "block"]:
        cond = cond & waiting[c].eqNullSafe(ends[f"e_{c}"])
    waiting = waiting.join(ends, cond).select(*[F.col(c).alias(f"__{c}") for c in [*group, "gap_ms", "id"]], F.col("t_ms").alias("__t"),
                                              F.col("from.b").alias("__from"), F.col("from.tok").alias("__state"))
    chain = [*[f"__{c}" for c in group], "__from"]
    waiting = waiting.withColumnsRenamed({"__gap_ms": "gap_ms", "__key0": "__key"})
    chain = ["__key" if c == "__key0" else c for c in chain]
    parted = waiting.repartition(num_partitions, *chain) if num_partitions else waiting.repartition(*chain)
    two = parted.sortWithinPartitions(*chain, "__t", "__id").mapInPandas(folded(chain, kernel_from("__state")), out_schema)
    return one.where("known").select(*fields).unionByName(two)
