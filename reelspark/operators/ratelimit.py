"""T6: exact per-key token-bucket admission, in order.

Semantics of the service's atomic script, per request of a key at time t:

* a key seen for the first time, or idle for ``idle_ms`` or more, starts a
  fresh bucket holding ``min(capacity, init)`` (the service starts it at the
  *rate*, not the capacity: ``init`` defaults to ``rate``);
* otherwise the bucket refills ``rate`` tokens per ``per_ms`` of elapsed
  time, capped at ``capacity``;
* a request with at least one token is allowed and spends it; a denied one
  gets ``wait_ms = ceil((1 - tokens) / rate * per_ms)``;
* every request, allowed or not, moves the refill clock.

Clamping plus spending is not associative, so this is a sequential fold.  It
is cut into independent segments at rows whose state needs no history: an
idle reset, or a gap long enough to refill a bucket from empty to full
(``gap / per_ms * rate >= capacity``).  See :mod:`.ordered`.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timecols import epoch_ms
from .ordered import DEFAULT_BUCKET_MS, as_is, as_long, fold_schema, segmented_fold, split_fold

DECISION = "t_ms long, allowed boolean, tokens long, wait_ms long, retry_after_s long"


#: Denied requests in a row from which they are told in one step.
STRETCH = 16


def _decide(gaps: list, first: float | None, tok: float | None, starts: list, capacity: float, rate: float, per_ms: float,
            idle_ms: int, start: float):
    """(allowed, tokens after, wait) of requests in order: ``gaps`` before each, ``first`` the content at the first where it is known.

    A run of denied requests only refills, so a long one is one running sum, whose additions are those of the request-by-request form.
    """
    n, i = len(gaps), 0
    allowed, after, wait = [False] * n, [0.0] * n, [0] * n
    denied = 0
    while i < n:
        g = gaps[i]
        if first is not None:
            r, first = first, None
        elif g != g or g >= idle_ms:            # first row of the key, or idle reset
            r = start
        elif starts[i]:                         # segment starts on a full refill
            r = capacity
        else:
            r = min(capacity, tok + (g / per_ms) * rate)
        if r >= 1:
            allowed[i] = True
            tok = r - 1
            denied = 0
        else:
            tok = r
            wait[i] = math.ceil(((1 - r) / rate) * per_ms)
            denied += 1
        after[i] = tok
        i += 1
        if denied >= STRETCH and i < n:
            ahead = min(n, i + 4 * denied)
            g = np.asarray(gaps[i:ahead])
            known = ~(g < idle_ms) | np.asarray(starts[i:ahead], dtype=bool)
            fill = np.cumsum(np.concatenate(([tok], (g / per_ms) * rate)))[1:]
            stop = np.flatnonzero(known | ~(fill < 1))
            m = int(stop[0]) if len(stop) else len(g)
            if m:
                some = fill[:m]
                after[i:i + m] = some.tolist()
                wait[i:i + m] = np.ceil(((1 - some) / rate) * per_ms).astype("int64").tolist()
                tok = after[i + m - 1]
                i += m
                denied += m
    return allowed, after, wait, tok


def _decisions(pdf: pd.DataFrame, allowed: list, after: list, wait: list) -> pd.DataFrame:
    w = np.asarray(wait, dtype="int64")
    return pd.DataFrame({
        "key": as_is(pdf["__key"]),
        "id": as_is(pdf["__id"]),
        "t_ms": as_long(pdf["__t"]).to_numpy(),
        "allowed": np.asarray(allowed, dtype=bool), "tokens": np.floor(np.asarray(after, dtype="float64")).astype("int64"),
        "wait_ms": w, "retry_after_s": w // 1000,
    })


def _gaps(pdf: pd.DataFrame) -> list:
    return pdf["gap_ms"].to_numpy(dtype="float64", na_value=np.nan).tolist()


def _bucket_kernel(capacity: float, rate: float, per_ms: float, idle_ms: int, init: float):
    start = min(capacity, init)

    def kernel(pdf: pd.DataFrame, starts: list, tok):
        allowed, after, wait, tok = _decide(_gaps(pdf), None, tok, starts, capacity, rate, per_ms, idle_ms, start)
        return _decisions(pdf, allowed, after, wait), tok

    return kernel


def _kernel_from(capacity: float, rate: float, per_ms: float, idle_ms: int, init: float):
    """The fold of rows whose group brings the state it starts from, in a column."""
    start = min(capacity, init)

    def named(column: str):
        def kernel(pdf: pd.DataFrame, starts: list, tok):
            gaps, begins, given = _gaps(pdf), np.flatnonzero(starts).tolist(), pdf[column].tolist()
            edges = [*([] if starts[0] else [0]), *begins, len(gaps)]
            parts = []
            for lo, hi in zip(edges, edges[1:]):
                tok = given[lo] if starts[lo] else tok
                *part, tok = _decide(gaps[lo:hi], None, tok, [False] * (hi - lo), capacity, rate, per_ms, idle_ms, start)
                parts.append(part)
            return _decisions(pdf, *[[x for part in parts for x in part[k]] for k in range(3)]), tok
        return kernel
    return named


def _block_kernel(capacity: float, rate: float, per_ms: float, idle_ms: int, init: float):
    """The fold of a block that starts in any state: ``known`` from the row on where the state no longer depends on it.

    The least and the greatest content that are possible are followed; where the least is clamped at the capacity (or the row resets
    the bucket), there is only one.  What a request does to a content between the two stays between the two.
    """
    start = min(capacity, init)

    def meet(gaps: list, low: float, high: float) -> tuple[int, float, float, float | None]:
        """(first row where the content before the request is known, bounds at the end, that content)."""
        for i, g in enumerate(gaps):
            if g != g or g >= idle_ms:
                return i, 0.0, 0.0, start
            fill = (g / per_ms) * rate
            low, high = min(capacity, low + fill), min(capacity, high + fill)
            if fill >= capacity or low >= capacity:
                return i, 0.0, 0.0, capacity
            if low >= 1:
                low, high = low - 1, high - 1
            elif high >= 1:                     # some contents are spent from, some are not
                low, high = 0.0, max(1.0, high - 1)
        return len(gaps), low, high, None

    def kernel(pdf: pd.DataFrame, starts: list, state):
        gaps, begins = _gaps(pdf), np.flatnonzero(starts).tolist()
        n = len(gaps)
        edges = [*([] if starts[0] else [0]), *begins, n]
        allowed, after, wait, known = [False] * n, [math.nan] * n, [0] * n, np.zeros(n, dtype=bool)
        for lo, hi in zip(edges, edges[1:]):
            if starts[lo]:
                state = (None, 0.0, capacity)   # (known content after the last row, bounds of it otherwise)
            tok, low, high = state
            at, first = lo, None
            if tok is None:
                m, low, high, first = meet(gaps[lo:hi], low, high)
                at = lo + m
            if at < hi:
                allowed[at:hi], after[at:hi], wait[at:hi], tok = _decide(gaps[at:hi], first, tok, [False] * (hi - at), capacity, rate, per_ms, idle_ms, start)
                known[at:hi] = True
            state = (tok, low, high)
        told = np.asarray(after)
        out = _decisions(pdf, allowed, np.where(known, told, 0.0), wait)
        return out.assign(key0=as_is(pdf["__key"]), seg_t=as_long(pdf["seg_t"]).to_numpy(), block=as_long(pdf["__block"]).to_numpy(),
                          gap_ms=as_long(pdf["gap_ms"]).to_numpy(), known=known, tok=told), state

    return kernel


def token_bucket(requests: DataFrame, *, key: str, ts: str, id_col: str, capacity: float = 10,
                 rate: float = 5, per_ms: float = 1000, idle_ms: int = 6000, init: float | None = None,
                 bucket_ms: int = DEFAULT_BUCKET_MS, num_partitions: int | None = None,
                 checkpoint: bool = False, never_pausing: bool = False) -> DataFrame:
    """One decision per request: ``key, id, t_ms, allowed, tokens, wait_ms, retry_after_s``.

    Defaults are the service's (capacity 10, 5 tokens/s, 6 s idle life).
    ``key`` and ``id_col`` may be of any sortable type and keep it (an address, a UUID, a number);
    ``ts`` is a timestamp column.

    ``never_pausing`` is for logs with keys that go on for millions of requests without a sync point (``fold_segments`` tells): such
    a key is folded in many blocks at once (:func:`.ordered.split_fold`), which a clamp at the capacity makes independent of what
    came before.  A key that stays over its rate for good is clamped by nothing and stays one ordered task, in which a
    run of denied requests costs a running sum.  Results are the same either way.
    """
    init = rate if init is None else init
    cap, rt, per = float(capacity), float(rate), float(per_ms)
    df = requests.select(F.col(key).alias("__key"), F.col(id_col).alias("__id"), epoch_ms(F.col(ts)).alias("__t"))

    def is_sync(gap):
        return (gap >= F.lit(idle_ms)) | ((gap.cast("double") / F.lit(per)) * F.lit(rt) >= F.lit(cap))

    if never_pausing:
        how = (cap, rt, per, idle_ms, float(init))
        return split_fold(df, ["__key"], "__t", "__id", is_sync, _block_kernel(*how), _kernel_from(*how),
                          fold_schema(requests, key, id_col, DECISION), bucket_ms=bucket_ms, num_partitions=num_partitions)
    kernel = _bucket_kernel(cap, rt, per, idle_ms, float(init))
    return segmented_fold(df, ["__key"], "__t", "__id", is_sync, kernel,
                          fold_schema(requests, key, id_col, DECISION), bucket_ms=bucket_ms, num_partitions=num_partitions, checkpoint=checkpoint)


def token_bucket_sql(table: str, key: str, ts: str, id_col: str, capacity: float, rate: float,
                     per_ms: float, idle_ms: int, init: float) -> str:
    """The same fold as a DuckDB recursive CTE (the oracle)."""
    d = lambda x: f"CAST({float(x)!r} AS DOUBLE)"
    start = f"least({d(capacity)}, {d(init)})"
    gap = "(e.t - b.t)"
    r = (f"(CASE WHEN {gap} >= {int(idle_ms)} THEN {start} "
         f"ELSE least({d(capacity)}, b.tok + (CAST({gap} AS DOUBLE) / {d(per_ms)}) * {d(rate)}) END)")
    r0 = start

    def row(rx):
        return (f"CASE WHEN {rx} >= 1 THEN {rx} - 1 ELSE {rx} END AS tok, "
                f"{rx} >= 1 AS allowed, "
                f"CASE WHEN {rx} >= 1 THEN 0 ELSE CAST(ceil(((1 - {rx}) / {d(rate)}) * {d(per_ms)}) AS BIGINT) END AS wait_ms")

    return f"""
WITH RECURSIVE e AS (
  SELECT {key} AS key, {id_col} AS id, (epoch_us({ts}) // 1000) AS t,
         row_number() OVER (PARTITION BY {key} ORDER BY (epoch_us({ts}) // 1000), {id_col}) AS rn
  FROM {table}),
b AS (
  SELECT key, id, t, rn, {row(r0)} FROM e WHERE rn = 1
  UNION ALL
  SELECT e.key, e.id, e.t, e.rn, {row(r)} FROM b JOIN e ON e.key = b.key AND e.rn = b.rn + 1)
SELECT key, id, t AS t_ms, allowed, CAST(floor(tok) AS BIGINT) AS tokens, wait_ms,
       wait_ms // 1000 AS retry_after_s
FROM b"""


def token_bucket_stream(requests, *, key: str, ts: str, id_col: str, capacity: float = 10,
                        rate: float = 5, per_ms: float = 1000, idle_ms: int = 6000,
                        init: float | None = None, **state):
    """Streaming twin of :func:`token_bucket` (keyed state, idle eviction); adds ``late`` (see ``streaming.state``)."""
    from ..streaming.state import keyed_fold_stream
    init = rate if init is None else init
    kernel = _bucket_kernel(float(capacity), float(rate), float(per_ms), idle_ms, float(init))
    return keyed_fold_stream(requests, key=key, ts=ts, id_col=id_col, kernel=kernel,
                             out_schema=fold_schema(requests, key, id_col, DECISION), idle_ms=idle_ms, **state)


def fold_segments(requests: DataFrame, *, key: str, ts: str, id_col: str, capacity: float = 10,
                  rate: float = 5, per_ms: float = 1000, idle_ms: int = 6000, top: int = 20,
                  bucket_ms: int = DEFAULT_BUCKET_MS) -> DataFrame:
    """The largest sequential pieces of :func:`token_bucket`: ``key, seg_t, rows`` (top ``top``).

    Segments between sync points fold in parallel; a segment itself is one
    ordered task.  This report shows how long those tasks are, so a key that
    never pauses long enough to sync is visible before it becomes a straggler.
    """
    from .ordered import segment_rows
    cap, rt, per = float(capacity), float(rate), float(per_ms)
    df = requests.select(F.col(key).alias("key"), F.col(id_col).alias("id"), epoch_ms(F.col(ts)).alias("t"))

    def is_sync(gap):
        return (gap >= F.lit(idle_ms)) | ((gap.cast("double") / F.lit(per)) * F.lit(rt) >= F.lit(cap))

    seg = segment_rows(df, ["key"], "t", "id", is_sync, bucket_ms)
    sizes = seg.groupBy("key", "seg_t").agg(F.count(F.lit(1)).alias("rows"))
    return sizes.orderBy(F.col("rows").desc(), "key", "seg_t").limit(top)
