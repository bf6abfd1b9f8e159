"""Keyed state of streams (T3-T6, T8, T9), kept by ``transformWithStateInPandas``.

State lives in the RocksDB store (``session.DEFAULT_CONF`` and ``session.scale_conf`` name it), on disk, and survives
restarts through the query's checkpoint.

No row is dropped.  A watermark on event time is global, so one key's clock would make another key's rows late; the
watermark here is on the *arrival* time, which no row is behind.  It moves with the stream's own micro-batches only, and the
rows of a micro-batch are handled before any timer fires, so a source that stalls for any time and resumes finds all
state as it was.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from ..functions.timecols import epoch_ms

Kernel = Callable[[pd.DataFrame, list, object], tuple[pd.DataFrame, object]]

#: How long the stream runs on (arrival time) without a row of a key before the key's state goes.
DEFAULT_EVICT_MS = 7 * 86_400_000
#: A machine clock may step back by so much without making a row late for the arrival watermark.
CLOCK_SLACK = "1 minute"


def arrived(stream: DataFrame, arrival: Column | None = None) -> DataFrame:
    """Add ``__arrived`` with the arrival watermark and ``__now``, the same in milliseconds.

    ``arrival`` defaults to the micro-batch's clock.  A column of the rows may be given where they carry the time at which
    they reached the queue; it must not go back by more than ``CLOCK_SLACK`` from one micro-batch to the next.
    """
    now = F.current_timestamp() if arrival is None else arrival.cast("timestamp")
    return stream.withColumn("__arrived", now).withColumn("__now", F.unix_millis("__arrived")).withWatermark("__arrived", CLOCK_SLACK)


def named(rows: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[pd.DataFrame]:
    """The frames with the stream's own column names, whatever Spark has made of them (it hands rows over as tuples)."""
    for pdf in rows:
        pdf.columns = columns
        yield pdf


class KeyedFold(StatefulProcessor):
    """A batch fold's kernel over a key's rows, micro-batch after micro-batch.

    State: the kernel's state, the key's own event clock (the last time folded) and when the key was last seen.  One timer a
    key at most; when it fires and the key has been seen since, it is set again.
    """

    def __init__(self, columns: list[str], kernel: Kernel, order: list[str], keep_ms: int | None, names: list[str], encode, decode):
        self.columns, self.kernel, self.order, self.keep_ms, self.names = columns, kernel, order, keep_ms, names
        self.encode, self.decode = encode, decode

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("fold", "kstate string, last_t long, seen long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = [p for p in named(rows, self.columns) if len(p)]
        pdf = (parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)).sort_values(self.order, kind="stable")
        now = int(pdf["__now"].max())
        kstate = last = seen = None
        if self.state.exists():
            text, last, seen = self.state.get()
            kstate = None if text is None else self.decode(text)
            behind = pdf["__t"].to_numpy(dtype="int64") < last
            if behind.any():
                old, pdf = pdf[behind], pdf[~behind]
                yield self.shaped(pd.DataFrame({"key": old["__key"].to_numpy(), "id": old["__id"].to_numpy(), "late": True}))
        if len(pdf):
            t = pdf["__t"].to_numpy(dtype="int64")
            before = np.concatenate([[np.nan if last is None else float(last)], t[:-1].astype("float64")])
            out, kstate = self.kernel(pdf.assign(gap_ms=t - before).reset_index(drop=True), [False] * len(pdf), kstate)
            last = int(t[-1])
            yield self.shaped(out.assign(late=False))
        self.state.update((None if kstate is None else self.encode(kstate), last, now))
        if self.keep_ms is not None and seen is None:
            self.handle.registerTimer(now + self.keep_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            due = self.state.get()[2] + self.keep_ms
            if due > expiredTimerInfo.getExpiryTimeInMs():
                self.handle.registerTimer(due)
            else:
                self.state.clear()
        return iter(())

    def shaped(self, out: pd.DataFrame) -> pd.DataFrame:
        return out.assign(**{c: None for c in self.names if c not in out})[self.names]

    def close(self) -> None:
        pass


def keyed_fold_stream(stream: DataFrame, *, key: str, ts: str, id_col: str, kernel: Kernel,
                      out_schema: str, idle_ms: int | None, evict_ms: int = DEFAULT_EVICT_MS,
                      extra: dict | None = None, order: tuple[str, ...] = ("__t", "__id"),
                      encode: Callable[[object], str] = json.dumps,
                      decode: Callable[[str], object] = json.loads, arrival: Column | None = None) -> DataFrame:
    """Apply ``kernel`` per key across micro-batches.

    The kernel sees columns ``__key, __id, __t, gap_ms`` (plus ``extra``) like the batch fold; ``gap_ms`` of a key's
    first row in a micro-batch is measured from the last row folded (null when the key has no state).  Rows of a key that
    arrive in one micro-batch are sorted by ``order`` first, in memory: bound a micro-batch by the source's trigger options.
    ``out_schema`` starts with the key and the id; ``late boolean`` is added to it.

    A row older than the last event its key has folded cannot be folded in order: it comes out at once with
    ``late = true`` and nulls for the fold's columns, for the caller to route.  Results equal the batch operator when each
    key's own events arrive in time order across micro-batches (a queue), whatever other keys' clocks say and however long the
    source stalls.  State goes after ``max(idle_ms, evict_ms)`` of arrival time in which the stream ran on without a row of the
    key; ``idle_ms=None`` keeps it for ever.
    """
    cols = [F.col(key).alias("__key"), F.col(id_col).alias("__id"), epoch_ms(F.col(ts)).alias("__t")]
    cols += [c.alias(n) for n, c in (extra or {}).items()]
    df = arrived(stream, arrival).select(*cols, "__now", "__arrived")
    keep_ms = None if idle_ms is None else max(int(idle_ms), int(evict_ms), 1)
    schema = T.StructType.fromDDL(out_schema).add("late", "boolean")
    return df.groupBy("__key").transformWithStateInPandas(
        KeyedFold(df.columns, kernel, list(order), keep_ms, schema.names, encode, decode), schema, "Append", "EventTime")


def packed(values: tuple) -> bytes:
    """A row's values as they are, for state that outlives the micro-batch."""
    return pickle.dumps(values, protocol=4)


def frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    """Rows of any values as a frame whose columns keep them (integers beside nulls too)."""
    return pd.DataFrame({n: pd.Series([r[k] for r in rows], dtype=object) for k, n in enumerate(names)}, columns=names)


def values_of(pdf: pd.DataFrame, names: list[str]) -> list[tuple]:
    """The rows of some columns as tuples of plain values, nulls as None."""
    columns = []
    for n in names:
        s = pdf[n]
        if pd.api.types.is_float_dtype(s) and s.isna().any() and (s.dropna() % 1 == 0).all():
            s = s.astype("Int64")           # integers beside nulls arrive as floats; a float column takes integers back
        columns.append(s.astype(object).where(s.notna(), None).tolist())
    return list(zip(*columns))


class Hold(StatefulProcessor):
    """Every delivery of a key waits in a list for its own time; a timer for each releases it."""

    def __init__(self, columns: list[str], names: list[str], delay_ms: int):
        self.columns, self.names, self.delay_ms = columns, names, delay_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "due long, row binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        due = timerValues.getCurrentProcessingTimeInMs() + self.delay_ms
        for pdf in named(rows, self.columns):
            if len(pdf):
                self.held.appendList([(due, packed(v)) for v in values_of(pdf, self.names)])
        self.handle.registerTimer(due)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        held = list(self.held.get())
        kept = [x for x in held if x[0] > now]
        if kept:
            self.held.put(kept)
        else:
            self.held.clear()
        out = [pickle.loads(bytes(x[1])) for x in held if x[0] <= now]
        if out:
            yield frame(out, self.names)

    def close(self) -> None:
        pass


class Await(StatefulProcessor):
    """Confirmations of a key wait for its object; objects are remembered for later confirmations.

    State: the object seen with the least time, and a list of waiting confirmations.  A timer for each waiting one, one for
    the object.
    """

    def __init__(self, columns: list[str], names: list[str], wait_ms: int, retention_ms: int | None, lag_ms: int):
        self.columns, self.names, self.wait_ms, self.retention_ms, self.lag_ms = columns, names, wait_ms, retention_ms, lag_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.object = handle.getValueState("object", "t long, size long, type string, until long")
        self.waiting = handle.getListState("waiting", "t long, came long, row binary")

    def outcome(self, t: int, seen: tuple) -> list:
        """What the confirmation at ``t`` gets, now that the object is known."""
        there = seen[0] <= t + self.wait_ms and (self.retention_ms is None or seen[0] >= t - self.retention_ms)
        return ["saved", seen[1], seen[2]] if there else ["dead", None, None]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = self.object.get() if self.object.exists() else None
        came, new, asked = 0, None, []
        for pdf in named(rows, self.columns):
            for kind, t, now, size, type_ in zip(pdf["__kind"], pdf["__t"], pdf["__now"], pdf["__size"], pdf["__type"]):
                if kind == 0:
                    one = (int(t), None if pd.isna(size) else int(size), None if pd.isna(type_) else type_)
                    new = one if new is None else min(new, one, key=lambda o: (o[0], o[1] is not None, o[1] or 0, o[2] is not None, o[2] or ""))
                came = max(came, int(now))
            mine = pdf[pdf["__kind"] == 1]
            asked += zip(mine["__t"].astype("int64").tolist(), mine["__now"].astype("int64").tolist(), values_of(mine, self.names))
        if new is not None and (seen is None or new[0] < seen[0]):
            until = 0
            if self.retention_ms is not None:
                until = came + self.retention_ms + self.wait_ms + self.lag_ms
                self.handle.registerTimer(until)
            seen = (*new, until)
            self.object.update(seen)
            held = list(self.waiting.get()) if self.waiting.exists() else []
            if held:
                asked = [(t, at, pickle.loads(bytes(row))) for t, at, row in held] + asked
                self.waiting.clear()
        if not asked:
            return
        if seen is None:
            self.waiting.appendList([(t, at, packed(row)) for t, at, row in asked])
            for due in {at + self.wait_ms + self.lag_ms for _, at, _ in asked}:
                self.handle.registerTimer(due)
        else:
            yield frame([(*row, *self.outcome(t, seen)) for t, _, row in asked], [*self.names, "outcome", "size_bytes", "content_type"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        if self.object.exists() and 0 < self.object.get()[3] <= now:
            self.object.clear()
        held = list(self.waiting.get()) if self.waiting.exists() else []
        done = [x for x in held if x[1] + self.wait_ms + self.lag_ms <= now]
        if done:
            kept = [x for x in held if x[1] + self.wait_ms + self.lag_ms > now]
            if kept:
                self.waiting.put(kept)
            else:
                self.waiting.clear()
            yield frame([(*pickle.loads(bytes(row)), "late" if at - t > self.lag_ms else "dead", None, None) for t, at, row in done],
                        [*self.names, "outcome", "size_bytes", "content_type"])

    def close(self) -> None:
        pass
