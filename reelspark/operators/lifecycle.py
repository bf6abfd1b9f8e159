"""Time-limited state evaluated as of any moment: tokens, blocklists, job
status, shares, accounts.

Interval and as-of joins are expressed as one time-ordered union per key and
a running max (``keyed_running_max``): no pairs are emitted, so a key with
many issues and many uses costs a linear pass, not a product.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.timecols import epoch_ms, epoch_us, from_epoch_us, plus
from .ordered import (DEFAULT_BUCKET_MS, as_is, as_long, fold_schema, folded, keyed_latest, keyed_running_max, segment_rows,
                      segmented_fold, time_buckets)


def _union_stream(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.unionByName(right, allowMissingColumns=True)


def _dec(n: int) -> Column:
    return F.lit(str(n)).cast("decimal(20,0)")


# J3 / J4 / M7 / M8 -------------------------------------------------------
def token_lifecycle(issues: DataFrame, uses: DataFrame, *, key: str, issue_ts: str, issue_id: str,
                    use_ts: str, use_id: str, ttl_hours: float,
                    bucket_ms: int = DEFAULT_BUCKET_MS) -> DataFrame:
    """Fate of every issued single-use token.

    A use belongs to the key's latest issue at or before it (a re-issue
    replaces the earlier token).  It is valid when ``issued < used <
    expires`` (strict, ``expire_at > now``).  The first valid use consumes the
    token; a token never used is ``replaced`` if the next issue came before
    its expiry, else ``expired``.
    """
    i = issues.select(F.col(key).alias("k"), F.col(issue_ts).alias("t"), F.lit(0).alias("kind"),
                      F.col(issue_id).alias("id"))
    u = uses.select(F.col(key).alias("k"), F.col(use_ts).alias("t"), F.lit(1).alias("kind"),
                    F.col(use_id).alias("id"))
    s = time_buckets(_union_stream(i, u), ["k"], epoch_ms(F.col("t")), bucket_ms, "__b", ["t", "kind", "id"])
    s = keyed_running_max(s, ["k"], "__b", ["t", "kind", "id"],
                          F.when(F.col("kind") == 0, F.struct(F.col("t").alias("t"), F.col("id").alias("id"))),
                          "owner", also_exclusive="prev_issue")
    # every row tells the token it concerns: an issue itself and its predecessor (which it replaces), a
    # use its owner; one aggregate by (key, token) then has all there is to know, without a join back
    valid = F.col("owner").isNotNull() & (F.col("t") > F.col("owner.t")) & (F.col("t") < plus(F.col("owner.t"), hours=ttl_hours))
    no_t, no_id = F.lit(None).cast(s.schema["t"].dataType), F.lit(None).cast(s.schema["id"].dataType)

    def note(token, issued, following, used, use):
        return F.struct(token.alias("token_id"), issued.alias("issued_at"), following.alias("next_at"), used.alias("ut"), use.alias("uid"))
    own = note(F.col("id"), F.col("t"), no_t, no_t, no_id)
    before = note(F.col("prev_issue.id"), no_t, F.col("t"), no_t, no_id)
    use = note(F.col("owner.id"), no_t, no_t, F.col("t"), F.col("id"))
    notes = (F.when((F.col("kind") == 0) & F.col("prev_issue").isNotNull(), F.array(own, before))
             .when(F.col("kind") == 0, F.array(own)).when(valid, F.array(use)))
    told = s.select("k", F.inline(notes))
    if isinstance(s.schema["id"].dataType, T.IntegralType):
        # time and id in one number: a fixed-width minimum, which aggregates by hash
        us = epoch_us(F.col("ut")).cast("decimal(18,0)")
        fu = F.min((us * _dec(1 << 64) + F.col("uid").cast("decimal(19,0)") + _dec(1 << 63)).cast("decimal(38,0)")).alias("fu")
    else:
        fu = F.min(F.when(F.col("ut").isNotNull(), F.struct("ut", "uid"))).alias("fu")
    out = (told.groupBy("k", "token_id").agg(F.max("issued_at").alias("issued_at"), F.min("next_at").alias("next_at"), fu)
               .withColumn("expire_at", plus(F.col("issued_at"), hours=ttl_hours)))
    status = (F.when(F.col("fu").isNotNull(), "consumed")
              .when(F.col("next_at") < F.col("expire_at"), "replaced")
              .otherwise("expired"))
    if isinstance(s.schema["id"].dataType, T.IntegralType):
        use_id = (F.pmod("fu", _dec(1 << 64)) - _dec(1 << 63)).cast(s.schema["id"].dataType)
        micros = F.expr(f"fu div cast('{1 << 64}' as decimal(20,0))")
        used_at = from_epoch_us(micros).cast(s.schema["t"].dataType)
    else:
        use_id, used_at = F.col("fu.uid"), F.col("fu.ut")
    return out.select(F.col("k").alias(key), "token_id", "issued_at", "expire_at", status.alias("status"),
                      use_id.alias("use_id"), used_at.alias("used_at"))


def reset_notices(lifecycle_rows: DataFrame, *, to: Column, queue: str = "email.queue") -> DataFrame:
    """J4: one notice message per successful reset (a consumed reset token)."""
    done = lifecycle_rows.filter(F.col("status") == "consumed")
    body = F.to_json(F.struct(to.alias("to"), F.lit("reset-password").alias("name"), F.lit("").alias("token")))
    return done.select("token_id", F.lit(queue).alias("queue"), body.alias("body"),
                       F.col("used_at").alias("published_at"))


# J5 / F16 ----------------------------------------------------------------
def blocklist_check(requests: DataFrame, blocks: DataFrame, *, key: str, req_ts: str, req_id: str,
                    block_ts: str, block_expire: Column, bucket_ms: int = DEFAULT_BUCKET_MS) -> DataFrame:
    """Add ``blocked`` to every request.

    A request is blocked when some block of its key has ``block_ts <= ts <
    expire``.  A block whose lifetime is <= 0 never blocks (no-op logout).
    The test is a running max of block expiry over the key's time-ordered
    stream (blocks sort before requests at the same instant).
    """
    r = requests.select("*", F.col(key).alias("__k"), F.col(req_ts).alias("__t"), F.lit(1).alias("__kind"),
                        F.col(req_id).alias("__id"))
    b = blocks.select(F.col(key).alias("__k"), F.col(block_ts).alias("__t"), F.lit(0).alias("__kind"),
                      F.lit(None).cast(requests.schema[req_id].dataType).alias("__id"), block_expire.alias("__exp"))
    s = time_buckets(_union_stream(r, b), ["__k"], epoch_ms(F.col("__t")), bucket_ms, "__b", ["__t", "__kind", "__id"])
    s = keyed_running_max(s, ["__k"], "__b", ["__t", "__kind", "__id"],
                          F.when(F.col("__kind") == 0, F.col("__exp")), "__maxexp")
    s = s.filter(F.col("__kind") == 1)
    blocked = F.coalesce(F.col("__maxexp") > F.col("__t"), F.lit(False))
    return s.withColumn("blocked", blocked).drop("__k", "__t", "__kind", "__id", "__exp", "__maxexp", "__b")


def blocklist_anti_join(requests: DataFrame, blocks: DataFrame, **kw) -> DataFrame:
    """Requests that pass the blocklist."""
    return blocklist_check(requests, blocks, **kw).filter(~F.col("blocked")).drop("blocked")


# J7 / W2 / T5 ------------------------------------------------------------
def job_status_asof(polls: DataFrame, statuses: DataFrame, *, key: str, poll_ts: str, poll_id: str,
                    status_ts: str, status_id: str, status_col: str, result_col: str | None,
                    ttl_hours: Mapping[str, float] | float, result_ttl_hours: float | None = None,
                    bucket_ms: int = DEFAULT_BUCKET_MS) -> DataFrame:
    """Latest status at or before each poll, and whether it has lapsed.

    ``outcome``: ``missing`` (no status yet), ``expired`` (the status's own
    lifetime ended at or before the poll) or ``ok``.

    The result key is kept apart from the status, as in the service: a row of ``statuses`` with a result sets it, for
    ``result_ttl_hours``, whatever status follows (a job that failed after its result was set still gives the key until the key
    itself lapses); a poll whose status is not ``ok`` gives none.  A row without a status but with a result sets the result alone.
    Without ``result_ttl_hours`` a result goes with the status row that carries it.
    """
    p = polls.select("*", F.col(key).alias("__k"), F.col(poll_ts).alias("__t"), F.lit(1).alias("__kind"),
                     F.col(poll_id).alias("__id"))
    res = F.col(result_col) if result_col else F.lit(None).cast("string")
    st = statuses.select(F.col(key).alias("__k"), F.col(status_ts).alias("__t"), F.lit(0).alias("__kind"),
                         F.col(status_id).alias("__id"), F.col(status_col).alias("__st"), res.alias("__res"))
    s = time_buckets(_union_stream(p, st), ["__k"], epoch_ms(F.col("__t")), bucket_ms, "__b", ["__t", "__kind", "__id"])
    own = result_ttl_hours is not None
    row = F.struct(F.col("__t").alias("t"), F.col("__id").alias("id"), F.col("__st").alias("status"), F.col("__res").alias("result"))
    set_ = (F.col("__kind") == 0) & (F.col("__st").isNotNull() if own else F.lit(True))
    values = {"__last": F.when(set_, row)}
    if own:
        values["__key"] = F.when((F.col("__kind") == 0) & F.col("__res").isNotNull(), row)
    s = keyed_latest(s, ["__k"], "__b", ["__t", "__kind", "__id"], values).filter(F.col("__kind") == 1)
    if isinstance(ttl_hours, Mapping):
        life = F.lit(None).cast("double")
        for name, h in ttl_hours.items():
            life = F.when(F.col("__last.status") == name, F.lit(float(h))).otherwise(life)
    else:
        life = F.lit(float(ttl_hours))
    expire = F.col("__last.t") + F.make_dt_interval(secs=(life * 3600).cast("decimal(18,6)"))
    outcome = (F.when(F.col("__last").isNull(), "missing")
               .when(~(expire > F.col("__t")) | life.isNull(), "expired")
               .otherwise("ok"))
    live = (plus(F.col("__key.t"), hours=result_ttl_hours) > F.col("__t")) if own else F.lit(True)
    return (s.withColumn("outcome", outcome)
             .withColumn("status", F.col("__last.status"))
             .withColumn("status_at", F.col("__last.t"))
             .withColumn("result_key", F.when((outcome == "ok") & live, F.col("__key.result" if own else "__last.result")))
             .drop("__k", "__t", "__kind", "__id", "__st", "__res", "__last", "__key", "__b"))


# J12 / D5 ----------------------------------------------------------------
def _reuse_kernel(ttl_ms: int):
    def kernel(pdf: pd.DataFrame, starts: list, state):
        """One step per issued token: from an issue, jump to the key's first row at or after its expiry."""
        t, ids = pdf["__t"].to_numpy(dtype="int64"), as_is(pdf["__id"])
        n = len(t)
        edges = [*np.flatnonzero(starts).tolist(), n]
        issue, first = np.full(n, -1, np.int64), 0
        if edges[0] > 0:                                   # rows that continue the state of the previous batch
            edges = [0, *edges]
        carried = None
        for lo, hi in zip(edges, edges[1:]):
            at = lo
            if lo == 0 and not starts[0] and state is not None:
                carried = state
                at = first = lo + int(np.searchsorted(t[lo:hi], state[0] + ttl_ms, "left"))
            while at < hi:
                issue[at], state = at, (int(t[at]), ids[at])
                at += int(np.searchsorted(t[at:hi], t[at] + ttl_ms, "left"))
        new = issue >= 0
        last = np.maximum.accumulate(issue)                 # the issue each row falls under
        token = np.empty(n, object)
        token[first:] = ids[last[first:]]
        if carried is not None:
            token[:first] = carried[1]
        out = pd.DataFrame({"key": as_is(pdf["__key"]), "id": ids, "t_ms": t,
                            "action": np.where(new, "new", "reuse"), "token_id": token})
        return out, state

    return kernel


def token_reuse(requests: DataFrame, *, key: str, ts: str, id_col: str, ttl_ms: int,
                bucket_ms: int = DEFAULT_BUCKET_MS, num_partitions: int | None = None, never_pausing: bool = False) -> DataFrame:
    """Reuse the active token, else issue a new one; reuse does not renew it.

    State per key is the active token's issue (time, id); a request at t
    reuses it while ``issued + ttl > t``.  A gap of ``ttl`` or more always
    issues anew, which is where the fold is cut into parallel segments.
    Output: ``key, id, t_ms, action ('new'|'reuse'), token_id``.

    ``never_pausing`` is for keys that go on for millions of requests without such a gap: their blocks are worked on at once
    (:func:`_chained`), with the same result.  Blocks should be many token lives long (``bucket_ms``).
    """
    df = requests.select(F.col(key).alias("__key"), F.col(id_col).alias("__id"), epoch_ms(F.col(ts)).alias("__t"))
    id_type = requests.schema[id_col].dataType.simpleString()
    schema = fold_schema(requests, key, id_col, f"t_ms long, action string, token_id {id_type}")
    if never_pausing:
        return _chained(df, ttl_ms, schema, bucket_ms)
    return segmented_fold(df, ["__key"], "__t", "__id", lambda gap: gap >= F.lit(ttl_ms), _reuse_kernel(ttl_ms), schema,
                          bucket_ms=bucket_ms, num_partitions=num_partitions)


def _jumps(ttl_ms: int):
    """The jump table of every block: for the latest issue before it, which issue the block ends with.

    The first issue of a block is its first row at or after some time within a token's life from its start, and from there every
    further issue follows.  A line stands for all entries up to ``upto`` (after those of the line before) that end alike.
    """
    names = ["key", "seg", "block", "upto", "end_t", "end_id"]

    def table(place: tuple, t: np.ndarray, ids: np.ndarray) -> list[tuple]:
        n = len(t)
        following = np.searchsorted(t, t + ttl_ms, "left")
        end = np.where(following < n, following, np.arange(n))
        while not np.array_equal(end, end[end]):                 # from jump to jump, twice as far each time
            end = end[end]
        entries = min(n, int(np.searchsorted(t, t[0] + ttl_ms, "left")) + 1)
        last = np.flatnonzero(np.append(end[1:entries] != end[:entries - 1], True))
        return [(*place, int(t[k]), int(t[end[k]]), ids[end[k]]) for k in last.tolist()]

    def run(batches):
        place, parts = None, []
        for pdf in batches:
            places = list(zip(as_is(pdf["__key"]), as_is(pdf["seg_t"]), as_is(pdf["__block"])))
            t, ids, out = pdf["__t"].to_numpy(dtype="int64"), as_is(pdf["__id"]), []
            edges = [0, *[k for k in range(1, len(places)) if places[k] != places[k - 1]], len(places)]
            for lo, hi in zip(edges, edges[1:]):
                if lo < hi and places[lo] != place:
                    if parts:
                        out += table(place, *(np.concatenate(x) for x in zip(*parts)))
                    place, parts = places[lo], []
                parts.append((t[lo:hi], ids[lo:hi]))
            yield pd.DataFrame({c: pd.Series([r[i] for r in out], dtype=object) for i, c in enumerate(names)})
        if parts:
            yield pd.DataFrame({c: pd.Series(list(v), dtype=object) for c, v in zip(names, zip(*table(place, *(np.concatenate(x) for x in zip(*parts)))))})
    return run


def _chain(ttl_ms: int):
    """From table to table in order: each block's state at its start, a line a block."""
    def run(batches):
        now, block, found, state = None, None, False, None
        for pdf in batches:
            key, seg, blocks = as_is(pdf["key"]), as_is(pdf["seg"]), pdf["block"].to_numpy(dtype="int64")
            upto, end_t, end_id = pdf["upto"].to_numpy(dtype="int64"), pdf["end_t"].to_numpy(dtype="int64"), as_is(pdf["end_id"])
            out = []
            for k in range(len(pdf)):
                if (key[k], seg[k]) != now:
                    now, block, state = (key[k], seg[k]), None, None
                if blocks[k] != block:
                    block, found = blocks[k], False
                    out.append((key[k], seg[k], block, *(state or (None, None))))
                if not found and (state is None or upto[k] >= state[0] + ttl_ms):
                    found, state = True, (int(end_t[k]), end_id[k])
            yield pd.DataFrame({c: pd.Series([r[i] for r in out], dtype=object) for i, c in enumerate(("key", "seg", "block", "from_t", "from_id"))})
    return run


def _from_kernel(ttl_ms: int):
    """The fold of blocks that bring the state they start from."""
    base = _reuse_kernel(ttl_ms)

    def kernel(pdf: pd.DataFrame, starts: list, state):
        from_t, from_id, parts = as_is(pdf["from_t"]), as_is(pdf["from_id"]), []
        # blocks that start anew are folded together; each block with a state of its own begins another call
        given = [k for k in np.flatnonzero(starts).tolist() if from_t[k] is not None]
        edges = sorted({0, *given, len(pdf)})
        for lo, hi in zip(edges, edges[1:]):
            begins = list(starts[lo:hi])
            if begins[0] and from_t[lo] is not None:
                begins[0], state = False, (int(from_t[lo]), from_id[lo])
            out, state = base(pdf.iloc[lo:hi], begins, state)
            parts.append(out)
        return pd.concat(parts, ignore_index=True), state
    return kernel


def _chained(df: DataFrame, ttl_ms: int, schema: str, bucket_ms: int) -> DataFrame:
    """Token reuse block by block: a jump table of each (narrow, in parallel), one scan over the tables, then all blocks at once.

    A block holds at most about ``ordered.DENSE_ROWS`` rows of a key; its table has a line only where entries end differently,
    so what goes through the one ordered scan of a segment is far less than its rows.
    """
    seg = segment_rows(df, ["__key"], "__t", "__id", lambda gap: gap >= F.lit(ttl_ms), bucket_ms, block="__block")
    types = {f.name: f.dataType.simpleString() for f in seg.schema.fields}
    place = f"key {types['__key']}, seg long, block long"
    # a segment within one block needs no state: it starts at a gap
    many = seg.groupBy(F.col("__key").alias("mk"), F.col("seg_t").alias("ms")).agg(F.min("__block").alias("lo"), F.max("__block").alias("hi")).where("lo < hi")
    long = seg.join(many, seg["__key"].eqNullSafe(many["mk"]) & seg["seg_t"].eqNullSafe(many["ms"]), "left_semi")
    part_cols = ["__key", "seg_t", "__block"]
    tables = long.select(*part_cols, "__t", "__id").repartition(*part_cols).sortWithinPartitions(*part_cols, "__t", "__id") \
        .mapInPandas(_jumps(ttl_ms), f"{place}, upto long, end_t long, end_id {types['__id']}")
    given = tables.repartition("key", "seg").sortWithinPartitions("key", "seg", "block", "upto") \
        .mapInPandas(_chain(ttl_ms), f"{place}, from_t long, from_id {types['__id']}")
    cond = seg["__key"].eqNullSafe(given["key"]) & seg["seg_t"].eqNullSafe(given["seg"]) & (seg["__block"] == given["block"])
    rows = seg.join(given, cond, "left").drop("key", "seg", "block", "gap_ms")
    return rows.repartition(*part_cols).sortWithinPartitions(*part_cols, "__t", "__id").mapInPandas(folded(part_cols, _from_kernel(ttl_ms)), schema)


# J11 ---------------------------------------------------------------------
def share_resolve(requests: DataFrame, shares: DataFrame, *, req_token: str, req_ts: str, want_col: str,
                  share_token: str, created_col: str, expires_col: str, access_col: str,
                  item_col: str) -> DataFrame:
    """HTTP-style outcome of resolving a share token at request time.

    404: unknown token, not yet created, or expired (null expiry = never);
    403: a 'view' share asked for a download; 200 otherwise.
    Tokens are unique, so the join is one-to-one at most.
    """
    sh = shares.select(F.col(share_token).alias("__tok"), F.col(created_col).alias("__c"),
                       F.col(expires_col).alias("__e"), F.col(access_col).alias("access"),
                       F.col(item_col).alias("item"))
    j = requests.join(sh, requests[req_token] == sh["__tok"], "left")
    t = F.col(req_ts)
    live = F.col("__tok").isNotNull() & (F.col("__c") <= t) & (F.col("__e").isNull() | (F.col("__e") > t))
    code = (F.when(~live, 404)
            .when((F.col(want_col) == "download") & (F.col("access") == "view"), 403)
            .otherwise(200))
    return (j.withColumn("code", code)
             .withColumn("item", F.when(code == 200, F.col("item")))
             .drop("__tok", "__c", "__e"))


# J13 ---------------------------------------------------------------------
def share_list(shares: DataFrame, *, owner_col: str, owner, item_col: str | None = None, item=None) -> DataFrame:
    """Shares scoped to one owner (and optionally one item)."""
    cond = F.col(owner_col) == F.lit(owner)
    if item_col is not None:
        cond = cond & (F.col(item_col) == F.lit(item))
    return shares.filter(cond)


def shares_for(shares: DataFrame, requests: DataFrame, *, owner_col: str, item_col: str,
               req_owner: str, req_item: str) -> DataFrame:
    """Bulk form: the shares matching each requested (owner, item) pair.

    A semi join on the composite key, so a request never sees another
    owner's shares and nothing fans out.
    """
    r = requests.select(F.col(req_owner).alias("__o"), F.col(req_item).alias("__i"))
    cond = (shares[owner_col] == r["__o"]) & (shares[item_col] == r["__i"])
    return shares.join(r, cond, "left_semi")


# M10 ---------------------------------------------------------------------
def account_sweep(accounts: DataFrame, *, deleted_col: str, as_of: Column) -> DataFrame:
    """Flag accounts whose ``deleted_at`` has passed (null = kept for ever)."""
    swept = F.col(deleted_col).isNotNull() & (F.col(deleted_col) <= as_of)
    return accounts.withColumn("swept", swept)


def token_reuse_stream(requests: DataFrame, *, key: str, ts: str, id_col: str, ttl_ms: int, **state) -> DataFrame:
    """Streaming twin of :func:`token_reuse`; adds ``late`` (see ``streaming.state``)."""
    from ..streaming.state import keyed_fold_stream
    return keyed_fold_stream(requests, key=key, ts=ts, id_col=id_col, kernel=_reuse_kernel(ttl_ms),
                             out_schema=fold_schema(requests, key, id_col,
                                                    f"t_ms long, action string, token_id {requests.schema[id_col].dataType.simpleString()}"),
                             idle_ms=ttl_ms, **state)


def _status_kernel(ttl_ms: Mapping[str, int], result_ttl_ms: int | None):
    def kernel(pdf: pd.DataFrame, starts: list, state):
        last, key = state or (None, None)              # [time, status, result], [time, result]: two lives
        kinds, ts_ = pdf["__kind"].tolist(), pdf["__t"].tolist()
        sts, res = pdf["__st"].tolist(), pdf["__res"].tolist()
        keep, outcome, status, result = [], [], [], []
        for i, k in enumerate(kinds):
            if k == 0:
                found = res[i] if isinstance(res[i], str) else None
                if isinstance(sts[i], str) or result_ttl_ms is None:
                    last = [ts_[i], sts[i] if isinstance(sts[i], str) else None, found]
                if found is not None:
                    key = [ts_[i], found]
                continue
            keep.append(i)
            if last is None:
                outcome.append("missing"); status.append(None); result.append(None)
                continue
            life = ttl_ms.get(last[1])
            ok = life is not None and last[0] + life > ts_[i]
            outcome.append("ok" if ok else "expired"); status.append(last[1])
            if result_ttl_ms is None:
                result.append(last[2] if ok else None)
            else:
                result.append(key[1] if ok and key is not None and key[0] + result_ttl_ms > ts_[i] else None)
        sub = pdf.iloc[keep]
        out = pd.DataFrame({"key": as_is(sub["__key"]), "id": as_is(sub["__id"]),
                            "t_ms": as_long(sub["__t"]).to_numpy(), "outcome": outcome, "status": status,
                            "result_key": result})
        return out, [last, key]
    return kernel


def job_status_stream(events: DataFrame, *, key: str, ts: str, id_col: str, is_status: Column,
                      status: Column, result: Column, ttl_ms: Mapping[str, int], result_ttl_ms: int | None = None,
                      evict_after_ms: int | None = None, **state) -> DataFrame:
    """Streaming twin of :func:`job_status_asof` over one stream of statuses and polls.

    State per key is the latest status and the latest result, each with its own time (``result_ttl_ms`` as there).  With ``evict_after_ms`` the state is
    dropped after at least that much time without a row of the key, after which a poll reads
    ``missing`` (as the service's expiring cache does) rather than ``expired``.
    """
    from ..streaming.state import keyed_fold_stream
    extra = {"__kind": F.when(is_status, F.lit(0)).otherwise(F.lit(1)),
             "__st": F.when(is_status, status), "__res": F.when(is_status, result)}
    return keyed_fold_stream(events, key=key, ts=ts, id_col=id_col, kernel=_status_kernel(dict(ttl_ms), result_ttl_ms),
                             out_schema=fold_schema(events, key, id_col, "t_ms long, outcome string, status string, result_key string"),
                             idle_ms=evict_after_ms, extra=extra, **state, order=("__t", "__kind", "__id"))
