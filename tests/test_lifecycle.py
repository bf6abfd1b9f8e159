"""Time-limited state: hand-written edge rows (FIXTURES section 4)."""

import pytest
from pyspark.sql import functions as F

from reelspark.functions.timecols import ntz, plus
from reelspark.operators import lifecycle as L
from reelspark.operators import ordered

from .conftest import T, ms

EV = "id long, k long, ts timestamp_ntz"


def df(spark, rows, schema=EV):
    return spark.createDataFrame(rows, schema)


def test_token_lifecycle_edges(spark):
    issues = df(spark, [(1, 1, T("2024-01-01 10:00:00")),      # used twice; first use wins
                        (2, 2, T("2024-01-01 10:00:00")),      # only use is exactly at expiry
                        (3, 3, T("2024-01-01 10:00:00")),      # re-issued before expiry
                        (4, 3, T("2024-01-01 10:30:00")),
                        (5, 4, T("2024-01-01 10:00:00")),      # re-issued after expiry
                        (6, 4, T("2024-01-01 12:00:00")),
                        (7, 5, T("2024-01-01 10:00:00"))])     # use before issue only
    uses = df(spark, [(11, 1, T("2024-01-01 10:10:00")), (12, 1, T("2024-01-01 10:20:00")),
                      (13, 2, T("2024-01-01 11:00:00")),
                      (14, 3, T("2024-01-01 10:40:00")),
                      (15, 5, T("2024-01-01 09:00:00"))])
    out = L.token_lifecycle(issues, uses, key="k", issue_ts="ts", issue_id="id", use_ts="ts", use_id="id",
                            ttl_hours=1)
    got = {r.token_id: (r.status, r.use_id) for r in out.collect()}
    assert got == {1: ("consumed", 11), 2: ("expired", None), 3: ("replaced", None), 4: ("consumed", 14),
                   5: ("expired", None), 6: ("expired", None), 7: ("expired", None)}


def test_token_reuse_keeps_first_issue(spark):
    rows = [(1, 1, T("2024-01-01 00:00:00")), (2, 1, T("2024-01-01 00:10:00")),
            (3, 1, T("2024-01-01 00:14:59")), (4, 1, T("2024-01-01 00:15:00")),  # first token lapsed
            (5, 1, T("2024-01-01 00:20:00")), (6, 2, T("2024-01-01 00:00:00"))]
    out = L.token_reuse(df(spark, rows), key="k", ts="ts", id_col="id", ttl_ms=15 * 60_000)
    got = {r.id: (r.action, r.token_id) for r in out.collect()}
    assert got == {1: ("new", 1), 2: ("reuse", 1), 3: ("reuse", 1), 4: ("new", 4), 5: ("reuse", 4),
                   6: ("new", 6)}


def test_blocklist_edges(spark):
    req = df(spark, [(1, 1, T("2024-01-01 10:00:00")),   # block comes after the request
                     (2, 2, T("2024-01-01 10:00:00")),   # block at the same instant
                     (3, 3, T("2024-01-01 12:00:00")),   # block lapsed
                     (4, 4, T("2024-01-01 10:30:00")),   # block of another key only
                     (5, 5, T("2024-01-01 10:30:00"))])  # lifetime <= 0: no-op
    blk = spark.createDataFrame([(1, T("2024-01-01 10:05:00"), T("2024-01-01 11:05:00")),
                                 (2, T("2024-01-01 10:00:00"), T("2024-01-01 11:00:00")),
                                 (3, T("2024-01-01 10:00:00"), T("2024-01-01 11:00:00")),
                                 (9, T("2024-01-01 10:00:00"), T("2024-01-01 11:00:00")),
                                 (5, T("2024-01-01 10:00:00"), T("2024-01-01 09:00:00"))],
                                "k long, ts timestamp_ntz, exp timestamp_ntz")
    out = L.blocklist_check(req, blk, key="k", req_ts="ts", req_id="id", block_ts="ts",
                            block_expire=F.col("exp"))
    got = {r.id: r.blocked for r in out.collect()}
    assert got == {1: False, 2: True, 3: False, 4: False, 5: False}


def test_job_status_edges(spark):
    polls = df(spark, [(1, 1, T("2024-01-01 09:00:00")),    # before any status
                       (2, 1, T("2024-01-01 10:03:00")),    # latest of two statuses, live
                       (3, 1, T("2024-01-01 10:20:00")),    # lapsed
                       (4, 2, T("2024-01-01 10:08:00"))])   # processing lives 10 min
    st = spark.createDataFrame([(1, T("2024-01-01 10:00:00"), 11, "queued", None),
                                (1, T("2024-01-01 10:02:00"), 12, "completed", "gif-12"),
                                (2, T("2024-01-01 10:00:00"), 13, "processing", None)],
                               "k long, ts timestamp_ntz, sid long, status string, res string")
    out = L.job_status_asof(polls, st, key="k", poll_ts="ts", poll_id="id", status_ts="ts", status_id="sid",
                            status_col="status", result_col="res",
                            ttl_hours={"queued": 5 / 60, "processing": 10 / 60, "completed": 5 / 60,
                                       "failed": 5 / 60})
    got = {r.id: (r.outcome, r.status, r.result_key) for r in out.collect()}
    assert got == {1: ("missing", None, None), 2: ("ok", "completed", "gif-12"),
                   3: ("expired", "completed", None), 4: ("ok", "processing", None)}


def test_share_resolve_edges(spark):
    shares = spark.createDataFrame(
        [(1, T("2024-01-01 00:00:00"), None, "view", "g1"),                      # never expires
         (2, T("2024-01-01 00:00:00"), T("2024-01-01 01:00:00"), "download", "g2"),  # expired
         (3, T("2024-01-01 00:00:00"), None, "view", "g3")],                     # view asked to download
        "token long, c timestamp_ntz, e timestamp_ntz, access string, item string")
    req = spark.createDataFrame([(1, T("2024-01-02 00:00:00"), "view"), (2, T("2024-01-01 02:00:00"), "download"),
                                 (3, T("2024-01-01 02:00:00"), "download"), (4, T("2024-01-01 02:00:00"), "view")],
                                "token long, ts timestamp_ntz, want string")
    out = L.share_resolve(req, shares, req_token="token", req_ts="ts", want_col="want", share_token="token",
                          created_col="c", expires_col="e", access_col="access", item_col="item")
    got = {r.token: (r.code, r.item) for r in out.collect()}
    assert got == {1: (200, "g1"), 2: (404, None), 3: (403, None), 4: (404, None)}


def test_active_tokens_strict_expiry(spark):
    from reelspark.operators.lookup import valid_at
    rows = df(spark, [(1, 1, T("2024-01-01 00:00:00")), (2, 1, T("2024-01-01 00:00:01"))])
    tok = rows.withColumn("exp", plus(F.col("ts"), minutes=15))
    got = valid_at(tok, "exp", ntz("2024-01-01 00:15:00"), issued_col="ts").select("id").collect()
    assert [r.id for r in got] == [2]


def test_blocklist_null_key_is_one_group(spark):
    req = df(spark, [(1, None, T("2024-01-02 10:00:00")), (2, None, T("2024-01-01 12:00:00")),
                     (3, 7, T("2024-01-02 10:00:00"))])
    blk = spark.createDataFrame([(None, T("2024-01-02 09:00:00"), T("2024-01-02 11:00:00"))],
                                "k long, ts timestamp_ntz, exp timestamp_ntz")
    out = L.blocklist_check(req, blk, key="k", req_ts="ts", req_id="id", block_ts="ts",
                            block_expire=F.col("exp"), bucket_ms=3_600_000)
    assert {r.id: r.blocked for r in out.collect()} == {1: True, 2: False, 3: False}


def test_reset_notices_one_per_consumed_token(spark):
    issues = df(spark, [(1, 1, T("2024-01-01 10:00:00")), (2, 2, T("2024-01-01 10:00:00"))])
    uses = df(spark, [(11, 1, T("2024-01-01 10:05:00")), (12, 1, T("2024-01-01 10:06:00"))])
    lc = L.token_lifecycle(issues, uses, key="k", issue_ts="ts", issue_id="id", use_ts="ts", use_id="id",
                           ttl_hours=0.25)
    notes = L.reset_notices(lc, to=F.concat(F.lit("u"), F.col("k").cast("string")))
    got = notes.collect()
    assert len(got) == 1 and got[0].token_id == 1 and '"name":"reset-password"' in got[0].body


@pytest.mark.parametrize("ttl_ms, bucket_ms", [(900_000, 14_400_000), (900_000, 600_000), (60_000, 3_600_000)])
def test_token_reuse_of_a_key_that_never_pauses(spark, monkeypatch, ttl_ms, bucket_ms):
    """Blocks chained by jump tables give what one ordered pass gives, ties, text ids and a null key included."""
    import random
    rng, t, rows = random.Random(ttl_ms), 0, []
    for i in range(4000):
        t += rng.choice([0, 1, 20, 50, 59]) * 1000
        rows.append((7, f"r{i % 1000:04d}-{i}", ms(t)))
    rows += [(rng.choice([None, 1]), f"x{i}", ms(rng.randint(0, t))) for i in range(150)]
    df = spark.createDataFrame(rows, "k long, id string, ts timestamp_ntz")
    p = dict(key="k", ts="ts", id_col="id", ttl_ms=ttl_ms)
    want = sorted(map(str, L.token_reuse(df, **p).collect()))
    monkeypatch.setattr(ordered, "DENSE_ROWS", 300)
    got = sorted(map(str, L.token_reuse(df, **p, bucket_ms=bucket_ms, never_pausing=True).collect()))
    assert got == want
