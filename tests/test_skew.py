"""One key holding a third of all rows: results stay exact and the work is spread."""

import pytest
from pyspark.sql import functions as F

from reelspark.functions.timecols import epoch_ms, plus
from reelspark.operators import lifecycle, messages, ordered, ratelimit

from .conftest import SF01
from .test_token_bucket import brute_force

HOT = 999_999
H = 3_600_000


@pytest.fixture(scope="module")
def skewed(spark):
    ev = spark.read.parquet(f"{SF01}/events.parquet")
    return ev.withColumn("user_id", F.when(F.col("event_id") % 3 == 0, F.lit(HOT)).otherwise(F.col("user_id")))


def test_token_bucket_exact_with_hot_key(spark, skewed):
    p = dict(capacity=3, rate=5.0, per_ms=H, idle_ms=48 * H, init=1)
    got = {r.id: (r.allowed, r.tokens, r.wait_ms) for r in
           ratelimit.token_bucket(skewed, key="user_id", ts="ts", id_col="event_id", **p).collect()}
    rows = [(r.event_id, r.user_id, r.t) for r in
            skewed.select("event_id", "user_id", epoch_ms(F.col("ts")).alias("t")).collect()]
    assert got == brute_force(rows, 3, 5.0, H, 48 * H, 1)


def test_hot_key_fold_is_split_across_tasks(spark, skewed):
    df = skewed.select(F.col("user_id").alias("k"), F.col("event_id").alias("id"), epoch_ms(F.col("ts")).alias("t"))
    seg = ordered.segment_rows(df, ["k"], "t", "id", lambda g: (g.cast("double") / H) * 5.0 >= 3.0)
    hot_rows = df.filter(F.col("k") == HOT).count()
    per_task = (seg.filter(F.col("k") == HOT).repartition(16, "k", "seg_t")
                .groupBy(F.spark_partition_id().alias("p")).count().collect())
    assert len(per_task) > 8                      # the hot key's segments land on many tasks
    assert max(r["count"] for r in per_task) < hot_rows / 4


def test_running_state_windows_spread_hot_key(spark, skewed):
    df = skewed.select(F.col("user_id").alias("k"), F.col("event_id").alias("id"), epoch_ms(F.col("ts")).alias("t"))
    b = df.withColumn("b", ordered.bucket_of(F.col("t"), ordered.DEFAULT_BUCKET_MS))
    groups = b.filter(F.col("k") == HOT).groupBy("k", "b").count()
    hot_rows = df.filter(F.col("k") == HOT).count()
    # the per-(key, bucket) windows each see a small slice of the hot key
    assert groups.agg(F.max("count")).first()[0] < hot_rows / 100


def test_blocklist_exact_with_hot_key(spark, skewed):
    req = skewed.filter(F.col("event_type") == "view")
    blk = skewed.filter(F.col("event_type") == "error")
    out = lifecycle.blocklist_anti_join(req.select("event_id", "user_id", "ts"), blk, key="user_id", req_ts="ts",
                                        req_id="event_id", block_ts="ts", block_expire=plus(F.col("ts"), hours=24))
    got = {r.event_id for r in out.collect()}
    r = [(x.event_id, x.user_id, x.ts) for x in req.collect()]
    bl = {}
    for x in blk.collect():
        bl.setdefault(x.user_id, []).append(x.ts)
    import datetime as dt
    want = {i for i, u, t in r if not any(b <= t < b + dt.timedelta(hours=24) for b in bl.get(u, []))}
    assert got == want


def test_fold_segment_report_finds_the_hot_key(spark, skewed):
    rep = ratelimit.fold_segments(skewed, key="user_id", ts="ts", id_col="event_id", capacity=3, rate=5.0,
                                  per_ms=H, idle_ms=48 * H, top=5).collect()
    assert rep[0].key == HOT and rep[0].rows >= rep[-1].rows
    # the hot key's segments add up to all of its rows
    seg_total = (ratelimit.fold_segments(skewed, key="user_id", ts="ts", id_col="event_id", capacity=3, rate=5.0,
                                         per_ms=H, idle_ms=48 * H, top=100000)
                 .filter(F.col("key") == HOT).agg(F.sum("rows")).first()[0])
    assert seg_total == skewed.filter(F.col("user_id") == HOT).count()


def test_a_dense_hour_of_one_key_is_split(spark, monkeypatch):
    """One key holds a third of the rows within a single hour: split buckets give what whole ones give."""
    hot = spark.range(600).select(F.lit(7).cast("long").alias("k"), F.col("id"), F.expr("timestamp_ntz'2024-01-01 05:00:00' + make_dt_interval(0,0,0,(id*id*7919) % 3600)").alias("ts"))
    rest = spark.range(600, 1800).select((F.col("id") % 50).alias("k"), F.col("id"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0,0,id % 900,0)").alias("ts"))
    ev = hot.unionAll(rest).unionAll(spark.createDataFrame([(None, 9001), (None, 9002)], "k long, id long").withColumn("ts", F.expr("timestamp_ntz'2024-01-01 05:00:00'")))

    def run():
        life = lifecycle.token_lifecycle(ev.where("id % 3 = 0"), ev.where("id % 3 <> 0"), key="k", issue_ts="ts", issue_id="id", use_ts="ts", use_id="id", ttl_hours=0.05)
        bucket = ratelimit.token_bucket(ev, key="k", ts="ts", id_col="id", capacity=3, rate=1, per_ms=20_000, idle_ms=600_000, init=1)
        retry = messages.retry_dead_letter(ev, message_key=["k"], ts="ts", id_col="id", max_retries=5, queue=F.lit("q"))
        block = lifecycle.blocklist_check(ev.where("id % 2 = 0"), ev.where("id % 31 = 1"), key="k", req_ts="ts", req_id="id", block_ts="ts",
                                          block_expire=F.col("ts") + F.expr("INTERVAL 2 MINUTES"))
        return [sorted(map(str, d.collect())) for d in (life, bucket, retry.select("k", "id", "retries", "action"), block.select("k", "id", "blocked"))]
    whole = run()
    monkeypatch.setattr(ordered, "DENSE_ROWS", 40)
    assert run() == whole


@pytest.mark.parametrize("when", ["timestamp_ntz'2024-01-01 05:00:00'", "cast(null as timestamp_ntz)"])
def test_a_burst_at_one_instant_or_without_a_time_is_split(spark, monkeypatch, when):
    """All rows of the hot key have one time, or none: they are many slices, and give what one slice gives."""
    hot = spark.range(900).select(F.lit(777).cast("long").alias("k"), F.concat(F.lit("id-"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("id"), F.expr(when).alias("ts"))
    rest = spark.range(900, 2700).select((F.col("id") % 50).alias("k"), F.concat(F.lit("id-"), F.col("id").cast("string")).alias("id"),
                                         F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0,0,id % 900,0)").alias("ts"))
    ev = hot.unionAll(rest)
    b = ordered.time_buckets(ev, ["k"], epoch_ms(F.col("ts")), H, "b", ["ts", "id"])
    assert b.where("k = 777").select("b").distinct().count() < 3

    def run():
        retry = messages.retry_dead_letter(ev, message_key=["k"], ts="ts", id_col="id", max_retries=5, queue=F.lit("q"))
        block = lifecycle.blocklist_check(ev.where("hash(id) % 2 = 0"), ev.where("k <> 777 AND hash(id) % 7 = 1"), key="k", req_ts="ts", req_id="id", block_ts="ts",
                                          block_expire=F.col("ts") + F.expr("INTERVAL 2 MINUTES"))
        status = lifecycle.job_status_asof(ev.where("hash(id) % 3 = 0"), ev.where("hash(id) % 3 <> 0").withColumn("st", F.lit("queued")), key="k", poll_ts="ts",
                                           poll_id="id", status_ts="ts", status_id="id", status_col="st", result_col=None, ttl_hours=1)
        return [sorted(map(str, d.collect())) for d in (retry.select("k", "id", "retries", "action"), block.select("k", "id", "blocked"), status)]
    whole = run()
    monkeypatch.setattr(ordered, "DENSE_ROWS", 50)
    cut = ordered.time_buckets(ev, ["k"], epoch_ms(F.col("ts")), H, "b", ["ts", "id"]).where("k = 777")
    sizes = [r["count"] for r in cut.groupBy("b").count().collect()]
    assert len(sizes) >= 16 and max(sizes) < 120
    # slices follow the order: ids of a later slice come after those of an earlier one
    edges = [(r.lo, r.hi) for r in cut.groupBy("b").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).orderBy("b").collect()]
    assert all(x[1] < y[0] for x, y in zip(edges, edges[1:]))
    assert run() == whole


def test_no_job_runs_while_a_plan_is_built(spark):
    tracker = spark.sparkContext.statusTracker()
    from reelspark.plans import QUERIES
    for name in ("job_status_asof", "token_bucket", "token_lifecycle", "retry_dead_letter", "blocklist_anti_join", "token_reuse", "listing_envelope"):
        QUERIES[name](spark, SF01)                     # reading a table's schema may run a job of its own
        before = len(tracker.getJobIdsForGroup())
        QUERIES[name](spark, SF01).explain("formatted")
        assert len(tracker.getJobIdsForGroup()) - before <= 2, name
