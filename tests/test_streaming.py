"""Stream forms equal their batch twins on the same input split into files."""

import datetime as dt
import os
import time
import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types

from reelspark.functions.timecols import epoch_ms, ntz, plus
from reelspark.operators import lifecycle, messages, mutate, ratelimit
from reelspark.plans.messages import _bodies
from reelspark.sources import tables
from reelspark.streaming import flows

from .conftest import SF001, T

CUTS = ["2024-01-08 00:00:00", "2024-01-15 00:00:00", "2024-01-22 00:00:00"]


@pytest.fixture(scope="module")
def stream_dir(spark, tmp_path_factory):
    """events of sf0.001 written as four files in time order (one per micro-batch)."""
    d = str(tmp_path_factory.mktemp("events-stream"))
    ev = tables.read_table(spark, SF001, "events")
    bounds = [None, *CUTS, None]
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        part = ev
        if lo:
            part = part.filter(F.col("ts") >= ntz(lo))
        if hi:
            part = part.filter(F.col("ts") < ntz(hi))
        part.coalesce(1).write.mode("append").parquet(d)
    return d


def run_stream(spark, df, scratch):
    name = "s" + uuid.uuid4().hex[:8]
    q = (df.writeStream.format("memory").queryName(name).outputMode("append")
         .option("checkpointLocation", os.path.join(scratch, "ckpt"))
         .trigger(availableNow=True).start())
    q.awaitTermination(300)
    return spark.table(name)


def events_stream(spark, d):
    schema = tables.read_table(spark, SF001, "events").schema
    return flows.file_stream(spark, d, schema)


def test_token_bucket_stream_equals_batch(spark, stream_dir, scratch):
    p = dict(capacity=3, rate=0.125, per_ms=3_600_000, idle_ms=48 * 3_600_000, init=1)
    s = ratelimit.token_bucket_stream(events_stream(spark, stream_dir), key="user_id", ts="ts",
                                      id_col="event_id", **p)
    got = {tuple(r) for r in run_stream(spark, s, scratch).where("NOT late").drop("late").collect()}
    ev = tables.read_table(spark, SF001, "events")
    want = {tuple(r) for r in ratelimit.token_bucket(ev, key="user_id", ts="ts", id_col="event_id", **p).collect()}
    assert len(want) == ev.count() and got == want


def test_blocklist_stream_equals_batch(spark, stream_dir, scratch):
    st = events_stream(spark, stream_dir).filter(F.col("event_type").isin("view", "error"))
    s = flows.blocklist_stream(st, key="user_id", ts="ts", id_col="event_id",
                               is_block=F.col("event_type") == "error",
                               block_expire_ms=epoch_ms(plus(F.col("ts"), hours=24)), max_life_ms=24 * 3_600_000)
    got = {(r.id, r.blocked) for r in run_stream(spark, s, scratch).collect()}
    ev = tables.read_table(spark, SF001, "events")
    b = lifecycle.blocklist_check(ev.filter(F.col("event_type") == "view"), ev.filter(F.col("event_type") == "error"),
                                  key="user_id", req_ts="ts", req_id="event_id", block_ts="ts",
                                  block_expire=plus(F.col("ts"), hours=24))
    want = {(r.event_id, r.blocked) for r in b.collect()}
    assert got == want and any(x for _, x in want)


def test_retry_stream_equals_batch(spark, stream_dir, scratch):
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    st = events_stream(spark, stream_dir).withColumn("mkey", F.col("user_id") * 100000 + day)
    s = flows.retry_stream(st, message_key="mkey", ts="ts", id_col="event_id", max_retries=3,
                           idle_ms=2 * 86_400_000)
    got = {(r.id, r.retries, r.action) for r in run_stream(spark, s, scratch).collect()}
    ev = tables.read_table(spark, SF001, "events").withColumn("day", F.to_date("ts"))
    b = messages.retry_dead_letter(ev, message_key=["user_id", "day"], ts="ts", id_col="event_id",
                                   max_retries=3, queue=F.lit("email.queue"))
    want = {(r.event_id, r.retries, r.action) for r in b.collect()}
    assert got == want


def test_mail_route_stream_equals_batch(spark, stream_dir, scratch):
    st = _bodies(events_stream(spark, stream_dir))
    got = {(r.event_id, r.route, r.queue) for r in run_stream(spark, flows.mail_route_stream(st), scratch).collect()}
    from reelspark.sources import messages as SM
    b = messages.route_mail(SM.decode(_bodies(tables.read_table(spark, SF001, "events")), "body", SM.MAIL))
    want = {(r.event_id, r.route, r.queue) for r in b.collect()}
    assert got == want


def test_upsert_stream_equals_batch(spark, stream_dir, scratch):
    cols = ["user_id", "id", "file_key", "size_bytes", "uploaded_at", "duration"]

    def uploads(df):
        return df.filter(F.col("event_type") == "purchase").select(
            "user_id", F.col("event_id").alias("id"), F.concat(F.lit("k"), F.col("event_id").cast("string")).alias("file_key"),
            F.round(F.col("value") * 100).cast("bigint").alias("size_bytes"), F.col("ts").alias("uploaded_at"),
            F.col("props").alias("duration"))

    ev = tables.read_table(spark, SF001, "events")
    schema = uploads(ev).schema
    root = os.path.join(scratch, "snap")
    sink = flows.upsert_sink(root, key="user_id", arrival="id", update_cols=["file_key", "size_bytes", "uploaded_at"],
                             keep_cols=["id", "duration"], schema=schema)
    q = (uploads(events_stream(spark, stream_dir)).writeStream.foreachBatch(sink)
         .option("checkpointLocation", os.path.join(scratch, "ckpt")).trigger(availableNow=True).start())
    q.awaitTermination(300)
    final = spark.read.parquet(flows.latest_version(spark, root))
    got = {tuple(r) for r in final.select(*cols).collect()}
    empty = spark.createDataFrame([], schema)
    want = {tuple(r) for r in mutate.upsert(empty, uploads(ev), key="user_id", arrival=F.col("id"),
                                            update_cols=["file_key", "size_bytes", "uploaded_at"],
                                            keep_cols=["id", "duration"]).select(*cols).collect()}
    assert got == want


def test_token_reuse_stream_equals_batch(spark, stream_dir, scratch):
    st = events_stream(spark, stream_dir).filter(F.col("event_type") == "signup")
    s = lifecycle.token_reuse_stream(st, key="user_id", ts="ts", id_col="event_id", ttl_ms=60 * 3_600_000)
    got = {tuple(r) for r in run_stream(spark, s, scratch).where("NOT late").drop("late").collect()}
    ev = tables.read_table(spark, SF001, "events").filter(F.col("event_type") == "signup")
    want = {tuple(r) for r in lifecycle.token_reuse(ev, key="user_id", ts="ts", id_col="event_id",
                                                   ttl_ms=60 * 3_600_000).collect()}
    assert got == want and any(r[3] == "reuse" for r in want)


@pytest.mark.parametrize("own", [None, 20])
def test_job_status_stream_equals_batch(spark, stream_dir, scratch, own):
    kinds = {"click": "queued", "purchase": "completed", "error": "failed"}
    status = F.when(F.col("event_type") == "click", "queued").when(F.col("event_type") == "purchase", "completed") \
        .otherwise("failed")
    result = F.when(F.col("event_type") == "purchase", F.concat(F.lit("gif/"), F.col("event_id").cast("string")))
    ttl = {k: 12 * 3_600_000 for k in ("queued", "processing", "completed", "failed")}
    st = events_stream(spark, stream_dir)
    s = lifecycle.job_status_stream(st, key="user_id", ts="ts", id_col="event_id",
                                    is_status=F.col("event_type").isin(*kinds), status=status, result=result,
                                    ttl_ms=ttl, result_ttl_ms=own and own * 3_600_000)
    got = {(r.id, r.outcome, r.status, r.result_key) for r in run_stream(spark, s, scratch).collect()
           if r is not None}
    ev = tables.read_table(spark, SF001, "events")
    polls = ev.filter(~F.col("event_type").isin(*kinds)).select("event_id", "user_id", "ts")
    sts = ev.filter(F.col("event_type").isin(*kinds)).select("user_id", "ts", "event_id", status.alias("status"),
                                                             result.alias("result"))
    b = lifecycle.job_status_asof(polls, sts, key="user_id", poll_ts="ts", poll_id="event_id", status_ts="ts",
                                  status_id="event_id", status_col="status", result_col="result",
                                  ttl_hours={k: 12 for k in ttl}, result_ttl_hours=own)
    want = {(r.event_id, r.outcome, r.status, r.result_key) for r in b.collect()}
    assert got == want and {o for _, o, _, _ in want} == {"ok", "expired", "missing"}
    assert not own or any(st == "failed" and key for _, _, st, key in want)


def test_metadata_enrich_stream_static_join(spark, stream_dir, scratch):
    from reelspark.functions import scalars as S
    docs = tables.read_table(spark, SF001, "documents").select("doc_id", "n_chars", F.lit("video/mp4").alias("ct"))

    def confirms(df):
        return df.select("event_id", (F.col("event_id") % 300).alias("object_key"),
                         F.when(F.col("event_id") % 97 == 0, F.lit("")).otherwise(S.uuid_text(F.col("user_id")))
                         .alias("user_uuid"))

    kw = dict(key="object_key", user_id="user_uuid", inv_key="doc_id", size_col="n_chars", type_col="ct")
    s = messages.metadata_enrich(confirms(events_stream(spark, stream_dir)), docs, **kw)
    got = {(r.event_id, r.outcome) for r in run_stream(spark, s, scratch).collect()}
    b = messages.metadata_enrich(confirms(tables.read_table(spark, SF001, "events")), docs, **kw)
    want = {(r.event_id, r.outcome) for r in b.collect()}
    assert got == want and {o for _, o in want} == {"saved", "retry", "reject"}


def test_message_files_stream_decodes(spark, scratch):
    from reelspark.sources import connectors
    from reelspark.sources import messages as SM
    bodies = _bodies(tables.read_table(spark, SF001, "events"))
    d = os.path.join(scratch, "queue")
    bodies.select("body").coalesce(1).write.text(d)
    st = connectors.message_files(spark, d, queue="email.queue")
    got = run_stream(spark, SM.decode(st, "body", SM.MAIL), scratch)
    assert got.count() == bodies.count() and got.filter("valid").count() < got.count()


ENRICH = dict(key="object_key", confirm_ts="ts", user_id="user_uuid", obj_key="event_id", obj_ts="ts", size_col="size", type_col="ctype",
              wait="1 hour", retention="7 days")


def lagging(spark, scratch, lag_s):
    """Confirmations and objects as queues whose confirmations come ``lag_s`` behind; files in order of arrival."""
    from reelspark.functions import scalars as S
    ev = tables.read_table(spark, SF001, "events")
    confirms = ev.filter(F.col("event_type") == "click").select(
        "event_id", "ts", (F.col("event_id") + 3 - 6 * (F.col("event_id") % 2)).alias("object_key"),
        F.when(F.col("event_id") % 97 == 0, F.lit("")).otherwise(S.uuid_text(F.col("user_id"))).alias("user_uuid"))
    objects = ev.filter(F.col("event_id") % 7 != 0).select("event_id", "ts", F.round(F.col("value") * 100).cast("bigint").alias("size"), F.col("event_type").alias("ctype"))
    out = []
    for name, df, late in (("c", confirms, lag_s), ("o", objects, 0)):
        d = os.path.join(scratch, name)
        df = df.withColumn("came", plus(F.col("ts"), seconds=late))
        for k, day in enumerate((1, 4, 7, 13, 19, 25, 31)):
            lo = ntz("2024-01-01 00:00:00") if day == 1 else ntz(f"2024-01-{day:02d} 00:00:00")
            hi = {1: 4, 4: 7, 7: 13, 13: 19, 19: 25, 25: 31}.get(day)
            part = df.where((F.col("came") >= lo) & (F.col("came") < ntz(f"2024-01-{hi:02d} 00:00:00"))) if hi else df.where(F.col("came") >= lo)
            part.coalesce(1).write.mode("append").parquet(d)
            for f in os.listdir(d):
                if f.startswith("part-") and not os.path.exists(os.path.join(scratch, f)):
                    os.utime(os.path.join(d, f), (1_700_000_000 + k * 60, 1_700_000_000 + k * 60))
                    open(os.path.join(scratch, f), "w").close()
        out.append((df, flows.file_stream(spark, d, df.schema)))
    return out


@pytest.mark.parametrize("lag_s", [3600])
def test_confirmations_of_a_lagging_source_come_out_once(spark, scratch, lag_s):
    (confirms, cs), (objects, os_) = lagging(spark, scratch, lag_s)
    s = flows.metadata_enrich_stream(cs, os_, **ENRICH, lag="2 hours", confirm_arrival=F.col("came"), obj_arrival=F.col("came"))
    got = sorted(tuple(map(str, r)) for r in run_stream(spark, s, scratch).collect())
    batch = messages.metadata_enrich_interval(confirms, objects, **ENRICH)
    want = sorted(tuple(map(str, r)) for r in batch.select(*s.columns).collect())
    # what still waits when the queues end comes out as the stream's clock moves on
    last = confirms.agg(F.max("came")).first()[0]
    still = {w for w in want if w[-3] == "dead" and T(w[4]) > last - dt.timedelta(hours=3, minutes=2)}
    assert len(got) == len(set(got)) and set(got) <= set(want) and set(want) - set(got) <= still
    assert {w[-3] for w in got} == {"saved", "dead", "reject"} and len(still) < 10


def test_a_confirmation_further_behind_is_marked_late(spark, scratch):
    c = [(1, T("2024-01-01 10:00:00"), 5, "6f1c1f7e-0f0b-4a0e-9d5c-0a1b2c3d4e5f", T("2024-01-03 10:00:00")),
         (2, T("2024-01-03 10:00:00"), 6, "6f1c1f7e-0f0b-4a0e-9d5c-0a1b2c3d4e5f", T("2024-01-03 10:00:00")),
         (2, T("2024-01-03 10:00:00"), 6, "6f1c1f7e-0f0b-4a0e-9d5c-0a1b2c3d4e5f", T("2024-01-03 10:00:00")),
         (3, T("2024-01-09 10:00:00"), None, "6f1c1f7e-0f0b-4a0e-9d5c-0a1b2c3d4e5f", T("2024-01-09 10:00:00")),
         (4, T("2024-01-09 10:00:00"), 7, "6f1c1f7e-0f0b-4a0e-9d5c-0a1b2c3d4e5f", T("2024-01-09 10:00:00"))]    # still waits at the end
    schema = "event_id long, ts timestamp_ntz, object_key long, user_uuid string, came timestamp_ntz"
    d = skewed_files(spark, scratch, [c[:3], c[3:]], schema)
    objects = spark.createDataFrame([(9, T("2024-01-01 00:00:00"), None, "x", T("2024-01-01 00:00:00"))], "event_id long, ts timestamp_ntz, size long, ctype string, came timestamp_ntz")
    objects.coalesce(1).write.parquet(os.path.join(scratch, "o"))
    s = flows.metadata_enrich_stream(flows.file_stream(spark, d, spark.createDataFrame([], schema).schema),
                                     flows.file_stream(spark, os.path.join(scratch, "o"), objects.schema), **ENRICH,
                                     confirm_arrival=F.col("came"), obj_arrival=F.col("came"))
    got = sorted((r.event_id, r.outcome, r.ts, r.object_key) for r in run_stream(spark, s, scratch).collect())
    assert got == [(1, "late", c[0][1], 5), (2, "dead", c[1][1], 6), (2, "dead", c[1][1], 6), (3, "dead", c[3][1], None)]


def test_a_source_that_stalls_and_resumes(spark, scratch):
    """The stream runs on for other keys; the stalled key's bucket is as it was."""
    schema = "client string, ts timestamp_ntz, id string, came timestamp_ntz"
    a = [("a", T("2024-01-01 10:00:00"), f"a{k}", T("2024-01-01 10:00:00")) for k in range(6)]
    b = [("b", T("2024-01-01 10:00:00") + dt.timedelta(minutes=10 * k), f"b{k}", T("2024-01-01 10:00:00") + dt.timedelta(minutes=10 * k)) for k in range(13)]
    again = [("a", T("2024-01-01 10:00:01"), f"c{k}", T("2024-01-01 12:30:00")) for k in range(6)]
    parts = [a, *[[r] for r in b], again]
    d = skewed_files(spark, scratch, parts, schema)
    rows = spark.createDataFrame([r for p in parts for r in p], schema)
    st = flows.file_stream(spark, d, rows.schema)
    p = dict(key="client", ts="ts", id_col="id", capacity=6, rate=1, per_ms=60_000, idle_ms=3_600_000)
    out = run_stream(spark, ratelimit.token_bucket_stream(st, **p, init=6, arrival=F.col("came")), scratch)
    batch = {tuple(r) for r in ratelimit.token_bucket(rows, **p, init=6).collect()}
    assert {tuple(r)[:-1] for r in out.collect()} == batch and not any(r[3] for r in batch if r[1] == "c0")
    # where the retention is shorter than the stall, state goes and the bucket is a fresh one
    scratch2 = os.path.join(scratch, "short")
    out = run_stream(spark, ratelimit.token_bucket_stream(st, **p, init=6, arrival=F.col("came"), evict_ms=3_600_000), scratch2)
    assert {r.id: r.allowed for r in out.collect()}["c0"]


def test_admission_job_exactly_once_sink(spark, stream_dir, scratch):
    from reelspark.streaming import jobs
    ev = tables.read_table(spark, SF001, "events")
    src = os.path.join(scratch, "requests")
    ev.select(F.col("event_id").alias("request_id"), F.col("user_id").alias("client"), "ts") \
      .coalesce(1).write.parquet(src)
    sink, ckpt = os.path.join(scratch, "out"), os.path.join(scratch, "ck")
    p = dict(capacity=3, rate=0.125, per_ms=3_600_000, idle_ms=48 * 3_600_000, init=1)
    jobs.admission_job(spark, src, sink, ckpt, available_now=True, **p).awaitTermination(300)
    # a restart on the same checkpoint must not duplicate output
    jobs.admission_job(spark, src, sink, ckpt, available_now=True, **p).awaitTermination(300)
    got = {tuple(r) for r in spark.read.parquet(sink).where("NOT late").drop("late").collect()}
    assert spark.read.parquet(sink).count() == ev.count()
    want = {tuple(r) for r in ratelimit.token_bucket(ev, key="user_id", ts="ts", id_col="event_id", **p).collect()}
    assert got == want


def test_mail_job_routes_to_queue_folders(spark, scratch):
    from reelspark.streaming import jobs
    bodies = _bodies(tables.read_table(spark, SF001, "events"))
    src = os.path.join(scratch, "mailq")
    bodies.select("body").coalesce(2).write.text(src)
    sink = os.path.join(scratch, "routed")
    jobs.mail_job(spark, src, sink, os.path.join(scratch, "ck"), available_now=True).awaitTermination(300)
    out = spark.read.parquet(sink)
    assert out.count() == bodies.count()
    assert {r.queue for r in out.select("queue").distinct().collect()} == {"email.queue", "email.queue.dead"}


def skewed_files(spark, scratch, rows, schema):
    """One file a micro-batch, in the order given."""
    d = os.path.join(scratch, "skewed")
    for k, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(d)
        for f in os.listdir(d):        # the file source orders by modification time
            if f.startswith("part-") and not os.path.exists(os.path.join(scratch, f)):
                os.utime(os.path.join(d, f), (1_700_000_000 + k * 60, 1_700_000_000 + k * 60))
                open(os.path.join(scratch, f), "w").close()
    return d


@pytest.mark.parametrize("idle_ms", [6000, 48 * 3_600_000])
def test_clocks_of_other_keys_make_no_row_late(spark, scratch, idle_ms):
    schema = "client string, ts timestamp_ntz, id string"
    parts = [[("10.0.0.1", T("2024-01-01 10:00:00"), "a")], [("10.0.0.1", T("2024-01-01 10:05:00"), "b")],
             [("10.0.0.2", T("2024-01-01 09:59:00"), "c"), ("10.0.0.2", T("2024-01-01 09:59:01"), "d")],
             [("10.0.0.1", T("2024-01-01 10:04:00"), "e")]]
    d = skewed_files(spark, scratch, parts, schema)
    rows = spark.createDataFrame([r for p in parts[:3] for r in p], schema)
    st = flows.file_stream(spark, d, rows.schema)
    out = run_stream(spark, ratelimit.token_bucket_stream(st, key="client", ts="ts", id_col="id", idle_ms=idle_ms), scratch)
    batch = ratelimit.token_bucket(rows, key="client", ts="ts", id_col="id", idle_ms=idle_ms)
    assert {tuple(r) for r in out.where("NOT late").drop("late").collect()} == {tuple(r) for r in batch.collect()}
    # a row behind its own key's last event is not folded, and not lost
    assert [(r.key, r.id, r.allowed) for r in out.where("late").collect()] == [("10.0.0.1", "e", None)]


def held_stream(spark, d, name, ckpt, delay_ms):
    held = flows.retry_hold_stream(flows.file_stream(spark, d, T_HELD), id_col="id", delay_ms=delay_ms)
    return (held.writeStream.format("parquet").outputMode("append").option("path", name)
            .option("checkpointLocation", ckpt).trigger(processingTime="1 second").start())


T_HELD = types.StructType([types.StructField("id", types.LongType()), types.StructField("body", types.StringType()),
                           types.StructField("ts", types.TimestampNTZType()), types.StructField("n", types.IntegerType())])


def wait_for(test, seconds=120):
    end = time.time() + seconds
    while time.time() < end and not test():
        time.sleep(0.3)
    assert test()


def rows_in(spark, path):
    try:
        return sorted(tuple(r) for r in spark.read.schema(T_HELD).parquet(path).collect())
    except Exception:  # noqa: BLE001 - nothing written yet
        return []


def test_every_delivery_is_held_and_released_also_after_a_restart(spark, scratch):
    rows = [(1, "a", T("2024-01-01 10:00:00.123456"), 1), (2, "b", T("2024-01-01 10:00:01"), None), (1, "a", T("2024-01-01 10:00:00.123456"), 1),
            (1, "again", None, 2)]
    d, out, ckpt = (os.path.join(scratch, n) for n in ("failed", "out", "ck"))
    spark.createDataFrame(rows[:3], T_HELD).coalesce(1).write.mode("append").parquet(d)
    q = held_stream(spark, d, out, ckpt, 12_000)
    wait_for(lambda: any(p["numInputRows"] for p in q.recentProgress))
    q.stop()
    assert rows_in(spark, out) == []                       # still held
    spark.createDataFrame(rows[3:], T_HELD).coalesce(1).write.mode("append").parquet(d)
    q = held_stream(spark, d, out, ckpt, 12_000)
    try:
        wait_for(lambda: len(rows_in(spark, out)) == 4)
        assert sorted(map(str, rows_in(spark, out))) == sorted(map(str, rows))
    finally:
        q.stop()
