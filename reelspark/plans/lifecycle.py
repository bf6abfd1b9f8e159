"""Time-limited state and the token bucket over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.timecols import ntz, plus
from ..functions import scalars as S
from ..operators import lifecycle, mutate, ratelimit
from ..sources.tables import read_table
from .registry import register

H = 3_600_000


@register("token_lifecycle", """
WITH iss AS (
  SELECT user_id, event_id AS token_id, ts AS issued_at, ts + INTERVAL 24 HOUR AS expire_at
  FROM events WHERE event_type = 'signup'),
u AS (SELECT user_id, event_id AS use_id, ts AS used_at FROM events WHERE event_type = 'click'),
a AS (
  SELECT u.use_id, u.used_at, i.token_id, i.issued_at, i.expire_at
  FROM u ASOF JOIN iss i ON u.user_id = i.user_id AND u.used_at >= i.issued_at),
fu AS (
  SELECT token_id, arg_min(use_id, used_at) AS use_id, min(used_at) AS used_at
  FROM a WHERE used_at > issued_at AND used_at < expire_at GROUP BY token_id),
nx AS (
  SELECT token_id, lead(issued_at) OVER (PARTITION BY user_id ORDER BY issued_at, token_id) AS next_at
  FROM iss)
SELECT i.user_id, i.token_id, i.issued_at, i.expire_at,
       CASE WHEN fu.use_id IS NOT NULL THEN 'consumed'
            WHEN nx.next_at < i.expire_at THEN 'replaced' ELSE 'expired' END AS status,
       fu.use_id, fu.used_at
FROM iss i LEFT JOIN fu ON i.token_id = fu.token_id LEFT JOIN nx ON i.token_id = nx.token_id
""")
def token_lifecycle(spark, sf):
    ev = read_table(spark, sf, "events")
    return lifecycle.token_lifecycle(
        ev.filter(F.col("event_type") == "signup"), ev.filter(F.col("event_type") == "click"),
        key="user_id", issue_ts="ts", issue_id="event_id", use_ts="ts", use_id="event_id", ttl_hours=24)


def _reuse_sql(ttl_ms):
    return f"""
WITH RECURSIVE e AS (
  SELECT user_id AS key, event_id AS id, (epoch_us(ts) // 1000) AS t,
         row_number() OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000), event_id) AS rn
  FROM events WHERE event_type = 'signup'),
f AS (
  SELECT key, id, t, rn, 'new' AS action, t AS tok_t, id AS token_id FROM e WHERE rn = 1
  UNION ALL
  SELECT e.key, e.id, e.t, e.rn,
         CASE WHEN f.tok_t + {ttl_ms} > e.t THEN 'reuse' ELSE 'new' END,
         CASE WHEN f.tok_t + {ttl_ms} > e.t THEN f.tok_t ELSE e.t END,
         CASE WHEN f.tok_t + {ttl_ms} > e.t THEN f.token_id ELSE e.id END
  FROM f JOIN e ON e.key = f.key AND e.rn = f.rn + 1)
SELECT key, id, t AS t_ms, action, token_id FROM f"""


@register("token_reuse", _reuse_sql(60 * H))
def token_reuse(spark, sf):
    ev = read_table(spark, sf, "events").filter(F.col("event_type") == "signup")
    return lifecycle.token_reuse(ev, key="user_id", ts="ts", id_col="event_id", ttl_ms=60 * H)


@register("blocklist_anti_join", """
SELECT r.event_id, r.user_id, r.ts FROM events r
WHERE r.event_type = 'view' AND NOT EXISTS (
  SELECT 1 FROM events b
  WHERE b.event_type = 'error' AND b.user_id = r.user_id
    AND b.ts <= r.ts AND r.ts < b.ts + INTERVAL 24 HOUR)
""")
def blocklist_anti_join(spark, sf):
    ev = read_table(spark, sf, "events")
    req = ev.filter(F.col("event_type") == "view").select("event_id", "user_id", "ts")
    blk = ev.filter(F.col("event_type") == "error")
    return lifecycle.blocklist_anti_join(req, blk, key="user_id", req_ts="ts", req_id="event_id",
                                         block_ts="ts", block_expire=plus(F.col("ts"), hours=24))


STATUS_OF = {"click": "queued", "purchase": "completed", "error": "failed"}


@register("job_status_asof", """
WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view'),
s AS (
  SELECT user_id, ts, event_id AS sid,
         CASE WHEN event_type = 'click' AND event_id % 2 = 0 THEN 'queued' WHEN event_type = 'click' THEN 'processing'
              WHEN event_type = 'purchase' THEN 'completed' ELSE 'failed' END AS status,
         CASE WHEN event_type = 'click' AND event_id % 2 = 0 THEN INTERVAL 30 HOUR WHEN event_type = 'click' THEN INTERVAL 6 HOUR
              WHEN event_type = 'purchase' THEN INTERVAL 72 HOUR ELSE INTERVAL 1 HOUR END AS life,
         CASE WHEN event_type = 'purchase' THEN 'gif/' || CAST(event_id AS VARCHAR) END AS result
  FROM events WHERE event_type IN ('click', 'purchase', 'error'))
SELECT p.event_id, p.user_id, p.ts,
       CASE WHEN s.sid IS NULL THEN 'missing'
            WHEN s.ts + s.life <= p.ts THEN 'expired' ELSE 'ok' END AS outcome,
       s.status, s.ts AS status_at,
       CASE WHEN s.sid IS NOT NULL AND s.ts + s.life > p.ts THEN s.result END AS result_key
FROM p ASOF LEFT JOIN s ON p.user_id = s.user_id AND p.ts >= s.ts
""")
def job_status_asof(spark, sf):
    ev = read_table(spark, sf, "events")
    polls = ev.filter(F.col("event_type") == "view").select("event_id", "user_id", "ts")
    st = ev.filter(F.col("event_type").isin(*STATUS_OF))
    status = F.when((F.col("event_type") == "click") & (F.col("event_id") % 2 == 0), "queued") \
        .when(F.col("event_type") == "click", "processing") \
        .when(F.col("event_type") == "purchase", "completed").otherwise("failed")
    st = st.select("user_id", "ts", "event_id", status.alias("status"),
                   F.when(F.col("event_type") == "purchase",
                          F.concat(F.lit("gif/"), F.col("event_id").cast("string"))).alias("result"))
    return lifecycle.job_status_asof(polls, st, key="user_id", poll_ts="ts", poll_id="event_id",
                                     status_ts="ts", status_id="event_id", status_col="status",
                                     result_col="result",
                                     ttl_hours={"queued": 30, "processing": 6, "completed": 72, "failed": 1})


# Three parameter sets (capacity, tokens per hour, idle hours); fresh buckets hold 1.
BUCKETS = {"token_bucket": (3, 0.125, 48), "token_bucket_cap10": (10, 0.125, 24),
           "token_bucket_cap2": (2, 0.1, 72)}


def _bucket_query(cap, rate, idle_h):
    def q(spark, sf):
        ev = read_table(spark, sf, "events")
        return ratelimit.token_bucket(ev, key="user_id", ts="ts", id_col="event_id", capacity=cap,
                                      rate=rate, per_ms=H, idle_ms=idle_h * H, init=1)
    return q


@register("job_status_result", """
WITH p AS (SELECT 'p-' || CAST(event_id AS VARCHAR) AS poll, user_id, ts FROM events WHERE event_type = 'view'),
s AS (SELECT user_id, ts, event_type AS st FROM events WHERE event_type IN ('click', 'error')),
g AS (SELECT user_id, ts, 'gif/' || CAST(event_id AS VARCHAR) AS gif FROM events WHERE event_type = 'click'),
l AS (SELECT p.poll, p.ts, p.user_id, s.st, s.ts AS status_at FROM p ASOF LEFT JOIN s ON p.user_id = s.user_id AND p.ts >= s.ts),
k AS (SELECT l.*, g.gif, g.ts AS set_at FROM l ASOF LEFT JOIN g ON l.user_id = g.user_id AND l.ts >= g.ts)
SELECT poll, CASE WHEN st IS NULL THEN 'missing' WHEN status_at + INTERVAL 12 HOUR <= ts THEN 'expired' ELSE 'ok' END AS outcome,
       CASE st WHEN 'click' THEN 'completed' WHEN 'error' THEN 'failed' END AS status, status_at,
       CASE WHEN status_at + INTERVAL 12 HOUR > ts AND set_at + INTERVAL 20 HOUR > ts THEN gif END AS result_key
FROM k
""")
def job_status_result(spark, sf):
    """The result key lives by itself (20 h here) while the status lives 12 h: a failure after the result leaves the key."""
    ev = read_table(spark, sf, "events")
    polls = ev.filter(F.col("event_type") == "view").select(F.concat(F.lit("p-"), F.col("event_id").cast("string")).alias("poll"), "user_id", "ts")
    st = ev.filter(F.col("event_type").isin("click", "error")).select(
        "user_id", "ts", F.concat(F.lit("s-"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("sid"),
        F.when(F.col("event_type") == "click", "completed").otherwise("failed").alias("status"),
        F.when(F.col("event_type") == "click", F.concat(F.lit("gif/"), F.col("event_id").cast("string"))).alias("gif"))
    return lifecycle.job_status_asof(polls, st, key="user_id", poll_ts="ts", poll_id="poll", status_ts="ts", status_id="sid", status_col="status",
                                     result_col="gif", ttl_hours=12, result_ttl_hours=20) \
        .select("poll", "outcome", "status", "status_at", "result_key")


@register("blocklist_uuid", """
SELECT 'r-' || CAST(r.event_id AS VARCHAR) AS request_id FROM events r WHERE r.event_type = 'view' AND NOT EXISTS (
  SELECT 1 FROM events b WHERE b.event_type = 'error' AND b.user_id = r.user_id AND b.ts <= r.ts AND r.ts < b.ts + INTERVAL 24 HOUR)
""")
def blocklist_uuid(spark, sf):
    """The blocklist by text keys and text request ids, as the service has them."""
    ev = read_table(spark, sf, "events").withColumn("token", F.concat(F.lit("u-"), F.col("user_id").cast("string")))
    req = ev.filter(F.col("event_type") == "view").select(F.concat(F.lit("r-"), F.col("event_id").cast("string")).alias("request_id"), "token", "ts")
    return lifecycle.blocklist_anti_join(req, ev.filter(F.col("event_type") == "error"), key="token", req_ts="ts", req_id="request_id",
                                         block_ts="ts", block_expire=plus(F.col("ts"), hours=24)).select("request_id")


for _name, (_cap, _rate, _idle) in BUCKETS.items():
    register(_name, ratelimit.token_bucket_sql("events", "user_id", "ts", "event_id", _cap, _rate, H,
                                                _idle * H, 1))(_bucket_query(_cap, _rate, _idle))


SHARES_SQL = """
  SELECT event_id AS token, user_id AS owner_id,
         'g' || CAST(user_id AS VARCHAR) || '-' || CAST(event_id % 5 AS VARCHAR) AS gif_key,
         ts AS created_at,
         CASE WHEN event_id % 3 = 0 THEN NULL ELSE ts + (event_id % 3) * INTERVAL 1 HOUR END AS expires_at,
         CASE WHEN event_id % 4 = 0 THEN 'download' ELSE 'view' END AS access
  FROM events WHERE event_type IN ('signup', 'click')"""


def _shares(ev):
    life = (F.col("event_id") % 3).cast("int")
    return (ev.filter(F.col("event_type").isin("signup", "click"))
              .select(F.col("event_id").alias("token"), F.col("user_id").alias("owner_id"),
                      F.concat(F.lit("g"), F.col("user_id").cast("string"), F.lit("-"),
                               (F.col("event_id") % 5).cast("string")).alias("gif_key"),
                      F.col("ts").alias("created_at"),
                      F.when(life == 0, F.lit(None))
                       .otherwise(F.col("ts") + F.make_dt_interval(hours=life)).alias("expires_at"),
                      F.when(F.col("event_id") % 4 == 0, "download").otherwise("view").alias("access")))


@register("share_resolve", f"""
WITH sh AS ({SHARES_SQL}),
r AS (SELECT event_id, ts, event_id - 20 AS token,
             CASE WHEN event_id % 2 = 0 THEN 'download' ELSE 'view' END AS want
      FROM events WHERE event_type = 'view')
SELECT r.event_id, r.token, r.want, sh.access,
       CASE WHEN sh.token IS NULL OR sh.created_at > r.ts
                 OR (sh.expires_at IS NOT NULL AND sh.expires_at <= r.ts) THEN 404
            WHEN r.want = 'download' AND sh.access = 'view' THEN 403 ELSE 200 END AS code,
       CASE WHEN sh.token IS NOT NULL AND sh.created_at <= r.ts
                 AND (sh.expires_at IS NULL OR sh.expires_at > r.ts)
                 AND NOT (r.want = 'download' AND sh.access = 'view') THEN sh.gif_key END AS item
FROM r LEFT JOIN sh ON r.token = sh.token
""")
def share_resolve(spark, sf):
    ev = read_table(spark, sf, "events")
    req = (ev.filter(F.col("event_type") == "view")
             .select("event_id", "ts", (F.col("event_id") - 20).alias("token"),
                     F.when(F.col("event_id") % 2 == 0, "download").otherwise("view").alias("want")))
    out = lifecycle.share_resolve(req, _shares(ev), req_token="token", req_ts="ts", want_col="want",
                                  share_token="token", created_col="created_at", expires_col="expires_at",
                                  access_col="access", item_col="gif_key")
    return out.select("event_id", "token", "want", "access", F.col("code").cast("int").alias("code"), "item")


@register("share_list", f"""
SELECT token, owner_id, gif_key, access, expires_at FROM ({SHARES_SQL}) sh
WHERE EXISTS (SELECT 1 FROM events e
              WHERE e.event_type = 'view' AND e.user_id = sh.owner_id
                AND 'g' || CAST(e.user_id AS VARCHAR) || '-' || CAST(e.event_id % 5 AS VARCHAR) = sh.gif_key)
""")
def share_list(spark, sf):
    ev = read_table(spark, sf, "events")
    req = (ev.filter(F.col("event_type") == "view")
             .select("user_id", F.concat(F.lit("g"), F.col("user_id").cast("string"), F.lit("-"),
                                         (F.col("event_id") % 5).cast("string")).alias("item")))
    out = lifecycle.shares_for(_shares(ev), req, owner_col="owner_id", item_col="gif_key",
                               req_owner="user_id", req_item="item")
    return out.select("token", "owner_id", "gif_key", "access", "expires_at")


@register("account_sweep", """
SELECT c_custkey,
       CASE WHEN c_custkey % 4 = 0 THEN NULL
            ELSE TIMESTAMP '2024-01-01 00:00:00' + (c_custkey % 3) * INTERVAL 1 DAY END AS deleted_at,
       (c_custkey % 4 <> 0 AND TIMESTAMP '2024-01-01 00:00:00' + (c_custkey % 3) * INTERVAL 1 DAY
            <= TIMESTAMP '2024-01-02 12:00:00') AS swept
FROM customer
""")
def account_sweep(spark, sf):
    c = read_table(spark, sf, "customer")
    deleted = F.when(F.col("c_custkey") % 4 == 0, F.lit(None)).otherwise(
        ntz("2024-01-01 00:00:00") + F.make_dt_interval(days=(F.col("c_custkey") % 3).cast("int")))
    acc = c.select("c_custkey", deleted.alias("deleted_at"))
    return lifecycle.account_sweep(acc, deleted_col="deleted_at", as_of=ntz("2024-01-02 12:00:00"))


_ADDR_SQL = """CASE WHEN user_id % 10 = 0 THEN '[::1]:80' WHEN user_id % 10 = 1 THEN 'noport'
              ELSE '10.0.0.' || CAST(user_id AS VARCHAR) || ':80' END"""


@register("token_bucket_ip", ratelimit.token_bucket_sql(
    f"(SELECT 'rate_limit:ip:' || split_part({_ADDR_SQL}, ':', 1) AS ip, event_id, ts FROM events) q", "ip", "ts", "event_id", 3, 0.125, H, 48 * H, 1))
def token_bucket_ip(spark, sf):
    """Admission by the service's own text key, the client's address (some addresses are shared by many users)."""
    ev = read_table(spark, sf, "events")
    addr = (F.when(F.col("user_id") % 10 == 0, F.lit("[::1]:80")).when(F.col("user_id") % 10 == 1, F.lit("noport"))
            .otherwise(F.concat(F.lit("10.0.0."), F.col("user_id").cast("string"), F.lit(":80"))))
    req = ev.select(S.rate_limit_key(addr).alias("ip"), "event_id", "ts")
    return ratelimit.token_bucket(req, key="ip", ts="ts", id_col="event_id", capacity=3, rate=0.125, per_ms=H, idle_ms=48 * H, init=1)


_BUSY_SQL = "(SELECT CASE WHEN event_id % 3 = 0 THEN -1 ELSE user_id END AS user_id, event_id, ts FROM events) q"


def _busy(ev):
    """One key holds a third of all rows and never pauses."""
    return ev.select(F.when(F.col("event_id") % 3 == 0, F.lit(-1).cast("long")).otherwise(F.col("user_id")).alias("user_id"), "event_id", "ts")


@register("token_bucket_busy", ratelimit.token_bucket_sql(_BUSY_SQL, "user_id", "ts", "event_id", 10, 6, H, 48 * H, 6))
def token_bucket_busy(spark, sf):
    """Admission where a key never pauses long enough for a gap to tell its state: folded in blocks."""
    return ratelimit.token_bucket(_busy(read_table(spark, sf, "events")), key="user_id", ts="ts", id_col="event_id", capacity=10, rate=6, per_ms=H,
                                  idle_ms=48 * H, init=6, bucket_ms=48 * H, never_pausing=True)


@register("token_reuse_busy", _reuse_sql(5 * H).replace("FROM events WHERE event_type = 'signup'", f"FROM {_BUSY_SQL}"))
def token_reuse_busy(spark, sf):
    """Token reuse where a key never pauses for a token's life: chained over blocks by jump tables."""
    return lifecycle.token_reuse(_busy(read_table(spark, sf, "events")), key="user_id", ts="ts", id_col="event_id", ttl_ms=5 * H,
                                 bucket_ms=48 * H, never_pausing=True)


@register("token_reuse_uuid", _reuse_sql(60 * H).replace("SELECT user_id AS key", "SELECT 'u-' || CAST(user_id AS VARCHAR) AS key"))
def token_reuse_uuid(spark, sf):
    """Token reuse keyed by a user id that is a text."""
    ev = read_table(spark, sf, "events").filter(F.col("event_type") == "signup")
    ev = ev.select(F.concat(F.lit("u-"), F.col("user_id").cast("string")).alias("uid"), "ts", "event_id")
    return lifecycle.token_reuse(ev, key="uid", ts="ts", id_col="event_id", ttl_ms=60 * H)


@register("reset_notices", """
WITH iss AS (
  SELECT user_id, event_id AS token_id, ts AS issued_at, ts + INTERVAL 15 MINUTE AS expire_at FROM events WHERE event_type = 'view'),
u AS (SELECT user_id, event_id AS use_id, ts AS used_at FROM events WHERE event_type = 'click'),
a AS (SELECT u.used_at, i.token_id, i.user_id, i.issued_at, i.expire_at
      FROM u ASOF JOIN iss i ON u.user_id = i.user_id AND u.used_at >= i.issued_at)
SELECT token_id, 'email.queue' AS queue,
       '{"to":"u' || CAST(any_value(user_id) AS VARCHAR) || '@mail.test","name":"reset-password","token":""}' AS body,
       min(used_at) AS published_at
FROM a WHERE used_at > issued_at AND used_at < expire_at GROUP BY token_id
""")
def reset_notices(spark, sf):
    """One notice per successful reset; reset tokens live 15 minutes."""
    ev = read_table(spark, sf, "events")
    life = lifecycle.token_lifecycle(
        ev.filter(F.col("event_type") == "view"), ev.filter(F.col("event_type") == "click"),
        key="user_id", issue_ts="ts", issue_id="event_id", use_ts="ts", use_id="event_id", ttl_hours=0.25)
    return lifecycle.reset_notices(life, to=F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("@mail.test")))


@register("share_update", f"""
WITH r AS (SELECT DISTINCT user_id AS o, 'g' || CAST(user_id AS VARCHAR) || '-' || CAST(event_id % 5 AS VARCHAR) AS i
           FROM events WHERE event_type = 'purchase')
SELECT token, owner_id, gif_key, CASE WHEN r.o IS NOT NULL THEN 'download' ELSE access END AS access, r.o IS NOT NULL AS patched
FROM ({SHARES_SQL}) sh LEFT JOIN r ON r.o = sh.owner_id AND r.i = sh.gif_key
""")
def share_update(spark, sf):
    """Owners widen the access of their own items' shares (scoped by owner and item)."""
    ev = read_table(spark, sf, "events")
    out = mutate.patch(_shares(ev), _owned(ev, "purchase").withColumn("access", F.lit("download")), key=["owner_id", "gif_key"],
                       cols=["access"], patch_key=["o", "i"], stamp=F.lit(None).cast("timestamp_ntz"))
    return out.select("token", "owner_id", "gif_key", "access", "patched")


@register("share_delete", f"""
WITH r AS (SELECT DISTINCT user_id AS o, 'g' || CAST(user_id AS VARCHAR) || '-' || CAST(event_id % 5 AS VARCHAR) AS i
           FROM events WHERE event_type = 'error')
SELECT token, owner_id, gif_key FROM ({SHARES_SQL}) sh WHERE (owner_id, gif_key) NOT IN (SELECT (o, i) FROM r)
""")
def share_delete(spark, sf):
    """Owners delete the shares of their own items; nobody else's go."""
    ev = read_table(spark, sf, "events")
    return mutate.delete_by_key(_shares(ev), _owned(ev, "error"), key=["owner_id", "gif_key"], keys_key=["o", "i"]) \
        .select("token", "owner_id", "gif_key")


def _owned(ev, kind):
    item = F.concat(F.lit("g"), F.col("user_id").cast("string"), F.lit("-"), (F.col("event_id") % 5).cast("string"))
    return ev.filter(F.col("event_type") == kind).select(F.col("user_id").alias("o"), item.alias("i")).distinct()
