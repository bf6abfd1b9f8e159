"""Snapshot mutations over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.timecols import ntz, plus
from ..operators import mutate
from ..sources.tables import read_table
from .registry import register


@register("insert_defaults", """
SELECT event_id AS id, user_id, sha256(CAST(event_id AS VARCHAR)) AS token_hash, ts AS created_at,
       false AS used, ts + INTERVAL 15 MINUTE AS expire_at
FROM events WHERE event_type = 'signup'
""")
def insert_defaults(spark, sf):
    ev = read_table(spark, sf, "events").filter(F.col("event_type") == "signup")
    rows = ev.select(F.col("event_id").alias("id"), "user_id",
                     F.sha2(F.col("event_id").cast("string"), 256).alias("token_hash"),
                     F.col("ts").alias("created_at"))
    return mutate.insert_defaults(rows, {"used": F.lit(False),
                                         "expire_at": plus(F.col("created_at"), minutes=15)})


_TOKEN_LIFE = {"insert_defaults_verify": 30, "insert_defaults_anonymous": 24 * 60}


def _defaults_query(minutes):
    def q(spark, sf):
        ev = read_table(spark, sf, "events").filter(F.col("event_type") == "signup")
        rows = ev.select(F.col("event_id").alias("id"), "user_id", F.col("ts").alias("created_at"),
                         F.when(F.col("event_id") % 7 == 0, plus(F.col("ts"), minutes=1)).alias("expire_at"))
        return mutate.insert_defaults(rows, {"expire_at": plus(F.col("created_at"), minutes=minutes)})
    return q


# the other lifetimes of the service's tables: 30 minutes and 24 hours; a given expiry is kept
for _name, _minutes in _TOKEN_LIFE.items():
    register(_name, f"""
SELECT event_id AS id, user_id, ts AS created_at,
       CASE WHEN event_id % 7 = 0 THEN ts + INTERVAL 1 MINUTE ELSE ts + INTERVAL {_minutes} MINUTE END AS expire_at
FROM events WHERE event_type = 'signup'
""")(_defaults_query(_minutes))


def _uploads(ev):
    return ev.select("user_id", F.col("event_id").alias("id"),
                     F.concat(F.lit("k"), F.col("event_id").cast("string")).alias("file_key"),
                     F.round(F.col("value") * 100).cast("bigint").alias("size_bytes"),
                     F.col("ts").alias("uploaded_at"), F.col("props").alias("duration"))


UPLOADS_SQL = """SELECT user_id, event_id AS id, 'k' || CAST(event_id AS VARCHAR) AS file_key,
         CAST(round(value * 100) AS BIGINT) AS size_bytes, ts AS uploaded_at, props AS duration"""


@register("upsert_last_upload", f"""
WITH base AS (
  {UPLOADS_SQL}
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
        FROM events WHERE event_type = 'purchase' AND ts < TIMESTAMP '2024-01-10 00:00:00') t
  WHERE rn = 1),
chg_all AS (
  {UPLOADS_SQL}, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn_new,
         row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn_old
  FROM events WHERE event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-10 00:00:00'),
chg AS (
  SELECT n.user_id, n.file_key, n.size_bytes, n.uploaded_at, o.id, o.duration
  FROM chg_all n JOIN chg_all o ON n.user_id = o.user_id AND o.rn_old = 1
  WHERE n.rn_new = 1)
SELECT coalesce(b.user_id, c.user_id) AS user_id,
       CASE WHEN c.user_id IS NOT NULL THEN c.file_key ELSE b.file_key END AS file_key,
       CASE WHEN c.user_id IS NOT NULL THEN c.size_bytes ELSE b.size_bytes END AS size_bytes,
       CASE WHEN c.user_id IS NOT NULL THEN c.uploaded_at ELSE b.uploaded_at END AS uploaded_at,
       CASE WHEN b.user_id IS NOT NULL THEN b.id ELSE c.id END AS id,
       CASE WHEN b.user_id IS NOT NULL THEN b.duration ELSE c.duration END AS duration,
       CASE WHEN b.user_id IS NULL THEN 'insert' WHEN c.user_id IS NULL THEN 'keep' ELSE 'update' END AS action
FROM base b FULL OUTER JOIN chg c ON b.user_id = c.user_id
""")
def upsert_last_upload(spark, sf):
    ev = read_table(spark, sf, "events").filter(F.col("event_type") == "purchase")
    base = mutate.newest_per_key(ev.filter(F.col("ts") < ntz("2024-01-10 00:00:00")), ["user_id"],
                                 [F.col("ts").desc(), F.col("event_id").desc()])
    changes = ev.filter(F.col("ts") >= ntz("2024-01-10 00:00:00"))
    return mutate.upsert(_uploads(base), _uploads(changes), key="user_id", arrival=F.col("id"),
                         update_cols=["file_key", "size_bytes", "uploaded_at"], keep_cols=["id", "duration"])


@register("patch_update", """
WITH p AS (
  SELECT user_id, ts,
         CASE event_type WHEN 'error' THEN NULL WHEN 'view' THEN '' ELSE 'P' || CAST(event_id AS VARCHAR) END AS c_name,
         CASE WHEN event_type = 'purchase' THEN 'VIP' END AS c_mktsegment
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) t
  WHERE rn = 1)
SELECT c.c_custkey, coalesce(p.c_name, c.c_name) AS c_name,
       coalesce(p.c_mktsegment, c.c_mktsegment) AS c_mktsegment,
       p.user_id IS NOT NULL AS patched, p.ts AS updated_at
FROM customer c LEFT JOIN p ON c.c_custkey = p.user_id
""")
def patch_update(spark, sf):
    c, ev = read_table(spark, sf, "customer"), read_table(spark, sf, "events")
    newest = mutate.newest_per_key(ev, ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()])
    p = newest.select(
        "user_id", "ts",
        F.when(F.col("event_type") == "error", F.lit(None))
         .when(F.col("event_type") == "view", F.lit(""))
         .otherwise(F.concat(F.lit("P"), F.col("event_id").cast("string"))).alias("c_name"),
        F.when(F.col("event_type") == "purchase", F.lit("VIP")).alias("c_mktsegment"))
    out = mutate.patch(c.select("c_custkey", "c_name", "c_mktsegment"), p, key="c_custkey",
                       cols=["c_name", "c_mktsegment"], patch_key="user_id", stamp=F.col("ts"))
    return out


@register("keyed_update", """
SELECT c.c_custkey,
       CASE WHEN h.user_id IS NOT NULL THEN true ELSE c.c_custkey % 3 <> 0 END AS is_verified,
       h.user_id IS NOT NULL AS changed
FROM customer c LEFT JOIN (
  SELECT DISTINCT user_id FROM events
  WHERE event_type = 'click' AND ts > TIMESTAMP '2024-01-28 00:00:00') h ON c.c_custkey = h.user_id
""")
def keyed_update(spark, sf):
    c, ev = read_table(spark, sf, "customer"), read_table(spark, sf, "events")
    users = c.select("c_custkey", (F.col("c_custkey") % 3 != 0).alias("is_verified"))
    clicks = ev.filter((F.col("event_type") == "click") & (F.col("ts") > ntz("2024-01-28 00:00:00")))
    return mutate.keyed_update(users, clicks, key="c_custkey", keys_key="user_id",
                               set_cols={"is_verified": F.lit(True)})


@register("cascade_delete", """
WITH cu AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0),
o AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM cu)),
l AS (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o))
SELECT 0 AS level, 'customer' AS tbl, c_custkey AS key1, CAST(NULL AS BIGINT) AS key2 FROM cu
UNION ALL SELECT 1, 'orders', o_orderkey, o_custkey FROM o
UNION ALL SELECT 2, 'lineitem', l_orderkey, CAST(l_linenumber AS BIGINT) FROM l
""")
def cascade_delete(spark, sf):
    c, o, li = (read_table(spark, sf, t) for t in ("customer", "orders", "lineitem"))
    root = c.filter(F.col("c_acctbal") < 0)
    res = mutate.cascade_delete(root, "c_custkey", [("orders", o, "o_custkey", "o_orderkey"),
                                                    ("lineitem", li, "l_orderkey", "l_orderkey")])
    k2 = F.lit(None).cast("bigint")
    parts = [root.select(F.lit(0).alias("level"), F.lit("customer").alias("tbl"),
                         F.col("c_custkey").alias("key1"), k2.alias("key2")),
             res["orders"][0].select(F.lit(1).alias("level"), F.lit("orders").alias("tbl"),
                                     F.col("o_orderkey").alias("key1"), F.col("o_custkey").alias("key2")),
             res["lineitem"][0].select(F.lit(2).alias("level"), F.lit("lineitem").alias("tbl"),
                                       F.col("l_orderkey").alias("key1"),
                                       F.col("l_linenumber").cast("bigint").alias("key2"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("cascade_tree", """
WITH cu AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0),
o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM cu)),
e AS (SELECT event_id FROM events WHERE user_id IN (SELECT c_custkey FROM cu)),
l AS (SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem
      WHERE l_orderkey IN (SELECT o_orderkey FROM o) OR l_suppkey IN (SELECT event_id FROM e))
SELECT 'orders' AS tbl, o_orderkey AS key1, CAST(NULL AS BIGINT) AS key2 FROM o
UNION ALL SELECT 'events', event_id, NULL FROM e
UNION ALL SELECT 'lineitem', l_orderkey, CAST(l_linenumber AS BIGINT) FROM l
""")
def cascade_tree(spark, sf):
    """Customers hold orders and events; a line item hangs on its order and on an event (two parents)."""
    c, o, li, ev = (read_table(spark, sf, t) for t in ("customer", "orders", "lineitem", "events"))
    res = mutate.cascade_tree(
        "customer", c.filter(F.col("c_acctbal") < 0), {"orders": o, "events": ev, "lineitem": li},
        [("orders", "o_custkey", "customer", "c_custkey"), ("events", "user_id", "customer", "c_custkey"),
         ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_suppkey", "events", "event_id")])
    none = F.lit(None).cast("bigint").alias("key2")
    return (res["orders"][0].select(F.lit("orders").alias("tbl"), F.col("o_orderkey").alias("key1"), none)
            .unionByName(res["events"][0].select(F.lit("events").alias("tbl"), F.col("event_id").alias("key1"), none))
            .unionByName(res["lineitem"][0].select(F.lit("lineitem").alias("tbl"), F.col("l_orderkey").alias("key1"),
                                                   F.col("l_linenumber").cast("bigint").alias("key2"))))


@register("schema_evolve", """
SELECT event_id, user_id, CASE WHEN event_id % 2 = 0 THEN 'x' ELSE '' END AS name FROM events
""")
def schema_evolve(spark, sf):
    ev = read_table(spark, sf, "events").select("event_id", "user_id")
    new = ev.filter(F.col("event_id") % 2 == 0).withColumn("name", F.lit("x"))
    old = ev.filter(F.col("event_id") % 2 != 0)
    return mutate.schema_evolve(old, new, defaults={"name": F.lit("")})


@register("signup_admission", """
WITH a AS (
  SELECT event_id, ts, 'u' || CAST(user_id AS VARCHAR) || '@mail.test' AS email
  FROM events WHERE event_type = 'signup'),
k AS (SELECT DISTINCT 'u' || CAST(c_custkey AS VARCHAR) || '@mail.test' AS email
      FROM customer WHERE c_custkey % 10 = 0),
f AS (SELECT email, min(ts) AS t FROM a GROUP BY email)
SELECT a.event_id, a.email,
       CASE WHEN k.email IS NOT NULL THEN 'conflict'
            WHEN a.ts = f.t AND a.event_id = (SELECT min(event_id) FROM a a2 WHERE a2.email = a.email AND a2.ts = f.t)
                 THEN 'created'
            ELSE 'duplicate' END AS outcome
FROM a LEFT JOIN k ON a.email = k.email LEFT JOIN f ON a.email = f.email
""")
def signup_admission(spark, sf):
    ev, c = read_table(spark, sf, "events"), read_table(spark, sf, "customer")
    email = lambda k: F.concat(F.lit("u"), k.cast("string"), F.lit("@mail.test"))
    a = ev.filter(F.col("event_type") == "signup").select("event_id", "ts", email(F.col("user_id")).alias("email"))
    known = c.filter(F.col("c_custkey") % 10 == 0).select(email(F.col("c_custkey")).alias("email"))
    out = mutate.signup_admission(a, known, email="email", ts="ts", id_col="event_id")
    return out.select("event_id", "email", "outcome")


@register("signup_outputs", """
WITH a AS (SELECT event_id, ts, 'u' || CAST(user_id AS VARCHAR) AS username, 'u' || CAST(user_id AS VARCHAR) || '@mail.test' AS email
           FROM events WHERE event_type = 'signup'),
k AS (SELECT 'u' || CAST(c_custkey AS VARCHAR) || '@mail.test' AS email FROM customer WHERE c_custkey % 10 = 0),
ok AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY email ORDER BY ts, event_id) AS rn FROM a) x
       WHERE rn = 1 AND email NOT IN (SELECT email FROM k))
SELECT 'users' AS tbl, CAST(event_id AS VARCHAR) AS id, username || '|' || 'N ' || username || '|' || email || '|user|false' AS row, ts AS at FROM ok
UNION ALL SELECT 'verifier', CAST(event_id AS VARCHAR), sha256(CAST(event_id AS VARCHAR)), ts + INTERVAL 30 MINUTE FROM ok
UNION ALL SELECT 'profiles', CAST(event_id AS VARCHAR), '', ts FROM ok
UNION ALL SELECT 'quota', CAST(event_id AS VARCHAR), '0|1073741824|0|100', NULL FROM ok
UNION ALL SELECT 'messages', 'email.queue', '{"to":"' || email || '","name":"signup","token":"' || CAST(event_id AS VARCHAR) || '"}', NULL FROM ok
""")
def signup_outputs(spark, sf):
    """The derived rows of every created sign-up, one line of text a row."""
    ev, c = read_table(spark, sf, "events"), read_table(spark, sf, "customer")
    name = lambda k: F.concat(F.lit("u"), k.cast("string"))
    mail = lambda k: F.concat(name(k), F.lit("@mail.test"))
    a = ev.filter(F.col("event_type") == "signup").select(
        "event_id", "ts", name(F.col("user_id")).alias("username"), F.concat(F.lit("N "), name(F.col("user_id"))).alias("fullname"),
        mail(F.col("user_id")).alias("email"))
    known = c.filter(F.col("c_custkey") % 10 == 0).select(mail(F.col("c_custkey")).alias("email"))
    admitted = mutate.signup_admission(a, known, email="email", ts="ts", id_col="event_id")
    out = mutate.signup_outputs(admitted, user_id=F.col("event_id").cast("string"), email="email", ts="ts",
                                username="username", fullname="fullname")
    no_time = F.lit(None).cast("timestamp_ntz").alias("at")

    def text(name, id_col, cols, at):
        return out[name].select(F.lit(name).alias("tbl"), F.col(id_col).alias("id"),
                                F.concat_ws("|", *[F.col(x).cast("string") for x in cols]).alias("row"), at)
    parts = [text("users", "id", ["username", "fullname", "email", "role", "is_verified"], F.col("created_at").alias("at")),
             text("verifier", "user_id", ["token_hash"], F.col("expire_at").alias("at")),
             text("profiles", "user_id", ["profile_pic"], F.col("created_at").alias("at")),
             text("quota", "user_id", ["used_bytes", "total_bytes", "gif_count", "gif_limit"], no_time),
             text("messages", "queue", ["body"], no_time)]
    res = parts[0]
    for p in parts[1:]:
        res = res.unionByName(p)
    return res
