"""Look-ups, listings, joins and roll-ups over the supplied tables.

Analogues: users = customer (or events.user_id), items = orders, item bytes
= lineitem.l_quantity, request log / tokens / status = events, objects =
documents (n_chars = size), URLs = pages.url.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.timecols import ntz, plus
from ..operators import lookup, mutate, quality, usage
from ..sources.tables import read_table
from .registry import register

ORDER_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate"]


@register("recents_per_user", """
SELECT user_id, event_id, ts, event_type, rn FROM (
  SELECT user_id, event_id, ts, event_type,
         row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
  FROM events) t
WHERE rn <= 20
""")
def recents_per_user(spark, sf):
    ev = read_table(spark, sf, "events")
    top = lookup.top_k_per_key(ev, "user_id", [F.col("ts").desc(), F.col("event_id").desc()], 20)
    return top.select("user_id", "event_id", "ts", "event_type", F.col("rn").cast("bigint").alias("rn"))


@register("recents_one_user", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate FROM orders
WHERE o_custkey = (SELECT min(o_custkey) FROM
                     (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) > 20) h)
ORDER BY o_orderdate DESC, o_orderkey DESC
LIMIT 20
""")
def recents_one_user(spark, sf):
    o = read_table(spark, sf, "orders")
    heavy = (o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
              .filter(F.col("n") > 20).agg(F.min("o_custkey").alias("o_custkey")))
    one = lookup.batch_lookup(o, heavy, "o_custkey")
    return lookup.top_k(one.select(*ORDER_COLS),
                        [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()], 20)


@register("list_by_status", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate FROM orders WHERE o_orderstatus = 'F'
""")
def list_by_status(spark, sf):
    return lookup.filter_optional(read_table(spark, sf, "orders"), "o_orderstatus", "F").select(*ORDER_COLS)


@register("list_by_status_all", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate FROM orders
""")
def list_by_status_all(spark, sf):
    return lookup.filter_optional(read_table(spark, sf, "orders"), "o_orderstatus", "all").select(*ORDER_COLS)


@register("listing_envelope", """
WITH r AS (
  SELECT o_custkey, o_orderkey,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS pos,
         count(*) OVER (PARTITION BY o_custkey) AS total
  FROM orders),
p AS (
  SELECT o_custkey, CAST((pos - 1) // 20 AS INTEGER) + 1 AS page, max(total) AS total,
         count(*) AS n_items,
         string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY pos) AS data_keys
  FROM r GROUP BY o_custkey, CAST((pos - 1) // 20 AS INTEGER) + 1)
SELECT c.c_custkey AS user_id, coalesce(p.page, 1) AS page, 20 AS "limit",
       coalesce(p.total, 0) AS total, coalesce(p.n_items, 0) AS n_items,
       coalesce(p.data_keys, '') AS data_keys
FROM customer c LEFT JOIN p ON c.c_custkey = p.o_custkey
""")
def listing_envelope(spark, sf):
    c, o = read_table(spark, sf, "customer"), read_table(spark, sf, "orders")
    env = lookup.listing_envelope(c, o, "c_custkey", "o_custkey", "o_orderdate", "o_orderkey",
                                  ["o_orderkey", "o_orderstatus"], page_size=20)
    return env.select(
        "user_id", "page", "limit", "total",
        F.size("data").cast("bigint").alias("n_items"),
        F.array_join(F.transform("data", lambda x: x["o_orderkey"].cast("string")), ",").alias("data_keys"))


@register("public_view", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate FROM orders
""")
def public_view(spark, sf):
    return lookup.public_view(read_table(spark, sf, "orders"), ORDER_COLS)


@register("batch_lookup", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate FROM orders
WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
""")
def batch_lookup(spark, sf):
    o, c = read_table(spark, sf, "orders"), read_table(spark, sf, "customer")
    keys = c.filter(F.col("c_mktsegment") == "BUILDING")
    return lookup.batch_lookup(o.select(*ORDER_COLS), keys, "o_custkey", "c_custkey")


@register("role_gate", """
SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'
""")
def role_gate(spark, sf):
    c = read_table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return lookup.role_gate(c, "c_mktsegment", "BUILDING")


@register("delete_by_key", """
SELECT o_orderkey, o_custkey FROM orders o
WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')
""")
def delete_by_key(spark, sf):
    o, li = read_table(spark, sf, "orders"), read_table(spark, sf, "lineitem")
    gone = li.filter(F.col("l_returnflag") == "R")
    return mutate.delete_by_key(o.select("o_orderkey", "o_custkey"), gone, key="o_orderkey", keys_key="l_orderkey")


@register("profile_view", """
SELECT o.o_orderkey, o.o_custkey, c.c_name, c.c_mktsegment, o.o_orderdate
FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
WHERE c.c_custkey IS NOT NULL
""")
def profile_view(spark, sf):
    o, c = read_table(spark, sf, "orders"), read_table(spark, sf, "customer")
    return lookup.profile_view(o, c, "o_custkey", "c_custkey",
                               ["o_orderkey", "o_custkey", "c_name", "c_mktsegment", "o_orderdate"])


@register("active_tokens_asof", """
SELECT event_id AS token_id, user_id, ts AS issued_at, ts + INTERVAL 24 HOUR AS expire_at
FROM events
WHERE event_type = 'signup' AND ts + INTERVAL 24 HOUR > TIMESTAMP '2024-01-15 00:00:00'
  AND ts <= TIMESTAMP '2024-01-15 00:00:00'
""")
def active_tokens_asof(spark, sf):
    ev = read_table(spark, sf, "events").filter(F.col("event_type") == "signup")
    tok = ev.select(F.col("event_id").alias("token_id"), "user_id", F.col("ts").alias("issued_at"),
                    plus(F.col("ts"), hours=24).alias("expire_at"))
    return lookup.valid_at(tok, "expire_at", ntz("2024-01-15 00:00:00"), issued_col="issued_at")


@register("login_outcome", """
SELECT e.event_id, e.user_id * 11 AS uid,
       CASE WHEN c.c_custkey IS NULL THEN 'unknown'
            WHEN NOT (c.c_custkey % 3 <> 0) THEN 'unverified'
            WHEN NOT (e.event_id % 5 <> 0) THEN 'wrong_secret'
            ELSE 'ok' END AS outcome
FROM events e LEFT JOIN customer c ON e.user_id * 11 = c.c_custkey
""")
def login_outcome(spark, sf):
    ev, c = read_table(spark, sf, "events"), read_table(spark, sf, "customer")
    attempts = ev.select("event_id", (F.col("user_id") * 11).alias("uid"),
                         (F.col("event_id") % 5 != 0).alias("secret_ok"))
    users = c.select("c_custkey", (F.col("c_custkey") % 3 != 0).alias("verified"))
    out = lookup.login_outcome(attempts, users, "uid", "c_custkey", "verified", "secret_ok")
    return out.select("event_id", "uid", "outcome")


@register("mail_eligibility", """
SELECT e.event_id, e.user_id * 11 AS uid,
       CASE e.event_type WHEN 'signup' THEN 'resend' ELSE 'forgot' END AS kind,
       CASE WHEN c.c_custkey IS NULL THEN 'unknown'
            WHEN e.event_type = 'view' AND NOT (c.c_custkey % 3 <> 0) THEN 'not_verified'
            WHEN e.event_type = 'signup' AND (c.c_custkey % 3 <> 0) THEN 'already_verified'
            ELSE 'send' END AS outcome
FROM events e LEFT JOIN customer c ON e.user_id * 11 = c.c_custkey
WHERE e.event_type IN ('signup', 'view')
""")
def mail_eligibility(spark, sf):
    ev, c = read_table(spark, sf, "events"), read_table(spark, sf, "customer")
    req = (ev.filter(F.col("event_type").isin("signup", "view"))
             .select("event_id", (F.col("user_id") * 11).alias("uid"),
                     F.when(F.col("event_type") == "signup", "resend").otherwise("forgot").alias("kind")))
    users = c.select("c_custkey", (F.col("c_custkey") % 3 != 0).alias("verified"))
    out = lookup.mail_eligibility(req, users, "uid", "c_custkey", "verified", "kind")
    return out.select("event_id", "uid", "kind", "outcome")


@register("object_readiness", """
SELECT p.page_id, p.page_id * 5 AS object_key, d.n_chars AS size,
       CASE WHEN d.doc_id IS NULL THEN 'missing' WHEN d.n_chars <= 0 THEN 'empty' ELSE 'ready' END AS state
FROM pages p LEFT JOIN documents d
  ON p.page_id * 5 = d.doc_id
""")
def object_readiness(spark, sf):
    p, d = read_table(spark, sf, "pages"), read_table(spark, sf, "documents")
    keys = p.select("page_id", (F.col("page_id") * 5).alias("object_key"))
    inv = d.select("doc_id", "n_chars")
    return lookup.object_readiness(keys, inv, "object_key", "doc_id", "n_chars")


@register("orphan_report", """
SELECT o_orderkey, o_custkey FROM orders o
WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)
""")
def orphan_report(spark, sf):
    o, li = read_table(spark, sf, "orders"), read_table(spark, sf, "lineitem")
    return quality.orphan_report(o.select("o_orderkey", "o_custkey"), li, "o_orderkey", "l_orderkey")


@register("duplicate_keys", """
SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem
GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
""")
def duplicate_keys(spark, sf):
    return quality.duplicate_keys(read_table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@register("quota_usage", """
WITH per_order AS (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY l_orderkey),
per_cust AS (
  SELECT o.o_custkey, sum(coalesce(p.q, 0)) AS used, count(*) AS n
  FROM orders o LEFT JOIN per_order p ON o.o_orderkey = p.l_orderkey
  GROUP BY o.o_custkey)
SELECT c.c_custkey AS user_id,
       CAST(coalesce(pc.used, 0) AS BIGINT) AS used_bytes,
       coalesce(pc.n, 0) AS gif_count,
       1200 AS total_bytes, 100 AS gif_limit,
       1200 - CAST(coalesce(pc.used, 0) AS BIGINT) AS remaining,
       (CAST(coalesce(pc.used, 0) AS BIGINT) > 1200 OR coalesce(pc.n, 0) > 100) AS over_limit
FROM customer c LEFT JOIN per_cust pc ON c.c_custkey = pc.o_custkey
""")
def quota_usage(spark, sf):
    c, o, li = (read_table(spark, sf, t) for t in ("customer", "orders", "lineitem"))
    return usage.quota_usage(c, o, li, user_key="c_custkey", item_key="o_orderkey",
                             item_user_key="o_custkey", part_item_key="l_orderkey",
                             part_bytes="l_quantity", total_bytes=1200, item_limit=100)


@register("download_counts", """
WITH d AS (SELECT user_id * 7 AS k, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY user_id * 7)
SELECT o.o_orderkey, coalesce(d.n, 0) AS downloads
FROM orders o LEFT JOIN d ON o.o_orderkey = d.k
""")
def download_counts(spark, sf):
    o, ev = read_table(spark, sf, "orders"), read_table(spark, sf, "events")
    out = usage.download_counts(o.select("o_orderkey"), ev, item_key="o_orderkey",
                                event_key=F.col("user_id") * 7,
                                is_download=F.col("event_type") == "click")
    return out.select("o_orderkey", "downloads")


@register("request_rollup", """
WITH e AS (SELECT nullif(event_type, 'error') AS event_type, CASE WHEN event_type <> 'signup' THEN value END AS value FROM events)
SELECT event_type, count(*) AS n,
       round(quantile_cont(value, 0.5), 4) AS p50,
       round(quantile_cont(value, 0.95), 4) AS p95,
       max(value) AS max_value
FROM e GROUP BY event_type
""")
def request_rollup(spark, sf):
    """With a null group (errors) and a group whose values are all null (sign-ups)."""
    ev = read_table(spark, sf, "events").select(
        F.nullif("event_type", F.lit("error")).alias("event_type"),
        F.when(F.col("event_type") != "signup", F.col("value")).alias("value"))
    return usage.request_rollup(ev, group_col="event_type", value_col="value")


@register("anonymous_profile_view", """
SELECT e.event_id, c.c_custkey, c.c_name FROM events e JOIN customer c ON e.user_id = c.c_custkey WHERE e.event_type = 'view' AND c.c_custkey % 10 <> 0
""")
def anonymous_profile_view(spark, sf):
    """The anonymous form of the profile view: profiles without a live account are not shown."""
    ev, c = read_table(spark, sf, "events"), read_table(spark, sf, "customer")
    anon = c.filter(F.col("c_custkey") % 10 != 0)
    return lookup.profile_view(ev.filter(F.col("event_type") == "view"), anon, "user_id", "c_custkey", ["event_id", "c_custkey", "c_name"])
