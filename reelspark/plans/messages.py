"""Messages, retries, scalar projections and validation over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.timecols import ntz, plus
from ..operators import messages as M
from ..operators import quality as Q
from ..sources import messages as SM
from ..sources.tables import USERS, read_table
from .registry import register

# events.event_type -> mail message name ('error' plays an unknown name)
MAIL_NAME = {"signup": "signup", "click": "resend-verify", "view": "forgot-password",
             "purchase": "reset-password", "error": "unknown-job"}

_NAME_SQL = ("CASE event_type WHEN 'signup' THEN 'signup' WHEN 'click' THEN 'resend-verify' "
             "WHEN 'view' THEN 'forgot-password' WHEN 'purchase' THEN 'reset-password' ELSE 'unknown-job' END")
# Bodies that a strict decoder tells apart: cut short, text after the object, two objects in a row, a field repeated, a
# field repeated in another case, a null after the field.
_ODD = {0: "cut", 10: "tail", 20: "two", 30: "again", 40: "case", 45: "null"}
BODY_SQL = f"""
  SELECT event_id, user_id, {_NAME_SQL} AS mail_name, CASE event_id % 50 WHEN 0 THEN substr(b, 1, 4) WHEN 10 THEN b || ' x' WHEN 20 THEN b || b
           WHEN 30 THEN left(b, -1) || ',"token":"last"}}' WHEN 40 THEN '{{"TO":"first",' || substr(b, 2) WHEN 45 THEN left(b, -1) || ',"Name":null}} ' ELSE b END AS body,
         event_id % 50 NOT IN (0, 10, 20) AS fine, CASE WHEN event_id % 50 = 30 THEN 'last' ELSE 't' || CAST(event_id AS VARCHAR) END AS tok
  FROM (SELECT event_id, user_id, event_type, '{{"to":"u' || CAST(user_id AS VARCHAR) || '@mail.test","name":"' || {_NAME_SQL}
               || '","token":"t' || CAST(event_id AS VARCHAR) || '"}}' AS b FROM events) x"""


def _bodies(ev):
    name = F.lit(None).cast("string")
    for k, v in MAIL_NAME.items():
        name = F.when(F.col("event_type") == k, F.lit(v)).otherwise(name)
    b = F.concat(F.lit('{"to":"u'), F.col("user_id").cast("string"), F.lit('@mail.test","name":"'), name,
                 F.lit('","token":"t'), F.col("event_id").cast("string"), F.lit('"}'))
    open_ = F.substring(b, F.lit(1), F.length(b) - 1)
    odd = {"cut": F.substring(b, 1, 4), "tail": F.concat(b, F.lit(" x")), "two": F.concat(b, b), "again": F.concat(open_, F.lit(',"token":"last"}')),
           "case": F.concat(F.lit('{"TO":"first",'), F.substring(b, F.lit(2), F.length(b))), "null": F.concat(open_, F.lit(',"Name":null} '))}
    body = b
    for k, kind in _ODD.items():
        body = F.when(F.col("event_id") % 50 == k, odd[kind]).otherwise(body)
    return ev.select("event_id", body.alias("body"))


@register("message_decode", f"""
WITH m AS ({BODY_SQL})
SELECT event_id, json_valid(body) AND fine AS valid,
       CASE WHEN fine THEN 'u' || CAST(user_id AS VARCHAR) || '@mail.test' END AS "to",
       CASE WHEN fine THEN mail_name END AS name,
       CASE WHEN fine THEN tok END AS token
FROM m
""")
def message_decode(spark, sf):
    d = SM.decode(_bodies(read_table(spark, sf, "events")), "body", SM.MAIL)
    return d.select("event_id", "valid", "msg.to", "msg.name", "msg.token")


@register("message_route", f"""
WITH m AS ({BODY_SQL}),
d AS (SELECT event_id, json_valid(body) AND fine AS valid, CASE WHEN fine THEN mail_name END AS name, CASE WHEN fine THEN tok END AS token FROM m),
r AS (SELECT *, CASE WHEN NOT valid THEN 'rejected'
                     WHEN name IN ('signup', 'resend-verify') THEN 'verification'
                     WHEN name = 'forgot-password' THEN 'reset'
                     WHEN name = 'reset-password' THEN 'notice' ELSE 'dead' END AS route FROM d)
SELECT event_id, route,
       CASE WHEN route IN ('rejected', 'dead') THEN 'email.queue.dead' ELSE 'email.queue' END AS queue,
       CASE WHEN route IN ('verification') THEN 'Verify your email'
            WHEN route IN ('reset', 'notice') THEN 'Reset Password' END AS subject,
       CASE WHEN route = 'verification' THEN 'http://127.0.0.1:8080/auth/verify?token=' || token
            WHEN route = 'reset' THEN 'http://127.0.0.1:8080/auth/reset?token=' || token END AS link
FROM r
""")
def message_route(spark, sf):
    d = SM.decode(_bodies(read_table(spark, sf, "events")), "body", SM.MAIL)
    return M.route_mail(d).select("event_id", "route", "queue", "subject", "link")


@register("message_encode", """
SELECT event_id, 'email.queue' AS queue,
       CAST(json_object('to', 'u' || CAST(user_id AS VARCHAR), 'name', event_type, 'id', event_id) AS VARCHAR) AS body
FROM events
""")
def message_encode(spark, sf):
    ev = read_table(spark, sf, "events")
    out = SM.encode(ev, {"to": F.concat(F.lit("u"), F.col("user_id").cast("string")),
                         "name": F.col("event_type"), "id": F.col("event_id")}, S.EMAIL_QUEUE)
    return out.select("event_id", "queue", "body")


def _retry_sql(where, max_retries, queue):
    return f"""
SELECT event_id, user_id, attempt, attempt - 1 AS retries,
       CASE WHEN attempt - 1 < {max_retries} THEN 'requeue' ELSE 'dead' END AS action,
       CASE WHEN attempt - 1 < {max_retries} THEN '{queue}' ELSE '{queue}.dead' END AS target_queue
FROM (SELECT event_id, user_id,
             row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS attempt
      FROM events {where}) t"""


def _retry_query(only_errors, max_retries, queue):
    def q(spark, sf):
        ev = read_table(spark, sf, "events")
        if only_errors:
            ev = ev.filter(F.col("event_type") == "error")
        ev = ev.withColumn("day", F.to_date("ts"))
        out = M.retry_dead_letter(ev, message_key=["user_id", "day"], ts="ts", id_col="event_id",
                                  max_retries=max_retries, queue=F.lit(queue))
        return out.select("event_id", "user_id", "attempt", "retries", "action", "target_queue")
    return q


register("retry_dead_letter", _retry_sql("WHERE event_type = 'error'", 1, S.PROCESS_QUEUE))(
    _retry_query(True, 1, S.PROCESS_QUEUE))
register("retry_dead_letter_max3", _retry_sql("", 3, S.EMAIL_QUEUE))(_retry_query(False, 3, S.EMAIL_QUEUE))


@register("retry_schedule", """
SELECT event_id, ts + INTERVAL 1 SECOND AS due_at, 'save.retry.queue' AS held_in,
       'video.save.queue' AS target_queue
FROM events WHERE event_type = 'error'
""")
def retry_schedule(spark, sf):
    ev = read_table(spark, sf, "events").filter(F.col("event_type") == "error")
    return M.retry_schedule(ev, ts="ts").select("event_id", "due_at", "held_in", "target_queue")


@register("retry_count", """
SELECT event_id, CAST(CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % 5 END AS BIGINT) AS retries FROM events
""")
def retry_count(spark, sf):
    ev = read_table(spark, sf, "events")
    deaths = (F.when(F.col("event_id") % 3 == 0, F.array().cast("array<struct<count:bigint>>"))
              .otherwise(F.array(F.struct((F.col("event_id") % 5).alias("count")),
                                 F.struct(F.lit(9).cast("bigint").alias("count")))))
    return ev.select("event_id", S.retry_count(deaths).alias("retries"))


_UUID_SQL = ("concat_ws('-', substr(md5(CAST(user_id AS VARCHAR)), 1, 8), substr(md5(CAST(user_id AS VARCHAR)), 9, 4), "
             "substr(md5(CAST(user_id AS VARCHAR)), 13, 4), substr(md5(CAST(user_id AS VARCHAR)), 17, 4), "
             "substr(md5(CAST(user_id AS VARCHAR)), 21, 12))")
_LANG_TYPE = {"en": "video/mp4", "fr": "video/webm", "es": "video/quicktime", "de": "video/avi"}


@register("metadata_enrich", f"""
WITH c AS (
  SELECT event_id, event_id AS object_key,
         CASE WHEN event_id % 97 = 0 THEN '' ELSE {_UUID_SQL} END AS user_uuid
  FROM events),
inv AS (
  SELECT doc_id, n_chars,
         CASE lang WHEN 'en' THEN 'video/mp4' WHEN 'fr' THEN 'video/webm' WHEN 'es' THEN 'video/quicktime'
                   WHEN 'de' THEN 'video/avi' END AS ctype
  FROM documents),
j AS (
  SELECT c.*, inv.doc_id, inv.n_chars, inv.ctype,
         CASE WHEN NOT regexp_full_match(c.user_uuid, '{S.UUID_PATTERN}') THEN 'reject'
              WHEN inv.doc_id IS NULL THEN 'retry' ELSE 'saved' END AS outcome
  FROM c LEFT JOIN inv ON c.object_key = inv.doc_id)
SELECT event_id, object_key, user_uuid, outcome,
       CASE WHEN outcome = 'saved' THEN n_chars END AS size_bytes,
       CASE WHEN outcome = 'saved' THEN ctype END AS content_type
FROM j
""")
def metadata_enrich(spark, sf):
    ev, d = read_table(spark, sf, "events"), read_table(spark, sf, "documents")
    conf = ev.select("event_id", F.col("event_id").alias("object_key"),
                     F.when(F.col("event_id") % 97 == 0, F.lit("")).otherwise(S.uuid_text(F.col("user_id")))
                     .alias("user_uuid"))
    ctype = F.lit(None).cast("string")
    for k, v in _LANG_TYPE.items():
        ctype = F.when(F.col("lang") == k, F.lit(v)).otherwise(ctype)
    inv = d.select("doc_id", "n_chars", ctype.alias("ctype"))
    out = M.metadata_enrich(conf, inv, key="object_key", user_id="user_uuid", inv_key="doc_id",
                            size_col="n_chars", type_col="ctype")
    return out.select("event_id", "object_key", "user_uuid", "outcome", "size_bytes", "content_type")


@register("metadata_enrich_interval", f"""
WITH c AS (
  SELECT event_id, ts, event_id + 40 - 80 * (event_id % 2) AS object_key,
         CASE WHEN event_id % 97 = 0 THEN '' ELSE {_UUID_SQL} END AS user_uuid
  FROM events WHERE event_type = 'click'),
o AS (SELECT event_id AS k, ts AS at, CASE WHEN event_id % 5 = 0 THEN 0 ELSE event_id * 7 END AS size_bytes, event_type AS ctype FROM events),
j AS (
  SELECT c.event_id, c.object_key, o.size_bytes, o.ctype,
         CASE WHEN NOT regexp_full_match(c.user_uuid, '{S.UUID_PATTERN}') THEN 'reject'
              WHEN o.k IS NULL THEN 'dead' ELSE 'saved' END AS outcome
  FROM c LEFT JOIN o ON c.object_key = o.k AND o.at <= c.ts + INTERVAL 1 HOUR)
SELECT event_id, object_key, outcome, CASE WHEN outcome = 'saved' THEN size_bytes END AS size_bytes,
       CASE WHEN outcome = 'saved' THEN ctype END AS content_type
FROM j
""")
def metadata_enrich_interval(spark, sf):
    """Objects before, within and after the wait of their confirmation."""
    ev = read_table(spark, sf, "events")
    conf = ev.filter(F.col("event_type") == "click").select(
        "event_id", "ts", (F.col("event_id") + 40 - 80 * (F.col("event_id") % 2)).alias("object_key"),
        F.when(F.col("event_id") % 97 == 0, F.lit("")).otherwise(S.uuid_text(F.col("user_id"))).alias("user_uuid"))
    objects = ev.select(F.col("event_id").alias("k"), F.col("ts").alias("at"), F.col("event_type").alias("ctype"),
                        F.when(F.col("event_id") % 5 == 0, F.lit(0)).otherwise(F.col("event_id") * 7).cast("bigint").alias("size"))
    out = M.metadata_enrich_interval(conf, objects, key="object_key", confirm_ts="ts", user_id="user_uuid", obj_key="k",
                                     obj_ts="at", size_col="size", type_col="ctype", wait="1 hour")
    return out.select("event_id", "object_key", "outcome", "size_bytes", "content_type")


_TYPE_OF = {"click": "video/mp4", "purchase": "video/quicktime", "signup": "video/x-matroska",
            "view": "video/webm", "error": "application/pdf"}


@register("content_type_map", """
SELECT event_id, ct AS content_type,
       CASE ct WHEN 'video/mp4' THEN 'mp4' WHEN 'video/quicktime' THEN 'mov' WHEN 'video/x-matroska' THEN 'mkv'
               WHEN 'video/webm' THEN 'webm' WHEN 'video/avi' THEN 'avi' ELSE '' END AS ext
FROM (SELECT event_id, CASE event_type WHEN 'click' THEN 'video/mp4' WHEN 'purchase' THEN 'video/quicktime'
                                       WHEN 'signup' THEN 'video/x-matroska' WHEN 'view' THEN 'video/webm'
                                       ELSE 'application/pdf' END AS ct FROM events) t
""")
def content_type_map(spark, sf):
    ev = read_table(spark, sf, "events")
    ct = F.lit(None).cast("string")
    for k, v in _TYPE_OF.items():
        ct = F.when(F.col("event_type") == k, F.lit(v)).otherwise(ct)
    t = ev.select("event_id", ct.alias("content_type"))
    return t.withColumn("ext", S.content_type_ext(F.col("content_type")))


_PATH_SQL = "regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


@register("storage_key", f"""
SELECT page_id, CAST(page_id AS VARCHAR) || sha256(url) || regexp_extract({_PATH_SQL}, '(\\.[^./]*)$', 1) AS storage_key,
       regexp_extract({_PATH_SQL}, '(\\.[^./]*)$', 1) AS ext
FROM pages
""")
def storage_key(spark, sf):
    p = read_table(spark, sf, "pages")
    path = S.url_path(F.col("url"))
    return p.select("page_id", S.storage_key(F.col("page_id"), S.token_hash(F.col("url")), path).alias("storage_key"),
                    S.file_ext(path).alias("ext"))


@register("client_ip", """
WITH a AS (
  SELECT event_id,
         CASE WHEN user_id % 10 = 0 THEN '[::1]:80' WHEN user_id % 10 = 1 THEN 'noport'
              ELSE '10.0.0.' || CAST(user_id AS VARCHAR) || ':80' END AS addr,
         CASE event_id % 4 WHEN 0 THEN 'Bearer tok' || CAST(event_id AS VARCHAR) WHEN 1 THEN 'bearer x'
                           WHEN 2 THEN 'Token abc' ELSE '' END AS header
  FROM events)
SELECT event_id, split_part(addr, ':', 1) AS ip, 'rate_limit:ip:' || split_part(addr, ':', 1) AS rate_key,
       CASE WHEN header <> '' AND starts_with(header, 'Bearer ') THEN substr(header, 8) END AS token
FROM a
""")
def client_ip(spark, sf):
    ev = read_table(spark, sf, "events")
    addr = (F.when(F.col("user_id") % 10 == 0, F.lit("[::1]:80")).when(F.col("user_id") % 10 == 1, F.lit("noport"))
            .otherwise(F.concat(F.lit("10.0.0."), F.col("user_id").cast("string"), F.lit(":80"))))
    hdr = (F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("Bearer tok"), F.col("event_id").cast("string")))
           .when(F.col("event_id") % 4 == 1, F.lit("bearer x")).when(F.col("event_id") % 4 == 2, F.lit("Token abc"))
           .otherwise(F.lit("")))
    a = ev.select("event_id", addr.alias("addr"), hdr.alias("header"))
    return a.select("event_id", S.client_ip(F.col("addr")).alias("ip"), S.rate_limit_key(F.col("addr")).alias("rate_key"),
                    S.bearer_token(F.col("header")).alias("token"))


_RANGE_RE = "^bytes=([^-]*)-([^-]*)$"


@register("range_parse", f"""
WITH h AS (
  SELECT doc_id,
         CASE doc_id % 7 WHEN 0 THEN '' WHEN 1 THEN 'bytes=0-'
              WHEN 2 THEN 'bytes=' || CAST(doc_id % 50 AS VARCHAR) || '-' || CAST(doc_id % 50 + 100 AS VARCHAR)
              WHEN 3 THEN 'bytes=-5' WHEN 4 THEN 'bytes=+5-' || CAST(doc_id AS VARCHAR)
              WHEN 5 THEN 'bytes=0-5,7-9'
              ELSE CASE WHEN doc_id % 2 = 0 THEN 'items=0-5' ELSE 'bytes=99999999999999999999-' END END AS header,
         CASE WHEN doc_id % 11 = 0 THEN 0 ELSE n_chars END AS size
  FROM documents),
p AS (SELECT *, regexp_matches(header, '{_RANGE_RE}') AS m,
             regexp_extract(header, '{_RANGE_RE}', 1) AS p1, regexp_extract(header, '{_RANGE_RE}', 2) AS p2 FROM h),
q AS (SELECT *, CASE WHEN regexp_full_match(p1, '[+]?[0-9]+') THEN TRY_CAST(p1 AS BIGINT) END AS s,
             CASE WHEN p2 = '' THEN size - 1 WHEN regexp_full_match(p2, '[+]?[0-9]+') THEN TRY_CAST(p2 AS BIGINT) END AS e_raw
      FROM p),
r AS (SELECT *, least(e_raw, size - 1) AS e,
             coalesce(m AND s IS NOT NULL AND e_raw IS NOT NULL AND s <= least(e_raw, size - 1), false) AS ok FROM q)
SELECT doc_id, header, size,
       CASE WHEN header = '' THEN 0 WHEN ok THEN s END AS "start",
       CASE WHEN header = '' THEN size - 1 WHEN ok THEN e END AS "end",
       CASE WHEN header = '' THEN size WHEN ok THEN e - s + 1 END AS length,
       CASE WHEN header = '' THEN 200 WHEN ok THEN 206 ELSE 416 END AS code
FROM r
""")
def range_parse(spark, sf):
    d = read_table(spark, sf, "documents")
    k = F.col("doc_id") % 7
    hdr = (F.when(k == 0, F.lit("")).when(k == 1, F.lit("bytes=0-"))
           .when(k == 2, F.concat(F.lit("bytes="), (F.col("doc_id") % 50).cast("string"), F.lit("-"),
                                  (F.col("doc_id") % 50 + 100).cast("string")))
           .when(k == 3, F.lit("bytes=-5"))
           .when(k == 4, F.concat(F.lit("bytes=+5-"), F.col("doc_id").cast("string")))
           .when(k == 5, F.lit("bytes=0-5,7-9"))
           .otherwise(F.when(F.col("doc_id") % 2 == 0, F.lit("items=0-5")).otherwise(F.lit("bytes=99999999999999999999-"))))
    size = F.when(F.col("doc_id") % 11 == 0, F.lit(0).cast("bigint")).otherwise(F.col("n_chars"))
    h = d.select("doc_id", hdr.alias("header"), size.alias("size"))
    r = S.range_parse(F.col("header"), F.col("size"))
    return h.select("doc_id", "header", "size", r["start"].alias("start"), r["end"].alias("end"),
                    r["length"].alias("length"), r["code"].alias("code"))


@register("token_hash", """
SELECT doc_id, sha256(text) AS token_hash FROM documents
""")
def token_hash(spark, sf):
    d = read_table(spark, sf, "documents")
    return d.select("doc_id", S.token_hash(F.col("text")).alias("token_hash"))


@register("url_parts", f"""
SELECT page_id,
       regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1) AS host,
       CASE WHEN regexp_matches(url, '[?&]page=') THEN regexp_extract(url, '[?&]page=([^&#]*)', 1) END AS page,
       regexp_extract({_PATH_SQL}, '(\\.[^./]*)$', 1) AS ext
FROM pages
""")
def url_parts(spark, sf):
    p = read_table(spark, sf, "pages")
    return p.select("page_id", S.url_host(F.col("url")).alias("host"),
                    S.url_query_param(F.col("url"), "page").alias("page"),
                    S.file_ext(S.url_path(F.col("url"))).alias("ext"))


@register("record_validation", """
SELECT doc_id, v AS violations, v = '' AS valid FROM (
  SELECT doc_id,
         CASE WHEN text IS NULL OR text = '' THEN 'text:required'
              WHEN length(text) < 20 THEN 'text:min'
              WHEN length(text) > 2000 THEN 'text:max'
              WHEN NOT regexp_matches(text, '[!@#$%^&*]') THEN 'text:containsany'
              ELSE '' END AS v
  FROM documents) t
""")
def record_validation(spark, sf):
    d = read_table(spark, sf, "documents")
    t = F.col("text")
    rules = [("text:required", Q.required(t)), ("text:min", Q.too_short(t, 20)),
             ("text:max", Q.too_long(t, 2000)), ("text:containsany", Q.lacks_any(t, S.SPECIAL_CHARS))]
    v = Q.validate(d.select("doc_id", "text"), rules)
    return v.select("doc_id", F.array_join("violations", ",").alias("violations"), "valid")


@register("conversion_validation", """
SELECT l_orderkey, l_linenumber, v AS violations, v = '' AS valid FROM (
  SELECT l_orderkey, l_linenumber, concat_ws(',',
      CASE WHEN NOT (l_discount * 100 < l_quantity) THEN 'start_before_end' END,
      CASE WHEN l_linenumber < 0 OR l_linenumber > 5 THEN 'fps_range' END,
      CASE WHEN l_partkey % 2500 < 0 OR l_partkey % 2500 > 1920 THEN 'width_range' END) AS v
  FROM lineitem) t
""")
def conversion_validation(spark, sf):
    li = read_table(spark, sf, "lineitem")
    rules = Q.conversion_rules(F.col("l_discount") * 100, F.col("l_quantity"), F.col("l_linenumber"),
                               F.col("l_partkey") % 2500, max_fps=5, max_width=1920)
    v = Q.validate(li.select("l_orderkey", "l_linenumber", "l_discount", "l_quantity", "l_partkey"), rules)
    return v.select("l_orderkey", "l_linenumber", F.array_join("violations", ",").alias("violations"), "valid")


# sign-up records built from customers: every rule is broken by some of them
_SIGNUP_SQL = """
  SELECT c_custkey,
         CASE c_custkey % 9 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'abc' WHEN 3 THEN repeat('x', 21) WHEN 4 THEN 'no_good'
              ELSE 'user' || CAST(c_custkey AS VARCHAR) END AS username,
         CASE c_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'Bo' WHEN 2 THEN repeat('n', 101) ELSE c_name END AS fullname,
         CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'nobody' WHEN 2 THEN repeat('m', 45) || '@a.test'
              ELSE 'u' || CAST(c_custkey AS VARCHAR) || '@mail.test' END AS email,
         CASE c_custkey % 11 WHEN 0 THEN NULL WHEN 1 THEN 'a!' WHEN 2 THEN repeat('p!', 36) WHEN 3 THEN 'plainword' ELSE 'Secret!1' END AS password,
         CASE c_custkey % 4 WHEN 0 THEN 'other' ELSE 'Secret!1' END AS confirm_password
  FROM customer"""


def _signups(c):
    k = F.col("c_custkey")

    def pick(mod, cases, other):
        out = None
        for i, v in enumerate(cases):
            out = F.when(k % mod == i, v) if out is None else out.when(k % mod == i, v)
        return out.otherwise(other)
    none = F.lit(None).cast("string")
    rep = lambda t, n: F.lit(t * n)
    return c.select(
        "c_custkey",
        pick(9, [none, F.lit(""), F.lit("abc"), rep("x", 21), F.lit("no_good")], F.concat(F.lit("user"), k.cast("string"))).alias("username"),
        pick(7, [none, F.lit("Bo"), rep("n", 101)], F.col("c_name")).alias("fullname"),
        pick(5, [F.lit(""), F.lit("nobody"), F.lit("m" * 45 + "@a.test")], F.concat(F.lit("u"), k.cast("string"), F.lit("@mail.test"))).alias("email"),
        pick(11, [none, F.lit("a!"), rep("p!", 36), F.lit("plainword")], F.lit("Secret!1")).alias("password"),
        pick(4, [F.lit("other")], F.lit("Secret!1")).alias("confirm_password"))


_UC = r"\x{00A0}-\x{D7FF}\x{F900}-\x{FDCF}\x{FDF0}-\x{FFEF}"


def _email_sql(c: str) -> str:
    atom = rf"[a-zA-Z0-9!#$%&''*+\-/=?^_`{{|}}~{_UC}]+"
    quoted = rf'"([ \t!#-\[\]-~{_UC}]|\\[ \t!-~{_UC}])+"'
    label, inner, last = rf"[a-zA-Z0-9{_UC}]", rf"[a-zA-Z0-9\-._~{_UC}]*", rf"[a-zA-Z{_UC}]"
    return (f"(regexp_full_match({c}, '({atom}(\\.{atom})*|{quoted})@({label}({inner}{label})?\\.)+{last}({inner}{last})?')"
            f" AND NOT contains(regexp_extract({c}, '@([^@]*)$', 1), '..'))")


@register("signup_validation", f"""
SELECT c_custkey, v AS violations, v = '' AS valid FROM (
  SELECT c_custkey, concat_ws(',',
    CASE WHEN username IS NULL OR username = '' THEN 'username:required' WHEN length(username) < 4 THEN 'username:min'
         WHEN length(username) > 20 THEN 'username:max' WHEN NOT regexp_full_match(username, '[a-zA-Z0-9]+') THEN 'username:alphanum' END,
    CASE WHEN fullname IS NULL OR fullname = '' THEN 'fullname:required' WHEN length(fullname) < 4 THEN 'fullname:min'
         WHEN length(fullname) > 100 THEN 'fullname:max' END,
    CASE WHEN email IS NULL OR email = '' THEN 'email:required'
         WHEN NOT {_email_sql("email")} THEN 'email:email' WHEN length(email) > 50 THEN 'email:max' END,
    CASE WHEN password IS NULL OR password = '' THEN 'password:required' WHEN length(password) < 5 THEN 'password:min'
         WHEN length(password) > 70 THEN 'password:max' WHEN NOT regexp_matches(password, '[!@#$%^&*]') THEN 'password:containsany' END,
    CASE WHEN coalesce(confirm_password = password, false) THEN NULL ELSE 'confirm_password:eqfield' END) AS v
  FROM ({_SIGNUP_SQL}) s) t
""")
def signup_validation(spark, sf):
    v = Q.validate(_signups(read_table(spark, sf, "customer")), Q.record_rules("signup"))
    return v.select("c_custkey", F.array_join("violations", ",").alias("violations"), "valid")


# One text for both engines: what every request record may hold, good and bad.
_REQUESTS_SQL = """
SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN 'u' || CAST(c_custkey AS STRING) || '@mail.test' WHEN 1 THEN '' WHEN 2 THEN 'no-at.example' WHEN 3 THEN 'a@b..c'
    WHEN 4 THEN NULL WHEN 5 THEN repeat('x', 45) || '@mail.test' WHEN 6 THEN '.a@b.c' ELSE 'first.last+tag@sub-1.example.org' END AS email,
  CASE c_custkey % 5 WHEN 0 THEN 'secret!1' WHEN 1 THEN 'a!c' WHEN 2 THEN '' WHEN 3 THEN 'longenough' ELSE repeat('x', 70) || '!' END AS password,
  CASE c_custkey % 3 WHEN 0 THEN 'other' ELSE CASE c_custkey % 5 WHEN 0 THEN 'secret!1' WHEN 1 THEN 'a!c' WHEN 2 THEN '' WHEN 3 THEN 'longenough' ELSE NULL END END AS confirm_password,
  CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN repeat('t', 51) ELSE 'tok' END AS token,
  CASE c_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'abcd' WHEN 2 THEN repeat('p', 71) ELSE 'current' END AS current_password,
  CASE WHEN c_custkey % 2 = 0 THEN 'clip.mp4' ELSE '' END AS filename, CASE WHEN c_custkey % 3 = 1 THEN NULL ELSE 'video/mp4' END AS content_type,
  CASE WHEN c_custkey % 5 = 2 THEN '' ELSE 'k/' || CAST(c_custkey AS STRING) END AS key, CASE WHEN c_custkey % 6 = 1 THEN '' ELSE c_name END AS fullname,
  CASE WHEN c_custkey % 9 = 4 THEN NULL ELSE 'user' END AS role
FROM customer"""


def _request_validation_sql() -> str:
    need = lambda f: f"WHEN {f} IS NULL OR {f} = '' THEN '{f}:required'"
    size = lambda f, lo, hi: f"WHEN length({f}) < {lo} THEN '{f}:min' WHEN length({f}) > {hi} THEN '{f}:max'"
    case = lambda *whens: f"CASE {' '.join(whens)} END"
    email = case(need("email"), f"WHEN NOT {_email_sql('email')} THEN 'email:email' WHEN length(email) > 50 THEN 'email:max'")
    password = case(need("password"), size("password", 5, 70), "WHEN NOT regexp_matches(password, '[!@#$%^&*]') THEN 'password:containsany'")
    same = "CASE WHEN coalesce(confirm_password = password, false) THEN NULL ELSE 'confirm_password:eqfield' END"
    records = {"login": [email, password], "reset_password": [case(need("token"), "WHEN length(token) > 50 THEN 'token:max'"), password, same],
               "forgot_password": [email], "resend_verify": [email],
               "change_password": [case(need("current_password"), size("current_password", 5, 70)), password, same], "delete_user": [password],
               "upload": [case(need("filename")), case(need("content_type"))], "upload_confirm": [case(need("key")), case(need("filename"))],
               "token_payload": [case(need(f)) for f in ("fullname", "email", "role")]}
    return "\nUNION ALL ".join(f"SELECT c_custkey, '{name}' AS record, concat_ws(',', {', '.join(rules)}) AS violations FROM ({_REQUESTS_SQL}) q"
                               for name, rules in records.items())


@register("request_validation", _request_validation_sql())
def request_validation(spark, sf):
    """Every request record's rules, the access token's payload among them, over the same fields in one pass."""
    rows = spark.sql(_REQUESTS_SQL.replace("FROM customer", "FROM {customer}"), customer=read_table(spark, sf, "customer"))
    found = [F.struct(F.lit(name).alias("record"), F.array_join(Q.violations(Q.record_rules(name)), ",").alias("violations"))
             for name in sorted(Q.RECORD_RULES) if name != "signup"]
    return rows.select("c_custkey", F.inline(F.array(*found)))


@register("ddl_validation", f"""
SELECT c_custkey, v AS violations, v = '' AS valid FROM (
  SELECT c_custkey, concat_ws(',',
    CASE WHEN username IS NULL THEN 'username:notnull' WHEN length(username) > 21 THEN 'username:max' END,
    CASE WHEN length(fullname) > 100 THEN 'fullname:max' END,
    CASE WHEN email IS NULL THEN 'email:notnull' WHEN length(email) > 50 THEN 'email:max' END,
    CASE WHEN length(password) > 70 THEN 'password_hash:max' END,
    CASE WHEN length(role) > 6 THEN 'role:max' END) AS v
  FROM (SELECT *, CASE WHEN c_custkey % 6 = 0 THEN 'operator' ELSE 'user' END AS role FROM ({_SIGNUP_SQL}) s0) s) t
""")
def ddl_validation(spark, sf):
    """User rows against the table's own limits (NOT NULL, lengths)."""
    u = _signups(read_table(spark, sf, "customer")).select(
        "c_custkey", F.col("c_custkey").cast("string").alias("id"), "username", "fullname", "email",
        F.col("password").alias("password_hash"), F.when(F.col("c_custkey") % 6 == 0, "operator").otherwise("user").alias("role"),
        F.lit(True).alias("is_verified"), *[F.lit(None).cast("timestamp_ntz").alias(c) for c in ("created_at", "updated_at", "deleted_at")])
    v = Q.validate(u, Q.table_rules("users", USERS))
    return v.select("c_custkey", F.array_join("violations", ",").alias("violations"), "valid")


@register("remaining_life", """
SELECT event_id, CAST(epoch_us(ts + INTERVAL 24 HOUR) // 1000 - epoch_us(TIMESTAMP '2024-01-15 12:00:00') // 1000 AS BIGINT) AS remaining_ms,
       ts + INTERVAL 24 HOUR <= TIMESTAMP '2024-01-15 12:00:00' AS noop
FROM events WHERE event_type = 'click'
""")
def remaining_life(spark, sf):
    """Time left of a token at logout; a block that has lapsed already does nothing."""
    ev = read_table(spark, sf, "events").filter(F.col("event_type") == "click")
    left = S.remaining_ms(plus(F.col("ts"), hours=24), ntz("2024-01-15 12:00:00"))
    return ev.select("event_id", left.alias("remaining_ms"), (left <= 0).alias("noop"))


@register("path_values", f"""
SELECT page_id, nullif(split_part({_PATH_SQL}, '/', 2), '') AS first_value, nullif(split_part({_PATH_SQL}, '/', 3), '') AS second_value FROM pages
""")
def path_values(spark, sf):
    p = read_table(spark, sf, "pages")
    return p.select("page_id", S.url_path_value(F.col("url"), 1).alias("first_value"), S.url_path_value(F.col("url"), 2).alias("second_value"))
