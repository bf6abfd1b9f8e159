"""Conversion planning, frame grids, resampling, codebooks, object inventory."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.timecols import ntz
from ..operators import lookup, media
from ..session import shared_path
from ..sources import objects
from ..sources.listing import listing
from ..sources.tables import read_table
from .registry import register


def _fixed2_sql(x):
    return (f"(CASE WHEN {x} < 0 OR ({x} = 0 AND starts_with(CAST({x} AS VARCHAR), '-')) THEN '-' ELSE '' END"
            f" || printf('%.2f', round_even(abs({x}), 2)))")


_ST = "CAST(CAST(l_discount * 10 AS FLOAT) AS DOUBLE)"
_DUR = "CAST(CAST(l_quantity / 8 AS FLOAT) - CAST(l_discount * 10 AS FLOAT) AS DOUBLE)"


@register("conversion_plan", f"""
SELECT l_orderkey, l_linenumber, fps AS plan_fps, width AS plan_width,
       CASE WHEN l_linenumber % 2 = 0 THEN '0' ELSE '-1' END AS loop_arg,
       {_fixed2_sql(_ST)} AS ss, {_fixed2_sql(_DUR)} AS t,
       'fps=' || CAST(fps AS VARCHAR) || ',scale=' || CAST(width AS VARCHAR) || ':-1:flags=lanczos,palettegen' AS palette_filter,
       'fps=' || CAST(fps AS VARCHAR) || ',scale=' || CAST(width AS VARCHAR)
         || ':-1:flags=lanczos[x];[x][1:v]paletteuse' AS gif_filter
FROM (SELECT *,
             CASE WHEN CAST(round(l_tax * 100) AS INTEGER) = 0 THEN 10 ELSE CAST(round(l_tax * 100) AS INTEGER) END AS fps,
             CASE WHEN l_linenumber % 3 = 0 THEN 480 ELSE l_linenumber * 160 END AS width
      FROM lineitem) t
""")
def conversion_plan(spark, sf):
    li = read_table(spark, sf, "lineitem")
    req = li.select("l_orderkey", "l_linenumber",
                    (F.col("l_discount") * 10).cast("float").alias("start_time"),
                    (F.col("l_quantity") / 8).cast("float").alias("end_time"),
                    F.round(F.col("l_tax") * 100).cast("int").alias("fps"),
                    F.when(F.col("l_linenumber") % 3 == 0, F.lit(0)).otherwise(F.col("l_linenumber") * 160).alias("width"),
                    (F.col("l_linenumber") % 2 == 0).alias("loop"))
    plan = media.conversion_plan(req, start="start_time", end="end_time", fps="fps", width="width", loop="loop")
    return plan.select("l_orderkey", "l_linenumber", "plan_fps", "plan_width", "loop_arg", "ss", "t",
                       "palette_filter", "gif_filter")


@register("frame_grid", """
SELECT l_orderkey, l_linenumber, frame,
       CAST(floor((l_discount * 10 + frame / l_linenumber) * 1000) AS BIGINT) AS t_ms
FROM (SELECT l_orderkey, l_linenumber, l_discount,
             unnest(range(0, CAST(ceil(l_quantity / 8 * l_linenumber) AS BIGINT))) AS frame
      FROM lineitem) t
""")
def frame_grid(spark, sf):
    li = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_quantity")
    g = media.frame_grid(li, start=F.col("l_discount") * 10, duration=F.col("l_quantity") / 8,
                         fps=F.col("l_linenumber"))
    return g.select("l_orderkey", "l_linenumber", "frame", "t_ms")


@register("series_resample", """
WITH g AS (
  SELECT user_id, unnest(generate_series((SELECT date_trunc('day', min(ts)) FROM events), (SELECT max(ts) FROM events),
                                         INTERVAL 6 HOUR)) AS t
  FROM (SELECT DISTINCT user_id FROM events) u)
SELECT g.user_id, g.t, e.value, e.event_id AS sample_id, e.ts AS sample_ts
FROM g ASOF LEFT JOIN events e ON g.user_id = e.user_id AND g.t >= e.ts
""")
def series_resample(spark, sf):
    ev = read_table(spark, sf, "events")
    keys = ev.select("user_id").distinct()
    first, last = ev.agg(F.date_trunc("day", F.min("ts")).cast("timestamp_ntz").cast("string"), F.max("ts").cast("string")).first()
    return media.series_resample(ev, keys, key="user_id", ts="ts", id_col="event_id", value="value",
                                 grid_start=ntz(first), grid_end=ntz(last), step="6 HOURS")


@register("codebook_assign", """
WITH x AS (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings),
cb AS (SELECT label AS code, pos, avg(v) AS m FROM x GROUP BY label, pos),
d AS (SELECT x.vec_id, any_value(x.label) AS label, cb.code, sum((x.v - cb.m) * (x.v - cb.m)) AS dist
      FROM x JOIN cb ON x.pos = cb.pos GROUP BY x.vec_id, cb.code)
SELECT vec_id, label, code FROM (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, code) AS rn FROM d) t
WHERE rn = 1
""")
def codebook_assign(spark, sf):
    emb = read_table(spark, sf, "embeddings")
    book = media.codebook_means(emb, vec="embedding", group="label")
    return media.codebook_assign(emb, book, vec="embedding").select("vec_id", "label", "code")


@register("object_inventory", """
SELECT lang, CAST(sum(strlen(text) + 1) AS BIGINT) AS total_bytes FROM documents GROUP BY lang
""")
def object_inventory(spark, sf):
    """Bytes of the objects of each language: written from the documents table (into a folder that goes with the
    application), listed through the binaryFile source."""
    docs = read_table(spark, sf, "documents")
    root = shared_path(spark, "objects")
    objects.write_objects(docs, root, key="doc_id", body="text", partition="lang")
    return (objects.inventory(spark, root).groupBy(F.regexp_extract("key", "lang=([^/]*)/", 1).alias("lang"))
            .agg(F.sum("size").cast("bigint").alias("total_bytes")))


@register("object_readiness_listed", """
SELECT page_id, CASE WHEN page_id % 97 >= 89 THEN 'missing' WHEN page_id % 97 IN (5, 17) THEN 'empty'
                     WHEN page_id % 97 IN (SELECT doc_id % 89 FROM documents WHERE text IS NOT NULL) THEN 'ready' ELSE 'missing' END AS state
FROM pages
""")
def object_readiness_listed(spark, sf):
    """Readiness against a listed store: objects are written from the documents, two of them without a byte, and listed."""
    docs = read_table(spark, sf, "documents").where("text IS NOT NULL").select(F.concat(F.lit("o"), (F.col("doc_id") % 89).cast("string")).alias("object"), "text")
    root = shared_path(spark, "listed")
    objects.write_objects(docs.where("object NOT IN ('o5', 'o17')"), root, key="object", body="text", partition="object")
    for name in ("o5", "o17"):
        docs.where("false").select("text").coalesce(1).write.text(f"{root}/object={name}")
    inv = listing(spark, root).groupBy(F.regexp_extract("key", "^object=([^/]*)/", 1).alias("object")).agg(F.sum("size").alias("bytes"))
    keys = read_table(spark, sf, "pages").select("page_id", F.concat(F.lit("o"), (F.col("page_id") % 97).cast("string")).alias("wanted"))
    return lookup.object_readiness(keys, inv, "wanted", "object", "bytes").select("page_id", "state")


@register("series_resample_uuid", """
WITH e AS (SELECT 'u-' || CAST(user_id AS VARCHAR) AS uid, 's-' || CAST(event_id AS VARCHAR) AS sid, ts, value FROM events),
g AS (SELECT uid, unnest(generate_series(TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-09', INTERVAL 15 MINUTE)) AS t
      FROM (SELECT DISTINCT uid FROM e) u)
SELECT g.uid, g.t, e.value, e.sid AS sample_id, e.ts AS sample_ts FROM g ASOF LEFT JOIN e ON g.uid = e.uid AND g.t >= e.ts
""")
def series_resample_uuid(spark, sf):
    """Resampling with text keys and text sample ids, on a fine grid."""
    ev = read_table(spark, sf, "events").select(F.concat(F.lit("u-"), F.col("user_id").cast("string")).alias("uid"),
                                                F.concat(F.lit("s-"), F.col("event_id").cast("string")).alias("sid"), "ts", "value")
    return media.series_resample(ev, ev.select("uid").distinct(), key="uid", ts="ts", id_col="sid", value="value",
                                 grid_start=ntz("2024-01-05 00:00:00"), grid_end=ntz("2024-01-09 00:00:00"), step="15 MINUTES")


def _median_cut_sql(codes: int) -> str:
    """The same cuts one after another: the widest box is cut at the median of its widest position."""
    steps = ["b0 AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, 0 AS box FROM embeddings WHERE embedding IS NOT NULL)"]
    for k in range(codes - 1):
        steps.append(f"""
w{k} AS (SELECT box, pos, max(x) AS hi FROM (SELECT box, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM b{k}) u
         GROUP BY box, pos ORDER BY max(x) - min(x) DESC, box, pos LIMIT 1),
m{k} AS (SELECT any_value(w.box) AS box, any_value(w.pos) AS pos, any_value(w.hi) AS hi, quantile_cont(b.v[w.pos], 0.5) AS cut FROM b{k} b JOIN w{k} w USING (box)),
b{k + 1} AS (SELECT vec_id, v, CASE WHEN b.box = m.box AND (v[pos] > cut OR (cut = hi AND v[pos] = hi)) THEN {k + 1} ELSE b.box END AS box FROM b{k} b, m{k} m)""")
    return f"WITH {','.join(steps)} SELECT vec_id, box AS code FROM b{codes - 1}"


@register("palette_median_cut", _median_cut_sql(6))
def palette_median_cut(spark, sf):
    emb = read_table(spark, sf, "embeddings").where("embedding IS NOT NULL")
    cuts = media.median_cut(emb, vec="embedding", codes=6)
    return media.median_cut_assign(emb, cuts, vec="embedding").select("vec_id", "code")
