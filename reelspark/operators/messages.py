"""Message handling: routing, bounded retry with dead-letter, delayed retry,
metadata enrichment (T2-T4, J6, F13, F14, F17)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.timecols import epoch_ms, plus
from .ordered import DEFAULT_BUCKET_MS, keyed_position


# T2 / F17 ----------------------------------------------------------------
def route_mail(decoded: DataFrame, *, msg: str = "msg", queue: str = S.EMAIL_QUEUE,
               base_url: str = S.MAIL_BASE_URL) -> DataFrame:
    """Route decoded mail messages by name.

    ``route``: verification / reset / notice; ``dead`` for an unknown name;
    ``rejected`` for an undecodable body.  Dead and rejected messages go to
    the dead-letter queue; the rest carry the mail row (subject, link).
    """
    mf = S.mail_fields(F.col(f"{msg}.name"), F.col(f"{msg}.token"), base_url)
    route = (F.when(~F.col("valid"), "rejected")
             .when(mf["template"].isNull(), "dead")
             .otherwise(mf["template"]))
    out_q = F.when(route.isin("rejected", "dead"), S.dead_letter_queue(F.lit(queue))).otherwise(F.lit(queue))
    return (decoded.withColumn("route", route).withColumn("queue", out_q)
                   .withColumn("subject", mf["subject"]).withColumn("link", mf["link"]))


# T3 / D6 -----------------------------------------------------------------
def running_count(df: DataFrame, keys: Sequence[str], t_col: str, id_col: str, out_col: str,
                  bucket_ms: int = DEFAULT_BUCKET_MS) -> DataFrame:
    """1-based position of each row within its key, in (t, id) order (bucketed, skew-safe)."""
    return keyed_position(df, keys, t_col, id_col, out_col, bucket_ms=bucket_ms, t_ms=epoch_ms(F.col(t_col)))


def retry_dead_letter(failures: DataFrame, *, message_key: Sequence[str], ts: str, id_col: str,
                      max_retries: int, queue: Column) -> DataFrame:
    """Each failure of a message is requeued while earlier failures < max, else dead-lettered.

    ``retries`` = failures of the same message before this one (the stated
    intent; the service's counter never advances, see D6).
    """
    f = running_count(failures, message_key, ts, id_col, "attempt")
    retries = F.col("attempt") - 1
    action = F.when(retries < F.lit(max_retries), "requeue").otherwise("dead")
    return (f.withColumn("retries", retries).withColumn("action", action)
             .withColumn("target_queue", F.when(action == "dead", S.dead_letter_queue(queue)).otherwise(queue)))


# T4 ----------------------------------------------------------------------
def retry_schedule(failures: DataFrame, *, ts: str, delay_ms: int = 1000,
                   retry_queue: str = S.SAVE_RETRY_QUEUE, target_queue: str = S.SAVE_QUEUE) -> DataFrame:
    """Delayed retry: held in the retry queue, due back on the target queue after the delay."""
    return (failures.withColumn("held_in", F.lit(retry_queue))
                    .withColumn("due_at", plus(F.col(ts), seconds=delay_ms / 1000))
                    .withColumn("target_queue", F.lit(target_queue)))


# J6 / F3 / T9 ------------------------------------------------------------
def metadata_enrich(confirms: DataFrame, inventory: DataFrame, *, key: str, user_id: str,
                    inv_key: str, size_col: str, type_col: str) -> DataFrame:
    """Upload confirmation joined to the object's stat.

    ``outcome``: ``reject`` (user id is not a UUID: dropped), ``retry``
    (object not there yet: one delayed retry per failure) or ``saved`` with
    size and content type.  An empty object is there: its size 0 is saved.
    """
    inv = inventory.select(F.col(inv_key).alias("__ik"), F.col(size_col).alias("size_bytes"),
                           F.col(type_col).alias("content_type"))
    j = confirms.join(inv, confirms[key] == inv["__ik"], "left")
    outcome = (F.when(~S.is_uuid(F.col(user_id)), "reject")
               .when(F.col("__ik").isNull(), "retry")
               .otherwise("saved"))
    saved = outcome == "saved"
    return (j.withColumn("outcome", outcome)
             .withColumn("size_bytes", F.when(saved, F.col("size_bytes")))
             .withColumn("content_type", F.when(saved, F.col("content_type")))
             .drop("__ik"))


def metadata_enrich_interval(confirms: DataFrame, objects: DataFrame, *, key: str, confirm_ts: str,
                             user_id: str, obj_key: str, obj_ts: str, size_col: str, type_col: str,
                             wait: str = "1 hour", retention: str | None = None) -> DataFrame:
    """T9: a confirmation is saved if its object is there already (since ``retention`` at most, where given) or shows up
    within ``wait`` after it, else it is dead-lettered.

    Batch twin of :func:`reelspark.streaming.flows.metadata_enrich_stream`: an equi join on the key, the times compared
    afterwards.  Of several objects of a key the one with the least (time, size, type) counts, so every confirmation is one row.
    """
    first = F.min(F.struct(F.col(obj_ts).alias("t"), F.col(size_col).cast("long").alias("s"), F.col(type_col).alias("c"))).alias("__o")
    o = objects.groupBy(F.col(obj_key).alias("__ok")).agg(first)
    j = confirms.join(o, confirms[key] == o["__ok"], "left")
    there = F.col("__o").isNotNull() & (F.col("__o.t") <= F.col(confirm_ts) + F.expr(f"INTERVAL {wait}"))
    if retention is not None:
        there = there & (F.col("__o.t") >= F.col(confirm_ts) - F.expr(f"INTERVAL {retention}"))
    outcome = (F.when(~F.coalesce(S.is_uuid(F.col(user_id)), F.lit(False)), "reject")
               .when(F.coalesce(there, F.lit(False)), "saved")
               .otherwise("dead"))
    saved = outcome == "saved"
    return (j.withColumn("outcome", outcome)
             .withColumn("size_bytes", F.when(saved, F.col("__o.s")))
             .withColumn("content_type", F.when(saved, F.col("__o.c")))
             .drop("__ok", "__o"))
