"""Stream forms of the operators (T1-T9).

Stateless operators (decode, route, validation, scalar projections) run on a
streaming DataFrame unchanged - they are plain column expressions.  Stateful
ones keep per-key state (``state``: folds, held deliveries, confirmations that
wait); snapshot upserts run in ``foreachBatch`` against versioned snapshot folders.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from ..functions.timecols import epoch_ms
from ..operators import messages as M
from ..operators import mutate
from ..sources import messages as SM
from ..operators.ordered import as_is, as_long, fold_schema
from .state import Await, Hold, arrived, keyed_fold_stream


# T1 ----------------------------------------------------------------------
def file_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
                max_files_per_trigger: int = 1) -> DataFrame:
    """A queue read as a folder of files; Spark owns the parallelism."""
    return (spark.readStream.format(fmt).schema(schema)
            .option("maxFilesPerTrigger", max_files_per_trigger).load(path))


# T2 ----------------------------------------------------------------------
def mail_route_stream(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Decode and route mail messages; the result is written partitioned by ``queue``."""
    return M.route_mail(SM.decode(bodies, body, SM.MAIL))


# T3 ----------------------------------------------------------------------
def _retry_kernel(max_retries: int):
    def kernel(pdf: pd.DataFrame, starts: list, count):
        count = 0 if count is None else count
        n = len(pdf)
        retries = list(range(count, count + n))
        action = ["requeue" if r < max_retries else "dead" for r in retries]
        out = pd.DataFrame({"key": as_is(pdf["__key"]), "id": as_is(pdf["__id"]),
                            "retries": pd.array(retries, dtype="int64"), "action": action})
        return out, count + n
    return kernel


def retry_stream(failures: DataFrame, *, message_key: str, ts: str, id_col: str, max_retries: int,
                 idle_ms: int | None = None, **state) -> DataFrame:
    """Failures per message counted in state; requeue below the maximum, else dead."""
    return keyed_fold_stream(failures, key=message_key, ts=ts, id_col=id_col, kernel=_retry_kernel(max_retries),
                             out_schema=fold_schema(failures, message_key, id_col, "retries long, action string"),
                             idle_ms=idle_ms, **state)


# T4 ----------------------------------------------------------------------
def retry_hold_stream(failures: DataFrame, *, id_col: str, delay_ms: int = 1000) -> DataFrame:
    """Hold every failed message for ``delay_ms`` after it arrives, then release it; the input's columns.

    Each delivery waits on its own: two of one id within the hold come out twice, each when it is due.  Timers
    are on processing time, so held messages do not wait for traffic, and what is held survives a restart.
    Run it with a continuous trigger: a held message keeps the query busy until it is due.
    """
    cols = failures.columns
    keyed = failures.withColumn("__id", F.col(id_col))
    return keyed.groupBy("__id").transformWithStateInPandas(
        Hold(keyed.columns, cols, int(delay_ms)), failures.schema, "Append", "ProcessingTime")


# T8 ----------------------------------------------------------------------
def _block_kernel(pdf: pd.DataFrame, starts: list, max_exp):
    kinds = pdf["__kind"].tolist()
    exps = pdf["__exp"].tolist()
    ts = pdf["__t"].tolist()
    blocked, keep = [], []
    for i, k in enumerate(kinds):
        if k == 0:
            e = exps[i]
            if e is not None and e == e:
                max_exp = e if max_exp is None else max(max_exp, e)
        else:
            keep.append(i)
            blocked.append(max_exp is not None and max_exp > ts[i])
    sub = pdf.iloc[keep]
    out = pd.DataFrame({"key": as_is(sub["__key"]), "id": as_is(sub["__id"]),
                        "t_ms": as_long(sub["__t"]).to_numpy(), "blocked": pd.array(blocked, dtype="bool")})
    return out, (None if max_exp is None else int(max_exp))


def blocklist_stream(events: DataFrame, *, key: str, ts: str, id_col: str, is_block: Column,
                     block_expire_ms: Column, max_life_ms: int, **state) -> DataFrame:
    """One stream of requests and blocks; a request is blocked while a block of its key is live.

    State per key is only the latest block expiry; it is evicted after
    ``max_life_ms`` (or longer, see ``streaming.state``) without a row of the key.  Blocks sort before requests at the same instant.
    """
    extra = {"__kind": F.when(is_block, F.lit(0)).otherwise(F.lit(1)),
             "__exp": F.when(is_block, block_expire_ms).cast("long")}
    return keyed_fold_stream(events, key=key, ts=ts, id_col=id_col, kernel=_block_kernel,
                             out_schema=fold_schema(events, key, id_col, "t_ms long, blocked boolean"),
                             idle_ms=max_life_ms, extra=extra, **state, order=("__t", "__kind", "__id"))


# T7 ----------------------------------------------------------------------
def upsert_sink(snapshot_root: str, *, key: str, arrival: str, update_cols, keep_cols, schema: T.StructType,
                keep_versions: int = 3):
    """``foreachBatch`` function applying each micro-batch as an upsert to a versioned snapshot.

    ``schema`` is the change records' schema (it must hold the key, the
    updated and kept columns and ``arrival``); snapshots store the key, the
    updated and the kept columns.

    Version ``v{batch_id}`` is written next to the previous one and never over
    a path being read; a batch already written (replay after a failure) is
    skipped and a half-written one is rewritten, so the sink is idempotent.  Of the older versions the
    newest ``keep_versions`` stay for readers, so the folder does not grow with the stream's life.
    """
    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        target = f"{snapshot_root.rstrip('/')}/v{batch_id:08d}"
        if _exists(spark, target):
            return
        prev = latest_version(spark, snapshot_root, before=batch_id)
        snap = spark.read.parquet(prev) if prev else spark.createDataFrame([], schema)
        cols = list(dict.fromkeys([key, *update_cols, *keep_cols]))
        change_cols = list(dict.fromkeys([*cols, arrival]))
        new = mutate.upsert(snap.select(*cols), batch.select(*change_cols), key=key,
                            arrival=F.col(arrival), update_cols=update_cols, keep_cols=keep_cols)
        # a folder without _SUCCESS is an attempt that died mid-write; nobody reads it
        # (latest_version requires _SUCCESS), so the replay may replace it
        new.drop("action").write.mode("overwrite").parquet(target)
        fs, root = _path(spark, snapshot_root)
        names = sorted(st.getPath().getName() for st in fs.listStatus(root))
        for old in [n for n in names if n.startswith("v") and n[1:].isdigit() and int(n[1:]) < batch_id][:-keep_versions]:
            fs.delete(_path(spark, f"{snapshot_root.rstrip('/')}/{old}")[1], True)
    return apply


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS"))


def latest_version(spark: SparkSession, root: str, before: int | None = None) -> str | None:
    """Newest complete ``v########`` folder under ``root`` (optionally older than ``before``)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    best = None
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if name.startswith("v") and name[1:].isdigit():
            n = int(name[1:])
            if (before is None or n < before) and fs.exists(jvm.org.apache.hadoop.fs.Path(
                    st.getPath().toString() + "/_SUCCESS")):
                if best is None or n > best[0]:
                    best = (n, st.getPath().toString())
    return best[1] if best else None


def route_file_sink(routed: DataFrame, out_dir: str, checkpoint: str):
    """Exactly-once file sink with one folder per target queue."""
    return (routed.writeStream.format("parquet").partitionBy("queue")
            .option("checkpointLocation", checkpoint).option("path", out_dir))



# T9 ----------------------------------------------------------------------
def metadata_enrich_stream(confirms: DataFrame, objects: DataFrame, *, key: str, confirm_ts: str, user_id: str,
                           obj_key: str, obj_ts: str, size_col: str, type_col: str, wait: str = "1 hour",
                           retention: str | None = "7 days", lag: str = "1 hour",
                           confirm_arrival: Column | None = None, obj_arrival: Column | None = None) -> DataFrame:
    """A confirmation finds an object that is there already, or that shows up within ``wait``: every confirmation once.

    Both inputs are one union, keyed by the object's key.  ``outcome`` as in the batch form
    (``messages.metadata_enrich_interval`` with the same ``wait`` and ``retention``): ``reject`` at once, ``saved`` or ``dead`` as soon as
    the object is known, and a confirmation without an object waits ``wait + lag`` of *arrival* time and is then ``dead`` - or
    ``late`` if it was itself over ``lag`` old when it came, so that its object may have been forgotten meanwhile.
    No watermark on event time is involved, so a source behind the other loses nothing; up to ``lag`` behind, results
    equal the batch form's.  An object is remembered for ``retention + wait + lag`` of arrival time (``None``: for ever).  Of several
    objects of a key the one with the least time counts.  Arrival is the micro-batch's clock, or the columns
    given (``state.arrived``), which is how old rows are replayed.  Confirmations with a null key wait for no object.
    """
    cols = confirms.columns
    ms = {n: None if t is None else int(pd.Timedelta(t).total_seconds() * 1000) for n, t in (("wait", wait), ("retention", retention), ("lag", lag))}
    clock = F.current_timestamp()
    c = confirms.select(*[F.col(n).alias(f"__c{i}") for i, n in enumerate(cols)], F.col(key).alias("__key"), F.lit(1).alias("__kind"),
                        epoch_ms(F.col(confirm_ts)).alias("__t"), F.lit(None).cast("long").alias("__size"), F.lit(None).cast("string").alias("__type"),
                        (clock if confirm_arrival is None else confirm_arrival).cast("timestamp").alias("__at"), S.is_uuid(F.col(user_id)).alias("__user"))
    empty = [F.lit(None).cast(f.dataType).alias(f"__c{i}") for i, f in enumerate(confirms.schema)]
    o = objects.select(*empty, F.col(obj_key).alias("__key"), F.lit(0).alias("__kind"), epoch_ms(F.col(obj_ts)).alias("__t"),
                       F.col(size_col).cast("long").alias("__size"), F.col(type_col).alias("__type"),
                       (clock if obj_arrival is None else obj_arrival).cast("timestamp").alias("__at"), F.lit(True).alias("__user"))
    names = [f"__c{i}" for i in range(len(cols))]
    schema = T.StructType([T.StructField(f"__c{i}", f.dataType) for i, f in enumerate(confirms.schema)]).add("outcome", "string") \
        .add("size_bytes", "long").add("content_type", "string")
    both = c.where("__user AND __key IS NOT NULL").drop("__user").unionByName(o.where("__key IS NOT NULL").drop("__user"))
    both = arrived(both, F.col("__at")).drop("__at")
    told = both.groupBy("__key").transformWithStateInPandas(
        Await(both.columns, names, ms["wait"], ms["retention"], ms["lag"]), schema, "Append", "EventTime")
    at_once = c.where("NOT coalesce(__user, false) OR __key IS NULL").select(
        *names, F.when(F.coalesce("__user", F.lit(False)), "dead").otherwise("reject").alias("outcome"),
        F.lit(None).cast("long").alias("size_bytes"), F.lit(None).cast("string").alias("content_type"))
    return told.unionByName(at_once).select(*[F.col(f"__c{i}").alias(n) for i, n in enumerate(cols)], "outcome", "size_bytes", "content_type")


def _path(spark: SparkSession, path: str):
    """(file system, path) of the Hadoop file API."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p
