"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import sys
import types

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import reliable_checkpoint, shared_path


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared checkpoint folder (never a local checkpoint)."""
    return reliable_checkpoint(df)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back (it survives lost executors)."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of whole texts in an Arrow batch; a batch is held several times over, by the JVM and by Python.
BATCH_ROWS = 1000


def bounded_batches(df: DataFrame) -> DataFrame:
    """Lower (never raise) the session's rows per Arrow batch to ``BATCH_ROWS``; the default is made for narrow rows."""
    key, spark = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    return df


def trim() -> None:
    """Give memory that a kernel has freed back to the system: Python workers live on and share an executor's limit."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):       # another C library
        pass


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished jobs now.

    Its cleaner acts when the driver's JVM collects garbage, which a quiet driver does rarely; a long
    operator would otherwise keep the shuffles of all its steps on disk until its end.  The last job is
    still held by Spark itself: call this after a further, small one.  What the driver's Python has freed goes back to
    the system, and what its JVM no longer uses (plans, compiled code) can.
    """
    gc.collect()
    trim()
    spark.sparkContext._jvm.System.gc()


def once(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows, but of several with one id and one text a single one; rows with a null id all stay.

    Repeated (id, text) pairs are found by a count of narrow rows, so only rows that repeat are gathered by
    pair (map-side first), and a table without any is left as it is.
    """
    pair = [F.col(id_col), F.xxhash64(F.lit(41), F.col(text_col)), F.xxhash64(F.lit(43), F.col(text_col))]
    keyed = [c.alias(f"__o{k}") for k, c in enumerate(pair)]
    again = stored(docs.where(F.col(id_col).isNotNull()).groupBy(*keyed).count().where("count > 1").drop("count"), "rows-again")
    if again.isEmpty():
        return docs
    marked = docs.select(F.struct(*docs.columns).alias("__row"), *keyed)
    names = ["__o0", "__o1", "__o2"]
    alone = marked.join(again, names, "left_anti").select("__row")
    first = marked.join(again, names, "left_semi").groupBy(*names).agg(F.first("__row").alias("__row")).select("__row")
    return alone.unionByName(first).select(*[F.col("__row")[c].alias(c) for c in docs.columns])


def with_fields(schema: T.StructType, **kinds: str) -> T.StructType:
    """``schema`` and further nullable columns (name=type)."""
    more = T.StructType.fromDDL(", ".join(f"{name} {kind}" for name, kind in kinds.items()))
    return T.StructType([*schema.fields, *more.fields])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_bucket(id_col: Column, n: int) -> Column:
    """``crc32(id as text) mod n`` (a null id counts as empty text)."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % n


def process_cache(name: str) -> dict:
    """A dict that lives as long as this Python worker process (kernels are unpickled afresh per task)."""
    mod = sys.modules.setdefault("reelspark_process_cache", types.ModuleType("reelspark_process_cache"))
    return mod.__dict__.setdefault(name, {})
