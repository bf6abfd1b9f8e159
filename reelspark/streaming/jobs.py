"""Deployable stream jobs: a folder queue in, exactly-once parquet out.

Each job reads new files from ``source`` (``maxFilesPerTrigger`` bounds a
micro-batch), applies the operator, and writes with the parquet sink, whose
commit log plus the checkpoint make the output exactly-once across restarts
and lost executors.  Checkpoints default to a sub-folder of the shared
``spark.checkpoint.dir``.

    python -m reelspark.streaming.jobs admission <source> <sink> [checkpoint]
    python -m reelspark.streaming.jobs mail <source> <sink> [checkpoint]
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from ..operators.ratelimit import token_bucket_stream
from ..session import get_session, shared_path
from ..sources.connectors import message_files
from .flows import mail_route_stream

REQUESTS = T.StructType([T.StructField("request_id", T.LongType()), T.StructField("client", T.LongType()),
                         T.StructField("ts", T.TimestampNTZType())])


def admission_job(spark: SparkSession, source: str, sink: str, checkpoint: str | None = None, *,
                  schema: T.StructType = REQUESTS, key: str = "client", ts: str = "ts", id_col: str = "request_id",
                  available_now: bool = False, **bucket):
    """Token-bucket decisions for every request file dropped into ``source``."""
    reqs = spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(source)
    out = token_bucket_stream(reqs, key=key, ts=ts, id_col=id_col, **bucket)
    w = (out.writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", checkpoint or shared_path(spark, "admission-ckpt", keep=True))
         .option("path", sink))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def mail_job(spark: SparkSession, source: str, sink: str, checkpoint: str | None = None, *,
             available_now: bool = False):
    """Decode and route JSON-lines mail messages; output partitioned by target queue."""
    routed = mail_route_stream(message_files(spark, source, queue="email.queue", max_files_per_trigger=8))
    w = (routed.drop("msg").writeStream.format("parquet").outputMode("append").partitionBy("queue")
         .option("checkpointLocation", checkpoint or shared_path(spark, "mail-ckpt", keep=True))
         .option("path", sink))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def main(argv: list[str]) -> None:
    kind, source, sink = argv[:3]
    checkpoint = argv[3] if len(argv) > 3 else None
    spark = get_session()
    job = {"admission": admission_job, "mail": mail_job}[kind]
    job(spark, source, sink, checkpoint).awaitTermination()


if __name__ == "__main__":
    main(sys.argv[1:])
