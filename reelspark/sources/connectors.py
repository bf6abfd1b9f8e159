"""Readers for the service's other stores, in their Spark form.

* relational tables: ``read_jdbc`` - a partitioned JDBC scan (one range of
  the partition column per task), never a single-connection read;
* queues: ``message_files`` (JSON lines dropped into a folder, one file per
  batch of messages) or ``kafka_messages`` when the Kafka connector is on the
  classpath (it is not in this image, so that reader fails with a clear
  message instead of at query time).

None of these needs a server in the tests: the queue readers are exercised
with files, and JDBC needs a database reachable by the cluster.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_jdbc(spark: SparkSession, url: str, table: str, *, partition_column: str, lower: int | None = None, upper: int | None = None,
              num_partitions: int, properties: dict | None = None) -> DataFrame:
    """Partitioned JDBC read: ``num_partitions`` parallel range scans of ``partition_column``.

    With ``lower`` and ``upper`` the column is a number.  Without them it is a UUID (or its text): the scans are
    :func:`uuid_ranges` of it, which need no statistics because random UUIDs spread evenly.
    """
    if lower is None or upper is None:
        return spark.read.jdbc(url, table, predicates=uuid_ranges(partition_column, num_partitions), properties=properties or {})
    return spark.read.jdbc(url, table, column=partition_column, lowerBound=lower, upperBound=upper,
                           numPartitions=num_partitions, properties=properties or {})


def uuid_ranges(column: str, n: int) -> list[str]:
    """``n`` conditions that split all UUIDs of a column into equal ranges; nulls are in the first, and each row meets one."""
    cuts = [str(uuid.UUID(int=(k << 128) // n)) for k in range(1, n)]
    if not cuts:
        return ["1 = 1"]
    middle = [f"{column} >= '{a}' AND {column} < '{b}'" for a, b in zip(cuts, cuts[1:])]
    return [f"{column} < '{cuts[0]}' OR {column} IS NULL", *middle, f"{column} >= '{cuts[-1]}'"]


def message_files(spark: SparkSession, path: str, *, queue: str, stream: bool = True,
                  max_files_per_trigger: int = 1) -> DataFrame:
    """Queue messages stored as JSON lines: columns ``queue, body`` (decode with ``messages.decode``)."""
    if stream:
        df = spark.readStream.option("maxFilesPerTrigger", max_files_per_trigger).text(path)
    else:
        df = spark.read.text(path)
    return df.select(F.lit(queue).alias("queue"), F.col("value").alias("body"))


def kafka_available(spark: SparkSession) -> bool:
    jvm = spark.sparkContext._jvm
    try:
        jvm.java.lang.Class.forName("org.apache.spark.sql.kafka010.KafkaSourceProvider")
        return True
    except Exception:  # noqa: BLE001
        return False


def kafka_messages(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """A queue as a Kafka topic: ``queue, body, published_at`` (streaming)."""
    if not kafka_available(spark):
        raise RuntimeError("the Kafka connector is not on the classpath; use message_files instead")
    df = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
          .option("subscribe", topic).load())
    return df.select(F.col("topic").alias("queue"), F.col("value").cast("string").alias("body"),
                     F.col("timestamp").alias("published_at"))
