"""Object store inventory (S4) through the ``binaryFile`` source.

Only ``path, length, modificationTime`` are selected, so the scan never
reads object bytes.  ``binaryFile`` skips zero-length files, so "empty" and
"missing" look alike here: readiness (P7) needs an inventory table with
sizes, which this produces for the objects that have bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_objects(df: DataFrame, root: str, *, key: str, body: str, partition: str | None = None) -> None:
    """Write one text object set per partition value (test fixture for the inventory)."""
    out = df.select(F.col(body).alias("value"), *( [F.col(partition)] if partition else []))
    w = out.write.mode("errorifexists")
    if partition:
        w = w.partitionBy(partition)
    w.text(root)


def inventory(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """``key`` (path relative to ``root``), ``size``, ``modified`` for every non-empty object."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", glob).load(root)
             .select("path", "length", "modificationTime"))
    rel = F.regexp_replace(F.col("path"), r"^.*?" + root.rstrip("/").split("/")[-1] + "/", "")
    return files.select(rel.alias("key"), F.col("length").alias("size"),
                        F.col("modificationTime").alias("modified"))
