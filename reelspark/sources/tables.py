"""Readers for the supplied tables and schemas of the service's own tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

TEST_TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
               "lineitem", "events", "documents", "embeddings", "pages",
               "benchmark", "labels", "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan; column pruning and filter push-down are left to Catalyst."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [read_table(spark, sf_dir, n) for n in names]


def _s(*fields):
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


S, B, L, I, BOOL = T.StringType(), T.LongType(), T.LongType(), T.IntegerType(), T.BooleanType()
TS, NTZ = T.TimestampType(), T.TimestampNTZType()

# Service tables as Spark schemas (nullable flag third).
USERS = _s(("id", S, False), ("username", S, False), ("fullname", S, True),
           ("email", S, False), ("password_hash", S, True), ("is_verified", BOOL, True),
           ("role", S, True), ("created_at", NTZ, True), ("updated_at", NTZ, True),
           ("deleted_at", NTZ, True))
VERIFIER = _s(("id", B, False), ("user_id", S, False), ("token_hash", S, False),
              ("created_at", TS, False), ("expire_at", TS, False))
RESETER = _s(*[(f.name, f.dataType, f.nullable) for f in VERIFIER.fields], ("used", BOOL, False))
PROFILES = _s(("id", B, False), ("user_id", S, False), ("profile_pic", S, True),
              ("created_at", TS, False), ("updated_at", NTZ, True))
QUOTA = _s(("id", B, False), ("user_id", S, False), ("used_bytes", I, True),
           ("total_bytes", I, True), ("gif_count", I, True), ("gif_limit", I, True))
ANON_USERS = _s(("id", S, False), ("username", S, False), ("fullname", S, True),
                ("role", S, True), ("created_at", NTZ, True), ("updated_at", NTZ, True),
                ("deleted_at", NTZ, True))
LAST_UPLOAD = _s(("id", B, False), ("user_id", S, False), ("file_key", S, False),
                 ("file_name", S, True), ("content_type", S, False), ("size_bytes", B, True),
                 ("duration_sec", T.DecimalType(10, 3), True), ("uploaded_at", TS, False),
                 ("thumbnail_url", S, True), ("deleted_at", TS, True), ("updated_at", TS, True))
GIFS = _s(("key", S, False), ("user_id", S, False), ("status", S, False),
          ("persist", BOOL, False), ("download", I, False), ("created_at", TS, False),
          ("updated_at", TS, False), ("url", S, False), ("thumbnail_url", S, True),
          ("name", S, True))
SHARES = _s(("id", S, False), ("gif_key", S, True), ("owner_id", S, True),
            ("token", S, False), ("access", S, False), ("expires_at", TS, True),
            ("created_at", TS, True))
