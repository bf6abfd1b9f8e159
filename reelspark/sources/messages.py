"""Queue messages: JSON decode with rejection (S2) and encode for publishing (S3).

A queue is a column: batch inputs are tables of ``(queue, body, ...)``; a
stream is the same shape from a file or Kafka source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The message shapes of the service.
MAIL = T.StructType([T.StructField("to", T.StringType()), T.StructField("name", T.StringType()),
                     T.StructField("token", T.StringType())])
CONVERSION = T.StructType([T.StructField("user_id", T.StringType()), T.StructField("job_id", T.StringType()),
                           T.StructField("upload_key", T.StringType()),
                           T.StructField("start_time", T.FloatType()), T.StructField("end_time", T.FloatType()),
                           T.StructField("width", T.IntegerType()), T.StructField("fps", T.IntegerType()),
                           T.StructField("loop", T.BooleanType()), T.StructField("retries", T.IntegerType())])
UPLOAD = T.StructType([T.StructField("key", T.StringType()), T.StructField("user_id", T.StringType()),
                       T.StructField("filename", T.StringType()), T.StructField("retries", T.IntegerType())])

def _fits(kind: Column, value: Column, want: T.DataType) -> Column:
    """Whether a JSON value of this kind may go into a field of this type."""
    if isinstance(want, T.StringType):
        return kind == "STRING"
    if isinstance(want, T.BooleanType):
        return kind == "BOOLEAN"
    if isinstance(want, T.IntegralType):
        return (kind == "BIGINT") & F.try_variant_get(value, "$", want.simpleString()).isNotNull()
    return kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")


def decode(df: DataFrame, body: str, schema: T.StructType, out: str = "msg") -> DataFrame:
    """Decode JSON bodies; add ``out`` (struct) and ``valid``.

    Invalid = not one JSON value with nothing after it but white space, not an object (``null`` is an empty one), or a top-level
    field of the wrong type (a number where the record has a text, a fraction where it has a whole number) at any of
    its places.  Field names match whatever their case, and of repeated ones the last that is not null counts; ``{}``, nulls and
    unknown extra fields are valid, as in the service (but for one that holds an object which itself repeats a
    name: Spark's parser refuses it).  Invalid messages are rejected without requeue.

    The body is parsed once, as a member of an object that ends in a hash of the body: a parser stops after the first
    value, so only a body that is one value lets it reach that end.  The entries of known fields are named in lower case once.
    """
    text = F.col(body).cast("string")
    mark = F.xxhash64(text)
    whole = F.from_json(F.concat(F.lit('{"body":'), text, F.lit(',"end":'), mark.cast("string"), F.lit("}")),
                        "body map<string,variant>, end bigint")
    kinds = {f.name.lower(): f.dataType for f in schema.fields}
    named = F.transform(F.map_entries("__json.body"), lambda e: F.struct(F.lower(e["key"]).alias("k"), e["value"].alias("v")))
    known = F.filter(named, lambda e: e["k"].isin(list(kinds)) & ~F.is_variant_null(e["v"]))

    def wrong(e: Column) -> Column:
        kind, test = F.schema_of_variant(e["v"]), F.lit(False)
        for name, want in kinds.items():
            test = F.when(e["k"] == name, ~F.coalesce(_fits(kind, e["v"], want), F.lit(False))).otherwise(test)
        return test
    df = df.withColumn("__json", whole).withColumn("__known", known).withColumn("__names", F.reverse("__known.k"))
    nothing = F.btrim(text, F.lit(" \t\r\n")) == "null"
    one = F.coalesce(F.col("__json.end") == mark, F.lit(False)) & (F.col("__json.body").isNotNull() | nothing)
    df = df.withColumn("valid", one & ~F.coalesce(F.exists("__known", wrong), F.lit(False)))

    def value(f: T.StructField) -> Column:
        at = F.array_position("__names", f.name.lower())            # counted from the end
        return F.when(F.col("valid") & (at > 0), F.try_variant_get(F.element_at("__known.v", (-at).cast("int")), "$", f.dataType.simpleString()))
    return df.withColumn(out, F.struct(*[value(f).alias(f.name) for f in schema.fields])).drop("__json", "__known", "__names")


def encode(df: DataFrame, fields: dict[str, Column], queue: str, ts: Column | None = None) -> DataFrame:
    """``to_json`` of the given fields as the body, with the queue and publish time."""
    body = F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))
    cols = [F.lit(queue).alias("queue"), body.alias("body")]
    if ts is not None:
        cols.append(ts.alias("published_at"))
    return df.select("*", *cols)


def publish(encoded: DataFrame, root: str) -> None:
    """Append encoded messages to a folder of queues (``queue=<name>/``), the shape the file sources read."""
    encoded.select("queue", "body").write.mode("append").partitionBy("queue").text(root)


def publish_stream(encoded: DataFrame, root: str, checkpoint: str):
    """The same from a stream, each message once: the file sink's log names the files of finished batches only, and
    Spark's readers of ``root`` go by it, so a batch that is written again after a failure replaces what it left."""
    return (encoded.select("queue", "body").writeStream.format("text").partitionBy("queue").outputMode("append")
            .option("checkpointLocation", checkpoint).option("path", root))


def publish_sink(root: str):
    """A ``foreachBatch`` function that publishes each micro-batch once, as a folder of its own (``batch=<id>/queue=<name>/``).

    For jobs that write several outputs a batch.  A batch whose folder is complete is skipped, so a replay publishes
    nothing twice; a folder that an attempt left half-written is written anew.  Read with :func:`published`.
    """
    def apply(batch: DataFrame, batch_id: int) -> None:
        target = f"{root.rstrip('/')}/batch={batch_id:012d}"
        if not complete(batch.sparkSession, target):
            batch.select("queue", "body").write.mode("overwrite").partitionBy("queue").text(target)
    return apply


def complete(spark: SparkSession, folder: str) -> bool:
    """Whether a folder has been written to its end."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def published(spark: SparkSession, root: str) -> DataFrame:
    """``batch, queue, body`` of all messages in complete batches of :func:`publish_sink`."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(st.getPath().getName() for st in fs.listStatus(path)) if fs.exists(path) else []
    done = [f"{root.rstrip('/')}/{n}" for n in names if n.startswith("batch=") and complete(spark, f"{root.rstrip('/')}/{n}")]
    schema = "body string, batch long, queue string"
    if not done:
        return spark.createDataFrame([], schema).select("batch", "queue", "body")
    return spark.read.schema(schema).option("basePath", root).format("text").load(done).select("batch", "queue", "body")
