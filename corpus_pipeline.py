"""Corpus preparation: five stages, each one of the subpackage's operators, from ``documents`` to packed sequences.

Every stage is ``(spark, docs, sf_dir) -> DataFrame``; its result is written as Parquet and read again as
the next one's ``docs``.  All but the last return the columns of ``documents``.  Each stage first lets go of
what the driver still holds of those before it (:func:`release`), so that the driver's memory does not add up over stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.llm.common import release, stored
from reelspark.llm.langid import language_id, training_rows
from reelspark.llm.lines import drop_duplicate_lines
from reelspark.llm.minhash import drop_near_duplicates
from reelspark.llm.mixing import poisson_mix
from reelspark.llm.packing import pack_best_fit
from reelspark.llm.queries import tokenizer_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found go on, with ``lang`` as found; rejected ones go."""
    release(spark)
    found = language_id(docs, training_rows()).where("NOT lang_rejected")
    return found.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line matches go; so do documents of which no line is left."""
    release(spark)
    return with_size(drop_duplicate_lines(docs))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the least id."""
    release(spark)
    return drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources get equal shares of the text; documents come as often as drawn, in a global hash order."""
    release(spark)
    return poisson_mix(docs).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in sequences of 4096 tokens."""
    release(spark)
    return pack_best_fit(docs, tokenizer_path())


def with_size(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


STAGES = [
    ("language ID", identify_language),
    ("line dedup", dedup_lines),
    ("MinHash near-dedup", dedup_documents),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Language identification and tokenization cannot be said in SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
