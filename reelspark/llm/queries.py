"""The named queries of this subpackage over the supplied tables, and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .audit import ORACLE as AUDIT_ORACLE
from .audit import filter_audit
from .common import id_bucket
from .extract import extract_main_text
from .fim import ORACLE as FIM_ORACLE
from .fim import digests, fill_in_middle
from .langid import language_id, training_rows
from .lines import ORACLE as LINE_ORACLE
from .lines import duplicate_lines
from .lm import held_out, score_documents
from .minhash import near_duplicates
from .mixing import oracle as mixing_oracle
from .mixing import poisson_mix
from .packing import pack_best_fit
from .substrings import ORACLE as SUBSTRING_ORACLE
from .substrings import remove_repeated_passages
from .topk import ORACLE as TOPK_ORACLE
from .topk import exact_top_k
from .toxicity import score_toxicity
from .vectors import ORACLE as VECTOR_ORACLE
from .vectors import near_duplicate_vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public vocabulary file lies on every machine."""
    import public_tokenizers
    return public_tokenizers.path(name)


@register("op1_line_dedup", LINE_ORACLE)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_lines(table(spark, sf_dir, "documents"))


@register("op2_histogram_topk", TOPK_ORACLE)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@register("op3_probminhash_neardup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


@register("op4_hmm_lm")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), ~held_out()).withColumn("held_out", held_out())


@register("op5_difference_cover_dedup", SUBSTRING_ORACLE)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_passages(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@register("op6_compression_langid")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language_id(docs, training_rows()).select(
        "doc_id", (~training_rows()).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), "lang_rejected")


@register("op7_subspace_pigeonhole", VECTOR_ORACLE)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


@register("op8_best_fit_packing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_best_fit(table(spark, sf_dir, "documents"), tokenizer_path())


@register("op9_poisson_mixing", mixing_oracle() + """
SELECT doc_id, text, lang, source, n_chars, copies::INT AS mix_copies, j::INT AS mix_copy, rate AS mix_rate,
  ('0x' || substr(md5('mix-order:' || coalesce(doc_id::VARCHAR, 'null') || ':' || j), 1, 15))::BIGINT AS mix_key
FROM copies""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poisson_mix(table(spark, sf_dir, "documents"))


@register("op10_fm_toxicity")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = id_bucket(F.col("doc_id"), 5) == 0
    return score_toxicity(docs, table(spark, sf_dir, "labels"), ~held_out).select(
        "doc_id", held_out.alias("held_out"), F.col("tox_score").alias("score"), F.col("tox_predicted").alias("predicted"))


@register("op11_displacement_fim", FIM_ORACLE)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text")))


@register("op12_boosted_dom")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_main_text(pages).select("page_id", "url", F.col("main_text").alias("text"), F.col("main_chars").alias("n_chars"))


@register("op13_filter_audit", AUDIT_ORACLE)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"))
