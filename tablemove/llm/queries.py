"""One query opN_<name> per operator: the operator on its whole table, and the digest columns of its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemove.session import scratch_path

from .byte_bpe import decode_ids, encode_texts, ids_text
from .common import read_table
from .flat_graph import near_dedup
from .html_text import extract_text
from .lexical_rank import rank_documents
from .maxscore import top_k
from .mixing import curriculum, in_order
from .ngram_join import jaccard_join
from .oracles import ORACLES  # noqa: F401  SQL of the queries that have any
from .packing import pack_documents
from .pii import BASE_KINDS, find_pii
from .quality import THRESHOLD, held_out, score_quality
from .substring import substring_dedup
from .target_resampling import resample
from .token_store import read_tokens, write_tokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score_quality(docs, read_table(spark, sf_dir, "labels"))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), F.col("quality_score").alias("score"),
                      (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"))


@query
def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = write_tokens(read_table(spark, sf_dir, "documents"), scratch_path(spark, "llm", "tokens"))
    return read_tokens(spark, out).select(F.col("id").alias("doc_id"), "start", F.expr("octet_length(ids) DIV 4").alias("n_tokens"),
                                          F.crc32("ids").alias("ids_crc32"))


@query
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack_documents(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


@query
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


@query
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = curriculum(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    out = in_order(out.drop("text"))
    return out.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"),
                      F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken"),
                      F.col("mix_first").alias("position"))


@query
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_pii(read_table(spark, sf_dir, "documents"))
    joined = lambda of: F.expr(f"array_join(transform({of}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')")
    base = f"filter(spans, s -> s.kind IN {BASE_KINDS})"
    counts = [F.expr(f"CAST(size(filter(spans, s -> s.kind = '{k}')) AS bigint)").alias(f"n_{k}") for k in BASE_KINDS]
    return out.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined("spans").alias("spans"))


@query
def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_text(read_table(spark, sf_dir, "pages"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


@query
def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read_table(spark, sf_dir, "embeddings"))


@query
def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(read_table(spark, sf_dir, "embeddings"))


@query
def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(read_table(spark, sf_dir, "documents"))


@query
def op11_lexical_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@query
def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decode_ids(ids_text(encode_texts(read_table(spark, sf_dir, "documents"))))
    return out.select("doc_id", F.expr("CAST(octet_length(ids) DIV 4 AS bigint)").alias("n_tokens"),
                      F.sha2("ids_text", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op12_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
