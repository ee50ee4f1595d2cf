"""A corpus pipeline: quality, near duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame; stages but the last
return the columns of ``documents``.  ``run`` writes each stage's result as Parquet
below the shared checkpoint folder and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemove.llm.common import materialize, read_table
from tablemove.llm.mixing import mix
from tablemove.llm.ngram_join import jaccard_groups
from tablemove.llm.packing import pack_documents
from tablemove.llm.pii import redact
from tablemove.llm.quality import THRESHOLD, score_quality

SHINGLE_WORDS, SIMILARITY_PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    scored = score_quality(docs, read_table(spark, sf_dir, "labels"))
    return scored.where(F.col("quality_score") >= THRESHOLD).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts linked by word shingles: the one with the smallest id, then hash of its text,
    then columns in their order.  Texts without words are linked with nothing: of equal ids one stays.
    Texts of different groups stay though their ids be equal; rows with a null id all stay."""
    groups = jaccard_groups(docs, size=SHINGLE_WORDS, percent=SIMILARITY_PERCENT).where("doc_id IS NOT NULL")
    first = groups.where("group IS NOT NULL").groupBy("group").agg(F.min(F.struct("doc_id", "text_hash")).alias("k")).select("k.*")
    keep = first.unionByName(groups.where("group IS NULL").select("doc_id", "text_hash")).distinct()
    rows = docs.withColumn("text_hash", F.xxhash64("text")).join(keep.withColumnsRenamed({"doc_id": "keep_id", "text_hash": "keep_hash"}),
                                                                 (F.col("doc_id") == F.col("keep_id")) & (F.col("text_hash") == F.col("keep_hash")), "left_semi")
    kept = rows.groupBy("doc_id", "text_hash").agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return kept.unionByName(docs.where("doc_id IS NULL"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind; n_chars follows the text."""
    return redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in training order; a document taken twice is two rows."""
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document: its token ids and their place in a training sequence."""
    return pack_documents(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("personal_data", personal_data),
          ("mixing", mixing), ("packing", packing)]

#: A trained classifier has no SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
