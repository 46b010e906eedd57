"""The corpus pipeline: quality rules, near-dedup, substring dedup, mixing to target weights, packing.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir), and its result is written as Parquet and read
again as the next one's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm import mixing, near_dedup, packing, quality, substring_dedup
from recollect.llm.common import stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or are outliers of their language and source, go; null texts fail."""
    return quality.keep(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8 or more: of each group the document with the smallest id stays."""
    return near_dedup.keep_one(docs, width=5, similarity=0.8)


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages of 50 words leave the texts; a text of which no word is left goes."""
    kept = substring_dedup.remove_repeats(docs, words=50).where("n_words = 0 or n_removed < n_words")
    return kept.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.length("kept_text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document that is drawn twice is there twice; one of which a part is drawn is cut to it."""
    return mixing.mix(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece of a packed sequence. A document that is there twice is packed twice."""
    return packing.pack(docs, with_ids=False)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup_stage),
    ("substring dedup", substring_dedup_stage),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
