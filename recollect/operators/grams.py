"""Substring search by 4-grams: blocks of texts that lack one of the sought text's grams aren't read."""

from __future__ import annotations

import math
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.batches import Batches

WIDTH = 4
#: Texts of a block, about; folders that grams are dealt to; blocks that are named one by one in a plan, beyond that they are joined.
ROWS, BUCKETS, NAMED = 10_000, 64, 10_000
PARTS = {"texts": ("block",), "grams": ("bucket",)}
#: Matches nothing at each place that ``WIDTH`` characters follow, and holds these: overlapping grams in one pass.
GRAMS = f"(?s)(?=(.{{{WIDTH}}}))"


def grams_of(text: str):
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(GRAMS), F.lit(1)))


def add(store: Batches, batch: str | int, texts: DataFrame, text: str = "text_string", rows_per_block: int = ROWS) -> bool:
    """Take a batch of texts (id, text, other columns) into the index; one that is there already is left alone. Whether it
    was taken. A batch's texts form blocks of their own. Null texts hold nothing; ids aren't replaced, for a text's id is
    its md5. A block's texts meet first, so its grams are found where the texts are, however few the files that hold these."""
    if store.has(batch):
        return False
    number = store.next()
    blocks = max(1, math.ceil(texts.count() / rows_per_block))
    rows = texts.where(F.col(text).isNotNull()).withColumn("block", F.concat(F.lit(f"{number}-"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("string"))).repartition("block")
    grams = rows.select("block", F.explode(grams_of(text)).alias("gram")).distinct()
    grams = grams.withColumn("bucket", (F.crc32(F.col("gram").cast("binary")) % BUCKETS).cast("int"))
    grams = grams.repartition(BUCKETS, "bucket").sortWithinPartitions("bucket", "gram")
    return store.commit(batch, {"texts": rows, "grams": grams}, PARTS)


def candidates(store: Batches, words: str) -> DataFrame | None:
    """(block) of blocks that have all grams of the sought text, in some of their texts; None if it is too short to say."""
    grams = store.spark.range(1).select(grams_of_literal(words)).first()[0]
    if not grams:
        return None
    buckets = sorted({zlib.crc32(g.encode("utf-8", "surrogatepass")) % BUCKETS for g in grams})
    found = store.read("grams").where(F.col("bucket").isin(buckets) & F.col("gram").isin(grams))
    return found.groupBy("block").agg(F.count("*").alias("n")).where(F.col("n") == len(grams)).select("block")


def grams_of_literal(words: str):
    return F.array_distinct(F.regexp_extract_all(F.lower(F.lit(words)), F.lit(GRAMS), F.lit(1)))


def search(store: Batches, words: str, text: str = "text_string") -> DataFrame:
    """Texts that contain the words, without regard to case: exactly those of a scan, from the blocks that can have them."""
    texts, blocks = store.read("texts"), candidates(store, words)
    if blocks is not None:
        named = [r["block"] for r in blocks.limit(NAMED + 1).collect()]
        texts = texts.where(F.col("block").isin(named)) if len(named) <= NAMED else texts.join(blocks, "block", "left_semi")
    return texts.where(F.contains(F.lower(text), F.lower(F.lit(words)))).drop("block")
