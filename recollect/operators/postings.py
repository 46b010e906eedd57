"""An inverted index of texts: stored postings by term, kept up to date by batches, for BM25 without reading the texts."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.batches import Batches
from .texts import WORDS, bm25_weight

#: Folders that terms are dealt to; a query reads those of its terms.
BUCKETS = 64
#: Texts whose postings of a bucket are sorted in one task, about.
TEXTS = 100_000
PARTS = {"postings": ("bucket",)}


def bucket_of(term: str) -> int:
    return zlib.crc32(term.encode()) % BUCKETS


def add(store: Batches, batch: str | int, texts: DataFrame, key: str = "id", text: str = "text_string") -> bool:
    """Take a batch of texts into the index, in place of earlier texts with the same keys; one that is there already is left
    alone. Whether it was taken. Null texts have no words; of several with one key in a batch the largest counts.

    A batch writes its own postings; those that it replaces are named by key and number, not rewritten, until ``compact``.
    """
    if store.has(batch):
        return False
    number = store.next()
    t = texts.groupBy(F.col(key).alias("id")).agg(F.max(text).alias("text"))
    t = t.select("id", F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), WORDS), lambda w: w != "").alias("w")).withColumn("length", F.size("w"))
    rows = t.select("id", "length", F.explode("w").alias("term")).groupBy("term", "id", "length").agg(F.count("*").alias("n"))
    rows = rows.select((F.crc32(F.col("term").cast("binary")) % BUCKETS).cast("int").alias("bucket"), "term", "id", "n", "length", F.lit(number).alias("batch"))
    documents = t.select("id", "length", F.lit(number).alias("batch"))
    held = live_documents(store.read("documents", documents.schema)).join(documents.select("id"), "id", "left_semi")
    replaced = held.select("id", F.lit(number).alias("batch"))
    added, gone = (d.agg(F.count("*").alias("texts"), F.coalesce(F.sum("length"), F.lit(0)).alias("words")) for d in (documents, held))
    totals = added.unionByName(gone.select((-F.col("texts")).alias("texts"), (-F.col("words")).alias("words")))
    rows = dealt(rows, texts.count())
    return store.commit(batch, {"postings": rows, "documents": documents, "replaced": replaced, "totals": totals}, PARTS)


def dealt(rows: DataFrame, texts: int) -> DataFrame:
    """Postings sorted within tasks, so that row groups have few terms. A bucket's rows form one file a batch, or more where
    the batch has many texts: a task has those of about ``TEXTS`` texts, and a frequent word is dealt to several."""
    pieces = max(1, -(-texts // TEXTS))
    own = rows.withColumn("_piece", F.pmod(F.xxhash64("id"), F.lit(pieces)))
    return own.repartition(BUCKETS * pieces, "bucket", "_piece").sortWithinPartitions("bucket", "term", "id").drop("_piece")


def live_documents(documents: DataFrame) -> DataFrame:
    return documents.groupBy("id").agg(F.max_by("length", "batch").alias("length"), F.max("batch").alias("batch"))


def live_postings(postings: DataFrame, replaced: DataFrame) -> DataFrame:
    """Postings of texts that no later batch has replaced."""
    last = replaced.groupBy("id").agg(F.max("batch").alias("_last"))
    return postings.join(last, "id", "left").where("_last is null or batch >= _last").select(*postings.columns)


def search(store: Batches, query: str, limit: int | None = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score): as ``texts.bm25`` of all texts of the index. Only the folders of the query's terms are read, and the
    few numbers of all texts and of each term."""
    words = sorted(set(query.lower().split()))
    postings = store.read("postings").where(F.col("bucket").isin([bucket_of(w) for w in words]) & F.col("term").isin(words))
    found = live_postings(postings, store.read("replaced")) if words else postings
    totals = store.read("totals").agg(F.sum("texts").alias("texts"), (F.sum("words") / F.sum("texts")).alias("mean"))
    frequent = found.groupBy("term").agg(F.count("*").alias("df"))  # a row a word of the query
    rows = found.join(F.broadcast(frequent), "term").crossJoin(F.broadcast(totals))
    scored = rows.groupBy("id").agg(F.sum(bm25_weight("texts", "df", "n", "length", "mean", k1, b)).alias("score")).where("score > 0")
    return scored if limit is None else scored.orderBy(F.desc("score"), "id").limit(limit)


def compact(store: Batches) -> None:
    """The index of the texts that count, in one file a bucket."""
    postings, replaced = store.read("postings"), store.read("replaced")
    documents = live_documents(store.read("documents"))
    rows = dealt(live_postings(postings, replaced), documents.count())
    totals = store.read("totals").agg(F.sum("texts").alias("texts"), F.sum("words").alias("words"))
    store.commit(f"compact-{store.next()}", {"postings": rows, "documents": documents, "replaced": replaced.limit(0), "totals": totals}, PARTS, whole=True)
