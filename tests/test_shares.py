"""Postings of many texts are dealt to several tasks a bucket."""

from pyspark.sql import functions as F
from recollect.operators import postings
from recollect.sources.batches import Batches, shared_folder


def test_frequent_words_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(postings, "TEXTS", 50)
    texts = spark.range(400).select("id", F.concat(F.lit("data of "), F.col("id")).alias("text_string"))
    store, plain = Batches(spark, shared_folder(spark, "postings")), Batches(spark, shared_folder(spark, "postings"))
    postings.add(store, 0, texts)
    rows = store.read("postings").where("term = 'data'")
    assert rows.count() == 400 and rows.select(F.input_file_name()).distinct().count() > 4
    monkeypatch.setattr(postings, "TEXTS", 10**6)
    postings.add(plain, 0, texts)
    found, want = ({r["id"]: round(r["score"], 9) for r in postings.search(s, "data 7", None).collect()} for s in (store, plain))
    assert found == want and len(found) == 400
    monkeypatch.setattr(postings, "TEXTS", 50)
    postings.compact(store)
    assert {r["id"]: round(r["score"], 9) for r in postings.search(store, "data 7", None).collect()} == want
