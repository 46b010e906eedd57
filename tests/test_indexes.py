"""Stored indexes against the scans they stand for, and what they read."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from recollect.operators import cells, grams, postings, reads, texts
from recollect.sources.batches import Batches

TEXT = "id long, text_string string"


def scores(df):
    return {r["id"]: round(r["score"], 9) for r in df.collect()}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def some_texts(spark):
    said = ["a license of data", "data data data", None, "", "The Data-licence, license!", "été license", "nothing here", "data " * 50]
    return spark.createDataFrame([(i, said[i % len(said)] + f" w{i}" if said[i % len(said)] else said[i % len(said)]) for i in range(40)], TEXT)


def test_postings_score_as_a_scan(spark, tmp_path, some_texts):
    store = Batches(spark, str(tmp_path / "s"))
    older = some_texts.where("id < 30").withColumn("text_string", F.when(F.col("id") % 2 == 0, "license data older").otherwise(F.col("text_string")))
    assert postings.add(store, 0, older) and not postings.add(store, 0, older)
    assert scores(postings.search(store, "data license", None)) == scores(texts.bm25(older, "data license", limit=None))
    assert postings.add(store, 1, some_texts.where("id >= 30 or id % 2 = 0")) and postings.add(store, 2, some_texts.where("id < 4"))
    for query in ("data license", "été", "w7 w8 nowhere", "nowhere", ""):
        assert scores(postings.search(store, query, None)) == scores(texts.bm25(some_texts.na.fill(""), query, limit=None)), query
    best = postings.search(store, "data license", 5)
    want = [r["id"] for r in texts.bm25(some_texts.na.fill(""), "data license", limit=5).collect()]
    assert [r["id"] for r in best.collect()] == want
    postings.compact(store)
    assert scores(postings.search(store, "data license", None)) == scores(texts.bm25(some_texts.na.fill(""), "data license", limit=None))
    assert store.read("replaced").count() == 0


def test_postings_read_the_terms_folders_alone(spark, tmp_path, some_texts):
    store = Batches(spark, str(tmp_path / "s"))
    postings.add(store, 0, some_texts)
    found = postings.search(store, "data")
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ = " + str(postings.bucket_of("data")), plan_of(found).replace("(", "").replace(" IN ", " = ").replace("INSET", "=")), plan_of(found)
    read = store.read("postings").where(F.col("bucket") == postings.bucket_of("data"))
    assert len(read.select(F.input_file_name()).distinct().collect()) == 1 < len(store.read("postings").inputFiles())


def test_cells_find_what_a_scan_finds(spark, tmp_path):
    rng = np.random.default_rng(1)
    middles = rng.normal(size=(12, 16))
    x = middles[rng.integers(0, 12, 1500)] + 0.15 * rng.normal(size=(1500, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, x[7].tolist())]
    every = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    store = Batches(spark, str(tmp_path / "s"))
    assert cells.add(store, 0, every.where("vec_id < 1000")) and cells.add(store, 1, every.where("vec_id >= 1000")) and not cells.add(store, 1, every)
    usable = every.where("vec_id < 1500 or vec_id = 2003")
    total = len(store.read("bounds").select("cell").distinct().collect())
    for n in (0, 7, 900):
        query = x[n].tolist()
        for least, k in ((0.7, 10), (-1.0, 30), (0.999, 5)):
            want = reads.similar(usable, query, k, least).collect()
            got = cells.search(store, query, k, least).collect()
            assert [(r["id"], round(r["similarity"], 9)) for r in got] == [(r["vec_id"], round(r["similarity"], 9)) for r in want]
        assert len(cells.plan(store, query, 10, 0.7, None)) < total / 2 and len(cells.plan(store, query, 10, 0.7, 3)) == 3
    assert re.search(r"PartitionFilters: \[[^\]]*cell", plan_of(cells.search(store, x[0].tolist())))
    found = cells.search_many(store, usable.where("vec_id % 50 = 0"), 10, 6).collect()
    exact = {q: {r["vec_id"] for r in reads.similar(usable, x[q].tolist(), 10, -1.0).collect()} for q in range(0, 1500, 250)}
    hits = sum(r["id"] in exact[r["query"]] for r in found if r["query"] in exact)
    assert hits >= 0.95 * 10 * len(exact) and len(found) == 300
    with pytest.raises(KeyError):
        cells.search(Batches(spark, str(tmp_path / "none")), x[0].tolist())


def test_grams_find_what_a_scan_finds(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(str(i), " ".join("".join(rng.choice(list("abcdé"), 3)) for _ in range(30)) + (f" Needle-{i}" if i % 50 == 0 else ""), i) for i in range(600)]
    rows += [("n", None, 1), ("e", "", 2), ("s", "ab", 3), ("x", "😀😀 smile\nNEW line\x00", 4)]
    texts_ = spark.createDataFrame(rows, "id string, text_string string, k long")
    store = Batches(spark, str(tmp_path / "s"))
    assert grams.add(store, 0, texts_.where("k < 300"), rows_per_block=20) and grams.add(store, 1, texts_.where("k >= 300"), rows_per_block=20) and not grams.add(store, 1, texts_)
    for words in ("needle-100", "Needle-5", "abc", "b", "", "dé a", "😀 smile", "smile\nnew", "not there at all", "\x00", "nEeD"):
        want = {r["id"] for r in texts_.where(F.contains(F.lower("text_string"), F.lower(F.lit(words)))).collect()}
        got = grams.search(store, words)
        assert {r["id"] for r in got.collect()} == want and got.columns == ["id", "text_string", "k"], words
    read = {p.rsplit("/", 2)[1] for p in grams.search(store, "needle-100").select(F.input_file_name()).distinct().toPandas().iloc[:, 0]}
    blocks = {p.split("block=")[1].split("/")[0] for p in store.read("texts").inputFiles()}
    assert len(read) <= 2 and len(blocks) > 25
    assert re.search(r"PartitionFilters: \[[^\]]*block", plan_of(grams.search(store, "needle-100")))
