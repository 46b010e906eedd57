"""Batches over several tables: seen whole or not at all, taken once, the same as all rows at once."""

from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from recollect.operators import ingest, stitching
from recollect.sources import tables
from recollect.sources.batches import Batches, latest_of
from recollect.streaming import pipelines


def obs(number, day, name, consent=None, observer="me", label="met"):
    entities = {"me": {"kind": "Person", "id": str(number), "traits": {"name": name, "text": f"I am {name}", "mail": f"{name}@x.org"}}, "it": {"kind": "thing", "id": "9", "traits": None}}
    relation = [{"label": label, "ts": None, "actor": "me", "objects": ["it"], "traits": None}, {"label": "slept", "ts": None, "actor": "me", "objects": None, "traits": None}]
    return (f"o{number}", datetime(2024, 1, day), "l", observer, "s", "x", consent, entities, relation)


ROWS = [obs(1, 1, "ann"), obs(1, 3, "anna"), obs(2, 2, "bob"), obs(3, 2, "eve", consent=False), obs(4, 1, "joe", observer="nobody"), obs(2, 5, "bob", label="left"), obs(5, 4, "ann")]
IDENTIFYING = {"person": ("mail",)}


@pytest.fixture
def made(spark):
    return spark.createDataFrame(ROWS, ingest.OBSERVATION), spark.createDataFrame([("met", 60, "remind")], "rel_label string, timeout int, event string")


def plain(df: DataFrame) -> Counter:
    return Counter(str(r) for r in df.select(*sorted(df.columns)).collect())


def check(store, whole, due):
    for name, want in pipelines.ingest_tables(whole, IDENTIFYING, due).items():
        assert plain(pipelines.read(store, name)) == plain(pipelines.MERGES.get(name, lambda rows: rows)(want)), name


def test_stream_equals_all_at_once(spark, tmp_path, made):
    whole, due = made
    schema = whole.schema
    for n in range(2):  # two files, a micro-batch each
        spark.createDataFrame(ROWS[n::2], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = tables.json_stream(spark, str(tmp_path / "in"), ingest.OBSERVATION, files_per_trigger=1)
    q = pipelines.start_ingest(stream, str(tmp_path / "out"), str(tmp_path / "cp"), True, IDENTIFYING, due)
    assert q.awaitTermination(300)
    store = Batches(spark, str(tmp_path / "out"))
    assert len(store.log()) == 2
    check(store, whole, due)
    identities = {r["identity"]: r["traits"] for r in stitching.view(store).collect()}
    assert any(t.get("name") == "anna" for t in identities.values()) and len(identities) == 4  # ann twice is one, for they share a mail
    pipelines.compact(store)
    check(store, whole, due)
    assert identities == {r["identity"]: r["traits"] for r in stitching.view(store).collect()}
    assert sum(store.vacuum(name) for name in pipelines.MERGES) == 2 * len(pipelines.MERGES)
    check(store, whole, due)
    assert plain(pipelines.read(store, "refused").select("reason")) == Counter({"Row(reason='no consent')": 1, "Row(reason='unknown observer')": 1})


def test_batch_that_dies_between_two_tables(spark, tmp_path, made):
    whole, due = made
    store = Batches(spark, str(tmp_path / "out"))
    assert pipelines.take(store, 0, spark.createDataFrame(ROWS[:3], whole.schema), IDENTIFYING, due)
    before = {name: plain(pipelines.read(store, name)) for name in pipelines.MERGES}
    rest = spark.createDataFrame(ROWS[3:], whole.schema)
    broken = pipelines.ingest_tables(rest, IDENTIFYING, due)
    broken["timers"] = broken["timers"].withColumn("event", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        store.commit(1, broken)
    assert not store.has(1) and {name: plain(pipelines.read(store, name)) for name in pipelines.MERGES} == before
    assert pipelines.take(store, 1, rest, IDENTIFYING, due) and not pipelines.take(store, 1, rest, IDENTIFYING, due)
    check(store, whole, due)
    assert store.vacuum("facts") == 1  # the dead attempt's


def test_tables_of_a_store(spark, tmp_path):
    store = Batches(spark, str(tmp_path / "s"))
    assert store.log() == [] and store.read("t", "k long").count() == 0
    with pytest.raises(KeyError):
        store.read("t")
    rows = spark.range(10).withColumn("k", F.col("id") % 3)
    assert store.commit("a", {"t": rows, "none": rows.limit(0)}, {"t": ("k",)}) and not store.commit("a", {"t": rows})
    store.commit("b", {"t": rows.withColumn("more", F.lit("x"))}, {"t": ("k",)})
    assert store.read("t").columns == ["id", "k", "more"] and store.read("t").where("more is null").count() == 10 and store.read("none").count() == 0
    store.compact("t", latest_of(["id"], ["more"]), ("k",))
    assert store.read("t").count() == store.read("t").where("more = 'x'").count() == 10 and store.read("none").count() == 0


def test_quarantine(spark, tmp_path, made):
    whole, due = made
    good = [r["p"] for r in whole.select(F.to_json(F.struct("*")).alias("p")).collect()]
    sent = [*good, "{", '{"id": 7, "ts": "no time"}', "", None, "[1]", '{"ts": "2024-01-01T00:00:00"}']
    read = ingest.parsed(spark.createDataFrame([(p,) for p in sent], "payload string"))
    assert read.count() == len(sent)
    made = pipelines.ingest_tables(read, IDENTIFYING, due)
    refused = made["refused"].collect()
    assert Counter(r["reason"] for r in refused) == {"no consent": 1, "unknown observer": 1, "broken": 5, "no id": 1}
    assert {r["payload"] for r in refused} >= {"{", "", None, "[1]"}
    admitted = ingest.judged(read).where("refused is null and not broken").count()
    assert admitted + len(refused) == len(sent)
