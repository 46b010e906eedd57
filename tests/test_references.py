"""References inside observations, states, rules for extracted entities, chunk rows."""

import hashlib

from pyspark.sql import functions as F
from recollect.functions import identity
from recollect.operators import ingest, references, texts

ENTITIES = "id string, entities map<string, struct<kind: string, id: string, traits: map<string, string>>>, n int"


def entity(kind, key, **traits):
    return {"kind": kind, "id": key, "traits": traits or None}


def test_chains_cycles_and_nothing(spark):
    chain = {f"l{i}": entity("Part", str(i), name=f"$(l{i + 1}).name", own="x") for i in range(20)} | {"l20": entity("Part", "20", name="end")}
    loop = {"a": entity("p", "1", x="$(b).x", y="$(a).x"), "b": entity("p", "2", x="$(c).x"), "c": entity("p", "3", x="$(a).x", z="$(none).z", u="$(c).z", v="$(b).no", w="plain $(a).x")}
    named = {"me": entity("Person", "7", name="Ann"), "it": entity("thing", "9", owner="$(person#7).name", same="$(PERSON#7).name", link="$(me).name")}
    rows = [("chain", chain, 1), ("loop", loop, 2), ("named", named, 3), ("empty", {}, 4), ("none", None, 5), (None, named, 6)]
    out, cycles = references.resolved(spark.createDataFrame(rows, ENTITIES))
    got = {r["id"]: r for r in out.collect()}
    assert out.columns == ["id", "entities", "n"] and len(got) == 6
    assert {e["traits"]["name"] for e in got["chain"]["entities"].values()} == {"end"} and got["chain"]["entities"]["l3"]["traits"]["own"] == "x"
    assert got["loop"]["entities"]["c"]["traits"] == {"x": "$(a).x", "z": "$(none).z", "u": "$(none).z", "v": "$(b).no", "w": "plain $(a).x"}
    assert {(r["link"], r["name"]) for r in cycles.collect()} == {("a", "x"), ("a", "y"), ("b", "x"), ("c", "x")}
    assert got["named"]["entities"]["it"]["traits"] == {"owner": "Ann", "same": "Ann", "link": "Ann"} and got["none"]["entities"] is None
    assert references.resolved(spark.createDataFrame([], ENTITIES))[0].count() == 0


def test_references_stay_in_their_rows(spark):
    import os

    shared = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(shared))
    odd = {"a": entity("p", "1"), "b": entity("P", "1", x="end", n=None), "c": entity("q", "2", y="$(p#1).x", z="$(b).n", v="$(P#1). n ", self="$(c).self"), "d": None}
    rows = [(f"o{i}", odd, i) for i in range(50)]
    out, cycles = references.resolved(spark.createDataFrame(rows, ENTITIES))
    got = out.where("id = 'o7'").first()["entities"]
    assert got["c"]["traits"] == {"y": "end", "z": None, "v": None, "self": "$(c).self"} and got["a"]["traits"] is None and got["d"] is None
    assert out.count() == 50 and {(r["link"], r["name"]) for r in cycles.collect()} == {("c", "self")}
    assert set(os.listdir(shared)) == before  # nothing is stored on the way


def test_states(spark):
    rows = spark.createDataFrame([("o", "a", None, {"x": "1"}), ("o", "b", "7", {"x": "2", "_id": "old"}), ("o", "c", "8", None)], "observation_id string, link string, entity_id string, traits map<string,string>")
    asked = spark.createDataFrame([("o", "c", "mood", "b"), ("o", "c", "none", "a"), ("o", "a", "no", "c"), ("o", "a", "lost", "zzz")], "observation_id string, link string, state string, ref string")
    assert [tuple(r) for r in references.states(rows, asked).collect()] == [("o", "c", "mood", {"x": "2", "_id": "7"})]


def test_extracted_entities(spark):
    rows = [("Top ic", {"$type": "t", "$id": "i"}), ("device", {"$serial_number": "", "$id": "i"}), ("Place", {"$address": "here"}), ("person", {"$id": "i", "$email": "A@x"}), ("person", {"$email": "a@X "})]
    df = spark.createDataFrame(rows, "entity_type string, traits map<string,string>")
    got = [r[0] for r in df.select(identity.extracted_id("entity_type", "traits")).collect()]
    assert got[:4] == [hashlib.md5(x).hexdigest() for x in (b"topic-t", b"device-i", b"place-here", b"person-i")] and len(got[4]) == 32
    entities = df.select(F.col("entity_type"), "traits", F.monotonically_increasing_id().cast("string").alias("entity_pk"), F.lit(1).alias("ts"))
    gids = {r["entity_gid"] for r in ingest.gid_rows(entities, identity.IDENTIFYING_TRAITS).where("entity_type = 'person'").collect()}
    assert len(gids) == 1 and ingest.gid_rows(entities, {}).count() == 0


def test_chunk_tables(spark):
    rows = [("a", "o1", "one two three four five", 1, 5), ("b", "o2", "x y", 1, 6), ("c", "o3", "one two three four five", 2, 7), ("d", "o4", None, 2, 7)]
    t = spark.createDataFrame(rows, "id string, observation_id string, text_string string, origin int, ts long").where("text_string is not null")
    made = {name: df.collect() for name, df in texts.chunk_tables(t, lambda many: [[float(len(x))] for x in many], "m", 2).items()}
    assert sorted((r["text_string"], r["parent_id"], r["observation_id"], r["chunked"]) for r in made["texts"]) == [("five", "a", "o1", True), ("one two", "a", "o1", True), ("three four", "a", "o1", True)]
    assert sorted(r["vector"][0] for r in made["vectors"]) == [3.0, 4.0, 7.0, 10.0] and {r["id"] for r in made["chunked"]} == {"a", "b", "c"}
