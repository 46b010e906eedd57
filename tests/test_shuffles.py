"""What is shuffled, by the plans: rows once, before they become many or long."""

from collections import Counter

from pyspark.sql import functions as F
from recollect.operators import grams, ingest, observations, search
from recollect.sources.batches import Batches, shared_folder
from recollect.streaming import timers


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def entities(spark):
    return spark.createDataFrame([("o1", "m", "p1", "part", "1", {"a": "x", "b": "y"}, 1, "u"), ("o2", "m", "p1", "part", "1", {"a": "z"}, 2, "u"), ("o2", "m", "p2", "part", "2", None, 2, None)],
                                 "observation_id string, link string, entity_pk string, entity_type string, entity_id string, traits map<string,string>, ts long, observer_pk string")


def test_an_entity_is_shuffled_once(spark):
    found = ingest.entity_properties(entities(spark), own=True)
    want = ingest.property_state(ingest.property_rows(entities(spark), own=True))
    assert Counter(found.collect()) == Counter(want.collect())
    assert plan(found.select("entity_pk", "property_name", "property_value").distinct()).count("Exchange hashpartitioning") == 1


def test_nested_rows_are_shuffled_before_arrays_are_made(spark):
    links = spark.createDataFrame([("o1", "p1", "part", {"a": "x"}, 1), ("o1", "p2", "part", None, None)], "observation_id string, entity_pk string, entity_type string, traits map<string,string>, state_ts long")
    facts = spark.createDataFrame([("o1", 1, "l", "r")], "obs_id string, ts long, rel_label string, rel_id string")
    found = observations.nested(spark.createDataFrame([("o1",), ("o2",)], "id string"), links, None, facts)
    assert plan(found).count("REPARTITION_BY_COL") == 2
    assert {r["id"]: (len(r["entities"]), len(r["facts"])) for r in found.collect()} == {"o1": (2, 1), "o2": (0, 0)}


class Handle:
    """Counts the messages that a processor sends."""

    def __init__(self):
        self.sent, self.value, self.timers = 0, None, set()

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def get(self):
        self.sent += 1
        return self.value

    def exists(self):
        self.sent += 1
        return self.value is not None

    def update(self, value):
        self.sent, self.value = self.sent + 1, value

    def listTimers(self):  # noqa: N802
        self.sent += 1
        return list(self.timers)

    def deleteTimer(self, at):  # noqa: N802
        self.sent += 1
        self.timers.discard(at)

    def registerTimer(self, at):  # noqa: N802
        self.sent += 1
        self.timers.add(at)

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return 0


def test_a_new_timer_costs_three_messages(spark):
    h, p = Handle(), timers.FiringTimers()
    p.init(h)
    row = dict(at=1_000_000, timeout=60, event="e", obs_id="o", actor_pk=None, object_pk=None)
    assert list(p.handleInputRows(("t",), iter([row]), h)) == [] and h.sent == 3 and h.timers == {61_000}
    assert list(p.handleInputRows(("t",), iter([row | {"at": 2_000_000}]), h)) == [] and h.timers == {62_000}


def test_a_search_adds_up_in_one_shuffle(spark):
    links = spark.createDataFrame([("p1", "o1", "part"), ("p1", "o1", "part"), ("c1", "o1", "customer"), ("c1", "o2", "customer")], "entity_pk string, observation_id string, entity_type string")
    state = spark.createDataFrame([("A", "p1", "part", "n", "v", 1)], "observer_pk string, entity_pk string, entity_type string, property_name string, property_value string, ts long")
    found = search.qualifying(state, links, [search.Entity("customer"), search.Entity("part")])
    assert "count(distinct" not in plan(found)
    assert [(r["observation_id"], r["no_of_entities"]) for r in found.collect()] == [("o1", 2)]


def test_links_without_a_hit_are_dropped_before_they_are_shuffled(spark):
    n = spark.range(1000)
    links = n.select(F.md5(F.col("id").cast("string")).alias("entity_pk"), F.concat(F.lit("o"), F.col("id") % 100).alias("observation_id"), F.lit("part").alias("entity_type")).distinct()
    state = n.select(F.lit("A").alias("observer_pk"), F.md5(F.col("id").cast("string")).alias("entity_pk"), F.lit("part").alias("entity_type"), F.lit("n").alias("property_name"),
                     F.when(F.col("id") % 250 == 7, "V").otherwise("w").alias("property_value"), F.lit(1).alias("ts"))
    found = search.qualifying(state, links, [search.Entity("part", (search.Property("n", "v"),))])
    lines = plan(found).splitlines()
    distinct = next(i for i, x in enumerate(lines) if "Exchange hashpartitioning(" in x and "observation_id" not in x.split("hashpartitioning(")[1].split("#")[0])
    assert any("LeftSemi" in x for x in lines[distinct:]) and not any("LeftSemi" in x for x in lines[:distinct])
    assert sorted((r["observation_id"], r["no_of_matched_props"]) for r in found.collect()) == [("o57", 2), ("o7", 2)]


def test_a_filter_of_bits_keeps_every_key(spark):
    df = spark.range(-5000, 5000).select(F.when(F.col("id") != 0, F.col("id").cast("string")).alias("k"))
    keys = df.where("k % 40 = 3")
    want = {r["k"] for r in keys.collect()}
    few, many = ([r["k"] for r in search.perhaps_in(df, keys, "k", words=n).collect()] for n in (1 << 20, 1))
    assert set(few) == want and want < set(many) and len(many) == len(set(many))
    assert search.perhaps_in(df, keys.where("false"), "k").count() == 0


def test_grams_are_found_where_a_blocks_texts_are(spark):
    class Store(Batches):
        def commit(self, batch, tables, parts=None, **how):
            self.made = plan(tables["grams"])
            return super().commit(batch, tables, parts, **how)

    store = Store(spark, shared_folder(spark, "grams"))
    texts = spark.createDataFrame([(str(n), f"text number {n}") for n in range(40)], "id string, text_string string").coalesce(1)
    grams.add(store, 0, texts, rows_per_block=10)
    assert "hashpartitioning(block" in store.made and "hashpartitioning(block#" in store.made and store.made.count("Exchange hashpartitioning") == 2
    assert {r["id"] for r in grams.search(store, "Number 3").collect()} == {"3", *map(str, range(30, 40))}


def test_copies_are_shuffled_once_and_ordered_by_content_at_equal_times(spark):
    rows = spark.createDataFrame([("o", i, "2024-01-01", label, True, {"m": ("part", "1", {"a": label})}) for i, label in enumerate("ba")],
                                 "id string, n int, ts string, label string, consent boolean, entities map<string, struct<kind:string, id:string, traits:map<string,string>>>")
    rows = rows.select("id", F.col("ts").cast("timestamp_ntz").alias("ts"), "label", F.lit("m").alias("observer"), F.lit("s").alias("source_id"), F.lit(None).cast("string").alias("session_id"), "consent", "entities",
                       F.lit(None).cast("array<struct<label: string, ts: timestamp_ntz, actor: string, objects: array<string>, traits: map<string, string>>>").alias("relation"))
    found = ingest.merge_observations(rows)
    assert "max_by" not in plan(found) and "REPARTITION_BY_COL" in plan(found)
    got = found.first()
    assert got["label"] == "b" and got["entities"]["m"]["traits"] == {"a": "b"} and got["relation"] == []


def test_repeated_links_are_left_once_without_a_shuffle_of_their_own(spark):
    state = "map('a', 'x')"
    links = spark.sql(f"SELECT * FROM VALUES ('o1', X'02', 'part', {state}, 1), ('o1', X'01', 'part', {state}, 1), ('o1', X'02', 'part', {state}, 1), ('o1', X'02', 'supplier', NULL, NULL), ('o2', X'02', 'part', {state}, 1), ('o2', NULL, 'part', NULL, NULL), ('o2', NULL, 'part', NULL, NULL) AS l(observation_id, entity_pk, entity_type, traits, state_ts)")
    said = spark.sql("SELECT X'02' AS entity_pk, 1 AS origin, 't' AS text")
    found = observations.nested(spark.createDataFrame([("o1",), ("o2",), ("o3",)], "id string"), links, said)
    got = {r["id"]: [(e["entity_pk"] and bytes(e["entity_pk"]), e["entity_type"], e["traits"], len(e["descriptions"])) for e in r["entities"]] for r in found.collect()}
    assert got == {"o1": [(b"\x01", "part", {"a": "x"}, 0), (b"\x02", "part", {"a": "x"}, 1), (b"\x02", "supplier", None, 1)], "o2": [(None, "part", None, 0), (b"\x02", "part", {"a": "x"}, 1)], "o3": []}


def test_obs_nested_shuffles_links_as_bytes_and_doesnt_make_them_distinct_first(spark):
    from recollect.plans.queries import QUERIES
    from recollect.plans import read_queries  # noqa: F401

    lines = plan(QUERIES["obs_nested"](spark, "/root/testdata/sf0.001"))
    assert "HashAggregate(keys=[l_partkey" not in lines and "HashAggregate(keys=[l_suppkey" not in lines
    assert lines.count("unhex(md5(") >= 4
