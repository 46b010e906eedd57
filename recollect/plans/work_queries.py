"""Registered queries over nested traits, logs, work lists with traits, histograms, and searches with popular entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import entities, grams, ingest, logs, nested, reads, references, search
from ..sources import tables
from ..sources.batches import Batches, shared_folder
from .memory import Memory
from .queries import NOW, TWO, VERSIONED, nested_observations, pks, query, search_sql


@query("""WITH l AS (SELECT l_orderkey, l_partkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS i FROM lineitem)
 SELECT md5(concat('order-', o_orderkey)) AS entity_pk, 'customer.id' AS property_name, CAST(o_custkey AS VARCHAR) AS property_value, CAST(o_custkey AS DOUBLE) AS n FROM orders
 UNION ALL SELECT md5(concat('order-', o_orderkey)), 'customer.tags.0', o_orderpriority, NULL FROM orders
 UNION ALL SELECT md5(concat('order-', o_orderkey)), 'customer.tags.1', o_orderstatus, NULL FROM orders
 UNION ALL SELECT md5(concat('order-', l_orderkey)), concat('lines.', i, '.part'), CAST(l_partkey AS VARCHAR), l_partkey FROM l SEMI JOIN orders ON l_orderkey = o_orderkey
 UNION ALL SELECT md5(concat('order-', l_orderkey)), concat('lines.', i, '.number'), CAST(l_linenumber AS VARCHAR), l_linenumber FROM l SEMI JOIN orders ON l_orderkey = o_orderkey""", ctes=False)
def nested_properties(m: Memory) -> DataFrame:
    """Orders as entities with nested traits (an object, lists, an object in a list, a JSON null), put through leaves,
    assembly and leaves again."""
    line = F.struct(F.col("l_linenumber").alias("number"), F.col("l_partkey").alias("part"))
    lines = m.raw("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    o = m.raw("orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    said = F.to_json(F.struct(F.struct(F.col("o_custkey").alias("id"), F.array("o_orderpriority", "o_orderstatus").alias("tags")).alias("customer"), "lines"))
    traits = F.parse_json(F.concat(F.lit('{"none":null,'), F.substr(said, F.lit(2))))
    rows = o.select(F.lit("A").alias("observer_pk"), F.md5(F.concat(F.lit("order-"), "o_orderkey")).alias("entity_pk"), F.lit("order").alias("entity_type"), F.unix_timestamp("o_orderdate").alias("ts"), traits.alias("traits"))
    keys = ["observer_pk", "entity_pk", "entity_type", "ts"]
    again = nested.assembled(nested.leaves(rows, keys, "traits", together=True), keys)
    return nested.property_rows(again).select("entity_pk", "property_name", "property_value", F.col("property_number").cast("double").alias("n"))


HOT = ", hot AS (SELECT CASE WHEN entity_type = 'customer' AND CAST(substr(observation_id, 2) AS BIGINT) % 3 = 0 THEN (SELECT min(entity_pk) FROM latest WHERE property_name = '$segment' AND lower(property_value) = 'building') ELSE entity_pk END AS entity_pk, observation_id, entity_type FROM links)"


@query(HOT + search_sql(TWO, 2).replace("FROM links", "FROM hot") + " SELECT * FROM result")
def eql_hot_entity(m: Memory) -> DataFrame:
    """As ``eql_two_group``, where one customer has a third of all orders."""
    state = m.property_state()
    building = search.latest_properties(state, ["customer"], ["$segment"]).where(F.lower("property_value") == "building")
    popular = building.agg(F.min("entity_pk").alias("_popular"))
    moved = (F.col("entity_type") == "customer") & (F.substr("observation_id", F.lit(2)).cast("long") % 3 == 0)
    links = m.links().crossJoin(F.broadcast(popular)).withColumn("entity_pk", F.when(moved, F.col("_popular")).otherwise(F.col("entity_pk"))).drop("_popular")
    return search.qualifying(state, links, TWO)


def event_logs(m: Memory) -> DataFrame:
    return m.raw("events").select(F.concat(F.lit("log"), "event_id").alias("id"), F.col("ts").alias("date"), F.col("event_type").alias("level"), F.concat(F.lit("u"), "user_id").alias("entity_id"))


LOGS = "WITH l AS (SELECT concat('log', event_id) AS id, ts AS date, event_type AS level, concat('u', user_id) AS entity_id FROM events)"


@query(LOGS + ", f AS (SELECT *, count(*) OVER () AS total FROM l WHERE level = 'click' AND date BETWEEN TIMESTAMP '2000-01-01' AND TIMESTAMP '2100-01-01') SELECT * FROM f ORDER BY date DESC, id LIMIT 20 OFFSET 10", ctes=False)
def logs_page(m: Memory) -> DataFrame:
    """A page of the logs that two batches saved."""
    store, every = Batches(m.spark, shared_folder(m.spark, "logs")), event_logs(m)
    even = F.pmod(F.xxhash64("id"), F.lit(2)) == 0
    logs.save(store, 0, every.where(even))
    logs.save(store, 1, every.where(~even))
    found = logs.between(store.read("logs"), "2000-01-01", "2100-01-01", F.col("level") == "click", start=10, limit=20)
    return found.select("id", "date", "level", "entity_id", "total")


@query(LOGS + " SELECT *, count(*) OVER () AS total FROM l WHERE entity_id = 'u3' ORDER BY date, id LIMIT 30", ctes=False)
def logs_of_entity(m: Memory) -> DataFrame:
    return logs.of_property(event_logs(m), "entity_id", "u3", newest_first=False)


@query(VERSIONED + f""" SELECT rel_id, a.traits AS actor_traits, NULL::VARCHAR AS rel_traits, o.traits AS object_traits FROM vf LEFT JOIN history a ON vf.actor_pk = a.entity_pk AND ah = a.data_hash LEFT JOIN history o ON vf.object_pk = o.entity_pk AND oh = o.data_hash
 WHERE length(rel_id) % 3 <> 0 AND source_id = '1-URGENT' AND ts > TIMESTAMP '1996-01-01' AND ts <= TIMESTAMP '{NOW}' - INTERVAL 3600 SECOND""")
def unprocessed_with_traits(m: Memory) -> DataFrame:
    f = m.versioned_facts().withColumn("rel_pk", F.col("rel_id")).withColumn("rel_data_hash", F.lit(None).cast("string"))
    done = m.versioned_facts().where(F.length("rel_id") % 3 == 0).select("rel_id", F.lit("trigger-1").alias("job_id"))
    found = reads.unprocessed_with_traits(f, done, m.history(), "trigger-1", "1996-01-01", NOW, 3600, F.col("source_id") == "1-URGENT")
    return found.select("rel_id", "actor_traits", "rel_traits", "object_traits")


def buckets_sql(table: str, ts: str, start: int, width: int, n: int) -> str:
    return (f"WITH w AS (SELECT CAST(floor(({ts} - {start}) / {width}) AS BIGINT) AS bucket, count(*) AS n FROM {table} WHERE {ts} >= {start} AND {ts} < {start + n * width} GROUP BY 1)"
            f" SELECT i AS bucket, {start} + i * {width} AS since, coalesce(n, 0) AS n FROM (SELECT unnest(range({n})) AS i) LEFT JOIN w ON i = bucket")


@query(buckets_sql("orders", "CAST(epoch(o_orderdate) AS BIGINT)", 788918400, 4320000, 60), ctes=False)
def observation_histogram(m: Memory) -> DataFrame:
    return reads.histogram(m.observations(), 788918400, 1048118400)


@query(buckets_sql("(SELECT 1704067200 + c_custkey * 10 + v AS t FROM customer, (VALUES (0), (1)) AS x(v))", "t", 1704067200, 100, 60), ctes=False)
def history_histogram(m: Memory) -> DataFrame:
    return reads.histogram(m.versions().withColumn("ts", F.timestamp_seconds("ts")), 1704067200, 1704073200)


@query(buckets_sql("events", "CAST(floor(epoch(ts)) AS BIGINT)", 1704067200, 86400, 60), ctes=False)
def log_histogram(m: Memory) -> DataFrame:
    return reads.histogram(event_logs(m), 1704067200, 1704067200 + 60 * 86400, ts="date")


@query("SELECT entity_pk, data_hash, traits FROM history WHERE entity_pk = md5('customer-7') AND data_hash = md5(concat(md5('customer-7'), '-', 1))")
def history_version(m: Memory) -> DataFrame:
    import hashlib

    pk = pks("customer-7")[0]
    return entities.version(m.history(), pk, hashlib.md5(f"{pk}-1".encode()).hexdigest()).select("entity_pk", "data_hash", "traits")


@query("SELECT entity_pk, data_hash FROM versions WHERE ts BETWEEN 1704067300 AND 1704067400 AND observer_pk = 'B'")
def history_in_span(m: Memory) -> DataFrame:
    return entities.history_between(m.versions(), 1704067300, 1704067400, F.col("observer_pk") == "B").select("entity_pk", "data_hash")


@query("SELECT entity_id, observer_pk, data_hash, ts FROM versions QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY ts DESC, data_hash) <= 1")
def newest_versions(m: Memory) -> DataFrame:
    return entities.newest_per_key(m.versions(), ["entity_id"], 1, ["data_hash"]).select("entity_id", "observer_pk", "data_hash", "ts")


@query("SELECT entity_pk, observer_pk, property_value FROM state WHERE entity_type = 'customer' AND property_name = '$segment' AND property_value = 'BUILDING' AND observer_pk = 'A'")
def entities_with_property(m: Memory) -> DataFrame:
    return entities.with_property(m.property_state(), "customer", "$segment", "BUILDING", "A").select("entity_pk", "observer_pk", "property_value")


@query("SELECT concat('o', o_orderkey) AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'no consent' END AS refused FROM orders SEMI JOIN lineitem ON l_orderkey = o_orderkey", ctes=False)
def judged_observations(m: Memory) -> DataFrame:
    return ingest.judged(nested_observations(m), whole=True).select("id", "refused")


@query("SELECT entity_pk, property_name, arg_max(property_value, (ts, observer_pk)) AS property_value, max(ts) AS ts FROM state GROUP BY ALL")
def latest_rows(m: Memory) -> DataFrame:
    return tables.latest(m.property_state(), ["entity_pk", "property_name"], ["ts", "observer_pk"]).select("entity_pk", "property_name", "property_value", "ts")


@query("SELECT id, rank FROM (VALUES ('o7', 1), ('o1', 2), ('o5', 3)) AS x(id, rank) SEMI JOIN obs USING (id)")
def observations_in_order(m: Memory) -> DataFrame:
    asked = ["o7", "o1", "o5"]
    found = entities.in_order(m.observations().where(F.col("id").isin(asked)), "id", asked)
    return found.select("id", F.array_position(F.array(*map(F.lit, asked)), F.col("id")).cast("int").alias("rank"))


@query("SELECT concat('t', c_custkey) AS id, c_acctbal AS timeout FROM customer WHERE c_custkey = 7", ctes=False)
def timer_by_id(m: Memory) -> DataFrame:
    return reads.timer(m.raw("customer").select(F.concat(F.lit("t"), "c_custkey").alias("id"), F.col("c_acctbal").alias("timeout")), "t7")


@query("SELECT DISTINCT observation_id FROM texts WHERE contains(lower(text_string), 'license')")
def fulltext_index(m: Memory) -> DataFrame:
    """As ``fulltext_obs``, from blocks of texts that have the grams."""
    store, t = Batches(m.spark, shared_folder(m.spark, "grams")), m.texts()
    grams.add(store, 0, t.where("doc_id % 2 = 0"), rows_per_block=500)
    grams.add(store, 1, t.where("doc_id % 2 = 1"), rows_per_block=500)
    return grams.search(store, "license").select("observation_id").distinct()


@query("""SELECT concat('o', o_orderkey) AS id, count(DISTINCT l_partkey) AS parts, 1 + count(DISTINCT l_partkey) AS same FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 5 <> 0 GROUP BY 1
 UNION ALL SELECT concat('o', o_orderkey), count(DISTINCT l_partkey), 0 FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 5 = 0 GROUP BY 1""", ctes=False)
def chained_references(m: Memory) -> DataFrame:
    """Each part of an order refers to the next one's seller, the last to the customer's; every fifth order's customer
    refers back to the first part, so that all run in a circle."""
    o = nested_observations(m)
    links = F.array_sort(F.filter(F.map_keys("entities"), lambda k: k != "me"))
    o = o.withColumn("_links", links)
    circle = F.substr("id", F.lit(2)).cast("long") % 5 == 0

    def reference(k):
        place = F.array_position("_links", k)
        onward = F.when(place < F.size("_links"), F.try_element_at("_links", (place + 1).cast("int"))).otherwise(F.lit("me"))
        own = F.when(circle, F.concat(F.lit("$("), F.element_at("_links", 1), F.lit(").seller"))).otherwise(F.lit("Ann"))
        return F.when(k == "me", own).otherwise(F.concat(F.lit("$("), onward, F.lit(").seller")))

    o = o.withColumn("entities", F.transform_values("entities", lambda k, e: e.withField("traits", F.create_map(F.lit("seller"), reference(k))))).drop("_links")
    found, _ = references.resolved(o.select("id", "entities"))
    sellers = F.transform(F.map_values("entities"), lambda e: F.try_element_at(e["traits"], F.lit("seller")))
    return found.select("id", (F.size("entities") - 1).cast("long").alias("parts"), F.size(F.filter(sellers, lambda s: s == "Ann")).cast("long").alias("same"))
