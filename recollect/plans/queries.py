"""Registered queries over the memory tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.identity import entity_pk, triplet_id, version_id
from ..operators import entities, ingest, observations, reads, search, texts
from ..operators.search import Entity, Property
from .memory import CTES, Memory

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Stands for the wall clock.
NOW = "2024-03-01 00:00:00"


def query(sql: str | None, ctes: bool = True):
    def register(f: Callable[[Memory], DataFrame]):
        QUERIES[f.__name__] = lambda spark, folder: f(Memory(spark, folder))
        if sql:
            ORACLE_SQL[f.__name__] = f"WITH {CTES}{sql if sql.lstrip().startswith(',') else ' ' + sql}" if ctes else sql
        return f

    return register


BUILDING = Entity("customer", (Property("$segment", "building"),))
BRAND = Entity("part", (Property("$brand", "Brand#1"),))
RESULT = """SELECT observation_id, count(DISTINCT group_id) AS no_of_entities, CAST(sum(matched) AS BIGINT) AS no_of_matched_props,
  string_agg(DISTINCT entity_pk, ',' ORDER BY entity_pk) AS entity_pks, max(similarity) AS max_similarity
FROM found GROUP BY observation_id HAVING count(DISTINCT group_id) >= """


def search_sql(groups: list[Entity], least: int, unmatched: int = 0, source: str = "latest") -> str:
    """The found rows of a search, and its result."""
    arms = []
    for n, g in enumerate(groups):
        if g.properties:
            hit = " OR ".join(f"(property_name = '{p.name}' AND lower(property_value) = '{p.value.lower()}')" for p in g.properties)
            arms.append(f"SELECT observation_id, entity_pk, {n} AS group_id, m AS matched, 1.0::DOUBLE AS similarity FROM links JOIN (SELECT entity_pk, count(*) AS m FROM {source} WHERE entity_type = '{g.kind}' AND ({hit}) GROUP BY entity_pk HAVING count(*) >= {max(0, len(g.properties) - unmatched)}) USING (entity_pk)")
        else:
            arms.append(f"SELECT observation_id, entity_pk, {n}, 1, NULL FROM links WHERE entity_type = '{g.kind}'")
    return f", found AS ({' UNION ALL '.join(arms)}), result AS ({RESULT}{least})"


def result_of(m: Memory, groups: list[Entity], **how) -> DataFrame:
    return search.qualifying(m.property_state(), m.links(), groups, **how)


TWO = [BUILDING, BRAND]


@query(search_sql(TWO, 2) + " SELECT * FROM result")
def eql_two_group(m: Memory) -> DataFrame:
    return result_of(m, TWO)


@query(search_sql([*TWO, Entity("supplier")], 3) + " SELECT * FROM result")
def eql_property_less(m: Memory) -> DataFrame:
    return result_of(m, [*TWO, Entity("supplier")])


LOOSE = [Entity("part", (Property("$brand", "Brand#2"), Property("$type", "PROMO"))), BUILDING]


@query(search_sql(LOOSE, 2, unmatched=1) + " SELECT * FROM result")
def eql_unmatched_trait(m: Memory) -> DataFrame:
    return result_of(m, LOOSE, unmatched_traits=1)


@query(search_sql(TWO, 1) + " SELECT * FROM result")
def eql_unmatched_entity(m: Memory) -> DataFrame:
    return result_of(m, TWO, unmatched_entities=1)


@query(", windowed AS (SELECT entity_pk, entity_type, property_name, arg_max(property_value, (ts, observer_pk)) AS property_value FROM state WHERE ts BETWEEN 1704067210 AND 1704067800 GROUP BY ALL)"
       + search_sql(TWO, 2, source="windowed") + " SELECT * FROM result")
def eql_date_window(m: Memory) -> DataFrame:
    return result_of(m, TWO, start=1704067210, end=1704067800)


@query(search_sql(TWO, 2) + " SELECT entity_type, count(*) AS n FROM links SEMI JOIN result USING (observation_id) GROUP BY ALL")
def eql_entity_facets(m: Memory) -> DataFrame:
    return search.entity_facets(result_of(m, TWO), m.links())


@query(search_sql(TWO, 2) + " SELECT id, source_id, label, ts, no_of_matched_props, max_similarity FROM result JOIN obs ON id = observation_id")
def eql_observations(m: Memory) -> DataFrame:
    return search.observations_of(result_of(m, TWO), m.observations())


@query(search_sql(TWO, 2) + """, e AS (SELECT DISTINCT entity_pk, entity_type FROM links SEMI JOIN result USING (observation_id) WHERE entity_type IN ('part', 'customer'))
 SELECT e.entity_pk, e.entity_type, string_agg(property_name || '=' || property_value, ' ' ORDER BY property_name) AS traits FROM e LEFT JOIN latest USING (entity_pk) GROUP BY ALL""")
def eql_expand_state(m: Memory) -> DataFrame:
    found = search.expanded_entities(result_of(m, TWO), m.links(), m.property_state(), ["part", "customer"])
    pairs = F.transform(F.array_sort(F.map_entries("traits")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return found.select("entity_pk", "entity_type", F.array_join(pairs, " ").alias("traits"))


SUPPLY = [Entity("supplier", (Property("$nation", "3"),))]


@query(search_sql(TWO, 2) + f", found2 AS (SELECT observation_id FROM links JOIN latest USING (entity_pk) WHERE latest.entity_type = 'supplier' AND property_name = '$nation' AND property_value = '3')"
       " SELECT observation_id FROM result UNION SELECT observation_id FROM found2")
def eql_any_of(m: Memory) -> DataFrame:
    return search.any_of(result_of(m, TWO), result_of(m, SUPPLY))


@query(search_sql(TWO, 2) + ", found2 AS (SELECT observation_id FROM links JOIN latest USING (entity_pk) WHERE latest.entity_type = 'supplier' AND property_name = '$nation' AND property_value = '3')"
       " SELECT * FROM result ANTI JOIN found2 USING (observation_id)")
def eql_none_of(m: Memory) -> DataFrame:
    return search.none_of(result_of(m, TWO), result_of(m, SUPPLY))


@query(""", v AS (SELECT concat('Brand#', vec_id) AS value, embedding::DOUBLE[] AS vector FROM embeddings),
 q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 1),
 near AS (SELECT entity_pk, list_cosine_similarity(vector, q) AS similarity FROM latest JOIN v ON property_value = value, q WHERE entity_type = 'part' AND property_name = '$brand' ORDER BY similarity DESC, entity_pk LIMIT 100)
 SELECT observation_id, count(*) AS parts, round(max(similarity), 6) AS similarity FROM links JOIN near USING (entity_pk) WHERE similarity >= 0.1 GROUP BY ALL""")
def eql_vector(m: Memory) -> DataFrame:
    e = m.raw("embeddings")
    vectors = e.select(F.concat(F.lit("Brand#"), "vec_id").alias("value"), F.col("embedding").alias("vector"))
    asked = tuple(e.where("vec_id = 1").first()["embedding"])
    groups = [Entity("part", (Property("$brand", "", vector=asked, similarity=0.1),))]
    found = result_of(m, groups, vectors=vectors)
    return found.select("observation_id", F.size(F.split("entity_pks", ",")).cast("long").alias("parts"), F.round("max_similarity", 6).alias("similarity"))


@query("SELECT rel_id, obs_id, rel_label, ts FROM facts WHERE ts BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '2030-01-01' AND (rel_label = 'ordered' OR rel_label LIKE 'pur%') ORDER BY ts DESC, rel_id LIMIT 50 OFFSET 10")
def fact_search_page(m: Memory) -> DataFrame:
    f = reads.facts_between(m.facts(), "1996-01-01", "2030-01-01", F.col("rel_label").isin("ordered") | F.col("rel_label").like("pur%"))
    return reads.page(f.select("rel_id", "obs_id", "rel_label", "ts"), [F.desc("ts"), F.col("rel_id")], 10, 50)


@query("SELECT rel_id, rel_label, ts FROM facts WHERE actor_pk IN (md5('user-1'), md5('user-2'), md5('customer-7'))")
def facts_by_actor(m: Memory) -> DataFrame:
    return observations.facts_of_entities(m.facts(), pks("user-1", "user-2", "customer-7"), ("actor",)).select("rel_id", "rel_label", "ts")


def pks(*keys: str) -> list[str]:
    import hashlib

    return [hashlib.md5(k.encode()).hexdigest() for k in keys]


VERSIONED = ", vf AS (SELECT *, md5(concat(actor_pk, '-', length(rel_id) % 2)) AS ah, md5(concat(object_pk, '-', length(rel_id) % 2)) AS oh FROM facts WHERE rel_label = 'ordered')"


@query(VERSIONED + " SELECT rel_id, a.traits AS actor_traits, o.traits AS object_traits FROM vf JOIN history a ON vf.actor_pk = a.entity_pk AND ah = a.data_hash JOIN history o ON vf.object_pk = o.entity_pk AND oh = o.data_hash WHERE source_id = '1-URGENT'")
def fact_versions_export(m: Memory) -> DataFrame:
    return reads.with_versions(m.versioned_facts().where(F.col("source_id") == "1-URGENT"), m.history()).select("rel_id", "actor_traits", "object_traits")


@query("SELECT rel_id, rel_label FROM facts ANTI JOIN jobs USING (rel_id) WHERE actor_type = 'user'")
def unprocessed_events(m: Memory) -> DataFrame:
    return reads.unprocessed(m.facts().where(F.col("actor_type") == "user"), m.jobs(), "trigger-1").select("rel_id", "rel_label")


@query(f"""SELECT f.obs_id, f.ts FROM (SELECT obs_id, max(ts) AS ts FROM facts WHERE ts < TIMESTAMP '{NOW}' - INTERVAL 60 MINUTE GROUP BY obs_id) f LEFT JOIN triggers t ON f.obs_id = t.obs_id
 WHERE t.ts_end IS NULL OR f.ts > t.ts_end""")
def ending_observations(m: Memory) -> DataFrame:
    return reads.ending_observations(m.facts(), m.triggers(), "ended", NOW)


@query("SELECT id, label, ts FROM links JOIN obs ON id = observation_id WHERE entity_pk = md5('customer-7')")
def obs_by_entity(m: Memory) -> DataFrame:
    return observations.of_entity(m.links(), m.observations(), pks("customer-7")).select("id", "label", "ts")


@query("SELECT DISTINCT entity_pk, texts.id AS text_id FROM links JOIN texts USING (observation_id) WHERE entity_type = 'customer'")
def entity_descriptions(m: Memory) -> DataFrame:
    return observations.descriptions(m.links(), m.texts(), ["customer"])


@query("SELECT entity_pk FROM gids WHERE entity_gid IN (SELECT entity_gid FROM gids WHERE entity_pk = md5('customer-8'))")
def gid_siblings(m: Memory) -> DataFrame:
    return reads.same_identity(m.gids(), F.col("entity_pk") == pks("customer-8")[0])


@query(""", s AS (SELECT state.*, coalesce(entity_gid, state.entity_pk) AS identity FROM state LEFT JOIN gids USING (entity_pk) WHERE entity_type = 'customer'),
 l AS (SELECT identity, property_name, arg_max(property_value, (ts, observer_pk, entity_pk)) AS v FROM s GROUP BY ALL)
 SELECT l.identity, (SELECT count(DISTINCT entity_pk) FROM s WHERE s.identity = l.identity) AS entities, string_agg(property_name || '=' || v, ' ' ORDER BY property_name) AS traits FROM l GROUP BY l.identity""")
def stitched_entities(m: Memory) -> DataFrame:
    out = reads.stitched(m.property_state().where(F.col("entity_type") == "customer"), m.gids())
    return out.select("identity", "entities", F.array_join(F.transform(F.array_sort(F.map_entries("traits")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), " ").alias("traits"))


@query("SELECT DISTINCT entity_pk FROM state WHERE ts > 1704067250 AND ts <= 1704067300")
def changed_entities(m: Memory) -> DataFrame:
    return reads.changed_since(m.property_state(), 1704067250, 1704067300)


@query("SELECT count(DISTINCT obs_id) AS observations, count(DISTINCT actor_pk) AS actors, count(DISTINCT actor_type) AS kinds, count(*) AS facts FROM facts WHERE ts >= TIMESTAMP '1998-01-01'")
def online_counts(m: Memory) -> DataFrame:
    return entities.online(m.facts(), "1998-01-01")


@query(" UNION ALL ".join(f"SELECT '{r}' AS role, count(DISTINCT {r}_pk) AS entities, count(DISTINCT obs_id) AS observations, count(DISTINCT rel_label) AS labels, count(*) AS facts, min(ts) AS first, max(ts) AS last FROM facts WHERE {r}_type = 'customer'" for r in ("actor", "object")))
def entity_stats(m: Memory) -> DataFrame:
    return reads.entity_statistics(m.facts(), "customer")


@query("SELECT rel_label, count(*) AS n FROM facts WHERE actor_type = 'customer' GROUP BY ALL UNION SELECT rel_label, count(*) FROM facts WHERE object_type = 'customer' GROUP BY ALL")
def event_role_counts(m: Memory) -> DataFrame:
    return entities.labels_by_role(m.facts(), "customer")


@query(", w AS (SELECT CAST(floor((epoch(ts) - 788918400) / 4320000) AS BIGINT) AS bucket, count(*) AS n FROM facts WHERE rel_label = 'ordered' AND epoch(ts) >= 788918400 AND epoch(ts) < 1048118400 GROUP BY 1)"
       " SELECT i AS bucket, 788918400 + i * 4320000 AS since, coalesce(n, 0) AS n FROM (SELECT unnest(range(60)) AS i) LEFT JOIN w ON i = bucket")
def event_histogram(m: Memory) -> DataFrame:
    return reads.histogram(m.facts().where(F.col("rel_label") == "ordered"), 788918400, 1048118400)


@query("SELECT event_type AS level, count(*) AS n FROM events GROUP BY ALL", ctes=False)
def log_levels(m: Memory) -> DataFrame:
    return entities.counts_by(m.raw("events").withColumnRenamed("event_type", "level"), "level")


@query("SELECT DISTINCT id FROM texts ANTI JOIN (SELECT doc_id FROM labels) USING (doc_id)")
def not_embedded(m: Memory) -> DataFrame:
    return texts.not_embedded(m.texts().select("doc_id", "id"), m.raw("labels"), "doc_id").join(m.texts(), "doc_id").select("id").distinct()


@query("SELECT concat('t', doc_id) AS id FROM documents t WHERE NOT EXISTS (SELECT 1 FROM labels c WHERE c.doc_id = t.doc_id)", ctes=False)
def not_summarised(m: Memory) -> DataFrame:
    t = m.chunked_texts()
    return texts.without_children(t).select("id")


@query("SELECT DISTINCT observation_id FROM texts WHERE contains(lower(text_string), 'license')")
def fulltext_obs(m: Memory) -> DataFrame:
    return observations.full_text(m.texts(), "license")


NEAR = "(SELECT e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS similarity FROM embeddings e, embeddings q WHERE q.vec_id = {q} ORDER BY similarity DESC, e.vec_id LIMIT {k})"


def vector(m: Memory, key: int) -> list[float]:
    return m.raw("embeddings").where(F.col("vec_id") == key).first()["embedding"]


@query("SELECT vec_id, round(similarity, 6) AS similarity FROM " + NEAR.format(q=0, k=10), ctes=False)
def similar_texts(m: Memory) -> DataFrame:
    return reads.similar(m.raw("embeddings"), vector(m, 0), 10, -1.0).withColumn("similarity", F.round("similarity", 6))


@query("SELECT vec_id, round(sum(1.0::DOUBLE / (60 + r)), 9) AS score FROM (" + " UNION ALL ".join(
    f"SELECT vec_id, row_number() OVER (ORDER BY similarity DESC, vec_id) AS r FROM {NEAR.format(q=q, k=150)}" for q in (0, 1)) + ") GROUP BY vec_id ORDER BY sum(1.0::DOUBLE / (60 + r)) DESC, vec_id LIMIT 10", ctes=False)
def rrf_fusion(m: Memory) -> DataFrame:
    e = m.raw("embeddings")
    return reads.rank_fusion([reads.similar(e, vector(m, q), 150, -1.0) for q in (0, 1)]).withColumn("score", F.round("score", 9))


@query(""", c AS (SELECT label, i AS position, avg(embedding[i + 1]::DOUBLE) AS m FROM embeddings, (SELECT unnest(range(64)) AS i) GROUP BY ALL)
 SELECT label, CAST(position AS INTEGER) AS position, round(m - 0.3 * ((sum(m) OVER (PARTITION BY position) - m) / (count(*) OVER (PARTITION BY position) - 1)), 6) AS prototype FROM c""")
def class_prototypes(m: Memory) -> DataFrame:
    return reads.centroids(m.raw("embeddings")).withColumn("prototype", F.round("prototype", 6))


@query(""", a AS (SELECT entity_pk FROM latest WHERE entity_type = 'customer' AND property_name = '$nation' AND property_value = '3'),
 b AS (SELECT entity_pk FROM latest WHERE entity_type = 'part' AND property_name = '$size' AND property_value = '7'),
 t AS (SELECT entity_pk, 0 AS c FROM a UNION ALL SELECT entity_pk, 1 FROM b)
 SELECT observation_id, count(DISTINCT entity_pk) AS entities FROM links JOIN t USING (entity_pk) GROUP BY ALL HAVING count(DISTINCT c) = 2""")
def hyper_edge(m: Memory) -> DataFrame:
    state = search.latest_properties(m.property_state(), ["customer", "part"])

    def having(kind: str, name: str, value: str) -> DataFrame:
        return state.where((F.col("entity_type") == kind) & (F.col("property_name") == name) & (F.col("property_value") == value))

    return search.hyper_edge(m.links(), [having("customer", "$nation", "3"), having("part", "$size", "7")])


@query("SELECT observation_id, count(*) AS n, count(DISTINCT entity_type) AS kinds FROM links GROUP BY ALL HAVING count(DISTINCT entity_type) = 3")
def links_of_entities(m: Memory) -> DataFrame:
    return entities.links_by_observation(m.links()).where("kinds = 3")


STATE = "st AS (SELECT entity_pk, string_agg(property_name || '=' || property_value, ' ' ORDER BY property_name) AS traits FROM latest GROUP BY entity_pk)"


def state_text(m: Memory, by: tuple[str, ...] = ()) -> DataFrame:
    s = search.entity_state(m.property_state(), by)
    return s.select("entity_pk", *by, F.array_join(F.transform(F.array_sort(F.map_entries("traits")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), " ").alias("traits"))


@query(", " + STATE + " SELECT rel_id, a.traits AS actor_traits, o.traits AS object_traits FROM facts LEFT JOIN st a ON actor_pk = a.entity_pk LEFT JOIN st o ON object_pk = o.entity_pk")
def view_fact_entities(m: Memory) -> DataFrame:
    return entities.with_states(m.facts(), state_text(m)).select("rel_id", "actor_traits", "object_traits")


@query(", " + STATE + " SELECT entity_pk, traits FROM st")
def view_entity_state(m: Memory) -> DataFrame:
    return state_text(m)


@query("SELECT entity_pk, observer_pk, string_agg(property_name || '=' || property_value, ' ' ORDER BY property_name) AS traits FROM state GROUP BY ALL")
def view_observer_state(m: Memory) -> DataFrame:
    return state_text(m, ("observer_pk",))


@query("SELECT state.entity_pk, coalesce(entity_gid, state.entity_pk) AS identity, property_name, property_value FROM state LEFT JOIN gids USING (entity_pk) WHERE observer_pk = 'A'")
def view_global_state(m: Memory) -> DataFrame:
    return entities.with_identity(m.property_state().where(F.col("observer_pk") == "A"), m.gids()).select("entity_pk", "identity", "property_name", "property_value")


@query(VERSIONED + """, r AS (SELECT 'actor' AS role, rel_label, ah AS h, count(*) AS n FROM vf GROUP BY ALL UNION ALL SELECT 'object', rel_label, oh, count(*) FROM vf GROUP BY ALL)
 SELECT role, rel_label, entity_type, CAST(sum(n) AS BIGINT) AS n, min(traits) AS sample FROM r JOIN history ON h = data_hash GROUP BY ALL""")
def view_uniq_traits(m: Memory) -> DataFrame:
    return entities.sample_traits(m.versioned_facts(), m.history())


@query("""SELECT entity_pk, entity_type, count(*) AS matches, count(*) / 2.0::DOUBLE AS fit FROM state WHERE entity_type = 'part' AND ((property_name = '$brand' AND lower(property_value) = 'brand#3')
 OR (property_name = '$size' AND try_cast(property_value AS DOUBLE) = 10)) GROUP BY ALL""")
def property_search(m: Memory) -> DataFrame:
    return search.by_properties(m.property_state(), [("$brand", "Brand#3"), ("$size", "10")], kind="part")


@query("SELECT entity_pk, property_name, property_value, count(*) AS n, max(ts) AS ts FROM state GROUP BY ALL")
def property_dedup(m: Memory) -> DataFrame:
    return reads.property_dedup(m.property_state())


@query("""SELECT coalesce(t.s_suppkey, p.s_suppkey) AS id, CASE WHEN t.s_suppkey IS NOT NULL THEN concat(t.s_name, ' (test)') ELSE p.s_name END AS name, p.s_suppkey IS NOT NULL AS running
 FROM (SELECT * FROM supplier WHERE s_suppkey % 3 <> 0) p FULL JOIN (SELECT * FROM supplier WHERE s_suppkey % 2 = 0) t ON p.s_suppkey = t.s_suppkey""", ctes=False)
def context_overlay(m: Memory) -> DataFrame:
    s = m.raw("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return reads.overlay(s.where("id % 3 <> 0"), s.where("id % 2 = 0").withColumn("name", F.concat("name", F.lit(" (test)"))))


@query(f"SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'O' AND epoch(o_orderdate) + o_orderkey * 60 < epoch(TIMESTAMP '2000-01-01')", ctes=False)
def active_timers(m: Memory) -> DataFrame:
    t = m.raw("orders").select("o_orderkey", "o_orderdate", F.col("o_orderdate").alias("ts"), (F.col("o_orderkey") * 60).alias("timeout"), F.when(F.col("o_orderstatus") == "O", 1).otherwise(0).alias("status"))
    return reads.active_timers(t, "2000-01-01").select("o_orderkey", "o_orderdate")


@query("SELECT conv_id, count(*) AS turns, CAST(sum(length(text)) + count(*) - 1 AS BIGINT) AS chars, sum(length(text)) + count(*) - 1 > 1000 AS compress FROM conversations GROUP BY conv_id", ctes=False)
def conversation_window(m: Memory) -> DataFrame:
    return ingest.conversation_memory(m.raw("conversations"), "conv_id", ["turn"], "text", 1000)


@query("SELECT DISTINCT json_extract_string(props, '$.k') AS k FROM events WHERE event_type = 'click' AND json_extract_string(props, '$.k') IS NOT NULL", ctes=False)
def json_field_values(m: Memory) -> DataFrame:
    return entities.column_values(m.raw("events").where(F.col("event_type") == "click"), F.get_json_object("props", "$.k")).withColumnRenamed("value", "k")


@query("""SELECT entity_pk, md5(concat(actor, '-', 'knows', '-', entity_pk)) AS tid, md5(concat(entity_pk, '-', 'None')) AS hid FROM (SELECT md5(concat('customer-', c_custkey)) AS entity_pk, md5(concat('nation-', c_nationkey)) AS actor FROM customer)""", ctes=False)
def identity_hashes(m: Memory) -> DataFrame:
    c = m.raw("customer").select(entity_pk(F.lit("Customer"), "c_custkey").alias("entity_pk"), entity_pk(F.lit("nation"), "c_nationkey").alias("actor"))
    return c.select("entity_pk", triplet_id("actor", F.lit("knows"), "entity_pk").alias("tid"), version_id("entity_pk", F.lit(None)).alias("hid"))


@query("""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-') AS slug, length(url) AS n FROM pages""", ctes=False)
def scalar_text_mix(m: Memory) -> DataFrame:
    return m.raw("pages").select("page_id", scalars.host_of("url").alias("host"), scalars.slug("url").alias("slug"), F.length("url").cast("long").alias("n"))


def nested_observations(m: Memory) -> DataFrame:
    """Orders as nested observations: their customer and parts as entities, one relation for each line."""
    def link(k):
        return F.concat(F.lit("part"), k)

    lines = m.raw("lineitem").select("l_orderkey", "l_partkey").repartition("l_orderkey")  # numbers, before texts are made of them
    per = lines.groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("keys"))
    parts = F.transform(F.array_distinct("keys"), lambda k: F.struct(link(k).alias("link"), F.struct(F.lit("part").alias("kind"), k.cast("string").alias("id")).alias("e")))
    per = per.select("l_orderkey", F.array_sort(parts).alias("parts"), F.transform("keys", link).alias("to"))
    o = m.raw("orders").join(per, F.col("o_orderkey") == F.col("l_orderkey"))
    customer = F.struct(F.lit("me").alias("link"), F.struct(F.lit("Customer").alias("kind"), F.col("o_custkey").cast("string").alias("id")).alias("e"))
    entities = F.map_from_entries(F.transform(F.concat("parts", F.array(customer)), lambda p: F.struct(p["link"].alias("key"), F.struct(
        p["e"]["kind"].alias("kind"), p["e"]["id"].alias("id"), F.create_map(F.lit("$type"), p["e"]["kind"]).alias("traits")).alias("value"))))
    relation = F.array(F.struct(F.lit("ordered").alias("label"), F.col("o_orderdate").alias("ts"), F.lit("me").alias("actor"), F.col("to").alias("objects"), F.lit(None).cast("map<string,string>").alias("traits")))
    return o.select(F.concat(F.lit("o"), "o_orderkey").alias("id"), F.col("o_orderdate").alias("ts"), F.col("o_orderstatus").alias("label"), F.lit("me").alias("observer"), F.col("o_orderpriority").alias("source_id"),
                    F.lit(None).cast("string").alias("session_id"), (F.col("o_orderkey") % 7 != 0).alias("consent"), entities.alias("entities"), relation.alias("relation"))


@query("SELECT obs_id, actor_pk, object_pk, count(*) AS n FROM facts WHERE rel_label = 'ordered' AND CAST(substr(obs_id, 2) AS BIGINT) % 7 <> 0 GROUP BY ALL")
def ingest_facts(m: Memory) -> DataFrame:
    f = ingest.fact_rows(ingest.admitted(nested_observations(m)))
    return f.groupBy("obs_id", "actor_pk", "object_pk").agg(F.count("*").alias("n"))


@query("""SELECT entity_pk, property_name, property_value FROM (SELECT DISTINCT md5(concat('part-', l_partkey)) AS entity_pk, CAST(l_partkey AS VARCHAR) AS i, 'part' AS t FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderkey % 7 <> 0
 UNION SELECT md5(concat('customer-', o_custkey)), CAST(o_custkey AS VARCHAR), 'Customer' FROM orders SEMI JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 7 <> 0), LATERAL (VALUES ('$id', i), ('$type', t), ('$pk', entity_pk)) AS p(property_name, property_value)""")
def ingest_properties(m: Memory) -> DataFrame:
    rows = ingest.entity_properties(ingest.entity_rows(ingest.admitted(nested_observations(m), whole=True)), own=True)
    return rows.select("entity_pk", "property_name", "property_value").distinct()
