"""More registered queries: observation and entity reads, texts, nested searches, and what ingestion writes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import filters, scalars
from ..operators import cells, conversations, entities, hierarchy, ingest, observations, postings, reads, search, stitching, texts
from ..operators.search import And, Entity, Not, Or, Property
from ..sources.batches import Batches, shared_folder
from ..streaming import timers
from .memory import Memory
from .queries import BRAND, BUILDING, NEAR, STATE, VERSIONED, nested_observations, pks, query, vector


def pairs_text(name: str = "traits"):
    return F.array_join(F.transform(F.array_sort(F.map_entries(name)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), " ").alias("traits")


@query("SELECT * FROM obs WHERE id IN ('o1', 'o5', 'o7', 'nowhere')")
def obs_by_ids(m: Memory) -> DataFrame:
    return observations.by_ids(m.observations(), ["o1", "o5", "o7", "nowhere"])


@query("SELECT * FROM obs WHERE label = 'F' ORDER BY ts DESC, id LIMIT 100")
def obs_newest(m: Memory) -> DataFrame:
    return observations.newest(m.observations(), where=F.col("label") == "F")


@query("SELECT rel_id, obs_id, rel_label FROM facts WHERE obs_id IN ('o1', 'o5', 'u3') AND (actor_pk IN (md5('user-3'), md5('part-7')) OR object_pk IN (md5('user-3'), md5('part-7')) OR obs_id = 'o1' AND actor_type = 'customer')")
def facts_of_obs(m: Memory) -> DataFrame:
    own = m.facts().where("obs_id = 'o1' and actor_type = 'customer'")
    return observations.facts_of(m.facts(), ["o1", "o5", "u3"], pks("user-3", "part-7")).unionByName(own).select("rel_id", "obs_id", "rel_label").distinct()


@query("SELECT rel_id, rel_label FROM facts WHERE actor_type = 'customer' AND actor_pk = md5('customer-7') AND ts > TIMESTAMP '1998-01-01' - INTERVAL 365 DAY AND ts <= TIMESTAMP '1998-01-01'")
def facts_in_days(m: Memory) -> DataFrame:
    return observations.facts_of_entities(m.facts(), pks("customer-7"), now="1998-01-01", days=365).select("rel_id", "rel_label")


@query(VERSIONED + " SELECT DISTINCT rel_id, rel_label, ts FROM vf WHERE ah = md5(concat(md5('customer-7'), '-', 1)) OR oh = md5(concat(md5('customer-7'), '-', 1)) ORDER BY ts DESC, rel_id LIMIT 100")
def facts_by_version(m: Memory) -> DataFrame:
    import hashlib

    return observations.facts_by_data_hash(m.versioned_facts(), hashlib.md5(f"{pks('customer-7')[0]}-1".encode()).hexdigest())


@query("SELECT rel_id FROM facts WHERE obs_id NOT IN ('o1', 'o5')")
def facts_after_deletion(m: Memory) -> DataFrame:
    return observations.without(m.facts(), "obs_id", ["o1", "o5"]).select("rel_id")


@query(", " + STATE + " SELECT observation_id, entity_pk, entity_type, traits FROM links LEFT JOIN st USING (entity_pk)")
def obs_entities_state(m: Memory) -> DataFrame:
    state = search.entity_state(m.property_state())
    return observations.entities_with_state(m.links(), state).select("observation_id", "entity_pk", "entity_type", pairs_text())


@query("SELECT data_hash, versions.ts FROM versions WHERE observer_pk = 'B' AND entity_pk IN (SELECT entity_pk FROM links WHERE observation_id = 'o7')")
def obs_entities_of_observer(m: Memory) -> DataFrame:
    return observations.entities_for_observer(m.links(), m.versions(), "o7", "B").select("data_hash", "ts")


@query("""SELECT id, (SELECT string_agg(e.entity_pk || ':' || n, ' ' ORDER BY e.entity_pk) FROM (SELECT l.observation_id, l.entity_pk, count(d.t) AS n FROM links l
  LEFT JOIN (SELECT DISTINCT md5(concat('customer-', doc_id)) AS entity_pk, text AS t FROM documents) d ON l.entity_pk = d.entity_pk GROUP BY ALL) e WHERE e.observation_id = obs.id) AS entities,
  (SELECT count(*) FROM facts WHERE obs_id = obs.id) AS facts FROM obs""")
def obs_nested(m: Memory) -> DataFrame:
    """Keys of entities are shuffled as the 16 bytes that they are, not as texts of 32; bytes have the texts' order."""
    def short(df: DataFrame) -> DataFrame:
        return df.withColumn("entity_pk", F.unhex("entity_pk"))

    said = m.raw("documents").select(F.md5(F.concat(F.lit("customer-"), "doc_id")).alias("entity_pk"), F.lit(texts.OBSERVATION).alias("origin"), "text")
    own = observations.entities_with_state(short(m.links(distinct=False)), search.entity_state(short(m.property_state())))
    found = observations.nested(m.observations(), own, short(said), m.facts())
    each = F.transform("entities", lambda e: F.concat(F.lower(F.hex(e["entity_pk"])), F.lit(":"), F.size(e["descriptions"]).cast("string")))
    return found.select("id", F.array_join(each, " ").alias("entities"), F.size("facts").cast("long").alias("facts"))


@query(VERSIONED + """ SELECT rel_id, a.traits AS actor_traits, o.traits AS object_traits, r.traits AS rel_traits FROM vf LEFT JOIN history a ON vf.actor_pk = a.entity_pk AND ah = a.data_hash
  LEFT JOIN history o ON vf.object_pk = o.entity_pk AND oh = o.data_hash LEFT JOIN history r ON r.entity_pk = vf.object_pk AND r.data_hash = ah""")
def facts_three_versions(m: Memory) -> DataFrame:
    f = m.versioned_facts().withColumn("rel_pk", F.col("object_pk")).withColumn("rel_data_hash", F.col("actor_data_hash"))
    return observations.with_trait_versions(f, m.history()).select("rel_id", "actor_traits", "object_traits", "rel_traits")


@query("SELECT DISTINCT observation_id, ts FROM texts JOIN obs ON obs.id = observation_id WHERE contains(lower(text_string), 'license') AND ts >= TIMESTAMP '1995-01-01' AND ts <= TIMESTAMP '1997-01-01'")
def fulltext_in_time(m: Memory) -> DataFrame:
    bounds = [F.lit(f"{y}-01-01").cast("timestamp_ntz") for y in (1995, 1997)]
    return observations.full_text(m.texts(), "License", m.observations(), *bounds)


@query("SELECT data_hash, observer_pk, ts FROM versions WHERE entity_id = '7' ORDER BY ts DESC LIMIT 25")
def history_of_entity(m: Memory) -> DataFrame:
    return entities.history_of(m.versions(), "7").select("data_hash", "observer_pk", "ts")


@query("SELECT entity_pk, arg_max(traits, (ts, data_hash)) AS traits, max(ts) AS ts FROM versions GROUP BY ALL")
def last_versions(m: Memory) -> DataFrame:
    return entities.last_versions(m.versions()).select("entity_pk", "traits", "ts")


@query("SELECT DISTINCT observer_pk, CASE WHEN observer_pk = 'A' THEN 'first' END AS name FROM versions")
def observers_named(m: Memory) -> DataFrame:
    names = m.spark.sql("SELECT 'A' AS entity_pk, 'Name' AS property_name, v AS property_value, t AS ts FROM VALUES ('old', 1), ('first', 2) AS x(v, t)")
    return entities.observers_with_name(m.versions(), names)


@query("""SELECT entity_pk, entity_type, matches, matches / n AS fit, changes FROM (SELECT entity_pk, entity_type, count(*) AS matches, 2.0::DOUBLE AS n FROM state WHERE entity_type = 'part' AND ((property_name = '$brand' AND lower(property_value) = 'brand#3')
   OR (property_name = '$size' AND try_cast(property_value AS DOUBLE) = 10)) GROUP BY ALL UNION ALL SELECT entity_pk, entity_type, count(*), 1.0 FROM state WHERE entity_type = 'customer' AND property_name = '$segment' AND lower(property_value) = 'building' GROUP BY ALL) f
  JOIN (SELECT entity_pk, string_agg(property_name || '=' || property_value, ' ' ORDER BY ts, property_name, property_value) AS changes FROM state GROUP BY entity_pk) USING (entity_pk) ORDER BY fit DESC, matches DESC, entity_pk LIMIT 30""")
def property_results(m: Memory) -> DataFrame:
    found = entities.property_results(m.property_state(), {"part": [("$brand", "Brand#3"), ("$size", "10")], "customer": [("$segment", "Building")]})
    return found.select("entity_pk", "entity_type", "matches", "fit", F.array_join("changes", " ").alias("changes"))


IDENTITY = "s AS (SELECT state.*, coalesce(entity_gid, state.entity_pk) AS identity FROM state LEFT JOIN gids USING (entity_pk))"


@query(f""", {IDENTITY}, l AS (SELECT property_name, arg_max(property_value, (ts, observer_pk, entity_pk)) AS v, max(ts) AS ts FROM s WHERE identity = (SELECT min(entity_gid) FROM gids) GROUP BY ALL)
 SELECT (SELECT min(entity_gid) FROM gids) AS entity_gid, max(ts) AS ts, string_agg(property_name || '=' || v, ' ' ORDER BY property_name) AS traits FROM l""")
def identity_state(m: Memory) -> DataFrame:
    gid = m.gids().agg(F.min("entity_gid")).first()[0]
    return entities.state_of_identity(m.property_state(), m.gids(), gid).select("entity_gid", "ts", pairs_text())


@query(f""", {IDENTITY}, l AS (SELECT identity, property_name, arg_max(property_value, (ts, observer_pk, entity_pk)) AS v, max(ts) AS ts FROM s GROUP BY ALL)
 SELECT identity, max(ts) AS ts, string_agg(property_name || '=' || v, ' ' ORDER BY property_name) AS traits FROM l GROUP BY identity""")
def restitched_entities(m: Memory) -> DataFrame:
    """Taken in three batches, dealt by hash and not by time, so rows come late: first all entities have another identity,
    then some get their own gid and others lose the one they had."""
    store, state = Batches(m.spark, shared_folder(m.spark, "stitched")), m.property_state()

    def part(df: DataFrame, n: int) -> DataFrame:
        return df.where(F.pmod(F.xxhash64("entity_pk", "property_name"), F.lit(3)) == n)

    every = state.select("entity_pk").distinct()
    first = every.select("entity_pk", F.concat(F.lit("first-"), F.substring("entity_pk", 1, 1)).alias("entity_gid"), F.lit(1).cast("long").alias("ts"))
    given = m.gids().select("entity_pk", "entity_gid", F.lit(2).cast("long").alias("ts"))
    lost = every.join(given, "entity_pk", "left_anti").select("entity_pk", F.lit(None).cast("string").alias("entity_gid"), F.lit(2).cast("long").alias("ts"))
    for n, gids in enumerate((first, given, lost)):
        stitching.stitch(store, n, part(state, n), gids)
    return stitching.view(store).select("identity", "ts", pairs_text())


@query("SELECT (SELECT max(ts) FROM versions) AS stitch_ts, (SELECT max(ts) FROM state) AS property_ts")
def stitching_marks(m: Memory) -> DataFrame:
    return entities.watermarks(m.versions().withColumn("stitch_ts", F.col("ts")), m.property_state())


@query("SELECT actor_type AS type FROM facts UNION SELECT object_type FROM facts WHERE object_type IS NOT NULL")
def types_in_roles(m: Memory) -> DataFrame:
    return entities.in_roles(m.facts())


@query("SELECT DISTINCT rel_label FROM facts WHERE actor_type = 'user' OR object_type = 'user' ORDER BY rel_label LIMIT 100")
def labels_of_type(m: Memory) -> DataFrame:
    return entities.labels_of(m.facts(), "user", limit=100)


@query("SELECT t AS type, upper(t[1]) || substr(t, 2) AS label FROM (SELECT 'customer' AS t UNION SELECT event_type FROM events)", ctes=False)
def types_over_contexts(m: Memory) -> DataFrame:
    one, other = m.raw("events").select(F.col("event_type").alias("type")), m.raw("customer").select(F.lit("customer").alias("type"))
    return entities.over_contexts([one, other], "type")


@query("SELECT DISTINCT c_mktsegment AS value FROM customer", ctes=False)
def column_values(m: Memory) -> DataFrame:
    return entities.column_values(m.raw("customer"), F.col("c_mktsegment"))


@query("SELECT md5(text) AS id, min(concat('o', doc_id)) AS observation_id, 1 AS origin, min(doc_id) AS ts FROM documents WHERE length(trim(text)) > 0 GROUP BY text", ctes=False)
def text_rows(m: Memory) -> DataFrame:
    rows = m.raw("documents").select(F.concat(F.lit("o"), "doc_id").alias("observation_id"), "text", F.col("doc_id").alias("ts"))
    return texts.text_rows(rows).select("id", "observation_id", "origin", "ts")


@query(r"""SELECT 't' || doc_id AS parent_id, CAST(p AS INTEGER) AS place, md5(array_to_string(w[p * 90 + 1:p * 90 + 100], ' ')) AS id FROM (SELECT doc_id, w, unnest(range(0, (len(w) - 11) // 90 + 1)) AS p
  FROM (SELECT doc_id, regexp_extract_all(text, '[^ \t\n\x0B\f\r]+') AS w FROM documents) WHERE len(w) > 100)""", ctes=False)
def text_chunks(m: Memory) -> DataFrame:
    return texts.chunks(m.chunked_texts().where("parent_id is null"), words=100, overlap=10).select("parent_id", "place", "id")


@query("SELECT DISTINCT property_value AS value FROM state WHERE property_value NOT IN (SELECT concat('Brand#', vec_id) FROM embeddings)")
def values_not_embedded(m: Memory) -> DataFrame:
    return texts.values_not_embedded(m.property_state(), m.raw("embeddings").select(F.concat(F.lit("Brand#"), "vec_id").alias("value")))


@query("SELECT concat('t', doc_id) AS id FROM documents WHERE doc_id % 2 <> 0 AND length(text) >= 10", ctes=False)
def texts_to_chunk(m: Memory) -> DataFrame:
    return texts.to_chunk(m.chunked_texts(), 10).select("id")


def embedded_texts(m: Memory) -> DataFrame:
    return m.raw("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


@query(f", near AS {NEAR.format(q=0, k=10)} SELECT vec_id AS id, round(similarity, 6) AS similarity, obs.id AS observation_id, label FROM near JOIN obs ON obs.id = concat('o', vec_id) WHERE similarity >= 0.2")
def semantic_obs(m: Memory) -> DataFrame:
    own = m.raw("embeddings").select(F.col("vec_id").alias("id"), F.concat(F.lit("o"), "vec_id").alias("observation_id"))
    found = texts.semantic(own, embedded_texts(m), vector(m, 0), 0.2, 10, m.observations())
    return found.select("id", F.round("similarity", 6).alias("similarity"), "observation_id", "label")


BM25 = r"""w AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
 n AS (SELECT id, len(w) AS l, len(list_filter(w, lambda x: x = 'data')) AS a, len(list_filter(w, lambda x: x = 'license')) AS b FROM w),
 t AS (SELECT count(*) AS c, avg(l) AS m, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM n),
 r AS (SELECT id, ln(1 + (c - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * l / m)) + ln(1 + (c - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * l / m)) AS score FROM n, t)"""


@query(f"WITH {BM25} SELECT id, round(score, 6) AS score FROM r WHERE score > 0 ORDER BY round(score, 9) DESC, id LIMIT 20", ctes=False)
def lexical_search(m: Memory) -> DataFrame:
    found = texts.bm25(m.raw("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("text_string")), "license data", limit=None)
    return found.orderBy(F.desc(F.round("score", 9)), "id").limit(20).withColumn("score", F.round("score", 6))


@query(f"WITH {BM25} SELECT id, round(score, 6) AS score FROM r WHERE score > 0 ORDER BY round(score, 9) DESC, id LIMIT 20", ctes=False)
def lexical_index_search(m: Memory) -> DataFrame:
    """The same from stored postings, which a second batch has brought up to date: a third of the texts were others before."""
    store, d = Batches(m.spark, shared_folder(m.spark, "postings")), m.raw("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("text_string"))
    postings.add(store, 0, d.where("id % 3 <> 1").withColumn("text_string", F.when(F.col("id") % 3 == 0, F.lit("license data of earlier days")).otherwise(F.col("text_string"))))
    postings.add(store, 1, d.where("id % 3 <> 2"))
    found = postings.search(store, "license data", limit=None)
    return found.orderBy(F.desc(F.round("score", 9)), "id").limit(20).withColumn("score", F.round("score", 6))


@query(f"""WITH {BM25}, x AS (SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rk FROM r WHERE score > 0 QUALIFY rk <= 150),
  d AS (SELECT vec_id AS id, row_number() OVER (ORDER BY similarity DESC, vec_id) AS rk FROM {NEAR.format(q=0, k=150)})
 SELECT id, round(sum(1.0::DOUBLE / (60 + rk)), 9) AS score FROM (SELECT * FROM x UNION ALL SELECT * FROM d) GROUP BY id ORDER BY sum(1.0::DOUBLE / (60 + rk)) DESC, id LIMIT 10""", ctes=False)
def hybrid_search(m: Memory) -> DataFrame:
    words = texts.bm25(m.raw("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("text_string")), "license data", limit=None)
    words = words.select("id", F.round("score", 9).alias("similarity")).orderBy(F.desc("similarity"), "id").limit(150)
    dense = reads.similar(m.raw("embeddings"), vector(m, 0), 150, -1.0).withColumnRenamed("vec_id", "id")
    return reads.rank_fusion([words, dense], "id").withColumn("score", F.round("score", 9))


@query("""WITH u AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT vec_id AS c, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id < 8),
 s AS (SELECT id, concat('class', c) AS class, list_cosine_similarity(u.v, p.v) AS score FROM u, p)
 SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY round(score, 9) DESC, class) AS INTEGER) AS rank, class, round(score, 6) AS score FROM s QUALIFY rank <= 3""", ctes=False)
def classified_vectors(m: Memory) -> DataFrame:
    classes = m.raw("embeddings").where("vec_id < 8").select(F.concat(F.lit("class"), "vec_id").alias("class"), F.col("embedding").alias("prototype"))
    return texts.classified(embedded_texts(m), classes, 3).withColumn("score", F.round("score", 6))


SUPPLIER = Entity("supplier", (Property("$nation", "3"),))


def one_sql(e: Entity) -> str:
    hit = " OR ".join(f"(property_name = '{p.name}' AND lower(property_value) = '{p.value.lower()}')" for p in e.properties)
    return f"(SELECT DISTINCT observation_id FROM links JOIN latest USING (entity_pk) WHERE latest.entity_type = '{e.kind}' AND ({hit}))"


@query(f" SELECT DISTINCT id AS observation_id FROM obs WHERE (id IN {one_sql(BUILDING)} AND id IN {one_sql(BRAND)}) OR (id IN {one_sql(SUPPLIER)} AND id NOT IN {one_sql(BUILDING)})")
def eql_tree(m: Memory) -> DataFrame:
    tree = Or((And((BUILDING, BRAND)), And((SUPPLIER, Not(BUILDING)))))
    return search.matching(m.property_state(), m.links(), tree, m.observations().select(F.col("id").alias("observation_id")))


@query(f" SELECT DISTINCT id AS observation_id FROM obs WHERE id NOT IN {one_sql(BUILDING)}")
def eql_not(m: Memory) -> DataFrame:
    return search.matching(m.property_state(), m.links(), Not(BUILDING), m.observations().select(F.col("id").alias("observation_id")))


PARTS = """o AS (SELECT DISTINCT o_orderkey AS k, o_custkey AS c, o_orderdate AS ts, o_orderstatus AS label, o_orderpriority AS s FROM orders SEMI JOIN lineitem ON l_orderkey = o_orderkey),
 e AS (SELECT DISTINCT k, ts, s, 'part' AS t, l_partkey AS i FROM o JOIN lineitem ON l_orderkey = k UNION ALL SELECT k, ts, s, 'Customer', c FROM o)"""


def entity_rows(m: Memory) -> DataFrame:
    return ingest.entity_rows(nested_observations(m))


@query(f"""WITH {PARTS} SELECT md5(lower(t) || '-' || i) AS entity_pk, md5('$type=' || t) AS data_hash, md5(md5(lower(t) || '-' || i) || '-' || md5('$type=' || t)) AS entity_hid, max(epoch(ts))::BIGINT AS ts FROM e GROUP BY t, i""", ctes=False)
def ingest_history(m: Memory) -> DataFrame:
    return ingest.history_rows(entity_rows(m)).select("entity_pk", "data_hash", "entity_hid", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("ts"))


@query(f"WITH {PARTS} SELECT concat('o', k) AS id, any_value(s) AS source_id, count(*)::INTEGER AS entities FROM e GROUP BY k", ctes=False)
def ingest_observations(m: Memory) -> DataFrame:
    return ingest.observation_rows(nested_observations(m)).select("id", "source_id", "entities")


@query(f"WITH {PARTS} SELECT DISTINCT concat('o', k) AS observation_id, CAST(i AS VARCHAR) AS entity_id, md5(lower(t) || '-' || i) AS entity_pk, md5('$type=' || t) AS entity_data_hash FROM e", ctes=False)
def ingest_observation_entities(m: Memory) -> DataFrame:
    return ingest.observation_entities(entity_rows(m)).select("observation_id", "entity_id", "entity_pk", "entity_data_hash")


@query(f"WITH {PARTS} SELECT md5(lower(t) || '-' || i) AS entity_pk, md5('customer-' || lower(t)) AS entity_gid, max(epoch(ts))::BIGINT AS ts FROM e WHERE t = 'Customer' GROUP BY t, i", ctes=False)
def ingest_gids(m: Memory) -> DataFrame:
    return ingest.gid_rows(entity_rows(m), {"customer": ("$type",)}).select("entity_pk", "entity_gid", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("ts"))


@query(f"WITH {PARTS} SELECT md5(concat('o', k, '-', md5(concat('customer-', c)), '-ordered')) AS entity_pk, concat('o', k) AS obs_id, (SELECT count(*) FROM lineitem WHERE l_orderkey = k) AS objects FROM o", ctes=False)
def ingest_events(m: Memory) -> DataFrame:
    return ingest.event_rows(ingest.fact_rows(nested_observations(m))).select("entity_pk", "obs_id", "objects")


@query("SELECT DISTINCT md5(concat(md5(concat('customer-', o_custkey)), '-ordered-', md5(concat('part-', l_partkey)))) AS id, 1 AS status, 60 AS timeout FROM lineitem JOIN orders ON l_orderkey = o_orderkey", ctes=False)
def ingest_timers(m: Memory) -> DataFrame:
    due = m.spark.sql("SELECT 'ordered' AS rel_label, 60 AS timeout, 'remind' AS event")
    return ingest.timer_rows(ingest.fact_rows(nested_observations(m)), due).select("id", "status", "timeout")


@query("SELECT observer_pk, entity_pk, property_name, property_value, min(ts) AS since, max(ts) AS ts, count(*) AS count FROM state GROUP BY ALL")
def ingest_property_history(m: Memory) -> DataFrame:
    return ingest.property_history(m.property_state()).drop("entity_type")


@query(f"WITH {PARTS} SELECT DISTINCT concat('o', k) AS observation_id, md5(lower(t) || '-' || i) AS entity_pk FROM e WHERE k % 3 = 0", ctes=False)
def ingest_without_relations(m: Memory) -> DataFrame:
    o = nested_observations(m).withColumn("relation", F.when(F.substr("id", F.lit(2)).cast("long") % 3 != 0, F.col("relation")))
    return ingest.entity_payloads(o).select("observation_id", "entity_pk")


@query(f"""WITH {PARTS}, n AS (SELECT k, count(*) AS lines FROM o JOIN lineitem ON l_orderkey = k GROUP BY k)
 SELECT concat('o', o.k) AS id, o.s AS source_id, o.k % 7 <> 0 AS consent, 2 AS relations, (SELECT string_agg(i || ':' || 'b1', ' ' ORDER BY i || ':') FROM (SELECT DISTINCT i FROM e WHERE e.k = o.k AND t = 'part')) AS parts FROM o""", ctes=False)
def merged_observations(m: Memory) -> DataFrame:
    """Each observation twice, a day apart: the newer copy changes one trait of its parts and adds another."""
    o = nested_observations(m)

    def parts(value: str, **traits):
        made = F.map_from_arrays(F.array(*map(F.lit, traits)), F.array(*map(F.lit, traits.values())))
        return o.withColumn("entities", F.transform_values("entities", lambda k, e: F.when(k == "me", e).otherwise(e.withField("traits", made)))).withColumn("label", F.lit(value))

    newer = parts("new", a="1", b="1").withColumn("ts", F.expr("ts + INTERVAL 1 DAY")).withColumn("consent", F.lit(True))
    found = ingest.merge_observations(parts("old", b="0", c="2").unionByName(newer))
    each = F.transform(F.filter(F.map_entries("entities"), lambda e: e["key"] != "me"), lambda e: F.concat(e["value"]["id"], F.lit(":b"), F.when((e["value"]["traits"]["a"] == "1") & (e["value"]["traits"]["c"] == "2"), e["value"]["traits"]["b"])))
    return found.where("label = 'new'").select("id", "source_id", "consent", F.size("relation").alias("relations"), F.array_join(F.array_sort(each), " ").alias("parts"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS id, 1 AS depth, concat(r_name, '/', n_name) AS path FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 1000 + r_regionkey, 0, r_name FROM region", ctes=False)
def taxonomy_paths(m: Memory) -> DataFrame:
    tree = m.raw("region").select((F.col("r_regionkey") + 1000).cast("long").alias("id"), F.lit(None).cast("long").alias("parent_id"), F.col("r_name").alias("name"))
    return hierarchy.paths(tree.unionByName(m.raw("nation").select(F.col("n_nationkey").cast("long").alias("id"), (F.col("n_regionkey") + 1000).cast("long").alias("parent_id"), F.col("n_name").alias("name"))))


@query("SELECT event_id, d AS destination FROM events, (VALUES ('click', NULL, 'a'), (NULL, 'web', 'b'), (NULL, 'app', 'c')) AS r(t, s, d) WHERE (t IS NULL OR t = event_type) AND (s IS NULL OR s = 'web')", ctes=False)
def event_routes(m: Memory) -> DataFrame:
    e = m.raw("events").withColumn("source_id", F.lit("web"))
    routes = m.spark.sql("SELECT * FROM VALUES ('click', NULL, 'a'), (NULL, 'web', 'b'), (NULL, 'app', 'c') AS r(event_type, source_id, destination)")
    return entities.fitting_routes(e, routes).select("event_id", "destination")


@query("SELECT event_id, CASE WHEN event_type = 'click' AND coalesce(user_id % 2 <> 0, true) THEN 'even' ELSE '' END AS failed FROM events", ctes=False)
def event_validation(m: Memory) -> DataFrame:
    found = ingest.valid_events(m.raw("events"), {"click": [("even", F.col("user_id") % 2 == 0)]}, "event_type")
    return found.select("event_id", F.array_join("failed", ",").alias("failed"))


@query("SELECT event_id, CASE WHEN event_type = 'click' THEN concat('kind=click who=', user_id) ELSE concat('type=', event_type, ' user=', user_id, ' x=1') END AS traits FROM events", ctes=False)
def event_reshaping(m: Memory) -> DataFrame:
    e = m.raw("events").select("event_id", "event_type", F.map_from_arrays(F.array(F.lit("type"), F.lit("user"), F.lit("x")), F.array(F.col("event_type"), F.col("user_id").cast("string"), F.lit("1"))).alias("traits"))
    shaped = ingest.reshaped(e, [(F.col("event_type") == "click", {"kind": "type", "who": "user", "none": "nothing"}, ["x"])])
    click = F.col("event_type") == "click"
    order = F.when(click, F.array(F.lit("kind"), F.lit("who"))).otherwise(F.array(F.lit("type"), F.lit("user"), F.lit("x")))
    return shaped.select("event_id", F.when(F.size("traits") == F.size(order), F.array_join(F.transform(order, lambda k: F.concat(k, F.lit("="), F.try_element_at("traits", k))), " ")).alias("traits"))


@query("""SELECT c_custkey, lower(c_name[1:1]) || 'ustomer' || regexp_extract(c_name, '[0-9]+') AS camel, false AS url, concat('seg of ', c_mktsegment, ', N/A') AS text FROM customer""", ctes=False)
def scalar_names(m: Memory) -> DataFrame:
    c = m.raw("customer")
    text = scalars.fill_template('{{seg ? "seg of %s"}}, {{none}}', {"seg": F.col("c_mktsegment")})
    return c.select("c_custkey", scalars.camel_case("c_name").alias("camel"), scalars.is_url("c_name").alias("url"), text.alias("text"))


@query("""WITH s AS (SELECT conv_id, 0 AS till, concat('sum ', conv_id) AS summary FROM conversations GROUP BY conv_id HAVING conv_id % 2 = 0),
 n AS (SELECT c.conv_id, count(*) AS turns, string_agg(coalesce(text, ''), chr(10) ORDER BY turn, text) AS said FROM conversations c LEFT JOIN s USING (conv_id) WHERE till IS NULL OR turn > till GROUP BY c.conv_id)
 SELECT conv_id, coalesce(turns, 0) AS turns, md5(concat_ws(chr(10), summary, said)) AS memory, CAST(length(concat_ws(chr(10), summary, said)) AS BIGINT) AS chars, length(concat_ws(chr(10), summary, said)) > 300 AS compress
 FROM s FULL JOIN n USING (conv_id)""", ctes=False)
def conversation_memories(m: Memory) -> DataFrame:
    c = m.raw("conversations")
    s = c.where("conv_id % 2 = 0").select("conv_id", F.lit(0).cast("long").alias("turn"), F.concat(F.lit("sum "), "conv_id").alias("summary")).distinct()
    return conversations.memories(c, s, "conv_id", "turn", "text", most=300).select("conv_id", "turns", F.md5("memory").alias("memory"), "chars", "compress")


@query("SELECT event_id FROM events WHERE event_type IS NOT NULL AND (user_id IN (1, 2, 3) OR event_type <> 'click')", ctes=False)
def filtered_events(m: Memory) -> DataFrame:
    kind, user = F.col("event_type"), F.col("user_id")
    return m.raw("events").where(filters.equals(kind, "*") & (filters.equals(user, [1, 2, 3]) | filters.differs(kind, "click"))).select("event_id")


def through_stream(m: Memory, table: str, made) -> DataFrame:
    """All that a stream over a table's files gives, once they are read."""
    folder, source = shared_folder(m.spark, "stream"), m.raw(table)
    rows = m.spark.readStream.schema(source.schema).parquet(f"{m.folder}/{table}.parquet*")  # a pattern, for the table may be one file
    store = Batches(m.spark, f"{folder}/out")
    q = made(rows).writeStream.foreachBatch(lambda df, n: store.commit(n, {"rows": df})).outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return store.read("rows")


@query("SELECT concat('u', user_id) AS obs_id, max(ts) AS ts FROM events GROUP BY user_id HAVING max(ts) + INTERVAL 60 MINUTE <= (SELECT max(ts) FROM events)", ctes=False)
def ended_observations_stream(m: Memory) -> DataFrame:
    ended = through_stream(m, "events", lambda e: timers.ended_observations(e.select(F.concat(F.lit("u"), "user_id").alias("obs_id"), "ts"), 60, "0 seconds"))
    return ended.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("""SELECT concat('t', o_custkey) AS id, max(o_orderdate) AS ts, arg_max(concat('o', o_orderkey), (o_orderdate, concat('o', o_orderkey))) AS obs_id FROM orders GROUP BY o_custkey
 HAVING max(o_orderdate) + to_seconds(o_custkey % 1000 * 600) <= (SELECT max(o_orderdate) FROM orders)""", ctes=False)
def fired_timers_stream(m: Memory) -> DataFrame:
    """A timer for each customer, set anew by each order."""
    own = lambda o: o.select(F.concat(F.lit("t"), "o_custkey").alias("id"), F.col("o_orderdate").alias("ts"), (F.col("o_custkey") % 1000 * 600).alias("timeout"), F.lit("due").alias("event"),
                             F.concat(F.lit("o"), "o_orderkey").alias("obs_id"), F.lit(None).cast("string").alias("actor_pk"), F.lit(None).cast("string").alias("object_pk"))
    fired = through_stream(m, "orders", lambda o: timers.fired_timers(own(o), "0 seconds"))
    return fired.select("id", F.col("ts").cast("timestamp_ntz").alias("ts"), "obs_id")


@query("SELECT vec_id, round(similarity, 6) AS similarity FROM " + NEAR.format(q=0, k=10), ctes=False)
def vector_index_search(m: Memory) -> DataFrame:
    """The nearest vectors from an index of cells, which two batches made; exact, though cells out of reach aren't read."""
    store, e = Batches(m.spark, shared_folder(m.spark, "cells")), m.raw("embeddings")
    cells.add(store, 0, e.where("vec_id % 3 <> 0"))
    cells.add(store, 1, e.where("vec_id % 3 = 0"))
    return cells.search(store, vector(m, 0), 10, -1.0).select(F.col("id").alias("vec_id"), F.round("similarity", 6).alias("similarity"))
