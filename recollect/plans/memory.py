"""Memory tables derived from the star schema, once as DataFrames and once as common table expressions of DuckDB."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import entity_pk
from ..sources.tables import divide, read_table


class Memory:
    """Lazily derived tables over one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        divide(spark)

    def raw(self, name: str) -> DataFrame:
        return read_table(self.spark, self.folder, name)

    def observations(self) -> DataFrame:
        return self.raw("orders").select(F.concat(F.lit("o"), "o_orderkey").alias("id"), F.col("o_orderpriority").alias("source_id"), F.col("o_orderstatus").alias("label"), F.col("o_orderdate").alias("ts"))

    def links(self, distinct: bool = True) -> DataFrame:
        """(entity_pk, observation_id, entity_type). Without ``distinct`` an entity that several lines of an order name is there
        as often, and nothing is shuffled."""
        def once(df: DataFrame) -> DataFrame:
            return df.distinct() if distinct else df

        def pairs(df: DataFrame, kind: str, key: str, order: str) -> DataFrame:
            return df.select(entity_pk(F.lit(kind), key).alias("entity_pk"), F.concat(F.lit("o"), order).alias("observation_id"), F.lit(kind).alias("entity_type"))

        items = self.raw("lineitem")
        parts = [pairs(self.raw("orders"), "customer", "o_custkey", "o_orderkey"),
                 pairs(once(items.select("l_partkey", "l_orderkey")), "part", "l_partkey", "l_orderkey"),
                 pairs(once(items.select("l_suppkey", "l_orderkey")), "supplier", "l_suppkey", "l_orderkey")]
        return reduce(DataFrame.unionByName, parts)

    def property_state(self) -> DataFrame:
        def trait(name: str, kind: str, key: str, columns: dict[str, str]) -> DataFrame:
            pairs = F.explode(F.create_map(*[x for n, c in columns.items() for x in (F.lit(n), F.col(c).cast("string"))])).alias("property_name", "v")
            return self.raw(name).select(F.lit(kind).alias("entity_type"), F.col(key).alias("k"), pairs)

        base = reduce(DataFrame.unionByName, [
            trait("customer", "customer", "c_custkey", {"$segment": "c_mktsegment", "$nation": "c_nationkey"}),
            trait("part", "part", "p_partkey", {"$brand": "p_brand", "$type": "p_type", "$size": "p_size"}),
            trait("supplier", "supplier", "s_suppkey", {"$nation": "s_nationkey"})])
        changed = F.struct(F.lit("B").alias("o"), F.concat("v", F.lit("*")).alias("v"), F.when(F.col("k") % 2 == 0, 10).otherwise(-10).alias("d"))
        seen = F.array(F.struct(F.lit("A").alias("o"), F.col("v"), F.lit(0).alias("d")))
        base = base.withColumn("s", F.explode(F.when(F.col("k") % 3 == 0, F.concat(seen, F.array(changed))).otherwise(seen)))
        return base.select(F.col("s.o").alias("observer_pk"), entity_pk("entity_type", "k").alias("entity_pk"), "entity_type", "property_name",
                           F.col("s.v").alias("property_value"), (F.lit(1704067200) + F.col("k") + F.col("s.d")).alias("ts"))

    def gids(self) -> DataFrame:
        c = self.raw("customer").where("c_custkey % 2 = 0")
        return c.select(entity_pk(F.lit("customer"), "c_custkey").alias("entity_pk"), F.md5(F.concat(F.lit("gid-"), "c_nationkey", "c_mktsegment")).alias("entity_gid"))

    def facts(self) -> DataFrame:
        """Orders' lines as facts (customer ordered part) and events as facts (user did)."""
        lines = self.raw("lineitem").join(self.raw("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        ordered = lines.select(
            F.concat(F.lit("l"), "l_orderkey", F.lit("-"), "l_linenumber", F.lit("-"), "l_partkey").alias("rel_id"), F.concat(F.lit("o"), "l_orderkey").alias("obs_id"), F.col("o_orderpriority").alias("source_id"),
            F.lit("ordered").alias("rel_label"), F.lit("customer").alias("actor_type"), entity_pk(F.lit("customer"), "o_custkey").alias("actor_pk"),
            F.lit("part").alias("object_type"), entity_pk(F.lit("part"), "l_partkey").alias("object_pk"), F.col("o_orderdate").alias("ts"))
        e = self.raw("events")
        did = e.select(
            F.concat(F.lit("e"), "event_id").alias("rel_id"), F.concat(F.lit("u"), "user_id").alias("obs_id"), F.lit("web").alias("source_id"), F.col("event_type").alias("rel_label"),
            F.lit("user").alias("actor_type"), entity_pk(F.lit("user"), "user_id").alias("actor_pk"), F.lit(None).cast("string").alias("object_type"), F.lit(None).cast("string").alias("object_pk"), "ts")
        return ordered.unionByName(did)

    def history(self) -> DataFrame:
        """Two versions of each customer and part."""
        def versions(name: str, kind: str, key: str, traits) -> DataFrame:
            v = self.raw(name).withColumn("v", F.explode(F.array(F.lit(0), F.lit(1))))
            pk = entity_pk(F.lit(kind), key)
            return v.select(pk.alias("entity_pk"), F.lit(kind).alias("entity_type"), F.md5(F.concat(pk, F.lit("-"), F.col("v").cast("string"))).alias("data_hash"),
                            F.concat(traits, F.lit(" v"), F.col("v").cast("string")).alias("traits"))

        return versions("customer", "customer", "c_custkey", F.col("c_mktsegment")).unionByName(versions("part", "part", "p_partkey", F.col("p_brand")))

    def versioned_facts(self) -> DataFrame:
        f = self.facts().where(F.col("rel_label") == "ordered")
        for role in ("actor", "object"):
            f = f.withColumn(f"{role}_data_hash", F.md5(F.concat(F.col(f"{role}_pk"), F.lit("-"), (F.length("rel_id") % 2).cast("string"))))
        return f

    def jobs(self) -> DataFrame:
        return self.raw("events").where("event_id % 5 = 0").select(F.concat(F.lit("e"), "event_id").alias("rel_id"), F.lit("trigger-1").alias("job_id"))

    def triggers(self) -> DataFrame:
        return self.raw("events").where("user_id % 4 = 0").groupBy("user_id").agg(F.min("ts").alias("ts_end")).select(F.concat(F.lit("u"), "user_id").alias("obs_id"), F.lit("ended").alias("trigger_id"), "ts_end")

    def texts(self) -> DataFrame:
        return self.raw("documents").select(F.md5("text").alias("id"), F.concat(F.lit("o"), "doc_id").alias("observation_id"), F.col("text").alias("text_string"), "source", "doc_id")

    def versions(self) -> DataFrame:
        """Two versions of each customer, with id, observer and time."""
        v = self.raw("customer").withColumn("v", F.explode(F.array(F.lit(0), F.lit(1))))
        pk = entity_pk(F.lit("customer"), "c_custkey")
        return v.select(pk.alias("entity_pk"), F.col("c_custkey").cast("string").alias("entity_id"), F.md5(F.concat(pk, F.lit("-"), F.col("v").cast("string"))).alias("data_hash"),
                        F.when(F.col("v") == 0, "A").otherwise("B").alias("observer_pk"), (F.lit(1704067200) + F.col("c_custkey") * 10 + F.col("v")).alias("ts"), F.concat("c_mktsegment", F.lit(" v"), F.col("v").cast("string")).alias("traits"))

    def chunked_texts(self) -> DataFrame:
        """Documents as root texts, and a part of each that has a label."""
        d = self.raw("documents").select(F.concat(F.lit("t"), "doc_id").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.col("text").alias("text_string"), (F.col("doc_id") % 2 == 0).alias("chunked"))
        c = self.raw("labels").select(F.concat(F.lit("c"), "doc_id").alias("id"), F.concat(F.lit("t"), "doc_id").alias("parent_id"), F.lit("part").alias("text_string"), F.lit(False).alias("chunked"))
        return d.unionByName(c)


CTES = """obs AS (
  SELECT concat('o', o_orderkey) AS id, o_orderpriority AS source_id, o_orderstatus AS label, o_orderdate AS ts FROM orders),
links AS (
  SELECT md5(concat('customer-', o_custkey)) AS entity_pk, concat('o', o_orderkey) AS observation_id, 'customer' AS entity_type FROM orders
  UNION SELECT md5(concat('part-', l_partkey)), concat('o', l_orderkey), 'part' FROM lineitem
  UNION SELECT md5(concat('supplier-', l_suppkey)), concat('o', l_orderkey), 'supplier' FROM lineitem),
base AS (
  SELECT 'customer' AS t, c_custkey AS k, '$segment' AS n, c_mktsegment AS v FROM customer
  UNION ALL SELECT 'customer', c_custkey, '$nation', CAST(c_nationkey AS VARCHAR) FROM customer
  UNION ALL SELECT 'part', p_partkey, '$brand', p_brand FROM part
  UNION ALL SELECT 'part', p_partkey, '$type', p_type FROM part
  UNION ALL SELECT 'part', p_partkey, '$size', CAST(p_size AS VARCHAR) FROM part
  UNION ALL SELECT 'supplier', s_suppkey, '$nation', CAST(s_nationkey AS VARCHAR) FROM supplier),
state AS (
  SELECT 'A' AS observer_pk, md5(concat(t, '-', k)) AS entity_pk, t AS entity_type, n AS property_name, v AS property_value, 1704067200 + k AS ts FROM base
  UNION ALL SELECT 'B', md5(concat(t, '-', k)), t, n, concat(v, '*'), 1704067200 + k + CASE WHEN k % 2 = 0 THEN 10 ELSE -10 END FROM base WHERE k % 3 = 0),
latest AS (
  SELECT entity_pk, entity_type, property_name, arg_max(property_value, (ts, observer_pk)) AS property_value FROM state GROUP BY ALL),
gids AS (
  SELECT md5(concat('customer-', c_custkey)) AS entity_pk, md5(concat('gid-', c_nationkey, c_mktsegment)) AS entity_gid FROM customer WHERE c_custkey % 2 = 0),
facts AS (
  SELECT concat('l', l_orderkey, '-', l_linenumber, '-', l_partkey) AS rel_id, concat('o', l_orderkey) AS obs_id, o_orderpriority AS source_id, 'ordered' AS rel_label,
         'customer' AS actor_type, md5(concat('customer-', o_custkey)) AS actor_pk, 'part' AS object_type, md5(concat('part-', l_partkey)) AS object_pk, o_orderdate AS ts
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  UNION ALL
  SELECT concat('e', event_id), concat('u', user_id), 'web', event_type, 'user', md5(concat('user-', user_id)), NULL, NULL, ts FROM events),
history AS (
  SELECT md5(concat('customer-', c_custkey)) AS entity_pk, 'customer' AS entity_type, md5(concat(md5(concat('customer-', c_custkey)), '-', v)) AS data_hash, concat(c_mktsegment, ' v', v) AS traits
  FROM customer, (VALUES (0), (1)) AS x(v)
  UNION ALL
  SELECT md5(concat('part-', p_partkey)), 'part', md5(concat(md5(concat('part-', p_partkey)), '-', v)), concat(p_brand, ' v', v) FROM part, (VALUES (0), (1)) AS x(v)),
jobs AS (SELECT concat('e', event_id) AS rel_id, 'trigger-1' AS job_id FROM events WHERE event_id % 5 = 0),
triggers AS (SELECT concat('u', user_id) AS obs_id, 'ended' AS trigger_id, min(ts) AS ts_end FROM events WHERE user_id % 4 = 0 GROUP BY user_id),
texts AS (SELECT md5(text) AS id, concat('o', doc_id) AS observation_id, text AS text_string, source, doc_id FROM documents),
versions AS (
  SELECT md5(concat('customer-', c_custkey)) AS entity_pk, CAST(c_custkey AS VARCHAR) AS entity_id, md5(concat(md5(concat('customer-', c_custkey)), '-', v)) AS data_hash,
         CASE WHEN v = 0 THEN 'A' ELSE 'B' END AS observer_pk, 1704067200 + c_custkey * 10 + v AS ts, concat(c_mktsegment, ' v', v) AS traits FROM customer, (VALUES (0), (1)) AS x(v))
"""
