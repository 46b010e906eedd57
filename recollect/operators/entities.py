"""Reading entities: histories, property results, identities kept up to date, views, and statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.batches import few
from .search import by_properties


def history_of(history: DataFrame, entity_id: str, observer_pk: str | None = None, newest_first: bool = True, limit: int = 25) -> DataFrame:
    """Versions of the entity with this id, by time."""
    h = history.where(F.col("entity_id") == entity_id)
    h = h if observer_pk is None else h.where(F.col("observer_pk") == observer_pk)
    return h.orderBy(F.desc("ts") if newest_first else F.asc("ts"), "entity_pk", "data_hash").limit(limit)


def history_between(history: DataFrame, start, end, where: Column | None = None) -> DataFrame:
    """Versions written within the bounds; page them with ``reads.page``."""
    h = history.where(F.col("ts").between(F.lit(start), F.lit(end)))
    return h if where is None else h.where(where)


def version(history: DataFrame, entity_pk: str, data_hash: str) -> DataFrame:
    return history.where((F.col("entity_pk") == entity_pk) & (F.col("data_hash") == data_hash))


def last_versions(history: DataFrame) -> DataFrame:
    """The newest version of each entity; equal times go to the larger data hash."""
    rest = [c for c in history.columns if c != "entity_pk"]
    return history.groupBy("entity_pk").agg(F.max_by(F.struct(*rest), F.struct("ts", "data_hash")).alias("_v")).select("entity_pk", "_v.*")


def observers_with_name(history: DataFrame, properties: DataFrame) -> DataFrame:
    """Distinct observers of the history with the newest value of their property ``name``, if they have one."""
    observers = history.where(F.col("observer_pk").isNotNull()).select("observer_pk").distinct()
    names = properties.where(F.lower("property_name") == "name").groupBy(F.col("entity_pk").alias("observer_pk")).agg(F.max_by("property_value", F.struct("ts", "property_value")).alias("name"))
    return observers.join(names, "observer_pk", "left")


def property_results(properties: DataFrame, wanted: dict[str | None, list[tuple[str, str]]], observer: str | None = None, number: int = 0, size: int = 30) -> DataFrame:
    """A page of (entity_pk, entity_type, matches, fit, changes, traits): entities of several kinds by how many of the
    properties wanted of their kind they have had (kind None: any), with all changes in the order of time and the last
    values as a map.

    Entities are ranked and paged on counts alone; only the page's properties are gathered.
    """
    found = reduce(DataFrame.unionByName, [by_properties(properties, pairs, kind, observer) for kind, pairs in wanted.items()])
    # an entity that fits under its own kind and under any is one row, by its better fit
    found = found.groupBy("entity_pk", "entity_type").agg(F.max(F.struct("fit", "matches")).alias("b")).select("entity_pk", "entity_type", "b.matches", "b.fit")
    page = found.orderBy(F.desc("fit"), F.desc("matches"), "entity_pk", "entity_type").offset(number * size).limit(size)
    p = properties if observer is None else properties.where(F.col("observer_pk") == observer)
    p = p.join(F.broadcast(page.select("entity_pk").distinct()), "entity_pk", "left_semi")
    rows = p.groupBy("entity_pk").agg(F.array_sort(F.collect_list(F.struct("ts", "property_name", "property_value"))).alias("c"))
    last = p.groupBy("entity_pk", "property_name").agg(F.max_by("property_value", F.struct("ts", "property_value")).alias("v")).groupBy("entity_pk").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("property_name", "v")))).alias("traits"))
    changes = F.transform("c", lambda x: F.concat_ws("=", x["property_name"], x["property_value"])).alias("changes")
    return page.join(rows.select("entity_pk", changes), "entity_pk").join(last, "entity_pk")


def with_property(properties: DataFrame, kind: str, name: str, value: str, observer: str | None = None) -> DataFrame:
    p = properties.where((F.col("entity_type") == kind) & (F.col("property_name") == name) & (F.col("property_value") == value))
    return p if observer is None else p.where(F.col("observer_pk") == observer)


def with_vectors(state: DataFrame, vectors: DataFrame, kinds: list[str]) -> DataFrame:
    """Property values of the kinds that have a vector (value, vector)."""
    own = state.where(F.lower("entity_type").isin([k.lower() for k in kinds]))
    return own.join(vectors, own["property_value"] == vectors["value"]).drop("value")


def state_of_identity(state: DataFrame, gids: DataFrame, gid: str) -> DataFrame:
    """(entity_gid, ts, traits): the last values over all entities of an identity."""
    own = state.join(gids.where(F.col("entity_gid") == gid).select("entity_pk").distinct(), "entity_pk", "left_semi")
    last = own.groupBy("property_name").agg(F.max_by("property_value", F.struct("ts", "observer_pk", "entity_pk")).alias("v"), F.max("ts").alias("ts"))
    return last.agg(F.max("ts").alias("ts"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("property_name", "v")))).alias("traits")).select(F.lit(gid).alias("entity_gid"), "ts", "traits").where("ts is not null")


def watermarks(stitched: DataFrame, properties: DataFrame) -> DataFrame:
    """(stitch_ts, property_ts): how far stitching has come, and the newest property."""
    return stitched.agg(F.max("stitch_ts").alias("stitch_ts")).crossJoin(properties.agg(F.max("ts").alias("property_ts")))


def in_roles(facts: DataFrame, column: str = "type", kind: str | None = None) -> DataFrame:
    """Distinct values of ``actor_<column>`` and ``object_<column>``; with ``kind``, of facts in which it has that role."""
    parts = []
    for role in ("actor", "object"):
        f = facts if kind is None else facts.where(F.col(f"{role}_type") == kind)
        parts.append(f.select(F.col(f"{role}_{column}").alias(column)))
    return parts[0].union(parts[1]).where(F.col(column).isNotNull()).distinct()


def labels_of(facts: DataFrame, kind: str | None = None, role: str | None = None, limit: int | None = None) -> DataFrame:
    """Distinct relation labels, of facts in which the entity type has the role (either, if None)."""
    if kind is not None:
        own = [F.coalesce(F.col(f"{r}_type") == kind, F.lit(False)) for r in (("actor", "object") if role is None else (role,))]
        facts = facts.where(reduce(lambda a, b: a | b, own))
    out = facts.select("rel_label").distinct().orderBy("rel_label")
    return out.limit(limit) if limit is not None else out


def labels_by_role(facts: DataFrame, kind: str) -> DataFrame:
    """Distinct (rel_label, n) of an entity type as actor and as object."""
    one = [facts.where(F.col(f"{r}_type") == kind).groupBy("rel_label").agg(F.count("*").alias("n")) for r in ("actor", "object")]
    return one[0].union(one[1]).distinct()


def over_contexts(tables: list[DataFrame], column: str) -> DataFrame:
    """Distinct values of a column over the tables of several contexts, in order, with a label for reading."""
    values = reduce(DataFrame.union, [t.select(column) for t in tables]).where(F.col(column).isNotNull()).distinct()
    return values.select(column, F.initcap(F.regexp_replace(column, r"[-_]+", " ")).alias("label")).orderBy(column)


def column_values(df: DataFrame, value: Column, limit: int | None = None) -> DataFrame:
    """Distinct values that aren't null, in order: (value)."""
    out = df.select(value.alias("value")).where(F.col("value").isNotNull()).distinct().orderBy("value")
    return out.limit(limit) if limit is not None else out


def counts_by(df: DataFrame, column: str, since: Column | None = None) -> DataFrame:
    """(column, n), of rows that meet the condition."""
    return (df if since is None else df.where(since)).groupBy(column).agg(F.count("*").alias("n"))


def online(facts: DataFrame, since) -> DataFrame:
    """Distinct observations, actors and actor types, and facts since then."""
    return facts.where(F.col("ts") >= F.lit(since).cast("timestamp_ntz")).agg(
        F.count_distinct("obs_id").alias("observations"), F.count_distinct("actor_pk").alias("actors"), F.count_distinct("actor_type").alias("kinds"), F.count("*").alias("facts"))


def with_states(facts: DataFrame, states: DataFrame) -> DataFrame:
    """Facts with the states (entity_pk, traits) of actor and object, if they have any."""
    for role in ("actor", "object"):
        facts = facts.join(states.select(F.col("entity_pk").alias(f"{role}_pk"), F.col("traits").alias(f"{role}_traits")), f"{role}_pk", "left")
    return facts


def with_identity(state: DataFrame, gids: DataFrame) -> DataFrame:
    """Property state with the global identity of its entity, or the entity's own key."""
    return state.join(gids.select("entity_pk", "entity_gid"), "entity_pk", "left").withColumn("identity", F.coalesce("entity_gid", "entity_pk"))


def sample_traits(facts: DataFrame, history: DataFrame, roles: tuple[str, ...] = ("actor", "object", "rel")) -> DataFrame:
    """(role, rel_label, entity_type, n, sample): how often types occur in a role with a label, and the least traits
    seen there. Facts are counted by version before they are joined."""
    parts = [facts.where(F.col(f"{r}_data_hash").isNotNull()).groupBy(F.lit(r).alias("role"), "rel_label", F.col(f"{r}_data_hash").alias("data_hash")).agg(F.count("*").alias("n")) for r in roles if f"{r}_data_hash" in facts.columns]
    found = reduce(DataFrame.unionByName, parts).join(history.select("data_hash", "entity_type", "traits"), "data_hash")
    return found.groupBy("role", "rel_label", "entity_type").agg(F.sum("n").alias("n"), F.min("traits").alias("sample"))


def links_by_observation(links: DataFrame, entity_pks: list[str] | None = None, kinds: list[str] | None = None) -> DataFrame:
    """(observation_id, n, kinds) over the links of these entities or kinds (all, if neither is given)."""
    own = links if entity_pks is None else links.where(F.col("entity_pk").isin(entity_pks))
    own = own if kinds is None else own.where(F.lower("entity_type").isin([k.lower() for k in kinds]))
    return own.groupBy("observation_id").agg(F.count("*").alias("n"), F.count_distinct("entity_type").alias("kinds"))


def in_order(df: DataFrame, column: str, ids: list[str]) -> DataFrame:
    """Rows in the order of the ids given, others last."""
    place = F.array_position(F.array(*map(F.lit, ids)), F.col(column))
    return df.orderBy(F.when(place > 0, place).otherwise(len(ids) + 1), column)


def fitting_routes(events: DataFrame, routes: DataFrame) -> DataFrame:
    """(events' columns, destination): each event with the routes (event_type, source_id, destination) that it fits; a
    null in a route fits all. Routes are configuration, and broadcast if they are few."""
    r = routes.withColumnsRenamed({"event_type": "_type", "source_id": "_source"})
    fits = (F.col("_type").isNull() | (F.col("_type") == F.col("event_type"))) & (F.col("_source").isNull() | (F.col("_source") == F.col("source_id")))
    return events.join(few(r), fits).drop("_type", "_source")


def newest_per_key(df: DataFrame, key: list[str], n: int, ties: list[str] | None = None) -> DataFrame:
    """The n newest rows of each key; equal times go by ``ties``, or else by all other columns that can be ordered."""
    rest = ties or [f.name for f in df.schema.fields if f.name not in (*key, "ts") and f.dataType.typeName() != "map"]
    order = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("ts"), *rest))
    return df.withColumn("_r", order).where(F.col("_r") <= n).drop("_r")
