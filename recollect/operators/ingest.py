"""From nested observations to flat rows: facts, links, properties, merged observations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import entity_pk, property_id, session_slot, text_of, traits_hash, triplet_id, version_id
from ..functions.scalars import merged
from ..sources.batches import few

#: What ingestion reads; traits are flattened maps of text.
OBSERVATION = """id string, ts timestamp_ntz, label string, observer string, source_id string, session_id string, consent boolean,
 entities map<string, struct<kind: string, id: string, traits: map<string, string>>>,
 relation array<struct<label: string, ts: timestamp_ntz, actor: string, objects: array<string>, traits: map<string, string>>>"""


def judged(observations: DataFrame, agents: DataFrame | None = None, bots: str = r"(?i)bot|crawler|spider", whole: bool = False) -> DataFrame:
    """``observations`` with ``refused``, the first reason against each, or null: no id, no consent, a reserved source
    (``@``), an observer that isn't an entity; if ``whole``, a link to an entity that isn't there; an automaton, if
    ``agents`` (id, agent) tells who sent it."""
    names = F.map_keys("entities")
    known = F.col("observer").isNull() | F.array_contains(names, F.col("observer"))
    asked = F.transform("relation", lambda r: F.concat(F.array(r["actor"]), F.coalesce(r["objects"], F.array().cast("array<string>"))))
    linked = F.forall(F.flatten(F.coalesce(asked, F.array().cast("array<array<string>>"))), lambda x: x.isNull() | F.array_contains(names, x))
    reasons = [(F.col("id").isNull(), "no id"), (~F.coalesce(F.col("consent"), F.lit(True)), "no consent"), (F.coalesce(F.col("source_id").startswith("@"), F.lit(False)), "reserved source"),
               (~F.coalesce(known, F.lit(False)), "unknown observer")]
    reasons += [(~F.coalesce(linked, F.lit(True)), "unknown link")] if whole else []
    out = observations
    if agents is not None:
        out = out.join(agents.where(F.col("agent").rlike(bots)).select("id", F.lit(True).alias("_bot")).distinct(), "id", "left").select(*observations.columns, "_bot")
        reasons.append((F.col("_bot").isNotNull(), "automaton"))
    return out.withColumn("refused", F.coalesce(*[F.when(condition, F.lit(reason)) for condition, reason in reasons])).drop("_bot")


def admitted(observations: DataFrame, agents: DataFrame | None = None, bots: str = r"(?i)bot|crawler|spider", whole: bool = False) -> DataFrame:
    """Observations against which ``judged`` has no reason."""
    return judged(observations, agents, bots, whole).where(F.col("refused").isNull()).drop("refused")


def parsed(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Observations of JSON texts, with the text in ``payload`` and in ``broken`` whether it isn't JSON of their form. A
    payload that is null, cut off or of another form gives a row of nulls that is broken, so no payload is lost."""
    form = ", ".join([OBSERVATION, "_broken string"])
    read = F.from_json(payload, form, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    o = payloads.select(F.col(payload).alias("payload"), read.alias("o"))
    return o.select("o.*", "payload").withColumn("broken", F.col("_broken").isNotNull() | F.col("payload").isNull() | (F.trim("payload") == "")).drop("_broken")


def dead_letters(observations: DataFrame) -> DataFrame:
    """(payload, reason) of what isn't admitted, of ``judged`` observations; where no text came with them, one is made."""
    made = F.to_json(F.struct(*[c for c in observations.columns if c not in ("payload", "broken", "refused")]))
    text = F.col("payload") if "payload" in observations.columns else made
    return observations.where(F.col("refused").isNotNull()).select(text.alias("payload"), F.col("refused").alias("reason"))


def of_known_sources(observations: DataFrame, sources: DataFrame) -> DataFrame:
    """Observations whose source is one of ``sources`` (source_id, enabled) that are on."""
    return observations.join(sources.where("enabled").select("source_id").distinct(), "source_id", "left_semi")


def without_traits(observations: DataFrame, denied: DataFrame) -> DataFrame:
    """Entities (kind, id) that deny their consent keep their place but lose their traits. ``denied`` is joined to the
    entities' rows, so it may be large."""
    rows = observations.select("id", F.explode("entities").alias("link", "e"))
    d = denied.select(F.lower("kind").alias("_kind"), F.col("id").alias("_id")).distinct()
    hit = rows.join(d, (F.lower("e.kind") == d["_kind"]) & (F.col("e.id") == d["_id"])).groupBy("id").agg(F.collect_set("link").alias("_denied"))
    out = observations.join(hit, "id", "left")
    wiped = F.transform_values("entities", lambda k, e: F.when(F.array_contains("_denied", k), F.struct(e["kind"].alias("kind"), e["id"].alias("id"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("traits"))).otherwise(e))
    return out.withColumn("entities", F.when(F.col("_denied").isNull(), F.col("entities")).otherwise(wiped)).drop("_denied").select(*observations.columns)


def with_sessions(observations: DataFrame, minutes: int = 15) -> DataFrame:
    """Observations without a session get that of their source's quarter of an hour."""
    return observations.withColumn("session_id", F.coalesce("session_id", session_slot("ts", "source_id", minutes)))


def entity_payloads(observations: DataFrame) -> DataFrame:
    """The entities of observations that state no relation: they are stored though there is no fact."""
    return entity_rows(observations.where(F.coalesce(F.size("relation"), F.lit(0)) <= 0))


def history_rows(entities: DataFrame) -> DataFrame:
    """One row for each version of an entity: (entity_hid, entity_pk, data_hash, entity_type, entity_id, traits, schema_hash,
    observation_id, observer_pk, ts), the newest of those with equal (entity, data hash)."""
    h = entities.withColumn("data_hash", traits_hash("traits"))
    h = h.withColumn("schema_hash", F.md5(F.array_join(F.array_sort(F.map_keys("traits")), ",")))
    rest = ["entity_type", "entity_id", "traits", "schema_hash", "observation_id", "observer_pk", "ts"]
    sortable = F.struct("ts", "observation_id", "link")
    return h.groupBy("entity_pk", "data_hash").agg(F.max_by(F.struct(*rest), sortable).alias("r")).select(version_id("entity_pk", "data_hash").alias("entity_hid"), "entity_pk", "data_hash", "r.*")


def observation_rows(observations: DataFrame) -> DataFrame:
    """(id, source_id, session_id, label, entities, ts): the newest of equal ids, with the number of entities."""
    rest = F.struct("source_id", "session_id", "label", F.size("entities").alias("entities"), "ts")
    return observations.groupBy("id").agg(F.max_by(rest, F.struct("ts", "session_id", "label", "source_id")).alias("o")).select("id", "o.*")


def observation_entities(entities: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """Distinct (observation_id, entity_id, entity_data_hash, entity_pk, entity_type), with the session if known."""
    out = entities.select("observation_id", "entity_id", traits_hash("traits").alias("entity_data_hash"), "entity_pk", "entity_type").distinct()
    return out if sessions is None else out.join(sessions.select(F.col("id").alias("observation_id"), "session_id").distinct(), "observation_id", "left")


def gid_rows(entities: DataFrame, identifying: dict[str, tuple[str, ...]]) -> DataFrame:
    """(entity_pk, entity_gid, entity_type, ts): an identity for entities that have all identifying traits of their kind,
    the newest one of each entity."""
    parts = []
    for kind, names in identifying.items():
        own = entities.where(F.lower("entity_type") == kind.lower())
        values = [F.try_element_at("traits", F.lit(n)) for n in names]
        gid = F.md5(F.concat_ws("-", F.lit(kind.lower()), *[F.lower(F.trim(v)) for v in values]))
        for v in values:
            own = own.where(v.isNotNull())
        parts.append(own.select("entity_pk", gid.alias("entity_gid"), "entity_type", "ts"))
    if not parts:
        return entities.limit(0).select("entity_pk", F.lit(None).cast("string").alias("entity_gid"), "entity_type", "ts")
    found = reduce(DataFrame.unionByName, parts)
    return found.groupBy("entity_pk").agg(F.max_by(F.struct("entity_gid", "entity_type", "ts"), F.struct("ts", "entity_gid")).alias("g")).select("entity_pk", "g.*")


def event_rows(facts: DataFrame) -> DataFrame:
    """Relations as entities: one row for each (observation, actor, label) with its time, objects and key."""
    e = facts.groupBy("obs_id", "actor_pk", "rel_label").agg(F.min("ts").alias("ts"), F.count("object_pk").alias("objects"), F.array_sort(F.collect_set("object_pk")).alias("object_pks"))
    return e.select(F.md5(F.concat_ws("-", "obs_id", text_of("actor_pk"), text_of("rel_label"))).alias("entity_pk"), F.lit("event").alias("entity_type"), "obs_id", "actor_pk", "rel_label", "ts", "objects", "object_pks")


def timer_rows(facts: DataFrame, timeouts: DataFrame) -> DataFrame:
    """(id, status, ts, timeout, event, obs_id, actor_pk, object_pk): a timer for each fact whose label has a timeout, as
    the newest of equal actor, label and object. ``timeouts`` (rel_label, timeout, event) is configuration, and broadcast if it is small."""
    t = facts.join(few(timeouts), "rel_label")
    last = t.groupBy("rel_tid").agg(F.max_by(F.struct("ts", "timeout", "event", "obs_id", "actor_pk", "object_pk"), F.struct("ts", "obs_id")).alias("t"))
    return last.select(F.col("rel_tid").alias("id"), F.lit(1).alias("status"), "t.*")


def resolved_references(observations: DataFrame) -> DataFrame:
    """Relation traits of the form ``$(link).name`` become that trait of the entity with this link; those that refer to
    nothing stay as they are."""

    def value(v):
        link, name = F.regexp_extract(v, r"^\$\(([^)]+)\)\.(.+)$", 1), F.regexp_extract(v, r"^\$\(([^)]+)\)\.(.+)$", 2)
        return F.when(v.rlike(r"^\$\([^)]+\)\..+$"), F.coalesce(F.try_element_at(F.try_element_at(F.col("entities"), link)["traits"], name), v)).otherwise(v)

    return observations.withColumn("relation", F.transform("relation", lambda r: r.withField("traits", F.transform_values(r["traits"], lambda k, v: value(v)))))


def valid_events(events: DataFrame, rules: dict[str, list[tuple[str, Column]]], label: str = "rel_label") -> DataFrame:
    """``events`` with ``failed``: the names of the rules (name, condition) of their label that don't hold."""
    checks = [F.when((F.col(label) == kind) & ~F.coalesce(condition, F.lit(False)), F.lit(name)) for kind, own in rules.items() for name, condition in own]
    return events.withColumn("failed", F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>"))


def reshaped(events: DataFrame, shapes: list[tuple[Column, dict[str, str], list[str]]], traits: str = "traits") -> DataFrame:
    """The map of traits by the first shape whose condition holds: (condition, {new name: old name}, names to delete).
    A new name whose old one is missing isn't made; events that no shape fits stay."""

    def shaped(names: dict[str, str], gone: list[str]) -> Column:
        replaced = [*gone, *names, *names.values()]
        kept = F.map_filter(traits, lambda k, v: ~k.isin(replaced)) if replaced else F.col(traits)
        if not names:
            return kept
        made = F.array(*[F.struct(F.lit(n).alias("key"), F.try_element_at(traits, F.lit(o)).alias("value")) for n, o in names.items()])
        return F.map_concat(kept, F.map_from_entries(F.filter(made, lambda e: e["value"].isNotNull())))

    out = F.col(traits)
    for condition, names, gone in reversed(shapes):
        out = F.when(F.coalesce(condition, F.lit(False)), shaped(names, gone)).otherwise(out)
    return events.withColumn(traits, out)


def entity_rows(observations: DataFrame) -> DataFrame:
    """(observation_id, link, entity_pk, entity_type, entity_id, traits, ts, observer_pk), one for each entity of each observation."""
    o = observations.select(F.col("id").alias("observation_id"), "ts", F.try_element_at("entities", F.col("observer")).alias("o"), F.explode("entities").alias("link", "e"))
    return o.select("observation_id", "link", entity_pk("e.kind", "e.id").alias("entity_pk"), F.col("e.kind").alias("entity_type"), F.col("e.id").alias("entity_id"),
                    F.col("e.traits").alias("traits"), "ts", F.when(F.col("o").isNotNull(), entity_pk("o.kind", "o.id")).alias("observer_pk"))


def fact_rows(observations: DataFrame) -> DataFrame:
    """One row for each relation and object; a relation without objects gives one row without object."""
    r = observations.select(F.col("id").alias("obs_id"), "ts", "source_id", "session_id", "entities", F.explode("relation").alias("r"))
    r = r.select("*", F.explode_outer("r.objects").alias("to"))
    actor, target = F.try_element_at("entities", F.col("r.actor")), F.try_element_at("entities", F.col("to"))
    r = r.select("obs_id", "source_id", "session_id", F.coalesce("r.ts", "ts").alias("ts"), F.col("r.label").alias("rel_label"), actor.alias("a"), target.alias("b"))
    r = r.select("*", F.when(F.col("a").isNotNull(), entity_pk("a.kind", "a.id")).alias("actor_pk"), F.when(F.col("b").isNotNull(), entity_pk("b.kind", "b.id")).alias("object_pk"))
    return r.select("obs_id", "source_id", "session_id", "ts", "rel_label", "actor_pk", F.col("a.kind").alias("actor_type"), "object_pk", F.col("b.kind").alias("object_type"),
                    triplet_id("actor_pk", "rel_label", "object_pk").alias("rel_tid"))


def link_rows(entities: DataFrame) -> DataFrame:
    return entities.select("entity_pk", "observation_id", "entity_type").distinct()


def property_rows(entities: DataFrame, own: bool = False) -> DataFrame:
    """One row for each trait; with ``own``, for key, id and type too, as ``$pk``, ``$id`` and ``$type``, where they aren't
    traits already. Numbers also as decimals."""
    named = F.col("traits")
    if own:
        nothing = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
        ids = F.map_from_arrays(F.array(F.lit("$id"), F.lit("$pk"), F.lit("$type")), F.array(F.col("entity_id"), F.col("entity_pk"), F.col("entity_type")))
        named = F.map_filter(merged(ids, F.coalesce("traits", nothing)), lambda k, v: v.isNotNull())
    p = entities.select("observer_pk", "entity_pk", "entity_type", "ts", F.explode(named).alias("property_name", "property_value"))
    return p.select("*", F.col("property_value").try_cast("decimal(20,10)").alias("property_number"), property_id("observer_pk", "entity_pk", "entity_type", "property_value").alias("property_id"))


def property_history(properties: DataFrame) -> DataFrame:
    """One row for each value that an observer has given a property: its first and last time, and how often."""
    return properties.groupBy("observer_pk", "entity_pk", "entity_type", "property_name", "property_value").agg(
        F.min("ts").alias("since"), F.max("ts").alias("ts"), F.count("*").alias("count"))


def property_state(properties: DataFrame) -> DataFrame:
    """The newest row of each observer, entity and property."""
    keys = ["observer_pk", "entity_pk", "entity_type", "property_name"]
    rest = [c for c in properties.columns if c not in keys]
    return properties.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("ts", "property_value")).alias("s")).select(*keys, "s.*")


def entity_properties(entities: DataFrame, own: bool = False) -> DataFrame:
    """``property_state`` of the ``property_rows`` of entities. Rows of an entity meet before their traits are taken apart, so
    an entity's row is shuffled once and not once for each trait; what is grouped by entity afterwards stays where it is."""
    return property_state(property_rows(entities.repartition("entity_pk"), own))


def merge_observations(observations: DataFrame) -> DataFrame:
    """Observations with the same id and session as one: the newest wins, entities are merged trait by trait, relations
    are put together by time, and one denial of consent counts for all.

    The order is total: by time, then by content, which is written out only where times are equal. Newer traits replace older
    ones of the same name and entity; the kind and id of an entity are the newest that aren't null. Only copies of one
    observation meet, each shuffled once; rows without an id go.
    """
    relations = F.transform("relation", lambda r: F.struct(r["ts"].alias("ts"), r["label"].alias("label"), r["actor"].alias("actor"), r["objects"].alias("objects"), F.array_sort(F.map_entries(r["traits"])).alias("traits")))
    o = observations.where(F.col("id").isNotNull()).withColumn("relation", relations)
    copies = F.collect_list(F.struct("ts", "label", "observer", "source_id", "relation", "entities"))
    grouped = o.repartition("id", "session_id").groupBy("id", "session_id").agg(F.min(F.coalesce("consent", F.lit(True))).alias("consent"), copies.alias("es"))
    tied = F.size(F.array_distinct(F.transform("es", lambda x: x["ts"]))) < F.size("es")

    def key(x, place):
        content = [F.to_json(F.struct(x["label"].alias("label"), x["observer"].alias("observer"), x["source_id"].alias("source_id"), x["relation"].alias("relation"))), F.to_json(F.struct(x["entities"].alias("entities")))]
        return F.struct(x["ts"].alias("ts"), *[F.when(tied, c).alias(n) for n, c in zip("ab", content)], place.alias("place"))

    grouped = grouped.withColumn("es", F.transform(F.sort_array(F.transform("es", key)), lambda k: F.get("es", k["place"])))
    last = F.element_at("es", -1)
    nothing = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))

    def one(a, b):
        return F.when(b.isNull(), a).when(a.isNull(), b).otherwise(F.struct(F.coalesce(b["kind"], a["kind"]).alias("kind"), F.coalesce(b["id"], a["id"]).alias("id"), merged(F.coalesce(a["traits"], nothing), F.coalesce(b["traits"], nothing)).alias("traits")))

    start = F.map_from_entries(F.array().cast(f"array<struct<key:string,value:{observations.schema['entities'].dataType.valueType.simpleString()}>>"))
    entities = F.aggregate("es", start, lambda a, x: F.map_zip_with(a, F.coalesce(x["entities"], start), lambda k, p, q: one(p, q)))
    relation = F.flatten(F.filter(F.transform("es", lambda x: x["relation"]), lambda r: r.isNotNull()))
    ordered = F.transform(F.array_sort(relation), lambda r: F.struct(r["label"].alias("label"), r["ts"].alias("ts"), r["actor"].alias("actor"), r["objects"].alias("objects"), F.map_from_entries(r["traits"]).alias("traits")))
    return grouped.select("id", last["ts"].alias("ts"), *[last[c].alias(c) for c in ("label", "observer", "source_id")], "session_id", "consent", entities.alias("entities"), ordered.alias("relation"))


def conversation_memory(turns: DataFrame, key: str, order: list[str], text: str, most: int = 100_000) -> DataFrame:
    """(key, turns, chars, compress): size of a conversation's memory, and whether it is due for a summary."""
    g = turns.groupBy(key).agg(F.count("*").alias("turns"), F.sum(F.length(text)).alias("sum"))
    return g.select(key, "turns", (F.coalesce("sum", F.lit(0)) + F.col("turns") - 1).alias("chars")).withColumn("compress", F.col("chars") > most)
