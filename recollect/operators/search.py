"""Entity search: observations in which entities with given properties occur together.

A query is a list of ``Entity`` groups, given as Python objects. All properties of a group must hold for one entity;
observations qualify that hold entities for enough groups. ``any_of`` and ``none_of`` combine results.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import cosine
from ..sources.batches import stored


@dataclass(frozen=True)
class Property:
    """``name = value``, or with ``vector`` a nearness of at least ``similarity`` among the ``top_k`` nearest values."""

    name: str
    value: str
    vector: tuple[float, ...] | None = None
    similarity: float = 0.7
    top_k: int = 100


@dataclass(frozen=True)
class Entity:
    kind: str
    properties: tuple[Property, ...] = ()


def latest_properties(state: DataFrame, kinds: list[str], names: list[str] | None = None, start=None, end=None) -> DataFrame:
    """Newest value of each property of each entity over all observers; equal times go to the larger observer.

    start and end bound the time of writing. Kinds and names are filtered before the one shuffle, which combines
    map-side.
    """
    s = state.where(F.lower("entity_type").isin([k.lower() for k in kinds]))
    if names is not None:
        s = s.where(F.col("property_name").isin(names))
    if start is not None:
        s = s.where(F.col("ts") >= F.lit(start))
    if end is not None:
        s = s.where(F.col("ts") <= F.lit(end))
    return s.groupBy("entity_pk", "entity_type", "property_name").agg(F.max_by("property_value", F.struct("ts", "observer_pk")).alias("property_value"))


def perhaps_in(df: DataFrame, keys: DataFrame, name: str, words: int = 1 << 20) -> DataFrame:
    """The rows of ``df`` whose ``name`` is in ``keys``, and a few others; an exact test must follow.

    A key's hash names a word and three bits in it, which are set. At most ``words`` of 64 bits are broadcast, however many
    keys there are, and Spark drops rows by them where the tables are read, before any shuffle. With two keys a word about one
    in 570 of the others stays, with ever more keys all do.
    """
    h = F.xxhash64(name)
    word, bits = F.pmod(h, F.lit(words)), [(F.shiftrightunsigned(h, at) % 64).cast("int") for at in (40, 46, 52)]
    mask = reduce(Column.bitwiseOR, [F.call_function("shiftleft", F.lit(1).cast("long"), b) for b in bits])
    sets = keys.groupBy(word.alias("_word")).agg(F.bit_or(mask).alias("_bits"))
    return df.join(F.broadcast(sets), reduce(Column.__and__, [F.getbit("_bits", b) == 1 for b in bits], word == F.col("_word")), "left_semi")


def entity_hits(state: DataFrame, groups: list[Entity], unmatched_traits: int = 0, start=None, end=None, vectors: DataFrame | None = None) -> DataFrame:
    """(entity_pk, group_id, matched, similarity) of entities that satisfy a group, before any link is touched.

    An exact hit has similarity 1. The predicates are a local relation of the query's own size. ``vectors`` (value,
    vector) is needed for nearness predicates; without it they are left out and not required either, as are groups
    without properties. The latest values are found only of entities that have had one of the exact values at some
    time (and of the few others that ``perhaps_in`` keeps), or of all if there are nearness predicates.
    """
    spark = state.sparkSession
    exact, near, required = [], [], []
    for number, group in enumerate(groups):
        counted = [p for p in group.properties if p.vector is None or vectors is not None]
        if counted:
            required.append((number, max(0, len(counted) - unmatched_traits)))
        for p in counted:
            (exact if p.vector is None else near).append((group.kind.lower(), p, number))
    kinds = sorted({g.kind.lower() for g in groups if g.properties})
    names = sorted({p.name for _, p, _ in exact + near})
    arms = []
    if exact:
        wanted = spark.createDataFrame([(k, p.name, p.value.lower(), n) for k, p, n in exact], "kind string, property_name string, wanted string, group_id int")
    if exact and not near:
        had = F.col("property_name").isin([p.name for _, p, _ in exact]) & F.lower("property_value").isin(sorted({p.value.lower() for _, p, _ in exact}))
        state = perhaps_in(state, state.where(F.lower("entity_type").isin(kinds) & had), "entity_pk")
    latest = latest_properties(state, kinds, names, start, end)
    if exact:
        arms.append(latest.join(F.broadcast(wanted), (F.lower("entity_type") == wanted["kind"]) & (latest["property_name"] == wanted["property_name"]) & (F.lower("property_value") == wanted["wanted"]))
                    .select("entity_pk", "group_id", F.lit(1.0).alias("similarity")))
    for kind, p, number in near if vectors is not None else []:
        values = latest.where((F.lower("entity_type") == kind) & (F.col("property_name") == p.name)).join(vectors, F.col("property_value") == F.col("value"))
        asked = F.array(*[F.lit(float(x)) for x in p.vector])
        best = values.select("entity_pk", cosine("vector", asked).alias("similarity")).orderBy(F.desc("similarity"), "entity_pk").limit(p.top_k)
        arms.append(best.where(F.col("similarity") >= p.similarity).select("entity_pk", F.lit(number).alias("group_id"), "similarity"))
    if not arms:
        return spark.createDataFrame([], "entity_pk string, group_id int, matched long, similarity double")
    hits = reduce(DataFrame.unionByName, arms).groupBy("entity_pk", "group_id").agg(F.count("*").alias("matched"), F.max("similarity").alias("similarity"))
    needed = spark.createDataFrame(required, "group_id int, required int")
    return hits.join(F.broadcast(needed), "group_id").where("matched >= required").drop("required")


def qualifying(state: DataFrame, links: DataFrame, groups: list[Entity], unmatched_entities: int = 0, hits: DataFrame | None = None, **how) -> DataFrame:
    """One row an observation: observation_id, no_of_entities, no_of_matched_props, entity_pks, max_similarity.

    Links that can't have a hit go first, then hits are joined with links on the entity and added up by observation. A group without properties is met by any
    entity of its kind and counts one each. Hits are stored first, so that Spark knows their size, broadcasts them if they
    are few and otherwise splits the links of a popular entity; ``hits`` gives the result of ``entity_hits`` where several
    searches share it.
    """
    if not groups:
        raise ValueError("a search needs an entity at least")
    if hits is None and not any(not g.properties or how.get("vectors") is not None or any(p.vector is None for p in g.properties) for g in groups):
        raise ValueError("no group is left: nearness needs vectors")
    spark = state.sparkSession
    found = []
    if any(g.properties for g in groups):
        hits = hits if hits is not None else stored(entity_hits(state, groups, **how), "hits")
        found.append(perhaps_in(links, hits, "entity_pk").join(hits, "entity_pk").select("observation_id", "entity_pk", "group_id", "matched", "similarity"))
    bare = [(g.kind.lower(), n) for n, g in enumerate(groups) if not g.properties]
    if bare:
        kinds = spark.createDataFrame(bare, "kind string, group_id int")
        found.append(links.join(F.broadcast(kinds), F.lower("entity_type") == kinds["kind"]).select("observation_id", "entity_pk", "group_id").distinct()
                     .select("*", F.lit(1).cast("long").alias("matched"), F.lit(None).cast("double").alias("similarity")))
    out = reduce(DataFrame.unionByName, found).groupBy("observation_id").agg(
        F.size(F.collect_set("group_id")).cast("long").alias("no_of_entities"), F.sum("matched").alias("no_of_matched_props"),
        F.array_join(F.array_sort(F.collect_set("entity_pk")), ",").alias("entity_pks"), F.max("similarity").alias("max_similarity"))
    return out.where(F.col("no_of_entities") >= max(0, len(groups) - unmatched_entities))


@dataclass(frozen=True)
class And:
    """All parts hold. Entities next to each other are one search, in which ``unmatched_entities`` may lack."""

    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


@dataclass(frozen=True)
class Not:
    part: object


def flattened(node):
    """The tree with parts of an And in an And, and of an Or in an Or, put into it; two Nots in a row cancel out."""
    if isinstance(node, Not):
        inner = flattened(node.part)
        return inner.part if isinstance(inner, Not) else Not(inner)
    if not isinstance(node, (And, Or)):
        return node
    parts = []
    for p in map(flattened, node.parts):
        parts += p.parts if type(p) is type(node) else [p]
    return parts[0] if len(parts) == 1 else type(node)(tuple(parts))


def leaves(node) -> list[Entity]:
    """The entities of a tree that aren't under a Not."""
    node = flattened(node)
    if isinstance(node, Not):
        return []
    return [node] if isinstance(node, Entity) else [e for p in node.parts for e in leaves(p)]


def matching(state: DataFrame, links: DataFrame, node, every: DataFrame, **how) -> DataFrame:
    """(observation_id) of the observations for which a tree of And, Or, Not and Entity holds. ``every`` has all
    observations (observation_id), of which a Not takes those that its part doesn't hold for."""
    node = flattened(node)
    if isinstance(node, Entity):
        return qualifying(state, links, [node], **how).select("observation_id")
    if isinstance(node, Not):
        return none_of(every.select("observation_id").distinct(), matching(state, links, node.part, every, **how))
    if isinstance(node, Or):
        return any_of(*[matching(state, links, p, every, **how) for p in node.parts])
    own = [p for p in node.parts if isinstance(p, Entity)]
    rest = [p for p in node.parts if not isinstance(p, (Entity, Not))]
    found = [qualifying(state, links, own, **how).select("observation_id")] if own else []
    found += [matching(state, links, p, every, **how) for p in rest]
    out = reduce(lambda a, b: a.join(b, "observation_id", "left_semi"), found) if found else every.select("observation_id").distinct()
    return none_of(out, *[matching(state, links, p.part, every, **how) for p in node.parts if isinstance(p, Not)])


def with_vectors(groups: list[Entity], embed) -> list[Entity]:
    """The groups with vectors for the properties marked as near (an empty vector): ``embed`` gets the distinct values."""
    asked = sorted({p.value for g in groups for p in g.properties if p.vector == ()})
    found = dict(zip(asked, embed(asked))) if asked else {}
    return [replace(g, properties=tuple(replace(p, vector=tuple(found[p.value])) if p.vector == () else p for p in g.properties)) for g in groups]


def any_of(*results: DataFrame) -> DataFrame:
    """Observations of any result."""
    return reduce(DataFrame.unionByName, [r.select("observation_id") for r in results]).distinct()


def none_of(result: DataFrame, *others: DataFrame) -> DataFrame:
    """Observations of the result that are in none of the others."""
    return reduce(lambda a, b: a.join(b.select("observation_id"), "observation_id", "left_anti"), others, result)


def observations_of(result: DataFrame, observations: DataFrame, limit: int | None = None) -> DataFrame:
    """The observations' own rows, best first."""
    out = result.select("observation_id", "no_of_matched_props", "max_similarity").join(observations, F.col("observation_id") == F.col("id")).drop("observation_id")
    out = out.orderBy(F.desc_nulls_last("max_similarity"), F.desc("no_of_matched_props"), "id")
    return out.limit(limit) if limit else out


def entities_of(result: DataFrame, links: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """All entities of the qualifying observations: (observation_id, entity_pk, entity_type)."""
    out = links.join(result.select("observation_id"), "observation_id", "left_semi")
    return out.where(F.lower("entity_type").isin([k.lower() for k in kinds])) if kinds else out


def expanded_entities(result: DataFrame, links: DataFrame, state: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """The distinct entities of the qualifying observations with their latest traits as a map; null without traits."""
    found = entities_of(result, links, kinds).select("entity_pk", "entity_type").distinct()
    return found.join(entity_state(state), "entity_pk", "left")


def entity_state(state: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(entity_pk, [by], ts, traits): the latest value of each property as one map. An entity's properties are one row's worth."""
    last = state.groupBy("entity_pk", *by, "property_name").agg(F.max_by("property_value", F.struct("ts", "observer_pk")).alias("v"), F.max("ts").alias("ts"))
    return last.groupBy("entity_pk", *by).agg(F.max("ts").alias("ts"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("property_name", "v")))).alias("traits"))


def entity_facets(result: DataFrame, links: DataFrame, top: int = 100) -> DataFrame:
    """Entity types of the qualifying observations by number of links."""
    return entities_of(result, links).groupBy("entity_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "entity_type").limit(top)


def by_properties(properties: DataFrame, wanted: list[tuple[str, str]], kind: str | None = None, observer: str | None = None) -> DataFrame:
    """(entity_pk, entity_type, matches, fit): entities by how many of the wanted properties they have had.

    ``$pk`` names the entity itself; numbers compare as numbers, other values without regard to case.
    """
    p = properties.where(F.lower("entity_type") == kind.lower()) if kind else properties
    p = p.where(F.col("observer_pk") == observer) if observer else p

    def condition(name: str, value: str):
        if name == "$pk":
            return F.col("entity_pk") == value
        try:
            same = F.col("property_value").try_cast("double") == float(value)
        except ValueError:
            same = F.lower("property_value") == value.lower()
        return (F.col("property_name") == name) & same

    p = p.where(reduce(lambda a, b: a | b, [condition(n, v) for n, v in wanted]))
    return p.groupBy("entity_pk", "entity_type").agg(F.count("*").alias("matches")).withColumn("fit", F.col("matches") / len(wanted))


def hyper_edge(links: DataFrame, candidates: list[DataFrame]) -> DataFrame:
    """Observations that link an entity of every candidate set (entity_pk); no combinations are built."""
    tagged = reduce(DataFrame.unionByName, [c.select("entity_pk", F.lit(n).alias("clause")).distinct() for n, c in enumerate(candidates)])
    met = links.join(tagged, "entity_pk").groupBy("observation_id").agg(F.count_distinct("clause").alias("clauses"), F.count_distinct("entity_pk").alias("entities"))
    return met.where(F.col("clauses") == len(candidates)).select("observation_id", "entities")
