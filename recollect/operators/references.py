"""References inside observations: traits that stand for traits of other entities, along chains, and states of entities."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ``$(link).trait`` or ``$(kind#id).trait``.
REFERENCE = r"^\$\(([^)]+)\)\.\s*(.+?)\s*$"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, however often it is used, in lambdas too."""
    return F.transform(F.array(value), body)[0]


def followed(entities: Column) -> Column:
    """An array of (link, name, new, circle) of the traits of a map of entities that are references: ``new`` is what they
    come to, unless they lead into a ``circle``."""
    # an entity without traits can't be referred to
    held = F.filter(F.map_entries(entities), lambda e: F.coalesce(F.size(e["value"]["traits"]), F.lit(0)) > 0)
    rows = F.flatten(F.transform(held, lambda e: F.transform(F.map_entries(e["value"]["traits"]), lambda t: F.struct(e["key"].alias("link"), t["key"].alias("name"), t["value"].alias("value")))))
    names = F.transform(held, lambda e: F.struct(e["key"].alias("link"), F.concat_ws("#", F.lower(e["value"]["kind"]), e["value"]["id"]).alias("to")))

    def parent(value: Column, keys: Column, names: Column) -> Column:
        """The place of the trait that a value refers to; 0 if there is none."""
        to = F.regexp_extract(value, REFERENCE, 1)
        place = F.locate("#", to)
        to = F.when(place > 0, F.concat_ws("#", F.lower(F.substring_index(to, "#", 1)), F.substr(to, place + 1))).otherwise(to)
        # a link goes before a kind and id that read the same, then the least link
        link = bound(to, lambda to: F.array_min(F.transform(F.filter(names, lambda n: (n["link"] == to) | (n["to"] == to)), lambda n: F.struct((n["link"] != to).alias("other"), n["link"].alias("link"))))["link"])
        return F.coalesce(F.array_position(keys, F.struct(link.alias("link"), F.regexp_extract(value, REFERENCE, 2).alias("name"))), F.lit(0)).cast("int")

    def ends(rows: Column, up: Column) -> Column:
        """Pointers are doubled until they reach over as many steps as there are traits: those at a root stay there, all
        others run in a circle."""
        start = F.transform(up, lambda u, i: F.when(u > 0, u).otherwise(i + 1))
        last = F.aggregate(F.sequence(F.lit(0), F.ceil(F.log2(F.size(rows))).cast("int")), start, lambda to, _: F.transform(to, lambda x: F.element_at(to, x)))
        return bound(last, lambda last: F.filter(
            F.transform(rows, lambda r, i: F.struct(r["link"].alias("link"), r["name"].alias("name"), F.get(rows, F.get(last, i) - 1)["value"].alias("new"), (F.get(up, F.get(last, i) - 1) > 0).alias("circle"), (F.get(up, i) > 0).alias("refers"))),
            lambda r: r["refers"]))

    return bound(rows, lambda rows: bound(names, lambda names: bound(F.transform(rows, lambda r: F.struct(r["link"].alias("link"), r["name"].alias("name"))), lambda keys: bound(
        F.transform(rows, lambda r: F.when(r["value"].rlike(REFERENCE), parent(r["value"], keys, names)).otherwise(0)), lambda up: ends(rows, up)))))


def resolved(observations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``observations`` with the references among the traits of their entities replaced by what they come to, along chains of
    any length; and (id, link, name) of those that lead into a cycle, which stay as they are.

    A reference names an entity of its observation by link or by ``kind#id``, and a trait. One that refers to nothing
    stays, and others that refer to it get its text. References don't leave their observation, so they are followed in its
    row, by doubling, and nothing is shuffled or stored. Observations whose id is null have no references.
    """
    refers = F.col("id").isNotNull() & F.exists(F.map_values("entities"), lambda e: F.exists(F.map_values(e["traits"]), lambda v: F.coalesce(v.rlike(REFERENCE), F.lit(False))))
    found = F.when(refers, followed(F.col("entities")))

    def renewed(new: Column) -> Column:
        def traits(link: Column, e: Column) -> Column:
            return bound(F.filter(new, lambda n: (n["link"] == link) & ~n["circle"]), lambda own: F.when(F.size(own) == 0, e).otherwise(e.withField("traits", F.transform_values(
                e["traits"], lambda name, v: bound(F.filter(own, lambda n: n["name"] == name), lambda mine: F.when(F.size(mine) > 0, mine[0]["new"]).otherwise(v))))))

        return F.transform_values("entities", traits)

    out = observations.withColumn("entities", bound(found, lambda new: F.when(F.coalesce(F.size(new), F.lit(0)) <= 0, F.col("entities")).otherwise(renewed(new))))
    cyclic = observations.select("id", F.inline(F.filter(found, lambda n: n["circle"]))).select("id", "link", "name")
    return out, cyclic


def states(entities: DataFrame, asked: DataFrame) -> DataFrame:
    """(observation_id, link, state, traits): the traits, with ``_id``, that entities (as of ``ingest.entity_rows``) have as a
    state. ``asked`` (observation_id, link, state, ref) says which entity of the observation is one's state; those that
    name no entity, or one without an id or traits, give no row."""
    held = entities.where("entity_id is not null and traits is not null")
    held = held.select("observation_id", F.col("link").alias("ref"), F.map_concat(F.map_filter("traits", lambda k, v: k != "_id"), F.create_map(F.lit("_id"), F.col("entity_id"))).alias("traits"))
    return asked.join(held, ["observation_id", "ref"]).select("observation_id", "link", "state", "traits")
