"""Stitched identities as a view that is kept up to date batch by batch.

An identity is an entity's gid, or the entity's own key; its traits are the newest values over all of its entities. The view
is a log of rows (identity, property, value, order, epoch). Newer values are just added, for the newest row wins in the
end. Only where an entity leaves an identity is something taken back: the identity gets a mark with the batch's epoch,
rows of earlier epochs no longer count, and the rows of the entities that stay are written again.

Nothing depends on the time in the rows: a batch is what has come since the last one, so late rows count as any others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.batches import Batches

OWN = ["entity_pk", "property_name", "property_value", "ts", "observer_pk"]
VIEW = ["identity", *OWN]


def newest_properties(properties: DataFrame) -> DataFrame:
    """The newest row of each entity and property; equal times go to the larger observer, then value."""
    p = properties.where(F.col("property_name").isNotNull()).select(*OWN)
    last = p.groupBy("entity_pk", "property_name").agg(F.max_by(F.struct("property_value", "ts", "observer_pk"), F.struct("ts", "observer_pk", "property_value")).alias("r"))
    return last.select("entity_pk", "property_name", "r.*").select(*OWN)


def newest_gids(gids: DataFrame) -> DataFrame:
    """The newest gid of each entity, null if it has lost it; equal times go to the larger gid."""
    return gids.groupBy("entity_pk").agg(F.max_by(F.struct("entity_gid"), F.struct("ts", "entity_gid")).alias("g"), F.max("ts").alias("ts")).select("entity_pk", "g.entity_gid", "ts")


def identity() -> Column:
    return F.coalesce("entity_gid", "entity_pk")


def delta(store: Batches, properties: DataFrame, gids: DataFrame, names: tuple[str, str] = ("properties", "gids")) -> DataFrame:
    """What a batch of property and gid changes adds to the view. ``store`` has the changes of all batches before in the
    tables ``names``; commit the batch's changes there together with this result, as ``stitch`` does.

    Work follows the batch and the identities that entities leave: entities of the batch find their identity by their
    keys, all entities of an identity are looked up only where one leaves it.
    """
    own = gids.select("entity_pk", "entity_gid", "ts")
    known = store.read(names[1], own.schema).select("entity_pk", "entity_gid", "ts")
    every = known.unionByName(own)

    def of(log: DataFrame, entities: DataFrame) -> DataFrame:
        """Newest gids of these entities; the log is cut to them before it is dealt out."""
        return newest_gids(log.join(entities.select("entity_pk").distinct(), "entity_pk", "left_semi"))

    moved = of(every, own).select("entity_pk", identity().alias("identity")).join(of(known, own).select("entity_pk", F.col("entity_gid").alias("_old")), "entity_pk", "left")
    moved = moved.withColumn("_old", F.coalesce("_old", "entity_pk")).where("_old <> identity")
    left = moved.select(F.col("_old").alias("identity")).distinct()

    new = newest_properties(properties)
    placed = new.join(of(every, new).select("entity_pk", "entity_gid"), "entity_pk", "left").select(identity().alias("identity"), *OWN)
    ever = every.join(left.select(F.col("identity").alias("entity_gid")), "entity_gid", "left_semi")
    stay = of(every, ever).where("entity_gid is not null").select("entity_pk", F.col("entity_gid").alias("identity")).join(left, "identity", "left_semi")
    again = moved.select("entity_pk", "identity").unionByName(stay.select("entity_pk", "identity")).distinct()
    held = store.read(names[0], properties.schema).select(*OWN).unionByName(new)
    rewritten = newest_properties(held.join(again.select("entity_pk").distinct(), "entity_pk", "left_semi")).join(again, "entity_pk").select(*VIEW)
    marks = left.select("identity", *[F.lit(None).cast(new.schema[c].dataType).alias(c) for c in OWN])
    return newest_rows(placed.unionByName(rewritten)).unionByName(marks).withColumn("epoch", F.lit(store.next()).cast("long"))


def newest_rows(rows: DataFrame) -> DataFrame:
    """The newest row of each identity and property."""
    rest = [c for c in rows.columns if c not in ("identity", "property_name")]
    last = rows.groupBy("identity", "property_name").agg(F.max_by(F.struct(*rest), F.struct("ts", "observer_pk", "entity_pk", "property_value")).alias("r"))
    return last.select("identity", "property_name", "r.*").select(*rows.columns)


def stitch(store: Batches, batch: str | int, properties: DataFrame, gids: DataFrame) -> bool:
    """Take a batch of changes into the tables ``properties``, ``gids`` and ``stitched``, all or none. A batch that is
    there already is left alone; whether it was taken."""
    if store.has(batch):
        return False
    return store.commit(batch, {"properties": newest_properties(properties), "gids": newest_gids(gids), "stitched": delta(store, properties, gids)})


def live(log: DataFrame) -> DataFrame:
    """Rows of the view's log that count: the newest of each identity and property since the identity's last mark."""
    marks = log.where("property_name is null").groupBy("identity").agg(F.max("epoch").alias("_mark"))
    rows = log.where("property_name is not null").join(marks, "identity", "left").where("_mark is null or epoch >= _mark").drop("_mark")
    return newest_rows(rows)


def view(store: Batches) -> DataFrame:
    """(identity, ts, traits) of all identities that have a property."""
    rows = live(store.read("stitched"))
    return rows.groupBy("identity").agg(F.max("ts").alias("ts"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("property_name", "property_value")))).alias("traits"))


def compact(store: Batches) -> None:
    """Each table as its rows that count."""
    store.compact("properties", newest_properties)
    store.compact("gids", newest_gids)
    store.compact("stitched", live)
