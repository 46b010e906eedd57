"""Structured Streaming versions of ingestion, property counts and inactivity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import ingest, stitching, texts
from ..sources.batches import Batches, latest_of


def property_sums(rows: DataFrame) -> DataFrame:
    """Histories of several batches as one."""
    keys = ["observer_pk", "entity_pk", "entity_type", "property_name", "property_value"]
    return rows.groupBy(*keys).agg(F.min("since").alias("since"), F.max("ts").alias("ts"), F.sum("count").alias("count"))


def event_unions(rows: DataFrame) -> DataFrame:
    """Relations as entities of several batches: objects are put together."""
    keys = ["entity_pk", "entity_type", "obs_id", "actor_pk", "rel_label"]
    e = rows.groupBy(*keys).agg(F.min("ts").alias("ts"), F.sum("objects").alias("objects"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("object_pks")))).alias("object_pks"))
    return e.select(*rows.columns)


def first_texts(rows: DataFrame) -> DataFrame:
    rest = F.struct("parent_id", "text_string", "origin")
    t = rows.groupBy("id").agg(F.min("observation_id").alias("observation_id"), F.min("ts").alias("ts"), F.min_by(rest, F.struct("origin", "observation_id")).alias("t"))
    return t.select("id", "t.parent_id", "observation_id", "t.text_string", "t.origin", "ts")


#: What makes one table of the rows of several batches; tables that aren't named are just put together.
MERGES = {
    "events": event_unions, "links": DataFrame.distinct, "observation_entities": DataFrame.distinct, "texts": first_texts, "property_history": property_sums,
    "history": latest_of(["entity_pk", "data_hash"], ["ts", "observation_id"]), "gids": latest_of(["entity_pk"], ["ts", "entity_gid"]), "timers": latest_of(["id"], ["ts", "obs_id"]),
    "properties": latest_of(["observer_pk", "entity_pk", "entity_type", "property_name"], ["ts", "property_value"]), "observations": latest_of(["id"], ["ts", "session_id", "label", "source_id"]),
}


def read(store: Batches, name: str) -> DataFrame:
    """A table of ``start_ingest`` over all batches."""
    return MERGES.get(name, lambda rows: rows)(store.read(name))


def ingest_tables(observations: DataFrame, identifying: dict[str, tuple[str, ...]], timeouts: DataFrame, text_traits: tuple[str, ...] = ("text", "description")) -> dict[str, DataFrame]:
    """All tables that a batch of observations gives, each without repetitions within the batch: facts, relations as
    entities, links, versions, identities, timers, texts (those of the named traits), properties and their history,
    observations with their entities, and what was refused and why."""
    judged = ingest.judged(observations)
    judged = judged.withColumn("refused", F.when(F.col("broken"), "broken").otherwise(F.col("refused"))) if "broken" in observations.columns else judged
    kept = judged.where("refused is null")
    entities, facts = ingest.entity_rows(kept), ingest.fact_rows(kept)
    properties = ingest.property_rows(entities, own=True)
    said = entities.select("observation_id", "ts", F.explode(F.map_filter("traits", lambda k, v: k.isin(*text_traits))).alias("name", "text"))
    return {"facts": facts.withColumn("month", F.date_format("ts", "yyyy-MM")), "events": ingest.event_rows(facts), "links": ingest.link_rows(entities), "history": ingest.history_rows(entities),
            "gids": ingest.gid_rows(entities, identifying), "timers": ingest.timer_rows(facts, timeouts), "texts": texts.text_rows(said, origin=texts.ENTITY),
            "properties": ingest.property_state(properties), "property_history": ingest.property_history(properties),
            "observations": ingest.observation_rows(kept), "observation_entities": ingest.observation_entities(entities, kept), "refused": ingest.dead_letters(judged)}


def take(store: Batches, batch: str | int, observations: DataFrame, identifying: dict[str, tuple[str, ...]], timeouts: DataFrame) -> bool:
    """Take a batch into all tables and into the stitched view (``stitching.view``), or into none; one that is there already
    is left alone. Whether it was taken."""
    if store.has(batch):
        return False
    held = observations.persist()
    made = ingest_tables(held, identifying, timeouts)
    made["stitched"] = stitching.delta(store, made["properties"], made["gids"])
    done = store.commit(batch, made, parts={"facts": ("month",)})
    held.unpersist()
    return done


def start_ingest(observations: DataFrame, folder: str, checkpoint: str, once: bool = False, identifying: dict[str, tuple[str, ...]] | None = None, timeouts: DataFrame | None = None) -> StreamingQuery:
    """Takes each micro-batch into the tables of ``Batches(spark, folder)``, see ``ingest_tables`` and ``read``. A batch that
    runs again after a failure is taken once. ``timeouts`` (rel_label, timeout, event) sets timers."""
    spark = observations.sparkSession
    due = timeouts if timeouts is not None else spark.createDataFrame([], "rel_label string, timeout int, event string")

    def store(batch: DataFrame, batch_id: int) -> None:
        take(Batches(spark, folder), batch_id, batch, identifying or {}, due)

    writer = observations.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="3 seconds")).start()


def compact(store: Batches, names: tuple[str, ...] = tuple(MERGES)) -> None:
    """Replace the batches of each table by the rows that count."""
    for name in names:
        store.compact(name, MERGES[name])
    store.compact("stitched", stitching.live)


def property_counts(changes: DataFrame, late: str = "1 day") -> DataFrame:
    """Running counts of reported values by day; state older than the watermark is dropped."""
    return changes.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "entity_pk", "property_name", "property_value").agg(F.count("*").alias("n"), F.max("ts").alias("last"))


def ended_sessions(facts: DataFrame, inactive: str = "60 minutes", late: str = "10 minutes") -> DataFrame:
    """Observations whose facts have ceased for so long, with their span."""
    s = facts.withWatermark("ts", late).groupBy(F.session_window("ts", inactive), "obs_id").agg(F.count("*").alias("facts"))
    return s.select("obs_id", F.col("session_window.start").alias("since"), F.col("session_window.end").alias("till"), "facts")
