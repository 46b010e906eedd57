"""Reads over facts, observations, history, texts and logs: filters, versioned joins, queues, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import version_key
from ..functions.scalars import cosine


def page(df: DataFrame, order: list[Column], start: int = 0, limit: int = 100) -> DataFrame:
    """A page of a total order."""
    return df.orderBy(*order).offset(start).limit(limit)


def facts_between(facts: DataFrame, start, end, where: Column | None = None) -> DataFrame:
    out = facts.where(F.col("ts").between(F.lit(start), F.lit(end)))
    return out.where(where) if where is not None else out


def with_versions(facts: DataFrame, history: DataFrame, how: str = "inner") -> DataFrame:
    """Facts with the traits that actor and object had then, by (entity, data hash)."""
    facts = facts.withColumns({f"_{r}": version_key(f"{r}_pk", f"{r}_data_hash") for r in ("actor", "object")})
    for role in ("actor", "object"):
        h = history.select(version_key("entity_pk", "data_hash").alias(f"_{role}"), F.col("traits").alias(f"{role}_traits"))
        facts = facts.join(h, f"_{role}", how).drop(f"_{role}")
    return facts


def unprocessed(facts: DataFrame, jobs: DataFrame, job_id: str, before=None) -> DataFrame:
    """Facts that a job hasn't handled yet and that are older than ``before``."""
    out = facts.join(jobs.where(F.col("job_id") == job_id), "rel_id", "left_anti")
    return out.where(F.col("ts") < F.lit(before)) if before is not None else out


def unprocessed_with_traits(facts: DataFrame, jobs: DataFrame, history: DataFrame, job_id: str, since=None, now=None, after_seconds: int = 0, where: Column | None = None) -> DataFrame:
    """Facts that a job hasn't handled, with the traits that actor, relation and object had then (null where there are
    none): those after ``since``, those at least ``after_seconds`` old at ``now``, those that meet the condition. History
    is joined by (entity, data hash), after the facts are filtered."""
    out = unprocessed(facts if where is None else facts.where(where), jobs, job_id)
    out = out if since is None else out.where(F.col("ts") > F.lit(since))
    if after_seconds:
        out = out.where(F.col("ts") <= F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(secs=F.lit(after_seconds)))
    out = out.withColumns({f"_{r}": version_key(f"{r}_pk", f"{r}_data_hash") for r in ("actor", "rel", "object")})
    for role in ("actor", "rel", "object"):
        h = history.select(version_key("entity_pk", "data_hash").alias(f"_{role}"), F.col("traits").alias(f"{role}_traits"))
        out = out.join(h, f"_{role}", "left").drop(f"_{role}")
    return out


def timer(timers: DataFrame, key: str) -> DataFrame:
    return timers.where(F.col("id") == key)


def ending_observations(facts: DataFrame, triggers: DataFrame, trigger_id: str, now, inactive_minutes: int = 60, strict: bool = False) -> DataFrame:
    """Observations with facts older than the limit that the trigger hasn't seen, or that have moved since.

    By default one old fact is enough; ``strict`` asks that all facts are old.
    """
    limit = F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {inactive_minutes} MINUTE")
    last = (facts if strict else facts.where(F.col("ts") < limit)).groupBy("obs_id").agg(F.max("ts").alias("ts"))
    last = last.where(F.col("ts") < limit)
    t = triggers.where(F.col("trigger_id") == trigger_id).select("obs_id", "ts_end")
    return last.join(t, "obs_id", "left").where(F.col("ts_end").isNull() | (F.col("ts") > F.col("ts_end"))).select("obs_id", "ts")


def active_timers(timers: DataFrame, now) -> DataFrame:
    """Timers that are on and have run out."""
    return timers.where((F.col("status") > 0) & (F.unix_timestamp("ts") + F.col("timeout") < F.unix_timestamp(F.lit(now).cast("timestamp_ntz"))))


def same_identity(gids: DataFrame, pk: Column) -> DataFrame:
    """Entities that share a global identity with those that the condition picks."""
    own = gids.where(pk).select("entity_gid").distinct()
    return gids.join(own, "entity_gid", "left_semi").select("entity_pk")


def stitched(state: DataFrame, gids: DataFrame) -> DataFrame:
    """(identity, entities, traits): latest property values over all entities of an identity, as one map."""
    s = state.join(gids.select("entity_pk", "entity_gid"), "entity_pk", "left").withColumn("identity", F.coalesce("entity_gid", "entity_pk"))
    last = s.groupBy("identity", "property_name").agg(F.max_by("property_value", F.struct("ts", "observer_pk", "entity_pk")).alias("v"))
    traits = last.groupBy("identity").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("property_name", "v")))).alias("traits"))
    members = s.groupBy("identity").agg(F.count_distinct("entity_pk").alias("entities"))
    return members.join(traits, "identity")


def changed_since(state: DataFrame, since: int, till: int) -> DataFrame:
    return state.where((F.col("ts") > since) & (F.col("ts") <= till)).select("entity_pk").distinct()


def entity_statistics(facts: DataFrame, kind: str) -> DataFrame:
    """Distinct counts and the time span of facts with an entity type, by its role."""
    parts = []
    for role in ("actor", "object"):
        parts.append(facts.where(F.col(f"{role}_type") == kind).agg(
            F.lit(role).alias("role"), F.count_distinct(f"{role}_pk").alias("entities"), F.count_distinct("obs_id").alias("observations"),
            F.count_distinct("rel_label").alias("labels"), F.count("*").alias("facts"), F.min("ts").alias("first"), F.max("ts").alias("last")))
    return parts[0].unionByName(parts[1])


def histogram(df: DataFrame, start: int, end: int, buckets: int = 60, ts: str = "ts") -> DataFrame:
    """(bucket, since, n): counts in equal parts of [start, end) in Unix seconds, empty ones included."""
    width = max(1, -(-(end - start) // buckets))
    at = F.unix_timestamp(ts)
    n = df.where((at >= start) & (at < end)).groupBy(F.floor((at - start) / width).cast("long").alias("bucket")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    return every.join(n, "bucket", "left").select("bucket", (F.lit(start) + F.col("bucket") * width).cast("long").alias("since"), F.coalesce("n", F.lit(0)).alias("n"))


def property_dedup(changes: DataFrame) -> DataFrame:
    """(entity_pk, property_name, property_value): how often a value was reported, and when last."""
    return changes.groupBy("entity_pk", "property_name", "property_value").agg(F.count("*").alias("n"), F.max("ts").alias("ts"))


def overlay(production: DataFrame, test: DataFrame, key: str = "id") -> DataFrame:
    """Rows of both, those of ``test`` in place of those of ``production`` with the same key; ``running`` marks
    the ones that production has."""
    p, t = F.struct(*[production[c] for c in production.columns]), F.struct(*[test[c] for c in test.columns])
    both = production.select(F.col(key).alias("_k"), p.alias("p")).join(test.select(F.col(key).alias("_k"), t.alias("t")), "_k", "full_outer")
    return both.select(F.coalesce("t", "p").alias("r"), F.col("p").isNotNull().alias("running")).select("r.*", "running")


def similar(vectors: DataFrame, query: list[float], top_k: int = 10, least: float = 0.7, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The nearest rows by cosine, best first: a scan with a bounded heap a task."""
    s = vectors.select(key, cosine(vector, F.array(*[F.lit(float(x)) for x in query])).alias("similarity"))
    return s.where(F.col("similarity") >= least).orderBy(F.desc("similarity"), key).limit(top_k)


def rank_fusion(lists: list[DataFrame], key: str = "vec_id", score: str = "similarity", constant: int = 60, limit: int = 10, depth: int = 1000) -> DataFrame:
    """Reciprocal rank fusion of the best ``depth`` rows of each list."""
    ranked = None
    for found in lists:
        best = found.orderBy(F.desc(score), key).limit(depth)  # so that few rows are numbered in one task
        r = best.select(key, F.row_number().over(Window.orderBy(F.desc(score), key)).alias("r"))
        ranked = r if ranked is None else ranked.unionByName(r)
    return ranked.groupBy(key).agg(F.sum(1 / (constant + F.col("r"))).alias("score")).orderBy(F.desc("score"), key).limit(limit)


def centroids(vectors: DataFrame, label: str = "label", vector: str = "embedding", negative: float = 0.3) -> DataFrame:
    """(label, position, prototype): each label's mean less ``negative`` times the mean of the other labels' means."""
    means = vectors.select(label, F.posexplode(vector).alias("position", "x")).groupBy(label, "position").agg(F.avg(F.col("x").cast("double")).alias("m"))
    every = means.groupBy("position").agg(F.sum("m").alias("sum"), F.count("*").alias("k"))
    return means.join(every, "position").select(label, "position", (F.col("m") - negative * F.coalesce((F.col("sum") - F.col("m")) / F.nullif(F.col("k") - 1, F.lit(0)), F.lit(0.0))).alias("prototype"))
