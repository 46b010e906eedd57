"""Conversation memory: what was said since the last summary, and whether it is due for a new one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def memories(turns: DataFrame, summaries: DataFrame, key: str, at: str, text: str, since=None, most: int = 100_000) -> DataFrame:
    """(key, summary, turns, memory, chars, compress) for each conversation with a turn or a summary that holds.

    ``turns`` has (key, at, text), ``summaries`` (key, at, summary) with the place of the last turn summed up; the newest
    summary replaces all turns up to there. ``since`` leaves out turns and summaries that have expired. A conversation is
    one text in the end, so its turns meet in a row; longer ones than ``most`` are marked, to be summed up.
    """
    t, s = turns.select(key, at, text), summaries.select(key, F.col(at).alias("_till"), "summary")
    if since is not None:
        t, s = t.where(F.col(at) >= F.lit(since)), s.where(F.col("_till") >= F.lit(since))
    s = s.groupBy(key).agg(F.max_by(F.struct("_till", "summary"), F.struct("_till", "summary")).alias("_s")).select(key, "_s.*")
    new = t.join(s.select(key, "_till"), key, "left").where(F.col("_till").isNull() | (F.col(at) > F.col("_till")))
    new = new.groupBy(key).agg(F.count("*").alias("turns"), F.array_sort(F.collect_list(F.struct(at, F.coalesce(F.col(text), F.lit("")).alias("text")))).alias("said"))
    out = s.join(new, key, "full_outer")
    parts = F.concat(F.array_compact(F.array("summary")), F.coalesce(F.transform("said", lambda x: x["text"]), F.array().cast("array<string>")))
    out = out.select(key, "summary", F.coalesce("turns", F.lit(0)).alias("turns"), F.array_join(parts, "\n").alias("memory"))
    return out.withColumn("chars", F.length("memory").cast("long")).withColumn("compress", F.col("chars") > most)
