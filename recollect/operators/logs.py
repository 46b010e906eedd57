"""Logs: saving, searching by time and condition, by property, each with the number of all that fit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.batches import Batches


def save(store: Batches, batch: str | int, logs: DataFrame, ts: str = "date") -> bool:
    """Take a batch of log rows, by month; those without an id get a random one."""
    made = F.uuid()
    rows = logs.withColumn("id", F.coalesce(F.col("id"), made)) if "id" in logs.columns else logs.withColumn("id", made)
    return store.commit(batch, {"logs": rows.withColumn("month", F.date_format(ts, "yyyy-MM"))}, {"logs": ("month",)})


def found(logs: DataFrame, where: Column, ts: str = "date", newest_first: bool = True, start: int = 0, limit: int | None = 30) -> DataFrame:
    """Rows that fit, by time and then by id, with ``total``, the number of all that fit. The page is cut before the number
    is put beside it."""
    own = logs.where(where)
    order = [F.desc(ts) if newest_first else F.asc(ts), F.col("id")]
    page = own.orderBy(*order).offset(start) if start else own.orderBy(*order)
    page = page if limit is None else page.limit(limit)
    return page.crossJoin(F.broadcast(own.agg(F.count("*").alias("total"))))


def between(logs: DataFrame, since, till, where: Column | None = None, ts: str = "date", start: int = 0, limit: int | None = 30) -> DataFrame:
    """Logs of a span of time, newest first."""
    span = F.col(ts).between(F.lit(since).cast(logs.schema[ts].dataType), F.lit(till).cast(logs.schema[ts].dataType))
    return found(logs, span if where is None else span & where, ts, start=start, limit=limit)


def of_property(logs: DataFrame, name: str, value: str, newest_first: bool = True, limit: int | None = 30, ts: str = "date") -> DataFrame:
    """Logs of one entity, flow, event or node, by the column that names it."""
    return found(logs, F.col(name) == value, ts, newest_first, limit=limit)
