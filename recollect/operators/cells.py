"""A partitioned vector index: unit vectors in coarse cells with bounds, read cell by cell."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import dot
from ..sources.batches import Batches

#: Vectors that centres are fitted on, centres at most, rounds of fitting.
SAMPLE, CELLS, ROUNDS = 50_000, 1024, 8
#: Cells read first by an exact search; what they hold says which others have to be read.
FIRST = 8
PARTS = {"vectors": ("cell",)}
CENTRES = "cell int, centre array<double>"


def fitted(x: np.ndarray, k: int) -> np.ndarray:
    """Centres of about equal use by Lloyd's rounds on unit vectors, from a spread-out start; the same for the same rows."""
    x = x[np.lexsort(x.T[::-1])]
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)]
    for _ in range(ROUNDS):
        own = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        used = np.bincount(own, minlength=k) > 0
        centres = np.where(used[:, None], sums, centres)
        centres = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-300)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray, many: int = 1) -> np.ndarray:
    """Numbers of each row's nearest centres, in blocks, the nearest first."""
    blocks = [x[at : at + 4096] @ centres.T for at in range(0, len(x), 4096)]
    found = [np.argsort(-b, axis=1, kind="stable")[:, :many] for b in blocks]
    out = np.concatenate(found) if found else np.zeros((0, many), int)
    return out[:, 0] if many == 1 else out


def unit(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v): unit vectors in doubles; null and zero ones, and those that aren't finite, have no direction and go."""
    v = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    rows = vectors.select(F.col(key).alias("id"), v.alias("v"), norm.alias("norm")).where("norm > 0 and norm < double('infinity') and not isnan(norm)")
    return rows.select("id", F.transform("v", lambda x: x / F.col("norm")).alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def add(store: Batches, batch: str | int, vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cells: int | None = None) -> bool:
    """Take a batch of vectors of one dimension into the index; one that is there already is left alone. Whether it was taken.

    The first batch's sample (at most about SAMPLE rows) fits the centres, as many as the root of its number, which hold
    from then on. A vector's key stands for its content (as the md5 of a text does), so keys aren't replaced.
    """
    if store.has(batch):
        return False
    spark, rows = vectors.sparkSession, unit(vectors, key, vector)
    centres = store.read("centres", CENTRES).orderBy("cell").toArrow()
    new = centres.num_rows == 0
    if new:
        n = rows.count()
        sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(max(1, n // SAMPLE))) == 0).select("v").toArrow()
        x = _matrix(sample.column("v").combine_chunks()) if sample.num_rows else np.zeros((0, 1))
        c = fitted(x, min(cells or math.isqrt(n) + 1, CELLS, len(x))) if len(x) else x
    else:
        c = _matrix(centres.column("centre").combine_chunks())
    shared = spark.sparkContext.broadcast(c)  # CELLS centres at most
    kind = rows.schema["id"].dataType.simpleString()

    def placed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(1))
                own = nearest(x, shared.value)
                away = np.sqrt(np.maximum(2 - 2 * np.einsum("ij,ij->i", x, shared.value[own]), 0))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own, pa.int32()), pa.array(away)], names=["id", "v", "cell", "away"])

    made = rows.mapInArrow(placed, f"id {kind}, v array<double>, cell int, away double").persist()
    bounds = made.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius"))
    tables = {"vectors": made.repartition("cell"), "bounds": bounds}
    if new:
        tables["centres"] = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], CENTRES)
    done = store.commit(batch, tables, PARTS)
    made.unpersist()
    return done


def plan(store: Batches, query: list[float], top_k: int, least: float, probes: int | None) -> list[int]:
    """Cells to read: the ``probes`` nearest, or all that can hold one of the ``top_k`` nearest with at least the similarity."""
    q = np.array(query, float)
    q /= np.linalg.norm(q)
    rows = store.read("bounds").groupBy("cell").agg(F.max("radius").alias("radius")).join(store.read("centres"), "cell").collect()
    away = sorted((float(np.sqrt(max(2 - 2 * float(q @ np.array(r["centre"])), 0))), r["cell"], r["radius"]) for r in rows)
    if probes is not None:
        return [cell for _, cell, _ in away[:probes]]
    limit = math.sqrt(max(2 - 2 * least, 0)) + 1e-9
    first = [cell for d, cell, radius in away if d - radius <= limit][:FIRST]
    found = ranked(store, query, first, least).limit(top_k).collect() if first else []
    if len(found) == top_k:
        limit = min(limit, math.sqrt(max(2 - 2 * found[-1]["similarity"], 0)) + 1e-9)
    return first + [cell for d, cell, radius in away if d - radius <= limit and cell not in first]


def ranked(store: Batches, query: list[float], cells: list[int], least: float) -> DataFrame:
    q = np.array(query, float)
    asked = F.array(*[F.lit(float(x)) for x in q / np.linalg.norm(q)])
    rows = store.read("vectors").where(F.col("cell").isin(cells)).select("id", dot("v", asked).alias("similarity"))
    return rows.where(F.col("similarity") >= least).orderBy(F.desc("similarity"), "id")


def search(store: Batches, query: list[float], top_k: int = 10, least: float = 0.7, probes: int | None = None) -> DataFrame:
    """(id, similarity): the nearest vectors by cosine, best first. Exact, as ``reads.similar``: a cell is left out only if
    its bound says that it holds none of them. With ``probes``, only so many nearest cells are read."""
    return ranked(store, query, plan(store, query, top_k, least, probes), least).limit(top_k)


def search_many(store: Batches, queries: DataFrame, top_k: int = 10, probes: int = 8, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query, rank, id, similarity): for each query the nearest vectors of its ``probes`` nearest cells. Queries meet cells
    by a join, so neither has to fit anywhere as a whole."""
    rows = unit(queries, key, vector)
    centres = store.read("centres").orderBy("cell").toArrow()
    shared = queries.sparkSession.sparkContext.broadcast(_matrix(centres.column("centre").combine_chunks()))
    kind = rows.schema["id"].dataType.simpleString()

    def routed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                own = nearest(_matrix(b.column(1)), shared.value, max(2, probes))[:, :probes]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own.tolist(), pa.list_(pa.int32()))], names=["query", "q", "cells"])

    asked = rows.mapInArrow(routed, f"query {kind}, q array<double>, cells array<int>").select("query", "q", F.explode("cells").alias("cell"))
    found = asked.join(store.read("vectors"), "cell").select("query", "id", dot("q", "v").alias("similarity"))
    order = Window.partitionBy("query").orderBy(F.desc("similarity"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k).select("query", "rank", "id", "similarity")
