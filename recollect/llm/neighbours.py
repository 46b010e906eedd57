"""Approximate nearest neighbours: stable projections in a kd-tree, searched until a chi-square test stops it."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Shared, stored

SEED = 7
#: Dimensions of the projection, and the chance that the stopping test may miss a neighbour.
PROJECTED, MISS = 8, 0.02
#: Vectors of a shard and queries of a block, about, and vectors of a leaf.
SHARD, BLOCK, LEAF = 8192, 1024, 128
#: Projections (about) from which the cells' tree is fitted, and of a cell at least: so cells number SAMPLE / PER_CELL at most.
SAMPLE, PER_CELL = 20_000, 16


def chi_square_quantile(p: float, dof: int) -> float:
    """For an even number of degrees of freedom, by bisection."""

    def below(x: float) -> float:
        term, total = 1.0, 1.0
        for i in range(1, dof // 2):
            term *= x / 2 / i
            total += term
        return 1 - math.exp(-x / 2) * total

    lo, hi = 0.0, 1000.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < p else (lo, mid)
    return hi


def directions(dim: int) -> np.ndarray:
    """Gaussian (2-stable) directions for vectors of ``dim`` components and the one that evens out their norms."""
    return np.random.default_rng(SEED + dim).standard_normal((dim + 1, PROJECTED))


def projections(vectors: np.ndarray, largest: float) -> np.ndarray:
    """A vector x gets one more component, so that all have the largest norm; then nearest by distance to (q, 0) is
    largest by inner product with q."""
    extra = np.sqrt(np.maximum(largest - np.einsum("ij,ij->i", vectors, vectors), 0))[:, None]
    return np.hstack((vectors, extra)) @ directions(vectors.shape[1])


def box_distances(at: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of projected queries from boxes."""
    out = np.zeros((len(at), len(low)))
    for d in range(PROJECTED):
        off = np.maximum(low[None, :, d] - at[:, d, None], at[:, d, None] - high[None, :, d])
        out += np.maximum(off, 0) ** 2
    return out


def halved(points: np.ndarray, leaf: int) -> list[np.ndarray]:
    """Indices of the points of each leaf of a kd-tree that halves along the widest axis."""
    leaves, todo = [], [np.arange(len(points))]
    while todo:
        at = todo.pop()
        if len(at) <= leaf:
            leaves.append(at)
            continue
        own = points[at]
        axis = int((own.max(axis=0) - own.min(axis=0)).argmax())
        order = at[np.argsort(own[:, axis], kind="stable")]
        todo += [order[: len(at) // 2], order[len(at) // 2 :]]
    return leaves


class ProjectedTree:
    """A kd-tree over projections of vectors, with the smallest id of each for ties."""

    def __init__(self, vectors: np.ndarray, first_ids: np.ndarray, largest: float):
        self.vectors, self.first_ids, self.largest = vectors, first_ids, largest
        points = projections(vectors, largest)
        self.leaves = halved(points, LEAF)
        self.low = np.array([points[at].min(axis=0) for at in self.leaves])
        self.high = np.array([points[at].max(axis=0) for at in self.leaves])

    def best(self, scores: np.ndarray, found: np.ndarray, k: int) -> np.ndarray:
        """Places of the k best of each row, equal scores by the smaller first id."""
        at = np.argpartition(-scores, k - 1, axis=1)[:, :k] if scores.shape[1] > k else np.broadcast_to(np.arange(k), scores.shape).copy()
        least = np.take_along_axis(scores, at, 1).min(axis=1)
        tied = np.flatnonzero(((scores >= least[:, None]).sum(axis=1) > k) & np.isfinite(least))
        if len(tied):
            ids = np.where(found[tied] >= 0, self.first_ids[found[tied]], np.iinfo(np.int64).max)
            at[tied] = np.lexsort((ids, -scores[tied]), axis=1)[:, :k]
        return at

    def search(self, queries: np.ndarray, k: int, reached: np.ndarray) -> np.ndarray:
        """Indices of the k best found for each query, in no order; -1 where there are fewer. ``reached`` is a score
        that k vectors elsewhere are known to have (-inf: none).

        Leaves are visited by their distance in the projection, and all vectors there verified. A query stops when a
        vector nearer than its k-th would lie that far off in the projection with probability MISS at most: squared
        projected over squared true distance is chi-square distributed.
        """
        limit = chi_square_quantile(1 - MISS, PROJECTED)
        n = len(queries)
        lengths = np.einsum("ij,ij->i", queries, queries)
        bounds = box_distances(queries @ directions(queries.shape[1])[:-1], self.low, self.high)
        order = np.argsort(bounds, axis=1, kind="stable")
        scores, found = np.full((n, k), -np.inf), np.full((n, k), -1)
        active = np.arange(n)
        for turn in range(len(self.leaves)):
            leaf = order[active, turn]
            kth = np.maximum(scores[active].min(axis=1), reached[active])
            distance = np.where(np.isfinite(kth), lengths[active] + self.largest - 2 * kth, np.inf)
            on = bounds[active, leaf] <= limit * np.maximum(distance, 0)
            active, leaf = active[on], leaf[on]
            if not len(active):
                break
            by_leaf = np.argsort(leaf, kind="stable")
            for group in np.split(by_leaf, np.flatnonzero(np.diff(leaf[by_leaf])) + 1):
                asking, members = active[group], self.leaves[leaf[group[0]]]
                new = queries[asking] @ self.vectors[members].T
                every = np.hstack((scores[asking], new))
                ids = np.hstack((found[asking], np.broadcast_to(members, new.shape)))
                best = self.best(every, ids, k)
                scores[asking], found[asking] = np.take_along_axis(every, best, 1), np.take_along_axis(ids, best, 1)
        return found


class Cells:
    """Boxes of the projections of one dimension's vectors; points belong to the cell whose side of each cut they lie on."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.cuts: list[tuple[int, float, int, int]] = []  # axis, threshold, and the two branches: ~cell or number of a cut
        self.count = 0
        self.boxes: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None  # of cells that have points: number, low, high
        self.root = self.cut(sample, cells)

    def cut(self, points: np.ndarray, cells: int) -> int:
        if cells <= 1 or len(points) < 2 * PER_CELL or (points.max(axis=0) == points.min(axis=0)).all():
            self.count += 1
            return -self.count
        axis = int((points.max(axis=0) - points.min(axis=0)).argmax())
        at = float(np.median(points[:, axis]))
        low = points[:, axis] < at
        if not low.any():
            at = float(np.nextafter(at, np.inf))
            low = points[:, axis] < at
        number = len(self.cuts)
        self.cuts.append((axis, at, 0, 0))
        self.cuts[number] = (axis, at, self.cut(points[low], (cells + 1) // 2), self.cut(points[~low], cells // 2))
        return number

    def of(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int64)
        todo = [(self.root, np.arange(len(points)))]
        while todo:
            node, at = todo.pop()
            if node < 0:
                out[at] = -node - 1
            elif len(at):
                axis, cut, below, above = self.cuts[node]
                low = points[at, axis] < cut
                todo += [(below, at[low]), (above, at[~low])]
        return out


def usable(e: Column) -> Column:
    """Not null, not zero, all components there and finite."""
    return e.isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)


def matrix(column: pa.ListArray, field: str) -> np.ndarray:
    rows = column.flatten()
    vectors = rows.field(field) if rows.offset == 0 else pa.array(rows.to_pylist(), rows.type).field(field)
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k rows of largest inner product found, its own id left out.

    Equal vectors are one point with their k + 1 smallest ids, all that a result can hold. Points fall into cells of
    their projection by a tree fitted on about SAMPLE of them, and within a cell by hash into shards of bounded size.
    Queries search their nearest cell first, in blocks; the k-th score found there then decides by the chi-square test
    which other cells each query visits. Where the test excludes little, that is queries x rows, in blocks. Results are
    merged by rank. Ties go to the smaller id; scores are double-precision inner products of the given vectors. Null,
    zero and non-finite vectors, and rows without an id, take no part. Repeated query rows count once. Vectors of
    different lengths don't meet. Fewer candidates than k give all; an empty table gives no rows.
    """
    spark = vectors.sparkSession

    def taken(df: DataFrame) -> DataFrame:
        e = df[vector_col]
        return df.select(df[id_col].cast("long").alias("id"), e.cast("array<double>").alias("e")).where(usable(F.col("e")) & F.col("id").isNotNull()).dropDuplicates(["id", "e"])

    order = Window.partitionBy("e").orderBy("id")
    points = taken(vectors).withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).groupBy("e").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    points = stored(points.withColumn("dim", F.size("e")), "points")
    norm = F.aggregate("e", F.lit(0.0), lambda a, x: a + x * x)
    totals = {r["dim"]: (r["n"], r["largest"]) for r in points.groupBy("dim").agg(F.count("*").alias("n"), F.max(norm).alias("largest")).collect()}
    every = sum(n for n, _ in totals.values())

    def projected(rows: DataFrame) -> DataFrame:
        """(dim, p): the projections."""

        def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [projections(x[None], totals[len(x)][1])[0].tolist() for x in map(np.array, batch.column(0).to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.list_(pa.float64()))], names=["dim", "p"])

        return rows.select("e", "dim").mapInArrow(mapped, "dim int, p array<double>")

    sample = projected(points.where(F.pmod(F.xxhash64("e"), F.lit(max(1, every // SAMPLE))) == 0)).collect()
    cells = {}
    for dim, (n, _) in totals.items():
        own = np.array([r["p"] for r in sample if r["dim"] == dim]).reshape(-1, PROJECTED)
        cells[dim] = Cells(own, math.ceil(n / SHARD))
    shared = Shared(spark, (cells, totals))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, sizes = shared.value
        for batch in batches:
            found = [projections(x[None], sizes[len(x)][1]) for x in map(np.array, batch.column(0).to_pylist())]
            cell = [int(trees[d].of(p)[0]) for d, p in zip(batch.column(2).to_pylist(), found)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array([p[0].tolist() for p in found], pa.list_(pa.float64()))], names=["e", "ids", "dim", "cell", "p"])

    points = stored(points.mapInArrow(placed, "e array<double>, ids array<long>, dim int, cell int, p array<double>"), "placed")
    boxes = points.groupBy("dim", "cell").agg(F.count("*").alias("n"), *[f(F.col("p")[d]).alias(f"{name}{d}") for d in range(PROJECTED) for name, f in (("low", F.min), ("high", F.max))]).collect()
    for dim, tree in cells.items():
        own = [r for r in boxes if r["dim"] == dim]
        tree.boxes = np.array([r["cell"] for r in own]), *(np.array([[r[f"{name}{d}"] for d in range(PROJECTED)] for r in own]) for name in ("low", "high"))
    routes = Shared(spark, (cells, totals))
    sizes = stored(points.groupBy("dim", "cell").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("shards")), "sizes")
    shards = points.join(F.broadcast(sizes), ["dim", "cell"]).withColumn("shard", F.pmod(F.xxhash64("e"), "shards"))
    shards = stored(shards.groupBy("dim", "cell", "shard").agg(F.collect_list(F.struct("e", "ids")).alias("points")), "shards")
    asked = stored(taken(queries).withColumn("dim", F.size("e")).where(F.col("dim").isin(list(totals))).withColumn("reached", F.lit(float("-inf"))), "asked")

    def routed(rows: DataFrame, first: bool) -> DataFrame:
        """(id, e, dim, reached, cell): each query's nearest cell, or all others that may hold a nearer vector."""

        def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trees, sizes = routes.value
            limit = chi_square_quantile(1 - MISS, PROJECTED)
            for batch in batches:
                to = []
                for q, reached in zip(map(np.array, batch.column(1).to_pylist()), batch.column(3).to_pylist()):
                    number, low, high = trees[len(q)].boxes
                    off = box_distances(q[None] @ directions(len(q))[:-1], low, high)[0]
                    home = int(off.argmin())
                    distance = max(q @ q + sizes[len(q)][1] - 2 * reached, 0.0)
                    near = np.flatnonzero(off <= limit * distance)
                    to.append([int(number[home])] if first else number[near[near != home]].tolist())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(to, pa.list_(pa.int32()))], names=["id", "e", "dim", "reached", "cells"])

        out = rows.select("id", "e", "dim", "reached").mapInArrow(mapped, "id long, e array<double>, dim int, reached double, cells array<int>")
        return out.select("id", "e", "dim", "reached", F.explode("cells").alias("cell"))

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, sizes = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                asked_by, held = batch.column(0).slice(i, 1), batch.column(1).slice(i, 1)
                q, x = matrix(asked_by, "e"), matrix(held, "e")
                ids = [r.as_py() for r in held.flatten().field("ids")]
                query_ids, reached = asked_by.flatten().field("id").to_pylist(), np.array(asked_by.flatten().field("reached").to_pylist())
                found = ProjectedTree(x, np.array([v[0] for v in ids]), sizes[x.shape[1]][1]).search(q, min(k + 1, len(x)), reached)
                out: list[tuple[int, int, float]] = []
                for j, query in enumerate(query_ids):
                    best = [(float(np.dot(q[j], x[p])), p) for p in found[j].tolist() if p >= 0]
                    every = sorted(((-s, v) for s, p in best for v in ids[p] if v != query and s >= reached[j]))
                    out += [(query, v, -s) for s, v in every[:k]]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in ((0, pa.int64()), (1, pa.int64()), (2, pa.float64()))], names=["query_id", "vec_id", "score"])

    def visited(rows: DataFrame) -> DataFrame:
        """(query_id, vec_id, score) from the cells that the queries are sent to, in blocks."""
        many = stored(rows, "visits")
        counts = many.groupBy("dim", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        many = many.join(F.broadcast(stored(counts, "counts")), ["dim", "cell"]).withColumn("block", F.pmod(F.xxhash64("id", "e"), "blocks"))
        blocks = stored(many.groupBy("dim", "cell", "block").agg(F.collect_list(F.struct("e", "id", "reached")).alias("asked")), "blocks")
        pairs = blocks.join(shards, ["dim", "cell"]).select("dim", "cell", "block", "shard", "asked", "points")
        return pairs.repartition("dim", "cell", "block", "shard").select("asked", "points").mapInArrow(searched, "query_id long, vec_id long, score double")

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))

    def best(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", rank).where(F.col("rank") <= k)

    home = stored(best(visited(routed(asked, True))), "home")
    reached = home.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") == k)
    known = asked.drop("reached").join(reached, asked["id"] == reached["query_id"], "left").withColumn("reached", F.coalesce("kth", F.lit(float("-inf"))))
    found = best(home.drop("rank").unionByName(visited(routed(known, False))))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
