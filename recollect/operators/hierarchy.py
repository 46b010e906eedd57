"""Trees given by parent pointers: closures by doubling, paths, cycles, and class scores with their ancestors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.batches import stored


def closure(tree: DataFrame, key: str = "id", parent: str = "parent_id") -> tuple[DataFrame, DataFrame]:
    """(node, ancestor, distance) of all nodes and their proper ancestors; and (node) of those whose parents form a cycle
    or lead into one, which have no rows in the first.

    First pointers are doubled: those over ``d`` generations, joined with themselves, reach over ``2 d``. What is left when
    ``d`` exceeds the number of nodes runs round a cycle. Then the pairs of up to ``d`` generations are joined with the
    pointers over ``d`` and so grow to ``2 d``; a tree of depth 1,000 takes ten steps of each kind. Steps are stored, so
    plans stay small. A parent that isn't a row of the tree counts as none. One row a node is expected; of several the
    least parent counts.
    """
    nodes = tree.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("node")).agg(F.min(parent).alias("up"))
    jumps, count = [stored(nodes.join(nodes.select(F.col("node").alias("up")), "up", "left_semi").select("node", "up"), "jumps")], nodes.count()
    while 2 ** (len(jumps) - 1) <= count and not jumps[-1].isEmpty():
        onward = jumps[-1].select(F.col("node").alias("_via"), F.col("up").alias("_up"))
        jumps.append(stored(jumps[-1].join(onward, F.col("up") == F.col("_via")).select("node", F.col("_up").alias("up")), "jumps"))
    cyclic = jumps.pop().select("node")
    pairs = (jumps or [cyclic.select("node", F.col("node").alias("up")).limit(0)])[0].join(cyclic, "node", "left_anti").select("node", F.col("up").alias("ancestor"), F.lit(1).cast("long").alias("distance"))
    for at, jump in enumerate(jumps):
        near = pairs.select(F.col("node").alias("_via"), "ancestor", "distance")
        longer = jump.join(near, F.col("up") == F.col("_via")).select("node", "ancestor", (F.col("distance") + 2**at).alias("distance"))
        pairs = stored(pairs.unionByName(longer), "pairs")
    return pairs, cyclic


def paths(tree: DataFrame, key: str = "id", parent: str = "parent_id", name: str = "name") -> DataFrame:
    """(key, depth, path) of a tree's rows: names from the root down, joined by ``/``. Rows on a cycle, under one, or under
    a parent that isn't there have no root and give no path."""
    above, cyclic = closure(tree, key, parent)
    own = tree.select(F.col(key).alias("node"), F.col(name).alias("_name"), F.col(parent).alias("_parent"))
    named = above.join(own.select(F.col("node").alias("ancestor"), F.col("_name").alias("_above"), F.col("_parent").alias("_up")), "ancestor")
    root = F.max_by("_up", "distance")
    up = named.groupBy("node").agg(F.max("distance").alias("depth"), F.transform(F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("d"), F.coalesce("_above", F.lit("")).alias("n")))), lambda x: x["n"]).alias("names"), root.alias("_top"))
    rows = own.join(cyclic, "node", "left_anti").join(up, "node", "left").where(F.coalesce(F.col("_top"), F.when(F.col("depth").isNull(), F.col("_parent"))).isNull())
    names = F.concat(F.coalesce("names", F.array().cast("array<string>")), F.array(F.coalesce("_name", F.lit(""))))
    return rows.select(F.col("node").alias(key), F.coalesce("depth", F.lit(0)).cast("int").alias("depth"), F.array_join(names, "/").alias("path"))


def rolled_up(scores: DataFrame, tree: DataFrame, top: int = 3, key: str = "id", parent: str = "parent_id", decay: float = 0.5) -> DataFrame:
    """(item, rank, class, score, distance) of scores (item, class, score): the ``top`` classes of each item, where a class
    also has the best score of its descendants, less by the factor ``decay`` for each generation between; distance says
    how many. Equal scores go to the nearer class, then by name."""
    above, _ = closure(tree, key, parent)
    lifted = scores.join(above, scores["class"] == above["node"]).select("item", F.col("ancestor").alias("class"), (F.col("score") * F.pow(F.lit(decay), F.col("distance"))).alias("score"), "distance")
    every = scores.select("item", "class", "score", F.lit(0).cast("long").alias("distance")).unionByName(lifted)
    best = every.groupBy("item", "class").agg(F.max_by(F.struct("score", "distance"), F.struct("score", (-F.col("distance")).alias("near"))).alias("b")).select("item", "class", "b.*")
    order = Window.partitionBy("item").orderBy(F.desc("score"), "distance", "class")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("item", "rank", "class", "score", "distance")
