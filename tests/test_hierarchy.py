"""Closures of parent pointers against walking up row by row."""

import random

from pyspark.sql import functions as F
from recollect.operators import hierarchy

TREE = "id int, parent_id int, name string"


def walked(rows):
    up = {i: p for i, p, _ in rows}
    pairs, cyclic = set(), set()
    for i in up:
        at, way = up[i], []
        while at in up and at not in way and at != i:
            way.append(at)
            at = up[at]
        if at in up:
            cyclic.add(i)
        else:
            pairs |= {(i, a, d + 1) for d, a in enumerate(way)}
    return pairs, cyclic


def test_closure_of_random_graphs(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice([None, *range(30)]) if i < 25 else i - 1, f"n{i}") for i in range(40)] + [(50, 50, "self"), (51, 99, "lost"), (52, 51, "under"), (None, 1, "no key")]
    above, cyclic = hierarchy.closure(spark.createDataFrame(rows, TREE))
    pairs, on = walked([r for r in rows if r[0] is not None])
    assert {tuple(r) for r in above.collect()} == pairs and {r["node"] for r in cyclic.collect()} == on and 50 in on
    paths = {r["id"]: (r["depth"], r["path"]) for r in hierarchy.paths(spark.createDataFrame(rows, TREE)).collect()}
    up, name = {i: p for i, p, _ in rows}, {i: n for i, _, n in rows}
    for i in up:
        way, at = [], i
        while at is not None and at in up and len(way) < 60:
            way.append(name[at])
            at = up[at]
        if at is None and i is not None:
            assert paths.pop(i) == (len(way) - 1, "/".join(reversed(way)))
    assert not paths


def test_deep_tree_takes_few_steps(spark, monkeypatch):
    steps = []
    real = hierarchy.stored
    monkeypatch.setattr(hierarchy, "stored", lambda df, name: steps.append(name) or real(df, name))
    deep = spark.range(1000).select(F.col("id").cast("int").alias("id"), F.when(F.col("id") > 0, F.col("id") - 1).cast("int").alias("parent_id"), F.lit("x").alias("name"))
    above, cyclic = hierarchy.closure(deep)
    assert len(steps) <= 24 and above.count() == 1000 * 999 // 2 and cyclic.count() == 0
    assert above.where("distance <> node - ancestor").count() == 0


def test_scores_reach_ancestors(spark):
    tree = spark.createDataFrame([(1, None, "a"), (2, 1, "b"), (3, 2, "c"), (4, 1, "d")], TREE)
    scores = spark.createDataFrame([("x", 3, 0.8), ("x", 4, 0.5), ("y", 1, 0.1), ("y", 9, 0.3)], "item string, class int, score double")
    got = {(r["item"], r["rank"], r["class"], r["score"], r["distance"]) for r in hierarchy.rolled_up(scores, tree).collect()}
    assert got == {("x", 1, 3, 0.8, 0), ("x", 2, 2, 0.4, 1), ("x", 3, 4, 0.5, 0), ("y", 1, 9, 0.3, 0), ("y", 2, 1, 0.1, 0)} - {("x", 2, 2, 0.4, 1), ("x", 3, 4, 0.5, 0)} | {("x", 2, 4, 0.5, 0), ("x", 3, 2, 0.4, 1)}
