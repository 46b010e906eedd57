"""Identities kept up to date against stitching from scratch, after any sequence of changes."""

import random

import pytest
from pyspark.sql import functions as F
from recollect.operators import reads, stitching
from recollect.sources.batches import Batches

PROPERTY = "observer_pk string, entity_pk string, entity_type string, property_name string, property_value string, ts long"
GID = "entity_pk string, entity_gid string, ts long"


def from_scratch(spark, properties, gids):
    """By loops over all rows ever given."""
    gid, best = {}, {}
    for pk, g, ts in gids:
        if pk not in gid or (ts, g is not None, g or "") > gid[pk][0]:
            gid[pk] = ((ts, g is not None, g or ""), g)
    for observer, pk, _, name, value, ts in properties:
        key = (gid.get(pk, (None, None))[1] or pk, name)
        order = (ts, observer, pk, value is not None, value or "")
        if key not in best or order > best[key][0]:
            best[key] = (order, value)
    out = {}
    for (identity, name), (_, value) in best.items():
        out.setdefault(identity, {})[name] = value
    return out


def seen(store):
    return {r["identity"]: r["traits"] for r in stitching.view(store).collect()}


@pytest.mark.parametrize("seed", range(3))
def test_any_sequence_of_changes(spark, tmp_path, seed):
    rng, store, every, moves = random.Random(seed), Batches(spark, str(tmp_path / "s")), [], []
    for batch in range(6):
        new = [(rng.choice("AB"), f"p{rng.randrange(6)}", "person", rng.choice(["name", "city"]), rng.choice(["x", "y", None]), rng.randrange(20)) for _ in range(rng.randrange(5))]
        gids = [(f"p{rng.randrange(6)}", rng.choice(["G", "H", None, "p0"]), rng.randrange(20)) for _ in range(rng.randrange(4))]
        every, moves = every + new, moves + gids
        assert stitching.stitch(store, batch, spark.createDataFrame(new, PROPERTY), spark.createDataFrame(gids, GID))
        assert seen(store) == from_scratch(spark, every, moves), (seed, batch)
        if batch == 3:
            stitching.compact(store)
            assert seen(store) == from_scratch(spark, every, moves)
    state = spark.createDataFrame(every, PROPERTY).groupBy("observer_pk", "entity_pk", "property_name").agg(F.max_by(F.struct("property_value", "ts"), F.struct("ts", "property_value")).alias("r")).select("observer_pk", "entity_pk", "property_name", "r.*")
    gids = stitching.newest_gids(spark.createDataFrame(moves, GID))
    assert seen(store) == {r["identity"]: r["traits"] for r in reads.stitched(state, gids).collect()}


def test_what_used_to_go_wrong(spark, tmp_path):
    store = Batches(spark, str(tmp_path / "s"))
    rows, none = [("A", "p1", "person", "name", "old", 5), ("A", "p2", "person", "city", "Rome", 5)], spark.createDataFrame([], GID)
    stitching.stitch(store, 0, spark.createDataFrame(rows, PROPERTY), none)
    assert seen(store) == {"p1": {"name": "old"}, "p2": {"city": "Rome"}}
    gids = spark.createDataFrame([("p1", "G", 6), ("p2", "G", 6)], GID)  # identities alone change
    assert stitching.stitch(store, 1, spark.createDataFrame([], PROPERTY), gids)
    assert seen(store) == {"G": {"name": "old", "city": "Rome"}}
    late = spark.createDataFrame([("A", "p1", "person", "age", "7", 1)], PROPERTY)  # older than all that was stitched
    stitching.stitch(store, 2, late, none)
    assert seen(store) == {"G": {"name": "old", "city": "Rome", "age": "7"}}
    assert not stitching.stitch(store, 2, late, none)  # a batch that runs again
    stitching.stitch(store, 3, spark.createDataFrame([], PROPERTY), spark.createDataFrame([("p1", "H", 7), ("p2", "I", 2)], GID))
    assert seen(store) == {"H": {"name": "old", "age": "7"}, "G": {"city": "Rome"}}  # p2's change is late and void
