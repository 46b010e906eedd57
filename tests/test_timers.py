"""Streams with timers against the batch reads at each watermark."""

import os
import random
from collections import Counter
from datetime import datetime, timedelta

from pyspark.sql import functions as F
from recollect.operators import reads
from recollect.sources import tables
from recollect.streaming import timers

START = datetime(2024, 1, 1)
FACT = "obs_id string, ts timestamp"
TIMER = "id string, ts timestamp, timeout long, event string, obs_id string, actor_pk string, object_pk string"

def at(minutes):
    return START + timedelta(minutes=minutes)

def streamed(spark, tmp_path, batches, schema, made):
    """What ``made`` gives of a stream with these micro-batches, with the number of the batch."""
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / f"in-{n}"))
    for n in range(len(batches)):  # files in the order of their times
        for f in sorted((tmp_path / f"in-{n}").glob("part-*.json")):
            (tmp_path / "in").mkdir(exist_ok=True)
            f.rename(tmp_path / "in" / f"{n}.json")

            os.utime(tmp_path / "in" / f"{n}.json", (1_000_000 + n, 1_000_000 + n))
    out = []
    q = made(tables.json_stream(spark, str(tmp_path / "in"), schema, 1)).writeStream.outputMode("append").foreachBatch(lambda df, n: out.extend((n, r) for r in df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(300)
    return out

def test_observations_end_and_end_again(spark, tmp_path):
    rng = random.Random(3)
    batches = [[(rng.choice("abcd"), at(90 * n + rng.randrange(90))) for _ in range(5)] for n in range(6)]
    batches += [[("a", at(900)), ("b", at(90))], [("z", at(5000))]]  # a goes on after it has ended; b comes too late
    got = [(r["obs_id"], r["ts"]) for _, r in streamed(spark, tmp_path, batches, FACT, lambda s: timers.ended_observations(s, 60, "0 seconds"))]
    want, triggers, rows, watermark = [], [], [], START - timedelta(days=1)
    for batch in batches:
        rows += [r for r in batch if r[1] > watermark]
        watermark = max(watermark, max(ts for _, ts in batch))
        seen = spark.createDataFrame([(o, "t", ts) for o, ts in dict(triggers).items()], "obs_id string, trigger_id string, ts_end timestamp")
        found = reads.ending_observations(spark.createDataFrame(rows, FACT).withColumn("ts", F.col("ts").cast("timestamp_ntz")), seen.withColumn("ts_end", F.col("ts_end").cast("timestamp_ntz")), "t", watermark, 60, strict=True).collect()
        want += [(r["obs_id"], r["ts"]) for r in found]
        triggers += [(r["obs_id"], r["ts"]) for r in found]
    assert Counter(got) == Counter(want) and max(Counter(o for o, _ in got).values()) > 1 and ("a", at(900)) in got

def test_timers_fire_once(spark, tmp_path):
    def timer(key, minute, timeout, obs="o", event="e"):
        return (key, at(minute), timeout, event, obs, "p", None)

    week = 7 * 24 * 3600
    batches = [[timer("a", 0, 600), timer("b", 0, 600), timer("long", 0, week + 60), timer("c", 1, 3600, "o1"), timer("c", 1, 600, "o2", None)],
               [timer("b", 5, 3600)],  # set anew before it fires
               [timer("x", 20, 99_999)], [timer("a", 100, 60)], [timer("y", 200, 10)], [timer("z", 60 * 24 * 9, 10)]]
    got = [(r["id"], r["ts"], r["timeout"], r["event"], r["obs_id"]) for _, r in streamed(spark, tmp_path, batches, TIMER, lambda s: timers.fired_timers(s, "0 seconds"))]
    assert Counter(got) == Counter([("a", at(0), 600, "e", "o"), ("b", at(5), 3600, "e", "o"), ("c", at(1), 600, None, "o2"), ("a", at(100), 60, "e", "o"), ("y", at(200), 10, "e", "o"), ("x", at(20), 99_999, "e", "o")])
    newest = spark.createDataFrame([r for b in batches for r in b], TIMER).groupBy("id").agg(F.max_by(F.struct("ts", "timeout"), F.struct("ts", "obs_id")).alias("t")).select("id", "t.*", F.lit(1).alias("status"))
    due = {r["id"] for r in reads.active_timers(newest, at(60 * 24 * 9)).collect()}
    assert due - {"long"} == {r[0] for r in got}
