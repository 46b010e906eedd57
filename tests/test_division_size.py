"""Shuffle partitions that are put together stay small."""

from recollect.sources import tables


def test_partitions_are_put_together_to_16_mb(spark):
    names = ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    held = {c: spark.conf.get(c, None) for c in names}
    try:
        spark.conf.unset(names[0])
        tables.divide(spark)
        assert spark.conf.get(names[0]) == "16m"
        spark.conf.set(names[0], "8m")
        tables.divide(spark)
        assert spark.conf.get(names[0]) == "8m"
    finally:
        for c, v in held.items():
            spark.conf.unset(c) if v is None else spark.conf.set(c, v)
