"""How tables are dealt to tasks: a task's share doesn't grow with the tables."""

from pyspark.sql import functions as F
from recollect.plans.memory import Memory


def test_small_splits_and_many_parts(spark, tmp_path):
    spark.range(2_000_000, numPartitions=1).select(F.xxhash64("id").alias("id")).write.option("parquet.block.size", 1 << 20).parquet(f"{tmp_path}/part.parquet")
    held = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
            spark.conf.unset(c)
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        rows = Memory(spark, str(tmp_path)).raw("part")
        assert rows.select(F.spark_partition_id().alias("p")).distinct().count() >= 6  # 16 MB
        parts = rows.groupBy("id").count().select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
        assert len(parts) > 2 and sum(r["count"] for r in parts) == 2_000_000
    finally:
        for c, v in held.items():
            spark.conf.set(c, v)
