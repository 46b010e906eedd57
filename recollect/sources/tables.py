"""Reading and writing the memory tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def divide(spark: SparkSession, parts: int = 600) -> None:
    """Let a task's share of the work stay small however few shuffle partitions are set: shuffles are dealt to ``parts``
    partitions, which adaptive execution puts together again where they are small, and files whose rows are short or
    become many (columns of equal values, traits of an entity) are read in small splits. Partitions are put together to 16 MB
    at most, since rows take twenty times that in memory where keys compress well. Sizes that were set stay."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", max(parts, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    if spark.conf.get("spark.sql.files.maxPartitionBytes") in ("134217728b", "134217728", "128m", "128MB"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2m")
        spark.conf.set("spark.sql.files.openCostInBytes", "1m")
    if spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") in ("67108864b", "67108864", "64m", "64MB"):
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "16m")


def append(df: DataFrame, path: str, batch_id: int, month_of: str | None = None) -> None:
    """Adds a batch under its number, so that a batch that runs again replaces itself; by month where a time is named."""
    out = df.withColumn("month", F.date_format(month_of, "yyyy-MM")) if month_of else df
    writer = out.write.mode("overwrite")
    (writer.partitionBy("month") if month_of else writer).parquet(f"{path}/batch={batch_id}")


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest full row of each key of an append-only log: one shuffle, combined map-side."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def project(df: DataFrame, mapping: dict[str, str], required: tuple[str, ...] = ()) -> DataFrame:
    """Columns by property name; rows without a required one go."""
    out = df.select(*[F.col(p).alias(c) for p, c in mapping.items()])
    for c in required:
        out = out.where(F.col(c).isNotNull())
    return out


def kafka_stream(spark: SparkSession, servers: str, topic: str, schema: str, per_trigger: int = 5000) -> DataFrame:
    """JSON observations of a Kafka topic as rows; needs Spark's Kafka package on the cluster."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("maxOffsetsPerTrigger", per_trigger).load()
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("o")).where("o.id is not null").select("o.*")


def json_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def table_counts(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """(name, rows) of tables."""
    parts = [read_table(spark, folder, n).agg(F.lit(n).alias("name"), F.count("*").alias("rows")) for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def create_table(spark: SparkSession, name: str, schema: str, partitioned_by: tuple[str, ...] = (), clustered_by: tuple[str, ...] = (), buckets: int = 64) -> None:
    """A Parquet table of the catalog, by month or tenant folders and in buckets of its key if asked for, so that joins on
    the key need no shuffle."""
    text = f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet"
    text += f" PARTITIONED BY ({', '.join(partitioned_by)})" if partitioned_by else ""
    text += f" CLUSTERED BY ({', '.join(clustered_by)}) SORTED BY ({', '.join(clustered_by)}) INTO {buckets} BUCKETS" if clustered_by else ""
    spark.sql(text)


def catalog(spark: SparkSession, database: str = "default") -> DataFrame:
    """(table, column, type) of the tables of a database; metadata only."""
    found = [(t.name, c.name, c.dataType) for t in spark.catalog.listTables(database) if not t.isTemporary for c in spark.catalog.listColumns(f"{database}.{t.name}")]
    return spark.createDataFrame(found, "table string, column string, type string")


def back_up(payloads: DataFrame, path: str, batch_id: int) -> None:
    """Raw payloads (id, ts, and whatever came with them) as they came, by month and batch."""
    append(payloads, path, batch_id, month_of="ts")


def kafka_sink(df: DataFrame, servers: str, topic: str, checkpoint: str, key: str | None = None):
    """Rows of a stream as JSON messages of a topic, keyed by a column if asked for; needs Spark's Kafka package."""
    out = df.select(*([F.col(key).cast("string").alias("key")] if key else []), F.to_json(F.struct(*df.columns)).alias("value"))
    return out.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint).start()
