"""Tables that change together: a batch of rows for several tables is seen whole or not at all."""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: One file a commit. ``whole``: the path replaces all that the table had.
LOG = "seq long, batch string, note string, tables array<struct<name: string, path: string, whole: boolean, schema: string>>"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one that driver and executors share (``spark.checkpoint.dir``); where none is set, a temporary
    one in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="recollect-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` in the shared folder and read it back: its plan ends there, and lost executors don't matter."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``df`` to be broadcast, if a count finds no more rows than that; else as it is, to be joined by a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


class Batches:
    """Append-only tables in ``folder``, with a log of commits.

    A batch's rows are written to folders of their own first, then one log file is added, which Spark's committer moves
    into place at once. Readers take the folders that the log names, so a batch that died between two tables is invisible,
    and its rerun writes all tables anew; a batch that is in the log already is left alone. One writer at a time, as a
    stream with a checkpoint has; any number of readers. The log grows by a line a batch and is read by the driver.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def log(self) -> list[Row]:
        """Commits in order; of two with one name the first counts."""
        try:
            rows = self.spark.read.schema(LOG).json(f"{self.folder}/commits").orderBy("seq").collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        seen: set[str] = set()
        return [r for r in rows if not (r["batch"] in seen or seen.add(r["batch"]))]

    def has(self, batch: str | int) -> bool:
        return any(r["batch"] == str(batch) for r in self.log())

    def next(self) -> int:
        """The number that the next commit will have."""
        log = self.log()
        return log[-1]["seq"] + 1 if log else 0

    def live(self, name: str) -> tuple[list[str], StructType | None]:
        """Folders of a table that count, and its newest schema."""
        paths: list[str] = []
        schema = None
        for commit in self.log():
            for t in commit["tables"]:
                if t["name"] == name:
                    paths = [t["path"]] if t["whole"] else [*paths, t["path"]]
                    schema = StructType.fromJson(json.loads(t["schema"]))
        return paths, schema

    def commit(self, batch: str | int, tables: dict[str, DataFrame], parts: dict[str, tuple[str, ...]] | None = None, whole: bool = False, note: str = "") -> bool:
        """Write the batch unless it is there; whether it was written. ``parts``: columns to make folders of."""
        log = self.log()
        if any(r["batch"] == str(batch) for r in log):
            return False
        seq = log[-1]["seq"] + 1 if log else 0
        made = []
        for name, df in tables.items():
            path = f"{self.folder}/{name}/_commit={seq}-{uuid.uuid4().hex}"
            writer = df.write
            if own := (parts or {}).get(name):
                writer = writer.partitionBy(*own)
            writer.parquet(path)
            made.append((name, path, whole, df.schema.json()))
        self.spark.createDataFrame([(seq, str(batch), note, made)], LOG).coalesce(1).write.mode("append").json(f"{self.folder}/commits")
        return True

    def read(self, name: str, schema: str | StructType | None = None) -> DataFrame:
        """Rows of all batches. A table that no batch has yet needs a schema, and is empty."""
        paths, found = self.live(name)
        if not paths:
            if schema is None:
                raise KeyError(f"no batch has a table {name}")
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(found).option("basePath", f"{self.folder}/{name}").parquet(*paths).select(*found.fieldNames())

    def compact(self, name: str, merge: Callable[[DataFrame], DataFrame], parts: tuple[str, ...] = ()) -> None:
        """Replace the rows of all batches by what ``merge`` makes of them, in one commit of its own."""
        self.commit(f"compact-{uuid.uuid4().hex}", {name: merge(self.read(name))}, {name: parts}, whole=True)

    def vacuum(self, name: str) -> int:
        """Delete a table's folders that no longer count, or never did; how many. For times without a writer or older readers."""
        live = {p.rsplit("/", 1)[1] for p in self.live(name)[0]}
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        gone = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith("_commit=") and s.getPath().getName() not in live]
        for path in gone:
            fs.delete(path, True)
        return len(gone)


def latest_of(keys: list[str], order: list[str]) -> Callable[[DataFrame], DataFrame]:
    """For ``compact``: the newest full row of each key."""

    def merge(df: DataFrame) -> DataFrame:
        rest = [c for c in df.columns if c not in keys]
        return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*").select(*df.columns)

    return merge
