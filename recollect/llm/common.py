"""Helpers shared by the training-data operators."""

from __future__ import annotations

import pickle
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch handled at a time, so that long texts don't pile up as Python objects.
SLICE = 256


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or that of ``setCheckpointDir``. Where none
    is set, a temporary one in local mode, in which all tasks are on this machine; an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="recollect-")
        spark.sparkContext.setCheckpointDir(base)
    return base


#: Paths of the tables that each open ``temporary`` block will delete.
_open: list[list[str]] = []


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables stored within the block are deleted at its end, but for those stored to be kept. What is returned from the
    block must rest on kept tables alone."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            discard(spark, path)


def store(df: DataFrame, name: str, keep: bool = False) -> str:
    """Write ``df`` as Parquet in the shared folder; its path. To be kept means by the block around, not by those further out."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if len(_open) > keep:
        _open[-1 - keep].append(path)
    return path


def kept(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As ``stored``, with the path, so that the table can be discarded."""
    path = store(df, name)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: it cuts lineage and survives lost executors."""
    return df.sparkSession.read.schema(df.schema).parquet(store(df, name, keep))


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table of ``store`` once all that is made from it is stored."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Shared:
    """A broadcast of objects of this package. Spark's own broadcast pickles them by reference, which executors without
    the package can't follow; here they are pickled by value, with their arrays beside them, and made again once a task
    around the broadcast's arrays, which aren't copied."""

    def __init__(self, spark: SparkSession, content: object) -> None:
        arrays: list[pickle.PickleBuffer] = []
        frame = cloudpickle.dumps(content, protocol=5, buffer_callback=arrays.append)
        self.pickled = spark.sparkContext.broadcast((frame, [np.frombuffer(a.raw(), np.uint8) for a in arrays]))

    def __getstate__(self) -> dict:
        return {"pickled": self.pickled}

    @property
    def value(self):
        if not hasattr(self, "content"):
            frame, arrays = self.pickled.value
            self.content = pickle.loads(frame, buffers=arrays)
        return self.content


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs of bytes other than space and \\t..\\r; ``bytes.split`` cuts at exactly these six."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def lower_words_of(text: str | None) -> list[bytes]:
    """As ``words_of``, with A-Z lower-cased (``bytes.lower`` changes ASCII letters only)."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long); root is the smallest node reachable.

    Alternates large-star and small-star until the edge set no longer changes. Minima are partial aggregates and are
    stored, so that both sides of the joins on a node are plain scans, and Spark can split a node with very many edges.
    Each round is a written checkpoint, and the one before is deleted.
    """
    spark = edges.sparkSession

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    e, path = kept(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = state(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest, low_path = kept(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "lowest")
        large, large_path = kept(both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        lowest, own_path = kept(large.groupBy("u").agg(F.min("v").alias("m")), "lowest")
        small = large.join(lowest, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
        e, new_path = kept(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")
        for old in (path, low_path, large_path, own_path):
            discard(spark, old)
        path, after = new_path, state(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
