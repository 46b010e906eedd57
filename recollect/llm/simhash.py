"""SimHash fingerprints and their near pairs through BK-trees."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, lower_words_of, slices, stored, temporary

SEED = 42
#: Fingerprints of a shard's tree, about: a bucket with more is split among trees.
SHARD = 4096
#: Shingles whose bits are counted at a time.
BLOCK = 1 << 16


def fingerprint(text: str | None, width: int) -> int:
    """A bit is set if it is set in over half of the XXH64 hashes of the text's word shingles."""
    words = lower_words_of(text)
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    first, last = starts.tolist(), ends.tolist()[min(width, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, len(last), BLOCK):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(first[at : at + BLOCK], last[at : at + BLOCK])], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += (np.ones((1, len(bits)), np.float32) @ bits.astype(np.float32))[0].astype(np.int64)
    return sum(1 << int(i) for i in np.flatnonzero(2 * counts > len(last)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(doc_id, fp) of whole texts, as longs. Null, empty and blank texts have fingerprint zero."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = np.array([fingerprint(t, width) for t in part.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(mapped, "doc_id long, fp long")


class BKTree:
    """Distinct 64-bit integers; a node's children are keyed by their Hamming distance to it, so that a search of
    radius r follows only the edges within r of the query's distance to the node."""

    def __init__(self, values: list[int]):
        self.values = values
        self.edges: list[dict[int, int]] = [{} for _ in values]
        for new in range(1, len(values)):
            at, value = 0, values[new]
            while True:
                d = (values[at] ^ value).bit_count()
                child = self.edges[at].setdefault(d, new)
                if child == new:
                    break
                at = child

    def search(self, query: int, radius: int) -> list[int]:
        """Indices of the values within the radius."""
        found, todo = [], [0]
        while todo:
            at = todo.pop()
            d = (self.values[at] ^ query).bit_count()
            if d <= radius:
                found.append(at)
            edges = self.edges[at]
            todo += [edges[e] for e in range(d - radius, d + radius + 1) if e in edges]
        return found

    def search_all(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """(index, indices of the queries within the radius of it), with all queries walking the tree together."""
        todo = [(0, np.arange(len(queries)))]
        while todo:
            at, walking = todo.pop()
            d = np.bitwise_count(queries[walking] ^ np.uint64(self.values[at]))
            near = walking[d <= radius]
            if len(near):
                yield at, near
            for e, child in self.edges[at].items():
                on = walking[(d >= e - radius) & (d <= e + radius)]
                if len(on):
                    todo.append((child, on))


def star(values: list[int], others: list[int] | None, radius: int) -> Iterator[tuple[int, int]]:
    """(value, smallest value of its component) under links found by a tree of ``values``: among them if ``others``
    is None, else between them and ``others``. A component of n gives n - 1 rows, not all its pairs."""
    if others is None and len(values) == 2:
        if (values[0] ^ values[1]).bit_count() <= radius:
            yield values[1], values[0]
        return
    tree = BKTree(values)
    every = values if others is None else values + others
    label = np.arange(len(every))
    if others is None and len(values) <= 48:
        hits = ((at, np.array(found)) for at, v in enumerate(values) if len(found := tree.search(v, radius)) > 1)
    else:
        shift = 0 if others is None else len(values)
        hits = ((at, near + shift) for at, near in tree.search_all(np.array(values if others is None else others, np.uint64), radius))
    for at, near in hits:
        marks = label[near]
        low = min(int(marks.min()), int(label[at]))
        for old in {*np.unique(marks).tolist(), int(label[at])} - {low}:
            label[label == old] = low
    for root in np.unique(label[label != np.arange(len(every))]).tolist():
        same = [every[i] for i in np.flatnonzero(label == root).tolist()]
        low = min(same)
        yield from ((v, low) for v in same if v != low)


def signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def block_keys(fp: str, radius: int, blocks: int) -> F.Column:
    """Keys of which two fingerprints within the radius share one at least: the bits fall into ``blocks`` blocks, of
    which ``blocks - radius`` agree, and each choice of so many blocks gives a key."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    part = [F.shiftrightunsigned(fp, cuts[i]).bitwiseAND((1 << (cuts[i + 1] - cuts[i])) - 1) for i in range(blocks)]
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        key = F.lit(number).cast("long")
        for i in chosen:
            key = F.shiftleft(key, cuts[i + 1] - cuts[i]).bitwiseOR(part[i])
        keys.append(key)
    return F.array(*keys)


def blocks_for(count: int, radius: int) -> int:
    """The least number of blocks with which ``count`` random fingerprints give buckets of fewer than 256 on average. A
    fingerprint has a key for each choice of blocks, so their number is no larger than it has to be."""
    blocks = radius + 2
    while count >> (64 * (blocks - radius) // blocks) >= 256:
        blocks += 1
    return blocks


def near_links(distinct: DataFrame, radius: int, blocks: int, shard: int = SHARD) -> DataFrame:
    """Star edges (a, b) whose components are those of the links between the distinct fingerprints (``fp``).

    Fingerprints meet in the buckets of their block keys. A bucket's fingerprints form shards of bounded size, each
    with a BK-tree; a shard is searched by its own fingerprints and by those of the bucket's other shards, as blocks.
    So a tree is sent only to the query blocks that can match it, and no bucket has to fit in one task.
    """
    keyed = distinct.select("fp", F.explode(block_keys("fp", radius, blocks)).alias("key"))
    sizes = stored(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "bucket-sizes")
    parts = (keyed.join(sizes, "key")
             .withColumn("shards", F.ceil(F.col("n") / shard))
             .withColumn("shard", F.pmod(F.xxhash64("fp"), "shards"))
             .groupBy("key", "shards", "shard").agg(F.collect_list("fp").alias("fps")))
    parts = stored(parts, "shards")

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 4096):
            rows = part.column(0)
            flat, offsets = rows.flatten().to_numpy().view(np.uint64), np.cumsum([0, *rows.value_lengths().to_pylist()])
            pairs = [p for lo, hi in zip(offsets, offsets[1:]) if hi - lo > 1 for p in star(np.sort(flat[lo:hi]).tolist(), None, radius)]
            yield pa.RecordBatch.from_arrays([signed([p[i] for p in pairs]) for i in (0, 1)], names=["a", "b"])

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            x, y = (np.sort(part.column(i).flatten().to_numpy().view(np.uint64)).tolist() for i in (0, 1))
            pairs = list(star(x, y, radius))
            yield pa.RecordBatch.from_arrays([signed([p[i] for p in pairs]) for i in (0, 1)], names=["a", "b"])

    many = parts.where("shards > 1")
    x, y = many.select("key", "shard", "fps"), many.select("key", F.col("shard").alias("other"), F.col("fps").alias("queries"))
    blocks_of = x.join(y, "key").where("shard < other").select("fps", "queries").repartition(F.xxhash64("fps", "queries"))
    return parts.select("fps").mapInArrow(within, "a long, b long").unionByName(
        blocks_of.mapInArrow(between, "a long, b long")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4, blocks: int | None = None) -> DataFrame:
    """(doc_id, fingerprint, component_id): documents whose fingerprints are linked by at most ``radius`` bits.

    component_id is the smallest doc_id that can be reached. Equal fingerprints are one node, whatever their number.
    Without ``blocks``, their number follows that of the distinct fingerprints. Very long texts are taken whole; an
    empty table gives no rows.
    Null, empty and blank texts have fingerprint zero and are linked like others. Repeated rows each give a row; a
    null doc_id has its component's smallest known id (null if there is none). Other columns are ignored.
    """
    found = stored(fingerprints(docs, id_col, text_col, width), "fingerprints")
    lowest = stored(found.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    with temporary(docs.sparkSession):
        links = near_links(lowest, radius, blocks or blocks_for(lowest.count(), radius))
        roots = stored(connected_components(links), "roots", keep=True)
    member = lowest.join(roots.withColumnRenamed("node", "fp"), "fp")
    reach = member.groupBy("root").agg(F.min("low").alias("reach"))
    linked = member.join(reach, "root").select("fp", "reach")
    classes = lowest.join(linked, "fp", "left").select("fp", F.coalesce("reach", "low").alias("component_id"))
    return found.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: int) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component; rows with a null id stay only where no row of
    their component has one."""
    found = near_duplicates(docs, id_col, text_col, **how).where("component_id <=> doc_id").select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(found, docs[id_col].cast("long").eqNullSafe(found["_kept"]), "left_semi")
