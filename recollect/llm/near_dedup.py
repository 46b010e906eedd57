"""Near-duplicates at a word-shingle similarity: SimHash candidates through BK-trees, then an exact check."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, discard, lower_words_of, slices, store, stored, temporary
from .simhash import SEED, SHARD, BKTree

#: Families of 64-bit fingerprints; the first SKETCH of them are the sketch whose distances are taken.
FAMILIES, SKETCH = 16, 4
#: Candidates differ in at most so many of a sketch's 256 bits. At similarity 0.8 about 39 are expected, with a
#: standard deviation of 6 (for texts of a few shingles: 48).
RADIUS = 64
#: Bits of a bucket's key: the bits of all families, cut into 64 keys. At similarity 0.8 a pair shares each key with
#: a chance of 0.07, and one of the 64 with 0.99. ``key_bits`` of 20 or 24 with as many more FAMILIES suit tables of many
#: more than 10^8 distinct texts, as buckets grow with their number.
KEY_BITS = 16
#: The keys are searched in so many rounds; links that a round confirms spare the later ones all pairs they imply.
ROUNDS = 4
#: Up to so many texts' hashes (two longs each) or keys are broadcast to find their rows; more are joined by shuffle.
BROADCAST_ROWS = 500_000
#: Spanning forests taken from a bucket's candidates; buckets of up to SMALL sketches are compared at once, without a tree.
FORESTS, SMALL = 3, 32
#: Shingle hashes of a block of texts that are compared with each other or with another block's.
BLOCK = 250_000


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct XXH64 hashes of the text's word shingles (A-Z lower-cased; fewer words: the whole sequence)."""
    words = lower_words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends.tolist()[min(width, len(words)) - 1 :])], np.uint64))


def remixed(hashes: np.ndarray, families: int) -> np.ndarray:
    """A row of ``families`` hashes drawn from each hash."""
    x = hashes[:, None] + np.arange(1, families + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signature(hashes: np.ndarray, families: int) -> np.ndarray:
    """``families`` fingerprints of 64 bits: one is set if it is set in over half of the hashes."""
    counts = np.zeros(families * 64, np.int64)
    for at in range(0, len(hashes), 255):  # so many bits add up in a byte
        bits = np.unpackbits(remixed(hashes[at : at + 255], families).view(np.uint8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)


def sketches(docs: DataFrame, id_col: str, text_col: str, width: int, key_bits: int) -> DataFrame:
    """(doc_id, text, sketch, keys): texts without words have no sketch."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            bits, keys = [], []
            for text in part.column(1):
                hashes = shingle_hashes(text.as_py(), width)
                if not len(hashes):
                    bits.append(None)
                    keys.append(None)
                    continue
                every = signature(hashes, FAMILIES)
                bands = len(every) * 64 // key_bits
                cut = np.unpackbits(every.view(np.uint8), bitorder="little")[: bands * key_bits].reshape(bands, key_bits)
                bits.append(every[:SKETCH].tobytes())
                keys.append((cut @ (1 << np.arange(key_bits, dtype=np.int64))) * bands + np.arange(bands))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(bits, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                                             names=["doc_id", "text", "sketch", "keys"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(
        mapped, "doc_id long, text string, sketch binary, keys array<long>")


def walk(values: np.ndarray, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(value's index, query's index, distance) of all within the radius, by a BK-tree of the values: all queries walk
    it together, each along the edges within the radius of its distance to the node."""
    tree = BKTree([int.from_bytes(v.tobytes(), "little") for v in values])
    todo = [(0, np.arange(len(queries)))]
    while todo:
        at, walking = todo.pop()
        d = np.bitwise_count(queries[walking] ^ values[at]).sum(axis=1, dtype=np.int64)
        near = d <= radius
        if near.any():
            yield np.full(int(near.sum()), at), walking[near], d[near]
        for e, child in tree.edges[at].items():
            on = walking[np.abs(d - e) <= radius]
            if len(on):
                todo.append((child, on))


def spanning_forest(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Indices of a minimum spanning forest's edges, the edges being given in ascending order of weight."""
    label, left, taken = np.arange(n), np.arange(len(u)), []
    while len(left):
        a, b = label[u[left]], label[v[left]]
        open_ = a != b
        left, a, b = left[open_], a[open_], b[open_]
        if not len(left):
            break
        first, other, back = np.full(n, len(left)), np.full(n, len(left)), np.arange(len(left))[::-1]
        first[a[::-1]], other[b[::-1]] = back, back  # the last one written holds: the lightest edge
        first = np.minimum(first, other)
        chosen = np.unique(first[first < len(left)])
        taken.append(left[chosen])
        parent = np.arange(n)
        roots = np.flatnonzero(first < len(left))
        x, y = a[first[roots]], b[first[roots]]
        parent[roots] = np.where(x == roots, y, x)
        both = parent[parent[roots]] == roots  # two that chose each other: the smaller one stays a root
        parent[roots[both & (roots < parent[roots])]] = roots[both & (roots < parent[roots])]
        while (parent != parent[parent]).any():
            parent = parent[parent]
        label = parent[label]
    return np.concatenate(taken) if taken else np.zeros(0, np.int64)


def forest_edges(nodes: np.ndarray, u: np.ndarray, v: np.ndarray, d: np.ndarray, forests: int) -> pa.RecordBatch:
    """(a, b), nodes joined by the edges of successive minimum spanning forests, so that an edge that fails the
    exact check leaves others. A group of n near copies gives at most forests * (n - 1) edges, not all its pairs."""
    a, b = np.minimum(nodes[u], nodes[v]), np.maximum(nodes[u], nodes[v])
    order = np.lexsort((b, a, d))
    u, v, kept = u[order], v[order], []
    for _ in range(forests):
        at = spanning_forest(len(nodes), u, v)
        kept.append((nodes[u[at]], nodes[v[at]]))
        u, v = np.delete(u, at), np.delete(v, at)
    x, y = (np.concatenate([k[i] for k in kept]) for i in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])


def bucket(rows: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nodes, labels, sketches) of rows (node, label, sketch)."""
    raw = b"".join(rows.field("sketch").to_pylist())
    return rows.field("node").to_numpy(), rows.field("label").to_numpy(), np.frombuffer(raw, np.uint64).reshape(-1, SKETCH)


def keyed(nodes: DataFrame) -> DataFrame:
    """(node, label, sketch, key) of rows (node, sketch, keys, label); without ``label`` each node has its own."""
    label = "label" if "label" in nodes.columns else "node"
    return nodes.select("node", F.col(label).alias("label"), "sketch", F.explode("keys").alias("key"))


def candidate_links(nodes: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """Distinct (a, b), nodes whose sketches are within the radius, from distinct rows (node, sketch, keys)."""
    return search(keyed(nodes), radius, shard)


def search(rows: DataFrame, radius: int = RADIUS, shard: int = SHARD, forests: int = FORESTS) -> DataFrame:
    """Distinct ``forest_edges`` of the buckets of ``keyed`` rows, between nodes whose labels differ; it is stored."""
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key", "n")
    sizes = stored(sizes, "bucket-sizes")  # so that both sides of the join are scans, and Spark can split a hot key
    parts = (rows.join(sizes, "key").withColumn("shards", F.ceil(F.col("n") / shard).cast("int"))
             .withColumn("shard", F.pmod(F.xxhash64("node"), "shards"))
             .groupBy("key", "shards", "shard").agg(F.collect_list(F.struct("node", "label", "sketch")).alias("rows")))
    path = store(parts, "buckets")
    parts = rows.sparkSession.read.schema(parts.schema).parquet(path)

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2048):
            node, label, bits = bucket(part.column(0).flatten())
            length = part.column(0).value_lengths().to_numpy()
            start = np.cumsum(length) - length
            found = []
            place, small = np.repeat(start + length, length), np.repeat(length <= SMALL, length)
            for off in range(1, min(SMALL, int(length.max(initial=1)))):
                i = np.flatnonzero(small & (np.arange(len(node)) + off < place))
                d = np.bitwise_count(bits[i] ^ bits[i + off]).sum(axis=1, dtype=np.int64)
                near = (d <= radius) & (label[i] != label[i + off])
                found.append((i[near], i[near] + off, d[near]))
            for lo, n in zip(start[length > SMALL].tolist(), length[length > SMALL].tolist()):
                for i, j, d in walk(bits[lo : lo + n], bits[lo : lo + n], radius):
                    on = (i < j) & (label[i + lo] != label[j + lo])
                    found.append((i[on] + lo, j[on] + lo, d[on]))
            if found:
                yield forest_edges(node, *(np.concatenate([f[k] for f in found]) for k in range(3)), forests)

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            (x, s, p), (y, t, q) = bucket(part.column(0).flatten()), bucket(part.column(1).flatten())
            found = [(i[on], j[on], d[on]) for i, j, d in walk(p, q, radius) for on in [s[i] != t[j]]]
            if found:
                i, j, d = (np.concatenate([f[k] for f in found]) for k in range(3))
                yield forest_edges(np.concatenate((x, y)), i, j + len(x), d, forests)

    many = parts.where("shards > 1")
    asked = many.select("key", F.col("shard").alias("other"), F.col("rows").alias("queries"))
    crossed = many.join(asked, "key").where("shard < other").select("key", "shard", "other", "rows", "queries").repartition("key", "shard", "other")
    schema = "a long, b long"
    links = stored(parts.select("rows").mapInArrow(within, schema).unionByName(
        crossed.select("rows", "queries").mapInArrow(between, schema)).distinct(), "links")
    discard(rows.sparkSession, path)
    return links


def similar(links: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """The links (a, b) whose texts (node, text) have Jaccard similarity of shingles of at least ``similarity``."""

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            kept = []
            for i in range(part.num_rows):
                x, y = (shingle_hashes(part.column(c)[i].as_py(), width) for c in (2, 3))
                both = len(np.intersect1d(x, y, assume_unique=True))
                kept.append(both >= similarity * (len(x) + len(y) - both))
            yield part.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    a = texts.select(F.col("node").alias("a"), F.col("text").alias("x"))
    b = texts.select(F.col("node").alias("b"), F.col("text").alias("y"))
    return links.join(a, "a").join(b, "b").select("a", "b", "x", "y").mapInArrow(checked, "a long, b long")


def small(side: DataFrame) -> DataFrame:
    """``side``, a stored table, to be broadcast if it has few rows."""
    return F.broadcast(side) if side.count() <= BROADCAST_ROWS else side


def ends_of(links: DataFrame) -> DataFrame:
    return links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct()


def texts_of(ends: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, text) of ``ends`` (node), stored: one text of ``texts`` (text) for each, found by its hash in ``nodes``."""
    wanted = stored(nodes.join(ends, "node", "left_semi").select("node", "text_hash"), "wanted")
    hashed = texts.select("text", F.xxhash64("text").alias("text_hash"))
    return stored(hashed.join(small(wanted), "text_hash").groupBy("node").agg(F.min("text").alias("text")), "linked-texts")


def block(rows: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """(nodes, labels, components, sketches, sets of hashes) of rows (node, label, component, sketch, hashes)."""
    sets = [np.frombuffer(h, np.uint64) for h in rows.field("hashes").to_pylist()]
    nodes, labels, bits = bucket(rows)
    return nodes, labels, rows.field("component").to_numpy(), bits, sets


def confirmed_pairs(labels: np.ndarray, components: np.ndarray, bits: np.ndarray, sets: list[np.ndarray], first: int, similarity: float, radius: int) -> tuple[list[int], list[int]]:
    """Indices of linked pairs. Every pair of one component within the radius is checked exactly or joined already by
    labels and links found before: all pairs, or those of the ``first`` rows with the others if ``first`` is not 0."""
    n, size = len(sets), np.fromiter(map(len, sets), np.int64, len(sets))
    words, ids = np.unique(np.concatenate(sets), return_inverse=True)
    ids = np.split(ids, np.cumsum(size)[:-1])
    label, marked, u, v = np.unique(labels, return_inverse=True)[1], np.zeros(len(words), bool), [], []
    order = np.argsort(components[first:], kind="stable") + first
    lo, hi = (np.searchsorted(components[order], components, side) for side in ("left", "right"))
    for i in range(first or n):
        others = order[lo[i] : hi[i]]
        others = others[(others > i) & (label[others] != label[i])]
        others = others[np.minimum(size[others], size[i]) >= similarity * np.maximum(size[others], size[i])]
        others = others[np.bitwise_count(bits[others] ^ bits[i]).sum(axis=1, dtype=np.int64) <= radius]
        marked[ids[i]] = True
        for at in range(0, len(others), 64):
            some = others[at : at + 64]
            some = some[label[some] != label[i]]
            if not len(some):
                continue
            both = np.add.reduceat(marked[np.concatenate([ids[j] for j in some])], np.cumsum(size[some]) - size[some], dtype=np.int64)
            for j in some[both >= similarity * (size[i] + size[some] - both)].tolist():
                if label[j] != label[i]:
                    u.append(i)
                    v.append(j)
                    label[label == label[j]] = label[i]
        marked[ids[i]] = False
    return u, v


def missed_links(members: DataFrame, texts: DataFrame, width: int, similarity: float, radius: int = RADIUS, size: int | None = None) -> DataFrame:
    """Confirmed links (a, b) between labels of one component, from distinct rows (node, component, label, sketch) and
    texts (node, text); it is stored.

    Of each component, labels with more than ``size`` (BLOCK) hashes have blocks of their own, whose texts needn't be compared
    with each other; all other labels share blocks. Each block is compared in itself and with its component's others.
    """

    size = size or BLOCK

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets = [shingle_hashes(t, width) for t in part.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                                             names=["node", "component", "label", "sketch", "n", "hashes"])

    rows = stored(members.join(texts, "node").select("node", "component", "label", "sketch", "text").mapInArrow(
        hashed, "node long, component long, label long, sketch binary, n long, hashes binary"), "sets")
    own = stored(rows.groupBy("component", "label").agg(F.sum("n").alias("n")).where(F.col("n") > size).select("component", "label", F.ceil(F.col("n") / size).alias("shards")), "own")
    alone = rows.join(small(own), ["component", "label"]).withColumn("own", F.col("label"))
    shared = rows.join(small(own), ["component", "label"], "left_anti")
    sizes = stored(shared.groupBy("component").agg(F.ceil(F.sum("n") / size).alias("shards")), "sizes")
    shared = shared.join(small(sizes), "component").withColumn("own", F.lit(None).cast("long"))
    parts = alone.unionByName(shared).withColumn("shard", F.pmod(F.xxhash64("node"), "shards"))
    path = store(parts.groupBy("component", "own", "shard").agg(F.collect_list(F.struct("node", "label", "component", "sketch", "hashes")).alias("rows")), "blocks")
    blocks = rows.sparkSession.read.schema("component long, own long, shard long, rows " + parts.select(F.array(F.struct("node", "label", "component", "sketch", "hashes")).alias("r")).schema["r"].dataType.simpleString()).parquet(path)
    blocks = blocks.withColumn("at", F.struct(F.col("own").isNotNull().alias("alone"), F.coalesce("own", F.lit(0)).alias("own"), "shard")).drop("shard")

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 16):
            nodes, *of = block(part.column(0).flatten())
            if len(nodes):
                u, v = confirmed_pairs(*of, 0, similarity, radius)
                yield pa.RecordBatch.from_arrays([pa.array(nodes[np.array(c, np.int64)]) for c in (u, v)], names=["a", "b"])

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            x, y = block(part.column(0).flatten()), block(part.column(1).flatten())
            nodes, *of = (np.concatenate(c) for c in zip(x[:4], y[:4]))
            u, v = confirmed_pairs(*of, x[4] + y[4], len(x[0]), similarity, radius)
            yield pa.RecordBatch.from_arrays([pa.array(nodes[np.array(c, np.int64)]) for c in (u, v)], names=["a", "b"])

    listed = blocks.select("component", "own", "at")
    pairs = listed.join(listed.select("component", F.col("own").alias("other_own"), F.col("at").alias("other")), "component").where("at < other and not coalesce(own = other_own, false)")
    crossed = (pairs.select("component", "at", "other").join(blocks.select("component", "at", "rows"), ["component", "at"])
               .join(blocks.select("component", F.col("at").alias("other"), F.col("rows").alias("queries")), ["component", "other"]).repartition("component", "at", "other"))
    schema = "a long, b long"
    links = stored(blocks.where("own is null").select("rows").mapInArrow(within, schema).unionByName(
        crossed.select("rows", "queries").mapInArrow(between, schema)), "missed")
    discard(rows.sparkSession, path)
    return links


def linked(nodes: DataFrame, texts: DataFrame, width: int, similarity: float, key_bits: int) -> DataFrame:
    """(node, root) of all nodes (node, sketch, keys, text_hash) that are linked with another; texts (text) has their texts."""
    with_words = nodes.where("sketch is not null")
    roots = nodes.sparkSession.createDataFrame([], "node long, root long")
    bands, checked = FAMILIES * 64 // key_bits, []
    for k in range(ROUNDS):
        first, end = bands * k // ROUNDS, bands * (k + 1) // ROUNDS
        rows = keyed(with_words.join(roots, "node", "left").select("node", "sketch", F.slice("keys", first + 1, end - first).alias("keys"), F.coalesce("root", "node").alias("label")))
        links = search(rows, forests=1)
        if links.isEmpty():
            continue
        checked.append(links)
        confirmed = similar(links, texts_of(ends_of(links), nodes, texts), width, similarity)
        roots = stored(connected_components(confirmed.unionByName(roots.toDF("a", "b"))), "roots")
    if checked:
        within = connected_components(reduce(DataFrame.unionByName, checked)).withColumnRenamed("root", "component")
        within = stored(within.join(roots, "node", "left").select("node", "component", F.coalesce("root", "node").alias("label")), "components")
        # of two nodes the one pair is checked
        open_ = stored(within.groupBy("component").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).where("n > 2 and low < high").select("component"), "open")
        if not open_.isEmpty():
            members = stored(within.join(small(open_), "component", "left_semi").join(nodes.select("node", "sketch"), "node"), "members")
            missed = missed_links(members, texts_of(members.select("node"), nodes, texts), width, similarity)
            roots = stored(connected_components(missed.unionByName(roots.toDF("a", "b"))), "roots")
    return roots


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, key_bits: int = KEY_BITS) -> DataFrame:
    """(doc_id, component_id): documents linked where the sets of their word shingles are similar by ``similarity``.

    Candidates share a key of SimHash bits and are within the radius by BK-trees of their bucket; each link is then
    checked exactly on whole texts. Keys are searched in rounds, and pairs that confirmed links already join are not
    candidates of later rounds. A round checks a spanning forest of each bucket's candidates, so all candidates lie
    within components of the links it checked; components that confirmed links don't join whole are compared in full
    at the end, until each pair within the radius is checked or joined. Equal fingerprints are one node, so copies are
    not compared. component_id is the smallest doc_id reachable. Null, empty and blank texts are linked with each other. Repeated rows each give a row;
    a null doc_id has its component's smallest known id (null if there is none). Other columns are ignored. ``docs``
    is read once a round, so it should be a table rather than a long computation.
    """
    found = stored(sketches(docs, id_col, text_col, width, key_bits).select(
        "doc_id", "sketch", "keys", F.xxhash64("text").alias("text_hash"),
        F.when(F.col("sketch").isNull(), 0).otherwise(F.xxhash64("sketch", "keys")).alias("node")), "sketches")
    nodes = stored(found.groupBy("node").agg(*(F.min(c).alias(n) for c, n in (("doc_id", "low"), ("sketch", "sketch"), ("keys", "keys"), ("text_hash", "text_hash")))), "nodes")
    with temporary(docs.sparkSession):
        roots = stored(linked(nodes, docs.select(docs[text_col].cast("string").alias("text")), width, similarity, key_bits), "roots", keep=True)
    member = nodes.select("node", "low").join(roots, "node")
    reach = member.groupBy("root").agg(F.min("low").alias("reach"))
    reached = member.join(reach, "root").select("node", "reach")
    known = nodes.select("node", "low").join(reached, "node", "left").select("node", F.coalesce("reach", "low").alias("component_id"))
    return found.select("doc_id", "node").join(known, "node").select("doc_id", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component; rows with a null id stay only where no row of
    their component has one."""
    found = classes(docs, id_col, text_col, **how).where("component_id <=> doc_id").select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(found, docs[id_col].cast("long").eqNullSafe(found["_kept"]), "left_semi")
