"""Removal of word windows that an earlier document has, found by shared anchors, then spans, then single windows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, kept, slices, stored, words_of

#: An odd multiplier of polynomial hashes modulo 2^64, and its inverse.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Words hashed at a time: a very long text is walked in blocks that overlap by a window.
BLOCK = 1 << 20


class WordHashes(dict):
    """64-bit hashes of words, kept while they are few."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value

    def __call__(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Windows:
    """Hashes of word windows of any length from prefix sums; a second, independent 64 bits on demand."""

    powers = np.ones(1, np.uint64)
    inverses = np.ones(1, np.uint64)

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        if len(Windows.powers) <= n:
            size = 2 * n + 1024
            Windows.powers = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size, BASE, np.uint64))))
            Windows.inverses = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size, INVERSE, np.uint64))))
        zero = np.zeros(1, np.uint64)
        self.sums = np.concatenate((zero, np.cumsum(hashes * Windows.powers[:n])))
        self.more = np.concatenate((zero, np.cumsum(mixed(hashes + np.uint64(1)) * Windows.powers[:n])))

    def of(self, starts: np.ndarray, ends: np.ndarray, second: bool = False) -> np.ndarray:
        sums = self.more if second else self.sums
        return mixed((sums[ends] - sums[starts]) * Windows.inverses[starts] + (ends - starts).astype(np.uint64)).view(np.int64)


def anchors(windows: Windows, n: int, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Half-length windows that are the smallest (by hash, first of equals) within some window of ``words`` words:
    their place and the first and last start of the windows they stand for. It depends on a window's words alone."""
    half = (words + 1) // 2
    at = np.arange(n - half + 1)
    hashes = windows.of(at, at + half).view(np.uint64)
    place = np.lib.stride_tricks.sliding_window_view(hashes, words - half + 1).argmin(axis=1) + np.arange(n - words + 1)
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    last = np.concatenate((first[1:], [len(place)])) - 1
    return place[first], first, last


def blocks(n: int, words: int) -> Iterator[tuple[int, int]]:
    for lo in range(0, max(n - words + 1, 0), BLOCK):
        yield lo, min(n, lo + BLOCK + words - 1)


def repeated_windows(docs: DataFrame, words: int = 50) -> DataFrame:
    """(doc_id, text_hash, ranges): starts of windows of ``words`` words that also start in a document with a smaller id.

    Level one: every window of ``words`` words stands behind its anchor, a window of half its length, and only anchors
    that two documents share go on. Level two: all words an anchor stands for (its span, at most twice the windows'
    length less one) are compared at once; a span that an earlier document has whole is settled. Level three: the
    windows of the spans left over, one by one. Nothing that is settled can hide an earlier occurrence, as the
    earliest holder of a span is never settled itself.
    """

    def first_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for part in slices(batches):
            columns: list[list] = [[] for _ in range(7)]
            for doc_id, text_hash, text in zip(*(part.column(i).to_pylist() for i in range(3))):
                found = words_of(text)
                if doc_id is None or len(found) < words:
                    continue
                hashes = known(found)
                for lo, hi in blocks(len(found), words):
                    w = Windows(hashes[lo:hi])
                    place, first, last = anchors(w, hi - lo, words)
                    ends = last + words
                    for c, v in zip(columns, (np.full(len(place), doc_id), np.full(len(place), text_hash), w.of(place, place + (words + 1) // 2), w.of(first, ends), w.of(first, ends, True), first + lo, last + lo)):
                        c.append(v)
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in columns], names=["doc_id", "text_hash", "anchor", "span1", "span2", "lo", "hi"])

    slim = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    places, anchors_path = kept(slim.mapInArrow(first_level, "doc_id long, text_hash long, anchor long, span1 long, span2 long, lo long, hi long")
                    .select("doc_id", "text_hash", "anchor", "span1", "span2", F.col("lo").cast("int"), F.col("hi").cast("int")), "anchors")
    shared = places.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("anchor")
    shared, own_path = kept(shared, "shared-anchors")  # so that both sides of the join are scans, and Spark can split a hot anchor
    places, shared_path = kept(places.join(shared, "anchor").drop("anchor"), "shared")
    earliest, earliest_path = kept(places.groupBy("span1", "span2").agg(F.min("doc_id").alias("low")), "earliest")
    places = stored(places.join(earliest, ["span1", "span2"]).select("doc_id", "text_hash", "lo", "hi", (F.col("low") < F.col("doc_id")).alias("settled")), "spans")
    for path in (anchors_path, own_path, shared_path, earliest_path):
        discard(docs.sparkSession, path)

    def third_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for part in slices(batches):
            columns: list[list] = [[] for _ in range(5)]
            for doc_id, text_hash, text, ranges in zip(*(part.column(i).to_pylist() for i in range(4))):
                hashes = known(words_of(text))
                starts = np.unique(np.concatenate([np.arange(r["lo"], r["hi"] + 1) for r in ranges]))
                for lo, hi in blocks(len(hashes), words):
                    own = starts[(starts >= lo) & (starts <= hi - words)] - lo
                    if len(own):
                        w = Windows(hashes[lo:hi])
                        for c, v in zip(columns, (np.full(len(own), doc_id), np.full(len(own), text_hash), w.of(own, own + words), w.of(own, own + words, True), own + lo)):
                            c.append(v)
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in columns], names=["doc_id", "text_hash", "h1", "h2", "lo"])

    left = places.where("not settled").groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    single = stored(slim.dropDuplicates(["doc_id", "text_hash"]).join(left, ["doc_id", "text_hash"]).select("doc_id", "text_hash", "text", "ranges")
                    .mapInArrow(third_level, "doc_id long, text_hash long, h1 long, h2 long, lo long"), "windows")
    lowest = single.groupBy("h1", "h2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").drop("high")
    lowest = stored(lowest, "lowest")
    single = single.join(lowest, ["h1", "h2"]).where("low < doc_id").select("doc_id", "text_hash", F.col("lo").cast("int"), F.col("lo").cast("int").alias("hi"))
    return places.where("settled").select("doc_id", "text_hash", "lo", "hi").unionByName(single).groupBy("doc_id", "text_hash").agg(
        F.collect_list(F.struct("lo", "hi")).alias("ranges"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 50) -> DataFrame:
    """The input's rows with kept_text, n_words, n_removed and kept_sha256 in place of equally named columns.

    Each word that a repeated window covers is removed. kept_text has the other words, joined by one blank; it is the
    unchanged text where nothing was removed, and null for a null text. Windows are judged on the input. Rows with the
    same id don't remove each other's words, whether their texts are equal or not; a row with a null id neither
    removes nor loses words. Texts of fewer than ``words`` words stay whole.
    """
    made = ["kept_text", "n_words", "n_removed", "kept_sha256"]
    rest = [c for c in docs.columns if c not in made and c != text_col]
    keyed = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), F.struct(*[docs[c] for c in rest]).alias("row"))
    ranges = repeated_windows(keyed, words)
    joined = keyed.withColumn("text_hash", F.xxhash64("text")).join(ranges, ["doc_id", "text_hash"], "left").select("text", "ranges", "row")
    schema = f"`{text_col}` string, kept_text string, n_words long, n_removed long, kept_sha256 string, row " + keyed.schema["row"].dataType.simpleString()

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            columns: list[list] = [[] for _ in range(4)]
            for text, spans in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                found = words_of(text)
                keep = found
                if spans:
                    depth = np.zeros(len(found) + 1, np.int64)
                    np.add.at(depth, [r["lo"] for r in spans], 1)
                    np.add.at(depth, [r["hi"] + words for r in spans], -1)
                    keep = [found[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]
                kept = b" ".join(keep)
                for c, v in zip(columns, (kept.decode("utf-8", "surrogatepass") if spans else text, len(found), len(found) - len(keep), hashlib.sha256(kept).hexdigest())):
                    c.append(v)
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)], part.column(2)], names=[text_col, *made, "row"])

    out = joined.mapInArrow(removed, schema)
    return out.select(*[out[text_col] if c == text_col else out["row"][c].alias(c) for c in docs.columns if c not in made], *made)
