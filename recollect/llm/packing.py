"""Packing token sequences by sum-of-squares online placement."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import slices

END_ID = b"\x00\x00\x00\x00"

PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
    T.StructField("ids_crc32", T.LongType()), T.StructField("doc_tokens", T.LongType()),
    T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()),
])


class Encoder:
    """Text to little-endian unsigned 32-bit ids of a byte-level BPE vocabulary.

    Such a vocabulary never merges across a blank that a non-blank follows, so a text is cut before these blanks and
    the pieces' ids are kept in a bounded cache. Texts with other runs of blanks are encoded whole. A text that holds
    a special token's string goes through the tokenizers library itself, which gives that token's id.
    """

    def __init__(self, vocabulary: str, cached: int = 300_000):
        import public_tokenizers
        import regex
        import tiktoken

        ranks = {}
        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
            for line in lines:
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
        self.plain = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.json = public_tokenizers.path(f"{vocabulary}.json")
        self.special = None
        self.odd = regex.compile(r" (?=[\s\x1c-\x1f\x85]|$)").search
        self.cached, self.known = cached, {}

    def special_tokens(self, text: str) -> np.ndarray:
        if self.special is None:
            from tokenizers import Tokenizer

            self.special = Tokenizer.from_file(self.json)
        return self.special.encode(text, add_special_tokens=False).ids

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if "<|" in text:
            return np.array(self.special_tokens(text), "<u4").tobytes()
        if self.odd(text):
            return np.array(self.plain(text), "<u4").tobytes()
        known, plain = self.known, self.plain
        first, *rest = text.split(" ")
        out = [np.array(plain(first), "<u4").tobytes()]
        for word in rest:
            ids = known.get(word)
            if ids is None:
                if len(known) >= self.cached:
                    known.clear()
                known[word] = ids = np.array(plain(" " + word), "<u4").tobytes()
            out.append(ids)
        return b"".join(out)


class LevelArray:
    """Partially filled windows by fill level; ``place`` keeps the sum of squared level counts as small as it can."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.counts = np.zeros(capacity + 1, np.int64)
        self.open: list[list] = [[] for _ in range(capacity + 1)]

    def choose(self, size: int) -> int:
        """The level that a piece of ``size`` goes to; 0 opens a window. Ties go to the fullest level."""
        top, n = self.capacity - size, self.counts
        # n[h] falls by one and n[h + size] grows by one; full windows aren't counted, and an empty one isn't either
        change = 2 * (n[size:] - n[: top + 1]) + 2
        change[top] = 1 - 2 * n[top] if top else 0
        change[:top][n[:top] == 0] = np.iinfo(np.int64).max
        if top and n[top] == 0:
            change[top] = np.iinfo(np.int64).max
        if top:
            change[0] = 2 * n[size] + 1
        return top - int(change[::-1].argmin())

    def place(self, piece: tuple, size: int) -> list | None:
        """Puts a piece into a window; returns that window's pieces once it is full."""
        level = self.choose(size)
        window = []
        if level:
            window = self.open[level].pop()
            self.counts[level] -= 1
        window.append(piece)
        if level + size == self.capacity:
            return window
        self.open[level + size].append(window)
        self.counts[level + size] += 1
        return None

    def close(self) -> Iterator[list]:
        """Windows still open: the emptiest are cut to fill the fullest, and the last is cut at powers of two."""
        left = [w for level in self.open[::-1] for w in level]
        sizes = [level for level in range(self.capacity, 0, -1) for _ in self.open[level]]
        at, last = 0, len(left) - 1
        while at < last:
            gap = self.capacity - sizes[at]
            take, rest = cut(left[last], gap)
            left[at] += take
            got = min(gap, sizes[last])
            sizes[at] += got
            sizes[last] -= got
            left[last] = rest
            if sizes[at] == self.capacity:
                yield left[at]
                at += 1
            if not sizes[last]:
                last -= 1
        if at == last and sizes[at]:
            rest, size = left[at], sizes[at]
            while size:
                part = 1 << (size.bit_length() - 1)
                take, rest = cut(rest, part)
                yield take
                size -= part


def cut(pieces: list, size: int) -> tuple[list, list]:
    """The first ``size`` ids of a list of (doc_id, start, ids, doc_tokens), and the others."""
    take, rest = [], []
    for doc_id, start, ids, total in pieces:
        n = len(ids) // 4
        k = min(n, size)
        size -= k
        if k:
            take.append((doc_id, start, ids[: 4 * k], total))
        if k < n:
            rest.append((doc_id, start + k, ids[4 * k :], total))
    return take, rest


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k", capacity: int = 1024, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset [, ids].

    Each input partition is packed as a stream, without a shuffle: full windows are cut off a document first, what is
    left goes to the fill level that minimises the sum of squared counts of partially filled windows. Only open
    windows are held in memory. A partition's last open windows are cut to fill each other, the very last one at
    powers of two, so no padding is left over. Sequence ids carry the partition's number: a task that runs again
    after a lost executor gives the same rows as long as its partition has the same order, and its sequences never
    mix with others'.

    Null and empty texts are documents of the end id alone. Repeated rows and repeated or null ids are documents of
    their own. Other columns are ignored. An empty table gives no rows.
    """
    schema = T.StructType(PIECES.fields + ([T.StructField("ids", T.ArrayType(T.IntegerType(), False))] if with_ids else []))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, levels = Encoder(vocabulary), LevelArray(capacity)
        sequence = TaskContext.get().partitionId() << 33
        out: list[list] = [[] for _ in schema.fields]

        def emit(window: list) -> None:
            nonlocal sequence
            offset = 0
            for doc_id, start, ids, total in window:
                n = len(ids) // 4
                row = [doc_id, start, n, zlib.crc32(ids), total, sequence, offset]
                for column, value in zip(out, row + ([np.frombuffer(ids, "<u4").astype(np.int32)] if with_ids else [])):
                    column.append(value)
                offset += n
            sequence += 1

        def flushed() -> pa.RecordBatch:
            kinds = [pa.int64()] * 7 + [pa.list_(pa.int32())] * with_ids
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=schema.names)
            for c in out:
                c.clear()
            return batch

        for part in slices(batches):
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                ids = encode(text) + END_ID
                total = len(ids) // 4
                full = total - total % capacity
                for start in range(0, full, capacity):
                    emit([(doc_id, start, ids[4 * start : 4 * (start + capacity)], total)])
                if full < total and (window := levels.place((doc_id, full, ids[4 * full :], total), total - full)):
                    emit(window)
            if len(out[0]) >= 4096:
                yield flushed()
        for window in levels.close():
            emit(window)
        yield flushed()

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(packed, schema)
