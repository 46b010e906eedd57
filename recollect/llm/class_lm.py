"""Scoring by a class-based bigram model whose word classes come from exchange clustering of all training words."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Shared, discard, lower_words_of, slices, store, stored, temporary

#: The end token's number; words are known by their 64-bit hashes, and none is empty.
END = -1
#: Most frequent words that are clustered first, all against all; and those whose classes every task holds (17 bytes
#: each). Both are bounds of what is collected and broadcast; counts, contexts and classes cover all words.
CORE, HEAD = 1024, 1_000_000
#: Classes of words. Their numbers are followed by that of the end and that of words not seen in training.
CLASSES = 64
#: Numbers held by a task before they are added up and passed on.
HELD = 1_000_000
#: Sweeps over the words outside the core end when so small a share of them moves, or when they gain no likelihood.
FEW = 0.005


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


class Hashes(dict):
    """64-bit hashes of words as longs, kept while they are few."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        value = xxhash.xxh64_intdigest(word)
        value -= (value >> 63) << 64
        self[word] = value = value if value != END else END - 1
        return value


def encoded(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(uid, doc_id, held_out, words): the hashes of a text's lower-cased words, 8 bytes each."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, uid = Hashes(), TaskContext.get().partitionId() << 33
        for part in slices(batches):
            words = [lower_words_of(t) for t in part.column(2).to_pylist()]
            raw = [np.fromiter(map(known.__getitem__, w), np.int64, len(w)).tobytes() for w in words]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(uid, uid + len(raw))), part.column(0), part.column(1), pa.array(raw, pa.binary())], names=["uid", "doc_id", "held_out", "words"])
            uid += len(raw)

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), held_out(docs[id_col]).alias("held_out"), docs[text_col].alias("text"))
    return rows.mapInArrow(mapped, "uid long, doc_id long, held_out boolean, words binary")


def tokens(column: pa.Array) -> np.ndarray:
    """The words of all texts of a column one after another, with the end token before the first and after each."""
    end = np.array([END], np.int64).tobytes()
    return np.frombuffer(end + end.join(column.to_pylist()) + end, np.int64)


def added_up(batches: Iterable[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Distinct pairs (first, second) and how often they come, from pairs added up as far as HELD of them fit."""

    def summed(held: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = (np.concatenate([h[i] for h in held]) for i in (0, 1))
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        at = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))) if len(a) else np.zeros(0, np.int64)
        return a[at], b[at], np.diff(np.append(at, len(a)))

    held, n = [], 0
    for pairs in batches:
        held.append(pairs)
        n += len(pairs[0])
        if n >= HELD:
            yield summed(held)
            held, n = [], 0
    if held:
        yield summed(held)


def count_words(training: DataFrame) -> DataFrame:
    """(word, n) of all tokens of encoded texts."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for word, _, n in added_up((w, np.zeros(len(w), np.int8)) for part in slices(batches) for w in [tokens(part.column(0))[1:]]):
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(n)], names=["word", "n"])

    return training.select("words").mapInArrow(counted, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Lookup:
    """Numbers of some words; -1 of all others."""

    def __init__(self, words: np.ndarray, values: np.ndarray):
        order = np.argsort(words)
        self.words, self.values = words[order], values[order]

    def at(self, words: np.ndarray) -> np.ndarray:
        """Places of the words in ``values``; -1 where a word isn't there."""
        if not len(self.words):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, at, -1)

    def __call__(self, words: np.ndarray) -> np.ndarray:
        at = self.at(words)
        return np.where(at >= 0, self.values[at], -1) if len(self.values) else at


def count_bigrams(training: DataFrame, core) -> DataFrame:
    """(a, b, n): symbol and next symbol, as the lookup has them; -1 stands for all other words."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for part in slices(batches):
                s = core.value(tokens(part.column(0))).astype(np.int32)
                yield s[:-1], s[1:]

        for a, b, n in added_up(pairs()):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n)], names=["a", "b", "n"])

    return training.select("words").mapInArrow(counted, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def x_log_x(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def exchange(bigrams: np.ndarray, clustered: int) -> tuple[np.ndarray, np.ndarray]:
    """(class of each symbol, class bigram counts).

    Words move, one at a time, to the class that raises the likelihood of class bigrams most, in sweeps over all
    clustered words until none moves; symbols after them keep a class each.
    """
    size = len(bigrams)
    classes = min(CLASSES, max(1, clustered))
    of = np.concatenate((np.arange(clustered) % classes, classes + np.arange(size - clustered)))
    k = classes + size - clustered
    member = np.zeros((size, k))
    member[np.arange(size), of] = 1
    after, before = bigrams @ member, bigrams.T @ member  # of a word, by the class of its neighbour
    table = member.T @ after
    least = max(1e-9, 1e-12 * float(x_log_x(table.sum())))  # above rounding errors, so no word goes to and fro
    moved = 1
    while moved:
        moved = 0
        for w in range(clustered):
            own, loop = of[w], bigrams[w, w]
            right, left = after[w].copy(), before[w].copy()
            right[own] -= loop
            left[own] -= loop
            table[own] -= right
            table[:, own] -= left
            table[own, own] -= loop
            total = table.sum(axis=1) + left  # tokens of each class but the word's: those before it count wherever it goes
            n = right.sum() + loop
            c = np.arange(classes)
            rows, columns = table[:classes], table[:, :classes].T
            gain = (x_log_x(rows + right) - x_log_x(rows)).sum(axis=1) + (x_log_x(columns + left) - x_log_x(columns)).sum(axis=1)
            corner = table[c, c]
            gain += x_log_x(corner + right[:classes] + left[:classes] + loop) - x_log_x(corner + right[:classes]) - x_log_x(corner + left[:classes]) + x_log_x(corner)
            gain -= 2 * (x_log_x(total[:classes] + n) - x_log_x(total[:classes]))
            best = int(gain.argmax())
            if gain[best] <= gain[own] + least:
                best = own
            table[best] += right
            table[:, best] += left
            table[best, best] += loop
            if best != own:
                moved += 1
                of[w] = best
                after[:, own] -= bigrams[:, w]
                after[:, best] += bigrams[:, w]
                before[:, own] -= bigrams[w]
                before[:, best] += bigrams[w]
    return of, table


def core_classes(training: DataFrame, counts: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, classes, table) of the core by exchange; table[d, c]: tokens of class c after context d. Contexts are
    the classes, the end, and all words outside the core."""
    top = counts.where(F.col("word") != END).orderBy(F.desc("n"), "word").limit(CORE).select("word").toArrow().column("word").to_numpy()
    k = len(top)
    lookup = Shared(training.sparkSession, Lookup(np.append(top, END), np.arange(k + 1)))
    found = count_bigrams(training, lookup).toArrow()
    a, b, n = (found.column(c).to_numpy() for c in ("a", "b", "n"))
    bigrams = np.zeros((k + 2, k + 2))
    np.add.at(bigrams, (np.where(a < 0, k + 1, a), np.where(b < 0, k + 1, b)), n)
    of, exchanged = exchange(bigrams, k)
    classes = len(exchanged) - 2
    table = np.zeros((CLASSES + 2, CLASSES))
    table[:classes, :classes], table[CLASSES:, :classes] = exchanged[:classes, :classes], exchanged[classes:, :classes]
    return top, of[:k], table


def contexts(training: DataFrame, core) -> DataFrame:
    """(word, n, before): for each word outside the core how often it comes, and (context, n) of the words before it."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for part in slices(batches):
                words = tokens(part.column(0))
                kind = core.value(words).astype(np.int16)
                at = np.flatnonzero(kind[1:] < 0)
                yield words[1:][at], np.where(kind[at] < 0, CLASSES + 1, kind[at])

        for word, context, n in added_up(pairs()):
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(context, pa.int16()), pa.array(n)], names=["word", "context", "n"])

    # one shuffle: the sums by word and context, and those by word, keep the partitioning by word
    rows = training.select("words").mapInArrow(counted, "word long, context short, n long").repartition("word").groupBy("word", "context").agg(F.sum("n").alias("n"))
    return rows.groupBy("word").agg(F.sum("n").alias("n"), F.collect_list(F.struct("context", "n")).alias("before"))


def choices(context: np.ndarray, n: np.ndarray, starts: np.ndarray, own: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The class of most likelihood for each word, given the counts of its contexts; own class -1: none so far.

    The likelihood is that of a word's class after its context, sum of N(d, c) log N(d, c) less that of N(c) log N(c)."""
    total, lengths = np.zeros(len(own)), np.diff(np.append(starts, len(n)))
    word = np.repeat(np.arange(len(own)), lengths)
    np.add.at(total, word, n)
    x = table[context]
    mine = own[word]
    at = np.flatnonzero(mine >= 0)
    x[at, mine[at]] -= n[at]
    gain = np.add.reduceat(x_log_x(x + n[:, None]) - x_log_x(x), starts, axis=0)
    sizes = np.repeat(table.sum(axis=0)[None], len(own), axis=0)
    at = np.flatnonzero(own >= 0)
    sizes[at, own[at]] -= total[at]
    gain -= x_log_x(sizes + total[:, None]) - x_log_x(sizes)
    best = gain.argmax(axis=1)
    return np.where((own >= 0) & (gain[np.arange(len(own)), best] <= gain[np.arange(len(own)), own] + 1e-9), own, best)


def likelihood(table: np.ndarray) -> float:
    return float(x_log_x(table).sum() - x_log_x(table.sum(axis=0)).sum())


def clustered(training: DataFrame, counts: DataFrame) -> DataFrame:
    """(word, n, class) of all training words but the end; it is stored.

    The core is clustered on the driver from its bigrams. All other words are then exchanged on Spark, where each goes
    to its best class by the counts of the classes before it: sweeps take the class table of the sweep before, until
    few words move or the likelihood no longer rises; the best assignment holds.
    """
    spark = training.sparkSession
    top, of, core_table = core_classes(training, counts)
    core = Shared(spark, Lookup(np.append(top, END), np.append(of, CLASSES)))
    fields = "word long, n long, before array<struct<context:short,n:long>>, class short, moved boolean"
    path = store(contexts(training, core).withColumn("class", F.lit(-1).cast("short")).withColumn("moved", F.lit(True)), "contexts")
    rest, table, reached = spark.read.schema(fields).parquet(path), core_table, -np.inf

    def swept(rows: DataFrame, shared) -> DataFrame:
        def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, 512):
                flat = part.column(2).flatten()
                starts = np.concatenate(([0], np.cumsum(part.column(2).value_lengths().to_numpy())[:-1]))
                own = part.column(3).to_numpy().astype(np.int64)
                new = choices(flat.field("context").to_numpy().astype(np.int64), flat.field("n").to_numpy().astype(float), starts, own, shared.value)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(new, pa.int16()), pa.array(new != own)], names=["word", "n", "before", "class", "moved"])

        return rows.mapInArrow(mapped, fields)

    while True:
        new_path = store(swept(rest, spark.sparkContext.broadcast(table)), "classes")
        new = spark.read.schema(fields).parquet(new_path)
        pairs = new.select("class", F.explode("before").alias("b")).groupBy("b.context", "class").agg(F.sum("b.n").alias("n")).toArrow()
        after = core_table.copy()
        np.add.at(after, (pairs.column("context").to_numpy().astype(int), pairs.column("class").to_numpy().astype(int)), pairs.column("n").to_numpy())
        if likelihood(after) <= reached:
            discard(spark, new_path)
            break
        discard(spark, path)
        path, rest, table, reached = new_path, new, after, likelihood(after)
        moved, every = new.agg(F.count_if("moved"), F.count("*")).first()
        if moved <= FEW * every:
            break
    own = spark.createDataFrame(pa.table({"word": pa.array(top, pa.int64()), "class": pa.array(of, pa.int16())})) if len(top) else spark.createDataFrame([], "word long, class short")
    classes = stored(rest.select("word", "n", "class").unionByName(F.broadcast(own).join(counts, "word").select("word", "n", "class")), "word-classes")
    discard(spark, path)
    return classes


def frequent(classes: DataFrame, most: int) -> DataFrame:
    """The most frequent words, up to ``most``: those above a count, found from a histogram of the counts' logarithms."""
    step = F.floor(8 * F.log2("n"))
    low, taken = 10**9, 0
    for r in sorted(classes.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect(), reverse=True):
        taken += r["words"]
        if taken > most:
            break
        low = r["step"]
    return classes.where(step >= low)


BIGRAM = "a long, ca int, b long, cb int, times long"


def sides(words: np.ndarray, kind: np.ndarray, *more: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Bigrams of which a side has no class here, each with its sides' words (0 where the class is known), classes and
    ``more``, a value for each bigram; and how often each comes."""
    at = np.flatnonzero((kind[:-1] < 0) | (kind[1:] < 0))
    a, b = np.where(kind[at] < 0, words[at], 0), np.where(kind[at + 1] < 0, words[at + 1], 0)
    if not len(at):
        return [np.zeros(0, np.int64)] * (4 + len(more)), np.zeros(0, np.int64)
    found, times = np.unique(np.stack((a, kind[at], b, kind[at + 1], *(m[at] for m in more))), axis=1, return_counts=True)
    return list(found), times


def sides_arrays(found: list[np.ndarray], times: np.ndarray) -> list[pa.Array]:
    a, ca, b, cb = found[:4]
    return [pa.array(a, mask=ca >= 0), pa.array(ca, pa.int32(), mask=ca < 0), pa.array(b, mask=cb >= 0), pa.array(cb, pa.int32(), mask=cb < 0), pa.array(times)]


def class_bigrams(training: DataFrame, classes: DataFrame, shared) -> np.ndarray:
    """Counts of class and next class over all tokens."""
    kinds = CLASSES + 2

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, table = shared.value[0], np.zeros(kinds * kinds, np.int64)
        for part in slices(batches):
            words = tokens(part.column(0))
            kind = lookup(words).astype(np.int64)
            whole = (kind[:-1] >= 0) & (kind[1:] >= 0)
            table += np.bincount(kind[:-1][whole] * kinds + kind[1:][whole], minlength=kinds * kinds)
            yield pa.RecordBatch.from_arrays(sides_arrays(*sides(words, kind)), names=["a", "ca", "b", "cb", "times"])
        at = np.flatnonzero(table)
        nothing = np.full(len(at), -1)
        yield pa.RecordBatch.from_arrays(sides_arrays([nothing, at // kinds, nothing, at % kinds], table[at]), names=["a", "ca", "b", "cb", "times"])

    parts = stored(training.select("words").mapInArrow(mapped, BIGRAM), "training-bigrams")
    counted = resolved(parts, classes, []).groupBy("ca", "cb").agg(F.sum("times").alias("n")).collect()
    table = np.zeros((kinds, kinds))
    for r in counted:
        table[r["ca"], r["cb"]] = r["n"]
    return table


def resolved(parts: DataFrame, classes: DataFrame, by: list[str]) -> DataFrame:
    """(by, ca, cb, times, n, outside): bigrams with the classes of all sides, by joins on the words that are outside
    the head; n is the count of the second word if it is outside. Words unseen in training have the last class and no
    count."""
    rows = parts.groupBy(*by, "a", "ca", "b", "cb").agg(F.sum("times").alias("times"))
    unseen = F.lit(CLASSES + 1)
    first = classes.select(F.col("word").alias("a"), F.col("class").cast("int").alias("class"))
    rows = rows.where("a is null").unionByName(rows.where("a is not null").join(first, "a", "left").withColumn("ca", F.coalesce("class", unseen)).drop("class"))
    second = classes.select(F.col("word").alias("b"), F.col("class").cast("int").alias("class"), "n")
    out = rows.where("b is null").withColumn("n", F.lit(None).cast("long")).withColumn("outside", F.lit(False)).unionByName(
        rows.where("b is not null").join(second, "b", "left").withColumn("cb", F.coalesce("class", unseen)).drop("class").withColumn("outside", F.lit(True)))
    return out.select(*by, "ca", "cb", "times", "n", "outside")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity for each row.

    The model learns from the documents that aren't held out: counts of all words, classes of all words by exchange
    (``clustered``), and class bigrams of all tokens. log10 P(text) adds log10 P(class | class before), add-one
    smoothed, and log10 P(word | class), relative frequency. The end has a class of its own, and so have the words that
    training lacks, which are one word there. Classes and counts of the HEAD most frequent words are broadcast; bigrams
    with other words get theirs by joins on the word. base_score is the add-one unigram model. Words are known by
    64-bit hashes. Null texts are empty: an end alone. A null doc_id counts as the text "". Very long texts are scored
    whole. Repeated rows each get their score and count as often in training; an empty table gives no rows. Other
    columns are ignored.
    """
    with temporary(docs.sparkSession):
        return scored(docs, id_col, text_col)


def scored(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """As ``score``; of its tables only the scores of the head's words and the sums for other words stay."""
    spark = docs.sparkSession
    rows = stored(encoded(docs, id_col, text_col), "words")
    training = rows.where("not held_out")
    counts = stored(count_words(training), "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ends = counts.where(F.col("word") == END).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    classes = clustered(training, counts)
    head = frequent(classes, HEAD).select("word", "class", "n").toArrow()
    words, of, n = (np.append(head.column(c).to_numpy(), v) for c, v in (("word", END), ("class", CLASSES), ("n", ends)))
    lookup, n = Lookup(words, of.astype(np.int16)), n[np.argsort(words)].astype(float)
    sizes = np.zeros(CLASSES + 2)
    for r in classes.groupBy("class").agg(F.sum("n").alias("n")).collect():
        sizes[r["class"]] = r["n"]
    sizes[CLASSES] = ends
    within = np.log10(np.maximum(sizes, 1))
    emitted, plain = np.log10(np.maximum(n, 1)) - within[lookup.values], np.log10(n + 1)
    table = class_bigrams(training, classes, Shared(spark, (lookup,)))
    transition = np.log10((table + 1) / (table.sum(axis=1, keepdims=True) + len(table)))
    shared = Shared(spark, (lookup, emitted, plain, transition))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, emitted, plain, transition = shared.value
        names = ["uid", "doc_id", "held_out", "n_tokens", "known", "steps", "base", "a", "ca", "b", "cb", "times"]
        for part in slices(batches):
            words = tokens(part.column(3))
            lengths = part.column(3).cast(pa.large_binary()).to_pylist()
            lengths = np.array([len(x) // 8 + 1 for x in lengths])
            doc, d = np.repeat(np.arange(len(lengths)), lengths), len(lengths)
            at = lookup.at(words)
            kind = np.where(at >= 0, lookup.values[at].astype(np.int64), -1)
            known, whole = at[1:] >= 0, (kind[:-1] >= 0) & (kind[1:] >= 0)

            def by_doc(where: np.ndarray, values: np.ndarray | None = None) -> np.ndarray:
                return np.bincount(doc[where], values, d)  # noqa: B023

            steps = by_doc(whole, transition[kind[:-1][whole], kind[1:][whole]]) + by_doc(known, emitted[at[1:][known]])
            none = [pa.nulls(d, pa.int64()), pa.nulls(d, pa.int32())]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(lengths), pa.array(by_doc(known).astype(np.int64)), pa.array(steps), pa.array(by_doc(known, plain[at[1:][known]])), *none, *none, none[0]], names=names)
            found, times = sides(words, kind, doc)
            m = len(times)
            if m:
                empty = [pa.nulls(m, t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(found[4])), *empty, *sides_arrays(found, times)], names=names)

    schema = f"uid long, doc_id long, held_out boolean, n_tokens long, known long, steps double, base double, {BIGRAM}"
    scores = stored(rows.mapInArrow(local, schema), "scores", keep=True)
    step = spark.createDataFrame([(i, j, float(x)) for i, row in enumerate(transition) for j, x in enumerate(row)], "ca int, cb int, step double")
    emission = spark.createDataFrame(list(enumerate(within.tolist())), "cb int, within double")
    more = resolved(scores.where("times is not null"), classes, ["uid"]).join(F.broadcast(step), ["ca", "cb"]).join(F.broadcast(emission), "cb")
    times, seen = F.col("times"), F.col("outside") & F.col("n").isNotNull()
    more = more.groupBy("uid").agg(
        F.sum(times * F.col("step")).alias("more_steps"), F.coalesce(F.sum(F.when(seen, times)), F.lit(0)).alias("more_known"),
        F.coalesce(F.sum(F.when(seen, times * (F.log10("n") - F.col("within")))), F.lit(0.0)).alias("more_emitted"), F.coalesce(F.sum(F.when(seen, times * F.log10(F.col("n") + 1.0))), F.lit(0.0)).alias("more_base"))

    def more_of(name: str) -> Column:
        return F.coalesce(name, F.lit(0))

    more = stored(more, "other-words", keep=True)
    out = scores.where("times is null").join(more, "uid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") - (0 if ends else 1) + more_of("more_known")).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + more_of("more_base") - F.col("n_tokens") * float(np.log10(total + distinct + 1))).alias("base_score"),
        (F.col("steps") + more_of("more_steps") + more_of("more_emitted")).alias("score"))
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
