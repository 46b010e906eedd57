"""Divergence of sources: inclusion-exclusion over the supports of their term counts, in integers throughout.

Within a language, group A's price of group B is the sum over all kept terms of f = floor((p - q)^2 / q). A group's p
depends on the term's count alone, so a term that B lacks costs the same wherever A has it as often: histograms of counts
price one-sided terms, a constant prices terms that both lack, and only terms that both have are joined, to correct the sums.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, stored, temporary

#: Bytes of UTF-8 by what they are to terms: A-Z as a-z, other ASCII as spaces, those of other characters as they are.
LETTERS = bytes(c | 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Entries of a task's table of counts, after which it is passed on; and bytes of a text looked at in one go.
HELD, PIECE = 500_000, 1 << 22
COUNTS = "lang string, source string, term string, n long, docs long"
RESULT = ("lang", "source", "part", "item", "value")
SCALE = 1_000_000_000


def terms(text: str) -> Iterator[list[bytes]]:
    """A text's terms, lower-cased; those of long texts piece by piece, cut between terms."""
    code = text.encode().translate(LETTERS)
    at = 0
    while at < len(code):
        end = code.find(b" ", at + PIECE) if at + PIECE < len(code) else -1
        end = len(code) if end < 0 else end
        yield code[at:end].split()
        at = end


def term_counts(docs: DataFrame, lang_col: str, source_col: str, text_col: str) -> DataFrame:
    """(lang, source, term, n, docs), several rows of one key possible, added up within each task; and a row with a null
    term for each group that a task saw, so that groups without terms aren't lost."""
    names = [f.split()[0] for f in COUNTS.split(", ")]
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple, tuple[Counter, Counter]] = {}
        held = 0

        def flushed() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, d) in groups.items():
                keys = list(n)
                for lo in range(0, len(keys), 100_000):
                    some = keys[lo : lo + 100_000]
                    counts = [pa.array(map(c.__getitem__, some), pa.int64(), size=len(some)) for c in (n, d)]
                    yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(some)), pa.repeat(source, len(some)), pa.array(some, pa.binary()).cast(pa.string()), *counts], names=names)
            seen = list(groups)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([[g[0] for g in seen], [g[1] for g in seen], [None] * len(seen), [0] * len(seen), [0] * len(seen)], kinds)], names=names)
            groups.clear()

        for part in slices(batches):
            for lang, source, text in zip(*(c.to_pylist() for c in part.columns)):
                n, d = groups.setdefault((lang, source), (Counter(), Counter()))
                held -= len(n)
                seen: set[bytes] = set()
                for found in terms(text):
                    n.update(found)
                    seen.update(found)
                d.update(seen)
                held += len(n)
                if held > HELD:
                    yield from flushed()
                    held = 0
        yield from flushed()

    empty = F.lit("")
    t = docs.select(F.coalesce(docs[lang_col], empty).alias("lang"), F.coalesce(docs[source_col], empty).alias("source"), F.coalesce(docs[text_col], empty).alias("text"))
    return t.mapInArrow(counted, COUNTS)


def share(count: str, total: str, kept: str) -> Column:
    """p = 1 + floor(10^9 (count + 1) / (total + kept)), exact for counts up to 10^19."""
    return F.expr(f"1 + (CAST({SCALE} AS DECIMAL(10,0)) * CAST({count} + 1 AS DECIMAL(20,0))) DIV CAST({total} + {kept} AS DECIMAL(20,0))")


def price(p: str, q: str) -> Column:
    """floor((p - q)^2 / q), as a number that can be added up safely; p and q are at most 10^9 + 1."""
    return F.expr(f"CAST((({p} - {q}) * ({p} - {q})) DIV {q} AS DECIMAL(20,0))")


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = 3, top: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank): what sets each (language, source) group apart.

    Part ``pair``: all other sources of the language by price, dearest first. Part ``term``: kept terms that are more
    frequent in the group than in its language, by price, the first ``top``. A language keeps terms that ``least_docs`` of
    its documents (rows) have. Ties go by item in UTF-8 order.

    Null languages, sources and texts are empty strings; groups without terms take part. A language without kept terms
    gives pairs of value 0 and no terms. Repeated rows count each. Other columns are ignored; an empty table gives no rows.

    Tasks add up their own counts before the shuffle. Pairs of groups are the result itself; beside them only postings of
    a term that two groups share meet. Both sides of joins on hot languages or sources are stored tables keyed more finely.
    """
    with temporary(docs.sparkSession):
        # tasks have added up their own rows, so these go straight to their terms, whose groups are few
        counts = term_counts(docs, lang_col, source_col, text_col).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        of_term = Window.partitionBy("lang", "term")
        counts = counts.select("lang", "term", "source", "n", F.sum("n").over(of_term).alias("whole"), F.sum("docs").over(of_term).alias("docs"), (F.min("source").over(of_term) == F.col("source")).alias("lead"))
        counts = stored(counts.where(F.col("term").isNull() | (F.col("docs") >= least_docs)), "term-counts")
        postings = counts.where("term is not null")
        langs = postings.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count_if("lead").alias("kept"))
        groups = (counts.where("term is null").select("lang", "source").join(postings.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("support")), ["lang", "source"], "left")
                  .join(langs, "lang", "left").na.fill(0, ["total", "support", "lang_total", "kept"]))
        groups = groups.withColumn("zero", F.when(F.col("kept") > 0, share("0L", "total", "kept")))
        groups = stored(groups, "groups")
        own = groups.select("lang", "source", "total", "kept", "lang_total", "zero")
        priced = stored(postings.join(own, ["lang", "source"]).select("lang", "source", "term", "n", "zero", share("n", "total", "kept").alias("p"), share("whole", "lang_total", "kept").alias("q")), "priced-postings")
        frequent = priced.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), price("p", "q").alias("value"))
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        frequent = stored(frequent.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top), "frequent", keep=True)

        a = groups.select("lang", F.col("source").alias("a"), F.col("zero").alias("za"), F.col("support").alias("sa"), "kept")
        b = groups.select("lang", F.col("source").alias("b"), F.col("zero").alias("zb"), F.col("support").alias("sb"))
        pairs = stored(a.join(b, "lang").where("a <> b"), "pairs")
        # as if no term were in both supports
        both_zero = pairs.where("kept > 0").select("lang", "a", "b", (F.expr("CAST(kept - sa - sb AS DECIMAL(20,0))") * price("za", "zb")).cast("decimal(38,0)").alias("value"))
        held = stored(priced.groupBy("lang", "source", "p").agg(F.count("*").alias("terms")), "histograms")
        times = F.col("terms").cast("decimal(18,0)")
        only_a = held.withColumnRenamed("source", "a").join(pairs.select("lang", "a", "b", "zb"), ["lang", "a"]).select("lang", "a", "b", (times * price("p", "zb")).cast("decimal(38,0)").alias("value"))
        only_b = held.withColumnRenamed("source", "b").join(pairs.select("lang", "a", "b", "za"), ["lang", "b"]).select("lang", "a", "b", (times * price("za", "p")).cast("decimal(38,0)").alias("value"))
        # and the correction for those that are
        x = priced.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("zero").alias("za"))
        y = priced.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"), F.col("zero").alias("zb"))
        shared = x.join(y, ["lang", "term"]).where("a < b")

        def corrected(u: str, v: str) -> Column:
            return F.sum(price(f"p{u}", f"p{v}") - price(f"p{u}", f"z{v}") - price(f"z{u}", f"p{v}") + price(f"z{u}", f"z{v}")).cast("decimal(38,0)")

        shared = stored(shared.groupBy("lang", "a", "b").agg(corrected("a", "b").alias("there"), corrected("b", "a").alias("back")), "overlaps")
        parts = [both_zero, only_a, only_b, shared.select("lang", "a", "b", F.col("there").alias("value")),
                 shared.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), F.col("back").alias("value")),
                 pairs.select("lang", "a", "b", F.lit(0).cast("decimal(38,0)").alias("value"))]
        summed = parts[0]
        for more in parts[1:]:
            summed = summed.unionByName(more)
        summed = summed.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
        compared = stored(summed.select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), F.col("value").cast("long").alias("value")), "pair-prices", keep=True)
    compared = compared.withColumn("rank", F.row_number().over(order))
    return compared.unionByName(frequent.withColumn("value", F.col("value").cast("long")).select(compared.columns))
