"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, in DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, temporary

SEED = 20240229
#: Words of a block and of an output shard, about; blocks of a group whose sums are taken together.
BLOCK_WORDS, SHARD_WORDS, GROUP = 1 << 14, 1 << 20, 1024
#: Passes over a source's blocks, and for each a prime that permutes them: position = block x prime + shift mod blocks.
PASSES, PRIMES = (0, 1), (2147483647, 2147483629)
#: Levels of the tree after which its nodes are stored.
STORED_LEVELS = 8


def let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def uniform(*key: Column) -> Column:
    """In [0, 1), fixed by the key."""
    return F.pmod(F.xxhash64(F.lit(SEED), *key), F.lit(1 << 53)) / F.lit(float(1 << 53))


def hypergeometric(population: Column, marked: Column, draws: Column, u: Column) -> Column:
    """Marked items among ``draws`` drawn without putting back, by inversion of ``u`` within 12 deviations of the mode."""
    p = marked / F.greatest(population, F.lit(1))
    mode = F.floor((draws + 1) * (marked + 1) / (population + 2))
    reach = F.ceil(12 * F.sqrt(draws * p * (1 - p)) + 12).cast("long")
    lo = F.greatest(F.lit(0).cast("long"), draws + marked - population, mode - reach)
    hi = F.least(draws, marked, mode + reach)

    def step(a: Column, k: Column) -> Column:  # from the weight of k to that of k + 1, in logarithms
        up = F.log((marked - k).cast("double")) + F.log((draws - k).cast("double"))
        down = F.log((k + 1).cast("double")) + F.log((population - marked - draws + k + 1).cast("double"))
        return F.coalesce(a + up - down, F.lit(float("-inf")))

    def walk(total: Column | None) -> Column:
        start = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("sum"), F.lit(None).cast("long").alias("pick"))

        def merge(a: Column, k: Column) -> Column:
            grown = a["sum"] + F.exp(a["w"])
            pick = F.coalesce(a["pick"], F.when(grown >= u * total, k)) if total is not None else a["pick"]
            return F.struct(F.when(k < hi, step(a["w"], k)).otherwise(F.lit(float("-inf"))).alias("w"), grown.alias("sum"), pick.alias("pick"))

        return F.aggregate(F.sequence(lo, hi), start, merge)

    return let(walk(None)["sum"], lambda total: F.coalesce(walk(total)["pick"], hi))


def split_quotas(quotas: DataFrame, depth: int) -> DataFrame:
    """From one row (quotas array) to 2^depth rows (shard, starts, quotas): each node's block quotas are split in two
    halves of equal total by a multivariate-hypergeometric draw, source after source, so that leaves add up exactly.
    ``starts`` are the sums of the quotas of the leaves before, so a leaf's draws are start to start + quota - 1."""
    nodes = quotas.select(F.lit(0).cast("long").alias("shard"), F.transform("quotas", lambda q: q * 0).alias("starts"), "quotas")
    for level in range(depth):
        total = F.aggregate("quotas", F.lit(0).cast("long"), lambda a, q: a + q)
        start = F.struct(total.alias("population"), F.floor(total / 2).alias("draws"), F.array().cast("array<bigint>").alias("left"))

        at = F.lit(level)

        def draw(a: Column, q: Column) -> Column:
            got = hypergeometric(a["population"], q, a["draws"], uniform(at, F.col("shard"), F.size(a["left"])))  # noqa: B023
            return let(got, lambda x: F.struct((a["population"] - q).alias("population"), (a["draws"] - x).alias("draws"), F.concat(a["left"], F.array(x)).alias("left")))

        nodes = nodes.withColumn("left", F.aggregate("quotas", start, draw)["left"])
        nodes = nodes.select(F.explode(F.array(
            F.struct((2 * F.col("shard")).alias("shard"), F.col("starts"), F.col("left").alias("quotas")),
            F.struct((2 * F.col("shard") + 1).alias("shard"), F.zip_with("starts", "left", lambda s, x: s + x).alias("starts"), F.zip_with("quotas", "left", lambda q, x: q - x).alias("quotas")))).alias("n")).select("n.*")
        if level % STORED_LEVELS == STORED_LEVELS - 1:
            nodes = stored(nodes, "nodes")
    return nodes


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """(number, source, source_size, target): shares of ``share`` x all sizes by weight, none above ``most`` x its size.

    Weights repeat over the sources by code point, null last. The sources that stop are those with the least
    ``most`` x size a weight: with c of them stopped, the others share what is left. One row a source is ordered here.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = sizes.withColumn("number", F.row_number().over(order) - 1)
    w = w.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("number") % len(weights) + 1).cast("int")))
    w = w.withColumn("cap", most * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("ratio", "number").rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumn("all", share * F.sum("source_size").over(every)).withColumn("rate", (F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    # the first source that doesn't stop has the rate that holds for all that follow it
    rate = F.min(F.when(F.col("rate") <= F.col("ratio"), F.struct("ratio", "number", "rate"))).over(every)["rate"]
    target = F.when(rate.isNull(), F.col("cap")).otherwise(F.least("cap", rate * F.col("weight")))
    return w.select("number", "source", "source_size", target.alias("target"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def placed(rows: DataFrame, totals: DataFrame) -> DataFrame:
    """``rows`` (with doc_id, source, size) and their source's totals, block and place in the block for each pass."""
    t = totals.withColumnRenamed("source", "known")
    out = rows.join(t, rows["source"].eqNullSafe(t["known"])).drop("known")
    out = out.withColumn("block", F.pmod(F.xxhash64(F.lit(SEED), F.lit(7), "doc_id", "size"), F.col("blocks")))
    return out.withColumns({f"place{p}": F.xxhash64(F.lit(SEED), F.lit(p), "doc_id", "size") for p in PASSES})


def permuted_blocks(docs: DataFrame) -> DataFrame:
    """(number, block, pass, draw, words, before) of blocks that have rows: their place in the order of draws, pass
    after pass, and the words of all draws before. Sums are taken within groups of blocks and over groups."""
    blocks = docs.groupBy("number", "block", "blocks", "source_size", "target").agg(F.sum("size").alias("words"))
    shift = F.pmod(F.xxhash64(F.lit(SEED), F.lit(11), "pass", "number"), F.col("blocks"))
    prime = F.element_at(F.array(*[F.lit(p).cast("long") for p in PRIMES]), F.col("pass") + 1)
    rows = blocks.withColumn("pass", F.explode(F.array(*map(F.lit, PASSES)))).withColumn("draw", F.pmod(F.col("block") * prime + shift, F.col("blocks")) + F.col("pass") * F.col("blocks"))
    rows = stored(rows.withColumn("group", F.floor(F.col("draw") / GROUP)), "blocks")
    earlier = Window.partitionBy("number").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = rows.groupBy("number", "group").agg(F.sum("words").alias("sum")).select("number", "group", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("ahead"))
    own = Window.partitionBy("number", "group").orderBy("draw").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("ahead") + F.coalesce(F.sum("words").over(own), F.lit(0))
    return rows.join(groups, ["number", "group"]).withColumn("before", before).drop("group", "ahead")


def draw_blocks(sized: DataFrame, weights: tuple[int, ...], share: float, most: float, shard_words: int, block_words: int) -> tuple[DataFrame, DataFrame]:
    """Totals a source, and one row a block: for each pass the words to take, the output shard, and within a block
    that is taken in part, the place where it ends. Both are stored, and the tables they are made from deleted."""
    with temporary(sized.sparkSession):
        totals, plan = drawn_blocks(sized, weights, share, most, shard_words, block_words)
        return stored(totals, "targets", keep=True), stored(plan, "plan", keep=True)


def drawn_blocks(sized: DataFrame, weights: tuple[int, ...], share: float, most: float, shard_words: int, block_words: int) -> tuple[DataFrame, DataFrame]:
    """As ``draw_blocks``, from tables still there.

    A source's quota is the number of block draws that fill its target. The tree splits the quotas among the output
    shards, and each shard draws as many of the permuted blocks as its leaf says, those that follow the leaves before.
    """
    totals = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    totals = stored(totals.withColumn("blocks", F.greatest(F.ceil(F.col("source_size") / block_words), F.lit(1)).cast("long")), "targets")
    docs = placed(sized, totals)
    wanted = F.round("target").cast("long")
    draws = stored(permuted_blocks(docs).where(F.col("before") < wanted).select("number", "block", "pass", "draw", "words", F.least(F.col("words"), wanted - F.col("before")).alias("take")), "draws")
    counts = totals.select("number").join(draws.groupBy("number").agg((F.max("draw") + 1).alias("quota"), F.sum("take").alias("take")), "number", "left")
    counts = stored(counts.select("number", F.coalesce("quota", F.lit(0)).alias("quota"), F.coalesce("take", F.lit(0)).alias("take")), "quotas")
    listed = counts.agg(F.array_sort(F.collect_list(F.struct("number", "quota"))).alias("s")).select(F.transform("s", lambda s: s["quota"]).alias("quotas"))
    words, most_draws = counts.agg(F.coalesce(F.sum("take"), F.lit(0)), F.coalesce(F.sum("quota"), F.lit(0))).first()
    depth = max(0, min(math.ceil(words / shard_words), most_draws) - 1).bit_length()
    leaf = F.explode(F.arrays_zip(F.transform("quotas", lambda q, i: i).alias("number"), F.col("starts").alias("start"), F.col("quotas").alias("quota"))).alias("leaf")
    leaves = split_quotas(listed, depth).select("shard", leaf).select("shard", "leaf.*").where("quota > 0")
    given = leaves.select("number", "shard", F.explode(F.sequence("start", F.col("start") + F.col("quota") - 1)).alias("draw"))
    draws = stored(draws.join(given, ["number", "draw"]).where("take > 0"), "drawn")
    # a block taken in part: rows up to a place
    part = draws.where("take < words").select(F.col("number").alias("s"), F.col("block").alias("b"), "pass", "take")
    rows = docs.join(part, (docs["number"] == part["s"]) & (docs["block"] == part["b"])).withColumn("place", F.when(F.col("pass") == 0, F.col("place0")).otherwise(F.col("place1")))
    same = rows.groupBy("s", "b", "pass", "take", "place").agg(F.sum("size").alias("size"))
    running = Window.partitionBy("s", "b", "pass").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    same = same.withColumn("left", F.col("take") - F.coalesce(F.sum("size").over(running), F.lit(0))).where("left > 0 and left <= size")
    same = same.select(F.col("s").alias("number"), F.col("b").alias("block"), "pass", F.col("place").alias("last"), "left", F.col("size").alias("last_size"))
    draws = draws.join(same, ["number", "block", "pass"], "left")
    plan = draws.groupBy("number", "block").agg(*[F.max(F.when(F.col("pass") == p, F.struct("take", "words", "shard", "last", "left", "last_size"))).alias(f"pass{p}") for p in PASSES])
    return totals, plan


def with_draws(rows: DataFrame, totals: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` with source_size, target and draws: (shard, place, taken) for each pass that takes words of the row.
    Rows whose ids and sizes are equal share a place and what is taken there."""
    docs = placed(rows, totals).join(plan, ["number", "block"], "left")

    def one(k: int) -> Column:
        d, place = F.col(f"pass{k}"), F.col(f"place{k}")
        taken = (F.when(d.isNull(), 0).when(d["take"] == d["words"], F.col("size")).when(place < d["last"], F.col("size"))
                 .when(place == d["last"], F.expr(f"(size * pass{k}.left) div greatest(pass{k}.last_size, 1)")).otherwise(0)).cast("long")
        return F.struct(d["shard"].alias("shard"), place.alias("place"), taken.alias("taken"))

    draws = F.filter(F.array(*[one(k) for k in PASSES]), lambda d: d["taken"] > 0)
    return docs.withColumn("draws", draws).drop("number", "block", "blocks", *[f"{x}{k}" for k in PASSES for x in ("pass", "place")])


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, source, size, source_size, target, draws, taken for each row: what the mix takes of it.

    A source's documents fall into blocks of about ``block_words`` words by a hash of their ids. Its target is an exact
    number of block draws, the last in part; the splitting tree deals these quotas out among output shards of about
    ``shard_words`` words, and each shard draws its own blocks of the source's permutation. Blocks are permuted anew in
    each pass, so that a block is drawn again only after all others. ``most`` is at most 2. What is drawn is fixed by
    ids and sizes: reruns agree. Null texts have size 0; a null source is a source; a source whose texts have no words
    takes none; an empty table gives no rows; very long texts are taken whole unless a target ends in them. Other
    columns are ignored. The table of sources, one row each, is ranked in one task and is one row of the tree.
    """
    sized = stored(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[source_col].alias("source"), word_count(docs[text_col]).alias("size")), "sizes")
    out = with_draws(sized, *draw_blocks(sized, weights, share, most, shard_words, block_words))
    return out.withColumn("taken", F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["taken"]))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mix itself: the input's columns, once for each draw, shuffled within their output shards.

    A text of which a part is taken is cut to its first words. Rows are dealt to partitions by their shard, which has a
    bounded number of words, and ordered by place there, which is random to the content. Nulls, repeated rows and
    empty tables are as in ``mix_plan``; columns keep their names, whatever these are.
    """
    names = docs.columns
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[source_col].alias("source"), word_count(docs[text_col]).alias("size"), F.struct(*[docs[c] for c in names]).alias("row"))
    plan = draw_blocks(stored(rows.select("doc_id", "source", "size"), "sizes"), weights, share, most, shard_words, block_words)
    out = with_draws(rows, *plan).select("row", "size", F.explode("draws").alias("d"))
    words = F.array_remove(F.split(out["row"][text_col], r"[\x20\x09-\x0D]+"), "")
    cut = F.array_join(F.slice(words, F.lit(1), out["d"]["taken"].cast("int")), " ")
    text = F.when(out["d"]["taken"] == out["size"], out["row"][text_col]).otherwise(cut)
    out = out.select(*[text.alias(c) if c == text_col else out["row"][c].alias(c) for c in names], out["d"]["shard"].alias("_shard"), out["d"]["place"].alias("_place"))
    return out.repartition("_shard").sortWithinPartitions("_shard", "_place").drop("_shard", "_place")
