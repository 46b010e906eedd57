"""Quality rules: text statistics and robust outliers per language and source, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, temporary

BLANKS = r"[\x20\x09-\x0D]+"
#: Up to so many repeated windows, positions are found by looking each up; beyond, by sorting. Both are exact.
LOOKED_UP = 32
#: Standard deviations that a feature has at least, so that one that hardly varies rejects nothing on its own:
#: of log words, mean word length, log symbols per thousand characters, root shares of repeated lines and words.
FLOORS = (0.5, 0.3, 0.5, 0.15, 0.15)
#: Chi-square quantiles with 5 degrees of freedom: the median, and the point passed with probability 1e-6.
MEDIAN_5, CUTOFF_5 = 4.3515, 35.89
#: Share of a group that the estimates rest on, and rows that a group needs for its own estimates.
SHARE, LEAST = 0.75, 25
#: Starts from small parts of a group by hash, rows of a group (about) on which starts take STEPS first, starts that go on
#: over all rows, and the fall of the determinant's logarithm under which their steps end.
SUBSETS, NESTED, STEPS, GO_ON, SETTLED = 28, 1500, 4, 3, 1e-4


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def text_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The input's columns without the text, and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines.

    Whole texts are counted; a null text counts as an empty one. Words are runs of characters other than the six
    blanks. Three-word windows are compared by their 64-bit hashes within one text.
    """
    rest = [c for c in docs.columns if c != text_col]
    text = F.coalesce(docs[text_col], F.lit(""))
    step = docs.select(*rest, text.alias("_text"), F.array_remove(F.split(text, BLANKS), "").alias("_words"))
    words, n = F.col("_words"), F.size("_words")
    step = step.select(
        *rest, n.cast("long").alias("n_words"), F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.filter(F.split("_text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
        F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))))
        .otherwise(F.array().cast("array<bigint>")).alias("_windows"))
    windows = F.col("_windows")
    twice = F.when(F.size(F.array_distinct(windows)) < F.size(windows), let(
        F.sort_array(windows), lambda s: F.array_distinct(F.filter(s, lambda x, i: (i > 0) & (F.get(s, i - 1) == x))))).otherwise(F.array().cast("array<bigint>"))
    step = step.select(*rest, "n_words", "word_chars", "n_symbols", F.size("_lines").cast("long").alias("n_lines"),
                       (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), "_windows", twice.alias("_twice"))
    twice = F.col("_twice")
    looked_up = F.filter(F.sequence(F.lit(0), F.size(windows) - 1), lambda i: F.array_contains(twice, F.get(windows, i)))
    by_sorting = let(F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("h"), i.alias("p")))), lambda s: F.sort_array(F.transform(
        F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])), lambda x: x["p"])))
    places = F.when(F.size(twice) == 0, F.array().cast("array<int>")).when(F.size(twice) <= LOOKED_UP, looked_up).otherwise(by_sorting)
    covered = F.aggregate(places, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
                          lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])
    return step.select(*rest, "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.cast("long").alias("n_repeat_words"), "n_lines")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def features() -> list[Column]:
    """The statistic vector, transformed so that clean texts spread about evenly around their centre."""
    n, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return [F.log1p(F.col("n_words")), F.col("word_chars") / n, F.log1p(1000 * F.col("n_symbols") / chars),
            F.sqrt(F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))), F.sqrt(F.col("n_repeat_words") / n)]


def squared_distance(x: list[str]) -> Column:
    """|M (x - c)|^2 for the centre c and the inverse M of the covariance's lower Cholesky factor, columns of the row."""
    rows = [" + ".join(f"m{i}{j} * ({x[j]} - c{j})" for j in range(i + 1)) for i in range(len(x))]
    return F.expr(" + ".join(f"power({r}, 2)" for r in rows))


X = [f"x{i}" for i in range(len(FLOORS))]


def with_features(stats: DataFrame) -> DataFrame:
    """Feature columns; null where the base rules fail."""
    return stats.withColumns({c: F.when(~base_failed(), f) for c, f in zip(X, features())})


def cholesky(params: DataFrame, rest: list[str]) -> DataFrame:
    """``rest``, the centre c, the inverse m of the lower Cholesky factor l of the covariance v, and the determinant's
    logarithm."""
    d = range(len(X))

    def less(value: str, parts: list[str]) -> str:
        return "(" + " - ".join([value, *parts]) + ")"

    for j in d:  # a column at a time
        params = params.selectExpr("*", f"sqrt(greatest({less(f'v{j}{j}', [f'l{j}{k} * l{j}{k}' for k in range(j)])}, 1e-9D)) AS l{j}{j}")
        params = params.selectExpr("*", *[f"{less(f'v{i}{j}', [f'l{i}{k} * l{j}{k}' for k in range(j)])} / l{j}{j} AS l{i}{j}" for i in d[j + 1 :]])
    for i in d:  # a row at a time
        params = params.selectExpr("*", *[f"{less('1D' if i == j else '0D', [f'l{i}{k} * m{k}{j}' for k in range(j, i)])} / l{i}{i} AS m{i}{j}" for j in range(i + 1)])
    logdet = " + ".join(f"2 * ln(l{i}{i})" for i in d)
    return params.selectExpr(*rest, *[f"c{i}" for i in d], *[f"m{i}{j}" for i in d for j in range(i + 1)], f"{logdet} AS logdet")


def moments(grouped, values: list[str]) -> DataFrame:
    """Means a and second moments q of the values, and the floors of the features."""
    d = range(len(values))
    return grouped.agg(*[F.expr(e) for e in (*[f"first(f{i}) AS f{i}" for i in d], *[f"avg({v}) AS a{i}" for i, v in enumerate(values)],
                                             *[f"avg({values[i]} * {values[j]}) AS q{i}{j}" for i in d for j in range(i + 1)])])


def floored(i: int, j: int, value: str) -> str:
    return f"greatest({value}, f{i} * f{i})" if i == j else value


def concentrated(rows: DataFrame, params: DataFrame, key: list[str]) -> DataFrame:
    """One concentration step: mean and covariance of the SHARE of each group's rows nearest by the params."""
    d = range(len(X))
    near = rows.join(params, "pool").withColumn("distance", squared_distance([f"z{i}" for i in d]))
    near = near.select(*key, *[f"{x}{i}" for x in "zf" for i in d], "distance")
    limit = near.groupBy(*key).agg(quantile(F.col("distance"), SHARE).alias("limit"))
    sums = moments(near.join(limit, key).where("distance <= limit").groupBy(*key), [f"z{i}" for i in d])
    return cholesky(sums.selectExpr(*key, *[f"a{i} AS c{i}" for i in d], *[floored(i, j, f"q{i}{j} - a{i} * a{j}") + f" AS v{i}{j}" for i in d for j in range(i + 1)]), key)


def plain_start(pools: DataFrame) -> DataFrame:
    """Medians and median deviations, which any pool has."""
    d = range(len(X))
    return cholesky(pools.select("pool", F.lit(0).alias("start"), *[F.expr(f"0D AS c{i}") for i in d], *[F.expr(f"{int(i == j)}D AS v{i}{j}") for i in d for j in range(i + 1)]), ["pool", "start"])


def first_estimates(rows: DataFrame) -> DataFrame:
    """Starts of a pool, in units of median deviations: none of the features correlated, correlations of their
    hyperbolic tangents, the spatial sign covariance, mean and covariance of the half nearest to the medians, and those
    of SUBSETS parts of about seven rows, chosen by hash."""
    d, keys = range(len(X)), ["pool", "start"]
    z = [F.col(f"z{i}") for i in d]
    norm = rows.withColumn("norm", sum((c * c for c in z[1:]), z[0] * z[0]))
    half = norm.groupBy("pool").agg(quantile(F.col("norm"), 0.5).alias("half"), F.count("*").alias("n"))
    norm = norm.join(half, "pool")
    length = F.greatest(F.sqrt("norm"), F.lit(1e-9))
    start = F.col("start")
    part = (start > 3) & (F.pmod(F.xxhash64("start", *z), F.ceil(F.col("n") / 7)) == 0)
    drawn = [F.when(start == 1, F.tanh(c)).when(start == 2, c / length).when((start == 3) & (F.col("norm") <= F.col("half")) | part, c).alias(f"y{i}") for i, c in enumerate(z)]
    one = norm.withColumn("start", F.explode(F.sequence(F.lit(1), F.lit(3 + SUBSETS)))).select(*keys, *[f"f{i}" for i in d], *drawn)
    m = moments(one.where("y0 is not null").groupBy(*keys), [f"y{i}" for i in d])
    spread = [f"sqrt(greatest(q{i}{i} - a{i} * a{i}, 1e-9D))" for i in d]

    def value(i: int, j: int) -> str:
        by_tanh = "1D" if i == j else f"0.98D * (q{i}{j} - a{i} * a{j}) / ({spread[i]} * {spread[j]})"
        other = floored(i, j, f"CASE WHEN start = 2 THEN {len(X)} * q{i}{j} ELSE q{i}{j} - a{i} * a{j} END")
        return f"CASE WHEN start = 1 THEN {by_tanh} ELSE {other} END AS v{i}{j}"

    made = m.selectExpr(*keys, *[f"CASE WHEN start >= 3 THEN a{i} ELSE 0D END AS c{i}" for i in d], *[value(i, j) for i in d for j in range(i + 1)])
    return plain_start(half).unionByName(cholesky(made, keys))


def quantile(c: Column, p: float) -> Column:
    return F.percentile_approx(c, p, 10_000)


def estimates(stats: DataFrame, by: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """``least_determinants``, of whose tables only the last one stays."""
    with temporary(stats.sparkSession):
        return stored(least_determinants(stats, by), "scaled", keep=True)


def least_determinants(stats: DataFrame, by: tuple[str, str]) -> DataFrame:
    """One row a group: medians and median deviations, in whose units the centre, the inverse Cholesky factor of the
    covariance and the determinant's logarithm are, and the scale of squared distances.

    Minimum covariance determinant per group. From each of several starts, concentration steps take mean and covariance
    of the SHARE of rows nearest so far. First they run on about NESTED rows a group; the GO_ON starts with the least
    determinants, and the medians, then go on over all rows until no determinant falls any more, and the least one holds. Variances are
    FLOORS squared at least. All are mergeable aggregates (sums, approximate quantiles), joined back as a row a group;
    no group is brought together. Distances are scaled so that the median is that of a chi-square with 5 degrees of
    freedom at most. Rows that fail the base rules take no part. A null language or source is a group. A group with
    fewer than LEAST rows has the estimates of all rows of its language, and where these are fewer too, of all rows.
    Only such wider pools as are needed are made.
    """
    a, b = by
    d = range(len(X))
    used = with_features(stats).where(~base_failed()).select(F.col(a).alias("ra"), F.col(b).alias("rb"), *X)
    sizes = stored(used.groupBy(F.col("ra").alias("ga"), F.col("rb").alias("gb")).agg(F.count("*").alias("n")), "sizes")
    languages = sizes.groupBy(F.col("ga").alias("la")).agg(F.sum("n").alias("of_language"))
    level = F.when(F.col("n") >= LEAST, 0).when(F.col("of_language") >= LEAST, 1).otherwise(2)

    def pool(k: Column | int) -> Column:  # its name: the level, and the language and source as far as they count there
        k = k if isinstance(k, Column) else F.lit(k)
        return F.to_json(F.struct(k.alias("k"), F.when(k < 2, F.col("ga")).alias("a"), F.when(k < 1, F.col("gb")).alias("b")))

    levels = sizes.join(languages, sizes["ga"].eqNullSafe(languages["la"])).withColumn("level", level)
    levels = stored(levels.select("ga", "gb", pool(F.col("level")).alias("pool")), "levels")
    # a row takes part in its group's pool, its language's and that of all rows, as far as some group is judged by them
    pools = levels.select("ga", "gb", F.explode(F.array(*[pool(k) for k in range(3)])).alias("pool"))
    pools = stored(pools.join(levels.select("pool").distinct(), "pool", "left_semi"), "pools")
    used = used.join(pools, used["ra"].eqNullSafe(pools["ga"]) & used["rb"].eqNullSafe(pools["gb"])).select("pool", *X)
    medians = stored(used.groupBy("pool").agg(F.count("*").alias("n"), *[quantile(F.col(c), 0.5).alias(f"m{i}") for i, c in enumerate(X)]), "medians")
    apart = used.join(medians, "pool").groupBy("pool").agg(F.first("n").alias("n"), *[F.first(f"m{i}").alias(f"m{i}") for i in d], *[quantile(F.abs(F.col(c) - F.col(f"m{i}")), 0.5).alias(f"s{i}") for i, c in enumerate(X)])
    units = stored(apart.select("pool", "n", *[f"m{i}" for i in d], *[F.greatest(1.4826 * F.col(f"s{i}"), F.lit(FLOORS[i])).alias(f"d{i}") for i in d]), "units")
    rows = used.join(units, "pool").select("pool", "n", *[((F.col(c) - F.col(f"m{i}")) / F.col(f"d{i}")).alias(f"z{i}") for i, c in enumerate(X)], *[(FLOORS[i] / F.col(f"d{i}")).alias(f"f{i}") for i in d])
    rows = stored(rows, "units-rows")
    part = stored(rows.where(F.pmod(F.xxhash64(F.lit("nested"), *[f"z{i}" for i in d]), F.ceil(F.col("n") / NESTED)) == 0).drop("n"), "nested")
    rows, key = rows.drop("n"), ["pool", "start"]
    params = stored(first_estimates(part), "starts")
    for _ in range(STEPS):
        params = stored(concentrated(part, params, key), "steps")
    order = F.row_number().over(Window.partitionBy("pool").orderBy("logdet", "start"))
    params = params.withColumn("order", order).where(F.col("order") <= GO_ON).drop("order").unionByName(plain_start(units).withColumn("start", F.lit(-1)))
    params = stored(params.withColumn("logdet", F.lit(float("inf"))), "best")
    names, falls = [c for c in params.columns if c not in key], True
    while falls:
        both = params.join(concentrated(rows, params, key).select(*key, F.struct(*names).alias("after")), key)
        better = F.col("after.logdet") < F.col("logdet")
        params = stored(both.select(*key, *[F.when(better, F.col(f"after.{c}")).otherwise(F.col(c)).alias(c) for c in names], (F.col("logdet") - F.col("after.logdet") > SETTLED).alias("falls")), "best")
        falls = not params.where("falls").isEmpty()
        params = params.drop("falls")
    params = params.groupBy("pool").agg(F.min_by(F.struct(*names), F.struct("logdet", "start")).alias("best")).select("pool", "best.*")
    near = rows.join(params, "pool").withColumn("distance", squared_distance([f"z{i}" for i in d]))
    scale = near.groupBy("pool").agg((F.greatest(quantile(F.col("distance"), 0.5), F.lit(MEDIAN_5)) / MEDIAN_5).alias("scale"))
    return levels.join(units.drop("n").join(params, "pool").join(scale, "pool"), "pool").drop("pool")


def outliers(stats: DataFrame, params: DataFrame, by: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """``stats`` with ``distance`` (squared, robust; null without estimates) and ``outlier``."""
    d = range(len(X))
    rows, p = with_features(stats), params.withColumnsRenamed({"ga": "ka", "gb": "kb"})
    out = rows.join(p, rows[by[0]].eqNullSafe(p["ka"]) & rows[by[1]].eqNullSafe(p["kb"]), "left")
    out = out.withColumns({f"z{i}": (F.col(c) - F.col(f"m{i}")) / F.col(f"d{i}") for i, c in enumerate(X)})
    out = out.withColumn("distance", squared_distance([f"z{i}" for i in d]) / F.col("scale"))
    return out.select(*stats.columns, "distance", F.coalesce(F.col("distance") > CUTOFF_5, F.lit(False)).alias("outlier"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang, source, the statistics, base_failed, distance, outlier and kept for each row of ``docs``.

    kept is false where the base rules fail (fewer than 50 words, or over half of the words in repeated three-word
    windows) and where the vector is an outlier of its language and source, or of a wider pool where these have few
    rows. A null text counts as empty and so fails; a null language or source is a group, a null id is passed on;
    repeated rows each get their verdict; very long texts are counted whole; an empty table gives no rows. Other columns
    are ignored.
    """
    slim = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), "lang", "source")
    stats = stored(text_statistics(slim), "statistics")
    return outliers(stats, estimates(stats)).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~F.col("outlier"))


def keep(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, unchanged, whatever their columns are called. Rows and statistics are
    stored together, so that texts are counted once and never shuffled: the estimates are a row for each language and
    source. Nulls, repeated rows, long texts and empty tables are as in ``judge``."""
    whole = docs.select(docs[text_col].alias("text"), "lang", "source", F.struct(*docs.columns).alias("row"))
    stats = stored(text_statistics(whole), "statistics")
    judged = outliers(stats, estimates(stats.drop("row")))
    return judged.where(~base_failed() & ~F.col("outlier")).select("row.*")
