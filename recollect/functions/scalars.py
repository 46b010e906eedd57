"""Text, number and vector helpers as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def try_number(c: Column | str) -> Column:
    """A double where the text is a number, else null (keep the text beside it)."""
    return col(c).try_cast("double")


def clean_value(c: Column | str, most: int = 100) -> Column:
    """Runs of blanks become one; longer values are cut and end in dots."""
    v = F.trim(F.regexp_replace(col(c), r"\s+", " "))
    return F.when(F.length(v) > most, F.concat(F.substring(v, 1, most), F.lit("..."))).otherwise(v)


def clean_text(c: Column | str) -> Column:
    """Lines without blanks at their ends, empty ones dropped."""
    lines = F.transform(F.split(col(c), "\n"), lambda line: F.trim(line))
    return F.array_join(F.filter(lines, lambda line: line != ""), "\n")


def slug(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(col(c)), r"[^a-z0-9]+", "-"), F.lit("-"))


def label_of_event(c: Column | str) -> Column:
    """``page-viewed`` becomes ``Page Viewed``."""
    return F.initcap(F.regexp_replace(col(c), r"[-_]+", " "))


def is_email(c: Column | str) -> Column:
    return F.coalesce(col(c).rlike(r"^[\w.+-]+@[\w-]+(\.[\w-]+)+$"), F.lit(False))


def is_hex(c: Column | str) -> Column:
    return F.coalesce(col(c).rlike(r"^[0-9a-fA-F]+$"), F.lit(False))


def host_of(c: Column | str) -> Column:
    return F.regexp_extract(col(c), r"^[a-z]+://([^/:?#]+)", 1)


def is_url(c: Column | str) -> Column:
    """http or https, with a host of which the last part is a name, or localhost, or an address."""
    return F.coalesce(col(c).rlike(r"(?i)^https?://([\w-]+(\.[\w-]+)*\.[a-z]{2,}|localhost|\d{1,3}(\.\d{1,3}){3})(:\d+)?([/?#]\S*)?$"), F.lit(False))


def in_reference(df: DataFrame, value: Column, reference: DataFrame, name: str) -> DataFrame:
    """``df`` with a boolean column ``name``: whether the value, lower-cased, is in the first column of the reference
    table (e-mail domains, social hosts, language codes, topics), which is distinct after lower-casing."""
    r = reference.select(F.lower(F.col(reference.columns[0])).alias("_r")).distinct()
    return df.withColumn("_v", F.lower(value)).join(r, F.col("_v") == F.col("_r"), "left").withColumn(name, F.col("_r").isNotNull()).drop("_v", "_r")


def email_domain(c: Column | str) -> Column:
    return F.lower(F.regexp_extract(col(c), r"@([^@\s]+)$", 1))


def try_json(c: Column | str) -> Column:
    """The value, null where the text isn't JSON."""
    return F.try_parse_json(col(c))


def split_list(c: Column | str, separator: str = ",") -> Column:
    """Trimmed parts that aren't empty; null gives an empty array."""
    parts = F.transform(F.split(col(c), re.escape(separator)), lambda x: F.trim(x))
    return F.coalesce(F.filter(parts, lambda x: x != ""), F.array().cast("array<string>"))


def camel_case(c: Column | str) -> Column:
    """``page_viewed now`` becomes ``pageViewedNow``."""
    words = F.filter(F.split(F.lower(col(c)), r"[^a-z0-9]+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w, i: F.when(i == 0, w).otherwise(F.initcap(w))), "")


def languages(c: Column | str) -> Column:
    """Codes of an Accept-Language header, the most wanted first; a code without a weight has 1."""
    def one(part: Column) -> Column:
        weight = F.coalesce(F.nullif(F.regexp_extract(part, r"q\s*=\s*([0-9.]+)", 1), F.lit("")).try_cast("double"), F.lit(1.0))
        return F.struct((-weight).alias("w"), F.lower(F.trim(F.substring_index(part, ";", 1))).alias("code"))

    parts = F.transform(split_list(c), lambda p: one(p))
    ranked = F.array_sort(F.transform(parts, lambda x, i: F.struct(x["w"].alias("w"), i.alias("i"), x["code"].alias("code"))))
    return F.transform(ranked, lambda x: x["code"])


def forwarded_ip(c: Column | str) -> Column:
    """The first address of an X-Forwarded-For header; null if it has none."""
    return F.nullif(F.trim(F.substring_index(col(c), ",", 1)), F.lit(""))


def fact_text(actor: Column | str, label: Column | str, target: Column | str) -> Column:
    """``actor label object.``, without what is null."""
    return F.concat(F.concat_ws(" ", col(actor), F.regexp_replace(col(label), r"[-_]+", " "), col(target)), F.lit("."))


def pretty_seconds(c: Column | str) -> Column:
    s = col(c).cast("long")
    return F.format_string("%dd %02d:%02d:%02d", F.floor(s / 86400), F.floor(s / 3600) % 24, F.floor(s / 60) % 60, s % 60)


def merged(left: Column | str, right: Column | str) -> Column:
    """Two maps of flattened traits as one; the right one wins."""
    kept = F.map_filter(col(left), lambda k, v: ~F.array_contains(F.map_keys(col(right)), k))
    return F.map_concat(kept, col(right))


def traits_text(c: Column | str) -> Column:
    """``(a="x", b="y")`` in the order of names."""
    e = F.transform(F.array_sort(F.map_entries(col(c))), lambda x: F.concat(x["key"], F.lit('="'), F.coalesce(x["value"], F.lit("")), F.lit('"')))
    return F.concat(F.lit("("), F.array_join(e, ", "), F.lit(")"))


def fill_template(template: str, values: dict[str, Column], default: str = "N/A") -> Column:
    """``{{name}}``, ``{{name ? "of %s"}}`` and ``{{name ! "default"}}`` replaced by columns; a null value gives the
    default, others are put into the format."""
    out, at = [], 0
    for m in re.finditer(r'\{\{\s*([\w.@]+)\s*(?:\?\s*"([^"]*)")?\s*(?:!\s*"([^"]*)")?\s*\}\}', template):
        out.append(F.lit(template[at : m.start()]))
        missing = F.lit(m[3] if m[3] is not None else default)
        value = values[m[1]].cast("string") if m[1] in values else None
        if value is not None and m[2] is not None:
            before, _, after = m[2].partition("%s")
            value = F.concat(F.lit(before), value, F.lit(after))
        out.append(missing if value is None else F.coalesce(value, missing))
        at = m.end()
    return F.concat(*out, F.lit(template[at:]))


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Null where a vector is zero."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))
