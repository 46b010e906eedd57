"""Nested traits as VARIANT values: taken apart into leaves, put together again, and reshaped by templates."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import property_id
from ..sources.batches import stored

#: A step of a path is a key of an object or a place in a list.
STEP = "struct<key: string, pos: int>"
LEAVES = ("path", "name", "kind", "value")
#: Between a path's text and its leaf's; JSON texts don't have it.
END = "\x01"


def kind_of(v: Column) -> Column:
    """object, array, null, or the scalar's type, of a variant."""
    own = F.lower(F.regexp_extract(F.schema_of_variant(v), r"^\w+", 0))
    return F.when(F.is_variant_null(v), "null").otherwise(own)


def kind_of_text(value: str) -> Column:
    """``kind_of`` of a variant's JSON text. Only numbers with more than 18 digits, or other than digits, are parsed: the first
    character tells the rest apart, and the schema of a whole object or list isn't worked out."""
    first = F.substring(value, 1, 1)
    known = [("{", "object"), ("[", "array"), ('"', "string"), ("n", "null"), ("t", "boolean"), ("f", "boolean")]
    return F.coalesce(*[F.when(first == c, kind) for c, kind in known], F.when(F.col(value).rlike(r"^-?\d{1,18}$"), "bigint"), kind_of(F.parse_json(value)))


def name_of(path: Column) -> Column:
    """Keys and places joined by dots."""
    return F.array_join(F.transform(path, lambda s: F.coalesce(s["key"], s["pos"].cast("string"))), ".")


def brackets_of_text(value: str) -> Column:
    """The brackets of a JSON text in order, without those within strings."""
    plain = F.when(F.contains(value, F.lit("\\")), F.regexp_replace(value, r"\\.", "")).otherwise(F.col(value))
    return F.regexp_replace(plain, r'"[^"]*"[^\[\]{}"]*|[^\[\]{}"]+', "")


def depth_of_brackets(brackets: str) -> Column:
    """How many levels they have; an empty object or list counts as one."""
    def after(state: Column, bracket: Column) -> Column:
        now = state["now"] + F.when((bracket == "{") | (bracket == "["), 1).when((bracket == "}") | (bracket == "]"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(state["most"], now).alias("most"))

    return F.aggregate(F.split(brackets, ""), F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), after)["most"]


def leaves(df: DataFrame, keys: list[str], column: str, together: bool = False) -> DataFrame:
    """(keys, path, name, kind, value): each scalar, JSON null, and empty object or list of a variant column, with its path
    and its JSON text. Rows whose variant is null give none; neither do other columns.

    Variants are stored once, as texts, and the deepest one's levels counted. A level of nesting is then a lateral
    ``variant_explode`` that leaves go through as they are, so that nothing else is written. With ``together`` a key's
    variant is shuffled to its key before it is taken apart, and ``assembled`` needs no shuffle of the leaves.
    """
    spark = df.sparkSession
    # nulls are left out when the texts are read: a filter before that would make each variant twice
    texts = stored(df.select(*keys, F.to_json(column).alias("value")), "nested", "zstd").where("value is not null")
    depth = texts.select(brackets_of_text("value").alias("b")).distinct().agg(F.max(depth_of_brackets("b"))).first()[0] or 0
    rows = (texts.repartition(*keys) if together else texts).select(*keys, F.array().cast(f"array<{STEP}>").alias("path"), F.parse_json("value").alias("v"))
    for _ in range(depth):
        outer = rows.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("path").alias("_path"), F.col("v").alias("_v"))
        parts = outer.lateralJoin(spark.tvf.variant_explode_outer(F.col("_v").outer()))
        step = F.struct("key", F.when(F.col("key").isNull(), F.col("pos")).cast("int").alias("pos"))
        path = F.when(F.col("pos").isNull(), F.col("_path")).otherwise(F.concat("_path", F.array(step)))
        rows = parts.select(*[F.col(f"_{k}").alias(k) for k in keys], path.alias("path"), F.when(F.col("pos").isNull(), F.col("_v")).otherwise(F.col("value")).alias("v"))
    rows = rows.select(*keys, "path", F.to_json("v").alias("value"))
    return rows.select(*keys, "path", name_of(F.col("path")).alias("name"), kind_of_text("value").alias("kind"), "value")


def assembled(rows: DataFrame, keys: list[str], column: str = "traits") -> DataFrame:
    """(keys, column): the variants whose ``leaves`` these are; a key's leaves must be of one variant.

    A key's leaves are put in the order of their paths, and the text of each is written after what closes and opens between
    its path and the one before.
    """
    end = END
    shapes: dict[tuple, tuple] = {}

    def steps_of(path: str) -> tuple:
        """A path's steps as (place, key, what opens it)."""
        return tuple((s["pos"], "", "[") if "pos" in s else (-1, s["key"], "{" + json.dumps(s["key"]) + ":") for s in json.loads(path))

    def closed(steps: tuple) -> str:
        return "".join("}" if place < 0 else "]" for place, _, _ in reversed(steps))

    def shape_of(paths: tuple) -> tuple:
        """The order of the leaves with these paths, what is written before each, and what after the last."""
        steps = [steps_of(p) for p in paths]
        order, parts, before = sorted(range(len(paths)), key=steps.__getitem__), [], ()
        for i in order:
            n, part = 0, ""
            if before:
                while before[n] == steps[i][n]:
                    n += 1
                part = closed(before[n + 1:]) + ","
            opened = "".join(opens for _, _, opens in steps[i][n:])
            parts.append(part + (opened[1:] if before else opened))
            before = steps[i]
        return order, parts, closed(before)

    def text_of(leaves: list[str]) -> str:
        split = [leaf.split(end, 1) for leaf in leaves]
        paths = tuple(path for path, _ in split)
        if (shape := shapes.get(paths)) is None:
            shape = shape_of(paths)
            if len(paths) <= 200 and len(shapes) < 1000:  # many variants are alike
                shapes[paths] = shape
        order, parts, last = shape
        return "".join(part + split[i][1] for i, part in zip(order, parts)) + last

    leaf = F.concat(F.to_json("path"), F.lit(END), F.col("value"))
    # a number as the first key: sorts that group many keys compare it before the keys themselves
    groups = rows.select(*keys, leaf.alias("leaf")).groupBy(F.xxhash64(*keys).alias("_h"), *keys).agg(F.collect_list("leaf").alias("leaves"))
    return groups.select(*keys, F.parse_json(F.udf(text_of, "string", useArrow=True)("leaves")).alias(column))


def property_rows(entities: DataFrame, column: str = "traits") -> DataFrame:
    """Properties as ``ingest.property_rows`` gives them, of entities (observer_pk, entity_pk, entity_type, ts) with nested
    traits: one row a leaf that isn't null or empty, by its dotted name; texts without quotes, numbers also as decimals."""
    keys = ["observer_pk", "entity_pk", "entity_type", "ts"]
    own = leaves(entities, keys, column).where(~F.col("value").isin("null", "{}", "[]"))
    plain = F.when(F.contains("value", F.lit("\\")), F.parse_json("value").cast("string")).otherwise(F.substr("value", F.lit(2), F.length("value") - 2))
    value = F.when(F.col("kind") == "string", plain).otherwise(F.col("value"))
    p = own.select(*keys, F.col("name").alias("property_name"), value.alias("property_value"), F.when(F.col("kind").isin("bigint", "decimal", "double", "float"), F.col("value")).alias("_n"))
    return p.select(*keys, "property_name", "property_value", F.col("_n").try_cast("decimal(20,10)").alias("property_number"), property_id("observer_pk", "entity_pk", "entity_type", "property_value").alias("property_id"))


def at(v: Column, path: str) -> Column:
    """The part of a variant at a dotted path; null if it isn't there. Numbers are places in lists."""
    steps = "".join(f"[{s}]" if s.isdigit() else f"[{json.dumps(s)}]" for s in path.split("."))
    return F.try_variant_get(v, "$" + steps, "variant")


class Missing(Exception):
    """Stands for a default that wasn't given."""


def _text(v: Column, template: object, default: object, with_null: bool) -> Column:
    """JSON text of the template's value; null where it is left out."""
    if isinstance(template, dict):
        parts = []
        for key, inner in template.items():
            optional, name = key.endswith("?"), key.removesuffix("?")
            part = _text(v, inner, None if optional else default, with_null)
            if optional and isinstance(inner, str):
                part = F.when(~part.isin("null", "false", "0", '""', "[]", "{}"), part)
            part = part if with_null or not isinstance(inner, str) else F.when(part != "null", part)
            parts.append(F.concat(F.lit(json.dumps(name) + ":"), part))
        return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    if isinstance(template, list):
        return F.concat(F.lit("["), F.concat_ws(",", *[_text(v, inner, default, with_null) for inner in template]), F.lit("]"))
    if not isinstance(template, str):
        raise ValueError("a template is an object, a list or a path")
    found = F.to_json(at(v, template))
    other = F.raise_error(F.lit(f"nothing at {template}")).cast("string") if default is Missing else F.lit(json.dumps(default))
    return F.coalesce(found, other)


def reshaped(v: Column, template: object, default: object = Missing, with_null: bool = True) -> Column:
    """A variant of the template's form: its objects and lists, with the parts of ``v`` at the paths that are its leaves.

    A key that ends with ``?`` is optional: it is left out if its part is missing, null or empty (false and 0 count as
    empty). Another part that is missing is ``default``, or an error if none is given. Without ``with_null`` keys whose part
    is null are left out. A null variant gives null.
    """
    return F.when(v.isNotNull(), F.parse_json(_text(v, template, default, with_null)))
