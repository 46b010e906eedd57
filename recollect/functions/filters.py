"""Comparisons of a column with a value as stored filters mean them, and nested columns by dotted names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Texts that stand for any value at all: fixed values of stored filters.
ANYTHING = ("null", "none", "*")


def equals(column: Column, value) -> Column:
    """Null asks for null, one of ANYTHING for what isn't null, a list for one of its values, a column for its value."""
    if value is None:
        return column.isNull()
    if isinstance(value, str) and value.lower() in ANYTHING:
        return column.isNotNull()
    return column.isin(list(value)) if isinstance(value, (list, tuple, set)) else column == value


def differs(column: Column, value) -> Column:
    """Null asks for what isn't null, a list for none of its values."""
    if value is None:
        return column.isNotNull()
    return ~column.isin(list(value)) if isinstance(value, (list, tuple, set)) else column != value


def flat_names(schema: StructType, prefix: str = "") -> list[str]:
    """The dotted names of all columns that aren't structs."""
    out = []
    for f in schema.fields:
        name = f"{prefix}{f.name}"
        out += flat_names(f.dataType, f"{name}.") if isinstance(f.dataType, StructType) else [name]
    return out


def flattened(df: DataFrame) -> DataFrame:
    """Nested structs as columns with dotted names."""
    return df.select(*[F.col(".".join(f"`{p}`" for p in n.split("."))).alias(n) for n in flat_names(df.schema)])
