"""Keys, types and tagged values as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def build_key(prefix: str, suffix: Column) -> Column:
    return F.concat(F.lit(prefix), suffix.cast("string"))


def type_of_key(key: Column, prefixes: dict[str, str]) -> Column:
    """The type whose prefix the key starts with; of several, the longest prefix wins.
    prefixes: type to prefix."""
    out = F.lit(None).cast("string")
    for name, prefix in sorted(prefixes.items(), key=lambda kv: (len(kv[1]), kv[0])):
        out = F.when(key.startswith(prefix), F.lit(name)).otherwise(out)
    return out


def hash_key(key: Column) -> Column:
    return F.xxhash64(key)


def weight(value: Column) -> Column:
    """An edge weight: what isn't a number, missing, zero or negative counts 1."""
    number = value.try_cast("double")
    return F.coalesce(F.when((number > 0) & ~F.isnan(number), number), F.lit(1.0))


#: Tags of values in exchange files.
TAGS = {"null": "void", "bool": "boolean", "int": "bigint", "float": "double", "string": "string", "vector": "array<float>"}


def tagged(value: Column, kind: str) -> Column:
    """A value as {type, value}, the value written as JSON text."""
    tag = tag_of(kind)
    text = F.to_json(F.struct(value.alias("v"))) if tag == "vector" else value.cast("string")
    if tag == "vector":
        text = F.regexp_extract(text, r'^\{"v":(.*)\}$', 1)
    return F.when(value.isNull(), F.struct(F.lit("null").alias("type"), F.lit(None).cast("string").alias("value"))).otherwise(
        F.struct(F.lit(tag).alias("type"), text.alias("value"))
    )


def tag_of(kind: str) -> str:
    kind = kind.lower()
    if kind in ("boolean",):
        return "bool"
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return "int"
    if kind in ("float", "double") or kind.startswith("decimal"):
        return "float"
    if kind.startswith("array<"):
        return "vector"
    return "string"


def untagged(pair: Column, kind: str) -> Column:
    """The typed value of {type, value}; a tag of another kind gives null."""
    fits = F.when(pair["type"] == tag_of(kind), pair["value"])
    if tag_of(kind) == "vector":
        return F.from_json(fits, kind)
    return fits.try_cast(kind)


def typed(value: Column, kind: str) -> Column:
    """A dynamic property (text) read as a kind; null where it isn't one."""
    return value.try_cast(kind)
