"""Declared node and edge types, and checking frames against them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys

KINDS = {"string": "string", "int": "bigint", "float": "double", "bool": "boolean", "vector": "array<float>", "any": None}


@dataclass(frozen=True)
class PropDef:
    name: str
    kind: str = "string"
    required: bool = False
    default: object = None
    dimensions: int | None = None

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"unknown kind {self.kind!r}")

    def optional(self) -> PropDef:
        return PropDef(self.name, self.kind, False, self.default, self.dimensions)


@dataclass(frozen=True)
class NodeDef:
    name: str
    prefix: str
    props: tuple[PropDef, ...] = ()
    key_fn: Callable[[Column], Column] | None = None

    def key(self, suffix: Column) -> Column:
        return self.key_fn(suffix) if self.key_fn else keys.build_key(self.prefix, suffix)

    @property
    def required(self) -> list[str]:
        return [p.name for p in self.props if p.required]


@dataclass(frozen=True)
class EdgeDef:
    name: str
    props: tuple[PropDef, ...] = ()


@dataclass(frozen=True)
class Schema:
    nodes: dict[str, NodeDef] = field(default_factory=dict)
    edges: dict[str, EdgeDef] = field(default_factory=dict)

    @classmethod
    def of(cls, *defs) -> Schema:
        return cls({d.name: d for d in defs if isinstance(d, NodeDef)}, {d.name: d for d in defs if isinstance(d, EdgeDef)})

    @property
    def prefixes(self) -> dict[str, str]:
        return {d.name: d.prefix for d in self.nodes.values()}

    def node(self, name: str) -> NodeDef:
        if name not in self.nodes:
            raise ValueError(f"unknown node type {name!r}")
        return self.nodes[name]

    def edge(self, name: str) -> EdgeDef:
        if name not in self.edges:
            raise ValueError(f"unknown edge type {name!r}")
        return self.edges[name]


def _violations(df: DataFrame, ident: list[str], props, where: Column) -> DataFrame:
    """One row for each property that breaks its definition. Unknown properties are fine."""
    kinds = dict(df.dtypes)
    found = []
    for p in props:
        missing = F.lit(True) if p.name not in kinds else F.col(p.name).isNull()
        if p.required:
            found.append(F.when(missing, F.struct(F.lit(p.name).alias("prop"), F.lit("required").alias("problem"))))
        if p.name in kinds and KINDS[p.kind] is not None and keys.tag_of(kinds[p.name]) != keys.tag_of(KINDS[p.kind]):
            wrong = ~missing & F.col(p.name).try_cast(KINDS[p.kind]).isNull() if not kinds[p.name].startswith("array") else ~missing
            found.append(F.when(wrong, F.struct(F.lit(p.name).alias("prop"), F.lit("type").alias("problem"))))
        if p.dimensions and p.name in kinds:
            found.append(F.when(F.size(p.name) != p.dimensions, F.struct(F.lit(p.name).alias("prop"), F.lit("dimensions").alias("problem"))))
    if not found:
        return df.where(F.lit(False)).select(*ident, F.lit("").alias("prop"), F.lit("").alias("problem"))
    return df.where(where).select(*ident, F.inline(F.filter(F.array(*found), lambda x: x.isNotNull())))


def node_violations(nodes: DataFrame, definition: NodeDef) -> DataFrame:
    return _violations(nodes, ["id", "key"], definition.props, F.col("key").startswith(definition.prefix))


def edge_violations(edges: DataFrame, definition: EdgeDef) -> DataFrame:
    return _violations(edges, ["src", "etype", "dst"], definition.props, F.col("etype") == definition.name)
