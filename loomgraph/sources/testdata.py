"""The driver's tables as a property graph.

Ids are type number * 10**12 + primary key; keys are a type's prefix and the primary key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import Graph
from ..operators.schema import EdgeDef, NodeDef, PropDef, Schema

BASE = 10**12
REGION, NATION, CUSTOMER, SUPPLIER, PART, ORDER = (BASE * t for t in range(1, 7))

SCHEMA = Schema.of(
    NodeDef("Region", "region:", (PropDef("name", required=True),)),
    NodeDef("Nation", "nation:", (PropDef("name", required=True),)),
    NodeDef("Customer", "customer:", (PropDef("name", required=True), PropDef("acctbal", "float"), PropDef("mktsegment"))),
    NodeDef("Supplier", "supplier:", (PropDef("name", required=True), PropDef("acctbal", "float"))),
    NodeDef("Part", "part:", (PropDef("name", required=True), PropDef("brand"), PropDef("ptype"), PropDef("size", "int"), PropDef("retailprice", "float"))),
    NodeDef("Order", "order:", (PropDef("status", required=True), PropDef("totalprice", "float"), PropDef("priority"))),
    EdgeDef("IN_REGION"),
    EdgeDef("IN_NATION"),
    EdgeDef("BASED_IN"),
    EdgeDef("PLACED", (PropDef("totalprice", "float"),)),
    EdgeDef("CONTAINS", (PropDef("quantity", "float"), PropDef("price", "float"), PropDef("n_lines", "int"))),
    EdgeDef("SUPPLIES", (PropDef("n_lines", "int"),)),
    EdgeDef("ROUTE", (PropDef("weight", "float"),)),
)

NODE_PROPS = {"name": "string", "acctbal": "double", "mktsegment": "string", "brand": "string", "ptype": "string", "size": "bigint", "retailprice": "double", "status": "string", "totalprice": "double", "priority": "string"}
EDGE_PROPS = {"quantity": "double", "price": "double", "n_lines": "bigint", "totalprice": "double", "weight": "double"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _nodes(df: DataFrame, base: int, prefix: str, label: str, pk: str, **props: str) -> DataFrame:
    return df.select(
        (F.col(pk).cast("long") + base).alias("id"),
        F.concat(F.lit(prefix), F.col(pk).cast("string")).alias("key"),
        F.array(F.lit(label)).alias("labels"),
        *[(F.col(props[p]) if p in props else F.lit(None)).cast(t).alias(p) for p, t in NODE_PROPS.items()],
    )


def _edges(df: DataFrame, etype: str, src, dst, **props) -> DataFrame:
    return df.select(
        src.cast("long").alias("src"), F.lit(etype).alias("etype"), dst.cast("long").alias("dst"), *[(props[p] if p in props else F.lit(None)).cast(t).alias(p) for p, t in EDGE_PROPS.items()]
    )


def route_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part p to part (2p + 1) mod N and to part (p + 7) mod N, N parts, weight p_size."""
    part = table(spark, sf_dir, "part")
    n = part.agg(F.count("*")).scalar()  # a subquery: not run where no route is read
    steps = part.select("p_partkey", "p_size", F.explode(F.array((F.col("p_partkey") * 2 + 1) % n, (F.col("p_partkey") + 7) % n)).alias("to"))
    steps = steps.dropDuplicates(["p_partkey", "to"])
    return _edges(steps, "ROUTE", F.col("p_partkey") + PART, F.col("to") + PART, weight=F.col("p_size"))


def route_graph(spark: SparkSession, sf_dir: str) -> Graph:
    part = table(spark, sf_dir, "part")
    nodes = _nodes(part, PART, "part:", "Part", "p_partkey", name="p_name", brand="p_brand", ptype="p_type", size="p_size", retailprice="p_retailprice")
    return Graph(nodes, route_edges(spark, sf_dir), SCHEMA)


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    t = lambda name: table(spark, sf_dir, name)
    nodes = [
        _nodes(t("region"), REGION, "region:", "Region", "r_regionkey", name="r_name"),
        _nodes(t("nation"), NATION, "nation:", "Nation", "n_nationkey", name="n_name"),
        _nodes(t("customer"), CUSTOMER, "customer:", "Customer", "c_custkey", name="c_name", acctbal="c_acctbal", mktsegment="c_mktsegment"),
        _nodes(t("supplier"), SUPPLIER, "supplier:", "Supplier", "s_suppkey", name="s_name", acctbal="s_acctbal"),
        _nodes(t("part"), PART, "part:", "Part", "p_partkey", name="p_name", brand="p_brand", ptype="p_type", size="p_size", retailprice="p_retailprice"),
        _nodes(t("orders"), ORDER, "order:", "Order", "o_orderkey", status="o_orderstatus", totalprice="o_totalprice", priority="o_orderpriority"),
    ]
    c = F.col
    lines = t("lineitem")
    contains = lines.groupBy("l_orderkey", "l_partkey").agg(F.sum("l_quantity").alias("q"), F.sum("l_extendedprice").alias("p"), F.count("*").alias("n"))
    supplies = lines.groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n"))
    edges = [
        _edges(t("nation"), "IN_REGION", c("n_nationkey") + NATION, c("n_regionkey") + REGION),
        _edges(t("customer"), "IN_NATION", c("c_custkey") + CUSTOMER, c("c_nationkey") + NATION),
        _edges(t("supplier"), "BASED_IN", c("s_suppkey") + SUPPLIER, c("s_nationkey") + NATION),
        _edges(t("orders"), "PLACED", c("o_custkey") + CUSTOMER, c("o_orderkey") + ORDER, totalprice=c("o_totalprice")),
        _edges(contains, "CONTAINS", c("l_orderkey") + ORDER, c("l_partkey") + PART, quantity=c("q"), price=c("p"), n_lines=c("n")),
        _edges(supplies, "SUPPLIES", c("l_suppkey") + SUPPLIER, c("l_partkey") + PART, n_lines=c("n")),
        route_edges(spark, sf_dir),
    ]

    def union(parts):
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.unionByName(p)
        return whole

    # Each part is a set already, so no edge needs to be looked for twice.
    return Graph(union(nodes), union(edges), SCHEMA)
