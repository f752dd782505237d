"""Collecting changes and applying them as one."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from .graph import Graph
from .mutate import batch

OPS = "seq long, op string, node_id long, key string, src long, etype string, dst long, prop string, value string"


@dataclass
class Transaction:
    """Operations in the order they were asked for; commit() gives the new graph, and
    nothing has happened before that. Used as a context, an exception drops them all.

    For many changes, hand mutate.batch a frame of operations instead."""

    graph: Graph
    ops: list[tuple] = field(default_factory=list)
    result: Graph | None = None

    def _add(self, op, node_id=None, key=None, edge=(None, None, None), prop=None, value=None) -> Transaction:
        self.ops.append((len(self.ops), op, node_id, key, *edge, prop, None if value is None else str(value)))
        return self

    def create_node(self, node_id: int, key: str | None = None, **props) -> Transaction:
        self._add("create_node", node_id, key)
        for name, value in props.items():
            self.set_node_prop(node_id, name, value)
        return self

    def delete_node(self, node_id: int) -> Transaction:
        return self._add("delete_node", node_id)

    def set_node_prop(self, node_id: int, name: str, value) -> Transaction:
        return self._add("set_node_prop", node_id, prop=name, value=value) if value is not None else self._add("del_node_prop", node_id, prop=name)

    def link(self, src: int, etype: str, dst: int, **props) -> Transaction:
        self._add("link", edge=(src, etype, dst))
        for name, value in props.items():
            self.set_edge_prop(src, etype, dst, name, value)
        return self

    def unlink(self, src: int, etype: str, dst: int) -> Transaction:
        return self._add("unlink", edge=(src, etype, dst))

    def set_edge_prop(self, src: int, etype: str, dst: int, name: str, value) -> Transaction:
        op = "del_edge_prop" if value is None else "set_edge_prop"
        return self._add(op, edge=(src, etype, dst), prop=name, value=value)

    def frame(self) -> DataFrame:
        return self.graph.spark.createDataFrame(self.ops, OPS)

    def commit(self) -> Graph:
        self.result = batch(self.graph, self.frame()) if self.ops else self.graph
        return self.result

    def rollback(self) -> Graph:
        self.ops.clear()
        self.result = self.graph
        return self.graph

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, *_) -> None:
        self.rollback() if kind else self.commit()
