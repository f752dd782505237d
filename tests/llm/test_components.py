"""Components of few edges (one task) and of many (rounds)."""

import random

import pytest

from loomgraph.llm import components as C


def least_nodes(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    return {x: find(x) for x in root}


@pytest.fixture
def scattered(spark):
    """Shares are not put together, however small."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("few", [0, C.FEW])
def test_few_and_many_edges_give_the_same(scattered, monkeypatch, few):
    monkeypatch.setattr(C, "FEW", few)
    draw = random.Random(3)
    edges = [(draw.randrange(400), draw.randrange(400)) for _ in range(190)] + [(1000 + i, 1001 + i) for i in range(60)]
    edges = [(a, b) for a, b in edges if a != b]
    got = C.components(scattered.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == len({r["node"] for r in got}) and {r["node"]: r["component"] for r in got} == least_nodes(edges)


def test_few_edges_take_no_rounds(scattered, monkeypatch):
    made, write = [], C.written
    monkeypatch.setattr(C, "written", lambda df, name: made.append(name) or write(df, name))
    chain = scattered.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    assert {r["component"] for r in C.components(chain).collect()} == {0} and len(made) == 2
    assert C.components(chain.where("a < 0")).count() == 0
