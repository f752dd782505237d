"""Near copies in rounds: all links, each pair in one family, no text that isn't asked for."""

import zlib

import numpy as np
import pyarrow as pa

from loomgraph.llm import shingles


def plain_components(texts):
    sets, least = [set(shingles.shingle_set(t).tolist()) for t in texts], list(range(len(texts)))
    for _ in texts:
        for a in range(len(texts)):
            for b in range(a):
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    least[a] = least[b] = min(least[a], least[b])
    return least


def test_rounds_lose_no_link(spark, monkeypatch):
    """Passages that many hold, so that families have members which are still apart."""
    made, names = shingles.written, []
    monkeypatch.setattr(shingles, "written", lambda df, name, *by: names.append(name) or made(df, name, *by))
    monkeypatch.setattr(shingles, "ROUND_GRAMS", 1)
    monkeypatch.setattr(shingles, "ROUND_SHARE", 8)
    draw, passage = np.random.default_rng(5), [f"p{i}" for i in range(40)]
    texts = []
    for k in range(30):
        words = [f"w{k}x{i}" for i in range(int(draw.integers(60, 90)))]
        for copy in range(3):
            texts.append(" ".join([*passage, *words[: len(words) - 8 * copy], *(f"e{k}y{i}" for i in range(copy))]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in shingles.link_near_duplicates(df).collect()}
    assert got == dict(enumerate(plain_components(texts))) and len(set(got.values())) < len(texts)
    assert names.count("shingle-met") == shingles.PREFIX_ROUNDS and names.count("shingle-links") > 4


def test_a_pair_stays_in_one_family():
    """Two members that meet in three families and may link are left to the least."""
    sets = [shingles.shingle_set(" ".join([*(f"w{i}" for i in range(50)), end])) for end in ("a", "b")]
    rows = [
        {"family": f, "x": 0, "y": 0, "id": i, "block": 0, "n": len(s), "parts": shingles.parts_of(s), "component": i, "families": [3, 1, 2]}
        for f in (1, 2, 3)
        for i, s in zip((7, 8), sets)
    ]
    left = [r for b in shingles._filter(80)([pa.RecordBatch.from_pylist(rows)]) for r in b.to_pylist()]
    assert sorted((r["family"], r["id"]) for r in left) == [(1, 7), (1, 8)]
    # A first class has been compared with its family's members.
    assert not shingles._own([1, 8], [[2], [1, 2]], np.array([0]), np.array([1]), 2).any()


def test_texts_that_are_not_wanted_stay(spark):
    rows = spark.range(-20_000, 20_000).selectExpr("id", "cast(id as string) text")
    wanted = set(range(-20_000, 20_000, 97))
    got = [r["id"] for r in shingles._wanted(rows, spark.createDataFrame([(i,) for i in wanted], "id long")).collect()]
    assert wanted <= set(got) and len(got) == len(set(got)) < 1.1 * len(wanted)
    assert shingles._wanted(rows, rows.where("false").select("id")).count() == 0


def test_order_tells_what_is_somewhat_more_frequent():
    """Counters of 130 (unique n-grams of a large input) and 174 (one that 44 documents share)."""
    counts = [{"chunk": 0, "counts": zlib.compress(np.array([130, 174], dtype=np.uint8).tobytes())}]
    (row,) = next(shingles._add_chunks([pa.RecordBatch.from_pylist(counts)])).to_pylist()
    rare, shared = zlib.decompress(row["codes"])
    assert rare < shared
