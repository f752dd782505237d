"""Near copies whose part counts exceed what a part's count can say."""

import numpy as np

from loomgraph.llm import shingles


def test_sets_over_the_cap_keep_their_pairs(monkeypatch):
    monkeypatch.setattr(shingles, "PART_MOST", 3)
    base = [f"w{i}" for i in range(2000)]
    texts = [" ".join(base), " ".join(["other", *base[1:]]), " ".join(base[:1900]), " ".join(base[:180]), "x " + " ".join(base[1:180])]
    sets = [shingles.shingle_set(t) for t in texts]
    sizes = np.array([len(s) for s in sets])
    parts = np.array([np.frombuffer(shingles.parts_of(s), "<u2") for s in sets]).astype(np.int32)
    assert (parts[:3] == 3).all()
    i, j = shingles._pairs(sizes, parts, np.arange(len(sets)), np.zeros(len(sets), dtype=bool), 80)
    held = [shingles._Set(shingles.parts_of(x), x.astype("<u8").tobytes(), 80) for x in sets]
    found = set(zip(i.tolist(), j.tolist()))
    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            o = len(np.intersect1d(sets[a], sets[b]))
            if 100 * o >= 80 * (sizes[a] + sizes[b] - o):
                assert (a, b) in found and shingles.links(held[a], held[b], 80)
    assert {(0, 1), (0, 2), (1, 2), (3, 4)} <= found
