"""Mixing, near duplicates, scoring, language, extraction, the pipeline."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import extraction, language, mixing, scoring, shingles
from loomgraph.llm.components import local_roots

SF = "/root/testdata/sf0.001"


# -- mixing ------------------------------------------------------------------------


def plain_targets(sizes, share=1.5, weights=(5, 2, 1), most=2.0):
    """Share by weight, cap, share the excess again, until none is above."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {}, set(names), share * sum(sizes.values())
    while free:
        level = left / sum(w[s] for s in free)
        full = {s for s in free if level * w[s] > most * sizes[s]}
        if not full:
            target |= {s: level * w[s] for s in free}
            break
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        free -= full
    return target


def test_mix(spark, odd, none):
    for df in (odd, spark.read.parquet(f"{SF}/documents.parquet")):
        rows = mixing.mix(df).collect()
        assert len(rows) == df.count()
        count = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
        assert Counter((r["id"], r["source"], r["size"]) for r in rows) == Counter((r["doc_id"], r["source"], count(r["text"])) for r in df.collect())
        sizes, taken = defaultdict(int), defaultdict(int)
        for r in rows:
            sizes[r["source"]] += r["size"]
            taken[r["source"]] += r["taken"]
            assert 0 <= r["taken"] <= 2 * r["size"]
        targets = plain_targets(dict(sizes))
        for r in rows:
            assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], targets[r["source"]], abs_tol=1e-6)
        for s in sizes:
            assert abs(taken[s] - targets[s]) <= 1.001
        # Whole epochs first.
        for r in rows:
            if targets[r["source"]] >= sizes[r["source"]]:
                assert r["taken"] >= r["size"]
        again = mixing.mix(df.repartition(7)).collect()
        assert Counter(map(tuple, rows)) == Counter(map(tuple, again))
    assert mixing.mix(none).count() == 0 and mixing.mixed(none, mixing.mix(none)).count() == 0


def test_better_documents_come_first(spark):
    """Keys scaled by quality: junk is taken less often."""
    rows = [(i, ("word " if i % 2 else "w#$% ") * 10, "b" if i < 500 else "a") for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df, weights=(1, 5), share=0.75).where("source = 'a'").collect()
    mean = lambda odd: np.mean([r["taken"] for r in got if r["id"] % 2 == odd])
    assert mean(1) > 1.5 * mean(0)


def test_mixed_rows(spark, odd):
    rows = mixing.mix(odd)
    copies = defaultdict(int)
    for r in rows.collect():
        copies[r["id"]] += int(r["taken"] / r["size"] + 0.5) if r["size"] else 1
    got = Counter(r["doc_id"] for r in mixing.mixed(odd, rows).collect())
    assert got == {k: v for k, v in copies.items() if v}


# -- near duplicates -------------------------------------------------------------


def plain_sets(texts, n=5):
    out = []
    for t in texts:
        words = [w for w in re.split("[\x20\x09-\x0d]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) if w]
        out.append({tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set())
    return out


def plain_links(ids, texts):
    sets = plain_sets(texts)
    i, j = [], []
    for a in range(len(ids)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                i.append(a), j.append(b)
    order = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), dtype=int)
    place[order] = np.arange(len(ids))
    root = local_roots(len(ids), place[np.array(i, dtype=int)], place[np.array(j, dtype=int)])
    return {ids[k]: (len(sets[k]), ids[order[root[place[k]]]]) for k in range(len(ids))}


def near_copies(seed=1, groups=8, copies=30):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(900)]
    texts = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([8, 60, 300]))]
        for _ in range(copies):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            texts.append(" ".join(t[: rng.choice([len(t), len(t) - 1, len(t) * 9 // 10])]))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("block", [7, 256])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(shingles, "BLOCK", block)
    monkeypatch.setattr(shingles, "STAR", 4 * block)
    texts = near_copies()
    df = spark.createDataFrame([(3 * i + 1, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in shingles.link_near_duplicates(df).collect()}
    assert got == plain_links([3 * i + 1 for i in range(len(texts))], texts)
    kept = {r["doc_id"] for r in shingles.keep_one_each(df).collect()}
    assert kept == {c for _, c in got.values()}


def test_near_duplicates_of_odd_rows(odd, none):
    rows = shingles.link_near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    texts = {r["doc_id"]: r["text"] for r in odd.where("doc_id is not null").collect()}
    want = plain_links(list(texts), list(texts.values()))
    for r in rows:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["n_shingles"] == 1
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
    assert shingles.link_near_duplicates(none).count() == 0 and shingles.keep_one_each(none).count() == 0
    assert Counter(r["doc_id"] for r in shingles.keep_one_each(odd).collect()).most_common(1)[0][1] == 1


def test_filters_lose_nothing():
    """Length, prefix, positional and suffix filter pass every pair at or over 0.8."""
    texts = near_copies(9, 5, 12)
    sets = [shingles.shingle_set(t) for t in texts]
    codes = np.zeros(1 << shingles.TABLE_BITS, dtype=np.uint8)
    held = [shingles._Set(shingles.parts_of(s), shingles.ordered(s, codes).tobytes(), 80) for s in sets]
    sizes = np.array([len(s) for s in sets])
    parts = np.array([np.frombuffer(shingles.parts_of(s), "<u2") for s in sets]).astype(np.int32)
    i, j = shingles._pairs(sizes, parts, np.arange(len(sets)), np.zeros(len(sets), dtype=bool), 80)
    passed, barred = set(zip(i.tolist(), j.tolist())), 0
    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            o = len(np.intersect1d(sets[a], sets[b]))
            linked = bool(o) and 100 * o >= 80 * (sizes[a] + sizes[b] - o)
            assert shingles.links(held[a], held[b], 80) == linked
            if linked:
                assert (a, b) in passed and shingles.may_link(held[a], held[b], 80)
            elif o:
                barred += not shingles.may_link(held[a], held[b], 80)
    assert barred


def test_suffix_filter_looks_past_the_shared_place():
    """Two sets that share one rare n-gram and as many n-grams in each part: only what
    comes after that n-gram can be shared, too."""
    rare = np.array([1 << 40], dtype="<u8")
    rng = np.random.default_rng(1)
    rest = [np.unique(rng.integers(1 << 45, 1 << 60, 400, dtype=np.uint64) & ~np.uint64(63) | np.uint64(k)) for k in (3, 9)]
    a, b = (shingles._Set(shingles.parts_of(np.sort(np.concatenate([rare, r]))), np.concatenate([rare, r]).astype("<u8").tobytes(), 80) for r in rest)
    assert not shingles.may_link(a, b, 80)
    same = shingles._Set(shingles.parts_of(np.sort(np.concatenate([rare, rest[0]]))), np.concatenate([rare, rest[0]]).astype("<u8").tobytes(), 80)
    assert shingles.may_link(a, same, 80) and shingles.links(a, same, 80)


def test_chains_and_stars(spark, monkeypatch):
    """Chains, in which first and last share little; a hub with copies that aren't near
    each other; small blocks, so that every step is gone through."""
    monkeypatch.setattr(shingles, "BLOCK", 5)
    monkeypatch.setattr(shingles, "STAR", 4)
    rng = random.Random(6)
    words = [f"w{i}" for i in range(4000)]
    texts = []
    for _ in range(6):  # each step changes some of the words
        t = [rng.choice(words) for _ in range(120)]
        for _ in range(14):
            t = list(t)
            at = rng.randrange(100)
            t[at : at + 8] = [rng.choice(words) for _ in range(8)]
            texts.append(" ".join(t))
    for _ in range(3):
        hub = [rng.choice(words) for _ in range(100)]
        texts.append(" ".join(hub))
        for _ in range(25):
            t = list(hub)
            at = rng.randrange(85)
            t[at : at + rng.randint(3, 12)] = [rng.choice(words) for _ in range(6)]
            texts.append(" ".join(t))
    shared = " ".join(rng.choice(words) for _ in range(30))
    texts += [shared + " " + " ".join(rng.choice(words) for _ in range(40)) for _ in range(30)]
    ids = rng.sample(range(10_000), len(texts))
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in shingles.link_near_duplicates(df).collect()}
    assert got == plain_links(ids, texts)


def test_texts_of_one_id_are_one_node(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(5, a), (5, b), (5, b), (3, a + " end"), (9, b + " end"), (7, c), (8, c)]
    got = sorted((r["doc_id"], r["component_id"]) for r in shingles.link_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(3, 3), (5, 3), (5, 3), (5, 3), (7, 7), (8, 7), (9, 3)]


# -- scoring -----------------------------------------------------------------------


def test_network_predicts_from_both_sides(spark, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    network = scoring.train(docs)
    assert (scoring.train(docs.repartition(5)).numbers() == network.numbers()).all()
    text = docs.where("n_chars > 500").first()["text"]
    codes = scoring.windows(scoring.symbols(text))
    logs = network.window_logs(codes)
    tokens = [0, 0, *scoring.symbols(text).tolist(), 0, 0]
    for k in range(2, len(tokens) - 2):
        context = ((tokens[k - 2] * 32 + tokens[k - 1]) * 32 + tokens[k + 1]) * 32 + tokens[k + 2]
        one = network.logs(np.array([context]))[0]
        assert math.isclose(np.exp(one).sum(), 1, rel_tol=1e-4) and math.isclose(logs[k - 2], one[tokens[k]], rel_tol=1e-4, abs_tol=1e-5)
    mean = lambda t: network.window_logs(scoring.windows(scoring.symbols(t))).mean()
    letters = list(text)
    random.Random(1).shuffle(letters)
    assert mean(text) > mean("".join(letters)) + 0.5 and mean(text) > -2.6
    assert len(network.window_logs(np.zeros(0, np.uint32))) == 0
    assert (scoring.train(none).numbers() == scoring.WindowNetwork().numbers()).all()


def test_windows_cover_all_texts(odd):
    want = Counter(int(c) for r in odd.collect() if r["text"] for c in scoring.windows(scoring.symbols(r["text"])))
    assert {r["code"]: r["n"] for r in scoring.count_windows(odd).collect()} == want


# -- language ------------------------------------------------------------------------


def test_language(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs.where("doc_id % 2 = 0"))
    held_out = language.identify(docs.where("doc_id % 2 = 1").withColumnRenamed("lang", "true"), model, "text", host="source")
    rows = held_out.collect()
    assert np.mean([r["lang"] == r["true"] for r in rows]) > 0.99 and all(r["kept"] for r in rows)
    assert all(0 < r["probability"] <= 1 for r in rows)
    got = language.identify(odd, model, "text", host="source", declared="lang").collect()
    assert len(got) == odd.count()
    assert not any(r["kept"] for r in got if not re.search(r"[^\W\d_]", r["text"] or ""))
    assert language.identify(none, model, "text", host="source").count() == 0


def test_evidence_decides_short_pages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs)
    texts = {l: [r["text"] for r in docs.where(F.col("lang") == l).limit(20).collect()] for l in ("fr", "de")}
    rows = [(i, "http://a.example.fr/", f"<html><body><p>{t}</p>") for i, t in enumerate(texts["fr"])]
    rows += [(100 + i, "http://b.example.de/", f"<html><body><p>{t}</p>") for i, t in enumerate(texts["de"])]
    rows += [(900, "http://a.example.fr/", '<html lang="fr"><p>xa</p>'), (901, "http://b.example.de/x", "<html lang=de-AT><p>xa</p>"), (902, None, None), (903, "no address", ""), (904, "http://new.example.de", "<p>xa</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: (r["lang"], r["kept"]) for r in language.identify(pages, model, "html", url="url", markup=True).collect()}
    assert got[900] == ("fr", True) and got[901] == ("de", True) and got[904][0] == "de" and not got[902][1] and not got[903][1]


# -- extraction ------------------------------------------------------------------------


def test_held_out_pages():
    crf = extraction.trained()
    right = [l == g for page in extraction.labelled_pages(120, seed=77) for (_, l), g in zip(page, crf.decode([b for b, _ in page]))]
    assert np.mean(right) > 0.98


def test_decoding_is_the_best_path():
    import itertools

    crf = extraction.trained()
    for page in extraction.labelled_pages(15, seed=5):
        blocks = [b for b, _ in page][:9]
        scores = [crf._score(b) for b in blocks]
        value = lambda path: sum(s[l] for s, l in zip(scores, path)) + sum(crf.move[a][b] for a, b in zip(path, path[1:]))
        best = max(itertools.product((0, 1), repeat=len(blocks)), key=value)
        assert math.isclose(value(best), value(crf.decode(blocks)), rel_tol=1e-9)


def test_articles_of_the_pages(spark):
    import html

    rows = extraction.extract(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect()
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    for r in rows:
        article = re.search("<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        parts = (" ".join(html.unescape(re.sub("</?b>|<br>", "", b)).split()) for b in re.split("</?(?:p|h1)>", article))
        assert r["text"] == "\n\n".join(p for p in parts if p) and r["n_chars"] == len(r["text"])


def test_odd_pages(spark):
    page = "<body><div class=menu>x</div><article><h1>A &amp;amp; B</h1><p>one\n two<br>three<p>four &lt;b&gt; &eacute; &#x41;<script>no()</script><!-- no --><ul><li>five<li>six</ul>"
    rows = [(1, None), (2, ""), (3, page), (3, page), (4, "<"), (5, "plain text"), (6, page + "<p>" + "long " * 20000), (7, "<p" * 50), (8, "<script>never closed"), (9, "</div></p></b>")]
    got = extraction.extract(spark.createDataFrame([(i, h, "t", 1) for i, h in rows], "page_id long, html string, text string, n_chars int")).collect()
    assert len(got) == len(rows) and set(got[0].asDict()) == {"page_id", "text", "n_chars"}
    texts = {r["page_id"]: r["text"] for r in got}
    assert texts[1] == texts[2] == texts[8] == texts[9] == ""
    assert texts[3] == "A &amp; B\n\none two three\n\nfour <b> é A\n\nfive\n\nsix"
    assert texts[6].endswith("long long") and extraction.extract(spark.createDataFrame([], "page_id long, html string")).count() == 0


# -- pipeline -----------------------------------------------------------------------------


def test_pipeline(spark):
    import corpus_pipeline
    import public_tokenizers
    import sentencepiece

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "jaccard_join", "source_mixing", "piece_encoding"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, SF)
        after = spark.createDataFrame(after.collect(), after.schema).persist()
        old, new = before.collect(), after.collect()
        if name != "piece_encoding":
            assert after.columns == columns
        if name == "language_id":
            assert len(new) == len(old) and np.mean([a["lang"] == b["lang"] for a, b in zip(sorted(old, key=lambda r: r["doc_id"]), sorted(new, key=lambda r: r["doc_id"]))]) > 0.98
        if name == "line_dedup":
            seen = Counter(k for r in old for k in {x.strip(" \t\n\x0b\f\r").translate({c: c + 32 for c in range(65, 91)}) for x in r["text"].split("\n")} - {""})
            for r in new:
                assert all(seen[x.strip(" \t\n\x0b\f\r").translate({c: c + 32 for c in range(65, 91)})] < 10 for x in r["text"].split("\n"))
        if name == "jaccard_join":
            links = plain_links([r["doc_id"] for r in old], [r["text"] for r in old])
            assert {r["doc_id"] for r in new} == {c for _, c in links.values()} and len(new) == len({c for _, c in links.values()})
        if name == "source_mixing":
            assert {r["doc_id"] for r in new} <= {r["doc_id"] for r in old}
            words = lambda rows: sum(len((r["text"] or "").split()) for r in rows)
            assert abs(words(new) / words(old) - 1.5) < 0.2
        if name == "piece_encoding":
            library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
            assert len(new) == len(old) and all(r["n_tokens"] == len(library.encode(r["text"])) for r in new)
        before = after
    assert corpus_pipeline.run(spark, SF).count() == before.count()
    empty = docs.where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
