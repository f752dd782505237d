"""Pieces, token files, lines: against the libraries and plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomgraph.llm import lines, pieces, token_files

MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def random_texts(n, seed):
    rng = random.Random(seed)
    parts = [*" \n\t▁aabbcdetheing01.,$éñ門梦😀\x00\r　ﬁ\xa0", " the", " and", "    ", "ss", "aaaa", "\n\n"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_pieces_as_the_library(library):
    coder = pieces.Pieces(MODEL)
    for text in [*random_texts(4000, 1), *(" " * n + end for n in range(70) for end in ("", "a", "1", "門"))]:
        ids = coder.encode(text)
        assert ids == library.encode(text), repr(text)
        assert coder.decode(ids) == library.decode(ids), repr(text)
    rng = random.Random(2)
    for _ in range(1000):
        ids = [rng.randrange(3, 300) if rng.random() < 0.5 else rng.randrange(300, 32000) for _ in range(rng.randint(0, 9))]
        assert coder.decode(ids) == library.decode(ids), ids


def test_pieces_memory_is_bounded(library, monkeypatch):
    monkeypatch.setattr(pieces, "MEMORY", 5)
    coder = pieces.Pieces(MODEL)
    for text in random_texts(200, 3):
        assert coder.encode(text) == library.encode(text)
    assert len(coder.words) <= 5


def test_encode_frame(spark, odd, none, library):
    rows = pieces.encode(odd, MODEL).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert r["ids"] == library.encode(r["text"] or "") and r["decoded"] == library.decode(r["ids"])
    digest = pieces.encode(odd.select("doc_id", "text"), MODEL, digest=True)
    for r in digest.collect():
        ids = library.encode(r["text"] or "")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert pieces.encode(none, MODEL).count() == 0
    back = pieces.decode(pieces.encode(odd, MODEL).select("text", "ids"), MODEL).collect()
    assert all(r["decoded"] == library.decode(r["ids"]) for r in back)


def test_variable_length_codes():
    rng = random.Random(4)
    for n in (0, 1, 3, 4, 5, 1001):
        v = np.array([rng.choice([0, 1, 255, 256, 65535, 65536, (1 << 24) - 1, 1 << 24, (1 << 32) - 1]) for _ in range(n)], dtype="<u4")
        control, data = token_files.pack(v)
        assert len(control) == -(-n // 4) and (token_files.unpack(control, data, n) == v).all()


def test_words_as_the_library():
    coder, library = token_files.WordCoder(WORDS), Tokenizer.from_file(WORDS)
    rng = random.Random(5)
    parts = [*" \n\t\r\x0b\x0c\x1c\x1d\x85\xa0 　aAbBcsSdetTheing01.,$éÉñÀßÿ門😀\x00Σσς'", " The", " and", "    ", "'s", "́", "İ", "<|endoftext|>", "<|startoftext|> ", "</w>"]
    assert coder.splits
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_token_files(spark, odd, none, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "SHARD_IDS", 1 << 24)
    library = Tokenizer.from_file(WORDS)
    for df, name in ((odd, "odd"), (none, "none")):
        path = str(tmp_path / name)
        contents = token_files.write_token_files(df, path, WORDS, 1)
        rows = token_files.read_token_files(spark, path).orderBy("start").collect()
        texts = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
        assert len(rows) == len(texts) == sum(c["docs"] for c in contents.collect())
        want = Counter((d, tuple(library.encode(t or "", add_special_tokens=False).ids + [1])) for d, t in texts)
        assert Counter((r["doc_id"], tuple(r["ids"])) for r in rows) == want
        ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in rows]
        assert ids == sorted(ids)
        start = 0
        for r in rows:
            assert r["start"] == start and r["n_tokens"] == len(r["ids"])
            start += len(r["ids"])
        for r in token_files.read_token_files(spark, path, digest=True).collect():
            assert r["ids_crc32"] in {zlib.crc32(np.array(x["ids"], "<u4").tobytes()) for x in rows if x["doc_id"] == r["doc_id"]}


def test_shards_end_and_go_on():
    docs = [(i, np.array([i % 5] * 9 + [1], dtype="<u4")) for i in range(20_000)]
    import io

    body = b"".join(token_files.pack_shard(docs))
    read = [(d, tuple(p)) for ids, counts, all_ids in token_files.read_blocks(io.BytesIO(body)) for d, p in zip(ids.tolist(), np.split(all_ids, np.cumsum(counts)[:-1]))]
    assert read == [(d, tuple(x)) for d, x in docs]


def plain_lines(rows, least):
    """Kept text, lines, dropped by row."""
    space = "[\x20\x09-\x0d]"
    key = lambda line: re.sub(f"^{space}+|{space}+$", "", line).translate({c: c + 32 for c in range(65, 91)})
    seen = Counter(k for t in rows for k in {key(x) for x in (t or "").split("\n")} - {""})
    out = []
    for t in rows:
        parts = (t or "").split("\n")
        kept = [x for x in parts if seen[key(x)] < least or key(x) == ""]
        out.append((t, len(parts), len(parts) - len(kept), "\n".join(kept)))
    return Counter(out)


@pytest.mark.parametrize("least", [1, 2, 3])
def test_lines(spark, odd, none, least):
    rows = lines.drop_common_lines(odd, min_docs=least, batches=5)
    assert set(rows.columns) == {"doc_id", "text", "lang", "source", "size", "n_lines", "n_dropped", "kept_text"}
    got = Counter((r["text"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in rows.collect())
    assert got == plain_lines([r["text"] for r in odd.collect()], least)
    assert lines.drop_common_lines(none, min_docs=least).count() == 0


def test_runs_are_compacted(spark):
    runs = lines.LineRuns(spark, 3, fanout=2, buckets=2)
    frame = lambda rows: spark.createDataFrame(rows, "h1 long, h2 long, n long")
    for batch in ([(1, 1, 1), (2, 2, 3)], [(1, 1, 1), (2, 2, 5), (3, 3, 2)], [(1, 1, 1)], [(3, 3, 1), (4, 4, 2)], [(4, 4, 0)]):
        runs.add(frame(batch))
    assert {r["h1"] for r in runs.heavy().collect()} == {1, 2, 3}
    assert sum(map(len, runs.levels)) <= 3


def test_counts_of_all_runs_are_added(spark):
    """A line that no batch has often enough alone, and one that many runs hold."""
    before = {r["tableName"] for r in spark.sql("SHOW TABLES").collect()}
    runs = lines.LineRuns(spark, 10, fanout=3, buckets=4)
    frame = spark.range(400).select((F.col("id") % 100).alias("h1"), (F.col("id") % 100 + 1).alias("h2")).groupBy("h1", "h2").agg(F.count("*").alias("n"))
    for k in range(7):
        assert runs.heavy().count() == (100 if 4 * k >= 10 else 0) if k else True
        runs.add(frame)
        assert runs.heavy().groupBy("h1", "h2").count().where("count > 1").isEmpty()
    runs.drop()
    assert {r["tableName"] for r in spark.sql("SHOW TABLES").collect()} == before


def test_lines_leave_no_tables_and_take_any_names(spark):
    before = {r["tableName"] for r in spark.sql("SHOW TABLES").collect()}
    rows = [(i, "same line\nown line %d" % i, "x", "y", "z") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __k1 string, __marks string, __kept string")
    got = lines.drop_common_lines(df, min_docs=40).collect()
    assert {r["kept_text"] for r in got} == {"own line %d" % i for i in range(40)} and got[0]["__k1"] == "x" and got[0]["__marks"] == "y"
    assert {r["tableName"] for r in spark.sql("SHOW TABLES").collect()} == before


def test_rows_of_one_id_are_split(spark, tmp_path, monkeypatch):
    """Null ids and one hot id go to several tasks and come back in order."""
    rows = [(None, f"null number {i}") for i in range(300)] + [(7, f"hot number {i}") for i in range(300)] + [(i, f"row {i}") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    contents = token_files.write_token_files(df, str(tmp_path / "hot"), WORDS, 1, tasks=6).orderBy("index").collect()
    assert len(contents) == 6 and [c["index"] for c in contents] == list(range(6)) and max(c["docs"] for c in contents) < 200
    read = token_files.read_token_files(spark, str(tmp_path / "hot")).orderBy("start").collect()
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in read]
    assert len(read) == len(rows) and ids == sorted(ids) and [c["start"] for c in contents] == [sum(c["ids"] for c in contents[:k]) for k in range(6)]
    library = Tokenizer.from_file(WORDS)
    assert Counter(tuple(r["ids"]) for r in read) == Counter(tuple([*library.encode(t, add_special_tokens=False).ids, 1]) for _, t in rows)
