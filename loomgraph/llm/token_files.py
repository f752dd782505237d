"""Token-id files: frequency-ranked ids in byte-aligned variable length.

A shard holds documents in ascending order of their ids. Its ids are replaced by
their ranks in the order of frequency in the shard, so frequent ids take one byte and
the next 65,280 two. The bytes lie apart from their lengths:

    magic b"LGT1", uint32 distinct ids, uint32 ids by rank
    blocks: uint32 documents, uint32 ids, uint32 data bytes,
            int64 document ids (null: the least long), uint32 ids of each document,
            control bytes (two bits an id, its length less 1; low bits first),
            data bytes (little endian)

All integers are little endian. The table of shards, with the number of ids before
each, lies beside them.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_dir, hold, let_go, prepare, quoted, release, written

MAGIC = b"LGT1"
NO_ID = -(1 << 63)
#: A block ends with the document that takes it to so many ids, and so does a shard.
BLOCK_IDS, SHARD_IDS = 1 << 16, 1 << 24
#: Words and parts of words that are remembered, up to this length.
WORDS, PARTS, WORD_MOST = 1_000_000, 600_000, 40

_SHIFTS = np.arange(0, 8, 2, dtype=np.uint8)
#: For each control byte, the lengths of its four ids.
LENGTHS = (((np.arange(256, dtype=np.uint16)[:, None] >> _SHIFTS) & 3) + 1).astype(np.uint8)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    values = np.ascontiguousarray(values, dtype="<u4")
    length = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    codes = np.zeros(-(-len(values) // 4) * 4, dtype=np.uint8)
    codes[: len(values)] = length - 1
    control = (codes.reshape(-1, 4) << _SHIFTS).sum(axis=1, dtype=np.uint8)
    used = np.arange(4) < length[:, None]
    return control.tobytes(), values.view(np.uint8).reshape(-1, 4)[used].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values; lengths come from a table by control byte."""
    length = LENGTHS[np.frombuffer(control, dtype=np.uint8)].reshape(-1)[:n]
    out = np.zeros((n, 4), dtype=np.uint8)
    out[np.arange(4) < length[:, None]] = np.frombuffer(data, dtype=np.uint8)
    return out.view("<u4").reshape(-1)


def pack_block(docs: list[tuple[int | None, np.ndarray]]) -> bytes:
    ranks = np.concatenate([r for _, r in docs]) if docs else np.zeros(0, dtype="<u4")
    control, data = pack(ranks)
    head = np.array([len(docs), len(ranks), len(data)], dtype="<u4").tobytes()
    ids = np.array([NO_ID if d is None else d for d, _ in docs], dtype="<i8").tobytes()
    return head + ids + np.array([len(r) for _, r in docs], dtype="<u4").tobytes() + control + data


def pack_shard(docs: list[tuple[int | None, np.ndarray]]) -> Iterator[bytes]:
    """A shard's file, part by part, of documents and their ids."""
    counts = np.zeros(1 + max(int(ids.max()) for _, ids in docs), dtype=np.int64)
    for _, ids in docs:
        counts += np.bincount(ids, minlength=len(counts))
    used = int((counts > 0).sum())
    order = np.argsort(-counts, kind="stable")[:used].astype("<u4")
    rank = np.zeros(len(counts), dtype="<u4")
    rank[order] = np.arange(used, dtype="<u4")
    yield MAGIC + np.array([used], dtype="<u4").tobytes() + order.tobytes()
    waiting, n = [], 0
    for doc, ids in docs:
        waiting.append((doc, rank[ids]))
        n += len(ids)
        if n >= BLOCK_IDS:
            yield pack_block(waiting)
            waiting, n = [], 0
    if waiting:
        yield pack_block(waiting)


def read_blocks(stream) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Document ids, number of ids of each, and the ids of all; block by block."""
    if stream.read(4) != MAGIC:
        raise ValueError("not a token file")
    (used,) = np.frombuffer(stream.read(4), dtype="<u4").tolist()
    order = np.frombuffer(stream.read(4 * used), dtype="<u4")
    while head := stream.read(12):
        n_docs, n_ids, n_data = np.frombuffer(head, dtype="<u4").tolist()
        docs = np.frombuffer(stream.read(8 * n_docs), dtype="<i8")
        counts = np.frombuffer(stream.read(4 * n_docs), dtype="<u4")
        control = stream.read(-(-n_ids // 4))
        yield docs, counts, order[unpack(control, stream.read(n_data), n_ids)]


def place(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:/") else f"file://{path}")


def put(path: str, name: str, body) -> None:
    """Write a file whole or not at all: under a name of its own, then renamed."""
    files, folder = place(path)
    part = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with files.open_output_stream(part) as out:
        for chunk in body:
            out.write(chunk)
    files.move(part, f"{folder}/{name}")


#: Characters whose lower case and normal form stand for themselves, in the pattern's classes.
_PLAIN = frozenset(map(chr, [*range(33, 127), *(c for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))]))
_LETTERS = "a-z\xdf-\xf6\xf8-\xff"
_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9]+")


def _byte_letters() -> dict[int, str]:
    """For each plain character beyond ASCII, its bytes in the byte-level alphabet:
    bytes that print stand for themselves, the others for 256 and on, in order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    letter = {b: chr(b) if b in shown else chr(next(hidden)) for b in range(256)}
    return {ord(c): "".join(letter[b] for b in c.encode()) for c in _PLAIN if not c.isascii()}


_BYTES = _byte_letters()


class _Tokens(dict):
    """Ids, as bytes, of lower-case parts that the tokenizer's pattern doesn't cut;
    they need its merges only."""

    def __init__(self, tokenizer):
        super().__init__()
        self.merges = tokenizer.model.tokenize

    def __missing__(self, part: str) -> bytes:
        ids = array("I", [t.id for t in self.merges(part if part.isascii() else part.translate(_BYTES))]).tobytes()
        if len(part) <= WORD_MOST:
            if len(self) >= PARTS:
                self.clear()
            self[part] = ids
        return ids


class _Words(dict):
    """Ids of words between white space, as bytes. A word of plain characters is cut
    as the tokenizer's pattern does, so its parts can be looked up, too; any other
    word goes to the tokenizer whole."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.tokens = tokenizer, _Tokens(tokenizer)

    def __missing__(self, word: str) -> bytes:
        tokens = self.tokens
        if not _PLAIN.issuperset(word) or "<|" in word:
            return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()
        low = word.lower()
        if low.isalpha():
            ids = tokens[low]
        elif low[:-1].isalpha():
            ids = tokens[low[:-1]] + tokens[low[-1]]
        else:
            ids = b"".join(map(tokens.__getitem__, _PARTS.findall(low)))
        if len(word) <= WORD_MOST:
            if len(self) >= WORDS:
                self.clear()
            self[word] = ids
        return ids


class WordCoder:
    """Whole texts through the tokenizers library, by word.

    White space is dropped by the tokenizer, nothing in it reaches across, so a text's
    ids are those of its words one after the other; words met before are looked up.
    `splits` tells whether the tokenizer is of that kind; others get the whole text."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        steps = (spec.get("normalizer") or {}).get("normalizers", [])
        cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.splits = (
            [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"]
            and [c["type"] for c in cuts] == ["Split", "ByteLevel"]
            and cuts[0]["behavior"] == "Removed"
            and cuts[0]["pattern"]["Regex"].endswith("|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+")
            and not any(any(map(str.isspace, t["content"])) or t["single_word"] for t in spec["added_tokens"])
        )
        self.words = _Words(self.tokenizer)

    def encode(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not text:
            return b""
        if not self.splits:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return b"".join(map(self.words.__getitem__, self.cut(text)))

    def cut(self, text: str) -> list[str]:
        return text.split(" ") if _KEPT.search(text) else text.split()


#: str.split() also cuts at these, which the tokenizer keeps.
_KEPT = re.compile("[\x1c-\x1f]")

_loaded: dict[str, WordCoder] = {}


def coder(path: str) -> WordCoder:
    if path not in _loaded:
        _loaded[path] = WordCoder(path)
    return _loaded[path]


CONTENTS = "name string, task int, place long, docs long, ids long"


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text: str = "text", tasks: int | None = None
) -> DataFrame:
    """Encode every whole text (null: empty), append end_id, write shards under path.

    Documents lie in ascending order of id (null first; equal ids by text hash), each
    row its own document; texts of any length are whole. An empty table gives a table of
    contents without shards. Texts are dealt out by range of id and text hash, so the rows
    of one id (or of none) are split, too; only rows that are alike stay together. A task
    encodes its range and writes a shard whenever SHARD_IDS ids have come together, so its
    memory is bounded by that and one document. A shard is written under a name of its own
    and renamed; the table of contents (files in path/contents) names the shards of the
    tasks that count, so a task that runs twice does no harm. Returns that table: index,
    name, start, docs, ids, one row for each file. One number for each task comes to the
    driver."""
    spark = docs.sparkSession
    prepare(spark)
    files, folder = place(path)
    files.create_dir(folder, recursive=True)
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(quoted(id_col).cast("long").alias("id"), quoted(text).alias("text"), F.xxhash64(quoted(text)).alias("hash"))
    order = [F.col("id").asc_nulls_first(), F.col("hash")]
    rows = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order).select("id", "text")

    def write(batches):
        words, end = coder(tokenizer), np.array([end_id], dtype="<u4").tobytes()
        hold(words.words, words.words.tokens)
        task, waiting, n, place_in_task = TaskContext.get().partitionId(), [], 0, 0

        def shard():
            nonlocal waiting, n, place_in_task
            name = f"shard-{uuid.uuid4().hex}.lgt"
            put(path, name, pack_shard(waiting))
            made = {"name": name, "task": task, "place": place_in_task, "docs": len(waiting), "ids": n}
            waiting, n, place_in_task = [], 0, place_in_task + 1
            return pa.RecordBatch.from_pylist([made], schema=_CONTENTS)

        for batch in batches:
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.frombuffer(words.encode(t.as_py()) + end, dtype="<u4")
                waiting.append((doc, ids))
                n += len(ids)
                if n >= SHARD_IDS:
                    yield shard()
        if waiting:
            yield shard()
        let_go()

    made = written(rows.mapInArrow(write, CONTENTS), "token-shards")
    # Ranges are in order of their tasks' numbers.
    before, ids, shards = [], 0, 0
    for r in made.groupBy("task").agg(F.sum("ids").alias("ids"), F.count("*").alias("n")).orderBy("task").collect():
        before.append((r["task"], ids, shards))
        ids, shards = ids + r["ids"], shards + r["n"]
    inside = Window.partitionBy("task").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    starts = F.broadcast(spark.createDataFrame(before, "task int, ids_before long, shards_before long"))
    contents = made.join(starts, "task").select(
        (F.col("shards_before") + F.col("place")).alias("index"), "name", (F.col("ids_before") + F.coalesce(F.sum("ids").over(inside), F.lit(0))).alias("start"), "docs", "ids"
    )
    contents.write.parquet(f"{path}/contents")
    release(made)
    return spark.read.schema(contents.schema).parquet(f"{path}/contents")


_CONTENTS = pa.schema([("name", pa.string()), ("task", pa.int32()), ("place", pa.int64()), ("docs", pa.int64()), ("ids", pa.int64())])


def read_token_files(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """Documents of the shards: doc_id, start (ids before it in all shards), n_tokens,
    and ids (array) or, with digest=True, ids_crc32. Shards are dealt out evenly by their
    index to as many tasks as shuffles have, and read block by block."""
    prepare(spark)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    contents = spark.read.schema("index long, name string, start long, docs long, ids long").parquet(f"{path}/contents")

    def run(batches):
        files, folder = place(path)
        for batch in batches:
            for shard in batch.to_pylist():
                start = shard["start"]
                with files.open_input_stream(f"{folder}/{shard['name']}", buffer_size=1 << 20) as f:
                    for docs, counts, ids in read_blocks(f):
                        ends = np.cumsum(counts, dtype=np.int64)
                        starts = ends - counts
                        parts = [ids[a:b] for a, b in zip(starts, ends)]
                        last = pa.array([zlib.crc32(p) for p in parts], pa.int64()) if digest else pa.array([p.astype(np.int64) for p in parts], pa.list_(pa.int64()))
                        columns = [pa.array([None if d == NO_ID else d for d in docs.tolist()], pa.int64()), pa.array(starts + start), pa.array(counts.astype(np.int64)), last]
                        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])
                        start += int(ends[-1]) if len(ends) else 0

    schema = "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digest else "ids array<long>")
    return contents.repartitionById(tasks, F.pmod("index", F.lit(tasks)).cast("int")).select("name", "start").mapInArrow(run, schema)


def token_file_rows(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    path = fresh_dir(docs.sparkSession, "tokens")
    write_token_files(docs, path, tokenizer, end_id)
    return read_token_files(docs.sparkSession, path, digest=True)
