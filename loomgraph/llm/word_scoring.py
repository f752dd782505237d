"""Masked pseudo-likelihood of words: each is scored from both neighbours by what all other documents say.

Tokens are words in their own letters, characters of scripts without blanks, and marks;
the vocabulary is every token of the corpus. Counts of all words and of all pairs of
neighbours in all documents are kept as a table dealt out by hash, which grows with the
corpus; no part of it comes to the driver.

With c counted in all documents but the one scored, a word w between l and r has

    P(w | l, r) = (P(w | l) + P(w | r)) / 2,    P(w | l) = (c(l, w) + WEIGHT P(w)) / (c(l) + WEIGHT)
    P(w) = (1 - u) c(w) / N + u S(w)

and P(w | r) alike. u is the share of words met once in the corpus, N the number of words
and S the spelling: the window network of scoring.py, fitted to the windows of all
documents, times the share of a character in its class. Beyond a text's ends stands a mark
that every text with words has once on each side.

1. Both passes cut the rows into the same chunks: rows that aren't plain columns of files
   are written first. A pass that meets another chunk than before raises an error.
2. Each chunk's distinct words and pairs go to the tasks of their hashes with their
   counts, as sorted blocks. There blocks are merged, and the chunk gets the sums of its
   own words and pairs back, in the order of its hashes.
3. The second pass meets each chunk again, reads its sums and scores its texts.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scoring
from .common import carried, fresh_dir, hold, let_go, prepare, quoted, written
from .scoring import WindowNetwork, symbols, windows
from .shingles import _mix
from .token_files import place, put

#: A chunk ends with the text that takes it to so many characters.
CHUNK_CHARS = 2 << 20
#: Weight, in words, of what a neighbour takes over from the words alone.
WEIGHT = 4.0
#: Stand before the first word and after the last.
START, END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)

_ALONE = "぀-ヿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff"
_WORD = re.compile(f"[{_ALONE}]|[^\\W{_ALONE}]+|[^\\w\\s]")


class _Places(dict):
    """A place for each word, in the order in which they come."""

    def __missing__(self, word: str) -> int:
        self[word] = found = len(self)
        return found

    def hashes(self) -> np.ndarray:
        return np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in self), dtype=np.uint64, count=len(self))


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text) if text else []


def _chunks(batches, column: int, most: int):
    """Number, distinct words, their places by text and (batch, from, to) parts of each
    chunk of a task's rows."""
    number, words, texts, parts, size = 0, _Places(), [], [], 0
    for batch in batches:
        start = 0
        for k, t in enumerate(batch.column(column)):
            t = t.as_py()
            found = words_of(t)
            texts.append(np.fromiter(map(words.__getitem__, found), dtype=np.int64, count=len(found)))
            size += len(t or "")
            if size >= most:
                yield number, words, texts, [*parts, (batch, start, k + 1)]
                number, words, texts, parts, size, start = number + 1, _Places(), [], [], 0, k + 1
        if start < batch.num_rows:
            parts.append((batch, start, batch.num_rows))
    if texts:
        yield number, words, texts, parts


def _pairs(hashes: np.ndarray, places: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hashes of all pairs of neighbours, one more than words in each text."""
    if not len(sizes):
        return np.zeros(0, np.uint64)
    ends = np.cumsum(sizes + 2)
    line = np.empty(int(ends[-1]), dtype=np.uint64)
    inside = np.ones(len(line), dtype=bool)
    inside[ends - 1] = inside[ends - sizes - 2] = False
    line[inside], line[ends - 1], line[ends - sizes - 2] = hashes[places], END, START
    pairs = _mix(line[:-1] * np.uint64(0x9E3779B97F4A7C15) + (line[1:] ^ np.uint64(0xC2B2AE3D27D4EB4F)))
    within = np.ones(len(pairs), dtype=bool)
    within[ends[:-1] - 1] = False
    return pairs[within]


def _joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All places, and the number of words of each text that has any."""
    return np.concatenate(texts), np.array([len(t) for t in texts if len(t)], dtype=np.int64)


def _sorted(words: _Places) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes by place, distinct hashes in order, and where each place's hash is there."""
    hashes = words.hashes()
    return (hashes, *np.unique(hashes, return_inverse=True))


def _whole(values: np.ndarray) -> bytes:
    """Counts in as many bytes as the largest needs, squeezed."""
    values = values.astype("<u8")
    width = max(1, -(-int(values.max()).bit_length() // 8)) if len(values) else 1
    return bytes([width]) + zlib.compress(values.view(np.uint8).reshape(-1, 8)[:, :width].tobytes(), 1)


def _counts(body: bytes) -> np.ndarray:
    parts = np.frombuffer(zlib.decompress(body[1:]), dtype=np.uint8).reshape(-1, body[0])
    out = np.zeros((len(parts), 8), dtype=np.uint8)
    out[:, : body[0]] = parts
    return out.view("<u8").reshape(-1)


def _packed(keys: np.ndarray) -> bytes:
    """Sorted hashes as differences, without the bytes that are zero in all."""
    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    width = max(1, -(-int(steps.max()).bit_length() // 8)) if len(steps) else 1
    return bytes([width]) + steps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpacked(body: bytes) -> np.ndarray:
    parts = np.frombuffer(body, dtype=np.uint8, offset=1).reshape(-1, body[0])
    out = np.zeros((len(parts), 8), dtype=np.uint8)
    out[:, : body[0]] = parts
    return np.cumsum(out.view("<u8").reshape(-1), dtype=np.uint64)


_ASKED = "bucket int, chunk long, texts long, words binary, word_counts binary, pairs binary, pair_counts binary"
_TOLD = "chunk long, bucket int, texts long, n long, once long, words binary, pairs binary"


def _batch(rows: list[tuple], columns: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    names, types = zip(*(c.split() for c in columns.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for v, k in zip(zip(*rows), types)], names=list(names))


def _ask(bits: int, most: int):
    def run(batches):
        hold()
        task = TaskContext.get().partitionId() << 32
        borders = (np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(0, np.uint64)
        for number, words, texts, _ in _chunks(batches, 0, most):
            places, sizes = _joined(texts)
            hashes, found, at = _sorted(words)
            made = [[task | number] * (1 << bits), [0 if b else len(sizes) for b in range(1 << bits)]]
            pairs = np.unique(_pairs(hashes, places, sizes), return_counts=True)
            for keys, counts in ((found, np.bincount(at[places], minlength=len(found))), pairs):
                cuts = [0, *np.searchsorted(keys, borders).tolist(), len(keys)]
                made.append([_packed(keys[a:b]) for a, b in zip(cuts, cuts[1:])])
                made.append([_whole(counts[a:b]) for a, b in zip(cuts, cuts[1:])])
            rows = list(zip(range(1 << bits), *made))
            for a in range(0, len(rows), 256):
                yield _batch(rows[a : a + 256], _ASKED)
        let_go()

    return run


def _sums(blocks: list[tuple[bytes, bytes]]) -> tuple[list[bytes], np.ndarray]:
    """For each block, the sums over all blocks of its keys; and the sum of each key."""
    keys = [_unpacked(k) for k, _ in blocks]
    counts = np.concatenate([_counts(c) for _, c in blocks])
    found, back = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(back, weights=counts, minlength=len(found)).astype("<u8")
    ends = np.cumsum([len(k) for k in keys])[:-1]
    return [_whole(t) for t in np.split(total[back], ends)], total


def _tell(batches):
    """Sums of each bucket, from partitions sorted by bucket and chunk."""

    def told(bucket, rows):
        words, totals = _sums([(r[3], r[4]) for r in rows])
        pairs, _ = _sums([(r[5], r[6]) for r in rows])
        out = [(None, bucket, sum(r[2] for r in rows), int(totals.sum()), int((totals == 1).sum()), None, None)]
        out += [(r[1], bucket, None, None, None, w, p) for r, w, p in zip(rows, words, pairs)]
        for a in range(0, len(out), 256):
            yield _batch(out[a : a + 256], _TOLD)

    waiting = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if waiting and row[0] != waiting[0][0]:
                yield from told(waiting[0][0], waiting)
                waiting = []
            waiting.append(row)
    if waiting:
        yield from told(waiting[0][0], waiting)


def _file(folder: str):
    """One file for each chunk, from partitions sorted by chunk and bucket."""

    def run(batches):
        waiting, chunk = [], None

        def write():
            words, pairs = (np.concatenate([_counts(r[k]) for r in waiting]) for k in (0, 1))
            put(folder, str(chunk), [_whole(np.concatenate([np.array([len(words)], "<u8"), words, pairs]))])
            return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64())], names=["chunk"])

        for batch in batches:
            for c, w, p in zip(*(x.to_pylist() for x in batch.columns)):
                if waiting and c != chunk:
                    yield write()
                    waiting = []
                chunk = c
                waiting.append((w, p))
        if waiting:
            yield write()

    return run


def _scan_only(docs: DataFrame) -> bool:
    """Columns of files as they are: two scans give the same tasks the same rows."""
    node = docs._jdf.queryExecution().optimizedPlan()
    while node.nodeName() == "Project" and node.deterministic():
        node = node.children().head()
    return node.nodeName().startswith(("LogicalRelation", "Relation"))


class CorpusCounts:
    """Where the sums of each chunk are, and what holds for all: the number of words, of
    words met once and of texts with words."""

    def __init__(self, rows: DataFrame, folder: str, most: int, words: int, once: int, texts: int):
        self.rows, self.folder, self.most, self.words, self.once, self.texts = rows, folder, most, words, once, texts


def count_words(docs: DataFrame, text: str = "text", chunk_chars: int = CHUNK_CHARS) -> CorpusCounts:
    """Counts of all words and pairs of neighbours in all whole texts."""
    spark = docs.sparkSession
    prepare(spark)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = max(0, tasks - 1).bit_length()
    rows = docs if _scan_only(docs) else written(docs, "lm-rows")
    asked = rows.select(quoted(text)).mapInArrow(_ask(bits, chunk_chars), _ASKED)
    told = asked.repartition(tasks, "bucket").sortWithinPartitions("bucket", "chunk").mapInArrow(_tell, _TOLD)
    told = written(told, "lm-sums")
    whole = told.where("chunk is null").agg(F.sum("n"), F.sum("once"), F.sum("texts")).first()
    folder = fresh_dir(spark, "lm-chunks")
    files, path = place(folder)
    files.create_dir(path)
    replies = told.where("chunk is not null").select("chunk", "bucket", "words", "pairs").repartition(tasks, "chunk").sortWithinPartitions("chunk", "bucket").drop("bucket")
    replies.mapInArrow(_file(folder), "chunk long").count()
    return CorpusCounts(rows, folder, chunk_chars, *(x or 0 for x in whole))


_log_share = None


def spelled(words: list[str], network: WindowNetwork) -> np.ndarray:
    """Log-probabilities of the words' characters and of the blank after each."""
    global _log_share
    if _log_share is None:
        symbols("")
        sizes = np.bincount(scoring._table, minlength=scoring.SYMBOLS)
        sizes[scoring.MARK] += 0x110000 - 0x10000
        _log_share = -np.log(np.maximum(1, sizes))
        _log_share[[scoring.BLANK, scoring.LINE]] = 0
    if not words:
        return np.zeros(0)
    tokens = symbols("  " + "   ".join(words) + "   ")  # a window is two wide
    logs = network.window_logs(windows(tokens)) + _log_share[tokens]
    lengths = np.array([len(w) for w in words])
    starts = 2 + np.concatenate([[0], np.cumsum(lengths + 3)[:-1]])
    return np.add.reduceat(logs, np.stack([starts, starts + lengths + 1], axis=1).reshape(-1))[::2]


def _own(places: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """How often each one stands in its own text."""
    _, back, times = np.unique(owner * n + places, return_inverse=True, return_counts=True)
    return times[back]


def _scored(distinct: _Places, texts, network, totals, words, once, n_texts) -> list[float]:
    places, sizes = _joined(texts)
    if not len(sizes):
        return [0.0] * len(texts)
    hashes, found, at = _sorted(distinct)
    found_pairs, at_pair = np.unique(_pairs(hashes, places, sizes), return_inverse=True)
    n = int(totals[0])
    if n != len(found) or len(totals) - 1 - n != len(found_pairs):
        raise RuntimeError("the rows came in another order than before")
    owner = np.repeat(np.arange(len(sizes)), sizes)
    own = totals[1 : 1 + n][at[places]].astype(np.int64) - _own(places, owner, len(hashes))
    both = totals[1 + n :][at_pair].astype(np.int64) - _own(at_pair, np.repeat(np.arange(len(sizes)), sizes + 1), len(found_pairs))
    spelling = spelled(list(distinct), network)[places]
    ends = np.cumsum(sizes)
    left, right = np.append(0, own[:-1]), np.append(own[1:], 0)
    left[ends - sizes] = right[ends - 1] = n_texts - 1
    before = np.arange(len(places)) + owner
    rest = (words - sizes)[owner]
    u = np.where(rest > 0, (once + 1) / (words + 2), 1.0)
    alone = (1 - u) * own / np.maximum(1, rest)
    back = 0.5 * (WEIGHT / (left + WEIGHT) + WEIGHT / (right + WEIGHT))
    seen = 0.5 * (both[before] / (left + WEIGHT) + both[before + 1] / (right + WEIGHT)) + back * alone
    with np.errstate(divide="ignore"):
        logs = np.logaddexp(np.log(seen), np.log(back * u) + spelling)
    sums = iter([float(logs[a:b].sum()) for a, b in zip((ends - sizes).tolist(), ends.tolist())])
    return [next(sums) if len(t) else 0.0 for t in texts]


def score_words(docs: DataFrame, network: WindowNetwork, text: str = "text", chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """docs with n_tokens, log_likelihood (summed over all words of the whole text) and
    mean_log_likelihood (null without words), each text against all others. Null and
    empty texts score 0; texts of any length are scored whole (a chunk ends with the text
    that takes it over its size); repeated rows score alike, each seeing the others; an
    empty table gives an empty one; columns of these names give way, others may have any."""
    spark = docs.sparkSession
    counts = count_words(docs, text, chunk_chars)
    made = ["n_tokens", "log_likelihood", "mean_log_likelihood"]
    keep = carried(docs, made)
    rest = [c for c in keep if c != text]
    kinds = dict(docs.dtypes)
    shared = spark.sparkContext.broadcast(network)  # a few thousand weights
    folder, most, whole = counts.folder, counts.most, (counts.words, counts.once, counts.texts)
    names = [*rest, *made[:2], *([text] if text in keep else [])]

    def run(batches):
        hold()
        files, path = place(folder)
        task = TaskContext.get().partitionId() << 32
        for number, words, texts, parts in _chunks(batches, len(rest), most):
            with files.open_input_stream(f"{path}/{task | number}") as file:
                totals = _counts(file.read())
            total, at = _scored(words, texts, shared.value, totals, *whole), 0
            for batch, a, b in parts:
                columns = batch.slice(a, b - a).columns
                here = slice(at, at + b - a)
                at += b - a
                values = [pa.array([len(t) for t in texts[here]], pa.int64()), pa.array(total[here], pa.float64())]
                yield pa.RecordBatch.from_arrays([*columns[: len(rest)], *values, *(columns[len(rest) :] if text in keep else [])], names=names)
        let_go()

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in rest), "n_tokens long", "log_likelihood double", *([f"`{text}` string"] if text in keep else [])])
    rows = counts.rows.select(*[quoted(c) for c in rest], quoted(text)).mapInArrow(run, schema)
    mean = F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens"))
    return rows.withColumn("mean_log_likelihood", mean).select(*[quoted(c) for c in keep], *made)
