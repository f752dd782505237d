"""N-gram Jaccard join: rare-first prefixes, length, positional and suffix filters.

Whatever the data, the result is exact (up to collisions of 64-bit hashes): every filter
only drops pairs that can't reach the threshold.

1. One pass makes each text's set of hashed n-grams. Equal sets (64-bit digests) are one
   class, represented by its least document id. The same pass counts n-gram frequencies over all documents
   in a table of 2**TABLE_BITS counters. Logarithms of these counts and then the hash
   order all n-grams, rare first. Any order gives right results; the table only has to
   tell the frequent ones. Its size is fixed.
2. For each class: the set's size, its first size - ceil(t * size) + 1 n-grams in that
   order (two sets that link share one of them), with their positions, and how many
   n-grams fall into each of 64 parts of the hash space.
3. Classes that share a prefix n-gram are members of the family of the n-gram's least
   class. Joined on prefix n-grams, each member meets that class, and the length filter
   and the positional filter are applied in the join: one row for each pair that passes.
4. Each such pair of a family's first class and a member is compared by its counts by part,
   then, if these leave it, by its sets: prefix, positional and suffix filter, then the
   intersection. A family of m classes takes m comparisons, and each set that is still
   in question travels once for each family.
5. A family whose other members hang together after that is done, for only what is connected
   counts, not by how many links.
6. Members of a family that are in different components are compared in block pairs: by
   length and counts by part, then what is left by sets, once for each pair and not
   within a component. Only a spanning forest of the links leaves a task, never the pairs.

So that little lies on disk at a time, what is dealt out most (prefix n-grams, sets) goes in
rounds, each a share of the input's n-grams, and only texts that are in question move.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, hold, let_go, prepare, quoted, release, spare, written
from .components import components, local_roots

TABLE_BITS, CHUNK_BITS = 22, 16
PARTS = 64
#: What a part's count can say; a set with a larger one says so in every part.
PART_MOST = 0xFFFF
#: Members, and n-grams on average, of a family's block. A task holds two blocks.
BLOCK, BLOCK_GRAMS = 512, 1 << 20
#: Members that are compared with one class in one group.
STAR = 128
#: A round deals out at most a ROUND_SHARE-th of the input's n-grams, or ROUND_GRAMS if that is
#: more. Prefixes go in at most PREFIX_ROUNDS, for each reads all of them.
ROUND_GRAMS, ROUND_SHARE, PREFIX_ROUNDS = 1 << 25, 4, 4
#: Bits of the mask of ids, in rows of 2**MASK_ROW bits (those that bitmap_construct_agg makes).
MASK_BITS, MASK_ROW = 25, 15
MEMORY, WORD_MOST = 200_000, 60

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= WORD_MOST:
            if len(self) >= MEMORY:
                self.clear()
            self[word] = h
        return h


_words = _Words()
_lower = bytes.maketrans(UPPER.encode(), LOWER.encode())


def words_of(text: str) -> list[bytes]:
    """A-Z lower-cased, split at blanks and the control characters 9 to 13 (as bytes.split does)."""
    return text.encode("utf-8", "surrogatepass").translate(_lower).split()


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def shingle_set(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the text's n-grams of words (fewer words: of them all)."""
    words = words_of(text) if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))
    if len(h) < n:
        # Another multiplier for each length: a short text is no n-gram of a longer one.
        out = np.array([len(h)], dtype=np.uint64)  # an array, so that products wrap around
        for k in range(len(h)):
            out = _mix(out * _ODD[0] + h[k : k + 1])
        return out
    out = np.zeros(len(h) - n + 1, dtype=np.uint64)
    for k in range(n):
        out = out * _ODD[0] + (h[k : len(h) - n + 1 + k] ^ _ODD[1 + k % 4])
        if k % 2:
            out ^= out >> np.uint64(29)
    out = _mix(out)
    out.sort()
    return out[np.append(True, out[1:] != out[:-1])]


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def ordered(shingles: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Rare first: by the table's code, then by hash (shingles come sorted by it)."""
    code = codes[(shingles >> np.uint64(64 - TABLE_BITS)).view(np.int64)]
    return shingles[np.argsort(code, kind="stable")]


def parts_of(shingles: np.ndarray) -> bytes:
    """How many fall into each part, as unsigned 16-bit. A set too large for that says
    PART_MOST in every part; two such sets always pass the suffix filter."""
    parts = np.bincount((shingles & np.uint64(PARTS - 1)).view(np.int64), minlength=PARTS)
    if parts.max() > PART_MOST:
        parts[:] = PART_MOST
    return parts.astype("<u2").tobytes()


def digest_of(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def _first_pass(n: int):
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("f", pa.int64()), ("chunk", pa.int32()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold(_words)
        table = np.zeros(1 << TABLE_BITS, dtype=np.int64)
        for batch in batches:
            hashes = [shingle_set(t.as_py(), n) for t in batch.column(1)]
            if hashes:
                places = (np.concatenate(hashes) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
                if len(places) > len(table) // 8:
                    table += np.bincount(places, minlength=len(table))
                else:
                    where, times = np.unique(places, return_counts=True)
                    table[where] += times
            rows = len(hashes)
            columns = [batch.column(0), pa.array([len(s) for s in hashes], pa.int64()), pa.array(map(digest_of, hashes), pa.int64()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)
        for chunk in range(1 << (TABLE_BITS - CHUNK_BITS)):
            part = table[chunk << CHUNK_BITS : (chunk + 1) << CHUNK_BITS]
            if part.any():
                # One task's share is held at 255; the order needs no more.
                body = zlib.compress(np.minimum(part, 255).astype(np.uint8).tobytes(), 1)
                yield pa.RecordBatch.from_pylist([{"chunk": chunk, "counts": body}], schema=schema)
        del table
        let_go()

    return run


def _add_chunks(batches):
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            part = np.frombuffer(zlib.decompress(body), dtype=np.uint8).astype(np.int64)
            sums[chunk] = sums[chunk] + part if chunk in sums else part
    for chunk, part in sums.items():
        # Steps of 9 %: where unique n-grams fill the counters, what is a little above them counts.
        codes = np.minimum(np.floor(8 * np.log2(1 + part)), 255).astype(np.uint8)
        yield pa.RecordBatch.from_pylist([{"chunk": chunk, "codes": zlib.compress(codes.tobytes())}], schema=pa.schema([("chunk", pa.int32()), ("codes", pa.binary())]))


def _prefixes(shared, n: int, percent: int):
    """Of (id, text): id, the set's digest and size, its prefix and its counts by part."""

    def run(batches):
        hold(_words)
        codes = np.frombuffer(shared.value, dtype=np.uint8)
        for batch in batches:
            sets = [shingle_set(t.as_py(), n) for t in batch.column(1)]
            prefixes = [ordered(s, codes)[: prefix_size(len(s), percent)].view(np.int64) for s in sets]
            columns = [batch.column(0), pa.array(map(digest_of, sets), pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(map(parts_of, sets), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "f", "n", "prefix", "parts"])
        let_go()

    return run


def _sets(shared, n: int, names: list[str]):
    """Of (id, f, text, names...), sorted by id: id, size, counts by part and n-grams, rare
    first, of each row whose text's set has the digest f, and the named columns. A set is made once
    for all rows of its text in a row; other texts of the id have other digests."""

    def run(batches):
        hold(_words)
        codes, last, made = np.frombuffer(shared.value, dtype=np.uint8), None, {}
        for batch in batches:
            rows, out = [], []
            for k, (i, f, t) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2))):
                if i != last:
                    last, made = i, {}
                t = t.as_py()
                if t not in made:
                    s = shingle_set(t, n)
                    made[t] = digest_of(s), len(s), parts_of(s), ordered(s, codes).astype("<u8").tobytes()
                if made[t][0] == f:
                    rows.append(k)
                    out.append(made[t][1:])
            take = pa.array(rows, pa.int64())
            size, parts, body = zip(*out) if out else ((), (), ())
            columns = [batch.column(0).take(take), pa.array(size, pa.int32()), pa.array(parts, pa.binary()), pa.array(body, pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, *(batch.column(3 + j).take(take) for j in range(len(names)))], names=["id", "n", "parts", "grams", *names])
        let_go()

    return run


class _Set:
    """A set for comparisons: its n-grams rare first, the prefix's positions and the
    counts by part."""

    __slots__ = ("n", "grams", "place", "parts")

    def __init__(self, parts: bytes, grams: bytes, percent: int):
        self.grams = np.frombuffer(grams, dtype="<u8")
        self.n = len(self.grams)
        self.place = {h: p for p, h in enumerate(self.grams[: prefix_size(self.n, percent)].tolist())}
        self.parts = np.frombuffer(parts, dtype="<u2").astype(np.int64)

    def rest(self, p: int) -> np.ndarray | None:
        """Counts by part of what comes after position p; None if they aren't known."""
        if self.parts[0] == PART_MOST:
            return None
        return self.parts - np.bincount((self.grams[: p + 1] & np.uint64(PARTS - 1)).view(np.int64), minlength=PARTS)


def may_link(a: _Set, b: _Set, percent: int) -> bool:
    """Length, prefix, positional and suffix filter: false only if a and b can't link."""
    if 100 * min(a.n, b.n) < percent * max(a.n, b.n):
        return False
    need = -(-percent * (a.n + b.n) // (100 + percent))  # 100 * o >= percent * (a + b - o)
    if len(a.place) > len(b.place):
        a, b = b, a
    for h, p in a.place.items():
        q = b.place.get(h)
        if q is not None:
            # The first n-gram that both have: nothing before it is shared.
            if min(a.n - p, b.n - q) < need:
                return False
            left, right = a.rest(p), b.rest(q)
            # N-grams in different parts of the hash space can't be shared.
            return left is None or right is None or 1 + int(np.minimum(left, right).sum()) >= need
    return False


def links(a: _Set, b: _Set, percent: int) -> bool:
    if not may_link(a, b, percent):
        return False
    o = len(np.intersect1d(a.grams, b.grams, assume_unique=True))
    return 100 * o >= percent * (a.n + b.n - o)


def _stars(columns, made, keep):
    """Pairs (pivot, id) that `keep` two things made of their rows' columns, from partitions
    sorted by pivot and block and with the pivot's own rows (one, if ids are unique) first.
    They and one batch are held."""

    def found(batches):
        key, own = None, []
        for batch in batches:
            names = ("pivot", "block", "id", *columns)
            values = (batch.column(batch.schema.get_field_index(c)) for c in names)
            for p, block, i, *rest in zip(*(v.to_pylist() if c not in ("parts", "grams") else v for c, v in zip(names, values))):
                if (p, block) != key:
                    key, own = (p, block), []
                it = made(*(r.as_py() if isinstance(r, pa.Scalar) else r for r in rest))
                if i == p:
                    own.append(it)
                elif any(keep(x, it) for x in own):
                    yield p, i

    return lambda batches: _batches(found(batches), ["a", "b"])


def _by_parts(percent: int):
    """_stars by sizes and counts by part."""

    def keep(x, y):
        need = -(-percent * (x[0] + y[0]) // (100 + percent))
        large = x[1][0] == PART_MOST and y[1][0] == PART_MOST
        return 100 * min(x[0], y[0]) >= percent * max(x[0], y[0]) and (large or int(np.minimum(x[1], y[1]).sum()) >= need)

    return _stars(("n", "parts"), lambda n, parts: (n, np.frombuffer(parts, dtype="<u2").astype(np.int64)), keep)


def _by_sets(percent: int):
    return _stars(("parts", "grams"), lambda parts, grams: _Set(parts, grams, percent), lambda x, y: links(x, y, percent))


def _pairs(sizes, parts, component, sides, percent):
    """Index arrays of the pairs of a block pair that may link by length and by what their
    sets have in each part, and aren't connected yet. sides tell two blocks apart where
    two meet (then only pairs across count)."""
    m = len(sizes)
    ok = np.triu(np.ones((m, m), dtype=bool), 1)
    if sides.any():
        ok &= sides[:, None] != sides[None, :]
    ok &= component[:, None] != component[None, :]
    ok &= 100 * np.minimum(sizes[:, None], sizes[None, :]) >= percent * np.maximum(sizes[:, None], sizes[None, :])
    i, j = np.nonzero(ok)
    # 100 * o >= percent * (a + b - o)
    need = -(-percent * (sizes[i] + sizes[j]) // (100 + percent))
    keep = np.zeros(len(i), dtype=bool)
    # One such set with one that isn't: the sum is the other's size, which is no less than need.
    large = (parts >= PART_MOST).all(axis=1)
    for a in range(0, len(i), 1 << 14):
        part = slice(a, a + (1 << 14))
        # N-grams in different parts of the hash space can't be shared.
        keep[part] = large[i[part]] & large[j[part]] | (np.minimum(parts[i[part]], parts[j[part]]).sum(axis=1) >= need[part])
    return i[keep], j[keep]


def _runs(batches, columns):
    """Rows, with the columns, of each (family, x, y), from partitions sorted by them, over batch borders."""
    waiting, key = [], None
    for batch in batches:
        lists = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns]
        keys = list(zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("family", "x", "y"))))
        for k, row in zip(keys, zip(*lists)):
            if k != key:
                if waiting:
                    yield key, waiting
                waiting, key = [], k
            waiting.append(row)
    if waiting:
        yield key, waiting


def _block(rows, x, at):
    """Sizes, parts, components and sides of a block pair's rows; at: their columns."""
    sizes = np.array([r[at[1]] for r in rows], dtype=np.int64)
    parts = np.array([np.frombuffer(r[at[2]], dtype="<u2") for r in rows]).astype(np.int32)
    return sizes, parts, np.array([r[at[3]] for r in rows], dtype=np.int64), np.array([r[at[0]] != x for r in rows])


def _batches(rows, names):
    """Tuples of longs as record batches of bounded size."""
    out = []
    for r in rows:
        out.append(r)
        if len(out) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=names)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=names)


def _own(names, families, i, j, family):
    """Which of the pairs (i, j) are this family's. A pair that meets in several families is
    left to the least of them; one of which one is the first class of the other's family
    has been compared."""
    # If the family is the least one of either's, it is the least that both have.
    first = np.array([min(f) == family for f in families], dtype=bool)
    heads = set().union(*families).intersection(names)
    head = np.array([n in heads for n in names], dtype=bool)
    keep, sets = np.ones(len(i), dtype=bool), {}
    for k in np.flatnonzero(~(first[i] | first[j]) | head[i] | head[j]).tolist():
        a, b = int(i[k]), int(j[k])
        for e in (a, b):
            if e not in sets:
                sets[e] = set(families[e])
        keep[k] = names[a] not in sets[b] and names[b] not in sets[a] and min(sets[a] & sets[b]) == family
    return keep


def _filter(percent: int):
    def left(batches):
        for (family, x, _), rows in _runs(batches, ["id", "block", "n", "parts", "component", "families"]):
            if len(rows) > 1:
                i, j = _pairs(*_block(rows, x, (1, 2, 3, 4)), percent)
                own = _own([r[0] for r in rows], [r[5] for r in rows], i, j, family)
                for k in {*i[own].tolist(), *j[own].tolist()}:
                    yield family, rows[k][0]

    return lambda batches: _batches(left(batches), ["family", "id"])


def _overlaps(sets: dict[int, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs (i, j)."""
    used, back = np.unique(np.concatenate([i, j]), return_inverse=True)
    i, j = back[: len(i)], back[len(i) :]
    chosen = [sets[u] for u in used]
    if len(i) <= 8:
        return np.array([len(np.intersect1d(chosen[a], chosen[b], assume_unique=True)) for a, b in zip(i, j)], dtype=np.int64)
    whole = np.concatenate(chosen)
    owner = np.repeat(np.arange(len(chosen)), [len(s) for s in chosen])
    values, place, times = np.unique(whole, return_inverse=True, return_counts=True)
    shared = times[place] > 1
    new = np.cumsum(times > 1) - 1
    place, owner, width = new[place[shared]], owner[shared], int((times > 1).sum())
    total = np.zeros((len(chosen), len(chosen)), dtype=np.float32)
    for a in range(0, width, 1 << 13):
        inside = (place >= a) & (place < a + (1 << 13))
        grid = np.zeros((len(chosen), min(1 << 13, width - a)), dtype=np.float32)
        grid[owner[inside], place[inside] - a] = 1
        total += grid @ grid.T
    return np.rint(total[i, j]).astype(np.int64)


def _verify(percent: int):
    def found(batches):
        for (family, x, _), rows in _runs(batches, ["id", "block", "n", "parts", "component", "families", "grams"]):
            if len(rows) < 2:
                continue
            sizes, parts, component, sides = _block(rows, x, (1, 2, 3, 4))
            i, j = _pairs(sizes, parts, component, sides, percent)
            names = [r[0] for r in rows]
            own = _own(names, [r[5] for r in rows], i, j, family)
            i, j = i[own], j[own]
            sets = {k: _Set(rows[k][3], rows[k][6], percent) for k in {*i.tolist(), *j.tolist()}}
            keep = np.array([may_link(sets[a], sets[b], percent) for a, b in zip(i.tolist(), j.tolist())], dtype=bool)
            i, j = i[keep], j[keep]
            if not len(i):
                continue
            o = _overlaps({k: v.grams for k, v in sets.items()}, i, j)
            linked = 100 * o >= percent * (sizes[i] + sizes[j] - o)
            root = local_roots(len(rows), i[linked], j[linked])
            for k, r in enumerate(root.tolist()):
                if r != k:
                    yield names[k], names[r]

    return lambda batches: _batches(found(batches), ["a", "b"])


def _blocked(members: DataFrame) -> DataFrame:
    """members (family, id, n) once for each pair (x, y) of blocks of the family that they
    are in: family, id, block, x, y."""
    sizes = members.groupBy("family").agg(F.count("*").alias("members"), F.sum("n").alias("grams_")).where("members > 1")
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("grams_") / BLOCK_GRAMS)).cast("int")
    rows = members.drop("n").join(sizes, "family").withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int"))
    rows = rows.select("family", "id", "block", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    return rows.select("family", "id", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))


def _together(rows: DataFrame, n_parts: int) -> DataFrame:
    return rows.repartition(n_parts, "family", "x", "y").sortWithinPartitions("family", "x", "y")


def _starred(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) as rows pivot, block, id: each b meets its a once, and a goes to each
    group of at most STAR (on average) of its pairs."""
    pairs = pairs.toDF("pivot", "id")
    sizes = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / STAR).cast("int").alias("blocks"))
    others = pairs.join(sizes, "pivot").select("pivot", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), "id")
    pivots = sizes.select("pivot", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("pivot").alias("id"))
    return others.unionByName(pivots)


def _around(rows: DataFrame, n_parts: int) -> DataFrame:
    return rows.repartition(n_parts, "pivot", "block").sortWithinPartitions("pivot", "block", F.col("id") != F.col("pivot"))


def _wanted(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """rows without most of those whose id isn't among the ids, told by a mask of 2**MASK_BITS
    bits that goes to all tasks. No wanted row is lost; a join tells the rest."""
    place = F.pmod(F.xxhash64(F.lit(31), F.col("id")), F.lit(1 << MASK_BITS))
    row, bit = F.shiftright(place, MASK_ROW).cast("int"), place.bitwiseAND(F.lit((1 << MASK_ROW) - 1))
    mask = ids.where("id is not null").select(row.alias("row_"), bit.alias("bit_")).groupBy("row_").agg(F.bitmap_construct_agg("bit_").alias("mask_"))
    rows_ = rows.select("*", row.alias("row_"), bit.alias("bit_")).join(F.broadcast(mask), "row_")
    byte = F.conv(F.hex(F.substring(F.col("mask_"), (F.shiftright("bit_", 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return rows_.where(F.getbit(byte, F.col("bit_").bitwiseAND(F.lit(7)).cast("int")) == 1).select(*rows.columns)


def _rounds(rows: DataFrame, n: int, *by) -> list[DataFrame]:
    """rows dealt to n tables by a hash of the columns."""
    deal = F.pmod(F.xxhash64(F.lit(17), *by), F.lit(n))
    return [rows.where(deal == k) for k in range(n)] if n > 1 else [rows]


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def link_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """doc id, n_shingles and component_id of every row of docs.

    A text's words are its parts between white space, A-Z lower-cased; its set are its
    distinct n-grams of words (the whole sequence, if it has fewer than n words). Two
    texts link if 100 * |intersection| >= percent * |union|; texts without words (null,
    empty) link with nothing. component_id is the least id reachable by links, the own id
    if there is none. Rows with equal ids but other texts are the same node of the graph; a
    null id has a null component and takes no part. Repeated rows come back as often as
    they are there; texts of any length are whole; an empty table gives an empty one."""
    spark = docs.sparkSession
    prepare(spark)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = docs.select(quoted(id_col).cast("long").alias("id"), quoted(text).alias("text"))
    first = source.mapInArrow(_first_pass(n), "id long, n long, f long, chunk int, counts binary")
    first = written(first, "shingle-sets")
    chunks = first.where("chunk is not null").select("chunk", "counts")
    table = np.zeros(1 << TABLE_BITS, dtype=np.uint8)
    # At most 2**TABLE_BITS bytes come to the driver and go out again.
    for r in chunks.repartition(min(tasks, 1 << (TABLE_BITS - CHUNK_BITS)), "chunk").mapInArrow(_add_chunks, "chunk int, codes binary").collect():
        table[r["chunk"] << CHUNK_BITS : (r["chunk"] + 1) << CHUNK_BITS] = np.frombuffer(zlib.decompress(r["codes"]), dtype=np.uint8)
    shared = spark.sparkContext.broadcast(table.tobytes())

    sets = first.where("chunk is null").select("id", "n", "f")
    known = sets.where("n > 0 and id is not null")
    classes = written(known.groupBy("f").agg(F.min("id").alias("id")), "shingle-classes")
    # An id with several texts connects their classes.
    several = known.groupBy("id").agg(F.min("f").alias("b"), F.max("f").alias("z")).where("b != z").select("id")
    several = known.join(several, "id", "left_semi").join(classes.withColumnRenamed("id", "a"), "f").select("id", "a")
    edges = several.join(several.groupBy("id").agg(F.min("a").alias("b")), "id").select("a", "b").where("a != b").distinct()
    edges = written(edges, "shingle-ids")

    prefixes = source.where("id is not null").mapInArrow(_prefixes(shared, n, percent), "id long, f long, n int, prefix array<long>, parts binary")
    prefixes = prefixes.join(classes.hint("merge"), ["f", "id"]).dropDuplicates(["f", "id"])
    prefixes = written(prefixes.select("id", "n", "prefix", "parts"), "shingle-prefixes")
    grams = int(prefixes.agg(F.sum("n")).first()[0] or 0)
    mets = []
    for postings in _rounds(prefixes.select("id", "n", F.posexplode("prefix").alias("p", "h")), min(PREFIX_ROUNDS, 1 + grams // ROUND_GRAMS), "h"):
        least = postings.groupBy("h").agg(F.min("id").alias("family"), F.max("id").alias("z")).where("family != z").drop("z")
        mets.append(written(postings.join(least, "h"), "shingle-met"))
    met = _union(mets)
    first_ = met.where("id = family").select("h", F.col("n").alias("n1"), F.col("p").alias("p1"))
    need = F.ceil(F.lit(percent) * (F.col("n") + F.col("n1")) / F.lit(100 + percent))
    # The n-gram needn't be the first that both have, so what comes before it counts, too.
    most = F.least("p", "p1") + F.least(F.col("n") - F.col("p"), F.col("n1") - F.col("p1"))
    fits = (100 * F.least("n", "n1") >= percent * F.greatest("n", "n1")) & (most >= need)
    members = met.where("id != family").join(first_, "h").groupBy("family", "id").agg(F.max("n").alias("n"), F.max(fits).alias("fits"))
    members = written(members, "shingle-families")
    release(*mets)

    def with_sets(rows: DataFrame) -> DataFrame:
        """rows (id and others) with n, parts and grams: texts move once, to their ids."""
        names = [c for c in rows.columns if c != "id"]
        texts = _wanted(source, rows.select("id")).join(rows.join(classes, "id").hint("merge"), "id").select("id", "f", "text", *names)
        kinds = ", ".join(f"{c} {t}" for c, t in rows.dtypes if c != "id")
        return texts.mapInArrow(_sets(shared, n, names), f"id long, n int, parts binary, grams binary, {kinds}")

    info = prefixes.select("id", "n", "parts")

    def linked(rows: DataFrame, by: tuple[str, ...], deal: Callable, more: Callable, match: Callable) -> list[DataFrame]:
        """Links (a, b) that match finds among rows with sets, in rounds by the columns `by`."""
        dealt = rows.join(info.select("id", "n"), "id").agg(F.sum("n")).first()[0] or 0
        parts = _rounds(rows, max(1, -(-int(dealt) // max(ROUND_GRAMS, grams // ROUND_SHARE))), *by)
        return [written(deal(with_sets(more(part)), tasks).mapInArrow(match, "a long, b long"), "shingle-links") for part in parts]

    pairs = _around(_starred(members.where("fits").select("family", "id")).join(info.hint("merge"), "id"), tasks)
    pairs = written(pairs.mapInArrow(_by_parts(percent), "a long, b long"), "shingle-pairs")
    ones = linked(_starred(pairs), ("pivot", "block"), _around, lambda rows: rows, _by_sets(percent))
    ones.append(edges)
    release(pairs)

    roots = components(_union(ones))
    rest = members.join(roots.withColumnRenamed("node", "id"), "id", "left").select("family", "id", "n", F.coalesce("component", "id").alias("component"))
    mixed = rest.groupBy("family").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y").select("family")
    rest = written(rest.join(mixed, "family", "left_semi"), "shingle-rest")
    by_id = rest.select("id", "component").distinct()
    families = members.join(by_id, "id", "left_semi").groupBy("id").agg(F.collect_set("family").alias("families"))
    told = by_id.join(families, "id")
    light = _together(_blocked(rest.select("family", "id", "n")).join(info.join(told, "id").hint("merge"), "id"), tasks)
    left = light.mapInArrow(_filter(percent), "family long, id long").distinct()
    left = written(left.join(rest.select("family", "id", "n"), ["family", "id"]), "shingle-candidates")
    twos = linked(_blocked(left), ("family", "x", "y"), _together, lambda rows: rows.join(told, "id"), _verify(percent))
    if not _union(twos).isEmpty():
        roots = components(_union([*twos, *ones]))
    release(prefixes, members, *ones, *twos, rest, left)

    near = classes.join(roots.withColumnRenamed("node", "id"), "id", "left").select("f", F.coalesce("component", "id").alias("component"))
    return sets.join(near, "f", "left").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"),
    )


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """The columns of docs, one document of each group of near duplicates: the one with
    the least id (of repeated ids one row). Documents with a null id stay, all of them, as
    do texts without words; columns may have any name; an empty table gives an empty one."""
    found = link_near_duplicates(docs, id_col, text, n, percent)
    (name,) = spare(docs.columns, "__id")
    kept = found.where(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias(name)).distinct()
    rows = docs.join(kept, quoted(id_col) == F.col(name), "left_semi").dropDuplicates([id_col])
    return rows.unionByName(docs.where(quoted(id_col).isNull())).select(*[quoted(c) for c in docs.columns])
