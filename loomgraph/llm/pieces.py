"""SentencePiece encoding and decoding over a prefix table.

The encoding of a text by a merge-type model has one last token for each prefix of
the text, and it depends on the prefix alone. So one pass suffices: an automaton
gives the pieces that end at a place; the one that is compatible with the last token
of the prefix before it is the prefix's own last token. Walking back from the end
of the text along these tokens gives the ids.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, hold, let_go, prepare, quoted

MARK = "▁"
codecs.register_error("each_byte", lambda e: ("\ufffd" * (e.end - e.start), e.end))
#: The rank of a merge that never happens.
NEVER = 1 << 30
#: Remembered words and pairs of pieces; beyond that the memory starts anew. Longer words aren't kept.
MEMORY, PAIRS, WORD_MOST = 250_000, 400_000, 40


class PieceModel:
    """A merge-type model with byte fallback, read from the library's model file.

    Raises ValueError for models whose results this method can't give: other types,
    normalisation, pieces of equal rank other than runs of the word mark, or pieces
    that go on after a word with a new word mark."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as model_pb2

        proto = model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or norm.name != "identity" or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
            raise ValueError(f"{path}: not a plain merge-type model")
        sp = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        size = sp.get_piece_size()
        self.surface: list[bytes] = []
        self.bytes_at = [0] * 256
        ids: dict[str, int] = {}
        for i in range(size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes_at[int(piece[3:5], 16)] = i
                self.surface.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i):
                self.surface.append(b"")
            elif sp.is_unknown(i):
                self.surface.append(" ⁇ ".encode())
            else:
                ids[piece] = i
                self.surface.append(piece.replace(MARK, " ").encode())
        self.ids, self.piece = ids, {i: p for p, i in ids.items()}
        self.chars = {p for p in ids if len(p) == 1}
        runs = [p for p in ids if len(p) > 1 and not p.strip(MARK)]
        words = sorted((p for p in ids if len(p) > 1 and p.strip(MARK)), key=lambda p: -sp.get_score(ids[p]))
        scores = [sp.get_score(ids[p]) for p in words]
        if any(a <= b for a, b in zip(scores, scores[1:])) or any(sp.get_score(ids[p]) >= scores[-1] for p in runs):
            raise ValueError(f"{path}: pieces of equal rank")
        if any(MARK in p.lstrip(MARK) or p.startswith(MARK * 2) for p in words) or any(c not in self.chars for p in words for c in p):
            raise ValueError(f"{path}: pieces across words or of unknown characters")
        self.rank = {p: r for r, p in enumerate(words)}
        self.runs = {len(p): ids[p] for p in runs} | {1: ids[MARK]}
        self._halves: dict[str, tuple[str, str] | None] = {}
        self._fits: dict[int, bool] = {}
        self._run_ids: dict[int, list[int]] = {}
        self._left: dict[int, tuple[list[str], list[int]]] = {}
        self._right: dict[int, tuple[list[str], list[int]]] = {}
        # Characters that stand side by side in no piece are never joined.
        self.beside = {p[i : i + 2] for p in ids for i in range(len(p) - 1)}
        self.automaton = ahocorasick.Automaton()
        for p in [*self.chars, *words]:
            if self.whole(p):
                self.automaton.add_word(p, (ids[p], len(p)))
        self.automaton.make_automaton()
        self.matches = self.automaton.iter
        self.length = [len(self.piece.get(i, "?")) for i in range(size)]

    # -- how the merges go -------------------------------------------------

    def halves(self, piece: str) -> tuple[str, str] | None:
        """The two pieces of the last merge on piece's own text; None if that text
        isn't encoded as this one piece (or is a single character)."""
        if piece not in self._halves:
            parts, last = list(piece), None
            while len(parts) > 1:
                best = min(((self.rank.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))))
                if best[0] == NEVER:
                    break
                i = best[1]
                last = (parts[i], parts[i + 1])
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self._halves[piece] = last if len(parts) == 1 else None
        return self._halves[piece]

    def whole(self, piece: str) -> bool:
        return len(piece) == 1 or self.halves(piece) is not None

    def edge(self, piece: int, side: int) -> tuple[list[str], list[int]]:
        """The pieces that lie at one edge of piece while it is put together, in order,
        and for each the rank of the merge that makes the next one of it."""
        memo = self._right if side else self._left
        found = memo.get(piece)
        if found is None:
            p = self.piece[piece]
            out = [p]
            while len(p) > 1:
                p = self.halves(p)[side]
                out.append(p)
            out.reverse()
            found = memo[piece] = out, [*(self.rank[p] for p in out[1:]), NEVER]
        return found

    def fits(self, a: int, b: int) -> bool:
        """Whether a b is the encoding of its own text: no merge across the border
        comes before the merges that put a and b together. At equal rank the merge
        further left goes first."""
        (left, left_next), (right, right_next) = self.edge(a, 1), self.edge(b, 0)
        rank, i, j, known = self.rank.get, 0, 0, True
        while True:
            across, next_a, next_b = rank(left[i] + right[j], NEVER), left_next[i], right_next[j]
            if across < next_a and across <= next_b:
                known = False
                break
            if next_a <= next_b:
                if next_a == NEVER:
                    break
                i += 1
            else:
                j += 1
        if len(self._fits) >= PAIRS:
            self._fits.clear()
        self._fits[a << 20 | b] = known
        return known

    # -- encoding ------------------------------------------------------------

    def _known(self, text: str) -> list[int]:
        """Ids of text in which every character is a piece."""
        last, known, fits = [-1] * len(text), self._fits.get, self.fits
        for end, (piece, size) in self.matches(text):
            if last[end] < 0:
                before = end - size
                if before >= 0:
                    a = last[before]
                    fit = known(a << 20 | piece)
                    if not fit and (fit is not None or not fits(a, piece)):
                        continue
                last[end] = piece
        out, at, length = [], len(text) - 1, self.length
        while at >= 0:
            piece = last[at]
            out.append(piece)
            at -= length[piece]
        out.reverse()
        return out

    def part(self, text: str) -> list[int]:
        """Ids of text without runs of word marks; unknown characters become bytes."""
        if self.chars.issuperset(text):
            return self._known(text)
        out: list[int] = []
        start = 0
        for at, c in enumerate(text):
            if c not in self.chars:
                if at > start:
                    out += self._known(text[start:at])
                out += [self.bytes_at[x] for x in c.encode()]
                start = at + 1
        return out + self._known(text[start:]) if start < len(text) else out

    def run(self, n: int) -> list[int]:
        """Ids of n word marks alone. Their merges all rank alike: leftmost first."""
        if n not in self._run_ids:
            size, after, before = [1] * n, list(range(1, n + 1)), list(range(-1, n - 1))
            heap = [i for i in range(n - 1)] if 2 in self.runs else []
            wait = {i: 2 for i in heap}
            while heap:
                i = heapq.heappop(heap)
                total = wait.pop(i, 0)
                j = after[i] if size[i] else n
                if not size[i] or j >= n or size[i] + size[j] != total:
                    continue
                size[i], size[j] = total, 0
                after[i] = after[j]
                if after[i] < n:
                    before[after[i]] = i
                for k in (before[i], i):
                    if k >= 0 and after[k] < n and size[k] + size[after[k]] in self.runs:
                        if k not in wait:
                            heapq.heappush(heap, k)
                        wait[k] = size[k] + size[after[k]]
            out, i = [], 0
            while i < n:
                out.append(self.runs[size[i]])
                i = after[i]
            if len(self._run_ids) > 10_000:
                self._run_ids.clear()
            self._run_ids[n] = out
        return self._run_ids[n]

    def decode_bytes(self, ids) -> bytes:
        return b"".join(map(self.surface.__getitem__, ids))


class _Words(dict):
    """Ids, as text, of parts between blanks."""

    def __init__(self, model: PieceModel):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> str:
        m = self.model
        if 2 < len(word) <= WORD_MOST and word[-2:] not in m.beside:  # a mark at the end that joins nothing
            entry = self[word[:-1]] + "," + ",".join(map(str, m.part(word[-1])))
        else:
            ids = [*m.part("\n"), *m.part(word[1:])] if word[:1] == "\n" else m.part(MARK + word)
            entry = ",".join(map(str, ids))
        if len(word) <= WORD_MOST:
            if len(self) >= MEMORY:
                self.clear()
            self[word] = entry
        return entry


class Pieces:
    """Encoder and decoder for whole texts."""

    def __init__(self, path: str):
        self.model = PieceModel(path)
        self.words = _Words(self.model)
        self.surfaces = np.array(self.model.surface, dtype=object)

    def parts(self, text: str) -> list[str]:
        """Ids, as text, of the text's parts in order. It is cut before every blank and
        every line feed: no piece goes over such a place. A part without a line feed in
        front has a word mark in front; of several marks in a row only the last can join a word."""
        cut = text.replace(MARK, " ").replace("\n", " \n").split(" ")
        if "" not in cut:
            return list(map(self.words.__getitem__, cut))
        m, out, marks = self.model, [], 0
        alone = str(m.ids[MARK])
        for p in cut:
            if p == "":
                marks += 1
                continue
            ids = self.words[p]
            if marks:
                first, _, rest = ids.partition(",")
                joins = p[0] == "\n" or first != alone
                out.append(",".join(map(str, m.run(marks + (not joins)))))
                ids = ids if joins else rest
                marks = 0
            if ids:
                out.append(ids)
        if marks:
            out.append(",".join(map(str, m.run(marks))))
        return out

    def encode(self, text: str | None) -> list[int]:
        return list(map(int, ",".join(self.parts(text)).split(","))) if text else []

    def _bytes(self, ids: np.ndarray) -> bytes:
        """Surfaces of the ids, one after the other; the blank that stands for the word
        mark put in front goes."""
        joined = b"".join(self.surfaces[ids].tolist())
        return joined[1:] if len(ids) and self.model.piece.get(int(ids[0]), "")[:1] == MARK else joined

    def decode(self, ids) -> str:
        """As the library: bytes that aren't UTF-8 become U+FFFD each."""
        return self._bytes(np.fromiter(ids, dtype=np.int64)).decode("utf-8", "each_byte")

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """n_tokens, sha256 of the ids, sha256 of the text that all ids decode to."""
        if not text:
            return 0, _EMPTY, _EMPTY
        ids = ",".join(self.parts(text))
        numbers = np.fromstring(ids, dtype=np.int32, sep=",")
        back = self._bytes(numbers)
        try:
            back.decode()  # most are UTF-8, so their bytes are what is hashed
        except UnicodeDecodeError:
            back = self.decode(numbers).encode()
        return len(numbers), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(back).hexdigest()


_EMPTY = hashlib.sha256(b"").hexdigest()

_loaded: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def encode(docs: DataFrame, model: str, text: str = "text", to: str = "ids", digest: bool = False) -> DataFrame:
    """Encode every whole text and decode it again.

    Adds `to` (array of ids), decoded, or with digest=True instead n_tokens,
    ids_sha256 and decoded_sha256; columns of docs with these names give way. Null
    and empty texts have no ids and decode to ''. One narrow pass without exchange:
    rows stay where they are, repeated rows give repeated results, an empty table an
    empty one. `model` is a path every worker can read."""
    prepare(docs.sparkSession)
    made = ["n_tokens", "ids_sha256", "decoded_sha256"] if digest else [to, "decoded"]
    keep = carried(docs, made)
    rest = [c for c in keep if c != text]
    # By place, so that no name can clash: the text is the last column.
    source = docs.select(*[quoted(c).alias(f"c{i}") for i, c in enumerate(rest)], quoted(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = pieces(model)
        hold(coder.words, coder.model._fits)
        for batch in batches:
            texts = batch.column(len(rest))
            columns = [batch.column(i) for i in range(len(rest))]
            if digest:
                rows = [coder.digest(t.as_py()) for t in texts]
                n, a, b = zip(*rows) if rows else ((), (), ())
                out = [pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            else:
                ids = [coder.encode(t.as_py()) for t in texts]
                out = [pa.array(ids, pa.list_(pa.int32())), pa.array([coder.decode(x) for x in ids], pa.string())]
            if text in keep:
                out.append(texts)
            names = [*rest, *made] + ([text] if text in keep else [])
            yield pa.RecordBatch.from_arrays([*columns, *out], names=names)
        let_go()

    kinds = dict(docs.dtypes)
    fields = [f"`{c}` {kinds[c]}" for c in rest]
    fields += ["n_tokens long", "ids_sha256 string", "decoded_sha256 string"] if digest else [f"`{to}` array<int>", "decoded string"]
    fields += [f"`{text}` string"] if text in keep else []
    return source.mapInArrow(run, ", ".join(fields)).select(*[quoted(c) for c in keep], *made)


def decode(rows: DataFrame, model: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """Decode an array column of ids (null: '')."""
    prepare(rows.sparkSession)

    @F.pandas_udf("string")
    def back(column):
        coder = pieces(model)
        return column.map(lambda x: coder.decode([int(i) for i in x]) if x is not None else "")

    return rows.withColumn(to, back(quoted(ids)))
