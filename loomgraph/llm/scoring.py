"""The window network: predicts every character of a masked place from both sides.

Characters are folded into SYMBOLS classes. The network sees the two before and the two
after a masked one and gives a distribution of it. Since the window is five characters,
the counts of all windows in all documents are everything that training needs: they are
gathered from the whole corpus as a table, dealt out by context. Each round every task
trains the network on its share, and the networks are averaged by weight, so only
networks (a few thousand numbers) come to the driver. word_scoring.py spells words by it.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, quoted, release, written

#: 0: beyond the ends; 1-26: letters without marks; then blank, line feed, digit, other
#: letter, punctuation and everything else.
SYMBOLS = 32
PAD, BLANK, LINE, DIGIT, LETTER, MARK = 0, 27, 28, 29, 30, 31
EMBED, HIDDEN = 8, 32
#: Contexts whose distributions are remembered while words are spelled.
REMEMBERED = 1 << 18
#: Characters taken together to bound memory.
CHARS = 1 << 21


def _symbol(ch: str) -> int:
    if ch == "\n":
        return LINE
    if ch.isspace():
        return BLANK
    base = unicodedata.normalize("NFD", ch)[:1].lower()
    if "a" <= base <= "z":
        return ord(base) - 96
    if ch.isdigit():
        return DIGIT
    return LETTER if ch.isalpha() else MARK


_table = None


def symbols(text: str) -> np.ndarray:
    global _table
    if _table is None:
        _table = np.array([MARK if 0xD800 <= c < 0xE000 else _symbol(chr(c)) for c in range(1 << 16)], dtype=np.uint8)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    out = _table[np.minimum(points, 0xFFFF)]
    out[points > 0xFFFF] = MARK
    return out


def windows(tokens: np.ndarray) -> np.ndarray:
    """One number for each token: the tokens around it (four base-SYMBOLS digits), then itself."""
    s = np.concatenate([np.zeros(2, np.uint32), tokens.astype(np.uint32), np.zeros(2, np.uint32)])
    return (((s[:-4] << 5 | s[1:-3]) << 5 | s[3:-1]) << 5 | s[4:]) << 5 | s[2:-2]


class WindowNetwork:
    """Embeddings of the four neighbours, one hidden layer, softmax over the tokens."""

    def __init__(self, seed: int = 9):
        rng = np.random.default_rng(seed)
        self.embed = rng.normal(0, 0.3, (SYMBOLS, EMBED)).astype(np.float32)
        self.w1 = rng.normal(0, 0.2, (4 * EMBED, HIDDEN)).astype(np.float32)
        self.b1 = np.zeros(HIDDEN, np.float32)
        self.w2 = rng.normal(0, 0.2, (HIDDEN, SYMBOLS)).astype(np.float32)
        self.b2 = np.zeros(SYMBOLS, np.float32)

    def _forward(self, contexts: np.ndarray):
        near = np.stack([contexts >> 15 & 31, contexts >> 10 & 31, contexts >> 5 & 31, contexts & 31], axis=1)
        x = self.embed[near].reshape(len(near), -1)
        h = np.tanh(x @ self.w1 + self.b1)
        z = h @ self.w2 + self.b2
        z -= z.max(axis=1, keepdims=True)
        return near, x, h, z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def logs(self, contexts: np.ndarray) -> np.ndarray:
        return self._forward(contexts)[3]

    def fit(self, codes: np.ndarray, counts: np.ndarray, rounds: int = 8, batch: int = 2048, rate: float = 0.01, seed: int = 4) -> WindowNetwork:
        """Adam on the mean log-probability over all counted windows. A batch is a set of
        contexts with the counts of all tokens seen in each; every context of the corpus
        takes part in every round, weighted by its counts."""
        self.__dict__.pop("_known", None)
        order = np.argsort(codes, kind="stable")
        codes, counts = codes[order], counts[order].astype(np.float64)
        contexts, starts = np.unique(codes >> 5, return_index=True)
        ends = np.append(starts[1:], len(codes))
        mean = counts.sum() / max(1, len(contexts))
        params = [self.embed, self.w1, self.b1, self.w2, self.b2]
        first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        rng = np.random.default_rng(seed)
        for r in range(rounds):
            pick = rng.permutation(len(contexts))
            for a in range(0, len(pick), batch):
                rows = pick[a : a + batch]
                seen = np.concatenate([np.arange(starts[i], ends[i]) for i in rows])
                target = np.zeros((len(rows), SYMBOLS), np.float32)
                target[np.repeat(np.arange(len(rows)), ends[rows] - starts[rows]), codes[seen] & 31] = counts[seen] / (mean * len(rows))
                near, x, h, logs = self._forward(contexts[rows])
                dz = np.exp(logs) * target.sum(axis=1, keepdims=True) - target
                dh = dz @ self.w2.T * (1 - h * h)
                dx = (dh @ self.w1.T).reshape(len(rows), 4, EMBED)
                de = np.zeros_like(self.embed)
                np.add.at(de, near.reshape(-1), dx.reshape(-1, EMBED))
                step += 1
                speed = rate * (1 - r / rounds) + 1e-4
                for k, (p, g) in enumerate(zip(params, [de, x.T @ dh, dh.sum(axis=0), h.T @ dz, dz.sum(axis=0)])):
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.01 * (g * g - second[k])
                    p -= speed * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
        return self

    def window_logs(self, codes: np.ndarray) -> np.ndarray:
        """Log-probabilities of windows; those of each context are made once and remembered,
        up to REMEMBERED contexts."""
        contexts, back = np.unique(codes >> 5, return_inverse=True)
        known, table = self.__dict__.get("_known", (np.zeros(0, contexts.dtype), np.zeros((0, SYMBOLS), np.float32)))
        at = np.searchsorted(known, contexts)
        new = contexts[known[np.minimum(at, len(known) - 1)] != contexts] if len(known) else contexts
        if len(new):
            if len(known) + len(new) > REMEMBERED:
                known, table, new = known[:0], table[:0], contexts
            made = np.concatenate([np.zeros((0, SYMBOLS), np.float32), *(self.logs(new[a : a + (1 << 14)].astype(np.int64)) for a in range(0, len(new), 1 << 14))])
            order = np.argsort(np.concatenate([known, new]), kind="stable")
            known, table = np.concatenate([known, new])[order], np.concatenate([table, made])[order]
            self._known = known, table
            at = np.searchsorted(known, contexts)
        return table[at[back], codes & 31].astype(np.float64)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_known"}

    def numbers(self) -> np.ndarray:
        return np.concatenate([p.reshape(-1) for p in (self.embed, self.w1, self.b1, self.w2, self.b2)])

    def set(self, numbers: np.ndarray) -> WindowNetwork:
        self.__dict__.pop("_known", None)
        at = 0
        for p in (self.embed, self.w1, self.b1, self.w2, self.b2):
            p[...] = numbers[at : at + p.size].reshape(p.shape)
            at += p.size
        return self


def count_windows(docs: DataFrame, text: str = "text") -> DataFrame:
    """code and n of every window in all whole texts."""
    prepare(docs.sparkSession)

    def run(batches):
        total_codes, total = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        waiting, size = [], 0

        def add():
            nonlocal total_codes, total, waiting, size
            codes = np.concatenate(waiting)
            codes.sort()
            first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
            n = np.diff(np.append(first, len(codes)))
            both = np.concatenate([total_codes, codes[first]])
            total_codes, back = np.unique(both, return_inverse=True)
            total = np.bincount(back, weights=np.concatenate([total, n]), minlength=len(total_codes)).astype(np.int64)
            waiting, size = [], 0

        for batch in batches:
            for t in batch.column(0):
                if t := t.as_py():
                    waiting.append(windows(symbols(t)))
                    size += len(t)
                    if size >= CHARS:
                        add()
        if waiting:
            add()
        for a in range(0, len(total), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(total_codes[a : a + (1 << 16)].astype(np.int32)), pa.array(total[a : a + (1 << 16)])], names=["code", "n"])

    return docs.select(quoted(text)).mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))


#: Tasks that train at most, distinct windows that make one, rounds of averaging, passes
#: of a task over its share in a round.
SHARES, SHARE, ROUNDS, PASSES = 64, 1 << 18, 4, 3


def train(docs: DataFrame, text: str = "text") -> WindowNetwork:
    """A network fitted to the windows of all texts, the same for the same counts. Nothing but one network for each of at most SHARES tasks comes to the driver.
    Null and empty texts have no windows; a table without any gives the network as
    initialised; repeated rows weigh as often as they are there."""
    table = written(count_windows(docs, text), "lm-windows")
    shares = max(1, min(SHARES, -(-table.count() // SHARE)))
    counts = table.repartition(shares, F.shiftright("code", 5)).sortWithinPartitions("code")
    network = WindowNetwork()
    for r in range(ROUNDS):
        now, rate = network.numbers(), 0.01 * (1 - r / ROUNDS)

        def learn(batches, now=now, rate=rate):
            parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
            if parts:
                codes, n = (np.concatenate(x) for x in zip(*parts))
                own = WindowNetwork().set(now).fit(codes.astype(np.int64), n, rounds=PASSES, rate=rate)
                yield pa.RecordBatch.from_arrays([pa.array([own.numbers().astype("<f4").tobytes()], pa.binary()), pa.array([float(n.sum())])], names=["network", "weight"])

        made = counts.mapInArrow(learn, "network binary, weight double").orderBy("weight", "network").collect()
        if not made:
            break
        network.set(np.average([np.frombuffer(m["network"], "<f4") for m in made], axis=0, weights=[m["weight"] for m in made]))
    release(table)
    return network
