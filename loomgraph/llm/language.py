"""Language identification: text likelihood, declared language, address suffix and host priors, fused by Bayes' rule."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import carried, hold, prepare, quoted, release, written

#: Hash buckets of character trigrams; about so many texts of each label the model is fitted on.
BUCKETS, SAMPLE = 1 << 16, 4096
#: Trigrams overlap, so a text's log-likelihood counts by this power.
TEMPER = 0.3
#: Weight, in rows, of what a level of hosts takes over from the level above it.
HOST_ROWS, DECLARED_ROWS = 8.0, 4.0
#: A text isn't a language's if it is less likely than chance by more than this (in nats).
SLACK = 30.0

_TAG = re.compile(r"<script\b.*?(?:</script\s*>|$)|<style\b.*?(?:</style\s*>|$)|<!--.*?(?:-->|$)|<[^>]*>|&#?\w+;?", re.S | re.I)
_DECLARED = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", re.I)


def _class_table() -> np.ndarray:
    """Lower case for letters, 0 for everything else, by code point of the basic plane."""
    table = np.zeros(1 << 16, dtype=np.uint32)
    for c in range(1 << 16):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


_classes = None


def trigrams(text: str) -> np.ndarray:
    """Buckets of the text's trigrams of letters; all between two letters is one mark."""
    global _classes
    if _classes is None:
        _classes = _class_table()
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    c = np.where(points < 1 << 16, _classes[np.minimum(points, 0xFFFF)], points)
    c = np.concatenate([np.zeros(1, dtype=np.uint32), c, np.zeros(1, dtype=np.uint32)])
    c = c[np.append(True, (c[1:] != 0) | (c[:-1] != 0))].astype(np.uint64)
    if len(c) < 3:
        return np.zeros(0, dtype=np.int64)
    h = c[:-2] * np.uint64(0x9E3779B1) + c[1:-1] * np.uint64(0x85EBCA77) + c[2:] * np.uint64(0xC2B2AE3D)
    return ((h ^ (h >> np.uint64(17))) % np.uint64(BUCKETS)).astype(np.int64)


class TextModel:
    """Naive Bayes over trigram buckets. counts: (languages, folds, BUCKETS) of trigrams
    in labelled texts. logs[0] is made of all folds, logs[1 + f] of all but f, for rows
    whose own labels went into fold f."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages, self.folds = languages, counts.shape[1] if len(languages) else 1
        self.logs = []
        for out in [None, *range(self.folds if self.folds > 1 else 0)] if languages else []:
            seen = (counts.sum(axis=1) - (0 if out is None else counts[:, out])).T + 0.05
            self.logs.append(np.log(seen / seen.sum(axis=0)).astype(np.float32))

    @classmethod
    def of(cls, texts, labels) -> TextModel:
        languages = sorted(set(labels))
        counts = np.zeros((len(languages), 1, BUCKETS))
        for t, l in zip(texts, labels):
            np.add.at(counts[languages.index(l), 0], trigrams(t or ""), 1)
        return cls(languages, counts)

    def loglik(self, text: str | None, fold: int | None = None) -> tuple[np.ndarray, int]:
        grams = trigrams(text) if text else np.zeros(0, dtype=np.int64)
        logs = self.logs[0 if fold is None or self.folds == 1 else 1 + fold]
        total = np.zeros(len(self.languages))
        for a in range(0, len(grams), 1 << 16):
            total += logs[grams[a : a + (1 << 16)]].sum(axis=0, dtype=np.float64)
        return total, len(grams)


def fold_of(text, folds: int):
    """The fold of a text: texts that are alike share one."""
    return F.pmod(F.xxhash64(F.lit(43), text), F.lit(folds)).cast("int")


def _trigram_counts(batches):
    """Label, fold, bucket and count for each batch of (label, fold, text)."""
    hold()
    for batch in batches:
        found: dict[tuple, list] = {}
        for l, f, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            found.setdefault((l, f), []).append(trigrams(t.as_py()))
        for (l, f), grams in found.items():
            bucket, n = np.unique(np.concatenate(grams), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([l] * len(n), pa.string()), pa.array([f] * len(n), pa.int32()), pa.array(bucket.astype(np.int32)), pa.array(n)], names=["l", "f", "b", "n"])


def fit(labelled: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", bound: int = SAMPLE, folds: int = 2) -> TextModel:
    """A text model of every label that any row with a text has. Of each label a share of
    bound / rows of its rows, picked by a hash of key and text (at least one row), counts;
    the labels are taken from all rows. Rows that are alike count once. Texts stay on the
    executors, whatever their length; BUCKETS counts for each label and fold come to the
    driver. No labelled rows: a model without languages. With folds, identify() can score
    the same rows by what the other folds' labels say."""
    usable = labelled.where(quoted(label).isNotNull() & quoted(text).isNotNull())
    rows = usable.select(quoted(label).alias("l"), quoted(text).alias("t"), F.xxhash64(F.lit(41), quoted(key), quoted(text)).alias("h"))
    sizes = rows.select("l", "h").distinct().groupBy("l").agg(F.count("*").alias("n"), F.min("h").alias("least"))
    sizes = written(sizes, "language-labels")
    part = F.pmod("h", F.lit(1 << 30)) < F.ceil(F.lit(float(bound << 30)) / F.col("n"))
    chosen = rows.join(F.broadcast(sizes), "l").where(part | (F.col("h") == F.col("least"))).dropDuplicates(["l", "h"])
    counts = chosen.select("l", fold_of(F.col("t"), folds).alias("f"), "t").mapInArrow(_trigram_counts, "l string, f int, b int, n long")
    counts = counts.groupBy("l", "f", "b").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(r["l"] for r in sizes.select("l").collect())
    release(sizes)
    whole = np.zeros((len(languages), folds, BUCKETS))
    if counts.num_rows:
        place = {l: i for i, l in enumerate(languages)}
        l = np.array([place[x] for x in counts.column("l").to_pylist()])
        whole[l, counts.column("f").to_numpy(), counts.column("b").to_numpy()] = counts.column("n").to_numpy()
    return TextModel(languages, whole)


def markup_text(html: str) -> str:
    return _TAG.sub(" ", html)


def host_parts(url):
    """host, domain (its last two labels) and suffix (the last) of an address column."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return host, F.substring_index(host, ".", -2), F.substring_index(host, ".", -1)


def identify(
    rows: DataFrame,
    model: TextModel,
    text: str,
    url: str | None = None,
    host: str | None = None,
    declared: str | None = None,
    markup: bool = False,
    keep=None,
    held_out: bool = False,
    columns: list[str] | None = None,
    made: tuple[str, str, str] = ("lang", "probability", "kept"),
) -> DataFrame:
    """rows (or the named columns of them) with lang, probability and kept.

    The posterior of a language is proportional to its prior on the row's host, times
    the text's likelihood, times the probability of what the row declares. With
    markup=True the text is HTML: tags and character references are no text, the
    declared language is <html lang>. Otherwise `declared` names a column. Hosts come
    from `url`, or `host` names a column of them (then there are no levels above it).
    held_out: the rows are those that the model was fitted to, so each is scored by the
    labels of the other folds, and what it declares is evidence of its own.

    Priors and the reliability of declarations come from all rows, by grouped sums of
    text posteriors: all rows -> suffix -> domain -> host, each level smoothed by the one above.
    kept is false for rows without letters, for texts far less likely in every language
    than chance over all trigrams (SLACK), and for languages outside `keep` (default: all).
    Null and empty texts get the language that the other evidence favours and aren't
    kept; null hosts, addresses and declarations are values of their own that say nothing;
    of languages that are equally likely the first by name is taken. Texts of any length
    are scored whole. Input columns named like the made ones give way, others may have any
    name; repeated rows get equal results; an empty table gives an empty one. With a model
    without languages no row has a language (null, probability 0) and none is kept.

    Each text is scored once: the evidence is written, and only hosts are joined to it,
    which moves no rows unless their table is too large to broadcast by Spark's own check."""
    spark = rows.sparkSession
    prepare(spark)
    languages, size = model.languages, len(model.languages)
    keep = set(languages if keep is None else keep)
    carry = [c for c in carried(rows, made) if columns is None or c in columns]
    if not size:
        none = [F.lit(None).cast("string").alias(made[0]), F.lit(0.0).alias(made[1]), F.lit(False).alias(made[2])]
        return rows.select(*[quoted(c) for c in carry], *none)
    shared = spark.sparkContext.broadcast(model)  # BUCKETS floats for each language and fold

    @arrow_udf("array<double>")
    def evidence(body: pa.Array, fold: pa.Array) -> pa.Array:
        hold()
        m, out = shared.value, []
        for t, f in zip(body, fold.to_pylist()):
            t = t.as_py()
            logs, n = m.loglik(markup_text(t) if markup and t else t, f)
            out.append([*(TEMPER * logs), float(n)])
        return pa.array(out, pa.list_(pa.float64()))

    @arrow_udf("string")
    def html_lang(body: pa.Array) -> pa.Array:
        found = (_DECLARED.search(t.as_py() or "") for t in body)
        return pa.array([f[1].lower() if f else None for f in found], pa.string())

    said = html_lang(quoted(text)) if markup else F.lower(F.split(quoted(declared).cast("string"), "[-_]")[0]) if declared else F.lit(None).cast("string")
    if url:
        h, d, s = host_parts(quoted(url))
    else:
        h = F.coalesce(quoted(host).cast("string"), F.lit("")) if host else F.lit("")
        d, s = F.lit(""), F.lit("")
    fold = fold_of(quoted(text), model.folds) if held_out else F.lit(None).cast("int")
    # By place, so that no name can clash.
    base = rows.select(*[quoted(c).alias(f"c{i}") for i, c in enumerate(carry)], h.alias("host"), d.alias("domain"), s.alias("suffix"), F.coalesce(said, F.lit("")).alias("said"), evidence(quoted(text), fold).alias("logs"))
    base = written(base, "language-evidence")

    # Soft counts by text alone; rows without letters count for nothing.
    slots = [F.col("logs")[i] for i in range(size)]
    best = F.greatest(*slots) if size > 1 else slots[0]
    mass = [F.exp(s - best) for s in slots]
    whole = sum(mass[1:], mass[0])
    soft = [F.when(F.col("logs")[size] > 0, m / whole).otherwise(0.0).alias(f"p{i}") for i, m in enumerate(mass)]
    sums = [F.sum(f"p{i}").alias(f"p{i}") for i in range(size)]
    stats = written(base.select("host", "domain", "suffix", "said", *soft).groupBy("host", "domain", "suffix", "said").agg(*sums), "language-counts")

    def add(over: DataFrame, *by: str) -> DataFrame:
        return over.groupBy(*by).agg(*sums)

    total = add(stats).first()
    world = np.array([total[f"p{i}"] or 0.0 for i in range(size)]) + 1.0
    world /= world.sum()

    def smoothed(level: DataFrame, above, name: str) -> DataFrame:
        """Shares by language: the level's counts and HOST_ROWS rows of the level above."""
        n = sum((F.col(f"p{i}") for i in range(1, size)), F.col("p0"))
        return level.withColumn(name, F.array(*[(F.col(f"p{i}") + HOST_ROWS * above(i)) / (n + HOST_ROWS) for i in range(size)])).drop(*[f"p{i}" for i in range(size)])

    suffixes = smoothed(add(stats, "suffix"), lambda i: F.lit(float(world[i])), "q1")
    domains = smoothed(add(stats, "domain", "suffix").join(suffixes, "suffix"), lambda i: F.col("q1")[i], "q2").drop("q1")
    hosts = smoothed(add(stats, "host", "domain", "suffix").join(domains, ["domain", "suffix"]), lambda i: F.col("q2")[i], "prior")
    hosts = written(hosts.select("host", "prior"), "language-hosts")
    # P(declared | language) up to a factor: the share of each language among what
    # declares so, over its share in all; a declaration of one of the languages is
    # smoothed towards that language, any other towards all alike.
    declarations = add(stats, "said")
    n = sum((F.col(f"p{i}") for i in range(1, size)), F.col("p0"))
    known = F.col("said").isin(languages)
    toward = [F.when(known, F.when(F.col("said") == l, 0.9).otherwise(0.1 / max(1, size - 1))).otherwise(float(world[i])) for i, l in enumerate(languages)]
    ratio = [(F.col(f"p{i}") + DECLARED_ROWS * toward[i]) / (n + DECLARED_ROWS) / F.lit(float(world[i])) for i in range(size)]
    declarations = declarations.select("said", F.when(F.col("said") == "", F.array(*[F.lit(1.0)] * size)).otherwise(F.array(*ratio)).alias("claim"))
    declarations = written(declarations, "language-declared")
    release(stats)

    joined = base.join(hosts, "host", "left").join(declarations, "said", "left")
    logs = [F.col("logs")[i] + F.log(F.col("prior")[i]) + F.log(F.col("claim")[i]) for i in range(size)]
    joined = joined.withColumn("all", F.array(*logs))
    top = F.array_max("all")
    chance = F.col("logs")[size] * F.lit(float(-TEMPER * np.log(BUCKETS))) - F.lit(TEMPER * SLACK)
    lang = F.element_at(F.array(*map(F.lit, languages)), F.array_position("all", top).cast("int"))
    share = F.lit(1.0) / F.aggregate(F.transform("all", lambda x: F.exp(x - top)), F.lit(0.0), lambda a, x: a + x)
    text_best = F.array_max(F.slice("logs", 1, size))
    return joined.select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)],
        lang.alias(made[0]),
        share.alias(made[1]),
        ((F.col("logs")[size] > 0) & (text_best >= chance) & lang.isin(sorted(keep))).alias(made[2]),
    )
