"""Mixing sources to target weights, in DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import UPPER, WORD, prepare, quoted, row_key, spare, written

#: Characters that are rare in prose.
JUNK = "0123456789#$%&*|=<>{}[]^~_@"
#: Bins of each feature of a text.
BINS = 11
#: The least weight of a document.
FLOOR = 0.01


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def features(text, size):
    """Bins (0 to BINS - 1) of the shares of junk and of capital letters, in steps of a
    fortieth, and of the mean length of a word with what follows it."""
    n = F.coalesce(F.length(text), F.lit(0)).cast("double")
    count = lambda chars: n - F.coalesce(F.length(F.translate(text, chars, "")), F.lit(0))
    held = lambda x: F.least(F.lit(BINS - 1), F.floor(x)).cast("int")
    share = lambda chars: F.when(n > 0, held(40 * count(chars) / n)).otherwise(0)
    return {"junk": share(JUNK), "upper": share(UPPER), "length": F.when(size > 0, held(n / size)).otherwise(0)}


def quality(rows: DataFrame, labels: DataFrame | None, label_id: str, label: str):
    """A weight in [FLOOR, 1] from the feature columns: the probability of a good label
    by naive Bayes over the bins, fitted to all labelled rows (id, label: over 0 is good).
    3 * BINS rows of counts come to the driver. Without labels all weigh alike."""
    names, count = ["junk", "upper", "length"], {}
    if labels is not None:
        known = labels.where(quoted(label).isNotNull() & quoted(label_id).isNotNull())
        known = known.groupBy(quoted(label_id).alias("id")).agg((F.max(quoted(label)) > 0).alias("good"))
        bins = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("b")) for f in names])).alias("x")
        met = rows.select("id", *names).join(known, "id").select("good", bins).groupBy("x.f", "x.b", "good").count()
        count = {(r["f"], r["b"], r["good"]): r["count"] for r in met.collect()}
    whole = {g: sum(n for (f, _, good), n in count.items() if f == names[0] and good == g) for g in (True, False)}
    odds = F.lit(math.log((whole[True] + 1) / (whole[False] + 1)))
    for f in names:
        log = lambda b, g: math.log((count.get((f, b, g), 0) + 1) / (whole[g] + BINS))  # noqa: B023, E731
        odds = odds + F.element_at(F.array(*[F.lit(log(b, True) - log(b, False)) for b in range(BINS)]), F.col(f) + 1)
    return F.lit(FLOOR) + F.lit(1 - FLOOR) / (1 + F.exp(-odds))


def water_fill(sources: DataFrame, share: float, weights, most: float) -> DataFrame:
    """Targets by weight, none above `most` times its source's size.

    Resharing the excess until none is above ends at a level L with target =
    min(cap, L * weight). Sources in order of cap / weight fill up one after the
    other, so prefix sums give L directly: one row for each source, no loop."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place + 1)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "skey")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    w = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    w = w.select(
        "*",
        F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("filled"),
        F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)).alias("left"),
        (F.sum("source_size").over(everything) * F.lit(float(share))).alias("whole"),
    )
    level = (F.col("whole") - F.col("filled")) / F.col("left")
    # The first source, in this order, that the level does not fill sets it for all after it.
    w = w.withColumn("level", F.when(level * F.col("weight") <= F.col("cap"), level))
    w = w.withColumn("level", F.first("level", ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, 0)))
    return w.withColumn("target", F.coalesce(F.least(F.col("level") * F.col("weight"), F.col("cap")), F.col("cap")))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    source: str = "source",
    share: float = 1.5,
    weights=(5, 2, 1),
    most: float = 2.0,
    seed: int = 7,
    labels: DataFrame | None = None,
    label: str = "quality",
) -> DataFrame:
    """Words to take of each document so that sources meet their target shares.

    Returns for each row its key (k1, k2: equal for equal rows), the id, size,
    source, source_size, target and taken. Sources in code-point order (null last)
    weigh `weights`, repeating; together they get `share` times all words, none more
    than `most` times its own. A source's target first buys whole epochs of all its
    documents; what is left buys documents by Efraimidis-Spirakis sampling: keys
    -ln(u) / quality, sorted in the source, prefix-summed up to the budget. A document's
    quality is the probability of a good label in `labels` (id_col, label), see quality();
    labels of other documents, null ones and repeated ones (the best counts) are fine. The
    document on the edge gives as many words as still fit, so a source's taken words
    are its target rounded down. u is a hash of seed, id and text: reruns agree.
    Ties of keys go by id, then text; rows that are wholly alike are exchangeable.
    Documents without words, or in a source without words, take 0; an empty table
    gives an empty one.

    A source may hold any share of all rows: its rows are dealt out by key range,
    sums of ranges give each range its start, and only ranges are ever sorted."""
    spark = docs.sparkSession
    prepare(spark)
    k1, k2 = row_key(docs)
    body = quoted(text)
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(quoted(id_col).cast("string"), F.lit("")), F.md5(F.coalesce(body, F.lit("")))))
    size = word_count(body)
    slim = docs.select(
        k1.alias("k1"),
        k2.alias("k2"),
        quoted(id_col).alias("id"),
        quoted(source).cast("string").alias("source"),
        F.when(quoted(source).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), quoted(source).cast("string"))).alias("skey"),
        size.alias("size"),
        digest.alias("digest"),
        *[f.alias(name) for name, f in features(body, size).items()],
    )
    slim = written(slim, "mix-sizes")
    u = (F.conv(F.substring("digest", 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))
    slim = slim.withColumn("quality", quality(slim, labels, id_col, label)).withColumn("key", -F.log(u) / F.col("quality"))
    slim = slim.drop("junk", "upper", "length")

    stats = slim.groupBy("skey").agg(
        F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count("*").alias("rows"), F.avg("quality").alias("mean")
    )
    targets = water_fill(stats, share, weights, most).select("skey", "source_size", "target", "rows", "mean")
    targets = written(targets, "mix-targets")

    # Key ranges: 1 - exp(-key * mean) is monotone in the key and about uniform.
    ranges = F.greatest(F.lit(1), F.least(F.lit(4096), F.ceil(F.col("rows") / 128)))
    place = F.least(F.floor((1 - F.exp(-F.col("key") * F.col("mean"))) * ranges), ranges - 1).cast("int")
    dealt = slim.join(targets, "skey").withColumn("range", place).drop("rows", "mean")
    starts = dealt.groupBy("skey", "range").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("skey").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("skey", "range", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("skey", "range").orderBy("key", "id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    rows = dealt.join(starts, ["skey", "range"]).withColumn("ahead", F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("ahead")))
    return rows.select("k1", "k2", "id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed(docs: DataFrame, mix_rows: DataFrame) -> DataFrame:
    """docs with each row as often as the mix takes it: taken / size, rounded half up
    (rows without words: once). Rows that are alike share a key; their copies are added up.

    Of r rows that are alike and c copies of them together each gives the whole part of
    c / r; only if something is left over is one of them looked up again for it, so whole
    rows are never grouped but there. Rows go by a hash of the whole row, nulls included;
    a hash's rows can be split, for adaptive execution deals a join's hot keys out."""
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(F.lit(1))
    a, b, each, rest, copy = spare(docs.columns, "__k1", "__k2", "__each", "__rest", "__copy")
    totals = mix_rows.select(F.col("k1").alias(a), F.col("k2").alias(b), copies.cast("long").alias("c")).groupBy(a, b).agg(F.sum("c").alias("c"), F.count("*").alias("r"))
    totals = totals.select(a, b, F.floor(F.col("c") / F.col("r")).cast("int").alias(each), (F.col("c") % F.col("r")).cast("int").alias(rest))
    totals = written(totals, "mix-copies")
    k1, k2 = row_key(docs)
    rows = docs.select("*", k1.alias(a), k2.alias(b))
    columns = [quoted(c) for c in docs.columns]
    often = lambda n: F.explode(F.sequence(F.lit(1), F.col(n))).alias(copy)
    whole = rows.join(totals.where(F.col(each) > 0), [a, b]).select(*columns, often(each)).drop(copy)
    left = rows.join(totals.where(F.col(rest) > 0), [a, b]).dropDuplicates([a, b]).select(*columns, often(rest)).drop(copy)
    return whole.unionByName(left)
