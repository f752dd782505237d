"""A training corpus from documents: five stages, each over all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import quoted, release, spare, written
from loomgraph.llm.language import fit, identify
from loomgraph.llm.lines import drop_common_lines
from loomgraph.llm.mixing import mix, mixed
from loomgraph.llm.pieces import encode
from loomgraph.llm.shingles import keep_one_each


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; `lang` becomes the language identified.

    The declared language is the old `lang` (null: says nothing), sources stand for hosts;
    each document is scored by what the labels of others say. Null and empty texts and
    those without letters go; of equally likely languages the first by name is taken;
    repeated rows share their fate. No rows or no labels at all: no document is left."""
    made = ("lang", *spare(docs.columns, "probability", "kept"))
    found = identify(docs, fit(docs), "text", host="source", declared="lang", held_out=True, made=made)
    return found.where(found[made[2]]).select(*_columns(docs))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that ten or more documents hold; documents of which
    nothing is left but white space go. n_chars follows the text.

    Each row is a document, so repeated rows count as often as they are there. Null and
    empty texts have nothing left, so they go; an empty table gives an empty one."""
    made = spare(docs.columns, "n_lines", "n_dropped", "kept_text")
    rows = drop_common_lines(docs, min_docs=10, made=tuple(made))
    rows = rows.where(F.regexp_like(made[2], F.lit("[^\\x20\\x09-\\x0D]")))
    kept = {"text": F.col(made[2]), "n_chars": F.length(made[2]).cast("long")}
    return rows.select(*[kept[c].alias(c) if c in kept else column for c, column in zip(docs.columns, _columns(docs))])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at Jaccard 0.8 or more: the
    one with the least id, of rows with one id a single one.

    Texts without words (null, empty) link with nothing and stay, as do documents with a
    null id; an empty table gives an empty one."""
    return keep_one_each(docs, n=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: whole epochs repeat rows.

    Weights of documents come from the table labels. Documents without words (null,
    empty) are taken once; null sources are a source of their own, the last; rows that
    are alike add up; an empty table gives an empty one."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return mixed(docs, mix(docs, labels=labels))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the whole texts, their number and the decoded text's digest. Null and empty
    texts have no ids; every row gives one, so repeated rows repeat; an empty table
    gives an empty one."""
    return encode(docs, public_tokenizers.path("piece_bpe_32k.model"), digest=True)


def _columns(docs: DataFrame) -> list:
    return [quoted(c) for c in docs.columns]


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("jaccard_join", drop_near_duplicates),
    ("source_mixing", mix_sources),
    ("piece_encoding", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and read again; a stage's rows go as soon
    as the next one's are written. Every table, empty ones too, goes through all stages."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The language model is fitted, so SQL can't give the rows; tests hold them against brute force.
ORACLE_SQL = None


def queries():
    return {"pipeline": run}


def oracle_sql():
    return {}
