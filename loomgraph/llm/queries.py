"""The queries opN_<name> of this subpackage and the SQL they are held against."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .extraction import extract
from .language import fit, identify
from .lines import drop_common_lines
from .mixing import mix
from .pieces import encode
from .scoring import train
from .shingles import link_near_duplicates
from .token_files import token_file_rows
from .vectors import link_vectors, top_k
from .word_scoring import score_words


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = encode(docs, public_tokenizers.path("piece_bpe_32k.model"), digest=True)
    return rows.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op2_vector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(table(spark, sf_dir, "embeddings"), cosine=0.95)


OP2 = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.95),
c AS (SELECT vec_id AS node, vec_id AS root FROM embeddings UNION SELECT l.y, c.root FROM c JOIN l ON c.node = l.x),
k AS (SELECT node, min(root) AS root FROM c GROUP BY node),
n AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, k.root AS component_id, e.vec_id = k.root AS kept
FROM embeddings e JOIN k ON e.vec_id = k.node LEFT JOIN n ON e.vec_id = n.x
"""


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_file_rows(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


OP4 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return mix(docs, labels=labels).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


OP5 = """
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, CAST(length(coalesce(text, '')) AS DOUBLE) AS n,
         CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END AS size
  FROM documents),
b AS (
  SELECT doc_id, source, size, md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(t)) AS digest,
         CASE WHEN n > 0 THEN least(10, floor(40 * (n - length(translate(t, '0123456789#$%&*|=<>{}[]^~_@', ''))) / n)) ELSE 0 END AS junk,
         CASE WHEN n > 0 THEN least(10, floor(40 * (n - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) / n)) ELSE 0 END AS upper,
         CASE WHEN size > 0 THEN least(10, floor(n / size)) ELSE 0 END AS length
  FROM d),
known AS (SELECT doc_id, max(quality) > 0 AS good FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id),
met AS (SELECT b.*, known.good FROM b JOIN known ON b.doc_id = known.doc_id),
whole AS (SELECT count(*) FILTER (good) AS good, count(*) FILTER (NOT good) AS bad FROM met),
bins AS (SELECT f, bin, count(*) FILTER (good) AS good, count(*) FILTER (NOT good) AS bad
         FROM (SELECT good, unnest(['junk', 'upper', 'length']) AS f, unnest([junk, upper, length]) AS bin FROM met) GROUP BY f, bin),
ratio AS (SELECT x.f, x.bin, ln((coalesce(bins.good, 0) + 1) / (whole.good + 11)) - ln((coalesce(bins.bad, 0) + 1) / (whole.bad + 11)) AS r
          FROM (SELECT unnest(['junk', 'upper', 'length']) AS f, bin FROM (SELECT CAST(unnest(range(11)) AS DOUBLE) AS bin)) x
          CROSS JOIN whole LEFT JOIN bins ON bins.f = x.f AND bins.bin = x.bin),
q AS (
  SELECT b.doc_id, b.source, b.size, b.digest, 0.01::DOUBLE + (1 - 0.01::DOUBLE) / (1 + exp(-(ln((whole.good + 1) / (whole.bad + 1)) + x.r + y.r + z.r))) AS w
  FROM b CROSS JOIN whole JOIN ratio x ON x.f = 'junk' AND x.bin = b.junk JOIN ratio y ON y.f = 'upper' AND y.bin = b.upper JOIN ratio z ON z.f = 'length' AND z.bin = b.length),
keyed AS (
  SELECT *, -ln((CAST(CAST('0x' || substr(digest, 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0) / w AS k FROM q),
s AS (
  SELECT source, sum(size)::DOUBLE AS n,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w
  FROM keyed GROUP BY source),
f AS (
  SELECT *, coalesce(sum(2 * n) OVER (ORDER BY 2 * n / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
         sum(w) OVER (ORDER BY 2 * n / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
         sum(n) OVER () * 1.5 AS whole
  FROM s),
g AS (SELECT (whole - filled) / rest AS level FROM f WHERE (whole - filled) / rest * w <= 2 * n ORDER BY 2 * n / w, source LIMIT 1),
t AS (SELECT source, n, least(coalesce((SELECT level FROM g), 1e300) * w, 2 * n) AS target FROM f),
r AS (
  SELECT k.doc_id, k.size, t.n, t.target,
         CASE WHEN t.n > 0 THEN floor(floor(t.target) / t.n) ELSE 0 END AS epochs,
         coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.k, k.doc_id, k.digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM keyed k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(n AS BIGINT) AS source_size, target,
       CAST(epochs * size + greatest(0, least(size, floor(target) - epochs * n - ahead)) AS BIGINT) AS taken
FROM r
"""


def op6_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_words(docs, train(docs)).drop("text")


def op7_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page (declared by markup, hosts from addresses) and every document (declared
    by its lang column, sources as hosts; scored by what other documents' labels say); a
    row has page_id or doc_id."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("lang").alias("declared"), "source")
    model = fit(docs, label="declared")
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    of_pages = identify(pages, model, "html", url="url", markup=True, columns=["page_id"])
    of_docs = identify(docs, model, "text", host="source", declared="declared", held_out=True, columns=["doc_id"])
    made = ["lang", "probability", "kept"]
    none = F.lit(None).cast("long")
    return of_docs.select("doc_id", none.alias("page_id"), *made).unionByName(of_pages.select(none.alias("doc_id"), "page_id", *made))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return link_near_duplicates(docs, n=5, percent=80)


OP9 = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                             '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
g AS (
  SELECT doc_id, CASE WHEN words IS NULL OR len(words) = 0 THEN []
                      ELSE list_distinct(list_transform(range(1, greatest(2, len(words) - 3)),
                                                        lambda i: array_to_string(list_slice(words, i, i + 4), ' '))) END AS grams FROM w),
s AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM g),
d AS (SELECT gram FROM s GROUP BY gram HAVING count(*) > 1),
r AS (SELECT s.* FROM s JOIN d ON s.gram = d.gram),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS o
      FROM r a JOIN r b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM o WHERE 100 * o >= 80 * (n + m - o)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
c AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.y, c.root FROM c JOIN e ON c.node = e.x),
k AS (SELECT node, min(root) AS root FROM c GROUP BY node)
SELECT g.doc_id, CAST(len(g.grams) AS BIGINT) AS n_shingles, k.root AS component_id FROM g JOIN k ON g.doc_id = k.node
"""


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = drop_common_lines(docs, min_docs=10)
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP10 = """
WITH l AS (
  SELECT row, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos
  FROM (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
h AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT row) >= 10)
SELECT doc_id, count(*) AS n_lines, count(h.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE h.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN h ON k.key = h.key GROUP BY row, doc_id
"""


def queries():
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql():
    return {"op2_vector_links": OP2, "op4_top_k": OP4, "op5_mixing": OP5, "op9_jaccard": OP9, "op10_lines": OP10}
