"""The library tables, derived from the given tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    name = F.concat(F.when(F.col("doc_id") % 7 == 0, "screenshot ").otherwise(""), "source", F.lit("-"), "lang", F.lit("-"), "doc_id", F.when(F.col("doc_id") % 5 == 0, ".mp4").otherwise(".png"))
    return d.select(F.col("doc_id").alias("row_id"), name.alias("filename"), F.col("text").alias("ocr"), F.sha2("text", 256).alias("hash"), "source", "lang")


def media_vectors(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """rows and the image vector and phrase vector of each: vectors are reused in turn."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n = e.count()
    at = rows.withColumn("_v", F.col("row_id") % n).withColumn("_p", (F.col("row_id") + 1) % n)
    at = at.join(e.withColumnRenamed("vec_id", "_v"), "_v")
    return at.join(e.select(F.col("vec_id").alias("_p"), F.col("embedding").alias("phrase")), "_p").drop("_v", "_p")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.floor(F.col("vec_id") / 20)
    return table(spark, sf_dir, "embeddings").select(F.concat(F.lit("film-"), F.col("vec_id") % 20, F.lit(".mp4")).alias("filename"), (at * 7 + 3.5).cast("double").alias("t"), F.lit(7.0).alias("dur"), at.alias("poster"), "embedding", "vec_id")


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.concat(F.lit("conv-"), "conv_id", F.lit(".mp4")).alias("filename"), F.col("turn").alias("line"), (F.col("turn") * 6).cast("double").alias("t0"), (F.col("turn") * 6 + 5).cast("double").alias("t1"), "text", "role")


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, text (three words of an item and a source), vec."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    n = e.count()
    b = table(spark, sf_dir, "benchmark")
    text = F.concat(F.array_join(F.slice(F.split("text", " "), 1, 3), " "), F.lit(" src"), F.col("item_id") % 20)
    return b.select(F.col("item_id").alias("query_id"), text.alias("text"), (F.col("item_id") * 7 % n).alias("vec_id")).join(e, "vec_id").drop("vec_id")


MEDIA = """media AS (SELECT doc_id AS row_id, (CASE WHEN doc_id % 7 = 0 THEN 'screenshot ' ELSE '' END) || source || '-' || lang || '-' || doc_id
  || (CASE WHEN doc_id % 5 = 0 THEN '.mp4' ELSE '.png' END) AS filename, text AS ocr, sha256(text) AS hash, source, lang FROM documents)"""
VECTORS = """n AS (SELECT count(*) AS n FROM embeddings),
media_vectors AS (SELECT m.*, CAST(e.embedding AS DOUBLE[]) AS embedding, CAST(p.embedding AS DOUBLE[]) AS phrase FROM media m, n
  JOIN embeddings e ON e.vec_id = m.row_id % n.n JOIN embeddings p ON p.vec_id = (m.row_id + 1) % n.n)"""
SEGMENTS = """segments AS (SELECT 'film-' || (vec_id % 20) || '.mp4' AS filename, CAST(7 * (vec_id // 20) + 3.5 AS DOUBLE) AS t, CAST(7 AS DOUBLE) AS dur,
  vec_id // 20 AS poster, CAST(embedding AS DOUBLE[]) AS embedding, vec_id FROM embeddings)"""
UTTERANCES = """utterances AS (SELECT 'conv-' || conv_id || '.mp4' AS filename, turn AS line, CAST(turn * 6 AS DOUBLE) AS t0, CAST(turn * 6 + 5 AS DOUBLE) AS t1, text, role FROM conversations)"""
QUERIES = """queries AS (SELECT item_id AS query_id, array_to_string(list_slice(string_split(b.text, ' '), 1, 3), ' ') || ' src' || (item_id % 20) AS text,
  CAST(e.embedding AS DOUBLE[]) AS vec FROM benchmark b, (SELECT count(*) AS n FROM embeddings) k JOIN embeddings e ON e.vec_id = (b.item_id * 7) % k.n),
tokens AS (SELECT query_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: length(x) >= 2)) AS tokens FROM queries)"""
COSINE = "list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"

# Whether a text holds an e-mail address, written, bracketed or dictated, in SQL.
_LOCAL, _LABEL, _DOT = "[A-Za-z0-9][A-Za-z0-9._%+-]*", "[A-Za-z0-9-]+", r"(?:\[dots?\]|\(dots?\)|\{dots?\}|<dots?>|\bdots?\b)"
_END = r"[A-Za-z]{2,}(?:[^A-Za-z0-9]|$)"
_INNER = rf"(?:(?:\.|\s*{_DOT}\s*){_LABEL})*"
_LAST = rf"(?:\. ?|\s*{_DOT}\s*){_END}"
_AT = r"(?:\[at\]|\(at\)|\{at\}|<at>)"
HAS_EMAIL = " OR ".join(
    f"regexp_matches(replace(coalesce(ocr, ''), ',', '.'), '(?i){p}')"
    for p in (rf"{_LOCAL}@{_LABEL}{_INNER}{_LAST}", rf"{_LOCAL}\s*{_AT}\s*{_LABEL}{_INNER}{_LAST}", rf"{_LOCAL}\s*\bat\b\s*{_LABEL}{_INNER}\s*{_DOT}\s*(?:{_LABEL}(?:\.|\s*{_DOT}\s*))*{_END}")
)

CHUNKS = """chunks AS (SELECT 'film-' || (vec_id % 20) || '.mp4' AS filename, vec_id // 20 AS line, CAST(7 * (vec_id // 20) + 1 AS DOUBLE) AS t0, CAST(7 * (vec_id // 20) + 6 AS DOUBLE) AS t1, coalesce(d.text, '') AS text, CAST(embedding AS DOUBLE[]) AS embedding
  FROM embeddings JOIN (SELECT doc_id, text FROM documents) d ON d.doc_id = (vec_id * 3) % (SELECT count(*) FROM documents))"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spoken stretches of the films, with a vector each."""
    docs = table(spark, sf_dir, "documents")
    n, at = docs.count(), F.floor(F.col("vec_id") / 20)
    e = table(spark, sf_dir, "embeddings").withColumn("doc_id", F.col("vec_id") * 3 % n).join(docs.select("doc_id", "text"), "doc_id")
    return e.select(F.concat(F.lit("film-"), F.col("vec_id") % 20, F.lit(".mp4")).alias("filename"), at.alias("line"), (at * 7 + 1).cast("double").alias("t0"), (at * 7 + 6).cast("double").alias("t1"), F.coalesce("text", F.lit("")).alias("text"), "embedding")
