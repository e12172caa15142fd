"""Five stages from documents to packed token sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before
kept; all but the last return the columns of documents. Null doc_ids pass the
first three stages and are never joined with anything; of rows that repeat a doc_id and
its text the near-duplicate stage keeps the least, and other texts under one doc_id are
documents of their own. Extra columns stay as they are, whatever their names and
types; of repeated rows the least is the one whose JSON is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memquarry.llm import language_id, mixing, ngram_join, packing, suffix_dedup
from memquarry.llm.common import SCRATCH, bounded_batches, crc_mod, quoted, removed, small, table, written


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, and those whose best language is no likelier than chance, 1 in the number of languages."""
    bounded_batches(spark)
    model = language_id.train(docs, crc_mod("doc_id", 4) != 2)
    out = language_id.predict(docs, model, with_rows=True)
    n = len(model["langs"]) if model else 0
    chance = 1 / n + 1e-6 if n > 1 else 0.0
    return out.where((F.col("lang_pred") != language_id.UND) & (F.col("score") > chance)).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays (five words, similarity 0.8)."""
    ids = docs.where("doc_id IS NOT NULL").agg(F.count("doc_id"), F.count_distinct("doc_id")).first()
    if ids[0] != ids[1]:
        row = F.struct(*map(quoted, docs.columns))
        one = docs.where("doc_id IS NOT NULL").groupBy("doc_id", "text").agg(F.min_by(row, F.to_json(row)).alias("row"))
        # keys in the order of doc_ids, so that the least doc_id of a class stays
        one = one.orderBy("doc_id", "text").select(F.monotonically_increasing_id().alias("key"), "row")
        one = written(spark, one, "pipeline-rows")
        classes = ngram_join.ngram_classes(spark, one.select(F.col("key").alias("doc_id"), F.col("row.text").alias("text")))
        kept = one.join(small(classes.where("doc_id <> component_id").select(F.col("doc_id").alias("key"))), "key", "left_anti")
        return kept.select("row.*").union(docs.where("doc_id IS NULL"))
    classes = ngram_join.ngram_classes(spark, docs)
    return docs.join(small(classes.where("doc_id <> component_id").select("doc_id")), "doc_id", "left_anti").select(*map(quoted, docs.columns))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller doc_id has go; characters cut in half go with them."""
    out = suffix_dedup.repeated_passages(spark, docs, characters=True).withColumn("text", F.col("kept").cast("string"))
    own = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*(own.get(c, F.col("rest")[c]).alias(c) for c in docs.columns))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice. Documents without an id are told apart by their texts."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text", F.lit(5)))
    out = mixing.mix(spark, mixing.sized(docs.select(key.alias("doc_id"), "text", "source"))).where("copies > 0")
    copies = out.groupBy(F.col("doc_id").alias("of"), F.col("source").alias("from"), F.col("size").alias("words")).agg(F.max("copies").alias("copies"))
    words = F.coalesce(F.regexp_count("text", F.lit(mixing.WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.struct(*map(quoted, docs.columns)).alias("row"), key.alias("key"), F.col("source").alias("home"), words.alias("size"))
    both = rows.join(small(copies), (F.col("key") == F.col("of")) & F.col("home").eqNullSafe(F.col("from")) & (F.col("size") == F.col("words")))
    return both.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of 2048 tokens."""
    import public_tokenizers

    return packing.pack_documents(spark, docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", languages),
    ("ngram_jaccard_join", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("source_mixing", mixed),
    ("best_fit_packing", sequences),
]
#: SQL can't express tokenisation and packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        before = set(SCRATCH)
        docs = written(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
        own = SCRATCH[-1]  # with it, what the stage has left and what it read are read no more
        removed(spark, [p for p in SCRATCH if p not in before and p != own] + last)
        last = [own]
    return STAGES[-1][1](spark, docs, sf_dir)
