"""Mixing sources to target weights by entropy balancing.

Every document has a rate r in [0, 2]. Rates of a source minimise the sum over
its documents of r log r + (2-r) log(2-r), an entropy about rate 1, under the one
constraint that rate times size sums to the source's target. The solution is an
exponential tilt of the odds, r / (2-r) = exp(lam * x), with x the size over the
source's mean size. The dual is convex in lam; its Newton steps need two sums a
source, taken over the (source, size) histogram of the whole corpus by Spark in
each iteration and guarded by a bracket. Rates become copies by carrying the
rounding error from large documents to small ones inside bounded cells of a
source, so that what a source takes differs from its target by a few words a cell.

Cases: null text or size counts 0 and takes 0; a null source is a source of its
own, the last; a source of size 0 has target 0; repeated rows are rows; an empty
table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small, table, written

WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2.0
WORD = r"[^\x20\x09-\x0D]+"
#: Documents of a cell, in which rounding errors are carried, on average at most.
CELL = 2_000
ROUNDS, CLOSE = 40, 1e-9


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size): size counts the words of the whole text."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def numbered(spark: SparkSession, per: DataFrame) -> DataFrame:
    """per with `place`, 0 and on by source (code points, null last). Sources can be many
    (domains), so they are dealt by range and each range counts from where the one before ends."""
    ordered = per.orderBy(F.col("source").asc_nulls_last()).withColumn("id", F.monotonically_increasing_id())
    ordered = written(spark, ordered.withColumn("part", F.shiftright("id", 33)).withColumn("own", F.col("id").bitwiseAND((1 << 33) - 1)), "mix-sources")
    sizes = sorted((r.part, r.n) for r in ordered.groupBy("part").agg(F.count("*").alias("n")).collect())  # a row for each range
    starts, at = [], 0
    for part, n in sizes:
        starts.append((part, at))
        at += n
    starts = spark.createDataFrame(starts, "part long, start long")
    return ordered.join(F.broadcast(starts), "part").withColumn("place", F.col("start") + F.col("own")).drop("id", "part", "own", "start")


def targets(spark: SparkSession, rows: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, n_docs, target) by water-filling: sources whose cap lies below
    weight times level are full, the others share what is left by weight. The level rises
    from round to round, each one sum over the sources, until no more of them are full."""
    per = numbered(spark, rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")))
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    per = per.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(most))
    level = 0.0
    while True:
        full = F.col("cap") <= F.col("w") * F.lit(level)
        s = per.agg(F.sum("source_size").alias("total"), F.sum(F.when(full, F.col("cap")).otherwise(0.0)).alias("caps"), F.sum(F.when(~full, F.col("w")).otherwise(0.0)).alias("w")).first()
        if not s.w:  # all are full, or there are none
            level = math.inf
            break
        now = (float(s.total) * share - s.caps) / s.w
        if now <= level * (1 + 1e-12):
            break
        level = now
    target = F.col("cap") if level == math.inf else F.least("cap", F.col("w") * F.lit(level))
    return per.select("source", "source_size", "n_docs", target.cast("double").alias("target"))


def multipliers(spark: SparkSession, rows: DataFrame, per: DataFrame) -> DataFrame:
    """(source, lam): safeguarded Newton on the dual, all sources at once."""
    hist = written(spark, rows.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n")), "mix-hist")
    state = per.where("source_size > 0 AND target > 0 AND target < source_size * 2").select("source", "target", (F.col("source_size") / F.col("n_docs")).alias("mean"), F.lit(0.0).alias("lam"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), F.lit(False).alias("done"))
    state = written(spark, state, "mix-state")
    for _ in range(ROUNDS):
        x = F.col("size") / F.col("mean")
        p = 1 / (1 + F.exp(-F.col("lam") * x))
        joined = hist.join(small(state.where("NOT done")), hist["source"].eqNullSafe(state["source"])).drop(hist["source"])
        sums = joined.groupBy("source").agg(F.sum(2 * p * F.col("size") * F.col("n")).alias("f"), F.sum(2 * p * (1 - p) * x * F.col("size") * F.col("n")).alias("g"))
        sums = sums.withColumnRenamed("source", "of")
        joined = state.join(sums, state["source"].eqNullSafe(sums["of"]), "left")
        off = F.col("f") - F.col("target")
        lo, hi = F.when(off < 0, F.col("lam")).otherwise(F.col("lo")), F.when(off > 0, F.col("lam")).otherwise(F.col("hi"))
        step = F.col("lam") - off / F.greatest("g", F.lit(1e-300))
        inside = (lo.isNull() | (step > lo)) & (hi.isNull() | (step < hi)) & (F.abs(step - F.col("lam")) < 50)
        fallback = F.when(lo.isNull(), hi - 2 - F.abs(hi)).when(hi.isNull(), lo + 2 + F.abs(lo)).otherwise((lo + hi) / 2)
        done = F.col("done") | (F.abs(off) <= F.col("target") * CLOSE)
        state = joined.select("source", "target", "mean", F.when(done, F.col("lam")).when(inside, step).otherwise(fallback).alias("lam"), lo.alias("lo"), hi.alias("hi"), done.alias("done")).checkpoint()
        if not state.where("NOT done").limit(1).count():
            break
    return state.select("source", "lam", "mean")


def rounded(rows):
    """One cell: copies from rates, the error carried from large to small documents."""
    rows = rows.sort_by([("size", "descending"), ("doc_id", "ascending")])
    size, rate = rows["size"].to_numpy().astype(float), rows["rate"].to_numpy()
    copies, carry = np.zeros(len(size), np.int64), 0.0
    for i in range(len(size)):
        if size[i] > 0:
            want = rate[i] * size[i] + carry
            copies[i] = min(2, max(0, math.floor(want / size[i] + 0.5)))
            carry = want - copies[i] * size[i]
    return rows.select(["doc_id", "source", "size"]).append_column("copies", pa.array(copies, pa.int64())).append_column("rate", rows["rate"])


def mix(spark: SparkSession, rows: DataFrame, weights=WEIGHTS, share: float = SHARE) -> DataFrame:
    """rows(doc_id, source, size) -> doc_id, source, size, source_size, target, rate, copies, taken."""
    shared_rows = rows.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.coalesce(F.col("size"), F.lit(0)).cast("long").alias("size"))
    shared_rows = written(spark, shared_rows, "mix-rows")
    per = written(spark, targets(spark, shared_rows, weights, share), "mix-targets")
    lam = multipliers(spark, shared_rows, per)
    lam = lam.withColumnRenamed("source", "of")
    per = per.join(lam, per["source"].eqNullSafe(lam["of"]), "left").drop("of")
    per = small(per.select(F.col("source").alias("of"), "source_size", "n_docs", "target", "lam", "mean"))
    both = shared_rows.join(per, shared_rows["source"].eqNullSafe(per["of"])).drop("of")
    rate = F.when(F.col("lam").isNotNull(), 2 / (1 + F.exp(-F.col("lam") * F.col("size") / F.col("mean")))).when(F.col("target") > 0, F.lit(2.0)).otherwise(F.lit(0.0))
    both = both.withColumn("rate", rate).withColumn("cell", F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("size"))), F.ceil(F.col("n_docs") / CELL)))
    out = both.groupBy("source", "cell").applyInArrow(rounded, "doc_id long, source string, size long, copies long, rate double")
    out = out.join(per, out["source"].eqNullSafe(per["of"]))
    return out.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(spark, sized(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")
