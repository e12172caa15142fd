"""Vector expressions over ARRAY columns, in double precision and array order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tokens import let


def dot(a: Column, b: Column) -> Column:
    """Over the shorter length."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))  # the longer one is paired with nulls
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine_pre(a: Column, b: Column, norm_a: Column, norm_b: Column) -> Column:
    """0 where a norm is 0; norms are computed once a row, not once a pair."""
    return F.when((norm_a == 0) | (norm_b == 0), F.lit(0.0)).otherwise(dot(a, b) / (norm_a * norm_b))


def cosine(a: Column, b: Column) -> Column:
    return cosine_pre(a, b, norm(a), norm(b))


def l2_normalize(a: Column) -> Column:
    return let(F.struct(a.alias("a"), norm(a).alias("n")), lambda s: F.when(s["n"] > 0, F.transform(s["a"], lambda x: x.cast("double") / s["n"])))


def is_zero_vector(a: Column) -> Column:
    return F.coalesce(F.forall(a, lambda x: x == 0), F.lit(True))


def vector_problem(a: Column, dim: int) -> Column:
    """Why a vector can't be used, or null."""
    return (
        F.when(a.isNull() | (F.size(a) == 0), F.lit("empty"))
        .when(F.size(a) != dim, F.lit("wrong dimension"))
        .when(F.exists(a, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))), F.lit("not finite"))
    )


def text_mean(df: DataFrame, by: list[str], vector: str) -> DataFrame:
    """by..., vec: the normed mean of the vectors of a group, summed by position."""
    flat = df.select(*by, F.posexplode(vector).alias("pos", "x"))
    per = flat.groupBy(*by, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    mean = per.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("vec"))
    return mean.withColumn("vec", l2_normalize(F.col("vec")))


def centred(a: Column, mean: Column) -> Column:
    """a without its part along mean, renormed; null if next to nothing is left."""
    rest = let(dot(a, mean), lambda d: F.zip_with(a, mean, lambda x, m: x.cast("double") - d * m))
    far = let(rest, lambda r: F.when(norm(r) > 1e-6, l2_normalize(r)))
    return F.when(mean.isNull() | (F.size(a) != F.size(mean)), F.transform(a, lambda x: x.cast("double"))).otherwise(far)


def validated(df: DataFrame, vector: str, dim: int) -> tuple[DataFrame, DataFrame]:
    """(rows whose vector can be used, the others with the reason)."""
    both = df.withColumn("reason", vector_problem(F.col(vector), dim))
    return both.where("reason IS NULL").drop("reason"), both.where("reason IS NOT NULL")


def mean_direction(df: DataFrame, by: list[str], vector: str) -> DataFrame:
    """by..., vec: the normed sum of a group's vectors; null if their lengths differ or the sum is nothing.
    Sums are made by position and combined before they meet."""
    same = df.groupBy(*by).agg((F.min(F.size(vector)) == F.max(F.size(vector))).alias("same"))
    flat = df.select(*by, F.posexplode(vector).alias("pos", "x"))
    per = flat.groupBy(*by, "pos").agg(F.sum(F.col("x").cast("double")).alias("x"))
    total = per.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("vec"))
    return total.join(same, by).select(*by, F.when(F.col("same"), l2_normalize(F.col("vec"))).alias("vec"))


def fold_frames(frames: Column) -> Column:
    """ARRAY<STRUCT<idx, vec>> -> vec: frame after frame is added and the sum normed each time, so order counts."""
    ordered = F.transform(F.array_sort(frames), lambda f: F.transform(f["vec"], lambda x: x.cast("double")))

    def added(s: Column, v: Column) -> Column:
        total = F.zip_with(s, v, lambda a, b: a + b)
        return F.when(norm(total) > 0, l2_normalize(total)).otherwise(s)

    return F.when(F.size(ordered) > 0, F.aggregate(F.slice(ordered, 2, F.size(ordered)), F.get(ordered, F.lit(0)), added))


def query_templates(text: Column) -> Column:
    """ARRAY of what is embedded for a query: itself and, from four characters on, two sentences around it."""
    q = F.trim(F.coalesce(text, F.lit("")))
    return F.when(F.length(q) >= 4, F.array(q, F.concat(F.lit("a photo of "), q), F.concat(F.lit("a screenshot of "), q))).otherwise(F.array(q))


def expand_templates(queries: DataFrame, vectors: DataFrame, mean: Column | None = None) -> DataFrame:
    """queries(query_id, text), vectors(text, vec) of the sentences -> query_id, vec: their mean direction, centred if there is a mean."""
    asked = queries.select("query_id", F.explode(query_templates(F.col("text"))).alias("text")).join(vectors, "text")
    out = mean_direction(asked, ["query_id"], "vec")
    return out if mean is None else out.withColumn("vec", centred(F.col("vec"), mean))


_prefixed = r"(?i)^(task|title)\s*:"


def query_prefix(text: Column) -> Column:
    t = F.trim(F.coalesce(text, F.lit("")))
    return F.when(t.rlike(_prefixed), t).otherwise(F.concat(F.lit("task: search result | query: "), t))


def document_prefix(text: Column, title: Column) -> Column:
    t, name = F.trim(F.coalesce(text, F.lit(""))), F.trim(F.coalesce(title, F.lit("")))
    return F.when(t.rlike(_prefixed), t).otherwise(F.concat(F.lit("title: "), F.when(name == "", F.lit("none")).otherwise(name), F.lit(" | text: "), t))


def percentile_nearest(name: str, p: float) -> Column:
    """Aggregate over the column of that name: the value at place ceil(p n), counted from 1."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY `{name}`)")
