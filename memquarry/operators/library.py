"""Joins, aggregates and plans that keep a library in order."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.emails import has_email
from ..functions.media import category, is_video
from ..functions.vectors import dot, is_zero_vector
from ..sources.manifest import counted_from, scratch_folder


def drop_known_content(batch: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of the batch whose content no row before the batch has."""
    return batch.join(known.select("hash").distinct(), "hash", "left_anti")


def content_classes(media: DataFrame) -> DataFrame:
    return media.groupBy("hash").agg(F.count("*").alias("copies"), F.min("row_id").alias("first_row")).where("copies > 1")


def tab_counts(media: DataFrame, overrides: DataFrame) -> DataFrame:
    both = media.join(overrides, "hash", "left")
    tab = category(F.col("filename"), F.lit(None).cast("string"), F.lit(None).cast("boolean"), F.col("override"))
    tabs = F.filter(F.array(F.lit("All"), F.when(has_email(F.col("ocr")), F.lit("Email")), tab), lambda t: t.isNotNull())
    return both.select(F.explode(tabs).alias("tab")).groupBy("tab").agg(F.count("*").alias("n"))


def filter_tab(media: DataFrame, tab: str) -> DataFrame:
    """Rows of one tab: All, Email (beside the others), or a category; media has `category`."""
    if tab == "All":
        return media
    return media.where(has_email(F.col("ocr"))) if tab == "Email" else media.where(F.col("category") == tab)


def filter_channel(media: DataFrame, sources: DataFrame, channel: str | None = None) -> DataFrame:
    """Films with a source, of one channel if it is named."""
    own = sources.select("filename", F.coalesce(F.nullif(F.trim("channel"), F.lit("")), F.lit("Unknown channel")).alias("_channel")).distinct()
    own = own if channel is None else own.where(F.col("_channel") == channel)
    return media.where(is_video(F.col("filename"))).join(own.select("filename").distinct(), "filename", "left_semi")


def channel_counts(media: DataFrame, sources: DataFrame) -> DataFrame:
    """Distinct files a channel; files without one are of an unknown channel."""
    both = media.where(is_video(F.col("filename"))).join(sources, "filename").withColumn("channel", F.coalesce(F.nullif(F.trim("channel"), F.lit("")), F.lit("Unknown channel")))
    return both.groupBy("channel").agg(F.count_distinct("filename").alias("files"))


#: Seconds of film that one window of nearest_poster sorts.
STRETCH = 600.0


def nearest_poster(hits: DataFrame, segments: DataFrame, stretch: float = STRETCH) -> DataFrame:
    """For each hit (filename, t) the segment of that film nearest in time, the first of
    equals: the last at or before, or the first after. Both are found by windows over the
    union of hits and segments in stretches of film; what a stretch needs of others is one
    segment on either side, so that however much meets in one film, it is many small sorts."""
    kind = "struct<t:double,poster:bigint>"
    events = hits.select("filename", "hit_id", "t", F.lit(1).alias("kind"), F.lit(None).cast(kind).alias("seg"))
    marks = segments.select("filename", F.lit(None).cast("bigint").alias("hit_id"), "t", F.lit(0).alias("kind"), F.struct("t", F.col("poster").cast("bigint").alias("poster")).alias("seg"))
    rows = events.unionByName(marks).withColumn("part", F.floor(F.col("t") / stretch))
    ends = rows.groupBy("filename", "part").agg(F.max_by("seg", F.when(F.col("kind") == 0, F.struct("t", -F.col("seg.poster")))).alias("last"), F.min_by("seg", F.when(F.col("kind") == 0, F.struct("t", "seg.poster"))).alias("first"))
    over = Window.partitionBy("filename").orderBy("part")  # a row for each stretch
    ends = ends.withColumn("left", F.last("last", True).over(over.rowsBetween(Window.unboundedPreceding, -1))).withColumn("right", F.first("first", True).over(over.rowsBetween(1, Window.unboundedFollowing)))
    by = Window.partitionBy("filename", "part").orderBy("t", "kind", F.col("seg.poster").desc())
    after = Window.partitionBy("filename", "part").orderBy(F.col("t").desc(), F.col("kind"), F.col("seg.poster").desc())
    rows = rows.withColumn("before", F.last("seg", True).over(by)).withColumn("after", F.last("seg", True).over(after)).where("kind = 1")
    rows = rows.join(ends.select("filename", "part", "left", "right"), ["filename", "part"])
    rows = rows.withColumn("before", F.coalesce("before", "left")).withColumn("after", F.coalesce("after", "right"))
    near = F.when(F.col("after").isNull() | (F.col("t") - F.col("before.t") <= F.col("after.t") - F.col("t")), F.col("before")).otherwise(F.col("after"))
    return rows.select("hit_id", "filename", "t", near["poster"].alias("poster"))


def line_windows(lines: DataFrame, seconds: float = 8.0) -> DataFrame:
    """Lines of a film and those that begin within so many seconds after: an interval
    join made equi by buckets of that width."""
    width = F.lit(seconds)
    a = lines.select("filename", F.col("line").alias("line_a"), F.col("t0").alias("ta")).withColumn("bucket", F.explode(F.array(F.floor(F.col("ta") / width), F.floor(F.col("ta") / width) + 1)))
    b = lines.select("filename", F.col("line").alias("line_b"), F.col("t0").alias("tb")).withColumn("bucket", F.floor(F.col("tb") / width))
    return a.join(b, ["filename", "bucket"]).where((F.col("tb") >= F.col("ta")) & (F.col("tb") <= F.col("ta") + width)).select("filename", "line_a", "line_b")


def tolerance_diff(a: DataFrame, b: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """(side, filename, t): cuts without a partner within the tolerance on the other side."""

    def alone(x: DataFrame, y: DataFrame, side: str) -> DataFrame:
        at = F.floor(F.col("t") / tolerance)
        x = x.select("filename", "t").withColumn("bucket", at)
        y = y.select(F.col("filename").alias("f"), F.col("t").alias("u"), F.explode(F.array(at - 1, at, at + 1)).alias("b"))
        hit = (F.col("filename") == F.col("f")) & (F.col("bucket") == F.col("b")) & (F.abs(F.col("t") - F.col("u")) <= tolerance)
        return x.join(y, hit, "left_anti").select(F.lit(side).alias("side"), "filename", "t")

    return alone(a, b, "missing").unionByName(alone(b, a, "extra"))


def _best_dots(asked: list):
    """Of each batch, for each model and query, the greatest dot product with a vector of the query's length."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    from .search import Vectors

    held = Vectors(asked)
    sizes, models = np.array([len(r.vec or ()) for r in asked]), np.array([r.model for r in asked], object)
    ids, genuine = np.array([r.query_id for r in asked]), np.array([r.genuine for r in asked])

    def run(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            dots = held.dots(table["embedding"])
            fits = sizes[:, None] == pc.fill_null(pc.list_value_length(table["embedding"]), -1).to_numpy()[None]
            model = np.array(table["model"].to_pylist(), object)
            for m in set(model.tolist()):
                allowed = fits & (model == m)[None] & np.array([x is None or x == m for x in models])[:, None]
                q = np.flatnonzero(allowed.any(1))
                best = np.where(allowed[q], dots[q], -np.inf).max(1) if len(q) else np.zeros(0)
                yield pa.record_batch({"model": pa.array([m] * len(q), pa.string()), "genuine": genuine[q], "query_id": pa.array(ids[q], pa.int64()), "best": best})

    return run


def calibrate(vectors: DataFrame, noise: DataFrame, genuine: DataFrame | None = None) -> DataFrame:
    """min_score from the best match of meaningless queries, lowered to half of the weakest
    best match of genuine ones where it is above that; (…, vec) tables, small. One row a
    model_id if the vectors have one (queries that have one too meet only their model), no
    row without noise. A query of another dimension than the vectors plays no part."""
    from .search import chunks, union

    model = ["model_id"] if "model_id" in vectors.columns else []
    own = lambda q: F.col("model_id").cast("string") if model and "model_id" in q.columns else F.lit(None).cast("string")
    asked = noise.select("query_id", "vec", own(noise).alias("model"), F.lit(False).alias("genuine"))
    if genuine is not None:
        asked = asked.unionByName(genuine.select("query_id", "vec", own(genuine).alias("model"), F.lit(True).alias("genuine")))
    rows = vectors.select("embedding", (F.col("model_id").cast("string") if model else F.lit(None).cast("string")).alias("model"))
    parts = [rows.mapInArrow(_best_dots(some), "model string, genuine boolean, query_id long, best double") for some in chunks(asked)]
    if not parts:
        return vectors.sparkSession.createDataFrame([], "min_score double, keep double")
    kind = dict(vectors.dtypes).get("model_id", "string")
    best = union(parts).withColumn("model_id", F.col("model").cast(kind)).groupBy(*model, "genuine", "query_id").agg(F.greatest(F.max("best"), F.lit(0.0)).alias("best"))
    ends = best.groupBy(*model).agg(F.max(F.when(~F.col("genuine"), F.col("best"))).alias("ceiling"), F.min(F.when(F.col("genuine"), F.col("best"))).alias("weakest")).where("ceiling IS NOT NULL")
    floor = F.least(F.lit(0.1), F.greatest(F.lit(0.01), F.col("ceiling") * 2))
    floor = F.least(floor, F.when(F.col("weakest").isNotNull(), F.greatest(F.lit(0.01), F.col("weakest") * 0.5)))
    return ends.select(*model, F.round(floor, 4).alias("min_score"), F.lit(0.6).alias("keep"))


def retrieval_quality(ranked: DataFrame, truth: DataFrame) -> DataFrame:
    """Queries, top-1 hits, mean reciprocal rank and hits in the first three."""
    first = ranked.join(truth, ["query_id", "vec_id"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("rank"))
    every = truth.select("query_id").distinct().join(first, "query_id", "left")
    return every.agg(F.count("*").alias("n"), F.count_if(F.col("rank") == 1).alias("top1"), F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 3).alias("mrr"), F.count_if(F.col("rank") <= 3).alias("top3"))


def score_band(ranked: DataFrame) -> DataFrame:
    per = ranked.groupBy("query_id").agg(F.max("score").alias("best"), F.min("score").alias("worst"))
    return per.agg(F.median("best").alias("median_best"), F.median("worst").alias("median_worst"))


def insights(results: DataFrame, k: int = 8) -> DataFrame:
    """For each file the queries that list it, the best first."""
    by = Window.partitionBy("filename").orderBy(F.col("score").desc(), "query_id")
    top = results.withColumn("nth", F.row_number().over(by)).where(F.col("nth") <= k)
    return top.select("filename", "nth", "query_id", "score")


def drop_adjacent_duplicates(lines: DataFrame) -> DataFrame:
    before = F.lag(F.lower("text")).over(Window.partitionBy("filename").orderBy("t0", "line"))
    return lines.withColumn("_b", before).where(F.col("_b").isNull() | (F.col("_b") != F.lower("text"))).drop("_b")


def footage_facts(media: DataFrame, segments: DataFrame) -> DataFrame:
    ends = segments.groupBy("filename").agg(F.max_by(F.col("t") + F.col("dur") / 2, F.col("t")).alias("end"))
    return media.where(is_video(F.col("filename"))).join(ends, "filename", "left").agg(F.count("*").alias("videos"), F.coalesce(F.sum("end"), F.lit(0.0)).alias("known_seconds"), F.count_if(F.col("end").isNull()).alias("unknown"))


def plan_slices(durations: DataFrame, step: float = 30.0, read: float = 35.0) -> DataFrame:
    """ceil(duration / step) slices, each read a little into the next."""
    n = F.greatest(F.ceil(F.col("duration") / step).cast("int"), F.lit(1))
    cut = durations.withColumn("i", F.explode(F.sequence(F.lit(0), n - 1)))
    return cut.select("filename", "i", (F.col("i") * step).alias("start"), F.least(F.lit(read), F.col("duration") - F.col("i") * step).alias("dur"))


def corrupt_phrases(vectors: DataFrame) -> DataFrame:
    """Phrase vectors that are next to nothing, or the image vector itself."""
    p = F.col("phrase")
    return vectors.where((dot(p, p) < 1e-6) | (dot(p, F.col("embedding")) > 0.9999)).select("row_id", "filename")


def missing_children(media: DataFrame, children: DataFrame) -> DataFrame:
    return media.where(is_video(F.col("filename"))).join(children.select("filename").distinct(), "filename", "left_anti").select("filename")


def drop_orphans(children: DataFrame, media: DataFrame) -> DataFrame:
    return children.join(media.select("filename").distinct(), "filename", "left_semi")


def orphan_counts(tables: dict[str, DataFrame], media: DataFrame) -> DataFrame:
    """(part, kept, dropped) of child tables: rows whose file is there, and gone."""
    there, out = media.select("filename").distinct().withColumn("there", F.lit(1)), None
    for part, children in tables.items():
        both = children.join(there, "filename", "left")
        one = both.agg(F.count("there").alias("kept"), F.count_if(F.col("there").isNull()).alias("dropped")).select(F.lit(part).alias("part"), "kept", "dropped")
        out = one if out is None else out.union(one)
    return out


def match_cached(media: DataFrame, cached: DataFrame, vectors: list[str]) -> DataFrame:
    """Files with `cached`, what a cache has for their name (the first of its rows by `at`), and the
    reason: absent, zero where one of its vectors is null or all zeros, else reused."""
    first = cached.groupBy("filename").agg(F.min_by(F.struct(*vectors), "at").alias("cached"))
    bad = F.lit(False)
    for v in vectors:
        bad = bad | is_zero_vector(F.col(f"cached.{v}"))
    return media.join(first, "filename", "left").withColumn("reason", F.when(F.col("cached").isNull(), "absent").when(bad, "zero").otherwise("reused"))


#: Keys that have at least 1 of so many rows are broadcast: there are at most as many.
HOT = 100_000


def met(rows: DataFrame, per: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined with per, one row a key with its number of rows `n`: the few keys that hold
    many of all `total` rows by broadcast, the others by shuffle, where none is large."""
    often = F.col("n") * HOT >= total
    hot = F.broadcast(per.where(often))
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(per.where(~often), key))


def _slot(name: Column) -> tuple[Column, Column]:
    """(name, number) of which a numbered name is a place, or nulls: `a (3).png` is place 3 of `a.png`."""
    ext = F.regexp_extract(name, EXTENSION, 1)
    stem = F.substring(name, F.lit(1), F.length(name) - F.length(ext))
    digits = F.regexp_extract(stem, NUMBER, 2)
    place = F.when((F.length(digits) < 16) & ~digits.startswith("0") & (digits != "1") & (digits != ""), digits.cast("long"))
    return F.when(place.isNotNull(), F.concat(F.regexp_extract(stem, NUMBER, 1), ext)), place


# An extension begins at the last dot that isn't the first character; numbers of names.
EXTENSION, NUMBER = r"(?s)^.+(\.[^.]*)$", r"(?s)^(.*) \((\d+)\)$"


def assign_names(batch: DataFrame, media: DataFrame | None = None) -> DataFrame:
    """(row_id, name) -> row_id, assigned: the name if it is free, else `stem (n).ext` with
    the least n from 2 on that is. Names of the library and of earlier rows are taken.

    The k-th row of a name that doesn't get the name gets the k-th free number: places of rows
    and of taken numbers are counted by ranges, and a row finds how many taken numbers lie
    below its own by its place between them. A row that is itself named `a (3).png` holds
    that number only if no row of `a.png` got it before, which depends on who holds lower numbers.
    That is settled by rounds: a claim holds if the row that would get its number, by the free
    ones below, comes later. Lower numbers settle first, and all are right once a round changes nothing."""
    spark = batch.sparkSession
    folder, nth = scratch_folder(spark, "names"), itertools.count()
    path = lambda: f"{folder}/{next(nth)}"

    def kept(df: DataFrame) -> DataFrame:
        at = path()
        df.write.parquet(at)
        return spark.read.schema(df.schema).parquet(at)

    named = batch.select("row_id", "name").where("name IS NOT NULL").withColumn("_w", F.lit(1))
    rows, total = counted_from(named, "_w", ["name", "row_id"], path(), 0)
    rows = kept(rows.drop("_w"))
    per = kept(rows.groupBy("name").agg(F.count("*").alias("n"), F.min("start").alias("first"), F.min("row_id").alias("since")))
    parent, place = _slot(F.col("name"))
    known = per.select("name")
    library = (media.select(F.col("filename").alias("name")) if media is not None else known.limit(0)).where("name IS NOT NULL").distinct()
    taken = kept(library.select(parent.alias("name"), place.alias("place")).where("place IS NOT NULL").join(known, "name", "left_semi"))
    held = kept(library.join(known, "name", "left_semi"))
    # names of the batch that are places of other names of the batch and that the library lacks
    claims = per.select(F.col("name").alias("claim"), "since", parent.alias("name"), place.alias("place")).where("place IS NOT NULL").join(known, "name", "left_semi")
    claims = kept(claims.join(held.select(F.col("name").alias("claim")), "claim", "left_anti"))
    contested = claims.limit(1).count() > 0

    def given(won: DataFrame) -> tuple[DataFrame, DataFrame]:
        """((row_id, name, number), the claims that hold against it); number 1 is the name itself."""
        lost = claims.join(won.select("claim"), "claim", "left_anti").withColumn("_w", F.lit(0))
        unfree = held.union(lost.select(F.col("claim").alias("name"))).withColumn("unfree", F.lit(1))
        own = per.join(unfree, "name", "left").withColumn("own", 1 - F.coalesce("unfree", F.lit(0))).select("name", "n", "first", "own")
        k = kept(met(rows, own, "name", total).withColumn("k", F.col("start") - F.col("first") + 1 - F.col("own")).select("row_id", "name", "k"))
        holes = taken.withColumns({"claim": F.lit(None).cast("string"), "since": F.lit(None).cast(claims.schema["since"].dataType), "_w": F.lit(1)})
        holes = holes.unionByName(won.withColumn("_w", F.lit(1))).unionByName(lost)
        if not holes.limit(1).count():
            return k.select("row_id", "name", (F.col("k") + 1).alias("number")), won
        holes = kept(counted_from(holes, "_w", ["name", "place"], path(), 0)[0])
        begin = kept(holes.groupBy("name").agg(F.count("*").alias("n"), F.min("start").alias("begin")))
        # free numbers below each taken one; a row's number lies above those with fewer than its k
        holes = kept(met(holes, begin, "name", total).withColumn("k", F.col("place") - 2 - (F.col("start") - F.col("begin"))).select("name", "k", "claim", "since", "_w"))
        both = k.where("k > 0").join(begin.select("name"), "name", "left_semi").select("name", "k", "row_id", F.lit(0).alias("_w"))
        both = both.unionByName(holes.where("_w = 1").select("name", "k", F.lit(None).cast(rows.schema["row_id"].dataType).alias("row_id"), "_w"))
        both = kept(counted_from(both, "_w", ["name", "k", "_w", "row_id"], path(), 0)[0])
        base = both.groupBy("name").agg(F.count("*").alias("n"), F.min("start").alias("begin"))
        below = met(both.where("_w = 0"), base, "name", total).select("row_id", "name", (F.col("k") + 1 + F.col("start") - F.col("begin")).alias("number"))
        rest = k.where("k = 0").unionByName(k.where("k > 0").join(begin.select("name"), "name", "left_anti"))
        out = below.unionByName(rest.select("row_id", "name", (F.col("k") + 1).alias("number")))
        # a claimed number would go to the row after as many as there are free numbers below it
        rival = k.where("k > 0").select("name", (F.col("k") - 1).alias("k"), F.col("row_id").alias("rival"))
        now = holes.where("claim IS NOT NULL").join(rival, ["name", "k"], "left").where("rival IS NULL OR rival > since")
        return out, claims.join(now.select("claim"), "claim", "left_semi")

    won = claims  # at first as if no row of another name got in between
    out, now = given(won)
    while contested:
        now = kept(now)
        if now.count() == won.count() and not now.join(won.select("claim"), "claim", "left_anti").limit(1).count():
            break
        won = now
        out, now = given(won)
    out = kept(out)
    ext = F.regexp_extract("name", EXTENSION, 1)
    stem = F.substring("name", F.lit(1), F.length("name") - F.length(ext))
    assigned = F.when(F.col("number") == 1, F.col("name")).otherwise(F.concat(stem, F.lit(" ("), F.col("number").cast("string"), F.lit(")"), ext))
    return out.select("row_id", assigned.alias("assigned")).union(batch.where("name IS NULL").select("row_id", F.lit(None).cast("string")))
