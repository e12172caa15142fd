"""Results put together: pictures and names, files and their scenes, two runs, saved searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.media import is_video
from ..functions.tokens import rank_tokens
from . import search
from .search import KEEP, MIN_SCORE, NOISE, TOP_K, anew, chunks, none, ranked, top, union

# What a scene must be better by, rescued scenes, weights of text and heading, the older boost of words in a text.
UPGRADE, RESCUED, TEXT_WEIGHT, HEADING_WEIGHT, OLD_OCR_BOOST, MOST = 0.05, 3, 0.7, 0.3, 0.35, 96


def ordered_union(a: DataFrame, b: DataFrame, k: int = MOST) -> DataFrame:
    """(query_id, rank, ...) tables: all of a, then all of b, renumbered, k in all."""
    both = anew(a).withColumn("_part", F.lit(0)).unionByName(anew(b).withColumn("_part", F.lit(1)), True).withColumnRenamed("rank", "_rank")
    return ranked(both, top(k), F.col("_part"), F.col("_rank")).drop("_part", "_rank")


def merge_results(semantic: DataFrame, keyword: DataFrame, k: int = MOST) -> DataFrame:
    """Rows found by pictures lead; those found by name alone follow and say so."""
    more = keyword.join(semantic.select("query_id", "filename"), ["query_id", "filename"], "left_anti")
    return ordered_union(semantic.select("query_id", "rank", "filename", "dominant"), more.select("query_id", "rank", "filename", F.lit("filename").alias("dominant")), k)


def files_with_fallback(queries: DataFrame, media: DataFrame, k: int = TOP_K, **options) -> DataFrame:
    """Files search; a query that it finds nothing for is answered by names alone."""
    found = search.search_files(queries, media, k, **options).select("query_id", "rank", "filename", "score", "dominant")
    lost = queries.join(found.select("query_id").distinct(), "query_id", "left_anti")
    names = search.search_keyword(lost, media.withColumn("ocr", F.lit("")), k)
    return anew(found).unionByName(anew(names).withColumn("score", F.col("score").cast("double")))


def attach_best_scene(queries: DataFrame, results: DataFrame, segments: DataFrame, min_score: float = MIN_SCORE, keep: float = KEEP, noise: float = NOISE, k: int = TOP_K) -> DataFrame:
    """Scene upgrade and rescue of files search: results(query_id, rank, filename, score).

    Where at most a share `noise` of all segments reaches the cutoff: each film gets its
    best scene, whose score replaces the file's if it is better by UPGRADE; the RESCUED best
    films outside the result whose scene reaches the cutoff follow after all others."""
    asked = results.groupBy("query_id").agg(F.greatest(F.lit(min_score), F.max_by("score", -F.col("rank")) * keep).alias("cut"))
    with_cut = queries.select("query_id", "vec").join(asked, "query_id")
    best, share = scenes_and_share(with_cut, segments)
    clear = share.where((F.col("total") > 0) & (F.col("above") / F.col("total") <= noise)).select("query_id")
    scene = best.select("query_id", "filename", F.col("t").alias("scene_t"), F.col("poster").alias("scene_poster"), F.col("score").alias("scene_score")).join(clear, "query_id", "left_semi")
    own = results.select("query_id", "filename", "rank", "score").join(scene.where(is_video(F.col("filename"))), ["query_id", "filename"], "left")
    own = own.withColumn("score", F.when(F.col("scene_score") > F.col("score") + UPGRADE, F.col("scene_score")).otherwise(F.col("score"))).withColumn("rescued", F.lit(False))
    lost = scene.join(results.select("query_id", "filename"), ["query_id", "filename"], "left_anti").join(asked, "query_id").where(F.col("scene_score") >= F.col("cut"))
    lost = ranked(lost, RESCUED, F.col("scene_score").desc(), F.col("filename")).select("query_id", "filename", (F.col("rank") + MOST).alias("rank"), F.col("scene_score").alias("score"), "scene_t", "scene_poster", "scene_score", F.lit(True).alias("rescued"))
    again = anew(own).join(clear.withColumn("clear", F.lit(True)), "query_id", "left").withColumn("order", F.when(F.col("clear"), -F.col("score")).otherwise(0.0)).drop("clear").unionByName(anew(lost).withColumn("order", -F.col("score")))
    return ranked(again.withColumnRenamed("rank", "was"), top(k), F.col("rescued"), F.col("order"), F.col("was")).select("query_id", "rank", "filename", "score", "scene_t", "scene_poster", "scene_score", "rescued")


def scenes_and_share(queries: DataFrame, segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """queries(query_id, vec, cut) -> best scene of each film, and (query_id, total, above): segments that reach the cut."""
    spark, rows = segments.sparkSession, segments.select("filename", "t", "dur", "poster", "embedding")
    counts, total = [], segments.count()
    for asked in chunks(queries):
        hit = search._grouped(rows, asked, __import__("numpy").array([r.cut for r in asked]), ["filename"])
        counts.append(hit.groupBy("query_id").agg(F.sum("n").alias("above")))
    empty = spark.createDataFrame([], "query_id long, above long")
    share = queries.select("query_id").join(union(counts) if counts else empty, "query_id", "left").select("query_id", F.lit(total).alias("total"), F.coalesce("above", F.lit(0)).alias("above"))
    return search.best_scene(queries, segments), share


def rank_hybrid(queries: DataFrame, media: DataFrame, k: int = TOP_K, min_score: float = 0.0, keep: float = KEEP, diverse: bool = False) -> DataFrame:
    """The older ranking: words anywhere in the text count in the score, and the cutoff is a share of
    the best. If diverse, near copies are left out of the first CANDIDATES above the cutoff. Ties: row_id."""
    wanted = search.CANDIDATES if diverse else top(k)
    rows = media.select("row_id", "filename", *search.stored(media, "embedding", "phrase"), "ocr").withColumn("_words", search.phrase_tokens(F.col("filename"))).withColumn("_name", F.lower("filename"))
    parts = []
    for asked in chunks(search.with_pieces(queries, rank_tokens(F.col("text"))).select("query_id", "vec", "tokens", "pieces")):
        parts.append(search.best_rows(search.with_words(rows, "ocr", asked), [r.query_id for r in asked], _hybrid(asked), [], ["row_id", "filename", *(["embedding"] if diverse else [])], "row_id", wanted))
    if not parts:
        return none(queries, "query_id long, rank int, filename string, score double")
    found = ranked(union(parts), wanted, F.col("score").desc(), F.col("row_id"))
    best = F.max("score").over(Window.partitionBy("query_id"))  # `wanted` rows a query
    found = found.withColumn("best", best).where((F.col("best") >= min_score) & (F.col("score") >= F.greatest(F.lit(min_score), F.col("best") * keep)))
    if diverse:
        row = F.col("row_id").cast("string")
        chosen = diversify(found.select("query_id", "rank", row.alias("filename"), "embedding"), top(k)).select("query_id", F.col("rank").alias("place"), F.col("filename").alias("row"))
        found = found.withColumn("row", row).join(chosen, ["query_id", "row"]).drop("rank").withColumnRenamed("place", "rank")
    return found.select("query_id", "rank", "filename", "score")


def _hybrid(asked: list):
    base, tokens = search.FileScores(asked), search.Tokens(asked)

    def score(table):
        import numpy as np

        return {"score": np.round(base(table)["base"] + OLD_OCR_BOOST * tokens.share(tokens.contained(table["_text"].to_pylist())), 12)}

    return score


def diversify(ranked_rows: DataFrame, k: int = TOP_K, threshold: float = search.DIVERSITY, group: str | None = None) -> DataFrame:
    """(query_id, rank, filename, embedding[, group]), CANDIDATES rows a query at most: greedily no
    row too near to one taken before (of its group, if there is one); the k first if fewer than 3 are left."""
    rows = ranked_rows.where(F.col("rank") <= search.CANDIDATES).select("query_id", "rank", "filename", "embedding", (F.col(group).cast("string") if group else F.lit(None).cast("string")).alias("grp"))
    return rows.groupBy("query_id").applyInPandas(_diverse(k, threshold, group is not None), "query_id long, rank int, filename string")


def _diverse(k: int, threshold: float, grouped: bool):
    def run(rows):
        import numpy as np

        rows = rows.sort_values("rank")
        vectors = [() if x is None else x for x in rows["embedding"]]
        v = np.zeros((len(vectors), max(1, *map(len, vectors)) if len(vectors) > 1 else max(1, len(vectors[0]))))
        for i, x in enumerate(vectors):  # rows without a vector are near to none
            v[i, : len(x)] = x
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
        of, taken = rows["grp"].to_numpy(object), []
        for i in range(len(v)):
            if len(taken) >= k:
                break
            others = [j for j in taken if not grouped or of[i] is None or of[j] == of[i]]
            if not others or (v[others] @ v[i]).max() <= threshold:
                taken.append(i)
        out = (rows.iloc[taken] if len(taken) >= 3 else rows.head(k)).copy()
        out["rank"] = range(1, len(out) + 1)
        return out[["query_id", "rank", "filename"]]

    return run


def weighted_heading_score(queries: DataFrame, sections: DataFrame, k: int = TOP_K) -> DataFrame:
    """(chunk_id, embedding, heading): 0.7 text and 0.3 heading cosine; a missing heading counts as the text. Ties: chunk_id."""
    rows, parts = sections.select("chunk_id", "embedding", F.coalesce("heading", "embedding").alias("heading")), []
    for asked in chunks(queries.select("query_id", "vec")):
        parts.append(search.best_rows(rows, [r.query_id for r in asked], _weighted(asked), [], ["chunk_id"], "chunk_id", top(k)))
    if not parts:
        return none(queries, "query_id long, rank int, chunk_id long, score double")
    return ranked(union(parts), top(k), F.col("score").desc(), F.col("chunk_id")).select("query_id", "rank", "chunk_id", "score")


def _weighted(asked: list):
    import numpy as np

    vectors = search.Vectors(asked)
    return lambda table: {"score": np.round(TEXT_WEIGHT * vectors.cosines(table, "embedding") + HEADING_WEIGHT * vectors.cosines(table, "heading"), 9)}


def compare_runs(a: DataFrame, b: DataFrame, k: int = TOP_K) -> DataFrame:
    """(query_id, kind, rank, a, b): names among the k first of one run only, and ranks at which the runs differ."""
    a, b = (df.where(F.col("rank") <= k).select("query_id", "rank", "filename") for df in (a, b))
    both = a.withColumnRenamed("rank", "ra").join(b.withColumnRenamed("rank", "rb"), ["query_id", "filename"], "full")
    only = both.where("ra IS NULL OR rb IS NULL").select("query_id", F.when(F.col("rb").isNull(), "only a").otherwise("only b").alias("kind"), F.coalesce("ra", "rb").alias("rank"), F.when(F.col("ra").isNotNull(), F.col("filename")).alias("a"), F.when(F.col("rb").isNotNull(), F.col("filename")).alias("b"))
    moved = a.withColumnRenamed("filename", "a").join(b.withColumnRenamed("filename", "b"), ["query_id", "rank"]).where("a <> b").select("query_id", F.lit("moved").alias("kind"), "rank", "a", "b")
    return union([only, moved])


def run_saved(saved: DataFrame, media: DataFrame, segments: DataFrame, lines: DataFrame, k: int = TOP_K) -> DataFrame:
    """saved(query_id, text, vec, mode): each in its own mode (files, scenes, ocr, dialogue)."""
    from .dialogue import search_dialogue

    of = lambda mode: saved.where(F.col("mode") == mode)
    out = [
        search.search_files(of("files"), media, k),
        search.search_scenes(of("scenes"), segments, k),
        search.search_ocr(of("ocr"), media, k),
        search_dialogue(of("dialogue"), lines, segments, k),
    ]
    return union([df.select("query_id", F.lit(mode).alias("mode"), F.col("rank").cast("int").alias("rank"), "filename", F.col("score").cast("double").alias("score")) for mode, df in zip(("files", "scenes", "ocr", "dialogue"), out)])
