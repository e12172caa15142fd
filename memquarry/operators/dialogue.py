"""Searches of spoken lines, and moments made of pictures and speech.

Tables: queries(query_id, text[, vec]), lines(filename, line, t0, t1, text),
segments(filename, t, dur, poster[, embedding]).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dialogue import asked_places, dialogue_keys, literal_share, literal_words, snippet_around
from ..sources.manifest import scratch_folder
from .library import nearest_poster
from .search import KEEP, MIN_SCORE, NOISE, NOISE_TOTAL, PER_VIDEO, SLOT, TOP_K, anew, best_rows, chunks, none, ranked, stored, top, union

# Seconds before a line that playing begins, seconds that words may be apart, characters
# around a match, weights of the two sides of a moment, and the boost of literal words.
PRE_ROLL, NEAR, RADIUS = 3.0, 8.0, 60
W_VISUAL, W_TEXT, LITERAL_BOOST, CHUNK_SNIPPET = 0.4, 0.6, 0.5, 80
TIERS = {1: "Exact line", 2: "Exact words", 3: "Words spoken"}


def valid_lines(lines: DataFrame) -> DataFrame:
    return lines.where((F.trim("text") != "") & F.col("t0").isNotNull() & F.col("t1").isNotNull() & (F.col("t1") > F.col("t0")) & F.col("filename").isNotNull())


#: Folders that a stored index is dealt into by key.
INDEX_BUCKETS = 64
POSTINGS = "key string, filename string, t0 double, t1 double, line long, places array<int>, bucket int"
FILMS = "key string, filename string, n long, bucket int"
SPOKEN = "filename string, t0 double, t1 double, line long"
#: Different keys of all queries up to which they are a filter on the scan.
MANY_KEYS = 2000


def dialogue_index(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(postings, films, spoken) of valid lines: for each key and line the places of the key among the
    line's keys; for each key the films that have it, with the number of lines; lines with a key."""
    spoken = valid_lines(lines).select("filename", "t0", "t1", F.col("line").cast("long").alias("line"), dialogue_keys(F.col("text")).alias("keys")).where(F.size("keys") > 0)
    each = spoken.select("filename", "t0", "t1", "line", F.posexplode("keys").alias("place", "key"))
    bucket = F.pmod(F.xxhash64("key"), F.lit(INDEX_BUCKETS)).cast("int").alias("bucket")
    postings = each.groupBy("key", "filename", "t0", "t1", "line").agg(F.sort_array(F.collect_list("place")).alias("places")).withColumn("bucket", bucket)  # one line's words
    films = postings.groupBy("key", "filename").agg(F.count("*").alias("n")).withColumn("bucket", bucket)
    return postings, films, spoken.drop("keys")


def write_dialogue_index(lines: DataFrame, path: str) -> None:
    """Store the index: folders by bucket of key, each sorted by key and film, so that a search reads only
    the folders of its keys and the row groups that hold them."""
    spark = lines.sparkSession
    postings, _, _ = dialogue_index(lines)
    order = ["bucket", "key", "filename"]
    postings.repartition("bucket", F.pmod(F.xxhash64("filename"), F.lit(8))).sortWithinPartitions(*order, "t0").write.partitionBy("bucket").parquet(f"{path}/postings")
    stored = spark.read.schema(POSTINGS).parquet(f"{path}/postings")
    films = stored.groupBy("bucket", "key", "filename").agg(F.count("*").alias("n"))
    stored.select("filename", "t0", "t1", "line").distinct().repartitionByRange("filename").sortWithinPartitions("filename", "t0").write.parquet(f"{path}/spoken")
    films.repartition("bucket").sortWithinPartitions(*order).write.partitionBy("bucket").parquet(f"{path}/films")


def read_dialogue_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.schema(schema).parquet(f"{path}/{name}") for name, schema in (("postings", POSTINGS), ("films", FILMS), ("spoken", SPOKEN)))


def asked_index(lines: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same for some keys only: each text is cut once, and what is found is stored."""
    folder = scratch_folder(lines.sparkSession, "dialogue")
    at = ["filename", "t0", "t1", "line"]
    # no filter on what is found before it is stored: Spark would ask it of texts that a join below leaves out, and twice
    found = valid_lines(lines).select("filename", "t0", "t1", F.col("line").cast("long").alias("line"), asked_places(F.col("text"), keys).alias("f"))
    rows = _kept(found.select(*at, "f.*"), f"{folder}/lines").where("spoken")
    places = F.sort_array(F.flatten(F.collect_list("places"))).alias("places")
    postings = _kept(rows.select(*at, F.inline("found")).groupBy("key", *at).agg(places), f"{folder}/postings")
    films = _kept(postings.groupBy("key", "filename").agg(F.count("*").alias("n")), f"{folder}/films")
    return postings, films, rows.select(*at).distinct()


def _kept(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exact_hits(queries: DataFrame, lines: DataFrame | None, seconds: float = NEAR, index: tuple | None = None) -> DataFrame:
    """(query_id, filename, tier, line, t0, end, occ): 1 the query's keys in a row in one
    line; 2 all of them in one line or in lines that begin within `seconds`; 3 in one
    longer line. A window begins at any line and ends where the last key is first found.

    Films of a query's rarest key are asked for its other keys, and only films that have them
    all are searched: common words are never met in films that lack a rare one. Windows are
    joins on (film, stretch of `seconds`), so that no long film is one task. `index` is that of
    `lines`, stored before or here; what is read more than once is stored, too."""
    spark = queries.sparkSession
    folder = scratch_folder(spark, "hits")
    asked = queries.select("query_id", dialogue_keys(F.coalesce("text", F.lit(""))).alias("wanted")).where(F.size("wanted") > 0)
    asked = _kept(asked, f"{folder}/asked")
    wanted = asked.select("query_id", F.size(F.array_distinct("wanted")).alias("different"), F.explode(F.array_distinct("wanted")).alias("key"))
    keys = [r.key for r in wanted.select("key").distinct().limit(MANY_KEYS + 1).collect()]
    if index is None and len(keys) > MANY_KEYS:
        write_dialogue_index(lines, f"{folder}/index")
    postings, films, spoken = index or (asked_index(lines, keys) if len(keys) <= MANY_KEYS else read_dialogue_index(spark, f"{folder}/index"))
    if index and len(keys) <= MANY_KEYS:  # a filter that reaches the scan; with more keys the joins below do it alone
        buckets = spark.createDataFrame([(k,) for k in keys], "key string").select(F.pmod(F.xxhash64("key"), F.lit(INDEX_BUCKETS)).cast("int").alias("b")).distinct()
        some = F.col("bucket").isin([r.b for r in buckets.collect()]) & F.col("key").isin(keys)
        postings, films = postings.where(some), films.where(some)
    spread = films.groupBy("key").agg(F.count("*").alias("films")).join(wanted, "key")
    complete = spread.groupBy("query_id", "different").agg(F.count("*").alias("known"), F.min_by("key", F.struct("films", "key")).alias("key")).where("known = different")
    candidates = films.select("key", "filename").join(complete.select("query_id", "key", "different"), "key").select("query_id", "filename", "different")
    asking = candidates.join(wanted.select("query_id", "key"), "query_id")
    held = asking.join(films.select("key", "filename"), ["key", "filename"]).groupBy("query_id", "filename", "different").agg(F.count("*").alias("held")).where("held = different")
    held = _kept(held, f"{folder}/held")
    asking = held.select("query_id", "filename", "different").join(wanted.select("query_id", "key"), "query_id")
    at = F.struct("t0", "t1", "line")
    hits = asking.join(postings.select("key", "filename", at.alias("at"), "places"), ["key", "filename"]).select("query_id", "filename", "different", "key", "at", F.size("places").cast("long").alias("n"), "places")
    # lines with all keys: is there a place from which on they come in a row?
    full = hits.groupBy("query_id", "filename", "different", "at").agg(F.count("*").alias("has"), F.map_from_entries(F.collect_list(F.struct("key", "places"))).alias("places")).where("has = different").join(asked, "query_id")
    follows = lambda p: F.forall(F.sequence(F.lit(0), F.size("wanted") - 1), lambda i: F.array_contains(F.col("places")[F.get("wanted", i)], p + i))
    phrases = full.where(F.exists(F.col("places")[F.get("wanted", F.lit(0))], follows)).select("query_id", "filename", "at", F.size("wanted").alias("occ"))
    phrases = _kept(phrases, f"{folder}/phrases")
    stretch = lambda c: F.floor(c / seconds).cast("long")
    hits = hits.drop("places")
    starts = spoken.join(held.select("query_id", "filename"), "filename").select("query_id", "filename", at.alias("first"))
    starts = starts.withColumn("stretch", F.explode(F.array(stretch(F.col("first.t0")), stretch(F.col("first.t0")) + 1)))
    near = starts.join(hits.withColumn("stretch", stretch(F.col("at.t0"))), ["query_id", "filename", "stretch"]).where((F.col("at") >= F.col("first")) & (F.col("at.t0") - F.col("first.t0") <= seconds))
    per = near.groupBy("query_id", "filename", "first", "different").agg(F.collect_list(F.struct("key", "at", "n")).alias("found"))  # the lines of a few seconds
    keys = F.array_distinct(F.transform("found", lambda x: x["key"]))
    ends = F.transform(keys, lambda k: F.array_min(F.transform(F.filter("found", lambda x: x["key"] == k), lambda x: x["at"])))
    per = per.where(F.size(keys) == F.col("different")).withColumn("last", F.array_max(ends))
    occ = F.aggregate(F.filter("found", lambda x: x["at"] <= F.col("last")), F.lit(0).cast("long"), lambda s, x: s + x["n"])
    same = phrases.select("query_id", "filename", F.col("at.t0").alias("p0"), F.col("at.t1").alias("p1")).distinct()
    windows = per.select("query_id", "filename", "first", "last", occ.alias("occ"))
    alone = (F.col("first") == F.col("last")) & (F.col("first.t0") == F.col("p0")) & (F.col("first.t1") == F.col("p1"))
    windows = windows.join(same.withColumnRenamed("query_id", "q").withColumnRenamed("filename", "f"), (F.col("query_id") == F.col("q")) & (F.col("filename") == F.col("f")) & alone, "left_anti")
    tier = F.when((F.col("first") == F.col("last")) & (F.col("last.t1") - F.col("first.t0") > seconds), 3).otherwise(2)
    windows = windows.select("query_id", "filename", tier.alias("tier"), "first", F.col("last.t1").alias("end"), "occ")
    lone = phrases.select("query_id", "filename", F.lit(1).alias("tier"), F.col("at").alias("first"), F.col("at.t1").alias("end"), F.col("occ").cast("long").alias("occ"))
    return anew(lone).unionByName(anew(windows)).select("query_id", "filename", "tier", F.col("first.line").alias("line"), F.col("first.t0").alias("t0"), "end", "occ")


def search_dialogue(queries: DataFrame, lines: DataFrame, segments: DataFrame | None = None, k: int = TOP_K, per_video: int = PER_VIDEO, pre_roll: float = PRE_ROLL, seconds: float = NEAR, radius: int = RADIUS, index: tuple | None = None) -> DataFrame:
    """Exact hits in order of tier, occurrences, span and time; one a film, tier and
    second, some a film, k in all, with a score, the words around and the nearest poster."""
    folder = scratch_folder(queries.sparkSession, "shown")
    asked = queries.select("query_id", "text", dialogue_keys(F.coalesce("text", F.lit(""))).alias("wanted"))
    asked = _kept(asked.withColumn("least", F.min_by(F.struct("query_id", "text"), "query_id").over(Window.partitionBy("wanted"))), f"{folder}/asked")
    once = asked.select("least.*").distinct()  # one of the queries with the same keys
    hits = exact_hits(once, lines, seconds, index).withColumn("span", F.col("end") - F.col("t0"))
    order = [F.col("tier"), F.col("occ").desc(), F.col("span"), F.col("t0"), F.col("filename"), F.col("line")]
    first = F.row_number().over(Window.partitionBy("query_id", "filename", "tier", F.floor("t0")).orderBy(*order))
    hits = hits.withColumn("nth", first).where("nth = 1")
    hits = hits.withColumn("nth", F.row_number().over(Window.partitionBy("query_id", "filename").orderBy(*order))).where(F.col("nth") <= max(1, min(24, per_video)))
    hits = ranked(hits, top(k), *order)
    score = 4 - F.col("tier") + F.least("occ", F.lit(8)) * 0.01 - F.least("span", F.lit(300.0)) * 0.0005
    hits = hits.withColumn("score", score).withColumn("mid", (F.col("t0") + F.col("end")) / 2)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "rank"))
    hits = _kept(hits.withColumn("rank", rank).withColumn("hit_id", F.xxhash64("query_id", "rank")), f"{folder}/hits")  # k a query at most
    every = asked.select("query_id", "wanted", F.col("least.query_id").alias("least"))
    text = lines.select("filename", F.col("line").cast("long").alias("line"), "text")
    shown = text.join(hits.withColumnRenamed("query_id", "least"), ["filename", "line"]).join(every, "least").withColumn("s", snippet_around(F.col("text"), F.col("wanted"), radius))
    poster = F.lit(0).cast("long")
    if segments is not None:
        near = nearest_poster(hits.select("filename", "hit_id", F.col("mid").alias("t")), segments).select("hit_id", "poster")
        shown, poster = shown.join(near, "hit_id", "left"), F.coalesce("poster", F.lit(0).cast("long"))
    label = F.create_map(*(F.lit(x) for pair in TIERS.items() for x in pair))[F.col("tier")]
    return shown.select("query_id", "rank", "filename", "score", F.greatest(F.lit(0.0), F.col("t0") - pre_roll).alias("t"), F.greatest(F.lit(0.5), F.col("span")).alias("dur"), poster.alias("poster"), "tier", label.alias("label"), F.col("s.text").alias("snippet"), F.col("s.start").alias("match_start"), F.col("s.len").alias("match_len"))


def fuse_moments(visual: DataFrame, text: DataFrame, segments: DataFrame | None = None, visual_total: int = 0, text_total: int = 0, k: int = TOP_K, min_score: float = MIN_SCORE, keep: float = KEEP, seconds: int = SLOT, per_video: int = PER_VIDEO, noise: float = NOISE) -> DataFrame:
    """visual(query_id, filename, t, dur, poster, score) and text(query_id, filename, t, dur,
    snippet, literal, score), both above the floor, made into moments of film and time slot:
    a weighted sum, a cutoff by the best, nothing where too large a share is above it
    (unless words were literally spoken), some a film, the k best with a boost of literal words.
    Ties: file and time; a text hit counts before one of a lower score."""
    own = ["query_id", "filename", "t", "dur", "score"]
    hits = visual.select(*own, F.coalesce(F.col("poster").cast("long"), F.lit(0).cast("long")).alias("poster"), F.lit(None).cast("string").alias("snippet"), F.lit(0.0).alias("literal"), F.lit(True).alias("seen"))
    hits = union([hits, text.select(*own, F.lit(0).cast("long"), "snippet", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("literal", F.lit(0.0)))), F.lit(False))])
    key, length = F.struct("score", (-F.col("t")).alias("e")), F.when(F.col("dur") > 0, F.col("dur")).otherwise(0.5)
    best = lambda side: F.max_by(F.struct("t", length.alias("dur"), "poster", "snippet", "score"), F.when(side, key))
    by_slot = hits.where("score > 0").groupBy("query_id", "filename", F.floor(F.col("t") / max(1, seconds)).alias("slot"))
    # the scores of a slot, a few seconds of one film, are kept to be counted once the cutoff is known
    slots = by_slot.agg(best(F.col("seen")).alias("v"), best(~F.col("seen")).alias("x"), F.max("literal").alias("literal"), F.collect_list(F.when(F.col("seen"), F.col("score"))).alias("vs"), F.collect_list(F.when(~F.col("seen"), F.col("score"))).alias("xs"))
    seen, said = F.coalesce("v.score", F.lit(0.0)), F.coalesce("x.score", F.lit(0.0))
    why = F.when((seen > 0) & (said > 0), "both").when(said > 0, "text").otherwise("visual")
    moments = slots.select("query_id", "filename", F.coalesce("v.t", "x.t").alias("t"), F.coalesce("v.dur", "x.dur").alias("dur"), F.coalesce("v.poster", F.lit(0).cast("long")).alias("poster"), F.round(W_VISUAL * seen + W_TEXT * said, 9).alias("score"), why.alias("why"), F.nullif("x.snippet", F.lit("")).alias("snippet"), "literal", "vs", "xs")
    tops = moments.groupBy("query_id").agg(F.greatest(F.lit(min_score), F.max("score") * keep).alias("cut"))
    moments = moments.join(tops, "query_id")
    many = lambda c: F.sum(F.size(F.filter(c, lambda x: x >= F.col("cut"))))
    gate = moments.groupBy("query_id").agg(many("vs").alias("v_above"), many("xs").alias("t_above"), F.max((F.col("score") >= F.col("cut")) & (F.col("literal") > 0)).alias("spoken"))
    loud = lambda c, total: F.coalesce(F.col(c), F.lit(0)) / max(1, total) > noise
    if visual_total > 0 and text_total > 0:
        flooded = loud("v_above", visual_total) & loud("t_above", text_total)
    elif visual_total > 0:
        flooded = loud("v_above", visual_total) & F.lit(visual_total >= NOISE_TOTAL)
    else:
        flooded = loud("t_above", text_total) if text_total > 0 else F.lit(False)
    kept = moments.where(F.col("score") >= F.col("cut")).drop("vs", "xs").join(gate.where(F.col("spoken") | ~flooded).select("query_id"), "query_id")
    order = [F.col("score").desc(), F.col("filename"), F.col("t")]
    kept = kept.withColumn("nth", F.row_number().over(Window.partitionBy("query_id", "filename").orderBy(*order))).where(F.col("nth") <= per_video)
    kept = ranked(kept, top(k), *order).withColumn("score", F.col("score") + LITERAL_BOOST * F.col("literal"))
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "rank")))
    poster: Column = F.col("poster")
    if segments is not None:
        kept = kept.withColumn("hit_id", F.xxhash64("query_id", "rank"))
        near = nearest_poster(kept.where("poster = 0").select("filename", "hit_id", "t"), segments).select("hit_id", F.col("poster").alias("near"))
        kept, poster = kept.join(near, "hit_id", "left"), F.when(F.col("poster") == 0, F.coalesce("near", F.lit(0).cast("long"))).otherwise(F.col("poster"))
    return kept.select("query_id", "rank", "filename", "score", "t", "dur", poster.alias("poster"), "why", "snippet")


def text_hits(queries: DataFrame, stretches: DataFrame, k: int = TOP_K, min_score: float = MIN_SCORE) -> DataFrame:
    """queries(query_id, text, vec), stretches(filename, line, t0, t1, text, embedding) ->
    query_id, filename, t, dur, snippet, literal, score: the 8 k best of those above the floor. Ties: film, time, line."""
    from .search import _rounded_cosines

    tie = F.concat_ws("\x01", "filename", F.format_string("%015.3f", (F.col("t0") + F.col("t1")) / 2), F.lpad(F.col("line").cast("string"), 12, "0"))
    rows = valid_lines(stretches).withColumn("_row", F.xxhash64("filename", "line", "t0", "t1", "text")).withColumn("tie", tie)
    vectors = rows.select("_row", "filename", "t0", "t1", *stored(rows, "embedding"), "tie")  # texts are fetched for what is found, and cut once each
    parts = []
    for asked in chunks(queries.select("query_id", "vec")):
        parts.append(best_rows(vectors, [r.query_id for r in asked], _floored(_rounded_cosines(asked), min_score), [], ["_row", "filename", "t0", "t1", "tie"], "tie", 8 * top(k)))
    if not parts:
        return none(queries, "query_id long, filename string, t double, dur double, snippet string, literal double, score double")
    found = ranked(union(parts), 8 * top(k), F.col("score").desc(), F.col("tie"))
    lines = rows.select("_row", "text").join(found.select("_row").distinct(), "_row", "left_semi").dropDuplicates(["_row"])
    lines = lines.select("_row", F.substring("text", 1, CHUNK_SNIPPET).alias("snippet"), literal_words(F.col("text")).alias("words"))
    found = found.join(lines, "_row").join(queries.select("query_id", literal_words(F.col("text")).alias("asked")), "query_id")
    return found.select("query_id", "filename", ((F.col("t0") + F.col("t1")) / 2).alias("t"), F.greatest(F.lit(0.5), F.col("t1") - F.col("t0")).alias("dur"), "snippet", literal_share(F.col("asked"), F.col("words")).alias("literal"), "score")


def rank_dialogue(queries: DataFrame, stretches: DataFrame, segments: DataFrame | None = None, k: int = TOP_K, min_score: float = MIN_SCORE, keep: float = KEEP) -> DataFrame:
    """Speech by meaning: stretches above the floor, fused as text alone."""
    text = text_hits(queries, stretches, k, min_score)
    nothing = text.select("query_id", "filename", "t", "dur", F.lit(0).cast("long").alias("poster"), "score").limit(0)
    return fuse_moments(nothing, text, segments, 0, stretches.count(), k, min_score, keep)


def _floored(scores, least: float):
    import numpy as np

    def score(table):
        got = scores(table)["score"]
        return {"score": np.where(got >= least, got, -np.inf)}

    return score


def utterances_or_chunks(scoped: DataFrame, utterances: DataFrame, chunks_: DataFrame) -> DataFrame:
    """scoped(query_id, filename): for each query the lines of its films if any of them has
    some, else their chunks."""
    names = scoped.select("query_id", "filename").distinct()
    columns = ["query_id", "filename", "line", "t0", "t1", "text"]
    lines = names.join(utterances, "filename")
    some = lines.select("query_id").distinct()
    coarse = names.join(some, "query_id", "left_anti").join(chunks_, "filename")
    spoken = (F.trim("text") != "") & F.col("t0").isNotNull() & F.col("t1").isNotNull()
    return union([lines.where(spoken).select(*columns), coarse.where(spoken).select(*columns)])
