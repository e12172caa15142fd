"""Registered queries over the library tables, each with the SQL that must agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import media as M
from ..functions import tokens as T
from ..functions import vectors as V
from ..operators import library as L
from ..operators import search as S
from ..sources import views
from ..sources.views import COSINE, HAS_EMAIL, MEDIA, QUERIES, SEGMENTS, UTTERANCES, VECTORS

TABLE: dict = {}


def query(sql: str | None = None):
    def add(f):
        TABLE[f.__name__] = (f, sql)
        return f

    return add


SCORED = f"""scored AS (SELECT q.query_id, m.row_id, m.filename, m.ocr, tk.tokens, {COSINE.format(a="q.vec", b="m.embedding")} AS semantic,
  {COSINE.format(a="q.vec", b="m.phrase")} AS ps,
  list_filter(regexp_split_to_array(regexp_replace(lower(m.filename), '\\.[^.]+$', ''), '[._\\-\\s]+'), lambda x: x <> '') AS ph
  FROM queries q JOIN tokens tk USING (query_id) CROSS JOIN media_vectors m),
parts AS (SELECT *, CASE WHEN len(list_intersect(tokens, ph)) > 0 THEN greatest(0.0, 0.6 * (ps - semantic)) ELSE 0.0 END AS phrase,
  0.2 * len(list_filter(tokens, lambda x: contains(lower(filename), x))) / greatest(len(tokens), 1) AS filename_part FROM scored),
words AS (SELECT row_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(ocr), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''))) AS word FROM media),
pieces AS (SELECT DISTINCT query_id, token, unnest(list_filter(regexp_split_to_array(token, '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) AS word
  FROM (SELECT query_id, unnest(tokens) AS token FROM tokens)),
hits AS (SELECT query_id, row_id, count(DISTINCT token) AS hits FROM words JOIN pieces USING (word) GROUP BY ALL),
base AS (SELECT p.*, semantic + phrase + filename_part AS base, coalesce(hits, 0) / len(tokens) AS word FROM parts p LEFT JOIN hits USING (query_id, row_id)),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY base DESC, row_id) AS place, count(*) OVER (PARTITION BY query_id) AS n,
  max(base) OVER (PARTITION BY query_id) AS top FROM base),
cut AS (SELECT query_id, base AS cut FROM placed WHERE place = least(floor(n * (1 - 0.6)) + 1, n)),
kept AS (SELECT p.*, 0.5 * word AS ocr_part, base + 0.5 * word AS score FROM placed p JOIN cut USING (query_id)
  WHERE top >= 0.04 AND (base >= greatest(0.04, cut) OR (base >= 0.04 AND word > 0)))"""


@query(f"""WITH {MEDIA}, {VECTORS}, {QUERIES}, {SCORED}
SELECT query_id, rank, filename, round(score, 6) AS score, CASE WHEN greatest(semantic, phrase, filename_part, ocr_part) <= 0
  OR greatest(semantic, phrase, filename_part, ocr_part) < semantic * 0.5 OR semantic = greatest(semantic, phrase, filename_part, ocr_part) THEN 'semantic'
  WHEN phrase = greatest(phrase, filename_part, ocr_part) THEN 'phrase' WHEN filename_part >= ocr_part THEN 'filename' ELSE 'ocr' END AS dominant
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, place) AS INTEGER) AS rank FROM kept) WHERE rank <= 24""")
def files_search(spark: SparkSession, d: str) -> DataFrame:
    out = S.search_files(views.queries(spark, d), views.media_vectors(spark, d, views.media(spark, d)), diverse=False)
    return out.select("query_id", "rank", "filename", F.round("score", 6).alias("score"), "dominant")


@query(f"""WITH {MEDIA}, {VECTORS}, {QUERIES}, {SCORED} SELECT query_id, round(cut, 6) AS cut FROM cut""")
def percentile_cutoffs(spark: SparkSession, d: str) -> DataFrame:
    """The base score that a file must reach to be among the best 60 % of a query."""
    out = S.percentile_cutoffs(views.queries(spark, d), views.media_vectors(spark, d, views.media(spark, d)))
    return out.select("query_id", F.round("cut", 6).alias("cut"))


@query(f"""WITH RECURSIVE {MEDIA}, {VECTORS}, {QUERIES}, {SCORED},
c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, place) AS i FROM kept QUALIFY i <= 500),
size AS (SELECT query_id, count(*) AS n FROM c GROUP BY 1),
u AS (SELECT c.query_id, c.i, list_transform(m.embedding, lambda x: x / sqrt(list_dot_product(m.embedding, m.embedding))) AS v FROM c JOIN media_vectors m USING (row_id)),
g AS (SELECT query_id, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS picked, CAST([] AS DOUBLE[][]) AS vs FROM size
  UNION ALL SELECT g.query_id, u.i, CASE WHEN near THEN picked ELSE list_append(picked, u.i) END, CASE WHEN near THEN vs ELSE list_append(vs, u.v) END
  FROM g JOIN u ON u.query_id = g.query_id AND u.i = g.i + 1, LATERAL (SELECT len(picked) >= 24 OR coalesce(list_max(list_transform(vs, lambda w: list_dot_product(w, u.v))), -1) > 0.92 AS near)),
done AS (SELECT g.query_id, picked FROM g JOIN size ON size.query_id = g.query_id AND size.n = g.i),
chosen AS (SELECT c.* FROM c JOIN size USING (query_id) JOIN done USING (query_id) WHERE CASE WHEN size.n > 24 AND len(picked) >= 3 THEN list_contains(picked, i) ELSE i <= 24 END)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY i) AS INTEGER) AS rank, filename, round(score, 6) AS score FROM chosen""")
def files_search_diverse(spark: SparkSession, d: str) -> DataFrame:
    """Files search as a whole, with its last step: no near copies."""
    out = S.search_files(views.queries(spark, d), views.media_vectors(spark, d, views.media(spark, d)))
    return out.select("query_id", "rank", "filename", F.round("score", 6).alias("score"))


CONTAINED = f"""WITH {MEDIA}, {QUERIES}, both_ AS (SELECT query_id, tokens, row_id, filename, lower(ocr) AS ocr FROM tokens CROSS JOIN media WHERE len(tokens) > 0)"""


@query(f"""{CONTAINED}, counted AS (SELECT query_id, row_id, filename, len(list_filter(tokens, lambda x: contains(lower(filename), x))) AS a, len(list_filter(tokens, lambda x: contains(coalesce(ocr, ''), x))) AS b FROM both_)
SELECT query_id, rank, filename, CAST(score AS INTEGER) AS score, dominant FROM (SELECT query_id, filename, a + b AS score,
  CASE WHEN b > 0 AND b >= a THEN 'ocr' WHEN a > 0 THEN 'filename' ELSE 'semantic' END AS dominant,
  CAST(row_number() OVER (PARTITION BY query_id ORDER BY a + b DESC, row_id) AS INTEGER) AS rank FROM counted WHERE a + b > 0) WHERE rank <= 24""")
def keyword_search(spark: SparkSession, d: str) -> DataFrame:
    return S.search_keyword(views.queries(spark, d), views.media(spark, d))


@query(f"""{CONTAINED}, counted AS (SELECT query_id, filename, len(list_filter(tokens, lambda x: contains(ocr, x))) / len(tokens) AS score FROM both_)
SELECT query_id, rank, filename, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, filename) AS INTEGER) AS rank FROM counted WHERE score > 0) WHERE rank <= 24""")
def ocr_search(spark: SparkSession, d: str) -> DataFrame:
    return S.search_ocr(views.queries(spark, d), views.media(spark, d))


ASK = """ask AS (SELECT query_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: length(x) >= 2)) AS tokens FROM queries)"""


@query(f"""WITH {MEDIA}, {QUERIES}, {ASK}, s AS (SELECT query_id, row_id, filename, len(list_filter(tokens, lambda x: contains(lower(filename), x))) / len(tokens) AS score FROM ask CROSS JOIN media)
SELECT query_id, rank, filename, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, filename, row_id) AS INTEGER) AS rank FROM s WHERE score > 0) WHERE rank <= 4""")
def keyword_evidence(spark: SparkSession, d: str) -> DataFrame:
    return S.keyword_evidence(views.queries(spark, d), views.media(spark, d))


@query(f"""WITH {MEDIA}, {QUERIES}, {ASK}, w AS (SELECT row_id, filename, unnest(list_distinct(regexp_split_to_array(lower(ocr), '[^\\p{{L}}\\p{{N}}]+'))) AS word FROM media),
t AS (SELECT query_id, len(tokens) AS n, unnest(tokens) AS word FROM ask), s AS (SELECT query_id, row_id, filename, count(*) / any_value(n) AS score FROM w JOIN t USING (word) GROUP BY ALL),
c AS (SELECT row_id, trim(regexp_replace(ocr, '\\s+', ' ', 'g')) AS flat FROM media)
SELECT query_id, rank, filename, score, CASE WHEN length(flat) > 300 THEN left(flat, 299) || '…' ELSE flat END AS snippet FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, filename, row_id) AS INTEGER) AS rank FROM s) JOIN c USING (row_id) WHERE rank <= 6""")
def ocr_evidence(spark: SparkSession, d: str) -> DataFrame:
    return S.ocr_evidence(views.queries(spark, d), views.media(spark, d))


SEGMENT_SCORES = f"s AS (SELECT q.query_id, g.filename, g.t, g.dur, g.poster, g.vec_id, round({COSINE.format(a='q.vec', b='g.embedding')}, 9) AS score FROM queries q CROSS JOIN segments g)"


@query(f"""WITH {SEGMENTS}, {QUERIES}, {SEGMENT_SCORES} SELECT query_id, rank, vec_id, round(score, 6) AS score FROM
(SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s) WHERE rank <= 24""")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return S.vector_topk(views.queries(spark, d), views.table(spark, d, "embeddings")).withColumn("score", F.round("score", 6))


@query(f"""WITH {SEGMENTS}, {QUERIES}, {SEGMENT_SCORES}, tot AS (SELECT query_id, count(*) AS total, greatest(0.04, max(score) * 0.6) AS cut FROM s GROUP BY 1),
q2 AS (SELECT query_id, cut FROM s JOIN tot USING (query_id) WHERE score >= 0.04 GROUP BY query_id, total, cut HAVING NOT (total >= 20 AND count(*) FILTER (score >= cut) / total > 0.25)),
slots AS (SELECT *, row_number() OVER (PARTITION BY query_id, filename, floor(t / 5) ORDER BY score DESC, t) AS k FROM s WHERE score >= 0.04),
c AS (SELECT s.*, row_number() OVER (PARTITION BY query_id, filename ORDER BY score DESC, t) AS nth FROM slots s JOIN q2 USING (query_id) WHERE k = 1 AND score >= cut)
SELECT query_id, rank, filename, t, dur, poster, round(score, 6) AS score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, filename, t) AS INTEGER) AS rank FROM c WHERE nth <= 3) WHERE rank <= 24""")
def scene_search(spark: SparkSession, d: str) -> DataFrame:
    return S.search_scenes(views.queries(spark, d), views.segments(spark, d)).withColumn("score", F.round("score", 6))


@query(f"""WITH {SEGMENTS}, {QUERIES}, {SEGMENT_SCORES} SELECT query_id, filename, t, poster, round(score, 6) AS score FROM
(SELECT *, row_number() OVER (PARTITION BY query_id, filename ORDER BY score DESC, t) AS k FROM s) WHERE k = 1""")
def best_scene(spark: SparkSession, d: str) -> DataFrame:
    return S.best_scene(views.queries(spark, d), views.segments(spark, d)).withColumn("score", F.round("score", 6))


@query(f"""WITH {MEDIA} SELECT hash, count(*) AS copies, min(row_id) AS first_row FROM media GROUP BY 1 HAVING count(*) > 1""")
def content_classes(spark: SparkSession, d: str) -> DataFrame:
    return L.content_classes(views.media(spark, d))


@query(f"""WITH {MEDIA} SELECT row_id, filename FROM media WHERE lang <> 'en' AND hash NOT IN (SELECT hash FROM media WHERE lang = 'en')""")
def drop_known_content(spark: SparkSession, d: str) -> DataFrame:
    m = views.media(spark, d)
    return L.drop_known_content(m.where("lang <> 'en'"), m.where("lang = 'en'")).select("row_id", "filename")


OVERRIDES = "overrides AS (SELECT hash, CASE WHEN min(row_id) % 2 = 0 THEN 'Projects' ELSE 'Screenshots' END AS override FROM media WHERE source = 'src3' GROUP BY 1)"
CATEGORY = """CASE WHEN regexp_matches(filename, '\\.mp4$') THEN 'Videos' WHEN override IS NOT NULL THEN override WHEN contains(filename, 'screenshot') THEN 'Screenshots' ELSE 'Projects' END"""
#: Where files came from and what their own metadata says.
ORIGIN = "origins AS (SELECT *, CASE row_id % 11 WHEN 3 THEN '/home/u/Screenshots/' || filename WHEN 5 THEN 'C:\\\\u\\\\Screenshots\\\\' || filename WHEN 7 THEN '/home/u/my screenshots old/' || filename END AS path, CASE WHEN row_id % 13 < 2 THEN row_id % 13 = 1 END AS hint FROM media)"


def _overrides(m: DataFrame) -> DataFrame:
    return m.where("source = 'src3'").groupBy("hash").agg(F.when(F.min("row_id") % 2 == 0, "Projects").otherwise("Screenshots").alias("override"))


@query(f"""WITH {MEDIA}, {OVERRIDES}, {ORIGIN} SELECT row_id, filename, CASE WHEN {CATEGORY} = 'Projects' AND override IS NULL AND (coalesce(hint, false) OR row_id % 11 IN (3, 5)) THEN 'Screenshots' ELSE {CATEGORY} END AS category FROM origins LEFT JOIN overrides USING (hash)""")
def categories(spark: SparkSession, d: str) -> DataFrame:
    """By ending, decisions by hand, names, folders (of either kind of separator) and hints."""
    m = views.media(spark, d)
    r, name = F.col("row_id"), F.col("filename")
    path = F.when(r % 11 == 3, F.concat(F.lit("/home/u/Screenshots/"), name)).when(r % 11 == 5, F.concat(F.lit("C:\\u\\Screenshots\\"), name)).when(r % 11 == 7, F.concat(F.lit("/home/u/my screenshots old/"), name))
    both = m.join(_overrides(m), "hash", "left")
    return both.select("row_id", "filename", M.category(name, path, F.when(r % 13 < 2, r % 13 == 1), F.col("override")).alias("category"))


@query(f"""WITH {MEDIA}, {OVERRIDES}, c AS (SELECT ocr, {CATEGORY} AS category FROM media LEFT JOIN overrides USING (hash))
SELECT tab, count(*) AS n FROM (SELECT unnest(list_filter(['All', CASE WHEN {HAS_EMAIL} THEN 'Email' END, category], lambda x: x IS NOT NULL)) AS tab FROM c) GROUP BY 1""")
def tab_counts(spark: SparkSession, d: str) -> DataFrame:
    m = views.media(spark, d)
    return L.tab_counts(m, _overrides(m))


@query(f"""WITH {MEDIA} SELECT CASE WHEN row_id % 3 = 0 THEN 'Unknown channel' ELSE source END AS channel, count(DISTINCT filename) AS files FROM media WHERE row_id % 5 = 0 GROUP BY 1""")
def channel_counts(spark: SparkSession, d: str) -> DataFrame:
    m = views.media(spark, d)
    return L.channel_counts(m, m.select("filename", F.when(F.col("row_id") % 3 == 0, F.lit(" ")).otherwise(F.col("source")).alias("channel")))


@query(f"""WITH {SEGMENTS}, h AS (SELECT event_id AS hit_id, 'film-' || (user_id % 20) || '.mp4' AS filename, CAST(event_id % 997 AS DOUBLE) / 3 AS t FROM events)
SELECT hit_id, filename, round(t, 6) AS t, poster FROM (SELECT h.*, s.poster, row_number() OVER (PARTITION BY hit_id ORDER BY abs(s.t - h.t), s.t) AS k FROM h JOIN segments s USING (filename)) WHERE k = 1""")
def nearest_poster(spark: SparkSession, d: str) -> DataFrame:
    hits = views.table(spark, d, "events").select(F.col("event_id").alias("hit_id"), F.concat(F.lit("film-"), F.col("user_id") % 20, F.lit(".mp4")).alias("filename"), ((F.col("event_id") % 997).cast("double") / 3).alias("t"))
    return L.nearest_poster(hits, views.segments(spark, d)).withColumn("t", F.round("t", 6))


@query(f"""WITH {UTTERANCES} SELECT a.filename, a.line AS line_a, b.line AS line_b FROM utterances a JOIN utterances b ON a.filename = b.filename AND b.t0 BETWEEN a.t0 AND a.t0 + 8""")
def line_windows(spark: SparkSession, d: str) -> DataFrame:
    return L.line_windows(views.utterances(spark, d))


@query(f"""WITH {SEGMENTS}, a AS (SELECT filename, t FROM segments), b AS (SELECT filename, t + (poster % 3) * 0.75 AS t FROM segments)
SELECT 'missing' AS side, filename, t FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.filename = a.filename AND abs(b.t - a.t) <= 1)
UNION ALL SELECT 'extra', filename, t FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE b.filename = a.filename AND abs(b.t - a.t) <= 1)""")
def tolerance_diff(spark: SparkSession, d: str) -> DataFrame:
    s = views.segments(spark, d)
    return L.tolerance_diff(s.select("filename", "t"), s.select("filename", (F.col("t") + F.col("poster") % 3 * 0.75).alias("t")))


@query(f"""WITH {QUERIES}, b AS (SELECT query_id, greatest(max(list_dot_product(vec, CAST(embedding AS DOUBLE[]))), 0.0) AS best FROM queries CROSS JOIN embeddings GROUP BY 1)
SELECT round(least(0.1, greatest(0.01, 2 * max(best))), 4) AS min_score, CAST(0.6 AS DOUBLE) AS keep FROM b""")
def calibrate(spark: SparkSession, d: str) -> DataFrame:
    """All queries as noise."""
    return L.calibrate(views.table(spark, d, "embeddings"), views.queries(spark, d))


@query(f"""WITH {QUERIES}, b AS (SELECT query_id, greatest(max(list_dot_product(vec, CAST(embedding AS DOUBLE[]))), 0.0) AS best FROM queries CROSS JOIN embeddings GROUP BY 1),
e AS (SELECT max(best) FILTER (query_id % 2 = 0) AS ceiling, min(best) FILTER (query_id % 2 = 1) AS weakest FROM b), f AS (SELECT least(0.1, greatest(0.01, 2 * ceiling)) AS floor, weakest FROM e)
SELECT round(CASE WHEN floor > 0.5 * weakest THEN greatest(0.01, 0.5 * weakest) ELSE floor END, 4) AS min_score, CAST(0.6 AS DOUBLE) AS keep FROM f""")
def calibrate_genuine(spark: SparkSession, d: str) -> DataFrame:
    """The whole rule over all queries: the even ones as noise, the odd ones as genuine."""
    q = views.queries(spark, d)
    return L.calibrate(views.table(spark, d, "embeddings"), q.where("query_id % 2 = 0"), q.where("query_id % 2 = 1"))


RANKED = f"WITH {SEGMENTS}, {QUERIES}, {SEGMENT_SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 24)"


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    return S.vector_topk(views.queries(spark, d), views.table(spark, d, "embeddings"))


@query(f"""{RANKED}, truth AS (SELECT query_id, e.vec_id FROM queries JOIN embeddings e ON e.label = query_id % 10), f AS (SELECT query_id, min(rank) AS rank FROM r JOIN truth USING (query_id, vec_id) GROUP BY 1)
SELECT count(*) AS n, count(*) FILTER (rank = 1) AS top1, round(avg(coalesce(1 / rank, 0)), 3) AS mrr, count(*) FILTER (rank <= 3) AS top3 FROM (SELECT DISTINCT query_id FROM truth) LEFT JOIN f USING (query_id)""")
def retrieval_quality(spark: SparkSession, d: str) -> DataFrame:
    truth = views.queries(spark, d).select("query_id", (F.col("query_id") % 10).alias("label")).join(views.table(spark, d, "embeddings").select("label", "vec_id"), "label").drop("label")
    return L.retrieval_quality(_ranked(spark, d), truth)


@query(f"""{RANKED}, p AS (SELECT query_id, max(score) AS best, min(score) AS worst FROM r GROUP BY 1) SELECT round(median(best), 6) AS median_best, round(median(worst), 6) AS median_worst FROM p""")
def score_band(spark: SparkSession, d: str) -> DataFrame:
    return L.score_band(_ranked(spark, d)).select(F.round("median_best", 6).alias("median_best"), F.round("median_worst", 6).alias("median_worst"))


@query(f"""{RANKED} SELECT filename, nth, query_id, round(score, 6) AS score FROM (SELECT CAST(vec_id AS VARCHAR) AS filename, query_id, score,
CAST(row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, query_id) AS INTEGER) AS nth FROM r) WHERE nth <= 8""")
def insights(spark: SparkSession, d: str) -> DataFrame:
    return L.insights(_ranked(spark, d).withColumn("filename", F.col("vec_id").cast("string"))).withColumn("score", F.round("score", 6))


@query(f"""WITH {UTTERANCES} SELECT filename, line, text FROM (SELECT *, lag(lower(text)) OVER (PARTITION BY filename ORDER BY t0, line) AS b FROM utterances) WHERE b IS NULL OR b <> lower(text)""")
def drop_adjacent_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return L.drop_adjacent_duplicates(views.utterances(spark, d)).select("filename", "line", "text")


@query(f"""WITH {MEDIA}, {SEGMENTS}, f AS (SELECT DISTINCT filename FROM segments UNION ALL SELECT filename FROM media), e AS (SELECT filename, max_by(t + dur / 2, t) AS e FROM segments GROUP BY 1)
SELECT count(*) AS videos, coalesce(sum(e), 0) AS known_seconds, count(*) FILTER (e IS NULL) AS unknown FROM f LEFT JOIN e USING (filename) WHERE regexp_matches(filename, '\\.mp4$')""")
def footage_facts(spark: SparkSession, d: str) -> DataFrame:
    s = views.segments(spark, d)
    return L.footage_facts(s.select("filename").distinct().union(views.media(spark, d).select("filename")), s)


@query(f"""WITH {UTTERANCES}, x AS (SELECT filename, max(t1) AS duration FROM utterances GROUP BY 1)
SELECT filename, CAST(i AS INTEGER) AS i, i * 30.0::DOUBLE AS start, least(35.0::DOUBLE, duration - i * 30) AS dur FROM (SELECT *, unnest(range(greatest(CAST(ceil(duration / 30) AS BIGINT), 1))) AS i FROM x)""")
def plan_slices(spark: SparkSession, d: str) -> DataFrame:
    return L.plan_slices(views.utterances(spark, d).groupBy("filename").agg(F.max("t1").alias("duration")))


@query(f"""WITH {MEDIA}, {VECTORS}, v AS (SELECT row_id, filename, embedding, list_transform(CASE WHEN row_id % 9 = 1 THEN embedding ELSE phrase END, lambda x: x / sqrt(list_dot_product(embedding, embedding)) * CASE WHEN row_id % 9 = 2 THEN 0.0001 ELSE 1 END) AS phrase FROM media_vectors)
SELECT row_id, filename FROM v WHERE list_dot_product(phrase, phrase) < 1e-6 OR list_dot_product(phrase, list_transform(embedding, lambda x: x / sqrt(list_dot_product(embedding, embedding)))) > 0.9999""")
def corrupt_phrases(spark: SparkSession, d: str) -> DataFrame:
    """A ninth of the phrase vectors are the image's, a ninth next to nothing."""
    m = views.media_vectors(spark, d, views.media(spark, d)).withColumn("e", V.l2_normalize(F.col("embedding"))).withColumn("n", V.norm(F.col("embedding")))
    phrase = F.transform(F.when(F.col("row_id") % 9 == 1, F.col("embedding")).otherwise(F.col("phrase")), lambda x: x.cast("double") / F.col("n") * F.when(F.col("row_id") % 9 == 2, 0.0001).otherwise(1.0))
    return L.corrupt_phrases(m.select("row_id", "filename", F.col("e").alias("embedding"), phrase.alias("phrase")))


@query(f"""WITH {MEDIA}, c AS (SELECT filename FROM media WHERE row_id % 10 = 0) SELECT filename FROM media WHERE row_id % 5 = 0 AND filename NOT IN (SELECT filename FROM c)""")
def missing_children(spark: SparkSession, d: str) -> DataFrame:
    m = views.media(spark, d)
    return L.missing_children(m, m.where("row_id % 10 = 0"))


@query(f"""WITH {MEDIA}, x AS (SELECT row_id, source || '.png' AS name FROM media),
lib AS (SELECT DISTINCT CASE WHEN row_id % 7 = 0 THEN source || ' (' || (2 + row_id % 50) || ').png' ELSE source || '.png' END AS name FROM media WHERE row_id % 7 = 0 OR row_id % 131 = 3),
r AS (SELECT row_id, name, row_number() OVER (PARTITION BY name ORDER BY row_id) - CASE WHEN name IN (SELECT name FROM lib) THEN 0 ELSE 1 END AS k FROM x),
free AS (SELECT name, j, row_number() OVER (PARTITION BY name ORDER BY j) AS k FROM (SELECT name, unnest(range(2, n + 60)) AS j FROM (SELECT name, count(*) AS n FROM x GROUP BY 1)) f
  WHERE replace(name, '.png', '') || ' (' || j || ').png' NOT IN (SELECT name FROM lib))
SELECT row_id, CASE WHEN k = 0 THEN name ELSE replace(name, '.png', '') || ' (' || j || ').png' END AS assigned FROM r LEFT JOIN free USING (name, k)""")
def assign_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of sources, some of which the library has, as well as numbers up to 51."""
    m = views.media(spark, d)
    number = F.concat("source", F.lit(" ("), (F.col("row_id") % 50 + 2).cast("string"), F.lit(").png"))
    held = m.where("row_id % 7 = 0 OR row_id % 131 = 3").select(F.when(F.col("row_id") % 7 == 0, number).otherwise(F.concat("source", F.lit(".png"))).alias("filename"))
    return L.assign_names(m.select("row_id", F.concat("source", F.lit(".png")).alias("name")), held)


@query("""WITH t AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: length(x) >= 2)) AS rank,
list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: length(x) >= 1)) AS word FROM documents),
s AS (SELECT doc_id, list_sort(rank) AS rank, list_sort(list_filter(word, lambda x: length(x) >= 2)) AS ask, list_sort(word) AS word FROM t)
SELECT doc_id, len(rank) AS n_rank, len(ask) AS n_ask, len(word) AS n_word, md5(array_to_string(rank, ' ')) AS rank, md5(array_to_string(ask, ' ')) AS ask, md5(array_to_string(word, ' ')) AS word FROM s""")
def token_functions(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of tokens of three kinds, and the tokens themselves, sorted, as a hash."""
    sets = views.table(spark, d, "documents").select("doc_id", T.token_sets(F.col("text")).alias("t")).select("doc_id", "t.*")
    n, same = lambda c: F.size(c).cast("long").alias(f"n_{c}"), lambda c: F.md5(F.array_join(F.sort_array(c), " ")).alias(c)
    return sets.select("doc_id", n("rank"), n("ask"), n("word"), same("rank"), same("ask"), same("word"))


@query(f"""WITH {MEDIA}, t AS (SELECT row_id, filename, ocr, list_distinct(list_filter([source, lang, 'screenshot', 'png'], lambda x: x <> '')) AS a, list_distinct(list_filter(regexp_split_to_array(lower(filename), '[^\\p{{L}}\\p{{N}}]+'), lambda x: length(x) >= 2)) AS b FROM media)
SELECT row_id, len(list_filter(a, lambda x: contains(lower(filename), x))) / len(a) AS in_name, len(list_filter(a, lambda x: contains(lower(coalesce(ocr, '')), x))) / len(a) AS in_text,
array_to_string(list_sort(list_distinct(list_concat(a, b))), ' ') AS either, array_to_string(list_sort(list_intersect(a, b)), ' ') AS both_ FROM t""")
def token_matches(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of a source against the name and the text of its files, and against the name's own tokens."""
    a, name = F.array_distinct(F.array("source", "lang", F.lit("screenshot"), F.lit("png"))), T.ask_tokens(F.col("filename"))
    joined = lambda c: F.array_join(F.sort_array(c), " ")
    shares = [T.filename_match(a, F.col("filename")).alias("in_name"), T.text_match(a, F.col("ocr")).alias("in_text")]
    return views.media(spark, d).select("row_id", *shares, joined(T.token_union(a, name)).alias("either"), joined(T.token_intersect(a, name)).alias("both_"))


@query(f"""WITH {MEDIA} SELECT row_id, array_to_string(list_filter(regexp_split_to_array(regexp_replace(filename, '\\.[^.]+$', ''), '[._\\-\\s]+'), lambda x: x <> ''), ' ') AS phrase FROM media""")
def filename_phrases(spark: SparkSession, d: str) -> DataFrame:
    return views.media(spark, d).select("row_id", T.filename_phrase(F.col("filename")).alias("phrase"))


@query("""SELECT vec_id, CASE WHEN vec_id % 11 = 0 THEN 'wrong dimension' END AS problem FROM embeddings""")
def vector_problems(spark: SparkSession, d: str) -> DataFrame:
    e = views.table(spark, d, "embeddings").withColumn("v", F.when(F.col("vec_id") % 11 == 0, F.slice("embedding", 1, 9)).otherwise(F.col("embedding")))
    return e.select("vec_id", V.vector_problem(F.col("v"), 64).alias("problem"))


@query("""WITH f AS (SELECT label, unnest(range(len(embedding))) AS pos, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings), m AS (SELECT label, pos, avg(x) AS x FROM f GROUP BY ALL),
n AS (SELECT label, sqrt(sum(x * x)) AS n FROM m GROUP BY 1) SELECT label, pos, round(x / n, 9) AS x FROM m JOIN n USING (label)""")
def text_means(spark: SparkSession, d: str) -> DataFrame:
    return V.text_mean(views.table(spark, d, "embeddings"), ["label"], "embedding").select("label", F.posexplode("vec").alias("p", "x")).select("label", F.col("p").cast("long").alias("pos"), F.round("x", 9).alias("x"))


@query(f"""WITH {UTTERANCES} SELECT filename, line, len(list_filter(regexp_split_to_array(text, '[^a-zA-Z0-9'']+'), lambda x: x <> '')) >= 2 AND length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) >= 8 AS long_enough FROM utterances""")
def speech_length(spark: SparkSession, d: str) -> DataFrame:
    clean = F.trim(F.regexp_replace("text", r"\s+", " "))
    return views.utterances(spark, d).select("filename", "line", ((F.size(F.filter(F.split("text", "[^a-zA-Z0-9']+"), lambda w: w != "")) >= 2) & (F.length(clean) >= 8)).alias("long_enough"))


@query()
def real_speech(spark: SparkSession, d: str) -> DataFrame:
    return views.utterances(spark, d).select("filename", "line", M.is_real_speech(F.col("text")).alias("real"))
