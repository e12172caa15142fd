"""Registered queries on library jobs: imports, recognised text, transcripts, shots, stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import emails as E
from ..functions import texts as X
from ..functions import tokens as T
from ..functions import vectors as V
from ..functions.dialogue import literal_fraction
from ..operators import evidence as EV
from ..operators import films, imports, ocr, transcripts
from ..operators import library as L
from ..sources import store, views
from ..sources.manifest import scratch_folder
from ..sources.views import HAS_EMAIL, MEDIA, SEGMENTS, UTTERANCES
from .queries import query


@query(f"WITH {MEDIA} SELECT row_id, ({HAS_EMAIL}) AS has_email FROM media")
def email_flags(spark: SparkSession, d: str) -> DataFrame:
    return views.media(spark, d).select("row_id", E.has_email(F.col("ocr")).alias("has_email"))


@query()
def emails_per_file(spark: SparkSession, d: str) -> DataFrame:
    """Addresses in order; the rules of overlapping matches have no SQL, tests have fixtures."""
    return EV.emails_per_file(views.media(spark, d)).select("filename", F.array_join("emails", " ").alias("emails"))


# --- recognised words ---------------------------------------------------------------

#: The words of a text as if they had been recognised, in rows of eight, forty-eight to a screen.
WORDS = """w AS (SELECT doc_id, i, t, 60 + (i * 7 + doc_id) % 41 AS conf, (i % 8) * 120.0 - 20 AS x0, (i // 8 % 6) * 50.0 AS y0, (i % 8) * 120.0 + 60 AS x1, (i // 8 % 6) * 50.0 + 30 * (i % 5) AS y1
  FROM (SELECT doc_id, unnest(range(len(ws))) AS i, ws, ws[i + 1] AS t FROM (SELECT doc_id, list_filter(string_split(coalesce(text, ''), ' '), lambda x: x <> '') AS ws FROM documents)))"""
REAL = "length(regexp_replace(t, '[^\\p{L}\\p{N}]', '', 'g')) >= 2 AND regexp_matches(t, '\\p{L}')"


def recognised(spark: SparkSession, d: str) -> DataFrame:
    docs = views.table(spark, d, "documents").select("doc_id", F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda x: x != "").alias("ws"))
    at = lambda word, i: F.struct(word.alias("text"), (60 + (i * 7 + F.col("doc_id")) % 41).cast("double").alias("confidence"), ((i % 8) * 120.0 - 20).alias("x0"), (F.floor(i / 8) % 6 * 50.0).alias("y0"), ((i % 8) * 120.0 + 60).alias("x1"), (F.floor(i / 8) % 6 * 50.0 + 30.0 * (i % 5)).alias("y1"))
    return docs.select(F.col("doc_id").cast("string").alias("filename"), F.transform("ws", at).alias("words"), F.lit(900).alias("width"), F.lit(300).alias("height"), F.lit(None).cast("string").alias("raw"))


@query(f"""WITH {WORDS}, k AS (SELECT doc_id, i, trim(t) AS t, greatest(0, least(900, x0)) AS x0, greatest(0, least(300, y0)) AS y0, least(900, x1) AS x1, least(300, y1) AS y1 FROM w WHERE conf >= 70 AND {REAL})
SELECT CAST(doc_id AS VARCHAR) AS filename, count(*) AS n, round(sum((greatest(x1, x0) - x0) / 900), 6) AS wide, round(sum((greatest(y1, y0) - y0) / 300), 6) AS high, string_agg(t, ' ' ORDER BY i) AS texts FROM k WHERE x1 > x0 AND y1 > y0 GROUP BY doc_id""")
def ocr_clean_words(spark: SparkSession, d: str) -> DataFrame:
    w = ocr.clean_words(recognised(spark, d)).where(F.size("words") > 0)
    total = lambda c: F.round(F.aggregate("words", F.lit(0.0), lambda s, x: s + x[c]), 6)
    return w.select("filename", F.size("words").cast("long").alias("n"), total("w").alias("wide"), total("h").alias("high"), F.array_join(F.transform("words", lambda x: x["text"]), " ").alias("texts"))


@query(f"""WITH {WORDS}, k AS (SELECT doc_id, string_agg(trim(t), ' ' ORDER BY i) AS s FROM w WHERE conf >= 70 AND {REAL} GROUP BY 1)
SELECT CAST(doc_id AS VARCHAR) AS filename, left(coalesce(trim(regexp_replace(s, '\\s+', ' ', 'g')), ''), 2000) AS ocr FROM documents LEFT JOIN k USING (doc_id)""")
def ocr_text(spark: SparkSession, d: str) -> DataFrame:
    return ocr.ocr_text(recognised(spark, d))


@query(f"""WITH {MEDIA}, m AS (SELECT *, CASE WHEN row_id % 3 > 0 THEN CASE WHEN row_id % 4 = 0 THEN 0 ELSE 5 END END AS words FROM media WHERE row_id % 5 <> 0)
SELECT filename, CASE WHEN words IS NULL THEN 'no boxes' ELSE 'text without boxes' END AS reason FROM m WHERE words IS NULL OR words = 0 AND length(coalesce(ocr, '')) > 0""")
def plan_ocr(spark: SparkSession, d: str) -> DataFrame:
    n = F.when(F.col("row_id") % 3 > 0, F.when(F.col("row_id") % 4 == 0, 0).otherwise(5))
    m = views.media(spark, d).withColumn("words", F.when(n == 0, F.array().cast("array<string>")).when(n == 5, F.array_repeat(F.lit("w"), 5)))
    return ocr.plan_ocr(m, "eng+jpn", "eng+jpn")


@query(f"""WITH {MEDIA} SELECT filename, 'languages' AS reason FROM media WHERE row_id % 5 <> 0""")
def plan_reocr(spark: SparkSession, d: str) -> DataFrame:
    return ocr.plan_ocr(views.media(spark, d).withColumn("words", F.lit(None).cast("array<string>")), "eng+jpn", "eng")


@query(f"""WITH {MEDIA} SELECT filename, CASE WHEN row_id % 5 = 0 THEN false WHEN row_id % 2 = 0 THEN true END AS hint, CAST(CASE WHEN row_id % 3 = 0 THEN row_id WHEN row_id % 4 = 0 THEN row_id * 2 ELSE row_id * 3 END AS DOUBLE) AS mtime FROM media""")
def plan_metadata(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("row_id")
    m = views.media(spark, d).withColumn("hint", F.when((r % 5 != 0) & (r % 2 == 0), True)).withColumn("mtime", F.when(r % 3 == 0, r.cast("double")))
    return ocr.plan_metadata(m, m.select("filename", F.when(r % 4 == 0, (r * 2).cast("double")).alias("source_mtime"), (r * 3).cast("double").alias("copy_mtime")))


@query(f"""WITH {MEDIA}, q AS (SELECT *, split_part(coalesce(ocr, ''), ' ', 1) || ' ' || split_part(coalesce(ocr, ''), ' ', 3) AS asked, list_filter(string_split(coalesce(ocr, ''), ' '), lambda x: x <> '') AS ws FROM media),
t AS (SELECT *, list_distinct(list_filter(flatten(list_transform(list_filter(regexp_split_to_array(lower(asked), '\\s+'), lambda x: length(x) >= 2), lambda x: regexp_split_to_array(x, '[^\\p{{L}}\\p{{N}}]+'))), lambda x: x <> '')) AS tokens FROM q)
SELECT row_id, len(list_filter(ws, lambda w: len(list_intersect(tokens, list_filter(regexp_split_to_array(lower(w), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''))) > 0)) AS hits,
len(list_filter(ws, lambda w: len(list_filter(tokens, lambda k: contains(lower(w), k))) > 0)) AS parts FROM t""")
def highlight_words(spark: SparkSession, d: str) -> DataFrame:
    text = F.coalesce("ocr", F.lit(""))
    words = F.transform(F.filter(F.split(text, " "), lambda x: x != ""), lambda x: F.struct(x.alias("text")))
    m = views.media(spark, d).select("row_id", F.concat(F.coalesce(F.get(F.split(text, " "), F.lit(0)), F.lit("")), F.lit(" "), F.coalesce(F.get(F.split(text, " "), F.lit(2)), F.lit(""))).alias("asked"), words.alias("words"))
    return m.select("row_id", F.size(EV.highlight_words(F.col("asked"), F.col("words"))).cast("long").alias("hits"), F.size(EV.highlight_words(F.col("asked"), F.col("words"), True)).cast("long").alias("parts"))


# --- imports ------------------------------------------------------------------------

BATCH = """batch AS (SELECT doc_id AS idx, 'dir/' || (doc_id // 2) || CASE WHEN (doc_id // 2) % 9 = 0 THEN '.txt' ELSE '.png' END AS path, CASE WHEN doc_id % 7 > 0 THEN CAST(doc_id * 37 % 1000 AS DOUBLE) END AS mtime_ms,
  doc_id % 100 AS size, (doc_id // 2) % 11 > 0 AS found, sha256(text) AS hash FROM documents)"""


def batch(spark: SparkSession, d: str) -> DataFrame:
    i, half = F.col("doc_id"), F.floor(F.col("doc_id") / 2)
    path = F.concat(F.lit("dir/"), half.cast("string"), F.when(half % 9 == 0, ".txt").otherwise(".png"))
    return views.table(spark, d, "documents").select(i.alias("idx"), path.alias("path"), F.when(i % 7 > 0, (i * 37 % 1000).cast("double")).alias("mtime_ms"), (i % 100).alias("size"), (half % 11 > 0).alias("found"), F.sha2("text", 256).alias("hash"))


@query(f"""WITH {BATCH}, one AS (SELECT * FROM batch QUALIFY row_number() OVER (PARTITION BY path ORDER BY idx) = 1),
known AS (SELECT DISTINCT path FROM batch WHERE idx % 26 = 4), held AS (SELECT DISTINCT hash FROM batch WHERE idx % 10 = 3), poison AS (SELECT DISTINCT path, size, mtime_ms FROM batch WHERE idx % 8 = 2 AND mtime_ms IS NOT NULL)
SELECT idx, o.path, o.mtime_ms, CASE WHEN reason IS NULL THEN 'added' WHEN reason IN ('File not found', 'Unsupported file type') THEN 'error' ELSE 'skipped' END AS status, reason FROM (
SELECT *, CASE WHEN path IN (SELECT path FROM known) THEN 'known source' WHEN (path, size, mtime_ms) IN (SELECT (path, size, mtime_ms) FROM poison) THEN 'failed before' WHEN NOT found THEN 'File not found'
  WHEN path NOT LIKE '%.png' THEN 'Unsupported file type' WHEN hash IN (SELECT hash FROM held WHERE hash IS NOT NULL) THEN 'known content' END AS reason FROM one) o""")
def plan_import(spark: SparkSession, d: str) -> DataFrame:
    b = batch(spark, d)
    media = b.select(F.when(F.col("idx") % 26 == 4, F.col("path")).alias("source_path"), F.when(F.col("idx") % 10 == 3, F.col("hash")).alias("hash"))
    return imports.plan_import(b, media, b.select("path", "size", "mtime_ms", F.when(F.col("idx") % 8 == 2, 3).otherwise(1).alias("count")), from_watch=True)


@query(f"""WITH {BATCH} SELECT status, count(*) AS n FROM (SELECT CASE WHEN path LIKE '%.txt' THEN 'error' ELSE 'added' END AS status FROM batch) GROUP BY 1""")
def import_summary(spark: SparkSession, d: str) -> DataFrame:
    return imports.import_summary(batch(spark, d).select(F.when(F.col("path").endswith(".txt"), "error").otherwise("added").alias("status")))


@query(f"""WITH {BATCH} SELECT idx, path, CAST(row_number() OVER (ORDER BY mtime_ms ASC NULLS FIRST, idx) AS BIGINT) AS place FROM batch""")
def import_order(spark: SparkSession, d: str) -> DataFrame:
    """Places made gapless only to be compared: rows of a partition and all before it are counted, no task sees all.
    Sorted once and written, as ranges are cut anew by each evaluation and what is counted must be what is numbered."""
    sorted_ = scratch_folder(spark, "order")
    imports.import_order(batch(spark, d)).select("idx", "path", "nth").write.parquet(sorted_)
    o = spark.read.parquet(sorted_).withColumn("part", F.shiftright("nth", 33)).withColumn("own", F.col("nth").bitwiseAND((1 << 33) - 1))
    sizes = o.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.alias("a").join(sizes.alias("b"), F.col("b.part") < F.col("a.part"), "left").groupBy("a.part").agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("before"))
    return o.join(F.broadcast(before), "part").select("idx", "path", (F.col("own") + F.col("before") + 1).alias("place"))


@query(f"""WITH {BATCH} SELECT idx, path FROM batch WHERE path NOT IN (SELECT path FROM batch WHERE idx % 3 = 0)""")
def drop_known_paths(spark: SparkSession, d: str) -> DataFrame:
    b = batch(spark, d)
    return imports.drop_known_paths(b, b.where("idx % 3 = 0").select(F.col("path").alias("source_path"))).select("idx", "path")


FAILURES = "f AS (SELECT CASE WHEN event_id % 5 = 0 THEN 'Indexer exited: ' ELSE 'broken file ' END || event_id % 3 AS message FROM events WHERE event_type <> 'view')"


@query(f"""WITH {FAILURES} SELECT message, count(*) AS n, count(*) OVER () = 1 AS systemic, message LIKE 'Indexer exited%' AS engine FROM f GROUP BY 1""")
def failure_summary(spark: SparkSession, d: str) -> DataFrame:
    e = views.table(spark, d, "events").where("event_type <> 'view'")
    f = e.select(F.concat(F.when(F.col("event_id") % 5 == 0, "Indexer exited: ").otherwise("broken file "), (F.col("event_id") % 3).cast("string")).alias("message"))
    return imports.summarize_failures(f, 10**9).withColumn("engine", imports.is_system_error(F.col("message")))


@query(f"""WITH {MEDIA} SELECT row_id, filename FROM media WHERE row_id % 7 <> 0""")
def prune_missing(spark: SparkSession, d: str) -> DataFrame:
    m = views.media(spark, d).select("row_id", "filename")
    return imports.prune_missing(m, m.where("row_id % 7 <> 0"))


@query(f"""WITH {MEDIA} SELECT row_id, filename FROM media""")
def prune_stopped(spark: SparkSession, d: str) -> DataFrame:
    """More than half of the files are missing: nothing goes."""
    m = views.media(spark, d).select("row_id", "filename")
    return imports.prune_missing(m, m.where("row_id % 7 = 0"))


HEADS = [("89504E470D0A1A0A", "image/png"), ("FFD8FF", "image/jpeg"), ("524946460102030457454250", "image/webp"), ("474946383961", "image/gif"), ("000000006674797061766966", "image/avif"), ("000000006674797068656963", "image/heic"), ("424D", "image/bmp"), ("4D4D002A", "image/tiff"), ("00000100", "image/x-icon"), ("3C7376673E", "image/svg+xml"), ("00", None)]


@query("WITH m AS (SELECT doc_id, CASE doc_id % 11 " + " ".join(f"WHEN {i} THEN '{m}'" for i, (_, m) in enumerate(HEADS) if m) + " END AS mime FROM documents) SELECT doc_id, mime, mime IS NOT NULL AND NOT (mime = 'image/png' AND doc_id % 2 = 0) AS rename FROM m")
def content_type(spark: SparkSession, d: str) -> DataFrame:
    head = F.element_at(F.array(*(F.lit(h) for h, _ in HEADS)), (F.col("doc_id") % 11 + 1).cast("int"))
    files = views.table(spark, d, "documents").select("doc_id", F.concat(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, ".png").otherwise(".dat")).alias("path"), F.concat(F.unhex(head), F.coalesce("text", F.lit("")).cast("binary")).alias("content"))
    return files.select("doc_id", "path").join(imports.content_type(files), "path").select("doc_id", "mime", "rename")


@query("SELECT doc_id, doc_id % 4 < 2 AND contains(lower(coalesce(text, '')), 'da') AS hint FROM documents")
def screenshot_hints(spark: SparkSession, d: str) -> DataFrame:
    """Each text as the comment of a picture, in a chunk of a PNG, a JPEG's EXIF block, a cut PNG or no picture at all; `da` in it is spelled `screenshot`."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "(?i)da", "ScreenShot").cast("binary")
    number = lambda n: F.unhex(F.lpad(F.hex(n), 8, "0"))
    png = F.concat(F.unhex(F.lit("89504E470D0A1A0A")), number(F.octet_length(text) + 8), F.lit("tEXtComment").cast("binary"), F.unhex(F.lit("00")), text, number(F.lit(0)))
    tiff = F.concat(F.unhex(F.lit("4D4D002A00000008")), F.unhex(F.lit("0001876900040000000100000018" + "0000")), F.unhex(F.lit("00019286" + "0007")), number(F.octet_length(text) + 8), F.unhex(F.lit("00000026")), F.lit("ASCII").cast("binary"), F.unhex(F.lit("000000")), text)
    jpeg = F.concat(F.unhex(F.lit("FFD8FFE1")), F.substring(number(F.octet_length(tiff) + 8), 3, 2), F.lit("Exif").cast("binary"), F.unhex(F.lit("0000")), tiff)
    kind = F.col("doc_id") % 4
    content = F.when((kind == 0) | (kind == 1) & (F.octet_length(tiff) > 65_000), png).when(kind == 1, jpeg).when(kind == 2, F.substring(png, 1, 12)).otherwise(text)
    files = views.table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), content.alias("content"))
    return imports.screenshot_hints(files).select(F.col("path").cast("long").alias("doc_id"), "hint")


@query(f"""WITH {MEDIA} SELECT row_id, CASE WHEN row_id % 2 = 0 THEN hash WHEN row_id % 3 = 0 THEN sha256(ocr) END AS hash FROM media""")
def backfill_hashes(spark: SparkSession, d: str) -> DataFrame:
    m = views.media(spark, d).withColumn("hash", F.when(F.col("row_id") % 2 == 0, F.col("hash")))
    return imports.backfill_hashes(m, m.where("row_id % 3 = 0").select("filename", F.col("ocr").cast("binary").alias("content"))).select("row_id", "hash")


URLS = ["https://www.youtube.com/watch?v=abc{}", "https://youtu.be/xyz{}?t=3", "https://m.youtube.com/shorts/s{}/x", "https://www.youtube.com/@name{}", "https://youtube.com/playlist?list=PL{}", "https://youtube.com/playlist?x={}", "https://youtube.com/results?q={}", "@handle{}", "https://youtube.com/c/{}/videos"]
KINDS = [("video", "abc"), ("video", "xyz"), ("video", "s"), ("channel", None), ("playlist", None), ("unknown", None), ("unknown", None), ("channel", None), ("channel", None)]


@query("SELECT page_id, CASE page_id % 10 " + " ".join(f"WHEN {i} THEN '{k}'" for i, (k, _) in enumerate(KINDS)) + " ELSE 'unknown' END AS kind, CASE page_id % 10 " + " ".join(f"WHEN {i} THEN '{v}' || page_id" for i, (_, v) in enumerate(KINDS) if v) + " END AS id FROM pages")
def classify_url(spark: SparkSession, d: str) -> DataFrame:
    """Page addresses as they are, and of nine kinds."""
    made = F.element_at(F.array(*(F.format_string(u.replace("{}", "%d"), "page_id") for u in URLS), F.col("url")), (F.col("page_id") % 10 + 1).cast("int"))
    return views.table(spark, d, "pages").select("page_id", imports.classify_url(made).alias("u")).select("page_id", "u.kind", "u.id")


@query("""SELECT lpad(CAST(page_id AS VARCHAR), 11, 'x') AS id, 'film [' || lpad(CAST(page_id AS VARCHAR), 11, 'x') || '].mp4' AS filename, url FROM pages WHERE page_id % 3 = 0 AND page_id % 4 <> 0""")
def backfill_sources(spark: SparkSession, d: str) -> DataFrame:
    p = views.table(spark, d, "pages").withColumn("id", F.lpad(F.col("page_id").cast("string"), 11, "x"))
    info = p.select("id", F.lit("c").alias("channel"), "url", F.lit("t").alias("title"))
    return imports.backfill_sources(info, p.where("page_id % 3 = 0").select(F.concat(F.lit("film ["), "id", F.lit("].mp4")).alias("filename")), p.where("page_id % 4 = 0").select("id")).select("id", "filename", "url")


# --- films and transcripts --------------------------------------------------------------

DURATIONS = "durations AS (SELECT 'c' || o_orderkey AS filename, CAST(o_orderkey * 13 % 9000 AS DOUBLE) AS duration FROM orders)"


def durations(spark: SparkSession, d: str) -> DataFrame:
    return views.table(spark, d, "orders").select(F.concat(F.lit("c"), "o_orderkey").alias("filename"), (F.col("o_orderkey") * 13 % 9000).cast("double").alias("duration"))


@query(f"""WITH {DURATIONS}, p(preset, target, low, high) AS (VALUES ('eco', 60.0, 4, 32), ('balanced', 30.0, 8, 128), ('detailed', 15.0, 12, 256), ('ultra', 5.0, 16, 1024), ('ultraPro', 2.5, 24, 2048)),
s AS (SELECT preset, CAST(sum(greatest(low, least(high, ceil(duration / CAST(target AS DOUBLE))))) AS BIGINT) AS segments FROM durations, p WHERE duration > 0 GROUP BY 1)
SELECT preset, segments, segments * 3 / 60 AS minutes_low, segments * 5 / 60 AS minutes_high, segments * 53248 AS disk_bytes FROM s""")
def enrichment_cost(spark: SparkSession, d: str) -> DataFrame:
    return films.enrichment_cost(durations(spark, d))


CUTS = """cuts AS (SELECT 'c' || l_orderkey AS filename, CAST(l_partkey * 7 % 900 + 1 AS DOUBLE) AS t FROM lineitem), lengths AS (SELECT 'c' || o_orderkey AS filename, CAST(1000 + o_orderkey % 50 AS DOUBLE) AS duration FROM orders)"""


def cuts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    at = views.table(spark, d, "lineitem").select(F.concat(F.lit("c"), "l_orderkey").alias("filename"), (F.col("l_partkey") * 7 % 900 + 1).cast("double").alias("t"))
    return at, views.table(spark, d, "orders").select(F.concat(F.lit("c"), "o_orderkey").alias("filename"), (1000 + F.col("o_orderkey") % 50).cast("double").alias("duration"))


@query(f"""WITH {CUTS}, e AS (SELECT DISTINCT filename, t FROM cuts UNION SELECT filename, 0.0 FROM lengths WHERE filename IN (SELECT filename FROM cuts)),
s AS (SELECT filename, t, coalesce(lead(t) OVER (PARTITION BY filename ORDER BY t), duration) AS e, duration FROM e JOIN lengths USING (filename)),
p AS (SELECT filename, (t + e) / 2 AS t, e - t AS span, duration FROM s UNION ALL SELECT filename, (i + 0.5) * duration / n, duration / n, duration
  FROM (SELECT filename, duration, n, unnest(range(n)) AS i FROM (SELECT *, CAST(greatest(24, least(2048, ceil(duration / 2.5))) AS INTEGER) AS n FROM lengths WHERE filename NOT IN (SELECT filename FROM cuts))))
SELECT filename, round(greatest(0, least(t, duration - 0.5)), 6) AS t, round(greatest(span, 0.5), 6) AS span FROM p""")
def segment_plan(spark: SparkSession, d: str) -> DataFrame:
    """Films here have fewer shots than the budget, or none; sampling of more has a test."""
    at, lengths = cuts(spark, d)
    return films.segment_plan(at, lengths, "ultraPro").select("filename", F.round("t", 6).alias("t"), F.round("span", 6).alias("span"))


@query()
def segment_plan_sampled(spark: SparkSession, d: str) -> DataFrame:
    """Cuts of a customer's orders as one film: more shots than points (greedy, no SQL)."""
    o = views.table(spark, d, "orders")
    film = F.concat(F.lit("c"), (F.col("o_custkey") % 40).cast("string"))
    at = o.select(film.alias("filename"), (F.col("o_orderkey") * 11 % 3000 + 0.5).cast("double").alias("t"))
    return films.segment_plan(at, o.select(film.alias("filename")).distinct().withColumn("duration", F.lit(3000.5)), "eco")


@query(f"""WITH {DURATIONS} SELECT filename, CAST(i AS INTEGER) AS i, round(CASE WHEN duration <= 0.5 THEN 0 ELSE greatest(0, least(duration - 0.5, duration * [0.2, 0.5, 0.8][i + 1])) END, 6) AS t
FROM (SELECT *, unnest(range(CASE WHEN duration <= 0.5 THEN 1 ELSE 3 END)) AS i FROM durations)""")
def frame_times(spark: SparkSession, d: str) -> DataFrame:
    return films.frame_times(durations(spark, d)).select("filename", "i", F.round("t", 6).alias("t"))


@query("""WITH c AS (SELECT o_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS q, o_orderkey % 60 AS s FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
SELECT CAST(o_orderkey AS VARCHAR) AS filename, array_to_string(list_transform(list_sort(list_distinct(list(q))), lambda x: CAST(x AS VARCHAR)), ' ') AS boundaries, 3600.0::DOUBLE + 120 + any_value(s) + 0.5 AS duration FROM c GROUP BY 1""")
def parse_cut_log(spark: SparkSession, d: str) -> DataFrame:
    line = views.table(spark, d, "lineitem")
    logs = line.groupBy(F.col("l_orderkey").alias("k")).agg(F.concat_ws("\n", F.collect_list(F.concat(F.lit("n:1 pts_time:"), F.col("l_quantity").cast("double").cast("string"), F.lit(" time=00:00:01.00")))).alias("log"))
    logs = logs.select(F.col("k").cast("string").alias("filename"), F.concat("log", F.lit("\nframe=9 time=01:02:"), F.lpad((F.col("k") % 60).cast("string"), 2, "0"), F.lit(".5 speed=1x")).alias("log"))
    return films.parse_cut_log(logs).select("filename", F.array_join(F.transform("boundaries", lambda x: x.cast("string")), " ").alias("boundaries"), "duration")


@query(f"""WITH {CUTS}, c AS (SELECT DISTINCT filename, t FROM cuts), r AS (SELECT filename, t, t + k * 0.25 - (CAST(t AS BIGINT) % 3) * 0.5 AS hit FROM c, (VALUES (0), (1), (2)) v(k) WHERE CAST(t AS BIGINT) % 4 > 0),
n AS (SELECT filename, t, hit FROM r QUALIFY row_number() OVER (PARTITION BY filename, t ORDER BY abs(hit - t), hit) = 1)
SELECT DISTINCT filename, coalesce(hit, t) AS t FROM c LEFT JOIN n USING (filename, t)""")
def refine_cuts(spark: SparkSession, d: str) -> DataFrame:
    c = cuts(spark, d)[0].distinct()
    whole = F.col("t").cast("long")
    r = c.where(whole % 4 > 0).select("filename", "t", F.explode(F.array(*(F.col("t") + k * 0.25 - (whole % 3) * 0.5 for k in range(3)))).alias("at"))
    return films.refine_cuts(c, r)


@query(f"""WITH {SEGMENTS}, s AS (SELECT filename, t, dur FROM segments UNION ALL SELECT 'late.mp4', 5000 + t, dur FROM segments), p AS (SELECT filename, min(t) AS a, max(t) AS b, max_by(t + dur / 2, t) AS duration, count(*) AS actual FROM s GROUP BY 1),
q AS (SELECT *, CAST(greatest(16, least(1024, ceil(duration / 5))) AS INTEGER) AS planned FROM p) SELECT filename, planned, actual, duration FROM q WHERE planned > 16 AND actual < planned AND b - a < duration * 0.5""")
def truncated_scenes(spark: SparkSession, d: str) -> DataFrame:
    s = views.segments(spark, d).select("filename", "t", "dur")
    return films.truncated_scenes(s.union(s.select(F.lit("late.mp4"), F.col("t") + 5000, "dur")), "ultra")


@query(f"""WITH {UTTERANCES}, c AS (SELECT filename, t0 + 3000 AS t0, t1 + 3000 AS t1 FROM utterances), p AS (SELECT filename, min(t0) AS a, max(t1) AS duration, count(*) AS actual FROM c GROUP BY 1)
SELECT filename, CAST(ceil(duration / 30) AS BIGINT) AS planned, actual, duration FROM p WHERE ceil(duration / 30) > 16 AND actual < ceil(duration / 30) AND duration - a < duration * 0.5""")
def truncated_transcripts(spark: SparkSession, d: str) -> DataFrame:
    return transcripts.truncated_transcripts(views.utterances(spark, d).select("filename", (F.col("t0") + 3000).alias("t0"), (F.col("t1") + 3000).alias("t1")))


@query()
def transcript_windows(spark: SparkSession, d: str) -> DataFrame:
    """A window's beginning depends on the end of the one before: no SQL, a loop in the tests."""
    return transcripts.transcript_windows(views.utterances(spark, d))


PROGRESS = "p AS (SELECT 'conv-' || conv_id || '.mp4' AS filename, conv_id % 5 AS done, 4 AS total, [conv_id % 3, 1, -2] AS skipped FROM (SELECT DISTINCT conv_id FROM conversations))"


@query(f"""WITH {PROGRESS}, f AS (SELECT *, filename LIKE '%3.mp4' AS fresh FROM p) SELECT filename, CAST(CASE WHEN fresh THEN 0 ELSE done END AS BIGINT) AS off,
CASE WHEN NOT fresh AND done < total THEN array_to_string(list_sort(list_distinct(list_filter(skipped, lambda x: x >= 0))), ' ') ELSE '' END AS skipped FROM f WHERE fresh OR done < total""")
def plan_transcripts(spark: SparkSession, d: str) -> DataFrame:
    c = views.table(spark, d, "conversations").select("conv_id").distinct()
    p = c.select(F.concat(F.lit("conv-"), "conv_id", F.lit(".mp4")).alias("filename"), (F.col("conv_id") % 5).alias("done"), F.lit(4).alias("total"), F.array(F.col("conv_id") % 3, F.lit(1).cast("long"), F.lit(-2).cast("long")).alias("skipped"))
    out = transcripts.plan_transcripts(p, p.where("filename NOT LIKE '%3.mp4'"), p)
    return out.select("filename", "off", F.coalesce(F.array_join(F.transform("skipped", lambda x: x.cast("string")), " "), F.lit("")).alias("skipped"))


@query(f"""WITH {PROGRESS} SELECT filename, done = 1 AS has_audio FROM p WHERE filename NOT IN (SELECT 'conv-' || conv_id || '.mp4' FROM conversations WHERE role = 'user' AND conv_id % 2 = 0)""")
def repair_candidates(spark: SparkSession, d: str) -> DataFrame:
    c = views.table(spark, d, "conversations").withColumn("filename", F.concat(F.lit("conv-"), "conv_id", F.lit(".mp4")))
    return transcripts.repair_candidates(c, c.where("role = 'user' AND conv_id % 2 = 0"), c.select("filename", (F.col("conv_id") % 5 == 1).alias("has_audio")).distinct())


@query(f"WITH {MEDIA} SELECT filename, CAST(0 AS BIGINT) AS off FROM media WHERE row_id % 5 = 0")
def plan_retranscribe(spark: SparkSession, d: str) -> DataFrame:
    return transcripts.plan_retranscribe(views.media(spark, d)).select("filename", "off")


# --- stores ----------------------------------------------------------------------------


@query(f"""WITH {MEDIA} SELECT row_id, filename, hash, CASE WHEN substr(hash, 1, 1) < '8' THEN 'Projects' ELSE 'Screenshots' END AS override FROM media WHERE hash IS NOT NULL""")
def export_index(spark: SparkSession, d: str) -> DataFrame:
    m = views.media(spark, d).where("hash IS NOT NULL")
    o = m.select("hash", F.when(F.substring("hash", 1, 1) < "8", "Projects").otherwise("Screenshots").alias("category")).distinct()
    return store.export_index(m, o).select("row_id", "filename", "hash", "override")


@query(f"""WITH {MEDIA}, n AS (SELECT hash, arg_max(CASE WHEN row_id % 3 > 0 THEN 1 ELSE 0 END, row_id) AS c, max(row_id) AS r FROM media WHERE row_id % 2 = 0 GROUP BY 1),
o AS (SELECT DISTINCT hash FROM media WHERE source = 'src3') SELECT hash, CASE WHEN n.hash IS NULL THEN 'Projects' WHEN c = 1 THEN 'Screenshots' END AS category FROM o FULL JOIN n USING (hash) WHERE n.hash IS NULL OR c = 1""")
def set_overrides(spark: SparkSession, d: str) -> DataFrame:
    m = views.media(spark, d)
    old = m.where("source = 'src3'").select("hash", F.lit("Projects").alias("category")).distinct()
    new = m.where("row_id % 2 = 0").select("filename", F.when(F.col("row_id") % 3 > 0, "Screenshots").alias("category"), F.col("row_id").alias("at"))
    return store.set_overrides(old, new, m)


@query(f"""WITH {MEDIA}, {SEGMENTS}, gone AS (SELECT filename FROM media WHERE row_id % 4 = 0 UNION SELECT filename FROM segments WHERE poster = 0 AND filename LIKE '%1.mp4')
SELECT 'media' AS part, count(*) AS n FROM media WHERE filename NOT IN (SELECT filename FROM gone) UNION ALL SELECT 'segments', count(*) FROM segments WHERE filename NOT IN (SELECT filename FROM gone)""")
def delete_files(spark: SparkSession, d: str) -> DataFrame:
    m, s = views.media(spark, d), views.segments(spark, d)
    gone = m.where("row_id % 4 = 0").select("filename").union(s.where("poster = 0 AND filename LIKE '%1.mp4'").select("filename"))
    out = store.delete_files({"media": m, "segments": s}, gone)
    return out["media"].agg(F.count("*").alias("n")).select(F.lit("media").alias("part"), "n").union(out["segments"].agg(F.count("*").alias("n")).select(F.lit("segments"), "n"))


@query(f"""WITH {SEGMENTS}, {UTTERANCES}, m AS (SELECT DISTINCT filename FROM segments WHERE filename NOT LIKE '%3.mp4' UNION SELECT filename FROM utterances WHERE filename LIKE '%1.mp4')
SELECT 'segments' AS part, count(*) FILTER (filename IN (SELECT filename FROM m)) AS kept, count(*) FILTER (filename NOT IN (SELECT filename FROM m)) AS dropped FROM segments
UNION ALL SELECT 'utterances', count(*) FILTER (filename IN (SELECT filename FROM m)), count(*) FILTER (filename NOT IN (SELECT filename FROM m)) FROM utterances""")
def orphan_counts(spark: SparkSession, d: str) -> DataFrame:
    s, u = views.segments(spark, d), views.utterances(spark, d)
    m = s.where("filename NOT LIKE '%3.mp4'").select("filename").union(u.where("filename LIKE '%1.mp4'").select("filename"))
    return L.orphan_counts({"segments": s, "utterances": u}, m)


@query(f"""WITH {MEDIA} SELECT filename, row_id % 3 = 1 AS reuse, CASE row_id % 3 WHEN 0 THEN 'absent' WHEN 1 THEN 'reused' ELSE 'zero' END AS reason FROM media""")
def plan_reembed(spark: SparkSession, d: str) -> DataFrame:
    m = views.media_vectors(spark, d, views.media(spark, d))
    cached = m.where("row_id % 3 > 0").select(F.col("row_id").alias("at"), "filename", "embedding", F.when(F.col("row_id") % 3 == 1, F.col("phrase")).otherwise(F.transform("phrase", lambda x: x * 0)).alias("phrase"))
    return store.plan_reembed(m, cached, {"code_version": 1, "dim": 64, "count": cached.count()}, 1, 64)


# --- vectors and words --------------------------------------------------------------------


@query("""WITH f AS (SELECT label, unnest(range(len(embedding))) AS pos, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings), m AS (SELECT label, pos, sum(x) AS x FROM f GROUP BY ALL),
n AS (SELECT label, sqrt(sum(x * x)) AS n FROM m GROUP BY 1) SELECT label, pos, round(x / n, 9) AS x FROM m JOIN n USING (label)""")
def mean_direction(spark: SparkSession, d: str) -> DataFrame:
    return V.mean_direction(views.table(spark, d, "embeddings"), ["label"], "embedding").select("label", F.posexplode("vec").alias("p", "x")).select("label", F.col("p").cast("long").alias("pos"), F.round("x", 9).alias("x"))


@query("""WITH e AS (SELECT vec_id // 3 AS g, vec_id % 3 AS i, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), a AS (SELECT e.g, list_transform(list_zip(e.v, f.v), lambda p: p[1] + p[2]) AS v, h.v AS w FROM e JOIN e f ON f.g = e.g AND f.i = 1 JOIN e h ON h.g = e.g AND h.i = 2 WHERE e.i = 0),
b AS (SELECT g, list_transform(list_zip(list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))), w), lambda p: p[1] + p[2]) AS v FROM a) SELECT g, round(v[1] / sqrt(list_dot_product(v, v)), 9) AS first, round(v[64] / sqrt(list_dot_product(v, v)), 9) AS last FROM b""")
def fold_frames(spark: SparkSession, d: str) -> DataFrame:
    e = views.table(spark, d, "embeddings").groupBy(F.floor(F.col("vec_id") / 3).alias("g")).agg(F.collect_list(F.struct((F.col("vec_id") % 3).alias("idx"), F.col("embedding").alias("vec"))).alias("frames")).where(F.size("frames") == 3)
    v = e.select("g", V.fold_frames(F.col("frames")).alias("v"))
    return v.select("g", F.round(F.get("v", F.lit(0)), 9).alias("first"), F.round(F.get("v", F.lit(63)), 9).alias("last"))


@query("""SELECT item_id, CASE WHEN length(t) >= 4 THEN t || '|a photo of ' || t || '|a screenshot of ' || t ELSE t END AS templates, CASE WHEN regexp_matches(t, '(?i)^(task|title)\\s*:') THEN t ELSE 'task: search result | query: ' || t END AS q,
CASE WHEN regexp_matches(t, '(?i)^(task|title)\\s*:') THEN t ELSE 'title: ' || CASE WHEN item_id % 2 = 0 THEN 'none' ELSE 'T' END || ' | text: ' || t END AS doc
FROM (SELECT item_id, CASE item_id % 4 WHEN 0 THEN left(trim(text), 3) WHEN 1 THEN 'Task : ' || left(trim(text), 9) ELSE left(trim(text), 30) END AS t0, trim(t0) AS t FROM benchmark)""")
def query_texts(spark: SparkSession, d: str) -> DataFrame:
    t = F.trim("text")
    cut = F.when(F.col("item_id") % 4 == 0, F.substring(t, 1, 3)).when(F.col("item_id") % 4 == 1, F.concat(F.lit("Task : "), F.substring(t, 1, 9))).otherwise(F.substring(t, 1, 30))
    b = views.table(spark, d, "benchmark").select("item_id", cut.alias("t"), F.when(F.col("item_id") % 2 == 0, " ").otherwise("T").alias("title"))
    return b.select("item_id", F.array_join(V.query_templates(F.col("t")), "|").alias("templates"), V.query_prefix(F.col("t")).alias("q"), V.document_prefix(F.col("t"), F.col("title")).alias("doc"))


@query("""SELECT event_type, median(value) AS middle, list_sort(list(value))[CAST(ceil(0.95 * count(*)) AS BIGINT)] AS high, list_sort(list(value))[CAST(greatest(1, ceil(0.05 * count(*))) AS BIGINT)] AS low FROM events WHERE value IS NOT NULL GROUP BY 1""")
def percentiles(spark: SparkSession, d: str) -> DataFrame:
    e = views.table(spark, d, "events").where("value IS NOT NULL")
    return e.groupBy("event_type").agg(F.median("value").alias("middle"), V.percentile_nearest("value", 0.95).alias("high"), V.percentile_nearest("value", 0.05).alias("low"))


@query("""SELECT vec_id, CASE WHEN vec_id % 11 = 0 THEN 'empty' WHEN vec_id % 11 = 1 THEN 'wrong dimension' WHEN vec_id % 11 = 2 THEN 'not finite' ELSE 'good' END AS verdict FROM embeddings""")
def validated_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors that can be used and those that can't, with the reason."""
    k = F.col("vec_id") % 11
    v = F.when(k == 0, F.slice("embedding", 1, 0)).when(k == 1, F.slice("embedding", 1, 9)).when(k == 2, F.transform("embedding", lambda x, i: F.when(i == 3, F.lit(float("nan"))).otherwise(x.cast("double"))).cast("array<float>")).otherwise(F.col("embedding"))
    good, bad = V.validated(views.table(spark, d, "embeddings").select("vec_id", v.alias("v")), "v", 64)
    return good.select("vec_id", F.lit("good").alias("verdict")).union(bad.select("vec_id", F.col("reason").alias("verdict")))


@query(f"""WITH {MEDIA}, x AS (SELECT row_id, filename, lang, trim(regexp_replace(coalesce(source, '') || '  x ' || lang, '\\s+', ' ', 'g')) AS prompt, list_filter(regexp_split_to_array(regexp_replace(lower(filename), '\\.[^.]+$', ''), '[._\\-\\s]+'), lambda x: x <> '') AS ph FROM media)
SELECT row_id, prompt, (CASE WHEN list_contains(ph, lang) THEN 1 ELSE 0 END + CASE WHEN list_contains(ph, 'screenshot') THEN 1 ELSE 0 END) / 2 AS overlap, CASE WHEN row_id % 2 = 0 THEN 'abcdefghi_-' END AS video,
CASE WHEN row_id % 3 = 0 THEN 'ocr semantic' WHEN row_id % 3 = 1 THEN 'semantic ocr' ELSE 'semantic ocr' END AS parts FROM x""")
def small_functions(spark: SparkSession, d: str) -> DataFrame:
    """Saved prompts, words in a name's phrase, ids in brackets, order of signals."""
    m = views.media(spark, d)
    signals = F.create_map(F.lit("semantic"), F.lit(0.5), F.lit("phrase"), F.lit(0.0), F.lit("filename"), F.lit(0.0), F.lit("ocr"), F.lit(0.2))
    dominant = F.when(F.col("row_id") % 3 == 0, "ocr").when(F.col("row_id") % 3 == 1, "semantic").otherwise("phrase")
    return m.select("row_id", X.normalize_prompt(F.concat(F.coalesce("source", F.lit("")), F.lit("  x "), "lang")).alias("prompt"), T.phrase_overlap(F.array("lang", F.lit("screenshot")), F.col("filename")).alias("overlap"),
                    X.video_id(F.when(F.col("row_id") % 2 == 0, "a/b [abcdefghi_-].mp4").otherwise("a [short].mp4")).alias("video"), F.array_join(T.breakdown_order(signals, dominant), " ").alias("parts"))


@query(f"""WITH {UTTERANCES}, q AS (SELECT *, string_split(coalesce(text, ''), ' ') AS ws FROM utterances), t AS (SELECT filename, line, text, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(ws[1], '') || ' ' || coalesce(ws[4], '') || 's zzz'), '[^a-z0-9]+'), lambda x: length(x) >= 2)) AS tokens,
  list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: length(x) >= 2) AS words FROM q)
SELECT filename, line, round(len(list_filter(tokens, lambda k: list_contains(words, k) OR length(k) >= 3 AND len(list_filter(words, lambda w: length(w) >= 3 AND (starts_with(w, k) OR starts_with(k, w)))) > 0)) / len(tokens), 9) AS literal FROM t""")
def literal_share(spark: SparkSession, d: str) -> DataFrame:
    ws = F.split(F.coalesce("text", F.lit("")), " ")
    asked = F.concat(F.coalesce(F.get(ws, F.lit(0)), F.lit("")), F.lit(" "), F.coalesce(F.get(ws, F.lit(3)), F.lit("")), F.lit("s zzz"))
    return views.utterances(spark, d).select("filename", "line", F.round(literal_fraction(asked, F.col("text")), 9).alias("literal"))
