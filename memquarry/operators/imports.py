"""Import batches: what is added, skipped or refused, and the checks around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.media import IMAGE, VIDEO, extension
from ..functions.probe import screenshot_hint

# Failures after which a file is left alone, failures that are one cause, messages of the engine, and the first bytes of pictures.
POISON, SYSTEMIC = 3, 5
ENGINE = ["Indexer not running", "Indexer exited", "AI indexing unavailable"]
MAGIC = [
    ("image/png", r"^89504E470D0A1A0A"), ("image/jpeg", "^FFD8FF"), ("image/webp", "^52494646.{8}57454250"), ("image/gif", "^474946383[79]61"), ("image/avif", "^.{8}6674797061766966"),
    ("image/heic", "^.{8}66747970(68656963|68656978|68657663|68657678)"), ("image/bmp", "^424D"), ("image/tiff", "^(49492A00|4D4D002A)"), ("image/x-icon", "^00000100"), ("image/svg+xml", "^(3C73766720|3C7376673E|3C3F786D6C)"),
]
CANONICAL = {"image/jpeg": ".jpg", "image/png": ".png", "image/webp": ".webp", "image/gif": ".gif", "image/avif": ".avif", "image/heic": ".heic", "image/bmp": ".bmp", "image/tiff": ".tiff", "image/x-icon": ".ico", "image/svg+xml": ".svg"}


def keep_first(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_nth = 1").drop("_nth")


def scan_media(spark: SparkSession, folders: list[str]) -> DataFrame:
    """path, mtime, size of the media files in folders and all below them. Only the listing is read, no content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", True).load(folders)
    return files.select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size")).where(extension(F.col("path")).isin([*IMAGE, *VIDEO]))


def expand_paths(spark: SparkSession, paths: list[tuple[str, bool]]) -> DataFrame:
    """(path, is folder) as a user names them -> path, supported: folders become their media files, plain files stay to be reported."""
    plain = spark.createDataFrame([(p,) for p, folder in paths if not folder], "path string")
    folders = [p for p, folder in paths if folder]
    every = plain.union(scan_media(spark, folders).select("path")) if folders else plain
    return every.distinct().withColumn("supported", extension(F.col("path")).isin([*IMAGE, *VIDEO]))


def import_order(batch: DataFrame) -> DataFrame:
    """Oldest first, unknown times before all, then as given (rows without idx last): adds `nth`, which is unique in order, not
    gapless, so that no task sees the whole batch. Another evaluation may number anew; who reads `nth` twice stores it first."""
    finite = F.when(F.isnan(F.col("mtime_ms").cast("double")) | (F.abs(F.col("mtime_ms").cast("double")) == float("inf")), F.lit(None)).otherwise(F.col("mtime_ms"))
    return batch.withColumn("mtime_ms", finite).orderBy(F.col("mtime_ms").asc_nulls_first(), F.col("idx").asc_nulls_last()).withColumn("nth", F.monotonically_increasing_id())


def drop_known_paths(batch: DataFrame, media: DataFrame) -> DataFrame:
    return batch.join(media.select(F.col("source_path").alias("path")).distinct(), "path", "left_anti")


def plan_import(batch: DataFrame, media: DataFrame, failures: DataFrame, from_watch: bool = False) -> DataFrame:
    """batch(idx, path, mtime_ms, size, found, hash), media(source_path, hash),
    failures(path, size, mtime_ms, count) -> path, status, reason; a path is one row however often it is named.

    In this order: its source is known; it failed too often unchanged (watched folders
    only); not found; unsupported; its content is known; else it is added."""
    rows = keep_first(batch, ["path"], F.col("idx"))
    known = media.select(F.col("source_path").alias("path")).where("path IS NOT NULL").distinct().withColumn("known", F.lit(True))
    content = media.select("hash").where("hash IS NOT NULL").distinct().withColumn("held", F.lit(True))
    poison = failures.where(F.col("count") >= POISON).select("path", "size", "mtime_ms").distinct().withColumn("poison", F.lit(True))
    both = rows.join(known, "path", "left").join(content, "hash", "left").join(poison, ["path", "size", "mtime_ms"], "left")
    reason = (
        F.when(F.col("known").isNotNull(), "known source")
        .when(F.lit(from_watch) & F.col("poison").isNotNull(), "failed before")
        .when(~F.coalesce("found", F.lit(False)), "File not found")
        .when(~extension(F.col("path")).isin([*IMAGE, *VIDEO]), "Unsupported file type")
        .when(F.col("held").isNotNull(), "known content")
    )
    status = F.when(reason.isNull(), "added").when(reason.isin("File not found", "Unsupported file type"), "error").otherwise("skipped")
    return both.select("idx", "path", "mtime_ms", status.alias("status"), reason.alias("reason"))


def import_summary(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("status").agg(F.count("*").alias("n"))


def is_system_error(message: Column) -> Column:
    out = F.lit(False)
    for m in ENGINE:
        out = out | F.startswith(F.coalesce(message, F.lit("")), F.lit(m))
    return out


def summarize_failures(failures: DataFrame, total: int) -> DataFrame:
    """message, n, systemic: all failures are the same, and there are five or every file failed."""
    per = failures.groupBy("message").agg(F.count("*").alias("n"))
    ends = per.agg(F.count("*").alias("messages"), F.sum("n").alias("all"))
    systemic = (F.col("messages") == 1) & ((F.col("all") >= SYSTEMIC) | (F.col("all") == total))
    return per.join(F.broadcast(ends), F.lit(True)).select("message", "n", systemic.alias("systemic"))  # ends: one row


def prune_missing(media: DataFrame, listing: DataFrame) -> DataFrame:
    """Rows whose file is there; all of them if half or more are not, as then a disk is missing rather than files."""
    there = listing.select("filename").distinct().withColumn("there", F.lit(True))
    both = media.join(there, "filename", "left")
    counts = both.agg(F.count("*").alias("_n"), F.count_if(F.col("there").isNull()).alias("_gone"))
    stop = F.col("_gone") >= F.greatest(F.lit(1), F.ceil(F.col("_n") / 2))
    return both.join(F.broadcast(counts), F.lit(True)).where(F.col("there").isNotNull() | stop).drop("there", "_n", "_gone")  # counts: one row


def content_type(files: DataFrame) -> DataFrame:
    """(path, content) -> path, mime, canonical_ext, rename: by the first bytes; rename where the name's ending says something else."""
    head = F.hex(F.substring("content", 1, 12))
    mime = F.coalesce(*(F.when(head.rlike(pattern), m) for m, pattern in MAGIC))
    ends = F.create_map(*(F.lit(x) for pair in CANONICAL.items() for x in pair))
    same = F.when(extension(F.col("path")) == ".jpeg", ".jpg").when(extension(F.col("path")) == ".tif", ".tiff").otherwise(extension(F.col("path")))
    return files.select("path", mime.alias("mime")).withColumn("canonical_ext", ends[F.col("mime")]).withColumn("rename", F.coalesce(same != F.col("canonical_ext"), F.lit(False)))


def screenshot_hints(files: DataFrame) -> DataFrame:
    """(path, content) -> path, hint: what the file's own metadata says."""
    return files.select("path", screenshot_hint(F.col("content")).alias("hint"))


def served_type(mime: Column, by_extension: Column) -> Column:
    """Known bytes win; a picture's ending without a picture's bytes is just bytes."""
    plain = F.lit("application/octet-stream")
    return F.coalesce(mime, F.when(F.startswith(by_extension, F.lit("image/")), plain).otherwise(by_extension), plain)


def backfill_hashes(media: DataFrame, files: DataFrame) -> DataFrame:
    """media(filename, hash), files(filename, content): missing hashes from the content; a file that isn't read keeps none."""
    new = files.join(media.where("hash IS NULL").select("filename"), "filename", "left_semi").select("filename", F.sha2("content", 256).alias("new"))
    return media.join(new, "filename", "left").withColumn("hash", F.coalesce("hash", "new")).drop("new")


def classify_url(url: Column) -> Column:
    """STRUCT<kind, url, id>: a video, channel, playlist or nothing known; bare handles and video ids are spelled out."""
    u = F.trim(F.coalesce(url, F.lit("")))
    part = lambda what: F.try_parse_url(u, F.lit(what))
    host = F.regexp_replace(F.lower(F.coalesce(part("HOST"), F.lit(""))), r"^(www|m|music)\.", "")
    path = F.coalesce(part("PATH"), F.lit(""))
    step = lambda i: F.nullif(F.get(F.filter(F.split(path, "/"), lambda x: x != ""), F.lit(i)), F.lit(""))
    query = lambda key: F.nullif(F.try_parse_url(u, F.lit("QUERY"), F.lit(key)), F.lit(""))
    out = lambda kind, link=u, id_=None: F.struct(F.lit(kind).alias("kind"), link.alias("url"), (F.lit(None) if id_ is None else id_).cast("string").alias("id"))
    site = host.isin("youtube.com", "youtube-nocookie.com")
    channel = path.rlike("^/(@|c/|channel/|user/)|/(videos|streams)$")
    return (
        F.when(u == "", out("unknown"))
        .when(u.rlike(r"^@[\w.-]{1,64}$"), out("channel", F.concat(F.lit("https://www.youtube.com/"), u)))
        .when(u.rlike(r"^[\w-]{11}$"), out("video", F.concat(F.lit("https://www.youtube.com/watch?v="), u), u))
        .when(host == "youtu.be", F.when(step(0).isNotNull(), out("video", u, step(0))).otherwise(out("unknown")))
        .when(~site, out("unknown"))
        .when((path == "/watch") & query("v").isNotNull(), out("video", u, query("v")))
        .when(path.rlike("^/(shorts|live)/[^/]"), out("video", u, step(1)))
        .when(channel, out("channel"))
        .when((path == "/playlist") & query("list").isNotNull(), out("playlist"))
        .when(path.isin("/", ""), out("channel"))
        .otherwise(out("unknown"))
    )


def backfill_sources(info: DataFrame, media: DataFrame, known: DataFrame) -> DataFrame:
    """info(id, channel, url, title), media(filename), known(id): films whose name has a new id in brackets; the first name of an id counts."""
    names = media.select("filename", F.explode(F.regexp_extract_all("filename", F.lit(r"\[([A-Za-z0-9_-]{11})\]"), F.lit(1))).alias("id"))
    first = names.groupBy("id").agg(F.min("filename").alias("filename"))
    return info.where("id IS NOT NULL").join(known.select("id").distinct(), "id", "left_anti").join(first, "id").select("id", "filename", "channel", "url", "title")
