"""A library on disk: tables of Parquet, versions that name their folders, and named snapshots.

A version is an entry in the library's log (`manifest.Log`): for each table the folders that
make it up, one for each model where a table has models. Folders are written once and never
changed; a new version names those of the tables it leaves alone, so that it costs what it
writes. A writer claims the number after the version it started from; who loses that race is
told (`Lost`) and nothing of theirs counts. A snapshot names the folders of a version too, and
pins them; a folder goes when no version that is kept and no pin names it any longer.
Paths go through Hadoop's file systems: any store that Spark reads will do."""

from __future__ import annotations

import datetime
import json
import zlib
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.texts import slugify
from ..functions.vectors import norm
from ..operators.library import match_cached
from .manifest import Log, claim, is_in, names, read_text, remove, seen_with, write_text

# Snapshots at most, characters of a name, categories that may be set by hand.
MOST, NAME, CATEGORIES = 10, 60, ["Screenshots", "Projects"]
MEDIA = "filename string, source_path string, mtime double, hash string, ocr string, hint boolean, model_id string, embedding array<float>, phrase array<float>, embedding_norm double, phrase_norm double"
SEGMENTS = "model_id string, filename string, t double, dur double, poster bigint, embedding array<float>, embedding_norm double"
TRANSCRIPTS = "model_id string, filename string, t0 double, t1 double, text string, embedding array<float>, embedding_norm double"
OVERRIDES = "hash string, category string"
TABLES = {"media": MEDIA, "segments": SEGMENTS, "transcripts": TRANSCRIPTS, "overrides": OVERRIDES}
MODELLED = {"media", "segments", "transcripts"}


def conformed(df: DataFrame, schema: str) -> DataFrame:
    """The schema's columns in its types, with the norms of the vectors; missing ones are null, others go."""
    wanted = df.sparkSession.createDataFrame([], schema).schema
    out = df.select(*((F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted))
    return out.withColumns({f.name: norm(F.col(f.name.removesuffix("_norm"))) for f in wanted if f.name.endswith("_norm")})


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The versions that are kept, the newest last."""
    return Log(spark, folder).numbers()


def _parts(spark: SparkSession, log: Log, name: str, df: DataFrame) -> list[dict]:
    """Write a table; the folders that make it up."""
    base, df = log.new_folder(name), conformed(df, TABLES[name])
    if name not in MODELLED:
        df.write.parquet(base)
        return [{"base": base, "path": base, "model": None}]
    df.write.partitionBy("model_id").parquet(base)
    value = lambda folder: unquote(folder.partition("=")[2])
    return [{"base": base, "path": f"{base}/{f}", "model": None if value(f) == "__HIVE_DEFAULT_PARTITION__" else value(f)} for f in names(spark, base) if f.startswith("model_id=")]


def commit(spark: SparkSession, folder: str, replace: dict[str, DataFrame] | None = None, append: dict[str, DataFrame] | None = None, models: list[str] | None = None, source: dict | None = None, after: int | None = None) -> int | None:
    """A new version of the library, and its number. Tables of `replace` are replaced (with
    `models`: only those models' rows), rows of `append` added, all others stay as they are.

    `after` is the version that the writer read; without it the newest is. None if a
    version with this `source` (a batch of a stream) is there. Raises `Lost` if another writer has
    the number."""
    log = Log(spark, folder)
    newest, last = log.last()
    if is_in(last, source):
        return None
    number = newest if after is None else after
    tables = dict(log.entry(number)["tables"]) if number else {name: [] for name in TABLES}
    for name, df in (replace or {}).items():
        kept = [p for p in tables[name] if p["model"] not in models] if models is not None and name in MODELLED else []
        if models is not None and name in MODELLED:
            df = df.where(F.col("model_id").isin(models))
        tables[name] = kept + _parts(spark, log, name, df)
    for name, df in (append or {}).items():
        tables[name] = tables[name] + _parts(spark, log, name, df)
    log.append(number + 1, {"tables": tables, "seen": seen_with(last, source), "at": datetime.datetime.now(datetime.UTC).isoformat()})
    return number + 1


def write_library(spark: SparkSession, folder: str, tables: dict[str, DataFrame]) -> int | None:
    """A new version with these tables; those that are not given are taken over as they are."""
    return commit(spark, folder, replace=tables)


def _read(spark: SparkSession, name: str, parts: list[dict]) -> DataFrame:
    bases: dict = {}
    for p in parts:
        bases.setdefault(p["base"], []).append(p["path"])
    out, columns = None, [c.split()[0] for c in TABLES[name].split(", ")]
    for base, paths in bases.items():
        one = spark.read.schema(TABLES[name]).option("basePath", base).parquet(*paths).select(*columns)
        out = one if out is None else out.union(one)
    return spark.createDataFrame([], TABLES[name]) if out is None else out


def read_table(spark: SparkSession, folder: str, name: str, model_id: str | None = None, version: int | None = None) -> DataFrame:
    """A table of a version, the newest unless one is named. With a model only that model's folders are listed and read."""
    log = Log(spark, folder)
    entry = log.entry(version) if version else log.last()[1]
    parts = entry["tables"][name] if entry else []
    if model_id is None or name not in MODELLED:
        return _read(spark, name, parts)
    return _read(spark, name, [p for p in parts if p["model"] == model_id]).where(F.col("model_id") == model_id)


def read_library(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "media")


def valid_segments(rows: DataFrame) -> DataFrame:
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf"))
    return rows.where(F.col("filename").isNotNull() & finite("t") & (F.col("t") >= 0) & finite("dur") & (F.col("dur") > 0))


def valid_transcripts(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("filename").isNotNull() & (F.col("t0") >= 0) & (F.col("t1") > F.col("t0")) & (F.trim("text") != ""))


def read_segments(spark: SparkSession, folder: str, model_id: str) -> DataFrame:
    return valid_segments(read_table(spark, folder, "segments", model_id))


def read_transcripts(spark: SparkSession, folder: str, model_id: str) -> DataFrame:
    return valid_transcripts(read_table(spark, folder, "transcripts", model_id))


def export_index(media: DataFrame, overrides: DataFrame) -> DataFrame:
    """The library's rows without vectors, with the category that was set by hand."""
    rest = [c for c in media.columns if c not in ("embedding", "phrase", "category")]
    return media.select(*rest).join(overrides.where(F.col("category").isin(CATEGORIES)), "hash", "left").select(*rest, F.col("category").alias("override"))


def set_overrides(overrides: DataFrame, decisions: DataFrame, media: DataFrame) -> DataFrame:
    """decisions(filename, category; null: take back) on known files with a content hash; the last by `at` of a hash counts."""
    allowed = decisions.where(F.col("category").isNull() | F.col("category").isin(CATEGORIES))
    new = allowed.join(media.where("hash IS NOT NULL").select("filename", "hash").distinct(), "filename").groupBy("hash").agg(F.max_by(F.struct("category"), "at").alias("d"))
    both = overrides.join(new, "hash", "full")
    return both.select("hash", F.when(F.col("d").isNotNull(), F.col("d.category")).otherwise(F.col("category")).alias("category")).where("category IS NOT NULL")


def delete_files(tables: dict[str, DataFrame], filenames: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of the files, of whatever model."""
    gone = filenames.select("filename").distinct()
    return {name: df.join(gone, "filename", "left_anti").select(*df.columns) if "filename" in df.columns else df for name, df in tables.items()}


def plan_reembed(media: DataFrame, cached: DataFrame, meta: dict | None, code_version: int, dim: int) -> DataFrame:
    """media(row_id, filename), cached(at, filename, embedding, phrase), meta(code_version,
    dim, count) -> filename, reuse, reason. The whole plan fails without meta, or with
    another code version, length or number of rows; a null or zero vector is done again."""
    whole = "no meta" if meta is None else "code version" if meta["code_version"] != code_version else "dim" if meta["dim"] != dim else "count" if meta["count"] != cached.count() else None
    if whole:
        return media.select("filename", F.lit(False).alias("reuse"), F.lit(whole).alias("reason"))
    return match_cached(media, cached, ["embedding", "phrase"]).select("filename", (F.col("reason") == "reused").alias("reuse"), "reason")


# --- snapshots -----------------------------------------------------------------------


def row_hash(media: DataFrame) -> DataFrame:
    """One row (n, hash): the number of names and a hash of them all that doesn't depend on their order, so that no task collects them."""
    part = F.conv(F.substring(F.sha2("filename", 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return media.agg(F.count("*").alias("n"), F.sha2(F.concat_ws(",", F.coalesce(F.sum(part), F.lit(0)).cast("string"), F.count("filename").cast("string")), 256).alias("hash"))


SNAPSHOT = "slug string, name string, created_at timestamp, n long, hash string, path string"


def _snapshots(spark: SparkSession, store: str) -> dict[str, dict]:
    """slug -> what its file says; MOST at most."""
    return {n[:-5]: json.loads(read_text(spark, f"{store}/{n}")) for n in names(spark, store) if n.endswith(".json") and not n.startswith(".")}


def list_snapshots(spark: SparkSession, store: str) -> DataFrame:
    """The newest first; MOST rows at most."""
    rows = [(s, x["name"], datetime.datetime.fromisoformat(x["created_at"]), x["n"], x["hash"], f"{store}/{s}.json") for s, x in _snapshots(spark, store).items()]
    return spark.createDataFrame(rows, SNAPSHOT).orderBy(F.col("created_at").desc(), "slug")


def _pin(folder: str, store: str, slug: str) -> str:
    return f"{folder}/_pins/{slug}-{zlib.crc32(store.encode()):08x}.json"


def _bases(tables: dict) -> set[str]:
    return {p["base"] for parts in tables.values() for p in parts}


def create_snapshot(spark: SparkSession, folder: str, store: str, name: str) -> str:
    """Name the newest version. Nothing is copied: the folders it names stay as long as the snapshot does."""
    name = (name or "").strip()
    slug = spark.range(1).select(slugify(F.lit(name))).first()[0]
    if not name or not slug or len(name) > NAME:
        raise ValueError(f"a name needs letters or numbers and has at most {NAME} characters")
    held = _snapshots(spark, store)
    if len(held) >= MOST and slug not in held:
        raise ValueError(f"there are {MOST} snapshots; delete one first")
    number, entry = Log(spark, folder).last()
    tables = entry["tables"] if entry else {t: [] for t in TABLES}
    row = row_hash(_read(spark, "media", tables["media"])).first()
    said = {"name": name, "created_at": datetime.datetime.now(datetime.UTC).isoformat(), "n": row.n, "hash": row.hash, "folder": folder, "version": number, "tables": tables}
    made = f"{store}/.{slug}-{zlib.crc32(str(said).encode()):08x}"
    write_text(spark, made, json.dumps(said))
    taken = slug in held
    if not taken:  # the pin first: what a snapshot names is never unpinned
        write_text(spark, _pin(folder, store, slug), json.dumps({"bases": sorted(_bases(tables))}))
    if taken or not claim(spark, made, f"{store}/{slug}.json"):
        if taken:
            remove(spark, made)
        raise ValueError(f"a snapshot named {name!r} is there already")
    return slug


def _snapshot(spark: SparkSession, store: str, slug: str) -> dict:
    found = _snapshots(spark, store)
    if slug not in found:
        raise ValueError("no such snapshot")
    return found[slug]


def rename_snapshot(spark: SparkSession, store: str, slug: str, name: str) -> None:
    """The file stays; a name that another snapshot has is refused."""
    said, name = _snapshot(spark, store, slug), name.strip()
    if not name or any(x["name"] == name and s != slug for s, x in _snapshots(spark, store).items()):
        raise ValueError("no such snapshot, or the name is taken")
    write_text(spark, f"{store}/{slug}.json", json.dumps(said | {"name": name}))


def _pinned(spark: SparkSession, folder: str) -> set[str]:
    return {base for n in names(spark, f"{folder}/_pins") for base in json.loads(read_text(spark, f"{folder}/_pins/{n}"))["bases"]}


def _release(spark: SparkSession, folder: str, gone: set[str]) -> list[str]:
    """Remove those of the folders that no version and no pin names; the ones that went."""
    log = Log(spark, folder)
    used = _pinned(spark, folder).union(*(_bases(log.entry(n)["tables"]) for n in log.numbers()))
    for base in sorted(gone - used):
        remove(spark, base)
    return sorted(gone - used)


def delete_snapshot(spark: SparkSession, store: str, slug: str) -> list[str]:
    """The folders that went with it, as nothing else names them."""
    said = _snapshot(spark, store, slug)
    remove(spark, f"{store}/{slug}.json")
    remove(spark, _pin(said["folder"], store, slug))
    return _release(spark, said["folder"], _bases(said["tables"]))


def forget_versions(spark: SparkSession, folder: str, keep: int = 1) -> list[str]:
    """Forget all but the newest `keep` versions, with the folders that only they name. Call
    it when no reader of an older version is at work."""
    return Log(spark, folder).forget(keep, lambda entry: _bases(entry["tables"]), _pinned(spark, folder))


def restore_snapshot(spark: SparkSession, folder: str, store: str, slug: str, listing: DataFrame) -> DataFrame:
    """The snapshot's folders become the library's newest version; returns the names whose file is missing."""
    tables, log = _snapshot(spark, store, slug)["tables"], Log(spark, folder)
    number, last = log.last()
    log.append(number + 1, {"tables": tables, "seen": seen_with(last, None), "at": datetime.datetime.now(datetime.UTC).isoformat()})
    return read_library(spark, folder).select("filename").join(listing.select("filename").distinct(), "filename", "left_anti")
