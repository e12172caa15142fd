"""Jobs that follow arrivals: files in watched folders, failures of files, lists of skipped slices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.media import IMAGE, VIDEO, extension
from ..operators import imports, library
from ..sources import store
from ..sources.manifest import Log, Lost, is_in, scratch_folder, stream_source

# Failures of an unchanged file before it is skipped; slices that a list of skips names.
SKIP_AFTER, SKIP_LIST = 3, 32


def watch_folder(spark: SparkSession, folder: str, files_per_batch: int = 1000, hashed: bool = False) -> DataFrame:
    """New media files of a folder and those below it, as they arrive: path, mtime_ms, size and,
    if hashed, the hash of the content. Content is read for the hash only."""
    found = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    files = found.option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch).load(folder)
    own = [F.sha2("content", 256).alias("hash")] if hashed else []
    return files.where(extension(F.col("path")).isin([*IMAGE, *VIDEO])).select("path", F.unix_millis("modificationTime").cast("double").alias("mtime_ms"), F.col("length").alias("size"), *own)


def ingest(files: DataFrame, add, checkpoint: str, every: str = "60 seconds", once: bool = False):
    """Start a query that hands each batch of new files to add(batch, batch_id); what was handed over is remembered in the checkpoint."""
    out = files.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out.trigger(processingTime=every)).start()


OUTCOMES = "path string, status string, reason string, filename string"


def import_batch(spark: SparkSession, batch: DataFrame, folder: str, source: dict, failures: DataFrame | None = None, tries: int = 5) -> DataFrame | None:
    """A batch of found files (path, mtime_ms, size, hash) becomes rows of the library's media: planned
    against what the library has, named, written, and committed as one version that says which
    batch it is. Returns OUTCOMES, or None if the batch is in. Where another writer gets in between,
    the batch is planned anew on what that one wrote."""
    log = Log(spark, folder)
    held = scratch_folder(spark, "arrived")
    batch.withColumn("idx", F.monotonically_increasing_id()).withColumn("found", F.lit(True)).write.parquet(held)  # planned more than once, numbered once
    rows = spark.read.parquet(held)
    if failures is None:
        failures = spark.createDataFrame([], "path string, size long, mtime_ms double, count int")
    for left in range(tries - 1, -1, -1):
        after, last = log.last()
        if is_in(last, source):
            return None
        media = store.read_table(spark, folder, "media", version=after) if after else store.read_library(spark, folder)
        plan = scratch_folder(spark, "plan")
        imports.plan_import(rows, media.select("source_path", "hash"), failures, from_watch=True).write.parquet(plan)
        plan = spark.read.parquet(plan)
        added = plan.where("status = 'added'").join(rows.select("idx", "hash"), "idx")
        first = imports.keep_first(added.where("hash IS NOT NULL"), ["hash"], F.col("mtime_ms").asc_nulls_first(), F.col("idx"))  # one of equal files of a batch
        added = first.unionByName(added.where("hash IS NULL"))
        order = imports.import_order(added).select("idx", "path", "hash", "mtime_ms", "nth")
        numbered = scratch_folder(spark, "order")
        order.write.parquet(numbered)
        order = spark.read.parquet(numbered)
        named = library.assign_names(order.select(F.col("nth").alias("row_id"), F.regexp_extract("path", r"[^/]+$", 0).alias("name")), media)
        new = order.join(named, order["nth"] == named["row_id"]).select(F.col("assigned").alias("filename"), F.col("path").alias("source_path"), F.col("mtime_ms").alias("mtime"), "hash", "idx")
        try:
            if store.commit(spark, folder, append={"media": new}, source=source, after=after) is None:
                return None
        except Lost:
            if not left:
                raise
            continue
        new = new.select("idx", "filename")
        twice = (F.col("status") == "added") & F.col("filename").isNull()
        out = plan.join(new, "idx", "left")
        return out.select("path", F.when(twice, "skipped").otherwise(F.col("status")).alias("status"), F.when(twice, "known content").otherwise(F.col("reason")).alias("reason"), "filename")


def ingest_library(files: DataFrame, folder: str, checkpoint: str, failures=None, outcomes=None, every: str = "60 seconds", once: bool = False):
    """Follow watch_folder(hashed=True) into the library at `folder`, a version for each batch, each batch
    once whatever is restarted. failures() gives the table of files that failed before; outcomes(df)
    gets what became of each file."""

    def add(batch, batch_id):
        spark = batch.sparkSession
        got = import_batch(spark, batch, folder, stream_source(batch, batch_id), failures() if failures else None)
        if got is not None and outcomes:
            outcomes(got)

    return ingest(files, add, checkpoint, every, once)


class FailureCounter(StatefulProcessor):
    """Attempts on one file, held until the watermark has passed them and then counted in order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "at long, seq long, size long, mtime double, ok boolean")
        self.now = handle.getValueState("now", "size long, mtime double, count int")

    def handleInputRows(self, key, rows, timerValues):
        for r in rows:
            self.held.appendValue((r["ms"], r["seq"], r["size"], r["mtime"], r["ok"]))
            self.handle.registerTimer(r["ms"])  # one timer a time, however often it is set
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        due = expiredTimerInfo.getExpiryTimeInMs()
        held = [tuple(r) for r in self.held.get()]
        size, mtime, count = self.now.get() if self.now.exists() else (None, None, 0)
        out = []
        for at, seq, s, m, ok in sorted((h for h in held if h[0] <= due), key=lambda h: h[:2]):
            count = 0 if ok else (count if (s, m) == (size, mtime) else 0) + 1
            size, mtime = s, m
            out.append(Row(path=key[0], seq=seq, count=count, skip=count >= SKIP_AFTER))
        if out:
            self.now.update((size, mtime, count))
            left = [h for h in held if h[0] > due]
            self.held.put(left) if left else self.held.clear()
        return iter(out)

    def close(self) -> None:
        pass


def poison_stream(attempts: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """attempts(path, at, seq, size, mtime, ok), a stream -> path, seq, count, skip: the failures in
    a row of a file that hasn't changed, after each attempt. A changed file starts anew, a success clears.

    Attempts are counted in order of (at, seq) in whatever micro-batch they come: each is held
    until the stream has seen times `delay` later. One that comes later still is dropped, as
    with every watermark. State is what is held and one triple for each file; the session
    needs the RocksDB state store (`with_state_store`)."""
    rows = attempts.select("path", "seq", "size", "mtime", "ok", "at", F.unix_millis("at").alias("ms")).withWatermark("at", delay)
    return rows.groupBy("path").transformWithState(FailureCounter(), "path string, seq long, count int, skip boolean", "Append", "EventTime")


def with_state_store(spark: SparkSession) -> None:
    """Set the state store that stateful processors need, unless the session names one."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(name, ""):
        spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def poison_state(attempts: DataFrame) -> DataFrame:
    """The same for a table of attempts."""
    by = Window.partitionBy("path").orderBy(*(c for c in ("at", "seq") if c in attempts.columns))
    changed = ~(F.col("size").eqNullSafe(F.lag("size").over(by)) & F.col("mtime").eqNullSafe(F.lag("mtime").over(by)))
    runs = attempts.withColumn("_nth", F.row_number().over(by)).withColumn("_new", (F.col("ok") | changed).cast("int")).withColumn("_run", F.sum("_new").over(by))
    count = F.sum((~F.col("ok")).cast("int")).over(Window.partitionBy("path", "_run").orderBy("_nth")).cast("int")
    return runs.select("path", "seq", count.alias("count"), (count >= SKIP_AFTER).alias("skip"))


def skip_list(slices: DataFrame, cap: int = SKIP_LIST) -> DataFrame:
    """The first distinct slices of each file; no more than cap rows of a file meet in one list."""
    one = slices.select("filename", "i").distinct()
    nth = F.row_number().over(Window.partitionBy("filename").orderBy("i"))
    return one.withColumn("nth", nth).where(F.col("nth") <= cap).groupBy("filename").agg(F.sort_array(F.collect_list("i")).alias("skipped"))
