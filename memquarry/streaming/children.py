"""Child rows of files (scenes, transcript lines) that arrive in slices of replies.

A reply is one slice of a file's plan: rows (filename, from_index, i) with `i` from 0 on,
`size` rows in all, `done` on the last slice and `ok` if the worker says so. Slices can be
sent again, come in any order and in any micro-batch; the first delivery of a slice
counts, and a batch that is handed over again after a restart changes nothing.

`ChildRows` keeps a table of them: rows that can be used with the place of their vectors
(`off`, counted on from all rows before), slices with how many of their rows were usable
or skipped, skipped rows with their reason, and files that are parked since nothing of them
could be used. All of a batch counts with one entry in the table's log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.media import is_real_speech
from ..functions.texts import clean_transcript
from ..sources.manifest import Log, counted_from, is_in, scratch_folder, seen_with, stream_source

REPLIES = "filename string, from_index long, i int, size int, done boolean, ok boolean, skipped boolean, t0 double, t1 double, text string, poster long, vec array<float>, delivery long"
ROWS = "filename string, from_index long, i int, t0 double, t1 double, text string, poster long, vec array<float>, off long, n int"
SLICES = "filename string, from_index long, size int, done boolean, ok boolean, good long, skipped long"
KEY = ["filename", "from_index"]
#: Files of a batch up to which they are a filter on the slices that are in.
MANY_FILES = 2000


def finite(c: str) -> Column:
    x = F.col(c)
    return F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), F.lit(False))


def skip_reason(speech: bool) -> Column:
    """Why a reply's row can't be used, or null; scenes need only a vector, speech its times and real words as well."""
    reason = F.when(F.coalesce("skipped", F.lit(False)), F.lit("skipped"))
    if speech:
        reason = reason.when(~(finite("t0") & finite("t1")) | (F.col("t1") <= F.col("t0")), F.lit("times"))
    reason = reason.when(F.col("vec").isNull() | (F.size("vec") == 0), F.lit("no vector"))
    return reason.when(~is_real_speech(F.col("text")), F.lit("no speech")) if speech else reason


def split_reply(replies: DataFrame, speech: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows that can be used, text cleaned; the others, with the reason)."""
    both = replies.withColumn("reason", skip_reason(speech))
    good = both.where("reason IS NULL").drop("reason")
    return (good.withColumn("text", clean_transcript(F.col("text"))) if speech else good), both.where("reason IS NOT NULL")


def first_deliveries(replies: DataFrame) -> DataFrame:
    """One delivery of each slice: the least of those that are here."""
    first = F.min("delivery").over(Window.partitionBy(*KEY))  # a slice is one reply, sent a few times
    rows = replies.withColumn("_first", first).where(F.col("delivery").eqNullSafe(F.col("_first"))).drop("_first")
    return rows.dropDuplicates([*KEY, "i"])


def slices_of(replies: DataFrame, speech: bool = True) -> DataFrame:
    """SLICES: a row for each slice; an empty one is told by a row without `i`."""
    good, real = skip_reason(speech).isNull(), F.col("i").isNotNull()
    counts = [F.count_if(real & good).alias("good"), F.count_if(real & ~good).alias("skipped")]
    facts = [F.max(F.coalesce("size", F.lit(0))).alias("size"), F.bool_or(F.coalesce("done", F.lit(False))).alias("done"), F.bool_and(F.coalesce("ok", F.lit(False))).alias("ok")]
    return replies.groupBy(*KEY).agg(*facts, *counts).select(*[c.split()[0] for c in SLICES.split(", ")])


def unusable(slices: DataFrame, covered: DataFrame | None = None) -> DataFrame:
    """Files of which every slice up to the last has come, whose last reply was ok, of which no row
    could be used and some were skipped, and that nothing else covers -> filename, skipped."""
    last = F.when(F.col("done"), F.col("from_index") + F.col("size"))
    per = slices.groupBy("filename").agg(F.sum("size").alias("here"), F.max(last).alias("planned"), F.max_by("ok", last).alias("ok"), F.sum("good").alias("good"), F.sum("skipped").alias("skipped"))
    out = per.where("planned IS NOT NULL AND here >= planned AND ok AND good = 0 AND skipped > 0").select("filename", "skipped")
    return out.join(covered.select("filename").distinct(), "filename", "left_anti") if covered is not None else out


def numbered(good: DataFrame, starts: DataFrame) -> DataFrame:
    """ROWS: `off` is a slice's start plus the row's place among the usable rows of its slice."""
    place = F.row_number().over(Window.partitionBy(*KEY).orderBy("i")) - 1
    rows = good.withColumn("_place", place).join(starts.select(*KEY, "start"), KEY)
    return rows.withColumn("off", F.col("start") + F.col("_place")).withColumn("n", F.lit(1)).select(*[c.split()[0] for c in ROWS.split(", ")])


def child_rows(replies: DataFrame, path: str, speech: bool = True) -> DataFrame:
    """The same for a table of replies at once, in order of file and slice, from offset 0; `path` is a new folder for the slices."""
    replies = first_deliveries(replies)
    good, _ = split_reply(replies.where("i IS NOT NULL"), speech)
    return numbered(good, counted_from(slices_of(replies, speech), "good", KEY, path, 0)[0])


class ChildRows:
    """The table at a path: rows, slices, skipped rows and parked files, in folders that the log names."""

    KINDS = {"rows": ROWS, "slices": SLICES, "skipped": f"{REPLIES}, reason string", "parked": "filename string, skipped long"}

    def __init__(self, spark: SparkSession, path: str, speech: bool = True):
        self.spark, self.log, self.speech = spark, Log(spark, path), speech

    def read(self, kind: str, entry: dict | None = None) -> DataFrame:
        paths = ((self.log.last()[1] if entry is None else entry) or {}).get(kind)
        return self.spark.read.schema(self.KINDS[kind]).parquet(*paths) if paths else self.spark.createDataFrame([], self.KINDS[kind])

    def rows(self) -> DataFrame:
        return self.read("rows")

    def slices(self) -> DataFrame:
        return self.read("slices")

    def skipped(self) -> DataFrame:
        return self.read("skipped")

    def parked(self) -> DataFrame:
        return self.read("parked")

    def add(self, replies: DataFrame, source: dict, covered: DataFrame | None = None) -> bool:
        """Take a batch of replies; False if this batch is in. Another writer's commit raises `Lost`
        before anything of this one counts."""
        number, last = self.log.last()
        if is_in(last, source):
            return False
        last = last or {"total": 0, **{kind: [] for kind in self.KINDS}}
        known, new = self.read("slices", last), {kind: self.log.new_folder(kind) for kind in self.KINDS}
        came = self._held(replies.select(*[c.split()[0] for c in REPLIES.split(", ")]))  # read several times, once from the stream
        files = [r.filename for r in came.select("filename").distinct().limit(MANY_FILES + 1).collect()]
        if len(files) <= MANY_FILES:  # a filter that reaches the scan of all slices there are
            known = known.where(F.col("filename").isin(files))
        fresh = self._held(first_deliveries(came.join(known.select(*KEY), KEY, "left_anti").select(*came.columns)))
        starts, good = counted_from(slices_of(fresh, self.speech), "good", KEY, new["slices"], last["total"])
        usable, skipped = split_reply(fresh.where("i IS NOT NULL"), self.speech)
        numbered(usable, starts).write.parquet(new["rows"])
        skipped.write.parquet(new["skipped"])
        # files that this batch touches, with their slices of all batches
        now = self.spark.read.schema(SLICES).parquet(new["slices"])
        whole = known.join(now.select("filename").distinct(), "filename", "left_semi").select(*now.columns).union(now)
        unusable(whole, covered).write.parquet(new["parked"])
        self.log.append(number + 1, {"seen": seen_with(last, source), "total": last["total"] + good, **{kind: last[kind] + [new[kind]] for kind in self.KINDS}})
        return True

    def _held(self, replies: DataFrame) -> DataFrame:
        path = scratch_folder(self.spark, "replies")
        replies.write.parquet(path)
        return self.spark.read.schema(REPLIES).parquet(path)

    def compact(self) -> None:
        """One folder of each kind instead of one for each batch. Older ones go with `forget`."""
        number, last = self.log.last()
        if last:
            new = {kind: self.log.new_folder(kind) for kind in self.KINDS}
            for kind, path in new.items():
                self.read(kind, last).repartitionByRange("filename").sortWithinPartitions("filename").write.parquet(path)
            self.log.append(number + 1, {**last, **{kind: [path] for kind, path in new.items()}})

    def forget(self, keep: int = 1) -> list[str]:
        return self.log.forget(keep, lambda entry: {path for kind in self.KINDS for path in entry[kind]})

    def follow(self, replies: DataFrame, checkpoint: str, covered: DataFrame | None = None, every: str = "10 seconds", once: bool = False):
        """Start a query that adds each micro-batch of a stream of replies."""
        out = replies.writeStream.foreachBatch(lambda batch, n: self.add(batch, stream_source(batch, n), covered)).option("checkpointLocation", checkpoint)
        return (out.trigger(availableNow=True) if once else out.trigger(processingTime=every)).start()
