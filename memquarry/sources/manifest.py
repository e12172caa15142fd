"""A log of numbered entries beside the data that they name.

What counts of a table is what its log's entries say: writers put data into folders that
no entry names yet, then claim the next number with one entry. Of two writers that
prepared the same number one gets it and the other is told (`Lost`), and a folder whose
writer died before its entry is never read. Entries carry the last batch of each stream
that is in (`seen`), so that a batch that is handed over again is known.

A number is claimed by giving a finished file its final name without replacing one that
is there: a hard link on local and mounted folders, a rename that doesn't overwrite on
Hadoop's file systems. An entry names all folders that count from then on, so that the last
one is enough to read a table; `forget` drops older ones with the folders that only they name.
"""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Lost(RuntimeError):
    """Another writer has the number."""


def file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def names(spark: SparkSession, path: str) -> list[str]:
    fs, at = file_system(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, at = file_system(spark, path)
    fs.delete(at, True)


def read_text(spark: SparkSession, path: str) -> str:
    fs, at = file_system(spark, path)
    stream = fs.open(at)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, at = file_system(spark, path)
    stream = fs.create(at, True)
    stream.write(bytearray(text.encode()))
    stream.close()


def scratch_folder(spark: SparkSession, kind: str) -> str:
    """A new folder in the one that spark.checkpoint.dir names (where that is unset, as on one
    machine, in a temporary one); it goes with the session."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="memquarry-")
    path = f"{shared}/{kind}-{uuid.uuid4().hex}"
    fs, at = file_system(spark, path)
    fs.deleteOnExit(at)
    return path


def claim(spark: SparkSession, made: str, name: str) -> bool:
    """Give the file `made` its final name if that is free; False if it is taken."""
    fs, _ = file_system(spark, made)
    if fs.getScheme() == "file":
        try:
            os.link(unquote(urlparse(made).path), unquote(urlparse(name).path))
        except FileExistsError:
            return False
        finally:
            remove(spark, made)
        return True
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = gateway.new_array(kind, 1)
    options[0] = kind.NONE  # fails where the name is there
    _, old = file_system(spark, made)
    _, new = file_system(spark, name)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(old.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(old, new, options)
    except Exception as error:
        if "FileAlreadyExistsException" not in str(error):
            raise
        remove(spark, made)
        return False
    return True


class Log:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.folder = f"{self.root}/_log"

    def numbers(self) -> list[int]:
        return [int(n[:-5]) for n in names(self.spark, self.folder) if n.endswith(".json") and n[:-5].isdigit()]

    def entry(self, number: int) -> dict:
        return json.loads(read_text(self.spark, f"{self.folder}/{number:010d}.json"))

    def last(self) -> tuple[int, dict | None]:
        found = self.numbers()
        return (found[-1], self.entry(found[-1])) if found else (0, None)

    def append(self, number: int, entry: dict) -> None:
        """Claim the number; it is the one after the last that the writer has seen."""
        made = f"{self.folder}/.{uuid.uuid4().hex}"
        write_text(self.spark, made, json.dumps(entry))
        if not claim(self.spark, made, f"{self.folder}/{number:010d}.json"):
            raise Lost(f"number {number} of {self.root} is taken: read it again and prepare anew")

    def forget(self, keep: int, folders, pinned: set[str] = frozenset()) -> list[str]:
        """Drop all but the last `keep` entries and the folders (`folders(entry)`) that no other entry and
        no pin names; those that went. For times without readers of older entries."""
        every = self.numbers()
        old, rest = every[: -max(1, keep)], every[-max(1, keep) :]
        gone = set().union(*(folders(self.entry(n)) for n in old)) - set().union(*(folders(self.entry(n)) for n in rest)) - pinned
        for n in old:
            remove(self.spark, f"{self.folder}/{n:010d}.json")
        for path in gone:
            remove(self.spark, path)
        return sorted(gone)

    def new_folder(self, kind: str) -> str:
        return f"{self.root}/{kind}/{uuid.uuid4().hex}"


def stream_source(batch: DataFrame, batch_id: int) -> dict:
    """Which batch of which stream this is; the stream's id is in its checkpoint and outlives restarts."""
    query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
    return {"query": query, "batch": int(batch_id)}


def is_in(entry: dict | None, source: dict | None) -> bool:
    """Does an entry hold this batch of a stream? Batches of a stream come in order of their numbers."""
    return bool(entry and source) and entry.get("seen", {}).get(source["query"], -1) >= source["batch"]


def seen_with(entry: dict | None, source: dict | None) -> dict:
    return {**(entry or {}).get("seen", {}), **({source["query"]: source["batch"]} if source else {})}


def counted_from(df: DataFrame, size: str, order: list, path: str, first: int) -> tuple[DataFrame, int]:
    """df written to path in order, with `start`: first plus the sizes of all rows before; and the sum
    of all. Rows are dealt by range and each range counts from where the one before ends, so that
    no task has them all."""
    spark = df.sparkSession
    df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path).withColumn("_part", F.shiftright("_id", 33))
    at, starts = first, []
    for r in rows.groupBy("_part").agg(F.sum(size).alias("n")).orderBy("_part").collect():  # a row for each range
        starts.append((r["_part"], at))
        at += r["n"]
    starts = spark.createDataFrame(starts, "_part long, _start long")
    before = F.sum(size).over(Window.partitionBy("_part").orderBy("_id").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.join(F.broadcast(starts), "_part").withColumn("start", F.col("_start") + F.coalesce(before, F.lit(0)))
    return rows.drop("_id", "_part", "_start"), at - first
