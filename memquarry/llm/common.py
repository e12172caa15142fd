"""What the training-data operators share: tables, scratch space, byte views of
text columns and connected components."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only after it has been counted and has at most
#: so many narrow rows; beyond it the same join shuffles.
BROADCAST_ROWS = 500_000


#: Rows of an Arrow batch, unless the session sets another number than Spark's own.
BATCH_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Texts are long rows: Spark's 10,000 of them a batch take hundreds of MB on either side."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str):
    """A column by its name, whatever characters that has."""
    return F.col("`" + name.replace("`", "``") + "`")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where that is
    unset (tests on one machine) a folder of its own is made and set."""
    own = spark.conf.get("spark.checkpoint.dir", None)
    if not own:
        own = "file://" + tempfile.mkdtemp(prefix="memquarry-")
        spark.conf.set("spark.checkpoint.dir", own)
        spark.sparkContext.setCheckpointDir(own)
    return own


@contextlib.contextmanager
def tidy(spark: SparkSession):
    """Shuffle files of the queries inside go when each query ends."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: Folders of written() and bucketed() that are still there.
SCRATCH: list = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one; it goes with the session, if not before."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    SCRATCH.append(path)
    return path


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read again."""
    path = scratch_path(spark, name)
    with tidy(spark):
        df.write.option("compression", "snappy").parquet(path)  # zstd holds much memory outside the heap
    return spark.read.schema(df.schema).parquet(path)


def bucketed(spark: SparkSession, df: DataFrame, n: int, keys: list, name: str) -> DataFrame:
    """df in the shared folder, dealt into n buckets by keys. The catalogue forgets the
    table again: the plan that is returned knows its files and buckets."""
    path, called = scratch_path(spark, name), f"memquarry_{uuid.uuid4().hex}"
    with tidy(spark):
        df.repartition(n, *keys).write.bucketBy(n, *keys).option("compression", "snappy").option("path", path).saveAsTable(called, format="parquet")
    out = spark.table(called)
    out.schema  # resolved while the table is known
    spark.sql(f"DROP TABLE {called}")  # its path is its own, so the files stay
    return out


def removed(spark: SparkSession, paths) -> None:
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        SCRATCH[:] = [p for p in SCRATCH if p != path]


def dropped(spark: SparkSession, df: DataFrame) -> None:
    """Delete a table of written() that no later job reads."""
    removed(spark, [p for p in SCRATCH if any(f.startswith(p.rstrip("/") + "/") or p.rpartition("/")[2] in f for f in df.inputFiles())])


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast df if a count shows that it is small; else leave the join to shuffle."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def crc_mod(col: str, n: int):
    return F.crc32(F.col(col).cast("string").cast("binary")) % n


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty. No copy unless needed."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind, buffers = (np.int64 if wide else np.int32), column.buffers()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(buffers[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def relieved() -> None:
    """Give freed memory back: Python workers outlive their tasks, and what a stage keeps the next one lacks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL("libc.so.6").malloc_trim(0)


#: What operators remember from task to task: name -> how to forget it.
CACHES: dict = {}


def slices(batches, size: int = 1 << 20, rows: int = 2000, text: str = "text", owner: str = ""):
    """Record batches cut into pieces of about size bytes of text and so many rows at most; a longer text stays whole.
    What operators other than `owner` remember in this worker is forgotten: their stage is over."""
    for name, forget in CACHES.items():
        if name != owner:
            forget()
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        _, offsets = byte_view(batch.column(batch.schema.get_field_index(text)))
        start = 0
        while start < n:
            end = int(np.searchsorted(offsets, offsets[start] + size, "left"))
            end = min(n, start + rows, max(end, start + 1))
            yield batch.slice(start, end - start)
            start = end
    relieved()


M1, M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
S33 = np.uint64(33)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser of MurmurHash3 (public domain constants)."""
    x = x ^ (x >> S33)
    x = x * M1
    x ^= x >> S33
    x *= M2
    x ^= x >> S33
    return x


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) for every node that isn't itself the least."""
    if not len(u):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    nodes, inverse = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = inverse[: len(u)], inverse[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]


def forest_batches(batches):
    """mapInArrow: the edges (u, v) of a partition, reduced to stars."""
    rows = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in map(pa.Table.from_batches, ([x] for x in batches))]
    if rows:
        u, v = forest(np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]))
        yield pa.record_batch({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def _stars(edges: DataFrame) -> DataFrame:
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges = edges.mapInArrow(forest_batches, "u long, v long").distinct().checkpoint()
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(least, "u")
        edges = star.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct().checkpoint()
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count_distinct("u")).first())
        if now == before or (now[0] == now[2] and not edges.join(edges.select(F.col("u").alias("v")).distinct(), "v", "left_semi").limit(1).count()):
            break
        before = now
    return edges


def connected_components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(id, component) for every node of edges(u, v); component is the least id.

    Alternating large-star and small-star rounds on DataFrames (Kiveris et al.,
    "Connected Components in MapReduce and Beyond"). The minimum of a node is a
    map-side combined aggregate joined back, so that a hub is never one task's
    group. Each round is cut by a checkpoint in the shared folder; links never
    reach the driver.
    """
    shared_dir(spark)
    with tidy(spark):
        edges = _stars(edges)
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
