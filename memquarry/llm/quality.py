"""Quality classification: random-indexing word vectors and a small network.

Every token has a bucket, every bucket a fixed sparse ternary index vector. A
bucket's context vector is the sum of the index vectors of its neighbours (two on
either side) over the whole corpus; partitions accumulate and Spark adds up the
blocks. A document is pooled as the mean and the spread of its tokens' normed
vectors and the logarithm of its length. A two-layer numpy network, trained on a
bounded sample of labelled rows, gives a logit, divided by a temperature that is
fitted on a fifth of the sample.

Learning reads at most SAMPLE labelled rows (least hash of doc_id first); counts
and scores read every whole text.

Cases: null text is empty; an empty text is scored like any other (its pooled
vector is 0); a document with several labels counts its least one, one with several
rows is learned from once, by its least text; without labels
of both kinds the score is the share of label 1, or 0.5; an empty table gives an
empty result; extra columns are not read.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, slices, table
from .packing import Remembered

BUCKETS, DIMS, NONZERO, NEAR = 1 << 14, 32, 4, 2
SAMPLE, HIDDEN, EPOCHS, THRESHOLD = 20_000, 32, 60, 0.3
GROUPS, FAN_IN = 64, 64
TOKEN = re.compile(r"\w+|[^\w\s]+")

_bucket = Remembered(lambda token: zlib.crc32(token.encode("utf-8", "surrogatepass")) % BUCKETS, 200_000)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(17)
    return rng.permuted(np.tile(np.arange(DIMS), (BUCKETS, 1)), axis=1)[:, :NONZERO], rng.choice([-1.0, 1.0], (BUCKETS, NONZERO))


def buckets(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every token, number of tokens of every text)."""
    found = [TOKEN.findall(t) if t else [] for t in texts]
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    return np.fromiter((b for f in found for b in map(_bucket.__getitem__, f)), np.int64, int(sizes.sum())), sizes


def context_vectors(docs: DataFrame) -> np.ndarray:
    """BUCKETS by DIMS sums over all documents; what reaches the driver has that fixed size."""

    def count(batches):
        place, sign = index_vectors()
        total = np.zeros(BUCKETS * DIMS)
        for batch in slices(batches, 1 << 20):
            b, sizes = buckets(batch.column("text").to_pylist())
            doc = np.repeat(np.arange(len(sizes)), sizes)
            for o in range(1, NEAR + 1):
                same = doc[:-o] == doc[o:]
                x, y = b[:-o][same], b[o:][same]
                for at, near in ((x, y), (y, x)):
                    for j in range(NONZERO):
                        total += np.bincount(at * DIMS + place[near, j], sign[near, j], BUCKETS * DIMS)
        if total.any():
            from pyspark import TaskContext

            part = TaskContext.get().partitionId()
            yield pa.record_batch({"g": pa.array(range(GROUPS), pa.int32()), "salt": pa.array([part // FAN_IN] * GROUPS, pa.int32()), "sums": pa.array([x.tobytes() for x in total.reshape(GROUPS, -1)], pa.binary())})

    def add(batches):
        sums: dict = {}
        for batch in batches:
            for g, salt, x in zip(*(batch.column(c).to_pylist() for c in ("g", "salt", "sums"))):
                sums[g, salt] = sums.get((g, salt), 0) + np.frombuffer(x)
        if sums:
            yield pa.record_batch({"g": pa.array([k[0] for k in sums], pa.int32()), "salt": pa.array([k[1] // FAN_IN for k in sums], pa.int32()), "sums": pa.array([x.tobytes() for x in sums.values()], pa.binary())})

    kind = "g int, salt int, sums binary"
    parts = docs.select(F.col("text").cast("string")).mapInArrow(count, kind)
    parts = parts.repartition("g", "salt").mapInArrow(add, kind).repartition("g").mapInArrow(add, kind)
    total = np.zeros((GROUPS, BUCKETS * DIMS // GROUPS))
    for r in parts.collect():
        total[r.g] += np.frombuffer(r.sums)
    v = total.reshape(BUCKETS, DIMS)
    v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    v -= v[np.linalg.norm(v, axis=1) > 0].mean(0) if v.any() else 0
    return (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(texts: list, vectors: np.ndarray) -> np.ndarray:
    b, sizes = buckets(texts)
    out = np.zeros((len(sizes), 2 * DIMS + 1))
    some = np.flatnonzero(sizes)
    if len(some):
        start, e = (np.cumsum(sizes) - sizes)[some], vectors[b]
        mean = np.add.reduceat(e, start) / sizes[some, None]
        out[some, :DIMS] = mean
        e *= e
        out[some, DIMS : 2 * DIMS] = np.sqrt(np.maximum(np.add.reduceat(e, start) / sizes[some, None] - mean**2, 0))
    out[:, -1] = np.log1p(sizes) / 10
    return out


def network(x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, epochs: int = EPOCHS) -> dict:
    """Two layers by Adam on four fifths; the temperature by a search on the rest."""
    rng = np.random.default_rng(5)
    if len(set(y.tolist())) < 2:
        p = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
        return {"constant": p}
    mean, scale = x.mean(0), x.std(0) + 1e-6
    x = (x - mean) / scale
    held = np.arange(len(x)) % 5 == 0
    xt, yt = x[~held], y[~held]
    w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    m, s, t = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(len(xt)), max(1, len(xt) // 256)):
            h = np.tanh(xt[at] @ w[0] + w[1])
            d = (1 / (1 + np.exp(-(h @ w[2] + w[3]))) - yt[at]) / len(at)
            back = np.outer(d, w[2]) * (1 - h * h)
            t += 1
            for i, g in enumerate((xt[at].T @ back + 1e-4 * w[0], back.sum(0), h.T @ d, d.sum(keepdims=True))):
                m[i] = 0.9 * m[i] + 0.1 * g
                s[i] = 0.999 * s[i] + 0.001 * g * g
                w[i] = w[i] - 0.005 * (m[i] / (1 - 0.9**t)) / (np.sqrt(s[i] / (1 - 0.999**t)) + 1e-8)
    z = np.tanh(x[held] @ w[0] + w[1]) @ w[2] + w[3]
    loss = lambda k: np.logaddexp(0, np.where(y[held] > 0, -z, z) / k).mean()
    return {"w": w, "mean": mean, "scale": scale, "temperature": min(np.geomspace(0.25, 8, 61), key=loss)}


def probability(model: dict, x: np.ndarray) -> np.ndarray:
    if "constant" in model:
        return np.full(len(x), model["constant"])
    w = model["w"]
    z = (np.tanh((x - model["mean"]) / model["scale"] @ w[0] + w[1]) @ w[2] + w[3]) / model["temperature"]
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def labelled(labels: DataFrame, column: str, learn) -> DataFrame:
    """(doc_id, y): one label a document of the folds to learn from."""
    return labels.where(learn & F.col(column).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col(column)).cast("int").alias("y"))


def quality(docs: DataFrame, labels: DataFrame, learn, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """docs(doc_id, text), labels(doc_id, quality) -> doc_id, score, predicted."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    vectors = context_vectors(rows)

    def pool(batches):
        for batch in slices(batches, 1 << 20):
            x = pooled(batch.column("text").to_pylist(), vectors)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "y": batch.column("y"), "x": pa.array([r.tobytes() for r in x], pa.binary())})

    chosen = labelled(labels, "quality", learn).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    some = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y"))  # sample rows at most, however often an id is there
    got = some.mapInArrow(pool, "doc_id long, y int, x binary").orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    x = np.frombuffer(b"".join(r.x for r in got)).reshape(len(got), 2 * DIMS + 1)
    model = network(x, np.array([r.y for r in got]))

    def score(batches):
        for batch in slices(batches, 1 << 20):
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "score": probability(model, pooled(batch.column("text").to_pylist(), vectors))})

    return rows.mapInArrow(score, "doc_id long, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), crc_mod("doc_id", 5) != 0)
    return out.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
