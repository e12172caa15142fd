"""Language identification by a string kernel.

A text is the set of its byte n-grams of 1 to 3 bytes (lower case, hashed to
GRAMS places): the blended-spectrum presence kernel of two texts is the number of
grams they share over the geometric mean of their set sizes. Nystroem landmarks
stand for the training rows, and a batch of texts is scored by two matrix products:
presence by landmarks, kernel by coefficients. One-versus-rest kernel ridge regression
needs only two sums over the training rows, features by features and features by languages;
tasks form them and sum them up, so that the driver holds landmarks, these sums and the
coefficients, whatever the number of rows.

Learning reads at most PER_LANGUAGE documents a language of the labelled folds (least
hash of doc_id first), of every language there is; LANDMARKS of a language are landmarks, or as many
as keep all within ALL_LANDMARKS. Scoring reads every whole text.

Cases: null text, and text without a letter, is `und` with score 0; if nothing can
be learned all is `und`; null lang isn't learned from; rows that repeat a
doc_id and lang are learned from once (their least text) and scored as rows; an
empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import byte_view, crc_mod, dropped, quoted, relieved, slices, small, table, written

GRAMS, LANDMARKS, ALL_LANDMARKS, PER_LANGUAGE, RIDGE = 4096, 64, 1024, 1000, 1e-3
#: Sharpnesses of probabilities that are tried on a fifth of the training rows.
SHARP = (1.0, 2.0, 4.0, 8.0, 16.0)
UND = "und"


def presence(texts: pa.Array) -> np.ndarray:
    """Float matrix, texts by grams: 1 where a gram occurs."""
    data, offsets = byte_view(pc.utf8_lower(pc.fill_null(texts, "")))
    n, size = len(offsets) - 1, np.diff(offsets)
    out = np.zeros((n, GRAMS), np.float32)
    doc = np.repeat(np.arange(n, dtype=np.int64) * GRAMS, size)
    left = np.repeat(offsets[1:], size) - np.arange(len(data))
    code, flat = np.zeros(len(data), np.uint32), out.reshape(-1)
    for k in range(3):
        code = code[: len(data) - k] * np.uint32(257) + data[k:] + np.uint32(1)
        place = (code * np.uint32(2654435761)) >> np.uint32(20)
        fits = left[: len(place)] > k
        flat[(doc[: len(place)] + place)[fits]] = 1
    return out


def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    sizes = np.sqrt(np.outer(a.sum(1), b.sum(1)))
    return (a @ b.T) / np.maximum(sizes, 1)


def features(df: DataFrame) -> DataFrame:
    """(doc_id, lang, text, nth) -> (doc_id, lang, nth, grams): the presence bits, packed."""

    def run(batches):
        for batch in slices(batches, 512 << 10, 500):
            bits = np.packbits(presence(batch.column("text")).astype(bool), axis=1)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "lang": batch.column("lang"), "nth": batch.column("nth"), "grams": pa.array([b.tobytes() for b in bits], pa.binary())})

    return df.mapInArrow(run, "doc_id long, lang string, nth int, grams binary")


def unpacked(grams: pa.Array) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(grams.to_pylist()), np.uint8).reshape(len(grams), GRAMS // 8), axis=1).astype(np.float32)


def row_sums(features_of, n: int):
    """mapInArrow: grams, class, held -> rows (held, at, part) of the sums of a task: `at` < width is a row of
    features by features, then come the classes by features."""

    def run(batches):
        gram, by_class = [0.0, 0.0], [0.0, 0.0]
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rows = batch.slice(at, 500)
                phi, y = features_of(unpacked(rows.column("grams"))), rows.column("class").to_numpy()
                held = rows.column("held").to_numpy(zero_copy_only=False)
                for k in (0, 1):
                    some = phi[held == bool(k)]
                    one = np.zeros((len(some), n))
                    one[np.arange(len(some)), y[held == bool(k)]] = 1
                    gram[k], by_class[k] = gram[k] + some.T @ some, by_class[k] + one.T @ some
        for k in (0, 1):
            if not np.isscalar(gram[k]):
                both = np.concatenate([gram[k], by_class[k]])
                relieved()
                for at in range(0, len(both), 200):
                    part = both[at : at + 200]
                    yield pa.record_batch({"held": pa.array([bool(k)] * len(part)), "at": pa.array(np.arange(at, at + len(part))), "part": pa.array([r.tobytes() for r in part], pa.binary())})

    return run


def added(rows):
    """One row of the sums from those of all tasks."""
    total = np.sum([np.frombuffer(p, float) for p in rows["part"].to_pylist()], axis=0)
    return pa.table({"held": rows["held"][:1], "at": rows["at"][:1], "part": pa.array([total.tobytes()], pa.binary())})


def losses(features_of, beta: np.ndarray):
    """mapInArrow: grams, class -> the summed loss of each sharpness."""

    def run(batches):
        total = np.zeros(len(SHARP))
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rows = batch.slice(at, 500)
                margin, y = features_of(unpacked(rows.column("grams"))) @ beta, rows.column("class").to_numpy()
                total += [-np.log(np.maximum(softmax(margin * t)[np.arange(len(y)), y], 1e-9)).sum() for t in SHARP]
        relieved()
        yield pa.record_batch({"at": pa.array(range(len(SHARP)), pa.int32()), "loss": pa.array(total)})

    return run


def train(docs: DataFrame, learn, per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS, most: int = ALL_LANDMARKS) -> dict | None:
    """learn: the condition on doc_id of rows to learn from. None if there are none."""
    spark = docs.sparkSession
    named = docs.where(learn & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    base = named.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    # of each language the ids of least hash, cut before they meet to a few times as many as are wanted
    n = named.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n"))
    hashed = (F.xxhash64("doc_id").cast("double") + 2.0**63) / 2.0**64
    near = base.select("doc_id", "lang").join(small(n), "lang").where(hashed * F.col("n") < 4 * per_language).select("doc_id", "lang").distinct()
    order = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = near.withColumn("nth", order).where(F.col("nth") <= per_language)  # per_language rows of each
    one = base.select("doc_id", "lang", "text").join(small(chosen), ["doc_id", "lang"]).groupBy("doc_id", "lang", "nth").agg(F.min("text").alias("text"))
    sample = written(spark, features(one.select("doc_id", "lang", "text", "nth")), "language-sample")
    langs = sorted(r.lang for r in sample.select("lang").distinct().collect())  # what can be answered
    if not langs:
        return None
    each = max(1, min(landmarks, most // len(langs)))
    picked = sample.where(F.col("nth") <= each).orderBy("nth", F.xxhash64("lang"), "lang", "doc_id").limit(most)  # rows without letters leave gaps
    z = unpacked(pa.array([r.grams for r in picked.select("grams").collect()], pa.binary()))
    if not len(z):
        z = unpacked(pa.array([r.grams for r in sample.orderBy("nth", "lang").limit(most).select("grams").collect()], pa.binary()))
    values, vectors = np.linalg.eigh(kernel(z, z).astype(float))
    keep = values > values[-1] * 1e-6
    half = vectors[:, keep] / np.sqrt(values[keep])
    width, classes = half.shape[1] + 1, len(langs)

    def features_of(x: np.ndarray) -> np.ndarray:
        return np.c_[kernel(x, z) @ half, np.ones(len(x))]

    number = spark.createDataFrame([(x, i) for i, x in enumerate(langs)], "lang string, class int")
    rows = sample.join(small(number), "lang").select("grams", "class", (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(5)) == 0).alias("held"))
    sums = rows.mapInArrow(row_sums(features_of, classes), "held boolean, at long, part binary").groupBy("held", "at").applyInArrow(added, "held boolean, at long, part binary")
    both = {k: np.zeros((width + classes, width)) for k in (False, True)}
    for r in sums.collect():  # width + classes rows, twice
        both[r.held][r["at"]] = np.frombuffer(r.part, float)

    def solve(s: np.ndarray) -> np.ndarray:
        gram, by_class = s[:width], s[width:]
        total = gram[-1]  # the last feature is 1: its row sums all
        return np.linalg.solve(gram + RIDGE * total[-1] * np.eye(width) / 100, (2 * by_class - total).T)

    fit = both[False] if both[False][width - 1, -1] else both[True]
    loss = rows.where("held").mapInArrow(losses(features_of, solve(fit)), "at int, loss double").groupBy("at").agg(F.sum("loss").alias("loss"))
    sharp = min(((r.loss, SHARP[r["at"]]) for r in loss.collect()), default=(0.0, SHARP[0]))[1]
    beta = solve(both[False] + both[True])
    dropped(spark, sample)
    return {"langs": langs, "z": z, "beta": (half @ beta[:-1]).astype(np.float32), "bias": beta[-1], "sharp": sharp}


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def predict(docs: DataFrame, model: dict | None, with_rows: bool = False) -> DataFrame:
    """docs -> doc_id, lang_pred, score and, if with_rows, row: the whole row as a struct."""
    row = F.struct(*map(quoted, docs.columns)) if with_rows else F.lit(None).cast("int")
    rows = docs.select(F.col("doc_id").cast("long"), (F.lit(None) if with_rows else F.col("text")).cast("string").alias("text"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"), row.alias("row"))
    if model is None:
        return rows.select("doc_id", F.lit(UND).alias("lang_pred"), F.lit(0.0).alias("score"), "row")
    kind = StructType.fromDDL("doc_id long, lang_pred string, score double").add("row", rows.schema["row"].dataType)

    def run(batches):
        langs = np.array([*model["langs"], UND], object)
        if with_rows:  # the text is in the row
            batches = (b.set_column(1, "text", pc.cast(b.column("row").field("text"), pa.string())) for b in batches)
        for batch in slices(batches, 512 << 10, 500):
            p = softmax((kernel(presence(batch.column("text")), model["z"]) @ model["beta"] + model["bias"]) * model["sharp"])
            best, letters = p.argmax(1), batch.column("letters").to_numpy(zero_copy_only=False)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "lang_pred": pa.array(langs[np.where(letters, best, len(langs) - 1)], pa.string()), "score": pa.array(np.where(letters, p.max(1), 0.0), pa.float64()), "row": batch.column("row")})

    return rows.mapInArrow(run, kind)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = predict(docs, train(docs, crc_mod("doc_id", 4) != 2))
    return out.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
