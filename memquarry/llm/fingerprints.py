"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is cut after line breaks and after the marks that end sentences, and longer parts
after words chosen by their hash, so that the parts joined are the text and texts of one
paragraph have parts too. Each part's 64-bit digest (a repeated part's with its number) is
added to one cell in each of three thirds of the sketch: a count, a sum of digests and a
sum of checks. Sketches of two versions subtract cell by cell: equal parts cancel, and
peeling cells that hold one digest recovers the parts that differ. Where peeling fails,
both are sketched anew with twice the cells and another hash, until it succeeds. The
likeness of two texts is (shared parts) / (parts of both together), repeats counted.

The next document is found without a window over the table: heads of ranges of doc_id are
taken from a narrow sort, rows go to their range, and the head of each range also to the
range before it, so that tasks stream through ranges and hold two documents at a time.

Cases: null text is empty and has no part; two empty texts are alike (1.0), an empty and
another are not (0.0); texts of any length are handled whole; of rows with one doc_id those
with the larger xxhash64 of the text come first, null doc_ids come last; repeated rows are
rows of their own; a table of one row is its own next; empty tables give no rows; extra
columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, slices, table

#: Cells of a fingerprint; a multiple of 3.
CELLS = 24
#: Characters of a part beyond which it is cut after words, one in so many on average.
LONG_PART, WORDS = 256, 16
#: Characters of texts that are sketched at once.
AT_ONCE = 400_000
PART = re.compile(r"[^\n.!?]*(?:\n+|[.!?]+\s*|\Z)")
WORD = re.compile(r"\s*\S+\s*")
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def golden(n: int) -> np.uint64:
    return np.uint64(int(GOLDEN) * n % (1 << 64))


def digests(text: str) -> np.ndarray:
    """A 64-bit digest for each part of a text."""
    parts = PART.findall(text)
    if any(len(p) > LONG_PART for p in parts):
        whole, parts = parts, []
        for part in whole:
            if len(part) <= LONG_PART:
                parts.append(part)
                continue
            at = 0
            for word in WORD.finditer(part):
                if xxhash.xxh32_intdigest(word[0].encode()) % WORDS == 0:
                    parts.append(part[at : word.end()])
                    at = word.end()
            parts.append(part[at:])
    return np.array([xxhash.xxh3_64_intdigest(p.encode()) for p in parts if p], np.uint64)


def numbered(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(document, key) of all parts: a repeated part has its number mixed in, the first is its digest."""
    doc = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    key = np.concatenate([np.zeros(0, np.uint64), *parts])
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])][: len(key)]
    place = np.arange(len(key))
    again = (place - np.maximum.accumulate(np.where(new, place, 0))).astype(np.uint64)
    return doc, np.where(again > 0, mix(key + again * GOLDEN), key)


class Sketches:
    """Sketches of several documents: counts, sums of keys and sums of checks by (document, cell)."""

    def __init__(self, count, keys, check, salt: int):
        self.count, self.keys, self.check, self.salt = count, keys, check, salt

    @classmethod
    def of(cls, doc: np.ndarray, key: np.ndarray, n: int, cells: int = CELLS, salt: int = 0) -> Sketches:
        out = cls(np.zeros((n, cells), np.int32), np.zeros((n, cells), np.uint64), np.zeros((n, cells), np.uint32), salt)
        out.add(doc, key, np.ones(len(key), np.int32))
        return out

    def checks(self, key: np.ndarray) -> np.ndarray:
        return (mix(key + golden(7 + self.salt)) >> np.uint64(32)).astype(np.uint32)

    def places(self, key: np.ndarray) -> list[np.ndarray]:
        third = self.count.shape[1] // 3
        return [t * third + (mix(key ^ golden(3 * self.salt + t + 11)) % np.uint64(third)).astype(np.int64) for t in range(3)]

    def add(self, doc: np.ndarray, key: np.ndarray, sign: np.ndarray) -> None:
        check, less = self.checks(key), sign < 0
        key_, check = np.where(less, ~key + np.uint64(1), key), np.where(less, ~check + np.uint32(1), check)
        for place in self.places(key):
            at = doc * self.count.shape[1] + place
            np.add.at(self.count.reshape(-1), at, sign)
            np.add.at(self.keys.reshape(-1), at, key_)
            np.add.at(self.check.reshape(-1), at, check)

    def sizes(self) -> np.ndarray:
        return self.count[:, : self.count.shape[1] // 3].sum(1)

    def texts(self) -> list[str]:
        """The fingerprints as Base64 of all counts, sums and checks, little-endian."""
        return [base64.b64encode(c.astype("<i4").tobytes() + k.astype("<u8").tobytes() + x.astype("<u4").tobytes()).decode() for c, k, x in zip(self.count, self.keys, self.check)]

    @classmethod
    def read(cls, texts: list[str]) -> Sketches:
        raw = [base64.b64decode(t) for t in texts]
        m = len(raw[0]) // 16
        return cls(*(np.stack([np.frombuffer(r[a * m : b * m], kind) for r in raw]).copy() for a, b, kind in ((0, 4, "<i4"), (4, 12, "<u8"), (12, 16, "<u4"))), salt=0)

    def minus(self, rows: np.ndarray, other: Sketches, others: np.ndarray) -> Sketches:
        return Sketches(self.count[rows] - other.count[others], self.keys[rows] - other.keys[others], self.check[rows] - other.check[others], self.salt)

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What a difference holds: (row, key, sign) of all that was peeled, and which rows are wholly peeled."""
        found, third = [], self.count.shape[1] // 3
        for _ in range(4 * self.count.shape[1]):
            row, cell = np.nonzero(np.abs(self.count) == 1)
            sign = self.count[row, cell]
            less = sign < 0
            key, check = self.keys[row, cell], self.check[row, cell]
            key, check = np.where(less, ~key + np.uint64(1), key), np.where(less, ~check + np.uint32(1), check)
            one = (check == self.checks(key)) & (np.choose(cell // third, self.places(key)) == cell)
            row, key, sign = row[one], key[one], sign[one]
            if not len(row):
                break
            order = np.lexsort((key, row))
            row, key, sign = row[order], key[order], sign[order]
            first = np.r_[True, (row[1:] != row[:-1]) | (key[1:] != key[:-1])]
            row, key, sign = row[first], key[first], sign[first]
            self.add(row, key, -sign)
            found.append((row, key, sign))
        done = ~(self.count.any(1) | self.keys.any(1) | self.check.any(1))
        row, key, sign = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int32))
        return row, key, sign, done


def differences(parts: tuple, base: Sketches, left: np.ndarray, right: np.ndarray):
    """Pairs (left[i], right[i]) of documents whose (document, key) are `parts` and whose
    fingerprints are `base` -> (pair, key, sign) of every part that one has more often (sign 1:
    the left) and the cells that each pair took."""
    doc, key = parts
    begin = np.searchsorted(doc, np.arange(len(base.count) + 1))
    todo, sketches, level, out = np.arange(len(left)), base, 0, []
    cells = np.zeros(len(left), np.int64)
    a, b = left, right
    while len(todo):
        row, k, sign, done = sketches.minus(a, sketches, b).peel()
        kept = done[row]
        out.append((todo[row[kept]], k[kept], sign[kept]))
        cells[todo[done]] = sketches.count.shape[1]
        todo, level = todo[~done], level + 1
        if len(todo):  # twice the cells, another hash; only documents of pairs that are left
            docs, number = np.unique(np.r_[left[todo], right[todo]], return_inverse=True)
            n = begin[docs + 1] - begin[docs]
            at = np.repeat(begin[docs] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            sketches = Sketches.of(np.repeat(np.arange(len(docs)), n), key[at], len(docs), base.count.shape[1] << level, level)
            a, b = number[: len(todo)], number[len(todo) :]
    return *(np.concatenate(x) for x in zip(*out)), cells


def likeness(a: np.ndarray, b: np.ndarray, differing: np.ndarray) -> np.ndarray:
    """Shared parts / parts of both, from sizes and the number of differing parts; 1 where both are empty."""
    whole = a + b + differing
    return np.where(whole > 0, (a + b - differing) / np.maximum(whole, 1), 1.0)


def compared(texts: list[str], left: np.ndarray, right: np.ndarray, cells: int = CELLS):
    """(fingerprints, likeness of each pair, (pair, key, sign) of the differing parts, cells taken)."""
    doc, key = numbered([digests(t) for t in texts])
    base = Sketches.of(doc, key, len(texts), cells)
    pair, part, sign, took = differences((doc, key), base, left, right)
    size = base.sizes()
    return base.texts(), likeness(size[left], size[right], np.bincount(pair, minlength=len(left))), (pair, part, sign), took


def compare_versions(versions: DataFrame, cells: int = CELLS) -> DataFrame:
    """versions(id, old, new) -> id, old_fingerprint, new_fingerprint, likeness, cells (of the
    sketch that could be peeled), gone and added (digests of parts that only old or new has)."""
    if cells % 3:
        raise ValueError("cells must be a multiple of 3")

    def run(batches):
        for batch in slices(batches, AT_ONCE, text="old"):
            for at in range(0, batch.num_rows, 50):
                rows = batch.slice(at, 50)
                n = rows.num_rows
                prints, near, (pair, key, sign), took = compared([t or "" for c in ("old", "new") for t in rows.column(c).to_pylist()], np.arange(n), n + np.arange(n), cells)
                lists = [[key[(pair == i) & (sign == s)].astype(np.int64) for i in range(n)] for s in (1, -1)]
                kinds = pa.list_(pa.int64())
                yield pa.record_batch([rows.column("id"), pa.array(prints[:n]), pa.array(prints[n:]), pa.array(near), pa.array(took), pa.array(lists[0], kinds), pa.array(lists[1], kinds)], names=["id", "old_fingerprint", "new_fingerprint", "likeness", "cells", "gone", "added"])

    kind = "old_fingerprint string, new_fingerprint string, likeness double, cells long, gone array<long>, added array<long>"
    return versions.select(F.col("id").cast("long"), F.col("old").cast("string"), F.col("new").cast("string")).mapInArrow(run, "id long, " + kind)


def in_ranges(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) in tasks by ranges of descending doc_id, sorted; a range's rows are
    followed by the first row of the range after it (the first of all after the last) with stop."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("at", F.struct(F.col("doc_id").alias("d"), F.xxhash64("text").alias("h")))
    ranges = rows.select("at").repartitionByRange(4 * n, F.desc("at"))
    heads = sorted(([r.top.d, r.top.h] for r in ranges.groupBy(F.spark_partition_id()).agg(F.max("at").alias("top")).collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]), reverse=True)
    many = max(len(heads), 1)
    known = F.from_json(F.lit(json.dumps([{"d": d, "h": h} for d, h in heads])), "array<struct<d:long,h:long>>")
    steps = F.array(*(F.lit(1 << b) for b in reversed(range(many.bit_length()))))
    # binary search: the last head that isn't after the row
    rows = rows.withColumn("range", F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step < many) & (F.get(known, at + step) >= F.col("at")), at + step).otherwise(at)))
    there = F.struct(F.col("range").alias("range"), F.lit(False).alias("stop"))
    before = F.struct(((F.col("range") + many - 1) % many).alias("range"), F.lit(True).alias("stop"))
    dealt = rows.withColumn("to", F.explode(F.when(F.get(known, F.col("range")).eqNullSafe(F.col("at")), F.array(there, before)).otherwise(F.array(there))))
    dealt = dealt.select(F.col("to.range").alias("range"), F.col("to.stop").alias("stop"), "at", "doc_id", "text").repartition(n, "range")
    return dealt.sortWithinPartitions("range", "stop", F.desc("at"), "text").select("doc_id", "text", "stop")


def edited(text: str, following: str) -> str:
    """The last half of the characters replaced by the first as many of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def chained(cells: int):
    """mapInArrow: rows of in_ranges -> the columns of op11."""

    def rows(ids: list, texts: list[str]):
        n = len(ids)
        new = [edited(a, b) for a, b in zip(texts, texts[1:])]
        own = np.arange(n)
        prints, near, _, _ = compared(texts + new, np.r_[own, own], np.r_[own + n + 1, own + 1], cells)
        out = [ids, [len(t) for t in texts[:n]], [hashlib.sha256(t.encode()).hexdigest() for t in new], prints[:n], prints[n + 1 :], near[:n], near[n:]]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.record_batch([pa.array(x, k) for x, k in zip(out, kinds)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(batches):
        ids, texts, size = [], [], 0
        for batch in slices(batches, AT_ONCE):
            for doc_id, text, stop in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "stop"))):
                texts.append(text)
                size += len(text)
                if not stop:
                    ids.append(doc_id)
                if (stop and ids) or (size > AT_ONCE and len(ids) > 1):
                    known, last = (ids, []) if stop else (ids[:-1], ids[-1:])
                    yield rows(known, texts)
                    ids, texts = last, [] if stop else [text]
                    size = sum(map(len, texts))
                elif stop:
                    texts.pop()

    return run


def fingerprints(spark: SparkSession, docs: DataFrame, cells: int = CELLS) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    if cells % 3:
        raise ValueError("cells must be a multiple of 3")
    kind = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_ranges(spark, docs).mapInArrow(chained(cells), kind)


def op11_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of the table, its edited text and the next document."""
    return fingerprints(spark, table(spark, sf_dir, "documents"))
