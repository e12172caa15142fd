"""Best-fit packing of token sequences by minimum bin slack.

Piece lengths are integers up to the capacity, so that the state of the packing
is a histogram with at most `capacity` entries whatever the corpus holds. The
plan is made on that histogram: a bin takes the longest length left, then a
bitset subset-sum over the lengths still available (counts by binary splitting)
finds the fullest feasible rest; the combination is removed as many times as the
counts allow. Pieces then look up their place by their rank among pieces of the
same length; ranks are counted in cells, so that one very common length is never
one task.

Cases: null text is empty and packs as the one closing id; texts longer than the
capacity are cut; repeated rows are packed as rows; an empty table gives no
sequences; extra columns are not read.
"""

from __future__ import annotations

import math
import os
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import CACHES, slices, table, written

CAPACITY, CLOSING_ID = 2048, 0
#: Pieces of a cell, on average, in which ranks are counted.
CELL = 5_000
#: Chunks up to so many characters are remembered; two generations of so many entries.
LONG_CHUNK, REMEMBERED = 40, 150_000


class Remembered(dict):
    """Bounded memory in two generations: a full one becomes the old one."""

    def __init__(self, make, limit: int = REMEMBERED):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= LONG_CHUNK:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


_known: dict[str, tuple[Remembered, Remembered]] = {}
CACHES["packing"] = _known.clear


#: Any character but these: a text without one needs no normaliser but lower case, as no
#: Latin-1 letter composes with another or changes its number of letters in lower case.
_odd = re.compile("[^\t\n\r\x20-\x7e\xa1-\xff]")
#: A run of Latin-1 characters other than letters, digits and blanks at the end of a chunk is a pre-token of its own.
_marks = re.compile("([!-/:-@\\[-`{-~\xa1-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf\xd7\xf7]+)(?=[ \\n]|$)")


def encoders(path: str) -> tuple[Remembered, Remembered]:
    """chunk -> its ids as little-endian 32-bit bytes, for lower-cased Latin-1 texts and for
    all others. No token of this vocabulary spans white space, so that a text's ids are
    those of its chunks between blanks."""
    if path not in _known:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers

        def remembered(plain: bool) -> Remembered:
            tokenizer = Tokenizer.from_file(path)
            if plain:
                tokenizer.normalizer = normalizers.Sequence([])

            def many(chunks):
                every = (e.ids for e in tokenizer.encode_batch_fast(chunks, add_special_tokens=False))
                return {c: struct.pack(f"<{len(ids)}I", *ids) for c, ids in zip(chunks, every)}

            known = Remembered(lambda chunk: many([chunk])[chunk], 2 * REMEMBERED if plain else REMEMBERED // 3)
            known.many = many
            return known

        _known[path] = remembered(True), remembered(False)
    return _known[path]


def chunks_of(text: str) -> tuple[bool, list[str]]:
    """(plain, chunks) of a text."""
    if _odd.search(text) or "<|" in text:  # special tokens are matched before letters are lower-cased
        return False, text.split(" ")
    return True, _marks.sub(r" \1", text.lower()).replace("\n", " ").split(" ")


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, closing_id: int = CLOSING_ID) -> DataFrame:
    """docs(doc_id, text) -> doc_id, piece, start, length, ids (binary, little-endian 32 bits)."""

    def run(batches):
        others, plain = encoders(tokenizer_path)[::-1]
        end = struct.pack("<I", closing_id)
        for batch in slices(batches, 512 << 10, owner="packing"):
            texts = [chunks_of(t or "") for t in batch.column("text").to_pylist()]
            for known, kind in ((plain, True), (others, False)):
                new = [c for c in set().union(*(x for k, x in texts if k is kind)) if c not in known and len(c) <= LONG_CHUNK and c not in known.old]
                if len(known) + len(new) > known.limit:
                    known.old = dict(known)
                    known.clear()
                known.update(known.many(new))
            rows = []
            for doc, (kind, chunks) in zip(batch.column("doc_id").to_pylist(), texts):
                ids = b"".join(map((plain if kind else others).__getitem__, chunks)) + end
                rows += [(doc, i, i * capacity, len(x) // 4, x) for i in range(math.ceil(len(ids) / 4 / capacity)) for x in (ids[i * capacity * 4 : (i + 1) * capacity * 4],)]
            for at in range(0, len(rows), 4000):
                part = rows[at : at + 4000]
                yield pa.record_batch([pa.array([r[i] for r in part], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names=["doc_id", "piece", "start", "length", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


def fullest(counts: dict[int, int], rest: int) -> list[tuple[int, int]]:
    """[(length, times)] with the greatest sum up to rest, within counts."""
    bits, mask, stages = 1, (1 << (rest + 1)) - 1, []
    for length in sorted((x for x in counts if x <= rest and counts[x]), reverse=True):
        left, k = min(counts[length], rest // length), 1
        while left:
            times = min(k, left)
            stages.append((length, times, bits))
            bits |= (bits << (times * length)) & mask
            left, k = left - times, 2 * k
        if bits >> rest & 1:
            break
    best, used = bits.bit_length() - 1, {}
    for length, times, before in reversed(stages):
        if not before >> best & 1:
            best -= length * times
            used[length] = used.get(length, 0) + times
    return sorted(used.items(), reverse=True)


def plan(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, times a bin, first bin, offset in the bin), sorted."""
    counts, ranks, bins, rows = {k: v for k, v in histogram.items() if v}, dict.fromkeys(histogram, 0), 0, []
    while counts:
        largest = max(counts)
        counts[largest] -= 1
        used = dict(fullest(counts, capacity - largest))
        counts[largest] += 1
        used[largest] = used.get(largest, 0) + 1
        repeat, offset = min(counts[x] // n for x, n in used.items()), 0
        for length, times in sorted(used.items(), reverse=True):
            rows.append((length, ranks[length], times, bins, offset))
            ranks[length] += times * repeat
            offset += times * length
            counts[length] -= times * repeat
            if not counts[length]:
                del counts[length]
        bins += repeat
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def packed(spark: SparkSession, items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """items with (doc_id, piece, length <= capacity) and more -> the same with sequence_id, offset."""
    cells = max(1, math.ceil(items.count() / CELL))
    every = [F.col(f"`{c}`") for c in items.columns]
    items = items.withColumn("cell", F.pmod(F.xxhash64(*every), F.lit(cells)))
    per = items.groupBy("length", "cell").agg(F.count("*").alias("n"))
    histogram = {r[0]: r[1] for r in per.groupBy("length").agg(F.sum("n")).collect()}  # at most `capacity` rows
    rows = plan(histogram, capacity)
    before = per.select("length", "cell", (F.sum("n").over(Window.partitionBy("length").orderBy("cell")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "cell").orderBy("doc_id", "piece", F.xxhash64(*every))) - 1  # rows that are equal in this are equal
    items = items.withColumn("own", own).join(before, ["length", "cell"]).withColumn("rank", F.col("before") + F.col("own")).drop("cell", "own", "before")
    keys = (rows[:, 0] << 44) + rows[:, 1]
    at_length, at_rank = items.columns.index("length"), items.columns.index("rank")
    every = items.columns
    names = [c for c in every if c != "rank"]

    def place(batches):
        for batch in batches:
            length, rank = batch.column(at_length).to_numpy(), batch.column(at_rank).to_numpy()
            row = rows[np.searchsorted(keys, (length << 44) + rank, "right") - 1]
            nth = rank - row[:, 1]
            columns = [batch.column(i) for i, c in enumerate(every) if c != "rank"]
            yield pa.record_batch([*columns, pa.array(row[:, 3] + nth // row[:, 2], pa.int64()), pa.array(row[:, 4] + nth % row[:, 2] * length, pa.int64())], names=[*names, "sequence_id", "offset"])

    kinds = dict(items.dtypes)
    return items.mapInArrow(place, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", sequence_id long, offset long")


def pack_documents(spark: SparkSession, docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    pieces = token_pieces(docs, tokenizer_path, capacity).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packed(spark, written(spark, pieces, "pack-pieces"), capacity)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
