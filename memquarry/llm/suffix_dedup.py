"""Removal of repeated passages by prefix-free parsing and suffix order.

Every byte that a LENGTH-byte string covers goes if that string also starts in a
document with a smaller doc_id. No comparison crosses documents.

1. Parse. Rolling hashes of GRAM bytes trigger phrase ends; a phrase keeps the
   LENGTH-1 bytes after it (the overlap of prefix-free parsing), so that each
   LENGTH-byte string lies in the phrase in which it starts. The dictionary is the
   set of distinct phrases with the least document of each; the parse is the list
   of phrases of each document.
2. An occurrence of a phrase in a later document is repeated as a whole: highly
   repetitive text ends here. Only the dictionary is looked at more closely.
3. Each string has a key, the least rolling hash in it, so that equal strings have
   equal keys. Keys that several documents of the dictionary hold are shared; the
   stretches of text under them are the dictionary's suffixes that need an order.
4. Stretches of a key meet in one task, where doubling ranks put all suffixes of the
   distinct ones into the corpus order of their first LENGTH bytes; equal ranks are
   equal strings, and the least document of a rank goes back along the parse. Keys
   of more than HOT documents are split: their distinct stretches are combined before
   they are shuffled, and what they give is joined back.

The texts are dealt once, into a bucketed table by document, and each step joins
its findings to that table without moving the texts again.

Cases: null text is empty; texts shorter than LENGTH stay; a null doc_id neither
removes nor loses anything; rows that repeat a doc_id are one document and don't
remove from each other; an empty table gives an empty result; other columns come
back as they are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import bucketed, byte_view, dropped, mix, quoted, relieved, slices, table, written

LENGTH, GRAM, PHRASE_BITS, HOT = 50, 16, 8, 10_000
#: Keys are shortened where they only tell what to look at more closely.
SHORT = np.uint64(16)
#: Bytes of stretches, of whole keys, that are put into order at once.
PART = 1 << 20
_letters = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_odd = np.uint64(0xFF51AFD7ED558CCD)
_top = np.uint64(0xFFFFFFFFFFFFFFFF)
SLICE = 256 << 10


class Parsed:
    """A few texts: rolling hashes, strings that fit, and phrases."""

    def __init__(self, column, length: int):
        self.data, self.offsets = byte_view(column)
        data, offsets, n = self.data, self.offsets, len(self.data)
        h = _letters[data]
        for step in (1, 2, 4, 8):
            h = h[: max(len(h) - step, 0)] * _odd + h[step:]
            h ^= h >> np.uint64(29)
        self.hash = np.full(n, _top, np.uint64)
        self.hash[: len(h)] = h
        ends = np.repeat(offsets[1:], np.diff(offsets))
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        at = np.arange(n)
        self.fits = at + length <= ends
        trigger = ((h >> np.uint64(40)) & np.uint64((1 << PHRASE_BITS) - 1)) == 0
        trigger[1:] &= h[1:] != h[:-1]
        trigger &= at[: len(h)] + GRAM <= ends[: len(h)]
        begins = np.zeros(n + 1, bool)
        begins[: len(h)] = trigger
        begins[offsets] = True
        begins = np.flatnonzero(begins[:n])
        # phrases without a string that fits play no part
        stop = np.r_[begins[1:], n]
        last = np.minimum(stop, offsets[1:][self.doc[begins]] - length + 1) if n else stop
        some = last > begins
        self.begin, self.stop = begins[some], last[some]
        self.length = length

    def starts(self) -> np.ndarray:
        return self.begin - self.offsets[self.doc[self.begin]]

    def repeated(self, starts: list) -> np.ndarray:
        """Of the phrases, those whose start in their document is in the document's list."""
        sizes = [0 if s is None else len(s) for s in starts]
        listed = np.concatenate([np.asarray(s, np.int64) + o for s, o in zip(starts, self.offsets) if s]) if sum(sizes) else np.zeros(0, np.int64)
        return np.isin(self.begin, listed)

    def strings(self, phrases: np.ndarray) -> np.ndarray:
        """Where strings start in the given phrases."""
        edge = np.zeros(len(self.data) + 1, np.int8)
        edge[self.begin[phrases]] += 1
        edge[self.stop[phrases]] -= 1
        return np.cumsum(edge[:-1]).astype(bool)

    def keys(self) -> np.ndarray:
        """The least rolling hash of the string that starts at each place."""
        width, m, have = self.length - GRAM + 1, self.hash, 1
        while have < width:
            step = min(have, width - have)
            low = m.copy()
            np.minimum(m[:-step], m[step:], out=low[:-step])
            m, have = low, have + step
        return m

    def runs(self, inside: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begins and ends of the runs of strings with one key in one document."""
        if not len(keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        change = np.ones(len(keys), bool)
        change[1:] = (keys[1:] != keys[:-1]) | (inside[1:] != inside[:-1]) | (self.doc[1:] != self.doc[:-1])
        begin = np.flatnonzero(change)
        end = np.r_[begin[1:], len(keys)]
        some = inside[begin]
        return begin[some], end[some]


def phrase_rows(length: int):
    def run(batches):
        for batch in slices(batches, SLICE):
            p = Parsed(batch.column("text"), length)
            view, doc = memoryview(np.ascontiguousarray(p.data)), p.doc[p.begin]
            digest = np.frombuffer(b"".join(hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(p.begin.tolist(), (p.stop + length - 1).tolist())), np.int64).reshape(-1, 2)
            ids, tags = batch.column("doc_id").to_numpy(), batch.column("tag").to_numpy()
            # one row a phrase and document, with all places of the phrase in it
            order = np.lexsort((p.begin, digest[:, 1], digest[:, 0], doc))
            doc, digest, at = doc[order], digest[order], p.starts()[order]
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (digest[1:] != digest[:-1]).any(1)
            first = np.flatnonzero(new)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(doc)], pa.int32()), pa.array(at, pa.int32()))
            yield pa.record_batch({"doc_id": ids[doc[first]], "tag": tags[doc[first]], "at": lists, "h1": digest[first, 0], "h2": digest[first, 1]})

    return run


def key_rows(length: int):
    def run(batches):
        for batch in slices(batches, SLICE):
            p = Parsed(batch.column("text"), length)
            keys = p.keys()
            begin, _ = p.runs(p.strings(~p.repeated(batch.column("repeated").to_pylist())), keys)
            key, doc = (keys[begin] >> SHORT).view(np.int64), batch.column("doc_id").to_numpy()[p.doc[begin]]
            order = np.lexsort((key, doc))
            key, doc = key[order], doc[order]
            new = np.r_[True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])] if len(key) else np.zeros(0, bool)
            yield pa.record_batch({"key": key[new], "doc_id": doc[new]})

    return run


def shared_keys(hot: int):
    """Of the (key, doc_id) rows of a partition by key: those whose key several documents have."""

    def run(batches):
        rows = [(b.column("key").to_numpy(), b.column("doc_id").to_numpy()) for b in batches]
        if rows:
            key, doc = (np.concatenate(x) for x in zip(*rows))
            order = np.lexsort((doc, key))
            key, doc = key[order], doc[order]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, int)
            end = np.r_[first[1:], len(key)] if len(key) else first
            many = np.repeat(doc[first] != doc[end - 1], end - first)
            large = np.repeat(end - first > hot, end - first)[many]
            key, doc = key[many], doc[many]
            for i in range(0, len(key), 100_000):
                yield pa.record_batch({"key": key[i : i + 100_000], "doc_id": doc[i : i + 100_000], "hot": large[i : i + 100_000]})

    return run


def stretch_rows(length: int):
    """The stretches of each text under the keys in its list."""

    def run(batches):
        for batch in slices(batches, SLICE):
            p = Parsed(batch.column("text"), length)
            keys = p.keys()
            begin, end = p.runs(p.strings(~p.repeated(batch.column("repeated").to_pylist())), keys)
            short = keys[begin] >> SHORT
            lists = batch.column("keys").to_pylist()
            salt = mix(np.arange(1, len(lists) + 1, dtype=np.uint64))
            wanted = np.sort(mix(np.array([k for x in lists for k in x], np.int64).view(np.uint64) ^ np.repeat(salt, [len(x) for x in lists])))
            if not len(wanted):
                continue
            mine = mix(short ^ salt[p.doc[begin]])
            some = wanted[np.minimum(np.searchsorted(wanted, mine), len(wanted) - 1)] == mine
            begin, end, short = begin[some], end[some], short[some]
            doc, data = p.doc[begin], p.data.tobytes()
            ids, tags = batch.column("doc_id").to_numpy(), batch.column("tag").to_numpy()
            yield pa.record_batch({"key": short.view(np.int64), "doc_id": ids[doc], "tag": tags[doc], "at": pa.array(begin - p.offsets[doc], pa.int32()), "stretch": pa.array([data[a:b] for a, b in zip(begin.tolist(), (end + length - 1).tolist())], pa.binary())})

    return run


def suffix_ranks(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, ranks): the suffixes with `length` bytes before their stretch ends, and
    their place in the order of those bytes; equal bytes have equal ranks."""
    have = 1
    rank = data.astype(np.int64)
    ends = np.repeat(offsets[1:], np.diff(offsets))
    while have < length:
        step = min(have, length - have)
        if have < 4:  # the first bytes are packed, not ranked
            packed = np.zeros(len(data), np.int64)
            for i in range(min(4, length)):
                packed[: len(data) - i] = (packed[: len(data) - i] << 8) | data[i:]
            rank, have = packed, min(4, length)
            continue
        pair = (rank[: len(rank) - step] << 31) | rank[step:] if have > 4 else None
        if pair is None:
            pair = (rank[: len(rank) - step].astype(np.uint64) << np.uint64(32)) | rank[step:].astype(np.uint64)
        have += step
        inside = np.flatnonzero(np.arange(len(pair)) + have <= ends[: len(pair)])
        _, order = np.unique(pair[inside], return_inverse=True)
        rank = np.zeros(len(data), np.int64)
        rank[inside] = order
    inside = np.flatnonzero(np.arange(len(data)) + length <= ends)
    return inside, rank[inside]


def least_documents(stretches, first: np.ndarray, length: int):
    """(list offsets, sizes, documents): for each distinct stretch its runs of strings
    and the least document that holds them."""
    data, offsets = byte_view(stretches)
    place, rank = suffix_ranks(data, offsets, length)
    of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[place]
    least = np.full(int(rank.max(initial=-1)) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, rank, first[of])
    least = least[rank]
    at = np.flatnonzero(np.r_[True, (least[1:] != least[:-1]) | (of[1:] != of[:-1])]) if len(of) else np.zeros(0, int)
    size, owner = np.diff(np.r_[at, len(of)]), of[at]
    return np.r_[0, np.cumsum(np.bincount(owner, minlength=len(first)))], size, least[at]


def later_runs(doc, tag, at, lists, size, least):
    """The runs of strings of occurrences (doc, tag, at, list) that an earlier document has."""
    n = np.diff(lists)[at[1]]
    of = np.repeat(np.arange(len(n)), n)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    row = lists[at[1]][of] + nth
    before = np.cumsum(size) - size
    begin = at[0][of] + before[row] - before[lists[at[1]][of]]
    some = least[row] < doc[of]
    return pa.record_batch({"doc_id": doc[of][some], "tag": tag[of][some], "run": pa.array(((begin << 32) | (begin + size[row]))[some], pa.int64())})


def whole_keys(batches):
    """The rows of a partition by key in parts of about PART bytes of stretches; all of a key are in one part."""
    rows = [pa.Table.from_batches([b]) for b in batches]
    if not rows or not (whole := pa.concat_tables(rows)).num_rows:
        return
    del rows
    parts = 1 + whole["stretch"].nbytes // PART
    part = whole["key"].to_numpy() % parts
    for i in range(parts):
        some = whole.filter(pa.array(part == i)) if parts > 1 else whole
        if some.num_rows:
            yield some
    del whole
    relieved()


def resolved(length: int):
    """All stretches of a partition by key -> runs to remove."""

    def run(batches):
        for rows in whole_keys(batches):
            yield from some(rows)

    def some(rows):
        coded = rows["stretch"].combine_chunks().dictionary_encode()
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        code, doc = coded.indices.to_numpy(), rows["doc_id"].to_numpy()
        first = np.full(len(coded.dictionary), np.iinfo(np.int64).max)
        np.minimum.at(first, code, doc)
        lists, size, least = least_documents(coded.dictionary, first, length)
        tag, at = rows["tag"].to_numpy(), rows["at"].to_numpy().astype(np.int64)
        later = first[code] < doc
        later |= np.minimum.reduceat(np.r_[least, np.iinfo(np.int64).max], lists[:-1])[code] < doc if len(least) else False
        doc, tag, at, code = doc[later], tag[later], at[later], code[later]
        for i in range(0, len(doc), 50_000):
            s = slice(i, i + 50_000)
            yield later_runs(doc[s], tag[s], (at[s], code[s]), lists, size, least)

    return run


def distinct_resolved(length: int):
    """The distinct stretches of a partition by key, with the least document of each -> lists to be joined back."""

    def run(batches):
        for rows in whole_keys(batches):
            yield from some(rows)

    def some(rows):
        lists, size, least = least_documents(rows["stretch"], rows["first"].to_numpy(), length)
        for i in range(0, rows.num_rows, 20_000):
            j = min(i + 20_000, rows.num_rows)
            cut, o = slice(lists[i], lists[j]), pa.array(lists[i : j + 1] - lists[i], pa.int32())
            yield pa.record_batch({"s1": rows["s1"][i:j].combine_chunks(), "s2": rows["s2"][i:j].combine_chunks(), "sizes": pa.ListArray.from_arrays(o, pa.array(size[cut], pa.int32())), "least": pa.ListArray.from_arrays(o, pa.array(least[cut], pa.int64()))})

    return run


def removed_runs(batches):
    """(doc_id, tag, at, sizes, least): stretches with their lists -> runs to remove."""
    for b in batches:
        lists = np.r_[0, np.cumsum(b.column("sizes").value_lengths().to_numpy())]
        size, least = b.column("sizes").flatten().to_numpy().astype(np.int64), b.column("least").flatten().to_numpy()
        yield later_runs(b.column("doc_id").to_numpy(), b.column("tag").to_numpy(), (b.column("at").to_numpy().astype(np.int64), np.arange(b.num_rows)), lists, size, least)


def whole_characters(data: np.ndarray, offsets: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """gone, and the other bytes of UTF-8 characters that it holds a byte of; a byte that belongs to no character is its own."""
    at = np.arange(len(data))
    lead = (data & 0xC0) != 0x80
    lead[offsets[:-1][offsets[:-1] < len(data)]] = True
    head = np.maximum.accumulate(np.where(lead, at, 0))
    size = np.searchsorted(np.array([0xC0, 0xE0, 0xF0], np.uint8), data[head], side="right") + 1
    lead |= at - head >= size
    char = np.cumsum(lead)
    return (np.bincount(char[gone], minlength=int(char[-1]) + 1) > 0)[char] if len(data) else gone


def applied(length: int, with_text: bool, characters: bool = False):
    def run(batches):
        for batch in slices(batches, SLICE):
            p = Parsed(batch.column("text"), length)
            covered = p.strings(p.repeated(batch.column("repeated").to_pylist()))
            for o, runs in zip(p.offsets, batch.column("runs").to_pylist()):
                for r in runs or ():
                    covered[o + (r >> 32) : o + (r & 0xFFFFFFFF)] = True
            edge = np.zeros(len(covered) + length, np.int32)
            at = np.flatnonzero(covered)
            edge[at] += 1
            edge[at + length] -= 1
            gone = np.cumsum(edge[: len(covered)], dtype=np.int32) > 0
            cut = whole_characters(p.data, p.offsets, gone) if characters else gone
            out: list = [[], [], [], [], [], []]
            for a, b in zip(p.offsets[:-1].tolist(), p.offsets[1:].tolist()):
                g = gone[a:b]
                step = np.diff(np.r_[0, g.astype(np.int8), 0])
                begin, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
                kept = p.data[a:b][~g].tobytes() if len(begin) else p.data[a:b].tobytes()
                for x, v in zip(out, (b - a, int(g.sum()), len(begin), hashlib.sha256(kept).hexdigest(), [{"start": int(i), "end": int(j)} for i, j in zip(begin, end)], (p.data[a:b][~cut[a:b]].tobytes() if characters and len(begin) else kept) if with_text else None)):
                    x.append(v)
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), span, pa.binary())
            yield pa.record_batch([batch.column("doc_id"), batch.column("rest"), *(pa.array(x, t) for x, t in zip(out, kinds))], names=["doc_id", "rest", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])

    return run


def repeated_passages(spark: SparkSession, docs: DataFrame, length: int = LENGTH, with_text: bool = True, hot: int = HOT, characters: bool = False) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, rest (the other columns), n_bytes, n_removed,
    n_spans, kept_sha256, spans, kept (bytes that stay, if with_text; if
    characters, without those of characters that are cut, which all else still counts)."""
    if length < GRAM:
        raise ValueError(f"length must be {GRAM} at least")
    rest = [quoted(c) for c in docs.columns if c not in ("doc_id", "text")]
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), (F.struct(*rest) if rest else F.struct(F.lit(0).alias("none"))).alias("rest"))
    every = every.withColumn("tag", F.xxhash64("text", F.lit(3)))
    own, n = ["doc_id", "tag"], int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = bucketed(spark, every.where("doc_id IS NOT NULL"), n, own, "passage-texts")

    phrases = written(spark, texts.select("doc_id", "tag", "text").mapInArrow(phrase_rows(length), "doc_id long, tag long, at array<int>, h1 long, h2 long"), "passage-phrases")
    later = phrases.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
    later = written(spark, later, "passage-later")  # read again, so that the join deals both sides by itself and can split a phrase that many documents hold
    repeated = phrases.join(later, ["h1", "h2"]).where("doc_id > first").groupBy(*own).agg(F.flatten(F.collect_list("at")).alias("repeated"))
    repeated = written(spark, repeated, "passage-repeated")
    dropped(spark, phrases)
    dropped(spark, later)
    parsed = texts.join(repeated.hint("shuffle_hash"), own, "left")

    keys = parsed.select("doc_id", "text", "repeated").mapInArrow(key_rows(length), "key long, doc_id long")
    keys = written(spark, keys.repartition("key").mapInArrow(shared_keys(hot), "key long, doc_id long, hot boolean"), "passage-keys")

    def stretches(some: DataFrame) -> DataFrame:
        lists = some.groupBy("doc_id").agg(F.collect_list("key").alias("keys"))
        lists = texts.select(*own).distinct().join(lists, "doc_id").hint("shuffle_hash")
        return parsed.join(lists, own).select(*own, "text", "repeated", "keys").mapInArrow(stretch_rows(length), "key long, doc_id long, tag long, at int, stretch binary")

    kind = "doc_id long, tag long, run long"
    runs = stretches(keys.where("NOT hot")).repartition("key").mapInArrow(resolved(length), kind)
    if keys.where("hot").limit(1).count():
        split = written(spark, stretches(keys.where("hot")).withColumn("s1", F.xxhash64("stretch")).withColumn("s2", F.xxhash64("stretch", F.lit(1))), "passage-stretches")
        found = split.groupBy("key", "stretch", "s1", "s2").agg(F.min("doc_id").alias("first")).repartition("key").mapInArrow(distinct_resolved(length), "s1 long, s2 long, sizes array<int>, least array<long>")
        runs = runs.union(split.select(*own, "at", "s1", "s2").join(found, ["s1", "s2"]).select(*own, "at", "sizes", "least").mapInArrow(removed_runs, kind))
    runs = written(spark, runs.groupBy(*own).agg(F.collect_list("run").alias("runs")), "passage-runs")
    dropped(spark, keys)

    schema = StructType().add("doc_id", "long").add("rest", texts.schema["rest"].dataType)
    schema = StructType([*schema, *StructType.fromDDL("n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>, kept binary")])
    whole = parsed.join(runs.hint("shuffle_hash"), own, "left").select("doc_id", "text", "rest", "repeated", "runs")
    nameless = every.where("doc_id IS NULL").select("doc_id", "text", "rest", F.lit(None).cast("array<int>").alias("repeated"), F.lit(None).cast("array<long>").alias("runs"))
    return whole.mapInArrow(applied(length, with_text, characters), schema).union(nameless.mapInArrow(applied(length, with_text, characters), schema))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return repeated_passages(spark, docs, with_text=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
