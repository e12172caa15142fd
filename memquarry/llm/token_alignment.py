"""Alignment of two tokenizers' tokens by windows between white space.

A is a byte-level BPE over a blank and the text, B a piece BPE, which adds the blank. Neither
has a token over the beginning of a word that stands behind one blank or behind line ends
(A by its pattern, B where its vocabulary shows it), so that both begin a token there and
the ids on either side don't depend on the other. Such places cut a text into windows;
windows that are new to a batch are tokenised and aligned together, as lines of many, and
remembered (bounded). A text with any other white space at the edge of a window, or that
isn't given back, is tokenised and aligned as a whole. Documents count as holding a pair of ids once; pairs are counted in each
task before they are shuffled, as a pair of common words is in nearly every document.

Of the counted pairs those with at least 1/PAIRS of all (document, pair) rows are at most
PAIRS and are broadcast; rarer ones are joined by shuffle, where none can be a hot key.

Cases: texts that are null, empty or not given back by the tokens of both have no tokens
and count zero everywhere, with '' for the hash; texts of any length and windows of any
length are handled (long windows aren't remembered); repeated rows and
null doc_ids are documents of their own; empty tables give no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CACHES, slices, small, table, written
from .token_counts import PATTERN, byte_letters

#: Pairs that are broadcast at most.
PAIRS = 400_000
#: Windows of more characters aren't remembered; windows of a generation that are; characters of a line; (document, pair) entries gathered before they are counted.
LONG_WINDOW, REMEMBERED_WINDOWS, LINE, GATHERED = 40, 150_000, 2048, 2_000_000
MARK = "▁"
LINE_ENDS = re.compile("\n+")


def words(text: str) -> list[str]:
    """A text's windows, without the blank before each; those behind line ends begin with them."""
    return LINE_ENDS.sub(r" \g<0>", text).split(" ")


def cuts(word: str) -> bool:
    """Whether both tokenizers begin a token at this window and at the next: no other white space at its edges."""
    bare = word.lstrip("\n")
    return bool(bare) and not bare[0].isspace() and not bare[-1].isspace() and MARK not in bare


class Vocabulary:
    """ids -> bytes, as flat arrays: sizes, starts, data."""

    def __init__(self, tokens: list[bytes]):
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all ids in a row."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        return self.data[np.repeat(self.starts[ids] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


class Bytewise:
    """A: byte-level BPE from a tokenizers file. Where ids are in merge order the same merges
    run as ranks in the faster library; a text that one can't take goes to the other.
    `cuts`: the pattern alone divides a text, no normaliser or added token does."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = {letter: b for b, letter in enumerate(byte_letters())}
        added = {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        vocab = {i: bytes(map(byte.__getitem__, t)) for t, i in spec["model"]["vocab"].items() if i not in added}
        self.tokens = Vocabulary([added.get(i) or vocab.get(i, b"") for i in range(max([*vocab, *added]) + 1)])
        pre = spec.get("pre_tokenizer") or {}
        self.cuts = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer") and all(t["special"] for t in spec["added_tokens"])
        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = True
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        made = [spec["model"]["vocab"].get(a + b) for a, b in merges]
        self.fast = None
        if made == list(range(256, 256 + len(made))) and len(vocab) == 256 + len(made):
            import tiktoken

            self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks={t: i for i, t in vocab.items()}, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast:
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.int32)
            except BaseException as error:  # the library panics on runs of blanks that its pattern can't hold
                if type(error).__name__ != "PanicException" and not isinstance(error, (ValueError, RuntimeError)):
                    raise
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.int32)


class Pieces:
    """B: a sentencepiece model. `cuts`: no piece goes over a line end or, but for runs of blanks, a blank inside."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        ids = range(self.model.get_piece_size())
        self.tokens = Vocabulary([bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(MARK, " ").encode() for i in ids for p in (self.model.id_to_piece(i),)])
        self.cuts = not any("\n" in p or MARK in p[1:] and p.strip(MARK) for p in map(self.model.id_to_piece, ids))

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.int32) for ids in self.model.encode(texts, num_threads=1)]


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = Bytewise(path_a), Pieces(path_b)
        self.wide = len(self.b.tokens.sizes)
        # digits of all ids with what follows them: within a group, and at its end
        self.digits = [f"{i}{mark}" for n, marks in ((len(self.a.tokens.sizes), ",|"), (self.wide, ",;")) for mark in marks for i in range(n)]
        self.known: dict = {}
        self.old: dict = {}

    def aligned(self, a: np.ndarray, b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray) -> list[tuple[int, int, int, str, bytes]]:
        """Ids of windows in a row and the places where windows begin among them -> for each n_a, n_b, number
        of groups, their digits, and the code a * wide + b of each link in order (64 bits each)."""
        ends_a, ends_b = np.cumsum(self.a.tokens.sizes[a]), np.cumsum(self.b.tokens.sizes[b])
        at_a, at_b = np.zeros((2, ends_a[-1] + 1), bool)
        at_a[ends_a], at_b[ends_b] = True, True
        shared_a, shared_b = at_b[ends_a], at_a[ends_b]
        union = np.flatnonzero(at_a | at_b)  # between two ends lies one link
        of_a, of_b = (np.cumsum(x) - x for x in (at_a[union], at_b[union]))
        codes = (a[of_a].astype(np.int64) * self.wide + b[of_b]).tobytes()
        last_a, last_b = np.r_[first_a[1:], len(a)], np.r_[first_b[1:], len(b)]
        cut = [0, *(8 * np.searchsorted(union, ends_a[last_a - 1], "right")).tolist()]
        groups = np.cumsum(shared_a)
        # a group's tokens of A stand behind all tokens of groups before, those of B behind its tokens of A
        place_a = np.arange(len(a)) + np.r_[0, np.flatnonzero(shared_b) + 1][groups - shared_a]
        place_b = np.arange(len(b)) + (np.flatnonzero(shared_a) + 1)[np.cumsum(shared_b) - shared_b]
        n, letter = len(self.a.tokens.sizes), np.empty(len(a) + len(b), np.int64)
        letter[place_a], letter[place_b] = a + n * shared_a, 2 * n + b + self.wide * shared_b
        letters = [*map(self.digits.__getitem__, letter.tolist())]
        at = [0, *(last_a + last_b).tolist()]
        counts = (np.diff(x, prepend=0).tolist() for x in (last_a, last_b, groups[last_a - 1]))
        return [(x, y, c, "".join(letters[i:k])[:-1], codes[m:o]) for x, y, c, i, k, m, o in zip(*counts, at, at[1:], cut, cut[1:])]

    def whole(self, texts: list[str], cut=lambda k: ()) -> tuple[list[int], list[tuple]]:
        """The numbers of the texts that the tokens of both give back, and the alignments of their
        windows; cut(k): where, in bytes behind the added blank, windows of text k begin but for the first."""
        ids_a, ids_b = [self.a(" " + t) for t in texts], self.b(texts)
        raw = [b" " + t.encode() for t in texts]
        same = [k for k in range(len(texts)) if self.a.tokens.sizes[ids_a[k]].sum() == len(raw[k]) == self.b.tokens.sizes[ids_b[k]].sum()]
        if same:
            data, at = np.frombuffer(b"".join([raw[k] for k in same]), np.uint8), np.cumsum([0] + [len(raw[k]) for k in same])
            differ = (self.a.tokens.spelled(np.concatenate([ids_a[k] for k in same])) != data) | (self.b.tokens.spelled(np.concatenate([ids_b[k] for k in same])) != data)
            same = [k for k, bad in zip(same, np.logical_or.reduceat(differ, at[:-1])) if not bad]
        if not same:
            return [], []
        a, b = np.concatenate([ids_a[k] for k in same]), np.concatenate([ids_b[k] for k in same])
        starts_a, starts_b = (np.cumsum(n) - n for n in (self.a.tokens.sizes[a], self.b.tokens.sizes[b]))
        begin = np.cumsum([0] + [len(raw[k]) for k in same])
        begin = np.concatenate([np.r_[x, x + np.array(cut(k), np.int64)] for k, x in zip(same, begin.tolist())])
        return same, self.aligned(a, b, np.searchsorted(starts_a, begin), np.searchsorted(starts_b, begin))

    def fresh(self, new: list[str]) -> dict[str, tuple]:
        """Windows -> their alignments, tokenised together; each line begins with a window of its own, "a"."""
        # a line ends with the window that fills it
        first = [*np.unique(np.cumsum([0] + [len(w) + 1 for w in new])[:-1] // LINE, return_index=True)[1].tolist(), len(new)]
        parts = [[w if w[0] == "\n" else " " + w for w in new[i:k]] for i, k in zip(first, first[1:])]
        same, found = self.whole(["a" + "".join(part) for part in parts], lambda k: 2 + np.cumsum([0] + [len(w.encode()) for w in parts[k][:-1]]))
        out, at = {}, 0
        for k in same:
            out |= zip(new[first[k] : first[k + 1]], found[at + 1 : at + 1 + len(parts[k])])
            at += 1 + len(parts[k])
        return out

    def windows(self, wanted) -> dict[str, tuple]:
        """Alignments of those windows that can be cut out, remembered in two generations of bounded size."""
        known = self.known
        out = {w: x for w in wanted if (x := known.get(w))}
        rest = [w for w in wanted if w not in out]
        new = {w: x for w in rest if (x := self.old.get(w))}
        new |= self.fresh([w for w in rest if w not in new and cuts(w)])
        if len(known) + len(new) > REMEMBERED_WINDOWS:
            self.old, self.known = known, {}
        self.known.update((w, x) for w, x in new.items() if len(w) <= LONG_WINDOW)
        return out | new

    def documents(self, texts: list[str]):
        """For each text (n_a, n_b, n_groups, n_links, digits of the groups' hash, codes, times) or None without tokens."""
        out: list = [None] * len(texts)
        cut = [words(t) for t in texts] if self.a.cuts and self.b.cuts else [[""]] * len(texts)
        found = self.windows(dict.fromkeys(itertools.chain.from_iterable(cut)))
        number, entries = {w: i for i, w in enumerate(found)}, [*found.values()]
        of = {k: x for k, c in enumerate(cut) if None not in (x := [*map(number.get, c)])}
        rest = [k for k in range(len(texts)) if k not in of]
        same, found = self.whole([texts[k] for k in rest])
        for k, entry in zip(same, found):
            of[rest[k]] = [len(entries)]
            entries.append(entry)
        if not of:
            return out
        window = np.fromiter(itertools.chain.from_iterable(of.values()), np.int64)
        at = np.cumsum([0] + [len(x) for x in of.values()])
        sums = np.add.reduceat(np.array([e[:3] for e in entries])[window], at[:-1]).tolist()
        digits = [e[3] for e in entries]
        codes, times, each = self.distinct(window, at, [e[4] for e in entries])
        for (k, x), n, m, o in zip(of.items(), sums, each.tolist(), each[1:].tolist()):
            text = ";".join(map(digits.__getitem__, x))
            out[k] = *n, int(times[m:o].sum()), hashlib.sha256(text.encode()).hexdigest(), codes[m:o], times[m:o]
        return out

    def distinct(self, window: np.ndarray, of: np.ndarray, links: list[bytes]):
        """Windows, the places where documents begin among them and the links of each -> codes in
        documents, how often, and the places where documents begin among those."""
        size = np.array([len(x) // 8 for x in links])
        codes, number = np.unique(np.frombuffer(b"".join(links), np.int64), return_inverse=True)
        n = size[window]
        ends = np.cumsum(n)
        number = number[np.repeat((np.cumsum(size) - size)[window] - (ends - n), n) + np.arange(ends[-1])]
        number += np.repeat(np.arange(len(of) - 1), np.diff(np.r_[0, ends][of])) * len(codes)
        number, times = np.unique(number, return_counts=True)
        return codes[number % len(codes)], times, np.searchsorted(number, np.arange(len(of)) * len(codes))


_aligners: dict[tuple[str, str], Aligner] = {}
CACHES["alignment"] = _aligners.clear


def aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    return _aligners[path_a, path_b]


OWN = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes array<long>, times array<int>"


def document_rows(path_a: str, path_b: str):
    """mapInArrow: doc_id, text -> the columns of OWN."""

    def run(batches):
        for batch in slices(batches, 512 << 10, owner="alignment"):
            known = aligner(path_a, path_b)
            texts = batch.column("text").to_pylist()
            having = [i for i, t in enumerate(texts) if t]
            found: list = [None] * len(texts)
            for i, row in zip(having, known.documents([texts[i] for i in having])):
                found[i] = row
            rows = [f or (0, 0, 0, 0, "", (), ()) for f in found]
            columns = [pa.array([r[c] for r in rows], kind) for c, kind in enumerate((pa.int64(),) * 4 + (pa.string(),))]
            ends = pa.array(np.cumsum([0] + [len(r[5]) for r in rows]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, t), *(r[c] for r in rows)]).astype(t))) for c, t in ((5, np.int64), (6, np.int32))]
            yield pa.record_batch([batch.column("doc_id"), *columns, *lists], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "codes", "times"])

    return run


def counted(batches):
    """mapInArrow: codes -> code, n (documents that hold it), summed within a task as far as memory is bounded."""
    held: list = []
    room = 0

    def merged():
        codes, inverse = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
        return codes, np.bincount(inverse, np.concatenate([n for _, n in held]), len(codes)).astype(np.int64)

    def out(codes, n):
        for at in range(0, len(codes), 100_000):
            yield pa.record_batch({"code": pa.array(codes[at : at + 100_000]), "n": pa.array(n[at : at + 100_000])})

    for batch in batches:
        codes, n = np.unique(batch.column("codes").flatten().to_numpy(zero_copy_only=False), return_counts=True)
        held.append((codes, n))
        room += len(codes)
        if room > GATHERED:
            held = [merged()]
            room = len(held[0][0])
            if room > GATHERED // 2:
                yield from out(*held[0])
                held, room = [], 0
    if held:
        yield from out(*merged())


def align_tokens(spark: SparkSession, docs: DataFrame, path_a: str, path_b: str, pairs: int = PAIRS) -> tuple[DataFrame, DataFrame]:
    """docs(doc_id, text) -> (documents, pairs).

    documents: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.
    pairs: a, b, n (documents in which the two ids are linked), best (no other b has more with this a)."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(document_rows(path_a, path_b), OWN)
    rows = written(spark, rows.withColumn("key", F.monotonically_increasing_id()), "aligned")
    counts = rows.select("codes").mapInArrow(counted, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    wide = Pieces(path_b).model.get_piece_size()
    counts = written(spark, counts.withColumn("a", F.floor(F.col("code") / wide)), "aligned-counts")
    highest = small(counts.groupBy("a").agg(F.max("n").alias("highest")))
    table_ = written(spark, counts.join(highest, "a").select("code", "n", (F.col("n") == F.col("highest")).alias("best")), "aligned-pairs")
    links = rows.select("key", F.explode(F.arrays_zip("codes", "times")).alias("link")).select("key", F.col("link.codes").alias("code"), F.col("link.times").alias("times"))

    def sums(links: DataFrame, table_: DataFrame) -> DataFrame:
        return links.join(table_, "code").groupBy("key").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))

    distinct, total = table_.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if distinct <= pairs:
        out = sums(links, F.broadcast(table_))
    else:  # at most `pairs` of them can each have 1/pairs of all rows
        often = F.col("n") * pairs >= total
        common = F.broadcast(table_.where(often))
        out = sums(links, common).union(sums(links.join(common, "code", "left_anti"), table_.where(~often)))
        out = out.groupBy("key").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = {c: F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")}
    out = rows.drop("codes", "times").join(out, "key", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero["n_best"], zero["count_sum"], "groups_sha256")
    return out, table_.select(F.floor(F.col("code") / wide).cast("int").alias("a"), (F.col("code") % wide).cast("int").alias("b"), "n", "best")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of the table, tokens of byte_bpe_50k.json against those of piece_bpe_32k.model."""
    import public_tokenizers

    return align_tokens(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))[0]
