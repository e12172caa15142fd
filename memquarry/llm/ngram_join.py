"""N-gram Jaccard join: near-duplicate classes of documents by a prefix-tree join.

1. Global order. Every shingle goes, with the sets of a task that hold it, to the task
   of its range of hash values, which counts the distinct sets that hold it; the
   shingles that several hold go back to their sets with this count. A shingle that HOT
   sets of one task hold sends its sets nowhere: only its counts are added up, and it
   comes after all others. The order is by count, then by hash: the rarest first.
2. Candidates, without losing a pair: of n shingles similar sets share ceil(t n) at
   least, so they share one of the n - ceil(t n) + 1 first of either. Shingles of one
   set only come first and are never sent back; a set of which too few came back has no
   partner. Equal (size class, shingle of a prefix) are shared by every similar pair.
   Signatures are made distinct in each partition before they are shuffled, so that a
   group of copies sends a row a partition.
3. Connected components of documents with an equal signature are the candidate
   groups; documents with equal sets are one member of them.
4. Prefix-tree join inside a group: sets, globally ordered with the rarest first,
   form a trie with compressed runs; one traversal carries the partial overlaps of
   all sets and drops, at each run, those that the remaining lengths, or a component
   already joined, rule out for the subtree. Groups above BLOCK
   members or SHINGLES shingles are split by size class and joined block by block, each with the group's least member; only members
   that this leaves apart from it meet all other blocks.
5. Components of the links.

Cases: null or wordless text has an empty set and no link; a null doc_id is kept,
with a null component; rows that repeat a doc_id are one node; equal texts always
link; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import M1, byte_view, connected_components, dropped, forest, mix, relieved, slices, small, table, written

NGRAM, PERCENT = 5, 80
#: Members of a group that one task joins; shingles, and hashes of sets, held before they are sent.
BLOCK, HELD, SEEN = 2000, 1_000_000, 150_000
#: Sets of a task that make a shingle hot; the weight that puts hot ones after all others.
HOT, FREQUENT = 64, 1 << 50
#: What tells distinct sets apart.
SET = ["s", "h2", "n"]
#: Shingles of the members that one task joins; a group of long documents is split by it.
SHINGLES = 2_000_000
#: Ratio of the sizes at the ends of a size class.
CLASS = 0.7
#: Tokens of a run that are counted at once.
STEP = 64

_letters = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_letters[65:91] = _letters[97:123]  # A-Z are lower-cased
_space = np.zeros(256, bool)
_space[[0x20, *range(0x09, 0x0E)]] = True
_base = 0x100000001B3 * 2 + 1
_inverse = pow(_base, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


def shingles(data: np.ndarray, offsets: np.ndarray, ngram: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of every text."""
    n = len(offsets) - 1
    empty = np.zeros(0, np.uint64)
    if not len(data):
        return [empty] * n
    space = _space[data]
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = space[1:] != space[:-1]
    edge[offsets] = True
    at = np.flatnonzero(edge)
    starts, ends = at[:-1], at[1:]
    word = ~space[starts]
    starts, ends = starts[word], ends[word]
    with np.errstate(over="ignore"):
        h = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_letters[data] * _powers(_base, len(data)), out=h[1:])
        w = mix((h[ends] - h[starts]) * _powers(_inverse, len(data))[starts])
        of = np.searchsorted(starts, offsets)
        size = max(len(w) - ngram + 1, 0)
        roll = np.zeros(size, np.uint64)
        for i in range(ngram):
            roll = (roll + w[i : i + size]) * M1
            roll ^= roll >> np.uint64(29)
        roll, out = mix(roll), []
        for a, b in zip(of[:-1].tolist(), of[1:].tolist()):
            if b - a >= ngram:
                s = np.sort(roll[a : b - ngram + 1])
                out.append(s[np.r_[True, s[1:] != s[:-1]]])
            elif b > a:
                x = np.zeros(1, np.uint64) + np.uint64(b - a)
                for i in range(a, b):
                    x = (x + w[i]) * M1
                    x ^= x >> np.uint64(29)
                out.append(mix(x ^ np.uint64(0x5555)))
            else:
                out.append(empty)
    return out


class Sizes:
    """The least sizes of size classes: similar sets share the class of the smaller one, which is its own or the one below for either."""

    def __init__(self):
        lows = [1]
        while lows[-1] < 1 << 40:
            lows.append(max(lows[-1] + 1, math.ceil(lows[-1] / CLASS)))
        self.lows = np.array(lows)


#: Kinds of rows: a document; shingles and the sets that hold them; shingles that many sets
#: of a task hold (HOT_SETS: with the sets, MARK: without); sets and the shingles that they share.
DOC, HELD_BY, HOT_SETS, MARK, SHARED = range(5)
_binaries = ("tokens", "weights", "sets", "sizes", "counts")
_kinds = "kind byte, key long, doc_id long, s long, h2 long, n long, " + ", ".join(f"{c} binary" for c in _binaries)
_fields = pa.schema([("kind", pa.int8()), *((c, pa.int64()) for c in ("key", "doc_id", "s", "h2", "n")), *((c, pa.binary()) for c in _binaries)])


def _batch(kind: int, size: int, **columns):
    full = {f.name: columns.get(f.name) for f in _fields}
    full["kind"] = np.full(size, kind, np.int8)
    return pa.record_batch([pa.nulls(size, f.type) if full[f.name] is None else pa.array(full[f.name], f.type) for f in _fields], schema=_fields)


def planes(x: np.ndarray) -> bytes:
    """All first bytes, then all second ones: those of sorted or small numbers compress well."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes()


def unplaned(x: bytes, kind) -> np.ndarray:
    return np.frombuffer(x, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).reshape(-1)


def limits(buckets: int) -> np.ndarray:
    """Where hash ranges of equal width, but the first, begin."""
    return np.array([-(-(b << 32) // buckets) << 32 for b in range(1, buckets)], np.uint64)


def _cut(x: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, begin, end) of the ranges that sorted hashes x fall into."""
    cut = np.r_[0, np.searchsorted(x, bounds), len(x)].tolist()
    return [(b, i, j) for b, (i, j) in enumerate(zip(cut[:-1], cut[1:])) if j > i]


def _shared(s: np.ndarray, n: np.ndarray, t: np.ndarray, w: np.ndarray, bounds: np.ndarray):
    """Rows by range of sets: sets s of n shingles with shingles t and the weights of these."""
    order = np.argsort(s, kind="stable")
    s, n, t, w = s[order], n[order], t[order], w[order]
    ranges = _cut(s, bounds)
    for i in range(0, len(ranges), 64):
        out = []
        for _, a, b in ranges[i : i + 64]:
            first = np.flatnonzero(np.r_[True, s[a + 1 : b] != s[a : b - 1]])
            out.append((planes(t[a:b]), planes(w[a:b]), planes(s[a:b][first]), planes(n[a:b][first]), planes(np.diff(np.r_[first, b - a]).astype(np.uint32))))
        yield _batch(SHARED, len(out), key=[b for b, _, _ in ranges[i : i + 64]], **dict(zip(_binaries, map(list, zip(*out)))))


def shingle_rows(ngram: int, buckets: int, hot: int):
    bounds = limits(buckets)

    def flush(sets: dict):
        s, n = np.fromiter(sets, np.int64, len(sets)), np.array(list(map(len, sets.values())))
        of = np.repeat(np.arange(len(sets), dtype=np.uint32), n)
        t = np.concatenate(list(sets.values()))
        order = np.argsort(t, kind="stable")
        t, of = t[order], of[order]
        first = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
        count = np.diff(np.r_[first, len(t)])
        many = count >= hot
        if many.any():
            at, size, key = first[many], count[many], t[first[many]]
            held = [of[a : a + c] for a, c in zip(at.tolist(), size.tolist())]
            yield _batch(HOT_SETS, len(at), key=key.view(np.int64), n=size, sets=[s[x].tobytes() for x in held], sizes=[n[x].tobytes() for x in held])
            ranges = _cut(key, bounds)
            yield _batch(MARK, len(ranges), key=[b for b, _, _ in ranges], tokens=[key[i:j].tobytes() for _, i, j in ranges], weights=[size[i:j].tobytes() for _, i, j in ranges])
            few = ~np.repeat(many, count)
            t, of = t[few], of[few]
        ranges = _cut(t, bounds)
        for i in range(0, len(ranges), 64):
            out = []
            for _, a, b in ranges[i : i + 64]:
                x, y = np.unique(of[a:b], return_inverse=True)
                out.append((planes(t[a:b]), planes(y.astype(np.uint32)), planes(s[x]), planes(n[x])))
            yield _batch(HELD_BY, len(out), key=[b for b, _, _ in ranges[i : i + 64]], **dict(zip(_binaries, map(list, zip(*out)))))

    def run(batches):
        sets, seen, held, row = {}, set(), 0, 0
        for batch in slices(batches):
            found = shingles(*byte_view(batch.column("text")), ngram)
            s = np.array([x.sum() for x in found], np.uint64).view(np.int64)
            h2 = np.array([mix(x ^ M1).sum() for x in found], np.uint64).view(np.int64)
            n = np.array(list(map(len, found)), np.int64)
            ids = batch.column("doc_id")
            yield _batch(DOC, len(n), key=pc.fill_null(ids, row), doc_id=ids, s=s, h2=h2, n=n)
            row += 1
            for d, k, x in zip(ids.to_pylist(), s.tolist(), found):
                if len(x) and d is not None and k not in seen:
                    if len(seen) < SEEN:
                        seen.add(k)
                    if k not in sets:
                        sets[k] = x
                        held += len(x)
            if held > HELD:
                yield from flush(sets)
                sets, held = {}, 0
        if sets:
            yield from flush(sets)

    return run


def shared_rows(buckets: int):
    """Of the rows of a partition by key: documents and HOT_SETS as they are; of each range of shingles those that several sets hold."""
    bounds = limits(buckets)

    def resolved(blocks, marks):
        t, s, n = [], [], []
        for x, y, z, size in blocks:
            at = unplaned(y, np.uint32)
            t.append(unplaned(x, np.uint64))
            s.append(unplaned(z, np.uint64)[at])
            n.append(unplaned(size, np.int64)[at])
        t, s, n = np.concatenate(t), np.concatenate(s), np.concatenate(n)
        order = np.argsort(t, kind="stable")
        t, s, n = t[order], s[order], n[order]
        same = t[1:] == t[:-1]
        several = np.zeros(len(t), bool)
        several[1:] |= same
        several[:-1] |= same
        if marks:
            mark, at = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x, _ in marks]), return_inverse=True)
            count = np.bincount(at, np.concatenate([np.frombuffer(y, np.int64) for _, y in marks])).astype(np.int64)
            several |= np.isin(t, mark)
        t, s, n = t[several], s[several], n[several]
        if not len(t):
            return
        order = np.lexsort((n, s, t))
        t, s, n = t[order], s[order], n[order]
        new = np.r_[True, (t[1:] != t[:-1]) | (s[1:] != s[:-1])]
        t, s, n = t[new], s[new], n[new]
        first = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
        size = np.diff(np.r_[first, len(t)])
        w = np.repeat(size, size)
        if marks:
            at = np.minimum(np.searchsorted(mark, t), len(mark) - 1)
            w = np.where(mark[at] == t, FREQUENT + count[at], w)
        some = w > 1
        yield s[some], n[some], t[some], w[some]

    def run(batches):
        blocks, marks = {}, {}
        for b in batches:
            kind = b.column("kind").to_numpy()
            passed = (kind == DOC) | (kind == HOT_SETS)
            if passed.any():
                yield b.filter(pa.array(passed))
            b = b.filter(pa.array(~passed)).select(["kind", "key", *_binaries[:4]])
            for k, key, *x in zip(*(c.to_pylist() for c in b.columns)):
                (marks if k == MARK else blocks).setdefault(key, []).append(x[:2] if k == MARK else x)
        found, held = [], 0
        for key in list(blocks):
            for x in resolved(blocks.pop(key), marks.get(key)):
                found.append(x)
                held += len(x[0])
            if held > HELD:
                yield from _shared(*map(np.concatenate, zip(*found)), bounds)
                found, held = [], 0
        if found:
            yield from _shared(*map(np.concatenate, zip(*found)), bounds)
        relieved()

    return run


def hot_shared(buckets: int):
    """(key, sets, sizes, total): shingles that many sets of a task hold -> rows of these sets."""
    bounds = limits(buckets)

    def run(batches):
        for b in batches:
            (s, cut), (n, _) = byte_view(b.column("sets")), byte_view(b.column("sizes"))
            size = np.diff(cut) // 8
            yield from _shared(s.view(np.uint64), n.view(np.int64), np.repeat(b.column("key").to_numpy(), size).view(np.uint64), np.repeat(FREQUENT + b.column("total").to_numpy(), size), bounds)

    return run


_pair_fields = pa.schema([("kind", pa.int8()), ("key", pa.int64()), ("u", pa.int64()), ("v", pa.int64())])
_pairs = "kind byte, key long, u long, v long"
#: Kinds of rows: a signature of a document u, a candidate pair.
PRINT, PAIR = 0, 1


def _least(key: np.ndarray, doc: np.ndarray):
    """Signatures (key, least doc) once a key, and pairs (doc, least doc) of the others."""
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    first = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
    low = doc[np.flatnonzero(first)[np.cumsum(first) - 1]] if len(key) else doc
    other = ~first & (doc != low)
    return key[first], doc[first], *forest(doc[other], low[other])


def _pair_rows(kind: int, key, u, v, size: int = 100_000):
    for i in range(0, len(key), size):
        a = slice(i, i + size)
        yield pa.record_batch([pa.array(np.full(len(key[a]), kind, np.int8)), *(pa.array(x[a], pa.int64()) for x in (key, u, v))], schema=_pair_fields)


def prefix_rows(percent: int):
    """All rows of ranges of sets -> signatures (key, set), one for each shingle of a prefix and size class."""

    def prefixes(rows: list, sizes: Sizes):
        s, n, t, w = [], [], [], []
        for x, y, z, size, count in rows:
            count = unplaned(count, np.uint32)
            s.append(np.repeat(unplaned(z, np.int64), count))
            n.append(np.repeat(unplaned(size, np.int64), count))
            t.append(unplaned(x, np.uint64))
            w.append(unplaned(y, np.int64))
        s, n, t, w = map(np.concatenate, (s, n, t, w))
        order = np.lexsort((t, w, s))
        s, n, t = s[order], n[order], t[order]
        new = np.r_[True, (t[1:] != t[:-1]) | (s[1:] != s[:-1])]  # a shingle that is hot in several tasks comes from each
        s, n, t = s[new], n[new], t[new]
        first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        size = np.diff(np.r_[first, len(s)])
        need = size - -(-np.minimum.reduceat(n, first) * percent // 100) + 1
        inside = np.arange(len(s)) - np.repeat(first, size) < np.repeat(need, size)
        s, n, t = s[inside], n[inside], t[inside]
        own = np.searchsorted(sizes.lows, n, "right") - 1
        both = (own > 0) & (sizes.lows[own] - 1 >= -(-n * percent // 100))
        yield mix(t ^ mix(own.astype(np.uint64) + np.uint64(1))), s
        yield mix(t[both] ^ mix(own[both].astype(np.uint64))), s[both]

    def run(batches):
        sizes, ranges = Sizes(), {}
        for b in batches:
            for key, *x in zip(*(b.column(c).to_pylist() for c in ("key", *_binaries))):
                ranges.setdefault(key, []).append(x)
        keys, owners, held = [], [], 0
        for key in list(ranges):
            for k, s in prefixes(ranges.pop(key), sizes):
                keys.append(k)
                owners.append(s)
                held += len(k)
            if held > HELD or not ranges:
                k, s, u, v = _least(np.concatenate(keys).view(np.int64), np.concatenate(owners))
                yield from _pair_rows(PRINT, k, s, s)
                yield from _pair_rows(PAIR, u, u, v)
                keys, owners, held = [], [], 0
        relieved()

    return run


def candidate_rows(batches):
    """Of the rows of a partition by key: pairs as they are, and signatures of several documents as pairs."""
    keys, docs = [], []
    for b in batches:
        kind = b.column("kind").to_numpy()
        if (kind == PAIR).any():
            yield b.filter(pa.array(kind == PAIR))
        p = pa.array(kind == PRINT)
        keys.append(b.column("key").filter(p).to_numpy(zero_copy_only=False))
        docs.append(b.column("u").filter(p).to_numpy(zero_copy_only=False))
    if keys:
        _, _, u, v = _least(np.concatenate(keys), np.concatenate(docs))
        yield from _pair_rows(PAIR, u, u, v)


def candidates(spark: SparkSession, docs: DataFrame, ngram: int, percent: int, hot: int = HOT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(own, sets, pairs): every document with the size and hashes of its set, the
    distinct sets with their least document (member), and candidate pairs of sets
    that join all similar ones."""
    buckets = 3 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.mapInArrow(shingle_rows(ngram, buckets, hot), _kinds).repartition("key").mapInArrow(shared_rows(buckets), _kinds)
    rows = written(spark, rows, "ngram-shared")
    own = written(spark, rows.where(f"kind = {DOC}").select("doc_id", "n", "s", "h2"), "ngram-own")
    sets = written(spark, own.where("n > 0 AND doc_id IS NOT NULL").groupBy(*SET).agg(F.min("doc_id").alias("member"), F.count("*").alias("copies")), "ngram-sets")
    shared, frequent = rows.where(f"kind = {SHARED}").select("key", *_binaries), rows.where(f"kind = {HOT_SETS}")
    if frequent.limit(1).count():
        totals = frequent.groupBy("key").agg(F.sum("n").alias("total"))
        more = frequent.select("key", "sets", "sizes").join(small(totals), "key").mapInArrow(hot_shared(buckets), _kinds)
        shared = shared.union(more.select("key", *_binaries))
    signatures = shared.repartition("key").mapInArrow(prefix_rows(percent), _pairs).repartition("key")
    pairs = written(spark, signatures.mapInArrow(candidate_rows, _pairs).select("u", "v"), "ngram-candidates")
    dropped(spark, rows)
    return own, sets, pairs


class Node:
    __slots__ = ("run", "children", "ends", "low", "high", "one")

    def __init__(self, run):
        self.run, self.children, self.ends, self.low, self.high, self.one = run, {}, [], 1 << 60, 0, None


class Trie:
    """A prefix tree of ordered sets with compressed runs; low and high: sizes of the sets below."""

    def __init__(self):
        self.root = Node(np.zeros(0, np.int64))

    def add(self, s: np.ndarray, i: int) -> int | None:
        """Index of an equal set that is there already, or None."""
        node, at, n = self.root, 0, len(s)
        while True:
            node.low, node.high = min(node.low, n), max(node.high, n)
            if at == n:
                node.ends.append(i)
                return node.ends[0] if len(node.ends) > 1 else None
            child = node.children.get(int(s[at]))
            if child is None:
                node.children[int(s[at])] = child = Node(s[at:])
                child.low = child.high = n
                child.ends.append(i)
                return None
            m = min(len(child.run), n - at)
            differ = np.flatnonzero(child.run[:m] != s[at : at + m])
            k = int(differ[0]) if len(differ) else m
            if k < len(child.run):
                upper = Node(child.run[:k])
                upper.low, upper.high = child.low, child.high
                child.run = child.run[k:]
                upper.children[int(child.run[0])] = child
                node.children[int(s[at])] = upper
                child = upper
            node, at = child, at + k


def trie_links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links (i, j) that join all sets with 100 * shared >= percent * united; links
    between sets that are joined already are left out."""
    n = len(sets)
    sizes = np.array(list(map(len, sets)), np.int64)
    root, links = np.arange(n), []

    def join(i: int, j: int) -> None:
        a, b = sorted((root[i], root[j]))
        if a != b:
            root[root == b] = a
            links.append((int(i), int(j)))

    owner = np.repeat(np.arange(n, dtype=np.int32), sizes)
    every = np.concatenate(sets)
    by_value = np.argsort(every, kind="stable")
    every = every[by_value]
    first = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])
    count = np.diff(np.r_[first, len(every)])
    del every
    token = first  # distinct shingles, by value
    order = np.argsort(count, kind="stable").astype(np.int32)  # the rarest first, ties by value
    places = np.empty(len(token), np.int32)
    places[order] = np.arange(len(token), dtype=np.int32)
    rank = np.empty(len(owner), np.int32)
    rank[by_value] = np.repeat(places, count)
    del by_value
    keys = owner.astype(np.int64)
    keys *= len(token)
    keys += rank
    keys.sort()  # all sets, one after the other, in the global order
    starts = np.cumsum(sizes) - sizes
    holders, ends = owner[np.argsort(rank, kind="stable")], np.r_[0, np.cumsum(count[order])]
    del owner, rank, places
    trie = Trie()
    for i in range(n):
        if (j := trie.add(keys[starts[i] : starts[i] + sizes[i]] - i * len(token), i)) is not None:
            join(j, i)
    stack = [(trie.root, np.arange(n), np.zeros(n, np.int64), 0)]
    while stack:
        node, active, shared, depth = stack.pop()
        if node.one is None:
            if not node.children:
                node.one = node.ends[0]
            elif all(c.one is not None for c in node.children.values()):
                below = [c.one for c in node.children.values()] + node.ends[:1]
                if (root[below] == root[below[0]]).all():
                    node.one = below[0]
        if node.one is not None:
            apart = root[active] != root[node.one]
            active, shared = active[apart], shared[apart]
        for at in range(0, len(node.run), STEP):
            if not len(active):
                break
            run = node.run[at : at + STEP]
            some = run[ends[run + 1] - ends[run] > 1]
            if len(some):
                shared = shared + np.bincount(np.concatenate([holders[ends[t] : ends[t + 1]] for t in some.tolist()]), minlength=n)[active]
            depth += len(run)
            left = sizes[active] - (np.searchsorted(keys, active * len(token) + run[-1], "right") - starts[active])
            most = shared + np.minimum(left, node.high - depth)
            may = 100 * most >= percent * (sizes[active] + np.maximum(node.low, most) - most)
            active, shared = active[may], shared[may]
        if not len(active):
            continue
        if node.ends:
            for i in active[100 * shared >= percent * (sizes[active] + sizes[node.ends[0]] - shared)]:
                join(i, node.ends[0])
        stack.extend((c, active, shared, depth) for c in node.children.values())
    return links


def joined(ngram: int, percent: int):
    def run(rows):
        doc, sets = rows["doc_id"].to_numpy(), []
        for part in rows.to_batches():
            for piece in slices([part]):
                sets += shingles(*byte_view(piece.column("text")), ngram)
        order = np.argsort(doc, kind="stable")
        order = [i for i in order if len(sets[i])]
        links = trie_links([sets[i] for i in order], percent) if len(order) > 1 else []
        u, v = np.array([doc[order[i]] for i, _ in links], np.int64), np.array([doc[order[j]] for _, j in links], np.int64)
        return pa.table({"u": u, "v": v})

    return run


def ngram_classes(spark: SparkSession, docs: DataFrame, ngram: int = NGRAM, percent: int = PERCENT, block: int = BLOCK, shingles: int = SHINGLES, hot: int = HOT) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    own, sets, pairs = candidates(spark, docs, ngram, percent, hot)
    groups = connected_components(spark, pairs)
    members = written(spark, sets.join(small(groups.withColumnRenamed("id", "s")), "s").select("component", "member", "n"), "ngram-members")
    copies = own.join(sets.where("copies > 1"), SET).where("doc_id <> member").select(F.col("doc_id").alias("u"), F.col("member").alias("v"))
    sizes = members.groupBy("component").agg(F.count("*").alias("size"), F.sum("n").alias("weight")).where("size > 1")
    # a group above `block` members or `shingles` shingles is split by size class first: similar sets share the class of the smaller one
    level = lambda n: F.floor(F.log(n) / -math.log(CLASS))
    least_partner = F.floor((F.col("n") * percent + 99) / 100)
    split = members.join(small(sizes), "component").withColumn("class", F.explode(F.when((F.col("size") > block) | (F.col("weight") > shingles), F.sequence(level(least_partner), level(F.col("n")))).otherwise(F.array(F.lit(-1).cast("long")))))
    members = written(spark, split.select(F.when(F.col("class") < 0, F.col("component")).otherwise(F.xxhash64("component", "class")).alias("component"), "member", "n"), "ngram-split")
    sizes = members.groupBy("component").agg(F.count("*").alias("size"), F.sum("n").alias("weight"), F.min("member").alias("hub")).where("size > 1")
    # blocks of a group: one, or as many as keep to `block` members and `shingles` shingles, each with the hub
    blocks = lambda n, weight: F.ceil(F.greatest(n / block, weight / shingles))
    dealt = members.join(small(sizes), "component").withColumn("blocks", blocks(F.col("size"), F.col("weight"))).withColumn("block", F.pmod(F.xxhash64("member"), "blocks"))
    everywhere = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    dealt = written(spark, dealt.select(F.col("member").alias("doc_id"), "component", "hub", "blocks", "block", "n"), "ngram-dealt")
    schema = "u long, v long"
    first = dealt.select("doc_id", "component", F.explode(F.when(F.col("doc_id") == F.col("hub"), everywhere).otherwise(F.array("block"))).alias("block")).distinct()
    links = docs.join(small(first), "doc_id").groupBy("component", "block").applyInArrow(joined(ngram, percent), schema)
    links = written(spark, links.union(copies), "ngram-links")
    classes = connected_components(spark, links)
    large = dealt.where("blocks > 1")
    if large.limit(1).count():
        named = large.join(classes.select(F.col("id").alias("doc_id"), F.col("component").alias("class")), "doc_id", "left").withColumn("class", F.coalesce("class", "doc_id"))
        hubs = named.where("doc_id = hub").select("component", F.col("class").alias("hub_class"))
        apart = named.join(hubs, "component").where("class <> hub_class").select("doc_id", "component", "blocks", "block", "n")
        chunks = apart.groupBy("component").agg(blocks(F.count("*"), F.sum("n")).alias("chunks"))
        apart = apart.join(chunks, "component").withColumn("chunk", F.pmod(F.xxhash64("doc_id", F.lit(1)), "chunks"))
        second = apart.select("doc_id", "component", F.explode(everywhere).alias("block"), "chunk")
        second = second.union(large.join(chunks, "component").select("doc_id", "component", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"))).distinct()
        more = docs.join(small(second), "doc_id").groupBy("component", "block", "chunk").applyInArrow(joined(ngram, percent), schema)
        classes = connected_components(spark, links.union(more))
    classes = small(classes.select(F.col("id").alias("doc_id"), "component"))
    return own.join(classes, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_classes(spark, table(spark, sf_dir, "documents"), ngram=4, percent=85)
