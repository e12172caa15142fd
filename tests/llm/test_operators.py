"""The training-data operators against brute force on small tables with nulls, empty
and long texts, ties, repeated rows, extra columns and no rows at all."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from memquarry.llm import common, embedding_dedup, language_id, mixing, ngram_join, packing, quality, suffix_dedup, token_counts, topk_search, toxicity

WORDS = "the of stone river Lamp été 東京 blue— run's 12 a!! <|endoftext|> don't x".split()
KIND = "doc_id long, text string, lang string, source string, size int, rank string, v array<int>, component string"


def texts(n=60, seed=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        t = " ".join(r.choice(WORDS) for _ in range(r.randint(0, 90)))
        out.append((i, t))
    for i in range(20):  # copies and near copies
        t = out[i][1]
        out.append((n + i, t if i % 3 else t + " and more", ))
        out.append((n + 20 + i, re.sub("river", "lake", t, count=1)))
    out += [(500, None), (501, ""), (502, " \n\t "), (503, "word " * 3000), (504, "y" * 9000), (505, "!!!")]
    return out


def frame(spark, rows):
    langs = ["en", "fr", None]
    return spark.createDataFrame([(d, t, langs[(d or 0) % 3], ["a", "b", None][(d or 0) % 3], 1, "x", [1], "y") for d, t in rows], KIND)


@pytest.fixture(scope="module")
def docs(spark):
    df = frame(spark, texts()).cache()
    yield df
    df.unpersist()


@pytest.fixture(scope="module")
def odd(spark):
    """A null id, and a row that is there twice."""
    return frame(spark, [*texts(8), (None, "the of stone river the of stone river the of stone river"), (3, texts(8)[3][1])])


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, texts(1)).where("doc_id < 0")


def brute_classes(rows, n, percent):
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    parent = {d: d for d in sets}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


@pytest.mark.parametrize("n, percent, block, shingles, hot", [(4, 85, 2000, 2_000_000, 64), (2, 60, 3, 2_000_000, 3), (2, 60, 2000, 40, 64)])
def test_ngram_join(spark, docs, n, percent, block, shingles, hot):
    expect = brute_classes(texts(), n, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_classes(spark, docs, n, percent, block, shingles, hot).collect()}
    assert got == expect


def test_ngram_join_odd(spark, odd, none):
    got = ngram_join.ngram_classes(spark, odd).collect()
    assert len(got) == odd.count() and [r.component_id for r in got if r.doc_id is None] == [None]
    assert ngram_join.ngram_classes(spark, none).count() == 0


def test_trie_links():
    r = random.Random(3)
    sets = [np.unique(np.array([r.randint(0, 40) for _ in range(r.randint(3, 30))], np.uint64)) for _ in range(80)]
    for percent in (50, 80):
        parent = list(range(80))

        def find(x):
            return x if parent[x] == x else find(parent[x])

        for i, j in ngram_join.trie_links(sets, percent):
            parent[find(j)] = find(i)
        for i in range(80):
            for j in range(i):
                a, b = set(sets[i].tolist()), set(sets[j].tolist())
                if 100 * len(a & b) >= percent * len(a | b):
                    assert find(i) == find(j)


def test_suffix_dedup(spark, docs, none):
    rows, length = texts(), 50
    first, expect = {}, {}
    for d, t in sorted(rows):
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            first.setdefault(b[i : i + length], d)
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < d:
                gone[i : i + length] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        expect[d] = (len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest(), kept)
    for hot in (2, 10_000):
        got = suffix_dedup.repeated_passages(spark, docs, hot=hot).collect()
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in got} == expect
        assert got[0].rest.component == "y"
    assert suffix_dedup.repeated_passages(spark, none).count() == 0


def test_suffix_dedup_odd(spark, odd):
    got = suffix_dedup.repeated_passages(spark, odd).collect()
    assert len(got) == odd.count() and [r.n_removed for r in got if r.doc_id is None] == [0]


def test_token_counts(spark, docs, odd, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(docs, path).collect()}
    for d, x in texts():
        n = len(t.encode(x or "", add_special_tokens=False).ids)
        assert got[d] == (len((x or "").encode()), n, n > 1024)
    count = token_counts.counter(path).text
    for x in ("  a  b\n\n c ", "\n\n\nx", "a \n b\t\tc   ", "日本 語\u3000テスト", "'s's ' s", "x\x1c y\x85z", " ", "a<|endoftext|> <|endoftext|>"):
        assert count(x) == len(t.encode(x, add_special_tokens=False).ids), repr(x)
    assert token_counts.token_counts(odd, path).count() == odd.count() and token_counts.token_counts(none, path).count() == 0


def test_packing(spark, docs, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    got = packing.pack_documents(spark, docs, path, 256).toPandas()
    for d, x in texts():
        ids = t.encode(x or "", add_special_tokens=False).ids + [0]
        mine = got[got.doc_id == d].sort_values("piece")
        assert list(mine.start) == list(range(0, len(ids), 256)) and mine.length.sum() == len(ids)
        assert list(mine.ids_crc32) == [zlib.crc32(np.array(ids[s : s + 256], "<u4").tobytes()) for s in mine.start]
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert list(s.offset) == list(np.cumsum(s.length) - s.length) and s.length.sum() <= 256
    assert got.sequence_id.nunique() <= np.ceil(got.length.sum() / 256) + 1
    assert packing.pack_documents(spark, none, path).count() == 0


def test_fullest():
    assert sum(x * n for x, n in packing.fullest({5: 2, 3: 3, 1: 1}, 14)) == 14
    assert packing.fullest({7: 1}, 5) == []
    rows = packing.plan(dict(collections.Counter([9, 9, 1, 1, 5, 5, 3, 7])), 10)
    assert rows[:, 0].tolist() == sorted(rows[:, 0].tolist())


def test_mixing(spark, docs, odd, none):
    got = mixing.mix(spark, mixing.sized(docs)).toPandas()
    assert len(got) == docs.count() and (got.taken <= 2 * got["size"]).all()
    assert abs(got.drop_duplicates("source").target.sum() - 1.5 * got["size"].sum()) < 1e-6
    for _, s in got.groupby("source", dropna=False):
        assert abs(s.taken.sum() - s.target.iloc[0]) <= max(3, 0.02 * s.target.iloc[0])
        assert s.target.iloc[0] <= 2 * s["size"].sum() + 1e-9
    again = mixing.mix(spark, mixing.sized(docs)).toPandas()
    assert sorted(zip(got.doc_id, got.taken)) == sorted(zip(again.doc_id, again.taken))
    assert mixing.mix(spark, mixing.sized(odd)).count() == odd.count() and mixing.mix(spark, mixing.sized(none)).count() == 0


def test_water_filling(spark):
    rows = spark.createDataFrame([(1, "a", 10), (2, "b", 100), (3, "c", 100), (4, None, 50)], "doc_id long, source string, size long")
    got = {r.source: r.target for r in mixing.targets(spark, rows).collect()}
    total, weight, cap = 1.5 * 260, {"a": 5, "b": 2, "c": 1, None: 5}, {"a": 20, "b": 200, "c": 200, None: 100}
    expect, full = {}, set()
    while True:
        rest = total - sum(cap[s] for s in full)
        w = sum(weight[s] for s in weight if s not in full)
        expect = {s: cap[s] if s in full else rest * weight[s] / w for s in weight}
        over = {s for s in weight if expect[s] > cap[s] + 1e-9}
        if not over:
            break
        full |= over
    assert got == pytest.approx(expect)


def test_topk(spark):
    r = np.random.default_rng(2)
    rows = [(i, [float(x) for x in r.normal(0, 1, 8)]) for i in range(300)] + [(300, None), (301, [None] * 8), (302, [float("nan")] * 8), (303, [0.0] * 8), (304, [1.0])]
    rows += [(i + 400, rows[i][1]) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = topk_search.quantised(df, "vec_id", "embedding", 64)
    got = [(x.query_id, x.rank, x.vec_id, x.score) for x in topk_search.topk(q.where("id % 20 = 0"), q, 20).collect()]
    v = {i: np.floor(64 * np.array(x, np.float32).astype(float)).astype(int) for i, x in rows if x is not None and all(y is not None and np.isfinite(y) for y in x)}
    expect = []
    for i in v:
        if i % 20 == 0:
            s = sorted((-int(v[i] @ v[j]), j) for j in v if j != i and len(v[j]) == len(v[i]))[:20]
            expect += [(i, k + 1, j, -x) for k, (x, j) in enumerate(s)]
    assert sorted(got) == sorted(expect)
    assert topk_search.topk(q.where("id < 0"), q.where("id < 0"), 5).count() == 0


def test_embeddings(spark):
    r = np.random.default_rng(4)
    centre = r.normal(0, 1, (20, 16))
    v = [centre[i % 20] + r.normal(0, 0.12, 16) for i in range(400)]
    rows = [(i, i % 3, [float(x) for x in np.float32(v[i])]) for i in range(400)]
    rows += [(1000 + i, rows[i][1], rows[i][2]) for i in range(30)] + [(2000, None, rows[0][2]), (2001, 0, None), (2002, 0, [0.0] * 16), (2003, 0, [float("inf")] * 16), (2004, 0, [None] * 16), (2005, 1, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumn("component", F.lit(1))
    good = [(i, k, np.array(x, float)) for i, k, x in rows if k is not None and x and len(x) == 16 and all(y is not None and np.isfinite(y) for y in x) and any(x)]
    links, parent = collections.Counter(), {i: i for i, _, _ in rows}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for i, k, x in good:
        for j, m, y in good:
            if i < j and k == m and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    for shard in (2048, 40):
        got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in embedding_dedup.embedding_classes(spark, df, shard=shard).collect()}
        assert got == {i: (links[i], find(i), find(i) == i) for i in parent}
    assert embedding_dedup.embedding_classes(spark, df.where("vec_id < 0")).count() == 0


def test_embedding_audit():
    """A beam that misses 10 of 100 partners among 1024 queries is widened, whatever the others found."""

    class Misses:
        v = np.eye(1024, dtype=np.float32)

        def descend(self, q, to):
            return np.zeros(len(q), int)

        def beam(self, q, entry, width, layer):
            node = np.where(q.any(1), q.argmax(1), -1)
            lost = (node < 0) | ((node < 10) & (width < 100))
            near, sims = np.full((len(q), width), -1), np.full((len(q), width), -2.0)
            near[:, 0], sims[:, 0] = np.where(lost, -1, node), np.where(lost, -2.0, 1.0)
            return near, sims

    q = np.zeros((1024, 1024), np.float32)
    q[np.arange(100) * 10 + 3, np.arange(100)] = 1
    a, b = embedding_dedup.hits(Misses(), q, np.arange(1024), 0.93)
    assert sorted(b) == list(range(100)) and (a == b * 10 + 3).all()


def test_embedding_sides(monkeypatch):
    """A pair that only one of two shards finds counts for both ends."""
    rows = [{"ids": np.array(i).tobytes(), "weights": np.array(w).tobytes(), "vectors": np.array(v, float).tobytes(), "levels": np.zeros(2, int).tobytes(), "lists": [], "entry": 0} for i, w, v in (([1, 2], [1, 3], [[1, 0], [0, 1]]), ([5, 6], [1, 2], [[0, 1.1], [1, 1]]))]
    monkeypatch.setattr(embedding_dedup, "hits", lambda g, q, ids, t: (np.array([1]), np.array([0])) if ids[0] == 1 else (np.zeros(0, int),) * 2)
    out = embedding_dedup.search(0.93)(None, pa.Table.from_pylist(rows)).to_pylist()
    assert sorted((r["kind"], r["a"], r["b"]) for r in out) == [(0, 2, 1), (0, 5, 3), (1, 5, 2)]


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randint(0, 400), r.randint(0, 400)) for _ in range(300)] + [(i, i + 1) for i in range(1000, 1060)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {x.id: x.component for x in common.connected_components(spark, spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


SF = "/root/testdata/sf0.01"


def test_language_id(spark, docs, none):
    assert sum(r.lang_pred == r.lang for r in language_id.op6_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").where("held_out").select("lang_pred", "lang").collect()) > 0.97 * 200
    model = language_id.train(docs, F.lit(True))
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(docs, model).collect()}
    assert all(got[d] == ("und", 0.0) for d in (500, 501, 502, 505)) and len(got) == docs.count()
    assert {p for p, _ in got.values()} <= {"en", "fr", "und"} and all(0 <= s <= 1 for _, s in got.values())
    assert language_id.predict(none, model).count() == 0 and language_id.train(none, F.lit(True)) is None
    assert {r.lang_pred for r in language_id.predict(docs, None).collect()} == {"und"}


@pytest.mark.parametrize("f, label, least", [(quality.op5_quality_classifier, "quality", 0.9), (toxicity.op3_toxicity, "toxic", 0.85)])
def test_classifiers(spark, f, label, least):
    got = f(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").select("score", "predicted", F.col(label).alias("y")).toPandas()
    assert ((got.score >= 0.3) == got.predicted.astype(bool)).all() and got.score.between(0, 1).all()
    pos, neg = got.score[got.y == 1].to_numpy(), got.score[got.y == 0].to_numpy()
    assert (pos[:, None] > neg[None]).mean() > least


def test_classifiers_odd(spark, docs, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (1, None, 1), (2, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")
    assert quality.quality(docs, labels, F.lit(True)).agg(F.min("score"), F.max("score")).first() == (0.99, 0.99)
    model = toxicity.train(spark, docs, labels, F.lit(True))
    got = toxicity.toxicity(odd, model)
    assert got.count() == odd.count() and got.where("score IS NULL").count() == 0
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    for d in (docs, odd, none):
        assert quality.quality(d, labels, F.lit(True)).where("score BETWEEN 0 AND 1").count() == d.count()
        assert toxicity.toxicity(d, toxicity.train(spark, docs, labels, F.lit(True))).where("score BETWEEN 0 AND 1").count() == d.count()


def test_forward_backward():
    """Marginals of a short chain against all its paths."""
    rng = np.random.default_rng(0)
    e, theta = rng.normal(size=5), rng.normal(size=5)
    t, total, one = theta[1:].reshape(2, 2), 0.0, np.zeros(5)
    for path in np.ndindex(*(2,) * 5):
        s = np.array(path)
        w = np.exp((e * s).sum() + theta[0] * s[0] + t[s[:-1], s[1:]].sum())
        total, one = total + w, one + w * s
    for piece in (256, 2, 1):
        p, _, z = toxicity.forward_backward(e, np.array([0]), np.array([5]), theta, piece)
        assert np.allclose(p, one / total) and np.isclose(z, np.log(total))


def test_forward_backward_long():
    """Chains of up to 5000 tokens, read in pieces, against the same read at one go."""
    rng = np.random.default_rng(1)
    lengths = np.array([1, 5000, 256, 257, 700, 3])
    e, theta = rng.normal(scale=3, size=lengths.sum()), rng.normal(size=5)
    starts = np.cumsum(lengths) - lengths
    p, pairs, z = toxicity.forward_backward(e, starts, lengths, theta, 10_000)
    q, others, y = toxicity.forward_backward(e, starts, lengths, theta)
    assert np.allclose(p, q) and np.allclose(pairs, others) and np.isclose(z, y)
    assert np.isclose(pairs.sum(), (lengths - 1).sum())


def test_toxicity_long_sentence(spark):
    """One text of 5000 words without a break: the words at its end count, and what is learned from is bounded."""
    rows = [(i, f"calm words here {'you idiot clown' if i % 2 else 'fine day'} . end") for i in range(80)]
    rows += [(100, "calm words here " * 1600 + "you idiot clown"), (101, "calm words here " * 1600 + "fine day")]
    docs = spark.createDataFrame(rows + rows[:40] * 3, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, toxic int")
    model = toxicity.train(spark, docs, labels, F.lit(True), sample=30, sentences=20, tokens=60)
    got = {r.doc_id: r for r in toxicity.toxicity(docs, model).collect()}
    assert got[100].spans and got[100].spans[-1].end == len(dict(rows)[100]) and not got[101].spans
    e = np.random.default_rng(2).normal(size=4803)
    assert [len(x) for x in toxicity.chains(np.isnan(e))] == [1, 1]


def test_least_hash():
    r, rows = random.Random(4), []
    kept = toxicity.LeastHash(5, 12)
    for i in range(100):
        rows.append((r.randint(0, 50), i, 0, r.randint(1, 4)))
        kept.add(rows[-1])
    rows.sort()
    expect = [x for x, total in zip(rows, np.cumsum([x[3] for x in rows])) if total <= 12][:5]
    assert kept.cut() == expect


def test_spans(spark):
    rows = [(i, f"calm words here {'you idiot clown' if i % 2 else 'fine day'} . end") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, toxicity.train(spark, docs, labels, F.lit(True))).collect()
    assert all(r.predicted == r.doc_id % 2 for r in got)
    assert all("idiot" in dict(rows)[r.doc_id][r.spans[0].start : r.spans[-1].end] for r in got if r.doc_id % 2)


# --- more of the odd cases, and the parts that only thresholds held so far -----------------


def test_packing_odd(spark, odd):
    """Null and repeated ids are packed as rows; repeated ids with other texts too."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    more = odd.select("doc_id", "text").union(spark.createDataFrame([(3, "another text"), (None, None), (None, "x y")], "doc_id long, text string"))
    got = packing.pack_documents(spark, more, path, capacity=16).toPandas()
    assert len(got[got.piece == 0]) == more.count()
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert list(s.offset) == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 16


def test_topk_odd(spark):
    """Null vectors and components take no part, repeated and null ids don't fail, ties go to the smaller id."""
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (None, [1.0, 0.0]), (5, [0.5, 0.0])]
    vectors = topk_search.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id", "embedding", 64)
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk_search.topk(vectors.where("id % 20 = 0"), vectors, 3).collect())
    assert got == [(0, 1, 1, 4096), (0, 2, 20, 4096), (0, 3, 20, 4096), (20, 1, 0, 4096), (20, 2, 1, 4096), (20, 3, 5, 2048)]


def test_quality_by_hand(spark):
    """Context vectors and pooling against loops over tokens."""
    texts_ = ["a b c a", "b c d", None, "", "a! b"]
    docs = spark.createDataFrame(list(enumerate(texts_)), "doc_id long, text string")
    got = quality.context_vectors(docs)
    place, sign = quality.index_vectors()
    total = np.zeros((quality.BUCKETS, quality.DIMS))
    bucket = lambda t: zlib.crc32(t.encode()) % quality.BUCKETS
    for t in texts_:
        words = re.findall(r"\w+|[^\w\s]+", t or "")
        for i, w in enumerate(words):
            for j in range(max(0, i - 2), min(len(words), i + 3)):
                if j != i:
                    for p, s in zip(place[bucket(words[j])], sign[bucket(words[j])]):
                        total[bucket(w), p] += s
    v = total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)
    v -= v[np.linalg.norm(v, axis=1) > 0].mean(0)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    assert np.allclose(got, v, atol=1e-6)
    x = quality.pooled(["a b c", ""], got)
    e = np.array([got[bucket(w)] for w in "abc"])
    assert np.allclose(x[0], [*e.mean(0), *e.std(0), np.log1p(3) / 10], atol=1e-5) and not x[1].any()


def test_language_by_hand():
    """Presence of grams and the kernel against sets of byte n-grams."""
    texts_ = ["Ab", "abé", "", "zz zz"]

    def grams(t):
        b = t.lower().encode()
        out = set()
        for k in (1, 2, 3):
            for i in range(len(b) - k + 1):
                code = 0
                for x in b[i : i + k]:
                    code = (code * 257 + x + 1) % (1 << 32)
                out.add((code * 2654435761) % (1 << 32) >> 20)
        return out

    x = language_id.presence(pa.array(texts_))
    assert [set(np.flatnonzero(r)) for r in x] == [grams(t) for t in texts_]
    k = language_id.kernel(x, x)
    for i, a in enumerate(map(grams, texts_)):
        for j, b in enumerate(map(grams, texts_)):
            assert np.isclose(k[i, j], len(a & b) / max(1, np.sqrt(len(a) * len(b))), atol=1e-6)


def test_samples_are_bounded(spark):
    """Rows that repeat an id don't add to what is learned from; every language is learned, landmarks are bounded."""
    rows = [(i % 2, f"text {i} of words", f"l{i % 2}") for i in range(2000)] + [(10 + i, "ein wort", f"rare{i}") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs, F.lit(True), per_language=5, most=4)
    assert model["langs"] == ["l0", "l1", *(f"rare{i}" for i in range(9))] and len(model["z"]) == 4
    labels = spark.createDataFrame([(0, 0, 0), (1, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality.quality(docs, labels, F.lit(True)).count() == docs.count()
    assert toxicity.train(spark, docs, labels, F.lit(True))["curve"].shape == (3,)


def test_many_languages(spark):
    """300 languages: all are learned from sums of tasks, the driver holds no more landmarks than it may."""
    r = random.Random(11)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(1500)]
    rows = [(300 * k + i, " ".join(r.choice(words[5 * i : 5 * i + 5]) for _ in range(12)), f"l{i:03}") for i in range(300) for k in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(6)
    model = language_id.train(docs, F.col("doc_id") < 1800)
    assert len(model["langs"]) == 300 and len(model["z"]) == 900 <= language_id.ALL_LANDMARKS
    held = language_id.predict(docs.where("doc_id >= 1800"), model).join(docs.select("doc_id", "lang"), "doc_id")
    assert held.where("lang_pred = lang").count() > 0.9 * 600


def test_ridge_from_sums(spark):
    """Sums of tasks give the coefficients of the ridge regression over all rows at once."""
    rows = [(i, " ".join(random.Random(i).choice(WORDS) for _ in range(20)) + " " + "abc"[i % 3] * 3, "abc"[i % 3]) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = language_id.train(docs, F.lit(True), landmarks=10)
    x, z = language_id.presence(pa.array([t for _, t, _ in rows])), model["z"]
    values, vectors = np.linalg.eigh(language_id.kernel(z, z).astype(float))
    half = vectors[:, values > values[-1] * 1e-6] / np.sqrt(values[values > values[-1] * 1e-6])
    phi = np.c_[language_id.kernel(x, z) @ half, np.ones(len(x))]
    target = np.where(np.array([i % 3 for i in range(90)])[:, None] == np.arange(3), 1.0, -1.0)
    beta = np.linalg.solve(phi.T @ phi + language_id.RIDGE * 90 / 100 * np.eye(phi.shape[1]), phi.T @ target)
    plain = phi @ beta
    got = language_id.kernel(x, z) @ model["beta"] + model["bias"]
    assert len(z) == 30 and np.allclose(got, plain, atol=1e-3)


def test_mixing_dual(spark):
    """Rates of a source against its dual solved by bisection, and the same result however the rows are dealt."""
    r = np.random.default_rng(6)
    sizes = r.integers(1, 400, 300)
    rows = spark.createDataFrame([(i, "abc"[i % 3], int(s)) for i, s in enumerate(sizes)], "doc_id long, source string, size long")
    got = mixing.mix(spark, rows).toPandas()
    for _, s in got.groupby("source"):
        x, target = s["size"] / s["size"].mean(), s.target.iloc[0]
        if target >= 2 * s["size"].sum() - 1e-9:
            assert (s.copies == 2).all()
            continue
        lo, hi = -100.0, 100.0
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if (2 / (1 + np.exp(-mid * x)) * s["size"]).sum() < target else (lo, mid)
        assert np.allclose(s.rate, 2 / (1 + np.exp(-lo * x)), atol=1e-5)
    again = mixing.mix(spark, rows.repartition(7)).toPandas()
    assert sorted(zip(got.doc_id, got.copies)) == sorted(zip(again.doc_id, again.copies))


def test_embedding_shards(spark):
    """A label of several full shards with planted groups, against all pairs: nothing wrong, at least 0.99 of the links found."""
    r = np.random.default_rng(7)
    size = 3 * 512
    v = r.normal(size=(size, 24))
    for i in range(0, size, 3):
        v[(i * 7 + 1) % size] = v[i] + r.normal(scale=0.05, size=24)
    v = np.concatenate([v, v[:5]])  # copies
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    links = ((unit @ unit.T) >= embedding_dedup.THRESHOLD).sum(1) - 1
    df = spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(v)] + [(9_000, v[0].tolist(), 1), (9_000, v[100].tolist(), 1)], "vec_id long, embedding array<double>, label int")
    got = {x.vec_id: x for x in embedding_dedup.embedding_classes(spark, df, shard=512).collect()}
    found = np.array([got[i].n_links for i in range(1, size) if i not in (0, 100)])
    true = np.array([links[i] + (unit[[0, 100]] @ unit[i] >= embedding_dedup.THRESHOLD).sum() for i in range(1, size) if i not in (0, 100)])
    assert (found <= true).all() and found.sum() >= 0.99 * true.sum()
    assert got[9_000].component_id == 0 and got[9_000].n_links >= 2  # one id with two vectors: links of both
