"""Toxicity by a linear-chain conditional random field.

Labels are given for documents, so tokens are labelled first: on a bounded sample
of labelled rows Spark counts in how many toxic and other documents each hashed
word and word beginning occurs; a token of a toxic document is labelled toxic if
one of its smoothed log ratios is above TOKEN_RATIO. On sentences with these
labels a two-state chain is trained by forward-backward gradients; its emissions
are linear in the ratios. Scoring runs the chain over every sentence of every
text: the marginals give offending spans, and their sum and maximum, through a
logistic curve fitted on the sample, the document's score.

Learning reads whole texts of at most SAMPLE documents a label (least hash first) and,
for the chain, at most half of SENTENCES sentences with half of TOKENS tokens that
hold a token labelled toxic and as much of those that hold none, again the least hashes first; scoring reads
every whole text. Sentences are never cut.

Cases: null text is empty; empty texts are scored (no marginals); a document with
several labels counts its least one, one with several rows is learned from once, by its least text; without labels of both kinds the score is the
share of label 1, or 0.5; an empty table gives an empty result; extra columns are
not read.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, dropped, slices, table, written
from .packing import Remembered
from .quality import labelled

PLACES, SMOOTH, TOKEN_RATIO = 1 << 18, 10.0, 1.5
SAMPLE, SENTENCES, TOKENS, THRESHOLD, SPAN = 8000, 40_000, 2_000_000, 0.3, 0.5
#: Tokens of a chain that are read one after the other; what longer ones need passes through matrices.
PIECE = 256
TOKEN = re.compile(r"[^\W\d_]+|[.!?\n]")
BREAK = re.compile(r"[.!?\n]")


def places(word: str) -> list[int]:
    """Hashed features of a word: itself and its first 4, 5 and 6 letters."""
    w = word.lower()
    return [zlib.crc32(f"{k}{w[:k] if k else w}".encode("utf-8", "surrogatepass")) % PLACES for k in (0, 4, 5, 6)]


def _transfers(lit: np.ndarray, starts: np.ndarray, lengths: np.ndarray, t: np.ndarray) -> np.ndarray:
    """For each piece (longest first) the product of its steps after the first token, scaled: what carries a message through it."""
    out = np.zeros((len(starts), 2, 2))
    out[:, 0, 0], out[:, 1, 1] = 1, lit[starts]
    for i in range(1, int(lengths[0]) if len(lengths) else 0):
        n = int(np.searchsorted(-lengths, -i, "left"))
        r = out[:n] @ t
        r[:, :, 1] *= lit[starts[:n] + i, None]
        out[:n] = r / r.sum((1, 2), keepdims=True)
    return out


def forward_backward(e: np.ndarray, starts: np.ndarray, lengths: np.ndarray, theta: np.ndarray, piece: int = PIECE):
    """Chains are runs of e, the log-odds of state 1. theta: start of state 1, then
    the transitions 00, 01, 10, 11. Returns the marginals of state 1, the sums of
    the pair marginals, and log Z of all chains.

    All chains go forward in step, so that a long one would take as many steps as it has
    tokens: it is read in pieces instead. The pieces' transfer matrices give the message
    that enters each from either side, and with these a piece is exact on its own."""
    p, pairs = np.zeros(len(e)), np.zeros((2, 2))
    if not len(starts):
        return p, pairs, 0.0
    number = -(-lengths // piece)
    chain = np.repeat(np.arange(len(starts)), number)
    nth = np.arange(len(chain)) - np.repeat(np.cumsum(number) - number, number)
    begin = starts[chain] + nth * piece
    size = np.minimum(lengths[chain] - nth * piece, piece)
    order = np.argsort(-size, kind="stable")
    begin, size, nth, last = begin[order], size[order], nth[order], nth[order] == number[chain[order]] - 1
    t = np.exp(theta[1:].reshape(2, 2))
    lit = np.exp(np.clip(e, -30, 30))
    into = np.ones((len(begin), 2))  # the message before the first token's own weight
    into[:, 1] = np.exp(theta[0])
    after = np.ones((len(begin), 2))  # the message that comes back to the last token
    some = np.flatnonzero((nth > 0) | ~last)
    if len(some):
        through = np.zeros((len(begin), 2, 2))
        through[some] = _transfers(lit, begin[some], size[some], t)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))  # where the pieces are, in the order of chains
        at, n = place[np.cumsum(number) - number], number
        for k in range(1, int(number.max())):
            more = np.flatnonzero(n > k)
            before, here = place[(np.cumsum(number) - number)[more] + k - 1], place[(np.cumsum(number) - number)[more] + k]
            out = np.einsum("ni,nij->nj", into[before], through[before])
            into[here] = (out / out.sum(1, keepdims=True)) @ t
        for k in range(int(number.max()) - 1, 0, -1):
            more = np.flatnonzero(n > k)
            before, here = place[(np.cumsum(number) - number)[more] + k - 1], place[(np.cumsum(number) - number)[more] + k]
            back = np.einsum("nij,nj->ni", through[here], after[here]) @ t.T
            after[before] = back / back.sum(1, keepdims=True)
    alive = np.searchsorted(-size, -np.arange(size[0]), "left")  # pieces longer than each place
    alpha, scale = np.zeros((len(e), 2)), np.ones(len(e))
    for i, n in enumerate(alive):
        at = begin[:n] + i
        if i:
            before = alpha[at - 1]
            a0, a1 = before[:, 0] * t[0, 0] + before[:, 1] * t[1, 0], before[:, 0] * t[0, 1] + before[:, 1] * t[1, 1]
        else:
            a0, a1 = into[:, 0], into[:, 1]
        a1 = a1 * lit[at]
        scale[at] = z = a0 + a1
        alpha[at, 0], alpha[at, 1] = a0 / z, a1 / z
    beta = after / (alpha[begin + size - 1] * after).sum(1, keepdims=True)
    for i in range(len(alive) - 1, -1, -1):
        n, at = alive[i], begin[: alive[i]] + i
        now = beta[:n]
        g = alpha[at] * now
        p[at] = g[:, 1] / g.sum(1)
        if not i:  # a step from the piece before
            at, now = at[nth[:n] > 0], now[nth[:n] > 0]
        if len(at):
            b0, b1 = now[:, 0] / scale[at], now[:, 1] * lit[at] / scale[at]
            before = alpha[at - 1]
            for j in (0, 1):
                pairs[j, 0] += (before[:, j] * b0).sum() * t[j, 0]
                pairs[j, 1] += (before[:, j] * b1).sum() * t[j, 1]
            if i:
                beta[:n, 0], beta[:n, 1] = t[0, 0] * b0 + t[0, 1] * b1, t[1, 0] * b0 + t[1, 1] * b1
    return p, pairs, float(np.log(scale).sum())


def train_chain(x: np.ndarray, y: np.ndarray, starts: np.ndarray, lengths: np.ndarray, rounds: int = 80):
    """x: ratios of every token and 1; y: token labels -> (emission weights, theta)."""
    w, theta = np.r_[np.full(x.shape[1] - 1, 0.5), -2.0], np.array([-2.0, 0.0, -2.0, 0.0, 0.0])
    first = np.zeros(len(y), bool)
    first[starts] = True
    inner = np.flatnonzero(~first)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[inner - 1], y[inner]), 1)
    size, m, s = max(len(y), 1), np.zeros(len(w) + 5), np.zeros(len(w) + 5)
    for k in range(1, rounds + 1):
        p, pairs, _ = forward_backward(x @ w, starts, lengths, theta)
        g = np.r_[x.T @ (y - p), (y - p)[first].sum(), (seen - pairs).ravel()] / size - 1e-5 * np.r_[w, theta]
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        step = 0.2 * (m / (1 - 0.9**k)) / (np.sqrt(s / (1 - 0.99**k)) + 1e-9)
        w, theta = w + step[: len(w)], theta + step[len(w) :]
    return w, theta


def chains(broken: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs between breaks."""
    edge = np.diff(np.r_[True, broken, True].astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    return starts, ends - starts


class Scorer:
    """Marginals of whole texts; made once a task."""

    def __init__(self, ratio: np.ndarray, w: np.ndarray, theta: np.ndarray):
        self.theta = theta
        self.emission = Remembered(lambda t: float("nan") if BREAK.fullmatch(t) else float(ratio[places(t)] @ w[:-1] + w[-1]))

    def __call__(self, texts: list):
        found = [TOKEN.findall(t) if t else [] for t in texts]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) + 1  # each text ends with a break
        ends = np.cumsum(sizes)
        e = np.fromiter((v for f in found for v in (*map(self.emission.__getitem__, f), float("nan"))), float, int(sizes.sum()))
        p, _, _ = forward_backward(e, *chains(np.isnan(e)), self.theta)
        first = ends - sizes
        return p, first, sizes, np.c_[np.log1p(np.add.reduceat(p, first)), np.maximum.reduceat(p, first)] if len(first) else np.zeros((0, 2))


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and bias by Newton steps with a small ridge."""
    a, w = np.c_[x, np.ones(len(x))], np.zeros(x.shape[1] + 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-a @ w))
        w += np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(len(w)), a.T @ (y - p) - 1e-2 * w)
    return w


class LeastHash:
    """The entries of least hash, as many as `most` with `tokens` tokens at most, and one at least; not many more are held."""

    def __init__(self, most: int, tokens: int):
        self.most, self.tokens, self.rows, self.limit = most, tokens, [], None

    def add(self, row: tuple) -> None:
        """row: (hash, doc_id, nth, tokens, ...)"""
        if self.limit is None or row[:3] < self.limit:
            self.rows.append(row)
            if len(self.rows) >= 2 * self.most:
                self.cut()

    def cut(self) -> list:
        self.rows.sort(key=lambda r: r[:3])
        within = np.cumsum([r[3] for r in self.rows]) <= self.tokens if self.rows else np.zeros(0, bool)
        room = max(1, min(self.most, int(within.sum())))
        if len(self.rows) > room:
            self.limit = self.rows[room][:3]
            del self.rows[room:]
        return self.rows


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, learn, sample: int = SAMPLE, sentences: int = SENTENCES, tokens: int = TOKENS) -> dict:
    by = [F.xxhash64("doc_id"), F.col("doc_id")]
    every = labelled(labels, "toxic", learn).where("y IN (0, 1)")
    chosen = every.where("y = 0").orderBy(*by).limit(sample).union(every.where("y = 1").orderBy(*by).limit(sample))
    # 2 * sample ids at most; it's the texts that are many, so they stay where they are. Of rows that repeat an id the least text counts
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y"))
    rows = written(spark, rows, "toxicity-sample")

    def count(batches):
        df, n, known = np.zeros((2, PLACES), np.int64), np.zeros(2, np.int64), Remembered(places)
        for batch in slices(batches):
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
                words = set(TOKEN.findall(text or ""))
                df[y][np.unique([p for w in words for p in known[w]]).astype(int)] += 1
                n[y] += 1
        at = np.flatnonzero(df.any(0))
        yield pa.record_batch({"place": pa.array(np.r_[at, PLACES], pa.int64()), "n0": pa.array(np.r_[df[0][at], n[0]], pa.int64()), "n1": pa.array(np.r_[df[1][at], n[1]], pa.int64())})

    got = rows.mapInArrow(count, "place long, n0 long, n1 long").groupBy("place").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toPandas()  # PLACES + 1 rows at most
    df = np.zeros((2, PLACES + 1))
    df[0][got["place"]], df[1][got["place"]] = got["n0"], got["n1"]
    n = df[:, PLACES]
    if n.min() == 0:
        return {"constant": float(n[1] / n.sum()) if n.sum() else 0.5}
    prior = SMOOTH * n / n.sum()
    ratio = np.log((df[1][:PLACES] + prior[1]) / (n[1] + SMOOTH)) - np.log((df[0][:PLACES] + prior[0]) / (n[0] + SMOOTH))

    def sentence(batches):
        known = Remembered(lambda w: (lambda at: (bool(ratio[at].max() > TOKEN_RATIO), at))(places(w)))
        kept = [LeastHash(sentences // 2, tokens // 2) for _ in range(2)]
        for batch in slices(batches):
            for doc, text, y in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "y"))):
                for i, s in enumerate(BREAK.split(text or "")):
                    if words := TOKEN.findall(s):
                        hot = int(bool(y) and any(known[w][0] for w in words))
                        kept[hot].add((zlib.crc32(f"{doc} {i}".encode()), doc, i, len(words), y, hot, words))
        out = [r for k in kept for r in k.cut()]
        coded = [np.array([known[w][1] for w in r[6]], "<i4").tobytes() for r in out]
        yield pa.record_batch([*(pa.array([r[i] for r in out], pa.int64()) for i in range(6)), pa.array(coded, pa.binary())], names=["hash", "doc_id", "i", "size", "y", "hot", "places"])

    some = written(spark, rows.mapInArrow(sentence, "hash long, doc_id long, i long, size long, y long, hot long, places binary"), "toxicity-sentences")
    got = []
    for hot in (0, 1):  # the tasks' least hashes hold the least ones of all; their sizes tell how many there's room for
        first = ["hash", "doc_id", "i"]
        sizes = np.array([r.size for r in some.where(F.col("hot") == hot).orderBy(*first).limit(sentences // 2).select("size").collect()], np.int64)
        room = max(1, int((np.cumsum(sizes) <= tokens // 2).sum()))
        got += some.where(F.col("hot") == hot).orderBy(*first).limit(room).collect()
    at = [np.frombuffer(r.places, "<i4").reshape(-1, 4) for r in got]
    lengths = np.array([len(a) for a in at], int)
    values = ratio[np.concatenate(at)] if at else np.zeros((0, 4))
    y = (np.repeat([r.y for r in got], lengths).astype(bool) & (values.max(1) > TOKEN_RATIO)).astype(int) if at else np.zeros(0, int)
    w, theta = train_chain(np.c_[values, np.ones(len(values))], y, np.cumsum(lengths) - lengths, lengths)
    model = {"ratio": ratio.astype(np.float32), "w": w, "theta": theta}

    def aggregate(batches):
        score = Scorer(model["ratio"], w, theta)
        for batch in slices(batches, 1 << 20):
            x = score(batch.column("text").to_pylist())[3]
            yield pa.record_batch({"y": batch.column("y"), "a": x[:, 0], "b": x[:, 1]})

    got = rows.mapInArrow(aggregate, "y int, a double, b double").orderBy("y", "a", "b").toPandas()  # 2 * sample rows at most
    share = docs.select(F.col("doc_id").cast("long")).join(labelled(labels, "toxic", learn), "doc_id").agg(F.avg("y")).first()[0]
    dropped(spark, rows)
    dropped(spark, some)
    curve = logistic(got[["a", "b"]].to_numpy(), got["y"].to_numpy())
    curve[-1] += np.log(share / (1 - share)) - np.log(n[1] / n[0])  # the sample is per label; back to the labels' own share
    return model | {"curve": curve}


def toxicity(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """docs(doc_id, text) -> doc_id, score, spans (offsets in characters of runs of toxic tokens), predicted."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        score = None if "constant" in model else Scorer(model["ratio"], model["w"], model["theta"])
        for batch in slices(batches, 1 << 20):
            texts = batch.column("text").to_pylist()
            spans: list = [[] for _ in texts]
            if score is None:
                out = np.full(len(texts), model["constant"])
            else:
                p, first, sizes, x = score(texts)
                out = 1 / (1 + np.exp(-np.clip(x @ model["curve"][:-1] + model["curve"][-1], -500, 500)))
                for d in np.flatnonzero(x[:, 1] >= SPAN):
                    found, before = list(TOKEN.finditer(texts[d])), -2
                    for i in np.flatnonzero(p[first[d] : first[d] + sizes[d] - 1] >= SPAN):
                        if i == before + 1:
                            spans[d][-1]["end"] = found[i].end()
                        else:
                            spans[d].append({"start": found[i].start(), "end": found[i].end()})
                        before = i
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "score": pa.array(out, pa.float64()), "spans": pa.array(spans, kind)})

    return rows.mapInArrow(run, "doc_id long, score double, spans array<struct<start:int,end:int>>").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(spark, docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 4) != 2)
    return toxicity(docs, model).select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", "predicted", "spans")
