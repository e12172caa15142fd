"""Searches: every operator takes a table of queries and ranks rows for each.

The library stays where it lies. Queries are few and rows are many, so queries are
collected in chunks of QUERIES_AT_ONCE (as many passes as a larger table needs), go to
the tasks, and meet each Arrow batch of rows there: vectors in one matrix product, tokens
in one walk through each text. A task sends the k best rows of a batch for each query, or
counts; only these are shuffled.

Cases: a blank query finds nothing by words; a null or zero vector has cosine 0; vectors
of different lengths meet over the shorter one; ties go by the order named for each search.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokens import ask_tokens, cjk_bigrams, phrase_tokens, rank_tokens, whitespace_tokens, word_tokens
from ..sources.manifest import scratch_folder

QUERIES_AT_ONCE = 1024
# Boosts, floors and caps of the rankings.
FILENAME_BOOST, PHRASE_BOOST, OCR_BOOST = 0.2, 0.6, 0.5
MIN_SCORE, KEEP, DIVERSITY, TOP_K, CANDIDATES = 0.04, 0.6, 0.92, 24, 500
SLOT, PER_VIDEO, NOISE, NOISE_TOTAL = 5, 3, 0.25, 20
SNIPPET = 300
#: Steps of scores from LOW to HIGH, to find the place of a cutoff by counting.
BUCKETS, LOW, HIGH = 4096, -2.0, 3.0


def chunks(queries: DataFrame):
    """The queries in lists of about QUERIES_AT_ONCE rows."""
    first = queries.limit(QUERIES_AT_ONCE + 1).collect()
    if len(first) <= QUERIES_AT_ONCE:
        if first:
            yield sorted(first, key=lambda r: (r.query_id is not None, r.query_id))
        return
    at = scratch_folder(queries.sparkSession, "queries")  # worked out once, not once a list
    queries.write.parquet(at)
    queries = queries.sparkSession.read.schema(queries.schema).parquet(at)
    n = -(-queries.count() // QUERIES_AT_ONCE)
    for i in range(n):
        yield queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i).orderBy("query_id").collect()


def anew(df: DataFrame) -> DataFrame:
    """df with its query_id worked out again. Tables that are dealt alike by query_id are
    united partition by partition, which fails if they were coalesced to different numbers."""
    return df.withColumn("query_id", F.col("query_id") + F.lit(0)) if "query_id" in df.columns else df


def union(parts: list[DataFrame]) -> DataFrame:
    out = anew(parts[0])
    for p in parts[1:]:
        out = out.union(anew(p))
    return out


def none(queries: DataFrame, schema: str) -> DataFrame:
    return queries.sparkSession.createDataFrame([], schema)


def top(k: int) -> int:
    return max(1, min(96, k))


def ranked(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """rank 1..k a query; Spark keeps k rows a partition before it shuffles."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)


def padded(vectors: list, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        v = [x or 0.0 for x in v or ()][:width]
        out[i, : len(v)] = v
    return out


def stored(df: DataFrame, *vectors: str) -> list[str]:
    """The vector columns, each with the norm that a library keeps beside it, if it does."""
    return [c for v in vectors for c in (v, f"{v}_norm") if c == v or c in df.columns]


def matrix(column: pa.Array, width: int, norms: pa.Array | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows by width, norms) of a list column; shorter vectors end in zeros. Norms that are given aren't worked out."""
    known = None if norms is None else np.nan_to_num(pc.fill_null(norms, 0.0).to_numpy())
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)
    flat = pc.fill_null(pc.cast(column.flatten(), pa.float64()), 0.0).to_numpy()
    if len(sizes) and (sizes == width).all():
        out = flat.reshape(-1, width)
        return out, np.sqrt(np.einsum("ij,ij->i", out, out)) if known is None else known
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out, some = np.zeros((len(sizes), width)), place < width
    out[row[some], place[some]] = flat[some]
    return out, np.sqrt(np.bincount(row, flat * flat, len(sizes))) if known is None else known


class Vectors:
    """The vectors of some queries, to be held against those of a batch."""

    def __init__(self, rows: list):
        self.width = max([1, *(len(r.vec or ()) for r in rows)])
        self.q = padded([r.vec for r in rows], self.width)
        self.norm = np.sqrt((self.q**2).sum(1))

    def dots(self, column) -> np.ndarray:
        return self.q @ matrix(column, self.width)[0].T

    def cosines(self, table, vector: str) -> np.ndarray:
        """Queries by rows; with the norms of the table, if it has them."""
        norms = f"{vector}_norm"
        x, n = matrix(table[vector], self.width, table[norms] if norms in table.column_names else None)
        both = self.norm[:, None] * n[None]
        return np.divide(self.q @ x.T, both, out=np.zeros(both.shape), where=both > 0)


class Tokens:
    """The distinct tokens of some queries, and which query has which."""

    def __init__(self, rows: list):
        self.every = sorted({t for r in rows for t in r.tokens or ()})
        place = {t: i for i, t in enumerate(self.every)}
        self.of = np.zeros((len(rows), len(self.every)), np.float32)
        for i, r in enumerate(rows):
            self.of[i, [place[t] for t in r.tokens or ()]] = 1
        self.size = np.array([len(r.tokens or ()) for r in rows])
        self.place, self.automaton = place, None

    def hits(self, found: list) -> np.ndarray:
        """found: for each row the places of its tokens -> tokens of each query that it holds, queries by rows."""
        held = np.zeros((len(self.every), len(found)), np.float32)
        for i, f in enumerate(found):
            held[list(f), i] = 1
        return np.rint(self.of @ held).astype(np.int64)

    def contained(self, texts: list) -> np.ndarray:
        """Tokens that stand anywhere in a text, by one walk through it."""
        import ahocorasick

        if not self.every:
            return np.zeros((len(self.size), len(texts)), np.int64)
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for t, i in self.place.items():
                self.automaton.add_word(t, i)
            self.automaton.make_automaton()
        return self.hits([{i for _, i in self.automaton.iter(t)} if t else () for t in texts])

    def share(self, hits: np.ndarray) -> np.ndarray:
        return hits / np.maximum(self.size, 1)[:, None]


_word = re.compile(r"[^\W_]+")


class Words(Tokens):
    """Tokens that count where one of their pieces is a word of the text. rows have
    pieces: a list of words for each token."""

    def __init__(self, rows: list):
        super().__init__(rows)
        self.by_piece: dict = {}
        for r in rows:
            for t, pieces in zip(r.tokens or (), r.pieces or ()):
                for p in pieces:
                    self.by_piece.setdefault(p, set()).add(self.place[t])

    def held(self, texts: list, bigrams: list) -> np.ndarray:
        """texts in lower case, and the pairs of characters of scripts without spaces that a query has too."""
        out = []
        for t, pairs in zip(texts, bigrams):
            words = self.by_piece.keys() & set(_word.findall(t or ""))
            out.append(set().union(*(self.by_piece[w] for w in [*words, *(p for p in pairs or () if p in self.by_piece)])))
        return self.hits(out)


def with_words(rows: DataFrame, ocr: str, asked: list) -> DataFrame:
    """Adds what Words.held reads: the text in lower case and, if a query has such pieces, its CJK pairs."""
    cjk = sorted({p for r in asked for pieces in r.pieces or () for p in pieces if any("　" < c for c in p)})
    pairs = F.array_intersect(cjk_bigrams(F.col(ocr)), F.array(*map(F.lit, cjk))) if cjk else F.lit(None).cast("array<string>")
    return rows.withColumn("_text", F.lower(F.coalesce(F.col(ocr).cast("string"), F.lit("")))).withColumn("_pairs", pairs).drop(ocr)


def with_pieces(queries: DataFrame, tokens: Column) -> DataFrame:
    return queries.withColumn("tokens", tokens).withColumn("pieces", F.transform("tokens", word_tokens))


def best_rows(rows: DataFrame, ids: list, score, parts: list[str], kept: list[str], tie: str, k: int) -> DataFrame:
    """(query_id, kept..., score, parts...): at least the k best rows of each query, by
    score and then by `tie`. score(batch) gives {"score": queries by rows, -inf where a
    row plays no part, and parts}; a task sends k rows a batch and query at most, and none
    below the k best that it has seen."""
    kinds = dict(rows.dtypes)
    schema = f"query_id long, {', '.join(f'`{c}` {kinds[c]}' for c in kept)}, score double{''.join(f', `{p}` double' for p in parts)}"

    def run(batches):
        floor, seen = np.full(len(ids), -np.inf), [np.zeros(0)] * len(ids)
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table.take(pc.sort_indices(table[tie]))
            got = score(table)
            some = (got["score"] >= floor[:, None]) & (got["score"] > -np.inf)
            q_at, r_at = [], []
            for q in np.flatnonzero(some.any(1)):
                at = np.flatnonzero(some[q])
                value = got["score"][q, at]
                if len(at) > k:
                    first = np.argsort(-value, kind="stable")[:k]
                    at, value = at[first], value[first]
                seen[q] = np.sort(np.r_[seen[q], value])[-k:]
                if len(seen[q]) == k:
                    floor[q] = seen[q][0]
                q_at.append(np.full(len(at), q))
                r_at.append(at)
            if q_at:
                q, r = np.concatenate(q_at), np.concatenate(r_at)
                taken = table.select(kept).take(pa.array(r)).combine_chunks()
                numbers = [pa.array(got[p][q, r].astype(float)) for p in ("score", *parts)]
                yield from pa.Table.from_arrays([pa.array(np.array(ids)[q], pa.int64()), *taken.columns, *numbers], names=["query_id", *kept, "score", *parts]).to_batches(max_chunksize=20_000)

    return rows.mapInArrow(run, schema)


# --- files -------------------------------------------------------------------------


class FileScores:
    """Base scores of files: cosine, excess of the name's vector where a word of the query is in the name, tokens in the name."""

    def __init__(self, asked: list):
        self.vectors, self.tokens = Vectors(asked), Tokens(asked)

    def __call__(self, table) -> dict:
        semantic = self.vectors.cosines(table, "embedding")
        named = [[self.tokens.place[w] for w in words or () if w in self.tokens.place] for words in table["_words"].to_pylist()]
        gate = self.tokens.hits(named) > 0
        phrase = np.where(gate, np.maximum(0.0, PHRASE_BOOST * (self.vectors.cosines(table, "phrase") - semantic)), 0.0)
        by_name = FILENAME_BOOST * self.tokens.share(self.tokens.contained(table["_name"].to_pylist()))
        # rounded, so that a row has the same score in every pass over it
        return {"base": np.round(semantic + phrase + by_name, 12), "semantic": semantic, "phrase": phrase, "by_name": by_name}


#: A score as a whole number: scores are rounded to as many places.
WHOLE = 10**12


def _counted(rows: DataFrame, asked: list, scores, low: np.ndarray, width: np.ndarray, high: np.ndarray) -> DataFrame:
    """(query_id, value, n, low, high): for each query, how many whole scores of its range lie in each
    step of `width` from `low` on, and the least and greatest of them."""
    ids = np.array([r.query_id for r in asked])

    def run(batches):
        for batch in batches:
            out = []
            for i, b in enumerate(np.rint(scores(pa.Table.from_batches([batch])) * WHOLE).astype(np.int64)):
                b = np.sort(b[(b >= low[i]) & (b <= high[i])])
                step = (b - low[i]) // width[i]
                first = np.flatnonzero(np.diff(step, prepend=-1))
                if len(first):
                    n = np.diff(np.r_[first, len(b)])
                    out.append((np.full(len(first), ids[i]), step[first], n, b[first], b[first + n - 1]))
            if out:
                yield pa.record_batch([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out)], names=["query_id", "value", "n", "low", "high"])

    counts = rows.mapInArrow(run, "query_id long, value long, n long, low long, high long")
    return counts.groupBy("query_id", "value").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


def percentile_cut(rows: DataFrame, asked: list, keep: float, scores=None) -> dict:
    """query_id -> the score at place floor(n (1 - keep)) + 1 from the best: the order statistic is
    closed in on by counting. Each pass over the rows counts a query's range in BUCKETS steps and
    goes on with what the step holds that has the place, from its least to its greatest score,
    so that crowded scores are told apart too; after four passes at most a step is one score."""
    scores = scores or (lambda table, base=FileScores(asked): base(table)["base"])
    n, spark = rows.count(), rows.sparkSession
    if not n:
        return {}
    ids, found = [r.query_id for r in asked], {}
    place = dict.fromkeys(ids, min(math.floor(n * (1 - keep)) + 1, n))
    low, high = np.full(len(ids), int(LOW * WHOLE)), np.full(len(ids), int(HIGH * WHOLE))
    while len(found) < len(ids):
        width = np.maximum((high - low) // BUCKETS + 1, 1)
        down = Window.partitionBy("query_id").orderBy(F.col("value").desc())  # BUCKETS rows a query
        counts = _counted(rows, asked, scores, low, width, high).withColumn("upto", F.sum("n").over(down))
        places = spark.createDataFrame([(q, p) for q, p in place.items() if q not in found], "query_id long, place long")
        seen: set = set()
        for r in counts.join(F.broadcast(places), "query_id").where("upto >= place AND upto - n < place").collect():  # a row a query
            i = ids.index(r.query_id)
            low[i], high[i] = r.low, r.high
            place[r.query_id] -= r.upto - r.n
            if r.low == r.high:
                found[r.query_id] = r.low / WHOLE
            seen.add(r.query_id)
        if len(seen | found.keys()) < len(ids):
            raise ValueError(f"scores must lie between {LOW} and {HIGH}")
        for i, q in enumerate(ids):  # nothing is counted for a query that is done
            if q in found:
                low[i], high[i] = 1, 0
    return found


def percentile_cutoffs(queries: DataFrame, media: DataFrame, keep: float = KEEP) -> DataFrame:
    """(query_id, cut): the base score that a file must reach to be among a query's best `keep`."""
    rows = media.select(*stored(media, "embedding", "phrase"), phrase_tokens(F.col("filename")).alias("_words"), F.lower("filename").alias("_name"))
    cuts: dict = {}
    for asked in chunks(with_pieces(queries.where(F.trim("text") != ""), rank_tokens(F.col("text"))).select("query_id", "vec", "tokens", "pieces")):
        cuts |= percentile_cut(rows, asked, keep)
    return queries.sparkSession.createDataFrame(list(cuts.items()), "query_id long, cut double")


def _low_places(rows: DataFrame, asked: list, place: int) -> dict:
    """query_id -> the base score at a place among the first CANDIDATES, from the best rows of each task."""
    base, ids = FileScores(asked), [r.query_id for r in asked]
    best = best_rows(rows, ids, lambda t: {"score": base(t)["base"]}, [], ["row_id"], "row_id", place)
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc()))
    return {r.query_id: r.score for r in best.withColumn("nth", nth).where(F.col("nth") == place).collect()}


def search_files(queries: DataFrame, media: DataFrame, k: int = TOP_K, min_score: float = MIN_SCORE, keep: float = KEEP, diverse: bool = True) -> DataFrame:
    """Floor, percentile cutoff (rows with a word of the query in their text are exempt),
    boost by recognised words, dominant signal, and, if diverse, no near copies. Ties: row_id.

    Boosts are never negative, so that no row below the cutoff without such a word outscores one
    above it: where as many rows as are wanted lie above, the best need no cutoff, and where
    fewer do, its place is among the best. Either way no pass over all scores looks for it."""
    k, names = top(k), ["semantic", "phrase", "by_name", "ocr"]
    rows = media.select("row_id", "filename", *stored(media, "embedding", "phrase"), "ocr").withColumn("_words", phrase_tokens(F.col("filename"))).withColumn("_name", F.lower("filename"))
    scored, parts, wanted = rows.drop("ocr"), [], CANDIDATES if diverse else k
    n = rows.count()
    place = min(math.floor(n * (1 - keep)) + 1, n)
    for asked in chunks(with_pieces(queries.where(F.trim("text") != ""), rank_tokens(F.col("text"))).select("query_id", "vec", "tokens", "pieces")):
        cuts = dict.fromkeys((r.query_id for r in asked), -np.inf) if place >= wanted or not n else _low_places(scored, asked, place)
        parts.append(best_rows(with_words(rows, "ocr", asked), [r.query_id for r in asked], _final_scores(asked, cuts, min_score), ["base", *names], ["row_id", "filename", *(["embedding"] if diverse else [])], "row_id", wanted))
    columns = "query_id long, rank int, filename string, score double, dominant string" + ("" if diverse else ", semantic double, phrase double, filename_part double, ocr double")
    if not parts:
        return none(queries, columns)
    kept = union(parts)
    signals = F.array(*(F.struct((-F.col(c)).alias("v"), F.lit(i).alias("i"), F.lit(name).alias("name")) for i, (c, name) in enumerate(zip(names, ("semantic", "phrase", "filename", "ocr")))))
    first = F.array_min(F.filter(signals, lambda p: p["v"] < 0))
    kept = kept.withColumn("dominant", F.when(-first["v"] >= F.col("semantic") * 0.5, first["name"]).otherwise("semantic"))
    order = (F.col("score").desc(), F.col("base").desc(), F.col("row_id"))
    if not diverse:
        return ranked(kept, k, *order).select("query_id", "rank", "filename", "score", "dominant", "semantic", "phrase", F.col("by_name").alias("filename_part"), "ocr")
    return ranked(kept, CANDIDATES, *order).select("query_id", "rank", "filename", "score", "dominant", "embedding").groupBy("query_id").applyInPandas(diversified(k), columns)


def _final_scores(asked: list, cuts: dict, min_score: float):
    base, words = FileScores(asked), Words(asked)
    cut = np.array([cuts.get(r.query_id, np.inf) for r in asked])[:, None]

    def score(table):
        got = base(table)
        share = words.share(words.held(table["_text"].to_pylist(), table["_pairs"].to_pylist()))
        kept = (got["base"] >= min_score) & ((got["base"] >= cut) | (share > 0))
        got["ocr"] = OCR_BOOST * share
        return got | {"score": np.where(kept, got["base"] + got["ocr"], -np.inf)}

    return score


def diversified(k: int, threshold: float = DIVERSITY):
    """Greedy: a candidate too near to one taken before is left out. The rule is
    sequential in a query, and a query has CANDIDATES rows at most."""

    def run(rows):
        import numpy as np

        rows = rows.sort_values("rank")
        if len(rows) > k:
            v = np.stack(rows["embedding"].to_list()).astype(float)
            v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
            taken: list[int] = []
            for i in range(len(v)):
                if len(taken) >= k:
                    break
                if not taken or (v[taken] @ v[i]).max() <= threshold:
                    taken.append(i)
            if len(taken) >= 3:
                rows = rows.iloc[taken]
        rows = rows.head(k).copy()
        rows["rank"] = range(1, len(rows) + 1)
        return rows[["query_id", "rank", "filename", "score", "dominant"]]

    return run


# --- words -------------------------------------------------------------------------


def _by_words(queries: DataFrame, rows: DataFrame, scores, parts: list, kept: list, tie: str, k: int) -> DataFrame:
    found = [best_rows(with_words(rows, "ocr", asked) if "ocr" in rows.columns else rows, [r.query_id for r in asked], scores(asked), parts, kept, tie, k) for asked in chunks(queries)]
    return union(found) if found else none(queries, f"query_id long, {', '.join(f'{c} {dict(rows.dtypes)[c]}' for c in kept)}, score double{''.join(f', {p} double' for p in parts)}")


def search_keyword(queries: DataFrame, media: DataFrame, k: int = TOP_K) -> DataFrame:
    """Tokens in the name plus tokens in the text. Ties: row_id."""

    def scores(asked):
        tokens = Tokens(asked)

        def score(table):
            a, b = tokens.contained(table["_name"].to_pylist()), tokens.contained(table["_text"].to_pylist())
            return {"score": np.where(a + b > 0, a + b, -np.inf), "in_name": a, "in_text": b}

        return score

    q = with_pieces(queries, rank_tokens(F.col("text"))).select("query_id", "tokens", "pieces").where(F.size("tokens") > 0)
    rows = media.select("row_id", "filename", F.lower("filename").alias("_name"), "ocr")
    found = _by_words(q, rows, scores, ["in_name", "in_text"], ["row_id", "filename"], "row_id", top(k))
    label = F.when((F.col("in_text") > 0) & (F.col("in_text") >= F.col("in_name")), "ocr").when(F.col("in_name") > 0, "filename").otherwise("semantic")
    return ranked(found.withColumn("dominant", label), top(k), F.col("score").desc(), F.col("row_id")).select("query_id", "rank", "filename", F.col("score").cast("int").alias("score"), "dominant")


def search_ocr(queries: DataFrame, media: DataFrame, k: int = TOP_K) -> DataFrame:
    """Share of the tokens that stand anywhere in the text. Ties: the name."""

    def scores(asked):
        tokens = Tokens(asked)

        def score(table):
            hits = tokens.contained(table["_text"].to_pylist())
            return {"score": np.where(hits > 0, tokens.share(hits), -np.inf)}

        return score

    q = with_pieces(queries, rank_tokens(F.col("text"))).select("query_id", "tokens", "pieces").where(F.size("tokens") > 0)
    found = _by_words(q, media.select("row_id", "filename", "ocr"), scores, [], ["row_id", "filename"], "filename", top(k))
    return ranked(found, top(k), F.col("score").desc(), F.col("filename"), F.col("row_id")).select("query_id", "rank", "filename", "score")


def keyword_evidence(queries: DataFrame, media: DataFrame, k: int = 4) -> DataFrame:
    """Share of the words that the name contains. Ties: the name."""

    def scores(asked):
        tokens = Tokens(asked)

        def score(table):
            hits = tokens.contained(table["_name"].to_pylist())
            return {"score": np.where(hits > 0, tokens.share(hits), -np.inf)}

        return score

    q = queries.select("query_id", ask_tokens(F.col("text")).alias("tokens")).where(F.size("tokens") > 0)
    found = _by_words(q, media.select("row_id", "filename", F.lower("filename").alias("_name")), scores, [], ["row_id", "filename"], "filename", top(k))
    return ranked(found, top(k), F.col("score").desc(), F.col("filename"), F.col("row_id")).select("query_id", "rank", "filename", "score")


def ocr_evidence(queries: DataFrame, media: DataFrame, k: int = 6) -> DataFrame:
    """Share of a query's words among the words of the text, with the beginning of the text. Ties: the name."""
    from ..functions.texts import truncate_text

    def scores(asked):
        words = Words(asked)

        def score(table):
            hits = words.held(table["_text"].to_pylist(), table["_pairs"].to_pylist())
            return {"score": np.where(hits > 0, words.share(hits), -np.inf)}

        return score

    q = queries.withColumn("tokens", ask_tokens(F.col("text"))).where(F.size("tokens") > 0).select("query_id", "tokens", F.transform("tokens", lambda t: F.array(t)).alias("pieces"))
    rows = media.select("row_id", "filename", "ocr").withColumn("snippet", truncate_text(F.col("ocr"), SNIPPET))
    found = _by_words(q, rows, scores, [], ["row_id", "filename", "snippet"], "filename", top(k))
    return ranked(found, top(k), F.col("score").desc(), F.col("filename"), F.col("row_id")).select("query_id", "rank", "filename", "score", "snippet")


# --- vectors and scenes --------------------------------------------------------------


def _rounded_cosines(asked: list):
    vectors = Vectors(asked)
    return lambda table: {"score": np.round(vectors.cosines(table, "embedding"), 9)}


def vector_topk(queries: DataFrame, rows: DataFrame, k: int = TOP_K) -> DataFrame:
    """Ties: vec_id."""
    rows = rows.select("vec_id", *stored(rows, "embedding"))
    found = [best_rows(rows, [r.query_id for r in asked], _rounded_cosines(asked), [], ["vec_id"], "vec_id", top(k)) for asked in chunks(queries.select("query_id", "vec"))]
    if not found:
        return none(queries, "query_id long, rank int, vec_id long, score double")
    return ranked(union(found), top(k), F.col("score").desc(), F.col("vec_id")).select("query_id", "rank", "vec_id", "score")


def _grouped(rows: DataFrame, asked: list, least: np.ndarray, by: list[str]) -> DataFrame:
    """(query_id, by..., t, dur, poster, score, n): of each task's rows with at least the
    query's score, the best of each group `by` (the earliest of equals) and their number."""
    ids, scores = [r.query_id for r in asked], _rounded_cosines(asked)
    kinds = dict(rows.dtypes)
    kept = list(dict.fromkeys([*by, "t", "dur", "poster"]))

    def run(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table.take(pc.sort_indices(table, [(c, "ascending") for c in [*by, "t"]]))
            s = scores(table)["score"]
            new = np.zeros(table.num_rows, bool)
            new[:1] = True
            for c in by:
                new[1:] |= pc.fill_null(pc.not_equal(table[c].combine_chunks()[1:], table[c].combine_chunks()[:-1]), True).to_numpy(zero_copy_only=False)
            start = np.flatnonzero(new)
            if not len(start):
                continue
            high = np.maximum.reduceat(s, start, axis=1)
            n = np.add.reduceat((s >= least[:, None]).astype(np.int64), start, axis=1)
            at = np.where(s == np.repeat(high, np.diff(np.r_[start, len(new)]), axis=1), np.arange(len(new)), len(new))
            at = np.minimum.reduceat(at, start, axis=1)
            q, g = np.nonzero(n)
            taken = table.select(kept).take(pa.array(at[q, g])).combine_chunks()
            out = pa.Table.from_arrays([pa.array(np.array(ids)[q], pa.int64()), *taken.columns, pa.array(high[q, g]), pa.array(n[q, g])], names=["query_id", *kept, "score", "n"])
            yield from out.to_batches(max_chunksize=20_000)

    return rows.mapInArrow(run, f"query_id long, {', '.join(f'`{c}` {kinds[c]}' for c in kept)}, score double, n long")


def slot_max(hits: DataFrame, seconds: int = SLOT) -> DataFrame:
    """The best hit of each file and time slot; the earliest of equals."""
    best = F.max_by(F.struct("t", "dur", "poster", "score"), F.struct("score", (-F.col("t")).alias("s")))
    return hits.groupBy("query_id", "filename", F.floor(F.col("t") / seconds).alias("slot")).agg(best.alias("best")).select("query_id", "filename", "slot", "best.*")


def _totals(rows: DataFrame, asked: list) -> dict:
    """query_id -> (rows, best score)."""
    ids, scores = np.array([r.query_id for r in asked]), _rounded_cosines(asked)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                s = scores(pa.Table.from_batches([batch]))["score"]
                yield pa.record_batch({"query_id": ids, "n": np.full(len(ids), s.shape[1]), "top": s.max(1)})

    got = rows.mapInArrow(run, "query_id long, n long, top double").groupBy("query_id").agg(F.sum("n").alias("n"), F.max("top").alias("top"))
    return {r.query_id: (r.n, r.top) for r in got.collect()}  # a row for each query of the chunk


def search_scenes(queries: DataFrame, segments: DataFrame, k: int = TOP_K, min_score: float = MIN_SCORE, keep: float = KEEP, slots: bool = True, noise: float = NOISE) -> DataFrame:
    """Segments above the floor, one a slot, above a share of the best; nothing if too
    large a share of all segments is above that; some a video; the k best."""
    rows = segments.select("filename", "t", "dur", "poster", *stored(segments, "embedding")).withColumn("slot", F.floor(F.col("t") / SLOT))
    by, parts = ["filename", "slot"] if slots else ["filename", "t", "poster"], []
    for asked in chunks(queries.select("query_id", "vec")):
        totals = _totals(rows.select(*stored(rows, "embedding")), asked)
        cut = np.array([max(min_score, totals.get(r.query_id, (0, 0.0))[1] * keep) for r in asked])
        spark = rows.sparkSession
        number = spark.createDataFrame([(r.query_id, totals.get(r.query_id, (0, 0.0))[0]) for r in asked], "query_id long, total long")
        found = _grouped(rows, asked, cut, by)
        above = found.groupBy("query_id").agg(F.sum("n").alias("above")).join(F.broadcast(number), "query_id")
        quiet = above.where(~((F.col("total") >= NOISE_TOTAL) & (F.col("above") / F.col("total") > noise))).select("query_id")
        parts.append((slot_max(found) if slots else found.select("query_id", "filename", "t", "dur", "poster", "score")).join(quiet, "query_id").select("query_id", "filename", "t", "dur", "poster", "score"))
    if not parts:
        return none(queries, "query_id long, rank int, filename string, t double, dur double, poster long, score double")
    nth = F.row_number().over(Window.partitionBy("query_id", "filename").orderBy(F.col("score").desc(), "t"))
    found = union(parts).withColumn("nth", nth).where(F.col("nth") <= PER_VIDEO)
    return ranked(found, top(k), F.col("score").desc(), F.col("filename"), F.col("t")).select("query_id", "rank", "filename", "t", "dur", "poster", "score")


def best_scene(queries: DataFrame, segments: DataFrame) -> DataFrame:
    """For each query and file its best segment, the earliest of equals."""
    rows = segments.select("filename", "t", "dur", "poster", *stored(segments, "embedding"))
    parts = [_grouped(rows, asked, np.full(len(asked), -np.inf), ["filename"]) for asked in chunks(queries.select("query_id", "vec"))]
    if not parts:
        return none(queries, "query_id long, filename string, t double, poster long, score double")
    best = F.max_by(F.struct("t", "poster", "score"), F.struct("score", (-F.col("t")).alias("s")))
    return union(parts).groupBy("query_id", "filename").agg(best.alias("b")).select("query_id", "filename", "b.*")


# --- built ahead -----------------------------------------------------------------------


def _build_scores(asked: list):
    """Dot products instead of cosines, and whole words of the query: how results are scored when they are built ahead."""
    vectors, tokens = Vectors(asked), Tokens(asked)

    def score(table):
        semantic = vectors.dots(table["embedding"])
        named = [[tokens.place[w] for w in words or () if w in tokens.place] for words in table["_words"].to_pylist()]
        phrase = np.where(tokens.hits(named) > 0, np.maximum(0.0, PHRASE_BOOST * (vectors.dots(table["phrase"]) - semantic)), 0.0)
        return {"score": np.round(semantic + phrase + FILENAME_BOOST * tokens.share(tokens.contained(table["_name"].to_pylist())), 9)}

    return score


def precompute_queries(queries: DataFrame, media: DataFrame, k: int = TOP_K) -> DataFrame:
    """query_id, results (ARRAY<STRUCT<rank, filename, score>>): the k best files of each sample query, to be stored. Ties: row_id."""
    rows = media.select("row_id", "filename", "embedding", "phrase").withColumn("_words", phrase_tokens(F.col("filename"))).withColumn("_name", F.lower("filename"))
    asked_for = queries.select("query_id", "vec", whitespace_tokens(F.col("text")).alias("tokens"))
    parts = [best_rows(rows, [r.query_id for r in asked], _build_scores(asked), [], ["row_id", "filename"], "row_id", top(k)) for asked in chunks(asked_for)]
    if not parts:
        return none(queries, "query_id long, results array<struct<rank:int,filename:string,score:double>>")
    best = ranked(union(parts), top(k), F.col("score").desc(), F.col("row_id"))
    return best.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "filename", "score"))).alias("results"))
