"""Near-duplicate classes of embeddings by navigable small-world graphs.

Vectors of one label are dealt into shards; each shard gets a hierarchical
navigable small-world graph, built once and stored as one row. Every vector of the
label queries every shard, in blocks: a greedy descent, then a beam on the lowest
layer. A beam that is full of hits is widened until it isn't, and a brute-force
audit of the queries of least hash of each block, whatever they found, widens all its
beams until the recall is AUDIT. Two shards meet in one task, which lets each query
the other: a pair found from either side counts for both ends. Found pairs are
verified by their cosine in double precision; a task sends counts and a forest of its
links, and components are united by Spark. Equal vectors are one node, so that copies
are never paired.

Cases: a null label, and vectors that are null, empty, zero or hold null or
non-finite components, link with nothing; only vectors of equal length are compared;
repeated rows (vec_id, label, vector) are one vector; a vec_id with several vectors
is one node that has the links of all of them; a null vec_id links with nothing; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, forest, mix, table, written

THRESHOLD, AUDIT = 0.93, 0.99
#: Vectors of a shard, on average at most; neighbours of a node; beams of building and of searching;
#: queries of a block that are audited.
SHARD, NEIGHBOURS, BUILD_BEAM, BEAM, AUDITED = 2048, 16, 48, 48, 256


def select(v: np.ndarray, candidates: np.ndarray, sims: np.ndarray, m: int) -> np.ndarray:
    """Rows of candidates (-1: none, best first): m that are nearer to the node than to
    those taken before, then the nearest others."""
    n, k = candidates.shape
    c = v[np.maximum(candidates, 0)]
    pair = np.matmul(c, c.transpose(0, 2, 1))
    taken, worst = np.zeros((n, k), bool), np.full((n, k), -2.0, np.float32)
    for j in range(k):
        ok = (candidates[:, j] >= 0) & (sims[:, j] > worst[:, j]) & (taken.sum(1) < m)
        taken[:, j] = ok
        worst = np.where(ok[:, None], np.maximum(worst, pair[:, j]), worst)
    order = np.argsort(np.where(candidates < 0, 2, np.where(taken, 0, 1)), axis=1, kind="stable")[:, :m]
    return np.take_along_axis(candidates, order, 1)


class Graph:
    """Layers of neighbour lists over the unit vectors v; layer 0 holds all."""

    def __init__(self, v: np.ndarray, levels: np.ndarray, lists: list[np.ndarray], entry: int):
        self.v, self.levels, self.lists, self.entry = v, levels, lists, entry

    def beam(self, q: np.ndarray, entry: np.ndarray, width: int, layer: int, own: np.ndarray | None = None):
        """(ids, similarities), best first, of the nearest found in a layer."""
        n, links = len(q), self.lists[layer]
        width = max(1, min(width, len(self.v)))
        ids, sims, done = np.full((n, width), -1), np.full((n, width), -2.0, np.float32), np.ones((n, width), bool)
        ids[:, 0], done[:, 0] = entry, False
        sims[:, 0] = np.einsum("ij,ij->i", self.v[entry], q)
        seen = np.zeros((n, len(self.v)), bool)
        seen[np.arange(n), entry] = True
        active = np.arange(n)
        while len(active):
            best = np.where(done[active], -3, sims[active]).argmax(1)
            live = ~done[active, best]
            active, best = active[live], best[live]
            if not len(active):
                break
            done[active, best] = True
            near = links[ids[active, best]]
            new = (near >= 0) & ~seen[active[:, None], near]
            seen[np.repeat(active, new.sum(1)), near[new]] = True
            s = np.where(new, np.einsum("aij,aj->ai", self.v[np.maximum(near, 0)], q[active]), -2)
            all_ids, all_sims = np.c_[ids[active], np.where(new, near, -1)], np.c_[sims[active], s]
            all_done = np.c_[done[active], ~new]
            top = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
            ids[active], sims[active], done[active] = (np.take_along_axis(x, top, 1) for x in (all_ids, all_sims, all_done))
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def descend(self, q: np.ndarray, to: int) -> np.ndarray:
        at = np.full(len(q), self.entry)
        for layer in range(len(self.lists) - 1, to, -1):
            at = self.beam(q, at, 1, layer)[0][:, 0]
        return at

    @classmethod
    def built(cls, v: np.ndarray, ids: np.ndarray) -> Graph:
        """Insertion in growing batches; a batch's members also see each other."""
        n = len(v)
        u = (mix(ids.astype(np.int64).view(np.uint64)) >> np.uint64(11)).astype(float) / 2**53
        levels = np.minimum((-np.log(np.maximum(u, 1e-12)) / np.log(NEIGHBOURS)).astype(int), 4)
        order = np.argsort(-levels, kind="stable")  # upper layers first: the entry is always there
        most = [2 * NEIGHBOURS] + [NEIGHBOURS] * int(levels.max(initial=0))
        graph = cls(v, levels, [np.full((n, m), -1, np.int32) for m in most], int(order[0]) if n else 0)
        at = 1
        while at < n:
            batch = order[at : at + max(8, min(256, at // 2))]
            top = int(levels[batch].max())
            entry = graph.descend(v[batch], top) if top < len(most) else np.full(len(batch), graph.entry)
            for layer in range(min(top, len(most) - 1), -1, -1):
                old, sims = graph.beam(v[batch], entry, BUILD_BEAM, layer)
                entry = old[:, 0]
                into = levels[batch] >= layer
                some = batch[into]
                peer = v[some] @ v[some].T
                np.fill_diagonal(peer, -2)
                k = min(NEIGHBOURS, len(some))
                near = np.argpartition(-peer, k - 1, axis=1)[:, :k]
                c = np.c_[old[into], np.where(np.take_along_axis(peer, near, 1) > -2, some[near], -1)]
                s = np.c_[sims[into], np.take_along_axis(peer, near, 1)]
                best = np.argsort(-s, axis=1, kind="stable")
                chosen = select(v, np.take_along_axis(c, best, 1), np.take_along_axis(s, best, 1), NEIGHBOURS)
                graph.link(layer, some, chosen)
            at += len(batch)
        return graph

    def link(self, layer: int, nodes: np.ndarray, chosen: np.ndarray) -> None:
        links, v = self.lists[layer], self.v
        links[nodes, : chosen.shape[1]] = chosen
        source, target = np.repeat(nodes, chosen.shape[1]), chosen.ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, first = np.unique(target, return_index=True)
        width = links.shape[1]
        for c, add in zip(nodes.tolist(), np.split(source, first[1:])):
            have = links[c]
            have = have[have >= 0]
            both = np.unique(np.r_[have, add])
            if len(both) > width:
                s = v[both] @ v[c]
                best = np.argsort(-s, kind="stable")
                both = select(v, both[best][None], s[best][None], width)[0]
            links[c] = -1
            links[c, : len(both)] = both


def unit(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return x.reshape(len(column), -1)


def build(key, rows):
    """One shard: ids, weights, vectors and neighbour lists as one row of bytes."""
    x = unit(rows["v"])
    ids, weight = rows["id"].to_numpy(), rows["weight"].to_numpy()
    order = np.argsort(ids, kind="stable")
    x, ids, weight = x[order], ids[order], weight[order]
    g = Graph.built((x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32), ids)
    lists = [a.astype("<i4").tobytes() for a in g.lists]
    return pa.table({"label": key[0:1] and pa.array([key[0].as_py()], pa.string()), "shard": pa.array([key[1].as_py()], pa.int64()), "ids": pa.array([ids.tobytes()]), "weights": pa.array([weight.tobytes()]), "vectors": pa.array([x.tobytes()]), "levels": pa.array([g.levels.tobytes()]), "lists": pa.array([lists], pa.list_(pa.binary())), "entry": pa.array([g.entry], pa.int64())})


def hits(g: Graph, q: np.ndarray, ids: np.ndarray, threshold: float):
    """(query, node) pairs that the beams find, a little below the threshold too."""
    low, width = threshold - 1e-4, BEAM
    audited = np.argsort(mix(ids.astype(np.int64).view(np.uint64)), kind="stable")[:AUDITED]
    true = (q[audited] @ g.v.T >= low).sum()
    while True:
        left, found, w = np.arange(len(q)), [], width
        while len(left):
            near, sims = g.beam(q[left], g.descend(q[left], 0), w, 0)
            full = (sims[:, -1] >= low) & (w < len(g.v))
            i, j = np.nonzero((sims >= low) & ~full[:, None])
            found.append((left[i], near[i, j]))
            left, w = left[full], 2 * w
        a, b = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int),) * 2
        got = np.isin(a, audited).sum()
        if got >= AUDIT * true:
            return a, b
        if width >= len(g.v):  # the graph falls apart here; look at all of the shard
            return np.nonzero(q @ g.v.T >= low)
        width *= 2


class Shard:
    """A shard as its row holds it."""

    def __init__(self, r: dict):
        self.ids, self.weight = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["weights"], np.int64)
        self.x = np.frombuffer(r["vectors"]).reshape(len(self.ids), -1)
        self.norm = np.sqrt(np.einsum("ij,ij->i", self.x, self.x))
        lists = [np.frombuffer(b, "<i4").reshape(len(self.ids), -1) for b in r["lists"]]
        self.graph = Graph((self.x / self.norm[:, None]).astype(np.float32), np.frombuffer(r["levels"], int), lists, r["entry"])


def met(one: Shard, other: Shard, threshold: float) -> np.ndarray:
    """Which vectors of one link with which of the other; each is looked for from both sides."""
    found = np.zeros((len(one.ids), len(other.ids)), bool)
    for query, shard, to in ((one, other, found), (other, one, found.T))[: 1 if one is other else 2]:
        for at in range(0, len(query.ids), 1024):
            s = slice(at, at + 1024)
            a, b = hits(shard.graph, query.graph.v[s], query.ids[s], threshold)
            to[a + at, b] = True
    if one is other:
        found |= found.T.copy()
        np.fill_diagonal(found, False)
    a, b = np.nonzero(found)
    for at in range(0, len(a), 65536):
        i, j = a[at : at + 65536], b[at : at + 65536]
        found[i, j] = np.einsum("ij,ij->i", one.x[i], other.x[j]) / (one.norm[i] * other.norm[j]) >= threshold
    return found


def search(threshold: float):
    def run(key, rows):
        out = {"kind": [], "a": [], "b": []}
        shards = [Shard(r) for r in rows.to_pylist()]
        one, other = shards[0], shards[-1]
        found = met(one, other, threshold)
        a, b = np.nonzero(found)
        u, v = forest(one.ids[a], other.ids[b])
        counts = [(one.ids, np.bincount(a, other.weight[b], len(one.ids)))]
        if one is not other:
            counts.append((other.ids, np.bincount(b, one.weight[a], len(other.ids))))
        for k, x1, x2 in (*((0, ids[n > 0], n[n > 0].astype(np.int64)) for ids, n in counts), (1, u, v)):
            out["kind"].append(np.full(len(x1), k, np.int32))
            out["a"].append(x1)
            out["b"].append(x2)
        return pa.table({k: pa.array(np.concatenate(x), pa.int32() if k == "kind" else pa.int64()) for k, x in out.items()})

    return run


def embedding_classes(spark: SparkSession, rows: DataFrame, threshold: float = THRESHOLD, shard: int = SHARD) -> DataFrame:
    """rows(vec_id, embedding, label) -> vec_id, n_links, component_id, kept."""
    rows = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), F.transform("embedding", lambda x: x.cast("double")).alias("v")).distinct()
    v = F.col("v")
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & F.exists(v, lambda x: x != 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = written(spark, rows.withColumn("good", F.coalesce(good, F.lit(False))), "vectors-rows")
    good_rows = rows.where("good").withColumn("label", F.concat("label", F.lit("/"), F.size("v"))).withColumn("h", F.xxhash64("v"))
    nodes = written(spark, good_rows.groupBy("label", "h", "v").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight")), "vectors-nodes")
    sizes = nodes.groupBy("label").agg(F.ceil(F.count("*") / shard).alias("shards"))
    dealt = nodes.join(sizes, "label").withColumn("shard", F.pmod(F.xxhash64("id"), "shards"))
    graphs = dealt.groupBy("label", "shard").applyInArrow(build, "label string, shard long, ids binary, weights binary, vectors binary, levels binary, lists array<binary>, entry long")
    graphs = written(spark, graphs, "vectors-graphs").join(sizes, "label")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1))
    pairs = graphs.withColumn("with", every).withColumn("low", F.least("shard", "with")).withColumn("high", F.greatest("shard", "with"))
    pairs = pairs.select("label", "low", "high", "ids", "weights", "vectors", "levels", "lists", "entry")
    found = pairs.groupBy("label", "low", "high").applyInArrow(search(threshold), "kind int, a long, b long")
    found = written(spark, found, "vectors-links")
    copies = good_rows.join(nodes, ["label", "h", "v"]).select("vec_id", "id", "weight")
    copies = written(spark, copies, "vectors-copies")
    links = found.where("kind = 1").select(F.col("a").alias("u"), F.col("b").alias("v"))
    classes = connected_components(spark, links.union(copies.where("vec_id <> id").select(F.col("vec_id").alias("u"), F.col("id").alias("v"))))
    counts = found.where("kind = 0").groupBy(F.col("a").alias("id")).agg(F.sum("b").alias("n"))
    direct = copies.join(counts, "id", "left").groupBy("vec_id").agg(F.sum(F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    out = rows.select("vec_id").distinct().join(direct, "vec_id", "left").join(classes.withColumnRenamed("id", "vec_id"), "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_classes(spark, table(spark, sf_dir, "embeddings"))
