"""The library on disk: versions, models, writers in a race, snapshots by reference, and imports from a watched folder."""

import os
import random

import pytest
from pyspark.sql import functions as F

from memquarry.functions.vectors import norm
from memquarry.sources import store
from memquarry.sources.manifest import Lost
from memquarry.streaming import arrivals


def segments(spark, *rows):
    return spark.createDataFrame([(m, f, float(t), 1.0, 0, [3.0, 4.0]) for m, f, t in rows], "model_id string, filename string, t double, dur double, poster long, embedding array<float>")


def media(spark, *names, model="m/1"):
    return spark.createDataFrame([(n, f"h{n}", model, [0.0, 2.0]) for n in names], "filename string, hash string, model_id string, embedding array<float>")


def files(folder):
    return {os.path.join(d, f) for d, _, found in os.walk(folder) for f in found if f.endswith(".parquet")}


def test_models_and_versions(spark, tmp_path):
    folder = f"file://{tmp_path}"
    one = store.commit(spark, folder, replace={"media": media(spark, "a.png"), "segments": segments(spark, ("m/1", "a", 1), ("o=2 %", "b", 2), (None, "c", 3))})
    before = files(tmp_path)
    two = store.commit(spark, folder, append={"segments": segments(spark, ("m/1", "d", 4))})
    three = store.commit(spark, folder, replace={"segments": segments(spark, ("o=2 %", "x", 5), ("m/1", "no", 9))}, models=["o=2 %"])
    assert before <= files(tmp_path) and store.versions(spark, folder) == [one, two, three] == [1, 2, 3]
    names = lambda **k: sorted(r.filename for r in store.read_table(spark, folder, "segments", **k).collect())
    assert names() == ["a", "c", "d", "x"] and names(model_id="m/1") == ["a", "d"] and names(model_id="o=2 %") == ["x"] and names(model_id="none") == []
    assert names(version=1) == ["a", "b", "c"] and names(version=2) == ["a", "b", "c", "d"]
    plan = store.read_segments(spark, folder, "m/1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(model_id" in plan
    listed = {f.rpartition("/")[0].rpartition("/")[2] for f in store.read_segments(spark, folder, "m/1").inputFiles()}
    assert listed == {"model_id=m%252F1"} or listed == {"model_id=m%2F1"}
    row = store.read_table(spark, folder, "segments").first()
    assert row.embedding_norm == 5.0 and store.read_library(spark, folder).select((F.col("embedding_norm") == norm(F.col("embedding"))).alias("same"), F.col("phrase_norm").alias("none")).first() == (True, None)


def test_lost_race(spark, tmp_path):
    """Two writers start from one version: the first commit counts, the other is told and changes nothing."""
    folder = f"file://{tmp_path}"
    start = store.commit(spark, folder, replace={"media": media(spark, "a.png")})
    store.commit(spark, folder, append={"media": media(spark, "b.png")}, after=start)
    with pytest.raises(Lost):
        store.commit(spark, folder, append={"media": media(spark, "c.png")}, after=start)
    assert sorted(r.filename for r in store.read_library(spark, folder).collect()) == ["a.png", "b.png"]
    assert store.commit(spark, folder, append={"media": media(spark, "d.png")}, source={"query": "q", "batch": 1}) == 3
    assert store.commit(spark, folder, append={"media": media(spark, "d.png")}, source={"query": "q", "batch": 1}) is None


def test_snapshots_by_reference(spark, tmp_path):
    """A snapshot copies nothing, keeps what it names, and its folders go with the last that names them."""
    folder, kept = f"file://{tmp_path}/lib", f"file://{tmp_path}/snaps"
    store.commit(spark, folder, replace={"media": media(spark, "a.png", "b.mp4"), "segments": segments(spark, ("m", "b.mp4", 1))})
    before = files(tmp_path)
    assert store.create_snapshot(spark, folder, kept, "My First!") == "my-first" and store.create_snapshot(spark, folder, kept, "Other") == "other"
    for bad in ("My first", "", "!!", "x" * 61):
        with pytest.raises(ValueError):
            store.create_snapshot(spark, folder, kept, bad)
    assert files(tmp_path) == before
    store.commit(spark, folder, replace={"media": media(spark)})
    assert store.read_library(spark, folder).count() == 0 and store.read_segments(spark, folder, "m").count() == 1
    assert store.forget_versions(spark, folder) == [] and before <= files(tmp_path)  # both snapshots hold the first version's media
    store.rename_snapshot(spark, kept, "my-first", "Second")
    assert [(r.slug, r.name, r.n) for r in store.list_snapshots(spark, kept).orderBy("slug").collect()] == [("my-first", "Second", 2), ("other", "Other", 2)]
    missing = store.restore_snapshot(spark, folder, kept, "my-first", spark.createDataFrame([("a.png",)], "filename string"))
    assert [r.filename for r in missing.collect()] == ["b.mp4"] and store.read_library(spark, folder).count() == 2
    store.commit(spark, folder, replace={"media": media(spark, "z.png")})
    assert store.delete_snapshot(spark, kept, "my-first") == []  # older versions and the other snapshot name them
    store.forget_versions(spark, folder)
    assert store.read_library(spark, folder).count() == 1
    gone = store.delete_snapshot(spark, kept, "other")
    assert len(gone) == 1 and not any(f.startswith(gone[0].removeprefix("file://")) for f in files(tmp_path))
    assert store.list_snapshots(spark, kept).count() == 0 and store.read_segments(spark, folder, "m").count() == 1
    with pytest.raises(ValueError):
        store.delete_snapshot(spark, kept, "other")
    for i in range(store.MOST):
        store.create_snapshot(spark, folder, kept, f"n{i}")
    with pytest.raises(ValueError, match="delete one"):
        store.create_snapshot(spark, folder, kept, "one more")


def put(folder, name, content, at):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content)
    os.utime(path, (at, at))


def test_watched_folder(spark, tmp_path, monkeypatch):
    """Files become versions of the library, each batch once: names are free, content and sources known are
    left out, a crash before or after the commit changes nothing, and a writer in between isn't lost."""
    inbox, folder, state = tmp_path / "in", f"file://{tmp_path}/lib", f"file://{tmp_path}/state"
    put(inbox, "a.png", b"one", 1_000_000)
    put(inbox, "sub/a.png", b"two", 1_000_100)
    put(inbox, "c.png", b"one", 1_000_200)
    put(inbox, "d.txt", b"three", 1_000_300)
    seen = []
    go = lambda: arrivals.ingest_library(arrivals.watch_folder(spark, f"file://{inbox}", hashed=True), folder, state, outcomes=lambda df: seen.extend(df.collect()), once=True).awaitTermination()
    commit = store.commit

    def dies_before(*a, **k):
        raise RuntimeError("gone")

    def dies_after(*a, **k):
        commit(*a, **k)
        raise RuntimeError("gone")

    monkeypatch.setattr(store, "commit", dies_before)
    with pytest.raises(Exception, match="gone"):
        go()
    assert store.read_library(spark, folder).count() == 0
    monkeypatch.setattr(store, "commit", dies_after)
    with pytest.raises(Exception, match="gone"):
        go()
    monkeypatch.setattr(store, "commit", commit)
    go()
    rows = lambda: sorted((r.filename, r.source_path.rpartition("/in/")[2]) for r in store.read_library(spark, folder).collect())
    assert rows() == [("a (2).png", "sub/a.png"), ("a.png", "a.png")] and store.versions(spark, folder) == [1]
    put(inbox, "e/a.png", b"four", 1_000_400)
    put(inbox, "e/b.png", b"two", 1_000_500)

    def another_first(*a, **k):
        monkeypatch.setattr(store, "commit", commit)
        commit(spark, folder, append={"media": spark.createDataFrame([("a (3).png", "elsewhere")], "filename string, source_path string")})
        return commit(*a, **k)

    monkeypatch.setattr(store, "commit", another_first)
    go()
    assert rows() == [("a (2).png", "sub/a.png"), ("a (3).png", "elsewhere"), ("a (4).png", "e/a.png"), ("a.png", "a.png")]
    assert sorted((r.path.rpartition("/in/")[2], r.status, r.reason, r.filename) for r in seen) == [("e/a.png", "added", None, "a (4).png"), ("e/b.png", "skipped", "known content", None)]
    go()
    assert store.versions(spark, folder) == [1, 2, 3]


def test_failed_files_stay_out(spark, tmp_path):
    folder, r = f"file://{tmp_path}/lib", random.Random(1)
    batch = spark.createDataFrame([(f"/in/{i}.png", 5.0, 7, f"h{r.random()}") for i in range(4)], "path string, mtime_ms double, size long, hash string")
    failed = spark.createDataFrame([("/in/1.png", 7, 5.0, 3), ("/in/2.png", 7, 5.0, 2), ("/in/3.png", 8, 5.0, 9)], "path string, size long, mtime_ms double, count int")
    out = arrivals.import_batch(spark, batch, folder, {"query": "q", "batch": 0}, failed)
    assert {x.path: x.reason for x in out.collect()} == {"/in/0.png": None, "/in/1.png": "failed before", "/in/2.png": None, "/in/3.png": None}
    assert arrivals.import_batch(spark, batch, folder, {"query": "q", "batch": 0}, failed) is None and store.read_library(spark, folder).count() == 3


def test_stored_norms(spark, tmp_path):
    """Searches take the norms that the library keeps: results are the same, and other norms give others."""
    from memquarry.operators import search

    r = random.Random(2)
    v = lambda: [round(r.gauss(0, 1), 3) for _ in range(4)]
    plain = spark.createDataFrame([(f"{i}.png", "m", v(), v() if i % 3 else None, "") for i in range(60)], "filename string, model_id string, embedding array<float>, phrase array<float>, ocr string")
    store.commit(spark, f"file://{tmp_path}", replace={"media": plain})
    kept = store.read_library(spark, f"file://{tmp_path}")
    number = F.regexp_extract("filename", r"\d+", 0).cast("long")
    queries = spark.createDataFrame([(i, "7 png", v()) for i in range(5)], "query_id long, text string, vec array<double>")
    found = lambda df: sorted(map(tuple, search.search_files(queries, df.withColumn("row_id", number)).withColumn("score", F.round("score", 5)).collect()))
    assert found(kept) == found(plain) and found(kept.withColumn("embedding_norm", F.col("embedding_norm") * 2)) != found(plain)
    topk = lambda df: sorted(map(tuple, search.vector_topk(queries, df.withColumn("vec_id", number)).withColumn("score", F.round("score", 5)).collect()))
    assert topk(kept) == topk(plain)
