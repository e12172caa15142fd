"""Streams against their table versions: order across micro-batches, resent slices, restarts."""

import random

import pytest
from pyspark.sql import functions as F

from memquarry.sources import manifest
from memquarry.streaming import arrivals as A
from memquarry.streaming import children as C


def feed(spark, rows, schema, folder, nth):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{nth}")


def stream(spark, schema, folder):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)


ATTEMPTS = "path string, at timestamp, seq long, size long, mtime double, ok boolean"


def test_failures_in_order_across_batches(spark, tmp_path):
    """Attempts dealt at random over micro-batches are counted as if they had come in order."""
    r = random.Random(3)
    A.with_state_store(spark)
    rows = [(f"f{r.randint(0, 5)}", 1_700_000_000 + 10 * i, i, r.randint(1, 2), r.choice([1.0, None]), r.random() < 0.2) for i in range(240)]
    late = sorted(rows, key=lambda x: x[1] + r.uniform(0, 280))  # up to 280 s late
    frame = lambda part: spark.createDataFrame(part, "path string, s long, seq long, size long, mtime double, ok boolean").select("path", F.timestamp_seconds("s").alias("at"), "seq", "size", "mtime", "ok")
    for n in range(8):
        frame(late[30 * n : 30 * n + 30]).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    end = [("end", 1_700_100_000, 999, 1, 1.0, True), ("end", 1_700_200_000, 1000, 1, 1.0, True)]
    for n, x in enumerate(end):
        frame([x]).coalesce(1).write.parquet(f"{tmp_path}/in/{8 + n}")

    def run():
        out = A.poison_stream(stream(spark, frame(end).schema, f"{tmp_path}/in"), "5 minutes")
        out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()

    run()
    run()  # a restart with nothing new
    got = spark.read.parquet(f"{tmp_path}/out").where("path <> 'end'")
    expect = A.poison_state(frame(rows))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expect.collect())) and got.count() == 240


def reply(filename, at, kinds, delivery=1, done=False, ok=True):
    """One slice: a row for each letter: g good, s skipped, v without vector, t bad times, w no words."""
    made = []
    for i, k in enumerate(kinds):
        t0, t1 = float(at + i), float("nan") if k == "t" and i % 2 else float(at + i - (1 if k == "t" else -1))
        text = "la" if k == "w" else f"  the words of   {filename} number {at + i} "
        made.append((filename, at, i, len(kinds), done, ok, k == "s", t0, t1, text, None, None if k == "v" else [1.0, 2.0], delivery))
    return made or [(filename, at, None, 0, done, ok, None, None, None, None, None, None, delivery)]


def told():
    """Files with several slices; b.mp4 and e.mp4 have nothing to use, c.mp4 ends badly, d.mp4 lacks a slice, f.mp4 has an empty plan."""
    return [
        reply("a.mp4", 0, "ggs"), reply("a.mp4", 3, "gtv"), reply("a.mp4", 6, "wg", done=True),
        reply("b.mp4", 0, "ss"), reply("b.mp4", 2, "sv", done=True), reply("c.mp4", 0, "s", done=True, ok=False),
        reply("d.mp4", 2, "s", done=True), reply("e.mp4", 0, "wt", done=True), reply("f.mp4", 0, "", done=True), reply("g.mp4", 0, "sg", done=True),
    ]


def checked(table, spark):
    rows = table.rows().collect()
    assert sorted((r.filename, r.from_index, r.i) for r in rows) == [("a.mp4", 0, 0), ("a.mp4", 0, 1), ("a.mp4", 3, 0), ("a.mp4", 6, 1), ("g.mp4", 0, 1)]
    assert sorted(r.off for r in rows) == list(range(5)) and all(r.n == 1 and "  " not in r.text for r in rows)
    for key in {(r.filename, r.from_index) for r in rows}:  # a slice's vectors lie together, in order
        offs = [r.off for r in sorted(rows, key=lambda r: r.i) if (r.filename, r.from_index) == key]
        assert offs == list(range(offs[0], offs[0] + len(offs)))
    assert sorted((r.filename, r.skipped) for r in table.parked().collect()) == [("b.mp4", 4), ("e.mp4", 2)]
    reasons = {(r.filename, r.from_index + r.i): r.reason for r in table.skipped().collect()}
    assert reasons[("a.mp4", 4)] == "times" and reasons[("a.mp4", 5)] == "no vector" and reasons[("a.mp4", 6)] == "no speech" and reasons[("a.mp4", 2)] == "skipped"
    assert len(reasons) == 13


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_child_rows_once(spark, tmp_path, seed):
    """Slices shuffled over micro-batches, some sent again: the same rows as one delivery."""
    r = random.Random(seed)
    slices = told()
    again = [[(*row[:9], "other words that are never taken", *row[10:12], 2) for row in s] for s in r.sample(slices, 4)]
    order = slices + again
    if seed:
        r.shuffle(slices)
        order = slices + again  # a resend never overtakes its first delivery
    for n, s in enumerate(order):
        feed(spark, s, C.REPLIES, f"{tmp_path}/in", n)
    schema = spark.createDataFrame([], C.REPLIES).schema
    table = C.ChildRows(spark, f"file://{tmp_path}/table")
    table.follow(stream(spark, schema, f"{tmp_path}/in"), f"{tmp_path}/state", once=True).awaitTermination()
    checked(table, spark)
    twin = C.child_rows(spark.createDataFrame([x for s in order for x in s], C.REPLIES), f"{tmp_path}/twin")
    shape = lambda df: sorted((x.filename, x.from_index, x.i, x.t0, x.t1, x.text, x.vec, x.n) for x in df.collect())
    assert shape(twin) == shape(table.rows()) and sorted(x.off for x in twin.collect()) == list(range(5))
    parked = C.unusable(table.slices(), spark.createDataFrame([("e.mp4",)], "filename string")).collect()
    assert [x.filename for x in parked] == ["b.mp4"]  # e.mp4 is covered by something else


def test_restart_in_a_batch(spark, tmp_path, monkeypatch):
    """A batch that dies between its data and its entry counts once after the restart, and one that dies after its entry isn't taken again."""
    for n, s in enumerate(told()):
        feed(spark, s, C.REPLIES, f"{tmp_path}/in", n)
    schema = spark.createDataFrame([], C.REPLIES).schema
    table = C.ChildRows(spark, f"file://{tmp_path}/table")
    go = lambda: table.follow(stream(spark, schema, f"{tmp_path}/in"), f"{tmp_path}/state", once=True).awaitTermination()
    append = manifest.Log.append
    for stop, after in ((3, False), (6, True)):
        def dying(self, number, entry, stop=stop, after=after):
            if number == stop:
                if after:
                    append(self, number, entry)
                raise RuntimeError("the driver is gone")
            append(self, number, entry)

        monkeypatch.setattr(manifest.Log, "append", dying)
        with pytest.raises(Exception, match="the driver is gone"):
            go()
    monkeypatch.setattr(manifest.Log, "append", append)
    go()
    checked(table, spark)
    assert table.log.numbers() == list(range(1, 11))
    table.compact()
    checked(table, spark)
    gone = table.forget()
    assert len(gone) == 40 and table.log.numbers() == [11]
    checked(table, spark)
    assert not table.add(spark.createDataFrame([], schema), {"query": next(iter(table.log.last()[1]["seen"])), "batch": 3})


def test_two_writers(spark, tmp_path):
    """Who prepared a number that another has claimed is told, and nothing of theirs counts."""
    table = C.ChildRows(spark, f"file://{tmp_path}/table")
    batch = spark.createDataFrame(told()[0], C.REPLIES)
    assert table.add(batch, {"query": "x", "batch": 0}) and not table.add(batch, {"query": "x", "batch": 0})
    number, last = table.log.last()
    table.log.append(number + 1, last | {"seen": last["seen"] | {"y": 0}})
    with pytest.raises(manifest.Lost):
        table.log.append(number + 1, last)
    assert table.rows().count() == 2 and table.add(batch, {"query": "x", "batch": 1}) and table.rows().count() == 2
    log = manifest.Log(spark, f"file://{tmp_path}/other")
    made = f"file://{tmp_path}/made"
    for _ in range(2):
        manifest.write_text(spark, made, "{}")
        taken = manifest.claim(spark, made, f"file://{tmp_path}/name")
    assert not taken and log.last() == (0, None)


def test_scenes_need_a_vector_only(spark):
    rows = spark.createDataFrame(reply("a.mp4", 0, "gstvw"), C.REPLIES)
    good, bad = C.split_reply(rows, speech=False)
    assert sorted(r.i for r in good.collect()) == [0, 2, 4] and sorted((r.i, r.reason) for r in bad.collect()) == [(1, "skipped"), (3, "no vector")]
