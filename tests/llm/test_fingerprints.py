"""Fingerprints against multisets of parts and a plain chain of documents."""

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from memquarry.llm import fingerprints
from test_operators import docs, frame, none, odd, texts  # noqa: F401


def ratio(a, b):
    a, b = (collections.Counter(fingerprints.digests(t).tolist()) for t in (a, b))
    both = sum((a | b).values())
    return sum((a & b).values()) / both if both else 1.0


def chain(rows):
    rows = sorted(rows, key=lambda r: r[0], reverse=True)
    return {d: (t or "", rows[(i + 1) % len(rows)][1] or "") for i, (d, t) in enumerate(rows)}


def test_parts_make_the_text():
    for t in [t for _, t in texts() if t] + ["a. b! c?\n\nd", "no mark", "...", "x " * 900]:
        parts = [p for p in fingerprints.PART.findall(t) if p]
        assert "".join(parts) == t
    assert len(fingerprints.digests("word " * 3000)) and len(fingerprints.digests("")) == 0
    long = " ".join(f"w{i}" for i in range(2000))
    assert len(fingerprints.digests(long)) > 50 and ratio(long, long[: len(long) // 2]) > 0.4


@pytest.mark.parametrize("cells", [24, 6])
def test_fingerprints(spark, docs, cells):  # noqa: F811
    rows = [(d, (t or "") and ". ".join((t or "").split(" "))) for d, t in texts()]
    got = {r.doc_id: r for r in fingerprints.fingerprints(spark, frame(spark, rows), cells).collect()}
    expect = chain(rows)
    assert got.keys() == expect.keys()
    prints = {}
    for d, (own, following) in expect.items():
        half = len(own) // 2
        new = own[: len(own) - half] + following[:half]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(own), hashlib.sha256(new.encode()).hexdigest())
        assert r.near_edited == pytest.approx(ratio(own, new)) and r.near_next == pytest.approx(ratio(own, following))
        for text, p in ((own, r.fingerprint), (new, r.edited_fingerprint)):
            assert prints.setdefault(text, p) == p
    assert len(set(prints.values())) == len(prints)


@pytest.mark.parametrize("n", ["1", "3", "40"])
def test_ranges(spark, n):
    """However many ranges there are, every document meets the one after it."""
    rows = [(i * 3, f"text {i}. more") for i in range(150)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", n)
    try:
        got = fingerprints.fingerprints(spark, frame(spark, rows)).select("doc_id", "edited_sha256").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert dict(map(tuple, got)) == {d: hashlib.sha256(fingerprints.edited(*x).encode()).hexdigest() for d, x in chain(rows).items()}


def test_odd_fingerprints(spark, odd, none):  # noqa: F811
    got = fingerprints.fingerprints(spark, odd).collect()
    assert len(got) == odd.count() and sum(r.doc_id is None for r in got) == 1
    assert fingerprints.fingerprints(spark, none).count() == 0
    (one,) = fingerprints.fingerprints(spark, odd.where("doc_id = 1")).collect()
    assert one.near_next == 1.0 and one.fingerprint == one.edited_fingerprint or one.near_edited < 1.0
    same = spark.range(50).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same. text").alias("text"))
    assert {r.near_next for r in fingerprints.fingerprints(spark, same).collect()} == {1.0}


def test_versions_give_back_what_differs(spark):
    """Recovered digests are those of the parts that only one version has, from few cells and after many retries."""
    r = random.Random(5)
    made = []
    for i, change in enumerate([0, 1, 3, 40, 900]):
        old = [f"line {i} {r.getrandbits(60)}\n" for _ in range(1000)]
        new = [x if j >= change else f"new {j} {i}\n" for j, x in enumerate(old)] + ["line\n", "line\n"] * (i > 1)
        made.append((i, "".join(old), "".join(new)))
    versions = spark.createDataFrame([*made, (10, None, ""), (11, "", "a"), (12, "b. b. b. ", "b. ")], "id int, old string, new string")
    got = {x.id: x for x in fingerprints.compare_versions(versions).collect()}
    for i, old, new in made:
        a, b = (set(fingerprints.digests(t).astype(np.int64).tolist()) for t in (old, new))
        assert set(got[i].gone) == a - b and b - a <= set(got[i].added) and len(got[i].added) == len(b - a) + (i > 1)
        assert got[i].likeness == pytest.approx(ratio(old, new))
    assert got[0].cells == 24 and got[4].cells > 1000 and got[0].old_fingerprint == got[0].new_fingerprint
    assert (got[10].likeness, got[11].likeness, len(got[12].gone)) == (1.0, 0.0, 2)


def test_read_back():
    rows = ["a. b. c", "d\ne", ""]
    doc, key = fingerprints.numbered([fingerprints.digests(t) for t in rows])
    made = fingerprints.Sketches.of(doc, key, 3)
    again = fingerprints.Sketches.read(made.texts())
    assert (again.keys == made.keys).all() and (again.count == made.count).all() and (again.check == made.check).all()
    row, k, sign, done = again.minus(np.array([0]), again, np.array([1])).peel()
    assert done.all() and len(k) == 5 and sign.sum() == 1
