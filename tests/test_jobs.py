"""Rules that no SQL repeats, or that the given tables don't exercise: against plain loops and small fixtures."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from memquarry.functions import dialogue as D
from memquarry.functions import emails as E
from memquarry.operators import dialogue, evidence, films, imports, library, merges, ocr, search, transcripts
from memquarry.sources import store

LINES = [
    ("hangover.mp4", 100.0, 106.0, "I just love a shot here. The night is young"), ("hangover.mp4", 200.0, 208.0, "We took on Bangkok and we won. I love you guys"),
    ("hangover.mp4", 300.0, 306.0, "Well done, too. Huh? All of your own business"), ("sicario.mp4", 50.0, 56.0, "Is he CIA? Are you? He is a DOD advisor"),
    ("party.mp4", 10.0, 14.0, "Are you loving it right now, the party never stops"), ("party.mp4", 20.0, 24.0, "The birthday celebration continues all night long"),
]


def test_keys():
    key = D.dialogue_key
    for same in (("love", "loves", "loved", "loving"), ("party", "parties"), ("fly", "flying", "flies"), ("price", "pricing"), ("CIA", "c.i.a"), ("Love!", "(love)"), ("cafés", "cafe")):
        assert len({key(w) for w in same}) == 1, same
    for other in (("car", "carpet"), ("ai", "air"), ("party", "part")):
        assert key(other[0]) != key(other[1])
    assert [key(w) for w in ("a", "!!!", "", None)] == [""] * 4
    assert {w: D.porter_stem(w) for w in ("parties", "flying", "flies", "caresses", "hopping", "relational", "adjustment", "controll", "probate", "agreed", "sky")} == {
        "parties": "parti", "flying": "fly", "flies": "fli", "caresses": "caress", "hopping": "hop", "relational": "relat", "adjustment": "adjust", "controll": "control", "probate": "probat", "agreed": "agre", "sky": "sky",
    }


def test_tokens_and_snippets():
    assert D.tokens_of("Hi 멤버들의, 駅") == [("Hi", "hi", 0, 2), ("멤버", "멤버", 3, 5), ("버들", "버들", 4, 6), ("들의", "들의", 5, 7), ("駅", "駅", 9, 10)]
    assert D.snippet_of("x " * 100 + "멤버들의 end", {"멤버", "버들"}, 5) == ("…x x 멤버들의 end", 6, 3) or D.snippet_of("x " * 100 + "멤버들의 end", {"멤버", "버들"}, 5)[2] == 3
    assert D.snippet_of("short text", {"zzz"}, 3) == ("short ", 0, 0)


def brute_dialogue(query, docs, k=24, per_video=3, seconds=8.0):
    """The rule as a loop over films and lines."""
    wanted, hits = [t[1] for t in D.tokens_of(query)], []
    if not wanted:
        return []
    for film in sorted({d[0] for d in docs}):
        rows = sorted((t0, t1, i, [t[1] for t in D.tokens_of(text)]) for i, (f, t0, t1, text) in enumerate(docs) if f == film and t1 > t0 and text.strip() and D.tokens_of(text))
        phrases = set()
        for t0, t1, i, keys in rows:
            if any(keys[s : s + len(wanted)] == wanted for s in range(len(keys))):
                phrases.add((t0, t1))
                hits.append((1, -len(wanted), t1 - t0, t0, film, i, t1))
        for a, (t0, t1, i, keys) in enumerate(rows):
            union, occ = set(), 0
            for b in range(a, len(rows)):
                if b > a and rows[b][0] - t0 > seconds:
                    break
                union |= set(rows[b][3])
                occ += sum(x in wanted for x in rows[b][3])
                if set(wanted) <= union:
                    if not (b == a and (t0, t1) in phrases):
                        hits.append((3 if b == a and rows[b][1] - t0 > seconds else 2, -occ, rows[b][1] - t0, t0, film, i, rows[b][1]))
                    break
    seen, count, out = set(), {}, []
    for tier, occ, span, t0, film, i, _ in sorted(hits):
        if (film, tier, math.floor(t0)) in seen:
            continue
        seen.add((film, tier, math.floor(t0)))
        if count.get(film, 0) >= per_video or len(out) >= k:
            continue
        count[film] = count.get(film, 0) + 1
        out.append((film, tier, i, round(4 - tier + min(-occ, 8) * 0.01 - min(span, 300) * 0.0005, 9), max(0.0, t0 - 3), max(0.5, span)))
    return sorted(out, key=lambda r: -r[3])


def test_dialogue(spark):
    r = random.Random(5)
    words = "love night party young guys won the all you never".split()
    docs = LINES + [(f"f{i % 3}.mp4", t := r.randint(0, 60) / 2, t + r.choice([2.0, 4.0, 12.0]), " ".join(r.choice(words) for _ in range(r.randint(1, 6)))) for i in range(90)] + [("z.mp4", 1.0, 0.0, "love"), ("z.mp4", 1.0, 2.0, " ")]
    lines = spark.createDataFrame([(f, i, a, b, t) for i, (f, a, b, t) in enumerate(docs)], "filename string, line long, t0 double, t1 double, text string")
    asked = ["love you", "loves", "night party", "the party never", "young guys won all", "DOD advisor", "zebra", "", "you you love", "all night long"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, text string")
    segments = spark.createDataFrame([("party.mp4", 12.0, 4.0, 7), ("party.mp4", 30.0, 4.0, 8)], "filename string, t double, dur double, poster long")
    got = dialogue.search_dialogue(queries, lines, segments).toPandas().sort_values(["query_id", "rank"])
    for i, q in enumerate(asked):
        mine = got[got.query_id == i]
        expect = brute_dialogue(q, docs)
        assert [round(x, 9) for x in mine.score] == [e[3] for e in expect], q
        assert sorted(zip(mine.filename, mine.tier, mine.t, mine.dur)) == sorted((f, t, a, d) for f, t, _, _, a, d in expect), q
    party = got[(got.query_id == 3) & (got.filename == "party.mp4")].iloc[0]
    assert (party.poster, party.label, party.snippet[party.match_start :][: party.match_len]) == (7, "Exact line", "the")


def test_dialogue_index(spark, tmp_path):
    """A stored index gives the same hits; it is read by key, and films that lack a key go before places are read."""
    r = random.Random(6)
    words = "love night party young guys won the all you never rare".split()
    rows = [(f"f{i % 7}.mp4", i, t := r.randint(0, 90) / 2, t + r.choice([2.0, 4.0, 12.0]), " ".join(r.choice(words[: 10 if i % 7 else 11]) for _ in range(r.randint(0, 7)))) for i in range(300)]
    lines = spark.createDataFrame(rows, "filename string, line long, t0 double, t1 double, text string")
    queries = spark.createDataFrame(list(enumerate(["the rare night", "love", "you you never", "rare rare", "unheard love", "all guys won", "never never never"])), "query_id long, text string")
    dialogue.write_dialogue_index(lines, f"{tmp_path}/index")
    index = dialogue.read_dialogue_index(spark, f"{tmp_path}/index")
    stored = dialogue.exact_hits(queries, None, index=index)
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, dialogue.exact_hits(queries, lines).collect())) and stored.count() > 50
    assert {x.filename for x in stored.where("query_id IN (0, 3)").collect()} == {"f0.mp4"} and not stored.where("query_id = 4").count()
    plan = stored._jdf.queryExecution().executedPlan().toString()
    assert "In(key, [" in plan and "PartitionFilters: [bucket" in plan and " all#" not in plan
    shown = dialogue.search_dialogue(queries, lines, index=index).orderBy("query_id", "rank").collect()
    assert shown == dialogue.search_dialogue(queries, lines).orderBy("query_id", "rank").collect()


def test_exact_hits_of_a_long_line(spark):
    lines = spark.createDataFrame([("a.mp4", 0, 0.0, 30.0, "one two"), ("a.mp4", 1, 40.0, 41.0, "one"), ("a.mp4", 2, 47.0, 49.0, "two")], "filename string, line long, t0 double, t1 double, text string")
    got = dialogue.exact_hits(spark.createDataFrame([(1, "two one")], "query_id long, text string"), lines).collect()
    assert sorted((r.tier, r.line, r.end) for r in got) == [(2, 1, 49.0), (3, 0, 30.0)]


EMAILS = [
    ("allen@example.com", ["allen@example.com"]), ("Contact me at bob.smith+tag@sub.example.co.uk or call the office", ["bob.smith+tag@sub.example.co.uk"]), ("Email: ME@EXAMPLE.COM", ["me@example.com"]), ("Reach out: allen@example.com, thanks", ["allen@example.com.thanks"]),
    ("allen@example,com", ["allen@example.com"]), ("allen at gmail dot com", ["allen@gmail.com"]), ("Contact allen AT gmail DOT com today", ["allen@gmail.com"]), ("support [at] example [dot] com", ["support@example.com"]), ("support(at)example(dot)com", ["support@example.com"]), ("allen@gmail dot com", ["allen@gmail.com"]),
    ("meet me at the office", []), ("polka dot dress", []), ("Rock at the park dot org", []), ("allen at gmail.com", []), ("and interned at Acme.AI (a VC firm)", []), ("celeste li@example.com", ["celeste_li@example.com"]), ("Contact li@example.com", ["li@example.com"]), ("a@x.com and b@y.org", ["a@x.com", "b@y.org"]), ("", []), (None, []),
]


def test_emails(spark):
    """A comma counts as a dot, so that a word after it can pass for the last part, as the rule has it."""
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(EMAILS)], "i long, t string")
    got = {r.i: [m.address for m in r.m] for r in df.select("i", E.extract_emails(F.col("t")).alias("m")).collect()}
    assert {i: got[i] for i in got} == {i: e for i, (_, e) in enumerate(EMAILS)}
    said = df.where("i IN (5, 7, 4, 0)").select("i", E.email_evidence(F.get(E.extract_emails(F.col("t")), F.lit(0))).alias("s")).collect()
    assert {r.i: r.s for r in said} == {0: "Found in photo text", 4: 'Found as "allen@example,com"', 5: 'Found as "allen at gmail dot com" (spelled-out at/dot)', 7: 'Found as "support [at] example [dot] com" (obfuscated at/dot)'}


def test_glued_words(spark):
    word = lambda t, c, *box: (t, float(c), *map(float, box))
    rows = [
        ("a", [word("jordan", 74, 1076, 145, 1160, 185), word("parkes9@example", 68, 1080, 149, 1400, 190), word("com", 68, 1433, 145, 1500, 185)]),
        ("b", [word("contact", 90, 0, 0, 80, 20), word("me", 90, 90, 0, 120, 20), word("@", 80, 130, 0, 145, 20), word("work.", 85, 155, 0, 210, 20)]),
        ("c", [word("see", 90, 0, 0, 50, 20), word("li@x.co", 90, 60, 0, 120, 20), word(".uk", 90, 121, 0, 140, 20), word("or", 90, 150, 0, 170, 20)]),
        ("d", None),
    ]
    raw = spark.createDataFrame([(f, w, 1658, 1342) for f, w in rows], f"filename string, words {ocr.WORDS}, width int, height int")
    got = {r.filename: r.words for r in ocr.glue_email_words(raw).collect()}
    assert [w.text for w in got["a"]] == ["jordan.parkes9@example.com"] and tuple(got["a"][0])[1:] == (74.0, 1076.0, 145.0, 1500.0, 190.0)
    assert [w.text for w in got["b"]] == ["contact", "me", "@", "work."] and [w.text for w in got["c"]] == ["see", "li@x.co.uk", "or"] and got["d"] is None
    assert ocr.ocr_text(ocr.glue_email_words(raw).withColumn("raw", F.lit(" x \r\n\n y  z "))).where("filename IN ('a', 'd')").orderBy("filename").select("ocr").collect() == [("jordan.parkes9@example.com",), ("x y z",)]


def test_windows(spark):
    r = random.Random(2)
    lines = []
    for f in "ab":
        t = 0.0
        for i in range(80):
            t += r.choice([0.5, 3.0, 9.0])
            lines.append((f, t, t + r.choice([2.0, 4.0]), f"line number {i} of {f}" + r.choice([".", "", "?"])))
    got = transcripts.transcript_windows(spark.createDataFrame(lines, "filename string, t0 double, t1 double, text string")).toPandas().sort_values(["filename", "i"])
    for f in "ab":
        rows, i, expect = [x[1:] for x in lines if x[0] == f], 0, []
        while i < len(rows):
            j, end = i, rows[i][1]
            while j < len(rows) and rows[j][0] < rows[i][0] + 30:
                end, j = max(end, rows[j][1]), j + 1
            if j < len(rows) and rows[j - 1][2][-1] not in ".?" and rows[j][0] - end < 8:
                end, j = max(end, rows[j][1]), j + 1
            expect.append((rows[i][0], end, " ".join(x[2] for x in rows[i:j])[:240]))
            after = [n for n in range(i + 1, j) if rows[n][1] > end - 5] if end - rows[i][0] >= 30 else []
            i = after[0] if after else j
        mine = got[got.filename == f]
        assert list(zip(mine.t0, mine.t1, mine.text)) == expect


def test_sampled_shots(spark):
    r = np.random.default_rng(1)
    t = np.sort(r.uniform(0, 600, 90))
    shots = spark.createDataFrame([("f", float(x), 1.0) for x in t], "filename string, t double, dur double")
    got = sorted(x.t for x in films.sample_shots(shots, spark.createDataFrame([("f", 600.0)], "filename string, duration double"), "eco").collect())
    free, expect = list(t), []
    for i in range(10):
        best = min(free, key=lambda x: abs(x - (i + 0.5) * 60))
        free.remove(best)
        expect.append(best)
    assert got == pytest.approx(sorted(expect))
    plan = films.segment_plan(shots.select("filename", "t"), spark.createDataFrame([("f", 600.0), ("g", 100.0), ("h", None)], "filename string, duration double"), "eco")
    assert {r.filename: r["count"] for r in plan.groupBy("filename").count().collect()} == {"f": 10, "g": 4}


def test_names(spark):
    def names(rows, taken=()):
        media = spark.createDataFrame([(t,) for t in taken], "filename string")
        got = library.assign_names(spark.createDataFrame(list(enumerate(rows)), "row_id long, name string"), media).collect()
        return [r.assigned for r in sorted(got)]

    assert names(["a.png", "a.png", "a (2).png"]) == ["a.png", "a (2).png", "a (2) (2).png"]
    assert names(["a (2).png", "a.png", "a.png", "b.png"]) == ["a (2).png", "a.png", "a (3).png", "b.png"]
    assert names(["a.png", "a.png", "b"], ["a.png", "b"]) == ["a (2).png", "a (3).png", "b (2)"]
    assert names(["a.png", "a.png"], ["a (2).png"]) == ["a.png", "a (3).png"]


def plain_names(rows, taken):
    held, out = set(taken), []
    for name in rows:
        ext = name[name.rfind(".") :] if name.rfind(".") > 0 else ""
        stem, pick, n = name[: len(name) - len(ext)], name, 2
        while pick in held:
            pick, n = f"{stem} ({n}){ext}", n + 1
        held.add(pick)
        out.append(pick)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_names_in_order(spark, seed):
    """Numbered names in the batch and in the library, in any order, against a loop."""
    r = random.Random(seed)
    pool = ["a.png", "a (2).png", "a (3).png", "a (4).png", "a (7).png", "a (2) (2).png", "a (02).png", "a (1).png", ".png", "b", "b (2)", "b (3)", "c.tar.gz", "x (2).png", "a\n.png"]
    rows = [r.choice(pool[: r.randint(3, len(pool))]) for _ in range(90)]
    taken = r.sample([*pool, "a (5).png", "a (9).png", "b (5)", ".png (2)", "c.tar (2).gz"], 7)
    media = spark.createDataFrame([(t,) for t in taken], "filename string")
    got = library.assign_names(spark.createDataFrame(list(enumerate(rows)), "row_id long, name string"), media).collect()
    assert [x.assigned for x in sorted(got)] == plain_names(rows, taken)


def test_many_rows_of_one_name(spark):
    """A million rows of one name against a thousand taken numbers: no list in any plan, and every number once."""
    batch = spark.range(1_000_000).select(F.col("id").alias("row_id"), F.lit("a.png").alias("name"))
    media = spark.range(1000).select(F.format_string("a (%d).png", F.col("id") * 3 + 4).alias("filename"))
    out = library.assign_names(batch, media)
    plan = out._jdf.queryExecution().toString()
    assert "collect_" not in plan and "array<" not in plan
    number = F.regexp_extract("assigned", r"\((\d+)\)", 1).try_cast("long")
    got = out.withColumn("number", number).agg(F.count_distinct("assigned"), F.max("number"), F.count_if((F.col("number") <= 3001) & (F.col("number") % 3 == 1)), F.count_if(F.col("row_id") == 0)).first()
    assert tuple(got) == (1_000_000, 1_001_000, 0, 1) and out.where("row_id = 0").first().assigned == "a.png"


def test_ties_and_blanks(spark):
    media = spark.createDataFrame([(0, "z.png", [1.0, 0.0], [1.0, 0.0], "cat"), (1, "a.png", [1.0, 0.0], [1.0, 0.0], "cat"), (2, "m.png", None, [0.0, 0.0], None)], "row_id long, filename string, embedding array<double>, phrase array<double>, ocr string")
    queries = spark.createDataFrame([(1, "cat", [1.0, 0.0]), (2, "  ", [1.0, 0.0]), (3, None, [1.0, 0.0])], "query_id long, text string, vec array<double>")
    assert [r.filename for r in search.search_keyword(queries, media).orderBy("rank").collect()] == ["z.png", "a.png"]  # row order
    assert [r.filename for r in search.search_ocr(queries, media).orderBy("rank").collect()] == ["a.png", "z.png"]  # the name
    assert [(r.filename, r.snippet) for r in search.ocr_evidence(queries, media).orderBy("rank").collect()] == [("a.png", "cat"), ("z.png", "cat")]
    found = search.search_files(queries, media).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.filename, r.score, r.dominant) for r in found] == [(1, "z.png", 1.5, "semantic"), (1, "a.png", 1.5, "semantic")]
    empty = queries.where("query_id < 0")
    for f in (lambda q: search.search_files(q, media), lambda q: search.search_keyword(q, media), lambda q: search.ocr_evidence(q, media)):
        assert f(empty).count() == 0 and f(queries).count() > 0


def test_exempt_rows(spark):
    """A row under the cutoff stays if a word of the query is in its text, and one under the floor doesn't."""
    at = lambda c: [c, math.sqrt(1 - c * c)]
    rows = [(0, "a", 0.4, ""), (1, "b", 0.35, ""), (2, "c", 0.3, ""), (3, "d", 0.05, "invoice total"), (4, "e", 0.03, "invoice")]
    media = spark.createDataFrame([(i, n, at(c), [0.0, 0.0], t) for i, n, c, t in rows], "row_id long, filename string, embedding array<double>, phrase array<double>, ocr string")
    got = search.search_files(spark.createDataFrame([(1, "invoice", [1.0, 0.0])], "query_id long, text string, vec array<double>"), media, diverse=False).orderBy("rank").collect()
    assert [r.filename for r in got] == ["d", "a", "b", "c"] and got[0].dominant == "ocr"


def test_cutoff_of_many(spark):
    """The cut by counts against a sort, with one query over many rows and many ties."""
    r = np.random.default_rng(3)
    v = np.round(r.normal(size=(4000, 4)), 1)
    media = spark.createDataFrame([(i, f"n{i}", x.tolist(), [0.0] * 4, "") for i, x in enumerate(v)], "row_id long, filename string, embedding array<double>, phrase array<double>, ocr string").repartition(5)
    q = r.normal(size=4)
    asked = spark.createDataFrame([(1, "zz", q.tolist())], "query_id long, text string, vec array<double>")
    rows = media.withColumn("_words", F.array().cast("array<string>")).withColumn("_name", F.col("filename")).drop("ocr")
    one = search.with_pieces(asked, search.rank_tokens(F.col("text"))).collect()
    norm = np.linalg.norm(v, axis=1) * np.linalg.norm(q)
    cos = np.sort(np.divide(v @ q, norm, out=np.zeros(len(v)), where=norm > 0))[::-1]
    assert search.percentile_cut(rows, one, 0.6)[1] == pytest.approx(cos[math.floor(4000 * 0.4)], abs=1e-11)


def test_cutoff_of_crowded_scores(spark):
    """All scores lie within a millionth, many are one: a place is still found exactly, from few values a step."""
    r = np.random.default_rng(5)
    rows = spark.createDataFrame([(i, float(x)) for i, x in enumerate(np.round(0.7 + r.integers(0, 900_000, 9000) * 1e-12, 12))] + [(9000 + i, 0.700000000005) for i in range(3000)], "row_id long, x double").repartition(4)
    asked = spark.createDataFrame([(1, "zz"), (2, "zz")], "query_id long, text string").collect()
    scores = lambda table: np.stack([table["x"].to_numpy(), -table["x"].to_numpy()])
    every = np.sort([x.x for x in rows.collect()])
    for keep in (0.6, 0.0, 0.999, 1.0):
        place = min(math.floor(len(every) * (1 - keep)) + 1, len(every))
        got = search.percentile_cut(rows, asked, keep, scores)
        assert got[1] == pytest.approx(every[::-1][place - 1], abs=1e-13) and got[2] == pytest.approx(-every[place - 1], abs=1e-13)
    with pytest.raises(ValueError):
        search.percentile_cut(rows, asked, 0.6, lambda t: scores(t) * 9)


@pytest.mark.parametrize("keep", [0.6, 0.97, 1.0])
def test_files_search_needs_no_cutoff(spark, keep):
    """Cut or not, the ranking is that of a plain version; with little to keep the cut is among the best rows."""
    r = np.random.default_rng(6)
    v = np.round(r.normal(size=(700, 3)), 2)
    words = ["cat" if i % 9 == 0 else "dog" for i in range(700)]
    media = spark.createDataFrame([(i, f"n{i}", x.tolist(), [0.0] * 3, w) for i, (x, w) in enumerate(zip(v, words))], "row_id long, filename string, embedding array<double>, phrase array<double>, ocr string").repartition(3)
    q = r.normal(size=3)
    asked = spark.createDataFrame([(1, "cat", q.tolist())], "query_id long, text string, vec array<double>")
    base = np.round(v @ q / (np.linalg.norm(v, axis=1) * np.linalg.norm(q)), 12)
    cut = np.sort(base)[::-1][min(math.floor(700 * (1 - keep)) + 1, 700) - 1]
    share = np.array([w == "cat" for w in words])
    kept = [i for i in range(700) if base[i] >= 0.04 and (base[i] >= cut or share[i])]
    for k in (24, 96):
        expect = sorted(kept, key=lambda i: (-(base[i] + 0.5 * share[i]), -base[i], i))[:k]
        got = search.search_files(asked, media, k=k, keep=keep, diverse=False).orderBy("rank").collect()
        assert [x.filename for x in got] == [f"n{i}" for i in expect]


def test_diversify(spark):
    r = np.random.default_rng(4)
    rows = [(q, i + 1, f"f{i}", (r.normal(size=3) + [3 * (i % 2), 0, 0]).tolist(), "ab"[i % 2]) for q in range(6) for i in range(40)]
    df = spark.createDataFrame(rows, "query_id long, rank int, filename string, embedding array<double>, post string")
    for group in (None, "post"):
        got = merges.diversify(df, 12, 0.92, group).toPandas()
        for q in range(6):
            taken = []
            for x in rows:
                unit = np.array(x[3]) / np.linalg.norm(x[3])
                if x[0] == q and len(taken) < 12 and all(unit @ u <= 0.92 for u, g in taken if group is None or g == x[4]):
                    taken.append((unit, x[4]))
            assert len(got[got.query_id == q]) == (len(taken) if len(taken) >= 3 else 12)


def test_hybrid_diversity(spark):
    """The older ranking with near copies left out, against a plain loop; without the switch they stay."""
    r = np.random.default_rng(9)
    v = np.abs(r.normal(size=(120, 3)))
    v[40:80] = v[:40] + 1e-3
    rows = [(i, f"n{i}.png", None if i == 119 else x.tolist(), [0.0] * 3, "") for i, x in enumerate(v)]
    media = spark.createDataFrame(rows, "row_id long, filename string, embedding array<double>, phrase array<double>, ocr string").repartition(3)
    queries = spark.createDataFrame([(1, "zz", [1.0, 1.0, 1.0]), (2, "n119", [-1.0, 0.5, 0.1])], "query_id long, text string, vec array<double>")
    all_, some = (merges.rank_hybrid(queries, media, k=12, keep=0.5, diverse=d).orderBy("query_id", "rank").toPandas() for d in (False, True))
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    score = unit @ (np.ones(3) / np.sqrt(3))
    order = [i for i in sorted(range(119), key=lambda i: (-np.round(score[i], 12), i)) if score[i] >= 0.5 * score[:119].max()]
    taken = []
    for i in order:
        if len(taken) < 12 and all(unit[i] @ unit[j] <= 0.92 for j in taken):
            taken.append(i)
    names = lambda df: df[df.query_id == 1].filename.tolist()
    assert names(all_) == [f"n{i}.png" for i in order[:12]] and names(some) == [f"n{i}.png" for i in (taken if len(taken) >= 3 else order[:12])]
    assert some[some.query_id == 1]["rank"].tolist() == list(range(1, len(names(some)) + 1)) and names(some) != names(all_)


def test_evidence_numbers(spark):
    def table(n):
        return spark.createDataFrame([(q, i + 1, f"f{i}", 1.0) for q, m in enumerate(n) for i in range(m)], "query_id long, rank int, filename string, score double")

    got = evidence.build_evidence(table([8, 2, 8]), table([8, 3, 0]), table([6, 6, 6])).toPandas()
    def order(q):
        mine = got[got.query_id == q].sort_values("position")
        assert list(mine.position) == list(range(1, len(mine) + 1))
        return "".join(k[0] for k in mine.kind), set(mine.tier)

    assert order(0) == ("d" * 6 + "o" * 6 + "d" * 2 + "o" * 2, {"wide"})
    assert order(1) == ("dd" + "ooo" + "k" * 4, {"standard"})
    assert order(2) == ("d" * 6 + "k" * 4 + "dd" + "kk", {"wide"})


def test_highlight(spark):
    df = spark.createDataFrame([("AI-powered 車站", [("台北車站",), ("air",), ("AI",)]), ("ai,", [("air",), ("AI.",)])], "q string, words array<struct<text:string>>")
    got = [[w.text for w in r.h] for r in df.select(evidence.highlight_words(F.col("q"), F.col("words")).alias("h")).collect()]
    assert got == [["台北車站", "air", "AI"], ["AI."]]


def test_fusion(spark):
    v = spark.createDataFrame([(1, "a", 1.0, 2.0, 5, 0.5), (1, "b", 1.0, 2.0, 6, 0.1)], "query_id long, filename string, t double, dur double, poster long, score double")
    t = spark.createDataFrame([(1, "a", 2.0, 3.0, "hello", 0.0, 0.4), (1, "c", 7.0, 3.0, "there", 1.0, 0.6)], "query_id long, filename string, t double, dur double, snippet string, literal double, score double")
    seg = spark.createDataFrame([("c", 5.0, 1.0, 8), ("c", 20.0, 1.0, 9)], "filename string, t double, dur double, poster long")
    got = dialogue.fuse_moments(v, t, seg).orderBy("rank").collect()
    assert [(r.filename, round(r.score, 6), r.poster, r.why, r.snippet, r.t) for r in got] == [("c", 0.86, 8, "text", "there", 7.0), ("a", 0.44, 5, "both", "hello", 1.0)]
    assert dialogue.fuse_moments(v, t.limit(0), None, visual_total=20).count() == 1  # 1 of 20 is above
    flood = spark.createDataFrame([(1, f"v{i}", 1.0, 1.0, 1, 0.9) for i in range(20)], v.schema)
    assert dialogue.fuse_moments(flood, t.limit(0), None, visual_total=20).count() == 0 and dialogue.fuse_moments(flood, t.limit(0), None, visual_total=200).count() == 20


def test_utterances_or_chunks(spark):
    kind = "filename string, line long, t0 double, t1 double, text string"
    said, coarse = spark.createDataFrame([("a", 0, 0.0, 1.0, "x")], kind), spark.createDataFrame([("a", 0, 0.0, 9.0, "X"), ("b", 0, 0.0, 9.0, "Y")], kind)
    scoped = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b")], "query_id long, filename string")
    assert sorted((r.query_id, r.text) for r in dialogue.utterances_or_chunks(scoped, said, coarse).collect()) == [(1, "x"), (2, "Y")]


def test_reembed_plan(spark):
    kind = "filename string, at long, embedding array<float>, phrase array<float>"
    rows = [("a", 2, [0.0], [1.0]), ("a", 1, [1.0], [1.0]), ("b", 1, [1.0], None), ("c", 1, [0.0, 0.0], [1.0])]
    cached, media = spark.createDataFrame(rows, kind), spark.createDataFrame([(x,) for x in "abcd"], "filename string")
    plan = lambda meta: {r.filename: r.reason for r in store.plan_reembed(media, cached, meta, 1, 2).collect()}
    good = {"code_version": 1, "dim": 2, "count": 4}
    assert plan(good) == {"a": "reused", "b": "zero", "c": "zero", "d": "absent"}
    for change, reason in (({"code_version": 2}, "code version"), ({"dim": 3}, "dim"), ({"count": 3}, "count")):
        assert set(plan(good | change).values()) == {reason}
    assert set(plan(None).values()) == {"no meta"}


def test_scan_and_watch(spark, tmp_path):
    from memquarry.streaming import arrivals

    (tmp_path / "in" / "sub").mkdir(parents=True)
    for name in ("a.png", "b.txt", "sub/c.MP4"):
        (tmp_path / "in" / name).write_bytes(b"x")
    found = imports.scan_media(spark, [f"file://{tmp_path}/in"]).collect()
    assert sorted(r.path.rpartition("/")[2] for r in found) == ["a.png", "c.MP4"] and found[0].size == 1
    paths = imports.expand_paths(spark, [(f"file://{tmp_path}/in", True), ("/x/y.doc", False)])
    assert {r.path.rpartition("/")[2]: r.supported for r in paths.collect()} == {"a.png": True, "c.MP4": True, "y.doc": False}
    taken = []
    watch = lambda: arrivals.ingest(arrivals.watch_folder(spark, f"file://{tmp_path}/in"), lambda batch, _: taken.extend(r.path for r in batch.collect()), f"file://{tmp_path}/state", once=True).awaitTermination()
    watch()
    (tmp_path / "in" / "d.jpg").write_bytes(b"y")
    watch()
    assert [p.rpartition("/")[2] for p in sorted(taken, key=lambda p: p.rpartition("/")[2])] == ["a.png", "c.MP4", "d.jpg"]


def test_calibrate_lengths(spark):
    v = spark.createDataFrame([([0.02, 0.0], "a"), ([0.5, 0.5], "b")], "embedding array<double>, model_id string")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0])], "query_id long, vec array<double>")
    got = {r.model_id: r.min_score for r in library.calibrate(v, q).collect()}
    assert got == {"a": 0.04, "b": 0.1}
    genuine = spark.createDataFrame([(3, [0.1, 0.0])], "query_id long, vec array<double>")
    assert {r.model_id: r.min_score for r in library.calibrate(v, q, genuine).collect()} == {"a": 0.01, "b": 0.025}


def test_nearest_poster(spark):
    """Stretches of ten seconds against a plain search."""
    r = random.Random(8)
    segments = [(f"f{i % 2}", r.randint(0, 100) / 2, i) for i in range(25)]
    hits = [(i, f"f{i % 3}", r.randint(-10, 240) / 4) for i in range(120)]
    got = library.nearest_poster(spark.createDataFrame(hits, "hit_id long, filename string, t double"), spark.createDataFrame(segments, "filename string, t double, poster long"), 10.0)
    got = {x.hit_id: x.poster for x in got.collect()}
    for i, f, t in hits:
        own = [s for s in segments if s[0] == f]
        assert got[i] == (min(own, key=lambda s: (abs(s[1] - t), s[1], s[2]))[2] if own else None)


def test_probe():
    import struct
    import zlib

    from memquarry.functions.probe import says_screenshot

    png = lambda kind, body: b"\x89PNG\r\n\x1a\n" + struct.pack(">I4s", len(body), kind) + body + bytes(4)

    def tiff(o):
        head = {"<": b"II*\0", ">": b"MM\0*"}[o] + struct.pack(o + "I", 8) + struct.pack(o + "HHHII", 1, 0x8769, 4, 1, 24) + bytes(2)
        return head + struct.pack(o + "HHHII", 1, 0x9286, 7, 28, 38) + b"UNICODE\0" + "Screenshot".encode("utf-16-le" if o == "<" else "utf-16-be")

    for body in (png(b"tEXt", b"Software\0My Screenshot"), png(b"zTXt", b"k\0\0" + zlib.compress(b"screenshot")), png(b"iTXt", b"k\0\0\0en\0t\0SCREENSHOT")):
        assert says_screenshot(body)
        assert not says_screenshot(body[:20])
    for o in "<>":
        e = tiff(o)
        assert says_screenshot(png(b"eXIf", e)) and says_screenshot(b"\xff\xd8\xff\xe1" + struct.pack(">H", len(e) + 8) + b"Exif\0\0" + e)
    for body in (None, b"", b"screenshot", b"\xff\xd8\xff", png(b"tEXt", b"a\0b"), png(b"eXIf", b"MM")):
        assert not says_screenshot(body)
