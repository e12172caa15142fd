"""Registered queries against their SQL on small tables that are odd or dealt as large ones are."""

import duckdb
import pytest

from memquarry.operators import dialogue, evidence
from memquarry.plans import jobs, moments  # noqa: F401
from memquarry.plans.queries import TABLE

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def dealt(spark):
    """Ranges of a few kilobytes, so that small tables have many, as large ones do."""
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "8k")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    yield
    spark.conf.set(name, before)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def agrees(spark, folder, name):
    c = duckdb.connect()
    for p in folder.glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS FROM read_parquet('{p}/*.parquet')")
    f, sql = TABLE[name]
    expect = c.sql(sql)
    got = [str(tuple(r)) for r in f(spark, str(folder)).select(*expect.columns).collect()]
    assert sorted(got) == sorted(map(str, expect.fetchall()))


def test_import_order_of_many_ranges(spark, dealt, tmp_path):
    """Ranges are cut anew by each evaluation; places are of one of them. Unknown numbers come last of unknown times."""
    docs = spark.range(20000).selectExpr("CASE WHEN id % 501 = 7 THEN NULL ELSE id END AS doc_id", "CAST(id AS string) AS text", "'en' AS lang", "'src1' AS source", "1L AS n_chars")
    docs.repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
    agrees(spark, tmp_path, "import_order")


#: Texts whose addresses are easily missed, or seen where there are none.
ADDRESSED = [
    "end of la at.16@mail8.example.com. More", "at@b.org", "a@dot.com", "info@at.example", "look.at.me@b.org", "a@b dot dots", "a at b.co at c dot com", "a at b dot c. com", "a\u00a0at b dot com", "a\u000bat b dot com", "a at b dot com",
    "a@b.com\u0131", "\u212a@b.com", "a@b.\u017fe", "a@b.c", "a@b.c0m", "a@b,com", "a [at] b. com", "a [at] b dot", "interned at Acme.AI", "Rock at the park dot org", "a@" + "b-dot-" * 60 + "!", "a@" + "b.c" * 9000 + "9", "x" * 20000 + " a <AT> b {dots} org", "", None, "at", "@",
]


def library_of(spark, folder, texts):
    """Documents and the tables that queries are made of."""
    docs = [(i, t, "en", f"src{i % 5}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, DOCUMENT).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.range(30).selectExpr("id AS vec_id", "transform(sequence(1, 64), i -> CAST(sin(i * (id + 1)) AS float)) AS embedding", "CAST(0 AS int) AS label").write.parquet(f"{folder}/embeddings.parquet")
    spark.range(8).selectExpr("id AS item_id", "concat('word', id, ' of src', id, ' and more') AS text").write.parquet(f"{folder}/benchmark.parquet")


def test_email_flags(spark, tmp_path):
    library_of(spark, tmp_path, ADDRESSED)
    agrees(spark, tmp_path, "email_flags")


def test_tab_counts(spark, tmp_path):
    library_of(spark, tmp_path, [f"{t or ''} {i}" for i, t in enumerate(ADDRESSED * 3)])
    agrees(spark, tmp_path, "tab_counts")


def test_tab_rows(spark, tmp_path):
    library_of(spark, tmp_path, [f"{t or ''} {i}" for i, t in enumerate(ADDRESSED * 3)])
    agrees(spark, tmp_path, "tab_rows")


def test_scopes(spark, tmp_path):
    library_of(spark, tmp_path, [f"{t or ''} {i}" for i, t in enumerate(ADDRESSED * 3)])
    agrees(spark, tmp_path, "scopes")


def test_evidence_prompt_of_long_films(spark, tmp_path):
    """Films of more than 100 minutes: the query writes times as its SQL does, the operator writes them whole."""
    library_of(spark, tmp_path, ["one word0 src3", "two word1", None, "more"])
    spark.range(20000).selectExpr("id AS vec_id", "transform(sequence(1, 4), i -> CAST(sin(i * (id + 1)) AS float)) AS embedding", "CAST(0 AS int) AS label").write.mode("overwrite").parquet(f"{tmp_path}/embeddings.parquet")
    agrees(spark, tmp_path, "evidence_prompt")
    said = spark.createDataFrame([(1, 1, "dialogue", "a.mp4", 12253.5, "x")], "query_id long, position int, kind string, filename string, t double, text string")
    asked = spark.createDataFrame([(1, "q")], "query_id long, text string")
    assert 'at 204:13: "x"' in evidence.evidence_prompt(asked, said).first().user


def test_dialogue_search_cuts_texts_once(spark):
    """What is found in texts is stored before it is joined, and queries with the same keys are one search."""
    films = spark.createDataFrame([(i, f"the night is young {i}") for i in range(40)], "id long, text string")
    some = spark.range(0, 40, 4).join(films, "id").selectExpr("'a.mp4' AS filename", "id AS line", "id * 7.0D AS t0", "id * 7.0D + 5 AS t1", "text")
    queries = spark.createDataFrame([(5, "young nights"), (3, "Young night!"), (4, "the 36"), (6, None)], "query_id long, text string")
    hits = dialogue.exact_hits(queries, some)
    assert "ArrowEvalPython" not in hits._jdf.queryExecution().executedPlan().toString()
    got = dialogue.search_dialogue(queries, some, per_video=24).orderBy("query_id", "rank").collect()
    of = {q: [tuple(r)[1:] for r in got if r.query_id == q] for q in (3, 4, 5, 6)}
    assert of[3] == of[5] and len(of[3]) == 10 and [x[1] for x in of[4]] == ["a.mp4"] and not of[6]
