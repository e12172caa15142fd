"""Scopes of questions, evidence for them, and the text that carries it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.emails import has_email
from ..functions.media import is_video
from ..functions.texts import padded_timecode, truncate_text
from ..functions.tokens import contains_cjk, let, rank_tokens, word_tokens
from .search import anew

# Scopes, and how many rows of each kind evidence has (dialogue, text, names, in all).
SCOPES = ["all", "screenshots", "videos", "email"]
STANDARD, WIDE = {"dialogue": 6, "ocr": 6, "keyword": 4, "total": 12}, {"dialogue": 8, "ocr": 8, "keyword": 6, "total": 16}
KINDS = ["dialogue", "ocr", "keyword"]
#: What the model that answers is told, unless the caller says something else.
SYSTEM = (
    "The user asks about photos and videos of their own. Below the question stand numbered rows found for it. Rest every statement on "
    "those rows and put the numbers it rests on behind it as [n]. Name the film and the time where something was said. Where the rows "
    "don't hold the answer, say so, and add nothing that they don't hold. Four sentences are enough."
)


def parse_scope(queries: DataFrame) -> DataFrame:
    """A leading `/scope` becomes a column and leaves the text; an unknown one stays text."""
    text = F.trim(F.coalesce("text", F.lit("")))
    lead = r"^/([A-Za-z]+)\b[\s,]*"
    word = F.lower(F.regexp_extract(text, lead, 1))
    known = word.isin(SCOPES)
    return queries.withColumn("scope", F.when(known, word).otherwise("all")).withColumn("text", F.when(known, F.trim(F.regexp_replace(text, lead, ""))).otherwise(text))


def apply_scope(queries: DataFrame, media: DataFrame) -> DataFrame:
    """queries(query_id, scope), media(filename, category, ocr) -> query_id, filename. Files
    and queries meet on scopes: a file has a row for each scope that it is in."""
    of = F.filter(F.array(F.lit("all"), F.when(is_video(F.col("filename")), F.lit("videos")), F.when(F.col("category") == "Screenshots", F.lit("screenshots")), F.when(has_email(F.col("ocr")), F.lit("email"))), lambda s: s.isNotNull())
    wanted = [r.scope for r in queries.select("scope").distinct().limit(len(SCOPES)).collect()]
    rows = media.withColumn("scopes", of).select("filename", F.explode("scopes").alias("scope")).where(F.col("scope").isin(wanted))
    return rows.join(queries.select("query_id", "scope"), "scope").select("query_id", "filename")


def validate_scope(scoped: DataFrame, media: DataFrame) -> DataFrame:
    """Names that the library has, once each."""
    return scoped.where(F.col("filename").isNotNull()).distinct().join(media.select("filename").distinct(), "filename", "left_semi")


def split_scope(scoped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(photos, videos)"""
    return scoped.where(~is_video(F.col("filename"))), scoped.where(is_video(F.col("filename")))


def dialogue_evidence(moments: DataFrame, snippet: int = 300) -> DataFrame:
    """Rows of search_dialogue as evidence."""
    return moments.select("query_id", F.lit("dialogue").alias("kind"), "rank", "filename", "score", "t", truncate_text(F.col("snippet"), snippet).alias("text"))


def build_evidence(dialogue: DataFrame, ocr: DataFrame, keyword: DataFrame) -> DataFrame:
    """(query_id, rank, filename, score[, t][, text]) tables, each with up to the wide number
    of rows -> query_id, position, kind, filename, score, t, text, tier.

    Few rows: the standard number of each kind. Many: those first, so that none gets another
    number, names trimmed to fit; then more of each kind. Counts a query give each row its
    place by arithmetic."""
    null = lambda df, c, kind: F.col(c).cast(kind) if c in df.columns else F.lit(None).cast(kind)
    parts = [anew(df).where(F.col("rank") <= WIDE[kind]).select("query_id", F.lit(kind).alias("kind"), F.col("rank").cast("int").alias("rank"), "filename", F.col("score").cast("double").alias("score"), null(df, "t", "double").alias("t"), null(df, "text", "string").alias("text")) for kind, df in zip(KINDS, (dialogue, ocr, keyword))]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    counts = rows.groupBy("query_id").agg(*(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS), F.count("*").alias("n"))
    first = {k: F.least(F.col(f"n_{k}"), F.lit(STANDARD[k])) for k in KINDS}
    names = F.greatest(F.lit(0), F.least(first["keyword"], STANDARD["total"] - first["dialogue"] - first["ocr"]))
    counts = counts.select("query_id", "n", first["dialogue"].alias("s_dialogue"), first["ocr"].alias("s_ocr"), names.alias("s_keyword"), (F.col("n_dialogue") - first["dialogue"]).alias("x_dialogue"), (F.col("n_ocr") - first["ocr"]).alias("x_ocr"))
    both = rows.join(counts, "query_id")
    standard = F.element_at(F.create_map(*(x for k in KINDS for x in (F.lit(k), F.col(f"s_{k}")))), F.col("kind"))
    at = F.when(F.col("kind") == "dialogue", 0).when(F.col("kind") == "ocr", F.col("s_dialogue")).otherwise(F.col("s_dialogue") + F.col("s_ocr"))
    base = F.col("s_dialogue") + F.col("s_ocr") + F.col("s_keyword")
    more = F.when(F.col("kind") == "dialogue", 0).when(F.col("kind") == "ocr", F.col("x_dialogue")).otherwise(F.col("x_dialogue") + F.col("x_ocr"))
    wide = F.col("n") > STANDARD["total"]
    place = F.when(F.col("rank") <= standard, at + F.col("rank")).when(wide, base + more + F.col("rank") - standard)
    return both.withColumn("position", place.cast("int")).where(F.col("position") <= F.when(wide, WIDE["total"]).otherwise(STANDARD["total"])).select("query_id", "position", "kind", "filename", "score", "t", "text", F.when(wide, "wide").otherwise("standard").alias("tier"))


def evidence_prompt(queries: DataFrame, evidence: DataFrame, system: str = SYSTEM, clock: Callable[[Column], Column] = padded_timecode) -> DataFrame:
    """query_id, system, user: the numbered rows and the question, times as `clock` writes them. A query without evidence says so."""
    # The forms of the rows and of the question below.
    text = F.coalesce("text", F.lit(""))
    said = F.format_string('[%d] Spoken in "%s" at %s: "%s"', "position", "filename", F.coalesce(clock(F.col("t")), F.lit("??:??")), text)
    line = F.when(F.col("kind") == "dialogue", said).when(F.col("kind") == "ocr", F.format_string('[%d] Text on "%s": "%s"', "position", "filename", text)).otherwise(F.format_string('[%d] File named "%s"', "position", "filename"))
    lines = evidence.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("position", line.alias("line")))).alias("lines"))
    both = queries.join(lines, "query_id", "left")
    scope = F.when(F.col("scope") != "all", F.concat(F.lit(" (searching only: "), "scope", F.lit(")"))).otherwise("") if "scope" in queries.columns else F.lit("")
    block = F.coalesce(F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), F.lit("(none)"))
    user = F.concat(F.lit("Question: "), F.trim(F.coalesce(F.col("text"), F.lit(""))), scope, F.lit("\n\nEvidence:\n"), block)
    return both.select("query_id", F.lit(system).alias("system"), user.alias("user"))


def highlight_words(query: Column, words: Column, substring: bool = False) -> Column:
    """Of words (ARRAY<STRUCT<text, ...>>) those with a word of the query, or with a part of
    it if substring or if the query has CJK characters."""
    pieces = F.array_distinct(F.flatten(F.transform(rank_tokens(query), lambda t: F.when(contains_cjk(t), F.array(F.lower(t))).otherwise(F.filter(F.split(F.lower(t), r"[^\p{L}\p{N}]+"), lambda x: x != "")))))

    def lit(s: Column) -> Column:
        part = lambda w: F.exists(s["pieces"], lambda t: F.contains(F.lower(w["text"]), t))
        return F.filter(words, part if substring else lambda w: F.when(s["cjk"], part(w)).otherwise(F.arrays_overlap(s["pieces"], word_tokens(w["text"]))))

    return let(F.struct(pieces.alias("pieces"), contains_cjk(query).alias("cjk")), lit)


def concat_evidence(dialogue: DataFrame, ocr: DataFrame, keyword: DataFrame) -> DataFrame:
    """All rows of the three kinds in their order, unnumbered."""
    return dialogue.unionByName(ocr, True).unionByName(keyword, True)


def display_rows(results: DataFrame, media: DataFrame, tab: str = "All") -> DataFrame:
    """Results with the file's columns, a label for the dominant signal, and one tab's rows only."""
    label = F.create_map(*(F.lit(x) for x in ("semantic", "Visual match", "phrase", "Name match", "filename", "Filename match", "ocr", "Text match")))[F.col("dominant")]
    rows = results.join(media, "filename")
    kept = rows if tab == "All" else rows.where(has_email(F.col("ocr"))) if tab == "Email" else rows.where(F.col("category") == tab)
    return kept.withColumn("reason", label)


def emails_per_file(media: DataFrame, limit: int = 5) -> DataFrame:
    """(filename, ocr) -> filename, emails: addresses in order, each once, `limit` at most."""
    from ..functions.emails import extract_emails

    found = media.select("filename", F.explode(extract_emails(F.col("ocr"), limit)).alias("m"))
    first = F.row_number().over(Window.partitionBy("filename", "m.address").orderBy("m.index"))
    found = found.withColumn("nth", first).where("nth = 1").groupBy("filename").agg(F.array_sort(F.collect_list(F.struct("m.index", "m.address"))).alias("a"))
    return found.select("filename", F.slice(F.transform("a", lambda x: x["address"]), 1, limit).alias("emails"))
