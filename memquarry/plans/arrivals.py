"""Registered queries on arrivals, short texts and plans of films, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import texts as X
from ..operators import films
from ..sources import views
from ..sources.manifest import scratch_folder
from ..sources.views import MEDIA, SEGMENTS, UTTERANCES
from ..streaming import arrivals as A
from ..streaming import children as C
from .queries import query

ATTEMPTS = "attempts AS (SELECT 'u' || user_id AS path, event_id AS seq, user_id % 7 + event_id // 400 AS size, event_id % 5 = 0 AS ok FROM events)"


def attempts(spark: SparkSession, d: str) -> DataFrame:
    size = (F.col("user_id") % 7 + F.floor(F.col("event_id") / 400)).cast("long")
    return views.table(spark, d, "events").select(F.concat(F.lit("u"), "user_id").alias("path"), F.col("event_id").alias("seq"), size.alias("size"), F.lit(0.0).alias("mtime"), (F.col("event_id") % 5 == 0).alias("ok"))


@query(f"""WITH {ATTEMPTS}, a AS (SELECT *, CASE WHEN ok OR lag(size) OVER (PARTITION BY path ORDER BY seq) IS DISTINCT FROM size THEN 1 ELSE 0 END AS new FROM attempts),
b AS (SELECT *, sum(new) OVER (PARTITION BY path ORDER BY seq) AS run FROM a), c AS (SELECT *, CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY path, run ORDER BY seq) AS INTEGER) AS n FROM b)
SELECT path, seq, n AS count, n >= 3 AS skip FROM c""")
def poison_state(spark: SparkSession, d: str) -> DataFrame:
    return A.poison_state(attempts(spark, d))


#: Replies made from conversations: a turn is a slice of up to three rows (sentences), the first turns of some are sent twice.
REPLIES = """told AS (SELECT conv_id, turn, role, text, 'conv-' || conv_id || '.mp4' AS filename, turn = max(turn) OVER (PARTITION BY conv_id) AS done, least(3, len(string_split(text, '. '))) AS size FROM conversations),
sent AS (SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS from_index FROM told),
replies AS (SELECT filename, from_index, i, CAST(size AS INTEGER) AS size, done, conv_id % 7 <> 5 AS ok, conv_id % 3 = 0 OR (turn + i) % 5 = 4 AS skipped,
  CAST(CASE WHEN (turn + i) % 11 = 3 THEN 'nan' ELSE CAST(turn * 6 + i AS VARCHAR) END AS DOUBLE) AS t0, CAST(turn * 6 + i + CASE WHEN i = 2 AND turn % 4 = 1 THEN -1 ELSE 2 END AS DOUBLE) AS t1,
  CASE WHEN conv_id % 10 = 1 THEN 'la' ELSE string_split(text, '. ')[i + 1] END AS text, conv_id % 13 <> 2 AS vec FROM (SELECT *, CAST(unnest(range(size)) AS INTEGER) AS i FROM sent))"""
_WORDS = "list_filter(regexp_split_to_array({c}, '[^a-zA-Z0-9'']+'), lambda x: x <> '')"
_SPOKEN = "trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))"
#: Words that say something: two at least, eight characters, no five equal words in a row, more than two different ones of six (the tables hold no CJK).
_LOOP = "list_bool_or(list_transform(range(1, greatest(len(w) - 3, 1)), lambda k: len(list_distinct(w[k:k + 4])) = 1 AND len(w[k:k + 4]) = 5))"
JUDGED = f"""{REPLIES}, spoken AS (SELECT *, {_SPOKEN} AS clean, list_transform({_WORDS.format(c=_SPOKEN)}, lambda x: lower(x)) AS w FROM replies),
judged AS (SELECT *, CASE WHEN skipped THEN 'skipped' WHEN isnan(t0) OR t1 <= t0 THEN 'times' WHEN NOT vec THEN 'no vector'
  WHEN len(w) < 2 OR length(clean) < 8 OR coalesce({_LOOP}, false) OR (len(w) >= 6 AND len(list_distinct(w)) <= 2) THEN 'no speech' END AS reason FROM spoken)"""


def replies(spark: SparkSession, d: str) -> DataFrame:
    c = views.table(spark, d, "conversations")
    by = Window.partitionBy("conv_id")
    parts = F.split("text", r"\. ")
    told = c.select("conv_id", "turn", "role", parts.alias("parts"), F.least(F.lit(3), F.size(parts)).alias("size"), (F.col("turn") == F.max("turn").over(by)).alias("done"))
    before = F.sum("size").over(by.orderBy("turn").rowsBetween(Window.unboundedPreceding, -1))
    rows = told.withColumn("from_index", F.coalesce(before, F.lit(0))).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("size") - 1)))
    nth = F.col("turn") + F.col("i")
    t0 = F.when(nth % 11 == 3, F.lit(float("nan"))).otherwise((F.col("turn") * 6 + F.col("i")).cast("double"))
    t1 = (F.col("turn") * 6 + F.col("i") + F.when((F.col("i") == 2) & (F.col("turn") % 4 == 1), -1).otherwise(2)).cast("double")
    text = F.when(F.col("conv_id") % 10 == 1, "la").otherwise(F.get("parts", F.col("i")))
    vec = F.when(F.col("conv_id") % 13 != 2, F.array(F.lit(1.0), F.lit(0.5))).cast("array<float>")
    rows = rows.select(F.concat(F.lit("conv-"), "conv_id", F.lit(".mp4")).alias("filename"), F.col("from_index").cast("long").alias("from_index"), "i", "size", "done", (F.col("conv_id") % 7 != 5).alias("ok"),
                       ((F.col("conv_id") % 3 == 0) | (nth % 5 == 4)).alias("skipped"), t0.alias("t0"), t1.alias("t1"), text.alias("text"), F.lit(None).cast("long").alias("poster"), vec.alias("vec"), F.lit(1).cast("long").alias("delivery"))
    again = rows.where("from_index % 4 = 1").withColumn("delivery", F.lit(2).cast("long")).withColumn("text", F.lit("Sent again and never taken."))
    return rows.union(again)


@query(f"""WITH {JUDGED} SELECT filename, from_index, i, reason, CASE WHEN reason IS NULL THEN clean[1:240] END AS text FROM judged""")
def split_reply(spark: SparkSession, d: str) -> DataFrame:
    """Every row of a reply, with why it can't be used, or its cleaned text."""
    good, bad = C.split_reply(C.first_deliveries(replies(spark, d)))
    own = ["filename", "from_index", "i"]
    return good.select(*own, F.lit(None).cast("string").alias("reason"), "text").union(bad.select(*own, "reason", F.lit(None).cast("string")))


@query(f"""WITH {JUDGED} SELECT filename, from_index, i, t0, t1, clean[1:240] AS text, row_number() OVER (ORDER BY filename, from_index, i) - 1 AS off FROM judged WHERE reason IS NULL""")
def child_rows(spark: SparkSession, d: str) -> DataFrame:
    """The usable rows of all slices, once each however often they were sent, with the places of their vectors."""
    return C.child_rows(replies(spark, d), scratch_folder(spark, "slices")).select("filename", "from_index", "i", "t0", "t1", "text", "off")


@query(f"""WITH {JUDGED}, per AS (SELECT filename, from_index, any_value(size) AS size, any_value(done) AS done, any_value(ok) AS ok, count(*) FILTER (reason IS NULL) AS good, count(*) FILTER (reason IS NOT NULL) AS skipped FROM judged GROUP BY ALL)
SELECT filename, CAST(sum(skipped) AS BIGINT) AS skipped FROM per WHERE filename NOT LIKE '%2.mp4' GROUP BY 1
HAVING max(CASE WHEN done THEN from_index + size END) <= sum(size) AND bool_or(done AND ok) AND sum(good) = 0 AND sum(skipped) > 0""")
def park_unusable(spark: SparkSession, d: str) -> DataFrame:
    """Files that came whole with nothing to be used, but for those that something covers."""
    r = replies(spark, d)
    return C.unusable(C.slices_of(C.first_deliveries(r)), r.where("filename LIKE '%2.mp4'"))


@query(f"""WITH {JUDGED} SELECT filename, array_to_string(list_slice(list_sort(list_distinct(list(from_index + i))), 1, 32), ' ') AS skipped FROM judged WHERE reason IS NOT NULL GROUP BY 1""")
def skip_list(spark: SparkSession, d: str) -> DataFrame:
    _, skipped = C.split_reply(C.first_deliveries(replies(spark, d)))
    rows = A.skip_list(skipped.withColumn("i", F.col("from_index") + F.col("i")))
    return rows.select("filename", F.array_join(F.transform("skipped", lambda i: i.cast("string")), " ").alias("skipped"))


CLEAN = "trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))"


@query(f"""SELECT doc_id, {CLEAN}[1:240] AS transcript, {CLEAN}[1:500] AS utterance, CASE WHEN length({CLEAN}) > 80 THEN {CLEAN}[1:79] || '…' ELSE {CLEAN} END AS short,
regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')[1:60] AS slug FROM documents""")
def short_texts(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return views.table(spark, d, "documents").select("doc_id", X.clean_transcript(t).alias("transcript"), X.cap_utterance(t).alias("utterance"), X.truncate_text(t, 80).alias("short"), X.slugify(t).alias("slug"))


@query(f"""WITH {UTTERANCES}, x AS (SELECT filename, line, CAST(floor(t0 * 7) AS BIGINT) AS s FROM utterances)
SELECT filename, line, (s // 60) || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS shown, (CASE WHEN s < 600 THEN '0' ELSE '' END) || (s // 60) || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS cited FROM x""")
def timecodes(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("t0") * 7
    return views.utterances(spark, d).select("filename", "line", X.format_timecode(t).alias("shown"), X.format_timecode(t, True).alias("cited"))


@query(f"""WITH {SEGMENTS}, x AS (SELECT filename, max(t + dur) AS duration FROM segments GROUP BY 1), e AS (SELECT filename, 0.0 AS t FROM x UNION SELECT filename, t FROM segments)
SELECT filename, t, coalesce(lead(t) OVER (PARTITION BY filename ORDER BY t), duration) - t AS dur FROM e JOIN x USING (filename)""")
def shots_from_cuts(spark: SparkSession, d: str) -> DataFrame:
    s = views.segments(spark, d)
    return films.shots_from_cuts(s.select("filename", "t"), s.groupBy("filename").agg(F.max(F.col("t") + F.col("dur")).alias("duration")))


@query(f"""WITH {UTTERANCES}, x AS (SELECT filename, max(t1) AS duration FROM utterances GROUP BY 1), p AS (SELECT *, unnest(range(8)) AS i FROM x)
SELECT filename, CAST(i AS INTEGER) AS i, greatest(0.0, least((i + 0.5) * duration / 8, duration - 0.5)) AS t, greatest(0.5, duration / 8) AS span FROM p""")
def interval_plan(spark: SparkSession, d: str) -> DataFrame:
    durations = views.utterances(spark, d).groupBy("filename").agg(F.max("t1").alias("duration"))
    return films.clamp_plan(films.interval_plan(durations, 8), durations)


@query(f"""WITH {UTTERANCES}, s AS (SELECT filename, line, t0 // 30 AS i, t0 - t0 // 30 * 30 AS a, CASE WHEN line % 4 = 3 THEN t0 - t0 // 30 * 30 ELSE t1 - t0 // 30 * 30 END AS b, text FROM utterances)
SELECT filename, line, i * 30 + a AS t0, i * 30 + b AS t1 FROM s WHERE b > a AND trim(text) <> ''""")
def offset_utterances(spark: SparkSession, d: str) -> DataFrame:
    i = F.floor(F.col("t0") / 30)
    u = views.utterances(spark, d).select("filename", "line", i.alias("i"), "text", (F.col("t0") - i * 30).alias("a"), (F.when(F.col("line") % 4 == 3, F.col("t0")).otherwise(F.col("t1")) - i * 30).alias("b"))
    return films.offset_utterances(u.withColumnsRenamed({"a": "t0", "b": "t1"})).select("filename", "line", "t0", "t1")


@query(f"""WITH {MEDIA}, x AS (SELECT row_id, filename, CASE WHEN row_id % 9 > 0 THEN row_id * 7919 % 100 END AS mtime FROM media)
SELECT CAST(row_number() OVER (ORDER BY mtime DESC NULLS LAST, row_id DESC) AS INTEGER) AS rank, row_id, filename FROM x QUALIFY rank <= 96""")
def newest_first(spark: SparkSession, d: str) -> DataFrame:
    m = views.media(spark, d).withColumn("mtime", F.when(F.col("row_id") % 9 > 0, F.col("row_id") * 7919 % 100))
    return films.newest_first(m, 96).select("rank", "row_id", "filename")
