"""Transcripts: windows of lines, what to transcribe, and what looks cut off."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.media import is_real_speech, is_video
from ..functions.texts import clean_transcript

# Seconds of a window, of its overlap, of a gap that a sentence may go on over; windows that come in one reply.
TARGET, OVERLAP, GAP, REPLY = 30.0, 5.0, 8.0, 16


def transcript_windows(utterances: DataFrame, target: float = TARGET, overlap: float = OVERLAP) -> DataFrame:
    """(filename, t0, t1, text) -> filename, i, t0, t1, text: windows of about `target`
    seconds that end with a sentence, the next one beginning a little before. A window's
    beginning depends on the end of the one before it, so a film (hours of speech at most) is one group."""
    rows = utterances.where((F.col("t1") > F.col("t0")) & (F.trim("text") != "") & F.col("filename").isNotNull()).select("filename", F.col("t0").cast("double").alias("t0"), F.col("t1").cast("double").alias("t1"), F.trim("text").alias("text"))
    cut = rows.groupBy("filename").applyInPandas(_windows(target, overlap), "filename string, i int, t0 double, t1 double, text string")
    real = cut.withColumn("text", clean_transcript(F.col("text"))).where(is_real_speech(F.col("text")))
    before = F.lag(F.lower("text")).over(Window.partitionBy("filename").orderBy("i"))
    return real.withColumn("before", before).where(F.col("before").isNull() | (F.col("before") != F.lower("text"))).drop("before")


def _windows(target: float, overlap: float):
    def run(rows):
        import numpy as np
        import pandas as pd

        rows = rows.sort_values(["t0", "t1", "text"], kind="stable")
        t0, t1, text, out, i = rows["t0"].to_numpy(), rows["t1"].to_numpy(), rows["text"].to_list(), [], 0
        while i < len(t0):
            j = max(i + 1, int(np.searchsorted(t0, t0[i] + target, "left")))
            end = t1[i:j].max()
            if j < len(t0) and not text[j - 1].rstrip().endswith((".", "!", "?")) and t0[j] - end < GAP:
                end = max(end, t1[j])
                j += 1
            out.append((rows["filename"].iloc[0], len(out), t0[i], end, " ".join(text[i:j])))
            late = np.flatnonzero(t1[i + 1 : j] > end - overlap) if end - t0[i] >= target else []
            i = i + 1 + int(late[0]) if len(late) else j
        return pd.DataFrame(out, columns=["filename", "i", "t0", "t1", "text"])

    return run


def plan_transcripts(media: DataFrame, covered: DataFrame, progress: DataFrame) -> DataFrame:
    """media(filename), covered(filename), progress(filename, done, total, skipped) ->
    filename, off, skipped: films without a transcript from 0, unfinished ones from where they stopped."""
    films = media.where(is_video(F.col("filename"))).select("filename")
    both = films.join(covered.select("filename").distinct().withColumn("has", F.lit(True)), "filename", "left").join(progress, "filename", "left")
    partly = (F.col("done") >= 0) & (F.col("done") < F.col("total"))
    kept = F.array_sort(F.array_distinct(F.filter("skipped", lambda s: s >= 0)))
    skipped = F.when(F.col("has").isNotNull() & partly & (F.size(kept) > 0), kept)
    return both.where(F.col("has").isNull() | partly).select("filename", F.when(F.col("has").isNull(), 0).otherwise(F.floor("done")).cast("long").alias("off"), skipped.alias("skipped"))


def repair_candidates(covered: DataFrame, chunks: DataFrame, audio: DataFrame) -> DataFrame:
    """Films that count as transcribed but have no rows, with whether they have sound; those with sound are to be done again."""
    return covered.select("filename").distinct().join(chunks.select("filename").distinct(), "filename", "left_anti").join(audio, "filename", "left").select("filename", F.coalesce("has_audio", F.lit(False)).alias("has_audio"))


def truncated_transcripts(chunks: DataFrame, per_reply: int = REPLY) -> DataFrame:
    """Films with fewer windows than planned, all within less than half of the time."""
    per = chunks.groupBy("filename").agg(F.min("t0").alias("first"), F.max("t1").alias("duration"), F.count("*").alias("actual"))
    per = per.where("duration > 0").withColumn("planned", F.ceil(F.col("duration") / TARGET))
    return per.where((F.col("planned") > per_reply) & (F.col("actual") < F.col("planned")) & (F.col("duration") - F.col("first") < F.col("duration") * 0.5)).select("filename", "planned", "actual", "duration")


def plan_retranscribe(media: DataFrame) -> DataFrame:
    """After a change of model every film is transcribed from its beginning; no transcript is kept."""
    return media.where(is_video(F.col("filename"))).select("filename", F.lit(0).cast("long").alias("off"), F.lit(None).cast("array<long>").alias("skipped"))
