"""Short forms of texts and times, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lengths that are kept.
TRANSCRIPT, UTTERANCE, SLUG = 240, 500, 60


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def clean_transcript(c: Column) -> Column:
    return F.substring(collapse(c), 1, TRANSCRIPT)


def cap_utterance(c: Column) -> Column:
    return F.substring(collapse(c), 1, UTTERANCE)


def truncate_text(c: Column, most: int) -> Column:
    clean = collapse(c)
    return F.when(F.length(clean) > most, F.concat(F.substring(clean, 1, most - 1), F.lit("…"))).otherwise(clean)


def slugify(c: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, SLUG)


def normalize_prompt(c: Column) -> Column:
    return collapse(c)


def format_timecode(t: Column, padded: bool = False) -> Column:
    whole = F.floor(F.greatest(t, F.lit(0.0))).cast("long")
    minutes, seconds = F.floor(whole / 60).cast("string"), F.lpad((whole % 60).cast("string"), 2, "0")
    return F.concat(F.lpad(minutes, F.greatest(F.length(minutes), F.lit(2)), F.lit("0")) if padded else minutes, F.lit(":"), seconds)


def padded_timecode(t: Column) -> Column:
    """Two digits of minutes at least."""
    return format_timecode(t, padded=True)


def video_id(filename: Column) -> Column:
    """The eleven characters in brackets of the base name, or null."""
    return F.nullif(F.regexp_extract(F.substring_index(filename, "/", -1), r"\[([A-Za-z0-9_-]{11})\]", 1), F.lit(""))
