"""Recognised words: clean-up, text, glued addresses and what to read again."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.emails import BARE_AT, BRACKETED_AT, DOT, STRICT
from ..functions.media import is_real_word, is_video
from ..functions.tokens import glue_cjk_spaces

# Confidence of kept words, of the word with @ and of its neighbours, parts of an address, characters of a text.
CONFIDENT, ANCHOR, PART, PARTS, MOST = 70, 55, 50, 5, 2000
LINE, GAP = 0.6, 0.03
WORDS = "array<struct<text:string,confidence:double,x0:double,y0:double,x1:double,y1:double>>"

_separator = re.compile(rf"(?:{BRACKETED_AT}|{BARE_AT}|{DOT})", re.I)


def join_words(texts: Column) -> Column:
    """One space between words, none between CJK characters."""
    flat = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    return flat(glue_cjk_spaces(flat(F.array_join(texts, " "))))


def _kept(words: Column) -> Column:
    return F.filter(words, lambda w: w["text"].isNotNull() & (F.coalesce(w["confidence"], F.lit(0.0)) >= CONFIDENT) & is_real_word(w["text"]))


def clean_words(raw: DataFrame) -> DataFrame:
    """(filename, words, width, height) -> filename, words: sure and real ones with boxes as shares of the picture, cut at its edges."""
    inside = lambda v, low, high: F.greatest(low, F.least(high, v))
    zero, w, h = F.lit(0.0), F.col("width").cast("double"), F.col("height").cast("double")

    def box(word: Column) -> Column:
        x0, y0 = inside(word["x0"], zero, w), inside(word["y0"], zero, h)
        x1, y1 = inside(word["x1"], x0, w), inside(word["y1"], y0, h)
        return F.struct(F.trim(word["text"]).alias("text"), (x0 / w).alias("x"), (y0 / h).alias("y"), ((x1 - x0) / w).alias("w"), ((y1 - y0) / h).alias("h"))

    boxes = F.filter(F.transform(F.filter(_kept(F.col("words")), lambda x: x["x0"].isNotNull()), box), lambda b: (b["text"] != "") & (b["w"] > 0) & (b["h"] > 0))
    sized = (F.coalesce(w, zero) > 0) & (F.coalesce(h, zero) > 0)
    return raw.select("filename", F.when(sized, boxes).otherwise(F.filter(F.array(F.struct(F.lit("").alias("text"), *(zero.alias(c) for c in "xywh"))), lambda _: F.lit(False))).alias("words"))


def ocr_text(raw: DataFrame) -> DataFrame:
    """(filename, words, raw) -> filename, ocr: the kept words, or, where there are no words at all, the lines of the raw text."""
    words = F.filter(F.transform(_kept(F.col("words")), lambda w: F.trim(w["text"])), lambda t: t != "")
    lines = F.filter(F.transform(F.split(F.regexp_replace(F.coalesce("raw", F.lit("")), "\r", ""), "\n"), lambda x: F.trim(x)), lambda t: t != "")
    plain = F.trim(F.regexp_replace(F.array_join(lines, " "), r"\s+", " "))
    return raw.select("filename", F.substring(F.when(F.coalesce(F.size("words"), F.lit(0)) > 0, join_words(words)).otherwise(plain), 1, MOST).alias("ocr"))


def _adjacent(a: dict, b: dict, width: float, height: float) -> bool:
    """b follows a on one line, close by (boxes may overlap)."""
    middle = lambda w: (w["y0"] + w["y1"]) / 2 / height
    tall = lambda w: max(1, w["y1"] - w["y0"]) / height
    return abs(middle(a) - middle(b)) <= LINE * max(tall(a), tall(b)) and (b["x0"] - a["x1"]) / width < GAP


def _joined(a: dict, b: dict, text: str) -> dict:
    return {"text": text, "confidence": max(a["confidence"], b["confidence"]), **{c: min(a[c], b[c]) for c in ("x0", "y0")}, **{c: max(a[c], b[c]) for c in ("x1", "y1")}}


def glued(words: list[dict], width: float, height: float) -> list[dict]:
    """Words in which the parts of a broken address are one: from each word with an @
    inside, to the left while it is no address, then to the right over its last parts."""
    width, height = width if width and width > 0 else 1, height if height and height > 0 else 1
    words = [dict(w) | {"confidence": w["confidence"] or 0.0} for w in words]
    whole = lambda w: re.fullmatch(STRICT, w["text"]) is not None
    usable = lambda w, pattern: w["x0"] is not None and re.fullmatch(pattern, w["text"].strip()) and not _separator.fullmatch(w["text"].strip()) and w["confidence"] >= PART
    out: list[dict] = []
    i = 0
    while i < len(words):
        w = words[i]
        run = w | {"text": (w["text"] or "").strip()}
        first = end = i
        if re.search("[A-Za-z0-9]@[A-Za-z0-9]", run["text"]) and run["confidence"] >= ANCHOR:
            while not whole(run) and end - first + 1 < PARTS and first > 0 and words[first - 1]["text"] and usable(words[first - 1], "[A-Za-z0-9._%+-]+") and _adjacent(words[first - 1], run, width, height):
                left = words[first - 1]
                t = left["text"].strip()
                run, first = _joined(left, run, t + ("" if t.endswith(".") or run["text"][0] in ".@" else ".") + run["text"]), first - 1
            while end - first + 1 < PARTS and end + 1 < len(words) and words[end + 1]["text"]:
                right = words[end + 1]
                dotted = usable(right, r"\.[A-Za-z0-9-]+")
                if not (dotted or not whole(run) and usable(right, "[A-Za-z]{2,}")) or not _adjacent(run, right, width, height):
                    break
                t = right["text"].strip()
                piece = t if dotted else "." + t
                run, end = _joined(run, right, run["text"] + piece), end + 1
            if whole(run):
                del out[len(out) - (i - first) :]
                out.append(run)
                i = end + 1
                continue
        out.append(w)
        i += 1
    return out


def glue_email_words(raw: DataFrame) -> DataFrame:
    """(filename, words, width, height) -> the same, with broken addresses glued; only rows with an @ reach Python."""

    @F.pandas_udf(WORDS)
    def run(words: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
        return pd.Series([None if w is None else glued(list(w), a, b) for w, a, b in zip(words, width, height)])

    anchored = F.exists("words", lambda w: F.contains(w["text"], F.lit("@")))
    fixed = run(F.when(anchored, F.col("words")).cast(WORDS), F.col("width").cast("double"), F.col("height").cast("double"))
    return raw.withColumn("words", F.when(anchored, fixed).otherwise(F.col("words").cast(WORDS)))


def plan_ocr(media: DataFrame, languages: str, stamped: str | None, migrated: bool = True, force: bool = False) -> DataFrame:
    """media(filename, ocr, words) -> filename, reason: photos to read again. All of them for
    the upgrade, another set of languages, or by force; else those without word boxes, or
    with a text that no words stand behind."""
    photos = media.where(~is_video(F.col("filename")))
    every = "forced" if force else "upgrade" if not migrated else "languages" if stamped and stamped != languages else None
    if every:
        return photos.select("filename", F.lit(every).alias("reason"))
    reason = F.when(F.col("words").isNull(), "no boxes").when((F.size("words") == 0) & (F.length(F.coalesce("ocr", F.lit(""))) > 0), "text without boxes")
    return photos.select("filename", reason.alias("reason")).where("reason IS NOT NULL")


def plan_metadata(media: DataFrame, sources: DataFrame) -> DataFrame:
    """media(filename, hint, mtime), sources(filename, source_mtime, copy_mtime) -> filename, hint
    (null: to be probed), mtime: films have no hint, times come from the source or else the copy."""
    both = media.join(sources, "filename", "left")
    return both.select("filename", F.when(F.col("hint").isNull() & is_video(F.col("filename")), False).otherwise(F.col("hint")).alias("hint"), F.coalesce("mtime", "source_mtime", "copy_mtime").alias("mtime"))
