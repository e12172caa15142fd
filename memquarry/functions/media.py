"""Predicates and labels of media rows."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .tokens import CJK

# Video and picture extensions; those that play; names of screenshots in many
# languages and tools, words that count alone, and pairs of words that count together.
VIDEO = [".mp4", ".m4v", ".mov", ".webm", ".mkv", ".avi", ".ts", ".m2ts", ".mts", ".mpg", ".mpeg", ".wmv", ".flv", ".3gp"]
IMAGE = [".jpg", ".jpeg", ".png", ".gif", ".webp", ".heic", ".heif"]
PLAYABLE = [".mp4", ".m4v", ".mov", ".webm"]
PHRASES = [
    "screenshot", "screencapture", "screen capture", "screengrab", "screen grab",
    "bildschirmfoto", "captura de pantalla", "capture d’écran", "capture d'écran", "istantanea",
    "captura de tela", "captura de ecrã", "schermafbeelding", "skärmbild", "skjermbilde",
    "skærmbillede", "kuvakaappaus", "zrzut ekranu", "snímek obrazovky", "képernyőkép",
    "ekran görüntüsü", "снимок экрана", "знімок екрана", "στιγμιότυπο οθόνης", "captură de ecran",
    "لقطة شاشة", "צילום מסך", "ภาพหน้าจอ", "ảnh chụp màn hình", "tangkapan layar",
    "スクリーンショット", "스크린샷", "화면 캡처", "화면캡처", "截屏",
    "截圖", "屏幕截圖", "屏幕截图",
    "cleanshot", "flameshot", "shottr", "xnip", "gyazo", "snipaste", "monosnap",
]
WORDS = ["scr", "snag", "captura", "capture"]
PAIRS = ["screen shot", "screen grab", "screen capture"]
FOLDERS = ["screenshots", "screenshot"]


def extension(filename: Column) -> Column:
    return F.regexp_extract(F.lower(filename), r"\.[a-z0-9]+$", 0)


def is_video(filename: Column) -> Column:
    return extension(filename).isin(VIDEO)


def is_playable(filename: Column) -> Column:
    return extension(filename).isin(PLAYABLE)


def looks_like_screenshot(filename: Column) -> Column:
    lower = F.lower(filename)
    tokens = F.filter(F.split(lower, "[^a-z0-9]+"), lambda t: t != "")
    line = F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))
    pair = F.lit(False)
    for p in PAIRS:
        pair = pair | F.contains(line, F.lit(f" {p} "))
    return lower.rlike("|".join(map(re.escape, PHRASES))) | F.arrays_overlap(tokens, F.array(*map(F.lit, WORDS))) | pair


def in_screenshot_folder(path: Column) -> Column:
    parts = F.split(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), "/")
    return F.coalesce(F.arrays_overlap(parts, F.array(*map(F.lit, FOLDERS))), F.lit(False))


def category(filename: Column, source_path: Column, hint: Column, override: Column) -> Column:
    shot = looks_like_screenshot(filename) | F.coalesce(hint, F.lit(False)) | in_screenshot_folder(source_path)
    own = F.when(override.isin("Screenshots", "Projects"), override).when(shot, F.lit("Screenshots")).otherwise(F.lit("Projects"))
    return F.when(is_video(filename), F.lit("Videos")).otherwise(own)


def is_intermediate_stream(filename: Column) -> Column:
    return F.lower(filename).rlike(r"\.f\d+\.[a-z0-9]+$")


def is_real_word(text: Column) -> Column:
    clean = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}]", "")
    return F.coalesce(text, F.lit("")).rlike(f"[{CJK}&&[\\p{{L}}]]") | ((F.length(clean) >= 2) & clean.rlike(r"\p{L}"))


def _looped(units: Column) -> Column:
    """Five equal units in a row."""
    step = lambda s, u: F.struct(u.alias("last"), F.when(s["last"] == u, s["run"] + 1).otherwise(F.lit(0)).alias("run"), F.greatest(s["most"], F.when(s["last"] == u, s["run"] + 1).otherwise(F.lit(0))).alias("most"))
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("most"))
    return F.aggregate(F.transform(units, F.lower), start, step)["most"] >= 4


def is_real_speech(text: Column) -> Column:
    clean = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    words = F.filter(F.split(clean, "[^a-zA-Z0-9']+"), lambda w: w != "")
    runs = F.regexp_extract_all(clean, F.lit(f"[{CJK}]+"), F.lit(0))
    runes = F.aggregate(runs, F.lit(0), lambda s, r: s + F.length(r))
    units = F.concat(words, runs)
    short = ((F.size(words) < 2) & (runes < 4)) | ((F.length(clean) < 8) & (runes < 4))
    few = (F.size(units) >= 6) & (F.size(F.array_distinct(F.transform(units, F.lower))) <= 2)
    return ~(short | _looped(words) | _looped(runs) | few)
