"""Token rules of names, queries and recognised text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The scripts written without spaces, and name parts that say nothing.
CJK = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}ー・々〻〱-〵ｰ"
SPACE = r"[\s   -     　﻿]+"
NOISE = ["img", "image", "photo", "pic", "picture", "dsc", "dscn", "untitled", "new"]
MAX_PHRASE_TOKENS, MIN_TOKEN = 8, 2
OTHER = r"[^\p{L}\p{N}]+"


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def let(value: Column, f) -> Column:
    """f(value) with value worked out once a row, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def cjk_runs(c: Column) -> Column:
    return F.regexp_extract_all(_text(c), F.lit(f"[{CJK}]+"), F.lit(0))


def contains_cjk(c: Column) -> Column:
    return _text(c).rlike(f"[{CJK}]")


def cjk_bigrams(c: Column) -> Column:
    """Overlapping pairs of each run; a run of one character stays."""

    def pairs(run: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(F.length(run) - 2, F.lit(0))), lambda i: F.substring(run, i + 1, F.lit(2)))

    return F.array_distinct(F.flatten(F.transform(cjk_runs(c), pairs)))


def glue_cjk_spaces(c: Column) -> Column:
    return F.regexp_replace(_text(c), f"([{CJK}])\\s+([{CJK}])", "$1$2")


def _tokens(latin: Column, split: str, least: int, bigrams: Column) -> Column:
    return F.array_union(F.filter(F.split(latin, split), lambda t: F.length(t) >= least), bigrams)


def _with_cjk(c: Column, split: str, least: int, cut: bool) -> Column:
    """Tokens of a text, lower-cased once; texts without CJK characters need no look at their runs."""

    def tokens(lower: Column) -> Column:
        plain = F.array_distinct(F.filter(F.split(lower, split), lambda t: F.length(t) >= least))
        latin = F.regexp_replace(lower, f"[{CJK}]+", " ") if cut else lower
        return F.when((F.octet_length(lower) == F.length(lower)) | ~lower.rlike(f"[{CJK}]"), plain).otherwise(_tokens(latin, split, least, cjk_bigrams(lower)))

    return let(F.lower(_text(c)), tokens)


def rank_tokens(c: Column) -> Column:
    return _with_cjk(c, SPACE, MIN_TOKEN, True)


def ask_tokens(c: Column) -> Column:
    return _with_cjk(c, OTHER, MIN_TOKEN, True)


def word_tokens(c: Column) -> Column:
    return _with_cjk(c, OTHER, 1, False)


def token_sets(c: Column) -> Column:
    """STRUCT<rank, ask, word>: the three kinds of tokens of a text at once. A text without CJK
    characters is lower-cased once and cut once for `ask` and `word`."""

    def sets(lower: Column) -> Column:
        def plain(word: Column) -> Column:
            rank = F.array_distinct(F.filter(F.split(lower, SPACE), lambda t: F.length(t) >= MIN_TOKEN))
            return F.struct(rank.alias("rank"), F.filter(word, lambda t: F.length(t) >= MIN_TOKEN).alias("ask"), word.alias("word"))

        cjk = F.struct(rank_tokens(lower).alias("rank"), ask_tokens(lower).alias("ask"), word_tokens(lower).alias("word"))
        ascii_only = F.octet_length(lower) == F.length(lower)
        return F.when(ascii_only | ~lower.rlike(f"[{CJK}]"), let(F.array_distinct(F.array_remove(F.split(lower, OTHER), "")), plain)).otherwise(cjk)

    return let(F.lower(_text(c)), sets)


def whitespace_tokens(c: Column, least: int = MIN_TOKEN) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(_text(c)), SPACE), lambda t: F.length(t) >= least))


def phrase_tokens(filename: Column) -> Column:
    base = F.lower(F.regexp_replace(_text(filename), r"\.[^.]+$", ""))
    parts = F.filter(F.split(base, r"[._\-\s]+"), lambda t: t != "")
    parts = F.transform(parts, lambda t: F.when(t == "scr", F.lit("screenshot")).otherwise(t))
    return F.slice(F.filter(parts, lambda t: ~t.isin(NOISE)), 1, MAX_PHRASE_TOKENS)


def filename_phrase(filename: Column) -> Column:
    return F.array_join(phrase_tokens(filename), " ")


def _share(hits: Column, tokens: Column) -> Column:
    return F.coalesce(F.size(hits) / F.nullif(F.size(tokens), F.lit(0)), F.lit(0.0)).cast("double")


def filename_match(tokens: Column, filename: Column) -> Column:
    """Share of the tokens that the lower-case name contains."""
    name = F.lower(_text(filename))
    return _share(F.filter(tokens, lambda t: F.contains(name, t)), tokens)


def phrase_overlap(tokens: Column, filename: Column) -> Column:
    phrase = phrase_tokens(filename)
    return _share(F.filter(tokens, lambda t: F.array_contains(phrase, t)), tokens)


def text_match(tokens: Column, text: Column) -> Column:
    """Share of the tokens that the lower-case text contains."""
    return filename_match(tokens, text)


def breakdown_order(parts: Column, dominant: Column) -> Column:
    """MAP<signal, score> -> the signals above 0 in their order, the dominant one first."""
    signals = F.array(*map(F.lit, ("semantic", "phrase", "filename", "ocr")))
    some = F.filter(signals, lambda s: F.coalesce(parts[s], F.lit(0.0)) > 0)
    return F.when(F.array_contains(some, dominant), F.concat(F.array(dominant), F.array_remove(some, dominant))).otherwise(some)


def token_union(a: Column, b: Column) -> Column:
    return F.array_union(a, b)


def token_intersect(a: Column, b: Column) -> Column:
    return F.array_intersect(a, b)
