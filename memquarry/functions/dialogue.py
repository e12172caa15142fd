"""Spoken words: comparison keys, tokens with places, snippets and the literal share.

Keys and tokens need Unicode decomposition, stemming and places in the text, which no
built-in function gives; they run as Arrow-batched UDFs and remember each distinct word.
Places count characters (code points)."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from .tokens import cjk_bigrams, let

# The suffix tables of Porter's stemmer (1980), in their order.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]
#: The scripts written without spaces, and their marks.
CJK_CLASS = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}ー・々〻〱-〵ｰ"
_latin, _cjk = re.compile("[A-Za-z0-9\u00c0-\u024f]+"), regex.compile(f"[{CJK_CLASS}]+")


def _shape(s: str) -> str:
    """v for each vowel, c for each consonant; y is a vowel after a consonant."""
    out = ""
    for x in s:
        out += "v" if x in "aeiou" or x == "y" and out[-1:] == "c" else "c"
    return out


def _measure(s: str) -> int:
    return len(re.findall("v+c+", _shape(s)))


def _double(s: str) -> bool:
    return len(s) > 1 and s[-1] == s[-2] and _shape(s)[-1] == "c"


def _short(s: str) -> bool:
    return _shape(s)[-3:] == "cvc" and s[-1] not in "wxy"


def porter_stem(w: str) -> str:
    """Porter's stemmer for lower-case ASCII words; in steps 2 to 4 a suffix whose stem is too short lets the next one be tried."""
    if len(w) < 3:
        return w
    s = re.sub("(?<=ss)es$|(?<=i)es$|(?<!s)s$", "", w)
    for end, back in (("eed", 1), ("ed", 2), ("ing", 3)):
        if not s.endswith(end):
            continue
        rest = s[: -len(end)]
        if end == "eed":
            s = s[:-1] if _measure(rest) else s
            break
        if "v" in _shape(rest):
            s = rest
            if s.endswith(("at", "bl", "iz")):
                s += "e"
            elif _double(s) and s[-1] not in "lsz":
                s = s[:-1]
            elif _measure(s) == 1 and _short(s):
                s += "e"
            break
    if s.endswith("y") and "v" in _shape(s[:-1]):
        s = s[:-1] + "i"
    for table in (STEP_2, STEP_3):
        end = next((x for x in table if s.endswith(x) and _measure(s[: -len(x)])), "")
        s = s[: len(s) - len(end)] + table.get(end, "")
    end = next((x for x in STEP_4 if s.endswith(x) and _measure(s[: -len(x)]) > 1 and (x != "ion" or s[-4] in "st")), "")
    s = s[: len(s) - len(end)]
    if s.endswith("e") and (_measure(s[:-1]) > 1 or _measure(s[:-1]) == 1 and not _short(s[:-1])):
        s = s[:-1]
    return s[:-1] if s.endswith("l") and _double(s) and _measure(s) > 1 else s


@lru_cache(200_000)
def dialogue_key(raw: str) -> str:
    """What words are compared by: without marks and case, stemmed; an i at the end is y, an e goes. Empty under two characters."""
    clean = re.sub("[^a-z0-9]", "", re.sub("[̀-ͯ]", "", unicodedata.normalize("NFKD", raw or "")).lower())
    if len(clean) < 2:
        return ""
    stem = porter_stem(clean) if clean.isalpha() else clean
    if len(stem) >= 3 and stem.endswith("i"):
        stem = stem[:-1] + "y"
    return stem[:-1] if len(stem) >= 4 and stem.endswith("e") else stem


def tokens_of(text: str | None) -> list[tuple[str, str, int, int]]:
    """(raw, key, start, end) of Latin words and of pairs of characters in runs of CJK (a lone one is itself), by place."""
    text = text or ""
    out = [(m[0], key, *m.span()) for m in _latin.finditer(text) if (key := dialogue_key(m[0]))]
    for m in _cjk.finditer(text):
        a, b = m.span()
        out += [(text[i : i + 2], text[i : i + 2], i, i + 2) for i in range(a, b - 1)] or [(text[a:b], text[a:b], a, b)]
    return sorted(out, key=lambda t: t[2:])


def snippet_of(text: str, keys: set, radius: int) -> tuple[str, int, int]:
    """The text around the first token with one of the keys: (snippet, where the match is in it, its length). The match goes on over tokens that touch it."""
    toks = tokens_of(text)
    at = next((i for i, t in enumerate(toks) if t[1] in keys), None)
    if at is None:
        return text[: radius * 2], 0, 0
    lo, hi = toks[at][2:]
    for t in toks[at + 1 :]:
        if t[1] not in keys or t[2] > hi or t[3] <= hi:
            break
        hi = t[3]
    a, b = max(0, lo - radius), min(len(text), hi + radius)
    return ("…" if a else "") + text[a:b] + ("…" if b < len(text) else ""), lo - a + (a > 0), hi - lo


def _tokens(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [dict(zip(("raw", "key", "start", "end"), x)) for x in tokens_of(t)])


def _keys(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [x[1] for x in tokens_of(t)])


def dialogue_tokens(text: Column) -> Column:
    return F.pandas_udf(_tokens, "array<struct<raw:string,key:string,start:int,end:int>>")(text)


def dialogue_keys(text: Column) -> Column:
    """The keys of a text's tokens, in order, as often as they come."""
    return F.pandas_udf(_keys, "array<string>")(text)


def asked_places(text: Column, keys: list[str]) -> Column:
    """STRUCT<spoken, found>: whether a text has a key at all, and the places of some keys among its keys."""
    wanted = frozenset(keys)

    @F.pandas_udf("spoken boolean, found array<struct<key:string,places:array<int>>>")
    def run(text: pd.Series) -> pd.DataFrame:
        out = []
        for t in text:
            toks, places = tokens_of(t), {}
            for i, x in enumerate(toks):
                if x[1] in wanted:
                    places.setdefault(x[1], []).append(i)
            out.append((bool(toks), [{"key": k, "places": p} for k, p in places.items()]))
        return pd.DataFrame(out, columns=["spoken", "found"])

    return run(text)


def snippet_around(text: Column, keys: Column, radius: int = 60) -> Column:
    """STRUCT<text, start, len>; for rows that are shown, not for all."""

    @F.pandas_udf("text string, start int, len int")
    def run(text: pd.Series, keys: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([snippet_of(t or "", set(k), radius) for t, k in zip(text, keys)], columns=["text", "start", "len"])

    return run(text, keys)


def literal_words(c: Column) -> Column:
    text = F.coalesce(c, F.lit(""))
    return F.array_union(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: F.length(t) >= 2), cjk_bigrams(text))


def literal_fraction(query: Column, text: Column) -> Column:
    """Share of the query's words that the text has: whole, or one the beginning of the other if both have three characters."""
    return literal_share(literal_words(query), literal_words(text))


def literal_share(tokens: Column, words: Column) -> Column:
    """The same for words that are cut already."""

    def share(s: Column) -> Column:
        def found(t: Column) -> Column:
            either = F.exists(s["words"], lambda w: (F.length(w) >= 3) & (F.startswith(w, t) | F.startswith(t, w)))
            return F.array_contains(s["words"], t) | ((F.length(t) >= 3) & either)

        return F.coalesce(F.size(F.filter(s["tokens"], found)) / F.nullif(F.size(s["tokens"]), F.lit(0)), F.lit(0.0))

    return let(F.struct(tokens.alias("tokens"), words.alias("words")), share)
