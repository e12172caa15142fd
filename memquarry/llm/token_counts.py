"""Token counts by byte-pair merging with a heap and a linked list.

A pre-token's symbols form a linked list; a heap holds its adjacent pairs by
merge rank and place. The lowest pair is popped and merged, its new neighbours
are pushed, until none is left; the count is the number of initial symbols minus
the merges. No identifiers are made. Counts of chunks and of pre-tokens are
remembered in bounded dictionaries.

Cases: null text is empty and has 0 tokens; special strings inside texts count as
one token, as the library does by default; texts and single words of any length
are handled (the heap is n log n); repeated rows and empty tables need no care;
extra columns are not read.
"""

from __future__ import annotations

import heapq
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table
from .packing import Remembered

LIMIT = 1024
# The byte-level pre-tokenisation pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A lone blank between two other characters always begins a pre-token.
LONE_BLANK = re.compile(r"(?<=\S) (?=\S)")
TWO_BLANKS = re.compile(r"\s |\s\Z| \s|\A ")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary: printable
    Latin-1 bytes for themselves, the others from U+0100 on, in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


class Counter:
    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.rank = {(a, b): i for i, (a, b) in enumerate(merges)}
        self.letters = byte_letters()
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.find = regex.compile(PATTERN).findall
        self.pretoken = Remembered(self.count)
        self.chunk = Remembered(lambda c: sum(map(self.pretoken.__getitem__, self.find(c))))

    def count(self, pretoken: str) -> int:
        symbols = [self.letters[b] for b in pretoken.encode("utf-8", "surrogatepass")]
        n, rank = len(symbols), self.rank
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := rank.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        merged = 0
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i]
            if symbols[i] != a or j < 0 or symbols[j] != b:
                continue
            symbols[i], symbols[j] = a + b, None
            right[i] = k = right[j]
            if k >= 0:
                left[k] = i
                if (r := rank.get((symbols[i], symbols[k]))) is not None:
                    heapq.heappush(heap, (r, i, symbols[i], symbols[k]))
            if (h := left[i]) >= 0 and (r := rank.get((symbols[h], symbols[i]))) is not None:
                heapq.heappush(heap, (r, h, symbols[h], symbols[i]))
            merged += 1
        return n - merged

    def plain(self, text: str) -> int:
        if not text:
            return 0
        if TWO_BLANKS.search(text):
            at = [0, *(m.start() for m in LONE_BLANK.finditer(text)), len(text)]
            return sum(self.chunk[text[a:b]] for a, b in zip(at, at[1:]))
        first, *rest = text.split(" ")
        return self.chunk[first] + sum(map(self.chunk.__getitem__, [" " + c for c in rest]))

    def text(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None or not self.special.search(text):
            return self.plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_bytes, n_tokens, over_limit."""

    def run(batches):
        count = counter(tokenizer_path).text
        for batch in slices(batches):
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "n_bytes": batch.column("n_bytes"), "n_tokens": pa.array(map(count, batch.column("text").to_pylist()), pa.int64())})

    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return docs.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
