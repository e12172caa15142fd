"""Token alignment against all pairs of byte ranges by the two libraries."""

import collections
import hashlib
import random

import pytest

from memquarry.llm import token_alignment
from test_operators import docs, frame, none, odd, texts  # noqa: F401

TRICKY = ["a  b\n\n c ", "▁a ▁", "<0x0A> <s></s> <|endoftext|>x", "日本 語　テスト été", "tab\t\ttab  ", " lead", "x\x00y", "🤷‍♂️ don't", "é é ﬁ Ⅳ", "  ", "\n"]


def brute(rows, path_a, path_b):
    """doc number -> (n_a, n_b, n_groups, links, digits): every pair of tokens is compared."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    t, p = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
    t.encode_special_tokens = True
    letters = token_alignment.byte_letters()
    out = {}
    for d, text in rows:
        if not text:
            out[d] = (0, 0, 0, [], "")
            continue
        e, ids = t.encode(" " + text, add_special_tokens=False), p.encode(text)
        a = [bytes(map(letters.index, x)) for x in e.tokens]
        b = [bytes([int(x[3:5], 16)]) if p.is_byte(i) else x.replace("▁", " ").encode() for i in ids for x in (p.id_to_piece(i),)]
        if not b"".join(a) == b"".join(b) == b" " + text.encode():
            out[d] = (0, 0, 0, [], "")
            continue
        ends = []
        for tokens in (a, b):
            at, e_ = 0, []
            for x in tokens:
                at += len(x)
                e_.append(at)
            ends.append(e_)
        shared = sorted(set(ends[0]) & set(ends[1]))
        links, start = [], 0
        for i, end in enumerate(ends[0]):
            links += [(e.ids[i], ids[j]) for j, other in enumerate(ends[1]) if other - len(b[j]) < end and start < other]
            start = end
        groups, low = [], 0
        for s in shared:
            groups.append("|".join(",".join(str(v) for v, x in zip(of, en) if low < x <= s) for of, en in ((e.ids, ends[0]), (ids, ends[1]))))
            low = s
        out[d] = (len(a), len(b), len(groups), links, ";".join(groups))
    return out


@pytest.mark.parametrize("pairs", [400_000, 3])
def test_alignment(spark, docs, pairs):  # noqa: F811
    import public_tokenizers

    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    rows = [*((d, t if len(t or "") < 3000 else t[:1500]) for d, t in texts()), *((600 + i, x) for i, x in enumerate(TRICKY))]
    plain = brute(rows, *paths)
    held = collections.Counter(x for *_, links, _ in plain.values() for x in set(links))
    top = {}
    for (a, _), n in held.items():
        top[a] = max(n, top.get(a, 0))
    expect = {d: (n_a, n_b, g, len(x), sum(held[y] == top[y[0]] for y in x), sum(held[y] for y in x), s and hashlib.sha256(s.encode()).hexdigest()) for d, (n_a, n_b, g, x, s) in plain.items()}
    out, table = token_alignment.align_tokens(spark, frame(spark, rows), *paths, pairs=pairs)
    assert {r.doc_id: tuple(r)[1:] for r in out.collect()} == expect
    assert {(r.a, r.b): (r.n, r.best) for r in table.collect()} == {k: (n, n == top[k[0]]) for k, n in held.items()}
    assert any(v[0] == 0 for v in expect.values()) and any(v[3] > v[2] for v in expect.values())


def test_whole_texts_and_long_windows():
    """One long word and texts of many windows: bytes and counts agree with the tokens' own."""
    import public_tokenizers

    known = token_alignment.aligner(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    for text in ("y" * 9000, "word " * 3000, "東京" * 2000, " " * 5000):
        (row,) = known.documents([text])
        assert row[3] == row[0] + row[1] - row[2] and row[0] == len(known.a.slow.encode(" " + text, add_special_tokens=False).ids)


def test_odd(spark, odd, none):  # noqa: F811
    import public_tokenizers

    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    got = token_alignment.align_tokens(spark, odd, *paths)[0].collect()
    assert len(got) == odd.count() and sum(r.doc_id is None for r in got) == 1
    assert token_alignment.align_tokens(spark, none, *paths)[0].count() == 0


def test_words_are_tokenised_once():
    """Texts of words that were seen before need neither tokenizer; others give what whole texts give."""
    import public_tokenizers

    known = token_alignment.Aligner(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    seen: list = []
    a, b = known.a, known.b

    class Seen:
        def __init__(self, tokenizer):
            self.tokens, self.cuts, self.run = tokenizer.tokens, getattr(tokenizer, "cuts", True), tokenizer

        def __call__(self, texts):
            seen.extend([texts] if isinstance(texts, str) else texts)
            return self.run(texts)

    known.a, known.b = Seen(a), Seen(b)
    first, again = "one two.\nthree été 日本\n\nfour", "été two. one one\nthree one 日本\n\nfour two."
    known.documents([first])
    seen.clear()
    got = known.documents([again])
    assert not seen
    rng = random.Random(7)
    bits = ["a", "the", "x", "日本", "é", "é", "'s", "12", "<s>", ".", "\n", "\n\n", "\t", "\r", "\x1c", "\x85", "\u3000", "▁", " ", "<|endoftext|>"]
    odd_ = ["".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    got += known.documents(odd_)
    a.cuts = known.a.cuts = False  # every text as a whole
    whole = [known.documents([t])[0] for t in [again, *odd_]]
    assert [x and [*x[:5], *map(list, x[5:])] for x in got] == [x and [*x[:5], *map(list, x[5:])] for x in whole]
    assert sum(x is None for x in whole) > 100


def test_windows_in_generations(monkeypatch):
    """Memory that is full again and again changes nothing."""
    import public_tokenizers

    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    rows = [" ".join(f"w{i * k % 97}{'y' * (i % 60)}" for k in range(30)) for i in range(1, 60)]
    expect = token_alignment.Aligner(*paths).documents(rows)
    monkeypatch.setattr(token_alignment, "REMEMBERED_WINDOWS", 50)
    monkeypatch.setattr(token_alignment, "LINE", 7)
    known = token_alignment.Aligner(*paths)
    for _ in range(2):
        got = [x for at in range(0, len(rows), 4) for x in known.documents(rows[at : at + 4])]
        assert [[*x[:5], *map(list, x[5:])] for x in got] == [[*x[:5], *map(list, x[5:])] for x in expect]
        assert len(known.known) + len(known.old) <= 2 * max(50, 4 * 30)
