"""Conversation repair against all edits of small patterns, a plain recursion, and DuckDB SQL."""

import functools
import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest

from memquarry.llm import conversation_repair as C

COLUMNS = "conv_id int, turn long, role string, text string, n int, what string, part string, audit string"


def best(rows, start=0, ends=C.ENDS, costs=C.Costs()):
    """(cost, audit) by recursion over whole rests, at most two insertions in a row."""

    @functools.cache
    def rest(i, state, inserted):
        options = [(0, "")] if i == len(rows) and state in ends else []

        def add(cost, letter, then):
            if then:
                options.append((cost + then[0], letter + then[1]))

        turn = C.NEXT[state][C.TURN[state]]
        if inserted < 2:
            add(costs.insert, "I", rest(i, turn, inserted + 1))
        if i < len(rows):
            row, more = rows[i], costs.truncated if rows[i].isupper() else 0
            add(costs.delete, "D", rest(i + 1, state, 0))
            if row != "x":
                add(costs.rerole + more, "R", rest(i + 1, turn, 0))
                if row.lower() in C.NEXT[state]:
                    add(more, "K", rest(i + 1, C.NEXT[state][row.lower()], 0))
        return min(options) if options else None

    return rest(0, start, 0)


def every(rows):
    """The cheapest of all sequences of edits with an insertion or none before each row and at the end."""
    found = []
    for edits in itertools.product("DKR", repeat=len(rows)):
        for gaps in itertools.product(("", "I", "II"), repeat=len(rows) + 1):
            cost, roles, audit = 0, "", ""
            options = [""]
            for i in range(len(rows) + 1):
                audit += gaps[i]
                cost += 5 * len(gaps[i])
                options = [o + "?" * len(gaps[i]) for o in options]
                if i == len(rows):
                    break
                audit += edits[i]
                row, e = rows[i], edits[i]
                cost += {"D": 2, "K": 0, "R": 1}[e] + (5 if e != "D" and row.isupper() else 0)
                options = [o + {"D": "", "K": row.lower(), "R": "?"}[e] for o in options]
            roles = options[0]
            if any(re.fullmatch(r"(s?(ua)+)?", "".join(x)) for x in itertools.product(*[("u", "a") if c == "?" else (c,) for c in roles])):
                found.append((cost, audit))
    return min(found)


def test_search_against_all_edits():
    for n in range(4):
        for rows in itertools.product("suaoSUA", repeat=n):
            assert C.search("".join(rows), 0, C.ENDS, C.Costs()) == every("".join(rows)), rows


def test_search_against_recursion():
    r = random.Random(2)
    for case in range(1500):
        rows = "".join(r.choice("sssuuuaaaoSUAO") for _ in range(r.randint(0, 14)))
        start, ends = r.randint(0, 3), r.choice([(0, 3), (0,), (1,), (2,), (3,)])
        costs = r.choice([C.Costs(), C.Costs(1, 1, 3, 0), C.Costs(0, 2, 9, 1), C.Costs(3, 1, 4, 2)])
        assert C.search(rows, start, ends, costs) == best(rows, start, ends, costs), (rows, start, ends, costs)
    with pytest.raises(ValueError):
        C.Costs(insert=4)


def test_long_patterns_take_few_steps(monkeypatch):
    """1000 rows are searched without a step for each subset of edits."""
    steps = []
    legal = C.NEXT
    monkeypatch.setattr(C, "NEXT", type("Counted", (), {"__getitem__": lambda self, s: steps.append(s) or legal[s]})())
    r = random.Random(4)
    for kinds in ("ua", "u", "s", "suaoSUA", "sss" + "uaUA", "UA", "SU"):
        rows = "".join(r.choice(kinds) for _ in range(1000))
        steps.clear()
        cost, audit = C.search(rows, 0, C.ENDS, C.Costs())
        assert len(audit) == 1000 and len(steps) < 12_000, (kinds, len(steps))


def plain(rows):
    """conv_id -> the contract's columns, from rows (conv_id, turn, role, text)."""
    out = {}
    for conv in {r[0] for r in rows}:
        after = []
        for c, turn, role, text in rows:
            if c == conv:
                role, text = (" " if x is None else x for x in (role, text))
                what = zlib.crc32(":".join(" " if x is None else str(x) for x in (c, turn)).encode()) % 20
                text = "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text
                after += [(turn, "user" if what == 4 else role, text)] * {0: 0, 3: 2}.get(what, 1)
        after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults, kinds = [], ""
        for i, (_, role, text) in enumerate(after):
            words = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "b" if not words else "d" if any((role, text) == x[1:] for x in after[:i]) else "" if words[-1] in ".!?" else "t"
            faults.append(fault)
            known = role[:1] if role[:1] in ("s", "u", "a") else "o"
            kinds += "x" if fault in ("b", "d") else known.upper() if fault else known
        cost, audit = best(kinds)
        state, lines = 0, []
        for edit, kind, (_, role, text) in zip(audit, kinds, after, strict=True):
            if edit != "D":
                turn = kind.lower() if edit == "K" else C.TURN[state]
                state = C.NEXT[state][turn]
                lines.append((role if edit == "K" else C.NEW[turn]) + ":" + text)
        turns = {t for t, _, _ in after if t is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(after, after[1:]))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def conversations(seed=7, n=60):
    r = random.Random(seed)
    roles, ends = ["system", "user", "assistant", "tool", "", None, "User", "s"], ["Yes.", "no", "Why?", "", " \n ", "ok!  ", None, "é…", "東。", "a.b"]
    rows = []
    for c in [*range(n), None]:
        for turn in range(r.randint(1, 9) if c else 130):
            role = r.choice(roles) if r.random() < 0.3 else ["user", "assistant"][turn % 2]
            text = r.choice(ends) if r.random() < 0.3 else f"text {c} {turn % 40}{r.choice(['.', '', '!'])}"
            rows += [(c, r.choice([turn, turn, turn, None, turn + 5]), role, text)] * r.choice([1, 1, 1, 1, 2])
    # rows that the damage drops, one conversation of nothing else, and a very long text
    gone = [t for t in range(400) if zlib.crc32(f"900:{t}".encode()) % 20 == 0]
    return rows + [(900, t, "user", "gone.") for t in gone] + [(901, 1, "user", "y" * 200_000 + "."), (901, 2, "assistant", "z.")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "w", "p", "q") for r in rows], COLUMNS)


@pytest.mark.parametrize("limits", [(1000, 8 << 20, 400), (5, 8 << 20, 3), (0, 8 << 20, 1), (1000, 1000, 400)])
def test_repair(spark, limits):
    """Conversations in one piece and cut into pieces agree with the plain version."""
    rows = conversations()
    expect = plain(rows)
    got = C.repair(spark, C.damaged(frame(spark, rows)), C.Costs(), *limits).collect()
    assert len(got) == len(expect) and {r.conv_id: tuple(r)[1:] for r in got} == expect
    assert expect[900] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_one_row_very_often(spark):
    """A third of all rows are copies of one: they meet as a count."""
    rows = spark.range(3000).selectExpr("7L AS conv_id", "4L AS turn", "'user' AS role", "'Again.' AS text").union(spark.range(40).selectExpr("7L", "id + 5", "if(id % 2 = 0, 'assistant', 'user')", "'text ' || id || '.'"))
    (got,) = C.repair(spark, C.damaged(rows), C.Costs(), 100, 8 << 20, 16).collect()
    (whole,) = C.repair(spark, C.damaged(rows), C.Costs(), 10_000).collect()
    assert tuple(got) == tuple(whole)
    assert got.duplicate >= 2999 and len(got.audit) >= 3000


def test_empty(spark):
    none = frame(spark, conversations(n=1)).where("conv_id < 0")
    assert C.repair(spark, C.damaged(none)).count() == 0


def test_sql(spark):
    """The SQL of the whole contract on rows without ties of turn."""
    rows = [(c, t, role, text) for c, t, role, text in {(r[0], i, r[2], r[3]) for i, r in enumerate(conversations(9))}]
    con = duckdb.connect()
    con.register("conversations", frame(spark, rows).select("conv_id", "turn", "role", "text").toPandas().astype({"turn": "Int64", "conv_id": "Int64"}))
    names = ", ".join(C.NAMES)
    want = {r[0]: r[1:] for r in con.sql(f"SELECT {names} FROM ({C.OP13_SQL})").fetchall()}
    assert want == plain(rows)
