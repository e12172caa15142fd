"""Conversations repaired by depth-first branch-and-bound.

Each row is kept, given another role or deleted, and rows may be inserted, so that the
role initials read `(s?(ua)+)?`. The search keeps an explicit stack of (row, state of the
pattern, cost, audit). A suffix lower bound for each row and state (the least cost of the rest,
whatever its audit) and the incumbent (cost, audit) cut nodes off, so that the steps grow
with the rows and not with the sets of edits; a dominance table for each row and state drops prefixes that are no
cheaper and no earlier in ASCII order than one that came before. The search ends when the
stack is empty, which proves the incumbent. Rows that must go are taken out before.

An insertion costs more than two deletions (checked), so that no cheapest repair holds one:
instead of an insertion and a row beside it that stays, both can go, or all of what is then
left of the conversation. Audits of a stretch of rows therefore have equal lengths, and
stretches can be solved apart: conversations of many rows or bytes are sorted by ranges, cut
into pieces of PIECE rows, solved from each state to each, and joined from the end. One task
sees short rows of a long conversation only: its pieces, as its audit is one value. The hash
of a long conversation is one sequential digest by contract: its kept rows stream through one
task, which holds a batch of them.

Cases: null role or text is one space, as is a null conv_id or turn inside the damage key;
null conv_ids are one conversation and come back as null; a role that is empty or begins with
another letter can't be kept; rows of one turn are taken by role, then text (bytes); repeated
rows are duplicates; empty and very long texts are handled whole; a conversation without rows
after the damage has zeros; empty tables give no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CACHES, slices, small, table, written
from .packing import Remembered

#: Rows and bytes beyond which a conversation is cut into pieces, and rows of a piece.
LONG_ROWS, LONG_BYTES, PIECE = 1000, 8 << 20, 400
BLANKS = " \t\n\x0b\x0c\r"
LEGAL = {"su", "ua", "au"}
#: States of the pattern: nothing yet, after s, after u, after a. What a turn leads to, by state.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
TURN = ("u", "u", "a", "u")
ENDS = (0, 3)
FAR = 1 << 40


@dataclass(frozen=True)
class Costs:
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5

    def __post_init__(self):
        if min(self.rerole, self.delete, self.truncated) < 0 or self.insert <= 2 * self.delete:
            raise ValueError("an insertion must cost more than two deletions, and no cost may be negative")


def letter(role: str, cut: bool) -> str:
    """A row in a pattern: its initial where the pattern knows it, else o; in upper case if truncated."""
    known = role[:1] if role[:1] in ("s", "u", "a") else "o"
    return known.upper() if cut else known


def bounds(rows: str, ends: tuple[int, ...], costs: Costs) -> list[list[int]]:
    """For each row and state the cost that no rest goes below, audits left out."""

    def inserted(v: list[int]) -> list[int]:
        v = v[:2] + [min(v[2], costs.insert + v[3]), min(v[3], costs.insert + v[2])]
        return [min(v[s], costs.insert + v[2]) if s < 2 else v[s] for s in range(4)]

    out = [inserted([0 if s in ends else FAR for s in range(4)])]
    for row in reversed(rows):
        more, low = costs.truncated if row.isupper() else 0, out[-1]
        step = []
        for s in range(4):
            keep = NEXT[s].get(row.lower())
            best = min(costs.delete + low[s], costs.rerole + more + low[NEXT[s][TURN[s]]])
            step.append(best if keep is None else min(best, more + low[keep]))
        out.append(inserted(step))
    return out[::-1]


def search(rows: str, start: int, ends: tuple[int, ...], costs: Costs) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest edits that lead from a state to one of `ends`, of equal
    ones the audit that is least in ASCII; None if no edits do. No row of `rows` must go."""
    n, low = len(rows), bounds(rows, ends, costs)
    stack, incumbent = [(0, start, 0, "")], None
    table_: dict[tuple[int, int], list[tuple[int, str]]] = {}
    while stack:
        at, state, cost, audit = stack.pop()
        least = cost + low[at][state]
        if least >= FAR or incumbent and (least > incumbent[0] or least == incumbent[0] and audit > incumbent[1][: len(audit)]):
            continue
        # a proper prefix of another audit is neither before nor after it until both go on
        seen = table_.setdefault((at, state), [])
        if any(c < cost or c == cost and (a == audit or a < audit and not audit.startswith(a)) for c, a in seen):
            continue
        seen[:] = [(c, a) for c, a in seen if c < cost or c == cost and (a < audit or a.startswith(audit))]
        seen.append((cost, audit))
        if at == n and state in ends and (incumbent is None or (cost, audit) < incumbent):
            incumbent = cost, audit
        turn = NEXT[state][TURN[state]]
        children = [(at, turn, cost + costs.insert, audit + "I")]
        if at < n:
            row = rows[at]
            more = costs.truncated if row.isupper() else 0
            children += [(at + 1, state, cost + costs.delete, audit + "D"), (at + 1, turn, cost + costs.rerole + more, audit + "R")]
            if (kept := NEXT[state].get(row.lower())) is not None:
                children.append((at + 1, kept, cost + more, audit + "K"))
        # the most promising is popped first, of equals the one with the least letter
        stack += sorted(children, key=lambda c: (c[2] + low[c[0]][c[1]], c[3][-1]), reverse=True)
    return incumbent


def roles_of(rows: str, audit: str, state: int) -> tuple[str, int]:
    """What becomes of each row: D, K, or the initial of its new role; and the state after them."""
    out = []
    for row, edit in zip(rows, audit, strict=True):
        if edit == "R":
            out.append(TURN[state])
            state = NEXT[state][TURN[state]]
        else:
            out.append(edit)
            if edit == "K":
                state = NEXT[state][row.lower()]
    return "".join(out), state


_searches: dict[Costs, Remembered] = {}
CACHES["conversations"] = _searches.clear


def solved(costs: Costs) -> Remembered:
    """(rows, start, ends) -> search(); conversations are often alike once texts are left out."""
    if costs not in _searches:
        _searches[costs] = Remembered(lambda key: search(*key, costs), 50_000)
    return _searches[costs]


def spread(kinds: str, letters: str) -> str:
    """Letters for all rows from letters for those that needn't go (x)."""
    left = iter(letters)
    return "".join("D" if k == "x" else next(left) for k in kinds)


def fault_of(text: str) -> str:
    """b: blank, t: truncated, or '.'"""
    bare = text.rstrip(BLANKS)
    return "b" if not bare else "." if bare[-1] in ".!?" else "t"


NEW = {"u": "user", "a": "assistant"}


def repaired(rows: list[tuple], costs: Costs) -> tuple:
    """Rows (turn, role, text, n) of a conversation in order -> the columns of FOUND after conv_id."""
    rows = [(turn, role, text) for turn, role, text, n in rows for _ in range(n)]
    turns = {t for t, _, _ in rows if t is not None}
    faults, seen = [], set()
    for _, role, text in rows:
        fault = fault_of(text)
        faults.append("d" if fault != "b" and (role, text) in seen else fault)
        seen.add((role, text))
    initials = [role[:1] for _, role, _ in rows]
    illegal = sum(a + b not in LEGAL for a, b in itertools.pairwise(initials))
    kinds = "".join("x" if f in "bd" else letter(role, f == "t") for f, (_, role, _) in zip(faults, rows))
    stay = kinds.replace("x", "")
    cost, audit = solved(costs)[stay, 0, ENDS]
    what = spread(kinds, roles_of(stay, audit, 0)[0])
    lines = [f"{role if w == 'K' else NEW[w]}:{text}" for w, (_, role, text) in zip(what, rows) if w != "D"]
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    counts = [faults.count(f) for f in "bdt"]
    return gaps, *counts, illegal, cost + costs.delete * kinds.count("x"), spread(kinds, audit), hashlib.sha256("\n".join(lines).encode()).hexdigest()


FOUND = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
KINDS = [pa.int64()] * 7 + [pa.string()] * 2
NAMES = [c.split()[0] for c in FOUND.split(", ")]


def streamed(batches, columns: list[str]):
    for batch in slices(batches, owner="conversations"):
        yield from zip(*(batch.column(c).to_pylist() for c in columns))


def rows_out(rows, names: list[str], kinds: list, size: int = 500):
    rows = iter(rows)
    while part := list(itertools.islice(rows, size)):
        yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*part), kinds)], names=names)


def whole(costs: Costs):
    """mapInArrow: rows sorted by conversation -> FOUND."""

    def run(batches):
        rows = itertools.groupby(streamed(batches, ["conv_id", "turn", "role", "text", "n"]), lambda r: r[0])
        yield from rows_out(((c, *repaired([r[1:] for r in own], costs)) for c, own in rows), NAMES, KINDS)

    return run


def damaged(rows: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) -> the same after the damage, and n, how often a row is there."""
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    what = F.crc32(F.concat(text["conv_id"], F.lit(":"), text["turn"]).cast("binary")) % 20
    rows = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), text["role"].alias("role"), text["text"].alias("text"), what.alias("what"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("what") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("what") == 1, F.lit("")).when(F.col("what") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("what") == 0, 0).when(F.col("what") == 3, 2).otherwise(1).cast("long").alias("n"),
    )


def marked(batches):
    """mapInArrow: sorted rows of long conversations -> part and place of each, what its own text says, and whether it is the first such row here."""

    def run():
        part, known, conv = TaskContext.get().partitionId(), set(), ()
        for at, (c, role, text, n) in enumerate(streamed(batches, ["conv_id", "role", "text", "n"])):
            if conv != (c,):
                conv, known = (c,), set()
            digest = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
            yield c, part, at, role, text, n, fault_of(text), digest, digest not in known
            known.add(digest)

    yield from rows_out(run(), ["conv_id", "part", "at", "role", "text", "n", "fault", "digest", "first"], [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64(), pa.string(), pa.binary(), pa.bool_()])


STEPS = [(s, e) for s in range(4) for e in range(4) if e >= min(s, 2)]


def transfers(costs: Costs):
    """mapInArrow: pieces (rows in order) -> their counts, and the cheapest way from each state to each."""

    def run(batches):
        def out():
            for c, part, block, rows in streamed(batches, ["conv_id", "part", "block", "rows"]):
                kinds = "".join("x" if r["fault"] in "bd" else letter(r["role"], r["fault"] == "t") for r in rows)
                stay, n = kinds.replace("x", ""), [r["n"] for r in rows]
                count = {f: sum(r["n"] if f in "bd" else 1 for r in rows if r["fault"] == f) for f in "bdt"}
                count["d"] += sum(r["n"] - 1 for r in rows if r["fault"] not in "bd")
                illegal = sum(n) - len(n) + sum(a["role"] + b["role"] not in LEGAL for a, b in itertools.pairwise(rows))
                ways = []
                for s, e in STEPS:
                    best = solved(costs)[stay, s, (e,)]
                    if best and "I" not in best[1]:  # where an insertion is cheapest, no cheapest repair leads through s and e
                        ways.append({"s": s, "e": e, "cost": best[0], "audit": spread(kinds, best[1]), "what": spread(kinds, roles_of(stay, best[1], s)[0])})
                forced = costs.delete * (sum(n) - len(stay))
                yield c, part, block, rows[0]["at"], count["b"], count["d"], count["t"], illegal, rows[0]["role"], rows[-1]["role"], forced, n, ways

        yield from rows_out(out(), PIECE_NAMES, PIECE_KINDS, 20)

    return run


WAY = pa.struct([("s", pa.int32()), ("e", pa.int32()), ("cost", pa.int64()), ("audit", pa.string()), ("what", pa.string())])
PIECE_NAMES = ["conv_id", "part", "block", "from", "blank", "duplicate", "truncated", "illegal", "head", "tail", "forced", "n", "ways"]
PIECE_KINDS = [pa.int64()] * 8 + [pa.string()] * 2 + [pa.int64(), pa.list_(pa.int64()), pa.list_(WAY)]
PIECES = (
    "conv_id long, part long, block long, from long, blank long, duplicate long, truncated long, illegal long, head string, tail string, "
    "forced long, n array<long>, ways array<struct<s:int,e:int,cost:long,audit:string,what:string>>"
)
JOINED = "conv_id long, part long, block long, from long, what string, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def joined(batches):
    """mapInArrow: pieces of conversations, last first -> what becomes of each piece's rows, and a row
    without a part for each conversation. Only pieces' short strings of one conversation are held."""

    def out():
        for c, pieces in itertools.groupby(streamed(batches, PIECE_NAMES), lambda r: r[0]):
            rest, chosen, counts, after = {s: 0 for s in ENDS}, [], [0] * 5, None
            for _, part, block, begin, *numbers, head, tail, forced, n, ways in pieces:
                best: dict = {}
                for w in ways:
                    if w["e"] in rest:
                        option = (w["cost"] + rest[w["e"]], w["audit"], w["e"], w["what"])
                        best[w["s"]] = min(best.get(w["s"], option), option)
                rest = {s: o[0] for s, o in best.items()}
                chosen.append((part, block, begin, n, {s: o[1:] for s, o in best.items()}))
                counts = [x + y for x, y in zip(counts, [*numbers, forced])]
                counts[3] += after is not None and tail + after not in LEGAL
                after = head
            state, audit = 0, []
            for part, block, begin, n, best in reversed(chosen):
                letters, state, what = best[state]
                audit += [x + "D" * (k - 1) for x, k in zip(letters, n)]
                yield c, part, block, begin, what, None, None, None, None, None, None
            yield c, None, None, None, None, *counts[:4], rest[0] + counts[4], "".join(audit)

    names = [x.split()[0] for x in JOINED.split(", ")]
    yield from rows_out(out(), names, [pa.int64()] * 4 + [pa.string()] + [pa.int64()] * 5 + [pa.string()], 20)


def hashed(batches):
    """mapInArrow: kept lines sorted by conversation and place -> conv_id, repaired_sha256; texts stream through."""

    def out():
        for c, rows in itertools.groupby(streamed(batches, ["conv_id", "role", "text"]), lambda r: r[0]):
            digest, between = hashlib.sha256(), ""
            for _, role, text in rows:
                digest.update(f"{between}{role}:{text}".encode())
                between = "\n"
            yield c, digest.hexdigest()

    yield from rows_out(out(), ["conv_id", "repaired_sha256"], [pa.int64(), pa.string()])


def same(a: DataFrame, b: DataFrame, *keys: str):
    out = a["conv_id"].eqNullSafe(b["conv_id"])
    for k in keys:
        out = out & (a[k] == b[k])
    return out


def long_conversations(spark: SparkSession, rows: DataFrame, ids: DataFrame, costs: Costs, piece: int) -> DataFrame:
    """Conversations of any length: sorted by ranges, solved in pieces, joined."""
    rows = rows.where("n > 0").groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
    rows = written(spark, rows, "conversations-long")
    order = [F.col("conv_id"), F.asc_nulls_first("turn"), F.col("role")]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, *order, F.substring("text", 1, 64)).sortWithinPartitions(*order, "text")
    lines = written(spark, ordered.mapInArrow(marked, "conv_id long, part long, at long, role string, text string, n long, fault string, digest binary, first boolean"), "conversations-lines")
    here = lines.where("first").select("conv_id", "digest", "part", "at")
    before = here.groupBy("conv_id", "digest").agg(F.min("part").alias("least"))
    again = here.join(before, same(here, before, "digest") & (F.col("part") > F.col("least"))).select(here["part"].alias("p"), here["at"].alias("a"))
    parts = lines.select("conv_id", "part", "at", F.substring("role", 1, 1).alias("role"), "n", "fault", "first").join(again, (F.col("part") == F.col("p")) & (F.col("at") == F.col("a")), "left")
    fault = F.when((F.col("fault") != "b") & (~F.col("first") | F.col("p").isNotNull()), F.lit("d")).otherwise(F.col("fault"))
    block = F.floor(F.col("at") / piece)
    pieces = parts.groupBy("conv_id", "part", block.alias("block")).agg(F.sort_array(F.collect_list(F.struct("at", "role", "n", fault.alias("fault")))).alias("rows"))
    pieces = pieces.withColumn("text", F.lit("")).mapInArrow(transfers(costs), PIECES).withColumn("text", F.lit(""))
    plan = pieces.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("block")).mapInArrow(joined, JOINED)
    plan = written(spark, plan, "conversations-plan")
    what = plan.where("part IS NOT NULL").select("conv_id", "part", "block", "from", "what")
    cut = lines.withColumn("block", block)
    kept = cut.join(what, same(cut, what, "part", "block")).select(cut["conv_id"], cut["part"], "at", "role", "text", F.substring("what", F.col("at") - F.col("from") + 1, F.lit(1)).alias("w"))
    kept = kept.where("w <> 'D'").withColumn("role", F.when(F.col("w") == "u", "user").when(F.col("w") == "a", "assistant").otherwise(F.col("role")))
    digest = kept.repartition("conv_id").sortWithinPartitions("conv_id", "part", "at").select("conv_id", "role", "text").mapInArrow(hashed, "conv_id long, repaired_sha256 string")
    gaps = rows.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    found = plan.where("part IS NULL")
    out = ids.join(found, same(ids, found), "left").join(digest, same(ids, digest), "left").join(gaps, same(ids, gaps), "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in NAMES[1:7]]
    return out.select(ids["conv_id"], *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def repair(spark: SparkSession, rows: DataFrame, costs: Costs = Costs(), long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES, piece: int = PIECE) -> DataFrame:
    """rows(conv_id, turn, role, text, n: how often a row is there) -> FOUND for each conv_id."""
    sizes = rows.groupBy("conv_id").agg(F.sum(F.greatest("n", F.lit(1))).alias("rows"), F.sum(F.octet_length("text") * F.greatest("n", F.lit(1))).alias("bytes"))
    long = written(spark, sizes.where((F.col("rows") > long_rows) | (F.col("bytes") > long_bytes)).select("conv_id"), "conversations-long-ids")
    some, short = long.limit(1).count(), rows
    if some:
        ids = small(long)
        short = rows.join(ids, same(rows, ids), "left_anti")
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "text"]
    out = short.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(whole(costs), FOUND)
    return out.union(long_conversations(spark, rows.join(ids, same(rows, ids), "left_semi"), long, costs, piece)) if some else out


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation of the table, after the damage."""
    return repair(spark, damaged(table(spark, sf_dir, "conversations")))


#: The whole contract in DuckDB SQL: rows are joined from the end, w0 to w3 hold the cheapest
#: rest (cost in 12 digits, then the audit) from each state of the pattern.
OP13_SQL = r"""
WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
summed AS (
  SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(name, ''), lambda c: ascii(c)::BIGINT)),
    lambda r, b: list_reduce(list_prepend(xor(r, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
      lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))) % 20 AS what FROM named),
harmed AS (
  SELECT conv_id, turn, CASE WHEN what = 4 THEN 'user' ELSE role END AS role,
         CASE what WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE what WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM summed),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS nr,
         rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM harmed),
judged AS (
  SELECT *, left(role, 1) AS initial, CASE WHEN bare = '' THEN 'b'
    WHEN nr > min(nr) OVER (PARTITION BY conv_id, role, text) THEN 'd' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '.' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY nr) AS earlier FROM placed),
counted AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
         count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
         count(*) FILTER (nr > 1 AND earlier || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id),
steps AS (
  SELECT conv_id, n + 1 AS nr, '000000000000' AS w0, '000000000010II' AS w1, '000000000005I' AS w2, '000000000000' AS w3 FROM counted
  UNION ALL
  SELECT conv_id, nr, least(v0, lpad((substr(v2, 1, 12)::BIGINT + 5)::VARCHAR, 12, '0') || 'I' || substr(v2, 13)), least(v1, lpad((substr(v2, 1, 12)::BIGINT + 5)::VARCHAR, 12, '0') || 'I' || substr(v2, 13)), least(v2, lpad((substr(v3, 1, 12)::BIGINT + 5)::VARCHAR, 12, '0') || 'I' || substr(v3, 13)), least(v3, lpad((substr(v2, 1, 12)::BIGINT + 5)::VARCHAR, 12, '0') || 'I' || substr(v2, 13)) FROM (
    SELECT s.conv_id, s.nr - 1 AS nr,
      least(lpad((substr(w0, 1, 12)::BIGINT + 2)::VARCHAR, 12, '0') || 'D' || substr(w0, 13), CASE WHEN ok THEN lpad((substr(w2, 1, 12)::BIGINT + 1 + more)::VARCHAR, 12, '0') || 'R' || substr(w2, 13) END, CASE WHEN ok AND initial = 's' THEN lpad((substr(w1, 1, 12)::BIGINT + more)::VARCHAR, 12, '0') || 'K' || substr(w1, 13) END, CASE WHEN ok AND initial = 'u' THEN lpad((substr(w2, 1, 12)::BIGINT + more)::VARCHAR, 12, '0') || 'K' || substr(w2, 13) END) AS v0,
      least(lpad((substr(w1, 1, 12)::BIGINT + 2)::VARCHAR, 12, '0') || 'D' || substr(w1, 13), CASE WHEN ok THEN lpad((substr(w2, 1, 12)::BIGINT + 1 + more)::VARCHAR, 12, '0') || 'R' || substr(w2, 13) END, CASE WHEN ok AND initial = 'u' THEN lpad((substr(w2, 1, 12)::BIGINT + more)::VARCHAR, 12, '0') || 'K' || substr(w2, 13) END) AS v1,
      least(lpad((substr(w2, 1, 12)::BIGINT + 2)::VARCHAR, 12, '0') || 'D' || substr(w2, 13), CASE WHEN ok THEN lpad((substr(w3, 1, 12)::BIGINT + 1 + more)::VARCHAR, 12, '0') || 'R' || substr(w3, 13) END, CASE WHEN ok AND initial = 'a' THEN lpad((substr(w3, 1, 12)::BIGINT + more)::VARCHAR, 12, '0') || 'K' || substr(w3, 13) END) AS v2,
      least(lpad((substr(w3, 1, 12)::BIGINT + 2)::VARCHAR, 12, '0') || 'D' || substr(w3, 13), CASE WHEN ok THEN lpad((substr(w2, 1, 12)::BIGINT + 1 + more)::VARCHAR, 12, '0') || 'R' || substr(w2, 13) END, CASE WHEN ok AND initial = 'u' THEN lpad((substr(w2, 1, 12)::BIGINT + more)::VARCHAR, 12, '0') || 'K' || substr(w2, 13) END) AS v3
    FROM steps s JOIN (SELECT *, fault NOT IN ('b', 'd') AS ok, CASE WHEN fault = 't' THEN 5 ELSE 0 END AS more FROM judged) j
      ON s.conv_id IS NOT DISTINCT FROM j.conv_id AND s.nr - 1 = j.nr) v),
solved AS (SELECT conv_id, substr(w0, 1, 12)::BIGINT AS cost, substr(w0, 13) AS audit FROM steps WHERE nr = 1),
letters AS (  -- no cheapest repair inserts, so that the letters are those of the rows
  SELECT j.conv_id, j.nr, j.role, j.text, j.initial, substr(s.audit, j.nr, 1) AS edit FROM judged j JOIN solved s ON j.conv_id IS NOT DISTINCT FROM s.conv_id),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY nr) - CASE WHEN first_value(edit || initial) OVER (PARTITION BY conv_id ORDER BY nr) = 'Ks' THEN 1 ELSE 0 END AS place
  FROM letters WHERE edit <> 'D'),
hashes AS (
  SELECT conv_id, sha256(string_agg((CASE WHEN edit = 'K' THEN role WHEN place % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || text, chr(10) ORDER BY nr)) AS digest
  FROM numbered GROUP BY conv_id)
SELECT c.conv_id, coalesce(n.gaps, 0)::BIGINT AS gaps, coalesce(n.blank, 0)::BIGINT AS blank, coalesce(n.duplicate, 0)::BIGINT AS duplicate, coalesce(n.truncated, 0)::BIGINT AS truncated,
       coalesce(n.illegal, 0)::BIGINT AS illegal, coalesce(s.cost, 0)::BIGINT AS cost, coalesce(s.audit, '') AS audit, coalesce(h.digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN counted n ON c.conv_id IS NOT DISTINCT FROM n.conv_id
LEFT JOIN solved s ON c.conv_id IS NOT DISTINCT FROM s.conv_id LEFT JOIN hashes h ON c.conv_id IS NOT DISTINCT FROM h.conv_id
"""
