"""Conversation repair against a brute-force search over audits."""

import hashlib
import random
import re
import zlib
from heapq import heappop, heappush

import pytest
from pyspark.sql import functions as F

from sparkdod.llm import conversation_repair as cr
from sparkdod.llm import queries

SCHEMA = "conv_id long, turn long, role string, text string"
PATTERN = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
NAMES = {"u": "user", "a": "assistant"}


def damage(rows):
    out = []
    for c, t, r, x in rows:
        harm = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = (" " if v is None else v for v in (r, x))
        x = "" if harm == 1 else re.sub("[.!?]", "", x) if harm == 2 else x
        out += [(c, t, "user" if harm == 4 else r, x)] * (0 if harm == 0 else 2 if harm == 3 else 1)
    return out


def brute(rows):
    """Figures of one conversation's (turn, role, text) in order: the first finished audit of a search by (cost, audit)."""
    seen, faults = set(), []
    for _, r, x in rows:
        body = x.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not body else "duplicate" if (r, x) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((r, x))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, s, kept = heappop(heap)
        if i == len(rows) and s in ("", "a"):
            return (gaps, *map(faults.count, ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())
        if (i, s) in done:
            continue
        done.add((i, s))
        named = [(w, PATTERN[s, w]) for w in "ua" if (s, w) in PATTERN]
        for w, t in named:
            heappush(heap, (cost + 2, audit + "I", i, t, (*kept, NAMES[w] + ":")))
        if i < len(rows):
            _, r, x = rows[i]
            heappush(heap, (cost + 3, audit + "D", i + 1, s, kept))
            if faults[i] not in ("blank", "duplicate"):
                late = faults[i] == "truncated"
                if (s, r[:1]) in PATTERN:
                    heappush(heap, (cost + late, audit + "K", i + 1, PATTERN[s, r[:1]], (*kept, f"{r}:{x}")))
                for w, t in named:
                    heappush(heap, (cost + late + 2, audit + "R", i + 1, t, (*kept, f"{NAMES[w]}:{x}")))


def want(rows):
    out = {c: brute([]) for c, _, _, _ in rows}
    for c in out:
        out[c] = brute(sorted(((t, r, x) for d, t, r, x in damage(rows) if d == c), key=lambda z: (z[0] is not None, z[0] or 0, z[1])))
    return out


def got(rows, **parameters):
    return {r["conv_id"]: tuple(r)[1:] for r in cr.digests_of_all(rows, cr.repair(cr.damaged(rows), **parameters)).collect()}


def some_rows(seed):
    rng, rows = random.Random(seed), []
    for c in range(120):
        for k in range(700 if c == 3 else rng.choice([1, 2, 3, 5, 8, 20])):  # one conversation holds about half of all rows
            rows.append((None if c == 5 else c, k if c % 9 or k else None, rng.choice(["user", "assistant", "system", "user", "assistant", "tool", None]),
                         rng.choice(["hi.", "ok", "yes!", "no?  ", "", None, " a b", f"x{rng.randrange(99)}.", f"y{rng.randrange(99)}"])))
    return rows


@pytest.mark.parametrize("seed, rows_per_part", [(1, 40), (2, 200_000)])
def test_repair(spark, seed, rows_per_part):
    rows = some_rows(seed)
    assert got(spark.createDataFrame(rows, SCHEMA), rows_per_part=rows_per_part) == want(rows)


def test_repair_query(spark, sf001):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf001}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {r["conv_id"]: tuple(r)[1:] for r in queries.op11_conversation_repair(spark, sf001).collect()} == want(rows)


def test_repaired_rows_read_as_the_pattern_wants(spark):
    df = spark.createDataFrame(some_rows(4), SCHEMA)
    chats = {}
    for r in cr.repair(df, rows_per_part=60).orderBy("pos", "nth").collect():
        chats.setdefault(r["conv_id"], "")
        chats[r["conv_id"]] += r["role"][0] if r["letter"] != "D" else ""
    assert all(re.fullmatch("(s?(ua)+)?", x) for x in chats.values()) and any(chats.values())


def test_odd_conversations(spark):
    # equal turns, repeated rows, empty roles, extra and clashing columns, a conversation that is dropped whole
    rows = [(1, 0, "user", "a."), (1, 0, "user", "a."), (1, 0, "assistant", "b."), (2, None, None, None), (None, None, "", "x."), (3, 0, "user", "x" * 300_000 + " \n")]
    gone = next(c for c in range(100, 999) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((gone, 0, "user", "hello."))
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("pos", "part", "h", "fault", "letter", "copies", "nth", "c", "id", "gaps")})
    out = got(df)
    assert out.keys() == {1, 2, None, 3, gone}
    assert out[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    plain = {r["conv_id"]: r["letter"] for r in cr.repair(df.filter("conv_id is null")).collect()}
    assert plain == {None: "D"} or plain == {None: "R"}  # an empty role is never kept
    audit = "".join(r["letter"] for r in cr.repair(df.filter("conv_id = 1")).orderBy("pos", "nth").collect())
    assert sorted(audit) in (["D", "I", "K", "K"], ["D", "K", "K"], ["D", "R", "R"], ["D", "I", "I", "K", "K"])
    assert got(df.limit(0)) == {}


def test_ranks_order_audits():
    import numpy as np

    rng = np.random.default_rng(7)
    initial, fault = rng.integers(0, 4, 300), rng.integers(0, 4, 300)
    s = cr.Segments(np.array([0, 40, 41, 200]), initial, fault, None)

    def audit(node):
        out = ""
        while s.choice[node] >= 0:
            out += cr.LETTERS[s.choice[node]]
            node = s.targets[s.choice[node], node]
        return out

    audits = [audit(n) for n in range(s.targets.shape[1])]
    assert all(len(a) == left for a, left in zip(audits, s.left))
    assert max(s.left) < 2 ** len(s.jumps)
