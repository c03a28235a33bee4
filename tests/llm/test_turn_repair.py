"""Conversation repair against a plain search that compares whole edit strings."""
import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspan.llm import queries, turnrepair

SCHEMA = "conv_id long, turn long, role string, text string"


def harmed(rows):
    out = []
    for c, t, r, x in rows:
        c_, t_, r, x = (" " if v is None else str(v) for v in (c, t, r, x))
        kind = zlib.crc32(f"{c_}:{t_}".encode()) % 20
        x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
        out += [(c, t, "user" if kind == 4 else r, x)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def asked(state):
    return "a" if state == "u" else "u"


def cheapest(turns):
    """(cost, edits) of turns (initial, must go, truncated), least by cost and then by the string."""
    behind = {s: (0, "") if s in "0a" else (1 << 30, "") for s in "0sua"}
    for turn in [None, *reversed(turns)]:
        now = dict(behind)
        if turn:
            initial, must, cut = turn
            for s in "0sua":
                ways = [(behind[s][0] + 2, "D" + behind[s][1])]
                if not must:
                    stay = initial if (initial == "s" and s == "0") or (initial in "ua" and initial == asked(s)) else None
                    ways += [(behind[stay][0] + 5 * cut, "K" + behind[stay][1])] if stay else []
                    ways += [(behind[asked(s)][0] + 1 + 5 * cut, "R" + behind[asked(s)][1])]
                now[s] = min(ways)
        for _ in range(4):
            for s in "0sua":
                now[s] = min(now[s], (now[asked(s)][0] + 5, "I" + now[asked(s)][1]))
        behind = now
    return behind["0"]


def brute(rows):
    by, out = defaultdict(list), []
    for r in harmed(rows):
        by[r[0]].append(r)
    for c in {r[0] for r in rows}:
        order = lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(f"{len(r[2])}\n{r[2]}\n{r[3]}".encode()).digest())
        mine, seen, n, turns = sorted(by[c], key=order), set(), [0, 0, 0], []
        for _, _, role, text in mine:
            body = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = 0 if not body else 1 if (role, text) in seen else 2 if body[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                n[fault] += 1
            turns.append((role[0] if role[:1] in tuple("sua") else "x", fault in (0, 1), fault == 2))
        numbers = {r[1] for r in mine} - {None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        cost, audit = cheapest(turns)
        left, state, result = iter(mine), "0", []
        for e in audit:
            _, _, role, text = (None, None, None, "") if e == "I" else next(left)
            if e != "D":
                state = role[0] if e == "K" else asked(state)
                result.append((role if e == "K" else {"u": "user", "a": "assistant"}[state]) + ":" + text)
        out.append((c, gaps, *n, illegal, cost, audit, hashlib.sha256("\n".join(result).encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in turnrepair.repair_digests(df).collect()), key=repr)


def some(seed, convs=60):
    rnd = random.Random(seed)
    roles, texts = ["system", "user", "assistant", None, "", "tool", "s"], ["a b.", "x!", "cut", "", None, "  ", "hey?\n", "e. 🙂", "é\x85"]
    return [(c, rnd.choice([None, *range(8)]), rnd.choice(roles), rnd.choice(texts)) for c in [*range(convs), None] for _ in range(rnd.randrange(14))]


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in queries.QUERIES["op13_block_table_turn_repair"](spark, sf).collect()), key=repr) == brute(rows)


def test_awkward_conversations(spark):
    rows = some(3)
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(3)) == brute(rows)


def test_long_conversation_over_many_parts(spark):
    rnd = random.Random(4)
    rows = some(5, 5) + [(999, i % 700, rnd.choice(["user", "assistant", "system"]), rnd.choice(["a.", "b", "c!", f"{i}."])) for i in range(4000)]
    rows += [(7, None, "user", "the same.")] * 50
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    parts = turnrepair.pieces(turnrepair.coded(turnrepair.damaged(df)))
    assert parts.where("conv_id = 999").count() > 1
    assert got(df) == brute(rows)


def test_repaired_turns(spark):
    rows = [(1, 1, "user", "Hi."), (1, 2, "user", "More."), (1, 3, "assistant", "Yes."), (2, 1, "assistant", "Late."), (3, 1, "user", " ")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"edit": F.lit(1), "kind": F.lit("x")})
    out = sorted(tuple(r) for r in turnrepair.repaired(df).collect())
    assert [(r[0], r[2], r[4], r[5]) for r in out if r[0] == 1] == [(1, "K", "user", "More."), (1, "K", "assistant", "Yes.")]
    assert [r for r in out if r[0] in (2, 3)] == []


def test_empty(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == []


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 17])
def test_blocks_equal_single_steps(n):
    rng = np.random.default_rng(n)
    t = turnrepair.tables()
    for _ in range(20):
        symbols = rng.integers(0, turnrepair.SYMBOLS, n)
        v, low = turnrepair.change(symbols)
        for start in range(len(t.vectors)):
            want = t.vectors[start]
            for s in symbols[::-1]:
                want = turnrepair.before(int(s), want)
            assert tuple(x + low[start] for x in t.vectors[v[start]]) == want
