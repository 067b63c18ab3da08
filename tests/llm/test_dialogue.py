"""Repair of conversations against a search over all edits."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from readloom.llm import dialogue
from readloom.llm.dialogue import damaged, repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string, extra int"
LEGAL = re.compile(r"(s?(ua)+)?")


def brute_damage(rows):
    text = lambda v: " " if v is None else str(v)
    out = []
    for conv, turn, role, t, *_ in rows:
        kind = zlib.crc32(f"{text(conv)}:{text(turn)}".encode()) % 20
        role, t = text(role), text(t)
        if kind == 0:
            continue
        if kind == 1:
            t = ""
        if kind == 2:
            t = re.sub("[.!?]", "", t)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, t)] * (2 if kind == 3 else 1)
    return out


def brute_repair(rows):
    """Dijkstra over (cost, audit) without a look at the four states: prefixes of role initials that can still be legal."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    faults, seen = [], set()
    for _, _, role, text in rows:
        core = text.strip("\x20\x09\x0a\x0b\x0c\x0d")
        faults.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else "")
        seen.add((role, text))
    shape = lambda p: p if len(p) < 2 else p[-1]
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, made, lines = heapq.heappop(heap)
        if i == len(rows) and LEGAL.fullmatch(made):
            break
        if (i, shape(made)) in done:
            continue
        done.add((i, shape(made)))
        options = [("I", 2, i, r, f"{r}:") for r in ("user", "assistant")]
        if i < len(rows):
            _, _, role, text = rows[i]
            options.append(("D", 3, i + 1, None, None))
            if faults[i] not in ("blank", "duplicate"):
                extra = faults[i] == "truncated"
                options += [("K", extra, i + 1, role, f"{role}:{text}"), *[("R", 2 + extra, i + 1, r, f"{r}:{text}") for r in ("user", "assistant") if r[0] != role[:1]]]
        for letter, price, j, role, line in options:
            now = made + (role[:1] or "?") if role is not None else made
            if any(LEGAL.fullmatch(now + more) for more in ("", "a", "ua")):
                heapq.heappush(heap, (cost + price, audit + letter, j, now, lines + ((line,) if line is not None else ())))
    turns = [r[1] for r in rows if r[1] is not None]
    pairs = [a[2][:1] + b[2][:1] for a, b in zip(rows, rows[1:], strict=False)]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
        sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def brute(rows, damage=True):
    blank = lambda v: " " if v is None else v
    after = brute_damage(rows) if damage else [(r[0], r[1], blank(r[2]), blank(r[3])) for r in rows]
    out = {}
    for conv in {r[0] for r in rows}:
        out[conv] = brute_repair([r[:4] for r in after if r[0] == conv])
    return out


def collect(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


def made(seed, convs=40, most=9):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(rng.randrange(1, most)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["", " \n", "Yes.", "No", "Why?  ", "a longer text\nof lines!", "Yes.", None, "é. x"])
            rows.append((c if c else None, rng.choice([t, t, t + rng.randrange(4), None]), role, text, 1))
    return rows


@pytest.mark.parametrize(("block_rows", "block_chars"), [(4096, 1 << 22), (2, 1 << 22), (100, 5)])
def test_against_search(spark, block_rows, block_chars):
    rows = made(block_rows + block_chars)
    df = spark.createDataFrame(rows, SCHEMA)
    assert collect(repair(damaged(df), block_rows, block_chars)) == brute(rows)


def test_long_conversation_over_partitions(spark):
    rng = random.Random(7)
    rows = [(5, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice([f"t{t}.", f"t{t}", "again.", ""]), 0) for t in range(600)] + [(6, 0, "user", "Hi.", 0)]
    got = collect(repair(damaged(spark.createDataFrame(rows, SCHEMA).repartition(8)), 16))
    assert got == brute(rows)


def test_repeats_ties_and_nothing(spark):
    rows = [(1, 3, "user", "Hm.", 0)] * 70 + [(1, 4, "assistant", "Ok.", 0), (2, None, None, None, 0), (3, 1, "assistant", "x", 0), (4, 1, "system", "Be kind.", 0)]
    got = collect(repair(spark.createDataFrame(rows, SCHEMA)))
    assert got == brute(rows, damage=False)
    assert got[1][6] == "K" + "D" * 69 + "K" and got[2][6] == "D" and got[4][6] == "D"
    assert collect(repair(spark.createDataFrame([], SCHEMA))) == {}
    gone = spark.createDataFrame([(9, 1, "user", "x", 0)], "conv_id bigint, turn bigint, role string, text string, copies bigint")
    assert collect(repair(gone)) == {9: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_tables_of_stretches_combine():
    rng = random.Random(1)
    tables = [dialogue.row_table(rng.choice("uast"), rng.random() < 0.3, rng.random() < 0.3, rng.randrange(1, 3)) for _ in range(40)]
    for _ in range(50):
        i, j, k = sorted(rng.sample(range(40), 3))
        cut = lambda a, b: __import__("functools").reduce(dialogue.combine, tables[a:b], dialogue.IDENTITY)
        both, whole = dialogue.combine(cut(i, j), cut(j, k)), cut(i, k)
        assert [line[:4] for line in both] == [line[:4] for line in whole]
        for x, y in zip(both, whole, strict=True):
            live = [q for q in range(4) if x[q] < dialogue.NEVER]
            assert sorted(live, key=lambda q: x[4 + q]) == sorted(live, key=lambda q: y[4 + q])


def test_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    assert collect(repair(damaged(df))) == brute([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
