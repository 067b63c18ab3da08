"""Repair of conversations whose turns are lost, empty, doubled, cut short or of the wrong role.

Rows are edited at least cost until the initials of the roles read ``(s?(ua)+)?``. What was read so far is one of four
states (nothing, system, user, assistant), so any stretch of rows is a table of four by four costs; of the cheapest
edits between two states the ones whose letters come first in ASCII count. Edits that end in different states can't be
the beginnings of one another, so their order, kept as ranks beside the costs, decides for whatever follows.

Reconstruction divides and conquers (Hirschberg): a forward vector of costs and ranks and a backward vector of costs
meet in the middle, the crossing with the least rank among the cheapest is taken, and both halves are solved between the
states that are now known. Nothing but vectors is kept on the way.

The same holds above the rows. Rows are ordered over range partitions, so a conversation of any size spreads over many;
each task cuts its stretches into blocks of bounded size. A conversation within one block is solved there. Others are
tables of blocks, combined by partition and then by conversation; crossings go back down to the blocks, which are
solved apart and hashed in order, as a stream. Equal rows are one row with a count from the start.

Defined cases: a null role or text is one space; null turns come first; rows of one turn are ordered by role and text;
equal rows are repeats of one another; a conversation without rows has zeros, an empty audit and the hash of nothing; a
null conv_id is a conversation of its own; texts are read whole; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import Scratch, prepare

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
#: What an inserted or reroled turn has to be in each state, and where it leads.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Where a kept turn leads by the initial of its role.
KEPT = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
LEGAL = {"su", "ua", "au"}
#: Inserts that end a conversation well.
TAIL = ("", "II", "I", "")
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
NEVER = 1 << 60
#: Rows and characters of a block.
BLOCK_ROWS, BLOCK_CHARS = 4096, 4 << 20

Table = tuple[tuple[int, ...], ...]  # four rows of (four costs, four ranks)


# -- costs ------------------------------------------------------------------------------------------------------------


@lru_cache(None)
def row_edits(initial: str, forced: bool, truncated: bool) -> tuple[tuple[tuple[int, str], ...], ...]:
    """(cost, letters) of the best edits from state to state over one row and the inserts before it."""
    out = []
    for start in STATES:
        best = [(NEVER, "")] * 4
        state = start
        for inserts in range(3):
            before, letters = INSERT * inserts, "I" * inserts
            found = [(state, DELETE, "D")]
            if not forced:
                if (state, initial) in KEPT:
                    found.append((KEPT[state, initial], truncated * TRUNCATED, "K"))
                found.append((NEXT[state], REROLE + truncated * TRUNCATED, "R"))
            for end, cost, letter in found:
                best[end] = min(best[end], (before + cost, letters + letter))
            state = NEXT[state]
        out.append(tuple(best))
    return tuple(out)


def _ranked(best: list[tuple]) -> tuple[int, ...]:
    order = sorted(STATES, key=lambda q: best[q])
    return tuple(order.index(q) for q in STATES)


@lru_cache(None)
def row_table(initial: str, forced: bool, truncated: bool, copies: int = 1) -> Table:
    """Costs and ranks over one row and its copies, which are deleted."""
    more = DELETE * (copies - 1)
    edits = row_edits(initial, forced, truncated)
    return tuple((*[min(NEVER, c + more) for c, _ in e], *_ranked([(c >= NEVER, letters) for c, letters in e])) for e in edits)


def advance(vector: tuple[int, ...], table: Table) -> tuple[int, ...]:
    """A forward vector (four costs, four ranks) past a table: cheapest first, then least rank here, then there."""
    best = [(NEVER, 9, 9)] * 4
    for q in STATES:
        if vector[q] < NEVER:
            line = table[q]
            for end in STATES:
                if line[end] < NEVER:
                    best[end] = min(best[end], (vector[q] + line[end], vector[4 + q], line[4 + end]))
    return (*[b[0] for b in best], *_ranked([b[1:] for b in best]))


def retreat(costs: tuple[int, ...], table: Table) -> tuple[int, ...]:
    """A backward vector of costs before a table."""
    return tuple(min(min(NEVER, line[end] + costs[end]) for end in STATES) for line in table)


def at(state: int) -> tuple[int, ...]:
    return tuple(0 if q == state else NEVER for q in STATES)


def begin(state: int) -> tuple[int, ...]:
    return (*at(state), 0, 0, 0, 0)


IDENTITY: Table = tuple(begin(q) for q in STATES)


def combine(first: Table, second: Table) -> Table:
    return tuple(advance(line, second) for line in first)


def crossings(tables: list[Table], start: int, end: int) -> Iterator[tuple[int, int]]:
    """The states before and after each table on the best way from start to end, by halves."""
    pending = [(0, len(tables), start, end)]
    while pending:
        lo, hi, a, b = pending.pop()
        if hi - lo == 1:
            yield a, b
            continue
        middle = (lo + hi) // 2
        forward, backward = begin(a), at(b)
        for table in tables[lo:middle]:
            forward = advance(forward, table)
        for table in reversed(tables[middle:hi]):
            backward = retreat(backward, table)
        state = min(STATES, key=lambda q: (forward[q] + backward[q], forward[4 + q]))
        pending += [(middle, hi, state, b), (lo, middle, a, state)]


# -- stretches of rows ------------------------------------------------------------------------------------------------

#: Counts that add up over stretches; turns and initials at both ends tell what the border adds.
COUNTS = ("blank", "duplicate", "truncated", "illegal", "distinct")


def summary(rows: list[dict]) -> dict:
    """Table and counts of consecutive rows (initial, fault, copies, turn)."""
    vectors, counts = IDENTITY, dict.fromkeys(COUNTS, 0)
    before, turns = None, []
    for r in rows:
        fault, copies = r["fault"], r["copies"]
        vectors = combine(vectors, row_table(r["initial"], fault in ("blank", "duplicate"), fault == "truncated", copies))
        if fault:
            counts[fault] += copies if fault in ("blank", "duplicate") else 1
        if fault not in ("blank", "duplicate"):
            counts["duplicate"] += copies - 1
        counts["illegal"] += copies - 1 + (before is not None and before + r["initial"] not in LEGAL)
        before = r["initial"]
        if r["turn"] is not None:
            counts["distinct"] += not turns or turns[-1] != r["turn"]
            turns = [turns[0] if turns else r["turn"], r["turn"]]
    return {"table": [c for line in vectors for c in line], **counts, "first": rows[0]["initial"], "last": before, "low": turns[0] if turns else None, "high": turns[-1] if turns else None}


def joined(parts: list[dict]) -> dict:
    """The summary of stretches that follow one another."""
    out = dict(parts[0])
    table = as_table(out["table"])
    for p in parts[1:]:
        table = combine(table, as_table(p["table"]))
        for c in COUNTS:
            out[c] += p[c]
        out["illegal"] += out["last"] + p["first"] not in LEGAL
        if p["low"] is not None:
            out["distinct"] -= out["high"] is not None and out["high"] == p["low"]
            out["low"] = p["low"] if out["low"] is None else out["low"]
            out["high"] = p["high"]
        out["last"] = p["last"]
    return out | {"table": [c for line in table for c in line]}


def as_table(flat: list[int]) -> Table:
    return tuple(tuple(int(x) for x in flat[8 * q : 8 * q + 8]) for q in STATES)


def verdict(whole: dict) -> tuple[dict, int]:
    """Result columns of a conversation (audit and hash apart) and the state in which its rows end."""
    line = as_table(whole["table"])[NOTHING]
    end = min((q for q in STATES if line[q] < NEVER), key=lambda q: (line[q] + INSERT * len(TAIL[q]), line[4 + q]))
    gaps = 0 if whole["low"] is None else whole["high"] - whole["low"] + 1 - whole["distinct"]
    return {"gaps": gaps, **{c: whole[c] for c in COUNTS[:4]}, "cost": line[end] + INSERT * len(TAIL[end])}, end


def edited(rows: list[dict], start: int, end: int) -> tuple[str, list[str]]:
    """Audit letters and repaired lines of consecutive rows between two states."""
    kinds = [(r["initial"], r["fault"] in ("blank", "duplicate"), r["fault"] == "truncated") for r in rows]
    tables = [row_table(*kind, r["copies"]) for kind, r in zip(kinds, rows, strict=True)]
    audit, lines = [], []
    for r, kind, (a, b) in zip(rows, kinds, crossings(tables, start, end), strict=True):
        letters = row_edits(*kind)[a][b][1]
        state = a
        for letter in letters:
            if letter == "I":
                state = NEXT[state]
                lines.append(f"{ROLE[state]}:")
            elif letter == "K":
                lines.append(f"{r['role']}:{r['text']}")
            elif letter == "R":
                lines.append(f"{ROLE[NEXT[state]]}:{r['text']}")
        audit += [letters, "D" * (r["copies"] - 1)]
    return "".join(audit), lines


def tail_lines(end: int) -> list[str]:
    return {"II": ["user:", "assistant:"], "I": ["assistant:"], "": []}[TAIL[end]]


def solved(rows: list[dict]) -> dict:
    """All result columns of a conversation in one piece."""
    if not rows:
        return {"gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    found, end = verdict(summary(rows))
    audit, lines = edited(rows, NOTHING, end)
    return found | {"audit": audit + TAIL[end], "repaired_sha256": hashlib.sha256("\n".join(lines + tail_lines(end)).encode()).hexdigest()}


# -- Spark ------------------------------------------------------------------------------------------------------------

SUMMARY_TYPE = "table array<bigint>, blank bigint, duplicate bigint, truncated bigint, illegal bigint, distinct bigint, first string, last string, low bigint, high bigint"
RESULT_TYPE = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
ROW_TYPE = "initial string, fault string, copies bigint, turn bigint, role string, text string"


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: rows as crc32(conv_id:turn) % 20 damages them (copies 0: dropped)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    x = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind"))
    new_text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return x.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), new_text.alias("text"), F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).cast("bigint").alias("copies"))


def with_faults(rows: DataFrame) -> DataFrame:
    """conv, turn, role, text, copies, initial, fault of the distinct rows; copies: how often each occurs."""
    text = lambda c: F.coalesce(F.col(c), F.lit(" "))
    copies = F.col("copies") if "copies" in rows.columns else F.lit(1).cast("bigint")
    keyed = rows.select(F.coalesce(F.concat(F.lit("v"), F.col("conv_id").cast("string")), F.lit("n")).alias("conv"), F.col("turn").cast("bigint").alias("turn"), text("role").alias("role"), text("text").alias("text"), copies.alias("copies"))
    once = keyed.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn"))
    seen = once.filter("copies > 0").groupBy("conv", "role", "text").agg(F.min(place).alias("earliest"))
    core = F.regexp_replace("text", r"[\x20\x09-\x0D]+$", "")
    fault = F.when(core == "", "blank").when(F.col("earliest") < place, "duplicate").when(~core.rlike(r"[.!?]\z"), "truncated").otherwise("")
    joined_ = once.join(seen, ["conv", "role", "text"], "left")
    return joined_.select("conv", "turn", "role", "text", "copies", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))


def _cut(ordered: DataFrame, block_rows: int, block_chars: int) -> DataFrame:
    """One row per block: conv, part, seq, result (of conversations that lie in one block), else summary and rows."""
    row = pa.struct([("initial", pa.string()), ("fault", pa.string()), ("copies", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    sums = pa.struct([("table", pa.list_(pa.int64())), *[(c, pa.int64()) for c in COUNTS], ("first", pa.string()), ("last", pa.string()), ("low", pa.int64()), ("high", pa.int64())])
    result = pa.struct([*[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()), ("repaired_sha256", pa.string())])
    schema = pa.schema([("conv", pa.string()), ("part", pa.int32()), ("seq", pa.int32()), ("result", result), ("summary", sums), ("rows", pa.list_(row))])
    names = ["turn", "role", "text", "copies", "initial", "fault"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        conv, first, seq, rows, chars, done = None, True, 0, [], 0, []

        def block(last: bool) -> None:
            """What has gathered leaves as a result if it is a whole conversation, else as a block."""
            whole = seq == 0 and last and not first
            live = [r for r in rows if r["copies"]]
            if whole:
                done.append({"conv": conv, "part": part, "seq": seq, "result": solved(live), "summary": None, "rows": None})
            else:
                done.append({"conv": conv, "part": part, "seq": seq, "result": None, "summary": summary(live) if live else None, "rows": live})

        for batch in batches:
            for c, *values in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if c != conv:
                    if conv is not None:
                        block(True)
                        first = False
                    conv, seq, rows, chars = c, 0, [], 0
                elif len(rows) >= block_rows or chars >= block_chars:
                    block(False)
                    seq, rows, chars = seq + 1, [], 0
                rows.append(dict(zip(names, values, strict=True)))
                chars += len(values[2])
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
                done.clear()
        if conv is not None:
            first = True  # the last conversation may go on in the next partition
            block(True)
            yield pa.RecordBatch.from_pylist(done, schema)

    struct = lambda t: "struct<" + t.replace(", ", ",").replace(" ", ":") + ">"
    out = f"conv string, part int, seq int, result {struct(RESULT_TYPE)}, summary {struct(SUMMARY_TYPE)}, rows array<{struct(ROW_TYPE)}>"
    return ordered.select("conv", *names).mapInArrow(run, out)


def _nodes(pdf: pd.DataFrame, *order: str) -> list[dict]:
    """Summaries in order, with the nulls of turns as None."""
    rows = pdf.sort_values(list(order)).to_dict("records")
    for r in rows:
        for c in ("low", "high"):
            r[c] = None if pd.isna(r[c]) else int(r[c])
        for c in COUNTS:
            r[c] = int(r[c])
    return rows


def _across(blocks: DataFrame) -> DataFrame:
    """Results of conversations that lie in several blocks (or may do so)."""
    flat = blocks.filter("summary is not null").select("conv", "part", "seq", *[F.col(f"summary.{c.split()[0]}").cast("string" if c.split()[0] in ("low", "high") else c.split()[1]).alias(c.split()[0]) for c in SUMMARY_TYPE.split(", ")])
    # Turns travel as text, as pandas would make doubles of a column with nulls.
    text_type = SUMMARY_TYPE.replace("low bigint", "low string").replace("high bigint", "high string")

    def by_part(pdf: pd.DataFrame) -> pd.DataFrame:
        whole = joined(_nodes(pdf, "seq"))
        return pd.DataFrame([{"conv": pdf["conv"].iloc[0], "part": pdf["part"].iloc[0]} | {c.split()[0]: whole[c.split()[0]] for c in SUMMARY_TYPE.split(", ")}]).astype({"low": object, "high": object}).assign(low=str_or_none(whole["low"]), high=str_or_none(whole["high"]))

    def by_conv(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = _nodes(pdf, "part")
        found, end = verdict(joined(nodes))
        ways = crossings([as_table(n["table"]) for n in nodes], NOTHING, end)
        return pd.DataFrame([{"conv": n["conv"], "part": n["part"], "a": a, "b": b, "end": end} | found for n, (a, b) in zip(nodes, ways, strict=True)])

    def down(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = _nodes(pdf, "seq")
        ways = crossings([as_table(n["table"]) for n in nodes], int(nodes[0]["a"]), int(nodes[0]["b"]))
        return pd.DataFrame([{"conv": n["conv"], "part": n["part"], "seq": n["seq"], "a": a, "b": b} for n, (a, b) in zip(nodes, ways, strict=True)])

    verdict_type = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint"
    parts = flat.groupBy("conv", "part").applyInPandas(by_part, f"conv string, part int, {text_type}")
    # A conversation has one row for each range partition at most.
    tops = Scratch.table(parts.groupBy("conv").applyInPandas(by_conv, f"conv string, part int, a int, b int, end int, {verdict_type}"), "repair-tops")
    ways = flat.join(tops.select("conv", "part", "a", "b"), ["conv", "part"]).groupBy("conv", "part").applyInPandas(down, "conv string, part int, seq int, a int, b int")
    verdicts = tops.groupBy("conv").agg(*[F.first(c.split()[0]).alias(c.split()[0]) for c in f"end int, {verdict_type}".split(", ")])
    pieces = blocks.select("conv", "part", "seq", "rows").join(ways, ["conv", "part", "seq"])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for conv, part, seq, rows, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                audit, lines = edited(rows, a, b)
                yield pa.RecordBatch.from_arrays([pa.array([conv]), pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([audit]), pa.array([len(lines)]), pa.array(["\n".join(lines)])], ["conv", "part", "seq", "audit", "lines", "repaired"])

    done = pieces.mapInArrow(solve, "conv string, part int, seq int, audit string, lines bigint, repaired string").join(verdicts, "conv")
    ordered = done.repartition("conv").sortWithinPartitions("conv", "part", "seq")
    columns = ["conv", "audit", "lines", "repaired", "end", *[c.split()[0] for c in verdict_type.split(", ")]]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, state, lines, row = None, [], None, 0, None

        def finish() -> pa.RecordBatch:
            end = row["end"]
            for line in tail_lines(end):
                add(line)
            values = [row[c] for c in columns[5:]]
            return pa.RecordBatch.from_arrays([pa.array([conv]), *[pa.array([v], pa.int64()) for v in values], pa.array(["".join([*audit, TAIL[end]])]), pa.array([state.hexdigest()])], ["conv", *columns[5:], "audit", "repaired_sha256"])

        def add(text: str) -> None:
            nonlocal lines
            state.update((b"\n" if lines else b"") + text.encode())
            lines += 1

        for batch in batches:
            for r in batch.to_pylist():
                if r["conv"] != conv:
                    if conv is not None:
                        yield finish()
                    conv, audit, state, lines = r["conv"], [], hashlib.sha256(), 0
                row = r
                audit.append(r["audit"])
                if r["lines"]:
                    add(r["repaired"])
        if conv is not None:
            yield finish()

    return ordered.select(*columns).mapInArrow(digest, f"conv string, {RESULT_TYPE}")


def str_or_none(value: int | None) -> str | None:
    return None if value is None else str(value)


def repair(rows: DataFrame, block_rows: int = BLOCK_ROWS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """conv_id and the result columns of every conversation. rows: conv_id, turn, role, text and, if given, copies (how
    often a row occurs; 0: it is gone, but its conversation is not)."""
    spark = rows.sparkSession
    prepare(spark)
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "text"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = with_faults(rows).repartitionByRange(n, *order).sortWithinPartitions(*order)
    cut = Scratch.table(_cut(ordered, block_rows, block_chars), "repair-blocks")
    whole = cut.filter("result is not null").select("conv", "result.*")
    open_ = cut.filter("result is null").select("conv", "part", "seq", "summary", "rows")
    some = _across(open_)
    live = open_.groupBy("conv").agg(F.bool_or(F.col("summary").isNotNull()).alias("live")).filter("not live")
    zero = F.lit(0).cast("bigint")
    none = live.select("conv", *[zero.alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.lit("").alias("audit"), F.lit(hashlib.sha256(b"").hexdigest()).alias("repaired_sha256"))
    kind = dict(rows.dtypes)["conv_id"]
    both = whole.unionByName(some).unionByName(none)
    return both.select(F.when(F.col("conv") != "n", F.expr("substring(conv, 2)")).cast(kind).alias("conv_id"), *[c for c in both.columns if c != "conv"])


def damage_and_repair(conversations: DataFrame) -> DataFrame:
    return repair(damaged(conversations))
