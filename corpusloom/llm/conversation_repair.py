"""Conversation structure repair as the lightest derivation of a weighted deduction system.

Items are suffixes: (i, q) says that the rows from i on can be repaired when
the roles so far leave the pattern ``(s?(ua)+)?`` in state q. A deduction joins
a suffix with an edit of the row before it (keep, rerole, delete), or with an
inserted turn, into a longer suffix; its function adds the costs and puts the
edit's initial in front of the audit. Knuth's agenda pops items by (cost, rows
covered, initial) and never takes one back. Every deduction raises that key, so
the functions are superior; and since two deductions of one item differ in
their first initial, an item's least key is its least (cost, audit).

A long conversation is cut into blocks of rows. A block's items end in each of
the four states instead of the goal; joining blocks is one more deduction.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from heapq import heappop, heappush
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpusloom.session import materialize

#: States of the pattern: nothing yet, after s, after u, after a.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
# the state before a turn, by the turn's initial and the state after it
BEFORE = {("s", SYSTEM): (NOTHING,), ("u", USER): (NOTHING, SYSTEM, ASSISTANT), ("a", ASSISTANT): (USER,)}
NEXT = {(b, r): after for (r, after), states in BEFORE.items() for b in states}
ROLES = {USER: "user", ASSISTANT: "assistant"}
# fixed values: costs of the edits, and of a truncated row that stays
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: What the end of the last row still needs, by state.
CLOSING = {NOTHING: (0, ""), SYSTEM: (2 * INSERT, "II"), USER: (INSERT, "I"), ASSISTANT: (0, "")}
BLANKS = " \t\n\x0b\x0c\r"
#: A block ends after so many rows or characters.
BLOCK_ROWS, BLOCK_CHARS = 512, 1 << 20


def lightest(initials: str, faults: list[str], ends: dict[int, str]) -> dict[tuple[int, str], tuple[int, str]]:
    """(cost, audit) of the lightest derivation from each state before the first row to each end.

    ``ends`` names what each state after the last row counts as. If all have
    one name, that is the goal, turns may be inserted after the last row, and
    the agenda stops when (first row, nothing yet) is final.
    """
    n, goal = len(initials), len(set(ends.values())) == 1
    agenda = [(0, 0, "", n, q, name, -1) for q, name in ends.items()]
    agenda.sort()
    final: dict[tuple, tuple[int, str, int]] = {}
    while agenda:
        cost, covered, letter, i, q, end, towards = heappop(agenda)
        if (i, q, end) in final:
            continue
        final[i, q, end] = cost, letter, towards
        if goal and i == 0 and q == NOTHING:
            break
        if (i < n or goal) and q in ROLES:
            for before in BEFORE["ua"[q - USER], q]:
                heappush(agenda, (cost + INSERT, covered, "I", i, before, end, q))
        if i == 0:
            continue
        fault = faults[i - 1]
        heappush(agenda, (cost + DELETE, covered + 1, "D", i - 1, q, end, q))
        if fault in ("blank", "duplicate"):
            continue
        more = cost + TRUNCATED if fault == "truncated" else cost
        for before in BEFORE.get((initials[i - 1], q), ()):
            heappush(agenda, (more, covered + 1, "K", i - 1, before, end, q))
        if q in ROLES:
            for before in BEFORE["ua"[q - USER], q]:
                heappush(agenda, (more + REROLE, covered + 1, "R", i - 1, before, end, q))
    found = {}
    for i, q, end in list(final):
        if i:
            continue
        audit, at = [], (0, q)
        while True:
            _, letter, towards = final[(*at, end)]
            if not letter:
                break
            audit.append(letter)
            at = (at[0] + (letter != "I"), towards)
        found[q, end] = final[0, q, end][0], "".join(audit)
    return found


def apply_audit(rows: list[tuple[str, str]], audit: str, state: int) -> list[tuple[str, str, str]]:
    """(role, text, edit) of the repaired turns; ``state`` is the one before the first row."""
    out, at = [], 0
    for letter in audit:
        role, text = ("", "") if letter == "I" else rows[at]
        at += letter != "I"
        if letter == "D":
            continue
        if letter != "K":
            role = "assistant" if state == USER else "user"
        state = NEXT[state, role[:1]]
        out.append((role, text, letter))
    return out


def written(turns: list[tuple[str, str, str]]) -> bytes:
    return "\n".join(f"{role}:{text}" for role, text, _ in turns).encode("utf-8")


@dataclass
class Block:
    """Rows of one conversation that follow each other, and what is counted on the way."""

    rows: list[tuple[str, str]] = field(default_factory=list)
    faults: list[str] = field(default_factory=list)
    turns: list[int] = field(default_factory=list)  # the different ones, in order, without null
    chars: int = 0
    illegal: int = 0
    last: tuple | None = None

    def add(self, turn: int | None, role: str, text: str, digest: str, seen: bool) -> None:
        said = text.strip(BLANKS)
        same = self.last is not None and self.last == (turn, role, digest)
        self.faults.append("blank" if not said else "duplicate" if seen or same else "" if said[-1] in ".!?" else "truncated")
        if self.rows:
            self.illegal += self.rows[-1][0][:1] + role[:1] not in ("su", "ua", "au")
        if turn is not None and (not self.turns or self.turns[-1] != turn):
            self.turns.append(turn)
        self.rows.append((role, text))
        self.chars += len(role) + len(text)
        self.last = turn, role, digest

    @property
    def initials(self) -> list[str]:
        return [role[:1] for role, _ in self.rows]


_TURNS = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("role", "text", "edit")]))
_COUNTS = ("n_rows", "turns", "blank", "duplicate", "truncated", "illegal", "cost")
_STATS = [T.StructField("low", T.LongType()), T.StructField("high", T.LongType()), *[T.StructField(c, T.LongType()) for c in _COUNTS]]
_KEY = [T.StructField("part", T.IntegerType()), T.StructField("seq", T.IntegerType())]


def _block_row(block: Block, whole: bool) -> dict:
    kinds = [block.faults.count(k) for k in ("blank", "duplicate", "truncated")]
    low, high = (block.turns[0], block.turns[-1]) if block.turns else (None, None)
    row = dict(zip(("low", "high", *_COUNTS), (low, high, len(block.rows), len(block.turns), *kinds, block.illegal, None), strict=True))
    row |= {"whole": whole, "first": block.initials[0], "last": block.initials[-1]}
    if whole:
        row["cost"], row["audit"] = lightest(block.initials, block.faults, {NOTHING: "", ASSISTANT: ""})[NOTHING, ""]
        turns = apply_audit(block.rows, row["audit"], NOTHING)
        return row | {"repaired_sha256": hashlib.sha256(written(turns)).hexdigest(), "messages": [dict(zip(("role", "text", "edit"), t, strict=True)) for t in turns]}
    paths = lightest(block.initials, block.faults, {q: str(q) for q in range(4)})
    ranks = {audit: rank for rank, audit in enumerate(sorted({a for _, a in paths.values()}))}
    given = [{"before": q, "after": int(end), "cost": cost, "rank": ranks[audit], "audit": audit} for (q, end), (cost, audit) in paths.items()]
    return row | {"paths": given, "messages": [{"role": r, "text": t, "edit": None} for r, t in block.rows]}


_PATHS = T.ArrayType(T.StructType([T.StructField(c, t) for c, t in (
    ("before", T.IntegerType()), ("after", T.IntegerType()), ("cost", T.LongType()), ("rank", T.IntegerType()), ("audit", T.StringType()))]))


def _blocks(rows: DataFrame) -> DataFrame:
    """Blocks of rows sorted by conversation over ranges; conversations inside one range and block are solved on the way."""
    schema = T.StructType([
        rows.schema["conv_id"], *_KEY, T.StructField("whole", T.BooleanType()), T.StructField("first", T.StringType()), T.StructField("last", T.StringType()),
        *_STATS, T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType()),
        T.StructField("messages", _TURNS), T.StructField("paths", _PATHS),
    ])
    arrow = to_arrow_schema(schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0
        conv, block, inner = object(), Block(), False

        def close(whole: bool) -> None:
            nonlocal seq, size
            held.append({"conv_id": conv, "part": part, "seq": seq, **_block_row(block, whole)})
            seq, size = seq + 1, size + block.chars

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != conv:
                    if block.rows:
                        close(inner)
                    # the first conversation of a range may go on from the one before
                    conv, inner, block = row[0], seq > 0, Block()
                elif len(block.rows) >= BLOCK_ROWS or block.chars >= BLOCK_CHARS:
                    close(False)
                    inner, block = False, Block(last=block.last)
                block.add(*row[1:])
            if len(held) >= 4096 or size >= BLOCK_CHARS:
                yield pa.RecordBatch.from_pylist(held, arrow)
                held, size = [], 0
        if block.rows:
            close(False)  # the last one may go on in the next range
        if held:
            yield pa.RecordBatch.from_pylist(held, arrow)

    return rows.mapInArrow(cut, schema)


def _cross(boundary: tuple[str, str]) -> int:
    return boundary[0] + boundary[1] not in ("su", "ua", "au")


def _chosen(blocks: DataFrame) -> DataFrame:
    """For the blocks of open conversations: the path to take, and on each first block the whole conversation's counts.

    Only numbers travel, a few per block; the blocks of one conversation meet in one task.
    """
    slim = F.transform("paths", lambda p: F.struct(p.before.alias("before"), p.after.alias("after"), p.cost.alias("cost"), p.rank.alias("rank")))
    light = blocks.select("conv_id", "part", "seq", "first", "last", *[s.name for s in _STATS], slim.alias("paths"))
    totals = [T.StructField(c, T.LongType()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    schema = T.StructType([
        blocks.schema["conv_id"], *_KEY, T.StructField("before", T.IntegerType()), T.StructField("after", T.IntegerType()), T.StructField("closing", T.StringType()), *totals,
    ])
    arrow = to_arrow_schema(schema)

    def fold(rows: list[dict]) -> list[dict]:
        # backwards: the lightest way on from each state before a block
        ahead = {q: (cost, None) for q, (cost, _) in CLOSING.items()}
        choices = []
        for row in reversed(rows):
            best: dict[int, tuple] = {}
            for p in row["paths"]:
                if p["after"] in ahead:
                    key = (p["cost"] + ahead[p["after"]][0], p["rank"], p["after"])
                    best[p["before"]] = min(best.get(p["before"], key), key)
            ahead = {q: (cost, after) for q, (cost, _, after) in best.items()}
            choices.append(ahead)
        turns = 0
        high = None
        for row in rows:
            turns += row["turns"] - (row["low"] is not None and row["low"] == high)
            high = row["high"] if row["high"] is not None else high
        low = next((r["low"] for r in rows if r["low"] is not None), None)
        whole = {c: sum(r[c] for r in rows) for c in ("blank", "duplicate", "truncated", "illegal")}
        whole["illegal"] += sum(_cross((a["last"], b["first"])) for a, b in zip(rows, rows[1:], strict=False))
        whole |= {"gaps": 0 if low is None else high - low + 1 - turns, "cost": ahead[NOTHING][0]}
        out, state = [], NOTHING
        for row, choice in zip(rows, reversed(choices), strict=True):
            after = choice[state][1]
            out.append({"conv_id": row["conv_id"], "part": row["part"], "seq": row["seq"], "before": state, "after": after, "closing": ""})
            state = after
        out[0] |= whole
        out[-1]["closing"] = CLOSING[state][1]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in batch.to_pylist())
        for _, mine in groupby(rows, itemgetter("conv_id")):
            yield pa.RecordBatch.from_pylist(fold(list(mine)), arrow)

    return light.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(run, schema)


def _repaired(blocks: DataFrame, chosen: DataFrame) -> DataFrame:
    """conv_id, part, seq, audit, messages of every block of an open conversation, along the chosen path."""
    schema = T.StructType([blocks.schema["conv_id"], *_KEY, T.StructField("audit", T.StringType()), T.StructField("messages", _TURNS)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                audit = next(p["audit"] for p in row["paths"] if (p["before"], p["after"]) == (row["before"], row["after"])) + row["closing"]
                turns = apply_audit([(m["role"], m["text"]) for m in row["messages"]], audit, row["before"])
                said = [dict(zip(("role", "text", "edit"), t, strict=True)) for t in turns]
                yield pa.RecordBatch.from_pylist([{**{c: row[c] for c in ("conv_id", "part", "seq")}, "audit": audit, "messages": said}], arrow)

    path = chosen.select("part", "seq", "before", "after", "closing")
    return blocks.select("conv_id", "part", "seq", "messages", "paths").join(path, ["part", "seq"]).mapInArrow(run, schema)


def _digested(repaired: DataFrame) -> DataFrame:
    """conv_id, audit, repaired_sha256 of open conversations: the blocks' texts pass one after the other through the hash."""
    schema = T.StructType([repaired.schema["conv_id"], T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in batch.to_pylist())
        for conv, mine in groupby(rows, itemgetter("conv_id")):
            audit, digest, first = [], hashlib.sha256(), True
            for row in mine:
                audit.append(row["audit"])
                if row["messages"]:
                    said = written([(m["role"], m["text"], m["edit"]) for m in row["messages"]])
                    digest.update(said if first else b"\n" + said)
                    first = False
            yield pa.RecordBatch.from_pylist([{"conv_id": conv, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}], arrow)

    return repaired.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(run, schema)


def _marked(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, digest, seen: whether an earlier turn of the conversation has this role and text."""
    rows = messages.withColumn("digest", F.sha2("text", 256)).withColumn("at", F.coalesce("turn", F.lit(-(1 << 63))))
    groups = rows.groupBy("conv_id", "role", "digest").agg(F.min("at").alias("first"), F.max("at").alias("final"))
    again = groups.filter("first < final").select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    seen = F.coalesce(F.col("at") > F.col("first"), F.lit(False))
    return rows.join(again, same, "left").select("conv_id", "turn", "role", "text", "digest", seen.alias("seen"))


@dataclass
class Repair:
    """``summary``: one row per conversation; ``messages``: the repaired turns, in order of (conv_id, block, place)."""

    summary: DataFrame
    messages: DataFrame


def repair_conversations(
    messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> Repair:
    """The cheapest edits that bring each conversation's roles into the pattern ``(s?(ua)+)?``.

    Rows stand by turn (null first), then role, then the text's SHA-256. A row's
    fault is the first of blank, duplicate (its role and text stood before in
    the conversation) and truncated (the last character that is not blank is
    none of ``.!?``). Costs: keep 0, rerole to user or assistant 1, delete 2,
    insert an empty user or assistant turn 5; blank and duplicate rows have to
    go, a truncated row that stays adds 5. Equal costs fall to the audit that
    is least in ASCII order.

    ``summary``: conv_id, gaps, blank, duplicate, truncated, illegal, cost,
    audit, repaired_sha256. Null roles and texts count as one blank, a null
    conversation is one of its own, repeated rows are duplicates, an empty
    table gives empty results, other columns are left alone. The rows are
    sorted over ranges, so that a long conversation is dealt to several tasks;
    its texts meet in one task only for the digest, one block at a time.
    """
    rows = messages.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("bigint").alias("turn"),
        F.coalesce(role_col, F.lit(" ")).alias("role"), F.coalesce(text_col, F.lit(" ")).alias("text"),
    )
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    blocks = materialize(_blocks(_marked(rows).repartitionByRange(*order).sortWithinPartitions(*order)), "repair-blocks")
    whole, open_ = blocks.filter("whole"), blocks.filter("NOT whole")
    chosen = materialize(_chosen(open_), "repair-paths")
    mended = materialize(_repaired(open_, chosen), "repair-open")
    counts = ("blank", "duplicate", "truncated", "illegal", "cost")
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).cast("bigint")
    plain = whole.select("conv_id", gaps.alias("gaps"), *counts, "audit", "repaired_sha256")
    digests = _digested(mended).withColumnRenamed("conv_id", "c")
    cut = chosen.filter("cost IS NOT NULL").join(digests, F.col("conv_id").eqNullSafe(F.col("c")))
    summary = plain.unionAll(cut.select("conv_id", "gaps", *counts, "audit", "repaired_sha256"))
    parts = whole.select("conv_id", "part", "seq", "messages").unionAll(mended.select("conv_id", "part", "seq", "messages"))
    block = (F.col("part").cast("bigint") * (1 << 32) + F.col("seq")).alias("block")
    return Repair(summary, parts.select("conv_id", block, F.posexplode("messages").alias("place", "m")).select("conv_id", "block", "place", "m.*"))


def damage(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage of the contract: crc32 of ``conv_id:turn`` modulo 20 (nulls: one blank)."""
    or_blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind: Column = F.crc32(F.concat(or_blank("conv_id"), F.lit(":"), or_blank("turn")).cast("binary")) % 20
    rows = messages.select("conv_id", "turn", or_blank("role").alias("role"), or_blank("text").alias("text"), kind.alias("kind")).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def with_lost(messages: DataFrame, summary: DataFrame) -> DataFrame:
    """``summary`` with a row of zeros for every conversation of ``messages`` that it lacks."""
    ids = messages.select("conv_id").distinct()
    found = summary.withColumnRenamed("conv_id", "c")
    joined = ids.join(found, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select(
        "conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256")
    )
