"""Repairing the turns of conversations at the least cost.

A conversation should read (system)? (user assistant)+, or be empty. Rows may be kept, given the other role, or deleted,
and turns without text may be inserted; each edit has a cost. What is still to be paid from a row on depends only on
where the grammar stands: at the start, behind a system, a user or an assistant turn. `to_go` works this out backward,
`walk` then goes forward along edits whose cost is exactly the difference, and takes the first in ASCII order of those.

A conversation is put in order by a shuffle by its id and read as a stream. One of more than LONG rows is cut into pieces
of a range partitioning instead: the costs of a piece are a matrix over the four states, these are chained over the
pieces' few rows, and each piece is walked by itself once it is known where it starts and what its end costs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.common import arrow_pass, cut

START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
#: The state behind the turn that the grammar wants next, and behind one of a role that it allows.
NEXT = (USER, USER, ASSISTANT, USER)
KEPT = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
ROLE = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
REROLE, DELETE, INSERT, CUT_SHORT = 1, 2, 5, 5
#: What the end costs: nothing at the start and behind an assistant turn; elsewhere turns must follow.
END = (0, math.inf, math.inf, 0)
#: Rows of a conversation beyond which it is cut into pieces.
LONG = 20_000
BLANK, DUPLICATE, TRUNCATED = "blank", "duplicate", "truncated"
WHITE = r"\x20\x09-\x0D"

ROWS = "conv_id long, turn long, role string, text string, copies long, fault string, again boolean"
RESULT = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)


class Row(NamedTuple):
    turn: int | None
    role: str
    text: str
    fault: str | None
    #: Further rows that equal this one; all of them have to go.
    more: int


def inserted(costs: Iterable[float]) -> tuple[float, ...]:
    """Costs to go from each state where turns may be inserted first."""
    start, system, user, assistant = costs
    user, assistant = min(user, INSERT + assistant), min(assistant, INSERT + user)
    return min(start, INSERT + user), min(system, INSERT + user), user, assistant


def edits(row: Row, state: int, after: tuple[float, ...]) -> list[tuple[str, float, int]]:
    """(initial, cost to go, next state) of the edits of a row itself, in ASCII order."""
    out = [("D", DELETE + after[state], state)]
    if row.fault not in (BLANK, DUPLICATE):
        short = CUT_SHORT if row.fault == TRUNCATED else 0
        kept = KEPT.get((row.role[:1], state))
        if kept is not None:
            out.append(("K", short + after[kept], kept))
        out.append(("R", short + REROLE + after[NEXT[state]], NEXT[state]))
    return out


def to_go(rows: list[Row], end: tuple[float, ...] = END) -> list[tuple[float, ...]]:
    """The costs to go before each row and at the end, from each state."""
    out = [inserted(end)]
    for row in reversed(rows):
        after = tuple(x + DELETE * row.more for x in out[-1])
        out.append(inserted(min(cost for _, cost, _ in edits(row, s, after)) for s in STATES))
    return out[::-1]


def walk(rows: list[Row], costs: list[tuple[float, ...]], state: int, last: bool = True) -> tuple[str, list[str], int]:
    """(audit, repaired turns, end state) of the cheapest edits, the ASCII-least of those; last: nothing follows."""
    audit: list[str] = []
    turns: list[str] = []

    def insert() -> int:
        audit.append("I")
        turns.append(f"{ROLE[NEXT[state]]}:")
        return NEXT[state]

    for row, here, behind in zip(rows, costs, costs[1:], strict=False):
        after = tuple(x + DELETE * row.more for x in behind)
        while True:
            tight = [(letter, to) for letter, cost, to in edits(row, state, after) if cost == here[state]]
            if tight and tight[0][0] == "D" or here[state] != INSERT + here[NEXT[state]]:
                break
            state = insert()
        letter, to = tight[0]
        if letter != "D":
            turns.append(f"{row.role if letter == 'K' else ROLE[to]}:{row.text}")
        state = to
        audit.append(letter + "D" * row.more)
    while last and costs[-1][state]:
        state = insert()
    return "".join(audit), turns, state


class Counts(NamedTuple):
    """What is counted over a conversation or a piece of it."""

    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    first: str | None = None
    last: str | None = None
    low: int | None = None
    high: int | None = None
    turns: int = 0

    def then(self, other: Counts) -> Counts:
        """With what follows."""
        if other.first is None:
            return self
        if self.first is None:
            return other
        seam = (self.last, other.first) not in LEGAL
        same = self.high is not None and self.high == other.low
        return Counts(
            self.blank + other.blank, self.duplicate + other.duplicate, self.truncated + other.truncated,
            self.illegal + other.illegal + seam, self.first, other.last, other.low if self.low is None else self.low,
            self.high if other.high is None else other.high, self.turns + other.turns - same,
        )

    @property
    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


def counts(rows: list[Row]) -> Counts:
    out = Counts()
    for r in rows:
        initial, extra = r.role[:1], r.more
        doubles = extra if r.fault == BLANK else 0
        inner = extra if (initial, initial) not in LEGAL else 0
        out = out.then(
            Counts(
                (r.fault == BLANK) + doubles, (r.fault == DUPLICATE) + extra - doubles, int(r.fault == TRUNCATED), inner, initial, initial,
                r.turn, r.turn, 0 if r.turn is None else 1,
            )
        )
    return out


def conversations(batches: Iterator[pa.RecordBatch], key: int = 1) -> Iterator[tuple[tuple, list[Row]]]:
    """(conversation's id, its rows) of batches in order of ROWS; key: so many leading columns tell conversations apart.

    Where `again` is null, the rows of a conversation are all here, and a repeated role and text is found by looking back.
    """
    now, rows, seen = None, [], set()
    for batch in batches:
        for line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            name, (turn, role, text, copies, fault, again) = line[:key], line[key:]
            if name != now:
                if now is not None:
                    yield now, rows
                now, rows, seen = name, [], set()
            if not copies:  # a row that is gone, which stands for its conversation
                continue
            if again is None:
                mark = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
                again = mark in seen
                seen.add(mark)
            rows.append(Row(turn, role, text, DUPLICATE if again and fault != BLANK else fault, copies - 1))
    if now is not None:
        yield now, rows


def _table(out: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "double": pa.float64(), "array<double>": pa.list_(pa.float64()), "array<int>": pa.list_(pa.int32())}
    names, types = zip(*(f.split(" ") for f in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kinds[t]) for i, t in enumerate(types)], names=list(names))


def _streamed(rows: Iterator[tuple], schema: str, size: int = 512) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    for row in rows:
        out.append(row)
        if len(out) == size:
            yield _table(out, schema)
            out = []
    if out:
        yield _table(out, schema)


def _told(name: object, c: Counts, cost: float, audit: str, digest: str) -> tuple:
    return (name, c.gaps, c.blank, c.duplicate, c.truncated, c.illegal, int(cost), audit, digest)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def each() -> Iterator[tuple]:
        for (name,), rows in conversations(batches):
            costs = to_go(rows)
            audit, turns, _ = walk(rows, costs, START)
            yield _told(name, counts(rows), costs[0][START], audit, hashlib.sha256("\n".join(turns).encode()).hexdigest())

    yield from _streamed(each(), RESULT)


def faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with `fault` blank or truncated, and copies and again as ROWS has them."""
    text = F.col("text")
    fault = F.when(~text.rlike(f"[^{WHITE}]"), BLANK).when(~text.rlike(rf"[.!?][{WHITE}]*\z"), TRUNCATED)
    return rows.withColumn("fault", F.when(F.col("copies") > 0, fault)).withColumn("again", F.lit(None).cast("boolean"))


def damaged(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) with `copies`, after the damage that crc32 of conv_id:turn chooses: of twenty
    remainders one drops a row (no copies), one empties its text, one takes its .!? away, one repeats it, one makes it
    the user's. Nulls in the key, in role and in text count as one space."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn"))) % 20
    text, role = name("text"), name("role")
    gone = kind == 0
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.when(~gone, F.col("turn").cast("long")).alias("turn"),
        F.when(gone, "").when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(gone | (kind == 1), "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(gone, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def _doubled(rows: DataFrame) -> DataFrame:
    """rows with a row for each copy, without `again`: short conversations find their repeats by looking back."""
    return rows.withColumn("copies", F.explode(F.when(F.col("copies") < 2, F.array("copies")).otherwise(F.array_repeat(F.lit(1).cast("long"), F.col("copies").cast("int")))))


def _in_order(rows: DataFrame, *first: str) -> DataFrame:
    return rows.sortWithinPartitions(*first, F.col("turn").asc_nulls_first(), "role", "text")


def _long(rows: DataFrame) -> DataFrame:
    """RESULT of long conversations, piece by piece.

    Equal rows are counted, not listed. The digest of a conversation is of all its turns in order, so they pass through
    one task at the end, as a stream of pieces.
    """
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    same = lambda a, b: a["conv_id"].eqNullSafe(b["_c"]) & (a["role"] == b["_r"]) & (a["_digest"] == b["_d"])
    rows = rows.withColumn("_digest", F.sha2("text", 256))
    here = F.struct(F.col("turn").isNotNull().alias("dated"), "turn")
    first = rows.where("copies > 0").groupBy(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("_digest").alias("_d")).agg(
        F.min(here).alias("_first")
    )
    told = faults(rows.join(first, same(rows, first), "left")).withColumn("again", F.coalesce(~here.eqNullSafe(F.col("_first")), F.lit(False)))
    names = [f.split(" ")[0] for f in ROWS.split(", ")]
    placed = _in_order(told.select(*names).repartitionByRange("conv_id", F.col("turn").asc_nulls_first(), "role", "text"), "conv_id")
    pieces = cut(placed.select("conv_id", F.spark_partition_id().alias("piece"), *names[1:]))

    seen_schema = (
        "conv_id long, piece int, blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, "
        "turns long, costs array<double>"
    )

    def costs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for (name, piece), found in conversations(batches, 2):
                ends = (tuple(0 if s == e else math.inf for s in STATES) for e in STATES)
                yield (name, piece, *counts(found), [x for end in ends for x in to_go(found, end)[0]])

        yield from _streamed(each(), seen_schema)

    ends_schema = "conv_id long, piece int, end array<double>"
    whole_schema = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, last_piece int"

    def chained(table: pa.Table) -> tuple[list[tuple], tuple]:
        """(conv_id, piece, what its end costs) of a conversation's pieces; its counts and cost."""
        found = sorted(table.to_pylist(), key=lambda r: r["piece"])
        total, end, out = Counts(), END, []
        for r in found:
            total = total.then(Counts(*(r[c] for c in Counts._fields)))
        for r in reversed(found):
            out.append((r["conv_id"], r["piece"], list(map(float, end))))
            end = tuple(min(r["costs"][4 * e + s] + inserted(end)[e] for e in STATES) for s in STATES)
        return out, (found[0]["conv_id"], *_told(None, total, end[START], "", "")[1:7], found[-1]["piece"])

    def ends_of(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_table(chained(table)[0], ends_schema)])

    def whole_of(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_table([chained(table)[1]], whole_schema)])

    seen = cut(pieces.select("*").mapInArrow(costs_of, seen_schema))
    ends, whole = seen.groupBy("conv_id").applyInArrow(ends_of, ends_schema), cut(seen.groupBy("conv_id").applyInArrow(whole_of, whole_schema))
    final = whole.select(F.col("conv_id").alias("_c"), F.col("last_piece").alias("_p"))
    ends = cut(ends.join(final, F.col("conv_id").eqNullSafe(F.col("_c"))).select("conv_id", "piece", "end", (F.col("piece") == F.col("_p")).alias("is_last")))

    def with_key(rows: DataFrame, facts: DataFrame) -> DataFrame:
        """rows with a piece's facts; there are no more of these than partitions, so they are broadcast."""
        other = F.broadcast(facts.withColumnsRenamed({"conv_id": "_c", "piece": "_p"}))
        return rows.join(other, rows["conv_id"].eqNullSafe(F.col("_c")) & (rows["piece"] == F.col("_p"))).drop("_c", "_p")

    def walked(facts: DataFrame, schema: str, result) -> DataFrame:
        """A pass over the pieces with their facts in front of each row."""
        extra = [c for c in facts.columns if c not in ("conv_id", "piece")]
        lines = with_key(pieces, facts).select("conv_id", "piece", *extra, *names[1:])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            plain = (pa.RecordBatch.from_arrays([_hashable(c) for c in b.columns], names=b.schema.names) for b in batches)
            yield from _streamed((result(name, found) for name, found in conversations(plain, 2 + len(extra))), schema)

        return lines.mapInArrow(run, schema)

    ways_schema = "conv_id long, piece int, ways array<int>"

    def ways(name: tuple, found: list[Row]) -> tuple:
        """Where a walk through the piece ends, from each state."""
        end, last = _costs(name[2]), name[3]
        costs = to_go(found, end)
        return (name[0], name[1], [walk(found, costs, s, last)[2] if costs[0][s] < math.inf else s for s in STATES])

    starts_schema = "conv_id long, piece int, start int"

    def starts_of(table: pa.Table) -> pa.Table:
        out, state = [], START
        for r in sorted(table.to_pylist(), key=lambda r: r["piece"]):
            out.append((r["conv_id"], r["piece"], state))
            state = r["ways"][state]
        return pa.Table.from_batches([_table(out, starts_schema)])

    starts = walked(ends, ways_schema, ways).groupBy("conv_id").applyInArrow(starts_of, starts_schema)
    both = cut(with_key(ends, starts).select("conv_id", "piece", "end", "is_last", "start"))
    parts_schema = "conv_id long, piece int, n long, audit string, turns string"

    def part(name: tuple, found: list[Row]) -> tuple:
        audit, turns, _ = walk(found, to_go(found, _costs(name[2])), name[4], name[3])
        return (name[0], name[1], len(turns), audit, "\n".join(turns))

    parts = cut(walked(both, parts_schema, part))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces in order to (conv_id, audit, digest); of the turns just the digest's state is held."""

        def each() -> Iterator[tuple]:
            now = None
            for b in batches:
                for name, n, audit, turns in zip(*(b.column(c).to_pylist() for c in ("conv_id", "n", "audit", "turns")), strict=True):
                    if now is None or now[0] != name:
                        if now is not None:
                            yield now[0], "".join(now[1]), now[2].hexdigest()
                        now = [name, [], hashlib.sha256(), False]
                    now[1].append(audit)
                    if n:
                        now[2].update((("\n" if now[3] else "") + turns).encode())
                        now[3] = True
            if now is not None:
                yield now[0], "".join(now[1]), now[2].hexdigest()

        yield from _streamed(each(), "conv_id long, audit string, repaired_sha256 string")

    texts = parts.repartition("conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(joined, "conv_id long, audit string, repaired_sha256 string")
    told = texts.withColumnRenamed("conv_id", "_c")
    out = whole.join(told, whole["conv_id"].eqNullSafe(told["_c"]))
    return out.select(*(f.split(" ")[0] for f in RESULT.split(", ")))


def _hashable(column: pa.Array) -> pa.Array:
    """A list column as text: it is part of the key that tells conversations apart."""
    return pa.array([None if x is None else ",".join(map(str, x)) for x in column.to_pylist()], pa.string()) if pa.types.is_list(column.type) else column


def _costs(text: str) -> tuple[float, ...]:
    return tuple(map(float, text.split(",")))


def repair(rows: DataFrame, longest: int | None = None) -> DataFrame:
    """RESULT of rows (conv_id, turn, role, text, copies); rows without copies stand for conversations only.

    The rows of a conversation stand by turn, nulls first; equal turns by role and text. Of the faults of a row the first
    counts: blank (white space alone), duplicate (role and text seen earlier), truncated (doesn't end in .!?). A null
    conv_id is one conversation. A conversation without rows has zeros, an empty audit and the digest of ''.
    """
    names = [f.split(" ")[0] for f in ROWS.split(", ")]
    sizes = rows.groupBy("conv_id").agg(F.sum("copies").alias("n")).where(F.col("n") > (LONG if longest is None else longest))
    many = cut(sizes.select(F.col("conv_id").alias("_c")))
    here: Column = F.col("conv_id").eqNullSafe(F.col("_c"))
    some = not many.isEmpty()
    short = rows.join(many, here, "left_anti") if some else rows
    placed = _in_order(_doubled(faults(short)).select(*names).repartition("conv_id"), "conv_id")
    out = arrow_pass(placed, _whole, RESULT)
    return out.union(_long(rows.join(many, here, "left_semi"))) if some else out


def repaired(conversations: DataFrame) -> DataFrame:
    """repair() of conversations (conv_id, turn, role, text) after damage(): one row for every conv_id that they hold.

    Rows that are repeated in the table are repeated in the conversation; extra columns are left out; an empty table
    gives an empty one.
    """
    return repair(damaged(conversations))
