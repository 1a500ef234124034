"""Turn repair against a search through all edits, and in pieces against the whole."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import pytest

from tallyweave.llm import turns as T

WHITE = " \t\n\x0b\x0c\r"


def plain_damage(rows: list[tuple]) -> dict[int | None, list[tuple]]:
    out: dict = {}
    for conv, turn, role, text in rows:
        show = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        here = out.setdefault(conv, [])
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        here += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode())) for c, r in out.items()}


def plain_repair(rows: list[tuple]) -> tuple:
    """Counts, and the least (cost, audit) by a search that knows no cost to go."""
    faults, seen = [], set()
    for _, role, text in rows:
        bare = text.strip(WHITE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    legal = re.compile("(s?(ua)+)?")
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, tail, out = heapq.heappop(heap)
        roles = [o[0] for o in out]
        if i == len(rows) and legal.fullmatch("".join(roles)):
            break
        if (i, tail) in done:
            continue
        done.add((i, tail))
        # the last initial tells all that the grammar needs to know of what came before
        step = lambda c: {"": "su", "s": "u", "u": "a", "a": "u"}[tail].find(c) >= 0
        for r in ("user", "assistant"):
            if step(r[0]):
                heapq.heappush(heap, (cost + 5, audit + "I", i, r[0], (*out, r + ":")))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, tail, out))
            if faults[i] not in ("blank", "duplicate"):
                more = 5 if faults[i] else 0
                if role[:1] and step(role[0]):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[0], (*out, f"{role}:{text}")))
                for r in ("user", "assistant"):
                    if step(r[0]):
                        heapq.heappush(heap, (cost + more + 1, audit + "R", i + 1, r[0], (*out, f"{r}:{text}")))
    known = sorted({t for t, _, _ in rows if t is not None})
    initials = [role[:1] for _, role, _ in rows]
    return (
        known[-1] - known[0] + 1 - len(known) if known else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)), cost, audit,
        hashlib.sha256("\n".join(out).encode()).hexdigest(),
    )


def made(seed: int, n: int, conversations: int) -> list[tuple]:
    r = random.Random(seed)
    texts = ["Yes.", "No!", "So?", "cut off", "", " \t", None, "Same.", "one. two", "end.  \n", "a\x0b", "é…", "x" * 300 + "."]
    rows = []
    for k in range(n):
        conv = None if r.random() < 0.1 else r.randrange(conversations)
        role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "u2"])
        rows.append((conv, None if r.random() < 0.08 else r.randrange(12) if r.random() < 0.7 else k, role, r.choice(texts) if r.random() < 0.7 else f"t{k}."))
    return rows + rows[: n // 20]


def found(df) -> dict:
    rows = df.collect()
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r["conv_id"]: tuple(r)[1:] for r in rows}


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize(("seed", "n", "conversations"), [(1, 1500, 300), (2, 600, 400), (3, 150, 3)])
def test_against_a_search_through_all_edits(spark, seed, n, conversations):
    rows = made(seed, n, conversations)
    expected = {c: plain_repair(x) for c, x in plain_damage(rows).items()}
    assert found(T.repaired(spark.createDataFrame(rows, SCHEMA))) == expected


@pytest.mark.parametrize(("seed", "n", "conversations", "longest"), [(4, 400, 3, 0), (5, 300, 60, 4), (6, 500, 1, 50)])
def test_pieces_of_long_conversations_give_the_same(spark, seed, n, conversations, longest):
    rows = made(seed, n, conversations)
    df = spark.createDataFrame(rows, SCHEMA)
    expected = {c: plain_repair(x) for c, x in plain_damage(rows).items()}
    assert found(T.repair(T.damaged(df), longest)) == expected


def test_a_hot_conversation_is_cut_into_pieces(spark, monkeypatch):
    """No piece holds more than its share of a conversation that has nearly all rows."""
    sizes = []
    keep = T.cut

    def noted(df):
        out = keep(df)
        if "piece" in out.columns and "text" in out.columns:
            sizes.extend(r["count"] for r in out.groupBy("piece").count().collect())
        return out

    monkeypatch.setattr(T, "cut", noted)
    rows = [(7, k, "user" if k % 2 else "assistant", f"text {k}.") for k in range(4000)] + [(8, 0, "user", "Hi.")]
    df = spark.createDataFrame(rows, SCHEMA)
    conf = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(conf, "false")
    try:
        out = found(T.repair(T.damaged(df), 100))
    finally:
        spark.conf.unset(conf)
    assert out == {c: plain_repair(x) for c, x in plain_damage(rows).items()}
    assert len(sizes) >= 3 and max(sizes) < 2 * sum(sizes) / len(sizes)


def test_empty_tables_extra_columns_and_nulls(spark):
    assert T.repaired(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, None, None, None), (1, None, "user", None), (2, 3, "user", "x" * 200_000)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1L as copies", "'x' as fault", "true as again", "2L as cost", "0 as piece")
    assert found(T.repaired(df)) == {c: plain_repair(x) for c, x in plain_damage(rows).items()}
