from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from tallyweave.llm import linededup as L
from tests.llm.helpers import no_documents, odd_documents


def kept_lines(docs: list[tuple[int, str | None]]) -> list[tuple[int, int, list[str]]]:
    """(id, number of lines, lines that no smaller id holds) of each document."""
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    owners: dict[str, set[int]] = {}
    for i, t in docs:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                owners.setdefault(key(x), set()).add(i)
    split = [(i, (t or "").split("\n")) for i, t in docs]
    return [(i, len(lines), [x for x in lines if min(owners.get(key(x), {i})) >= i]) for i, lines in split]


def plain_lines(docs: list[tuple[int, str | None]]) -> list[tuple[int, str]]:
    return [(i, "\n".join(kept)) for i, _, kept in kept_lines(docs)]


def plain(docs: list[tuple[int, str | None]]) -> dict[int, tuple[int, int, str]]:
    return {i: (n, n - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()) for i, n, kept in kept_lines(docs)}


@pytest.mark.parametrize("sizes", [{}, {"shard_keys": 16, "block_keys": 32}])
def test_equals_brute_force(spark, sizes):
    r = random.Random(3)
    pool = [f"Line number {i} of the pool" for i in range(120)] + ["short", "", "  exactly10 ", "EXACTLY10x", "\x0bexactly10X\r"]
    docs = [(i, "\n".join(r.choices(pool, k=r.randint(0, 30)))) for i in range(80)] + [(80, None), (81, "")]
    rows = L.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), **sizes).collect()
    assert {x["doc_id"]: (x["n_lines"], x["n_dropped"], x["kept_sha256"]) for x in rows} == plain(docs)


def test_minimal_perfect_hash_is_one():
    keys = np.random.default_rng(1).integers(0, 1 << 63, (5000, 2)).astype(np.uint64)
    keys[:100, 0] = keys[100:200, 0]  # pairs that share one of their hashes
    keys[200:300, 1] = keys[300:400, 1]
    sizes, bits, order = L.build_levels(keys)
    assert sorted(order) == list(range(len(keys))) and bits.sum() == len(keys) and sizes.sum() == len(bits)


def test_keys_that_share_a_hash_are_told_apart(spark):
    """Index and probes on the arrays themselves: one hash equal, the other not."""
    r = np.random.default_rng(2)
    both = r.integers(0, 1 << 63, (400, 2)).astype(np.uint64)
    both[:100, 0] = both[100:200, 0]
    rows = [(*map(int, k.view(np.int64)), n, 2) for n, k in enumerate(both)]
    index = L.build_index(spark.createDataFrame(rows, "hash long, print long, owner long, n_docs long"), 3)
    held = L.Index.join([x.asDict() for x in index.collect()], 3)
    found = held.probe(both)
    assert held.owners[found].tolist() == list(range(400))
    others = both.copy()
    others[:, 1] += np.uint64(1)
    assert (held.probe(others) == -1).all()


def test_a_hot_line_is_dealt_over_groups(spark, monkeypatch):
    monkeypatch.setattr(L, "GROUP_ROWS", 16)
    docs = [(i, f"this line is in all of them\nand this one in some {i % 7}") for i in range(200)]
    rows = L.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), shard_keys=4, block_keys=2).collect()
    assert {x["doc_id"]: (x["n_lines"], x["n_dropped"], x["kept_sha256"]) for x in rows} == plain(docs)


def test_odd_and_empty_tables(spark):
    rows = L.dedup_lines(odd_documents(spark)).collect()
    assert len(rows) == 10
    by = {r["doc_id"]: r for r in rows}
    assert by[2]["text"] == "" and by[2]["n_lines"] == 1 and by[6]["n_dropped"] == 1 and by[1]["n_dropped"] == 0 and by[None]["n_dropped"] == 1
    assert by[4]["n_dropped"] == 0  # two rows of one id are one document
    assert L.dedup_lines(no_documents(spark)).count() == 0
