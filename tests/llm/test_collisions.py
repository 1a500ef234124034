"""Collision counting against all cosines."""

from __future__ import annotations

import math

import numpy as np
import pytest

from tallyweave.llm import collisions as C
from tests.test_oracles import DIR

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows: list[tuple], k: int = 5) -> dict[int, list[tuple]]:
    fine = [
        (i, np.array(v, np.float32).astype(float)) for i, v in rows
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    ]
    out = {}
    for at, (q, v) in enumerate(fine):
        if q is not None and q % 50 == 0:
            others = [(i, w) for n, (i, w) in enumerate(fine) if n != at and len(w) == len(v)]
            found = sorted(((-float(v @ w) / math.sqrt(v @ v) / math.sqrt(w @ w), math.inf if i is None else i) for i, w in others))[:k]
            out[q] = [(None if i == math.inf else i, -s) for s, i in found]
    return out


def answers(df) -> dict[int, list[tuple]]:
    out: dict[int, list[tuple]] = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def recall(found: dict, expected: dict) -> float:
    """Of the expected rows; scores tell ties apart from misses."""
    hits = total = 0
    for q, rows in expected.items():
        got = [s for _, s in found.get(q, [])]
        total += len(rows)
        hits += sum(bool(got) and s >= min(got) - 1e-9 for _, s in rows) if len(got) == len(rows) else 0
        for i, s in found.get(q, []):
            true = dict(rows).get(i)
            assert true is None or abs(true - s) < 1e-9
    return hits / total


def test_recall_on_the_given_tables(spark):
    for table in (DIR, DIR.replace("0.001", "0.1")):
        df = spark.read.parquet(f"{table}/embeddings.parquet")
        expected = brute([(r["vec_id"], r["embedding"]) for r in df.collect()])
        found = answers(C.neighbours(df))
        same = sum(len({i for i, _ in found[q]} & {i for i, _ in rows}) for q, rows in expected.items())
        assert same >= 0.95 * sum(map(len, expected.values())) and recall(found, expected) > 0.9


@pytest.mark.parametrize("dim", [3, 24])
def test_recall_over_many_blocks_with_copies_and_clusters(spark, monkeypatch, dim):
    monkeypatch.setattr(C, "BLOCK", 150)
    monkeypatch.setattr(C, "QUERIES", 10)
    monkeypatch.setattr(C, "SAMPLE", 100)
    r = np.random.default_rng(dim)
    centres = r.standard_normal((6, dim))
    vectors = [centres[k % 6] + 0.2 * r.standard_normal(dim) for k in range(1200)]
    vectors[300:700] = [vectors[50]] * 400  # a query's vector has very many copies
    rows = [(k, [float(np.float32(x)) for x in v]) for k, v in enumerate(vectors)]
    df = spark.createDataFrame([(*x, 0) for x in rows], SCHEMA)
    expected, found = brute(rows), answers(C.neighbours(df))
    assert recall(found, expected) > 0.95
    copies = [50, *range(300, 700)]
    assert [i for i, _ in found[50]] == copies[1:6] and [i for i, _ in found[350]] == copies[:5]
    assert all(math.isclose(s, 1, abs_tol=1e-12) for _, s in found[400])


def test_the_count_decides_which_vectors_are_verified(spark):
    r = np.random.default_rng(1)
    vectors = r.standard_normal((3000, 128))
    vectors[1:7] = vectors[0] + 0.05 * r.standard_normal((6, 128))
    verified = []
    keep = C.cosines
    block = C.Block(vectors)
    C.cosines = lambda v, q: verified.append(len(v)) or keep(v, q)
    try:
        (_, found, _), = block.search(vectors[:1], np.array([0.2]), np.array([0]), np.arange(3000), 5)
    finally:
        C.cosines = keep
    assert set(found) <= set(range(1, 7)) and len(found) == 5 and sum(verified) < 60


def test_threshold_is_the_binomial_tail():
    p = math.erf(1 / math.sqrt(2))
    for m in (1, 10, 64):
        tail = lambda t: sum(math.comb(m, c) * p**c * (1 - p) ** (m - c) for c in range(t, m + 1))  # noqa: B023, E731
        t = C.threshold(m, 0.9)
        assert t == 1 or tail(t) >= 0.9 > tail(t + 1)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (50, [0.0, 1.0]), (1, [1.0, 1.0]), (2, [-1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [1.0, inf]),
        (7, [None, 1.0]), (8, []), (None, [1.0, 0.0]), (100, [1.0, 2.0, 3.0]), (9, [3e38, 3e38]), (10, [1e-40, 0.0]), (150, None), (200, [0.0, 0.0]),
        (250, [1.0] * 7),
    ]
    df = spark.createDataFrame([(*x, 0) for x in rows], SCHEMA).selectExpr("*", "1 as _row", "2 as dim", "0 as block", "1.0 as score", "7L as query_id")
    found = answers(C.neighbours(df))
    assert found.keys() == {0, 50} == {q for q, v in brute(rows).items() if v}
    for q, some in brute(rows).items():
        assert [i for i, _ in found.get(q, [])] == [i for i, _ in some]
        assert np.allclose([s for _, s in found.get(q, [])], [s for _, s in some], rtol=0, atol=1e-12)
    assert C.neighbours(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(0, [1.0, 0.0], 0), (0, [1.0, 0.0], 0), (1, [0.0, 1.0], 0)], SCHEMA)
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in C.neighbours(twice).collect()) == [(0, 1, 0), (0, 1, 0), (0, 2, 1), (0, 2, 1)]
