from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter

import pytest

from tallyweave.llm import rendezvous as R
from tests.llm.helpers import no_documents, odd_documents


def plain_shard(key: str, weights: list[float]) -> int:
    def score(s: int) -> float:
        n = int(hashlib.md5(f"{key}:{s}".encode()).hexdigest()[:13], 16)
        return -weights[s] / math.log((n + 0.5) / 2**52)

    return max(range(len(weights)), key=lambda s: (score(s), -s))


def test_equals_brute_force_and_moves_only_into_the_new_shard(spark):
    docs = spark.createDataFrame([(i, f"text é {i % 7}") for i in range(3000)], "doc_id long, text string")
    rows = R.shard(docs, pieces=8).collect()
    assert len(rows) == 3000
    for r in rows:
        text = f"text é {r['doc_id'] % 7}".encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(text) + 1, zlib.crc32(text), "key")
        assert r["shard"] == plain_shard(str(r["doc_id"]), [1.0] * 16)
        assert r["grown_shard"] in (r["shard"], 16)
    by: dict[int, list[int]] = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert set(by) == set(range(16)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) < 1.4 * min(map(len, by.values()))


def test_weights_and_bad_weights(spark):
    docs = spark.createDataFrame([(i, "") for i in range(4000)], "doc_id long, text string")
    n = Counter(r["shard"] for r in R.shard(docs, weights=(3.0, 1.0)).collect())
    assert 2.6 < n[0] / n[1] < 3.5
    with pytest.raises(ValueError):
        R.shard(docs, weights=(1.0, 0.0))


def test_odd_and_empty_tables(spark):
    rows = R.shard(odd_documents(spark)).collect()
    assert len(rows) == 10 and all(r["size"] == 1 for r in rows if r["doc_id"] in (2, 3))
    assert R.shard(no_documents(spark)).count() == 0


def test_plan_has_no_python(spark):
    plan = R.shard(odd_documents(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
