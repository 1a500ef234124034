from __future__ import annotations

import random

import pytest

from tallyweave.llm import tokencounts as T
from tallyweave.llm.common import shared_path
from tests.llm.helpers import no_documents, odd_documents

CHANGES = "op string, seq long, doc_id long, source string, lang string, tokenizer string, n_tokens long"


def rollup(spark):
    return T.Rollup(spark, shared_path(spark, "rollup"))


def totals(r):
    return {(x["source"], x["lang"], x["tokenizer"]): (x["n_docs"], x["n_tokens"]) for x in r.totals().collect()}


def test_batches_equal_a_plain_model(spark):
    rng, r, state = random.Random(2), rollup(spark), {}
    for batch in range(3):
        rows, model = [], {}
        for seq in range(60):
            row = (
                rng.choice(["upsert", "upsert", "delete"]), seq, rng.randint(1, 15), rng.choice(["a", "b", None]),
                rng.choice(["en", "de"]), rng.choice(["t1", "t2"]), rng.randint(0, 50),
            )
            rows.append(row)
            model[row[2], row[5]] = row
        for key, row in model.items():
            if row[0] == "delete":
                state.pop(key, None)
            else:
                state[key] = row
        assert r.commit(f"b{batch}", spark.createDataFrame(rows, CHANGES))
        assert not r.commit(f"b{batch}", spark.createDataFrame(rows, CHANGES))
        expected = {}
        for row in state.values():
            n, t = expected.get(row[3:6], (0, 0))
            expected[row[3:6]] = (n + 1, t + row[6])
        assert totals(r) == expected
    assert {(x["doc_id"], x["tokenizer"], x["n_tokens"]) for x in r.current().collect()} == {(k[0], k[1], v[6]) for k, v in state.items()}


def test_a_batch_that_failed_halfway_counts_for_nothing_and_can_be_repeated(spark):
    r = rollup(spark)
    rows = spark.createDataFrame([("upsert", 0, 1, "a", "en", "t", 5)], CHANGES)
    r.commit("one", rows)
    rows.selectExpr(
        "doc_id", "source", "lang", "tokenizer", "1L as n_docs", "99L as n_tokens",
    ).write.parquet(f"{r.path}/attempts/dead/ledger")
    assert totals(r) == {("a", "en", "t"): (1, 5)}
    assert r.commit("two", spark.createDataFrame([("upsert", 0, 1, "a", "de", "t", 7)], CHANGES))
    assert totals(r) == {("a", "de", "t"): (1, 7)}
    with pytest.raises(ValueError):
        r.commit("../x", rows)


def test_two_writers_at_a_time(spark, monkeypatch):
    """Each writer's first attempt is overtaken by another commit between reading and publishing."""
    r = rollup(spark)
    one = lambda n: spark.createDataFrame([("upsert", 0, 1, "a", "en", "t", n)], CHANGES)
    r.commit("first", one(5))
    publish, other = T.Rollup._publish, [("other", 7), ("same", 9)]

    def slow(self, number, entry):
        if entry["batch"] == "mine" and other:
            batch, n = other.pop(0)
            assert T.Rollup(spark, r.path).commit(batch, one(n))
        return publish(self, number, entry)

    monkeypatch.setattr(T.Rollup, "_publish", slow)
    assert r.commit("mine", one(11)) and r.committed() == ["first", "other", "same", "mine"]
    assert totals(r) == {("a", "en", "t"): (1, 11)}
    # the very batch that another writer commits meanwhile counts once
    other[:] = [("mine2", 3)]
    monkeypatch.setattr(
        T.Rollup, "_publish", lambda self, number, entry: publish(self, number, entry) if entry["batch"] != "late" else False,
    )
    monkeypatch.setattr(T, "MOST_TRIES", 2)
    with pytest.raises(RuntimeError):
        r.commit("late", one(1))
    assert totals(r) == {("a", "en", "t"): (1, 11)}


def test_the_same_batch_from_two_writers_counts_once(spark, monkeypatch):
    r = rollup(spark)
    rows = spark.createDataFrame([("upsert", 0, 1, "a", "en", "t", 5)], CHANGES)
    publish, first = T.Rollup._publish, [True]

    def slow(self, number, entry):
        if first:
            first.clear()
            assert T.Rollup(spark, r.path).commit("b", rows)
        return publish(self, number, entry)

    monkeypatch.setattr(T.Rollup, "_publish", slow)
    assert not r.commit("b", rows)
    assert totals(r) == {("a", "en", "t"): (1, 5)} and r.committed() == ["b"]


def test_snapshots_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(T, "SNAPSHOT_EVERY", 2)
    r = rollup(spark)
    for n in range(5):
        r.commit(
            f"b{n}",
            spark.createDataFrame(
                [("upsert", 0, n % 2, "a", "en", "t", n), ("delete" if n == 3 else "upsert", 0, 9, "b", "en", "t", 1)], CHANGES,
            ),
        )
    assert totals(r) == {("a", "en", "t"): (2, 7), ("b", "en", "t"): (1, 1)}
    assert {(x["doc_id"], x["n_tokens"]) for x in r.current().collect()} == {(0, 4), (1, 3), (9, 1)}
    assert len(r.log()) > len(r.committed()) == 5 and r.log()[-1]["start"] > 1


def test_odd_and_empty_tables(spark):
    from pyspark.sql import functions as F

    r, text = rollup(spark), F.col("text")
    assert totals(r) == {}
    r.commit("none", T.counts(no_documents(spark), {"words": T.words(text)}))
    r.commit("odd", T.counts(odd_documents(spark), {"words": T.words(text), "bytes": T.octets(text), "clean": T.clean_words(text)}))
    assert totals(r)["a", "en", "words"] == (3, 8 + 8 + 9 * 5000)  # a null id goes; rows of one id count once
    assert totals(r)["c", "fr", "words"] == (1, 5) and totals(r)["c", "fr", "clean"] == (1, 2)
    assert totals(r)[None, "en", "bytes"] == (1, 0)
