from __future__ import annotations

import random

import numpy as np
import pytest

from tallyweave.llm import decontam as D
from tests.llm.helpers import no_documents, odd_documents

ITEMS = "item_id long, text string"


def plain_score(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    best = 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (D.MATCH if a[i - 1] == b[j - 1] else D.MISMATCH), h[i - 1][j] + D.GAP, h[i][j - 1] + D.GAP)
            best = max(best, h[i][j])
    return best


def test_alignment_equals_the_plain_recurrence():
    r = random.Random(1)
    for _ in range(300):
        a, b = r.choices(range(1, 5), k=r.randint(1, 12)), r.choices(range(5), k=r.randint(0, 20))
        score, first, end = D.align(np.array(a), np.array(b))
        assert score == plain_score(a, b) and (not score or plain_score(a, b[first:end]) == score)


@pytest.fixture(scope="module")
def planted(spark):
    r = random.Random(2)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(k, " ".join(r.choices(vocabulary, k=r.randint(12, 40)))) for k in range(30)]
    docs, truth = [], set()
    for i in range(300):
        words = r.choices(vocabulary, k=r.randint(10, 120))
        if i % 3 == 0:
            k = r.randrange(30)
            copy = items[k][1].split()
            if i % 2:
                copy = [r.choice(vocabulary) if r.random() < 0.1 else w for w in copy if r.random() > 0.05]
            at = r.randrange(len(words))
            words[at:at] = copy
            truth.add((i, k))
        docs.append((i, " ".join(words).upper() if i % 5 == 0 else ", ".join(words)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEMS), truth, docs, items


def test_equals_aligning_everything(planted):
    docs, bench, truth, texts, items = planted
    rows = D.leaks(docs, bench).collect()
    found = {(r["doc_id"], r["item_id"]): r["score"] for r in rows}
    expected = {}
    for i, t in texts:
        for k, b in items:
            x, y = D.words(b), D.words(t)
            ids: dict[str, int] = {}
            s = D.align(
                np.array([ids.setdefault(w, len(ids)) for w in x]), np.array([ids.setdefault(w, len(ids)) for w in y]),
            )[0] / (D.MATCH * len(x))
            if s >= D.MIN_SCORE:
                expected[i, k] = s
    # a copy so edited that no run of three words is left has no seed; all others are found, with the full score
    assert found == {k: v for k, v in expected.items() if k in found} and len(found) >= 0.98 * len(expected)
    assert len(truth & set(found)) >= 0.98 * len(truth)
    for r in rows:
        words = D.words(dict(texts)[r["doc_id"]])
        assert 0 <= r["first_word"] < r["end_word"] <= len(words)


def test_blocks_give_the_same_rows(planted):
    docs, bench, _, _, _ = planted
    rows = lambda **k: sorted(
        map(tuple, D.leaks(docs, bench, **k).select("doc_id", "item_id", "first_word", "end_word").collect())
    )
    assert rows(block_words=60) == rows()


def test_an_item_that_has_leaked_everywhere_is_found(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = spark.createDataFrame([(i, f"some words {item} more words {i}") for i in range(50)], "doc_id long, text string")
    assert D.leaks(docs, spark.createDataFrame([(1, item)], ITEMS)).count() == 50


def test_odd_and_empty_tables(spark):
    bench = spark.createDataFrame(
        [
            (1, "hello world this is a line of text"), (2, None), (3, ""), (4, "of text"), (None, "x y z"),
            (1, "hello world this is a line of text"),
        ],
        ITEMS,
    )
    docs = odd_documents(spark)
    assert {r["doc_id"] for r in D.leaks(docs, bench).collect()} == {1, 6, None}
    clean = D.keep_clean(docs, bench)
    assert clean.columns == docs.columns and sorted(r["doc_id"] for r in clean.collect()) == [2, 3, 4, 4, 5, 7, 8]
    assert D.leaks(no_documents(spark), bench).count() == 0 and D.leaks(docs, bench.limit(0)).count() == 0


def test_items_without_an_n_gram_leak_as_whole_texts(spark):
    docs = spark.createDataFrame([(1, "Yes, sir!"), (2, "yes"), (3, "yes sir and so on"), (4, None), (5, ""), (1, "yes sir")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "yes sir"), (8, "Yes"), (9, ""), (10, None), (11, "yes sir"), (12, "yes sir and so on")], "item_id long, text string")
    found = sorted((x["doc_id"], x["item_id"], x["score"], x["end_word"]) for x in D.leaks(docs, items).collect())
    assert found == sorted([*[(1, i, 1.0, 2) for i in (7, 7, 11, 11)], (2, 8, 1.0, 1), (3, 12, 1.0, 5)])
