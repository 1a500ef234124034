from __future__ import annotations

import random

import numpy as np
import pytest

import corpus_pipeline
from tallyweave.llm import nearcopies
from tests.llm.helpers import DOCUMENTS, no_documents, odd_documents


def plain_set(text: str) -> set[str]:
    words = text.lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_kept(texts: list[str]) -> set[int]:
    sets, root = [plain_set(t) for t in texts], list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((root[a], root[b]))
                root = [x if r == y else r for r in root]
    return set(root)


def planted() -> list[str]:
    """Texts with copies of which 1 to 15 % of the words are edited, in a stretch or one by one, and chains of copies."""
    r = random.Random(12)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(r.choices(words, k=r.choice([8, 40, 100, 300, 1500]))) for _ in range(50)]
    for t in list(texts):
        for share in (0.01, 0.02, 0.05, 0.08, 0.1, 0.15):
            w = t.split()
            n = max(1, round(share * len(w)))
            at = r.randrange(len(w) - n + 1)
            for k in range(at, at + n) if r.random() < 0.6 else r.sample(range(len(w)), n):
                w[k] = r.choice(words)
            texts.append(" ".join(w))
            if r.random() < 0.3:
                texts[-1] += " " + " ".join(r.choices(words, k=n))
    r.shuffle(texts)
    return texts


def test_stage_keeps_what_all_pairs_keep(spark):
    texts = planted()
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], DOCUMENTS)
    kept = {x["doc_id"] for x in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert kept == plain_kept(texts)
    assert 60 < len(texts) - len(kept) < len(texts) - 60


def test_dense_cells_lose_no_group(spark):
    """Copies of copies: ends of a chain share cells but are no near copies of each other."""
    r = random.Random(3)
    texts = []
    for _ in range(3):
        w = [f"v{r.randrange(300)}" for _ in range(120)]
        for _ in range(40):
            at = r.randrange(110)
            w[at : at + 4] = [f"v{r.randrange(300)}" for _ in range(4)]
            texts.append(" ".join(w))
    r.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {x["doc_id"] for x in nearcopies.keep_first(docs).collect()} == plain_kept(texts)


def test_odd_and_empty_tables(spark):
    kept = nearcopies.keep_first(odd_documents(spark)).collect()
    assert sorted(x["doc_id"] for x in kept) == [1, 2, 4, 4, 7, 8]
    assert nearcopies.keep_first(no_documents(spark)).count() == 0


def test_joining_links_what_the_plain_rule_links():
    r = random.Random(4)
    for _ in range(20):
        base = r.sample(range(10_000), 60)
        sets = [np.unique(np.array([x if r.random() > 0.06 else r.randrange(10_000) for x in base], np.int64)) for _ in range(25)] + [np.zeros(0, np.int64)]
        labels, blocks = [r.randrange(12) for _ in sets], [r.randrange(2) for _ in sets]
        for across in (False, True):
            found = nearcopies.joining(list(range(26)), labels, blocks, sets, across)
            root = {x: x for x in labels}
            for i in range(26):
                for j in range(i):
                    if (not across or blocks[i] != blocks[j]) and len(sets[i]) and len(sets[j]) and nearcopies.near(sets[i], sets[j]):
                        x, y = sorted((root[labels[i]], root[labels[j]]))
                        root = {k: x if v == y else v for k, v in root.items()}
            got = {x: x for x in labels}
            for i, j in found:
                assert labels[i] != labels[j] and nearcopies.near(sets[i], sets[j]) and (not across or blocks[i] != blocks[j])
                x, y = sorted((got[labels[i]], got[labels[j]]))
                got = {k: x if v == y else v for k, v in got.items()}
            assert got == root


@pytest.mark.parametrize("unit", [0, 30, 100_000])
def test_blocks_lose_no_group(spark, monkeypatch, unit):
    """Whether rows are compared as units or cell by cell, and in blocks of few rows or few shingles."""
    monkeypatch.setattr(nearcopies, "UNIT", unit)
    monkeypatch.setattr(nearcopies, "BLOCK", 5)
    monkeypatch.setattr(nearcopies, "BLOCK_SHINGLES", 2000)
    monkeypatch.setattr(nearcopies, "MATRIX", 64)
    texts = planted()[:150]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {x["doc_id"] for x in nearcopies.keep_first(docs).collect()} == plain_kept(texts)


def test_rows_without_ids_meet_no_more_often_than_others(spark):
    """Contents of classes that have no id at all come from one pass over the rows without ids."""
    texts = planted()[:60]
    docs = spark.createDataFrame([(None, t) for t in texts] * 3, "doc_id long, text string")
    found = nearcopies.groups(docs).collect()
    assert len(found) == 180 and all(x["component_id"] is None for x in found)
    some = spark.createDataFrame([(None, t) for t in texts] + [(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    kept = {x["doc_id"] for x in nearcopies.keep_first(some).collect()}
    assert kept == plain_kept(texts)
