from __future__ import annotations

import itertools
import random
import zlib

import numpy as np
import pytest

from tallyweave.llm import toxicity as T
from tests.llm.helpers import no_documents, odd_documents

BAD = ["grumbok", "snarfle", "blivetty"]
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(6)
    words = ["".join(r.choices(["ta", "re", "lo", "mi", "ne", "su", "ka"], k=r.randint(1, 3))) for _ in range(300)]
    docs, labels = [], []
    for i in range(700):
        text, toxic = r.choices(words, k=r.randint(5, 80)), int(r.random() < 0.25)
        if toxic:
            for w in r.choices(BAD, k=2):
                w = r.choice(
                    [w, w.upper() + "!!", w.replace("o", "0").replace("e", "3"), w.replace("a", "@"), " ".join(w), w.replace("u", "uuuu")]
                )
                text.insert(r.randrange(len(text)), w)
        docs.append((i, " ".join(text)))
        labels.append((i, 1, toxic))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, LABELS)


def test_held_out_documents_with_disguised_words(corpus):
    docs, labels = corpus
    rows = T.toxicity(docs, labels).join(labels, "doc_id").collect()
    assert len(rows) == 700
    for r in rows:
        assert r["held_out"] == (
            zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1
        ) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
    held = [r for r in rows if r["held_out"]]
    toxic = [r["predicted"] for r in held if r["toxic"]]
    assert sum(toxic) / len(toxic) > 0.9 and not any(r["predicted"] for r in held if not r["toxic"])


def test_copies_of_one_toxic_document_do_not_make_its_words_toxic(spark, corpus):
    docs, labels = corpus
    copies = spark.createDataFrame([(1000 + i, "zorply quintex " + BAD[0]) for i in range(200)], "doc_id long, text string")
    more = spark.createDataFrame([(1000 + i, 1, 1) for i in range(200)], LABELS)
    lm = T.log_probabilities(T.trigram_counts(docs))
    sample, _ = T._sample(docs.union(copies), labels.union(more), "text", "doc_id", 8000)
    weights = T.feature_weights(sample, lm)
    assert "grumbok$" in weights and "zorply$" not in weights and "quintex$" not in weights


def test_decoding_equals_brute_force_over_the_lattice(corpus):
    lm = T.log_probabilities(T.trigram_counts(corpus[0]))

    def plain(token):
        runs = ["".join(g) for _, g in itertools.groupby(token)]
        options = [T._readings(x, k == 0, k == len(runs) - 1, {}) for k, x in enumerate(runs)]
        best = None
        for path in itertools.product(*options):
            a = b = 0
            s = sum(c for _, c in path)
            for ch in "".join(e for e, _ in path):
                code = 0 if ch == " " else T.CODE.get(ch, T.OTHER)
                s += lm[a, b, code] + (T.GAIN if code else 0)
                a, b = b, code
            s += lm[a, b, 0]
            if best is None or s > best[0] + 1e-9:
                best = (s, "".join(e for e, _ in path))
        return best[1]

    for token in ("gr0mb0k", "$n@rfl3", "bl1vettyyy", "t4+3", "a1b", "s n a", "!x!"):
        assert T.decode(token, lm) == plain(token)
    assert T.restore_token("plain,", lm) == ["plain"] and T.restore_token("123", lm) == [] and T.restore_token("a-b", lm) == ["a", "b"]


def test_logistic_never_falls_with_more_weight():
    r = np.random.default_rng(0)
    x = np.abs(r.normal(size=(200, 3)))
    w = T.fit_logistic(x, (x[:, 0] - x[:, 1] > 0).astype(float), np.ones(200))
    assert (w[:-1] >= 0).all() and w[0] > 0


def test_odd_and_empty_tables(spark, corpus):
    labels = spark.createDataFrame([(1, 1, 0), (6, 1, 1), (99, 1, 1), (None, 1, 1), (2, None, None)], LABELS)
    rows = T.toxicity(odd_documents(spark), labels).collect()
    assert len(rows) == 10 and all(r["score"] is not None for r in rows)
    assert T.toxicity(no_documents(spark), labels).count() == 0
    assert {r["predicted"] for r in T.toxicity(odd_documents(spark), labels.limit(0)).collect()} == {0}
    model = T.train(*corpus)
    out = {r["doc_id"]: r for r in T.score(odd_documents(spark), model, restored=True).collect()}
    assert out[2]["restored_text"] == "" and out[1]["restored_text"].startswith("hello world")


def test_disguises_reach_the_language_model():
    text = " ".join(
        [
            "you stupid idiot", "the idiot was stupid", "what an asshole", "they die", "a well known plan and good book",
            "tell all of them",
        ] * 50
    )
    x = np.append(0, T.encode(text).astype(np.int64))
    n = np.bincount(x[:-2] * T.CLASSES**2 + x[1:-1] * T.CLASSES + x[2:], minlength=T.CLASSES**3)
    restorer = T.Restorer(T.log_probabilities(n.reshape((T.CLASSES,) * 3)))
    for disguised, plain in [
        ("id-iot", "idiot"), ("st.up.id", "stupid"), ("stu_pid", "stupid"), ("i d ! o t", "idiot"), ("a $ $ h o l e", "asshole"), ("d i e", "die"),
        ("i   d   i   o   t", "idiot"), ("i\nd\ni\no\nt", "idiot"), ("well-known", "well known"), ("good book", "good book"), ("tell all", "tell all"),
    ]:
        assert restorer.text(disguised) == plain and set(plain.split()) <= restorer.words(disguised), disguised
