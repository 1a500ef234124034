from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from tallyweave.llm import langid as L
from tests.llm.helpers import no_documents, odd_documents

SYLLABLES = {"en": "the ing er and th wh".split(), "de": "sch ung ein ich ä ß".split(), "fr": "eau oi é ç que aux".split()}


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(1)
    rows = []
    for i in range(600):
        y = r.choice(sorted(SYLLABLES))
        text = " ".join("".join(r.choices(SYLLABLES[y], k=r.randint(1, 3))) for _ in range(r.randint(3, 40)))
        rows.append((i, text.upper() if i % 9 == 0 else text, y if i % 11 else None, y))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, truth string")


def test_held_out_accuracy_and_scores(corpus):
    rows = L.predictions(corpus).join(corpus, "doc_id").collect()
    assert len(rows) == 600
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == r["truth"] for r in held) / len(held) > 0.97


def test_copies_of_one_text_predict_alike_and_ids_are_no_input(corpus):
    model = L.train(corpus)
    assert model.predict("the ing and") == model.predict("the ing and") and model.predict("the ing and")[0] == "en"
    moved = {r["doc_id"] - 1000: r["lang_pred"] for r in L.identify(corpus.selectExpr("doc_id + 1000 as doc_id", "text"), model).collect()}
    assert moved == {r["doc_id"]: r["lang_pred"] for r in L.identify(corpus, model).collect()}


def test_counts_equal_a_plain_count():
    assert L.counts(None) is None and L.counts("123 ... \n") is None
    at, n = L.counts("Ab ab, AB")
    assert n.sum() == sum(max(0, 10 - k + 1) for k in L.ORDERS)  # of ' ab ab ab '
    assert (L.counts("ab;ab  ab\t")[0] == at).all()


def test_ftrl_is_sparse_and_separates():
    xs = [(np.array([k % 2, 5]), np.array([1.0, 0.1])) for k in range(60)]
    w = L.ftrl(xs, [k % 2 for k in range(60)], 2)
    assert w[0, 0] > 0 > w[0, 1] and w[1, 1] > 0 > w[1, 0] and not w[6:].any()


def test_temperature_softens_wrong_certainty():
    z = [np.array([5.0, 0.0])] * 4
    assert L.fit_temperature(z, [0, 0, 0, 1]) > 1 > L.fit_temperature([np.array([0.5, 0.0])] * 4, [0] * 4)


def test_odd_and_empty_tables(spark):
    docs = odd_documents(spark)
    rows = {r["doc_id"]: r for r in L.predictions(docs).collect()}
    assert all((rows[i]["lang_pred"], rows[i]["score"]) == ("und", 0.0) for i in (2, 3, 5))
    kept = L.keep_identified(docs)
    assert kept.columns == docs.columns and 2 not in {r["doc_id"] for r in kept.collect()}
    assert L.predictions(no_documents(spark)).count() == 0
    unlabelled = docs.selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert {r["lang_pred"] for r in L.predictions(unlabelled).collect()} == {"und"}


def test_against_a_plain_twin():
    """N-grams, TF-IDF, FTRL and the softmax, written with dictionaries and loops over single features."""
    import math

    texts = [
        "the cat and the dog", "der Hund und die Katze", "The THE the 12 dogs!", "die und der, das", "x", "eine Katze", "a dog is a dog",
    ]
    ys = [0, 1, 0, 1, 0, 1, 0]

    def grams(text: str) -> dict[int, int]:
        clean = " ".join("".join(c.lower() if c.isalpha() else " " for c in text).split())
        codes, out = [ord(c) for c in f" {clean} "], {}
        for n in range(1, 5):
            for at in range(len(codes) - n + 1):
                h = 0
                for c in codes[at : at + n]:
                    h = (h ^ c) * 0x9E3779B1 & 0xFFFFFFFF
                    h ^= h >> 15
                f = (h ^ (n * 0x85EBCA6B & 0xFFFFFFFF)) >> 17
                out[f] = out.get(f, 0) + 1
        return out

    bags = [grams(t) for t in texts]
    for t, bag in zip(texts, bags, strict=True):
        at, n = L.counts(t)
        assert dict(zip(at.tolist(), n.tolist(), strict=True)) == bag
    idf = {f: math.log((1 + len(bags)) / (1 + sum(f in b for b in bags))) + 1 for f in range(L.BUCKETS)}
    vectors = []
    for bag in bags:
        raw = {f: (1 + math.log(n)) * idf[f] for f, n in bag.items()}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        vectors.append({f: v / norm for f, v in raw.items()})
    z, q = {}, {}

    def weight(f: int, k: int) -> float:
        a, b = z.get((f, k), 0.0), q.get((f, k), 0.0)
        return 0.0 if abs(a) <= L.L1 else -(a - math.copysign(L.L1, a)) / ((L.BETA + math.sqrt(b)) / L.ALPHA + L.L2)

    order = np.random.default_rng(7)
    for _ in range(L.EPOCHS):
        for i in order.permutation(len(vectors)):
            w = {(f, k): weight(f, k) for f in vectors[i] for k in (0, 1)}
            score = [sum(v * w[f, k] for f, v in vectors[i].items()) for k in (0, 1)]
            total = sum(math.exp(s) for s in score)
            for f, v in vectors[i].items():
                for k in (0, 1):
                    g = v * (math.exp(score[k]) / total - (ys[i] == k))
                    was = q.get((f, k), 0.0)
                    z[f, k] = z.get((f, k), 0.0) + g - (math.sqrt(was + g * g) - math.sqrt(was)) / L.ALPHA * w[f, k]
                    q[f, k] = was + g * g
    dense = np.array([idf[f] for f in range(L.BUCKETS)])
    fitted = L.ftrl([L.vector(t, dense) for t in texts], ys, 2)
    for f in {f for bag in bags for f in bag}:
        assert np.allclose(fitted[f], [weight(f, 0), weight(f, 1)], atol=1e-9)
    assert (fitted == 0).mean() > 0.9


def test_all_planes_have_letters(spark):
    assert L.counts("\U00031350") is not None and L.counts("\U0001f600") is None


def test_stage_fills_languages_and_takes_only_the_wanted(spark):
    r = __import__("random").Random(1)
    words = {"en": "the and of to in is that for with on".split(), "de": "der die und das ist nicht mit auf ein zu".split()}
    rows = [
        (
            i, " ".join(r.choices(words[y], k=20)), y if i % 5 else None, "s", 1, "kept", 0.5,
        ) for i in range(400) for y in (("en", "de")[i % 2],)
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, score double")
    kept = L.keep_identified(docs).collect()
    assert len(kept) == 400 and all(
        x["lang"] == ("en", "de")[x["doc_id"] % 2] and x["lang_pred"] == "kept" and x["score"] == 0.5 for x in kept
    )
    assert {x["doc_id"] % 2 for x in L.keep_identified(docs, wanted=("de",)).collect()} == {1}
