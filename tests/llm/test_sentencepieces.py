from __future__ import annotations

import math
import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyweave.llm import sentencepieces as P
from tests.llm.helpers import LONG, no_documents, odd_documents


@pytest.fixture(scope="module")
def pieces():
    return P.Pieces.load()


def best_score(unit: str, p: P.Pieces) -> float:
    """Plain dynamic programme over characters."""
    by = {text: p.scores[i] for i, text in p.pieces.items()}
    best = [0.0] + [-math.inf] * len(unit)
    for e in range(1, len(unit) + 1):
        for s in range(max(0, e - 48), e):
            w = by.get(unit[s:e], p.unknown if e - s == 1 else None)
            if w is not None:
                best[e] = max(best[e], best[s] + w)
    return best[-1]


def score_of(ids, p):
    total, k = 0.0, 0
    while k < len(ids):
        if p.is_byte[ids[k]]:
            lead = p.bytes_.index(ids[k])
            k += 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            total += p.unknown
        else:
            total += p.scores[ids[k]]
            k += 1
    return total


def test_segmentation_is_the_best_one(pieces):
    r = random.Random(4)
    units = ["▁" + "".join(r.choices("aeinrst hz日é😀".replace(" ", ""), k=r.randint(1, 14))) for _ in range(150)]
    for unit, ids in zip(units, pieces.segment([u.encode() for u in units]), strict=True):
        assert ids == pieces.segment_one(unit.encode())
        assert score_of(ids, pieces) == pytest.approx(best_score(unit, pieces))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=60))
def test_round_trip_of_any_text(text):
    p = test_round_trip_of_any_text.__dict__.setdefault("pieces", None) or P.Pieces.load()
    test_round_trip_of_any_text.pieces = p
    assert p.decode(P.Encoder(p).encode([text])[0].tolist()) == text


def test_trie_holds_exactly_its_keys():
    keys = {w.encode(): k for k, w in enumerate(["a", "ab", "abc", "b", "ba", "é", "日本", "\x01", "\xff"])}
    t = P.Trie.build(keys)

    def find(key: bytes) -> int:
        node = 0
        for c in key:
            after = t.base[node] + c
            if after >= len(t.check) or t.check[after] != node:
                return -1
            node = after
        return int(t.value[node])

    assert {k: find(k) for k in keys} == keys
    assert all(find(k) < 0 for k in (b"", b"c", b"abcd", "日".encode(), b"bb"))


def test_tables(spark, pieces):
    rows = {r["doc_id"]: r for r in P.digests(odd_documents(spark), pieces).collect()}
    assert all(r["round_trip"] for r in rows.values()) and rows[2]["n_pieces"] == rows[3]["n_pieces"] == 0 and rows[7]["n_byte_pieces"] > 0
    both = P.decode(P.encode(odd_documents(spark), pieces), pieces).collect()
    assert {r["doc_id"]: r["decoded"] for r in both}[4] == LONG
    assert P.digests(no_documents(spark), pieces).count() == 0


def test_any_units_as_one_by_one(pieces):
    r = random.Random(5)
    texts = ["".join(r.choices("aeinrst hz日é😀ก\x00▁\n  ", k=r.choice([0, 1, 2, 5, 30, 300]))) for _ in range(300)]
    texts += ["▁▁", " ", "  ", "\n", "a▁", "▁ a", "\n\n▁\n b", " ▁", "日" * 300, "ab" * 200 + " " * 100, None]
    own = [pieces.bytes_[c] for c in "▁".encode()]

    def plain(text):
        units = re.findall(r"▁| *[^ \n▁]+| +|\n+", " " + text) if text else []
        return [i for u in units for i in (own if u == "▁" else pieces.segment_one(u.replace(" ", "▁").encode()))]

    encoder = P.Encoder(pieces)
    for some in (texts[:7], texts, texts[::-1], []):
        assert [ids.tolist() for ids in encoder.encode(some)] == [plain(t) for t in some]
        assert pieces.decode_all(encoder.lists(some)) == [t or "" for t in some]


def test_long_units_are_cut_in_stretches(pieces, monkeypatch):
    unit = "".join(random.Random(6).choices("aeinrstz日é😀", k=900)).encode()
    monkeypatch.setattr(P, "BLOCK", 7)
    assert pieces.segment([unit, b"", unit[:1], unit])[::3] == [pieces.segment_one(unit)] * 2


def test_a_vocabulary_without_pieces_writes_bytes():
    p = P.Pieces({}, P.np.full(256, -P.np.inf), list(range(256)))
    assert P.Encoder(p).encode(["a é"])[0].tolist() == list("▁a▁é".encode())


def test_the_memo_is_bounded_in_bytes_too(pieces, monkeypatch):
    encoder = P.Encoder(pieces)
    texts = [f"{k}" + "日本" * 200 for k in range(50)]
    assert len(encoder.encode(texts)) == 50 and max(map(len, encoder.memo), default=0) <= P.LONG
    monkeypatch.setattr(P, "MEMO", 100)
    for k in range(20):
        words = [f"w{k}x{j}" for j in range(40)]
        assert pieces.decode_all(encoder.lists(words)) == words and len(encoder.memo) <= 101


def test_cost_of_units_met_before(pieces):
    """CPU time of texts whose units a worker remembers, against that of splitting the same texts by a regular expression."""
    r = random.Random(7)
    syllables = [a + b for a in "bcdfghklmnprstvw" for b in ("a", "e", "i", "o", "u", "en", "ar", "is")]
    words = ["".join(r.choices(syllables, k=r.randint(1, 4))) for _ in range(60_000)]
    texts = [" ".join(r.choices(words, k=300)) for _ in range(1000)]
    encoder = P.Encoder(pieces)
    encoder.encode(words)

    def seconds(work):
        start = time.process_time()
        work()
        return time.process_time() - start

    split = min(seconds(lambda: [re.findall(r"▁| *[^ \n▁]+| +|\n+", " " + t) for t in texts]) for _ in range(5))
    assert min(seconds(lambda: encoder.encode(texts)) for _ in range(5)) < 2.5 * split
