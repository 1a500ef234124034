"""The trie of filter orders against applying every order to every row."""

from __future__ import annotations

import itertools
import re
from collections import Counter

from pyspark.sql import DataFrame

from tallyweave.llm import filteraudit as A
from tests.llm.helpers import no_documents, odd_documents

LABELS = "doc_id long, quality int, toxic int"


def plain(docs: list[dict], labels: list[tuple]) -> dict:
    good = {d for d, q, _ in labels if q == 1} - {None}
    toxic = {d for d, _, t in labels if t == 1} - {None}
    least: dict[str, int] = {}
    for d in docs:
        if d["doc_id"] is not None:
            least[d["text"] or ""] = min(least.get(d["text"] or "", d["doc_id"]), d["doc_id"])
    rows = []
    for d in docs:
        text = d["text"] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = ("A" if len(words) < 100 else "") + ("B" if 100 * len(set(words)) < 80 * len(words) else "")
        fails += "C" if 100 * len(re.findall("[A-Z]", text)) > 10 * len(text) else ""
        fails += "D" if re.search("[#$%&*|]", text) else ""
        fails += "E" if d["doc_id"] is not None and least[text] < d["doc_id"] else ""
        rows.append((d["lang"] or "", fails, d["doc_id"] in good, d["doc_id"] in toxic))
    out: dict = {}
    shapley: Counter = Counter()
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                before = sum(f in r[1] for r in mine)
                left = [r for r in left if f not in r[1]]
                shapley[part, f] += len(gone)
                out[part, order, step] = [
                    len(left), len(gone), before - len(gone), sum(r[1] == f for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone),
                ]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def rows_of(df: DataFrame) -> dict:
    rows = df.collect()
    out = {
        (r["part"], r["filter_order"], r["step"]): tuple(
            r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
        )
        for r in rows
    }
    assert len(out) == len(rows)
    return out


def test_against_every_order_on_every_row(spark):
    words = [f"w{k}" for k in range(130)]
    texts = [
        " ".join(words), " ".join(words) + " a&b", " ".join(words[:50] * 3), "SHOUT " * 60, "SHOUT LOUD " * 60, "few words", "", None, "few words",
        " ".join(words), "#", "$ " * 120, " \t\n", " ".join(words).upper(), "few words", " ".join(words[:99]), " ".join(words[:100]),
    ]
    docs = [(k, texts[k % len(texts)], ("en", "de", None, "")[k % 4], "s", 1) for k in range(120)]
    docs += [docs[3], docs[9], (None, "few words", "en", "s", 1), (None, "only here", None, "s", 1), (5, "few words", "de", "s", 1)]
    labels = [(k, k % 3 % 2, k % 5 % 2) for k in range(0, 100, 2)] + [(2, 1, None), (2, 0, 1), (None, 1, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    expected = plain([dict(zip(df.columns, d, strict=True)) for d in docs], labels)
    assert rows_of(A.audit(df, spark.createDataFrame(labels, LABELS))) == expected


def test_states_are_shared_between_orders(spark, monkeypatch):
    """One frame for each unordered prefix, and no survivors left in memory."""
    made = []
    keep = A.cut
    monkeypatch.setattr(A, "cut", lambda df: made.append(df) or keep(df))
    rows = [("p", *(bool(k >> i & 1) for i in range(5)), False, True) for k in range(32)]
    marked = spark.createDataFrame(rows, "part string, A boolean, B boolean, C boolean, D boolean, E boolean, good boolean, toxic boolean")
    spark.catalog.clearCache()
    found = rows_of(A.interactions(marked))
    assert len(made) == 1 + 31 and len(found) == 600
    assert spark._jsparkSession.sharedState().cacheManager().isEmpty()
    assert found["p", "ABCDE", 1] == (16, 16, 0, 1, 0, 16, 16 * 24 + 4 * 8 * 6 + 6 * 4 * 4 + 4 * 2 * 6 + 24)


def test_odd_and_empty_tables(spark):
    labels = spark.createDataFrame([(1, 1, 1)], LABELS)
    docs = odd_documents(spark)
    expected = plain([r.asDict() for r in docs.select("doc_id", "text", "lang").collect()], [(1, 1, 1)])
    assert rows_of(A.audit(docs, labels)) == expected
    assert A.audit(no_documents(spark), labels).count() == 0
    assert len(rows_of(A.audit(docs, labels.limit(0)))) == len(expected)
