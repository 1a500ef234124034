from __future__ import annotations

import random

import pytest

import corpus_pipeline
from tallyweave.llm import sentencepieces
from tests.llm.helpers import DOCUMENTS, odd_documents
from tests.llm.test_linededup import plain_lines
from tests.llm.test_nearcopies import plain_kept

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_each_stage_takes_odd_and_empty_documents(spark, name, stage):
    docs = odd_documents(spark)
    for d in (docs, docs.limit(0)):
        out = stage(spark, d, SMALL)
        assert out.count() <= d.count()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns


def test_the_whole_run_keeps_one_of_each_copy(spark):
    rows = corpus_pipeline.run(spark, SMALL)
    n = spark.read.parquet(f"{SMALL}/documents.parquet").count()
    assert 0.5 * n < rows.count() <= n and rows.where("NOT round_trip").count() == 0
    assert rows.select("doc_id").distinct().count() == rows.count()


WORDS = {
    "en": "the and of to in is that for with on house river green walking evening letter under window sometimes bread".split(),
    "de": "der die und das ist nicht mit auf ein zu Haus Fluss gehen Abend Brief unter Fenster manchmal Brot immer".split(),
}


def planted(r: random.Random) -> tuple[list[tuple], list[str]]:
    """(documents, benchmark items): clean ones, near copies, shared lines, copied and edited items, and texts without letters."""
    text = lambda y, n: " ".join(r.choice(WORDS[y]) + str(r.randrange(40)) * (r.random() < 0.5) for _ in range(n))
    items = [text("en", 25) for _ in range(6)]
    rows = [(y, text(y, r.choice([30, 60, 90]))) for _ in range(30) for y in WORDS]
    near = []
    for y, t in rows[:16]:
        w = t.split()
        for _ in range(r.choice([1, 1, 3])):
            w[r.randrange(len(w))] = "edited"
        near.append((y, " ".join(w)))
    line = text("en", 12)
    shared = [("en", f"{text('en', 20)}\n{line}\n{text('en', 20)}") for _ in range(4)]
    leaks = []
    for n, item in enumerate(items[:4]):
        w = item.split()
        if n % 2:
            w[10] = "edited"
        leaks.append(("en", f"{text('en', 30)} {' '.join(w)} {text('en', 10)}"))
    nothing = [(None, None), ("en", ""), ("de", " 12 34 !"), (None, "?")]
    rows += near + shared + leaks + nothing + rows[20:24]
    r.shuffle(rows)
    return [(i, t, y if i % 6 else None, "s", len(t or "")) for i, (y, t) in enumerate(rows)], items


def plain_alignment(a: list[str], b: list[str]) -> int:
    """Smith-Waterman, cell by cell: 2 for equal words, -1 for unequal ones and for gaps."""
    row, best = [0] * (len(b) + 1), 0
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(max(0, row[j - 1] + (2 if x == y else -1), row[j] - 1, new[-1] - 1))
        row, best = new, max(best, *new)
    return best


def test_the_run_against_plain_stages(spark, tmp_path):
    """Each stage done plainly on the planted documents: kept ids and texts are those of the run."""
    docs, items = planted(random.Random(8))
    folder = str(tmp_path / "sf")
    spark.createDataFrame(docs, DOCUMENTS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    kept = [(i, t) for i, t, *_ in docs if any(c.isalpha() for c in t or "")]
    assert len(docs) - len(kept) == 4
    kept = plain_lines(kept)
    stays = plain_kept([t for _, t in kept])
    kept = [x for k, x in enumerate(kept) if k in stays]
    clean = [(i, t) for i, t in kept if all(plain_alignment(item.lower().split(), t.lower().split()) < len(item.split()) for item in items)]
    assert len(kept) < len(docs) - 12 and len(clean) == len(kept) - 4
    pieces = sentencepieces.Pieces.load()
    found = {r["doc_id"]: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert {i: pieces.decode(r["piece_ids"]) for i, r in found.items()} == dict(clean)
    assert all(r["round_trip"] for r in found.values())


def test_languages_are_filled_in(spark):
    docs, _ = planted(random.Random(9))
    out = corpus_pipeline.language_id(spark, spark.createDataFrame(docs, DOCUMENTS), "")
    was = {i: y for i, _, y, *_ in docs}
    rows = out.collect()
    assert all(r["lang"] in WORDS and was[r["doc_id"]] in (None, r["lang"]) for r in rows) and any(was[r["doc_id"]] is None for r in rows)
