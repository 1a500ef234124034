from __future__ import annotations

import random

import xxhash
from pyspark.sql import functions as F

from tallyweave.llm import cells, simhash
from tallyweave.llm.common import components
from tests.llm.helpers import no_documents, odd_documents


def plain_fingerprint(text: str | None) -> int:
    words = [
        w for w in "".join(
            chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""
        ).translate({9: " ", 10: " ", 11: " ", 12: " ", 13: " "}).split(" ") if w
    ]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps: dict[int, int]) -> dict[int, int]:
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in fps:
        for b in fps:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in fps}


def test_fingerprint_is_that_of_the_plain_rule():
    for text in (None, "", "one", "A b C", "a b c d", "A b c d\te\x0bf  g", "é É ß x y z " * 30):
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_components_equal_brute_force(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(r.choices(words, k=60)) for _ in range(25)]
    for t in list(texts):
        for _ in range(3):
            w = t.split()
            w[r.randrange(60)] = r.choice(words)
            texts.append(" ".join(w))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = {x["doc_id"]: x for x in simhash.near_duplicates(docs).collect()}
    fps = {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    expected = plain_components(fps)
    assert {i: rows[i]["component_id"] for i in fps} == expected
    assert {i: int(rows[i]["fingerprint"], 16) for i in fps} == fps
    kept = {x["doc_id"] for x in simhash.keep_first(docs).collect()}
    assert kept == set(expected.values())


def test_links_cross_dense_cells(spark):
    """Fingerprints that share most of their bits fill cells; brute force still agrees."""
    r = random.Random(9)
    base = [r.getrandbits(64) for _ in range(4)]
    fps = {i: base[i % 4] ^ sum(1 << b for b in r.sample(range(12), r.randint(0, 5))) for i in range(160)}
    by = {}
    for i, f in fps.items():
        by.setdefault(f, i)
    distinct = {i: f for f, i in by.items()}
    links = simhash.near_links(spark.createDataFrame([(_signed(f),) for f in by], "fp long"))
    roots = {x["node"]: x["root"] for x in components(links).collect()}
    groups, expected = {}, {}
    for i, root in plain_components(distinct).items():
        expected.setdefault(root, set()).add(_signed(distinct[i]))
        groups.setdefault(roots.get(_signed(distinct[i]), _signed(distinct[i])), set()).add(_signed(distinct[i]))
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def _signed(f):
    return f - (1 << 64) if f >> 63 else f


def test_the_manhattan_bound_turns_strangers_away(spark):
    """Rows of a cell agree in the counts of some bands only; the bound, not the exact check, drops most of their pairs."""
    r = random.Random(4)
    some = [r.getrandbits(64) for _ in range(300)]
    # strangers that agree with another one in the counts of half the segments: bits swapped inside segments
    fps = {f ^ (r.getrandbits(32) << 32) for f in some for _ in range(4)} | {f ^ 1 << r.randrange(64) for f in some} | set(some)
    shared = cells.in_company(simhash.grid_cells(spark.createDataFrame([(_signed(f),) for f in fps], "fp long"), 8))
    pairs = cells.along(shared, F.col("fp")).distinct()
    bound, links = simhash.within_bound(pairs), simhash.verified(pairs)
    assert pairs.count() > 1.3 * bound.count() > 1.3 * links.count() > 300
    assert links.exceptAll(simhash.verified(bound)).count() == 0
    fewer = cells.in_company(simhash.grid_cells(spark.createDataFrame([(_signed(f),) for f in fps], "fp long"), 8), simhash.apart)
    assert links.exceptAll(simhash.verified(cells.along(fewer, F.col("fp")).distinct())).count() == 0
    # cells of two strangers go before any pair is made
    two = spark.createDataFrame([(_signed(x),) for f in some for x in (f, f ^ (r.getrandbits(32) << 32))], "fp long")
    assert cells.in_company(simhash.grid_cells(two, 8)).count() > 20 * cells.in_company(simhash.grid_cells(two, 8), simhash.apart).count()


def test_cells_are_told_by_counts_and_hold_all_pairs_within_reach(spark):
    r = random.Random(6)
    swapped = [(0b01, 0b10)]  # one bit a segment either way: the same counts, 64 bits apart
    low, high = (sum(bits << 2 * s for s in range(32)) for bits in swapped[0])
    for bands in (8, 9, 12):
        fps = [(x, x ^ sum(1 << b for b in r.sample(range(64), 4))) for x in (r.getrandbits(64) for _ in range(60))]
        rows = spark.createDataFrame([(_signed(f),) for pair in [*fps, (low, high)] for f in pair], "fp long")
        grid = simhash.grid_cells(rows, bands)
        met = {
            frozenset((x["fp"], x["other"])) for x in grid.join(
                grid.withColumnRenamed("fp", "other"), "cell",
            ).where("fp < other").distinct().collect()
        }
        assert {frozenset(map(_signed, pair)) for pair in [*fps, (low, high)]} <= met
    assert simhash.bands_for(0) == 8 and simhash.bands_for(10**6) == 8 and simhash.bands_for(2 * 10**6) == 9 and simhash.bands_for(10**12) == 12


def test_hubs_and_long_chains(spark):
    """A fingerprint with very many copies, one with very many neighbours, and a chain that is walked bit by bit."""
    hub = 0x0123456789ABCDEF
    near = [hub ^ (1 << a) ^ (1 << b) for a in range(40) for b in range(a)]
    chain = [((1 << 64) - 1) ^ ((1 << k) - 1) for k in range(0, 64, 3)]
    fps = spark.createDataFrame([(_signed(f),) for f in {hub, *near, *chain}], "fp long")
    roots = {x["node"]: x["root"] for x in components(simhash.near_links(fps)).collect()}
    assert len({roots[_signed(f)] for f in [hub, *near]}) == 1 and len({roots[_signed(f)] for f in chain}) == 1
    assert roots[_signed(hub)] != roots[_signed(chain[0])]
    docs = spark.range(3000).selectExpr("id AS doc_id", """CASE WHEN id % 3 = 0 THEN 'one text of many copies' ELSE concat('text ',
        id) END AS text""")
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == 3000 and {x["component_id"] for x in rows if x["doc_id"] % 3 == 0} == {0}
    assert {x["n_same"] for x in rows if x["doc_id"] % 3 == 0} == {1000}


def test_long_paths_reach_the_fixed_point(spark):
    links = spark.range(3000).selectExpr("(id * 7919) % 3001 AS u", "((id + 1) * 7919) % 3001 AS v")
    assert {x["root"] for x in components(links).collect()} == {0}


def test_odd_and_empty_tables(spark):
    rows = simhash.near_duplicates(odd_documents(spark)).collect()
    assert len(rows) == 10
    by = {r["doc_id"]: r for r in rows}
    assert by[2]["fingerprint"] == by[3]["fingerprint"] == by[5]["fingerprint"] == "0" * 16
    assert by[3]["component_id"] == by[5]["component_id"] == 2 and by[6]["component_id"] == 1 and by[None]["component_id"] == 1
    assert simhash.near_duplicates(no_documents(spark)).count() == 0
    assert simhash.keep_first(odd_documents(spark)).columns == odd_documents(spark).columns
