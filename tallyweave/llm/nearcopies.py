"""Near copies by the exact overlap of word shingles: the corpus pipeline's deduplication.

Two texts are near copies where their sets of five-word shingles have a Jaccard similarity of 0.8 or more. Candidates
come from two signatures of the set:

* its SimHash fingerprint: fingerprints within four bits of each other, by the grid range-join of `simhash`;
* 128 least shingle hashes in 32 bands of four, since texts of similarity 0.8 lie some ten bits apart, which no grid of
  64 bits reaches. Such texts share no band with probability (1 - 0.8^4)^32, which is 5e-8, and less above.

Pairs that share a band are found as `cells` says: along each cell, with its hub, and where a cell still has several
labels, among all its rows. Rows of a large group of near copies may share cells by the thousand and yet be less than
four fifths alike, and no bound tells that beforehand. So this last step compares blocks of rows inside tasks, where
pairs are entries of a matrix and only links that join labels come out. In a group of near copies most cells hold much
the same rows, and a set would be sent once for each of its bands. So rows that cells connect, as long as they number no
more than UNIT, are compared as one unit, to which each set is sent once; only beyond that the cells stand for themselves.
Every link is verified on the shingle sets themselves, so no text goes that isn't a near copy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm import cells, simhash
from tallyweave.llm.common import arrow_pass, components, cut, fresh, join_facts

WIDTH = 5
#: Least similarity as a fraction of whole numbers, so that the comparison is exact.
SHARED, OF = 4, 5
SEED = 42
BANDS, ROWS = 32, 4
ORDERS = 4
#: Rows of a cell that are compared at once with as many others, their shingles, and the entries of the matrix that does it.
BLOCK, BLOCK_SHINGLES = 2048, 1 << 21
#: Rows that cells connect which are compared without regard to cells.
UNIT = 16_384
MATRIX = 1 << 23
_FACTORS, _TERMS = np.random.Generator(np.random.PCG64(SEED)).integers(0, 1 << 63, (2, BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, width: int = WIDTH) -> tuple[np.ndarray, int]:
    """(hashes of the different shingles of `width` words, in order; the fingerprint of all of them).

    A shorter text is one shingle, a wordless one none.
    """
    hashes = simhash.shingle_hashes(text, width)
    return np.unique(hashes), simhash.majority(hashes)


def _digest(found: np.ndarray) -> int:
    """Of a whole set, as a signed long; 0 for the empty one."""
    return xxhash.xxh64_intdigest(found.tobytes(), SEED) - (1 << 63) if len(found) else 0


def _cells(found: np.ndarray) -> list[int]:
    """The set's cell in each band; none for the empty set."""
    if not len(found):
        return []
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for at in range(0, len(found), 1024):
        np.minimum(least, (found[at : at + 1024] * _FACTORS + _TERMS).min(1), out=least)
    return [xxhash.xxh64_intdigest(row.tobytes(), band) - (1 << 63) for band, row in enumerate(least.reshape(BANDS, ROWS))]


def near(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets in order overlap by SHARED / OF of their union at least."""
    if min(len(a), len(b)) * OF < max(len(a), len(b)) * SHARED:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * OF >= (len(a) + len(b) - both) * SHARED


def _sets(docs: DataFrame, text: str, doc_id: str, width: int) -> DataFrame:
    """(doc_id, fp, bits, bands) of every row; fp tells shingle sets apart, bits is the fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingles(t, width) for t in b.column(1).to_pylist()]
            bits = np.array([f for _, f in found], np.uint64).view(np.int64)
            cols = [
                pa.array([_digest(s) for s, _ in found], pa.int64()), pa.array(bits),
                pa.array([_cells(s) for s, _ in found], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *cols], ["doc_id", "fp", "bits", "bands"])

    return arrow_pass(docs.select(F.col(doc_id).cast("long"), F.col(text)), run, "doc_id long, fp long, bits long, bands array<long>")


def _contents(docs: DataFrame, wanted: DataFrame, text: str, doc_id: str, width: int) -> DataFrame:
    """(fp, content) of the wanted (fp, first_id): the set's hashes in order, of one row of each.

    A class without any id is looked for among all rows without one, by its content, so that no row meets all of these.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text"))
    known = rows.join(wanted.where("first_id IS NOT NULL"), F.col("_id") == F.col("first_id")).select("_text", "fp")
    unknown = rows.where("_id IS NULL").select("_text", F.lit(None).cast("long").alias("fp"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = ((fp, shingles(t, width)[0]) for t, fp in zip(*(c.to_pylist() for c in b.columns), strict=True))
            found = [(d, s.view(np.int64)) for fp, s in sets if (d := _digest(s)) == fp or fp is None]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f for f, _ in found], pa.int64()), pa.array([s for _, s in found], pa.list_(pa.int64()))], ["fp", "content"],
            )

    made = lambda some: arrow_pass(some, run, "fp long, content array<long>")
    nameless = made(unknown).join(wanted.where("first_id IS NULL").select("fp"), "fp", "left_semi")
    return made(known).unionByName(nameless).dropDuplicates(["fp"])  # rows may share their id


def _verified(pairs: DataFrame, contents: DataFrame) -> DataFrame:
    """The pairs (u, v) that are near copies."""
    a, b = (contents.select(F.col("fp").alias(x), F.col("content").alias(f"{x}_set")) for x in "uv")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hold = [near(x.values.to_numpy(), y.values.to_numpy()) for x, y in zip(*batch.columns[2:], strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["u", "v"]).filter(pa.array(hold, pa.bool_()))

    return arrow_pass(pairs.join(a, "u").join(b, "v").select("u", "v", "u_set", "v_set"), run, "u long, v long")


def _by_fingerprint(classes: DataFrame) -> DataFrame:
    """Pairs (u, v) of classes with equal fingerprints or with fingerprints that near_links links."""
    firsts = cut(classes.groupBy("bits").agg(F.min("fp").alias("head"), F.count("*").alias("n")))
    n, n_classes = firsts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    same = join_facts(classes.select("fp", "bits"), firsts, "bits", "n", n_classes).select(F.col("fp").alias("u"), F.col("head").alias("v"))
    links = simhash.near_links(firsts.select(F.col("bits").alias("fp")), n)
    a, b = (firsts.select(F.col("bits").alias(x), F.col("head").alias(f"{x}_head")) for x in "uv")
    return same.union(links.join(a, "u").join(b, "v").select("u_head", "v_head")).where("u <> v")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two of the sets share, as a matrix; shingles that a single set has are left out."""
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, at, times = np.unique(np.concatenate([*sets, np.zeros(0, np.int64)]), return_inverse=True, return_counts=True)
    column = np.cumsum(times > 1) - 1
    row, at = row[times[at] > 1], column[at[times[at] > 1]]
    shared = np.zeros((len(sets), len(sets)), np.int64)
    step = max(1, MATRIX // max(1, len(sets)))
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        here = (at >= first) & (at < first + step)
        part = np.zeros((len(sets), step), np.float32)  # sums of ones below 2^24 are exact
        part[row[here], at[here] - first] = 1
        shared += (part @ part.T).astype(np.int64)
    return shared


def joining(fps: list[int], labels: list[int], blocks: list[int], sets: list[np.ndarray], across: bool) -> list[tuple[int, int]]:
    """Near copies among the rows that join unlike labels, no more than it takes; `across`: those of two blocks only."""
    size = np.array([len(s) for s in sets], np.int64)
    label, block = np.array(labels, np.int64), np.array(blocks, np.int64)
    both = overlaps(sets)
    fine = (both * OF >= (size[:, None] + size[None, :] - both) * SHARED) & (label[:, None] != label[None, :])
    if across:
        fine &= block[:, None] != block[None, :]
    roots: dict[int, int] = {}

    def find(x: int) -> int:
        while roots.get(x, x) != x:
            x = roots[x]
        return x

    out = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(fine))), strict=True):
        x, y = find(labels[i]), find(labels[j])
        if x != y:
            roots[max(x, y)] = min(x, y)
            out.append((fps[i], fps[j]))
    return out


def _within(rows: DataFrame, contents: DataFrame) -> DataFrame:
    """Links (u, v) that join the unlike labels of near copies in one cell; rows: (cell, fp, label).

    A cell is cut into blocks of some BLOCK rows and BLOCK_SHINGLES shingles, and each two blocks are compared in one task:
    their pairs are counted there, by one product of matrices, and never become rows.
    """
    weighed = rows.join(contents.select("fp", F.size("content").alias("_size")), "fp")
    blocks = F.greatest(F.count("*") / BLOCK, F.sum("_size") / BLOCK_SHINGLES)
    sizes = weighed.groupBy("cell").agg(F.ceil(blocks).cast("int").alias("blocks"))
    dealt = rows.join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    meets = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda other: F.struct(F.least("block", other).alias("one"), F.greatest("block", other).alias("two")),
    )
    copies = dealt.select("cell", "fp", "label", "block", F.inline(meets)).join(contents, "fp")

    def run(key: tuple, group: pa.Table) -> pa.Table:
        fps, labels, blocks = (group[c].to_pylist() for c in ("fp", "label", "block"))
        sets = [x.values.to_numpy() for x in group["content"]]
        found = joining(fps, labels, blocks, sets, key[1].as_py() != key[2].as_py())
        return pa.table({c: pa.array([x[k] for x in found], pa.int64()) for k, c in enumerate("uv")})

    return copies.groupBy("cell", "one", "two").applyInArrow(run, "u long, v long")


def _units(rows: DataFrame) -> DataFrame:
    """rows (cell, fp, label) with rows that cells connect under one cell, where they number UNIT at most, each once."""
    heads = rows.groupBy("cell").agg(F.min("fp").alias("head"))
    roots = components(rows.join(heads, "cell").select(F.col("fp").alias("u"), F.col("head").alias("v")))
    few = roots.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") <= UNIT).select("root")
    known = roots.join(few, "root").select(F.col("node").alias("fp"), "root")
    placed = rows.join(known, "fp", "left")
    # a unit's name can't be a cell's, as cells get even numbers here and units odd ones
    name = F.when(F.col("root").isNull(), F.xxhash64("cell").bitwiseAND(F.lit(-2))).otherwise(F.xxhash64("root").bitwiseOR(F.lit(1)))
    return placed.select(name.alias("cell"), "fp", "label").distinct()


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Links (u, v) that join what (node, root) of earlier links and the new links do: stars, so few rounds are left to go."""
    return roots.select(F.col("node").alias("u"), F.col("root").alias("v")).union(links)


def _links(docs: DataFrame, classes: DataFrame, text: str, doc_id: str, width: int) -> DataFrame:
    """Links (u, v) between classes that join the same components as all near copies with a common band do."""
    shared = cells.in_company(classes.select(F.explode("bands").alias("cell"), "fp"))
    ordered = lambda pairs: pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    tried = cut(ordered(cells.to_heads(shared).union(_by_fingerprint(classes))))
    met = tried.select(F.explode(F.array("u", "v")).alias("fp")).union(shared.select("fp")).distinct()
    contents = cut(_contents(docs, classes.join(met, "fp", "left_semi").select("fp", "first_id"), text, doc_id, width))
    links = cut(_verified(tried, contents))
    roots = components(links)
    # each try looks only at cells whose rows the tries before it haven't joined: a pair sends two whole sets
    # some orders that cells take turns in: a row meets several others, but not another one in each of its cells
    order = F.xxhash64(F.pmod("cell", F.lit(ORDERS)), "fp")
    for more in (lambda rows: cells.in_turn(rows, order), lambda rows: cells.to_hubs(rows.drop("major"), links)):
        left = cells.mixed(cells.labelled(shared, roots))
        fresh_pairs = cut(ordered(more(left)).join(tried, ["u", "v"], "left_anti"))
        found = cut(_verified(fresh_pairs, contents))
        links, tried, roots = links.union(found), tried.union(fresh_pairs), components(_joined(roots, found))
    # the rows of a cell of two have been tried already
    left = cells.mixed(cells.labelled(shared.where("n > 2"), roots))
    return _joined(roots, _within(cut(_units(left)), contents))


def groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = WIDTH) -> DataFrame:
    """(doc_id, component_id) of every row: the smallest doc_id that a chain of near copies reaches.

    Rows of equal doc_id stay separate. A null doc_id is never the smallest unless all are null. Null and wordless texts
    are copies of one another.
    """
    rows = cut(_sets(docs, text, doc_id, width))
    classes = cut(
        rows.groupBy("fp").agg(
            F.min("doc_id").alias("first_id"), F.count("*").alias("n_same"), F.min("bits").alias("bits"), F.first("bands").alias("bands"),
        )
    )
    n, n_rows = classes.agg(F.count("*"), F.coalesce(F.sum("n_same"), F.lit(0))).first()
    roots = components(_links(docs, classes, text, doc_id, width))
    rooted = cut(
        classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first_id", "n_same", F.coalesce("root", "fp").alias("root"))
    )
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("n_root"))
    named = cut(join_facts(rooted, least, "root", "n_root", n).select("fp", "component_id", "n_same"))
    return join_facts(rows.select("doc_id", "fp"), named, "fp", "n_same", n_rows).select("doc_id", "component_id")


def keep_first(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = WIDTH) -> DataFrame:
    """The rows of docs that are the first of their group; of rows with equal doc_id all stay."""
    found = groups(docs, text, doc_id, width).where("doc_id = component_id OR component_id IS NULL")
    kept = fresh("kept")
    return docs.join(found.select(F.col("doc_id").alias(kept)).distinct(), F.col(doc_id).eqNullSafe(F.col(kept)), "left_semi")
