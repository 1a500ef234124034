"""SimHash near-duplicates by segment-popcount embedding.

A fingerprint's 64 bits form 32 segments of two bits; its embedding is the bit count of each segment. The Manhattan
distance of two embeddings never exceeds the Hamming distance of the fingerprints. Each count (0, 1 or 2) is written
as a thermometer of two bits, so that distance is the bit count of one XOR.

Grid range-join: the 32 axes form bands. A distance of at most four breaks at most four of them, so the counts of two
fingerprints within reach agree in all the other bands: the fingerprints share a cell of one of the grids, each of which
takes the counts of all bands but four. There are eight bands at least, and more as the number of fingerprints grows, so
that a cell holds hardly any strangers. The Manhattan distance of the whole embeddings turns away those it does: a cell
of two rows further apart goes when its rows are counted, before any pair is made, and the pairs of fuller cells (see
`cells`) are held to it before the exact Hamming distance verifies them. No link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.llm import cells
from tallyweave.llm.common import arrow_pass, components, cut, fresh, join_facts

WIDTH = 4
MAX_BITS = 4
SEED = 42
SEGMENTS = 32
#: Chance that two random segments of two bits have the same count.
SAME = 3 / 8
#: Bands are added until a cell holds so many strangers on average, or MOST_BANDS are reached.
STRANGERS = 0.25
LEAST_BANDS, MOST_BANDS = 8, 12


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """Hashes of the text's shingles of `width` words, repeats included; a shorter text is one shingle, a wordless one none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    digest = xxhash.xxh64_intdigest
    spans = zip((ends - sizes)[: 1 - width].tolist(), ends[width - 1 :].tolist(), strict=True)
    return np.fromiter((digest(joined[i:j], SEED) for i, j in spans), np.uint64, len(words) - width + 1)


def majority(hashes: np.ndarray) -> int:
    """The fingerprint: the bits that more than half of the hashes have set; 0 without a hash."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        octets = hashes[at : at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """Unsigned 64-bit fingerprint of the text's shingles of `width` words, repeats included; 0 without a word."""
    return majority(shingle_hashes(text, width))


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = WIDTH) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long. Null or wordless texts have fp 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, width) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(fps)], ["doc_id", "fp"])

    return arrow_pass(docs.select(F.col(doc_id).cast("long"), F.col(text)), run, "doc_id long, fp long")


def _embedding(fp: Column) -> Column:
    """Per-segment bit counts as thermometers: the low bit of a segment says count >= 1, the high bit count = 2."""
    odd = F.lit(0x5555555555555555)
    low, high = fp.bitwiseAND(odd), F.shiftrightunsigned(fp, 1).bitwiseAND(odd)
    return low.bitwiseOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def bands_for(n: int) -> int:
    """The bands for n different fingerprints: eight up to 1.6 million, nine up to 9.8 million, and so on."""
    return next((b for b in range(LEAST_BANDS, MOST_BANDS) if n * SAME ** (SEGMENTS * (b - MAX_BITS) / b) <= STRANGERS), MOST_BANDS)


def grid_cells(fps: DataFrame, bands: int) -> DataFrame:
    """(cell, fp): one row for each fingerprint and grid, told by the counts of all bands but MAX_BITS."""
    axes = np.array_split(np.arange(SEGMENTS), bands)
    masks = [reduce(lambda m, s: m | 3 << 2 * int(s), band, 0) for band in axes]
    grids = [reduce(int.__or__, c) for c in combinations(masks, bands - MAX_BITS)]
    signed = F.array(*(F.lit(m - (1 << 64) if m >> 63 else m) for m in grids))
    spread = fps.select("fp", _embedding(F.col("fp")).alias("counts"), F.posexplode(signed).alias("grid", "mask"))
    return spread.select(F.xxhash64("grid", F.col("counts").bitwiseAND(F.col("mask"))).alias("cell"), "fp")


def apart(u: Column, v: Column) -> Column:
    """The embeddings are more than MAX_BITS apart, and so the fingerprints are."""
    return F.bit_count(_embedding(u).bitwiseXOR(_embedding(v))) > MAX_BITS


def within_bound(pairs: DataFrame) -> DataFrame:
    """The different pairs (u, v) whose embeddings are at most MAX_BITS apart."""
    return pairs.where(~apart(F.col("u"), F.col("v"))).distinct()


def verified(pairs: DataFrame) -> DataFrame:
    """The pairs (u, v) of fingerprints that are at most MAX_BITS apart."""
    return pairs.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= MAX_BITS)


def near_links(fps: DataFrame, n: int | None = None) -> DataFrame:
    """Links (u, v) between distinct fingerprints that join the same components as all pairs within MAX_BITS do.

    fps: column fp, no value twice; n of them. The result holds at most two links a cell row plus one for each pair that
    is within reach and yet unlike in label, not all pairs of a dense cluster.
    """
    shared = cells.in_company(grid_cells(fps.select("fp"), bands_for(fps.count() if n is None else n)), apart)
    links = cut(verified(within_bound(cells.along(shared, F.col("fp")))))
    rows = cells.mixed(cells.labelled(shared, components(links)))
    return links.union(verified(within_bound(cells.across(rows))))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = WIDTH) -> DataFrame:
    """(doc_id, fingerprint, component_id, n_same) of every row.

    component_id is the smallest doc_id that a chain of links reaches; n_same counts the rows with the very same
    fingerprint. Rows of equal doc_id stay separate. A null doc_id is never the smallest unless all are null.
    """
    rows = cut(fingerprints(docs, text, doc_id, width))
    classes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n_same")))
    n, n_rows = classes.agg(F.count("*"), F.coalesce(F.sum("n_same"), F.lit(0))).first()
    roots = components(near_links(classes, n))
    rooted = cut(
        classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first_id", "n_same", F.coalesce("root", "fp").alias("root"))
    )
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("n_root"))
    named = cut(join_facts(rooted, least, "root", "n_root", n).select("fp", "component_id", "n_same"))
    return join_facts(rows, named, "fp", "n_same", n_rows).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_same"
    )


def keep_first(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs that are the first of their component; of rows with equal doc_id all stay."""
    found = near_duplicates(docs, text, doc_id).where("doc_id = component_id OR component_id IS NULL")
    kept = fresh("kept")
    return docs.join(found.select(F.col("doc_id").alias(kept)).distinct(), F.col(doc_id).eqNullSafe(F.col(kept)), "left_semi")
