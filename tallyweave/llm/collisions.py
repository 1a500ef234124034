"""Nearest neighbours by collision counting over single projections.

A vector, brought to unit length, is projected on PROJECTIONS random lines. Along each line all projections stand in one
sorted array, and a query opens a window around its own projection there. A vector within a distance R of the query lies
in a window of half width R with the probability that a standard normal value is at most one in size, whatever the line;
so in how many of the windows it lies is binomial, and `threshold` is the count that it reaches with probability RECALL.
Virtual rehashing: a query starts with a small R and widens the same windows, so that only what is new is counted.
Vectors that reach the threshold are verified on the vectors themselves. A query ends when its k-th best is within R: all
that is nearer has reached the threshold by then, with that probability. No candidate is ever cut off by number.

All rows are indexed, in blocks of a bounded number of rows that are spread by hash; each block sorts its own arrays and
meets each block of queries in one task. What a query needs to know of other blocks is one number: its k-th best among
SAMPLE rows, beyond which it never has to look. The sample gives that bound alone; it decides no candidate.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyweave.llm.common import arrow_pass, cut

PROJECTIONS, RECALL, SEED = 64, 0.985, 42
#: Rows of a block of vectors and of a block of queries, about.
BLOCK, QUERIES = 8192, 4096
#: Rows that give each query an upper bound of its k-th best distance.
SAMPLE = 2048
#: Radii that a query goes through, as shares of that bound.
STEPS = (0.25, 0.5, 0.75, 1.0)
#: Rounding errors of a distance from a cosine.
SLACK = 1e-6


def threshold(m: int = PROJECTIONS, recall: float = RECALL) -> int:
    """The most windows of m that a vector at distance R lies in with probability `recall` at least, for half width R."""
    p = math.erf(1 / math.sqrt(2))
    tail = 0.0
    for count in range(m, 0, -1):
        tail += math.comb(m, count) * p**count * (1 - p) ** (m - count)
        if tail >= recall:
            return count
    return 1


def lines(dim: int, m: int = PROJECTIONS) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([SEED, dim])).standard_normal((dim, m))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows at length one; powers of two first, so that no square overflows or vanishes."""
    scaled = in_range(vectors)
    return scaled / np.sqrt((scaled * scaled).sum(1))[:, None]


def in_range(vectors: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, which is exact and leaves a cosine as it is."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(1))[1][:, None])


def cosines(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Of each row with the query, in double precision; equal rows get equal values. Both have gone through in_range."""
    return (vectors * query).sum(1) / (np.sqrt((vectors * vectors).sum(1)) * np.sqrt((query * query).sum()))


class Block:
    """Vectors (rows of a matrix) with a sorted array for each line."""

    def __init__(self, vectors: np.ndarray, m: int = PROJECTIONS) -> None:
        self.vectors, self.axes = in_range(vectors), lines(vectors.shape[1], m)
        places = unit(vectors) @ self.axes
        self.order = np.argsort(places, axis=0, kind="stable").astype(np.int32).T.copy()
        self.sorted = np.take_along_axis(places.T, self.order, 1)
        self.least = threshold(m)

    def windows(self, centres: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first, behind the last) place in each line's array of each query's window: two matrices, a row a query."""
        low, high = (np.empty(centres.shape, np.int64) for _ in range(2))
        for i, row in enumerate(self.sorted):
            low[:, i] = np.searchsorted(row, centres[:, i] - radius, "left")
            high[:, i] = np.searchsorted(row, centres[:, i] + radius, "right")
        return low, high

    def search(self, queries: np.ndarray, bounds: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(which query, places of its best rows, their cosines), nearest first, ties by ids; own: a query's own place or -1.

        bounds: a distance within which k other rows are known to lie somewhere; infinite where that isn't known.
        """
        n, asked = len(self.vectors), in_range(queries)
        centres = unit(queries) @ self.axes
        steps = [self.windows(centres, np.where(np.isinf(bounds), np.inf, bounds * s + SLACK)) for s in STEPS]
        for q in range(len(queries)):
            met, seen = np.zeros(n, np.int32), np.zeros(n, bool)
            if own[q] >= 0:
                seen[own[q]] = True
            found, scores = np.zeros(0, np.int64), np.zeros(0)
            before = None
            for share, (low, high) in zip(STEPS, steps, strict=True):
                if before is None:
                    parts = [row[a:b] for row, a, b in zip(self.order, low[q], high[q], strict=True)]
                else:
                    parts = [row[a:b] for row, a, b in zip(self.order, low[q], before[0], strict=True)]
                    parts += [row[a:b] for row, a, b in zip(self.order, before[1], high[q], strict=True)]
                before = low[q], high[q]
                met += np.bincount(np.concatenate(parts), minlength=n).astype(np.int32)
                fresh = np.flatnonzero((met >= self.least) & ~seen)
                seen[fresh] = True
                if len(fresh):
                    found = np.concatenate([found, fresh])
                    scores = np.concatenate([scores, cosines(self.vectors[fresh], asked[q])])
                    best = np.lexsort((ids[found], -scores))[:k]
                    found, scores = found[best], scores[best]
                radius = bounds[q] * share
                if len(found) >= k and math.sqrt(max(0.0, 2 - 2 * scores[k - 1])) <= radius:
                    break
            yield q, found, scores


def taking_part(vector: Column) -> Column:
    """Whether a vector has a direction: neither null nor empty nor zero, without null or non-finite components."""
    fine = F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ListArray | pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _bounded(queries: DataFrame, sample: list, k: int) -> DataFrame:
    """queries (_row, query_id, vector, dim) with `bound`: the distance of the k-th best other row among the sample's."""
    by_dim: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dim in {len(r["vector"]) for r in sample}:
        some = [r for r in sample if len(r["vector"]) == dim]
        by_dim[dim] = np.array([r["_row"] for r in some]), unit(np.array([r["vector"] for r in some], np.float64))

    def bound(row: int, vector: np.ndarray) -> float:
        rows, vectors = by_dim.get(vector.shape[1], (np.zeros(0), np.zeros((0, vector.shape[1]))))
        others = vectors[rows != row]
        if len(others) < k:
            return math.inf
        return math.sqrt(max(0.0, 2 - 2 * np.partition(others @ unit(vector)[0], len(others) - k)[-k]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [bound(r, np.array([v], np.float64)) for r, v in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.float64())], [*b.schema.names, "bound"])

    return arrow_pass(queries.select("_row", "query_id", "vector", "dim"), run, "_row long, query_id long, vector array<double>, dim int, bound double")


def neighbours(vectors: DataFrame, asks: Column | None = None, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest cosine of each query, nearest first, ties to the smaller id.

    asks says which rows are queries (ids divisible by 50); candidates are all rows but the query's own, fewer than k
    where there are no more. Vectors without a direction take no part (see taking_part). Rows of one id are different
    rows: each is a query and each a candidate of the others; of equal rows the order is open. A null id is no query and
    comes last among ties. Vectors of unlike lengths are never compared. An empty table gives an empty result. Each of
    a query's nearest is found with probability RECALL at least, for itself.
    """
    asks = F.col(vec_id) % 50 == 0 if asks is None else asks
    wide = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = cut(
        vectors.select(F.col(vec_id).cast("long").alias("vec_id"), wide.alias("vector"), F.coalesce(asks, F.lit(False)).alias("asks"))
        .where(taking_part(F.col("vector")))
        .select("*", F.size("vector").alias("dim"), F.monotonically_increasing_id().alias("_row"))
    )
    n, n_queries = rows.agg(F.count("*"), F.coalesce(F.sum(F.col("asks").cast("long")), F.lit(0))).first()
    blocks, turns = max(1, math.ceil(n / BLOCK)), max(1, math.ceil(n_queries / QUERIES))
    sample = rows.select("_row", "vector").orderBy(F.xxhash64("_row"), "_row").limit(SAMPLE).collect()
    queries = _bounded(rows.where("asks").withColumn("query_id", F.col("vec_id")), sample, k)
    deal = lambda of: F.pmod(F.xxhash64("_row"), F.lit(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    placed = rows.select("dim", deal(blocks).alias("block"), every(turns).alias("turn"), "_row", "vec_id", "vector")
    asked = queries.select("dim", every(blocks).alias("block"), deal(turns).alias("turn"), "_row", "query_id", "vector", "bound")

    def run(key: tuple, there: pa.Table, wanted: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if there.num_rows and wanted.num_rows:
            dim = key[0].as_py()
            there_rows = there["_row"].to_numpy()
            names = there["vec_id"].to_pylist()
            ids = np.array([(1 << 63) - 1 if x is None else x for x in names], np.int64)
            place = {r: i for i, r in enumerate(there_rows.tolist())}
            asked_rows = wanted["_row"].to_pylist()
            own = np.array([place.get(r, -1) for r in asked_rows])
            block = Block(_matrix(there["vector"], dim))
            for q, found, scores in block.search(_matrix(wanted["vector"], dim), wanted["bound"].to_numpy(), own, ids, k):
                query = wanted["query_id"][q].as_py()
                out += [(asked_rows[q], query, names[i], there_rows[i], s) for i, s in zip(found.tolist(), scores.tolist(), strict=True)]
        kinds = {"_query": pa.int64(), "query_id": pa.int64(), "vec_id": pa.int64(), "_row": pa.int64(), "score": pa.float64()}
        return pa.table({c: pa.array([x[i] for x in out], t) for i, (c, t) in enumerate(kinds.items())})

    keys = ("dim", "block", "turn")
    met = placed.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(
        run, "_query long, query_id long, vec_id long, _row long, score double"
    )
    best = Window.partitionBy("_query").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "_row")
    ranked = met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
