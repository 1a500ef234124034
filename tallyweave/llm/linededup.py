"""Line deduplication over a sharded minimal perfect hash.

A line's key is the line stripped of the six ASCII white-space characters, with A-Z lower-cased. Keys found in two
documents or more are "repeated". Keys are told apart by 128 bits of XXH3, two of 64: the first places a key, the second
is its fingerprint, so that of 10^12 keys two are confused with probability 2e-15. They are cut into shards; each shard
is built into a minimal perfect hash: levels of bit arrays, where a key owns a bit on the first level on which no other
key of its level shares its place. A key's rank among the set bits indexes the shard's fingerprint, owner (smallest
doc_id) and count arrays. Documents are split and their line hashes probe the arrays; the lines themselves are never
joined.

Up to BLOCK_KEYS repeated keys, all arrays are broadcast, and the documents probe them in the same pass that rewrites
them. Beyond that no array comes near the driver: narrow rows of (doc_id, hash) meet their shard's arrays in a cogroup,
where a shard with very many rows, as that of a line that a third of the documents share, is salted: its rows are dealt
over several groups, each of which gets the arrays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.common import arrow_pass, cut, fresh

MIN_CHARS = 10
SPACE = " \t\n\x0b\x0c\r"
#: Keys of one shard: what one task builds.
SHARD_KEYS = 1 << 18
#: Keys that are broadcast at most. A key takes about 25 bytes, so that is 105 MB.
BLOCK_KEYS = 1 << 22
#: Line rows of one group that probes a shard's arrays.
GROUP_ROWS = 1 << 21
GAMMA = 1.6
NO_ID = (1 << 63) - 1


def line_digests(lines: list[str]) -> list[bytes | None]:
    """The 16 bytes that tell each line's key; None for keys of fewer than MIN_CHARS code points."""
    digest = xxhash.xxh3_128_digest
    keys = (line.strip(SPACE) for line in lines)
    return [digest(key.encode("utf-8", "surrogatepass").lower()) if len(key) >= MIN_CHARS else None for key in keys]


def halves(digests: list[bytes]) -> np.ndarray:
    """Two unsigned hashes a row: the place and the fingerprint of each key."""
    return np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)


def _mix(h: np.ndarray, level: int) -> np.ndarray:
    x = h ^ np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _places(keys: np.ndarray, level: int, size) -> np.ndarray:
    """Where keys (two hashes a row) fall on a level; keys that share one hash part on some level by the other."""
    return ((_mix(keys[:, 0], level) + _mix(keys[:, 1], level + 64)) % np.asarray(size, np.uint64)).astype(np.int64)


def build_levels(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(level sizes in bits, bits, order): order sorts the distinct keys by their minimal perfect hash value."""
    sizes, bits, order, left = [], [], [], np.arange(len(keys))
    while len(left):
        size = max(8, int(len(left) * GAMMA))
        place = _places(keys[left], len(sizes), size)
        alone = np.bincount(place, minlength=size) == 1
        mine = alone[place]
        order.append(left[mine][np.argsort(place[mine])])
        sizes.append(size)
        bits.append(alone)
        left = left[~mine]
    if not sizes:
        return np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)
    return np.array(sizes, np.int64), np.concatenate(bits), np.concatenate(order)


@dataclass
class Index:
    """Arrays of some shards. place[s] is a shard's position in them, or -1."""

    place: np.ndarray
    sizes: np.ndarray
    bases: np.ndarray
    bits: np.ndarray
    ranks: np.ndarray
    prints: np.ndarray
    owners: np.ndarray
    counts: np.ndarray

    @classmethod
    def join(cls, shards: list[dict], n_shards: int) -> Index:
        own = [np.frombuffer(r["sizes"], np.int64) for r in shards]
        place, sizes = np.full(n_shards, -1, np.int64), np.zeros((len(shards), max(map(len, own), default=0)), np.int64)
        for k, (r, x) in enumerate(zip(shards, own, strict=True)):
            place[r["shard"]] = k
            sizes[k, : len(x)] = x
        bases = np.concatenate([[0], np.cumsum(sizes.ravel())[:-1]]).reshape(sizes.shape) if sizes.size else sizes
        bits = [np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=int(x.sum())) for r, x in zip(shards, own, strict=True)]
        packed = np.packbits(np.concatenate(bits)) if bits else np.zeros(0, np.uint8)
        ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)]).astype(np.uint32)
        of = lambda name, kind: np.concatenate(
            [np.frombuffer(r[name], kind) for r in shards]
        ) if shards else np.zeros(0, kind)
        return cls(place, sizes, bases, packed, ranks, of("prints", np.uint64), of("owners", np.int64), of("counts", np.uint32))

    def probe(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key (two hashes a row) in the arrays, or -1 for keys that they don't hold."""
        out = np.full(len(keys), -1, np.int64)
        shard = self.place[shard_ids(keys[:, 0], len(self.place))]
        todo = np.nonzero(shard >= 0)[0]
        for level in range(self.sizes.shape[1]):
            size = self.sizes[shard[todo], level]
            todo, size = todo[size > 0], size[size > 0]
            if not len(todo):
                break
            at = self.bases[shard[todo], level] + _places(keys[todo], level, size)
            byte, bit = at >> 3, (at & 7).astype(np.uint8)
            hit = (self.bits[byte] >> (7 - bit)) & 1 == 1
            before = np.bitwise_count(self.bits[byte[hit]] >> (np.uint8(8) - bit[hit]).astype(np.uint16)).astype(np.int64)
            rank = self.ranks[byte[hit]].astype(np.int64) + before
            out[todo[hit]] = np.where(self.prints[rank] == keys[todo[hit], 1], rank, -1)
            todo = todo[~hit]
        return out

    def lost(self, keys: np.ndarray, who: np.ndarray) -> np.ndarray:
        """Which lines go: the arrays hold their key, and its owner is a smaller doc_id than the line's own."""
        found = self.probe(keys)
        out = found >= 0
        out[out] = self.owners[found[out]] < who[out]
        return out


def shard_ids(hashes: np.ndarray, n_shards: int) -> np.ndarray:
    return ((hashes >> np.uint64(33)) % np.uint64(n_shards)).astype(np.int64)


def repeated_keys(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(hash, print, owner, n_docs): keys of two documents or more, the smallest doc_id and the number of rows with them.

    Each Arrow batch is combined before the shuffle. A null doc_id counts as the largest id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            low: dict[bytes, list[int]] = {}
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for h in set(line_digests((t or "").split("\n"))) - {None}:
                    seen = low.setdefault(h, [i, i, 0])
                    seen[0], seen[1], seen[2] = min(seen[0], i), max(seen[1], i), seen[2] + 1
            cols = np.array(list(low.values()), np.int64).reshape(-1, 3)
            keys = halves(list(low)).view(np.int64)
            arrays = [keys[:, 0].copy(), keys[:, 1].copy(), *(cols[:, k].copy() for k in range(3))]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["hash", "print", "lo", "hi", "n"])

    ids = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("i"), F.col(text))
    rows = arrow_pass(ids, run, "hash long, print long, lo long, hi long, n long")
    found = rows.groupBy("hash", "print").agg(F.min("lo").alias("owner"), F.max("hi").alias("hi"), F.sum("n").alias("n_docs"))
    return found.where("owner < hi").select("hash", "print", "owner", "n_docs")


INDEX = "shard long, n long, sizes binary, bits binary, prints binary, owners binary, counts binary"


def build_index(keys: DataFrame, n_shards: int) -> DataFrame:
    """One row of arrays a shard, built by one task each: the columns of INDEX."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        both = np.stack([table[c].to_numpy().view(np.uint64) for c in ("hash", "print")], axis=1)
        shard, owners, counts = shard_ids(both[:, 0], n_shards), table["owner"].to_numpy(), table["n_docs"].to_numpy()
        for s in np.unique(shard):
            mine = np.nonzero(shard == s)[0]
            sizes, bits, order = build_levels(both[mine])
            at = mine[order]
            yield pa.RecordBatch.from_pylist([{
                "shard": int(s), "n": len(mine), "sizes": sizes.tobytes(), "bits": np.packbits(bits).tobytes(), "prints": both[at, 1].tobytes(),
                "owners": owners[at].tobytes(), "counts": np.minimum(counts[at], 0xFFFFFFFF).astype(np.uint32).tobytes(),
            }])

    placed = keys.withColumn("at", _shard(n_shards)).repartition(n_shards, "at").drop("at")
    return arrow_pass(placed, run, INDEX)


def _shard(n_shards: int) -> Column:
    return F.pmod(F.shiftrightunsigned("hash", 33), F.lit(n_shards))


def _rewrite(text: str | None, lost: list[bool]) -> tuple[str, int]:
    lines = (text or "").split("\n")
    if not any(lost):
        return text or "", 0
    return "\n".join(x for x, gone in zip(lines, lost, strict=True) if not gone), sum(lost)


def dedup_lines(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shard_keys: int = SHARD_KEYS, block_keys: int = BLOCK_KEYS,
) -> DataFrame:
    """docs with `text` rewritten and the columns n_lines, n_dropped and kept_sha256 added (replacing such columns).

    A line whose key has MIN_CHARS code points or more and is found in two documents stays only in the smallest
    doc_id with it, there as often as it occurs. Null and empty texts are one empty line and become ''. A null doc_id
    is larger than all others. Rows of one doc_id are one document.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_lines", "n_dropped", "kept_sha256")
    keys = cut(repeated_keys(docs, text, doc_id))
    n_keys = keys.count()
    n_shards = max(1, -(-n_keys // shard_keys))
    index = cut(build_index(keys, n_shards))
    names = docs.columns
    schema = ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema
    ) + ", n_lines long, n_dropped long, kept_sha256 string"
    at_text, at_id = names.index(text), names.index(doc_id)

    def rewritten(rows: DataFrame, lost_of) -> DataFrame:
        """lost_of(batch, lines of each row) says for each line of the batch, in order, whether it goes."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = b.column(at_text).to_pylist()
                lines = [(t or "").split("\n") for t in texts]
                lost, start, out = lost_of(b, lines), 0, []
                for t, own in zip(texts, lines, strict=True):
                    out.append((*_rewrite(t, lost[start : start + len(own)]), len(own)))
                    start += len(own)
                kept = [x[0] for x in out]
                cols = [*b.columns[: len(names)]]
                cols[at_text] = pa.array(kept, pa.string())
                sha = [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in kept]
                yield pa.RecordBatch.from_arrays(
                    [*cols, pa.array([x[2] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array(sha)],
                    [*names, "n_lines", "n_dropped", "kept_sha256"],
                )

        return arrow_pass(rows, run, schema)

    if n_keys <= block_keys:
        shared = spark.sparkContext.broadcast(Index.join([r.asDict() for r in index.collect()], n_shards))

        def by_arrays(b: pa.RecordBatch, lines: list[list[str]]) -> list[bool]:
            ids = [NO_ID if i is None else i for i in b.column(at_id).to_pylist()]
            found = [h for own in lines for h in line_digests(own)]
            who = np.repeat(np.array(ids, np.int64), [len(own) for own in lines])
            told = np.array([h is not None for h in found], bool)
            lost = np.zeros(len(found), bool)
            lost[told] = shared.value.lost(halves([h for h in found if h is not None]), who[told])
            return lost.tolist()

        return rewritten(docs, by_arrays)

    # more keys than are broadcast: narrow rows of the lines probe their shards' arrays, then the lost lines go to the documents
    key, gone = fresh("i"), fresh("lost")
    lost = _probed(cut(_line_rows(docs, text, doc_id, n_shards)), index, n_shards)
    lost = lost.groupBy(F.col("i").alias(key)).agg(F.collect_list("digest").alias(gone))
    joined = docs.join(
        lost, F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)) == F.col(key), "left",
    ).select(*(F.col(f"`{n}`") for n in names), gone)

    def by_list(b: pa.RecordBatch, lines: list[list[str]]) -> list[bool]:
        gone = [set(x or []) for x in b.column(len(names)).to_pylist()]
        return [h in g for own, g in zip(lines, gone, strict=True) for h in line_digests(own)]

    return rewritten(joined, by_list)


def _line_rows(docs: DataFrame, text: str, doc_id: str, n_shards: int) -> DataFrame:
    """(i, digest, shard): each document's different keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [list(set(line_digests((t or "").split("\n"))) - {None}) for t in b.column(1).to_pylist()]
            found = [h for some in own for h in some]
            ids = np.repeat(b.column(0).to_numpy(), [len(some) for some in own])
            shards = shard_ids(halves(found)[:, 0].copy(), n_shards)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(found, pa.binary()), pa.array(shards)], ["i", "digest", "shard"])

    ids = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("i"), F.col(text))
    return arrow_pass(ids, run, "i long, digest binary, shard long")


def _probed(lines: DataFrame, index: DataFrame, n_shards: int) -> DataFrame:
    """(i, digest) of the lines that go. A group holds GROUP_ROWS lines, give or take, and one shard's arrays."""
    salts = lines.groupBy("shard").agg(F.ceil(F.count("*") / GROUP_ROWS).alias("salts"))
    dealt = lines.join(salts, "shard").withColumn("salt", F.pmod(F.xxhash64("i", "digest"), F.col("salts"))).drop("salts")
    copies = index.join(salts, "shard").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("salts")

    def run(own: pa.Table, arrays: pa.Table) -> pa.Table:
        none = pa.table({"i": pa.array([], pa.int64()), "digest": pa.array([], pa.binary())})
        if not own.num_rows or not arrays.num_rows:
            return none
        held = Index.join(arrays.to_pylist(), n_shards)
        lost = held.lost(halves(own["digest"].to_pylist()), own["i"].to_numpy())
        return own.select(["i", "digest"]).filter(pa.array(lost))

    return dealt.groupBy("shard", "salt").cogroup(copies.groupBy("shard", "salt")).applyInArrow(run, "i long, digest binary")
