"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Texts become lower-case words. The benchmark's word n-grams are looked up in every document; how many documents hold
each says how rare it is. The rarer ones of an item are its seeds, each worth its inverse document frequency. Where
seeds worth MIN_SEEDS of the item's total lie near one another in a document, the stretch around them is aligned with
the whole item; the alignment's score against a full match tells copies, also edited and paraphrased ones, from
chance. An item that has leaked everywhere still has seeds: rarity only ranks an item's own n-grams.

Items are taken in blocks of at most BLOCK_WORDS words, so what is broadcast has a bound; each block reads the
documents anew. Documents are never joined with one another, and each is handled where it is read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.common import arrow_pass, fresh

N = 3
#: Share of an item's n-grams, the rarest first, that are seeds.
RARE_SHARE = 0.75
#: Least share of the worth of an item's seeds that a stretch must hold to be aligned.
MIN_SEEDS = 0.12
#: Alignments with this share of a full match's score are leaks.
MIN_SCORE = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
#: Words in a block of items: some 30 MB of arrays.
BLOCK_WORDS = 1 << 19

_WORDS = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return _WORDS.findall((text or "").lower())


def align(item: np.ndarray, stretch: np.ndarray) -> tuple[int, int, int]:
    """(score, first word, word after the last) of the best local alignment with linear gaps; ties: the earliest end.

    Rows over the item; within a row a gap is a running maximum, so each row is a few array operations.
    """
    m = len(stretch)
    ramp = np.arange(m + 1) * -GAP
    score, start = np.zeros(m + 1, np.int64), np.arange(m + 1)
    best = (0, 0, 0)
    for word in item.tolist():
        diagonal = score[:-1] + np.where(stretch == word, MATCH, MISMATCH)
        above = score[1:] + GAP
        row, origin = np.zeros(m + 1, np.int64), np.arange(m + 1)
        step = np.maximum(diagonal, above)
        row[1:] = np.maximum(step, 0)
        origin[1:] = np.where(step > 0, np.where(diagonal >= above, start[:-1], start[1:]), origin[1:])
        lifted = row + ramp
        top = np.maximum.accumulate(lifted)
        left = top > lifted
        if left.any():
            at = np.maximum.accumulate(np.where(lifted == top, np.arange(m + 1), 0))
            row, origin = np.where(left, top - ramp, row), np.where(left, origin[at], origin)
        score, start = row, origin
        k = int(score.argmax())
        if score[k] > best[0]:
            best = (int(score[k]), int(start[k]), k)
    return best


@dataclass
class Items:
    """A block of benchmark items over a vocabulary of their own; other words have the number 0."""

    ids: list[int]
    vocabulary: dict[str, int]
    texts: list[np.ndarray]
    keys: np.ndarray  # of distinct n-grams, sorted
    first: np.ndarray  # where each key's places begin
    item: np.ndarray  # places, by key
    place: np.ndarray
    worth: np.ndarray | None = None  # of each key, by place
    total: np.ndarray | None = None  # of each item's seeds
    short: dict[tuple[int, ...], list[int]] = field(default_factory=dict)  # items without an n-gram, by their words

    @classmethod
    def of(cls, rows: list[tuple[int, str | None]]) -> Items:
        vocabulary: dict[str, int] = {}
        texts = [np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words(t)], np.int64) for _, t in rows]
        self = cls([i for i, _ in rows], vocabulary, texts, *(np.zeros(0, np.int64),) * 4)
        for k, x in enumerate(texts):
            if 0 < len(x) < N:
                self.short.setdefault(tuple(x.tolist()), []).append(k)
        grams = [self.grams(x) for x in texts]
        key = np.concatenate([np.zeros(0, np.int64), *grams])
        item = np.concatenate([np.zeros(0, np.int64), *(np.full(len(g), k) for k, g in enumerate(grams))])
        place = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(g)) for g in grams)])
        order = np.argsort(key, kind="stable")
        self.keys, first = np.unique(key[order], return_index=True)
        self.first = np.append(first, len(key)).astype(np.int64)
        self.item, self.place = item[order], place[order]
        return self

    def grams(self, x: np.ndarray) -> np.ndarray:
        """Keys of the n-grams of a sequence of word numbers; -1 where a word is unknown. Texts of fewer words have none."""
        if len(x) < N:
            return np.zeros(0, np.int64)
        key, known = np.zeros(len(x) - N + 1, np.int64), np.ones(len(x) - N + 1, bool)
        for k in range(N):
            part = x[k : len(x) - N + 1 + k]
            key = key * (len(self.vocabulary) + 1) + part
            known &= part > 0
        return np.where(known, key, -1)

    def numbers(self, text: str | None) -> np.ndarray:
        found = words(text)
        get = self.vocabulary.get
        return np.fromiter((get(w, 0) for w in found), np.int64, len(found))

    def hits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, key indexes) of the document's n-grams that the items have."""
        g = self.grams(x)
        at = np.nonzero(g >= 0)[0]
        if not len(at) or not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        k = np.minimum(np.searchsorted(self.keys, g[at]), len(self.keys) - 1)
        ok = self.keys[k] == g[at]
        return at[ok], k[ok]

    def rank(self, frequency: np.ndarray, n_docs: int) -> None:
        """Choose each item's seeds by document frequency, and their worth."""
        idf = np.log((n_docs + 2) / (frequency + 1))
        by_place = np.repeat(np.arange(len(self.keys)), np.diff(self.first))
        self.worth = idf[by_place]
        order = np.lexsort((self.place, -self.worth, self.item))
        sizes = np.bincount(self.item, minlength=len(self.ids))
        nth = np.empty(len(order), np.int64)
        nth[order] = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.worth = np.where(nth < np.ceil(RARE_SHARE * sizes)[self.item], self.worth, 0.0)
        self.total = np.bincount(self.item, self.worth, len(self.ids))

    def leaks(self, text: str | None) -> list[tuple[int, float, int, int, int]]:
        """(item, score, first word, word after the last, seeds) of the best alignment with each item above MIN_SCORE."""
        x = self.numbers(text)
        if len(x) < N:
            return [(i, 1.0, 0, len(x), 0) for i in self.short.get(tuple(x.tolist()), [])]
        at, k = self.hits(x)
        if not len(at):
            return []
        times = self.first[k + 1] - self.first[k]
        place = np.repeat(self.first[k] - np.cumsum(times) + times, times) + np.arange(times.sum())
        at, place = np.repeat(at, times)[self.worth[place] > 0], place[self.worth[place] > 0]
        item, offset = self.item[place], self.place[place]
        # an item whose seeds, wherever they lie, are worth too little has no stretch worth aligning
        _, once = np.unique(place, return_index=True)
        enough = np.bincount(item[once], self.worth[place[once]], len(self.ids)) >= MIN_SEEDS * self.total
        out = []
        for i in np.unique(item[enough[item]]).tolist():
            mine = item == i
            p, q, seeds = at[mine], offset[mine], place[mine]
            size = len(self.texts[i])
            slack = size // 4 + 4
            found = None
            # stretches: runs of seeds with gaps of at most the item's length
            for part in np.split(np.arange(len(p)), np.nonzero(np.diff(p) > size + slack)[0] + 1):
                own = np.unique(seeds[part])
                if self.worth[own].sum() < MIN_SEEDS * self.total[i]:
                    continue
                lo, hi = max(0, int((p[part] - q[part]).min()) - slack), int((p[part] - q[part]).max()) + size + slack
                score, a, b = align(self.texts[i], x[lo:hi])
                share = score / (MATCH * size)
                if share >= MIN_SCORE and (found is None or share > found[1]):
                    found = (i, share, lo + a, lo + b, len(own))
            if found:
                out.append(found)
        return out


def frequencies(docs: DataFrame, items: Items, text: str = "text") -> tuple[np.ndarray, int]:
    """In how many rows each n-gram of the items occurs, and how many rows there are."""
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        total = np.zeros(len(own.keys) + 1, np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                total[np.unique(own.hits(own.numbers(t))[1])] += 1
            total[-1] += b.num_rows
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["k", "n"])

    out = np.zeros(len(items.keys) + 1, np.int64)
    for r in arrow_pass(docs.select(text), run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():  # BLOCK_WORDS rows at most
        out[r["k"]] = r["n"]
    return out[:-1], int(out[-1])


def _blocks(benchmark: DataFrame, text: str, item_id: str, block_words: int) -> Iterator[Items]:
    """Items in blocks that hold some block_words words; an item's block depends on its id alone."""
    sized = benchmark.where(F.col(item_id).isNotNull() & F.col(text).isNotNull()).select(
        F.col(item_id).cast("long").alias("i"), F.col(text).alias("t"),
    )
    total = sized.agg(F.sum(F.length("t"))).first()[0] or 0
    n = max(1, -(-total // (5 * block_words)))  # five characters a word at least, as a rule
    for k in range(n):
        part = sized.where(F.pmod(F.xxhash64("i"), F.lit(n)) == k) if n > 1 else sized
        if rows := [(r["i"], r["t"]) for r in part.orderBy("i", "t").collect()]:
            yield Items.of(rows)


SCHEMA = "doc_id long, item_id long, score double, first_word long, end_word long, n_seeds long"


def leaks(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id",
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """(doc_id, item_id, score, first_word, end_word, n_seeds) of every document and item that it holds a copy of.

    score is the alignment's score over that of a full match, MIN_SCORE to 1; first_word and end_word bound the copy,
    counted in words of the document. Null and empty texts have no row; a null doc_id is kept. An item of fewer than N
    words, which a text may hold by chance, leaks into documents of just these words. Items with equal texts each have their rows. A copy so edited that it holds hardly a run of N words of the
    item has no stretch to align and isn't found.
    """
    found = None
    for items in _blocks(benchmark, text, item_id, block_words):
        items.rank(*frequencies(docs, items, text))
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for b in batches:
                rows = [
                    (d, own.ids[i], *rest) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for i,
                    *rest in own.leaks(t)
                ]
                cols = list(zip(*rows, strict=True)) or [()] * 6
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")],
                )

        part = arrow_pass(docs.select(F.col(doc_id).cast("long"), F.col(text)), run, SCHEMA)
        found = part if found is None else found.union(part)
    return docs.sparkSession.createDataFrame([], SCHEMA) if found is None else found


def keep_clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs without a copy of a benchmark item. Rows of one doc_id go together."""
    name = fresh("bad")
    bad = leaks(docs, benchmark, text, doc_id).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(bad, F.col(doc_id).eqNullSafe(F.col(name)), "left_anti")
