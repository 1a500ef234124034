"""SentencePiece encoding and decoding with a unigram model.

Pieces and their order come from a public model file, which holds no unigram scores; none are fitted, as tokenizers are
not trained here. Unigram log scores follow Zipf's law over that order: the piece of rank r has probability in
proportion to 1 / r. A text is marked (a space becomes U+2581, one
stands in front), and the best segmentation is found by Viterbi over a double-array trie of the pieces' UTF-8 bytes.
A character that no piece covers costs the least score less UNKNOWN_PENALTY and becomes byte pieces. Decoding turns
pieces and bytes back into the very text.

Pieces don't run on from a letter into a space or over a line end, so a text falls into units with one best
segmentation each. A worker segments the units that it hasn't seen, many at a time, and remembers them.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.common import arrow_pass

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Units that a worker remembers.
MEMO = 400_000
#: Units of more bytes are segmented one by one and not remembered.
LONG = 64
#: So many units, or characters of a long one, have their pieces looked up at once.
BLOCK = 32_768
#: Stands behind a unit; UTF-8 has no such byte.
END = b"\xff"


@dataclass
class Trie:
    """Double array: the child of node s by byte c is t = base[s] + c, if check[t] = s. value[t] is a piece or -1."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray

    @classmethod
    def build(cls, keys: dict[bytes, int]) -> Trie:
        """From non-empty keys to values of 0 and more."""
        children: dict[bytes, list[int]] = defaultdict(list)
        seen = set()
        for key in keys:
            for n in range(len(key), 0, -1):
                if key[:n] in seen:
                    break
                seen.add(key[:n])
                children[key[: n - 1]].append(key[n - 1])
        base, check, value, taken = [0], [-1], [-1], bytearray(1)
        taken[0], free, roomy, queue = 1, 257, 257, [(b"", 0)]
        for prefix, node in queue:
            if not (own := sorted(children.get(prefix, ()))):
                continue
            # one child fits into the first free place; several look on from where several last fitted
            at = (free if len(own) == 1 else roomy) - own[0]
            while True:
                while at + 257 > len(taken):
                    grow = len(taken) + 257
                    taken.extend(bytes(grow))
                    for array, blank in ((base, 0), (check, -1), (value, -1)):
                        array.extend([blank] * grow)
                if not any(taken[at + c] for c in own):
                    break
                at += 1
            if len(own) > 1:
                roomy = max(roomy, at + own[0] - 64)
            base[node] = at
            for c in own:
                taken[at + c], check[at + c] = 1, node
                key = prefix + bytes([c])
                value[at + c] = keys.get(key, -1)
                queue.append((key, at + c))
            while free < len(taken) and taken[free]:
                free += 1
        return cls(*(np.array(x, np.int32) for x in (base, check, value)))


@dataclass
class Pieces:
    """A vocabulary: text pieces by id with their log scores, and the ids of the 256 byte pieces."""

    pieces: dict[int, str]
    scores: np.ndarray
    bytes_: list[int]
    trie: Trie = field(init=False)

    def __post_init__(self) -> None:
        if any(re.search(rf"[^{MARK}]{MARK}|\n", p) for p in self.pieces.values()):
            raise ValueError("a piece runs over the end of a unit")
        self.trie = Trie.build({p.encode(): i for i, p in self.pieces.items()})
        self.unknown = min(self.scores[list(self.pieces)], default=0.0) - UNKNOWN_PENALTY
        self.longest = max((len(p.encode()) for p in self.pieces.values()), default=0)
        self.raw = {i: p.replace(MARK, " ").encode() for i, p in self.pieces.items()} | {i: bytes([c]) for c, i in enumerate(self.bytes_)}
        self.table = pa.array([self.raw.get(i, b"") for i in range(len(self.scores))], pa.large_binary())
        self.is_byte = np.zeros(len(self.scores), bool)
        self.is_byte[self.bytes_] = True

    @classmethod
    def load(cls, path: str = MODEL_FILE) -> Pieces:
        """From a model file with byte pieces, on the driver; workers get the arrays."""
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        octets = [model.piece_to_id(f"<0x{c:02X}>") for c in range(256)]
        if not all(map(model.is_byte, octets)):
            raise ValueError("the model has no byte pieces")
        text = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        rank = np.empty(len(text))
        rank[sorted(range(len(text)), key=lambda k: (-model.get_score(text[k]), text[k]))] = np.arange(1, len(text) + 1)
        scores = np.full(len(ids), -np.inf)
        scores[text] = -np.log(rank) - np.log((1 / rank).sum())
        return cls({i: model.id_to_piece(i) for i in text}, scores, octets)

    def segment_one(self, unit: bytes) -> list[int]:
        """Viterbi over one unit, of any length. Of equal scores the first found stays: the longer last piece."""
        base, check, value, n = self.trie.base, self.trie.check, self.trie.value, len(unit)
        best, starts, ids = [0.0] + [-np.inf] * n, [0] * (n + 1), [-1] * (n + 1)
        for s in range(n):
            if best[s] == -np.inf or unit[s] & 0xC0 == 0x80:
                continue
            width = 1 + sum(unit[s] >= x for x in (0xC0, 0xE0, 0xF0))
            node, covered = 0, False
            for e in range(s + 1, min(n, s + self.longest) + 1):
                after = base[node] + unit[e - 1]
                if check[after] != node:
                    break
                node = after
                if (i := value[node]) >= 0:
                    covered |= e - s == width
                    if (x := best[s] + self.scores[i]) > best[e]:
                        best[e], starts[e], ids[e] = x, s, int(i)
            e = min(n, s + width)
            if not covered and (x := best[s] + self.unknown) > best[e]:
                best[e], starts[e], ids[e] = x, s, -1
        out, end = [], n
        while end:
            start, i = starts[end], ids[end]
            out.append([self.bytes_[c] for c in unit[start:end]] if i < 0 else [i])
            end = start
        return [i for part in reversed(out) for i in part]

    def segment(self, units: list[bytes]) -> list[list[int]]:
        """Viterbi over many units at once; the same result as segment_one for each."""
        return [np.frombuffer(ids, "<i4").tolist() for ids in self.packed(units)]

    def packed(self, units: list[bytes]) -> list[bytes]:
        """What segment gives, each unit's ids as little-endian 32-bit numbers."""
        short = [u for u in units if len(u) <= LONG]
        found = chain.from_iterable(self._block(short[k : k + BLOCK]) for k in range(0, len(short), BLOCK))
        return [next(found) if len(u) <= LONG else self._long(u) for u in units]

    def _edges(self, text: np.ndarray, at: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, id) of all pieces in text that start at the places `at`, id -1 for a character without a piece.

        Units stand in text one after another, an END, which no piece holds, at each of the places `ends`.
        """
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        lead = text[at]
        chars = 1 + (lead >= 0xC0).astype(np.int64) + (lead >= 0xE0) + (lead >= 0xF0)
        covered, own, node, depth, found = np.zeros(len(at), bool), np.arange(len(at)), np.zeros(len(at), np.int64), 0, []
        while len(own) and depth < self.longest:
            after = base[node] + text[at[own] + depth]
            ok = check[after] == node
            own, node, depth = own[ok], after[ok], depth + 1
            i = value[node]
            hit = i >= 0
            who, i = own[hit], i[hit]
            covered[who[chars[who] == depth]] = True
            found.append((at[who], at[who] + depth, i))
        bare = ~covered
        starts = at[bare]
        found.append((starts, np.minimum(starts + chars[bare], ends[np.searchsorted(ends, starts)]), np.full(len(starts), -1, np.int32)))
        return tuple(map(np.concatenate, zip(*found, strict=True)))

    def _written(self, text: np.ndarray, starts: np.ndarray, lasts: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of edges on best paths, those of -1 spelt in byte pieces; and how many each edge gives."""
        many = np.where(ids < 0, lasts - starts, 1)
        out = np.repeat(ids, many).astype("<i4")
        spelt = np.nonzero(out < 0)[0]
        places = np.repeat(starts - (np.cumsum(many) - many), many)[spelt] + spelt
        out[spelt] = np.array(self.bytes_, "<i4")[text[places]]
        return out, many

    def _block(self, units: list[bytes]) -> list[bytes]:
        """Short units: step by step, all edges that start as far into their unit at once."""
        text = np.frombuffer(END.join(units) + END, np.uint8)
        ends = np.nonzero(text == END[0])[0]
        firsts = np.concatenate([[0], ends[:-1] + 1])
        at = np.nonzero((text & 0xC0 != 0x80) & (text != END[0]))[0]
        starts, lasts, ids = self._edges(text, at, ends)
        far = (np.arange(len(text)) - np.repeat(firsts, ends - firsts + 1)).astype(np.uint16)[starts]
        order = np.argsort(far, kind="stable")
        starts, lasts, ids = starts[order], lasts[order], ids[order]
        gains = np.where(ids < 0, self.unknown, self.scores[ids])
        best, edge = np.full(len(text), -np.inf), np.full(len(text), -1, np.int64)
        best[firsts] = 0
        steps = np.concatenate([[0], np.cumsum(np.bincount(far))]).tolist()
        for lo, hi in pairwise(steps):
            x, to = best[starts[lo:hi]] + gains[lo:hi], lasts[lo:hi]
            better = np.nonzero(x > best[to])[0]
            to = to[better]
            best[to], edge[to] = x[better], better + lo
        on_path, now = np.zeros(len(text), bool), ends[ends > firsts]
        while len(now):
            on_path[now] = True
            now = starts[edge[now]]
            now = now[edge[now] >= 0]
        path = np.nonzero(on_path)[0]
        taken = edge[path]
        out, many = self._written(text, starts[taken], lasts[taken], ids[taken])
        # a unit's ids end where those of its last edge do
        cuts = (4 * np.concatenate([[0], np.cumsum(many)])[np.cumsum(on_path)[ends]]).tolist()
        raw = out.tobytes()
        return [raw[a:b] for a, b in pairwise([0, *cuts])]

    def _long(self, unit: bytes) -> bytes:
        """One long unit: edges for a stretch of it at once, then one after another."""
        text, n = np.frombuffer(unit + END, np.uint8), len(unit)
        best, came, ids = array("d", [-np.inf]) * (n + 1), array("q", [0]) * (n + 1), array("i", [-1]) * (n + 1)
        best[0], ends = 0.0, np.array([n])
        heads = np.nonzero(text[:n] & 0xC0 != 0x80)[0]
        for k in range(0, len(heads), BLOCK):
            starts, lasts, own = self._edges(text, heads[k : k + BLOCK], ends)
            order = np.argsort(starts, kind="stable")
            gains = np.where(own < 0, self.unknown, self.scores[own])
            for s, e, i, gain in zip(*(x[order].tolist() for x in (starts, lasts, own, gains)), strict=True):
                if (x := best[s] + gain) > best[e]:
                    best[e], came[e], ids[e] = x, s, i
        path = [n]
        while came[path[-1]]:
            path.append(came[path[-1]])
        lasts = np.array(path[::-1])
        return self._written(text, np.frombuffer(came, np.int64)[lasts], lasts, np.frombuffer(ids, np.int32)[lasts])[0].tobytes()

    def decode(self, ids: list[int]) -> str:
        """The text of ids; unknown and control ids stand for nothing."""
        raw = b"".join(self.raw.get(i, b"") for i in ids)
        return raw.removeprefix(b" ").decode("utf-8", "replace")

    def decode_all(self, lists: pa.ListArray) -> list[str]:
        """What decode gives for each list of ids, none of them null."""
        taken = self.table.take(lists.values)
        _, ends, data = taken.buffers()
        raw = data.to_pybytes() if data else b""
        ends = np.frombuffer(ends, np.int64)[: len(taken) + 1] if len(taken) else np.zeros(1, np.int64)
        return [raw[a:b].removeprefix(b" ").decode("utf-8", "replace") for a, b in pairwise(ends[lists.offsets.to_numpy()].tolist())]


@dataclass
class Encoder:
    pieces: Pieces
    #: The ids of units, as in Pieces.packed.
    memo: dict[bytes, bytes] = field(default_factory=dict)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; none for a null or empty one. A mark that the text itself holds is written in bytes."""
        lists = self.lists(texts)
        ids = lists.values.to_numpy()
        return [ids[a:b] for a, b in pairwise(lists.offsets.to_numpy().tolist())]

    def lists(self, texts: list[str | None]) -> pa.ListArray:
        """What encode gives, in one array."""
        raw = [b" " + t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        at, text = np.cumsum([0, *map(len, raw)]), b"".join(raw)
        cuts = np.append(_unit_starts(text, at), len(text))
        units = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(text)]).dictionary_encode()
        ids = self._packed(units.dictionary.to_pylist())
        taken = _lists(ids).take(units.indices)
        ends = taken.offsets.to_numpy()[np.searchsorted(cuts[:-1], at)]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), taken.values)

    def _packed(self, units: list[bytes]) -> list[bytes]:
        """The ids of each of these units, all different; short ones are remembered."""
        own = MARK.encode()
        out = [self.memo.get(u) for u in units]
        new = [k for k, ids in enumerate(out) if ids is None]
        marked = [units[k].replace(b" ", own) for k in new]
        found = self.pieces.packed(marked)
        if len(self.memo) + len(new) > MEMO:
            # those remembered first are mostly the frequent ones: the others go
            late = list(self.memo)[len(self.memo) // 4 :]
            for u in late:
                del self.memo[u]
        for k, m, ids in zip(new, marked, found, strict=True):
            out[k] = np.array([self.pieces.bytes_[c] for c in own], "<i4").tobytes() if units[k] == own else ids
            # a text without spaces is one unit: remembered, such texts would fill the memory
            if len(m) <= LONG:
                self.memo[units[k]] = out[k]
        return out


def _unit_starts(text: bytes, at: np.ndarray) -> np.ndarray:
    """Where the units of the texts that begin at the places `at` begin: a mark; spaces with what follows up to the next
    space, line end or mark; or line ends."""
    c = np.frombuffer(text, np.uint8)
    space, line, mark = c == 0x20, c == 0x0A, np.zeros(len(c), bool)
    own = MARK.encode()
    k = text.find(own)
    while k >= 0:
        mark[k : k + len(own)] = True
        k = text.find(own, k + len(own))
    stops = line | mark
    starts = np.zeros(len(c) + 1, bool)
    starts[1:-1] = (space[1:] & ~space[:-1]) | (line[1:] & ~line[:-1]) | (stops[:-1] & ~stops[1:])
    starts[:-1] |= mark & (c == own[0])
    starts[at] = True
    return np.nonzero(starts[:-1])[0]


def _lists(packed: list[bytes]) -> pa.ListArray:
    """A list of ids for each."""
    ids = pa.array(np.frombuffer(b"".join(packed), "<i4"), pa.int32())
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, packed)]) // 4, pa.int32()), ids)


def encode(docs: DataFrame, pieces: Pieces, text: str = "text") -> DataFrame:
    """docs with the column piece_ids added (replacing such a column): the ids of each text, none for null and empty ones."""
    docs = docs.drop("piece_ids")
    names, at_text = docs.columns, docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [*b.columns, encoder.lists(b.column(at_text).to_pylist())], [*names, "piece_ids"],
            )

    return arrow_pass(docs, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", piece_ids array<int>")


def decode(docs: DataFrame, pieces: Pieces, ids: str = "piece_ids") -> DataFrame:
    """docs with the column decoded added (replacing such a column); null ids decode to ''."""
    docs = docs.drop("decoded")
    names, at = docs.columns, docs.columns.index(ids)
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([shared.value.decode(x or []) for x in b.column(at).to_pylist()], pa.string())], [*names, "decoded"],
            )

    return arrow_pass(docs, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", decoded string")


def digests(docs: DataFrame, pieces: Pieces, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Of every row: how it is encoded and whether decoding gives the text again.

    (doc_id, piece_ids, n_pieces, n_byte_pieces, log_score, ids_crc32, decoded_sha256, round_trip): the encoded corpus,
    and what decoding the ids gives. log_score leaves byte pieces out. A null text counts as '' and has no ids; equal
    texts have equal ids, and repeated rows stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        encoder, scores = Encoder(p), np.where(np.isfinite(p.scores), p.scores, 0.0)
        for b in batches:
            texts = b.column(1).to_pylist()
            lists = encoder.lists(texts)
            at, ids = lists.offsets.to_numpy(), lists.values.to_numpy()
            in_bytes, gains, raw = np.concatenate([[0], np.cumsum(p.is_byte[ids])]), scores[ids], memoryview(ids.astype("<i4").tobytes())
            cols: list[list] = [[], [], [], []]
            for t, decoded, (lo, hi) in zip(texts, p.decode_all(lists), pairwise(at.tolist()), strict=True):
                row = (
                    round(float(gains[lo:hi].sum()), 6), zlib.crc32(raw[4 * lo : 4 * hi]),
                    hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest(), decoded == (t or ""),
                )
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            kinds = [pa.float64(), pa.int64(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), lists, pa.array(np.diff(at), pa.int64()), pa.array(np.diff(in_bytes[at]), pa.int64()),
                    *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True)),
                ],
                ["doc_id", "piece_ids", "n_pieces", "n_byte_pieces", "log_score", "ids_crc32", "decoded_sha256", "round_trip"],
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return arrow_pass(
        rows, run,
        f"doc_id {kind}, piece_ids array<int>, n_pieces long, n_byte_pieces long, log_score double, ids_crc32 long, decoded_sha256 string, round_trip boolean",
    )
