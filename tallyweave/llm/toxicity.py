"""Toxicity scores of noisy-channel-restored text.

Language model: character trigrams counted over every document, interpolated with bigrams and single characters.
Channel: a written symbol may stand for a letter (leetspeak), for nothing (filler), or for one or two of a repeated
letter; letters written apart may form words. The readings of a token make a lattice, and a Viterbi decode under the
language model picks one; filler may part words too, so a token as it stands is one of its paths. A token of letters
alone without a letter three times in a row has one reading: itself.

Scoring: each restored word has features (itself and its beginnings). A feature's weight is the lower confidence bound
of its log odds between toxic and clean documents; it needs documents of SUPPORT different contents, so that copies of
one document don't make its words toxic. A word weighs as much as its heaviest feature, and a logistic regression over
a document's heaviest words gives the score. Length alone changes no score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.common import arrow_pass, held_out, thinned

#: Bound on the labelled documents of each class that weights are fitted on.
SAMPLE_ROWS = 8000
SUPPORT = 5
#: Standard errors below the log odds.
CAUTION = 2.0
PREFIXES = (3, 4, 5, 6)
END = "$"
THRESHOLD = 0.7
#: Words that a worker remembers readings and weights of.
MEMO = 500_000

# fixed values: letters that symbols stand for
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i",
    "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "<": "c", "¡": "i",
}
ALPHABET = "abcdefghijklmnopqrstuvwxyzàâäáãåçéèêëíìîïñóòôöõúùûüýßæøœ"
#: Classes of the language model: 0 is the edge of a word, the last stands for letters outside the alphabet.
CLASSES = 64
OTHER = CLASSES - 1
CODE = {c: k + 1 for k, c in enumerate(ALPHABET)}

# log costs of the channel, and what each emitted letter gains so that leaving letters out doesn't pay by itself
GAIN, SUBSTITUTE, DROP_SYMBOL, DROP_DIGIT, DROP_EDGE, DOUBLE, SINGLE, WILD, EDGE, BREAK, PART = 3.0, -0.5, -6.0, -7.0, -2.0, -1.0, -0.7, -3.5, -3.0, -8.0, 2.0

_WORDS = re.compile(r"[^\W\d_]+")
_TRIPLE = re.compile(r"([^\W\d_])\1\1")
_GAP = re.compile(r"[\s.\-_*~]+")
_APART = re.compile(r"(?<!\S)(?:[^\W_]|[@$!|+€£(<¡])(?:[\s.\-_*~]+(?:[^\W_]|[@$!|+€£(<¡])){2,}(?![^\W_])")
_TAIL = ".,;:!?\"'()[]{}<>%&#*$~^`…»”’|"
_HEAD = "\"'([{<#%&*~^`«“‘¿"


def _table() -> np.ndarray:
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x30000):
        x = chr(c)
        if x.isalpha():
            out[c] = CODE.get(x, OTHER)
    return out


_codes: list[np.ndarray] = []


def encode(text: str) -> np.ndarray:
    """Classes of a text's characters, with one 0 between words and at both ends."""
    if not _codes:
        _codes.append(_table())
    codes = _codes[0][np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)]
    edge = codes == 0
    return codes[np.append(True, ~(edge[1:] & edge[:-1]))]


def trigram_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Counts [a, b, c] over every row; at most CLASSES^3 sums reach the driver, however many rows there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grams = []
            for t in b.column(0).to_pylist():
                x = np.append(0, encode(t or "").astype(np.int64))
                if len(x) > 2:
                    grams.append(x[:-2] * CLASSES**2 + x[1:-1] * CLASSES + x[2:])
            total = np.bincount(np.concatenate(grams), minlength=CLASSES**3) if grams else np.zeros(0, np.int64)
            at = np.nonzero(total)[0]
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["gram", "n"])

    out = np.zeros(CLASSES**3, np.int64)
    for r in arrow_pass(docs.select(text), run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        out[r["gram"]] = r["n"]
    return out.reshape(CLASSES, CLASSES, CLASSES)


def log_probabilities(counts: np.ndarray) -> np.ndarray:
    """ln P(c | a b), interpolated; every class keeps some probability."""
    c3, c2, c1 = counts.astype(float), counts.sum(0).astype(float), counts.sum((0, 1)).astype(float)
    p1 = (c1 + 0.5) / (c1.sum() + 0.5 * CLASSES)
    n2, n3 = c2.sum(1, keepdims=True), c3.sum(2, keepdims=True)
    p2 = (c2 + 20 * p1) / (n2 + 20)
    p3 = (c3 + 10 * p2) / (n3 + 10)
    return np.log(p3)


def _readings(run: str, first: bool, last: bool, letters: dict[str, float]) -> list[tuple[str, float]]:
    """(letters, log cost) that a run of one symbol may stand for."""
    c, n = run[0], len(run)
    if c.isalpha():
        return [(c, 0.0)] if n == 1 else [(c + c, 0.0)] if n == 2 else [(c, SINGLE), (c + c, DOUBLE)]
    drop = DROP_DIGIT if c.isdigit() else 0.0 if c not in LEET else DROP_EDGE if first or last else DROP_SYMBOL
    out = [("", drop if n < 3 else 0.0)]
    for x in LEET.get(c, ""):
        cost = SUBSTITUTE + (EDGE if last and not c.isdigit() else 0)
        out += [(x, cost), (x + x, cost + DOUBLE)] if n > 1 else [(x, cost)]
    if c == "*" and not first and not last:
        out += [(x, WILD) for x in letters]
    if c in " \t":
        out += [(" ", 0.0 if n > 1 else BREAK)]
    elif not c.isalnum() and c not in LEET and c != "*" and not first and not last:
        out += [(" ", PART)]
    return out


def decode(token: str, lm: np.ndarray) -> str:
    """The reading of a lower-case token that is likeliest; words are parted by spaces. Ties: the first found."""
    runs = [m[0] for m in re.finditer(r"(.)\1*", token, re.S)]
    wild = {x: 0.0 for x in ALPHABET[:26]}
    # state: the last two classes; value: (score, chain of emitted letters)
    beam: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
    for k, run in enumerate(runs):
        choices = _readings(run, k == 0, k == len(runs) - 1, wild)
        after: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (a, b), (score, chain) in beam.items():
            for emitted, cost in choices:
                x, y, s = a, b, score + cost
                for c in emitted:
                    code = 0 if c == " " else CODE.get(c, OTHER)
                    s += lm[x, y, code] + (GAIN if code else 0)
                    x, y = y, code
                if (x, y) not in after or s > after[x, y][0]:
                    after[x, y] = (s, (chain, emitted) if emitted else chain)
        beam = after
    best = max(beam.items(), key=lambda e: e[1][0] + lm[e[0][0], e[0][1], 0])[1][1]
    parts = []
    while best:
        best, emitted = best
        parts.append(emitted)
    return "".join(reversed(parts))


def restore_token(token: str, lm: np.ndarray) -> list[str]:
    """The words of a lower-case token without white space."""
    core = token.rstrip(_TAIL).lstrip(_HEAD)
    if not core:
        return []
    if core.isalpha() and not _TRIPLE.search(core):
        return [core]
    return _WORDS.findall(decode(core, lm)) if any(c.isalpha() for c in core) else []


def join_apart(stretch: str, lm: np.ndarray) -> str:
    """The reading of letters written apart; gaps wider than the narrowest part words. One without a letter stays."""
    if not any(c.isalpha() for c in stretch):
        return stretch
    least = min(len(g) for g in _GAP.findall(stretch))
    return decode(_GAP.sub(lambda g: " " if len(g[0]) == least else "  ", stretch), lm)


@dataclass
class Restorer:
    """Restores texts with a memory of tokens that it has read."""

    lm: np.ndarray
    memo: dict[str, list[str]] = field(default_factory=dict)

    def token(self, token: str) -> list[str]:
        if (found := self.memo.get(token)) is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            found = self.memo[token] = restore_token(token, self.lm)
        return found

    def apart(self, low: str) -> list[str]:
        """Words of the stretches of letters written apart."""
        return [w for m in _APART.finditer(low) for w in _WORDS.findall(join_apart(m[0], self.lm))]

    def words(self, text: str | None) -> set[str]:
        """The different words of the restored text."""
        low = (text or "").lower()
        out = {w for t in set(low.split()) for w in self.token(t)}
        return out.union(self.apart(low)) if _APART.search(low) else out

    def text(self, text: str | None) -> str:
        """The restored text: words parted by one space, stretches of letters written apart in place."""
        low = (text or "").lower()
        low = _APART.sub(lambda m: join_apart(m[0], self.lm), low)
        return " ".join(w for t in low.split() for w in self.token(t))


def features(word: str) -> list[str]:
    """Features of a word: itself, with an end mark, and its beginnings."""
    return [word + END, *(word[:n] for n in PREFIXES if len(word) >= n)]


def _sample(docs: DataFrame, labels: DataFrame, text: str, doc_id: str, sample_rows: int) -> tuple[DataFrame, dict[int, float]]:
    """(text, toxic) of the labelled rows that are not held out, thinned to about sample_rows a class, and the rates."""
    known = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.where(~held_out(F.col("_id")))
    n = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    rates = {y: min(1.0, sample_rows / n[y]) if n.get(y) else 1.0 for y in (0, 1)}
    some = thinned(known, F.col("_id"), F.when(F.col("toxic") == 1, rates[1]).otherwise(rates[0]))
    # about two times sample_rows ids: a size that doesn't grow with the input
    rows = docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("text"))
    return rows.join(F.broadcast(some), F.col("_doc") == F.col("_id")).select("text", "toxic"), rates


def feature_weights(sample: DataFrame, lm: np.ndarray) -> dict[str, float]:
    """Weights of the features that speak for toxicity."""
    shared = sample.sparkSession.sparkContext.broadcast(lm)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(shared.value)
        for b in batches:
            seen: dict[str, list[int]] = {}
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = restorer.words(t)
                # the least hash of a document's words: copies and near copies share it
                slot = 1 << min((xxhash.xxh32_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), default=0) % 63
                for f in {f for w in words for f in features(w)}:
                    x = seen.setdefault(f, [0, 0, 0])
                    x[1 - y] += 1
                    x[2] |= slot * y
            cols = list(zip(*seen.values(), strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.string()), *(pa.array(c, pa.int64()) for c in cols)], ["f", "t", "n", "mask"],
            )

    total = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    rows = arrow_pass(sample.select("text", "toxic"), run, "f string, t long, n long, mask long").groupBy("f").agg(
        F.sum("t").alias("t"), F.sum("n").alias("n"), F.bit_count(F.expr("bit_or(mask)")).alias("kinds"),
    )
    t, n = F.col("t") + 0.5, F.col("n") + 0.5
    odds = F.log(t / (total.get(1, 0) + 1.0)) - F.log(n / (total.get(0, 0) + 1.0)) - CAUTION * F.sqrt(1 / t + 1 / n)
    found = rows.where(F.col("kinds") >= SUPPORT).select("f", odds.alias("w")).where("w > 0")
    return {r["f"]: r["w"] for r in found.collect()}  # bounded by the sample


@dataclass
class Weigher:
    """Document features under a model's weights, with a memory of tokens: None, or the heavy words of a token."""

    restorer: Restorer
    weights: dict[str, float]
    memo: dict[str, dict[str, float] | None] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.starts = {f.removesuffix(END)[: PREFIXES[0]] for f in self.weights}

    def word(self, word: str) -> float:
        return max(self.weights.get(f, 0.0) for f in features(word)) if word[: PREFIXES[0]] in self.starts else 0.0

    def heavy(self, words: list[str]) -> dict[str, float] | None:
        return {w: x for w in words if (x := self.word(w))} or None

    def document(self, text: str | None) -> tuple[float, float, float]:
        """The heaviest word's weight, the second heaviest's, and the sum of the next three."""
        low, memo, top = (text or "").lower(), self.memo, {}
        for t in set(low.split()):
            try:
                found = memo[t]
            except KeyError:
                if len(memo) >= MEMO:
                    memo.clear()
                found = memo[t] = self.heavy(restore_token(t, self.restorer.lm))
            if found:
                top |= found
        if _APART.search(low):
            top |= self.heavy(self.restorer.apart(low)) or {}
        best = sorted(top.values(), reverse=True)[:5] + [0.0] * 5
        return best[0], best[1], sum(best[2:5])


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 0.1, rounds: int = 100) -> np.ndarray:
    """Coefficients, the constant last, by Newton's method with a ridge and halved steps.

    More weight never lowers a score: features whose coefficient would be negative are left out and the rest fitted anew.
    """
    used = list(range(x.shape[1]))
    while True:
        design = np.column_stack([x[:, used], np.ones(len(x))])
        ridge = np.diag([penalty] * len(used) + [1e-3])

        def loss(w: np.ndarray, design: np.ndarray = design, ridge: np.ndarray = ridge) -> float:
            z = design @ w
            return float(weight @ (np.logaddexp(0, z) - y * z) + w @ ridge @ w / 2)

        w = np.zeros(len(used) + 1)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
            gradient = design.T @ (weight * (p - y)) + ridge @ w
            step = np.linalg.solve((design * (weight * p * (1 - p))[:, None]).T @ design + ridge, gradient)
            size, before = 1.0, loss(w)
            while size > 1e-6 and loss(w - size * step) > before:
                size /= 2
            w = w - size * step
            if np.abs(size * step).max() < 1e-6:
                break
        if all(w[:-1] >= 0):
            out = np.zeros(x.shape[1] + 1)
            out[[*used, -1]] = w
            return out
        used = [u for u, c in zip(used, w[:-1], strict=True) if c >= 0]


@dataclass
class Model:
    lm: np.ndarray
    weights: dict[str, float]
    coefficients: np.ndarray

    def score(self, x: tuple[float, float, float]) -> float:
        z = float(np.dot(self.coefficients[:-1], x) + self.coefficients[-1])
        return 1 / (1 + float(np.exp(-min(30.0, max(-30.0, z)))))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Language model over all rows of docs; weights and scores from the labelled rows that are not held out."""
    lm = log_probabilities(trigram_counts(docs, text))
    sample, rates = _sample(docs, labels, text, doc_id, sample_rows)
    weights = feature_weights(sample, lm)
    shared = docs.sparkSession.sparkContext.broadcast((lm, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigher = Weigher(Restorer(shared.value[0]), shared.value[1])
        for b in batches:
            x = [weigher.document(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([v[k] for v in x], pa.float64()) for k in range(3)), b.column(1)], ["a", "b", "c", "toxic"],
            )

    rows = arrow_pass(
        sample.select("text", "toxic"), run, "a double, b double, c double, toxic int",
    ).collect()  # about two times sample_rows
    x = np.array([(r["a"], r["b"], r["c"]) for r in rows], float).reshape(-1, 3)
    y = np.array([r["toxic"] for r in rows], float)
    if not 0 < y.sum() < len(y):  # one class at most: nothing to tell apart
        return Model(lm, weights, np.array([0.0, 0.0, 0.0, 30.0 if len(y) and y.all() else -30.0]))
    return Model(lm, weights, fit_logistic(x, y, np.where(y == 1, 1 / rates[1], 1 / rates[0])))


def score(docs: DataFrame, model: Model, text: str = "text", restored: bool = False) -> DataFrame:
    """docs with the columns score and predicted added, and restored_text on request (replacing such columns).

    Null and empty texts score as texts without a heavy word. Equal texts have equal scores.
    """
    docs = docs.drop("score", "predicted", "restored_text")
    names, at_text = docs.columns, docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        restorer = Restorer(m.lm)
        weigher = Weigher(restorer, m.weights)
        for b in batches:
            texts = b.column(at_text).to_pylist()
            scores = [m.score(weigher.document(t)) for t in texts]
            cols = [*b.columns, pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32())]
            more = [pa.array([restorer.text(t) for t in texts], pa.string())] if restored else []
            yield pa.RecordBatch.from_arrays([*cols, *more], [*names, "score", "predicted", *["restored_text"] * restored])

    schema = ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema
    ) + ", score double, predicted int" + ", restored_text string" * restored
    return arrow_pass(docs, run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    Null and empty texts have the score of a text without words. Of several labels of one id the toxic one counts;
    null labels and labels of unknown ids count for nothing. Equal texts have equal scores; repeated rows stay, also
    those of one id. Without labels of both kinds there is nothing to learn, and all scores are equal.
    """
    model = train(docs, labels, text, doc_id)
    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).alias("text"))
    return score(rows, model).drop("text")
