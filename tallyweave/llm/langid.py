"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Letters are lower-cased, everything else becomes a space; n-grams of one to four characters are hashed into BUCKETS
features. Document frequencies come from every learnable document. The regression is trained with
follow-the-regularised-leader (FTRL-proximal) under an elastic net, on at most SAMPLE_ROWS documents dealt evenly over
the languages; a part of them is set aside to fit the temperature by which scores are calibrated.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.common import arrow_pass, held_out, thinned

BUCKETS = 1 << 15
ORDERS = (1, 2, 3, 4)
#: Bound on the documents that the classifier is fitted on.
SAMPLE_ROWS = 2400
#: One in so many of them calibrates the temperature instead.
CALIBRATION = 5
#: A document is rejected when no language gets this calibrated score, or when it has no letter.
MIN_SCORE = 0.5
UNDETERMINED = "und"
EPOCHS = 3
#: Languages of which there are fewer documents than one in so many aren't learned, so there are at most so many labels.
MOST_LABELS = 1000
# FTRL-proximal: learning rate alpha / (beta + sqrt(sum of squared gradients)), penalties l1 and l2
ALPHA, BETA, L1, L2 = 2.0, 1.0, 0.02, 0.05


@lru_cache(maxsize=1)
def _folds() -> np.ndarray:
    """Code point of each letter's lower case, 32 for what is no letter."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            out[c] = ord(low) if len(low := x.lower()) == 1 else c
    return out


def counts(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """(features in order, how often each occurs), or None for a text without a letter."""
    codes = np.frombuffer((" " + (text or "") + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = _folds()[codes]
    space = codes == 32
    codes = codes[np.append(True, ~(space[1:] & space[:-1]))]  # one space between words and at the ends
    if len(codes) < 2:
        return None
    grams, h = [], np.zeros(len(codes), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        h = (h[: len(codes) - n + 1] ^ codes[n - 1 :]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        if n in ORDERS and len(h):
            grams.append((h ^ np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) >> np.uint32(17))
    total = np.bincount(np.concatenate(grams), minlength=BUCKETS)
    at = np.nonzero(total)[0]
    return at, total[at]


def vector(text: str | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Features and their TF-IDF values (1 + ln tf, times idf), of length 1."""
    if (found := counts(text)) is None:
        return None
    at, n = found
    x = (1 + np.log(n)) * idf[at]
    norm = np.sqrt(x @ x)
    return at, x / norm if norm else x


def document_frequencies(docs: DataFrame, text: str = "text") -> np.ndarray:
    """In how many documents each feature occurs (the last entry counts the documents). One vector a task is merged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS + 1, np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                if (found := counts(t)) is not None:
                    total[found[0]] += 1
                    total[-1] += 1
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["feature", "n"])

    rows = arrow_pass(docs.select(text), run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS + 1, np.int64)
    for r in rows:  # BUCKETS + 1 rows at most
        out[r["feature"]] = r["n"]
    return out


@dataclass
class Model:
    labels: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float = 1.0

    def logits(self, x: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        return x[1] @ self.weights[x[0]]

    def predict(self, text: str | None) -> tuple[str, float]:
        """The likeliest label (ties: the first in order) and its calibrated probability; UNDETERMINED and 0 without a letter."""
        x = vector(text, self.idf)
        if x is None or not self.labels:
            return UNDETERMINED, 0.0
        p = softmax(self.logits(x) / self.temperature)
        k = int(p.argmax())
        return self.labels[k], float(p[k])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def ftrl(xs: list[tuple[np.ndarray, np.ndarray]], ys: list[int], n_labels: int, epochs: int = EPOCHS) -> np.ndarray:
    """Weights by feature and label; most are exactly zero."""
    z, n = np.zeros((BUCKETS, n_labels)), np.zeros((BUCKETS, n_labels))

    def weights(at: np.ndarray) -> np.ndarray:
        zs = z[at]
        return np.where(np.abs(zs) <= L1, 0.0, (np.sign(zs) * L1 - zs) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(xs)):
            at, x = xs[k]
            w = weights(at)
            p = softmax(x @ w)
            p[ys[k]] -= 1
            g = np.outer(x, p)
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(np.arange(BUCKETS))


def fit_temperature(logits: list[np.ndarray], ys: list[int]) -> float:
    """The temperature of least log loss on a grid from 0.05 to 20."""
    if not logits:
        return 1.0
    grid = np.geomspace(0.05, 20, 121)
    loss = [sum(-np.log(max(softmax(z / t)[y], 1e-12)) for z, y in zip(logits, ys, strict=True)) for t in grid]
    return float(grid[int(np.argmin(loss))])


def train(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from the rows that are not held out and have a language. Without such rows it has no labels.

    Rows with a null id count as not held out; repeated rows count as often as they occur, in the document frequencies
    and in the sample, where rows of one id are taken together or not at all. Null texts and texts without a letter
    teach nothing. Languages with less than one in MOST_LABELS of the rows are left out.
    """
    known = docs.where(~held_out(F.col(doc_id)) & F.col(lang).isNotNull()).select(
        F.col(doc_id).cast("string").alias("i"), F.col(text).alias("t"), F.col(lang).alias("y"),
    )
    df = document_frequencies(known, "t")
    idf = np.log((1.0 + df[-1]) / (1.0 + df[:-1])) + 1.0
    sizes = known.groupBy("y").agg(F.count("*").alias("n"))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    by = {r["y"]: r["n"] for r in sizes.where(F.col("n") * MOST_LABELS >= total).collect()}  # MOST_LABELS rows at most
    labels = sorted(by)
    if not labels:
        return Model([], idf, np.zeros((BUCKETS, 0)))
    each = max(1, sample_rows // len(labels))
    rates = F.create_map(*(x for y in labels for x in (F.lit(y), F.lit(min(1.0, each / by[y])))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            xs = [counts(t) for t in b.column(0).to_pylist()]
            at = [None if x is None else x[0].astype("<u2").tobytes() for x in xs]
            n = [None if x is None else x[1].astype("<u4").tobytes() for x in xs]
            yield pa.RecordBatch.from_arrays(
                [pa.array(at, pa.binary()), pa.array(n, pa.binary()), b.column(1), b.column(2)], ["at", "n", "y", "c"],
            )

    part = F.pmod(F.xxhash64(F.lit("calibrate"), "i"), F.lit(CALIBRATION)) == 0
    sample = thinned(known, F.col("i"), rates[F.col("y")]).select("t", "y", part.alias("c"))
    xs, ys, zs, zy = [], [], [], []
    for r in arrow_pass(
        sample, run, "at binary, n binary, y string, c boolean",
    ).where("at IS NOT NULL").collect():  # sample_rows, give or take
        at, n = np.frombuffer(r["at"], "<u2").astype(np.int64), np.frombuffer(r["n"], "<u4")
        x = (1 + np.log(n)) * idf[at]
        (zs if r["c"] else xs).append((at, x / np.sqrt(x @ x)))
        (zy if r["c"] else ys).append(labels.index(r["y"]))
    model = Model(labels, idf, ftrl(xs, ys, len(labels)))
    model.temperature = fit_temperature([model.logits(x) for x in zs], zy)
    return model


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with the columns lang_pred and score added (replacing such columns)."""
    docs = docs.drop("lang_pred", "score")
    names, at_text = docs.columns, docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS weights a label

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shared.value.predict(t) for t in b.column(at_text).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *b.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()),
                ], [*names, "lang_pred", "score"]
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", lang_pred string, score double"
    return arrow_pass(docs, run, schema)


def predictions(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row, by a model trained on the rows that are not held out.

    Null texts and texts without a letter are UNDETERMINED with score 0. Equal texts have equal predictions; rows of
    one id stay separate.
    """
    model = train(docs, text, lang, doc_id)
    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).alias("text"))
    return identify(rows, model).drop("text")


def keep_identified(
    docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", min_score: float = MIN_SCORE, wanted: tuple[str, ...] | None = None
) -> DataFrame:
    """The rows of docs whose text has a language, one of the wanted ones if they are given: some letter, and a score of
    min_score or more for the likeliest language. Where `lang` is null it becomes that language; other columns stay."""
    names, at_text, at_lang = docs.columns, docs.columns.index(text), docs.columns.index(lang)
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, text, lang, doc_id))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shared.value.predict(t) for t in b.column(at_text).to_pylist()]
            cols = list(b.columns)
            cols[at_lang] = pa.array(
                [y if was is None else was for was, (y, _) in zip(cols[at_lang].to_pylist(), found, strict=True)], pa.string(),
            )
            fine = [y != UNDETERMINED and s >= min_score and (wanted is None or y in wanted) for y, s in found]
            yield pa.RecordBatch.from_arrays(cols, names).filter(pa.array(fine, pa.bool_()))

    return arrow_pass(docs, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))
