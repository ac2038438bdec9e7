"""Quality classifier: random-indexing word vectors, pooled per document, under a small calibrated network.

Every term owns a sparse random index vector, by a hash of its name into TERMS rows (terms that share a row share their
vector; in a mean over a document's words that is noise like the random vectors' own). Over all training texts each term
collects the index vectors of its neighbours; its word vector is its own index vector plus the scaled
collection. A word stands for up to three terms: its letters, its shape (how it is cased and what it is made of) and
its punctuation. Shapes and punctuation are pooled apart from letters, so that the network sees how a text is written
as well as what it is about. A document is the mean of its words' vectors with the shares of repeated words and lines.
A network with one hidden layer, in numpy, scores it, and a temperature fitted on part of the training rows makes its
output a probability.

Defined cases: a null text counts as empty and gets the score of an all-zero vector; a very long text is pooled whole;
repeated rows and equal texts get equal scores; with labels of one class only, or none, every score is that share
(1 without labels, so that nothing is thrown away); an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, map_batches, table, training_rows

#: Bound of the labelled sample: at most so many documents of class 0 and of class 1, in hash order.
PER_CLASS = (3000, 3000)
#: A document is of good quality from this probability on.
GOOD = 0.3
DIMS, NONZERO, TERMS, HIDDEN = 64, 6, 1 << 15, 32
CACHE = 100_000
_LETTERS = re.compile(r"[^\W\d_]+")


def row_of(term: str) -> int:
    return zlib.crc32(term.encode("utf-8", "surrogatepass")) & (TERMS - 1)


def index_vectors() -> np.ndarray:
    """The index vector of each term row: NONZERO entries of +1 or -1."""
    rng = np.random.default_rng(20)
    out = np.zeros((TERMS, DIMS), np.float32)
    rows = np.repeat(np.arange(TERMS), NONZERO)
    np.add.at(out, (rows, rng.integers(0, DIMS, len(rows))), rng.choice(np.array([-1, 1], np.float32), len(rows)))
    return out


def shape_of(word: str) -> str:
    letters = "".join(_LETTERS.findall(word))
    case = "none" if not letters else "upper" if letters.isupper() and len(letters) > 1 else "lower" if letters.islower() else "title" if letters.istitle() else "mixed"
    return f"shape:{case}:{'digit' if any(c.isdigit() for c in word) else ''}:{min(len(word), 24) // 4}"


def terms_of(word: str) -> tuple[int, int, int]:
    """Term rows of a word's letters, shape and punctuation."""
    letters = "".join(_LETTERS.findall(word)).lower()
    marks = re.sub(r"[\w]+", "_", word)
    return row_of("word:" + letters), row_of(shape_of(word)), row_of("marks:" + marks)


@dataclass
class Model:
    vectors: np.ndarray
    layers: list[np.ndarray]
    temperature: float
    share: float | None = None

    def probability(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        z = (np.tanh(x @ w1 + b1) @ w2 + b2) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Pooler:
    """Documents as vectors; the term rows of words met before are kept, up to CACHE words."""

    def __init__(self, vectors: np.ndarray):
        self.vectors, self.known = vectors, {}

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), 2 * DIMS + 4), np.float32)
        if len(self.known) > CACHE:
            self.known.clear()
        known = self.known
        for k, text in enumerate(texts):
            words = (text or "").split()
            if not words:
                continue
            counts = Counter(words)
            rows = np.array([known.get(w) or known.setdefault(w, terms_of(w)) for w in counts])
            n = np.fromiter(counts.values(), np.float32, len(counts))
            out[k, :DIMS] = n @ self.vectors[rows[:, 0]] / len(words)
            out[k, DIMS : 2 * DIMS] = (n @ self.vectors[rows[:, 1]] + n @ self.vectors[rows[:, 2]]) / len(words)
            lines = [x for x in (text or "").split("\n") if x.strip()]
            out[k, 2 * DIMS :] = 1, len(counts) / len(words), 1 - len(set(lines)) / max(len(lines), 1), np.log1p(len(words)) / 10
        return out


def word_vectors(texts: list[str], reach: int = 2) -> np.ndarray:
    """Random indexing over the texts: own index vector plus the scaled sum of the neighbours' ones."""
    index = index_vectors()
    context, known = np.zeros_like(index), {}
    for first in range(0, len(texts), 500):
        words = [t.split() for t in texts[first : first + 500]]
        rows = np.array([known.get(w) or known.setdefault(w, terms_of(w)) for ws in words for w in ws], np.int64).reshape(-1, 3)
        text = np.repeat(np.arange(len(words)), [len(ws) for ws in words])
        for d in range(1, reach + 1):
            near = text[d:] == text[:-d]
            for kind in range(3):
                pair, times = np.unique(rows[:-d, kind][near] * TERMS + rows[d:, kind][near], return_counts=True)
                left, right, n = pair // TERMS, pair % TERMS, times.astype(np.float32)[:, None]
                np.add.at(context, left, index[right] * n)
                np.add.at(context, right, index[left] * n)
    length = np.linalg.norm(context, axis=1, keepdims=True)
    return index + np.divide(context, length, out=np.zeros_like(context), where=length > 0)


def train(texts: list[str], labels: list[int], epochs: int = 100) -> Model:
    y = np.array(labels, np.float64)
    if len(set(labels)) < 2:
        return Model(np.zeros((1, 1), np.float32), [], 1.0, float(y.mean()) if len(y) else 1.0)
    vectors = word_vectors(texts)
    x = Pooler(vectors)(texts).astype(np.float64)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    x = (x - mean) / scale
    fold = np.arange(len(y)) % 5 == 0  # for the temperature
    rng = np.random.default_rng(8)
    p = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
    a, b, step = x[~fold], y[~fold], 0
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(a)), max(1, len(a) // 256)):
            h = np.tanh(a[part] @ p[0] + p[1])
            out = 1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30)))
            d = (out - b[part]) / len(part)
            back = d[:, None] * p[2] * (1 - h * h)
            grads = [a[part].T @ back + 1e-3 * p[0], back.sum(0), h.T @ d + 1e-3 * p[2], np.array([d.sum()])]
            step += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - 3e-3 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    z = np.tanh(x[fold] @ p[0] + p[1]) @ p[2] + p[3]
    loss = lambda t: np.logaddexp(0, np.where(y[fold] > 0, -z, z) / t).mean()
    temperature = min(np.geomspace(0.25, 8, 61), key=loss)
    layers = [p[0] / scale[:, None], p[1] - (mean / scale) @ p[0], p[2], p[3]]
    return Model(vectors, layers, float(temperature))


def fitted(spark: SparkSession, documents: DataFrame, labels: DataFrame, per_class: tuple[int, int] = PER_CLASS) -> Model:
    texts, y, _ = training_rows(spark, documents, labels, "quality", per_class)
    return train(texts, y)


class Scorer:
    def __init__(self, model: Model):
        self.model, self.pool = model, Pooler(model.vectors)

    def __call__(self, texts: list[str | None]) -> list[float]:
        if self.model.share is not None:
            return [self.model.share] * len(texts)
        return self.model.probability(self.pool(texts).astype(np.float64)).tolist()


def quality(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every document, by a model sent to the executors once (of fixed size)."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    own: list[Scorer] = []

    def of(ids: list, texts: list) -> dict:
        if not own:
            own.append(Scorer(shared.value))
        return {"doc_id": ids, "score": own[0](texts)}

    return map_batches(documents.select("doc_id", "text"), of, "doc_id long, score double")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    scores = quality(documents, fitted(spark, documents, table(spark, sf_dir, "labels")))
    return scores.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))
