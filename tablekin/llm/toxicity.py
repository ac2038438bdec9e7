"""Toxicity by a gap-weighted subsequence kernel and a support vector machine on Nyström landmarks.

Sentences. Every text is cut into sentences and a sentence is a string of letter codes: case is folded, punctuation
inside words is dropped, blanks are one code, and blanks between single letters go (`i d i o t`). No subsequence runs
over the end of a sentence. What the machine judges are a sentence's stretches: one begins at each word and holds the
subsequences that start among its first WIDTH codes, wherever in the sentence they end.

Kernel. Two stretches share weight for every subsequence of ORDER codes they have in common. Codes may be skipped
between any two of them, at a discount of DECAY each, which makes `idxiot`, `idxiqot`, `i-diot` and `idi ot` resemble
the plain word. (Weights below DECAY ** (GAP + 1) are dropped.) A blank is a code like any other, so word ends count.

Training. A labelled document lends its label to its sentences, and multiple-instance rounds find the stretches that
earn it: first those that begin with a run of codes known from toxic documents and all but absent from clean ones, then
those that the machine of the last round finds worst, each also with letters put in at random. Clean sentences give
random stretches and, in each round, the ones the machine finds worst. Landmarks are stretches of both kinds; the
kernel to them, whitened by their own kernel matrix, is the feature map of a linear machine with squared hinge loss.
The machine is linear in the kernel and folds into one weight per subsequence, so a text is scored by table lookups.
A document's probability is fitted on its three worst words' stretches.

Defined cases: a null text counts as empty; an empty text has a low, fixed score; a very long text is judged whole;
repeated rows and equal texts get equal scores; with labels of one class only, or none, every score is that share
(0 without labels); an empty table gives an empty result; further columns are ignored, or kept where rows are filtered.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE, arrow_map, give_back, held_out, map_batches, table, training_rows

#: Bound of the labelled sample: at most so many clean and so many toxic documents, in hash order.
PER_CLASS = (3000, 2000)
#: A document is rejected from this probability on.
REJECT = 0.5
ORDER, GAP, DECAY, WIDTH = 4, 4, 0.5, 10
#: Stretches that a round of training takes of toxic documents and adds of clean ones, and the landmarks.
BAD, GOOD, LANDMARKS, ROUNDS = 3000, 3000, 320, 4
LEAST = 50  # a telling run is in one of so many toxic documents at least, and in three
CODES, BLANK, STOP, DROP = 32, 1, 254, 255
#: Codes between two sentences, which no subsequence and no stretch gets over.
APART = max(WIDTH, GAP + 1) + 1
LONGEST = WIDTH + ORDER + GAP
TOP, LOW = 3, -3.0  # words a document is judged by, and the margin in place of those a short text doesn't have


def _codes() -> np.ndarray:
    """A code for each character: a to z, four codes for all other letters and digits, blank, and two marks."""
    out = np.full(0x110000, DROP, np.uint8)
    for k in range(0x3000):
        low = chr(k).lower()
        if low.isspace():
            out[k] = BLANK
        elif low.isalnum():
            out[k] = ord(low) - 95 if "a" <= low <= "z" else 28 + ord(low[0]) % 4
    out[0x3000:] = 28 + np.arange(0x3000, 0x110000) % 4
    out[[ord(c) for c in ".!?\n"]] = STOP
    return out


_CODE = _codes()
#: Codes skipped after the first, second, ... code of a subsequence.
GAPS = [g for g in itertools.product(range(GAP + 1), repeat=ORDER - 1) if sum(g) <= GAP]


def sentences(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The codes of all texts, sentences kept apart by zeros; where each word starts (at the blank before it); its text's number."""
    joined = "\n".join([*texts, ""])
    raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = _CODE[raw]
    ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
    after = np.append(codes[1:], BLANK)
    codes[(codes == STOP) & (raw != 10) & (after != BLANK) & (after != STOP)] = DROP  # a point inside a word
    at = np.flatnonzero(codes != DROP)
    codes = codes[at]
    for _ in range(2):  # blanks next to others, then blanks between single letters
        empty = codes == BLANK
        edge = np.concatenate([[True, True], empty | (codes == STOP), [True, True]])
        n = len(codes)
        gone = empty & (edge[1 : n + 1] if _ == 0 else edge[:n] & ~edge[1 : n + 1] & ~edge[3 : n + 3] & edge[4 : n + 4])
        at, codes = at[~gone], codes[~gone]
    stop = codes == STOP
    codes[stop] = 0
    many = np.where(stop, APART, 1)
    place = np.concatenate([[0], np.cumsum(many)])
    out = np.concatenate([np.zeros(APART, np.uint8), np.repeat(codes, many)])
    first = np.flatnonzero((out[:-1] == 0) & (out[1:] > BLANK))
    out[first] = BLANK
    starts = np.flatnonzero((out[:-1] == BLANK) & (out[1:] > BLANK))
    last = place[np.searchsorted(at, ends)] + APART  # where each text ends among the codes
    return out, starts, np.searchsorted(last, starts + 1, side="right")


def gathered(texts: list[str], at_a_time: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """sentences() of many texts, a few at a time, which bounds what is held besides the codes."""
    codes, starts, text, size = [], [], [], 0
    for k in range(0, len(texts), at_a_time):
        c, s, t = sentences(texts[k : k + at_a_time])
        codes.append(c)
        starts.append(s + size)
        text.append((t + k).astype(np.int32))
        size += len(c)
    return np.concatenate(codes), np.concatenate(starts), np.concatenate(text)


def margins(codes: np.ndarray, starts: np.ndarray, weights: np.ndarray, block: int = 1 << 15) -> np.ndarray:
    """The sum of the weights of all subsequences of each stretch; starts ascend."""
    out = np.zeros(len(starts), np.float32)
    padded = np.concatenate([codes, np.zeros(LONGEST + WIDTH, np.uint8)])
    for k in range(0, len(codes), block):
        first, last = np.searchsorted(starts, (k, k + block))
        if first == last:
            continue
        x = padded[k : k + block + WIDTH + LONGEST].astype(np.int32)
        n = min(block, len(codes) - k) + WIDTH
        pairs = [x[: len(x) - 1 - g] * CODES + x[1 + g :] for g in range(GAP + 1)]
        by_gap = np.zeros((GAP + 1, n), np.float32)
        for a, b, c in GAPS:
            by_gap[a + b + c] += weights.take(pairs[a][:n] * CODES**2 + pairs[c][2 + a + b : 2 + a + b + n])
        total = np.zeros(n + 1)
        np.cumsum((by_gap * DECAY ** np.arange(GAP + 1, dtype=np.float32)[:, None]).sum(axis=0), out=total[1:])
        here = starts[first:last] - k
        out[first:last] = total[here + WIDTH] - total[here]
    return out


def stretches(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The codes of each stretch, one a row, with zeros behind the end of the sentence."""
    padded = np.concatenate([codes, np.zeros(LONGEST, np.uint8)])
    out = np.empty((len(starts), LONGEST), np.uint8)
    ended = np.zeros(len(starts), bool)
    for k in range(LONGEST):
        out[:, k] = padded[starts + k]
        ended |= out[:, k] == 0
        out[ended, k] = 0
    return out


def subsequences(rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each way to skip codes: the row and the number of each subsequence, and their weight."""
    x = np.concatenate([rows, np.zeros((len(rows), ORDER), np.uint8)], axis=1).astype(np.int32)
    for gaps in GAPS:
        number, whole, at = np.zeros((len(rows), WIDTH), np.int32), np.ones((len(rows), WIDTH), bool), 0
        for skip in (*gaps, 0):
            number = number * CODES + x[:, at : at + WIDTH]
            whole &= x[:, at : at + WIDTH] > 0
            at += 1 + skip
        row, _ = np.nonzero(whole)
        yield row, number[whole], DECAY ** sum(gaps)


class Landmarks:
    def __init__(self, rows: np.ndarray):
        found = list(subsequences(rows))
        self.known, column = np.unique(np.concatenate([n for _, n, _ in found]), return_inverse=True)
        self.table = np.zeros((len(self.known), len(rows)), np.float32)
        np.add.at(self.table, (column, np.concatenate([r for r, _, _ in found])), np.concatenate([np.full(len(r), w, np.float32) for r, _, w in found]))
        self.table /= np.sqrt(np.maximum(np.einsum("ij,ij->j", self.table, self.table), 1e-6))  # stretches of any length weigh the same
        gram = self.table.T @ self.table
        values, vectors = np.linalg.eigh(gram.astype(float))
        keep = values > 1e-4 * values[-1]
        self.whiten = (vectors[:, keep] / np.sqrt(values[keep])).astype(np.float32)

    def features(self, rows: np.ndarray) -> np.ndarray:
        """The Nyström features of stretches and a 1, one row each."""
        out = np.ones((len(rows), self.whiten.shape[1] + 1), np.float32)
        for k in range(0, len(rows), 64):
            found = []
            for row, number, weight in subsequences(rows[k : k + 64]):
                at = np.minimum(np.searchsorted(self.known, number), len(self.known) - 1)
                hit = self.known[at] == number
                found.append((row[hit], at[hit], np.full(hit.sum(), weight, np.float32)))
            row, at, weight = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(row, kind="stable")
            row, at, weight = row[order], at[order], weight[order]
            value = np.zeros((min(64, len(rows) - k), self.table.shape[1]), np.float32)
            ends = np.searchsorted(row, np.arange(len(value) + 1))
            for j, (first, last) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                value[j] = weight[first:last] @ self.table[at[first:last]]
            out[k : k + 64, :-1] = value @ self.whiten
        return out

    def folded(self, w: np.ndarray) -> np.ndarray:
        """The machine's weight for each subsequence there can be."""
        out = np.zeros(CODES**ORDER, np.float32)
        out[self.known] = self.table @ (self.whiten @ w[:-1].astype(np.float32))
        return out


@dataclass
class Model:
    weights: np.ndarray  # for each subsequence, by number
    bias: float
    link: np.ndarray  # of the worst margins and 1
    share: float | None = None  # the constant score if there was nothing to learn from

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.share is not None:
            return np.full(len(texts), self.share)
        codes, starts, text = sentences([t or "" for t in texts])
        x = worst(margins(codes, starts, self.weights) + self.bias, text, len(texts))
        return 1 / (1 + np.exp(-np.clip(x @ self.link, -30, 30)))


def worst(margin: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """The TOP largest margins of each text, falling, and a 1."""
    out = np.concatenate([np.full((n, TOP), LOW), np.ones((n, 1))], axis=1)
    order = np.lexsort((-margin, text))
    text = text[order]
    begin = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]])) if len(text) else text
    rank = np.arange(len(text)) - np.repeat(begin, np.diff([*begin, len(text)]))
    top = rank < TOP
    out[text[top], rank[top]] = np.clip(margin[order][top], LOW, -LOW)
    return out


def _machine(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Linear machine with squared hinge loss by Newton steps; the last column of x is 1."""
    w = np.zeros(x.shape[1])
    for _ in range(25):
        slack = 1 - y * (x @ w)
        grad, curve = ridge * w, ridge * np.eye(len(w))
        for k in range(0, len(x), 2048):  # a few rows at a time, to hold no second copy
            rows = k + np.flatnonzero(slack[k : k + 2048] > 0)
            xs = x[rows].astype(np.float64)
            grad -= xs.T @ (cost[rows] * y[rows] * slack[rows])
            curve += (xs * cost[rows][:, None]).T @ xs
        step = np.linalg.solve(curve, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def telling(codes: np.ndarray, starts: np.ndarray, toxic: np.ndarray, text: np.ndarray) -> np.ndarray:
    """How telling the run of codes is that each toxic document's stretch begins with, over runs of ORDER to WIDTH codes: their log odds,
    weighted by how many toxic documents hold them. Runs that clean documents hold more than once in 50 count nothing,
    nor do rare ones, which are there by chance."""
    best = np.zeros(len(starts), np.float32)
    rows = stretches(codes, starts)
    bad = toxic[text]
    number = np.zeros(len(starts), np.uint64)
    n = np.maximum([(~toxic).sum(), toxic.sum()], 1)
    least = max(3, n[1] // LEAST)

    def documents(at: np.ndarray, run: np.ndarray, runs: int) -> np.ndarray:
        """How many documents hold each run, given which run each of these stretches begins with."""
        return np.bincount(np.unique(text[at].astype(np.int64) * runs + run) % runs, minlength=runs)

    for length in range(1, WIDTH + 1):
        number = number * np.uint64(CODES) + rows[:, length - 1].astype(np.uint64)
        if length < ORDER:
            continue
        whole = rows[:, length - 1] > 0
        at = np.flatnonzero(whole & bad)
        runs, run = np.unique(number[at], return_inverse=True)
        if not len(runs):
            continue
        often = documents(at, run, len(runs)) >= least
        at, runs = at[often[run]], runs[often]
        if not len(runs):
            continue
        run, other = np.searchsorted(runs, number[at]), np.flatnonzero(whole & ~bad)
        place = np.minimum(np.searchsorted(runs, number[other]), len(runs) - 1)
        same = runs[place] == number[other]
        df = [documents(other[same], place[same], len(runs)), documents(at, run, len(runs))]
        odds = np.log((df[1] + 0.5) / (n[1] + 1)) - np.log((df[0] + 0.5) / (n[0] + 1))
        value = np.where(df[0] * 50 <= df[1], odds * np.sqrt(df[1]), 0).astype(np.float32)
        best[at] = np.maximum(best[at], value[run])
    return best


def disguised(rows: np.ndarray, letters: int, rng: np.random.Generator) -> np.ndarray:
    """The stretches with so many letters put in among their first, as people write to slip past a filter."""
    out = rows.copy()
    for _ in range(letters):
        at = rng.integers(2, 6, len(out))[:, None]
        k = np.arange(out.shape[1])[None, :]
        moved = np.take_along_axis(out, np.where(k > at, k - 1, k), axis=1)
        out = np.where((k == at) & (moved > 0), rng.integers(2, 28, len(out))[:, None], moved).astype(np.uint8)
    return out


def train(texts: list[str], labels: list[int], toxic_share: float | None = None) -> Model:
    """toxic_share: how many of all labelled documents are toxic, where the sample holds another share of them."""
    y = np.array(labels, int)
    none = np.zeros(1, np.float32)
    if len(set(labels)) < 2:
        return Model(none, 0.0, np.zeros(TOP + 1), float(y.mean()) if len(y) else 0.0)
    rng = np.random.default_rng(10)
    codes, starts, text = gathered(texts)
    apart = np.arange(len(y)) % 8 == 4  # these documents' sentences stay out of the rounds and fit the probability
    if len(set(y[apart])) < 2 or len(set(y[~apart])) < 2:
        apart[:] = False
    learnt = ~apart[text]
    toxic, clean = learnt & (y[text] == 1), np.flatnonzero(learnt & (y[text] == 0))
    margin, bias = telling(codes, starts[learnt], y == 1, text[learnt]), 0.0
    margin = np.bincount(np.flatnonzero(learnt), margin, minlength=len(starts))
    chosen = np.flatnonzero(toxic & (margin > 0))
    if not len(chosen):  # no run of codes tells anything: each toxic document's first stretches will do
        chosen = np.unique(text, return_index=True)[1]
        chosen = chosen[toxic[chosen]]
    if not len(chosen) or not len(clean):
        return Model(none, 0.0, np.zeros(TOP + 1), float(y.mean()))
    good = rng.choice(clean, min(len(clean), GOOD), replace=False)
    weights = none
    for turn in range(ROUNDS):
        if turn:
            order = np.lexsort((-margin, text))
            order = order[toxic[order]]
            best = order[np.concatenate([[True], text[order][1:] != text[order][:-1]])]  # each toxic document's worst stretch
            chosen = np.unique(np.concatenate([chosen[margin[chosen] > -0.5], best, np.flatnonzero(toxic & (margin > 0.5))]))
            hard = clean[np.argsort(-margin[clean], kind="stable")[:GOOD]]
            good = np.union1d(good, hard)
        bad = stretches(codes, starts[chosen if len(chosen) <= BAD else np.sort(rng.choice(chosen, BAD, replace=False))])
        fine = stretches(codes, starts[good])
        rows = np.unique(np.concatenate([bad, *(disguised(bad, k, rng) for k in (1, 2, 2))]), axis=0)
        n_bad = len(rows)
        of_bad = bad[rng.choice(len(bad), min(len(bad), LANDMARKS * 3 // 4), replace=False)]
        of_fine = fine[rng.choice(len(fine), min(len(fine), LANDMARKS - len(of_bad)), replace=False)]
        marks = None  # the last round's table goes before the next is made
        marks = Landmarks(np.concatenate([of_bad, of_fine]))
        rows = np.concatenate([rows, np.unique(fine, axis=0)])
        target = np.where(np.arange(len(rows)) < n_bad, 1.0, -1.0)
        w = _machine(marks.features(rows), target, np.where(target > 0, 500 / n_bad, 500 / (len(rows) - n_bad)))
        weights, bias = marks.folded(w), float(w[-1])
        margin = margins(codes, starts, weights) + np.float32(bias)
    fit = apart if apart.any() else ~apart
    share = y[fit].mean()
    of_all = share if toxic_share is None else min(max(toxic_share, 1e-3), 1 - 1e-3)
    cost = np.where(y[fit] > 0, of_all / share, (1 - of_all) / (1 - share))
    return Model(weights, bias, _link(worst(margin, text, len(texts))[fit], y[fit].astype(float), cost))


def _link(x: np.ndarray, y: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Logistic weights of the worst margins; no word may speak for a text, so weights below 0 are left out."""
    used = list(range(x.shape[1]))
    while True:
        link = np.zeros(x.shape[1])
        link[used] = _logistic(x[:, used], y, cost)
        low = [k for k in used[:-1] if link[k] < 0]
        if not low:
            return link
        used.remove(min(low, key=lambda k: link[k]))


def _logistic(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (cost * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (cost * (p - y)) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fitted(spark: SparkSession, documents: DataFrame, labels: DataFrame, per_class: tuple[int, int] = PER_CLASS) -> Model:
    texts, y, sizes = training_rows(spark, documents, labels, "toxic", per_class)
    model = train(texts, y, sizes[1] / max(sum(sizes), 1))
    give_back()
    return model


def toxicity(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every document, by a model sent to the executors once (of fixed size)."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def of(ids: list, texts: list) -> dict:
        return {"doc_id": ids, "score": shared.value.scores(texts).tolist()}

    return map_batches(documents.select("doc_id", "text"), of, "doc_id long, score double", rows=SLICE // 4)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    scores = toxicity(documents, fitted(spark, documents, table(spark, sf_dir, "labels")))
    return scores.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted"))


def without_toxic(documents: DataFrame, model: Model, reject: float = REJECT) -> DataFrame:
    """The documents that score below reject, with all their columns."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE // 4):
                part = batch.slice(k, SLICE // 4)
                yield part.filter(pa.array(shared.value.scores(part.column(at).to_pylist()) < reject))

    return arrow_map(documents, run, documents.schema)
