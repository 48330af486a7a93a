"""Document quality from weak labels.

Overlapping heuristics vote good, bad or nothing on each document.  Expectation
maximisation over the counts of all vote patterns estimates how often each
heuristic is right about good and about bad documents, with no labels.  The
posteriors of a bounded sample of documents then train a linear scorer over hashed
byte n-grams, which judges every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.llm import textbuf
from cartulary.llm.workspace import lean

NONE, BAD, GOOD = 0, 1, 2
#: Distinct texts, by hash, on which the scorer is fitted, in expectation; twice as many at most.
SAMPLE = 4000
BUCKETS, WORD_BUCKETS = 4096, 1024
THRESHOLD = 0.5
#: What is known of a heuristic beforehand counts as so many votes on good documents for each that it cast, of which this share was wrong.
PRIOR_VOTES, PRIOR_WRONG = 1.0, 0.002

_CLASS = np.zeros(256, np.int64)  # 1 small, 2 capital, 3 digit, 4 symbol, 5 white space, 6 beyond ASCII
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 1, 2, 3
_CLASS[[ord(c) for c in "*$%&#@^~=+<>{}[]\\/_|!"]] = 4
_CLASS[[0x20, 9, 10, 11, 12, 13]] = 5
_CLASS[128:] = 6


def signals(chunk: textbuf.Chunk) -> np.ndarray:
    """A row of measurements for each document: see HEURISTICS."""
    starts, ends, docs = textbuf.spans(chunk)
    hashed = textbuf.hashes(chunk.data, starts, ends)
    same = np.zeros(len(hashed) + 1, np.int64)
    same[2:] = np.cumsum(hashed[1:] == hashed[:-1])
    kinds = _CLASS[chunk.data]
    out = np.zeros((chunk.n, len(HEURISTICS)))
    for i in range(chunk.n):
        a, b = int(chunk.offsets[i]), int(chunk.offsets[i + 1])
        first, last = int(docs[i]), int(docs[i + 1])
        words = last - first
        count = np.bincount(kinds[a:b], minlength=7)
        own = chunk.data[a:b]
        solid = max(1, b - a - int(count[5]))
        row = out[i]
        row[0] = count[4] / solid
        row[1] = count[2] / max(1, count[1] + count[2])
        row[2] = np.count_nonzero(own == 0x7C) / max(1, words)
        row[3] = np.count_nonzero(own == 0x21) / max(1, words)
        row[4] = count[3] / solid
        row[5] = _repeated_lines(chunk.text(i)) if words >= 20 else np.nan
        row[6] = len(np.unique(hashed[first:last])) / words if words >= 50 else np.nan
        row[7] = (same[last] - same[first + 1]) / words if words >= 2 else np.nan
        row[8] = solid / max(1, words) if words else 0
        row[9] = words
    return out


def _repeated_lines(text: bytes) -> float:
    """The share of a text's bytes in lines that stand in it before."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return 1 - sum(map(len, set(lines))) / max(1, sum(map(len, lines)))


#: What is measured, and where it speaks for a bad and for a good document; between, and where nothing was measured, there is no vote.
HEURISTICS = {
    "symbols": (lambda x: x > 0.10, lambda x: x < 0.04),
    "capitals": (lambda x: x > 0.40, lambda x: x < 0.15),
    "bars": (lambda x: x > 0.15, lambda x: x < 0.05),
    "exclamations": (lambda x: x > 0.15, lambda x: x < 0.03),
    "digits": (lambda x: x > 0.30, lambda x: x < 0.10),
    "repeated lines": (lambda x: x > 0.30, lambda x: x < 0.10),
    "vocabulary": (lambda x: x < 0.10, lambda x: x > 0.25),
    "adjacent repeats": (lambda x: x > 0.20, lambda x: x < 0.03),
    "word length": (lambda x: (x < 2) | (x > 20), lambda x: (x > 3) & (x < 14)),
    "words": (lambda x: x < 1, lambda x: x >= 20),
}


def patterns(measured: np.ndarray) -> np.ndarray:
    """The votes on each document as one number of base 3."""
    out = np.zeros(len(measured), np.int64)
    for k, (bad, good) in enumerate(HEURISTICS.values()):
        out = out * 3 + np.where(bad(measured[:, k]), BAD, np.where(good(measured[:, k]), GOOD, NONE))
    return out


def votes(pattern: np.ndarray) -> np.ndarray:
    k = len(HEURISTICS)
    return pattern[:, None] // 3 ** np.arange(k - 1, -1, -1) % 3


class LabelModel:
    """Accuracies of the heuristics, given only how often each pattern of votes occurs."""

    def __init__(self, pattern: np.ndarray, n: np.ndarray, rounds: int = 50):
        vote = votes(pattern)
        k = vote.shape[1]
        # Of the votes that a heuristic casts, how many are bad ones.  It starts as precise: it seldom speaks against a good document, and sees some of the bad ones.
        self.prior = 0.8
        self.bad = np.array([[0.3] * k, [0.01] * k])
        for _ in range(rounds if len(pattern) else 0):
            good = self._posterior(vote) * n
            self.prior = float((good.sum() + 1) / (n.sum() + 2))
            for y, weight, known, wrong in ((0, n - good, 0.0, 0.5), (1, good, PRIOR_VOTES, PRIOR_WRONG)):
                cast = ((vote != NONE) * weight[:, None]).sum(axis=0)
                # Two more votes keep the estimate off 0 and 1.
                self.bad[y] = (((vote == BAD) * weight[:, None]).sum(axis=0) + known * wrong * cast + 2 * wrong) / (cast + known * cast + 2)

    def _posterior(self, vote: np.ndarray) -> np.ndarray:
        against = np.log(self.bad[1] / self.bad[0])
        in_favour = np.log((1 - self.bad[1]) / (1 - self.bad[0]))
        odds = np.log(self.prior / (1 - self.prior)) + (vote == BAD) @ against + (vote == GOOD) @ in_favour
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))

    def posterior(self, pattern: np.ndarray) -> np.ndarray:
        return self._posterior(votes(pattern))


def features(chunk: textbuf.Chunk) -> np.ndarray:
    """For each document the roots of the shares of its hashed byte trigrams, and of its words by shape and by how often they stand in it, hashed as well; each of length 1."""
    d = chunk.data.astype(np.uint32)
    hashed = np.zeros(len(d), np.uint32)
    if len(d) > 2:
        hashed[:-2] = (d[:-2] * np.uint32(0x9E3779B1) ^ d[1:-1] * np.uint32(0x85EBCA77) ^ d[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(20)
    starts, ends, docs = textbuf.spans(chunk)
    words = textbuf.hashes(chunk.data, starts, ends)
    shape = np.minimum(ends - starts, 31) * 49 + _CLASS[chunk.data[starts]] * 7 + _CLASS[chunk.data[ends - 1]]
    out = np.zeros((chunk.n, BUCKETS + WORD_BUCKETS), np.float32)
    for i in range(chunk.n):
        a, b = int(chunk.offsets[i]), int(chunk.offsets[i + 1])
        if b - a > 2:
            out[i, :BUCKETS] = np.sqrt(np.bincount(hashed[a : b - 2], minlength=BUCKETS) / (b - a - 2))
        first, last = int(docs[i]), int(docs[i + 1])
        if last > first:
            _, back, n = np.unique(words[first:last], return_inverse=True, return_counts=True)
            # How often in steps of a factor of two, against how often a word of a text of this length may well stand in it.
            often = np.minimum(np.log2(n * (64.0 / (last - first + 64)) + 1).astype(np.int64), 7)[back]
            alike = np.concatenate([[False], back[1:] == back[:-1]])
            kind = (shape[first:last] * 8 + often) * 2 + alike
            kind = (kind.astype(np.uint32) * np.uint32(0x9E3779B1)) >> np.uint32(32 - WORD_BUCKETS.bit_length() + 1)
            out[i, BUCKETS:] = np.sqrt(np.bincount(kind, minlength=WORD_BUCKETS) / (last - first))
    return out


def fit_scorer(x: np.ndarray, p: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Weights of a logistic scorer (the bias last) for posteriors p.  x stays in single precision and is not copied."""
    w, m, v, g = (np.zeros(x.shape[1] + 1) for _ in range(4))
    w[-1] = 1e-6
    for t in range(1, rounds + 1 if len(p) else 1):
        off = 1 / (1 + np.exp(-np.clip(x @ w[:-1].astype(np.float32) + w[-1], -50, 50))) - p
        g[:-1], g[-1] = off.astype(np.float32) @ x, off.sum()
        g = g / len(p) + 1e-5 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _measured(docs: DataFrame) -> DataFrame:
    @textbuf.frugal
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for batch in batches:
            for chunk in textbuf.chunks(batch.column(0)):
                for k, n in zip(*np.unique(patterns(signals(chunk)), return_counts=True)):
                    total[int(k)] = total.get(int(k), 0) + int(n)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["pattern", "n"])

    return docs.select("text").mapInArrow(scan, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, sample: int = SAMPLE) -> tuple[LabelModel, np.ndarray]:
    """The label model of all documents, and the weights of the scorer."""
    # At most 3 to the number of heuristics patterns, whatever the number of documents.
    seen = sorted(map(tuple, _measured(docs).collect()))
    pattern, n = np.array([r[0] for r in seen], np.int64), np.array([r[1] for r in seen], np.float64)
    model = LabelModel(pattern, n)
    rate = min(1.0, sample / max(1.0, n.sum()))
    chosen = docs.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(np.ceil(rate * (1 << 20)))).select("text").distinct()

    @textbuf.frugal
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in textbuf.chunks(batch.column(0)):
                pattern = patterns(signals(chunk))
                x = features(chunk).astype(np.float16)
                yield pa.RecordBatch.from_arrays([pa.array(pattern), pa.array([r.tobytes() for r in x], pa.binary())], ["pattern", "x"])

    @textbuf.frugal
    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, parts = [np.empty(0, np.int64)], [np.empty((0, BUCKETS + WORD_BUCKETS), np.float32)]
        for batch in batches:
            seen.append(batch.column(0).to_numpy())
            parts.append(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float16).reshape(batch.num_rows, -1).astype(np.float32))
        weights = fit_scorer(np.concatenate(parts), model.posterior(np.concatenate(seen)))
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary())], ["weights"])

    # The sample is bounded, so one task can fit it; only the weights come to the driver.  In one order, so that the sums are the same each time.
    measured = chosen.mapInArrow(scan, "pattern long, x binary").orderBy(F.xxhash64("x"), "x").limit(2 * sample)
    return model, np.frombuffer(bytes(measured.mapInArrow(fit, "weights binary").collect()[0][0]))


def judge(docs: DataFrame, *, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of docs with posterior (of the label model), quality (of the scorer) and keep.

    Null counts as an empty text.  A text without words is rejected; all others are
    judged by the scorer, whole.  Rows with equal texts get equal values; an empty
    table gives no rows.  Columns of docs named like the new ones are replaced.
    """
    docs = lean(docs)
    model, weights = train(docs, sample)
    extra = ("posterior", "quality", "keep")
    base = docs.select([c for c in docs.columns if c not in extra])
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields] + ["posterior double", "quality double", "keep boolean"])
    names = base.columns
    at = names.index("text")

    @textbuf.frugal
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in textbuf.chunks(batch.column(at)):
                measured = signals(chunk)
                pattern = patterns(measured)
                quality = 1 / (1 + np.exp(-np.clip(features(chunk) @ weights[:-1] + weights[-1], -50, 50)))
                quality = np.where(measured[:, -1] > 0, quality, 0.0)
                part = batch.slice(chunk.first, chunk.n)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.posterior(pattern)), pa.array(quality), pa.array(quality >= threshold)], [*names, *extra])

    return base.mapInArrow(score, schema)
