"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line with a word is a position of a chain with the states bad (0) and good (1).  Features of
a line are proportions of letters, capitals, digits, marks and separators, lengths and the share of distinct
words; the same features of the neighbouring lines are features too.  Forward-backward gives each
line's marginal of being good; the mean of the marginals, weighted by the words of the lines, is the
document's quality, which a logistic calibration maps to the probability of label 1.

Training takes a bounded sample of the documents labelled in the training fold: of each label, the ``train_docs`` // 2 with the smallest hash
of their id, whole texts up to half of ``train_bytes``.  Texts of more than a 64th of ``train_bytes`` come last, the smallest
first, so that one that does not fit keeps out no other.  Sizes are looked at first, and only the texts chosen are moved.  Each line takes the
label of its document; the transitions' weight is kept within ``TRANSITION`` at every step.  The calibration weighs both labels by their shares
of all labels of the training fold, so that it does not depend on the sample's.  Scores depend on the text alone.

``score`` returns one row per row of the input: ``doc_id, held_out, score, predicted``.  A null or empty
text, or one without words, has the calibrated score of quality 0.  Held out is crc32 of the decimal
doc_id modulo 5 = 0; a null doc_id is not held out and never trains.  Repeated labels and rows count
once; null labels are ignored.  Without usable labels of both kinds every score is 0.5, and a warning is logged.  Further columns are ignored.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidefold.llm import _words as W
from tidefold.llm._shared import own_columns

FOLDS, THRESHOLD = 5, 0.3
TRAIN_DOCS, TRAIN_BYTES, STEPS, TRANSITION = 3000, 24_000_000, 150, 1.0


def _classes() -> np.ndarray:
    """Class of each byte: 0 other, 1 lower-case letter, 2 capital, 3 digit, 4 mark of a sentence, 5 separator or symbol, 6 other mark, 7 space."""
    c = np.zeros(256, np.uint8)
    c[97:123], c[65:91], c[48:58] = 1, 2, 3
    c[[ord(x) for x in ".,;:?!'\"()-"]] = 4
    c[[ord(x) for x in "#*$%&|<>=_~^\\/{}[]+@`"]] = 5
    c[[9, 10, 11, 12, 13, 32]] = 7
    c[0x80:0xC0] = 6  # continuation bytes; the second byte of a two-byte letter is counted below
    return c


_CLASS = _classes()
_N_FEATURES = 14


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, words and text number of each line with a word; for texts as _words.slices gives them."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    part = data[lo:hi]
    if not len(part):
        return np.zeros((0, _N_FEATURES)), np.zeros(0), np.zeros(0, np.int64)
    begins = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0] - lo, np.flatnonzero(part == 10) + 1]))
    begins = begins[begins < len(part)]
    ends = np.append(begins[1:], len(part))
    cls = _CLASS[part]
    # letters of Latin-1: C3 80..9E are capitals, C3 9F..BF are not
    two = np.flatnonzero(part[:-1] == 0xC3) + 1
    cls[two] = np.where(part[two] < 0x9F, 2, 1)
    sums = [np.add.reduceat((cls == k).astype(np.int32), begins) for k in range(8)]
    size = (ends - begins).astype(np.float64)
    h, line = W.words(data, np.append(begins, len(part)) + lo)
    n = np.bincount(line, minlength=len(begins)).astype(np.float64)
    order = np.lexsort((h, line))
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (line[order][1:] != line[order][:-1])
    distinct = np.bincount(line[order][fresh], minlength=len(begins)).astype(np.float64)
    twice = np.bincount(line[1:][(h[1:] == h[:-1]) & (line[1:] == line[:-1])], minlength=len(begins))
    letters = sums[1] + sums[2]
    one, w = np.maximum(size - sums[7], 1), np.maximum(n, 1)
    stop = np.add.reduceat(np.isin(part, np.frombuffer(b".?!", np.uint8)).astype(np.int32), begins)
    x = np.stack(
        [
            np.ones(len(begins)),
            np.log1p(n) / 4,
            np.log1p(size) / 6,
            sums[2] / np.maximum(letters, 1),
            sums[3] / one * 4,
            sums[4] / w,
            np.minimum(sums[5] / w, 2),
            (sums[5] > 0.3 * n).astype(float),
            (sums[2] > 0.6 * letters).astype(float),
            one / w / 8,
            distinct / w,
            np.minimum(twice / w * 4, 1),
            ((distinct < 0.4 * n) & (n >= 8)).astype(float),
            np.minimum(stop / w * 4, 2),
        ],
        axis=1,
    )
    text = np.searchsorted(offsets[1:] - lo, begins, "right")
    keep = n > 0
    return x[keep], n[keep], text[keep]


def with_neighbours(x: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Each line's features with those of the lines before and after it in its text, zeros at the ends."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    same = (text[1:] == text[:-1])[:, None]
    before[1:], after[:-1] = x[:-1] * same, x[1:] * same
    return np.concatenate([x, before, after], axis=1)


def _padded(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chain and step of each line; chains are numbered from the longest, so that those alive at a step are a prefix."""
    _, chain, count = np.unique(text, return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(-count, kind="stable")] = np.arange(len(count))
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    return rank[chain], np.arange(len(text)) - first[chain]


def _log_add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    m = np.maximum(a, b)
    return m + np.log1p(np.exp(-np.abs(a - b)))


def forward_backward(u: np.ndarray, trans: np.ndarray, text: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of state 1 for each line (state 0 has potential 0, state 1 has u), and the expected transitions."""
    if not len(u):
        return np.zeros(0), np.zeros((2, 2))
    chain, step = _padded(text)
    steps = int(step.max()) + 1
    order = np.lexsort((chain, step))
    alive = np.bincount(step, minlength=steps)
    at = np.concatenate([[0], np.cumsum(alive)])
    v = u[order]
    f, b = np.zeros((len(u), 2)), np.zeros((len(u), 2))
    f[: at[1], 1] = v[: at[1]]
    for t in range(1, steps):
        n, i, j = alive[t], at[t], at[t - 1]
        p = f[j : j + n]
        f[i : i + n, 0] = _log_add(p[:, 0] + trans[0, 0], p[:, 1] + trans[1, 0])
        f[i : i + n, 1] = _log_add(p[:, 0] + trans[0, 1], p[:, 1] + trans[1, 1]) + v[i : i + n]
    for t in range(steps - 2, -1, -1):
        n, i, j = alive[t + 1], at[t], at[t + 1]
        q = b[j : j + n]
        s1 = q[:, 1] + v[j : j + n]
        b[i : i + n, 0] = _log_add(trans[0, 0] + q[:, 0], trans[0, 1] + s1)
        b[i : i + n, 1] = _log_add(trans[1, 0] + q[:, 0], trans[1, 1] + s1)
    total = f + b
    marginal = np.empty(len(u))
    marginal[order] = 1 / (1 + np.exp(np.clip(total[:, 0] - total[:, 1], -50, 50)))
    expected = np.zeros((2, 2))
    if pairs:
        z = _log_add(total[:, 0], total[:, 1])
        for t in range(1, steps):
            n, i, j = alive[t], at[t], at[t - 1]
            for s in (0, 1):
                for r in (0, 1):
                    expected[s, r] += np.exp(f[j : j + n, s] + trans[s, r] + (v[i : i + n] if r else 0) + b[i : i + n, r] - z[i : i + n]).sum()
    return marginal, expected


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    trans: np.ndarray
    slope: float
    intercept: float

    def line_marginals(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x, n, text = line_features(data, offsets)
        return forward_backward(with_neighbours(x, text) @ self.weights, self.trans, text)[0], n, text

    def qualities(self, values: pa.Array) -> np.ndarray:
        """The length-weighted marginal of each text; 0 without words."""
        data, offsets = W.column(values)
        out = np.zeros(len(values))
        for i, j in W.slices(offsets):
            m, n, text = self.line_marginals(data, offsets[i : j + 1])
            w = np.bincount(text, n, minlength=j - i)
            out[i:j] = np.bincount(text, m * n, minlength=j - i) / np.maximum(w, 1)
        return out

    def score(self, values: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.qualities(values) + self.intercept, -50, 50)))


def _adam(theta: np.ndarray, grad, steps: int, rate: float, project=lambda x: x) -> np.ndarray:
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        g = grad(theta)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = project(theta + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8))
    return theta


def fit(texts: list[str], labels: list[int], good: float | None = None, steps: int = STEPS) -> Model:
    """A model from whole texts and their labels 0 and 1; deterministic.  ``good``: the share of label 1 that the calibration assumes, by default the sample's."""
    k = 3 * _N_FEATURES
    if len(set(labels)) < 2:
        logging.getLogger("tidefold").warning("the quality classifier lacks texts of both labels: every score is 0.5")
        return Model(np.zeros(k), np.zeros((2, 2)), 0.0, 0.0)
    data, offsets = W.column(pa.array(texts, pa.large_string()))
    found = [(i, line_features(data, offsets[i : j + 1])) for i, j in W.slices(offsets)]
    x = np.concatenate([f[0] for _, f in found])
    n = np.concatenate([f[1] for _, f in found])
    text = np.concatenate([f[2] + i for i, f in found])
    x, y = with_neighbours(x, text), np.asarray(labels)[text].astype(float)
    same = text[1:] == text[:-1]
    seen = np.array([[(same & (y[:-1] == s) & (y[1:] == r)).sum() for r in (0, 1)] for s in (0, 1)], dtype=float)

    def grad(theta: np.ndarray) -> np.ndarray:
        m, expected = forward_backward(x @ theta[:k], theta[k:].reshape(2, 2), text, pairs=True)
        return np.concatenate([x.T @ (y - m), (seen - expected).ravel()]) / len(y) - 1e-4 * theta

    # the transitions' weight is held to evidence between lines, not to that of one label for all lines of a text
    theta = _adam(np.zeros(k + 4), grad, steps, 0.1, lambda x: np.append(x[:k], np.clip(x[k:], -TRANSITION, TRANSITION)))
    trans = theta[k:].reshape(2, 2)
    raw = Model(theta[:k], trans, 1.0, 0.0)
    q, target = raw.qualities(pa.array(texts, pa.large_string())), np.asarray(labels, dtype=float)

    share = target.mean()
    good = share if good is None else good
    weight = np.where(target == 1, good / share, (1 - good) / (1 - share))

    def slope(ab: np.ndarray) -> np.ndarray:
        e = weight * (target - 1 / (1 + np.exp(-np.clip(ab[0] * q + ab[1], -50, 50))))
        return np.array([(e * q).mean(), e.mean()]) - 1e-4 * ab

    a, b = _adam(np.zeros(2), slope, 1500, 0.05)
    return Model(theta[:k], trans, float(a), float(b))


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, train_bytes: int = TRAIN_BYTES) -> Model:
    """Fit on the bounded sample that the module describes."""
    y = own_columns(labels, "doc_id", "quality").where("quality in (0, 1) and doc_id is not null").select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("quality"))
    y = y.where(fold(F.col("id")) != 0).distinct()
    shares = {r["quality"]: r["count"] for r in y.groupBy("quality").count().collect()}
    order = [F.xxhash64("id"), F.col("id")]
    picked = y.where("quality = 0").orderBy(*order).limit(train_docs // 2).unionByName(y.where("quality = 1").orderBy(*order).limit(train_docs // 2))
    d = own_columns(docs, "doc_id", "text").where("text is not null")
    rows = d.join(F.broadcast(picked), d["doc_id"] == picked["id"]).withColumn("h", F.xxhash64("text"))
    # an id may stand on any number of rows: equal texts count once, and of others as many as there may be documents
    sizes = rows.groupBy("id", "quality", "h").agg(F.max(F.octet_length("text")).alias("size"))
    first = [F.greatest("size", F.lit(train_bytes // 64)), F.xxhash64("id"), F.col("id"), F.col("h")]
    sizes = sizes.where("quality = 0").orderBy(*first).limit(train_docs // 2).unionByName(sizes.where("quality = 1").orderBy(*first).limit(train_docs // 2))
    so_far = Window.partitionBy("quality").orderBy(*first).rowsBetween(Window.unboundedPreceding, 0)
    chosen = sizes.withColumn("before", F.sum("size").over(so_far)).where(F.col("before") <= train_bytes // 2).select("id", "quality", "h", "size")
    got = rows.join(F.broadcast(chosen), ["id", "quality", "h"]).groupBy("id", "quality", "h").agg(F.min("text").alias("text")).orderBy("quality", "h", "id").select("text", "quality").toArrow()
    known = sum(shares.values())
    return fit(got["text"].to_pylist(), got["quality"].to_pylist(), shares.get(1, 0) / known if known else None)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
    # broadcasts are pickled by reference to their classes, so only plain values go
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.trans, model.slope, model.intercept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array(own.score(batch.column(1)))], schema=schema)

    d = own_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = d.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))
