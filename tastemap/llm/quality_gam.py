"""Quality classifier: a generalised additive model with pairwise interactions.

Features are measured on whole texts in Arrow batches.  Each feature is cut into
at most ``BINS`` quantile bins.  Training is cyclic boosting: in every round each
feature in turn fits a shallow tree (a few leaves over its bins) to the current
logistic gradient and adds a damped step to that feature's lookup table; then the
pairs of features that explain most of the remaining gradient are boosted in the
same way over coarse two-way grids.  A score is the sigmoid of an intercept plus
one table entry per feature and per pair: vectorised additions, no trees left.

Training uses a bounded sample: at most ``MAX_TRAIN`` labelled rows, the ones
with the smallest hash of doc_id.  The scoring pass reads every whole text.

Defined results: null and empty texts get the features of an empty text and a
score; a corpus with no labelled training row scores 0.5 everywhere (one class
only: that class's smoothed rate); labels that are null are ignored and several
labels of one document count as their rounded mean; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean
from .textnum import Slice, byte_table, repeated, slices, text_buffer

MAX_TRAIN = 20_000
BINS = 32
PAIR_BINS = 8
ROUNDS = 200
PAIR_ROUNDS = 60
PAIRS = 6
RATE = 0.15
LEAVES = 3

_SYMBOL = byte_table("#*$%&|<>{}[]\\^~=+_@")
_MARK = byte_table("!?;:\"'()-")
_STOP = byte_table(".,")
_DIGIT = byte_table("0123456789")
_UPPER = byte_table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LOWER = byte_table("abcdefghijklmnopqrstuvwxyz")

FEATURES = ["log_words", "word_length", "word_length_spread", "symbol_rate", "mark_rate", "stop_rate",
            "digit_rate", "upper_rate", "lone_symbol_rate", "word_end_symbol_rate",
            "repeated_word_rate", "repeated_pair_rate", "line_words", "white_rate", "short_rate",
            "long_rate"]


def features_of(s: Slice) -> np.ndarray:
    """(documents, features) of a slice."""
    words = np.maximum(s.n_words, 1)
    chars = np.maximum(s.per_doc(s.code_points), 1)
    cp = np.zeros(len(s.buf) + 1, np.int64)
    np.cumsum(s.code_points, out=cp[1:])
    length = (cp[s.end] - cp[s.start]).astype(float)
    doc = s.word_doc()
    per = lambda x: np.bincount(doc, weights=x, minlength=s.n)
    mean = per(length) / words
    spread = np.sqrt(np.maximum(per(length * length) / words - mean * mean, 0))
    tail = s.buf[s.end - 1] if len(doc) else np.zeros(0, np.uint8)
    hashes = s.word_hashes()
    pair_at, pairs = s.shingles(hashes, 2)
    pair_doc = doc[pair_at]
    rep = np.bincount(doc[repeated(doc, hashes)], minlength=s.n)
    rep2 = np.bincount(pair_doc[repeated(pair_doc, pairs)], minlength=s.n)
    newlines = s.per_doc(s.buf == 10) + 1
    upper, lower = s.per_doc(_UPPER[s.buf]), s.per_doc(_LOWER[s.buf])
    return np.stack([
        np.log1p(s.n_words), mean, spread, s.per_doc(_SYMBOL[s.buf]) / chars,
        s.per_doc(_MARK[s.buf]) / chars, s.per_doc(_STOP[s.buf]) / words,
        s.per_doc(_DIGIT[s.buf]) / chars, upper / np.maximum(upper + lower, 1),
        per((length == 1) & (_SYMBOL[tail] | _MARK[tail])) / words,
        per(_SYMBOL[tail] | _MARK[tail]) / words,
        rep / words, rep2 / words, s.n_words / newlines,
        1 - s.per_doc(s.inside & s.code_points) / chars,
        per(length <= 3) / words, per(length >= 15) / words], axis=1)


def batch_features(texts: pa.Array) -> np.ndarray:
    buf, offs = text_buffer(texts)
    got = [features_of(Slice(buf, offs, i, j)) for i, j in slices(offs)]
    return np.concatenate(got) if got else np.zeros((0, len(FEATURES)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _shallow(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """Newton steps of a tree with at most ``leaves`` leaves over ordered bins, from
    the bins' gradient and curvature sums."""
    cuts, steps = [0, len(g)], None
    G, H = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    gain = lambda a, b: (G[b] - G[a]) ** 2 / (H[b] - H[a] + 1.0)
    for _ in range(leaves - 1):
        best = (1e-9, None)
        for a, b in zip(cuts[:-1], cuts[1:]):
            at = np.arange(a + 1, b)
            if len(at):
                up = gain(a, at) + gain(at, b) - gain(a, b)
                k = int(up.argmax())
                if up[k] > best[0]:
                    best = (up[k], int(at[k]))
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    steps = np.zeros(len(g))
    for a, b in zip(cuts[:-1], cuts[1:]):
        steps[a:b] = (G[b] - G[a]) / (H[b] - H[a] + 1.0)
    return steps


@dataclass
class Gam:
    intercept: float
    edges: list[np.ndarray]                       # bin edges of each feature
    tables: list[np.ndarray]                      # one value a bin
    pair_edges: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]      # (feature, feature, grid)

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for f, (edges, values) in enumerate(zip(self.edges, self.tables)):
            z += values[np.searchsorted(edges, x[:, f], "right")]
        for a, b, grid in self.pairs:
            z += grid[np.searchsorted(self.pair_edges[a], x[:, a], "right"),
                      np.searchsorted(self.pair_edges[b], x[:, b], "right")]
        return z

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logit(x))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0)


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    """Cyclic boosting of the feature tables, then of the best pairs' grids."""
    n, k = x.shape
    rate = (y.sum() + 1) / (n + 2)
    model = Gam(float(np.log(rate / (1 - rate))), [], [], [], [])
    model.edges = [_edges(x[:, f], BINS) for f in range(k)]
    model.pair_edges = [_edges(x[:, f], PAIR_BINS) for f in range(k)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    if n == 0 or y.min() == y.max():
        return model
    bins = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(model.edges)]
    z = np.full(n, model.intercept)
    for _ in range(ROUNDS):
        for f in range(k):
            p = _sigmoid(z)
            m = len(model.tables[f])
            step = RATE * _shallow(np.bincount(bins[f], y - p, m),
                                   np.bincount(bins[f], p * (1 - p), m), LEAVES)
            model.tables[f] += step
            z += step[bins[f]]

    coarse = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(model.pair_edges)]
    width = PAIR_BINS + 1
    p = _sigmoid(z)
    gains = []
    for a in range(k):
        for b in range(a + 1, k):
            cell = coarse[a] * width + coarse[b]
            g, h = np.bincount(cell, y - p, width ** 2), np.bincount(cell, p * (1 - p), width ** 2)
            gains.append((float((g * g / (h + 1)).sum()), a, b))
    chosen = sorted(gains, key=lambda t: (-t[0], t[1:]))[:PAIRS]
    model.pairs = [(a, b, np.zeros((width, width))) for _, a, b in chosen]
    for _ in range(PAIR_ROUNDS):
        for a, b, grid in model.pairs:
            p = _sigmoid(z)
            cell = coarse[a] * width + coarse[b]
            g = np.bincount(cell, y - p, width ** 2).reshape(width, width)
            h = np.bincount(cell, p * (1 - p), width ** 2).reshape(width, width)
            # a tree of depth two: a split of one feature, then one of the other on each side
            cut = _shallow(g.sum(1), h.sum(1), 2)
            side = np.flatnonzero(np.diff(cut))[:1]
            rows = np.split(np.arange(width), side + 1)
            step = np.zeros((width, width))
            for r in rows:
                step[r] = RATE * _shallow(g[r].sum(0), h[r].sum(0), 2)
            grid += step
            z += step.ravel()[cell]
    return model


def labelled(docs: DataFrame, labels: DataFrame, target: str = "quality",
             max_rows: int = MAX_TRAIN) -> DataFrame:
    """(doc_id, y, text) of at most ``max_rows`` labelled documents, by hash of doc_id."""
    ids = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.round(F.avg(target)).cast("int").alias("y"))
    ids = ids.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")   # at most max_rows ids


def train(docs: DataFrame, labels: DataFrame, target: str = "quality",
          max_rows: int = MAX_TRAIN) -> Gam:
    """Fit on the labelled rows among ``docs``; only their features reach the driver."""
    rows = labelled(docs, labels, target, max_rows).select("doc_id", "y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = batch_features(b.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").cast(pa.string()), b.column("y"), pa.array(list(x), pa.list_(pa.float64()))],
                    ["doc_id", "y", "x"])

    got = rows.mapInArrow(lean(run), "doc_id string, y int, x array<double>").toArrow().sort_by(
        [("doc_id", "ascending")])
    x = np.array(got["x"].to_pylist(), float).reshape(-1, len(FEATURES))
    return fit(x, got["y"].to_numpy().astype(float))


def score(docs: DataFrame, model: Gam, keep: list[str]) -> DataFrame:
    """``keep`` columns and the score of every whole text."""
    out = docs.select(*keep).schema.add("score", "double")
    names = out.names
    text = "text" if "text" in keep else "_text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(c) for c in keep],
                     pa.array(model.score(batch_features(b.column(text))), pa.float64())], names)

    return docs.select(*keep, *([] if text == "text" else [F.col("text").alias("_text")])).mapInArrow(lean(run), out)
