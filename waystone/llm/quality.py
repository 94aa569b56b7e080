"""Operator 3: quality classifier, histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, span_hashes, text_chunks, with_fields, word_spans

#: Most labelled documents that the classifier is fitted on, those of least hash.
SAMPLE_ROWS = 20_000
TREES, DEPTH, BINS, RATE, MIN_LEAF, RIDGE = 60, 4, 64, 0.2, 8, 1.0
#: Documents of at least this score are kept.
KEEP = 0.3

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_HIGH = np.zeros(256, bool)
_HIGH[128:] = True
_POINT = np.zeros(256, bool)
_POINT[[ord(c) for c in ".,;:?'\"-()"]] = True
_SIGN = np.zeros(256, bool)
_SIGN[33:127] = True
_SIGN &= ~(_UPPER | _LOWER | _DIGIT | _POINT)
CLASSES = (_SPACE, _UPPER, _LOWER, _DIGIT, _HIGH, _POINT, _SIGN, *(np.arange(256) == ord(c) for c in "!|\n#"))
FEATURES = len(CLASSES) + 13


def _per_text(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, weights=values, minlength=n)[:n]


def _repeats(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of each text: how many, how many distinct, and how often the most frequent one stands."""
    order = np.lexsort((h, doc))
    d, v = doc[order], h[order]
    new = np.ones(len(v), bool)
    new[1:] = (d[1:] != d[:-1]) | (v[1:] != v[:-1])
    at = np.flatnonzero(new)
    runs = np.diff(np.append(at, len(v)))
    most = np.zeros(n)
    np.maximum.at(most, d[at], runs)
    return np.bincount(doc, minlength=n).astype(float), np.bincount(d[at], minlength=n).astype(float), most


def document_statistics(texts: pa.Array | list[str | None]) -> np.ndarray:
    """A row of FEATURES statistics for each whole text: shares of byte classes, word and line lengths, repetition."""
    out = np.zeros((len(texts), FEATURES), np.float64)
    for lo, hi, buf, off in text_chunks(texts):
        n, size = hi - lo, np.maximum(1, np.diff(off)).astype(float)
        f = out[lo:hi]
        for i, c in enumerate(CLASSES):
            sums = np.zeros(len(buf) + 1, np.int64)
            np.cumsum(c[buf], out=sums[1:])
            f[:, i] = (sums[off[1:]] - sums[off[:-1]]) / size
        i = len(CLASSES)
        f[:, i] = np.log1p(np.diff(off))
        s, e, doc = word_spans(buf, off, ~_SPACE)
        h = span_hashes(buf, s, e)
        count, distinct, most = _repeats(h, doc, n)
        some = np.maximum(1, count)
        length = (e - s).astype(float)
        mean = _per_text(length, doc, n) / some
        f[:, i + 1], f[:, i + 2] = np.log1p(count), mean
        f[:, i + 3] = np.sqrt(np.maximum(0, _per_text(length**2, doc, n) / some - mean**2))
        f[:, i + 4], f[:, i + 5] = distinct / some, most / some
        if len(h) > 1:
            same = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
            f[:, i + 6] = _per_text(same.astype(float), doc[1:], n) / some
        if len(e):
            last = buf[e - 1]
            f[:, i + 7] = _per_text(_SIGN[last].astype(float), doc, n) / some
            f[:, i + 8] = _per_text(_POINT[last].astype(float), doc, n) / some
        s, e, doc = word_spans(buf, off, np.arange(256) != 10)
        count, distinct, most = _repeats(span_hashes(buf, s, e), doc, n)
        some = np.maximum(1, count)
        f[:, i + 9], f[:, i + 10], f[:, i + 11] = np.log1p(count), distinct / some, most / some
        f[:, i + 12] = np.log1p(_per_text((e - s).astype(float), doc, n) / some)
    return out


@dataclass
class Forest:
    """Complete trees of one depth in flat arrays: tree t's node i has the children 2 i + 1 and 2 i + 2."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row: every row goes down each tree at once."""
        rows, total = np.arange(len(x)), np.full(len(x), self.base)
        inner = self.feature.shape[1]
        for f, t, v in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            total += v[node - inner] if len(node) else 0
        return 1 / (1 + np.exp(-total))


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Forest:
    """Boosts trees on logistic loss; splits are sought in histograms of quantile bins. One class only: no trees."""
    n, inner = len(y), (1 << depth) - 1
    base = float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    if n == 0 or y.min() == y.max():
        trees = 0
    feature, threshold = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf)
    leaf = np.zeros((trees, inner + 1))
    if not trees:
        return Forest(base, feature, threshold, leaf)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    bins = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T, strict=True)])
    total = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h, node = p - y, p * (1 - p), np.zeros(n, np.int64)
        for level in range(depth):
            first, wide = (1 << level) - 1, 1 << level
            local = node - first
            best = np.full(wide, 1e-6)
            for j, b in enumerate(bins):
                if not len(cuts[j]):
                    continue
                key = local * BINS + b
                hist = [np.bincount(key, w, wide * BINS).reshape(wide, BINS) for w in (g, h, None)]
                left = [np.cumsum(a, axis=1)[:, :-1] for a in hist]
                right = [a.sum(axis=1, keepdims=True) - b_ for a, b_ in zip(hist, left, strict=True)]
                gain = left[0] ** 2 / (left[1] + RIDGE) + right[0] ** 2 / (right[1] + RIDGE) - (left[0] + right[0]) ** 2 / (left[1] + right[1] + RIDGE)
                gain[(left[2] < MIN_LEAF) | (right[2] < MIN_LEAF)] = 0
                gain = gain[:, : len(cuts[j])]
                at = gain.argmax(axis=1)
                better = gain[np.arange(wide), at] > best
                best = np.where(better, gain[np.arange(wide), at], best)
                feature[t, first : first + wide][better] = j
                threshold[t, first : first + wide][better] = cuts[j][at[better]]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > threshold[t, node])
        at = node - inner
        leaf[t] = -RATE * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + RIDGE)
        total += leaf[t, at]
    return Forest(base, feature, threshold, leaf)


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null ids are in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0))


def train_quality(docs: DataFrame, labels: DataFrame, folds: int = 5, sample_rows: int = SAMPLE_ROWS) -> Forest:
    """A classifier of labels (doc_id, quality 0/1) from the texts of docs, learnt outside fold 0.

    It sees at most sample_rows labelled ids, those of least hash, and one text of each, of several the least, so what
    is broadcast, gathered and fitted on is bounded, whatever repeats.
    Other values of quality, and nulls, are no labels; of differing labels for an id the larger counts. Without
    labels the classifier has no trees and scores 0.5.
    """
    y = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("quality IN (0, 1) AND doc_id IS NOT NULL")
    y = y.where(fold(F.col("doc_id"), folds) != 0).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    y = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    seen = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(y), "doc_id")
    seen = seen.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))

    def statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = document_statistics(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality").cast(pa.int32()), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "quality", "x"])

    kind = dict(seen.dtypes)["doc_id"]
    rows = sorted(seen.mapInArrow(statistics, f"doc_id {kind}, quality int, x array<double>").toArrow().to_pylist(), key=lambda r: (r["doc_id"], r["x"]))
    x = np.array([r["x"] for r in rows], np.float64).reshape(-1, FEATURES)
    return fit_forest(x, np.array([r["quality"] for r in rows], np.float64))


def score_quality(docs: DataFrame, forest: Forest, column: str = "quality_score") -> DataFrame:
    """docs with the classifier's score of each whole text in one more column, no shuffle.

    Null and empty texts have the statistics of the empty text; other columns pass through untouched, a column of
    the name is replaced; repeated rows are scored each on its own; an empty table stays empty.
    """
    keep = [c for c in docs.columns if c != column]
    d = docs.select(*keep)
    schema = with_fields(d.schema, **{column: "double"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = forest.scores(document_statistics(b.column("text")))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], [*keep, column])

    return d.mapInArrow(run, schema)


def keep_quality(docs: DataFrame, forest: Forest, least: float = KEEP) -> DataFrame:
    """The rows of docs whose text scores at least so much, with their own columns."""
    (name,) = free_names(docs, "quality")
    return score_quality(docs, forest, name).where(F.col(name) >= least).drop(name)


def op3_quality_classifier(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The digest of score_quality: one row per document."""
    scored = score_quality(docs.select("doc_id", "text"), train_quality(docs, labels), "score")
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= KEEP).cast("int").alias("predicted"))
