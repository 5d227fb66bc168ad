"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of every whole text are computed in Spark tasks (a byte histogram and a few word
counts) and written once; training and scoring read those short rows. The trees are grown
level by level on binned statistics with logistic loss, to a fixed depth, and stored as
flat arrays (a complete tree per row), which numpy walks for all documents of a batch at once.

The training sample is the only bounded part: at most ``sample_rows`` labelled rows, those with
the smallest hash of the id.

Defined cases: a null text is an empty text; empty texts get a score like any other; a
null label is no label; an id labelled twice counts once, with its smallest label; without both labels in
the sample every score is the share of label 1 (0.5 without any); null ids have no label;
repeated rows get equal scores; an empty table gives an empty result.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, lean, slices, staged, texts_of

STATISTICS = (
    "log_bytes", "log_words", "word_bytes", "upper", "lower", "digit", "beyond_ascii", "space", "newline",
    "stop", "comma", "shout", "symbol", "bar", "other", "byte_entropy", "distinct_words", "same_as_last", "longest_word", "distinct_lines", "first_line",
)


def statistics(text: str) -> list[float]:
    """The numbers of ``STATISTICS`` for one whole text."""
    data = text.encode()
    n = max(1, len(data))
    c = np.bincount(np.frombuffer(data, np.uint8), minlength=256).astype(np.float64) / n
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    w = max(1, len(words))
    p = c[c > 0]
    symbols = float(c[[ord(x) for x in "#*$%&<>"]].sum())
    stop, comma, shout, bar = (float(c[ord(x)]) for x in ".,!|")
    upper, lower, digit = float(c[65:91].sum()), float(c[97:123].sum()), float(c[48:58].sum())
    beyond, space, newline = float(c[128:].sum()), float(c[32]), float(c[10])
    return [
        np.log1p(len(data)), np.log1p(len(words)), len(data) / w, upper, lower, digit, beyond, space, newline,
        stop, comma, shout, symbols, bar, 1.0 - (upper + lower + digit + beyond + space + newline + stop + comma + shout + symbols + bar) if data else 0.0,
        float(-(p * np.log2(p)).sum()), len(set(words)) / w, sum(map(eq, words, words[1:])) / w,
        np.log1p(max(map(len, words), default=0)), len(set(lines)) / max(1, len(lines)), len(lines[0]) / max(1, len(text)) if lines else 0.0,
    ]


def document_statistics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and ``x``, the array of statistics."""

    def measure(batches):
        lean()
        for batch in batches:
            for part in slices(batch, "text", 16 << 20):
                rows = [statistics(t) for t in texts_of(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "x"])

    two = docs.select(col(docs, id_col).cast("long").alias("doc_id"), col(docs, text_col).alias("text"))
    return two.mapInArrow(measure, "doc_id long, x array<double>")


class BoostedTrees:
    """Binary logistic boosting with histograms; arrays only."""

    def __init__(self, rounds: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.l2, self.least = rounds, depth, rate, bins, l2, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> "BoostedTrees":
        n, f = x.shape
        share = float(y.mean()) if n else 0.5
        self.base = float(np.log(share / (1 - share))) if 0 < share < 1 else (0.0 if not n else (12.0 if share == 1 else -12.0))
        inner, leaves = 2**self.depth - 1, 2**self.depth
        self.feature = np.zeros((0, inner), np.int32)
        self.cut = np.zeros((0, inner))
        self.leaf = np.zeros((0, leaves))
        if not n or not 0 < share < 1:
            return self
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(f)]
        binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)  # bin b: x <= edges[b]
        margin = np.full(n, self.base)
        features, cuts, values = [], [], []
        flat = binned + np.arange(f) * self.bins
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, np.maximum(p * (1 - p), 1e-9)
            node = np.zeros(n, np.int64)
            feature, cut = np.zeros(inner, np.int32), np.full(inner, np.inf)
            for level in range(self.depth):
                width, first = 2**level, 2**level - 1
                at = ((node - first)[:, None] * (f * self.bins) + flat).ravel()
                shape = (width, f, self.bins)
                hg = np.bincount(at, np.repeat(g, f), width * f * self.bins).reshape(shape).cumsum(2)
                hh = np.bincount(at, np.repeat(h, f), width * f * self.bins).reshape(shape).cumsum(2)
                tg, th = hg[:, :, -1:], hh[:, :, -1:]
                gain = hg**2 / (hh + self.l2) + (tg - hg) ** 2 / (th - hh + self.l2) - tg**2 / (th + self.l2)
                gain[(hh < self.least) | (th - hh < self.least)] = 0
                best = gain.reshape(width, -1).argmax(1)
                for k in range(width):
                    j, b = divmod(int(best[k]), self.bins)
                    if gain[k, j, b] > 1e-6 and b < len(edges[j]):
                        feature[first + k], cut[first + k] = j, edges[j][b]
                node = 2 * node + 1 + (x[np.arange(n), feature[node]] > cut[node])
            leaf = node - inner
            value = -self.rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + self.l2)
            margin += value[leaf]
            features.append(feature), cuts.append(cut), values.append(value)
        self.feature, self.cut, self.leaf = np.stack(features), np.stack(cuts), np.stack(values)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        margin, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            margin += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-margin))


def train_quality(measured: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", label_col: str = "quality", train_where: Column | None = None, sample_rows: int = 20_000, **options) -> BoostedTrees:
    """Fit on at most ``sample_rows`` labelled rows of ``document_statistics``."""
    marks = labels.select(col(labels, id_col).cast("long").alias("l_id"), col(labels, label_col).cast("double").alias("y")).where("y IS NOT NULL AND l_id IS NOT NULL")
    marks = marks.groupBy("l_id").agg(F.min("y").alias("y"))
    rows = measured if train_where is None else measured.where(train_where)
    rows = rows.dropDuplicates(["doc_id"]).join(marks, F.col("doc_id") == F.col("l_id"))
    got = rows.select("doc_id", F.xxhash64("doc_id").alias("h"), "x", "y").orderBy("h", "doc_id").limit(sample_rows).toArrow()
    x = np.array(got["x"].to_pylist(), np.float64).reshape(-1, len(STATISTICS))
    return BoostedTrees(**options).fit(x, got["y"].to_numpy().astype(np.float64))


def score_quality(measured: DataFrame, model: BoostedTrees, threshold: float = 0.3) -> DataFrame:
    """Per row: id, ``score`` and ``predicted`` (1 where the score is at least the threshold)."""

    def score(batches):
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
                s = model.predict(x)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return measured.mapInArrow(score, "doc_id long, score double, predicted int")


def classify_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", train_where=None, threshold: float = 0.3, **options) -> DataFrame:
    """Measure, train on the rows where ``train_where(id)`` holds, and score every row."""
    measured = staged(document_statistics(docs, id_col=id_col, text_col=text_col), "quality-statistics")
    model = train_quality(measured, labels, train_where=train_where(measured["doc_id"]) if train_where else None, **options)
    return score_quality(measured, model, threshold)


def keep_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", train_where=None, threshold: float = 0.3, **options) -> DataFrame:
    """The rows of ``docs`` whose score is at least the threshold, with all their columns."""
    measured = staged(document_statistics(docs, id_col=id_col, text_col=text_col), "quality-statistics")
    model = train_quality(measured, labels, train_where=train_where(measured["doc_id"]) if train_where else None, **options)
    place = docs.columns.index(text_col)

    def keep(batches):
        for batch in batches:
            x = np.array([statistics(t) for t in texts_of(batch.column(place))]).reshape(-1, len(STATISTICS))
            yield batch.filter(pa.array(model.predict(x) >= threshold))

    return docs.mapInArrow(keep, docs.schema)
