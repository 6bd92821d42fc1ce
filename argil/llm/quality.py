"""Quality: histogram gradient-boosted trees over document statistics, trained in numpy and flattened into arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from argil.llm._labels import held_out, labelled, sample
from argil.llm._stats import FEATURES, features
from argil.llm._text import raw, read, slices

#: Most training rows of each class, a proven bound of what reaches the driver: one row of statistics each.
SAMPLE = 10000
TREES, DEPTH, RATE, BINS, LEAST, RIDGE = 60, 4, 0.15, 64, 20, 1.0
THRESHOLD = 0.3


@dataclass
class Forest:
    """Complete trees of ``DEPTH`` levels, level by level: node ``i`` of a tree has the children ``2 i + 1`` and ``2 i + 2``. A node
    that isn't split sends everything left. ``feature`` and ``cut`` have shape (trees, inner nodes), ``leaf`` (trees, leaves)."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row of ``x``. All rows go down a tree together, one gather and one comparison a level."""
        out = np.full(len(x), self.base)
        every = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[every, feature[node]] > cut[node])
            out += leaf[node - len(feature)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, trees: int = TREES) -> Forest:
    """Boost trees on the logistic loss; each split maximises the gain over histograms of at most ``BINS`` bins."""
    weight = np.ones(len(y)) if weight is None else weight
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(1) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1) if len(x) else np.zeros(x.shape, dtype=np.int64)
    p = np.clip((weight * y).sum() / max(weight.sum(), 1e-9), 1e-3, 1 - 1e-3) if len(y) else 0.5
    inner, n_features = 2**DEPTH - 1, x.shape[1]
    forest = Forest(np.zeros((trees, inner), dtype=np.int64), np.full((trees, inner), np.inf), np.zeros((trees, 2**DEPTH)), float(np.log(p / (1 - p))))
    if not len(y) or y.min() == y.max():
        return forest
    margin = np.full(len(y), forest.base)
    columns = np.arange(n_features) * BINS
    for t in range(trees):
        q = 1 / (1 + np.exp(-margin))
        g, h = weight * (q - y), weight * q * (1 - q)
        node = np.zeros(len(y), dtype=np.int64)
        for level in range(DEPTH):
            begin, n_nodes = 2**level - 1, 2**level
            slot = ((node - begin)[:, None] * (n_features * BINS) + columns + binned).ravel()
            shape = (n_nodes, n_features, BINS)
            hist = [np.bincount(slot, np.repeat(v, n_features), n_nodes * n_features * BINS).reshape(shape) for v in (g, h, np.ones(len(y)))]
            left = [np.cumsum(v, axis=2) for v in hist]
            whole = [v[:, :, -1:] for v in left]
            right = [w - v for w, v in zip(whole, left)]
            gain = left[0] ** 2 / (left[1] + RIDGE) + right[0] ** 2 / (right[1] + RIDGE) - whole[0] ** 2 / (whole[1] + RIDGE)
            gain[(left[2] < LEAST) | (right[2] < LEAST)] = 0
            best = gain.reshape(n_nodes, -1).argmax(axis=1)
            for k, b in enumerate(best.tolist()):
                j, at = divmod(b, BINS)
                if gain[k, j, at] > 1e-6 and at < len(edges[j]):
                    forest.feature[t, begin + k], forest.cut[t, begin + k] = j, edges[j][at]
            node = 2 * node + 1 + (x[np.arange(len(x)), forest.feature[t][node]] > forest.cut[t][node])
        place = node - inner
        forest.leaf[t] = -RATE * np.bincount(place, g, 2**DEPTH) / (np.bincount(place, h, 2**DEPTH) + RIDGE)
        margin += forest.leaf[t][place]
    return forest


def _with_statistics(docs: DataFrame, text_column: str, columns: list[str]) -> DataFrame:
    schema = docs.select(*columns).schema.add("__x", T.ArrayType(T.DoubleType()))
    wide = docs.select(*columns, F.col(text_column).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                x = features(*raw(part.column(part.num_columns - 1)))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], lists], names=schema.names)

    return wide.mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE, id_column: str = "doc_id", text_column: str = "text") -> Forest:
    """Train on a bounded sample of labelled rows, weighted back to the classes' shares among all labels.

    Rows without an id, a label of 0 or 1, or a document are passed over, and so are ids with contradicting labels and held-out ids.
    Of rows that share an id one is learnt from, that with the smallest statistics in their order. Without labels, or of one class
    only, all documents score alike.
    """
    chosen = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).join(F.broadcast(sample(labels, label, most, id_column)), "doc_id")
    rows = _with_statistics(chosen, "text", ["doc_id", "label"]).groupBy("doc_id", "label").agg(F.min("__x").alias("__x"))
    found = rows.toArrow().sort_by("doc_id")
    y = found.column("label").to_numpy().astype(np.float64)
    x = np.array(found.column("__x").to_pylist(), dtype=np.float64).reshape(len(y), len(FEATURES))
    shares = {r[0]: r[1] for r in labelled(labels, label, id_column).groupBy("label").count().collect()}
    weight = np.array([shares[int(v)] / max((y == v).sum(), 1) for v in y]) if len(y) else None
    return train(x, y, weight / weight.mean() if len(y) else None)


def score(docs: DataFrame, forest: Forest, text_column: str = "text", score_column: str = "score") -> DataFrame:
    """Add the score of each whole text, 0 to 1; a null or empty text scores too. A column of that name is replaced, unless it is the
    text's own, which is an error. Other columns, nulls in them and repeated rows pass through; no rows, no rows."""
    if text_column == score_column:
        raise ValueError("the score needs a column of its own")
    shared = docs.sparkSession.sparkContext.broadcast(forest)  # of a fixed size
    rest = [c for c in docs.columns if c != score_column]
    place = rest.index(text_column)
    schema = docs.select(*rest).schema.add(score_column, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_column):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(shared.value.score(features(*raw(part.column(place)))))], names=schema.names)

    return docs.select(*rest).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: quality score of every document; one without an id isn't held out."""
    docs = read(spark, sf_dir, "documents")
    scored = score(docs.select("doc_id", "text"), fit(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out("doc_id"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
