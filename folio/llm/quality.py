"""Quality classifier: a generalised additive model with pairwise interactions (operator 8).

Shallow trees are boosted on one feature at a time, round after round, and added up into a lookup table for
each feature; tables of pairs are boosted on what the single features leave. A score is a sum of table
entries, looked up for whole batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_slices, solid, written

#: Bound of what is fitted: labelled rows, those of smallest hash.
LABELLED = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 10
ROUNDS, PAIR_ROUNDS, RATE = 120, 60, 0.15
LEAVES, LEAST_WEIGHT = 4, 4.0

FEATURES = [
    "log_bytes", "log_words", "word_length", "long_words", "distinct_words", "repeated_neighbours", "upper", "digits", "marks",
    "odd_marks", "blank", "lines_per_word", "distinct_lines", "non_ascii", "top_word", "ends_with_mark", "short_words", "title_words",
]

_CLASS = np.zeros((256, 5), dtype=np.float64)
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = [65 <= _b <= 90, 48 <= _b <= 57, _c in ".,;:'\"-!?", _b < 128 and _c.isprintable() and not _c.isalnum() and _c not in " .,;:'\"-?", _b >= 128]


def text_features(text: str) -> list[float]:
    """The FEATURES of a whole text; an empty text has zeros and ones that no other text has together."""
    raw = text.encode("utf-8", "replace")
    words = text.split()
    n, size = max(len(words), 1), max(len(raw), 1)
    upper, digits, marks, odd, high = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256) @ _CLASS
    lines = text.split("\n")
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) if words else np.zeros(1, dtype=np.int64)
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    same = sum(map(str.__eq__, words, words[1:]))
    return [
        np.log1p(len(raw)), np.log1p(len(words)), lengths.mean(), (lengths > 12).mean(), len(counts) / n, same / n, upper / size, digits / size, marks / size,
        odd / size, 1 - lengths.sum() / max(len(text), 1), len(lines) / n, len(set(lines)) / len(lines), high / size, max(counts.values(), default=0) / n,
        sum([w[-1] in ".,;:!?*#%&$|" for w in words]) / n, (lengths <= 3).mean(), sum([w[0].isupper() for w in words]) / n,
    ]


def _bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)], axis=1)


def _edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    return [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]


def _tree(grad: np.ndarray, hess: np.ndarray) -> np.ndarray:
    """Values of a tree of at most LEAVES leaves over ordered bins, grown by best gain."""
    g, h = np.concatenate([[0], np.cumsum(grad)]), np.concatenate([[0], np.cumsum(hess)])
    value = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + 1.0)
    leaves = [(0, len(grad))]
    for _ in range(LEAVES - 1):
        best, where = 1e-9, None
        for k, (a, b) in enumerate(leaves):
            cuts = np.arange(a + 1, b)
            if len(cuts):
                gain = np.where((h[cuts] - h[a] >= LEAST_WEIGHT) & (h[b] - h[cuts] >= LEAST_WEIGHT), value(a, cuts) + value(cuts, b) - value(a, b), 0)
                if gain.max() > best:
                    best, where = gain.max(), (k, int(cuts[gain.argmax()]))
        if where is None:
            break
        k, cut = where
        a, b = leaves.pop(k)
        leaves += [(a, cut), (cut, b)]
    out = np.zeros(len(grad))
    for a, b in leaves:
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + 1.0)
    return out


def _quadrants(grad: np.ndarray, hess: np.ndarray) -> tuple[float, np.ndarray]:
    """Best gain and values of one cut along each axis of a table."""
    g, h = np.pad(grad.cumsum(0).cumsum(1), ((1, 0), (1, 0))), np.pad(hess.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    a, b = grad.shape
    best, out = 0.0, np.zeros_like(grad)
    for i in range(1, a):
        for j in range(1, b):
            cells = [((0, i), (0, j)), ((0, i), (j, b)), ((i, a), (0, j)), ((i, a), (j, b))]
            sums = [(g[r1, c1] - g[r0, c1] - g[r1, c0] + g[r0, c0], h[r1, c1] - h[r0, c1] - h[r1, c0] + h[r0, c0]) for (r0, r1), (c0, c1) in cells]
            gain = sum(x * x / (y + 1.0) for x, y in sums)
            if gain > best:
                best, out = gain, np.zeros_like(grad)
                for ((r0, r1), (c0, c1)), (x, y) in zip(cells, sums, strict=True):
                    out[r0:r1, c0:c1] = x / (y + 1.0)
    return best, out


@dataclass
class AdditiveModel:
    bias: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pair_edges: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def margins(self, x: np.ndarray) -> np.ndarray:
        out, at = np.full(len(x), self.bias), _bins(x, self.edges)
        for j, table in enumerate(self.tables):
            out += table[at[:, j]]
        two = _bins(x, self.pair_edges)
        for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
            out += table[two[:, i], two[:, j]]
        return out


def fit_tables(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Cyclic boosting of single features, then of the pairs that gain most on what is left."""
    share = (y.sum() + 1) / (len(y) + 2)
    model = AdditiveModel(float(np.log(share / (1 - share))), _edges(x, BINS), [], _edges(x, PAIR_BINS), [], [])
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    at, margin = _bins(x, model.edges), np.full(len(y), model.bias)
    chance = lambda: 1 / (1 + np.exp(-margin))
    for _ in range(ROUNDS):
        for j, table in enumerate(model.tables):
            p = chance()
            step = RATE * _tree(np.bincount(at[:, j], y - p, len(table)), np.bincount(at[:, j], p * (1 - p), len(table)))
            table += step
            margin += step[at[:, j]]
    two, sizes = _bins(x, model.pair_edges), [len(e) + 1 for e in model.pair_edges]
    cell = lambda i, j: two[:, i] * sizes[j] + two[:, j]
    sums = lambda i, j, w: np.bincount(cell(i, j), w, sizes[i] * sizes[j]).reshape(sizes[i], sizes[j])
    p = chance()
    gains = [(_quadrants(sums(i, j, y - p), sums(i, j, p * (1 - p)))[0], (i, j)) for i, j in combinations(range(x.shape[1]), 2)]
    model.pairs = [pair for _, pair in sorted(gains, reverse=True)[:PAIRS]]
    model.pair_tables = [np.zeros((sizes[i], sizes[j])) for i, j in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (i, j), table in zip(model.pairs, model.pair_tables, strict=True):
            p = chance()
            step = RATE * _quadrants(sums(i, j, y - p), sums(i, j, p * (1 - p)))[1]
            table += step
            margin += step[two[:, i], two[:, j]]
    return model


def features(docs: DataFrame) -> DataFrame:
    """docs without text, with the array column features."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in in_slices(frames, "text"):
            rows = [text_features(t if isinstance(t, str) else "") for t in part["text"]]
            yield part.drop(columns="text").assign(features=rows)

    rest = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text"]
    return docs.mapInPandas(solid(run), ", ".join([*rest, "features array<double>"]))


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> AdditiveModel:
    """Fit on the features of at most `labelled` rows of labels(doc_id, quality), the bound of what the driver gets.

    Without labelled rows, or with one class only, the tables stay at zero and every score is the class's share.
    """
    labels = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    sample = written(labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled))
    known = F.broadcast(sample.select(F.col("doc_id").alias("_id"), "quality"))
    rows = features(docs.where("text is not null").select("doc_id", "text").join(known, F.col("doc_id") == F.col("_id")).select("quality", "text")).toPandas()
    x = np.array(rows["features"].tolist(), dtype=np.float64).reshape(len(rows), len(FEATURES))
    return fit_tables(x, rows["quality"].to_numpy(dtype=np.float64)) if len(rows) else AdditiveModel(0.0, [np.zeros(0)] * len(FEATURES), [np.zeros(1)] * len(FEATURES), [np.zeros(0)] * len(FEATURES), [], [])


def predict(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """doc_id and score of every text; one narrow stage, the model has a fixed size.

    Null texts score as empty ones. A very long text is read whole. Equal texts have equal scores. Repeated rows, null
    doc_ids and other columns change nothing; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in in_slices(frames, "text"):
            x = np.array([text_features(t if isinstance(t, str) else "") for t in part["text"]], dtype=np.float64)
            margin = shared.value.margins(x)
            yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "score": 1 / (1 + np.exp(-np.clip(margin, -30, 30)))})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(solid(run), f"doc_id {kind}, score double")
