"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature is cut into bins. Boosting goes round the features; each step fits a shallow tree to the loss's gradient over
one feature's bins and adds it to that feature's lookup table, so the model stays a sum of tables. The feature pairs with
the largest gain on what is left get tables of two dimensions in the same way. Scoring is a lookup and an addition per
table, for whole batches at once.

Defined results: a null text counts as empty and is scored; a label of null is no label; of several labels of one doc_id each
counts; without labels of both kinds every score is the share of label 1, or 0.5; rows are scored one by one; other columns
do not matter; an empty table gives an empty table. Labels, lang, source and doc_id are no features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from counterlake.llm import bpe, shingles
from counterlake.llm.store import stored

#: Labelled rows that the model is fitted on (those with the smallest hashed doc_id), held by the driver.
FIT_ROWS = 20_000
FOLDS, HELD_FOLD, CUT = 5, 0, 0.3
FEATURES = ("log_words", "word_bytes", "symbol_share", "upper_share", "digit_share", "mark_share", "high_share", "lines_word",
            "distinct_words", "equal_neighbours", "repeated_windows", "repeated_lines", "shout_share", "capital_words")
#: Classes of bytes: white space, line end, a-z, A-Z, digit, symbol, other mark, beyond ASCII, exclamation mark.
_CLASS = np.full(256, 6, np.uint8)
_CLASS[[9, 11, 12, 13, 32]], _CLASS[10], _CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 3, 4, 7
_CLASS[[ord(c) for c in "#*$%&|<>"]], _CLASS[33] = 5, 8
_LINE = np.zeros(256, bool)
_LINE[10] = True


def features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES a text."""
    words, lines = shingles.Spans(texts), shingles.Spans(texts, _LINE)
    n_texts, counts = len(texts), words.counts.astype(np.int64)
    owner = np.repeat(np.arange(n_texts), np.diff(words.offsets))
    by_class = np.bincount(owner * 9 + _CLASS[words.raw], minlength=9 * n_texts).reshape(n_texts, 9).astype(float)
    hashes, line_hashes = words.hashes(), lines.hashes()
    windows = shingles.rolled_windows(hashes)
    of = np.repeat(np.arange(n_texts), counts)
    equal = np.bincount(of[1:][(hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])], minlength=n_texts) if len(of) else np.zeros(n_texts)
    letters = by_class[:, 2] + by_class[:, 3] + by_class[:, 7]
    capital = np.concatenate([[0], np.cumsum(_CLASS[words.raw] == 3)])
    small = np.concatenate([[0], np.cumsum(_CLASS[words.raw] == 2)])
    loud = (capital[words.ends] - capital[words.starts] > 1) & (small[words.ends] == small[words.starts])
    n_loud = np.bincount(of[loud], minlength=n_texts)
    out, low, line = np.zeros((n_texts, len(FEATURES))), 0, 0
    for k, n in enumerate(counts.tolist()):
        size, n_lines = max(1, n), int(lines.counts[k])
        own = windows[low:low + n - 4] if n >= 5 else windows[:0]
        total = max(1.0, by_class[k].sum())
        out[k] = (np.log1p(n), (total - by_class[k, 0] - by_class[k, 1]) / size, by_class[k, 5] / size,
                  by_class[k, 3] / max(1.0, letters[k]), by_class[k, 4] / total, by_class[k, 6] / size, by_class[k, 7] / total,
                  n_lines / size, len(shingles.distinct(hashes[low:low + n])) / size, equal[k] / size,
                  1 - len(shingles.distinct(own)) / len(own) if len(own) else 0.0,
                  1 - len(shingles.distinct(line_hashes[line:line + n_lines])) / n_lines if n_lines else 0.0,
                  by_class[k, 8] / size, n_loud[k] / size)
        low, line = low + n, line + n_lines
    return out


def _tree(grad: np.ndarray, weight: np.ndarray, depth: int, ridge: float = 1.0) -> np.ndarray:
    """Leaf values over ordered bins of a tree with 2 ** depth leaves at most."""
    value = np.full(len(grad), grad.sum() / (weight.sum() + ridge))
    if depth and len(grad) > 1:
        g, w = np.cumsum(grad)[:-1], np.cumsum(weight)[:-1]
        gain = g ** 2 / (w + ridge) + (grad.sum() - g) ** 2 / (weight.sum() - w + ridge)
        cut = int(gain.argmax()) + 1
        value[:cut], value[cut:] = _tree(grad[:cut], weight[:cut], depth - 1), _tree(grad[cut:], weight[cut:], depth - 1)
    return value


def _square(grad: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """A tree over two features' bins: the best cut of the first, then one of the second on either side; and its gain."""
    best, value = -1.0, np.zeros_like(grad)
    for cut in range(1, len(grad)):
        parts, gain = np.empty_like(grad), 0.0
        for rows in (slice(0, cut), slice(cut, None)):
            g, w = grad[rows].sum(0), weight[rows].sum(0)
            leaf = _tree(g, w, 1)
            parts[rows] = leaf
            gain += float((2 * leaf * g - leaf ** 2 * (w + ridge / len(g))).sum())
        if gain > best:
            best, value = gain, parts
    return value, best


@dataclass
class Model:
    """start + sum of tables; edges cut a feature into bins, pairs use every fourth edge."""

    edges: list[np.ndarray]
    start: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)], 1)

    def coarse(self, k: int) -> np.ndarray:
        return self.edges[k][::4]

    def raw(self, x: np.ndarray) -> np.ndarray:
        at = self.bins(x)
        out = np.full(len(x), self.start)
        for k, table in enumerate(self.tables):
            out += table[at[:, k]]
        for (i, j), table in self.pairs.items():
            out += table[np.searchsorted(self.coarse(i), x[:, i], "right"), np.searchsorted(self.coarse(j), x[:, j], "right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.15, n_pairs: int = 6, n_bins: int = 32) -> Model:
    share = float(y.mean()) if len(y) else 0.5
    # all distinct values of rare features count for the cuts, so that a mass at zero does not take every quantile
    edges = [np.unique(np.quantile(np.unique(x[:, k]), np.linspace(0, 1, n_bins + 1)[1:-1])) for k in range(x.shape[1])] if len(x) else [np.zeros(0)] * len(FEATURES)
    model = Model(edges, float(np.log((share + 1e-6) / (1 - share + 1e-6))), [np.zeros(len(e) + 1) for e in edges])
    if share in (0.0, 1.0) or not len(y):
        return model
    at, f = model.bins(x), np.full(len(y), model.start)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-f))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for k, table in enumerate(model.tables):
            g, w = slopes()
            size = len(table)
            step = rate * _tree(np.bincount(at[:, k], g, size), np.bincount(at[:, k], w, size), 2)
            table += step
            f += step[at[:, k]]
    near = [np.searchsorted(model.coarse(k), x[:, k], "right") for k in range(x.shape[1])]

    def histogram(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shape = len(model.coarse(i)) + 1, len(model.coarse(j)) + 1
        cell = near[i] * shape[1] + near[j]
        g, w = slopes()
        return (np.bincount(cell, g, shape[0] * shape[1]).reshape(shape), np.bincount(cell, w, shape[0] * shape[1]).reshape(shape), cell)

    gains = sorted(((-_square(*histogram(i, j)[:2])[1], i, j) for i in range(x.shape[1]) for j in range(i)))
    for _, i, j in gains[:n_pairs]:
        model.pairs[i, j] = np.zeros((len(model.coarse(i)) + 1, len(model.coarse(j)) + 1))
    for _ in range(rounds // 4):
        for (i, j), table in model.pairs.items():
            g, w, cell = histogram(i, j)
            step = rate * _square(g, w)[0]
            table += step
            f += step.ravel()[cell]
    return model


def fold(key: str, folds: int) -> str:
    """SQL: crc32 of the id as text, modulo folds; a null id counts as an empty text."""
    return f"CAST(crc32(CAST(coalesce(CAST({key} AS STRING), '') AS BINARY)) % {folds} AS INT)"


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and x, the features of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in bpe.slices(batch, text):
                x = np.concatenate([features(t) for t in shingles.runs(texts)])
                yield pa.RecordBatch.from_arrays([rows.column(key), pa.ListArray.from_arrays(
                    pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))], names=["doc_id", "x"])

    return docs.select(key, text).mapInArrow(run, f"doc_id {docs.schema[key].dataType.simpleString()}, x array<double>")


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text",
             fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score (label 1 likelier when higher), predicted."""
    rows = stored(measured(docs, key, text), "gam-features")
    known = labels.filter(f"`{label}` IS NOT NULL AND {fold(key, FOLDS)} != {HELD_FOLD}").select(
        F.col(key).alias("_key"), F.col(label).cast("int").alias("y"))
    sample = (rows.join(known, F.col("doc_id") == F.col("_key")).orderBy(F.xxhash64("doc_id"), "doc_id", "y")
              .limit(fit_rows).select("x", "y").toArrow())
    x = np.array(sample.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    model = docs.sparkSession.sparkContext.broadcast(fit(x, sample.column("y").to_numpy().astype(float)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.value.score(x))], names=["doc_id", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, score double").selectExpr(
        "doc_id", f"{fold('doc_id', FOLDS)} = {HELD_FOLD} AS held_out", "score", f"CASE WHEN score >= {CUT} THEN 1 ELSE 0 END AS predicted")
