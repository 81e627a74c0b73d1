"""Toxicity by a classifier chain.

Categories are predicted one after the other. A linear (logistic) model sees
which words and word beginnings a text holds, and the probabilities of the
categories before it. While fitting, those probabilities are out-of-fold: each
document's comes from a model that didn't see it; the final models see all.

Features are 64-bit hashes of words without punctuation, A-Z lower-cased, and
of their first 4 and 5 bytes. A model keeps those that tell most about its
category in the sample (by the size of their log odds against its standard
error), so what is broadcast is bounded by ``features`` and the categories. The
sample is bounded by ``labelled_rows``. Every document is scored over its whole
text.

Defined results: null and empty texts have no feature and get the probability
of the bias and the chain; without labelled rows probabilities are 0; a
category that has one value in the sample gets that value's smoothed share;
repeated rows get equal results; columns of the results' names are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.types import BinaryType, DoubleType, StructField

from foretrace.llm.common import arrow_columns
from foretrace.llm.samples import labelled_texts
from foretrace.llm.shingles import IS_SPACE, MULTIPLIERS, PLACES, U64, mixed, word_parts
from foretrace.session import ship_by_value

ship_by_value(__name__)

LABELLED_ROWS = 6000
FEATURES = 3000
FOLDS = 4
BEGINNINGS = (4, 5)
# Everything in ASCII that is no letter becomes a space.
PLAIN = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def text_features(text: str) -> np.ndarray:
    """Sorted distinct feature hashes of a text."""
    found = [np.empty(0, U64)]
    for part in word_parts(text.encode().lower().translate(PLAIN)):
        raw = np.frombuffer(part, np.uint8)
        solid = np.flatnonzero(~IS_SPACE[raw])
        if not len(solid):
            continue
        starts = np.flatnonzero(np.diff(solid, prepend=-2) > 1)
        lengths = np.diff(starts, append=len(solid))
        place = np.arange(len(solid)) - np.repeat(starts, lengths)
        value = (raw[solid].astype(U64) + U64(1)) * MULTIPLIERS[place % PLACES]
        whole = mixed(np.add.reduceat(value, starts) + lengths.astype(U64))
        found.append(np.unique(whole))
        for k in BEGINNINGS:
            begin = np.add.reduceat(np.where(place < k, value, U64(0)), starts)[lengths > k]
            found.append(np.unique(mixed(begin + U64(1000 + k))))
    return np.unique(np.concatenate(found))


def present(vocabulary: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Places in a sorted vocabulary of the features that it holds."""
    if not len(vocabulary) or not len(features):
        return np.empty(0, np.int64)
    at = np.minimum(np.searchsorted(vocabulary, features), len(vocabulary) - 1)
    return at[vocabulary[at] == features]


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def chosen_features(rows: np.ndarray, values: np.ndarray, y: np.ndarray, features: int) -> np.ndarray:
    """Sorted hashes of the features with the largest log odds per standard error."""
    names, at = np.unique(values, return_inverse=True)
    held = np.bincount(at, minlength=len(names)) + 1.0
    hit = np.bincount(at, weights=y[rows], minlength=len(names)) + 0.5
    base, total = y.sum() + 0.5, len(y) + 1.0
    odds = np.log(hit / (held - hit)) - np.log(base / (total - base))
    worth = np.abs(odds) / np.sqrt(1 / hit + 1 / (held - hit))
    worth[held < 4] = 0
    best = np.argsort(-worth, kind="stable")[:features]
    return np.sort(names[best[worth[best] > 2]])


def fit_linear(rows: np.ndarray, values: np.ndarray, extra: np.ndarray, y: np.ndarray, features: int, penalty: float = 1.0, steps: int = 150) -> dict:
    """Logistic model of present features, extra columns and a bias, by accelerated gradient descent."""
    vocabulary = chosen_features(rows, values, y, features)
    at = np.minimum(np.searchsorted(vocabulary, values), max(len(vocabulary) - 1, 0))
    known = vocabulary[at] == values if len(vocabulary) else np.zeros(len(values), bool)
    r, c, n, k = rows[known], at[known], len(y), len(vocabulary)
    extra = np.hstack([extra, np.ones((n, 1))])
    penalties = np.concatenate([np.full(k + extra.shape[1] - 1, penalty), [0.0]])
    per_row = np.bincount(r, minlength=n)
    step = 1.0 / (0.25 * max(1.0, np.percentile(np.bincount(c, minlength=max(k, 1)), 99.5), n / 4) * max(1.0, np.median(per_row) / 4) + penalty)
    w = np.zeros(k + extra.shape[1])
    w[-1] = np.log((y.sum() + 0.5) / (n - y.sum() + 0.5))
    before, t = w, 1.0

    def loss_and_gradient(v):
        margin = np.bincount(r, weights=v[c], minlength=n) + extra @ v[k:]
        p = sigmoid(margin)
        loss = np.sum(np.logaddexp(0, margin) - y * margin) + 0.5 * np.sum(penalties * v * v)
        return loss, np.concatenate([np.bincount(c, weights=(p - y)[r], minlength=k)[:k], extra.T @ (p - y)]) + penalties * v

    for _ in range(steps):
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = w + (t - 1) / t_next * (w - before)
        loss, slope = loss_and_gradient(ahead)
        while True:
            moved = ahead - step * slope
            if loss_and_gradient(moved)[0] <= loss - 0.5 * step * np.sum(slope * slope) or step < 1e-9:
                break
            step /= 2
        before, w, t, step = w, moved, t_next, step * 1.2
    return {"vocabulary": vocabulary, "weights": w[:k], "extra": w[k:-1], "bias": w[-1]}


def probability(model: dict, features: np.ndarray, extra: np.ndarray) -> float:
    return float(sigmoid(model["weights"][present(model["vocabulary"], features)].sum() + model["extra"] @ extra + model["bias"]))


def fit_chain(sets: list[np.ndarray], labels: np.ndarray, features: int = FEATURES, folds: int = FOLDS) -> list[dict]:
    """One model per category; each saw out-of-fold probabilities of those before."""
    n = len(sets)
    rows, values = np.repeat(np.arange(n), [len(s) for s in sets]), np.concatenate(sets)
    fold, chain, models = np.arange(n) % min(folds, n), np.empty((n, 0)), []
    for category in range(labels.shape[1]):
        y = labels[:, category].astype(float)
        models.append(fit_linear(rows, values, chain, y, features))
        if category + 1 < labels.shape[1]:
            outside = np.zeros(n)
            for f in range(fold.max() + 1):
                train = np.flatnonzero(fold != f)
                if not len(train):
                    continue
                place = np.full(n, -1)
                place[train] = np.arange(len(train))
                inside = place[rows] >= 0
                model = fit_linear(place[rows[inside]], values[inside], chain[train], y[train], features)
                for i in np.flatnonzero(fold == f):
                    outside[i] = probability(model, sets[i], chain[i])
            chain = np.hstack([chain, outside[:, None]])
    return models


def fitted(docs: DataFrame, labels: DataFrame, categories: list[str], usable: Column, text: str = "text", labelled_rows: int = LABELLED_ROWS) -> list[dict]:
    """The chain of a bounded sample of labelled rows, categories in order; empty without any."""
    chosen = labelled_texts(docs, labels, categories, labelled_rows, usable, text)
    column = chosen.columns.index("text")

    def prepare():
        return lambda batch: [pa.array((text_features(t.as_py() or "").tobytes() for t in batch.column(column)), pa.binary())]

    rows = arrow_columns(chosen, ["doc_id", *categories], [StructField("features", BinaryType())], prepare).toArrow().sort_by("doc_id")
    if not rows.num_rows:
        return []
    sets = [np.frombuffer(f.as_py(), U64) for f in rows["features"]]
    return fit_chain(sets, np.stack([rows[c].to_numpy() for c in categories], axis=1))


def score(docs: DataFrame, chain: list[dict], names: list[str], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default: all) and each category's probability under ``names``."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    column = docs.columns.index(text)

    def prepare():
        def chained(features):
            found = np.empty(0)
            for model in shared.value:
                found = np.append(found, probability(model, features, found))
            return found if len(found) else np.zeros(len(names))

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            p = np.array([chained(text_features(t.as_py() or "")) for t in batch.column(column)]).reshape(-1, len(names))
            return [pa.array(p[:, i], pa.float64()) for i in range(len(names))]

        return work

    return arrow_columns(docs, docs.columns if keep is None else keep, [StructField(n, DoubleType()) for n in names], prepare)
