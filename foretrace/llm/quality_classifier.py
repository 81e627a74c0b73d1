"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors.

A text becomes hashed byte trigrams, weighted by log frequency and the inverse
document frequency of the labelled sample, beside soft bins of ratios (upper
case, symbols, distinct words and pairs, word length, line length). The
labelled vectors' largest right singular vectors span the latent space. Every
document is projected; its cosines with all labelled vectors are computed in
blocks, exactly, and the labels of the nearest vote with a power of their
similarity, each label's votes divided by its share of the sample.

The sample is bounded by ``labelled_rows``; its vectors (rows times dimensions)
are what is broadcast, and one task fits them. Every document is scored over its whole text.

Defined results: null and empty texts have a zero trigram vector and are scored
by their bins; ties of similarity are settled by the sample's order (by id);
without labelled rows every score is 0.5; repeated rows get equal scores.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, StructField

from foretrace.llm.common import arrow_columns
from foretrace.llm.samples import labelled_texts
from foretrace.llm.shingles import U64, hashed_words, mixed, word_parts
from foretrace.session import ship_by_value

ship_by_value(__name__)

LABELLED_ROWS = 4000
TRIGRAMS = 2048
DIMENSIONS = 64
NEIGHBOURS = 25
POWER = 8
BLOCK = 256
BINS = np.linspace(0, 1, 9)
KINDS = np.zeros((5, 256), bool)
KINDS[0, 65:91] = True
KINDS[1, 97:123] = True
KINDS[1, 128:] = True
KINDS[2, [ord(c) for c in "#*$%&|<>!@^~=_{}[]\\/+"]] = True
KINDS[3, 48:58] = True
KINDS[4, [ord(c) for c in ".,;:?'\"-()"]] = True


def ratios(data: bytes, trigrams: np.ndarray) -> np.ndarray:
    """Ratios between 0 and 1 that describe a text; also counts its trigrams."""
    kinds, counts, pairs, chars, n = np.zeros(5), [], [], 0, 0
    for part in word_parts(data):
        raw = np.frombuffer(part, np.uint8)
        kinds += [np.count_nonzero(k[raw]) for k in KINDS]
        if len(raw) > 2:
            code = raw[:-2].astype(np.uint32) << 16 | raw[1:-1].astype(np.uint32) << 8 | raw[2:]
            trigrams += np.bincount((code * np.uint32(2654435761)) >> np.uint32(21), minlength=TRIGRAMS)
        words = hashed_words(part)
        n += len(words)
        chars += len(raw)
        counts.append(words)
        pairs.append(np.unique(words[:-1] * U64(3) + mixed(words[1:])))
    if not n:
        return np.zeros(8)
    distinct, times = np.unique(np.concatenate(counts), return_counts=True)
    solid = max(1.0, kinds.sum())
    lines = data.count(b"\n") + 1
    return np.array([
        kinds[0] / solid, min(1.0, kinds[2] / n), kinds[3] / solid, min(1.0, kinds[4] / n),
        sum(map(len, pairs)) / max(1, n - 1), times.max() / n, min(1.0, chars / n / 16), min(1.0, np.log1p(n / lines) / 6),
    ])


def bins(values: np.ndarray) -> np.ndarray:
    """Each value's nearness to evenly spaced centres, linear between two of them."""
    return np.maximum(0, 1 - np.abs(values[:, None] - BINS) * (len(BINS) - 1)).ravel()


def raw_vector(text: str) -> np.ndarray:
    """Trigram counts followed by binned ratios."""
    trigrams = np.zeros(TRIGRAMS)
    described = bins(ratios(text.encode(), trigrams))
    return np.concatenate([trigrams, described]).astype(np.float32)


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


def weighted(raw: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit trigram vectors and unit ratio vectors side by side."""
    return np.hstack([0.6 * unit(np.log1p(raw[:, :TRIGRAMS]) * idf), 0.8 * unit(raw[:, TRIGRAMS:])]).astype(np.float32)


def fit(raw: np.ndarray, labels: np.ndarray, dimensions: int = DIMENSIONS) -> dict:
    """Latent space of labelled raw vectors, their places in it and their labels.

    Rows are weighted a block at a time, so the driver holds the sample and its
    weighted form, but no temporary copies of them in double precision.
    """
    blocks = range(0, len(raw), BLOCK)
    idf = np.log((1 + len(raw)) / (1 + sum((raw[at:at + BLOCK, :TRIGRAMS] > 0).sum(0) for at in blocks)))
    x = np.empty(raw.shape, np.float32)
    for at in blocks:
        x[at:at + BLOCK] = weighted(raw[at:at + BLOCK], idf)
    # Right singular vectors, from the matrix of inner products of columns.
    basis = np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :dimensions].copy()
    return {"idf": idf, "basis": basis, "vectors": unit(x @ basis), "labels": labels.astype(np.float64)}


def vote(model: dict, raw: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """Scores 0 to 1 of raw vectors: similarity-weighted labels of their nearest labelled vectors."""
    vectors, labels = model["vectors"], model["labels"]
    near = min(neighbours, len(vectors))
    share = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    scores = []
    for at in range(0, len(raw), BLOCK):
        cosine = unit(weighted(raw[at:at + BLOCK], model["idf"]) @ model["basis"]) @ vectors.T
        best = np.argpartition(-cosine, near - 1, axis=1)[:, :near]
        weight = np.maximum(np.take_along_axis(cosine, best, 1), 1e-6).astype(np.float64) ** POWER
        good = (weight * labels[best]).sum(1) / share
        bad = (weight * (1 - labels[best])).sum(1) / (1 - share)
        scores.append(good / (good + bad))
    return np.concatenate(scores)


def fitted(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality", text: str = "text", labelled_rows: int = LABELLED_ROWS) -> dict | None:
    """The model of a bounded sample of labelled rows; None without any."""
    chosen = labelled_texts(docs, labels, [label], labelled_rows, usable, text)
    column = chosen.columns.index("text")

    def prepare():
        return lambda batch: [pa.array((raw_vector(t.as_py() or "").tobytes() for t in batch.column(column)), pa.binary())]

    rows = arrow_columns(chosen, ["doc_id", label], [StructField("raw", BinaryType())], prepare)

    def learn(batches):
        held = [b for b in batches if b.num_rows]
        if held:
            sample = pa.Table.from_batches(held)
            sample = sample.take(pc.sort_indices(sample.select(["doc_id"]), sort_keys=[("doc_id", "ascending")]))
            raw = np.stack([np.frombuffer(r.as_buffer(), np.float32) for r in sample["raw"]])
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(raw, sample[label].to_numpy()))], pa.binary())], names=["model"])

    # The sample is bounded, but it and its products are far larger than the model: a task works on them, not the driver.
    found = rows.repartition(1).mapInArrow(learn, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else None


def score(docs: DataFrame, model: dict | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default: all) and ``score`` of every document."""
    keep = docs.columns if keep is None else keep
    if model is None:
        return docs.select(*[f"`{c}`" for c in keep if c.lower() != "score"], F.lit(0.5).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    column = docs.columns.index(text)

    def prepare():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            scores, rows = [np.empty(0)], batch.num_rows
            for at in range(0, rows, BLOCK):
                raw = np.stack([raw_vector(t.as_py() or "") for t in batch.column(column).slice(at, BLOCK)])
                scores.append(vote(shared.value, raw))
            return [pa.array(np.concatenate(scores), pa.float64())]

        return work

    return arrow_columns(docs, keep, [StructField("score", DoubleType())], prepare)
