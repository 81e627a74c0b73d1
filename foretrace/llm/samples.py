"""Labelled rows that classifiers are fitted on: a bounded sample, always the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foretrace.llm.common import sampled


def labelled_texts(docs: DataFrame, labels: DataFrame, names: list[str], rows: int, usable: Column, text: str = "text") -> DataFrame:
    """doc_id, text and the labels of at most ``rows`` documents.

    Rows with a null id or label don't count; an id labelled or stored several
    times counts once, with its largest labels. The chosen ids are broadcast,
    at most ``rows`` of them.
    """
    clean = labels.where(usable & F.col("doc_id").isNotNull()).dropna(subset=names)
    chosen = sampled(clean.groupBy("doc_id").agg(*[F.max(n).alias(n) for n in names]), rows, "doc_id")
    texts = docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id")
    return texts.dropDuplicates(["doc_id"])
