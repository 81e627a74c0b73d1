"""Corpus pipeline: quality, language, near duplicates, mixing, tokens.

Each stage is one operator over all that the stage before kept, written as
Parquet and read again. ORACLE_SQL is None: the classifier, the language model
and the tokenizer have no SQL form. Tests hold near duplicates, mixture and
tokens against plain versions on small tables, and the vote and the sum over
segmentations that the first two stages rest on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foretrace.llm import byte_bpe, jaccard_join, language_id, mixing, quality_classifier
from foretrace.llm.common import prepare, remainder
from foretrace.llm.queries import CURRICULUM, table
from foretrace.session import fresh_path

ACCEPTED_QUALITY = 0.3
ACCEPTED_LANGUAGE = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the accepted quality."""
    prepare(spark)
    labels = table(spark, sf_dir, "labels")
    model = quality_classifier.fitted(docs, labels, remainder(F.col("doc_id"), 5) != 0)
    scored = quality_classifier.score(renamed(docs, "score"), model)
    return scored.where(F.col("score") >= ACCEPTED_QUALITY).drop("score").toDF(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is recognised with some certainty."""
    import public_tokenizers

    prepare(spark)
    pieces = language_id.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    model = language_id.fitted(docs, pieces, remainder(F.col("doc_id"), 4) != 2)
    found = language_id.predict(renamed(docs, "lang_pred", "score"), model)
    kept = (F.col("lang_pred") != language_id.NONE) & (F.col("score") >= ACCEPTED_LANGUAGE)
    return found.where(kept).drop("lang_pred", "score").toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, 80 percent."""
    prepare(spark)
    return jaccard_join.one_of_each(docs, width=5, percent=80)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, each whole, in training order."""
    mixed = mixing.mix(renamed(docs, "size", "source_size", "target", "taken", "takes", "words", "position"), CURRICULUM)
    return mixing.training_order(mixed, whole=True).drop("size", "source_size", "target", "words", "position").toDF(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, decoded again, as counts and digests beside the id."""
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    prepare(spark)
    return byte_bpe.digests(byte_bpe.code_documents(docs.select("doc_id", "text"), path, pattern, keep=["doc_id"]))


def renamed(docs: DataFrame, *results: str) -> DataFrame:
    """Columns that share a result's name under another one, in place; stages name them back."""
    return docs.toDF(*[f"_own_{c}" if c.lower() in results else c for c in docs.columns])


STAGES = [("quality", quality), ("language", language), ("near_duplicates", near_duplicates), ("mixture", mixture), ("tokens", tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each keeps is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
