r"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.
The probability of a word is the sum over all ways to cut it into pieces of the
product of their probabilities, which a forward pass over the word's characters
gives. A text's score per language is the product over its words.

Piece probabilities come from a bounded sample of texts with a known language
by expectation maximisation: forward and backward passes give the expected use
of every piece, summed per language. Expected counts are made in tasks over
distinct words and summed by (language, piece); the driver gets a table of
vocabulary times languages.

Words are runs of letters, lower-cased, with the vocabulary's word mark. Runs of
more than 40 letters are summed in logarithms, as their probabilities are too
small for numbers; the work is linear in their length, since pieces have a
longest size. A character outside the
vocabulary is a piece of small probability. The score of the best language is
its posterior with the evidence of long texts tempered to that of 30 words, for
which every 40 letters of a run count as one.

Defined results: ``und`` and score 0 for a null text or one without letters, or
where no language was learned; equal scores go to the language that sorts
first; repeated rows get equal results.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from foretrace.llm.common import arrow_columns, sampled
from foretrace.session import pin, ship_by_value

ship_by_value(__name__)

SAMPLE_ROWS = 3000
ROUNDS = 2
# Longer runs are summed in logarithms.
LONGEST_WORD = 40
TEMPERED_WORDS = 30
# Words whose probabilities a task keeps from batch to batch before it starts anew.
KEPT_WORDS = 100_000
KEPT_LETTERS = 2_000_000
# Places that words of one length are looked up for at once.
SPANS = 250_000
# Distinct words that one task of a round of the fit is meant for.
WORDS_PER_TASK = 20_000
UNKNOWN = 1e-9
MARK = "▁"
LETTERS = re.compile(r"[^\W\d_]+")
NONE = "und"


def vocabulary(path: str) -> list[str]:
    """The ordinary pieces of a model file, without control, unknown and byte pieces."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


def words_of(text: str) -> list[str]:
    """Lower-case words of a text, the word mark in front; none if it has no letter."""
    runs = LETTERS.findall(text.lower())
    if not any(c.isalpha() for r in runs for c in r):
        return []
    return [MARK + r for r in runs]


def is_long(word: str) -> bool:
    return len(word) > LONGEST_WORD + len(MARK)


def weight_of(word: str) -> int:
    """Words that a run counts as."""
    return -(-(len(word) - len(MARK)) // LONGEST_WORD)


class Lattice:
    """All pieces of a batch of words by length, to pass over many words at once."""

    def __init__(self, pieces: list[str]):
        self.ids = {p: i for i, p in enumerate(pieces)}
        self.unknown = len(pieces)
        self.longest = max(map(len, pieces), default=1)

    def groups(self, words: list[str]):
        """(indices, ids) of words of one length; ids[n, start, size - 1] is a piece or -1."""
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_length.setdefault(len(w), []).append(i)
        get = self.ids.get
        for length, indices in by_length.items():
            sizes = min(self.longest, length)
            spans = [(s, s + k) for s in range(length) for k in range(1, min(sizes, length - s) + 1)]
            most = max(1, SPANS // len(spans))
            for at in range(0, len(indices), most):
                some = indices[at:at + most]
                flat = np.array([get(words[i][a:b], -1) for i in some for a, b in spans], np.int32).reshape(len(some), len(spans))
                table = np.full((len(some), length, sizes), -1, np.int32)
                for column, (a, b) in enumerate(spans):
                    table[:, a, b - a - 1] = flat[:, column]
                first = table[:, :, 0]
                first[first < 0] = self.unknown
                yield np.array(some), table

    def forward(self, table: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Probabilities of all beginnings; p has a row per piece (the last two: unknown, none)."""
        n, length, sizes = table.shape
        ahead = np.zeros((length + 1, n, p.shape[1]))
        ahead[0] = 1
        for end in range(1, length + 1):
            for k in range(1, min(sizes, end) + 1):
                ids = table[:, end - k, k - 1]
                if (ids >= 0).any():
                    ahead[end] += ahead[end - k] * p[ids]
        return ahead

    def pieces_of(self, word: str) -> np.ndarray:
        """ids[start, size - 1] of one word, as in ``groups``."""
        length, get = len(word), self.ids.get
        table = np.full((length, min(self.longest, length)), -1, np.int32)
        for k in range(1, table.shape[1] + 1):
            table[:length - k + 1, k - 1] = np.fromiter((get(word[s:s + k], -1) for s in range(length - k + 1)), np.int32, length - k + 1)
        first = table[:, 0]
        first[first < 0] = self.unknown
        return table

    def log_forward(self, ids: np.ndarray, logs: np.ndarray) -> np.ndarray:
        """Log probabilities of all beginnings of one word; ``logs`` has the logarithms of ``forward``'s p."""
        length, sizes = ids.shape
        ahead = np.zeros((length + 1, logs.shape[1]))
        for end in range(1, length + 1):
            k = np.arange(1, min(sizes, end) + 1)
            parts = ahead[end - k] + logs[ids[end - k, k - 1]]
            most = parts.max(0)
            ahead[end] = most + np.log(np.exp(parts - most).sum(0))
        return ahead

    def log_expected(self, word: str, logs: np.ndarray, times: float) -> np.ndarray:
        """``expected`` of one long word."""
        ids = self.pieces_of(word)
        length, sizes = ids.shape
        ahead, behind = self.log_forward(ids, logs)[:, 0], np.zeros(length + 1)
        for start in range(length - 1, -1, -1):
            k = np.arange(1, min(sizes, length - start) + 1)
            parts = behind[start + k] + logs[ids[start, k - 1], 0]
            behind[start] = parts.max() + np.log(np.exp(parts - parts.max()).sum())
        uses = np.zeros(self.unknown + 2)
        for k in range(1, sizes + 1):
            some = ids[:length - k + 1, k - 1]
            part = np.exp(ahead[:length - k + 1] + logs[some, 0] + behind[k:] - ahead[length]) * times
            uses += np.bincount(some + 1, weights=part, minlength=len(uses) + 1)[1:len(uses) + 1]
        return uses

    def log_words(self, words: list[str], p: np.ndarray) -> np.ndarray:
        """Log probabilities of words, a row each."""
        out = np.zeros((len(words), p.shape[1]))
        short = [i for i, w in enumerate(words) if not is_long(w)]
        for some, table in self.groups([words[i] for i in short]):
            out[[short[i] for i in some]] = np.log(np.maximum(self.forward(table, p)[-1], 1e-300))
        if len(short) < len(words):
            logs = logarithms(p)
            for i, w in enumerate(words):
                if is_long(w):
                    out[i] = self.log_forward(self.pieces_of(w), logs)[-1]
        return out

    def expected(self, table: np.ndarray, p: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Expected uses of each piece, one language's words weighted by ``times``."""
        n, length, sizes = table.shape
        ahead, behind = self.forward(table, p)[:, :, 0], np.zeros((length + 1, n))
        behind[length] = 1
        for start in range(length - 1, -1, -1):
            for k in range(1, min(sizes, length - start) + 1):
                behind[start] += behind[start + k] * p[table[:, start, k - 1], 0]
        used, parts = [], []
        for start in range(length):
            for k in range(1, min(sizes, length - start) + 1):
                ids = table[:, start, k - 1]
                held = np.flatnonzero(ids >= 0)
                ids = ids[held]
                used.append(ids)
                parts.append(ahead[start, held] * p[ids, 0] * behind[start + k, held] / np.maximum(ahead[length, held], 1e-300) * times[held])
        return np.bincount(np.concatenate(used), weights=np.concatenate(parts), minlength=self.unknown + 2)


def padded(p: np.ndarray) -> np.ndarray:
    """Piece probabilities with rows for the unknown piece and, at -1, for none."""
    return np.vstack([p, np.full((1, p.shape[1]), UNKNOWN), np.zeros((1, p.shape[1]))])


def logarithms(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log(p)


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, word, n) of distinct words per language."""
    schema = StructType([StructField("lang", StringType()), StructField("word", StringType()), StructField("n", LongType())])

    def count(batches):
        for batch in batches:
            counts: dict[tuple[str, str], int] = {}
            for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                for w in words_of(text or ""):
                    counts[lang, w] = counts.get((lang, w), 0) + 1
            yield pa.RecordBatch.from_pydict({"lang": pa.array([k[0] for k in counts], pa.string()), "word": pa.array([k[1] for k in counts], pa.string()), "n": pa.array(counts.values(), pa.int64())})

    return texts.select("lang", "text").mapInArrow(count, schema).groupBy("lang", "word").agg(F.sum("n").alias("n"))


def expected_uses(counts: DataFrame, shared, languages: list[str]) -> np.ndarray:
    """Expected uses of pieces by language under the current probabilities."""
    schema = StructType([StructField("lang", StringType()), StructField("piece", LongType()), StructField("uses", DoubleType())])

    def make(batches):
        pieces, p = shared.value
        lattice = Lattice(pieces)
        for batch in batches:
            lang, word, n = (c.to_pylist() for c in batch.columns)
            for i, one in enumerate(languages):
                mine = [j for j, x in enumerate(lang) if x == one]
                uses = np.zeros(len(pieces) + 2)
                long, mine = [j for j in mine if is_long(word[j])], [j for j in mine if not is_long(word[j])]
                for some, table in lattice.groups([word[j] for j in mine]):
                    uses += lattice.expected(table, padded(p[:, [i]]), np.array([n[mine[s]] for s in some], float))
                logs = logarithms(padded(p[:, [i]]))
                for j in long:
                    uses += lattice.log_expected(word[j], logs, n[j])
                at = np.flatnonzero(uses[:len(pieces)])
                yield pa.RecordBatch.from_pydict({"lang": pa.array([one] * len(at), pa.string()), "piece": pa.array(at, pa.int64()), "uses": pa.array(uses[at], pa.float64())})

    rows = counts.mapInArrow(make, schema).groupBy("lang", "piece").agg(F.sum("uses").alias("uses")).toArrow()
    found = np.zeros((len(shared.value[0]), len(languages)))
    place = {x: i for i, x in enumerate(languages)}
    if rows.num_rows:
        found[rows["piece"].to_numpy(), [place[x] for x in rows["lang"].to_pylist()]] = rows["uses"].to_numpy()
    return found


def fitted(docs: DataFrame, pieces: list[str], usable: Column, text: str = "text", sample_rows: int = SAMPLE_ROWS, rounds: int = ROUNDS) -> dict | None:
    """Languages, priors and piece probabilities of a bounded sample; None without rows."""
    known = docs.where(usable & F.col("lang").isNotNull() & F.col(text).isNotNull())
    texts = pin(sampled(known.select("doc_id", F.col(text).alias("text"), "lang"), sample_rows, "doc_id", "text"))
    shares = {r["lang"]: r["n"] for r in texts.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not shares:
        return None
    languages = sorted(shares)
    counts = pin(word_counts(texts))
    # The words are few bytes and much work: their number, not their size, says how many tasks share them.
    counts = pin(counts.repartition(max(1, -(-counts.count() // WORDS_PER_TASK)), "word"))
    p = np.full((len(pieces), len(languages)), 1 / len(pieces))
    for _ in range(rounds):
        shared = docs.sparkSession.sparkContext.broadcast((pieces, p))
        uses = expected_uses(counts, shared, languages) + 0.01
        p = uses / uses.sum(0)
    prior = np.array([shares[x] for x in languages], float)
    return {"languages": languages, "prior": np.log(prior / prior.sum()), "pieces": pieces, "p": p}


def predict(docs: DataFrame, model: dict | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default: all), ``lang_pred`` and ``score``."""
    keep = docs.columns if keep is None else keep
    if model is None:
        kept = [f"`{c}`" for c in keep if c.lower() not in ("lang_pred", "score")]
        return docs.select(*kept, F.lit(NONE).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    column = docs.columns.index(text)

    def prepare():
        m = shared.value
        lattice, p = Lattice(m["pieces"]), padded(m["p"])
        ids: dict[str, int] = {}
        logs, weights, letters = np.zeros((0, p.shape[1])), np.zeros(0), 0

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            nonlocal ids, logs, weights, letters
            if len(ids) > KEPT_WORDS or letters > KEPT_LETTERS:
                ids, logs, weights, letters = {}, logs[:0], weights[:0], 0
            known = len(ids)
            texts = [np.array([ids.setdefault(w, len(ids)) for w in words_of(t.as_py() or "")], np.int64) for t in batch.column(column)]
            fresh = list(ids)[known:]
            logs = np.vstack([logs, lattice.log_words(fresh, p)])
            weights = np.append(weights, [weight_of(w) for w in fresh])
            letters += sum(map(len, fresh))
            langs, scores = [], []
            for words in texts:
                if not len(words):
                    langs.append(NONE)
                    scores.append(0.0)
                    continue
                evidence = logs[words].sum(0) + m["prior"]
                tempered = evidence * min(1.0, TEMPERED_WORDS / weights[words].sum())
                posterior = np.exp(tempered - tempered.max())
                best = int(np.argmax(evidence))
                langs.append(m["languages"][best])
                scores.append(float(posterior[best] / posterior.sum()))
            return [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]

        return work

    return arrow_columns(docs, keep, [StructField("lang_pred", StringType()), StructField("score", DoubleType())], prepare, gathered=True)
