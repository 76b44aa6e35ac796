"""Language of each word of a text by a linear-chain conditional random field.

Words are runs of letters. A word's features are the word itself, its affixes and inner
n-grams (hashed), and whether a lexicon made from the training texts gives it to one
language. Transitions between languages are learned with the feature weights by
stochastic gradient descent on the likelihood; forward-backward gives each word's
probabilities, so a text may change its language on the way. A document's language is the
one with the most words in expectation.

Chains are at most ``CHAIN`` words long. They are worked on side by side, so that memory
depends on the block of bytes and not on the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tallyframe.llm.common import LETTER_BYTES, hash_below, pieces, remainder, span_hashes, table, with_columns, word_spans

#: Training texts of each language, the bytes of each, and the languages, at most.
TRAIN_DOCS, TRAIN_BYTES, MOST_LANGUAGES = 300, 20_000, 200
TABLE_LOG2, LEXICON_LOG2 = 16, 16
AFFIXES = (1, 2, 3, 4)
CHAIN, EPOCHS, RATE, BATCH = 64, 2, 0.2, 128
FOLDS, HELD_OUT, UNKNOWN = 3, 1, "und"
LEXICON_LEAST, LEXICON_SHARE = 3, 0.9


def letters(text: bytes | None) -> bytes:
    """The text in lower case, with a space for everything of ASCII that is no letter."""
    if not text:
        return b""
    if not text.isascii():
        text = text.decode("utf-8", "replace").lower().encode("utf-8")
    return text.translate(LETTER_BYTES)


def has_letter(text: bytes | None) -> bool:
    if not text:
        return False
    if text.upper() != text or text.lower() != text:  # an ASCII letter
        return True
    return not text.isascii() and any(map(str.isalpha, text.decode("utf-8", "replace")))


def feature_rows(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words (by number) and table rows: the word, its affixes, its n-grams of three bytes."""
    hashes = span_hashes(data)
    shift = np.uint64(64 - TABLE_LOG2)

    def rows(values: np.ndarray, kind: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((values ^ np.uint64(kind * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xD6E8FEB86659FD93) >> shift).astype(np.int64)

    everyone = np.arange(len(starts))
    yield everyone, rows(hashes(starts, ends), 1)
    length = ends - starts
    for size in AFFIXES:
        long = everyone[length >= size]
        yield long, rows(hashes(starts[long], starts[long] + size), 1 + size)
        yield long, rows(hashes(ends[long] - size, ends[long]), 10 + size)
    owner = np.repeat(everyone, np.maximum(length - 2, 0))
    if len(owner):
        first = np.repeat(starts - np.r_[0, np.cumsum(np.maximum(length - 2, 0))[:-1]], np.maximum(length - 2, 0)) + np.arange(len(owner))
        yield owner, rows(hashes(first, first + 3), 30)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    weights: np.ndarray  # table row, language
    lexicon: np.ndarray  # 0: not listed, k + 1: of language k
    listed: np.ndarray  # lexicon entry, language
    transitions: np.ndarray  # language, next language

    def emissions(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        scores = self.listed[self.lexicon[lexicon_rows(data, starts, ends)]].astype(np.float64)
        for words, rows in feature_rows(data, starts, ends):
            for k in range(len(self.languages)):
                scores[:, k] += np.bincount(words, weights=self.weights[rows, k], minlength=len(starts))
        return scores

    def predict(self, texts: Iterable[bytes | None]) -> tuple[list[str], np.ndarray]:
        """Each text's language and the mean probability that its words are in it."""
        texts = list(texts)
        total = np.zeros((len(texts), max(1, len(self.languages))))
        count = np.zeros(len(texts))
        if self.languages:
            for data, at, owners in pieces(map(letters, texts)):
                starts, ends = word_spans(data)
                if not len(starts):
                    continue
                part = np.searchsorted(at, starts, side="right") - 1
                owner = np.array(owners)[part]
                chains = chain_table(part)
                chances = posteriors(self.emissions(data, starts, ends), self.transitions, chains)[0]
                for k in range(len(self.languages)):
                    total[:, k] += np.bincount(owner, weights=chances[:, k], minlength=len(texts))
                count += np.bincount(owner, minlength=len(texts))
        best = total.argmax(axis=1)
        known = np.array([has_letter(t) for t in texts], bool) & (count > 0)
        score = np.where(known, total[np.arange(len(texts)), best] / np.maximum(count, 1), 0.0)
        return [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, known)], np.clip(score, 0, 1)


def lexicon_rows(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return (span_hashes(data)(starts, ends) >> np.uint64(64 - LEXICON_LOG2)).astype(np.int64)


def chain_table(part: np.ndarray) -> np.ndarray:
    """Word numbers by chain and place in it, -1 beyond its end; a chain stays in one part of a text."""
    n = len(part)
    new = np.r_[True, part[1:] != part[:-1]]
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    place = (np.arange(n) - first) % CHAIN
    chain = np.cumsum(place == 0) - 1
    made = np.full((chain[-1] + 1, CHAIN), -1)
    made[chain, place] = np.arange(n)
    return made


def posteriors(emissions: np.ndarray, transitions: np.ndarray, chains: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over all chains at once.

    Gives each word's probabilities, the expected transitions and the number of words that
    follow another one. Values are scaled at each step, so long chains do not underflow.
    """
    count, length = chains.shape
    move = np.exp(transitions - transitions.max())
    real = chains >= 0
    emit = np.exp(emissions - emissions.max(axis=1, keepdims=True))
    local = np.where(real[:, :, None], emit[chains], 1.0)
    forward = np.empty_like(local)
    forward[:, 0] = local[:, 0] / local[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, length):
        step = (forward[:, t - 1] @ move) * local[:, t]
        forward[:, t] = step / step.sum(axis=1, keepdims=True)
    chances = np.empty_like(local)
    chances[:, -1] = forward[:, -1]
    backward = np.ones((count, local.shape[2]))
    pairs = np.zeros_like(transitions)
    for t in range(length - 1, 0, -1):
        ahead = local[:, t] * backward
        both = ahead / np.maximum(((forward[:, t - 1] @ move) * ahead).sum(axis=1, keepdims=True), 1e-300)
        going = real[:, t]
        pairs += move * (forward[going, t - 1].T @ both[going])
        behind = ahead @ move.T
        backward = np.where(going[:, None], behind / behind.sum(axis=1, keepdims=True), 1.0)
        now = forward[:, t - 1] * backward
        chances[:, t - 1] = now / now.sum(axis=1, keepdims=True)
    words = np.empty((len(emissions), local.shape[2]))
    words[chains[real]] = chances[real]
    return words, pairs, real


def train(examples: list[tuple[bytes, int]], languages: tuple[str, ...], epochs: int = EPOCHS, seed: int = 5) -> Model:
    """Weights by AdaGrad steps on batches of chains; every word has its document's language."""
    k, random = len(languages), np.random.default_rng(seed)
    counts = np.zeros((1 << LEXICON_LOG2, k))
    for text, label in examples:
        for data, _, _ in pieces([letters(text)]):
            counts[:, label] += np.bincount(lexicon_rows(data, *word_spans(data)), minlength=1 << LEXICON_LOG2)
    rate_of = counts / np.maximum(counts.sum(axis=0), 1)
    sure = (counts.sum(axis=1) >= LEXICON_LEAST) & (rate_of.max(axis=1) >= LEXICON_SHARE * rate_of.sum(axis=1))
    lexicon = np.where(sure, rate_of.argmax(axis=1) + 1, 0).astype(np.uint16)
    weights, listed, transitions = np.zeros((1 << TABLE_LOG2, k)), np.zeros((k + 1, k)), np.zeros((k, k))
    squares = [np.full_like(x, 1e-6) for x in (weights, listed, transitions)]
    model = Model(languages, weights, lexicon, listed, transitions)
    for _ in range(epochs):
        order = random.permutation(len(examples))
        for at in range(0, len(order), BATCH // 8):
            chosen = [examples[i] for i in order[at : at + BATCH // 8]]
            for data, begins, owners in pieces(letters(text) for text, _ in chosen):
                starts, ends = word_spans(data)
                if not len(starts):
                    continue
                part = np.searchsorted(begins, starts, side="right") - 1
                label = np.array([chosen[o][1] for o in owners])[part]
                chances, pairs, real = posteriors(model.emissions(data, starts, ends), transitions, chains := chain_table(part))
                error = chances
                error[np.arange(len(label)), label] -= 1
                seen = np.zeros((k, k))
                after = real[:, 1:]
                np.add.at(seen, (label[chains[:, :-1][after]], label[chains[:, 1:][after]]), 1)
                slopes = [np.zeros_like(weights), np.zeros_like(listed), pairs - seen]
                for words, rows in feature_rows(data, starts, ends):
                    for c in range(k):
                        slopes[0][:, c] += np.bincount(rows, weights=error[words, c], minlength=len(weights))
                entry = lexicon[lexicon_rows(data, starts, ends)]
                for c in range(k):
                    slopes[1][:, c] += np.bincount(entry, weights=error[:, c], minlength=k + 1)
                for value, square, slope in zip((weights, listed, transitions), squares, slopes):
                    square += slope**2
                    value -= RATE * slope / np.sqrt(square)
    return Model(languages, weights.astype(np.float32), lexicon, listed, transitions)


#: What is known without any training text.
NOTHING = Model((), np.zeros((1, 0)), np.zeros(1, np.uint16), np.zeros((1, 0)), np.zeros((0, 0)))


def fit(docs: DataFrame, per_language: int = TRAIN_DOCS) -> Model:
    """Learn from at most ``per_language`` texts of each language outside the held-out fold.

    A share of each language's ids by their hash, twice as many as are wanted, is cut to that
    number, so that few rows come together however many the language has. The languages are
    the ``MOST_LANGUAGES`` with the most texts.
    """
    rows = docs.where(remainder("doc_id", FOLDS) != HELD_OUT).where(
        (F.octet_length("text") <= TRAIN_BYTES) & F.col("lang").isNotNull() & (F.length(F.trim("text")) > 0)
    )
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()
    if not counts:
        return NOTHING
    shares = F.create_map(*[F.lit(x) for r in counts for x in (r.lang, min(1.0, 2 * per_language / r["count"]))])
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    slim = rows.where(hash_below("doc_id", F.element_at(shares, F.col("lang")))).select("lang", "doc_id").distinct()
    chosen = slim.withColumn("n", F.row_number().over(order)).where(f"n <= {per_language}").select("lang", "doc_id")
    found = (
        rows.select("lang", "doc_id", "text").join(F.broadcast(chosen), ["lang", "doc_id"])
        .groupBy("lang", "doc_id").agg(F.min("text").alias("text")).orderBy("doc_id", "lang").collect()
    )
    languages = tuple(sorted({r.lang for r in found}))
    return train([(r.text.encode(), languages.index(r.lang)) for r in found], languages)


def with_languages(docs: DataFrame, model: Model, text_column: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All columns of ``docs``, the language and its score under ``names``."""
    parts = (model.languages, model.weights, model.lexicon, model.listed, model.transitions)
    shared = docs.sparkSession.sparkContext.broadcast(parts)  # their size is fixed by the table and the languages
    added = StructType([StructField(names[0], StringType(), False), StructField(names[1], DoubleType(), False)])
    return with_columns(docs, text_column, added, lambda texts: list(Model(*shared.value).predict(texts)))


def document_languages(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``doc_id``, whether it is in the held-out fold, its language and the score, for every row.

    A text that is null or has no letter is ``und`` with the score 0, and so is every text
    where nothing can be learned. Repeated rows are returned as often as they come; an empty
    table gives an empty result.
    """
    found = with_languages(docs.select("doc_id", "text"), model or fit(docs))
    return found.select("doc_id", (remainder("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_languages(table(spark, sf_dir, "documents"))
