"""Quality of texts by supervised subword embeddings.

Words and character n-grams of three to five bytes are hashed to rows of a learned table;
a document is the mean of its rows, and a softmax over two classes is learned with them by
stochastic gradient descent. The table has a fixed size, so the model does not grow with
the data. Scoring needs only each row's part of the difference between both classes, one
number a row, and is vectorised over blocks of bytes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tallyframe.llm.common import as_bytes, hash_below, map_batches, pieces, remainder, span_hashes, table, with_columns, word_spans

#: Labelled documents and bytes of each that are learned from at most. They are chosen by a hash of the id.
TRAIN_DOCS, TRAIN_BYTES = 3000, 100_000
BUCKETS_LOG2, DIMENSIONS, EPOCHS, RATE = 15, 8, 6, 20.0
GRAMS = (3, 4, 5)
FOLDS, THRESHOLD = 5, 0.3
ALWAYS, AGAIN = 0, 1  # the row that every document has once, and that of a word said again
#: How often the latter is counted: about as often as the n-grams of a word.
AGAIN_WEIGHT = 16


def hashed(data: np.ndarray, bits: int = BUCKETS_LOG2) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions and table rows: for the words of a block, pairs of equal words, and n-grams of each length.

    All pairs of a word and the same word after one white space have one row. An n-gram may
    begin or end with the white space beside a word but not go beyond it.
    """
    starts, ends = word_spans(data)
    words = span_hashes(data)(starts, ends)
    yield starts, (words >> np.uint64(64 - bits)).astype(np.int64)
    again = np.flatnonzero((words[1:] == words[:-1]) & (starts[1:] - ends[:-1] == 1)) + 1
    yield np.repeat(starts[again], AGAIN_WEIGHT), np.full(len(again) * AGAIN_WEIGHT, AGAIN)
    solid = data > 32
    values = np.maximum(data, 32).astype(np.uint32)  # any white space is a space
    h, inside, length = values, np.ones(len(data), bool), 1
    while length < max(GRAMS):
        if len(h) < 2:
            return
        h = h[:-1] * np.uint32(0x01000193) + values[length:]
        inside = inside[:-1] if length == 1 else inside[:-1] & solid[length - 1 : -1]
        length += 1
        if length in GRAMS:
            at = np.flatnonzero(inside)
            yield at, ((h[at] ^ np.uint32(length)) * np.uint32(0x9E3779B1) >> np.uint32(32 - bits)).astype(np.int64)


def block_owners(data: np.ndarray, starts: list[int], owners: list[int]) -> np.ndarray:
    return np.repeat(np.array(owners), np.diff([*starts, len(data)]))


@dataclass(frozen=True)
class Model:
    """What each table row adds to the log-odds of class 1."""

    parts: np.ndarray

    def scores(self, texts: Iterable[bytes | None]) -> np.ndarray:
        texts = list(texts)
        total, count = np.full(len(texts), self.parts[ALWAYS], np.float64), np.ones(len(texts))
        for data, starts, owners in pieces(texts):
            owner = block_owners(data, starts, owners)
            for at, rows in hashed(data):
                count += np.bincount(owner[at], minlength=len(texts))
                total += np.bincount(owner[at], weights=self.parts[rows], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(total / count, -500, 500)))


def document_rows(texts: Iterable[bytes | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Table rows of each text and how often it has them."""
    texts = list(texts)
    size = 1 << BUCKETS_LOG2
    counts: list[dict] = []
    for text in texts:
        total = np.zeros(size, np.int64)
        total[ALWAYS] = 1
        for data, _, _ in pieces([text]):
            for _, rows in hashed(data):
                total += np.bincount(rows, minlength=size)
        rows = np.flatnonzero(total)
        counts.append((rows.astype(np.int32), total[rows].astype(np.float32)))
    return counts


def train(examples: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> Model:
    """Stochastic gradient descent, one document at a time, with a rate that falls to zero."""
    random = np.random.default_rng(seed)
    size = 1 << BUCKETS_LOG2
    inputs = random.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (size, DIMENSIONS)).astype(np.float32)
    output = np.zeros((2, DIMENSIONS), np.float32)
    steps, done = max(1, epochs * len(examples)), 0
    for _ in range(epochs):
        for k in random.permutation(len(examples)):
            rows, counts, label = examples[k]
            share = counts / counts.sum()
            hidden = share @ inputs[rows]
            odds = output @ hidden
            chance = np.exp(odds - odds.max())
            error = chance / chance.sum() - np.array([1 - label, label], np.float32)
            now = rate * (1 - done / steps)
            back = error @ output
            output -= 0.01 * now * np.outer(error, hidden).astype(np.float32)
            inputs[rows] -= (now * np.outer(share, back)).astype(np.float32)
            done += 1
    return Model((inputs @ (output[1] - output[0])).astype(np.float64))


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> Model:
    """Learn from at most ``most`` labelled rows outside the held-out fold.

    Labels are taken once for each id (the smaller where they differ). A share of the ids by
    their hash, twice as many as are wanted, is cut to ``most``, so that however many labels
    there are few come together. The chosen ids may be broadcast, and features of the chosen
    texts collected. Without labels every score is one half.
    """
    known = labels.where(remainder("doc_id", FOLDS) != 0).where("quality is not null and doc_id is not null")
    share = min(1.0, 2 * most / max(1, known.count()))
    chosen = (
        known.where(hash_below("doc_id", F.lit(share)))
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )
    texts = (
        docs.select("doc_id", "text").where(F.octet_length("text") <= TRAIN_BYTES)
        .join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    )

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = document_rows(as_bytes(batch.column(2)))
        arrays = [batch.column(0), batch.column(1), pa.array([r.tobytes() for r, _ in made]), pa.array([c.tobytes() for _, c in made])]
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "quality", "rows", "counts"])

    schema = f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, quality {texts.schema['quality'].dataType.simpleString()}, rows binary, counts binary"
    found = sorted(map_batches(texts, run, schema).collect(), key=lambda r: r.doc_id)
    if not found:
        return Model(np.zeros(1 << BUCKETS_LOG2))
    return train([(np.frombuffer(r["rows"], np.int32), np.frombuffer(r["counts"], np.float32), int(r.quality)) for r in found])


def with_scores(docs: DataFrame, model: Model, text_column: str = "text", name: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score; a null text is scored like an empty one."""
    parts = model.parts
    added = StructType([StructField(name, DoubleType(), False)])
    return with_columns(docs, text_column, added, lambda texts: [Model(parts).scores(texts)])


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, whether it is in the held-out fold, its score and the predicted class, for every row.

    The score depends on the text only. Null and empty texts get the score of a document
    that has nothing but the row common to all. Repeated rows are scored as often as they come;
    an empty table gives an empty result.
    """
    scored = with_scores(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select(
        "doc_id", (remainder("doc_id", FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
