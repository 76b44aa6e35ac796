"""Token counts without token ids.

A byte-level vocabulary never merges across pre-tokens, so a text has as many tokens as
its pre-tokens have together. Every distinct pre-token of the corpus is encoded once; its
number of pieces is joined to the pre-token frequencies of each document and summed. The
pre-tokens in the most documents, a bounded number, are joined by a broadcast dictionary
in the task that counts them. The others are rare, so the shuffled join has no hot key.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyframe.llm.common import settle, table

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024
#: Entries of the broadcast dictionary, and bytes of each, at most: 16 MB together.
FREQUENT, FREQUENT_BYTES = 1 << 17, 128
#: Distinct pre-tokens that a task holds before it hands its counts on.
HELD = 1 << 17
#: Up to this character both pattern engines know the same letters, numbers and spaces (tested).
PLAIN = regex.compile(r"[\x00-ɏ‐-‧€]*+")


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load(vocabulary: str):
    """The tokenizer of the file; one thread, as Spark gives a task one core."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path(vocabulary))


def added_tokens(tokenizer) -> list[str]:
    """Strings that the tokenizer takes out of a text, as one token each, before all else."""
    return sorted((t.content for t in tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)


def splitter(tokenizer) -> Callable[[str], tuple[list[str], int]]:
    """A function of a text that gives its pre-tokens and the number of added tokens in it."""
    from public_tokenizers import PATTERN

    find = regex.compile(PATTERN).findall
    special = added_tokens(tokenizer)
    part = regex.compile("|".join(map(regex.escape, special))).split if special else None

    def exact(text: str) -> list[str]:
        return [text[a:b] for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def split(text: str) -> tuple[list[str], int]:
        parts = part(text) if part and any(s in text for s in special) else [text]
        found: list[str] = []
        for piece in parts:
            if piece:
                found += find(piece) if PLAIN.fullmatch(piece) else exact(piece)
        return found, len(parts) - 1

    return split


def pre_token_documents(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``piece`` (pre-token) and the number of texts that have it, added up by task at first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, counts = splitter(load(vocabulary)), Counter()
        for batch in batches:
            for text in batch.column(0):
                counts.update(set(split(text.as_py())[0]))
                if len(counts) >= HELD:
                    yield counted(counts)
                    counts = Counter()
        yield counted(counts)

    def counted(counts: Counter) -> pa.RecordBatch:
        arrays = [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, names=["piece", "n"])

    found = docs.where("text <> ''").select("text").mapInArrow(run, "piece string, n long")
    return found.groupBy("piece").agg(F.sum("n").alias("n"))


def with_lengths(pieces: DataFrame, vocabulary: str) -> DataFrame:
    """The number of tokens of each distinct pre-token, by the library."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                some = batch.slice(at, 4096)
                encoded = tokenizer.encode_batch_fast(some.column(0).to_pylist(), add_special_tokens=False)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array([len(e) for e in encoded], pa.int64())], names=["piece", "n", "tokens"])

    return pieces.mapInArrow(run, "piece string, n long, tokens long")


def frequent(lengths: DataFrame, most: int = FREQUENT) -> dict[str, int]:
    """Pre-tokens in the most texts: all above the lowest frequency that keeps them within ``most``.

    The frequency is found from a histogram of at most 64 * 32 steps, without sorting.
    """
    step = F.floor(F.log2("n") * 32).alias("step")
    short = lengths.where(F.octet_length("piece") <= FREQUENT_BYTES)
    steps = sorted(((r.step, r["count"]) for r in short.groupBy(step).count().collect()), reverse=True)
    total, lowest = 0, None
    for at, count in steps:
        total += count
        if total > most:
            break
        lowest = at
    if lowest is None:
        return {}
    rows = short.where(F.floor(F.log2("n") * 32) >= lowest).select("piece", "tokens").toArrow()
    return dict(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()))


def token_counts(
    docs: DataFrame, vocabulary: str = VOCABULARY, id_column: str = "doc_id", text_column: str = "text", limit: int = LIMIT,
    most_frequent: int = FREQUENT,
) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens`` and whether these are over ``limit``, for every row.

    A null text counts as empty and has 0 bytes and 0 tokens. Repeated rows and rows with one
    id are counted each for itself. An empty table gives an empty result.
    """
    texts = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    lengths = settle(with_lengths(pre_token_documents(texts, vocabulary), vocabulary), "piece-lengths")
    known = docs.sparkSession.sparkContext.broadcast(frequent(lengths, most_frequent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, length_of = splitter(load(vocabulary)), known.value.get
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                total, rare = [], ([], [], [])
                for row, text in zip(some.column(0).to_pylist(), some.column(3)):
                    found, tokens = split(text.as_py())
                    for piece, times in Counter(found).items():
                        length = length_of(piece)
                        if length is None:
                            for values, value in zip(rare, (row, piece, times)):
                                values.append(value)
                        else:
                            tokens += length * times
                    total.append(tokens)
                more = len(rare[0])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([some.column(0), pa.array(rare[0], pa.int64())]),
                        pa.concat_arrays([some.column(1), pa.nulls(more, some.column(1).type)]),
                        pa.concat_arrays([some.column(2), pa.nulls(more, pa.int64())]),
                        pa.concat_arrays([pa.nulls(some.num_rows, pa.string()), pa.array(rare[1], pa.string())]),
                        pa.array(total + rare[2], pa.int64()),
                    ],
                    names=["row", "doc_id", "n_bytes", "piece", "n"],
                )

    # one row for each text with its facts and the tokens known so far, and one for each rare pre-token in it
    rows = texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    kind = texts.schema["doc_id"].dataType.simpleString()
    counts = settle(rows.mapInArrow(run, f"row long, doc_id {kind}, n_bytes long, piece string, n long"), "counts")
    rare = counts.where("piece is not null").join(lengths.select("piece", "tokens"), "piece")
    rare = rare.select("row", "doc_id", "n_bytes", (F.col("n") * F.col("tokens")).alias("n"))
    sums = counts.where("piece is null").select("row", "doc_id", "n_bytes", "n").unionByName(rare)
    sums = sums.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("n").alias("n_tokens"))
    return sums.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
