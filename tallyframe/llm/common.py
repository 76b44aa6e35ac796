"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from tallyframe.shared import fresh_path

#: ASCII letters and digits (upper case to lower) and all bytes of longer characters stay;
#: everything else becomes a space.
WORD_BYTES = bytes(
    (b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256)
)
#: The same without digits.
LETTER_BYTES = bytes(32 if 48 <= b <= 57 else b for b in WORD_BYTES)
#: Odd multiplier of the polynomial hashes and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read back: lost executors cost no rework."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema) -> DataFrame:
    """``mapInArrow`` for a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield function(batch)

    return df.mapInArrow(run, schema)


def with_columns(df: DataFrame, column: str, added: StructType, function) -> DataFrame:
    """All columns, and those that ``function`` makes from the texts of a batch.

    ``function`` gets an iterator of texts (``bytes``, ``None`` for nulls) and returns one
    array for each field of ``added``. A column of ``df`` with such a name is replaced.
    """
    kept = [f for f in df.schema.fields if f.name not in added.names]
    types = [pa_type(f.dataType) for f in added.fields]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = function(as_bytes(batch.column(batch.schema.get_field_index(column))))
        arrays = [batch.column(i) for i, name in enumerate(batch.schema.names) if name not in added.names]
        names = [name for name in batch.schema.names if name not in added.names]
        arrays += [pa.array(values, type=kind) for values, kind in zip(made, types, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names=names + added.names)

    return map_batches(df, run, StructType([*kept, *added.fields]))


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have, in any case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def pa_type(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def as_bytes(column: pa.Array) -> Iterator[bytes | None]:
    """Texts of an Arrow string column as UTF-8, one at a time."""
    if not pa.types.is_binary(column.type):
        column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    return (value.as_py() for value in column)


def sliced(batch: pa.RecordBatch, rows: int = 1 << 18):
    """A batch in slices of at most ``rows`` rows, so that no Arrow message grows with a shard."""
    for at in range(0, max(batch.num_rows, 1), rows):
        yield batch.slice(at, rows)


def pieces(texts: Iterable[bytes | None], size: int = 1 << 19) -> Iterator[tuple[np.ndarray, list[int], list[int]]]:
    """Texts in blocks of about ``size`` bytes: the bytes, and where each part starts and whose it is.

    Each part stands between two line feeds. A longer text is cut at white space, or at
    ``size`` bytes where it has none, so that memory does not grow with the text.
    """
    block, starts, owners, length = [], [], [], 0
    for owner, text in enumerate(texts):
        at = 0
        while True:
            part = text[at : at + size] if text else b""
            if text and at + size < len(text):
                cut = max(part.rfind(b" "), part.rfind(b"\n"))
                part = part[: cut + 1] if cut > 0 else part
            starts.append(length)
            owners.append(owner)
            block += (b"\n", part, b"\n")
            length += len(part) + 2
            at += len(part)
            if length >= size:
                yield np.frombuffer(b"".join(block), np.uint8), starts, owners
                block, starts, owners, length = [], [], [], 0
            if not text or at >= len(text):
                break
    if owners:
        yield np.frombuffer(b"".join(block), np.uint8), starts, owners


def powers(base: int, n: int) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` modulo 2**64."""
    with np.errstate(over="ignore"):
        return np.cumprod(np.r_[np.uint64(1), np.full(max(n, 1) - 1, base, np.uint64)])[:n]


_POWERS: dict[int, np.ndarray] = {}


def cached_powers(base: int, n: int) -> np.ndarray:
    if base not in _POWERS or len(_POWERS[base]) < n:
        _POWERS[base] = powers(base, max(n, 1 << 16))
    return _POWERS[base][:n]


def span_hashes(data: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function of starts and ends that gives a 64-bit hash of each span of ``data``."""
    total = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * cached_powers(BASE, len(data)), out=total[1:])
    inverse = cached_powers(INVERSE, len(data) + 1)

    def hashes(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((total[ends] - total[starts]) * inverse[starts])

    return hashes


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that any of their bits can be used."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(31))
        h = h * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes above 32."""
    solid = np.zeros(len(data) + 2, np.int8)
    solid[1:-1] = data > 32
    edge = np.diff(solid)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(text: bytes | None, size: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash for each word of a text that ``WORD_BYTES`` has been applied to."""
    if not text:
        return np.zeros(0, np.uint64)
    parts, at = [], 0
    while at < len(text):
        end = at + size
        if end < len(text):
            cut = text.rfind(b" ", at, end)
            end = cut + 1 if cut > at else (text.find(b" ", end) + 1 or len(text))
        data = np.frombuffer(text[at:end], np.uint8)
        starts, ends = word_spans(data)
        parts.append(span_hashes(data)(starts, ends))
        at = end
    return np.concatenate(parts)


def hash_below(column: str, share: Column) -> Column:
    """Whether the value's hash lies in the lowest ``share`` of all hashes: a sample that is the same in every run."""
    return F.pmod(F.xxhash64(column), F.lit(1 << 31)) < share * float(1 << 31)


def remainder(column: str | Column, divisor: int) -> Column:
    """crc32 of the value as text, modulo ``divisor``: the folds of the classifiers."""
    value = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.coalesce(value.cast("string"), F.lit("")).cast("binary")) % divisor
