"""Language-model scores by online logistic context mixing.

A text is lower-cased in A-Z and cut into words at ``[\\x20\\x09-\\x0D]``; the model reads
the words joined by single spaces and closed by a line feed (which no word holds, so the
end is a symbol of its own), bit by bit, most significant first.

Training (rows whose ``crc32(doc_id as text) % 7`` is not 2). Four hashed contexts predict
each bit: the last one, two and three bytes and the part of the current word already read,
each with the bits of the current byte before it. Every task counts the tokens and the runs
of four bytes (grams) of its rows and Spark sums them; zeros and ones per context slot come
from these sums, in numpy, and Spark sums them by blocks of slots. Texts with a word that a
chunk may cut are counted byte by byte. The table is written to the shared folder. There are
``2 ** bits`` slots an order, ``bits`` growing with the training bytes up to
``most_table_bits`` (21: 4 orders x 2 M slots, at most 128 MB of counts in a counting task,
32 MB of predictions in a Python process that scores), so the model grows with the corpus and
its memory stays bounded.

Scoring (every row). Each predictor gives ``stretch(p) = ln((n1 + 1/2) / (n0 + 1/2))`` of its
slot (0 for an unseen slot). A gated mixer combines them: the weight set is chosen by the
bit's place in its byte and the number of predictors that know their context (8 x 5
sets), the bit's probability is ``squash(w . x)``, and the weights are refined by online
gradient steps on the log loss, after every block of 64 bytes of the text, from the same
start for every text. The bits of all blocks are summed: ``score`` is the log10
probability of the text, ``bits_per_byte`` its cost per byte read.

Texts are read whole: long ones in chunks of ``chunk_bytes``, cut at spaces, with the
weights and the last three bytes carried over (a word longer than a chunk starts its
word context again at the cut). Rows of a task are scored in lockstep, block by block, so
that numpy works on many texts at once; slots are looked up once for each distinct pair of
contexts and byte of a group of texts.

The base score is a Spark job: ``log10((c + 1) / (N + V + 1))`` summed over tokens, with
``c`` from the training tokens' counts (the at most ``frequent`` most frequent tokens of at
most 64 bytes are summed where the texts are read, the rest joined by a shuffle), ``N`` and ``V`` their total
and distinct number; the end token counts once per training row.

Defined cases: null texts are empty (one token, the end; one byte, the line feed); null
ids have crc32 of the empty text, 0, so they are training rows; repeated rows are scored
(and learnt) each time; other columns, of any name, are ignored; an empty table gives no
rows; with no training rows every count is 0 and every slot unseen.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyframe.llm.common import as_bytes, fresh_path, remainder, settle, sliced, span_hashes, table
from tallyframe.llm.warc import open_store

#: Fixed values of the contract: folds, the letters lower-cased.
FOLDS, HELD_OUT = 7, 2
LOWERED = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: The same, and each white space a space.
SPACED = bytes(32 if 9 <= b <= 13 else b for b in LOWERED)

ORDERS = 4
#: Slots an order: 2 ** bits, bits from the training bytes, within these bounds.
FEWEST_TABLE_BITS, MOST_TABLE_BITS = 16, 21
#: Bytes of a text read at once, bytes a weight step covers, start and rate of the weights.
CHUNK_BYTES, BLOCK, START_WEIGHT, RATE = 1 << 16, 64, 0.3, 0.02
GATES = 8 * (ORDERS + 1)
#: Bytes of text scored in lockstep, at most ``chunk_bytes`` of each text.
GROUP_BYTES = 1 << 19
#: Texts whose blocks are mixed side by side.
LANE = 128
#: Bytes of text whose contexts are counted at once, and whose tokens are.
COUNT_BYTES, TOKEN_BYTES = 1 << 20, 1 << 22
#: Distinct grams, and tokens, that a task holds before it sums them, bytes of words whose contexts are counted at once.
GRAMS, TOKENS, WORD_BYTES = 1 << 19, 1 << 19, 1 << 17
#: Slots in a row of counts that tasks hand on, and rows at once.
BLOCK_SLOTS, BLOCK_ROWS = 1 << 12, 64
#: Rows of the count table read at once.
LOAD_ROWS = 1 << 16
#: Tokens of the broadcast count table at most (of at most 64 bytes each).
FREQUENT, FREQUENT_BYTES = 1 << 17, 64
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
ORDER_SALT = [np.uint64(0x2545F4914F6CDD1D * (k + 1) % (1 << 64)) for k in range(ORDERS)]
LOG10_2 = math.log10(2)
#: Of each byte: its bits, and the bits before each with a leading one, spread by the salt of each order.
BIT = ((np.arange(256)[:, None] >> (7 - np.arange(8))) & 1).astype(np.int8)
BIT_FLOAT = BIT.astype(np.float32)
#: Bounds of a bit's probability.
LEAST, MOST = np.float32(1 / 4096), np.float32(1 - 1 / 4096)
PARTIAL = ((np.arange(256)[:, None] | 256) >> (8 - np.arange(8))).astype(np.uint64)
with np.errstate(over="ignore"):
    SPREAD = [PARTIAL * ORDER_SALT[(k + 1) % ORDERS] for k in range(ORDERS)]


def give_back() -> None:
    """Hands freed memory back to the system: a Python process that Spark uses again keeps what its last task held."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def stream(text: bytes | None) -> bytes:
    """The bytes the model reads: lower-cased words joined by spaces, then a line feed."""
    spaced = (text or b"").translate(SPACED).strip(b" ")
    return (b" ".join(spaced.split()) if b"  " in spaced else spaced) + b"\n"


def contexts(chunk: bytes, before: bytes) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of the contexts of each byte of ``chunk`` (one array an order), and the bytes.

    ``before`` holds the three bytes read before the chunk (line feeds at a text's start).
    """
    data = np.frombuffer(before + chunk, np.uint8)
    n, pad = len(chunk), len(before)
    at = np.arange(pad, pad + n)
    spans = span_hashes(data)
    separator = (data == 32) | (data == 10)
    last = np.maximum.accumulate(np.where(separator, np.arange(len(data)), 0))
    starts = [at - 1, at - 2, at - 3, last[at - 1] + 1]
    with np.errstate(over="ignore"):
        return [(spans(starts[k], at) ^ ORDER_SALT[k]) * MULTIPLIER for k in range(ORDERS)], data[pad:]


def slots_of(k: int, base: np.ndarray, own: np.ndarray, bits: int) -> np.ndarray:
    """The slots (n, 8) of the bits of bytes ``own`` in their contexts of order ``k``."""
    with np.errstate(over="ignore"):
        spread = SPREAD[k].take(own, axis=0)
        spread += base[:, None]
        spread *= MULTIPLIER
        spread >>= np.uint64(64 - bits)
    return spread.view(np.int64)


def slots(chunk: bytes, before: bytes, bits: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Context slots (one array (n, 8) an order) and bits (n, 8) of the bytes of ``chunk``."""
    bases, own = contexts(chunk, before)
    return [slots_of(k, bases[k], own, bits) for k in range(ORDERS)], BIT[own]


def pieces_of(text: bytes, chunk_bytes: int):
    """A stream in chunks of at most ``chunk_bytes``, cut after a space where there is one; with the bytes before each."""
    at = 0
    while at < len(text):
        end = min(at + chunk_bytes, len(text))
        if end < len(text):
            cut = text.rfind(b" ", at, end)
            end = cut + 1 if cut > at else end
        yield text[at:end], (b"\n\n\n" + text[max(0, at - 3) : at])[-3:]
        at = end


def add_slots(counts: np.ndarray, k: int, hashes: np.ndarray, own: np.ndarray, times: np.ndarray, bits: int) -> None:
    """Adds bytes ``own``, each ``times`` times in the context of order ``k`` with this hash, to ``counts`` (2 * slots), in place."""
    with np.errstate(over="ignore"):
        base = (hashes ^ ORDER_SALT[k]) * MULTIPLIER
    slot = slots_of(k, base, own, bits)
    np.add.at(counts, (slot * 2 + BIT[own]).ravel(), np.repeat(times.astype(counts.dtype), 8))


def gram_contexts(k: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of keys that hold a byte and the ``k`` bytes before it (the last one lowest): the hash of these, and the byte."""
    context = np.stack([(keys >> np.uint32(8 * i)).astype(np.uint8) for i in range(k, 0, -1)], 1).ravel()
    first = np.arange(len(keys)) * k
    return span_hashes(context)(first, first + k), (keys & np.uint32(255)).astype(np.int64)


def add_contexts(counts: np.ndarray, parts: list[tuple[bytes, bytes]], bits: int) -> None:
    """Adds the zeros and ones of the bytes of ``parts`` (chunk, before) to ``counts`` (ORDERS, 2 * slots), in place.

    Equal pairs of context and byte are counted first, by sorting, and their eight slots looked
    up once: short contexts by their bytes, words (with the byte that ends them) by their hash.
    """
    # Words cut at a chunk's end are few: byte by byte, as in scoring.
    whole = [c[-1:] in (b" ", b"\n") and b[-1:] in (b" ", b"\n") for c, b in parts]
    for (chunk, before), even in zip(parts, whole, strict=True):
        if not even:
            found, ones = slots(chunk, before, bits)
            for k in range(ORDERS):
                np.add.at(counts[k], (found[k] * 2 + ones).ravel(), np.uint32(1))
    parts = [part for part, even in zip(parts, whole, strict=True) if even]
    if not parts:
        return
    data = np.frombuffer(b"".join(b + c for c, b in parts), np.uint8)
    own = np.ones(len(data), bool)
    lead = len(parts[0][1])
    begin = np.cumsum([0, *[lead + len(c) for c, _ in parts[:-1]]])
    for i in range(lead):
        own[begin + i] = False
    at = np.flatnonzero(own)
    for k in range(1, ORDERS):
        keys = data[at].astype(np.uint32)
        for i in range(1, k + 1):
            keys |= data[at - i].astype(np.uint32) << np.uint32(8 * i)
        keys, times = run_lengths(np.sort(keys))
        add_slots(counts[k - 1], k - 1, *gram_contexts(k, keys), times, bits)
    ends = np.flatnonzero(own & ((data == 32) | (data == 10)))
    starts = np.append(0, ends[:-1] + 1)
    starts += np.where(own[starts], 0, lead)
    spans = span_hashes(data)
    words = spans(starts, ends + 1)
    order = np.argsort(words)
    times = run_lengths(words[order])[1]
    some = order[np.cumsum(times) - times]
    sizes = ends[some] + 1 - starts[some]
    start = np.repeat(starts[some], sizes)
    place = start + np.arange(len(start)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    add_slots(counts[-1], ORDERS - 1, spans(start, place), data[place].astype(np.int64), np.repeat(times, sizes), bits)


def run_lengths(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ones of sorted values, and how often each stands there."""
    first = np.flatnonzero(np.append(np.ones(min(len(values), 1), bool), values[1:] != values[:-1]))
    return values[first], np.diff(np.append(first, len(values)))


BLOCK_SCHEMA = pa.schema([("order", pa.int32()), ("block", pa.int32()), ("counts", pa.binary())])


def slot_blocks(counts: list[np.ndarray | None]):
    """Zeros and ones of the slots of each order as rows (order, block, counts): ``BLOCK_SLOTS`` slots a row, none without a count."""
    for k, some in enumerate(counts):
        if some is None:
            continue
        blocks = some.reshape(-1, min(2 * BLOCK_SLOTS, len(some)))
        for at in range(0, len(blocks), BLOCK_ROWS):
            seen = at + np.flatnonzero(blocks[at : at + BLOCK_ROWS].any(1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(seen), k, np.int32)), pa.array(seen.astype(np.int32)), pa.array([blocks[i].astype(np.int64).tobytes() for i in seen], pa.binary())],
                schema=BLOCK_SCHEMA,
            )


def sum_blocks(bits: int):
    """The sum of the rows of one order and block, as rows (order, slot, n0, n1) of the slots seen."""
    width = min(BLOCK_SLOTS, 1 << bits)
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        total = np.zeros(2 * width, np.int64)
        for counts in rows.column("counts"):
            total += np.frombuffer(counts.as_buffer(), np.int64)
        n0, n1 = total[0::2], total[1::2]
        seen = np.flatnonzero(n0 + n1)
        order, block = (value.as_py() for value in key)
        return pa.table({"order": pa.array(np.full(len(seen), order, np.int32)), "slot": seen + block * width, "n0": n0[seen], "n1": n1[seen]})

    return run


def count_contexts(bits: int, chunk_bytes: int):
    """Contexts of the texts that hold a word which a chunk may cut, byte by byte, as rows of ``slot_blocks``."""

    def run(batches):
        counts = None
        for batch in batches:
            for text in as_bytes(batch.column(0)):
                read = stream(text)
                if max(map(len, read.split()), default=0) < chunk_bytes - 1:
                    continue
                if counts is None:
                    counts = np.zeros((ORDERS, 2 << bits), np.uint32)
                held, length = [], 0
                for part in pieces_of(read, chunk_bytes):
                    held.append(part)
                    length += len(part[0])
                    if length >= COUNT_BYTES:
                        add_contexts(counts, held, bits)
                        held, length = [], 0
                add_contexts(counts, held, bits)
        yield from slot_blocks([] if counts is None else list(counts))

    return run


def token_groups(batches, group_bytes: int):
    """Rows of a task in groups of about ``group_bytes`` of text: keys (of the second column, if there is one), each
    token's place among them, the distinct tokens, which of these each token is, the streams' bytes and their sizes."""

    def made(keys, streams):
        data = np.frombuffer(b"".join(streams), np.uint8)
        parts = (data == 32) | (data == 10)
        ends = np.flatnonzero(parts)
        sizes = np.diff(np.append(-1, ends)) - 1
        bounds = np.asarray([len(s) for s in streams])
        owner = np.repeat(np.arange(len(bounds)), np.diff(np.searchsorted(ends, np.cumsum(bounds)), prepend=0))
        ends, owner, sizes = ends[sizes > 0], owner[sizes > 0], sizes[sizes > 0]
        offsets = np.append(0, np.cumsum(sizes)).astype(np.int64)
        letters = pa.py_buffer(np.ascontiguousarray(data[~parts]))
        # A key of Arrow's dictionary is the token itself, so that no two are taken for one.
        coded = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), letters]).dictionary_encode()
        return keys, owner, coded.dictionary.cast(pa.large_string()).cast(pa.string()), coded.indices.to_numpy(), data, bounds

    keys, streams, size = [], [], 0
    for batch in batches:
        given = batch.column(1).to_pylist() if batch.num_columns > 1 else [None] * batch.num_rows
        for text, key in zip(as_bytes(batch.column(0)), given, strict=True):
            keys.append(key)
            streams.append(stream(text))
            size += len(streams[-1])
            if size >= group_bytes:
                yield made(keys, streams)
                keys, streams, size = [], [], 0
    if streams:
        yield made(keys, streams)


def grams_of(data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each byte of the streams in ``data`` with the three before it (line feeds at a stream's start), the byte itself lowest."""
    grams = data.astype(np.uint32)
    for k in range(1, ORDERS):
        grams[k:] |= data[:-k].astype(np.uint32) << np.uint32(8 * k)
    starts = np.cumsum(sizes) - sizes
    for k in range(1, ORDERS):
        at = starts[sizes >= k] + k - 1
        low = np.uint32((1 << 8 * k) - 1)
        grams[at] = grams[at] & low | np.uint32(0x0A0A0A0A) & ~low
    return grams


def summed(keys: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, and the sum of the times of each."""
    joined, counts = np.concatenate(keys), np.concatenate(times)
    order = np.argsort(joined)
    found, runs = run_lengths(joined[order])
    return found, np.add.reduceat(counts[order], np.cumsum(runs) - runs) if len(found) else counts


def count_parts(chunk_bytes: int):
    """Training pass: what base score and model count, as rows (token, gram, c, w, e).

    ``c``: the token's number. Of texts without a word that a chunk may cut, ``w`` and ``e``: how often
    the token, or the gram, stands there, and how often the token is the last one (the empty token: texts without one).
    """
    schema = pa.schema([("token", pa.string()), ("gram", pa.int64()), ("c", pa.int64()), ("w", pa.int64()), ("e", pa.int64())])

    def rows(tokens, grams, *numbers):
        n = len(numbers[0])
        columns = [pa.nulls(n, pa.string()) if tokens is None else tokens, pa.nulls(n, pa.int64()) if grams is None else pa.array(grams.astype(np.int64))]
        return pa.RecordBatch.from_arrays([*columns, *[pa.array(x.astype(np.int64)) for x in numbers]], schema=schema)

    def once(held):
        table_ = pa.Table.from_batches(held, schema).group_by("token", use_threads=False)
        table_ = table_.aggregate([(name, "sum") for name in ("c", "w", "e")])
        names = ("token", None, "c_sum", "w_sum", "e_sum")
        columns = [pa.nulls(len(table_), pa.int64()) if name is None else table_.column(name) for name in names]
        return pa.Table.from_arrays(columns, schema=schema).combine_chunks().to_batches()

    def run(batches):
        import pyarrow.compute as pc

        keys, times, words = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], []
        for given, owner, tokens, which, data, sizes in token_groups(batches, TOKEN_BYTES // 4):
            n = len(tokens)
            cut = np.zeros(len(given), bool)
            cut[owner[(pc.binary_length(tokens).to_numpy() >= chunk_bytes - 1)[which]]] = True
            last = np.append(owner[1:] != owner[:-1], np.ones(min(len(owner), 1), bool))
            plain = ~cut[owner]
            words.append(rows(tokens, None, *(np.bincount(x, minlength=n) for x in (which, which[plain], which[plain & last]))))
            empty = np.full(1, len(given) - last.sum())
            words.append(rows(pa.array([""]), None, np.zeros(1), empty, empty))
            if sum(map(len, words)) > TOKENS:
                # Those of many groups once; what they are still too many for is summed by Spark alone.
                words = once(words)
                if sum(map(len, words)) > TOKENS * 3 // 4:
                    for batch in words:
                        yield from sliced(batch)
                    words = []
            grams = grams_of(data, sizes)
            if cut.any():
                grams = grams[np.repeat(~cut, sizes)]
            grams.sort()
            for held, more in zip((keys, times), run_lengths(grams), strict=True):
                held.append(more)
            if sum(map(len, keys)) > GRAMS:
                keys, times = ([x] for x in summed(keys, times))
        found, number = summed(keys, times)
        zero = np.zeros(len(found))
        words = [*once(words), rows(None, found, zero, number, zero)]
        for batch in words:
            yield from sliced(batch)
        del batch, words, keys, times
        give_back()

    return run


def count_slots(bits: int):
    """Context slots of counted tokens and grams (columns token, gram, w, e), as rows of ``slot_blocks``."""

    def run(batches):
        counts = [None] * ORDERS

        def add(k, hashes, own, times):
            if counts[k] is None:
                counts[k] = np.zeros(2 << bits, np.int64)
            add_slots(counts[k], k, hashes, own, times, bits)

        for batch in batches:
            words = batch.filter(batch.column("token").is_valid())
            others = batch.filter(batch.column("gram").is_valid())
            grams, times = (others.column(name).to_numpy() for name in ("gram", "w"))
            grams = grams.astype(np.uint32)
            for k in range(1, ORDERS if len(grams) else 0):
                keys, number = summed([grams & np.uint32((1 << 8 * (k + 1)) - 1)], [times])
                add(k - 1, *gram_contexts(k, keys), number)
            w, e = (words.column(name).to_numpy() for name in ("w", "e"))
            tokens = list(as_bytes(words.column("token")))
            # A word, and the space or the line feed that ends it: as many tokens at once as make ``WORD_BYTES``.
            sizes = np.asarray([len(t) + 1 for t in tokens], np.int64)
            group = (np.cumsum(sizes) - sizes) // WORD_BYTES
            for some in np.split(np.arange(len(tokens)), np.flatnonzero(np.diff(group)) + 1):
                if not len(some):
                    continue
                data = np.frombuffer(b" ".join(tokens[i] for i in some) + b" ", np.uint8)
                ends = np.cumsum(sizes[some])
                starts = ends - sizes[some]
                spans = span_hashes(data)
                number = np.repeat(w[some], sizes[some])
                number[ends - 1] -= e[some]
                add(ORDERS - 1, spans(np.repeat(starts, sizes[some]), np.arange(len(data))), data.astype(np.int64), number)
                final = np.flatnonzero(e[some])
                add(ORDERS - 1, spans(starts[final], ends[final] - 1), np.full(len(final), 10), e[some][final])
        yield from slot_blocks(counts)
        counts.clear()
        give_back()

    return run


def row_tokens(path: str, denominator: float):
    """Of every row its number of words, and of those at ``path`` number and summed log10 (a row without token); other tokens with their number."""
    schema = pa.schema([("key", pa.int64()), ("token", pa.string()), ("m", pa.int64()), ("hot_words", pa.int64()), ("hot_score", pa.float64())])

    def run(batches):
        import pyarrow.compute as pc
        import pyarrow.dataset as ds

        store, root = open_store(path)
        hot = ds.dataset(root, filesystem=store, format="parquet").to_table(columns=["token", "c"])
        tokens_ = pa.concat_arrays([pa.array([], pa.string()), *[chunk.cast(pa.string()) for chunk in hot.column("token").chunks]])
        logs = np.append(np.log10((hot.column("c").to_numpy() + 1) / denominator), 0.0)
        for keys, owner, distinct, which, _, _ in token_groups(batches, TOKEN_BYTES // 2):
            n = len(keys)
            found = pc.fill_null(pc.index_in(distinct, value_set=tokens_), -1).to_numpy()[which]
            known = found >= 0
            yield from sliced(pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.nulls(n, pa.string()), pa.array(np.bincount(owner, minlength=n).astype(np.int64)),
                 pa.array(np.bincount(owner[known], minlength=n).astype(np.int64)), pa.array(np.bincount(owner, logs[found], minlength=n))],
                schema=schema,
            ))
            pairs, m = run_lengths(np.sort(owner[~known] * max(len(distinct), 1) + which[~known]))
            row, token = np.divmod(pairs, max(len(distinct), 1))
            yield from sliced(pa.RecordBatch.from_arrays(
                [pa.array(np.asarray(keys, np.int64)[row]), distinct.take(pa.array(token)), pa.array(m.astype(np.int64)),
                 pa.array(np.zeros(len(m), np.int64)), pa.array(np.zeros(len(m)))],
                schema=schema,
            ))
        give_back()

    return run


def load_table(path: str, bits: int) -> np.ndarray:
    """Stretched predictions (ORDERS, 2 ** bits) of the summed counts at ``path``; 0 where a slot is unseen."""
    import pyarrow.dataset as ds

    store, root = open_store(path)
    out = np.zeros((ORDERS, 1 << bits), np.float32)
    # One batch at a time: the counts as a whole are many times the size of the predictions.
    batches = ds.dataset(root, filesystem=store, format="parquet").to_batches(
        columns=["order", "slot", "n0", "n1"], batch_size=LOAD_ROWS, batch_readahead=0, fragment_readahead=0, use_threads=False
    )
    for batch in batches:
        order, slot, n0, n1 = (column.to_numpy() for column in batch.columns)
        out[order, slot] = np.clip(np.log((n1 + 0.5) / (n0 + 0.5)), -8, 8)
    return out


@functools.lru_cache(maxsize=1)
def kept_table(path: str, bits: int) -> np.ndarray:
    """The predictions, read once by each Python process and kept for its next tasks."""
    return load_table(path, bits)


def distinct(keys: np.ndarray, below: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct key, and which of these each key is. Keys are 64-bit hashes, or lie ``below`` a
    bound and have their last places taken."""
    if below is not None and below > 4 * len(keys) + (1 << 16):
        found, first, which = np.unique(keys[::-1], return_index=True, return_inverse=True)
        return len(keys) - 1 - first, which[::-1]
    if below is not None:
        place = np.full(below, -1, np.int32)
        place[keys] = np.arange(len(keys), dtype=np.int32)
        some = place >= 0
        return place[some], (np.cumsum(some, dtype=np.int32) - np.int32(1)).take(keys)
    # The key that was written last at a place of its hash's highest bits stands for all that equal it there.
    width = max(len(keys) - 1, 1).bit_length() + 1
    slot = (keys >> np.uint64(64 - width)).view(np.int64)
    place = np.empty(1 << width, np.int32)
    here = np.arange(len(keys), dtype=np.int32)
    place[slot] = here
    held = place.take(slot)
    some = np.flatnonzero(held == here)
    number = place[: len(keys)]
    number[some] = np.arange(len(some), dtype=np.int32)
    which = number.take(held)
    # The others, few, by sorting.
    rest = np.flatnonzero(keys.take(held) != keys)
    found, first, same = np.unique(keys[rest], return_index=True, return_inverse=True)
    which[rest] = same + len(some)
    return np.append(some, rest[first]), which


def context_rows(units, table_: np.ndarray, bits: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """What the bytes of the units have in common, looked up once: the predictions of the eight bits (one array (rows, 8)
    an order) of each distinct pair of a context and a byte.

    Further: the row of every byte (one array an order), whether a predictor does not know one of its contexts, the
    bytes (with those before each unit), and where each unit starts in them.
    """
    data = np.frombuffer(b"".join(before + chunk for chunk, before, _ in units), np.uint8)
    leads = np.asarray([len(before) for _, before, _ in units])
    sizes = np.asarray([len(chunk) for chunk, _, _ in units])
    begin = np.cumsum(leads + sizes) - leads - sizes
    spans = span_hashes(data)
    present = np.bincount(data, minlength=256) > 0
    letters, letter = int(present.sum()), (np.cumsum(present) - 1)[data]
    xrows, rows = [], []
    odd, ids, n = np.zeros(letters, bool), letter, letters
    for k in range(ORDERS):
        if k < ORDERS - 1:
            # A context and its byte are numbered by the number of what ends before the byte, and the byte. The first
            # bytes before the first unit have none; their numbers are not used, and never the last places of others'.
            keys = letter.copy()
            keys[1:] += ids[:-1].astype(np.int64) * letters
            places, ids = distinct(keys, n * letters)
            n = len(places)
            row, own = ids, np.maximum(places, k + 1)
            base = spans(own - k - 1, own)
        else:
            # Words, each with the byte that ends it, once; then the parts of the distinct ones.
            parts = (data == 32) | (data == 10)
            parts[begin] = parts[-1:] = True
            ends = np.flatnonzero(parts)
            starts = np.append(0, ends[:-1] + 1)
            lengths = ends + 1 - starts
            one, same = distinct(spans(starts, ends + 1))
            first = np.cumsum(lengths[one]) - lengths[one]
            begins = np.repeat(starts[one], lengths[one])
            places = begins + np.arange(len(begins)) - np.repeat(first, lengths[one])
            words = spans(begins, places)
            with np.errstate(over="ignore"):
                some, row = distinct(words + data[places] * MULTIPLIER)
            row = row.take(np.repeat(first[same] - starts, lengths) + np.arange(len(data)))
            own, base = places[some], words[some]
        with np.errstate(over="ignore"):
            x = table_[k].take(slots_of(k, (base ^ ORDER_SALT[k]) * MULTIPLIER, data[own], bits))
        xrows.append(x)
        rows.append(row)
        if k < ORDERS - 1:
            shorter = rows[-2] if k else letter
            odd = odd[shorter[places]] | (x == 0).any(1)
    odd = odd[rows[-2]] | (x == 0).any(1)[row]
    return xrows, rows, odd, data, begin + leads


def mixed_bits(units, weights: np.ndarray, table_: np.ndarray, bits: int) -> np.ndarray:
    """Bits of each unit (chunk, before, text index) under the gated mixer; ``weights`` (texts, GATES, ORDERS) are refined in place."""
    sizes = np.asarray([len(chunk) for chunk, _, _ in units])
    xrows, rows, odd, data, start = context_rows(units, table_, bits)
    # Units of like length side by side, in lanes small enough for the processor's cache.
    by_size = np.argsort(-sizes, kind="stable")
    cost = np.zeros(len(units))
    for i in range(0, len(units), LANE):
        lane = by_size[i : i + LANE]
        texts = [units[j][2] for j in lane]
        cost[lane] = lane_bits(start[lane], sizes[lane], texts, weights, xrows, rows, odd, data)
    return cost


def lane_bits(start, sizes, texts, weights, xrows, rows, odd, data) -> np.ndarray:
    """Bits of units of descending ``sizes``, block by block in lockstep; ``start``: their places in ``rows``, ``odd`` and ``data``.

    A step's arrays are (byte, unit, bit). Bits of which all predictors know their context, nearly
    all, take the unit's weights of that gate as they lie; the others' are looked up one by one.
    """
    blocks = -(-sizes // BLOCK)
    # Weights of each order: (unit, bit) where all contexts are known, (unit, bit, number known) elsewhere.
    held = weights[texts].reshape(len(texts), 8, ORDERS + 1, ORDERS)
    full = [np.ascontiguousarray(held[:, :, ORDERS, k]) for k in range(ORDERS)]
    part = [np.ascontiguousarray(held[:, :, :ORDERS, k]).reshape(-1) for k in range(ORDERS)]
    cost = np.zeros(len(texts))
    buffers = np.empty((ORDERS + 3, BLOCK * len(texts) * 8), np.float32)
    active = np.searchsorted(-blocks, -np.arange(blocks.max(initial=0)), side="left")
    for step, n in enumerate(active):
        *xs, dot, one, ys = (buffer[: BLOCK * n * 8].reshape(BLOCK, n, 8) for buffer in buffers)
        at = (start[:n] + step * BLOCK) + np.arange(BLOCK)[:, None]
        # Units that end within the step are filled up with their last byte, which then counts for nothing.
        ends = start[:n] + sizes[:n]
        over = at >= ends if (sizes[:n] < (step + 1) * BLOCK).any() else None
        if over is not None:
            at = np.minimum(at, ends - 1)
        for k in range(ORDERS):
            xrows[k].take(rows[k].take(at), axis=0, out=xs[k], mode="clip")
            if over is not None:
                xs[k][over] = 0
        np.multiply(full[0][:n], xs[0], out=dot)
        for k in range(1, ORDERS):
            dot += np.multiply(full[k][:n], xs[k], out=one)
        some = np.flatnonzero(odd.take(at) if over is None else odd.take(at) & ~over)
        if len(some):
            odd_known = sum((x.reshape(-1, 8)[some] != 0).view(np.int8) for x in xs)
            byte, bit = np.nonzero(odd_known != ORDERS)
            some = some[byte] * 8 + bit
            gate = (some // 8 % n * 8 + bit) * ORDERS + odd_known[byte, bit]
            odd_xs = [x.reshape(-1)[some] for x in xs]
            odd_dot = part[0][gate] * odd_xs[0]
            for k in range(1, ORDERS):
                odd_dot += part[k][gate] * odd_xs[k]
            dot.reshape(-1)[some] = odd_dot
        # Beyond the bounds of a probability nothing depends on the product, be its exponential infinite.
        with np.errstate(over="ignore"):
            np.exp(np.negative(dot, out=dot), out=dot)
        dot += 1
        p = np.divide(np.float32(1), dot, out=dot)
        np.minimum(np.maximum(p, LEAST, out=p), MOST, out=p)
        # The probability of the bit that came, p or 1 - p, is the distance of p from the other bit.
        slope = BIT_FLOAT.take(data.take(at), axis=0, out=ys, mode="clip")
        np.subtract(np.float32(1), ys, out=one)
        one -= p
        np.log2(np.abs(one, out=one), out=one)
        total = one[..., 0::2] + one[..., 1::2]
        total = total[..., 0::2] + total[..., 1::2]
        total = total[..., 0] + total[..., 1]
        if over is not None:
            total[over] = 0
        cost[:n] -= total.sum(0, dtype=np.float64)
        slope -= p
        slope *= np.float32(RATE)
        if len(some):
            odd_slope = slope.reshape(-1)[some]
            slope.reshape(-1)[some] = 0
            for k in range(ORDERS):
                part[k] += np.bincount(gate, odd_slope * odd_xs[k], minlength=len(part[k])).astype(np.float32)
        for k in range(ORDERS):
            xs[k] *= slope
            full[k][:n] += xs[k].sum(0, dtype=np.float64).astype(np.float32)
    for k in range(ORDERS):
        held[:, :, ORDERS, k] = full[k]
        held[:, :, :ORDERS, k] = part[k].reshape(len(texts), 8, ORDERS)
    weights[texts] = held.reshape(len(texts), GATES, ORDERS)
    return cost


def score_texts(path: str, bits: int, chunk_bytes: int):
    """Scoring pass: key, score (log10 probability), model_bytes and bits_per_byte of every row."""
    schema = pa.schema([("key", pa.int64()), ("score", pa.float64()), ("model_bytes", pa.int64()), ("bits_per_byte", pa.float64())])

    def run(batches):
        import pyarrow.compute as pc

        table_ = kept_table(path, bits)
        for batch in batches:
            keys = batch.column(1).to_numpy()
            texts = batch.column(0)
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
            cost, read = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
            group, length = [], 0

            def flush(group):
                weights = np.full((len(group), GATES, ORDERS), START_WEIGHT, np.float32)
                streams = [stream(t) for t in as_bytes(texts.take(pa.array(group)))]
                read[group] = [len(s) for s in streams]
                reading = [pieces_of(s, chunk_bytes) for s in streams]
                # The first chunks of all texts together, then the second of those that have one, and so on.
                while units := [(*piece, i) for i, rest in enumerate(reading) if (piece := next(rest, None))]:
                    for (_, _, i), c in zip(units, mixed_bits(units, weights, table_, bits), strict=True):
                        cost[group[i]] += c

            # Texts of like length together: a group takes as many steps as its longest text has blocks.
            for j in np.argsort(sizes, kind="stable").tolist():
                held = min(int(sizes[j]) + 1, chunk_bytes)
                if group and length + held > GROUP_BYTES:
                    flush(group)
                    group, length = [], 0
                group.append(j)
                length += held
            if group:
                flush(group)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys), pa.array(-cost * LOG10_2), pa.array(read), pa.array(cost / read)], schema=schema
            )
        give_back()

    return run


def table_bits(train_bytes: int, fewest: int = FEWEST_TABLE_BITS, most: int = MOST_TABLE_BITS) -> int:
    """Slots an order grow with the training bytes: about one slot per 256 bytes, within bounds."""
    return int(min(most, max(fewest, math.ceil(math.log2(max(train_bytes, 1))) - 8)))


def part_counts(training: DataFrame, chunk_bytes: int) -> DataFrame:
    """Tokens and grams of the training rows with their numbers, as ``count_parts`` has them."""
    parts = training.select("text").mapInArrow(count_parts(chunk_bytes), "token string, gram long, c long, w long, e long")
    # A task hands on each of its keys once: nothing to sum before the shuffle.
    return parts.repartition("token", "gram").groupBy("token", "gram").agg(*(F.sum(n).alias(n) for n in ("c", "w", "e")))


def context_counts(training: DataFrame, counted: DataFrame, bits: int, chunk_bytes: int, longest: int) -> DataFrame:
    """Zeros and ones of every context slot: from the counted tokens and grams, and from texts, of at most ``longest``
    bytes, with words that a chunk may cut."""
    block = "order int, block int, counts binary"
    blocks = counted.where("w > 0").select("token", "gram", "w", "e").mapInArrow(count_slots(bits), block)
    if longest >= chunk_bytes - 1:
        long = training.where(F.octet_length("text") >= chunk_bytes - 1).select("text")
        blocks = blocks.unionByName(long.mapInArrow(count_contexts(bits, chunk_bytes), block))
    return blocks.groupBy("order", "block").applyInArrow(sum_blocks(bits), "order int, slot long, n0 long, n1 long")


def lm_scores(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    most_table_bits: int = MOST_TABLE_BITS,
    chunk_bytes: int = CHUNK_BYTES,
    frequent: int = FREQUENT,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, model_bytes, bits_per_byte per row."""
    spark = docs.sparkSession
    rows = settle(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            F.col(text).alias("text"),
            (remainder(F.col(doc_id), FOLDS) == HELD_OUT).alias("held_out"),
            F.monotonically_increasing_id().alias("key"),
        ),
        "scored_rows",
    )
    training = rows.where(~F.col("held_out"))
    counted = settle(part_counts(training, chunk_bytes), "training_counts")
    counts = counted.where("token is not null and c > 0").select("token", "c")
    size = F.octet_length(F.coalesce("text", F.lit("")))
    totals = training.agg(
        F.count(F.lit(1)).alias("r"), F.sum(size).alias("b"), F.max(size).alias("longest")
    ).first()
    seen = counts.agg(F.count(F.lit(1)).alias("v"), F.sum("c").alias("n")).first()
    ends = int(totals["r"])
    n_total = int(seen["n"] or 0) + ends
    v_total = int(seen["v"]) + (1 if ends else 0)
    denominator = float(n_total + v_total + 1)

    # The base score: the most frequent tokens' part is summed where the texts are read, the others are joined to the counts.
    cut = counts.where(F.octet_length("token") <= FREQUENT_BYTES).orderBy(F.col("c").desc(), "token").limit(frequent)
    hot = fresh_path(spark, "frequent_tokens")
    cut.write.parquet(hot)
    per_row = settle(
        rows.select("text", "key").mapInArrow(
            row_tokens(hot, denominator), "key long, token string, m long, hot_words long, hot_score double"
        ),
        "row_tokens",
    )
    rest = per_row.where(F.col("token").isNotNull()).select("key", "token", "m").join(counts, "token", "left")
    rest = rest.groupBy("key").agg(
        F.sum(F.when(F.col("c") > 0, F.col("m")).otherwise(0)).alias("rest_words"),
        F.sum(F.col("m") * F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(denominator))).alias("rest_score"),
    )
    base = per_row.where(F.col("token").isNull()).join(rest, "key", "left").select(
        "key",
        F.col("m").alias("n_words"),
        (F.col("hot_words") + F.coalesce("rest_words", F.lit(0))).alias("known_words"),
        (F.col("hot_score") + F.coalesce("rest_score", F.lit(0.0))).alias("word_score"),
    )

    # The model: context counts of the training rows, summed by slot, then every row scored.
    bits = table_bits(int(totals["b"] or 0) + 2 * ends, most=most_table_bits)
    path = fresh_path(spark, "context_counts")
    context_counts(training, counted, bits, chunk_bytes, int(totals["longest"] or 0)).write.parquet(path)
    model = rows.select("text", "key").mapInArrow(
        score_texts(path, bits, chunk_bytes), "key long, score double, model_bytes long, bits_per_byte double"
    )

    end_score = math.log10((ends + 1) / denominator)
    return (
        rows.select("key", "doc_id", "held_out")
        .join(model, "key")
        .join(base, "key", "left")
        .select(
            "doc_id",
            "held_out",
            (F.coalesce("n_words", F.lit(0)) + 1).cast("long").alias("n_tokens"),
            (F.coalesce("known_words", F.lit(0)) + (1 if ends else 0)).cast("long").alias("n_known"),
            F.lit(n_total).cast("long").alias("train_tokens"),
            (F.coalesce("word_score", F.lit(0.0)) + F.lit(end_score)).alias("base_score"),
            "score",
            "model_bytes",
            "bits_per_byte",
        )
    )


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))
