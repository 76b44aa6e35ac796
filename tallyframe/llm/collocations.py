"""Phrase collocations by SON partitioning.

Texts are lower-cased in A-Z only, cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and the pieces
into words at spaces and tabs. Everything is counted per language (null: ``und``).

1. One Spark aggregate sums the bytes of each language.
2. SON, first pass, one phrase length after the other: each shard (rows of a task, at most
   ``shard_bytes`` of text together) is mined: its phrases are counted by sorting their
   64-bit keys in numpy, and those whose local count reaches
   ``min_count * shard bytes / all bytes`` of their language are locally frequent. A phrase
   below that share in every shard is below ``min_count`` in all, so the union of these sets
   holds every frequent phrase. A frequent phrase has only frequent parts: of 2 to 4 words,
   only phrases are counted whose two parts of one word less are candidates (told by a filter
   of fixed size, which may let others through but holds none back). Local support falls to 1
   when the table is much larger than a shard, so phrases of 2 to 4 words are first counted
   by buckets of their keys over the whole table (Park, Chen and Yu): about one bucket per 8 to
   16 bytes of text, two bytes of id and one of count for each bucket of a shard, summed by
   Spark. A phrase whose bucket stays below ``min_count`` is not mined; none that reaches it is lost.
3. Second pass: every shard counts exactly the phrases of all candidates (held in the task in
   blocks of at most ``block_keys``, one pass over the texts per block), and Spark sums
   them. Phrases are tuples of 64-bit word hashes; a hash that two words share is an error,
   raised by the query, so counts are exact.
4. Spark scores candidates (2 to 4 words, ``a >= min_count``) by their weakest cut,
   ``floor(2000000 * a / (l + r))`` in decimal arithmetic, drops those that lie inside a
   longer candidate with at least 80 % of their count, and keeps each language's first
   ``top`` by score, count and phrase.

Defined cases: null texts have no words; null languages are ``und``; rows and columns
besides ``text`` and ``lang`` are ignored (any names); repeated rows count again; an empty
table gives no rows; a very long text is one shard of its own, hashed in blocks that end with a piece.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tallyframe.llm.common import as_bytes, fresh_path, mix, settle, sliced, span_hashes, table
from tallyframe.llm.warc import open_store

#: Fixed values of the contract: piece and word separators, phrase lengths, thresholds.
PIECE_BREAKS = b".,;:!?\n\x0b\x0c\r"
WORD_BREAKS = b" \t"
LENGTHS = (2, 3, 4)
MIN_COUNT, TOP, SCALE, INSIDE_SHARE = 30, 2000, 2_000_000, 80

#: Bytes of text that one shard holds at most (a longer text is a shard of its own).
SHARD_BYTES = 1 << 23
#: Candidate keys a task holds at once; more are counted in further passes.
BLOCK_KEYS = 1 << 22
#: Bytes of text hashed at once: numpy's 64-bit arrays of a block stay in the processor's cache.
TEXT_BLOCK = 1 << 18
#: Last bits of a key in the filter of a mining task (a byte each) and in the index of a counting one (four each).
FILTER_BITS, INDEX_BITS = 25, 23
FILTER_MASK, INDEX_MASK = np.uint64((1 << FILTER_BITS) - 1), np.uint64((1 << INDEX_BITS) - 1)
#: Buckets of the phrases of one length: 2 ** bits within these bounds, a bit each in a mining task; buckets of a row: 2 ** 16.
FEWEST_BUCKET_BITS, MOST_BUCKET_BITS, BLOCK_BITS = 16, 29, 16
#: Languages whose word counts are broadcast at most; more are joined by a shuffle.
BROADCAST_LANGS = 100_000
RESULT = "lang string, rank long, phrase string, a long, l long, r long, n long, score long"

#: Bytes after lower-casing A-Z: piece breaks become 10, word breaks 32.
TABLE = bytes(
    10 if b in PIECE_BREAKS else 32 if b in WORD_BREAKS else b + 32 if 65 <= b <= 90 else b for b in range(256)
)
WORDS = ["w1", "w2", "w3", "w4"]
BUCKETS, HELD = "block int, ids binary, counts binary", "block int, held binary"
LOCAL = "code long, g int, k long, v long"
COUNTED = "lang string, g int, w1 long, w2 long, w3 long, w4 long, c long, word string"
STEP = np.uint64(0x9E3779B97F4A7C15)


class Words(NamedTuple):
    """The words of a shard, language by language."""

    names: list[str]  # the languages
    size: np.ndarray  # bytes of text, of each language
    total: np.ndarray  # bytes of text in the whole table, of each language
    bounds: np.ndarray  # first word of each language, and the number of words
    code: np.ndarray  # 64-bit code of each word's language
    hashes: np.ndarray  # 64-bit hash of each word
    piece: np.ndarray  # number of each word's piece
    starts: np.ndarray  # place of each word in ``text``
    ends: np.ndarray
    text: bytes


def text_blocks(texts):
    """Translated texts in blocks of about ``TEXT_BLOCK`` bytes; longer texts are cut where a piece ends."""
    held, size = [], 0
    for text in texts:
        text = (text or b"").translate(TABLE)
        at = 0
        while at < len(text):
            end = len(text)
            if end - at > TEXT_BLOCK:
                cut = text.rfind(b"\n", at, at + TEXT_BLOCK)
                cut = text.find(b"\n", at + TEXT_BLOCK) if cut < 0 else cut
                end = cut + 1 if cut >= 0 else end
            held.append(text[at:end])
            size += end - at + 1
            at = end
            if size >= TEXT_BLOCK:
                yield b"\n" + b"\n".join(held) + b"\n"
                held, size = [], 0
    if held:
        yield b"\n" + b"\n".join(held) + b"\n"


def shard_words(shard) -> Words:
    """The words of a shard's rows (text, lang, bytes of its language), hashed block by block."""
    by_lang: dict[str, list] = {}
    totals = {}
    for text, lang, total in shard:
        by_lang.setdefault(lang, []).append(text)
        totals[lang] = int(total)
    names = sorted(by_lang)
    parts, blocks, bounds, length, pieces = [], [], [0], 0, 0
    for name in names:
        n = 0
        for block in text_blocks(by_lang[name]):
            data = np.frombuffer(block, np.uint8)
            solid = (data != 10) & (data != 32)
            edge = np.flatnonzero(solid[1:] != solid[:-1]) + 1
            starts, ends = edge[0::2], edge[1::2]
            piece = np.cumsum(data == 10, dtype=np.int32)
            parts.append((span_hashes(data)(starts, ends), piece[starts] + pieces, starts + length, ends + length))
            blocks.append(block)
            length += len(block)
            pieces += int(piece[-1])
            n += len(starts)
        bounds.append(bounds[-1] + n)
    kinds = (np.uint64, np.int64, np.int64, np.int64)
    hashes, piece, starts, ends = (
        np.concatenate([part[i] for part in parts]) if parts else np.zeros(0, kind) for i, kind in enumerate(kinds)
    )
    hashes[hashes == 0] = 1
    codes = np.repeat(language_codes(names), np.diff(bounds))
    size = np.array([sum(len(t or b"") for t in by_lang[name]) for name in names], np.int64)
    total = np.array([totals[name] for name in names], np.int64)
    return Words(names, size, total, np.asarray(bounds), codes, hashes, piece, starts, ends, b"".join(blocks))


def longer_keys(words: Words, keys: np.ndarray | None, g: int) -> np.ndarray:
    """Keys of the ``g`` words from each word on, from those of ``g - 1`` words.

    A key is a 64-bit hash of a phrase's language and word hashes, the same in every shard.
    Where the words do not lie in one piece it stands for no phrase.
    """
    before = words.code if keys is None else keys[:-1]
    with np.errstate(over="ignore"):
        return mix(before * STEP + words.hashes[g - 1 :])


def in_one_piece(words: Words, g: int) -> np.ndarray:
    return words.piece[: max(len(words.piece) - g + 1, 0)] == words.piece[g - 1 :]


def counted_keys(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    edge = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    first = np.concatenate([np.zeros(min(len(keys), 1), np.int64), edge])
    return keys[first], np.diff(np.append(first, len(keys)))


def key_batches(path: str):
    """The keys written at ``path``, batch by batch."""
    import pyarrow.dataset as ds

    store, root = open_store(path)
    for batch in ds.dataset(root, filesystem=store, format="parquet").to_batches(columns=["k"]):
        yield batch.column(0).to_numpy().view(np.uint64)


def key_filter(path: str) -> np.ndarray:
    """Which values the last ``FILTER_BITS`` bits of the keys at ``path`` take: a size that does not grow with them."""
    held = np.zeros(1 << FILTER_BITS, bool)
    for keys in key_batches(path):
        held[keys & FILTER_MASK] = True
    return held


def phrase_keys(words: Words, g: int, known: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and keys of a shard's phrases of ``g`` words whose parts of ``g - 1`` words pass the filter ``known``."""
    keys = None
    for j in range(1, g):
        keys = longer_keys(words, keys, j)
    if g == 1:
        return np.arange(len(words.hashes)), longer_keys(words, None, 1)
    hit = known[keys & FILTER_MASK]
    at = np.flatnonzero(hit[:-1] & hit[1:] & in_one_piece(words, g))
    with np.errstate(over="ignore"):
        return at, mix(keys[at] * STEP + words.hashes[at + g - 1])


def bucket_bits(text_bytes: int) -> int:
    """Buckets grow with the bytes of text, one per 8 to 16 of them, within bounds."""
    return min(MOST_BUCKET_BITS, max(FEWEST_BUCKET_BITS, max(text_bytes, 1).bit_length() - 4))


def bucket_counts(g: int, shorter: str, bits: int, min_count: int, shard_bytes: int):
    """Counts of each shard's phrases of ``g`` words by bucket (the first ``bits`` of a key), at most ``min_count`` each.

    A row holds the buckets of one block of ``2 ** BLOCK_BITS``: their last bits and their counts.
    """
    schema = pa.schema([("block", pa.int32()), ("ids", pa.binary()), ("counts", pa.binary())])
    kind = np.min_scalar_type(min_count)

    def packed(values, ends):
        offsets = (ends * values.itemsize).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values)])

    def run(batches):
        known = key_filter(shorter)
        for shard in shards(batches, shard_bytes):
            keys = phrase_keys(shard_words(shard), g, known)[1]
            buckets, counts = counted_keys(keys >> np.uint64(64 - bits))
            if not len(buckets):
                continue
            blocks = (buckets >> np.uint64(BLOCK_BITS)).astype(np.int32)
            first = np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1]])
            ends = np.append(first, len(blocks))
            yield from sliced(pa.RecordBatch.from_arrays(
                [pa.array(blocks[first]), packed((buckets & np.uint64((1 << BLOCK_BITS) - 1)).astype("<u2"), ends),
                 packed(np.minimum(counts, min_count).astype(kind), ends)],
                schema=schema,
            ), 1 << 12)

    return run


def full_buckets(min_count: int):
    """Of a block's rows: a bit for each bucket, set where the counts reach ``min_count``."""
    kind = np.min_scalar_type(min_count)

    def run(rows: pa.Table) -> pa.Table:
        total = np.zeros(1 << BLOCK_BITS, np.int64)
        for ids, counts in zip(rows.column("ids"), rows.column("counts"), strict=True):
            total[np.frombuffer(ids.as_buffer(), "<u2")] += np.frombuffer(counts.as_buffer(), kind)
        return pa.table({
            "block": pa.array([rows.column("block")[0].as_py()], pa.int32()),
            "held": pa.array([np.packbits(total >= min_count).tobytes()], pa.binary()),
        })

    return run


def load_buckets(path: str, bits: int) -> np.ndarray:
    """The bits of all buckets, from the blocks at ``path``."""
    import pyarrow.dataset as ds

    store, root = open_store(path)
    held = np.zeros((1 << bits - BLOCK_BITS, (1 << BLOCK_BITS) // 8), np.uint8)
    for batch in ds.dataset(root, filesystem=store, format="parquet").to_batches(columns=["block", "held"], batch_size=1 << 10):
        for block, bits_ in zip(batch.column(0).to_numpy(), batch.column(1), strict=True):
            held[block] = np.frombuffer(bits_.as_buffer(), np.uint8)
    return held.reshape(-1)


def in_full_bucket(keys: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Whether the bit of each key's bucket is set."""
    bits = len(held).bit_length() + 2
    bucket = keys >> np.uint64(64 - bits)
    return (held[bucket >> np.uint64(3)] >> (7 - (bucket & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


def tuples(hashes, at, g):
    """The four word hashes of phrases of ``g`` words that start at ``at`` (0 beyond the phrase)."""
    return [hashes[at + j] if j < g else np.zeros(len(at), np.uint64) for j in range(4)]


def language_codes(names):
    """64-bit codes of languages, the same in every task."""
    import hashlib

    return np.array([int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little") for name in names], np.uint64)


def shards(batches, shard_bytes):
    """Rows of a task in shards of at most ``shard_bytes`` of text: lists of (text, lang, words of its language)."""
    held, size = [], 0
    for batch in batches:
        texts = as_bytes(batch.column(0))
        langs = batch.column(1).to_pylist()
        totals = batch.column(2).to_pylist()
        for text, lang, total in zip(texts, langs, totals, strict=True):
            if held and size + len(text or b"") > shard_bytes:
                yield held
                held, size = [], 0
            held.append((text, lang, total))
            size += len(text or b"")
    if held:
        yield held


def local_frequent(g: int, shorter: str | None, min_count: int, shard_bytes: int, buckets: str | None = None, bits: int = 0):
    """First SON pass for phrases of ``g`` words: the locally frequent ones of each shard, and each shard's slack.

    ``shorter`` is where the candidates of ``g - 1`` words lie: a phrase can only be frequent
    if both its phrases of ``g - 1`` words are, so the others are not looked at. ``buckets`` is
    where the full ones of ``2 ** bits`` buckets lie: a phrase of any other is not frequent.

    A phrase's rows carry ``count - (need - 1)``, where ``need`` is the local support of its
    language; a row with ``g = 0`` carries ``need - 1`` of a language of the shard. Summed,
    ``slack + sum`` bounds the phrase's count from above: in a shard where it is not
    locally frequent it occurs at most ``need - 1`` times.
    """
    schema = pa.schema([("code", pa.int64()), ("g", pa.int32()), ("k", pa.int64()), ("v", pa.int64())])

    def rows(code, g, keys, v):
        n = len(keys)
        yield from sliced(pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, code, np.uint64).view(np.int64)), pa.array(np.full(n, g, np.int32)), pa.array(keys.view(np.int64)),
             pa.array(v)],
            schema=schema,
        ))

    def run(batches):
        known = key_filter(shorter) if shorter else None
        full = load_buckets(buckets, bits) if buckets else None
        for shard in shards(batches, shard_bytes):
            words = shard_words(shard)
            at, keys = phrase_keys(words, g, known)
            if full is not None:
                own = in_full_bucket(keys, full)
                at, keys = at[own], keys[own]
            ends = np.searchsorted(at, words.bounds)
            for i, code in enumerate(language_codes(words.names)):
                # Locally frequent: count * all bytes >= min_count * shard bytes of the language, in integers.
                need = -(-min_count * int(words.size[i]) // int(words.total[i])) if words.size[i] else 0
                slack = max(need - 1, 0)
                if slack:
                    yield from rows(code, 0, np.zeros(1, np.uint64), np.array([slack], np.int64))
                found, counts = counted_keys(keys[ends[i] : ends[i + 1]])
                keep = counts >= max(need, 1)
                yield from rows(code, g, found[keep], counts[keep] - slack)

    return run


def candidate_counts(paths: list[str], block: int, blocks: int, shard_bytes: int):
    """Second SON pass: exact counts of the phrases whose keys at ``paths`` fall in block ``block`` of ``blocks``."""
    schema = pa.schema(
        [("lang", pa.string()), ("g", pa.int32()), *[(w, pa.int64()) for w in WORDS], ("c", pa.int64()), ("word", pa.string())]
    )

    def run(batches):
        held = [keys[(keys >> np.uint64(32)) % np.uint64(blocks) == np.uint64(block)] for path in paths for keys in key_batches(path)]
        wanted = np.unique(np.concatenate(held)) if held else np.zeros(0, np.uint64)
        index = np.full(1 << INDEX_BITS, -1, np.int32)
        index[wanted & INDEX_MASK] = np.arange(len(wanted), dtype=np.int32)
        for shard in shards(batches, shard_bytes):
            words = shard_words(shard)
            names = words.names
            lang = np.repeat(np.arange(len(names)), np.diff(words.bounds))
            if block == 0:  # the words of each language, counted once
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.string()), pa.array(np.zeros(len(names), np.int32)),
                     *[pa.array(np.zeros(len(names), np.int64)) for _ in WORDS],
                     pa.array(np.diff(words.bounds).astype(np.int64)), pa.array([None] * len(names), pa.string())],
                    schema=schema,
                )
            keys = None
            for g in range(1, min(4, len(words.hashes)) + 1):
                keys = longer_keys(words, keys, g)
                at, counts = places(words, lang, keys, g, wanted, index)
                spelt = [words.text[words.starts[i] : words.ends[i]].decode() for i in at] if g == 1 else [None] * len(at)
                yield from sliced(pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.asarray(names, dtype=object)[lang[at]], pa.string()),
                        pa.array(np.full(len(at), g, np.int32)),
                        *[pa.array(c.view(np.int64)) for c in tuples(words.hashes, at, g)],
                        pa.array(counts.astype(np.int64)),
                        pa.array(spelt, pa.string()),
                    ],
                    schema=schema,
                ))

    return run


def places(words: Words, lang, keys, g: int, wanted, index):
    """One place and the count of each phrase of ``g`` words of a shard whose key is wanted.

    ``index`` leads from the last bits of a key to its place in the sorted ``wanted``; keys
    that share them with another are searched for.
    """
    guess = index[keys & INDEX_MASK]
    at = np.flatnonzero((guess >= 0) & in_one_piece(words, g))
    which, own = guess[at], keys[at]
    off = np.flatnonzero(wanted[which] != own)
    if len(off):
        found = np.minimum(np.searchsorted(wanted, own[off]), len(wanted) - 1)
        which[off] = np.where(wanted[found] == own[off], found, -1)
        at, which = at[which >= 0], which[which >= 0]
    counts = np.bincount(which, minlength=len(wanted))
    place = np.zeros(len(wanted), np.int64)
    place[which] = at
    same = lang[at] == lang[place[which]]
    for j in range(g):
        same &= words.hashes[at + j] == words.hashes[place[which] + j]
    if same.all():
        seen = np.flatnonzero(counts)
        return place[seen], counts[seen]
    # Two phrases share a key: group them by all their parts instead.
    parts = np.rec.fromarrays([lang[at], *[words.hashes[at + j] for j in range(g)]])
    _, first, counts = np.unique(parts, return_index=True, return_counts=True)
    return at[first], counts


def collocations(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    min_count: int = MIN_COUNT,
    top: int = TOP,
    shard_bytes: int = SHARD_BYTES,
    block_keys: int = BLOCK_KEYS,
) -> DataFrame:
    """Each language's ``top`` collocations: lang, rank, phrase, a, l, r, n, score (numbers long).

    ``a`` is the phrase's count, ``l`` and ``r`` those of the two parts of its weakest cut
    (lowest score, then fewest words on the left), ``n`` the language's words.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(text).alias("text"), F.coalesce(F.col(lang), F.lit("und")).alias("lang"))
    # Local support follows a shard's share of its language's bytes: any additive share keeps SON exact.
    totals = rows.groupBy("lang").agg(F.sum(F.octet_length(F.coalesce("text", F.lit("")))).cast("long").alias("n"))
    totals = settle(totals, "languages")
    # Each row carries its language's words: by broadcast if the languages are few, as checked, else by a shuffle.
    size = totals.agg(F.count(F.lit(1)).alias("langs"), F.sum("n").alias("bytes")).first()
    few, bits = size["langs"] <= BROADCAST_LANGS, bucket_bits(int(size["bytes"] or 0))
    sized = rows.join(F.broadcast(totals) if few else totals, "lang").select("text", "lang", "n")

    paths: list[str] = []
    for g in range(1, 5):
        # A job a length, so that only phrases are looked at whose parts can be frequent.
        shorter = paths[-1] if paths else None
        buckets = None
        if shorter:
            buckets = fresh_path(spark, "buckets")
            parts = sized.mapInArrow(bucket_counts(g, shorter, bits, min_count, shard_bytes), BUCKETS)
            parts.groupBy("block").applyInArrow(full_buckets(min_count), HELD).write.parquet(buckets)
        local = sized.mapInArrow(local_frequent(g, shorter, min_count, shard_bytes, buckets, bits), LOCAL)
        summed = settle(local.groupBy("code", "g", "k").agg(F.sum("v").alias("v")), f"local_{g}")
        slack = summed.where("g = 0").select("code", F.col("v").alias("slack"))
        found = summed.where("g > 0").join(F.broadcast(slack) if few else slack, "code", "left")
        # Only candidates that could reach min_count: the bound is never below the count.
        found = found.where(F.coalesce("slack", F.lit(0)) + F.col("v") >= min_count)
        path = fresh_path(spark, "phrases")
        found.select("k").write.parquet(path)
        if spark.read.schema("k long").parquet(path).isEmpty():
            break
        paths.append(path)
    if not paths:
        return spark.createDataFrame([], RESULT)
    count = sum(spark.read.schema("k long").parquet(path).count() for path in paths)
    blocks = max(1, math.ceil(count / block_keys))

    counted = None
    for block in range(blocks):
        part = sized.mapInArrow(candidate_counts(paths, block, blocks, shard_bytes), COUNTED)
        counted = part if counted is None else counted.unionByName(part)
    # Written once: the steps below read these few rows many times. Spellings are a key, as minima of texts are not hashed.
    exact = settle(counted.groupBy("lang", "g", *WORDS, "word").agg(F.sum("c").alias("f")), "counted")
    words = exact.where("g = 0").select("lang", F.col("f").alias("n"))
    # Every phrase whose key is asked for is counted in every shard, so its count is exact.
    single = exact.where("g = 1").groupBy("lang", "g", *WORDS).agg(
        F.sum("f").alias("f"), F.min("word").alias("word"), F.max("word").alias("other")
    )
    single = single.withColumn(
        "f", F.when(F.col("word") != F.col("other"), F.raise_error(F.lit("two words share a 64-bit hash"))).otherwise(F.col("f"))
    )
    exact = exact.where("g > 1").unionByName(settle(single.drop("other"), "words"))
    return score_phrases(exact, words, min_count, top)


def score_phrases(exact: DataFrame, totals: DataFrame, min_count: int, top: int) -> DataFrame:
    """Scores, containment and ranks of the counted phrases (lang, g, w1..w4, f, word)."""
    words = exact.where("g = 1").select("lang", F.col("w1").alias("w"), "word")
    frequent = exact.where(F.col("f") >= min_count).select("lang", "g", *WORDS, "f")
    phrases = frequent.where(F.col("g").isin(*LENGTHS))
    parts = [F.col(w) for w in WORDS]
    zero = F.lit(0).cast("long")

    cuts = phrases.select("*", F.explode(F.sequence(F.lit(1), F.col("g") - 1)).alias("cut"))
    left = [F.when(F.col("cut") > j, parts[j]).otherwise(zero).alias(f"l{j + 1}") for j in range(4)]
    right = [
        F.coalesce(F.try_element_at(F.array(*parts), F.col("cut") + j + 1), zero).alias(f"r{j + 1}") if j < 3 else zero.alias("r4")
        for j in range(4)
    ]
    cuts = cuts.select("lang", "g", *WORDS, F.col("f").alias("a"), "cut", *left, *right)
    cuts = cuts.withColumn("r_g", F.col("g") - F.col("cut"))
    lefts = exact.select("lang", F.col("g").alias("cut"), *[F.col(w).alias(f"l{j + 1}") for j, w in enumerate(WORDS)], F.col("f").alias("l"))
    rights = exact.select("lang", F.col("g").alias("r_g"), *[F.col(w).alias(f"r{j + 1}") for j, w in enumerate(WORDS)], F.col("f").alias("r"))
    cuts = cuts.join(lefts, ["lang", "cut", "l1", "l2", "l3", "l4"]).join(rights, ["lang", "r_g", "r1", "r2", "r3", "r4"])
    score = F.expr(f"(CAST(a AS DECIMAL(38,0)) * {SCALE}) div (CAST(l AS DECIMAL(38,0)) + CAST(r AS DECIMAL(38,0)))")
    cuts = cuts.withColumn("score", score.cast("long"))
    weakest = cuts.groupBy("lang", "g", *WORDS, "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("m"))

    # Candidates inside a longer candidate with 80 % of their count or more are dropped.
    longer = frequent.where(F.col("g") >= 3)
    inside = None
    for size in (2, 3):
        for start in range(0, 4 - size + 1):
            sub = longer.where((F.col("g") > size) & (F.col("g") >= start + size))
            cols = [parts[start + j].alias(WORDS[j]) for j in range(size)] + [zero.alias(w) for w in WORDS[size:]]
            piece = sub.select("lang", F.lit(size).alias("g"), *cols, F.col("f").alias("outer"))
            inside = piece if inside is None else inside.unionByName(piece)
    covering = inside.groupBy("lang", "g", *WORDS).agg(F.max("outer").alias("outer"))
    scored = weakest.join(covering, ["lang", "g", *WORDS], "left").where(
        F.col("outer").isNull() | (F.col("outer") * 100 < F.col("a") * INSIDE_SHARE)
    )

    # The phrase's words, read back by their hashes.
    spelled = scored.select("lang", "g", *WORDS, F.posexplode(F.array(*parts)).alias("at", "w")).where(F.col("at") < F.col("g"))
    spelled = spelled.join(words, ["lang", "w"]).groupBy("lang", "g", *WORDS).agg(
        F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda s: s["word"])).alias("phrase")
    )
    result = scored.join(spelled, ["lang", "g", *WORDS]).join(totals, "lang")
    order = Window.partitionBy("lang").orderBy(F.col("m.score").desc(), F.col("a").desc(), F.col("phrase").asc())
    ranked = result.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select(
        "lang",
        F.col("rank").cast("long").alias("rank"),
        "phrase",
        F.col("a").cast("long").alias("a"),
        F.col("m.l").cast("long").alias("l"),
        F.col("m.r").cast("long").alias("r"),
        F.col("n").cast("long").alias("n"),
        F.col("m.score").cast("long").alias("score"),
    )


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


#: The same in DuckDB SQL: every phrase counted by its text.
ORACLE = r"""
WITH docs AS (
  SELECT coalesce(lang, 'und') AS lang,
         regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                               '[.,;:!?\x0A-\x0D]') AS pieces
  FROM documents),
pieces AS (SELECT lang, regexp_extract_all(unnest(pieces), '[^\x20\x09]+') AS w FROM docs),
grams AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS s FROM pieces WHERE len(w) > 0),
phrases AS (
  SELECT lang, g, w[s:s + g - 1] AS p FROM grams, (SELECT unnest(range(1, 5)) AS g) AS lengths WHERE s + g - 1 <= len(w)),
f AS (SELECT lang, array_to_string(p, ' ') AS key, count(*) AS f FROM phrases GROUP BY ALL),
n AS (SELECT lang, count(*) AS n FROM phrases WHERE g = 1 GROUP BY ALL),
cand AS (
  SELECT lang, p, array_to_string(p, ' ') AS key, count(*) AS a FROM phrases WHERE g >= 2 GROUP BY ALL HAVING count(*) >= 30),
cuts AS (
  SELECT c.lang, c.key, c.a, k, array_to_string(c.p[1:k], ' ') AS lkey, array_to_string(c.p[k + 1:], ' ') AS rkey
  FROM cand c, (SELECT unnest(range(1, 4)) AS k) AS ks WHERE k < len(c.p)),
scored AS (
  SELECT c.lang, c.key, c.a, c.k, l.f AS l, r.f AS r,
         (CAST(c.a AS HUGEINT) * 2000000) // (CAST(l.f AS HUGEINT) + r.f) AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.key = c.lkey JOIN f r ON r.lang = c.lang AND r.key = c.rkey),
best AS (
  SELECT lang, key, a, arg_min(l, score * 10 + k) AS l, arg_min(r, score * 10 + k) AS r, min(score) AS score
  FROM scored GROUP BY ALL),
inside AS (
  SELECT o.lang, array_to_string(o.p[s:s + size - 1], ' ') AS key, max(o.a) AS outer_a
  FROM cand o, (SELECT unnest(range(1, 4)) AS s) AS ss, (SELECT unnest(range(2, 4)) AS size) AS sizes
  WHERE size < len(o.p) AND s + size - 1 <= len(o.p) GROUP BY ALL),
kept AS (
  SELECT b.* FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.key = b.key
  WHERE i.outer_a IS NULL OR 100 * i.outer_a < 80 * b.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT k.lang, CAST(row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, encode(k.key)) AS BIGINT) AS rank,
         k.key AS phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
         CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
  FROM kept k JOIN n ON n.lang = k.lang)
WHERE rank <= 2000
"""
