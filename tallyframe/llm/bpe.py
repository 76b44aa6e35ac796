"""Byte-level BPE by recursive DuckDB queries inside each partition, and back.

A task splits its texts into pre-tokens and encodes each distinct one once. A pre-token
that is in the vocabulary is one token. The others become token-position rows, one for
each byte; a recursive query joins neighbouring rows with the merge table, picks each
word's pair of the lowest rank, the leftmost of equals, and contracts it, until no pair
is left. Decoding joins the ids of each text with the vocabulary and puts their bytes
together by an ordered aggregate.

The merge table holds every pair of tokens whose bytes together are a token, so a lowest
pair is what the rank file's own library would merge. Rows are worked on in bounded blocks.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyframe.llm.common import table
from tallyframe.llm.token_counts import vocabulary_path

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Bytes of text, and of words to encode, that are worked on together; words that a task remembers; rounds of one query.
BLOCK_BYTES, WORD_BYTES, REMEMBERED, ROUNDS = 1 << 20, 1 << 19, 500_000, 24
#: Ids that one query puts together, rows that the rounds of one query may make, memory of a task's database.
DECODED, ROUND_ROWS = 1 << 18, 1 << 22
MEMORY = "400MB"

#: Longest word, in bytes, of the first query.
SHORT = 64

#: One round: of each word the pair with the lowest rank, leftmost first, is found by one minimum
#: of a number that holds rank, position, and the lengths of the left token and of both. ``pos``
#: and ``stop`` are byte positions in the block; words are parted by a gap, so tokens of two
#: words never meet.
CONTRACT = """
with recursive state as (
    select word, pos, stop, token, 0 as round from tokens
    union all
    (with best as (
        select a.word, min((m.token::bigint << 40) | (a.pos::bigint << 14) | ((b.pos - a.pos) << 7) | (b.stop - a.pos)) as k
        from state a join state b on b.pos = a.stop join merges m on m.pair = a.token::bigint * 65536 + b.token
        where a.round < {rounds} group by a.word
    ), picked as (
        select word, (k >> 40)::int as token, ((k >> 14) & 67108863)::int as pos, ((k >> 7) & 127)::int as middle, (k & 127)::int as size
        from best
    )
    select s.word, s.pos, case when s.pos = p.pos then p.pos + p.size else s.stop end,
        case when s.pos = p.pos then p.token else s.token end, s.round + 1
    from state s join picked p on s.word = p.word where s.pos <> p.pos + p.middle)
)
select word, pos, stop, token, round from state
"""

#: The same for long words, in fewer rounds: a rank that can never lead to a lower one (``calm``) is
#: contracted at all places that do not overlap at once, which is what taking them one after
#: another comes to.
CONTRACT_LONG = """
with recursive state as (
    select word, pos, stop, token, 0 as round from tokens
    union all
    (with pairs as (
        select a.word, a.pos, b.pos as middle, b.stop, m.token, m.calm
        from state a join state b on b.pos = a.stop join merges m on m.pair = a.token::bigint * 65536 + b.token
        where a.round < {rounds}
    ), lowest as (
        select word, best >> 32 as token, best & 4294967295 as first
        from (select word, min((token::bigint << 32) | pos) as best from pairs group by word)
    ), candidates as (
        select p.*, lag(p.middle) over (partition by p.word order by p.pos) as before
        from pairs p join lowest l on p.word = l.word and p.token = l.token
        where p.calm or p.pos = l.first
    ), chains as (
        select *, sum(case when before = pos then 0 else 1 end) over (partition by word order by pos) as chain from candidates
    ), picked as (
        select * from (select *, row_number() over (partition by word, chain order by pos) as place from chains) where place % 2 = 1
    )
    select s.word, s.pos, coalesce(p.stop, s.stop), coalesce(p.token, s.token), s.round + 1
    from state s join lowest l on s.word = l.word left join picked p on p.pos = s.pos
    where s.pos not in (select middle from picked))
)
select word, pos, stop, token, round from state
"""

DECODE = """
select string_agg(v.bytes, '' order by t.place) from ids t join vocabulary v on v.token = t.token
"""


def load_ranks(vocabulary: str) -> dict[bytes, int]:
    with open(vocabulary_path(vocabulary), "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Coder:
    """The tables of one vocabulary in a database that only this process has, and the words known so far."""

    def __init__(self, vocabulary: str):
        import duckdb
        from public_tokenizers import PATTERN

        self.ranks = load_ranks(vocabulary)
        self.find = regex.compile(PATTERN).findall
        self.con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": MEMORY})
        left, right, token = [], [], []
        for word, rank in self.ranks.items():
            for cut in range(1, len(word)):
                a, b = self.ranks.get(word[:cut]), self.ranks.get(word[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), token.append(rank)
        left, right, token = (np.array(x, np.int64) for x in (left, right, token))
        uneasy = np.unique(np.concatenate([left[left > token], right[right > token]]))
        merges = pa.table({"pair": left * 65536 + right, "token": token.astype(np.int32), "calm": ~np.isin(token, uneasy)})
        vocabulary_rows = pa.table({"token": pa.array(list(self.ranks.values()), pa.int32()), "bytes": [w.hex() for w in self.ranks]})
        for name, rows in (("merges", merges), ("vocabulary", vocabulary_rows)):
            self.con.register("rows", rows)
            self.con.execute(f"create table {name} as select * from rows")
            self.con.unregister("rows")
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.sizes = np.zeros(max(self.ranks.values()) + 1, np.int64)
        self.sizes[list(self.ranks.values())] = [len(w) for w in self.ranks]
        self.decimal = [str(k) for k in range(max(self.ranks.values()) + 1)]
        self.forget()

    def forget(self, keep: np.ndarray | None = None) -> None:
        """Drop the words known so far, but for those numbered in ``keep``."""
        words = list(self.known) if keep is not None and len(keep) else []
        kept = [(words[k], self.ids[k]) for k in keep.tolist()] if words else []
        self.known: dict[str, int] = {}
        self.ids: list[bytes] = []  # each word's ids as packed 32-bit numbers
        self.uses = np.zeros(0, np.int32)
        for entry in kept:
            self.add(*entry)

    def add(self, word: str, ids: bytes) -> None:
        self.known[word] = len(self.ids)
        self.ids.append(ids)

    def learn(self, words: Iterable[str]) -> None:
        """Encode words that are not yet known, in blocks of about ``WORD_BYTES``."""
        held: dict[str, list[tuple[str, bytes]]] = {CONTRACT: [], CONTRACT_LONG: []}
        size = dict.fromkeys(held, 0)
        for word in words:
            whole = self.ranks.get(data := word.encode())
            if whole is not None:
                self.add(word, whole.to_bytes(4, "little"))
                continue
            query = CONTRACT if len(data) <= SHORT else CONTRACT_LONG
            held[query].append((word, data))
            size[query] += len(data)
            if size[query] >= WORD_BYTES:
                self.contract(held[query], query)
                held[query], size[query] = [], 0
        for query, block in held.items():
            if block:
                self.contract(block, query)

    def contract(self, block: list[tuple[str, bytes]], query: str) -> None:
        data = np.frombuffer(b"".join(d for _, d in block), np.uint8)
        number = np.repeat(np.arange(len(block)), [len(d) for _, d in block])
        at = np.arange(len(data)) + number  # a gap of one after each word
        columns = [number, at, at + 1, self.single[data]]
        while len(columns[0]):
            names = ("word", "pos", "stop", "token")
            self.con.register("tokens", pa.table({n: pa.array(c, pa.int32()) for n, c in zip(names, columns)}))
            most = max(1, min(ROUNDS, ROUND_ROWS // len(columns[0])))
            found = self.con.sql(query.format(rounds=most)).to_arrow_table()
            self.con.unregister("tokens")
            *columns, rounds = (c.to_numpy() for c in found.columns)
            last = np.zeros(len(block), rounds.dtype)
            np.maximum.at(last, columns[0], rounds)
            final = np.flatnonzero(rounds == last[columns[0]])
            final = final[np.argsort(columns[1][final], kind="stable")]
            columns = [c[final] for c in columns]
            word, token = columns[0], columns[3]
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]).tolist()
            done = (last[word] < most).tolist()
            ids = token.astype("<i4").tobytes()
            for s, e, k in zip(starts, [*starts[1:], len(word)], word[starts].tolist()):
                if done[s]:
                    self.add(block[k][0], ids[4 * s : 4 * e])
            columns = [c[last[word] >= most] for c in columns]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        found = [self.find(text) for text in texts]
        self.learn(set().union(*found).difference(self.known))
        numbers = [list(map(self.known.__getitem__, words)) for words in found]
        ids = [np.frombuffer(b"".join(map(self.ids.__getitem__, row)), "<i4") for row in numbers]
        self.uses = np.concatenate([self.uses, np.zeros(len(self.ids) - len(self.uses), np.int32)])
        for row in numbers:
            self.uses[row] += 1
        if len(self.ids) > REMEMBERED:  # the words that the most texts had stay
            self.forget(np.argsort(-self.uses, kind="stable")[: REMEMBERED // 4])
        return ids

    def listed(self, ids: np.ndarray) -> str:
        """The ids in decimal, parted by commas."""
        return ",".join(map(self.decimal.__getitem__, ids.tolist()))

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The bytes of each list of ids, which are put together in order, so many at a time, and cut apart by their lengths."""
        tokens = np.concatenate([np.zeros(0, np.int32), *ids])
        parts = []
        for at in range(0, len(tokens), DECODED):
            some = tokens[at : at + DECODED]
            self.con.register("ids", pa.table({"place": pa.array(np.arange(len(some)), pa.int32()), "token": pa.array(some, pa.int32())}))
            parts.append(bytes.fromhex(self.con.sql(DECODE).fetchall()[0][0]))
            self.con.unregister("ids")
        data = b"".join(parts)
        ends = np.cumsum([int(self.sizes[i].sum()) for i in ids])
        return [data[start:end] for start, end in zip([0, *ends[:-1].tolist()], ends.tolist())]


def blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, list[str]]]:
    """Texts of a column in blocks of about ``most`` characters, with the number of the first."""
    block, first, size = [], 0, 0
    for k, value in enumerate(column):
        block.append(value.as_py() or "")
        size += len(block[-1])
        if size >= most:
            yield first, block
            block, first, size = [], k + 1, 0
    if block:
        yield first, block


def encoded_documents(
    docs: DataFrame, vocabulary: str = VOCABULARY, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False
) -> DataFrame:
    """Number of tokens, digests of the ids and of the decoded bytes, and the ids if wanted, of every row.

    A null text counts as empty: no tokens, and the digests of nothing. Rows come out as
    often as they come in; an empty table gives an empty result. A special token's string in
    a text is ordinary text.
    """
    slim = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for batch in batches:
            for first, texts in blocks(batch.column(1)):
                coder = coder or Coder(vocabulary)
                ids = coder.encode(texts)
                decoded = coder.decode(ids)
                digest = lambda data: hashlib.sha256(data).hexdigest()
                arrays = [
                    batch.column(0).slice(first, len(texts)),
                    pa.array([len(i) for i in ids], pa.int64()),
                    pa.array([digest(coder.listed(i).encode()) for i in ids]),
                    pa.array([digest(d) for d in decoded]),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    arrays.append(pa.array([i.tolist() for i in ids], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_documents(table(spark, sf_dir, "documents"))
