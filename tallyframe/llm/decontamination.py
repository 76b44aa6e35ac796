"""Benchmark passages in documents, found by CGK embedding and bit sampling.

Windows of a document are as many words long as an item. A window and an item are each
embedded by the same random walks: at every step the walk puts out the word it stands at
and goes on to the next one if a random bit of step and word says so. Two sequences with a
small edit distance walk together again soon after each edit, so their embeddings differ in
few steps (Chakraborty, Goldenberg and Koucky). Sampling ``SAMPLED`` steps of a walk gives
a hash on which similar sequences agree with a fair chance; walks are repeated until the
chance that none agrees is below 1 - ``RECALL``, by the rate measured on edited items.
Windows and items of one length with an equal hash are candidates, and their exact edit
distance in words decides.

What matches an item of ``n`` words within ``t`` edits has n - t to n + t words and shares a
run of ``q`` words with it whenever n - q + 1 - q t > 0. Windows at whose start nothing of
that size would hold such a run of an item of their length can begin no match and are not
embedded. That leaves out no match.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from tallyframe.llm.common import as_bytes, fresh, mix, table, with_columns, word_hashes
from tallyframe.llm.words import parted_words

#: Words of an item for each edit that is allowed, sampled steps, recall aimed at.
WORDS_PER_EDIT, SAMPLED, RECALL = 5, 3, 0.95
LONGEST_RUN, WINDOWS_AT_ONCE, TEXT_BYTES = 4, 4096, 1 << 21
#: Words of the items that are searched in one reading of the documents; more items take more readings.
BLOCK_WORDS = 1 << 19
FILTER_LOG2 = 22


def allowed_edits(n: int) -> int:
    return n // WORDS_PER_EDIT


def shared_run(n: int) -> int:
    """The longest run, up to ``LONGEST_RUN`` words, that a match must share with an item of ``n`` words."""
    return next((q for q in range(min(LONGEST_RUN, n), 0, -1) if n - q + 1 - q * allowed_edits(n) > 0), 1)


def words_of(text: bytes | None) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint64), *map(word_hashes, parted_words(text))])


def runs(words: np.ndarray, size: int) -> np.ndarray:
    n = max(0, len(words) - size + 1)
    total = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            total = total * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n]
    return mix(total)


def edit_distances(left: np.ndarray, right: np.ndarray, least: int, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least edit distance in words between each row of ``left`` and a beginning of the same row of ``right``.

    Beginnings have ``least`` to ``sizes`` words. Also gives the size of the best, the smallest of equals.
    """
    steps = np.arange(right.shape[1] + 1)
    row = np.broadcast_to(steps, (len(left), len(steps))).astype(np.int32)
    for k in range(left.shape[1]):
        new = np.empty_like(row)
        new[:, 0] = k + 1
        new[:, 1:] = np.minimum(row[:, :-1] + (right != left[:, k : k + 1]), row[:, 1:] + 1)
        row = np.minimum.accumulate(new - steps, axis=1) + steps
    row = np.where((steps >= least) & (steps <= sizes[:, None]), row, 1 << 30)
    best = row.argmin(axis=1)
    return row[np.arange(len(left)), best], best


def walk_factors(repetitions: int, steps: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and offsets: the bit of a step and a word is the top bit of word * factor + offset."""
    random = np.random.default_rng(seed)
    draw = random.integers(0, 1 << 63, (2, repetitions, steps), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return draw[0], draw[1] ^ (draw[1] >> np.uint64(7))


def walk(words: np.ndarray, first: np.ndarray, end: np.ndarray, factors, steps: int) -> Iterator[np.ndarray]:
    """What each walk puts out at each step, one row for each repetition; 0 after the end."""
    multiply, offset = factors
    at = np.broadcast_to(first, (multiply.shape[0], len(first))).copy()
    padded = np.append(words, np.uint64(0))
    with np.errstate(over="ignore"):
        for step in range(steps):
            inside = at < end
            here = np.where(inside, padded[np.minimum(at, len(words))], np.uint64(0))
            yield here
            bit = (here * multiply[:, step, None] + offset[:, step, None]) >> np.uint64(63)
            at += bit.astype(at.dtype)


@dataclass(frozen=True)
class Index:
    """Items of one block, by number, and what the search needs of them."""

    words: tuple[np.ndarray, ...]
    repetitions: int
    seed: int = 11

    @property
    def lengths(self) -> np.ndarray:
        return np.array([len(w) for w in self.words], np.int64)

    def sampled_steps(self, n: int) -> np.ndarray:
        """For each repetition the steps that make its hash."""
        random = np.random.default_rng([self.seed, n])
        return np.sort(np.stack([random.choice(2 * n, min(SAMPLED, 2 * n), replace=False) for _ in range(self.repetitions)]), axis=1)

    def hashes(self, words: np.ndarray, first: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
        """The hashes of windows by repetition and window."""
        sampled = self.sampled_steps(n)
        steps = int(sampled.max()) + 1
        taken = np.zeros((self.repetitions, steps), bool)
        np.put_along_axis(taken, sampled, True, axis=1)
        total = np.zeros((self.repetitions, len(first)), np.uint64)
        with np.errstate(over="ignore"):
            for step, here in enumerate(walk(words, first, end, walk_factors(self.repetitions, 2 * n, self.seed + n), steps)):
                rows = taken[:, step]
                total[rows] = mix(total[rows] * np.uint64(0x9E3779B97F4A7C15) + here[rows] + np.uint64(1))
        return total

    def prepared(self) -> Search:
        lengths = self.lengths
        seeds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for q in range(1, LONGEST_RUN + 1):
            pairs = [(run, n) for w, n in zip(self.words, lengths) if n and shared_run(int(n)) == q for run in runs(w, q).tolist()]
            if pairs:
                made = np.unique(np.array(pairs, np.uint64), axis=0)
                seeds[q] = (made[:, 0], made[:, 1].astype(np.int64))
        for n in np.unique(lengths[lengths > 0]).tolist():
            members = np.flatnonzero(lengths == n)
            flat = np.concatenate([self.words[m] for m in members])
            first = np.arange(len(members)) * n
            by_length[n] = (members, self.hashes(flat, first, first + n, n))
        return Search(self, seeds, by_length)


@dataclass(frozen=True)
class Search:
    index: Index
    seeds: dict[int, tuple[np.ndarray, np.ndarray]]
    by_length: dict[int, tuple[np.ndarray, np.ndarray]]

    def windows(self, words: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> dict[int, np.ndarray]:
        """Starts of the windows of each length that may begin a match, by the seeds after them."""
        found: dict[int, list[np.ndarray]] = {}
        for q, (seeds, lengths) in self.seeds.items():
            filtered = np.zeros(1 << FILTER_LOG2, bool)
            filtered[seeds >> np.uint64(64 - FILTER_LOG2)] = True
            here = runs(words, q)
            at = np.flatnonzero(filtered[here >> np.uint64(64 - FILTER_LOG2)])
            low, high = np.searchsorted(seeds, here[at], "left"), np.searchsorted(seeds, here[at], "right")
            count = high - low
            place = np.repeat(at, count)
            entry = np.repeat(low - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum()) if len(at) else at
            n = lengths[entry]
            owner = np.searchsorted(begins, place, "right") - 1
            inside = place + q <= ends[owner]
            for length in np.unique(n[inside]).tolist():
                chosen = inside & (n == length)
                first = np.maximum(place[chosen] - (length + allowed_edits(length) - q), begins[owner[chosen]])
                last = np.minimum(place[chosen], ends[owner[chosen]] - (length - allowed_edits(length)))
                first, size = first[last >= first], (last - first + 1)[last >= first]
                starts = np.repeat(first - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum()) if len(first) else first
                found.setdefault(length, []).append(starts)
        return {n: np.unique(np.concatenate(starts)) for n, starts in found.items()}

    def candidates(self, words: np.ndarray, first: np.ndarray, end: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a window and an item with an equal hash in some repetition."""
        members, known = self.by_length[n]
        made = self.index.hashes(words, first, end, n)
        pairs = []
        for mine, theirs in zip(made, known):
            order = np.argsort(theirs, kind="stable")
            low, high = np.searchsorted(theirs[order], mine, "left"), np.searchsorted(theirs[order], mine, "right")
            hit = np.flatnonzero(high > low)
            count = (high - low)[hit]
            entry = np.repeat(low[hit] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum()) if len(hit) else hit
            pairs.append(np.repeat(hit, count) * len(members) + order[entry])
        window, item = np.divmod(np.unique(np.concatenate(pairs)), len(members))
        return window, members[item]

    def find(self, texts: Iterable[bytes | None]) -> dict[str, np.ndarray]:
        """The best window for each text and item that match: text, item, first word, words, edits."""
        parts = [words_of(t) for t in texts]
        ends = np.cumsum([len(p) for p in parts])
        begins = np.r_[0, ends[:-1]].astype(np.int64)
        words = np.concatenate([np.zeros(0, np.uint64), *parts])
        rows = []
        occupied = np.flatnonzero(ends > begins)
        if len(occupied):
            for n, starts in self.windows(words, begins[occupied], ends[occupied]).items():
                owner = occupied[np.searchsorted(begins[occupied], starts, "right") - 1]
                for at in range(0, len(starts), WINDOWS_AT_ONCE):
                    first, text = starts[at : at + WINDOWS_AT_ONCE], owner[at : at + WINDOWS_AT_ONCE]
                    end = np.minimum(first + n, ends[text])
                    window, item = self.candidates(words, first, end, n)
                    for some in range(0, len(window), WINDOWS_AT_ONCE):
                        w, i = window[some : some + WINDOWS_AT_ONCE], item[some : some + WINDOWS_AT_ONCE]
                        most = n + allowed_edits(n)
                        padded = np.minimum(first[w, None] + np.arange(most), len(words) - 1)
                        sizes = np.minimum(ends[text[w]] - first[w], most)
                        edits, size = edit_distances(np.stack([self.index.words[x] for x in i]), words[padded], n - allowed_edits(n), sizes)
                        good = edits <= allowed_edits(n)
                        rows.append(np.stack([text[w], i, first[w] - begins[text[w]], size, edits])[:, good])
        all_rows = np.concatenate([np.zeros((5, 0), np.int64), *rows], axis=1)
        order = np.lexsort((all_rows[2], all_rows[4], all_rows[1], all_rows[0]))
        all_rows = all_rows[:, order]
        best = np.r_[True, (np.diff(all_rows[0]) != 0) | (np.diff(all_rows[1]) != 0)][: all_rows.shape[1]]
        return dict(zip(("text", "item", "first_word", "n_words", "edits"), all_rows[:, best]))


def edited(words: np.ndarray, edits: int, random: np.random.Generator) -> np.ndarray:
    made = list(words)
    for _ in range(edits):
        kind, at = random.integers(3), int(random.integers(max(1, len(made))))
        if kind == 0 and len(made) > 1:
            del made[at]
        elif kind == 1:
            made.insert(at, np.uint64(random.integers(1, 1 << 62)))
        else:
            made[at] = np.uint64(random.integers(1, 1 << 62))
    return np.array(made, np.uint64)


def repetitions_for(items: list[np.ndarray], recall: float = RECALL, trials: int = 64, seed: int = 3) -> int:
    """Walks needed for ``recall``, by how often items and copies with as many edits as allowed agree in a step."""
    random = np.random.default_rng(seed)
    chances = []
    usable = [w for w in items if len(w) >= WORDS_PER_EDIT]
    for k in range(min(trials, 4 * len(usable))):
        item = usable[int(random.integers(len(usable)))]
        n = len(item)
        other = edited(item, allowed_edits(n), random)[:n]
        factors = walk_factors(8, 2 * n, int(random.integers(1 << 30)))
        zero = np.zeros(1, np.int64)
        ways = zip(walk(item, zero, zero + n, factors, 2 * n), walk(other, zero, zero + len(other), factors, 2 * n))
        agree = np.mean([a == b for a, b in ways], axis=0).ravel()
        chances.append(np.mean(agree**SAMPLED))
    hit = float(np.mean(chances)) if chances else 1.0
    return 1 if hit >= recall else int(np.ceil(np.log(1 - recall) / np.log(1 - hit)))


def item_blocks(benchmark: DataFrame, item_column: str, text_column: str) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Ids and words of the items, in blocks of about ``BLOCK_WORDS`` words. Items without words are left out."""
    ids, words, size = [], [], 0
    for row in benchmark.select(F.col(item_column), F.col(text_column)).orderBy(item_column).toLocalIterator():
        made = words_of((row[1] or "").encode())
        if not len(made):
            continue
        ids.append(row[0])
        words.append(made)
        size += len(made)
        if size >= BLOCK_WORDS:
            yield ids, words
            ids, words, size = [], [], 0
    if ids:
        yield ids, words


def text_blocks(texts: Iterable[bytes | None]) -> Iterator[tuple[int, list[bytes | None]]]:
    first, block, size = 0, [], 0
    for k, text in enumerate(texts):
        block.append(text)
        size += len(text or b"")
        if size >= TEXT_BYTES:
            yield first, block
            first, block, size = k + 1, [], 0
    if block:
        yield first, block


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    item_column: str = "item_id", item_text: str = "text", recall: float = RECALL,
) -> DataFrame:
    """One row for each document row and item in it, with the window of the fewest edits.

    ``doc_id``, ``item_id``, ``first_word`` and ``n_words`` of the window, ``edits`` in words
    and ``similarity``. Words are those of ``words``: runs of letters and digits of any script,
    without case, and single characters of scripts that are written without spaces. At most
    one word in ``WORDS_PER_EDIT`` may be edited, so items under five words must stand as they
    are. Null and empty texts match nothing; repeated rows are reported as often as they come;
    without items or documents the result is empty. Of windows with equal edits the first is taken.
    """
    slim = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    kind, item_kind = slim.schema["doc_id"].dataType.simpleString(), benchmark.schema[item_column].dataType
    schema = f"doc_id {kind}, item_id {item_kind.simpleString()}, first_word long, n_words long, edits long, similarity double"
    found = None
    for ids, words in item_blocks(benchmark, item_column, item_text):
        index = Index(tuple(words), repetitions_for(words, recall))
        made = slim.mapInArrow(searching(index, ids), schema)
        found = made if found is None else found.unionByName(made)
    return docs.sparkSession.createDataFrame([], schema) if found is None else found


def searching(index: Index, ids: list):
    lengths = index.lengths

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = None
        for batch in batches:
            search = search or index.prepared()
            for first, texts in text_blocks(as_bytes(batch.column(1))):
                got = search.find(texts)
                items = pa.array([ids[i] for i in got["item"].tolist()])
                if not len(items):
                    continue
                longest = np.maximum(lengths[got["item"]], got["n_words"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(got["text"] + first)), items, *(pa.array(got[c]) for c in ("first_word", "n_words", "edits")),
                     pa.array(1 - got["edits"] / longest)],
                    names=["doc_id", "item_id", "first_word", "n_words", "edits", "similarity"],
                )

    return run


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", recall: float = RECALL) -> DataFrame:
    """The rows of ``docs`` that hold no item. Rows stay where they are; nothing is shuffled."""
    name = fresh(docs, "contaminated")
    added = StructType([StructField(name, BooleanType(), False)])
    for _, words in item_blocks(benchmark, "item_id", "text"):
        docs = with_columns(docs, text_column, added, flagging(Index(tuple(words), repetitions_for(words, recall))))
        docs = docs.where(~F.col(name)).drop(name)
    return docs


def flagging(index: Index):
    prepared: list[Search] = []

    def flag(texts: Iterable[bytes | None]) -> list[np.ndarray]:
        if not prepared:
            prepared.append(index.prepared())
        flags = []
        for _, block in text_blocks(texts):
            one = np.zeros(len(block), bool)
            one[prepared[0].find(block)["text"]] = True
            flags.append(one)
        return [np.concatenate([np.zeros(0, bool), *flags])]

    return flag


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
