"""LM scoring, spelling variants and collocations against plain versions."""

from __future__ import annotations

import collections
import math
import re
import tracemalloc
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pyarrow.parquet as pq
import pytest
from llm_cases import texts_of

from tallyframe.llm import collocations, lm_scoring, spelling

SF = "/root/testdata/sf0.001"
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


# ---------------------------------------------------------------- op13 collocations


def oracle_rows(docs_df):
    """The module's DuckDB SQL over the rows of a DataFrame."""
    con = duckdb.connect()
    con.register("documents", docs_df.select("doc_id", "text", "lang").toPandas())
    return sorted(tuple(r) for r in con.execute(collocations.ORACLE).fetchall())


def result_rows(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_collocations_equal_the_sql(documents):
    want = oracle_rows(documents)
    assert want, "the fixture must have candidates"
    assert result_rows(collocations.collocations(documents)) == want
    # Many shards (local support near 1) and many blocks of candidates give the same rows.
    assert result_rows(collocations.collocations(documents, shard_bytes=1 << 14, block_keys=700)) == want


def test_collocations_cuts_ties_and_containment(spark):
    # "big red" stands 40 times alone and 40 times in "big red dog": both reach 30, but
    # "big red" has 80 and "big red dog" 40 < 0.8 * 80, so both stay; "red dog" (40) lies
    # inside "big red dog" (40 >= 0.8 * 40) and goes. Ties of score are ordered by a, phrase.
    rows = [(i, "Big red dog. big red; x y z: x y z!", "en") for i in range(40)]
    rows += [(100 + i, "Big Red", None) for i in range(40)] + [(200, None, "en"), (201, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = result_rows(collocations.collocations(docs))
    assert got == oracle_rows(docs)
    phrases = {(r[0], r[2]) for r in got}
    assert ("en", "big red dog") in phrases and ("en", "red dog") not in phrases and ("und", "big red") in phrases


def test_collocations_odd_tables(odd, nothing):
    got = collocations.collocations(odd.withColumnRenamed("score", "a"))
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert result_rows(got) == oracle_rows(odd)
    assert collocations.collocations(nothing).count() == 0


def shard_batch(rows):
    return pa.RecordBatch.from_arrays(
        [pa.array([t for t, _ in rows]), pa.array([lang for _, lang in rows]), pa.array([10**12] * len(rows), pa.int64())],
        ["text", "lang", "n"],
    )


def test_collocation_mining_holds_little_beside_a_shard():
    # 4 MB of text: words and keys are some 30 MB, 64-bit arrays over all bytes would be over 150 MB.
    rng = np.random.default_rng(3)
    vocabulary = ["".join(map(chr, rng.integers(97, 123, 5))) for _ in range(5000)]
    rows = [(" ".join(vocabulary[i] for i in rng.integers(0, 5000, 700)), "en") for _ in range(1000)]
    batch = shard_batch(rows)
    tracemalloc.start()
    found = sum(b.num_rows for b in collocations.local_frequent(1, None, 30, 1 << 23)([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == len(set(vocabulary)) and peak < 120e6


def test_collocation_mining_skips_phrases_with_rare_parts(tmp_path):
    rows = [("a b c d", "en"), ("b c, d a", "en"), ("b c", "de")]
    batch = shard_batch(rows)
    words = [b for b in collocations.local_frequent(1, None, 30, 1 << 23)([batch]) if b.num_rows]
    keys = pa.Table.from_batches(words)
    shard = next(collocations.shards([batch], 1 << 23))
    held = collocations.shard_words(shard)
    own = collocations.longer_keys(held, None, 1)
    kept = [k for k, i in zip(own.view(np.int64), range(len(own))) if held.text[held.starts[i] : held.ends[i]] in (b"b", b"c")]
    assert set(kept) < set(keys.column("k").to_pylist())
    pq.write_table(pa.table({"k": pa.array(kept, pa.int64())}), tmp_path / "part-0.parquet")
    pairs = pa.Table.from_batches(list(collocations.local_frequent(2, str(tmp_path), 30, 1 << 23)([batch])))
    assert sorted(zip(pairs.column("g").to_pylist(), pairs.column("v").to_pylist())) == [(2, 1), (2, 2)]  # b c in de and en


def test_collocation_counts_when_keys_share_their_index(monkeypatch):
    monkeypatch.setattr(collocations, "INDEX_MASK", np.uint64(7))
    monkeypatch.setattr(collocations, "TEXT_BLOCK", 64)
    rng = np.random.default_rng(5)
    texts = ["".join(f"{w}{s}" for w, s in zip(rng.choice(list("abcdefghij"), 40), rng.choice([" ", " ", ". ", "\t"], 40))) for _ in range(30)]
    held = collocations.shard_words(next(collocations.shards([shard_batch([(t, "en") for t in texts])], 1 << 23)))
    keys, lang = None, np.zeros(len(held.hashes), np.int64)
    for g in (1, 2, 3):
        keys = collocations.longer_keys(held, keys, g)
        wanted = np.unique(keys[::2])
        index = np.full(8, -1, np.int32)
        index[wanted & np.uint64(7)] = np.arange(len(wanted), dtype=np.int32)
        at, counts = collocations.places(held, lang, keys, g, wanted, index)
        got = {b" ".join(held.text[held.starts[i + j] : held.ends[i + j]] for j in range(g)): int(c) for i, c in zip(at, counts)}
        plain = collections.Counter()
        for text in texts:
            for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
                w = re.findall(r"[^ \t]+", piece)
                plain.update(" ".join(w[i : i + g]).encode() for i in range(len(w) - g + 1))
        assert set(got) and all(plain[phrase] == n for phrase, n in got.items())
        assert sum(got.values()) == int((np.isin(keys, wanted) & collocations.in_one_piece(held, g)).sum())


def test_collocation_mining_leaves_out_phrases_of_buckets_below_min_count(tmp_path):
    # Of 20,000 pairs of candidate words one stands 30 times: a shard of a large table (support 1) handed on every pair.
    rng = np.random.default_rng(9)
    pairs = {(f"w{i}", f"w{j}") for i, j in rng.integers(0, 400, (20_000, 2))}
    rows = [(f"{a} {b}.", "en") for a, b in sorted(pairs)] + [("big dog!", "en")] * 30
    batch = shard_batch(rows)
    words = pa.Table.from_batches([b for b in collocations.local_frequent(1, None, 30, 1 << 23)([batch]) if b.num_rows])
    pq.write_table(words.select(["k"]), tmp_path / "words.parquet")
    (tmp_path / "full").mkdir()
    bits = collocations.bucket_bits(1 << 21)
    mined = {}
    for shard_bytes in (1 << 23, 1 << 12):  # one shard, many shards
        parts = pa.Table.from_batches(list(collocations.bucket_counts(2, str(tmp_path / "words.parquet"), bits, 30, shard_bytes)([batch])))
        full = [collocations.full_buckets(30)(parts.filter(pa.compute.equal(parts["block"], b))) for b in set(parts["block"].to_pylist())]
        pq.write_table(pa.concat_tables(full), tmp_path / "full" / "part-0.parquet")
        args = (2, str(tmp_path / "words.parquet"), 30, shard_bytes, str(tmp_path / "full"), bits)
        mined[shard_bytes] = pa.Table.from_batches(list(collocations.local_frequent(*args)([batch])))
    assert all(sum(t["v"].to_pylist()) >= 30 and t.num_rows < 100 for t in mined.values())
    assert 30 in mined[1 << 23]["v"].to_pylist()


def test_collocation_buckets_lose_no_frequent_phrase(spark, documents, monkeypatch):
    # Few buckets, counts beyond a byte: other phrases may be let through, the result is the same.
    monkeypatch.setattr(collocations, "MOST_BUCKET_BITS", 16)
    docs = documents.unionByName(documents).unionByName(documents)
    wide = result_rows(collocations.collocations(docs, min_count=300, shard_bytes=1 << 16))
    assert wide == result_rows(collocations.collocations(docs.coalesce(1), min_count=300)) and wide


def test_collocation_scores_are_exact_beyond_64_bits():
    assert (10**13 * 2_000_000) // (10**13 + 10**13 + 1) == 999_999
    # The Spark expression divides decimals, so a * 2000000 may pass 2 ** 63.
    assert 10**13 * 2_000_000 > 2**63


# ---------------------------------------------------------------- op12 spelling


def plain_spelling(pairs):
    counts = collections.Counter()
    for doc_id, text in pairs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = run.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{low}".encode())
            if h % 199 == 0:
                k = h % len(low)
                low = low[:k] + low[k + 1 :]
            counts[low] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        if len(a) > len(b):
            a, b = b, a
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out = {}
    for w, n in words.items():
        ns = [v for v in words if v != w and near(w, v)]
        best = min(ns, key=lambda v: (-words[v], v)) if ns else None
        form = best if best and words[best] >= 5 * n else None
        out[w] = [form, n, len(ns), words[form] if form else None]
    for w, row in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        row.insert(1, root)
    return {w: tuple(r) for w, r in out.items()}


def spelled(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_spelling_equals_plain_version(documents):
    got = spelled(spelling.spelling_variants(documents))
    assert got == plain_spelling(texts_of(documents)) and got


def test_spelling_chains_ties_and_planted_deletions(spark):
    # colour (150) <- colouur (21) <- colouuur (4: too few, not a word) ; ties of n: smallest word.
    rows = [(1, "colour " * 150 + "colouur " * 20 + "colouuur " * 4), (2, "abcdefx " * 30 + "abcdefy " * 30 + "abcdef " * 6)]
    rows += [(3, "Colouur COLOUUR"), (None, "ÀÉÎÕÜ àéîõüx àéîõüx àéîõüx àéîõüx àéîõüx"), (4, None), (5, "")]
    rows += [(h, "planted") for h in range(6, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = spelled(spelling.spelling_variants(docs))
    assert got == plain_spelling(rows)
    assert got["abcdef"][0] == "abcdefx" and got["colouur"][1] == "colour"


def test_spelling_odd_tables(odd, nothing):
    got = spelling.spelling_variants(odd.withColumnRenamed("score", "word"))
    assert spelled(got) == plain_spelling(texts_of(odd))
    assert spelling.spelling_variants(nothing).count() == 0


# ---------------------------------------------------------------- op11 LM scoring


def plain_base(pairs):
    tokens = {d: (t or "").encode().translate(LOWER).split() for d, t in pairs}
    train = [d for d, _ in pairs if zlib.crc32(str("" if d is None else d).encode()) % 7 != 2]
    counts = collections.Counter()
    for d in train:
        counts.update(tokens[d])
    n = sum(counts.values()) + len(train)
    v = len(counts) + (1 if train else 0)
    out = {}
    for d, _ in pairs:
        ts = tokens[d]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ts) + math.log10((len(train) + 1) / (n + v + 1))
        out[d] = (len(ts) + 1, sum(counts[w] > 0 for w in ts) + (1 if train else 0), n, round(base, 6))
    return out


def test_lm_base_equals_plain_version(documents):
    got = lm_scoring.lm_scores(documents).collect()
    want = plain_base(texts_of(documents))
    assert {r.doc_id: (r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got} == want
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in got)
    assert all(r.score < 0 and r.bits_per_byte > 0 for r in got)


def sequential_bits(text: bytes, table: np.ndarray, bits: int) -> float:
    """The mixer bit by bit, one text alone: the plain version of the lockstep blocks."""
    s = lm_scoring.stream(text)
    slots, y = lm_scoring.slots(s, b"\n\n\n", bits)
    w = np.full((lm_scoring.GATES, lm_scoring.ORDERS), lm_scoring.START_WEIGHT, np.float64)
    total = 0.0
    for start in range(0, len(s), lm_scoring.BLOCK):
        grad = np.zeros_like(w)
        for t in range(start, min(start + lm_scoring.BLOCK, len(s))):
            for j in range(8):
                x = np.array([table[k][slots[k][t, j]] for k in range(lm_scoring.ORDERS)], np.float64)
                g = j * (lm_scoring.ORDERS + 1) + int((x != 0).sum())
                p = min(max(1 / (1 + math.exp(-float(w[g] @ x))), 1 / 4096), 1 - 1 / 4096)
                total -= math.log2(p if y[t, j] else 1 - p)
                grad[g] += lm_scoring.RATE * (y[t, j] - p) * x
        w += grad
    return total


def test_lockstep_mixer_equals_sequential_one():
    rng = np.random.default_rng(7)
    bits = 12
    table = np.where(rng.random((lm_scoring.ORDERS, 1 << bits)) < 0.5, rng.normal(0, 2, (lm_scoring.ORDERS, 1 << bits)), 0)
    table = table.astype(np.float32)
    texts = [b"the cat sat on the mat " * 9, b"", b"Zebra", b"a b c d e f g " * 30]
    units = [(lm_scoring.stream(t), b"\n\n\n", i) for i, t in enumerate(texts)]
    weights = np.full((len(texts), lm_scoring.GATES, lm_scoring.ORDERS), lm_scoring.START_WEIGHT, np.float32)
    got = lm_scoring.mixed_bits(units, weights, table, bits)
    want = [sequential_bits(t, table, bits) for t in texts]
    assert np.allclose(got, want, rtol=1e-3)


def test_lm_scores_learn_the_corpus(spark, documents):
    # Texts like the corpus cost fewer bits than random letters; equal texts score alike;
    # a long text read in many chunks scores about as read at once.
    junk = ["".join(np.random.default_rng(i).choice(list("qxzjkvwy"), 400)) for i in range(5)]
    texts = [r.text for r in documents.where("doc_id % 7 = 1").limit(5).collect()]
    rows = [(10_000 + i, t) for i, t in enumerate(texts + texts[:1] + junk)]
    extra = spark.createDataFrame(rows, "doc_id long, text string")
    both = documents.select("doc_id", "text").unionByName(extra)
    got = {r.doc_id: r for r in lm_scoring.lm_scores(both).collect()}
    corpus = np.mean([got[10_000 + i].bits_per_byte for i in range(5)])
    noise = np.mean([got[10_006 + i].bits_per_byte for i in range(5)])
    assert corpus < noise
    assert got[10_000].score == got[10_005].score
    long_text = " ".join(texts) * 3
    one = lm_scoring.lm_scores(spark.createDataFrame([(1, long_text)], "doc_id long, text string")).first()
    many = lm_scoring.lm_scores(spark.createDataFrame([(1, long_text)], "doc_id long, text string"), chunk_bytes=4096).first()
    assert abs(one.score - many.score) < 0.02 * abs(one.score)


def test_lm_table_is_loaded_in_little_memory(tmp_path):
    # 4 x 2^18 slots are 4 MB of predictions and 29 MB of counts, which stood in memory several times.
    bits, parts = 18, 4
    rng = np.random.default_rng(7)
    n0, n1 = rng.integers(0, 1000, (2, lm_scoring.ORDERS, 1 << bits))
    for part in range(parts):
        slot = np.tile(np.arange(part, 1 << bits, parts), lm_scoring.ORDERS)
        order = np.repeat(np.arange(lm_scoring.ORDERS, dtype=np.int32), (1 << bits) // parts)
        rows = {"order": order, "slot": slot, "n0": n0[order, slot], "n1": n1[order, slot]}
        pq.write_table(pa.table(rows), tmp_path / f"part-{part}.parquet")
    lm_scoring.load_table(str(tmp_path), bits)  # imports and pools
    tracemalloc.start()
    got = lm_scoring.load_table(str(tmp_path), bits)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(got, np.clip(np.log((n1 + 0.5) / (n0 + 0.5)), -8, 8).astype(np.float32))
    assert peak < 12e6


def test_lm_contexts_are_counted_once_a_pair(monkeypatch):
    # Counts equal those of the scoring slots, byte by byte; equal texts are looked up once, not a time each.
    rng = np.random.default_rng(11)
    words = ["".join(map(chr, rng.integers(97, 103, n))) for n in rng.integers(1, 9, 60)]
    texts = [" ".join(rng.choice(words, 40)).encode() for _ in range(30)] + [b"", b"x" * 900, "Gr\u00f6\u00dfe \u65e5\u672c ".encode() * 9, b"a " + b"y" * 300 + b" b"]
    bits, parts = 12, [part for text in texts for part in lm_scoring.pieces_of(lm_scoring.stream(text), 256)]
    want = np.zeros((lm_scoring.ORDERS, 2 << bits), np.uint32)
    for chunk, before in parts:
        found, ones = lm_scoring.slots(chunk, before, bits)
        for k in range(lm_scoring.ORDERS):
            np.add.at(want[k], (found[k] * 2 + ones).ravel(), 1)
    got = np.zeros_like(want)
    lm_scoring.add_contexts(got, parts, bits)
    assert np.array_equal(got, want)
    looked = []
    monkeypatch.setattr(lm_scoring, "BIT", type("Bits", (), {"__getitem__": lambda self, own: looked.append(len(own)) or np.zeros((len(own), 8), np.int8)})())
    for copies in (1, 50):
        lm_scoring.add_contexts(got, [(c, b) for c, b in parts if c[-1:] in (b" ", b"\n") and b[-1:] in (b" ", b"\n")] * copies, bits)
    assert looked[:4] == looked[4:]


def test_lm_model_counts_equal_those_byte_by_byte(spark):
    # Counted tokens and grams give the slots of every byte, with words that chunks cut, empty texts and texts of one byte.
    rng = np.random.default_rng(13)
    words = ["".join(map(chr, rng.integers(97, 103, n))) for n in rng.integers(1, 9, 60)]
    texts = [" ".join(rng.choice(words, 40)) for _ in range(30)]
    texts += ["", None, "a", "\t\n", "Gr\u00f6\u00dfe \u65e5\u672c " * 9, "\x00 \x00\x00"]
    texts += ["x" * n + tail for n in (253, 254, 255, 256, 257, 300, 900) for tail in ("", " end here", " " + "y" * 254 + " z")]
    texts += ["a " + "y" * 300 + " b", "b " * 100 + "w" * 600]
    bits, chunk = 12, 256
    want = np.zeros((lm_scoring.ORDERS, 2 << bits), np.int64)
    for text in texts:
        for piece, before in lm_scoring.pieces_of(lm_scoring.stream((text or "").encode()), chunk):
            found, ones = lm_scoring.slots(piece, before, bits)
            for k in range(lm_scoring.ORDERS):
                np.add.at(want[k], (found[k] * 2 + ones).ravel(), 1)
    training = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    counted = lm_scoring.part_counts(training, chunk)
    got = np.zeros_like(want)
    for r in lm_scoring.context_counts(training, counted, bits, chunk, 2000).collect():
        got[r.order, 2 * r.slot : 2 * r.slot + 2] += r.n0, r.n1
    assert np.array_equal(got, want)


def test_lm_mixer_does_not_grow_with_equal_contexts(monkeypatch):
    # Slots are looked up once a distinct pair of context and byte, and texts score the same in any company.
    rng = np.random.default_rng(17)
    bits = 12
    table = rng.normal(0, 2, (lm_scoring.ORDERS, 1 << bits)).astype(np.float32)
    table[rng.random(table.shape) < 0.3] = 0
    texts = [lm_scoring.stream(" ".join(rng.choice(["the", "cat", "s\u00e4t", "x" * 150], n)).encode()) for n in (0, 1, 9, 40, 90)]
    looked, plain = [], lm_scoring.slots_of

    def scored(some):
        weights = np.full((len(some), lm_scoring.GATES, lm_scoring.ORDERS), lm_scoring.START_WEIGHT, np.float32)
        monkeypatch.setattr(lm_scoring, "slots_of", lambda k, base, own, bits: looked.append(len(own)) or plain(k, base, own, bits))
        return lm_scoring.mixed_bits([(t, b"\n\n\n", i) for i, t in enumerate(some)], weights, table, bits)

    one = scored(texts)
    before = sum(looked)
    looked.clear()
    assert np.array_equal(scored(texts * 200)[:5], one)
    assert sum(looked) < 1.2 * before + 50
    for t, bits_ in zip(texts, one, strict=True):
        assert scored([t])[0] == bits_


def test_lm_token_rows_without_a_shuffle_of_every_token(tmp_path):
    pq.write_table(pa.table({"token": ["the", "cat"], "c": pa.array([9, 4], pa.int64())}), tmp_path / "part-0.parquet")
    batch = pa.RecordBatch.from_arrays([pa.array(["The cat the dog dog", None, "\tcat\x0b"]), pa.array([5, 6, 7], pa.int64())], ["text", "key"])
    got = pa.Table.from_batches(list(lm_scoring.row_tokens(str(tmp_path), 100.0)([batch]))).to_pylist()
    assert [(r["key"], r["m"], r["hot_words"]) for r in got if r["token"] is None] == [(5, 5, 3), (6, 0, 0), (7, 1, 1)]
    assert [(r["key"], r["token"], r["m"]) for r in got if r["token"] is not None] == [(5, "dog", 2)]
    assert math.isclose(got[0]["hot_score"], 2 * math.log10(0.1) + math.log10(0.05))


def test_lm_odd_tables(odd, nothing):
    got = lm_scoring.lm_scores(odd.withColumnRenamed("score", "key")).collect()
    assert len(got) == odd.count()
    want = plain_base(texts_of(odd))
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == sorted(
        want[d] for d, _ in texts_of(odd)
    )
    assert lm_scoring.lm_scores(nothing).count() == 0


@pytest.mark.parametrize("train_bytes, bits", [(0, 16), (1 << 20, 16), (1 << 30, 21), (1 << 50, 21)])
def test_table_grows_with_the_corpus(train_bytes, bits):
    assert lm_scoring.table_bits(train_bytes) == bits


# ---------------------------------------------------------------- the registered queries


def test_registered_queries_give_the_plain_results(spark, documents):
    import __spark_entry__ as entry

    queries = entry.queries()
    assert entry.oracle_sql()["op13_collocations"] == collocations.ORACLE
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = sorted(tuple(r) for r in con.execute(collocations.ORACLE).fetchall())
    assert result_rows(queries["op13_collocations"](spark, SF)) == want
    assert spelled(queries["op12_spelling"](spark, SF)) == plain_spelling(texts_of(documents))
    scored = queries["op11_lm_scoring"](spark, SF).collect()
    assert {r.doc_id: (r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in scored} == plain_base(
        texts_of(documents)
    )
