"""Sharding, fingerprints, token counts and BPE against plain versions."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from llm_cases import TEXTS, texts_of

from tallyframe.llm import bpe, fingerprints, sharding, token_counts


@pytest.mark.parametrize("table", ["documents", "odd"])
def test_shards(request, table):
    docs = request.getfixturevalue(table)
    rows = sharding.shard_documents(docs).collect()
    want = Counter((d, len(t.encode()) + 16, zlib.crc32(t.encode())) for d, t in texts_of(docs))
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    places = defaultdict(list)
    for r in rows:
        assert 0 <= r.shard < 40 and r.law == "bytes" and r.grown_shard is None
        places[r.shard].append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    if table == "documents":
        load = Counter()
        for r in rows:
            load[r.shard] += r.size
        largest = max(r.size for r in rows)
        assert max(load.values()) <= sum(load.values()) / 40 + largest


def test_no_shards_of_nothing(nothing):
    assert sharding.shard_documents(nothing).count() == 0


def test_maps_change_little_and_grow_into_the_new_shard_only():
    weight = {k: (k * 7919) % 1000 + 1 for k in range(sharding.SLOTS)}
    first = sharding.first_map(sharding.SLOTS, 40)
    second = sharding.rebalance(first, weight, 40)
    load = Counter()
    for slot, shard in second.items():
        load[shard] += weight[slot]
    assert max(load.values()) - min(load.values()) <= max(weight.values())
    moved = sum(weight[s] for s in first if first[s] != second[s])
    assert moved < 0.1 * sum(weight.values())
    assert sum(sharding.rebalance(second, weight, 40)[s] != second[s] for s in second) <= 40
    third = sharding.grow(second, weight, 40)
    assert {third[s] for s in third if third[s] != second[s]} == {40}
    share = sum(weight[s] for s in third if third[s] == 40) / sum(weight.values())
    assert 0.8 / 41 < share < 1.2 / 41


def edited_texts(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    for k, (doc, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        yield doc, text, text[: len(text) - half] + following[:half], following


@pytest.mark.parametrize("table", ["documents", "odd"])
def test_edited_texts_and_their_likeness(request, table):
    docs = request.getfixturevalue(table)
    got = {(r.doc_id, r.n_chars, r.edited_sha256): r for r in fingerprints.fingerprint_documents(docs).collect()}
    error, pairs, prints = 0.0, 0, {}
    for doc, text, edited, following in edited_texts(texts_of(docs)):
        row = got[doc, len(text), hashlib.sha256(edited.encode()).hexdigest()]
        assert prints.setdefault(text, row.fingerprint) == row.fingerprint
        for other, near in ((edited, row.near_edited), (following, row.near_next)):
            a, b = (Counter(x.lower().split()) for x in (text, other))
            union = sum((a | b).values())
            jaccard = sum((a & b).values()) / union if union else 1.0
            assert abs(near - jaccard) < 0.5
            error += near - jaccard
            pairs += 1
    assert abs(error / pairs) < 0.05
    assert len(set(prints.values())) >= 0.9 * len({" ".join(sorted(t.lower().split())) for t in prints})


def test_fingerprints_of_few(spark, nothing):
    assert fingerprints.fingerprint_documents(nothing).count() == 0
    one = fingerprints.fingerprint_documents(spark.createDataFrame([(3, "only this one")], "doc_id long, text string")).first()
    assert one.near_next == 1.0 and one.n_chars == 13


def test_no_python_in_fingerprints(documents, capsys):
    fingerprints.fingerprint_documents(documents).explain()
    assert "Python" not in capsys.readouterr().out


@pytest.mark.parametrize("frequent", [token_counts.FREQUENT, 50, 0])
@pytest.mark.parametrize("table", ["documents", "odd"])
def test_token_counts(request, table, frequent):
    docs = request.getfixturevalue(table)
    tokenizer = token_counts.load(token_counts.VOCABULARY)
    want = []
    for doc, text in texts_of(docs):
        n = len(tokenizer.encode(text, add_special_tokens=False).ids)
        want.append((doc, len(text.encode()), n, n > 1024))
    got = [tuple(r) for r in token_counts.token_counts(docs, most_frequent=frequent).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_no_tokens_of_nothing(nothing):
    assert token_counts.token_counts(nothing).count() == 0
    assert bpe.encoded_documents(nothing).count() == 0


def test_plain_characters_are_split_alike():
    """Each character that the quick pattern is used for, beside letters, digits and white space."""
    tokenizer = token_counts.load(token_counts.VOCABULARY)
    split = token_counts.splitter(tokenizer)
    for code in [*range(0x250), *range(0x2010, 0x2028), 0x20AC]:
        text = f"a{chr(code)}1 {chr(code)}{chr(code)} {chr(code)}b\n"
        exact = [text[a:b] for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        assert split(text)[0] == exact, hex(code)


def encoding(name):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(name), special_tokens={})


@pytest.mark.parametrize("table", ["documents", "odd"])
def test_bpe(request, table):
    docs = request.getfixturevalue(table)
    library = encoding(bpe.VOCABULARY)
    want = []
    for doc, text in texts_of(docs):
        ids = library.encode_ordinary(text)
        digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        want.append((doc, len(ids), digest, hashlib.sha256(text.encode()).hexdigest()))
    got = [tuple(r) for r in bpe.encoded_documents(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    ids = {(r.doc_id, r.n_tokens, r.ids_sha256): r.ids for r in bpe.encoded_documents(docs, with_ids=True).collect()}
    assert all(len(v) == n for (_, n, _), v in ids.items())


def test_both_contractions_agree(monkeypatch):
    import random

    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeéü ") for _ in range(rng.randint(2, 70))) for _ in range(300)]
    words += ["a" * n for n in range(2, 60)] + ["=" * 200, "ab" * 100, "".join(rng.choice("etaoin") for _ in range(900))]
    library = encoding(bpe.VOCABULARY)
    for short in (0, 63):
        monkeypatch.setattr(bpe, "SHORT", short)
        got = bpe.Coder(bpe.VOCABULARY).encode(words)
        assert [i.tolist() for i in got] == [library.encode_ordinary(w) for w in words]


def test_words_are_forgotten_and_learned_again(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 40)
    coder, library = bpe.Coder(bpe.VOCABULARY), encoding(bpe.VOCABULARY)
    for text in [t for t in TEXTS if t and len(t) < 500] * 3 + [" ".join(map(str, range(500)))]:
        (ids,) = coder.encode([text])
        assert ids.tolist() == library.encode_ordinary(text)
        assert coder.decode([ids]) == [text.encode()]
        assert len(coder.known) <= 40
