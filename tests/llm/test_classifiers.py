from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import language, quality

SF = "/root/testdata/sf0.01"


def fold(doc_id, divisor):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % divisor


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_quality_of_held_out_documents(tables):
    docs, labels = tables
    rows = quality.quality_scores(docs, labels).collect()
    assert len(rows) == docs.count()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert all(r.held_out == (fold(r.doc_id, 5) == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([a == b for a, b in held]) > 0.9


def test_quality_of_odd_rows(spark, odd, nothing, tables):
    labels = spark.createDataFrame([(k, k % 2) for k in range(14)] + [(3, 0), (None, 1), (4, None)], "doc_id long, quality int")
    rows = quality.quality_scores(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    by_id = {r.doc_id: r.score for r in rows}
    assert by_id[0] == by_id[1]  # null and empty
    assert by_id[5] == by_id[6]  # equal texts
    assert quality.quality_scores(nothing, labels).count() == 0
    assert {r.score for r in quality.quality_scores(odd, labels.limit(0)).collect()} == {0.5}


def test_scores_do_not_depend_on_the_blocks(monkeypatch):
    rng = np.random.default_rng(2)
    model = quality.Model(rng.normal(size=1 << quality.BUCKETS_LOG2))
    texts = [b"", None, b"some words and more words " * 40, "größer straße ".encode() * 30, b"x y"]
    whole = model.scores(texts)
    pieces = quality.pieces
    monkeypatch.setattr(quality, "pieces", lambda t: pieces(t, 100))
    assert np.allclose(whole, model.scores(texts))
    assert np.allclose(whole, [model.scores([t])[0] for t in texts])


def plain_grams(text: bytes):
    """Words and n-grams of a text as strings, one by one."""
    data = b"\n" + text + b"\n"
    found = [w for w in data.split()]
    found += [b"again" for a, b in zip(found, found[1:]) if a == b] * quality.AGAIN_WEIGHT
    for n in quality.GRAMS:
        found += [data[i : i + n] for i in range(len(data) - n + 1) if all(c > 32 for c in data[i + 1 : i + n - 1])]
    return found


def test_features_are_the_words_and_their_grams():
    text = "ab cde fghij  klm\nno größe größe nono".encode()
    data, _, _ = next(quality.pieces([text]))
    assert sum(len(at) for at, _ in quality.hashed(data)) == len(plain_grams(text))


def test_language_of_held_out_documents(tables):
    docs, _ = tables
    rows = language.document_languages(docs).collect()
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert len(rows) == len(truth)
    assert all(r.held_out == (fold(r.doc_id, 3) == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r.lang_pred == truth[r.doc_id] for r in rows if r.held_out]
    assert np.mean(held) > 0.97


def test_language_of_odd_rows(odd, nothing, tables):
    model = language.fit(tables[0])
    rows = {r.doc_id: r for r in language.document_languages(odd, model).collect()}
    assert all(rows[k].lang_pred == "und" and rows[k].score == 0 for k in (0, 1, 2, 7))
    assert rows[9].lang_pred in model.languages
    assert language.document_languages(odd, model).count() == odd.count()
    assert language.document_languages(nothing).count() == 0
    unlabelled = language.document_languages(odd.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in unlabelled.collect()} == {"und"}


def test_words_of_a_mixed_text(tables):
    """A text in two languages: forward-backward changes over between the words."""
    model = language.fit(tables[0])
    docs = {r.lang: r.text for r in tables[0].where("n_chars between 800 and 1500").collect()}
    words = [" ".join(docs[k].split()[:25]) for k in ("en", "de")]
    (data, at, _), *_ = language.pieces([language.letters(" ".join(words).encode())])
    starts, ends = language.word_spans(data)
    chains = language.chain_table(np.zeros(len(starts), int))
    best = language.posteriors(model.emissions(data, starts, ends), model.transitions, chains)[0].argmax(axis=1)
    half = len(best) // 2
    assert np.mean(best[: half - 3] == model.languages.index("en")) > 0.8
    assert np.mean(best[half + 3 :] == model.languages.index("de")) > 0.8


def test_forward_backward_equals_enumeration():
    from itertools import product

    rng = np.random.default_rng(1)
    emissions, transitions = rng.normal(size=(5, 3)), rng.normal(size=(3, 3))
    chains = np.full((2, 4), -1)
    chains[0, :4], chains[1, :1] = [0, 1, 2, 3], [4]
    words, pairs, _ = language.posteriors(emissions, transitions, chains)
    total, single, double = 0.0, np.zeros((4, 3)), np.zeros((3, 3))
    for path in product(range(3), repeat=4):
        weight = np.exp(sum(emissions[t, y] for t, y in enumerate(path)) + sum(transitions[a, b] for a, b in zip(path, path[1:])))
        total += weight
        for t, y in enumerate(path):
            single[t, y] += weight
        for a, b in zip(path, path[1:]):
            double[a, b] += weight
    assert np.allclose(words[:4], single / total) and np.allclose(pairs, double / total)
    assert np.allclose(words[4], np.exp(emissions[4]) / np.exp(emissions[4]).sum())
