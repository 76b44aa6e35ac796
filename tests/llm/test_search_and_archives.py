"""Decontamination, license scans, WARC archives and the pipeline against plain versions."""

from __future__ import annotations

import gzip
import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from llm_cases import texts_of
from pyspark.sql import functions as F

from tallyframe.llm import decontamination as dc, licenses, warc
from tallyframe.llm.common import WORD_BYTES, pieces, word_hashes


def plain_words(text: str) -> list[str]:
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


# ---------------------------------------------------------------- shared helpers


def test_pieces_cover_whole_texts():
    texts = [b"", None, b"ab cd " * 100, b"x" * 333, b"last"]
    for size in (7, 50, 1 << 19):
        joined = {k: b"" for k in range(len(texts))}
        for data, starts, owners in pieces(texts, size):
            for start, end, owner in zip(starts, [*starts[1:], len(data)], owners):
                joined[owner] += data[start + 1 : end - 1].tobytes()
        assert [joined[k] for k in range(len(texts))] == [t or b"" for t in texts]


def test_word_hashes_do_not_depend_on_blocks():
    text = ("Some words, and größer ones; " * 50).encode().translate(WORD_BYTES)
    assert (word_hashes(text) == word_hashes(text, 64)).all()
    assert len(word_hashes(text)) == len(text.split())
    assert len(set(word_hashes(text).tolist())) == len(set(text.split()))


# ---------------------------------------------------------------- decontamination


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_items_that_stand_in_documents_are_found(spark, documents):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    padded = {d: f" {' '.join(plain_words(t))} " for d, t in texts_of(documents)}
    want = {(d, r.item_id) for d, t in padded.items() for r in items.collect() if f" {' '.join(plain_words(r.text))} " in t}
    got = dc.contamination(documents, items).collect()
    assert want <= {(r.doc_id, r.item_id) for r in got} and want
    words = {d: plain_words(t) for d, t in texts_of(documents)}
    texts = {r.item_id: plain_words(r.text) for r in items.collect()}
    for r in got:
        window, item = words[r.doc_id][r.first_word : r.first_word + r.n_words], texts[r.item_id]
        assert edit_distance(window, item) == r.edits <= dc.allowed_edits(len(item))
    kept = {r.doc_id for r in dc.without_contaminated(documents, items).collect()}
    assert kept == set(words) - {r.doc_id for r in got}


def test_edited_items_are_found_and_others_are_not(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{k}" for k in range(400)]
    make = lambda n: list(rng.choice(vocabulary, n))
    items = [make(int(n)) for n in rng.integers(12, 70, 60)]
    docs, want = [], set()
    for k, item in enumerate(items):
        made = list(item)
        for _ in range(k % (dc.allowed_edits(len(item)) + 1)):
            at = int(rng.integers(len(made)))
            made[at : at + 1] = [[], ["new", made[at]], ["other"]][int(rng.integers(3))]
        docs.append((k, " ".join([*make(30), *made, *make(30)])))
        if edit_distance(made, item) <= dc.allowed_edits(len(item)):
            want.add((k, k))
    docs += [(100 + k, " ".join(make(200))) for k in range(60)]
    got = dc.contamination(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)], "item_id long, text string"),
    ).collect()
    found = {(r.doc_id, r.item_id) for r in got}
    assert len(want & found) >= 0.93 * len(want)
    assert found <= {(k, k) for k in range(60)}


def test_odd_items_and_rows(spark, odd, nothing):
    items = spark.createDataFrame(
        [(1, None), (2, ""), (3, "one two three"), (4, "Größe über alles und die Straße"), (5, "the SAME text; stands here twice")],
        "item_id long, text string",
    )
    got = Counter((r.doc_id, r.item_id) for r in dc.contamination(odd, items).collect())
    assert got == {(4, 3): 1, (8, 4): 1, (5, 5): 2, (6, 5): 1}
    assert dc.contamination(nothing, items).count() == 0
    assert dc.contamination(odd, items.limit(0)).count() == 0
    kept = dc.without_contaminated(odd, items)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 5


def test_many_items_take_more_readings(spark, odd, monkeypatch):
    items = spark.createDataFrame([(3, "one two three"), (5, "the same text stands here twice")], "item_id long, text string")
    once = sorted(map(tuple, dc.contamination(odd, items).collect()), key=str)
    monkeypatch.setattr(dc, "BLOCK_WORDS", 1)
    assert sorted(map(tuple, dc.contamination(odd, items).collect()), key=str) == once
    assert dc.without_contaminated(odd, items).count() == odd.count() - 4


def test_words_of_any_script(spark):
    cases = [
        ("東京は日本の首都である", "昔から東京は日本の首都であるといわれている。"),
        ("今天天气很好", "他说:今天天气很好,我们走吧"),
        ("กรุงเทพมหานคร", "เมืองกรุงเทพมหานครใหญ่มาก"),
        ("élève à l’école", "VOICI «ÉLÈVE À L’ÉCOLE»"),
        ("Straße nach Köln", "die STRASSE—NACH…KÖLN!"),
        ("москва столица россии", "сегодня“МОСКВА\u00a0СТОЛИЦА\u3000РОССИИ”"),
        ("naïve café", "a na\u00adïve cafe, naïve¡café¿"),
    ]
    docs = spark.createDataFrame([(k, d, "x") for k, (_, d) in enumerate(cases)] + [(99, "別の話です plain text", "x")], "doc_id long, text string, more string")
    items = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(cases)], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.edits) for r in dc.contamination(docs, items).collect()}
    assert got == {(k, k, 0) for k in range(len(cases))}
    assert [r.doc_id for r in dc.without_contaminated(docs, items).collect()] == [99]


def test_words_do_not_depend_on_parts(monkeypatch):
    from tallyframe.llm import words

    split = lambda t: b" ".join(words.parted_words(t.encode())).split()
    text = "Größe日本 x\u200by İ😀❤\ufe0f ½ €5 naïve\u00ad" * 40
    whole = split(text)
    assert [w.decode() for w in split("Größe日本 x\u200by 😀❤\ufe0f €5")] == ["grösse", "日", "本", "x", "y", "😀", "❤", "€", "5"]
    for size in (1, 3, 7, 64):
        monkeypatch.setattr(words, "CHARACTERS_AT_ONCE", size)
        assert split(text) == whole
    assert split("ab_C-9\n") == [b"ab", b"c", b"9"] and not split("")


@pytest.mark.parametrize("n", range(1, 80))
def test_runs_leave_out_no_match(n):
    q, t = dc.shared_run(n), dc.allowed_edits(n)
    assert n - q + 1 - q * t > 0


# ---------------------------------------------------------------- licenses


def plain_phrases(text):
    words = plain_words(text)
    places = [(k, t.label) for t in licenses.PHRASES for k in range(len(words)) if tuple(words[k : k + len(t.words)]) == t.words]
    return words, sorted(places)


@pytest.mark.parametrize("table", ["documents", "odd"])
def test_phrases(request, table):
    docs = request.getfixturevalue(table)
    want = []
    for doc, text in texts_of(docs):
        words, places = plain_phrases(text)
        first, last = (places[0][0], places[-1][0]) if places else (None, None)
        want.append((doc, len(words), len(places), first, last, ",".join(sorted({x for _, x in places}))))
    got = licenses.license_labels(docs).collect()
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted(want, key=str)
    for r in got:
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert (r.score > 0) == bool(r.labels) and r.score <= 1


def test_notices_with_changes(spark, nothing):
    notice = " ".join(licenses.NOTICES[0].words)
    words = notice.split()
    changed = words[:20] + ["really"] + words[20:40] + words[41:]
    broken = words[: len(words) // 3]
    again = "under the MIT license " * 3
    docs = [(1, f"x y z {notice} a b"), (2, "a " * 9 + " ".join(changed)), (3, " ".join(broken)), (4, again), (5, "nothing of that")]
    rows = {r.doc_id: r for r in licenses.license_labels(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert rows[1].labels == "mit" and rows[1].score == 1 and rows[1].n_base == 0
    assert rows[2].labels == "mit" and 0.9 < rows[2].score < 1
    assert rows[3].labels == "" and rows[3].score == 0
    assert (rows[4].n_base, rows[4].first_word, rows[4].last_word) == (3, 0, 8)
    assert rows[5].labels == "" and rows[5].first_word is None
    assert licenses.license_labels(nothing).count() == 0


def test_white_space_beyond_ascii_shifts_no_place(spark):
    phrases = [" ".join(t.words) for t in licenses.PHRASES]
    gaps = "\u00a0\u0085\u2003\u2028\u202f\u3000"
    docs = [(k, f"a{gap}b {gap} c " * 4 + phrase) for k, (gap, phrase) in enumerate((g, p) for g in gaps for p in phrases)]
    docs.append((99, "a\u00a0b " * 9 + " ".join(licenses.NOTICES[0].words)))
    rows = {r.doc_id: r for r in licenses.license_labels(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for doc, text in docs[:-1]:
        words, places = plain_phrases(text)
        assert (rows[doc].n_words, rows[doc].n_base) == (len(words), 1)
        assert (rows[doc].first_word, rows[doc].last_word, rows[doc].base_labels) == (places[0][0], places[0][0], places[0][1])
    assert rows[99].labels == "mit" and rows[99].score == 1


# ---------------------------------------------------------------- archives


def plain_pages(rows, least=warc.LEAST_REVISIT):
    first = {}
    for page, html in rows:
        data = (html or "").encode()
        if len(data) >= least:
            first[data] = min(page, first.get(data, page))
    for page, html in rows:
        data = (html or "").encode()
        original = first.get(data, page)
        yield page, len(data), hashlib.sha256(data).hexdigest(), "response" if original == page else "revisit", None if original == page else original


def read_all(index, folder):
    return warc.read_archives(index, folder).selectExpr(
        "cast(page_id as long) page_id", "payload_bytes", "payload_digest", "record_type", "cast(refers_to as long) refers_to"
    )


@pytest.mark.parametrize("broadcast", [warc.BROADCAST_COPIES, 0])
def test_archives_round_trip(spark, monkeypatch, broadcast):
    monkeypatch.setattr(warc, "FILE_BYTES", 2000)
    monkeypatch.setattr(warc, "BROADCAST_COPIES", broadcast)
    long, copy = "<p>line</p>\r\n\r\n" * 40_000, "c" * 150
    pages = [(9, copy), (4, copy), (6, copy), (1, None), (2, ""), (3, long), (5, "short"), (7, "short"), (8, "größe " * 30), (4, copy), (10, long)]
    rows = [(p, f"http://h.example/{p}?a=%41\r\nX: y" if p % 2 else None, h, "extra") for p, h in pages]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    index, folder = warc.archive_pages(table)
    got = [tuple(r) for r in read_all(index, folder).collect()]
    assert sorted(got, key=str) == sorted(plain_pages(pages), key=str)
    urls = {r.page_id: r.url for r in warc.read_archives(index, folder).collect()}
    assert urls["9"] == "http://h.example/9?a=%41\r\nX: y" and urls["4"] == ""
    # any part of the index can be read by itself, and a member stands alone
    some = warc.read_archives(index.where("offset > 0"), folder)
    assert some.count() == index.where("offset > 0").count() > 0
    row = index.where(F.col("url").startswith("http://h.example/3")).first()
    store, root = warc.open_store(folder)
    with store.open_input_file(f"{root}/{row.path}") as file:
        member = file.read_at(row.length, row.offset)
    assert gzip.decompress(member).startswith(b"WARC/1.1\r\nWARC-Type: response\r\n")
    assert warc.parse(member).http()[1] == long.encode()
    assert index.agg(F.countDistinct("path")).first()[0] > 1
    empty, folder = warc.archive_pages(table.limit(0))
    assert read_all(empty, folder).count() == 0


def test_damage_is_noticed():
    member = bytearray(warc.record("1", "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None))
    data = gzip.decompress(bytes(member)).replace(b"payload\r\n", b"paylaod\r\n")
    with pytest.raises(ValueError, match="damaged"):
        warc.parse(gzip.compress(data))


def test_ranges_are_joined():
    offsets, lengths = [0, 10, 30, 10_000_000, 10_000_020], [10, 20, 5, 20, 5]
    assert list(warc.ranges(offsets, lengths)) == [(0, 35, [0, 1, 2]), (10_000_000, 25, [3, 4])]
    big = warc.REQUEST_BYTES
    assert [m for _, _, m in warc.ranges([0, big // 2, big], [big // 2, big // 2, big])] == [[0, 1], [2]]


# ---------------------------------------------------------------- the pipeline


def test_stages_keep_what_their_operators_say(spark):
    import corpus_pipeline as cp
    from tallyframe.llm import bpe, language, quality, simhash

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in cp.STAGES:
        made = stage(spark, docs, sf).persist()
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        left = {r.doc_id for r in made.select("doc_id").collect()}
        if name == "language":
            rows = language.document_languages(docs).collect()
            assert left == {r.doc_id for r in rows if r.lang_pred != "und" and r.score >= cp.LEAST_LANGUAGE_SCORE}
        elif name == "quality":
            rows = quality.quality_scores(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()
            assert left == {r.doc_id for r in rows if r.predicted == 1}
        elif name == "simhash":
            assert left == {r.component_id for r in simhash.simhash_groups(docs).collect()}
        elif name == "decontamination":
            hits = dc.contamination(docs, spark.read.parquet(f"{sf}/benchmark.parquet"))
            assert left == ids - {r.doc_id for r in hits.collect()}
        else:
            assert sorted(map(tuple, made.collect())) == sorted(map(tuple, bpe.encoded_documents(docs).collect()))
        if name != "bpe":
            assert made.columns == docs.columns and made.count() == len(left)
        docs = made


def test_stages_take_odd_rows(spark, odd, nothing):
    import corpus_pipeline as cp

    for docs in (odd, nothing):
        for name, stage in cp.STAGES:
            made = stage(spark, docs, "/root/testdata/sf0.001").persist()
            assert made.count() <= docs.count()
            if name != "bpe":
                assert made.columns == docs.columns
                docs = made
