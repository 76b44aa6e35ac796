"""Texts that operators must take, and small helpers."""

from __future__ import annotations

#: Texts that operators must take: nulls, nothing, white space, repeats, other scripts, one very long.
TEXTS = [
    None, "", " \n\t ", "a", "one two three", "The same text stands here twice.", "The same text stands here twice.",
    "!!! ??? 123", "Größe über alles, und die Straße ist lang.", "日本語のテキスト и русский", "it's <|endoftext|> we'll\x00 go",
    "word " * 30_000, "x" * 3_000, "licensed under the MIT license. Apache License, version 2.0; CC BY-NC 4.0",
]


def texts_of(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
