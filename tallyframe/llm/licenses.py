"""License scans by diagonal voting.

Every run of ``GRAM`` words of a text is hashed and joined with the same runs of license
templates. A place in the text minus the place in the template is a diagonal; a template
that stands in a text, whole or in part, leaves many votes on one diagonal, or on
neighbouring ones where words were put in or left out. Diagonals are counted, neighbours
merged, and each span with enough votes is compared with its template word by word.

The templates are a parameter of bounded size and may be broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tallyframe.llm.common import WORD_BYTES, as_bytes, map_batches, mix, settle, table, word_hashes

NO_ID = "\0"
GRAM, LEAST_VOTES, LEAST_LIKENESS = 3, 0.3, 0.8
#: Words that all templates have together, and spans that are broadcast, at most.
MOST_TEMPLATE_WORDS, BROADCAST_SPANS = 1 << 20, 200_000


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    exact: bool = False

    @property
    def reach(self) -> int:
        """How far apart diagonals of one span may be."""
        return 0 if self.exact else min(4, len(self.words) // 4)


def document_words(text: bytes | None) -> bytes:
    return text.translate(WORD_BYTES) if text else b""


def words_of(text: str) -> tuple[str, ...]:
    return tuple(word.decode() for word in document_words(text.encode()).split())


# Phrases that must stand word for word, and their labels.
PHRASES = (
    Template("mit", words_of("under the mit license"), exact=True),
    Template("apache-2", words_of("apache license version 2"), exact=True),
    Template("cc-by-nc", words_of("cc by nc"), exact=True),
)
# Wording of public licenses and of the usual notices of them.
NOTICES = (
    Template("mit", words_of(
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
    )),
    Template("apache-2", words_of(
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at"
    )),
    Template("apache-2", words_of("licensed under the Apache License, Version 2.0")),
    Template("bsd", words_of(
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met"
    )),
    Template("gpl-3", words_of("licensed under the GNU General Public License, version 3")),
    Template("gpl", words_of(
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation"
    )),
    Template("cc-by-nc", words_of("licensed under a Creative Commons Attribution NonCommercial 4.0 International License")),
    Template("cc-by-sa", words_of("licensed under a Creative Commons Attribution ShareAlike 4.0 International License")),
    Template("cc-by", words_of("licensed under a Creative Commons Attribution 4.0 International License")),
)
TEMPLATES = PHRASES + NOTICES


def gram_hashes(hashes: np.ndarray, size: int = GRAM) -> np.ndarray:
    """One hash for each run of ``size`` words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            total = total * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
    return mix(total).view(np.int64)


def template_grams(spark: SparkSession, templates: tuple[Template, ...]) -> DataFrame:
    if sum(len(t.words) for t in templates) > MOST_TEMPLATE_WORDS:
        raise ValueError("too many templates to broadcast")
    rows = []
    for number, template in enumerate(templates):
        if len(template.words) < GRAM:
            raise ValueError(f"a template needs {GRAM} words: {template}")
        grams = gram_hashes(word_hashes(" ".join(template.words).encode()))
        rows += [(number, place, int(gram)) for place, gram in enumerate(grams)]
    return spark.createDataFrame(rows, "template int, at int, gram long")


def counted_words(rows: DataFrame) -> DataFrame:
    """``doc_id``, ``print`` and the number of words of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = [len(document_words(t).split()) for t in as_bytes(batch.column(2))]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], names=["doc_id", "print", "n_words"])

    return map_batches(rows, run, f"{key_schema(rows)}, n_words long")


def key_schema(rows: DataFrame) -> str:
    return f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, print long"


def hashed_grams(rows: DataFrame) -> DataFrame:
    """``doc_id``, ``print`` and the hash of every run of words of every row, as one array."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        grams = [gram_hashes(word_hashes(document_words(t))) for t in as_bytes(batch.column(2))]
        ends = np.cumsum([0, *map(len, grams)])
        values = pa.array(np.concatenate([np.zeros(0, np.int64), *grams]))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["doc_id", "print", "grams"])

    return map_batches(rows, run, f"{key_schema(rows)}, grams array<bigint>")


def voted_spans(grams: DataFrame, templates: tuple[Template, ...]) -> DataFrame:
    """Spans with enough votes: the document, the template, the first and the last diagonal."""
    listed = F.broadcast(template_grams(grams.sparkSession, templates))
    hits = grams.select("doc_id", "print", F.posexplode("grams").alias("place", "gram")).join(listed, "gram")
    diagonals = hits.groupBy("doc_id", "print", "template", (F.col("place") - F.col("at")).alias("diagonal")).agg(F.count("*").alias("votes"))
    per_template = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("template") + 1)
    order = Window.partitionBy("doc_id", "print", "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(order) > per_template([t.reach for t in templates])
    grouped = diagonals.withColumn("new", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("span", F.sum("new").over(order))
    spans = grouped.groupBy("doc_id", "print", "template", "span").agg(
        F.min("diagonal").alias("first"), F.max("diagonal").alias("last"), F.sum("votes").alias("votes")
    )
    runs = [len(t.words) - GRAM + 1 for t in templates]
    least = [n if t.exact else max(1, int(LEAST_VOTES * n)) for t, n in zip(templates, runs)]
    return spans.where(F.col("votes") >= per_template(least)).select("doc_id", "print", "template", "first", "last")


def likeness(template: np.ndarray, window: np.ndarray) -> float:
    """1 less the fewest word edits between the template and any part of the window, for each template word."""
    row, at = np.zeros(len(window) + 1), np.arange(len(window) + 1)
    for k, word in enumerate(template):
        new = np.r_[k + 1.0, np.minimum(row[:-1] + (window != word), row[1:] + 1)]
        row = np.minimum.accumulate(new - at) + at
    return max(0.0, 1 - row.min() / len(template))


def verified_spans(rows: DataFrame, spans: DataFrame, templates: tuple[Template, ...]) -> DataFrame:
    """Spans whose words are like their template's: all of them for a phrase, else ``LEAST_LIKENESS``."""
    few = spans.count() <= BROADCAST_SPANS
    grouped = spans.groupBy("doc_id", "print").agg(F.sort_array(F.collect_list(F.struct("template", "first", "last"))).alias("spans"))
    joined = rows.join(F.broadcast(grouped) if few else grouped, ["doc_id", "print"]).select("doc_id", "print", "text", "spans")
    # equal rows of one document would be checked, and counted, once each
    joined = joined.dropDuplicates(["doc_id", "print"])
    # words are bytes here too: str.split() would part them at white space beyond ASCII and shift all places after it
    known = [(np.array([w.encode() for w in t.words], dtype=object), t.exact) for t in templates]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list] = [[], [], [], []]
            for k, (text, listed) in enumerate(zip(as_bytes(batch.column(2)), batch.column(3))):
                words = np.array(document_words(text).split(), dtype=object)
                for span in listed.as_py():
                    template, exact = known[span["template"]]
                    if exact:
                        window = words[span["first"] : span["first"] + len(template)] if span["first"] >= 0 else words[:0]
                        like = float(len(window) == len(template) and (window == template).all())
                    else:
                        window = words[max(0, span["first"] - 2) : max(0, span["last"] + len(template) + 2)]
                        like = likeness(template, window)
                    if like >= (1.0 if exact else LEAST_LIKENESS):
                        for values, value in zip(found, (k, span["template"], span["first"], like)):
                            values.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(found[0], pa.int64())), batch.column(1).take(pa.array(found[0], pa.int64())),
                 pa.array(found[1], pa.int32()), pa.array(found[2], pa.int64()), pa.array(found[3], pa.float64())],
                names=["doc_id", "print", "template", "word", "likeness"],
            )

    return joined.mapInArrow(run, f"{key_schema(rows)}, template int, word long, likeness double")


def license_labels(
    docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """The labels of every row, with the places of the fixed phrases.

    ``base_labels`` come from templates that must stand word for word, ``labels`` from all;
    both are sorted and parted by commas, empty if there are none. ``score`` is the likeness
    of the best span, 0 without one. ``first_word`` and ``last_word`` are null without a
    phrase. A null text counts as empty. Repeated rows are returned as often as they come, a
    null id is an id of its own, an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("print"), "text")
    # a null id is made a value for the joins and taken back at the end
    kind = rows.schema["doc_id"].dataType
    keyed = rows.withColumn("doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit(NO_ID)))
    spans = settle(voted_spans(hashed_grams(keyed), templates), "license-spans")
    found = verified_spans(keyed, spans, templates)
    label = F.element_at(F.array(*[F.lit(t.label) for t in templates]), F.col("template") + 1)
    exact = F.element_at(F.array(*[F.lit(t.exact) for t in templates]), F.col("template") + 1)
    sums = found.withColumn("label", label).withColumn("exact", exact).groupBy("doc_id", "print").agg(
        F.count_if("exact").alias("n_base"),
        F.min(F.when(F.col("exact"), F.col("word"))).alias("first_word"),
        F.max(F.when(F.col("exact"), F.col("word"))).alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("exact"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"),
        F.max("likeness").alias("score"),
    )
    sums = settle(sums, "license-labels")
    return counted_words(keyed).join(sums, ["doc_id", "print"], "left").select(
        F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).cast(kind).alias("doc_id"), "n_words",
        F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_labels(table(spark, sf_dir, "documents"))
