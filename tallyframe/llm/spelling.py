"""Spelling variants by a relational trie frontier.

Words are maximal runs ``[A-Za-z\\u00C0-\\u00FF]+`` with A-Z lower-cased; a run whose
``crc32("<doc_id>:<run>")`` is divisible by 199 loses its code point ``h % length`` (a
planted misspelling; a null id is written as nothing). Words of at least 6 code points
and 5 occurrences are kept, with their counts ``n``.

The trie of the kept words is a distributed edge table ``(node, char)``: a node is a
prefix, each edge the code point that follows it in some word. A search state is
``(word, position, node, edits)``. Before its edit a state's node is the word's own
prefix, so the frontier of every level is known at once and all levels are joined with
the edge table in one shuffle: a deletion skips the word's code point, a substitution or
an insertion follows an edge of the node. After the edit the rest of the word must follow
exactly, which is one more join, of the whole candidate with the words: terminal states
with one edit are the near words. Nodes of at most one code point have at most
90 + 90 * 90 edges (the code points that a lower-cased run can hold), so that part of the
edge table is broadcast and the root, which every word passes, is no hot key; deeper
nodes are joined by a shuffle. Edges that cannot go on are not followed: a state is
joined with trie triples (node, char, next code point), two levels at once, so a
substitution or insertion becomes a candidate only where the trie continues with the
word's next code point.

A word's form is its near word of largest ``n`` (ties: smallest in code-point order) if
that ``n`` is at least 5 times its own; the root follows forms to the end, by pointer
jumping over written tables (each step at least quintuples ``n``, so there are no cycles).

Defined cases: null texts and texts without letters add nothing; null ids hash as an
empty id; repeated rows count again; an empty table gives no rows; other columns of any
name are ignored; very long runs are words like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyframe.llm.common import settle, table

#: Fixed values of the contract.
RUN = "[A-Za-z\\u00C0-\\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DIVISOR, SHORTEST, LEAST, FACTOR = 199, 6, 5, 5
#: Levels whose edges are broadcast: nodes of at most this many code points (90 + 90 ** 2 edges).
SHALLOW = 1


def planted_words(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Every run of every text, lower-cased in A-Z, with the planted deletion: column ``word``."""
    runs = docs.select(
        F.col(doc_id).alias("id"), F.explode(F.regexp_extract_all(F.col(text), F.lit(RUN), F.lit(0))).alias("run")
    )
    runs = runs.select("id", F.translate(F.col("run"), UPPER, LOWER).alias("low"))
    runs = runs.withColumn("h", F.crc32(F.encode(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), "low"), "UTF-8")))
    at = "cast(h % char_length(low) as int)"
    cut = F.expr(f"concat(substring(low, 1, {at}), substring(low, {at} + 2))")
    return runs.select(F.when(F.col("h") % DIVISOR == 0, cut).otherwise(F.col("low")).alias("word"))


def near_words(words: DataFrame) -> DataFrame:
    """Pairs (word, near, near_n) of kept words one edit apart, by the trie frontier; ``words`` has word, n.

    A substitution or insertion at a node follows an edge whose child has the word's next
    code point below it: the state is joined with trie triples (node, char, next), two
    levels at once, so only edges that can go on become candidates. At the word's end
    the plain edges (node, char) serve.
    """
    length = F.char_length("word")
    levels = words.select("word", F.explode(F.sequence(F.lit(0), length)).alias("i"))
    states = levels.select(
        "word", "i", F.expr("substring(word, 1, i)").alias("node"), F.expr("substring(word, i + 2)").alias("after"),
        F.expr("substring(word, i + 1)").alias("rest"), F.expr("substring(word, i + 1, 1)").alias("own"),
    )
    prefixes = words.select("word", F.explode(F.sequence(F.lit(0), length - 1)).alias("i"))
    edges = prefixes.select(F.expr("substring(word, 1, i)").alias("node"), F.expr("substring(word, i + 1, 1)").alias("char")).distinct()
    triples = prefixes.select(
        F.expr("substring(word, 1, i)").alias("node"), F.expr("substring(word, i + 1, 1)").alias("char"),
        F.expr("substring(word, i + 2, 1)").alias("next"),
    ).where(F.col("next") != "").distinct()

    def follow(frontier: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
        """States joined with trie rows; nodes of at most SHALLOW code points are broadcast (bounded by the alphabet)."""
        shallow = frontier.where(F.col("i") <= SHALLOW).join(F.broadcast(table.where(F.char_length("node") <= SHALLOW)), on)
        deep = frontier.where(F.col("i") > SHALLOW).join(table.where(F.char_length("node") > SHALLOW), on)
        return shallow.unionByName(deep)

    # Substitution: the code point after the replaced one must follow the new edge.
    inner = follow(states.where(F.col("after") != "").withColumn("next", F.substring("after", 1, 1)), triples, ["node", "next"])
    last = follow(states.where((F.col("own") != "") & (F.col("after") == "")), edges, ["node"])
    substituted = inner.unionByName(last, allowMissingColumns=True).where(F.col("char") != F.col("own")).select(
        "word", F.concat("node", "char", "after").alias("near")
    )
    # Insertion: the word's own code point must follow the inserted one.
    inner = follow(states.where(F.col("rest") != "").withColumn("next", F.col("own")), triples, ["node", "next"])
    last = follow(states.where(F.col("rest") == ""), edges, ["node"])
    inserted = inner.unionByName(last, allowMissingColumns=True).select("word", F.concat("node", "char", "rest").alias("near"))
    deleted = states.where(F.col("own") != "").select("word", F.concat("node", "after").alias("near"))
    candidates = substituted.unionByName(inserted).unionByName(deleted)
    targets = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    # Candidates meet the words in one shuffle; only the terminal states, few, are made distinct.
    return candidates.join(targets, "near").select("word", "near", "near_n").distinct()


def spelling_variants(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """word, form, root, n, n_near, form_n for every kept word (see the module)."""
    counted = planted_words(docs, text, doc_id).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    words = settle(counted.where((F.char_length("word") >= SHORTEST) & (F.col("n") >= LEAST)), "words")
    pairs = near_words(words)
    best = pairs.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("near"))).alias("b")
    )
    formed = words.join(best, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(-F.col("b.m") >= FACTOR * F.col("n"), F.col("b.near")).alias("form"),
        F.when(-F.col("b.m") >= FACTOR * F.col("n"), -F.col("b.m")).cast("long").alias("form_n"),
    )
    formed = settle(formed, "forms")
    return formed.join(roots(formed), "word").select("word", "form", "root", F.col("n").cast("long").alias("n"), "n_near", "form_n")


def roots(formed: DataFrame) -> DataFrame:
    """word, root: forms followed to the end by pointer jumping, each step a written table."""
    links = settle(formed.select("word", F.coalesce("form", "word").alias("root")), "roots")
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = links.join(ahead, "root", "left").select("word", "root", F.coalesce("next", "root").alias("next"))
        jumped = settle(jumped, "jumps")
        if not jumped.where(F.col("next") != F.col("root")).limit(1).count():
            return jumped.select("word", "root")
        links = jumped.select("word", F.col("next").alias("root"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))
