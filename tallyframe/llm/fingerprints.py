"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

A text is a bag of lower-cased words with their counts as weights. For each of ``SAMPLES``
samples every word draws r and c from Gamma(2, 1) and b from [0, 1), all from hashes of
the word and the sample's number, so they agree wherever the word occurs. With weight w,
t = floor(ln w / r + b), ln y = r (t - b) and ln a = ln c - ln y - r; the word with the
least ln a is the sample, together with its t. Two texts agree in a sample with a
probability equal to their generalised Jaccard similarity (sum of the smaller weights over
sum of the larger ones), so the share of equal samples estimates it.

The least value is found by a plain minimum of 64-bit numbers: 31 bits of ln a above 32
bits that name word and t.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tallyframe.llm.common import table

SAMPLES = 32
#: Rows that one bucket of neighbouring ids aims at, and the most buckets there are.
BUCKET_ROWS, MOST_BUCKETS, MOST_BOUNDS = 256, 100_000, 500
#: A text takes several times its size as words with their counts, so it is dealt to so many times the usual partitions.
SPREAD = 4
WORDS = r"\s+"


def sample_value(word: str, weight_log: str, k: int) -> Column:
    """What sample ``k`` minimises, from a word's hash and the logarithm of its weight."""
    first, second = f"xxhash64({word}, {2 * k})", f"xxhash64({word}, {2 * k + 1})"

    def uniform(bits: str, shift: int) -> str:
        return f"(((shiftrightunsigned({bits}, {shift}) & 2097151) + 0.5d) / 2097152d)"

    r = f"(-ln({uniform(first, 0)} * {uniform(first, 21)}))"
    log_c = f"ln(-ln({uniform(second, 0)} * {uniform(second, 21)}))"
    b = uniform(second, 42)
    t = f"floor({weight_log} / {r} + {b})"
    log_a = f"({log_c} - {r} * ({t} - {b}) - {r})"
    rank = f"least(greatest(cast(({log_a} + 64d) * 16777216d as bigint), 0L), 2147483647L)"
    return F.expr(f"shiftleft({rank}, 32) | (xxhash64({word}, {t}) & 4294967295L)")


def signatures(texts: DataFrame, keys: list[str], text: str, samples: int = SAMPLES) -> DataFrame:
    """``keys`` and ``fingerprint`` (eight hex digits a sample) of every row.

    A row whose text is null has a fingerprint too, which means nothing: such rows carry
    keys through. Where ``texts`` are already dealt out by one of the keys, nothing is shuffled.
    """
    split = F.coalesce(F.split(F.lower(text), WORDS), F.array(F.lit("-")))
    words = texts.select(*keys, F.explode(split).alias("word")).where("word <> ''")
    weights = words.groupBy(*keys, F.xxhash64("word").alias("word")).agg(F.count("*").alias("n"))
    weights = weights.select(*keys, "word", F.log(F.col("n").cast("double")).alias("weight"))
    least = weights.groupBy(*keys).agg(*[F.min(sample_value("word", "weight", k)).alias(f"s{k}") for k in range(samples)])
    digits = [F.lower(F.lpad(F.hex(F.col(f"s{k}").bitwiseAND(4294967295)), 8, "0")) for k in range(samples)]
    return least.select(*keys, F.concat(*digits).alias("fingerprint"))


def empty_fingerprint(samples: int = SAMPLES) -> Column:
    return F.lit("0" * 8 * samples)


def likeness(left: str, right: str, samples: int = SAMPLES) -> Column:
    """Share of equal samples."""
    equal = [F.when(F.substring(left, 8 * k + 1, 8) == F.substring(right, 8 * k + 1, 8), 1.0).otherwise(0.0) for k in range(samples)]
    return sum(equal[1:], equal[0]) / F.lit(float(samples))


def id_buckets(docs: DataFrame, rows_per_bucket: int = BUCKET_ROWS) -> Column:
    """A number for each ``doc_id`` that never falls as ids rise, with about as many rows each.

    Bounds are quantiles of all ids (at most ``MOST_BOUNDS``); between two of them ids are
    dealt out evenly. There are at most ``MOST_BUCKETS`` buckets.
    """
    rows = docs.count()
    buckets = max(1, min(MOST_BUCKETS, rows // rows_per_bucket))
    ranges = min(buckets, MOST_BOUNDS)
    shares = [i / ranges for i in range(ranges + 1)]
    found = docs.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, shares)), 10 * MOST_BOUNDS)).first()[0]
    if not found:
        return F.lit(0).cast("long")
    bounds = sorted(set(found))
    lows = F.array(*map(F.lit, bounds)).cast("array<double>")
    highs = F.array(*map(F.lit, [*bounds[1:], bounds[-1] + 1])).cast("array<double>")
    key = F.coalesce(F.col("doc_id"), F.lit(bounds[0])).cast("double")
    at = F.greatest(F.size(F.filter(lows, lambda low: low <= key)), F.lit(1))
    per = max(1, buckets // ranges)
    low, high = F.element_at(lows, at), F.element_at(highs, at)
    inside = F.least(F.greatest(F.floor((key - low) / (high - low) * per), F.lit(0)), F.lit(per - 1))
    return (at * per + inside).cast("long")


def with_next(docs: DataFrame) -> DataFrame:
    """Rows with ``bucket``, ``place``, ``text`` and ``next_text``; a last row of each bucket, marked, repeats the next.

    Texts are shuffled once, by bucket. The first row of each bucket is also sent to the
    bucket before it, so no row has to look beyond its own; that of the first bucket goes to the last.
    """
    dealt = docs.withColumn("bucket", id_buckets(docs))
    firsts = dealt.groupBy("bucket").agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id")).alias("first"))
    firsts = firsts.select("bucket", F.col("first.doc_id").alias("first_id"))
    wrapped = Window.orderBy("bucket")  # over one row for each bucket, of which there are at most MOST_BUCKETS
    before = F.coalesce(F.lag("bucket").over(wrapped), F.max("bucket").over(Window.partitionBy()))
    firsts = F.broadcast(firsts.select("first_id", before.alias("before")))  # at most MOST_BUCKETS rows of 16 bytes
    heads = dealt.join(firsts, F.col("doc_id").eqNullSafe(F.col("first_id"))).groupBy("before", "doc_id").agg(F.min("text").alias("text"))
    marked = heads.select("doc_id", "text", F.col("before").alias("bucket"), F.lit(1).alias("mark"))
    rows = dealt.select("doc_id", "text", "bucket", F.lit(0).alias("mark")).unionByName(marked)
    rows = rows.repartition(SPREAD * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "bucket")
    order = Window.partitionBy("bucket").orderBy("mark", F.asc_nulls_first("doc_id"), "text")
    return rows.select("*", F.row_number().over(order).alias("place"), F.lead("text").over(order).alias("next_text"))


def fingerprint_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of every text, of the text with its last half exchanged, and their likeness.

    A null text counts as empty; a text without words has the fingerprint of zeros, which is
    like another such one in every sample. Rows with one id are ordered by text; a null id
    stands first. The next document of the last is the first, that of an only one itself.
    An empty table gives an empty result. Ids must be numbers.
    """
    docs = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    rows = with_next(docs)
    chars = F.char_length("text")
    half = F.floor(chars / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), chars - half), F.substring("next_text", F.lit(1), half))
    facts = F.concat_ws("|", chars.cast("string"), F.sha2(edited.cast("binary"), 256), F.col("doc_id").cast("string"))
    nothing = F.lit(None).cast("string")
    # one row for the text, one for the edited text, and one without text that carries the row's facts
    versions = F.array(
        *[
            F.struct((F.col("place") * 8 + F.col("mark") * 4 + kind).alias("row"), version.alias("version"), fact.alias("fact"))
            for kind, version, fact in ((0, F.col("text"), nothing), (1, edited, nothing), (2, nothing, facts))
        ]
    )
    rows = rows.select("bucket", F.inline(versions)).where("(row & 5) <> 5")
    prints = signatures(rows, ["bucket", "row", "fact"], "version", samples)
    kind = F.col("row").bitwiseAND(3)
    of = lambda n, name: F.max(F.when(kind == n, F.col(name)))
    none = empty_fingerprint(samples)
    full = prints.groupBy("bucket", F.shiftright("row", 2).alias("place")).agg(
        F.split(of(2, "fact"), r"\|").alias("facts"),
        F.coalesce(of(0, "fingerprint"), none).alias("fingerprint"),
        F.coalesce(of(1, "fingerprint"), none).alias("edited_fingerprint"),
    )
    following = F.lead("fingerprint").over(Window.partitionBy("bucket").orderBy("place"))
    return (
        full.withColumn("next_fingerprint", following)  # still dealt out by bucket
        .where("(place & 1) = 0")
        .select(
            F.get("facts", F.lit(2)).cast("long").alias("doc_id"), F.get("facts", F.lit(0)).cast("long").alias("n_chars"),
            F.get("facts", F.lit(1)).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
            likeness("fingerprint", "edited_fingerprint", samples).alias("near_edited"),
            likeness("fingerprint", "next_fingerprint", samples).alias("near_next"),
        )
    )


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))
