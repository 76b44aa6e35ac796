"""Reading tables: delimited text with inferred types, and Parquet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tallyframe.functions.missing import col
from tallyframe.functions.text import INTEGER_TEXT, is_float_text
from tallyframe.operators.derive import derive_durations

# Fixed list of the texts that stand for a missing value.
MISSING_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

# The text of a row that has more or fewer values than the header has names, NULL for all others.
RAGGED = "_tally_ragged"
# What stands after the end of such a row to see where it ends; no value.
END = "\u0001end\u0001"
# Has a value where a row has more values than the header has names.
MORE = "_tally_more"
# Spark's own bound on the values of a row.
MOST_VALUES = 20480

# How values are quoted.
QUOTES = {"quote": '"', "escape": '"'}

# Unsigned 64-bit integers beyond bigint.
UNSIGNED = "decimal(20,0)"


def load_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def load_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    multi_line: bool = False,
    durations: bool = True,
    on_bad: str = "error",
    copies: str | None = None,
) -> DataFrame:
    """Table from comma-separated text with a header.

    With ``copies`` (a folder every executor can reach) the typed table is written there
    as Parquet under a key of the files' paths, sizes and modification times and of the
    options; a later call with the same files finds it and starts no job at all. A
    changed, added or removed file makes another key, so a stale copy is never read.

    Without ``schema`` one aggregate pass over the whole file settles the column
    types; with it (names must be those of the header) that pass is left out, which
    is the choice for very large files. ``multi_line`` allows line breaks inside
    quotes, at the price of files that cannot be split between tasks.

    Nothing is lost without a word: a row with more values than the header has names, empty
    ones too, and with ``schema`` a value of another type, is an error, found by the pass that
    infers types or, with ``schema``, when the row is read. With ``on_bad="null"`` the further
    values are dropped and misfits are NULL. Missing values at the end of a row are NULL.
    """
    if on_bad not in ("error", "null"):
        raise ValueError(f"on_bad is 'error' or 'null', not {on_bad!r}")
    if copies is not None:
        return _kept_copy(spark, path, copies, schema, multi_line, durations, on_bad)
    reader = spark.read.options(header=True, multiLine=multi_line, **QUOTES)
    names = reader.csv(path).columns
    texts = [T.StructField(n, T.StringType()) for n in names]
    cells = blank_missing(reader.schema(T.StructType(texts)).csv(path), names)
    # where only some columns are read Spark cannot tell the length of a row
    whole = spark.read.options(header=True, multiLine=multi_line, columnPruning=False, columnNameOfCorruptRecord=RAGGED, **QUOTES)
    watched = blank_missing(whole.schema(T.StructType([*texts, T.StructField(RAGGED, T.StringType())])).csv(path), names)
    watched = watched.withColumn(MORE, F.when(_too_long(len(names)), "more"))
    strict = on_bad == "error"
    if schema is None:
        types, too_long = infer_types(watched, names)
        if strict and too_long:
            raise ValueError(f"{too_long} rows of {path} have more values than the header has names")
    else:
        wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        types = {f.name: f.dataType.simpleString() for f in wanted.fields}
        if list(types) != names:
            raise ValueError(f"schema names {list(types)} differ from the header {names}")
        if strict:
            # the first cell is in the message as Spark reads no table for the text of ragged rows alone
            message = F.concat(F.lit(f"a row of {path} has more values than the header has names; it begins with: "), F.coalesce(col(names[0]), F.lit("")))
            cells = watched.where(F.when(col(MORE).isNotNull(), F.raise_error(message).cast("boolean")).otherwise(True))
    checked = strict and schema is not None
    table = cells.select(*[(_typed(n, t) if checked else col(n).try_cast(t)).alias(n) for n, t in types.items()])
    return derive_durations(table) if durations else table


def _kept_copy(spark, path, copies, schema, multi_line, durations, on_bad) -> DataFrame:
    """The typed copy of the CSV files at ``path`` in ``copies``, written by the first call."""
    import hashlib
    import json

    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    files = []
    # a fixed schema lists the files without reading them
    for name in sorted(spark.read.schema("_tally_line string").csv(path).inputFiles()):
        hadoop_path = jvm.org.apache.hadoop.fs.Path(name)
        status = hadoop_path.getFileSystem(conf).getFileStatus(hadoop_path)
        files.append([name, status.getLen(), status.getModificationTime()])
    wanted = schema.simpleString() if isinstance(schema, T.StructType) else schema
    key = hashlib.sha256(json.dumps([files, wanted, multi_line, durations, on_bad]).encode()).hexdigest()[:32]
    folder = f"{copies.rstrip('/')}/csv-{key}"
    marker = jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    store = marker.getFileSystem(conf)
    types = jvm.org.apache.hadoop.fs.Path(f"{folder}.schema.json")
    if store.exists(marker) and store.exists(types):
        stream = store.open(types)
        try:
            text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return spark.read.schema(T.StructType.fromJson(json.loads(text))).parquet(folder)
    table = load_csv(spark, path, schema, multi_line, durations, on_bad)
    table.write.mode("overwrite").parquet(folder)
    out = store.create(types, True)
    try:
        out.write(bytearray(json.dumps(table.schema.jsonValue()).encode()))
    finally:
        out.close()
    return spark.read.schema(table.schema).parquet(folder)


def bad_rows(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, multi_line: bool = False
) -> DataFrame:
    """The rows of the CSV files at ``path`` that ``load_csv`` would refuse: file, row, reason, values.

    ``row`` is the row's text as Spark's parser kept it (the corrupt-record column), and
    ``file`` comes from ``_metadata``. Reasons: ``more values than the header`` (empty ones
    too) and, with ``schema``, ``a value does not fit the schema``; ``values`` are the cells as
    the parser took them (NULL where a value did not fit). One pass reads whole
    rows; nothing goes through the driver.
    """
    reader = spark.read.options(header=True, multiLine=multi_line, **QUOTES)
    names = reader.csv(path).columns
    texts = [T.StructField(n, T.StringType()) for n in names]
    whole = spark.read.options(header=True, multiLine=multi_line, columnPruning=False, columnNameOfCorruptRecord=RAGGED, **QUOTES)
    if schema is None:
        fields = texts
    else:
        wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        if wanted.names != names:
            raise ValueError(f"schema names {wanted.names} differ from the header {names}")
        fields = list(wanted.fields)
    read = whole.schema(T.StructType([*fields, T.StructField(RAGGED, T.StringType())])).csv(path)
    # Spark reads the corrupt-record column only beside parsed columns: all of them are kept in the query.
    read = read.select(F.col("_metadata.file_path").alias("file"), F.col(RAGGED), *[col(n).alias(f"_tally_cell{i}") for i, n in enumerate(names)])
    flagged = read.where(F.col(RAGGED).isNotNull()).withColumn(MORE, _too_long(len(names)))
    reason = F.when(F.col(MORE), F.lit("more values than the header")).otherwise(F.lit("a value does not fit the schema"))
    # A short row is no fault (missing values at the end are NULL): a misfit is a value the typed cell lost.
    plain = F.from_csv(F.col(RAGGED), ", ".join(f"`c{i}` string" for i in range(len(names))), QUOTES)
    lost = [plain[f"c{i}"].isNotNull() & (plain[f"c{i}"] != "") & F.col(f"_tally_cell{i}").isNull() for i in range(len(names))]
    misfit = F.lit(False)
    for one in lost:
        misfit = misfit | one
    found = flagged.where(F.col(MORE) | (F.lit(schema is not None) & misfit))
    parsed = F.array(*[F.col(f"_tally_cell{i}").cast("string") for i in range(len(names))])
    return found.select("file", F.col(RAGGED).alias("row"), reason.alias("reason"), parsed.alias("values"))


def _too_long(names: int) -> Column:
    """Whether a row has more values than the header has names, empty ones too.

    Only ragged rows have a text to read. It is read once more with marks put after its end:
    the first value that has no name is a mark unless the row itself has a value there.
    """
    width = names + 1
    marked = F.concat(F.col(RAGGED), F.lit(f",{END}" * width))
    wide = ", ".join(f"`c{k}` string" for k in range(width))
    beyond = F.from_csv(marked, wide, {**QUOTES, "maxColumns": str(MOST_VALUES + width)})[f"c{names}"]
    return F.when(F.col(RAGGED).isNotNull(), ~beyond.eqNullSafe(END)).otherwise(False)


def _typed(name: str, kind: str) -> Column:
    """The cell as another type; an error if it has a value that is none of that type."""
    value = col(name).try_cast(kind)
    message = F.concat(F.lit(f"column {name!r} is not {kind}: "), col(name))
    return F.when(col(name).isNotNull() & value.isNull(), F.raise_error(message).cast(kind)).otherwise(value)


def blank_missing(cells: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """NULL in place of every missing-value token in the text columns."""
    texts = {
        f.name: F.when(~col(f.name).isin(*MISSING_TOKENS), col(f.name))
        for f in cells.schema.fields
        if isinstance(f.dataType, T.StringType) and (names is None or f.name in names)
    }
    return cells.withColumns(texts) if texts else cells


def _fits(cell: Column) -> dict[str, Column]:
    whole = cell.rlike(INTEGER_TEXT)
    return {
        "present": cell.isNotNull(),
        "whole": whole,
        "bigint": whole & cell.try_cast("bigint").isNotNull(),
        UNSIGNED: whole & (cell.try_cast(UNSIGNED) >= 0),
        "double": is_float_text(cell),
        "boolean": F.lower(cell).isin("true", "false"),
    }


def infer_types(cells: DataFrame, names: Sequence[str]) -> tuple[dict[str, str], int]:
    """Narrowest type per column that loses nothing, and the rows that are too long, from one aggregate.

    Dates stay text. A column without any value is ``double``; whole numbers too
    long for any integer type stay text rather than lose digits.
    """
    if not names:
        return {}, 0
    columns = [F.struct(F.lit(i).alias("column"), col(n).alias("cell")) for i, n in enumerate([*names, MORE])]
    exploded = cells.select(F.explode(F.array(*columns)).alias("c")).select("c.*")
    counts = [F.count_if(condition).alias(kind) for kind, condition in _fits(F.col("cell")).items()]
    found = {r["column"]: r.asDict() for r in exploded.groupBy("column").agg(*counts).collect()}
    types = {}
    for i, name in enumerate(names):
        fits = found.get(i, {"present": 0})
        total = fits["present"]
        kinds = [k for k in ("bigint", UNSIGNED, "double", "boolean") if total and fits[k] == total]
        if total == 0:
            types[name] = "double"
        elif not kinds or (kinds[0] == "double" and fits["whole"] == total):
            types[name] = "string"
        else:
            types[name] = kinds[0]
    return types, found.get(len(names), {"present": 0})["present"]
