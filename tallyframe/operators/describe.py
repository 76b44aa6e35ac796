"""Description of a table: columns, types, sizes and missing values."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyframe.functions.missing import present
from tallyframe.operators.order import sample_rows

SAMPLE = 3


def describe(df: DataFrame) -> DataFrame:
    """One row per column, from one aggregate over the table."""
    counts = [F.count(present(df, c)).alias(f"present {i}") for i, c in enumerate(df.columns)]
    lines = [
        F.struct(
            F.lit(i + 1).alias("ordinal"),
            F.lit(f.name).alias("column"),
            F.lit(f.dataType.simpleString()).alias("dtype"),
            F.col("n_rows"),
            (F.col("n_rows") - F.col(f"present {i}")).alias("n_missing"),
        )
        for i, f in enumerate(df.schema.fields)
    ]
    return df.agg(F.count("*").alias("n_rows"), *counts).select(F.inline(F.array(*lines)))


def describe_text(df: DataFrame, sample: int = SAMPLE, notes: str = "") -> str:
    """The description, a few sample rows and the caller's notes as plain text."""
    lines = describe(df).orderBy("ordinal").collect()
    n_rows = lines[0]["n_rows"] if lines else df.count()
    parts = [f"{n_rows} rows, {len(df.columns)} columns"]
    parts += [f"{r['column']}: {r['dtype']}, {r['n_missing']} missing" for r in lines]
    parts += [f"first {sample} rows:"]
    parts += [str(r.asDict()) for r in sample_rows(df, sample).collect()]
    return "\n".join(parts + ([notes] if notes else []))
