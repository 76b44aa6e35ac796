"""A row's place in the files it was read from, for orders that follow the files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: The name that asks for file order where a column of that name does not exist.
FILE = "file"


def file_place(df: DataFrame) -> list[Column]:
    """Sort columns of the files' order: the path, then Parquet's row index.

    Formats without a row index (CSV, JSON) give the start of the split and the row's
    number within its task, which follows the file inside one split. Raises if the rows
    were not read from files.
    """
    try:
        fields = df.select("_metadata.*").columns
    except Exception as error:
        raise ValueError("order_by='file' needs rows read from files") from error
    if "row_index" in fields:
        return [F.col("_metadata.file_path"), F.col("_metadata.row_index")]
    return [F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()]


def wants_file_order(df: DataFrame, order: list[str]) -> bool:
    return order == [FILE] and FILE not in df.columns
