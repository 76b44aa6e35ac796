"""Native expressions over text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

# All characters that count as white space when a text is stripped.
WHITE_SPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())

# Fixed patterns. Only ASCII digits count.
WHOLE_NUMBER = r"^[+-]?[0-9]+$"
INTEGER_TEXT = r"^\s*[+-]?[0-9]+\s*$"
FLOAT_TEXT = r"^\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity))\s*$"
FIRST_NUMBER = r"([0-9]+(?:\.[0-9]+)?)"
NUMBER_WITH_UNIT = r"^[0-9]+(\.[0-9]+)?(?U:[\s\x1c-\x1f]*)[a-zA-Z]"


def text_form(value: Column, dtype: T.DataType) -> Column:
    """Text that a value is searched by and labelled with.

    Booleans are ``True`` and ``False``, and doubles and floats are written out from
    0.0001 to 1e16, the same forms that equality takes. Other types have Spark's text.
    """
    if isinstance(dtype, T.BooleanType):
        return F.when(value, "True").when(~value, "False")
    if not isinstance(dtype, (T.DoubleType, T.FloatType)):
        return value.cast("string")
    text, size = value.cast("string"), F.abs(value)
    digits = F.regexp_replace(text.try_cast("decimal(38,22)").cast("string"), "0+$", "")
    written_out = F.regexp_replace(digits, r"\.$", ".0")
    mantissa = F.regexp_replace(F.split_part(text, F.lit("E"), F.lit(1)), r"\.0$", "")
    exponent = F.split_part(text, F.lit("E"), F.lit(2)).try_cast("int")
    sign = F.when(exponent < 0, "e-").otherwise("e+")
    power = F.abs(exponent).cast("string")
    scientific = F.concat(mantissa, sign, F.when(F.length(power) < 2, "0").otherwise(""), power)
    infinite = F.when(value > 0, "inf").otherwise("-inf")
    return (
        F.when(value.isNull() | F.isnan(value), F.lit(None).cast("string"))
        .when(((size >= 0.001) & (size < 1e7)) | (size == 0), text)
        .when(size == float("inf"), infinite)
        .when((size >= 0.0001) & (size < 1e16), written_out)
        .otherwise(scientific)
    )


def strip(text: Column) -> Column:
    """Both ends without white space of any kind.

    Blanks are dropped first. A text that then starts and ends with a visible ASCII
    character is done; only others are checked against the full list.
    """
    text = F.trim(text)
    visible = (text >= "!") & (text < "\x7f") & F.right(text, F.lit(1)).between("!", "~")
    return F.when(visible, text).otherwise(F.btrim(text, F.lit(WHITE_SPACE)))


def explode_list(rows: DataFrame, text: Column, name: str) -> DataFrame:
    """One row per stripped item of comma-separated texts; empty items stay."""
    items = rows.select(F.explode(F.split(text, ",", -1)).alias(name))
    return items.select(strip(F.col(name)).alias(name))


def first_number(text: Column) -> Column:
    """First unsigned number in a text, 0.0 if it holds none, NULL for NULL."""
    found = F.regexp_extract(text, FIRST_NUMBER, 1).try_cast("double")
    return F.when(text.isNotNull(), F.coalesce(found, F.lit(0.0)))


def whole_number_with_unit(text: Column, unit: str, *suffixes: str) -> Column:
    """Whole number that is left when the unit suffixes are taken out of a text.

    NULL if ``unit`` does not occur, or if anything but a whole number is left.
    """
    rest = text
    for suffix in suffixes:
        rest = F.replace(rest, F.lit(suffix), F.lit(""))
    rest = strip(rest)
    usable = text.contains(unit) & rest.rlike(WHOLE_NUMBER)
    return F.when(usable, rest.try_cast("bigint"))


def is_number_with_unit(text: Column) -> Column:
    return text.rlike(NUMBER_WITH_UNIT)


def is_float_text(text: Column) -> Column:
    return text.rlike(FLOAT_TEXT)
