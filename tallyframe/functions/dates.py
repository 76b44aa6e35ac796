"""Lenient reading of dates kept as text."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import cache

from pyspark.sql import Column, DataFrame, functions as F

# Fixed list of the date forms that are recognised, as Spark patterns. On equal numbers of
# parsed values the earlier one wins.
DAYS = (
    "yyyy-M-d",
    "M/d/yyyy",
    "yyyy/M/d",
    "MMMM d, yyyy",
    "MMM d, yyyy",
    "MMMM d yyyy",
    "MMM d yyyy",
    "d MMMM yyyy",
    "d MMM yyyy",
    "d-MMM-yyyy",
    "yyyyMMdd",
    "M-d-yyyy",
    "d/M/yyyy",
    "d.M.yyyy",
    "yyyy.M.d",
    "M/d/yy",
    "EEEE, MMMM d, yyyy",
    "EEE, MMM d, yyyy",
)
# Fixed list of the forms without a day, which no time follows.
LONGER = ("yyyy", "yyyy-M", "MMM yyyy", "MMMM yyyy")
# A time of day is made of a separator, one of these, and an offset where the clock has 24 hours.
SEPARATORS = (" ", "'T'")
CLOCKS = ("H:mm:ss", "H:mm", "H:mm:ss.SSSSSSSSS")
HALF_DAYS = ("h:mm:ss a", "h:mm a")
OFFSETS = ("", "XXX")


def _times() -> Iterable[str]:
    yield ""
    for separator in SEPARATORS:
        yield from (separator + clock + offset for clock in CLOCKS for offset in OFFSETS)
    yield from (" " + clock for clock in HALF_DAYS)


DATE_FORMATS = tuple(day + time for time in _times() for day in DAYS) + LONGER

OFFSET = r"(Z|[+-][0-9]{2}:?[0-9]{2})$"

# Fixed table: what each letter run of a pattern may match in the text, and the least
# and greatest number of characters that takes.
_FIELDS = {
    "yyyy": ("[0-9]{4}", 4, 4),
    "yy": ("[0-9]{2}", 2, 2),
    "EEEE": ("[A-Za-z]+", 6, 9),
    "EEE": ("[A-Za-z]{3}", 3, 3),
    "MMMM": ("[A-Za-z]+", 3, 9),
    "MMM": ("[A-Za-z]{3}", 3, 3),
    "MM": ("[0-9]{2}", 2, 2),
    "M": ("[0-9]{1,2}", 1, 2),
    "dd": ("[0-9]{2}", 2, 2),
    "d": ("[0-9]{1,2}", 1, 2),
    "HH": ("[0-9]{2}", 2, 2),
    "H": ("[0-9]{1,2}", 1, 2),
    "h": ("[0-9]{1,2}", 1, 2),
    "mm": ("[0-9]{2}", 2, 2),
    "ss": ("[0-9]{2}", 2, 2),
    "SSSSSSSSS": ("[0-9]{1,9}", 1, 9),
    "SSSSSS": ("[0-9]{1,6}", 1, 6),
    "a": ("[AaPp][Mm]", 2, 2),
    "XXX": ("(?:Z|[+-][0-9]{2}:?[0-9]{2})", 1, 6),
}
_TOKEN = re.compile(r"'([^']*)'|((?P<letter>[A-Za-z])(?P=letter)*)|(.)")
LONGEST = 60


@cache
def shape_of(fmt: str) -> tuple[str, int, int] | None:
    """Regular expression of a format and the least and greatest length of what fits it."""
    shape, least, most = "", 0, 0
    for quoted, run, _, other in _TOKEN.findall(fmt):
        if run and run not in _FIELDS:
            return None
        literal = quoted or other
        part = _FIELDS[run] if run else (re.escape(literal), len(literal), len(literal))
        shape, least, most = shape + part[0], least + part[1], most + part[2]
    return shape, least, most


def fits(text: Column, fmt: str) -> Column | None:
    """Whether a text has the first character, the length and the shape of a format.

    This keeps the parser off texts that cannot fit. The first two tests take the same
    time however long the text is. ``None`` if the pattern uses fields the table does
    not hold.
    """
    found = shape_of(fmt)
    if found is None:
        return None
    shape, least, most = found
    starts = text >= "A" if shape.startswith("[A-Z") else (text >= "0") & (text < ":")
    return starts & F.octet_length(text).between(least, most) & text.rlike(f"^{shape}$")


def parse_date(text: Column, fmt: str) -> Column:
    """Timestamp of a text in one format, NULL if it has another form.

    A text with an offset keeps its own local day: the offset is cut off before
    parsing, so the session time zone never moves it. The name of a weekday is cut off
    too, and AM and PM may be in either case. Two digits of a year stand for 1969 to 2068.
    """
    guard = fits(text, fmt)
    local, pattern = text, fmt
    if pattern.endswith("XXX"):
        local, pattern = F.regexp_replace(local, OFFSET, ""), pattern.removesuffix("XXX")
    if pattern.endswith(" a"):
        local = F.concat(F.substring(local, F.lit(1), F.length(local) - 2), F.upper(F.right(local, F.lit(2))))
    for weekday in ("EEEE, ", "EEE, "):
        if pattern.startswith(weekday):
            local, pattern = F.regexp_replace(local, "^[A-Za-z]+, ", ""), pattern.removeprefix(weekday)
    if "yyyy" not in pattern and pattern.startswith("M/d/yy"):
        century = F.when(F.regexp_extract(local, "^[0-9]+/[0-9]+/([0-9]{2})", 1) < "69", "20").otherwise("19")
        local = F.concat(
            F.regexp_extract(local, "^([0-9]+/[0-9]+/)", 1), century, F.regexp_extract(local, "^[0-9]+/[0-9]+/(.*)$", 1)
        )
        pattern = pattern.replace("yy", "yyyy")
    parsed = F.try_to_timestamp(local, F.lit(pattern))
    return parsed if guard is None else F.when(guard, parsed)


def parse_any(text: Column, formats: Sequence[str]) -> Column:
    """First format that fits each value by itself."""
    if not formats:
        return F.lit(None).cast("timestamp")
    return F.coalesce(*[parse_date(text, fmt) for fmt in formats])


@cache
def any_shape() -> str:
    """Regular expression of all forms together, built from their parts."""
    days, longer = ("|".join(dict.fromkeys(shape_of(f)[0] for f in fmts)) for fmts in (DAYS, LONGER))
    times = "|".join(dict.fromkeys(shape_of(t)[0] for t in _times() if t))
    return f"^(?:(?:{days})(?:{times})?|{longer})$"


def date_shape(text: Column) -> Column:
    """The form of a text that could be a date, 9 for a digit and A for a letter; else NULL.

    There are some thousand such forms, whatever the texts, so counts of them are small.
    """
    could = (text >= "0") & (text < "{") & F.octet_length(text).between(4, LONGEST) & text.rlike(any_shape())
    return F.when(could, F.regexp_replace(F.regexp_replace(text, "[0-9]", "9"), "[A-Za-z]", "A"))


@cache
def formats_of_shape(shape: str) -> tuple[str, ...]:
    """Known formats that some text of this form could have."""
    could = []
    for fmt in DATE_FORMATS:
        pattern = re.sub(r"\[AaPp\]\[Mm\]", "AA", shape_of(fmt)[0]).replace("Z|", "A|")
        pattern = re.sub(r"(?<!\[)T(?![a-z])", "A", pattern) if "'T'" in fmt else pattern
        if re.fullmatch(pattern, shape):
            could.append(fmt)
    return tuple(could)


def candidate_formats(shapes: Iterable[str]) -> list[str]:
    """Formats that texts of these forms could have, in the fixed order."""
    found = {fmt for shape in shapes for fmt in formats_of_shape(shape)}
    return [fmt for fmt in DATE_FORMATS if fmt in found]


def parse_counts(text: Column, formats: Sequence[str]) -> list[Column]:
    """One aggregate per format: how many values it parses."""
    return [F.count(parse_date(text, fmt)) for fmt in formats]


def formats_found(df: DataFrame, text: Column) -> list[tuple[str, int]]:
    """Known formats that parse any value of the column, with how many they parse.

    One aggregate finds the forms that occur and a second one parses with the few formats
    that have them, so no text meets more parsers than its column needs.
    """
    shapes = df.select(date_shape(text).alias("shape")).where("shape is not null").groupBy("shape").count()
    formats = candidate_formats(r["shape"] for r in shapes.collect())
    if not formats:
        return []
    hits = df.agg(*[c.alias(f"f{i}") for i, c in enumerate(parse_counts(text, formats))]).first()
    return [(fmt, n) for fmt, n in zip(formats, hits) if n]


def best_format(df: DataFrame, text: Column) -> str | None:
    """The one format that parses most values of the column (two aggregate jobs)."""
    found = formats_found(df, text)
    return max(found, key=lambda f: f[1])[0] if found else None
