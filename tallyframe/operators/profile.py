"""Findings about the columns of a table that matter before it is queried."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tallyframe.operators.ids import id_names
from tallyframe.operators.metrics import measure
from tallyframe.operators.rules import TEXT_RULES, date_hits, missing_rate_is_high

SCHEMA = "ordinal int, column string, rule string, metric double"

NO_FINDINGS = "No structural issues detected."
ADVICE = {
    "comma_list": "holds comma-separated lists; split them before counting or grouping",
    "number_with_unit": "holds numbers with a unit; take the number out before aggregating",
    "date_text": "holds dates as text; parse them before filtering or sorting by date",
    "mixed_numeric": "is numeric but for some values; clean it before aggregating",
    "missing_rate": "is missing in {:.0%} of the rows; it may not be usable",
    "unique": "has a different value in every row; it is likely an identifier",
}


def profile(df: DataFrame) -> DataFrame:
    """One row per finding: the rule and the share of the values it holds for.

    One pass measures every column. Two more look at the columns whose values have the
    form of dates, and one or two at all likely identifiers together. The result has at
    most six rows per column.
    """
    rows, measured = measure(df, df.columns, rules=list(TEXT_RULES))
    dated = [m for m in measured if "date_text" in m.hits and TEXT_RULES["date_text"].holds(m.present, m.hits["date_text"])]
    for m in dated:  # the form of a date in so many values: now count those that are one
        m.hits["date_text"] = 0
    for name, hits in date_hits(df, [m.name for m in dated]).items():
        next(m for m in dated if m.name == name).hits["date_text"] = hits
    ids = id_names(df, rows, measured)
    findings = []
    for m in measured:
        for rule, hits in m.hits.items():
            if TEXT_RULES[rule].holds(m.present, hits):
                findings.append((m.name, rule, hits / m.present))
        if missing_rate_is_high(rows, rows - m.present):
            findings.append((m.name, "missing_rate", (rows - m.present) / rows))
        if m.name in ids:
            findings.append((m.name, "unique", 1.0))
    numbered = [(i + 1, *finding) for i, finding in enumerate(findings)]
    return df.sparkSession.createDataFrame(numbered, SCHEMA)


def profile_text(findings: DataFrame) -> str:
    lines = [
        f"{r['column']} {ADVICE[r['rule']].format(r['metric'])}"
        for r in findings.orderBy("ordinal").collect()
    ]
    return "\n".join(lines or [NO_FINDINGS])
