"""Declarative questions about one table, answered by Spark.

Every operator takes a ``DataFrame`` and gives back a ``DataFrame`` or a
``Column``. Nothing here owns a session, registers a Python UDF or pulls a result
of unknown size to the driver.
"""

from tallyframe.operators.breakdown import breakdown, pick_breakdown_column
from tallyframe.operators.counts import matching_rows, total_values, value_counts
from tallyframe.operators.derive import derive_durations, unit_column
from tallyframe.operators.describe import describe, describe_text
from tallyframe.operators.filters import apply_filters
from tallyframe.operators.groups import group_agg, groups_count
from tallyframe.operators.ids import id_columns
from tallyframe.operators.order import sample_rows, sort_limit
from tallyframe.operators.profile import profile, profile_text
from tallyframe.operators.series import with_share
from tallyframe.plans.runner import PlanResult, run_plan
from tallyframe.sinks.files import write_csv, write_json
from tallyframe.sources.files import bad_rows, load_csv, load_parquet
from tallyframe.functions.missing import nan_to_null

__all__ = [
    "PlanResult",
    "apply_filters",
    "breakdown",
    "derive_durations",
    "describe",
    "describe_text",
    "group_agg",
    "groups_count",
    "id_columns",
    "bad_rows",
    "load_csv",
    "load_parquet",
    "matching_rows",
    "nan_to_null",
    "pick_breakdown_column",
    "profile",
    "profile_text",
    "run_plan",
    "sample_rows",
    "sort_limit",
    "total_values",
    "unit_column",
    "value_counts",
    "with_share",
    "write_csv",
    "write_json",
]
