"""Run a request: filters first, then one operation."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, Observation, functions as F

from tallyframe.operators.breakdown import EXCLUDED, breakdown, pick_breakdown_column
from tallyframe.operators.counts import matching_rows, total_values, value_counts
from tallyframe.operators.filters import apply_filters
from tallyframe.operators.groups import group_agg, groups_count, order_groups
from tallyframe.operators.ids import id_columns
from tallyframe.operators.order import sample_rows, sort_limit
from tallyframe.operators.series import (
    SMALL_SERIES,
    breakdown_series,
    chart_kind,
    count_series,
    first_labels,
    group_series,
    looks_like_years,
    sort_series,
    with_share,
)
from tallyframe.plans.request import UNSUPPORTED, Request, read_request

SAMPLE = 5


@dataclass
class PlanResult:
    """What a request gave.

    ``rows`` is the result and ``filtered`` the table after the filters. Everything else
    is worked out when it is first asked for and then kept: the id columns and the
    breakdown column read the whole filtered table once.
    """

    request: Request
    filtered: DataFrame | None = None
    rows: DataFrame | None = None
    exclude: Iterable[str] = EXCLUDED
    matching: int | None = field(default=None, repr=False)

    @property
    def operation(self) -> str:
        return self.request.operation

    @property
    def reason(self) -> str | None:
        return self.request.reason

    @property
    def supported(self) -> bool:
        return self.operation != UNSUPPORTED

    @property
    def columns(self) -> list[str]:
        return self._table().columns

    def _table(self) -> DataFrame:
        if self.filtered is None:
            raise ValueError(f"unsupported request: {self.reason}")
        return self.filtered

    def count(self) -> int:
        """Rows that pass the filters; known without a job once ``write_rows`` has written a filter's rows."""
        if self.matching is None:
            self.matching = matching_rows(self._table()).first()["matching_rows"]
        return self.matching

    def write_rows(self, path: str, fmt: str = "parquet") -> None:
        """Write ``rows``. For a filter, the rows that pass are counted by an ``Observation`` of
        the same job, so ``count()`` reads the table no second time."""
        if self.rows is None:
            raise ValueError(f"unsupported request: {self.reason}")
        rows, observation = self.rows, None
        if self.operation == "filter" and self.rows is self.filtered:
            observation = Observation("tallyframe_matching_rows")
            rows = rows.observe(observation, F.count(F.lit(1)).alias("matching_rows"))
        rows.write.format(fmt).save(path)
        if observation is not None:
            self.matching = observation.get["matching_rows"]

    def sample(self, n: int = SAMPLE, order_by: Sequence[str] | None = None) -> DataFrame:
        return sample_rows(self._table(), n, order_by)

    def id_columns(self) -> list[str]:
        return list(self._ids)

    @cached_property
    def _ids(self) -> list[str]:
        return id_columns(self._table())

    def breakdown_column(self) -> str | None:
        return self._breakdown_column

    @cached_property
    def _breakdown_column(self) -> str | None:
        return pick_breakdown_column(self._table(), self.exclude)

    def breakdown(self, column: str | None = None) -> DataFrame:
        return breakdown(self._table(), column or self.breakdown_column(), self.exclude)

    def total_values(self) -> int:
        return total_values(self._table(), self.request.target).first()["total_values"]

    def groups_count(self) -> int:
        return groups_count(self._table(), self.request.target).first()["groups_count"]

    def series(self, value: str | None = None) -> DataFrame | None:
        """``ordinal, label, value`` of the chart, ``None`` where there is none.

        For sorted rows, ``value`` names the column shown. Without it the first column that is
        no identifier is taken, which depends on the data, and only labels like years are charted.
        """
        if value is None:
            return self._series
        if self.operation != "sort_limit" or not isinstance(self.request.target, str):
            raise ValueError("a value column is named for rows sorted by one column")
        return sort_series(self.rows, self.request.target, value, self.request.ascending, self._bounded())

    def shares(self) -> DataFrame | None:
        """The series with ``pct``, each value's share of the total shown."""
        series = self.series()
        small = self.operation == "group_by_agg" or (self.operation != "filter" and self._bounded())
        return None if series is None else with_share(series, small)

    @cached_property
    def _series(self) -> DataFrame | None:
        if self.operation == "filter":
            column = self.breakdown_column()
            return None if column is None else breakdown_series(self.breakdown(column))
        if self.operation == "value_counts":
            return count_series(self.rows, self._bounded())
        if self.operation == "group_by_agg":
            return group_series(self.rows)
        if self.operation == "sort_limit":
            return self._sorted_series()
        return None

    def _bounded(self) -> bool:
        return self.request.limit is not None and self.request.limit <= SMALL_SERIES

    def _sorted_series(self) -> DataFrame | None:
        target, ascending = self.request.target, self.request.ascending
        if not isinstance(target, str):
            return None
        labels = first_labels(self.rows, target, ascending)
        if labels.isEmpty() or not labels.agg(looks_like_years(labels["label"]).alias("y")).first()["y"]:
            return None
        others = [c for c in self.rows.columns if c != target]
        ids = set()
        for column in others:
            ids.update(id_columns(self._table(), [column]))
            if column not in ids:
                return sort_series(self.rows, target, column, ascending, self._bounded())
        return None

    def kind(self, choice: str | None = None) -> str | None:
        """Kind of chart for the series; rows sorted by year are always a line."""
        series = self.series()
        if series is None or series.isEmpty():
            return None
        if self.operation == "sort_limit":
            return "line"
        target = self.breakdown_column() if self.operation == "filter" else self.request.target
        return chart_kind(series, target, choice).first()["kind"]


def run_plan(
    df: DataFrame,
    plan: Mapping,
    formats: Sequence[str] | str | None = None,
    split: bool | str = "auto",
    units: bool | str = "auto",
    order_by: str | Sequence[str] | None = None,
    exclude: Iterable[str] = EXCLUDED,
) -> PlanResult:
    """Check a request against the table and give its lazy result.

    ``formats``, ``split`` and ``units`` fix what otherwise depends on the data and
    is settled by one small aggregate each: the format of date texts, whether lists
    are split, and whether numbers are taken out of texts.
    """
    request = read_request(plan, df.columns[0] if df.columns else None)
    result = PlanResult(request, exclude=exclude)
    if not result.supported:
        return result
    kept = apply_filters(df, request.filters, formats)
    if request.operation == "filter":
        rows = kept
    elif request.operation == "value_counts":
        rows = value_counts(kept, request.target, request.limit, split)
    elif request.operation == "group_by_agg":
        rows = order_groups(
            group_agg(kept, request.target, request.agg_column, request.agg_func, units, order_by)
        )
    else:
        rows = sort_limit(kept, request.target, request.ascending, request.limit)
    result.filtered, result.rows = kept, rows
    return result
