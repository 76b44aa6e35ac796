"""A declarative request, read from a plain dictionary."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from tallyframe.operators.counts import value_limit
from tallyframe.operators.order import DEFAULT_ROWS

OPERATIONS = ("filter", "value_counts", "group_by_agg", "sort_limit")
UNSUPPORTED = "unsupported"


@dataclass(frozen=True)
class Request:
    operation: str
    reason: str | None = None
    filters: Any = None
    target: Any = None
    agg_column: str | None = None
    agg_func: str = "count"
    ascending: bool = False
    limit: int | None = None


def read_request(plan: Mapping, first_column: str | None) -> Request:
    """The request with its defaults filled in; an unknown operation is unsupported."""
    operation = plan.get("operation")
    if operation == UNSUPPORTED:
        return Request(UNSUPPORTED, reason=plan.get("reason", "No reason provided"))
    if operation not in OPERATIONS:
        return Request(UNSUPPORTED, reason=f"Unknown operation: {operation}")

    target = plan.get("target_column", first_column if operation == "sort_limit" else None)
    if operation != "filter" and not target:
        raise ValueError(f"{operation} needs a target_column")
    limit = plan.get("limit", DEFAULT_ROWS if operation == "sort_limit" else None)
    if limit is not None and (isinstance(limit, bool) or not isinstance(limit, int)):
        raise ValueError(f"limit must be a whole number, not {limit!r}")
    return Request(
        operation,
        filters=plan.get("filter"),
        target=target,
        agg_column=plan.get("agg_column"),
        agg_func=plan.get("agg_func") or "count",
        ascending=bool(plan.get("sort_ascending", False)),
        limit=value_limit(limit) if operation == "value_counts" else limit,
    )
