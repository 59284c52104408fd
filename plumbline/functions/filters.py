"""Predicates with the null rules of a data frame: a comparison with null is false, and
"not equal" to a value is true for null."""

from __future__ import annotations

import operator
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_COMPARE = {">": operator.gt, "<": operator.lt, ">=": operator.ge, "<=": operator.le, "==": operator.eq}


@dataclass(frozen=True)
class FilterSpec:
    """One comparison of a column with a number."""

    column: str
    op: str
    value: float


def predicate(spec: FilterSpec) -> Column:
    """The spec as a column that is never null."""
    if spec.op == "!=":
        return ~F.col(spec.column).eqNullSafe(F.lit(spec.value))
    if spec.op not in _COMPARE:
        raise ValueError(f"unknown comparison: {spec.op}")
    return F.coalesce(_COMPARE[spec.op](F.col(spec.column), F.lit(spec.value)), F.lit(False))


def all_of(specs: Iterable[FilterSpec]) -> Column:
    return reduce(operator.and_, map(predicate, specs), F.lit(True))


def _need(df: DataFrame, columns: Iterable[str]) -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def filter_all(df: DataFrame, specs: Iterable[FilterSpec]) -> DataFrame:
    """Rows that meet every spec."""
    specs = list(specs)
    _need(df, (s.column for s in specs))
    return df.filter(all_of(specs))


def exclude_any(df: DataFrame, groups: Iterable[Iterable[FilterSpec]]) -> DataFrame:
    """Rows that meet no group of specs as a whole."""
    groups = [list(g) for g in groups]
    _need(df, (s.column for g in groups for s in g))
    return df.filter(~reduce(operator.or_, map(all_of, groups), F.lit(False)))


def between(column: str, low: float | None = None, high: float | None = None) -> Column:
    """Strictly between the bounds; null is outside."""
    c = F.col(column)
    tests = [c > low] * (low is not None) + [c < high] * (high is not None)
    return F.coalesce(reduce(operator.and_, tests, F.lit(True)), F.lit(False))


def members(df: DataFrame, column: str, values: list) -> DataFrame:
    """Rows whose value is one of ``values``."""
    return df.filter(F.col(column).isin(values))


def slice_rows(df: DataFrame, expression: str) -> DataFrame:
    """Rows of a named slice, given as a SQL expression."""
    return df.filter(F.expr(expression))


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN means missing: null it in all float columns."""
    floats = [n for n, t in df.dtypes if t in ("float", "double")]
    return df.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in floats}) if floats else df
