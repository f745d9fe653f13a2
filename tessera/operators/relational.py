"""Relational operators as DataFrame transforms.

Each returns a lazy DataFrame; Catalyst prunes columns, pushes predicates, orders joins and picks strategies. None collects
or hints a broadcast, so that adaptive execution decides from measured sizes.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Aggregate name -> builder. ``count`` of no column counts rows.
AGGREGATES = {
    "count": lambda c=None: F.count(F.lit(1)) if c is None else F.count(c),
    "sum": F.sum,
    "avg": F.avg,
    "min": F.min,
    "max": F.max,
    "median": F.median,
    "count_distinct": F.count_distinct,
    "sum_distinct": F.sum_distinct,
}

_HOW = {"inner": "inner", "left_semi": "left_semi", "left_outer": "left_outer"}


def scan(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Read the named columns, in order; an unknown name raises."""
    return frame.select(*columns)


def project(frame: DataFrame, expressions: Mapping[str, Column], keep: Sequence[str] = ()) -> DataFrame:
    """Kept columns followed by named expressions."""
    return frame.select(*keep, *[e.alias(name) for name, e in expressions.items()])


def filter_keep(frame: DataFrame, condition: Column, keep: Sequence[str] | None = None) -> DataFrame:
    """Rows for which the condition is true, reduced to the kept columns."""
    kept = frame.where(condition)
    return kept if keep is None else kept.select(*keep)


def aggregate(frame: DataFrame, keys: Sequence[str], measures: Mapping[str, tuple], having: Column | None = None) -> DataFrame:
    """Hash aggregation: keys, then measures. ``measures`` maps an output name to ``(function,)`` or ``(function, column)``.

    Without keys there is exactly one row, also of empty input (count 0, the others null).
    """
    columns = [
        AGGREGATES[spec[0]](*[F.col(c) if isinstance(c, str) else c for c in spec[1:]]).alias(name)
        for name, spec in measures.items()
    ]
    out = frame.groupBy(*keys).agg(*columns) if keys else frame.agg(*columns)
    return out if having is None else out.where(having)


def equi_join(
    left: DataFrame,
    right: DataFrame,
    left_keys: Sequence[str],
    right_keys: Sequence[str],
    how: str = "inner",
    residual: Column | None = None,
    unique_left: bool = False,
) -> DataFrame:
    """Equi join on one or more keys; the left side is the one preserved by ``left_semi`` and ``left_outer``.

    Duplicate keys on either side multiply rows as in SQL. ``unique_left`` asserts that the left keys are unique: a left
    key that occurs twice fails the query instead of multiplying rows. Clashing names stay reachable through their frames.
    """
    if len(left_keys) != len(right_keys) or not left_keys:
        raise ValueError("as many left keys as right keys are needed, and one at least")
    if unique_left:
        left = _checked_unique(left, left_keys)
    condition = [left[a] == right[b] for a, b in zip(left_keys, right_keys, strict=True)]
    if residual is not None:
        condition.append(residual)
    return left.join(right, condition, _HOW[how])


def _checked_unique(frame: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same rows; raises at run time if a key occurs twice. One aggregation on the join keys, so the join reuses its exchange."""
    names = frame.columns
    packed = frame.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in names if c not in keys]
    )
    checked = F.when(F.col("_n") > 1, F.raise_error(F.lit("the left join keys are not unique"))).otherwise(F.lit(True))
    return packed.where(checked).select(*names)


def limit(frame: DataFrame, n: int) -> DataFrame:
    """Any ``n`` rows; which ones is not defined."""
    return frame.limit(n)


def top(frame: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows of a total order, without a global sort."""
    return frame.orderBy(*order).limit(n)
