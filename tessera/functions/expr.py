"""Column builders. Everything here is a JVM-side expression that Catalyst can push down and fold."""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_BINARY = {
    "add": operator.add,
    "subtract": operator.sub,
    "multiply": operator.mul,
    "divide": operator.truediv,
    "eq": operator.eq,
    "neq": operator.ne,
    "less": operator.lt,
    "less_equal": operator.le,
    "greater": operator.gt,
    "greater_equal": operator.ge,
    "and": operator.and_,
    "or": operator.or_,
}


def all_of(*conditions: Column) -> Column:
    """Conjunction of one or more conditions."""
    return functools.reduce(operator.and_, conditions)


def any_of(*conditions: Column) -> Column:
    """Disjunction of one or more conditions."""
    return functools.reduce(operator.or_, conditions)


def constant(value: object, kind: str | None = None) -> Column:
    """A literal column, cast if a type is named."""
    return F.lit(value) if kind is None else F.lit(value).cast(kind)


def with_constant(code: str, value: object, column: Column) -> Column:
    """``value OP column``: the constant is the left operand, so ``less_equal`` of 5 keeps columns of at least 5."""
    return _BINARY[code](F.lit(value), column)


def int_div(left: Column, right: Column) -> Column:
    """Integer division that truncates toward zero."""
    return F.call_function("div", left, right)


def cast_to(column: Column, kind: str, checked: bool = True) -> Column:
    """Cast; out of range raises when ``checked`` and is null otherwise."""
    return column.cast(kind) if checked else column.try_cast(kind)


def date_shift(column: Column, days: int) -> Column:
    """The date ``days`` later (earlier if negative)."""
    return F.date_add(column.cast("date"), days)


def epoch_day(column: Column) -> Column:
    """Days since 1970-01-01."""
    return F.unix_date(column.cast("date"))


def in_list(column: Column, values: Iterable[str]) -> Column:
    """Membership in a literal list; never true of an empty list."""
    return column.isin(list(values))


def _pattern(tokens: Sequence[str]) -> str:
    quoted = [t.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") for t in tokens]
    return "%" + "%".join(quoted) + "%"


def like_tokens(column: Column, tokens: Sequence[str]) -> Column:
    """True if all tokens occur one after the other; true of an empty list."""
    return column.like(_pattern(tokens)) if tokens else column.isNotNull()


def not_like_tokens(column: Column, tokens: Sequence[str]) -> Column:
    """Negation of :func:`like_tokens`; false of an empty list."""
    return ~like_tokens(column, tokens)
