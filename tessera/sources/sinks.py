"""Sinks: text output with a header, and a row counter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_lines(frame: DataFrame) -> DataFrame:
    """One column ``value``: the fields of each row joined by commas, null as nothing."""
    # concat_ws would skip nulls and so shift the fields
    return frame.select(F.concat_ws(",", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in frame.columns]).alias("value"))


def format_rows(frame: DataFrame, limit: int | None = None) -> str:
    """The header joined by ``", "`` and each row joined by ``","``; meant for results that fit the driver."""
    body = as_lines(frame if limit is None else frame.limit(limit)).collect()
    return "\n".join([", ".join(frame.columns), *[row.value for row in body]]) + "\n"


def write_text(frame: DataFrame, path: str) -> None:
    """The rows as distributed text files of comma-joined fields (no header)."""
    as_lines(frame).write.mode("overwrite").text(path)


def count_rows(frame: DataFrame) -> int:
    """Number of rows of a result."""
    return frame.count()
