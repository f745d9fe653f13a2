"""Column types by short names, and their Spark counterparts.

Spark has no unsigned integers: each is held by the next wider signed type, the widest by a decimal of 20 digits. A cast to a
declared type is checked, so a value out of its range fails instead of wrapping around.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Short name -> Spark type.
COLUMN_TYPES: dict[str, T.DataType] = {
    "I1": T.ByteType(), "I2": T.ShortType(), "I4": T.IntegerType(), "I8": T.LongType(),
    "UI1": T.ShortType(), "UI2": T.IntegerType(), "UI4": T.LongType(), "UI8": T.DecimalType(20, 0),
    "F4": T.FloatType(), "F8": T.DoubleType(), "Bool": T.BooleanType(), "Char": T.StringType(), "String": T.StringType(), "Date": T.DateType(),
}


def struct_of(layout: dict[str, str]) -> T.StructType:
    """A schema from column names and short type names."""
    return T.StructType([T.StructField(name, COLUMN_TYPES[kind], True) for name, kind in layout.items()])


def checked(column: Column, kind: str) -> Column:
    """The column as a declared type; a negative or too large unsigned value, or a text longer than a Char, fails the query."""
    value = column.cast(COLUMN_TYPES[kind])
    if kind.startswith("UI"):
        fits = (value >= 0) & (value < F.lit(str(256 ** int(kind[2:]))).cast("decimal(38,0)"))
    elif kind == "Char":
        fits = F.length(value) <= 1
    else:
        return value
    return F.when(value.isNull() | fits, value).otherwise(F.raise_error(F.lit(f"a value is no {kind}")).cast(COLUMN_TYPES[kind]))
