"""Table readers: Parquet first, delimited text second."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.schemas import TABLES


def _strict(parts: Column, place: int, field: T.StructField) -> Column:
    """One field of a split row; what is no value of its type fails the query."""
    value = parts[place]
    if isinstance(field.dataType, T.StringType):
        return value.alias(field.name)
    parsed = value.try_cast(field.dataType)
    message = F.concat(F.lit(f"{field.name} is no {field.dataType.simpleString()}: "), value)
    return F.when(parsed.isNotNull(), parsed).otherwise(F.raise_error(message).cast(field.dataType)).alias(field.name)


def read_delimited(spark: SparkSession, path: str, schema: T.StructType, strict: bool = False) -> DataFrame:
    """Read ``|``-separated rows.

    Surplus fields are ignored, and so is a trailing separator. When ``strict``, a row with too few fields fails the query, and so does
    a field that is no value of its type (an empty one too, but for texts), as soon as a column of that row or that field is
    read; lines end with a line feed. Otherwise missing and malformed fields are null.
    """
    if strict:
        n = len(schema.fields)
        parts = F.split("value", "\\|")
        # a last piece without a character is what follows a trailing separator, no field
        complete = (F.size(parts) > n) | ((F.size(parts) == n) & (parts[n - 1] != ""))
        whole = F.when(complete, parts).otherwise(F.raise_error(F.lit("a row has too few fields")).cast("array<string>"))
        rows = spark.read.option("lineSep", "\n").text(path).select(whole.alias("parts"))
        return rows.select(*[_strict(F.col("parts"), i, f) for i, f in enumerate(schema.fields)])
    # One more field takes what a trailing separator leaves.
    wide = T.StructType([*schema.fields, T.StructField("_rest", T.StringType(), True)])
    frame = spark.read.schema(wide).options(sep="|", dateFormat="yyyy-MM-dd", quote="").csv(path)
    return frame.select(*[f.name for f in schema.fields])


def load(spark: SparkSession, directory: str, table: str, force: bool = True, strict: bool = True) -> DataFrame:
    """``<directory>/<table>.parquet``, else ``<directory>/<table>.tbl``, of which ``strict`` bears no malformed row.

    With ``force`` a missing table raises; without it, the table is empty with its declared schema.
    """
    try:
        return spark.read.parquet(f"{directory}/{table}.parquet")
    except AnalysisException:
        if table not in TABLES:
            raise
    try:
        return read_delimited(spark, f"{directory}/{table}.tbl", TABLES[table], strict)
    except AnalysisException:
        if force:
            raise
        return spark.createDataFrame([], TABLES[table])


def load_schema(spark: SparkSession, directory: str, force: bool = True) -> dict[str, DataFrame]:
    """All seven tables by name; also registers them as temporary views."""
    tables = {name: load(spark, directory, name, force) for name in TABLES}
    for name, frame in tables.items():
        frame.createOrReplaceTempView(name)
    return tables


def missing_columns(frame: DataFrame, table: str) -> list[str]:
    """Declared columns that a loaded table lacks."""
    return [f.name for f in TABLES[table].fields if f.name not in frame.columns]
