from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def stream_table(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    """An unbounded read of a folder of Parquet files; the schema is that of the files there now."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def drain(frame: DataFrame, output: str, checkpoint: str, mode: str = "append", fmt: str = "parquet") -> None:
    """Process all that is available now, exactly once by way of ``checkpoint``, and stop."""
    query = (
        frame.writeStream.format(fmt)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(output)
    )
    query.awaitTermination()
