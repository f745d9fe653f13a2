"""Structured Streaming entry points: the same stateless transforms and keyed aggregates over a growing folder of Parquet files."""

from tessera.streaming.tables import drain, stream_table

__all__ = ["drain", "stream_table"]
