from tessera.sources.reader import load, load_schema, missing_columns, read_delimited
from tessera.sources.schemas import TABLES
from tessera.sources.sinks import as_lines, count_rows, format_rows, write_text
from tessera.sources.types import COLUMN_TYPES, checked, struct_of

__all__ = ["COLUMN_TYPES", "TABLES", "as_lines", "checked", "struct_of", "count_rows", "format_rows", "load", "load_schema", "missing_columns", "read_delimited", "write_text"]
