from tessera.operators.relational import (
    AGGREGATES,
    aggregate,
    equi_join,
    filter_keep,
    limit,
    project,
    scan,
    top,
)

__all__ = ["AGGREGATES", "aggregate", "equi_join", "filter_keep", "limit", "project", "scan", "top"]
