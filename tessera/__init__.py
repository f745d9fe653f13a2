"""Tessera: a small analytics engine expressed entirely through the Spark DataFrame and SQL APIs."""
