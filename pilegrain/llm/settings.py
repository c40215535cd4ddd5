"""Tables of settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row


def few(settings: DataFrame, most: int) -> list[Row]:
    """All rows of a table of settings; more than most of them is an error, never cut."""
    rows = settings.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows of settings")
    return rows
