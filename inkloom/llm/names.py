"""Names for helper columns that no column of a table has."""

from __future__ import annotations


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names with a prefix that none of the columns starts with, whatever their case."""
    prefix = "_"
    while any(c.lower().startswith(prefix) for c in columns):
        prefix += "_"
    return [prefix + n for n in names]
