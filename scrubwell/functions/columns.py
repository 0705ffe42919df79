"""Column names: quoting, and names that a frame doesn't have."""

from __future__ import annotations

from pyspark.sql import DataFrame


def quoted_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The names, each with underscores added until ``df`` has no column of it (in any case of its letters)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
