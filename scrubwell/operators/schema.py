"""Column names."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame

__all__ = "normalize_column_names".split()


def normalize_column_names(df: DataFrame, separator: str = "_") -> DataFrame:
    """All names stripped, in small letters, white space as ``separator``; raises if two become one."""
    names = [re.sub(r"\s+", lambda _: separator, c.strip().lower()) for c in df.columns]
    twice = sorted(n for n, k in Counter(names).items() if k > 1)
    if twice:
        raise ValueError(f"names collide after normalisation: {twice}")
    return df.toDF(*names)
