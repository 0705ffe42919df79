r"""Regular expressions in Java's dialect with Unicode classes, and helpers for literals.

``(?U)`` makes ``\s``, ``\d``, ``\w`` and ``\b`` Unicode-aware; ``\z`` is the end of the text alone (Java's ``$`` also
stops before a last line feed); ``d`` lets ``.`` cross every line end but ``\n``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"(?U)^\s*\z"
SPACES = r"(?U)\s+"
RIM = r"(?U)^\s+|\s+\z"
JR = r"(?iU)[, ]*jr[.]?\z"
INITIAL = r"(?iU)\b([a-z])[\s.]+"
IN_PARENTHESES = r"(?Ud)\A\s*[(]\s*(.+?)\s*[)]\s*\z"
MINUS_LAST = r"(?Ud)\A((?:[^-]).+)-\z"
GROUPING = r"(?U)[,\s]"
ZIP_LAST = r"(?U)\b(\d{5})(?:|-\d{4})[\s,.]*\z"
NUMBER = r"(?i)^[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?|inf|infinity|nan)\z"


def quoted(text: str) -> str:
    """``text`` as a literal of a pattern, each sign escaped on its own."""
    return "".join(c if c.isalnum() or c == "_" or ord(c) > 127 else "\\" + c for c in text)


def replacement(text: str) -> str:
    """``text`` as a literal of a replacement."""
    return re.sub(r"([\\$])", r"\\\1", text)


def any_of(words: Iterable[str]) -> str:
    """Alternation, longest first, since the first alternative that fits wins."""
    return "|".join(quoted(w) for w in sorted(words, key=lambda w: (-len(w), w)))


def group_or_null(column: Column, pattern: str) -> Column:
    """Group 1 of the first match, null where there is none; the group must not be empty."""
    return F.nullif(F.regexp_extract(column, pattern, 1), F.lit(""))


def let(column: Column, body: Callable[[Column], Column]) -> Column:
    """``body(column)`` with ``column`` evaluated once per row, however often ``body`` mentions it.

    Mentions multiply when such bodies are nested, and Catalyst shares them only outside of branches.
    """
    return F.element_at(F.transform(F.array(column), body), 1)
