"""Person names and e-mail addresses."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column
from pyspark.sql import functions as F

from scrubwell.functions.patterns import INITIAL, JR, any_of, group_or_null, quoted
from scrubwell.functions.tables import DEFAULT_CREDENTIALS, DEFAULT_NAME_PREFIXES, DEFAULT_NAME_SUFFIXES
from scrubwell.types import ColumnTransform

__all__ = """
extract_email_local_part extract_email_local_part_strict remove_credentials remove_jr_suffix
standardize_initials strip_name_prefixes strip_name_suffixes
""".split()


def remove_jr_suffix(c: Column) -> Column:
    """No ``jr`` at the end, with or without a separator before it."""
    return F.regexp_replace(c, JR, "")


def extract_email_local_part(c: Column) -> Column:
    """What stands before the first ``@``; all of it where there is none."""
    return F.substring_index(c, "@", 1)


def extract_email_local_part_strict(c: Column) -> Column:
    """The same, but null where there is no ``@`` or nothing before it."""
    return group_or_null(c, r"^([^@]+)@")


def strip_name_suffixes(suffixes: Collection[str] = DEFAULT_NAME_SUFFIXES) -> ColumnTransform:
    """One generational suffix at the end goes; it needs a comma or space before it."""
    if not suffixes:
        raise ValueError("suffixes must not be empty")
    pattern = rf"(?iU)[, ]+(?:{any_of(suffixes)})\.?\z"
    return lambda c: F.regexp_replace(c, pattern, "")


def strip_name_prefixes(prefixes: Collection[str] = DEFAULT_NAME_PREFIXES) -> ColumnTransform:
    """One honorific at the start goes; it needs white space after it."""
    if not prefixes:
        raise ValueError("prefixes must not be empty")
    pattern = rf"(?iU)^(?:{any_of(prefixes)})\.?\s+"
    return lambda c: F.regexp_replace(c, pattern, "")


def remove_credentials(credentials: Collection[str] = DEFAULT_CREDENTIALS) -> ColumnTransform:
    """Credentials at the end go, each after a comma, with or without periods inside."""
    if not credentials:
        raise ValueError("credentials must not be empty")
    longest = sorted(credentials, key=lambda w: (-len(w), w))
    dotted = "|".join("".join(quoted(x) + r"\.?" for x in w) for w in longest)
    pattern = rf"(?iU)(?:\s*,\s*(?:{dotted}))+\z"
    return lambda c: F.regexp_replace(c, pattern, "")


def standardize_initials(c: Column) -> Column:
    """A single letter before periods or spaces becomes the letter, a period and a space."""
    return F.regexp_replace(c, INITIAL, "$1. ")
