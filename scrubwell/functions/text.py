"""White space, case, Unicode and substitution."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from scrubwell.functions.patterns import BLANK, RIM, SPACES, any_of, replacement
from scrubwell.functions.tables import ASCII_STAND_INS
from scrubwell.types import ColumnTransform

__all__ = """
apply_replacements collapse_whitespace fold_to_ascii normalize_unicode_nfkc nullify_blank_strings
periods_to_spaces remove_apostrophes remove_periods replace_ampersand_with_and
replace_whitespace_with separators_to_space strip_whitespace to_lowercase to_snake_case to_titlecase
to_uppercase underscores_to_spaces
""".split()


def nullify_blank_strings(c: Column) -> Column:
    """Null for empty and blank strings."""
    return F.when(~c.rlike(BLANK), c)


def collapse_whitespace(c: Column) -> Column:
    """Each run of white space becomes one space; the ends stay."""
    return F.regexp_replace(c, SPACES, " ")


def strip_whitespace(c: Column) -> Column:
    """No white space at the ends, Unicode spaces included (``trim`` knows the plain space alone)."""
    return F.regexp_replace(c, RIM, "")


def replace_whitespace_with(separator: str) -> ColumnTransform:
    """Each run of white space, at the ends too, becomes ``separator``."""
    to = replacement(separator)
    return lambda c: F.regexp_replace(c, SPACES, to)


def to_lowercase(c: Column) -> Column:
    return F.lower(c)


def to_uppercase(c: Column) -> Column:
    return F.upper(c)


def to_titlecase(c: Column) -> Column:
    """Each run of letters gets a capital first and small letters after; ``initcap`` would leave ``2pac``."""
    parts = F.split(F.lower(c), r"(?<=\P{IsAlphabetic})(?=\p{IsAlphabetic})")
    return F.array_join(F.transform(parts, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 2**31 - 1))), "")


def to_snake_case(c: Column) -> Column:
    """Small letters, white space to underscores; nothing is stripped."""
    return F.regexp_replace(F.lower(c), SPACES, "_")


@F.pandas_udf(StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: v if v is None else unicodedata.normalize("NFKC", v))


def normalize_unicode_nfkc(c: Column) -> Column:
    """NFKC; Spark has no such function, so values go through an Arrow UDF, ASCII ones as nulls, which stay as they are."""
    return F.coalesce(_nfkc(F.when(~c.rlike(r"^[\x00-\x7f]*\z"), c)), c)


_LONG = {k: v for k, v in ASCII_STAND_INS.items() if len(v) > 1}
_SHORT = {k: v for k, v in ASCII_STAND_INS.items() if len(v) == 1}
_GONE = [k for k, v in ASCII_STAND_INS.items() if not v]


def fold_to_ascii(c: Column) -> Column:
    """Dashes, quotes, spaces and the like become ASCII; invisible, currency and legal signs go.

    One ``translate`` for the one-to-one part; what becomes several signs is replaced before. No stand-in
    is a key itself, so the order makes no difference.
    """
    for k, v in _LONG.items():
        c = F.replace(c, F.lit(k), F.lit(v))
    return F.translate(c, "".join([*_SHORT, *_GONE]), "".join(_SHORT.values()))


def replace_ampersand_with_and(c: Column) -> Column:
    return F.replace(c, F.lit("&"), F.lit("and"))


def remove_apostrophes(c: Column) -> Column:
    return F.translate(c, "'", "")


def remove_periods(c: Column) -> Column:
    return F.translate(c, ".", "")


def periods_to_spaces(c: Column) -> Column:
    return F.translate(c, ".", " ")


def underscores_to_spaces(c: Column) -> Column:
    return F.translate(c, "_", " ")


def separators_to_space(c: Column) -> Column:
    """Each run of ``.``, ``_`` and ``-`` becomes one space."""
    return F.regexp_replace(c, r"[._-]+", " ")


def apply_replacements(replacements: Mapping[str, str]) -> ColumnTransform:
    """Literal substrings replaced in one pass; what comes out isn't looked at again.

    Of keys that overlap in a text, the one that ends first wins; so a key that holds another one before
    its last sign can never match and is dropped, after which leftmost matching is the same.
    """
    if not replacements:
        raise ValueError("replacements must not be empty")
    table = {k: v for k, v in replacements.items() if not any(o in k[:-1] for o in replacements if o)}
    if len(table) == 1:
        ((old, new),) = table.items()
        return lambda c: F.replace(c, F.lit(old), F.lit(new))
    pattern = f"{any_of(table)}|[\\s\\S]"

    def transform(c: Column) -> Column:
        lookup = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
        tokens = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
        return F.array_join(F.transform(tokens, lambda t: F.coalesce(F.element_at(lookup, t), t)), "")

    return transform
