"""US addresses."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from scrubwell.functions import tables
from scrubwell.functions.patterns import ZIP_LAST, any_of, group_or_null, let, replacement
from scrubwell.functions.text import strip_whitespace
from scrubwell.types import ColumnTransform

__all__ = """
extract_zip_code standardize_directionals standardize_state standardize_state_name
standardize_street_suffixes standardize_unit_markers strip_trailing_state
""".split()


def _state(c: Column, known: Mapping[str, str]) -> Column:
    lookup = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    return F.coalesce(F.element_at(lookup, F.translate(F.lower(strip_whitespace(c)), ".", "")), c)


def standardize_state(c: Column) -> Column:
    """Names, codes and short forms become the postal code; anything else stays."""
    return _state(c, tables.STATE_CODES)


def standardize_state_name(c: Column) -> Column:
    """Names, codes and short forms become the name in small letters; anything else stays."""
    return _state(c, tables.STATE_NAMES)


def strip_trailing_state(c: Column) -> Column:
    """No state code at the end, if a comma or space comes before it."""
    return F.regexp_replace(c, rf"(?iU)(?:\s+|,\s*)(?:{any_of(tables.TRAILING_CODES)})\z", "")


def _rule(variants: Sequence[str]) -> str:
    return rf"\b(?:{any_of(variants)})\b\.?"


def _standardizer(mapping: Mapping[str, Sequence[str]], what: str) -> ColumnTransform:
    """Each canonical's variants in turn, whole words in any case, with a period after them if there is one.

    By definition that is a chain of replacements. Where a value is ASCII and no period stands inside a
    word, words can't fuse, so the chain treats each by itself; then one scan with a look-up
    gives the same in a tenth of the time. Other values take the chain.
    """
    if not mapping:
        raise ValueError(f"{what} must not be empty")
    rules = [(f"(?iU){_rule(v)}", replacement(k)) for k, v in mapping.items()]

    def chain(c: Column) -> Column:
        for pattern, to in rules:
            c = F.regexp_replace(c, pattern, to)
        return c

    words = [w for v in mapping.values() for w in v]
    if not all(re.fullmatch(r"[A-Za-z0-9]+", w) for w in [*words, *mapping]):
        return chain
    local = [(re.compile(f"(?ai){_rule(v)}"), k) for k, v in mapping.items()]

    def outcome(word: str) -> str:
        for pattern, to in local:
            word = pattern.sub(to, word)
        return word

    table = {w.lower() + dot: outcome(w.lower() + dot) for w in [*words, *mapping] for dot in ("", ".")}
    tokens = r"\w+\.?|\W+"

    def each(c: Column) -> Column:
        lookup = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
        found = F.regexp_extract_all(c, F.lit(tokens), F.lit(0))
        # The set is hashed, a map is searched in turn: so most tokens never reach the map.
        one = lambda t: F.when(F.lower(t).isin(*table), F.element_at(lookup, F.lower(t))).otherwise(t)
        return F.when(c.rlike(r"[^\x00-\x7f]|\w\.\w"), chain(c)).otherwise(F.array_join(F.transform(found, one), ""))

    return lambda c: let(c, each)


def standardize_directionals(mapping: Mapping[str, Sequence[str]] = tables.DEFAULT_DIRECTIONAL_MAP) -> ColumnTransform:
    return _standardizer(mapping, "directionals")


def standardize_unit_markers(mapping: Mapping[str, Sequence[str]] = tables.DEFAULT_UNIT_MARKER_MAP) -> ColumnTransform:
    return _standardizer(mapping, "unit markers")


def standardize_street_suffixes(mapping: Mapping[str, Sequence[str]] = tables.DEFAULT_STREET_SUFFIX_MAP) -> ColumnTransform:
    return _standardizer(mapping, "street suffixes")


def extract_zip_code(c: Column) -> Column:
    """The five-digit ZIP at the end as a string, else null."""
    return group_or_null(c, ZIP_LAST)
