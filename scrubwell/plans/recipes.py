"""Named tuples of transforms; a longer recipe splices a shorter one."""

from scrubwell.functions import addresses, names, numbers, text, values
from scrubwell.functions.tables import DEFAULT_PLACEHOLDER_SENTINELS

WHITESPACE_CANONICALIZE = (text.nullify_blank_strings, text.collapse_whitespace, text.strip_whitespace)
UNICODE_TO_ASCII = (text.normalize_unicode_nfkc, text.fold_to_ascii)
TEXT_CANONICALIZE = (text.nullify_blank_strings, *UNICODE_TO_ASCII, text.collapse_whitespace, text.strip_whitespace)
TEXT_NORMALIZE = (*TEXT_CANONICALIZE, text.replace_ampersand_with_and, text.remove_apostrophes, text.remove_periods)
TEXT_NORMALIZE_TO_SNAKE_CASE = (*TEXT_NORMALIZE, text.to_snake_case)
CATEGORY_CANONICALIZE = (*WHITESPACE_CANONICALIZE, text.to_lowercase)
CATEGORY_CANONICALIZE_TO_SNAKE_CASE = (*CATEGORY_CANONICALIZE, text.to_snake_case)
STREET_ADDRESS_NORMALIZE = (
    *WHITESPACE_CANONICALIZE,
    addresses.standardize_directionals(),
    addresses.standardize_unit_markers(),
    addresses.standardize_street_suffixes(),
)
STREET_ADDRESS_NORMALIZE_TO_SNAKE_CASE = (*STREET_ADDRESS_NORMALIZE, text.to_snake_case)
PERSON_NAME_NORMALIZE = (
    *WHITESPACE_CANONICALIZE,
    names.remove_credentials(),
    names.strip_name_prefixes(),
    names.strip_name_suffixes(),
    names.standardize_initials,
    text.strip_whitespace,
)
PERSON_NAME_NORMALIZE_TO_SNAKE_CASE = (*PERSON_NAME_NORMALIZE, text.to_snake_case)
UPPERCASE_CODE_NORMALIZE = (
    text.normalize_unicode_nfkc,
    *WHITESPACE_CANONICALIZE,
    text.to_uppercase,
    values.nullify_sentinels(DEFAULT_PLACEHOLDER_SENTINELS),
)
NUMERIC_STRING_NORMALIZE = (
    *UNICODE_TO_ASCII,
    numbers.accounting_parens_to_negative,
    numbers.trailing_minus_to_prefix,
    numbers.remove_thousands_separators,
)
NUMERIC_STRING_TO_FLOAT = (*NUMERIC_STRING_NORMALIZE, numbers.cast_to_float64)
PERCENT_STRING_TO_FRACTION = (*NUMERIC_STRING_NORMALIZE, numbers.percent_to_fraction)
EMAIL_TO_DISPLAY_NAME = (text.strip_whitespace, names.extract_email_local_part, text.periods_to_spaces, text.collapse_whitespace)
EMAIL_TO_TITLE_NAME = (names.extract_email_local_part_strict, text.separators_to_space, text.to_titlecase)
SNAKE_CASE_TO_TITLE = (text.underscores_to_spaces, text.to_titlecase)

ALL = {k: v for k, v in dict(globals()).items() if k.isupper() and isinstance(v, tuple)}
__all__ = list(ALL)
