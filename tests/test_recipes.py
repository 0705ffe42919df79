import scrubwell as s
from tests.helpers import check


def test_there_are_eighteen():
    assert len(s.RECIPES) == 18 and all(isinstance(r, tuple) and all(map(callable, r)) for r in s.RECIPES.values())
    assert all(getattr(s, name) is recipe for name, recipe in s.RECIPES.items())


def test_splices():
    for short, long in (("TEXT_NORMALIZE", "TEXT_NORMALIZE_TO_SNAKE_CASE"), ("CATEGORY_CANONICALIZE", "CATEGORY_CANONICALIZE_TO_SNAKE_CASE"),
                        ("STREET_ADDRESS_NORMALIZE", "STREET_ADDRESS_NORMALIZE_TO_SNAKE_CASE"), ("PERSON_NAME_NORMALIZE", "PERSON_NAME_NORMALIZE_TO_SNAKE_CASE"),
                        ("NUMERIC_STRING_NORMALIZE", "NUMERIC_STRING_TO_FLOAT")):
        assert s.RECIPES[long][:-1] == s.RECIPES[short]


def test_text(spark):
    check(spark, s.WHITESPACE_CANONICALIZE, {"  a \n b ": "a b", "\t": None})
    check(spark, s.TEXT_CANONICALIZE, {" “Ａcme”  ™ ": '"Acme" TM', "®": "", "​": "", " ": None})
    check(spark, s.TEXT_NORMALIZE, {" O’Neil & Co. ": "ONeil and Co"})
    check(spark, s.TEXT_NORMALIZE_TO_SNAKE_CASE, {" O’Neil & Co. ": "oneil_and_co"})
    check(spark, s.CATEGORY_CANONICALIZE_TO_SNAKE_CASE, {" Mid  West ": "mid_west", " ": None})
    check(spark, s.UPPERCASE_CODE_NORMALIZE, {" ab  ｃ１ ": "AB C1", " ? ": None, "": None, "??": "??"})


def test_public_names():
    expected = """accounting_parens_to_negative apply_replacements cast_to_float64 clip_numeric collapse_keep_top_n collapse_rare_by_count
    collapse_whitespace extract_email_local_part extract_email_local_part_strict extract_zip_code flag_dates_outside_range flag_iqr_outliers
    flag_mad_outliers flag_zscore_outliers fold_to_ascii map_categories normalize_epoch_timestamps normalize_excel_serial_dates
    normalize_unicode_nfkc nullify_blank_strings nullify_sentinels pad_left percent_to_fraction periods_to_spaces remove_apostrophes
    remove_credentials remove_jr_suffix remove_periods remove_thousands_separators replace_ampersand_with_and replace_whitespace_with
    separators_to_space split_on_delimiters standardize_directionals standardize_initials standardize_state standardize_state_name
    standardize_street_suffixes standardize_unit_markers strip_name_prefixes strip_name_suffixes strip_trailing_state strip_whitespace
    to_lowercase to_snake_case to_titlecase to_uppercase trailing_minus_to_prefix underscores_to_spaces winsorize_numeric
    within_complete_period within_complete_month combine_columns coalesce_blank_columns hash_key first_non_null_per_group
    mode_then_first_per_group fill_null_numeric_by_group fill_null_string_by_group assert_no_nulls assert_string_length
    normalize_column_names canonicalize_vin compose_column""".split()
    assert len(expected) == 64 and all(callable(getattr(s, n)) for n in expected)
