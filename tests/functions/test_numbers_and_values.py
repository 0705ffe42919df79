import math

import pytest

import scrubwell as s
from tests.helpers import applied, check


def test_numbers(spark):
    check(spark, [s.accounting_parens_to_negative], {"(12.5)": "-12.5", " ( 7 ) ": "-7", "(": "(", "a(1)": "a(1)", "()": "()"})
    check(spark, [s.trailing_minus_to_prefix], {"500-": "-500", "5-": "5-", "-5-": "-5-", "500-\n": "500-\n"})
    check(spark, [s.remove_thousands_separators], {" 1,234 567 ": "1234567"})
    check(spark, [s.cast_to_float64], {"12": 12.0, "-.5": -0.5, "1e3": 1000.0, "1,2": None, "1d": None, "0x1p3": None, " 1": None, "": None, "1\n": None, "inf": math.inf})
    check(spark, [s.percent_to_fraction], {"15%": 0.15, "-50%": -0.5, "15": 15.0, "%": None, "": None, "x%": None, "5%%": None})


def test_number_recipes(spark):
    check(spark, s.NUMERIC_STRING_TO_FLOAT, {"($1,234.50)": -1234.5, "1,234.50-": -1234.5, "−12": -12.0, "１２": 12.0, "(-5)": None, "   ": None, "x": None})
    check(spark, s.NUMERIC_STRING_NORMALIZE, {"  ": "", "5‰": "5", "($1)": "-1"})
    check(spark, s.PERCENT_STRING_TO_FRACTION, {"1,250%": 12.5, " 50% ": 0.5, "−50%": -0.5, "50": 50.0} | {"(12%)": -0.12})


def test_sentinels(spark):
    f = s.nullify_sentinels(s.DEFAULT_MISSING_SENTINELS)
    check(spark, [f], {"N/A": None, " n/a ": None, "": None, "NABISCO": "NABISCO", " x ": " x ", "None": None, " NA": None})
    check(spark, [s.nullify_sentinels({" na "}, case_insensitive=False)], {"na": None, "NA": "NA"})
    with pytest.raises(ValueError):
        s.nullify_sentinels(set())


def test_padding(spark):
    check(spark, [s.pad_left(4)], {"7": "0007", "12345": "12345", "": "0000", "😀": "000😀"})
    check(spark, [s.pad_left(3, fill=" ")], {"a": "  a"})
    for bad in ({"width": 0}, {"width": 2, "fill": ""}, {"width": 2, "fill": "ab"}):
        with pytest.raises(ValueError):
            s.pad_left(**bad)


def test_splitting(spark):
    check(spark, [s.split_on_delimiters()], {"a,, b ,": ["a", None, "b", None], ",": [None, None], "": [None], "x|y/z;w-v": ["x", "y", "z", "w", "v"]})
    check(spark, [s.split_on_delimiters([","], dedup_delimiters=True)], {"a,,,b": ["a", "b"], ",a": [None, "a"]})
    for d in "]^\\&[-.|":
        check(spark, [s.split_on_delimiters([d, ","])], {f"a{d}b,c": ["a", "b", "c"]})
    check(spark, [s.split_on_delimiters([","])], {"a\x1fb,c": ["a\x1fb", "c"]})
    for bad in ([], ["ab"], [""]):
        with pytest.raises(ValueError):
            s.split_on_delimiters(bad)


def test_categories(spark):
    check(spark, [s.map_categories({"y": 1, "n": 0})], {"y": 1, "n": 0})
    assert applied(spark, [1, 2, 3, None], [s.map_categories({1: "Yes", 2: "No", None: "?"})], "long") == ["Yes", "No", "3", "?"]
    assert applied(spark, ["a", None], [s.map_categories({"a": "b"})]) == ["b", None]
    with pytest.raises(ValueError):
        s.map_categories({})
