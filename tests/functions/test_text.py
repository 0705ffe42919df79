import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import scrubwell as s
from scrubwell.functions.tables import ASCII_STAND_INS
from tests.helpers import applied, check

NBSP, EM, THIN = " ", " ", " "


def test_white_space(spark):
    check(spark, [s.nullify_blank_strings], {"": None, " ": None, "\t\n": None, NBSP: None, " a ": " a ", "a\n": "a\n"})
    check(spark, [s.collapse_whitespace], {"  a \t b\n\nc ": " a b c ", f"a{NBSP}{EM}b": "a b", "": ""})
    check(spark, [s.strip_whitespace], {"  a  b ": "a  b", f"{NBSP}a{THIN}": "a", "\ta\n\n": "a", "": ""})
    check(spark, [s.replace_whitespace_with("")], {" a b\tc ": "abc"})
    check(spark, [s.replace_whitespace_with(r"$1\-")], {"a  b ": r"a$1\-b$1\-"})


def test_case(spark):
    check(spark, [s.to_lowercase], {"ÀB ẞ": "àb ß"})
    check(spark, [s.to_uppercase], {"straße é": "STRASSE É"})
    check(spark, [s.to_titlecase], {"2pac o'neil": "2Pac O'Neil", "1ST a-b": "1St A-B", "john.doe": "John.Doe", "éa ÉB": "Éa Éb", "": ""})
    check(spark, [s.to_snake_case], {" Hello \t World": "_hello_world", "A": "a"})


def test_unicode(spark):
    check(spark, [s.normalize_unicode_nfkc], {"１２": "12", "ﬂat": "flat", "™": "TM", "plain": "plain", "": "", "½": "1⁄2"})
    check(spark, [s.fold_to_ascii], {"“x”—‘y’": "\"x\"-'y'", "a…b": "a...b", "€5": "5", "$5": "5", "a​b\tc": "ab c", "‴≠": "'''!=", "é": "é"})
    check(spark, s.UNICODE_TO_ASCII, {"™®": "TM", "５‰": "5", "“Ａ”": '"A"'})


def test_every_stand_in(spark):
    assert len(ASCII_STAND_INS) == 146 and all(v.isascii() for v in ASCII_STAND_INS.values())
    assert not {c for v in ASCII_STAND_INS.values() for c in v} & set(ASCII_STAND_INS)
    check(spark, [s.fold_to_ascii], {f"<{k}>": f"<{v}>" for k, v in ASCII_STAND_INS.items()})


@given(st.lists(st.text(max_size=12), min_size=20, max_size=20))
@settings(max_examples=5, deadline=None)
def test_nfkc_is_pythons(spark, texts):
    assert applied(spark, texts, [s.normalize_unicode_nfkc]) == [unicodedata.normalize("NFKC", t) for t in texts]


def test_substitution(spark):
    check(spark, [s.replace_ampersand_with_and], {"A&B & C": "AandB and C"})
    check(spark, [s.remove_apostrophes], {"O'Neil's": "ONeils"})
    check(spark, [s.remove_periods], {"a.b..c": "abc"})
    check(spark, [s.periods_to_spaces], {"a..b": "a  b"})
    check(spark, [s.underscores_to_spaces], {"a__b_": "a  b "})
    check(spark, [s.separators_to_space], {"a._-b c": "a b c", "-": " "})


def test_replacements_are_one_pass(spark):
    check(spark, [s.apply_replacements({"a": "b"})], {"banana": "bbnbnb"})
    check(spark, [s.apply_replacements({"a": "b", "b": "a"})], {"abba": "baab", "": "", "x😀a": "x😀b"})
    check(spark, [s.apply_replacements({"na": "NA", "$.": "\\1"})], {"banana$.": "baNANA\\1"})
    check(spark, [s.apply_replacements({"abc": "1", "b": "2"})], {"abc": "a2c"})  # the key that ends first wins
    with pytest.raises(ValueError):
        s.apply_replacements({})


@given(st.dictionaries(st.text("ab.", min_size=1, max_size=3), st.text("xyab", max_size=2), min_size=2, max_size=4), st.lists(st.text("abc.", max_size=9), min_size=8, max_size=8))
@settings(max_examples=12, deadline=None)
def test_replacements_against_a_plain_scanner(spark, table, texts):
    def scan(t):
        out, at = "", 0
        while at < len(t):
            ends = sorted((i + len(k), i, k) for k in table for i in range(at, len(t)) if t.startswith(k, i))
            if not ends:
                break
            end, i, k = ends[0]
            out += t[at:i] + table[k]
            at = end
        return out + t[at:]

    assert applied(spark, texts, [s.apply_replacements(table)]) == [scan(t) for t in texts]
