import random

import pytest
from pyspark.sql import functions as F

import scrubwell as s
from scrubwell.functions import tables
from scrubwell.functions.patterns import any_of
from tests.helpers import applied, check


def test_names(spark):
    check(spark, [s.remove_jr_suffix], {"Al Roe, Jr.": "Al Roe", "Al Roe JR": "Al Roe", "Fajr": "Fa", "Jr. Roe": "Jr. Roe", "Roe jr\n": "Roe jr\n"})
    check(spark, [s.extract_email_local_part], {"a.b@c@d": "a.b", "none": "none", "@x": ""})
    check(spark, [s.extract_email_local_part_strict], {"a.b@c@d": "a.b", "none": None, "@x": None, "": None})
    check(spark, [s.strip_name_suffixes()], {"Al Roe III": "Al Roe", "Al Roe, Esq.": "Al Roe", "Hawaii": "Hawaii", "Henry V": "Henry V", "Roe JR, SR": "Roe JR"})
    check(spark, [s.strip_name_prefixes()], {"Dr. Al": "Al", "MISS Ann": "Ann", "Drake": "Drake", "Mr": "Mr", "St. John": "St. John", "Mr Dr Al": "Dr Al"})
    check(spark, [s.remove_credentials()], {"Al, MD, Ph.D.": "Al", "Al ,md": "Al", "Al MD": "Al MD", "Al, Boston": "Al, Boston", "MD": "MD"})
    check(spark, [s.standardize_initials], {"J.R.Roe": "J. R. Roe", "J R Roe": "J. R. Roe", "JR Roe": "JR Roe", "Roe J.": "Roe J. "})
    for factory in (s.strip_name_suffixes, s.strip_name_prefixes, s.remove_credentials):
        with pytest.raises(ValueError):
            factory([])


def test_name_recipes(spark):
    check(spark, s.PERSON_NAME_NORMALIZE, {" Dr. Al  Roe Jr, PhD": "Al Roe", "Roe, J.R.": "Roe, J. R.", "  ": None, "Al Roe MD": "Al Roe MD"})
    check(spark, s.EMAIL_TO_DISPLAY_NAME, {" al.b.roe@x.org ": "al b roe", "@x": "", "": "", "al..roe@x": "al roe"})
    check(spark, s.EMAIL_TO_TITLE_NAME, {"first.mid_LAST-jr@x": "First Mid Last Jr", "2pac@x": "2Pac", "none": None, "1st.class@x": "1St Class"})
    check(spark, s.SNAKE_CASE_TO_TITLE, {"unit_price_2nd": "Unit Price 2Nd"})


def test_states(spark):
    check(spark, [s.standardize_state], {" n.h. ": "NH", "W. Va.": "WV", "Penna": "PA", "Ontario": "Ontario", "dc": "DC", "U.S. Virgin Islands": "VI", "": ""})
    check(spark, [s.standardize_state_name], {"TX": "texas", "Calif.": "california", "D.C.": "district of columbia", "zz": "zz"})
    check(spark, [s.strip_trailing_state], {"Reno, NV": "Reno", "Reno nv": "Reno", "Reno,NV": "Reno", "Washington, DC": "Washington, DC", "NV": "NV", "log in": "log"})
    assert len(tables.STATE_CODES) == 149 and len(tables.TRAILING_CODES) == 55 and set(tables.STATE_CODES) == set(tables.STATE_NAMES)


def test_address_words(spark):
    check(spark, [s.standardize_directionals()], {"1 north Elm": "1 N Elm", "N.E. Elm": "NE Elm", "Northern": "Northern", "Neil's": "Neil'S", "south west": "S W"})
    check(spark, [s.standardize_unit_markers()], {"Apt. 4": "APT 4", "suite 2": "STE 2", "aptly": "aptly"})
    check(spark, [s.standardize_street_suffixes()], {"Elm Street.": "Elm ST", "Park Avenue": "Park AVE", "Broadway": "Broadway", "St.Rd. 5": "STRd. 5", "É Court": "É CT"})
    check(spark, [s.extract_zip_code], {"X 62704-1234, ": "62704", "02134": "02134", "1234567": None, "12345 Main": None, "": None})
    check(spark, s.STREET_ADDRESS_NORMALIZE, {"  12  south oak ave  Apartment 4": "12 S oak AVE APT 4", " ": None})
    for factory in (s.standardize_directionals, s.standardize_unit_markers, s.standardize_street_suffixes):
        with pytest.raises(ValueError):
            factory({})


@pytest.mark.parametrize("mapping", ["DEFAULT_DIRECTIONAL_MAP", "DEFAULT_UNIT_MARKER_MAP", "DEFAULT_STREET_SUFFIX_MAP"])
def test_one_scan_equals_the_chain(spark, mapping):
    mapping = getattr(tables, mapping)
    r = random.Random(1)
    words = [w for v in mapping.values() for w in v] + ["oak", "x1", "st_", "stra", "ſt"]
    texts = []
    for _ in range(1500):
        parts = [r.choice([str.lower, str.upper, str.title])(r.choice(words)) + r.choice(["", "", ".", "..", ",", "'s"]) for _ in range(r.randrange(1, 6))]
        texts.append(r.choice([" ", " ", "  ", "-", ""]).join(parts) + r.choice(["", " é"]))
    df = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    chain = F.col("x")
    for to, variants in mapping.items():
        chain = F.regexp_replace(chain, rf"(?iU)\b(?:{any_of(variants)})\b\.?", to)
    from scrubwell.functions.addresses import _standardizer

    bad = df.withColumns({"a": chain, "b": _standardizer(mapping, "m")(F.col("x"))}).filter("a <> b").collect()
    assert bad == []


def test_custom_maps_take_the_chain(spark):
    assert applied(spark, ["a b", "c"], [s.standardize_directionals({"X Y": ("a",), "Z$1": ("b",)})]) == ["X Y Z$1", "c"]
    assert applied(spark, ["one two"], [s.standardize_directionals({"two": ("one",), "three": ("two",)})]) == ["three three"]
