"""Registered queries over the driver tables, and the same in DuckDB SQL.

Inputs are dirtied by SQL that both engines read alike; the oracle's expressions are written for DuckDB on
their own and composed like the recipes.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import scrubwell as s
from scrubwell.functions import tables
from scrubwell.sources.tables import read_table

FLAGSHIP = "street_address_normalize"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# Inputs.


def _choice(key: str, *values: str | None) -> str:
    cases = " ".join(f"WHEN {i} THEN {'NULL' if v is None else chr(39) + v.replace(chr(39), chr(39) * 2) + chr(39)}" for i, v in enumerate(values))
    return f"CASE {key} % {len(values)} {cases} END"


_MONEY = "CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS STRING)"
INPUTS: dict[str, tuple[str, str, str]] = {
    "messy": (
        "part", "p_partkey",
        "CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN concat('  ', chr(9)) "
        "ELSE concat('  ', p_name, '   ', chr(9), p_brand, ' & O''Neil Co. ') END",
    ),
    "code": ("part", "p_partkey", "CASE WHEN p_partkey % 5 = 0 THEN ' ? ' WHEN p_partkey % 9 = 0 THEN 'n/a' ELSE concat(' ', lower(p_brand), ' ') END"),
    "snake": ("part", "p_partkey", "concat('2nd_', lower(p_type), '_x-y.', p_brand)"),
    "number": (
        "orders", "o_orderkey",
        f"CASE o_orderkey % 6 WHEN 0 THEN concat('($', {_MONEY}, ')') WHEN 1 THEN concat({_MONEY}, '-') "
        f"WHEN 2 THEN concat('  1,', {_MONEY}) WHEN 3 THEN 'abc' WHEN 4 THEN NULL ELSE {_MONEY} END",
    ),
    "plain_number": ("orders", "o_orderkey", f"CASE o_orderkey % 4 WHEN 0 THEN 'x1' WHEN 1 THEN NULL WHEN 2 THEN concat('-', {_MONEY}) ELSE {_MONEY} END"),
    "percent": ("orders", "o_orderkey", "CASE o_orderkey % 5 WHEN 0 THEN '%' WHEN 1 THEN NULL WHEN 2 THEN CAST(o_orderkey AS STRING) ELSE concat(CAST(o_orderkey % 100 AS STRING), '%') END"),
    "name": ("customer", "c_custkey", _choice("c_custkey", "Dr. John  Smith, M.D., PhD", "John Smith, Jr.", "J.R.Smith", "Hawaii", " Mrs. Ann Lee III ", None, "Drake, esq", "mr a b Fajr", "")),
    "email": ("customer", "c_custkey", _choice("c_custkey", " john.doe@example.com", "noatsign", "@x", "a_b-2c@h@s", "", None)),
    "state": ("customer", "c_custkey", _choice("c_custkey", " N.C. ", "w. va.", "Ontario", "texas", "U.S.V.I.", None, "Calif", "new  york")),
    "city": ("customer", "c_custkey", _choice("c_custkey", "Chicago, IL", "Washington, DC", "IL", "Reno nv", "log in", None, "Austin,TX", "Utah")),
    "address": (
        "supplier", "s_suppkey",
        "concat(CAST(s_suppkey AS STRING), ' ', " + _choice("s_suppkey", "N. Main Street", "north Oak Ave., Suite 5", "Broadway", "S.E. Park Avenue floor 2", "St.Rd. 5", "Elm  blvd apt 3B", "Lake View Ter. N.W.", "Neil's Ct") + ")",
    ),
    "zip": ("customer", "c_custkey", _choice("c_custkey", "Boston, MA 02134-5678", "Boston 02134. ", "021345", None, "12345 Main", "x 99999")),
    "list": ("customer", "c_custkey", _choice("c_custkey", "a,, b ,", ",a,", "a;b|c/d-e", "", None, "a, ,b")),
    "short": ("customer", "c_custkey", "CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE CAST(c_custkey * 37 AS STRING) END"),
    "signs": (
        "part", "p_partkey",
        "concat(p_name, '\u2014\u201cx\u201d\u2026\u20ac\u00a0\u200b\u2264\u00ae')",
    ),
}

# DuckDB expressions.


def _re(pattern: str, to: str) -> Callable[[str], str]:
    p, t = pattern.replace("'", "''"), to.replace("'", "''")
    return lambda x: f"regexp_replace({x}, '{p}', '{t}', 'g')"


def _blank(x: str) -> str:
    return f"CASE WHEN NOT regexp_matches({x}, '^\\s*$') THEN {x} END"


_collapse, _strip, _snake = _re(r"\s+", " "), _re(r"^\s+|\s+$", ""), lambda x: f"regexp_replace(lower({x}), '\\s+', '_', 'g')"


def _white(x: str) -> str:
    return _strip(_collapse(_blank(x)))


def _sub(old: str, new: str) -> Callable[[str], str]:
    o, n = (v.replace("'", "''") for v in (old, new))
    return lambda x: f"replace({x}, '{o}', '{n}')"


def _chain(*steps: Callable[[str], str]) -> Callable[[str], str]:
    def run(x: str) -> str:
        for f in steps:
            x = f"({f(x)})"
        return x

    return run


def _title(x: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all(lower({x}), '[a-z]+|[^a-z]+'), lambda w: upper(w[1]) || w[2:]), '')"


def _words(mapping: dict[str, tuple[str, ...]]) -> Callable[[str], str]:
    return _chain(*[_re(rf"(?i)\b(?:{'|'.join(sorted(v, key=len, reverse=True))})\b\.?", k) for k, v in mapping.items()])


def _null_in(*values: str) -> Callable[[str], str]:
    listed = ", ".join("'" + v + "'" for v in values)
    return lambda x: f"CASE WHEN upper({_strip(x)}) IN ({listed}) THEN NULL ELSE {x} END"


_parens, _minus, _grouping = _re(r"^\s*[(]\s*(.+?)\s*[)]\s*$", r"-\1"), _re(r"^([^-].+)-$", r"-\1"), _re(r"[,\s]", "")
_double = lambda x: f"CASE WHEN regexp_matches({x}, '^[+-]?[0-9.]+$') THEN TRY_CAST({x} AS DOUBLE) END"
_percent = lambda x: f"CASE WHEN {x} LIKE '%\\%' ESCAPE '\\' THEN ({_double(_re('%$', '')(x))}) / 100.0 ELSE {_double(x)} END"
_local = lambda x: f"split_part({x}, '@', 1)"
_local_strict = lambda x: f"nullif(regexp_extract({x}, '^([^@]+)@', 1), '')"
_suffixes = _re(r"(?i)[, ]+(?:" + "|".join(sorted(tables.DEFAULT_NAME_SUFFIXES, key=len, reverse=True)) + r")\.?$", "")
_prefixes = _re(r"(?i)^(?:" + "|".join(sorted(tables.DEFAULT_NAME_PREFIXES, key=len, reverse=True)) + r")\.?\s+", "")
_credentials = _re(
    r"(?i)(?:\s*[,]\s*(?:" + "|".join("".join(c + r"\.?" for c in w) for w in sorted(tables.DEFAULT_CREDENTIALS, key=len, reverse=True)) + r"))+$", ""
)
_initials = _re(r"(?i)\b([a-z])[\s.]+", r"\1. ")


def _lookup(mapping: dict[str, str]) -> Callable[[str], str]:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return lambda x: f"CASE replace(lower({_strip(x)}), '.', '') {cases} ELSE {x} END"


_fold = _chain(*[_sub(chr(c), v) for c, v in ((8212, "-"), (8220, '"'), (8221, '"'), (8230, "..."), (8364, ""), (160, " "), (8203, ""), (8804, "<="), (174, ""))], _sub("$", ""), _sub("\t", " "))
_nfkc = _chain(_sub(chr(8230), "..."), _sub(chr(160), " "))
_canonical = _chain(_blank, _fold, _collapse, _strip)
_normal = _chain(_canonical, _sub("&", "and"), _sub("'", ""), _sub(".", ""))
_name = _chain(_white, _credentials, _prefixes, _suffixes, _initials, _strip)
_address = _chain(_white, _words(tables.DEFAULT_DIRECTIONAL_MAP), _words(tables.DEFAULT_UNIT_MARKER_MAP), _words(tables.DEFAULT_STREET_SUFFIX_MAP))
_number = _chain(_fold, _parens, _minus, _grouping)
_same = lambda x: x


def _split(delimiters: str) -> Callable[[str], str]:
    return lambda x: f"list_transform(string_split_regex({x}, '{delimiters}'), lambda e: nullif(trim(e, ' '), ''))"




def _column(name: str, source: str, transforms, oracle: Callable[[str], str]) -> None:
    """One query: the transforms over an input, by the table's key."""
    table, key, sql = INPUTS[source]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        dirty = read_table(spark, sf_dir, table).select(F.col(key).alias("id"), F.expr(sql).cast("string").alias("x"))
        return dirty.select("id", s.compose_column("x", transforms, "value"))

    QUERIES[name] = query
    ORACLE_SQL[name] = f"SELECT id, {oracle('x')} AS value FROM (SELECT {key} AS id, {sql} AS x FROM {table})"


for _n, _source, _t, _d in [
    ("nullify_blank_strings", "messy", [s.nullify_blank_strings], _blank),
    ("collapse_whitespace", "messy", [s.collapse_whitespace], _collapse),
    ("strip_whitespace", "messy", [s.strip_whitespace], _strip),
    ("replace_whitespace_with", "messy", [s.replace_whitespace_with("$1")], _re(r"\s+", "$1")),
    ("to_lowercase", "messy", [s.to_lowercase], lambda x: f"lower({x})"),
    ("to_uppercase", "messy", [s.to_uppercase], lambda x: f"upper({x})"),
    ("to_titlecase", "snake", [s.to_titlecase], _title),
    ("to_snake_case", "messy", [s.to_snake_case], _snake),
    ("normalize_unicode_nfkc", "signs", [s.normalize_unicode_nfkc], _nfkc),
    ("fold_to_ascii", "signs", [s.fold_to_ascii], _fold),
    ("replace_ampersand_with_and", "messy", [s.replace_ampersand_with_and], _sub("&", "and")),
    ("remove_apostrophes", "messy", [s.remove_apostrophes], _sub("'", "")),
    ("remove_periods", "messy", [s.remove_periods], _sub(".", "")),
    ("periods_to_spaces", "messy", [s.periods_to_spaces], _sub(".", " ")),
    ("underscores_to_spaces", "snake", [s.underscores_to_spaces], _sub("_", " ")),
    ("separators_to_space", "snake", [s.separators_to_space], _re(r"[._-]+", " ")),
    ("apply_replacements", "messy", [s.apply_replacements({"&": "+", "a": "A"})], _chain(_sub("&", "+"), _sub("a", "A"))),
    ("accounting_parens_to_negative", "number", [s.accounting_parens_to_negative], _parens),
    ("trailing_minus_to_prefix", "number", [s.trailing_minus_to_prefix], _minus),
    ("remove_thousands_separators", "number", [s.remove_thousands_separators], _grouping),
    ("cast_to_float64", "plain_number", [s.cast_to_float64], _double),
    ("percent_to_fraction", "percent", [s.percent_to_fraction], _percent),
    ("nullify_sentinels", "code", [s.nullify_sentinels(s.DEFAULT_MISSING_SENTINELS | {"?"})], _null_in("?", "", "N/A", "NA", "NAN", "NULL", "NONE")),
    ("pad_left", "short", [s.pad_left(5)], lambda x: f"CASE WHEN length({x}) >= 5 THEN {x} ELSE lpad({x}, 5, '0') END"),
    ("split_on_delimiters", "list", [s.split_on_delimiters()], _split("[,;|/-]")),
    ("remove_jr_suffix", "name", [s.remove_jr_suffix], _re(r"(?i)[, ]*jr[.]?$", "")),
    ("extract_email_local_part", "email", [s.extract_email_local_part], _local),
    ("extract_email_local_part_strict", "email", [s.extract_email_local_part_strict], _local_strict),
    ("strip_name_suffixes", "name", [s.strip_name_suffixes()], _suffixes),
    ("strip_name_prefixes", "name", [s.strip_name_prefixes()], _prefixes),
    ("remove_credentials", "name", [s.remove_credentials()], _credentials),
    ("standardize_initials", "name", [s.standardize_initials], _initials),
    ("standardize_state", "state", [s.standardize_state], _lookup(tables.STATE_CODES)),
    ("standardize_state_name", "state", [s.standardize_state_name], _lookup(tables.STATE_NAMES)),
    ("strip_trailing_state", "city", [s.strip_trailing_state], _re(r"(?i)(?:\s+|,\s*)(?:" + "|".join(tables.TRAILING_CODES) + ")$", "")),
    ("standardize_directionals", "address", [s.standardize_directionals()], _words(tables.DEFAULT_DIRECTIONAL_MAP)),
    ("standardize_unit_markers", "address", [s.standardize_unit_markers()], _words(tables.DEFAULT_UNIT_MARKER_MAP)),
    ("standardize_street_suffixes", "address", [s.standardize_street_suffixes()], _words(tables.DEFAULT_STREET_SUFFIX_MAP)),
    ("extract_zip_code", "zip", [s.extract_zip_code], lambda x: f"nullif(regexp_extract({x}, '\\b(\\d{{5}})(?:|-\\d{{4}})[\\s,.]*$', 1), '')"),
    ("whitespace_canonicalize", "messy", s.WHITESPACE_CANONICALIZE, _white),  # noqa: F405
    ("unicode_to_ascii", "signs", s.UNICODE_TO_ASCII, _fold),
    ("text_canonicalize", "messy", s.TEXT_CANONICALIZE, _canonical),
    ("text_normalize", "messy", s.TEXT_NORMALIZE, _normal),
    ("text_normalize_to_snake_case", "messy", s.TEXT_NORMALIZE_TO_SNAKE_CASE, _chain(_normal, _snake)),
    ("category_canonicalize", "messy", s.CATEGORY_CANONICALIZE, _chain(_white, lambda x: f"lower({x})")),
    ("category_canonicalize_to_snake_case", "messy", s.CATEGORY_CANONICALIZE_TO_SNAKE_CASE, _chain(_white, _snake)),
    ("street_address_normalize", "address", s.STREET_ADDRESS_NORMALIZE, _address),
    ("street_address_normalize_to_snake_case", "address", s.STREET_ADDRESS_NORMALIZE_TO_SNAKE_CASE, _chain(_address, _snake)),
    ("person_name_normalize", "name", s.PERSON_NAME_NORMALIZE, _name),
    ("person_name_normalize_to_snake_case", "name", s.PERSON_NAME_NORMALIZE_TO_SNAKE_CASE, _chain(_name, _snake)),
    ("uppercase_code_normalize", "code", s.UPPERCASE_CODE_NORMALIZE, _chain(_white, lambda x: f"upper({x})", _null_in("?"))),
    ("numeric_string_normalize", "number", s.NUMERIC_STRING_NORMALIZE, _number),
    ("numeric_string_to_float", "number", s.NUMERIC_STRING_TO_FLOAT, _chain(_number, _double)),
    ("percent_string_to_fraction", "percent", s.PERCENT_STRING_TO_FRACTION, _chain(_number, _percent)),
    ("email_to_display_name", "email", s.EMAIL_TO_DISPLAY_NAME, _chain(_strip, _local, _sub(".", " "), _collapse)),
    ("email_to_title_name", "email", s.EMAIL_TO_TITLE_NAME, _chain(_local_strict, _re(r"[._-]+", " "), _title)),
    ("snake_case_to_title", "snake", s.SNAKE_CASE_TO_TITLE, _chain(_sub("_", " "), _title)),
]:
    _column(_n, _source, _t, _d)


def _recipe(name: str, table: str, key: str, sql: str, transforms, oracle: str) -> None:
    """The frame path: figures come from the whole column. ``oracle`` may use ``x`` and windows over all rows."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = read_table(spark, sf_dir, table).select(F.col(key).alias("id"), F.expr(sql).alias("x"))
        return s.apply_recipe(rows, "x", transforms, "value").select("id", "value")

    QUERIES[name] = query
    ORACLE_SQL[name] = f"SELECT id, {oracle} AS value FROM (SELECT {key} AS id, {sql} AS x FROM {table})"


_Q = lambda p: f"quantile_cont(x, {p}) OVER ()"
_BALANCE = "CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_acctbal END"
for _args in [
    ("map_categories", "customer", "c_custkey", "c_mktsegment", [s.map_categories({"BUILDING": 1, "MACHINERY": 2, "AUTOMOBILE": 3, "FURNITURE": 4, "HOUSEHOLD": 5})],
     "CASE x WHEN 'BUILDING' THEN 1::BIGINT WHEN 'MACHINERY' THEN 2 WHEN 'AUTOMOBILE' THEN 3 WHEN 'FURNITURE' THEN 4 WHEN 'HOUSEHOLD' THEN 5 END"),
    ("clip_numeric", "customer", "c_custkey", _BALANCE, [s.clip_numeric(0.0, 5000.0)], "CASE WHEN x < 0 THEN 0.0 WHEN x > 5000 THEN 5000.0 ELSE x END"),
    ("winsorize_numeric", "customer", "c_custkey", _BALANCE, [s.winsorize_numeric(), lambda c: F.round(c, 6)],
     f"round(CASE WHEN x < {_Q(0.05)} THEN {_Q(0.05)} WHEN x > {_Q(0.95)} THEN {_Q(0.95)} ELSE x END, 6)"),
    ("clip_numeric_whole", "orders", "o_orderkey", "CAST(floor(o_totalprice) AS BIGINT)", [s.clip_numeric(0.0, 150000.5)],
     "CASE WHEN x > 150000.5 THEN 150000 ELSE x END"),
    ("winsorize_numeric_whole", "orders", "o_orderkey", "o_custkey", [s.winsorize_numeric()],
     f"CASE WHEN x < {_Q(0.05)} THEN trunc({_Q(0.05)})::BIGINT WHEN x > {_Q(0.95)} THEN trunc({_Q(0.95)})::BIGINT ELSE x END"),
    ("flag_zscore_outliers", "customer", "c_custkey", _BALANCE, [s.flag_zscore_outliers(1.5)], "abs((x - avg(x) OVER ()) / stddev_samp(x) OVER ()) > 1.5"),
    ("flag_iqr_outliers", "events", "event_id", "value", [s.flag_iqr_outliers()],
     f"x < {_Q(0.25)} - 1.5 * ({_Q(0.75)} - {_Q(0.25)}) OR x > {_Q(0.75)} + 1.5 * ({_Q(0.75)} - {_Q(0.25)})"),
    ("collapse_rare_by_count", "part", "p_partkey", "CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_type END", [s.collapse_rare_by_count(12)],
     "CASE WHEN x IS NOT NULL AND count(x) OVER (PARTITION BY x) < 12 THEN 'other' ELSE x END"),
    ("normalize_epoch_timestamps", "events", "event_id", "event_id * 86461", [s.normalize_epoch_timestamps("s")], "make_timestamp(x * 1000000)"),
    ("normalize_excel_serial_dates", "orders", "o_orderkey", "40000 + (o_orderkey % 5000) + 0.5", [s.normalize_excel_serial_dates],
     "TIMESTAMP '1899-12-30' + to_microseconds((x * 86400000000)::BIGINT)"),
    ("flag_dates_outside_range", "orders", "o_orderkey", "o_orderdate", [s.flag_dates_outside_range(datetime(1994, 1, 1), datetime(1996, 6, 30))],
     "x < TIMESTAMP '1994-01-01' OR x > TIMESTAMP '1996-06-30'"),
]:
    _recipe(*_args)


def _frame(name: str, sql: str):
    """Register a query on frames with its SQL."""

    def take(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        ORACLE_SQL[name] = sql
        return f

    return take


@_frame(
    "flag_mad_outliers",
    "WITH m AS (SELECT median(value) AS m FROM events), d AS (SELECT median(abs(value - m)) AS d FROM events, m) "
    "SELECT event_id AS id, CASE WHEN d = 0 THEN value <> m ELSE abs(0.6745 * (value - m) / d) > 2 END AS value FROM events, m, d",
)
def _mad(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "value")
    return s.apply_recipe(rows, "value", [s.flag_mad_outliers(2.0)])


@_frame(
    "collapse_keep_top_n",
    "WITH c AS (SELECT p_type, dense_rank() OVER (ORDER BY count(*) DESC) AS r FROM part GROUP BY p_type) "
    "SELECT p_partkey AS id, CASE WHEN r > 3 THEN 'other' ELSE p_type END AS value FROM part JOIN c USING (p_type)",
)
def _top(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("value"))
    return s.apply_recipe(rows, "value", [s.collapse_keep_top_n(3)])


for _unit, _trunc, _step in [("1d", "day", "1 DAY"), ("1w", "week", "7 DAY"), ("1mo", "month", "1 MONTH"), ("1q", "quarter", "3 MONTH"), ("1y", "year", "1 YEAR")]:

    def _period(spark: SparkSession, sf_dir: str, unit: str = _unit) -> DataFrame:
        rows = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
        return rows.filter(s.within_complete_period(rows, "o_orderdate", unit, 5 if unit != "1d" else -2)).select("o_orderkey")

    QUERIES[f"within_complete_period_{_unit}"] = _period
    ORACLE_SQL[f"within_complete_period_{_unit}"] = (
        f"WITH m AS (SELECT max(o_orderdate) AS m FROM orders) SELECT o_orderkey FROM orders, m WHERE CASE WHEN "
        f"date_sub('day', m, date_trunc('{_trunc}', m)::TIMESTAMP + INTERVAL {_step} - INTERVAL 1 DAY) > {5 if _unit != '1d' else -2} "
        f"THEN date_trunc('{_trunc}', o_orderdate) <> date_trunc('{_trunc}', m) ELSE true END"
    )


@_frame(
    "within_complete_month",
    "WITH m AS (SELECT max(o_orderdate) AS m FROM orders) SELECT o_orderkey FROM orders, m WHERE CASE WHEN date_sub('day', m, "
    "date_trunc('month', m)::TIMESTAMP + INTERVAL 1 MONTH - INTERVAL 1 DAY) > 5 THEN date_trunc('month', o_orderdate) <> date_trunc('month', m) ELSE true END",
)
def _month(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return rows.filter(s.within_complete_month(rows, "o_orderdate")).select("o_orderkey")


@_frame("combine_columns", "SELECT c_custkey AS id, concat_ws(' ', CASE WHEN c_custkey % 3 <> 0 THEN c_name END, c_mktsegment) AS value FROM customer")
def _combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS a", "c_mktsegment AS b")
    return rows.select("id", s.combine_columns(["a", "b"], "value"))


@_frame("coalesce_blank_columns", "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE c_name END AS value FROM customer")
def _coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "CASE WHEN c_custkey % 3 = 0 THEN '  ' ELSE c_name END AS a", "c_mktsegment AS b")
    return rows.select("id", s.coalesce_blank_columns(["a", "b"], "value"))


_SWAPPED = """SELECT CASE WHEN p_partkey % 5 <> 0 THEN p_brand END AS a, CASE WHEN p_partkey % 7 <> 0 THEN p_type END AS b FROM part
UNION ALL SELECT CASE WHEN p_partkey % 7 <> 0 THEN p_type END, CASE WHEN p_partkey % 5 <> 0 THEN p_brand END FROM part"""


@_frame("hash_key", f"SELECT count(*) AS n_keys, count(*) AS n_tuples FROM (SELECT DISTINCT a, b FROM ({_SWAPPED}))")
def _hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key values differ between engines, so what is compared is how they divide the rows: nulls and swapped positions too."""
    part = read_table(spark, sf_dir, "part")
    brand, kind = F.when(F.col("p_partkey") % 5 != 0, F.col("p_brand")), F.when(F.col("p_partkey") % 7 != 0, F.col("p_type"))
    rows = part.select(brand.alias("a"), kind.alias("b")).unionAll(part.select(kind.alias("a"), brand.alias("b")))
    keyed = rows.select("a", "b", s.hash_key(["a", "b"], "key")).distinct()
    return keyed.agg(F.countDistinct("key").alias("n_keys"), F.count("*").alias("n_tuples"))


_EVENTS = "SELECT user_id, event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS kind, CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END AS amount FROM events"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").selectExpr(
        "user_id", "event_id", "CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS kind", "CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END AS amount"
    )


@_frame(
    "first_non_null_per_group",
    f"SELECT user_id, min(event_id) AS event_id, arg_min(kind, event_id) FILTER (kind IS NOT NULL) AS kind, "
    f"arg_min(amount, event_id) FILTER (amount IS NOT NULL) AS amount FROM ({_EVENTS}) GROUP BY user_id",
)
def _first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.first_non_null_per_group(_events(spark, sf_dir), ["user_id"], order_by="event_id")


def _mode_sql(column: str) -> str:
    return f"""SELECT user_id, {column} FROM (SELECT user_id, {column}, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, min(event_id)) AS r
FROM ({_EVENTS}) WHERE {column} IS NOT NULL GROUP BY user_id, {column}) WHERE r = 1"""


_MODE = _mode_sql("kind")


@_frame(
    "mode_then_first_per_group",
    f"SELECT u.user_id, m.kind, a.amount, e.event_id FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN ({_MODE}) m USING (user_id) "
    f"LEFT JOIN ({_mode_sql('amount')}) a USING (user_id) JOIN (SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id) e USING (user_id)",
)
def _modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.mode_then_first_per_group(_events(spark, sf_dir), ["user_id"], order_by="event_id")


@_frame("fill_null_string_by_group", f"SELECT e.event_id, coalesce(e.kind, m.kind) AS kind FROM ({_EVENTS}) e LEFT JOIN ({_MODE}) m USING (user_id)")
def _fill_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.fill_null_string_by_group(_events(spark, sf_dir), "kind", ["user_id"], order_by="event_id").select("event_id", "kind")


_SKEW = f"(SELECT avg(power((amount - m) / d, 3)) FROM ({_EVENTS}), (SELECT avg(amount) AS m, stddev_pop(amount) AS d FROM ({_EVENTS})))"
for _strategy, _center in [
    ("mean", "avg(amount) OVER (PARTITION BY user_id)"),
    ("median", "median(amount) OVER (PARTITION BY user_id)"),
    ("auto", f"CASE WHEN abs({_SKEW}) >= 1 THEN median(amount) OVER (PARTITION BY user_id) ELSE avg(amount) OVER (PARTITION BY user_id) END"),
]:

    def _fill(spark: SparkSession, sf_dir: str, strategy: str = _strategy) -> DataFrame:
        done = s.fill_null_numeric_by_group(_events(spark, sf_dir), "amount", ["user_id"], strategy=strategy)
        return done.select("event_id", F.round("amount", 6).alias("amount"))

    QUERIES[f"fill_null_numeric_by_group_{_strategy}"] = _fill
    ORACLE_SQL[f"fill_null_numeric_by_group_{_strategy}"] = f"SELECT event_id, round(coalesce(amount, {_center}), 6) AS amount FROM ({_EVENTS})"


def _counted(guard: Callable[[], None]) -> int:
    """How many violations a guard reports."""
    try:
        guard()
    except ValueError as error:
        return int(re.search(r"(\d+) (?:null )?value", str(error)).group(1))
    return 0


@_frame("assert_no_nulls", "SELECT 'clean' AS input, 0::BIGINT AS n_nulls UNION ALL SELECT 'dirty', count(*) FROM customer WHERE c_custkey % 10 = 0")
def _no_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "customer").withColumn("dirty", F.when(F.col("c_custkey") % 10 != 0, F.col("c_name")))
    found = [(name, _counted(lambda c=column: s.assert_no_nulls(rows, c))) for name, column in (("clean", "c_name"), ("dirty", "dirty"))]
    return spark.createDataFrame(found, "input string, n_nulls long")


@_frame(
    "assert_string_length",
    "SELECT 'loose' AS input, 0::BIGINT AS n_violations UNION ALL SELECT 'tight', count(*) FROM part WHERE NOT coalesce(length(p_name) BETWEEN 5 AND 18, false)",
)
def _lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "part")
    bounds = (("loose", 1, None), ("tight", 5, 18))
    found = [(name, _counted(lambda a=low, b=high: s.assert_string_length(rows, "p_name", min_length=a, max_length=b))) for name, low, high in bounds]
    return spark.createDataFrame(found, "input string, n_violations long")


@_frame("normalize_column_names", "SELECT r_regionkey AS region_key, r_name AS region_name FROM region")
def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name").toDF(" Region  Key", "REGION\tname ")
    return s.normalize_column_names(rows)


@_frame("canonicalize_vin", "SELECT o_orderkey AS id, lpad(CAST(o_orderkey AS VARCHAR), 17, '0') AS vin FROM orders")
def _vin(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").cast("string").alias("vin"))
    return s.canonicalize_vin(rows, "vin")
