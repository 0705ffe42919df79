import random
import statistics
from datetime import date, datetime

import pytest

import scrubwell as s
from tests.helpers import column


def dates(spark, values, kind="date"):
    return spark.createDataFrame(list(enumerate(values)), f"i int, d {kind}")


def kept(df, mask):
    return [r.i for r in df.filter(mask).orderBy("i").collect()]


def test_complete_periods(spark):
    df = dates(spark, [date(2024, 1, 31), date(2024, 2, 20), date(2024, 2, 1), None])
    assert kept(df, s.within_complete_month(df, "d")) == [0]
    full = dates(spark, [date(2024, 1, 31), date(2024, 2, 25)])
    assert kept(full, s.within_complete_month(full, "d")) == [0, 1]  # four days to come
    strict = dates(spark, [date(2024, 1, 1), date(2024, 2, 24)])
    assert kept(strict, s.within_complete_month(strict, "d")) == [0, 1]  # exactly five is not more
    for period, last in (("1w", date(2024, 5, 7)), ("1q", date(2024, 5, 7)), ("1y", date(2024, 5, 7))):
        df = dates(spark, [date(2023, 12, 1), last])
        assert kept(df, s.within_complete_period(df, "d", period, 2)) == [0]
    df = dates(spark, [datetime(2024, 1, 15, 13), datetime(2024, 1, 31, 1)], "timestamp_ntz")
    assert kept(df, s.within_complete_period(df, "d", "1mo", 0)) == [0, 1]  # part of a day counts for nothing
    assert kept(df, s.within_complete_period(df, "d", "1d", -1)) == [0]
    nothing = dates(spark, [None, None])
    assert kept(nothing, s.within_complete_month(nothing, "d")) == [0, 1]
    both = dates(spark, [date(2024, 1, 31), date(2024, 2, 20)])
    assert kept(both, s.within_complete_month(both, "d") & (both.i >= 0)) == [0]


def test_combine(spark):
    df = spark.createDataFrame([("a", 1, "x"), (None, 2, "y"), ("  ", None, None), (None, None, None)], "p string, q long, r string")
    assert [r.o for r in df.select(s.combine_columns(["p", "q"], "o", "-")).collect()] == ["a-1", "2", "  ", ""]
    assert [r.o for r in df.select(s.coalesce_blank_columns(["p", "r"], "o")).collect()] == ["a", "y", None, None]
    for f in (s.combine_columns, s.coalesce_blank_columns, s.hash_key):
        with pytest.raises(ValueError):
            f([], "o")


def test_hash_key(spark):
    rows = [("a", None), (None, "a"), ("a", "b"), ("b", "a"), (None, None), ("ab", ""), ("a", None)]
    df = spark.createDataFrame(rows, "p string, q string").coalesce(1)
    keys = [r.k for r in df.select(s.hash_key(["p", "q"], "k")).collect()]
    assert len(set(keys)) == len(set(rows)) and keys[0] == keys[-1]
    assert dict(df.select(s.hash_key(["p"], "k")).dtypes)["k"] == "bigint"


GROUPS = [(0, 1, "x", None), (1, 1, None, "b"), (2, 1, "y", "a"), (3, 1, "y", "a"), (4, 1, "x", "b"), (5, None, None, "n"), (6, None, "z", None), (7, 2, None, None)]


def grouped(spark):
    return spark.createDataFrame(GROUPS, "o int, g int, p string, q string").repartition(3)


def test_first_and_mode(spark):
    first = {r.g: (r.p, r.q) for r in s.first_non_null_per_group(grouped(spark), ["g"], order_by="o").collect()}
    assert first == {1: ("x", "b"), None: ("z", "n"), 2: (None, None)}
    mode = {r.g: (r.p, r.q) for r in s.mode_then_first_per_group(grouped(spark), ["g"], order_by="o").collect()}
    assert mode == {1: ("x", "b"), None: ("z", "n"), 2: (None, None)}
    keys = spark.createDataFrame([(1,), (1,), (None,)], "g int")
    assert s.first_non_null_per_group(keys, ["g"]).count() == s.mode_then_first_per_group(keys, ["g"]).count() == 2
    plain = spark.createDataFrame([(1, "b"), (1, "a")], "g int, p string").coalesce(1)
    assert s.first_non_null_per_group(plain, ["g"]).collect()[0].p == "b"
    for f in (s.first_non_null_per_group, s.mode_then_first_per_group):
        with pytest.raises(ValueError):
            f(keys, [])


def test_fills(spark):
    df = spark.createDataFrame([(0, 1, 10), (1, 1, None), (2, 1, 20), (3, None, None), (4, None, 3), (5, 2, None)], "i int, g int, v long")
    assert column(s.fill_null_numeric_by_group(df, "v", ["g"], strategy="mean"), "v") == [10, 15, 20, 3, 3, None]
    skewed = spark.createDataFrame([(i, 1, v) for i, v in enumerate([1.0, 1.0, 1.0, 1.0, 1.0, 2.0, 30.0, None])], "i int, g int, v double")
    assert column(s.fill_null_numeric_by_group(skewed, "v", ["g"]), "v")[-1] == 1.0
    assert column(s.fill_null_numeric_by_group(skewed, "v", ["g"], skew_threshold=99), "v")[-1] == pytest.approx(37 / 7)
    constant = spark.createDataFrame([(0, 1, 5.0), (1, 1, None)], "i int, g int, v double")
    assert column(s.fill_null_numeric_by_group(constant, "v", ["g"]), "v") == [5.0, 5.0]
    text = spark.createDataFrame([(0, 1, "x")], "i int, g int, v string")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        s.fill_null_numeric_by_group(text, "v", ["g"], strategy="mean").collect()
    for bad in ({"strategy": "mode"}, {"skew_threshold": -1}):
        with pytest.raises(ValueError):
            s.fill_null_numeric_by_group(df, "v", ["g"], **bad)
    filled = s.fill_null_string_by_group(grouped(spark), "p", ["g"], order_by="o")
    assert column(filled, "p", "o") == ["x", "x", "y", "y", "x", "z", "z", None]
    numbers = s.fill_null_string_by_group(df, "v", ["g"], order_by="i")
    assert column(numbers, "v") == [10, 10, 20, 3, 3, None] and dict(numbers.dtypes)["v"] == "bigint"


def test_guards(spark):
    df = spark.createDataFrame([("ab", 1), (None, None), ("abcdef", 2)], "v string, n long")
    with pytest.raises(ValueError, match="'v' contains 1 null"):
        s.assert_no_nulls(df, "v")
    with pytest.raises(ValueError, match="2 value"):
        s.assert_string_length(df, "v", max_length=3)
    s.assert_string_length(df, "v", min_length=2, max_length=6, ignore_null=True)
    s.assert_string_length(df.limit(0), "v", min_length=1)
    with pytest.raises(ValueError):
        s.assert_string_length(df, "v")
    with pytest.raises(TypeError):
        s.assert_string_length(df, "n", min_length=1)
    vin = spark.createDataFrame([("7" * 15,), (None,)], "vin string")
    assert s.canonicalize_vin(vin, "vin", ignore_null=True).collect()[0].vin == "00" + "7" * 15
    for rows, ignore in (([("8" * 18,)], True), ([(None,)], False)):
        with pytest.raises(ValueError):
            s.canonicalize_vin(spark.createDataFrame(rows, "vin string"), "vin", ignore_null=ignore)


def test_column_names(spark):
    df = spark.createDataFrame([(1, 2)], "`  First  Name ` int, `LAST\tNAME` int")
    assert s.normalize_column_names(df).columns == ["first_name", "last_name"]
    assert s.normalize_column_names(df, "\\1").columns == ["first\\1name", "last\\1name"]
    with pytest.raises(ValueError, match="collide"):
        s.normalize_column_names(spark.createDataFrame([(1, 2)], "`a b` int, `A  B` int"))


CLASHES = "value gone n order at which row k0 k1 v0 v1 middle mode total upto __order __value __n __rare __clipped __middle __mode __k0 __median __mean".split()


def test_names_that_clash(spark):
    """Every name used inside, as a column of the user: values come back unchanged."""
    names = ", ".join(f"`{c}` string" for c in CLASHES)
    df = spark.createDataFrame([(i, i % 2, "abb"[i % 3], float(i) if i % 4 else None, *CLASHES) for i in range(12)], f"i int, g int, t string, x double, {names}").coalesce(1)
    whole = lambda out: out.count() > 0 and all(tuple(r[c] for c in CLASHES) == tuple(CLASHES) for r in out.collect())
    assert whole(s.first_non_null_per_group(df, ["g"])) and whole(s.mode_then_first_per_group(df, ["g"], order_by="i"))
    for strategy in ("auto", "mean", "median"):
        assert whole(s.fill_null_numeric_by_group(df, "x", ["g"], strategy=strategy))
    assert whole(s.fill_null_string_by_group(df, "t", ["g"]))
    for column_, step in (("t", s.collapse_rare_by_count(9)), ("t", s.collapse_keep_top_n(1)), ("x", s.winsorize_numeric()), ("x", s.clip_numeric(1, 2))):
        assert whole(s.apply_recipe(df, column_, [step], "out"))
    assert s.fill_null_string_by_group(df, "t", ["g"], output="mode").filter("mode = t").count() == 12
    assert s.first_non_null_per_group(df.limit(0), ["g"]).count() == s.mode_then_first_per_group(df.limit(0), ["g"]).count() == 0


def test_medians_against_plain_ones(spark):
    r = random.Random(3)
    rows = [(r.choice([1, 2, None]), r.choice([None, *map(float, range(9))])) for _ in range(300)] + [(7, None)]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "i int, g int, x double").repartition(3)
    want = {g: statistics.median([x for k, x in rows if k == g and x is not None] or [-1]) for g in (1, 2, None, 7)}
    got = column(s.fill_null_numeric_by_group(df, "x", ["g"], strategy="median"), "x")
    assert got == [x if x is not None else (None if g == 7 else want[g]) for g, x in rows]


def test_modes_take_two_shuffles(spark):
    plan = s.mode_then_first_per_group(spark.range(9).selectExpr("id % 2 g", "id a", "id b", "id c"), ["g"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and "Join" not in plan
