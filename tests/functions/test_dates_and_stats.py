from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

import scrubwell as s
from tests.helpers import applied, check, column


def test_epochs_and_serials(spark):
    moment = datetime(2023, 1, 1)
    for unit, value in (("s", 1672531200), ("ms", 1672531200000), ("us", 1672531200000000)):
        assert applied(spark, [value, None, 0], [s.normalize_epoch_timestamps(unit)], "long") == [moment, None, datetime(1970, 1, 1)]
    assert applied(spark, [44927.0, 44927.5, None], [s.normalize_excel_serial_dates], "double") == [moment, datetime(2023, 1, 1, 12), None]
    assert applied(spark, [44927], [s.normalize_excel_serial_dates], "long") == [moment]


@pytest.mark.parametrize("kind,make", [("date", date), ("timestamp_ntz", datetime)])
def test_date_range(spark, kind, make):
    values = [make(1999, 12, 31), make(2000, 1, 1), make(2026, 1, 1), make(2026, 1, 2), None]
    assert applied(spark, values, [s.flag_dates_outside_range(make(2000, 1, 1), make(2026, 1, 1))], kind) == [True, False, False, True, None]
    assert applied(spark, values, [s.flag_dates_outside_range(upper=make(2000, 1, 1))], kind) == [False, False, True, True, None]
    with pytest.raises(ValueError):
        s.flag_dates_outside_range()


def both(spark, values, transforms, kind="double"):
    """``apply_recipe`` and a column made on the frame must agree; frequencies only have the former."""
    if kind == "double":
        values = [None if v is None else float(v) for v in values]
    df = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
    framed = column(s.apply_recipe(df, "x", transforms, "y"), "y")
    if kind == "double":
        assert framed == applied(spark, values, transforms, kind)
    else:
        with pytest.raises(ValueError, match="apply_recipe"):
            applied(spark, values, transforms, kind)
    return framed


def test_outliers(spark):
    spread = [10.0] * 20 + [50.0, None]
    assert both(spark, spread, [s.flag_zscore_outliers()]) == [False] * 20 + [True, None]
    assert both(spark, spread, [s.flag_iqr_outliers()]) == [False] * 20 + [True, None]
    assert both(spark, spread, [s.flag_mad_outliers()]) == [False] * 20 + [True, None]
    assert both(spark, [0.1] * 3, [s.flag_zscore_outliers()]) == [False] * 3
    assert both(spark, [7.0] * 4, [s.flag_mad_outliers()]) == [False] * 4
    assert both(spark, [42.0], [s.flag_zscore_outliers()]) == [None]
    assert both(spark, [42.0], [s.flag_iqr_outliers()]) == [False]
    assert both(spark, [1.0, 2, 3, 4, 100], [s.flag_mad_outliers()]) == [False] * 4 + [True]
    for factory in (s.flag_zscore_outliers, s.flag_iqr_outliers, s.flag_mad_outliers):
        with pytest.raises(ValueError):
            factory(0)


def test_bounds(spark):
    assert both(spark, [-5.0, 0, 5, 50, None], [s.clip_numeric(0, 10)]) == [0, 0, 5, 10, None]
    assert both(spark, [-5.0, 50], [s.clip_numeric(upper=10)]) == [-5.0, 10.0]
    whole = spark.createDataFrame([(0, -5), (1, 3), (2, 99)], "i int, x long")
    clipped = s.apply_recipe(whole, "x", [s.clip_numeric(0.0, 10.0)])
    assert dict(clipped.dtypes)["x"] == "bigint" and column(clipped, "x") == [0, 3, 10]
    assert both(spark, [float(i) for i in range(1, 10)] + [1000.0, None], [s.winsorize_numeric(0.0, 0.9)])[-2:] == [pytest.approx(108.1), None]
    assert both(spark, [None, None], [s.winsorize_numeric()]) == [None, None]
    assert dict(s.apply_recipe(whole, "x", [s.winsorize_numeric()]).dtypes)["x"] == "bigint"
    for bad in ({}, {"lower": 2, "upper": 1}):
        with pytest.raises(ValueError):
            s.clip_numeric(**bad)
    for low, high in ((0.5, 0.5), (-0.1, 0.5), (0.5, 1.1)):
        with pytest.raises(ValueError):
            s.winsorize_numeric(low, high)


def test_frequencies(spark):
    values = list("aaaabbbccd") + [None] * 6
    assert both(spark, values, [s.collapse_rare_by_count(3)], "string") == list("aaaabbb") + ["other"] * 3 + [None] * 6
    assert both(spark, values, [s.collapse_keep_top_n(2, "rest")], "string") == list("aaaabbb") + ["rest"] * 3 + [None] * 6
    assert both(spark, list("aabbc"), [s.collapse_keep_top_n(1)], "string") == list("aabb") + ["other"]
    assert both(spark, [None], [s.collapse_keep_top_n(1)], "string") == [None]
    for factory in (s.collapse_rare_by_count, s.collapse_keep_top_n):
        with pytest.raises(ValueError):
            factory(0)


def test_recipe_breaks_at_data_dependent_steps(spark):
    df = spark.createDataFrame([(0, " A"), (1, "a "), (2, "b")], "i int, x string")
    out = s.apply_recipe(df, "x", [s.strip_whitespace, s.to_lowercase, s.collapse_rare_by_count(2), s.to_uppercase], "y")
    assert out.columns == ["i", "x", "y"] and column(out, "y") == ["A", "A", "OTHER"]
    plan = s.apply_recipe(df, "x", [s.to_lowercase])._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join" not in plan


def test_no_global_window_on_the_frame_path(spark):
    df = spark.createDataFrame([(0, 1.0)], "i int, x double")
    for step in (s.flag_zscore_outliers(), s.flag_mad_outliers(), s.winsorize_numeric()):
        assert "Window" not in s.apply_recipe(df, "x", [step])._jdf.queryExecution().optimizedPlan().toString()


def test_figures_need_the_frame(spark):
    whole = spark.createDataFrame([(0, -5), (1, 3), (2, 99), (3, None)], "i int, x long")
    for step in (s.flag_zscore_outliers(), s.flag_iqr_outliers(), s.flag_mad_outliers(), s.winsorize_numeric(), s.collapse_keep_top_n(1), s.collapse_rare_by_count(1)):
        with pytest.raises(ValueError, match="apply_recipe"):
            s.compose_column("x", [step])
    for bounds, want in (((0.0, 3.5), [0, 3, 3, None]), ((0, 10), [0, 3, 10, None])):
        out = whole.withColumn("y", s.compose_column("x", [s.clip_numeric(*bounds)], df=whole))
        assert dict(out.dtypes)["y"] == "bigint" and column(out, "y") == want
    out = whole.withColumn("y", s.compose_column("x", [s.clip_numeric(0.0, 10.0)]))
    assert dict(out.dtypes)["y"] == "bigint" and column(out, "y") == [0, 3, 10, None]
    steps = {"x": s.compose_column("x", [s.winsorize_numeric(0.0, 0.5)], df=whole), "i": s.compose_column("i", [s.clip_numeric(1)], df=whole)}
    out = whole.withColumns(steps)
    assert [tuple(r) for r in out.collect()] == [(1, -5), (1, 3), (2, 3), (3, None)] and out.dtypes == whole.dtypes
    assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString().split("Subquery")[0]


def test_compose(spark):
    df = spark.createDataFrame([(" A ",)], "`a.b` string")
    assert df.select(s.compose_column("a.b", [s.strip_whitespace])).columns == ["a.b"]
    assert df.select(s.compose_column("a.b", (s.strip_whitespace, s.to_lowercase), "c")).collect()[0].c == "a"
    assert df.select(s.compose_column("a.b", [lambda c: c.alias("z")], "")).columns == ["a.b"]
    for f in (lambda: s.compose_column("a", []), lambda: s.apply_recipe(df, "a.b", [])):
        with pytest.raises(ValueError):
            f()
    check(spark, [F.upper], {"x": "X"})
