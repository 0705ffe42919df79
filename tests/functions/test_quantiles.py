import numpy as np
import pytest

from scrubwell.functions.quantiles import exact_quantiles


@pytest.mark.parametrize("make,limit,accuracy", [("normal", 10**6, 10000), ("even", 400, 50), ("ties", 20, 50), ("constant", 3, 40), ("normal", 700, 40)])
def test_closing_in_equals_numpy(spark, make, limit, accuracy):
    r = np.random.default_rng(3)
    x = {"even": np.arange(3000.0), "ties": r.integers(0, 40, 3000).astype(float), "constant": np.full(500, 2.5), "normal": r.normal(size=3000)}[make]
    r.shuffle(x)
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double").coalesce(2)
    points = [0.0, 0.45, 1.0]
    got = df.limit(1).select(*exact_quantiles(df, df.v, points, limit=limit, accuracy=accuracy)).first()
    assert list(got) == pytest.approx(list(np.quantile(x, points)), rel=1e-12)


def test_no_values(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert df.select(*exact_quantiles(df, df.v, [0.5])).first()[0] is None
