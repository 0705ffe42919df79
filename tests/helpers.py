from pyspark.sql import functions as F

from scrubwell import compose_column


def applied(spark, values, transforms, kind="string"):
    """The values after the transforms, in order."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}").coalesce(1)
    return [r.y for r in df.select("i", compose_column("x", transforms, "y", df=df)).orderBy("i").collect()]


def check(spark, transforms, table, kind="string"):
    """``table`` maps inputs to outputs; null must stay null."""
    pairs = list(table.items()) if isinstance(table, dict) else list(table)
    got = applied(spark, [k for k, _ in pairs] + [None], transforms, kind)
    assert got[:-1] == [v for _, v in pairs]
    assert got[-1] is None


def column(df, name, order="i"):
    return [r[0] for r in df.orderBy(order).select(F.col(name)).collect()]
