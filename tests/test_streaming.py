import pytest

import scrubwell as s


def test_recipes_on_a_stream(spark, tmp_path):
    spark.createDataFrame([(" A ", 1), (" ", 2), (None, 3)], "x string, n int").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("x string, n int").parquet(str(tmp_path / "in"))
    done = s.clean_stream(stream, {"x": s.CATEGORY_CANONICALIZE})
    query = done.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination()
    assert sorted((r.n, r.x) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, "a"), (2, None), (3, None)]
    with pytest.raises(ValueError):
        s.clean_stream(stream, {"n": [s.winsorize_numeric()]})
