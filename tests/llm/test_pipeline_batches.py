import pyarrow as pa
import pytest

import corpus_pipeline
from scrubwell.llm import common


@pytest.fixture
def session(spark):
    spark.conf.unset(common.BATCH_LIMIT)
    yield spark
    spark.conf.unset(common.BATCH_LIMIT)


def batches(df):
    """Rows and bytes of the batches that a worker gets."""

    def run(them):
        for b in them:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64()), pa.array([b.nbytes], pa.int64())], names=["rows", "bytes"])

    return [(r.rows, r.bytes) for r in common.map_batches(df, run, "rows long, bytes long", __name__).collect()]


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_workers_get_small_batches(session, docs, tmp_path, stage):
    """Spark's 64 MB, in JVM and worker, took an executor beyond its memory."""
    session.createDataFrame([(0, "a b c d e f")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stage(session, docs(["one two", "", None]), str(tmp_path))
    got = batches(session.range(0, 12, 1, 1).selectExpr("id", "repeat('word ', 250000) AS text"))
    assert sum(n for n, _ in got) == 12 and max(size for _, size in got) <= 1.5 * common.IN_BYTES


def test_a_setting_of_the_user_stays(session, docs):
    session.conf.set(common.BATCH_LIMIT, 9 << 20)
    corpus_pipeline.tokens(session, docs(["one two"]), "")
    assert session.conf.get(common.BATCH_LIMIT).rstrip("b") == str(9 << 20)
