"""A training corpus from ``documents``: language ID, near-dedup, decontamination, sanitisation, tokens.

Each stage takes what the one before kept, written as Parquet and read again. All but the last return
the columns of ``documents`` (and any further ones, with their values, whatever their names).

Null ids stay as they are. An empty table passes through every stage. Stages set the session's size of Arrow batches, where
the user hasn't: a worker that gets large ones takes the memory that it shares with its executor.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubwell.llm import bpe, decontaminate, langid, near_copies, pii
from scrubwell.llm.common import checkpoint_root, checkpoints_removed, finished, read_table, remove, small_batches

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what no learned language claims; learns as the query does. Null texts and texts without a letter go, as does
    everything if no row has a language; repeated rows stay or go alike."""
    small_batches(spark)
    return langid.accepted(docs, langid.fit(docs.filter(~langid.held_out(docs))))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least id of each group that links of a 5-word similarity of 0.8 or more connect.

    Of equal ids the least hash of the text decides, null ids come last, a repeated row stays once. Null, empty and blank
    texts are copies of each other."""
    small_batches(spark)
    return near_copies.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain an item of the benchmark. Null and empty texts stay, null and empty items match nothing."""
    small_batches(spark)
    return decontaminate.clean(docs, read_table(spark, sf_dir, "benchmark"))


def sanitisation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Redacts personal data and the terms that disclose it; ``n_chars`` follows the text, null for a null text. All rows stay."""
    small_batches(spark)
    done = pii.sanitised(docs)
    return done.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document, with digests of the ids and of what they decode to. Null texts count as empty, without ids."""
    small_batches(spark)
    trip = bpe.round_trip(docs, public_tokenizers.path(bpe.RANKS), numbers=True)
    return trip.select(
        "doc_id", F.size("numbers").cast("long").alias("n_tokens"), F.sha2(F.encode("ids", "UTF-8"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"), F.col("numbers").alias("ids"),
    )


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("sanitisation", sanitisation),
    ("tokens", tokens),
]
#: SQL can't express the models and components of the first two stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, *, root: str | None = None) -> DataFrame:
    """All stages over ``documents``; the result stays in the shared folder, stages between and checkpoints are removed.

    A call with the ``root`` (a folder that executors share) of a run that failed goes on after its last finished stage.
    """
    root = root or f"{checkpoint_root(spark)}/pipeline-{uuid.uuid4().hex}"
    done = max((k for k in range(len(STAGES)) if finished(f"{root}/{k}")), default=-1)
    docs = spark.read.parquet(f"{root}/{done}") if done >= 0 else read_table(spark, sf_dir, "documents")
    for k, (_, stage) in list(enumerate(STAGES))[done + 1 :]:
        with checkpoints_removed():
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{root}/{k}")
        docs = spark.read.parquet(f"{root}/{k}")
        if k:
            remove(f"{root}/{k - 1}")
    return docs
