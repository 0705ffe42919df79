"""Shared plumbing of the training-data operators: Arrow row mapping, checkpoints and text rules."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import zlib
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of output that a task gathers before it hands an Arrow batch back to Spark.
OUT_BYTES = 4 << 20
OUT_ROWS = 4096
#: Spark's limit of the bytes of a batch that it hands to a worker, and what ``small_batches`` sets.
BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
IN_BYTES = 4 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Have Spark end a batch for a worker with the row that reaches ``IN_BYTES``. Its default is 64 MB, of which a task holds
    copies in the JVM and one in the worker. Plans are made when they run, so the session keeps the setting; one of the user's own stays."""
    if BATCH_LIMIT not in spark.conf.getAll:
        spark.conf.set(BATCH_LIMIT, IN_BYTES)


def map_rows(
    df: DataFrame,
    rows: Callable[[Iterator[tuple]], Iterable[tuple]],
    schema: str,
    arrow: pa.Schema,
    *,
    binary: tuple[str, ...] = (),
) -> DataFrame:
    """Run ``rows`` over the tuples of each partition, Arrow batch by Arrow batch.

    ``rows`` is a generator over input tuples, so what a task holds is one input batch and at most
    ``OUT_BYTES`` of output. String columns named in ``binary`` arrive as UTF-8 bytes.
    """
    cut, owner = frozenset(binary), rows.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tuples() -> Iterator[tuple]:
            for batch in batches:
                for start in range(0, batch.num_rows, 512):
                    part = batch.slice(start, 512)
                    columns = [
                        (c.cast(pa.binary()) if name in cut and not pa.types.is_binary(c.type) else c).to_pylist()
                        for name, c in zip(part.schema.names, part.columns)
                    ]
                    yield from zip(*columns)

        held: list[tuple] = []
        size = 0
        for out in rows(tuples()):
            held.append(out)
            size += sum(8 * len(v) if isinstance(v, (list, np.ndarray)) else len(v) for v in out if hasattr(v, "__len__"))
            if size >= OUT_BYTES or len(held) >= OUT_ROWS:
                yield _batch(held, arrow)
                held, size = [], 0
        if held:
            yield _batch(held, arrow)

    return map_batches(df, run, schema, owner)


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, owner: str) -> DataFrame:
    """Run ``run`` of the module ``owner`` over the Arrow batches of each partition; what it gives goes to Spark in
    batches of some ``OUT_BYTES``."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.set_threshold(200_000, 50, 100)  # memos hold many small tuples; walking them often is slow
        forget(owner)
        give_back()  # of the task before, whose function and what it refers to are in cycles
        for batch in run(batches):
            step = min(OUT_ROWS, batch.num_rows * OUT_BYTES // max(batch.nbytes, OUT_BYTES) + 1)
            for start in range(0, batch.num_rows, step):
                yield batch.slice(start, step)
        batch = None
        give_back()

    return df.mapInArrow(task, schema)


#: What a worker keeps from task to task, and the modules whose tasks use it.
_KEPT: list[tuple[dict, frozenset[str]]] = []


def kept(*users: str) -> dict:
    """A dict that lives as long as a worker runs tasks of the modules ``users``; tasks of another operator empty it."""
    _KEPT.append(({}, frozenset(users)))
    return _KEPT[-1][0]


def forget(owner: str) -> None:
    for what, users in _KEPT:
        if owner not in users:
            what.clear()


def give_back() -> None:
    """Return what a task freed to the system; workers outlive it, and allocators would hold on to it."""
    gc.collect()
    trim()


def trim() -> None:
    """The same for what needs no collection, quick enough for the middle of a task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of the cluster. A temporary one is set only in local mode, where none is configured."""
    sc = spark.sparkContext
    have = spark.conf.get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not have and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not have:
            have = "file://" + tempfile.mkdtemp(prefix="scrubwell-")
        sc.setCheckpointDir(have)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and drop its lineage."""
    checkpoint_root(df.sparkSession)
    out = df.checkpoint()
    path = out._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if path.isDefined():
        _MADE.append(path.get())
    return out


#: Checkpoints of this process, for ``checkpoints_removed``.
_MADE: list[str] = []


@contextmanager
def checkpoints_removed() -> Iterator[None]:
    """Delete the checkpoints made inside, for code whose results are written by its end."""
    at = len(_MADE)
    try:
        yield
    finally:
        for path in _MADE[at:]:
            remove(path)
        del _MADE[at:]


def open_folder(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder))


def remove(folder: str) -> None:
    system, base = open_folder(folder)
    if system.get_file_info(base).type != pafs.FileType.NotFound:
        system.delete_dir(base)


def finished(folder: str) -> bool:
    """Whether Spark wrote the folder to its end."""
    system, base = open_folder(folder)
    return system.get_file_info(f"{base}/_SUCCESS").type != pafs.FileType.NotFound


def crc_mod(doc_id: Any, mod: int) -> Any:
    """crc32 of the decimal text of an id, modulo ``mod``; a column for a column, else an int."""
    if isinstance(doc_id, int):
        return zlib.crc32(str(doc_id).encode()) % mod
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % mod


def bounded(df: DataFrame, order: list[Any], rows: int) -> DataFrame:
    """The rows of ``df`` of the ``rows`` least identities by ``order``, whose last column is ``hash``, of all of a row.

    The identities are a top-k, of which each task keeps ``rows`` at most; texts don't travel for it. Equal rows share an
    identity, so callers drop repeats of ``hash`` before anything reaches the driver.
    """
    named = [o.alias(f"o{i}") for i, o in enumerate(order)]
    least = df.select(*named).orderBy(*[f"o{i}" for i in range(len(order))]).limit(rows).select(F.col(f"o{len(order) - 1}").alias("hash"))
    return df.join(F.broadcast(least.distinct()), "hash", "left_semi")


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The names, each with underscores added until ``df`` has no column of it (in any case of its letters)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: 64-bit words of a row filter; so a broadcast of 16 MB at most before Spark's own overhead.
FILTER_WORDS = 1 << 20


def maybe_in(df: DataFrame, column: str, hashes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``df`` split into the rows whose hash in ``column`` may be among ``hashes`` (one column), and those where it isn't.

    A bitmap of a fixed number of bits, in a broadcast table of words. With more than some ``64 * FILTER_WORDS`` hashes most
    rows may be among them; the result of what follows is the same, it only has more rows to shuffle.
    """
    word, bits = free_names(df, "word", "bits")
    n = FILTER_WORDS * 64
    table = hashes.toDF("h").select(F.pmod("h", F.lit(n)).alias("h")).groupBy(F.expr("h div 64").alias(word)).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(h % 64 as int))")).alias(bits)
    )
    table = cut(table)  # at most ``FILTER_WORDS`` rows
    marked = df.withColumn(word, F.expr(f"pmod(`{column}`, {n}L) div 64")).join(F.broadcast(table), word, "left")
    hit = F.coalesce(F.expr(f"getbit({bits}, cast(pmod(`{column}`, 64) as int)) = 1"), F.lit(False))
    return marked.filter(hit).drop(word, bits), marked.filter(~hit).drop(word, bits)


def without_rows(df: DataFrame, identity: list[Any], gone: DataFrame) -> DataFrame:
    """``df`` without the rows whose ``identity`` (columns that aren't null, the last one a hash) is among the rows of ``gone``.

    Only rows that a filter of fixed size can't tell from those are shuffled; all others stay where they are read.
    """
    names = free_names(df, *[f"id{i}" for i in range(len(identity))])
    gone = cut(gone.toDF(*names))
    named = df.withColumns(dict(zip(names, identity)))
    maybe, rest = maybe_in(named, names[-1], gone.select(names[-1]))
    same = [F.col("`" + c.replace("`", "``") + "`") for c in rest.columns]
    return rest.unionAll(maybe.join(gone.hint("shuffle_hash"), names, "left_anti").select(*same)).drop(*names)


def release(df: DataFrame) -> None:
    """Let Spark drop the shuffle files of plans that nothing refers to any more; it does so on a collection."""
    gc.collect()
    df.sparkSession._jvm.System.gc()
