"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_SPACE = b" \t\n\r\x0b\x0c"
_CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCHES = ("spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
#: Bytes of text that one Python step holds at once.
WINDOW_BYTES = 8 << 20
#: Bytes of a row group of the tables that cut lineage; a task that writes texts holds one in memory.
ROW_GROUP_BYTES = 16 << 20
#: Keys that are broadcast because they are frequent are at most so many, by the choice of what counts as frequent.
HOT_KEYS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a local session (tests) may do without it; there it is set."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="corpusmill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str, group_rows: int | None = None) -> DataFrame:
    """Cut lineage: write df as Parquet to the shared folder and read it again. group_rows: rows of a row group at most; Parquet looks at its bytes after a hundred only."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN_SHUFFLES)
    spark.conf.set(_CLEAN_SHUFFLES, "true")  # the table replaces the shuffles that made it
    try:
        bounds = {"parquet.block.row.count.limit": str(group_rows)} if group_rows else {}
        df.write.options(compression="zstd", **{"parquet.block.size": str(ROW_GROUP_BYTES)}, **bounds).parquet(path)
    finally:
        spark.conf.set(_CLEAN_SHUFFLES, before)
    made = spark.read.schema(df.schema).parquet(path)
    made.written_to = path
    return made


def discard(made: DataFrame) -> None:
    """Delete a table of `materialize` that nothing reads any more."""
    spark = made.sparkSession
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(made.written_to)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bound_batches(spark: SparkSession, size: int = 4 << 20, rows: int = 2000) -> None:
    """Let Spark send batches of at most about `size` bytes and `rows` rows to Python, and read Parquet by rows / 4; a session with lower bounds keeps them."""
    for key, most in zip(_BATCHES, (size, rows, rows // 4), strict=True):
        now = int(re.sub(r"\D", "", spark.conf.get(key)))
        if not 0 < now <= most:  # 0: no bound
            spark.conf.set(key, str(most))


@contextlib.contextmanager
def batches_bounded(spark: SparkSession, size: int = 4 << 20, rows: int = 2000) -> Iterator[None]:
    """`bound_batches` for the jobs that run within; the session's own settings are there again afterwards."""
    before = [spark.conf.get(k) for k in _BATCHES]
    bound_batches(spark, size, rows)
    try:
        yield
    finally:
        for k, v in zip(_BATCHES, before, strict=True):
            spark.conf.set(k, v)


@contextlib.contextmanager
def splits_bounded(spark: SparkSession, size: int) -> Iterator[None]:
    """Files are read in splits of at most about `size` bytes by the jobs that run within; a session with smaller ones keeps them."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    jvm = spark._jsparkSession.sessionState().conf()
    now = (jvm.filesMaxPartitionBytes(), jvm.filesOpenCostInBytes())
    before = [spark.conf.get(k) for k in keys]
    for k, is_now in zip(keys, now, strict=True):
        spark.conf.set(k, str(min(is_now, size)))
    try:
        yield
    finally:
        for k, v in zip(keys, before, strict=True):
            spark.conf.set(k, v)


def text_bytes(df: DataFrame, text_col: str, *keep: str) -> DataFrame:
    """keep..., and the text as UTF-8 in column `text` (null: empty)."""
    return df.select(*keep, F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))


def windows(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = WINDOW_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices whose `column` holds about `size` bytes, one row at least."""
    for batch in batches:
        lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(lengths):
            if held and held + n > size:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)


def release() -> None:
    """Give memory that nothing uses back to the system; Python workers live on between tasks and stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not every C library has it
        pass


def tidy(step: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A step over batches that leaves no unused memory with its worker."""

    @functools.wraps(step)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from step(batches)
        finally:
            release()

    return run


def word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Words between ASCII white space: (where each text's words begin, and the end; each word's place in the list; distinct words)."""
    split = pc.ascii_split_whitespace(texts.view(pa.string()))
    coded = split.flatten().dictionary_encode()
    codes, bounds = coded.indices.to_numpy(zero_copy_only=False), split.offsets.to_numpy().astype(np.int64)
    bounds -= bounds[0]
    distinct = coded.dictionary.cast(pa.binary()).to_pylist()
    if b"" in distinct:  # before leading and behind trailing white space
        nothing = distinct.index(b"")
        there = codes != nothing
        bounds = np.concatenate([[0], np.cumsum(there)])[bounds]
        codes = codes[there]
        codes = codes - (codes > nothing)
        del distinct[nothing]
    return bounds, codes.astype(np.int64), distinct


def unique_ids() -> Iterator[int]:
    """Ids that no other task of the same stage gives: the partition, then a counter."""
    base = TaskContext.get().partitionId() << 36
    while True:
        yield base
        base += 1


def skew_safe_join(rows: DataFrame, table: DataFrame, keys: list[str], count: str, rows_in_all: int) -> DataFrame:
    """Inner join of rows with a table that has one row for each key, and in column `count` how many rows have it.

    Keys of more than max(1000, rows_in_all / HOT_KEYS) rows, of which there can be no more than HOT_KEYS, are broadcast, and
    their rows stay where they are; all the others meet in a shuffle, in which no key is frequent.
    """
    most = max(1000, rows_in_all // HOT_KEYS)
    hot = F.broadcast(table.where(F.col(count) > most).drop(count))
    cold = table.where(F.col(count) <= most).drop(count)
    return rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(cold, keys))


def prefix_sum(df: DataFrame, value: str, out: str, by: list[str], key: str, n_rows: int) -> DataFrame:
    """Add `out`: the sum of `value` over the rows before this one within `by`, without one task holding a whole group.

    Rows are dealt to blocks by a hash of `key`, one for each 50,000 of `n_rows` and 256 at least; each block is summed, the
    blocks' sums are accumulated (a row for each group and block), and rows are accumulated within their block in the order of `key`.
    `key` must be unique.
    """
    from pyspark.sql import Window

    blocks = max(256, n_rows // 50_000)
    dealt = df.withColumn("_block", F.pmod(F.xxhash64(key), F.lit(blocks)))
    sums = dealt.groupBy(*by, "_block").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*by, "_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy(*by, "_block").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    rows = dealt.withColumn("_within", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return rows.join(offsets, [*by, "_block"]).withColumn(out, F.col("_offset") + F.col("_within")).drop("_offset", "_within", "_block")
