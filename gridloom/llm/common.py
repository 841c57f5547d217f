"""Shared helpers: tables in the cluster's shared folder, document selection, hashing."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folder -> session and, for a bucketed one, its table.
_written: dict[str, tuple[SparkSession, str | None]] = {}
#: Bytes of text that one task of a shuffle takes.
TASK_BYTES = 64 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``. Where it is unset, a local run takes a temporary one;
    on a cluster that is an error, as executors would write to their own disks."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="gridloom-"))
    return sc.getCheckpointDir()


@contextmanager
def shuffles_freed(spark: SparkSession):
    """Shuffle files of what is written inside go as soon as it is written, as nothing reads them again."""
    option = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(option, "false")
    spark.conf.set(option, "true")
    try:
        yield
    finally:
        spark.conf.set(option, before)


def settle(df: DataFrame, name: str = "table", gather: bool = False) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    This cuts the lineage so that a lost executor costs a re-read and not a recomputation, and it fixes
    generated ids. The files go with ``discard`` or when the driver ends. ``gather`` is for tasks that read much and
    leave little: the files then follow the size of what is written, where each task would write one of its own.
    """
    spark = df.sparkSession
    if gather:
        df = df.hint("rebalance")
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _written[path] = (spark, None)
    with shuffles_freed(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled = path
    return out


def settle_by(df: DataFrame, keys: list[str], width: int, name: str = "table") -> DataFrame:
    """As ``settle``, but dealt to ``width`` buckets of ``keys`` once, so that each later join or grouping by them reads
    the buckets as they are and moves nothing."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{table}"
    _written[path] = (spark, table)
    with shuffles_freed(spark):
        dealt = df.repartition(width, *keys).write.bucketBy(width, *keys).option("compression", "zstd").option("parquet.compression.codec.zstd.level", "1").option("path", path)
        dealt.saveAsTable(table)
    out = spark.table(table)
    out._settled = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete settled tables that nothing reads any more."""
    for df in tables:
        _delete(df._settled)


@contextmanager
def scratch():
    """Delete what is settled inside, at the end, but for the tables that are given to the function it hands out."""
    before, kept = set(_written), set()
    yield lambda df: kept.add(df._settled)
    for path in set(_written) - before - kept:
        _delete(path)


def deleted_at_end(spark: SparkSession, path: str) -> None:
    """Have a folder that was written otherwise deleted when the driver ends."""
    _written[path] = (spark, None)


def _delete(path: str) -> None:
    spark, table = _written.pop(path)
    if table:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clear() -> None:
    for path in list(_written):
        try:
            _delete(path)
        except Exception:  # the session may already be gone
            return


def select_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text): the two columns the operators need, null text as empty, whatever else ``df`` holds."""
    return df.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )


def map_by_id(docs: DataFrame, run, fields: str) -> DataFrame:
    """``mapInPandas`` to (doc_id, ``fields``) where ids are strings on the way, as pandas would round large integers
    that stand beside nulls."""
    kind = docs.schema["doc_id"].dataType
    named = docs.withColumn("doc_id", F.col("doc_id").cast("string"))
    return named.mapInPandas(run, f"doc_id string, {fields}").withColumn("doc_id", F.col("doc_id").cast(kind))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def width_for(spark: SparkSession, size: int) -> int:
    """Partitions for ``size`` bytes: as many as the session asks for, and more where they would hold too much."""
    return max(shuffle_width(spark), -(-size // TASK_BYTES))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def byte_values() -> np.ndarray:
    """A 64-bit value for each byte, made from a rule."""
    return mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def word_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, line) of every word of lines whose words are separated by single spaces; all lines at once."""
    data = np.frombuffer("\n".join(lines).encode(), np.uint8)
    if not len(data):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    ends_line = data == 10
    gap = ends_line | (data == 32)
    start = np.flatnonzero(~gap & np.r_[True, gap[:-1]])
    if not len(start):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    end = np.flatnonzero(~gap & np.r_[gap[1:], True]) + 1
    size = end - start
    inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    power = np.cumprod(np.full(int(size.max()), np.uint64(0x9FB21C651E98DF25)))
    terms = byte_values()[data[~gap]] * power[inside]
    sums = np.add.reduceat(terms, np.cumsum(size) - size)
    line = np.cumsum(ends_line)[start]
    return mix64(sums + size.astype(np.uint64)), line


def shingle_hashes_of(word: np.ndarray, line: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, line) of every run of ``words`` words in one line."""
    n = len(word) - words + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    total = np.zeros(n, np.uint64)
    for k in range(words):
        total = total * np.uint64(0xC2B2AE3D27D4EB4F) + word[k : k + n]
    same = line[:n] == line[words - 1 :]
    return mix64(total)[same], line[:n][same]


def text_chunks(texts, limit: int = 8 << 20):
    """(first, last) index of runs of texts of at most about ``limit`` characters, so that arrays stay small."""
    at, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= limit:
            yield at, i + 1
            at, held = i + 1, 0
    if at < len(texts):
        yield at, len(texts)
