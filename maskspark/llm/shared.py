"""What several operators of this subpackage share: lineage cuts, word hashes, table reading."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: no space, tab, line feed, vertical tab, form feed or carriage return in it. bytes.split() cuts at the same six.
WORD = r"[^\x20\x09-\x0D]+"

#: Distinct words a worker remembers before it starts afresh: bounds a worker's memory, has no influence on results.
CACHE_WORDS = 400_000


#: What a worker remembers from task to task, by the operator that it is for.
KEPT: dict[str, dict] = {}


def kept(owner: str) -> dict:
    return KEPT.setdefault(owner, {})


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], owner: str = "") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, by a worker that first forgets what it remembers for other operators, and in the end gives freed memory back.

    Workers are used again by later stages, and while they wait their memory counts too.
    """

    def lighter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for other in KEPT.keys() - {owner}:
            KEPT[other].clear()
        try:
            yield from run(batches)
        finally:
            give_back()

    return lighter


def give_back() -> None:
    """Freed memory goes back to the system, by Arrow's pool and by the C library where it can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table in fewer pieces than there are cores, dealt to all of them; any larger one is left as it lies."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(4 * cores)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def checkpoint_dir(spark: SparkSession) -> None:
    """Uses spark.checkpoint.dir. Where it is unset, a session on one machine gets a folder of its own; on a cluster that is an error."""
    if spark.sparkContext.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None:
            if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            where = tempfile.mkdtemp(prefix="maskspark-checkpoints-")
        spark.sparkContext.setCheckpointDir(where)


def cut(df: DataFrame, free: bool = True) -> DataFrame:
    """df computed once and kept in the shared checkpoint folder; earlier shuffle files can then go.

    The cleaner removes shuffle and checkpoint files of frames that nothing refers to any more, but only
    once the JVM has noticed, hence the two collections; without `free`, for small frames, that is left to later.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    out = df.checkpoint(eager=True)
    del df
    if free:
        release(spark)
    return out


def release(spark: SparkSession) -> None:
    """Lets the cleaner see what nothing refers to any more. Called after cut(), also what the caller had given to it.

    The scheduler refers to its last job until the next one comes: a job of one row takes that place first.
    """
    gc.collect()
    spark.range(1).collect()
    spark.sparkContext._jvm.System.gc()


def unused(df: DataFrame, name: str) -> str:
    """`name`, with as many underscores before it as no column of df has."""
    while name in df.columns:
        name = f"_{name}"
    return name


def positional(df: DataFrame, names: list[str]) -> list:
    """The columns of these names as c0, c1, ...: what is added to them then cannot clash."""
    return [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]


class WordHashes(dict):
    """Word (bytes) to a 64-bit hash, computed once for each word a worker meets."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > CACHE_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them evenly."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


#: Odd multipliers without structure, of the 1st, 2nd, ... word of a window.
_FACTORS = [np.uint64(xxhash.xxh3_64_intdigest(str(i).encode()) | 1) for i in range(64)]


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of all windows of `width` words in a row; empty if there are fewer words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i in range(width):
        total += hashes[i : i + n] * _FACTORS[i]
    return mixed(total)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """The texts of an Arrow string column as UTF-8."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
