"""Shared pieces of the training-data operators: words, hashes, and tables that cut lineage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

MIX1 = np.uint64(0xBF58476D1CE4E5B9)
MIX2 = np.uint64(0x94D049BB133111EB)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory, by any path that Spark's readers open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * MIX2
    return x ^ (x >> np.uint64(31))


def hash_words(words: list[bytes]) -> np.ndarray:
    """64-bit hash of each word, the same in every process."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive values; one value fewer than k gives none."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.full(n, np.uint64(k), dtype=np.uint64)
    for i in range(k):
        out = mix(out * GOLDEN + h[i : i + n])
    return out


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, null as None, without decoding."""
    return column.cast(pa.binary()).to_pylist()


def signed(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only in a local session, where none is set."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quillstone-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def trim() -> None:
    """Gives memory that nothing holds back to the system; idle workers would keep it beside those at work."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def lean(run):
    """A function over record batches that reads them in slices and trims the worker's memory behind each batch."""

    def reading(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            for lo in range(0, n, rows):
                yield batch.slice(lo, rows)
            del batch
            if n > rows:
                trim()

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(reading(batches, 512))
        trim()

    return out


class Stages:
    """Tables written by one run of an operator under the shared folder.

    Each is complete once written, so a lost executor costs a re-read and never a recomputation of what stands before.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/quillstone-{label}-{uuid.uuid4().hex}"
        self.written = 0

    def put(self, df: DataFrame, name: str) -> DataFrame:
        self.written += 1
        path = f"{self.base}/{self.written:02d}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def count(self, df: DataFrame, name: str, what: Column | None = None) -> tuple[DataFrame, int]:
        """put(), and how many of the rows written have `what`, without a job of its own."""
        seen = Observation()
        out = self.put(df.observe(seen, F.sum(F.lit(1) if what is None else F.when(what, 1).otherwise(0)).alias("n")), name)
        return out, seen.get["n"] or 0

    def tidy(self) -> None:
        """Lets Spark delete the shuffle files of plans that nothing refers to any more; it does so when the driver collects its garbage."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, df: DataFrame) -> None:
        """Deletes a table that no later plan reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if self.base.split("://", 1)[-1].split(":", 1)[-1] in path:
                where = jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(conf).delete(where, True)


def docs_of(df: DataFrame) -> DataFrame:
    """doc_id and text alone, under those names; other columns, whatever they are called, stay out of the plan."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def keyed(docs: DataFrame, stages: Stages) -> DataFrame:
    """docs with a key of its own for each row, `row`; written, as a second reading of the input could number rows differently."""
    return stages.put(docs.withColumn("row", F.monotonically_increasing_id()), "rows")
