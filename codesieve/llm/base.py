"""What the operators share: the shared folder, word splitting, hashes of word runs."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The white space that separates words: blank, tab, line feed, vertical tab, form feed, carriage return. `bytes.split()` splits at the same six.
SPACES = " \t\n\x0b\x0c\r"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: While a step is written: its shuffle files go when it ends, and batches of rows for Python are small, as a task holds several of them.
WRITING = {CLEANUP: "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by `spark.checkpoint.dir`; where that is unset (tests), one beside the warehouse."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-steps"


def written(df: DataFrame) -> DataFrame:
    """Write an intermediate result as a table in the shared folder and go on from there.

    Lost executors cannot take it with them, each reader takes only the columns it needs, and the shuffle files of the
    job that made it are no longer needed, so Spark is told to drop them when the write has ended.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in WRITING}
    for k, v in WRITING.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete a table made by `written` once no pending plan reads it."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        folder = name.rsplit("/llm-", 1)
        if len(folder) == 2:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder[0]}/llm-{folder[1].split('/')[0]}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def words(text: Column) -> Column:
    """Array of words (null text: none), by built-in functions only."""
    plain = F.coalesce(text, F.lit(""))
    for space in SPACES[1:]:
        plain = F.replace(plain, F.lit(space), F.lit(" "))
    return F.array_remove(F.split(plain, " "), "")


class WordHash(dict):
    """64-bit hashes of words, remembered up to a bound."""

    LIMIT = 1 << 17

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, items: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, items), np.uint64, len(items))


_STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the usual finaliser of multiplicative hashes)."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def run_hashes(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of k neighbouring values."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, seed, np.uint64)
    for j in range(k):
        out *= _STEP
        out += h[j:j + n]
    return mixed(out)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts of a batch as UTF-8; null is empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


#: Bytes of text that one step of a task looks at.
SLICE = 4 << 20


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most SLICE bytes of text; a longer text is a part of its own."""
    sizes = np.array([len(x.as_buffer() or b"") if x.is_valid else 0 for x in batch.column(column)], np.int64)
    part = np.cumsum(sizes) // SLICE
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def by_batch(f: Callable[[pa.RecordBatch], dict], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that turns each batch into columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict(f(batch), schema=schema)
    return run


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, as Spark's own Python file."""
    context = spark.sparkContext
    if not getattr(context, "_codesieve_shipped", False):
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        context.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp()}/codesieve", "zip", os.path.dirname(package), os.path.basename(package)))
        context._codesieve_shipped = True


def in_arrow(df: DataFrame, f: Callable, schema: str | StructType) -> DataFrame:
    """mapInArrow with this package at hand in the tasks."""
    ship(df.sparkSession)
    return df.mapInArrow(f, schema)
