"""Helpers shared by the pipeline operators: tables, the shared folder, byte-level text batches."""

from __future__ import annotations

import contextlib
import math
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from ..session import ship

_OWN: list[str] = []
_SCRATCH: list[list[str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a local session gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="loomgraph-"))
    return _OWN[0]


def staged(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for written in _SCRATCH:
        written.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Delete the tables that were staged inside, but those that are taken off the list."""
    written: list[str] = []
    _SCRATCH.append(written)
    try:
        yield written
    finally:
        _SCRATCH.remove(written)
        for path in written:
            _delete(spark, path)


def _delete(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_staged(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more."""
    spark = df.sparkSession
    root = shared_dir(spark)
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        if f.split(":", 1)[-1].lstrip("/").startswith(root.split(":", 1)[-1].lstrip("/")):
            _delete(spark, f)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the rows of one Arrow batch: whole texts go to the Python workers, which need this package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def bounds_below(value: Column, bounds: list, kind: DataType, equal: bool = False) -> Column:
    """How many of the ascending bounds are below a value (or equal to it, with ``equal``).

    The tops of blocks are compared first, then one block: twice the root of the bounds' number of comparisons.
    """
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds)) + 1
    array = lambda some: F.array(*[F.lit(b).cast(kind) for b in some])
    lower = lambda some: F.size(F.filter(some, lambda b: (b <= value) if equal else (b < value)))
    tops = bounds[step - 1 :: step]
    block = lower(array(tops)) * step if tops else F.lit(0)
    return block + lower(F.slice(array(bounds), block + 1, F.lit(step)))


def ascii_lower(col):
    """A-Z to a-z and nothing else (``lower`` would change other letters too)."""
    upper, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(col) == F.length(col), F.lower(col)).otherwise(F.translate(col, upper, low))


# --- texts as one byte array -------------------------------------------------------------------


def ranges(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Row ranges whose sizes sum to about ``most``; one larger row is a range of its own."""
    at = size = 0
    for i, n in enumerate(sizes):
        if i > at and size + n > most:
            yield at, i
            at, size = i, 0
        size += n
    if at < len(sizes):
        yield at, len(sizes)


def slices(texts: list[bytes], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes; one longer text is a range of its own."""
    return ranges([len(t) for t in texts], most)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    off = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=off[1:])
    return np.frombuffer(b"".join(texts), np.uint8), off


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, element by element."""
    x = x ^ (x >> _S30)
    x = x * _M1
    x ^= x >> _S27
    x *= _M2
    x ^= x >> _S31
    return x


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_POW = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and their inverses, at least ``n`` of each."""
    if len(_POW[0]) < n:
        m = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            a = np.full(m, np.uint64(base & (2**64 - 1)), np.uint64)
            a[0] = 1
            np.multiply.accumulate(a, out=a)
            _POW[k] = a
    return _POW[0], _POW[1]


def range_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``values[s:e]`` (uint64) for every range, wherever it lies."""
    p, inv = powers(len(values) + 1)
    s = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * p[: len(values)], out=s[1:])
    h = (s[ends] - s[starts]) * inv[starts]
    return mix(h + (ends - starts).astype(np.uint64) * _M2)
