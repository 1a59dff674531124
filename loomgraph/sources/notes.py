"""Scans: notes and code from a directory tree, and the writers of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab as V


def skipped_dir(name: Column) -> Column:
    return name.isin(*V.SKIP_DIRS) | name.startswith(".")


def indexable(path: Column) -> Column:
    ext = T.extension(path)
    return ~ext.isin(*V.NEVER_INDEXED) & ext.isin(*V.INDEXED)


def visible(path: Column) -> Column:
    """No directory of the (relative) path is to be skipped."""
    dirs = F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1)
    return ~F.exists(dirs, skipped_dir)


def _having(spark: SparkSession, root: str, dirs: list[str], name: str) -> list[str]:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [d for d in dirs if fs.exists(path(f"{root.rstrip('/')}/{d}{name}"))]


def collect_files(spark: SparkSession, root: str, marker: str = ".index-ignore", glob: str | None = None) -> DataFrame:
    """(path, content) of the indexable text files under ``root``; a directory with a file named ``marker`` is left out with all below.

    Invalid UTF-8 becomes replacement characters; blank files are left out. ``glob='*.md'`` is the scan of notes alone.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    raw = (reader.option("pathGlobFilter", glob) if glob else reader).load(root)
    rel = F.regexp_replace(F.regexp_replace("path", r"^file:/+", "/"), "^.*?" + root.rstrip("/").replace(".", r"\.") + "/", "")
    files = raw.select(rel.alias("path"), "content")
    if glob is None:
        files = files.filter(visible(F.col("path")) & indexable(F.col("path")))
        ups = F.transform(F.sequence(F.lit(0), F.size(F.split("path", "/")) - 1), lambda k: F.concat(F.array_join(F.slice(F.split("path", "/"), F.lit(1), k), "/"), F.when(k > 0, F.lit("/")).otherwise(F.lit(""))))
        # Spark's listing leaves out names with a leading dot, so the folders (not their files) are asked for the marker.
        dirs = [r["dir"] for r in files.select(F.explode(ups).alias("dir")).distinct().collect()]
        marked = spark.createDataFrame([(d,) for d in _having(spark, root, dirs, marker)], "dir string")
        hidden = files.select("path", F.explode(ups).alias("dir")).join(marked, "dir", "left_semi").select("path").distinct()
        files = files.join(hidden, "path", "left_anti")
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return files.select("path", text.alias("content")).filter(F.trim("content") != "")


def read_limited(text: Column, most: int = 3000) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("\n\n[truncated, "), F.length(text).cast("string"), F.lit(" chars total]"))).otherwise(F.coalesce(text, F.lit("[could not read file]")))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def embeddings_decoded(df: DataFrame, column: str = "embedding", dims: int | None = None) -> DataFrame:
    """Packed little-endian vectors (half, single or double precision, told apart by size) or JSON text to arrays of floats."""
    @F.pandas_udf("array<float>")
    def decode(blobs):
        import json

        import numpy as np

        def one(b):
            if b is None:
                return None
            b = bytes(b)
            if b[:1] == b"[":
                return [float(x) for x in json.loads(b)]
            kind = {2: "<f2", 4: "<f4", 8: "<f8"}.get(len(b) // dims if dims else 4, "<f4")
            return np.frombuffer(b, kind).astype(np.float32).tolist()

        return blobs.map(one)

    return df.withColumn(column, decode(F.col(column).cast("binary")))
