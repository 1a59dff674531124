"""The tables of an index: their schemas, where they lie, what they hold, migrations, and the stored postings of the full text."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import dot
from ..operators.fulltext import BUCKETS, STORED, trigram_postings
from .notes import embeddings_decoded

SCHEMAS = {
    "files": "path string, content_hash string, embedding array<float>, embedding_norm double, summary string, content string, indexed_at timestamp",
    "chunks": "file_path string, chunk_index int, heading string, content string, start_line int, end_line int, embedding array<float>, embedding_norm double",
    "entities": "id long, name string, type string, source_file string",
    "relations": "id long, source_entity string, relation string, target_entity string, source_file string, confidence double",
    "communities": "entity string, community_id long, community_size long, resolution double, modularity double, updated_at timestamp",
    "community_meta": "community_id long, size long, top_entities array<string>, relation_types map<string,bigint>, density double, resolution double, modularity double, updated_at timestamp",
    "catalysts": "entity string, type string, mentions long, questions array<string>, notes array<string>",
}
PENDING = "(pending)"


def schema(table: str) -> StructType:
    return StructType.fromDDL(SCHEMAS[table])


def folder_of(root: str, base: str, override: str | None = None) -> str:
    """Where the index of a root lies: the override, else a folder named by the first twelve signs of the root's hash."""
    return override or f"{base.rstrip('/')}/{hashlib.sha256(root.encode()).hexdigest()[:12]}"


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.exists(p)


def largest(spark: SparkSession, base: str) -> str | None:
    """The largest index under a base folder; of equally large ones the first by name."""
    p, fs = _fs(spark, base)
    if not fs.exists(p):
        return None
    found = [(-fs.getContentSummary(s.getPath()).getLength(), s.getPath().toString()) for s in fs.listStatus(p) if s.isDirectory()]
    return min(found)[1] if found else None


@dataclass
class Index:
    """Tables by name; a table that was never written is None."""

    spark: SparkSession
    folder: str

    def table(self, name: str) -> DataFrame | None:
        path = f"{self.folder}/{name}"
        return self.spark.read.schema(SCHEMAS[name]).parquet(path) if exists(self.spark, path) else None

    def write(self, name: str, rows: DataFrame) -> None:
        """Replace a table. Columns that it lacks are null, others are left out."""
        want = schema(name)
        kept = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in want])
        kept.write.mode("overwrite").parquet(f"{self.folder}/{name}.new")
        p, fs = _fs(self.spark, f"{self.folder}/{name}")
        fs.delete(p, True)
        fs.rename(_fs(self.spark, f"{self.folder}/{name}.new")[0], p)

    def status(self) -> dict[str, int | None]:
        """Rows of each table; None where there is no table."""
        found = {name: self.table(name) for name in SCHEMAS}
        return {name: None if t is None else t.count() for name, t in found.items()}


def migrated(files: DataFrame, dims: int | None = None) -> DataFrame:
    """An older table of files in today's schema: missing columns, packed or JSON embeddings to arrays, missing norms computed."""
    rows = files
    if "embedding" in rows.columns and not rows.schema["embedding"].dataType.typeName().startswith("array"):
        rows = embeddings_decoded(rows, "embedding", dims)
    want = schema("files")
    rows = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in want])
    norm = F.sqrt(dot(F.col("embedding"), F.col("embedding")))
    return rows.withColumn("embedding_norm", F.coalesce("embedding_norm", F.when(F.size("embedding") > 0, norm)))


# --- stored postings ---


def write_postings(files: DataFrame, folder: str, buckets: int = BUCKETS) -> None:
    """Documents (path, path_lc, dl, content) and postings (trigram, path), these in folders by hash of the trigram and sorted inside."""
    dl = F.least(F.greatest(F.length("content") - 2, F.lit(0)), F.lit(STORED - 2))
    docs = files.select("path", F.lower("path").alias("path_lc"), F.coalesce(dl, F.lit(0)).alias("dl"), F.left(F.col("content"), F.lit(STORED)).alias("content"))
    docs.write.mode("overwrite").parquet(f"{folder}/docs")
    posts = trigram_postings(docs).withColumn("bucket", F.pmod(F.xxhash64("trigram"), F.lit(buckets)).cast("int"))
    # Rebalanced: adaptive execution splits large buckets among tasks and joins small ones.
    posts.hint("rebalance", "bucket").sortWithinPartitions("bucket", "trigram").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings")


def postings_stale(spark: SparkSession, files: DataFrame, folder: str) -> bool:
    """Have the postings to be built again: are there none, or for less than nine tenths of the files?"""
    n = files.count()
    return n > 0 and (not exists(spark, f"{folder}/docs") or spark.read.parquet(f"{folder}/docs").count() < int(n * 0.9))
