"""Incremental ingestion: change detection, merges, pruning, chunk bookkeeping, normalisation and pruning of the graph tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab as V


def changes(stored: DataFrame, current: DataFrame) -> DataFrame:
    """(path, content_hash, change) of the current files: ``new``, ``changed`` or ``same`` against the stored hashes."""
    now = current.select("path", T.content_hash(F.col("content")).alias("content_hash"))
    old = stored.select("path", F.col("content_hash").alias("old"))
    kind = F.when(F.col("old").isNull(), "new").when(F.col("old") == F.col("content_hash"), "same").otherwise("changed")
    return now.join(old, "path", "left").select("path", "content_hash", kind.alias("change"))


def upserted(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """``new`` rows replace ``old`` ones of the same keys (ON CONFLICT DO UPDATE); of repeated new keys one row is kept."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new.dropDuplicates(list(keys)))


def pruned(rows: DataFrame, current: DataFrame, key: str = "path") -> DataFrame:
    """Rows whose file still exists."""
    return rows.join(current.select(F.col("path").alias(key)).distinct(), key, "left_semi")


def without_chunks(files: DataFrame, chunks: DataFrame) -> DataFrame:
    return files.join(chunks.select(F.col("file_path").alias("path")), "path", "left_anti")


def inserted(rows: DataFrame, *unique: str) -> DataFrame:
    """INSERT OR IGNORE: of the rows that share a unique key the one with the least id stays."""
    w = W.partitionBy(*unique).orderBy("id")
    return rows.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def normalized_relations(rows: DataFrame) -> DataFrame:
    """Relations renamed to the canonical set; of rows that become equal one that was canonical already stays, else the least id."""
    to = T.canonical_relation(F.col("relation"))
    out = rows.withColumn("_to", to)
    w = W.partitionBy("source_entity", "_to", "target_entity", "source_file").orderBy((F.col("relation") != F.col("_to")).cast("int"), "id")
    kept = out.withColumn("_k", F.row_number().over(w)).filter("_k = 1")
    return kept.withColumn("relation", F.col("_to")).drop("_to", "_k")


def normalization_counts(rows: DataFrame) -> DataFrame:
    """One row: relations, those renamed, those merged away, those without an entry in the map."""
    to = T.canonical_relation(F.col("relation"))
    known = F.lower(F.trim("relation")).isin(*V.RELATION_MAP)
    return rows.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("relation") != to).alias("changed"),
        (F.count("*") - F.count_distinct("source_entity", to, "target_entity", "source_file")).alias("merged"),
        F.count_if(~known).alias("unknown"),
    )


def dangling_relations(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations with an end that is no entity."""
    return _ends(relations, entities).filter("_a is null or _b is null").drop("_a", "_b")


def _ends(relations: DataFrame, entities: DataFrame) -> DataFrame:
    names = entities.select("name").distinct()
    a, b = names.select(F.col("name").alias("_a")), names.select(F.col("name").alias("_b"))
    return relations.join(a, F.col("source_entity") == F.col("_a"), "left").join(b, F.col("target_entity") == F.col("_b"), "left")


def orphan_entities(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Entities in no relation."""
    ends = relations.select(F.col("source_entity").alias("name")).union(relations.select("target_entity")).distinct()
    return entities.join(ends, "name", "left_anti")


def prune_orphans(entities: DataFrame, relations: DataFrame, to_fixpoint: bool = False) -> tuple[DataFrame, DataFrame]:
    """Both removals, judged on the state before either; a second run may find more, ``to_fixpoint`` makes it."""
    kept = _ends(relations, entities).filter("_a is not null and _b is not null").drop("_a", "_b")
    names = entities.join(orphan_entities(entities, relations).select("name").distinct(), "name", "left_anti")
    if to_fixpoint:
        return prune_orphans(names, kept)
    return names, kept


def extracted(raw: DataFrame, column: str = "answer") -> DataFrame:
    """``parsed``: entities and relations of models' JSON answers, each as JSON text; code fences and prose around the object go."""
    text = F.regexp_extract(F.regexp_replace(F.trim(column), r"(?m)^```\w*\s*$", ""), r"(?s)(\{.*\})", 1)
    return raw.withColumn("parsed", F.from_json(text, "entities array<string>, relations array<string>", {"mode": "PERMISSIVE"}))


def pruned_index(files: DataFrame, chunks: DataFrame, current: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files that still exist, and the chunks of those."""
    kept = pruned(files, current)
    return kept, pruned(chunks, kept, "file_path")


def without_orphans(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Chunks whose file is in the index."""
    return pruned(chunks, files, "file_path")


def rechunked(chunks: DataFrame, changed: DataFrame, new: DataFrame) -> DataFrame:
    """Chunks after some files have changed: all of theirs go, the new ones come, keyed by file and number."""
    rest = chunks.join(changed.select(F.col("path").alias("file_path")).distinct(), "file_path", "left_anti")
    return upserted(rest, new, "file_path", "chunk_index")


def unknown_relations(rows: DataFrame, most: int = 10) -> DataFrame:
    """(relation, n): the most frequent relations that the map of canonical ones lacks."""
    lacks = ~F.lower(F.trim("relation")).isin(*V.RELATION_MAP)
    return rows.filter(lacks).groupBy("relation").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "relation").limit(most)
