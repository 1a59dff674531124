"""Vector search: cosine with a keyword bonus, chunk candidates, promotion of files by their best chunk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import dot, keyword_score
from ..session import ship


def query_vector(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def scored(rows: DataFrame, vector: list[float], query: str = "", weight: float = 0.15, embedding: str = "embedding", norm: str | None = None) -> DataFrame:
    """``score``: cosine with the query vector (0 for a zero vector) plus ``weight`` times the path's keyword score."""
    q = query_vector(vector)
    length = sum(x * x for x in vector) ** 0.5
    own = F.col(norm) if norm else F.sqrt(dot(F.col(embedding), F.col(embedding)))
    cos = F.when((own > 0) & F.lit(length > 0), dot(F.col(embedding), q) / (own * F.lit(length))).otherwise(F.lit(0.0))
    return rows.withColumn("score", cos + (weight * keyword_score(query, F.col("path")) if query.strip() else F.lit(0.0)))


def scored_blocks(rows: DataFrame, asked: DataFrame, embedding: str = "embedding", key: str = "path", top: int = 10, block: int = 8192) -> DataFrame:
    """(query, key, score, rank): the best rows for each of many query vectors (query, embedding), by matrix products of blocks.

    Queries and rows are dealt into blocks; each pair of blocks is one task's product, of which it keeps the best ``top`` for each query
    (with the ties of the last place); the final choice is a window over those. Scores are compared to nine places.
    """
    import numpy as np
    from pyspark.sql import Window as W

    ship(rows.sparkSession)
    n_rows, n_asked = (max(1, -(-x.count() // block)) for x in (rows, asked))
    place = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select(F.col(key).alias("k"), F.col(embedding).alias("e"), place(key, n_rows).alias("rb"), every(n_asked).alias("qb"))
    right = asked.select("query", F.col("embedding").alias("e"), place("query", n_asked).alias("qb"), every(n_rows).alias("rb"))

    def unit(column, n: int):
        x = np.array(column.to_pylist(), np.float64).reshape(n, -1)
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)

    def run(a, b):
        import pyarrow as pa

        a, b = a.combine_chunks(), b.combine_chunks()
        found = [[], [], []]
        if a.num_rows and b.num_rows:
            x, q = unit(a["e"], a.num_rows), unit(b["e"], b.num_rows)
            k = min(top, a.num_rows)
            for at in range(0, len(q), 256):
                s = np.round(x @ q[at : at + 256].T, 9)
                last = np.partition(s, -k, axis=0)[-k]
                i, j = np.nonzero(s >= last)
                for out, y in zip(found, (j + at, i, s[i, j]), strict=True):
                    out.append(y)
        j, i, s = (np.concatenate(y) if y else np.zeros(0) for y in found)
        take = lambda t, c, y: t[c].take(pa.array(y.astype(np.int64)))
        return pa.table({"query": take(b, "query", j), key: take(a, "k", i), "score": pa.array(s.astype(np.float64))})

    kinds = f"query {asked.schema['query'].dataType.simpleString()}, {key} {rows.schema[key].dataType.simpleString()}, score double"
    best = left.groupBy("rb", "qb").cogroup(right.groupBy("rb", "qb")).applyInArrow(run, kinds)
    w = W.partitionBy("query").orderBy(F.col("score").desc(), key)
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def best_chunks(chunks: DataFrame) -> DataFrame:
    """The best chunk of each file; of equally good ones the first."""
    top = F.max_by(F.struct("score", "chunk_index", "heading", "start_line", "end_line"), F.struct("score", (-F.col("chunk_index")).alias("i")))
    return chunks.groupBy("file_path").agg(top.alias("c")).select(F.col("file_path").alias("path"), F.col("c.score").alias("chunk_score"), F.col("c.chunk_index").alias("chunk_index"), F.col("c.heading").alias("chunk_heading"), F.col("c.start_line").alias("start_line"), F.col("c.end_line").alias("end_line"))


def promoted(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Files with the better of their own and their best chunk's score; a chunk must be strictly better. Unknown files count 0."""
    both = files.select("path", F.col("score").alias("file_score")).join(best_chunks(chunks), "path", "full_outer")
    better = F.coalesce(F.col("chunk_score") > F.coalesce("file_score", F.lit(0.0)), F.lit(False))
    kept = both.filter(F.col("file_score").isNotNull() | better)
    return kept.select("path", F.when(better, F.col("chunk_score")).otherwise(F.col("file_score")).alias("score"), F.when(better, F.col("chunk_index")).alias("chunk_index"), F.when(better, F.col("chunk_heading")).alias("chunk_heading"))


def chunk_candidates(files: DataFrame, chunks: DataFrame, most: int = 200) -> DataFrame:
    """Chunks of the ``most`` best files: the only ones that are scored."""
    top = files.orderBy(F.col("score").desc(), "path").limit(most).select(F.col("path").alias("file_path"))
    return chunks.join(F.broadcast(top), "file_path", "left_semi")  # at most ``most`` rows


def low_confidence(found: DataFrame, semantic: bool) -> DataFrame:
    """One row: is the best score or the spread of the best three too small? With fewer than three rows there is no spread."""
    top = found.orderBy(F.col("score").desc()).limit(3).agg(F.max("score").alias("top"), F.min("score").alias("third"), F.count("*").alias("n"))
    spread = F.col("top") - F.col("third")
    few = F.col("n") < 3
    weak = ((F.col("top") < 0.15) | (~few & (spread < 0.05))) if semantic else (~few & (spread < 0.003))
    return top.select("top", F.when(~few, spread).alias("spread"), F.coalesce((F.col("n") > 0) & weak, F.lit(False)).alias("low_confidence"))
