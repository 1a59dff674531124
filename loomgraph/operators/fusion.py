"""Reciprocal-rank fusion of ranked lists, blends of scores by rank, budgets and diversity over ranked rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

K = 60


def fuse(lists: list[DataFrame], k: int = K, top: int | None = 10) -> DataFrame:
    """(path, score, rank): the sum of 1 / (k + rank) over the lists (path, rank). Ties: by descending path."""
    if not lists:
        raise ValueError("no lists")
    parts = reduce(DataFrame.unionByName, [x.select("path", (F.lit(1.0) / (k + F.col("rank"))).alias("s")) for x in lists])
    total = parts.groupBy("path").agg(F.sum("s").alias("score"))
    return _ranked(total, top, F.col("path").desc())


def fuse_passes(first: DataFrame, second: DataFrame, k: int = K, top: int | None = 10) -> DataFrame:
    """Two passes: as ``fuse``, but ties keep the order of the first pass, then of the second."""
    a = first.select("path", F.col("rank").alias("r"), F.lit(0).alias("pass"))
    b = second.select("path", F.col("rank").alias("r"), F.lit(1).alias("pass"))
    total = a.unionByName(b).groupBy("path").agg(F.sum(F.lit(1.0) / (k + F.col("r"))).alias("score"), F.min(F.struct("pass", "r")).alias("at"))
    return _ranked(total, top, F.col("at"), F.col("path")).drop("at")


def _ranked(rows: DataFrame, top: int | None, *ties: Column) -> DataFrame:
    order = [F.col("score").desc(), *ties]
    best = rows.orderBy(*order).limit(top) if top is not None else rows
    return best.withColumn("rank", F.row_number().over(W.orderBy(*order)))


def reranked(found: DataFrame, model_score: Column, top: int = 20) -> DataFrame:
    """Blend of the retrieval score (over the largest of the ``top``) and the model's score: .6/.4 for the first five, then .4/.6.

    Rows beyond ``top`` follow in their old order.
    """
    head = F.col("rank") <= top
    best = F.max(F.when(head, F.col("score"))).over(W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    share = F.when(best > 0, F.col("score") / best).otherwise(F.lit(0.0))
    w = F.when(F.col("rank") <= 5, 0.6).otherwise(0.4)
    out = found.withColumn("blend", F.when(head, w * share + (1 - w) * model_score))
    order = [F.when(head, 0).otherwise(1), F.col("blend").desc_nulls_last(), F.col("rank")]
    return out.withColumn("final_rank", F.row_number().over(W.orderBy(*order)))


def context(ranked: DataFrame, text: Column, most: int = 12_000, least: int = 200) -> DataFrame:
    """Entries ``### path`` with their texts up to ``most`` characters; the first that overflows is cut if over ``least`` remain."""
    head = F.concat(F.lit("### "), F.col("path"), F.lit("\n\n"))
    entry = F.concat(head, text)
    rows = ranked.select("rank", "path", entry.alias("entry"), F.length(entry).alias("n"), F.length(head).alias("h"))
    sofar = W.orderBy("rank").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("cum", F.sum("n").over(sofar)).withColumn("over", F.sum(F.when(F.col("cum") > most, 1).otherwise(0)).over(sofar))
    left = most - (F.col("cum") - F.col("n")) - F.col("h")
    kept = rows.filter((F.col("over") == 0) | ((F.col("over") == 1) & (left > least)))
    cut = F.when(F.col("over") == 0, F.col("entry")).otherwise(F.concat(F.left("entry", (F.col("h") + left).cast("int")), F.lit("\n[truncated]")))
    return kept.select("rank", "path", cut.alias("entry"), (F.col("over") > 0).alias("cut"))


def diversity(ranked: DataFrame, key: str, domains: str, score: str, most: int = 3, factor: float = 0.7) -> DataFrame:
    """``score`` times ``factor`` for rows one of whose domains stands in ``most`` earlier rows or more."""
    each = ranked.select(key, "rank", F.explode(F.array_distinct(domains)).alias("_d"))
    before = W.partitionBy("_d").orderBy("rank").rowsBetween(W.unboundedPreceding, -1)
    full = each.withColumn("_n", F.count("*").over(before)).groupBy(key).agg((F.max("_n") >= most).alias("penalized"))
    out = ranked.join(full, key, "left").withColumn("penalized", F.coalesce("penalized", F.lit(False)))
    return out.withColumn(score, F.when(F.col("penalized"), F.round(F.col(score) * factor, 3)).otherwise(F.col(score)))
