"""Full-text search: Okapi BM25 over substrings, conjunctive with a disjunctive fallback, in one scoring plan."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import overlapping_count

K1, B, STORED = 1.2, 0.75, 50_000
BUCKETS = 64  # folders of the stored postings


def query_words(query: str) -> list[str]:
    return [w for w in re.findall(r"\w+", query.lower()) if len(w) >= 3]


def _sum(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def _scored(base: DataFrame, stats: DataFrame, n: int, passed: Column, limit: int | None, mode: str) -> DataFrame:
    """Scores from (path, dl, f0, f1, ..) and one row of statistics: n_docs, avgdl, n_all, n0, n1, .."""
    has = [F.coalesce(F.col(f"f{i}") > 0, F.lit(False)) for i in range(n)]
    every, any_ = reduce(lambda a, b: a & b, has), reduce(lambda a, b: a | b, has)
    idf = [F.greatest(F.ln((F.col("n_docs") - F.col(f"n{i}") + 0.5) / (F.col(f"n{i}") + 0.5)), F.lit(1e-6)) for i in range(n)]
    norm = K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))
    score = _sum([F.when(h, i_ * F.col(f"f{i}") * (K1 + 1) / (F.col(f"f{i}") + norm)).otherwise(0.0) for i, (h, i_) in enumerate(zip(has, idf, strict=True))])
    wanted = {"and": every, "or": any_}.get(mode, F.when((F.col("n_all") < 3) & (F.lit(n) > 1), any_).otherwise(every))
    found = base.filter(any_ & passed).crossJoin(F.broadcast(stats)).filter(wanted).select("path", score.alias("score"))  # one row of statistics
    return ranked(found, limit)


def _counts_of(words: list[str], passed: Column) -> list[Column]:
    has = [F.coalesce(F.col(f"f{i}") > 0, F.lit(False)) for i in range(len(words))]
    return [F.count_if(reduce(lambda a, b: a & b, has) & passed).alias("n_all"), *[F.count_if(h).alias(f"n{i}") for i, h in enumerate(has)]]


def _frequencies(words: list[str], dl: Column) -> list[Column]:
    low = F.lower(F.left(F.col("content"), F.lit(STORED)))
    return ["path", dl.alias("dl"), *[overlapping_count(low, w).alias(f"f{i}") for i, w in enumerate(words)]]


def bm25(files: DataFrame, query: str, path_prefix: str | None = None, limit: int | None = 100, mode: str = "auto") -> DataFrame:
    """(path, score, rank) of the files that contain the query's words (of three letters or more, case folded).

    ``mode``: ``and``, ``or`` or ``auto``, which is ``and`` unless it finds fewer than three files for several words. Statistics are
    those of all files; the path filter and the limit come afterwards. A repeated word counts twice. Ties: by path. This reads every
    text; ``bm25_stored`` reads those that stored postings name.
    """
    words = query_words(query)
    if not words:
        return files.select("path", F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    base = files.select(*_frequencies(words, F.least(F.greatest(F.length("content") - 2, F.lit(0)), F.lit(STORED - 2))))
    passed = F.lower("path").startswith(path_prefix.lower()) if path_prefix else F.lit(True)
    stats = base.agg(F.count("*").alias("n_docs"), F.avg(F.coalesce("dl", F.lit(0))).alias("avgdl"), *_counts_of(words, passed))
    return _scored(base, stats, len(words), passed, limit, mode)


def bm25_stored(spark: SparkSession, folder: str, query: str, path_prefix: str | None = None, limit: int | None = 100, mode: str = "auto", buckets_of: int = BUCKETS) -> DataFrame:
    """As ``bm25``, over what ``write_postings`` has stored.

    The postings of the query's trigrams alone are read; a text is read if it has all trigrams of some word, and decides itself whether it
    has the word. Lengths come from a column of their own.
    """
    docs = spark.read.parquet(f"{folder}/docs")
    words = query_words(query)
    if not words:
        return docs.select("path", F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    grams = sorted({(w, w[i : i + 3]) for w in set(words) for i in range(len(w) - 2)})
    asked = spark.createDataFrame(grams, "word string, trigram string")
    posts = spark.read.parquet(f"{folder}/postings")
    buckets = [r["bucket"] for r in asked.select(F.pmod(F.xxhash64("trigram"), F.lit(buckets_of)).cast("int").alias("bucket")).distinct().collect()]  # of a query's trigrams
    met = posts.filter(F.col("bucket").isin(buckets) & F.col("trigram").isin([g for _, g in grams])).select("trigram", "path").join(F.broadcast(asked), "trigram")
    need = F.create_map(*[F.lit(x) for w in sorted(set(words)) for x in (w, len({g for v, g in grams if v == w}))])
    paths = met.groupBy("word", "path").agg(F.count("*").alias("n")).filter(F.col("n") == need[F.col("word")]).select("path").distinct()
    base = docs.join(paths, "path", "left_semi").select(*_frequencies(words, F.col("dl")))
    passed = F.lower("path").startswith(path_prefix.lower()) if path_prefix else F.lit(True)
    stats = docs.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl")).crossJoin(base.agg(*_counts_of(words, passed)))  # two single rows
    return _scored(base, stats, len(words), passed, limit, mode)


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``name``: the place of each row in the order, from 1 on, by ranges: places inside a range after the sizes of those before it."""
    from pyspark.sql import Window as W

    from ..sources.tables import staged

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = staged(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # a row for each range
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("n")).select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return dealt.join(F.broadcast(sizes), "_part").withColumn(name, F.col("_before") + inside).drop("_part", "_before")


def ranked(found: DataFrame, limit: int | None, *ties: Column) -> DataFrame:
    """The best rows with their rank; without a limit all rows are ranked, by ranges."""
    from pyspark.sql import Window as W

    order = [F.col("score").desc(), *(ties or (F.col("path"),))]
    if limit is None:
        return numbered(found, order, "rank")
    return found.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(W.orderBy(*order)))


def token_postings(rows: DataFrame, key: str, *texts: str) -> DataFrame:
    """(key, token, tf, dl) over several text columns, with ``\\w+`` tokens of the lower-cased text."""
    words = F.filter(F.split(F.lower(F.concat_ws(" ", *texts)), r"(?U)\W+"), lambda w: w != "")
    tokens = rows.select(F.col(key), words.alias("ws")).select(key, F.size("ws").alias("dl"), F.explode("ws").alias("token"))
    return tokens.groupBy(key, "token").agg(F.count("*").alias("tf"), F.max("dl").alias("dl"))


def token_search(rows: DataFrame, key: str, query: str, *texts: str, limit: int = 5) -> DataFrame:
    """BM25 over whole tokens, any of the query's words of more than two letters. Punctuation in the query is no error here."""
    words = sorted({w for w in re.findall(r"\w+", query.lower()) if len(w) > 2})
    length = F.size(F.filter(F.split(F.lower(F.concat_ws(" ", *texts)), r"(?U)\W+"), lambda w: w != ""))
    total = rows.agg(F.count("*").alias("n_docs"), F.avg(length).alias("avgdl"))
    posts = token_postings(rows, key, *texts).filter(F.col("token").isin(*words) if words else F.lit(False))
    df = posts.groupBy("token").agg(F.count("*").alias("n"))
    met = posts.join(F.broadcast(df), "token").crossJoin(F.broadcast(total))  # a row for each query word; one row of totals
    idf = F.greatest(F.ln((F.col("n_docs") - F.col("n") + 0.5) / (F.col("n") + 0.5)), F.lit(1e-6))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return ranked(met.groupBy(F.col(key).alias("path")).agg(F.sum(part).alias("score")), limit).withColumnRenamed("path", key)


def trigram_postings(files: DataFrame) -> DataFrame:
    """(trigram, path) of the lower-cased contents: prunes candidates, never decides."""
    last = F.length("content") - 3
    # Code points in one array that is bound to a name, so that it is made once for a text.
    grams = F.get(F.transform(F.array(F.split(F.lower("content"), "")), lambda c: F.array_distinct(F.transform(F.sequence(F.lit(0), last), lambda i: F.concat(F.get(c, i), F.get(c, i + 1), F.get(c, i + 2))))), F.lit(0))
    return files.filter(F.length("content") >= 3).select("path", F.explode(grams).alias("trigram")).filter(F.col("trigram").isNotNull())


def matching_terms(files: DataFrame, terms: list[str], limit: int | None = None) -> DataFrame:
    """Files whose content has the first term, with the share of all terms that it has; kept from half of them on."""
    low = F.lower("content")
    if not terms:
        return files.select("path", F.lit(0.0).alias("score")).limit(0)
    hits = _sum([F.when(F.contains(low, F.lit(t.lower())), 1).otherwise(0) for t in terms])
    found = files.filter(F.contains(low, F.lit(terms[0].lower()))).select("path", hits.alias("n")).filter(F.col("n") >= max(1, len(terms) // 2))
    found = found.select("path", (F.col("n") / len(terms)).alias("score"))
    return found.orderBy(F.col("score").desc(), "path").limit(limit) if limit else found
