"""Benchmark decontamination (operator 9), in DataFrame functions only.

The benchmark's normalised windows form a hash set that is broadcast when its measured size is under a bound and joined by
shuffle beyond it. Each document is read once: its words, all its windows and one marker row per document go through the
join, and only the marker and the windows that hit leave it. The join compares the windows' words themselves, so a hit is
verified by the join. Spans or whole documents can be removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

N = 8
BROADCAST_BYTES = 32 << 20
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text: runs of digits, ASCII letters (lower-cased) and everything beyond ASCII."""
    return F.array_remove(F.split(C.ascii_lower(F.coalesce(text, F.lit(""))), _BREAK, -1), "")


def _windows(w: Column, length: int) -> Column:
    one = lambda i: F.struct(i.cast("int").alias("pos"), F.array_join(F.slice(w, i, length), " ").alias("w"))
    some = F.transform(F.sequence(F.lit(1), F.size(w) - (length - 1)), one)
    return F.when(F.size(w) >= length, some).otherwise(F.array().cast("array<struct<pos:int,w:string>>"))


def benchmark_windows(bench: DataFrame, n: int = N) -> DataFrame:
    """(w, len, item_id): the distinct windows of each item; an item of fewer words, but not none, is one window."""
    items = bench.select(F.col("item_id"), words(F.col("text").cast("string")).alias("ws")).filter(F.size("ws") > 0)
    short = items.filter(F.size("ws") < n).select("item_id", F.array_join("ws", " ").alias("w"), F.size("ws").alias("len"))
    full = items.filter(F.size("ws") >= n).select("item_id", F.explode(_windows(F.col("ws"), n)).alias("x")).select("item_id", F.col("x.w").alias("w"), F.lit(n).alias("len"))
    return full.unionByName(short).distinct()


def contamination(docs: DataFrame, bench: DataFrame, n: int = N, least_items: int = 2) -> DataFrame:
    """One row per input row: doc_id, key, n_words, n_hit, n_items, items_sha256, contaminated, hits (pos, len of each hit).

    A word inside any occurrence of a window is hit. Null and wordless texts have no words and no hits. Rows that repeat a
    doc_id are judged each by its own text. An empty benchmark hits nothing; items without words are ignored.
    """
    windows = C.staged(benchmark_windows(bench, n), "windows")
    lengths = sorted(r[0] for r in windows.select("len").distinct().collect())  # at most n numbers
    ids = windows.groupBy("w").agg(F.max("len").alias("len"))
    size = windows.agg(F.sum(F.octet_length("w") + 40)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        ids = F.broadcast(ids)
    text = F.col("text").cast("string")
    base = docs.select(F.col("doc_id"), F.xxhash64(text).alias("key"), words(text).alias("ws"))
    marker = F.array(F.struct(F.lit(0).alias("pos"), F.concat(F.lit(" "), F.col("key").cast("string")).alias("w")))
    rows = base.select("doc_id", "key", F.size("ws").alias("n_words"), F.explode(F.concat(marker, *[_windows(F.col("ws"), k) for k in lengths])).alias("x"))
    met = rows.select("doc_id", "key", "n_words", F.col("x.pos").alias("pos"), F.col("x.w").alias("w")).join(ids, "w", "left").filter("pos = 0 or len is not null")
    hit = F.when(F.col("pos") > 0, F.struct("pos", "len"))
    by_doc = met.groupBy("doc_id", "key").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.count_if(F.col("pos") == 0).alias("copies"),
        F.collect_set(hit).alias("hits"),
        F.collect_set(F.when(F.col("pos") > 0, F.col("w"))).alias("found"),
    )
    by_doc = C.staged(by_doc, "hits")
    items = by_doc.select("doc_id", "key", F.explode("found").alias("w")).join(windows.select("w", "item_id"), "w").select("doc_id", "key", F.col("item_id").cast("string").alias("item")).distinct()
    items = items.groupBy("doc_id", "key").agg(F.array_sort(F.collect_list("item")).alias("items"))
    d, i = by_doc.alias("d"), items.alias("i")
    out = d.join(i, (F.col("d.key") == F.col("i.key")) & F.col("d.doc_id").eqNullSafe(F.col("i.doc_id")), "left")
    out = out.select("d.doc_id", "d.key", "d.n_words", "d.hits", "d.copies", F.coalesce("i.items", F.array().cast("array<string>")).alias("items"))
    covered = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["pos"], h["pos"] + h["len"] - 1))))
    out = out.select("*", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("_one"))
    return out.select(
        "doc_id",
        "key",
        "n_words",
        F.size(covered).cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("items") >= least_items).alias("contaminated"),
        "hits",
    )


def without_spans(text: Column, hits: Column) -> Column:
    """The text without its hit words (with what separates them from the words before), in time in proportion to its words."""
    body = F.coalesce(text, F.lit(""))
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    bound = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))  # noqa: E731  computed once, not for each word

    def kept(both: Column) -> Column:
        covered = F.flatten(F.transform(hits, lambda h: F.sequence(h["pos"], h["pos"] + h["len"] - 1)))
        left = F.array_except(F.sequence(F.lit(1), F.size(both["ws"])), covered)
        pieces = F.transform(left, lambda i: F.concat(F.get(both["gaps"], i - 1), F.get(both["ws"], i - 1)))
        return F.concat(F.array_join(pieces, ""), F.element_at(both["gaps"], -1))

    both = F.struct(F.split(body, word, -1).alias("gaps"), F.regexp_extract_all(body, F.lit(word), F.lit(0)).alias("ws"))
    return F.when(F.size(hits) > 0, bound(both, kept)).otherwise(text)


def removed(docs: DataFrame, bench: DataFrame, n: int = N, spans: bool = False, least_items: int = 1) -> DataFrame:
    """The documents without those that hit ``least_items`` items or more, or, with ``spans``, all of them without their hit words.

    Null, empty and wordless texts hit nothing. Texts of any length are judged whole. Rows that repeat a doc_id are judged each by its
    own text, equal rows alike. Other columns may have any name. An empty table or an empty benchmark removes nothing.
    """
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    keyed = whole.select("row", F.col("row.doc_id").alias("row_id"), F.xxhash64(F.col("row.text").cast("string")).alias("row_key"))
    found = contamination(docs.select("doc_id", "text"), bench, n, least_items=least_items).filter("contaminated").select("doc_id", "key", "hits").dropDuplicates(["doc_id", "key"])
    on = F.col("row_id").eqNullSafe(F.col("doc_id")) & (F.col("row_key") == F.col("key"))
    if not spans:
        return keyed.join(found, on, "left_anti").select("row.*")
    out = keyed.join(found, on, "left")
    text = F.when(F.col("hits").isNotNull(), without_spans(F.col("row.text").cast("string"), F.col("hits"))).otherwise(F.col("row.text").cast("string"))
    return out.select(*[text.cast(docs.schema["text"].dataType).alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents with a window of any benchmark item go (op9's flag asks for two items); the others stay as they came.

    For nulls, long texts, repeated rows, ties, clashing columns and empty tables see ``removed``.
    """
    return removed(docs, C.table(spark, sf_dir, "benchmark"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark")).drop("key", "hits")


_ABC = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
SQL = rf"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), {_ABC}), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), {_ABC}), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(ws), 8) AS l, array_to_string(ws[i : i + least(len(ws), 8) - 1], ' ') AS w
       FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(len(ws), 8) + 2)) AS i FROM b WHERE len(ws) > 0)),
ls AS (SELECT DISTINCT l FROM bw),
dw AS (SELECT doc_id, l, i, array_to_string(ws[i : i + l - 1], ' ') AS w
       FROM (SELECT doc_id, ws, l, unnest(range(1, len(ws) - l + 2)) AS i FROM d, ls WHERE len(ws) >= l)),
h AS (SELECT dw.doc_id, dw.i, dw.l, bw.item_id FROM dw JOIN bw ON dw.w = bw.w),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(k, ',' ORDER BY k)) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items,
       coalesce(t.s, sha256('')) AS items_sha256, coalesce(t.n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
