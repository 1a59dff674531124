"""Citations: urls of notes, their judgement, liveness through an injected fetcher, and roll-ups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import url_doubt, url_skip_reason
from ..session import ship

STATUSES = ("ok", "redirect", "not_found", "timeout", "error", "skipped", "hallucinated", "access_denied")
ISSUES = ("not_found", "timeout", "error", "hallucinated")


def extract_urls(notes: DataFrame) -> DataFrame:
    """(path, line_number, url): targets of links, then bare urls, line by line; the first occurrence of each url in a file."""
    lines = notes.select("path", F.posexplode(F.split("content", r"\r\n|[\n\r\x0B\f\x1C-\x1E\u0085  ]")).alias("i", "line"))
    linked = F.transform(F.regexp_extract_all("line", F.lit(r"\[[^\]]*\]\(([^)]+)\)"), F.lit(1)), lambda x: F.trim(x))
    bare = F.regexp_extract_all("line", F.lit(r"(?<!\()\b(https?://[^\s)\]\">]+)"), F.lit(1))
    each = lines.select("path", "i", F.posexplode(F.concat(linked, bare)).alias("j", "raw"))
    clean = each.withColumn("url", F.expr("trim(TRAILING '.,;:)' FROM raw)")).filter("url <> ''")
    first = clean.groupBy("path", "url").agg(F.min(F.struct("i", "j")).alias("at"))
    return first.select("path", (F.col("at.i") + 1).alias("line_number"), "url")


def judged(urls: DataFrame) -> DataFrame:
    """``status`` and ``reason``: skipped, hallucinated, or ``fetch`` for those to be looked up."""
    skip, doubt = url_skip_reason(F.col("url")), url_doubt(F.col("url"))
    return urls.withColumn("status", F.when(skip.isNotNull(), "skipped").when(doubt.isNotNull(), "hallucinated").otherwise("fetch")).withColumn("reason", F.coalesce(skip, doubt))


def reply_status(url: Column, head: Column, ranged: Column) -> Column:
    """Status of a HEAD reply and, where that was 405, of the ranged GET: structs of code, redirect (the final address) and failure.

    404 and 410 are not found, 403 is denied access (often a paywall), other codes from 400 on are errors. Another final address is a
    redirect, but for the one that a cookie check gives: same host and path, with a parameter ``error`` or ``cookies_not_supported``.
    """
    bare = lambda c: F.rtrim(c, F.lit("/"))
    host = lambda c: F.regexp_extract(c, r"^[^:/?#]+://([^/?#]*)", 1)
    path = lambda c: F.regexp_extract(c, r"^[^:/?#]+://[^/?#]*([^?#;]*)", 1)
    query = lambda c: F.regexp_extract(c, r"^[^?#]*\?([^#]*)", 1)
    moved = lambda r: r["redirect"].isNotNull() & (bare(r["redirect"]) != bare(url))
    final = head["redirect"]
    cookie = (host(final) == host(url)) & (path(final) == path(url)) & (query(final).rlike(r"(?:^|&)error=[^&]") | F.contains(query(final), F.lit("cookies_not_supported")))
    late = F.lower(head["failure"]).rlike("timed out|timeout")
    second = (
        F.when(ranged.isNull() | ranged["failure"].isNotNull(), "error")
        .when(ranged["code"] == 404, "not_found")
        .when(ranged["code"].isNull() | (ranged["code"] >= 400), "error")
        .when(moved(ranged), "redirect")
        .otherwise("ok")
    )
    return (
        F.when(head["failure"].isNotNull(), F.when(late, "timeout").otherwise("error"))
        .when(head["code"] == 405, second)
        .when(head["code"].isin(404, 410), "not_found")
        .when(head["code"] == 403, "access_denied")
        .when(head["code"].isNull() | (head["code"] >= 400), "error")
        .when(moved(head) & ~F.coalesce(cookie, F.lit(False)), "redirect")
        .otherwise("ok")
    )


_REPLY = "struct<code:int,redirect:string,failure:string>"


def checked(urls: DataFrame, fetcher: Callable[[str], dict], ranged: Callable[[str], dict] | None = None) -> DataFrame:
    """Looks up each distinct url once: ``fetcher`` gives code, redirect and failure of a HEAD, ``ranged`` of a GET, asked on 405."""
    ship(urls.sparkSession)
    rows = judged(urls)

    def ask(f, u: str) -> dict:
        try:
            r = f(u)
        except Exception as e:  # noqa: BLE001  a fetcher may fail in any way; its url is then an error
            r = {"failure": str(e)}
        return {k: r.get(k) for k in ("code", "redirect", "failure")}

    def run(batches):
        import pyarrow as pa

        kind = pa.struct([("code", pa.int32()), ("redirect", pa.string()), ("failure", pa.string())])
        for b in batches:
            asked = b.column(0).to_pylist()
            heads = [ask(fetcher, u) for u in asked]
            again = [ask(ranged, u) if ranged and h["code"] == 405 else None for u, h in zip(asked, heads, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(heads, kind), pa.array(again, kind)], ["url", "head", "ranged"])

    once = rows.filter("status = 'fetch'").select("url").distinct().mapInArrow(run, f"url string, head {_REPLY}, ranged {_REPLY}")
    last = F.coalesce("ranged", "head")
    found = once.select("url", reply_status(F.col("url"), F.col("head"), F.col("ranged")).alias("found"), last["code"].alias("code"), last["redirect"].alias("redirect_to"), last["failure"].alias("error_msg"))
    return rows.join(found, "url", "left").withColumn("status", F.coalesce("found", "status")).drop("found")


def rollup(rows: DataFrame, *by: str) -> DataFrame:
    """Counts by status, all urls and issues, for each file or all together."""
    n = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    return rows.groupBy(*by).agg(F.count("*").alias("urls"), *n, F.count_if(F.col("status").isin(*ISSUES)).alias("issues"))


def fixes(rows: DataFrame) -> DataFrame:
    """(path, line_number, url, replacement): redirects to follow, invented urls to remove (no replacement)."""
    return rows.filter(F.col("status").isin("redirect", "hallucinated")).select("path", "line_number", "url", F.when(F.col("status") == "redirect", F.col("redirect_to")).alias("replacement"))


def first_per_key(rows: DataFrame, key: str, *order: str) -> DataFrame:
    return rows.withColumn("_k", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter("_k = 1").drop("_k")
