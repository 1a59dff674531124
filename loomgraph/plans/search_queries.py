"""Registered queries: text search, vectors, fusion, chunks, ingestion, citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, citations, fulltext, fusion, ingest, search, vector
from ..sources.tables import view, with_views
from ..streaming.notes import event_windows

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = with_views(sql)
        return f

    return put


def _r(c, n: int = 6):
    return F.round(c, n)


# --- full text ---


def bm25_ctes(words: list[str], mode: str, tag: str = "", where: str = "TRUE") -> str:
    """``b{tag}``: path, score of all matching files; words must not overlap themselves."""
    low = "lower(left(content, 50000))"
    f = ", ".join(f"CAST((length({low}) - length(replace({low}, '{w}', ''))) / {len(w)} AS BIGINT) AS f{i}" for i, w in enumerate(words))
    n = len(words)
    every, any_ = " AND ".join(f"f{i} > 0" for i in range(n)), " OR ".join(f"f{i} > 0" for i in range(n))
    stats = ", ".join(f"count(*) FILTER (WHERE f{i} > 0) AS n{i}" for i in range(n))
    score = " + ".join(
        f"CASE WHEN f{i} > 0 THEN greatest(ln((nd - n{i} + 0.5::DOUBLE) / (n{i} + 0.5::DOUBLE)), 1e-6::DOUBLE) * f{i} * 2.2::DOUBLE / (f{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / av)) ELSE 0 END" for i in range(n)
    )
    wanted = {"and": f"({every})", "or": f"({any_})"}.get(mode, f"CASE WHEN na < 3 AND {n} > 1 THEN ({any_}) ELSE ({every}) END")
    return f"""t{tag} AS (SELECT path, least(greatest(length(content) - 2, 0), 49998) AS dl, {f} FROM {{files}}),
    s{tag} AS (SELECT count(*) AS nd, avg(dl) AS av, count(*) FILTER (WHERE ({every}) AND ({where})) AS na, {stats} FROM t{tag}),
    b{tag} AS (SELECT path, {score} AS score FROM t{tag}, s{tag} WHERE {wanted} AND ({where}))"""


def top_sql(tag: str, k: int) -> str:
    return f"SELECT path, score, row_number() OVER (ORDER BY score DESC, path) AS rank FROM b{tag} ORDER BY score DESC, path LIMIT {k}"


def _ranked(df: DataFrame) -> DataFrame:
    return df.select("path", _r("score").alias("score"), F.col("rank").cast("bigint").alias("rank"))


_OUT = "SELECT path, round(score, 6) AS score, CAST(rank AS BIGINT) AS rank FROM"


@query("bm25_and", f"WITH {bm25_ctes(['with', 'from'], 'and')} {_OUT} ({top_sql('', 20)})")
def bm25_and(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(fulltext.bm25(view(spark, d, "files"), "with from", limit=20, mode="and"))


@query("bm25_or_fallback", f"WITH {bm25_ctes(['apache', 'worthless', 'pathetic'], 'auto')} {_OUT} ({top_sql('', 20)})")
def bm25_or_fallback(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(fulltext.bm25(view(spark, d, "files"), "Apache worthless pathetic", limit=20))


@query("bm25_path_prefix", f"WITH {bm25_ctes(['with', 'from'], 'auto', where=chr(34) + 'path' + chr(34) + chr(32) + 'LIKE ' + chr(39) + 'src1/%' + chr(39))} {_OUT} ({top_sql('', 20)})")
def bm25_path_prefix(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(fulltext.bm25(view(spark, d, "files"), "with from", path_prefix="SRC1/", limit=20))


_KEYWORD = """(SELECT path, (CASE WHEN contains(lower(path), 'src1') OR len(list_filter(regexp_split_to_array(lower(path), '[/_. -]+'), lambda p: length(p) >= 4 AND left(p, 4) = 'src1')) > 0 THEN 1 ELSE 0 END
  + CASE WHEN contains(lower(path), 'en--1') THEN 1 ELSE 0 END) / 2.0::DOUBLE AS score FROM {files})"""


@query("keyword_score", f"SELECT path, round(score, 6) AS score FROM {_KEYWORD} WHERE score > 0")
def keyword_score(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "files").select("path", _r(T.keyword_score("src1 en--1", F.col("path"))).alias("score")).filter("score > 0")


@query("path_prefix_filter", "SELECT path, summary FROM {files} WHERE starts_with(lower(path), 'src3/en')")
def path_prefix_filter(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "files").filter(F.lower("path").startswith("src3/en")).select("path", "summary")


@query("match_ratio_grep", """SELECT path, round(n / 3.0::DOUBLE, 6) AS score FROM (SELECT path, 1 + CASE WHEN contains(lower(content), 'licens') THEN 1 ELSE 0 END + CASE WHEN contains(lower(content), 'worthless') THEN 1 ELSE 0 END AS n
  FROM {files} WHERE contains(lower(content), 'version')) WHERE n >= 1""")
def match_ratio_grep(spark: SparkSession, d: str) -> DataFrame:
    return fulltext.matching_terms(view(spark, d, "files"), ["Version", "licens", "worthless"]).select("path", _r("score").alias("score"))


@query("trigram_candidates", """SELECT trigram, count(*) AS files FROM (SELECT DISTINCT path, substring(lower(content), i, 3) AS trigram FROM (SELECT path, content, unnest(range(1, length(content) - 1)) AS i FROM {files} WHERE length(content) >= 3))
  WHERE trigram IN ('apa', 'wor', 'ver', 'xyz') GROUP BY trigram""")
def trigram_candidates(spark: SparkSession, d: str) -> DataFrame:
    return fulltext.trigram_postings(view(spark, d, "files")).filter(F.col("trigram").isin("apa", "wor", "ver", "xyz")).groupBy("trigram").agg(F.count("*").alias("files"))


# --- vectors ---


def _vector(spark: SparkSession, d: str, vec_id: int) -> list[float]:
    return list(view(spark, d, "embeddings").filter(F.col("vec_id") == vec_id).first()["embedding"])


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "embeddings").select("vec_id", "label", "embedding", F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("path"))


_COS = "list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"


@query("cosine_topk", f"SELECT e.vec_id, round({_COS}, 6) AS score FROM {{embeddings}} e, {{embeddings}} q WHERE q.vec_id = 3 ORDER BY {_COS} DESC, e.vec_id LIMIT 20")
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    found = vector.scored(_vectors(spark, d), _vector(spark, d, 3))
    return found.orderBy(F.col("score").desc(), "vec_id").limit(20).select("vec_id", _r("score").alias("score"))


@query("cosine_batch_topk", f"""SELECT query, vec_id, round(score, 6) AS score, CAST(rank AS BIGINT) AS rank FROM (SELECT q.vec_id AS query, e.vec_id, {_COS} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_COS}, 9) DESC, e.vec_id) AS rank
  FROM {{embeddings}} e, {{embeddings}} q WHERE q.vec_id % 20 = 0) WHERE rank <= 10""")
def cosine_batch_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = _vectors(spark, d)
    asked = rows.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), "embedding")  # the stated query set, against all rows
    return vector.scored_blocks(rows, asked, key="vec_id", top=10).select("query", "vec_id", _r("score").alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query("best_chunk_promote", f"""WITH f AS (SELECT concat('l', CAST(e.label AS VARCHAR)) AS path, max({_COS}) * 0.9::DOUBLE AS s FROM {{embeddings}} e, {{embeddings}} q WHERE q.vec_id = 3 AND e.vec_id % 2 = 0 GROUP BY e.label),
  c AS (SELECT concat('l', CAST(e.label AS VARCHAR)) AS path, {_COS} AS s, e.vec_id AS i FROM {{embeddings}} e, {{embeddings}} q WHERE q.vec_id = 3 AND e.vec_id % 2 = 1),
  b AS (SELECT path, arg_max(i, (s, -i)) AS i, max(s) AS s FROM c GROUP BY path)
  SELECT path, round(CASE WHEN b.s > coalesce(f.s, 0) THEN b.s ELSE f.s END, 6) AS score, CASE WHEN b.s > coalesce(f.s, 0) THEN b.i END AS chunk_index FROM f FULL JOIN b USING (path) WHERE f.s IS NOT NULL OR b.s > 0""")
def best_chunk_promote(spark: SparkSession, d: str) -> DataFrame:
    rows = vector.scored(_vectors(spark, d), _vector(spark, d, 3)).withColumn("path", F.concat(F.lit("l"), F.col("label").cast("string")))
    files = rows.filter("vec_id % 2 = 0").groupBy("path").agg((F.max("score") * 0.9).alias("score"))
    none = F.lit(None)
    chunks = rows.filter("vec_id % 2 = 1").select(F.col("path").alias("file_path"), "score", F.col("vec_id").alias("chunk_index"), none.cast("string").alias("heading"), none.cast("int").alias("start_line"), none.cast("int").alias("end_line"))
    return vector.promoted(files, chunks).select("path", _r("score").alias("score"), "chunk_index")


@query("low_confidence", f"""SELECT round(max(s), 6) AS top, round(max(s) - min(s), 6) AS spread, max(s) < 0.15 OR max(s) - min(s) < 0.05 AS low_confidence FROM (SELECT {_COS} AS s FROM {{embeddings}} e, {{embeddings}} q WHERE q.vec_id = 3 ORDER BY s DESC LIMIT 3)""")
def low_confidence(spark: SparkSession, d: str) -> DataFrame:
    return vector.low_confidence(vector.scored(_vectors(spark, d), _vector(spark, d, 3)), True).select(_r("top").alias("top"), _r("spread").alias("spread"), "low_confidence")


# --- fusion ---

_SEMANTIC = f"""m AS (SELECT f.path, {_COS} AS score FROM {{embeddings}} e, {{embeddings}} q, {{files}} f WHERE q.vec_id = 3 AND f.doc_id = e.vec_id),
  mr AS (SELECT path, row_number() OVER (ORDER BY score DESC, path) AS rank FROM m)"""


def _semantic(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "embeddings").join(view(spark, d, "files"), F.col("vec_id") == F.col("doc_id")).select("path", "embedding")
    return fulltext.ranked(vector.scored(rows, _vector(spark, d, 3)).select("path", "score"), None)


@query("hybrid_rrf", f"""WITH {_SEMANTIC}, {bm25_ctes(['with', 'from'], 'auto')}, br AS ({top_sql('', 50)}),
  u AS (SELECT path, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (SELECT path, rank FROM mr UNION ALL SELECT path, rank FROM br) GROUP BY path)
  {_OUT} (SELECT path, score, row_number() OVER (ORDER BY score DESC, path DESC) AS rank FROM u ORDER BY score DESC, path DESC LIMIT 20)""")
def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(fusion.fuse([_semantic(spark, d), fulltext.bm25(view(spark, d, "files"), "with from", limit=50)], top=20))


@query("multi_rrf", f"""WITH {_SEMANTIC}, {bm25_ctes(['with', 'from'], 'auto')}, {bm25_ctes(['apache'], 'auto', '2')}, br AS ({top_sql('', 40)}), cr AS ({top_sql('2', 40)}),
  u AS (SELECT path, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (SELECT path, rank FROM mr UNION ALL SELECT path, rank FROM br UNION ALL SELECT path, rank FROM cr) GROUP BY path)
  {_OUT} (SELECT path, score, row_number() OVER (ORDER BY score DESC, path DESC) AS rank FROM u ORDER BY score DESC, path DESC LIMIT 10)""")
def multi_rrf(spark: SparkSession, d: str) -> DataFrame:
    files = view(spark, d, "files")
    return _ranked(fusion.fuse([_semantic(spark, d), fulltext.bm25(files, "with from", limit=40), fulltext.bm25(files, "apache", limit=40)], top=10))


@query("two_pass_rrf", f"""WITH {bm25_ctes(['with', 'from'], 'auto')}, {bm25_ctes(['with', 'from', 'version'], 'or', '2')}, x AS ({top_sql('', 20)}), y AS ({top_sql('2', 20)}),
  u AS (SELECT path, sum(1.0::DOUBLE / (60 + rank)) AS score, min((p, rank)) AS place FROM (SELECT path, rank, 0 AS p FROM x UNION ALL SELECT path, rank, 1 FROM y) GROUP BY path)
  {_OUT} (SELECT path, score, row_number() OVER (ORDER BY score DESC, place) AS rank FROM u ORDER BY score DESC, place LIMIT 10)""")
def two_pass_rrf(spark: SparkSession, d: str) -> DataFrame:
    files = view(spark, d, "files")
    return _ranked(fusion.fuse_passes(fulltext.bm25(files, "with from", limit=20), fulltext.bm25(files, "with from version", limit=20, mode="or"), top=10))


_MODEL = "(((doc_id * 7919) % 1000) / 1000.0::DOUBLE)"


@query("rerank_blend", f"""WITH {bm25_ctes(['with', 'from'], 'auto')}, x AS ({top_sql('', 40)}),
  y AS (SELECT x.*, {_MODEL} AS m, (SELECT max(score) FROM x WHERE rank <= 20) AS best FROM x JOIN {{files}} USING (path)),
  z AS (SELECT *, CASE WHEN rank <= 20 THEN CASE WHEN rank <= 5 THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END * score / best + CASE WHEN rank <= 5 THEN 0.4::DOUBLE ELSE 0.6::DOUBLE END * m END AS blend FROM y)
  SELECT path, round(blend, 6) AS blend, row_number() OVER (ORDER BY CASE WHEN rank <= 20 THEN 0 ELSE 1 END, blend DESC NULLS LAST, rank) AS final_rank FROM z""")
def rerank_blend(spark: SparkSession, d: str) -> DataFrame:
    files = view(spark, d, "files")
    found = fulltext.bm25(files, "with from", limit=40).join(files.select("path", "doc_id"), "path")
    out = fusion.reranked(found, ((F.col("doc_id") * 7919) % 1000) / F.lit(1000.0), 20)
    return out.select("path", _r("blend").alias("blend"), F.col("final_rank").cast("bigint").alias("final_rank"))


@query("context_budget", f"""WITH {bm25_ctes(['with', 'from'], 'auto')}, x AS ({top_sql('', 15)}),
  e AS (SELECT rank, path, concat('### ', path, chr(10), chr(10), content) AS entry, length(path) + 6 AS h FROM x JOIN {{files}} USING (path)),
  c AS (SELECT *, sum(length(entry)) OVER (ORDER BY rank) AS cum FROM e),
  o AS (SELECT *, sum(CASE WHEN cum > 12000 THEN 1 ELSE 0 END) OVER (ORDER BY rank) AS over, 12000 - (cum - length(entry)) - h AS rest FROM c)
  SELECT CAST(rank AS BIGINT) AS rank, path, md5(CASE WHEN over = 0 THEN entry ELSE concat(left(entry, CAST(h + rest AS BIGINT)), chr(10), '[truncated]') END) AS entry_md5, over > 0 AS cut FROM o WHERE over = 0 OR (over = 1 AND rest > 200)""")
def context_budget(spark: SparkSession, d: str) -> DataFrame:
    files = view(spark, d, "files")
    found = fulltext.bm25(files, "with from", limit=15).join(files.select("path", "content"), "path")
    return fusion.context(found, F.col("content")).select(F.col("rank").cast("bigint").alias("rank"), "path", F.md5("entry").alias("entry_md5"), "cut")


@query("snippet_window", """SELECT path, snippet FROM (SELECT path, CASE WHEN length(content) <= 500 THEN left(content, 400) WHEN best.n > 0 THEN substring(content, CAST(1 - best.pos AS BIGINT), 400) ELSE summary END AS snippet
  FROM (SELECT path, content, summary, list_max(list_transform(range(0, greatest(0, length(content) - 400) + 1, 100), lambda s: {{'n': CASE WHEN contains(substring(lower(content), s + 1, 400), 'with') THEN 1 ELSE 0 END + CASE WHEN contains(substring(lower(content), s + 1, 400), 'apache') THEN 1 ELSE 0 END, 'pos': -s}})) AS best FROM {files}))""")
def snippet_window(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "files").select("path", T.snippet(F.col("content"), F.col("summary"), ["with", "apache"]).alias("snippet"))


@query("iterative_search")
def iterative_search(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(search.iterative(view(spark, d, "notes"), "with from", top=10))


@query("typed_search")
def typed_search(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.models import hashed_embedder

    files = view(spark, d, "embeddings").join(view(spark, d, "files"), F.col("vec_id") == F.col("doc_id")).select("path", "content", "summary", "embedding")
    return _ranked(search.search(files, 'lex:version vec:"the apache license" with', hashed_embedder(64), top=10))


@query("expansion_terms")
def expansion_terms(spark: SparkSession, d: str) -> DataFrame:
    notes = view(spark, d, "notes")
    return search.expansion_terms(fulltext.bm25(notes, "with from", limit=20), notes, "with from")


@query("diversity_slots", """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank, round(n_chars / 40000.0::DOUBLE, 3) AS score, source, lang FROM {documents}),
  e AS (SELECT doc_id, rank, source AS x FROM r UNION SELECT doc_id, rank, lang FROM r), n AS (SELECT doc_id, count(*) OVER (PARTITION BY x ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS k FROM e),
  p AS (SELECT doc_id, max(k) >= 3 AS penalized FROM n GROUP BY doc_id)
  SELECT doc_id, CASE WHEN penalized THEN round(score * 0.7::DOUBLE, 3) ELSE score END AS score, penalized FROM r JOIN p USING (doc_id)""")
def diversity_slots(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    rows = view(spark, d, "documents").select("doc_id", F.round(F.col("n_chars") / F.lit(40000.0), 3).alias("score"), F.array("source", "lang").alias("domains"), F.row_number().over(W.orderBy(F.col("n_chars").desc(), "doc_id")).alias("rank"))
    return fusion.diversity(rows, "doc_id", "domains", "score").select("doc_id", "score", "penalized")


# --- chunks and ingestion ---


@query("code_chunks", """WITH c AS (SELECT path, content, unnest(range(0, CASE WHEN length(content) <= 2000 THEN 1 ELSE CAST(ceil((length(content) - 300) / 1700.0::DOUBLE) AS BIGINT) END)) AS i FROM {files} WHERE length(content) > 0),
  p AS (SELECT path, i, substring(content, i * 1700 + 1, 2000) AS piece, length(left(content, i * 1700)) - length(replace(left(content, i * 1700), chr(10), '')) + 1 AS a FROM c)
  SELECT path, i AS chunk_index, md5(piece) AS chunk_md5, a AS start_line, a + length(piece) - length(replace(piece, chr(10), '')) AS end_line FROM p""")
def code_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.code_chunks(view(spark, d, "files")).select("path", F.col("chunk_index").cast("bigint").alias("chunk_index"), F.md5("content").alias("chunk_md5"), F.col("start_line").cast("bigint").alias("start_line"), F.col("end_line").cast("bigint").alias("end_line"))


@query("markdown_chunks")
def markdown_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.note_chunks(view(spark, d, "notes"))


@query("chunk_router", "SELECT path, CASE WHEN length(content) <= 8000 THEN 'whole' ELSE 'chunks' END AS kind FROM {files}")
def chunk_router(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "files").select("path", F.when(F.length("content") <= chunking.WHOLE, "whole").otherwise("chunks").alias("kind"))


_OLD = "SELECT path, left(sha256(CASE WHEN doc_id % 10 = 0 THEN concat(content, '!') ELSE content END), 16) AS content_hash FROM {files} WHERE doc_id % 7 <> 0"


def _stored(spark: SparkSession, d: str) -> DataFrame:
    files = view(spark, d, "files").filter("doc_id % 7 <> 0")
    return files.select("path", T.content_hash(F.when(F.col("doc_id") % 10 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content"))).alias("content_hash"))


@query("content_hash_changes", f"""WITH o AS ({_OLD}), n AS (SELECT path, left(sha256(content), 16) AS h FROM {{files}})
  SELECT n.path, h AS content_hash, CASE WHEN o.path IS NULL THEN 'new' WHEN o.content_hash = h THEN 'same' ELSE 'changed' END AS change FROM n LEFT JOIN o ON n.path = o.path""")
def content_hash_changes(spark: SparkSession, d: str) -> DataFrame:
    return ingest.changes(_stored(spark, d), view(spark, d, "files"))


@query("upsert_files", f"""WITH o AS ({_OLD}), n AS (SELECT path, left(sha256(content), 16) AS content_hash FROM {{files}} WHERE doc_id % 5 = 0)
  SELECT path, content_hash FROM o WHERE path NOT IN (SELECT path FROM n) UNION ALL SELECT path, content_hash FROM n""")
def upsert_files(spark: SparkSession, d: str) -> DataFrame:
    new = view(spark, d, "files").filter("doc_id % 5 = 0").select("path", T.content_hash(F.col("content")).alias("content_hash"))
    return ingest.upserted(_stored(spark, d), new, "path")


@query("prune_missing", f"WITH o AS ({_OLD}) SELECT path, content_hash FROM o WHERE path IN (SELECT path FROM {{files}} WHERE doc_id % 3 <> 0)")
def prune_missing(spark: SparkSession, d: str) -> DataFrame:
    return ingest.pruned(_stored(spark, d), view(spark, d, "files").filter("doc_id % 3 <> 0"))


@query("files_without_chunks", "SELECT path FROM {files} WHERE path NOT IN (SELECT path FROM {files} WHERE length(content) > 2000)")
def files_without_chunks(spark: SparkSession, d: str) -> DataFrame:
    files = view(spark, d, "files")
    made = chunking.code_chunks(files.filter(F.length("content") > 2000)).select(F.col("path").alias("file_path"))
    return ingest.without_chunks(files.select("path"), made)


@query("index_status", "SELECT count(*) AS files, count(DISTINCT split_part(path, '/', 1)) AS sources, sum(length(content)) AS characters FROM {files}")
def index_status(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "files").agg(F.count("*").alias("files"), F.count_distinct(F.get(F.split("path", "/"), F.lit(0))).alias("sources"), F.sum(F.length("content")).alias("characters"))


@query("event_windows", "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM {events} GROUP BY 1, 2")
def events_by_day(spark: SparkSession, d: str) -> DataFrame:
    return event_windows(view(spark, d, "events")).withColumn("total", F.round("total", 2))


# --- citations ---


@query("extract_urls", r"""WITH l AS (SELECT doc_id, path, generate_subscripts(string_split(content, chr(10)), 1) AS n, unnest(string_split(content, chr(10))) AS line FROM {notes}),
  u AS (SELECT path, n, unnest(regexp_extract_all(line, '\]\(([^)]+)\)', 1)) AS url FROM l UNION ALL SELECT path, n, unnest(regexp_extract_all(line, '[^(](https?://[^\s)\]">]+)', 1)) FROM l)
  SELECT path, min(n) AS line_number, regexp_replace(trim(url), '[.,;:)]+$', '') AS url FROM u GROUP BY path, regexp_replace(trim(url), '[.,;:)]+$', '')""")
def extract_urls(spark: SparkSession, d: str) -> DataFrame:
    return citations.extract_urls(view(spark, d, "notes")).withColumn("line_number", F.col("line_number").cast("bigint"))


_URLS = """u AS (SELECT page_id, url FROM {pages} UNION ALL SELECT page_id + 1000000, concat('https://arxiv.org/abs/', lpad(CAST(page_id % 30 AS VARCHAR), 2, '0'), lpad(CAST(page_id % 15 AS VARCHAR), 2, '0'), '.12345') FROM {pages}
  UNION ALL SELECT page_id + 2000000, concat(CASE page_id % 5 WHEN 0 THEN 'ftp://h.org/' WHEN 1 THEN 'http://localhost:80/' WHEN 2 THEN 'https://doi.org/10.1234/' WHEN 3 THEN 'https://h.org/0000000' ELSE 'notes/' END, CASE WHEN page_id % 5 = 3 THEN '' ELSE CAST(page_id AS VARCHAR) END) FROM {pages}),
  j AS (SELECT page_id, url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS s, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) AS h, regexp_extract(url, '(?i)arxiv\\.org/(?:abs|html|pdf|src)/(\\d{{4}}\\.\\d{{4,5}}(?:v\\d+)?)', 1) AS a FROM u),
  k AS (SELECT page_id, url, CASE WHEN s IN ('file', 'mailto', 'ftp') THEN concat('skipped (', s, ':// scheme)') WHEN NOT starts_with(s, 'http') THEN concat('skipped (non-http scheme: ', s, ')') WHEN h IN ('localhost', '127.0.0.1', '0.0.0.0') THEN concat('skipped (local address: ', h, ')') END AS skip,
    CASE WHEN regexp_matches(url, '(?i)example\\.com|placeholder|your-?url|INSERT|FIXME|TODO|<[^>]+>') THEN 'URL contains placeholder text' WHEN regexp_matches(url, '/(0{{6,}}|1234567890|9876543210)([/?#]|$)') THEN 'URL contains suspiciously round/sequential ID'
      WHEN regexp_matches(url, '(?i)arxiv\\.org') AND a = '' THEN 'arxiv URL missing valid YYMM.NNNNN ID' WHEN a <> '' AND CAST(substring(a, 3, 2) AS INT) NOT BETWEEN 1 AND 12 THEN concat('arxiv ID has invalid month: ', a)
      WHEN a <> '' AND CAST(substring(a, 1, 2) AS INT) > 26 THEN concat('arxiv ID year ', CAST(CAST(substring(a, 1, 2) AS INT) AS VARCHAR), ' is in the future: ', a) WHEN regexp_matches(url, '(?i)doi\\.org/(10\\.(XXXX|0000|1234)\\b|.*placeholder|.*example)') THEN 'DOI URL contains placeholder publisher code' END AS doubt FROM j),
  v AS (SELECT page_id, url, CASE WHEN skip IS NOT NULL THEN 'skipped' WHEN doubt IS NOT NULL THEN 'hallucinated' ELSE 'fetch' END AS status, coalesce(skip, doubt) AS reason FROM k)"""


def _urls(spark: SparkSession, d: str) -> DataFrame:
    p = view(spark, d, "pages").select("page_id", "url")
    i = F.col("page_id")
    two = lambda n: F.lpad((i % n).cast("string"), 2, "0")
    papers = p.select((i + 1000000).alias("page_id"), F.concat(F.lit("https://arxiv.org/abs/"), two(30), two(15), F.lit(".12345")).alias("url"))
    start = F.element_at(F.array(*[F.lit(x) for x in ("ftp://h.org/", "http://localhost:80/", "https://doi.org/10.1234/", "https://h.org/0000000", "notes/")]), (i % 5 + 1).cast("int"))
    odd = p.select((i + 2000000).alias("page_id"), F.concat(start, F.when(i % 5 == 3, F.lit("")).otherwise(i.cast("string"))).alias("url"))
    return p.unionByName(papers).unionByName(odd)


@query("classify_urls", f"WITH {_URLS} SELECT page_id, url, status, reason FROM v")
def classify_urls(spark: SparkSession, d: str) -> DataFrame:
    return citations.judged(_urls(spark, d))


@query("citation_rollup", f"""WITH {_URLS} SELECT page_id % 10 AS path, count(*) AS urls, 0::BIGINT AS ok, 0::BIGINT AS redirect, 0::BIGINT AS not_found, 0::BIGINT AS timeout, 0::BIGINT AS error, count(*) FILTER (WHERE status = 'skipped') AS skipped, count(*) FILTER (WHERE status = 'hallucinated') AS hallucinated, 0::BIGINT AS access_denied, count(*) FILTER (WHERE status = 'hallucinated') AS issues FROM v GROUP BY 1""")
def citation_rollup(spark: SparkSession, d: str) -> DataFrame:
    return citations.rollup(citations.judged(_urls(spark, d)).withColumn("path", F.col("page_id") % 10), "path")


def _reply(url: str) -> dict:
    """Made-up replies by the url's length."""
    cookie = {"code": 200, "redirect": url.split("#")[0].split("?")[0] + "?error=cookies"}
    replies = [{"code": 200}, {"code": 404}, {"code": 403}, {"code": 200, "redirect": "https://elsewhere.org/"}, {"failure": "timed out"}, {"failure": "refused"}, {"code": 500}, {"code": 401}, {"code": 405}, cookie, {"code": 410}]
    return replies[len(url) % 11]


def _second(url: str) -> dict:
    return [{"code": 206}, {"code": 410}, {"code": 404}, {"failure": "timed out"}][len(url) // 11 % 4]


@query("citation_liveness", f"""WITH {_URLS}, s AS (SELECT CASE WHEN status <> 'fetch' THEN status ELSE CASE length(url) % 11 WHEN 0 THEN 'ok' WHEN 1 THEN 'not_found' WHEN 2 THEN 'access_denied' WHEN 3 THEN 'redirect' WHEN 4 THEN 'timeout' WHEN 5 THEN 'error' WHEN 6 THEN 'error' WHEN 7 THEN 'error'
    WHEN 8 THEN CASE length(url) // 11 % 4 WHEN 0 THEN 'ok' WHEN 2 THEN 'not_found' ELSE 'error' END WHEN 9 THEN 'ok' ELSE 'not_found' END END AS status FROM v)
  SELECT count(*) AS urls, {", ".join(f"count(*) FILTER (WHERE status = '{x}') AS {x}" for x in citations.STATUSES)}, count(*) FILTER (WHERE status IN ('not_found', 'timeout', 'error', 'hallucinated')) AS issues FROM s""")
def citation_liveness(spark: SparkSession, d: str) -> DataFrame:
    return citations.rollup(citations.checked(_urls(spark, d), _reply, _second))
