"""Registered queries: stored postings, summaries, extraction, stored communities, details of neighbourhoods, upkeep of chunks."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..operators import assistant, chunking, communities, extraction, fulltext, fusion, ingest, models, search
from ..sources import index
from ..sources.notes import read_limited
from ..sources.tables import shared_dir, staged, view, with_views
from .graph_queries import _MERGED, _case, _graph
from .search_queries import _OUT, _ranked, bm25_ctes, top_sql

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = with_views(sql)
        return f

    return put


_FOLDERS: dict[tuple[str, str], str] = {}


def _postings(spark: SparkSession, d: str) -> str:
    """The stored postings of the files of a folder, written once for each application."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _FOLDERS:
        _FOLDERS[key] = f"{shared_dir(spark)}/postings-{uuid.uuid4().hex}"
        index.write_postings(view(spark, d, "files"), _FOLDERS[key])
    return _FOLDERS[key]


@query("bm25_stored", f"WITH {bm25_ctes(['apache', 'worthless', 'pathetic'], 'auto')} {_OUT} ({top_sql('', 20)})")
def bm25_stored(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(fulltext.bm25_stored(spark, _postings(spark, d), "Apache worthless pathetic", limit=20))


@query("bm25_stored_prefix", f"WITH {bm25_ctes(['with', 'version'], 'auto', where=chr(34) + 'path' + chr(34) + ' LIKE ' + chr(39) + 'src1/%' + chr(39))} {_OUT} ({top_sql('', 20)})")
def bm25_stored_prefix(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(fulltext.bm25_stored(spark, _postings(spark, d), "with version", path_prefix="SRC1/", limit=20))


@query("second_pass_only", f"WITH {bm25_ctes(['with', 'from'], 'auto')}, {bm25_ctes(['with', 'from', 'version'], 'or', '2')}, x AS ({top_sql('', 20)}), y AS ({top_sql('2', 20)}) SELECT path, CAST(rank AS BIGINT) AS rank FROM y WHERE path NOT IN (SELECT path FROM x)")
def second_pass_only(spark: SparkSession, d: str) -> DataFrame:
    files = view(spark, d, "files")
    found = assistant.second_pass_only(fulltext.bm25(files, "with from", limit=20), fulltext.bm25(files, "with from version", limit=20, mode="or"))
    return found.select("path", F.col("rank").cast("bigint").alias("rank"))


@query("index_folders", "SELECT path, concat('/base/', left(sha256(path), 12)) AS folder FROM {files}")
def index_folders(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "files").select("path", F.concat(F.lit("/base/"), F.left(F.sha2(F.col("path").cast("binary"), 256), F.lit(12))).alias("folder"))


@query("limited_reads", "SELECT path, md5(CASE WHEN length(content) > 3000 THEN concat(left(content, 3000), chr(10), chr(10), '[truncated, ', CAST(length(content) AS VARCHAR), ' chars total]') ELSE content END) AS read_md5 FROM {files}")
def limited_reads(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "files").select("path", F.md5(read_limited(F.col("content"))).alias("read_md5"))


# --- models ---


def _model(prompt: str) -> str:
    """A stand-in: says how long what it was given is, and fails on long prompts that end in a full stop."""
    if len(prompt) > 3000 and prompt.endswith("."):
        raise ValueError("too long")
    return f" {len(prompt)} signs "


_PROMPT = "concat('Say: ', left(content, 4000))"


@query("pending_summaries", f"""SELECT path, CASE WHEN doc_id % 3 <> 0 THEN summary WHEN length({_PROMPT}) > 3000 AND ends_with({_PROMPT}, '.') THEN '(summary failed: too long)' ELSE concat(CAST(length({_PROMPT}) AS VARCHAR), ' signs') END AS summary FROM {{files}}""")
def pending_summaries(spark: SparkSession, d: str) -> DataFrame:
    files = view(spark, d, "files").withColumn("summary", F.when(F.col("doc_id") % 3 == 0, index.PENDING).otherwise(F.col("summary")))
    some = extraction.summarised(files.filter(F.col("summary") == index.PENDING), _model, "Say: {text}").select(*files.columns)
    return ingest.upserted(files, some, "path").select("path", "summary")


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """Models' answers made of the parts: objects, plain strings, fences, prose, self-relations, empty ends and no JSON."""
    p = view(spark, d, "part")
    k, name, brand = F.col("p_partkey") % 4, F.col("p_name"), F.col("p_brand")
    say = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    whole = say('{"entities": [{"name": "', name, '", "type": "Method"}, "', brand, '", {"name": "x"}], "relations": [{"source": "', name, '", "relation": "Uses", "target": "', brand, '"}, {"source": "', brand, '", "target": "', brand, '"}, "odd", {"source": "", "relation": "is", "target": "a"}]}')
    answer = F.when(k == 0, whole).when(k == 1, say("```json\n", whole, "\n```")).when(k == 2, say("Here it is: ", whole, " That is all.")).otherwise("Nothing to say.")
    return p.select(answer.alias("answer"), say("note ", (F.col("p_partkey") % 50).cast("string"), ".md").alias("source_file"))


_GIVEN = "SELECT lower(p_name) AS a, lower(p_brand) AS b, concat('note ', CAST(p_partkey % 50 AS VARCHAR), '.md') AS source_file FROM {part} WHERE p_partkey % 4 < 3"


@query("extracted_entities", f"""WITH g AS ({_GIVEN}), n AS (SELECT a AS name, 'method' AS type, source_file FROM g UNION SELECT b, 'concept', source_file FROM g)
  SELECT regexp_replace(regexp_replace(name, '([a-z0-9]{{{{2}}}})-([a-z]{{{{3}}}})', '\\1 \\2', 'g'), '([a-z0-9]{{{{2}}}})-([a-z]{{{{3}}}})', '\\1 \\2', 'g') AS name, min(type) AS type, source_file FROM n GROUP BY 1, 3""")
def extracted_entities(spark: SparkSession, d: str) -> DataFrame:
    return extraction.extraction_rows(_answers(spark, d))[0]


@query("extracted_relations", f"""WITH g AS ({_GIVEN}) SELECT DISTINCT a AS source_entity, 'uses' AS relation, b AS target_entity, source_file FROM g WHERE a <> b""")
def extracted_relations(spark: SparkSession, d: str) -> DataFrame:
    return extraction.extraction_rows(_answers(spark, d))[1]


@query("new_notes", "SELECT path FROM {files} WHERE length(content) >= 100 AND split_part(path, '/', -1) NOT IN (SELECT split_part(path, '/', -1) FROM {files} WHERE doc_id % 3 = 0)")
def new_notes(spark: SparkSession, d: str) -> DataFrame:
    files = view(spark, d, "files")
    known = files.filter("doc_id % 3 = 0").select(F.element_at(F.split("path", "/"), -1).alias("source_file"))
    return extraction.new_notes(files, known).select("path")


@query("added_relations", """WITH n AS (SELECT DISTINCT lower(p_name) AS source_entity, 'uses' AS relation, lower(p_brand) AS target_entity, 'new.md' AS source_file FROM {part}), o AS (SELECT source_entity, relation, target_entity, source_file, id FROM {relations}), m AS (SELECT max(id) AS top FROM o)
  SELECT source_entity, relation, target_entity, source_file, id FROM o UNION ALL SELECT source_entity, relation, target_entity, source_file, top + row_number() OVER (ORDER BY source_entity, relation, target_entity, source_file) FROM n, m""")
def added_relations(spark: SparkSession, d: str) -> DataFrame:
    old = view(spark, d, "relations").select("source_entity", "relation", "target_entity", "source_file", "id")
    new = view(spark, d, "part").select(F.lower("p_name").alias("source_entity"), F.lit("uses").alias("relation"), F.lower("p_brand").alias("target_entity"), F.lit("new.md").alias("source_file"))
    return extraction.added(old, new.unionByName(old.filter("id % 3 = 0").drop("id")), "source_entity", "relation", "target_entity", "source_file")


@query("parsed_scores", "SELECT page_id, least(1.0::DOUBLE, greatest(0.0::DOUBLE, CASE WHEN page_id % 3 = 2 THEN 5.0::DOUBLE ELSE (page_id % 13)::DOUBLE END / 10)) AS score, round(1 / (1 + exp(-((page_id % 9) - 4.0::DOUBLE))), 9) AS likely FROM {pages}")
def parsed_scores(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id")
    answer = F.when(k % 3 == 2, "no number").when(k % 3 == 1, F.concat(F.lit("Score: "), (k % 13).cast("string"), F.lit(" of 10"))).otherwise((k % 13).cast("string"))
    return view(spark, d, "pages").select("page_id", models.parsed_score(answer).alias("score"), F.round(models.sigmoid((k % 9) - F.lit(4.0)), 9).alias("likely"))


# --- stored communities ---


@query("stored_communities", f"""WITH {_MERGED}, n AS (SELECT community_id, count(*) AS size FROM c GROUP BY 1), g AS (SELECT entity, count(*) AS degree FROM (SELECT a AS entity FROM p WHERE ca = cb UNION ALL SELECT b FROM p WHERE ca = cb) GROUP BY 1),
  t AS (SELECT community_id, string_agg(entity, '|' ORDER BY rank) AS top_entities FROM (SELECT community_id, entity, row_number() OVER (PARTITION BY community_id ORDER BY coalesce(degree, 0) DESC, entity) AS rank FROM c LEFT JOIN g USING (entity)) WHERE rank <= 10 GROUP BY 1),
  k AS (SELECT community_id, string_agg(type || '=' || n, '|' ORDER BY type) AS relation_types FROM (SELECT ca AS community_id, type, count(*) AS n FROM p WHERE ca = cb GROUP BY 1, 2) GROUP BY 1)
  SELECT CAST(community_id AS BIGINT) AS community_id, size, top_entities, coalesce(relation_types, '') AS relation_types, 1.0::DOUBLE AS resolution FROM n LEFT JOIN t USING (community_id) LEFT JOIN k USING (community_id)""")
def stored_communities(spark: SparkSession, d: str) -> DataFrame:
    meta = communities.stored(*_graph(spark, d), 1.0)[1]
    kinds = F.array_join(F.transform(F.array_sort(F.map_entries("relation_types")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), "|")
    return meta.select("community_id", "size", F.array_join("top_entities", "|").alias("top_entities"), kinds.alias("relation_types"), "resolution")


@query("community_peers", """WITH c AS (SELECT * FROM {communities}), q AS (SELECT entity, community_id FROM c WHERE contains(entity, 'nation 1') ORDER BY CASE WHEN entity = 'nation 1' THEN 0 ELSE 1 END, length(entity), entity LIMIT 1)
  SELECT c.entity, CAST(c.community_id AS BIGINT) AS community_id FROM c JOIN q ON c.community_id = q.community_id AND c.entity <> q.entity ORDER BY c.entity LIMIT 20""")
def community_peers(spark: SparkSession, d: str) -> DataFrame:
    rows = communities.stored(*_graph(spark, d), 1.0)[0]
    return communities.peers(rows, "Nation 1")


@query("neighbourhood_details", """WITH n AS (SELECT DISTINCT name FROM {entities} WHERE name LIKE '%nation 1%'), s AS (SELECT name AS node, 0 AS depth FROM n UNION ALL SELECT target_entity, 1 FROM {relations} WHERE source_entity IN (SELECT name FROM n) UNION ALL SELECT source_entity, 1 FROM {relations} WHERE target_entity IN (SELECT name FROM n)),
  m AS (SELECT node, min(depth) AS depth FROM s GROUP BY node)
  SELECT node, CAST(depth AS INT) AS depth, (SELECT string_agg(DISTINCT type, '|' ORDER BY type) FROM {entities} e WHERE e.name = node) AS types, (SELECT count(*) FROM {relations} r WHERE r.source_entity = node) AS outgoing, (SELECT count(*) FROM {relations} r WHERE r.target_entity = node) AS incoming FROM m""")
def neighbourhood_details(spark: SparkSession, d: str) -> DataFrame:
    found = extraction.neighbourhood_details(view(spark, d, "relations"), view(spark, d, "entities"), "nation 1", 1)
    return found.select("node", "depth", F.array_join("types", "|").alias("types"), F.size("outgoing").cast("long").alias("outgoing"), F.size("incoming").cast("long").alias("incoming"))


# --- upkeep ---


@query("unknown_relations", """SELECT raw AS relation, count(*) AS n FROM (SELECT CASE p_partkey % 7 WHEN 0 THEN 'uses' WHEN 1 THEN 'causes' ELSE concat('odd ', CAST(p_partkey % 30 AS VARCHAR)) END AS raw FROM {part}) WHERE raw LIKE 'odd%' GROUP BY 1 ORDER BY n DESC, relation LIMIT 10""")
def unknown_relations(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    raw = F.when(k % 7 == 0, "uses").when(k % 7 == 1, "causes").otherwise(F.concat(F.lit("odd "), (k % 30).cast("string")))
    return ingest.unknown_relations(view(spark, d, "part").select(raw.alias("relation")))


_KNOWN = ", ".join(f"'{k}'" for k in V.RELATION_MAP)


@query("normalization_of_odd_names", f"""WITH o AS (SELECT concat('e', CAST(p_partkey % 9 AS VARCHAR)) AS s, CASE p_partkey % 5 WHEN 0 THEN 'uses' WHEN 1 THEN 'employs' WHEN 2 THEN 'odd one' WHEN 3 THEN 'founded' ELSE 'never heard' END AS r, 't' AS t, CAST(p_partkey % 3 AS VARCHAR) AS f FROM {{part}}), c AS (SELECT *, {_case("r", V.RELATION_MAP, "'relates_to'")} AS n FROM o)
  SELECT count(*) AS total, count(*) FILTER (WHERE r <> n) AS changed, count(*) - count(DISTINCT (s, n, t, f)) AS merged, count(*) FILTER (WHERE r NOT IN ({_KNOWN})) AS unknown FROM c""")
def normalization_of_odd_names(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    raw = F.element_at(F.array(*[F.lit(x) for x in ("uses", "employs", "odd one", "founded", "never heard")]), (k % 5 + 1).cast("int"))
    rows = view(spark, d, "part").select(F.concat(F.lit("e"), (k % 9).cast("string")).alias("source_entity"), raw.alias("relation"), F.lit("t").alias("target_entity"), (k % 3).cast("string").alias("source_file"))
    return ingest.normalization_counts(rows)


_CHUNKED = "SELECT path AS file_path, i AS chunk_index FROM (SELECT path, content, unnest(range(0, CASE WHEN length(content) <= 2000 THEN 1 ELSE CAST(ceil((length(content) - 300) / 1700.0::DOUBLE) AS BIGINT) END)) AS i FROM {files} WHERE length(content) > 0)"


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.code_chunks(view(spark, d, "files")).select(F.col("path").alias("file_path"), F.col("chunk_index").cast("bigint").alias("chunk_index"))


@query("orphan_chunks_removed", f"WITH c AS ({_CHUNKED}) SELECT file_path, chunk_index FROM c WHERE file_path IN (SELECT path FROM {{files}} WHERE doc_id % 3 <> 0)")
def orphan_chunks_removed(spark: SparkSession, d: str) -> DataFrame:
    files = view(spark, d, "files")
    return ingest.pruned_index(files, _chunks(spark, d), files.filter("doc_id % 3 <> 0"))[1]


@query("rechunked_files", f"WITH c AS ({_CHUNKED}), x AS (SELECT path FROM {{files}} WHERE doc_id % 4 = 0) SELECT file_path, chunk_index FROM c WHERE file_path NOT IN (SELECT path FROM x) UNION ALL SELECT file_path, chunk_index + 100 FROM c WHERE file_path IN (SELECT path FROM x)")
def rechunked_files(spark: SparkSession, d: str) -> DataFrame:
    rows, changed = _chunks(spark, d), view(spark, d, "files").filter("doc_id % 4 = 0")
    new = rows.join(changed.select(F.col("path").alias("file_path")), "file_path", "left_semi").withColumn("chunk_index", F.col("chunk_index") + 100)
    return ingest.rechunked(rows, changed, new)


# --- the whole search ---


def _embedded_files(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "embeddings").join(view(spark, d, "files"), F.col("vec_id") == F.col("doc_id")).select("path", "content", "summary", "embedding")


@query("full_search")
def full_search(spark: SparkSession, d: str) -> DataFrame:
    e, r = view(spark, d, "entities"), view(spark, d, "relations")
    return assistant.full_search(
        _embedded_files(spark, d), "the nation with version", models.hashed_embedder(64), entities=e, relations=r, communities=view(spark, d, "communities"),
        top=10, model=lambda p: "a passage on nations " + p[-20:], scorer=lambda s: F.least(F.lit(1.0), F.length(s) / F.lit(400.0)),
    ).results.select("path", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query("keyword_search_boosted", f"""WITH {bm25_ctes(['with', 'from'], 'auto')}, x AS ({top_sql('', 60)}), y AS (SELECT * FROM x WHERE rank <= 20),
  z AS (SELECT y.path, y.rank, CASE WHEN y.rank <= 5 THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END * y.score / (SELECT max(score) FROM y) + CASE WHEN y.rank <= 5 THEN 0.4::DOUBLE ELSE 0.6::DOUBLE END * ((length(y.path) * 37) % 100) / 100.0::DOUBLE AS blend FROM y)
  SELECT path, round(blend, 6) AS score, CAST(k AS BIGINT) AS rank FROM (SELECT path, blend, row_number() OVER (ORDER BY blend DESC, rank) AS k FROM z) WHERE k <= 10""")
def keyword_search_boosted(spark: SparkSession, d: str) -> DataFrame:
    files = view(spark, d, "files")
    found = search.search(files, "with from", top=20)
    out = fusion.reranked(found, ((F.length("path") * 37) % 100) / F.lit(100.0), 20).filter("final_rank <= 10")
    return out.select("path", F.round("blend", 6).alias("score"), F.col("final_rank").cast("bigint").alias("rank"))


@query("cached_embeddings", "SELECT path, doc_id % 2 = 0 AS cached, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 64 END AS dims FROM {files}")
def cached_embeddings(spark: SparkSession, d: str) -> DataFrame:
    files = view(spark, d, "files").select("path", "doc_id", F.concat("path", F.lit(" "), "summary").alias("t"))
    cache = files.filter("doc_id % 2 = 0").select(F.sha2(F.concat(F.lit("m:"), "t"), 256).alias("key"), F.array(F.lit(1.0).cast("float")).alias("embedding"))
    out = models.cached_embeddings(files, "t", staged(cache, "cache"), models.hashed_embedder(64), "m")
    return out.select("path", (F.size("embedding") == 1).alias("cached"), F.size("embedding").alias("dims"))


def graph_context_json(spark: SparkSession, d: str) -> str:
    """The graph's part of a search as JSON text."""
    e, r = view(spark, d, "entities"), view(spark, d, "relations")
    found = assistant.full_search(view(spark, d, "files"), "nation 1", entities=e, relations=r, communities=view(spark, d, "communities"))
    return json.dumps(found.context(), indent=2)
