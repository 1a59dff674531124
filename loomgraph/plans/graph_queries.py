"""Registered queries: entities and relations, paths, communities, catalysts, pair mining, notes and code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab as V
from ..operators import communities, graph, ingest, search, synthesis
from ..operators.fulltext import bm25, ranked
from ..sources.tables import view, with_views

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


def _case(column: str, pairs: dict[str, str], default: str) -> str:
    by: dict[str, list[str]] = {}
    for k, v in sorted(pairs.items()):
        by.setdefault(v, []).append("'" + k + "'")
    return f"CASE {' '.join(f'WHEN {column} IN ({chr(44).join(ks)}) THEN {chr(39)}{v}{chr(39)}' for v, ks in sorted(by.items()))} ELSE {default} END"


# --- entities and relations ---

_RAW = "SELECT list_extract(['applies, to', 'is_part_of', 'Leads_To', 'founded', 'mentions', 'based on', 'led to', 'uses', 'is a', 'inhibits'], CAST(p_partkey % 10 + 1 AS INT)) AS raw, p_partkey AS id FROM {part}"


def _raw(spark: SparkSession, d: str) -> DataFrame:
    names = ["applies, to", "is_part_of", "Leads_To", "founded", "mentions", "based on", "led to", "uses", "is a", "inhibits"]
    return view(spark, d, "part").select(F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("p_partkey") % 10 + 1).cast("int")).alias("raw"), F.col("p_partkey").alias("id"))


@query("relation_normalize", f"SELECT id, {_case('lower(raw)', V.RELATION_MAP, chr(39) + V.RELATION_DEFAULT + chr(39))} AS relation FROM ({_RAW})")
def relation_normalize(spark: SparkSession, d: str) -> DataFrame:
    return _raw(spark, d).select("id", T.canonical_relation(F.col("raw")).alias("relation"))


@query("relation_normalize_causal", f"SELECT id, {_case('lower(raw)', V.CAUSAL_SPELLING, 'replace(lower(raw), chr(32), chr(95))')} AS relation FROM ({_RAW})")
def relation_normalize_causal(spark: SparkSession, d: str) -> DataFrame:
    return _raw(spark, d).select("id", T.causal_relation(F.col("raw")).alias("relation"))


@query("entity_type_normalize", f"SELECT name, source_file, {_case('lower(type)', V.TYPE_MAP, chr(39) + V.TYPE_DEFAULT + chr(39))} AS type FROM {{entities}}")
def entity_type_normalize(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "entities").select("name", "source_file", T.canonical_type(F.col("type")).alias("type"))


_NAME = "concat(upper(p_name), CASE p_partkey % 4 WHEN 0 THEN '-making_of' WHEN 1 THEN '_b-tree' WHEN 2 THEN '-t-cell  x-ray' ELSE '-aaa-bbb-ccc' END)"


@query("entity_name_normalize", rf"SELECT p_partkey AS id, trim(regexp_replace(regexp_replace(regexp_replace(replace(lower({_NAME}), '_', ' '), '([a-z0-9]{{{{2}}}})-([a-z]{{{{3}}}})', '\1 \2', 'g'), '([a-z0-9]{{{{2}}}})-([a-z]{{{{3}}}})', '\1 \2', 'g'), '\s+', ' ', 'g')) AS name FROM {{part}}")
def entity_name_normalize(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    tail = F.when(k == 0, "-making_of").when(k == 1, "_b-tree").when(k == 2, "-t-cell  x-ray").otherwise("-aaa-bbb-ccc")
    return view(spark, d, "part").select(F.col("p_partkey").alias("id"), T.normal_name(F.concat(F.upper("p_name"), tail)).alias("name"))


@query("entity_dedupe", "SELECT source_entity, relation, target_entity, min(id) AS id FROM {relations} GROUP BY ALL")
def entity_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return ingest.inserted(view(spark, d, "relations"), "source_entity", "relation", "target_entity").select("source_entity", "relation", "target_entity", "id")


_TWICE = "SELECT id, source_entity, relation, target_entity, source_file FROM {relations} UNION ALL SELECT id + 7, source_entity, CASE relation WHEN 'causes' THEN 'triggers' WHEN 'is_part_of' THEN 'part_of' ELSE 'requires' END, target_entity, source_file FROM {relations} WHERE id % 3 = 0"


def _twice(spark: SparkSession, d: str) -> DataFrame:
    r = view(spark, d, "relations").select("id", "source_entity", "relation", "target_entity", "source_file")
    new = F.when(F.col("relation") == "causes", "triggers").when(F.col("relation") == "is_part_of", "part_of").otherwise("requires")
    return r.unionByName(r.filter("id % 3 = 0").withColumn("id", F.col("id") + 7).withColumn("relation", new))


_CANON = _case("relation", V.RELATION_MAP, "'relates_to'")


@query("relation_merge", f"""SELECT id, source_entity, r AS relation, target_entity, source_file FROM (SELECT *, row_number() OVER (PARTITION BY source_entity, r, target_entity, source_file ORDER BY CASE WHEN relation = r THEN 0 ELSE 1 END, id) AS k
  FROM (SELECT *, {_CANON} AS r FROM ({_TWICE}))) WHERE k = 1""")
def relation_merge(spark: SparkSession, d: str) -> DataFrame:
    return ingest.normalized_relations(_twice(spark, d))


@query("normalization_counts", f"""SELECT count(*) AS total, count(*) FILTER (WHERE relation <> r) AS changed, count(*) - count(DISTINCT (source_entity, r, target_entity, source_file)) AS merged, 0::BIGINT AS unknown FROM (SELECT *, {_CANON} AS r FROM ({_TWICE}))""")
def normalization_counts(spark: SparkSession, d: str) -> DataFrame:
    return ingest.normalization_counts(_twice(spark, d))


_SOME = "(SELECT DISTINCT name FROM {entities} WHERE length(name) % 5 <> 0)"


def _some(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "entities").filter("length(name) % 5 <> 0")


@query("prune_dangling", f"SELECT id, source_entity, target_entity FROM {{relations}} WHERE source_entity NOT IN {_SOME} OR target_entity NOT IN {_SOME}")
def prune_dangling(spark: SparkSession, d: str) -> DataFrame:
    return ingest.dangling_relations(view(spark, d, "relations"), _some(spark, d)).select("id", "source_entity", "target_entity")


@query("prune_orphan_entities", "SELECT name, source_file, type FROM {entities} WHERE name NOT IN (SELECT source_entity FROM {relations} WHERE id % 3 = 0 UNION SELECT target_entity FROM {relations} WHERE id % 3 = 0)")
def prune_orphan_entities(spark: SparkSession, d: str) -> DataFrame:
    return ingest.orphan_entities(view(spark, d, "entities"), view(spark, d, "relations").filter("id % 3 = 0")).select("name", "source_file", "type")


@query("graph_stats_types", "SELECT 'type' AS kind, type AS value, count(*) AS n FROM {entities} GROUP BY type UNION ALL SELECT 'relation', relation, count(*) FROM {relations} GROUP BY relation")
def graph_stats_types(spark: SparkSession, d: str) -> DataFrame:
    a = graph.counts(view(spark, d, "entities"), "type").select(F.lit("type").alias("kind"), F.col("type").alias("value"), "n")
    b = graph.counts(view(spark, d, "relations"), "relation").select(F.lit("relation").alias("kind"), F.col("relation").alias("value"), "n")
    return a.unionByName(b)


_DEGREE = "SELECT name, count(*) AS connections FROM (SELECT source_entity AS name FROM {relations} UNION ALL SELECT target_entity FROM {relations}) GROUP BY name"


@query("degree_topk", f"{_DEGREE} ORDER BY connections DESC, name LIMIT 20")
def degree_topk(spark: SparkSession, d: str) -> DataFrame:
    return graph.connection_counts(view(spark, d, "relations")).orderBy(F.col("connections").desc(), "name").limit(20)


_TYPED = _case("lower(type)", V.TYPE_MAP, "'concept'")


@query("export_nodes", f"""WITH t AS (SELECT name, {_TYPED} AS type, count(*) AS n FROM {{entities}} GROUP BY ALL), p AS (SELECT name, arg_min(type, (-n, type)) AS type FROM t GROUP BY name),
  f AS (SELECT name, array_to_string(list_sort(list(DISTINCT source_file))[1:5], ' ') AS sources FROM {{entities}} GROUP BY name), g AS ({_DEGREE})
  SELECT g.name, g.connections, p.type, f.sources FROM (SELECT * FROM g WHERE connections >= 2 ORDER BY connections DESC, name LIMIT 300) g JOIN p USING (name) JOIN f USING (name)""")
def export_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.export_nodes(view(spark, d, "relations"), view(spark, d, "entities")).withColumn("sources", F.array_join("sources", " "))


@query("export_links", f"""WITH n AS (SELECT name FROM ({_DEGREE}) WHERE connections >= 2 ORDER BY connections DESC, name LIMIT 300)
  SELECT source_entity AS source, target_entity AS target, {_CANON} AS relation FROM (SELECT source_entity, target_entity, arg_min(relation, id) AS relation FROM {{relations}} WHERE source_entity IN (SELECT name FROM n) AND target_entity IN (SELECT name FROM n) GROUP BY ALL)""")
def export_links(spark: SparkSession, d: str) -> DataFrame:
    return graph.export_links(view(spark, d, "relations"))


# --- paths ---

_EDGES = "e AS (SELECT DISTINCT a, b FROM (SELECT source_entity AS a, target_entity AS b FROM {relations} UNION ALL SELECT target_entity, source_entity FROM {relations}) WHERE a <> b)"
_INNER = _EDGES + ", g AS (SELECT a FROM e GROUP BY a HAVING count(*) >= 2), i AS (SELECT e.a, e.b FROM e WHERE e.a IN (SELECT a FROM g) AND e.b IN (SELECT a FROM g))"


@query("leaf_pruned_graph", f"WITH {_INNER} SELECT a AS src, b AS dst FROM i")
def leaf_pruned_graph(spark: SparkSession, d: str) -> DataFrame:
    return graph.undirected(view(spark, d, "relations"))


def _ends(spark: SparkSession, d: str) -> tuple[str, str]:
    r = view(spark, d, "relations").filter("relation = 'causes'").agg(F.min("source_entity"), F.max("target_entity")).first()
    return r[0], r[1]


_START = "(SELECT min(source_entity) FROM {relations} WHERE relation = 'causes')"
_END = "(SELECT max(target_entity) FROM {relations} WHERE relation = 'causes')"


@query("khop_neighbors", f"""WITH RECURSIVE {_EDGES}, r AS (SELECT {_START} AS node, 0 AS depth UNION SELECT e.b, r.depth + 1 FROM r JOIN e ON e.a = r.node WHERE r.depth < 2)
  SELECT node, CAST(min(depth) AS INT) AS depth FROM r GROUP BY node""")
def khop_neighbors(spark: SparkSession, d: str) -> DataFrame:
    start = spark.createDataFrame([(_ends(spark, d)[0],)], "node string")
    return graph.neighborhood(view(spark, d, "relations"), start, 2)


@query("shortest_path_length", f"""WITH RECURSIVE {_EDGES}, r AS (SELECT {_START} AS node, 0 AS depth UNION SELECT e.b, r.depth + 1 FROM r JOIN e ON e.a = r.node WHERE r.depth < 6)
  SELECT CAST(min(depth) AS BIGINT) AS edges FROM r WHERE node = {_END}""")
def shortest_path_length(spark: SparkSession, d: str) -> DataFrame:
    path = graph.find_path(graph.undirected(view(spark, d, "relations"), prune_leaves=False), *_ends(spark, d))
    return spark.createDataFrame([(len(path) - 1,)], "edges long")


# The best paths of at most three edges, by the order in which neighbours are visited: descending degree, then name.
_PATHS = f"""{_EDGES}, d AS (SELECT a AS n, count(*) AS k FROM e GROUP BY a), s AS (SELECT e.b AS x, d.k AS kx FROM e JOIN d ON d.n = e.b WHERE e.a = {_START}),
  w AS (SELECT 1 AS l, NULL AS x, NULL AS y, 0 AS kx, 0 AS ky FROM s WHERE x = {_END} UNION ALL SELECT 2, x, NULL, kx, 0 FROM s JOIN e ON e.a = s.x AND e.b = {_END}
  UNION ALL SELECT 3, s.x, e.b, kx, d.k FROM s JOIN e ON e.a = s.x JOIN d ON d.n = e.b JOIN e f ON f.a = e.b AND f.b = {_END} WHERE s.x <> {_END} AND e.b <> {_START}),
  p AS (SELECT row_number() OVER (ORDER BY kx DESC, x, ky DESC, y) - 1 AS path, l, x, y FROM w WHERE l = (SELECT min(l) FROM w)),
  o AS (SELECT path, unnest(list_filter([{_START}, x, y, {_END}], lambda v: v IS NOT NULL)) AS node, generate_subscripts(list_filter([{_START}, x, y, {_END}], lambda v: v IS NOT NULL), 1) - 1 AS step FROM p)"""


@query("shortest_path", f"WITH {_PATHS} SELECT CAST(step AS BIGINT) AS step, node FROM o WHERE path = 0")
def shortest_path(spark: SparkSession, d: str) -> DataFrame:
    path = graph.find_path(graph.undirected(view(spark, d, "relations"), prune_leaves=False), *_ends(spark, d))
    return spark.createDataFrame([(i, x) for i, x in enumerate(path)], "step long, node string")


@query("all_paths", f"WITH {_PATHS} SELECT path, CAST(step AS BIGINT) AS step, node FROM o WHERE path < 3")
def all_paths(spark: SparkSession, d: str) -> DataFrame:
    paths = graph.find_all_paths(graph.undirected(view(spark, d, "relations"), prune_leaves=False), *_ends(spark, d), max_depth=8)
    return spark.createDataFrame([(k, i, x) for k, p in enumerate(paths) for i, x in enumerate(p)], "path long, step long, node string")


@query("causal_chain", f"""WITH r AS (SELECT id, source_entity AS a, relation, target_entity AS b, source_file AS f, CASE WHEN relation IN ('causes', 'uses') THEN 0 ELSE 1 END AS late FROM {{relations}}),
  p AS (SELECT w.a AS a0, w.relation AS r0, w.b AS a1, w.f AS f0, x.relation AS r1, x.b AS a2, x.f AS f1, y.relation AS r2, y.b AS a3, y.f AS f2, z.relation AS r3, z.b AS a4, z.f AS f3
    FROM r w JOIN r x ON x.a = w.b JOIN r y ON y.a = x.b JOIN r z ON z.a = y.b WHERE w.a = {_START} AND z.b = 'region 1' ORDER BY w.late, w.id, x.late, x.id, y.late, y.id, z.late, z.id LIMIT 1)
  SELECT 0::BIGINT AS step, a0 AS src, r0 AS relation, a1 AS dst, f0 AS source FROM p UNION ALL SELECT 1, a1, r1, a2, f1 FROM p UNION ALL SELECT 2, a2, r2, a3, f2 FROM p UNION ALL SELECT 3, a3, r3, a4, f3 FROM p""")
def causal_chain(spark: SparkSession, d: str) -> DataFrame:
    a, _ = _ends(spark, d)
    steps = graph.causal_chain(view(spark, d, "relations"), a, "region 1")
    return spark.createDataFrame([(i, s["src"], s["relation"], s["dst"], s["source"]) for i, s in enumerate(steps)], "step long, src string, relation string, dst string, source string")


_ASKED = ("nation 1", "making nation 1", "ation 1", "of 1 nation", "nothing of it")


@query("fuzzy_names", f"""WITH n AS (SELECT name, count(*) AS n FROM (SELECT source_entity AS name FROM {{relations}} UNION ALL SELECT target_entity FROM {{relations}}) GROUP BY name), q AS (SELECT unnest([{", ".join(repr(x) for x in _ASKED)}]) AS query),
  m AS (SELECT query, name, n, len(list_intersect(string_split(query, ' '), string_split(name, ' '))) AS shared FROM q, n),
  t AS (SELECT *, CASE WHEN name = query THEN 0 WHEN contains(name, query) THEN 1 WHEN shared >= 2 THEN 2 END AS tier FROM m)
  SELECT query, name FROM (SELECT query, name, row_number() OVER (PARTITION BY query ORDER BY tier, CASE WHEN tier = 2 THEN -shared ELSE 0 END, n DESC, name) AS k FROM t WHERE tier IS NOT NULL) WHERE k = 1""")
def fuzzy_names(spark: SparkSession, d: str) -> DataFrame:
    edges = graph.directed(view(spark, d, "relations"))
    found = [(q, graph.fuzzy_node(edges, q)) for q in _ASKED]
    return spark.createDataFrame([x for x in found if x[1]], "query string, name string")


@query("implementations", "SELECT DISTINCT name AS src, 'applies' AS relation, source_file AS dst FROM {entities} WHERE name LIKE 'nation%'")
def implementations(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "entities").filter(F.col("name").startswith("nation")).select("name", "source_file").distinct()
    rel = rows.select(F.xxhash64("name", "source_file").alias("id"), F.col("name").alias("source_entity"), F.lit("Applies").alias("relation"), F.col("source_file").alias("target_entity"), "source_file")
    other = view(spark, d, "relations").select("id", "source_entity", "relation", "target_entity", "source_file")
    return graph.implementations(rel.unionByName(other))


@query("entity_lookup_tiers", """SELECT name, CAST(tier AS INT) AS tier, row_number() OVER (ORDER BY tier, length(name), name) AS rank FROM (SELECT name, CASE WHEN name = 'nation 1' THEN 0 WHEN contains(name, 'nation 1') THEN 1 WHEN contains(name, 'nation') THEN 2 END AS tier FROM (SELECT DISTINCT name FROM {entities})) WHERE tier IS NOT NULL ORDER BY tier, length(name), name LIMIT 8""")
def entity_lookup_tiers(spark: SparkSession, d: str) -> DataFrame:
    return graph.lookup(view(spark, d, "entities"), "Nation_1").withColumn("rank", F.col("rank").cast("bigint"))


@query("ask_graph", "SELECT 'out' AS direction, source_entity AS entity, relation, target_entity AS other FROM {relations} WHERE source_entity = 'nation 1' UNION SELECT 'in', target_entity, relation, source_entity FROM {relations} WHERE target_entity = 'nation 1'")
def ask_graph(spark: SparkSession, d: str) -> DataFrame:
    asked = graph.parse_question("What is connected to the nation?") | {"entity": "nation 1"}
    return graph.ask(view(spark, d, "relations"), view(spark, d, "entities"), asked)


_COMPONENTS = f"""{_EDGES}, r(node, component) USING KEY (node) AS (SELECT a, a FROM e GROUP BY a UNION SELECT e.b, min(r.component) FROM r JOIN e ON e.a = r.node JOIN recurring.r AS o ON o.node = e.b WHERE r.component < o.component GROUP BY e.b)"""


@query("connected_components", f"WITH RECURSIVE {_COMPONENTS} SELECT node, component FROM r")
def connected_components(spark: SparkSession, d: str) -> DataFrame:
    return graph.components(graph.undirected(view(spark, d, "relations"), prune_leaves=False))


@query("path_length_stats")
def path_length_stats(spark: SparkSession, d: str) -> DataFrame:
    return graph.path_statistics(graph.undirected(view(spark, d, "relations")))


# --- communities ---

_MERGED = """m AS (SELECT least(source_entity, target_entity) AS a, greatest(source_entity, target_entity) AS b, sum(CASE WHEN coalesce(confidence, 0) = 0 THEN 0.8::DOUBLE ELSE confidence END) AS weight, arg_min(relation, id) AS type
  FROM {relations} WHERE source_entity <> target_entity GROUP BY 1, 2), c AS (SELECT * FROM {communities}), p AS (SELECT m.*, x.community_id AS ca, y.community_id AS cb FROM m JOIN c x ON m.a = x.entity JOIN c y ON m.b = y.entity)"""


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return communities.merged(view(spark, d, "relations")), view(spark, d, "communities")


@query("parallel_edge_merge", f"WITH {_MERGED} SELECT a, b, round(weight, 6) AS weight, type FROM m")
def parallel_edge_merge(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d)[0].withColumn("weight", _r("weight"))


@query("modularity", f"""WITH {_MERGED}, l AS (SELECT sum(weight) AS w FROM p WHERE ca = cb), k AS (SELECT c, sum(w) AS k FROM (SELECT ca AS c, weight AS w FROM p UNION ALL SELECT cb, weight FROM p) GROUP BY c), t AS (SELECT sum(k) AS m2, sum(k * k) AS kk FROM k)
  SELECT round(l.w / (t.m2 / 2) - t.kk / (t.m2 * t.m2), 6) AS modularity FROM l, t""")
def modularity(spark: SparkSession, d: str) -> DataFrame:
    return communities.modularity(*_graph(spark, d)).withColumn("modularity", _r("modularity"))


@query("community_density", f"""WITH {_MERGED}, n AS (SELECT community_id, count(*) AS size FROM c GROUP BY 1), i AS (SELECT ca AS community_id, count(*) AS edges FROM p WHERE ca = cb GROUP BY 1)
  SELECT community_id, size, coalesce(edges, 0) AS edges, round(CASE WHEN size > 1 THEN 2.0::DOUBLE * coalesce(edges, 0) / (size * (size - 1)) ELSE 0 END, 9) AS density FROM n LEFT JOIN i USING (community_id)""")
def community_density(spark: SparkSession, d: str) -> DataFrame:
    return communities.densities(*_graph(spark, d)).withColumn("density", _r("density", 9))


@query("community_top_entities", f"""WITH {_MERGED}, g AS (SELECT entity, count(*) AS degree FROM (SELECT a AS entity FROM p WHERE ca = cb UNION ALL SELECT b FROM p WHERE ca = cb) GROUP BY 1)
  SELECT * FROM (SELECT community_id, entity, coalesce(degree, 0) AS degree, row_number() OVER (PARTITION BY community_id ORDER BY coalesce(degree, 0) DESC, entity) AS rank FROM c LEFT JOIN g USING (entity)) WHERE rank <= 10""")
def community_top_entities(spark: SparkSession, d: str) -> DataFrame:
    return communities.top_entities(*_graph(spark, d)).withColumn("rank", F.col("rank").cast("bigint"))


@query("community_relation_types", f"WITH {_MERGED} SELECT ca AS community_id, type, count(*) AS n FROM p WHERE ca = cb GROUP BY 1, 2")
def community_relation_types(spark: SparkSession, d: str) -> DataFrame:
    return communities.relation_types(*_graph(spark, d))


@query("degree_distribution", f"""WITH {_MERGED}, g AS (SELECT n, count(*) AS d FROM (SELECT a AS n FROM m UNION ALL SELECT b FROM m) GROUP BY 1), o AS (SELECT d, row_number() OVER (ORDER BY d) AS i, count(*) OVER () AS k FROM g)
  SELECT count(*) AS nodes, round(avg(d), 6) AS mean_degree, max(CASE WHEN i = k // 2 + 1 THEN d END) AS median_degree, max(d) AS max_degree, round(count(*) FILTER (WHERE d = 1) / count(*), 6) AS share_1, round(count(*) FILTER (WHERE d >= 2) / count(*), 6) AS share_2_up, round(count(*) FILTER (WHERE d >= 3) / count(*), 6) AS share_3_up FROM o""")
def degree_distribution(spark: SparkSession, d: str) -> DataFrame:
    out = communities.degree_distribution(_graph(spark, d)[0])
    return out.select("nodes", _r("mean_degree").alias("mean_degree"), "median_degree", "max_degree", *[_r(c).alias(c) for c in ("share_1", "share_2_up", "share_3_up")])


@query("size_buckets", """WITH s AS (SELECT community_id, count(*) AS n FROM (SELECT CAST(length(entity) * 31 + ascii(right(entity, 1)) AS INT) AS community_id FROM {communities}) GROUP BY 1), o AS (SELECT n, row_number() OVER (ORDER BY n, community_id) AS i, count(*) OVER () AS k FROM s)
  SELECT count(*) AS communities, max(n) AS largest, count(*) FILTER (WHERE n = 1) AS singletons, max(CASE WHEN i = k // 2 + 1 THEN n END) AS median, round(avg(n), 6) AS mean, count(*) FILTER (WHERE n BETWEEN 2 AND 5) AS size_2_5, count(*) FILTER (WHERE n BETWEEN 6 AND 20) AS size_6_20, count(*) FILTER (WHERE n BETWEEN 21 AND 100) AS size_21_100, count(*) FILTER (WHERE n > 100) AS size_over_100 FROM o""")
def size_buckets(spark: SparkSession, d: str) -> DataFrame:
    given = view(spark, d, "communities").select("entity", (F.length("entity") * 31 + F.ascii(F.right("entity", F.lit(1)))).alias("community_id"))
    return communities.size_statistics(given).withColumn("mean", _r("mean"))


@query("graph_overview", f"""WITH RECURSIVE {_COMPONENTS}, c AS (SELECT component, count(*) AS n FROM r GROUP BY 1), t AS (SELECT count(*) AS components, max(n) AS largest, sum(n) AS nodes FROM c)
  SELECT components, largest, round(largest / nodes, 9) AS share, round((SELECT count(*) FROM e) / (nodes * (nodes - 1.0::DOUBLE)), 9) AS density FROM t""")
def graph_overview(spark: SparkSession, d: str) -> DataFrame:
    return communities.overview(_graph(spark, d)[0]).withColumn("share", _r("share", 9)).withColumn("density", _r("density", 9))


@query("leiden")
def leiden(spark: SparkSession, d: str) -> DataFrame:
    return communities.leiden(_graph(spark, d)[0])


@query("resolution_sweep")
def resolution_sweep(spark: SparkSession, d: str) -> DataFrame:
    return communities.resolution_sweep(_graph(spark, d)[0])


# --- search over the graph ---


def _hits(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "entities").groupBy("source_file").agg(F.count("*").alias("n")).select(F.concat(F.lit("k/"), "source_file").alias("path"), (F.col("n") / F.lit(1000.0)).alias("score"))
    return ranked(rows, 30)


_HITS = "h AS (SELECT path, score, row_number() OVER (ORDER BY score DESC, path) AS rank FROM (SELECT concat('k/', source_file) AS path, count(*) / 1000.0::DOUBLE AS score FROM {entities} GROUP BY source_file) ORDER BY score DESC, path LIMIT 30)"


@query("community_boost", f"""WITH {_HITS}, q AS (SELECT DISTINCT community_id FROM {{entities}} JOIN {{communities}} ON name = entity WHERE name LIKE '%nation%' AND (name LIKE 'nation%' OR list_contains(string_split(name, ' '), 'nation'))),
  b AS (SELECT source_file, 0.005::DOUBLE * count(DISTINCT name) AS bonus FROM {{entities}} JOIN {{communities}} ON name = entity WHERE community_id IN (SELECT community_id FROM q) GROUP BY 1)
  SELECT path, round(score + coalesce(bonus, 0), 6) AS score, row_number() OVER (ORDER BY score + coalesce(bonus, 0) DESC, rank) AS rank FROM h LEFT JOIN b ON path = concat('k/', source_file)""")
def community_boost(spark: SparkSession, d: str) -> DataFrame:
    out = search.community_boost(_hits(spark, d), "the nation", view(spark, d, "entities"), view(spark, d, "communities"))
    return out.select("path", _r("score").alias("score"), F.col("rank").cast("bigint").alias("rank"))


_TOP6 = f"""g AS ({_DEGREE}), x AS (SELECT name, 10 + 1 + 1 AS p, coalesce(connections, 0) AS n FROM (SELECT DISTINCT name FROM {{entities}} WHERE name LIKE '%nation 1%') LEFT JOIN g USING (name)),
  y AS (SELECT name FROM (SELECT name, CASE WHEN name LIKE '%nation 1%' THEN 10 ELSE 0 END + 1 AS p FROM (SELECT DISTINCT name FROM {{entities}} WHERE name LIKE '%nation%')) LEFT JOIN g USING (name) ORDER BY p * greatest(coalesce(connections, 0), 1) DESC, name LIMIT 6)"""


@query("graph_context_edges", f"""WITH {_TOP6}, o AS (SELECT name AS entity, 'out' AS direction, relation, target_entity AS other, row_number() OVER (PARTITION BY name ORDER BY id) AS place FROM {{relations}} JOIN y ON source_entity = name),
  n AS (SELECT name AS entity, 'in' AS direction, relation, source_entity AS other, row_number() OVER (PARTITION BY name ORDER BY id) AS place FROM {{relations}} JOIN y ON target_entity = name)
  SELECT entity, direction, {_CANON} AS relation, other, place FROM (SELECT * FROM o WHERE place <= 5 UNION ALL SELECT * FROM n WHERE place <= 3)""")
def graph_context_edges(spark: SparkSession, d: str) -> DataFrame:
    e, r = view(spark, d, "entities"), view(spark, d, "relations")
    return search.context_edges(search.context_entities("nation 1", [], e, r), r).withColumn("place", F.col("place").cast("bigint"))


@query("graph_context_communities")
def graph_context_communities(spark: SparkSession, d: str) -> DataFrame:
    e, r = view(spark, d, "entities"), view(spark, d, "relations")
    return search.context_communities(search.context_entities("nation 1", [], e, r), view(spark, d, "communities"))


_CATALYST = """b AS (SELECT name, count(*) AS mentions, min(type) AS type, list_sort(list(DISTINCT source_file)) AS notes FROM {entities} GROUP BY name ORDER BY mentions DESC, name LIMIT 200),
  r AS (SELECT name, target_entity AS other, id FROM {relations} JOIN b ON source_entity = name UNION ALL SELECT name, source_entity, id FROM {relations} JOIN b ON target_entity = name WHERE source_entity <> target_entity),
  t AS (SELECT name, list_sort(list(DISTINCT other))[1:3] AS related FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY id, other) AS k FROM r) WHERE k <= 10 GROUP BY name),
  c AS (SELECT name AS entity, type, mentions, list_filter([concat('What is ', name, ' and how does it work?'), CASE WHEN len(related) > 0 THEN concat('How does ', name, ' relate to ', array_to_string(related, ', '), '?') END,
    concat('What are the implications of ', name, '?'), CASE WHEN len(list_distinct(list_transform(notes, lambda x: split_part(x, '--', 1)))) >= 2 THEN concat('How does ', name, ' bridge ', array_to_string(list_sort(list_distinct(list_transform(notes, lambda x: split_part(x, '--', 1))))[1:3], ' and '), '?') END,
    CASE WHEN len(notes) > 3 THEN concat('What are the most important aspects of ', name, ' across ', CAST(len(notes) AS VARCHAR), ' vault notes?') END], lambda q: q IS NOT NULL) AS questions, notes[1:5] AS notes FROM b LEFT JOIN t USING (name))"""


@query("catalyst_questions", f"WITH {_CATALYST} SELECT entity, type, mentions, array_to_string(questions, ' | ') AS questions, array_to_string(notes, ' ') AS notes FROM c")
def catalyst_questions(spark: SparkSession, d: str) -> DataFrame:
    rows = search.catalysts(view(spark, d, "entities"), view(spark, d, "relations"))
    return rows.withColumn("questions", F.array_join("questions", " | ")).withColumn("notes", F.array_join("notes", " "))


@query("catalyst_search", rf"""WITH {_CATALYST}, k AS (SELECT entity, list_filter(regexp_split_to_array(lower(concat_ws(' ', entity, array_to_string(questions, ' '))), '\W+'), lambda w: w <> '') AS ws FROM c), s AS (SELECT count(*) AS nd, avg(len(ws)) AS av FROM k),
  p AS (SELECT entity, w, count(*) AS tf, any_value(len(ws)) AS dl FROM (SELECT entity, ws, unnest(ws) AS w FROM k) WHERE w IN ('nation', 'bridge') GROUP BY entity, w), f AS (SELECT w, count(*) AS n FROM p GROUP BY w),
  z AS (SELECT entity, sum(greatest(ln((nd - n + 0.5::DOUBLE) / (n + 0.5::DOUBLE)), 1e-6::DOUBLE) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / av))) AS score FROM p JOIN f USING (w), s GROUP BY entity)
  SELECT entity, round(score, 6) AS score FROM z ORDER BY score DESC, entity LIMIT 5""")
def catalyst_search(spark: SparkSession, d: str) -> DataFrame:
    rows = search.catalysts(view(spark, d, "entities"), view(spark, d, "relations"))
    return search.catalyst_search(rows, "nation bridge").select("entity", _r("score").alias("score"))


# --- pair mining ---

_PAIRS = """e AS (SELECT DISTINCT a, b FROM (SELECT source_entity AS a, target_entity AS b FROM {topics} UNION ALL SELECT target_entity, source_entity FROM {topics})), g AS (SELECT a, count(*) AS d FROM e GROUP BY a HAVING count(*) >= 6),
  s AS (SELECT x.a AS entity_a, y.a AS entity_b, count(*) AS shared FROM e x JOIN e y ON x.b = y.b AND x.a < y.a WHERE x.a IN (SELECT a FROM g) AND y.a IN (SELECT a FROM g) GROUP BY 1, 2),
  j AS (SELECT entity_a, entity_b, shared, shared / (u.d + v.d - shared) AS jaccard FROM s JOIN g u ON u.a = entity_a JOIN g v ON v.a = entity_b WHERE shared >= 3 AND shared / (u.d + v.d - shared) >= 0.15)"""


@query("synthesis_jaccard", f"WITH {_PAIRS} SELECT entity_a, entity_b, shared, round(jaccard, 6) AS jaccard FROM j")
def synthesis_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return synthesis.neighbour_pairs(view(spark, d, "topics")).withColumn("jaccard", _r("jaccard"))


@query("synthesis_ucb", f"""WITH {_PAIRS} SELECT entity_a, entity_b, round((sqrt(ln(20.0::DOUBLE) / greatest(length(entity_a) % 4, 1)) + sqrt(ln(20.0::DOUBLE) / greatest(length(entity_b) % 4, 1))) / 2, 3) AS ucb_bonus FROM j""")
def synthesis_ucb(spark: SparkSession, d: str) -> DataFrame:
    pairs = synthesis.neighbour_pairs(view(spark, d, "topics")).withColumn("covered_a", F.length("entity_a") % 4).withColumn("covered_b", F.length("entity_b") % 4)
    return synthesis.with_bonus(pairs, 20).select("entity_a", "entity_b", "ucb_bonus")


@query("spelling_variants", """SELECT DISTINCT p_name AS name, CASE WHEN length(w) > 4 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN left(w, length(w) - 1) ELSE w END AS normal FROM (SELECT p_name, CASE WHEN p_partkey % 2 = 0 THEN concat(split_part(lower(p_name), ' ', 1), 's') ELSE split_part(lower(p_name), ' ', 1) END AS w FROM {part})""")
def spelling_variants(spark: SparkSession, d: str) -> DataFrame:
    first = F.get(F.split(F.lower("p_name"), " "), F.lit(0))
    w = F.when(F.col("p_partkey") % 2 == 0, F.concat(first, F.lit("s"))).otherwise(first)
    return view(spark, d, "part").select(F.col("p_name").alias("name"), T.normal_phrase(w).alias("normal")).distinct()


@query("discipline_sets", "SELECT entity, array_to_string(list_sort(list(DISTINCT split_part(f, '--', 1))), ' ') AS disciplines FROM (SELECT source_entity AS entity, source_file AS f FROM {topics} UNION ALL SELECT target_entity, source_file FROM {topics}) GROUP BY entity")
def discipline_sets(spark: SparkSession, d: str) -> DataFrame:
    return synthesis.disciplines(view(spark, d, "topics")).withColumn("disciplines", F.array_join("disciplines", " "))


@query("synthesis_full")
def synthesis_full(spark: SparkSession, d: str) -> DataFrame:
    # A synthesis note for each brand, named after its first part.
    names = view(spark, d, "part").groupBy("p_brand").agg(F.lower(F.min("p_name")).alias("n"))
    notes = names.select(F.concat(F.lit("synthesis--"), F.replace("n", F.lit(" "), F.lit("-")), F.lit("-"), F.lower("p_brand"), F.lit(".md")).alias("path"), F.col("n").alias("content"))
    return synthesis.suggestions(view(spark, d, "topics"), notes, ucb=True)


# --- notes and code ---


@query("bridge_merge", """WITH a AS (SELECT path FROM {files} WHERE starts_with(path, 'src1/') AND contains(lower(content), 'apache')), g AS (SELECT path FROM {files} WHERE contains(lower(content), 'version'))
  SELECT path, 'semantic' AS origin FROM a UNION ALL SELECT path, 'grep' FROM g WHERE path NOT IN (SELECT path FROM a)""")
def bridge_merge(spark: SparkSession, d: str) -> DataFrame:
    files = view(spark, d, "files")
    from ..operators.fulltext import matching_terms

    return search.bridged(bm25(files, "apache", path_prefix="src1/", limit=None), matching_terms(files, ["version"])).select("path", "origin")


@query("code_search", """SELECT path, round(n / 2.0::DOUBLE, 6) AS score, split_part(path, '/', 2) AS project FROM (SELECT concat('Projects/', regexp_replace(path, '\\.md$', '.py')) AS path, 1 + CASE WHEN contains(lower(content), 'licensed') THEN 1 ELSE 0 END AS n
  FROM {files} WHERE contains(lower(content), 'version')) ORDER BY score DESC, path LIMIT 10""")
def code_search(spark: SparkSession, d: str) -> DataFrame:
    files = view(spark, d, "files").withColumn("path", F.concat(F.lit("Projects/"), F.regexp_replace("path", r"\.md$", ".py")))
    return search.code_hits(files, "version licensed").withColumn("score", _r("score"))
