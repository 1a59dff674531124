"""Tables of an index, the shared folder, and views of the benchmark tables in the shape of notes and a knowledge graph."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []

NAMES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations", "orders", "lineitem", "customer", "supplier", "part", "nation", "region", "events")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="loomgraph-"))
    return _OWN[0]


def staged(df: DataFrame, what: str = "table") -> DataFrame:
    """Write into the shared folder and read back: cuts the lineage of loops, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Views in SQL that Spark and DuckDB both read; braces name tables or other views.
VIEWS = {
    "files": "SELECT doc_id, concat(source, '/', lang, '--', CAST(doc_id AS STRING), '.md') AS path, text AS content, substring(text, 1, 100) AS summary FROM {documents}",
    "relations": """
        SELECT l_orderkey * 100 + l_linenumber AS id, concat('customer ', CAST(o_custkey AS STRING)) AS source_entity, 'causes' AS relation,
               concat('part ', CAST(l_partkey AS STRING)) AS target_entity,
               concat(CASE o_custkey % 3 WHEN 0 THEN 'bio' WHEN 1 THEN 'cs' ELSE 'econ' END, '--', CAST(l_orderkey % 97 AS STRING), '.md') AS source_file,
               0.5 + (l_linenumber % 5) / CAST(10 AS DOUBLE) AS confidence
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
        UNION ALL
        SELECT l_orderkey * 100 + 50 + l_linenumber, concat('part ', CAST(l_partkey AS STRING)), 'uses', concat('supplier ', CAST(l_suppkey AS STRING)),
               concat('ops--', CAST(l_partkey % 89 AS STRING), '.md'), CAST(0 AS DOUBLE)
        FROM {lineitem}
        UNION ALL
        SELECT -s_suppkey, concat('supplier ', CAST(s_suppkey AS STRING)), 'part_of', concat('nation ', CAST(s_nationkey AS STRING)),
               concat('geo--', CAST(s_nationkey AS STRING), '.md'), CAST(0.8 AS DOUBLE) FROM {supplier}
        UNION ALL
        SELECT -1000000000 - n_nationkey, concat('nation ', CAST(n_nationkey AS STRING)), 'is_part_of', concat('region ', CAST(n_regionkey AS STRING)),
               'geo--regions.md', CAST(NULL AS DOUBLE) FROM {nation}""",
    "topics": """
        SELECT p_partkey AS id, lower(p_name) AS source_entity, 'related_to' AS relation, lower(p_brand) AS target_entity,
               concat(lower(substring(p_type, 1, 3)), '--', CAST(p_partkey % 31 AS STRING), '.md') AS source_file, CAST(0.8 AS DOUBLE) AS confidence
        FROM {part}""",
    "entities": """
        SELECT name,
               CASE substring(name, 1, 3) WHEN 'cus' THEN 'company' WHEN 'par' THEN 'process' WHEN 'sup' THEN 'Protein' WHEN 'nat' THEN 'country' ELSE 'galaxy' END AS type, source_file
        FROM (SELECT source_entity AS name, source_file FROM {relations} UNION SELECT target_entity, source_file FROM {relations})""",
    "communities": """
        SELECT concat('customer ', CAST(c_custkey AS STRING)) AS entity, CAST(c_nationkey % 7 AS INT) AS community_id FROM {customer}
        UNION ALL SELECT concat('supplier ', CAST(s_suppkey AS STRING)), CAST(s_nationkey % 7 AS INT) FROM {supplier}
        UNION ALL SELECT concat('part ', CAST(p_partkey AS STRING)), CAST(p_partkey % 7 AS INT) FROM {part}
        UNION ALL SELECT concat('nation ', CAST(n_nationkey AS STRING)), CAST(n_nationkey % 7 AS INT) FROM {nation}
        UNION ALL SELECT concat('region ', CAST(r_regionkey AS STRING)), CAST(r_regionkey % 7 AS INT) FROM {region}""",
    # Every document with its whole text; without a page of the same number the url is made from doc_id.
    "notes": """
        SELECT doc_id, path, concat('---\ntags: [', lang, ', ', source, ']\n---\n## Topic ', source, ' of ', lang, '\n', text, ' [[', source, '|x]] [l](', url, ') `id_', lang, '` see ', url, '.\n') AS content, summary
        FROM (SELECT d.doc_id, d.lang, d.source, d.text, f.path, f.summary, coalesce(p.url, concat('https://example.org/', CAST(d.doc_id AS STRING))) AS url
              FROM {documents} d JOIN {files} f ON d.doc_id = f.doc_id LEFT JOIN {pages} p ON d.doc_id = p.page_id)""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table or a view of tables."""
    if name not in VIEWS:
        return table(spark, sf_dir, name)
    import string

    needed = {f for _, f, _, _ in string.Formatter().parse(VIEWS[name]) if f}
    return spark.sql(VIEWS[name], **{n: view(spark, sf_dir, n) for n in sorted(needed)})


def with_views(sql: str) -> str:
    """DuckDB SQL with the views that it names (``{files}``) as common table expressions."""
    import string

    order: list[str] = []

    def need(text: str) -> None:
        for _, f, _, _ in string.Formatter().parse(text):
            if f in VIEWS and f not in order:
                need(VIEWS[f])
                order.append(f)

    need(sql)
    plain = lambda text: text.format(**{n: n if n in NAMES else f"v_{n}" for n in {*NAMES, *VIEWS}})
    ctes = [f"v_{n} AS ({plain(VIEWS[n])})" for n in order]
    body = plain(sql).strip()
    if not ctes:
        return body
    if body[:14].upper() == "WITH RECURSIVE":
        return "WITH RECURSIVE " + ", ".join(ctes) + "," + body[14:]
    if body[:5].upper() == "WITH ":
        return "WITH " + ", ".join(ctes) + "," + body[4:]
    return "WITH " + ", ".join(ctes) + " " + body
