"""Every registered query against its SQL, as the driver compares them; the others return rows."""

import math

import duckdb
import pytest

from loomgraph.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)) and not hasattr(v, "asDict"):
        return [plain(x) for x in v]
    if hasattr(v, "asDict"):
        return sorted((k, plain(x)) for k, x in v.asDict().items())
    if isinstance(v, dict):
        return sorted((k, plain(x)) for k, x in v.items())
    return v


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, data, duck, name):
    df = registry.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    found = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(repr([plain(r[i]) for i in at]) for r in found.fetchall())


@pytest.mark.parametrize("name", ["iterative_search", "typed_search", "markdown_chunks", "citation_liveness", "shortest_path", "all_paths", "causal_chain", "leiden", "graph_overview"])
def test_query_without_sql_has_rows(spark, data, name):
    assert registry.QUERIES[name](spark, data).columns


def test_entry_points():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and set(registry.QUERIES) <= set(e.queries())
