"""Operators on small hand-made inputs, against the standard library or brute force."""

import itertools
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators import chunking, citations, communities, fulltext, fusion, graph, ingest, models, search, vector
from loomgraph.sources import notes
from loomgraph.streaming.notes import FILES, ingest_stream

CORPUS = [
    ("a/one.md", "ababab abab École nationale"), ("a/two.md", "aaaaa and ÉCOLE again"), ("b/three.md", ""), ("b/four.md", "ab"), ("A/five.md", "ecole aaa graph search engine"),
    ("c/six.md", "graph graph search"), ("c/seven.md", "the search for graphs, engine"), ("c/eight.md", "nothing here"), ("c/nine.md", "engine engine"),
]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(CORPUS, "path string, content string")


@pytest.fixture(scope="module")
def fts():
    c = sqlite3.connect(":memory:")
    c.execute("CREATE VIRTUAL TABLE t USING fts5(path UNINDEXED, content, tokenize='trigram')")
    c.executemany("INSERT INTO t VALUES (?, ?)", CORPUS)
    return c


def by_fts(fts, words, glue):
    match = f" {glue} ".join(f'"{w}"' for w in words)
    return {p: -s for p, s in fts.execute("SELECT path, bm25(t) FROM t WHERE t MATCH ?", (match,))}


@pytest.mark.parametrize("query", ["abab", "aaa", "École", "ecole", "graph search", "graph engine", "graph nationale", "graph graph", "search engine graph", "zzz"])
def test_bm25_equals_a_full_text_index(files, fts, query):
    words = fulltext.query_words(query)
    want = by_fts(fts, words, "AND")
    if len(want) < 3 and len(words) > 1:
        want = by_fts(fts, words, "OR")
    got = {r["path"]: r["score"] for r in fulltext.bm25(files, query, limit=None).collect()}
    assert got == pytest.approx(want, abs=1e-8)


def test_bm25_path_prefix_and_short_words(files):
    assert {r["path"] for r in fulltext.bm25(files, "graph", path_prefix="c/").collect()} == {"c/six.md", "c/seven.md"}
    assert {r["path"] for r in fulltext.bm25(files, "ecole", path_prefix="a/F").collect()} == {"A/five.md"}
    assert fulltext.bm25(files, "ab", limit=5).count() == 0
    assert fulltext.bm25(files.limit(0), "graph").count() == 0


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [("Decision-Making", "decision making"), ("decision_making", "decision making"), ("b-tree", "b-tree"), ("5-HT1A", "5-ht1a"), ("T-cell", "t-cell"), ("aaa-bbb-ccc", "aaa bbb ccc"), ("  a   b ", "a b")],
)
def test_names(spark, raw, want):
    assert one(spark, T.normal_name(F.col("n")), n=raw) == want


def test_cosine_of_nothing_is_nothing(spark):
    rows = spark.createDataFrame([("a", [0.0, 0.0]), ("b", [1.0, -1.0]), ("c", [1.0, -1.0]), ("d", [-1.0, 1.0])], "path string, embedding array<float>")
    got = {r["path"]: round(r["score"], 6) for r in vector.scored(rows, [2.0, -2.0]).collect()}
    assert got == {"a": 0.0, "b": 1.0, "c": 1.0, "d": -1.0}


def test_rank_fusion(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2), ("z", 3)], "path string, rank int")
    b = spark.createDataFrame([("y", 1), ("x", 2), ("w", 3)], "path string, rank int")
    got = [(r["path"], r["rank"]) for r in fusion.fuse([a, b]).orderBy("rank").collect()]
    assert [p for p, _ in got] == ["y", "x", "z", "w"]  # mirrored ranks tie: by descending path
    assert fusion.fuse([a, b.limit(0)]).count() == 3
    assert [r["path"] for r in fusion.fuse_passes(a, b).orderBy("rank").collect()] == ["x", "y", "z", "w"]


def relations(spark, edges):
    rows = [(i, a, r, b, f"f{i}.md", 0.8) for i, (a, r, b) in enumerate(edges)]
    return spark.createDataFrame(rows, "id long, source_entity string, relation string, target_entity string, source_file string, confidence double")


def test_paths(spark):
    hub = [("hub", "uses", f"leaf{i}") for i in range(5)] + [(f"leaf{i}", "uses", f"leaf{i + 1}") for i in range(4)]
    diamond = [("start", "uses", "hub"), ("start", "uses", "plain"), ("hub", "uses", "end"), ("plain", "uses", "end"), ("start", "is", "start"), ("p", "x", "q"), ("q", "x", "r"), ("r", "x", "p")]
    edges = graph.undirected(relations(spark, hub + diamond))
    assert graph.find_path(edges, "start", "end") == ["start", "hub", "end"]
    assert graph.find_path(edges, "START ", "start") == ["start"]
    assert graph.find_path(edges, "start", "p") == [] and graph.find_path(edges, "start", "nowhere") == []
    assert graph.find_path(edges, "plain", "leaf0", max_depth=2) == [] and len(graph.find_path(edges, "plain", "leaf0", max_depth=3)) == 4
    assert sorted(graph.find_all_paths(edges, "start", "end")) == [["start", "hub", "end"], ["start", "plain", "end"]]


def brute_distance(pairs, a, b):
    seen, level = {a: 0}, [a]
    while level:
        new = []
        for x in level:
            for y in {q for p in pairs for q in p if x in p and q != x}:
                if y not in seen:
                    seen[y] = seen[x] + 1
                    new.append(y)
        level = new
    return seen.get(b)


def test_path_lengths_and_components_of_random_graphs(spark):
    rng = random.Random(4)
    pairs = [(f"n{rng.randint(0, 40)}", f"n{rng.randint(0, 40)}") for _ in range(45)]
    edges = graph.undirected(relations(spark, [(a, "uses", b) for a, b in pairs]), prune_leaves=False)
    names = sorted({x for p in pairs if p[0] != p[1] for x in p})
    for a, b in [(names[0], names[-1]), (names[3], names[9])]:
        path, want = graph.find_path(edges, a, b, max_depth=12), brute_distance(pairs, a, b)
        assert (len(path) - 1 if path else None) == want
        assert all(tuple(x) in pairs or tuple(x[::-1]) in pairs for x in itertools.pairwise(path))
    comp = {r["node"]: r["component"] for r in graph.components(edges).collect()}
    for a in names[:12]:
        for b in names[-12:]:
            assert (comp[a] == comp[b]) == (brute_distance(pairs, a, b) is not None)
    reach = {r["node"]: r["distance"] for r in graph.distances(edges, spark.createDataFrame([(names[0],)], "node string")).collect()}
    assert all(reach.get(b) == brute_distance(pairs, names[0], b) for b in names if b != names[0])


def test_paths_of_a_layered_graph_equal_all_ways_sorted(spark):
    from loomgraph.sources import tables

    pairs = [("s", f"a{i}") for i in range(5)] + [(f"a{i}", f"b{j}") for i in range(5) for j in range(6)] + [(f"b{j}", f"c{k}") for j in range(6) for k in range(2)] + [("c1", "t"), ("b5", "c0"), ("c0", "c1"), ("c0", "u"), ("u", "t"), *((f"a{i}", "x") for i in (1, 3)), *(("t", f"far{i}") for i in range(9))]
    near = {}
    for x, y in pairs:
        near.setdefault(x, set()).add(y)
        near.setdefault(y, set()).add(x)
    ways = sorted(tuple((-len(near[n]), n) for n in (f"a{i}", f"b{j}", "c1")) for i in range(5) for j in range(6))
    want = [["s", *(n for _, n in w), "t"] for w in ways]
    edges = graph.undirected(relations(spark, [(x, "uses", y) for x, y in pairs]), prune_leaves=False)
    rows, real = [], tables.staged
    graph.staged = lambda df, what="table": (out := real(df, what), rows.append((what, out)))[0]
    try:
        assert graph.find_path(edges, "s", "t") == want[0]
        assert graph.find_all_paths(edges, "s", "t") == want[:3]
    finally:
        graph.staged = real
    # Of 30 ways to c1 three are carried on, and what lies behind the end is not visited.
    assert all(r["count"] <= 3 for what, df in rows if what == "front" and "path" in df.columns for r in df.groupBy("node").count().collect())
    assert not any(df.filter("node like 'far%'").count() for what, df in rows if what == "front" and "path" in df.columns)
    more = graph.find_all_paths(edges, "s", "t", max_paths=40)
    assert more[:30] == want and len(more) == 40 and all(len(p) == 6 and p[3:] == ["c0", "u", "t"] for p in more[30:])  # one edge longer
    assert graph.find_path(edges, "s", "t", max_depth=3) == [] == graph.find_all_paths(edges, "s", "t", max_depth=3)


def test_causal_chains(spark):
    r = relations(spark, [("a", "part of", "b"), ("a", "causes", "c"), ("b", "causes", "d"), ("c", "is a", "d"), ("d", "uses", "a"), ("e", "causes", "d")])
    steps = lambda x: [(s["src"], s["relation"], s["dst"]) for s in x]
    assert steps(graph.causal_chain(r, "a", "d")) == [("a", "causes", "c"), ("c", "is_a", "d")]
    assert steps(graph.causal_chain(r, "a", "d", prefer_causal=False)) == [("a", "part_of", "b"), ("b", "causes", "d")]
    assert len(graph.causal_chain(r, "a", "a")) == 3  # a cycle
    assert graph.causal_chain(r, "d", "e", allow_reverse=False) == [] and steps(graph.causal_chain(r, "d", "e"))[0][1].startswith("← ")


def test_leiden_of_two_cliques(spark):
    clique = lambda k: [(f"{k}{i}", "uses", f"{k}{j}") for i in range(5) for j in range(i)]
    merged = communities.merged(relations(spark, [*clique("a"), *clique("b"), ("a0", "uses", "b0"), ("a0", "causes", "a1")]))
    found = {r["entity"]: r["community_id"] for r in communities.leiden(merged).collect()}
    assert len({found[f"a{i}"] for i in range(5)}) == 1 and len({found[f"b{i}"] for i in range(5)}) == 1 and found["a0"] != found["b0"]
    w = {(r["a"], r["b"]): r["weight"] for r in merged.collect()}
    assert w["a0", "a1"] == pytest.approx(1.6)
    given = communities.leiden(merged).select("entity", "community_id")
    two_m = 2 * sum(w.values())
    want = sum(x for (a, b), x in w.items() if found[a] == found[b]) / (two_m / 2)
    for c in set(found.values()):
        want -= (sum(x * ((found[a] == c) + (found[b] == c)) for (a, b), x in w.items()) / two_m) ** 2
    assert communities.modularity(merged, given).first()["modularity"] == pytest.approx(want)


def test_merges_and_pruning(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1")], "path string, v string")
    new = spark.createDataFrame([("b", "2"), ("c", "2")], "path string, v string")
    assert sorted(map(tuple, ingest.upserted(old, new, "path").collect())) == [("a", "1"), ("b", "2"), ("c", "2")]
    names = spark.createDataFrame([("a", "concept", "f"), ("b", "concept", "f"), ("lone", "concept", "f"), ("c", "concept", "f")], "name string, type string, source_file string")
    r = relations(spark, [("a", "uses", "b"), ("c", "uses", "missing")])
    left, kept = ingest.prune_orphans(names, r)
    assert {x["name"] for x in left.collect()} == {"a", "b", "c"} and kept.count() == 1  # c goes in a second run only
    assert {x["name"] for x in ingest.prune_orphans(names, r, to_fixpoint=True)[0].collect()} == {"a", "b"}


def test_sections_of_notes():
    assert len(chunking.sections("no heading at all")) == 1
    text = "intro\n" + "## A\n" + "x" * 250 + "\n## B\nshort\n## C\n" + "y" * 2500 + "\n## D\ntail"
    parts = chunking.sections(text)
    assert [p["heading"] for p in parts][:1] == ["A"] and parts[0]["start_line"] == 1
    assert all(len(p["content"]) <= chunking.MOST for p in parts)
    assert parts[-1]["content"].endswith("tail")


def test_windows_of_code(spark):
    text = "".join(random.Random(1).choices("ab\n", k=5000))
    got = [r for r in chunking.code_chunks(spark.createDataFrame([("f.py", text), ("e.py", "")], "path string, content string")).orderBy("chunk_index").collect()]
    assert [r["content"] for r in got] == [text[i : i + 2000] for i in range(0, 4700, 1700)]
    assert all(r["start_line"] == text[: 1700 * i].count("\n") + 1 for i, r in enumerate(got))


def test_urls(spark):
    text = "[a](https://good.site/x) https://good.site/x, http://localhost:3/ [b](rel/x.md) mailto:x@y.z\nhttps://arxiv.org/abs/2413.00001 and https://arxiv.org/abs/2701.00001. https://doi.org/10.1234/abc"
    urls = citations.extract_urls(spark.createDataFrame([("n.md", text)], "path string, content string"))
    got = {r["url"]: r["status"] for r in citations.judged(urls).collect()}
    assert got["https://good.site/x"] == "fetch" and got["http://localhost:3/"] == "skipped" and got["rel/x.md"] == "skipped"
    assert got["https://arxiv.org/abs/2413.00001"] == got["https://arxiv.org/abs/2701.00001"] == got["https://doi.org/10.1234/abc"] == "hallucinated"
    replies = {"https://good.site/x": {"code": 404}}
    assert {r["url"]: r["status"] for r in citations.checked(urls, lambda u: replies[u]).collect()}["https://good.site/x"] == "not_found"


def test_model_answers(spark):
    raw = spark.createDataFrame([("a", '```json\n{"entities": ["x"], "relations": [{"source": "x", "relation": "uses", "target": "y"}]}\n```'), ("b", 'Here: {"entities": [], "relations": []} ok'), ("c", "no json")], "path string, answer string")
    got = {r["path"]: r["parsed"] for r in ingest.extracted(raw).collect()}
    assert '"target":"y"' in got["a"]["relations"][0].replace(" ", "") and got["b"]["relations"] == [] and not (got["c"] and got["c"]["relations"])
    assert models.routed("why this function fails", "small", "coder") == "coder" and models.routed("why the sky", "small", "coder") == "small"
    scores = spark.createDataFrame([("7",), ("score 12",), ("none",), (None,)], "s string").select(models.parsed_score(F.col("s")).alias("x"))
    assert [r["x"] for r in scores.collect()] == [0.7, 1.0, 0.5, 0.5]


def test_failing_embedder_gets_shorter_texts(spark):
    def embedder(texts):
        if any(len(t) > 1500 for t in texts):
            raise ValueError("too long")
        return [[float(len(t))] for t in texts]

    rows = spark.createDataFrame([(1, "x" * 9000), (2, "y"), (3, None)], "id int, text string")
    assert {r["id"]: r["embedding"] for r in models.embedded(rows, "text", embedder).collect()} == {1: [1000.0], 2: [1.0], 3: [0.0]}


def test_typed_queries():
    assert search.typed_parts('lex:word vec:"a phrase" rest of it') == {"lex": ["word"], "vec": ["a phrase"], "hyde": [], "plain": ["rest of it"]}


def test_budget(spark):
    rows = spark.createDataFrame([(1, "a", "x" * 50), (2, "b", "y" * 500), (3, "c", "z")], "rank int, path string, t string")
    for most, n in ((1000, 3), (57 + 7 + 201, 2), (57 + 7 + 200, 1)):
        assert fusion.context(rows, F.col("t"), most=most).count() == n


def test_files_of_a_folder(spark, tmp_path):
    for name, data in {"a.md": b"note", "b.py": b"x = 1", "c.png": b"no", ".git/d.md": b"no", "sub/e.md": b"bad \xff byte", "off/.index-ignore": b"", "off/f.md": b"no", "off/deep/g.md": b"no", "blank.md": b"  "}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {r["path"]: r["content"] for r in notes.collect_files(spark, str(tmp_path)).collect()}
    assert got == {"a.md": "note", "b.py": "x = 1", "sub/e.md": "bad � byte"}


def test_stream_equals_batch(spark, tmp_path):
    source, target = f"{tmp_path}/in", f"{tmp_path}/out"
    for rows in ([("a", "1"), ("b", "1")], [("b", "2"), ("c", "2")]):
        spark.createDataFrame(rows, "path string, content string").coalesce(1).write.mode("append").parquet(source)
        ingest_stream(spark, source, target, f"{tmp_path}/check").awaitTermination()
    got = {r["path"]: r["content"] for r in spark.read.schema(FILES).parquet(f"{target}/v1").collect()}
    assert got == {"a": "1", "b": "2", "c": "2"}


def test_every_document_is_a_note_with_its_whole_text(spark, data):
    from loomgraph.plans import registry
    from loomgraph.sources.tables import view

    texts = {r["doc_id"]: r["text"] for r in view(spark, data, "documents").collect()}
    got = view(spark, data, "notes").collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    assert all(texts[r["doc_id"]] in r["content"] for r in got)
    long = {r["path"] for r in got if len(r["content"]) > chunking.WHOLE}
    chunked = {r["path"] for r in registry.QUERIES["markdown_chunks"](spark, data).collect()}
    assert long and long <= chunked
