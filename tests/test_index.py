"""The index: tables, migrations, postings, models, stored communities, sinks, the whole search; large searches against brute force."""

import json
import random
import struct
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import assistant, citations, communities, extraction, fulltext, fusion, graph, ingest, models, search, synthesis
from loomgraph.sources import index, notes, sinks
from test_operators import CORPUS, relations


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(CORPUS, "path string, content string")


@pytest.fixture(scope="module")
def stored(spark, files, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('postings')}"
    index.write_postings(files, folder)
    return folder


@pytest.mark.parametrize("query", ["abab", "aaa", "École", "graph search", "graph nationale", "graph graph", "search engine graph", "zzz"])
def test_stored_postings_give_the_same_scores(spark, files, stored, query):
    for mode in ("auto", "or"):
        want = {r["path"]: r["score"] for r in fulltext.bm25(files, query, mode=mode).collect()}
        assert {r["path"]: r["score"] for r in fulltext.bm25_stored(spark, stored, query, mode=mode).collect()} == pytest.approx(want)
    assert {r["path"] for r in fulltext.bm25_stored(spark, stored, query, path_prefix="C/").collect()} == {r["path"] for r in fulltext.bm25(files, query, path_prefix="C/").collect()}


def test_stored_postings_read_one_folder_for_a_trigram(spark, files, stored):
    assert not index.postings_stale(spark, files, stored) and index.postings_stale(spark, files, stored + "/none")
    assert index.postings_stale(spark, files.unionByName(files.withColumn("path", F.concat("path", F.lit("2")))), stored)
    plan = fulltext.bm25_stored(spark, stored, "nationale")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters")[1]


def test_all_ranks_by_ranges(spark):
    rows = spark.createDataFrame([(f"p{i}", float(i * 7919 % 50)) for i in range(300)], "path string, score double").repartition(7)
    got = [r["path"] for r in fulltext.ranked(rows, None).orderBy("rank").collect()]
    want = sorted(((f"p{i}", float(i * 7919 % 50)) for i in range(300)), key=lambda x: (-x[1], x[0]))
    assert got == [p for p, _ in want]
    assert [r["rank"] for r in fulltext.ranked(rows, None).orderBy("rank").collect()] == list(range(1, 301))


def test_tables_of_an_index(spark, files, tmp_path):
    base = f"file://{tmp_path}"
    folder = index.folder_of("/some/root", base)
    assert len(folder.rsplit("/", 1)[1]) == 12
    assert index.folder_of("/some/root", base, "x") == "x" and index.largest(spark, base + "/none") is None
    i = index.Index(spark, folder)
    assert i.status() == dict.fromkeys(index.SCHEMAS)
    i.write("files", files)
    i.write("files", files.limit(4))
    assert i.status()["files"] == 4 and i.status()["chunks"] is None and i.table("files").schema == index.schema("files")
    index.Index(spark, f"{base}/small").write("chunks", spark.createDataFrame([("a", 0)], "file_path string, chunk_index int").coalesce(1))
    i.write("catalysts", spark.createDataFrame([(f"entity {k}" * 50,) for k in range(2000)], "entity string"))
    assert index.largest(spark, base).rstrip("/").endswith(folder.rsplit("/", 1)[1])


def test_migrations_of_older_tables(spark):
    old = spark.createDataFrame([("a", bytearray(b"[3.0, 4.0]"), "h"), ("b", bytearray(struct.pack("<2f", 1, 0)), "h"), ("c", bytearray(struct.pack("<2e", 0, 2)), "h"), ("d", None, "h")], "path string, embedding binary, content_hash string")
    got = {r["path"]: r for r in index.migrated(old, 2).collect()}
    assert {p: r["embedding_norm"] for p, r in got.items()} == {"a": 5.0, "b": 1.0, "c": 2.0, "d": None}
    assert list(got["c"]["embedding"]) == [0.0, 2.0] and got["a"]["content"] is None


def test_summaries_and_passages(spark):
    rows = spark.createDataFrame([("a", "x" * 9000, "(pending)"), ("b", "y", "known"), ("c", "bad", "(pending)")], "path string, content string, summary string")

    def model(prompt):
        if "bad" in prompt:
            raise ValueError("no answer")
        return f" {prompt.count('x')} "

    got = {r["path"]: r["summary"] for r in extraction.pending_filled(rows, model).collect()}
    assert got == {"a": "4000", "b": "known", "c": "(summary failed: no answer)"}
    assert extraction.hypothetical("q", None) == "q" and extraction.hypothetical("bad", model) == "bad" and extraction.hypothetical("q", lambda p: " ") == "q"
    assert extraction.hypothetical("q", lambda p: p, "biology").endswith("(field: biology)")


def test_extraction_of_notes(spark):
    notes_ = spark.createDataFrame([("k/a.md", "text " * 30), ("k/b.md", "short"), ("k/c.md", "known " * 30), ("k/d.md", "broken " * 30)], "path string, content string")
    known = spark.createDataFrame([("x", "concept", "c.md")], "name string, type string, source_file string")

    def model(prompt):
        return "no" if "broken" in prompt else 'So: {"entities": [{"name": "Deep_Learning", "type": "Field"}, "Gradient-Descent", {"name": "q"}, {"type": "x"}], "relations": [{"source": "Deep Learning", "relation": "Uses", "target": "gradient descent"}, {"source": "a", "target": "a"}, "bad"]}'

    entities, rels = extraction.extract(notes_, model, known)
    assert sorted(map(tuple, entities.collect())) == [("deep learning", "field", "a.md"), ("gradient descent", "concept", "a.md")]
    assert list(map(tuple, rels.collect())) == [("deep learning", "uses", "gradient descent", "a.md")]
    old = spark.createDataFrame([(7, "deep learning", "field", "a.md")], "id long, name string, type string, source_file string")
    assert sorted(map(tuple, extraction.added(old, entities, "name", "source_file").collect())) == [(7, "deep learning", "field", "a.md"), (8, "gradient descent", "concept", "a.md")]


def test_questions():
    asked = extraction.parsed_question("q", lambda p: '```json\n{"entity": "dopamine", "max_hops": "2", "relation_filter": "causes"}\n```')
    assert (asked["entity"], asked["max_hops"], asked["relation_filter"]) == ("dopamine", 2, "causes")
    for broken in (lambda p: "no json", lambda p: 1 / 0, None):
        assert extraction.parsed_question("What connects learning with memory?", broken)["entity"] == "learning memory"


def test_stored_communities_and_json(spark, tmp_path):
    merged = communities.merged(relations(spark, [("a", "uses", "b"), ("b", "uses", "c"), ("a", "causes", "c"), ("x", "uses", "y")]))
    given = spark.createDataFrame([("a", 0), ("b", 0), ("c", 0), ("x", 1), ("y", 1)], "entity string, community_id int")
    rows, meta = communities.stored(merged, given, 1.5)
    got = {r["community_id"]: r for r in meta.collect()}
    assert got[0]["top_entities"] == ["a", "b", "c"] and got[0]["relation_types"] == {"uses": 2, "causes": 1} and got[0]["density"] == 1.0 and got[0]["resolution"] == 1.5
    assert {(r["entity"], r["community_size"]) for r in rows.collect()} == {("a", 3), ("b", 3), ("c", 3), ("x", 2), ("y", 2)}
    assert [r["entity"] for r in communities.peers(rows, "B").collect()] == ["a", "c"] and communities.member(rows, "zzz").count() == 0
    assert communities.top_entities(merged, given, inner=False).count() == 5
    sinks.communities_json(rows, meta, f"file://{tmp_path}/c")
    lines = spark.read.json(f"file://{tmp_path}/c").orderBy("community_id").collect()
    assert lines[0]["entities"] == ["a", "b", "c"] and lines[1]["meta"]["size"] == 2
    assert sinks.communities_text(meta)[0].split()[:2] == ["0", "3"]


def test_moves_in_joins_find_cliques_and_keep_most_of_the_quality(spark, monkeypatch):
    rng = random.Random(3)
    edges = [(f"{k}{i}", "uses", f"{k}{j}") for k in "abcd" for i in range(7) for j in range(i)] + [(f"{rng.choice('abcd')}{rng.randint(0, 6)}", "is", f"{rng.choice('abcd')}{rng.randint(0, 6)}") for _ in range(12)]
    merged = communities.merged(relations(spark, edges))
    quality = lambda: communities.modularity(merged, communities.leiden(merged).select("entity", "community_id")).first()["modularity"]
    whole = quality()
    monkeypatch.setattr(communities, "MOST_EDGES", 0)
    assert quality() >= 0.95 * whole > 0.3
    by = {r["resolution"]: r for r in communities.resolution_sweep(merged, (0.2, 1.0, 4.0)).collect()}
    assert by[0.2]["communities"] < by[4.0]["communities"] and sum(r["best"] for r in by.values()) == 1


def test_communities_do_not_depend_on_where_a_level_is_held(spark, monkeypatch):
    rng = random.Random(6)
    edges = [(f"n{a}", "uses", f"n{b}") for a, b in ((rng.randint(0, 50), rng.randint(0, 50)) for _ in range(170))] + [("far", "uses", "off"), ("off", "is", "away")]
    merged = communities.merged(relations(spark, edges))
    found = lambda: {r["entity"]: (r["community_id"], r["component"]) for r in communities.leiden(merged).collect()}
    held = found()
    assert held["far"] == held["off"] == held["away"] and held["far"][1] == "away" and held["n1"][1] == min(x for x in held if x[0] == "n")
    near = defaultdict(set)
    for r in merged.collect():
        if held[r["a"]] == held[r["b"]]:
            near[r["a"]].add(r["b"])
            near[r["b"]].add(r["a"])
    for start, c in held.items():  # communities are connected
        seen, level = {start}, [start]
        while level:
            level = list({y for x in level for y in near[x]} - seen)
            seen.update(level)
        assert seen == {x for x in held if held[x] == c}
    monkeypatch.setattr(communities, "MOST_EDGES", 0)
    assert found() == held


def test_distances_by_bits(spark):
    rng = random.Random(8)
    pairs = [(f"n{rng.randint(0, 90)}", f"n{rng.randint(0, 90)}") for _ in range(110)]
    edges = graph.undirected(relations(spark, [(a, "uses", b) for a, b in pairs]), prune_leaves=False)
    near = defaultdict(set)
    for a, b in pairs:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    count = defaultdict(int)
    for start in near:
        seen, level, d = {start}, [start], 0
        while level:
            level, d = list({y for x in level for y in near[x]} - seen), d + 1
            seen.update(level)
            if level:
                count[d] += len(level)
    assert graph.pairs_by_distance(edges, edges.select(F.col("src").alias("node"))) == sorted(count.items())
    one = graph.path_statistics(edges, sample=3, whole_up_to=0).first()
    assert one["pairs"] > 0 and one["diameter"] <= max(count)


def test_path_statistics_are_of_all_nodes(spark):
    n = 5100  # a star
    edges = spark.range(1, n).select(F.lit("hub").alias("src"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("dst"))
    one = graph.path_statistics(edges.union(edges.select("dst", "src"))).first()
    assert (one["pairs"], one["diameter"]) == (n * (n - 1), 2)
    assert one["mean_distance"] == pytest.approx((2 * (n - 1) + 2 * (n - 1) * (n - 2)) / (n * (n - 1)))


def test_pairs_of_neighbours_equal_brute_force(spark):
    rng = random.Random(5)
    pairs = [(f"e{rng.randint(0, 25)}", f"h{min(rng.randint(0, 40), rng.randint(0, 40))}") for _ in range(420)]
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    want = {}
    for a in near:
        for b in near:
            n = len(near[a] & near[b])
            if a < b and min(len(near[a]), len(near[b])) >= 6 and n >= 3 and n / len(near[a] | near[b]) >= 0.15:
                want[a, b] = n
    got = {(r["entity_a"], r["entity_b"]): r["shared"] for r in synthesis.neighbour_pairs(relations(spark, [(a, "uses", b) for a, b in pairs])).collect()}
    assert got == want and len(want) > 20


def test_fuzzy_names_contain_the_query(spark):
    edges = graph.directed(relations(spark, [("making", "uses", "x"), ("making", "uses", "y"), ("decision making theory", "uses", "x")]))
    assert graph.fuzzy_node(edges, "Decision Making") == "decision making theory"
    assert graph.fuzzy_node(edges, "theory of decision") == "decision making theory" and graph.fuzzy_node(edges, "of theory") is None


@pytest.mark.parametrize(
    ("head", "ranged", "want"),
    [
        ({"code": 200}, None, "ok"), ({"code": 401}, None, "error"), ({"code": 403}, None, "access_denied"), ({"code": 410}, None, "not_found"), ({"code": 404}, None, "not_found"), ({"code": 500}, None, "error"),
        ({"failure": "timed out"}, None, "timeout"), ({"failure": "refused"}, None, "error"),
        ({"code": 200, "redirect": "https://h.org/a/?x=1/"}, None, "redirect"), ({"code": 200, "redirect": "https://h.org/a?x=2"}, None, "redirect"), ({"code": 200, "redirect": "https://h.org/a?x=1/"}, None, "ok"),
        ({"code": 200, "redirect": "https://h.org/a?error=cookies"}, None, "ok"), ({"code": 200, "redirect": "https://h.org/a?cookies_not_supported"}, None, "ok"), ({"code": 200, "redirect": "https://o.org/a?error=x"}, None, "redirect"),
        ({"code": 405}, {"code": 206}, "ok"), ({"code": 405}, {"code": 404}, "not_found"), ({"code": 405}, {"code": 410}, "error"), ({"code": 405}, {"failure": "timed out"}, "error"), ({"code": 405}, None, "error"),
        ({"code": 405}, {"code": 200, "redirect": "https://h.org/b"}, "redirect"),
    ],
)
def test_status_of_replies(spark, head, ranged, want):
    urls = spark.createDataFrame([("n.md", 3, "https://h.org/a?x=1")], "path string, line_number int, url string")
    out = citations.checked(urls, lambda u: head, (lambda u: ranged) if ranged else None)
    assert out.first()["status"] == want
    if want == "redirect":
        assert citations.fixes(out).first()["replacement"].startswith("https://")
        assert sinks.citations_text(out).first()["line"].startswith("REDIRECT  line 3")


def test_the_whole_search(spark):
    rows = [(f"k/n{i}.md", f"decision making note {i} " + ("graph theory " * (i % 4)), f"summary {i}") for i in range(12)]
    embed = models.hashed_embedder(32)
    files = spark.createDataFrame([(*r, embed([r[1]])[0]) for r in rows], "path string, content string, summary string, embedding array<float>")
    entities = spark.createDataFrame([("decision making", "concept", "n3.md"), ("graph theory", "theory", "n5.md"), ("decision", "concept", "n7.md")], "name string, type string, source_file string")
    rel = relations(spark, [("decision making", "uses", "graph theory"), ("decision", "is", "decision making")])
    given = spark.createDataFrame([("decision making", 1), ("graph theory", 1), ("decision", 2)], "entity string, community_id int")
    cats = search.catalysts(entities, rel)
    plain = assistant.full_search(files, "decision making", embed, top=4)
    assert plain.results.count() == 4 and plain.edges is None and plain.context() is None
    lifted = assistant.full_search(files, "decision making", embed, entities=entities, relations=rel, communities=given, top=12, mode="hybrid")
    score = {r["path"]: r["score"] for r in lifted.results.collect()}
    base = {r["path"]: r["score"] for r in assistant.full_search(files, "decision making", embed, top=12).results.collect()}
    assert score["k/n3.md"] == pytest.approx(base["k/n3.md"] + 0.005) and score["k/n1.md"] == pytest.approx(base["k/n1.md"])
    context = lifted.context()
    assert {e["entity"] for e in context["relations"]} >= {"decision making"} and context["communities"]
    whole = assistant.full_search(files, "graph theory", None, entities=entities, relations=rel, catalysts=cats, top=3, scorer=lambda s: F.when(F.contains(s, F.lit("note 7")), 1.0).otherwise(0.0))
    got = json.loads(sinks.results_json(whole.results, whole.context()))
    assert got["results"][0]["path"] == "k/n7.md" and len(got["results"]) == 3 and got["graph_context"]["relations"]
    assert whole.catalysts.first()["entity"] == "graph theory" and whole.confidence.count() == 1
    assert sinks.results_text(whole.results)[0].endswith("k/n7.md") and isinstance(json.loads(sinks.results_json(plain.results)), list)
    failing = assistant.full_search(files, "decision making", lambda t: 1 / 0, top=4)
    assert failing.results.count() == 4
    hyde = assistant.full_search(files, 'hyde:"graph note"', embed, top=3, model=lambda p: "graph theory " * 3)
    assert hyde.results.orderBy("rank").first()["path"] in {f"k/n{i}.md" for i in (3, 7, 11)}


def test_a_graph_as_json(spark):
    rel = relations(spark, [("a", "uses", "b"), ("b", "uses", "c"), ("a", "is", "c")])
    entities = spark.createDataFrame([(n, "tool", f"{n}.md") for n in "abc"], "name string, type string, source_file string")
    text = sinks.graph_json(graph.export_nodes(rel, entities), graph.export_links(rel), 3, "now").first()["json"]
    got = json.loads(text)
    assert got["metadata"] == {"total_entities": 3, "total_relations": 3, "total_notes": 3, "generated": "now"} and [n["type"] for n in got["nodes"]] == ["technique"] * 3


def test_small_helpers(spark, tmp_path):
    rows = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 1, "z")], "k string, i int, v string")
    assert {(r["k"], r["v"]) for r in citations.first_per_key(rows, "k", "i").collect()} == {("a", "y"), ("b", "z")}
    assert graph.chain_summary([{"relation": "causes"}, {"relation": "← part_of"}]) == {"steps": 2, "causal": 1, "structural": 1}
    assert search.verdict(1, 0) == "no implementation found" and search.status({"a": rows, "b": None}) == {"a": 3, "b": None}
    notes.write_json(rows, f"file://{tmp_path}/j")
    assert spark.read.json(f"file://{tmp_path}/j").count() == 3
    rel = relations(spark, [("a", "x", "a"), ("a", "x", "b")])
    assert {r["name"]: r["connections"] for r in graph.connection_counts(rel, loops_once=True).collect()} == {"a": 2, "b": 1}
    chunks = spark.createDataFrame([("a", 0), ("gone", 0)], "file_path string, chunk_index int")
    assert ingest.without_orphans(chunks, spark.createDataFrame([("a",)], "path string")).count() == 1
    assert fusion.fuse([spark.createDataFrame([("p", 1)], "path string, rank int")]).count() == 1


def test_answers_from_notes(spark):
    files = spark.createDataFrame([(f"n{i}.md", f"graph theory {i}", "") for i in range(9)], "path string, content string, summary string")
    out = search.answer(files, "graph theory", lambda prompt: f"{prompt.count('###')} notes")
    assert out["answer"] == "7 notes" and len(out["sources"]) == 5
