"""Search: hybrid, typed and two-pass retrieval, catalysts, community boost, graph context, answers, notes and code together."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab as V
from .fulltext import bm25, matching_terms, ranked, token_search
from .fusion import context, fuse, fuse_passes, reranked
from .graph import connection_counts, word_match
from .models import Embedder, TextModel
from .vector import chunk_candidates, promoted, scored


def typed_parts(query: str) -> dict[str, list[str]]:
    """``lex:word vec:"a phrase" hyde:x`` and the rest as ``plain``."""
    out: dict[str, list[str]] = {"lex": [], "vec": [], "hyde": [], "plain": []}

    def take(m: re.Match) -> str:
        out[m[1]].append(m[2].strip('"'))
        return " "

    rest = re.sub(r'\b(lex|vec|hyde):("[^"]*"|\S+)', take, query).strip()
    if rest:
        out["plain"].append(re.sub(r"\s+", " ", rest))
    return out


def semantic(files: DataFrame, vector: list[float], query: str, chunks: DataFrame | None = None, most: int = 200) -> DataFrame:
    """(path, score, rank): cosine and keywords; with chunks, the best files are lifted by their best chunk."""
    base = scored(files, vector, query).select("path", "score")
    if chunks is not None:
        near = scored(chunk_candidates(base, chunks, most).withColumn("path", F.col("file_path")), vector, query)
        base = promoted(base, near).select("path", "score")
    return ranked(base, None)


def search(files: DataFrame, query: str, embedder: Embedder | None = None, chunks: DataFrame | None = None, mode: str = "hybrid", top: int = 5, path_prefix: str | None = None, hyde: TextModel | None = None) -> DataFrame:
    """(path, score, rank). Without an embedder, or where it fails, keywords alone; ``mode``: hybrid, semantic or bm25.

    ``hyde`` gives the passage that is embedded for a query, or for the ``hyde:`` parts of a typed one.
    """
    typed = typed_parts(query)
    if any(typed[k] for k in ("lex", "vec", "hyde")):
        lists = [bm25(files, q, path_prefix, top * 4) for q in typed["lex"] + typed["plain"]]
        if embedder:
            some = _under(files, path_prefix)
            lists += [semantic(some, embedder([q])[0], q) for q in typed["vec"] + [hyde(q) if hyde else q for q in typed["hyde"]] + typed["plain"]]
        return fuse(lists, top=top)
    vector = None
    if embedder and mode != "bm25":
        try:
            vector = embedder([hyde(query) if hyde else query])[0]
        except Exception:  # noqa: BLE001  the model may fail in any way; keywords remain
            vector = None
    if vector is None:
        return bm25(files, query, path_prefix, top * 3).filter(F.col("rank") <= top)
    near = semantic(_under(files, path_prefix), vector, query, chunks)
    if mode == "semantic":
        return near.filter(F.col("rank") <= top)
    return fuse([near, bm25(files, query, path_prefix, max(top * 4, 50))], top=top)


def _under(files: DataFrame, prefix: str | None) -> DataFrame:
    return files.filter(F.lower("path").startswith(prefix.lower())) if prefix else files


def expansion_terms(found: DataFrame, files: DataFrame, query: str, top: int = 4, most: int = 10) -> DataFrame:
    """(term, place) from the best files: links, front-matter tags, headings with new words, identifiers; each once."""
    words = sorted(set(re.findall(r"\w+", query.lower())))
    q = F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")
    docs = found.filter(F.col("rank") <= top).select("path", "rank").join(files.select("path", F.coalesce("content", "summary").alias("text")), "path")
    front = F.regexp_extract("text", r"(?s)\A---\n(.*?)\n---", 1)
    kinds = [
        F.transform(F.regexp_extract_all("text", F.lit(r"\[\[([^\]|#]{2,60})(?:[|#][^\]]{0,60})?\]\]"), F.lit(1)), lambda x: F.trim(x)),
        F.transform(F.regexp_extract_all(front, F.lit(r"[-\s]([a-z][a-z0-9_-]{2,30})"), F.lit(1)), lambda x: F.replace(x, F.lit("-"), F.lit(" "))),
        F.transform(F.regexp_extract_all("text", F.lit(r"(?dm)^#{1,3}\s+(.{3,60})$"), F.lit(1)), lambda x: F.trim(x)),
        F.regexp_extract_all("text", F.lit(r"`([a-zA-Z_][a-zA-Z0-9_:.-]{2,40})`"), F.lit(1)),
    ]
    each = docs.select("rank", F.posexplode(F.array(*kinds)).alias("kind", "terms")).select("rank", "kind", F.posexplode("terms").alias("i", "term"))
    low = F.lower("term")
    low = F.when(F.col("kind") == 0, F.replace(low, F.lit("-"), F.lit(" "))).otherwise(low)
    each = each.withColumn("low", low)
    new = F.array_except(F.filter(F.split("low", r"(?U)\W+"), lambda w: w != ""), q)
    stop = F.array(*[F.lit(w) for w in sorted(V.HEADING_STOP)])
    own = F.filter(F.split("low", r"(?U)\W+"), lambda w: w != "")
    good = (
        F.when(F.col("kind") == 0, F.size(F.array_except(F.split("low", r"\s+"), q)) > 0)
        .when(F.col("kind") == 2, ~F.array_contains(stop, F.col("low")) & (F.size(F.array_except(own, stop)) > 0) & (F.size(new) >= 2))
        .otherwise(~F.array_contains(q, F.col("low")))
    )
    at = F.struct("rank", "kind", "i")
    once = each.filter(good).groupBy("low").agg(F.min(at).alias("at"), F.min_by("term", at).alias("term"))
    return once.orderBy("at").limit(most).select("term", F.row_number().over(W.orderBy("at")).alias("place"))


def iterative(files: DataFrame, query: str, embedder: Embedder | None = None, top: int = 5, **options) -> DataFrame:
    """A first pass, at most ten terms from its best files, a second pass with them, both fused."""
    wide = max(top, 10) * 2
    first = search(files, query, embedder, top=wide, **options)
    terms = [r["term"] for r in expansion_terms(first, files, query).orderBy("place").collect()]  # ten at most
    if not terms:
        return first.filter(F.col("rank") <= top)
    second = search(files, f"{query} {' '.join(terms)}", embedder, top=wide, **options)
    return fuse_passes(first, second, top=top)


def community_boost(found: DataFrame, query: str, entities: DataFrame, communities: DataFrame, weight: float = 0.005) -> DataFrame:
    """Adds ``weight`` for each entity of a file that is in a community of an entity that the query names."""
    words = [w for w in query.lower().split() if len(w) > 3]
    name = F.lower("name")
    hit = F.lit(False)
    for w in words:
        hit = hit | (F.contains(name, F.lit(w)) & word_match(name, w))
    asked = entities.filter(hit).select(F.col("name").alias("entity")).distinct().join(communities, "entity").select("community_id").distinct()
    inside = entities.select(F.col("name").alias("entity"), "source_file").distinct().join(communities, "entity").join(asked, "community_id", "left_semi")
    bonus = inside.groupBy("source_file").agg((weight * F.count_distinct("entity")).alias("bonus"))
    rows = found.withColumn("source_file", T.base_name(F.col("path"))).join(bonus, "source_file", "left")
    out = rows.select("path", (F.col("score") + F.coalesce("bonus", F.lit(0.0))).alias("score"), F.col("rank").alias("old_rank"))
    return out.withColumn("rank", F.row_number().over(W.orderBy(F.col("score").desc(), "old_rank")))


def context_entities(query: str, result_files: list[str], entities: DataFrame, relations: DataFrame, most: int = 6) -> DataFrame:
    """(name, relevance, connections, rank): ten for the whole phrase, one for each word, one for a best result's file."""
    low = query.lower().strip()
    words = [w for w in low.split() if len(w) >= 4]
    name = F.lower("name")
    points = F.when(F.contains(name, F.lit(low)), 10).otherwise(0)
    for w in words:
        points = points + F.when(F.contains(name, F.lit(w)) & word_match(F.col("name"), w), 1).otherwise(0)
    base = entities.select("name").distinct().withColumn("p", points).filter("p > 0")
    shown = [p.rsplit("/", 1)[-1] for p in result_files[:3]]
    from_file = entities.filter(F.col("source_file").isin(*shown) if shown else F.lit(False)).groupBy("name").agg(F.count_distinct("source_file").alias("f"))
    full = base.join(from_file, "name", "left").join(connection_counts(relations), "name", "left")
    n = F.coalesce("connections", F.lit(0))
    rows = full.select("name", (F.col("p") + F.coalesce("f", F.lit(0))).alias("relevance"), n.alias("connections"))
    order = [(F.col("relevance") * F.greatest(F.col("connections"), F.lit(1))).desc(), F.col("name")]
    return rows.orderBy(*order).limit(most).withColumn("rank", F.row_number().over(W.orderBy(*order)))


def context_edges(top: DataFrame, relations: DataFrame, out_most: int = 5, in_most: int = 3) -> DataFrame:
    """(entity, direction, relation, other, place): the first relations out of and into each of a few entities."""
    e = F.broadcast(top.select("name"))  # six names
    out = relations.join(e, relations["source_entity"] == e["name"]).select(F.col("name").alias("entity"), F.lit("out").alias("direction"), "relation", F.col("target_entity").alias("other"), "id")
    into = relations.join(e, relations["target_entity"] == e["name"]).select(F.col("name").alias("entity"), F.lit("in").alias("direction"), "relation", F.col("source_entity").alias("other"), "id")
    rows = out.unionByName(into).withColumn("place", F.row_number().over(W.partitionBy("entity", "direction").orderBy("id")))
    most = F.when(F.col("direction") == "out", out_most).otherwise(in_most)
    return rows.filter(F.col("place") <= most).select("entity", "direction", T.canonical_relation(F.col("relation")).alias("relation"), "other", "place")


def context_communities(top: DataFrame, communities: DataFrame, most: int = 3, siblings: int = 5) -> DataFrame:
    """(community_id, members, siblings): communities of the shown entities by how many are in them, and a few others of each."""
    shown = top.select(F.col("name").alias("entity"))
    met = communities.join(F.broadcast(shown), "entity").groupBy("community_id").agg(F.array_sort(F.collect_list("entity")).alias("members"))
    best = met.orderBy(F.size("members").desc(), "community_id").limit(most)
    rest = communities.join(F.broadcast(best.select("community_id")), "community_id", "left_semi").join(F.broadcast(shown), "entity", "left_anti")
    w = W.partitionBy("community_id").orderBy(F.xxhash64("entity"), "entity")
    few = rest.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= siblings).groupBy("community_id").agg(F.array_sort(F.collect_list("entity")).alias("siblings"))
    return best.join(few, "community_id", "left")


def catalysts(entities: DataFrame, relations: DataFrame, limit: int = 200) -> DataFrame:
    """(entity, type, mentions, questions, notes) of the most mentioned entities; questions are made from the graph alone."""
    best = entities.groupBy("name").agg(F.count("*").alias("mentions"), F.min("type").alias("type"), F.array_sort(F.collect_set("source_file")).alias("all_notes"))
    best = best.orderBy(F.col("mentions").desc(), "name").limit(limit)
    e = F.broadcast(best.select("name"))  # ``limit`` names
    a = relations.join(e, relations["source_entity"] == e["name"]).select("name", F.col("target_entity").alias("other"), "id")
    b = relations.filter("source_entity <> target_entity").join(e, relations["target_entity"] == e["name"]).select("name", F.col("source_entity").alias("other"), "id")
    ten = a.unionAll(b).withColumn("k", F.row_number().over(W.partitionBy("name").orderBy("id", "other"))).filter("k <= 10")
    related = ten.groupBy("name").agg(F.slice(F.array_sort(F.collect_set("other")), 1, 3).alias("related"))
    rows = best.join(related, "name", "left")
    n, t = F.col("name"), F.lower("type")
    say = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])
    # The texts of the questions.
    third = F.when(t == "concept", say("What are the key mechanisms behind ", n, "?")).when(t == "technique", say("How is ", n, " applied in practice?")).when(t == "theory", say("What evidence supports or challenges ", n, "?")).when(t == "person", say("What contributions did ", n, " make?")).otherwise(say("What are the implications of ", n, "?"))
    domains = F.array_sort(F.array_distinct(F.array_compact(F.transform("all_notes", lambda f: T.domain(f)))))
    count = F.size("all_notes")
    questions = F.array_compact(
        F.array(
            say("What is ", n, " and how does it work?"),
            F.when(F.size("related") > 0, say("How does ", n, " relate to ", F.array_join("related", ", "), "?")),
            third,
            F.when(F.size(domains) >= 2, say("How does ", n, " bridge ", F.array_join(F.slice(domains, 1, 3), " and "), "?")),
            F.when(count > 3, say("What are the most important aspects of ", n, " across ", count.cast("string"), " vault notes?")),
        )
    )
    return rows.select(n.alias("entity"), "type", "mentions", questions.alias("questions"), F.slice("all_notes", 1, 5).alias("notes"))


def catalyst_search(index: DataFrame, query: str, top: int = 5) -> DataFrame:
    found = token_search(index.select("entity", F.array_join("questions", " ").alias("q")), "entity", query, "entity", "q", limit=top)
    return found.join(index, "entity").orderBy("rank")


def code_hits(files: DataFrame, query: str, projects: str = "Projects", top: int = 10) -> DataFrame:
    """(project, path, score): code files that have the query's terms; generated and copied trees are left out."""
    terms = [w for w in re.findall(r"\w+", query.lower()) if len(w) > 2]
    parts = F.split("path", "/")
    code = files.filter(T.extension(F.col("path")).isin(*V.CODE_FILES) & ~F.exists(parts, lambda p: p.isin("worktrees", "node_modules", ".next")))
    found = matching_terms(code, terms, top)
    at = F.array_position(F.split("path", "/"), projects).cast("int")
    return found.withColumn("project", F.when(at > 0, F.get(F.split("path", "/"), at)).otherwise(F.get(F.split("path", "/"), F.lit(0))))


def bridged(semantic_hits: DataFrame, grep_hits: DataFrame) -> DataFrame:
    """Semantic hits, then the grep hits that they lack; ``origin`` tells which."""
    a = semantic_hits.select("path", "score", F.lit("semantic").alias("origin"))
    b = grep_hits.select("path", "score").join(semantic_hits.select("path"), "path", "left_anti").withColumn("origin", F.lit("grep"))
    return a.unionByName(b)


def verdict(n_notes: int, n_code: int) -> str:
    return {(True, True): "bridge", (True, False): "no implementation found", (False, True): "undocumented code", (False, False): "no match"}[(n_notes > 0, n_code > 0)]


def answer(files: DataFrame, question: str, model: TextModel, embedder: Embedder | None = None, top: int = 7) -> dict:
    """Retrieve, put the best into a bounded context, ask the model; sources are the first five paths."""
    found = search(files, question, embedder, top=top)
    entries = context(found.join(files.select("path", "content"), "path"), F.col("content")).orderBy("rank").collect()  # ``top`` rows, 12,000 characters
    text = "\n\n".join(r["entry"] for r in entries)
    return {"answer": model(f"{text}\n\nQuestion: {question}"), "sources": [r["path"] for r in entries[:5]]}


def with_rerank(found: DataFrame, files: DataFrame, query: str, score, top: int = 20) -> DataFrame:
    words = [w for w in query.lower().split() if len(w) > 2]
    rows = found.join(files.select("path", "content", "summary"), "path", "left").withColumn("snippet", T.snippet(F.col("content"), F.col("summary"), words))
    return reranked(rows, score(F.col("snippet")), top).drop("content", "summary")


def status(tables: dict[str, DataFrame | None]) -> dict[str, int | None]:
    return {k: None if t is None else t.count() for k, t in tables.items()}
