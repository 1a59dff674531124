"""Graph operators: undirected paths, directed typed chains, neighbourhoods, lookups, statistics, export.

Searches are level-synchronous: one equi-join of the frontier with the edges a level, each level a written table. The order in
which a queue would visit is kept as a sort key, so that the same path is found.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab as V
from ..sources.tables import staged
from . import compact


def undirected(relations: DataFrame, prune_leaves: bool = True) -> DataFrame:
    """Distinct symmetric edges (src, dst) of trimmed lower-case names without self-loops; leaves go in one pass."""
    a, b = F.lower(F.trim("source_entity")), F.lower(F.trim("target_entity"))
    one = relations.select(a.alias("src"), b.alias("dst")).filter((F.col("src") != "") & (F.col("dst") != "") & (F.col("src") != F.col("dst")))
    # Each pair is made once and turned round afterwards: relations are read once, half the rows are shuffled.
    one = one.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    edges = one.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e")).select("e.*")
    if not prune_leaves:
        return edges
    inner = degrees(edges).filter("degree >= 2").select(F.col("node").alias("src"))
    return edges.join(inner, "src", "left_semi").join(inner.withColumnRenamed("src", "dst"), "dst", "left_semi").select("src", "dst")


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))


def resolved(nodes: DataFrame, name: str) -> str | None:
    """The node itself, else the shortest that contains the name (then by name)."""
    low = name.lower().strip()
    hit = nodes.filter(F.contains("node", F.lit(low))).orderBy((F.col("node") != low).cast("int"), F.length("node"), "node").limit(1).collect()
    return hit[0]["node"] if hit else None


#: The place of a node in the order of visits: (-degree, name) of each node on the way to it, compared from the first on.
_PLACE = "pos array<struct<d:bigint,n:string>>"


def _place() -> Column:
    return F.concat("pos", F.array(F.struct((-F.col("degree")).cast("long").alias("d"), F.col("dst").alias("n")))).alias("pos")


def _between(edges: DataFrame, a: str, b: str, most: int) -> DataFrame | None:
    """(src, dst, degree) of the part of a graph that holds every path from a to b of up to one edge more than the shortest; None if that has over ``most``.

    Searches from both ends, the smaller front first. If they meet after i and j levels, a node of such a path is at most i edges from
    a or j from b. Degrees of ``dst`` are those of the whole graph.
    """
    spark = edges.sparkSession
    fronts = [spark.createDataFrame([(x,)], "node string") for x in (a, b)]
    balls, sizes = list(fronts), [1, 1]
    for _ in range(most):
        k = 0 if sizes[0] <= sizes[1] else 1
        new = edges.join(fronts[k].withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        fronts[k] = staged(new.join(balls[k], "node", "left_anti"), "front")
        balls[k] = balls[k].union(fronts[k])
        sizes[k] = fronts[k].count()
        if not sizes[k]:
            return None
        if not fronts[0].join(fronts[1], "node", "left_semi").isEmpty():
            near = staged(balls[0].union(balls[1]).distinct(), "near")
            of = edges.join(near.withColumnRenamed("node", "src"), "src", "left_semi")
            sub = staged(of.join(near.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst"), "between")
            return staged(sub.join(degrees(of).withColumnRenamed("node", "dst"), "dst").select("src", "dst", "degree"), "edges")
    return None


def find_path(edges: DataFrame, start: str, end: str, max_depth: int = 8) -> list[str]:
    """A shortest path of at most ``max_depth`` edges; neighbours are visited by descending degree, then name."""
    edges = staged(edges, "edges")
    nodes = edges.select(F.col("src").alias("node")).distinct()
    a, b = resolved(nodes, start), resolved(nodes, end)
    if a is None or b is None:
        return []
    if a == b:
        return [a]
    edges = _between(edges, a, b, max_depth)
    if edges is None:
        return []
    spark = edges.sparkSession
    front = spark.createDataFrame([(a, [], [a])], f"node string, {_PLACE}, path array<string>")
    seen = front.select("node")
    for _ in range(max_depth):
        step = front.join(edges, front["node"] == edges["src"]).select("pos", "path", "dst", "degree")
        step = step.join(seen, step["dst"] == seen["node"], "left_anti")
        step = step.select("dst", "path", _place())
        level = staged(step.groupBy("dst").agg(F.min_by("path", "pos").alias("path"), F.min("pos").alias("pos")), "level")
        goal = level.filter(F.col("dst") == b).select("path").collect()
        if goal:
            return [*goal[0]["path"], b]
        front = staged(level.select(F.col("dst").alias("node"), "pos", F.concat("path", F.array("dst")).alias("path")), "front")
        if front.isEmpty():
            return []
        seen = seen.union(front.select("node"))
    return []


def find_all_paths(edges: DataFrame, start: str, end: str, max_depth: int = 6, max_paths: int = 3) -> list[list[str]]:
    """Up to ``max_paths`` paths: every shortest way to each neighbour of the end, then the end; at most one edge longer than the best.

    Of the ways to a node the first ``max_paths`` are carried on, which all of the result begin with.
    """
    edges = staged(edges, "edges")
    nodes = edges.select(F.col("src").alias("node")).distinct()
    a, b = resolved(nodes, start), resolved(nodes, end)
    if a is None or b is None:
        return []
    if a == b:
        return [[a]]
    edges = _between(edges, a, b, max_depth)
    if edges is None:
        return []
    spark = edges.sparkSession
    front = spark.createDataFrame([(a, [], [a])], f"node string, {_PLACE}, path array<string>")
    seen = front.select("node")
    out: list[list[str]] = []
    for depth in range(1, max_depth + 1):
        step = front.join(edges, front["node"] == edges["src"]).select("pos", "path", "dst", "degree")
        ends = step.filter(F.col("dst") == b).orderBy("pos").limit(max_paths - len(out)).select("path").collect()
        if out and depth > len(out[0]):
            break
        out += [[*r["path"], b] for r in ends]
        if len(out) >= max_paths:
            break
        step = step.filter(F.col("dst") != b).join(seen, step["dst"] == seen["node"], "left_anti").select("dst", "path", _place())
        step = step.withColumn("k", F.row_number().over(W.partitionBy("dst").orderBy("pos"))).filter(F.col("k") <= max_paths)
        front = staged(step.select(F.col("dst").alias("node"), "pos", F.concat("path", F.array("dst")).alias("path")), "front")
        if front.isEmpty():
            break
        seen = seen.union(front.select("node").distinct())
    return out[:max_paths]


def neighborhood(relations: DataFrame, starts: DataFrame, hops: int = 1, relation: str | None = None) -> DataFrame:
    """(node, depth): what lies within ``hops`` of any start, in either direction; with ``relation`` only over such edges."""
    rel = relations.filter(F.col("relation") == relation) if relation else relations
    one = rel.select(F.col("source_entity").alias("src"), F.col("target_entity").alias("dst"))
    edges = staged(one.union(one.select("dst", "src")).distinct(), "edges")
    seen = staged(starts.select("node").distinct().withColumn("depth", F.lit(0)), "seen")
    front = seen.select("node")
    for depth in range(1, hops + 1):
        new = front.join(edges, front["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti")
        front = staged(new, "front")
        if front.isEmpty():
            break
        seen = seen.union(front.withColumn("depth", F.lit(depth)))
    return seen


def directed(relations: DataFrame) -> DataFrame:
    """(id, src, relation, dst, source): typed edges in the path search's spelling; parallel ones stay."""
    return relations.select("id", F.lower(F.trim("source_entity")).alias("src"), T.causal_relation(F.col("relation")).alias("relation"), F.lower(F.trim("target_entity")).alias("dst"), F.col("source_file").alias("source"))


def fuzzy_matches(edges: DataFrame, query: str) -> DataFrame:
    """(node, tier, shared, n): names that match, best first by tier (exact, containing the query, two shared words), then words, edges, name."""
    low = query.lower().strip()
    ends = edges.select(F.col("src").alias("node")).unionAll(edges.select("dst")).groupBy("node").agg(F.count("*").alias("n"))
    words = F.array(*[F.lit(w) for w in low.split()]) if low.split() else F.array().cast("array<string>")
    same = F.size(F.array_intersect(words, F.split("node", r"\s+")))
    tier = F.when(F.col("node") == low, 0).when(F.contains("node", F.lit(low)), 1).when(same >= 2, 2)
    return ends.select("node", tier.alias("tier"), F.when(tier == 2, same).otherwise(0).alias("shared"), "n").filter("tier is not null")


def fuzzy_node(edges: DataFrame, query: str) -> str | None:
    """Exact name, else the best connected that contains it, else the one with most shared words, two at least; ties by name."""
    hit = fuzzy_matches(edges, query).orderBy("tier", F.col("shared").desc(), F.col("n").desc(), "node").limit(1).collect()
    return hit[0]["node"] if hit else None


def causal_chain(relations: DataFrame, start: str, end: str, max_depth: int = 6, prefer_causal: bool = True, allow_reverse: bool = True) -> list[dict]:
    """Steps (src, relation, dst, source) of a shortest directed chain; causal edges first, then by id.

    The end is tested before the visited set, so equal ends find a cycle. Only if nothing is found forwards, a search backwards is
    made; its relations carry an arrow.
    """
    edges = staged(directed(relations), "edges")
    a, b = fuzzy_node(edges, start), fuzzy_node(edges, end)
    if a is None or b is None:
        return []
    found = _chain(edges, a, b, max_depth, prefer_causal)
    if not found and allow_reverse:
        back = edges.select("id", F.col("dst").alias("src"), F.concat(F.lit("← "), "relation").alias("relation"), F.col("src").alias("dst"), "source")
        found = _chain(back, a, b, max_depth, prefer_causal)
    return found


def _chain(edges: DataFrame, a: str, b: str, max_depth: int, prefer: bool) -> list[dict]:
    causal = F.regexp_replace("relation", "^← ", "").isin(*V.CAUSAL_RELATIONS)
    edges = edges.withColumn("late", F.when(causal, 0).otherwise(1) if prefer else F.lit(0))
    step_type = "array<struct<src:string,relation:string,dst:string,source:string>>"
    spark = edges.sparkSession
    place = "array<struct<late:int,id:bigint>>"
    front = spark.createDataFrame([(a, [], [])], f"node string, pos {place}, path {step_type}")
    seen = front.select("node")
    for _ in range(max_depth):
        at = F.concat("pos", F.array(F.struct("late", F.col("id").cast("long").alias("id")))).alias("pos")
        step = front.join(edges, front["node"] == edges["src"]).select("dst", at, F.concat("path", F.array(F.struct("src", "relation", "dst", "source"))).alias("path"))
        level = staged(step.groupBy("dst").agg(F.min_by("path", "pos").alias("path"), F.min("pos").alias("pos")), "level")
        goal = level.filter(F.col("dst") == b).select("path").collect()
        if goal:
            return [s.asDict() for s in goal[0]["path"]]
        front = staged(level.join(seen, level["dst"] == seen["node"], "left_anti").select(F.col("dst").alias("node"), "pos", "path"), "front")
        if front.isEmpty():
            return []
        seen = seen.union(front.select("node"))
    return []


def chain_summary(chain: list[dict]) -> dict:
    causal = sum(s["relation"].removeprefix("← ") in V.CAUSAL_RELATIONS for s in chain)
    return {"steps": len(chain), "causal": causal, "structural": len(chain) - causal}


def implementations(relations: DataFrame) -> DataFrame:
    """(src, relation, dst): what implements or applies something."""
    return directed(relations).filter(F.col("relation").isin(*V.IMPLEMENTING)).select("src", "relation", "dst")


def lookup(entities: DataFrame, query: str, most: int = 8) -> DataFrame:
    """(name, tier, rank): exact normal name, then containing it, then containing one of its first three long words."""
    import re

    low = re.sub(r"\s+", " ", query.lower().replace("_", " ")).strip()
    for _ in range(2):
        low = re.sub(r"([a-z0-9]{2})-([a-z]{3})", r"\1 \2", low)
    words = [w for w in low.split() if len(w) > 3][:3]
    tier = F.when(F.col("name") == low, 0).when(F.contains("name", F.lit(low)), 1)
    for i, w in enumerate(words):
        tier = tier.when(F.contains("name", F.lit(w)), 2 + i)
    found = entities.select("name").distinct().withColumn("tier", tier).filter("tier is not null")
    best = found.orderBy("tier", F.length("name"), "name").limit(most)
    return best.withColumn("rank", F.row_number().over(W.orderBy("tier", F.length("name"), "name")))


def parse_question(question: str) -> dict:
    """Keyword fallback of the question parser: long words that are no question words."""
    import re

    words = [w for w in re.findall(r"[a-zA-Z]+", question.lower()) if len(w) > 4 and w not in V.QUESTION_WORDS]
    return {"entity": " ".join(words[:3]) or question[:40], "relation_filter": None, "max_hops": 1, "intent": f"Find connections for: {question}", "raw_question": question}


def ask(relations: DataFrame, entities: DataFrame, question: str | dict) -> DataFrame:
    """(direction, entity, relation, other) around the best entity of a question."""
    q = parse_question(question) if isinstance(question, str) else question
    best = lookup(entities, q["entity"], 1).collect()
    rel = relations.filter(F.col("relation") == q["relation_filter"]) if q["relation_filter"] else relations
    if not best:
        return rel.select(F.lit("out").alias("direction"), F.col("source_entity").alias("entity"), "relation", F.col("target_entity").alias("other")).limit(0)
    spark = relations.sparkSession
    near = neighborhood(relations, spark.createDataFrame([(best[0]["name"],)], "node string"), max(0, q["max_hops"] - 1), q["relation_filter"]).select("node")
    out = rel.join(near, rel["source_entity"] == near["node"]).select(F.lit("out").alias("direction"), F.col("source_entity").alias("entity"), "relation", F.col("target_entity").alias("other"))
    into = rel.join(near, rel["target_entity"] == near["node"]).select(F.lit("in").alias("direction"), F.col("target_entity").alias("entity"), "relation", F.col("source_entity").alias("other"))
    return out.unionByName(into).distinct()


def connection_counts(relations: DataFrame, loops_once: bool = False) -> DataFrame:
    """(name, connections): ends of relations; a self-loop counts twice, or once with ``loops_once``."""
    a = relations.select(F.col("source_entity").alias("name"))
    b = relations.filter("source_entity <> target_entity") if loops_once else relations
    return a.unionAll(b.select("target_entity")).groupBy("name").agg(F.count("*").alias("connections"))


def counts(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def primary_types(entities: DataFrame) -> DataFrame:
    """(name, type, sources): the most frequent canonical type (ties by name) and up to five sources."""
    each = entities.groupBy("name", T.canonical_type(F.col("type")).alias("type")).agg(F.count("*").alias("n"))
    best = each.groupBy("name").agg(F.min(F.struct((-F.col("n")).alias("k"), "type")).alias("t"))
    files = entities.groupBy("name").agg(F.slice(F.array_sort(F.collect_set("source_file")), 1, 5).alias("sources"))
    return best.select("name", F.col("t.type").alias("type")).join(files, "name")


def export_nodes(relations: DataFrame, entities: DataFrame, top: int = 300, least: int = 2) -> DataFrame:
    best = connection_counts(relations).filter(F.col("connections") >= least).orderBy(F.col("connections").desc(), "name").limit(top)
    return best.join(primary_types(entities), "name", "left").select("name", "connections", F.coalesce("type", F.lit(V.TYPE_DEFAULT)).alias("type"), "sources")


def export_links(relations: DataFrame, top: int = 300, least: int = 2) -> DataFrame:
    """The first relation of each pair of exported nodes, renamed to the canonical set."""
    best = connection_counts(relations).filter(F.col("connections") >= least).orderBy(F.col("connections").desc(), "name").limit(top).select("name")
    both = relations.join(F.broadcast(best.withColumnRenamed("name", "source_entity")), "source_entity", "left_semi").join(F.broadcast(best.withColumnRenamed("name", "target_entity")), "target_entity", "left_semi")  # at most ``top`` names
    first = both.groupBy("source_entity", "target_entity").agg(F.min_by("relation", "id").alias("relation"))
    return first.select(F.col("source_entity").alias("source"), F.col("target_entity").alias("target"), T.canonical_relation(F.col("relation")).alias("relation"))


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, component): the least name that is reachable, by contraction towards least neighbours."""
    work = staged(edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).filter("a < b").distinct(), "edges")
    label: DataFrame | None = None
    for _ in range(most):
        if work.isEmpty():
            break
        both = work.union(work.select("b", "a"))
        up = staged(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("up")), "up")
        for _ in range(2):
            up = up.join(up.select(F.col("node").alias("up"), F.col("up").alias("over")), "up").select("node", F.col("over").alias("up"))
        up = staged(up, "up")
        if label is None:
            label = up.select("node", F.col("up").alias("component"))
        else:
            step = up.select(F.col("node").alias("component"), F.col("up").alias("next"))
            label = staged(label.join(step, "component", "left").select("node", F.coalesce("next", "component").alias("component")), "labels")
        x, y = up.select(F.col("node").alias("a"), F.col("up").alias("x")), up.select(F.col("node").alias("b"), F.col("up").alias("y"))
        work = staged(work.join(x, "a").join(y, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a < b").distinct(), "edges")
    return label if label is not None else work.select(F.col("a").alias("node"), F.col("b").alias("component"))


def distances(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, node, distance) of all nodes that the sources reach."""
    edges = staged(edges.select("src", "dst"), "edges")
    seen = staged(sources.select(F.col("node").alias("source"), "node").distinct().withColumn("distance", F.lit(0)), "seen")
    front = seen.select("source", "node")
    d = 0
    while not front.isEmpty():
        d += 1
        step = front.join(edges, front["node"] == edges["src"]).select("source", F.col("dst").alias("node")).distinct()
        front = staged(step.join(seen, ["source", "node"], "left_anti"), "front")
        seen = seen.union(front.withColumn("distance", F.lit(d)))
    return seen


def _compact(edges: DataFrame) -> tuple[compact.Compact, DataFrame]:
    return compact.compact(edges.filter("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b")))


def pairs_by_distance(edges: DataFrame, sources: DataFrame) -> list[tuple[int, int]]:
    """(distance, pairs of a source and a node that far apart), from 1 on, over symmetric edges."""
    g, names = _compact(edges)
    ids = [r["id"] for r in names.join(sources.select("node").distinct(), "node", "left_semi").select("id").collect()]  # some numbers a node
    return compact.pairs_by_distance(edges.sparkSession, g, np.array(ids, np.int64))


def path_statistics(edges: DataFrame, sample: int | None = None, whole_up_to: int = 0) -> DataFrame:
    """One row: mean and largest distance in the largest component (of equal ones that of the least name), from all its nodes.

    If a ``sample`` is asked for, from so many of them, fixed by their hashes, in a component of over ``whole_up_to`` nodes.
    """
    g, names = _compact(edges)
    comp = compact.components(g)
    big = np.argmax(np.bincount(comp)) if g.n else 0
    ids = np.flatnonzero(comp == big)
    if sample is not None and len(ids) > whole_up_to:
        rows = compact.looked_up(names, component=comp).filter(F.col("component") == int(big))
        ids = np.array([r["id"] for r in rows.orderBy(F.xxhash64("node"), "node").limit(sample).collect()])
    found = compact.pairs_by_distance(edges.sparkSession, g, ids)
    pairs = sum(n for _, n in found)
    mean = sum(d * n for d, n in found) / pairs if pairs else None
    row = (mean, found[-1][0] if found else None, pairs)
    return edges.sparkSession.createDataFrame([row], "mean_distance double, diameter long, pairs long")


def word_match(name: Column, word: str) -> Column:
    return F.array_contains(F.split(name, r"\s+"), word) | name.startswith(word) | name.endswith(word)
