"""Pairs of entities with shared neighbours from different disciplines: an inverted join, bonuses, penalties, greedy dedup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import ship
from ..sources.tables import staged
from .fusion import diversity
from .graph import degrees, undirected


def neighbour_pairs(relations: DataFrame, min_jaccard: float = 0.15, min_shared: int = 3, min_degree: int = 6) -> DataFrame:
    """(entity_a, entity_b, shared, jaccard): pairs a < b of well connected entities that share enough neighbours.

    Two that share ``n`` neighbours share one outside the ``n - 1`` best connected of either. So candidates come from the rarer neighbours
    alone, which spares the hubs, and what they share is counted for candidates only.
    """
    edges = staged(undirected(relations, prune_leaves=False), "edges")
    deg = degrees(edges)
    high = deg.filter(F.col("degree") >= min_degree)
    sides = edges.join(high.select(F.col("node").alias("src"), "degree"), "src").select(F.col("src").alias("entity"), "dst", "degree")
    hub = deg.select(F.col("node").alias("dst"), F.col("degree").alias("hub"))
    place = F.row_number().over(W.partitionBy("entity").orderBy("hub", "dst"))
    # Sharing at least max(min_shared, ceil(min_jaccard * degree)); a margin keeps rounding from dropping a pair.
    least = F.greatest(F.lit(min_shared), F.ceil(F.col("degree") * min_jaccard - 1e-9))
    rare = sides.join(hub, "dst").withColumn("place", place).filter(F.col("place") <= F.col("degree") - least + 1).select("entity", "dst", "degree")
    a, b = (rare.select(F.col("entity").alias(f"entity_{k}"), "dst", F.col("degree").alias(f"d{k}")) for k in "ab")
    # Degrees too far apart rule a pair out at once.
    apart = (F.least("da", "db") >= min_jaccard * F.greatest("da", "db") - 1e-9) & (F.col("entity_a") < F.col("entity_b"))
    pairs = a.join(b, "dst").filter(apart).select("entity_a", "entity_b", "da", "db").distinct()
    x, y = (sides.select(F.col("entity").alias(f"entity_{k}"), "dst") for k in "ab")
    met = pairs.join(x, "entity_a").join(y, ["entity_b", "dst"]).groupBy("entity_a", "entity_b", "da", "db").agg(F.count("*").alias("shared")).filter(F.col("shared") >= min_shared)
    out = met.withColumn("jaccard", F.col("shared") / (F.col("da") + F.col("db") - F.col("shared")))
    return out.filter(F.col("jaccard") >= min_jaccard).select("entity_a", "entity_b", "shared", "jaccard")


def disciplines(relations: DataFrame) -> DataFrame:
    """(entity, disciplines): sorted distinct beginnings before ``--`` of the notes that name it."""
    a, b = F.lower(F.trim("source_entity")), F.lower(F.trim("target_entity"))
    d = T.domain(F.col("source_file"))
    rows = relations.filter((a != "") & (b != "") & (a != b)).select(F.explode(F.array(a, b)).alias("entity"), d.alias("d"))
    return rows.filter("d is not null").groupBy("entity").agg(F.array_sort(F.collect_set("d")).alias("disciplines"))


def coverage(relations: DataFrame, synthesis: DataFrame) -> DataFrame:
    """(entity, covered): how many synthesis notes name an entity of over four letters."""
    names = undirected(relations, prune_leaves=False).select(F.col("src").alias("entity")).distinct().filter(F.length("entity") > 4)
    notes = synthesis.select("path", F.lower("content").alias("content"))
    # A note that contains a name contains the name's first five letters: joined on these without the texts, then verified.
    last = F.length("content") - 5
    grams = F.get(F.transform(F.array(F.split("content", "")), lambda c: F.array_distinct(F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(c, i + 1, F.lit(5)), "")))), F.lit(0))
    signs = notes.filter(F.length("content") >= 5).select("path", F.explode(grams).alias("gram"))
    near = signs.join(names.withColumn("gram", F.left("entity", F.lit(5))), "gram").select("path", "entity").distinct()
    met = near.join(notes, "path").filter(F.contains("content", F.col("entity")))
    return met.groupBy("entity").agg(F.count_distinct("path").alias("covered"))


def pair_candidates(relations: DataFrame, covered: DataFrame, **limits) -> DataFrame:
    """Pairs with disciplines that differ, not both of them covered already."""
    pairs = neighbour_pairs(relations, **limits)
    d = disciplines(relations)
    c = covered.select("entity", "covered")
    for side in "ab":
        pairs = pairs.join(d.select(F.col("entity").alias(f"entity_{side}"), F.col("disciplines").alias(f"disciplines_{side}")), f"entity_{side}")
        pairs = pairs.join(c.select(F.col("entity").alias(f"entity_{side}"), F.col("covered").alias(f"covered_{side}")), f"entity_{side}", "left")
    kept = pairs.filter("disciplines_a <> disciplines_b and (covered_a is null or covered_b is null)")
    return kept.select("entity_a", "entity_b", F.slice("disciplines_a", 1, 3).alias("disciplines_a"), F.slice("disciplines_b", 1, 3).alias("disciplines_b"), "shared", F.round("jaccard", 3).alias("jaccard"), F.coalesce("covered_a", F.lit(0)).alias("covered_a"), F.coalesce("covered_b", F.lit(0)).alias("covered_b"))


def with_bonus(pairs: DataFrame, total_notes: int, c: float = 1.0) -> DataFrame:
    """Upper-confidence bonus for entities that few synthesis notes name."""
    if total_notes < 1:
        return pairs.withColumn("ucb_bonus", F.lit(0.0))
    one = lambda n: c * F.sqrt(F.ln(F.lit(float(total_notes))) / F.greatest(F.col(n), F.lit(1)))
    bonus = (one("covered_a") + one("covered_b")) / 2
    return pairs.withColumn("ucb_bonus", F.round(bonus, 3)).withColumn("jaccard", F.round(F.col("jaccard") * (1 + bonus), 3))


def penalized(pairs: DataFrame) -> DataFrame:
    """Half the score for pairs that share a discipline; spelling variants of one name go."""
    same = F.arrays_overlap("disciplines_a", "disciplines_b")
    out = pairs.withColumn("domain_penalized", same).withColumn("jaccard", F.when(same, F.round(F.col("jaccard") * 0.5, 3)).otherwise(F.col("jaccard")))
    return out.filter(T.normal_phrase(F.col("entity_a")) != T.normal_phrase(F.col("entity_b")))


def greedy(pairs: DataFrame, most: float = 0.4) -> DataFrame:
    """In order of score: pairs whose names share at most ``most`` of their words with any pair accepted before.

    Sequential by nature; names that share no word can't exclude each other, so what shares words goes together: pairs are
    sent by connected words to one task each.
    """
    from .graph import components

    ship(pairs.sparkSession)
    rows = staged(pairs.withColumn("key", F.concat_ws("\u0001", "entity_a", "entity_b")), "pairs")
    words = rows.select(F.concat(F.lit("p:"), "key").alias("src"), F.explode(F.array_union(T.long_words(F.col("entity_a")), T.long_words(F.col("entity_b")))).alias("w"))
    comp = components(words.select("src", F.concat(F.lit("w:"), "w").alias("dst"))).filter(F.col("node").startswith("p:"))
    grouped = rows.join(comp.select(F.expr("substring(node, 3)").alias("key"), "component"), "key", "left").withColumn("component", F.coalesce("component", "key"))

    def run(table):
        import pyarrow as pa

        t = table.sort_by([("jaccard", "descending"), ("entity_a", "ascending"), ("entity_b", "ascending")])
        taken: list[set[str]] = []
        keep = []
        for a, b in zip(t["entity_a"].to_pylist(), t["entity_b"].to_pylist(), strict=True):
            wa, wb = ({w for w in x.split() if len(w) > 2} for x in (a, b))
            ok = not any(x and s and len(x & s) / min(len(x), len(s)) > most for s in taken for x in (wa, wb))
            if ok:
                taken.append(wa | wb)
            keep.append(ok)
        return t.filter(pa.array(keep, pa.bool_())).select(["key"])

    kept = grouped.select("component", "key", "entity_a", "entity_b", "jaccard").groupBy("component").applyInArrow(run, "key string")
    return rows.join(kept, "key", "left_semi").drop("key")


def suggestions(relations: DataFrame, synthesis: DataFrame, top: int = 10, ucb: bool = False, ucb_c: float = 1.0, **limits) -> DataFrame:
    """The best pairs: candidates, bonus, penalties, greedy dedup, diversity of disciplines, no existing title."""
    covered = coverage(relations, synthesis)
    pairs = pair_candidates(relations, covered, **limits)
    if ucb:
        pairs = with_bonus(pairs, synthesis.count(), ucb_c)
    kept = greedy(penalized(pairs))
    order = [F.col("jaccard").desc(), "entity_a", "entity_b"]
    rows = kept.withColumn("rank", F.row_number().over(W.orderBy(*order))).withColumn("key", F.concat_ws("\u0001", "entity_a", "entity_b")).withColumn("domains", F.array_union("disciplines_a", "disciplines_b"))
    spread = diversity(rows, "key", "domains", "jaccard")
    titles = synthesis.select(F.filter(F.split(F.regexp_replace(T.stem(F.col("path")), "^synthesis--", ""), "-"), lambda w: F.length(w) > 2).alias("title")).filter("size(title) > 0").distinct()
    words = spread.select("key", T.long_words(F.lower(F.concat_ws(" ", "entity_a", "entity_b"))).alias("words"))
    # An overlap needs a shared word, so pairs meet titles on words.
    met = words.select("key", "words", F.explode("words").alias("w")).join(titles.select("title", F.explode(F.array_distinct("title")).alias("w")), "w").select("key", "words", "title").distinct()
    old = met.filter(T.overlap(F.col("words"), F.array_distinct("title")) > 0.8).select("key").distinct()
    return spread.join(old, "key", "left_anti").orderBy(*order).limit(top).drop("key", "domains", "rank")
