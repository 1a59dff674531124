"""Results as JSON and as lines of text."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def results_json(found: DataFrame, context: dict | None = None) -> str:
    """A search's results by rank, scores to four places, chunk fields only where there are any; with a context an object of both."""
    rows = found.orderBy("rank").collect()  # the results that are shown
    out = []
    for r in (r.asDict(recursive=True) for r in rows):
        one = {"score": round(r["score"], 4), "path": r["path"], "summary": r.get("summary") or ""}
        one |= {k: r[k] for k in ("chunk_heading", "chunk_lines") if r.get(k)}
        out.append(one)
    return json.dumps({"results": out, "graph_context": context} if context else out, indent=2, ensure_ascii=False)


def results_text(found: DataFrame, width: int = 100) -> list[str]:
    lines = []
    for r in (r.asDict() for r in found.orderBy("rank").collect()):
        lines.append(f"{r['score']:.4f}  {r['path']}")
        if r.get("chunk_heading"):
            lines.append(f"        § {r['chunk_heading']}")
        short = " ".join((r.get("summary") or "").split("\n")).strip()
        lines += [f"        {short if len(short) <= width else short[: width - 3] + '...'}", ""]
    return lines


def graph_json(nodes: DataFrame, links: DataFrame, notes: int, generated: str) -> DataFrame:
    """One row: an exported graph as JSON text; nodes by descending connections. Both tables are cut to the most connected nodes before."""
    node = F.struct((-F.col("connections")).alias("k"), F.col("name").alias("n"), F.struct("name", "type", "connections", "sources").alias("v"))
    a = nodes.agg(F.transform(F.array_sort(F.collect_list(node)), lambda x: x["v"]).alias("nodes"))
    b = links.agg(F.array_sort(F.collect_list(F.struct("source", "target", "relation"))).alias("links"))
    about = F.struct(F.size("nodes").alias("total_entities"), F.size("links").alias("total_relations"), F.lit(notes).alias("total_notes"), F.lit(generated).alias("generated"))
    return a.crossJoin(b).select(F.to_json(F.struct(about.alias("metadata"), "nodes", "links")).alias("json"))  # two single rows


def communities_json(communities: DataFrame, meta: DataFrame, folder: str) -> None:
    """A JSON line for each community: its entities by name and what is known of it. Written in parts, as communities may be many."""
    members = communities.groupBy("community_id").agg(F.array_sort(F.collect_list("entity")).alias("entities"))
    members.join(meta, "community_id").select("community_id", "entities", F.struct("size", "top_entities", "relation_types", "density").alias("meta"), "resolution", "modularity").write.mode("overwrite").json(folder)


def citations_text(rows: DataFrame, shown: tuple[str, ...] = ("hallucinated", "not_found", "timeout", "error", "redirect")) -> DataFrame:
    """(path, line): a line of text for each url of the shown statuses, in the order of files, statuses and lines; stays distributed."""
    place = F.array_position(F.array(*[F.lit(s) for s in shown]), F.col("status"))
    why = F.coalesce("reason", F.concat(F.lit("-> "), F.col("redirect_to")), "error_msg", F.lit(""))
    some = rows.filter(F.col("status").isin(*shown))
    text = F.concat(F.upper("status"), F.lit("  line "), F.col("line_number").cast("string"), F.lit("  "), F.col("url"), F.lit("  "), why)
    return some.orderBy("path", place, "line_number", "url").select("path", F.rtrim(text).alias("line"))


def communities_text(meta: DataFrame, most: int = 15) -> list[str]:
    """The largest communities with five of their entities each."""
    rows = meta.orderBy(F.col("size").desc(), "community_id").limit(most).collect()
    return [f"{r['community_id']:>5} {r['size']:>6} {r['density']:>8.4f}  {', '.join(r['top_entities'][:5])}" for r in rows]
