"""The whole search: expansion, retrieval, community boost, reranking, confidence, graph context and catalysts in one call."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import staged
from . import search as S
from .extraction import hypothetical
from .models import Embedder, TextModel
from .vector import low_confidence


@dataclass
class Found:
    """What a search gives: results, whether to trust them, and what the graph knows of the query; None where a table is missing."""

    results: DataFrame
    confidence: DataFrame
    edges: DataFrame | None = None
    communities: DataFrame | None = None
    catalysts: DataFrame | None = None

    def context(self) -> dict | None:
        """The graph's part as plain values: a few rows."""
        if self.edges is None:
            return None
        edges = [r.asDict() for r in self.edges.orderBy("entity", "direction", "place").collect()]
        if not edges:
            return None
        groups = [] if self.communities is None else [r.asDict() for r in self.communities.collect()]
        return {"relations": edges, "communities": groups}


def full_search(
    files: DataFrame,
    query: str,
    embedder: Embedder | None = None,
    chunks: DataFrame | None = None,
    entities: DataFrame | None = None,
    relations: DataFrame | None = None,
    communities: DataFrame | None = None,
    catalysts: DataFrame | None = None,
    mode: str = "hybrid",
    top: int = 5,
    path_prefix: str | None = None,
    model: TextModel | None = None,
    intent: str | None = None,
    scorer=None,
    rerank_top: int = 20,
    graph: bool = True,
) -> Found:
    """Search with all that is at hand.

    ``model`` writes the passage that is embedded in the query's place; ``scorer`` (a function of the snippet column) reranks the best
    ``rerank_top``. Communities lift the results of a plain hybrid search, after the cut to ``top`` unless reranking follows. Typed queries
    are ranked by their parts alone. Catalysts are looked up where there is no embedder.
    """
    wide = max(top, rerank_top) if scorer else top
    typed = any(S.typed_parts(query)[k] for k in ("lex", "vec", "hyde"))
    found = S.search(files, query, embedder, chunks, mode, wide, path_prefix, hyde=(lambda q: hypothetical(q, model, intent)) if model else None)
    if mode == "hybrid" and not typed and entities is not None and communities is not None:
        found = S.community_boost(found, query, entities, communities)
    if scorer:
        found = S.with_rerank(found, files, query, scorer, rerank_top).select("path", F.coalesce("blend", "score").alias("score"), F.col("final_rank").alias("rank")).filter(F.col("rank") <= top)
    found = staged(found.select("path", "score", "rank"), "results")
    results = found.join(files.select("path", "summary"), "path", "left") if "summary" in files.columns else found
    out = Found(results, low_confidence(found, mode == "semantic"))
    if graph and entities is not None and relations is not None:
        shown = [r["path"] for r in found.orderBy("rank").limit(3).collect()]
        names = staged(S.context_entities(query, shown, entities, relations), "context")
        out.edges = S.context_edges(names, relations)
        out.communities = S.context_communities(names, communities) if communities is not None else None
    if catalysts is not None and embedder is None:
        out.catalysts = S.catalyst_search(catalysts, query, 3)
    return out


def second_pass_only(first: DataFrame, second: DataFrame) -> DataFrame:
    """Results of an iterative search that only its second pass has found."""
    return second.join(first.select("path"), "path", "left_anti")


def cross_encoder(logits) -> Column:
    """A scorer from a function of (query, snippet) pairs to logits."""
    from .models import sigmoid

    return lambda snippet: sigmoid(logits(snippet))
