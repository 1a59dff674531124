"""What text models add to an index: summaries, hypothetical passages, entities and relations of notes, parsed questions.

Models are passed in; each step has a default for their failure.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import graph
from .fulltext import numbered
from .ingest import extracted, inserted, upserted
from .models import TextModel, generated

SUMMARISED, EXTRACTED, LEAST_NOTE = 4000, 3000, 100
FAILED = "(summary failed: {error})"


def _filled(template: str, **parts: Column) -> Column:
    """A prompt from a template with ``{name}`` for columns."""
    out, at = [], 0
    for m in re.finditer(r"\{(\w+)\}", template):
        out += [F.lit(template[at : m.start()]), parts[m[1]]]
        at = m.end()
    return F.concat(*out, F.lit(template[at:]))


def summarised(files: DataFrame, model: TextModel, prompt: str = "Summarise the file {path} in two or three sentences:\n{text}") -> DataFrame:
    """``summary`` of each row's first 4000 characters; a failing model leaves a note of its error."""
    asked = files.drop("summary").withColumn("_prompt", _filled(prompt, path=F.col("path"), text=F.left(F.coalesce("content", F.lit("")), F.lit(SUMMARISED))))
    return generated(asked, "_prompt", "summary", model, FAILED).withColumn("summary", F.trim("summary")).drop("_prompt")


def pending_filled(files: DataFrame, model: TextModel, pending: str = "(pending)") -> DataFrame:
    """All files; those whose summary is pending get one."""
    some = summarised(files.filter(F.col("summary") == pending), model).select(*files.columns)
    return upserted(files, some, "path")


def hypothetical(query: str, model: TextModel | None, intent: str | None = None) -> str:
    """A passage that would answer the query, to be embedded in its place; the query itself if the model fails or says nothing."""
    if model is None:
        return query
    about = f" (field: {intent})" if intent else ""
    try:
        return model(f"Write two or three technical sentences that answer this: {query}{about}").strip() or query
    except Exception:  # noqa: BLE001  the model may fail in any way; the query remains
        return query


# --- entities and relations ---


def new_notes(notes: DataFrame, entities: DataFrame | None) -> DataFrame:
    """Notes of a hundred characters or more whose file name no entity has as its source yet."""
    rows = notes.filter(F.length("content") >= LEAST_NOTE).withColumn("source_file", T.base_name(F.col("path")))
    return rows if entities is None else rows.join(entities.select("source_file").distinct(), "source_file", "left_anti")


def extraction_rows(answers: DataFrame, column: str = "answer") -> tuple[DataFrame, DataFrame]:
    """Entities (name, type, source_file) and relations (source_entity, relation, target_entity, source_file) of models' answers.

    Names become normal names. An entity may be a plain string, which is a concept; names of one letter go. Relations need two different
    ends; one that is no object is left out. Answers without JSON give nothing. Repeated rows count once.
    """
    rows = extracted(answers, column).select("source_file", "parsed")
    raw = rows.select("source_file", F.explode("parsed.entities").alias("e"))
    given = F.from_json("e", "name string, type string")
    name = T.normal_name(F.coalesce(given["name"], F.when(~F.startswith("e", F.lit("{")), F.trim("e", F.lit('"'))), F.lit("")))
    kind = F.lower(F.trim(F.coalesce(given["type"], F.lit("concept"))))
    entities = raw.select(name.alias("name"), kind.alias("type"), "source_file").filter(F.length("name") > 1)
    entities = entities.groupBy("name", "source_file").agg(F.min("type").alias("type")).select("name", "type", "source_file")
    each = rows.select("source_file", F.explode("parsed.relations").alias("r")).select("source_file", F.from_json("r", "source string, relation string, target string").alias("r"))
    ends = each.select(
        T.normal_name(F.coalesce("r.source", F.lit(""))).alias("source_entity"),
        F.lower(F.trim(F.coalesce("r.relation", F.lit("relates_to")))).alias("relation"),
        T.normal_name(F.coalesce("r.target", F.lit(""))).alias("target_entity"),
        "source_file",
    )
    return entities, ends.filter("source_entity <> '' and target_entity <> '' and source_entity <> target_entity").distinct()


def extract(notes: DataFrame, model: TextModel, entities: DataFrame | None = None, prompt: str = "List entities and relations of the note {path} as JSON (entities: name, type; relations: source, relation, target):\n{text}") -> tuple[DataFrame, DataFrame]:
    """Entities and relations of the notes that have none yet, from their first 3000 characters."""
    rows = new_notes(notes, entities)
    asked = rows.withColumn("_prompt", _filled(prompt, path=F.col("source_file"), text=F.left("content", F.lit(EXTRACTED))))
    return extraction_rows(generated(asked, "_prompt", "answer", model).select("source_file", "answer"))


def added(old: DataFrame, new: DataFrame, *unique: str) -> DataFrame:
    """INSERT OR IGNORE of new rows without ids: they get ids after the largest, in the order of their keys."""
    top = old.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    fresh = inserted(new.withColumn("id", F.xxhash64(*unique)), *unique).join(old.select(*unique).distinct(), list(unique), "left_anti")
    rows = numbered(fresh.drop("id"), [F.col(c) for c in unique], "id").withColumn("id", F.col("id") + F.lit(top))
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in old.schema if f.name not in rows.columns]
    return old.unionByName(rows.select("*", *missing).select(*old.columns))


# --- questions ---


def parsed_question(question: str, model: TextModel | None = None) -> dict:
    """Entity, relation filter and hops of a question, by the model if it answers with JSON, else by keywords."""
    if model is not None:
        try:
            answer = re.sub(r"^```\w*\n?|\n?```$", "", model(f"Give entity, relation_filter, max_hops and intent of this question as JSON: {question}").strip())
            found = json.loads(answer)
            return {"entity": found.get("entity", ""), "relation_filter": found.get("relation_filter"), "max_hops": int(found.get("max_hops", 1)), "intent": found.get("intent", question), "raw_question": question}
        except Exception:  # noqa: BLE001, S110  the model may fail in any way; keywords remain
            pass
    return graph.parse_question(question)


def neighbourhood_details(relations: DataFrame, entities: DataFrame, query: str, hops: int = 1) -> DataFrame:
    """(node, depth, types, files, outgoing, incoming) around all entities whose name contains the query.

    Types are sorted, files are the first five by name; edges are structs (relation, other, source_file) in the order of their ids.
    ``%`` and ``_`` in the query match any signs and any one sign.
    """
    like = F.lower("name").like(f"%{query.lower()}%")
    near = graph.neighborhood(relations, entities.filter(like).select(F.col("name").alias("node")), hops)
    about = entities.groupBy(F.col("name").alias("node")).agg(F.array_sort(F.collect_set("type")).alias("types"), F.slice(F.array_sort(F.collect_set("source_file")), 1, 5).alias("files"))

    def edges(own: str, other: str, name: str) -> DataFrame:
        at = F.struct("id", "relation", F.col(other).alias("other"), "source_file")
        rows = relations.join(near.select("node"), F.col(own) == F.col("node"), "left_semi")
        return rows.groupBy(F.col(own).alias("node")).agg(F.transform(F.array_sort(F.collect_list(at)), lambda e: e.dropFields("id")).alias(name))

    out = near.join(about, "node", "left").join(edges("source_entity", "target_entity", "outgoing"), "node", "left").join(edges("target_entity", "source_entity", "incoming"), "node", "left")
    return out.select("node", "depth", *[F.coalesce(c, F.array().cast(out.schema[c].dataType)).alias(c) for c in ("types", "files", "outgoing", "incoming")])
