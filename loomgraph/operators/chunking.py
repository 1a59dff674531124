"""Chunks of texts: fixed windows in SQL, headed sections of notes by a fold in Arrow batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import extension
from ..session import ship

MOST, SHARED, LEAST, WHOLE = 2000, 300, 200, 8000


def code_chunks(files: DataFrame) -> DataFrame:
    """(path, chunk_index, content, start_line, end_line): windows of 2000 characters, 300 shared with the one before."""
    n = F.length("content")
    count = F.when(n <= MOST, F.lit(1)).otherwise(F.ceil((n - SHARED) / (MOST - SHARED))).cast("int")
    rows = files.filter(n > 0).select("path", "content", F.explode(F.sequence(F.lit(0), count - 1)).alias("chunk_index"))
    at = F.col("chunk_index") * (MOST - SHARED)
    lines = lambda s: F.length(s) - F.length(F.replace(s, F.lit("\n"), F.lit("")))
    rows = rows.withColumn("piece", F.substring("content", at + 1, F.lit(MOST))).withColumn("start_line", lines(F.left("content", at)) + 1)
    return rows.select("path", "chunk_index", F.col("piece").alias("content"), "start_line", (F.col("start_line") + lines(F.col("piece"))).alias("end_line"))


def sections(text: str) -> list[dict]:
    """Sections at ``## ``; short ones join the next, a short tail joins the one before, long ones are cut with overlap."""
    lines = text.split("\n")
    cuts = [0, *[i for i, x in enumerate(lines) if i and x.startswith("## ")], len(lines)]
    parts = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        body = "\n".join(lines[a:b])
        if body.strip():
            head = lines[a].lstrip("# ").strip() if lines[a].startswith("## ") else None
            parts.append([head, body, a + 1, b])
    joined: list[list] = []
    for p in parts:
        if joined and len(joined[-1][1]) < LEAST:
            q = joined[-1]
            q[0], q[1], q[3] = q[0] or p[0], q[1] + "\n" + p[1], p[3]
        else:
            joined.append(p)
    if len(joined) > 1 and len(joined[-1][1]) < LEAST:
        tail = joined.pop()
        joined[-1][1] += "\n" + tail[1]
        joined[-1][3] = tail[3]
    out = []
    for head, body, a, b in joined:
        starts = [0] if len(body) <= MOST else range(0, len(body) - SHARED, MOST - SHARED)
        out += [{"heading": head, "content": body[s : s + MOST], "start_line": a, "end_line": b} for s in starts]
    return out


def note_chunks(files: DataFrame) -> DataFrame:
    """(path, chunk_index, heading, content, start_line, end_line) of notes by their sections."""
    ship(files.sparkSession)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = [(p, i, c["heading"], c["content"], c["start_line"], c["end_line"]) for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for i, c in enumerate(sections(t or ""))]
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["path", "chunk_index", "heading", "content", "start_line", "end_line"])

    return files.select("path", "content").mapInArrow(run, "path string, chunk_index int, heading string, content string, start_line int, end_line int")


def chunks(files: DataFrame) -> DataFrame:
    """Chunks of the files that have more than one: those of over 8000 characters, notes by sections, others by windows."""
    long = files.filter(F.length("content") > WHOLE)
    notes = note_chunks(long.filter(extension(F.col("path")).isin(".md", ".txt", ".rst")))
    code = code_chunks(long.filter(~extension(F.col("path")).isin(".md", ".txt", ".rst"))).withColumn("heading", F.lit(None).cast("string"))
    return notes.unionByName(code.select(*notes.columns))
