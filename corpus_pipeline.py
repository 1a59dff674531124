"""The corpus pipeline: language ID, near-dedup, decontamination, PII, piece encoding, in this order.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet into the shared folder and read again
as the next one's docs; all but the last return the columns of documents. What a stage has staged for itself is deleted once
its result is written, and that result once the next stage's is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import common, decontaminate, language_id, near_dedup, pii, piece_encoding

STAGES = [
    ("language_id", language_id.stage),
    ("near_dedup", near_dedup.stage),
    ("decontamination", decontaminate.stage),
    ("pii", pii.stage),
    ("piece_encoding", piece_encoding.stage),
]

#: Trained classifiers and tokenizers are beyond SQL; tests hold the result against the operators' brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with common.scratch(spark) as written:
            docs = common.staged(stage(spark, docs, sf_dir), name)
            written.pop()
        if before is not None:
            common.drop_staged(before)
        before = docs
    return docs
