"""Models are plugged in: an embedder, a text model, a pair scorer. Deterministic stand-ins for tests; failures have defaults."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from ..functions import vocab as V
from ..session import ship

Embedder = Callable[[list[str]], list[list[float]]]
TextModel = Callable[[str], str]


def hashed_embedder(dims: int = 64) -> Embedder:
    """Hashed bags of words: a stand-in without a model."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * dims
            for w in re.findall(r"\w+", t.lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                v[h % dims] += 1.0 if h >> 63 else -1.0
            n = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / n for x in v])
        return out

    return embed


def embedded(rows: DataFrame, text: str, embedder: Embedder, batch: int = 20, most: int = 8000, retries: tuple[int, ...] = (4000, 2000, 1000)) -> DataFrame:
    """``embedding`` of each row's text, by batches, cut to ``most`` characters; a failed batch is tried row by row, ever shorter."""
    ship(rows.sparkSession)
    schema = StructType([*rows.schema.fields, StructField("embedding", ArrayType(FloatType()))])

    def one(t: str) -> list[float] | None:
        for k in (most, *retries):
            try:
                return embedder([t[:k]])[0]
            except Exception:  # noqa: BLE001, S112  the model may fail in any way; a shorter text is tried
                continue
        return None

    def run(batches):
        import pandas as pd

        for pdf in batches:
            texts = [(t or "").replace("\0", "") for t in pdf[text]]
            found: list = []
            for i in range(0, len(texts), batch):
                some = texts[i : i + batch]
                try:
                    found += embedder([t[:most] for t in some])
                except Exception:  # noqa: BLE001
                    found += [one(t) for t in some]
            yield pdf.assign(embedding=pd.Series(found, index=pdf.index, dtype=object))

    return rows.mapInPandas(run, schema)


def cached_embeddings(rows: DataFrame, text: str, cache: DataFrame | None, embedder: Embedder, model: str) -> DataFrame:
    """``embedding`` from the cache table (key, embedding) by hash of model and text, the rest from the model."""
    keyed = rows.withColumn("key", F.sha2(F.concat(F.lit(model + ":"), F.col(text)), 256))
    if cache is None:
        return embedded(keyed, text, embedder)
    hit = keyed.join(cache.dropDuplicates(["key"]), "key")
    miss = embedded(keyed.join(cache, "key", "left_anti"), text, embedder)
    return hit.select(*miss.columns).unionByName(miss)


def generated(rows: DataFrame, prompt: str, column: str, model: TextModel, failure: str = "") -> DataFrame:
    """``column``: the model's answer to each row's prompt, or ``failure``."""
    ship(rows.sparkSession)

    @F.pandas_udf("string")
    def run(prompts):
        def one(p):
            try:
                return model(p)
            except Exception as e:  # noqa: BLE001
                return failure.replace("{error}", str(e))

        return prompts.map(one)

    return rows.withColumn(column, run(F.col(prompt)))


def parsed_score(answer, default: float = 5.0):
    """First number of an answer over ten, between 0 and 1; without a number the default."""
    n = F.regexp_extract(answer, r"(\d+(?:\.\d+)?)", 1).try_cast("double")
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(n, F.lit(default)) / 10))


def sigmoid(logit):
    return 1 / (1 + F.exp(-logit))


def routed(question: str, default: str, coder: str) -> str:
    low = question.lower()
    return coder if any(s in low for s in V.CODE_SIGNALS) else default
