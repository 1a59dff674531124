"""Document fingerprints (operator 5): context-triggered piecewise hashing.

A rolling hash over seven bytes cuts a text where its value is -1 modulo the block size (3 * 2**k); each piece is hashed to
one of 64 signs. The fingerprint holds the signs for a block size and its double, ``size:signs:signs``; the size is the
smallest that gives at most 64 pieces, halved while there are under 32. Fingerprints are compared where their block sizes
are equal or differ by a factor of two: by the share of signs in a longest common subsequence, that is, one less the edit
distance (insertions and deletions) over both lengths, if they share seven signs in a row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegralType

from . import common as C

SIGNS = 64
_SIGN = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_SHARED = 7


def rolling(b: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte: sum, weighted sum and shifted exclusive or of the last seven bytes."""
    n = len(b)
    x = np.zeros(n + 8, np.uint32)
    x[8:] = b
    s = np.cumsum(x, dtype=np.uint32)
    ss = np.cumsum(s, dtype=np.uint32)
    now = s[8:]
    h = now - s[1 : n + 1]
    h += np.uint32(7) * now - (ss[7 : n + 7] - ss[0:n])
    z = x[8:].copy()
    for i in range(1, 7):
        z ^= x[8 - i : n + 8 - i] << np.uint32(5 * i)
    return h + z


def _signs(ends: np.ndarray, sums: np.ndarray, inv: np.ndarray, n: int) -> str:
    ends = ends[: SIGNS - 1] + 1
    if not len(ends) or ends[-1] < n:
        ends = np.append(ends, n)
    starts = np.concatenate([[0], ends[:-1]])
    h = C.mix((sums[ends] - sums[starts]) * inv[starts] + (ends - starts).astype(np.uint64))
    return _SIGN[(h >> np.uint64(58)).astype(np.int64)].tobytes().decode()


def _cuts(h: np.ndarray, k: int) -> np.ndarray:
    """Where a block of size ``3 * 2**k`` ends; ``h`` is the rolling hash and one."""
    at = np.flatnonzero((h & np.uint32((1 << k) - 1)) == 0)
    return at[h[at] % np.uint32(3) == 0]


def fingerprint(text: bytes) -> str:
    n = len(text)
    if not n:
        return "3::"
    b = np.frombuffer(text, np.uint8)
    h = rolling(b) + np.uint32(1)
    p, inv = C.powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(C.BYTE[b] * p[:n], out=sums[1:])
    k = 0
    while 3 * (1 << k) * SIGNS < n:
        k += 1
    low = max(0, k - 4)
    at = _cuts(h, low)
    ends = lambda j: at[(h[at] & np.uint32((1 << j) - 1)) == 0]
    while k and len(ends(k)) < SIGNS // 2 - 1:
        k -= 1
        if k < low:
            low = max(0, low - 4)
            at = _cuts(h, low)
    return f"{3 << k}:{_signs(ends(k), sums, inv, n)}:{_signs(ends(k + 1), sums, inv, n)}"


def _subsequence(a: str, b: str) -> int:
    """Length of a longest common subsequence, with one machine word for a row of the table."""
    mask: dict[str, int] = {}
    for i, c in enumerate(a):
        mask[c] = mask.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & mask.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _alike(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    k = min(_SHARED, len(a), len(b))
    if not any(a[i : i + k] in b for i in range(len(a) - k + 1)):
        return 0.0
    return 2 * _subsequence(a, b) / (len(a) + len(b))


def likeness(x: str, y: str) -> float:
    """0 to 1; 1 for equal fingerprints, 0 where block sizes are not compatible."""
    if x == y:
        return 1.0
    sa, a1, a2 = x.split(":")
    sb, b1, b2 = y.split(":")
    i, j = int(sa), int(sb)
    if i == j:
        return max(_alike(a1, b1), _alike(a2, b2))
    if i == 2 * j:
        return _alike(a1, b2)
    if j == 2 * i:
        return _alike(a2, b1)
    return 0.0


def edited(text: str, following: str) -> str:
    """The last third of the code points is replaced by the first as many (or all) of the following text."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def _row(doc, text: str, fp: str, following: str, next_fp: str) -> tuple:
    new = edited(text, following)
    raw = new.encode("utf-8", "surrogatepass")
    efp = fp if new == text else fingerprint(raw)
    return doc, len(text), hashlib.sha256(raw).hexdigest(), fp, efp, likeness(fp, efp), likeness(fp, next_fp)


_OUT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = ["doc_id", *[x.split()[0] for x in _OUT.split(", ")]]
_KINDS = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def _compared(batches):
    """Rows in order, each with the one after it; a part ends with the next one's first row as a guest, or else with its own first row."""
    rows: list[tuple] = []
    held = first = part_now = None  # doc_id, text, fingerprint: waits for the document after it
    kind = pa.null()

    def flush():
        cols = list(zip(*rows, strict=True))
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [kind, *_KINDS], strict=True)], _NAMES)

    for batch in batches:
        kind = batch.column(2).type
        for part, guest, doc, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            text = text or ""
            if guest and (held is None or part_now != part):
                continue
            now = (doc, text, fingerprint(text.encode("utf-8", "surrogatepass")))
            if held is not None:
                rows.append(_row(*held, *now[1:]))
            else:
                first = now
            held, part_now = (None if guest else now), part
            if len(rows) >= 500:
                yield flush()
    if held is not None:
        rows.append(_row(*held, *first[1:]))
    if rows:
        yield flush()


def _bounds(rows: DataFrame, parts: int) -> list:
    """Descending ids that begin the ranges; the largest one is among them."""
    if isinstance(rows.schema["doc_id"].dataType, IntegralType):
        found = rows.agg(F.percentile_approx("doc_id", [1 - i / parts for i in range(parts)], 100 * parts).alias("b"), F.max("doc_id").alias("top")).first()
        some = found["b"] or []
    else:  # other kinds of ids: every twentieth of those with the least hashes, a bounded number of them
        known = rows.select("doc_id").filter("doc_id is not null")
        some = sorted(r["doc_id"] for r in known.orderBy(F.xxhash64("doc_id")).limit(20 * parts).collect())[::20]
        found = known.agg(F.max("doc_id").alias("top")).first()
    return sorted({*some, *([found["top"]] if found["top"] is not None else [])}, reverse=True)


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per input row, see ``_OUT``; documents follow each other by descending doc_id, after the last comes the first.

    Null text counts as empty (fingerprint ``3::``). Of rows that repeat a doc_id the order is that of their texts' hashes; null
    doc_ids come last. A single document follows itself. doc_id may be of any type that has an order; very long texts are read
    whole; other columns are ignored. Empty input gives no rows. Each text is dealt once, by ranges of doc_id; only the first of
    each range goes to two of them.
    """
    spark = docs.sparkSession
    C.small_batches(spark, 500)
    kind = docs.schema["doc_id"].dataType
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    bounds = _bounds(rows, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # The first rows of a range also go, as guests, to the range before it. Without bounds (no doc_id but null) there is one range.
    return _ranged(rows, bounds, max(1, len(bounds)), kind)


def _ranged(rows: DataFrame, bounds: list, n: int, kind: DataType) -> DataFrame:
    up = bounds[::-1]
    above = F.lit(len(up)) - C.bounds_below(F.col("doc_id"), up, kind)  # bounds that are the id or more
    own = F.when(F.col("doc_id").isNull(), n - 1).otherwise(above - 1) if up else F.lit(0)
    begins = (C.bounds_below(F.col("doc_id"), up, kind, equal=True) > C.bounds_below(F.col("doc_id"), up, kind)) if up else F.lit(False)
    entry = lambda part, guest: F.struct(part.cast("int").alias("part"), F.lit(guest).alias("guest"))
    placed = rows.withColumn("own", own)
    both = F.when(begins, F.array(entry(F.col("own"), False), entry(F.pmod(F.col("own") - 1, F.lit(n)), True))).otherwise(F.array(entry(F.col("own"), False)))
    dealt = placed.select(F.explode(both).alias("e"), "doc_id", "text").select("e.part", "e.guest", "doc_id", "text", F.xxhash64("text").alias("h"))
    dealt = dealt.repartitionById(n, "part").sortWithinPartitions("part", "guest", F.col("doc_id").desc_nulls_last(), "h")
    return dealt.select("part", "guest", "doc_id", "text").mapInArrow(_compared, f"doc_id {kind.simpleString()}, {_OUT}")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(C.table(spark, sf_dir, "documents"))
