"""MinHash near-dedup (operator 10): fast similarity sketching, banding, exact verification.

Sketch: in round ``i < t`` each element is thrown into one hashed bin, in round ``t + b`` into bin ``b``; a bin keeps
its least ``(round, value)``. Rounds stop when all bins are full, which ``2 t`` rounds guarantee. One bin of two sets
agrees with the probability of their Jaccard similarity, with concentration as for independent hash functions.

Exact copies of a shingle set are collapsed before anything else, so a hot group of copies costs one aggregation. Buckets
are never expanded into all pairs: each member is first compared with its bucket's least member in every band, the links
found are joined to components, and what shared buckets connect but links don't is compared in blocks, exactly.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C
from .components import components

BANDS, ROWS = 52, 7
BLOCK_ITEMS = 300_000
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_NONE = np.uint64(2**64 - 1)


def shingle_sets(texts: list[bytes], width: int = 2) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingles of each text; a text of fewer words is one shingle, one without words has none."""
    raw, off = C.joined(texts)
    if not len(raw):
        return [np.zeros(0, np.uint64)] * len(texts)
    word = ~_SPACE[raw]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    edge = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < len(raw))]
    first[edge] = word[edge]
    last[edge - 1] = word[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    h = C.range_hash(C.BYTE[_LOWER[raw]], starts, ends)
    at = np.searchsorted(starts, off)
    n = len(h)
    if n >= width:
        sh = h[: n - width + 1].copy()
        for k in range(1, width):
            sh = C.mix(sh * np.uint64(0xD6E8FEB86659FD93) + h[k : n - width + 1 + k])
    out = []
    for i in range(len(texts)):
        a, b = at[i], at[i + 1]
        if b - a >= width:
            out.append(np.unique(sh[a : b - width + 1]))
        elif b > a:
            x = np.full(1, b - a, np.uint64)
            for k in range(a, b):
                x = C.mix(x * np.uint64(0xA0761D6478BD642F) + h[k : k + 1])
            out.append(x)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sketches(sets: list[np.ndarray], t: int) -> np.ndarray:
    """A row of ``t`` coordinates for each set; an empty set keeps the value that nothing else takes."""
    s = np.full(len(sets) * t, _NONE, np.uint64)
    sizes = np.array([len(x) for x in sets])
    e, row = np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.repeat(np.arange(len(sets)), sizes)
    for i in range(2 * t):
        if not len(e):
            break
        h = C.mix(e ^ C.mix(np.full(1, i + 1, np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        b = ((h >> np.uint64(32)) % np.uint64(t)).astype(np.int64) if i < t else i - t
        np.minimum.at(s, row * t + b, (C.mix(h) >> np.uint64(10)) | (np.uint64(i) << np.uint64(54)))
        open_ = (s.reshape(-1, t) == _NONE).any(axis=1)
        keep = open_[row]
        e, row = e[keep], row[keep]
    return s.reshape(-1, t)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _texts(col) -> list[bytes]:
    return [b"" if x is None else x for x in col.cast(pa.binary()).to_pylist()]


def _signatures(width: int, bands: int, rows: int):
    def run(batches):
        salt = C.mix(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in batches:
            texts = _texts(batch.column(1))
            for a, b in C.slices(texts):
                sets = shingle_sets(texts[a:b], width)
                sk = sketches(sets, bands * rows).reshape(len(sets), bands, rows)
                key = np.broadcast_to(salt, (len(sets), bands)).copy()
                for k in range(rows):
                    key = C.mix(key * np.uint64(0xD6E8FEB86659FD93) + sk[:, :, k])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array([len(x) for x in sets], pa.int64()),
                        pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets], pa.binary()),
                        pa.ListArray.from_arrays(np.arange(0, len(sets) * bands + 1, bands, dtype=np.int32), pa.array(_signed(key).ravel())),
                    ],
                    ["doc_id", "n_shingles", "digest", "bands"],
                )

    return run


def _sets(width: int):
    def run(batches):
        for batch in batches:
            texts = _texts(batch.column(1))
            for a, b in C.slices(texts):
                sets = shingle_sets(texts[a:b], width)
                off = np.zeros(len(sets) + 1, np.int32)
                np.cumsum([len(x) for x in sets], out=off[1:])
                values = pa.array(_signed(np.concatenate(sets)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(off, values)], ["node", "items"])

    return run


def node_sets(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(node, items) of the given nodes: their full shingle sets, from the whole texts."""
    texts = docs.select("doc_id", "text").join(nodes.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")
    return C.staged(texts.mapInArrow(_sets(width), f"node {docs.schema['doc_id'].dataType.simpleString()}, items array<long>"), "sets")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets overlap enough."""
    left, right = (sets.select(F.col("node").alias(k), F.col("items").alias(f"items_{k}")) for k in "ab")
    both = pairs.hint("merge").join(right.hint("merge"), "b").join(left.hint("merge"), "a")
    same = F.size(F.array_intersect("items_a", "items_b"))
    found = both.select("a", "b", same.alias("i"), (F.size("items_a") + F.size("items_b")).alias("n")).filter(100 * F.col("i") >= percent * (F.col("n") - F.col("i")))
    return C.staged(found.select("a", "b"), "links")


def _block(percent: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("n")
        asks = table["asks"].combine_chunks().to_numpy(zero_copy_only=False)
        a, b = [], []
        if asks.any() and not asks.all():
            items = table["items"].combine_chunks()
            off, values = items.offsets.to_numpy(), items.values.to_numpy()
            _, ids = np.unique(values[off[0] : off[-1]], return_inverse=True)
            off = off - off[0]
            comp, size = table["component"].combine_chunks().dictionary_encode().indices.to_numpy(), np.diff(off)
            mark = np.zeros(ids.max() + 1, np.int32)
            data = np.flatnonzero(~asks)
            flat = np.concatenate([ids[off[i] : off[i + 1]] for i in data])
            at = np.zeros(len(data) + 1, np.int64)
            np.cumsum(size[data], out=at[1:])
            for q in np.flatnonzero(asks):
                # Rows come by size, and only sets of nearly the same size can overlap enough.
                lo, hi = np.searchsorted(size[data], [-(-percent * size[q] // 100), 100 * size[q] // percent + 1])
                if lo == hi:
                    continue
                own, some = ids[off[q] : off[q + 1]], data[lo:hi]
                mark[own] = 1
                same = np.add.reduceat(mark[flat[at[lo] : at[hi]]], at[lo:hi] - at[lo])
                mark[own] = 0
                hit = some[(comp[some] != comp[q]) & (100 * same >= percent * (size[q] + size[some] - same))]
                _, one = np.unique(comp[hit], return_index=True)
                a += [q] * len(one)
                b += hit[one].tolist()
        node = table["node"]
        return pa.table({"a": node.take(pa.array(a, pa.int64())), "b": node.take(pa.array(b, pa.int64()))})

    return run


def missed(cluster: DataFrame, comp: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between the components of a cluster, which is what shared buckets connect.

    A link that the first comparisons missed has an end outside its cluster's largest component. These documents are the queries:
    each is compared exactly with the members of the cluster whose sets are of nearly its size (others can't overlap enough), in
    blocks of bounded size, and one link is returned for each component that it meets; no pair is emitted otherwise.
    """
    member = cluster.withColumnRenamed("component", "cluster").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    member = C.staged(member.join(sets, "node").select("cluster", "component", "node", "items", F.size("items").cast("long").alias("n")), "members")
    parts = member.groupBy("cluster", "component").agg(F.sum("n").alias("n"))
    whole = parts.groupBy("cluster").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("parts")).filter("parts > 1").select("cluster", "main")
    # Classes of sizes: what overlaps enough differs by one class at most (the factor leaves room for rounding).
    class_ = F.floor(F.log(F.col("n").cast("double")) / math.log(101 / percent)).cast("int")
    member = member.join(whole, "cluster").withColumn("class", class_)
    near = F.explode(F.array(F.col("class") - 1, F.col("class"), F.col("class") + 1))
    blocks = lambda c: F.ceil(c / BLOCK_ITEMS).cast("int")
    asked = member.filter("component <> main").select("cluster", near.alias("class"), "n").groupBy("cluster", "class").agg(blocks(F.sum("n")).alias("nq"))
    there = member.groupBy("cluster", "class").agg(blocks(F.sum("n")).alias("nd")).join(asked, ["cluster", "class"])
    pick = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keep = ["cluster", "class", "component", "node", "items", "n"]
    data = member.join(there, ["cluster", "class"]).select(*keep, F.lit(False).alias("asks"), pick("nd").alias("db"), every("nq").alias("qb"))
    asks = member.filter("component <> main").withColumn("class", near).join(there, ["cluster", "class"]).select(*keep, F.lit(True).alias("asks"), pick("nq").alias("qb"), every("nd").alias("db"))
    # Dealt by block: else a join before this may leave all blocks of a cluster in one task.
    met = data.unionByName(asks).repartition("cluster", "class", "db", "qb").groupBy("cluster", "class", "db", "qb")
    kind = member.schema["node"].dataType.simpleString()
    return C.staged(met.applyInArrow(_block(percent), f"a {kind}, b {kind}"), "links")


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Components of the documents whose shingle sets have a Jaccard similarity of ``percent``/100 or more.

    Takes ``doc_id`` (of any type that has an order) and ``text``; other columns are ignored, very long texts are read whole. Returns doc_id, n_shingles, component_id, kept for
    every input row. Null or blank texts have no shingles and are linked with nothing; rows that repeat a doc_id share its
    component; a row whose doc_id is null is kept with a null component. Empty input gives no rows. A pair of similarity 0.8
    misses all bands with a probability of 5e-6 (``bands`` 52, ``rows`` 7), a more similar one with less.
    """
    spark = docs.sparkSession
    C.small_batches(spark)
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    sigs = C.staged(docs.mapInArrow(_signatures(width, bands, rows), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_shingles long, digest binary, bands array<long>"), "sketches")
    usable = sigs.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    nodes = C.staged(usable.groupBy("digest").agg(F.min("doc_id").alias("node")), "nodes")
    reps = usable.join(nodes.select("digest", F.col("node").alias("doc_id")), ["digest", "doc_id"], "left_semi")
    keyed = C.staged(reps.select(F.col("doc_id").alias("node"), F.explode("bands").alias("key")).distinct(), "bands")
    heads = keyed.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a < z").select("key", "a")
    shared = C.staged(keyed.join(heads, "key").select("key", "node", "a"), "buckets")
    C.drop_staged(keyed)
    stars = C.staged(shared.filter("node > a").select("a", F.col("node").alias("b")).distinct(), "pairs")
    C.drop_staged(shared)
    cluster = components(stars)
    sets = node_sets(docs, cluster, width)
    links = verified(stars, sets, percent)
    more = missed(cluster, components(links), sets, percent)
    C.drop_staged(sets)
    comp = components(links.unionByName(more))
    of = nodes.join(comp, "node", "left").select("digest", F.coalesce("component", "node").alias("of_set"))
    least = usable.join(of, "digest").groupBy("doc_id").agg(F.min("of_set").alias("component_id"))
    out = sigs.select("doc_id", "n_shingles").join(least, "doc_id", "left")
    cid = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", cid.alias("component_id"), F.coalesce(cid == F.col("doc_id"), F.lit(True)).alias("kept"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group stays (five-word shingles, similarity 0.8); columns as they came.

    The least doc_id of a group stays. Of rows that repeat a doc_id one stays, that with the least hash of its text, then of all its
    columns. Rows without doc_id all stay, those without words too. Very long texts are read whole, other columns may have any
    name. An empty table gives an empty one.
    """
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    keyed = whole.select("row", F.col("row.doc_id").alias("id"), F.xxhash64(F.col("row.text").cast("string")).alias("text_key"), F.xxhash64("row").alias("row_key"))
    kept = near_duplicates(docs.select("doc_id", "text")).filter("kept and doc_id is not null").select(F.col("doc_id").alias("id")).distinct()
    named = keyed.join(kept, "id", "left_semi")
    first = named.withColumn("place", F.row_number().over(W.partitionBy("id").orderBy("text_key", "row_key"))).filter("place = 1")
    return first.select("row.*").unionByName(keyed.filter("id is null").select("row.*"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(C.table(spark, sf_dir, "documents"), percent=80, width=2)
