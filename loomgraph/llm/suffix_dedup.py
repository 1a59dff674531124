"""Suffix-array dedup (operator 2): every byte that a repeated string of ``length`` bytes covers is removed.

Column-wise construction of the Burrows-Wheeler order and common prefixes of a collection: in each round one symbol of every
document, from its end, is put before the suffix inserted last; the place follows from the order of the suffixes with that
symbol, the common prefix from a range minimum. A symbol is a group of forty bytes, which divides ``length``, so a string enters in forty phases and the
rounds are as many as its forties.

One construction over the whole collection would need as many rounds as the longest document has symbols, each over all data.
So the collection is first dealt into blocks that share no string of ``length`` bytes: each window of that length belongs to the
least hash among its ``gram``-byte parts, and neighbouring windows with the same least hash form one string. What has a hash of
its own is not repeated. Strings that are equal as a whole are settled by counting; of the others each distinct one goes, with
all strings of the same hash, through the construction in blocks of bounded size (through sequential files where a block is
large). A hash with more strings than a
block may hold, or with a very long one (text that repeats itself), is settled by counting its windows. No group meets in one task.

Two windows count as equal if the construction has compared their bytes, or if two 64-bit hashes of their strings are equal, that
of the whole string (or window) and the least one of its parts.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

LENGTH, GRAM, SYMBOL = 400, 200, 40
BLOCK_BYTES, HOT_BYTES, LONG_BYTES, IN_MEMORY = 150_000, 3_000_000, 4096, 1 << 22
_HALF = np.int64((1 << 32) - 1)


# --- the construction ---


class _RangeMin:
    """Minima of ranges: within groups of 64 by prefixes and suffixes, over groups by a sparse table."""

    def __init__(self, a: np.ndarray):
        n = -(-len(a) // 64) * 64
        b = np.full(n, np.iinfo(a.dtype).max, a.dtype)
        b[: len(a)] = a
        self.rows = b.reshape(-1, 64)
        self.pre = np.minimum.accumulate(self.rows, axis=1).ravel()
        self.suf = np.minimum.accumulate(self.rows[:, ::-1], axis=1)[:, ::-1].ravel()
        self.levels = [self.rows.min(axis=1)]
        while (1 << len(self.levels)) <= len(self.levels[0]):
            x, h = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(x[:-h], x[h:]))

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Minimum over lo..hi, both included; lo <= hi."""
        g, e = lo >> 6, hi >> 6
        out = np.minimum(self.suf[lo], self.pre[hi])
        far = np.flatnonzero(e - g > 1)
        if len(far):
            a, b = g[far] + 1, e[far]
            k = np.frexp((b - a).astype(float))[1] - 1
            for level in np.unique(k):
                at = np.flatnonzero(k == level)
                t = self.levels[level]
                i = far[at]
                out[i] = np.minimum(out[i], np.minimum(t[a[at]], t[b[at] - (1 << level)]))
        near = np.flatnonzero(g == e)
        if len(near):
            rows, col = self.rows[g[near]], np.arange(64)
            inside = (col >= (lo[near] & 63)[:, None]) & (col <= (hi[near] & 63)[:, None])
            out[near] = np.where(inside, rows, np.iinfo(rows.dtype).max).min(axis=1)
        return out


def _merge(old: np.ndarray, new: np.ndarray, keep: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.empty(len(keep), old.dtype)
    out[at] = new
    out[keep] = old
    return out


def _through(file, a: np.ndarray) -> np.ndarray:
    """Write an array to the file in order and map it for the next round."""
    file.seek(0)
    a.tofile(file)
    file.truncate()
    file.flush()
    return np.memmap(file, a.dtype, "r+", shape=a.shape)


def ordered(symbols: np.ndarray, off: np.ndarray, in_memory: int = IN_MEMORY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes of all documents (``symbols[off[d]:off[d + 1]]``, each above 0) in order: document, length, common prefix.

    An end mark is smaller than all symbols and common to no two documents. One symbol of each document is inserted each round.
    """
    n = len(off) - 1
    size = np.diff(off)
    key = np.arange(n, dtype=np.int64)  # first symbol, then the place of the rest
    lcp, doc, length = np.zeros(n, np.int32), np.arange(n, dtype=np.int32), np.zeros(n, np.int32)
    place = np.arange(n, dtype=np.int64)
    files = [[tempfile.TemporaryFile() for _ in range(4)] for _ in range(2)] if 20 * (len(symbols) + n) > in_memory else None
    for j in range(1, int(size.max(initial=0)) + 1):
        act = np.flatnonzero(size >= j)
        new = (symbols[off[act + 1] - j].astype(np.int64) << np.int64(32)) | place[act]
        o = np.argsort(new)
        act, new = act[o], new[o]
        at = np.searchsorted(key, new)
        to = at + np.arange(len(at))
        rest, sign = new & _HALF, new >> np.int64(32)
        least = _RangeMin(lcp)
        chained = np.zeros(len(at), bool)
        chained[1:] = at[1:] == at[:-1]
        before = np.where(at > 0, key[np.maximum(at - 1, 0)], np.int64(0))
        before[1:] = np.where(chained[1:], new[:-1], before[1:])
        same = (before >> np.int64(32)) == sign
        own = np.zeros(len(at), np.int32)
        own[same] = 1 + least((before[same] & _HALF) + 1, rest[same])
        last = np.ones(len(at), bool)
        last[:-1] = ~chained[1:]
        last &= at < len(key)
        i = np.flatnonzero(last)
        after = key[at[i]]
        same = (after >> np.int64(32)) == sign[i]
        then = np.zeros(len(i), np.int32)
        then[same] = 1 + least(rest[i][same] + 1, after[same] & _HALF)
        lcp = np.array(lcp) if files else lcp
        lcp[at[i]] = then
        keep = np.ones(len(key) + len(at), bool)
        keep[to] = False
        moved = np.cumsum(np.bincount(at, minlength=len(key) + 1))[: len(key)]
        key, lcp = _merge(key, new, keep, to), _merge(lcp, own, keep, to)
        key += moved[key & _HALF]
        doc, length = _merge(doc, act.astype(np.int32), keep, to), _merge(length, np.full(len(act), j, np.int32), keep, to)
        place[act] = to
        if files:
            key, lcp, doc, length = (_through(f, a) for f, a in zip(files[j % 2], (key, lcp, doc, length), strict=True))
    out = tuple(np.array(a) for a in (doc, length, lcp))
    for f in [f for fs in files or [] for f in fs]:
        f.close()
    return out


def repeated(strings: list[bytes], length: int = LENGTH, symbol: int = SYMBOL) -> list[np.ndarray]:
    """For each string and each place in it: does a string of ``length`` bytes start there that starts elsewhere too?

    ``symbol`` divides ``length``. Symbols are ranked by their bytes.
    """
    cut, at, flat = [], [], []
    for i, s in enumerate(strings):
        for p in range(min(symbol, len(s) - length + 1)):
            n = (len(s) - p) // symbol
            cut.append(n)
            at.append((i, p))
            flat.append(np.frombuffer(s, f"S{symbol}", n, p))
    found = [np.zeros(max(0, len(s) - length + 1), bool) for s in strings]
    if not cut:
        return found
    _, ranks = np.unique(np.concatenate(flat), return_inverse=True)
    off = np.zeros(len(cut) + 1, np.int64)
    np.cumsum(cut, out=off[1:])
    doc, size, lcp = ordered(ranks + 1, off)
    need = length // symbol
    twice = lcp >= need
    twice[:-1] |= lcp[1:] >= need
    for k in np.flatnonzero(twice & (size >= need)):
        i, p = at[doc[k]]
        found[i][p + symbol * (cut[doc[k]] - size[k])] = True
    return found


def runs(mask: np.ndarray) -> Iterator[tuple[int, int]]:
    """Half-open ranges of consecutive true places."""
    d = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return zip(d[::2].tolist(), d[1::2].tolist(), strict=True)


# --- dealing into blocks ---


def _sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    n = -(-len(h) // w) * w
    b = np.full(n, np.iinfo(h.dtype).max, h.dtype)
    b[: len(h)] = h
    b = b.reshape(-1, w)
    pre, suf = np.minimum.accumulate(b, axis=1).ravel(), np.minimum.accumulate(b[:, ::-1], axis=1)[:, ::-1].ravel()
    k = len(h) - w + 1
    return np.minimum(suf[:k], pre[w - 1 : w - 1 + k])


def strings_of(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Per string: text number, start in it, number of windows, least hash, hash of the whole string, may it repeat itself."""
    raw, off = C.joined(texts)
    none = tuple(np.zeros(0, np.int64) for _ in range(6))
    if len(raw) < length:
        return none
    p, inv = C.powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(C.BYTE[raw] * p[: len(raw)], out=sums[1:])
    grams = C.mix((sums[gram:] - sums[: len(raw) - gram + 1]) * inv[: len(raw) - gram + 1])
    least = _sliding_min(grams, length - gram + 1)  # for each start in 0..len(raw)-length
    # A string repeats a window only if its least hash stands at two places: the first and the last one differ.
    low = np.uint64((1 << int(len(grams)).bit_length()) - 1)
    place = np.arange(len(grams), dtype=np.uint64)
    first = _sliding_min((grams & ~low) | place, length - gram + 1) & low
    last = low - (_sliding_min((grams & ~low) | (low - place), length - gram + 1) & low)
    del grams, place
    row = np.repeat(np.arange(len(texts)), np.diff(off))[: len(least)]
    valid = np.arange(len(least)) + length <= off[row + 1]
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1]) | ~valid[:-1]
    start = np.flatnonzero(valid & new)
    if not len(start):
        return none
    edge = np.flatnonzero(new | ~valid)
    end = np.append(edge, len(least))[np.searchsorted(edge, start, side="right")]
    stop = end + length - 1
    whole = C.mix((sums[stop] - sums[start]) * inv[start] + (stop - start).astype(np.uint64))
    return row[start], start - off[row[start]], end - start, least[start].view(np.int64), whole.view(np.int64), first[start] != last[end - 1]


def _scan(batches):
    for batch in batches:
        texts = [t or b"" for t in batch.column(2).cast(pa.binary()).to_pylist()]
        for a, b in C.slices(texts):
            row, start, n, least, whole, inner = strings_of(texts[a:b])
            off = np.searchsorted(row, np.arange(b - a + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(off, pa.array(x.astype(k))) for x, k in ((start, np.int32), (n, np.int32), (least, np.int64), (whole, np.int64), (inner, bool))]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *lists], ["doc_id", "h", "start", "n", "least", "whole", "inner"])


def _take(batches):
    for batch in batches:
        for doc, h, text, wanted in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 3)), strict=True):
            raw = (text or "").encode("utf-8", "surrogatepass")
            k = len(wanted)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([doc] * k, batch.column(0).type),
                    pa.array([h] * k, pa.int64()),
                    pa.array([w["start"] for w in wanted], pa.int32()),
                    pa.array([w["least"] for w in wanted], pa.int64()),
                    pa.array([w["more"] for w in wanted], pa.bool_()),
                    pa.array([raw[w["start"] : w["start"] + w["n"] + LENGTH - 1] for w in wanted], pa.binary()),
                ],
                ["doc_id", "h", "start", "least", "more", "s"],
            )


def _gathered(batches, columns: int = 6):
    """Record batches of at least some hundred rows, from very small ones."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= 500:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _taken(batches):
    return _gathered(_take(batches))


_RANGE = ["doc_id", "h", "a", "b"]


def _ranges(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (kind, pa.int64(), pa.int32(), pa.int32()), strict=True)], _RANGE)


def _constructed(batches):
    """Rows sorted by least hash: whole groups are put into blocks, each goes through the construction."""
    block: list[tuple] = []
    size, last, kind = 0, None, pa.null()

    def settle():
        out = []
        for (doc, h, start, _, more, _s), mask in zip(block, repeated([r[5] for r in block]), strict=True):
            if not more:  # the others are covered as a whole
                out += [(doc, h, start + a, start + b + LENGTH - 1) for a, b in runs(mask)]
        return _ranges(out, kind)

    for batch in batches:
        kind = batch.column(0).type
        for r in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            if size >= BLOCK_BYTES and r[3] != last:
                yield settle()
                block, size = [], 0
            block.append(r)
            size, last = size + len(r[5]), r[3]
    if block:
        yield settle()


def _windows(batches):
    """Each window of the strings of a hot hash: its own hash and place."""
    for batch in batches:
        for doc, h, start, least, more, s in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            raw = np.frombuffer(s, np.uint8)
            at = np.arange(len(raw) - LENGTH + 1)
            w = C.range_hash(C.BYTE[raw], at, at + LENGTH).view(np.int64)
            k = len(at)
            yield pa.RecordBatch.from_arrays(
                [pa.array([doc] * k, batch.column(0).type), pa.array([h] * k, pa.int64()), pa.array([least] * k, pa.int64()), pa.array([more] * k, pa.bool_()), pa.array((at + start).astype(np.int32)), pa.array(w)],
                ["doc_id", "h", "least", "more", "a", "w"],
            )


def _digest(batches):
    for batch in batches:
        out = []
        for doc, text, ranges in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            raw = (text or "").encode("utf-8", "surrogatepass")
            kept, at, spans = hashlib.sha256(), 0, 0
            last, removed = -1, 0
            for r in sorted((r["a"], r["b"]) for r in ranges or []):
                if r[0] > last:
                    kept.update(raw[at : r[0]])
                    spans += 1
                    at, last, removed = r[1], r[1], removed + r[1] - r[0]
                elif r[1] > last:
                    removed += r[1] - last
                    at = last = r[1]
            kept.update(raw[at:])
            out.append((doc, len(raw), removed, spans, kept.hexdigest()))
        cols = list(zip(*out, strict=True)) or [()] * 5
        kinds = (batch.column(0).type, pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select("doc_id", F.xxhash64(text).alias("h"), text.alias("text"))


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text), a, b: byte ranges to remove; they may overlap."""
    spark = docs.sparkSession
    C.small_batches(spark, 500)
    docs = _keyed(docs)
    key = docs.schema["doc_id"].dataType.simpleString()
    lists = C.staged(docs.mapInArrow(_scan, f"doc_id {key}, h long, start array<int>, n array<int>, least array<long>, whole array<long>, inner array<boolean>").filter("size(n) > 0"), "strings")
    each = lists.select("doc_id", "h", F.explode(F.arrays_zip("start", "n", "least", "whole", "inner")).alias("x")).select("doc_id", "h", "x.*")
    shared = each.groupBy("least").agg(F.count("*").alias("c"), F.min("whole").alias("lo"), F.max("whole").alias("hi"), F.bool_or("inner").alias("inner"))
    shared = shared.filter("c > 1 or inner").select("least", ((F.col("c") == 1) | (F.col("lo") < F.col("hi"))).alias("mixed"))
    met = C.staged(each.drop("inner").join(shared, "least"), "shared")
    C.drop_staged(lists)
    equal = met.filter("not mixed").select("doc_id", "h", F.col("start").alias("a"), (F.col("start") + F.col("n") + LENGTH - 1).alias("b"))
    mixed = met.filter("mixed")
    one = F.min(F.struct("doc_id", "h", "start", "n"))
    kinds = C.staged(mixed.groupBy("least", "whole").agg(F.count("*").alias("c"), one.alias("r")), "kinds")
    twice = mixed.join(kinds.filter("c > 1").select("least", "whole"), ["least", "whole"]).select("doc_id", "h", F.col("start").alias("a"), (F.col("start") + F.col("n") + LENGTH - 1).alias("b"))
    wanted = kinds.select("r.doc_id", "r.h", F.struct("r.start", "r.n", "least", (F.col("c") > 1).alias("more")).alias("w")).groupBy("doc_id", "h").agg(F.collect_list("w").alias("w"))
    d, w = docs.alias("d"), wanted.alias("w")
    taken = d.join(w, (F.col("d.h") == F.col("w.h")) & F.col("d.doc_id").eqNullSafe(F.col("w.doc_id"))).select("d.doc_id", "d.h", "d.text", "w.w")
    strings = C.staged(taken.mapInArrow(_taken, f"doc_id {key}, h long, start int, least long, more boolean, s binary").dropDuplicates(["doc_id", "h", "start", "least"]), "strings")
    weight = strings.groupBy("least").agg(F.sum(F.length("s")).alias("bytes"), (F.max(F.length("s")) > LONG_BYTES).alias("long"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cool = strings.join(weight.filter((F.col("bytes") <= HOT_BYTES) & ~F.col("long")).select("least"), "least", "left_semi")
    hot = strings.join(weight.filter((F.col("bytes") > HOT_BYTES) | F.col("long")).select("least"), "least", "left_semi")
    columns = ["doc_id", "h", "start", "least", "more", "s"]
    built = cool.select(*columns).repartition(parts, "least").sortWithinPartitions("least").mapInArrow(_constructed, f"doc_id {key}, h long, a int, b int")
    windows = hot.select(*columns).mapInArrow(_windows, f"doc_id {key}, h long, least long, more boolean, a int, w long")
    often = windows.groupBy("least", "w").agg(F.count("*").alias("c")).filter("c > 1").select("least", "w")
    counted = windows.filter("not more").join(often, ["least", "w"]).select("doc_id", "h", "a", (F.col("a") + LENGTH).alias("b"))
    return C.staged(equal.unionByName(twice).unionByName(built).unionByName(counted), "ranges")


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every input row.

    Null text counts as empty. Strings are judged on the input; matches within one document count, none crosses documents.
    Repeated rows repeat each other's strings, so all their bytes in strings of 400 go. doc_id may be of any type; null ones are
    texts like others. Very long texts are read whole, other columns are ignored.
    Empty input gives no rows.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    ranges = repeated_ranges(docs).groupBy("doc_id", "h").agg(F.collect_set(F.struct("a", "b")).alias("ranges"))
    d, r = _keyed(docs).alias("d"), ranges.alias("r")
    both = d.join(r, (F.col("d.h") == F.col("r.h")) & F.col("d.doc_id").eqNullSafe(F.col("r.doc_id")), "left").select("d.doc_id", "d.text", "r.ranges")
    return both.mapInArrow(_digest, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(C.table(spark, sf_dir, "documents"))
