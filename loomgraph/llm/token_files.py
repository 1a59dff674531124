"""Token-ID / binary output (operator 3): ORC stripes with row indexes and Bloom filters on document ids.

Documents are dealt by ranges of doc_id, encoded, and written as one ORC file a range, in ascending order of doc_id: integer
run-length encoding for ids, a row index and a Bloom filter on doc_id in every stripe. Stripes are read in parallel, and a
search for document ids skips files, stripes and row groups by their statistics and filters. ``start`` (ids before a document)
comes from the files: sums by part, then by row inside each part.

Encoding keeps the ids of words in a bounded table. A byte-level vocabulary cuts texts before each single space and no token of
it reaches across, so a text is the concatenation of its parts' ids; between letters and punctuation it is cut as well, which
leaves fewer different words. Texts with double or no-break spaces or with what could be a special token go through the tokenizer whole. New words are encoded many at a time and told apart by their leading space.
"""

from __future__ import annotations

import itertools
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegralType, LongType, StringType

from . import common as C

VOCABULARY, END_ID = "byte_bpe_50k.json", 2
STRIPE_BYTES, INDEX_STRIDE, BATCH_BYTES = 16 << 20, 1000, 6 << 20
_CACHE = 800_000
_OTHER = r"!-&(-/:-@\[-`{-~"
_SPACE = "Ġ"  # how a byte-level vocabulary writes a space


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of texts, equal to the tokenizer's own."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        n = self.tokenizer.get_vocab_size()
        self.leads = np.array([(self.tokenizer.id_to_token(i) or "").startswith(_SPACE) for i in range(n)])
        self._forget()

    def _forget(self) -> None:
        self.led: dict[str, int] = {}  # numbers of words behind a space, written without it
        self.first: dict[str, int] = {}  # numbers of words that begin a text
        self.at, self.ids, self.n, self.used = np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.int32), 0, 0

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(itertools.chain.from_iterable(found), np.int32, int(sizes.sum())), sizes

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words behind a space: joined, then cut before each token that begins with a space."""
        ids, sizes = self._whole([" " + " ".join(words[i : i + 400]) for i in range(0, len(words), 400)])
        lead, begin = self.leads[ids], np.cumsum(sizes) - sizes
        by_group = np.add.reduceat(lead, begin) if len(sizes) else sizes
        if not lead[begin].all() or (by_group[:-1] != 400).any() or by_group.sum() != len(words):
            return self._whole([" " + w for w in words])
        return ids, np.diff(np.flatnonzero(np.append(lead, True)))

    def _numbers(self, known: dict[str, int], words: list[str], encode) -> np.ndarray:
        """The numbers of distinct words in a table; what is new goes in, encoded."""
        out = np.fromiter(map(known.get, words, itertools.repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(out < 0)
        if not len(missing):
            return out
        new = [words[i] for i in missing.tolist()]
        ids, sizes = encode(new)
        k, end = self.n, self.used + len(ids)
        if k + len(new) >= len(self.at):
            self.at = np.concatenate([self.at, np.zeros(k + len(new), np.int64)])
        if end > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(end, np.int32)])
        self.ids[self.used : end] = ids
        np.cumsum(sizes, out=self.at[k + 1 : k + len(new) + 1])
        self.at[k + 1 : k + len(new) + 1] += self.used
        self.n, self.used = k + len(new), end
        known.update(zip(new, range(k, k + len(new)), strict=True))
        out[missing] = np.arange(k, k + len(new))
        return out

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Where each text's ids begin (one more entry than texts), and all ids. There are no nulls."""
        odd = pc.match_substring_regex(texts, "  |\u00a0|<\\||\x00").to_numpy(zero_copy_only=False)
        some = texts.filter(pa.array(~odd)) if odd.any() else texts
        # Between an ASCII letter and other ASCII signs (no apostrophes, digits or spaces) texts are always cut too. A mark says that no
        # space stands before what follows.
        for before, after in (("[A-Za-z]", rf"[{_OTHER}\n]"), (f"[{_OTHER}]", "[A-Za-z]"), ("[!-~\x00]\n", "[A-Za-z]")):  # a line's end after white space is not cut off
            some = pc.replace_substring_regex(some, f"({before})({after})", "\\1 \x00\\2")
        parts = pc.split_pattern(some, " ")
        off = parts.offsets.to_numpy().astype(np.int64)
        flat = parts.values.slice(off[0], off[-1] - off[0])
        off -= off[0]
        coded = flat.dictionary_encode()
        words = coded.dictionary.to_pylist()
        first = flat.take(pa.array(off[:-1])).unique().to_pylist()  # these have no space before them
        if self.n + len(words) + len(first) > _CACHE:
            self._forget()
        marked = pc.starts_with(coded.dictionary, "\x00").to_numpy(zero_copy_only=False)
        number = np.empty(len(words), np.int64)
        for some_words, encode in ((np.flatnonzero(~marked), self._words), (np.flatnonzero(marked), lambda new: self._whole([w[1:] for w in new]))):
            number[some_words] = self._numbers(self.led, [words[i] for i in some_words.tolist()], encode)
        number = number[coded.indices.to_numpy()]
        self._numbers(self.first, first, self._whole)
        number[off[:-1]] = [self.first[w] for w in flat.take(pa.array(off[:-1])).to_pylist()]
        begin, size = self.at[number], self.at[number + 1] - self.at[number]
        total = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=total[1:])
        kind = np.int32 if total[-1] + self.used < 2**31 else np.int64  # half the memory, unless a text is immense
        at = np.repeat((begin - total[:-1]).astype(kind), size)
        at += np.arange(total[-1], dtype=kind)
        ids = self.ids[at]
        del at
        ends = total[off]
        if not odd.any():
            return ends, ids
        more, sizes = self._whole(texts.filter(pa.array(odd)).to_pylist())
        rest, plain = iter(np.split(more, np.cumsum(sizes)[:-1])), iter(zip(ends[:-1], ends[1:], strict=True))
        each = [np.array(next(rest), np.int32) if o else ids[slice(*next(plain))] for o in odd]
        out = np.zeros(len(each) + 1, np.int64)
        np.cumsum([len(x) for x in each], out=out[1:])
        return out, np.concatenate(each)


_LOADED: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def _large(batches, most: int = BATCH_BYTES):
    """Batches of about ``most`` bytes of text from smaller ones."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.column(1).nbytes
        if size >= most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _dealt(rows: DataFrame, parts: int) -> DataFrame:
    """Rows by ascending ranges of doc_id, the ranges' bounds from the ids alone (numbers), so that no text is read for them."""
    if not isinstance(rows.schema["doc_id"].dataType, IntegralType):
        return rows.repartitionByRange(parts, "doc_id")
    shares = [(i + 1) / parts for i in range(parts - 1)]
    bounds = sorted(set(rows.agg(F.percentile_approx("doc_id", shares, 100 * parts)).first()[0] or [])) if shares else []
    if not bounds:
        return rows.coalesce(1) if parts == 1 else rows.repartitionByRange(parts, "doc_id")
    below = C.bounds_below(F.col("doc_id"), [int(b) for b in bounds], rows.schema["doc_id"].dataType)
    return rows.repartitionById(len(bounds) + 1, F.when(F.col("doc_id").isNull(), 0).otherwise(below).cast("int"))


def write_tokens(docs: DataFrame, out: str, vocabulary: str | None = None, end_id: int = END_ID) -> None:
    """Write doc_id, part, ordinal (row number in its part), n_tokens, ids as ORC files under ``out``, in ascending doc_id order.

    Null text counts as empty: its only id is the end id. Rows that repeat a doc_id are all written, ordered by their text's
    hash; null doc_ids come first. doc_id keeps its type. Very long texts are encoded alone. Empty input writes no rows.
    """
    spark = docs.sparkSession
    C.small_batches(spark, 1000)
    vocabulary = vocabulary or vocabulary_path()

    def run(batches):
        from pyspark import TaskContext

        e, seen, part = encoder(vocabulary), 0, TaskContext.get().partitionId()
        for batch in _large(batches):
            texts = batch.column(1).fill_null("")
            for a, b in C.ranges(pc.binary_length(texts).to_pylist(), 2 * BATCH_BYTES):
                off, ids = e.encode(texts.slice(a, b - a))
                to = off + np.arange(b - a + 1)
                with_end = np.full(to[-1], end_id, np.int32)
                with_end[np.arange(len(ids)) + np.repeat(np.arange(b - a), np.diff(off))] = ids
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(np.full(b - a, part, np.int32)),
                        pa.array(np.arange(seen, seen + b - a, dtype=np.int64)),
                        pa.array(np.diff(to).astype(np.int64)),
                        pa.ListArray.from_arrays(to.astype(np.int32), pa.array(with_end)),
                    ],
                    ["doc_id", "part", "ordinal", "n_tokens", "ids"],
                )
                seen += b - a

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    dealt = _dealt(rows, parts).withColumn("_h", F.xxhash64("text")).sortWithinPartitions("doc_id", "_h").select("doc_id", "text")
    done = dealt.mapInArrow(run, _schema(docs.schema["doc_id"].dataType))
    options = {
        "compression": "snappy",
        "orc.stripe.size": str(STRIPE_BYTES),
        "orc.create.index": "true",
        "orc.row.index.stride": str(INDEX_STRIDE),
        "orc.bloom.filter.columns": "doc_id",
        "orc.bloom.filter.fpp": "0.01",
    }
    done.write.options(**options).orc(out)


def _schema(kind: DataType) -> str:
    return f"doc_id {kind.simpleString()}, part int, ordinal long, n_tokens long, ids array<int>"


def read_tokens(spark: SparkSession, path: str, kind: DataType | None = None) -> DataFrame:
    return spark.read.schema(_schema(kind or LongType())).orc(path)


def find(spark: SparkSession, path: str, doc_ids: list) -> DataFrame:
    """The rows of some documents; the filter reaches the files' statistics and Bloom filters."""
    kind = StringType() if doc_ids and isinstance(doc_ids[0], str) else LongType()
    return read_tokens(spark, path, kind).filter(F.col("doc_id").isin(list(doc_ids)))


def digests(spark: SparkSession, path: str, kind: DataType | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every row, from the files alone."""
    C.small_batches(spark, 1000)
    files = read_tokens(spark, path, kind)
    sums = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # a row for each part

    def run(batches):
        for batch in batches:
            lists = batch.column(3)
            off = lists.offsets.to_numpy()
            raw = memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)).cast("B")
            ends = (off.astype(np.int64) * 4).tolist()
            crc = [zlib.crc32(raw[a:b]) for a, b in itertools.pairwise(ends)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(off).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "part", "ordinal", "n_tokens", "ids_crc32"])

    key = files.schema["doc_id"].dataType.simpleString()
    rows = files.select("doc_id", "part", "ordinal", "ids").mapInArrow(run, f"doc_id {key}, part int, ordinal long, n_tokens long, ids_crc32 long")
    inside = W.partitionBy("part").orderBy("ordinal").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("s", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return rows.join(sums, "part").select("doc_id", (F.col("base") + F.col("s")).alias("start"), "n_tokens", "ids_crc32")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f"{C.shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    docs = C.table(spark, sf_dir, "documents")
    write_tokens(docs, out)
    return digests(spark, out, docs.schema["doc_id"].dataType)
