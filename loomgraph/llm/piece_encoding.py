"""SentencePiece encoding and decoding (operator 8): a forward pass over a trie of words, with shared prefixes.

A text is marked as the vocabulary's normaliser does (a mark before it and for every space) and cut where no piece can reach
across: before a mark that follows another character, and around characters that no longer piece contains. The distinct marked
words of a batch are sorted, which lists their trie depth-first; the forward states of the prefix that a word shares with the
word before it are reused, and only the rest is computed.

``unigram`` vocabularies: a forward state is the best score of a prefix and its last piece (Viterbi). ``bpe`` vocabularies:
their scores are merge ranks, so the best sum of scores is not the encoding. There the same pass runs over the pieces that
may follow each other, ``a`` before ``b`` if merging their joint text gives just these two; the encoding of a prefix has a
single last piece, which is its forward state together with the sum of scores up to it. Results equal those of the public library
for either kind.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

MARK = "▁"
VOCABULARY = "piece_bpe_32k.model"
#: Bytes of words in one generation (two are kept), what a word takes beside its characters and ids, pairs that are kept.
_CACHE, _WORD, _PAIRS = 64 << 20, 250, 400_000


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Codec:
    """Encoder and decoder over the pieces of a vocabulary file."""

    def __init__(self, pieces: list[str], scores: list[float], unknown: int, bytes_: list[int], kind: str):
        self.pieces, self.kind, self.unknown = pieces, kind, unknown
        self.byte_ids = bytes_
        special = set(bytes_) | {unknown}
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        for i, (p, s) in enumerate(zip(pieces, scores, strict=True)):
            if i not in special and p and not (p.startswith("<") and p.endswith(">") and s == 0 and i < 3):
                self.ids[p] = i
                self.score[p] = s
        # All ends of pieces of more than one character: what is none of them can't be the end of a longer piece either.
        self.tails = {p[i:] for p in self.ids for i in range(len(p) - 1)}
        # Characters that occur in a piece of more than one character; words are cut around all others.
        self.inner = {c for p in self.ids if len(p) > 1 for c in p}
        self.worst = min(self.score.values(), default=0.0) - 10.0
        self.pair: dict[tuple[str, str], bool] = {}
        self.own: dict[str, bool] = {}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # the generation before; what is asked for again moves on
        self.held = 0  # bytes of the words
        self.value = {i: p.replace(MARK, " ").encode() for i, p in enumerate(pieces)}
        for b, i in enumerate(bytes_):
            self.value[i] = bytes([b])
        for i in range(min(3, len(pieces))):
            if i not in bytes_:
                self.value[i] = b" \xe2\x81\x87 " if i == unknown else b""

    @classmethod
    def load(cls, path: str) -> Codec:
        import sentencepiece

        return cls.of(sentencepiece.SentencePieceProcessor(model_file=path))

    @classmethod
    def of(cls, sp, kind: str | None = None) -> Codec:
        """The vocabulary of the library's processor; without a kind whole scores, which are merge ranks, mean ``bpe``."""
        n = sp.vocab_size()
        scores = [sp.get_score(i) for i in range(n)]
        bytes_ = [i for i in range(n) if sp.is_byte(i)]
        whole = all(float(s).is_integer() for s in scores)
        return cls([sp.id_to_piece(i) for i in range(n)], scores, sp.unk_id(), bytes_, kind or ("bpe" if whole else "unigram"))

    def merged(self, s: str) -> list[str]:
        """Merge neighbours by the best score, leftmost first: the definition of the bpe kind."""
        parts = list(s)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                x = self.score.get(parts[i] + parts[i + 1])
                if x is not None and (best is None or x > best):
                    best, at = x, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, a: str, b: str) -> bool:
        key = (a, b)
        ok = self.pair.get(key)
        if ok is None:
            if len(self.pair) >= _PAIRS:
                self.pair.clear()
            ok = self.pair[key] = self.merged(a + b) == [a, b]
        return ok

    def _states(self, word: str, last: list[str], best: list[float], shared: int) -> None:
        """Forward states of the prefixes of ``word`` that are longer than ``shared``."""
        ids, score, tails, bpe = self.ids, self.score, self.tails, self.kind == "bpe"
        del last[shared + 1 :], best[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            starts, start = [], end - 2
            while start >= 0 and (p := word[start:end]) in tails:
                if p in ids:
                    starts.append(start)
                start -= 1
            found = word[end - 1]
            if bpe:
                top = best[end - 1] + score.get(found, self.worst)
                for start in reversed(starts):
                    p = word[start:end]
                    if self._merges(p) and (start == 0 or self.follows(last[start], p)):
                        top, found = best[start] + score[p], p
                        break
                best.append(top)
            else:
                top = -math.inf  # of equally good ends the longest piece counts, as in the library
                for start in reversed(starts):
                    p = word[start:end]
                    if best[start] + score[p] > top:
                        top, found = best[start] + score[p], p
                one = best[end - 1] + score.get(word[end - 1], self.worst)
                if one > top:
                    top, found = one, word[end - 1]
                best.append(top)
            last.append(found)

    def _merges(self, p: str) -> bool:
        """Does the piece result from its own characters?"""
        ok = self.own.get(p)
        if ok is None:
            ok = self.own[p] = self.merged(p) == [p]
        return ok

    def _ids(self, pieces: list[str]) -> bytes:
        out: list[int] = []
        for p in pieces:
            i = self.ids.get(p)
            if i is not None:
                out.append(i)
            elif self.byte_ids:
                out.extend(self.byte_ids[b] for b in p.encode("utf-8", "replace"))
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return np.array(out, "<u4").tobytes()

    def _keep(self, word: str, ids: bytes) -> None:
        self.words[word] = ids
        self.held += _WORD + 2 * len(word) + len(ids)

    def learn(self, words: set[str]) -> None:
        """Encode the words that aren't known yet, in sorted order."""
        if self.held > _CACHE:
            self.older, self.words, self.held = self.words, {}, 0
        missing = words.difference(self.words)
        for w in missing & self.older.keys():
            self._keep(w, self.older[w])
        new = sorted(missing.difference(self.older))
        last, best, before = [""], [0.0], ""
        for w in new:
            k, m = 0, min(len(w), len(before))
            while k < m and w[k] == before[k]:
                k += 1
            self._states(w, last, best, k)
            pieces, at = [], len(w)
            while at:
                pieces.append(last[at])
                at -= len(last[at])
            self._keep(w, self._ids(pieces[::-1]))
            before = w

    def cut(self, text: str) -> list[str]:
        """The marked words of a text; together they are the marked text."""
        if not text:
            return []
        marked = MARK + text.replace(" ", MARK)
        return self._cutter().findall(marked)

    def _cutter(self) -> re.Pattern:
        if not hasattr(self, "_pattern"):
            inside = "".join(re.escape(c) for c in sorted(self.inner - {MARK}))
            self._pattern = re.compile(f"{MARK}+[{inside}]*|[{inside}]+|." if inside else ".", re.S)
        return self._pattern

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [self.cut(t) for t in texts]
        self.learn({w for c in cut for w in c})
        return [b"".join([self.words[w] for w in c]) for c in cut]

    def decode(self, ids: bytes) -> str:
        """The text of the ids: marks become spaces, the first one goes, byte pieces are joined."""
        value = self.value
        out = b"".join([value[i] for i in np.frombuffer(ids, "<u4").tolist()])
        return (out[1:] if out.startswith(b" ") else out).decode("utf-8", "replace")


_LOADED: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _LOADED:
        _LOADED[path] = Codec.load(path)
    return _LOADED[path]


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_chars, ids (list of integers), n_tokens, ids_crc32, round_trip: encoded, then decoded and compared.

    One row per input row. Null text counts as empty and has no ids. Very long texts are encoded whole; rows that repeat give
    repeated results; doc_id may be of any type; other columns are ignored; an empty table gives no rows. ``path`` is the
    vocabulary file on the workers.
    """
    spark = docs.sparkSession
    C.small_batches(spark, 2000)
    path = path or vocabulary_path()

    def run(batches):
        c = codec(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in C.slices(texts, 1 << 22):
                ids = c.encode(texts[a:b])
                off = np.zeros(b - a + 1, np.int32)
                np.cumsum([len(x) // 4 for x in ids], out=off[1:])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array([len(t) for t in texts[a:b]], pa.int64()),
                        pa.ListArray.from_arrays(off, pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))),
                        pa.array(np.diff(off).astype(np.int64)),
                        pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                        pa.array([c.decode(x) == t for x, t in zip(ids, texts[a:b], strict=True)], pa.bool_()),
                    ],
                    ["doc_id", "n_chars", "ids", "n_tokens", "ids_crc32", "round_trip"],
                )

    key = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {key}, n_chars long, ids array<int>, n_tokens long, ids_crc32 long, round_trip boolean"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def decoded(rows: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text of rows of doc_id, ids. Null ids give a null text."""
    spark = rows.sparkSession
    C.small_batches(spark, 500)
    path = path or vocabulary_path()

    def run(batches):
        c = codec(path)
        for batch in batches:
            out = [None if x is None else c.decode(np.array(x, "<u4").tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: each document's ids and counts instead of its text; nulls, long texts, ties and empty tables as in ``encoded``."""
    return encoded(docs)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(C.table(spark, sf_dir, "documents")).drop("ids")
