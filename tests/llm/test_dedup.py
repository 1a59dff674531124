"""Operators 2 and 10 and the pipeline against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from loomgraph.llm import decontaminate, language_id, near_dedup, pii, piece_encoding, suffix_dedup
from test_text_operators import brute_hits


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


# --- 2 ---


def brute_repeats(rows, length=suffix_dedup.LENGTH):
    raw = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(b[i : i + length] for _, b in raw for i in range(len(b) - length + 1))
    for d, b in raw:
        gone = np.zeros(len(b) + 1, np.int64)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i] += 1
                if i + length < len(gone):
                    gone[i + length] -= 1
        gone = np.cumsum(gone)[: len(b)] > 0
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        yield d, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()


def repeats(rng):
    word = lambda: "".join(rng.choices("abcdeéñ日", k=rng.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    a, b, c = text(90), text(300), text(75)
    rows = [
        a + text(20), text(20) + a, text(10) + a + text(10) + a, b, b, b + "x", "x" + b[:-7], b[50:900] + c + b[300:1200],
        "ab" * 1500, "ab" * 250 + text(50), "z" * 399, "z" * 399, "q" * 400, "q" * 400, "y" * 401, c + c, c[:-1], text(50), "", None,
        a[:399], "-" * 5000, text(5) + "-" * 450, text(30) + c + text(30),
    ]
    return list(enumerate(rows)) + [(3, b), (None, a)]


@pytest.mark.parametrize("seed", [1, 2])
def test_repeated_strings(spark, seed):
    rows = repeats(random.Random(seed))
    got = [tuple(r) for r in suffix_dedup.dedup(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(brute_repeats(rows), key=str)


def test_repeated_strings_by_windows_and_files(spark, monkeypatch):
    rows = repeats(random.Random(3))
    want = sorted(brute_repeats(rows), key=str)
    monkeypatch.setattr(suffix_dedup, "HOT_BYTES", 0)
    assert sorted((tuple(r) for r in suffix_dedup.dedup(frame(spark, rows)).collect()), key=str) == want


def test_construction_is_the_suffix_order():
    rng = random.Random(5)
    for in_memory in (0, 1 << 30):
        docs = [[rng.randint(1, 3) for _ in range(rng.randint(0, 12))] for _ in range(9)]
        off = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
        doc, size, lcp = suffix_dedup.ordered(np.array([x for d in docs for x in d], np.int64), off, in_memory)
        suffixes = [docs[d][len(docs[d]) - n :] for d, n in zip(doc, size, strict=True)]
        assert len(suffixes) == sum(len(d) + 1 for d in docs)
        assert all(x <= y for x, y in zip(suffixes, suffixes[1:]))
        for i in range(1, len(suffixes)):
            k, x, y = 0, suffixes[i - 1], suffixes[i]
            while k < min(len(x), len(y)) and x[k] == y[k]:
                k += 1
            assert lcp[i] == k


# --- 10 ---


def brute_components(rows, width, percent=80):
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    up = {d: d for d in sets}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return sorted((d, len(sets[d]), root(d), root(d) == d) for d in ids)


def copies(rng):
    rows = ["", None, "  \t", "one", "ONE", "one two", "One  two", "ÉTÉ x", "été x"]
    for _ in range(6):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(30, 120))]
        for _ in range(9):  # chains of ever more edits, around the threshold
            base = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 16))):
                base[rng.randrange(len(base))] = f"v{rng.randint(0, 9999)}"
            rows.append(" ".join(base))
    return list(enumerate(rows))


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(spark, width):
    rows = copies(random.Random(width))
    got = sorted(tuple(r) for r in near_dedup.near_duplicates(frame(spark, rows), width=width).collect())
    assert got == brute_components(rows, width)


def test_what_buckets_leave_apart_is_compared(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_ITEMS", 100)
    rows = copies(random.Random(8))
    got = sorted(tuple(r) for r in near_dedup.near_duplicates(frame(spark, rows), width=2).collect())
    assert got == brute_components(rows, 2)


def test_sketch_agrees_as_often_as_the_sets_overlap():
    rng = np.random.default_rng(2)
    for overlap in (0, 30, 100, 400):
        a = rng.integers(0, 2**63, 500, np.uint64)
        b = np.concatenate([a[:overlap], rng.integers(0, 2**63, 500 - overlap, np.uint64)])
        s = near_dedup.sketches([np.unique(a), np.unique(b), np.unique(a[:3]), a[:0]], 512)
        full = np.uint64(2**64 - 1)
        assert (s[:3] != full).all() and (s[3] == full).all()
        assert abs((s[0] == s[1]).mean() - overlap / (1000 - overlap)) < 0.08


# --- pipeline ---


def test_pipeline_equals_its_operators_one_after_another(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = {r["doc_id"]: r["ids_crc32"] for r in corpus_pipeline.run(spark, data).collect()}
    rows = {r["doc_id"]: (r["text"], r["lang"]) for r in docs.collect()}
    refused = {r["doc_id"] for r in language_id.identify(docs).collect() if r["rejected"]}
    left = {d: t for d, (t, _) in rows.items() if d not in refused}
    left = {d: left[d] for d, _, _, kept in brute_components(left.items(), 5) if kept}
    bench = spark.read.parquet(f"{data}/benchmark.parquet")
    out = {r[0] for r in brute_hits([(d, t) for d, (t, _) in rows.items()], [tuple(r) for r in bench.select("item_id", "text").collect()]) if r[3]}
    assert out & set(left)
    left = {d: t for d, t in left.items() if d not in out}
    assert set(got) == set(left) and len(left) < len(rows)
    masked = {r["doc_id"]: r["text"] for r in pii.stage(spark, frame(spark, list(left.items())), data).collect()}
    ids = {r["doc_id"]: r["ids_crc32"] for r in piece_encoding.encoded(frame(spark, list(masked.items()))).collect()}
    assert got == ids
    assert sum(masked[d] != left[d] for d in left) > 0


def test_a_passage_of_one_benchmark_item_does_not_pass_the_pipeline(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    bench = spark.read.parquet(f"{data}/benchmark.parquet")
    passage = max((r["text"] for r in bench.collect()), key=len)
    planted = spark.createDataFrame([(900001, f"Before it stands this. {passage} And this comes after it."), (900002, "Nothing of a benchmark stands in this one.")], "doc_id long, text string")
    rows = docs.select("doc_id", "text").unionByName(planted)
    hit = {r["doc_id"]: r["n_items"] for r in decontaminate.contamination(rows, bench).collect() if r["n_items"]}
    assert hit[900001] == 1 and len(hit) > 1
    left = {r["doc_id"] for r in decontaminate.stage(spark, rows, data).collect()}
    assert left == {r["doc_id"] for r in rows.select("doc_id").collect()} - set(hit)
    assert not set(hit) & {r["doc_id"] for r in corpus_pipeline.run(spark, data).collect()}


def test_unknown_scripts_are_rejected(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang")
    more = spark.createDataFrame([(100001, "これは日本語の文章です。とても長い文章ではありません。" * 3, None), (100002, "Это текст на русском языке, который никто не учил. " * 3, None)], docs.schema)
    got = {r["doc_id"]: r for r in language_id.identify(docs.unionByName(more)).collect()}
    assert got[100001]["rejected"] and got[100002]["rejected"]
    assert sum(r["rejected"] for r in got.values()) <= 2 + 0.01 * len(got)
