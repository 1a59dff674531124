"""Nulls, empty and long texts, ties, repeated rows, empty tables and extra columns: every operator and every stage."""

import pytest

import corpus_pipeline
from loomgraph.llm import decontaminate, fingerprints, language_id, main_text, near_dedup, pii, piece_encoding, suffix_dedup, token_files, url_filter

KIND = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, kept boolean, spans string, a int"
LONG = " ".join(f"word{i % 977} of the long text number {i // 977}" for i in range(20_000))
ROWS = [
    (1, "The cat sat on the mat and looked at the moon for a long time.", "en", "web", 10, 0.5, "k", True, "s", 1),
    (1, "The cat sat on the mat and looked at the moon for a long time.", "en", "web", 10, 0.5, "k", True, "s", 1),
    (2, None, None, None, None, None, None, None, None, None),
    (3, "", "en", "", 0, 0.0, "", False, "", 0),
    (None, "No id here, but there is a text that says so.", "en", None, None, None, None, None, None, None),
    (None, None, None, None, None, None, None, None, None, None),
    (4, LONG, "en", "web", len(LONG), 0.1, "k", True, "s", 2),
    (5, LONG, None, "web", len(LONG), 0.1, "k", True, "s", 2),
    (6, "!!! ... 12 ?", "fr", "x", 3, 1.0, "k", False, "s", 3),
    (7, "    \t \r\n", "en", "x", 3, 1.0, "k", False, "s", 3),
]
OPERATORS = {
    "language_id": language_id.identify,
    "suffix_dedup": suffix_dedup.dedup,
    "fingerprints": fingerprints.fingerprints,
    "pii": lambda d: pii.digest(pii.personal_spans(d)),
    "piece_encoding": piece_encoding.encoded,
    "near_dedup": near_dedup.near_duplicates,
}


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, KIND)


@pytest.mark.parametrize("name", OPERATORS)
def test_operator_returns_a_row_for_each_row(rows, name):
    got = OPERATORS[name](rows)
    assert sorted((r["doc_id"] for r in got.collect()), key=str) == sorted((r[0] for r in ROWS), key=str)
    assert OPERATORS[name](rows.limit(0)).count() == 0


def test_decontamination_and_tokens(spark, rows, tmp_path):
    bench = spark.createDataFrame([(1, "the moon for a long time"), (2, None), (3, "cat sat"), (3, "cat sat")], "item_id long, text string")
    got = decontaminate.contamination(rows, bench)
    found = got.collect()
    assert len(found) == len(ROWS) and all(r["n_items"] == 2 and r["contaminated"] for r in found if r["doc_id"] == 1)
    out = f"file://{tmp_path}/t"
    token_files.write_tokens(rows, out)
    back = token_files.digests(spark, out).collect()
    assert len(back) == len(ROWS) and min(r["n_tokens"] for r in back) == 1
    at = 0
    for r in sorted(back, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]


def test_pages(spark):
    pages = spark.createDataFrame([(1, None, None, 1), (1, "http://a.b/c", "<p>x", 2), (None, "", "", 3)], "page_id long, url string, html string, score int")
    assert main_text.main_texts(pages).count() == url_filter.judge(pages).count() == 3
    assert main_text.main_texts(pages.limit(0)).count() == url_filter.judge(pages.limit(0)).count() == 0


@pytest.mark.parametrize("k", range(5))
def test_stages(spark, rows, data, k):
    name, stage = corpus_pipeline.STAGES[k]
    got = stage(spark, rows, data)
    if k < 4:
        assert got.columns == rows.columns and [f.dataType for f in got.schema] == [f.dataType for f in rows.schema]
    n = {"language_id": None, "near_dedup": 8, "decontamination": 10, "pii": 10, "piece_encoding": 10}[name]
    if n:
        assert got.count() == n
    assert stage(spark, rows.limit(0), data).count() == 0


NAMES = ["_id", "_key", "_kept_id", "_spans", "_h", "row", "row_id", "id", "spans", "hits", "text_key", "place", "own", "a.b"]


@pytest.mark.parametrize("k", range(4))
def test_stages_with_clashing_names_and_ids_of_text(spark, data, k):
    docs = spark.createDataFrame([(f"d{r[0]}", r[1], r[2], *range(len(NAMES))) for r in ROWS[:4]], "doc_id string, text string, lang string, " + ", ".join(f"`{n}` int" for n in NAMES))
    got = corpus_pipeline.STAGES[k][1](spark, docs, data)
    assert got.columns == docs.columns and 0 < got.count() <= 4


def test_operators_with_ids_of_text(spark, tmp_path):
    docs = spark.createDataFrame([(f"d{i % 7}", t) for i, t in enumerate(["One two three, mail a@b.org.", None, "", "x y " * 300, "x y " * 300] * 3)], "doc_id string, text string")
    for name, op in OPERATORS.items():
        if name != "language_id":
            assert sorted(r["doc_id"] for r in op(docs).collect()) == sorted(r["doc_id"] for r in docs.collect()), name
    token_files.write_tokens(docs, f"file://{tmp_path}/s")
    assert token_files.digests(spark, f"file://{tmp_path}/s", docs.schema["doc_id"].dataType).count() == 15
    assert token_files.find(spark, f"file://{tmp_path}/s", ["d3"]).count() == 2


def test_many_matches_in_one_text(spark):
    n = 20_000
    docs = spark.createDataFrame([(1, "mail a1@b.org, card 4111 1111 1111 1111 or 123-45-6789; " * n)], "doc_id long, text string")
    got = pii.digest(pii.personal_spans(docs)).first()
    assert (got["n_email"], got["n_card"]) == (n, n)
    assert pii.stage(spark, docs, "").first()["text"].count("[EMAIL]") == n


def test_one_repeated_labelled_row_does_not_fill_the_sample(spark):
    docs = spark.createDataFrame([(1, f"text {i % 3}", "en") for i in range(900)] + [(2, "un texte", "fr")], "doc_id long, text string, lang string")
    assert {r["lang"]: r["count"] for r in language_id.sample(docs, 50).groupBy("lang").count().collect()} == {"en": 50, "fr": 1}


def test_the_first_text_of_a_repeated_id_stays(spark):
    docs = spark.createDataFrame([(1, f"text number {i} of many that are all different in words {i * 7}") for i in range(20)], "doc_id long, text string")
    kept = {near_dedup.stage(spark, docs.repartition(k, "text"), "").first()["text"] for k in (1, 3)}
    assert len(kept) == 1
