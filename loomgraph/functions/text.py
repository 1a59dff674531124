"""Scalar functions on columns: names, relations, types, paths, tokens, snippets, vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab as V


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in sorted(pairs.items()) for x in kv])


def canonical_relation(raw: Column) -> Column:
    return F.coalesce(_map(V.RELATION_MAP)[F.lower(F.trim(raw))], F.lit(V.RELATION_DEFAULT))


def causal_relation(raw: Column) -> Column:
    """The path search's own spelling of relations: a small map, else blanks to underscores."""
    low = F.lower(F.trim(raw))
    return F.coalesce(_map(V.CAUSAL_SPELLING)[low], F.replace(low, F.lit(" "), F.lit("_")))


def canonical_type(raw: Column) -> Column:
    return F.coalesce(_map(V.TYPE_MAP)[F.lower(F.trim(raw))], F.lit(V.TYPE_DEFAULT))


def normal_name(name: Column) -> Column:
    """Lower case, underscores and separating hyphens to blanks; ``b-tree`` and ``t-cell`` keep theirs."""
    low = F.replace(F.lower(name), F.lit("_"), F.lit(" "))
    return F.trim(F.regexp_replace(F.regexp_replace(low, r"(?<=[a-z0-9]{2})-(?=[a-z]{3})", " "), r"\s+", " "))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"\.md$", "")


def domain(path: Column) -> Column:
    """What stands before ``--`` in the file's name; null without one."""
    s = stem(path)
    return F.when(F.contains(s, F.lit("--")), F.get(F.split(s, "--"), F.lit(0)))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def content_hash(text: Column) -> Column:
    return F.left(F.sha2(text.cast("binary"), 256), F.lit(16))


def overlapping_count(text: Column, term: str) -> Column:
    """Occurrences of a term, overlapping ones too; a term that can't overlap itself needs no regular expression."""
    if any(term[:k] == term[-k:] for k in range(1, len(term))):
        quoted = "".join("\\" + c if not c.isalnum() and ord(c) < 128 and c != "_" else c for c in term)
        return F.regexp_count(text, F.lit(f"(?={quoted})"))
    return ((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / len(term)).cast("int")


def keyword_score(query: str, path: Column) -> Column:
    """Share of the query's words that are in the path, or share a beginning of four or five letters with one of its words."""
    words = query.lower().split()
    low = F.lower(path)
    parts = F.filter(F.split(low, r"[/\-_. ]+"), lambda w: w != "")

    def fits(word: str) -> Column:
        def near(p):
            k = F.least(F.lit(len(word)), F.length(p), F.lit(5))
            return (k >= 4) & (F.left(p, k) == F.left(F.lit(word), k))

        return F.when(F.contains(low, F.lit(word)) | F.exists(parts, near), 1).otherwise(0)

    if not words:
        return F.lit(0.0)
    return sum((fits(w) for w in words), F.lit(0)) / F.lit(float(len(words)))


def snippet(text: Column, summary: Column, words: list[str], width: int = 400, step: int = 100) -> Column:
    """The window with the most query words, the first of equally good ones; short texts are cut, no hit gives the summary."""
    body = F.regexp_replace(text, r"(?s)^---\n.*?\n---\n?", "")
    # Pieces of ``step`` characters are cut once; a window is some pieces in a row. The one-element array binds them to a name.
    pieces = F.regexp_extract_all(F.lower(body), F.lit(f"(?s).{{1,{step}}}"), F.lit(0))

    def best_of(cut):
        def hits(i):
            piece = F.array_join(F.slice(cut, i + 1, width // step), "")
            n = sum((F.when(F.contains(piece, F.lit(w)), 1).otherwise(0) for w in words), F.lit(0))
            return F.struct(n.alias("n"), (-step * i).alias("at"))

        last = F.floor(F.greatest(F.lit(0), F.length(body) - width) / step).cast("int")
        return F.array_max(F.transform(F.sequence(F.lit(0), last), hits))

    best = F.transform(F.array(pieces), best_of)[0]
    window = F.substring(body, (1 - best["at"]).cast("int"), F.lit(width))
    none = F.coalesce(F.when(F.length(summary) > 0, summary), F.left(body, F.lit(width)))
    return F.when(F.length(body) <= 500, F.left(body, F.lit(width))).when(best["n"] > 0, window).otherwise(none)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def normal_word(word: Column) -> Column:
    """A word without apostrophes, adverb endings and plural."""
    w = F.regexp_replace(F.lower(word), "['’]", "")
    n = F.length(w)
    cut = lambda c, k: F.substring(c, F.lit(1), F.length(c) - k)
    w = (
        F.when(w.endswith("ily") & (n > 5), F.concat(cut(w, 3), F.lit("y")))
        .when(w.endswith("ally") & (n > 6), F.concat(cut(w, 4), F.lit("al")))
        .when(w.endswith("ly") & (n > 4), cut(w, 2))
        .otherwise(w)
    )
    m = F.length(w)
    return F.when(w.endswith("ies") & (m > 4), F.concat(cut(w, 3), F.lit("y"))).when(w.endswith("s") & (m > 4) & ~w.endswith("ss"), cut(w, 1)).otherwise(w)


def normal_phrase(name: Column) -> Column:
    return F.array_join(F.transform(F.split(F.trim(name), r"\s+"), normal_word), " ")


def long_words(name: Column, more_than: int = 2) -> Column:
    return F.array_distinct(F.filter(F.split(name, r"\s+"), lambda w: F.length(w) > more_than))


def overlap(a: Column, b: Column) -> Column:
    """Shared words over the smaller set's words; 0 if either has none."""
    small = F.least(F.size(a), F.size(b))
    return F.when(small > 0, F.size(F.array_intersect(a, b)) / small).otherwise(F.lit(0.0))


# --- urls ---

# Patterns and reasons of skipped and doubtful urls.
_ARXIV = r"(?i)arxiv\.org/(?:abs|html|pdf|src)/(\d{4}\.\d{4,5}(?:v\d+)?)"


def url_skip_reason(url: Column) -> Column:
    """Why a url is not fetched: its scheme or a local host; null if it is."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))
    return (
        F.when(scheme.isin("file", "mailto", "ftp"), F.concat(F.lit("skipped ("), scheme, F.lit(":// scheme)")))
        .when(~scheme.startswith("http"), F.concat(F.lit("skipped (non-http scheme: "), scheme, F.lit(")")))
        .when(host.isin("localhost", "127.0.0.1", "0.0.0.0"), F.concat(F.lit("skipped (local address: "), host, F.lit(")")))
    )


def url_doubt(url: Column, last_year: int = 26) -> Column:
    """Why a url looks invented; null if it doesn't."""
    paper = F.regexp_extract(url, _ARXIV, 1)
    month, year = F.substring(paper, 3, 2).try_cast("int"), F.substring(paper, 1, 2).try_cast("int")
    return (
        F.when(url.rlike(r"(?i)example\.com|placeholder|your-?url|INSERT|FIXME|TODO|<[^>]+>"), "URL contains placeholder text")
        .when(url.rlike(r"/(?:0{6,}|1234567890|9876543210)(?:[/?#]|$)"), "URL contains suspiciously round/sequential ID")
        .when(url.rlike(r"(?i)arxiv\.org") & (paper == ""), "arxiv URL missing valid YYMM.NNNNN ID")
        .when((paper != "") & ~month.between(1, 12), F.concat(F.lit("arxiv ID has invalid month: "), paper))
        .when((paper != "") & (year > last_year), F.concat(F.lit("arxiv ID year "), year.cast("string"), F.lit(" is in the future: "), paper))
        .when(url.rlike(r"(?i)doi\.org/(?:10\.(?:XXXX|0000|1234)\b|.*placeholder|.*example)"), "DOI URL contains placeholder publisher code")
    )
