"""URL filters (operator 4): explicit rules first, then gradient-boosted trees on lexical features.

Features: lengths of url, host and path, depth, labels, digit ratio, hyphens, character entropy, parameter counts, and statistics
of suffixes: how often urls under the same host suffix or with the same host words are unwanted among the labelled ones. The
trees are grown here, in numpy, on labelled urls: a table of one's own, of which at most ``MOST_LABELLED`` rows are used, or made
ones (``seed_urls``) where there is none. Labels never come from the rules.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
MOST_LABELLED, LONGEST, TREES, DEPTH, RATE = 20_000, 4000, 80, 4, 0.2
FEATURES = ("length", "host_length", "path_length", "labels", "depth", "digit_ratio", "host_digits", "hyphens", "entropy", "host_entropy", "params", "query_length", "suffix_rate", "word_rate", "scheme")


def host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; empty if there is none."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return C.ascii_lower(rest)


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host_: Column, path_: Column, rules=RULES) -> Column:
    """The longest rule that fits (of equally long ones the first by name), as struct(rule, verdict), or null."""
    found = []
    for text, verdict in rules:
        h, slash, p = text.partition("/")
        fits = ((host_ == h) | host_.endswith("." + h)) & path_.startswith(slash + p)
        found.append(F.when(fits, F.struct(F.lit(-len(text)).alias("k"), F.lit(text).alias("rule"), F.lit(verdict).alias("verdict"))))
    if not found:
        return F.lit(None).cast("struct<k:int,rule:string,verdict:string>")
    return F.array_min(F.array_compact(F.array(*found)))


_PARTS = re.compile(r"^(.*?)://([^/?#]*)([^?#]*)(?:\?([^#]*))?", re.S)


def parts(url: str | None) -> tuple[str, str, str, str]:
    m = _PARTS.match(url or "")
    return (m[1].lower(), m[2].lower(), m[3], m[4] or "") if m else ("", "", "", "")


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def suffixes(host_: str) -> list[str]:
    labels = host_.split(".")
    return [".".join(labels[i:]) for i in range(len(labels))]


def host_words(host_: str) -> list[str]:
    return [w for w in re.split(r"[^a-z]+", host_.rpartition(".")[0]) if len(w) > 1 and w != "www"]


class Statistics:
    """Smoothed rates of unwanted urls by host suffix and by word of the host."""

    def __init__(self, urls: list[str], labels: list[int]):
        self.prior = (sum(labels) + 1) / (len(labels) + 2)
        self.rate: dict[str, tuple[float, int]] = {}
        sums: dict[str, list[int]] = {}
        for u, y in zip(urls, labels, strict=True):
            h = parts(u)[1]
            for k in {"s:" + s for s in suffixes(h)} | {"w:" + w for w in host_words(h)}:
                t = sums.setdefault(k, [0, 0])
                t[0] += y
                t[1] += 1
        self.rate = {k: ((a + 4 * self.prior) / (n + 4), n) for k, (a, n) in sums.items() if n >= 3}

    def suffix(self, h: str) -> float:
        for s in suffixes(h):
            if "s:" + s in self.rate:
                return self.rate["s:" + s][0]
        return self.prior

    def words(self, h: str) -> float:
        found = [self.rate["w:" + w][0] for w in host_words(h) if "w:" + w in self.rate]
        return max(found) if found else self.prior


def features(url: str | None, stats: Statistics) -> list[float]:
    scheme, h, p, q = parts(url)
    u = url or ""
    return [
        len(u), len(h), len(p), h.count(".") + 1 if h else 0, len([x for x in p.split("/") if x]),
        sum(c.isdigit() for c in u) / max(1, len(u)), sum(c.isdigit() for c in h), h.count("-"),
        _entropy(u), _entropy(h), q.count("&") + 1 if q else 0, len(q), stats.suffix(h), stats.words(h), float(scheme == "https"),
    ]


class Trees:
    """Gradient boosting of the logistic loss with regression trees on quantile bins."""

    def __init__(self):
        self.base, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Trees:
        mean = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.base = math.log(mean / (1 - mean))
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.02, 0.98, 33))) for j in range(x.shape[1])]
        bins = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
        f = np.full(len(y), self.base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p) + 1e-9
            tree: list[tuple] = []
            self._grow(tree, bins, cuts, g, h, np.arange(len(y)), depth, rate)
            self.trees.append(tree)
            f += self._one(tree, x)
        return self

    def _grow(self, tree, bins, cuts, g, h, at, depth, rate) -> int:
        me = len(tree)
        tree.append(())
        total_g, total_h = g[at].sum(), h[at].sum()
        best, split = 1e-6, None
        if depth and len(at) >= 10:
            for j, c in enumerate(cuts):
                gs = np.bincount(bins[at, j], g[at], len(c) + 1).cumsum()[:-1]
                hs = np.bincount(bins[at, j], h[at], len(c) + 1).cumsum()[:-1]
                gain = gs**2 / (hs + 1) + (total_g - gs) ** 2 / (total_h - hs + 1) - total_g**2 / (total_h + 1)
                gain[(hs < 0.5) | (total_h - hs < 0.5)] = 0
                if len(gain) and gain.max() > best:
                    best, split = gain.max(), (j, int(gain.argmax()))
        if split is None:
            tree[me] = (-1, rate * total_g / (total_h + 1), 0, 0)
            return me
        j, k = split
        left = bins[at, j] <= k
        a = self._grow(tree, bins, cuts, g, h, at[left], depth - 1, rate)
        b = self._grow(tree, bins, cuts, g, h, at[~left], depth - 1, rate)
        tree[me] = (j, float(cuts[j][k]), a, b)
        return me

    @staticmethod
    def _one(tree, x: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(x)), [(0, np.arange(len(x)))]
        while todo:
            n, at = todo.pop()
            j, v, a, b = tree[n]
            if j < 0:
                out[at] = v
            elif len(at):
                left = x[at, j] <= v
                todo += [(a, at[left]), (b, at[~left])]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.base + sum(self._one(t, x) for t in self.trees)))) if len(x) else np.zeros(0)


# Words of made urls: ordinary sites, and kinds of sites that filters for training data leave out.
_GOOD = "news blog docs wiki library museum school city garden kitchen travel science history music weather journal forum recipes sports books archive research health atlas review market street bridge river advice".split()
_BAD = "casino win bets bet free cheap pills pill spam farm adult xxx porn ads track tracker poker slots lottery bonus loan payday viagra crypto hack crack warez torrent click popup escort dating replica seo".split()
_SYLLABLES = "th er in on an re ti es or ha st en ou nd le ma ke ro sa la".split()


def seed_urls(n: int = 2400, seed: int = 11) -> tuple[list[str], list[int]]:
    """Labelled urls, made up where no labelled table is at hand: ordinary (0) and unwanted (1).

    Unwanted are hosts of certain words and, apart from words, hosts of digits and hyphens with long queries. Ordinary ones are
    words and syllables, public suffixes (gov, edu, ac) whatever the words, and what is no absolute url.
    """
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices(_SYLLABLES, k=rng.randint(1, 4)))
    code = lambda k: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=k))
    query = lambda k: "?" + "&".join(f"{rng.choice([word(), code(2)])}={rng.choice([str(rng.randint(1, 10**9)), code(12)])}" for _ in range(k))
    urls, labels = [], []
    for i in range(n):
        y = i % 2
        scheme, sub = rng.choice(["http", "https"]), rng.choice(["", "", "www.", "m.", "blog."])
        tail = rng.choice(["", "/", f"/{word()}", f"/{word()}/{rng.randint(1, 99999)}", f"/{word()}/{word()}/{word()}", f"/{word()}.html"])
        q = rng.choice(["", "", "", query(1), query(2), "#" + word()])
        top = rng.choice(["com", "org", "net", "info", "co.uk", "de", "fr"])
        kind = rng.random()
        if y and kind < 0.6:
            name = "-".join([*rng.sample(_BAD, rng.randint(1, 2)), *([code(2)] if rng.random() < 0.2 else [])])
            q = query(rng.randint(3, 7)) if rng.random() < 0.3 else q
        elif y:
            name = "-".join([code(rng.randint(4, 9)), str(rng.randint(100, 99999))][: rng.randint(1, 2)]) + str(rng.randint(10, 9999))
            top, q = rng.choice([top, "biz", "top", "xyz"]), query(rng.randint(3, 8)) if rng.random() < 0.8 else q
        elif kind < 0.15:
            name, top = f"{rng.choice(_GOOD + _BAD)}-{rng.choice(_GOOD)}", rng.choice(["gov", "gov.uk", "edu", "ac.uk"])
        elif kind < 0.2:
            urls.append(rng.choice(["", f"/{word()}/{word()}", f"mailto:{word()}", f"{word()} {word()}"]))
            labels.append(0)
            continue
        else:
            name = rng.choice([word(), word(), rng.choice(_GOOD), f"{rng.choice(_GOOD)}-{word()}", f"{word()}-{word()}", word() + rng.choice(_GOOD), word() + str(rng.randint(1, 9))])
        name += "." + rng.choice([word(), rng.choice(_GOOD)]) if rng.random() < 0.3 else ""
        urls.append(f"{scheme}://{sub}{name}.{top}{tail}{q}")
        labels.append(y)
    return urls, labels


def sample(labelled: DataFrame, most: int = MOST_LABELLED) -> tuple[list[str], list[int]]:
    """At most ``most`` rows (url, label) of a table, those with the least hashes of the url; urls over ``LONGEST`` characters and nulls teach nothing."""
    known = labelled.select(F.col("url").cast("string").alias("url"), F.col("label").cast("int").alias("label")).filter(F.col("url").isNotNull() & F.col("label").isin(0, 1) & (F.length("url") <= LONGEST))
    rows = known.orderBy(F.xxhash64("url"), "url", "label").limit(most).collect()
    return [r["url"] for r in rows], [r["label"] for r in rows]


def fitted(urls: list[str], labels: list[int]) -> tuple[Statistics, Trees]:
    urls, labels = urls[:MOST_LABELLED], labels[:MOST_LABELLED]
    if not urls:
        return Statistics([], []), Trees()
    half = len(urls) // 2
    # Each half's suffix statistics come from the other half, as a url must not vouch for itself.
    a, b = Statistics(urls[half:], labels[half:]), Statistics(urls[:half], labels[:half])
    x = np.array([features(u, a) for u in urls[:half]] + [features(u, b) for u in urls[half:]])
    return Statistics(urls, labels), Trees().fit(x, np.array(labels, float))


def judge(pages: DataFrame, rules=RULES, labelled: DataFrame | tuple[list[str], list[int]] | None = None, least: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, score of every row: the longest rule decides, else the trees (block from ``least``).

    ``labelled``: a table of urls with labels 0 and 1, or lists of them; else ``seed_urls``. A null url or one without ``://`` has an
    empty host and path, so that no rule fits it; the trees judge it by what it is. Urls of any length are read whole. Repeated rows
    are judged alike; page_id may be of any type; other columns are ignored. Empty input gives no rows.
    """
    spark = pages.sparkSession
    C.small_batches(spark, 10_000)
    given = sample(labelled) if isinstance(labelled, DataFrame) else labelled or seed_urls()
    sent = spark.sparkContext.broadcast(fitted(*given))

    def run(batches):
        stats, trees = sent.value
        for batch in batches:
            x = np.array([features(u, stats) for u in batch.column(1).to_pylist()], float).reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(trees.score(x), pa.float64())], ["page_id", "url", "score"])

    kind = pages.schema["page_id"].dataType.simpleString()
    scored = pages.select("page_id", F.col("url").cast("string").alias("url")).mapInArrow(run, f"page_id {kind}, url string, score double")
    parted = scored.select("page_id", "score", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    ruled = parted.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce("r.verdict", F.when(F.col("score") >= least, "block").otherwise("allow"))
    return ruled.select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), "score")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(C.table(spark, sf_dir, "pages"))
