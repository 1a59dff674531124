r"""PII (operator 6), in DataFrame functions only: weak labelers, expectation-maximisation, a span classifier.

Candidates are the four base kinds (email, ip, card, phone) and three wider ones (ssn, tel, iban). Five labelers vote on each
candidate: strict form, gazetteer, context words, boundary and variety of digits. What leaves the executors for the fit is the
count of each vote pattern: at most 7 * 3**5 rows, whatever the input. On these counts expectation-maximisation estimates the
labelers' reliabilities, and a logistic span classifier is trained on its posteriors. Base spans always stay; spans of the
wider kinds are added where the classifier accepts them and no base span overlaps.

The patterns are those of the contract, rewritten so that the search is linear: a match can only begin at the start of a
run of its first class or right after the match before, and runs are taken possessively.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

BASE = ("email", "ip", "card", "phone")
WIDE = ("ssn", "tel", "iban")
KINDS = BASE + WIDE
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
PATTERN = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "tel": r"(?<![0-9A-Za-z+(.-])(?:\([2-9][0-9]{2}\)\x20?|[2-9][0-9]{2}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
}
_NEED = {"email": "@", "phone": "+", "ssn": "-"}
SPAN = "struct<kind:string,start:int,end:int,m:string,before:string,after:string>"
_WORDS = {
    "for": r"(?i)(?:mail|contact|phone|tel\b|call|fax|mobile|card|visa|credit|pay|\bip\b|host|server|address|ssn|social|iban|account|konto|compte|cuenta)",
    "against": r"(?i)(?:version|\bv\.?\s*$|order|isbn|issn|\bno\.?\s*$|#\s*$|page|total|password|\bid\b|part|sku|build)",
}


def _luhn(m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    n = F.length(digits)

    def add(acc, i):
        d = F.substring(digits, (n - i).cast("int"), F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return (F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10) == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return _luhn(m)
    if kind == "phone":
        return F.length(F.regexp_replace(m, "[^0-9]", "")).between(8, 15)
    return F.lit(True)


def _with(value: Column, f) -> Column:
    """``f`` of a value that is computed once: a lambda's body would compute an outer expression again for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _blocks(a: Column, size: Column) -> Column:
    """An array cut into arrays of ``size``; both have to be bound names."""
    some = F.transform(F.sequence(F.lit(1), F.size(a), size), lambda i: F.slice(a, i, size))
    return F.when(F.size(a) > 0, some).otherwise(F.array())


def _root(n: Column) -> Column:
    return F.greatest(F.lit(16), F.ceil(F.sqrt(n.cast("double"))).cast("int"))


def _sums(steps: Column) -> Column:
    """Running sums of an array of integers, each with its own element. Folds copy what they have gathered, so they go by blocks of
    the root of the length: n to the power of 1.5 altogether, where one fold is quadratic."""
    none = F.array().cast("array<int>")

    def gathered(first: Column, a: Column) -> Column:
        begin = F.struct(first.alias("at"), none.alias("out"))
        step = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"] + x)).alias("out"))
        return F.aggregate(a, begin, step)["out"]

    def by_blocks(blocks: Column) -> Column:
        whole = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda acc, x: acc + x))
        ends = gathered(F.lit(0), whole)
        return _with(ends, lambda e: F.flatten(F.transform(blocks, lambda b, i: gathered(F.when(i > 0, F.get(e, i - 1)).otherwise(F.lit(0)), b))))

    return _with(steps, lambda a: _with(_blocks(a, _root(F.size(a))), by_blocks))


def _matches(text: Column, kind: str) -> Column:
    """Valid matches of a kind with code-point offsets: what lies between the matches gives the places."""
    empty = F.array().cast(f"array<{SPAN}>")

    def spans(gaps: Column, found: Column) -> Column:
        def one(i: Column, ends: Column) -> Column:
            m = F.get(found, i)
            return F.struct(F.lit(kind).alias("kind"), (F.get(ends, i) - F.length(m)).alias("start"), F.get(ends, i).alias("end"), m.alias("m"), F.right(F.get(gaps, i), F.lit(24)).alias("before"), F.left(F.get(gaps, i + 1), F.lit(8)).alias("after"))

        steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.length(g) + F.length(m))
        return _with(_sums(steps), lambda ends: F.transform(F.sequence(F.lit(0), F.size(found) - 1), lambda i: one(i, ends)))

    def some(both: Column) -> Column:
        all_ = spans(both["gaps"], both["found"])
        return F.when(F.size(both["found"]) > 0, F.filter(all_, lambda s: _valid(kind, s["m"]))).otherwise(empty)

    both = F.struct(F.split(text, PATTERN[kind], -1).alias("gaps"), F.regexp_extract_all(text, F.lit(PATTERN[kind]), F.lit(0)).alias("found"))
    gate = F.contains(text, F.lit(_NEED[kind])) if kind in _NEED else text.rlike(PATTERN[kind])
    return F.when(gate, _with(both, some)).otherwise(empty)


def _apart(wide: Column, base: Column) -> Column:
    """The spans of ``wide`` that meet none of ``base``: tested against blocks of sorted base spans first, then inside those that they meet."""

    def tested(blocks: Column) -> Column:
        meets = lambda w, x: (x["start"] < w["end"]) & (w["start"] < x["end"])
        return F.filter(wide, lambda w: ~F.exists(blocks, lambda k: meets(w, k) & F.exists(k["spans"], lambda x: meets(w, x))))

    def blocks(sorted_: Column) -> Column:
        cut = _blocks(sorted_, _root(F.size(sorted_)))
        return F.transform(cut, lambda k: F.struct(F.array_min(F.transform(k, lambda x: x["start"])).alias("start"), F.array_max(F.transform(k, lambda x: x["end"])).alias("end"), k.alias("spans")))

    ends = F.array_sort(F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    return _with(ends, lambda e: _with(blocks(e), tested))


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and its candidate spans by kind, then start; a span of a wider kind that meets a base span is left out."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    cols = docs.select("doc_id", text.alias("text")).select("doc_id", *[_matches(F.col("text"), k).alias(k) for k in KINDS])
    found = cols.select("doc_id", F.concat(*[F.col(k) for k in BASE]).alias("base"), F.concat(*[F.col(k) for k in WIDE]).alias("wide"))
    free = F.when(F.size("wide") > 0, _apart(F.col("wide"), F.col("base"))).otherwise(F.col("wide"))
    return found.select("doc_id", F.concat("base", free).alias("spans"))


def _votes(s: Column) -> list[Column]:
    """The five labelers: 1 for, -1 against, 0 abstains."""
    kind, m, before, after = s["kind"], s["m"], s["before"], s["after"]
    digits = F.regexp_replace(m, "[^0-9]", "")
    vote = lambda good, bad: F.when(bad, -1).when(good, 1).otherwise(0)
    is_ = lambda *k: kind.isin(*k)
    form = vote(
        (is_("email") & m.rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}$")) | is_("ip", "card") | (is_("phone") & m.rlike(r"^\+[0-9]{1,3}[ .(-]")) | (is_("ssn") & ~m.rlike("^(?:000|666|9..)|-00-|-0000$")) | (is_("tel") & m.rlike(r"^\(")) | (is_("iban") & (F.length(F.regexp_replace(m, " ", "")) >= 15)),
        (is_("email") & m.rlike(r"\.\.|^\.|\.@|-\.|\.-")) | (is_("ssn") & m.rlike("^(?:000|666|9..)|-00-|-0000$")) | (is_("ip") & m.rlike(r"(?:^|\.)0[0-9]")),
    )
    names = vote(
        (is_("email") & m.rlike(r"(?i)\.(?:com|org|net|edu|gov|io|de|fr|es|uk|eu|info)$"))
        | (is_("card") & digits.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6)"))
        | (is_("phone") & digits.rlike("^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"))
        | (is_("iban") & m.rlike("^(?:AT|BE|CH|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)")),
        (is_("ip") & m.rlike(r"^(?:0|127|255)\.")) | (is_("tel", "ssn") & m.rlike(r"^\(?(?:123|000|999)")),
    )
    context = vote(before.rlike(_WORDS["for"]), before.rlike(_WORDS["against"]))
    edge = vote(
        (F.length(before) == 0) | before.rlike(r"[\s(<\[\"':;,]$"),
        before.rlike(r"[A-Za-z0-9_./=-]$") | after.rlike(r"^[A-Za-z0-9_]"),
    )
    kinds = F.size(F.array_distinct(F.split(digits, "")))
    variety = F.when(is_("email", "ip"), 0).otherwise(vote(kinds >= 5, kinds <= 2))
    return [form, names, context, edge, variety]


def with_votes(found: DataFrame) -> DataFrame:
    def voted(s):
        return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.concat_ws("", *[F.element_at(F.array(F.lit("n"), F.lit("z"), F.lit("p")), v + 2) for v in _votes(s)]).alias("votes"))

    return found.select("doc_id", F.transform("spans", voted).alias("spans"))


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, x))))


def fit(counts: list[tuple[str, str, int]], rounds: int = 30, steps: int = 300) -> dict:
    """EM over vote patterns (kind, votes, count), then a logistic classifier on the posteriors.

    Reliability of labeler ``j``: ``p[j][y][v]`` is the chance of vote ``v`` given the truth ``y``. Classifier features: a weight
    for each kind and for each labeler's vote. Without any candidate the weights are those of the priors.
    """
    code = {"n": 0, "z": 1, "p": 2}
    rows = [(KINDS.index(k), [code[c] for c in v], n) for k, v, n in counts]
    labelers = 5
    p = [[[0.6, 0.3, 0.1], [0.1, 0.3, 0.6]] for _ in range(labelers)]
    prior = [0.8 if k in BASE else 0.5 for k in KINDS]
    post: list[float] = []
    for _ in range(rounds):
        post = []
        for k, v, _n in rows:
            x = math.log(prior[k]) - math.log(1 - prior[k]) + sum(math.log(p[j][1][v[j]]) - math.log(p[j][0][v[j]]) for j in range(labelers))
            post.append(_sigmoid(x))
        for j in range(labelers):
            for y in (0, 1):
                w = [[0.6, 0.3, 0.1], [0.1, 0.3, 0.6]][y]
                tally = [20 * x for x in w]
                for (_, v, n), q in zip(rows, post, strict=True):
                    tally[v[j]] += n * (q if y else 1 - q)
                p[j][y] = [t / sum(tally) for t in tally]
        for k in range(len(KINDS)):
            a = 8.0 if KINDS[k] in BASE else 5.0
            good, total = a, 10.0
            for (kk, _, n), q in zip(rows, post, strict=True):
                if kk == k:
                    good, total = good + n * q, total + n
            prior[k] = min(0.99, max(0.01, good / total))
    weights = {"kind": [math.log(x / (1 - x)) for x in prior], "vote": [[0.0, 0.0, 0.0] for _ in range(labelers)]}
    for j in range(labelers):
        weights["vote"][j] = [math.log(p[j][1][v] / p[j][0][v]) for v in range(3)]
    mass = sum(n for _, _, n in rows) or 1
    for _ in range(steps if rows else 0):
        gk, gv = [0.0] * len(KINDS), [[0.0] * 3 for _ in range(labelers)]
        for (k, v, n), q in zip(rows, post, strict=True):
            e = n / mass * (q - _sigmoid(weights["kind"][k] + sum(weights["vote"][j][v[j]] for j in range(labelers))))
            gk[k] += e
            for j in range(labelers):
                gv[j][v[j]] += e
        weights["kind"] = [a + 0.5 * g for a, g in zip(weights["kind"], gk, strict=True)]
        weights["vote"] = [[a + 0.5 * g for a, g in zip(x, y, strict=True)] for x, y in zip(weights["vote"], gv, strict=True)]
    return weights | {"reliability": p, "prior": prior}


def _score(s: Column, model: dict) -> Column:
    kind = F.create_map(*[x for k, w in zip(KINDS, model["kind"], strict=True) for x in (F.lit(k), F.lit(float(w)))])[s["kind"]]
    votes = [F.create_map(F.lit("n"), F.lit(float(w[0])), F.lit("z"), F.lit(float(w[1])), F.lit("p"), F.lit(float(w[2])))[F.substring(s["votes"], j + 1, 1)] for j, w in enumerate(model["vote"])]
    total = kind
    for v in votes:
        total = total + v
    return 1 / (1 + F.exp(-total))


def personal_spans(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id and its spans (kind, start, end, base, score), one row per input row: base ones and those that were added.

    Null text counts as empty. Texts of any length are read whole; the work grows with the power of 1.5 of a text's matches at most.
    Repeated rows give repeated results, doc_id may be of any type, other columns are ignored. Empty input gives no rows.
    """
    found = C.staged(with_votes(candidates(docs)), "candidates")
    counted = found.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.votes").agg(F.count("*").alias("n")).orderBy("kind", "votes")
    model = fit([(r["kind"], r["votes"], r["n"]) for r in counted.collect()])  # at most 7 * 3**5 rows
    scored = F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].isin(*BASE).alias("base"), _score(s, model).alias("score")))
    return found.select("doc_id", F.filter(scored, lambda s: s["base"] | (s["score"] >= least)).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """The digest columns of spans that come by kind as listed, then start."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(F.array_join(F.transform(base, one), ","), 256).alias("base_sha256"), F.array_join(F.transform("spans", one), ",").alias("spans"))


def masked(text: Column, spans: Column) -> Column:
    """The text with each span replaced by ``[KIND]``; of overlapping spans the one that begins first (then is longer) counts.

    Spans go by blocks of the root of their number: a block's part of the text is cut out once, its pieces are cut from that part.
    """
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("minus_end"), s["kind"].alias("kind"))))
    part_type = "struct<at:int,out:array<string>>"

    def pieces(block: Column, at: Column) -> Column:
        """What stands from ``at`` to the end of the block's last span, masked, and that end."""
        last = F.greatest(at, F.array_max(F.transform(block, lambda s: -s["minus_end"])))

        def cut(part: Column) -> Column:
            def step(acc: Column, s: Column) -> Column:
                one = F.concat(F.substring(part, acc["at"] - at + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
                return F.when(s["start"] >= acc["at"], F.struct((-s["minus_end"]).alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))).otherwise(acc)

            return F.aggregate(block, F.struct(at.alias("at"), F.array().cast("array<string>").alias("out")).cast(part_type), step)

        return _with(F.substring(text, at + 1, last - at), cut)

    def joined(blocks: Column) -> Column:
        def step(acc: Column, block: Column) -> Column:
            return _with(pieces(block, acc["at"]), lambda p: F.struct(p["at"].alias("at"), F.concat(acc["out"], F.array(F.array_join(p["out"], ""))).alias("out")))

        return F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")).cast(part_type), step)

    whole = _with(order, lambda o: _with(_blocks(o, _root(F.size(o))), joined))
    out = _with(whole, lambda w: F.concat(F.array_join(w["out"], ""), F.substring(text, w["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, out).otherwise(text)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: personal data is masked in the texts, n_chars follows; all documents and columns stay.

    Null and empty texts stay as they are, texts of any length are masked whole; rows that repeat a doc_id are masked each by its own
    text, equal rows alike. Other columns may have any name. An empty table gives an empty one.
    """
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    key = F.xxhash64(F.col("row.text").cast("string"))
    asked = whole.select(F.struct(F.col("row.doc_id").alias("id"), key.alias("key")).alias("doc_id"), F.col("row.text").alias("text"))
    found = personal_spans(asked).filter(F.size("spans") > 0).dropDuplicates(["doc_id"]).select(F.col("doc_id.id").alias("id"), F.col("doc_id.key").alias("key"), "spans")
    keyed = whole.select("row", F.col("row.doc_id").alias("row_id"), key.alias("row_key"))
    both = keyed.join(found, F.col("row_id").eqNullSafe(F.col("id")) & (F.col("row_key") == F.col("key")), "left")
    hit, text = F.col("spans").isNotNull(), F.col("row.text").cast("string")
    new = {"text": F.when(hit, masked(text, F.col("spans"))).otherwise(text).cast(docs.schema["text"].dataType)}
    out = both.select("row", "spans", new["text"].alias("new"))
    kind = docs.schema["n_chars"].dataType if "n_chars" in docs.columns else None
    sized = F.when(F.col("spans").isNotNull(), F.length("new").cast(kind)).otherwise(F.col("row.n_chars")) if kind is not None else None
    return out.select(*[F.col("new").alias(c) if c == "text" else sized.alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(personal_spans(C.table(spark, sf_dir, "documents").select("doc_id", "text")))
