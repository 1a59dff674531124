"""HTML extraction (operator 7): two-pass block rules.

A page is cut into blocks at block-level tags; end tags that HTML implies (of paragraphs, list items, table cells) are implied here
too. What encloses a block can rule it out: navigation, header, footer, sidebar, form, or an element whose class or id as a
whole names a notice, an advert, comments and the like. The first pass decides the others by link density, length and the share
of stop words: good, bad, or undecided (short ones, and inside an article also long ones with few stop words). In the second pass
an undecided block inherits the label of the nearest decided block within its own container; at equal distance good counts. A heading
inherits from what follows it. Where nothing around is decided, the container decides: an article's blocks are good.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

LENGTH_LOW, LENGTH_HIGH, STOP_LOW, STOP_HIGH, LINKS_MOST = 70, 200, 0.12, 0.25, 0.4

STOP = frozenset(
    "the of and to in a is that it for on with as are was be at by this have from or an not but they which you we his her "
    "le la les de des du un une et est en que qui dans pour par sur au aux avec ne pas il elle sont ce se plus "
    "der die das und ist in den von zu mit sich des auf für nicht ein eine als auch es an werden aus er hat dass sie nach bei "
    "el los las del y es por con para una su al lo como más o pero sus no se".split()
)
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody "
    "td tfoot th thead title tr ul br".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_DROPPED = frozenset("nav footer aside form button select textarea menu dialog head title template noscript iframe svg canvas object audio video map fieldset label".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
# A class or id is boilerplate if all its words are of the two lists and one is of the first: ``cookie-banner``, not ``related-work``.
_BOILER = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot banner sponsor sponsored promo promotion sidebar side widget widgets nav navbar navigation menu "
    "breadcrumb breadcrumbs footer masthead topbar cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription comment comments "
    "commentlist disqus respond replies reply share sharing social related recommended recommendations login signup signin search searchbox pager pagination toolbar skip "
    "hidden copyright disclaimer".split()
)
_NEUTRAL = frozenset(
    "site page main top bottom left right list lists box block blocks bar bars button buttons link links container wrapper wrap inner outer area item items icon icons group section "
    "module panel row col column post posts article articles story stories content body form field text title heading header more read also by user thread tree count unit slot zone image "
    "media sticky fixed floating mobile desktop global primary secondary".split()
)
_HEADER = frozenset(("header", "page-header", "site-header", "page_header", "site_header"))
_MAIN = frozenset("article post entry story main content article-body article-content post-body post-content entry-content story-body main-content page-content".split())
_WORDS = re.compile(r"[a-z]+|[0-9]+")
# What an opening tag ends: the elements of its own kind that are open since the last element of the second list.
_CELLS, _LISTS = ("td", "th", "caption", "table"), ("ul", "ol", "menu", "dl", "td", "th", "table")
_ENDS = {"li": ("li",), "dt": ("dd", "dt"), "dd": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",), "tbody": ("tbody", "thead", "tfoot"), "thead": ("tbody", "thead", "tfoot"), "tfoot": ("tbody", "thead", "tfoot"), "option": ("option",)}
_KEPT_OPEN = {"p": (*_CELLS, "button", "object"), "li": _LISTS, "dd": _LISTS, "dt": _LISTS, "td": ("table",), "th": ("table",), "tr": ("table",), "tbody": ("table",), "thead": ("table",), "tfoot": ("table",), "option": ("select",)}
_BOUNDS: dict[str, tuple[str, ...]] = {}
for _tag, _outer in _KEPT_OPEN.items():
    for _o in _outer:
        _BOUNDS[_o] = (*_BOUNDS.get(_o, ()), _tag)
_ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table ul".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<raw>script|style|noscript|template|iframe|svg|textarea|select)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*+>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(?P<close2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)(?:>|\Z)|<[!?][^>]*+(?:>|\Z)",
    re.S | re.I,
)
_QUOTED, _HIDDEN = re.compile(r"\"[^\"]*\"|'[^']*'"), re.compile(r"\shidden(?:\s|=|$|/)", re.I)
_RIGHTS = re.compile(r"(?:©|\(c\)|copyright\b|all rights reserved)", re.I)
_SIGNS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum()) + "«»„“”‘’…–—¿¡"
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))")


class Block:
    __slots__ = ("area", "dropped", "heading", "links", "main", "parts")

    def __init__(self, dropped: bool, main: int, heading: bool, area: int):
        self.parts: list[str] = []
        self.links, self.dropped, self.main, self.heading, self.area = 0, dropped, main, heading, area


class _Open:
    """The open elements. Counts of open tags, and of those since each bound, tell at once whether an end tag or an implied end
    has something to close; what is closed is popped, so all of a page takes time in proportion to its tags."""

    def __init__(self):
        self.stack: list[tuple[str, int, int, int]] = []  # tag, dropped, main (2: by tag or role, 1: by name), header
        self.count: dict[str, int] = {}
        self.inner: dict[str, list[int]] = {t: [0] for t in _KEPT_OPEN}
        self.dropped = self.header = self.anchors = 0
        self.main = [0, 0, 0]

    def push(self, tag: str, dropped: int, main: int, header: int) -> None:
        self.stack.append((tag, dropped, main, header))
        self.count[tag] = self.count.get(tag, 0) + 1
        for t in _BOUNDS.get(tag, ()):
            self.inner[t].append(0)
        if tag in self.inner:
            self.inner[tag][-1] += 1
        self.dropped += dropped
        self.header += header
        self.main[main] += 1
        self.anchors += tag == "a"

    def pop(self) -> tuple[str, bool]:
        tag, dropped, main, header = self.stack.pop()
        self.count[tag] -= 1
        if tag in self.inner:
            self.inner[tag][-1] -= 1
        for t in _BOUNDS.get(tag, ()):
            self.inner[t].pop()
        self.dropped -= dropped
        self.header -= header
        self.main[main] -= 1
        self.anchors -= tag == "a"
        return tag, bool(dropped or main or header)

    def close(self, tags: tuple[str, ...]) -> bool:
        """Pop up to one of the tags, which is open; was an area left?"""
        left = False
        while True:
            tag, area = self.pop()
            left |= area
            if tag in tags:
                return left

    def level(self) -> int:
        return 2 if self.main[2] else 1 if self.main[1] else 0


def _boilerplate(name: str) -> bool:
    words = [w for w in _WORDS.findall(name) if not w.isdigit()]
    return bool(words) and any(w in _BOILER for w in words) and all(w in _BOILER or w in _NEUTRAL for w in words)


def blocks(page: str) -> list[tuple[str, Block]]:
    """The page's blocks that have text, in page order, with white space turned into single spaces."""
    found: list[Block] = []
    open_ = _Open()
    areas = 0
    now = Block(False, 0, False, 0)

    def start(heading: bool = False) -> None:
        nonlocal now
        if now.parts:
            found.append(now)
        level = open_.level()
        now = Block(open_.dropped > 0 or (open_.header > 0 and not level), level, heading, areas)

    def text(s: str) -> None:
        if s:
            now.parts.append(s)
            if open_.anchors:
                now.links += len(s.strip())

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            if m["raw"] and m["raw"].lower() in ("noscript", "textarea", "select"):
                start()
            continue
        if m["close"] or m["close2"]:
            if open_.count.get(tag):
                areas += open_.close((tag,))
            if tag in _BLOCK:
                start()
            continue
        if tag in _ENDS_P and open_.inner["p"][-1]:
            areas += open_.close(("p",))
        for t in _ENDS.get(tag, ()):
            if open_.inner[t][-1]:
                areas += open_.close((t,))
        if tag in _VOID:
            if tag == "hr":
                start()
            elif tag in ("br", "img"):
                now.parts.append(" ")
            continue
        raw = m["attrs"] or m["attrs2"] or ""
        attrs = {k.lower(): x or y or z for k, x, y, z in _ATTR.findall(raw)}
        names = f"{attrs.get('class', '')} {attrs.get('id', '')}".lower().split()
        role = attrs.get("role", "").lower()
        main = 2 if tag in ("article", "main") or role in ("main", "article") else int(tag in ("div", "section") and any(n in _MAIN for n in names))
        hidden = attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "") or bool(_HIDDEN.search(_QUOTED.sub("", raw)))
        named = tag not in ("html", "body", "main") and tag not in _HEADINGS and any(_boilerplate(n) for n in names)
        dropped = tag in _DROPPED or role in _ROLES or hidden or named
        if dropped:
            main = 0
        header = tag == "header" or (tag not in ("html", "body", "article", "main") and any(n in _HEADER for n in names))
        if not m[0].endswith("/>"):
            open_.push(tag, int(dropped), main, int(header))
            areas += bool(main or dropped or header)
        if tag in _BLOCK or dropped or main or header:
            start(tag in _HEADINGS)
    if at < len(page):
        text(page[at:])
    start()
    out = []
    for b in found:
        s = " ".join(entities.unescape("".join(b.parts)).split())
        if s:
            out.append((s, b))
    return out


def _first(s: str, b: Block, level: int) -> int:
    """1 good, -1 bad, 0 undecided; ``level``: how the page's main container is known, 0 if there is none."""
    if b.dropped or b.main < level:
        return -1
    words = s.split()
    if b.links / max(1, len(s)) > LINKS_MOST and (len(words) > 1 or not level):
        return -1
    if not level and _RIGHTS.match(s):
        return -1
    if len(s) < LENGTH_LOW:
        return 0
    stop = sum(w.strip(_SIGNS).lower() in STOP for w in words) / max(1, len(words))
    if level:
        return int(stop >= STOP_LOW)  # inside an article nothing is bad for its words
    if stop >= STOP_HIGH or (stop >= STOP_LOW and len(s) >= LENGTH_HIGH):
        return 1
    return 0 if stop >= STOP_LOW or len(s) >= LENGTH_HIGH else -1


def extract(page: str | None) -> str:
    """The main text: good blocks in page order, joined by single spaces."""
    found = blocks(page or "")
    level = max((b.main for _, b in found if not b.dropped), default=0)
    first = [_first(s, b, level) for s, b in found]
    labels = list(first)
    own = [i for i, (_, b) in enumerate(found) if b.main >= level and not b.dropped] if level else list(range(len(found)))
    for i, before, after in _undecided(first, own):
        near = sorted([(i - before, -first[before])] * (before >= 0) + [(after - i, -first[after])] * (after >= 0))
        labels[i] = -near[0][1] if near else 1
        if found[i][1].heading and after >= 0:
            labels[i] = first[after]
    return " ".join(s for (s, _), y in zip(found, labels, strict=True) if y > 0)


def _undecided(first: list[int], own: list[int]) -> list[tuple[int, int, int]]:
    """Each undecided block with the nearest decided ones before and after it among ``own``; -1 where there is none."""
    after, last = {}, -1
    for i in reversed(own):
        after[i] = last
        last = i if first[i] else last
    out, last = [], -1
    for i in own:
        if first[i]:
            last = i
        else:
            out.append((i, last, after[i]))
    return out


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row. Null or empty html, or none but boilerplate: empty text.

    Pages of any length are read whole, in time in proportion to their length. Repeated rows give repeated results, page_id may be of
    any type, other columns are ignored. An empty table gives no rows.
    """
    spark = pages.sparkSession
    C.small_batches(spark, 500)

    def run(batches):
        for batch in batches:
            texts = [extract(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(C.table(spark, sf_dir, "pages"))
