"""Main text of web pages: the maximum-scoring subsequence of a page's words and tags.

A page is read as a sequence of words and tags. Words score at least zero and tags below zero, by weights that labelled pages give; the contiguous part with
the greatest sum, found in one linear scan, is the region of the article. What stands in it inside of navigation, adverts, forms, comments and the
like is left out, then blocks are joined.

A word's weight belongs to the element that it stands in, a tag's to its name; both belong to the zone instead (nav, footer, advert ...) where an element, a
role or a class name opens one. A weight is the log-odds of standing inside to outside of the labelled regions, with prior counts for what no page shows;
words' are held between 0 and 1, tags' below 0. A zone costs once, where it opens, so that an advert within an article does not end it. Labelled pages are pages whose neighbouring blocks are neighbouring lines of a text of a corpus; at most
`SAMPLE` pages of at most `SAMPLE_HTML` characters are read, in the order of a checksum of their ids (one page of an id, none without an id). Without any, the prior counts alone give the weights.

Defined results: a null or empty page, or one without words outside of zones, has an empty text. Character references are decoded as browsers do (also without a semicolon
where HTML allows it). White space is Unicode's. Block elements and line breaks part words, inline elements do not. Unclosed elements end with their parent; an
unclosed comment, script, style or title, and a tag that the page breaks off in, end the page. Of equal sums the first and shortest region counts. Repeated rows give
repeated rows, null ids go through, an empty table gives no rows, very long pages are read whole, other columns are not read.
"""

from __future__ import annotations

import html
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfold.llm import common

#: Labelled pages: how many, and characters of each at most; code points by which a block and a line are compared (shorter ones: whole).
SAMPLE, SAMPLE_HTML, HEAD = 400, 64_000, 24
#: Cost of a tag and of a zone against a word, bounds of log-odds, cost of any tag at least.
TAG_SCALE, ZONE_SCALE, LEAST, MOST_WORD, SMALL = 4.0, 0.1, -6.0, 1.0, 0.01

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z) | <[!?][^>]*(?:>|\Z) | <(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)> | <(/?)([a-zA-Z][^\s/>]*+)([^>]*)(?:>|(\Z))""", re.S | re.X
)
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Elements whose content is text up to their end tag; elements that have none.
_RAW = frozenset(("script", "style", "title", "textarea", "iframe", "xmp", "noembed", "noframes"))
_VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
_INLINE = frozenset(("a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "script", "small", "span", "strike", "strong", "style", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"))
#: Zones by element, by role, and by a word of a class or id.
_ELEMENTS = dict(nav="menu", menu="menu", header="header", footer="footer", aside="sidebar", form="form", button="form", select="form", fieldset="form", head="hidden", noscript="hidden", template="hidden", svg="hidden", object="hidden", canvas="hidden", dialog="notice")
_WORDS = {
    "menu": ("nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "toc"),
    "header": ("header", "masthead", "topbar", "banner"),
    "footer": ("footer", "colophon", "copyright", "contentinfo"),
    "sidebar": ("sidebar", "aside", "related", "recommended", "widget", "widgets", "complementary", "trending"),
    "notice": ("cookie", "cookies", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "paywall", "disclaimer", "notification"),
    "advert": ("ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion"),
    "form": ("form", "search", "searchbox", "newsletter", "subscribe", "subscription", "signup", "login"),
    "comments": ("comment", "comments", "disqus", "replies", "respond", "reactions"),
    "share": ("share", "sharing", "social"),
}
_ZONE_OF = {w: z for z, words in _WORDS.items() for w in words}
#: Elements that class names do not make a zone of, unless one name is all there is; elements that end a zone left open by a plain element before them.
_PLAIN, _MAIN = frozenset(("html", "body", "main", "article")), frozenset(("main", "article"))
_LASTING = frozenset(("comments", "sidebar", "menu", "footer", "hidden"))
#: Prior counts (inside, outside) of words, words of links, structure tags, text tags, links, the edges of articles, zones' words and openings.
PRIOR = {"word": (2.0, 1.0), "link word": (1.5, 1.0), "tag": (1.0, 2.0), "text tag": (3.0, 3.1), "link": (3.0, 3.5), "edge": (0.05, 1.0), "zone": (0.05, 5.0)}
_TEXT_TAGS = _INLINE | {"p", "br", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "blockquote", "pre", "figure", "figcaption", "table", "thead", "tbody", "tr", "td", "th"}


def _zone(name: str, attributes: str) -> str | None:
    if name in _ELEMENTS:
        return _ELEMENTS[name]
    if not attributes or "=" not in attributes:
        return None
    for m in _NAMES.finditer(attributes):
        value = html.unescape(m[1] or m[2] or m[3] or "").lower().split()
        for v in value:
            if v in _ZONE_OF and (name not in _PLAIN or len(value) == 1 and name not in ("html", "body")):
                return _ZONE_OF[v]
            if name not in _PLAIN:
                for w in re.split(r"[-_:]", v):
                    if w in _ZONE_OF:
                        return _ZONE_OF[w]
    return None


def tokens(page: str) -> list[tuple[str, str, str]]:
    """(kind, key, text) of a page in order. Words: kind 'word', the element or zone that they stand in, a run of text. Tags: kind 'tag', or 'break' where
    they part words, with the name, 'zone ...' where one opens, 'zone' inside of one, and no text."""
    out: list = []
    stack: list[tuple[str, str | None]] = []  # open elements, with the zone inside
    depth: Counter = Counter()
    zone, at, n = None, 0, len(page)

    def said(text: str) -> None:
        if text:
            key = f"zone {zone}" if zone else "a" if depth["a"] else next((e for e, _ in reversed(stack) if e not in _INLINE), "")
            out.append(("word", key, html.unescape(text)))

    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            said(page[at:])
            break
        said(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[7] is not None:  # the page ends within this tag
            break
        closing, kind = bool(m[1] or m[4]), "tag" if name in _INLINE else "break"
        if closing:
            out.append((kind, "zone" if zone or name in _RAW else name, ""))
            if depth[name]:
                while stack:
                    e, _ = stack.pop()
                    depth[e] -= 1
                    if e == name:
                        break
                zone = stack[-1][1] if stack else None
            continue
        if name in _MAIN and zone and zone not in _LASTING:
            zone = None
        zone_here = zone or _zone(name, m[3] or m[6] or "")
        if name in _RAW:
            end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            out.append((kind, "zone" if zone else "zone hidden", ""))
            if end is None:
                break
            at = end.start()
            stack.append((name, zone))
            depth[name] += 1
            continue
        out.append((kind, "zone" if zone else f"zone {zone_here}" if zone_here else name, ""))
        if name not in _VOID:
            stack.append((name, zone_here))
            depth[name] += 1
            zone = zone_here
    return out


def blocks(page: list[tuple[str, str, str]]) -> list[tuple[int, int, str]]:
    """First token, end, and text with single blanks of each block that has words."""
    out, first, said = [], None, []

    def close(end: int) -> None:
        text = " ".join("".join(said).split())
        if text:
            out.append((first, end, text))

    for k, (kind, key, text) in enumerate(page):
        if kind == "break" and key != "br":
            close(k)
            first, said = None, []
        elif kind == "break":
            said.append(" ")
        elif kind == "word":
            first = k if first is None else first
            said.append(text)
    close(len(page))
    return out


def prior(kind: str, key: str) -> tuple[float, float]:
    if key.startswith("zone "):
        return PRIOR["zone"]
    if kind == "word":
        return PRIOR["link word" if key == "a" else "word"]
    return PRIOR["link" if key == "a" else "edge" if key in _MAIN else "text tag" if key in _TEXT_TAGS else "tag"]


def weight(kind: str, key: str, inside: float = 0, outside: float = 0) -> float:
    """Weight of a word or tag that was seen so often inside and outside of labelled regions."""
    a, b = prior(kind, key)
    odds = math.log((inside + a) / (outside + b))
    if kind == "word":
        return min(max(odds, 0.0), MOST_WORD)
    if key == "zone":
        return -SMALL
    return (ZONE_SCALE if key.startswith("zone ") else TAG_SCALE) * min(max(odds, LEAST), -SMALL)


def learn(labelled: Iterator[tuple[list[tuple[str, str, str]], set[int]]]) -> dict[tuple[str, str], float]:
    """Weights from pages (tokens) and the numbers of their content blocks; the region is from the first to the last of them."""
    counts: dict[tuple[str, str], list[float]] = {}
    for page, content in labelled:
        held = blocks(page)
        if not content:
            continue
        lo, hi = held[min(content)][0], held[max(content)][1]
        for k, (kind, key, text) in enumerate(page):
            n = len(text.split()) if kind == "word" else 1
            if n:
                counts.setdefault(("word" if kind == "word" else "tag", key), [0, 0])[not lo <= k < hi] += n
    return {k: weight(*k, *c) for k, c in counts.items()}


def region(scores: list[float]) -> tuple[int, int]:
    """The contiguous part with the greatest sum above zero: the first of equal ones, and the shortest."""
    best, low, total, start, out = 0.0, 0.0, 0.0, 0, (0, 0)
    for k, s in enumerate(scores):
        total += s
        if total - low > best:
            best, out = total - low, (start, k + 1)
        if total <= low:
            low, start = total, k + 1
    return out


def main_text(page: str | None, weights: dict[tuple[str, str], float]) -> str:
    read = tokens(page or "")
    scores = []
    for kind, key, text in read:
        as_kind = "word" if kind == "word" else "tag"
        w = weights.get((as_kind, key))
        w = weight(as_kind, key) if w is None else w
        scores.append(w * len(text.split()) if kind == "word" else w)
    lo, hi = region(scores)
    said = [" " if kind == "break" else "" if kind == "tag" or key.startswith("zone ") else text for kind, key, text in read[lo:hi]]
    return " ".join("".join(said).split())


#: Between the marks of neighbouring lines, and before the first and after the last line of a text.
_NEXT, _EDGE = "\x01", "\x02"


def _mark(text: str) -> str:
    """A block as lines are told by: all of a short one, the beginning of a longer one."""
    return f"={text}" if len(text) < HEAD else f"^{text[:HEAD]}"


def labelled_pages(pages: DataFrame, texts: DataFrame, sample: int = SAMPLE, most: int = SAMPLE_HTML) -> list[tuple[list, set[int]]]:
    """Tokens and content blocks of at most `sample` pages. Two neighbouring blocks are content where two neighbouring lines of some text are alike, one block where
    it is alike to the one line of some text; so is a heading that the first of them begins with. What is asked of the texts is as large as the sample, and each line of
    a text answers once, however common it is."""
    spark = pages.sparkSession
    usable = pages.where(F.length("html").between(1, most) & F.col("page_id").isNotNull())
    # Ids first, then the pages with these ids, one of each: no task sends more than ids and its share of the sample.
    chosen = usable.select("page_id", F.crc32(F.col("page_id").cast("string")).alias("crc")).orderBy("crc", "page_id").limit(sample).select("page_id").collect()
    ids = spark.createDataFrame([(i,) for i in {r.page_id for r in chosen}], f"page_id {dict(pages.dtypes)['page_id']}")
    rows = usable.join(F.broadcast(ids), "page_id", "left_semi").groupBy("page_id").agg(F.min("html").alias("html")).collect()
    rows.sort(key=lambda r: (zlib.crc32(str(r.page_id).encode()), str(r.page_id)))
    read = [tokens(r.html) for r in rows]
    said = [[text for _, _, text in blocks(page)] for page in read]
    pair = lambda a, b: f"{_mark(a)}{_NEXT}{_mark(b)}"
    alone = lambda a: f"{_EDGE}{_NEXT}{_mark(a)}{_NEXT}{_EDGE}"
    asked = {pair(a, b) for own in said for a, b in zip(own, own[1:], strict=False)} | {alone(a) for own in said for a in own}
    if not asked:
        return []
    few = F.broadcast(spark.createDataFrame([(a,) for a in sorted(asked)], "said string"))  # blocks of the sample
    line = F.filter(F.transform(F.split(F.col("text"), "\n"), lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " "))), lambda x: x != "")
    mark = F.transform(line, lambda x: F.when(F.length(x) < HEAD, F.concat(F.lit("="), x)).otherwise(F.concat(F.lit("^"), F.substring(x, 1, HEAD))))
    marks = texts.select(mark.alias("m")).where("size(m) > 0")
    both = F.zip_with(F.slice("m", F.lit(1), F.size("m") - 1), F.slice("m", F.lit(2), F.size("m")), lambda a, b: F.concat(a, F.lit(_NEXT), b))
    one = F.array(F.concat(F.lit(_EDGE + _NEXT), F.get("m", 0), F.lit(_NEXT + _EDGE)))
    found = {r.said for r in marks.select(F.explode(F.when(F.size("m") == 1, one).otherwise(both)).alias("said")).join(few, "said", "left_semi").distinct().collect()}  # as many as were asked for, at most
    out = []
    for page, own in zip(read, said, strict=True):
        content = {k for k, a in enumerate(own) if alone(a) in found}
        for k in range(len(own) - 1):
            content |= {k, k + 1} if pair(own[k], own[k + 1]) in found else set()
        if content:
            first = min(content)
            if first and own[first].startswith(own[first - 1][:HEAD]):
                content.add(first - 1)
            out.append((page, content))
    return out


def extracted(pages: DataFrame, weights: dict[tuple[str, str], float]) -> DataFrame:
    """page_id, url, text of every page."""
    sent = pages.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, "html"):
            text = [main_text(h, sent.value) for h in b.column(2).to_pylist()]
            yield pa.record_batch({"page_id": b.column(0), "url": b.column(1), "text": pa.array(text, pa.string())})

    kind = dict(pages.dtypes)
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return rows.mapInArrow(run, f"page_id {kind['page_id']}, url {kind['url']}, text string")


def op11_main_text(spark, sf_dir: str) -> DataFrame:
    pages, docs = (common.table(spark, sf_dir, t) for t in ("pages", "documents"))
    weights = learn(labelled_pages(pages, docs.select("text")))
    return extracted(pages, weights).withColumn("n_chars", F.length("text").cast("long"))


#: The article of the given pages, which mark it; inline elements go without a blank, all other tags leave one.
OP11_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS x FROM pages),
t AS (SELECT page_id, url, regexp_replace(regexp_replace(x, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') AS x FROM a),
d AS (SELECT page_id, url, regexp_replace(replace(replace(replace(replace(x, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&#x27;', chr(39)), '&amp;?', '&', 'g') AS x FROM t),
s AS (SELECT page_id, url, trim(regexp_replace(x, '\s+', ' ', 'g')) AS text FROM d)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM s
"""
