"""HTML extraction: the maximum-scoring subsequence of a page's words and tags is its article (Pasternack, Roth 2009).

A page is a sequence of words and tags. Words score positive and tags negative, and one linear scan finds the run with the
greatest sum. The weights come from labelled pages, which are those whose markup itself says where the article is: how
often a tag stands outside tells its cost, how many words with a class name (or in links) stand outside tells what
such a word counts. Words in elements that their name, role or class says to be page furniture count as no words, so
they neither win the scan nor come out when the article runs around them.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Weights come from so many pages about, chosen by a hash of page_id and url.
TRAIN_PAGES = 4_000
#: Class names that fewer labelled pages hold have no weight of their own.
LEAST_PAGES = 20
#: Costs of a tag that always stands outside, in words; of equally good ones the first is taken.
COSTS = (1.0, 2.0, 0.5, 3.25, 5.0, 8.0, 0.25)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|title|noscript|template|textarea|select|svg|datalist)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*>"
    r"""|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>"
    r"|<[a-zA-Z/][^>]*\Z",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z][a-zA-Z-]*)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# Elements that are set in lines of text, that have no content, and that break blocks by their end tag only.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup"
    " time tt u var wbr img picture source track input button nobr".split()
)
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Elements and roles that never hold an article.
FURNITURE = frozenset("nav footer aside form fieldset button menu dialog iframe object audio video canvas".split())
ROLES = frozenset("navigation contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
# Words in class names and ids of furniture.
HINTS = frozenset(
    "ad ads adbox adslot adsense advert adverts advertisement advertisements advertising banner banners sponsor sponsors sponsored promo"
    " promos promotion promoted cookie cookies consent gdpr notice notices alert alerts notification notifications popup popups modal"
    " overlay paywall newsletter subscribe subscription signup signin login register nav navbar navigation menu menus submenu"
    " breadcrumb breadcrumbs pagination pager toolbar topbar sidebar sidebars rail widget widgets related recommended recommendations"
    " trending share sharing social footer copyright disclaimer comment comments reply replies respond discussion disqus feedback form"
    " forms search searchbox".split()
)
HEADER_HINTS = frozenset("header masthead".split())
ARTICLE_WORDS = frozenset("article post entry story".split())
NOT_MEANT = ("has-", "with-", "no-", "without-", "not-")


#: Tags that mostly stand in articles, and the share of a tag's occurrences outside before any page is seen.
CONTENT = frozenset("p br b strong em i q blockquote pre code figure figcaption h1 h2 h3 h4 h5 h6 sub sup".split())


def _outside_before(tag: str) -> float:
    return 0.1 if tag in CONTENT else 0.5


class Weights:
    """What tags cost and what words count."""

    def __init__(self, cost: float = COSTS[0], outside: dict[str, float] | None = None, names: dict[str, float] | None = None, link: float = 0.5):
        self.cost, self.outside, self.names, self.link = cost, outside or {}, names or {}, link


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(text)} if text else {}


def furniture(tag: str, attributes: dict[str, str], level: int) -> int:
    """2: the element's text is no article; 1: only its headings may be; 0: may be. level: 2 inside an article, 1 inside main."""
    if not attributes and tag not in FURNITURE and tag != "header" and tag != "article":
        return 0
    if tag in FURNITURE or tag == "article" and level == 2 or attributes.get("role", "").lower() in ROLES:
        return 2
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower():
        return 2
    names = f"{attributes.get('class', '')} {attributes.get('id', '')}".split()
    if tag in ("article", "main", "body", "html"):  # only names that are nothing but a hint
        return 2 if any(n.lower() in HINTS for n in names) and tag == "article" else 0
    words = {p.lower() for n in names if not n.lower().startswith(NOT_MEANT) for p in _PART.findall(n)}
    if words & HINTS:
        return 2
    if tag == "header" or words & HEADER_HINTS or attributes.get("role") == "banner":
        return 1 if level or words & ARTICLE_WORDS else 2
    return 0


class Page:
    """A page's words and tags, in order.

    chunks: (text, number of words, block, furniture, level, in a link, weight or names). events: (None, the number of a chunk,
    level) or (name of a tag, 0 or what furniture it is in or begins, level).
    """

    def __init__(self, source: str, names: dict[str, float] | None = None):
        self.chunks: list[tuple] = []
        self.events: list[tuple[str | None, int, int]] = []
        self._names = names  # weights of class names, or None to keep the names
        self._block, self._at = 0, 0
        # open elements: tag, furniture, level, in a link, weight or names
        self._stack: list[tuple] = [("", 0, 0, False, 1.0 if names is not None else ())]
        self._open: Counter[str] = Counter()
        end = 0
        for m in _TOKEN.finditer(source):
            if m.start() > end:
                self._text(source[end : m.start()])
            end = m.end()
            if tag := m[3] or m[6]:
                self._tag(tag.lower(), bool(m[2] or m[5]), m[4] if m[3] else m[7])
        if end < len(source):
            self._text(source[end:])

    def _text(self, raw: str) -> None:
        text = html.unescape(raw) if "&" in raw else raw
        _, kind, level, link, weight = self._stack[-1]
        self.events.append((None, len(self.chunks), level))
        self.chunks.append((text, len(text.split()), self._block, kind, level, link, weight))

    def _pop(self, tag: str) -> None:
        """Close the innermost open element of that name, and all inside it."""
        while self._open[tag]:
            name = self._stack.pop()[0]
            self._open[name] -= 1
            if name == tag:
                return

    def _tag(self, tag: str, closes: bool, rest: str) -> None:
        if tag == "br":
            self.events.append((None, len(self.chunks), self._stack[-1][2]))
            self.chunks.append((" ", 0, self._block, *self._stack[-1][1:]))
            return
        breaks = tag not in INLINE
        if breaks:
            self._block += 1
        _, kind, level, link, weight = self._stack[-1]
        if closes:
            self._pop(tag)
            self.events.append((tag, min(kind, self._stack[-1][1]), self._stack[-1][2]))
            return
        if breaks and self._open["p"]:
            self._pop("p")
        if tag == "li" and self._stack[-1][0] == "li":
            self._pop("li")
        _, kind, level, link, weight = self._stack[-1]
        attributes = _attributes(rest)
        own = furniture(tag, attributes, level)
        self.events.append((tag, kind if kind == 2 else 3 if own == 2 else 0, level))
        if tag in VOID or rest.endswith("/") and tag not in INLINE and "=" not in rest[-3:]:
            return
        kind = 2 if 2 in (kind, own) else own if own else 0 if tag in HEADINGS else kind
        if tag == "article":
            level = 2
        elif level == 0 and (tag == "main" or attributes.get("role") == "main" or attributes.get("itemprop") == "articleBody"):
            level = 1
        if names := [n for n in attributes.get("class", "").split() if n]:
            if self._names is None:
                weight = (*weight, *(n for n in names if n not in weight))
            else:
                weight = min(weight, *(self._names.get(n, 1.0) for n in names))
        self._stack.append((tag, kind, level, link or tag == "a", weight))
        self._open[tag] += 1

    def marked(self) -> int:
        """The level that says where the article is, if it holds a third of the words that may be one; else 0."""
        words = Counter()
        for _, n, _, kind, level, _, _ in self.chunks:
            if not kind:
                words[level] += n
        total = sum(words.values())
        return next((lv for lv in (2, 1) if words[lv] and 3 * sum(words[x] for x in (1, 2) if x >= lv) >= total), 0)

    def scores(self, w: Weights, level: int) -> list[float]:
        """Of each event. On a page that marks its article, words outside count against the run and tags inside cost nothing."""
        out = []
        for tag, what, at in self.events:
            if tag is not None and 0 < level <= at:
                out.append(0.0)
            elif tag is not None:  # furniture costs as much as a tag when it begins, and nothing inside
                out.append(-w.cost if what == 3 else 0.0 if what else -w.cost * (w.outside[tag] if tag in w.outside else _outside_before(tag)))
            else:
                _, n, _, kind, _, link, weight = self.chunks[what]
                out.append(0.0 if kind else -float(n) if at < level else n * min(weight, w.link) if link else n * weight)
        return out

    def text(self, first: int, last: int) -> str:
        """The blocks of the events first to last, without furniture."""
        blocks: dict[int, list[str]] = defaultdict(list)
        for tag, what, _ in self.events[first:last]:
            if tag is None and not self.chunks[what][3]:
                blocks[self.chunks[what][2]].append(self.chunks[what][0])
        return "\n\n".join(t for b in blocks.values() if (t := " ".join("".join(b).split())))


def best_run(scores: list[float]) -> tuple[int, int]:
    """The slice with the greatest positive sum, the first and shortest of equal ones; (0, 0) if none is positive."""
    best, first, last, total, start = 0.0, 0, 0, 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, first, last = total, start, i + 1
    return first, last


def extract(source: str | None, weights: Weights) -> str:
    """The article of a page."""
    page = Page(source or "", weights.names)
    return page.text(*best_run(page.scores(weights, page.marked())))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(what, inside, outside, pages) over labelled pages: words by class name, words in links, tags."""
    inside, outside, pages = Counter(), Counter(), Counter()
    for batch in batches:
        for source in batch["html"].to_pylist():
            page = Page(source)
            if not (level := page.marked()):
                continue
            seen, now = set(), 0
            for tag, what, _ in page.events:
                if tag is None:
                    _, n, _, kind, now, link, names = page.chunks[what]
                    keys, n = ([] if kind else [*(f".{x}" for x in names), *["a:"] * link]), n
                elif what or tag in ("article", "main", "html", "body"):
                    continue
                else:  # a tag belongs where the text before it is; most articles are one piece
                    keys, n = [f"<{tag}"], 1
                for key in keys:
                    (inside if now >= level else outside)[key] += n
                seen.update(keys)
            pages.update(seen)
    keys = sorted(pages)
    columns = [pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in (inside, outside, pages))]
    yield pa.RecordBatch.from_arrays(columns, names=["what", "inside", "outside", "pages"])


def _trial(weights: list[Weights]):
    """For each of the weights, the words of labelled pages' articles that come out, that should, and that do both."""

    def tried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [[0, 0, 0] for _ in weights]
        for batch in batches:
            for source in batch["html"].to_pylist():
                page = Page(source, weights[0].names)
                if not (level := page.marked()):
                    continue
                for total, w in zip(totals, weights):
                    first, last = best_run(page.scores(w, 0))  # the labels themselves are hidden
                    for i, (tag, what, _) in enumerate(page.events):
                        if tag is None and not page.chunks[what][3]:
                            n, true = page.chunks[what][1], page.chunks[what][4] >= level
                            total[0] += n * (first <= i < last)
                            total[1] += n * true
                            total[2] += n * (true and first <= i < last)
        columns = [pa.array([*range(len(totals))], pa.int64()), *(pa.array(c, pa.int64()) for c in zip(*totals))]
        yield pa.RecordBatch.from_arrays(columns, names=["k", "got", "true", "both"])

    return tried


def fit(pages: DataFrame, train_pages: int = TRAIN_PAGES) -> Weights:
    """Weights from about train_pages rows of pages(page_id, url, html), of which those with a marked article are labelled."""
    n = pages.count()
    share = int(1e6 * min(1.0, train_pages / max(1, n)))
    sample = pages.where(F.pmod(F.xxhash64("page_id", "url"), F.lit(1_000_000)) < share)
    sample = sample.where(F.lower("html").rlike("<(article|main)[\\s>]|role=.?main|articlebody")).select("html")
    counts = sample.mapInArrow(_counts, "what string, inside long, outside long, pages long").groupBy("what")
    # class names on few pages have no weight; the rest is bounded by train_pages times a page's names
    sums = counts.agg(*(F.sum(c).alias(c) for c in ("inside", "outside", "pages"))).where(
        (F.col("pages") >= LEAST_PAGES) | ~F.col("what").startswith(".")
    )
    before = lambda what: 1 - _outside_before(what[1:]) if what[0] == "<" else 0.5
    share_in = {r.what: (r.inside + 4 * before(r.what)) / (r.inside + r.outside + 4) for r in sums.collect()}
    outside = {k[1:]: 1 - v for k, v in share_in.items() if k[0] == "<"}
    names = {k[1:]: 2 * v - 1 for k, v in share_in.items() if k[0] == "." and v < 0.5}
    choices = [Weights(c, outside, names, share_in.get("a:", 0.5)) for c in COSTS]
    tried = sample.mapInArrow(_trial(choices), "k long, got long, true long, both long").groupBy("k")
    f1 = {r.k: 2 * r.both / max(1, r.got + r.true) for r in tried.agg(*(F.sum(c).alias(c) for c in ("got", "true", "both"))).collect()}
    return max(enumerate(choices), key=lambda x: (f1.get(x[0], 0.0), -x[0]))[1]


def main_text(pages: DataFrame, train_pages: int = TRAIN_PAGES) -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars (code points).

    text is the article: character references are decoded, white space inside a block is one space, blocks are trimmed and
    joined by two line feeds. Menus, page headers, footers, sidebars, notices, adverts, forms, scripts, styles, comments of
    readers and hidden elements are left out; of a header inside the article its headings stay. Pages without an article
    (null, empty, markup only) give an empty text. Markup may be broken: unclosed elements end with what holds them, an
    unclosed comment or script runs to the page's end. Every page is read whole; repeated rows all stay. Without labelled
    pages the weights are those of Weights(). Extra columns are ignored; an empty table gives no rows.
    """
    inputs = pages.select("page_id", "url", "html")
    weights = inputs.sparkSession.sparkContext.broadcast(json.dumps(fit(inputs, train_pages).__dict__))
    schema = inputs.select("page_id", "url").schema.add("text", "string").add("n_chars", "long")

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = Weights(**json.loads(weights.value))
        for batch in batches:
            texts = [extract(source, w) for source in batch["html"].to_pylist()]
            columns = [batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    return inputs.mapInArrow(extracted, schema)
