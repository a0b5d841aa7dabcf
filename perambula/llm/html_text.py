"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. Pass one decides blocks on their own. Blocks in elements that
are never the article (navigation, header, footer, form, aside, or a name that is wholly made of such words)
and blocks of links are boilerplate; long blocks with many stop words are content, long ones with next to
none are boilerplate; the rest is undecided. Pass two lets undecided blocks inherit: each takes the label of
its nearest decided neighbours, content if they agree on it or if the block stands in the same container as
a content neighbour.

Names are a prior, no verdict: `body`, `main`, `article` and what holds `main` or the first `article` are never
judged by them, and if a page has no content otherwise and what names condemn far outweighs the rest, pass one
is done again without names. Where no block has enough stop words (another language, a short page), what
nothing else speaks against is content.

Tasks map over pages in bounded batches; nothing is shuffled.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from perambula.llm.common import bound_batches

# Elements that end a block; elements without text; boilerplate elements and name parts; stop words.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li main menu nav noscript ol optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
SILENT_TAGS = frozenset("applet button canvas datalist embed head iframe input map math noframes noscript object script select style svg template textarea title".split())
BOILERPLATE_TAGS = frozenset("aside dialog footer form header menu nav".split())
BOILERPLATE_NAMES = frozenset(
    "ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice pager pagination popup promo promoted promotion related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar topbar widget widgets".split()
)
NEUTRAL_NAMES = frozenset("area bar block bottom body box container content form global inner item items left link links list main outer page panel primary right row secondary section site thread top unit wrap wrapper".split())
NEVER_BY_NAME = frozenset("html body main article".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose end tag may be missing; they end where one of the same kind or their parent ends.
OPTIONAL_END = frozenset("p li dt dd tr td th option optgroup thead tbody tfoot".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
INNER_TAGS = frozenset("blockquote dl figcaption figure ol pre table ul".split())
STOP_WORDS = frozenset(
    (
        "a about after all an and any are as at be been but by can could do for from had has have he her his how i if in into is it its more most no not of on one or other our out she so some such than that the their them then there these they this to up was we were what when which who will with would you your "
        "aber als am an auch auf aus bei bin bis das dass dem den der des die durch ein eine einem einen einer es für hat ich im in ist mit nach nicht noch nur oder sein sich sie sind so über um und uns von vor war was wenn wie wird zu zum zur "
        "au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas plus pour qu que qui sa se ses son sur un une vous "
        "al como con de del el ella en entre era es esta este fue ha la las le lo los más me no nos o para pero por que se si sin sobre su sus te un una y ya"
    ).split()
)

MIN_CONTENT_WORDS = 12
MIN_STOP_SHARE = 0.12
MAX_SPAM_SHARE = 0.02
#: How much more text than all the rest names must condemn to lose their say.
NAMES_LOSE = 3
MAX_LINK_SHARE = 0.5

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_HREF = re.compile(r"(?:^|[\s\"'])href\s*=", re.I)
_EMPTY = re.compile(r"(?:^|[\s\"'])/$")
_RAW_TAGS = frozenset("script style textarea title iframe noscript noframes template svg math select canvas".split())
_RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I) for tag in _RAW_TAGS | (SILENT_TAGS - VOID_TAGS - {"head"})}
_WORD = re.compile(r"[^\W\d_]+")

CONTENT, BOILERPLATE, UNDECIDED, SPAM = 1, 0, -1, 2


def boilerplate_name(name: str) -> bool:
    """Is a class, id or role wholly made of boilerplate words, and words that say nothing?"""
    parts = [x for x in re.split(r"[\W_\d]+", name.lower()) if x]
    return any(x in BOILERPLATE_NAMES for x in parts) and all(x in BOILERPLATE_NAMES or x in NEUTRAL_NAMES for x in parts)


class Element:
    __slots__ = ("bad", "container", "named", "tag")

    def __init__(self, tag: str, bad: bool, named: list, container: int):
        self.tag, self.bad, self.named, self.container = tag, bad, named, container


class Block:
    """A block: its text, characters of links, whether an element or a name condemns it, whether it is a heading, its container."""

    __slots__ = ("bad", "container", "heading", "inner", "linked", "named", "text")

    def __init__(self, text: str, linked: int, top: Element):
        self.text, self.linked, self.bad, self.container = text, linked, top.bad, top.container
        self.heading, self.inner = top.tag in HEADINGS, top.tag in INNER_TAGS
        self.named = top.named


class Blocks:
    """The blocks of one page."""

    def __init__(self, page: str):
        self.found: list[Block] = []
        self.parts: list[str] = []
        self.linked = 0
        self.stack = [Element("", False, [], 0)]
        self.made = self.articles = 0
        self.links = 0  # depth of the stack at which a link began; 0: none
        self.read(page)

    def end_block(self) -> None:
        if self.parts:
            text = " ".join(html.unescape("".join(self.parts)).split())
            if text:
                self.found.append(Block(text, self.linked, self.stack[-1]))
            self.parts, self.linked = [], 0

    def say(self, text: str) -> None:
        self.parts.append(text)
        if self.links:
            self.linked += len(text)

    def cut(self, k: int) -> None:
        """The element at k of the stack ends, with all in it; a link that began in it was never closed."""
        del self.stack[k:]
        if self.links > k:
            self.links = 0

    def open(self, tag: str, rest: str) -> None:
        if tag in BLOCK_TAGS:
            self.end_block()
            if tag in OPTIONAL_END:
                for k in range(len(self.stack) - 1, 0, -1):
                    if self.stack[k].tag == tag:
                        self.cut(k)
                        break
                    if self.stack[k].tag not in OPTIONAL_END and self.stack[k].tag in BLOCK_TAGS:
                        break
            elif self.stack[-1].tag == "p":
                self.cut(len(self.stack) - 1)
        elif tag == "br":
            self.parts.append(" ")
        if tag == "a":
            self.links = len(self.stack) if _HREF.search(rest) else 0
        elif tag in BLOCK_TAGS and tag not in VOID_TAGS and not _EMPTY.search(rest):
            top = self.stack[-1]
            if tag == "main" or (tag == "article" and not self.articles):  # what holds these is not judged by its name
                for e in self.stack:
                    e.named.clear()
            self.articles += tag == "article"
            bad = top.bad or tag in BOILERPLATE_TAGS or bool(rest and _HIDDEN.search(rest))
            own_header = tag == "header" and top.tag in ("article", "main") and not top.bad
            if own_header:
                bad = False  # an article's own header holds its heading
            named = top.named
            if rest and tag not in NEVER_BY_NAME and any(boilerplate_name(n) for m in _NAMES.finditer(rest) for n in m[1].strip("\"'").split()):
                named = [tag]
            if tag not in OPTIONAL_END and not own_header and tag not in HEADINGS and tag not in INNER_TAGS:
                self.made += 1
                container = self.made
            else:
                container = top.container
            self.stack.append(Element(tag, bad, named, container))

    def close(self, tag: str) -> None:
        if tag == "a":
            self.links = 0
        elif tag in BLOCK_TAGS:
            self.end_block()
            for k in range(len(self.stack) - 1, 0, -1):
                if self.stack[k].tag == tag:
                    self.cut(k)
                    break

    def read(self, page: str) -> None:
        at, n = 0, len(page)
        while at < n:
            m = _TOKEN.search(page, at)
            if not m:
                self.say(page[at:])
                break
            if m.start() > at:
                self.say(page[at : m.start()])
            at = m.end()
            tag = m[2]
            if tag:
                tag = tag.lower()
                if m[1]:
                    self.close(tag)
                elif tag in _RAW_END:
                    if tag in BLOCK_TAGS:
                        self.end_block()
                    end = _RAW_END[tag].search(page, at)
                    at = end.end() if end else n
                else:
                    self.open(tag, m[3])
        self.end_block()


def stop_share(text: str) -> tuple[int, float]:
    words = [w.lower() for w in _WORD.findall(text)]
    return len(words), sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


def first_pass(block: Block, names: bool = True) -> int:
    """A block's label by its elements, links, length and stop words; names count if asked."""
    if block.bad or (names and block.named) or block.linked > MAX_LINK_SHARE * len(block.text):
        return BOILERPLATE
    n, share = stop_share(block.text)
    if n < MIN_CONTENT_WORDS:
        return UNDECIDED
    if share >= MIN_STOP_SHARE:
        return CONTENT
    return SPAM if share < MAX_SPAM_SHARE and not block.inner else UNDECIDED


def second_pass(labels: list[int], containers: list[int], headings: list[bool]) -> list[bool]:
    """Undecided blocks take the label of their nearest decided neighbours, headings that of what follows.

    A long block without stop words stays only beside a content block of its own container.
    """
    n = len(labels)
    decided = [x in (CONTENT, BOILERPLATE) for x in labels]
    before, after = [-1] * n, [-1] * n
    last = -1
    for i in range(n):
        before[i] = last
        if decided[i]:
            last = i
    last = -1
    for i in range(n - 1, -1, -1):
        after[i] = last
        if decided[i]:
            last = i
    kept = []
    for i in range(n):
        if decided[i]:
            kept.append(labels[i] == CONTENT)
            continue
        near = [k for k in (before[i], after[i]) if k >= 0]
        good = [k for k in near if labels[k] == CONTENT]
        if labels[i] == SPAM:
            kept.append(any(containers[k] == containers[i] for k in good))
            continue
        same = any(containers[k] == containers[i] for k in good)
        follows = headings[i] and after[i] in good
        kept.append(not near or len(good) == len(near) or same or follows)
    return kept


def main_text(page: str | None) -> str:
    """The content blocks of a page, joined by an empty line."""
    if not page:
        return ""
    found = Blocks(page).found
    labels = [first_pass(x) for x in found]
    if CONTENT not in labels:  # a name may have condemned the article
        plain = [first_pass(x, False) for x in found]
        rest = sum(len(x.text) for x, label in zip(found, labels, strict=True) if label != BOILERPLATE)
        if sum(len(x.text) for x, label in zip(found, plain, strict=True) if label == CONTENT) > NAMES_LOSE * rest:
            labels = plain
    if CONTENT not in labels:  # a short page, or another language: blocks that nothing else speaks against
        labels = [CONTENT if x in (UNDECIDED, SPAM) else x for x in labels]
    kept = second_pass(labels, [x.container for x in found], [x.heading for x in found])
    return "\n\n".join(x.text for x, k in zip(found, kept, strict=True) if k)


EXTRACTED = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("text", T.StringType(), False), T.StructField("n_chars", T.LongType(), False)])
EXTRACTED_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: page_id, url, text, n_chars.

    Null or empty html: empty text. Ids and urls may be null, and rows may be repeated: each row is a page.
    Only the three named columns are read, so further ones may have any name. An empty table gives no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=EXTRACTED_ARROW)

    bound_batches(pages.sparkSession)
    return pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].alias("html")).mapInArrow(run, EXTRACTED)
