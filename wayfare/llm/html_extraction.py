"""Main-text extraction from raw HTML with site template removal.

Templates.  Every element subtree of a page is hashed (tag, attributes,
text); Spark counts for each host on how many pages a subtree occurs.  A
subtree that recurs on at least ``MIN_PAGES`` pages and ``MIN_SHARE`` times
the root of its host's number of pages is a template of that host and is
deleted: the menus, banners and boxes that no markup names.  The share asked
falls with the host's size (9 of 320 pages, 500 of a million), so the
templates of sections, languages and layouts count too.  Pages of one host
with the same content (the text that structure alone leaves) count as one, so
copies of a page cannot make its text a template; links inside an article
are counted on every page.  What the page itself marks as the article is
held apart: sites republish paragraphs and whole pages, so inside an article
a recurring subtree goes only if it is a block of blocks (a list, a box) of
mostly links, or a block whose whole text is links, but no heading.  Inline
elements never go out of running text: not inside an article, and elsewhere
not out of a block that has words besides links.

Structure.  Of the rest, elements that can hold no article text go by tag
(scripts, forms, navigation, page headers, footers, asides, ...), by role,
by being hidden, or by a class or id that names a menu, notice, advert,
comment section and the like.  Inside an article a name counts only as a whole
(``share-buttons``, not ``share-price``), and takes a paragraph, heading or
list item with it only if it is mostly links or the name is that of adverts,
comments or consent.  The text is that of the page's articles, or of its
``main`` if it has none; if it has both and none of the articles lies within
``main``, of both; of the whole body if it has neither.

Text.  Character references are decoded, white space within a block becomes
one space, blocks are trimmed and joined by one line feed in page order,
empty ones left out.  Nothing else is dropped or shortened.

A host's templates are bounded: at most root(pages) / MIN_SHARE times as many
as a page has subtrees on average.  The table of all hosts is broadcast if its measured size allows;
else pages meet it by host and salt, at least as many salts as there are
shuffle partitions, so a host with a third of all pages spreads over all.

Defined results: a null or empty html gives an empty text; broken, unclosed
and truncated markup is read as far as it goes; a null url counts as one
unnamed host; repeated rows are extracted alike and counted each; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import BROADCAST_BYTES, checkpointed
from wayfare.llm.url_filter import url_parts

MIN_PAGES = 5
#: Share of a host's pages, divided by the root of their number.
MIN_SHARE = 0.5
LINK_SHARE = 0.5
SALTS = 16

MAIN = re.compile(r"(?:^|\s)role\s*=\s*[\"']?\s*main\b", re.I)
MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|<(?P<close2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<rest2>[^>]*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search "
    "section summary table tbody tfoot thead tr ul".split())
CELLS = frozenset("td th br".split())
#: Elements that an opening tag of the first kind closes, if open within the same container.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
          "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"),
          "tfoot": ("tr", "td", "th", "tbody"), "body": ("head",)}
CONTAINERS = frozenset("ul ol dl table select div article section main body td th blockquote aside nav".split())

# What holds no article text.
NOT_TEXT = frozenset(
    "head script style noscript template nav footer aside form menu dialog button select textarea input iframe object "
    "embed svg math canvas audio video map title noembed noframes search datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads adsense advert adverts advertisement advertising adbox adslot banner breadcrumb breadcrumbs comment comments "
    "consent cookie cookies copyright disqus footer gdpr header masthead menu modal nav navbar navigation newsletter "
    "notice notices overlay pager pagination paywall popup promo promotion related recommended respond share sharing "
    "sidebar signup skiplink social sponsor sponsored subscribe subscription toolbar widget widgets".split())
#: Words that a name may have besides, and names that no paragraph of an article has.
FILLERS = frozenset(
    "area articles bar block blocks body bottom box buttons container content form icons inner inline item items left link "
    "links list module news outer panel posts right section slot stories thread tools top unit wrap wrapper".split())
STRONG = frozenset(
    "ad ads adsense advert adverts advertisement advertising adbox adslot comment comments consent cookie cookies disqus gdpr "
    "newsletter paywall sponsored subscribe subscription".split())
PARAGRAPHS = frozenset("p blockquote pre h1 h2 h3 h4 h5 h6 li dt dd td th caption figcaption".split())
KEPT_WHOLE = frozenset("html body main article".split())
HEADINGS = frozenset("header masthead banner".split())
TITLES = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
NOT_PREFIX = frozenset("with has no without".split())


class Node:
    __slots__ = ("tag", "attributes", "children", "parent", "hash", "letters", "link_letters", "has_blocks", "is_main", "in_article")

    def __init__(self, tag: str, attributes: str, parent: Node | None):
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.children: list = []
        self.hash = self.letters = self.link_letters = 0
        self.has_blocks = False
        self.is_main = tag in ("article", "main") or bool(attributes) and MAIN.search(attributes) is not None
        self.in_article = parent is not None and (parent.in_article or parent.is_main)

    def close(self) -> None:
        """Hash and text length from the closed children."""
        parts = [self.tag, self.attributes]
        for c in self.children:
            if isinstance(c, str):
                parts.append(" ".join(c.split()))
                self.letters += len(parts[-1])
            else:
                parts.append(f"\x00{c.hash}")
                self.letters += c.letters
                self.link_letters += c.link_letters
                self.has_blocks = self.has_blocks or c.has_blocks or c.tag in BLOCK
        if self.tag == "a":
            self.link_letters = self.letters
        self.hash = xxhash.xxh64_intdigest("\x01".join(parts).encode("utf-8", "surrogatepass")) - (1 << 63)


def parse(source: str) -> Node:
    """The element tree; unclosed elements end with their container, stray end tags are passed over."""
    at = root = Node("#root", "", None)
    pos, lower = 0, None

    def end(to: Node) -> Node:
        """Close everything from the current element up to and including ``to``."""
        node = at
        while True:
            node.close()
            if node is to:
                return node.parent
            node = node.parent

    while pos < len(source):
        m = MARKUP.search(source, pos)
        if m is None:
            at.children.append(source[pos:])
            break
        if m.start() > pos:
            at.children.append(source[pos:m.start()])
        pos = m.end()
        tag = m["tag"] or m["tag2"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["close"] or m["close2"]:
            node = at
            while node is not root and node.tag != tag:
                node = node.parent
            if node is not root:
                at = end(node)
            elif tag in BLOCK:
                at.children.append(Node(tag, "", at))      # a stray end tag still ends a block
                at.children[-1].close()
            continue
        closes = CLOSES.get(tag, ())
        if tag in BLOCK or closes:
            node, target = at, None
            while node is not root:
                if node.tag in closes or (node.tag == "p" and tag in BLOCK):
                    target = node
                if node.tag in CONTAINERS and node.tag not in closes:
                    break
                node = node.parent
            if target is not None:
                at = end(target)
        rest = m["rest"] if m["tag"] else m["rest2"]
        node = Node(tag, " ".join(rest.split()).rstrip("/ "), at)
        at.children.append(node)
        if tag in VOID:
            node.close()
        elif tag in RAW:
            lower = source.lower() if lower is None else lower
            stop = lower.find(f"</{tag}", pos) if len(lower) == len(source) else source.find(f"</{tag}", pos)
            stop = len(source) if stop < 0 else stop
            node.children.append(source[pos:stop])
            node.close()
            close = source.find(">", stop)
            pos = len(source) if close < 0 else close + 1
        else:
            at = node
    end(root)
    return root


def _walk(root: Node) -> Iterator[Node]:
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack.extend(c for c in node.children if not isinstance(c, str))


def subtree_hashes(root: Node) -> set[int]:
    """Hashes of the subtrees that may be templates: with text, outside the article or of links."""
    return {n.hash for n in _walk(root) if _may_go(n)}


def counted_hashes(root: Node) -> Iterator[tuple[int, int | None]]:
    """(hash, content) of ``subtree_hashes``: the page's content, or None for links inside an article."""
    text = main_text(root)
    content = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)
    inside = {n.hash for n in _walk(root) if n.in_article and _may_go(n)}
    for h in subtree_hashes(root):
        yield h, None if h in inside else content


def _may_go(node: Node) -> bool:
    return bool(node.letters) and node.tag not in KEPT_WHOLE and node.tag != "#root" and not node.is_main and _removable(node)


def _removable(node: Node) -> bool:
    if node.in_article:
        return (node.tag in BLOCK and node.tag not in TITLES
                and (node.link_letters > LINK_SHARE * node.letters if node.has_blocks else node.link_letters == node.letters))
    if node.tag in BLOCK or node.has_blocks:
        return True
    block = node.parent
    while block.parent is not None and block.tag not in BLOCK:
        block = block.parent
    return block.has_blocks or block.link_letters == block.letters or block.letters == node.letters


def _boilerplate(node: Node) -> bool:
    """Whether tag, role, visibility, class or id say that this is no article text."""
    if node.tag in NOT_TEXT:
        return True
    if node.tag == "header" and not node.in_article:
        return True
    if not node.attributes or node.tag in KEPT_WHOLE:
        return node.tag == "article" and _named(node, frozenset(("comment", "comments")))
    values = {k.lower(): html.unescape(a or b or c) for k, a, b, c in ATTRIBUTE.findall(node.attributes)}
    if "hidden" in values or values.get("aria-hidden", "").lower() == "true":
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", values.get("style", ""), re.I):
        return True
    return values.get("role", "").lower() in ROLES or _named(node, NAMES, values)


def _named(node: Node, names: frozenset, values: dict | None = None) -> bool:
    """A class or id whose first or last word is one of ``names``; inside an article all its words must be names or fillers."""
    if values is None:
        values = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(node.attributes)}
    for name in f"{values.get('class', '')} {values.get('id', '')}".split():
        words = [w for w in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()) if w]
        if not words or words[0] in NOT_PREFIX:
            continue
        if not node.in_article:
            if {words[0], words[-1]} & names:
                return True
            continue
        hit = (set(words) & names) - HEADINGS
        if not hit or set(words) - names - FILLERS:
            continue
        running = node.tag in PARAGRAPHS or node.tag not in BLOCK
        if not running or hit & STRONG or node.link_letters > LINK_SHARE * node.letters:
            return True
    return False


def main_text(root: Node, templates: frozenset | set = frozenset()) -> str:
    """Text of the main content without boilerplate and template subtrees."""
    chosen: list[tuple[str, Node]] = []             # in page order
    nested = False                                  # an article lies within ``main``
    dropped: set[int] = set()
    stack = [(root, None)]
    while stack:
        node, inside = stack.pop()
        if _boilerplate(node) or (node.hash in templates and _may_go(node)):
            dropped.add(id(node))
            continue
        kind = "article" if node.tag == "article" else "main" if node.is_main else None
        if kind and inside != kind and not (inside == "article"):
            chosen.append((kind, node))
            nested = nested or (kind == "article" and inside == "main")
            inside = kind
        stack.extend((c, inside) for c in reversed(node.children) if not isinstance(c, str))
    blocks: list[str] = []
    buffer: list[str] = []

    def flush() -> None:
        text = " ".join("".join(buffer).split())
        if text:
            blocks.append(text)
        buffer.clear()

    for top in [n for kind, n in chosen if kind == "article" or not nested] or [root]:
        walk: list = [top]
        while walk:
            item = walk.pop()
            if item is None:
                flush()
            elif isinstance(item, str):
                buffer.append(html.unescape(item))
            elif id(item) not in dropped:
                if item.tag in BLOCK:
                    flush()
                    walk.append(None)
                elif item.tag in CELLS:
                    buffer.append(" ")
                walk.extend(reversed(item.children))
            elif item.tag in BLOCK:
                flush()
        flush()
    return "\n".join(blocks)


def templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, url_col: str = "url",
              html_col: str = "html") -> DataFrame:
    """(host, templates array<long>): the template subtrees of every host that has any."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(host, *h) for host, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist())
                     for h in ((0, None), *(counted_hashes(parse(source)) if source else ()))]    # 0 counts the page itself
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.string(), pa.int64(), pa.int64()))],
                                                 names=["host", "hash", "content"])

    counts = (pages.select(url_parts(f"`{url_col}`")[0], F.col(f"`{html_col}`").alias("html"))
              .mapInArrow(hashes, "host string, hash long, content long")
              .groupBy("host", "hash", "content").agg(F.count("*").alias("pages"))
              .groupBy("host", "hash").agg(F.sum(F.when(F.col("content").isNull(), F.col("pages")).otherwise(1)).alias("n")))
    by_host = counts.groupBy("host").agg(F.max(F.when(F.col("hash") == 0, F.col("n"))).alias("pages"))
    return (counts.filter((F.col("hash") != 0) & (F.col("n") >= min_pages)).join(by_host, "host")
            .filter(F.col("n") >= min_share * F.sqrt("pages"))
            .groupBy("host").agg(F.collect_list("hash").alias("templates")))


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, id_col: str = "page_id",
            url_col: str = "url", html_col: str = "html", limit: int = BROADCAST_BYTES) -> DataFrame:
    """(id, url, text, n_chars) of every page.

    The template table is measured.  Up to ``limit`` bytes it is broadcast and
    pages are not moved; beyond, pages are joined to it by host and salt.
    """
    page = pages.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{url_col}`").alias("_url"), F.col(f"`{html_col}`").alias("_html"),
                        url_parts(f"`{url_col}`")[0])
    found = checkpointed(templates(pages, min_pages, min_share, url_col, html_col))
    size = found.agg(F.sum(F.lit(64) + F.length("host") + 8 * F.size("templates")).alias("n")).first()["n"] or 0
    if size <= limit:
        known = page.join(F.broadcast(found), "host", "left")
    else:
        salts = max(SALTS, int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        page = page.withColumn("salt", F.pmod(F.xxhash64("_id", "_url"), F.lit(salts)).cast("int"))
        known = page.join(salted, ["host", "salt"], "left")

    def texts(hosts: pd.Series, sources: pd.Series, templates: pd.Series) -> pd.Series:
        sets: dict[str, frozenset] = {}                        # one set a host and batch
        out = []
        for host, s, t in zip(hosts, sources, templates):
            if host not in sets:
                sets[host] = frozenset(()) if t is None else frozenset(t.tolist())
            out.append(main_text(parse(s), sets[host]) if s else "")
        return pd.Series(out, dtype=object)

    return (known.withColumn("_text", F.pandas_udf(texts, "string")("host", "_html", "templates"))
            .select(F.col("_id").alias(id_col), F.col("_url").alias(url_col), F.col("_text").alias("text"),
                    F.length("_text").cast("long").alias("n_chars")))
