"""Main text of web pages: structure rules within a page, and site templates found by counting subtrees per host."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmesh.llm.common import SMALL_ROWS, cut, text_of

#: A subtree is a site's template if so many pages of the host, of different text, hold it.
MIN_PAGES = 8
#: Templates of a host that its pages are compared with as one list; beyond that each page is joined to its own.
HOST_TEMPLATES = 5000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
#: Elements without main text.
DROPPED = frozenset("script style noscript template head title nav footer aside form button select option textarea iframe object embed svg math canvas audio video map dialog menu fieldset label input xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag of BLOCK ends an open p; these also end an open element of their kind, up to the list or table around it.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Words in class or id that name what is not main text, alone or together with each other and with words of place and form.
MARKED = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot banner banners breadcrumb breadcrumbs comment comments commentlist respond disqus discussion "
    "cookie cookies consent gdpr notice notices notification alert footer header masthead menu nav navbar navigation sidebar aside widget widgets related recommended "
    "share sharing social subscribe subscription newsletter popup modal overlay promo promotion sponsor sponsored signup login search toolbar pager pagination skip".split()
)
BESIDE = frozenset("site page main global top bottom left right side upper lower primary secondary list area box bar wrapper wrap container block section inner outer item items link links button buttons icon icons form slot unit posts articles stories".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
TAG = re.compile(r"""<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)""", re.S)
ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


class Node:
    __slots__ = ("tag", "attrs", "kids", "up")

    def __init__(self, tag: str, attrs: str = "", up: Node | None = None):
        self.tag, self.attrs, self.kids, self.up = tag, attrs, [], up


def parse(text: str) -> Node:
    """The tree of a page; strings are text as written. Never fails: what isn't a tag is text, what isn't closed ends with its parent."""
    root = here = Node("#root")
    at, end = 0, len(text)
    while at < end:
        m = TAG.search(text, at)
        if not m:
            here.kids.append(text[at:])
            break
        if m.start() > at:
            here.kids.append(text[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag, closing = name.lower(), m[1] or m[4]
        if closing:
            node = here
            while node is not root and node.tag != tag:
                if node.tag in ("td", "th", "table") and tag not in BLOCK and tag not in ("td", "th", "table"):
                    break
                node = node.up
            if node is not root and node.tag == tag:
                here = node.up
            continue
        if tag in BLOCK and tag not in ("html", "body", "head"):
            here = _closed(here, {"p"}, {"td", "th", "table", "button", "object"})
        if tag in SIBLINGS:
            here = _closed(here, *SIBLINGS[tag])
        attrs = m[3] if m[2] else m[6]
        node = Node(tag, attrs, here)
        here.kids.append(node)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|$)", re.I).search(text, at)
            stop = close.start() if close else end
            node.kids.append(text[at:stop])
            gt = text.find(">", stop) if close else -1
            at = gt + 1 if gt >= 0 else end
        elif tag not in VOID and not attrs.endswith("/") or tag in BLOCK and tag not in VOID:
            here = node
    return root


def _closed(here: Node, kinds: set[str], walls: set[str]) -> Node:
    """Where the tree goes on after closing the outermost open element of kinds inside the nearest wall."""
    node, out = here, here
    while node.up is not None and node.tag not in walls:
        if node.tag in kinds:
            out = node.up
        node = node.up
    return out


def marked(value: str) -> bool:
    """Whether a class or id names what is not main text: its parts at hyphens are all MARKED or BESIDE words, one MARKED.

    So cookie-notice and site-footer count, has-sidebar, entry-header, job-search and social-science don't.
    """
    parts = [p for p in re.split(r"[-_]+", value) if p and not p.isdigit()]
    return any(p in MARKED for p in parts) and all(p in MARKED or p in BESIDE for p in parts)


def unwanted(node: Node, in_article: bool) -> bool:
    """Whether structure rules drop the element. A header inside an article stays for its headings (see blocks)."""
    if node.tag in DROPPED:
        return True
    if node.tag == "header":
        return not in_article
    if not node.attrs or node.tag in ("html", "body", "main"):
        return False
    for m in ATTR.finditer(node.attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id") and any(map(marked, value.split())):
            return True
        if name == "role" and value.strip() in ROLES:
            return True
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def _roots(tree: Node) -> list[Node]:
    """The articles that aren't dropped nor inside another one; else the main element; else the whole page.

    If all articles and mains stand inside elements dropped by their class, id, role or style, those around them are
    not dropped: whatever holds the main text stays.
    """

    def found(dropped) -> list[Node]:
        articles, mains, stack = [], [], [tree]
        while stack:
            node = stack.pop()
            if node.tag == "article":
                articles.append(node)
                continue
            if node.tag == "main" or 'role="main"' in node.attrs:
                mains.append(node)
            stack += [k for k in reversed(node.kids) if isinstance(k, Node) and not dropped(k)]
        return articles or mains[:1]

    return found(lambda k: unwanted(k, False)) or found(lambda k: k.tag in DROPPED) or [tree]


def blocks(text: str) -> tuple[list[tuple[str, list[int]]], list[int]]:
    """The page's text blocks, each with the hashes of the element subtrees around it, and the hash of each subtree in page order.

    A subtree's hash covers its tag, its text without markup white space, and its children in order; the chosen root
    elements themselves are not counted, so a page that is copied whole is no template.
    """
    out: list[list] = []
    inside: list[Node] = []

    def flush(buf: list[str]) -> None:
        if (s := " ".join(entities.unescape("".join(buf)).split())):
            out.append([s, list(inside)])
        buf.clear()

    hashes: dict[int, int] = {}
    order: list[int] = []
    for root in _roots(parse(text)):
        buf: list[str] = []
        in_article = root.tag == "article"
        # (node, child index, digest, in a header)
        stack = [[root, 0, xxhash.xxh64(root.tag), False]]
        while stack:
            frame = stack[-1]
            node, k, digest, header = frame
            if k == len(node.kids):
                stack.pop()
                if node.tag in BLOCK:
                    flush(buf)
                if stack:
                    hashes[id(node)] = h = digest.intdigest() - (1 << 63)
                    order.append(h)
                    stack[-1][2].update(digest.digest())
                    inside.pop()
                continue
            frame[1] += 1
            kid = node.kids[k]
            if isinstance(kid, str):
                if not header or any(f[0].tag in HEADINGS for f in stack):
                    buf.append(kid)
                    digest.update(" ".join(kid.split()))
                continue
            if kid.tag in ("br", "td", "th", "wbr"):
                buf.append("" if kid.tag == "wbr" else " ")
            if unwanted(kid, in_article):
                if kid.tag in BLOCK:
                    flush(buf)
                continue
            if kid.tag in BLOCK:
                flush(buf)
            stack.append([kid, 0, xxhash.xxh64(kid.tag), header or kid.tag == "header"])
            inside.append(kid)
        flush(buf)
    return [(s, [hashes[id(n)] for n in nodes]) for s, nodes in out], order


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


SCHEMA = "page_id long, url string, _host string, _blocks array<struct<s:string,h:array<long>>>, _page long, _subs array<long>"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("_host", pa.string()), ("_blocks", pa.list_(pa.struct([("s", pa.string()), ("h", pa.list_(pa.int64()))]))), ("_page", pa.int64()), ("_subs", pa.list_(pa.int64()))])
    for batch in batches:
        rows = []
        for page, url, text in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "_t")), strict=True):
            found, order = blocks(text)
            with_text = {h for _, hs in found for h in hs}
            page_hash = xxhash.xxh64_intdigest("\n".join(s for s, _ in found).encode("utf-8", "replace")) - (1 << 63)
            rows.append({"page_id": page, "url": url, "_host": host_of(url), "_blocks": [{"s": s, "h": hs} for s, hs in found], "_page": page_hash, "_subs": list(with_text.intersection(order))})
        yield pa.RecordBatch.from_pylist(rows, kinds)


def templates(parsed: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(_on, _h): for each host the hashes of its template subtrees, a row each.

    A subtree counts by the pages of different text that hold it, wherever it stands, so copies of one article don't make
    its paragraphs a template. Neither copies nor the size of the host matter.
    """
    seen = parsed.select("_host", "_page", F.explode("_subs").alias("h")).distinct()
    subs = seen.groupBy("_host", "h").agg(F.count(F.lit(1)).alias("on")).filter(F.col("on") >= min_pages)
    return subs.select(F.col("_host").alias("_on"), F.col("h").alias("_h"))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every row of pages.

    Null and empty pages, and pages without text outside what is dropped, have the empty text. Urls that are null or have
    no host form one host. Repeated rows each give a row, an empty table none. Other columns are not read.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), text_of(html).alias("_t"))
    parsed = cut(rows.mapInArrow(_parse, SCHEMA).withColumn("_rid", F.monotonically_increasing_id()), "pages")
    found = cut(templates(parsed), "templates")
    by_host = found.groupBy("_on").agg(F.collect_list("_h").alias("_drop"))
    size = found.groupBy("_on").count().agg(F.sum("count"), F.max("count")).first()
    if (size[0] or 0) <= SMALL_ROWS and (size[1] or 0) <= HOST_TEMPLATES:
        out = parsed.join(F.broadcast(by_host), F.col("_host") == F.col("_on"), "left")
    else:  # each page meets just those templates that it holds
        held = parsed.select("_rid", "_host", F.explode("_subs").alias("h")).join(found, (F.col("_host") == F.col("_on")) & (F.col("h") == F.col("_h")))
        out = parsed.join(held.groupBy(F.col("_rid").alias("_r")).agg(F.collect_list("h").alias("_drop")), F.col("_rid") == F.col("_r"), "left")
    kept = F.when(F.col("_drop").isNull(), F.col("_blocks")).otherwise(F.filter("_blocks", lambda b: ~F.arrays_overlap(b["h"], "_drop")))
    out = out.select("page_id", "url", F.array_join(F.transform(kept, lambda b: b["s"]), "\n\n").alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
