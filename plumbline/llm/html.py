"""Main text of web pages by composite text density."""

from __future__ import annotations

import html as entities
import math
import re
import zlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.values import col

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg object xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark output q rp rt ruby s"
    " samp small span strike strong sub sup time tt u var wbr".split()
)
#: Elements and roles that hold no part of an article.
ASIDE = frozenset("nav header footer aside form button select dialog menu head".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: Words of class names and ids (parted at case changes, digits and punctuation) that mark such elements.
MARKS = frozenset(
    "ad ads adv advert advertisement advertising banner sponsor sponsored promo promotion sidebar aside nav navbar"
    " navigation menu breadcrumb breadcrumbs footer masthead topbar cookie cookies consent gdpr notice newsletter"
    " subscribe subscription signup popup modal overlay share sharing social related recommended comment comments"
    " disqus respond replies pagination pager toolbar widget login".split()
)
#: Those of them that stand on lists of links. Where prose bears such a name (related work, a share price), it is text.
OF_LINKS = frozenset("nav navbar navigation menu breadcrumb breadcrumbs share sharing social related recommended pagination pager toolbar widget".split())
PROSE = re.compile(r"[.!?\u2026\u3002][\"'\u2019\u201d)\]]*(?:\s|\Z)")
#: Elements that hold whole pages or articles, whatever their classes say.
HOLDERS = frozenset("html body main article".split())
#: Beside the core, text with less than this share of its density sum is a notice.
NOTICE = 0.05
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag of the key ends an open element of the value, up to the nearest holder or table.
ENDS = {
    "li": ("li",),
    "dt": ("dt", "dd"),
    "dd": ("dt", "dd"),
    "tr": ("tr", "td", "th"),
    "td": ("td", "th"),
    "th": ("td", "th"),
    "option": ("option",),
}
SCOPE = frozenset("ul ol dl table div section article main body html".split())

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|[^>])*)(?:>|\Z)",
    re.DOTALL,
)
# A name is tried at its start only and taken whole, so that long runs without "=" are read once.
ATTRIBUTE = re.compile(r"(?<![^\s\"'/])([^\s=/\"'>]++)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.IGNORECASE) for t in RAW}


def bit(tag: str) -> int:
    return 1 << zlib.crc32(tag.encode("utf-8", "replace")) % 256


class Node:
    """A block, a link or a marked element; other inline elements leave only their text."""

    __slots__ = ("tag", "parent", "hidden", "open", "children", "own", "chars", "tags", "link_chars", "link_tags", "density", "density_sum")

    def __init__(self, tag: str, parent: Node | None, hidden: str = ""):
        self.tag, self.parent, self.hidden = tag, parent, hidden
        # Which tags are open, as bits by hash: what is not is not searched for.
        self.open = bit(tag) | (parent.open if parent else 0)
        self.children: list[Node | str] = []  # in page order
        self.own = self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.density_sum = 0.0


def marked(tag: str, attributes: str) -> str:
    """Why an element holds something else than article text: its tag or its attributes; empty if it doesn't."""
    if tag in ASIDE and tag != "form":
        return "tag"
    why = "form" if tag == "form" else ""
    if not attributes or tag in HOLDERS:
        return why
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id") and (said := MARKS.intersection(x.lower() for x in NAME_PARTS.findall(value))):
            why = why if why in ("form", "name") else "links" if said <= OF_LINKS else "name"
        value = value.strip().lower()
        if name == "role" and value in ROLES and value != tag or name == "aria-hidden" and value == "true":
            return "attribute"
        if name == "style" and "display:none" in value.replace(" ", ""):
            return "attribute"
    return "attribute" if re.search(r"(?:^|\s)hidden(?:\s|/|$)", ATTRIBUTE.sub(" ", attributes)) else why


def parse(page: str) -> Node:
    """A tree of elements; unclosed and stray tags are put right as far as text blocks need it."""
    root = here = Node("html", None)
    pos, n = 0, len(page)
    while m := TAG.search(page, pos):
        if m.start() > pos:
            here.children.append(entities.unescape(page[pos : m.start()]))
        pos = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                here.children.append(m[0][9:].removesuffix("]]>"))
            continue
        tag, attributes = m[2].lower(), m[3]
        inline = tag in INLINE
        if m[1]:
            if not here.open & bit(tag):
                continue
            at = here
            while at.tag != tag and at.parent is not None and not (inline and at.tag not in INLINE):
                at = at.parent
            if at.tag == tag and at.parent is not None:
                here = at.parent
            continue
        if tag == "br":
            here.children.append("\n")
            continue
        if tag in RAW:
            if tag == "svg" and attributes.endswith("/"):
                continue
            end = RAW_END[tag].search(page, pos)
            pos = end.end() if end else n
            continue
        why = marked(tag, attributes)
        if tag == "html" or inline and tag != "a" and not why:
            continue
        if not inline:
            # A block ends an open paragraph or heading, with the links that are open in it.
            at = here
            while at.tag in INLINE and at.parent is not None:
                at = at.parent
            if at.tag == "p" or at.tag in HEADINGS and (tag in HEADINGS or tag == "p"):
                here = at.parent
            if tag in ENDS and any(here.open & bit(t) for t in ENDS[tag]):
                at = here
                while at.parent is not None and at.tag not in SCOPE and at.tag not in ENDS[tag]:
                    at = at.parent
                while at.tag in ENDS[tag] and at.parent is not None:
                    here = at = at.parent
            if tag == "body":
                while here.parent is not None:
                    here = here.parent
        node = Node(tag, here, why)
        here.children.append(node)
        if tag in ("article", "main"):
            # A page's frame is not an aside, whatever it is called.
            at = here
            while at is not None:
                at.hidden = "" if at.hidden in ("attribute", "name", "links") else at.hidden
                # What is around an outer one has been shown with it.
                at = None if at.tag in ("article", "main") else at.parent
        if tag not in VOID and not (inline and attributes.endswith("/")):
            here = node
    if pos < n:
        here.children.append(entities.unescape(page[pos:]))
    return root


def unhide(body: Node) -> None:
    """Shows elements that their names hide wrongly.

    These are forms and named elements that hold most of the body's text, being its frame, and those with names of
    link lists that hold sentences, less than a third of them links.
    """
    nodes, todo = [], [body]
    while todo:
        node = todo.pop()
        nodes.append(node)
        todo.extend(c for c in node.children if isinstance(c, Node) and c.hidden in ("", "name", "links", "form"))
    chars: dict[int, tuple[int, int, bool]] = {}
    for node in reversed(nodes):
        n, links, prose = 0, 0, False
        for c in node.children:
            if isinstance(c, str):
                n += len("".join(c.split()))
                prose = prose or PROSE.search(c) is not None
            elif id(c) in chars:
                n, links, prose = (n + chars[id(c)][0], links + chars[id(c)][1], prose or chars[id(c)][2])
        chars[id(node)] = (n, n if node.tag == "a" else links, prose)
    for node in nodes:
        n, links, prose = chars[id(node)]
        if node.hidden and 2 * n > chars[id(body)][0] or node.hidden == "links" and prose and 3 * links < n:
            node.hidden = ""


def weigh(body: Node) -> list[Node]:
    """Densities and density sums of all nodes outside of marked elements, parents first."""
    nodes, todo = [], [body]
    while todo:
        node = todo.pop()
        nodes.append(node)
        todo.extend(c for c in reversed(node.children) if isinstance(c, Node) and not c.hidden)
    for node in reversed(nodes):
        for c in node.children:
            if isinstance(c, str):
                node.own += len("".join(c.split()))
            elif not c.hidden:
                node.chars += c.chars
                node.tags += c.tags + 1
                node.link_chars += c.link_chars
                node.link_tags += c.link_tags + (c.tag == "a")
        node.chars += node.own
        if node.tag == "a":
            node.link_chars = node.chars
    body_ratio = body.link_chars / max(body.chars, 1)
    for node in nodes:
        if node.chars:
            plain, tags = max(node.chars - node.link_chars, 1), max(node.tags, 1)
            base = math.log(node.chars / plain * node.link_chars + body_ratio * node.chars + math.e)
            ratio = node.chars / max(node.link_chars, 1) * tags / max(node.link_tags, 1)
            node.density = max(0.0, node.chars / tags * math.log(ratio) / base)
    for node in nodes:
        # Text of the node itself counts as it is.
        node.density_sum = node.own + sum(c.density for c in node.children if isinstance(c, Node) and not c.hidden)
    return nodes


def article_nodes(root: Node) -> list[Node]:
    """The subtrees that hold the article.

    Its core is the node of the highest density sum. If that lies in an article or main element, or around one that
    holds most of its text, alone or with others of like density beside it, the page says itself how far the article reaches. If not, the lowest density on the way from the body to the core is the
    threshold: beside that way, what is as dense, mostly no links and no mere notice (by its density sum) belongs
    to the article too, and so does a heading before it.
    """
    body = next((c for c in root.children if isinstance(c, Node) and c.tag == "body"), root)
    unhide(body)
    nodes = weigh(body)
    if not body.chars:
        return []
    core = max(nodes, key=lambda x: x.density_sum)
    path = [core]
    while path[-1] is not body:
        path.append(path[-1].parent)
    for holder in ("article", "main"):
        for node in path:
            if node.tag == holder:
                return [node]
        inside = [x for x in nodes if x.tag == holder and x.chars]
        if inside and core in outer(inside[0]):
            best = max(inside, key=lambda x: x.density_sum)
            # Parts of the article side by side are as dense, and together most of the core.
            parts = [x for x in inside if x.parent is best.parent and 2 * x.density >= best.density]
            if 2 * sum(x.chars for x in parts) > core.chars:
                return parts
    threshold = min(x.density for x in path)
    kept = [core]
    for inner, node in zip(path, path[1:], strict=False):
        before = True
        for c in node.children:
            if c is inner:
                before = False
            elif isinstance(c, Node) and not c.hidden and c.chars and 3 * c.link_chars < c.chars:
                dense = c.density >= threshold and c.density_sum >= NOTICE * core.density_sum
                if dense or before and c.tag in HEADINGS:
                    kept.append(c)
    return kept


def outer(node: Node) -> list[Node]:
    out = []
    while node.parent is not None:
        node = node.parent
        out.append(node)
    return out


def blocks(root: Node, kept: set[int]) -> list[str]:
    """Text blocks of the kept subtrees in page order: white space as one space, trimmed, none empty."""
    out: list[str] = []
    run: list[str] = []

    def close():
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            out.append(text)

    # (node or text, inside a kept subtree, leaving a block)
    todo: list[tuple] = [(root, False, False)]
    while todo:
        x, inside, leaving = todo.pop()
        if leaving:
            close()
        elif isinstance(x, str):
            if inside:
                run.append(x)
        elif not x.hidden:
            inside = inside or id(x) in kept
            if x.tag not in INLINE:
                close()
                todo.append((x, inside, True))
            todo.extend((c, inside, False) for c in reversed(x.children))
    close()
    return out


def main_text(page: str | None) -> list[str]:
    """Blocks of the article of a page."""
    if not page:
        return []
    root = parse(page)
    return blocks(root, {id(x) for x in article_nodes(root)})


@F.pandas_udf(T.ArrayType(T.StringType()))
def main_blocks(pages: pd.Series) -> pd.Series:
    return pd.Series([main_text(p) for p in pages], dtype=object)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """All rows and columns of ``pages`` with blocks (array of text) and text (blocks joined by a space).

    Every block and link gets a composite text density: characters per tag, lowered where much of it is link text,
    relative to the links of the whole body (inline markup is no tag here: bold words don't thin a paragraph).
    The element whose children's densities sum highest is the core of the article; see ``article_nodes``. Menus, headers, footers, sidebars, notices, adverts, forms,
    comments, scripts and styles are left out before, by element, role and the words of their class names.

    Null, empty and textless pages give no blocks and an empty text. Unclosed and cut-off pages are read as
    far as they go; repeated rows give repeated results. Columns of ``pages`` named blocks or text are replaced.
    """
    kept = [col(c) for c in pages.columns if c.lower() not in ("blocks", "text")]
    return pages.select(*kept, main_blocks(col(html)).alias("blocks")).withColumn("text", F.array_join("blocks", " "))
