"""HTML main text by tag-path ratios.

A page becomes blocks of text, each with its root-to-leaf path of structural tags (with classes).
Text length, punctuation and link text are aggregated per path; a path's ratios (length per block
and punctuation per block) are smoothed over neighbouring blocks in page order, fused by their
product, and paths over a share of the best one are content.  The content root is the
article or main element that holds most of the content, or else the deepest element outside of which
there is no content and no heading; its blocks are the article, but for blocks in menus, headers,
footers, sidebars, notices, adverts, forms and comments, which are known by tag, role or class, and,
where the root is no article or main, paths that are mostly links (``h1`` stays).

A class or id marks an element by a whole name, by a name's leading part, or by its last part for
page structure (``site-footer``, but not ``has-sidebar``).  Marks of ``form`` and of classes but for
comments are weak: the page's largest article or main clears those above it, and an element that
holds most of the page's text loses its own unless there is an article or much other text beside it.

Defined results: null, empty and text-free pages give an empty text; broken markup is closed as
browsers do; a ``br`` is white space; repeated rows stay repeated; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML and words of class names.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "select", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "ruby", "rt", "rp", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
BAD_TAGS = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "head", "button"}
BAD_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar"}
BAD_WORDS = {
    "ad", "ads", "advert", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus",
    "footer", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pagination", "popup", "promo", "related",
    "replies", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}
WEAK, STRONG = 1, 2
COMMENTS = {"comment", "comments", "disqus", "replies"}
STRUCTURE = {"footer", "header", "menu", "nav", "navbar", "navigation", "sidebar"}
NEGATIONS = {"has", "is", "no", "not", "with", "without"}
#: What an opening tag closes, up to the container that stops the search.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}

# quotes count straight after an equals sign only
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|[^>])*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*(?:=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]*)))?")
PUNCTUATION = re.compile(r"[.,;:!?…。，、！？]")


@dataclass
class Node:
    tag: str
    parent: int
    mark: int  # own: 0 none, WEAK or STRONG
    label: str
    bad: int = 0  # with what it inherits


@dataclass
class Block:
    node: int
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def named(name: str) -> int:
    """The mark of one class name or id."""
    if name in COMMENTS:
        return STRONG
    parts = [x for x in re.split(r"[^a-z]+", name) if x]
    if not parts:
        return 0
    return WEAK if name in BAD_WORDS or parts[0] in BAD_WORDS or (parts[-1] in STRUCTURE and NEGATIONS.isdisjoint(parts)) else 0


def described(attributes: str) -> tuple[str, int]:
    """Class names, and how class, id or role mark what is not content."""
    label, mark = "", 0
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "").lower()
        if name not in ("class", "id", "role"):
            continue
        if name == "class":
            label = value
        if name == "role":
            mark = max(mark, (WEAK if value == "form" else STRONG) if value in BAD_ROLES else 0)
        else:
            mark = max([mark, *map(named, value.split())])
    return label, mark


def resolve(nodes: list[Node], blocks: list[Block]) -> None:
    """Marks as inherited, without the weak ones that would cost the page's main text."""
    n = len(nodes)
    size, end = [0] * n, list(range(1, n + 1))
    for b in blocks:
        size[b.node] += len(b.text)
    own = size[:]
    for i in range(n - 1, 0, -1):  # children follow their parents
        up = nodes[i].parent
        size[up] += size[i]
        end[up] = max(end[up], end[i])
    articles = [i for i in range(n) if nodes[i].tag in ("article", "main") and size[i]]
    largest = max(articles, key=size.__getitem__, default=0)

    def inherit() -> None:
        for i in range(1, n):
            above = nodes[nodes[i].parent].bad
            nodes[i].bad = 0 if nodes[i].tag == "body" else max(nodes[i].mark, 0 if i == largest and above == WEAK else above)

    inherit()
    for i in range(1, n):
        if nodes[i].mark == WEAK and nodes[i].bad == WEAK and not nodes[nodes[i].parent].bad and size[i] * 2 > size[0]:
            beside = sum(own[j] for j in range(n) if not i <= j < end[i] and not nodes[j].bad)
            other = any(not nodes[j].bad and (end[j] <= i or j >= end[i]) for j in articles)
            if beside * 4 < size[i] and not other:
                nodes[i].mark = 0
                inherit()


def parse(page: str) -> tuple[list[Node], list[Block]]:
    nodes, blocks, stack = [Node("", -1, 0, "")], [Block(0)], [0]
    links = at = 0

    def block() -> None:
        if blocks[-1].parts:
            blocks.append(Block(stack[-1]))
        blocks[-1].node = stack[-1]

    def say(text: str) -> None:
        if text:
            blocks[-1].parts.append(text)
            if links:
                blocks[-1].linked += len(text)

    while at < len(page):
        less = page.find("<", at)
        if less < 0:
            say(html.unescape(page[at:]))
            break
        match = TOKEN.match(page, less)
        if match is None:
            say(html.unescape(page[at : less + 1]))
            at = less + 1
            continue
        say(html.unescape(page[at:less]))
        at, (closing, tag) = match.end(), match.group(1, 2)
        if tag is None:
            continue
        tag = tag.lower()
        if tag in RAW and not closing:
            if not match.group(3).endswith("/"):
                end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            say(" ")
        elif tag in INLINE:
            if tag == "a":
                links = 0 if closing else 1
        elif tag in VOID:
            if tag == "hr":
                block()
            else:
                say(" ")
        elif closing:
            if tag in ("body", "html"):
                continue
            found = next((i for i in range(len(stack) - 1, 0, -1) if nodes[stack[i]].tag == tag), 0)
            if found:
                del stack[found:]
                links = 0
                block()
        else:
            if nodes[stack[-1]].tag == "p" or (nodes[stack[-1]].tag[:1] == "h" and nodes[stack[-1]].tag[1:].isdigit() and tag[:1] == "h" and tag[1:].isdigit()):
                stack.pop()
            if nodes[stack[-1]].tag == "head" and tag == "body":
                stack.pop()
            if tag in CLOSES:
                own, stop = CLOSES[tag]
                for i in range(len(stack) - 1, 0, -1):
                    if nodes[stack[i]].tag in stop:
                        break
                    if nodes[stack[i]].tag in own:
                        del stack[i:]
                        break
            label, mark = described(match.group(3))
            up = stack[-1]
            if tag in ("html", "body", "article", "main"):
                mark = 0
            if tag in BAD_TAGS:
                mark = max(mark, WEAK if tag == "form" else STRONG)
            nodes.append(Node(tag, up, mark, label))
            stack.append(len(nodes) - 1)
            links = 0
            block()
    for b in blocks:
        b.text = " ".join("".join(b.parts).split())
    blocks = [b for b in blocks if b.text]
    resolve(nodes, blocks)
    return nodes, blocks


def main_text(page: str | None, share: float = 0.1) -> str:
    """The article of a page, blocks joined by newlines."""
    nodes, blocks = parse(page or "")
    blocks = [b for b in blocks if not nodes[b.node].bad]
    if not blocks:
        return ""
    paths: dict[int, str] = {}

    def path(i: int) -> str:
        chain, j = [], i
        while j > 0 and j not in paths:
            chain.append(j)
            j = nodes[j].parent
        text = paths.get(j, "")
        for k in reversed(chain):
            # a digest keeps deep paths small
            text = paths[k] = str(hash((text, nodes[k].tag, nodes[k].label)))
        return text

    totals: dict[str, list[float]] = {}
    for b in blocks:
        t = totals.setdefault(path(b.node), [0, 0, 0, 0])
        for i, x in enumerate((len(b.text), len(PUNCTUATION.findall(b.text)) + 1, min(b.linked, len(b.text)), 1)):
            t[i] += x
    raw = [(t[0] / t[3], t[1] / t[3]) for t in (totals[path(b.node)] for b in blocks)]
    fused = []
    for i in range(len(blocks)):
        near = raw[max(0, i - 1) : i + 2]
        fused.append(sum(x[0] for x in near) / len(near) * sum(x[1] for x in near) / len(near))
    top = max(fused)
    linky = {p for p, t in totals.items() if t[2] * 2 > t[0]}
    weight = [len(b.text) if f >= share * top and path(b.node) not in linky else 0 for b, f in zip(blocks, fused, strict=True)]
    if not any(weight):
        weight = [len(b.text) for b in blocks]
    inside = [0] * len(nodes)
    for b, w in zip(blocks, weight, strict=True):
        tag = nodes[b.node].tag
        inside[b.node] += len(b.text) if tag == "h1" or tag in HEADINGS and path(b.node) not in linky else w
    for i in range(len(nodes) - 1, 0, -1):  # children follow their parents
        inside[nodes[i].parent] += inside[i]
    containers = {"p", "li", "td", "th", "tr", "blockquote", "pre", "ul", "ol", "dl", *HEADINGS}
    # the topmost article or main with most of the content
    root = next((i for i in range(1, len(nodes)) if nodes[i].tag in ("article", "main") and inside[i] * 2 > inside[0] and not nodes[i].bad), 0)
    article = root > 0
    if not article:
        for i in range(1, len(nodes)):
            if nodes[i].parent == root and inside[i] == inside[0] and nodes[i].tag not in containers and not nodes[i].bad:
                root = i
    holds = [False] * len(nodes)
    for i in range(len(nodes)):
        holds[i] = i == root or (i > 0 and holds[nodes[i].parent])
    return "\n".join(b.text for b in blocks if holds[b.node] and (article or nodes[b.node].tag == "h1" or path(b.node) not in linky))


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(id, url, text, n_chars)`` of every row."""
    source = pages.select(F.col(id_col).cast("bigint").alias(id_col), F.col(url_col).cast("string").alias(url_col), F.col(html_col).cast("string").alias("html"))

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = [main_text(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    return source.mapInArrow(run, f"`{id_col}` bigint, `{url_col}` string, text string, n_chars bigint")
