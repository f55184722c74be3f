"""Main text of web pages by composite text density."""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import slices, texts

#: A comment, a tag whose quoted values may hold ``>``, a tag that ends at the next ``>``, or a declaration.
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?][^>]*+>", re.S)
PLAIN_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>()()()|<[!?][^>]*+>", re.S)
#: After so many tags whose quotes do not end, quotes no longer count, so that a page is read a bounded number of times.
OPEN_QUOTES = 16
ATTRIBUTE = re.compile(r"\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
#: A slash that ends the tag, not an unquoted value.
SELF_CLOSED = re.compile(r"(?:^|[\s\"'])/\Z")
# fixed values: element and class names of HTML pages
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea select title svg object".split())
#: Of these, what no end tag closes goes on to the end of the page; other ``RAW`` elements are then as good as empty.
ENDLESS = frozenset("script style textarea title iframe".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul caption".split())
ENDS_P = BLOCK - {"body", "html", "option", "optgroup", "legend", "caption", "tbody", "tfoot", "thead", "tr"}
SAME_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("html body table ul ol dl article section main div td th".split())
NOISE_TAGS = frozenset("nav footer aside form button dialog menu head".split())
NOISE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar footer cookie cookies "
    "consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments "
    "disqus respond reply replies discussion pagination pager toolbar masthead complementary contentinfo search".split()
)
#: Words that say nothing of what a block holds; a name of these and at least one noise word is a noise name.
NEUTRAL_NAMES = frozenset("a area bar block body bottom box button buttons col column container content foot form group head header inner item items js left links list main message outer page panel primary right row secondary section site slot text thread title top unit widget wrap wrapper".split())
#: Readers' comments can be most of a page; any other block that holds most of its text is the article, whatever its name.
COMMENT_NAMES = frozenset("comment comments disqus respond reply replies discussion".split())
PAGE_HEADER = frozenset({"header", "topbar"})
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
CONTENT = frozenset({"article", "main"})


@dataclass(slots=True)
class Node:
    """An element; ``parts`` are its texts and children in page order."""

    tag: str
    parent: Node | None
    names: frozenset[str] = frozenset()
    hidden: bool = False
    parts: list[str | Node] = field(default_factory=list)
    noise: bool = False
    chars: int = 0
    tags: int = 0
    link_chars: int = 0
    link_tags: int = 0
    density: float = 0.0
    total: float = 0.0

    def children(self) -> Iterator[Node]:
        return (p for p in self.parts if isinstance(p, Node))


def _noise_name(name: str) -> bool:
    """Whether a class, id or role names noise as a whole: ``ad``, ``cookie-notice``, ``nav_list``, but not ``ad-free`` or ``search-intro``."""
    words = [w for w in re.split(r"[^a-z]+", name) if w]
    return any(w in NOISE_NAMES for w in words) and all(w in NOISE_NAMES or w in NEUTRAL_NAMES for w in words)


def _attributes(raw: str) -> tuple[frozenset[str], bool]:
    """The classes, ids and roles of a tag, and whether it is hidden."""
    names, hidden = [], False
    if raw:
        for m in ATTRIBUTE.finditer(raw):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key in ("class", "id", "role"):
                names += value.split()
            elif key == "style":
                hidden |= "display:none" in value.replace(" ", "")
            elif key == "hidden":
                hidden = True
            else:
                hidden |= value == "true"
    return frozenset(names), hidden


def _close(node: Node, tags: tuple[str, ...]) -> Node:
    """The parent of the nearest open element of ``tags``, if nothing that bounds it is in between; else the node itself."""
    at: Node | None = node
    while at is not None and at.parent is not None:
        if at.tag in tags:
            return at.parent
        if at.tag in SCOPE:
            break
        at = at.parent
    return node


def parse(page: str) -> tuple[Node, list[Node]]:
    """The tree of a page and its nodes in page order. Tags that nothing opened are left out, open ones end with the page."""
    root = Node("html", None)
    nodes, now, at, open_tags = [root], root, 0, {"html": 1}

    def text_up_to(end: int) -> None:
        if end > at:
            now.parts.append(html.unescape(page[at:end]))

    end_of_tags, endless, pattern, unquoted = page.rfind(">") + 1 or page.find("<!--") + 1 and len(page), set(), TAG, 0
    if "<!--" in page[end_of_tags:]:
        end_of_tags = len(page)
    while at < end_of_tags and (m := pattern.search(page, at, end_of_tags)):
        text_up_to(m.start())
        at = m.end()
        if m[5]:
            unquoted += 1
            if unquoted >= OPEN_QUOTES:
                pattern = PLAIN_TAG
        name = (m[2] or m[5] or "").lower()
        if not name or name == "html":
            continue
        if m[1] or m[4]:
            if open_tags.get(name):
                while now.tag != name:
                    open_tags[now.tag] -= 1
                    now = now.parent
                open_tags[name] -= 1
                now = now.parent or root
            continue
        if name in RAW:
            if SELF_CLOSED.search(m[3] or m[6] or ""):
                continue
            end = None if name in endless else re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            if end:
                at = end.end()
            else:
                endless.add(name)  # nor does a later one end
                if name in ENDLESS:
                    at = len(page)
            continue
        if name in ENDS_P or name in SAME_ENDS:
            before = now
            if name in ENDS_P and open_tags.get("p"):
                now = _close(now, ("p",))
            if name in SAME_ENDS:
                now = _close(now, SAME_ENDS[name])
            while before is not now:
                open_tags[before.tag] -= 1
                before = before.parent
        names, hidden = _attributes(m[3] or m[6] or "")
        node = Node(name, now, names, hidden)
        now.parts.append(node)
        nodes.append(node)
        if name not in VOID and not (m[3] or m[6] or "").endswith("/"):
            now = node
            open_tags[name] = open_tags.get(name, 0) + 1
    text_up_to(len(page))
    return root, nodes


def _mark_noise(nodes: list[Node]) -> None:
    """Mark what is no article by its element, or by its names, unless it holds several paragraphs and over half of the page's plain text."""
    plain: dict[int, int] = {}
    paragraphs: dict[int, int] = {}
    holds: set[int] = set()
    for n in reversed(nodes):
        own = 0 if n.tag == "a" or n.tag in NOISE_TAGS else plain.get(id(n), 0) + sum(len(p.strip()) for p in n.parts if isinstance(p, str))
        plain[id(n)] = own
        if n.parent is not None:
            plain[id(n.parent)] = plain.get(id(n.parent), 0) + own
            paragraphs[id(n.parent)] = paragraphs.get(id(n.parent), 0) + paragraphs.get(id(n), 0) + (n.tag == "p")
        if n.tag in CONTENT and not any(map(_noise_name, n.names)):
            holds.add(id(n))
        if id(n) in holds and n.parent is not None:
            holds.add(id(n.parent))
    whole = plain[id(nodes[0])]
    inside: set[int] = set()
    for n in nodes:
        if n.parent is not None and (id(n.parent) in inside or n.parent.tag in CONTENT):
            inside.add(id(n))
        if n.parent is None or n.parent.noise:
            n.noise = n.parent is not None
        elif n.tag in NOISE_TAGS or n.hidden:
            n.noise = True
        elif id(n) not in holds and n.tag != "body":
            named = [x for x in n.names if _noise_name(x)]
            comments = any(w in COMMENT_NAMES for x in named for w in re.split(r"[^a-z]+", x))
            article = 2 * plain[id(n)] > whole and paragraphs.get(id(n), 0) > 1
            n.noise = bool(named) and (comments or not article) or id(n) not in inside and bool(n.tag == "header" or n.names & PAGE_HEADER)


def _measure(nodes: list[Node]) -> None:
    """Characters, tags, link characters and link tags of each subtree, noise left out; then densities and their sums."""
    for n in reversed(nodes):
        if n.noise:
            continue
        n.chars += sum(len(" ".join(p.split())) for p in n.parts if isinstance(p, str))
        if n.tag == "a":
            n.link_chars, n.link_tags = n.chars, n.link_tags + 1
        if n.parent is not None:
            up = n.parent
            up.chars += n.chars
            up.tags += n.tags + 1
            up.link_chars += n.link_chars
            up.link_tags += n.link_tags
    body = next((n for n in nodes if n.tag == "body" and not n.noise), nodes[0])
    ratio = body.link_chars / max(1, body.chars)
    for n in nodes:
        if not n.noise and n.chars:
            plain = max(1, n.chars - n.link_chars)
            base = math.log(n.chars / plain * n.link_chars + ratio * n.chars + math.e)
            weight = n.chars / max(1, n.link_chars) * (max(1, n.tags) / max(1, n.link_tags))
            # the base is above e for pages with links; the logarithm's base falls to 1 with no links at all
            n.density = n.chars / max(1, n.tags) * math.log(max(weight, 1.0)) / max(math.log(base), 1e-9) if base > 1.0001 else n.chars / max(1, n.tags) * math.log(max(weight, 1.0))
            if n.parent is not None:
                n.parent.total += n.density


def _article(nodes: list[Node]) -> list[Node]:
    """The subtrees that make up the article, in page order.

    The subtree of the largest density sum sets the threshold: the least density on its way to the body. From the
    body down, each subtree that reaches it gives its own subtree of the largest sum; a subtree under it gives
    nothing. What is found inside an article element that reaches the threshold is widened to that element. Between
    two parts of the article that are siblings, and as a heading before the first, what is no list of links stays.
    """
    body = next((n for n in nodes if n.tag == "body" and not n.noise), nodes[0])
    held = [n for n in nodes if not n.noise and n.chars]
    best = max(held, key=lambda n: n.total, default=None)
    if best is None:
        return []
    path = [best]
    while path[-1] is not body and path[-1].parent is not None:
        path.append(path[-1].parent)
    threshold = min(n.density for n in path)
    top: dict[int, Node] = {id(n): n for n in held}
    around: dict[int, Node] = {}
    for n in held:
        up = around.get(id(n.parent)) if n.parent is not None else None
        if up is not None or n.tag == "article" and n.density >= threshold:
            around[id(n)] = up or n
    for n in reversed(held):
        for c in n.children():
            if id(c) in top and top[id(c)].total > top[id(n)].total:
                top[id(n)] = top[id(c)]
    kept: dict[int, Node] = {}
    left = [body]
    while left:
        n = left.pop()
        if id(n) in top and n.density >= threshold:
            part = around.get(id(top[id(n)]), top[id(n)])
            kept[id(part)] = part
            if top[id(n)] is not n and id(n) not in around:
                left += n.children()
    _join(kept)
    within: set[int] = set()
    out = []
    for n in held:
        if n.parent is not None and id(n.parent) in within:
            within.add(id(n))
        elif id(n) in kept:
            within.add(id(n))
            out.append(n)
    return out


def _join(kept: dict[int, Node]) -> None:
    """Add what stands between kept siblings, and headings right before them."""
    parents = {id(n.parent): n.parent for n in kept.values() if n.parent is not None}
    for parent in parents.values():
        children = [c for c in parent.children() if not c.noise and c.chars]
        at = [k for k, c in enumerate(children) if id(c) in kept]
        for a, b in zip(at, at[1:], strict=False):
            between = children[a + 1 : b]
            if all(2 * c.link_chars <= c.chars for c in between):
                kept.update((id(c), c) for c in between)
        first = at[0]
        while first and children[first - 1].tag in HEADINGS:
            first -= 1
            kept[id(children[first])] = children[first]


def main_text(page: str) -> str:
    """The article of a page: its blocks, white space collapsed, two line feeds between them. Without text it is empty."""
    _, nodes = parse(page)
    _mark_noise(nodes)
    _measure(nodes)
    blocks: list[list[str]] = [[]]
    stack: list[str | Node | None] = [p for n in reversed(_article(nodes)) for p in (None, n)]
    while stack:
        part = stack.pop()
        if part is None:
            blocks.append([])
        elif isinstance(part, str):
            blocks[-1].append(part)
        elif not part.noise:
            inner: list[str | Node | None] = list(part.parts)
            if part.tag in BLOCK:
                inner = [None, *inner, None]
            elif part.tag in ("br", "td", "th"):
                inner = [" ", *inner]
            stack += reversed(inner)
    joined = (" ".join("".join(b).split()) for b in blocks)
    return "\n\n".join(b for b in joined if b)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(id, url, text, n_chars)`` of every row, from the whole html.

    Null and empty pages have the empty text; a page without tags is one block. Null ids and urls stay, repeated
    rows give a row each, other columns are not read, and an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [main_text(t) for t in texts(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], ["id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, "id long, url string, text string, n_chars long")
