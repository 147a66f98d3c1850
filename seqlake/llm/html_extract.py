"""Main text of web pages by composite text density.

A page becomes a tree. Each node's composite density weighs its characters per
tag against the characters and tags of its links; the node whose children's
densities sum highest holds the article. The least density on the path from it
to the body is what blocks beside that path must reach to be read too. Class and
id words that notices, adverts or comments often bear don't decide: characters
in their block count less, and its density must reach the same threshold.
"""

from __future__ import annotations

import html as entities
import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of the HTML standard and common words in class and id names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math canvas object video audio noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
NOT_TEXT = frozenset("head title nav header footer aside form button select option textarea input fieldset menu dialog".split()) | RAW
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adbox adsense sponsor sponsored promo promotion banner "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside rail widget widgets "
    "footer masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login "
    "share sharing social related recommended recommendations trending popular pagination pager skip "
    "comment comments commentlist disqus respond replies reply disclaimer legal copyright".split()
)
CONTENT_WORDS = frozenset("article story post entry content main text body news".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog alertdialog menu menubar toolbar form status".split())
#: What a character in a block with such words counts.
DOUBTED = 0.05
#: Elements whose class and id words are not looked at: text itself, or what holds all of it.
UNDOUBTED = INLINE | frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre article main body html".split())
#: Elements that are parts of a text: the block around them is the text.
TEXT_PARTS = INLINE | frozenset("p li dt dd ul ol dl h1 h2 h3 h4 h5 h6 hgroup blockquote pre figure figcaption address tr tbody thead tfoot table caption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
ALIKE = {"li": ("li", ("ul", "ol", "menu")), "option": ("option", ("select",)), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table"))}

_NAME_END = re.compile(r"[\s/>]|\Z")
#: The rest of a tag with balanced quotes; each part is taken for good, so a failure costs one pass.
_REST = re.compile(r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_QUOTE = re.compile(r"[>\"']")
#: Numbers of character references: leading zeros, and numbers beyond Unicode, whose digits Python may refuse to read.
_ZEROS = re.compile(r"(&#)0+(?=[0-9])|(&#[xX])0+(?=[0-9a-fA-F])")
_BEYOND_UNICODE = re.compile(r"&#(?:[0-9]{8,}|[xX][0-9a-fA-F]{7,});?")
_NAMED = re.compile(r"\b(class|id|role|aria-hidden|hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I | re.S)
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


class Markup:
    """Comments, declarations and tags of a page in order, each character looked at a bounded number of times."""

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.closes: tuple[list[int], list[int]] | None = None
        self.name_end = 0  # no space, slash or bracket stands between the last name's start and here

    def _close(self, start: int) -> int:
        """Where the ``>`` is that ends a tag whose name ends at ``start``, outside quotes; -1 if there is none."""
        if start > self.last:
            return -1
        if self.closes is None:
            m = _REST.match(self.page, start)
            if m is not None:
                return m.end() - 1
            # Such a tag runs to the page's end. One pass from there tells for every place where a tag from it on ends.
            marks = [m.start() for m in _QUOTE.finditer(self.page)]
            out = double = single = -1
            ends = [0] * len(marks)
            for i in range(len(marks) - 1, -1, -1):
                c = self.page[marks[i]]
                if c == ">":
                    out = marks[i]  # within quotes it is a character like others
                elif c == '"':
                    out, double = double, out
                else:
                    out, single = single, out
                ends[i] = out
            self.closes = marks, ends
        marks, ends = self.closes
        i = bisect_left(marks, start)
        return ends[i] if i < len(marks) else -1

    def next(self, pos: int) -> tuple[int, int, bool, str | None, str] | None:
        """(start, end, whether an end tag, name or None for no tag, attributes) of the first markup from ``pos`` on."""
        page = self.page
        while True:
            start = page.find("<", pos)
            if start < 0:
                return None
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                return start, end + 3 if end >= 0 else len(page), False, None, ""
            if page.startswith(("<!", "<?"), start):
                if start < self.last:
                    return start, page.find(">", start) + 1, False, None, ""
            else:
                closing = page.startswith("</", start)
                name = start + 1 + closing
                if name <= self.last and page[name].isascii() and page[name].isalpha():
                    if name >= self.name_end:
                        self.name_end = _NAME_END.search(page, name).start()
                    end = self._close(self.name_end)
                    if end >= 0:
                        return start, end + 1, closing, page[name : self.name_end].lower(), page[self.name_end : end]
            pos = start + 1


#: For each kind of element that ends others of its kind: which it ends, and beyond which ancestors none.
_GROUPS = list(dict.fromkeys(ALIKE.values()))
_GROUP = {tag: _GROUPS.index(x) for tag, x in ALIKE.items()}
_ENDED = {tag: {i for i, (ends, _) in enumerate(_GROUPS) if tag in ends.split()} for ends, _ in _GROUPS for tag in ends.split()}
_BEYOND = {tag: {i for i, (_, stop) in enumerate(_GROUPS) if tag in stop} for _, stop in _GROUPS for tag in stop}


class Node:
    """An element. What the parser would look for among its ancestors stands in it: the open paragraph that only inline
    elements part it from, the outermost element that a next one of each group ends, inline elements open in its block,
    and whether an article or main element holds it."""

    __slots__ = ("tag", "up", "parts", "noise", "weight", "chars", "tags", "link_chars", "link_tags", "density", "total", "paragraph", "ended", "inline", "in_article")

    def __init__(self, tag: str, up: Node | None, noise: bool, doubted: bool = False):
        self.tag, self.up, self.noise = tag, up, noise
        flows = tag in INLINE and up is not None
        self.paragraph: Node | None = self if tag == "p" else up.paragraph if flows else None
        self.inline: dict[str, int] = up.inline if flows else {}
        self.in_article: bool = tag in ("article", "main") or up is not None and up.in_article
        self.ended: tuple = up.ended if up is not None else (None,) * len(_GROUPS)
        if tag in _ENDED or tag in _BEYOND:
            self.ended = tuple(None if i in _BEYOND.get(tag, ()) else x or (self if i in _ENDED.get(tag, ()) else None) for i, x in enumerate(self.ended))
        self.weight: float = (up.weight if up is not None else 1.0) * (DOUBTED if doubted else 1.0)
        self.parts: list = []
        self.chars = self.link_chars = 0.0
        self.tags = self.link_tags = 0
        self.density = self.total = 0.0


def _is_noise(tag: str, attributes: str, up: Node) -> bool:
    """Whether the element's kind, role or visibility says that it holds no article text."""
    if tag == "header" and up.in_article:
        return False  # the article's own heading
    if tag in NOT_TEXT:
        return True
    if not attributes.strip() or tag in ("body", "html", "article", "main"):
        return False
    for name, *values in _NAMED.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if name == "role":
            if value.strip() in NOISE_ROLES:
                return True
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def _is_doubted(tag: str, attributes: str) -> bool:
    """Whether a block's class or id has a word of noise and none of content."""
    if not attributes.strip() or tag in UNDOUBTED:
        return False
    for name, *values in _NAMED.findall(attributes):
        if name.lower() in ("class", "id"):
            words = set(_WORD.findall("".join(values).lower()))
            if words & {"has", "with", "no"} or words & CONTENT_WORDS:
                continue  # says what lies inside or is missing, or that it is text
            if words & NOISE_WORDS or "header" in words:
                return True
    return False


def parse(page: str) -> Node:
    """The page's tree, in time linear in the page's length however broken it is.

    Unclosed elements end where the standard ends them; stray end tags are
    dropped, as is a tag whose quotes or brackets never close.
    """
    root = Node("html", None, False)
    at, pos, size = root, 0, len(page)
    markup, open_ = Markup(page), {}
    head = False

    def enter(child: Node) -> Node:
        open_[child.tag] = open_.get(child.tag, 0) + 1
        if child.tag in INLINE:
            child.inline[child.tag] = child.inline.get(child.tag, 0) + 1
        return child

    def leave(to: Node) -> Node:
        """``to``, with all elements from the present one up to it closed."""
        n = at
        while n is not to:
            open_[n.tag] -= 1
            if n.tag in INLINE:
                n.inline[n.tag] -= 1
            n = n.up
        return to

    while pos < size:
        m = markup.next(pos)
        if m is None:
            at.parts.append(page[pos:])
            break
        start, end, closing, tag, attributes = m
        if start > pos:
            at.parts.append(page[pos:start])
        pos = end
        if tag is None:
            continue
        if closing:
            # An inline end tag doesn't reach out of a block.
            if (at.inline if tag in INLINE else open_).get(tag):
                found = at
                while found.tag != tag:
                    found = found.up
                at = leave(found.up)
            elif tag == "head":
                head = False
            elif tag == "p":
                at.parts.append(Node("p", at, False))
            continue
        if tag in RAW or tag == "title" or tag == "textarea":
            if attributes.endswith("/"):
                continue
            child = Node(tag, at, True)
            at.parts.append(child)
            m = re.compile(rf"</{re.escape(tag)}\b", re.I).search(page, pos)
            close = page.find(">", m.end()) if m is not None else -1
            pos = close + 1 if close >= 0 else size
            continue
        if tag in ("html", "head", "body"):
            if tag == "body" or tag == "head":
                to = at
                while to is not root and to.tag != "html":
                    to = to.up
                at = leave(to)
                child = Node(tag, at, tag == "head")
                at.parts.append(child)
                at = enter(child)
                head = tag == "head"
            continue
        if head and tag not in ("meta", "link", "base"):
            at = leave(root)
            head = False
        if tag in CLOSES_P:
            # an open paragraph ends here, with the inline elements in it
            if at.paragraph is not None:
                at = leave(at.paragraph.up)
        elif tag in _GROUP:
            ended = at.ended[_GROUP[tag]]
            if ended is not None:
                at = leave(ended.up)
        child = Node(tag, at, _is_noise(tag, attributes, at), _is_doubted(tag, attributes))
        at.parts.append(child)
        if tag not in VOID and not attributes.endswith("/"):
            at = enter(child)
    return root


def _nodes(root: Node) -> list[Node]:
    """All nodes that may hold article text, parents first; noise counts for nothing, nor does what lies in it."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        out.append(n)
        todo += [p for p in reversed(n.parts) if type(p) is not str and not p.noise]
    return out


def _density(chars: float, tags: int, link_chars: float, link_tags: int, page_ratio: float) -> float:
    c, t, lc, lt = chars, max(tags, 1), max(link_chars, 1), max(link_tags, 1)
    base = math.log(c * link_chars / max(c - link_chars, 1) + page_ratio * c + math.e)
    return c / t * math.log(max(c / lc * t / lt, 1.0)) / math.log(base) if base > 1 else c / t


def _measure(nodes: list[Node], body: Node) -> float:
    """Characters, tags and link shares below each node, then composite densities and their sums over children.

    Returns the body's share of characters in links.
    """
    for n in reversed(nodes):
        n.chars += n.weight * sum(len(_SPACE.sub("", p)) for p in n.parts if type(p) is str)
        if n.tag == "a":
            n.link_chars, n.link_tags = n.chars, n.tags + 1
        if n.up is not None:
            n.up.chars += n.chars
            n.up.tags += n.tags + 1
            n.up.link_chars += n.link_chars
            n.up.link_tags += n.link_tags
    page_ratio = body.link_chars / max(body.chars, 1)
    for n in reversed(nodes):
        if n.chars:
            n.density = _density(n.chars, n.tags, n.link_chars, n.link_tags, page_ratio)
        if n.up is not None:
            n.up.total += n.density
    return page_ratio


def _keep(node: Node, below: Node | None, threshold: float, page_ratio: float, whole: bool) -> None:
    """Leaves in ``node`` its part on the path, ``below``, and what beside it is dense enough.

    Text and inline elements between two blocks are judged together. Of a
    ``whole`` text only thin blocks that are mostly links go. Elsewhere a
    heading stays before what stays, an h1 that is no link always.
    """
    units: list[list] = []
    loose = False
    for p in node.parts:
        flows = type(p) is str or p.tag in INLINE and p is not below
        if flows and loose:
            units[-1].append(p)
        else:
            units.append([p])
        loose = flows
    kept: list = []
    follows = False  # whether the next block that isn't a heading stays
    for unit in reversed(units):
        first = unit[0]
        inner = [p for p in unit if type(p) is not str and not p.noise]
        chars = node.weight * sum(len(_SPACE.sub("", p)) for p in unit if type(p) is str) + sum(p.chars for p in inner)
        if first is below or type(first) is not str and first.tag == "body":
            stays = follows = True
        elif not chars:
            stays = True
        else:
            link_chars = sum(p.link_chars for p in inner)
            stays = _density(chars, sum(p.tags + 1 for p in inner) if len(unit) > 1 or not inner else first.tags, link_chars, sum(p.link_tags for p in inner), page_ratio) >= threshold
            flows = type(first) is str or first.tag in INLINE
            if whole:
                stays = stays or flows or 2 * link_chars <= chars
            elif not flows and first.tag in HEADINGS:
                stays = follows or first.tag == "h1" and 2 * link_chars <= chars
                kept.append(unit if stays else [])
                continue
            follows = stays
        kept.append(unit if stays else [])
    node.parts = [p for unit in reversed(kept) for p in unit]


def main_node(root: Node) -> Node:
    """The body, or the root, with only the node whose children's densities sum highest and the blocks beside its path that are as dense as the path."""
    nodes = _nodes(root)
    body = next((n for n in nodes if n.tag == "body"), root)
    page_ratio = _measure(nodes, body)
    best = max(nodes, key=lambda n: n.total)
    if best.total <= 0:
        return body if body.chars else root
    if best is root and body.chars == root.chars:
        best = body
    top, threshold = best, best.density
    while top is not body and top.up is not None:
        top = top.up
        threshold = min(threshold, top.density)
    while best is not top and best.tag in TEXT_PARTS:
        best = best.up
    # A doubted block off the path must reach the threshold wherever it lies.
    above = {id(top)}
    up = best
    while up is not top:
        above.add(id(up))
        up = up.up
    for n in nodes:
        if n.weight < 1 and id(n) not in above and (n.up is None or n.weight < n.up.weight) and n.density < threshold:
            n.noise = True
    if best is top:
        _keep(top, None, threshold, page_ratio, True)
        return top
    path = [best]
    while path[-1] is not top:
        path.append(path[-1].up)
    # What an article or main element holds is its text, so that an article split over sections stays whole.
    whole = max((i for i, n in enumerate(path) if n.tag in ("article", "main")), default=-1)
    for i in range(1, len(path)):
        _keep(path[i], path[i - 1], threshold, page_ratio, i <= whole)
    return top


def _blocks(node: Node) -> Iterator[str]:
    """The text of each block in page order, white space made one space."""
    todo: list = [(node, 0)]
    run: list[str] = []
    while todo:
        n, i = todo.pop()
        if i == 0 and n.tag not in INLINE or n.tag == "br":
            yield "".join(run)
            run = []
        while i < len(n.parts):
            p = n.parts[i]
            i += 1
            if type(p) is str:
                run.append(p)
            elif not p.noise:
                todo += [(n, i), (p, 0)]
                break
        else:
            if n.tag not in INLINE:
                yield "".join(run)
                run = []
    yield "".join(run)


def _decoded(text: str) -> str:
    """``text`` with its character references decoded; a number beyond Unicode becomes U+FFFD, however long it is."""
    if "&#" in text:
        text = _BEYOND_UNICODE.sub("\ufffd", _ZEROS.sub(lambda m: m[1] or m[2], text))
    return entities.unescape(text)


def main_text(page: str | None) -> str:
    """The article's text: blocks joined by one space, references decoded, nothing cut."""
    if not page:
        return ""
    node = main_node(parse(page))
    out = []
    for block in _blocks(node):
        if block:
            text = _SPACE.sub(" ", _decoded(block)).strip()
            if text:
                out.append(text)
    return " ".join(out)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, len(batch), 256):
            part = batch.slice(lo, 256)
            texts = [main_text(x.as_py()) for x in part.column(2)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row of ``pages`` (page_id, url, html).

    Null and empty html, and pages without article text, give an empty text.
    Rows with the same page_id are pages of their own; null ids and urls stay
    null. Of subtrees with equal sums the first in page order is taken. A page
    of any length is read whole; it must fit in a task. An empty table gives no
    rows. Other columns, whatever their names, are ignored. Each row is read
    alone: no shuffle.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_run, "page_id long, url string, text string, n_chars long")
