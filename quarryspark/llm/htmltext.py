"""HTML extraction by tree scoring.

A page is parsed into a tree in one pass. Paragraphs pass points for their length and commas to their
ancestors, the whole to the parent and shrinking parts further up; a container's points are discounted by
its share of link text. The best container (or the article or main element around it) is kept, with those
siblings that score a fair share of it or read like paragraphs; menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles and reader comments are left out wherever they are: by their elements, and by
words in class, id or role; inside an article only by whole names. Time is linear in the page, depth included.

Defined results: a null or empty page has the empty text; a page without a paragraph that earns points
keeps its article, main or body element; an unfinished tag or comment at the end is dropped, and elements
left open end with the page; repeated rows are alike; an empty table gives no rows; other columns are kept, but for
those whose names the results take.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Attributes as browsers read them: a quote counts only right after "=", and stands for itself elsewhere. A quoted
#: value that never ends is read as one without quotes. The quantifiers never give back: each tag is read once.
_NAME = r"[^\s/>=][^\s/>=]*+"
_VALUE = r"""(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+))"""
_TAG = re.compile(rf"""<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|=?{_NAME}(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))?+|=)*+)>""")
_COMMENT_END = re.compile("--!?>")
_ATTRIBUTE = re.compile(rf"""=?({_NAME})(?:\s*+=\s*+{_VALUE})?""")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript textarea title iframe template svg math xmp noembed object".split())
_BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
_DROPPED = frozenset("nav header footer aside form script style noscript template iframe svg math object select button input textarea title head dialog menu".split())
_POINTED = frozenset("p pre blockquote li td dd h2 h3 h4 h5 h6".split())
#: (elements, scope): a new element closes the outermost open one of its kind inside the scope. By tag, the place there.
_ENDED = (({"li"}, {"ul", "ol", "menu"}), ({"dt", "dd"}, {"dl"}), ({"tr", "td", "th"}, {"table"}), ({"td", "th"}, {"tr", "table"}))
_CLOSES = {"li": 0, "dt": 1, "dd": 1, "tr": 2, "td": 3, "th": 3}
#: Words in class, id or role that mark parts other than the article.
_UNWANTED = frozenset("ad ads adv advert adverts advertisement advertising adsense banner banners breadcrumb breadcrumbs combx comment comments complementary consent contentinfo cookie cookies discuss discussion disqus disclaimer footer footnav gdpr header masthead menu menus modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promotion promoted recommended related replies reply respond search share sharing shoutbox sidebar sidebars skyscraper social sponsor sponsored subscribe subscription tags toolbar widget widgets".split())
_WANTED_ROOTS = ("article", "main")


class _Node:
    __slots__ = ("tag", "parent", "children", "dropped", "points", "chars", "link_chars", "inner", "paragraph", "around", "inline")

    def __init__(self, tag, parent, dropped):
        self.tag, self.parent, self.dropped = tag, parent, dropped
        self.children: list = []  # nodes and texts
        self.points, self.chars, self.link_chars = 0.0, 0, 0
        # What would else be looked for up the tree, at each tag: whether the node is in an article or main element,
        # the paragraph that a block would end, the outermost open elements that others of their kind end, and the
        # numbers of open inline elements by tag since the last block.
        if parent is None:
            self.inner, self.paragraph, self.around, self.inline = False, None, (None,) * len(_ENDED), {}
            return
        self.inner = parent.inner or tag in _WANTED_ROOTS
        if tag in _BLOCKS:
            self.paragraph, self.inline = self if tag == "p" else None, {}
            self.around = tuple(None if tag in scope else x or (self if tag in ended else None) for x, (ended, scope) in zip(parent.around, _ENDED, strict=True))
        else:
            self.paragraph, self.inline, self.around = parent.paragraph, parent.inline, parent.around
            self.inline[tag] = self.inline.get(tag, 0) + 1


def _words(value: str) -> set[str]:
    return {w for w in re.split(r"[^a-z]+", value) if w}


def _unwanted(tag: str, attributes: str, inner: bool) -> bool:
    """Whether an element is no part of an article. ``inner``: inside an article or main element, only whole class
    names count ("share", not "market-share"), and of ids and roles as well."""
    if tag in _DROPPED:
        return not (tag == "header" and inner)  # the head of an article isn't the head of the page
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), next((unescape(x) for x in m.group(2, 3, 4) if x is not None), "").lower()
        if name in ("class", "id", "role", "aria-label"):
            if not _UNWANTED.isdisjoint(value.split() if inner else _words(value)) or inner and any(len(w) > 1 and w <= _UNWANTED for w in map(_words, value.split())):
                return True
        elif name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def parse(html: str) -> _Node:
    """The tree of a page; what is never article text is marked as dropped, or is left out altogether. Each tag costs
    the same however deep it stands: nodes know what else would be searched for, and what is climbed is closed."""
    root = node = _Node("html", None, False)
    opened: dict[str, int] = {}
    raw_end: dict[str, int] = {}  # raw elements that are known not to end any more
    at, size = 0, len(html)

    def closed_to(up):
        """Closes all elements from the current one up to, and without, ``up``."""
        nonlocal node
        while node is not up:
            opened[node.tag] -= 1
            if node.tag not in _BLOCKS:
                node.inline[node.tag] -= 1
            node = node.parent

    look = 0  # text begins at ``at``; marks are looked for from ``look``
    while True:
        look = html.find("<", look)
        after = html[look + 1 : look + 3] if look >= 0 else ""
        if look >= 0 and not (after[:1].isascii() and after[:1].isalpha() or after[:1] in ("/", "!", "?")):
            look += 1  # a sign, not a tag
            continue
        end = look if look >= 0 else size
        if end > at and not node.dropped:
            node.children.append(unescape(html[at:end]))
        if look < 0:
            break
        m = None
        if html.startswith("<!--", look):
            close = _COMMENT_END.search(html, look + 2)
            at = close.end() if close else size
        elif after[:1] in ("!", "?") or after[:1] == "/" and not (after[1:].isascii() and after[1:].isalpha()):
            at = html.find(">", look) + 1 or size
        else:
            m = _TAG.match(html, look)
            at = m.end() if m else size  # a tag that never ends takes the rest, as in browsers
        look = at
        if not m:
            continue
        tag = m[2].lower()
        if m[1]:
            # An end tag closes up to its element; one of an inline element (but a link) never ends a block.
            if opened.get(tag) and (tag in _BLOCKS or tag == "a" or node.inline.get(tag)):
                up = node
                while up.tag != tag:
                    up = up.parent
                closed_to(up.parent)
            elif tag in ("p", "br") and not opened.get(tag):
                node.children.append(_Node(tag, node, node.dropped))
                if tag != "p":
                    node.inline[tag] -= 1
            continue
        if tag in ("html", "body"):
            continue
        bare = m[3].rstrip().endswith("/")
        if tag in _RAW:
            if not bare and raw_end.get(tag) != -1:
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(html, at)
                if not close:
                    raw_end[tag] = -1
                look = at = close.end() if close else size
            continue
        if tag in _BLOCKS and node.paragraph:  # a block ends an open paragraph, with the inline elements in it
            closed_to(node.paragraph.parent)
        if tag in _CLOSES and (last := node.around[_CLOSES[tag]]):
            closed_to(last.parent)
        new = _Node(tag, node, node.dropped or _unwanted(tag, m[3], node.inner))
        node.children.append(new)
        if tag in _VOID or bare:
            if tag not in _BLOCKS:
                new.inline[tag] -= 1
        else:
            opened[tag] = opened.get(tag, 0) + 1
            node = new
    return root


def _measure(node: _Node, in_link: bool = False) -> None:
    """Characters and link characters below each node; points from its paragraphs. Iterative: trees may be deep."""
    order, todo = [], [(node, in_link)]
    while todo:
        n, linked = todo.pop()
        order.append((n, linked))
        for c in n.children:
            if isinstance(c, _Node) and not c.dropped:
                todo.append((c, linked or c.tag == "a"))
    commas: dict[int, int] = {}
    for n, linked in reversed(order):
        own, marks = 0, 0
        for c in n.children:
            if isinstance(c, str):
                own += len(c.strip())
                marks += c.count(",") + c.count("、") + c.count("，")
            elif not c.dropped:
                own += c.chars
                marks += commas[id(c)]
                n.link_chars += c.link_chars
        n.chars, commas[id(n)] = own, marks
        if linked:
            n.link_chars = own
        if n.tag in _POINTED and own >= 25:
            gain = (1.0 + marks + own / 100.0) * (1.0 - n.link_chars / own)
            share, up = 1.0, n.parent
            while up and share > 0.05:
                up.points += gain * share
                share, up = share * 0.5, up.parent


def _score(node: _Node) -> float:
    return node.points * (1.0 - node.link_chars / node.chars) if node.chars else 0.0


def _find(root: _Node, tags) -> _Node | None:
    found, todo = None, [root]
    while todo:
        n = todo.pop()
        if n.tag in tags and (found is None or n.chars > found.chars):
            found = n
        todo += [c for c in n.children if isinstance(c, _Node) and not c.dropped]
    return found


def _best(root: _Node) -> list[_Node]:
    """The best container and those of its siblings that are kept, in page order."""
    best, todo = None, [root]
    while todo:
        n = todo.pop()
        if n.points and (best is None or _score(n) > _score(best)):
            best = n
        todo += [c for c in n.children if isinstance(c, _Node) and not c.dropped]
    if best is None:
        return [_find(root, ("article",)) or _find(root, ("main",)) or root]
    up, around = best, None
    while up:
        if up.tag in _WANTED_ROOTS and around is None:
            around = up
        up = up.parent
    if around:
        return [around]
    if best.parent is None:
        return [best]
    least = max(10.0, 0.2 * _score(best))
    kept = []
    for c in best.parent.children:
        if isinstance(c, _Node) and not c.dropped:
            links = c.link_chars / c.chars if c.chars else 1.0
            reads = c.tag in ("p", "pre", "blockquote", "h1", "h2", "h3") and c.chars and links < 0.25
            if c is best or _score(c) >= least or reads:
                kept.append(c)
    return kept


def _blocks(nodes: list[_Node]) -> list[str]:
    """Texts of the blocks in page order, white space made single and trimmed; none is empty."""
    out: list[str] = []
    now: list[str] = []

    def flush():
        if text := " ".join("".join(now).split()):
            out.append(text)
        now.clear()

    todo: list = list(reversed(nodes))
    while todo:
        n = todo.pop()
        if n is None:
            flush()
        elif isinstance(n, str):
            now.append(n)
        elif n.tag == "br":
            now.append(" ")
        elif not n.dropped:
            if n.tag in _BLOCKS:
                flush()
                todo.append(None)
            todo += reversed(n.children)
    flush()
    return out


def main_text(html: str | None) -> str:
    """The article's text of one page: blocks joined by newlines."""
    if not html:
        return ""
    root = parse(html)
    _measure(root)
    return "\n".join(_blocks(_best(root)))


def extract(pages: DataFrame, html: str = "html", text: str = "text", chars: str = "n_chars") -> DataFrame:
    """``pages`` without ``html``, with the main text and its number of code points."""
    others = [c for c in pages.columns if c not in (html, text, chars)]
    kinds = [T.StructField(f.name, f.dataType) for f in pages.schema if f.name in others]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # pages can be large
                part = batch.slice(at, 256)
                texts = [main_text(x.as_py()) for x in part.column(html)]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in others], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=[*others, text, chars])

    return pages.select(*others, html).mapInArrow(run, T.StructType([*kinds, T.StructField(text, T.StringType()), T.StructField(chars, T.LongType())]))
