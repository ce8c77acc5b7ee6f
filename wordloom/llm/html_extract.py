"""Main text of web pages by scoring the element tree.

Each paragraph earns points for its length and its commas, passes them to the elements around it,
less with each level, and an element's sum is discounted by the share of its text that is links.
The best container is kept, with those of its siblings that score well enough or read like text.
Before that, elements that by tag, role or class are menus, page headers and footers, sidebars,
notices, adverts, forms or reader comments are cut out, and within the container lists of links.

Defined results: null and empty pages, and pages without text, give the empty text. Markup that
is cut off or not closed is read as browsers do: as far as it goes. Rows that repeat give the
same text. Other columns are not read.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from wordloom.llm.common import map_texts, texts_of

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: What may end a tag, or open a value in quotes within it.
TAG_STOP = re.compile(r""">|=\s*(["'])""")
#: Elements are nested to this depth; deeper ones become siblings, as in browsers.
DEPTH = 512
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

# Elements of HTML by their role here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript xmp iframe".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary"
    " table tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset(
    "script style noscript template iframe svg canvas object embed audio video form input button select textarea"
    " label fieldset nav footer aside menu dialog head title link meta map datalist".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Start tags that close an open element: tag -> (closed, where to stop looking).
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
UNWANTED = re.compile(
    r"(?:^|[\s_-])(?:ads?|adv|advert\w*|adbox|adslot|adsense|banner\w*|sponsor\w*|promo\w*|cookie\w*|consent|gdpr|notices?"
    r"|notification\w*|pop-?up|modal|overlay|newsletter|subscri\w*|sign-?up|log-?in|side-?bar\w*|menu\w*|nav|navbar|navigation"
    r"|bread-?crumbs?|footer|header|masthead|toolbar|shar(?:e|ing)|social|related|recommend\w*|teasers?|outbrain|taboola"
    r"|comments?|commentlist|disqus|respond|repl(?:y|ies)|search|widgets?|paginat\w*|pager|copyright|disclaimer|skip|hidden|tags"
    r"|alert|rss|forum|remark\w*|toc)(?:$|[\s_-])",
    re.I,
)
COMMENTS = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|disqus|respond|repl(?:y|ies))(?:$|[\s_-])", re.I)
LIKELY = re.compile(r"article|body|content|entry|main|page|post|story|text", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Points of a tag, before those of the paragraphs in it.
START = {"article": 10, "main": 8, "section": 4, "div": 5, "pre": 3, "td": 3, "blockquote": 3, "ul": -3, "ol": -3, "dl": -3}


class Node:
    __slots__ = ("tag", "names", "drop", "parent", "children", "score", "chars", "links", "anchors")

    def __init__(self, tag: str, parent: Node | None, names: str = "", drop: bool = False):
        self.tag, self.parent, self.names, self.drop = tag, parent, names, drop
        self.children: list[Node | str] = []
        self.score, self.chars, self.links, self.anchors = 0.0, 0, 0, 0


@lru_cache(maxsize=20_000)
def _attributes(raw: str) -> tuple[str, str, bool]:
    """Class and id, role, and whether the element is hidden."""
    found = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(raw)}
    names = f"{found.get('class', '')} {found.get('id', '')}"
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or bool(HIDDEN.search(found.get("style", "")))
    return names, found.get("role", "").lower(), hidden


def _tag_end(page: str, at: int) -> int:
    """Where the tag ends whose name ends at ``at``; -1 if the page ends in it."""
    while True:
        m = TAG_STOP.search(page, at)
        if m is None:
            return -1
        if m[1] is None:
            return m.start()
        at = page.find(m[1], m.end()) + 1
        if not at:
            return -1


class _Tree:
    """The open elements of a page that is read."""

    def __init__(self) -> None:
        self.root = self.node = Node("html", None)
        self.depth = 0
        self.open: dict[str, int] = {}

    def text(self, piece: str) -> None:
        if piece:
            self.node.children.append(html.unescape(piece) if "&" in piece else piece)

    def up_to(self, node: Node) -> None:
        """``node`` is the innermost open element from now on."""
        while self.node is not node:
            self.open[self.node.tag] -= 1
            self.node, self.depth = self.node.parent, self.depth - 1

    def end(self, tag: str) -> None:
        if self.open.get(tag):
            up = self.node
            while up.tag != tag:
                up = up.parent
            self.up_to(up.parent)
        elif tag == "p":
            self.node.children.append(Node("p", self.node))

    def start(self, tag: str, attributes: str) -> None:
        if tag == "body":
            self.up_to(self.root)
        if tag in ("html", "body"):
            return
        if tag in BLOCK or tag in CLOSES:
            closed, stop = CLOSES.get(tag, (frozenset(), frozenset()))
            up = self.node
            while up.parent is not None and up.tag not in stop and any(map(self.open.get, ("p", *closed))):
                above, of_block = up.parent, up.tag in BLOCK and up.tag != "p"
                if up.tag == "p" or up.tag in closed:
                    self.up_to(above)
                if of_block and not closed:
                    break
                up = above
        names, role, hidden = _attributes(attributes) if attributes else ("", "", False)
        child = Node(tag, self.node, names, hidden or role in ROLES or tag in DROPPED)
        self.node.children.append(child)
        if tag not in RAW and tag not in VOID and not attributes.endswith("/") and self.depth < DEPTH:
            self.node, self.depth = child, self.depth + 1
            self.open[tag] = self.open.get(tag, 0) + 1


def parse(page: str) -> Node:
    """The page's tree, in one pass over it. A tag or comment that the end cuts off is left out."""
    tree, text, at, n = _Tree(), 0, 0, len(page)
    while True:
        lt = page.find("<", at)
        c = page[lt + 1 : lt + 2] if lt >= 0 else ""
        closing = c == "/"
        name = NAME.match(page, lt + 1 + closing) if lt >= 0 else None
        if lt >= 0 and name is None and (not c or c not in "/!?"):
            if lt + 1 < n:
                at = lt + 1  # no markup
                continue
            lt = n - 1
        tree.text(page[text:lt] if lt >= 0 else page[text:])
        if lt < 0:
            return tree.root
        if name is None:
            comment = page.startswith("!--", lt + 1)
            end = page.find("-->" if comment else ">", lt + 4 if comment else lt + 1)
            if end < 0:
                return tree.root
            text = at = end + (3 if comment else 1)
            continue
        end = _tag_end(page, name.end())
        if end < 0:
            return tree.root
        tag, text = name[0].lower(), end + 1
        at = text
        if closing:
            tree.end(tag)
            continue
        tree.start(tag, page[name.end() : end])
        if tag in RAW:
            m = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            end = page.find(">", m.end()) if m else -1
            if end < 0:
                return tree.root
            text = at = end + 1


def _measure(node: Node) -> None:
    """Characters of text and of link text below each element. Without recursion: deep pages."""
    order, stack = [], [node]
    while stack:
        x = stack.pop()
        order.append(x)
        stack += [c for c in x.children if not isinstance(c, str) and not c.drop]
    for x in reversed(order):
        x.chars = x.links = 0
        x.anchors = int(x.tag == "a")
        for c in x.children:
            if isinstance(c, str):
                x.chars += len(c) if len(c) < 3 or not c.isspace() else 0
            elif not c.drop:
                x.chars += c.chars
                x.links += c.links
                x.anchors += c.anchors
        if x.tag == "a":
            x.links = x.chars


def _within(node: Node, tags: frozenset[str] | set[str]) -> bool:
    up = node.parent
    while up is not None:
        if up.tag in tags:
            return True
        up = up.parent
    return False


def _nodes(root: Node) -> list[Node]:
    order, stack = [], [root]
    while stack:
        x = stack.pop()
        order.append(x)
        stack += [c for c in reversed(x.children) if not isinstance(c, str) and not c.drop]
    return order


def _prune(root: Node) -> None:
    _measure(root)
    whole = max(1, root.chars)
    for x in _nodes(root):
        if x is root or x.drop or x.tag in ("article", "main") and not COMMENTS.search(x.names):
            continue
        if x.tag == "header" and not _within(x, {"article", "main"}):
            x.drop = True
        elif UNWANTED.search(x.names) and not (x.tag == "header" and _within(x, {"article"})):
            # A page's frame may be called anything; what holds most of the text is no side matter.
            comments = COMMENTS.search(x.names)
            frame = x.chars > 0.6 * whole and any(not isinstance(c, str) and c.chars > 140 for c in x.children)
            x.drop = bool(comments and not LIKELY.search(x.names)) or not frame and not (x.tag in HEADINGS and x.links == 0)
    _measure(root)


def _blocks(node: Node) -> list[str]:
    """Texts of blocks in page order, white space made one space."""
    out: list[str] = []
    now: list[str] = []

    def flush() -> None:
        if text := " ".join("".join(now).split()):
            out.append(text)
        now.clear()

    stack: list = [node]
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            now.append(x)
        elif x.drop:
            continue
        elif x.tag == "br":
            now.append(" ")
        else:
            block = x.tag in BLOCK
            if block:
                flush()
                stack.append(None)
            stack += reversed(x.children)
    flush()
    return out


def _density(node: Node) -> float:
    return node.links / node.chars if node.chars else 0.0


def _own_text(node: Node) -> str:
    """Text of a paragraph: without blocks in it."""
    out, stack = [], list(reversed(node.children))
    while stack:
        c = stack.pop()
        if isinstance(c, str):
            out.append(c)
        elif not c.drop and c.tag not in BLOCK:
            stack += reversed(c.children)
    return " ".join("".join(out).split())


def _score(root: Node) -> Node | None:
    """The best container."""
    scored: list[Node] = []
    for x in _nodes(root):
        if x.tag not in BLOCK and x is not root or x.tag in HEADINGS:
            continue
        text = _own_text(x)
        if len(text) < 25:
            continue
        points = 1 + text.count(",") + text.count("，") + text.count("、") + min(len(text) // 100, 3)
        level = 0
        up = x.parent if x.tag in ("p", "li", "td", "pre", "blockquote", "dd") and x.parent is not None else x
        while up is not None and level < 5:
            if up.tag in BLOCK or up is root:
                if not up.score:
                    up.score = START.get(up.tag, 0) + (5 if LIKELY.search(up.names) else 0) + 0.01
                    scored.append(up)
                up.score += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
                level += 1
            up = up.parent
    for x in scored:
        x.score *= 1 - _density(x)
    return max(scored, key=lambda x: x.score, default=None)


def main_text(page: str) -> str:
    """Blocks of the main text, one a line."""
    if not page:
        return ""
    root = parse(page)
    _prune(root)
    best = _score(root)
    if best is None:
        return "\n".join(_blocks(root))
    up = best
    while up is not None:  # the article that the best container is a part of
        if up.tag in ("article", "main"):
            best = up
            break
        up = up.parent
    for x in _nodes(best):
        if x is best or x.tag in HEADINGS:
            continue
        if x.tag in ("ul", "ol", "dl", "div", "section", "table") and x.links and x.anchors >= 2 and _density(x) > 0.5:
            x.drop = True
    if best.parent is None:
        return "\n".join(_blocks(best))
    least, out = max(10.0, best.score * 0.2), []
    for x in best.parent.children:
        if x is best:
            out += _blocks(best)
        elif not isinstance(x, str) and not x.drop and x.chars:
            density = _density(x)
            text = _own_text(x)
            reads = x.tag in ("p", "blockquote", "pre") and (len(text) > 80 and density < 0.25 or 0 < len(text) and density == 0 and re.search(r"[.!?](\s|$)", text))
            if x.tag == "h1" and density == 0 or x.score >= least and x.tag in BLOCK or reads:
                out += _blocks(x)
    return "\n".join(out)


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col``, ``url_col``, text, n_chars (code points of the text)."""

    def run(columns: list[pa.Array]) -> list[pa.Array]:
        texts = [main_text(t) for t in texts_of(columns[2])]
        return [columns[0], columns[1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

    id_type = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, `{url_col}` string, text string, n_chars bigint"
    return map_texts(df, [id_col, url_col, html_col], schema, lambda: run)
