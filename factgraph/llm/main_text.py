"""Operator 3: main text of web pages by tree scoring.

A tolerant tokenizer builds the tree of block elements of a page. Elements that never hold the article (navigation,
footers, forms, scripts and the like) are pruned, and so are those whose class or id name a part beside it, unless
they stand around an ``article`` or ``main`` element; within one, or within a block named as a post, a name counts only
if it is exact, has a word that names nothing else (comments, sidebar), or most of the text stands in links; outside, a
name that may be a topic (legal, social) does not cost a block of prose. A form that holds most of the page's text is the
page. Each paragraph gives points for its length and commas to its container, half of them to the container above and a
sixth to the next; containers are discounted by the share of their text that stands in links. The best container is
raised to the ``article`` or ``main`` around it, beside which other such elements are kept; where there is none, its
neighbours are kept too: sections, titles, lists, code and whatever else is left, less those of which most stands in
links and the titles of these. Only there are lists and tables of links taken for menus. Lengths and choices are handed
along the tree once, so the time is in proportion to the page however deep it nests.

Rows: null or empty html, and pages without text outside pruned elements, give an empty text; pages of any length
are read whole; unclosed, wrongly nested and cut-off markup is read as browsers do, as far as blocks go. Rows are
independent, so repeated rows and an empty table need no rule; of containers with equal points the first wins. Other
columns are ignored, and a kept column called main_text gives way to the result.
"""

from __future__ import annotations

import html as _html
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.llm.common import mapped, table

#: Elements that begin and end a block of text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav noframes ol optgroup option p pre section "
    "summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose content is no text of the page.
SKIPPED = frozenset("script style noscript template iframe object svg math canvas audio video select textarea title embed applet label".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset("nav footer aside form dialog menu button fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
#: Words of class and id that name parts beside the article.
_BESIDE = re.compile(
    r"(?:^|[\s_\-])(?:ads?|advert\w*|ads(?:ense|box|by\w*)|adbox|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|notices|newsletter|subscri\w*|popup|pop|modal|overlay|"
    r"sidebar|side|rail|menu|menus|nav|navbar|navigation|breadcrumbs?|footer|foot|masthead|topbar|comments?|commentlist|disqus|respond|replies|reply|discussion|"
    r"share|sharing|social|related|recommend\w*|login|signup|register|widgets?|pagination|pager|toolbar|hidden|alert|tags|skip|legal|copyright|disclaimer)(?:$|[\s_\-])",
    re.I,
)
#: Names that mean such a part even within the article and around articles (of readers, say).
_EXACT = frozenset(
    "ad ads advert advertisement adsbygoogle sponsor sponsored promo promotion sidebar nav navbar navigation menu breadcrumb breadcrumbs footer "
    "share sharing share-buttons social social-share comments comment-list commentlist comments-area disqus related related-posts related-articles "
    "recommended newsletter newsletter-signup subscribe cookie-banner cookie-notice consent popup modal pagination pager widget login signup".split()
)
#: Words that name nothing else wherever they stand in a name, and words that may as well be a topic.
_ANYWHERE = frozenset("comment comments commentlist disqus sidebar sidebars newsletter breadcrumb breadcrumbs pagination adsbygoogle".split())
_TOPICS = frozenset("legal social side rail register tags".split())
_POST = frozenset("post article story entry hentry".split())
#: Characters outside links that make prose of a block whose name or tag speaks against it.
PROSE = 140
_ABSENT = re.compile(r"(?:^|(?<=\s))(?:no|not|has|with|without)-[\w\-]+")
_HEADER = re.compile(r"(?:^|[\s_\-])(?:header|head|masthead|site-header|page-header)(?:$|[\s_\-])", re.I)
_GOOD = re.compile(r"(?:^|[\s_\-])(?:article|body|content|entry|main|page|post|story|text|blog|hentry)(?:$|[\s_\-])", re.I)
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: A quote opens a value only directly after the equals sign; elsewhere it is a character like any other.
_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</(?![a-zA-Z])[^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>=][^\s>]*|))*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?")
_SPACE = re.compile(r"\s+")
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
_CELLS = frozenset("td th caption table".split())
_TABLE = frozenset("table caption colgroup thead tbody tfoot tr td th".split())
#: What a start tag ends: the open elements of the first set, up to one of the second.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dd": ({"dd", "dt"}, {"dl"}),
    "dt": ({"dd", "dt"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
ALWAYS, BY_NAME = 1, 2


class Node:
    """A block element. ``tag`` is what it stands for, ``name`` how it is closed, ``beside`` why it may be no part of the article."""

    __slots__ = ("tag", "name", "parent", "children", "beside", "exact", "plain", "topic", "post", "inside", "within", "holds", "gone", "weight", "points", "length", "linked")

    def __init__(self, tag: str, parent: Node | None):
        self.tag = self.name = tag
        self.parent, self.children = parent, []
        self.beside, self.exact, self.plain, self.topic, self.post, self.holds, self.gone = 0, False, False, False, False, False, False
        self.inside = parent is not None and (parent.inside or parent.tag in ("article", "main"))
        self.within = self.inside or parent is not None and (parent.within or parent.post)
        self.weight, self.points, self.length, self.linked = 0.0, 0.0, 0, 0


class Paragraph:
    """A run of text between block borders, in page order."""

    __slots__ = ("parent", "text", "linked")

    def __init__(self, parent: Node, text: str, linked: int):
        self.parent, self.text, self.linked = parent, text, linked


def _attributes(raw: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(raw):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return found


def _judge(node: Node, raw: str) -> None:
    """Whether the element may stand beside the article, and what its names are worth."""
    tag = node.tag
    if tag in ("html", "body"):
        return
    if tag in NEVER or tag == "header" and not node.inside:
        node.beside = ALWAYS
        return
    if "=" not in raw and "hidden" not in raw:
        return
    at = _attributes(raw)
    names = _ABSENT.sub(" ", f"{at.get('class', '')} {at.get('id', '')}")
    role = at.get("role", "").lower()
    if role in ROLES or "hidden" in at or at.get("aria-hidden") == "true" or _UNSEEN.search(at.get("style", "")):
        node.beside = ALWAYS
        return
    if role in ("main", "article"):
        node.tag = role
    if node.tag in ("article", "main"):
        return
    if _BESIDE.search(names) or (_HEADER.search(names) and tag not in _HEADINGS and not node.inside):
        node.beside = BY_NAME
        node.exact = not _EXACT.isdisjoint(names.lower().replace("_", "-").split())
        words = set(re.split(r"[\s_\-]+", names.lower()))
        node.plain = tag != "p" and not _ANYWHERE.isdisjoint(words)
        node.topic = {w for w in words if _BESIDE.search(w) or _HEADER.search(w)} <= _TOPICS
    elif _GOOD.search(names):
        node.weight = 25.0
        node.post = not _POST.isdisjoint(re.split(r"[\s_\-]+", names.lower()))


def parse(page: str) -> tuple[list[Paragraph], list[Node]]:
    """The paragraphs of a page in page order, and its blocks, parents first."""
    root = Node("#root", None)
    here, links, found, nodes = root, 0, [], [root]
    opened: dict[str, int] = {}
    parts: list[str] = []
    linked = [0]

    def close_block() -> None:
        text = _SPACE.sub(" ", _html.unescape("".join(parts)).replace("\x00", "")).strip()
        if text:
            found.append(Paragraph(here, text, min(len(text), linked[0])))
        parts.clear()
        linked[0] = 0

    def leave(node: Node) -> None:
        """Close node and what is open within it."""
        nonlocal here
        while here is not node:
            opened[here.name] -= 1
            here = here.parent
        opened[here.name] -= 1
        here = here.parent

    at, end = 0, len(page)
    skipping: list[str] = []  # an element whose content is no text, and what is open within it
    inline = False
    for token in _TOKEN.finditer(page):
        if token.start() < at:
            continue
        if token.start() > at and not skipping:
            piece = page[at : token.start()]
            parts.append(piece)
            if links:
                linked[0] += len(piece)
        at = token.end()
        if not token[2]:
            if token[0].startswith("<![CDATA[") and not skipping:
                parts.append(token[0][9:].removesuffix("]]>"))
            continue
        tag, closing, raw = token[2].lower(), bool(token[1]), token[3]
        if not closing and tag in RAW and not raw.endswith("/"):
            stop = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = stop.end() if stop else end
            if tag not in BLOCKS:
                continue
        if skipping:
            if closing and tag in skipping:
                while skipping.pop() != tag:
                    pass
                continue
            if not (tag in BLOCKS and (inline or closing and opened.get(tag))):
                if not closing and (tag in BLOCKS or tag == skipping[0]) and tag not in VOID and not raw.endswith("/"):
                    skipping.append(tag)
                continue
            skipping.clear()  # a named inline element ends with its block, any with the block around it
        if tag == "a":
            links = 0 if closing else 1
            continue
        if tag == "br":
            parts.append("\n")
            continue
        if tag in VOID and tag != "hr":
            continue
        if tag in SKIPPED or tag == "button":
            if not closing and not raw.endswith("/"):
                skipping, inline = [tag], False
            continue
        if tag not in BLOCKS:
            if not closing and tag in ("span", "ins", "amp-ad") and "=" in raw:
                probe = Node(tag, here)
                _judge(probe, raw)
                if probe.beside == ALWAYS or probe.beside and (probe.exact or not probe.inside):
                    skipping, inline = [tag], True
            continue
        close_block()
        links = 0
        if closing:
            if opened.get(tag):
                up = here
                while up.name != tag and (up.name not in _CELLS or tag in _TABLE):
                    up = up.parent
                if up.name == tag:
                    leave(up)
            continue
        if tag == "hr":
            continue
        if here.name == "p":
            leave(here)
        if tag in _CLOSES:
            these, until = _CLOSES[tag]
            if any(map(opened.get, these)):
                up, last = here, None
                while up is not root and up.name not in until:
                    if up.name in these:
                        last = up
                        if tag not in _TABLE:
                            break
                    elif tag not in _TABLE and up.name not in ("div", "p", "address"):
                        break
                    up = up.parent
                if last is not None:
                    leave(last)
        if tag in ("body", "html") and here is not root:
            continue
        node = Node(tag, here)
        _judge(node, raw)
        here.children.append(node)
        nodes.append(node)
        opened[tag] = opened.get(tag, 0) + 1
        here = node
    if at < end and not skipping:
        parts.append(page[at:].removesuffix("<"))
        if links:
            linked[0] += len(parts[-1])
    close_block()
    return found, nodes


def _measured(blocks: list[Paragraph], nodes: list[Node]) -> None:
    """Lengths of text and of linked text of all blocks that are not gone, each paragraph counted once and sums handed up."""
    for node in nodes:
        node.length = node.linked = 0
    for b in blocks:
        if not b.parent.gone:
            b.parent.length += len(b.text)
            b.parent.linked += b.linked
    for node in reversed(nodes):
        if node.parent is not None and not node.gone:
            node.parent.length += node.length
            node.parent.linked += node.linked


def _pruned(nodes: list[Node]) -> None:
    """Marks what stands beside the article as gone: what is so by its kind; what is named so, but for parts around an
    article or main element and prose of a name that may be a topic; and within an article or post only by an exact or
    plain name or where links make most of the text."""
    every = nodes[0].length
    for node in reversed(nodes):
        if node.tag == "form" and (node.holds or node.length > 0.5 * every and node.length - node.linked >= PROSE):  # around the whole page
            node.beside = 0
        if node.parent is not None and node.beside != ALWAYS and (node.holds or node.tag in ("article", "main")):
            node.parent.holds = True
    for node in nodes:
        beside = node.beside == ALWAYS
        if node.beside == BY_NAME:
            if node.topic and node.length - node.linked >= PROSE and node.linked <= 0.25 * node.length:
                beside = False
            elif node.within and not (node.holds and not node.inside):
                beside = node.tag not in _HEADINGS and (node.exact or node.plain or node.linked > 0.5 * node.length)
            else:
                beside = node.exact or not node.holds
        node.gone = beside or (node.parent is not None and node.parent.gone)


def main_text(page: str | None) -> str:
    """The article of a page, one line a block."""
    blocks, nodes = parse(page or "")
    _measured(blocks, nodes)
    _pruned(nodes)
    _measured(blocks, nodes)
    blocks = [b for b in blocks if not b.parent.gone]
    if not blocks:
        return ""
    candidates: dict[int, Node] = {}
    for b in blocks:
        if b.parent.tag in _HEADINGS or b.parent.tag in ("caption", "figcaption"):
            continue
        free = len(b.text) - b.linked
        if free < 20:
            continue
        points = (1 + b.text.count(",") + min(free / 100, 3)) * free / len(b.text)
        holder = b.parent.parent if b.parent.tag in ("p", "pre", "blockquote", "li", "td") and b.parent.parent is not None else b.parent
        for share in (1.0, 0.5, 1 / 6):
            if holder is None or holder.tag == "#root" and share < 1:
                break
            if id(holder) not in candidates:
                candidates[id(holder)] = holder
                holder.points += holder.weight + {"article": 30, "main": 20, "div": 5, "section": 5, "pre": 3, "td": 3, "blockquote": 3, "ul": -3, "ol": -3, "dl": -3, "li": -3}.get(holder.tag, 0)
            holder.points += points * share
            holder = holder.parent
    scored = {k: n.points * (1 - n.linked / max(1, n.length)) for k, n in candidates.items()}
    best = nodes[0]
    if scored:
        best = candidates[max(scored, key=scored.__getitem__)]
        least = max(10.0, scored[id(best)] * 0.2)
        while best.inside and best.tag not in ("article", "main"):
            best = best.parent
    whole = best.tag in ("article", "main")
    chosen = {id(best)}
    if scored and best.parent is not None and best.tag not in ("li", "td", "tr", "tbody"):
        titles: list[int] = []  # of what comes next
        for near in best.parent.children:
            if near.gone or not near.length:
                continue
            if whole:
                stays = near.tag in ("article", "main") and near.linked <= 0.5 * near.length or scored.get(id(near), 0) >= least
            else:
                stays = near is best or near.linked <= 0.5 * near.length
            if near.tag in _HEADINGS and not whole:
                titles.append(id(near))
                continue
            if stays:
                chosen.update([id(near), *titles])
            titles = []
    kept: set[int] = set()
    for node in nodes:
        menu = not whole and node.tag in ("ul", "ol", "dl", "table") and len(node.children) > 2 and node.linked > 0.8 * node.length
        if id(node) in chosen or node.parent is not None and id(node.parent) in kept and not menu:
            kept.add(id(node))
    return "\n".join(b.text for b in blocks if id(b.parent) in kept)


def extracted(pages: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of pages(html) and main_text, which takes the place of a kept column of its name."""
    return mapped(pages, keep, "html", "main_text string", lambda pages_: [[main_text(p) for p in pages_]], "main_text")


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extracted(table(spark, sf_dir, "pages"), ["page_id", "url"])
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))
