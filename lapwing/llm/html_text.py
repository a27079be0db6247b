"""Main text of web pages by tree scoring.

A page is read into a tree.  Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader
comments are cut off by their element, role, class or id.  A class or id says so by its whole name or its last part
(``site-footer``), not by a part that says what an element has or lacks (``with-sidebar``, ``promo-free``).  Where only its first
part does (``related-work``), the element stays if it holds paragraphs of prose with few links.  If no text is left, the
page is read again without regard to classes and ids.  Every paragraph then passes points to its ancestors: one, one
for each comma, and up to three for its length; the parent gets all, the next half, and so on ever less.  An element's
points are discounted by the share of its text that stands in links.  The best container is kept, with those of its
siblings that reach a fifth of its points or are long paragraphs with few links; an ``article`` or ``main`` element around
the best container is taken instead of it, since it holds the same text's other blocks.

Blocks are what block elements hold; white space inside them becomes one space, blocks are joined by an empty line.
Character references are decoded.  Null, empty and textless pages give an empty text.  Pages whose paragraphs score
nothing give the text of their ``article``, ``main`` or ``body``.  Ties go to the element that begins first.  Repeated rows
give equal rows.  A page is read whole, whatever its length; work is in proportion to it.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapwing.llm.scratch import over_batches

LEVELS = 8  # ancestors that a paragraph passes points to

_TAG = re.compile(
    r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^<>"']|"[^"]*"|'[^']*')*+)>|(/?)([a-zA-Z][^\s/<>]*)([^<>]*)>)""",
    re.S,
)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""\b(?:hidden\b(?!\s*=\s*["']?(?:false|until))|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)

# Elements and name parts by their role on a page.
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style noscript template iframe svg math textarea title object canvas audio video".split())
_RAW_END = {tag: re.compile(f"</{tag}", re.I | re.A) for tag in _RAW}
_BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table "
    "tbody td tfoot th thead tr ul".split()
)
_CUT = set("nav footer aside form button select head menu dialog fieldset search".split())
_CUT_ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
_CUT_NAMES = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promoted promotion banner "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar footer header masthead topbar "
    "notice cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login "
    "share sharing social related recommended recommendations comment comments commentlist reply replies respond disqus "
    "widget widgets pagination pager toolbar skip".split()
)
# Parts that turn a name into a trait of something else, and first parts that always name what follows them.
_TRAITS = set("no not non without with has have is free enabled disabled off on less hide show toggle allow".split())
_HEADS = set("ad ads adv advert adverts sponsor sponsored promo cookie cookies consent gdpr popup modal newsletter comment comments reply replies disqus".split())
_PROSE = 200  # characters of paragraphs that an element needs to stay despite its first name part
_CLOSED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
}
_SCOPES = {"td", "th", "table", "button", "object", "html"}
_PARAGRAPHS = {"p", "pre", "blockquote", "td", "div", "section", "article", "dd", "main", "li"}


class _Node:
    __slots__ = ("tag", "parent", "cut", "doubt", "inside", "points", "text", "linked", "order", "end")

    def __init__(self, tag: str, parent: _Node | None, cut: bool, doubt: bool, order: int):
        self.tag, self.parent, self.cut, self.order = tag, parent, cut, order
        # the outermost element around this one whose name leaves it in doubt
        self.doubt = parent.doubt if parent is not None and parent.doubt is not None else self if doubt else None
        self.inside = tag in ("article", "main") or parent is not None and parent.inside
        self.points, self.text, self.linked, self.end = 0.0, 0, 0, order


def _named(name: str, in_article: bool) -> int:
    """What a class or id says: 0 nothing, 1 perhaps unwanted, 2 unwanted."""
    parts = [p for p in re.split(r"[^a-z0-9]+", name) if p]
    if not parts or _TRAITS.intersection(parts):
        return 0
    if parts[-1] in _CUT_NAMES:
        return 0 if in_article and parts[-1] == "header" else 2
    if parts[0] in _HEADS:
        return 2
    return int(parts[0] in _CUT_NAMES)


def _unwanted(tag: str, attributes: str, in_article: bool, by_name: bool) -> int:
    if tag in _CUT or tag == "header" and not in_article:
        return 2
    if not attributes or tag in ("html", "body", "article", "main"):
        return 0
    if _HIDDEN.search(attributes):
        return 2
    most = 0
    for name, a, b, c in _NAMES.findall(attributes):
        value = (a or b or c).lower()
        if name.lower() == "role":
            if value in _CUT_ROLES:
                return 2
        elif by_name:
            most = max([most, *(_named(token, in_article) for token in value.split())])
    return most


class _Page:
    def __init__(self, html: str, by_name: bool = True):
        self.by_name, self.skipped = by_name, False  # ``skipped``: a name has cut something
        self.root = _Node("", None, False, False, 0)
        self.nodes = [self.root]
        self.blocks: list[tuple[_Node, int, str, int]] = []  # element, order, text, characters in links
        self.open = [self.root]
        self.places: dict[str, list[int]] = {}  # where elements of a tag stand in ``open``
        self.block_places = [0]
        self.pieces: list[str] = []
        self.link_pieces: list[str] = []
        self._read(html)

    def _flush(self) -> None:
        if not self.pieces:
            return
        text = " ".join("".join(self.pieces).split())
        linked = len(" ".join("".join(self.link_pieces).split()))
        self.pieces.clear()
        self.link_pieces.clear()
        if text:
            self.blocks.append((self.open[self.block_places[-1]], len(self.nodes), text, min(linked, len(text))))

    def _text(self, text: str) -> None:
        if text and not self.open[-1].cut:
            text = unescape(text) if "&" in text else text
            self.pieces.append(text)
            if any(n.tag == "a" for n in self.open[-4:]):
                self.link_pieces.append(text)

    def _close(self, count: int) -> None:
        for node in self.open[count:]:
            node.end = len(self.nodes)
            self.places[node.tag].pop()
        del self.open[count:]
        while self.block_places[-1] >= count:
            self.block_places.pop()

    def _last(self, tags) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def _start(self, tag: str, attributes: str) -> None:
        if tag in _BLOCKS:
            self._flush()
            if self.open[self.block_places[-1]].tag == "p":  # a block ends an open paragraph
                self._close(self.block_places[-1])
        if tag in _CLOSED_BY:
            closes, until = _CLOSED_BY[tag]
            bound = self._last(until)
            while (last := self._last(closes)) > bound:
                self._flush()
                self._close(last)
        if tag in _VOID:
            if tag == "br":
                self._text(" ")
            return
        parent = self.open[-1]
        unwanted = 2 if parent.cut else _unwanted(tag, attributes, parent.inside, self.by_name)
        self.skipped |= self.by_name and unwanted > 0 and not parent.cut
        node = _Node(tag, parent, unwanted == 2, unwanted == 1, len(self.nodes))
        self.nodes.append(node)
        if not attributes.endswith("/") or tag in _BLOCKS or tag == "a":
            self.places.setdefault(tag, []).append(len(self.open))
            if tag in _BLOCKS:
                self.block_places.append(len(self.open))
            self.open.append(node)

    def _end(self, tag: str) -> None:
        if tag in _BLOCKS:
            self._flush()
        at = self._last((tag,))
        # an inline element that isn't open inside its block has nothing to end
        if at and (tag in _BLOCKS or at > self.block_places[-1]):
            self._close(at)

    def _read(self, html: str) -> None:
        at = 0
        while (m := _TAG.search(html, at)) is not None:
            self._text(html[at : m.start()])
            at = m.end()
            tag = m[2] or m[5]
            if not tag:
                continue
            tag = tag.lower()
            if m[1] or m[4]:
                self._end(tag)
                continue
            attributes = m[3] if m[2] else m[6]
            if tag in _RAW:
                if not attributes.endswith("/"):
                    end = _RAW_END[tag].search(html, at)
                    close = html.find(">", end.end()) if end else -1
                    at = close + 1 if close >= 0 else len(html)
                continue
            self._start(tag, attributes)
        self._text(html[at:])
        self._flush()
        self._close(1)
        self.root.end = len(self.nodes)

    def _settle(self) -> None:
        """Drops the blocks of elements in doubt that hold too little prose."""
        held: dict[_Node, list[int]] = {}
        for node, _, text, linked in self.blocks:
            if node.doubt is not None:
                own = held.setdefault(node.doubt, [0, 0, 0])
                own[0] += len(text) if len(text) >= 80 and linked * 4 < len(text) else 0
                own[1] += len(text)
                own[2] += linked
        gone = {n for n, (prose, text, linked) in held.items() if prose < _PROSE or 2 * prose < text or 4 * linked >= text}
        self.blocks = [b for b in self.blocks if b[0].doubt not in gone]

    def _score(self) -> None:
        for node, _, text, linked in self.blocks:
            node.text += len(text)
            node.linked += linked
            if node.tag not in _PARAGRAPHS or len(text) < 25:
                continue
            points = 1 + text.count(",") + text.count("，") + min(len(text) / 100, 3)
            up: _Node | None
            up, level = node if node.tag in ("div", "section", "article", "main") else node.parent, 0
            while up is not None and up.tag not in ("", "html") and level < LEVELS:
                up.points += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
                up, level = up.parent, level + 1
        for node in reversed(self.nodes[1:]):
            node.parent.text += node.text
            node.parent.linked += node.linked

    @staticmethod
    def _worth(node: _Node) -> float:
        return node.points * (1 - node.linked / node.text) if node.text else 0.0

    def main_text(self) -> str:
        self._settle()
        self._score()
        best = max(self.nodes, key=lambda n: (self._worth(n), -n.order))
        if self._worth(best) <= 0:
            best = next((n for t in ("article", "main", "body") for n in self.nodes if n.tag == t and n.text), self.root)
        up, around = best, None
        while up is not None:
            if up.tag in ("article", "main") and (around is None or around.tag != "article"):
                around = up
            up = up.parent
        kept = {around or best}
        best = around or best
        if best.tag not in ("article", "main", "body", ""):
            least = max(10.0, self._worth(best) / 5)
            for n in self.nodes:
                if n.parent is best.parent and n is not best and not n.cut and n.text:
                    density = n.linked / n.text
                    if self._worth(n) >= least or n.tag == "p" and (n.text > 80 and density < 0.25):
                        kept.add(n)
        spans = sorted((n.order, n.end) for n in kept)
        out = []
        for node, _, text, _ in self.blocks:
            if any(a <= node.order < b for a, b in spans):
                out.append(text)
        return "\n\n".join(out)


def main_text(html: str | None) -> str:
    if not html:
        return ""
    page = _Page(html)
    text = page.main_text()
    return text if text or not page.skipped else _Page(html, by_name=False).main_text()


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(x) for x in batch.column(2).to_pylist()]
        sizes = pa.array([len(t) for t in texts], type=pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, type=pa.string()), sizes], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(
        over_batches(run), "page_id bigint, url string, text string, n_chars bigint"
    )
