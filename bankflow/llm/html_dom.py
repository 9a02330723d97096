"""A small forgiving HTML tree: enough to tell blocks, their places and their texts."""

from __future__ import annotations

import html
import re

TOKEN = re.compile(r"<(?:(!--)|[!?]|(/?)([a-z][^\s/>]*))", re.I)
QUOTED = re.compile(r"(?>\"[^\"]*\"|'[^']*'|[^>\"'])*>")
# Elements left out with all they hold. Without an end tag, only the first ones reach to the end of the page.
SCRIPTS = frozenset("script style".split())
UNSEEN = SCRIPTS | frozenset("noscript template svg iframe title".split())
END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in UNSEEN}
ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
SPLIT = re.compile(r"[^a-z]+")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset(
    "html body article main section nav header footer aside div p pre blockquote h1 h2 h3 h4 h5 h6 ul ol li dl dt dd "
    "table thead tbody tfoot tr td th caption form fieldset legend label button select option textarea figure "
    "figcaption address details summary dialog menu center hgroup search".split()
)
# A start tag closes these open ones, up to the nearest of the other set.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}


BARE = "#text"


class Node:
    """A block element, or (``BARE``) text between two of them that the page itself owns, as in an unwrapped body; ``runs`` are its own pieces of text, numbered in page order over the whole page."""

    __slots__ = ("tag", "tokens", "parent", "children", "runs", "chars", "links", "tags", "stops", "words")

    def __init__(self, tag: str, tokens: list[str], parent: Node | None):
        self.tag, self.tokens, self.parent = tag, tokens, parent
        self.children: list[Node] = []
        self.runs: list[int] = []
        self.chars = self.links = self.tags = self.stops = self.words = 0


def attribute_tokens(attributes: str) -> list[str]:
    if "=" not in attributes:
        return []
    found = ATTRIBUTE.findall(attributes)
    return [t for value in found for t in SPLIT.split("".join(value).lower()) if t]


class Tokens:
    """Tags of a page in one pass: closing, name, attributes and where the tag starts and ends.

    A tag ends at the next ``>`` outside quotes. Where quotes do not close before the page does, tags end at
    their next ``>`` from there on; what follows the last ``>`` is text. So no part is searched twice.
    """

    def __init__(self, page: str):
        self.page, self.last_end, self.quotes = page, page.rfind(">"), True

    def next(self, at: int) -> tuple[int, int, bool, str | None, str] | None:
        page = self.page
        while match := TOKEN.search(page, at):
            if match[1]:
                end = page.find("-->", match.end())
                return match.start(), len(page) if end < 0 else end + 3, False, None, ""
            if match.end() > self.last_end:
                return None if "<!--" not in page[match.start() :] else self.comment(match.end())
            inside = QUOTED.match(page, match.end()) if match[3] and self.quotes else None
            if match[3] and self.quotes and not inside:
                self.quotes = False
            end = inside.end() if inside else page.index(">", match.end()) + 1
            return match.start(), end, bool(match[2]), match[3], page[match.end() : end - 1]
        return None

    def comment(self, at: int) -> tuple[int, int, bool, str | None, str] | None:
        """A comment behind the last tag, which reaches to the end of the page."""
        start = self.page.find("<!--", at)
        return (start, len(self.page), False, None, "") if start >= 0 else None


class Stack:
    """Open elements. Blocks, and places by name, are found without a walk over what is open."""

    def __init__(self, root: Node):
        self.entries: list[tuple[str | None, Node | None]] = [("html", root)]  # inline elements have no node
        self.blocks = [0]
        self.places: dict[str, list[int]] = {}

    @property
    def owner(self) -> Node:
        return self.entries[self.blocks[-1]][1]

    def push(self, tag: str, node: Node | None = None) -> None:
        if node is not None:
            self.blocks.append(len(self.entries))
        self.places.setdefault(tag, []).append(len(self.entries))
        self.entries.append((tag, node))

    def last(self, tag: str) -> int:
        """Place of the innermost open element of that name, 0 if there is none."""
        places = self.places.get(tag)
        return places[-1] if places else 0

    def forget(self, place: int) -> None:
        """Close an inline element below others, which stay open."""
        self.places[self.entries[place][0]].pop()
        self.entries[place] = (None, None)

    def cut(self, place: int) -> int:
        """Close everything from a place on; how many links were among it."""
        links = 0
        for tag, _ in reversed(self.entries[place:]):
            if tag is not None:
                self.places[tag].pop()
                links += tag == "a"
        del self.entries[place:]
        while self.blocks[-1] >= place:
            self.blocks.pop()
        return links

    def closed_by(self, closes: set[str], until: set[str] | None) -> int:
        """Place of the open block that a start tag closes, 0 if none."""
        if not any(self.places.get(name) for name in closes):
            return 0
        for place in reversed(self.blocks[1:] if until is not None else self.blocks[-1:]):
            name = self.entries[place][0]
            if place and name in closes:
                return place
            if until is None or name in until:
                return 0
        return 0


def parse(page: str | None) -> tuple[Node, list[str]]:
    """Root block and the texts of all runs, white space collapsed; empty runs do not count."""
    root = Node("html", [], None)
    texts: list[str] = []
    stack = Stack(root)
    owner, pieces, in_link = root, [], 0
    bare_links = bare_tags = 0  # since the last flush

    def flush():
        nonlocal pieces, bare_links, bare_tags
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                node = owner
                if owner is root:
                    node = Node(BARE, [], root)
                    node.links, node.tags = bare_links, bare_tags
                    root.children.append(node)
                node.runs.append(len(texts))
                node.chars += len(text)
                node.words += text.count(" ") + 1
                node.stops += text.count(".") + text.count(",") + text.count("?") + text.count("!")
                texts.append(text)
            pieces = []
        bare_links = bare_tags = 0

    def pop_to(depth: int):
        nonlocal owner, in_link
        flush()
        in_link -= stack.cut(depth)
        owner = stack.owner

    def add(piece: str):
        nonlocal bare_links
        pieces.append(piece)
        if in_link and owner is root:
            bare_links += len(piece)
        elif in_link:
            owner.links += len(piece)

    page = page or ""
    last, tokens = 0, Tokens(page)
    endless: set[str] = set()  # no further end tag of these
    while token := tokens.next(last):
        start, end_of_tag, closing, tag, attributes = token
        if start > last:
            add(page[last:start])
        last = end_of_tag
        if tag is None:
            continue
        tag = tag.lower()
        if tag in UNSEEN and not closing:
            if tag not in ("svg", "title"):
                owner.tags += 1
            if tag not in SCRIPTS and attributes.endswith("/"):
                continue
            end = None if tag in endless else END[tag].search(page, last)
            if end:
                last = end.end()
            elif tag in SCRIPTS:
                last = len(page)
            else:
                endless.add(tag)
            continue
        if closing:
            depth = stack.last(tag)
            if not depth:
                continue
            if tag not in BLOCKS:
                if stack.blocks[-1] > depth:
                    continue  # an inline end tag does not close blocks
                in_link -= tag == "a"
                stack.forget(depth)
            else:
                pop_to(depth)
            continue
        if tag == "head":
            continue  # what it may hold has no text, so it ends where other content starts
        owner.tags += 1
        bare_tags += tag not in BLOCKS
        if tag == "br":
            add(" ")
        if tag in VOID:
            continue
        if tag not in BLOCKS:
            if not attributes.rstrip().endswith("/"):
                stack.push(tag)
                in_link += tag == "a"
            continue
        if tag in ("html", "body"):
            root.tokens += attribute_tokens(attributes)
            continue
        closes, until = CLOSES.get(tag, ({"p"}, None))
        if place := stack.closed_by(closes, until):
            pop_to(place)
        flush()
        node = Node(tag, attribute_tokens(attributes), owner)
        owner.children.append(node)
        stack.push(tag, node)
        owner = node
    if last < len(page):
        add(page[last:])
    flush()
    return root, texts
