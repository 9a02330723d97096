"""Generated pages with known main text, on which the extractor's trees are trained.

Layouts, class names and texts are drawn at random; the main part may be a semantic element, a named or an
unnamed container, with adverts, notices and forms inside and reader comments behind it. Unwrapped pages have
theirs as bare text in the body.
"""

from __future__ import annotations

import random

SYLLABLES = "an er on th re he in ou la en de st ti no ma si ro le vi ta que ung ch mi cion do par".split()
MAIN = ["content", "main", "post", "entry", "article-body", "story", "text", "body-copy", "post-content"]
SIDE = ["sidebar", "side", "widget", "related", "rail", "recommended", "trending", "more-links", "tags"]
ADS = ["ad", "ads", "advert", "advertisement", "banner", "promo", "sponsored", "ad-slot", "adsbygoogle"]
NOTICES = ["notice", "cookie", "cookie-banner", "consent", "gdpr", "alert", "popup", "modal", "paywall", "subscribe"]
COMMENTS = ["comments", "comment-list", "responses", "discussion", "disqus", "replies"]
FOOT = ["footer", "copyright", "legal", "site-info", "colophon", "bottom"]
HEAD = ["header", "masthead", "top", "topbar", "site-header", "branding", "logo"]
MENU = ["menu", "nav", "navigation", "breadcrumb", "breadcrumbs", "pagination", "share", "social", "toolbar"]


class Maker:
    """Nested lists ``[tag, class, label, *children]``; label 1 main text, 0 other, None both."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        r = self.r
        return " ".join(
            "".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high))
        )

    def sentence_text(self, low: int, high: int) -> str:
        return " ".join(self.words(2, 16).capitalize() + "." for _ in range(self.r.randint(low, high)))

    def links(self, low: int, high: int) -> list:
        return ["ul", "", 0, *[["li", "", 0, ["a", self.words(1, 4)]] for _ in range(self.r.randint(low, high))]]

    def named(self, tags: list[str], names: list[str], label, children: list) -> list:
        r = self.r
        tag = r.choice(tags)
        name = r.choice(names) if tag in ("div", "section", "ul", "p", "td") or r.random() < 0.5 else ""
        return [tag, name, label, *children]

    def other(self) -> list:
        r = self.r
        kind = r.randrange(9)
        if kind == 0:
            return self.named(["nav", "div", "ul"], MENU, 0, [self.links(2, 9)])
        if kind == 1:
            return self.named(["aside", "div"], SIDE, 0, [["h3", "", 0, self.words(1, 3)], self.links(2, 8)])
        if kind == 2:
            return self.named(["div", "aside", "section"], ADS, 0, [self.sentence_text(1, 3)])
        if kind == 3:
            return self.named(["div", "section"], NOTICES, 0, [["p", "", 0, self.sentence_text(1, 3)], ["button", "", 0, self.words(1, 2)]])
        if kind == 4:
            return self.named(["form"], ["search", "newsletter", "login", "signup"], 0, [["label", "", 0, self.words(1, 5)], ["button", "", 0, self.words(1, 2)]])
        if kind == 5:
            return self.named(["aside", "div"], SIDE, 0, [["p", "", 0, self.sentence_text(1, 3)]])
        if kind == 6:
            return self.named(["div", "p"], ADS, 0, [["p", "", 0, self.sentence_text(1, 2)]] if r.random() < 0.5 else [self.sentence_text(1, 2)])
        if kind == 7:
            return self.named(["div"], NOTICES, 0, [self.sentence_text(1, 2)])
        return self.named(["div", "section"], SIDE, 0, [["h4", "", 0, self.words(1, 4)], ["p", "", 0, ["a", self.words(3, 9)]], ["p", "", 0, ["a", self.words(3, 9)]]])

    def comments(self) -> list:
        r = self.r
        item = r.choice(["li", "div", "article"])
        one = lambda: [item, "comment" if item != "li" or r.random() < 0.5 else "", 0, ["p", "", 0, self.words(1, 2)], ["p", "", 0, self.sentence_text(1, 5)]]
        many = [one() for _ in range(r.randint(1, 5))]
        return self.named(["section", "div"], COMMENTS, 0, [["h3", "", 0, self.words(1, 2)], ["ol", "", 0, *many] if item == "li" else ["div", "", 0, *many]])

    def main(self) -> list:
        r = self.r
        blocks: list = [["h1", "", 1, self.words(2, 12)]]
        if r.random() < 0.2:
            blocks = [["header", "", 1, *blocks]]
        for _ in range(r.choice([0, 1, 2, 4, 8, 14])):
            kind = r.random()
            if kind < 0.72:
                blocks.append(["p", "", 1, self.sentence_text(1, r.choice([1, 3, 9]))])
            elif kind < 0.82:
                blocks.append([r.choice(["h2", "h3"]), "", 1, self.words(2, 8)])
            elif kind < 0.9:
                blocks.append([r.choice(["ul", "ol"]), "", 1, *[["li", "", 1, self.sentence_text(1, 2)] for _ in range(r.randint(2, 6))]])
            elif kind < 0.96:
                blocks.append(["blockquote", "", 1, ["p", "", 1, self.sentence_text(1, 4)]])
            else:
                blocks.append(["table", "", 1, ["tr", "", 1, ["td", "", 1, self.words(1, 6)], ["td", "", 1, self.words(1, 6)]]])
        mixed = r.random() < 0.35
        if mixed:
            for _ in range(r.randint(1, 3)):
                blocks.insert(r.randint(1, len(blocks)), self.other())
            if r.random() < 0.4:
                blocks.append(self.comments())
        label = None if mixed else 1
        kind = r.random()
        if kind < 0.5:
            return ["article", r.choice(MAIN) if r.random() < 0.3 else "", label, *blocks]
        if kind < 0.8:
            return [r.choice(["div", "section", "td"]), r.choice(MAIN), label, *blocks]
        if kind < 0.9:
            return ["main", "", label, *blocks]
        return ["div", r.choice(["", "col", "wrap", "inner"]), label, *blocks]

    def page(self) -> list:
        r = self.r
        before = []
        if r.random() < 0.6:
            before.append(self.named(["header", "div"], HEAD, 0, [["h2", "", 0, ["a", self.words(1, 3)]]] if r.random() < 0.6 else [["p", "", 0, self.words(1, 6)]]))
        before += [["nav", "", 0, self.links(3, 8)]] if r.random() < 0.6 else []
        before += [self.other() for _ in range(r.randint(0, 2))]
        after = [self.comments()] if r.random() < 0.3 else []
        after += [self.other() for _ in range(r.randint(0, 2))]
        after += [self.named(["footer", "div"], FOOT, 0, ["© " + self.words(1, 4) + " · " + self.sentence_text(1, 3)] if r.random() < 0.6 else [self.links(2, 5), ["p", "", 0, self.words(2, 9)]])]
        main = self.main()
        if r.random() < 0.4:
            main = [r.choice(["div", "main", "section"]), r.choice(["container", "wrapper", "page", "layout", "row"]), None, main, *[self.other() for _ in range(r.randint(0, 2))]]
        return ["body", "", None, *before, main, *after]

    def bare(self) -> list:
        r = self.r
        gap = r.choice([" ", "<br>", "<br><br>\n"])
        parts = [self.sentence_text(1, r.choice([2, 4, 9])) for _ in range(r.choice([1, 1, 2, 4, 8]))]
        if r.random() < 0.3:
            parts.insert(r.randint(0, len(parts)), f"<b>{self.words(1, 4)}</b>")
        return ["#text", "", 1, gap.join(parts)]

    def bare_links(self) -> list:
        parts = [f'<a href="/x">{self.words(1, 3)}</a>' for _ in range(self.r.randint(2, 7))]
        return ["#text", "", 0, self.r.choice([" | ", " ", "<br>"]).join(parts)]

    def unwrapped_page(self) -> list:
        """Main text directly in the body, cut by other blocks; adjoining bare texts would be one."""
        r = self.r
        blocks = [self.bare_links()] if r.random() < 0.3 else []
        if r.random() < 0.5:
            blocks.append(self.named(["header", "div"], HEAD, 0, [["p", "", 0, self.words(1, 6)]]))
        if r.random() < 0.5:
            blocks.append(["nav", "", 0, self.links(3, 8)])
        if r.random() < 0.7 or blocks and blocks[-1][0] == "#text":
            blocks.append([r.choice(["h1", "h2"]), "", 1, self.words(2, 12)])
        for _ in range(r.choice([1, 1, 2, 3, 5])):
            if blocks and blocks[-1][0] == "#text":
                kind = r.randrange(5)
                if kind == 0:
                    blocks.append(self.other())
                elif kind == 1:
                    blocks.append(["ul", "", 1, *[["li", "", 1, self.sentence_text(1, 2)] for _ in range(r.randint(2, 6))]])
                elif kind == 2:
                    blocks.append(["blockquote", "", 1, self.sentence_text(1, 4)])
                else:
                    blocks.append([r.choice(["p", "h2", "h3"]), "", 1, self.words(2, 12)])
            blocks.append(self.bare())
        blocks += [self.comments()] if r.random() < 0.2 else []
        blocks += [self.other() for _ in range(r.randint(0, 2))]
        if r.random() < 0.7:
            blocks.append(self.named(["footer", "div"], FOOT, 0, ["© " + self.words(1, 4)]))
        if blocks[-1][0] != "#text" and r.random() < 0.4:
            blocks.append(self.bare_links() if r.random() < 0.5 else ["#text", "", 0, "© " + self.words(1, 6)])
        return ["body", "", None, *blocks]


def render(node: list | str) -> str:
    if isinstance(node, str):
        return node
    if node[0] == "a":
        return f'<a href="/x">{node[1]}</a>'
    tag, name, _, *children = node
    if tag == "#text":
        return "".join(children)
    attribute = f' class="{name}"' if name else ""
    return f"<{tag}{attribute}>{''.join(map(render, children))}</{tag}>"


def labels(node: list | str) -> list[int | None]:
    """Labels of the block elements below ``body``, and of bare texts in it, in page order."""
    out: list[int | None] = []
    for child in node[3:]:
        if isinstance(child, list) and child[0] != "a":
            out.append(child[2])
            out += labels(child)
    return out
