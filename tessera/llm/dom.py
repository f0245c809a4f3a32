"""A tree of the blocks of an HTML page, and the features of its nodes."""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import numpy as np

#: Where markup begins: a comment, a declaration or instruction, or a tag with its name.
MARKUP = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*+))")
#: What matters within a tag: its end, and quotes.
INSIDE = re.compile(r"""[>"']""")
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|itemprop|aria-label|data-part)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.IGNORECASE)
TOKEN = re.compile(r"[a-z]+")
#: The end tags of elements whose text is not part of a page, in letters of any case.
ENDS: dict[str, re.Pattern] = {}

#: Elements that end a run of text; elements whose text is not part of a page.
BLOCKS = frozenset(
    """address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6
    header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul""".split()
)
HIDDEN = frozenset("script style title textarea noscript template iframe object svg math select datalist canvas audio video noframes xmp".split())
ENDS.update({name: re.compile(f"</{name}", re.IGNORECASE | re.ASCII) for name in HIDDEN})
CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"},
}
ROOTS = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}

#: Words of class names and ids by what they tell of an element.
HINTS = {
    "content": "article content main post entry story body text prose copy page hentry blog news",
    "menu": "nav navbar navigation menu crumb crumbs breadcrumb breadcrumbs tabs pager pagination toc skip",
    "advert": "ad ads adv advert advertisement adverts adsense sponsor sponsored sponsors promo promotion banner dfp gpt outbrain taboola affiliate",
    "comment": "comment comments commentlist reply replies respond response responses disqus discussion reader thread",
    "footer": "footer foot copyright legal colophon bottom imprint credits",
    "header": "header head masthead top topbar logo brand branding site",
    "side": "sidebar side aside widget widgets rail related recommended recommendations more popular trending tags author bio",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login paywall message warning",
    "form": "form search field input button",
    "share": "share sharing social follow facebook twitter tweet",
}
HINT_OF = {w: i for i, words in enumerate(HINTS.values()) for w in words.split()}
TAGS = ("#text", "p", "h1", "h2", "h3", "h4", "li", "ul", "ol", "div", "section", "article", "main", "nav", "header", "footer", "aside", "form", "table", "td", "blockquote", "pre", "figure", "body")
TAG_AT = {t: i for i, t in enumerate(TAGS)}
ZONES = {"article": 0, "main": 0, "nav": 1, "menu": 1, "header": 2, "footer": 3, "aside": 4, "form": 5, "fieldset": 5, "figure": 6, "table": 7}


class Scanner:
    """Finds the ends of markup, in time linear in the page: what is once found
    to be nowhere behind a place isn't looked for again."""

    def __init__(self, text: str):
        self.text, self.none_behind = text, {}

    def find(self, what: str, at: int) -> int:
        """The first place of `what` from `at` on, or -1."""
        if at >= self.none_behind.get(what, len(self.text) + 1):
            return -1
        found = self.text.find(what, at)
        if found < 0:
            self.none_behind[what] = at
        return found

    def find_any_case(self, name: str, at: int) -> int:
        """The first place of an element's end tag from `at` on, or -1."""
        if at >= self.none_behind.get(name, len(self.text) + 1):
            return -1
        found = ENDS[name].search(self.text, at)
        if not found:
            self.none_behind[name] = at
        return found.start() if found else -1

    def tag_end(self, at: int) -> int:
        """The place of the `>` that ends a tag; quoted ones don't. A quote that
        isn't closed is a character like any other. -1 if the page is cut off."""
        while m := INSIDE.search(self.text, at) if self.find(">", at) >= 0 else None:
            if m[0] == ">":
                return m.start()
            closed = self.find(m[0], m.end())
            if closed < 0:
                return self.find(">", m.end())
            at = closed + 1
        return -1


class Page:
    """Blocks in the order of the page. A block has a tag, a parent, hints, and
    either children or runs of text; text beside children is a child of its own."""

    def __init__(self, text: str):
        self.tag: list[str] = ["body"]
        self.parent: list[int] = [-1]
        self.hints: list[int] = [0]
        self.part: list[str] = [""]
        self.words: list[list[str]] = [[]]
        self.links: list[int] = [0]
        self.has_children = [False]
        self.read(text)

    def open(self, tag: str, parent: int, attributes: str = "") -> int:
        hints, part = 0, ""
        if attributes:
            for name, value in ATTRIBUTE.findall(attributes):
                if name.lower() == "data-part":
                    part = value.strip("\"'")
                    continue
                for w in TOKEN.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value).lower()):
                    if w in HINT_OF:
                        hints |= 1 << HINT_OF[w]
        self.tag.append(tag)
        self.parent.append(parent)
        self.hints.append(hints)
        self.part.append(part)
        self.words.append([])
        self.links.append(0)
        self.has_children.append(False)
        self.has_children[parent] = True
        return len(self.tag) - 1

    def read(self, text: str) -> None:
        stack, run, run_links, in_link, at, end = [0], [], 0, False, 0, len(text)
        tag_of, still_open = self.tag, Counter()

        def shut(k: int) -> None:
            """Closes the blocks from place k of the stack on."""
            still_open.subtract(tag_of[i] for i in stack[k:])
            del stack[k:]

        def flush() -> None:
            nonlocal run, run_links
            if run:
                words = entities.unescape("".join(run)).split()
                if words:
                    node = self.open("#text", stack[-1])
                    self.words[node], self.links[node] = words, run_links
                run, run_links = [], 0

        scan = Scanner(text)
        while at < end:
            m = MARKUP.search(text, at)
            piece = text[at : m.start()] if m else text[at:]
            if piece:
                run.append(piece)
                if in_link:
                    run_links += len(piece)
            if not m:
                break
            comment, declaration, slash, name = m.groups()
            if comment:
                over = scan.find("-->", m.end())
                at = end if over < 0 else over + 3
                continue
            over = scan.find(">", m.end()) if declaration or slash else scan.tag_end(m.end())
            attributes = text[m.end() : over] if over >= 0 else ""
            at = end if over < 0 else over + 1
            if declaration or over < 0:
                continue
            name = name.lower()
            if slash:
                if name == "a":
                    in_link = False
                elif still_open[name] > 0:
                    flush()
                    k = len(stack) - 1
                    while tag_of[stack[k]] != name:
                        k -= 1
                    shut(k)
            elif name in BLOCKS:
                flush()
                if name in ("body", "html", "hr"):
                    continue
                if tag_of[stack[-1]] == "p":
                    shut(len(stack) - 1)
                if any(still_open[x] > 0 for x in CLOSED_BY.get(name, ())):
                    for k in range(len(stack) - 1, 0, -1):
                        if tag_of[stack[k]] in ROOTS.get(name, ()):
                            break
                        if tag_of[stack[k]] in CLOSED_BY[name]:
                            shut(k)
                stack.append(self.open(name, stack[-1], attributes))
                still_open[name] += 1
            elif name in HIDDEN and not attributes.endswith("/"):
                over = scan.find_any_case(name, at)
                at = end if over < 0 and name in ("script", "style", "textarea", "title") else max(over, at)
            elif name == "a":
                in_link = True
            elif name in ("br", "img", "input"):
                run.append(" ")
        flush()


class Features:
    """Features of a page's nodes: some numbers for each node, from which rows of
    the whole matrix are made when they are asked for."""

    def __init__(self, page: Page):
        n = len(page.tag)
        self.n, self.parent = n, np.array(page.parent)
        own = np.zeros((n, 6))  # characters, words, characters in links, stops, text runs, elements
        for i in range(n):
            words = page.words[i]
            if words:
                line = " ".join(words)
                own[i] = len(line), len(words), min(page.links[i], len(line)), line.count(".") + line.count(",") + line.count("!") + line.count("?"), 1, 0
            else:
                own[i, 5] = 1
        total, depth, links = own.copy(), np.zeros(n), page.parent
        for i in range(n - 1, 0, -1):
            total[links[i]] += total[i]
        self.hints, self.zones = np.array(page.hints), np.zeros(n, np.int64)
        self.up, self.kinds = self.hints.copy(), np.array([TAG_AT.get(t, len(TAGS)) for t in page.tag])
        for i in range(n):
            p = links[i]
            if i:
                depth[i] = depth[p] + 1
                self.zones[i] = self.zones[p]
                self.up[i] |= self.up[p]
            if page.tag[i] in ZONES:
                self.zones[i] |= 1 << ZONES[page.tag[i]]
        above = np.where(self.parent < 0, 0, self.parent)
        siblings = np.bincount(above[1:], minlength=n) if n > 1 else np.zeros(n)
        rank, seen = np.zeros(n), {}
        for i in range(1, n):
            rank[i] = seen.get(links[i], 0)
            seen[links[i]] = rank[i] + 1
        before = np.cumsum(own[:, 0]) - own[:, 0]
        self.chars, words = total[:, 0], np.maximum(total[:, 1], 1)
        chars, mates, whole = self.chars, np.maximum(siblings[above], 1), max(total[0, 0], 1)
        self.numbers = [
            np.log1p(chars), np.log1p(total[:, 1]), total[:, 2] / np.maximum(chars, 1), total[:, 3] / words, np.log1p(total[:, 4]), np.log1p(total[:, 5]),
            chars / (total[:, 5] + total[:, 4] + 1), chars / np.maximum(total[:, 4], 1), chars / words, chars / np.maximum(chars[above], 1), chars / whole,
            before / whole, depth, rank, rank / mates, mates, np.log1p(chars[above] / mates), chars * mates / np.maximum(chars[above], 1),
        ]

    def rows(self, begin: int, end: int) -> np.ndarray:
        at = slice(begin, end)
        bits = np.arange(len(HINTS))
        one_hot = (self.kinds[at, None] == np.arange(len(TAGS) + 1)).astype(float)
        return np.column_stack([*(c[at] for c in self.numbers), (self.hints[at, None] >> bits) & 1, (self.up[at, None] >> bits) & 1, (self.zones[at, None] >> np.arange(8)) & 1, one_hot])


def decide(margins: np.ndarray, parent: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """Which nodes are kept: the choice of greatest total margin in which nothing
    below a dropped node is kept.

    A node's margin weighs as the root of its text, within bounds. The root is
    always kept; `decide` works up the tree and then down.
    """
    n = len(margins)
    value = np.clip(margins, -4, 4) * np.sqrt(np.clip(chars, 1, 400))
    drop = (-value).tolist()
    keep = value.tolist()
    links = parent.tolist()
    for i in range(n - 1, 0, -1):
        p = links[i]
        drop[p] += drop[i]
        keep[p] += max(keep[i], drop[i])
    kept = np.zeros(n, bool)
    kept[0] = True
    for i in range(1, n):
        kept[i] = kept[links[i]] and keep[i] > drop[i]
    return kept

