"""Main text of web pages: boosted trees over block nodes, decoded along the tree."""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.boosting import Forest, grow
from tessera.llm.common import slices
from tessera.llm.dom import HINTS, Features, Page, decide

#: Made-up pages that the trees are fitted on, and nodes whose margins are made together.
FIT_PAGES, TOGETHER = 1500, 8192
#: Where the fitted trees are.
STORED = Path(__file__).with_name("html_forest.json")

SYLLABLES = "an be ca de en fo ga hi in jo ka la mo ne os pi qu re sa ti un ve wo xi yo za ing tion ment ble heit keit ción eau ère ß ü ñ".split()
#: Names that tell nothing, put together from these; none is a word of HINTS.
PLAIN = "x1 b2 row col wrap inner outer box block item unit cell grid flex group layout module component node zone area slot panel a1 c9 z".split()
MARKS = ("", "", "", "", "", "***", "!!", " |", "%%%", "$$$")


class Maker:
    """Makes pages of which it is known what is main text.

    Parts carry data-part="keep" or "drop", which the page reader takes away.
    """

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.mark = self.r.choice(MARKS)
        #: how many of a page's names tell nothing
        self.unnamed = self.r.choice((0.0, 0.15, 0.3))

    def word(self) -> str:
        return "".join(self.r.choice(SYLLABLES) for _ in range(self.r.choice((1, 1, 2, 2, 3, 4))))

    def words(self, low: int, high: int) -> str:
        n = self.r.randint(low, high)
        out = [self.word() + (self.r.choice((".", ",")) if self.r.random() < 0.1 else "") for _ in range(n)]
        return " ".join(out).capitalize() + self.r.choice((".", ".", ""))

    def prose(self, low: int, high: int) -> str:
        text = self.words(low, high)
        if self.mark:
            text = " ".join(w + self.mark for w in text.split())
        if self.r.random() < 0.3 and len(text) > 60:
            tag = self.r.choice(("b", "i", "em", "a href='/x'", "span", "code"))
            cut = len(text) // 2
            text = f"{text[: cut // 2]} <{tag}>{text[cut // 2 : cut]}</{tag.split()[0]}>{text[cut:]}"
        return text.replace("&", "&amp;")

    def named(self, kind: str) -> str:
        if self.r.random() < self.unnamed:
            names = " ".join(self.r.choice(PLAIN) + self.r.choice(("", "", f"-{self.r.randint(1, 99)}", f"__{self.r.choice(PLAIN)}")) for _ in range(self.r.randint(0, 3)))
            return self.r.choice(("", f' class="{names}"', f' id="{names}"')) if names else ""
        name = self.r.choice(HINTS[kind].split())
        return self.r.choice((f' class="{name}"', f' id="{name}"', f' class="box {name}-{self.word().encode("ascii", "ignore").decode()}"', f' role="{name}"'))

    def links(self) -> str:
        n = self.r.randint(2, 9)
        items = [f'<a href="/{i}">{self.words(1, self.r.choice((1, 3, 8)))}</a>' for i in range(n)]
        form = self.r.choice(("li", "li", "a", "p", "div"))
        if form == "li":
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return " ".join(items) if form == "a" else "".join(f"<{form}>{x}</{form}>" for x in items)

    def drop(self, kind: str) -> str:
        r = self.r
        short, long = f"<p>{self.words(3, 14)}</p>", "".join(f"<p>{self.words(4, 40)}</p>" for _ in range(r.randint(1, 4)))
        tag, body = {
            "menu": ("nav", self.links()),
            "header": ("header", r.choice((self.words(1, 5), f"<h1>{self.words(1, 4)}</h1>", f"<a href='/'>{self.words(1, 3)}</a>{self.links()}", short))),
            "footer": ("footer", r.choice((f"&copy; {self.words(2, 25)} &middot; {self.words(2, 20)}", self.links(), short + self.links()))),
            "side": ("aside", r.choice((f"<h3>{self.words(1, 4)}</h3>{self.links()}", short, long, f"<h2>{self.words(1, 3)}</h2>{short}"))),
            "advert": (r.choice(("div", "div", "aside", "section")), r.choice((self.words(3, 25), short, f"<a href='/b'>{self.words(2, 12)}</a>", f"{self.words(3, 9)} <b>{self.words(1, 5)}</b>"))),
            "notice": (r.choice(("div", "div", "dialog", "section")), r.choice((self.words(5, 30), short + "<button>OK</button>", f"{self.words(5, 20)} <a href='/p'>{self.words(1, 3)}</a>"))),
            "form": ("form", f"<label>{self.words(1, 3)}</label><input name=a><button>{self.words(1, 2)}</button>" + r.choice(("", short, f"<select><option>{self.words(1, 2)}</option></select>"))),
            "comment": (r.choice(("section", "div", "div")), f"<h3>{self.words(1, 3)}</h3>" * r.randint(0, 1) + r.choice(("", "<ol>")) + "".join(r.choice(("<div{}><b>{}</b><p>{}</p></div>", "<li{}>{} <p>{}</p></li>", "<article{}><h4>{}</h4><p>{}</p></article>", "<p{}>{}: {}</p>")).format(self.named("comment"), self.words(1, 2), self.words(3, 60)) for _ in range(r.randint(1, 5)))),
            "share": ("div", self.links()),
        }[kind]
        if r.random() < (0.3 if tag in ("nav", "header", "footer", "aside") else 0.05):
            tag, name = "div", f' class="{r.choice(HINTS[kind].split())}"'
        else:
            name = self.named(kind) if tag in ("div", "section", "ul") or r.random() < 0.4 else ""
        return f'<{tag} data-part="drop"{name}>{body}</{tag}>'

    def block(self) -> str:
        r = self.r
        kind = r.choice(("p",) * 14 + ("broken", "broken", "h2", "h3", "list", "list", "linked", "linked", "quote", "pre", "table", "figure", "div", "bare", "short", "short"))
        return {
            "p": lambda: f"<p>{self.prose(5, 90)}</p>",
            "short": lambda: f"<p>{self.prose(1, 3)}</p>",
            "broken": lambda: f"<p><b>{self.prose(3, 50)}<br><p>{self.prose(3, 50)}</p>",
            "h2": lambda: f"<h2>{self.prose(1, 8)}</h2>",
            "h3": lambda: f"<h3>{self.prose(1, 8)}</h3>",
            "list": lambda: "<ul>" + "".join(f"<li>{self.prose(2, 25)}</li>" for _ in range(r.randint(2, 6))) + "</ul>",
            "linked": lambda: "<ul>" + "".join(f'<li><a href="/{i}">{self.prose(1, 9)}</a>{r.choice(("", " " + self.prose(2, 9)))}</li>' for i in range(r.randint(2, 6))) + "</ul>",
            "quote": lambda: f"<blockquote><p>{self.prose(5, 40)}</p></blockquote>",
            "pre": lambda: f"<pre>{self.prose(4, 30)}</pre>",
            "table": lambda: "<table>" + "".join(f"<tr><td>{self.prose(1, 5)}</td><td>{self.prose(1, 5)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>",
            "figure": lambda: f"<figure><img src=a><figcaption>{self.prose(3, 15)}</figcaption></figure>",
            "div": lambda: f"<div>{self.prose(8, 60)}</div>",
            "bare": lambda: self.prose(8, 60),
        }[kind]()

    def article(self) -> str:
        r = self.r
        blocks = [f"<h1>{self.prose(1, 14)}</h1>"] if r.random() < 0.8 else []
        blocks += [self.block() for _ in range(r.choice((1, 1, 2, 3, 5, 8, 12, 20, 35)))]
        for kind, odds in (("advert", 0.2), ("share", 0.1), ("side", 0.1), ("comment", 0.12), ("form", 0.06), ("notice", 0.06)):
            if r.random() < odds:
                blocks.insert(r.randint(1, len(blocks)), self.drop(kind))
        body = r.choice(("", "\n", " ")).join(blocks)
        tag = r.choice(("article",) * 6 + ("main", "div", "div", "section"))
        name = self.named("content") if tag in ("div", "section") or r.random() < 0.3 else ""
        out = f'<{tag} data-part="keep"{name}>{body}</{tag}>'
        if r.random() < 0.2:
            tag = r.choice(("main", "div", "section"))
            extra = self.drop("side") if r.random() < 0.4 else ""
            out = f"<{tag}>{out}{extra}</{tag}>"
        return out

    def page(self) -> str:
        r = self.r
        odds = {"notice": 0.25, "menu": 0.85, "header": 0.4, "form": 0.2, "advert": 0.6, "side": 0.2}
        before = [k for k, p in odds.items() if r.random() < p]
        odds = {"share": 0.15, "advert": 0.3, "comment": 0.35, "side": 0.4, "form": 0.2, "menu": 0.1, "notice": 0.15, "footer": 0.9}
        after = [k for k, p in odds.items() if r.random() < p]
        if r.random() < 0.5:
            r.shuffle(before)
        head = f"<!DOCTYPE html><html><head><title>{self.words(2, 9)}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>"
        inside = [self.article()] if r.random() < 0.98 else []
        return head + "".join([*map(self.drop, before), "<!-- c -->", *inside, *map(self.drop, after)]) + "</body></html>"


def example(seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Features of a made-up page's nodes with text, and whether main text is among it."""
    page = Page(Maker(seed).page())
    n = len(page.tag)
    part, kept = ["drop"] * n, np.zeros(n)
    for i in range(1, n):
        part[i] = page.part[i] or part[page.parent[i]]
    for i in range(n - 1, -1, -1):
        kept[i] = max(kept[i], bool(page.words[i]) and part[i] == "keep")
        if i:
            kept[page.parent[i]] = max(kept[page.parent[i]], kept[i])
    x = Features(page).rows(0, n)
    some = x[:, 0] > 0
    some[0] = False
    return x[some], kept[some]


def fitted(pages: int = FIT_PAGES) -> Forest:
    """Trees fitted on `pages` made-up pages; the same at every call."""
    made = [example(seed) for seed in range(pages)]
    return grow(np.concatenate([m[0] for m in made]), np.concatenate([m[1] for m in made]))


@lru_cache(maxsize=1)
def model() -> Forest:
    """The trees of `fitted`, as `python -m tessera.llm.html_extract` has stored them beside this module."""
    return Forest.load(STORED.read_text())


def margins_of(features: list[Features], forest: Forest) -> list[np.ndarray]:
    """The margins of some pages' nodes; the matrix is made for TOGETHER nodes at a time."""
    out: list[list[np.ndarray]] = [[] for _ in features]
    waiting, n = [], 0
    pieces = [(k, begin, min(begin + TOGETHER, f.n)) for k, f in enumerate(features) for begin in range(0, f.n, TOGETHER)]
    for at, (k, begin, end) in enumerate(pieces):
        waiting.append((k, features[k].rows(begin, end)))
        n += end - begin
        if n >= TOGETHER or at == len(pieces) - 1:
            found = np.split(forest.margins(np.concatenate([x for _, x in waiting])), np.cumsum([len(x) for _, x in waiting])[:-1])
            for (own, _), m in zip(waiting, found, strict=True):
                out[own].append(m)
            waiting, n = [], 0
    return [np.concatenate(m) for m in out]


def extract_text(page: Page, features: Features, margins: np.ndarray) -> str:
    kept = decide(margins, features.parent, features.chars)
    return "\n\n".join(" ".join(w) for w, k in zip(page.words, kept, strict=True) if k and w)


def extract(pages: DataFrame, forest: Forest) -> DataFrame:
    """page_id, url, text and n_chars of every page, in one pass without a shuffle.

    A page is read into a tree of its blocks. Each node gets a margin from the
    trees, by the text, links and elements below it, words of its attributes,
    depth, siblings and place. The choice of greatest total margin is taken in
    which nothing below a dropped node is kept. Kept runs of text, references
    decoded and white space made single, are joined by an empty line.

    Defined results: a null or blank html, or one without text, gives an empty
    text; markup that is not closed ends with the page, and a page that is cut
    off within a tag ends before it; a page is read in time linear in its
    length, and what is held besides it grows with one page or with the bytes
    of a block of small ones; repeated rows give the same text; an empty table
    gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2):
            read = [Page(x.as_py() or "") for x in part.column(2)]
            made = [Features(p) for p in read]
            texts = [extract_text(p, f, m) for p, f, m in zip(read, made, margins_of(made, forest), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    schema = T.StructType([pages.schema["page_id"], pages.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return pages.select("page_id", "url", F.col("html")).mapInArrow(run, schema)


if __name__ == "__main__":
    STORED.write_text(fitted().dump())
