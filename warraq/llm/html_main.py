"""Main text of web pages from flat text blocks.

A page becomes a flat list of blocks.  Each block has its word count and link density, those of the blocks
before and after it, and what its containers say (in an article; in a menu or notice, by how plain a sign).
A small decision tree, trained here on the labelled table below, says whether it is main text.  Containers are
features like the others: where a page names none, words and links decide.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warraq.llm._common import require, short_batches

#: Elements whose text is no text of the page: code, what shows when something can't be, and fields of forms.
SKIPPED = {"script", "style", "noscript", "template", "svg", "iframe", "canvas", "textarea", "select", "head", "title", "audio", "video"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
CONTAINERS = {"article", "aside", "blockquote", "div", "dialog", "fieldset", "footer", "form", "header", "li", "main", "menu", "nav", "ol", "section", "table", "td", "th", "tr", "ul", "p"}
#: Blocks before which an open p ends.
END_P = BLOCKS - {"body", "caption", "html", "legend", "option", "tbody", "td", "tfoot", "th", "thead", "tr"}
#: Parts of a table that end an open cell, and those that end an open row.
END_CELL = {"caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
END_ROW = END_CELL - {"td", "th"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ASIDES = {"nav", "aside", "footer", "form", "menu", "dialog", "fieldset"}
#: Words of class, id and role that name a part of the page that isn't the article.
HINTS = {"ad", "ads", "adsense", "advert", "advertisement", "adverts", "alert", "alertdialog", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "complementary", "consent", "contentinfo", "cookie", "cookies", "copyright", "dialog", "disclaimer", "disqus", "footer", "form", "gdpr", "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pager", "pagination", "popup", "promo", "promoted", "recommended", "related", "replies", "reply", "respond", "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "subscription", "topbar", "toolbar", "widget"}
#: Words that name a part of the article as well, in an article or beside one of OWN in the same name.
EITHER = {"header", "banner", "form", "notice", "skip", "search"}
OWN = {"article", "content", "entry", "main", "post", "story", "text", "body"}
#: How plain a sign is that a container is not the article.
NO_SIGN, FAINT, NAMED, TAGGED = 0, 1, 2, 3

_MARKUP = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|(/?)([A-Za-z][^\s/>]*))")
_TAG_PART = re.compile(r"""[>"']""")
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def sign(tag: str, attributes: str, in_article: bool) -> int:
    """How plainly this element says that it holds something other than the article."""
    if tag in ASIDES or tag == "header" and not in_article:
        return TAGGED
    out = NO_SIGN
    for name, value in _ATTRIBUTE.findall(attributes):
        value = value.strip("\"'")
        name = name.lower()
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return TAGGED
        if name in ("class", "id", "role") and tag not in ("html", "body", "article", "main"):
            for one in value.split():
                words = {w.lower() for w in _WORD.findall(one)}
                told = words & HINTS
                if told:
                    out = max(out, FAINT if told <= EITHER and (in_article or words & OWN) else NAMED)
    return out


class Markup:
    """The tags of a page in order; every character is read a bounded number of times, broken markup included."""

    def __init__(self, page: str):
        self.page = page
        self.dead: set[int] = set()  # quotes after which no tag ever ends
        self.missing: set[str] = set()  # what doesn't occur any more

    def find(self, what: str, at: int) -> int:
        """Where `what` is next, or -1; looked for only until it is missing once."""
        if what in self.missing:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.missing.add(what)
        return found

    def after_tag(self, at: int) -> int:
        """The place after the tag whose name ends here: its first > outside quotes, or its first > if quotes don't end."""
        page, seen, here = self.page, [], at
        while True:
            m = _TAG_PART.search(page, here)
            if not m:
                break
            if m[0] == ">":
                return m.end()
            if m.start() in self.dead:
                break
            seen.append(m.start())
            close = self.find(m[0], m.end())
            if close < 0:
                break
            here = close + 1
        self.dead.update(seen)
        plain = self.find(">", at)
        return plain + 1 if plain >= 0 else -1

    def after_element(self, tag: str, at: int) -> int:
        """The place after the end tag of a skipped element that begins here, or -1."""
        if tag in self.missing:
            return -1
        m = re.compile(rf"</{tag}\b", re.I).search(self.page, at)
        end = self.find(">", m.end()) if m else -1
        if end < 0:
            self.missing.add(tag)
        return end + 1 if end >= 0 else -1

    def body_start(self, at: int) -> int:
        m = None if "<body" in self.missing else re.compile(r"<body\b", re.I).search(self.page, at)
        if not m:
            self.missing.add("<body")
        return m.start() if m else -1

    def pieces(self):
        """(text before the tag, tag or "" at the end, closing, attributes) over the whole page."""
        page, at, end = self.page, 0, len(self.page)
        held = 0  # where the text that no tag has ended begins
        while True:
            m = _MARKUP.search(page, at)
            if not m:
                yield page[held:], "", False, ""
                return
            tag = (m[2] or "").lower()
            if tag:
                after = self.after_tag(m.end())
            else:
                close = {"<!--": "-->", "<![CDATA[": "]]>"}.get(m[0], ">")
                after = self.find(close, m.end())
                after = after + len(close) if after >= 0 else end if m[0] == "<!--" else -1
            if after < 0:  # not markup: read as text
                at = m.end()
                continue
            text = page[held : m.start()]
            at = held = after
            if tag in SKIPPED and not m[1]:
                if page[after - 2] != "/":
                    close, body = self.after_element(tag, after), self.body_start(after) if tag == "head" else -1
                    if 0 <= body and (close < 0 or body < close):
                        at = held = body
                    elif close >= 0:
                        at = held = close
                    elif tag in ("script", "style"):
                        at = held = end
                yield text, "", False, ""
            elif tag:
                yield text, tag, bool(m[1]), page[m.end() : after - 1]
            else:
                yield text, "", False, ""


def flat_blocks(page: str) -> list[tuple[str, int, int, int, int, int]]:
    """(text, words, words in links, sign of another part, article container, heading) in page order."""
    blocks: list[tuple] = []
    parts: list[str] = []
    linked = in_link = inside = heading = 0
    # (tag, its sign, article, and where the item, cell and row are that an implied end would close, or -1)
    stack: list[tuple[str, int, bool, int, int, int]] = []
    opened: Counter[str] = Counter()
    signs = [0, 0, 0, 0]  # open containers by sign

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            plain = next((k for k in (TAGGED, NAMED, FAINT) if signs[k]), NO_SIGN)
            blocks.append((text, text.count(" ") + 1, linked, plain, int(inside > 0), int(heading > 0)))
        parts.clear()
        linked = 0

    def close_from(depth: int) -> None:
        """Ends the containers from this depth on."""
        nonlocal inside
        while len(stack) > depth:
            name, o, i, *_ = stack.pop()
            opened[name] -= 1
            signs[o] -= 1
            inside -= i

    def close_implied(tag: str) -> None:
        """Ends what this start tag ends by the rules of HTML, where end tags are left out."""
        item, cell, row = stack[-1][3:] if stack else (-1, -1, -1)
        if tag == "li" and item >= 0:
            close_from(item)
        if tag in END_ROW and row >= 0:
            close_from(row)
        elif tag in END_CELL and cell >= 0:
            close_from(cell)
        if tag in END_P and stack and stack[-1][0] == "p":
            close_from(len(stack) - 1)

    for text, tag, closing, attributes in Markup(page).pieces():
        if text:
            parts.append(text)
            if in_link:
                linked += len(html.unescape(text).split())
        if tag == "a":
            in_link = 0 if closing else 1
        elif tag == "br":
            parts.append(" ")
        elif tag in BLOCKS:
            flush()
            if not closing:
                close_implied(tag)
            if tag in HEADINGS:
                heading = 0 if closing else 1
            elif tag in CONTAINERS and not closing:
                o, i = sign(tag, attributes, inside > 0), tag in ("article", "main")
                item, cell, row = stack[-1][3:] if stack else (-1, -1, -1)
                here = len(stack)
                item = here if tag == "li" else item if tag in ("div", "p") else -1  # other containers keep an item open
                cell, row = (-1, -1) if tag == "table" else (here if tag in ("td", "th") else cell, here if tag == "tr" else row)
                stack.append((tag, o, i, item, cell, row))
                opened[tag] += 1
                signs[o] += 1
                inside += i
            elif tag in CONTAINERS and opened[tag]:
                depth = len(stack) - 1
                while stack[depth][0] != tag:
                    depth -= 1
                close_from(depth)
                in_link = 0
    flush()
    return blocks


FEATURES = ("words", "links", "words before", "links before", "words after", "links after", "sign", "article", "heading", "heading after")


def features(blocks: list[tuple]) -> np.ndarray:
    words = np.array([0, *(b[1] for b in blocks), 0], dtype=float)
    density = np.array([0, *(min(1.0, b[2] / b[1]) for b in blocks), 0], dtype=float)
    rest = np.array([b[3:6] for b in blocks], dtype=float).reshape(-1, 3)
    after = np.append(rest[1:, 2], 0) if len(rest) else rest[:, 2]
    return np.column_stack([words[1:-1], density[1:-1], words[:-2], density[:-2], words[2:], density[2:], rest, after])


#: The labelled table: pages as runs of blocks "words/linked words, o and its sign, a, h = label"; o1: a faint sign, o2: a name, o3: a
#: tag says that the container isn't the article; a: in an article, h: heading, label 1: main text.
LABELLED = (
    # pages with tags and names
    "1/1o3=0 2/2o3=0 9o2=0 12ah=1 84a=1 65a=1 1a=1 14o3=0 6/6o3=0", "3/3o3=0 4ah=1 33a=1 2a=1 40/2a=1 7ah=1 58a=1 22o2=0 18o3=0",
    "2o3=0 8o2h=0 35o2=0 28/2o2=0 11ah=1 5/5a=1 52/20a=1 3o2ah=0 30o2a=0 6/4o2a=0", "6ah=1 20a=1 9o2a=0 11/11o2a=0 16o3=0",
    "30o3=0 6h=1 55=1 60o2=0", "2/2o3=0 5ah=1 26/9a=1 14/4a=1 90a=1 6/6o2a=0", "7ah=1 140a=1 125a=1 3a=1 9o3=0",
    "1/1o3=0 4a=1", "1/1o3=0 20a=1 80a=1", "1/1=0 33=1 44=1 60=1", "1/1o3=0 12a=1 9ah=1 44a=1", "1/1o3=0 2/2o3=0 6a=1", "3/3o3=0 15a=1 9o3=0", "1/1=0 1/1=0 2a=1", "1/1o2=0 5/5a=1 4a=1 8o3=0",
    "20o2=0 90o3=0", "6/5a=1 30a=1", "6o3=0 44=1 6o2=0 80=1 100/90=0",
    # faint signs: the head of an article, or links in it
    "3/3o3=0 9o1ah=1 14o1a=1 60a=1 8o3=0", "8o1a=1 30o1a=1 5/5o1a=0 2/2o1a=0 3/3o1a=0 66a=1", "1/1o1=0 2/2o1=0 1/1o1=0 6o1h=1 18o1=1 90=1",
    # pages without any: links, words and neighbours decide
    "1/1=0 1/1=0 2/2=0 8h=1 90=1 75/3=1 3h=1 31=1 5/5=0 4/4=0 6/6=0", "3/3=0 7h=1 110/6=1 10/8=0 9/9=0 12/10=0",
    "1/1=0 1/1=0 9=0 11h=1 100=1 131=1 6=1 95=1", "3/3=0 14=0 5h=1 39=1", "4/4=0 20=0 9h=1 140=1", "2/2=0 5=0 12h=1 71=1",
    "2/2=0 150=1 140=1 1/1=0", "3/3=0 9h=1 6=1 164=1 6=1 3/3=0", "4/4=0 5h=1 100=1 15/15=0 95=1 4/4=0",
    "6/6=0 40/40=0", "4h=1 30/12=1 44=1", "10o3=0 3h=1 16=1 9=1 11=1 3/3=0 2/2=0",
    "1/1o3=0 19=1 19=1 19=1", "44=1 15=1 5h=1 60=1", "1h=1 2=1 1h=1 9=1", "1ah=1 2a=1 1ah=1 9a=1", "9h=1 8=1 6h=1 33=1", "40a=1 12a=1 6ah=1 18a=1 4ah=1 70a=1", "5ah=1 9a=1 3ah=1 25a=1 5ah=1 1a=1 4ah=1", "140a=1 20a=1", 
)


def labelled_table() -> tuple[np.ndarray, np.ndarray]:
    xs, ys = [], []
    for page in LABELLED:
        rows = [re.fullmatch(r"(\d+)(?:/(\d+))?(?:o([123]))?(a?)(h?)=(\d)", r) for r in page.split()]
        xs.append(features([("", int(m[1]), int(m[2] or 0), int(m[3] or 0), int(bool(m[4])), int(bool(m[5]))) for m in rows]))
        ys += [int(m[6]) for m in rows]
    return np.vstack(xs), np.array(ys)


def grow_tree(x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 2):
    """A nested (feature, threshold, below, above), or a leaf 0 or 1; splits by Gini impurity, first of equals."""
    p = y.mean()
    if depth == 0 or p in (0, 1):
        return int(p >= 0.5)
    best = (2 * p * (1 - p) * len(y) - 1e-9, None, None)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, c = x[order, f], np.cumsum(y[order])
        n = np.arange(1, len(y))
        for k in n[(v[1:] > v[:-1]) & (n >= least) & (len(y) - n >= least)]:
            a, b = c[k - 1] / k, (c[-1] - c[k - 1]) / (len(y) - k)
            impurity = 2 * a * (1 - a) * k + 2 * b * (1 - b) * (len(y) - k)
            if impurity < best[0]:
                best = (impurity, f, (v[k] + v[k - 1]) / 2)
    if best[1] is None:
        return int(p >= 0.5)
    below = x[:, best[1]] <= best[2]
    return best[1], best[2], grow_tree(x[below], y[below], depth - 1, least), grow_tree(x[~below], y[~below], depth - 1, least)


@cache
def trained_tree():
    return grow_tree(*labelled_table())


def classify(tree, row: np.ndarray) -> int:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def main_text(page: str | None, tree=None) -> str:
    blocks = flat_blocks(page or "")
    if not blocks:
        return ""
    tree = tree or trained_tree()
    return "\n\n".join(b[0] for b, row in zip(blocks, features(blocks), strict=True) if classify(tree, row))


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The kept columns, text and n_chars (code points) of each whole page.

    Null or empty html, and pages with no main text, give an empty text and 0; repeated rows stay; broken
    markup is read as far as it goes; an empty table gives no rows; further columns don't pass.
    """
    require(pages, html_col, *keep)
    head = short_batches(pages).select(*keep, F.col(html_col).alias("_html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*keep, "text", "n_chars"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in head.schema.fields[: len(keep)])
    return head.mapInArrow(run, f"{schema}, text string, n_chars long")
