"""Rendered pages as passages: elements that stand for an entry of their own, with overrides in data attributes.

The attributes are data-<prefix>-index, -skip, -title, -section, -type, -url, -desc, -keywords, -thumb, -updated
and -rank; the prefix is a parameter.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from contextlib import suppress
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from warraq.functions import constants as C
from warraq.sources.parsers import STRUCTURED, held, let_go, parse_records

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
CARD_CLASSES = {"card", "manuscript-card", "landmark-card", "era-card", "person-card"}
TITLE_CLASSES = {"card-title", "title"}
# Sections of entries that name none.
PLATFORM, DATABASE = "المنصّة", "قاعدة البيانات"
LEAST_CHARS = 8


class Element:
    def __init__(self, tag: str, attributes: dict[str, str], parent: Element | None):
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.children: list[Element | str] = []
        self.classes = set(attributes.get("class", "").split())

    def text(self) -> str:
        out, todo = [], [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
            elif x.tag not in ("script", "style"):
                todo += reversed(x.children)
        return "".join(out)

    def below(self) -> Iterator[Element]:
        todo = [c for c in reversed(self.children) if isinstance(c, Element)]
        while todo:
            x = todo.pop()
            yield x
            todo += [c for c in reversed(x.children) if isinstance(c, Element)]

    def upward(self) -> Iterator[Element]:
        x: Element | None = self
        while x is not None:
            yield x
            x = x.parent


class TreeBuilder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.here = Element("#page", {}, None)

    def handle_starttag(self, tag, attrs):
        node = Element(tag, {let_go(k): let_go(v or "") for k, v in attrs}, self.here)
        self.here.children.append(node)
        if tag not in VOID:
            self.here = node

    def handle_endtag(self, tag):
        match = next((x for x in self.here.upward() if x.tag == tag), None)
        if match is not None and match.parent is not None:
            self.here = match.parent

    def handle_data(self, data):
        self.here.children.append(let_go(data))


def guessed_type(text: str) -> str:
    return next((name for pattern, name in C.TYPE_PATTERNS if re.search(pattern, text, re.I)), C.DEFAULT_TYPE)


def _first_text(elements: Iterator[Element]) -> str:
    return next((x.text().strip() for x in elements), "")


def _rank(value: str) -> float:
    m = re.match(r"\s*[-+]?(?:\d+\.?\d*|\.\d+)", value)
    return float(m[0]) if m else 0.0


def parse_live_page(raw: str, path: str, prefix: str = "index") -> list[dict]:
    """Entries of one page, outer containers left out unless they are marked, then its structured data."""
    tree = TreeBuilder()
    tree.feed(held(raw))
    tree.close()
    data = lambda x, name: x.attributes.get(f"data-{prefix}-{name}", "")
    marked = lambda x: f"data-{prefix}-index" in x.attributes
    is_root = lambda x: marked(x) or x.tag == "section" and "id" in x.attributes or x.tag in ("article", "details") or bool(x.classes & CARD_CLASSES)
    page_title = _first_text(x for x in tree.root.below() if x.tag == "title").split("—")[0].strip()
    out = []
    for el in filter(is_root, tree.root.below()):
        if any(f"data-{prefix}-skip" in x.attributes for x in el.upward()) or not marked(el) and any(map(is_root, el.below())):
            continue
        head = _first_text(x for x in el.below() if x.tag in ("h1", "h2", "h3", "h4", "summary", "legend") or x.classes & TITLE_CLASSES)
        title = (data(el, "title") or head or el.attributes.get("aria-label", "")).strip()
        if not title:
            continue
        holder = next((x for x in el.upward() if x.tag == "section" and "id" in x.attributes), None)
        named = holder and (data(holder, "section") or _first_text(x for x in holder.below() if x.tag in ("h1", "h2")))
        section = (data(el, "section") or named or page_title or PLATFORM).strip()
        body = " ".join(el.text().split())
        images = [x for x in el.below() if x.tag == "img"]
        anchor = next((x.attributes["id"] for x in el.upward() if x.attributes.get("id")), "")
        link = el.attributes.get("href", "") if el.tag == "a" else ""
        out.append({
            "title": title, "section": section, "type": data(el, "type") or guessed_type(f"{el.attributes.get('class', '')} {section}"), "url": data(el, "url") or link or path + (f"#{anchor}" if anchor else ""),
            "body": body, "source": path, "desc": data(el, "desc") or body[: C.DESC_CHARS], "heading": " · ".join(x.text().strip() for x in el.below() if x.tag in ("h2", "h3", "h4", "h5", "dt", "th")), "keywords": data(el, "keywords"),
            "alt": " ".join(f"{x.attributes.get('alt', '')} {x.attributes.get('title', '')}" for x in images).strip(), "img": data(el, "thumb") or (images[0].attributes.get("src", "") if images else ""),
            "updated": data(el, "updated"), "rank": _rank(data(el, "rank")) or C.SECTION_RANKS.get(section, 1.0),
        })
    for script in (x for x in tree.root.below() if x.tag == "script"):
        kind = script.attributes.get("type", "")
        linked, inline = kind == "application/ld+json", kind == "application/json" and f"data-{prefix}-source" in script.attributes
        if linked or inline:
            try:
                found = json.loads("".join(c for c in script.children if isinstance(c, str)))
            except ValueError:
                continue  # a broken block concerns itself alone
            out += [d | {"source": path} for d in parse_records(found, STRUCTURED if linked else data(script, "section") or DATABASE, C.SECTION_RANKS)]
    return out


def json_sources(spark: SparkSession, paths: list[str], section: str = DATABASE) -> DataFrame:
    """The columns of a section, from JSON files at the listed addresses that Spark can read; one that is missing or
    broken is passed over."""
    from warraq.sources.files import _SECTION

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0].strip("`") for c in _SECTION.split(", ")]
        for frame in frames:
            rows = []
            for path, raw in zip(frame.path, frame.content, strict=True):
                with suppress(ValueError):
                    rows += [d | {"source": path} for d in parse_records(json.loads(bytes(raw).decode("utf-8-sig")), section, C.SECTION_RANKS)]
            yield pd.DataFrame(rows, columns=names)

    there = []
    for path in paths:  # a short list of settings
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            there.append(path)
    if not there:
        return spark.createDataFrame([], _SECTION)
    return spark.read.format("binaryFile").load(there).select("path", "content").mapInPandas(run, _SECTION)


def live_sections(pages: DataFrame, prefix: str = "index", html_col: str = "html", path_col: str = "url", id_col: str = "page_id") -> DataFrame:
    """(id, entry_no and the columns of a section) of rendered pages held in a table; null pages have none."""
    from warraq.sources.files import _SECTION

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0].strip("`") for c in _SECTION.split(", ")]
        for frame in frames:
            rows = [{id_col: i, "entry_no": k} | d for i, raw, path in zip(frame[id_col], frame[html_col], frame[path_col], strict=True) for k, d in enumerate(parse_live_page(raw or "", path or "", prefix))]
            yield pd.DataFrame(rows, columns=[id_col, "entry_no", *names])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, html_col, path_col).mapInPandas(run, f"{id_col} {kind}, entry_no int, {_SECTION}")
