"""Web pages: HTML to Markdown, selection by tag, class or id, absolute links, and a bounded breadth-first crawl.

Pages come as rows (url, html); fetching them is left to the caller.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespan.session import materialize

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_SILENT = {"script", "style", "head", "title", "noscript", "template"}
_BLOCK = {"p", "div", "section", "article", "main", "header", "footer", "nav", "aside", "ul", "ol", "table", "blockquote", "pre", "figure", "form", "tr", "dl", "dd", "dt"}
_OTHER_SCHEME = re.compile(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:|#)")


def charset_of(raw: bytes) -> str:
    """The charset a page declares, or the first that decodes it."""
    m = re.search(rb"<meta[^>]+charset=[\"']?\s*([\w-]+)", raw[:4096], re.I)
    for name in ([m[1].decode("ascii")] if m else []) + ["utf-8", "gb18030", "cp1252"]:
        try:
            raw.decode(name)
        except (LookupError, UnicodeDecodeError):
            continue
        return name
    return "latin-1"


class Page(HTMLParser):
    """Markdown of a page, or of the elements that selectors choose, and the links in it."""

    def __init__(self, url: str = "", selectors: list[str] | None = None) -> None:
        super().__init__(convert_charrefs=True)
        self.url = url
        self.wanted = [s for s in selectors or [] if s]
        self.out: list[str] = []
        self.links: list[str] = []
        self.stack: list[tuple[str, bool]] = []
        self.lists: list[list] = []
        self.href: list[str | None] = []
        self.silent = 0
        self.pre = 0
        self.cells: list[str] | None = None
        self.header_done = False

    def _chosen(self, tag: str, attrs: dict[str, str | None]) -> bool:
        """All kinds of selectors must fit; of one kind the last counts."""
        if not self.wanted:
            return True
        need: dict[str, str] = {}
        for s in self.wanted:
            if s.startswith("."):
                need["class"] = s.replace(".", "")
            elif s.startswith("#"):
                need["id"] = s.replace("#", "")
            else:
                need["name"] = s
        return all(tag == v if k == "name" else v in (attrs.get(k) or "").split() for k, v in need.items())

    @property
    def on(self) -> bool:
        return not self.silent and (not self.wanted or any(c for _, c in self.stack))

    def absolute(self, link: str) -> str:
        if not link or _OTHER_SCHEME.match(link):
            return link
        return urljoin(self.url if self.url.endswith("/") else self.url + "/", link).rstrip("/")

    def put(self, text: str) -> None:
        if self.cells is not None and self.cells:
            self.cells[-1] += text
        else:
            self.out.append(text)

    def handle_starttag(self, tag: str, pairs: list[tuple[str, str | None]]) -> None:
        attrs = dict(pairs)
        if tag == "a" and attrs.get("href"):
            self.links.append(attrs["href"] or "")
        if tag not in _VOID:
            self.stack.append((tag, bool(self.wanted) and self._chosen(tag, attrs)))
        self.silent += tag in _SILENT
        if not self.on:
            return
        if re.fullmatch(r"h[1-6]", tag):
            self.put("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
            self.put("\n")
        elif tag == "li":
            level = self.lists[-1] if self.lists else ["ul", 0]
            level[1] += 1
            self.put("\n" + "  " * len(self.lists) + ("* " if level[0] == "ul" else f"{level[1]}. "))
        elif tag == "tr":
            self.cells = []
        elif tag in ("td", "th") and self.cells is not None:
            self.cells.append("")
        elif tag == "br":
            self.put("  \n")
        elif tag == "hr":
            self.put("\n\n* * *\n\n")
        elif tag in ("b", "strong"):
            self.put("**")
        elif tag in ("i", "em"):
            self.put("_")
        elif tag == "pre":
            self.pre += 1
            self.put("\n\n```\n")
        elif tag == "code" and not self.pre:
            self.put("`")
        elif tag == "img":
            self.put(f"![{attrs.get('alt') or ''}]({self.absolute(attrs.get('src') or '')})")
        elif tag == "a":
            self.href.append(attrs.get("href"))
            self.put("[" if attrs.get("href") else "")
        elif tag in _BLOCK:
            self.put("\n\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in _VOID:
            return
        if self.on:
            if tag in ("b", "strong"):
                self.put("**")
            elif tag in ("i", "em"):
                self.put("_")
            elif tag == "code" and not self.pre:
                self.put("`")
            elif tag == "pre":
                self.pre = max(0, self.pre - 1)
                self.put("\n```\n\n")
            elif tag in ("ul", "ol") and self.lists:
                self.lists.pop()
                self.put("\n")
            elif tag == "tr" and self.cells is not None:
                cells, self.cells = [re.sub(r"\s+", " ", c).strip().replace("|", "&#124;") for c in self.cells], None
                if cells:
                    self.put("\n" + " | ".join(cells) + ("\n" + " | ".join(["---"] * len(cells)) if not self.header_done else ""))
                    self.header_done = True
            elif tag == "table":
                self.header_done = False
                self.put("\n\n")
            elif tag == "a" and self.href:
                link = self.href.pop()
                self.put(f"]({self.absolute(link)})" if link else "")
            elif tag in _BLOCK or re.fullmatch(r"h[1-6]", tag):
                self.put("\n\n")
        self.silent -= tag in _SILENT and self.silent > 0
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                break

    def handle_data(self, data: str) -> None:
        if self.on:
            self.put(data if self.pre else re.sub(r"\s+", " ", data))

    def markdown(self) -> str:
        text = "".join(self.out)
        parts = re.split(r"(```\n[\s\S]*?\n```)", text)
        parts = [p if p.startswith("```\n") else re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+(?=\n)", "", re.sub(r"(?<=\n) (?=\S)", "", p))) for p in parts]
        return "".join(parts).strip()


def remove_fragment(url: str) -> str:
    return urldefrag(url)[0]


def page_key(url: Column | str) -> Column:
    """A URL without fragment and trailing slash, by which pages are visited once."""
    return F.regexp_replace(F.regexp_replace(F.col(url) if isinstance(url, str) else url, "#.*$", ""), "/$", "")


def parse_page(url: str, html: str | None, selectors: list[str] | None = None) -> tuple[str, list[str]]:
    """Markdown, and the links below the page's own address."""
    page = Page(remove_fragment(url), selectors)
    page.feed(html or "")
    page.close()
    split = urlsplit(remove_fragment(url))
    host = urlunsplit((split.scheme, split.netloc, "", "", ""))
    base = host + split.path.rstrip("/")
    links = []
    for link in page.links:
        if re.match(r"^(?:tel:|#|mailto:|javascript:)", link):
            continue
        full = link if re.match(r"^https?:", link) else host + link if link.startswith("/") else page.absolute(link)
        if full.startswith(base):
            links.append(remove_fragment(full))
    return page.markdown(), list(dict.fromkeys(links))


def parse_pages(pages: DataFrame, selectors: list[str] | None = None) -> DataFrame:
    """url, content (Markdown), links. pages: url, html."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(u, *parse_page(u, h, selectors)) for u, h in f.itertuples(index=False)]
            yield pd.DataFrame(rows, columns=["url", "content", "links"])

    return pages.select("url", "html").where("url is not null").mapInPandas(run, "url string, content string, links array<string>")


def crawl(pages: DataFrame, start: DataFrame, depth: int = 2, selectors: list[str] | None = None) -> DataFrame:
    """url, content, level of the pages reached from the start URLs; each is visited once, at its least level.

    Rounds are bounded by the depth; the visited set is anti-joined, never collected.
    """
    parsed = parse_pages(pages, selectors).withColumn("key", page_key("url")).dropDuplicates(["key"])
    parsed = materialize(parsed, "crawl-pages")
    frontier = start.select(page_key("url").alias("key")).distinct()
    visited = None
    for level in range(depth + 1):
        reached = materialize(parsed.join(frontier, "key", "left_semi").withColumn("level", F.lit(level)), f"crawl-{level}")
        visited = reached if visited is None else visited.unionByName(reached)
        frontier = reached.select(F.explode("links").alias("link")).select(page_key("link").alias("key")).distinct().join(visited.select("key"), "key", "left_anti")
    return visited.select("url", "content", "level")
