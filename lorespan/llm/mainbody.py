"""Problem 3: the article's lines of a web page whose text is mixed with the page's navigation and notices.

Method: tree scoring on the tree that the text of a page still shows. Leaves are lines; a run of lines of one kind is a
block; a heading and the blocks below it are a section; the sections make the page. A line has a point, one more for each
comma, and up to three for its length; it passes them to its block in full, to its section by half and to the page by a
quarter. A node's score is its points, discounted by its link density: the share of its letters that are links. The section
with the best score is the article's container. Another section is kept as its sibling, and a block within a kept section
stays, if its score for each of its lines reaches SIBLING of the best one's.

A page's text shows only some of its links, so the share of a line that is link is estimated. Link syntax, menus and trails
show it. Beyond that it is learned from all pages: pages on which nothing shows a link are taken for articles, as they come
from a useful selector. What is more frequent on the other pages than there belongs to links and notices to that extent:
for the shape of a line (list marker, sentence end, length, codes) beside its neighbours' shapes, and for the pairs of words
in it. No phrase is given. On few pages the estimates fall back to the shape alone (PRIOR_PAGES).

The page's title is the line that repeats the end of the trail, or as learned.

Defined results: null and empty contents give no line; blank lines are never given; a paragraph delivered again counts
once; lines are told apart by '\\n' alone; an unclosed code fence holds no code.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import pairwise
from math import exp, log
from statistics import median_low

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespan.session import materialize, spread

#: What a sibling's score for a line must reach of the best one's.
SIBLING = 0.12
#: Pages for which the estimate from a line's shape alone counts.
PRIOR_PAGES = 20
#: Pairs of words and shapes are kept if they are on two pages, and make up this share of all; so at most 1 / LEAST_SHARE are.
LEAST_SHARE = 1e-6
#: Counts a worker holds before it passes them on.
HELD_COUNTS = 400_000
#: Weight of a line's words in log odds, from all of them usual in articles (half of it against) to none.
WORDS = 10
SHORT, LONG, BODY = 90, 300, 140

_LINK = re.compile(r"\[([^\[\]]*)\]\([^()\s]*\)")
_BRACKETS = re.compile(r"(?:\[[^\[\]]{1,40}\]\s*){2,}")
_PART = re.compile(r"\s+[>»›/→|]\s+")
_ITEM = re.compile(r"([-*•+–]|\d{1,3}[.)、])\s+")
_HEADING = re.compile(r"#{1,6}\s")
_END = re.compile(r"[.!?;。！？；…:：][\s*_\"'”’»）)\]]*$")
_COMMA = re.compile(r"[,，、;；]")
_CODE = re.compile(r"[A-Z]{2,}-\d+")
_WORD = re.compile(r"[⺀-鿿]|(?:(?![⺀-鿿])[^\W\d_])+|\d+|[^\w\s]")
_NOT_LETTER = re.compile(r"[\W_]+")


@dataclass
class Line:
    no: int
    text: str
    kind: str  # code, table, heading, item, menu, text
    shape: str
    letters: int
    links: float = 0.0  # estimated share of letters that are links

    @property
    def points(self) -> float:
        return 1 + len(_COMMA.findall(self.text)) + min(len(self.text) / 100, 3)


@dataclass
class Node:
    """A block or section with its lines, and the points they passed to it."""

    lines: list[Line] = field(default_factory=list)
    share: float = 1.0

    def density(self) -> float:
        n = sum(x.letters for x in self.lines)
        return min(sum(x.letters * x.links for x in self.lines) / n, 1.0) if n else 0.0

    def score(self) -> float:
        return self.share * sum(x.points * (1 - x.links) for x in self.lines) * (1 - self.density())

    def per_line(self) -> float:
        return self.score() / len(self.lines)

    def typical(self) -> float:
        """What a usual line of it scores."""
        return median_low([x.points * (1 - x.links) for x in self.lines if x.links < 0.5] or [0.0])


def _key(text: str) -> str:
    return _NOT_LETTER.sub("", text.casefold())


def parts_of(text: str) -> list[str]:
    """The parts of a menu or trail of links: three or more short ones between separators."""
    if text[:1] in "#|-*`" or len(text) > LONG or _END.search(text):
        return []
    parts = [p.strip() for p in _PART.split(text)]
    return parts if len(parts) >= 3 and all(p and len(p) <= 120 for p in parts) else []


def lines_of(content: str) -> list[Line]:
    """The lines that aren't blank."""
    out, in_code = [], False
    for no, text in enumerate(content.split("\n")):
        bare = text.strip()
        if not bare:
            continue
        indent = "indented " if text[:1].isspace() else ""
        item = _ITEM.match(bare)
        end, code = " end" if _END.search(bare) else "", " code" if _CODE.search(bare) else ""
        size = " short" if len(bare) <= SHORT else " long" if len(bare) > LONG else " medium"
        letters = len(_NOT_LETTER.sub("", text))
        if bare.startswith("```"):
            kind, shape, in_code = "code", "fence", not in_code
        elif in_code:
            kind, shape = "code", "code"
        elif bare.startswith("|"):
            kind, shape = "table", "table"
        elif _HEADING.match(bare):
            kind, shape = "heading", "heading"
        elif _BRACKETS.fullmatch(bare):
            kind, shape = "menu", "brackets"
        elif (found := _LINK.findall(bare)) and sum(len(_key(x)) for x in found) >= 0.8 * len(_key(_LINK.sub(r"\1", bare))):
            kind, shape = "menu", "link"
        elif parts := parts_of(bare):
            sign = _PART.search(bare)[0].strip()
            named = ":" in parts[0] or "：" in parts[0]
            kind, shape = ("text" if named else "menu"), f"parts {sign}" + (" named" if named else "")
        elif item:
            kind, shape = "item", f"{indent}item {'0' if item[1][0].isdigit() else item[1]}{end}{code}{size}"
        else:
            kind, shape = "text", f"{indent}text{end}{code}{size}"
        out.append(Line(no, text, kind, shape, letters))
    if in_code:
        return lines_of(content.replace("```", "'''"))
    return out


def _side(line: Line | None) -> str:
    """What a neighbour tells of a line: the page's edge or a menu, a short line without an end, or content."""
    if line is None or line.kind == "menu":
        return "edge"
    return "title" if line.kind in ("text", "item") and " end" not in line.shape and " code" not in line.shape and " short" in line.shape and not line.shape.startswith("indented") else "content"


def contexts(lines: list[Line]) -> list[str]:
    """Shape of each line; of a short one without an end, which may be a title or a link, beside its neighbours'."""
    around = [None, *lines, None]
    return [f"{_side(a)} < {x.shape} > {_side(b)}" if _side(x) == "title" else x.shape for a, x, b in zip(around, lines, around[2:], strict=False)]


def word_pairs(text: str) -> list[str]:
    words = ["^", *("0" if w[0].isdigit() else w.lower() for w in _WORD.findall(text)), "$"]
    return [f"{a} {b}" for a, b in pairwise(words)]


def shows_links(lines: list[Line]) -> bool:
    return any(x.kind == "menu" for x in lines)


def is_body(line: Line) -> bool:
    """Whether a line is as long as notices and links are not, and ends like a sentence."""
    return line.kind in ("text", "item") and bool(_END.search(line.text)) and len(line.text) + sum(c > "⺀" for c in line.text) > BODY


def counts_of(content: str) -> tuple[bool, Counter]:
    """Whether the page shows links, and how often it has each context ("c ...") and, once a page, each pair of words, in
    its body ("b ...") and elsewhere ("w ...")."""
    lines = lines_of(content)
    out = Counter("c " + c for c in contexts(lines))
    for kind, body in (("w ", False), ("b ", True)):
        out.update({kind + p for x in lines if x.kind in ("text", "item") and is_body(x) == body for p in word_pairs(x.text)})
    return shows_links(lines), out


class Links:
    """Estimated share of a line that is link or notice: by how much its context and its pairs of words are more frequent
    on pages that show links. counts: key to numbers on pages that do and don't."""

    def __init__(self, counts: dict[str, tuple[int, int]], with_links: int, without: int) -> None:
        self.with_links, self.without = with_links, without
        self.contexts = {k[2:]: v for k, v in counts.items() if k.startswith("c ")}
        # rates of a pair in short lines of pages with links, in bodies of these, and on pages without
        self.words: dict[str, tuple[float, float, float]] = {}
        for p in {k[2:] for k in counts if k[0] in "wb"}:
            there, here = counts.get("w " + p, (0, 0))
            body, clean = counts.get("b " + p, (0, 0))
            self.words[p] = (there / max(with_links, 1), body / max(with_links, 1), max(here, clean) / max(without, 1))

    def _excess(self, there: int, here: int) -> float:
        """Share of the occurrences on pages with links that pages without don't explain."""
        if not there or not self.without:
            return 0.0
        return max(0.0, 1 - ((here + 1) / self.without) / (there / self.with_links))

    def of_context(self, line: Line, context: str) -> float:
        prior = 1.0 if line.kind == "menu" else 0.85 if _side(line) == "title" and not context.startswith("edge <") else 0.0
        there, here = self.contexts.get(context, (0, 0))
        # pages with links are not the ones to be compared with alone: both kinds must be known
        weight = min(there, self.with_links, self.without)
        return (prior * PRIOR_PAGES + self._excess(there, here) * weight) / (PRIOR_PAGES + weight)

    def likeness(self, lines: list[Line]) -> float:
        """How well pages without links cover what this page is about, its language above all: the rate there of the word
        pairs of its body, by their rate in bodies of pages with links."""
        rates = [self.words[p] for x in lines if is_body(x) for p in word_pairs(x.text) if p in self.words]
        body = sum(b for _, b, _ in rates)
        return min(max(sum(c for _, _, c in rates) / body, 0.02), 1.0) if body else 1.0

    def of_words(self, text: str, likeness: float) -> float:
        """Share of the line's word pairs that neither bodies nor pages without links explain."""
        if not self.without:
            return 0.0
        pairs, out = word_pairs(text), 0.0
        for p in pairs:
            there, body, clean = self.words.get(p, (0.0, 0.0, 0.0))
            if there:
                out += max(0.0, 1 - max((clean + 0.5 / self.without) / likeness, body + 0.5 / self.with_links) / there)
        return out / len(pairs)

    def mark(self, lines: list[Line]) -> None:
        title, likeness = self._title(lines), self.likeness(lines)
        for x, c in zip(lines, contexts(lines), strict=True):
            if x is title:
                continue
            shown = sum(len(_key(t)) for t in _LINK.findall(x.text)) / x.letters if x.letters and x.kind != "code" else 0.0
            x.links = max(min(shown, 1.0), self.estimate(x, c, likeness))

    def estimate(self, line: Line, context: str, likeness: float) -> float:
        """The context's share as odds, multiplied by the evidence of the words; links repeat titles, so with short lines
        without an end usual words tell nothing."""
        share = min(max(self.of_context(line, context), 0.02), 0.98)
        if line.kind not in ("text", "item"):
            return share
        words = self.of_words(line.text, likeness)
        evidence = max(words - 0.6, 0.0) if _side(line) == "title" else words - 0.5
        return 1 / (1 + exp(-log(share / (1 - share)) - WORDS * evidence))

    @staticmethod
    def _title(lines: list[Line]) -> Line | None:
        """The line after a trail that repeats the trail's end."""
        for i, x in enumerate(lines):
            if x.kind == "menu" and (parts := parts_of(x.text.strip())):
                last = _key(parts[-1])
                if found := next((y for y in lines[i + 1 :] if y.kind in ("heading", "text") and _key(y.text) == last), None):
                    return found
        return None


def tree_of(lines: list[Line]) -> list[list[Node]]:
    """Blocks by section. A block's lines are of one kind and are all rather links or all rather not."""
    sections: list[list[Node]] = []
    before = None
    for x in lines:
        group = (x.kind, x.links >= 0.5)
        if not sections or (x.kind == "heading" and before != "heading"):
            sections.append([])
            before = None
        if before is None or group != last:
            sections[-1].append(Node())
        sections[-1][-1].lines.append(x)
        before, last = x.kind, group
    return sections


def article_lines(content: str | None, links: Links) -> list[int]:
    if not content:
        return []
    lines = lines_of(content)
    links.mark(lines)
    sections = tree_of(lines)
    nodes = [Node([x for b in s for x in b.lines], 0.5) for s in sections]
    if not nodes:
        return []
    best = max(nodes, key=Node.score)
    least = SIBLING * best.typical()
    kept = []
    for blocks, node in zip(sections, nodes, strict=True):
        if node is best or node.typical() >= least or max(b.per_line() for b in blocks) >= least:
            kept += [x.no for b in blocks if b.per_line() >= least for x in b.lines]
    return kept


def fit(contents: Iterable[str]) -> Links:
    """Links of page texts at hand."""
    pages, counts = [0, 0], {}
    for c in contents:
        shows, of = counts_of(c)
        pages[not shows] += 1
        for k, n in of.items():
            v = counts.setdefault(k, [0, 0])
            v[not shows] += n
    return Links({k: (a, b) for k, (a, b) in counts.items() if a + b > 1}, *pages)


def fit_pages(pages: DataFrame) -> Links:
    """The same of all pages (content); what reaches the driver is bounded by LEAST_SHARE."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple[Counter, Counter] = (Counter(), Counter())

        def rows() -> pd.DataFrame:
            return pd.DataFrame([(k, held[0][k], held[1][k]) for k in {*held[0], *held[1]}], columns=["key", "there", "here"])

        for f in frames:
            for c in f["content"]:
                if c:
                    shows, of = counts_of(c)
                    held[not shows].update(of)
                    held[not shows]["p"] += 1
            if len(held[0]) + len(held[1]) > HELD_COUNTS:
                yield rows()
                held[0].clear(), held[1].clear()
        yield rows()

    counts = pages.select("content").mapInPandas(count, "key string, there long, here long").groupBy("key").agg(F.sum("there").alias("there"), F.sum("here").alias("here"))
    counts = materialize(counts.where((F.col("there") + F.col("here") > 1) | (F.col("key") == "p")), "page-counts")
    total = counts.agg(F.sum(F.col("there") + F.col("here"))).first()[0] or 0
    got = {r.key: (r.there, r.here) for r in counts.where((F.col("there") + F.col("here") >= LEAST_SHARE * total) | (F.col("key") == "p")).toPandas().itertuples(index=False)}
    return Links(got, *got.pop("p", (0, 0)))


def main_lines(pages: DataFrame, links: Links) -> DataFrame:
    """paragraph_id, line_no, line of the article's lines. pages: paragraph_id, content."""
    shared = pages.sparkSession.sparkContext.broadcast(links)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for i, c in f.itertuples(index=False):
                split = c.split("\n") if c else []
                out.append((i, [{"line_no": n, "line": split[n]} for n in article_lines(c, shared.value)]))
            yield pd.DataFrame(out, columns=["paragraph_id", "lines"])

    kept = pages.mapInPandas(run, "paragraph_id string, lines array<struct<line_no: int, line: string>>").where(F.size("lines") > 0)
    return kept.dropDuplicates(["paragraph_id"]).select("paragraph_id", F.explode("lines").alias("x")).select("paragraph_id", "x.line_no", "x.line")


def web_pages(paragraph: DataFrame, document: DataFrame) -> DataFrame:
    """paragraph_id, content of the paragraphs of web documents, as a written table."""
    web = document.where(F.col("doc_type") == 1).select(F.col("id").alias("document_id"))
    rows = spread(paragraph.where(F.col("id").isNotNull() & F.col("content").isNotNull()).select("id", "document_id", "content"))
    return materialize(rows.join(web, "document_id", "left_semi").select(F.col("id").alias("paragraph_id"), "content"), "web-pages")
