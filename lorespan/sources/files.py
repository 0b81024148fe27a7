"""Files into paragraphs: text, Markdown, HTML, CSV, XLSX, DOCX and ZIP archives of these; Q&A and plain table imports.

binaryFile rows (path, content) are parsed by Arrow batches; a file's type decides its parser, in a fixed order. A file
that can't be parsed gives no rows. XLS and PDF need libraries that are absent here, so they are read as unknown.
"""

from __future__ import annotations

import csv
import hashlib
import io
import os
import posixpath
import re
import uuid
import zipfile
from collections.abc import Callable, Iterator
from urllib.parse import unquote
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from lorespan.sources.split import MOST_LIMIT, Splitter, patterns_for
from lorespan.sources.web import charset_of, parse_page

QA_TITLE_CHARS, QA_CONTENT_CHARS, QA_PROBLEM_CHARS = 255, 102_400, 255
#: Header prefixes of Q&A sheets.
QA_HEADERS = {"分段标题": "title", "分段内容": "content", "问题": "problem_list"}
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"

#: Members of archives that texts show, and that are no documents themselves.
IMAGES = (".png", ".jpg", ".jpeg", ".gif", ".bmp", ".webp", ".svg")
_IMAGE_LINK = re.compile(r"(!\[[^\]\n]*\]\()([^()\s]+)(\))")

Paragraph = tuple[str, str]


def decode(raw: bytes) -> str:
    for name in ("utf-8-sig", "gb18030", "cp1252"):
        try:
            return raw.decode(name)
        except UnicodeDecodeError:
            continue
    return raw.decode("latin-1")


def table_row(cells: list) -> str:
    return "| " + " | ".join("" if c is None else str(c).replace("\n", "<br>").replace("|", "&#124;") for c in cells) + " |\n"


def table_blocks(rows: Iterator[list], limit: int) -> Iterator[str]:
    """Blocks of a table as Markdown, each with the header, closed before the row that would reach the limit."""
    header = next(rows, None)
    if not header:
        return
    top = table_row(header) + "| " + " | ".join("---" if c is not None else "" for c in header) + " |\n"
    block = ""
    for row in rows:
        line = table_row(row)
        if block and len(block) + len(line) >= limit:
            yield block
            block = ""
        block = (block or top) + line
    if block:
        yield block


def csv_rows(raw: bytes) -> Iterator[list]:
    return iter(csv.reader(io.StringIO(decode(raw), newline="")))


def sheets(raw: bytes) -> Iterator[tuple[str, list[list], list[tuple[int, int, int, int]]]]:
    """Name, rows and merged ranges (first row, first column, last row, last column) of a workbook's sheets."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
        links = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet"):
            target = (links.get(sheet.get(f"{_R}id")) or "").lstrip("/")
            path = target if target.startswith("xl/") else f"xl/{target}"
            root = ET.fromstring(z.read(path))
            rows: list[list] = []
            for row in root.iter(f"{_S}row"):
                at = int(row.get("r") or len(rows) + 1) - 1
                rows += [[] for _ in range(at + 1 - len(rows))]
                for cell in row.iter(f"{_S}c"):
                    column = _column(cell.get("r") or "") if cell.get("r") else len(rows[at])
                    rows[at] += [None] * (column + 1 - len(rows[at]))
                    rows[at][column] = _value(cell, shared)
            width = max(map(len, rows), default=0)
            merged = [_range(m.get("ref") or "") for m in root.iter(f"{_S}mergeCell")]
            yield sheet.get("name") or "", [r + [None] * (width - len(r)) for r in rows], [m for m in merged if m]


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _range(ref: str) -> tuple[int, int, int, int] | None:
    m = re.fullmatch(r"([A-Z]+)(\d+):([A-Z]+)(\d+)", ref)
    return (int(m[2]) - 1, _column(m[1]), int(m[4]) - 1, _column(m[3])) if m else None


def _value(cell: ET.Element, shared: list[str]) -> str | None:
    kind = cell.get("t")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{_S}t"))
    v = cell.find(f"{_S}v")
    if v is None or v.text is None:
        return None
    return shared[int(v.text)] if kind == "s" else {"0": "FALSE", "1": "TRUE"}.get(v.text, v.text) if kind == "b" else v.text


def filled(rows: list[list], merged: list[tuple[int, int, int, int]]) -> list[list]:
    """Merged cells all hold the value of their first."""
    for a, b, c, d in merged:
        value = rows[a][b] if a < len(rows) and b < len(rows[a]) else None
        for i in range(a, min(c, len(rows) - 1) + 1):
            for j in range(b, min(d, len(rows[i]) - 1) + 1):
                rows[i][j] = value
    return rows


def docx_markdown(raw: bytes) -> str:
    """Headings by style or by one run of 30 points and more, tables as Markdown."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        styles = {}
        if "word/styles.xml" in z.namelist():
            styles = {s.get(f"{_W}styleId"): (s.find(f"{_W}name").get(f"{_W}val") if s.find(f"{_W}name") is not None else "") for s in ET.fromstring(z.read("word/styles.xml")).iter(f"{_W}style")}
    out = []
    for part in body if body is not None else []:
        if part.tag == f"{_W}p":
            text = "".join(t.text or "" for t in part.iter(f"{_W}t"))
            style = part.find(f"{_W}pPr/{_W}pStyle")
            name = styles.get(style.get(f"{_W}val"), style.get(f"{_W}val") or "") if style is not None else ""
            m = re.match(r"heading\s*(\d)", name or "", re.I)
            runs = [r for r in part.iter(f"{_W}r") if "".join(t.text or "" for t in r.iter(f"{_W}t")).strip()]
            size = runs[0].find(f"{_W}rPr/{_W}sz") if len(runs) == 1 else None
            big = int(size.get(f"{_W}val") or 0) / 2 if size is not None else 0
            level = int(m[1]) if m else 1 if big >= 36 else 2 if big >= 30 else 0
            out.append("#" * level + " " + text if level and text.strip() else text)
        elif part.tag == f"{_W}tbl":
            rows = [["\n".join("".join(t.text or "" for t in p.iter(f"{_W}t")) for p in cell.iter(f"{_W}p")) for cell in row.iter(f"{_W}tc")] for row in part.iter(f"{_W}tr")]
            out.append("".join(table_blocks(iter(rows), 1 << 30)))
    return "\n".join(out)


def archive_members(raw: bytes) -> Iterator[tuple[str, bytes]]:
    """Files of an archive by name (cp437 names that are UTF-8 or GBK are read as such), without system folders."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        for info in z.infolist():
            name = info.filename
            if not info.flag_bits & 0x800:
                for code in ("utf-8", "gbk"):
                    try:
                        name = info.filename.encode("cp437").decode(code)
                        break
                    except UnicodeError:
                        continue
            if not info.is_dir() and not name.startswith("__MACOSX") and "/__MACOSX" not in name:
                yield name, z.read(info)


def file_id(raw: bytes) -> str:
    """The id under which a content is stored: by its hash, so the same content has one."""
    return str(uuid.UUID(hashlib.sha256(raw).hexdigest()[:32]))


def linked_images(name: str, raw: bytes, images: dict[str, bytes]) -> bytes:
    """A text of an archive with its links to images of the archive turned into links to stored files; others stay."""

    def stored(m: re.Match) -> str:
        path = posixpath.normpath(posixpath.join(posixpath.dirname(name), unquote(m[2])))
        return f"{m[1]}./oss/file/{file_id(images[path])}{m[3]}" if path in images else m[0]

    return _IMAGE_LINK.sub(stored, decode(raw)).encode("utf-8") if images else raw


def parse_file(name: str, raw: bytes, patterns: list[str] | None = None, with_filter: bool = False, limit: int = MOST_LIMIT, errors: list[tuple[str, str]] | None = None) -> list[tuple[str, list[Paragraph]]]:
    """(document name, paragraphs) of a file; an archive gives those of its members. Unreadable files give none, and their
    name and error in errors."""
    low, base = name.lower(), os.path.basename(name)
    split = lambda text, kind=name: Splitter(patterns or patterns_for(kind), with_filter, limit).split(text)
    try:
        if low.endswith((".html", ".htm")):
            return [(base, split(parse_page("", raw.decode(charset_of(raw), "replace"))[0], "x.md"))]
        if low.endswith(".docx"):
            return [(base, split(docx_markdown(raw), "x.md"))]
        if low.endswith(".xlsx"):
            return [(f"{base} {n}", [("", b) for b in table_blocks(iter(rows), limit)]) for n, rows, _ in sheets(raw)]
        if low.endswith(".csv"):
            return [(base, [("", b) for b in table_blocks(csv_rows(raw), limit)])]
        if low.endswith(".zip"):
            members = dict(archive_members(raw))
            images = {n: r for n, r in members.items() if n.lower().endswith(IMAGES)}
            texts = {n: linked_images(n, r, images) if n.lower().endswith((".md", ".txt")) else r for n, r in members.items() if n not in images}
            return [x for n, r in texts.items() for x in parse_file(n, r, patterns, with_filter, limit, errors)]
        if low.endswith((".md", ".txt")) or b"\0" not in raw:
            return [(base, split(decode(raw)))]
        problem = "no text, and of no known kind"
    except (KeyError, ValueError, zipfile.BadZipFile, ET.ParseError, csv.Error) as e:
        problem = f"{type(e).__name__}: {e}"
    if errors is not None:
        errors.append((base, problem))
    return []


def file_text(name: str, raw: bytes) -> str | None:
    """All text of a file, of paragraphs with their titles; None if it can't be read."""
    errors: list[tuple[str, str]] = []
    found = parse_file(name, bytes(raw), errors=errors)
    if errors and not found:
        return None
    return "\n".join("\n".join(filter(None, (t.strip(), c))) for _, ps in found for t, c in ps)


def parse_qa(name: str, raw: bytes) -> list[tuple[str, str, list[str]]]:
    """(title, content, problems) of Q&A sheets: columns by header, else title, content, problems in this order."""
    low = name.lower()
    try:
        if low.endswith(".zip"):
            return [x for n, r in archive_members(raw) for x in parse_qa(n, r)]
        tables = [list(csv_rows(raw))] if low.endswith(".csv") else [rows for _, rows, _ in sheets(raw)] if low.endswith(".xlsx") else []
    except (KeyError, ValueError, zipfile.BadZipFile, ET.ParseError, csv.Error):
        return []
    out = []
    for rows in tables:
        if not rows or not rows[0]:
            continue
        at = {"content": 0} if len(rows[0]) == 1 else {"title": 0, "content": 1, "problem_list": 2}
        for i, head in enumerate(rows[0]):
            at |= {f: i for prefix, f in QA_HEADERS.items() if (head or "").startswith(prefix)}
        for row in rows[1:]:
            cell = lambda f: row[at[f]] if f in at and at[f] < len(row) else None  # noqa: E731, B023
            if cell("content") is not None:
                problems = [p[:QA_PROBLEM_CHARS] for p in (cell("problem_list") or "").split("\n") if p.strip()]
                out.append(((cell("title") or "")[:QA_TITLE_CHARS], cell("content")[:QA_CONTENT_CHARS], problems))
    return out


def parse_table(name: str, raw: bytes) -> list[str]:
    """Rows as 'key:value; key:value' (CSV) or 'key: value; key: value' (XLSX, merged cells filled)."""
    if name.lower().endswith(".csv"):
        lines = decode(raw).split("\n")
        keys = lines[0].rstrip("\r").split(",")
        return ["; ".join(f"{k}:{v}" for k, v in zip(keys, line.rstrip("\r").split(","), strict=False)) for line in lines[1:] if line.strip()]
    out = []
    for _, rows, merged in sheets(raw):
        rows = filled(rows, merged)
        out += ["; ".join(f"{k}: {v}" for k, v in zip(rows[0], row, strict=False) if v is not None) for row in rows[1:] if any(v is not None for v in row)]
    return out


def _each_file(files: DataFrame, run: Callable[[str, bytes], list[tuple]], columns: list[str], schema: str) -> DataFrame:
    def go(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for p, raw in f.itertuples(index=False):
                yield pd.DataFrame([(p, *r) for r in run(p, bytes(raw))] if raw is not None else [], columns=["path", *columns])

    return files.select("path", "content").mapInPandas(go, f"path string, {schema}")


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """path, content of every file below a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def paragraphs_of(files: DataFrame, patterns: list[str] | None = None, with_filter: bool = False, limit: int = MOST_LIMIT) -> DataFrame:
    """path, name, ordinal, title, content, error of files (path, content). A file or member that can't be read has one row
    with its error and nothing else."""

    def run(p: str, raw: bytes) -> list[tuple]:
        errors: list[tuple[str, str]] = []
        found = parse_file(p, raw, patterns, with_filter, limit, errors)
        return [(n, i, t, c, None) for n, ps in found for i, (t, c) in enumerate(ps)] + [(n, None, None, None, e) for n, e in errors]

    return _each_file(files, run, ["name", "ordinal", "title", "content", "error"], "name string, ordinal int, title string, content string, error string")


def qa_of(files: DataFrame) -> DataFrame:
    """path, ordinal, title, content, problems of question-and-answer sheets (path, content)."""
    run = lambda p, raw: [(i, *r) for i, r in enumerate(parse_qa(p, raw))]
    return _each_file(files, run, ["ordinal", "title", "content", "problems"], "ordinal int, title string, content string, problems array<string>")


def table_rows_of(files: DataFrame) -> DataFrame:
    """path, ordinal, content of tables (path, content), a row of text for each of theirs."""
    return _each_file(files, lambda p, raw: list(enumerate(parse_table(p, raw))), ["ordinal", "content"], "ordinal int, content string")


def read_paragraphs(spark: SparkSession, path: str, patterns: list[str] | None = None, with_filter: bool = False, limit: int = MOST_LIMIT) -> DataFrame:
    """paragraphs_of() of every file below a path."""
    return paragraphs_of(binary_files(spark, path), patterns, with_filter, limit)


def read_qa(spark: SparkSession, path: str) -> DataFrame:
    return qa_of(binary_files(spark, path))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return table_rows_of(binary_files(spark, path))


def read_jdbc(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """A database query as a source, read by Spark's own connector."""
    return spark.read.format("jdbc").option("url", url).option("query", query).options(**options).load()
