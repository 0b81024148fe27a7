"""Splitting by headings, files of all kinds, web pages and crawls."""

import io
import random
import re
import zipfile

from lorespan.functions.text import MARKDOWN_PATTERNS, PLAIN_PATTERNS
from lorespan.sources import files, web
from lorespan.sources.split import Splitter, cut_at_periods, pack_lines, split_documents

MD = "intro\n# A\nalpha\n## A1\none\n## A2\ntwo\n# B\n\n# C\nend"


def test_headings():
    got = Splitter().split(MD)
    assert ("", "intro\n") in got and (" A", "\nalpha\n") in got and (" A  A1", "\none\n") in got and (" A  A2", "\ntwo\n") in got and (" C", "\nend") in got
    assert ("", "# B") in got  # a heading with a blank body becomes content
    assert Splitter().split(None) == Splitter().split("") == []
    assert Splitter().split("a\r\nb\0c") == [("", "a\nbc")]


def test_leading_text_comes_before_sub_sections():
    titles = [t for t, _ in Splitter().split("# A\nlead\n## A1\nx")]
    assert titles == [" A", " A  A1"]


def test_limits_and_filters():
    assert pack_lines("ab\ncd\nef", 6) == ["ab\ncd\n", "ef"]
    assert [len(c) for _, c in Splitter(limit=10).split("x" * 120)] == [50, 50, 20]
    assert Splitter(with_filter=True).split("a\n\n\nb  c") == [("", "a\nb c")]
    long = "# " + "t" * 300 + "\nbody"
    (title, content), *_ = Splitter().split(long)
    assert len(title) <= 255 and content.endswith("body")
    assert len(Splitter(PLAIN_PATTERNS).split("a\n\nb\n\n\nc")) == 3


def test_split_on_spark(spark):
    df = spark.createDataFrame([(1, MD, "x"), (2, None, "x"), (3, "", "x")], "doc_id long, text string, title string")
    rows = split_documents(df, "doc_id", "text").collect()
    assert {r.doc_id for r in rows} == {1} and [r.ordinal for r in rows] == list(range(len(rows)))
    assert split_documents(df.limit(0), "doc_id", "text").count() == 0


def _xlsx(rows, merged=""):
    cell = lambda r, c, v: "" if v is None else f'<c r="{chr(65 + c)}{r + 1}" t="inlineStr"><is><t>{v}</t></is></c>'
    body = "".join(f'<row r="{i + 1}">' + "".join(cell(i, j, v) for j, v in enumerate(r)) + "</row>" for i, r in enumerate(rows))
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{body}</sheetData>{merged}</worksheet>")
    return out.getvalue()


def _docx():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, style="": f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>" if style else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
    tc = lambda t: f"<w:tc>{p(t)}</w:tc>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{p('Top', 'h1')}{p('text')}<w:tbl><w:tr>{tc('k')}{tc('v')}</w:tr><w:tr>{tc('1')}{tc('2')}</w:tr></w:tbl></w:body></w:document>")
        z.writestr("word/styles.xml", f'<w:styles {w}><w:style w:styleId="h1"><w:name w:val="heading 1"/></w:style></w:styles>')
    return out.getvalue()


def test_tables():
    raw = "h1,h2\n1,a|b\n2,\"c\nd\"\n".encode()
    (name, paragraphs), = files.parse_file("dir/t.csv", raw)
    assert name == "t.csv" and paragraphs == [("", "| h1 | h2 |\n| --- | --- |\n| 1 | a&#124;b |\n| 2 | c<br>d |\n")]
    assert len(files.parse_file("t.csv", raw, limit=45)[0][1]) == 2
    assert files.parse_table("t.csv", b"a,b\n1,2\n\n3,4") == ["a:1; b:2", "a:3; b:4"]
    merged = '<mergeCells><mergeCell ref="A2:A3"/></mergeCells>'
    assert files.parse_table("t.xlsx", _xlsx([["k", "v"], ["m", "1"], [None, "2"]], merged)) == ["k: m; v: 1", "k: m; v: 2"]
    assert files.parse_file("t.xlsx", _xlsx([["k"], ["1"]]))[0][1] == [("", "| k |\n| --- |\n| 1 |\n")]


def test_questions_and_answers():
    raw = "分段标题,分段内容,问题（每行一个）\nT,C,\"q1\n\nq2\"\n,only,\n".encode()
    assert files.parse_qa("x.csv", raw) == [("T", "C", ["q1", "q2"]), ("", "only", [])]
    assert files.parse_qa("x.csv", b"content\nc1\n") == [("", "c1", [])] and files.parse_qa("x.csv", b"") == [] and files.parse_qa("x.xlsx", b"broken") == []


def test_documents_and_archives(spark, tmp_path):
    assert files.parse_file("a.docx", _docx()) == [("a.docx", [(" Top", "\ntext\n| k | v |\n| --- | --- |\n| 1 | 2 |\n")])]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("d/a.md", "# H\nbody")
        z.writestr("__MACOSX/a.md", "no")
        z.writestr("b.docx", b"broken")
    (tmp_path / "z.zip").write_bytes(out.getvalue())
    (tmp_path / "p.txt").write_text("one\n\ntwo")
    (tmp_path / "q.html").write_bytes('<meta charset="gbk"><h1>标题</h1><p>正文</p>'.encode("gbk"))
    rows = files.read_paragraphs(spark, str(tmp_path)).collect()
    assert sorted((r.name, r.title, r.content.strip()) for r in rows if r.error is None) == [("a.md", " H", "body"), ("p.txt", "", "one\n\ntwo"), ("q.html", " 标题", "正文")]
    assert [(r.name, r.ordinal, r.content) for r in rows if r.error] == [("b.docx", None, None)]


def test_text_files_have_headings_but_coding_lines():
    text = "# -*- coding: utf-8 -*-\n# A\nx\n## B\ny"
    assert [t for t, _ in files.parse_file("p.txt", text.encode())[0][1]] == ["", " A", " A  B"]
    assert [t for t, _ in files.parse_file("p.md", text.encode())[0][1]][1:] == [" A", " A  B"]
    assert files.file_text("a.txt", b"# A\nx") == "A\n\nx" and files.file_text("a.docx", b"broken") is None
    late = b"a" * 5000 + b"\0"
    errors = []
    assert files.parse_file("a.bin", late, errors=errors) == [] and errors[0][0] == "a.bin"


def test_images_of_archives_become_stored_files():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("d/a.md", "# H\n![x](img/a%20b.png) ![y](../c.png) ![z](https://h.example/d.png) ![q](gone.png)")
        z.writestr("d/img/a b.png", b"\x89PNG\0one")
        z.writestr("c.png", b"\x89PNG\0two")
    errors = []
    ((name, ((title, content),)),) = files.parse_file("z.zip", out.getvalue(), errors=errors)
    one, two = files.file_id(b"\x89PNG\0one"), files.file_id(b"\x89PNG\0two")
    assert (name, title) == ("a.md", " H") and not errors and one != two
    assert content.strip() == f"![x](./oss/file/{one}) ![y](./oss/file/{two}) ![z](https://h.example/d.png) ![q](gone.png)"


def test_pieces_end_at_periods():
    assert cut_at_periods("", 5) == [] and cut_at_periods("abc", 5) == ["abc"] and cut_at_periods("abcdefg", 3) == ["abc", "def", "g"]
    assert cut_at_periods("a. bcd. efghij", 6) == ["a.", " bcd.", " efghi", "j"]
    rng = random.Random(2)
    for _ in range(300):
        t, n = "".join(rng.choices("ab. ", k=rng.randint(0, 60))), rng.randint(1, 12)
        pieces = cut_at_periods(t, n)
        assert "".join(pieces) == t and all(0 < len(p) <= n for p in pieces)
        assert all(p.endswith(".") or "." not in p for p in pieces[:-1])


def _by_rules(text, patterns, limit):
    """The eight rules, told anew over a nested list: [heading, children] or a text."""
    compiled = [re.compile(p) for p in patterns]

    def parse(part, level):
        names = next((n for n in ([m[0][:255] for m in p.finditer(part) if m[0]] for p in compiled[level:]) if n), [])
        if not names:
            return pack_lines(part, limit)
        if level == 0 and not part.lstrip().startswith(names[0].lstrip()):
            names = ["", *names]
        strays, out, at = [], [], 0
        for i, n in enumerate(names):
            place = part.find(n, at)
            if place < 0:
                continue
            strays = pack_lines(part[at:place], limit)[::-1] + strays
            stop = part.find(names[i + 1], place + len(n)) if i + 1 < len(names) else len(part)
            at = len(part) if stop < 0 else stop
            body = part[place + len(n) : at]
            below = parse(body, level + 1) if body else []
            first = (below[0] if isinstance(below[0], str) else below[0][0]) if below else ""
            if (lead := body.lstrip().find(first.lstrip())) > 0:
                below = below + parse(body[:lead], level + 1)
            out.append([n, below])
        return strays + out

    def rows(nodes, chain):
        return [r for x in nodes for r in ([(chain, x)] if isinstance(x, str) else rows(x[1], (*chain, x[0])))]

    return rows(parse(text, 0), ())


def test_leaves_follow_the_rules():
    rng = random.Random(1)
    parts = ["# A\n", "## B\n", "### C\n", "# A", "\n", "text ", "line.\n", "  \n", "# AB\n", "#### D\n", "x" * 30, "word word\n", "# " + "t" * 260 + "\n"]
    for _ in range(2000):
        t, limit = "".join(rng.choices(parts, k=rng.randint(1, 14))), rng.choice([50, 100_000])
        got = [(chain, b) for _, chain, b in Splitter(limit=limit).leaves(t)]
        assert got == _by_rules(t, MARKDOWN_PATTERNS, limit), t


def test_html_and_selectors():
    html = '<html><head><title>t</title></head><body><nav><a href="/x">n</a></nav><div class="main big"><h2>H</h2><p>a <b>b</b> <a href="sub">l</a></p><ul><li>i</li></ul><pre>c  d</pre></div><script>s</script></body></html>'
    all_, links = web.parse_page("https://h.example/base#f", html)
    part, _ = web.parse_page("https://h.example/base", html, [".main"])
    assert "## H" in part and "**b**" in part and "[l](https://h.example/base/sub)" in part and "* i" in part and "c  d" in part and "n]" not in part and "s" not in part.split()
    assert "[n](https://h.example/base/x)" in all_ or "/x" in all_
    assert "https://h.example/base/sub" in links and web.parse_page("https://h.example", None) == ("", [])


def test_crawl_visits_once_and_stops(spark):
    page = lambda *to: "".join(f'<a href="{t}">x</a>' for t in to)
    pages = spark.createDataFrame([("https://h.example/d", page("/d/a", "/d/b#x", "https://other.example/")), ("https://h.example/d/a", page("/d/a/", "/d/a/deep")), ("https://h.example/d/b", page("/d")), ("https://h.example/d/a/deep", page("/d/a/deep/er")), ("https://h.example/d/a/deep/er", "")], "url string, html string")
    start = spark.createDataFrame([("https://h.example/d/",)], "url string")
    got = {r.url: r.level for r in web.crawl(pages, start, 2).collect()}
    assert got == {"https://h.example/d": 0, "https://h.example/d/a": 1, "https://h.example/d/b": 1, "https://h.example/d/a/deep": 2}
