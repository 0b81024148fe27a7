"""Text expressions: Column to Column, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK_CHARS = 256
#: The characters after which a chunk may end.
CHUNK_ENDS = r"[。 |\\.！;；!\n]"
_MARKED = rf"(?s).{{1,{CHUNK_CHARS}}}{CHUNK_ENDS}"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(text: Column | str) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(col(text), r"(?U)^\s+|\s+$", "")


def mark_chunks(text: Column | str) -> Column:
    """Chunks of a text: every greedy run of up to 256 characters that ends in a mark, then what lies between the runs,
    cut at 256; stripped, without blank ones. Runs come before remainders, so the order isn't that of the text.
    Null gives null, empty text an empty array."""
    text = col(text)
    runs = F.regexp_extract_all(text, F.lit(_MARKED), F.lit(0))
    rests = F.flatten(F.transform(F.split(text, _MARKED), lambda r: F.regexp_extract_all(r, F.lit(rf"(?s).{{1,{CHUNK_CHARS}}}"), F.lit(0))))
    return F.filter(F.transform(F.concat(runs, rests), strip), lambda c: F.length(c) > 0)


def normalize(text: Column | str) -> Column:
    """One kind of line end, no NUL."""
    return F.translate(F.regexp_replace(col(text), r"\r\n?", "\n"), "\0", "")


def clean(text: Column | str) -> Column:
    """Runs of line ends and of spaces become one, number signs and tabs go."""
    out = col(text)
    for pattern, new in ((r"\n+", "\n"), (r" +", " "), (r"#+", ""), (r"\t+", "")):
        out = F.regexp_replace(out, pattern, new)
    return out


#: Patterns and replacements that turn Markdown into plain text, in the order that gives the required result.
_PLAIN = (
    (r"!\[.*?\]\(.*?\)", ""),
    (r"\[([^\]]+)\]\([^)]+\)", "$1"),
    (r"(?m)^#{1,6}\s+", ""),
    (r"\*\*(.*?)\*\*", "$1"),
    (r"__(.*?)__", "$1"),
    (r"\*(.*?)\*", "$1"),
    (r"_(.*?)_", "$1"),
    (r"`(.*?)`", "$1"),
    (r"```[\s\S]*?```", ""),
    (r"\n{2,}", "\n"),
    (r"<[^>]+>", ""),
    (r"(?U)\s+", " "),
)


def markdown_to_plain(text: Column | str) -> Column:
    out = col(text)
    for pattern, new in _PLAIN:
        out = F.regexp_replace(out, pattern, new)
    return strip(out)


def drop_blank_lines(text: Column | str) -> Column:
    return F.array_join(F.filter(F.split(col(text), "\n"), lambda x: F.length(strip(x)) > 0), "\n")


def speakable(text: Column | str) -> Column:
    """Text for a voice: no blank lines, no markup."""
    return markdown_to_plain(drop_blank_lines(text))


def image_links(text: Column | str) -> Column:
    return F.regexp_extract_all(col(text), F.lit(r"!\[.*?\]\(.*?\)"), F.lit(0))


def stored_file_ids(text: Column | str) -> Column:
    """Ids of stored images and files that a text refers to."""
    return F.array_distinct(F.regexp_extract_all(col(text), F.lit(r"/oss/(?:image|file)/([0-9A-Za-z-]+)"), F.lit(1)))


def mask_secret(text: Column | str) -> Column:
    """Two fifths of the start (1 to 8 characters), 15 stars, a fifth of the end (up to 4)."""
    text = col(text)
    n = F.length(text)
    two_fifths, fifth = F.floor(n / 5 * 2).cast("int"), F.floor(n / 5).cast("int")
    start = F.when(two_fifths > 8, 8).when(two_fifths <= 0, 1).otherwise(two_fifths)
    end = F.when(two_fifths < 4, fifth).otherwise(4)
    return F.concat(F.substring(text, F.lit(1), start), F.lit("*" * 15), F.when(end > 0, F.substring(text, n - end + 1, end)).otherwise(""))


def sha256_hex(text: Column | str) -> Column:
    return F.sha2(col(text).cast("binary"), 256)


def md5_hex(text: Column | str) -> Column:
    return F.md5(col(text).cast("binary"))


def uuid5(name: Column | str, namespace_hex: str = "6ba7b8109dad11d180b400c04fd430c8") -> Column:
    """Name-based UUID of version 5 (the DNS namespace by default)."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(col(name), "UTF-8")))
    nibble = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4
    variant = F.element_at(F.array(*[F.lit(x) for x in "89ab"]), nibble + 1)
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def data_tag(text: Column | str, tag: str = "data") -> Column:
    """What the first <tag>…</tag> holds, or the whole text."""
    found = F.regexp_extract(col(text), rf"(?s)<{tag}>(.*?)</{tag}>", 1)
    return F.when(F.length(found) > 0, found).otherwise(col(text))


def split_reasoning(text: Column | str, start: str = "<think>", end: str = "</think>") -> Column:
    """struct(reasoning, answer): the text between the first start and end tag, and the rest. An open tag reasons to the end."""
    text = col(text)
    a = F.locate(start, text)
    b = F.when(a > 0, F.locate(end, text, 1)).otherwise(0)
    reasoning = F.when(a == 0, "").when(b <= a, F.substring(text, a + len(start), F.length(text))).otherwise(F.substring(text, a + len(start), b - a - len(start)))
    before = F.when(a == 0, text).otherwise(F.substring(text, F.lit(1), a - 1))
    after = F.when((a > 0) & (b > a), F.substring(text, b + len(end), F.length(text))).otherwise("")
    return F.struct(reasoning.alias("reasoning"), F.concat(before, after).alias("answer"))


def chapter_title(text: Column | str) -> Column:
    """A chapter's title without its Chinese enumeration."""
    return F.regexp_replace(strip(text), r"^(?:第[一二三四五六七八九十百零\d]+[章节篇部]|[一二三四五六七八九十百]+、|[（(][一二三四五六七八九十百\d]+[）)])\s*", "")


def protected_words(text: Column | str) -> Column:
    """Version numbers and e-mail addresses, in the order of the text, parts of a colon apart."""
    words = F.regexp_extract_all(col(text), F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}|[vV]?\d+(?:\.\d+)+"), F.lit(0))
    return F.flatten(F.transform(words, lambda w: F.split(w, ":")))


def tokens(text: Column | str) -> Column:
    """Search tokens, lower case, in order: words of letters and digits, and for East Asian runs each character and each pair."""
    text = F.lower(col(text))
    parts = F.regexp_extract_all(text, F.lit(r"[぀-ヿ㐀-鿿]+|[\p{L}\p{N}&&[^぀-ヿ㐀-鿿]]+"), F.lit(0))
    pair = lambda p: F.flatten(F.transform(F.sequence(F.lit(1), F.length(p)), lambda i: F.when(i < F.length(p), F.array(F.substring(p, i, F.lit(1)), F.substring(p, i, F.lit(2)))).otherwise(F.array(F.substring(p, i, F.lit(1))))))
    return F.flatten(F.transform(parts, lambda p: F.when(p.rlike(r"^[぀-ヿ㐀-鿿]"), pair(p)).otherwise(F.array(p))))


def keywords(text: Column | str, stop_words: list[str]) -> Column:
    return F.array_distinct(F.filter(tokens(text), lambda t: ~t.isin(*stop_words)) if stop_words else tokens(text))


def icontains(text: Column | str, part: str) -> Column:
    """Case-insensitive containment; nothing in the part has a special meaning."""
    return F.lower(col(text)).contains(part.lower())


def formula_safe(text: Column | str) -> Column:
    """A cell that no spreadsheet takes for a formula: a byte order mark before = + - @."""
    return F.when(col(text).rlike(r"^[=+\-@]"), F.concat(F.lit("﻿"), col(text))).otherwise(col(text))


#: The split patterns offered by name, and their regular expressions.
SPLIT_PATTERNS = {
    "#": r"(?<=^)# .*|(?<=\n)# .*",
    "##": r"(?<=\n)(?<!#)## (?!#).*|(?<=^)(?<!#)## (?!#).*",
    "###": r"(?<=\n)(?<!#)### (?!#).*|(?<=^)(?<!#)### (?!#).*",
    "####": r"(?<=\n)(?<!#)#### (?!#).*|(?<=^)(?<!#)#### (?!#).*",
    "#####": r"(?<=\n)(?<!#)##### (?!#).*|(?<=^)(?<!#)##### (?!#).*",
    "######": r"(?<=\n)(?<!#)###### (?!#).*|(?<=^)(?<!#)###### (?!#).*",
    "-": r"(?<! )- .*",
    "space": r"(?<! ) (?! )",
    "semicolon": r"(?<!；)；(?!；)",
    "comma": r"(?<!，)，(?!，)",
    "period": r"(?<!。)。(?!。)",
    "enter": r"(?<!\n)\n(?!\n)",
    "blank line": r"(?<!\n)\n\n(?!\n)",
}
MARKDOWN_PATTERNS = [SPLIT_PATTERNS["#" * n] for n in range(1, 7)]
#: Fixed value: the first level of text files, which leaves out coding lines.
TEXT_PATTERNS = [r"(?<=^)# (?!-\*- coding:).*|(?<=\n)# (?!-\*- coding:).*", *MARKDOWN_PATTERNS[1:]]
PLAIN_PATTERNS = [r"(?<!\n)\n\n+"]
