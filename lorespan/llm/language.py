"""Problem 9: the language of documents and of the segments of mixed ones, with a confidence.

Method: language-bitmask n-gram filters. A Bloom filter is bit-sliced: each of its cells holds one bit per language, so
one look-up of an n-gram's cells, and-ed, gives the set of all languages that know it. Per sentence, the bits are counted
per language, corrected for the filter's false positives, and the largest share decides. N-grams are four characters of a
word (with its borders), or two East Asian characters (kana, Han, Hangul).

Filters are fitted on a bounded sample, FIT_DOCS documents of each label, the first by hash of the id; labels may be wrong,
so an n-gram enters a language only if its rate there is at least RATE of its best rate, and the documents whose text
then disagrees with their label are left out of a second fit.

Sentences of one language in a row make a segment. A language belongs to a document if at least MIN_SENTENCES complete
sentences are in it; names, codes and lone phrases aren't sentences. If fewer than two do, the language of the whole text
is the document's.

Defined results: null and empty texts, and texts without n-grams known to any language, have a null language and
confidence 0; texts of fewer than MIN_LETTERS letters are no case; a label in another spelling is read by its language;
equal scores go to the language first in order of code.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorespan.session import spread

FIT_DOCS = 400
FIT_CHARS = 20_000
MIN_LETTERS = 40
MIN_SENTENCES = 2
RATE = 0.2
CELLS_PER_GRAM = 16
HASHES = 3
#: Least share of a sentence's n-grams that its language knows, and least lead over the next one.
LEAST_SHARE, LEAST_LEAD = 0.35, 0.04

#: Other names of the languages that labels use, by code: three-letter codes, and the languages' own names.
OTHER_NAMES = {
    "en": ("eng", "english"),
    "zh": ("zho", "chi", "cmn", "chinese", "中文", "汉语", "漢語", "mandarin"),
    "de": ("deu", "ger", "german", "deutsch"),
    "fr": ("fra", "fre", "french", "français", "francais"),
    "es": ("spa", "spanish", "español", "espanol", "castellano"),
    "pt": ("por", "portuguese", "português", "portugues"),
    "ru": ("rus", "russian", "русский"),
    "ja": ("jpn", "japanese", "日本語"),
}

_SENTENCE_END = re.compile(r"[.!?…]+[\"'”’»)\]]*(?=\s|$|[^\x00-˿])|[。！？]+[”’」』）]*|\n+")
_SPACE, _LETTER, _WIDE = 0, 1, 2


def label_codes(names: dict[str, str]) -> dict[str, str]:
    """Spellings of labels, lower case, by code. names: code to language name."""
    out = {}
    for code, name in names.items():
        for spelling in (code, name, *OTHER_NAMES.get(code, ())):
            if spelling:
                out[spelling.lower()] = code
    return out


def read_label(label, spellings: dict[str, str]):
    """Column of the code a label names, or null: the part before a region or script, in any case."""
    text = F.lower(F.trim(F.regexp_replace(label, r"(?U)\s+", " ")))
    base = F.regexp_replace(text, r"[-_.@ (].*$", "")
    table = F.create_map(*[F.lit(x) for kv in sorted(spellings.items()) for x in kv])
    return F.coalesce(F.try_element_at(table, text), F.try_element_at(table, base))


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Class and lower-case form of each code point of the basic planes; others are spaces."""
    kind = np.zeros(0x30000, dtype=np.uint8)
    low = np.arange(0x30000, dtype=np.uint32)
    for c in range(0x30000):
        ch = chr(c)
        if ch.isalpha():
            kind[c] = _LETTER
            if len(ch.lower()) == 1:
                low[c] = ord(ch.lower())
    for a, b in ((0x2E80, 0x2FE0), (0x3005, 0x3008), (0x3040, 0x3100), (0x3400, 0x4DC0), (0x4E00, 0xA000), (0xAC00, 0xD7A4), (0xF900, 0xFB00), (0x20000, 0x30000)):
        kind[a:b] = _WIDE
    low[kind == _SPACE] = 32
    return kind, low


_KIND, _LOW = _classes()


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the text's n-grams, and their offsets."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    codes = np.where(codes < 0x30000, codes, 32)
    kind = np.concatenate([[_SPACE], _KIND[codes], [_SPACE] * 3])
    low = np.concatenate([[32], _LOW[codes], [32] * 3]).astype(np.uint64)
    n = len(codes)
    wide = (kind[:-1] == _WIDE) & (kind[1:] == _WIDE)
    word = (kind[1 : n + 1] == _LETTER) & (kind[2 : n + 2] == _LETTER) & (kind[0:n] != _WIDE) & (kind[3 : n + 3] != _WIDE)
    a = np.flatnonzero(wide[:n])
    b = np.flatnonzero(word)
    two = (low[a] << np.uint64(21)) | low[a + 1]
    four = (((low[b] * np.uint64(0x1F1F1F1F1F) + low[b + 1]) * np.uint64(0x9E3779B97F4A7C15) + low[b + 2]) * np.uint64(0xC2B2AE3D27D4EB4F) + low[b + 3]) | np.uint64(1 << 63)
    return np.concatenate([two, four]), np.concatenate([np.maximum(a - 1, 0), b])


def _mix(x: np.ndarray, i: int) -> np.ndarray:
    x = (x ^ np.uint64(0x9E3779B97F4A7C15 * (i + 1) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(29))


class Filters:
    """Bit-sliced Bloom filter: cell -> bits of languages."""

    def __init__(self, languages: list[str], known: dict[int, int]) -> None:
        if len(languages) > 64:
            raise ValueError("a cell holds the bits of 64 languages")
        self.languages = languages
        size = 1 << max(int(np.ceil(np.log2(max(len(known), 1) * CELLS_PER_GRAM))), 10)
        self.mask = np.uint64(size - 1)
        self.cells = np.zeros(size, dtype=np.uint64)
        x = np.fromiter(known, dtype=np.uint64, count=len(known))
        bits = np.fromiter(known.values(), dtype=np.uint64, count=len(known))
        for i in range(HASHES):
            np.bitwise_or.at(self.cells, (_mix(x, i) & self.mask).astype(np.int64), bits)
        fill = np.array([((self.cells >> np.uint64(j)) & np.uint64(1)).mean() for j in range(len(languages))])
        self.false = fill**HASHES

    def bits(self, x: np.ndarray) -> np.ndarray:
        """n-grams by languages, 0 or 1."""
        at = self.cells[(_mix(x, 0) & self.mask).astype(np.int64)]
        for i in range(1, HASHES):
            at = at & self.cells[(_mix(x, i) & self.mask).astype(np.int64)]
        return ((at[:, None] >> np.arange(len(self.languages), dtype=np.uint64)[None, :]) & np.uint64(1)).astype(np.float64)

    def shares(self, counts: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Share of n-grams each language knows, less the false positives to be expected."""
        p = counts / np.maximum(n, 1)[:, None]
        return np.clip((p - self.false) / (1 - self.false), 0, 1)


def fit(rows: list[tuple[str, str]], languages: list[str]) -> Filters:
    """rows: label code and text."""
    number = {c: i for i, c in enumerate(languages)}
    sets = [(number[c], np.unique(grams(t)[0])) for c, t in rows if c in number]

    def known(use: list[tuple[int, np.ndarray]]) -> dict[int, int]:
        docs = Counter(i for i, _ in use)
        rates: dict[int, dict[int, float]] = {}
        for i in docs:
            values, times = np.unique(np.concatenate([g for j, g in use if j == i] or [np.zeros(0, np.uint64)]), return_counts=True)
            for g, k in zip(values.tolist(), times.tolist(), strict=True):
                rates.setdefault(g, {})[i] = k / docs[i]
        out = {}
        for g, of in rates.items():
            best = max(of.values())
            out[g] = sum(1 << i for i, r in of.items() if r >= RATE * best)
        return out

    first = Filters(languages, known(sets))
    sure = []
    for i, g in sets:
        if len(g):
            share = first.shares(first.bits(g).sum(0)[None, :], np.array([len(g)]))[0]
            if share.argmax() == i:
                sure.append((i, g))
    return Filters(languages, known(sure or sets))


def sentences(text: str) -> list[tuple[int, int, bool]]:
    """Start, end and whether it ends like a sentence, of the parts of a text between sentence ends and line ends."""
    out, at = [], 0
    for m in _SENTENCE_END.finditer(text):
        whole = m[0][0] != "\n"
        end = m.end() if whole else m.start()
        if end > at and not text[at:end].isspace():
            out.append((at, end, whole))
        at = m.end()
    if at < len(text) and not text[at:].isspace():
        out.append((at, len(text), False))
    return out


class Judge:
    """Languages of sentences and texts by the filters."""

    def __init__(self, filters: Filters) -> None:
        self.f = filters

    def text(self, text: str) -> tuple[str | None, float, list[tuple[int, int, str, float]], list[str]]:
        """Language and confidence of the text, its segments (start, end, language, confidence), and its languages by sentences."""
        g, at = grams(text)
        if not len(g):
            return None, 0.0, [], []
        parts = sentences(text)
        starts = np.array([p[0] for p in parts])
        bits = self.f.bits(g)
        part = np.clip(np.searchsorted(starts, at, side="right") - 1, 0, None)
        counts = np.zeros((len(parts), len(self.f.languages)))
        np.add.at(counts, part, bits)
        n = np.bincount(part, minlength=len(parts))
        shares = self.f.shares(counts, n)
        whole = self.f.shares(counts.sum(0)[None, :], np.array([n.sum()]))[0]
        order = np.sort(shares, axis=1)
        best = shares.argmax(1)
        lead = order[:, -1] - (order[:, -2] if shares.shape[1] > 1 else 0)
        sure = (order[:, -1] >= LEAST_SHARE) & (lead >= LEAST_LEAD) & (n >= 4)
        # names and code are known to all languages, so they weigh little
        weight = np.bincount(best[sure], weights=(n * lead)[sure], minlength=len(self.f.languages))
        main = int(weight.argmax()) if weight.any() else int(whole.argmax()) if whole.any() else -1
        if main < 0:
            return None, 0.0, [], []
        complete = Counter(int(b) for b, s, p in zip(best, sure, parts, strict=True) if s and p[2])
        languages = [self.f.languages[i] for i, k in sorted(complete.items()) if k >= MIN_SENTENCES]
        confidence = float(weight[main] / weight.sum()) if weight.any() else float(whole[main] / whole.sum())
        segments: list[list] = []
        for i, (a, b, _) in enumerate(parts):
            if not sure[i]:
                if segments:
                    segments[-1][1] = b
                continue
            if segments and segments[-1][2] == best[i]:
                segments[-1][1] = b
                segments[-1][3].append((shares[i, best[i]], n[i]))
            else:
                segments.append([a, b, best[i], [(shares[i, best[i]], n[i])]])
        spans = [(a, b, self.f.languages[k], float(np.average([s for s, _ in c], weights=[w for _, w in c]))) for a, b, k, c in segments]
        return self.f.languages[main], confidence, spans, languages


def fit_on(docs: DataFrame, codes: dict[str, str]) -> Filters:
    """Filters from documents (doc_id, text, lang) by their labels; a bounded sample goes to the driver."""
    read = docs.where(F.length("text").between(MIN_LETTERS, FIT_CHARS)).select("doc_id", "text", read_label(F.col("lang"), label_codes(codes)).alias("code")).where(F.col("code").isNotNull())
    first = Window.partitionBy("code").orderBy(F.xxhash64("doc_id"), "doc_id")
    some = read.withColumn("n", F.row_number().over(first)).where(F.col("n") <= FIT_DOCS).select("code", "text").collect()
    return fit([(r.code, r.text) for r in some], sorted(codes))


def codes_of(language_code: DataFrame) -> dict[str, str]:
    """language_code as a parameter; it names at most the 64 languages of a cell."""
    rows = language_code.limit(65).collect()
    if len(rows) > 64:
        raise ValueError("language_code names over 64 languages")
    return {r.lang: r.language_name for r in rows if r.lang}


RESULT = "doc_id long, lang string, n_letters long, language string, confidence double, languages array<string>, segments array<struct<start: int, `end`: int, language: string, confidence: double>>"


def judge(docs: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, lang, n_letters, language, confidence, languages, segments of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by = Judge(shared.value)
        for f in frames:
            out = []
            for i, lang, letters, text in f.itertuples(index=False):
                a, b, c, d = by.text(text) if text else (None, 0.0, [], [])
                out.append((i, lang, letters, a, b, d, [{"start": s, "end": e, "language": x, "confidence": y} for s, e, x, y in c]))
            yield pd.DataFrame(out, columns=["doc_id", "lang", "n_letters", "language", "confidence", "languages", "segments"])

    letters = F.coalesce(F.length(F.regexp_replace("text", r"[^\p{L}]", "")), F.lit(0)).cast("long")
    return spread(docs.select("doc_id", "lang", letters.alias("n_letters"), "text")).mapInPandas(run, RESULT)


def wrong_labels(judged: DataFrame, codes: dict[str, str]) -> DataFrame:
    """doc_id, lang (of the text): one row per language of each document whose label is missing or wrong, or whose text is mixed."""
    mixed = F.size("languages") > 1
    label = read_label(F.col("lang"), label_codes(codes))
    case = mixed | label.isNull() | (label != F.col("language"))
    rows = judged.where((F.col("n_letters") >= MIN_LETTERS) & F.col("language").isNotNull() & case)
    return rows.select("doc_id", F.explode(F.when(mixed, F.col("languages")).otherwise(F.array("language"))).alias("lang"))
