"""Problem 6: cut oversized items into pieces within a limit, at natural boundaries, with an overlap.

Method: an item is seen as ranges, and no step holds a whole item. (1) Workers take one range with a halo of HALO
characters on each side and list the cut points in the range itself, strongest first kind: paragraph, line, sentence,
clause, word; the halo makes the decision at the range's edges equal to that on the whole. (2) The lengths of the ranges are
prefix-summed in two levels, groups of ranges and ranges in a group, without their cut points; this stitches the local
tables into one of global offsets. (3) An item is divided into sections of SECTION times its limit, each ending at the best
cut point within the limit before that place. Sections are folded in tasks of their own, in order of range, so one giant
file keeps many tasks busy; a task holds one range and one open piece. (4) Pieces are joined to the ranges they touch, and
the parts are put together in order. Items of at most the limit never enter (3).

For text columns, ranges are parts of a value; for files (split_files) they are byte ranges that each worker reads at their
offsets, from any file system pyarrow can open by the path's scheme.

A piece has at most max_chars characters (code points). Its end is the last cut point of the strongest kind that lies in
the last two thirds of the room; where there's none, it is cut at max_chars. Each further piece starts overlap_chars before
the end of the one before, moved back to the start of a word if there is one within as many characters again and room
remains, so consecutive pieces share overlap_chars characters or slightly more. Pieces cover the item without a gap.

Defined results: null and empty items and items within the limit give no piece; a repeated item key counts once; rows of
equal texts under different keys are separate items; columns of other names are ignored.
"""

from __future__ import annotations

import os
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from lorespan.session import materialize, n_tasks

RANGE_CHARS = 65_536
RANGE_BYTES = 1 << 20
#: Characters on each side of a range that its worker also sees; all patterns look at fewer.
HALO = 8
#: Kinds of cut points, strongest first. A cut point is the offset after the match.
KINDS = (
    r"\n[ \t\r]*\n",
    r"\n",
    r"[.!?…][\"'”’»)\]]{0,3}[ \t　]|[。！？][”’」』）]{0,3}",
    r"[;:,][ \t]|[；：，、]",
    r"[ \t　]",
)
_PATTERNS = [re.compile(p) for p in KINDS]
#: A piece ends in this last part of its room if it can.
ROOM = 2 / 3
#: Sections of an item, in limits; and ranges of one group of the prefix sum.
SECTION = 256
GROUP = 1024


def cut_points(text: str, left: int, right: int) -> list[int]:
    """Cut points in (left, right] of a text with halos, relative to left, as offset * 8 + kind; each offset once, by its strongest kind."""
    best: dict[int, int] = {}
    for kind, pattern in reversed(list(enumerate(_PATTERNS))):
        for m in pattern.finditer(text):
            if left < m.end() <= right:
                best[m.end() - left] = kind
    return [k * 8 + v for k, v in sorted(best.items())]


class Fold:
    """Takes an item's cut points in order of offset and gives pieces (start, end) as soon as they're decided."""

    def __init__(self, max_chars: int, overlap: int, start: int = 0) -> None:
        self.max, self.overlap = max_chars, min(max(overlap, 0), max_chars // 2)
        self.start, self.known, self.points = start, start, []

    def feed(self, cuts: list[tuple[int, int]], known: int, last: bool) -> Iterator[tuple[int, int]]:
        """cuts: (offset, kind) up to the offset known; last: known is the item's end."""
        self.points += cuts
        self.known = known
        while self.known - self.start > self.max or (last and self.known > self.start):
            if last and self.known - self.start <= self.max:
                yield self.start, self.known
                self.start = self.known
                return
            end = self._end()
            yield self.start, end
            self.start = self._next(end)
        del self.points[: bisect_right(self.points, (self.start, 8))]

    def _end(self) -> int:
        low, high = self.start + int(self.max * (1 - ROOM)), self.start + self.max
        room = self.points[bisect_right(self.points, (low, 8)) : bisect_right(self.points, (high, 8))]
        return min(room, key=lambda p: (p[1], -p[0]))[0] if room else high

    def _next(self, end: int) -> int:
        """Where the next piece starts; always after this one's start."""
        if not self.overlap:
            return end
        want = end - self.overlap
        at = bisect_right(self.points, (want, 8)) - 1
        word = self.points[at][0] if at >= 0 else -1
        return word if word > self.start and word >= want - self.overlap else max(want, self.start + 1)


def ranges(items: DataFrame, text_col: str = "text", size: int = RANGE_CHARS) -> DataFrame:
    """item_key, max_chars, overlap_chars, range_no, left (of the halo), n, body (with halos). One pass over each text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for k, most, over, text in f.itertuples(index=False):
                for at in range(0, len(text), size):
                    left = min(HALO, at)
                    out.append((k, most, over, at // size, left, min(size, len(text) - at), text[at - left : at + size + HALO]))
                    if len(out) == 256:
                        yield pd.DataFrame(out, columns=columns)
                        out = []
            yield pd.DataFrame(out, columns=columns)

    columns = ["item_key", "max_chars", "overlap_chars", "range_no", "left", "n", "body"]
    full = items.where(F.length(text_col) > 0).select("item_key", "max_chars", "overlap_chars", text_col)
    return full.mapInPandas(run, "item_key string, max_chars int, overlap_chars int, range_no long, left int, n int, body string")


def boundary_table(cut: DataFrame) -> DataFrame:
    """One row per range with its length and cut points."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(k, m, o, r, n, cut_points(b, left, left + n)) for k, m, o, r, left, n, b in f.itertuples(index=False)]
            yield pd.DataFrame(rows, columns=["item_key", "max_chars", "overlap_chars", "range_no", "n_chars", "cuts"])

    return cut.mapInPandas(run, "item_key string, max_chars int, overlap_chars int, range_no long, n_chars long, cuts array<long>")


def offsets(boundaries: DataFrame) -> DataFrame:
    """item_key, range_no, offset, total: where each range starts. Lengths alone are summed, first by groups of ranges, so
    no task sees more than GROUP ranges or one row of each group of an item."""
    slim = boundaries.select("item_key", "range_no", "n_chars", F.floor(F.col("range_no") / GROUP).alias("g"))
    before = lambda keys, order: W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    groups = slim.groupBy("item_key", "g").agg(F.sum("n_chars").alias("n"))
    groups = groups.select("item_key", "g", F.coalesce(F.sum("n").over(before(["item_key"], "g")), F.lit(0)).alias("base"), F.sum("n").over(W.partitionBy("item_key")).alias("total"))
    within = slim.withColumn("inner", F.coalesce(F.sum("n_chars").over(before(["item_key", "g"], "range_no")), F.lit(0)))
    return within.join(groups, ["item_key", "g"]).select("item_key", "range_no", (F.col("base") + F.col("inner")).alias("offset"), "total")


def section_edge(points: list[tuple[int, int]], place: int, max_chars: int) -> int:
    """Where the section that ends about `place` does: at the best cut point in the limit before it."""
    room = points[bisect_right(points, (place - max_chars, 8)) : bisect_right(points, (place, 8))]
    return min(room, key=lambda p: (p[1], -p[0]))[0] if room else place


def plan_pieces(boundaries: DataFrame) -> DataFrame:
    """item_key, section, piece_in_section, start, end (characters), and the first and last range touched, of the items that
    need more than one piece. Numbers within the item are given by numbered().

    A section's task reads the ranges from the limit and twice the overlap before it to its end.
    """
    size = F.col("max_chars").cast("long") * SECTION
    back = F.col("max_chars").cast("long") * 2
    placed = boundaries.join(offsets(boundaries), ["item_key", "range_no"]).where(F.col("total") > F.col("max_chars"))
    last_section = F.floor((F.col("total") - 1) / size)
    of_range = F.sequence(F.floor(F.col("offset") / size), F.least(F.floor((F.col("offset") + F.col("n_chars") + back) / size), last_section))
    tasks = placed.withColumn("section", F.explode(of_range))

    limits = SECTION

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["item_key", "section", "piece_in_section", "start", "end", "first_range", "last_range"]
        key, section = None, None
        for f in frames:
            out = []
            for k, s, most, overlap, r, n, cuts, off, total in f[["item_key", "section", "max_chars", "overlap_chars", "range_no", "n_chars", "cuts", "offset", "total"]].itertuples(index=False):
                if (k, s) != key:
                    if section:
                        out += section.finish()
                    key, section = (k, s), Section(k, int(s), most, overlap, int(total), most * limits)
                out += section.feed(int(r), int(off), int(n), [(int(off) + (c >> 3), c & 7) for c in map(int, cuts)])
            yield pd.DataFrame(out, columns=columns)
        if section:
            yield pd.DataFrame(section.finish(), columns=columns)

    spread = tasks.repartition(n_tasks(boundaries.sparkSession), "item_key", "section").sortWithinPartitions("item_key", "section", "range_no")
    return spread.mapInPandas(run, "item_key string, section long, piece_in_section int, start long, end long, first_range long, last_range long")


class Section:
    """Pieces of one section; ranges are fed in order."""

    def __init__(self, key: str, number: int, max_chars: int, overlap: int, total: int, size: int) -> None:
        self.key, self.number, self.max, self.overlap, self.total = key, number, max_chars, overlap, total
        self.begin, self.stop = number * size, min((number + 1) * size, total)
        self.fold: Fold | None = Fold(max_chars, overlap) if number == 0 else None
        self.points: list[tuple[int, int]] = []  # before the section's first piece is known, and within the limit before its end
        self.starts: list[tuple[int, int]] = []  # offset and number of the ranges
        self.pieces, self.known = 0, 0

    def feed(self, r: int, offset: int, n: int, cuts: list[tuple[int, int]]) -> list[tuple]:
        self.starts.append((offset, r))
        self.known = offset + n
        self.points += cuts
        if self.fold is None:
            if self.known < self.begin and self.known < self.total:
                return []
            # the first piece starts before the section's edge by the overlap
            edge = section_edge(self.points, self.begin, self.max)
            first = Fold(self.max, self.overlap)
            first.points = self.points
            self.fold = Fold(self.max, self.overlap, first._next(edge) if self.overlap else edge)
            self.points = [p for p in self.points if p[0] > self.fold.start]
        # cut points near the section's end wait until its edge is known
        sure = min(self.known, self.stop if self.stop == self.total else self.stop - self.max)
        at = bisect_right(self.points, (sure, 8))
        out = self._rows(self.fold.feed(self.points[:at], max(sure, self.fold.known), False))
        self.points = self.points[at:]
        return out

    def finish(self) -> list[tuple]:
        if self.fold is None:
            return []
        edge = self.stop if self.stop == self.total else section_edge(self.points, self.stop, self.max)
        return self._rows(self.fold.feed([p for p in self.points if p[0] <= edge], edge, True))

    def _rows(self, pieces: Iterator[tuple[int, int]]) -> list[tuple]:
        out = []
        for a, b in pieces:
            first = bisect_right(self.starts, (a, 1 << 62)) - 1
            last = bisect_left(self.starts, (b, -1)) - 1
            out.append((self.key, self.number, self.pieces, a, b, self.starts[first][1], self.starts[last][1]))
            self.pieces += 1
        if gone := max(bisect_right(self.starts, (self.fold.start, 1 << 62)) - 1, 0):
            del self.starts[:gone]
        return out


def numbered(pieces: DataFrame) -> DataFrame:
    """With piece_no: the number of pieces in the sections before, and the one within."""
    counts = pieces.groupBy("item_key", "section").agg(F.count("*").alias("n"))
    before = W.partitionBy("item_key").orderBy("section").rowsBetween(W.unboundedPreceding, -1)
    base = counts.select("item_key", "section", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return pieces.join(base, ["item_key", "section"]).withColumn("piece_no", (F.col("base") + F.col("piece_in_section")).cast("int")).drop("base")


def touched_ranges(pieces: DataFrame) -> DataFrame:
    return pieces.select("item_key", "piece_no", "start", "end", F.explode(F.sequence("first_range", "last_range")).alias("range_no"))


def emit_pieces(pieces: DataFrame, cut: DataFrame, size: int = RANGE_CHARS) -> DataFrame:
    """The pieces with their text, put together from the ranges they touch."""
    touched = touched_ranges(numbered(pieces))
    parts = touched.join(cut.select("item_key", "range_no", "left", "n", "body"), ["item_key", "range_no"])
    base = F.col("range_no") * size
    a = F.greatest(F.col("start") - base, F.lit(0))
    b = F.least(F.col("end") - base, F.col("n").cast("long"))
    part = F.substring(F.col("body"), (F.col("left") + a + 1).cast("int"), (b - a).cast("int"))
    return (
        parts.groupBy("item_key", "piece_no", "start", "end")
        .agg(F.array_sort(F.collect_list(F.struct("range_no", part.alias("part")))).alias("parts"))
        .select("item_key", "piece_no", "start", "end", F.concat_ws("", F.transform("parts", lambda x: x["part"])).alias("text"))
    )


def split_items(items: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Pieces as offsets, and the ranges to emit them from. items: item_key, text_col, max_chars, overlap_chars; keys are unique."""
    cut = ranges(items.where(F.length(text_col) > F.col("max_chars")), text_col)
    return plan_pieces(materialize(boundary_table(cut), "split-boundaries")), cut


def settings(spark: SparkSession, split_setting: DataFrame) -> dict[tuple[str, str], tuple[int, int]]:
    """split_setting as parameters: one row for each table and field that may be cut, so a handful; more than 1,000 are refused."""
    rows = split_setting.limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("split_setting is a table of parameters; it has over 1000 rows")
    return {(r.item_table, r.field): (int(r.max_chars), int(r.overlap_chars or 0)) for r in rows if r.max_chars and r.max_chars > 0}


def items_of(spark: SparkSession, tables: dict[str, DataFrame], limits: dict[tuple[str, str], tuple[int, int]]) -> DataFrame:
    """Oversized fields of paragraph and document_import as items; a record delivered again counts once."""
    out = []
    sources = {
        "paragraph": lambda d: d.select(F.col("id").alias("item_id"), F.lit(0).alias("item_no"), "title", "content"),
        "document_import": lambda d: d.select(F.col("id").alias("item_id"), F.posexplode("paragraphs").alias("item_no", "p")).select("item_id", "item_no", F.col("p.title").alias("title"), F.col("p.content").alias("content")),
    }
    for (name, field), (most, overlap) in limits.items():
        if name in tables and field in ("title", "content"):
            rows = sources[name](tables[name]).select(F.lit(name).alias("item_table"), "item_id", "item_no", F.lit(field).alias("field"), F.col(field).alias("text"))
            out.append(rows.where(F.length("text") > most).select("*", F.lit(most).alias("max_chars"), F.lit(overlap).alias("overlap_chars")))
    if not out:
        raise ValueError("split_setting names no known field")
    every = out[0]
    for x in out[1:]:
        every = every.unionByName(x)
    every = every.where(F.col("item_id").isNotNull()).dropDuplicates(["item_table", "item_id", "item_no", "field"])
    return every.withColumn("item_key", F.concat_ws("\x1f", "item_table", "item_id", F.col("item_no").cast("string"), "field"))


def key_parts() -> list:
    part = lambda i: F.split("item_key", "\x1f")[i]
    return [part(0).alias("item_table"), part(1).alias("item_id"), part(2).cast("int").alias("item_no"), part(3).alias("field")]


# --- giant files ---


def file_ranges(spark: SparkSession, paths: list[str], max_chars: int, overlap_chars: int, size: int = RANGE_BYTES) -> DataFrame:
    """Byte ranges of files, by path or URI; only sizes are looked up on the driver."""
    rows = []
    for p in paths:
        files, path = _opened(p)
        rows.append((p, files.get_file_info(path).size or 0))
    files = spark.createDataFrame(rows, "item_key string, total_bytes long")
    every = files.where("total_bytes > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("total_bytes") - 1) / size))).alias("range_no"))
    return every.repartition(n_tasks(spark), "item_key", "range_no").select("*", F.lit(max_chars).alias("max_chars"), F.lit(overlap_chars).alias("overlap_chars"))


def _opened(uri: str) -> tuple[object, str]:
    """File system and path of a URI; of a bare path, the local one's."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else os.path.abspath(uri))


def _read(uri: str, start: int, end: int) -> bytes:
    files, path = _opened(uri)
    with files.open_input_file(path) as file:
        return file.read_at(end - start, start)


def _aligned(raw: bytes, at: int) -> int:
    """The first offset from at on that starts a UTF-8 character."""
    while at < len(raw) and raw[at] & 0xC0 == 0x80:
        at += 1
    return at


def file_boundaries(cut: DataFrame, size: int = RANGE_BYTES) -> DataFrame:
    """Boundary table of UTF-8 files: a range owns the characters that start in it; bytes that are no UTF-8 become U+FFFD."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for k, total, r, most, over in f[["item_key", "total_bytes", "range_no", "max_chars", "overlap_chars"]].itertuples(index=False):
                lo = max(0, r * size - 4 * HALO - 4)
                raw = _read(k, lo, min(total, (r + 1) * size + 4 * HALO + 4))
                a, b = _aligned(raw, r * size - lo), _aligned(raw, min(total, (r + 1) * size) - lo)
                left, body, right = (x.decode("utf-8", "replace") for x in (raw[_aligned(raw, 0) : a], raw[a:b], raw[b:]))
                left, right = left[-HALO:], right[:HALO]
                out.append((k, most, over, r, len(body), b - a, lo + a, cut_points(left + body + right, len(left), len(left) + len(body))))
            yield pd.DataFrame(out, columns=["item_key", "max_chars", "overlap_chars", "range_no", "n_chars", "n_bytes", "from_byte", "cuts"])

    return cut.mapInPandas(run, "item_key string, max_chars int, overlap_chars int, range_no long, n_chars long, n_bytes long, from_byte long, cuts array<long>")


def split_files(spark: SparkSession, paths: list[str], max_chars: int, overlap_chars: int, size: int = RANGE_BYTES) -> DataFrame:
    """item_key (path), piece_no, start, end, text of files of any size; no worker holds more than a range and its pieces."""
    table = materialize(file_boundaries(file_ranges(spark, paths, max_chars, overlap_chars, size), size), "file-boundaries")
    pieces = numbered(materialize(plan_pieces(table), "file-pieces"))
    spans = table.select("item_key", "range_no", "n_chars", "from_byte", "n_bytes").join(offsets(table).select("item_key", "range_no", F.col("offset").alias("from_char")), ["item_key", "range_no"])
    near = touched_ranges(pieces).join(spans, ["item_key", "range_no"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out, held = [], (None, -1, "")
            for k, no, a, b, c, n, byte, size_ in f[["item_key", "piece_no", "start", "end", "from_char", "n_chars", "from_byte", "n_bytes"]].itertuples(index=False):
                if held[:2] != (k, byte):
                    held = (k, byte, _read(k, byte, byte + size_).decode("utf-8", "replace"))
                out.append((k, no, a, b, c, held[2][max(a - c, 0) : min(b - c, n)]))
            yield pd.DataFrame(out, columns=["item_key", "piece_no", "start", "end", "from_char", "part"])

    parts = near.repartition("item_key", "from_byte").sortWithinPartitions("item_key", "from_byte").mapInPandas(run, "item_key string, piece_no int, start long, end long, from_char long, part string")
    return (
        parts.groupBy("item_key", "piece_no", "start", "end")
        .agg(F.array_sort(F.collect_list(F.struct("from_char", "part"))).alias("parts"))
        .select("item_key", "piece_no", "start", "end", F.concat_ws("", F.transform("parts", lambda x: x["part"])).alias("text"))
    )
