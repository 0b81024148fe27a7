"""Problem 4: records whose contents differ by small edits.

Method: exact copies are collapsed first; each distinct text gets HASHES minima of universal hash functions over its
distinct five-character substrings, cut into BANDS bands of ROWS. Texts that agree in a band are candidates; signatures
verify them (one byte of each minimum is kept, so the estimate has a standard error below 0.03; MARGIN below the
threshold is five of these), and at last the exact similarity. Groups are connected components by alternating large-star
and small-star.

Bands are shuffled once, as keys and row numbers: a task reads its keys in order and holds no more of a bucket than a
batch and SMALL_BUCKET rows. A bucket of up to SMALL_BUCKET texts lists its pairs. A larger one is cut into chunks, and each
pair of chunks is compared by signature in a task of its own, so that only verified pairs leave it: no bucket is capped, and
none is held by one task. At similarity 0.7 a pair meets in some band with a probability of 0.998, at 0.8 of 0.9999997.

Defined results: null ids and null texts take part in nothing; a record delivered again counts once; texts outside the
length limits, empty ones among them, have no pairs; equal texts under different ids have similarity 1. Substrings are
of code points, on text as stored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespan.session import materialize, n_tasks, spread

CHARS = 5
ROWS, BANDS = 6, 50
HASHES = ROWS * BANDS
MARGIN = 0.14
SMALL_BUCKET = 48
CHUNK = 256
SALTS = 16
_SEED = 20250101


def _functions(bands: int = BANDS) -> tuple[np.ndarray, np.ndarray]:
    """Multiply-add functions of 32 bits, each a permutation."""
    rng = np.random.default_rng(_SEED)
    a = rng.integers(0, 1 << 31, bands * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    return a, rng.integers(0, 1 << 32, bands * ROWS, dtype=np.uint32)


def shingle_hashes(text: str, chars: int = CHARS) -> np.ndarray:
    """64-bit hashes of the text's substrings of that many code points, in order of place."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    n = len(codes) - chars + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for i in range(chars):
        h = (h * np.uint64(1_099_511_628_211)) ^ (codes[i : i + n] + np.uint64(0x9E3779B97F4A7C15))
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
    return h


def signature(text: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The minimum of each function over the text's substrings; repeated ones don't matter to it."""
    x = (shingle_hashes(text) >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(a), np.iinfo(np.uint32).max, dtype=np.uint32)
    for at in range(0, len(x), 512):
        y = np.multiply(x[at : at + 512, None], a[None, :])
        y += b
        np.minimum(out, y.min(axis=0), out=out)
    return out


def jaccard(a: str, b: str, chars: int = CHARS) -> float:
    """The exact similarity; 0 if either text is shorter than a substring."""
    x, y = ({s[i : i + chars] for i in range(len(s) - chars + 1)} for s in (a, b))
    both = len(x & y)
    return both / (len(x) + len(y) - both) if x and y else 0.0


def overlap(x: np.ndarray, y: np.ndarray) -> float:
    """The same of sorted distinct 64-bit hashes, which differ for different substrings of two texts as good as always."""
    if not len(x) or not len(y):
        return 0.0
    both = np.sort(np.concatenate([x, y]))
    same = int((both[1:] == both[:-1]).sum())
    return same / (len(x) + len(y) - same)


def _sign(texts: DataFrame, keep: list[str], n_bands: int = BANDS) -> DataFrame:
    """Columns keep, and the band keys and sketch of column content."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = _functions(n_bands)
        mix = np.random.default_rng(_SEED + 1).integers(0, 1 << 62, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        number = np.arange(n_bands, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        for f in frames:
            bands, sketches = [], []
            for text in f["content"]:
                s = signature(text, a, b)
                v = s.reshape(n_bands, ROWS).astype(np.uint64) * mix
                v ^= v >> np.uint64(31)
                # the band's number is part of its key
                bands.append(((v * mix[::-1]).sum(axis=1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + number).view(np.int64))
                sketches.append((s & np.uint32(255)).astype(np.uint8).tobytes())
            yield f[keep].assign(bands=bands, sketch=sketches)

    kinds = ", ".join(f"{c} {texts.schema[c].dataType.simpleString()}" for c in keep)
    return texts.select(*keep, "content").mapInPandas(run, f"{kinds}, bands array<long>, sketch binary")


def _alike(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Which row pairs of two sketch arrays have an estimated similarity of at least `least`."""
    e = (x == y).mean(axis=1)
    return (e - 1 / 256) / (1 - 1 / 256) >= least


def _sketches(col: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(col), dtype=np.uint8).reshape(len(col), -1)


class Buckets:
    """Reads (key, row) in order of key; gives pairs of rows of small buckets, and the rows of large ones with their chunk."""

    def __init__(self) -> None:
        self.h = self.r = np.zeros(0, dtype=np.int64)
        self.large, self.seen = None, 0  # the large bucket that is being read, and how many of its rows were

    def feed(self, h: np.ndarray, r: np.ndarray, last: bool) -> Iterator[pd.DataFrame]:
        h, r = np.concatenate([self.h, h]), np.concatenate([self.r, r])
        if not len(h):
            return
        starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        sizes = np.diff(np.append(starts, len(h)))
        if not last and sizes[-1] <= SMALL_BUCKET and h[-1] != self.large:
            self.h, self.r = h[starts[-1] :], r[starts[-1] :]  # may go on in the next batch
            starts, sizes = starts[:-1], sizes[:-1]
            h, r = h[: len(h) - len(self.h)], r[: len(r) - len(self.r)]
        else:
            self.h = self.r = np.zeros(0, dtype=np.int64)
        size = np.repeat(sizes, sizes)
        big = (size > SMALL_BUCKET) | (h == self.large) if self.large is not None else size > SMALL_BUCKET
        x, y = h[~big], r[~big]
        a, b = [], []
        for step in range(1, SMALL_BUCKET):
            same = np.flatnonzero(x[:-step] == x[step:])
            if not len(same):
                break
            a.append(y[same])
            b.append(y[same + step])
        if a:
            a, b = np.concatenate(a), np.concatenate(b)
            yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "h": None, "chunk": None})
        for s, n in zip(starts[big[starts]], sizes[big[starts]], strict=True):
            if h[s] != self.large:
                self.large, self.seen = h[s], 0
            yield pd.DataFrame({"a": r[s : s + n], "b": None, "h": h[s], "chunk": (self.seen + np.arange(n)) // CHUNK})
            self.seen += n


def _candidates(signed: DataFrame, least: float) -> DataFrame:
    """Verified candidate pairs a < b of rids."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        buckets = Buckets()
        for f in frames:
            yield from buckets.feed(f["h"].to_numpy(), f["rid"].to_numpy(), False)
        yield from buckets.feed(*np.zeros((2, 0), dtype=np.int64), True)

    keys = signed.select(F.explode("bands").alias("h"), "rid").repartition(n_tasks(signed.sparkSession), "h").sortWithinPartitions("h")
    met = materialize(keys.mapInPandas(read, "a long, b long, h long, chunk long"), "dup-buckets")
    pairs = met.where("b is not null").select("a", "b").distinct()
    left = signed.select(F.col("rid").alias("a"), F.col("sketch").alias("x"))
    right = signed.select(F.col("rid").alias("b"), F.col("sketch").alias("y"))

    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                yield f.loc[_alike(_sketches(f["x"]), _sketches(f["y"]), least), ["a", "b"]]

    out = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInPandas(verify, "a long, b long")
    in_large = met.where("chunk is not null").select(F.col("a").alias("rid"), "h", "chunk")
    if in_large.isEmpty():
        return out
    # each chunk meets itself and every other one
    counts = in_large.groupBy("h").agg(F.max("chunk").alias("last"))
    tasks = in_large.join(counts, "h").select("rid", "h", "chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("o"))
    tasks = tasks.select("rid", "h", F.least("chunk", "o").alias("i"), F.greatest("chunk", "o").alias("j"), F.col("chunk").alias("c")).join(signed.select("rid", "sketch"), "rid")

    def blocks(f: pd.DataFrame) -> pd.DataFrame:
        i, j = f["i"].iloc[0], f["j"].iloc[0]
        one, two = f[f["c"] == i], f[f["c"] == j]
        x, y = _sketches(one["sketch"]), _sketches(two["sketch"])
        found = []
        for r, s in zip(one["rid"].to_numpy(), x, strict=True):
            hit = two["rid"].to_numpy()[_alike(s[None, :], y, least)]
            found += [(min(r, o), max(r, o)) for o in hit if (r < o if i == j else r != o)]
        return pd.DataFrame(found, columns=["a", "b"])

    return out.unionByName(tasks.groupBy("h", "i", "j").applyInPandas(blocks, "a long, b long")).distinct()


def near_duplicates(df: DataFrame, id_col: str, text_col: str, threshold: float, least_chars: int, most_chars: int) -> tuple[DataFrame, DataFrame]:
    """Members (rid, id) and links (a, b, similarity) of distinct texts a < b by rid, both as written tables."""
    n = F.length(text_col)
    rows = df.where(F.col(id_col).isNotNull() & n.between(least_chars, most_chars)).select(F.col(id_col).alias("id"), F.col(text_col).alias("content"))
    keyed = rows.select("id", "content", F.md5(F.col("content").cast("binary")).alias("key"))
    reps = materialize(keyed.dropDuplicates(["key"]).select("key", "content", F.monotonically_increasing_id().alias("rid")), "dup-texts")
    members = materialize(keyed.select("id", "key").distinct().join(reps.select("key", "rid"), "key").select("rid", "id"), "dup-members")
    signed = materialize(_sign(spread(reps), ["rid"]), "dup-signatures")
    cand = _candidates(signed, threshold - MARGIN)

    def exact(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            sets: dict[int, np.ndarray] = {}
            for rids, texts in ((f["a"], f["x"]), (f["b"], f["y"])):
                for r, t in zip(rids, texts, strict=True):
                    if r not in sets:
                        sets[r] = np.unique(shingle_hashes(t))
            s = np.array([overlap(sets[a], sets[b]) for a, b in zip(f["a"], f["b"], strict=True)], dtype=float)
            yield f[["a", "b"]].assign(similarity=s)[s >= threshold]

    texts = reps.select("rid", "content")
    both = cand.join(texts.select(F.col("rid").alias("a"), F.col("content").alias("x")), "a").join(texts.select(F.col("rid").alias("b"), F.col("content").alias("y")), "b")
    return members, materialize(both.select("a", "b", "x", "y").mapInPandas(exact, "a long, b long, similarity double"), "dup-links")


def alike(df: DataFrame, id_col: str, text_col: str, threshold: float, least_chars: int, n_bands: int = 25) -> tuple[DataFrame, DataFrame]:
    """Members (rid, id) and links (a, b) of distinct texts whose signatures agree in a share of `threshold`: the same without
    the exact check, so that texts aren't shuffled. With 25 bands, texts of a similarity of 0.8 meet with a probability of
    0.9995, and the estimate's standard error is 0.033."""
    rows = df.where(F.col(id_col).isNotNull() & (F.length(text_col) >= least_chars)).select(F.col(id_col).alias("id"), F.col(text_col).alias("content"))
    signed = _sign(spread(rows.withColumn("key", F.md5(F.col("content").cast("binary")))), ["id", "key"], n_bands)
    signed = materialize(signed, "alike-signatures")
    one = materialize(signed.select("key", "bands", "sketch").dropDuplicates(["key"]).withColumn("rid", F.monotonically_increasing_id()), "alike-texts")
    members = materialize(signed.select("id", "key").distinct().join(one.select("key", "rid"), "key").select("rid", "id"), "alike-members")
    return members, materialize(_candidates(one, threshold), "alike-links")


def all_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """id_a < id_b of every pair of records with linked or equal texts, each once."""
    one = members.select(F.col("rid").alias("a"), F.col("id").alias("i"))
    two = members.select(F.col("rid").alias("b"), F.col("id").alias("j"))
    between = links.select("a", "b").join(one, "a").join(two, "b").select("i", "j")
    # a text may have very many copies: their ids are salted on one side, and repeated for each salt on the other
    copied = members.join(members.groupBy("rid").agg(F.count("*").alias("n")).where("n > 1").select("rid"), "rid")
    left = copied.select("rid", F.col("id").alias("i"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"))
    right = copied.select("rid", F.col("id").alias("j"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    within = left.join(right, ["rid", "salt"]).where("i < j").select("i", "j")
    return between.unionByName(within).select(F.least("i", "j").alias("id_a"), F.greatest("i", "j").alias("id_b"))


def components(links: DataFrame, most_rounds: int = 50) -> DataFrame:
    """node, root: the least node of each node's component, by alternating large-star and small-star until nothing changes."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    before = None
    for k in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = materialize(small.where("u <> v").distinct(), f"dup-stars-{k}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before is not None and tuple(now) == before:
            break
        before = tuple(now)
    else:
        raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """id, group_id (the least id of the group), n_links (to other distinct texts) of every record in the length limits."""
    degree = links.select(F.explode(F.array("a", "b")).alias("rid")).groupBy("rid").agg(F.count("*").alias("n_links"))
    roots = components(links).select(F.col("node").alias("rid"), "root")
    rooted = members.join(roots, "rid", "left").join(degree, "rid", "left").select("id", F.coalesce("root", "rid").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    names = rooted.groupBy("root").agg(F.min("id").alias("group_id"))
    return rooted.join(names, "root").select("id", "group_id", "n_links")


def classes(members: DataFrame) -> DataFrame:
    """id, class_id of every record in the length limits: the least id with an equal text stands for all of these."""
    return members.join(members.groupBy("rid").agg(F.min("id").alias("class_id")), "rid").select("id", "class_id")


def class_links(members: DataFrame, links: DataFrame) -> DataFrame:
    """class_a < class_b, similarity of the linked texts, by the ids that stand for them."""
    names = members.groupBy("rid").agg(F.min("id").alias("name"))
    both = links.join(names.select(F.col("rid").alias("a"), F.col("name").alias("x")), "a").join(names.select(F.col("rid").alias("b"), F.col("name").alias("y")), "b")
    return both.select(F.least("x", "y").alias("class_a"), F.greatest("x", "y").alias("class_b"), "similarity")
