"""Problem 8: put texts, sized in tokens, into as few containers of a fixed capacity as possible.

Method: conflict-constrained best fit. Items go in by falling size, those of crowded sources and clusters first; open bins are ordered by residual, and each carries a
bitmap of the sources and one of the duplicate clusters in it. The successor search starts at the tightest bin that has
room and goes on, bin by bin and residual by residual, until one without the item's source and cluster is found; if there
is none, the item opens a bin. So no container holds two texts of a source or of a cluster, and a source or cluster of
more texts than containers would be needed for has a container for each of them.

Spread: items are dealt to shards of about SHARD_ITEMS by a hash of their id, so neither a hot source nor a hot group of
copies meets in one task. Shards are packed on their own; bins filled below FULL are then dissolved and their items
packed again in fewer shards, until one shard remains or a round no longer saves a container. What enters a round is what
shards left open, a small share of the items.

An item over the capacity is divided into pieces of the capacity and a rest; only such items are divided. Defined
results: null and empty texts take no room and no container: container_id is null and n_tokens 0; a text of exactly
the capacity fills one container; null sources and clusters conflict with nothing; the pieces of a divided text carry its
source and cluster; repeated rows of one id must be removed before.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespan.session import materialize

SHARD_ITEMS = 20_000
FULL = 0.97
CROWDED = 0.1

PLACED = "container_name string, shard string, bin_no int, item_id long, part_no int, start int, n_tokens int, capacity int, source string, cluster long"


class Bins:
    """Bins of one shard by residual."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.at: dict[int, dict[int, None]] = {}  # residual -> bins, oldest first
        self.carry: dict[int, dict[int, int]] = {}  # residual -> bit of a source or cluster -> how many of its bins carry it
        self.used = 0  # bit r is set if a bin has residual r
        self.held: list[int] = []  # bitmap of each bin: sources and clusters have bits of their own

    def _find(self, size: int, bits: tuple[int, ...]) -> tuple[int, int] | None:
        """The tightest bin with room that carries none of the bits, and its residual."""
        left, r, wanted = self.used >> size, size, sum(bits)
        while left:
            low = (left & -left).bit_length() - 1
            r += low
            bins, carry = self.at[r], self.carry[r]
            if not any(carry.get(x, 0) == len(bins) for x in bits):
                for b in bins:
                    if not self.held[b] & wanted:
                        return b, r
            left >>= low + 1
            r += 1
        return None

    def put(self, size: int, bits: tuple[int, ...]) -> int:
        found = self._find(size, bits)
        if found is None:
            b, new = len(self.held), self.capacity - size
            self.held.append(0)
        else:
            b, old = found
            new = old - size
            del self.at[old][b]
            for x in _bits(self.held[b]):
                self.carry[old][x] -= 1
            if not self.at[old]:
                self.used &= ~(1 << old)
                del self.at[old], self.carry[old]
        self.held[b] |= sum(bits)
        self.at.setdefault(new, {})[b] = None
        carry = self.carry.setdefault(new, {})
        for x in _bits(self.held[b]):
            carry[x] = carry.get(x, 0) + 1
        self.used |= 1 << new
        return b


def _bits(x: int) -> Iterator[int]:
    while x:
        low = x & -x
        yield low
        x ^= low


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int) -> list[int]:
    """Bin of each item; no item is over the capacity. Ties keep the given order. Only what occurs twice needs a bit.

    Items whose source or cluster needs more than a share CROWDED of the bins go in first, as late ones would find their
    few bins without it filled."""
    bit: dict[tuple[int, object], int] = {}
    crowd = [0] * len(sizes)
    for kind, values in ((0, sources), (1, clusters)):
        numbers = Counter(v for v in values if v is not None)
        for v, n in numbers.items():
            if n > 1:
                bit[kind, v] = 1 << len(bit)
        crowd = [max(c, numbers.get(v, 0)) for c, v in zip(crowd, values, strict=True)]
    least = CROWDED * sum(sizes) / capacity
    bins, out = Bins(capacity), [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (crowd[i] <= max(least, 1), -sizes[i], i)):
        out[i] = bins.put(sizes[i], tuple(b for key in ((0, sources[i]), (1, clusters[i])) if (b := bit.get(key))))
    return out


def _pack(items: DataFrame, n_shards: int, tag: str) -> DataFrame:
    shard = F.concat_ws("-", F.lit(tag), F.col("container_name"), F.pmod(F.xxhash64("item_id", "part_no", F.lit(tag)), F.lit(n_shards)).cast("string"))

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["n_tokens", "item_id", "part_no"], ascending=[False, True, True], ignore_index=True)
        none = lambda x: None if pd.isna(x) else x
        f["bin_no"] = np.array(best_fit(f["n_tokens"].tolist(), list(map(none, f["source"])), list(map(none, f["cluster"])), int(f["capacity"].iloc[0])), dtype=np.int32)
        return f[[c.split(" ")[0] for c in PLACED.split(", ")]]

    return items.withColumn("shard", shard).groupBy("shard").applyInPandas(run, PLACED)


def pack(sized: DataFrame, containers: list[tuple[str, int]], shard_items: int = SHARD_ITEMS) -> DataFrame:
    """container_name, container_id, item_id, part_no, start, n_tokens.

    sized: item_id long, n_tokens int, source string, cluster long, of unique item_id.
    """
    spark = sized.sparkSession
    for _, capacity in containers:
        if not 0 < capacity <= 1 << 20:
            raise ValueError("a capacity must be from 1 to 1048576 tokens")
    kinds = F.array(*[F.struct(F.lit(n).alias("container_name"), F.lit(c).alias("capacity")) for n, c in containers])
    kinded = sized.select("*", F.explode(kinds).alias("k")).select("k.*", "item_id", F.coalesce("n_tokens", F.lit(0)).alias("size"), "source", "cluster")
    starts = F.when(F.col("size") == 0, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("size") - 1, F.col("capacity")))
    parts = kinded.select("*", F.posexplode(starts).alias("part_no", "start")).withColumn("n_tokens", F.least(F.col("capacity"), F.col("size") - F.col("start")))
    parts = materialize(parts.drop("size"), "pack-items")
    whole = parts.where("n_tokens = capacity").select("container_name", F.concat_ws("-", F.lit("full"), "container_name", "item_id", "part_no").alias("container_id"), "item_id", "part_no", "start", "n_tokens")
    empty = parts.where("n_tokens = 0").select("container_name", F.lit(None).cast("string").alias("container_id"), "item_id", "part_no", "start", "n_tokens")
    open_items = parts.where("n_tokens > 0 and n_tokens < capacity")
    n = open_items.count() / max(len(containers), 1)
    done, before, k = [], None, 0
    while True:
        n_shards = max(1, round(n / shard_items))
        placed = materialize(_pack(open_items, n_shards, str(k)), f"pack-{k}")
        fill = placed.groupBy("shard", "bin_no").agg((F.sum("n_tokens") / F.first("capacity")).alias("fill"))
        bins, below = fill.agg(F.count("*"), F.count_if(F.col("fill") < FULL)).first()
        if n_shards == 1 or not below or (before is not None and bins >= before):
            done.append(placed)
            break
        marked = placed.join(fill, ["shard", "bin_no"])
        done.append(marked.where(F.col("fill") >= FULL).drop("fill"))
        open_items = marked.where(F.col("fill") < FULL).drop("fill", "shard", "bin_no")
        n, before, k = open_items.count() / max(len(containers), 1), below, k + 1
    out = whole.unionByName(empty)
    for d in done:
        out = out.unionByName(d.select("container_name", F.concat_ws("-", "shard", F.col("bin_no").cast("string")).alias("container_id"), "item_id", "part_no", "start", "n_tokens"))
    return out
