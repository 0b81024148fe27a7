"""Problem 5: the k most similar vectors of every vector, by an inverted multi-index.

Method: vectors are scaled to length 1 and cut into two halves; each half is quantised by its own codebook, fitted on a
bounded sample (FIT_ROWS rows, by hash), so K centroids a half make K * K cells. Every vector is indexed. For each
vector, centroid pairs are traversed by summed distance with a heap until the cells hold CANDIDATES vectors, and these
are reranked by exact cosine.

Layout: cells that lie near each other form blocks of about BLOCK_ROWS vectors (a cell over that is divided by hash), and
a task holds one block. In its own block a vector meets the cells of its traversal that lie there. Each other cell lies
behind a bisecting plane between its centroids and the vector's own; if that plane is farther away than SLACK times the
last neighbour that the vector holds, the cell is dropped, and the vector is sent to the blocks of the rest. At SLACK = 1
no neighbour of the traversal is lost; as it ships, SLACK is DEVIATIONS / sqrt(dims): the share of its distance that lies in
one given direction has a standard deviation of 1 / sqrt(dims) for a neighbour in any direction, so one in thirty thousand
lies beyond a plane at four of these. A request carries its vector as 16-bit floats, which changes a similarity by some
0.0001 at most. Requests of one block are divided into parts of REQUEST_ROWS, so hot blocks don't meet in one task.

Equal vectors are one entry of the index: it lists at most K_SOURCES ids of a source and twice as many in all, which is
all that any search for k neighbours of other sources can need; the ids beyond are answered from the same list, which may
be shorter than that where few sources share the vector.

Sources are told apart by 64-bit hashes, as only their equality counts.

Defined results: rows that are inactive, null, of another length, all zero, or hold null or NaN take no part; rows of the
same source are never neighbours (a null source is no source and equals none); ties go to the smaller id; a record
delivered again counts once; a vector with fewer than k possible neighbours gets those there are.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorespan.session import materialize, n_tasks

#: The bound of the sample on which codebooks are fitted.
FIT_ROWS = 20_000
FIT_ROUNDS = 8
CANDIDATES = 500
BLOCK_ROWS = 40_000
REQUEST_ROWS = 50_000
#: A cell's plane must lie within so many standard deviations of a direction's share for its block to be asked.
DEVIATIONS = 4
#: What 16-bit floats may take from a similarity.
ROUNDING = 1e-4
MOST_CENTROIDS = 1024
SALTS = 32
MOST_TASKS = 20_000


def centroids_for(rows: int) -> int:
    """Centroids a half: cells grow with the rows, so that a cell's share of them doesn't."""
    return int(min(max(round(rows**0.5 / 4), 4), MOST_CENTROIDS))


def fit(x: np.ndarray, k: int, rounds: int = FIT_ROUNDS, seed: int = 7) -> np.ndarray:
    """Lloyd's rounds; the centroids of empty clusters are drawn anew."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].astype(np.float32)
    for _ in range(rounds):
        near = (x @ c.T * 2 - (c * c).sum(1)).argmax(1)
        n = np.bincount(near, minlength=len(c))
        order = np.argsort(near, kind="stable")
        sums = np.add.reduceat(x[order], np.minimum(np.concatenate([[0], np.cumsum(n)[:-1]]), len(x) - 1), axis=0)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.integers(0, len(x), len(c))]).astype(np.float32)
    return c


class Index:
    """Codebooks, cell sizes, and the blocks of cells; its size is bounded by MOST_CENTROIDS."""

    def __init__(self, c1: np.ndarray, c2: np.ndarray) -> None:
        self.c1, self.c2 = c1, c2
        self.k = len(c2)

    def distances(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = unit.shape[1] // 2
        out = []
        for x, c in ((unit[:, :h], self.c1), (unit[:, h:], self.c2)):
            out.append(np.maximum((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :], 0))
        return out[0], out[1]

    def set_cells(self, counts: dict[int, int], block_rows: int) -> None:
        self.counts = np.zeros(len(self.c1) * self.k, dtype=np.int64)
        for cell, n in counts.items():
            self.counts[cell] = n
        # twice the distances between centroids, for bisecting planes
        self.gap1, self.gap2 = (np.maximum(2 * np.sqrt(np.maximum((c * c).sum(1)[:, None] - 2 * c @ c.T + (c * c).sum(1)[None, :], 0)), 1e-9) for c in (self.c1, self.c2))
        self.first_block = np.full(len(self.counts), -1, dtype=np.int32)
        self.n_blocks_of = np.zeros(len(self.counts), dtype=np.int32)
        cells = np.flatnonzero(self.counts)
        place = np.concatenate([self.c1[cells // self.k], self.c2[cells % self.k]], axis=1)
        block, stack = 0, [np.arange(len(cells))]
        while stack:
            part = stack.pop()
            weight = self.counts[cells[part]]
            if weight.sum() > block_rows and len(part) > 1:
                axis = place[part].var(axis=0).argmax()
                order = part[np.argsort(place[part, axis], kind="stable")]
                cut = int(np.clip(np.searchsorted(np.cumsum(self.counts[cells[order]]), weight.sum() / 2) + 1, 1, len(order) - 1))
                stack += [order[cut:], order[:cut]]
                continue
            self.first_block[cells[part]] = block
            m = max(1, -(-int(weight.sum()) // block_rows)) if len(part) == 1 else 1
            self.n_blocks_of[cells[part]] = m
            block += m
        self.n_blocks = block
        self.first, self.blocks, self.held = self.first_block.tolist(), self.n_blocks_of.tolist(), self.counts.tolist()

    def traverse(self, d1: np.ndarray, d2: np.ndarray, o1: np.ndarray, o2: np.ndarray, want: int) -> list[int]:
        """Non-empty cells by rising summed distance until they hold `want` vectors. o1, o2: centroids by rising distance."""
        counts, k = self.held, self.k
        heap, seen, got, out = [(d1[o1[0]] + d2[o2[0]], 0, 0)], {(0, 0)}, 0, []
        n1, n2 = len(o1), len(o2)
        while heap and got < want:
            _, i, j = heapq.heappop(heap)
            cell = o1[i] * k + o2[j]
            if n := counts[cell]:
                out.append(int(cell))
                got += n
            if i + 1 < n1 and (i + 1, j) not in seen:
                seen.add((i + 1, j))
                heapq.heappush(heap, (d1[o1[i + 1]] + d2[o2[j]], i + 1, j))
            if j + 1 < n2 and (i, j + 1) not in seen:
                seen.add((i, j + 1))
                heapq.heappush(heap, (d1[o1[i]] + d2[o2[j + 1]], i, j + 1))
        return out


def _unit(col: pd.Series) -> np.ndarray:
    v = np.stack(col.to_numpy()).astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _halves(col: pd.Series) -> np.ndarray:
    """Unit vectors of requests."""
    v = np.frombuffer(b"".join(col), dtype=np.float16).reshape(len(col), -1).astype(np.float64)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _listed(rows: list[tuple[float, str, int | None]], k: int) -> list[tuple[float, str, int | None]]:
    """Of (-similarity, id, source), sorted: at most k of a source and 2 k in all."""
    out, of = [], {}
    for r in rows:
        if r[2] is not None:
            of[r[2]] = of.get(r[2], 0) + 1
            if of[r[2]] > k:
                continue
        out.append(r)
        if len(out) == 2 * k:
            break
    return out


def _merged(f: pd.DataFrame) -> pd.DataFrame:
    """Rows of equal vectors, which lie side by side, as one with all their members, each once and by id. They are at most
    2 k ids, delivered again or not, as hot vectors come as one row."""
    v1, v2 = f["v1"].to_numpy(), f["v2"].to_numpy()
    new = np.concatenate([[True], (v1[1:] != v1[:-1]) | (v2[1:] != v2[:-1])]) if len(f) else np.zeros(0, dtype=bool)
    if new.all():
        return f
    starts = np.flatnonzero(new)
    members = f["members"].tolist()
    merged = []
    for a, b in zip(starts, [*starts[1:], len(f)], strict=True):
        if b - a == 1:
            merged.append(members[a])
        else:
            merged.append([{"id": i, "source": x} for i, x in sorted({(m["id"], m["source"]) for r in range(a, b) for m in members[r]}, key=lambda m: m[0])])
    out = f.iloc[starts].reset_index(drop=True)
    out["members"] = merged
    return out


class Block:
    """Entries of one block, sorted by cell."""

    def __init__(self, f: pd.DataFrame) -> None:
        f = _merged(f.sort_values(["cell", "v1", "v2"], kind="stable", ignore_index=True))
        self.f, self.unit = f, _unit(f["vec"])
        self.small = self.unit.astype(np.float32)
        cells, starts = np.unique(f["cell"].to_numpy(), return_index=True)
        ends = [*starts[1:].tolist(), len(f)]
        self.span = {int(c): (int(a), int(b)) for c, a, b in zip(cells, starts, ends, strict=True)}
        self.members = [[(m["id"], m["source"]) for m in x] for x in f["members"]]

    def rows_of(self, cells: list[int]) -> np.ndarray:
        spans = [self.span[c] for c in cells if c in self.span]
        return np.concatenate([np.arange(a, b) for a, b in spans]) if spans else np.zeros(0, dtype=np.int64)

    def search(self, unit: np.ndarray, rows: np.ndarray, k: int) -> list[list[tuple[float, str, int | None]]]:
        """For each query the list of its best neighbours among the rows, as _listed gives it."""
        if not len(rows):
            return [[] for _ in unit]
        out: list = [None] * len(unit)
        todo, take = np.arange(len(unit)), min(2 * k + 6, len(rows))
        sims = unit.astype(np.float32) @ self.small[rows].T
        while len(todo):
            if take < len(rows):
                part = np.argpartition(-sims[todo], take - 1, axis=1)[:, :take]
            else:
                part = np.broadcast_to(np.arange(len(rows)), (len(todo), len(rows)))
            again = []
            for q, cols in zip(todo.tolist(), part, strict=True):
                at = rows[cols]
                exact = self.unit[at] @ unit[q]
                got = _listed(sorted((-s, i, src) for s, r in zip(exact.tolist(), at.tolist(), strict=True) for i, src in self.members[r]), k)
                if len(got) < 2 * k and take < len(rows):
                    again.append(q)
                else:
                    out[q] = got
            todo, take = np.array(again, dtype=np.int64), min(take * 4, len(rows))
        return out


NEAR = "near array<struct<sim: double, id: string, source: bigint>>"


def _near(rows: list) -> list[dict]:
    return [{"sim": -s, "id": i, "source": src} for s, i, src in rows]


def usable(df: DataFrame, dims: int) -> DataFrame:
    """id, source (hash), vec and the 128-bit key (v1, v2) of the vector, of rows that take part."""
    v = F.col("embedding")
    ok = F.col("is_active") & F.col("id").isNotNull() & (F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.where(ok).select("id", F.when(F.col("source_id").isNotNull(), F.xxhash64("source_id")).alias("source"), v.alias("vec"), F.xxhash64(v).alias("v1"), F.xxhash64(F.reverse(v)).alias("v2"))


def neighbours(df: DataFrame, k: int = 5, dims: int = 64, candidates: int = CANDIDATES, block_rows: int = BLOCK_ROWS, slack: float | None = None) -> DataFrame:
    """id, neighbour, similarity, rank (from 1): the k best rows of other sources for every usable row."""
    spark = df.sparkSession
    rows = usable(df, dims)
    slack = min(1.0, DEVIATIONS / dims**0.5) if slack is None else slack
    # vectors of more rows than a list may hold; they are few, or each stands for many rows
    hot_keys = materialize(rows.groupBy("v1", "v2").agg(F.count("*").alias("n")).where(F.col("n") > 2 * k).select("v1", "v2"), "knn-hot")
    any_hot = not hot_keys.isEmpty()
    cold = rows.join(hot_keys, ["v1", "v2"], "left_anti") if any_hot else rows
    # equal vectors fall into one block, which makes one entry of them, so they needn't meet before
    entries = cold.select("v1", "v2", "vec", F.array(F.struct("id", "source")).alias("members"), F.lit(False).alias("hot"))
    if any_hot:
        hot_ids = rows.join(hot_keys, ["v1", "v2"]).select("v1", "v2", "id", "source").distinct()
        by_source = W.partitionBy("v1", "v2", "source").orderBy("id")
        by_vector = W.partitionBy("v1", "v2").orderBy("id")
        # a null source equals no other, so its rows aren't limited by source
        few = hot_ids.withColumn("n", F.row_number().over(by_source)).where((F.col("n") <= k) | F.col("source").isNull())
        ranked = few.withColumn("n", F.row_number().over(by_vector)).where(F.col("n") <= 2 * k)
        kept = ranked.groupBy("v1", "v2").agg(F.sort_array(F.collect_list(F.struct("id", "source"))).alias("members"), F.lit(True).alias("hot"))
        vectors = rows.select("v1", "v2", "vec").join(hot_keys, ["v1", "v2"]).dropDuplicates(["v1", "v2"])
        entries = entries.unionByName(vectors.join(kept, ["v1", "v2"]))
    entries = materialize(entries, "knn-entries")
    n = entries.count()
    if not n:
        return spark.createDataFrame([], "id string, neighbour string, similarity double, rank int")
    share = min(1.0, FIT_ROWS / n)
    picked = entries.where(F.pmod(F.xxhash64("v1"), F.lit(1_000_000)) < int(share * 1_000_000)).select("vec") if share < 1 else entries.select("vec")
    sample = _unit(picked.limit(2 * FIT_ROWS).toPandas()["vec"]).astype(np.float32)
    half, c = dims // 2, centroids_for(n)
    index = Index(fit(sample[:, :half], c), fit(sample[:, half:], c))
    shared = spark.sparkContext.broadcast(index)

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ix = shared.value
        for f in frames:
            if len(f):
                d1, d2 = ix.distances(_unit(f["vec"]).astype(np.float32))
                yield pd.DataFrame({"cell": d1.argmin(1) * ix.k + d2.argmin(1)})

    # at most MOST_CENTROIDS ** 2 cells
    cells = entries.select("vec").mapInPandas(assign, "cell long").groupBy("cell").agg(F.count("*").alias("n")).collect()
    index.set_cells({s.cell: s.n for s in cells}, block_rows)
    full = spark.sparkContext.broadcast(index)

    def to_block(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ix = full.value
        for f in frames:
            if len(f):
                d1, d2 = ix.distances(_unit(f["vec"]).astype(np.float32))
                cell = d1.argmin(1) * ix.k + d2.argmin(1)
                f["cell"] = cell
                f["block"] = ix.first_block[cell] + np.abs(f["v2"].to_numpy() % ix.n_blocks_of[cell])
                yield f[["block", "cell", "v1", "v2", "vec", "members", "hot"]]

    entry_type = "block int, cell long, v1 long, v2 long, vec array<float>, members array<struct<id: string, source: bigint>>, hot boolean"
    blocked = entries.select("v1", "v2", "vec", "members", "hot").mapInPandas(to_block, entry_type)

    def at_home(f: pd.DataFrame) -> pd.DataFrame:
        ix, block = full.value, Block(f)
        here, out = int(f["block"].iloc[0]), []
        v1, v2, is_hot = (block.f[c].tolist() for c in ("v1", "v2", "hot"))
        small = [v.tobytes() for v in block.unit.astype(np.float16)]
        for a, b in block.span.values():
            for at in range(a, b, 2048):
                end = min(at + 2048, b)
                unit = block.unit[at:end]
                d1, d2 = ix.distances(unit.astype(np.float32))
                o1, o2 = np.argsort(d1, axis=1), np.argsort(d2, axis=1)
                # squared distance from the vector to the plane between its own centroid and each other
                low1, low2 = (((d - d.min(axis=1, keepdims=True)) / gap[d.argmin(axis=1)]) ** 2 for d, gap in ((d1, ix.gap1), (d2, ix.gap2)))
                ways = [ix.traverse(x, y, p, q, candidates) for x, y, p, q in zip(d1.tolist(), d2.tolist(), o1.tolist(), o2.tolist(), strict=True)]
                rows_ = block.rows_of(sorted({c for w in ways for c in w}))
                for r, way, got, n1, n2 in zip(range(at, end), ways, block.search(unit, rows_, k), low1.tolist(), low2.tolist(), strict=True):
                    m = block.members[r]
                    hot = is_hot[r]
                    best = [[g for g in got if g[1] != i and (x is None or g[2] != x)][:k] for i, x in m]
                    # the least similarity that can still enter a list; ids of hot vectors may have any source
                    least = min((-b[-1][0] if len(b) == k else -np.inf for b in best), default=-np.inf)
                    if hot:
                        least = -got[-1][0] if len(got) == 2 * k else -np.inf
                    reach = (max(2 - 2 * least, 0) + 1e-6) * slack**2
                    asked: dict[int, list[int]] = {}
                    for c in way:
                        if n1[c // ix.k] + n2[c % ix.k] <= reach:
                            first = ix.first[c]
                            for o in range(first, first + ix.blocks[c]):
                                if o != here:
                                    asked.setdefault(o, []).append(c)
                    if asked or hot:
                        out.append((v1[r], v2[r], None, None, float(least), [{"id": i, "source": x} for i, x in m], _near(got if hot else sorted({g for b in best for g in b})), [{"block": o, "cells": c} for o, c in asked.items()], small[r] if asked else None, hot))
                    else:
                        for (i, _), b in zip(m, best, strict=True):
                            out.append((None, None, i, [{"id": g[1], "sim": -g[0]} for g in b], None, None, None, None, None, None))
        # as objects: keys beside nulls would become floats
        return pd.DataFrame(out, dtype=object, columns=["v1", "v2", "id", "best", "least", "members", "near", "asked", "vec", "hot"])

    home_type = f"v1 long, v2 long, id string, best array<struct<id: string, sim: double>>, least float, members array<struct<id: string, source: bigint>>, {NEAR}, asked array<struct<block: int, cells: array<int>>>, vec binary, hot boolean"
    def block_by_block(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for f in frames:
            for block, part in f.groupby("block", sort=True):
                if held and held[0]["block"].iloc[0] != block:
                    yield at_home(pd.concat(held, ignore_index=True))
                    held = []
                held.append(part)
        if held:
            yield at_home(pd.concat(held, ignore_index=True))

    # a block's number is its partition, so that a task holds one of them at a time, and with enough tasks only one
    tasks = min(max(n_tasks(spark), index.n_blocks), MOST_TASKS)
    placed = blocked.repartitionById(tasks, F.pmod("block", F.lit(tasks)).cast("int")).sortWithinPartitions("block")
    home = materialize(placed.mapInPandas(block_by_block, home_type), "knn-home")
    settled = home.where(F.col("id").isNotNull()).select("id", "best")
    open_ = home.where(F.col("id").isNull())

    asked = open_.where(F.size("asked") > 0).select("v1", "v2", "vec", "least", F.explode("asked").alias("a")).select("a.block", "a.cells", "v1", "v2", "vec", "least")
    parts = materialize(asked.groupBy("block").agg(F.ceil(F.count("*") / REQUEST_ROWS).cast("int").alias("parts")), "knn-parts")
    wanted = asked.select("block", F.explode("cells").alias("cell")).distinct()
    requests = asked.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("v1"), F.col("parts")).cast("int")).drop("parts")
    copies = blocked.join(wanted, ["block", "cell"], "left_semi").join(parts, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def away(e: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(e) or not len(q):
            return pd.DataFrame([], columns=["v1", "v2", "near"])
        block, out = Block(e), []
        q = q.assign(key=[tuple(sorted(x)) for x in q["cells"]])
        for key, f in q.groupby("key", sort=False):
            for a, b, least, got in zip(f["v1"], f["v2"], f["least"], block.search(_halves(f["vec"]), block.rows_of(list(key)), k), strict=True):
                if better := [g for g in got if -g[0] >= least - ROUNDING]:
                    out.append((a, b, _near(better)))
        return pd.DataFrame(out, columns=["v1", "v2", "near"])

    found = copies.groupBy("block", "part").cogroup(requests.groupBy("block", "part")).applyInPandas(away, f"v1 long, v2 long, {NEAR}")
    both = open_.select("v1", "v2", "members", "hot", "near").unionByName(found, allowMissingColumns=True)
    merged = both.groupBy("v1", "v2").agg(F.first("members", ignorenulls=True).alias("members"), F.max("hot").alias("hot"), F.flatten(F.collect_list("near")).alias("near"))
    merged = merged.withColumn("near", F.array_sort(F.transform("near", lambda x: F.struct((-x["sim"]).alias("d"), x["id"].alias("id"), x["source"].alias("source")))))
    own = merged.select(F.explode("members").alias("m"), "near").select("m.id", "m.source", "near")
    if any_hot:
        # ids of equal vectors beyond those listed; a vector may have very many, so its list is salted
        hot = merged.where("hot").select("v1", "v2", "near", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        rest = hot_ids.join(ranked.select("id"), "id", "left_anti").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
        own = own.unionByName(rest.join(hot, ["v1", "v2", "salt"]).select("id", "source", "near"))
    others = own.select("id", F.slice(F.filter("near", lambda x: (x["id"] != F.col("id")) & ~F.coalesce(x["source"] == F.col("source"), F.lit(False))), 1, k).alias("near"))
    late = others.select("id", F.transform("near", lambda x: F.struct(x["id"].alias("id"), (-x["d"]).alias("sim"))).alias("best"))
    return settled.unionByName(late).select("id", F.posexplode("best").alias("pos", "x")).select("id", F.col("x.id").alias("neighbour"), F.col("x.sim").alias("similarity"), (F.col("pos") + 1).alias("rank"))


def pairs(near: DataFrame) -> DataFrame:
    return near.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
