"""Relational building blocks: current records, paging, unions, positions, upserts, trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def current(df: DataFrame, key: str = "id", by: list[str] | None = None) -> DataFrame:
    """One row per key: the newest of records that were delivered again. Ranks are limited before the shuffle."""
    by = by or [c for c in ("update_time", "create_time") if c in df.columns]
    w = W.partitionBy(key).orderBy(*[F.desc_nulls_last(c) for c in by] or [F.lit(0)])
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def latest_per(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    w = W.partitionBy(key).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def last_n(df: DataFrame, key: str, order: str, n: int, tie: str | None = None) -> DataFrame:
    w = W.partitionBy(key).orderBy(F.desc_nulls_last(order), *[F.desc(tie)] * bool(tie))
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def ordered(df: DataFrame, order_by: str | None = None, tie: str = "id") -> list[Column]:
    """Sort columns of an order like '-create_time', nulls first when falling; the default is newest first."""
    name = order_by or "-create_time"
    first = F.desc_nulls_first(name[1:]) if name.startswith("-") else F.asc_nulls_last(name)
    return [first, F.asc(tie)]


def page(df: DataFrame, number: int, size: int, order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """Rows of a page (from 1), and its envelope total, current, size as one row; neither is computed yet."""
    rows = df.orderBy(*order).offset((number - 1) * size).limit(size)
    return rows, df.agg(F.count("*").alias("total")).select("total", F.lit(number).alias("current"), F.lit(size).alias("size"))


def union_distinct(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.distinct()


def json_rows(spark, text: str, schema: str) -> DataFrame:
    """A JSON array of objects as rows."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{schema}>>")))


def appended_positions(existing: DataFrame, new: DataFrame, key: str, position: str, order: list[str]) -> DataFrame:
    """New rows with positions that go on after the greatest of their group (from 1 in an empty one)."""
    top = existing.groupBy(key).agg(F.max(position).alias("__top"))
    w = W.partitionBy(key).orderBy(*order)
    return new.join(top, key, "left").withColumn(position, F.coalesce("__top", F.lit(0)) + F.row_number().over(w)).drop("__top")


def renumbered(df: DataFrame, key: str, position: str, order: list[Column | str]) -> DataFrame:
    """Positions 0, 1, 2 ... per group."""
    return df.withColumn(position, F.row_number().over(W.partitionBy(key).orderBy(*order)) - 1)


def moved(df: DataFrame, key: str, position: str, old: Column, new: Column) -> DataFrame:
    """One item of each group moves from the old position to the new, and those between shift by one."""
    p = F.col(position)
    shifted = F.when(p == old, new).when((old < new) & (p > old) & (p <= new), p - 1).when((new < old) & (p >= new) & (p < old), p + 1).otherwise(p)
    return df.withColumn(position, shifted)


def get_or_create(existing: DataFrame, wanted: DataFrame, keys: list[str], new_id: Column, id_col: str = "id") -> DataFrame:
    """The rows of `wanted` (distinct by keys) with the existing id, or a new one; `created` tells which."""
    asked = wanted.dropDuplicates(keys)
    known = existing.groupBy(*keys).agg(F.min(id_col).alias("__id"))
    out = asked.join(known, keys, "left")
    return out.select(*[c for c in asked.columns if c != id_col], F.coalesce("__id", new_id).alias(id_col), F.col("__id").isNull().alias("created"))


def without(df: DataFrame, gone: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows without a partner: deletion, cascade and orphan clean-up as a rewrite."""
    return df.join(gone, on, "left_anti")


def descendants(folders: DataFrame, roots: DataFrame, most_depth: int = 3) -> DataFrame:
    """root, id, depth of each folder below each root (depth 0: itself), to a bounded depth."""
    level = roots.select(F.col("id").alias("root"), F.col("id"), F.lit(0).alias("depth"))
    out = level
    below = folders.select(F.col("id").alias("__child"), F.col("parent_id").alias("__parent"))
    for d in range(1, most_depth + 1):
        level = level.join(below, level.id == below["__parent"]).select("root", F.col("__child").alias("id"), F.lit(d).alias("depth"))
        out = out.unionByName(level)
    return out.distinct()


def runs(df: DataFrame, key: str, order: list[str], value: str, text: str, sep: str = "") -> DataFrame:
    """key, run, value, text, n_parts: rows of one value in a row, in order, are one; their texts are joined. Null is a value."""
    w = W.partitionBy(key).orderBy(*order)
    begins = F.when(F.row_number().over(w) == 1, 1).otherwise((~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int"))
    marked = df.withColumn("__begins", begins).withColumn("run", F.sum("__begins").over(w).cast("int"))
    parts = F.array_sort(F.collect_list(F.struct(*order, F.coalesce(text, F.lit("")).alias("__text"))))
    return marked.groupBy(key, "run", value).agg(parts.alias("__parts"), F.count("*").alias("n_parts")).select(key, "run", value, F.array_join(F.transform("__parts", lambda p: p["__text"]), sep).alias(text), "n_parts")


#: Rows that may become one map.
MOST_GROUPED = 100_000


def grouped_map(df: DataFrame, key: str, value: str) -> DataFrame:
    """One row: a map from each key to the array of its values, in order; null keys are left out. As it is one value, more than
    MOST_GROUPED rows are refused."""
    if df.limit(MOST_GROUPED + 1).count() > MOST_GROUPED:
        raise ValueError(f"more than {MOST_GROUPED} rows for one map")
    per = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(value)).alias("__v"))
    return per.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "__v")))).alias("groups"))


def flattened(lists: Column) -> Column:
    """An array of arrays as one; null parts are left out."""
    return F.flatten(F.filter(lists, lambda x: x.isNotNull()))


def merged_maps(a: Column, b: Column) -> Column:
    """Both maps' entries; where both have a key, the second counts. A null map has none."""
    first = F.map_filter(a, lambda k, _: ~F.coalesce(F.map_contains_key(b, k), F.lit(False)))
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.map_concat(first, b))
