"""Maintenance as copy-on-write rewrites: retention, expiry, votes, improvements, sync."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Lives of temporary files by their source type, in minutes.
FILE_LIFE = {"TEMPORARY_30_MINUTE": 30, "TEMPORARY_120_MINUTE": 120, "TEMPORARY_1_DAY": 1440}


def expired_records(records: DataFrame, chats: DataFrame, keep_days: DataFrame, now: Column) -> DataFrame:
    """Records older than their application keeps them. keep_days: application_id, clean_time. No application: nothing."""
    limits = chats.select(F.col("id").alias("chat_id"), "application_id").join(keep_days, "application_id")
    old = records.join(limits, "chat_id").where(F.col("create_time") < now - F.make_dt_interval(F.col("clean_time")))
    return old.select("id", "chat_id")


def retained(records: DataFrame, chats: DataFrame, keep_days: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Records and chats that stay; a chat goes when it had records and all have expired."""
    gone = expired_records(records, chats, keep_days, now)
    left = records.join(gone.select("id"), "id", "left_anti")
    emptied = records.select("chat_id").distinct().join(left.select("chat_id"), "chat_id", "left_anti")
    return left, chats.join(emptied.withColumnRenamed("chat_id", "id"), "id", "left_anti")


def live_files(files: DataFrame, now: Column) -> DataFrame:
    """Files whose source type has no life, or whose life isn't over."""
    life = F.create_map(*[F.lit(x) for kv in FILE_LIFE.items() for x in kv])
    minutes = F.try_element_at(life, F.col("source_type"))
    return files.where(minutes.isNull() | (F.col("create_time") >= now - F.make_dt_interval(F.lit(0), F.lit(0), minutes)))


def voted(current: Column, wish: Column) -> Column:
    """Vote states: none '-1', up '0', down '1'. Only an open record takes a vote; a given one can only be withdrawn."""
    return F.when((current == "-1") & wish.isin("0", "1"), wish).when((current != "-1") & (wish == "-1"), F.lit("-1")).otherwise(current)


def improved(paragraphs: DataFrame, answers: DataFrame, new_id: Column) -> DataFrame:
    """Answers as first paragraphs of their documents (document_id, knowledge_id, title, content); the others move down."""
    n = answers.groupBy("document_id").agg(F.count("*").alias("__n"))
    shifted = paragraphs.join(n, "document_id", "left").withColumn("sort_position", (F.col("sort_position") + F.coalesce("__n", F.lit(0))).cast("int")).drop("__n")
    w = W.partitionBy("document_id").orderBy("title", "content")
    first = answers.select("document_id", "knowledge_id", "title", "content", new_id.alias("id"), (F.row_number().over(w) - 1).cast("int").alias("sort_position"))
    return shifted.unionByName(first, allowMissingColumns=True)


def propagated_active(embeddings: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Embedding rows take over whether their paragraph is active; those of vanished paragraphs keep theirs."""
    flags = paragraphs.select(F.col("id").alias("paragraph_id"), F.col("is_active").alias("__active"))
    return embeddings.join(flags, "paragraph_id", "left").withColumn("is_active", F.coalesce("__active", "is_active")).drop("__active")


def migrated(rows: DataFrame, moves: DataFrame, key: str = "document_id") -> DataFrame:
    """Rows of moved documents get the target knowledge base; re_embed tells where the model differs. moves: key, target_id, same_model."""
    out = rows.join(moves, key, "left")
    return out.withColumn("re_embed", F.coalesce(F.col("target_id").isNotNull() & ~F.col("same_model"), F.lit(False))).withColumn("knowledge_id", F.coalesce("target_id", "knowledge_id")).drop("target_id", "same_model")


def synced(existing: DataFrame, fetched: DataFrame, replace: bool) -> DataFrame:
    """Web documents by source URL: all fetched ones replace theirs, or only missing ones are added."""
    if replace:
        return existing.join(fetched.select("source_url"), "source_url", "left_anti").unionByName(fetched, allowMissingColumns=True)
    return existing.unionByName(fetched.join(existing.select("source_url"), "source_url", "left_anti"), allowMissingColumns=True)


def reset_daily(stats: DataFrame) -> DataFrame:
    return stats.withColumn("intraday_access_num", F.lit(0))


def generated_problems(paragraphs: DataFrame, answer: str = "answer") -> DataFrame:
    """Lines of a model's answer as problems of their paragraph, capped at 255 characters, blank ones left out."""
    lines = F.filter(F.split(answer, "\n"), lambda x: F.length(F.trim(x)) > 0)
    return paragraphs.select(F.col("id").alias("paragraph_id"), F.explode(F.transform(lines, lambda x: F.substring(x, 1, 255))).alias("problem"))


def stored_once(files: DataFrame, content: str = "content") -> DataFrame:
    """One row per content, by its SHA-256."""
    return files.withColumn("sha256_hash", F.sha2(F.col(content), 256)).dropDuplicates(["sha256_hash"])
