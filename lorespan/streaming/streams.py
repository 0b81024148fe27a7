"""Structured Streaming forms of counters, quotas, sessions, expiry, votes and ingest.

Each takes a streaming (or batch) DataFrame of chat records with create_time and gives one; the caller writes it. Late
data beyond the watermark is dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lorespan.operators import reports
from lorespan.operators.relational import current


def read_tables(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def once_each(records: DataFrame, late: str = "1 day") -> DataFrame:
    """Records delivered again within the watermark count once."""
    return records.withWatermark("create_time", late).dropDuplicatesWithinWatermark(["id"])


def chat_counters(records: DataFrame) -> DataFrame:
    """Counters per chat; write in update mode. The records must come once each; for those delivered again see newest_to()."""
    return reports.chat_counters(records)


def daily_quota(records: DataFrame, limit: int, late: str = "2 hours", key: str = "chat_id", time: str = "create_time") -> DataFrame:
    """Requests per key and day, reset at midnight, and whether the quota is used up."""
    days = records.withWatermark(time, late).groupBy(F.window(time, "1 day"), key).agg(F.count("*").alias("used"))
    return days.select(F.col("window.start").cast("date").alias("day"), key, "used", (F.col("used") >= limit).alias("exhausted"))


def sessions(records: DataFrame, gap: str = "30 minutes", late: str = "1 day", key: str = "chat_id", time: str = "create_time") -> DataFrame:
    """Runs of records of a key with no gap of that length."""
    runs = records.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("records"))
    return runs.select(key, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "records")


def votes(events: DataFrame) -> DataFrame:
    """Vote events (record_id, wish, at) folded by the vote rules: only an open record takes a vote, a given one is only
    withdrawn. The state is one character per record; it has no timeout, as one would keep a bounded stream from ending."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else "-1"
        rows = pd.concat(list(frames)).sort_values("at", kind="stable")
        for wish in rows["wish"]:
            if (now == "-1" and wish in ("0", "1")) or (now != "-1" and wish == "-1"):
                now = wish
        state.update((now,))
        yield pd.DataFrame({"record_id": [key[0]], "vote_status": [now]})

    return events.groupBy("record_id").applyInPandasWithState(step, "record_id string, vote_status string", "vote_status string", "update", GroupStateTimeout.NoTimeout)


def live(events: DataFrame, life: str, late: str = "10 minutes") -> DataFrame:
    """Items (id, create_time, life in minutes by its column) as they expire: each comes out once, with its time of expiry,
    when the watermark has passed that. Renewed items (delivered again) live on from their last time."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            end = state.get[0]
            state.remove()
            yield pd.DataFrame({"id": [key[0]], "expired_at": [pd.Timestamp(end, unit="ms")]})
            return
        end = state.get[0] if state.exists else 0
        for f in frames:
            end = max(end, int((f["create_time"].astype("datetime64[ms]").astype("int64") + f[life].astype("int64") * 60_000).max()))
        state.update((end,))
        state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))

    return events.withWatermark("create_time", late).groupBy("id").applyInPandasWithState(step, "id string, expired_at timestamp", "expires long", "append", GroupStateTimeout.EventTimeTimeout)


def reasoning(chunks: DataFrame, start: str = "<think>", end: str = "</think>") -> DataFrame:
    """Chunks (record_id, seq, text) of answers as they come, split into reasoning and answer. A chunk's end that may begin a
    tag waits for the next chunk; a chunk with is_end true gives what waits. Only the first pair of tags counts."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        phase, held = state.get if state.exists else (0, "")
        out = []
        for r in pd.concat(list(frames)).sort_values("seq", kind="stable").itertuples(index=False):
            held += r.text or ""
            parts = ["", ""]  # answer, reasoning
            while phase < 2 and (at := held.find((start, end)[phase])) >= 0:
                parts[phase % 2] += held[:at]
                held = held[at + len((start, end)[phase]) :]
                phase += 1
            tag = (start, end, "")[phase]
            wait = 0 if r.is_end else next((n for n in range(min(len(tag) - 1, len(held)), 0, -1) if tag.startswith(held[-n:])), 0)
            parts[phase % 2] += held[: len(held) - wait]
            held = held[len(held) - wait :]
            out.append((key[0], r.seq, parts[1], parts[0]))
        state.update((phase, held))
        yield pd.DataFrame(out, columns=["record_id", "seq", "reasoning", "answer"])

    return chunks.groupBy("record_id").applyInPandasWithState(step, "record_id string, seq int, reasoning string, answer string", "phase int, held string", "append", GroupStateTimeout.NoTimeout)


def newest_to(stream: DataFrame, target: str, checkpoint: str, key: str = "id"):
    """A bounded or endless stream of records into a folder of Parquet: each batch's newest row of a key. Readers take the
    newest of all batches (latest_of), so a record delivered again counts as it came last, and no state is kept."""

    def write(batch: DataFrame, number: int) -> None:
        current(batch, key).withColumn("__batch", F.lit(number)).write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_of(spark: SparkSession, target: str, key: str = "id") -> DataFrame:
    return current(spark.read.parquet(target), key).drop("__batch")


def ingest(files: DataFrame, parse: Callable[[DataFrame], DataFrame], target: str, checkpoint: str):
    """New files of a stream, parsed batch by batch and appended."""

    def write(batch: DataFrame, _: int) -> None:
        parse(batch).write.mode("append").parquet(target)

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drained(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """All that a bounded stream gives, by the memory sink: for tests and small reports."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
