"""The live lane as Structured Streaming: windows, arrivals, retractions, breaker, snapshot.

Window aggregates over event time with watermarks and late rows are an addition to what the
match platform does by rules; they are marked so.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

c = F.col


def stream_of(spark: SparkSession, path: str, files_a_batch: int = 1) -> DataFrame:
    """A folder of event files as a stream; the schema is that of the files."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Addition: events and value by type and window; batch frames have no use for the watermark."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    out = marked.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return out.select(c("w.start").alias("start"), "event_type", "n", "value")


def sliding(events: DataFrame, width: str = "2 hours", step: str = "1 hour") -> DataFrame:
    """Addition: as tumbling, with windows that overlap."""
    return events.groupBy(F.window("ts", width, step).alias("w")).agg(F.count("*").alias("n")).select(c("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Addition: runs of a user's events with no longer pause than the gap."""
    return events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", c("w.start").alias("start"), "n")


def deduplicated(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """One row per event id; a stream forgets ids after the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])


def retractions(events: DataFrame) -> DataFrame:
    """Signed rows: every event counts +1, and a withdrawn one -1 as well; sums are right whatever arrives first."""
    return events.select("user_id", "event_id", "value", F.explode(F.when(c("withdrawn"), F.array(F.lit(1), F.lit(-1))).otherwise(F.array(F.lit(1)))).alias("sign"))


def standing(signed: DataFrame) -> DataFrame:
    return signed.groupBy("user_id").agg(F.sum("sign").cast("long").alias("n"), F.sum(c("sign") * c("value")).alias("value"))


STATE = "first_seen timestamp, last_seen timestamp, n long, score long"
LIVE = "user_id long, first_seen timestamp, last_seen timestamp, n long, score long, status string"


def live_state(events: DataFrame, idle_ms: int = 3 * 3600 * 1000) -> DataFrame:
    """State of each match (user_id) by arrival: first and last event, count, score; final after a pause."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            first, last, n, score = state.get
            state.remove()
            yield pd.DataFrame({"user_id": [key[0]], "first_seen": [first], "last_seen": [last], "n": [n], "score": [score], "status": ["final"]})
            return
        first, last, n, score = state.get if state.exists else (None, None, 0, 0)
        for pdf in frames:
            low, high = pdf.ts.min(), pdf.ts.max()
            first = low if first is None else min(first, low)
            last = high if last is None else max(last, high)
            n += len(pdf)
            score += int((pdf.event_type == "purchase").sum())
        state.update((first, last, n, score))
        state.setTimeoutTimestamp(max(int(last.timestamp() * 1000), state.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame({"user_id": [key[0]], "first_seen": [first], "last_seen": [last], "n": [n], "score": [score], "status": ["live"]})

    return events.withWatermark("ts", "2 hours").groupBy("user_id").applyInPandasWithState(update, LIVE, STATE, "update", GroupStateTimeout.EventTimeTimeout)


def breaker(ticks: DataFrame, failures: int = 3) -> DataFrame:
    """Circuit breaker from ordered ticks (provider, at, ok): open where the last ``failures`` ticks all failed."""
    recent = Window.partitionBy("provider").orderBy("at").rowsBetween(-(failures - 1), 0)
    fails = F.sum(F.when(c("ok"), 0).otherwise(1)).over(recent)
    return ticks.select("provider", "at", "ok", (fails == failures).alias("open"))


def waits(ticks: DataFrame, failures: int = 3, pause: int = 300, blocked: int = 3600) -> DataFrame:
    """The breaker's waits over made requests (provider, at in seconds, outcome ok, failed or blocked).

    ``until``: how long a request's outcome closes its provider, null where it doesn't; ``early``: made
    within a wait that an earlier request set.
    """
    order = Window.partitionBy("provider").orderBy("at")
    fails = F.count_if(c("outcome") != "ok").over(order.rowsBetween(-(failures - 1), 0))
    until = F.when(c("outcome") == "blocked", c("at") + blocked).when(fails == failures, c("at") + pause)
    closed = ticks.select("provider", "at", "outcome", until.alias("until"))
    before = F.max("until").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return closed.withColumn("early", F.coalesce(c("at") < before, F.lit(False)))


def stale(events: DataFrame, now: str, minutes: int = 5) -> DataFrame:
    """Matches whose last observation is older than ``minutes``."""
    last = events.groupBy("user_id").agg(F.max("ts").alias("last"))
    age = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(c("last").cast("timestamp"))) / 60e6
    return last.select("user_id", F.floor(age).cast("long").alias("age_minutes"), (age > minutes).alias("delayed"))


def state_at(events: DataFrame, now: str) -> DataFrame:
    """What was known of each match at an instant: nothing later shows."""
    return events.where(c("ts") <= F.lit(now).cast("timestamp")).groupBy("user_id").agg(F.count("*").alias("n"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"), F.max_by("value", F.struct("ts", "event_id")).alias("last_value"))


def run_once(out: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over what is there, into Parquet (append) or a table overwritten by batch (update, complete)."""
    writer = out.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", path).outputMode("append").start()
    else:
        query = writer.outputMode(mode).foreachBatch(lambda df, batch: df.write.mode("overwrite").parquet(f"{path}/batch={batch}")).start()
    query.awaitTermination()
