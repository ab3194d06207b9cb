"""Streams: rates in sliding windows, sustained conditions, an outbox with retries, idempotent events, job states.

Every function takes a streaming (or static) DataFrame and returns one; run() drives a
stream over what is there (availableNow) into a Parquet folder with its checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: An outbox row is tried again after 2^n seconds, 600 at most, five times in all.
MOST_WAIT, MOST_TRIES = 600, 5


def events(spark: SparkSession, path: str, schema, files_a_batch: int = 1) -> DataFrame:
    """A Parquet folder as a stream, its time stamps as instants."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def run(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """All that is there now, then stop. A restart goes on where the checkpoint ends."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").option("path", path).start().awaitTermination()


def rates(df: DataFrame, size: str = "5 minutes", slide: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Events a window and type, and how many of them failed; rows later than the watermark allows are dropped when df is a stream."""
    if df.isStreaming:
        df = df.withWatermark("ts", late)
    g = df.groupBy(F.window("ts", size, slide), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n", "total")


def once(df: DataFrame, key: str, late: str | None = "10 minutes") -> DataFrame:
    """The first event of each key within the watermark; late None: of each key at any age, with a state row for each key."""
    if late is None:
        return df.dropDuplicates([key])
    return df.withWatermark("ts", late).dropDuplicatesWithinWatermark([key]) if df.isStreaming else df.dropDuplicates([key])


def sustained(df: DataFrame, key: str, order: str, flag: str, windows: int = 5) -> DataFrame:
    """Rows with alert: whether the flag has held for so many windows in a row."""
    from quarrymill.operators.relational import runs_of

    return runs_of(df, key, order, flag).withColumn("alert", F.col("streak") >= windows)


def outbox(df: DataFrame) -> DataFrame:
    """df (message, ts, ok) to (message, status, tries, next_wait): delivered, retry or dead after the last try; a state a message, which expires a day of event time after its last news."""

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tries, done = state.get if state.exists else (0, False)
        newest = 0
        for pdf in pdfs:
            newest = max(newest, int(pdf["ts"].max().timestamp() * 1000))
            for ok in pdf.sort_values("ts")["ok"]:
                if not done and tries < MOST_TRIES:
                    tries, done = tries + 1, bool(ok)
        state.update((tries, done))
        state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + 24 * 3600 * 1000)
        status = "delivered" if done else "dead" if tries >= MOST_TRIES else "retry"
        yield pd.DataFrame({"message": [key[0]], "status": [status], "tries": [tries], "next_wait": [0 if status != "retry" else min(2**tries, MOST_WAIT)]})

    return df.withWatermark("ts", "1 hour").groupBy("message").applyInPandasWithState(step, "message long, status string, tries int, next_wait int", "tries int, done boolean", "update", GroupStateTimeout.EventTimeTimeout)


def outbox_batch(df: DataFrame) -> DataFrame:
    """The same over all rows at once, in aggregations: tries up to the first success or the last try."""
    from pyspark.sql import Window

    w = Window.partitionBy("message").orderBy("ts")
    r = df.withColumn("k", F.row_number().over(w)).where(F.col("k") <= MOST_TRIES)
    g = r.groupBy("message").agg(F.min(F.when(F.col("ok"), F.col("k"))).alias("hit"), F.max("k").alias("last"))
    tries = F.coalesce("hit", "last")
    status = F.when(F.col("hit").isNotNull(), "delivered").when(F.col("last") >= MOST_TRIES, "dead").otherwise("retry")
    return g.select("message", status.alias("status"), tries.alias("tries"), F.when(status == "retry", F.least(F.pow(F.lit(2), tries).cast("int"), F.lit(MOST_WAIT))).otherwise(0).alias("next_wait"))


def batch_status(attempts: DataFrame, most_tries: int = 3) -> DataFrame:
    """attempts (batch, item, ts, ok) to (batch, n_items, n_ok, tries, status): each item is tried by itself, most_tries times at most, and fails alone; a batch is done, partial or failed."""
    listed = F.transform(F.sort_array(F.collect_list(F.struct("ts", "ok"))), lambda x: x["ok"])
    hit = F.array_position(F.slice("oks", 1, most_tries), True)
    items = attempts.groupBy("batch", "item").agg(listed.alias("oks")).select("batch", (hit > 0).alias("ok"), F.when(hit > 0, hit).otherwise(F.least(F.size("oks"), F.lit(most_tries))).alias("tries"))
    n = items.groupBy("batch").agg(F.count("*").alias("n_items"), F.count_if("ok").alias("n_ok"), F.sum("tries").alias("tries"))
    return n.withColumn("status", F.when(F.col("n_ok") == F.col("n_items"), "done").when(F.col("n_ok") > 0, "partial").otherwise("failed"))


def job_states(df: DataFrame) -> DataFrame:
    """The last status of each job (done, partial or failed once it has ended) and its seconds from first to last event."""
    return df.groupBy("job").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"), (F.max("ts").cast("timestamp").cast("long") - F.min("ts").cast("timestamp").cast("long")).alias("seconds"), F.count_if(F.col("status") == "failed").alias("failures"))


class Hysteresis:
    """Drift alerts only after so many checks in a row over the limit; a new fingerprint of the base starts anew."""

    def __init__(self, needed: int = 3) -> None:
        self.needed = needed

    def __call__(self, df: DataFrame, key: str, order: str, value: str, fingerprint: str, limit: float = 0.5) -> DataFrame:
        from quarrymill.operators.relational import runs_of

        rows = df.withColumn("over", F.coalesce(F.col(value) >= limit, F.lit(False))).withColumn("_k", F.concat_ws("|", key, fingerprint))
        return runs_of(rows, "_k", order, "over").withColumn("alert", F.col("streak") >= self.needed).drop("_k")
