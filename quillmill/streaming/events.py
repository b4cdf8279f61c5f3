"""Event-time operators on streams: held conditions, answers with a time limit, sums.

Each keeps a few values for a key, and an event-time timer ends what does not come.
Timestamps without zone are cast where a stream is read, as watermarks need."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read(spark: SparkSession, path: str, schema, files_at_once: int = 1) -> DataFrame:
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def held(events: DataFrame, key: str, condition, seconds: int, late: str = "1 hour") -> DataFrame:
    """(key, start, fired): a condition that has been true for so many seconds, fired once
    a run, when the watermark is beyond; a row that ends the run at that very moment does
    not prevent it. Columns of `events`: key and ts."""
    rows = events.withWatermark("ts", late).select(F.col(key).cast("string").alias("key"), "ts", condition.alias("on"))

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start = state.get[0] if state.exists else None
        out: list[tuple] = []
        wait = pd.Timedelta(seconds=seconds)
        rows = pd.concat(list(batches)).sort_values("ts") if not state.hasTimedOut else None
        if rows is None:
            out.append((k[0], pd.Timestamp(start, unit="us"), pd.Timestamp(start, unit="us") + wait))
            start = -1  # fired: silent until the run ends
        else:
            # a run is decided by its first row and the one that ends it, or the last there is
            on = rows["on"].fillna(False).to_numpy(bool)
            turns = np.flatnonzero(on != np.r_[start is not None, on[:-1]])
            rows = rows.iloc[np.union1d(turns, len(on) - 1)]
            for ts, on in zip(rows["ts"], rows["on"]):
                if start is not None and start >= 0 and ts - pd.Timestamp(start, unit="us") >= wait:
                    out.append((k[0], pd.Timestamp(start, unit="us"), pd.Timestamp(start, unit="us") + wait))
                    start = -1
                if not on:
                    start = None
                elif start is None:
                    start = ts.value // 1000
        if start is None:
            if state.exists:
                state.remove()
        else:
            state.update((start,))
            if start >= 0:
                due = start // 1000 + seconds * 1000
                state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "start", "fired"])

    return rows.groupBy("key").applyInPandasWithState(step, "key string, start timestamp, fired timestamp", "start long", "append", GroupStateTimeout.EventTimeTimeout)


def answered(asked: DataFrame, answers: DataFrame, key: str, seconds: int, late: str = "1 hour") -> DataFrame:
    """Each question with every answer after it and within the time, or with none once the
    watermark has passed its time: a left outer join of streams with a bound. asked: key,
    id, ts; answers: key, answer, ts."""
    q = asked.withWatermark("ts", late).select(F.col(key).alias("k"), "id", F.col("ts").alias("asked"))
    a = answers.withWatermark("ts", late).select(F.col(key).alias("ak"), "answer", F.col("ts").alias("at"))
    bound = (F.col("k") == F.col("ak")) & (F.col("at") > F.col("asked")) & (F.col("at") <= F.col("asked") + F.expr(f"INTERVAL {int(seconds)} SECONDS"))
    return q.join(a, bound, "left_outer").select("k", "id", "asked", "answer", F.when(F.col("answer").isNull(), "timeout").otherwise("answered").alias("status"))


def daily(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Sessions and values by day, given out when the day is over."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"))
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("day"), "n", "value")
