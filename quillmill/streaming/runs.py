"""Automations as streams: runs that ask, wait and act, and states at each midnight.

Both hold rows in a list state until the watermark is beyond them, so that they are
taken in the order of their times however they arrive; event-time timers wake them. What has
been decided is never changed: rows behind the watermark are dropped by Spark. State is kept
in RocksDB (`STORE`), and a restart from the checkpoint goes on where the last one ended.

Keys are dealt into a fixed number of buckets, and a bucket is what Spark groups by: it has
one timer, its waiting rows are Arrow batches and its keys' states one JSON object, so that
calls to the state store are as many as buckets and batches, not as keys and timers."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillmill.sources.outputs import new_folder
from quillmill.workers import importable

#: The setting that state with lists and timers needs.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
DAY = 86_400_000_000
ROW = pa.schema([("key", pa.string()), ("at", pa.int64()), ("tie", pa.string()), ("kind", pa.string()), ("value", pa.string())])
#: Buckets of keys, fixed for a stream's life; and most rows of an Arrow batch in the state.
BUCKETS, CHUNK = 2048, 10_000


def _packed(batch: pa.RecordBatch) -> tuple[bytes]:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, ROW) as to:
        to.write_batch(batch)
    return (sink.getvalue().to_pybytes(),)


class _Ordered(StatefulProcessor):
    """Gives a key's rows to take() in order once the watermark is beyond them, then calls
    due(). States are lists that JSON holds."""

    out: list[str]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.rows = handle, handle.getListState("rows", "rows binary")
        self.now = handle.getValueState("now", "states string")
        self.done: dict = {}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = []
        for part in rows:
            part = part[part["at"].notna()]
            for batch in pa.Table.from_pandas(part[ROW.names], ROW, preserve_index=False).to_batches(CHUNK):
                self.rows.appendValue(_packed(batch))
                first.append(int(part["at"].min()))
        if first:
            self._wake(min(first))
        return iter(())

    def _wake(self, at: int) -> None:
        self.handle.registerTimer(-(-at // 1000) + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        if self.done.get(key) == upto:  # another timer of this bucket has been here
            return iter(())
        self.done[key] = upto
        held = pa.concat_tables([ROW.empty_table(), *[pa.ipc.open_stream(x[0]).read_all() for x in self.rows.get()]])
        is_ready = held["at"].to_numpy() <= upto
        ready, rest = held.filter(pa.array(is_ready)), held.filter(pa.array(~is_ready))
        keys, ats, ties, kinds, values = (c.to_pylist() for c in ready.columns)
        ties = [str(t) for t in ties]
        order = sorted(range(len(keys)), key=lambda i: (ats[i], kinds[i], len(ties[i]), ties[i]))
        states, found = (json.loads(self.now.get()[0]) if self.now.exists() else {}), []
        of: dict[str, list[int]] = {k: [] for k in states}
        for i in order:
            of.setdefault(keys[i], []).append(i)
        for k, mine in of.items():
            state, out = states.pop(k, None), []
            for i in mine:
                state = self.take(state, ats[i], ties[i], kinds[i], values[i], out)
            state = self.due(state, upto, out)
            if state is not None:
                states[k] = state
            found += [(k, *r) for r in out]
        if len(ready):
            self.rows.put([_packed(b) for b in rest.combine_chunks().to_batches(CHUNK)]) if len(rest) else self.rows.clear()
        if states:
            self.now.update((json.dumps(states),))
        elif of:
            self.now.clear()
        wake = [x for state in states.values() for x in self.next(state)]
        if len(rest):
            wake.append(int(rest["at"].to_numpy().min()))
        if wake:
            self._wake(max(min(wake), upto))
        return iter([self.frame(found)] if found else ())

    def frame(self, found: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(found, columns=self.out)

    def close(self) -> None:
        pass


class Waits(_Ordered):
    """kind `b` asks, kind `a` answers (so that of rows at one time answers come first, as
    an answer must be later). A question that is open is (its time, its tie)."""

    out = ["key", "id", "status", "answer"]

    def __init__(self, micros: int, single: bool):
        self.micros, self.single = micros, single

    def take(self, state, at, tie, kind, value, out):
        # answers of a run's last moment come first; a run that is just over then gives way
        state = self.due(state, at if self.single and kind == "b" else at - 1, out)
        open_ = [] if state is None else [tuple(x) for x in state[0]]
        if kind == "a":
            out += [(q, "answered", value) for _, q in open_]
            return None
        if open_ and self.single and at < open_[0][0] + self.micros:
            return (open_,)
        return ([*open_, (at, tie)],)

    def due(self, state, upto, out):
        open_ = [] if state is None else [tuple(x) for x in state[0]]
        over = [q for q in open_ if q[0] + self.micros <= upto]
        out += [(q, "timeout", None) for _, q in over]
        return ([q for q in open_ if q not in over],) if len(open_) > len(over) else None

    def next(self, state):
        return [state[0][0][0] + self.micros] if state else []


class Midnights(_Ordered):
    """The state at each midnight that the watermark has passed, from a key's first row on,
    and the rows that change it. now: the state and the next midnight."""

    out = ["key", "kind", "at", "id", "before", "state"]

    def take(self, state, at, tie, kind, value, out):
        state = self.due(state, at, out)
        if state is not None and state[0] is not None and value is not None and state[0] != value:
            out.append(("transition", at, tie, state[0], value))
        return (value, at // DAY * DAY + DAY)

    def due(self, state, upto, out):
        while state is not None and state[1] <= upto:
            out.append(("midnight", state[1], None, None, state[0]))
            state = (state[0], state[1] + DAY)
        return state

    def next(self, state):
        return [state[1]] if state else []

    def frame(self, found):
        return super().frame(found).assign(at=lambda x: pd.to_datetime(x["at"], unit="us"))


def _rows(events: DataFrame, key: str, time: str, tie: str, kind: Column, value: Column, late: str) -> DataFrame:
    importable(events.sparkSession)
    rows = events.withWatermark(time, late)
    # a condition that doesn't name the time would be put ahead of the watermark, which must see all rows
    kept = (F.col(key).isNotNull() & kind.isNotNull()) | F.col(time).isNull()
    return rows.where(kept).select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.col(time).alias("ts"), F.unix_micros(time).alias("at"), F.col(tie).cast("string").alias("tie"), kind.alias("kind"), value.cast("string").alias("value")).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)))


def waits(events: DataFrame, key: str, time: str, tie: str, asks: Column, answers: Column, value: Column, seconds: int, single: bool = False, late: str = "1 hour") -> DataFrame:
    """key, id, status and answer of rows that ask: the first later answer of their key
    within the time, or timeout. single: a row that asks while an earlier one of its key is
    open starts nothing. Ties of one time go by the length of their text, then the text."""
    kind = F.when(answers, "a").when(asks, "b")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in Waits.out])
    return _rows(events, key, time, tie, kind, value, late).groupBy("bucket").transformWithStateInPandas(Waits(seconds * 1_000_000, single), schema, "Append", "EventTime")


def midnights(events: DataFrame, key: str, time: str, tie: str, state: Column, late: str = "1 hour") -> DataFrame:
    """key, kind, at, id, before and state: at each midnight (UTC) the last state of every
    key that has had one, on days without rows too; and transitions with the row that made
    them."""
    kinds = dict.fromkeys(Midnights.out, T.StringType()) | {"at": T.TimestampType()}
    schema = T.StructType([T.StructField(c, t) for c, t in kinds.items()])
    return _rows(events, key, time, tie, F.lit("b"), state, late).groupBy("bucket").transformWithStateInPandas(Midnights(), schema, "Append", "EventTime")


def over(spark: SparkSession, rows: DataFrame, time: str, query, parts: int = 3, days: int = 2) -> DataFrame:
    """The rows of a stream query over a table: the table is landed in `parts` files by
    time, and after them a row that only moves the watermark, so many days behind the last
    (its other fields are null); the stream reads a file at a time, in that order."""
    before = {k: spark.conf.get(k, None) for k in STORE}
    folder, out = new_folder(spark), new_folder(spark)
    rows = rows.withColumn(time, F.col(time).cast("timestamp"))
    low, high = rows.agg(F.min(F.unix_micros(time)), F.max(F.unix_micros(time))).first()
    step = ((high or 0) - (low or 0)) // parts + 1
    part = F.floor((F.unix_micros(time) - F.lit(low or 0)) / step)
    for k in range(parts):
        rows.where(part == k).repartition(1).write.mode("append").parquet(folder)
    end = F.timestamp_micros(F.lit((high or 0) + days * DAY))
    last = [end.alias(c) if c == time else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns]
    spark.range(1).select(*last).write.mode("append").parquet(folder)
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        stream = query(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder))
        started = stream.writeStream.format("parquet").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start(f"{out}/rows")
        started.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")
