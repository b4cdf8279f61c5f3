"""Device states and events, in batch: inventories, transitions, held conditions, waits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions.text import domain

#: Parts of the names of switches that are no lights.
NOT_LIGHT = ["enchufe", "network_indicator", "outlet_control", "permit_join", "zigbee2mqtt_bridge", "power_on_behavior", "backlight"]


def latest(events: DataFrame, key: str, time: str, tie: str) -> DataFrame:
    """The last row of each key: an aggregation that shrinks before it is shuffled."""
    rest = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(time, tie)).alias("__r")).select(key, "__r.*")


def inventory(states: DataFrame, entity: str, seq: str) -> DataFrame:
    """domain, n and the first entity of each domain."""
    return states.groupBy(domain(F.col(entity)).alias("domain")).agg(F.count("*").alias("n"), F.min_by(entity, seq).alias("sample"))


def blocks(states: DataFrame, entity: str, state: str, seq: str) -> DataFrame:
    """domain, n and its lines, in order. A domain's text is one row, so there must be a
    row per device (see latest()), not per event."""
    line = F.concat(F.col(entity), F.lit(" = "), F.coalesce(F.col(state), F.lit("?")))
    got = states.groupBy(domain(F.col(entity)).alias("domain")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), line.alias("l")))).alias("x"))
    return got.select("domain", "n", F.concat(F.lit("## "), "domain", F.lit(" ("), F.col("n").cast("string"), F.lit(")\n"), F.array_join(F.col("x.l"), "\n")).alias("block"))


def excluded(entity: Column, name: Column, prefix: str, parts: list[str]) -> Column:
    """Whether it has the prefix and none of the parts in its names."""
    blob = F.lower(F.concat(entity, F.lit(" "), F.coalesce(name, F.lit(""))))
    out = entity.startswith(prefix)
    for part in parts:
        out = out & ~F.contains(blob, F.lit(part))
    return out


def keep_list(keep: str) -> list[str]:
    return [k.strip() for k in keep.split(",") if k.strip()]


def transitions(events: DataFrame, key: str, time: str, tie: str, state: str) -> DataFrame:
    """Rows where the state of a key is another than before, with the one before."""
    w = Window.partitionBy(key).orderBy(time, tie)
    return events.withColumn("before", F.lag(state).over(w)).where(F.col("before").isNotNull() & (F.col("before") != F.col(state)))


def held(events: DataFrame, key: str, time: str, tie: str, condition: Column, seconds: int) -> DataFrame:
    """Runs of rows that meet the condition, up to the next row that doesn't, that last at
    least so many seconds: key, start, end and fired (start plus the seconds). A run that
    never ends has not been held as far as the data can tell."""
    w = Window.partitionBy(key).orderBy(time, tie)
    on = F.coalesce(condition, F.lit(False))
    rows = events.withColumn("__on", on)
    rows = rows.withColumn("__was", F.lag("__on").over(w)).where(F.col("__was").isNull() | (F.col("__on") != F.col("__was")))
    ends = rows.withColumn("end", F.lead(time).over(w)).where("__on")
    long = F.unix_micros(F.col("end").cast("timestamp")) - F.unix_micros(F.col(time).cast("timestamp")) >= seconds * 1_000_000
    return ends.where(long).select(key, F.col(time).alias("start"), "end", (F.col(time) + F.make_dt_interval(secs=F.lit(seconds))).alias("fired"))


def wait(asked: DataFrame, answers: DataFrame, key: str, seconds: int) -> DataFrame:
    """Each question (key, id, time) with its first answer after it and within the time:
    answered, or timeout. One sort over both tables by key and time, and a look ahead, so
    that no pair is made."""
    q = asked.select(key, F.col("id"), F.col("time"), F.lit(None).cast("string").alias("answer"), F.lit(1).alias("__q"))
    a = answers.select(key, F.col("id"), F.col("time"), F.col("answer"), F.lit(0).alias("__q"))
    # latest first, so that the frame only grows; at one time a question comes after the
    # answers: an answer must be later
    w = Window.partitionBy(key).orderBy(F.desc("time"), F.desc("__q"), F.desc("id")).rowsBetween(Window.unboundedPreceding, -1)
    both = q.unionByName(a).withColumn("__next", F.last(F.when(F.col("__q") == 0, F.struct("time", "answer")), ignorenulls=True).over(w)).where("__q = 1")
    late = F.unix_micros(F.col("__next.time").cast("timestamp")) - F.unix_micros(F.col("time").cast("timestamp")) <= seconds * 1_000_000
    inside = F.coalesce(late, F.lit(False))
    return both.select(key, "id", F.when(inside, "answered").otherwise("timeout").alias("status"), F.when(inside, F.col("__next.answer")).alias("answer"))


def after_answer(waits: DataFrame, keep: str, action: str) -> DataFrame:
    """What a wait leads to: an answer to keep things stops the run, any other or none
    goes on with the action."""
    kept = F.coalesce((F.col("status") == "answered") & (F.col("answer") == keep), F.lit(False))
    return waits.withColumn("action", F.when(kept, "abort").otherwise(action))


def by_entity(states: DataFrame, entity: str) -> DataFrame:
    """All states in the order of their entities: a range sort."""
    return states.orderBy(entity)
