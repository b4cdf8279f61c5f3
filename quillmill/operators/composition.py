"""Texts put together of rows: contexts, summaries, lists, sections, key files; and
automations made of triggers and actions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.operators.selection import ranked


def context(parts: list[Column], sep: str = "\n") -> Column:
    """Parts in order, missing ones left out."""
    return F.concat_ws(sep, *parts)


def top(rows: DataFrame, among: Column, order: list, k: int, text: str, most: int = 600) -> DataFrame:
    """The first k of a search with their rank, the text cut."""
    best = rows.where(among).orderBy(*order).limit(k)
    return best.withColumns({"rank": F.row_number().over(Window.orderBy(*order)), text: F.substring(text, 1, most)})


def count_table(counts: DataFrame, key: str, n: str, place: str) -> DataFrame:
    """Markdown rows of a table of counts, in order."""
    line = F.concat(F.lit("| "), F.col(key).cast("string"), F.lit(" | "), F.col(n).cast("string"), F.lit(" |"))
    return counts.select(F.col(place).alias("ord"), line.alias("line"))


def sectioned(rows: DataFrame, relevance: str, place: str, line: Column, most: int) -> DataFrame:
    """section (priority, secondary, off) and the rows' lines: relevant rows by place, the
    first `most` of them being the priority."""
    section = F.when(F.col(relevance) >= 2, "off").when(F.col(place) <= most, "priority").otherwise("secondary")
    return rows.select(section.alias("section"), F.col(place).alias("place"), line.alias("line"))


def arrivals(records: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """name and status: arrived, invalid, missing; and strays, which no record expects."""
    f = found.select(name, F.col("verdict").alias("__v"))
    known = records.select(name).join(f, name, "left").select(name, F.when(F.col("__v").isNull(), "missing").when(F.col("__v") == "ok", "arrived").otherwise("invalid").alias("status"))
    return known.unionByName(found.join(records.select(name), name, "left_anti").select(name, F.lit("stray").alias("status")))


def inserted(text: Column, end: Column, new: str) -> Column:
    """A text with a line, and a blank one, put in before line number `end`."""
    lines = F.split(text, "\n", -1)
    return F.array_join(F.concat(F.slice(lines, F.lit(1), end), F.array(F.lit(new), F.lit("")), F.slice(lines, end + 1, F.size(lines))), "\n")


def query_text(topic: Column, stratum: Column, since: int) -> Column:
    return F.format_string("(%s) AND (%s) AND (\"%s\"[dp] : \"3000\"[dp])", topic, stratum, F.lit(str(since)))


def state_line(entity: Column, state: Column, attributes: Column, most: int = 400) -> Column:
    """entity (name) = state, and the other attributes as JSON, cut."""
    rest = F.map_filter(attributes, lambda k, v: k != "friendly_name")
    head = F.concat(entity, F.lit(" ("), F.coalesce(F.try_element_at(attributes, F.lit("friendly_name")), entity), F.lit(") = "), state)
    return F.when(F.size(rest) > 0, F.concat(head, F.lit("\n  attrs: "), F.substring(F.to_json(rest), 1, most))).otherwise(head)


def merge_keys(existing: DataFrame, updates: DataFrame) -> DataFrame:
    """key, value and place: the file's keys keep their places, new ones come after.
    Both: key, value, ord; one row a key."""
    e = existing.select("key", F.col("value").alias("v0"), F.col("ord").alias("o0"))
    u = updates.select("key", F.col("value").alias("v1"), F.col("ord").alias("o1"))
    both = e.join(u, "key", "full_outer")
    both = both.withColumn("o", F.coalesce("o0", "o1")).withColumn("new", F.col("o0").isNull())
    # numbered by thousands of either order, so that no task orders all keys
    both = ranked(both, [], [F.col("new"), F.floor(F.col("o") / 1000)], [F.col("new"), F.col("o")])
    return both.select("key", F.coalesce("v1", "v0").alias("value"), F.col("place").cast("int").alias("place"))


def merged(section: Column, **fields: Column) -> Column:
    """A struct with fields put in, in the place of those of the same name."""
    for name, value in fields.items():
        section = section.withField(name, value)
    return section


def merged_json(first: Column, second: Column) -> Column:
    """JSON objects whose keys aren't known, merged: all keys of both, in order, a key's
    value being the second's where that has it, null too. What is no object, or names a key
    twice, merges to null."""
    fields = lambda c: F.when(F.try_parse_json(c).isNotNull() & c.rlike(r"\A\s*\{"), F.from_json(c, "map<string,variant>"))
    texts = F.map_zip_with(_texts(fields(first)), _texts(fields(second)), lambda k, a, b: F.coalesce(b, a))
    pairs = F.array_sort(F.map_entries(texts))
    body = F.array_join(F.transform(pairs, lambda x: F.concat(F.to_json(F.array(x["key"])).substr(F.lit(2), F.length(F.to_json(F.array(x["key"]))) - 2), F.lit(":"), x["value"])), ",")
    return F.concat(F.lit("{"), body, F.lit("}"))


def _texts(fields: Column) -> Column:
    """The values of a map as JSON texts."""
    return F.transform_values(fields, lambda k, v: F.coalesce(F.to_json(v), F.lit("null")))


def result(params: dict[str, Column], metrics: dict[str, Column]) -> Column:
    """What a computation was asked, and what it measured."""
    pack = lambda x: F.struct(*[v.alias(k) for k, v in x.items()])
    return F.struct(pack(params).alias("params"), pack(metrics).alias("metrics"))


def valid_json(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


def bullets(slides: DataFrame, key: str, text: str) -> DataFrame:
    """key, place and bullet of each line."""
    return slides.select(key, F.posexplode(F.split(text, "\n", -1)).alias("place", "bullet"))


def shaped(fmt: Column, sections: Column) -> Column:
    """Sections (heading, content) in the shape of a format: (slides, sections), of which
    one is null. `pptx` has slides, with a bullet a line; all others (docx where there is
    none) have sections with a body. A missing heading is empty."""
    head = lambda s: F.coalesce(s["heading"], F.lit(""))
    deck = F.coalesce(fmt, F.lit("docx")) == "pptx"
    slides = F.transform(sections, lambda s: F.struct(head(s).alias("title"), F.split(s["content"], "\n", -1).alias("bullets")))
    bodies = F.transform(sections, lambda s: F.struct(head(s).alias("heading"), s["content"].alias("body")))
    return F.struct(F.when(deck, slides).alias("slides"), F.when(~deck, bodies).alias("sections"))


def at_midnight(events: DataFrame, key: str, time: str, tie: str, state: str) -> DataFrame:
    """key, midnight and the state it then had: the last of each day of the key's."""
    day = F.to_date(time)
    got = events.groupBy(key, day.alias("__day")).agg(F.max_by(state, F.struct(time, tie)).alias("state"))
    return got.select(key, F.date_add("__day", 1).cast("timestamp_ntz").alias("midnight"), "state")


def calendar_midnights(events: DataFrame, key: str, time: str, tie: str, state: str, until: Column) -> DataFrame:
    """key, midnight and state at each midnight from a key's first row up to `until` (an
    aggregate over all rows), on days without rows too: the last state before it."""
    day = F.to_date(time)
    days = events.groupBy(key, day.alias("__day")).agg(F.max_by(F.struct(state), F.struct(time, tie)).alias("__last"))
    end = events.agg(F.to_date(until).alias("__end"))  # one row
    calendar = days.groupBy(key).agg(F.min("__day").alias("__first")).crossJoin(F.broadcast(end))
    calendar = calendar.select(key, F.explode(F.sequence("__first", F.date_sub("__end", 1))).alias("__day"))
    before = Window.partitionBy(key).orderBy("__day")
    filled = calendar.join(days, [key, "__day"], "left").withColumn("state", F.last("__last", ignorenulls=True).over(before)[state])
    return filled.select(key, F.date_add("__day", 1).cast("timestamp_ntz").alias("midnight"), "state")


def actions(triggers: DataFrame, trigger: str, choices: dict[str, str], targets: list[str], spare: list[str]) -> DataFrame:
    """One row for each trigger that has a choice and each target that isn't spared."""
    chosen = F.lit(None).cast("string")
    for name, action in choices.items():
        chosen = F.when(F.col(trigger) == name, action).otherwise(chosen)
    left = [t for t in targets if t not in spare]
    return triggers.withColumn("action", chosen).where("action IS NOT NULL").withColumn("target", F.explode(F.array(*map(F.lit, left))))


def single(events: DataFrame, key: str, time: str, tie: str, seconds: int) -> DataFrame:
    """Runs that start: a trigger is left out while an earlier run of its key, so many
    seconds long, goes on. Keys are sorted within partitions and read as a stream of rows,
    with one time held, so a key may have any number of rows."""
    rows = events.select(F.col(key).alias("k"), F.col(tie).alias("id"), F.unix_micros(F.col(time).cast("timestamp")).alias("at"))
    rows = rows.repartition("k").sortWithinPartitions("k", "at", "id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, until, none = object(), 0, -(1 << 62)
        for b in batches:
            keys, at = b["k"].to_numpy(), b["at"].to_numpy()
            keep = np.zeros(len(b), bool)
            ends = [*(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(b)] if len(b) else []
            for start, end in zip([0, *ends], ends):
                if keys[start] != now:
                    now, until = keys[start], none
                i = start + np.searchsorted(at[start:end], until)
                while i < end:  # from run to run, over the rows between
                    keep[i], until = True, at[i] + seconds * 1_000_000
                    i = start + np.searchsorted(at[start:end], until)
            yield b[keep]

    return rows.mapInPandas(run, rows.schema).select(F.col("k").alias(key), F.col("id").alias(tie))
