"""Guaranteed heavy hitters: keys that hold more than a share of their group's weight.

Summaries: a group's counters lie in a numpy table with open addressing, which all groups
of a task share. When a group has more than `limit` counters, their exact median, found by
quickselect, is subtracted from each, those that reach zero go, and the median is added to
the group's offset. A purge takes at least limit / 2 times the median from the group's
weight, so offset <= 2 * weight / limit, whatever the number of keys: a key's true weight is
between its counter and its counter plus the offset, and one without a counter weighs no
more than the offset. To merge summaries, counters of one are replayed into the other and
the offsets are added; the bound holds for the sum.

Plan: each task of the entries summarises its part (in bounded memory: a full table is sent
and begun anew). Summaries are merged in a tree, FAN tasks' at a time, so that no task reads
more of a hot group than that. Candidates (at most about 1 / share a group) come from the
last summaries. Where nothing was ever purged, counters are exact; candidates of the other
groups are counted again over the entries, which are summed up by key before they are
shuffled. A bitmap of BUCKETS bits, of hashes of such groups, keeps the others' entries
where they are.

Defined results: an entry with a null group, item or weight drops out; repeated entries
count again; zero weights count as entries; a negative weight is an error. Texts of any
length may be items. An item at exactly the share is not returned. An empty table gives an
empty one.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import Workspace, ready

EMPTY = np.int64(-1)
FAN = 16
#: Rows that are summed up at once, counters after which a task sends its table, and hash buckets of purged groups.
ROWS, MOST, BUCKETS = 1 << 16, 1 << 20, 1 << 16
KEY = ["stream", "grp"]
SUMMARY = "stream string, grp long, node long, n_entries long, total long, offset long, items array<string>, counts array<long>"


class Counters:
    """Counts of 64-bit keys in one table with open addressing; places of many keys are
    looked for at once."""

    def __init__(self, size: int = 64):
        self.keys, self.counts, self.live = np.full(size, EMPTY), np.zeros(size, np.int64), 0

    def held(self) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.keys != EMPTY)
        return self.keys[at], self.counts[at]

    def add(self, keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Adds to keys, each given once; says which of them are new."""
        if 4 * (self.live + len(keys)) > 3 * len(self.keys):
            self.rebuild(*self.held(), room=self.live + len(keys))
        mask = np.uint64(len(self.keys) - 1)
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        at = (mixed ^ mixed >> np.uint64(32)) & mask
        new, left = np.zeros(len(keys), bool), np.arange(len(keys))
        while len(left):
            here = at[left]
            free = self.keys[here] == EMPTY
            self.keys[here[free]] = keys[left[free]]  # of several that want a place the last gets it
            found = self.keys[here] == keys[left]
            self.counts[here[found]] += weights[left[found]]
            new[left[found & free]] = True
            left = left[~found]
            at[left] = at[left] + np.uint64(1) & mask
        self.live += int(new.sum())
        return new

    def rebuild(self, keys: np.ndarray, counts: np.ndarray, room: int = 0) -> None:
        size = 64
        while 3 * size < 4 * max(room, len(keys)):
            size *= 2
        self.__init__(size)
        self.add(keys, counts)


def purge(counts: np.ndarray, limit: int) -> tuple[np.ndarray, int]:
    """What is left of the counters when at most `limit` stay, and how much was taken."""
    taken, counts = 0, counts.copy()
    while np.count_nonzero(counts > 0) > limit:
        some = counts[counts > 0]
        median = int(np.partition(some, len(some) // 2)[len(some) // 2])
        counts -= median
        taken += median
    return np.maximum(counts, 0), taken


class Bank:
    """Summaries of groups. A group is named by a text, and so is an item."""

    def __init__(self, limit: int):
        self.limit, self.table, self.groups, self.items = limit, Counters(), {}, {}
        self.totals = np.zeros((4, 64), np.int64)  # entries, weight, offset and counters of each group

    @staticmethod
    def _codes(texts: pa.Array, known: dict) -> np.ndarray:
        coded = texts.dictionary_encode()
        names = coded.dictionary.to_pylist()
        return np.array([known.setdefault(x, len(known)) for x in names], np.int64)[coded.indices.to_numpy(zero_copy_only=False)]

    def count(self, groups: pa.Array, *totals: np.ndarray) -> None:
        """Adds entries, weights and offsets to groups."""
        at = self._codes(groups, self.groups)
        while len(self.groups) > self.totals.shape[1]:
            self.totals = np.concatenate([self.totals, np.zeros_like(self.totals)], axis=1)
        for k, x in enumerate(totals):
            np.add.at(self.totals[k], at, x)

    def add(self, groups: pa.Array, items: pa.Array, weights: np.ndarray) -> None:
        """Adds to counters of pairs, each given once, of groups that have been counted."""
        some = np.flatnonzero(weights)
        g, i = self._codes(groups, self.groups)[some], self._codes(items, self.items)[some]
        new = self.table.add(g << 32 | i, weights[some])
        np.add.at(self.totals[3], g[new], 1)
        over = np.flatnonzero(self.totals[3] > self.limit)
        if not len(over):
            return
        keys, counts = self.table.held()
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        starts = np.searchsorted(keys, over << 32)
        for group, a, n in zip(over, starts, self.totals[3][over]):
            counts[a : a + n], taken = purge(counts[a : a + n], self.limit)
            self.totals[2][group] += taken
            self.totals[3][group] = np.count_nonzero(counts[a : a + n])
        self.table.rebuild(keys[counts > 0], counts[counts > 0])

    def full(self) -> bool:
        return max(self.table.live, len(self.items), len(self.groups)) > MOST

    def rows(self) -> pa.RecordBatch:
        names = [x.split("\0") for x in self.groups]
        keys, counts = self.table.held()
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        ends = np.searchsorted(keys, np.arange(len(names) + 1) << 32).astype(np.int32)
        texts = pa.array(list(self.items), pa.string()).take(pa.array(keys & 0xFFFFFFFF))
        lists = [pa.ListArray.from_arrays(pa.array(ends), x) for x in (texts, pa.array(counts))]
        return pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in names], pa.string()), *[pa.array([int(x[k]) for x in names], pa.int64()) for k in (1, 2)], *[pa.array(x[: len(names)]) for x in self.totals[:3]], *lists],
            names=[*KEY, "node", "n_entries", "total", "offset", "items", "counts"],
        )


def _chunks(batches):
    """Tables of about ROWS rows, or of a batch that is larger."""
    some, n = [], 0
    for batch in batches:
        some.append(batch)
        n += batch.num_rows
        if n >= ROWS:
            yield pa.Table.from_batches(some).combine_chunks()
            some, n = [], 0
    if n:
        yield pa.Table.from_batches(some).combine_chunks()


def _flat(x) -> pa.Array:
    return x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x


def _named(table: pa.Table, node=None) -> pa.Array:
    """Names of groups in a bank: stream (which holds no zero byte), group and node."""
    node = pa.scalar(str(node)) if node is not None else table["node"].cast(pa.string())
    return _flat(pc.binary_join_element_wise(table["stream"], table["grp"].cast(pa.string()), node, "\0"))


def summarise(entries: DataFrame, limit: int) -> DataFrame:
    """Summaries of each task's part; node is the number of the task."""

    def run(batches):
        node, bank = TaskContext.get().partitionId(), Bank(limit)
        for chunk in _chunks(batches):
            if pc.min(chunk["weight"]).as_py() < 0:
                raise ValueError("a weight is negative")
            sums = chunk.group_by([*KEY, "item"], use_threads=False).aggregate([("weight", "sum"), ("weight", "count")])
            groups, weights = _named(sums, node), sums["weight_sum"].to_numpy()
            bank.count(groups, sums["weight_count"].to_numpy(), weights)
            bank.add(groups, _flat(sums["item"]), weights)
            if bank.full():
                yield bank.rows()
                bank = Bank(limit)
        yield bank.rows()

    return entries.select(*KEY, "item", "weight").mapInArrow(run, SUMMARY)


def merge(summaries: DataFrame, limit: int) -> DataFrame:
    """One summary of each group and node. Their rows lie side by side in a task, so that
    all but the last are done when the table is sent."""

    def run(batches):
        bank = Bank(limit)
        for chunk in _chunks(batches):
            groups, items = _named(chunk), _flat(chunk["items"])
            bank.count(groups, *[chunk[c].to_numpy() for c in ("n_entries", "total", "offset")])
            pairs = pa.table({"g": groups.take(pc.list_parent_indices(items)), "i": items.flatten(), "w": _flat(chunk["counts"]).flatten()})
            sums = pairs.group_by(["g", "i"], use_threads=False).aggregate([("w", "sum")])
            bank.add(_flat(sums["g"]), _flat(sums["i"]), sums["w_sum"].to_numpy())
            if bank.full():
                rows, last = bank.rows(), groups[-1].as_py()
                open_ = pa.array([x == last for x in bank.groups])
                yield rows.filter(pc.invert(open_))
                bank, kept = Bank(limit), rows.filter(open_).to_pylist()[0]
                bank.count(pa.array([last]), *[np.array([kept[c]]) for c in ("n_entries", "total", "offset")])
                bank.add(pa.array([last] * len(kept["items"]), pa.string()), pa.array(kept["items"], pa.string()), np.array(kept["counts"], np.int64))
        yield bank.rows()

    place = [*KEY, "node"]
    return summaries.repartition(*place).sortWithinPartitions(*place).mapInArrow(run, SUMMARY)


def summaries(ws: Workspace, entries: DataFrame, limit: int) -> DataFrame:
    """A summary of each group: stream, grp, n_entries, total, offset, items, counts."""
    rows, level = ws.write(summarise(entries, limit), "level0"), 0
    last = rows.agg(F.max("node")).first()[0] or 0
    while True:
        last, level = last // FAN, level + 1
        rows = ws.write(merge(rows.withColumn("node", F.floor(F.col("node") / FAN)), limit), f"level{level}")
        ws.drop(f"level{level - 1}")
        if not last:
            return rows.drop("node")


def heavy_hitters(entries: DataFrame, share: int = 20, precision: int = 10) -> DataFrame:
    """stream, grp, item, n_entries, total, w, low, estimate, high of the items of
    entries(stream, grp, item, weight) with share * w > total. low and high differ by at
    most total / (share * precision)."""
    ws = Workspace(entries.sparkSession)
    limit = 3 * share * precision  # of which 2 would do
    whole = F.col("grp").isNotNull() & F.col("item").isNotNull() & F.col("weight").isNotNull()
    entries = ws.write(entries.where(whole).select("stream", F.col("grp").cast("long").alias("grp"), F.col("item").cast("string").alias("item"), F.col("weight").cast("long").alias("weight")), "entries")
    found = summaries(ws, entries, limit)
    counters = F.filter(F.arrays_zip(F.col("items").alias("item"), F.col("counts").alias("low")), lambda x: share * (x["low"] + F.col("offset")) > F.col("total"))
    found = found.select(*KEY, "n_entries", "total", "offset", F.explode(counters).alias("x"))
    found = ws.write(found.select(*KEY, "x.item", "n_entries", "total", "x.low", (F.col("x.low") + F.floor(F.col("offset") / 2)).alias("estimate"), (F.col("x.low") + F.col("offset")).alias("high")), "candidates")
    bucket = F.pmod(F.xxhash64(*KEY), F.lit(BUCKETS))
    open_ = found.where("high > low")
    bits = open_.select(bucket.alias("b")).groupBy(F.shiftright("b", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 AS int))")).alias("bits"))
    held = {r["word"]: r["bits"] for r in bits.collect()}  # at most BUCKETS / 64 rows
    bitmap = F.array(*[F.lit(held.get(k, 0)).cast("long") for k in range(BUCKETS // 64)])
    purged = F.expr("shiftright(__word, cast(__b & 63 AS int)) & 1") == 1
    again = entries.withColumn("__b", bucket).withColumn("__word", F.element_at(bitmap, (F.shiftright("__b", 6) + 1).cast("int"))).where(purged).groupBy(*KEY, "item").agg(F.sum("weight").alias("w"))
    exact = found.where("high = low").withColumn("w", F.col("low")).unionByName(open_.join(again.hint("merge"), [*KEY, "item"]))
    return exact.where(share * F.col("w") > F.col("total")).select(*KEY, "item", "n_entries", "total", "w", "low", "estimate", "high")


def _refused(name: str):
    raise ValueError(name)


def json_items(text: str | None) -> list[str]:
    """os=, tag= and sku= of a JSON object; of text that isn't valid JSON throughout, or
    holds half a surrogate pair, nothing. Numbers are taken as they are written; null, and
    values that are objects or lists, give no item."""
    try:
        x = json.loads(text or "", parse_constant=_refused, parse_int=str, parse_float=str)
    except (ValueError, RecursionError):
        return []
    if not isinstance(x, dict):
        return []
    device, tags, items = x.get("device"), x.get("tags"), x.get("items")
    out = [("os=", device.get("os"))] if isinstance(device, dict) else []
    out += [("tag=", t) for t in tags] if isinstance(tags, list) else []
    out += [("sku=", i.get("sku")) for i in items if isinstance(i, dict)] if isinstance(items, list) else []
    got = [k + (v if isinstance(v, str) else str(v).lower()) for k, v in out if isinstance(v, (str, bool))]
    try:
        "".join(got).encode()
    except UnicodeEncodeError:
        return []
    return got


def property_entries(clicks: DataFrame, group: str = "client_id", props: str = "props") -> DataFrame:
    """grp and item: an entry for each item of each row with a group."""

    def run(batches):
        for batch in batches:
            found = [json_items(x) for x in batch.column(1).to_pylist()]
            at = np.repeat(np.arange(batch.num_rows), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array([i for x in found for i in x], pa.string())], names=["grp", "item"])

    ready(clicks.sparkSession)
    return clicks.where(F.col(group).isNotNull() & F.col(props).isNotNull()).select(F.col(group).cast("long"), F.col(props)).mapInArrow(run, "grp long, item string")


def hour(ts: Column) -> Column:
    """Whole hours since 1970 of a time without a zone, whatever the session's zone."""
    ts = ts.cast("timestamp_ntz")
    return F.datediff(F.to_date(ts), F.lit("1970-01-01")).cast("long") * 24 + F.hour(ts)


def op12_heavy_hitters(spark, sf_dir: str) -> DataFrame:
    clicks = spark.read.parquet(f"{sf_dir}/clicks.parquet")
    lines = spark.read.parquet(f"{sf_dir}/sale_lines.parquet")
    one = F.lit(1).cast("long").alias("weight")
    user = clicks.select(F.lit("user").alias("stream"), hour(F.col("ts")).alias("grp"), F.col("client_id").cast("string").alias("item"), one)
    part = lines.select(F.lit("part").alias("stream"), F.col("vendor_id").alias("grp"), F.col("item_id").cast("string").alias("item"), F.col("quantity").cast("long").alias("weight"))
    prop = property_entries(clicks).select(F.lit("prop").alias("stream"), "grp", "item", one)
    return heavy_hitters(user.unionByName(part).unionByName(prop))
