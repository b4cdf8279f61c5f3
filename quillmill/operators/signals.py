"""Filtering of signals held as long tables, a sample a row.

A Butterworth band-pass of order four, designed by the bilinear transform from its
analogue poles and run as second-order sections forwards and backwards, so that it has no
phase. What a stretch of samples does to the filter's state is an affine map: the state
before it, times a power of one matrix, plus what its samples add. So a channel is cut into
blocks, rows of one array each. Each block is run from a zero state; their maps are composed
along the channel, group by group and then over the groups, however many these are; and
each block is run again from the state it really begins with. No task holds a channel."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.operators.selection import ranked
from quillmill.sources.outputs import new_folder
from quillmill.workers import importable


def sections(order: int, low: float, high: float, rate: float) -> np.ndarray:
    """Rows b0 b1 b2 a1 a2 of the digital band-pass."""
    w = 2 * rate * np.tan(np.pi * np.array([low, high]) / rate)
    width, centre = w[1] - w[0], np.sqrt(w[0] * w[1])
    proto = np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order))
    half = proto * width / 2
    root = np.sqrt(half**2 - centre**2)
    poles = np.concatenate([half + root, half - root])
    z = (2 * rate + poles) / (2 * rate - poles)
    z = z[z.imag > 0]  # conjugates go together; zeros are +1 and -1
    out = np.array([[1.0, 0.0, -1.0, -2 * p.real, abs(p) ** 2] for p in z])
    mid = np.exp(2j * np.arctan(centre / (2 * rate)))
    gain = np.prod([(1 - mid**-2) / (1 + s[3] * mid**-1 + s[4] * mid**-2) for s in out])
    out[0, :3] /= abs(gain)
    return out


def _run(sos: np.ndarray, x: np.ndarray) -> np.ndarray:
    for b0, b1, b2, a1, a2 in sos:
        y, s1, s2 = np.empty_like(x), 0.0, 0.0
        # a steady start, as if the first value had always been there
        level = x[0] * (b0 + b1 + b2) / (1 + a1 + a2)
        s1, s2 = level - b0 * x[0], b2 * x[0] - a2 * level
        for i, v in enumerate(x):
            y[i] = b0 * v + s1
            s1, s2 = b1 * v - a1 * y[i] + s2, b2 * v - a2 * y[i]
        x = y
    return x


def zero_phase(sos: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forwards and backwards, the ends continued by their odd reflection."""
    n = min(len(x) - 1, 3 * (2 * len(sos) + 1))
    if n < 1:
        return np.zeros_like(x)
    wide = np.concatenate([2 * x[0] - x[n:0:-1], x, 2 * x[-1] - x[-2 : -n - 2 : -1]])
    return _run(sos, _run(sos, wide)[::-1])[::-1][n:-n]


def steady(sos: np.ndarray) -> np.ndarray:
    """The state that a constant input of one has always had."""
    out, level = np.zeros(2 * len(sos)), 1.0
    for k, (b0, b1, b2, a1, a2) in enumerate(sos):
        after = level * (b0 + b1 + b2) / (1 + a1 + a2)
        out[2 * k : 2 * k + 2] = after - b0 * level, b2 * level - a2 * after
        level = after
    return out


def run_lanes(sos: np.ndarray, x: np.ndarray, sizes: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Filters rows of x, each of its own size, from their states; and their last states."""
    y, state = np.zeros_like(x), state.copy()
    for t in range(x.shape[1]):
        u, on = x[:, t], t < sizes
        new = np.empty_like(state)
        for k, (b0, b1, b2, a1, a2) in enumerate(sos):
            out = b0 * u + state[:, 2 * k]
            new[:, 2 * k] = b1 * u - a1 * out + state[:, 2 * k + 1]
            new[:, 2 * k + 1] = b2 * u - a2 * out
            u = out
        y[:, t] = u
        state = np.where(on[:, None], new, state)
    return y, state


def step_matrix(sos: np.ndarray) -> np.ndarray:
    """What a sample of zero does to a state."""
    n = 2 * len(sos)
    return run_lanes(sos, np.zeros((n, 1)), np.ones(n), np.eye(n))[1].T


#: Blocks of a channel that are composed at once, and lanes that are run side by side.
GROUP, LANES = 1024, 256


def _lanes(batches, at: int):
    """Batches of rows, and their arrays in column `at` as one matrix with their sizes."""
    for whole in batches:
        for start in range(0, whole.num_rows, LANES):
            batch = whole.slice(start, LANES)
            lists = [np.asarray(x, float) for x in batch.column(at).to_pylist()]
            sizes = np.array([len(x) for x in lists])
            x = np.zeros((len(lists), sizes.max()))
            for row, v in zip(x, lists):
                row[: len(v)] = v
            yield batch, x, sizes


def _starts(maps: DataFrame, channel: str, matrix: np.ndarray, zero: np.ndarray) -> DataFrame:
    """channel, k and start (the state before) for maps(channel, k, size, add, first) in the
    order of k; `first` is the value that a channel's state is steady for."""
    kind = maps.schema[channel].dataType.simpleString()
    power = lambda n: np.linalg.matrix_power(matrix, int(n))

    def along(rows: pd.DataFrame, state: np.ndarray, powers: dict) -> list[list[float]]:
        out = []
        for size, add in zip(rows["size"], rows["add"]):
            out.append(state.tolist())
            if size not in powers:
                powers[size] = power(size)
            state = powers[size] @ state + np.asarray(add)
        return [*out, state.tolist()]

    if (maps.agg(F.max("k")).first()[0] or 0) < GROUP:

        def each(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("k")
            return rows[[channel, "k"]].assign(start=along(rows, zero * rows["first"].iloc[0], {})[:-1])

        return maps.groupBy(channel).applyInPandas(each, f"{channel} {kind}, k long, start array<double>")

    def composed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("k")
        end = along(rows, np.zeros(len(zero)), {})[-1]
        return pd.DataFrame({channel: rows[channel].iloc[:1], "k": rows["g"].iloc[:1], "size": [rows["size"].sum()], "add": [end], "first": rows["first"].iloc[:1]})

    maps = maps.withColumn("g", F.floor(F.col("k") / GROUP).cast("long"))
    above = maps.groupBy(channel, "g").applyInPandas(composed, f"{channel} {kind}, k long, size long, add array<double>, first double")
    above = _starts(_kept(above), channel, matrix, zero).select(F.col(channel), F.col("k").alias("g"), F.col("start").alias("from"))

    def within(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("k")
        return rows[[channel, "k"]].assign(start=along(rows, np.asarray(rows["from"].iloc[0]), {})[:-1])

    return maps.join(above, [channel, "g"]).groupBy(channel, "g").applyInPandas(within, f"{channel} {kind}, k long, start array<double>")


def _kept(rows: DataFrame) -> DataFrame:
    path = new_folder(rows.sparkSession)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def filtered(blocks: DataFrame, channel: str, sos: np.ndarray) -> DataFrame:
    """blocks(channel, k, v array<double>) filtered in the order of k, from a steady start."""
    matrix, zero = step_matrix(sos), steady(sos)
    names, spark_type = [channel, "k"], blocks.schema[channel]

    def mapped(batches):
        for batch, x, sizes in _lanes(batches, 2):
            end = run_lanes(sos, x, sizes, np.zeros((len(x), len(zero))))[1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(sizes.astype(np.int64)), pa.array(end.tolist(), pa.list_(pa.float64())), pa.array(x[:, 0])], names=[*names, "size", "add", "first"])

    fields = [spark_type, T.StructField("k", T.LongType())]
    doubles = T.ArrayType(T.DoubleType())
    maps = blocks.select(*names, "v").mapInArrow(mapped, T.StructType([*fields, T.StructField("size", T.LongType()), T.StructField("add", doubles), T.StructField("first", T.DoubleType())]))
    starts = _starts(_kept(maps), channel, matrix, zero)

    def again(batches):
        for batch, x, sizes in _lanes(batches, 2):
            y = run_lanes(sos, x, sizes, np.array(batch.column(3).to_pylist()))[0]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([r[:n].tolist() for r, n in zip(y, sizes)], pa.list_(pa.float64()))], names=[*names, "v"])

    return blocks.join(starts, names).select(*names, "v", "start").mapInArrow(again, T.StructType([*fields, T.StructField("v", doubles)]))


def band_pass(samples: DataFrame, rate: float, low: float = 20.0, high: float = 500.0, order: int = 4, channel: str = "channel", by: list[str] | None = None, value: str = "v", coarse: list[Column] | None = None, block: int = 4096) -> DataFrame:
    """channel, `by` and the filtered value of samples in the order of `by`, channel by
    channel, the ends continued by their odd reflection. Samples without a value are left
    out; a channel of one sample is zero. `coarse` is the beginning of that order in few
    values, as ranked() takes it."""
    importable(samples.sparkSession)
    sos, by = sections(order, low, high, rate), by or ["t"]
    rows = samples.where(F.col(value).isNotNull()).select(channel, *by, F.col(value).cast("double").alias("__v"))
    placed = _kept(ranked(rows, [channel], coarse or [], [F.col(c) for c in by], "__i").withColumn("__i", F.col("__i") - 1))
    ends = placed.groupBy(channel).agg(F.count("*").alias("__n"), F.min_by("__v", "__i").alias("__a"), F.max_by("__v", "__i").alias("__z"))
    ends = ends.withColumn("__p", F.least(F.col("__n") - 1, F.lit(3 * (2 * len(sos) + 1))))
    i, n, p, v = (F.col(f"__{c}") for c in "inpv")
    at = lambda w, x: F.struct(w.alias("w"), x.alias("v"))
    wide = F.array_compact(F.array(at(i + p, v), F.when((i >= 1) & (i <= p), at(p - i, 2 * F.col("__a") - v)), F.when((i <= n - 2) & (i >= n - 1 - p), at(p + n + (n - 2 - i), 2 * F.col("__z") - v))))
    cut = placed.join(ends, channel).where(n > 1).select(channel, F.explode(wide).alias("x")).select(channel, F.floor(F.col("x.w") / block).alias("k"), "x")
    blocks = _kept(cut.groupBy(channel, "k").agg(F.array_sort(F.collect_list("x"))["v"].alias("v")))
    last = ends.select(channel, F.floor((n + 2 * p - 1) / block).alias("__last"))
    turn = lambda b: b.join(last, channel).select(channel, (F.col("__last") - F.col("k")).alias("k"), F.reverse("v").alias("v"))
    ahead = _kept(filtered(blocks, channel, sos))
    done = turn(filtered(_kept(turn(ahead)), channel, sos))
    # back to samples, without what was put at the ends
    flat = done.join(ends, channel).select(channel, "__p", "__n", "k", F.posexplode("v").alias("__j", "__w"))
    flat = flat.select(channel, (F.col("k") * block + F.col("__j") - F.col("__p")).alias("__i"), "__n", "__w").where("__i >= 0 AND __i < __n").drop("__n")
    return placed.join(flat, [channel, "__i"], "left").select(channel, *by, F.coalesce("__w", F.lit(0.0)).alias(value))


def synthetic(spark: SparkSession, rate: int = 2048, seconds: int = 2, channels: int = 16, seed: int = 42) -> DataFrame:
    """Seeded normal noise."""
    data = np.random.default_rng(seed).standard_normal((rate * seconds, channels))
    t, c = np.indices(data.shape)
    return spark.createDataFrame(pd.DataFrame({"channel": c.ravel().astype("int32"), "t": t.ravel().astype("int32"), "v": data.ravel()}))
