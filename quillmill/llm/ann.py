"""Nearest neighbours by score-aware (anisotropic) quantisation.

Vectors are dealt into cells around centroids. Within the cell of centroid c, with y = x - c,
v = y / |y| and p = q - c, the squared distance is |p|^2 - 2 |y| p.v + |y|^2, so that only the
direction v has to be quantised, whatever a vector's length, and the cell's place doesn't
matter: two dimensions at a time, four bits (16 code words) each. Codes and code words
minimise h |r|^2 + (p - h) (r.v)^2 for the error r of v: an error along v costs p / h times
one across it, for it is the error that changes the products of those queries that are
near. Two codes are a byte of the index. A search adds up what the codes of a block of
vectors and a block of queries give (a product of matrices of decoded words, which is
faster than a table entry a byte); a code's error |y| |r| bounds how near a vector can be,
and those that may be nearer than the k-th known so far are measured exactly. To begin
with, the sampled vectors of a query's cells say how far the k-th is at most. So no vector
of a probed cell is lost, however unevenly the vectors lie.

Fitting sees at most `sample` vectors (those with the smallest hashes of their ids);
every vector is indexed. The number of cells grows with the square root of the rows up to
MOST_CELLS, so what the driver holds and broadcasts is bounded. Cells are joined or cut
into units of vectors that a task holds (UNIT bytes at most), and a unit's queries are cut
likewise, so that a cell that holds a third of all rows, or one that is asked for by all
queries, is many tasks. A query is sent once to a unit, not once a cell. Of equal vectors
in a unit, those with the k + 1 smallest ids are measured: no others can be among the k
nearest. Vectors of floats stay floats until they are measured, in double precision.

Defined results: vectors that are null, zero, of another length than most, or have null or
non-finite components take no part, as candidate or query. A query is a row, and each
other row is a candidate, with the same id or vector too; rows of one id that are queries
have k neighbours each. Ties go to the smaller id, and between rows of one id it makes no
difference. With no more than k candidates all are returned. Null ids take no part. Only
the id and the vector are read, whatever other columns are named. An empty table gives an
empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmill.llm.common import Workspace

MOST_CELLS = 1024
BITS = 4
#: Bytes of vectors, or queries, of a task.
UNIT = 1 << 26


def directions(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths, and rows of length one (or zero), with a zero where their number is odd."""
    norm = np.linalg.norm(y, axis=1)
    return norm, np.pad(y / np.where(norm > 0, norm, 1)[:, None], ((0, 0), (0, y.shape[1] % 2)))


def nearest_cells(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, less what is the same for all centres."""
    return (centres**2).sum(1) - 2 * x @ centres.T


def cells_of(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centres, a few thousand rows at a time."""
    return np.concatenate([nearest_cells(x[at : at + 2048], centres).argmin(1) for at in range(0, len(x), 2048)])


def k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = cells_of(x, centres)
        count = np.bincount(own, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return centres


class Quantiser:
    """Anisotropic product quantisation with 4-bit codes."""

    def __init__(self, ratio: float = 4.0):
        self.ratio, self.words = ratio, np.zeros((0, 16, 2))

    def encode(self, v: np.ndarray, sweeps: int = 2) -> np.ndarray:
        n, m = len(v), v.shape[1] // 2
        codes, along = np.zeros((n, m), np.uint8), np.zeros((n, m))
        # coordinates apart, so that sums run over whole rows of 16
        u, words, every = v.reshape(n, m, 2), self.words, np.arange(n)
        for sweep in range(sweeps + 1):
            total = along.sum(1)
            for j in range(m):
                a, b = u[:, j, :1], u[:, j, 1:]
                gap_a, gap_b = a - words[j, :, 0], b - words[j, :, 1]
                part = gap_a * a
                part += gap_b * b
                gap_a *= gap_a
                gap_b *= gap_b
                gap_a += gap_b
                if sweep:
                    whole = part + (total - along[:, j])[:, None]
                    whole *= whole
                    whole *= self.ratio - 1
                    gap_a += whole
                codes[:, j] = gap_a.argmin(1)
                now = part[every, codes[:, j]]
                total += now - along[:, j]
                along[:, j] = now
        return codes

    def fit(self, v: np.ndarray, rounds: int, rng: np.random.Generator) -> Quantiser:
        n, m = len(v), v.shape[1] // 2
        r = u = v.reshape(n, m, 2)
        self.words = np.stack([_padded(k_means(r[:, j], min(16, n), 6, rng)) for j in range(m)])
        for _ in range(rounds):
            codes = self.encode(v, 1)
            for j in range(m):
                along = ((r - self.words[np.arange(m), codes]) * u).sum(2)
                others = along.sum(1) - along[:, j]
                d = self.ratio - 1
                a = np.eye(2) + d * u[:, j, :, None] * u[:, j, None, :]
                b = r[:, j] + d * u[:, j] * (others + (r[:, j] * u[:, j]).sum(1))[:, None]
                left, right = np.zeros((16, 2, 2)), np.zeros((16, 2))
                np.add.at(left, codes[:, j], a)
                np.add.at(right, codes[:, j], b)
                some = np.bincount(codes[:, j], minlength=16) > 0
                self.words[j][some] = np.linalg.solve(left[some], right[some][..., None])[..., 0]
        return self

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return self.words[np.arange(codes.shape[1]), codes].reshape(len(codes), -1)


def packed_codes(codes: np.ndarray) -> np.ndarray:
    """Two codes of four bits a byte; an odd last one has a zero beside it."""
    wide = np.pad(codes, ((0, 0), (0, codes.shape[1] % 2)))
    return wide[:, 0::2] | wide[:, 1::2] << 4


def unpacked_codes(packed: np.ndarray, parts: int) -> np.ndarray:
    return np.stack([packed & 15, packed >> 4], 2).reshape(len(packed), -1)[:, :parts]


def byte_tables(tables: np.ndarray) -> np.ndarray:
    """Tables (part, query, 16) of two parts each as tables (pair, query, 256) by byte, for
    searches of few queries."""
    wide = np.pad(tables, ((0, len(tables) % 2), (0, 0), (0, 0)))
    return (wide[1::2, :, :, None] + wide[0::2, :, None, :]).reshape(len(wide) // 2, tables.shape[1], 256)


def _padded(words: np.ndarray) -> np.ndarray:
    return np.vstack([words, np.repeat(words[:1], 16 - len(words), 0)])


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int, int]:
    """(vec_id, vector array<double>) of the rows that take part, their dimension and number."""
    good = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vector")).where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull()).where(F.coalesce(good, F.lit(False)))
    top = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim, n = (top["d"], top["count"]) if top else (1, 0)
    return rows.where(F.size("vector") == dim), dim, n


def _matrix(column, dim: int, kind) -> np.ndarray:
    """The rows of an Arrow column of binary values of `dim` numbers each, without a copy if
    it is in one piece."""
    parts = []
    for c in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if len(c):
            ends = np.frombuffer(c.buffers()[1], np.int64 if pa.types.is_large_binary(c.type) else np.int32)
            parts.append(np.frombuffer(c.buffers()[2], kind, len(c) * dim, ends[c.offset]).reshape(-1, dim))
    return np.concatenate(parts or [np.zeros((0, dim), kind)]) if len(parts) != 1 else parts[0]


def _binary(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    ends = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.shape[1] * rows.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(rows)])


def units_of(sizes: np.ndarray, most: int) -> np.ndarray:
    """(cell, unit) by unit: small cells share one of at most so many rows, a larger cell has
    several by itself."""
    pairs, unit, room = [], -1, 0
    for c in np.flatnonzero(sizes):
        own = -(-int(sizes[c]) // most)
        if own > 1:
            pairs += [(c, unit + 1 + i) for i in range(own)]
            unit, room = unit + own, 0
            continue
        if sizes[c] > room:
            unit, room = unit + 1, most
        room -= int(sizes[c])
        pairs.append((c, unit))
    return np.array(pairs)


class Nearest:
    """The k nearest rows so far of some queries, and how far away a row may be that can
    still be one (reach)."""

    def __init__(self, asker: np.ndarray, reach: np.ndarray, k: int):
        self.asker, self.reach = asker, reach.copy()
        self.score = np.full((len(asker), k), np.inf)
        self.vec_id, self.row = np.zeros((2, len(asker), k), np.int64)

    def add(self, i: np.ndarray, score: np.ndarray, vec_id: np.ndarray, row: np.ndarray) -> None:
        other = row != self.asker[i]
        some, k = np.unique(i[other]), self.score.shape[1]
        a, b = np.nonzero(np.isfinite(self.score[some]))
        i, score = np.concatenate([i[other], some[a]]), np.concatenate([score[other], self.score[some[a], b]])
        vec_id, row = np.concatenate([vec_id[other], self.vec_id[some[a], b]]), np.concatenate([row[other], self.row[some[a], b]])
        order = np.lexsort((row, vec_id, score, i))
        i = i[order]
        first = np.flatnonzero(np.diff(i, prepend=-1))
        rank = np.arange(len(i)) - np.repeat(first, np.diff(first, append=len(i)))
        i, rank, order = i[rank < k], rank[rank < k], order[rank < k]
        self.score[i, rank], self.vec_id[i, rank], self.row[i, rank] = score[order], vec_id[order], row[order]
        self.reach[some] = np.minimum(self.reach[some], self.score[some, -1])


def scan(near: Nearest, q: np.ndarray, asking: np.ndarray, centre: np.ndarray, x: np.ndarray, coded: np.ndarray, rows: tuple[np.ndarray, ...], scale: float, rerank: int) -> None:
    """Adds what is near to the queries `asking` among the vectors x of a cell, all different,
    with decoded directions `coded`. Of rows (start, count, vec_id, row), `count` from `start` on
    have a vector. scale: no length here exceeds it, so that single precision has room.

    Sums of codes decide in single precision which vectors can be within reach; their
    rounding is allowed for (slack)."""
    y = x - centre
    norm, v = directions(y)
    y, length, slack = y / scale, norm / scale, 3e-7 * (x.shape[1] + 8)
    word, error = length[:, None] * coded[:, : x.shape[1]], length * np.linalg.norm(v - coded, axis=1)
    # |p|^2 - 2 p.w + |w|^2 <= (reach + error)^2, as a product of what has the query and what has the vector
    by_code = np.vstack([word.T, np.einsum("nd,nd->n", word, word) - error**2 - slack * length**2, error, np.ones(len(x))]).astype(np.float32)
    by_vector = np.vstack([y.T, (1 - slack) * length**2, np.ones(len(x))]).astype(np.float32)
    start, count, vec_id, row = rows
    step = max(64, (1 << 21) // len(x))
    for at in range(0, len(asking), step):
        i = asking[at : at + step]
        own = q[i].astype(np.float64)
        p = (own - centre) / scale
        square, one = np.einsum("nd,nd->n", p, p), np.ones(len(i))
        reach = np.minimum(near.reach[i] / scale, np.sqrt(square) + length.max())
        rest = (1 - slack) * square - (1 + slack) * reach**2 - 1e-30
        may = np.column_stack([-2 * p, one, -2 * reach, rest]).astype(np.float32) @ by_code <= 0
        if (left := np.count_nonzero(may)) > may.size // 32:
            far = np.column_stack([-2 * p, one, rest]).astype(np.float32) @ by_vector
            may &= far <= 0
            left = np.count_nonzero(may)
            if left > rerank * len(i) and len(x) > near.score.shape[1]:
                # one of k + 1 different vectors may be the query's own row
                last = np.partition(far, near.score.shape[1], 1)[:, near.score.shape[1]]
                may &= far <= (last + 4 * slack * (square + reach**2 + length.max() ** 2) + 1e-30)[:, None]
        if not left:
            continue
        a, j = np.divmod(np.flatnonzero(may), len(x))
        for cut in range(0, len(a), 1 << 15):
            of, at_x = a[cut : cut + (1 << 15)], j[cut : cut + (1 << 15)]
            score = np.sqrt(((x[at_x] - own[of]) ** 2).sum(1))
            n = count[at_x]
            place = np.repeat(start[at_x] - np.cumsum(n) + n, n) + np.arange(n.sum())
            near.add(np.repeat(i[of], n), np.repeat(score, n), vec_id[place], row[place])


def search(vectors: DataFrame, is_query, k: int = 10, sample: int = 20_000, rerank: int = 200, block: int = 8192, id_col: str = "vec_id", vec_col: str = "embedding", probe_share: float = 0.995) -> DataFrame:
    """query_id, rank, vec_id and score (the distance) for each query.

    probe_share: cells are probed until this share of the neighbours of sampled queries
    among the sampled vectors is found. rerank: where more vectors a query can be within
    reach, the distances at hand narrow the reach. block: vectors that a task decodes at a
    time; a unit has an eighth as many at least."""
    spark = vectors.sparkSession
    ws = Workspace(spark)
    kind = np.float32 if vectors.schema[vec_col].dataType.elementType.typeName() == "float" else np.float64
    rows, dim, n = usable(vectors, id_col, vec_col)
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    def pack(batches):
        for b in batches:
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dim)
            yield pa.RecordBatch.from_arrays([b.column(0), _binary(flat)], names=["vec_id", "v"])

    def first(of: DataFrame, m: int) -> np.ndarray:
        """m vectors, those with the smallest hashes of their ids."""
        seen = of.mapInArrow(pack, "vec_id long, v binary").orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(m).collect()
        return np.frombuffer(b"".join(r["v"] for r in seen), kind).reshape(-1, dim).astype(np.float64)

    # each vector once: copies would draw the centres and the probes to themselves
    x, rng = np.unique(first(rows, sample), axis=0), np.random.default_rng(5)
    cells = min(MOST_CELLS, max(1, math.isqrt(n) // 2), len(x))
    centres = k_means(x, cells, 8, rng)
    own = cells_of(x, centres)
    quantiser = Quantiser().fit(directions(x - centres[own])[1], 3, rng)
    some = first(rows.where(is_query(F.col("vec_id"))), 500)
    probes = max(_probes(y, x, centres, own, k, probe_share) for y in (x[:: max(1, len(x) // 500)], some))
    model = spark.sparkContext.broadcast((centres, quantiser))  # at most MOST_CELLS centres
    guide = spark.sparkContext.broadcast((x, own))  # at most `sample` vectors

    def index(batches):
        centres, quantiser = model.value
        for b in batches:
            x = _matrix(b.column(1), dim, kind).astype(np.float64)
            own = cells_of(x, centres)
            codes = quantiser.encode(directions(x - centres[own])[1])
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), b.column(0), _binary(packed_codes(codes)), b.column(1), b.column(2)], names=["cell", "vec_id", "codes", "v", "row"])

    packed = rows.mapInArrow(pack, "vec_id long, v binary").withColumn("row", F.monotonically_increasing_id())
    indexed = ws.write(packed.mapInArrow(index, "cell int, vec_id long, codes binary, v binary, row long"), "index")
    sizes = np.zeros(cells, np.int64)
    for c, m in indexed.groupBy("cell").count().collect():  # a row per cell
        sizes[c] = m
    # some units a core, unless they get too small or too large for a task
    most = max(1, min(max(block // 8, n // (3 * spark.sparkContext.defaultParallelism)), UNIT // (dim * np.dtype(kind).itemsize)))
    pairs = units_of(sizes, most)
    starts = np.flatnonzero(np.diff(pairs[:, 1], prepend=-1))

    def ask(batches):
        centres, (x, own) = model.value[0], guide.value
        square = (x**2).sum(1)
        for b in (y.slice(at, 128) for y in batches for at in range(0, y.num_rows, 128)):
            q = _matrix(b.column(1), dim, kind).astype(np.float64)
            far = nearest_cells(q, centres)
            order = np.argsort(far, 1, kind="stable")
            # enough cells to hold k others, whatever the number of probes
            need = np.maximum(probes, (np.cumsum(sizes[order], 1) <= 4 * k).sum(1) + 1)
            last = far[np.arange(len(q)), order[np.arange(len(q)), np.minimum(need, cells) - 1]]
            probed = far <= last[:, None]
            units = np.logical_or.reduceat(probed[:, pairs[:, 0]], starts, axis=1)
            # of k + 1 sampled vectors in probed cells k are others, so none is needed beyond them
            reach = np.full(len(q), np.inf)
            if len(x) > k:
                off = np.where(probed[:, own], square - 2 * q @ x.T, np.inf)
                pick = np.argpartition(off, k, 1)[:, : k + 1]
                known = np.isfinite(np.take_along_axis(off, pick, 1)).all(1)
                reach[known] = np.sqrt(((x[pick[known]] - q[known, None]) ** 2).sum(2)).max(1)
            ends = np.concatenate([[0], np.cumsum(units.sum(1))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(last), pa.array(reach), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.nonzero(units)[1].astype(np.int32)))],
                names=["query_id", "q", "asker", "last", "reach", "units"])

    asking = indexed.where(is_query(F.col("vec_id"))).select("vec_id", "v", "row")
    asked = ws.write(asking.mapInArrow(ask, "query_id long, q binary, asker long, last double, reach double, units array<int>"), "asked").withColumn("unit", F.explode("units")).drop("units")
    # a row per unit, of thousands of vectors; without the hint Spark goes by the size of files, in which copies take no room
    parts = [(u, -(-m // most)) for u, m in asked.groupBy("unit").count().collect()]
    blocks = F.broadcast(spark.createDataFrame(parts, "unit int, qbs int"))
    ranges = np.bincount(pairs[:, 0], minlength=cells)
    place = F.broadcast(spark.createDataFrame([(int(c), int(u), int(ranges[c])) for c, u in pairs[np.unique(pairs[:, 0], return_index=True)[1]]], "cell int, unit int, vbs int"))
    left = indexed.join(place, "cell").withColumn("unit", F.col("unit") + F.pmod(F.hash("row"), "vbs")).join(blocks, "unit").select("unit", F.explode(F.sequence(F.lit(0), F.col("qbs") - 1)).alias("qb"), "cell", "vec_id", "codes", "v", "row")
    right = asked.join(blocks, "unit").select("unit", F.pmod(F.hash("asker"), "qbs").alias("qb"), "query_id", "q", "asker", "last", "reach")
    out = pa.schema([(c, pa.int64()) for c in ("query_id", "asker", "vec_id", "row")] + [("score", pa.float64())])

    def meet(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        if not vectors.num_rows or not queries.num_rows:
            return out.empty_table()
        centres, quantiser = model.value
        cell, vec_id, row, query_id, asker, last, reach = (t[c].to_numpy() for t, names in ((vectors, ("cell", "vec_id", "row")), (queries, ("query_id", "asker", "last", "reach"))) for c in names)
        x, q = _matrix(vectors["v"], dim, kind), _matrix(queries["q"], dim, kind)
        codes = _matrix(vectors["codes"], (len(quantiser.words) + 1) // 2, np.uint8)
        same = pa.Array.from_buffers(pa.binary(dim * x.itemsize), len(x), [None, pa.py_buffer(x)]).dictionary_encode().indices.to_numpy()
        order = np.lexsort((row, vec_id, same, cell))
        start = np.flatnonzero(np.diff(same[order], prepend=-1))
        # of equal vectors the k + 1 smallest ids: no others can be among the k nearest
        count = np.minimum(np.diff(start, append=len(order)), k + 1)
        held, vec_id, row = order[start], vec_id[order], row[order]
        near = Nearest(asker, reach, k)
        longest = max(np.linalg.norm(q[at : at + 8192].astype(np.float64), axis=1).max() for at in range(0, len(q), 8192))
        ends = np.flatnonzero(np.diff(cell[held], prepend=-1, append=-1))
        for a, b in zip(ends, ends[1:]):
            centre = centres[cell[held[a]]]
            # as `ask` has it, with room for another order of its sums
            size = (centre**2).sum()
            off = np.concatenate([size - 2 * q[at : at + 8192].astype(np.float64) @ centre for at in range(0, len(q), 8192)])
            probing = np.flatnonzero(off <= last + 1e-12 * (size + longest**2))
            for at in range(a, b if len(probing) else a, block):
                some = slice(at, min(at + block, b))
                here = x[held[some]].astype(np.float64)
                scale = longest + np.linalg.norm(centre) + np.linalg.norm(here, axis=1).max()
                coded = quantiser.decode(unpacked_codes(codes[held[some]], len(quantiser.words)))
                scan(near, q, probing, centre, here, coded, (start[some], count[some], vec_id, row), scale, rerank)
        i, r = np.nonzero(np.isfinite(near.score))
        return pa.table([query_id[i], asker[i], near.vec_id[i, r], near.row[i, r], near.score[i, r]], schema=out)

    found = left.groupBy("unit", "qb").cogroup(right.groupBy("unit", "qb")).applyInArrow(meet, "query_id long, asker long, vec_id long, row long, score double")
    rank = F.row_number().over(Window.partitionBy("asker").orderBy("score", "vec_id", "row"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _probes(queries: np.ndarray, x: np.ndarray, centres: np.ndarray, own: np.ndarray, k: int, share: float) -> int:
    """Cells that hold this share of the k nearest sampled vectors of sampled queries."""
    if len(centres) == 1:
        return 1
    need: list[int] = [0]
    for q in queries:
        far = ((x - q) ** 2).sum(1)
        near = np.argpartition(far, min(k + 1, len(x) - 1))[: k + 1]
        place = np.argsort(np.argsort(nearest_cells(q[None], centres)[0]))
        need += place[own[near]].tolist()
    return int(np.quantile(need, share)) + 1


def op10_anisotropic_search(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(rows, lambda i: i % 100 == 0)
