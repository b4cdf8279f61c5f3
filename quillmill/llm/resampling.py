"""Importance resampling towards a target: hashed n-gram features and Gumbel top-k.

Features of a text are its runs of n words, for n in a range; a feature's bucket is the
CRC-32 of its words joined by one space. Each word's CRC is computed once, where it stands
in the bytes. Those of longer runs come from it by the algebra of CRCs over GF(2): to
append m bytes is a linear map of the 32 bits, the m-th power of the map for one byte, and
maps for powers of two are squared from it. crc(a + b) = shift(crc(a), len(b)) ^ crc(b), so
no n-gram is ever put together as a string.

Two passes over the texts: the first counts features per bucket (a task sends at most a row
a bucket), the second adds up each document's gains. Between them the driver holds the
gains, a number a bucket, whose count is a parameter. Scores are integers, so a histogram of
them, bounded by their range, tells the score at which the draw ends; only what is not
below it is sorted, by ranges, and numbered by the sizes of the ranges before.

Defined results: a null text has no words, as has an empty one; weight is 0 then. Null ids
count as the empty text in the hash and come after others among ties. Rows that agree in id
and text are scored alike and drawn one by one. Texts of any length are read whole. Only id
and text are read, whatever other columns are named. An empty table, or one in which no
document has enough words, gives no rank; an empty target has T = 0.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.llm.common import Workspace, offsets, ready, slices

POLYNOMIAL = 0xEDB88320
#: Words of more bytes are given to zlib; the loop over places of shorter ones ends here.
LONG = 48
_BYTES = np.arange(256)
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
IN_WORD = (LOWER >= 97) & (LOWER <= 122) | (LOWER >= 48) & (LOWER <= 57) | (LOWER >= 128)


def byte_table() -> np.ndarray:
    """What a zero byte after each value of the lowest byte leaves."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(POLYNOMIAL), out >> 1).astype(np.uint32)
    return out


TABLE = byte_table()


class Shift:
    """Maps of 32 bits that append 1, 2, 4, 8 ... zero bytes to what a CRC was taken of,
    each as four tables of 256 sums of the map's columns."""

    def __init__(self) -> None:
        bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
        self.maps = [self._tables((bits >> np.uint32(8)) ^ TABLE[bits & np.uint32(255)])]

    @staticmethod
    def _tables(columns: np.ndarray) -> np.ndarray:
        out = np.zeros((4, 256), np.uint32)
        for bit in range(32):
            out[bit // 8] ^= np.where(_BYTES >> (bit % 8) & 1, columns[bit], 0).astype(np.uint32)
        return out

    @staticmethod
    def _apply(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
        return tables[0][crc & 255] ^ tables[1][crc >> 8 & 255] ^ tables[2][crc >> 16 & 255] ^ tables[3][crc >> 24]

    def __call__(self, crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        out, bit = crc.copy(), 0
        while len(lengths) and int(lengths.max()) >> bit:
            if bit == len(self.maps):
                m = self.maps[-1]
                self.maps.append(self._tables(self._apply(m, self._apply(m, np.uint32(1) << np.arange(32, dtype=np.uint32)))))
            at = np.flatnonzero(lengths >> bit & 1)
            out[at] = self._apply(self.maps[bit], out[at])
            bit += 1
        return out


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CRCs and byte lengths of all words, and for each text where its words begin, with
    the end at last."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = LOWER[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]]
    ends = ends - ends[0]
    inside = IN_WORD[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = ends[(ends > 0) & (ends < len(data))]
    first[edges], last[edges - 1] = inside[edges], inside[edges - 1]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    lengths = stops - starts
    crc = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    order = np.argsort(-np.minimum(lengths, LONG + 1), kind="stable")
    sizes = lengths[order]
    most = int(np.searchsorted(-sizes, -LONG, side="left"))  # the long ones come first
    at, some, size = starts[order[most:]], crc[order[most:]], sizes[most:]
    for place in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -place, side="left"))
        some[:n] = TABLE[(some[:n] ^ data[at[:n] + place]) & 255] ^ (some[:n] >> 8)
    crc[order[most:]] = some ^ np.uint32(0xFFFFFFFF)
    for k in order[:most]:
        crc[k] = zlib.crc32(data[starts[k] : stops[k]])
    return crc, lengths, np.searchsorted(starts, ends)


class Features:
    def __init__(self, buckets: int, least: int = 1, most: int = 1):
        if not 1 <= least <= most:
            raise ValueError("runs of at least one word, the longest not shorter than the shortest")
        self.buckets, self.least, self.most, self.shift = buckets, least, most, Shift()
        self.space = np.uint32(zlib.crc32(b" "))

    def of(self, texts: pa.Array):
        """(buckets of all features of n words, where each text's begin) for each n, and
        the numbers of words."""
        crc, lengths, begins = words(texts)
        n_words = np.diff(begins)
        ends, run, out = np.repeat(begins[1:], n_words), crc, []
        for n in range(1, self.most + 1):
            if n > 1:  # the run of n - 1 words, a space, and the word after them
                run, after = run[:-1], slice(n - 1, None)
                joined = self.shift(run, np.ones(len(run), np.int64)) ^ self.space
                run = self.shift(joined, lengths[after]) ^ crc[after]
            if n >= self.least:
                whole = np.arange(len(run)) + n <= ends[: len(run)]
                out.append(((run[whole] % np.uint32(self.buckets)).astype(np.int64), np.r_[0, np.cumsum(np.maximum(0, n_words - n + 1))]))
        return out, n_words


def bucket_counts(docs: DataFrame, features: Features, text_col: str = "text") -> DataFrame:
    """bucket and n: how many features of all texts it has."""

    def run(batches):
        n = np.zeros(features.buckets, np.int64)
        for whole in batches:
            for batch in slices(whole, 0):
                for found, _ in features.of(batch.column(0))[0]:
                    n += np.bincount(found, minlength=features.buckets)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], names=["bucket", "n"])

    ready(docs.sparkSession)
    return docs.select(F.col(text_col).cast("string")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: dict[int, int], target: dict[int, int], buckets: int) -> np.ndarray:
    """Thousandths of the logarithm of how much likelier a bucket is in the target, each
    count with one added."""
    s, t = float(sum(raw.values()) + buckets), float(sum(target.values()) + buckets)
    return np.array([math.floor(1000 * math.log((target.get(b, 0) + 1.0) * s / ((raw.get(b, 0) + 1.0) * t))) for b in range(buckets)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, features: Features, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features and weight of each document."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, 1):
                found, n_words = features.of(batch.column(1))
                n, total = np.zeros(len(n_words), np.int64), np.zeros(len(n_words), np.int64)
                for bucket, begins in found:
                    sums = np.r_[0, np.cumsum(gain[bucket])]
                    n += np.diff(begins)
                    total += sums[begins[1:]] - sums[begins[:-1]]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words.astype(np.int64)), pa.array(n), pa.array(total // np.maximum(n, 1))], names=["doc_id", "n_words", "n_features", "weight"])

    ready(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")]]))


def draw(scored: DataFrame, percent: int, ws: Workspace) -> DataFrame:
    """Adds rank to a table of files with doc_id, score and eligible: 1, 2, 3 ... for the
    highest scores of that part of the eligible rows, ties to the smaller id."""
    levels = scored.where("eligible").groupBy("score").agg(F.count("*").alias("n"))  # a row a score, bounded by their range
    most = percent * (levels.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) // 100
    cut = levels.withColumn("upto", F.sum("n").over(Window.orderBy(F.desc("score")))).where(F.col("upto") >= max(1, most)).agg(F.max("score")).first()[0] if most else None
    above = F.col("eligible") & (F.col("score") >= F.lit(cut).cast("long")) if most else F.lit(False)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.col("row")]
    top = scored.where(above).withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    # the number of a row of a sorted partition: its place there below, the partition's above
    top = ws.write(top.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)).withColumn("one", F.lit(1)), "top")
    place = F.col("offset") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    top = top.join(offsets(top, "part", "one"), "part").withColumn("rank", F.when(place <= most, place))
    return scored.where(~above).withColumn("rank", F.lit(None).cast("long")).unionByName(top.select(*scored.columns, "rank"))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, seed: str = "2024", buckets: int = 10_000, ngrams: tuple[int, int] = (1, 1), id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight, score, eligible and rank of each document; rank
    is null where it isn't drawn."""
    ws, features = Workspace(docs.sparkSession), Features(buckets, *ngrams)
    # at most a row a bucket each
    raw, wanted = ({r["bucket"]: r["n"] for r in bucket_counts(x, features, c).collect()} for x, c in ((docs, text_col), (target, target_col)))
    weighed = weigh(docs, gains(raw, wanted, buckets), features, id_col, text_col)
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = weighed.withColumn("score", F.col("weight") + noise).withColumn("eligible", F.col("n_words") >= least_words)
    return draw(ws.write(scored, "scored"), percent, ws)


def op11_crc_resampling(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text")
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")
