"""Removing repeated passages: each byte covered by a WINDOW-byte string that also starts
earlier in the corpus, by suffix arrays over the places where texts may repeat.

Of the GRAM-byte strings in a window the one with the smallest hash is its anchor, so
equal windows have equal anchors at equal places. Windows whose anchor occurs once can't
repeat. What surrounds an anchor (WINDOW - GRAM bytes on each side, less at the ends of
a document) is its context.

1. Anchors are counted (64-bit hashes, shuffled once).
2. Occurrences of repeated anchors are compared by a hash of anchor and context: all but
   the earliest of equal ones are covered as a whole. Batches settle this among their own
   rows first, so that a group of copies shrinks before it is shuffled.
3. Anchors that occur in different contexts may still share windows. Their occurrences
   are split by the nearer half of the context on the left, or on the right: a window
   reaches over one of them. What stays together is put in one sequence, the part that
   all share as a single symbol, and its suffix array (see suffix_array) brings equal
   windows side by side: runs whose common prefixes span a window. All but the earliest
   of a run are covered. Groups of more than LIMIT occurrences are split further by
   shuffles first, until they are small or their windows are whole.
4. The covered spans of a document meet its text, and their bytes are left out.

Which texts to read again in steps 2 and 3 is told by bitmaps whose size is bounded
(at most 2^28 bits); they only save work, as what they let through is compared exactly.

Defined results: a null text is empty; texts shorter than a window lose nothing. Null ids
come before all others. Rows that agree in id and text are the same document: each loses
what one of them would lose, none is earlier than the other. Rows of the same id and
other texts are ordered by a hash of their texts. Windows never cross documents. Very
long texts are read in pieces that overlap by a window. Only the id and the text are read,
whatever other columns are named. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmill.llm.common import Workspace
from quillmill.llm.suffix_array import common_prefixes, suffix_array

WINDOW, GRAM = 100, 64
EXTRA = WINDOW - GRAM
LIMIT = 20_000
#: A context is split while windows need more bytes of it than this.
STOP = 4
PIECE = 1 << 20
_ODD = 0x9E3779B97F4A7C15
_FIRST = np.iinfo(np.int64).min


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP = _powers(_ODD, PIECE + 2 * WINDOW)
_DOWN = _powers(pow(_ODD, -1, 1 << 64), PIECE + 2 * WINDOW)
_BYTE = np.frombuffer(b"".join(hashlib.sha256(bytes([i])).digest()[:8] for i in range(256)), np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _slide(x: np.ndarray, w: int, least) -> np.ndarray:
    """Minimum or maximum of each w neighbours, by doubling."""
    k = 1
    while 2 * k <= w:
        x, k = least(x[:-k], x[k:]), 2 * k
    return least(x[: len(x) - (w - k)], x[w - k :]) if w > k else x


def anchors(raw: bytes):
    """Pieces of (places, hashes, context hashes, context starts and ends)."""
    for at in range(0, max(1, len(raw) - WINDOW + 1), PIECE - WINDOW + 1):
        data = np.frombuffer(raw[at : at + PIECE], np.uint8)
        n = len(data)
        if n < WINDOW:
            return
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * _UP[:n], out=sums[1:])
        grams = mix((sums[GRAM:] - sums[:-GRAM]) * _DOWN[: n - GRAM + 1])
        w = WINDOW - GRAM + 1
        least = _slide(grams, w, np.minimum)
        edge = np.zeros(w - 1, np.uint64)
        here = np.flatnonzero(grams == _slide(np.concatenate([edge, least, edge]), w, np.maximum))
        # contexts end where the document or the piece does
        lo, hi = np.maximum(here - EXTRA, 0), np.minimum(here + WINDOW, n)
        context = mix((sums[hi] - sums[lo]) * _DOWN[lo] + (here - lo).astype(np.uint64) * np.uint64(257) + (hi - here).astype(np.uint64))
        yield here + at, grams[here], context, lo + at, hi + at


def _slices(batches, rows: int = 1500):
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _anchored(batch) -> list[np.ndarray]:
    """Of a batch (d, tie, text): rows d, tie, place, hash, context, start, end, and the
    row of the batch."""
    d, tie = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
    parts = []
    for i, text in enumerate(batch.column(2).to_pylist()):
        for place, h, c, lo, hi in anchors((text or "").encode()):
            parts.append((np.full(len(place), d[i]), np.full(len(place), tie[i]), place, h, c, lo, hi, np.full(len(place), i)))
    if not parts:
        return [np.empty(0, np.uint64 if k in (3, 4) else np.int64) for k in range(8)]
    return [np.concatenate(x) for x in zip(*parts)]


def _has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & np.uint64(8 * len(bits) - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def bitmap(hashes: DataFrame, count: int) -> np.ndarray:
    """Of hash values (long): at least 32 bits for each, but 2^28 at most."""
    size = 1 << min(28, max(16, (32 * count).bit_length()))
    bit = F.col("h").bitwiseAND(F.lit(size - 1)) + 1  # Spark numbers bits from 1
    out = np.zeros(size // 8, np.uint8)
    for k, b in hashes.select(bit.alias("b")).groupBy(F.bitmap_bucket_number("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b"))).collect():
        out[(k - 1) * 4096 : k * 4096] = np.frombuffer(bytes(b), np.uint8)
    return out


def merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans in order of their starts to spans that don't touch."""
    if not len(lo):
        return lo, hi
    reach = np.maximum.accumulate(hi)
    first = np.flatnonzero(np.r_[True, lo[1:] > reach[:-1]])
    return lo[first], reach[np.r_[first[1:] - 1, len(lo) - 1]]


def split(rows: list[tuple], extra: int):
    """rows (left, right, d, tie, start, end of the shared part), windows of which need
    `extra` more bytes. Yields (what is shared, rows, extra): windows with the nearer half
    of the context on the left, and those without, which have the rest on the right."""
    half = (extra + 1) // 2
    rest = extra - half + 1
    sides: tuple[dict, dict] = ({}, {})
    for left, right, d, tie, a, b in rows:
        if len(left) >= half:
            sides[0].setdefault(left[-half:], []).append((left[:-half], right, d, tie, a - half, b))
        if len(right) >= rest:
            sides[1].setdefault(right[:rest], []).append((left, right[rest:], d, tie, a, b + rest))
    for side, need in zip(sides, (extra - half, extra - rest)):
        for key, own in side.items():
            yield key, own, need


class Solver:
    """Covered spans of groups of occurrences; groups are gathered for a suffix array."""

    def __init__(self, most: int = 30_000):
        self.most, self.spans, self.text, self.owner = most, [], [], []
        self.groups = 0

    def add(self, rows: list[tuple], extra: int) -> None:
        if len(rows) < 2:
            return
        # of equal contexts the earliest stands for all
        seen: dict[tuple[bytes, bytes], tuple] = {}
        for r in sorted(rows, key=lambda r: r[2:5]):
            key = (r[0][-extra:] if extra else b"", r[1][:extra])
            if (old := seen.setdefault(key, r)) is not r and old[2:5] != r[2:5]:
                a, b = r[4] - len(key[0]), r[5] + len(key[1])
                if b - a >= WINDOW:
                    self.spans.append((r[2], r[3], a, b))
        if len(seen) < 2:
            return
        if extra > STOP:
            for _, own, need in split([(k[0], k[1], *r[2:]) for k, r in seen.items()], extra):
                self.add(own, need)
            return
        for (left, right), r in seen.items():
            if len(left) + len(right) >= extra:
                self.owner += [(r[2], r[3], r[4] - len(left) + i, extra) for i in range(len(left) + 1)] + [None] * (len(right) + 1)
                self.text += [*left, 256 + self.groups, *right, -1]
        self.groups += 1
        if len(self.text) >= self.most:
            self.solve()

    def solve(self) -> None:
        """Runs of suffixes that share a window's symbols: equal windows."""
        text, owner = self.text, self.owner
        order = suffix_array(text)
        shared = common_prefixes(text, order)
        n, run, need = len(text), [], 0
        for k in range(n + 1):
            i = order[k] if k < n else -1
            if run and not (k < n and shared[k] >= need):
                if len(run) > 1:
                    first = min(run)
                    self.spans += [(d, t, a, a + WINDOW) for d, t, a in run if (d, t, a) != first]
                run = []
            # a window starts here if it holds the shared symbol and ends before the mark
            if k < n and (o := owner[i]) is not None:
                need = o[3] + 1
                if i + need <= n and -1 not in text[i : i + need]:
                    run.append(o[:3])
                    continue
            run = []
        self.text, self.owner, self.groups = [], [], 0

    def take(self):
        self.solve()
        out = sorted(self.spans)
        self.spans = []
        return out


def _span_batch(spans: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*spans)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["d", "tie", "lo", "hi"])


SPANS = "d long, tie long, lo long, hi long"
ROWS = "key long, extra int, left binary, right binary, d long, tie long, a long, b long"


def _solve(batches):
    """ROWS in order of key, d, tie and a to spans. A group without open context is only
    compared with its first row, so it may be of any size."""
    solver, now, first, rows, size = Solver(), None, None, [], 0
    for batch in batches:
        for key, extra, *r in zip(*(c.to_pylist() for c in batch.columns)):
            if key != now:
                if rows:
                    solver.add(rows, size)
                now, first, rows, size = key, r, [], extra
            if not extra:
                if r[2:5] != first[2:5]:
                    solver.spans.append((r[2], r[3], r[4], r[5]))
            else:
                rows.append(tuple(r))
        if len(solver.spans) > 50_000:
            yield _span_batch(solver.take())
    if rows:
        solver.add(rows, size)
    yield _span_batch(solver.take())


def _split_rows(batches):
    for batch in batches:
        out = []
        for key, extra, *r in zip(*(c.to_pylist() for c in batch.columns)):
            for k, side in enumerate(split([tuple(r)], extra)):
                part, own, need = side
                name = xxhash.xxh3_64_intdigest(key.to_bytes(8, "little", signed=True) + bytes([need == extra - (extra + 1) // 2 and own[0][4] != r[4]]) + part)
                out.append((name - (1 << 63), need, *own[0]))
        cols = list(zip(*out)) or [[]] * 8
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), *[pa.int64()] * 4)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["key", "extra", "left", "right", "d", "tie", "a", "b"])


def covered_spans(ws: Workspace, texts: DataFrame) -> DataFrame:
    """texts(d, tie, text) to spans (d, tie, lo, hi), not merged, to be removed."""
    context = ws.spark.sparkContext

    def count(batches):
        for batch in _slices(batches):
            h, n = np.unique(_anchored(batch)[3], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.minimum(n, 2).astype(np.int32))], names=["h", "n"])

    repeated = ws.write(texts.mapInArrow(count, "h long, n int").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h"), "repeated")
    known = context.broadcast(bitmap(repeated, repeated.count()))

    def occurrences(batches):
        for batch in _slices(batches):
            rows = _anchored(batch)
            keep = _has(known.value, rows[3])
            d, tie, place, h, c, lo, hi, i = (x[keep] for x in rows)
            order = np.lexsort((place, tie, d, c, h))
            d, tie, place, h, c, lo, hi, i = (x[order] for x in (d, tie, place, h, c, lo, hi, i))
            first = np.ones(len(h), bool)
            first[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
            start = np.maximum.accumulate(np.where(first, np.arange(len(h)), 0)) if len(h) else np.empty(0, np.int64)
            later = ~first & ((d != d[start]) | (tie != tie[start]) | (place != place[start]))
            # spans of each row of the batch, merged
            own = np.flatnonzero(later)
            own = own[np.lexsort((lo[own], i[own]))]
            step = i[own] * np.int64(1 << 40)
            a, b = merged(lo[own] + step, hi[own] + step)
            row = a >> 40
            n, m = int(first.sum()), len(a)
            ids = [batch.column(k).to_numpy(zero_copy_only=False)[row] for k in range(2)]
            cols = [np.r_[x[first], y] for x, y in ((h.view(np.int64), np.zeros(m, np.int64)), (c.view(np.int64), np.zeros(m, np.int64)), (d, ids[0]), (tie, ids[1]), (place, np.full(m, -1)), (lo, a & ((1 << 40) - 1)), (hi, b & ((1 << 40) - 1)))]
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in cols], names=["h", "c", "d", "tie", "place", "lo", "hi"])

    marks = ws.write(texts.mapInArrow(occurrences, "h long, c long, d long, tie long, place long, lo long, hi long"), "marks")
    met = marks.where("place >= 0")
    rank = F.rank().over(Window.partitionBy("h", "c").orderBy("d", "tie", "place"))
    whole = met.withColumn("rank", rank).where("rank > 1").select("d", "tie", "lo", "hi")
    spans = [ws.write(whole.unionByName(marks.where("place < 0").select("d", "tie", "lo", "hi")), "whole")]
    mixed = ws.write(met.groupBy("h").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x <> y").select("h"), "mixed")
    ws.drop("marks")
    differ = context.broadcast(bitmap(mixed, mixed.count()))

    def contexts(batches):
        for batch in _slices(batches):
            rows = _anchored(batch)
            keep = np.flatnonzero(_has(differ.value, rows[3]))
            keep = keep[np.lexsort((rows[2][keep], rows[1][keep], rows[0][keep], rows[4][keep], rows[3][keep]))]
            h, c = rows[3][keep], rows[4][keep]
            keep = keep[np.r_[np.ones(min(1, len(h)), bool), (h[1:] != h[:-1]) | (c[1:] != c[:-1])]]
            keep = keep[np.argsort(rows[7][keep], kind="stable")]
            d, tie, place, h, _, lo, hi, i = (x[keep] for x in rows)
            left, right, now, raw = [], [], -1, b""
            texts = batch.column(2)
            for k in range(len(keep)):
                if i[k] != now:
                    now, raw = i[k], (texts[int(i[k])].as_py() or "").encode()
                left.append(raw[lo[k] : place[k]])
                right.append(raw[place[k] + GRAM : hi[k]])
            cols = (pa.array(h.view(np.int64)), pa.array(np.full(len(h), EXTRA, np.int32)), pa.array(left, pa.binary()), pa.array(right, pa.binary()), pa.array(d), pa.array(tie), pa.array(place), pa.array(place + GRAM))
            yield pa.RecordBatch.from_arrays(list(cols), names=["key", "extra", "left", "right", "d", "tie", "a", "b"])

    rows = ws.write(texts.mapInArrow(contexts, ROWS).join(mixed.withColumnRenamed("h", "key"), "key", "left_semi"), "contexts0")
    for level in range(1, 10):
        large = ws.write(rows.where("extra > 0").groupBy("key").count().where(F.col("count") > LIMIT).select("key"), f"large{level}")
        some = large.count() > 0
        small = rows.join(large, "key", "left_anti") if some else rows
        small = small.repartition("key").sortWithinPartitions("key", "d", "tie", "a")
        spans.append(ws.write(small.mapInArrow(_solve, SPANS), f"spans{level}"))
        if not some:
            break
        rows = ws.write(rows.join(large, "key", "left_semi").mapInArrow(_split_rows, ROWS), f"contexts{level}")
    out = spans[0]
    for s in spans[1:]:
        out = out.unionByName(s)
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the bytes that are left)."""
    ws = Workspace(docs.sparkSession)
    texts = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(_FIRST)).alias("d"),
        F.xxhash64(text_col).alias("tie"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    spans = covered_spans(ws, texts.select("d", "tie", "text"))
    held = spans.groupBy(F.col("d").alias("sd"), F.col("tie").alias("st")).agg(F.collect_list(F.struct("lo", "hi")).alias("s"))
    joined = texts.join(held, (F.col("d") == F.col("sd")) & (F.col("tie") == F.col("st")), "left").select("doc_id", "text", F.col("s.lo").alias("lo"), F.col("s.hi").alias("hi"))

    def cut(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                out = []
                for text, lo, hi in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                    raw, a, b = text.encode(), np.array(lo or [], np.int64), np.array(hi or [], np.int64)
                    order = np.argsort(a, kind="stable")
                    a, b = merged(a[order], b[order])
                    kept = b"".join(raw[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(raw)]))
                    out.append((len(raw), len(raw) - len(kept), len(a), kept))
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def op9_grouped_suffix_array(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
