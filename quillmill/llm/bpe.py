"""Byte-level BPE with a two-tier lookup, and decoding.

First tier: a minimal perfect hash over the vocabulary (hash and displace: each bucket of
keys has a displacement that sends its keys to free slots; as many slots as keys) tells
the id of a pre-token that is a vocabulary entry. Second tier, for the others: bytes in a
doubly linked list, and a heap of adjacent pairs by rank, then place; stale heap entries
are skipped. Pair ranks come from the same hash. Pieces of text seen before are taken
from a bounded memo.

The table is built once on the driver and broadcast; its size is that of the vocabulary
file. Defined results: null and empty texts have no ids and decode to no bytes; a text of
any length, and a pre-token of any length, is encoded whole (a pre-token of n bytes takes
n log n steps). Row order and repeated rows don't matter: each row is encoded alone. Of
columns named like those that are added, the added ones are kept.
Lone surrogates can't occur in Spark strings. Bytes that are not UTF-8 come back from
decoding as bytes.
"""

from __future__ import annotations

import base64
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.llm.common import ready, slices
from quillmill.llm.segments import PATTERN, Memo, pack


class PerfectHash:
    """bytes -> place of the key in `keys`, or -1. As many slots as keys."""

    def __init__(self, keys: list[bytes], load: int = 4, tries: int = 4096):
        if len(set(keys)) != len(keys):
            raise ValueError("keys must be distinct")
        # keys of a bucket whose hashes agree in all parts need another seed
        for seed in range(64):
            if self._build(keys, load, tries, seed):
                return
        raise ValueError("no displacement found")

    def _build(self, keys: list[bytes], load: int, tries: int, seed: int) -> bool:
        n, self.seed = len(keys), seed
        self.n, self.buckets = n, max(1, n // load)
        hashes = np.array([xxhash.xxh3_64_intdigest(k, seed) for k in keys], dtype=np.uint64)
        b, f, g = (hashes % np.uint64(self.buckets)).astype(np.int64), ((hashes >> np.uint64(20)) % np.uint64(max(n, 1))).astype(np.int64), ((hashes >> np.uint64(41)) % np.uint64(max(n, 1))).astype(np.int64)
        order = np.argsort(b, kind="stable")
        starts = np.searchsorted(b[order], np.arange(self.buckets + 1))
        free, self.move, slot_of = np.ones(n, bool), np.zeros((self.buckets, 2), np.int64), np.zeros(n, np.int64)
        for k in np.argsort(starts[:-1] - starts[1:], kind="stable"):
            own = order[starts[k] : starts[k + 1]]
            if not len(own):
                break
            if len({*zip(f[own].tolist(), g[own].tolist())}) < len(own):
                return False
            for t0 in chain([0], range(64, n * n + tries, tries)):
                t = np.arange(t0, t0 + tries if t0 else 64)
                d, e = (t % n, (t // n) % n) if len(own) == 1 else (t // 61, t % 61 + (t // 61) * 7)
                slots = (f[own] + g[own] * e[:, None] + d[:, None]) % n
                good = free[slots].all(1)
                if len(own) > 1:
                    good &= (np.diff(np.sort(slots, 1), axis=1) > 0).all(1)
                if good.any():
                    i = int(good.argmax())
                    self.move[k], slot_of[own] = (d[i], e[i]), slots[i]
                    free[slots[i]] = False
                    break
            else:
                return False
        self.slots: list[tuple[bytes, int]] = [(b"", -1)] * n
        for i, s in enumerate(slot_of.tolist()):
            self.slots[s] = (keys[i], i)
        self.moves = [tuple(x) for x in self.move.tolist()]
        del self.move
        return True

    def find(self, key: bytes) -> int:
        if not self.n:
            return -1
        h, n = xxhash.xxh3_64_intdigest(key, self.seed), self.n
        d, e = self.moves[h % self.buckets]
        found, place = self.slots[((h >> 20) % n + ((h >> 41) % n) * e + d) % n]
        return place if found == key else -1


class ByteBpe:
    """Encodes as the rank file says: `tokens` in the order of their ranks."""

    def __init__(self, tokens: list[bytes], ids: list[int], pattern: str, table: PerfectHash | None = None):
        self.hash, self.ids = table or PerfectHash(tokens), ids
        self.tokens, self.split = dict(zip(ids, tokens)), regex.compile(pattern)
        self.single = [self.lookup(bytes([i])) for i in range(256)]
        self.pairs: dict[int, int] = {}
        self.memo, self.flat = Memo(self.encode_many, pieces=pattern == PATTERN), None

    def __reduce__(self):
        """What is sent to workers: the tables, not the memos."""
        return ByteBpe, (list(self.tokens.values()), self.ids, self.split.pattern, self.hash)

    def lookup(self, token: bytes) -> int:
        place = self.hash.find(token)
        return -1 if place < 0 else self.ids[place]

    def pair(self, a: int, b: int) -> int:
        """The rank of two tokens together, or -1; known ones are kept."""
        key = a << 32 | b
        if (found := self.pairs.get(key)) is None:
            if len(self.pairs) >= 200_000:
                self.pairs.clear()
            found = self.pairs[key] = self.lookup(self.tokens[a] + self.tokens[b])
        return found

    def merge(self, token: bytes) -> list[int]:
        single, get, pair = self.single, self.pairs.get, self.pair
        part = [single[x] for x in token]
        n = len(part)
        rank = []
        for i in range(n - 1):
            r = get(part[i] << 32 | part[i + 1])
            rank.append(pair(part[i], part[i + 1]) if r is None else r)
        rank.append(-1)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [r * n + i for i, r in enumerate(rank) if r >= 0]  # by rank, then place
        heapify(heap)
        while heap:
            r, i = divmod(heappop(heap), n)
            if rank[i] != r:
                continue
            j = after[i]
            k = after[i] = after[j]
            part[i], part[j], rank[i], rank[j] = r, -1, -1, -1
            if k < n:
                before[k] = i
                if (q := get(r << 32 | part[k])) is None:
                    q = pair(r, part[k])
                if q >= 0:
                    rank[i] = q
                    heappush(heap, q * n + i)
            if (h := before[i]) >= 0:
                if (q := get(part[h] << 32 | r)) is None:
                    q = pair(part[h], r)
                rank[h] = q
                if q >= 0:
                    heappush(heap, q * n + h)
        return [x for x in part if x >= 0]

    def encode_token(self, token: str) -> list[int]:
        raw = token.encode()
        return [i] if (i := self.lookup(raw)) >= 0 else self.merge(raw)

    def encode_plain(self, text: str) -> list[int]:
        return [i for token in self.split.findall(text) for i in self.encode_token(token)]

    def encode_many(self, texts: list[str], pure: bool) -> list[bytes]:
        one = self.encode_token if pure else self.encode_plain
        return [pack(one(t)) for t in texts]

    def encode(self, text: str | None) -> list[int]:
        return self.memo.ids(text)

    def decode(self, ids) -> bytes:
        return self.decode_flat(np.asarray(ids, np.int64))[0].tobytes()

    def decode_flat(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids one after another, and where each id's end."""
        if self.flat is None:
            starts, sizes = np.zeros((2, max(self.tokens) + 1), np.int64)
            at = 0
            for i, token in self.tokens.items():
                starts[i], sizes[i], at = at, len(token), at + len(token)
            self.flat = np.frombuffer(b"".join(self.tokens.values()), np.uint8), starts, sizes
        data, starts, sizes = self.flat
        size = sizes[ids]
        if len(ids) and (ids.min() < 0 or not size.all()):
            raise ValueError("an id is not in the vocabulary")
        ends = np.cumsum(size)
        place = np.repeat(starts[ids] - (ends - size), size)
        place += np.arange(len(place))
        return data[place], ends

    def decode_lists(self, flat: np.ndarray, ends: np.ndarray) -> pa.Array:
        """Binary values of lists of ids that end where `ends` (from 0) says."""
        data, after = self.decode_flat(flat)
        offsets = np.r_[0, after][ends].astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def load_ranks(path: str, pattern: str) -> tuple[list[bytes], list[int], str]:
    with open(path, "rb") as f:
        pairs = sorted((int(r), base64.b64decode(t)) for t, r in map(bytes.split, filter(bytes.strip, f)))
    return [t for _, t in pairs], [r for r, _ in pairs], pattern


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", decode: bool = False) -> DataFrame:
    """The other columns of `docs` with ids array<int>, and with `decode` the bytes that
    decode() makes of them, as `decoded`."""
    spark = docs.sparkSession
    ready(spark)
    table = spark.sparkContext.broadcast(ByteBpe(*load_ranks(path, pattern)))
    rest = [c for c in docs.columns if c not in (text_col, "ids", "decoded")]
    docs = docs.select(*rest, F.col(text_col).alias("__text"))
    kept = len(rest)

    def run(batches):
        coder = table.value
        for whole in batches:
            for batch in slices(whole, kept):
                ids = coder.memo.lists(batch.column(kept))
                cols = [*batch.columns[:kept], ids]
                if decode:
                    cols.append(coder.decode_lists(ids.values.to_numpy(), ids.offsets.to_numpy()))
                yield pa.RecordBatch.from_arrays(cols, names=[*rest, "ids", *["decoded"] * decode])

    added = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())]
    return docs.mapInArrow(run, T.StructType([*docs.select(*rest).schema.fields, *added[: 1 + decode]]))


def decode(rows: DataFrame, path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """The columns of `rows` with decoded binary; null ids decode to no bytes."""
    spark = rows.sparkSession
    ready(spark)
    table = spark.sparkContext.broadcast(ByteBpe(*load_ranks(path, pattern)))
    at, names = rows.columns.index(ids_col), [*[c for c in rows.columns if c != "decoded"], "decoded"]
    rows = rows.drop("decoded")

    def run(batches):
        coder = table.value
        for batch in batches:
            out = pa.array([coder.decode(x or []) for x in batch.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], names=names)

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("decoded", T.BinaryType())]))


def op4_two_tier_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as vocabularies

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = encode(docs, vocabularies.path("byte_bpe_50k.tiktoken"), vocabularies.PATTERN, decode=True)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
