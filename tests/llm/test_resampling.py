import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmill.llm import resampling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, least, most):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(w), [" ".join(w[i : i + n]) for n in range(least, most + 1) for i in range(len(w) - n + 1)]


def brute(docs, target, least=1, most=1, buckets=10_000, words=20, percent=10):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    found = [(i, *features(t, least, most)) for i, t in docs]
    s, t = Counter(bucket(g) for _, _, f in found for g in f), Counter(bucket(g) for x in target for g in features(x, least, most)[1])
    big_s, big_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * big_s / ((s[b] + 1) * big_t)))
    out = []
    for i, n, f in found:
        w = sum(gain(bucket(g)) for g in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    drawn = sorted((r for r in out if r[5] >= words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(drawn[: percent * len(drawn) // 100]):
        r[4] = k + 1
    return out


def same(rows, want):
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted((tuple(r) for r in rows), key=key) == sorted((tuple(r[:5]) for r in want), key=key)


@given(st.lists(st.binary(max_size=80), max_size=12), st.integers(0, 1 << 32))
@settings(max_examples=60, deadline=None)
def test_shift(parts, seed):
    a = np.array([zlib.crc32(p) for p in parts], np.uint32)
    b = [random.Random(seed + k).randbytes(random.Random(seed - k).randint(0, 3000)) for k in range(len(parts))]
    joined = resampling.Shift()(a, np.array([len(x) for x in b], np.int64)) ^ np.array([zlib.crc32(x) for x in b], np.uint32)
    assert joined.tolist() == [zlib.crc32(p + x) for p, x in zip(parts, b)]


@given(st.lists(st.one_of(st.none(), st.text(max_size=60), st.just("x" * 500 + " y" * 40 + "Z")), max_size=8), st.integers(1, 2), st.integers(0, 2))
@settings(max_examples=80, deadline=None)
def test_features(texts, least, more):
    found, n = resampling.Features(997, least, least + more).of(pa.array(texts, pa.string()))
    want = [features(t, least, least + more) for t in texts]
    assert n.tolist() == [w for w, _ in want]
    for k in range(len(texts)):
        got = Counter(b for bucket, begins in found for b in bucket[begins[k] : begins[k + 1]].tolist())
        assert got == Counter(zlib.crc32(g.encode()) % 997 for g in want[k][1])


@pytest.mark.parametrize("ngrams", [(1, 1), (1, 3), (2, 2)])
def test_edge_rows(spark, edge, ngrams):
    target = spark.createDataFrame([("kaba lode mifi one two three",), (None,), ("",)], "text string")
    rows = resampling.resample(edge, target, ngrams=ngrams, percent=50, least_words=3)
    assert rows.columns == ["doc_id", "n_words", "n_features", "weight", "score", "eligible", "rank"]
    want = brute([(r["doc_id"], r["text"]) for r in edge.collect()], ["kaba lode mifi one two three", None, ""], *ngrams, words=3, percent=50)
    same(rows.select("doc_id", "n_features", "weight", "score", "rank").collect(), want)


def test_without_rows(spark, edge, empty):
    target = spark.createDataFrame([("a b",)], "text string")
    assert resampling.resample(empty, target).collect() == []
    rows = resampling.resample(edge, target.limit(0), least_words=10**6).collect()
    assert len(rows) == edge.count() and all(r["rank"] is None for r in rows)


def test_repeated_rows_are_drawn_one_by_one(spark):
    docs = spark.createDataFrame([(7, "a b c " * 10)] * 300 + [(None, "a b c " * 10)] * 100 + [(k, f"w{k} " * 30) for k in range(100)], "doc_id long, text string")
    ranks = [r["rank"] for r in resampling.resample(docs, docs, percent=90).collect() if r["rank"]]
    assert sorted(ranks) == list(range(1, 451))


def test_query(spark, data):
    docs = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    target = [r[0] for r in spark.read.parquet(f"{data}/benchmark.parquet").select("text").collect()]
    rows = resampling.op11_crc_resampling(spark, data)
    assert [c[1] for c in rows.dtypes] == ["bigint"] * 5
    same(rows.collect(), brute(docs, target))
