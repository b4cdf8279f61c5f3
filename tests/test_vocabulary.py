import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmill.operators import language, vocabulary

TEXTS = st.lists(st.one_of(st.none(), st.text("abé ñx", max_size=60)), max_size=8)


@given(TEXTS, st.lists(st.text("abé ñx", max_size=5), min_size=1, max_size=12))
@settings(max_examples=150, deadline=None)
def test_words(texts, words):
    pairs = [(f"l{k % 3}", w) for k, w in enumerate(sorted(set(words)))]
    got = vocabulary.Vocabulary(pairs, plain=True).count(texts)
    for text, found in zip(texts, got):
        want = {}
        for x, w in pairs:
            if text is not None and w in text:
                want[x] = want.get(x, 0) + 1
        assert found == want


def test_stretches_meet(monkeypatch):
    """Words across the ends of stretches, texts longer than a slice, and words longer than
    what enters the automaton."""
    monkeypatch.setattr(vocabulary, "STRETCH", 8)
    monkeypatch.setattr(vocabulary, "SLICE", 700)
    r = random.Random(1)
    words = ["".join(r.choice("ab") for _ in range(r.randint(1, 9))) for _ in range(40)] + ["a" * 70, "b" * 64 + "a"]
    texts = ["".join(r.choice("ab") for _ in range(r.choice([3, 50, 2000]))) for _ in range(30)] + ["a" * 69, "b" * 65, "b" * 64 + "a", ""]
    pairs = [(w, w) for w in sorted(set(words))]
    got = vocabulary.Vocabulary(pairs, plain=True).count(texts)
    assert [sorted(x) for x in got] == [sorted(w for w, _ in pairs if w in t) for t in texts]


@pytest.mark.parametrize(
    ("pattern", "want"),
    [
        ("abc", ("abc", True)), (r"neuropat\w+", ("neuropat", False)), (r"guillain[- ]barr\w+", ("guillain", False)), (r"a\.b", ("a.b", True)), ("colou?r", ("colo", False)), ("ab+c", ("ab", False)), ("x|y", ("", False)),
        ("(ab|c)d{2}ef", ("ef", False)), (r"[^]a]xy", ("xy", False)), ("", ("", True)), (r"\bword\b", ("word", False)), ("a{0,3}bc", ("bc", False)), (r"(a\)(b))z", ("z", False)),
    ],
)
def test_literal(pattern, want):
    assert vocabulary.literal(pattern) == want


def test_literals_are_in_all_matches():
    samples = ["neuropatía", "guillain-barré", "metaanálisis", "unión neuromuscular", "charcot marie", "esclerosis  lateral amiotrófica", "motor\nneuron", "deterioro cognitivo", "pronóstico"]
    for patterns in language.TAXONOMY.values():
        for p in patterns:
            for s in samples:
                if m := re.search(p, s):
                    assert vocabulary.literal(p)[0] in m[0]


def test_same_tags_and_routes_as_by_expressions(spark, data):
    from pyspark.sql import functions as F

    samples = ["Neuropatía y EMG", "guillain-barré", "METAANÁLISIS de la unión neuromuscular", None, "", "la luz del plan .sd", "negocio y costo, paciente"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(samples)], "id int, t string")
    tags = spark.createDataFrame([(x, p) for x, ps in language.TAXONOMY.items() for p in ps], "tag string, pattern string")
    found = vocabulary.labelled(rows, F.lower("t"), tags, "tag", "pattern")
    same = found.select("id", F.array_join("found.label", ",").alias("a"), F.array_join(F.coalesce(language.tags(F.col("t"), language.TAXONOMY), F.array()), ",").alias("b"))
    assert [r["a"] for r in same.orderBy("id").collect()] == [r["b"] for r in same.orderBy("id").collect()]
    words = spark.createDataFrame([(x, w) for x, ws in language.KEYWORDS.items() for w in ws], "agent string, word string")
    found = vocabulary.labelled(rows, F.lower("t"), words, "agent", "word", plain=True)
    for r in found.select(vocabulary.route(F.col("found"), "research").alias("a"), language.route(F.coalesce("t", F.lit("")), language.KEYWORDS, "research").alias("b")).collect():
        assert r["a"] == r["b"]


def test_vocabulary_in_parts(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(vocabulary, "TABLE", 4 * 256 * 6)
    rows = spark.createDataFrame([(1, "ab bc cd", "old"), (2, None, "old"), (3, "", "old")], "id int, t string, found string")
    words = spark.createDataFrame([("x", "ab"), ("x", "cd"), ("y", "bc"), ("z", "zz"), ("x", "ab"), (None, "ab"), ("w", None)], "l string, w string")
    assert len(vocabulary._parts(words, "l", "w")) == 2
    got = vocabulary.labelled(rows, F.col("t"), words, "l", "w", plain=True)
    assert [(r["id"], [tuple(x) for x in r["found"]]) for r in got.orderBy("id").collect()] == [(1, [("x", 2), ("y", 1)]), (2, []), (3, [])]
    assert [r["found"] for r in vocabulary.labelled(rows, F.col("t"), words.limit(0), "l", "w").collect()] == [[], [], []]
    assert np.all([r["t"] in ("ab bc cd", None, "") for r in got.collect()])


def test_memory_does_not_grow_with_a_batch(spark, monkeypatch):
    """A worker holds a slice of texts and what is found in them, however many rows a batch
    has, and Spark makes batches of few rows."""
    import tracemalloc

    import pyarrow as pa
    from pyspark.sql import functions as F

    runs = []
    kind = type(spark.range(0))
    real = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, f, *args, **kwargs: (runs.append(f), real(self, f, *args, **kwargs))[1])
    words = spark.createDataFrame([(f"l{k % 5}", f"w{k}") for k in range(90)], "l string, w string")
    rows = spark.createDataFrame([(1, "w1 w2 w6")], "id int, t string")
    kept = vocabulary.labelled(rows, F.col("t"), words, "l", "w", plain=True)
    assert [tuple(x) for x in kept.first()["found"]] == [("l1", 2), ("l2", 1)]
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
    kind_of = pa.list_(pa.struct([("label", pa.string()), ("n", pa.int32())]))
    peaks = []
    for n in (1500, 12000):
        texts = [" ".join(f"w{(k + j) % 90}" for j in range(40)) for k in range(n)]
        batch = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array(texts), pa.nulls(n, kind_of), pa.array(texts)], names=["id", "t", "found", "__text"])
        seen = 0
        tracemalloc.start()
        for out in runs[0](iter([batch])):
            seen += out.num_rows
            last = out.column(2)[-1].as_py()
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert seen == n and last == [{"label": f"l{x}", "n": m} for x, m in sorted({x: sum(f"w{k}" in texts[-1] for k in range(x, 90, 5)) for x in range(5)}.items())]
    assert peaks[1] < 1.5 * peaks[0], peaks
