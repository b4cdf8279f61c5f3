import hashlib
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F
from quillmill.llm import bpe, registry


def test_queries_have_names():
    assert sorted(int(q[2:].split("_")[0]) for q in registry.QUERIES) == list(range(1, len(registry.QUERIES) + 1))
    assert set(registry.SQL) <= set(registry.QUERIES)


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, rows = rows, stage(spark, rows, data).cache()
        if k < 4:
            assert rows.columns == docs.columns and 0 < rows.count(), name
        if k < 3:
            ids = Counter(r["doc_id"] for r in rows.collect())
            assert max(ids.values()) == 1 and ids.keys() <= {r["doc_id"] for r in before.collect()}
    whole = {i: hashlib.sha256(t.encode()).hexdigest() for i, t in texts.items()}
    got = rows.collect()
    assert sum(r["decoded_sha256"] != whole[r["doc_id"]] for r in got) == 0
    assert all(len(r["ids"]) == r["n_tokens"] for r in got)


def test_exact_and_near_stages(spark, data):
    base = " ".join(f"w{k}" for k in range(80))
    docs = spark.createDataFrame([(1, base, "en", "s", 1), (2, base.upper(), "en", "s", 1), (3, base + " more", "en", "s", 1), (4, "other words " * 30, "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    exact = corpus_pipeline.exact(spark, docs, data)
    assert sorted(r["doc_id"] for r in exact.collect()) == [2, 3, 4]
    assert sorted(r["doc_id"] for r in corpus_pipeline.near(spark, exact, data).collect()) == [2, 4]


def test_empty(spark, data):
    rows = spark.read.parquet(f"{data}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, data)
        assert rows.collect() == []


def test_encode_keeps_clashing_names(spark):
    import public_tokenizers as P

    df = spark.createDataFrame([(1, "a b", "old")], "doc_id long, text string, ids string")
    assert bpe.encode(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).first()["ids"] == [64, 275]


def test_stages_on_edge_rows(spark, edge, data):
    """Nulls, repeated rows, long texts, and columns named like the operators' own."""
    docs = edge.withColumns({"kept": F.lit("k"), "predicted": F.lit("p"), "group_size": F.lit(-1)})
    given = Counter(docs.collect())
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        rows = stage(spark, docs, data)
        assert rows.schema.names == docs.columns
        kept[name] = rows.collect()
        assert set(kept[name]) <= set(given), name  # each row with all its values
    lower = lambda t: (t or "").encode().lower()
    exact = kept["exact dedup"]
    assert sorted(lower(r["text"]) for r in exact) == sorted({lower(r["text"]) for r in given})
    near = {(r["doc_id"], r["text"]) for r in kept["n-gram Jaccard join"]}
    assert {r["doc_id"] for r in kept["n-gram Jaccard join"]} >= {-5, 5, 6, 7, 8, 14, 15, None} and not near & {(r["doc_id"], r["text"]) for r in given if r["doc_id"] in (1, 2, 3, 4, 10, 11)}
    mixed = Counter(kept["mixing sources to target weights"])
    assert all(r["text"] and r["text"].split() for r in mixed) and max(mixed.values()) <= 2 * max(given.values())
    coded = corpus_pipeline.encode(spark, docs, data).collect()
    assert sorted(r["decoded_sha256"] for r in coded) == sorted(hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in given.elements())
