import hashlib
import re
from collections import Counter, defaultdict

import pytest

from quillmill.llm import exact_dedup, mixing

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fill(sizes: dict, ratio=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    budget, capped = ratio * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        if not free:
            return {s: most * sizes[s] for s in names}
        level = (budget - sum(most * sizes[s] for s in capped)) / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in capped else weight[s] * level for s in names}
        capped |= over


def test_mix(edge):
    rows = mixing.mix(edge).collect()
    texts = [(r["doc_id"], r["text"], r["source"]) for r in edge.collect()]
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for _, t, s in texts:
        sizes[s] += size(t)
    want = fill(sizes)
    assert Counter((r["doc_id"], r["size"], r["source"]) for r in rows) == Counter((i, size(t), s) for i, t, s in texts)
    taken = defaultdict(int)
    for r in rows:
        assert abs(r["target"] - want[r["source"]]) < 1e-6 and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in sizes)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(edge).collect()))
    small = mixing.mix(edge, bucket_rows=2).groupBy("source").sum("taken").collect()
    assert {r[0]: r[1] for r in small} == dict(taken)


def test_repeat_gives_whole_rows(edge):
    out = mixing.repeat(edge)
    assert out.columns == edge.columns
    words = out.selectExpr("sum(size(split(trim(text), '[ ]+')))").first()[0]
    assert words > 0


def test_mix_without_rows(empty):
    assert mixing.mix(empty).collect() == [] and mixing.repeat(empty).collect() == []


@pytest.mark.parametrize("hot", [1000, 1])
def test_exact(edge, hot):
    rows = exact_dedup.exact_dedup(edge, hot_rows=hot).collect()
    groups = defaultdict(list)
    for r in edge.collect():
        groups[(r["text"] or "").translate(LOWER)].append(r["doc_id"])
    assert len(rows) == edge.count()
    kept = Counter()
    for r in rows:
        norm = (r["text"] or "").translate(LOWER)
        ids = [i for i in groups[norm] if i is not None]
        assert r["keep_id"] == (max(ids) if ids else None) and r["group_size"] == len(groups[norm])
        assert r["text_sha256"] == hashlib.sha256(norm.encode()).hexdigest()
        kept[norm] += r["kept"]
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert set(kept.values()) == {1}


def test_exact_smallest_and_empty(edge, empty):
    rows = exact_dedup.exact_dedup(edge, keep="smallest").where("text = 'one two three'").collect()
    assert {(r["doc_id"], r["kept"]) for r in rows} == {(9, True), (10, False)}
    assert exact_dedup.exact_dedup(empty).collect() == []


def test_many_copies_are_spread(spark):
    df = spark.range(4000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'Hot text' ELSE concat('t', id) END AS text")
    rows = exact_dedup.exact_dedup(df, hot_rows=10).where("kept").collect()
    assert len(rows) == 2667 and [r["doc_id"] for r in rows if r["group_size"] > 1] == [3999]


def test_repeat_never_cuts_a_text(spark):
    """One source of one long document, whose target is below its size, beside others."""
    rows = [(1, " \n".join(f"w{k}" for k in range(20000)), "b"), *[(k, f"a {k}  b", "a") for k in range(2, 3000)], *[(k, f"c\t{k}", "c") for k in range(3000, 9000)]]
    docs = spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, source string, n_chars int")
    options = {"budget_ratio": 0.6}
    taken = {r["doc_id"]: (r["taken"], r["size"]) for r in mixing.mix(docs, **options).collect()}
    assert 0 < taken[1][0] < taken[1][1]
    out = mixing.repeat(docs, **options).collect()
    whole = {r[0]: r[1] for r in rows}
    assert all(r["text"] == whole[r["doc_id"]] and r["n_chars"] == len(r["text"]) for r in out)
    assert 1 in {r["doc_id"] for r in out}
