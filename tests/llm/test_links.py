import hashlib
import os
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmill.llm import ann, jaccard, repeats
from quillmill.llm.common import Workspace
from quillmill.llm.components import components
from quillmill.llm.suffix_array import common_prefixes, suffix_array

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(docs):
    sets, parent = [shingle_set(t) for _, t in docs], list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(docs):
        if i is not None:
            least[find(k)].append(i)
    return [(len(sets[k]), (min(least[find(k)]) if least[find(k)] else None) if sets[k] else docs[k][0]) for k in range(len(docs))]


def test_jaccard(spark, edge, empty, monkeypatch):
    docs = [(r["doc_id"], r["text"]) for r in edge.collect()]
    want = Counter((i, *x) for (i, _), x in zip(docs, brute_components(docs)))
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(edge).collect())
    assert got == want
    kept = [r["doc_id"] for r in jaccard.keep_one(edge).collect()]
    assert -5 in kept and not {1, 2, 3, 4} & set(kept) and {5, 6, 7, 8} <= set(kept)
    assert jaccard.jaccard_components(empty).collect() == []


def test_large_group_of_near_copies_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK", 7)
    base = [f"w{k}" for k in range(100)]
    rows = [(k, " ".join([*base[: k % 90], f"x{k}", *base[k % 90 + 1 :]])) for k in range(120)] + [(500 + k, f"alone {k} " * 20) for k in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(df).collect()}
    assert [got[i] for i, _ in rows] == [c for _, c in brute_components(rows)]


@settings(max_examples=40, deadline=None)
@given(seed=st.integers(0, 10**6))
def test_tree_finds_what_all_pairs_find(seed):
    r = np.random.default_rng(seed)
    pool = r.integers(1, 2**63, 60, dtype=np.uint64)
    sets = sorted((np.unique(r.choice(pool, r.integers(1, 60))) for _ in range(70)), key=len)
    tree = jaccard.Tree(sets, np.arange(70))
    tree.join()
    root = np.arange(70)
    for a in range(70):
        for b in range(a):
            i = len(np.intersect1d(sets[a], sets[b]))
            if 100 * i >= 80 * (len(sets[a]) + len(sets[b]) - i):
                root[root == max(root[a], root[b])] = min(root[a], root[b])
    assert (tree.root == root).all()


def test_components(spark):
    links = [(f"{a:03}", f"{b:03}") for a, b in [*((k, k + 1) for k in range(40)), (50, 60), (60, 70), (70, 50), (80, 80)]]
    got = components(Workspace(spark), spark.createDataFrame(links, "a string, b string"), "t").collect()
    want = {f"{k:03}": "000" for k in range(41)} | {x: "050" for x in ("050", "060", "070")}
    assert {r["node"]: r["root"] for r in got} == want and len(got) == len(want)


@settings(max_examples=300, deadline=None)
@given(text=st.lists(st.integers(0, 3), max_size=60))
def test_suffix_array(text):
    order = sorted(range(len(text)), key=lambda i: text[i:])
    assert suffix_array(text) == order
    for k, n in enumerate(common_prefixes(text, order)):
        if k:
            a, b = text[order[k - 1] :], text[order[k] :]
            assert a[:n] == b[:n] and (len(a) == n or a[n : n + 1] != b[n : n + 1])


def brute_removed(docs):
    """docs in order; rows that agree are one document."""
    seen, out = set(), {}
    for key, raw in docs:
        cover = np.zeros(len(raw), bool)
        for k in range(len(raw) - 99):
            w = raw[k : k + 100]
            if w in seen:
                cover[k : k + 100] = True
            seen.add(w)
        out[key] = (len(raw), int(cover.sum()), int((np.diff(np.r_[0, cover.astype(int)]) == 1).sum()), bytes(np.frombuffer(raw, np.uint8)[~cover]))
    return out


@pytest.mark.parametrize("limit", [20000, 3])
def test_repeats(spark, edge, empty, monkeypatch, limit):
    monkeypatch.setattr(repeats, "LIMIT", limit)
    passage = " ".join(f"common{k}" for k in range(18))
    more = [(100 + k, f"start {k} " + passage[k % 7 :] + f" end of text {k} " * 9, *[None] * 10) for k in range(40)]
    # ids that occur once: the order of rows that share an id is by a hash
    rows = edge.where("doc_id IS NOT NULL AND doc_id NOT IN (12, 13)").unionByName(spark.createDataFrame(more, edge.schema))
    docs = sorted((r["doc_id"], (r["text"] or "").encode()) for r in rows.collect())
    want = brute_removed(docs)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in repeats.remove_repeats(rows).collect()}
    assert got == want
    assert sum(x[1] for x in got.values()) > 3000
    assert repeats.remove_repeats(empty).collect() == []


def test_rows_that_agree_lose_alike(spark):
    t = "".join(hashlib.sha256(bytes([k])).hexdigest() for k in range(5))
    df = spark.createDataFrame([(1, t), (1, t), (2, t), (None, None), (None, "x" * 250)], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_removed"]) for r in repeats.remove_repeats(df).collect())
    assert got == [("1", 0), ("1", 0), ("2", 320), ("None", 0), ("None", 249)]


def test_long_texts_in_pieces(monkeypatch):
    raw = os.urandom(1000) * 3
    whole = [np.concatenate(x) for x in zip(*repeats.anchors(raw))]
    monkeypatch.setattr(repeats, "PIECE", 700)
    parts = [np.concatenate(x) for x in zip(*repeats.anchors(raw))]
    assert set(zip(whole[0].tolist(), whole[1].tolist())) <= set(zip(parts[0].tolist(), parts[1].tolist()))


def nearest(vectors, q, k=10):
    far = sorted((float(np.sqrt(((np.array(v) - np.array(vectors[q])) ** 2).sum())), i) for i, v in vectors.items() if i != q)
    return far[:k]


def test_search(spark):
    r = np.random.default_rng(1)
    vectors = {i: r.normal(size=16).tolist() for i in range(1500)} | {i: [1.0] * 16 for i in range(1500, 2000)}
    odd = [(5000, None, 1), (5100, [], 1), (5200, [0.0] * 16, 1), (5300, [float("nan")] + [1.0] * 15, 1), (5400, [None] + [1.0] * 15, 1), (5500, [1.0] * 3, 1), (None, [1.0] * 16, 1)]
    df = spark.createDataFrame([(i, v, 0) for i, v in vectors.items()] + odd, "vec_id long, embedding array<double>, score int")
    hits = total = 0
    got = defaultdict(list)
    for row in ann.search(df, lambda i: i % 100 == 0, block=300).orderBy("query_id", "rank").collect():
        got[row["query_id"]].append((row["score"], row["vec_id"]))
    assert set(got) == set(range(0, 2000, 100))
    for q, found in got.items():
        want = nearest(vectors, q)
        assert len(found) == 10 and all(abs(s - np.sqrt(((np.array(vectors[i]) - np.array(vectors[q])) ** 2).sum())) < 1e-9 for s, i in found)
        hits, total = hits + len({i for _, i in want} & {i for _, i in found}), total + 10
    assert hits / total >= 0.9
    assert [i for _, i in got[1600]] == list(range(1500, 1510))


def test_search_of_uneven_vectors(spark):
    """Lengths over many magnitudes, and tight clusters far from each other."""
    r = np.random.default_rng(2)
    uneven = r.normal(size=(2000, 16)) * np.exp(3 * r.normal(size=(2000, 1)))
    tight = (10 * r.normal(size=(4, 16)))[np.arange(2000) % 4] + 1e-3 * r.normal(size=(2000, 16))
    for rows in (uneven, tight):
        vectors = dict(enumerate(rows.tolist()))
        df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
        got = {(x["query_id"], x["vec_id"]) for x in ann.search(df, lambda i: i % 100 == 0).collect()}
        want = {(q, i) for q in range(0, 2000, 100) for _, i in nearest(vectors, q)}
        assert len(got) == len(want) and len(got & want) / len(want) >= 0.95


def test_search_with_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 2.0]), (2, [0.0, 2.0])], "vec_id long, embedding array<float>")
    assert [(r["rank"], r["vec_id"]) for r in ann.search(df, lambda i: i % 100 == 0).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert ann.search(df.limit(0), lambda i: i % 100 == 0).collect() == []


def test_each_row_is_a_candidate(spark):
    """Rows of one id, with equal vectors and with others, and queries of one id."""
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (1, [2.0, 0.0]), (1, [3.0, 0.0]), (2, [9.0, 0.0]), (0, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in ann.search(df, lambda i: i % 100 == 0).collect()]
    want = []
    for a, (i, q) in enumerate(rows):
        if i == 0:
            far = sorted((round(sum((x - y) ** 2 for x, y in zip(q, v)) ** 0.5, 6), j) for b, (j, v) in enumerate(rows) if b != a)
            want += [(i, k + 1, j, d) for k, (d, j) in enumerate(far)]
    assert sorted(got) == sorted(want)


def test_what_a_search_broadcasts(spark):
    """Copies of queries, a few each cell, take next to no room in files: Spark took them for a
    small table and broadcast them all, which no longer fitted at 600,000 vectors."""
    r = np.random.default_rng(4)
    df = spark.createDataFrame(list(enumerate(r.normal(size=(3000, 16)).tolist())), "vec_id long, embedding array<float>")
    found = ann.search(df, lambda i: i % 10 == 0)
    assert found.count() == 3000 and found.collect()  # the plan is final once it has run
    plan = found._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    sent = re.findall(r"BroadcastExchange\nInput \[\d+\]: \[(.*?)\]\n", plan)
    assert sent and not [x for x in sent if re.search(r"\b(v|q|codes|row|asker)#", x)]


def test_every_row_asks(spark, monkeypatch):
    """Several blocks of queries, cells cut into several units or sharing one, ids that agree, equal
    vectors beyond k, and all in float and in double; lengths that single precision can't square."""
    monkeypatch.setattr(ann, "UNIT", 60 * 12 * 8)
    r = np.random.default_rng(6)
    x = np.concatenate([r.normal(size=(300, 12)), np.repeat(r.normal(size=(3, 12)), 40, 0), 5 + 1e-3 * r.normal(size=(200, 12)), r.integers(0, 2, (80, 12)) + 0.5])
    for kind, scale in (("float", 1), ("double", 1), ("double", 1e25), ("double", 1e-25)):
        v = (x * scale).astype(np.float32 if kind == "float" else np.float64).astype(np.float64)
        ids = [i // 2 for i in range(len(v))]
        df = spark.createDataFrame(list(zip(ids, v.tolist())), f"vec_id long, embedding array<{kind}>")
        got = defaultdict(list)
        for row in ann.search(df, lambda i: i >= 0, k=7, block=1, probe_share=1.0).orderBy("query_id", "rank").collect():
            got[row["query_id"]].append((row["score"], row["vec_id"]))
        want = defaultdict(list)
        for a, q in enumerate(v):
            far = np.sqrt(((v - q) ** 2).sum(1))
            want[ids[a]] += sorted((float(d), ids[b]) for b, d in enumerate(far) if b != a)[:7]
        hits = sum((Counter(got[i]) & Counter(want[i])).total() for i in want)
        assert sum(map(len, got.values())) == 7 * len(v) and hits >= 0.99 * 7 * len(v)


def test_cells_in_units():
    sizes = np.array([5, 0, 4, 3, 25, 10, 1, 9])
    pairs = ann.units_of(sizes, 10)
    assert pairs.tolist() == [[0, 0], [2, 0], [3, 1], [4, 2], [4, 3], [4, 4], [5, 5], [6, 6], [7, 6]]


def test_no_query_asks(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0])], "vec_id long, embedding array<float>")
    assert ann.search(df, lambda i: i % 100 == 0).collect() == []


def prose(seed, n):
    r = np.random.default_rng(seed)
    return [f"v{x}" for x in r.integers(0, 60, n)]


def test_groups_that_are_not_one_component(spark, monkeypatch):
    """Small chunks: nodes outside the largest component of a key meet all the others."""
    monkeypatch.setattr(jaccard, "CHUNK", 3)
    monkeypatch.setattr(jaccard, "EARLY", 0)
    base = prose(11, 60)
    texts = [" ".join(base[:k] + [f"w{k}"] + base[k:]) for k in range(0, 60, 2)] + [" ".join(base[:20] + prose(k, 25)) for k in range(40, 60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(df).collect()}
    assert [got[k] for k in range(len(texts))] == [c for _, c in brute_components(list(enumerate(texts)))]


def test_packed_codes_give_the_sums_of_single_ones():
    r = np.random.default_rng(3)
    for parts in (1, 4, 33):
        codes, tables = r.integers(0, 16, (50, parts)).astype(np.uint8), r.normal(size=(parts, 7, 16))
        packed = ann.packed_codes(codes)
        assert packed.dtype == np.uint8 and packed.shape == (50, (parts + 1) // 2)
        got = sum(t[:, packed[:, k]] for k, t in enumerate(ann.byte_tables(tables)))
        assert np.allclose(got, sum(t[:, codes[:, k]] for k, t in enumerate(tables)))


def test_popular_keys_of_differing_texts(spark, monkeypatch):
    """A long passage in all texts, which are near copies in pairs only: keys gather nodes
    of many components. Their rows stay linear, and all links are found."""
    monkeypatch.setattr(jaccard, "CHUNK", 10)
    common = [f"c{k}" for k in range(60)]
    rows = []
    for k in range(150):
        own = [f"o{k}_{j}" for j in range(60)]
        rows += [(2 * k, " ".join(common + own)), (2 * k + 1, " ".join(common + [*own[:30], f"new{k}", *own[31:]]))]
    parts = []
    kind = type(spark.range(0))
    real = kind.mapInArrow

    def counted(self, f, *args, **kwargs):
        if f is jaccard._verify:
            parts.append(self.count())
        return real(self, f, *args, **kwargs)

    monkeypatch.setattr(kind, "mapInArrow", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(df).collect()}
    assert [got[i] for i, _ in rows] == [i - i % 2 for i, _ in rows] == [c for _, c in brute_components(rows)]
    assert len(parts) >= 2 and sum(parts) < 64 * len(rows) * 3, parts


@settings(max_examples=60, deadline=None)
@given(seed=st.integers(0, 10**6), least=st.integers(1, 400))
def test_signatures_lose_no_link(seed, least):
    """Sets of many sizes around a common one: of a linked pair both stay, unlike ones go."""
    r = np.random.default_rng(seed)
    pool = r.integers(1, 2**63, 500, dtype=np.uint64)
    sets = [np.unique(np.r_[pool[: r.integers(least, 500)], r.integers(1, 2**63, r.integers(1, 120), dtype=np.uint64)]) for _ in range(12)]
    sets += [np.unique(r.integers(1, 2**63, 300, dtype=np.uint64))]
    sets.sort(key=len)
    got = jaccard.may_link([len(s) for s in sets], [jaccard.signature(s) for s in sets])
    pairs = [(a, b) for a in range(len(sets)) for b in range(a) if jaccard.linked(sets[a], sets[b])]
    assert all(got[[a, b]].all() for a, b in pairs)
    assert not jaccard.may_link([300] * 9, [jaccard.signature(r.integers(1, 2**63, 300, dtype=np.uint64)) for _ in range(9)]).any()
    assert not jaccard.may_link([1], [jaccard.signature(pool[:1])]).any() and jaccard.may_link([5, 5], [jaccard.signature(pool[:5])] * 2).all()


def test_sets_go_only_where_a_link_is_possible(spark, monkeypatch):
    """Texts that share a passage, and so keys, without being alike: of their sets only those
    of the two near copies are shuffled."""
    common = [f"c{k}" for k in range(60)]
    rows = [(k, " ".join(common + [f"o{k}_{j}" for j in range(70)])) for k in range(60)]
    rows.append((60, rows[7][1].replace("o7_30", "other")))
    sent = []
    kind = type(spark.range(0))
    real = kind.mapInArrow

    def counted(self, f, *args, **kwargs):
        if f is jaccard._verify:
            sent.extend(r["node"] for r in self.select("node").collect())
        return real(self, f, *args, **kwargs)

    monkeypatch.setattr(kind, "mapInArrow", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(df).collect()}
    assert [got[i] for i, _ in rows] == [7 if i == 60 else i for i, _ in rows] == [c for _, c in brute_components(rows)]
    assert {bytes(x) for x in sent} == {jaccard.node_of(jaccard.shingles(rows[k][1])) for k in (7, 60)}
