import itertools
import math
import random
import re
import string
import zlib
from collections import Counter

import numpy as np
import pytest
import public_tokenizers as P
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmill.llm import lattice_lm, pii, quality


VOCABULARY = ["▁a", "a", "ab", "▁", "b", "▁ab", "ba", "▁b", "aba", "▁▁", "é", *[f"<0x{k:02X}>" for k in range(256)]]


def spelled(m: lattice_lm.Unigram, text: list[str]) -> float:
    """The probability of a text: all segmentations of all its words, one by one."""
    total = 1.0
    for word in text:
        found = 0.0
        for cuts in itertools.product((0, 1), repeat=len(word)):
            parts, now = [], ["▁"]
            for c, cut in zip(word, cuts):
                if cut:
                    parts.append(now)
                    now = []
                now.append("mark" if c == "▁" else c)
            p = 0.0
            for k, x in enumerate([*parts, now]):
                piece = "".join(x)
                if piece in m.pieces.ids and (k == 0 or "▁" not in piece):
                    p += m.logs[m.pieces.ids[piece]]
                elif len(x) == 1:
                    p += m.char("▁" if x[0] == "mark" else x[0])
                else:
                    p = -math.inf
            found += math.exp(p)
        total *= found
    return total * math.exp(m.end)


def test_forward_recursion_is_the_sum_over_segmentations():
    for vocabulary in (VOCABULARY, VOCABULARY[:3], [x for x in VOCABULARY if x not in ("▁", "<0x96>")]):
        m = lattice_lm.Unigram(p := lattice_lm.Pieces(vocabulary), lattice_lm.Pieces(vocabulary).zipf())
        words = ["a", "ab", "aba", "bab", "abba", "cab", "é", "zz", "▁a", "\x00a", "a▁b", "abababab"]
        each = m.log_probabilities(words)
        for word, got in zip(words, each):
            assert math.isclose(math.exp(got + m.end), spelled(m, [word]), rel_tol=1e-9), word
            assert math.isclose(got, m.one(word)[-1], rel_tol=1e-9)
        for text in (["ab", "aba"], ["a", "cab", "bab"], []):
            assert math.isclose(math.exp(m.log_probabilities(text).sum() + m.end), spelled(m, text), rel_tol=1e-9)
        times = np.arange(1.0, len(words) + 1)
        (both, likely), one = m.expect(words, times), np.zeros(p.size + 1)
        assert math.isclose(likely, float(each @ times), rel_tol=1e-9)
        for w, c in zip(words, times.tolist()):
            m.one(w, one, c)
        assert np.allclose(both, one)


def test_words_of_any_length():
    m = lattice_lm.Unigram(p := lattice_lm.Pieces(VOCABULARY), lattice_lm.Pieces(VOCABULARY).zipf())
    words = ["ab" * n for n in (31, 32, 33, 40, 5000)]  # on both sides of LONG
    assert np.allclose(m.log_probabilities(words), [m.one(w)[-1] for w in words])
    assert len(m.expect(words, np.ones(5))[0]) == p.size + 1


def test_words():
    texts = ["  One\ttwo one\x0b", None, "", "É é \u3000 x"]
    text, word, names = lattice_lm.words_of(pa.array(texts))
    got = [[names[int(w)].as_py() for t, w in zip(text, word) if t == k] for k in range(4)]
    assert got == [words(t) for t in texts] == [["one", "two", "one"], [], [], ["É", "é", "\u3000", "x"]]


def test_fit_raises_the_likelihood(spark, data):
    """Each round does, on training documents; and on the held-out ones the fitted model
    is above the vocabulary's own probabilities and above single characters."""
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    path, cond = P.path("piece_bpe_32k.model"), lattice_lm.fold(F.col("doc_id"), 7) != 2
    sums = [
        {r["train"]: r["s"] for r in lattice_lm.score(docs, path, cond, rounds=k).groupBy("train").agg(F.sum("score").alias("s")).collect()}
        for k in (0, 1, 2, lattice_lm.ROUNDS)
    ]
    assert sums[0][True] < sums[1][True] < sums[2][True] < sums[3][True] and sums[2][False] < sums[3][False]
    assert sums[0][False] < sums[1][False] < sums[2][False]
    rows = [(r["text"] or "", zlib.crc32(str(r["doc_id"]).encode()) % 7 != 2) for r in docs.collect()]
    chars = Counter(c for t, learn in rows if learn for w in words(t) for c in "▁" + w)
    total = sum(chars.values()) + len(chars) + 1
    held = sum(math.log10((chars[c] + 1) / total) for t, learn in rows if not learn for w in words(t) for c in "▁" + w)
    assert held < sums[2][False]


def words(text: str | None) -> list[str]:
    return [w.decode() for w in (text or "").encode().lower().split()]


def check_base(docs, rows, train):
    counts, ends = Counter(), 0
    for i, t in docs:
        if train(i):
            counts.update(words(t))
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + (ends > 0)
    want = []
    for i, t in docs:
        listed = words(t)
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in listed) + math.log10((ends + 1) / (n + v + 1))
        want.append((str(i), len(listed) + 1, sum(counts[w] > 0 for w in listed) + (ends > 0), n, round(base, 6)))
    assert sorted(want) == sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows)
    assert all(-1e9 < r["score"] < 0 for r in rows)


def test_scores(edge, empty, monkeypatch):
    docs = [(r["doc_id"], r["text"]) for r in edge.collect()]
    train = lambda i: zlib.crc32(str(i if i is not None else "").encode()) % 7 != 2
    cond = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 != 2
    path = P.path("piece_bpe_32k.model")
    rows = lattice_lm.score(edge, path, cond).collect()
    check_base(docs, rows, train)
    monkeypatch.setattr(lattice_lm, "COMMON", 5)  # nearly all words by the join
    joined = lattice_lm.score(edge, path, cond).collect()
    check_base(docs, joined, train)
    key = lambda r: (str(r["doc_id"]), r["n_tokens"], round(r["score"], 6))
    assert sorted(map(key, rows)) == sorted(map(key, joined))
    assert lattice_lm.score(empty, path, cond).collect() == []
    untrained = lattice_lm.score(edge, path, F.lit(False)).collect()
    assert all(r["base_score"] == 0 and r["train_tokens"] == 0 and math.isfinite(r["score"]) for r in untrained)


def brute_spans(t):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for kind, pattern, low, high in ((2, r"[0-9]([\x20-]?[0-9])+", 16, 19), (3, r"\+[0-9][\x20().0-9-]+[0-9]", 8, 15)):
        for m in re.finditer(pattern, t):
            d = re.sub("[^0-9]", "", m[0])
            if low <= len(d) <= high and (kind == 3 or pii.luhn(d)):
                out.append((kind, *m.span()))
    return out


@settings(max_examples=400, deadline=None)
@given(t=st.text(st.sampled_from("1234567890..@+ab- ()é\n"), max_size=70))
def test_base_is_the_patterns(t):
    assert pii.base_spans(t) == brute_spans(t)
    spans = pii.all_spans(t, pii.train(), pii.base_spans(t))
    assert set(pii.base_spans(t)) <= set(spans) and spans == sorted(spans)


def test_long_runs_take_linear_time():
    assert pii.base_spans("9" * 200_000) == [] and pii.base_spans("a" * 200_000 + "@") == [] and pii.base_spans("+1" + " " * 200_000) == []


def test_field_on_generated_sentences():
    weights, hit, found, true = pii.train(), 0, 0, 0
    for text, words, truth in pii.sentences(300, seed=99):
        got = set(pii.decode(weights, text, words))
        hit, found, true = hit + len(got & truth), found + len(got), true + len(truth)
    assert hit / found > 0.95 and hit / true > 0.9


def planted(r):
    """Private and public items in phrases that the generator has not: (kind or None, before, item, after)."""
    some = lambda k, of=string.digits: "".join(r.choice(of) for _ in range(k))
    mixed = lambda k: "".join(r.sample(some(k - 4, string.ascii_letters) + some(4), k))
    no_luhn = lambda: next(d for d in iter(lambda: some(16), None) if not pii.luhn(d))
    groups = lambda *n: " ".join(some(k) for k in n)
    out = []
    for lead in ("my pwd=", "Passwort: ", "tu contraseña=", "le mot de passe : ", "DB_PASSWORD=", "export GH_TOKEN=", '"client_secret": "', "der API-Key: "):
        out.append(("secret", lead, mixed(r.randint(10, 12)), '"' if lead.endswith('"') else ""))
    out += [("secret", "using ", "AKIA" + some(16, string.ascii_uppercase + "234567"), ""), ("secret", "push with ", "ghp_" + some(36, string.ascii_letters + string.digits), ","), ("secret", "Authorization token ", some(40, "0123456789abcdef"), ".")]
    out += [("phone", "rang ", f"0{r.randint(1, 7)} " + groups(2, 2, 2, 2), ""), ("phone", "sous le ", f"06-{some(2)}-{some(2)}-{some(2)}-{some(2)}", " demain"), ("phone", "unter ", f"030/{some(7)}", ""), ("phone", "Handy ", f"0171 {some(8)}", "")]
    out += [("phone", "al ", f"{r.choice('69')}{some(2)} " + groups(3, 3), ""), ("phone", "dial ", f"({some(3)}) {some(3)}-{some(4)}", ";"), ("phone", "teléfono: ", groups(3, 3, 3), "."), ("phone", "Tel. ", f"0{some(4)} {some(6)}", "")]
    out += [(None, "host ", f"{r.randint(256, 299)}.{r.randint(0, 99)}.{r.randint(0, 99)}.{r.randint(0, 99)}", ""), (None, 'ETag: "', some(32, "0123456789abcdef"), '"'), (None, "konto DE", some(20), ""), (None, "cuenta ", "ES" + groups(2, 4, 4, 4, 4, 4), ""), (None, "order ", no_luhn(), "")]
    out += [(None, "number ", no_luhn(), ""), (None, "at git commit ", some(40, "0123456789abcdef"), ""), (None, "ISBN ", f"978-{some(1)}-{some(5)}-{some(3)}-{some(1)}", ""), (None, "on ", "2024-03-05", ""), (None, "am ", "05.03.2024", ""), (None, "paid ", f"{r.randint(1, 5)}{some(2)} {some(3)} {some(3)} EUR", "")]
    out += [(None, "", some(26, "etaoinshrdlu"), ""), (None, "key ", some(4), ""), (None, "Rechnung Nr. ", some(9), ""), (None, "id ", "-".join(some(k, "0123456789abcdef") for k in (8, 4, 4, 4, 12)), ""), (None, "pages ", "120-135", ""), (None, "ratio ", "12.5/13", "")]
    return out


def test_field_on_planted_spans(spark, data):
    """Exact kinds and bounds, in the tables' own texts, in phrases of this test alone.
    (Pairs of digits between dots are not among them: four such are an address to the base.)"""
    r, w = random.Random(77), pii.train()
    texts = [t.split()[:30] for t, in spark.read.parquet(f"{data}/documents.parquet").select("text").collect() if t]
    texts = [t for t in texts if not re.search(r"[0-9@]", " ".join(t))]
    hits, false = {}, Counter()
    for _ in range(100):
        for k, (kind, before, item, after) in enumerate(planted(r)):
            words_ = r.choice(texts)
            cut = r.randrange(len(words_) + 1)
            head = "".join(x + " " for x in words_[:cut]) + before
            t = head + item + after + " " + " ".join(words_[cut:])
            spans = pii.all_spans(t, w, pii.base_spans(t))
            if kind:
                want = (pii.KINDS.index(kind), len(head), len(head) + len(item))
                n = hits.setdefault((k, kind, before), [0, 0, 0])
                n[0], n[1], n[2] = n[0] + 1, n[1] + (want in spans), n[2] + len(set(spans) - {want})
            elif spans:
                false[k, before] += 1
    for kind in ("secret", "phone"):
        of = [n for key, n in hits.items() if key[1] == kind]
        assert sum(n[1] for n in of) > 0.9 * sum(n[0] for n in of) and sum(n[2] for n in of) < 0.05 * sum(n[0] for n in of)
        assert all(n[1] > 0.6 * n[0] for n in of)
    assert sum(false.values()) < 0.03 * 100 * sum(kind is None for kind, *_ in planted(r)) and not any(x[1] == "host " for x in false)


def test_numbers_in_many_groups_and_long_words():
    w = pii.train()
    t = "appelez le 06 12 34 56 78 ou " + "x" * 200_000 + "1 fin"
    assert (3, 11, 25) in pii.all_spans(t, w, [])
    t = "card " + " ".join("4539578763621486"[k : k + 2] for k in range(0, 16, 2)) + " end"
    assert pii.all_spans(t, w, pii.base_spans(t)) == [(2, 5, 28)]
    t = " ".join(["12"] * 20_000)
    assert all(y - x < 60 for _, x, y in pii.all_spans(t, w, []))


def test_decoding_is_the_best_labelling():
    weights = pii.train()
    for text, words, _ in itertools.islice(pii.sentences(60, seed=5), 60):
        found = pii.segments(text, words)
        if not 0 < len(found) <= 9:
            continue
        scores = [float((np.array(x[4]) @ weights).max()) for x in found]
        best = 0.0
        for pick in itertools.product((0, 1), repeat=len(found)):
            cover = [w for x, p in zip(found, pick) if p for w in range(x[0], x[0] + x[1])]
            if len(cover) == len(set(cover)):
                best = max(best, sum(s for s, p in zip(scores, pick) if p))
        spans = pii.decode(weights, text, words)
        got = sum(max(s for s, x in zip(scores, found) if (x[2], x[3]) == (a, b)) for _, a, b in spans)
        assert math.isclose(got, best, abs_tol=1e-9)


def test_find(edge, empty):
    rows = pii.find(edge).collect()
    want = Counter()
    for r in edge.collect():
        t = r["text"] or ""
        want[pii.written(brute_spans(t))] += 1
    assert Counter(r["base"] for r in rows) == want
    row = next(r for r in rows if r["doc_id"] == 17)
    assert (row["n_email"], row["n_ip"], row["n_card"], row["n_phone"]) == (1, 1, 1, 1) and row["tie"] == "t"
    assert pii.find(empty).collect() == []


def test_query_counts_all_spans(spark, data):
    for r in pii.op5_semi_markov_pii(spark, data).collect():
        kinds = [x.split(":")[0] for x in r["spans"].split(",") if x]
        assert (r["n_spans"], r["n_secret"]) == (len(kinds), kinds.count("secret"))
        assert r["n_spans"] >= r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"]


def test_marginals_are_sums_over_labellings():
    r = np.random.default_rng(0)
    counts = np.array([3, 1, 4])
    good, move = r.normal(size=8), r.normal(size=(2, 2))
    p, pairs = quality.forward_backward(good, counts, move)
    at, moved = 0, np.zeros((2, 2))
    for n in counts:
        total, ones = 0.0, np.zeros(n)
        trans = np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=int(n)):
            w = math.exp(sum(good[at + k] * y[k] for k in range(n)) + sum(move[y[k - 1], y[k]] for k in range(1, n)))
            total += w
            ones += w * np.array(y)
            for k in range(1, n):
                trans[y[k - 1], y[k]] += w
        assert np.allclose(p[at : at + n], ones / total)
        moved += trans / total
        at += n
    assert np.allclose(pairs, moved)


@pytest.mark.parametrize("block", [2, 3, 64])
def test_marginals_by_blocks(monkeypatch, block):
    """As line by line, for texts of all lengths around powers of a block."""
    r, counts = np.random.default_rng(1), np.array([1, 2, 3, 4, 9, 10, 27, 63, 64, 65, 300, 1, 81])
    good, move = r.normal(size=counts.sum()) * 3, r.normal(size=(2, 2))
    monkeypatch.setattr(quality, "BLOCK", block)
    p, pairs = quality.forward_backward(good, counts, move)
    at, moved = 0, np.zeros((2, 2))
    for n in counts:
        score = np.stack([np.zeros(n), good[at : at + n]], 1)
        fore, back = [score[0]], [np.zeros(2)]
        for t in range(1, n):
            fore.append(score[t] + np.logaddexp(fore[-1][0] + move[0], fore[-1][1] + move[1]))
        for t in range(n - 1, 0, -1):
            back.append(np.logaddexp(*(move + score[t] + back[-1]).T))
        f, b = np.array(fore), np.array(back[::-1])
        total = np.logaddexp(*(f[-1]))
        assert np.allclose(p[at : at + n], np.exp(f[:, 1] + b[:, 1] - total))
        for t in range(1, n):
            moved += np.exp(f[t - 1][:, None] + move + score[t] + b[t] - total)
        at += n
    assert np.allclose(pairs, moved)


def test_a_text_of_a_million_lines():
    import time

    r = np.random.default_rng(2)
    counts = np.array([1_000_000, 3, 500])
    began = time.time()
    p, pairs = quality.forward_backward(r.normal(size=counts.sum()), counts, r.normal(size=(2, 2)))
    assert time.time() - began < 30 and np.isfinite(p).all() and abs(pairs.sum() - (counts - 1).sum()) < 1e-3


def test_neighbouring_lines_matter():
    """Lines that say nothing by themselves, between lines that do: with the transitions and
    the neighbours' features they are told apart, by their own features they can't be."""
    r = np.random.default_rng(3)
    counts = np.full(60, 9)
    y = np.repeat(np.arange(60) % 2, 9).astype(float)
    x = r.normal(size=(540, 3)) * 0.1
    loud = np.arange(540) % 3 == 0
    x[loud, 0] += np.where(y[loud] > 0, 2, -2)
    labels, lengths = np.arange(60) % 2, np.ones(540, np.int64)
    model = quality.fit_lines(x, lengths, counts, labels)
    z = quality.with_neighbours((x - model["mean"]) / model["std"], counts)
    theta = model["theta"]
    p, _ = quality.forward_backward(z @ theta[:-4], counts, theta[-4:].reshape(2, 2))
    alone = z[:, :3] @ theta[:3] + theta[-5]
    assert ((p > 0.5) == y)[~loud].mean() > 0.95 > 0.75 > ((alone > 0) == y)[~loud].mean()


def test_quality(spark, edge, empty):
    import os

    d = "/root/testdata/sf0.01"
    if os.path.isdir(d):
        rows = quality.op8_line_crf(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
        assert sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.95
    labels = spark.createDataFrame([(1, 1), (4, 1), (5, 1), (20, 0), (20, None), (None, 0), (99, 0)], "doc_id long, quality int")
    for held in (2, 9):
        model = quality.fit(edge, labels, held_out=held)
        rows = quality.score(edge, model).collect()
        assert len(rows) == edge.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    assert quality.fit(edge, labels.limit(0)) == {"constant": 0.5}
    assert quality.score(empty, {"constant": 0.5}).collect() == []


def test_quality_fits_whole_texts(spark):
    """Bad documents begin as the good ones do, and differ only after many lines."""
    clean = ["The old harbour was quiet in the morning."] * 70
    rows = [(k, "\n".join(clean + (["$$ || ## 0 0 0"] * 70 if k % 2 else clean)), 1 - k % 2) for k in range(1, 41)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality.fit(docs.select("doc_id", "text"), docs.select("doc_id", "quality"), held_out=9)
    got = quality.score(docs, model, threshold=0.5).collect()
    assert all(r["predicted"] == r["quality"] and abs(r["score"] - r["quality"]) < 0.3 for r in got)
