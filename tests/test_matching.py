import random
import re

from pyspark.sql import functions as F

from quillmill.operators import matching


def test_best_titles(spark):
    """Against all pairs, with words that all texts hold, titles without words, and nulls."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcde") for _ in range(5)) if r.random() < 0.3 else r.choice(["alpha", "betas", "gamma", "delta"])
    titles = [(k, " ".join(word() for _ in range(r.randint(1, 12)))) for k in range(60)] + [(60, "a b c"), (61, None), (62, "zzzzz yyyyy xxxxx"), (63, "")]
    docs = [(k, " ".join([word() for _ in range(r.choice([0, 3, 40, 300]))] + [titles[k % 60][1]] * (k % 3 == 0))) for k in range(80)] + [(80, None), (81, ""), (82, "alpha")]
    words = lambda t: set(re.findall("[a-z]{5,}", (t or "").lower()))
    want = {}
    for d, t in docs:
        have, got = words(t), []
        for k, x in titles:
            if w := words(x):
                got.append((-len(w & have) / len(w), k))
        good = [x for x in got if -x[0] >= 0.34]
        best = min(good, default=(None, None))
        want[d] = (best[1], None if best[0] is None else -best[0], len(good) + sum(not words(x) for _, x in titles))
    a = spark.createDataFrame(docs, "id int, text string")
    b = spark.createDataFrame(titles, "id int, text string")
    assert {r["id"]: tuple(r)[1:] for r in matching.best_titles(a, b, "id", "text", "id", "text").collect()} == want
    assert [tuple(r)[1:] for r in matching.best_titles(a.limit(2), b.limit(0), "id", "text", "id", "text").collect()] == [(None, None, 0)] * 2


def test_first_rule_of(spark):
    rules = spark.createDataFrame([("ab", 3, "three"), ("abc", 1, "one"), ("a", 2, "two"), ("ab", 0, "none"), ("x", 5, "five"), (None, 9, "null")], "p string, o int, v string")
    rows = spark.createDataFrame([(1, "abcd"), (2, "ac"), (3, "abx"), (4, None), (5, ""), (6, "xé")], "k int, t string")
    got = matching.first_rule_of(rows, "k", F.col("t"), rules, "p", "o", "v", "other", "out")
    assert {r["k"]: r["out"] for r in got.collect()} == {1: "none", 2: "two", 3: "none", 4: "other", 5: "other", 6: "five"}
    assert {r["out"] for r in matching.first_rule_of(rows, "k", F.col("t"), rules.limit(0), "p", "o", "v", "other", "out").collect()} == {"other"}
    assert matching.first_rule_of(rows, "k", F.col("t"), spark.createDataFrame([("", 1, "all")], "p string, o int, v string"), "p", "o", "v", "other", "out").where("out = 'all'").count() == 5
