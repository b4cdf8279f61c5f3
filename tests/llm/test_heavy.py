import json
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmill.llm import heavy

SCHEMA = "stream string, grp long, item string, weight long, n_entries string, w string"


def brute(entries, share):
    w, n, total = Counter(), Counter(), Counter()
    for s, g, i, x in entries:
        if None not in (g, i, x):
            w[s, g, i] += x
            n[s, g] += 1
            total[s, g] += x
    return {(*k, n[k[:2]], total[k[:2]], x) for k, x in w.items() if share * x > total[k[:2]]}


def holds(rows, want, share, precision):
    assert sorted(tuple(r)[:6] for r in rows) == sorted(want)
    for r in rows:
        assert r["low"] <= r["w"] <= r["high"] and r["low"] <= r["estimate"] <= r["high"]
        assert share * precision * (r["high"] - r["low"]) <= r["total"]


@given(st.lists(st.tuples(st.integers(0, 2**62), st.integers(1, 9)), max_size=300), st.integers(1, 40))
@settings(max_examples=60, deadline=None)
def test_counters(pairs, step):
    table, want = heavy.Counters(), Counter()
    for at in range(0, len(pairs), step):
        some = Counter()
        for k, w in pairs[at : at + step]:
            some[k] += w
        new = table.add(np.array([*some], np.int64), np.array([*some.values()], np.int64))
        assert new.tolist() == [k not in want for k in some]
        want += some
    keys, counts = table.held()
    assert dict(zip(keys.tolist(), counts.tolist())) == want and table.live == len(want)


@given(st.lists(st.integers(1, 50), min_size=1, max_size=80), st.integers(1, 20))
def test_purge_takes_half_of_the_limit_times_the_median(counts, limit):
    left, taken = heavy.purge(np.array(counts), limit)
    assert np.count_nonzero(left) <= limit
    assert left.tolist() == [max(0, c - taken) for c in counts]
    assert 2 * (sum(counts) - left.sum()) >= limit * taken


def bank_of(entries, limit, parts, seed):
    """Summaries of parts, replayed into one another."""
    r = random.Random(seed)
    for part in range(parts):
        bank = heavy.Bank(limit)
        own = [e for e in entries if r.random() < 1 / parts] if part else entries
        for at in range(0, len(own), 37):
            some = Counter()
            for g, i, w in own[at : at + 37]:
                some[g, i] += w
            names, items = pa.array([f"s\0{g}\0 0" for g, _ in some]), pa.array([i for _, i in some])
            w = np.array([*some.values()], np.int64)
            bank.count(names, np.ones(len(w), np.int64), w)
            bank.add(names, items, w)
        yield own, bank


@pytest.mark.parametrize("limit", [4, 30])
def test_bounds_hold_and_tables_stay_bounded(limit):
    r = random.Random(limit)
    entries = [(g, f"k{min(int(r.paretovariate(0.6)), 4000)}", r.randint(1, 5)) for g in (1, 2, 3) for _ in range(1500)]
    for own, bank in bank_of(entries, limit, 3, 1):
        true, total = Counter(), Counter()
        for g, i, w in own:
            true[g, i] += w
            total[g] += w
        for row in bank.rows().to_pylist():
            g, held = row["grp"], dict(zip(row["items"], row["counts"]))
            assert row["total"] == total[g] and len(held) <= limit and limit * row["offset"] <= 2 * total[g]
            for (h, i), w in true.items():
                if h == g:
                    assert held.get(i, 0) <= w <= held.get(i, 0) + row["offset"]


@pytest.mark.parametrize(("share", "precision", "most", "fan"), [(20, 10, 1 << 20, 16), (5, 1, 50, 2)])
def test_against_brute_force(spark, monkeypatch, share, precision, most, fan):
    monkeypatch.setattr(heavy, "MOST", most)
    monkeypatch.setattr(heavy, "ROWS", 300)
    monkeypatch.setattr(heavy, "FAN", fan)
    r = random.Random(5)
    hot = lambda: 1 if r.random() < 0.4 else r.randint(2, 60)
    entries = [(s, hot(), f"é{min(int(r.paretovariate(0.7)), 5000)}", r.choice([0, 1, 3])) for s in ("a", "b") for _ in range(6000)]
    entries += [("a", None, "x", 1), ("a", 1, None, 1), ("a", 1, "x", None), ("c", -7, "", 0), ("c", -8, "y" * 20000, 2), ("c", -9, "t", 1), ("c", -9, "u", 1)] + [("c", -10, "same", 4)] * 5
    df = spark.createDataFrame([(*e, "n", "w") for e in entries], SCHEMA).repartition(7)
    rows = heavy.heavy_hitters(df, share, precision).collect()
    holds(rows, brute(entries, share), share, precision)
    if share == 5:
        assert any(x["high"] > x["low"] for x in rows)  # groups were purged


def test_share_itself_is_not_heavy(spark):
    entries = [("a", 1, str(k), 1) for k in range(20)] + [("a", 2, str(k), 1) for k in range(19)]
    rows = heavy.heavy_hitters(spark.createDataFrame(entries, "stream string, grp long, item string, weight long")).collect()
    assert len(rows) == 19 and {r["grp"] for r in rows} == {2}


def test_without_rows(spark):
    assert heavy.heavy_hitters(spark.createDataFrame([], SCHEMA)).collect() == []


def test_negative_weight_is_an_error(spark):
    with pytest.raises(Exception, match="negative"):
        heavy.heavy_hitters(spark.createDataFrame([("a", 1, "x", -1, "", "")], SCHEMA)).collect()


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('{"device": {"os": "a"}, "tags": ["b", null, "b"], "items": [{"sku": 5, "qty": 1}, {"qty": 2}, 7, {"sku": null}]}', ["os=a", "tag=b", "tag=b", "sku=5"]),
        ('{"device": {"os": "a"}', []), ('{"device": {"os": "a"}} x', []), ('{"device": {"os": NaN}}', []), ("[1]", []), ("", []), (None, []), ("null", []),
        ('{"device": "os", "tags": "t", "items": {"sku": 1}}', []), ('{"device": {"os": "\\ud800"}, "tags": ["b"]}', []), ('{"tags": [1.50, true, {"a": 1}, "é"]}', ["tag=1.50", "tag=true", "tag=é"]),
        ("[" * 100000, []), ('{"items": [{"sku": ' + "9" * 5000 + "}]}", ["sku=" + "9" * 5000]),
    ],
)
def test_json_items(text, want):
    assert heavy.json_items(text) == want


def test_hours_do_not_depend_on_the_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "Europe/Paris"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            rows = spark.sql("SELECT TIMESTAMP_NTZ'2024-03-31 02:30:00.5' t UNION ALL SELECT TIMESTAMP_NTZ'1969-12-31 23:59:59.9' UNION ALL SELECT NULL")
            from pyspark.sql import functions as F

            assert {r[0] for r in rows.select(heavy.hour(F.col("t"))).collect()} == {(1711852200 // 3600), -1, None}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_query(spark, data, duck):
    """Exact sums by the tables themselves, taken apart in plain Python."""
    entries = []
    for grp, client, props in duck.execute(f"SELECT floor(epoch_us(ts) / 3600000000)::BIGINT, client_id, props FROM '{data}/clicks.parquet'").fetchall():
        entries.append(("user", grp, None if client is None else str(client), 1))
        try:
            x = json.loads(props)
        except (TypeError, ValueError):
            continue
        found = [f"os={x['device']['os']}"] if "device" in x else []
        found += [f"tag={t}" for t in x.get("tags") or [] if t is not None] + [f"sku={i['sku']}" for i in x.get("items") or []]
        entries += [("prop", client, i, 1) for i in found]
    entries += [("part", v, None if i is None else str(i), q) for v, i, q in duck.execute(f"SELECT vendor_id, item_id, quantity FROM '{data}/sale_lines.parquet'").fetchall()]
    rows = heavy.op12_heavy_hitters(spark, data)
    assert rows.columns == ["stream", "grp", "item", "n_entries", "total", "w", "low", "estimate", "high"]
    assert [t for _, t in rows.dtypes] == ["string", "bigint", "string"] + ["bigint"] * 6
    holds(rows.collect(), brute(entries, 20), 20, 10)
    streams = defaultdict(int)
    for r in rows.collect():
        streams[r["stream"]] += 1
    assert set(streams) == {"user", "part", "prop"}
