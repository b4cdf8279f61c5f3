"""Streams against the batch forms of the same operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillmill.operators import states
from quillmill.streaming import events, runs

T0 = dt.datetime(2024, 1, 1)


def run(spark, df, name, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def rows(spark, tmp_path, data, schema, name):
    path = str(tmp_path / name)
    for k, part in enumerate(data):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    return path


def at(m):
    return T0 + dt.timedelta(minutes=m)


def test_held(spark, tmp_path):
    schema = "user string, ts timestamp, state string"
    data = [[("a", at(0), "on"), ("b", at(0), "on"), ("b", at(3), "off")], [("a", at(8), "off"), ("c", at(9), "on")], [("z", at(500), "off")], [("z", at(600), "off")]]
    path = rows(spark, tmp_path, data, schema, "in")
    stream = events.held(events.read(spark, path, schema, 1), "user", F.col("state") == "on", 300, "1 minute")
    got = {(r["key"], r["start"], r["fired"]) for r in run(spark, stream, "held", tmp_path)}
    assert got == {("a", at(0), at(5)), ("c", at(9), at(14))}
    batch = spark.read.parquet(path).withColumn("id", F.lit(0))
    batch = states.held(batch, "user", "ts", "id", F.col("state") == "on", 300).collect()
    # a run that no row ends is held for the stream, whose clock goes on, and open in a batch
    assert {(r["user"], r["start"], r["fired"]) for r in batch} == {("a", at(0), at(5))}


def test_held_looks_at_turns_only(spark, tmp_path):
    """Many rows between the turns of a run, over several batches."""
    schema = "user string, ts timestamp, state string"
    data = [[("a", at(k), "on") for k in range(5)] + [("b", at(k), "on" if k % 4 else "off") for k in range(5)], [("a", at(k), "on") for k in range(5, 9)] + [("a", at(9), None), ("b", at(5), "on"), ("b", at(20), "off")], [("z", at(500), "off")], [("z", at(600), "off")]]
    path = rows(spark, tmp_path, data, schema, "in")
    stream = events.held(events.read(spark, path, schema, 1), "user", F.col("state") == "on", 300, "1 minute")
    got = {(r["key"], r["start"], r["fired"]) for r in run(spark, stream, "turns", tmp_path)}
    assert got == {("a", at(0), at(5)), ("b", at(5), at(10))}


def test_answers(spark, tmp_path):
    q = rows(spark, tmp_path, [[("u", 1, at(0)), ("v", 2, at(0))], [("w", 3, at(500))]], "k string, id int, ts timestamp", "q")
    a = rows(spark, tmp_path, [[("u", "keep", at(4)), ("v", "late", at(6))], [("w", "x", at(501))]], "k string, answer string, ts timestamp", "a")
    stream = events.answered(events.read(spark, q, "k string, id int, ts timestamp"), events.read(spark, a, "k string, answer string, ts timestamp"), "k", 300, "1 minute")
    got = {(r["id"], r["status"]) for r in run(spark, stream, "answers", tmp_path)}
    assert {(1, "answered"), (2, "timeout")} <= got


def test_daily(spark, tmp_path, data):
    schema = spark.read.parquet(f"{data}/events.parquet").schema
    path = str(tmp_path / "e")
    spark.read.parquet(f"{data}/events.parquet").write.parquet(path)
    stream = events.daily(events.read(spark, path, schema), "1 hour")
    got = {r["day"].date(): r["n"] for r in run(spark, stream, "daily", tmp_path, "complete")}
    want = {r[0]: r[1] for r in spark.read.parquet(path).groupBy(F.to_date("ts")).count().collect()}
    assert got == want


def brute_waits(rows, micros, single):
    """rows: (key, at, id, kind, value) in the order of times, answers first."""
    out, open_ = set(), {}
    for key, at, i, kind, value in sorted(rows, key=lambda r: (r[1], r[3], r[2])):
        asked = open_.setdefault(key, [])
        for q in [q for q in asked if q[0] + micros < at + (single and kind == "b")]:
            out.add((key, str(q[1]), "timeout", None))
            asked.remove(q)
        if kind == "a":
            out |= {(key, str(q[1]), "answered", value) for q in asked}
            asked.clear()
        elif not (single and asked):
            asked.append((at, i))
    return out | {(k, str(i), "timeout", None) for k, x in open_.items() for _, i in x}


@pytest.mark.parametrize("single", [False, True])
def test_waits_over_batches_restarts_and_late_rows(spark, tmp_path, monkeypatch, single):
    import random

    for k, v in runs.STORE.items():
        spark.conf.set(k, v)
    r = random.Random(3)
    schema = "k string, ts timestamp, id int, kind string, value string"
    made = [(r.choice("pqr"), at(r.choice([k, k, k // 2 * 2])), k, r.choice("aabbb"), r.choice(["keep", "off", None])) for k in range(120)]
    made += [("p", at(30), 500, "b", None), ("p", at(30), 501, "a", "same"), ("p", at(35), 502, "a", "limit"), (None, at(3), 503, "b", None)]
    made.sort(key=lambda x: x[1])
    files = [r.sample(made[:40], 40), made[40:80] + [("q", at(5), 900, "b", None)], [*made[80:], ("r", at(20), 901, "a", "late")], [("end", at(900), 999, "none", None)], [("end", at(901), 999, "none", None)]]
    path = rows(spark, tmp_path, files[:2], schema, "in")

    def go():
        events_ = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
        stream = runs.waits(events_, "k", "ts", "id", F.col("kind") == "b", F.col("kind") == "a", F.col("value"), 300, single, "5 minutes")
        q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination(300)

    try:
        go()
        rows(spark, tmp_path, files[2:], schema, "in")
        go()
    finally:
        for k in runs.STORE:
            spark.conf.unset(k)
    got = [tuple(x) for x in spark.read.parquet(str(tmp_path / "out")).collect()]
    micros = lambda t: (t - T0) // dt.timedelta(microseconds=1)
    made.append(("q", at(5), 900, "b", None))  # behind the first file's watermark, but not behind that of the batch before it
    want = brute_waits([(k, micros(t), i, kind, v) for k, t, i, kind, v in made if k], 300_000_000, single)
    assert len(got) == len(set(got)) and set(got) == want


def test_midnights_over_batches(spark, tmp_path):
    for k, v in runs.STORE.items():
        spark.conf.set(k, v)
    day = 24 * 60
    schema = "k string, ts timestamp, id int, s string"
    files = [[("a", at(10), 1, "on"), ("b", at(day), 2, "x")], [("a", at(3 * day - 1), 3, "off"), ("a", at(3 * day), 4, "on"), ("b", at(3 * day + 5), 6, None)], [("z", at(5 * day + 30), 9, None)], [("z", at(5 * day + 31), 9, None)]]
    path = rows(spark, tmp_path, files, schema, "in")
    try:
        events_ = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path).where("k <> 'z' OR id = 9")
        got = [tuple(x) for x in run(spark, runs.midnights(events_, "k", "ts", "id", F.col("s"), "10 minutes"), "midnights", tmp_path)]
    finally:
        for k in runs.STORE:
            spark.conf.unset(k)
    night = lambda k, d, s: (k, "midnight", at(d * day), None, None, s)
    want = [night("a", 1, "on"), night("a", 2, "on"), night("a", 3, "off"), night("a", 4, "on"), night("a", 5, "on"), night("b", 2, "x"), night("b", 3, "x"), night("b", 4, None), night("b", 5, None)]
    want += [("a", "transition", at(3 * day - 1), "3", "on", "off"), ("a", "transition", at(3 * day), "4", "off", "on")]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_keys_of_a_bucket_share_timers(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(runs, "BUCKETS", 2, raising=False)
    for k, v in runs.STORE.items():
        spark.conf.set(k, v)
    schema = "k string, ts timestamp, id int, kind string"
    files = [[(f"u{k}", at(k), k, "b") for k in range(60)], [("end", at(900), 99, "none")], [("end", at(901), 99, "none")]]
    try:
        events_ = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(rows(spark, tmp_path, files, schema, "in"))
        stream = runs.waits(events_, "k", "ts", "id", F.col("kind") == "b", F.lit(False), F.lit(None), 300)
        q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination(300)
        timers = [o["customMetrics"]["numRegisteredTimers"] for p in q.recentProgress for o in p["stateOperators"]]
    finally:
        for k in runs.STORE:
            spark.conf.unset(k)
    assert 0 < max(timers) <= 2
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted((f"u{k}", str(k), "timeout", None) for k in range(60))


def test_log_once(spark, tmp_path):
    """A stream that dies between a batch's files and its entry, one that is replayed after
    the entry, and a reader in between."""
    import shutil

    from pyspark.errors import StreamingQueryException

    from quillmill.streaming import log

    schema = "ts string, agent string"
    files = [[("2024-01-15T00:00:00", f"a{k}"), ("2024-01-16T00:00:00", f"b{k}")] for k in range(3)]
    path, folder, checkpoint = rows(spark, tmp_path, files, schema, "in"), str(tmp_path / "log"), str(tmp_path / "c")
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)

    def die(batch):
        if batch == 1:
            raise RuntimeError("dead")

    assert log.read(spark, folder, schema).collect() == []
    with pytest.raises(StreamingQueryException):
        log.append(stream(), folder, "ts", checkpoint, die).awaitTermination()
    assert (tmp_path / "log" / "data" / "batch=1").exists()
    assert log.read(spark, folder, schema).count() == 2  # of batch 1 nothing is seen
    log.append(stream(), folder, "ts", checkpoint).awaitTermination()
    want = sorted(a for f in files for _, a in f)
    assert sorted(r["agent"] for r in log.read(spark, folder, schema).collect()) == want
    # the checkpoint's note of the last batch is lost, after its entry
    for name in ("commits/2", "commits/.2.crc"):
        (tmp_path / "c" / name).unlink(missing_ok=True)
    log.append(stream(), folder, "ts", checkpoint).awaitTermination()
    assert sorted(r["agent"] for r in log.read(spark, folder, schema).collect()) == want
    assert sorted(r["agent"] for r in log.read(spark, folder, schema, "2024-01-15").collect()) == ["a0", "a1", "a2"]
    assert not log.commit(spark.createDataFrame(files[0], schema), 2, folder, "ts")
    shutil.rmtree(folder)
