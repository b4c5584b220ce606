"""Streams against their batch forms: several batches of files, and one late row."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cairn.streaming import events as V

T0 = dt.datetime(2024, 1, 1)


def at(s):
    return T0 + dt.timedelta(seconds=s)


def drive(spark, tmp_path, schema, batches, job, mode="append", restart=False):
    """Writes each batch as a file, runs the job after each, and returns the sink's rows. restart: a new query after each batch."""
    src, out, query = tmp_path / "src", [], None
    src.mkdir()
    def sink(df, _):
        out.extend(tuple(r) for r in df.collect())
    def start():
        stream = job(spark.readStream.schema(schema).parquet(str(src)))
        return stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        for rows in batches:
            query = query or start()
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
            query.processAllAvailable()
            if restart:
                query.stop()
                query = None
    finally:
        if query:
            query.stop()
    return out


def test_session_dedup(spark, tmp_path):
    schema = "event_id long, session_id long, tool string, target string, ts timestamp"
    e = lambda i, s, tool="Edit", target="f": (i, 1, tool, target, at(s))
    first, second = [e(1, 0), e(2, 200), e(3, 400), e(4, 700), e(5, 1000, "Run")], [e(6, 2000), e(7, 100_000)]
    late = [e(8, 10)]
    batch = V.session_dedup(spark.createDataFrame(first + second, schema))
    want = sorted(r["event_id"] for r in batch.collect())
    assert want == [1, 4, 5, 6, 7]
    got = drive(spark, tmp_path, schema, [first, second, late, [e(9, 300_000)], [e(10, 400_000)]], V.session_dedup_stream)
    assert sorted(r[0] for r in got)[: len(want)] == want and 8 not in {r[0] for r in got}


def test_debounce(spark, tmp_path):
    schema = "profile string, tag string, ts timestamp"
    rows = [("p", "a", at(0)), ("p", "a", at(30)), ("p", "b", at(10)), ("p", "a", at(200))]
    want = sorted((r["tag"], r["fire_at"], r["n"]) for r in V.recompute_debounce(spark.createDataFrame(rows, schema)).collect())
    got = drive(spark, tmp_path, schema, [rows, [("p", "z", at(100_000))], [("p", "z", at(200_000))]], V.recompute_debounce_stream)
    assert sorted((r[1], r[2], r[3]) for r in got if r[1] != "z") == want


def opened(rows, length=1800):
    """Openers by one pass over each memory's sorted seconds."""
    out, start = [], {}
    for m, t in sorted(r for r in rows if None not in r):
        if m not in start or t >= start[m] + length:
            start[m] = t
            out.append((m, at(t)))
    return sorted(out)


def test_editing_batch(spark):
    """Pauses, slots' borders, repeats, times before 1970, and a hot memory that always has a window open."""
    import random

    dice = random.Random(7)
    rows = [(m, dice.randrange(-2_000_000_000, -1_999_000_000) if m == 3 else dice.choice((600, 1800, 3600)) * dice.randrange(40) + dice.choice((0, 0, 1, -1))) for m in range(6) for _ in range(60)]
    rows += [(9, 97 * i) for i in range(2500)] + [(None, 5), (5, None)]
    df = spark.createDataFrame([(m, None if t is None else at(t)) for m, t in rows], "memory_id long, ts timestamp")
    got = V.editing_windows(df)
    assert sorted((r[0], r[1]) for r in got.collect()) == opened(rows)
    assert got.filter("closes_at <> opened_at + INTERVAL 30 MINUTES").isEmpty()
    assert V.editing_windows(df.limit(0)).count() == 0


def test_editing(spark, tmp_path):
    """Windows open and close as in the batch form, over a restart and with a late row."""
    schema = "memory_id long, ts timestamp"
    rows = [(1, at(0)), (1, at(600)), (1, at(1799)), (1, at(1800)), (2, at(5))]
    want = sorted((r[0], r[1]) for r in V.editing_windows(spark.createDataFrame(rows, schema)).collect())
    assert want == [(1, at(0)), (1, at(1800)), (2, at(5))]
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        got = drive(spark, tmp_path, schema, [rows[:2], rows[2:], [(3, at(100_000))], [(1, at(700)), (3, at(100_001))]], V.editing_window_stream, restart=True)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)
    assert sorted((r[0], r[1]) for r in got if not r[3]) == [*want, (3, at(100_000))]
    assert sorted((r[0], r[1], r[2]) for r in got if r[3]) == [(m, t, t + dt.timedelta(minutes=30)) for m, t in want]


def test_ingest(spark, tmp_path):
    schema = "key string, ts timestamp, content string"
    rows = [("a", at(0), "1"), ("b", at(1), "2"), ("a", at(2), "again")]
    store = str(tmp_path / "store")
    src = spark.createDataFrame(rows, schema)
    for _ in range(2):  # a batch that is run again adds nothing
        V.store_new(src, store)
    assert sorted(r["key"] for r in spark.read.parquet(store).collect()) == ["a", "b"]
    got = drive(spark, tmp_path, schema, [rows[:1], rows[1:]], V.ingest_stream)
    assert sorted(r[0] for r in got) == ["a", "b"]


def test_gate(spark):
    rows = [("Edit", "we decided on api_key=abcdefgh1234", []), ("Edit", "plain", []), ("Read", "we decided", []), ("Edit", "plain", ["type:fact"])]
    got = V.capture_gate(spark.createDataFrame(rows, "tool string, content string, tags array<string>")).collect()
    assert sorted(r["content"] for r in got) == ["plain", "we decided on api_key=***MASKED***"]
    prompts = spark.createDataFrame([("what should we prefer in this case, really?",), ("I prefer tabs over spaces in this code",), ("short prefer",)], "content string")
    assert [r[0] for r in V.capture_prompts(prompts).collect()] == ["I prefer tabs over spaces in this code"]


def test_windows(spark, tmp_path):
    schema = "profile string, operation string, event_time timestamp"
    rows = [("p", "x", at(0)), ("p", "x", at(3599)), ("p", "x", at(3600))]
    got = drive(spark, tmp_path, schema, [rows, [("p", "y", at(100_000))], [("p", "y", at(200_000))]], V.audit_windows)
    assert sorted((r[1], r[4]) for r in got if r[1] == "x") == [("x", 1), ("x", 2)]
