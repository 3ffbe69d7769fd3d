"""Resume, pacing, breakers and windows."""

import pytest
from pyspark.sql import functions as F

from citelab.streaming import incremental as I


def test_pending(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k long"), spark.createDataFrame([(1,)], "k long")
    assert [r.k for r in I.pending(a, b, ["k"]).collect()] == [2]


def test_pace():
    assert list(I.pace([False, False], 1, 2)) == [1.5, 2]
    assert list(I.pace([False] + [True] * 8, 1, 10))[-1] == 1.5 * 0.85
    assert list(I.pace([True] * 16, 1, 10)) == [1] * 16


def test_breaker(spark):
    rows = [("a", i, "429") for i in range(3)] + [("b", 0, "429"), ("b", 1, None), ("b", 2, "429"), ("b", 3, "429"), ("c", 0, "429"), ("c", 1, "500"), ("c", 2, "429")]
    df = spark.createDataFrame(rows, "engine string, seq long, signature string")
    assert [tuple(r) for r in I.breaker_trips(df, limit=3).collect()] == [("a", "429", 2)]


def test_runs_once_and_resumes(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("src", "out", "cp"))
    seen = []

    def sink(df, batch):
        seen.append(df.count())
        df.write.mode("append").parquet(out)

    for part in (range(3), range(3, 5)):
        spark.createDataFrame([(i, "x") for i in part], "event_id long, event_type string").write.mode("append").parquet(src)
        I.run_available(I.event_stream(spark, src), sink, cp)
    assert sum(seen) == 5 and spark.read.parquet(out).count() == 5


def test_state_of_calls(spark, tmp_path):
    src, name = str(tmp_path / "calls"), "watched"
    rows = [("a", i, "429") for i in range(3)] + [("b", i, None) for i in range(4)]
    spark.createDataFrame(rows, "engine string, seq long, signature string").write.parquet(src)
    with I.with_states(spark):
        q = I.watch_calls(I.event_stream(spark, src), limit=3).writeStream.format("memory").queryName(name).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = {r.engine: r for r in spark.table(name).collect()}
    assert got["a"].tripped_at == 2 and got["a"].failures == 3 and got["a"].delay == 0.5 * 1.5**3 and got["b"].tripped_at is None


def test_windows_on_a_stream(spark, tmp_path):
    src = str(tmp_path / "e")
    df = spark.createDataFrame([(1, "2024-01-01 00:10:00", 1, "view", 1.0), (1, "2024-01-01 00:10:00", 1, "view", 1.0), (2, "2024-01-01 02:10:00", 1, "view", 2.0)], "event_id long, ts string, user_id long, event_type string, value double")
    df.withColumn("ts", F.to_timestamp_ntz("ts")).write.parquet(src)
    stream = I.without_repeats(I.event_stream(spark, src))
    q = stream.writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("once").count() == 2
    w = I.event_windows(spark.table("once"), "1 hour").collect()
    assert sorted(r.value for r in w) == [1.0, 2.0]
    assert I.event_windows(spark.table("once"), "2 hours", "1 hour").count() == 4
    assert I.sessions(spark.table("once"), "30 minutes").count() == 2


def slow_pace(outcomes, start, most):
    """The rule as it is told: the last eight outcomes in a list that nothing clears."""
    delay, recent, out = start, [], []
    for ok in outcomes:
        recent = [*recent, ok][-8:]
        if not ok:
            delay = min(delay * 1.5, most)
        elif len(recent) == 8 and all(recent):
            delay = max(delay * 0.85, start)
        out.append(delay)
    return out


def test_every_success_after_a_clean_window_eases():
    import random

    rng = random.Random(4)
    assert list(I.pace([False] * 3 + [True] * 10, 1, 10))[-4:] == slow_pace([False] * 3 + [True] * 10, 1, 10)[-4:] == pytest.approx([1.5**3 * 0.85**k for k in range(4)])
    for p in (0.05, 0.3):
        calls = [rng.random() > p for _ in range(400)]
        assert list(I.pace(calls, 0.5, 30)) == slow_pace(calls, 0.5, 30)


def test_delays_of_stretches_join(spark):
    """Whatever the number of partitions, also with one engine that has most calls."""
    import random

    rng = random.Random(7)
    calls = {"a": [rng.random() > 0.06 for _ in range(3000)], "b": [True] * 30, "c": [False] * 40, "d": [False] * 9 + [True] * 7, "e": [rng.random() > 0.5 for _ in range(60)]}
    rows = [(e, i * 3, ok) for e, v in calls.items() for i, ok in enumerate(v)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "engine string, seq long, ok boolean")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for n in (1, 13):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = {r.engine: (r.calls, r.delay) for r in I.final_delays(df, 0.5, 30.0).collect()}
        spark.conf.set("spark.sql.shuffle.partitions", before)
        assert got.keys() == calls.keys()
        for e, v in calls.items():
            assert got[e][0] == len(v) and abs(got[e][1] - slow_pace(v, 0.5, 30.0)[-1]) < 1e-9
    assert I.final_delays(df.limit(0), 0.5, 30.0).count() == 0


def test_states_are_kept_between_batches(spark, tmp_path):
    """A run of failures and a clean window that begin in one batch and end in the next."""
    a = [None] * 3 + ["429"] * 2 + ["429"] * 2 + [None] * 9
    b = ["500", "429", "500", None]
    rows = [("a", i, s, int(i >= 5)) for i, s in enumerate(a)] + [("b", i, s, 0) for i, s in enumerate(b)]
    df = spark.createDataFrame(rows, "engine string, seq long, signature string, part int")
    got = {r.engine: r for r in I.watched(df, "part", str(tmp_path), limit=4, start=1.0).collect()}
    assert (got["a"].calls, got["a"].failures, got["a"].tripped_at, got["a"].batches) == (16, 4, 6, 2)
    assert (got["b"].calls, got["b"].failures, got["b"].tripped_at, got["b"].batches) == (4, 3, None, 1)
    assert got["a"].delay == slow_pace([s is None for s in a], 1.0, 30.0)[-1] and got["b"].delay == 1.5**3


def test_a_set_of_calls_may_be_many_files(spark, tmp_path):
    """Each set is written by all tasks that hold calls of it, not by one, and still is one batch of the stream."""
    rows = [(f"e{i % 7}", i, "429" if i % 3 else None, i // 100) for i in range(200)]
    df = spark.createDataFrame(rows, "engine string, seq long, signature string, part int").repartition(4)
    got = {r.engine: r for r in I.watched(df, "part", str(tmp_path), limit=50).collect()}
    assert all((r.batches, r.calls, r.failures) == (2, sum(x[0] == e for x in rows), sum(x[0] == e and x[2] is not None for x in rows)) for e, r in got.items()) and len(got) == 7
    assert len(list((tmp_path / "calls").glob("*.parquet"))) > 2


def test_breakers_of_stretches_join(spark):
    """Runs that begin in one partition and trip in another, against a plain walk."""
    import random

    rng = random.Random(12)
    calls = {e: [rng.choice([None, "429", "429", "429", "500"]) if rng.random() < 0.3 else "429" for _ in range(n)] for e, n in (("a", 900), ("b", 40), ("c", 7))}
    calls |= {"d": ["429"] * 30, "e": [None] * 30, "f": ["429"] * 3 + ["500"] * 4, "g": ["429"] * 3 + [None] + ["429"] * 4}

    def walk(signatures, limit):
        n, last = 0, None
        for i, s in enumerate(signatures):
            n = 0 if s is None else n + 1 if s == last else 1
            last = s
            if n == limit:
                return s, i * 2
        return None

    rows = [(e, i * 2, s) for e, v in calls.items() for i, s in enumerate(v)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "engine string, seq long, signature string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for parts in (1, 17):
        for limit in (1, 4, 20):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got = {r.engine: (r.signature, r.tripped_at) for r in I.breaker_trips(df, limit=limit).collect()}
            spark.conf.set("spark.sql.shuffle.partitions", before)
            assert got == {e: t for e, v in calls.items() if (t := walk(v, limit))}
    assert I.breaker_trips(df.limit(0)).count() == 0
