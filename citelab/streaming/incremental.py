"""Bounded incremental runs and streams: resume, retries' pacing, circuit breakers, windows over events."""

from __future__ import annotations

import contextlib
import itertools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Pacing of calls and the breaker's limit.
ADAPT_UP, ADAPT_DOWN, ADAPT_WINDOW, BREAKER = 1.5, 0.85, 8, 20


def pending(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What is still to do: wanted keys without a result."""
    return wanted.join(done.select(*keys), keys, "left_anti")


def run_available(source: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """All input there is, once; a rerun with the same checkpoint takes only what is new."""
    q = source.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


class Pacer:
    """The delay between calls of one engine and its circuit breaker, call by call.

    A failure makes the delay longer (up to most). A success makes it shorter (down to start) if all of the last `window` calls,
    itself among them, went well: once a window is clean, every further success does. `limit` failures in a row with
    the same signature trip the breaker, which stays tripped."""

    def __init__(self, start: float, most: float, up: float = ADAPT_UP, down: float = ADAPT_DOWN, window: int = ADAPT_WINDOW, limit: int = BREAKER) -> None:
        self.start, self.most, self.up, self.down, self.window, self.limit = start, most, up, down, window, limit
        self.delay, self.clean, self.row, self.signature, self.tripped_at = start, 0, 0, None, None

    def call(self, seq: int, signature: str | None) -> float:
        """signature: that of a failure, null for a success."""
        if signature is None:
            self.clean, self.row, self.signature = min(self.window, self.clean + 1), 0, None
            if self.clean == self.window:
                self.delay = max(self.start, self.delay * self.down)
        else:
            self.clean, self.row = 0, self.row + 1 if signature == self.signature else 1
            self.signature, self.delay = signature, min(self.most, self.delay * self.up)
            if self.row >= self.limit and self.tripped_at is None:
                self.tripped_at = seq
        return self.delay


def pace(outcomes: Iterable[bool], start: float, most: float, up: float = ADAPT_UP, down: float = ADAPT_DOWN, window: int = ADAPT_WINDOW) -> Iterator[float]:
    """The delay after each call."""
    pacer = Pacer(start, most, up, down, window)
    for ok in outcomes:
        yield pacer.call(0, None if ok else "failed")


def stretches(calls: DataFrame, by: str, order: str, value: Column, about: str, summary: Callable[[np.ndarray, list], tuple]) -> DataFrame:
    """(engine_, first, calls and what `about` names): a row for each engine and partition of its calls.

    Calls are range-partitioned by engine and order, so one engine's calls are dealt over tasks. summary(orders, values) tells what a stretch of
    calls of one engine, in their order, does to any state that it may find; whoever asks folds an engine's stretches, which are as many as
    partitions at most."""
    kind = T.StructType.fromDDL(f"engine_ binary, first long, calls long, {about}")
    types = to_arrow_schema(kind)

    def run(batches):
        name, seqs, held = None, [], []

        def out():
            at = np.concatenate(seqs)
            row = (name, int(at[0]), len(at), *summary(at, list(itertools.chain.from_iterable(held))))
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, types, strict=True)], schema=types)

        for batch in batches:
            if not batch.num_rows:
                continue
            engines, order_, values = (batch.column(i) for i in range(3))
            coded = engines.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(coded[1:] != coded[:-1]) + 1).tolist(), len(coded)]
            for s, e in itertools.pairwise(edges):
                this = engines[s].as_py()
                if held and this != name:
                    yield out()
                    seqs, held = [], []
                name = this
                seqs.append(order_.slice(s, e - s).to_numpy(zero_copy_only=False))
                held.append(values.slice(s, e - s).to_pylist())
        if held:
            yield out()

    rows = calls.select(F.col(by).cast("string").cast("binary").alias("e"), F.col(order).cast("long").alias("s"), value.alias("v"))
    return rows.repartitionByRange("e", "s").sortWithinPartitions("e", "s").mapInArrow(run, kind)


def final_delays(calls: DataFrame, start: float, most: float, by: str = "engine", order: str = "seq", ok: str = "ok") -> DataFrame:
    """(by, calls, delay): pace() over the calls of each engine in their order.

    What a stretch of calls does to a delay is `least(high, greatest(low, factor * delay))` whatever the delay is, and stretches join
    associatively; only the successes before its first failure depend on what came before."""
    up, down, window = ADAPT_UP, ADAPT_DOWN, ADAPT_WINDOW

    def summary(_, outcomes: list) -> tuple:
        ok = np.array(outcomes, bool)
        bad = np.flatnonzero(~ok)
        factor, low, high = 1.0, 0.0, float("inf")
        for well in np.diff(np.append(bad, len(ok))).tolist():  # each failure and the successes behind it
            factor, low, high = factor * up, min(most, low * up), min(most, high * up)
            if well > window:  # `well` counts the failure; from the window's last success on each one eases
                eased = down ** (well - window)
                factor, low, high = factor * eased, max(start, low * eased), max(start, high * eased)
        return int(bad[0]) if len(bad) else len(ok), not len(bad), factor, low, high, int(len(ok) - 1 - bad[-1]) if len(bad) else len(ok)

    parts = stretches(calls, by, order, F.coalesce(ok, F.lit(False)), "lead long, whole boolean, factor double, low double, high double, trail long", summary)
    each = parts.groupBy("engine_").agg(F.sum("calls").alias("calls"), F.array_sort(F.collect_list(F.struct("first", "lead", "whole", "factor", "low", "high", "trail"))).alias("p"))

    def step(acc, x):
        eased = F.greatest(F.lit(0), F.least(x["lead"], x["lead"] + acc["clean"] - (window - 1)))
        led = F.when(eased > 0, F.greatest(F.lit(float(start)), acc["delay"] * F.pow(F.lit(down), eased))).otherwise(acc["delay"])
        after = F.when(x["whole"], led).otherwise(F.least(x["high"], F.greatest(x["low"], x["factor"] * led)))
        return F.struct(after.alias("delay"), F.when(x["whole"], acc["clean"] + x["lead"]).otherwise(x["trail"]).alias("clean"))

    zero = F.struct(F.lit(float(start)).alias("delay"), F.lit(0).cast("long").alias("clean"))
    return each.select(F.col("engine_").cast("string").cast(calls.schema[by].dataType).alias(by), "calls", F.aggregate("p", zero, step)["delay"].alias("delay"))


def breaker_trips(calls: DataFrame, by: str = "engine", order: str = "seq", signature: str = "signature", limit: int = BREAKER) -> DataFrame:
    """The first call of each engine at which `limit` failures with the same signature have followed each other.
    signature is null for a success.

    A stretch tells its first and last run of equal signatures, and where a run that begins within it trips; a run that goes on
    from the stretch before trips at one of the first run's calls."""

    def summary(at: np.ndarray, signatures: list) -> tuple:
        runs, place = [], 0
        for s, group in itertools.groupby(signatures):
            n = sum(1 for _ in group)
            runs.append((s, place, n))
            place += n
        inner = next(((int(at[p + limit - 1]), s) for s, p, n in runs[1:] if s is not None and n >= limit), (None, None))
        (head, _, n), (tail, _, m) = runs[0], runs[-1]
        return head, n, at[: min(n, limit)].tolist(), *inner, tail, m, len(runs) == 1

    about = "head string, n long, head_at array<bigint>, inner_at long, inner string, tail string, m long, whole boolean"
    parts = stretches(calls, by, order, F.col(signature).cast("string"), about, summary)
    fields = ("first", "head", "n", "head_at", "inner_at", "inner", "tail", "m", "whole")
    each = parts.groupBy("engine_").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("p"))

    def step(acc, x):
        before = F.when(acc["signature"] == x["head"], acc["n"]).otherwise(F.lit(0).cast("long"))  # a success goes on from nothing
        need = limit - before
        led = F.when(x["head"].isNotNull() & (need >= 1) & (need <= x["n"]), F.try_element_at(x["head_at"], need.cast("int")))
        at = F.coalesce(acc["at"], led, x["inner_at"])
        name = F.when(acc["at"].isNotNull(), acc["name"]).when(led.isNotNull(), x["head"]).otherwise(x["inner"])
        run = F.when(x["whole"], F.when(x["head"].isNotNull(), before + x["n"]).otherwise(0)).otherwise(F.when(x["tail"].isNotNull(), x["m"]).otherwise(0))
        return F.struct(at.alias("at"), name.alias("name"), x["tail"].alias("signature"), run.cast("long").alias("n"))

    none = lambda kind: F.lit(None).cast(kind)
    zero = F.struct(none("long").alias("at"), none("string").alias("name"), none("string").alias("signature"), F.lit(0).cast("long").alias("n"))
    got = each.select(F.col("engine_").cast("string").cast(calls.schema[by].dataType).alias(by), F.aggregate("p", zero, step).alias("t"))
    return got.where("t.at is not null").select(by, F.col("t.name").alias(signature), F.col("t.at").alias("tripped_at"))


#: What a breaker and its pacing remember of an engine, and what they say of it after each batch.
STATE = "calls long, failures long, delay double, clean int, row int, signature string, tripped_at long"
OUT = "engine string, calls long, failures long, delay double, tripped_at long"


class Watch(StatefulProcessor):
    """One state for each engine; the calls of a batch are taken in their order."""

    def __init__(self, start: float, most: float, limit: int) -> None:
        self.settings = start, most, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("engine", STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        start, most, limit = self.settings
        pacer, calls, failures = Pacer(start, most, limit=limit), 0, 0
        if (known := self.state.get()) is not None:
            calls, failures, pacer.delay, pacer.clean, pacer.row, pacer.signature, pacer.tripped_at = known
        for seq, signature in sorted(((r.seq, r.signature) for r in rows), key=lambda call: call[0]):
            pacer.call(seq, signature)
            calls, failures = calls + 1, failures + (signature is not None)
        self.state.update((calls, failures, pacer.delay, pacer.clean, pacer.row, pacer.signature, pacer.tripped_at))
        yield Row(engine=key[0], calls=calls, failures=failures, delay=pacer.delay, tripped_at=pacer.tripped_at)

    def close(self) -> None:
        pass


def watch_calls(calls: DataFrame, limit: int = BREAKER, start: float = 0.5, most: float = 30.0) -> DataFrame:
    """A stream of calls (engine, seq, signature) as the state of each engine's pacing and breaker after each batch that has
    calls of it. States are kept in the state store, so the query needs `spark.sql.streaming.stateStore.providerClass` for RocksDB (with_states())."""
    return calls.groupBy("engine").transformWithState(Watch(start, most, limit), OUT, "update", "none")


@contextlib.contextmanager
def with_states(spark: SparkSession):
    """A state store that queries with several kinds of state need, for the queries started within."""
    name, provider = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name, None)
    spark.conf.set(name, provider)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def watched(calls: DataFrame, batches: str, folder: str, limit: int = BREAKER, start: float = 0.5, most: float = 30.0) -> DataFrame:
    """watch_calls() over what is there, as a stream: calls are written as one set of files for each value of `batches` in order, and the stream
    goes on from its checkpoint for each set, whatever number of files it has; the last state of each engine."""
    spark = calls.sparkSession

    def keep(batch: DataFrame, k: int) -> None:
        batch.withColumn("batch", F.lit(k).cast("long")).write.mode("overwrite").parquet(f"{folder}/states/batch={k}")

    with with_states(spark):
        for k in sorted(r[0] for r in calls.select(batches).distinct().collect()):
            calls.where(F.col(batches) == k).select("engine", "seq", "signature").write.mode("append").parquet(f"{folder}/calls")
            stream = spark.readStream.schema("engine string, seq long, signature string").parquet(f"{folder}/calls")
            q = watch_calls(stream, limit, start, most).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
            q.awaitTermination()
    states = spark.read.schema(f"{OUT}, batch long").parquet(f"{folder}/states")
    return states.groupBy("engine").agg(F.max_by(F.struct("calls", "failures", "delay", "tripped_at"), "batch").alias("s"), F.count("*").alias("batches")).select("engine", "s.*", "batches")


def event_windows(events: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and sums by event time and type, with a watermark; ts may be without a time zone."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", length, slide) if slide else F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def without_repeats(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """A folder of event files as a stream, with the schema of what is there."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
