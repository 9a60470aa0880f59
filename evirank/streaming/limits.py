"""Rate limits, retention, incremental ingest and progressive results, as batch operators and on streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues
from pyspark.sql.window import Window

from ..functions.digest import table_fingerprint
from ..functions.scratch import materialize


def arrivals(events: DataFrame, key: str, ts: str, window_s: int = 3600) -> DataFrame:
    """in_window: the arrivals of the key in (ts - window, ts], later rows of the same instant included."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(key).orderBy("__us").rangeBetween(-(window_s * 1_000_000 - 1), 0)
    return events.withColumn("__us", micros).withColumn("in_window", F.count("*").over(w)).drop("__us")


class Limiter:
    """Accepted requests of one key, oldest first.  One counts while its time is after now - window."""

    def __init__(self, limit: int, window_us: int, accepted: list[int] | None = None):
        self.limit, self.window, self.accepted = limit, window_us, list(accepted or [])

    def admit(self, now: int) -> tuple[bool, float]:
        """Whether it is accepted, and else after how many seconds to try again."""
        self.accepted = [t for t in self.accepted if t > now - self.window]
        if len(self.accepted) < self.limit:
            self.accepted.append(now)
            return True, 0.0
        return False, (self.accepted[0] + self.window - now) / 1e6


def rate_limited(events: DataFrame, key: str, ts: str, tie: str, limit: int = 20, window_s: int = 3600) -> DataFrame:
    """key, tie, ts, accepted, retry_after: only accepted requests use up the limit, so each key is one sequence."""
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    spec = f"{key} {kinds[key]}, {tie} {kinds[tie]}, us long, accepted boolean, retry_after double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["us", tie])
        limiter = Limiter(limit, window_s * 1_000_000)
        got = [limiter.admit(int(t)) for t in pdf["us"]]
        return pdf.assign(accepted=[a for a, _ in got], retry_after=[r for _, r in got])

    rows = events.select(key, tie, F.unix_micros(F.col(ts).cast("timestamp")).alias("us"))
    out = rows.groupBy(key).applyInPandas(run, spec)
    return out.select(key, tie, F.timestamp_micros("us").alias(ts), "accepted", "retry_after")


def use_state_timers(spark: SparkSession) -> None:
    """Streams with timers keep their state in RocksDB; a provider that the session names already stays."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(name, ""):
        spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _tick(us: int) -> int:
    """The first watermark, in milliseconds, at which no row of that time can arrive any more."""
    return -(-us // 1000)


class _InOrder(StatefulProcessor):
    """Holds a key's requests until the watermark has passed them, then admits them in the order of their times.  What
    arrives together is one entry of the state, not one a request."""

    def __init__(self, key: str, tie: str, tie_type: T.DataType, limit: int, window_us: int):
        self.key, self.tie, self.tie_type, self.limit, self.window = key, tie, tie_type, limit, window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", T.StructType().add("us", T.ArrayType(T.LongType())).add("tie", T.ArrayType(self.tie_type)))
        self.accepted = handle.getValueState("accepted", T.StructType().add("times", T.ArrayType(T.LongType())))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            us = pdf["us"].astype("int64").tolist()
            self.pending.appendValue((us, pdf[self.tie].tolist()))
            first = min(us if first is None else [first, *us])
        if first is not None:
            self.handle.registerTimer(_tick(first))
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        held = [(int(us), tie) for times, ties in self.pending.get() for us, tie in zip(times, ties, strict=True)]
        ready, rest = sorted(r for r in held if r[0] <= now), [r for r in held if r[0] > now]
        limiter = Limiter(self.limit, self.window, list(self.accepted.get()[0]) if self.accepted.exists() else [])
        got = [(*key, tie, us, *limiter.admit(us)) for us, tie in ready]
        if ready:
            self.pending.put([tuple(map(list, zip(*rest, strict=True)))]) if rest else self.pending.clear()
        live = [t for t in limiter.accepted if t > now - self.window]  # a later request cannot be earlier than now
        self.accepted.update((live,)) if live else self.accepted.clear()
        if rest:
            self.handle.registerTimer(_tick(min(us for us, _ in rest)))
        elif live:
            self.handle.registerTimer(_tick(live[-1] + self.window))
        if got:
            yield pd.DataFrame(got, columns=[self.key, self.tie, "us", "accepted", "retry_after"])

    def close(self) -> None:
        pass


def rate_limited_stream(events: DataFrame, key: str, ts: str, tie: str, limit: int = 20, window_s: int = 3600, late_s: int = 600) -> DataFrame:
    """The same on a stream, row for row, in whatever order the requests arrive.

    A request is decided when the watermark passes it: event-time timers hold it back for ``late_s`` seconds of event time,
    and requests that arrive later than that are dropped.  A key's state is its undecided requests and the accepted ones of
    one window; it goes when a window has passed without requests.  Rows without a time are left out."""
    use_state_timers(events.sparkSession)
    kinds = {f.name: f.dataType for f in events.schema}
    times = F.col(ts).cast("timestamp")
    rows = events.select(key, tie, times.alias(ts)).where(F.col(ts).isNotNull()).withWatermark(ts, f"{late_s} seconds").withColumn("us", F.unix_micros(ts))
    out = T.StructType([T.StructField(key, kinds[key]), T.StructField(tie, kinds[tie])]).add("us", "long").add("accepted", "boolean").add("retry_after", "double")
    processor = _InOrder(key, tie, kinds[tie], limit, window_s * 1_000_000)
    found = rows.groupBy(key).transformWithStateInPandas(processor, out, "Append", "EventTime")
    return found.select(key, tie, F.timestamp_micros("us").alias(ts), "accepted", "retry_after")


class _Retention(StatefulProcessor):
    """Holds the last time of a key until its time to live has passed."""

    def __init__(self, key: str, ttl_us: int):
        self.key, self.ttl = key, ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", T.StructType().add("us", "long"))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        newest = max([int(pdf["us"].max()) for pdf in rows], default=None)
        known = self.last.get()[0] if self.last.exists() else None
        if newest is not None and (known is None or newest > known):
            self.last.update((newest,))
            self.handle.registerTimer(_tick(newest + self.ttl))
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        # a timer of an earlier time of the key has nothing to do
        if self.last.exists() and _tick(self.last.get()[0] + self.ttl) <= timerValues.getCurrentWatermarkInMs():
            us = int(self.last.get()[0])
            self.last.clear()
            yield pd.DataFrame([(*key, us)], columns=[self.key, "us"])

    def close(self) -> None:
        pass


def expired_stream(rows: DataFrame, key: str, ts: str, ttl_s: int = 7200, late_s: int = 600) -> DataFrame:
    """key, ts, expired_at: each key once the watermark passes its last time by ``ttl_s`` seconds.  A newer row of a key
    before that puts its end off; one after it begins anew.  The state of a key is one number, until it has expired."""
    use_state_timers(rows.sparkSession)
    times = rows.select(key, F.col(ts).cast("timestamp").alias(ts)).where(F.col(ts).isNotNull()).withWatermark(ts, f"{late_s} seconds").withColumn("us", F.unix_micros(ts))
    out = T.StructType([T.StructField(key, rows.schema[key].dataType)]).add("us", "long")
    found = times.groupBy(key).transformWithStateInPandas(_Retention(key, ttl_s * 1_000_000), out, "Append", "EventTime")
    return found.select(key, F.timestamp_micros("us").alias(ts), F.timestamp_micros(F.col("us") + ttl_s * 1_000_000).alias("expired_at"))


def expired(rows: DataFrame, ts: str, ttl_s: int = 7200, now: str | None = None) -> DataFrame:
    """Rows whose age has reached the time to live; now: a timestamp literal, else the current time."""
    at = F.lit(now).cast("timestamp") if now else F.current_timestamp()
    return rows.where(F.col(ts).cast("timestamp") + F.expr(f"interval {ttl_s} seconds") <= at)


def _batch(rows: DataFrame, path: str, batch: str) -> None:
    """One batch of a table, as a whole: what an earlier try of it left is replaced."""
    rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch}")


def _batches(spark: SparkSession, path: str) -> DataFrame | None:
    """A table of batches; None before the first."""
    try:
        return spark.read.parquet(path).withColumn("batch_id", F.col("batch_id").cast("string"))
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def ingest_unseen(ids: DataFrame, column: str, ledger: str, process: Callable[[DataFrame], DataFrame], target: str, batch: str | None = None) -> None:
    """Process ids that the ledger lacks, add their rows, then enter them all, also those without rows.

    Each call is one batch of both tables and can be repeated: ids that only this batch entered are processed again, and its
    rows replace themselves.  ``batch``: a name that a retry has again (a stream's batch number); without one it follows
    from the ids.  Read the rows with ``ingested``, which leaves out batches that were not finished."""
    spark = ids.sparkSession
    fresh, done = ids.select(column).where(F.col(column).isNotNull()).distinct(), _batches(spark, ledger)
    if done is not None:
        others = done if batch is None else done.where(F.col("batch_id") != batch)
        fresh = fresh.join(others.select(column), column, "left_anti")
    if batch is None:
        if fresh.isEmpty():
            return
        batch = f"b{table_fingerprint(fresh)[:32]}"
    fresh = materialize(fresh, "fresh")  # the ledger that it was taken from changes below
    _batch(process(fresh), target, batch)
    _batch(fresh, ledger, batch)


def ingested(spark: SparkSession, ledger: str, target: str) -> DataFrame:
    """The rows of all finished batches."""
    rows, done = _batches(spark, target), _batches(spark, ledger)
    if rows is None or done is None:
        raise ValueError(f"nothing was ingested into {target}")
    return rows.join(done.select("batch_id").distinct(), "batch_id", "left_semi").drop("batch_id")


def _stream_batch(batch: DataFrame, number: int) -> str:
    """A name that a repeated micro-batch has again, and a batch of another checkpoint has not."""
    stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "stream"
    return f"s{stream}-{number}"


def ingest_stream(files: DataFrame, column: str, ledger: str, process: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """The same for a stream of files: each micro-batch is one ingest; everything there now, then it ends."""
    return (
        files.writeStream.foreachBatch(lambda batch, n: ingest_unseen(batch, column, ledger, process, target, _stream_batch(batch, n)))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def progressive(asked: DataFrame, compute: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, column: str = "qseqid") -> StreamingQuery:
    """Results that grow while a job runs: each micro-batch of asked queries is computed and added below ``path``, then
    entered as finished.  It takes what is there now and ends; started again from the same checkpoint it goes on where it
    stopped, and a batch that was cut off replaces itself, so every query's rows are there once."""

    def run(batch: DataFrame, number: int) -> None:
        name = _stream_batch(batch, number)
        new = materialize(batch.select(column).where(F.col(column).isNotNull()).distinct(), "asked")
        known = _batches(batch.sparkSession, f"{path}/finished")
        if known is not None:  # a query that is asked again has its rows
            new = new.join(known.where(F.col("batch_id") != name).select(column), column, "left_anti")
        new = materialize(new, "asked")
        _batch(compute(new), f"{path}/results", name)
        _batch(new, f"{path}/finished", name)

    return asked.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def results_so_far(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all finished queries."""
    return ingested(spark, f"{path}/finished", f"{path}/results")


def progress(spark: SparkSession, path: str, asked: DataFrame, column: str = "qseqid") -> DataFrame:
    """One row: n_asked, n_finished and share of the asked queries, as a client polls it."""
    done = _batches(spark, f"{path}/finished")
    wanted = asked.select(column).where(F.col(column).isNotNull()).distinct()
    marked = wanted.withColumn("__done", F.lit(False)) if done is None else wanted.join(done.select(column, F.lit(True).alias("__done")).distinct(), column, "left")
    counts = marked.agg(F.count("*").alias("n_asked"), F.count_if(F.coalesce("__done", F.lit(False))).alias("n_finished"))
    return counts.withColumn("share", F.when(F.col("n_asked") > 0, F.col("n_finished") / F.col("n_asked")).otherwise(1.0))
