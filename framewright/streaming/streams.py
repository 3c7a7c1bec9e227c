"""The same verbs on streams: windows, sessions, stateful scores, late rows and duplicates.

Streams are of frames with an event time ``ts`` (TIMESTAMP).  The stateful
operators keep a bounded state per key in the state store.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def frame_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 4) -> DataFrame:
    """Parquet files that arrive in a directory, a few at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def with_time(df: DataFrame) -> DataFrame:
    return df.withColumn("ts", F.timestamp_micros("ts_us"))


def tumbling_label(df: DataFrame, span: str, delay: str) -> DataFrame:
    """Messages, any-label and labelled share of tumbling windows."""
    w = df.withWatermark("ts", delay).groupBy(F.window("ts", span))
    return w.agg(F.count("*").alias("n_msgs"), F.max("label").alias("label_window"), F.sum("label").alias("n_attack")).select(F.unix_micros("window.start").alias("start_us"), "n_msgs", "label_window", "n_attack")


def sliding_id_count(df: DataFrame, span: str, stride: str, delay: str) -> DataFrame:
    w = df.withWatermark("ts", delay).groupBy(F.window("ts", span, stride), "can_id").agg(F.count("*").alias("n"))
    return w.select(F.unix_micros("window.start").alias("start_us"), "can_id", "n")


def session_bursts(df: DataFrame, gap: str, delay: str) -> DataFrame:
    """Bursts of attack messages of each file, ended by a gap."""
    s = df.where("label = 1").withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "source_file").agg(F.count("*").alias("n"))
    return s.select("source_file", F.unix_micros("session_window.start").alias("start_us"), "n")


def dedup(df: DataFrame, keys: list[str], delay: str) -> DataFrame:
    return df.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def enrich(df: DataFrame, intervals: DataFrame) -> DataFrame:
    """Stream-static labelling: one interval a file, a small dimension."""
    out = df.drop("label").join(intervals, "source_file", "left")
    return out.withColumn("label", F.coalesce(F.col("ts_us").between(F.col("start_us"), F.col("end_us")).cast("int"), F.lit(0))).drop("start_us", "end_us")


class InOrder(StatefulProcessor):
    """Takes the rows of a key in the order of (ts_us, idx_src), although they come in any order within the watermark's delay.

    Rows wait in a list state, chunk by chunk as they come.  A timer at the earliest of them fires once the
    watermark has passed it: rows behind the watermark are final and are taken, later ones wait on.  ``take`` gives
    the output of some rows and what the key has to hold of them; ``silence_us`` behind its last row a key is
    forgotten, by a timer, too.  In memory is what a key gets within the delay, never its whole batch history.
    """

    columns: tuple[str, ...] = ("ts_us", "idx_src")
    waiting = "ts_us bigint, idx_src bigint"
    holds = "last bigint, held array<bigint>"
    silence_us = 0
    seen: tuple | None = None

    def take(self, key, rows: list[tuple], held: list[int]) -> tuple[pd.DataFrame, list[int]]:
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", self.waiting)
        self.known = handle.getValueState("known", self.holds)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for chunk in rows:
            if len(chunk):
                self.pending.appendList([tuple(r) for r in chunk[list(self.columns)].to_numpy().tolist()])
                self._wake(int(chunk["ts_us"].min()))
        self.seen = None
        yield from ()

    def _wake(self, ts_us: int) -> None:
        self.handle.registerTimer(ts_us // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        if self.seen == (key, passed):
            return  # an earlier timer of the key took all that is final
        self.seen = (key, passed)
        rows = sorted(self.pending.get()) if self.pending.exists() else []
        final = [r for r in rows if r[0] <= passed]
        last, held = self.known.get() if self.known.exists() else (None, [])
        if final:
            if last is not None and final[0][0] - last > self.silence_us:
                held = []
            out, held = self.take(key, final, list(held))
            last = final[-1][0]
            self.known.update((last, held))
            if len(final) < len(rows):
                self.pending.put(rows[len(final) :])
            else:
                self.pending.clear()
            yield out
        if len(final) < len(rows):
            self._wake(rows[len(final)][0])
        elif last is not None and last + self.silence_us < passed:
            self.known.clear()
        elif last is not None:
            self._wake(last + self.silence_us)

    def close(self) -> None:
        pass


def _in_order(df: DataFrame, key: str, verb: InOrder, delay: str, out: str) -> DataFrame:
    return df.withWatermark("ts", delay).groupBy(key).transformWithStateInPandas(verb, outputStructType=out, outputMode="Append", timeMode="EventTime")


class RollingGrams(InOrder):
    """Holds the last n - 1 symbols of a trace; gives each message's n-gram once there are n."""

    columns = ("ts_us", "idx_src", "symbol")
    waiting = "ts_us bigint, idx_src bigint, symbol bigint"
    n = 3
    silence_us = 86_400_000_000

    def take(self, key, rows: list[tuple], held: list[int]) -> tuple[pd.DataFrame, list[int]]:
        symbols = held + [r[2] for r in rows]
        skip = len(held)
        grams = [" ".join(map(str, symbols[k - self.n + 1 : k + 1])) if k >= self.n - 1 else None for k in range(skip, len(symbols))]
        return pd.DataFrame({"source_file": key[0], "idx_src": [r[1] for r in rows], "gram": grams}), symbols[max(0, len(symbols) - self.n + 1) :]


def rolling_grams(df: DataFrame, delay: str = "1 hour") -> DataFrame:
    """n-grams of a stream with event time ``ts``, whose rows of a trace are out of order by the delay at most."""
    return _in_order(df, "source_file", RollingGrams(), delay, "source_file string, idx_src bigint, gram string")


def score_grams(grams: DataFrame, model: DataFrame) -> DataFrame:
    """1 for an n-gram of a stream that the model, a table of known ``gram``s, does not hold; 0 for known and unfinished ones."""
    known = model.select("gram", F.lit(1).alias("_seen"))
    return grams.join(known, "gram", "left").withColumn("score", F.when(F.col("gram").isNull() | F.col("_seen").isNotNull(), 0).otherwise(1)).drop("_seen")


class TrailingCounts(InOrder):
    """Holds the times of an id's messages within a span; gives how many lie in [t - span, t]."""

    span_us = 6 * 3_600_000_000
    silence_us = span_us

    def take(self, key, rows: list[tuple], held: list[int]) -> tuple[pd.DataFrame, list[int]]:
        t = np.array(held + [r[0] for r in rows], np.int64)
        first = np.searchsorted(t, t - self.span_us)
        counts = np.arange(1, len(t) + 1) - first
        return pd.DataFrame({"idx_src": [r[1] for r in rows], "trailing": counts[len(held) :]}), t[first[-1] :].tolist()


#: State keys that the ids of a stream are dealt to: a key costs several calls a batch, whatever its rows.
BUCKETS = 512


class BucketCounts(TrailingCounts):
    """The same for all ids of a bucket at once; holds (id, time) pairs of the last span, one after the other."""

    columns = ("ts_us", "idx_src", "can_id")
    waiting = "ts_us bigint, idx_src bigint, can_id bigint"

    def take(self, key, rows: list[tuple], held: list[int]) -> tuple[pd.DataFrame, list[int]]:
        old, new = np.array(held, np.int64).reshape(-1, 2), np.array(rows, np.int64)
        both = np.concatenate([old, new[:, [2, 0]]])  # in the order of time
        by = np.argsort(both[:, 0], kind="stable")
        t = both[by, 1] - both[:, 1].min()
        start = np.unique(both[by, 0], return_inverse=True)[1] * (t.max() + 1)  # ids apart, times in order within each
        counts = np.empty(len(both), np.int64)
        counts[by] = np.arange(1, len(both) + 1) - np.searchsorted(start + t, start + np.maximum(t - self.span_us, 0))
        return pd.DataFrame({"idx_src": new[:, 1], "trailing": counts[len(old) :]}), both[both[:, 1] >= new[-1, 0] - self.span_us].ravel().tolist()


def trailing_counts(df: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Trailing counts of a stream with event time ``ts``, whose rows are out of order by the delay at most; ids share ``BUCKETS`` states."""
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64("can_id"), F.lit(BUCKETS)))
    return _in_order(dealt, "_bucket", BucketCounts(), delay, "idx_src bigint, trailing bigint")


def run_to_table(df: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there, and gives its result as a table.

    Appended rows are written as Parquet; in complete mode each batch replaces
    the table.
    """
    spark = df.sparkSession
    out, check = f"{path}/out", f"{path}/checkpoint"
    if mode == "complete":
        query = df.writeStream.outputMode("complete").option("checkpointLocation", check).trigger(availableNow=True).foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(out)).start()
    else:
        query = df.writeStream.outputMode(mode).option("checkpointLocation", check).trigger(availableNow=True).format("parquet").start(out)
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)
