"""Queries of the streaming forms: bridge rows are written as files of one day each and streamed in order."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import bridge
from ..registry import Registry
from ..scratch import scratch
from ..streaming import streams as X

R = Registry()
WITH = "WITH " + bridge.DUCK + " "
HOUR = 3_600_000_000


STATE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream(spark, sf, files=4, twice=False, per_trigger=100):
    """The frames as a stream of Parquet files in time order."""
    df = bridge.frames(spark, sf)
    path = scratch(spark, "stream")
    rows = df.unionByName(df.where("idx_src % 10 = 0")) if twice else df
    rows.repartitionByRange(files, "ts_us", "idx_src").sortWithinPartitions("ts_us", "idx_src").write.parquet(path)
    return X.with_time(X.frame_stream(spark, path, df.schema, per_trigger))


def with_state_store(spark):
    """A session of its own for stateful streams, so that the caller's settings stay as they are."""
    own = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if own.conf.isModifiable(name) and own.conf.get(name, None) != value:
            own.conf.set(name, value)
    own.conf.set(STATE, ROCKS)
    return own


def in_two_runs(spark, sf, verb, columns, late=False):
    """A stateful verb over the first days, and after a restart from its checkpoint over the days that arrived since; with ``late`` the first days arrive last."""
    df = bridge.frames(spark, sf)
    path, table = scratch(spark, "stream"), scratch(spark, "table")
    own = with_state_store(spark)
    parts = (f"source_file < '{bridge.TRAIN_BEFORE}'", f"source_file >= '{bridge.TRAIN_BEFORE}'")
    for part in reversed(parts) if late else parts:
        df.where(part).select(*columns).write.mode("append").parquet(path)
        out = X.run_to_table(verb(X.frame_stream(own, path, df.select(*columns).schema, 1_000_000)), table)
    return spark.read.schema(out.schema).parquet(f"{table}/out")


#: Arrival of the sixths of the time: pairs of them are out of order.
ARRIVAL = (0, 2, 1, 3, 5, 4)


def out_of_order(spark, sf, verb, columns):
    """A stateful verb over sixths of the time, some of which arrive before earlier ones, a few files a batch.

    The delay of the watermark covers that disorder.  In a second run, after a restart, a message of a later month
    moves the watermark behind all others, so that all results are final.
    """
    df = bridge.frames(spark, sf).withColumn("symbol", F.col("can_id") % 12)
    span = df.agg(F.min("ts_us").alias("a"), F.max("ts_us").alias("b")).first()  # two numbers
    sixth = F.least(F.floor((F.col("ts_us") - span.a) * 6 / (span.b - span.a + 1)), F.lit(5))
    path, table = scratch(spark, "stream"), scratch(spark, "table")
    own, delay = with_state_store(spark), f"{(span.b - span.a) // 2_000_000 + 3600} seconds"
    rows = df.select(*columns)
    for part in ARRIVAL:
        df.where(sixth == part).select(*columns).write.mode("append").parquet(path)
    stream_of = lambda: X.with_time(X.frame_stream(own, path, rows.schema, 8))
    X.run_to_table(verb(stream_of(), delay), table)
    after = {"ts_us": 2 * span.b - span.a + 60 * 24 * HOUR, "idx_src": -1, "source_file": "later", "can_id": -1, "symbol": -1}
    spark.range(1).select(*(F.lit(after[f.name]).cast(f.dataType).alias(f.name) for f in rows.schema)).write.mode("append").parquet(path)
    out = X.run_to_table(verb(stream_of(), delay), table)
    return spark.read.schema(out.schema).parquet(f"{table}/out")


def complete(spark, df):
    return X.run_to_table(df, scratch(spark, "table"), "complete")


@R.add("stream_source", WITH + "SELECT idx_src, ts_us, can_id FROM f")
def _(spark, sf):
    return X.run_to_table(stream(spark, sf).select("idx_src", "ts_us", "can_id"), scratch(spark, "table"))


@R.add("stream_tumbling_label", WITH + f"SELECT ts_us - ts_us % {6 * HOUR} AS start_us, count(*) AS n_msgs, max(label) AS label_window, CAST(sum(label) AS BIGINT) AS n_attack FROM f GROUP BY 1")
def _(spark, sf):
    return complete(spark, X.tumbling_label(stream(spark, sf), "6 hours", "1 hour"))


@R.add("stream_sliding_freq", WITH + f", e AS (SELECT can_id, ts_us - ts_us % {2 * HOUR} - {2 * HOUR} * unnest([0, 1, 2]) AS start_us FROM f) SELECT start_us, can_id, count(*) AS n FROM e GROUP BY ALL")
def _(spark, sf):
    return complete(spark, X.sliding_id_count(stream(spark, sf), "6 hours", "2 hours", "1 hour"))


@R.add("stream_session_bursts", WITH + ", a AS (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY source_file ORDER BY ts_us) < 600000000 THEN 0 ELSE 1 END AS fresh FROM f WHERE label = 1), g AS (SELECT *, sum(fresh) OVER (PARTITION BY source_file ORDER BY ts_us) AS s FROM a) SELECT source_file, min(ts_us) AS start_us, count(*) AS n FROM g GROUP BY source_file, s")
def _(spark, sf):
    return complete(spark, X.session_bursts(stream(spark, sf), "10 minutes", "1 hour"))


@R.add("stream_ngram_score", WITH + ", g AS (SELECT idx_src, CASE WHEN row_number() OVER w >= 3 THEN concat_ws(' ', lag(can_id % 12, 2) OVER w, lag(can_id % 12) OVER w, can_id % 12) END AS gram, source_file FROM f WINDOW w AS (PARTITION BY source_file ORDER BY ts_us, idx_src)) SELECT idx_src, CASE WHEN gram IS NULL OR gram IN (SELECT gram FROM g WHERE source_file < '" + bridge.TRAIN_BEFORE + "' AND gram IS NOT NULL) THEN 0 ELSE 1 END AS score FROM g WHERE source_file >= '" + bridge.TRAIN_BEFORE + "'")
def _(spark, sf):
    """Grams roll in state and are scored on the stream; the model is a table of the earlier days."""
    from ..operators.detect import ngram_fit

    train = bridge.frames(spark, sf).where(f"source_file < '{bridge.TRAIN_BEFORE}'").withColumn("symbol", F.col("can_id") % 12)
    path = scratch(spark, "model")
    ngram_fit(train, 3, "symbol").select(F.array_join("gram", " ").alias("gram")).write.parquet(path)

    def verb(df, delay):
        own = df.sparkSession.read.schema("gram string").parquet(path)
        return X.score_grams(X.rolling_grams(df, delay).where(f"source_file >= '{bridge.TRAIN_BEFORE}'"), own).select("idx_src", "score")

    return out_of_order(spark, sf, verb, ["source_file", "idx_src", "ts_us", "symbol"])


@R.add("stream_trailing_freq", WITH + f"SELECT idx_src, count(*) OVER (PARTITION BY can_id ORDER BY ts_us RANGE BETWEEN {6 * HOUR} PRECEDING AND CURRENT ROW) AS trailing FROM f")
def _(spark, sf):
    return out_of_order(spark, sf, X.trailing_counts, ["can_id", "idx_src", "ts_us"])


@R.add("stream_late_drop", WITH + f"SELECT ts_us - ts_us % {6 * HOUR} AS start_us, count(*) AS n_msgs, max(label) AS label_window, CAST(sum(label) AS BIGINT) AS n_attack FROM f WHERE source_file >= '{bridge.TRAIN_BEFORE}' GROUP BY 1 HAVING start_us + {6 * HOUR} <= (SELECT max(ts_us) FROM f) - {HOUR}")
def _(spark, sf):
    """Append mode: windows behind the watermark are given once, the last ones stay open, and days that arrive late are dropped."""
    return in_two_runs(spark, sf, lambda df: X.tumbling_label(X.with_time(df), "6 hours", "1 hour"), ["ts_us", "label"], late=True)


@R.add("stream_dedup", WITH + "SELECT idx_src FROM f")
def _(spark, sf):
    return X.run_to_table(X.dedup(stream(spark, sf, twice=True), ["idx_src"], "2 days").select("idx_src"), scratch(spark, "table"))


@R.add("stream_enrich", WITH + f", i AS (SELECT source_file, min(ts_us) + {HOUR} AS a, min(ts_us) + {5 * HOUR} AS b FROM f WHERE source_file < '2024-01-20' GROUP BY 1) SELECT idx_src, coalesce(CAST(ts_us BETWEEN a AND b AS INT), 0) AS label FROM f LEFT JOIN i USING (source_file)")
def _(spark, sf):
    i = bridge.frames(spark, sf).where("source_file < '2024-01-20'").groupBy("source_file").agg((F.min("ts_us") + HOUR).alias("start_us"), (F.min("ts_us") + 5 * HOUR).alias("end_us"))
    return X.run_to_table(X.enrich(stream(spark, sf), i).select("idx_src", "label"), scratch(spark, "table"))
