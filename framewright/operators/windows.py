"""Windows over message streams: rows, spans of time, traces, sequences and runs.

A message's windows are computed by arithmetic and exploded, never by a theta
join.  Window keys are (source_file, window_no) or window_no on the global
grid, anchored at the first row or time of the concatenated files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import fits, last_values, place

#: Spans that one time bucket of a trailing count holds.
SPANS = 8


def inter_arrival(df: DataFrame, per_id: bool = False, name: str = "inter_arrival_us") -> DataFrame:
    """Time since the previous message of the file (or of the id in the file); the first one has 0."""
    pair = last_values(df, 2, F.col("ts_us"), ("source_file", "can_id") if per_id else ("source_file",), "_pair")
    return pair.withColumn(name, F.coalesce(F.when(F.size("_pair") == 2, F.col("ts_us") - F.col("_pair")[0]), F.lit(0))).drop("_pair")


def row_index(df: DataFrame, name: str = "row") -> DataFrame:
    """0-based position over all files in the order of their names: rank in the file plus the sizes of earlier files."""
    sizes = df.groupBy("source_file").agg(F.count("*").alias("n"))
    # one row a file
    begin = sizes.select("source_file", F.coalesce(F.sum("n").over(Window.orderBy("source_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("begin"))
    return place(df).join(begin, "source_file").withColumn(name, F.col("begin") + F.col("_nth")).drop("_nth", "begin")


def _explode_windows(df: DataFrame, low: Column, high: Column) -> DataFrame:
    return df.withColumn("_lo", low.cast("bigint")).withColumn("_hi", high.cast("bigint")).where("_hi >= _lo").withColumn("window_no", F.explode(F.sequence("_lo", "_hi"))).drop("_lo", "_hi")


def message_count_windows(df: DataFrame, size: int, stride: int) -> DataFrame:
    """Message and count window, one row for each window that a message is in; df has ``row``."""
    return _explode_windows(df, F.greatest(F.lit(0), F.ceil((F.col("row") - size + 1) / stride)), F.floor(F.col("row") / stride))


def message_time_windows(df: DataFrame, span_us: int, stride_us: int, origin: Column) -> DataFrame:
    """Message and time window, one row for each window that a message is in."""
    r = F.col("ts_us") - origin
    return _explode_windows(df, F.greatest(F.lit(0), F.floor((r - span_us) / stride_us) + 1), F.floor(r / stride_us))


def window_summary(df: DataFrame, *keys: str, label: str = "label") -> DataFrame:
    """First and last time, message count, any-label and share of labelled messages of each window."""
    return df.groupBy(*keys).agg(F.min("ts_us").alias("t_start_us"), F.max("ts_us").alias("t_end_us"), F.count("*").alias("n_msgs"), F.max(label).cast("int").alias("label_window"), F.avg(label).alias("frac_attack"), F.count_distinct("source_file").alias("files"))


def count_windows(df: DataFrame, size: int, stride: int) -> DataFrame:
    """Windows of ``size`` rows; those across files are dropped; after the first kept window that reaches the end no more follow."""
    rows = row_index(df)
    found = window_summary(message_count_windows(rows, size, stride).withColumn("_row", F.col("row")), "window_no")
    last = rows.agg(F.max("row").alias("last_row"))
    kept = found.where("files = 1").crossJoin(F.broadcast(last))  # one row
    stop = kept.where(F.col("window_no") * stride + size - 1 >= F.col("last_row")).agg(F.min("window_no").alias("stop"))
    return kept.crossJoin(F.broadcast(stop)).where("stop IS NULL OR window_no <= stop").drop("files", "last_row", "stop")


def time_windows(df: DataFrame, span_us: int, stride_us: int) -> DataFrame:
    """Sliding windows from the first time of all; nominal bounds; empty ones and those across files are not given."""
    origin = df.agg(F.min("ts_us").alias("t0"))
    placed = message_time_windows(df.crossJoin(F.broadcast(origin)), span_us, stride_us, F.col("t0"))
    found = window_summary(placed, "window_no", "t0").where("files = 1")
    start = F.col("t0") + F.col("window_no") * stride_us
    return found.withColumn("t_start_us", start).withColumn("t_end_us", start + span_us).drop("t0", "files")


def tumbling_bins(df: DataFrame, span_us: int) -> DataFrame:
    """Bins of one span by integer division; files do not matter; bounds are those of the messages."""
    origin = df.agg(F.min("ts_us").alias("t0"))
    binned = df.crossJoin(F.broadcast(origin)).withColumn("window_no", F.floor((F.col("ts_us") - F.col("t0")) / span_us))
    return window_summary(binned, "window_no").drop("files")


def trace_time_windows(df: DataFrame, span_us: int, stride_us: int, label: str = "label") -> DataFrame:
    """Time windows from the first message of each trace."""
    origin = df.groupBy("source_file").agg(F.min("ts_us").alias("t0"))
    placed = message_time_windows(df.join(origin, "source_file"), span_us, stride_us, F.col("t0"))
    return window_summary(placed, "source_file", "window_no", label=label).drop("files")


def trailing_id_count(df: DataFrame, span_us: int, name: str = "trailing") -> DataFrame:
    """Messages of the same id in [t - span, t] seen so far; of messages at one time only the earlier ones count."""
    bucket = SPANS * max(span_us, 1)
    at = lambda t: F.floor(t / bucket)
    # a busy id is cut in buckets of time; rows of the last span of a bucket stand in the next one, too
    placed = df.withColumn("_own", at(F.col("ts_us"))).withColumn("_b", F.explode(F.array_distinct(F.array("_own", at(F.col("ts_us") + span_us)))))
    upto = Window.partitionBy("can_id", "_b").orderBy("ts_us").rangeBetween(-span_us, Window.currentRow)
    peers = Window.partitionBy("can_id", "_b", "ts_us")
    later = F.count("*").over(peers) - F.row_number().over(peers.orderBy("idx_src"))
    return placed.withColumn(name, F.count("*").over(upto) - later).where("_b = _own").drop("_own", "_b")


def ngrams(df: DataFrame, n: int, symbol: str, trace: str | None = "source_file", name: str = "gram", short: bool | None = None) -> DataFrame:
    """The last n symbols ending at each message of a trace; null for the first n - 1."""
    return last_values(df, n, F.col(symbol), (trace,) if trace else (), name, short).withColumn(name, F.when(F.size(name) == n, F.col(name)))


def sequence_windows(df: DataFrame, steps: int, values: list[str], name: str = "sequence") -> DataFrame:
    """The last ``steps`` value rows of each id in its file, for messages that have so many."""
    return last_values(df, steps, F.array(*(F.col(v).cast("double") for v in values)), ("source_file", "can_id"), name).where(F.size(name) == steps)


def image_windows(df: DataFrame, steps: int, period: int, step: int, values: list[str], label: str = "label") -> DataFrame:
    """Every ``step`` rows: ``steps`` samples ``period`` rows apart, and whether any row of the span is labelled."""
    span = period * (steps - 1)
    row = F.struct(F.array(*(F.col(v).cast("double") for v in values)).alias("x"), F.col(label).alias("y"))
    short = fits(df, ("source_file",))
    out = place(last_values(df, span + 1, row, name="_span", short=short), name="nth", short=short).where((F.col("nth") >= span) & ((F.col("nth") - span) % step == 0))
    samples = F.array(*(F.col("_span")[period * k].x for k in range(steps)))
    return out.select("source_file", "ts_us", "idx_src", "nth", samples.alias("image"), F.array_max(F.transform("_span", lambda r: r.y)).alias("label_window"))


def contiguous_intervals(df: DataFrame, label: str = "label") -> DataFrame:
    """Runs of labelled messages in each file: first and last time, and length."""
    short = fits(df, ("source_file",))
    both = place(place(df, short=short), ("source_file", label), "_same", short=short)
    return both.withColumn("_run", F.col("_nth") - F.col("_same")).where(F.col(label) == 1).groupBy("source_file", "_run").agg(F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"), F.count("*").alias("n_msgs")).drop("_run")


def first_window_prediction(messages: DataFrame, predictions: DataFrame) -> DataFrame:
    """Each message with the prediction of its first window (0 without one): messages (idx_src, window_no), predictions (window_no, pred)."""
    return messages.join(predictions, "window_no", "left").groupBy("idx_src").agg(F.coalesce(F.min_by("pred", F.when(F.col("pred").isNotNull(), F.col("window_no"))), F.lit(0)).alias("pred"))


def window_to_message_score(messages: DataFrame, scores: DataFrame) -> DataFrame:
    """Each message gets its id's score in each window that covers it."""
    return messages.join(scores, ["window_no", "can_id"])


def chrono_split(df: DataFrame, share: float, per_file: bool = True) -> DataFrame:
    """The last ``int(n * share)`` rows of each file (or of all) are ``valid``."""
    if per_file:
        counted = place(df, name="_row", total="_n")
    else:
        counted = row_index(df, "_row").crossJoin(F.broadcast(df.agg(F.count("*").alias("_n"))))
    return counted.withColumn("split", F.when(F.col("_row") >= F.col("_n") - F.floor(F.col("_n") * share), "valid").otherwise("train")).drop("_row", "_n")


def random_split(df: DataFrame, key: str, seed: int, shares: dict[str, float]) -> DataFrame:
    """Splits by a seeded hash of a key: the same key always falls in the same split."""
    at = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1_000_000)) / 1_000_000.0
    upto, out = 0.0, None
    for name, share in shares.items():
        upto += share
        out = F.when(at < upto, name) if out is None else out.when(at < upto, name)
    return df.withColumn("split", out.otherwise(list(shares)[-1]))


def fixed_slices(df: DataFrame, rows: int) -> DataFrame:
    """Slices of at most ``rows`` consecutive rows of a file."""
    return place(df).withColumn("slice_no", F.floor(F.col("_nth") / rows)).drop("_nth")
