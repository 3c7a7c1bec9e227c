"""Queries of the window operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import bridge
from ..operators import windows as W
from ..registry import Registry

R = Registry()
WITH = "WITH " + bridge.DUCK
HOUR = 3_600_000_000
IN_FILE = "PARTITION BY source_file ORDER BY ts_us, idx_src"
SUMMARY = "min(ts_us) AS t_start_us, max(ts_us) AS t_end_us, count(*) AS n_msgs, CAST(max(label) AS INT) AS label_window, round(avg(label), 9) AS frac_attack"
#: Coarse times with ties.
COARSE = "SELECT * REPLACE (ts_us - ts_us % 3600000000 AS ts_us) FROM f"


def f(spark, sf_dir):
    return bridge.frames(spark, sf_dir)


def coarse(spark, sf_dir):
    return f(spark, sf_dir).withColumn("ts_us", F.col("ts_us") - F.col("ts_us") % HOUR)


def rounded(df):
    return df.withColumn("frac_attack", F.round("frac_attack", 9))


@R.add("inter_arrival", WITH + f" SELECT idx_src, coalesce(ts_us - lag(ts_us) OVER ({IN_FILE}), 0) AS inter_arrival_us FROM f")
def _(spark, sf):
    return W.inter_arrival(f(spark, sf)).select("idx_src", "inter_arrival_us")


@R.add("inter_arrival_per_id", WITH + " SELECT idx_src, coalesce(ts_us - lag(ts_us) OVER (PARTITION BY source_file, can_id ORDER BY ts_us, idx_src), 0) AS inter_arrival_us FROM f")
def _(spark, sf):
    return W.inter_arrival(f(spark, sf), per_id=True).select("idx_src", "inter_arrival_us")


@R.add("row_index", WITH + " SELECT idx_src, row_number() OVER (ORDER BY source_file, ts_us, idx_src) - 1 AS row FROM f")
def _(spark, sf):
    return W.row_index(f(spark, sf)).select("idx_src", "row")


COUNTED = f""", i AS (SELECT *, row_number() OVER (ORDER BY source_file, ts_us, idx_src) - 1 AS row FROM f),
e AS (SELECT *, unnest(range(CAST(greatest(0, ceil((row - 90 + 1) / 40.0)) AS BIGINT), row // 40 + 1)) AS window_no FROM i),
k AS (SELECT window_no, {SUMMARY}, max(row) AS last FROM e GROUP BY window_no HAVING count(DISTINCT source_file) = 1),
stop AS (SELECT min(window_no) AS s FROM k WHERE window_no * 40 + 89 >= (SELECT max(row) FROM i))"""


@R.add("count_windows", WITH + COUNTED + " SELECT k.* EXCLUDE (last) FROM k, stop WHERE s IS NULL OR window_no <= s")
def _(spark, sf):
    return rounded(W.count_windows(f(spark, sf), 90, 40))


@R.add("time_windows", WITH + f""", o AS (SELECT *, ts_us - (SELECT min(ts_us) FROM f) AS r FROM f),
e AS (SELECT *, unnest(range(greatest(0, CAST(floor((r - {6 * HOUR}) / {2 * HOUR}.0) AS BIGINT) + 1), r // {2 * HOUR} + 1)) AS window_no FROM o)
SELECT window_no, (SELECT min(ts_us) FROM f) + window_no * {2 * HOUR} AS t_start_us, (SELECT min(ts_us) FROM f) + window_no * {2 * HOUR} + {6 * HOUR} AS t_end_us, count(*) AS n_msgs, CAST(max(label) AS INT) AS label_window, round(avg(label), 9) AS frac_attack
FROM e GROUP BY window_no HAVING count(DISTINCT source_file) = 1""")
def _(spark, sf):
    return rounded(W.time_windows(f(spark, sf), 6 * HOUR, 2 * HOUR))


@R.add("tumbling_bins", WITH + f" SELECT (ts_us - (SELECT min(ts_us) FROM f)) // {6 * HOUR} AS window_no, {SUMMARY} FROM f GROUP BY 1")
def _(spark, sf):
    return rounded(W.tumbling_bins(f(spark, sf), 6 * HOUR))


@R.add("trace_time_windows", WITH + f""", o AS (SELECT *, ts_us - min(ts_us) OVER (PARTITION BY source_file) AS r FROM f),
e AS (SELECT *, unnest(range(greatest(0, CAST(floor((r - {4 * HOUR}) / {HOUR}.0) AS BIGINT) + 1), r // {HOUR} + 1)) AS window_no FROM o)
SELECT source_file, window_no, {SUMMARY} FROM e GROUP BY ALL""")
def _(spark, sf):
    return rounded(W.trace_time_windows(f(spark, sf), 4 * HOUR, HOUR))


@R.add("trailing_id_freq", WITH + f""", c AS ({COARSE})
SELECT x.idx_src, count(*) / 6.0 AS hz FROM c x JOIN c y ON x.can_id = y.can_id AND y.ts_us >= x.ts_us - {6 * HOUR} AND (y.ts_us < x.ts_us OR y.ts_us = x.ts_us AND y.idx_src <= x.idx_src) GROUP BY x.idx_src""")
def _(spark, sf):
    return W.trailing_id_count(coarse(spark, sf), 6 * HOUR).select("idx_src", (F.col("trailing") / 6.0).alias("hz"))


@R.add("ngrams", WITH + f" SELECT idx_src, CASE WHEN row_number() OVER ({IN_FILE}) >= 3 THEN array_to_string([lag(can_id % 4, 2) OVER ({IN_FILE}), lag(can_id % 4) OVER ({IN_FILE}), can_id % 4], ' ') END AS gram FROM f")
def _(spark, sf):
    g = W.ngrams(f(spark, sf).withColumn("symbol", F.col("can_id") % 4), 3, "symbol")
    return g.select("idx_src", F.array_join("gram", " ").alias("gram"))


IN_ID = "PARTITION BY source_file, can_id ORDER BY ts_us, idx_src"


@R.add("sequence_windows", WITH + f" SELECT idx_src, lag(signal1, 1) OVER ({IN_ID}) AS v0, signal1 AS v1, CAST(lag(dlc, 1) OVER ({IN_ID}) AS DOUBLE) AS d0 FROM f QUALIFY row_number() OVER ({IN_ID}) >= 2")
def _(spark, sf):
    s = W.sequence_windows(f(spark, sf), 2, ["signal1", "dlc"])
    return s.select("idx_src", F.col("sequence")[0][0].alias("v0"), F.col("sequence")[1][0].alias("v1"), F.col("sequence")[0][1].alias("d0"))


@R.add("strided_image_windows", WITH + f""" SELECT idx_src, label_window, v0, v2 FROM (SELECT idx_src, row_number() OVER ({IN_FILE}) - 1 AS nth, lag(signal1, 10) OVER ({IN_FILE}) AS v0, signal1 AS v2,
max(label) OVER ({IN_FILE} ROWS BETWEEN 10 PRECEDING AND CURRENT ROW) AS label_window FROM f) WHERE nth >= 10 AND (nth - 10) % 7 = 0""")
def _(spark, sf):
    return W.image_windows(f(spark, sf), 3, 5, 7, ["signal1"]).select("idx_src", "label_window", F.col("image")[0][0].alias("v0"), F.col("image")[2][0].alias("v2"))


RUNS = WITH + f""", r AS (SELECT *, row_number() OVER ({IN_FILE}) - row_number() OVER (PARTITION BY source_file, label ORDER BY ts_us, idx_src) AS g FROM f)
SELECT source_file, min(ts_us) AS start_us, max(ts_us) AS end_us, count(*) AS n_msgs FROM r WHERE label = 1 GROUP BY source_file, g"""


@R.add("contiguous_intervals", RUNS)
def _(spark, sf):
    return W.contiguous_intervals(f(spark, sf))


@R.add("window_message_interval", WITH + f""", o AS (SELECT *, ts_us - (SELECT min(ts_us) FROM f) AS r FROM f)
SELECT idx_src, unnest(range(greatest(0, CAST(floor((r - {3 * HOUR}) / {HOUR}.0) AS BIGINT) + 1), r // {HOUR} + 1)) AS window_no FROM o""")
def _(spark, sf):
    df = f(spark, sf)
    return W.message_time_windows(df.crossJoin(F.broadcast(df.agg(F.min("ts_us").alias("t0")))), 3 * HOUR, HOUR, F.col("t0")).select("idx_src", "window_no")


COVER = f""", i AS (SELECT *, row_number() OVER (ORDER BY source_file, ts_us, idx_src) - 1 AS row FROM f),
e AS (SELECT *, unnest(range(CAST(greatest(0, ceil((row - 90 + 1) / 40.0)) AS BIGINT), row // 40 + 1)) AS window_no FROM i)"""


@R.add("first_window_prediction", WITH + COVER + ", p AS (SELECT window_no, CAST(sum(label) >= 20 AS INT) AS pred FROM e WHERE window_no % 5 <> 0 GROUP BY 1) SELECT idx_src, coalesce(arg_min(pred, CASE WHEN pred IS NOT NULL THEN window_no END), 0) AS pred FROM e LEFT JOIN p USING (window_no) GROUP BY idx_src")
def _(spark, sf):
    e = W.message_count_windows(W.row_index(f(spark, sf)), 90, 40)
    p = e.where("window_no % 5 <> 0").groupBy("window_no").agg((F.sum("label") >= 20).cast("int").alias("pred"))
    return W.first_window_prediction(e.select("idx_src", "window_no"), p)


@R.add("window_to_message_score", WITH + COVER + ", s AS (SELECT window_no, can_id, count(*) AS score FROM e GROUP BY ALL) SELECT idx_src, window_no, score FROM e JOIN s USING (window_no, can_id)")
def _(spark, sf):
    e = W.message_count_windows(W.row_index(f(spark, sf)), 90, 40)
    s = e.groupBy("window_no", "can_id").agg(F.count("*").alias("score"))
    return W.window_to_message_score(e, s).select("idx_src", "window_no", "score")


@R.add("chrono_split", WITH + f""" SELECT idx_src, CASE WHEN row_number() OVER ({IN_FILE}) - 1 >= count(*) OVER (PARTITION BY source_file) - floor(count(*) OVER (PARTITION BY source_file) * 0.05) THEN 'valid' ELSE 'train' END AS per_file,
CASE WHEN row_number() OVER (ORDER BY source_file, ts_us, idx_src) - 1 >= count(*) OVER () - floor(count(*) OVER () * 0.05) THEN 'valid' ELSE 'train' END AS merged FROM f""")
def _(spark, sf):
    a = W.chrono_split(f(spark, sf), 0.05).select("idx_src", F.col("split").alias("per_file"))
    return a.join(W.chrono_split(f(spark, sf), 0.05, per_file=False).select("idx_src", F.col("split").alias("merged")), "idx_src")


@R.add("random_window_split")
def _(spark, sf):
    w = W.trace_time_windows(f(spark, sf), 6 * HOUR, 6 * HOUR).withColumn("key", F.concat_ws("/", "source_file", "window_no"))
    return W.random_split(w, "key", 13, {"train": 0.7, "valid": 0.1, "test": 0.2}).select("source_file", "window_no", "split")


@R.add("fixed_slices", WITH + f" SELECT idx_src, (row_number() OVER ({IN_FILE}) - 1) // 100 AS slice_no FROM f")
def _(spark, sf):
    return W.fixed_slices(f(spark, sf), 100).select("idx_src", "slice_no")
