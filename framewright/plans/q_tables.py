"""Queries of cleaning, labelling joins, statistics, sorts and set operations."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .. import bridge
from ..operators import blocks as B
from ..operators import clean as C
from ..operators import detect as D
from ..operators import evaluate as E
from ..operators import labels as L
from ..operators import matrix as X
from ..operators import stats as T
from ..operators import windows as W
from ..operators.ranks import exact_quantiles
from ..registry import Registry
from ..scratch import scratch

R = Registry()
HOUR = 3_600_000_000
DAY = bridge.TRAIN_BEFORE
WITH = "WITH " + bridge.DUCK + " "
TYPED = "WITH " + bridge.DUCK_TYPES + " "
IN_FILE = "PARTITION BY source_file ORDER BY ts_us, idx_src"


def f(spark, sf):
    return bridge.frames(spark, sf)


def a(spark, sf):
    return bridge.attack_types(f(spark, sf))


def r9(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


# cleaning -----------------------------------------------------------------------

BYTE = "CASE WHEN dlc > {0} THEN CAST(coalesce(try_cast('0x' || nullif(substr(data_hex, {1}, 2), '') AS INT), 0) AS INT) ELSE 0 END AS data{0}"


@R.add("to_canonical_frames", TYPED + f"SELECT idx_src, ts_us, can_id, dlc, {', '.join(BYTE.format(i, 2 * i + 1) for i in range(8))}, label, CASE WHEN label = 1 THEN attack_type END AS attack_type, round(coalesce(ts_us - lag(ts_us) OVER ({IN_FILE}), 0) / 1e6, 6) AS inter_arrival FROM a")
def _(spark, sf):
    out = C.to_frames(a(spark, sf), "events")
    return out.select("idx_src", "ts_us", "can_id", *(F.col(c).cast("int").alias(c) for c in ("dlc", *(f"data{i}" for i in range(8)), "label")), "attack_type", F.round("inter_arrival", 6).alias("inter_arrival"))


@R.add("to_canonical_signals", TYPED + "SELECT idx_src, can_id, signal1 AS s1, dlc::DOUBLE AS s2, CASE WHEN label = 1 THEN attack_type END AS attack_type, round(coalesce(ts_us - lag(ts_us) OVER (PARTITION BY source_file, can_id ORDER BY ts_us, idx_src), 0) / 1e6, 6) AS inter_arrival FROM a")
def _(spark, sf):
    return C.to_signals(a(spark, sf), ["signal1", "dlc"], "events").select("idx_src", "can_id", F.col("signals")[0].alias("s1"), F.col("signals")[1].alias("s2"), "attack_type", F.round("inter_arrival", 6).alias("inter_arrival"))


@R.add("rebase_time", WITH + "SELECT idx_src, ts_us - min(ts_us) OVER (PARTITION BY source_file) AS ts_us FROM f")
def _(spark, sf):
    return C.rebase_time(f(spark, sf)).select("idx_src", "ts_us")


@R.add("enforce_dtypes", WITH + "SELECT CASE WHEN idx_src % 7 = 0 OR idx_src % 11 = 0 THEN 'bad' ELSE 'good' END AS side, count(*) AS n, CAST(sum(CASE WHEN idx_src % 5 = 0 THEN 0 ELSE label END) AS BIGINT) AS attacks, CAST(sum(CASE WHEN idx_src % 5 = 0 THEN 0 ELSE dlc END) AS BIGINT) AS bytes FROM f GROUP BY 1")
def _(spark, sf):
    raw = f(spark, sf).select("idx_src", F.when(F.col("idx_src") % 7 == 0, "inf").otherwise(F.col("ts_us").cast("string")).alias("ts_s"), F.when(F.col("idx_src") % 11 == 0, "x").otherwise(F.col("can_id").cast("string")).alias("can_id"), F.when(F.col("idx_src") % 5 == 0, "?").otherwise(F.col("dlc").cast("string")).alias("dlc"), F.when(F.col("idx_src") % 5 == 0, "2").otherwise(F.col("label").cast("string")).alias("label"))
    good, bad = C.enforce_dtypes(raw)
    both = good.withColumn("side", F.lit("good")).unionByName(bad.withColumn("side", F.lit("bad")))
    return both.groupBy("side").agg(F.count("*").alias("n"), F.sum("label").alias("attacks"), F.sum("dlc").alias("bytes"))


@R.add("null_benign_attack_type", WITH + "SELECT idx_src, CASE WHEN label = 1 THEN scenario END AS attack_type FROM f")
def _(spark, sf):
    return C.null_benign_attack_type(f(spark, sf).withColumn("attack_type", F.col("scenario"))).select("idx_src", "attack_type")


@R.add("filter_selected_ids", WITH + "SELECT idx_src FROM f WHERE can_id IN (SELECT c_custkey FROM customer WHERE c_custkey < 40)")
def _(spark, sf):
    ids = spark.read.parquet(f"{sf}/customer.parquet").where("c_custkey < 40").select(F.col("c_custkey").alias("can_id"))
    return C.filter_selected_ids(f(spark, sf), ids).select("idx_src")


@R.add("benign_only", WITH + "SELECT idx_src FROM f WHERE label = 0")
def _(spark, sf):
    return C.assert_benign(C.benign_only(f(spark, sf))).select("idx_src")


@R.add("assert_benign", WITH + f"SELECT idx_src FROM f WHERE label = 0 AND source_file < '{DAY}'")
def _(spark, sf):
    return C.assert_benign(f(spark, sf).where(f"label = 0 AND source_file < '{DAY}'")).select("idx_src")


@R.add("exclude_prefixes", WITH + "SELECT idx_src FROM f WHERE source_file NOT LIKE '2024-01-0%' AND source_file NOT LIKE '2024-01-2%'")
def _(spark, sf):
    return C.exclude_prefixes(f(spark, sf), ["2024-01-0", "2024-01-2"]).select("idx_src")


@R.add("ffill_bfill", WITH + f", g AS (SELECT *, CASE WHEN dlc > 5 THEN signal1 END AS v FROM f) SELECT idx_src, coalesce(last_value(v IGNORE NULLS) OVER ({IN_FILE} ROWS UNBOUNDED PRECEDING), first_value(v IGNORE NULLS) OVER ({IN_FILE} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS v FROM g")
def _(spark, sf):
    return C.fill(f(spark, sf).withColumn("v", F.when(F.col("dlc") > 5, F.col("signal1"))), ["v"]).select("idx_src", "v")


@R.add("time_slice", WITH + f"SELECT idx_src FROM f QUALIFY ts_us - min(ts_us) OVER (PARTITION BY source_file) BETWEEN {HOUR} AND {5 * HOUR}")
def _(spark, sf):
    return C.time_slice(f(spark, sf), HOUR, 5 * HOUR, relative=True).select("idx_src")


@R.add("signals_pivot_wide", WITH + "SELECT idx_src, " + ", ".join(f"last_value(CASE WHEN can_id % 3 = {k} THEN signal1 END IGNORE NULLS) OVER ({IN_FILE} ROWS UNBOUNDED PRECEDING) AS Sig_1_of_ID_{k}" for k in range(3)) + " FROM f")
def _(spark, sf):
    return C.signals_wide(f(spark, sf).withColumn("can_id", F.col("can_id") % 3), [0, 1, 2]).drop("source_file", "ts_us")


# labelling joins ------------------------------------------------------------------

SPANS = ", i AS (SELECT source_file, min(can_id) AS can_id, min(ts_us) + 7200000000 AS start_us, min(ts_us) + 36000000000 AS end_us FROM f WHERE source_file < '2024-01-20' GROUP BY 1)"


def spans(spark, sf):
    return f(spark, sf).where("source_file < '2024-01-20'").groupBy("source_file").agg(F.min("can_id").alias("can_id"), (F.min("ts_us") + 2 * HOUR).alias("start_us"), (F.min("ts_us") + 10 * HOUR).alias("end_us"))


@R.add("label_interval_range", WITH + SPANS + " SELECT idx_src, CASE WHEN i.source_file IS NOT NULL THEN CAST(ts_us BETWEEN start_us AND end_us AS INT) WHEN f.can_id BETWEEN 100 AND 120 THEN 1 ELSE 0 END AS label FROM f LEFT JOIN i USING (source_file)")
def _(spark, sf):
    return L.label_interval_range(f(spark, sf).drop("label"), spans(spark, sf), F.col("can_id").between(100, 120)).select("idx_src", "label")


IDS = SPANS + ", j AS (SELECT source_file, CASE WHEN can_id % 2 = 0 THEN 3 END AS can_id, start_us, end_us FROM i UNION ALL SELECT source_file, 7, end_us, start_us FROM i UNION ALL SELECT source_file, 9, NULL, start_us FROM i)"
IDS_SQL = " SELECT idx_src, CAST(max(CASE WHEN j.source_file IS NOT NULL THEN 1 ELSE 0 END) AS INT) AS label FROM f LEFT JOIN j ON j.source_file = f.source_file AND (j.can_id IS NULL OR j.can_id = f.can_id) AND ts_us BETWEEN least(coalesce(start_us, -4611686018427387904), coalesce(end_us, 4611686018427387904)) AND greatest(coalesce(start_us, -4611686018427387904), coalesce(end_us, 4611686018427387904)) GROUP BY idx_src"


def id_spans(spark, sf):
    i = spans(spark, sf)
    two = i.select("source_file", F.when(F.col("can_id") % 2 == 0, F.lit(3)).cast("bigint").alias("can_id"), "start_us", "end_us")
    swapped = i.select("source_file", F.lit(7).cast("bigint").alias("can_id"), F.col("end_us").alias("start_us"), F.col("start_us").alias("end_us"))
    return two.unionByName(swapped).unionByName(i.select("source_file", F.lit(9).cast("bigint").alias("can_id"), F.lit(None).cast("bigint").alias("start_us"), F.col("start_us").alias("end_us")))


@R.add("label_interval_id", WITH + IDS.replace("CASE WHEN can_id % 2 = 0 THEN 3 END", "3") + IDS_SQL)
def _(spark, sf):
    return L.label_interval_id(f(spark, sf).drop("label"), id_spans(spark, sf).withColumn("can_id", F.coalesce("can_id", F.lit(3)))).select("idx_src", "label")


@R.add("label_interval_wildcard", WITH + IDS + IDS_SQL)
def _(spark, sf):
    return L.label_interval_id(f(spark, sf).drop("label"), id_spans(spark, sf)).select("idx_src", "label")


@R.add("label_interval_pattern", WITH + SPANS + " SELECT idx_src, CAST(i.source_file IS NOT NULL AND can_idx % 2 = 1 AND ts_us BETWEEN start_us AND end_us AND rpad(data_hex, 16, '0')[13:] = '0000' AS INT) AS label FROM f LEFT JOIN (SELECT *, CAST(substr(source_file, 10, 1) AS INT) AS can_idx FROM i) i USING (source_file)")
def _(spark, sf):
    c = spans(spark, sf).withColumn("kind", F.when(F.substring("source_file", 10, 1).cast("int") % 2 == 1, "fuzzing").otherwise("Accelerator attack")).withColumn("pattern", F.lit("XXXXXXXXXXXX0000")).withColumn("can_id", F.lit(None).cast("bigint"))
    return L.label_interval_pattern(f(spark, sf).drop("label"), c).select("idx_src", "label")


@R.add("label_rules_time_id", WITH + "SELECT idx_src, CAST(CASE WHEN scenario = 'click' THEN can_id = 0 WHEN scenario = 'view' THEN ts_us >= 1705000000000000 ELSE false END AS INT) AS label FROM f")
def _(spark, sf):
    kind = F.when(F.col("scenario") == "click", "DoS").when(F.col("scenario") == "view", "Fuzzy").otherwise("normal")
    return L.label_rules_time_id(f(spark, sf), kind, 1705000000000000).select("idx_src", "label")


@R.add("mask_join", WITH + ", m(can_id, start, stop) AS (VALUES (1, 0, 8), (1, 8, 24), (5, 4, 12)) SELECT idx_src, start, CAST((CAST('0x' || rpad(data_hex, 16, '0') AS UBIGINT) >> (64 - stop)) & ((1 << (stop - start)) - 1)::UBIGINT AS DOUBLE) / 2.0 ** (stop - start) AS value FROM f JOIN m USING (can_id)")
def _(spark, sf):
    mask = spark.createDataFrame([(1, 0, 8), (1, 8, 24), (5, 4, 12)], "can_id long, start int, stop int")
    return L.mask_join(f(spark, sf), mask).select("idx_src", "start", "value")


@R.add("join_predictions_labels", WITH + ", p AS (SELECT source_file, signal1, row_number() OVER (PARTITION BY source_file ORDER BY idx_src) AS pos FROM f WHERE dlc > 0), l AS (SELECT source_file, label, row_number() OVER (PARTITION BY source_file ORDER BY idx_src) AS pos FROM f WHERE can_id > 9) SELECT * FROM p JOIN l USING (source_file, pos)")
def _(spark, sf):
    df = f(spark, sf)
    return L.join_predictions_labels(df.where("dlc > 0").select("source_file", "idx_src", "signal1"), df.where("can_id > 9").select("source_file", "idx_src", "label"), ["source_file"], "idx_src").select("source_file", "pos", "signal1", "label")


@R.add("lookup_attack_type", TYPED + "SELECT x.idx_src, y.attack_type FROM f x LEFT JOIN (SELECT * FROM a WHERE dlc > 2) y USING (idx_src)")
def _(spark, sf):
    return L.lookup_attack_type(f(spark, sf).select("idx_src"), a(spark, sf).where("dlc > 2"))


@R.add("lookup_threshold", WITH + "SELECT idx_src, dlc * 10 + 5 AS threshold FROM f WHERE dlc < 7")
def _(spark, sf):
    t = spark.range(0, 7).select((F.col("id") + 0.1 * 3).alias("factor"), (F.col("id") * 10 + 5).alias("threshold"))
    return L.lookup_threshold(f(spark, sf).withColumn("wanted", F.col("dlc") + 0.3), t).select("idx_src", "threshold")


# statistics ------------------------------------------------------------------------

BINS = f", b AS (SELECT *, (ts_us - (SELECT min(ts_us) FROM f)) // {6 * HOUR} AS window_no FROM a)"


def binned(spark, sf):
    df = a(spark, sf)
    return df.crossJoin(F.broadcast(df.agg(F.min("ts_us").alias("t0")))).withColumn("window_no", F.floor((F.col("ts_us") - F.col("t0")) / (6 * HOUR)))


@R.add("window_label_any", TYPED + BINS + "SELECT window_no, max(attack) AS label_window, round(avg(attack), 6) AS frac_attack FROM b GROUP BY 1")
def _(spark, sf):
    s = W.window_summary(binned(spark, sf), "window_no", label="attack")
    return r9(s.select("window_no", "label_window", "frac_attack"), "frac_attack")


@R.add("window_attack_type", TYPED + BINS + "SELECT window_no, coalesce(min(attack_type) FILTER (label = 1), 'benign') AS attack_type FROM b GROUP BY 1")
def _(spark, sf):
    return T.window_attack_type(binned(spark, sf), "window_no")


@R.add("window_mode_attack_type", TYPED + BINS + "SELECT window_no, scenario AS attack_type FROM (SELECT window_no, scenario, count(*) AS n FROM b GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY window_no ORDER BY n DESC, scenario) = 1")
def _(spark, sf):
    return T.window_mode_type(binned(spark, sf).withColumn("attack_type", F.col("scenario")), "window_no")


@R.add("id_baseline_distribution", WITH + "SELECT can_id, round(count(*) / (SELECT count(*) FROM f WHERE label = 0), 9) AS share FROM f WHERE label = 0 GROUP BY 1")
def _(spark, sf):
    return T.id_share(f(spark, sf).where("label = 0")).withColumn("share", F.round("share", 9))


@R.add("quality_profile", TYPED + f""", tr AS (SELECT * FROM a WHERE source_file < '{DAY}'), te AS (SELECT * FROM a WHERE source_file >= '{DAY}'), x AS (SELECT DISTINCT scenario FROM tr WHERE attack = 0), y AS (SELECT DISTINCT scenario FROM te)
SELECT (SELECT round(avg(attack), 6) FROM tr) AS train_attack_share, count(*) FILTER (attack = 0) AS n_benign, count(*) FILTER (attack = 1) AS n_attack, count(*) FILTER (attack = 1 AND attack_type IS NULL) AS untyped,
(SELECT string_agg(scenario, ',' ORDER BY scenario) FROM y WHERE scenario NOT IN (SELECT scenario FROM x)) AS only_test, (SELECT string_agg(scenario, ',' ORDER BY scenario) FROM y WHERE scenario IN (SELECT scenario FROM x)) AS in_both FROM te""")
def _(spark, sf):
    df = a(spark, sf)
    return r9(T.quality_profile(df.where(f"source_file < '{DAY}'"), df.where(f"source_file >= '{DAY}'")), "train_attack_share")


@R.add("otids_consistency", WITH + "SELECT count(*) FILTER (dlc <> length(data_hex) // 2) AS bad_dlc, count(*) FILTER (label = 1 AND can_id <> 0) AS bad_dos FROM f")
def _(spark, sf):
    return f(spark, sf).agg(F.count_if(F.col("dlc") != F.floor(F.length("data_hex") / 2)).alias("bad_dlc"), F.count_if((F.col("label") == 1) & (F.col("can_id") != 0)).alias("bad_dos"))


@R.add("per_attack_consistency", TYPED + "SELECT CAST(sum(attack) AS BIGINT) AS n_attack, true AS same_benign FROM a")
def _(spark, sf):
    return T.per_attack_consistency(E.attack_sizes(a(spark, sf).select(F.col("attack").alias("label"), "attack_type")))


@R.add("estimate_msg_rate", WITH + ", p AS (SELECT can_id, source_file, count(*) AS n, (max(ts_us) - min(ts_us)) / 3600e6 AS s FROM f GROUP BY 1, 2) SELECT can_id, CAST(coalesce(least(greatest(round(sum(n) FILTER (n > 2 AND s > 0) / sum(s) FILTER (n > 2 AND s > 0) * 20), 2), 400), 5) AS INT) AS rate FROM p GROUP BY 1")
def _(spark, sf):
    return T.message_rate(f(spark, sf).withColumn("ts_us", (F.col("ts_us") / 72000.0)))


@R.add("signal_norm_stats", WITH + ", p AS (SELECT can_id, source_file, avg(signal1) AS m, stddev_pop(signal1) AS s FROM f GROUP BY 1, 2) SELECT can_id, round(avg(m), 6) AS mean, round(max(s), 6) AS std, round((SELECT avg(signal1) FROM f g WHERE g.can_id = p.can_id), 6) AS pooled FROM p GROUP BY 1")
def _(spark, sf):
    x = T.signal_norm_stats(f(spark, sf), "per_file")
    return r9(x.join(T.signal_norm_stats(f(spark, sf)).select("can_id", F.col("mean").alias("pooled")), "can_id"), "mean", "std", "pooled")


IN_ID = "PARTITION BY source_file, can_id ORDER BY ts_us, idx_src"


@R.add("sequence_stats", WITH + f", s AS (SELECT can_id, signal1 AS x, lag(signal1) OVER ({IN_ID}) AS y FROM f QUALIFY row_number() OVER ({IN_ID}) >= 2), v AS (SELECT can_id, x FROM s UNION ALL SELECT can_id, y FROM s) SELECT can_id, count(*) // 2 AS samples, min(x) AS low, max(x) AS high, round(avg(x), 8) AS mean, round(stddev_pop(x), 8) AS std, count(*) FILTER (x IS NULL) AS nulls FROM v GROUP BY 1")
def _(spark, sf):
    return T.sequence_stats(W.sequence_windows(f(spark, sf), 2, ["signal1"])).withColumns({c: F.round(c, 8) for c in ("mean", "std")})


@R.add("signal_profile", WITH + "SELECT source_file, count(*) AS n, round(avg(signal1), 6) AS mean, round(stddev_pop(signal1), 6) AS std, round(quantile_cont(signal1, 0.1), 6) AS q10, round(quantile_cont(signal1, 0.5), 6) AS q50, round(quantile_cont(signal1, 0.9), 6) AS q90 FROM f GROUP BY 1")
def _(spark, sf):
    return r9(T.signal_profile(f(spark, sf)), "mean", "std", "q10", "q50", "q90")


@R.add("signal_histogram", WITH + "SELECT least(CAST(floor((signal1 - lo) / (hi - lo) * 120) AS BIGINT), 119) AS bin, count(*) AS n FROM f, (SELECT min(signal1) AS lo, max(signal1) AS hi FROM f) GROUP BY 1")
def _(spark, sf):
    return T.histogram(f(spark, sf), "signal1", 120)


COLS = ["signal1", "dlc", "can_id", "label"]


def corr(spark, sf):
    return T.correlations(f(spark, sf).withColumns({c: F.col(c).cast("double") for c in COLS}), COLS)


@R.add("corr_matrix", WITH + " UNION ALL ".join(f"SELECT '{x}' AS a, '{y}' AS b, " + ("1.0::DOUBLE" if x == y else f"round(corr({x}, {y}), 6)") + " AS r FROM f" + (" WHERE idx_src = 0" if x == y else "") for i, x in enumerate(COLS) for y in COLS[i:]))
def _(spark, sf):
    return r9(corr(spark, sf), "r")


CORR = " UNION ALL ".join(f"SELECT '{x}' AS a, '{y}' AS b, corr({x}, {y}) AS r FROM f" for i, x in enumerate(COLS) for y in COLS[i + 1 :])


@R.add("correlated_groups", "WITH RECURSIVE " + bridge.DUCK + f", c AS ({CORR}), e AS (SELECT a, b FROM c WHERE 1 - abs(r) <= 0.999 UNION SELECT b, a FROM c WHERE 1 - abs(r) <= 0.999), g AS (SELECT unnest({COLS}) AS a, unnest({COLS}) AS grp UNION SELECT e.b, g.grp FROM g JOIN e USING (a)) SELECT a, min(grp) AS grp FROM g GROUP BY a")
def _(spark, sf):
    return D.correlated_groups(corr(spark, sf), 0.999)


@R.add("window_count_study", WITH + f", w AS (SELECT unnest([{HOUR}, {6 * HOUR}, {24 * HOUR}]) AS size_us), p AS (SELECT size_us, (ts_us - (SELECT min(ts_us) FROM f)) // size_us AS k, count(*) AS n, max(label) AS label FROM f, w GROUP BY 1, 2) SELECT size_us, count(*) AS windows, CAST(sum(label) AS BIGINT) AS attack, count(*) FILTER (label = 0) AS benign, round(avg(n), 6) AS mean_msgs FROM p GROUP BY 1")
def _(spark, sf):
    return r9(T.window_count_study(f(spark, sf), [HOUR, 6 * HOUR, 24 * HOUR]), "mean_msgs")


@R.add("window_size_study", WITH + f""", w AS (SELECT unnest([{HOUR}, {6 * HOUR}]) AS size_us), p AS (SELECT size_us, (ts_us - (SELECT min(ts_us) FROM f)) // size_us AS k, round(max(signal1)) AS score, CAST(sum(label) % 2 AS INT) AS label FROM f, w GROUP BY 1, 2),
g AS (SELECT size_us, score, sum(label) AS p, sum(1 - label) AS n FROM p GROUP BY 1, 2), c AS (SELECT size_us, score, sum(p) OVER v / sum(p) OVER u AS tpr, sum(n) OVER v / sum(n) OVER u AS fpr FROM g WINDOW v AS (PARTITION BY size_us ORDER BY score DESC), u AS (PARTITION BY size_us)), l AS (SELECT *, lag(tpr, 1, 0) OVER (PARTITION BY size_us ORDER BY score DESC) AS lt, lag(fpr, 1, 0) OVER (PARTITION BY size_us ORDER BY score DESC) AS lf FROM c)
SELECT size_us, round(sum((fpr - lf) * (tpr + lt) / 2), 6) AS auc, size_us // 2 AS latency_us FROM l GROUP BY 1""")
def _(spark, sf):
    df = f(spark, sf)
    p = df.crossJoin(F.broadcast(df.agg(F.min("ts_us").alias("t0")))).withColumn("size_us", F.explode(F.array(F.lit(HOUR), F.lit(6 * HOUR)))).groupBy("size_us", F.floor((F.col("ts_us") - F.col("t0")) / F.col("size_us")).alias("k")).agg(F.round(F.max("signal1")).alias("score"), (F.sum("label") % 2).cast("int").alias("label"))
    return E.roc_auc(p, ["size_us"]).select("size_us", F.round("auc", 6).alias("auc"), F.expr("size_us div 2").alias("latency_us"))


GAPS = ", m AS (SELECT source_file, ts_us FROM f WHERE label = 1 UNION ALL SELECT source_file, min(ts_us) FROM f GROUP BY 1 UNION ALL SELECT source_file, max(ts_us) FROM f GROUP BY 1), g AS (SELECT source_file, ts_us, ts_us - lag(ts_us) OVER (PARTITION BY source_file ORDER BY ts_us) AS gap_us FROM m)"


@R.add("attack_free_gaps", WITH + GAPS + " SELECT source_file, max(gap_us) AS max_gap, count(*) AS n, round(quantile_cont(gap_us, 0.5), 3) AS half, round(quantile_cont(gap_us, 0.9), 3) AS most FROM g WHERE gap_us > 0 GROUP BY 1")
def _(spark, sf):
    g = T.attack_free_gaps(f(spark, sf))
    middle = exact_quantiles(g, "gap_us", {"half": 0.5, "most": 0.9}, ["source_file"])
    return r9(g.groupBy("source_file").agg(F.max("gap_us").alias("max_gap"), F.count("*").alias("n")).join(middle, "source_file")).withColumns({c: F.round(c, 3) for c in ("half", "most")})


@R.add("sweep_summary", WITH + ", r AS (SELECT dlc AS trial, source_file AS run, avg(signal1) AS auc FROM f GROUP BY 1, 2) SELECT trial, round(avg(auc), 6) AS mean, round(quantile_cont(auc, 0.5), 6) AS median, round(max(auc), 6) AS best, arg_max(run, (auc, run)) AS best_run FROM r GROUP BY 1")
def _(spark, sf):
    runs = f(spark, sf).groupBy(F.col("dlc").alias("trial"), F.col("source_file").alias("run")).agg(F.avg("signal1").alias("auc"))
    return r9(T.sweep_summary(runs), "mean", "median", "best")


@R.add("f1_by_group_and_n", WITH + "SELECT scenario, " + ", ".join(f"round(avg(signal1) FILTER (dlc = {n}), 6) AS n{n}, round(quantile_cont(CASE WHEN dlc = {n} THEN signal1 END, 0.5), 6) AS m{n}" for n in (1, 2, 3)) + " FROM f GROUP BY 1")
def _(spark, sf):
    p = f(spark, sf).groupBy("scenario").pivot("dlc", [1, 2, 3]).agg(F.avg("signal1").alias("n"), F.percentile("signal1", 0.5).alias("m"))
    return p.select("scenario", *(F.round(f"{n}_{x}", 6).alias(f"{x}{n}") for n in (1, 2, 3) for x in ("n", "m")))


@R.add("baseline_compare", TYPED + ", g AS (SELECT attack_type, avg(signal1) AS v FROM a WHERE attack = 1 GROUP BY 1) SELECT 'ours' AS model, round(max(v) FILTER (attack_type = 'error'), 6) AS error, round(max(v) FILTER (attack_type = 'purchase'), 6) AS purchase FROM g UNION ALL SELECT 'published', 0.979, 0.882")
def _(spark, sf):
    g = a(spark, sf).where("attack = 1").groupBy("attack_type").agg(F.avg("signal1").alias("v")).withColumn("model", F.lit("ours")).groupBy("model").pivot("attack_type", ["error", "purchase"]).agg(F.max("v"))
    published = spark.createDataFrame([("published", 0.979, 0.882)], "model string, error double, purchase double")
    return r9(g.unionByName(published), "error", "purchase")


@R.add("scenario_rollup", WITH + "SELECT scenario, source_file, count(*) AS n, CAST(sum(label) AS BIGINT) AS n_attack, CAST(2 - (scenario IS NOT NULL)::INT - (source_file IS NOT NULL)::INT AS INT) AS level FROM f GROUP BY ROLLUP (scenario, source_file)")
def _(spark, sf):
    return T.scenario_rollup(f(spark, sf), ["scenario", "source_file"])


@R.add("distinct_ids_approx")
def _(spark, sf):
    return f(spark, sf).groupBy("source_file").agg(F.approx_count_distinct("can_id").alias("ids"))


# sorts, limits, sets -----------------------------------------------------------------


@R.add("sort_stable_time", WITH + "SELECT idx_src, row_number() OVER (PARTITION BY source_file ORDER BY ts_us - ts_us % 3600000000, idx_src) AS place FROM f")
def _(spark, sf):
    c = f(spark, sf).withColumn("ts_us", F.col("ts_us") - F.col("ts_us") % HOUR)
    return B.place(c).select("idx_src", (F.col("_nth") + 1).alias("place"))


@R.add("topk_signals", WITH + ", s AS (SELECT 'value' AS signal, signal1 AS err, label FROM f UNION ALL SELECT 'dlc', dlc, label FROM f UNION ALL SELECT 'id', can_id, label FROM f) SELECT signal, round(avg(err) FILTER (label = 1) - avg(err) FILTER (label = 0), 6) AS gain FROM s GROUP BY 1 ORDER BY 2 DESC LIMIT 2")
def _(spark, sf):
    s = f(spark, sf).select("label", F.explode(F.array(*(F.struct(F.lit(n).alias("signal"), F.col(c).cast("double").alias("err")) for n, c in (("value", "signal1"), ("dlc", "dlc"), ("id", "can_id"))))).alias("s")).select("label", "s.*")
    return r9(T.topk_signals(s, 2), "gain")


@R.add("topk_runs", WITH + "SELECT source_file, can_id, count(*) AS n, round(avg(signal1), 6) AS m FROM f GROUP BY 1, 2 ORDER BY n DESC, m DESC, source_file, can_id LIMIT 10")
def _(spark, sf):
    g = f(spark, sf).groupBy("source_file", "can_id").agg(F.count("*").alias("n"), F.round(F.avg("signal1"), 6).alias("m"))
    return g.orderBy(F.desc("n"), F.desc("m"), "source_file", "can_id").limit(10)


@R.add("limit_files", WITH + "SELECT idx_src FROM f WHERE source_file IN (SELECT DISTINCT source_file FROM f ORDER BY 1 LIMIT 3)")
def _(spark, sf):
    return C.limit_files(f(spark, sf), 3).select("idx_src")


@R.add("union_traces", WITH + "SELECT idx_src, dlc, NULL::DOUBLE AS extra FROM f WHERE label = 1 UNION ALL SELECT idx_src, NULL, signal1 FROM f WHERE label = 0")
def _(spark, sf):
    df = f(spark, sf)
    return df.where("label = 1").select("idx_src", "dlc").unionByName(df.where("label = 0").select("idx_src", F.col("signal1").alias("extra")), allowMissingColumns=True)


@R.add("benign_only_types", TYPED + "(SELECT 'only' AS side, scenario FROM a WHERE attack = 0 EXCEPT SELECT 'only', scenario FROM a WHERE attack = 1) UNION ALL (SELECT 'both', source_file FROM a WHERE attack = 0 INTERSECT SELECT 'both', source_file FROM a WHERE attack = 1)")
def _(spark, sf):
    b, k = a(spark, sf).where("attack = 0"), a(spark, sf).where("attack = 1")
    only = b.select("scenario").exceptAll(k.select("scenario")).distinct().select(F.lit("only").alias("side"), "scenario")
    return only.unionByName(b.select("source_file").intersect(k.select("source_file")).select(F.lit("both").alias("side"), F.col("source_file").alias("scenario")))


@R.add("metadata_json", "SELECT event_id, 'k' AS name, CAST(json_extract(props, '$.k') AS DOUBLE) AS value FROM events")
def _(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.from_json("props", "map<string, double>").alias("m"))
    return e.select("event_id", F.explode("m").alias("name", "value"))


@R.add("known_ids", WITH + f"SELECT DISTINCT can_id FROM f WHERE source_file < '{DAY}'")
def _(spark, sf):
    return f(spark, sf).where(f"source_file < '{DAY}'").select("can_id").distinct()


@R.add("unknown_ids", WITH + "SELECT can_id FROM f WHERE source_file >= '2024-01-02' EXCEPT SELECT can_id FROM f WHERE source_file < '2024-01-02'")
def _(spark, sf):
    df = f(spark, sf)
    return df.where("source_file >= '2024-01-02'").select("can_id").distinct().subtract(df.where("source_file < '2024-01-02'").select("can_id"))


@R.add("array_columns", WITH + f"SELECT idx_src, signal1 + coalesce(lag(signal1) OVER ({IN_FILE}), 0) AS s FROM f")
def _(spark, sf):
    q = B.last_values(f(spark, sf), 2, F.col("signal1"), name="q")
    return q.select("idx_src", F.aggregate("q", F.lit(0.0), lambda x, y: x + y).alias("s"))


# matrix runs -------------------------------------------------------------------------


@R.add("evaluate_matrix", TYPED + """, s AS (SELECT 'd' || (can_id % 2) AS dataset, m AS method, round(CASE m WHEN 'value' THEN signal1 ELSE dlc END) AS score, attack AS label FROM a, (SELECT unnest(['value', 'length']) AS m)),
g AS (SELECT dataset, method, score, sum(label) AS p, sum(1 - label) AS n FROM s GROUP BY ALL), c AS (SELECT dataset, method, score, sum(p) OVER v / sum(p) OVER u AS tpr, sum(n) OVER v / sum(n) OVER u AS fpr FROM g WINDOW v AS (PARTITION BY dataset, method ORDER BY score DESC), u AS (PARTITION BY dataset, method)),
l AS (SELECT *, lag(tpr, 1, 0) OVER w AS lt, lag(fpr, 1, 0) OVER w AS lf FROM c WINDOW w AS (PARTITION BY dataset, method ORDER BY score DESC)) SELECT dataset, method, round(sum((fpr - lf) * (tpr + lt) / 2), 6) AS auc, true AS ok FROM l GROUP BY 1, 2
UNION ALL SELECT unnest(['d0', 'd1']), 'broken', NULL, false""")
def _(spark, sf):
    """Two runs over all pairs: the first without the lengths, the second finds its metrics and computes what is missing; broken pairs are rows."""
    rows = a(spark, sf)
    value = {"value": F.round("signal1"), "length": F.col("dlc").cast("double"), "broken": F.when(F.col("idx_src") >= 0, F.raise_error(F.lit("no such score")).cast("double"))}

    def scores(dataset, method):
        return rows.where(F.concat(F.lit("d"), F.col("can_id") % 2) == dataset).select(value[method].alias("score"), F.col("attack").alias("label"))

    pairs = {(d, m): functools.partial(scores, d, m) for d in ("d0", "d1") for m in value}
    path = scratch(spark, "matrix")
    for some in ({k: v for k, v in pairs.items() if k[1] == "value"}, pairs):
        out = X.run_matrix(spark, some, E.roc_auc, "auc double", path)
    return out.select("dataset", "method", F.round("auc", 6).alias("auc"), "ok")


@R.add("plan_inputs", WITH + "SELECT p.dataset, p.role, count(*) AS n, sum(f.idx_src) AS total FROM f JOIN (VALUES ('early', 'train', '2024-01-0'), ('early', 'test', '2024-01-1'), ('early', 'test', '2024-01-2'), ('late', 'train', '2024-01-1'), ('late', 'test', '2024-01-3'), ('late', 'test', '2024-01-2')) p(dataset, role, day) ON f.source_file[:9] = p.day GROUP BY ALL")
def _(spark, sf):
    """Plan entries with one or many globs each; files of several entries are read once."""
    path = scratch(spark, "days")
    f(spark, sf).repartitionByRange("source_file").write.partitionBy("source_file").parquet(path)
    days = lambda *tens: [f"{path}/source_file=2024-01-{t}*/*.parquet" for t in tens]
    entries = [("early", "train", days(0)), ("early", "test", days(1, 2)), ("late", "train", days(1)), ("late", "test", [*days(2, 3), f"{path}/source_file=2024-01-29/*.parquet"])]
    plan = spark.createDataFrame(entries, "dataset string, role string, globs array<string>")
    rows = X.plan_rows(spark, plan, StructType([StructField("idx_src", LongType())]))
    return rows.groupBy("dataset", "role").agg(F.count("*").alias("n"), F.sum("idx_src").alias("total"))
