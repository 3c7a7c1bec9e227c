"""Queries of the evaluation protocol; the score of a frame is its signal value."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import bridge
from ..operators import evaluate as E
from ..operators import windows as W
from ..operators.ranks import exact_quantiles
from ..registry import Registry

R = Registry()
HOUR = 3_600_000_000


def typed(spark, sf):
    return bridge.attack_types(bridge.frames(spark, sf))


def scores(spark, sf):
    """Scores with ties, one slice per payload length, and attack labels."""
    return typed(spark, sf).select("idx_src", "source_file", F.round("signal1").alias("score"), F.col("attack").alias("label"), "attack_type", "dlc", "can_id")


SC = "WITH " + bridge.DUCK_TYPES + ", s AS (SELECT idx_src, source_file, round(signal1) AS score, attack AS label, attack_type, dlc, can_id FROM a)"


def curve_sql(key: str) -> str:
    return f""", g AS (SELECT {key} AS k, score AS threshold, sum(label) AS p, sum(1 - label) AS n FROM s GROUP BY ALL),
c AS (SELECT k, threshold, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER (PARTITION BY k) AS pos, sum(n) OVER (PARTITION BY k) AS neg FROM g WINDOW w AS (PARTITION BY k ORDER BY threshold DESC)),
r AS (SELECT *, CASE WHEN pos > 0 THEN tp / pos END AS tpr, CASE WHEN neg > 0 THEN fp / neg END AS fpr, tp / (tp + fp) AS prec, 2 * tp / (tp + fp + pos) AS f1 FROM c)"""


CURVE = SC + curve_sql("1")
BY_DLC = SC + curve_sql("dlc")


@R.add("roc_points", CURVE + " SELECT threshold, round(tpr, 9) AS tpr, round(fpr, 9) AS fpr FROM r UNION ALL SELECT 'inf'::DOUBLE, 0, 0")
def _(spark, sf):
    return E.roc_points(scores(spark, sf)).select("threshold", F.round("tpr", 9).alias("tpr"), F.round("fpr", 9).alias("fpr"))


@R.add("pr_points", CURVE + " SELECT threshold, round(prec, 9) AS precision, round(tpr, 9) AS recall FROM r")
def _(spark, sf):
    return E.curve(scores(spark, sf)).select("threshold", F.round("precision", 9).alias("precision"), F.round("tpr", 9).alias("recall"))


AUC = "sum((fpr - coalesce(lf, 0)) * (tpr + coalesce(lt, 0)) / 2)"
LAGGED = "(SELECT *, lag(fpr) OVER (PARTITION BY k ORDER BY threshold DESC) AS lf, lag(tpr) OVER (PARTITION BY k ORDER BY threshold DESC) AS lt FROM r)"


@R.add("roc_auc", BY_DLC + f" SELECT k AS dlc, round({AUC}, 9) AS auc FROM {LAGGED} GROUP BY k")
def _(spark, sf):
    return E.roc_auc(scores(spark, sf), ["dlc"]).select("dlc", F.round("auc", 9).alias("auc"))


@R.add("average_precision", BY_DLC + f" SELECT k AS dlc, round(sum((tpr - coalesce(lt, 0)) * prec), 9) AS average_precision FROM {LAGGED} GROUP BY k")
def _(spark, sf):
    return E.average_precision(scores(spark, sf), ["dlc"]).select("dlc", F.round("average_precision", 9).alias("average_precision"))


def first(value: str, tie: str = "threshold DESC") -> str:
    return BY_DLC + f" SELECT k AS dlc, threshold FROM r QUALIFY row_number() OVER (PARTITION BY k ORDER BY {value}, {tie}) = 1"


@R.add("youden_threshold", first("tpr - fpr DESC"))
def _(spark, sf):
    return E.youden_threshold(scores(spark, sf), ["dlc"])


@R.add("best_f1_threshold", first("f1 DESC"))
def _(spark, sf):
    return E.best_f1_threshold(scores(spark, sf), ["dlc"])


@R.add("best_f1_pr", first("f1 DESC", "threshold"))
def _(spark, sf):
    return E.best_f1_threshold(scores(spark, sf), ["dlc"], highest=False)


@R.add("threshold_for_fpr", first("abs(fpr - 0.05)"))
def _(spark, sf):
    return E.threshold_for_fpr(scores(spark, sf), 0.05, ["dlc"])


@R.add("pick_threshold", SC + curve_sql("dlc") + " SELECT k AS dlc, 'youden' AS rule, threshold FROM r QUALIFY row_number() OVER (PARTITION BY k ORDER BY tpr - fpr DESC, threshold DESC) = 1 UNION ALL SELECT * FROM (SELECT k, 'fpr', threshold FROM r QUALIFY row_number() OVER (PARTITION BY k ORDER BY abs(fpr - 0.01), threshold DESC) = 1)")
def _(spark, sf):
    s = scores(spark, sf)
    return E.pick_threshold(s, "youden", ["dlc"]).select("dlc", F.lit("youden").alias("rule"), "threshold").unionByName(E.pick_threshold(s, "fpr", ["dlc"], 0.01).select("dlc", F.lit("fpr").alias("rule"), "threshold"))


@R.add("last_threshold_below_fpr", BY_DLC + " SELECT k AS dlc, min(threshold) AS threshold FROM r WHERE fpr < 0.2 GROUP BY k")
def _(spark, sf):
    return E.last_threshold_below_fpr(scores(spark, sf), 0.2, ["dlc"])


@R.add("tpr_at_fpr_interp", BY_DLC + """, p AS (SELECT k, fpr, tpr FROM r UNION ALL SELECT DISTINCT k, 0, 0 FROM r),
lo AS (SELECT k, max(fpr) AS f, arg_max(tpr, (fpr, tpr)) AS t FROM p WHERE fpr <= 0.1 GROUP BY k), hi AS (SELECT k, min(fpr) AS f, arg_min(tpr, (fpr, tpr)) AS t FROM p WHERE fpr >= 0.1 GROUP BY k)
SELECT k AS dlc, round(lo.t + CASE WHEN hi.f > lo.f THEN (hi.t - lo.t) / (hi.f - lo.f) * (0.1 - lo.f) ELSE 0 END, 9) AS tpr FROM lo JOIN hi USING (k)""")
def _(spark, sf):
    return E.tpr_at_fpr(scores(spark, sf), 0.1, ["dlc"]).select("dlc", F.round("tpr", 9).alias("tpr"))


@R.add("quantile_threshold", SC + " SELECT dlc, round(quantile_cont(score, 0.999), 9) AS threshold FROM s GROUP BY dlc")
def _(spark, sf):
    return E.quantile_threshold(scores(spark, sf), 0.999, ["dlc"]).select("dlc", F.round("threshold", 9).alias("threshold"))


@R.add("three_sigma_threshold", SC + " SELECT dlc, round(avg(score) + 3 * stddev_pop(score), 6) AS threshold FROM s WHERE label = 0 GROUP BY dlc")
def _(spark, sf):
    return E.three_sigma_threshold(scores(spark, sf), ["dlc"]).select("dlc", F.round("threshold", 6).alias("threshold"))


def predicted(spark, sf):
    return scores(spark, sf).withColumn("pred", (F.col("score") >= 20).cast("int"))


PRED = SC + ", p AS (SELECT *, CAST(score >= 20 AS INT) AS pred FROM s), q AS (SELECT source_file, count(*) FILTER (pred = 1 AND label = 1) AS tp, count(*) FILTER (pred = 1 AND label = 0) AS fp, count(*) FILTER (pred = 0 AND label = 1) AS fn, count(*) FILTER (pred = 0 AND label = 0) AS tn FROM p GROUP BY 1)"
RATES = {"precision": ("tp", "tp + fp"), "recall": ("tp", "tp + fn"), "fpr": ("fp", "fp + tn"), "tnr": ("tn", "fp + tn"), "fnr": ("fn", "tp + fn"), "accuracy": ("tp + tn", "tp + fp + fn + tn")}


def rates(null: bool) -> str:
    one = ", ".join((f"round(({a}) / nullif({b}, 0), 9)" if null else f"round(coalesce(({a}) / nullif({b}, 0), 0), 9)") + f" AS {n}" for n, (a, b) in RATES.items())
    return one + ", round(" + ("CASE WHEN tp + fn > 0 THEN " if null else "") + "coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)" + (" END" if null else "") + ", 9) AS f1"


def rounded(df, *names):
    return df.withColumns({n: F.round(n, 9) for n in names or (*RATES, "f1")})


@R.add("confusion", PRED + f" SELECT source_file, tp, fp, fn, tn, {rates(False)} FROM q")
def _(spark, sf):
    return rounded(E.confusion(predicted(spark, sf), ["source_file"]))


@R.add("confusion_nullable", PRED.replace("SELECT source_file, count(*) FILTER", "SELECT source_file, can_id, count(*) FILTER").replace("GROUP BY 1)", "GROUP BY 1, 2)") + f" SELECT source_file, can_id, tp, fp, fn, tn, {rates(True)} FROM q")
def _(spark, sf):
    return rounded(E.confusion(predicted(spark, sf), ["source_file", "can_id"], nullable=True))


@R.add("confusion_rates", PRED + " SELECT source_file, round(tp / (tp + fn), 9) AS hit, round(fp / (fp + tn), 9) AS false_alarm, round(fn / (tp + fn), 9) AS miss, round(tn / (fp + tn), 9) AS correct_reject FROM q")
def _(spark, sf):
    return rounded(E.confusion_rates(predicted(spark, sf), ["source_file"]), "hit", "false_alarm", "miss", "correct_reject")


@R.add("balanced_accuracy", PRED + " SELECT source_file, round((tp / (tp + fn) + tn / (fp + tn)) / 2, 9) AS balanced_accuracy FROM q")
def _(spark, sf):
    return rounded(E.balanced_accuracy(E.confusion(predicted(spark, sf), ["source_file"])), "balanced_accuracy").select("source_file", "balanced_accuracy")


@R.add("mcc", PRED + " SELECT source_file, round(coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 9) AS mcc FROM q")
def _(spark, sf):
    return rounded(E.mcc(E.confusion(predicted(spark, sf), ["source_file"])), "mcc").select("source_file", "mcc")


def bundle(key: str) -> str:
    """Thresholds of six rules and their confusion counts per slice."""
    pick = lambda rule, value: f"SELECT * FROM (SELECT k, '{rule}' AS rule, threshold FROM r QUALIFY row_number() OVER (PARTITION BY k ORDER BY {value}, threshold DESC) = 1)"
    rules = " UNION ALL ".join([pick("youden", "tpr - fpr DESC"), pick("best_f1", "f1 DESC"), *(pick(f"fpr_{t}", f"abs(fpr - {t})") for t in (0.001, 0.01, 0.05)), f"SELECT {key}, 'three_sigma', avg(score) FILTER (label = 0) + 3 * stddev_pop(score) FILTER (label = 0) FROM s GROUP BY 1"])
    return curve_sql(key) + f""", t AS ({rules}), sz AS (SELECT {key} AS k, count(*) AS n, CAST(sum(label) AS BIGINT) AS n_attack FROM s GROUP BY 1), c2 AS (SELECT * FROM sz WHERE n_attack NOT IN (0, n)), z AS (SELECT k, round({AUC}, 9) AS auc FROM {LAGGED} GROUP BY k)
SELECT t.k AS slice, rule, round(threshold, 6) AS threshold, count(*) FILTER (score >= threshold AND label = 1) AS tp, count(*) FILTER (score >= threshold AND label = 0) AS fp, count(*) FILTER (score < threshold AND label = 1) AS fn, count(*) FILTER (score < threshold AND label = 0) AS tn, any_value(auc) AS auc, any_value(c2.n) AS n, any_value(c2.n_attack) AS n_attack, NULL AS note
FROM s JOIN t ON t.k = {key} JOIN z ON z.k = t.k JOIN c2 ON c2.k = t.k GROUP BY t.k, rule, threshold
UNION ALL SELECT k, NULL, NULL, NULL, NULL, NULL, NULL, NULL, n, n_attack, CASE WHEN n_attack = 0 THEN 'benign only' ELSE 'attack only' END FROM sz WHERE n_attack IN (0, n)"""


def in_digits(out):
    return out.withColumn("threshold", F.round("threshold", 6)).withColumn("auc", F.round("auc", 9))


def bundled(df, keys):
    return in_digits(E.evaluate_scores(df, keys))


@R.add("evaluate_scores", SC + bundle("dlc"))
def _(spark, sf):
    return bundled(scores(spark, sf), ["dlc"]).withColumnRenamed("dlc", "slice")


@R.add("evaluate_files", SC + bundle("source_file || '/' || can_id"))
def _(spark, sf):
    """Each id of each file: many of these slices have one class."""
    return bundled(scores(spark, sf).withColumn("slice", F.concat_ws("/", "source_file", F.col("can_id").cast("string"))), ["slice"])


@R.add("evaluate_per_attack", SC.replace(", s AS (", ", s0 AS (") + ", s AS (SELECT score, label, attack_type AS dlc FROM s0 WHERE label = 1 UNION ALL SELECT score, label, t FROM s0, (SELECT DISTINCT attack_type AS t FROM s0 WHERE label = 1) WHERE label = 0)" + bundle("dlc"))
def _(spark, sf):
    return in_digits(E.evaluate_attacks(scores(spark, sf)))


@R.add("evaluate_binary", PRED + " SELECT source_file, tp, fp, fn, tn FROM q")
def _(spark, sf):
    return E.confusion(predicted(spark, sf), ["source_file"]).select("source_file", "tp", "fp", "fn", "tn")


@R.add("single_class_report", SC + " SELECT source_file, can_id, count(*) AS n, CAST(sum(label) AS BIGINT) AS n_attack, CASE WHEN sum(label) = 0 THEN 'benign only' WHEN sum(label) = count(*) THEN 'attack only' END AS note FROM s GROUP BY ALL")
def _(spark, sf):
    return E.single_class_report(scores(spark, sf), ["source_file", "can_id"])


@R.add("score_contract", SC + " SELECT count(*) FILTER (NOT isfinite(score)) AS not_finite, count(*) FILTER (label NOT IN (0, 1)) AS bad_label, count(*) FILTER (score NOT IN (0, 1)) AS not_binary FROM s")
def _(spark, sf):
    return E.score_contract(scores(spark, sf), binary=True)


@R.add("macro_average", PRED + ", m AS (SELECT tp / nullif(tp + fn, 0) AS recall, fp / nullif(fp + tn, 0) AS fpr, tp + fn > 200 AS two FROM q) SELECT round(avg(recall), 9) AS recall_all, round(avg(fpr), 9) AS fpr_all, round(avg(recall) FILTER (two), 9) AS recall_two_class, round(avg(fpr) FILTER (two), 9) AS fpr_two_class FROM m")
def _(spark, sf):
    m = E.confusion(predicted(spark, sf), ["source_file"], nullable=True).withColumn("two", F.col("tp") + F.col("fn") > 200)
    out = E.macro_average(m, ["recall", "fpr"], "two")
    return rounded(out, *out.columns)


@R.add("evaluate_at_train_threshold", SC + """, t AS (SELECT quantile_cont(score, 0.9) AS th FROM s WHERE source_file < '2024-01-16' AND label = 0), p AS (SELECT s.*, coalesce(attack_type, 'benign') AS kind, CAST(score > th AS INT) AS pred FROM s, t WHERE source_file >= '2024-01-16')
SELECT kind, count(*) AS n, round(avg(pred), 9) AS alarm_rate, round(avg(pred) FILTER (label = 1), 9) AS tpr, round(avg(pred) FILTER (label = 0), 9) AS fpr FROM p GROUP BY kind""")
def _(spark, sf):
    s = scores(spark, sf)
    t = E.quantile_threshold(s.where(f"source_file < '{bridge.TRAIN_BEFORE}' AND label = 0"), 0.9).withColumnRenamed("threshold", "th")
    p = s.where(f"source_file >= '{bridge.TRAIN_BEFORE}'").crossJoin(F.broadcast(t)).withColumn("pred", (F.col("score") > F.col("th")).cast("int"))
    out = p.groupBy(F.coalesce("attack_type", F.lit("benign")).alias("kind")).agg(F.count("*").alias("n"), F.avg("pred").alias("alarm_rate"), F.avg(F.when(F.col("label") == 1, F.col("pred"))).alias("tpr"), F.avg(F.when(F.col("label") == 0, F.col("pred"))).alias("fpr"))
    return rounded(out, "alarm_rate", "tpr", "fpr")


@R.add("detection_timeline", PRED + ", x AS (SELECT source_file, ts_us, idx_src, CAST(round(signal1) >= 20 AS INT) AS pred FROM a), y AS (SELECT source_file, row_number() OVER (PARTITION BY source_file ORDER BY ts_us, idx_src) - row_number() OVER (PARTITION BY source_file, pred ORDER BY ts_us, idx_src) AS g FROM x WHERE true QUALIFY pred = 1), i AS (SELECT source_file, count(DISTINCT g) AS alarms FROM y GROUP BY 1) SELECT source_file, tp + fp + fn + tn AS n, tp + fn AS n_attack, tp + fp AS n_detected, tp, fp, fn, alarms FROM q JOIN i USING (source_file)")
def _(spark, sf):
    p = predicted(spark, sf).join(typed(spark, sf).select("idx_src", "ts_us"), "idx_src")
    runs = W.contiguous_intervals(p, "pred").groupBy("source_file").agg(F.count("*").alias("alarms"))
    c = E.confusion(p, ["source_file"]).selectExpr("source_file", "tp + fp + fn + tn AS n", "tp + fn AS n_attack", "tp + fp AS n_detected", "tp", "fp", "fn")
    return c.join(runs, "source_file")


@R.add("roc_downsample", CURVE + ", p AS (SELECT threshold, row_number() OVER (ORDER BY threshold DESC) - 1 AS nth, count(*) OVER () AS n FROM r) SELECT threshold FROM p WHERE nth % greatest(1, CAST(ceil(n / 20.0) AS BIGINT)) = 0")
def _(spark, sf):
    return E.stride_sample(E.curve(scores(spark, sf)), -F.col("threshold"), 20).select("threshold")


@R.add("downsample_linspace", CURVE + ", p AS (SELECT threshold, row_number() OVER (ORDER BY threshold DESC) - 1 AS nth, count(*) OVER () AS n FROM r) SELECT threshold FROM p WHERE nth IN (SELECT CAST(floor(i * (n - 1) / 9.0) AS BIGINT) FROM range(10) t(i), (SELECT count(*) AS n FROM r))")
def _(spark, sf):
    return E.linspace_sample(E.curve(scores(spark, sf)), -F.col("threshold"), 10).select("threshold")


@R.add("downsample_stride", "WITH " + bridge.DUCK + ", p AS (SELECT idx_src, row_number() OVER (PARTITION BY source_file ORDER BY ts_us, idx_src) - 1 AS nth, count(*) OVER (PARTITION BY source_file) AS n FROM f) SELECT idx_src FROM p WHERE nth % greatest(1, CAST(ceil(n / 50.0) AS BIGINT)) = 0")
def _(spark, sf):
    return E.stride_sample(bridge.frames(spark, sf), None, 50, ["source_file"]).select("idx_src")


@R.add("threshold_sweep", SC + ", q AS (SELECT unnest([0.95, 0.99, 0.995, 0.999]) AS q), t AS (SELECT q, quantile_cont(score, [0.95, 0.99, 0.995, 0.999]) AS v FROM s, q WHERE label = 0 GROUP BY q), u AS (SELECT q, v[list_position([0.95, 0.99, 0.995, 0.999], q)] AS th FROM t) SELECT CAST(q AS DOUBLE) AS q, round(th, 9) AS threshold, count(*) FILTER (score > th AND label = 1) AS tp, count(*) FILTER (score > th AND label = 0) AS fp FROM s, u GROUP BY q, th")
def _(spark, sf):
    qs = [0.95, 0.99, 0.995, 0.999]
    s = scores(spark, sf)
    wide = exact_quantiles(s.where("label = 0"), "score", {f"t{k}": q for k, q in enumerate(qs)})
    t = wide.select(F.explode(F.array(*(F.struct(F.lit(q).alias("q"), F.col(f"t{k}").alias("th")) for k, q in enumerate(qs)))).alias("x")).select("x.*")
    met = s.groupBy("score", "label").count().crossJoin(F.broadcast(t)).where("score > th")
    sums = met.groupBy("q", F.round("th", 9).alias("threshold")).agg(F.coalesce(F.sum(F.when(F.col("label") == 1, F.col("count"))), F.lit(0)).alias("tp"), F.coalesce(F.sum(F.when(F.col("label") == 0, F.col("count"))), F.lit(0)).alias("fp"))
    return sums
