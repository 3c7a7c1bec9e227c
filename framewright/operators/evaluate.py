"""One evaluation protocol: ranking curves, threshold rules, confusion counts.

Scores are rows (slice columns..., score, label).  Every curve is made from
running sums over the distinct scores of a slice: scores are counted first, so
the ordered pass sees one row per distinct score, whatever the message count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import kept
from .blocks import place
from .ranks import exact_quantiles, listed, range_of, splitters, with_few

#: Ranges of scores whose running sums are formed apart and joined by their totals.
RANGES = 256
#: Slices with both classes.
TWO = "pos > 0 AND neg > 0"


def _with(rows: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the one row of their slice."""
    return with_few(rows, few, keys) if keys else rows.crossJoin(F.broadcast(few))


def curve(scores: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """tp, fp, totals and rates at each distinct score taken as threshold (score >= threshold).

    Scores are counted once, in a written table.  Running sums go in two steps, so that no
    task orders a whole slice: within each of ``RANGES`` ranges of about as many distinct
    scores, by quantiles, and over the ranges' totals.
    """
    keys = keys or []
    per = kept(scores.groupBy(*keys, "score").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n")), "scores")
    whole = per.groupBy(*keys).agg(splitters(F.col("score"), RANGES).alias("_s"), F.sum("p").alias("pos"), F.sum("n").alias("neg"))
    per = _with(per, whole, keys).withColumn("_r", RANGES - range_of(F.col("_s"), F.col("score"), RANGES)).drop("_s")
    above = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    totals = per.groupBy(*keys, "_r").agg(F.sum("p").alias("_p"), F.sum("n").alias("_n"))  # at most RANGES rows a slice
    totals = totals.select(*keys, "_r", F.coalesce(F.sum("_p").over(above), F.lit(0)).alias("_p"), F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_n"))
    inside = Window.partitionBy(*keys, "_r").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    out = per.join(totals, [*keys, "_r"]).withColumns({"tp": F.col("_p") + F.sum("p").over(inside), "fp": F.col("_n") + F.sum("n").over(inside)})
    out = out.withColumnRenamed("score", "threshold").drop("_r", "_p", "_n")
    rate = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    tp, fp, pos, neg = (F.col(x) for x in ("tp", "fp", "pos", "neg"))
    return out.withColumns({
        "tpr": rate(tp, pos), "fpr": rate(fp, neg), "precision": rate(tp, tp + fp), "f1": rate(2 * tp, tp + fp + pos),
        "tpr_before": rate(tp - F.col("p"), pos), "fpr_before": rate(fp - F.col("n"), neg),
    }).drop("p", "n")


def roc_points(scores: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The curve with its first point (0, 0, infinity)."""
    keys = keys or []
    c = curve(scores, keys).select(*keys, "threshold", "tpr", "fpr")
    zero = c.select(*keys, F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("tpr"), F.lit(0.0).alias("fpr")).distinct()
    return c.unionByName(zero)


def roc_auc(scores: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Trapezoid area; null when a slice has one class."""
    return _area(curve(scores, keys), keys or [])


def _area(c: DataFrame, keys: list[str]) -> DataFrame:
    return c.groupBy(*keys).agg(F.sum((F.col("fpr") - F.col("fpr_before")) * (F.col("tpr") + F.col("tpr_before")) / 2).alias("auc"))


def average_precision(scores: DataFrame, keys: list[str] | None = None) -> DataFrame:
    keys = keys or []
    return curve(scores, keys).groupBy(*keys).agg(F.sum((F.col("tpr") - F.col("tpr_before")) * F.col("precision")).alias("average_precision"))


def _or_median(best: DataFrame, scores: DataFrame, keys: list[str]) -> DataFrame:
    """The threshold of each slice, or its median score where the slice has one class."""
    slices = scores.groupBy(*keys).agg((F.min("label") == F.max("label")).alias("_one"))
    if keys:
        slices = listed(slices)
        alone = scores.join(slices.where("_one").drop("_one"), keys, "left_semi")
        joined = slices.join(best, keys, "left").join(exact_quantiles(alone, "score", {"median": 0.5}, keys), keys, "left")
    else:
        alone = scores.crossJoin(F.broadcast(slices)).where("_one")  # one row
        joined = slices.join(best, F.lit(True), "left").crossJoin(F.broadcast(exact_quantiles(alone, "score", {"median": 0.5})))
    return joined.select(*keys, F.coalesce("threshold", "median").alias("threshold"))


def _best(c: DataFrame, keys: list[str], value: Column, highest_threshold: bool = True) -> DataFrame:
    tie = F.col("threshold") if highest_threshold else -F.col("threshold")
    return c.groupBy(*keys).agg(F.max_by("threshold", F.struct(value, tie)).alias("threshold"))


def youden_threshold(scores: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Threshold of the largest tpr - fpr, the highest at ties; the median score where a slice has one class."""
    keys = keys or []
    best = _best(curve(scores, keys).where(TWO), keys, F.col("tpr") - F.col("fpr"))
    return _or_median(best, scores, keys)


def best_f1_threshold(scores: DataFrame, keys: list[str] | None = None, highest: bool = True) -> DataFrame:
    """Threshold of the largest F1 over all distinct scores; ties go to the highest (ROC rule) or lowest (PR rule); the median score where a slice has one class."""
    keys = keys or []
    return _or_median(_best(curve(scores, keys).where(TWO), keys, F.col("f1"), highest), scores, keys)


def threshold_for_fpr(scores: DataFrame, target: float, keys: list[str] | None = None) -> DataFrame:
    """Threshold whose fpr is nearest to the target, the highest at ties; the median score where a slice has one class."""
    keys = keys or []
    return _or_median(_best(curve(scores, keys).where(TWO), keys, -F.abs(F.col("fpr") - target)), scores, keys)


def last_threshold_below_fpr(scores: DataFrame, limit: float, keys: list[str] | None = None) -> DataFrame:
    return curve(scores, keys).where(F.col("fpr") < limit).groupBy(*(keys or [])).agg(F.min("threshold").alias("threshold"))


def tpr_at_fpr(scores: DataFrame, at: float, keys: list[str] | None = None) -> DataFrame:
    """TPR at an FPR by linear interpolation along the curve."""
    keys = keys or []
    c = roc_points(scores, keys)
    low = c.where(F.col("fpr") <= at).groupBy(*keys).agg(F.max(F.struct("fpr", "tpr")).alias("a"))
    high = c.where(F.col("fpr") >= at).groupBy(*keys).agg(F.min(F.struct("fpr", "tpr")).alias("b"))
    both = low.join(high, keys, "left") if keys else low.join(high, F.lit(True), "left")
    a, b = F.col("a"), F.coalesce("b", "a")
    slope = F.coalesce(F.try_divide(b["tpr"] - a["tpr"], b["fpr"] - a["fpr"]), F.lit(0.0))
    return both.select(*keys, (a["tpr"] + slope * (at - a["fpr"])).alias("tpr"))


def quantile_threshold(scores: DataFrame, q: float, keys: list[str] | None = None) -> DataFrame:
    """Exact quantile with linear interpolation."""
    return exact_quantiles(scores, "score", {"threshold": q}, keys)


def three_sigma_threshold(scores: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean plus three population deviations of benign scores; of all scores where no benign ones exist."""
    benign = F.when(F.col("label") == 0, F.col("score"))
    return scores.groupBy(*(keys or [])).agg((F.coalesce(F.avg(benign), F.avg("score")) + 3 * F.coalesce(F.stddev_pop(benign), F.stddev_pop("score"))).alias("threshold"))


def pick_threshold(scores: DataFrame, rule: str, keys: list[str] | None = None, value: float = 0.01) -> DataFrame:
    rules = {
        "youden": lambda: youden_threshold(scores, keys),
        "best_f1": lambda: best_f1_threshold(scores, keys),
        "three_sigma": lambda: three_sigma_threshold(scores, keys),
        "fpr": lambda: threshold_for_fpr(scores, value, keys),
        "quantile": lambda: quantile_threshold(scores, value, keys),
    }
    return rules[rule]()


def _ratio(a: Column, b: Column, null: bool) -> Column:
    r = F.try_divide(a.cast("double"), b.cast("double"))
    return r if null else F.coalesce(r, F.lit(0.0))


def confusion(df: DataFrame, keys: list[str] | None = None, pred: str = "pred", label: str = "label", nullable: bool = False) -> DataFrame:
    """Counts and rates; an empty denominator gives 0, or null if ``nullable``."""
    p, y = F.col(pred), F.col(label)
    counted = df.groupBy(*(keys or [])).agg(*(F.count_if((p == a) & (y == b)).alias(n) for n, a, b in (("tp", 1, 1), ("fp", 1, 0), ("fn", 0, 1), ("tn", 0, 0))))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    f1 = _ratio(2 * tp, 2 * tp + fp + fn, False)
    return counted.withColumns({
        "precision": _ratio(tp, tp + fp, nullable), "recall": _ratio(tp, tp + fn, nullable), "fpr": _ratio(fp, fp + tn, nullable),
        "tnr": _ratio(tn, fp + tn, nullable), "fnr": _ratio(fn, tp + fn, nullable), "accuracy": _ratio(tp + tn, tp + fp + fn + tn, nullable),
        "f1": F.when(F.lit(not nullable) | (tp + fn > 0), f1),
    })


def confusion_rates(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The signal-detection names of the four rates."""
    c = confusion(df, keys)
    return c.select(*(keys or []), F.col("recall").alias("hit"), F.col("fpr").alias("false_alarm"), F.col("fnr").alias("miss"), F.col("tnr").alias("correct_reject"))


def balanced_accuracy(c: DataFrame) -> DataFrame:
    return c.withColumn("balanced_accuracy", (F.col("recall") + F.col("tnr")) / 2)


def mcc(c: DataFrame) -> DataFrame:
    """Matthews correlation; 0 where it has no value."""
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    return c.withColumn("mcc", F.coalesce(F.try_divide(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))), F.lit(0.0)))


FPRS = (0.001, 0.01, 0.05)
RULES = ("youden", "best_f1", "three_sigma", *(f"fpr_{t}" for t in FPRS))


def evaluate_scores(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Per slice and rule: threshold and confusion at score >= threshold, with the slice's AUC and size; keys are not empty.

    A slice with one class has one row, without rule and metrics, and a note.
    """
    c = curve(scores, keys)
    top = lambda value: F.max_by("threshold", F.struct(value, F.col("threshold")))
    by_curve = c.where(TWO).groupBy(*keys).agg(
        top(F.col("tpr") - F.col("fpr")).alias("youden"), top(F.col("f1")).alias("best_f1"),
        *(top(-F.abs(F.col("fpr") - t)).alias(f"fpr_{t}") for t in FPRS),
    )
    sigma = three_sigma_threshold(scores, keys).withColumnRenamed("threshold", "three_sigma")
    wide = by_curve.join(sigma, keys)
    rules = wide.select(*keys, F.explode(F.create_map(*(x for r in RULES for x in (F.lit(r), F.col(f"`{r}`"))))).alias("rule", "threshold"))
    counts = scores.groupBy(*keys, "score", "label").agg(F.count("*").alias("n"))
    met = counts.join(rules, keys).withColumn("hit", F.col("score") >= F.col("threshold"))
    sums = met.groupBy(*keys, "rule", "threshold").agg(*(F.coalesce(F.sum(F.when(F.col("hit") == a, F.when(F.col("label") == b, F.col("n")))), F.lit(0)).alias(n) for n, a, b in (("tp", True, 1), ("fp", True, 0), ("fn", False, 1), ("tn", False, 0))))
    sizes = single_class_report(scores, keys)
    return sizes.join(sums.join(_area(c, keys), keys, "left"), keys, "left")


def single_class_report(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of each slice, and a note where it has one class only."""
    out = scores.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("label").alias("n_attack"))
    return out.withColumn("note", F.when(F.col("n_attack") == 0, "benign only").when(F.col("n_attack") == F.col("n"), "attack only"))


def attack_sizes(scores: DataFrame, kind: str = "attack_type") -> DataFrame:
    """Messages of each attack type, and the benign ones that each type is held against; benign messages are counted once."""
    attacks = scores.where("label = 1").groupBy(F.col(kind).alias("slice")).agg(F.count("*").alias("n_attack"))
    return attacks.crossJoin(F.broadcast(scores.agg(F.count_if(F.col("label") == 0).alias("n_benign"))))  # one row


def evaluate_attacks(scores: DataFrame, kind: str = "attack_type") -> DataFrame:
    """``evaluate_scores`` of each attack type (column ``slice``) against all benign messages, which are ranked once for all types.

    A type's own scores are the only thresholds where its tp changes, so the best ones by tpr - fpr and by F1 are among
    them, and its area is a sum over them of the benign scores below.  A threshold by fpr is a benign score, or the type's
    highest score where no benign one is above; three deviations are the same for all types.  Nothing is repeated for each
    type, whatever their number.  Messages without a type are a slice of their own (null); without benign messages there
    are sizes and a note.
    """
    attack, benign = F.col("label") == 1, F.col("label") == 0
    counted = scores.where(attack | benign).groupBy(F.when(attack, F.struct(F.col(kind).alias("slice"))).alias("_f"), "score").agg(F.count("*").alias("c"))
    per = kept(counted, "scores").withColumns({"p": F.when(F.col("_f").isNotNull(), F.col("c")).otherwise(0), "n": F.when(F.col("_f").isNull(), F.col("c")).otherwise(0)})
    per = per.crossJoin(F.broadcast(per.agg(splitters(F.col("score"), RANGES).alias("_s")))).withColumn("_r", RANGES - range_of(F.col("_s"), F.col("score"), RANGES)).drop("_s")

    # benign and own messages above each score: within its range, and in the ranges above it
    above = lambda *keys: Window.partitionBy(*keys or [F.lit(0)]).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    inside = lambda *keys: Window.partitionBy(*keys, "_r").orderBy(F.desc("score")).rangeBetween(Window.unboundedPreceding, 0)
    zero = lambda c: F.coalesce(c, F.lit(0))
    sums = per.groupBy("_f", "_r").agg(F.sum("p").alias("_p"), F.sum("n").alias("_n"))  # at most RANGES rows a type
    fps = sums.groupBy("_r").agg(F.sum("_n").alias("_n")).select("_r", zero(F.sum("_n").over(above())).alias("_fp"))
    tps = sums.where("_p > 0").select("_f", "_r", zero(F.sum("_p").over(above("_f"))).alias("_tp"))
    ranked = per.join(fps, "_r").withColumns({"fp": F.col("_fp") + F.sum("n").over(inside()), "_eq": F.sum("n").over(Window.partitionBy("_r", "score"))})
    ranked = ranked.join(tps, ["_f", "_r"], "left").withColumn("tp", F.col("_tp") + F.sum("p").over(inside("_f")))
    ranked = kept(ranked.select("_f", "score", "p", "n", "tp", "fp", "_eq"), "ranked")

    b, fpr = F.col("n") > 0, F.col("fp") / F.col("_neg")
    neg = ranked.agg(zero(F.sum("n")).alias("_neg"), F.max(F.when(b, F.col("score"))).alias("_top"))
    nearest = {t: F.max_by(F.struct(F.col("score").alias("threshold"), "fp", F.abs(fpr - t).alias("off")), F.struct(-F.abs(fpr - t), F.col("score"))) for t in FPRS}
    at_fpr = ranked.where(b).crossJoin(F.broadcast(neg)).agg(*(nearest[t].alias(f"fpr_{t}") for t in FPRS))
    sigma = three_sigma_threshold(scores.where(benign)).select(F.col("threshold").alias("_sigma"))
    one = neg.crossJoin(at_fpr).crossJoin(sigma)  # one row each
    over = ranked.where(b).crossJoin(F.broadcast(sigma)).agg(zero(F.sum(F.when(F.col("score") >= F.col("_sigma"), F.col("n")))).alias("_sigma_fp"))
    one = one.crossJoin(over)

    pos = ranked.where("p > 0")
    sizes = pos.groupBy("_f").agg(F.sum("p").alias("_pos"), F.max("score").alias("_high"))
    own = pos.join(sizes, "_f").crossJoin(F.broadcast(one))
    tpr, f1 = F.try_divide(F.col("tp").cast("double"), F.col("_pos").cast("double")), 2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("_pos"))
    best = lambda value: F.max_by(F.struct(F.col("score").alias("threshold"), "fp", "tp"), F.struct(value, F.col("score")))
    free = F.col("_high") > F.col("_top")  # some of the type's scores are above every benign one
    chosen = {f"fpr_{t}": F.when(free & (F.lit(t) <= F.col(f"`fpr_{t}`.off")), F.struct(F.col("_high").alias("threshold"), F.lit(0).cast("long").alias("fp"))).otherwise(F.struct(F.col(f"`fpr_{t}`.threshold").alias("threshold"), F.col(f"`fpr_{t}`.fp").alias("fp"))) for t in FPRS}
    chosen["three_sigma"] = F.struct(F.col("_sigma").alias("threshold"), F.col("_sigma_fp").alias("fp"))
    hits = {r: F.sum(F.when(F.col("score") >= c["threshold"], F.col("p")).otherwise(0)) for r, c in chosen.items()}
    area = F.sum(F.col("p") * (F.col("_neg") - F.col("fp") + F.col("_eq") / 2)) / F.first("_pos") / F.first("_neg")
    youden, best_f1 = best(tpr - F.try_divide(F.col("fp").cast("double"), F.col("_neg").cast("double"))), best(f1)
    rows = own.where("_neg > 0").groupBy("_f").agg(
        area.alias("auc"), youden.alias("_youden"), best_f1.alias("_best_f1"), *(F.first(c).withField("tp", hits[r]).alias(f"_{r}") for r, c in chosen.items()),
        F.first("_pos").alias("_pos"), F.first("_neg").alias("_neg"),
    )
    rule = lambda r: F.struct(F.lit(r).alias("rule"), *(F.col(f"`_{r}`.{c}").alias(c) for c in ("threshold", "tp", "fp")))
    rows = rows.select("_f", "auc", "_pos", "_neg", F.explode(F.array(*map(rule, RULES))).alias("x")).select("_f", "x.*", (F.col("_pos") - F.col("x.tp")).alias("fn"), (F.col("_neg") - F.col("x.fp")).alias("tn"), "auc")
    out = sizes.crossJoin(F.broadcast(neg)).select("_f", (F.col("_pos") + F.col("_neg")).alias("n"), F.col("_pos").alias("n_attack"), F.when(F.col("_neg") == 0, "attack only").alias("note"))
    return out.join(rows, "_f", "left").withColumn("slice", F.col("_f.slice")).drop("_f")


def score_contract(scores: DataFrame, binary: bool = False) -> DataFrame:
    """Number of rows that break each rule; all are 0 for valid scores."""
    bad = [F.count_if(F.col("score").isNull() | F.isnan("score") | (F.abs("score") == float("inf"))).alias("not_finite"), F.count_if(F.col("label").isNull() | ~F.col("label").isin(0, 1)).alias("bad_label")]
    return scores.agg(*bad, F.count_if(F.lit(binary) & ~F.col("score").isin(0.0, 1.0)).alias("not_binary"))


def macro_average(metrics: DataFrame, values: list[str], two_class: str) -> DataFrame:
    """Means over files that skip nulls: of all files, and of files with both classes."""
    return metrics.agg(*(F.avg(v).alias(f"{v}_all") for v in values), *(F.avg(F.when(F.col(two_class), F.col(v))).alias(f"{v}_two_class") for v in values))


def placed(df: DataFrame, order: Column | None, keys: list[str] | None = None) -> DataFrame:
    """Each row's place (_nth, from 0) in the order and the number of rows (_n), by slice or over all rows.

    The order is a number (nulls first), or None for that of the messages.  Rows are ranked
    in ``RANGES`` ranges of about as many rows, by quantiles, whose sizes are summed, so that no task
    orders a whole slice; rows of one number that fill several ranges are dealt to them by a hash of the row.
    """
    if order is None:
        return place(df, tuple(keys or ()), total="_n")
    rows = df.withColumns({"_k": F.struct(*keys) if keys else F.struct(F.lit(0)), "_o": order})
    bounds = rows.groupBy("_k").agg(splitters(F.col("_o"), RANGES).alias("_s"))  # one row a slice
    hashed = [F.col(f"`{c.name}`") for c in df.schema if "map<" not in c.dataType.simpleString()]
    salt = F.pmod(F.xxhash64(*hashed), F.lit(1 << 20)) / float(1 << 20)
    at = F.when(F.col("_o").isNull(), F.floor(salt * RANGES).cast("int") - RANGES).otherwise(range_of(F.col("_s"), F.col("_o"), RANGES, salt))
    rows = with_few(rows, bounds, "_k").withColumn("_r", at).drop("_s")
    by_slice = Window.partitionBy("_k")
    before = F.coalesce(F.sum("_c").over(by_slice.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = rows.groupBy("_k", "_r").agg(F.count("*").alias("_c")).select("_k", "_r", F.sum("_c").over(by_slice).alias("_n"), before.alias("_b"))
    ranked = rows.withColumn("_i", F.row_number().over(Window.partitionBy("_k", "_r").orderBy("_o")) - 1).join(sizes, ["_k", "_r"])
    return ranked.withColumn("_nth", F.col("_b") + F.col("_i")).drop("_k", "_o", "_r", "_b", "_i")


def stride_sample(df: DataFrame, order: Column | None, most: int, keys: list[str] | None = None) -> DataFrame:
    """Every k-th row of the order, k = ceil(n / most)."""
    k = F.greatest(F.lit(1), F.ceil(F.col("_n") / most))
    return placed(df, order, keys).where(F.col("_nth") % k == 0).drop("_n", "_nth")


def linspace_sample(df: DataFrame, order: Column | None, n: int, keys: list[str] | None = None) -> DataFrame:
    """The rows at places floor(i (N - 1) / (n - 1)), i = 0 .. n - 1."""
    rows = placed(df, order, keys)
    # the row at place r is chosen if some i has floor(i (N - 1) / (n - 1)) = r
    i = F.ceil(F.col("_nth") * (n - 1) / F.greatest(F.col("_n") - 1, F.lit(1)))
    return rows.where((F.floor(i * (F.col("_n") - 1) / (n - 1)) == F.col("_nth")) & (i <= n - 1)).drop("_n", "_nth")
