"""Detectors whose models are DataFrames, so that scoring is a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import kept
from . import windows as W
from .blocks import carried, fits, last_values, with_start
from .kernel import gauss_scores
from .ranks import exact_quantiles, listed, range_of, splitters, with_few

# n-grams ----------------------------------------------------------------------


def ngram_fit(df: DataFrame, n: int, symbol: str, short: bool | None = None) -> DataFrame:
    """Distinct n-grams of benign traffic."""
    return W.ngrams(df, n, symbol, short=short).where("gram IS NOT NULL").select("gram").distinct()


def ngram_score(df: DataFrame, model: DataFrame, known: DataFrame, n: int, symbol: str, short: bool | None = None) -> DataFrame:
    """1 for a message whose symbol is unknown or whose n-gram is not in the model; 0 for the first n - 1 of a trace."""
    grams = W.ngrams(df, n, symbol, short=short)
    seen = grams.join(model.withColumn("_seen", F.lit(True)), "gram", "left")
    named = seen.join(known.select(F.col(symbol)).distinct().withColumn("_known", F.lit(True)), symbol, "left")
    return named.withColumn("score", F.when(F.col("gram").isNull(), 0).when(F.col("_known").isNull() | F.col("_seen").isNull(), 1).otherwise(0)).drop("_seen", "_known")


def ngram_sweep(train: DataFrame, test: DataFrame, sizes: list[int], symbol: str, label: str) -> DataFrame:
    """Confusion counts for every n in one job: grams of all sizes in one (n, gram) table."""

    def every(df: DataFrame) -> DataFrame:
        whole = last_values(df, max(sizes), F.col(symbol), name="_g")
        return whole.withColumn("n", F.explode(F.array(*map(F.lit, sizes)))).withColumn("gram", F.when(F.size("_g") >= F.col("n"), F.slice("_g", -F.col("n"), F.col("n")))).drop("_g")

    model = every(train).where("gram IS NOT NULL").select("n", "gram").distinct().withColumn("_seen", F.lit(True))
    scored = every(test).join(model, ["n", "gram"], "left").withColumn("pred", F.when(F.col("gram").isNotNull() & F.col("_seen").isNull(), 1).otherwise(0))
    y, p = F.col(label), F.col("pred")
    return scored.groupBy("n").agg(F.count_if((p == 1) & (y == 1)).alias("tp"), F.count_if((p == 1) & (y == 0)).alias("fp"), F.count_if((p == 0) & (y == 1)).alias("fn"))


def f1(c: DataFrame) -> DataFrame:
    return c.withColumn("f1", F.coalesce(F.try_divide(2.0 * F.col("tp"), (2 * F.col("tp") + F.col("fp") + F.col("fn")).cast("double")), F.lit(0.0)))


# frequencies --------------------------------------------------------------------


def id_rates(df: DataFrame, seconds: float, *keys: str) -> DataFrame:
    """Messages a second of each id in each window."""
    return df.groupBy(*keys, "can_id").agg((F.count("*") / seconds).alias("hz"))


def kernel_model(points: DataFrame, scale: DataFrame) -> DataFrame:
    """Distinct scaled (id, rate) points with their share of all training points."""
    counts = scaled_points(points, scale).groupBy("x", "y").agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total")))).select(F.col("x").alias("mx"), F.col("y").alias("my"), (F.col("n") / F.col("total")).alias("w"))


def fit_minmax(points: DataFrame) -> DataFrame:
    return points.agg(*(f(c).alias(f"{n}_{c}") for c in ("can_id", "hz") for n, f in (("low", F.min), ("high", F.max))))


def scaled_points(points: DataFrame, scale: DataFrame) -> DataFrame:
    def unit(c: str) -> Column:
        return (F.col(c) - F.col(f"low_{c}")) / F.greatest(F.col(f"high_{c}") - F.col(f"low_{c}"), F.lit(1e-12))

    drop = [f"{n}_{c}" for c in ("can_id", "hz") for n in ("low", "high")]
    return points.crossJoin(F.broadcast(scale)).withColumns({"x": unit("can_id"), "y": unit("hz")}).drop(*drop)


def kernel_scores(points: DataFrame, model: DataFrame, scale: DataFrame, gammas: list[float]) -> DataFrame:
    """Parzen score -sum w exp(-gamma d^2) of every point, for each gamma, by a fast Gauss transform (error below 1e-13).

    Equal points share one sum, so that their scores are equal in every digit.  Points without an id or a rate have none.
    """
    placed = kept(scaled_points(points, scale), "points")
    return placed.join(gauss_scores(placed.select("x", "y").dropna().distinct(), model, gammas), ["x", "y"])


# signals -----------------------------------------------------------------------------


def asof_align(df: DataFrame, values: dict[int, int], cutoff_us: int = 0) -> DataFrame:
    """Each message with the latest sequence of every id (id -> window length), as a backward as-of join.

    Rows begin after the file's first time plus the cutoff, once every id has a
    sequence.
    """
    mine = F.create_map(*(F.lit(x) for kv in values.items() for x in kv))
    rows = df.where(F.col("can_id").isin(*values)).withColumn("_n", F.try_element_at(mine, F.col("can_id").cast("int")))
    longest = max(values.values())
    short = fits(rows, ("source_file",))  # then its ids are short, too
    q = F.filter("_q", lambda x: x.isNotNull())
    rows = last_values(rows, longest, F.col("signal1"), ("source_file", "can_id"), "_q", short).withColumn("_q", q)
    rows = rows.withColumn("_q", F.slice("_q", -F.least(F.col("_n"), F.size("_q")), F.least(F.col("_n"), F.size("_q"))))
    rows = carried(rows, {f"seq_{k}": F.when((F.col("can_id") == k) & (F.size("_q") == n), F.col("_q")) for k, n in values.items()}, short=short)
    ready = F.col("ts_us") > F.col("_t0") + cutoff_us
    for k in values:
        ready = ready & F.col(f"seq_{k}").isNotNull()
    return with_start(rows).where(ready).drop("_q", "_n", "_t0")


def pca_residual(train: DataFrame, test: DataFrame, features: str, k: int) -> DataFrame:
    """Mean squared residual of test vectors from the k principal directions of the training vectors."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    vec = lambda d: d.withColumn("_v", array_to_vector(features))
    scaler = StandardScaler(inputCol="_v", outputCol="_z", withMean=True, withStd=True).fit(vec(train))
    pca = PCA(k=k, inputCol="_z", outputCol="_p").fit(scaler.transform(vec(train)))
    parts = pca.pc.toArray()  # a matrix of features x k
    rebuilt = F.array(*(sum((F.col("_pa")[j] * float(parts[i][j]) for j in range(k)), F.lit(0.0)) for i in range(parts.shape[0])))
    out = pca.transform(scaler.transform(vec(test))).withColumns({"_pa": vector_to_array("_p"), "_za": vector_to_array("_z")})
    mse = F.aggregate(F.zip_with("_za", rebuilt, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x) / parts.shape[0]
    return out.withColumn("score", mse).drop("_v", "_z", "_p", "_pa", "_za")


#: Blocks that the rows of a signal are cut in.
BLOCKS = 256


def running_share(df: DataFrame, rows: int = 10) -> DataFrame:
    """Mean of ``hit`` over the last ``rows`` rows of each signal, as ``run``; row_id is a number.

    A signal's rows are cut in blocks of about as many rows, by quantiles of row_id; the
    last rows before a block are carried into it, so that no task holds a whole signal.
    """
    ends = df.groupBy("signal").agg(splitters(F.col("row_id"), BLOCKS).alias("_s"))
    part = with_few(df, ends, "signal").withColumn("_b", range_of(F.col("_s"), F.col("row_id"), BLOCKS)).drop("_s")
    block = Window.partitionBy("signal", "_b")
    last = part.withColumn("_k", F.row_number().over(block.orderBy(F.desc("row_id")))).where(F.col("_k") < rows)
    tails = last.groupBy("signal", "_b").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_id", "hit"))), lambda x: x.hit).alias("_t"))
    # every block that exists has a row, so rows - 1 blocks are enough
    held = F.flatten(F.collect_list("_t").over(Window.partitionBy("signal").orderBy("_b").rowsBetween(1 - rows, -1)))
    tails = tails.select("signal", "_b", held.alias("_p"))
    inside = block.orderBy("row_id").rowsBetween(1 - rows, 0)
    out = part.withColumns({"_s": F.sum("hit").over(inside), "_c": F.count("hit").over(inside)}).join(tails, ["signal", "_b"])
    more = F.least(F.size("_p"), rows - F.col("_c")).cast("int")
    before = F.when(more > 0, F.aggregate(F.slice("_p", F.size("_p") - more + 1, F.greatest(more, F.lit(0))), F.lit(0.0), lambda s, x: s + x)).otherwise(0.0)
    return out.withColumn("run", (F.col("_s") + before) / (F.col("_c") + F.greatest(more, F.lit(0)))).drop("_b", "_s", "_c", "_p")


def three_step_threshold(train: DataFrame, test: DataFrame, loss_q: float, time_q: float, signal_q: float) -> DataFrame:
    """Losses (row_id, signal, loss): per-signal loss limit, per-signal limit on the running share of violations, and a limit on the share of violating signals."""
    loss = listed(exact_quantiles(train, "loss", {"loss_limit": loss_q}, ["signal"]))

    def violations(df: DataFrame) -> DataFrame:
        return kept(running_share(df.join(loss, "signal").withColumn("hit", (F.col("loss") > F.col("loss_limit")).cast("double"))).select("row_id", "signal", "run"), "violations")

    a = violations(train)
    time = listed(exact_quantiles(a, "run", {"time_limit": time_q}, ["signal"]))

    def shares(df: DataFrame) -> DataFrame:
        return df.join(time, "signal").groupBy("row_id").agg(F.avg((F.col("run") > F.col("time_limit")).cast("double")).alias("share"))

    limit = exact_quantiles(shares(a), "share", {"signal_limit": signal_q})
    return shares(violations(test)).crossJoin(F.broadcast(limit)).select("row_id", "share", (F.col("share") > F.col("signal_limit")).cast("int").alias("pred"))


def score_ensemble(scores: DataFrame, periods: int) -> DataFrame:
    """Mean label and loss over sampling periods at equal row positions; positions that all periods have."""
    return scores.groupBy("row").agg(F.count_distinct("period").alias("_p"), F.avg("loss").alias("loss"), F.avg("label").alias("_l")).where(F.col("_p") == periods).select("row", "loss", (F.col("_l") >= 0.5).cast("int").alias("label"))


def correlated_groups(pairs: DataFrame, limit: float) -> DataFrame:
    """Groups of features whose correlation distance is at most ``limit``, by spreading the smallest name until nothing moves."""
    pairs = kept(pairs, "pairs")  # every round reads them
    near = pairs.where(1 - F.abs("r") <= limit)
    both = near.select("a", "b").unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(pairs.select("a", F.col("a").alias("b"))).unionByName(pairs.select(F.col("b").alias("a"), "b")).distinct()
    known = {r.a: r.a for r in both.select("a").distinct().collect()}  # one row a feature column
    while True:
        label = pairs.sparkSession.createDataFrame(sorted(known.items()), "b string, grp string")
        moved = {r.a: r.grp for r in both.join(label, "b").groupBy("a").agg(F.min("grp").alias("grp")).collect()}
        if moved == known:  # names only get smaller, so this is reached
            return label.withColumnRenamed("b", "a")
        known = moved
