"""Profiles, rates, splits and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import last_values
from .ranks import exact_quantiles


def window_attack_type(df: DataFrame, *keys: str) -> DataFrame:
    """The single attack type of each window's attack rows; two different ones are an error."""
    kinds = F.collect_set(F.when(F.col("label") == 1, F.coalesce("attack_type", F.lit("attack_unknown"))))
    out = df.groupBy(*keys).agg(kinds.alias("k"))
    return out.select(*keys, F.when(F.size("k") > 1, F.raise_error(F.lit("a window holds two attack types"))).when(F.size("k") == 1, F.element_at("k", 1)).otherwise(F.lit("benign")).alias("attack_type"))


def window_mode_type(df: DataFrame, *keys: str) -> DataFrame:
    """The most frequent type of each window, the smallest at ties."""
    counts = df.groupBy(*keys, "attack_type").agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(F.min_by("attack_type", F.struct(-F.col("n"), F.col("attack_type"))).alias("attack_type"))


def id_share(df: DataFrame) -> DataFrame:
    """Share of each id in all messages."""
    counts = df.groupBy("can_id").agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("t")))).select("can_id", (F.col("n") / F.col("t")).alias("share"))


def quality_profile(train: DataFrame, test: DataFrame) -> DataFrame:
    """Train attack share, test class counts, attack rows without a type, and types on either or both sides."""
    a = train.agg(F.avg("attack").alias("train_attack_share"), F.sort_array(F.collect_set(F.when(F.col("attack") == 0, F.col("scenario")))).alias("train_types"))
    b = test.agg(F.count_if(F.col("attack") == 0).alias("n_benign"), F.count_if(F.col("attack") == 1).alias("n_attack"), F.count_if((F.col("attack") == 1) & F.col("attack_type").isNull()).alias("untyped"), F.sort_array(F.collect_set("scenario")).alias("test_types"))
    both = a.crossJoin(b)  # one row each
    return both.select("train_attack_share", "n_benign", "n_attack", "untyped", F.array_join(F.array_except("test_types", "train_types"), ",").alias("only_test"), F.array_join(F.array_intersect("test_types", "train_types"), ",").alias("in_both"))


def per_attack_consistency(metrics: DataFrame) -> DataFrame:
    """metrics (slice, n_attack, n_benign): the sum of attacks, and whether all slices have the same benign count."""
    return metrics.agg(F.sum("n_attack").alias("n_attack"), (F.min("n_benign") == F.max("n_benign")).alias("same_benign"))


def message_rate(df: DataFrame, low: int = 2, high: int = 400, default: int = 5) -> DataFrame:
    """Messages a second of each id over its files with more than two rows, rounded and held in [low, high]."""
    per = df.groupBy("can_id", "source_file").agg(F.count("*").alias("n"), ((F.max("ts_us") - F.min("ts_us")) / 1e6).alias("s"))
    good = (F.col("n") > 2) & (F.col("s") > 0)
    sums = per.groupBy("can_id").agg(F.sum(F.when(good, F.col("n"))).alias("n"), F.sum(F.when(good, F.col("s"))).alias("s"))
    return sums.select("can_id", F.coalesce(F.least(F.greatest(F.round(F.col("n") / F.col("s")), F.lit(float(low))), F.lit(float(high))), F.lit(float(default))).cast("int").alias("rate"))


def signal_norm_stats(df: DataFrame, mode: str = "pooled") -> DataFrame:
    """Mean and deviation per id: pooled, or the mean of the files' means with the largest of their deviations."""
    if mode == "pooled":
        return df.groupBy("can_id").agg(F.avg("signal1").alias("mean"), F.stddev_pop("signal1").alias("std"))
    per = df.groupBy("can_id", "source_file").agg(F.avg("signal1").alias("m"), F.stddev_pop("signal1").alias("s"))
    return per.groupBy("can_id").agg(F.avg("m").alias("mean"), F.max("s").alias("std"))


def sequence_stats(sequences: DataFrame) -> DataFrame:
    """Per id: number of sequences and figures over all their values (array<array<double>>)."""
    flat = sequences.select("can_id", F.explode(F.flatten("sequence")).alias("x"))
    return sequences.groupBy("can_id").agg(F.count("*").alias("samples")).join(flat.groupBy("can_id").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.count_if(F.col("x").isNull()).alias("nulls")), "can_id")


def signal_profile(df: DataFrame) -> DataFrame:
    quantiles = exact_quantiles(df, "signal1", {f"q{int(100 * q)}": q for q in (0.1, 0.5, 0.9)}, ["source_file"]).withColumnRenamed("source_file", "_f")
    per = df.groupBy("source_file").agg(F.count("*").alias("n"), F.avg("signal1").alias("mean"), F.stddev_pop("signal1").alias("std"))
    return per.join(quantiles, F.col("source_file").eqNullSafe(F.col("_f"))).drop("_f")


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Counts in equal bins between the smallest and the largest value."""
    bounds = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    at = F.least(F.floor((F.col(column) - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-12)) * bins), F.lit(bins - 1))
    return df.crossJoin(F.broadcast(bounds)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every pair of columns in one pass; undefined ones are 0, the diagonal is 1."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    row = df.agg(*((F.lit(1.0) if a == b else F.coalesce(F.when(~F.isnan(F.corr(a, b)), F.corr(a, b)), F.lit(0.0))).alias(f"{a}|{b}") for a, b in pairs))
    return row.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs))).alias("x")).select("x.*")


def window_count_study(df: DataFrame, sizes_us: list[int]) -> DataFrame:
    """Windows, attack windows and mean messages for each window size, in one job."""
    origin = df.agg(F.min("ts_us").alias("t0"))
    placed = df.crossJoin(F.broadcast(origin)).withColumn("size_us", F.explode(F.array(*map(F.lit, sizes_us)))).withColumn("window_no", F.floor((F.col("ts_us") - F.col("t0")) / F.col("size_us")))
    per = placed.groupBy("size_us", "window_no").agg(F.count("*").alias("n"), F.max("label").alias("label"))
    return per.groupBy("size_us").agg(F.count("*").alias("windows"), F.sum("label").alias("attack"), F.count_if(F.col("label") == 0).alias("benign"), F.avg("n").alias("mean_msgs"))


def attack_free_gaps(df: DataFrame) -> DataFrame:
    """Per file: stretches without attack messages, before the first, between two and after the last."""
    marks = df.where("label = 1").select("source_file", "ts_us", "idx_src")
    edges = df.groupBy("source_file").agg(F.min("ts_us").alias("a"), F.max("ts_us").alias("b"))
    both = marks.unionByName(edges.select("source_file", F.explode(F.array("a", "b")).alias("ts_us"), F.lit(-1).cast("bigint").alias("idx_src")))
    pair = last_values(both, 2, F.col("ts_us"), name="_pair").where(F.size("_pair") == 2)
    return pair.withColumn("gap_us", F.col("ts_us") - F.col("_pair")[0]).where("gap_us > 0").select("source_file", "ts_us", "gap_us")


def sweep_summary(runs: DataFrame) -> DataFrame:
    """Per trial: mean, median and best value, and the run that has it."""
    return runs.groupBy("trial").agg(F.avg("auc").alias("mean"), F.percentile("auc", 0.5).alias("median"), F.max("auc").alias("best"), F.max_by("run", F.struct("auc", "run")).alias("best_run"))


def scenario_rollup(df: DataFrame, levels: list[str]) -> DataFrame:
    """Totals and subtotals over nested levels, with the number of levels that a row leaves out."""
    return df.rollup(*levels).agg(F.count("*").alias("n"), F.sum("label").alias("n_attack"), F.expr("CAST(bit_count(grouping_id()) AS INT)").alias("level"))


def topk_signals(df: DataFrame, k: int) -> DataFrame:
    """Signals (signal, err, label) by the largest difference of mean error between attack and benign rows; by the mean where there is one class."""
    per = df.groupBy("signal").agg(F.avg(F.when(F.col("label") == 1, F.col("err"))).alias("a"), F.avg(F.when(F.col("label") == 0, F.col("err"))).alias("b"), F.avg("err").alias("m"))
    return per.select("signal", F.coalesce(F.col("a") - F.col("b"), F.col("m")).alias("gain")).orderBy(F.desc("gain"), "signal").limit(k)


