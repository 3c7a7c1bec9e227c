"""Labelling joins: attack intervals, ids and payload patterns against messages.

Interval tables are dimensions of a few rows a file; a join on the file with a
range condition never repeats a message, because hits are folded per message.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .evaluate import placed


def _hit(df: DataFrame, intervals: DataFrame, on: Column, key: str = "idx_src") -> DataFrame:
    """Label 1 for messages with any interval that fits."""
    i = intervals.select(*(F.col(c).alias(f"i_{c}") for c in intervals.columns))
    hits = df.join(i, (df["source_file"] == F.col("i_source_file")) & on).select("source_file", key).distinct().withColumn("_hit", F.lit(1))
    return df.join(hits, ["source_file", key], "left").withColumn("label", F.coalesce("_hit", F.lit(0))).drop("_hit")


def within() -> Column:
    return F.col("ts_us").between(F.col("i_start_us"), F.col("i_end_us"))


def label_interval_range(df: DataFrame, intervals: DataFrame, fallback: Column) -> DataFrame:
    """In the file's interval; files without one are labelled by a fallback condition on the message."""
    have = intervals.select("source_file").distinct().withColumn("_has", F.lit(True))
    out = _hit(df, intervals, within()).join(have, "source_file", "left")
    return out.withColumn("label", F.when(F.col("_has"), F.col("label")).otherwise(F.when(fallback, 1).otherwise(0))).drop("_has")


def label_interval_id(df: DataFrame, intervals: DataFrame) -> DataFrame:
    """In an interval, and of its id if it names one; open ends and swapped bounds are put right."""
    low, high = F.coalesce("start_us", F.lit(-(2**62))), F.coalesce("end_us", F.lit(2**62))
    right = intervals.select("source_file", "can_id", F.least(low, high).alias("start_us"), F.greatest(low, high).alias("end_us"))
    return _hit(df, right, within() & (F.col("i_can_id").isNull() | (F.col("i_can_id") == F.col("can_id"))))


def label_interval_pattern(df: DataFrame, captures: DataFrame) -> DataFrame:
    """In a capture's interval, of its id and with its payload pattern, each only where the capture gives it; accelerator captures are benign."""
    on = within() & (F.col("i_can_id").isNull() | (F.col("i_can_id") == F.col("can_id"))) & (F.col("i_pattern").isNull() | S.match_payload_pattern(F.rpad("data_hex", 16, "0"), F.col("i_pattern")))
    return _hit(df, captures.where(~F.lower("kind").contains("accelerator")).drop("kind"), on)


def label_rules_time_id(df: DataFrame, kind: Column, attack_from_us: int) -> DataFrame:
    """Denial of service is id 0; the other attacks begin at a fixed time."""
    k = F.lower(kind)
    return df.withColumn("label", F.when(k.contains("dos"), (F.col("can_id") == 0).cast("int")).when(k.contains("fuzz") | k.contains("impersonation"), (F.col("ts_us") >= attack_from_us).cast("int")).otherwise(0))


def mask_join(df: DataFrame, mask: DataFrame) -> DataFrame:
    """Each message with the scaled value of every bit range of its id."""
    return df.join(mask, "can_id").withColumn("value", S.scaled_signal(F.rpad("data_hex", 16, "0"), F.col("start"), F.col("stop")))


def join_predictions_labels(predictions: DataFrame, labels: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of both sides paired by their position within the keys, up to the shorter side."""
    side = lambda df: placed(df, F.col(order), keys).withColumn("pos", F.col("_nth") + 1).drop(order, "_n", "_nth")
    return side(predictions).join(side(labels), [*keys, "pos"])


def lookup_attack_type(scores: DataFrame, messages: DataFrame) -> DataFrame:
    return scores.join(messages.select("idx_src", "attack_type"), "idx_src", "left")


def lookup_threshold(rows: DataFrame, thresholds: DataFrame) -> DataFrame:
    """The threshold whose factor is approximately equal; joined on the rounded factor and its neighbours, then checked."""
    bucket = lambda c: F.round(F.col(c) * 1000).cast("bigint")
    near = thresholds.withColumn("_b", F.explode(F.array(bucket("factor") - 1, bucket("factor"), bucket("factor") + 1)))
    out = rows.withColumn("_b", bucket("wanted")).join(near, "_b", "left")
    ok = F.abs(F.col("wanted") - F.col("factor")) <= 1e-8 + 1e-5 * F.abs("factor")
    return out.where(ok).drop("_b")
