"""Projections, filters and cleaning of frames and signals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..schemas import BYTES
from . import windows as W
from .blocks import carried, with_start


def rebase_time(df: DataFrame) -> DataFrame:
    """Times of each file from its first row."""
    return with_start(df).withColumn("ts_us", F.col("ts_us") - F.col("_t0")).drop("_t0")


def null_benign_attack_type(df: DataFrame) -> DataFrame:
    return df.withColumn("attack_type", F.when(F.col("label") == 1, F.col("attack_type")))


def to_frames(df: DataFrame, dataset: str, vehicle: str | None = None, split: str | None = None) -> DataFrame:
    """FRAMES from any source with ts_us, can_id, dlc, data_hex, label, attack_type, source_file, idx_src."""
    data = [S.zero_beyond_dlc(b, i, F.col("dlc")).alias(BYTES[i]) for i, b in enumerate(S.payload_bytes(F.col("data_hex")))]
    out = W.inter_arrival(null_benign_attack_type(df)).select(
        (F.col("ts_us") / 1e6).alias("ts_s"), "ts_us", F.col("can_id").cast("bigint").alias("can_id"), S.sanitize_dlc(F.col("dlc")).alias("dlc"), *data, "data_hex",
        F.col("label").cast("tinyint").alias("label"), "attack_type", F.lit(dataset).alias("dataset"), F.lit("data").alias("frame_type"), F.lit(vehicle).cast("string").alias("vehicle"), F.lit(split).cast("string").alias("split"),
        "idx_src", (F.col("inter_arrival_us") / 1e6).alias("inter_arrival"), "source_file",
    )
    return out


def to_signals(df: DataFrame, signals: list[str], dataset: str) -> DataFrame:
    """SIGNALS from any source with ts_us, can_id, label, attack_type and signal columns."""
    out = W.inter_arrival(null_benign_attack_type(df), per_id=True)
    return out.select((F.col("ts_us") / 1e6).alias("ts_s"), "ts_us", "can_id", F.col("label").cast("tinyint").alias("label"), "attack_type", F.lit(dataset).alias("dataset"), F.lit(None).cast("string").alias("split"), "idx_src", (F.col("inter_arrival_us") / 1e6).alias("inter_arrival"), F.array(*(F.col(s).cast("double") for s in signals)).alias("signals"), "source_file")


def enforce_dtypes(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clean rows, rejected rows): infinite or missing times and ids reject a row; lengths, bytes and labels are coerced."""
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
    ts = finite(F.expr("try_cast(ts_s AS double)"))
    out = df.withColumns({
        "ts_s": ts, "can_id": F.expr("try_cast(can_id AS bigint)"), "dlc": S.sanitize_dlc(F.expr("try_cast(dlc AS int)")),
        "label": F.when(F.expr("try_cast(label AS int)") == 1, 1).otherwise(0).cast("tinyint"), "idx_src": F.coalesce(F.expr("try_cast(idx_src AS bigint)"), F.lit(-1)),
    })
    bad = F.col("ts_s").isNull() | F.col("can_id").isNull()
    return out.where(~bad), out.where(bad)


def filter_selected_ids(df: DataFrame, selected: DataFrame) -> DataFrame:
    return df.join(selected.select("can_id").distinct(), "can_id", "left_semi")


def benign_only(df: DataFrame, label: str = "label") -> DataFrame:
    return df.where(F.col(label) == 0)


def assert_benign(df: DataFrame, label: str = "label") -> DataFrame:
    """The same rows; reading one that is not benign fails."""
    return df.where(F.when(F.col(label) == 0, F.lit(True)).otherwise(F.raise_error(F.lit("training rows must be benign")).cast("boolean")))


def exclude_prefixes(df: DataFrame, prefixes: list[str], column: str = "source_file") -> DataFrame:
    out = df
    for p in prefixes:
        out = out.where(~F.col(column).startswith(p))
    return out


def fill(df: DataFrame, columns: list[str]) -> DataFrame:
    """Forward, then backward fill within each file; rows with nothing to fill from go."""
    same = {c: F.col(c) for c in columns}
    return carried(carried(df, same), same, back=True).dropna(subset=columns)


def time_slice(df: DataFrame, start: float, end: float, relative: bool = False) -> DataFrame:
    """Messages of [start, end] microseconds, from the file's first message if relative."""
    if not relative:
        return df.where(F.col("ts_us").between(start, end))
    return with_start(df).where((F.col("ts_us") - F.col("_t0")).between(start, end)).drop("_t0")


def signals_wide(df: DataFrame, ids: list[int], value: str = "signal1") -> DataFrame:
    """One forward-filled column per id at each message of a file."""
    wide = {f"Sig_1_of_ID_{i}": F.when(F.col("can_id") == i, F.col(value)) for i in ids}
    return carried(df.select("source_file", "ts_us", "idx_src", "can_id", value), wide).select("source_file", "ts_us", "idx_src", *wide)


def limit_files(df: DataFrame, n: int) -> DataFrame:
    """Rows of the first n files by name."""
    first = df.select("source_file").distinct().orderBy("source_file").limit(n)
    return df.join(F.broadcast(first), "source_file", "left_semi") if n <= 1000 else df.join(first, "source_file", "left_semi")


