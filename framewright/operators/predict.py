"""A linear predictor of each id's next vector: ridge regression from sums of products."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import last_values


def lagged(df: DataFrame, values: list[str], lags: int) -> DataFrame:
    """Messages with the vector of values (y) and those of the id's ``lags`` messages before it in the file (x, after a 1); only where all are there."""
    whole = last_values(df, lags + 1, F.array(*(F.col(v).cast("double") for v in values)), ("source_file", "can_id"), "_q")
    full = whole.where((F.size("_q") == lags + 1) & ~F.exists(F.flatten("_q"), lambda v: v.isNull()))
    return full.select("*", F.concat(F.array(F.lit(1.0)), F.flatten(F.slice("_q", 1, lags))).alias("x"), F.col("_q")[lags].alias("y")).drop("_q")


def ridge_sums(rows: DataFrame, inputs: int, outputs: int, digits: int = 6) -> DataFrame:
    """Per id: number of rows and the sums of products x x' (upper half, by rows) and x y', in one aggregate of decimals, so that any order of rows gives the same."""
    product = lambda a, b: F.sum(F.round(a * b, digits).cast(f"decimal(38,{digits})")).cast("double")
    x, y = F.col("x"), F.col("y")
    xx = [product(x[i], x[j]) for i in range(inputs) for j in range(i, inputs)]
    xy = [product(x[i], y[j]) for i in range(inputs) for j in range(outputs)]
    return rows.groupBy("can_id").agg(F.count("*").alias("n"), F.array(*xx).alias("xx"), F.array(*xy).alias("xy"))


def ridge_fit(sums: DataFrame, inputs: int, outputs: int, ridge: float) -> DataFrame:
    """Weights (inputs x outputs, by rows) of each id, from its one row of sums; the constant is not shrunk."""

    def solve(rows: pa.Table) -> pa.Table:
        shrink = ridge * np.diag([0.0] + [1.0] * (inputs - 1))
        out = []
        for xx, xy in zip(rows["xx"].to_pylist(), rows["xy"].to_pylist(), strict=True):
            a = np.zeros((inputs, inputs))
            a[np.triu_indices(inputs)] = xx
            a = a + np.triu(a, 1).T
            out.append(np.linalg.lstsq(a + shrink, np.reshape(xy, (inputs, outputs)), rcond=None)[0].ravel().tolist())
        return pa.table([rows["can_id"], pa.array(out, pa.list_(pa.float64()))], names=["can_id", "weights"])

    return sums.groupBy("can_id").applyInArrow(solve, "can_id bigint, weights array<double>")


def ridge_residual(rows: DataFrame, weights: DataFrame, inputs: int, outputs: int) -> DataFrame:
    """Mean squared residual of each message's vector as its id's weights predict it; null for ids without weights."""
    guess = [sum((F.col("x")[i] * F.col("weights")[i * outputs + j] for i in range(inputs)), F.lit(0.0)) for j in range(outputs)]
    error = sum(((F.col("y")[j] - g) ** 2 for j, g in enumerate(guess)), F.lit(0.0)) / outputs
    return rows.join(weights, "can_id", "left").withColumn("score", error).drop("weights", "x", "y")
