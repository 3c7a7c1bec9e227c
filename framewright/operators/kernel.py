"""Kernel sums in the plane at a cost linear in points: a fast Gauss transform over cells.

``-sum w exp(-gamma d^2)`` is smooth over a cell of side ``1 / sqrt(gamma)``.  Model points become the
Chebyshev moments of their cells; a cell passes its moments to the cells up to ``REACH`` away; and a point's
score is the value of its cell's polynomial.  Cells that hold no point are never made, so a small gamma has
few cells and a large one no more than points.

Error: interpolation with ``ORDER`` nodes on cells of half a width ``0.5 / sqrt(gamma)`` is off by at most
``1.09 * 0.5 ** (ORDER / 2) / (2 ** (ORDER - 1) * sqrt(ORDER!))``, 2.1e-16, times the Lebesgue constants of the
two steps, and what lies beyond the reach adds at most ``exp(-REACH ** 2)``, 2.3e-16: below 1e-13 in all for
weights that add up to 1, which is about what doubles can tell of such a sum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..scratch import kept
from .ranks import listed

ORDER, REACH = 18, 6
CELL = ["gamma", "cx", "cy"]
MOMENTS = "gamma double, cx long, cy long, m array<double>"

_NODES = np.cos(np.pi * (np.arange(ORDER) + 0.5) / ORDER)


def chebyshev(u: np.ndarray) -> np.ndarray:
    """T_0 .. T_{ORDER-1} of each value, a row a value."""
    return np.cos(np.arange(ORDER) * np.arccos(np.clip(u, -1, 1))[:, None])


#: Node values to coefficients; its transpose takes moments to node weights.
_FIT = chebyshev(_NODES).T * np.where(np.arange(ORDER)[:, None] == 0, 1, 2) / ORDER


def in_cells(points: DataFrame, x: str, y: str, gammas: list[float]) -> DataFrame:
    """Points for each gamma, with their cell and the place in it (ux, uy, from -1 to 1)."""
    out = points.withColumn("gamma", F.explode(F.array(*(F.lit(float(g)) for g in gammas))))
    root = F.sqrt("gamma")
    out = out.withColumns({"cx": F.floor(F.col(x) * root), "cy": F.floor(F.col(y) * root)})
    return out.withColumns({"ux": 2 * (F.col(x) * root - F.col("cx")) - 1, "uy": 2 * (F.col(y) * root - F.col("cy")) - 1})


def _cells_of(gamma: np.ndarray, cx: np.ndarray, cy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of each distinct cell, number of each row's cell)."""
    _, first, own = np.unique(np.rec.fromarrays([gamma, cx, cy]), return_index=True, return_inverse=True)
    return first, own


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), rows.shape[1]).cast(pa.list_(pa.float64()))


#: Rows whose polynomials a task works on at once.
ROWS = 1000


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (batch.slice(k, ROWS) for batch in batches for k in range(0, len(batch), ROWS))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Moments of the cells of each batch."""
    for batch in batches:
        gamma, cx, cy, ux, uy, w = (batch.column(k).to_numpy() for k in range(6))
        if not len(w):
            continue
        first, own = _cells_of(gamma, cx, cy)
        by = np.argsort(own, kind="stable")
        sums = np.zeros((len(first), ORDER * ORDER))
        for at in (by[k : k + ROWS] for k in range(0, len(by), ROWS)):
            both = (chebyshev(ux[at])[:, :, None] * (chebyshev(uy[at]) * w[at, None])[:, None, :]).reshape(len(at), -1)
            cells, begin = np.unique(own[at], return_index=True)
            sums[cells] += np.add.reduceat(both, begin)
        yield pa.RecordBatch.from_arrays([pa.array(gamma[first]), pa.array(cx[first]), pa.array(cy[first]), _lists(sums)], names=[*CELL, "m"])


def _added(rows: pa.Table) -> pa.Table:
    """One row of moments a cell; a group has one row a batch."""
    m = rows["m"].combine_chunks().flatten().to_numpy().reshape(len(rows), -1).sum(axis=0)
    return pa.table([*(rows[c].slice(0, 1) for c in CELL), _lists(m[None])], names=[*CELL, "m"])


def _field(rows: pa.Table) -> pa.Table:
    """Coefficients of the score in a cell, from the moments of at most (2 REACH + 1)^2 cells around it."""
    out = np.zeros((ORDER, ORDER))
    m = rows["m"].combine_chunks().flatten().to_numpy().reshape(-1, ORDER, ORDER)
    for k, (dx, dy) in enumerate(zip(rows["dx"].to_pylist(), rows["dy"].to_pylist(), strict=True)):
        kx, ky = (np.exp(-((d + (_NODES[:, None] - _NODES[None, :]) / 2) ** 2)) for d in (dx, dy))  # in units of cells
        out -= _FIT @ kx @ _FIT.T @ m[k] @ _FIT @ ky.T @ _FIT.T
    return pa.table([*(rows[c].slice(0, 1) for c in CELL), _lists(out.reshape(1, -1))], names=[*CELL, "m"])


def gauss_scores(points: DataFrame, model: DataFrame, gammas: list[float], digits: int = 14) -> DataFrame:
    """Every point (x, y, and more) for each gamma with score = -sum w exp(-gamma d^2) over the model (mx, my, w), rounded."""
    sources = in_cells(model.dropna(subset=["mx", "my"]), "mx", "my", gammas).select(*CELL, "ux", "uy", F.col("w").cast("double"))
    moments = kept(sources.mapInArrow(_moments, MOMENTS).groupBy(*CELL).applyInArrow(_added, MOMENTS), "moments")
    placed = in_cells(points, "x", "y", gammas)
    offsets = F.sequence(F.lit(-REACH), F.lit(REACH))
    passed = moments.withColumn("dx", F.explode(offsets)).withColumn("dy", F.explode(offsets))
    passed = passed.withColumns({"cx": F.col("cx") + F.col("dx"), "cy": F.col("cy") + F.col("dy")})
    wanted = kept(placed.select(*CELL).distinct(), "cells")
    field = listed(passed.join(wanted, CELL, "left_semi").groupBy(*CELL).applyInArrow(_field, MOMENTS))

    names = [*points.columns, "gamma"]
    schema = StructType([*(f for f in placed.schema if f.name in names), StructField("score", DoubleType())])

    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            t = pa.Table.from_batches([batch])
            none = t["m"].combine_chunks().is_null().to_numpy(zero_copy_only=False)  # no model point within reach
            score = np.zeros(len(t))
            held = t.filter(pa.array(~none))
            if len(held):
                c = held["m"].combine_chunks().flatten().to_numpy().reshape(-1, ORDER, ORDER)
                score[~none] = np.einsum("ni,nij,nj->n", chebyshev(held["ux"].to_numpy()), c, chebyshev(held["uy"].to_numpy()))
            score[np.isnan(t["ux"].to_numpy()) | np.isnan(t["uy"].to_numpy())] = np.nan
            yield from t.select(schema.names[:-1]).append_column("score", pa.array(np.round(score, digits) + 0.0)).to_batches()

    return placed.join(field, CELL, "left").mapInArrow(evaluate, schema)
