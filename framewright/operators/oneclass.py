"""One-class machines on random Fourier features, all candidates (gamma, nu) fitted together.

The dual is the point of least norm among the means of point sets of share ``nu`` (every point counts for at
most 1 / (nu N)).  A step is one pass over the distinct points for all candidates at once: the decisions
``w . z`` fall in buckets, whose numbers, least and largest decisions and sums of features are added up.
The lowest buckets of share ``nu`` make the set that descends most; the driver then takes the point of least
norm among the means found so far (a problem of a few dozen numbers).  ``w . w`` less the bound that the buckets
give for the best set is a duality gap: no fit is better by more.

What reaches the driver in a step is at most ``BUCKETS`` rows of features a candidate, whatever the points.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import kept

BUCKETS = 128
#: Below this w . w (it is 0 where nothing parts the points from the origin) the gap counts by itself.
LITTLE = 0.1
_SUMS = "c int, b int, n double, low double, high double, s array<double>"


@dataclass
class Candidate:
    gamma: float
    nu: float
    w: np.ndarray
    rho: float = 0.0
    gap: float = math.inf
    share: float = 1.0  # of training points that support the fit: decisions of at most rho
    span: tuple[float, float] = (0.0, 0.0)
    done: bool = False
    atoms: list[np.ndarray] = field(default_factory=list)
    mix: np.ndarray = field(default_factory=lambda: np.zeros(0))


def frequencies(features: int, seed: int) -> np.ndarray:
    rnd = random.Random(seed)
    return np.array([[rnd.gauss(0, 1), rnd.gauss(0, 1), rnd.uniform(0, 2 * math.pi)] for _ in range(features)])


def fourier(x: np.ndarray, y: np.ndarray, freq: np.ndarray, gamma: float) -> np.ndarray:
    """Features whose products are about exp(-gamma d^2), a row a point."""
    root = math.sqrt(2 * gamma)
    return np.cos(root * (np.outer(x, freq[:, 0]) + np.outer(y, freq[:, 1])) + freq[:, 2]) * math.sqrt(2 / len(freq))


def least_norm(atoms: np.ndarray, mix: np.ndarray) -> np.ndarray:
    """Weights of the point of least norm in the hull of the atoms (Wolfe's method), from feasible weights."""
    g = atoms @ atoms.T
    g = g + np.eye(len(g)) * 1e-13 * max(1e-300, g.trace())
    mix = mix.copy()
    held = np.flatnonzero(mix > 0).tolist()
    for _ in range(10 * len(g) + 10):
        grad = g @ mix
        j = int(np.argmin(grad))
        if grad[j] >= mix @ grad * (1 - 1e-12) - 1e-15 or j in held:
            break
        held.append(j)
        while True:
            inner = np.linalg.solve(g[np.ix_(held, held)], np.ones(len(held)))
            want, now = inner / inner.sum(), mix[held]
            if (want > 0).all():
                mix[:] = 0
                mix[held] = want
                break
            falls = want <= 0
            step = np.min(now[falls] / np.maximum(now[falls] - want[falls], 1e-300))
            now = np.maximum(now + step * (want - now), 0)
            now[falls & (now <= 1e-14)] = 0
            now[np.argmin(np.where(falls, now, np.inf))] = 0
            mix[:] = 0
            mix[held] = now / now.sum()
            held = [k for k, v in zip(held, now, strict=True) if v > 0]
    return mix / mix.sum()


def _pass(freq: np.ndarray, todo: list[tuple[int, float, np.ndarray, tuple[float, float]]]):
    """Bucket sums of a task's points for every open candidate (number, gamma, w, span)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(freq)
        n, s = np.zeros((len(todo), BUCKETS)), np.zeros((len(todo), BUCKETS, d))
        low, high = np.full((len(todo), BUCKETS), np.inf), np.full((len(todo), BUCKETS), -np.inf)
        for batch in batches:
            x, y, times = (batch.column(k).to_numpy() for k in range(3))
            if not len(x):
                continue
            z_of: dict[float, np.ndarray] = {}
            for k, (_, gamma, w, (a, b)) in enumerate(todo):
                if gamma not in z_of:
                    z_of = {gamma: fourier(x, y, freq, gamma)}
                z = z_of[gamma]
                dots = z @ w
                at = np.clip(np.floor((dots - a) / max(b - a, 1e-300) * (BUCKETS - 2)) + 1, 0, BUCKETS - 1).astype(np.int64)
                by = np.argsort(at, kind="stable")
                own, first = np.unique(at[by], return_index=True)
                n[k, own] += np.add.reduceat(times[by], first)
                s[k, own] += np.add.reduceat(z[by] * times[by][:, None], first)
                low[k, own] = np.minimum(low[k, own], np.minimum.reduceat(dots[by], first))
                high[k, own] = np.maximum(high[k, own], np.maximum.reduceat(dots[by], first))
        c, b = np.nonzero(n)
        lists = pa.FixedSizeListArray.from_arrays(pa.array(s[c, b].ravel()), d).cast(pa.list_(pa.float64()))
        number = np.array([t[0] for t in todo], np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(number[c]), pa.array(b.astype(np.int32)), pa.array(n[c, b]), pa.array(low[c, b]), pa.array(high[c, b]), lists], names=["c", "b", "n", "low", "high", "s"])

    return run


def _added(rows: pa.Table) -> pa.Table:
    """One row a bucket; a group has one row a task."""
    s = rows["s"].combine_chunks().flatten().to_numpy().reshape(len(rows), -1).sum(axis=0)
    n, low, high = rows["n"].to_numpy().sum(), rows["low"].to_numpy().min(), rows["high"].to_numpy().max()
    return pa.table([rows["c"].slice(0, 1), rows["b"].slice(0, 1), pa.array([n]), pa.array([low]), pa.array([high]), pa.array([s], pa.list_(pa.float64()))], names=["c", "b", "n", "low", "high", "s"])


def _advance(one: Candidate, n: np.ndarray, low: np.ndarray, high: np.ndarray, s: np.ndarray, tolerance: float) -> None:
    """Takes the bucket sums at the present w: threshold, gap and share; then the next w, unless the gap is small."""
    total, most = n.sum(), one.nu * n.sum()
    upto = np.cumsum(n)
    j = min(int(np.searchsorted(upto, most, side="left")), len(n) - 1)
    rest = most - (upto[j] - n[j])  # points of the last bucket that the set takes, each in part
    below = s[:j].sum(axis=0)
    one.gap = float(one.w @ one.w - (one.w @ below + low[j] * rest) / most)
    one.rho = float(low[j] + (high[j] - low[j]) * rest / n[j])
    one.share = float(upto[j] / total)
    one.done = bool(one.atoms) and one.gap <= tolerance * max(float(one.w @ one.w), LITTLE)
    if one.done:
        return
    one.atoms.append((below + s[j] * (rest / n[j])) / most)
    start = np.append(one.mix, 0.0) if len(one.mix) else np.ones(1)
    one.mix = least_norm(np.array(one.atoms), start)
    kept_ = one.mix > 0
    one.atoms, one.mix = [a for a, k in zip(one.atoms, kept_, strict=True) if k], one.mix[kept_]
    moved = one.mix @ np.array(one.atoms)
    if len(one.atoms) == 1 and not one.w.any():  # the first w: its decisions are not known yet
        wide = math.sqrt(2) * float(np.linalg.norm(moved))
        one.span = (-wide, wide)
    else:
        one.span = (float(low[0]), one.rho + 0.5 * (one.rho - float(low[0])) + 1e-12)
    one.w = moved


def fit_candidates(points: DataFrame, candidates: Sequence[tuple[float, float]], features: int = 32, seed: int = 7, tolerance: float = 1e-3, steps: int = 40) -> tuple[np.ndarray, list[Candidate]]:
    """Frequencies, and the fit of every (gamma, nu) on points (x, y); stops at gaps of ``tolerance`` of w . w each; what is open after ``steps`` keeps its larger gap."""
    freq = frequencies(features, seed)
    order = sorted(range(len(candidates)), key=lambda k: candidates[k])  # of one gamma together: features are made once
    found = [Candidate(float(g), float(nu), np.zeros(features)) for g, nu in candidates]
    weighed = kept(points.groupBy("x", "y").agg(F.count("*").cast("double").alias("n")), "points")
    for _ in range(steps):
        todo = [(k, found[k].gamma, found[k].w, found[k].span) for k in order if not found[k].done]
        if not todo:
            break
        sums = weighed.mapInArrow(_pass(freq, todo), _SUMS).groupBy("c", "b").applyInArrow(_added, _SUMS).toArrow()
        if not len(sums):
            break
        c, b = sums["c"].to_numpy(), sums["b"].to_numpy()
        s = sums["s"].combine_chunks().flatten().to_numpy().reshape(len(c), -1)
        n, low, high = (sums[name].to_numpy() for name in ("n", "low", "high"))
        for k, *_ in todo:
            own = np.flatnonzero(c == k)
            own = own[np.argsort(b[own])]
            _advance(found[k], n[own], low[own], high[own], s[own], tolerance)
    return freq, found


def decision(freq: np.ndarray, one: Candidate) -> Column:
    """rho - w . z of the columns x and y: above 0 for outliers."""
    root, scale = math.sqrt(2 * one.gamma), math.sqrt(2 / len(freq))
    terms = [F.cos(F.col("x") * float(root * a) + F.col("y") * float(root * b) + float(c)) * float(v * scale) for (a, b, c), v in zip(freq, one.w, strict=True)]
    return F.lit(one.rho) - sum(terms[1:], terms[0])
