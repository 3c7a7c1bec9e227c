"""Queries on events as larger tables have them: long ids, and times that stand more than once."""

import os
import re

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framewright.operators import blocks, detect, evaluate, kernel, ranks
from framewright.plans import catalog, q_streams
from framewright.sources import readers
from framewright.streaming import streams

from .oracle import TABLES, same
from .test_stateful import batches_of, run

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def larger(sf_dir, tmp_path_factory):
    """Makes a folder of the supplied tables with other events: ``columns`` replaces columns of these."""

    def make(columns):
        d = tmp_path_factory.mktemp("larger")
        for t in TABLES:
            if t != "events":
                os.symlink(f"{sf_dir}/{t}.parquet", d / f"{t}.parquet")
        duckdb.connect().execute(f"COPY (SELECT * REPLACE ({columns}) FROM '{sf_dir}/events.parquet' ORDER BY event_id) TO '{d}/events.parquet' (FORMAT parquet)")
        return str(d)

    return make


@pytest.mark.parametrize("name", ["scan_frames_csv", "scan_keyed_log", "scan_keyed_log_normal"])
def test_ids_of_more_than_four_digits(spark, larger, name):
    same(QUERIES[name](spark, d := larger("user_id * 60000 + 3 AS user_id")), SQL[name], d)


def test_odd_digits_of_messages_at_one_time(spark, larger):
    same(QUERIES["scan_candump_oddnibble"](spark, d := larger("date_trunc('day', ts) AS ts")), SQL["scan_candump_oddnibble"], d)


def test_odd_policies_beside_each_other(spark, tmp_path):
    (tmp_path / "a.log").write_text("(1.000000) can0 1#123\n(1.000000) can0 1#45\n")
    got = readers.read_candump(spark, str(tmp_path / "a.log"), "right", ("left", "right", "own")).select("data_hex", "left", "right", "own").collect()
    assert sorted(map(tuple, got)) == [("1230", "0123", "1230", "1203"), ("45", "45", "45", "45")]


def test_no_task_gets_a_slice_by_its_key(spark):
    """Rows reach the ranges of their slice without a shuffle by slice, also where nothing is broadcast by its size."""
    slow = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in slow}
    for k, v in slow.items():
        spark.conf.set(k, v)
    try:
        df = spark.range(1000).select("id", (F.col("id") % 2).alias("slice"))
        out = evaluate.placed(df, F.col("id"), ["slice"])
        plan = out._jdf.queryExecution().executedPlan().toString()
        rows = out.collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert all(r._nth == r.id // 2 and r._n == 500 for r in rows) and len(rows) == 1000
    assert "BroadcastHashJoin" in plan


@pytest.mark.parametrize("step", ["quantiles", "curve", "start", "median", "three_step"])
def test_rows_meet_a_few_keys_by_broadcast(spark, monkeypatch, step):
    """Limits of a signal, bounds of a slice and starts of a file reach their rows without a shuffle by these few keys."""
    slow = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in slow}
    plans, plain = [], detect.kept
    seen = lambda x: plans.append(x._jdf.queryExecution().executedPlan().toString()) or x
    monkeypatch.setattr(detect, "kept", lambda x, what: plain(seen(x), what))
    for k, v in slow.items():
        spark.conf.set(k, v)
    try:
        df = spark.range(1000).selectExpr("id AS row_id", "concat('s', id % 2) AS signal", "id * 1.5D AS loss")
        out = {
            "quantiles": lambda: ranks.exact_quantiles(df, "loss", {"half": 0.5}, ["signal"]),
            "curve": lambda: evaluate.curve(df.selectExpr("signal", "loss AS score", "CAST(row_id % 3 = 0 AS INT) AS label"), ["signal"]),
            "start": lambda: blocks.with_start(df.selectExpr("signal AS source_file", "row_id AS ts_us")),
            "median": lambda: evaluate.youden_threshold(df.selectExpr("signal", "loss AS score", "0 AS label"), ["signal"]),
            "three_step": lambda: detect.three_step_threshold(df, df, 0.9, 0.9, 0.95),
        }[step]()
        rows = seen(out).count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert rows == {"quantiles": 2, "median": 2}.get(step, 1000)
    assert not [p for p in plans if re.search(r"(?:SortMerge|ShuffledHash)Join \[(signal|_g|_f)#\d+\], \[\1#\d+\], (?:Inner|LeftSemi)", p)]


@pytest.mark.parametrize("span", [0, 3000, 1_000_000])
def test_trailing_counts_of_a_bucket(span):
    """All ids of a bucket in one state, out of order, with times that repeat, against a plain loop."""
    rnd = np.random.default_rng(span)
    df = pd.DataFrame({"idx_src": range(90), "ts_us": np.sort(rnd.integers(0, 60, 90)) * 1000, "can_id": rnd.integers(-2, 3, 90) * 10**12})
    verb = streams.BucketCounts()
    verb.span_us = verb.silence_us = span
    out = run(verb, 3, batches_of(df, [7, 20, 21, 50], 1), 60_000)
    t, c = df["ts_us"].to_numpy(), df["can_id"].to_numpy()
    want = [int(((t[: k + 1] >= t[k] - span) & (c[: k + 1] == c[k])).sum()) for k in range(90)]
    assert out.sort_values("idx_src")["trailing"].tolist() == want


def test_ids_share_states(spark, tmp_path):
    """A stream of many more ids than ``BUCKETS`` keeps at most so many keys, whose calls are what a batch costs."""
    df = spark.range(2000).selectExpr("id AS can_id", "id AS idx_src", "1000000 * id AS ts_us")
    df.write.parquet(str(tmp_path / "in"))
    own = q_streams.with_state_store(spark)
    verb = streams.trailing_counts(streams.with_time(streams.frame_stream(own, str(tmp_path / "in"), df.schema, 1000)), "1 hour")
    query = verb.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).format("parquet").start(str(tmp_path / "out"))
    query.awaitTermination()
    assert query.recentProgress[0]["stateOperators"][0]["customMetrics"]["numRegisteredTimers"] <= streams.BUCKETS


def test_regions_of_repeated_numbers(spark, larger):
    d = larger("event_id // 2 * 2 AS event_id")
    same(QUERIES["payload_regions_assign"](spark, d), SQL["payload_regions_assign"], d)


def test_regions_of_missing_numbers(spark, larger):
    """Messages without a number come last among the centres, and have no region."""
    d = larger("CASE WHEN event_id % 7 > 0 THEN event_id END AS event_id")
    same(QUERIES["payload_regions_assign"](spark, d), SQL["payload_regions_assign"], d)


def test_kernel_works_on_few_rows_at_once(monkeypatch):
    """Moments of a large batch are those of the whole, from at most ``kernel.ROWS`` rows at a time."""
    rnd, seen, plain = np.random.default_rng(3), [], kernel.chebyshev
    n = 5000
    cell, u, w = rnd.integers(0, 3, n), rnd.uniform(-1, 1, (2, n)), rnd.uniform(0, 1, n)
    monkeypatch.setattr(kernel, "chebyshev", lambda x: seen.append(len(x)) or plain(x))
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in (np.ones(n), cell, cell, *u, w)], names=["gamma", "cx", "cy", "ux", "uy", "w"])
    (got,) = kernel._moments(iter([batch]))
    assert max(seen) <= 1000
    for c, m in zip(got["cx"].to_pylist(), got["m"].to_pylist(), strict=True):
        k = cell == c
        assert np.allclose(np.einsum("ni,nj,n->ij", plain(u[0][k]), plain(u[1][k]), w[k]).ravel(), m)


def test_threshold_is_chosen_from_the_whole_grid(spark, larger):
    """The least false alarms may be at any gamma of the reference's grid, 1e-4 to 1e2."""
    d = larger("user_id * user_id % 97 AS user_id")
    found = QUERIES["freq_threshold"](spark, d)
    same(found, SQL["freq_threshold"], d)
    assert found.first().gamma < 1


def test_threshold_without_some_ids(spark, larger):
    """Points without an id have no score."""
    d = larger("CASE WHEN event_id % 7 > 0 THEN user_id END AS user_id")
    for name in ("freq_threshold", "freq_kernel_score"):
        same(QUERIES[name](spark, d), SQL[name], d)


def test_near_scores_keep_their_order(spark):
    """A small gamma has scores that differ late; they are as far apart as direct sums are, and equal points have equal ones."""
    rnd = np.random.default_rng(8)
    model, points = rnd.uniform(0, 1, (400, 2)), rnd.uniform(0, 1, (3000, 2))
    points[1500:] = points[:1500]
    scale = spark.createDataFrame([(0, 1, 0.0, 1.0)], "low_can_id int, high_can_id int, low_hz double, high_hz double")
    frame = lambda a, names: spark.createDataFrame(pd.DataFrame(a, columns=names)).repartition(3)
    m = frame(model, ["mx", "my"]).withColumn("w", F.lit(1 / 400))
    rows = detect.kernel_scores(frame(points, ["can_id", "hz"]), m, scale, [1e-4, 100.0]).collect()
    assert len(rows) == 6000
    for g in (1e-4, 100.0):
        got = {}
        for r in rows:
            if r.gamma == g:
                got.setdefault((r.can_id, r.hz), set()).add(r.score)
        assert all(len(v) == 1 for v in got.values())
        want = -np.exp(-g * ((points[:1500, None] - model[None]) ** 2).sum(axis=2)).sum(axis=1) / 400
        assert max(abs(got[tuple(p)].pop() - s) for p, s in zip(points[:1500].tolist(), want, strict=True)) < 1e-13
