"""The stateful stream verbs over batches in and out of order, against plain loops."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from framewright.plans import q_streams
from framewright.streaming import streams
from framewright.streaming.streams import RollingGrams, TrailingCounts


class Value:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


class Rows(Value):
    def get(self):
        return iter(self.value)

    def put(self, rows):
        self.value = list(rows)

    def appendList(self, rows):  # noqa: N802
        self.value = (self.value or []) + list(rows)


class Handle:
    """State of one key, and its timers."""

    def __init__(self):
        self.timers = set()

    def getValueState(self, name, schema):  # noqa: N802
        return Value()

    def getListState(self, name, schema):  # noqa: N802
        return Rows()

    def registerTimer(self, ms):  # noqa: N802
        self.timers.add(ms)


class At:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.ms


def run(verb, key, batches, delay_us):
    """All output of the batches, with the watermark moved behind each, and behind the last one far on."""
    handle, out, most, mark = Handle(), [], 0, 0
    verb.init(handle)
    for rows in [*batches, None]:
        if rows is not None:
            half = len(rows) // 2  # the chunks of a batch come in any order
            assert not list(verb.handleInputRows((key,), iter([rows.iloc[half:], rows.iloc[:half]]), At(mark)))
            most = max(most, int(rows["ts_us"].max()))
            mark = max(mark, (most - delay_us) // 1000)
        else:
            mark = 10**15
        while due := {t for t in handle.timers if t <= mark}:
            handle.timers -= due
            for t in sorted(due):
                out += list(verb.handleExpiredTimer((key,), At(mark), t))
    assert not verb.pending.exists() and not verb.known.exists() and not handle.timers, "state is left"
    return pd.concat(out)


def batches_of(rows, cuts, seed):
    """Parts of the rows in order, each shuffled, with neighbours exchanged."""
    parts = [rows.iloc[p].sample(frac=1, random_state=seed) for p in np.split(np.arange(len(rows)), cuts)]
    for k in range(0, len(parts) - 1, 3):
        parts[k], parts[k + 1] = parts[k + 1], parts[k]
    return parts


@pytest.mark.parametrize("n", [1, 2, 3, 5])
@pytest.mark.parametrize("cuts", [[], [1, 2, 3], [7, 20]])
def test_rolling_grams(n, cuts):
    rnd = np.random.default_rng(n)
    rows = pd.DataFrame({"idx_src": range(40), "ts_us": np.sort(rnd.integers(0, 30, 40)) * 1000, "symbol": rnd.integers(0, 4, 40)})
    verb = RollingGrams()
    verb.n = n
    s = rows["symbol"].tolist()
    expected = [" ".join(map(str, s[k - n + 1 : k + 1])) if k >= n - 1 else None for k in range(40)]
    out = run(verb, "a", batches_of(rows, cuts, n), 30_000)
    assert out["idx_src"].tolist() == list(range(40)) and out["gram"].tolist() == expected


@pytest.mark.parametrize("span", [0, 3000, 1_000_000])
@pytest.mark.parametrize("cuts", [[], [1, 2, 3], [7, 20]])
def test_trailing_counts(span, cuts):
    rnd = np.random.default_rng(span)
    t = np.sort(rnd.integers(0, 60, 40)) * 1000
    verb = TrailingCounts()
    verb.span_us = verb.silence_us = span
    out = run(verb, 3, batches_of(pd.DataFrame({"idx_src": range(40), "ts_us": t}), cuts, span), 60_000)
    assert out["trailing"].tolist() == [int((t[: k + 1] >= t[k] - span).sum()) for k in range(40)]


def test_a_silent_key_is_forgotten_and_begins_anew():
    rows = pd.DataFrame({"idx_src": range(4), "ts_us": [0, 1000, 10**12, 10**12 + 1000], "symbol": [1, 2, 3, 4]})
    verb = RollingGrams()
    verb.n, verb.silence_us = 2, 10**9
    assert run(verb, "a", [rows.iloc[:2], rows.iloc[2:]], 0)["gram"].tolist() == [None, "1 2", None, "3 4"]


def test_thirty_batches_out_of_order(spark, tmp_path):
    """On the engine: 30 batches, files out of order within the delay, all results final, and no state left but the last key's."""
    rnd = np.random.default_rng(1)
    hour = 3_600_000_000
    t = np.sort(rnd.integers(0, 300, 600)) * hour // 2
    rows = pd.DataFrame({"can_id": rnd.integers(0, 3, 600), "idx_src": range(600), "ts_us": t})
    want = {}
    for k, r in rows.iterrows():
        own = rows[(rows.can_id == r.can_id) & (rows.index <= k)]
        want[int(r.idx_src)] = int((own.ts_us >= r.ts_us - 6 * hour).sum())
    later = pd.DataFrame({"can_id": [9], "idx_src": [-1], "ts_us": [int(t[-1]) + 1000 * hour]})
    schema = "can_id bigint, idx_src bigint, ts_us bigint"
    for part in [*batches_of(rows, [20 * k for k in range(1, 29)], 5), later]:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    own = q_streams.with_state_store(spark)
    own.conf.set("spark.sql.shuffle.partitions", "2")
    verb = streams.trailing_counts(streams.with_time(streams.frame_stream(own, str(tmp_path / "in"), own.read.schema(schema).parquet(str(tmp_path / "in")).schema, 1)), "20 hours")
    query = verb.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).format("parquet").start(str(tmp_path / "out"))
    query.awaitTermination()
    assert sum(p["numInputRows"] > 0 for p in query.recentProgress) == 30
    got = {r.idx_src: r.trailing for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == want
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3  # the message of the last hour waits
    assert spark.conf.get(q_streams.STATE, None) != q_streams.ROCKS and not spark.range(1).where(F.lit(False)).count()
