"""Block-wise ordered work against plain windows over whole traces."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from framewright.operators import blocks as B
from framewright.operators import clean, evaluate
from framewright.plans import catalog

from .oracle import same

SCHEMA = "source_file string, can_id long, ts_us long, idx_src long, v long"


@pytest.fixture(scope="module")
def messages(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice(["a", "a", "a", "b", None]), rnd.choice([1, 1, 2, None]), rnd.choice([None, *range(0, 300, 3), 10**9]), i, rnd.choice([None, i])) for i in range(400)]
    rows += [("one", 1, 5, 400, 1)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def both(got, want, *names):
    a = {r.idx_src: tuple(r[n] for n in names) for r in got.collect()}
    b = {r.idx_src: tuple(r[n] for n in names) for r in want.collect()}
    assert len(a) == 401 and a == b


@pytest.mark.parametrize("blocks", [0, 3, 256])
@pytest.mark.parametrize("keys", [("source_file",), ("source_file", "can_id"), ()])
def test_blocks_equal_whole_traces(messages, monkeypatch, blocks, keys):
    if blocks:
        monkeypatch.setattr(B, "BLOCKS", blocks)
        monkeypatch.setattr(B, "TRACE_ROWS", 0)
    part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    w = part.orderBy(*B.ORDER)
    want = messages.select("*", (F.row_number().over(w) - 1).alias("_nth"), F.count("*").over(part).alias("n"))
    both(B.place(messages, keys, total="n"), want, "_nth", "n")
    for n in (1, 4):
        lags = F.array(*(F.struct(F.lag("idx_src", k).over(w).alias("i"), F.lag("v", k).over(w).alias("v")) for k in range(n - 1, -1, -1)))
        want = messages.withColumn("_last", F.transform(F.filter(lags, lambda x: x.i.isNotNull()), lambda x: x.v))
        both(B.last_values(messages, n, F.col("v"), keys), want, "_last")
    upto, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    want = messages.select("*", F.last("v", ignorenulls=True).over(upto).alias("x"), F.first("v", ignorenulls=True).over(after).alias("y"))
    both(B.carried(B.carried(messages, {"x": F.col("v")}, keys), {"y": F.col("v")}, keys, back=True), want, "x", "y")


def test_fill_and_places(spark, messages, monkeypatch):
    monkeypatch.setattr(B, "TRACE_ROWS", 0)
    filled = clean.fill(messages, ["v"])
    assert filled.count() == 401 and not filled.where("v IS NULL").count()
    p = Window.partitionBy("source_file")
    want = messages.select("idx_src", (F.row_number().over(p.orderBy("idx_src")) - 1).alias("_nth"), F.count("*").over(p).alias("_n"))
    both(evaluate.placed(messages, F.col("idx_src"), ["source_file"]), want, "_nth", "_n")
    none = messages.where("false")
    assert not B.place(none).count() and not B.last_values(none, 3, F.col("v")).count() and not B.carried(none, {"x": F.col("v")}).count()


@pytest.mark.parametrize("name", ["ngram_score_messages", "asof_align_sequences", "strided_image_windows", "contiguous_intervals", "signals_pivot_wide", "chrono_split"])
def test_queries_over_long_traces(spark, sf_dir, monkeypatch, name):
    monkeypatch.setattr(B, "TRACE_ROWS", 0)
    same(catalog.queries()[name](spark, sf_dir), catalog.oracle_sql()[name], sf_dir)
