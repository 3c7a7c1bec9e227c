"""Small fixtures for edge cases of parsing, labelling, windows, detectors and thresholds."""

import random

import pytest
from pyspark.sql import functions as F

from framewright.functions import scalars as S
from framewright.operators import clean, detect, evaluate, labels, rules, stats, windows
from framewright.sources import readers


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_ids_and_labels(spark):
    df = spark.createDataFrame([("0x1A",), (" 290.0",), ("zz",), (None,)], "s string")
    assert [r[0] for r in df.select(S.parse_can_id_trace(F.col("s"))).collect()] == [26, 0x290, None, None]
    t = spark.createDataFrame([("T",), ("odd",), (None,)], "s string")
    assert [r[0] for r in t.select(S.map_label_token(F.col("s"), "null")).collect()] == [1, None, 0]
    with pytest.raises(Exception, match="unknown label"):
        t.select(S.map_label_token(F.col("s"), "error")).collect()


def test_pattern_wildcards(spark):
    df = spark.createDataFrame([("FF00000000000000",)], "h string")
    got = df.select(*(S.match_payload_pattern(F.col("h"), F.lit(p)) for p in ("FF", "FX00", "00", "XXXX00"))).first()
    assert list(got) == [True, True, False, True]


def test_candump_odd_lines(spark, tmp_path):
    (tmp_path / "a.log").write_text("(0.000000) can0 110#0220\n\nbad\n(1.5) can0 7FF#\n(2.000001) can0 1#123\n")
    df = readers.read_candump(spark, str(tmp_path / "a.log"))
    assert rows(df.select("ts_us", "can_id", "dlc", "data0", "data1")) == [(0, 0x110, 2, 2, 0x20), (1_500_000, 0x7FF, 0, 0, 0), (2_000_001, 1, 2, 1, 0x23)]


def test_frames_csv_short_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1.0,0316,2,0a,20,T\n1.5,0316,8,00,01,02,03,04,05,06,07,R\n")
    df = readers.read_frames_csv(spark, str(tmp_path / "a.csv"))
    assert rows(df.select("can_id", "dlc", "data0", "data1", "data2", "label")) == [(0x316, 2, 10, 32, 0, 1), (0x316, 8, 0, 1, 2, 0)]


def frames(spark, data):
    return spark.createDataFrame(data, "source_file string, idx_src long, ts_us long, can_id long, label int")


def test_count_windows_stop_and_boundaries(spark):
    df = frames(spark, [("a", i, i, 1, 0) for i in range(5)] + [("b", 5 + i, i, 1, int(i == 4)) for i in range(5)])
    got = rows(windows.count_windows(df, 4, 2).select("window_no", "n_msgs", "label_window"))
    assert got == [(0, 4, 0), (3, 4, 1)]  # 1 and 2 cross the files, 3 reaches the end


def test_time_windows_gap_when_stride_exceeds_span(spark):
    df = frames(spark, [("a", i, i * 10, 1, 0) for i in range(6)])
    assert rows(windows.time_windows(df, 10, 20).select("window_no", "n_msgs")) == [(0, 1), (1, 1), (2, 1)]


def test_trailing_counts_ties(spark):
    df = frames(spark, [("a", 0, 0, 1, 0), ("a", 1, 5, 1, 0), ("a", 2, 5, 1, 0), ("a", 3, 10, 1, 0), ("a", 4, 16, 1, 0)])
    got = dict(rows(windows.trailing_id_count(df, 10).select("idx_src", "trailing")))
    assert got == {0: 1, 1: 2, 2: 3, 3: 4, 4: 2}


def test_ngram_unknown_symbol(spark):
    train = frames(spark, [("a", i, i, i % 2, 0) for i in range(6)])
    test = frames(spark, [("b", i, i, s, 0) for i, s in enumerate((0, 1, 0, 9, 0, 1, 0))])
    model = detect.ngram_fit(train, 3, "can_id")
    got = [r.score for r in detect.ngram_score(test, model, train, 3, "can_id").orderBy("idx_src").collect()]
    assert got == [0, 0, 0, 1, 1, 1, 0]


def test_interval_never_repeats_rows(spark):
    df = frames(spark, [("a", i, i, 1, 0) for i in range(5)]).drop("label")
    spans = spark.createDataFrame([("a", None, 1, 3), ("a", 1, 2, 2), ("a", 2, 0, 9)], "source_file string, can_id long, start_us long, end_us long")
    assert [r.label for r in labels.label_interval_id(df, spans).orderBy("idx_src").collect()] == [0, 1, 1, 1, 0]


def test_threshold_ties(spark):
    s = spark.createDataFrame([(3.0, 1), (2.0, 0), (1.0, 1), (0.0, 0)], "score double, label int")
    assert evaluate.youden_threshold(s).first()[0] == 3.0
    assert evaluate.best_f1_threshold(s).first()[0] == 1.0
    one = spark.createDataFrame([(1.0, 0), (3.0, 0)], "score double, label int")
    assert evaluate.youden_threshold(one).first()[0] == 2.0
    assert evaluate.roc_auc(one).first()[0] is None


def test_auc_is_symmetric(spark):
    s = spark.range(200).select((F.col("id") * 37 % 101).cast("double").alias("score"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    a, b = evaluate.roc_auc(s).first()[0], evaluate.roc_auc(s.withColumn("score", -F.col("score"))).first()[0]
    assert a + b == pytest.approx(1)


def test_two_attack_types_in_a_window_fail(spark):
    df = spark.createDataFrame([(1, 1, "x"), (1, 1, "y")], "w int, label int, attack_type string")
    with pytest.raises(Exception, match="two attack types"):
        stats.window_attack_type(df, "w").collect()


def test_assert_benign(spark):
    df = frames(spark, [("a", 0, 0, 1, 1)])
    with pytest.raises(Exception, match="benign"):
        clean.assert_benign(df).collect()


def test_region_distances_and_unknown_ids(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (1, [3.0, 4.0]), (2, [1.0, 1.0])], "can_id long, payload array<double>")
    c = spark.createDataFrame([(1, 0, [0.0, 0.0])], "can_id long, region int, centre array<double>")
    assert sorted((r.region, r.distance) for r in rules.regions_assign(df, c).collect()) == [(-1, float("inf")), (0, 0.0), (0, 5.0)]


def test_empty_table(spark):
    df = frames(spark, [])
    for out in (windows.count_windows(df, 3, 1), windows.time_windows(df, 3, 1), windows.contiguous_intervals(df), stats.attack_free_gaps(df)):
        assert out.count() == 0


def test_kernel_scores_of_scaled_points(spark):
    import math

    rows = [(i % 7, float(i * i % 11)) for i in range(60)]
    pts = spark.createDataFrame(rows, "can_id int, hz double")
    scale = detect.fit_minmax(pts)
    got = detect.kernel_scores(pts, detect.kernel_model(pts, scale), scale, [1.0, 10.0]).collect()
    low, high = [min(r[k] for r in rows) for k in (0, 1)], [max(r[k] for r in rows) for k in (0, 1)]
    at = [[(r[k] - low[k]) / (high[k] - low[k]) for k in (0, 1)] for r in rows]
    want = sorted((*r, g, -sum(math.exp(-g * ((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2)) for q in at) / 60) for r, p in zip(rows, at, strict=True) for g in (1.0, 10.0))
    mine = sorted((r.can_id, r.hz, r.gamma, r.score) for r in got)
    assert len(mine) == 120 and all(x[:3] == y[:3] and abs(x[3] - y[3]) < 1e-8 for x, y in zip(mine, want, strict=True))


def test_large_zip_members_stream(spark, tmp_path):
    """An archive whose member is far larger than what a worker holds; names with spaces; archives without a CSV file."""
    import resource
    import zipfile

    from framewright.sources import readers

    line = "x" * 990
    with zipfile.ZipFile(tmp_path / "long one.zip", "w", zipfile.ZIP_DEFLATED) as z, z.open("b.csv", "w") as f:
        for k in range(400):
            f.write("".join(f"{k * 1000 + j:09d}{line}\r\n" for j in range(1000)).encode())
    with zipfile.ZipFile(tmp_path / "none.zip", "w") as z:
        z.writestr("readme.txt", "no csv")
    with zipfile.ZipFile(tmp_path / "two.zip", "w") as z:
        z.writestr("z.csv", "not this")
        z.writestr("a.CSV", "é,1\n\nlast")
    got = readers.read_zip_lines(spark, str(tmp_path / "*.zip"))
    small = got.where("source_file = 'two'").orderBy("line_no").collect()
    assert [(r.line_no, r.line) for r in small] == [(0, "é,1"), (1, ""), (2, "last")]

    def peak(batches):
        import pyarrow as pa

        n = sum(b.num_rows for b in batches)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024])], names=["n", "mb"])

    rows = got.where("source_file = 'long one'").withColumn("at", F.substring("line", 1, 9).cast("long"))
    r = rows.agg(F.count("*").alias("n"), F.count_if(F.col("at") == F.col("line_no")).alias("same"), F.max(F.length("line")).alias("longest")).first()
    assert (r.n, r.same, r.longest) == (400_000, 400_000, 999)  # 400 MB of text
    assert max(x.mb for x in got.mapInArrow(peak, "n long, mb long").collect()) < 350


@pytest.mark.parametrize("case", ["mixed", "apart", "no_benign", "empty"])
def test_attack_types_share_one_ranking(spark, case):
    """Each type against all benign messages, as if these were repeated for it; ties, high types, a missing class, a null type."""
    rng = random.Random(case)
    rows = [(float(rng.randint(0, 30)), 0, None) for _ in range(400)] if case not in ("no_benign", "empty") else []
    if case != "empty":
        rows += [(float(rng.randint(5, 60)), 1, "a") for _ in range(150)] + [(float(rng.randint(0, 20)), 1, "b") for _ in range(50)]
        rows += [(90.0 if case == "apart" else 12.0, 1, "one")]
    scores = spark.createDataFrame(rows, "score double, label int, attack_type string")
    parts = [[(s, y, k) for s, y, t in rows if y == 0 or t == k] for k in sorted({t for _, y, t in rows if y})]
    repeated = spark.createDataFrame([(s, y, k) for part in parts for s, y, k in part], "score double, label int, slice string")
    names = ["slice", "rule", "threshold", "tp", "fp", "fn", "tn", "auc", "n", "n_attack", "note"]
    digits = lambda df: sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(names).collect()), key=str)
    assert digits(evaluate.evaluate_attacks(scores)) == digits(evaluate.evaluate_scores(repeated, ["slice"]))
    if case != "mixed":
        return
    nameless = evaluate.evaluate_attacks(scores.withColumn("attack_type", F.when(F.col("attack_type") != "b", F.col("attack_type"))))
    renamed = [tuple("b" if c is None and i == 0 else c for i, c in enumerate(r)) for r in digits(nameless)]
    assert sorted(renamed, key=str) == digits(evaluate.evaluate_attacks(scores))
