"""Iterative fits and approximate queries against numpy or their invariants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.operators import blocks, detect, evaluate, oneclass, ranks, rules, stats, windows
from framewright.plans import catalog

Q = catalog.queries()


def test_correlated_groups_against_union(spark):
    rng = np.random.default_rng(3)
    names = [f"s{k:02d}" for k in range(60)]
    near = {(k, k + 1) for k in range(40)} | {(50, 55), (51, 55)}  # a chain of 41 and a star
    pairs = [(names[i], names[j], 1.0 if i == j else 0.99 if (i, j) in near else float(rng.uniform(-0.5, 0.5))) for i in range(60) for j in range(i, 60)]
    group = dict(zip(names, names, strict=True))
    for i, j in sorted(near):
        low, high = sorted((group[names[i]], group[names[j]]))
        group = {n: low if g == high else g for n, g in group.items()}
    got = detect.correlated_groups(spark.createDataFrame(pairs, "a string, b string, r double"), 0.05)
    assert {r.a: r.grp for r in got.collect()} == group


def test_random_window_split(spark, sf_dir):
    one, two = ({(r.source_file, r.window_no): r.split for r in Q["random_window_split"](spark, sf_dir).collect()} for _ in range(2))
    assert one == two and set(one.values()) <= {"train", "valid", "test"}
    rows = windows.random_split(spark.range(20_000).withColumn("key", F.col("id").cast("string")), "key", 13, {"train": 0.7, "valid": 0.1, "test": 0.2}).groupBy("split").count().collect()
    share = {r.split: r["count"] / 20_000 for r in rows}
    assert share["train"] == pytest.approx(0.7, abs=0.02) and share["valid"] == pytest.approx(0.1, abs=0.02) and share["test"] == pytest.approx(0.2, abs=0.02)


def test_regions_fit_against_numpy(spark):
    rng = np.random.default_rng(5)
    data = [(int(i % 3), [float(x) for x in rng.integers(0, 6, 4)]) for i in range(300)]
    df = spark.createDataFrame(data, "can_id long, payload array<double>")
    got = rules.regions_fit(df, 3, rounds=3).collect()
    starts = df.distinct().withColumn("h", F.xxhash64("payload")).orderBy("h", "payload").collect()
    for i in range(3):
        x = np.array([p for c, p in data if c == i])
        centres = np.array([r.payload for r in starts if r.can_id == i][:3])
        for _ in range(3):
            d = np.sqrt(((x[:, None] - centres) ** 2).sum(axis=2))
            own = d.argmin(axis=1)
            centres = np.array([x[own == k].mean(axis=0) for k in range(3)])
        d = np.sqrt(((x[:, None] - centres) ** 2).sum(axis=2))
        own, near = d.argmin(axis=1), d.min(axis=1)
        for r in got:
            if r.can_id == i:
                assert r.centre == pytest.approx(centres[r.region])
                assert (r.low, r.high) == pytest.approx(tuple(np.quantile(near[own == r.region], [0.01, 0.99])))
    assert len(got) == 9


def test_pca_residual_against_numpy(spark):
    rng = np.random.default_rng(7)
    train, test = rng.normal(size=(200, 5)) @ rng.normal(size=(5, 5)), rng.normal(size=(40, 5))
    df = lambda m: spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)], "id long, v array<double>")
    got = {r.id: r.score for r in detect.pca_residual(df(train), df(test), "v", 2).select("id", "score").collect()}
    mean, std = train.mean(axis=0), train.std(axis=0, ddof=1)
    vectors = np.linalg.eigh(np.cov((train - mean) / std, rowvar=False))[1][:, ::-1][:, :2]
    z = (test - mean) / std
    want = ((z - z @ vectors @ vectors.T) ** 2).mean(axis=1)
    assert [got[i] for i in range(40)] == pytest.approx(list(want))


def dense_one_class(z, nu, rounds=20_000):
    """The dual by plain conditional gradient on every point's own weight; its value, and the gap that is left."""
    n = len(z)
    alpha = np.full(n, 1 / n)
    for _ in range(rounds):
        w = alpha @ z
        order, best, left = np.argsort(z @ w), np.zeros(n), 1.0
        for i in order[: math.ceil(nu * n) + 1]:
            best[i] = min(left, 1 / (nu * n))
            left -= best[i]
        step = (best - alpha) @ z
        gap = -w @ step
        if gap < 1e-5 * (w @ w):
            break
        alpha += min(1.0, gap / max(step @ step, 1e-300)) * (best - alpha)
    return w @ w / 2, gap


def test_one_class_fits_against_a_dense_solver(spark):
    rng = np.random.default_rng(11)
    pts = np.round(np.concatenate([rng.normal(0.5, 0.15, (150, 2)), rng.uniform(size=(50, 2))]), 2)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in pts], "x double, y double").repartition(3)
    candidates = [(0.5, 0.2), (10.0, 0.1), (10.0, 0.5), (60.0, 0.05)]
    freq, fits = oneclass.fit_candidates(df, candidates, features=12)
    for one in fits:
        z = oneclass.fourier(pts[:, 0], pts[:, 1], freq, one.gamma)
        value, gap = dense_one_class(z, one.nu)
        assert one.done and one.gap <= 1e-3 * max(one.w @ one.w, 0.1)
        assert value - gap - 1e-12 <= one.w @ one.w / 2 <= value + one.gap + 1e-12
        below = (z @ one.w < one.rho).mean()
        assert below <= one.nu + 0.03 and one.nu - 1e-9 <= one.share
    out = df.select(oneclass.decision(freq, fits[1]).alias("v"), "x", "y").collect()
    z = oneclass.fourier(np.array([r.x for r in out]), np.array([r.y for r in out]), freq, 10.0)
    assert [r.v for r in out] == pytest.approx(list(fits[1].rho - z @ fits[1].w))


def test_least_norm_by_hand():
    atoms = np.array([[1.0, 1.0], [1.0, -1.0], [3.0, 0.0], [1.5, 0.2]])
    mix = oneclass.least_norm(atoms, np.array([0, 0, 1.0, 0]))
    assert mix @ atoms == pytest.approx([1.0, 0.0], abs=1e-6) and mix.min() >= 0 and mix.sum() == pytest.approx(1)
    assert oneclass.least_norm(np.array([[2.0, 0.0]]), np.ones(1)) == pytest.approx([1.0])


def test_candidate_sweep(spark, sf_dir):
    rows = Q["candidate_sweep"](spark, sf_dir).collect()
    assert len({(r.gamma, r.nu) for r in rows}) == len(rows) == 40
    for r in rows:
        assert 0 <= r.far <= 1 and r.nu <= r.support + 1e-9 <= 1 + 1e-9 and r.fitness == pytest.approx(r.far + 0.1 * r.support)
        assert r.gap <= 1e-3 * 1.0  # w . w is below 1
    assert [r.fitness for r in rows] == sorted(r.fitness for r in rows)


def test_itemsets_by_hand(spark):
    from itertools import combinations

    rng = np.random.default_rng(9)
    windows = {int(w): sorted({f"i{int(x)}" for x in rng.integers(0, 9, rng.integers(0, 8))}) for w in rng.choice(1000, 200, replace=False)}
    rows = [(w, i) for w, held in windows.items() for i in held]
    items = spark.createDataFrame(rows + rows[:50], "w long, item string")
    windows = {w: held for w, held in windows.items() if held}
    for share, most in ((0.02, 4), (0.1, 3), (0.3, 2), (0.99, 3)):
        need = max(1, math.ceil(share * len(windows)))
        counts = {c: sum(set(c) <= set(held) for held in windows.values()) for size in range(1, most + 1) for c in combinations(sorted({i for _, i in rows}), size)}
        legal = rules.itemset_support(items, "w", share, most)
        assert {tuple(r["items"]): r.n for r in legal.collect()} == {c: n for c, n in counts.items() if n >= need}, (share, most)
    legal = rules.itemset_support(items, "w", 0.1, 2)
    sets = {tuple(r["items"]) for r in legal.collect()}
    none = spark.createDataFrame([], "w long")
    got = {r.w: r.score for r in rules.rules_score(items, legal, none, none.withColumn("shifted", F.lit(True)), items, "w").collect()}
    for w, held in windows.items():
        own = [c for size in (1, 2) for c in combinations(held, size)]
        assert got[w] == pytest.approx(sum(c not in sets for c in own) / len(own))
    assert rules.itemset_support(items.limit(0), "w", 0.5).count() == 0


def test_window_contents_by_steps_and_by_rows(spark):
    df = spark.range(500).select(F.col("id").alias("row"), (F.col("id") * F.col("id") % 7).alias("can_id"), F.format_string("f%d", F.floor(F.col("id") / 200)).alias("source_file"))
    for size, stride in ((90, 45), (30, 30), (45, 15), (40, 25), (10, 25)):
        got = {(r.window_no, r.can_id): (r.n, r["last"]) for r in rules.window_contents(df, size, stride, "can_id").collect()}
        want = {}
        for w in range(500 // stride + 1):
            for row in range(w * stride, min(500, w * stride + size)):
                n, last = want.get((w, row * row % 7), (0, ""))
                want[w, row * row % 7] = (n + 1, max(last, f"f{row // 200}"))
        assert got == want, (size, stride)


def test_distinct_ids_approx(spark, sf_dir):
    got = {r.source_file: r.ids for r in Q["distinct_ids_approx"](spark, sf_dir).collect()}
    from framewright import bridge

    want = {r.source_file: r.n for r in bridge.frames(spark, sf_dir).groupBy("source_file").agg(F.count_distinct("can_id").alias("n")).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= max(2, 0.15 * want[k]) for k in want)


def test_one_class_slices(spark):
    s = spark.createDataFrame([("a", 1.0, 0), ("a", 3.0, 0), ("b", 5.0, 1), ("c", 1.0, 0), ("c", 2.0, 1)], "slice string, score double, label int")
    for rule in (evaluate.best_f1_threshold(s, ["slice"]), evaluate.threshold_for_fpr(s, 0.1, ["slice"]), evaluate.youden_threshold(s, ["slice"])):
        assert {r.slice: r.threshold for r in rule.collect()} == {"a": 2.0, "b": 5.0, "c": 2.0}
    out = evaluate.evaluate_scores(s, ["slice"]).collect()
    assert sorted((r.slice, r.n, r.n_attack, r.note) for r in out if r.rule is None) == [("a", 2, 0, "benign only"), ("b", 1, 1, "attack only")]
    assert len([r for r in out if r.slice == "c"]) == len(evaluate.RULES)


def test_places_over_all_rows(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000 / 7).alias("v")).repartition(5)
    assert [r._nth for r in evaluate.placed(df, -F.col("v")).orderBy(F.desc("v")).collect()] == list(range(1000))


def test_running_share_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(detect, "BLOCKS", 40)
    rng = np.random.default_rng(2)
    ids = sorted(int(x) for x in rng.choice(5000, 300, replace=False) if not 900 < x < 4000)
    hits = [float(x) for x in rng.integers(0, 2, len(ids))]
    got = detect.running_share(spark.createDataFrame([("s", i, h) for i, h in zip(ids, hits, strict=True)], "signal string, row_id long, hit double")).orderBy("row_id").collect()
    assert [r.run for r in got] == pytest.approx([np.mean(hits[max(0, k - 9) : k + 1]) for k in range(len(ids))])


def test_message_rate_counts_all_rows(spark):
    df = spark.createDataFrame([("a", i, i * 1_000_000 // 50, 1) for i in range(500)], "source_file string, idx_src long, ts_us long, can_id long")
    assert stats.message_rate(df).first().rate == 50


def test_exact_quantiles_against_numpy(spark):
    rng = np.random.default_rng(4)
    groups = {"ties": np.repeat([3.0, 7.0, 7.0, 9.0], 500), "far": np.append(rng.normal(size=3000), 1e300), "one": np.array([5.0]), "two": np.array([1.0, 2.0]), None: rng.integers(0, 50, 700).astype(float)}
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("far", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    wanted = {"low": 0.0, "some": 0.013, "half": 0.5, "most": 0.95, "all": 1.0}
    got = {r.g: [r[n] for n in wanted] for r in ranks.exact_quantiles(df, "v", wanted, ["g"]).collect()}
    assert got.pop("none") == [None] * 5
    for g, values in groups.items():
        assert got.pop(g) == pytest.approx([float(np.quantile(values, q)) for q in wanted.values()]), g
    assert not got
    whole = np.concatenate(list(groups.values()))
    r = ranks.exact_quantiles(df, "v", wanted).first()
    assert list(r) == pytest.approx([float(np.quantile(whole, q)) for q in wanted.values()])
    assert ranks.exact_quantiles(df.limit(0), "v", wanted, ["g"]).count() == 0
    assert list(ranks.exact_quantiles(df.limit(0), "v", {"half": 0.5}).first()) == [None]


def test_exact_quantiles_of_many_distinct_values(spark):
    df = spark.range(2_000_000).select(((F.col("id") * 7919) % 2_000_000).cast("double").alias("v"))
    r = ranks.exact_quantiles(df, "v", {"half": 0.5, "most": 0.999}).first()
    assert list(r) == pytest.approx([999_999.5, 0.999 * 1_999_999], rel=1e-12)
    bracket = df.agg(F.percentile_approx("v", F.array(F.lit(0.5 - ranks._SLACK), F.lit(0.5 + ranks._SLACK)), F.lit(ranks.ACCURACY))).first()[0]
    assert bracket[1] - bracket[0] < 2_000  # of two million values these few are ranked


def most_in_a_range(df, key):
    counts = [r["count"] for r in df.groupBy(key).count().collect()]
    return max(counts) / (sum(counts) / len(counts))


def test_ranges_are_even_beside_outliers_and_ties(spark):
    n = 20_000
    far = spark.range(n).select(F.when(F.col("id") == 7, 1e18).otherwise(F.rand(3)).alias("v"), F.col("id").alias("idx_src"))
    tied = spark.range(n).select(F.when(F.col("id") % 3 == 0, 0.5).otherwise(F.rand(3)).alias("v"), F.col("id").alias("idx_src"))
    for df in (far, tied):
        df = df.cache()
        bounds = df.agg(ranks.splitters(F.col("v"), 32).alias("s"))
        salt = F.pmod(F.xxhash64("idx_src"), F.lit(1000)) / 1000.0
        dealt = df.crossJoin(F.broadcast(bounds)).withColumn("r", ranks.range_of(F.col("s"), F.col("v"), 32, salt))
        assert most_in_a_range(dealt, "r") < 2
        ends = dealt.groupBy("r").agg(F.min("v").alias("a"), F.max("v").alias("b")).orderBy("r").collect()
        assert all(x.b <= y.a for x, y in zip(ends, ends[1:], strict=False))


def test_blocks_are_even_beside_outlying_times_and_long_ties(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCKS", 32)
    rows = spark.range(20_000).select(F.lit("a").alias("source_file"), F.when(F.col("id") == 3, 10**17).when(F.col("id") % 3 == 0, 500).otherwise(F.col("id") % 1000).alias("ts_us"), F.col("id").alias("idx_src"))
    assert most_in_a_range(blocks.in_blocks(rows, ("source_file",)), "_b") < 2
    monkeypatch.setattr(blocks, "TRACE_ROWS", 0)
    assert [r.idx_src for r in blocks.place(rows).orderBy("_nth").collect()] == [r.idx_src for r in rows.orderBy("ts_us", "idx_src").collect()]


def test_places_and_curve_beside_an_outlier(spark):
    df = spark.range(5000).select(F.when(F.col("id") == 9, 1e200).when(F.col("id") % 4 == 0, 0.25).otherwise(F.col("id") / 5000).alias("v"), (F.col("id") % 3 == 0).cast("int").alias("label"), F.col("id"))
    got = evaluate.placed(df, F.col("v")).orderBy("_nth").collect()
    assert [r._nth for r in got] == list(range(5000)) and [r.v for r in got] == sorted(r.v for r in got)
    rows = [(r.v, r.label) for r in got]
    pos = sum(y for _, y in rows)
    c = {r.threshold: (r.tp, r.fp) for r in evaluate.curve(df.select(F.col("v").alias("score"), "label")).collect()}
    for t in (1e200, 0.25, 0.9998, 0.0002):
        above = [y for v, y in rows if v >= t]
        assert c[t] == (sum(above), len(above) - sum(above))
    assert pos == max(tp for tp, _ in c.values())


def test_one_long_file_is_written_by_many_tasks(spark, tmp_path):
    from framewright.sources import sinks

    rows = spark.range(40_000).select(F.lit("d").alias("dataset"), F.when(F.col("id") % 10 == 0, F.concat(F.lit("f"), F.col("id") % 100)).otherwise("long").alias("source_file"), (F.col("id") % 17).alias("can_id"), F.col("id").alias("ts_us"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_canonical(rows, str(tmp_path / "out"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    back = spark.read.parquet(str(tmp_path / "out"))
    parts = back.where("source_file = 'long'").groupBy(F.input_file_name()).agg(F.count("*").alias("n"), F.min(F.struct("can_id", "ts_us")).alias("a"), F.max(F.struct("can_id", "ts_us")).alias("b")).orderBy("a").collect()
    assert len(parts) >= 3 and max(p.n for p in parts) < 2 * 36_000 / len(parts)
    assert all(tuple(x.b) <= tuple(y.a) for x, y in zip(parts, parts[1:], strict=False))
    assert back.exceptAll(rows.select(back.columns)).count() == 0 and back.count() == 40_000


def direct_scores(points, model, w, gamma):
    return -(w * np.exp(-gamma * ((points[:, None] - model[None]) ** 2).sum(axis=2))).sum(axis=1)


def test_gauss_transform_against_direct_sums(spark):
    from framewright.operators import kernel

    rng = np.random.default_rng(6)
    model = np.concatenate([rng.uniform(-0.2, 1.3, (300, 2)), rng.normal(0.5, 0.01, (200, 2)), [[0.25, 0.25]] * 3])
    points = np.concatenate([rng.uniform(-1, 2, (400, 2)), model[:50], [[40.0, 40.0]]])
    w = rng.uniform(0, 1, len(model))
    w /= w.sum()
    gammas = [1e-6, 0.3, 10.0, 100.0, 5e4]
    m = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(model, w, strict=True)], "mx double, my double, w double").repartition(3)
    p = spark.createDataFrame([(k, float(a), float(b), "kept") for k, (a, b) in enumerate(points)], "id long, x double, y double, note string").repartition(3)
    rows = kernel.gauss_scores(p, m, gammas).collect()
    assert len(rows) == len(points) * len(gammas) and {r.note for r in rows} == {"kept"}
    for g in gammas:
        want, got = direct_scores(points, model, w, g), {r.id: r.score for r in rows if r.gamma == g}
        assert max(abs(got[k] - want[k]) for k in range(len(points))) < 1e-8, g
    assert kernel.gauss_scores(p.limit(0), m, [1.0]).count() == 0
    assert {r.score for r in kernel.gauss_scores(p, m.limit(0), [1.0]).collect()} == {0.0}


def test_gauss_transform_has_no_more_cells_than_the_plane(spark):
    from framewright.operators import kernel

    cells = []
    for n in (2_000, 20_000):  # tenfold points, the same cells: the part that is not linear stays as it is
        df = spark.range(n).select((F.rand(1)).alias("x"), (F.rand(2)).alias("y"))
        cells.append(kernel.in_cells(df, "x", "y", [100.0]).select(*kernel.CELL).distinct().count())
    assert cells == [100, 100]


def test_ridge_predictor_against_numpy(spark):
    from framewright.operators import predict

    rng = np.random.default_rng(12)
    rows, want = [], {}
    for i in range(3):
        v = np.round(rng.normal(size=(80, 2)).cumsum(axis=0), 3)
        rows += [("a", i, k, 100 * i + k, float(a), float(b)) for k, (a, b) in enumerate(v)]
        x = np.column_stack([np.ones(78), v[:-2], v[1:-1]])
        y = v[2:]
        weights = np.linalg.solve(x.T @ x + np.diag([0.0, 2, 2, 2, 2]), x.T @ y)
        want |= {100 * i + k + 2: e for k, e in enumerate(((y - x @ weights) ** 2).mean(axis=1))}
    df = spark.createDataFrame(rows, "source_file string, can_id long, ts_us long, idx_src long, u double, v double").repartition(3)
    lagged = predict.lagged(df, ["u", "v"], 2)
    weights = predict.ridge_fit(predict.ridge_sums(lagged, 5, 2), 5, 2, 2.0)
    got = {r.idx_src: r.score for r in predict.ridge_residual(lagged, weights, 5, 2).collect()}
    assert got.keys() == want.keys() and [got[k] for k in want] == pytest.approx(list(want.values()), rel=1e-3, abs=1e-5)


def test_a_broken_pair_does_not_end_the_others_and_runs_resume(spark, tmp_path):
    from framewright.operators import matrix

    calls, fixed = [], []
    scores = spark.createDataFrame([(float(k), k % 2) for k in range(20)], "score double, label int")

    def pair(d, m):
        calls.append((d, m))
        if m == "missing" and not fixed:
            raise FileNotFoundError(d)
        return scores if m != "late" or fixed else scores.select(F.raise_error(F.lit("late")).cast("double").alias("score"), "label")

    pairs = {(d, m): (lambda d=d, m=m: pair(d, m)) for d in ("x", "y") for m in ("good", "late", "missing")}
    run = lambda: {(r.dataset, r.method): r for r in matrix.run_matrix(spark, pairs, evaluate.roc_auc, "auc double", str(tmp_path)).collect()}
    first = run()
    assert {k for k, r in first.items() if r.ok} == {("x", "good"), ("y", "good")} and len(first) == 6
    assert "FileNotFoundError" in first["x", "missing"].error and "late" in first["y", "late"].error
    fixed.append(True)
    calls.clear()
    second = run()
    assert all(r.ok and r.error is None and r.auc == pytest.approx(0.55) for r in second.values()) and len(second) == 6
    assert set(calls) == {p for p in pairs if p[1] != "good"} and len(calls) == 4
    calls.clear()
    assert len(run()) == 6 and not calls
