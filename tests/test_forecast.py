import datetime as dt
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from salescope.operators import features, forecast, models, past_days, series, trees

DAY = dt.date(2024, 1, 1)


def table(spark, values, name="A"):
    rows = [(name, DAY + dt.timedelta(days=i), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "series_id string, date date, quantity double")


def wave(n):
    return [float(20 + 8 * np.sin(2 * np.pi * i / 7) + 0.05 * i) for i in range(n)]


def plain_naive(history, periods):
    history, out = list(history), []
    for _ in range(periods):
        out.append(max(0.0, history[-7]) if len(history) >= 7 else float(np.mean(history)))
        history.append(out[-1])
    return out


def test_product_series(spark):
    rows = [(DAY + dt.timedelta(days=i), p, q) for i in range(40) for p, q in (("A", 2), ("B", 20))]
    df = spark.createDataFrame(rows, "date date, product_id string, quantity int")
    sums = {r["series_id"]: r["s"] for r in series.daily_series(df).groupBy("series_id").agg(F.sum("quantity").alias("s")).collect()}
    assert sums == {"A": 80.0, "B": 800.0, series.OVERALL: 880.0}
    with pytest.raises(ValueError, match="quantity"):
        series.daily_demand(df.drop("quantity"))


def test_no_day_is_missing(spark):
    df = spark.createDataFrame([(DAY, "A", 1), (DAY + dt.timedelta(days=9), "A", 2)], "date date, product_id string, quantity int")
    days = series.daily_series(df, overall=False).orderBy("date").collect()
    assert [r["date"] for r in days] == [DAY + dt.timedelta(days=i) for i in range(10)]
    assert [r["quantity"] for r in days] == [1.0] + [0.0] * 8 + [2.0]


@pytest.mark.parametrize("n", [1, 2, 3, 5, 6, 7, 8, 30])
def test_seasonal_naive_equals_the_loop(spark, n):
    values = [float((i * 5) % 9) for i in range(n)]
    got = [r["predicted"] for r in series.seasonal_naive(table(spark, values), 20).orderBy("step").collect()]
    assert got == pytest.approx(plain_naive(values, 20))


@pytest.mark.parametrize("n", [70, 100, 200, 400])
def test_folds_and_naive_backtest(spark, n):
    values = [float((i * 11) % 23) for i in range(n)]
    s = table(spark, values)
    folds = {r["fold"]: r for r in series.rolling_origin_folds(s).collect()}
    h = min(28, max(7, n // 12))
    assert [folds[f]["origin"] for f in range(3)] == [n - 3 * h, n - 2 * h, n - h]
    rows = series.naive_backtest(s).orderBy("date").collect()
    assert len({r["date"] for r in rows}) == len(rows) == 3 * h
    want = [p for f in range(3) for p in plain_naive(values[:n - (3 - f) * h], h)]
    assert [r["predicted"] for r in rows] == want


def test_features_equal_numpy(spark):
    values = wave(60)
    rows = series.daily_features(table(spark, values)).orderBy("date").collect()
    for i in (0, 1, 5, 28, 59):
        past = np.array(values[:i])
        for k in series.ROLLING_DAYS:
            assert rows[i][f"mean_{k}"] == pytest.approx(past[-k:].mean() if i else 0.0)
            assert rows[i][f"std_{k}"] == pytest.approx(past[-k:].std() if i else 0.0)
        for k in series.LAG_DAYS:
            assert rows[i][f"lag_{k}"] == (values[i - k] if i >= k else 0.0)


def inputs(spark, values):
    rows = series.training_rows(series.daily_features(table(spark, values))).orderBy("date").collect()
    return np.array([[float(r[f]) for f in series.FEATURES] for r in rows]), np.array([r["quantity"] for r in rows])


def walked(tree, row):
    node = 0
    while tree.left[node] != node:
        node = tree.left[node] if row[tree.feature[node]] <= tree.threshold[node] else tree.right[node]
    return tree.value[node]


def test_ensembles_equal_a_walk_from_the_root():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 4))
    y = 3 * x[:, 0] + (x[:, 1] > 0) + rng.normal(size=300) * 0.1
    forest = trees.fit_forest(x, y, 7, 6)
    boosted, base = trees.fit_boosting(x, y, 20, 0.2, 6, 2.0)
    want = np.array([np.mean([walked(t, row) for t in forest]) for row in x])
    assert trees.Ensemble(forest, 1 / 7).predict(x) == pytest.approx(want)
    want = np.array([base + sum(walked(t, row) for t in boosted) for row in x])
    assert trees.Ensemble(boosted, 1.0, base).predict(x) == pytest.approx(want)
    assert max(sum(a == i for i, a in enumerate(t.left)) for t in boosted) <= 6


@pytest.mark.parametrize("l2", [0.0, 2.0])
def test_best_cut_by_trying_all(l2):
    rng = np.random.default_rng(int(l2))
    x, y = rng.integers(0, 9, (60, 3)).astype(float), rng.normal(size=60)
    edges = trees.edges_of(x)
    bins = trees.binned(x, edges)
    count, total = trees.histograms(bins, np.zeros(60, int), 1, 9, np.ones(60), y)
    gain, f, b = (v[0] for v in trees.best_cuts(count, total, 5, l2))

    def worth(part):
        return part.sum() ** 2 / (len(part) + l2)

    every = {}
    for k in range(3):
        for cut in edges[k]:
            below = x[:, k] <= cut
            if min(below.sum(), (~below).sum()) >= 5:
                every[k, cut] = worth(y[below]) + worth(y[~below]) - worth(y)
    assert gain == pytest.approx(max(every.values())) and every[f, edges[f][b]] == pytest.approx(gain)


def test_boosting_grows_the_best_leaf_first_with_l2():
    """One round with three leaves against all pairs of cuts, made one after the other."""
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 6, (80, 2)).astype(float), rng.normal(size=80) * 10
    (tree,), base = trees.fit_boosting(x, y, 1, 1.0, 3, 2.0, least=4)
    rest = y - y.mean()

    def cuts(rows):
        out = []
        for k in range(2):
            for cut in (0.5, 1.5, 2.5, 3.5, 4.5):
                low = rows & (x[:, k] <= cut)
                high = rows & ~low
                if min(low.sum(), high.sum()) >= 4:
                    def worth(part):
                        return rest[part].sum() ** 2 / (part.sum() + 2.0)
                    out.append((worth(low) + worth(high) - worth(rows), low, high))
        return max(out, key=lambda c: c[0])

    _, low, high = cuts(np.ones(80, bool))
    parts = [low, high]
    at = max((0, 1), key=lambda i: cuts(parts[i])[0])
    parts[at : at + 1] = cuts(parts[at])[1:]
    want = np.zeros(80)
    for part in parts:
        want[part] = rest[part].sum() / (part.sum() + 2.0)
    assert trees.Ensemble([tree], 1.0, base).predict(x) == pytest.approx(want + y.mean())


def test_recursion_equals_one_day_at_a_time(spark):
    values = wave(150)
    x, y = inputs(spark, values)
    model = trees.Ensemble(trees.fit_forest(x, y, 4, 4), 1 / 4)
    starts = spark.createDataFrame(
        [("A", 3, values[-28:], 1.0, (DAY - dt.date(1970, 1, 1)).days + 150, 150, 5)],
        "series_id string, fit int, memory array<double>, scale double, start bigint, day bigint, steps int")
    made = forecast.recursive_forecast(starts, {(3, forecast.FOREST): model}).orderBy("step").collect()
    grown = list(values)
    for _ in range(5):
        grown.append(max(0.0, float(model.predict(inputs(spark, [*grown, 0.0])[0][-1:])[0])))
    assert [r["predicted"] for r in made] == pytest.approx(grown[-5:], rel=1e-9)


def test_series_of_any_size_teach_the_same_model(spark):
    """A series a thousand times as large gets forecasts a thousand times as large, and its rows are scaled by past days alone."""
    s = table(spark, wave(140)).unionByName(table(spark, [1000 * v for v in wave(140)], "B"))
    _, days = forecast.forecast_daily_demand(s, 7, [forecast.boosting(rounds=20)])
    made = {(r["series_id"], r["step"]): r["predicted"] for r in days.collect()}
    assert all(made["B", k] == pytest.approx(1000 * made["A", k], rel=1e-6) for k in range(1, 8))
    panel = series.positions(s)
    scale = {(r["series_id"], r["fit"]): r for r in forecast.scales(panel).collect()}
    assert [scale["A", f]["origin"] for f in range(4)] == [140 - 33, 140 - 22, 140 - 11, 140]
    assert all(scale["A", f]["scale"] == pytest.approx(np.mean(wave(140)[: 140 - (3 - f) * 11])) for f in range(4))


def test_large_panels_are_dealt_into_bags(spark, monkeypatch):
    monkeypatch.setattr(forecast, "BAG_ROWS", 30)
    monkeypatch.setattr(forecast, "BAGS", 3)
    s = table(spark, wave(140)).unionByName(table(spark, wave(120), "B"))
    panel = series.positions(s)
    scale = forecast.scales(panel)
    rows = {r.fit: r.n for r in scale.groupBy("fit").agg(F.sum("rows").alias("n")).collect()}
    dealt = forecast.training_bags(panel, scale, dict.fromkeys(rows, 3), rows).groupBy("fit", "bag").count().collect()
    assert {(r.fit, r.bag) for r in dealt} == {(f, b) for f in range(4) for b in range(3)}
    assert all(10 <= r["count"] <= 60 for r in dealt)
    made = forecast.fit_panel(panel, scale, [forecast.forest(trees=7, depth=3), forecast.boosting(rounds=3)])
    assert {k: e.shape[0] for k, e in made.items()} == {(f, m): n for f in range(4) for m, n in ((forecast.FOREST, 7), (forecast.BOOSTING, 3))}


def test_forecast_selects_and_reports(spark):
    s = table(spark, wave(140)).unionByName(table(spark, [3.0] * 90, "B")).unionByName(table(spark, [1.0] * 30, "C"))
    summary, days = forecast.forecast_daily_demand(s, 10, [forecast.forest(trees=5, depth=4)])
    rows = {r["series_id"]: r for r in summary.collect()}
    assert rows["C"]["status"] == "error" and "30" in rows["C"]["error"] and rows["C"]["model_name"] is None
    assert rows["A"]["status"] == rows["B"]["status"] == "success"
    assert rows["B"]["total_predicted"] == pytest.approx(30.0, rel=0.2)
    for r in rows.values():
        if r["status"] == "success":
            assert r["model_name"] in forecast.ORDER
            assert r["backtest_wape"] <= r["baseline_wape"]
            assert r["beats_baseline"] == (r["model_name"] != forecast.NAIVE)
    made = days.collect()
    assert len(made) == 20 and all(r["predicted"] >= 0 for r in made)
    assert min(r["date"] for r in made if r["series_id"] == "A") == DAY + dt.timedelta(days=140)
    with pytest.raises(ValueError, match="one day"):
        forecast.forecast_daily_demand(s, 0)


def test_wape_without_demand_is_infinite(spark):
    df = spark.createDataFrame([("A", 0.0, 1.0)], "series_id string, actual double, predicted double")
    assert series.scores(df, "series_id").first()["wape"] == float("inf")


def test_ties_follow_the_fixed_order(spark):
    df = spark.createDataFrame([("A", m, 1.0, 0.5) for m in reversed(forecast.ORDER)], "series_id string, model string, mae double, wape double")
    assert forecast.select_method(df).first()["model"] == forecast.FOREST


def test_same_day_stays_together(spark):
    rows = [(DAY + dt.timedelta(days=i // 2), i) for i in range(6)]
    out = features.chronological_split(spark.createDataFrame(rows, "date date, quantity int"))
    assert sorted(r["quantity"] for r in out.where("is_test").collect()) == [4, 5]


@pytest.fixture
def lines(spark):
    rnd = np.random.default_rng(1)
    rows = []
    for i in range(600):
        a, b = float(rnd.uniform(0, 10)), float(rnd.uniform(0, 10))
        rows.append((DAY + dt.timedelta(days=i // 3), "P", a, b, int(3 * a + b + 5)))
    return spark.createDataFrame(rows, "date date, product_id string, unit_price double, discount double, quantity int")


def test_models_beat_the_mean(lines):
    split = features.chronological_split(lines)
    names = features.feature_names(split)
    assert names == ["unit_price", "discount"]
    made = models.assemble(split, names, keep=("is_test",))
    train, test = made.where("not is_test").drop("is_test"), made.where("is_test").drop("is_test")
    trained = models.train_all(train, names, trees=6, depth=5, rounds=12)
    table = {r["model"]: r for r in models.fit_band(models.compare_models(models.predictions(trained, test))).collect()}
    assert set(table) == {models.LINEAR, models.FOREST, models.BAGGED, models.BOOSTED}
    assert all(r["r2"] > 0.5 for r in table.values()) and table[models.LINEAR]["predictive_power"] == "strong"
    top = models.top_features(trained[models.FOREST].weights).collect()
    assert top[0]["feature"] == "unit_price" and sum(r["importance"] for r in top) == pytest.approx(1, abs=1e-3)
    again = models.train_forest(train, names, trees=6, depth=5)
    assert [tuple(r) for r in again.weights.collect()] == [tuple(r) for r in trained[models.FOREST].weights.collect()]
    assert models.predict_nonneg(trained[models.LINEAR].model, test).where("prediction < 0").count() == 0


def test_candidates_are_fitted_side_by_side(lines, monkeypatch):
    train = models.assemble(lines, ["unit_price", "discount"])
    met, given = threading.Barrier(4, timeout=30), {}
    for name in ("train_linear", "train_forest", "train_bagged", "train_boosted"):
        def fit(rows, features, *args, name=name):
            met.wait()  # broken unless all four are at work at a time
            given[name] = (*args, rows.count())
            return models.Trained(name, {})

        monkeypatch.setattr(models, name, fit)
    trained = models.train_all(train, ["unit_price", "discount"], trees=6, depth=5, rounds=12)
    assert {k: t.model for k, t in trained.items()} == {
        models.LINEAR: "train_linear", models.FOREST: "train_forest", models.BAGGED: "train_bagged",
        models.BOOSTED: "train_boosted"}
    assert given == {
        "train_linear": (600,), "train_forest": (6, 5, 600), "train_bagged": (6, 5, 600), "train_boosted": (12, 600)}


def test_too_few_rows(lines):
    with pytest.raises(ValueError, match="Insufficient"):
        features.select_features(lines.limit(49))
    with pytest.raises(ValueError, match="quantity"):
        features.select_features(lines.drop("quantity"))


def test_labels_of_any_number_are_coded_in_order(spark):
    rows = [(f"c{i * 7919 % 5000:04d}" if i % 3 else None, "ab"[i % 2], i) for i in range(9000)]
    df = spark.createDataFrame(rows, "category string, region string, quantity int")
    made = features.encode_categories(df)
    assert made.columns == ["category", "region", "quantity", "category_encoded", "region_encoded"] and made.count() == 9000
    values = sorted({r[0] or "nan" for r in rows})
    assert all(values[r["category_encoded"]] == (r["category"] or "nan") for r in made.collect())
    assert {(r["region"], r["region_encoded"]) for r in made.collect()} == {("a", 0), ("b", 1)}
    assert features.encode_categories(df.drop("category", "region")).columns == ["quantity"]
    assert features.encode_categories(df.limit(0)).collect() == []


def days_apart(spark, ends, gaps):
    """Series with some days observed, the last of them ``ends`` days after the first."""
    rnd = np.random.default_rng(7)
    rows = [(name, DAY + dt.timedelta(days=int(i)), float(rnd.integers(1, 9)) / 3)
            for name, gap in gaps.items() for i in sorted({0, ends, *rnd.integers(0, ends, ends // gap)})]
    return spark.createDataFrame(rows, "series_id string, date date, quantity double").repartition(3)


def test_runs_of_days_give_the_features_of_every_day(spark):
    """The pass over runs equals windows over every day, also when a series spans many batches."""
    from pyspark.sql import Window

    observed = days_apart(spark, 400, {"A": 2, "B": 50, "C": 400})
    whole = series.numbered_days(observed)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        made = series.daily_features(series.daily_runs(observed)).orderBy("series_id", "date").collect()
        plain = series.daily_features(whole.repartition(5, "date")).orderBy("series_id", "date").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    w = Window.partitionBy("series_id").orderBy("date")
    want = whole.select(
        "series_id", "date", "quantity", "day", "days",
        *[F.coalesce(F.lag("quantity", k).over(w), F.lit(0.0)).alias(f"lag_{k}") for k in series.LAG_DAYS],
        *[F.coalesce(f("quantity").over(w.rowsBetween(-k, -1)), F.lit(0.0)).alias(f"{s}_{k}")
          for k in series.ROLLING_DAYS for s, f in (("mean", F.avg), ("std", F.stddev_pop))],
    ).orderBy("series_id", "date")
    names = want.columns
    assert [tuple(r[c] for c in names) for r in made] == [tuple(r) for r in want.collect()]
    assert [tuple(r[c] for c in names) for r in plain] == [tuple(r[c] for c in names) for r in made]


def test_only_observed_days_are_sorted(spark):
    """No window, sort or exchange stands above the days that are filled in."""
    observed = days_apart(spark, 400, {"A": 20, "B": 50})
    for made in (series.daily_features(series.daily_runs(observed)), series.history_tail(series.numbered_days(observed)),
                 series.last_days(series.numbered_days(observed), 7)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        above = plan.split("MapInArrow")[0] if "MapInArrow" in plan else plan.split("Generate explode")[0]
        assert len(above) < len(plan) and not any(x in above for x in ("Window", "Sort", "Repartition"))


def test_runs_out_of_order_are_refused(spark):
    runs = series.daily_runs(days_apart(spark, 200, {"A": 10, "B": 10}))
    with pytest.raises(Exception, match="in order"):
        series.daily_features(runs.repartition(2, "date")).collect()


def test_look_backs_leave_gaps_out(spark):
    rows = [("A", DAY + dt.timedelta(days=i), None if i in (3, 9) else float(i * i % 11)) for i in range(40)]
    made = series.daily_features(spark.createDataFrame(rows, "series_id string, date date, quantity double")).orderBy("date").collect()
    for i in (0, 1, 4, 10, 39):
        for k in series.ROLLING_DAYS:
            past = [v for _, _, v in rows[max(0, i - k):i] if v is not None]
            assert made[i][f"mean_{k}"] == pytest.approx(np.mean(past) if past else 0.0)
            assert made[i][f"std_{k}"] == pytest.approx(np.std(past) if past else 0.0)
        for k in series.LAG_DAYS:
            assert made[i][f"lag_{k}"] == ((rows[i - k][2] or 0.0) if i >= k else 0.0)


def test_tails_of_short_and_long_series(spark):
    s = table(spark, [float(i) for i in range(5)]).unionByName(table(spark, [float(i) for i in range(100)], "B"))
    tails = series.history_tail(s, 90).groupBy("series_id").agg(F.count("*").alias("n"), F.min("quantity").alias("q")).collect()
    assert {(r.series_id, r.n, r.q) for r in tails} == {("A", 5, 0.0), ("B", 90, 10.0)}
    ends = {r.series_id: r for r in series.last_days(s, 7).collect()}
    assert ends["A"].recent == [0.0, 1.0, 2.0, 3.0, 4.0] and ends["A"].days == 5 and ends["A"].mean_quantity == 2.0
    assert ends["B"].recent == [float(i) for i in range(93, 100)] and ends["B"].days == 100


def test_days_without_sales_are_not_written(spark, monkeypatch):
    """What the forecast writes grows with the days that sold something, not with the calendar."""
    s = table(spark, ([4.0] + [0.0] * 9) * 40).unionByName(table(spark, [1.0] * 30, "B"))
    kept, plain = {}, forecast.written
    monkeypatch.setattr(forecast, "written", lambda df, name: kept.setdefault(name, plain(df, name)))
    summary, days = forecast.forecast_daily_demand(s, 10, [])
    rows = {r.series_id: r for r in summary.collect()}
    assert kept["daily-panel"].where("series_id = 'A'").count() == 41
    assert rows["A"].total_predicted == pytest.approx(sum(plain_naive(([4.0] + [0.0] * 9) * 40, 10)))
    assert rows["A"].validation_days == 28 and rows["B"].status == "error" and "30" in rows["B"].error
    assert days.count() == 10


def test_rows_without_a_value_go_right_and_stay_on_leaves():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 2))
    forest = trees.fit_forest(x, x[:, 0], 3, 5)
    odd = np.array([[np.nan, 0.0], [np.inf, np.nan], [-np.inf, 1.0]])
    want = [np.mean([walked(t, row) for t in forest]) for row in odd]
    assert trees.Ensemble(forest, 1 / 3).predict(odd) == pytest.approx(want)


@pytest.mark.parametrize("share", [0.02, 0.9])
def test_windows_without_sales_are_not_worked_out(monkeypatch, share):
    rng, n, memory = np.random.default_rng(5), 3_000, 28
    values = np.where(rng.random(n + memory) < share, rng.integers(1, 50, n + memory) / 8, 0.0)
    seen, plain = [], past_days.moments
    monkeypatch.setattr(past_days, "moments", lambda past, known, k: seen.append((k, len(past(1)))) or plain(past, known, k))
    before, there = np.arange(memory, n + memory), np.ones(n + memory, bool)
    made = past_days.looked_back(values, there, before, memory, series.LAG_DAYS, series.ROLLING_DAYS)
    windows = {k: np.array([values[memory + i - k : memory + i] for i in range(n)]) for k in series.ROLLING_DAYS}
    assert dict(seen) == {k: (w.any(axis=1).sum() if share < 0.1 else n) for k, w in windows.items()}
    want = [values[memory - k : memory - k + n] for k in series.LAG_DAYS]
    want += [x for w in windows.values() for x in (w.mean(axis=1), w.std(axis=1))]
    for a, b in zip(made, want, strict=True):
        np.testing.assert_allclose(a, b, rtol=1e-12, atol=1e-12)


def test_trees_of_any_shape_give_what_a_walk_gives():
    rng = np.random.default_rng(8)
    x = np.where(rng.random((3_000, 5)) < 0.4, 0.0, rng.normal(size=(3_000, 5)))
    y = x[:, 0] * x[:, 1] + np.exp(2 * x[:, 2])
    odd = np.vstack([x[:40], rng.normal(size=(40, 5)), np.full((1, 5), np.nan), np.full((1, 5), -np.inf)])
    leaf = [trees.Tree.root(0.5)]
    for made, base in (trees.fit_boosting(x, y, 12, 0.3, 10, 1.0), trees.fit_boosting(x, y, 4, 0.3, 40, 1.0, least=1),
                       (trees.fit_forest(x, y, 4, 9) + leaf, 0.0), (leaf, 2.0)):
        got = trees.Ensemble(made, 0.25, base).predict(odd)
        assert got == pytest.approx([base + 0.25 * sum(walked(t, row) for t in made) for row in odd], rel=1e-12)


def test_thresholds_themselves_go_left():
    tree = trees.Tree.root(0.0)
    tree.split(0, 3, 1.5, -1.0, 1.0)
    values = np.array([[9, 9, 9, 1.5], [9, 9, 9, np.nextafter(1.5, 2)], [9, 9, 9, -9], [9, 9, 9, np.inf]])
    assert trees.Ensemble([tree] * 3, 1.0).predict(values).tolist() == [-3.0, 3.0, -3.0, 3.0]


def test_features_of_wanted_days_only(spark):
    observed = days_apart(spark, 400, {"A": 20, "B": 50, "C": 1})
    runs = series.daily_runs(observed)
    some = series.daily_features(series.only_days(runs, lambda date: F.dayofmonth(date) % 7 == 3))
    want = series.daily_features(runs).where(F.dayofmonth("date") % 7 == 3)
    assert some.columns == want.columns
    assert sorted(map(repr, some.collect())) == sorted(map(repr, want.collect())) and some.count() > 50


def test_a_sampled_panel_works_out_the_days_it_takes(spark, monkeypatch):
    panel = series.daily_runs(days_apart(spark, 400, {"A": 20, "B": 50}))
    scale, seen, plain = forecast.scales(panel), [], series.daily_features
    monkeypatch.setattr(series, "daily_features", lambda p: seen.append(plain(p).count()) or plain(p))
    sizes = {f: 1 for f in range(4)}, {r.fit: r.n for r in scale.groupBy("fit").agg(F.sum("rows").alias("n")).collect()}
    whole = forecast.training_bags(panel, scale, *sizes)
    monkeypatch.setattr(forecast, "BAG_ROWS", 100)
    taken = forecast.training_bags(panel, scale, *sizes)
    assert seen[0] > 700 and taken.where("fit = 3").count() <= seen[1] < 200
    key = ["fit", *series.FEATURES, "target"]
    assert taken.select(key).exceptAll(whole.select(key)).isEmpty()
    assert 50 < taken.where("fit = 3").count() < 160


def test_trees_are_fitted_on_no_more_partitions_than_cores(spark, monkeypatch):
    seen, rows = [], spark.createDataFrame([(float(i % 7), float(i)) for i in range(80)], "a double, quantity double")
    monkeypatch.setattr(models, "_fit", lambda name, kind, estimator, train, features: seen.append(
        (train.rdd.getNumPartitions(), train.count())) or models.Trained(None, {}))
    monkeypatch.setattr(models, "_with_importance", lambda out, train, features: out)
    train = models.assemble(rows.repartition(40), ["a"])
    for fit in (models.train_forest, models.train_bagged, models.train_boosted):
        fit(train, ["a"])
    assert seen == [(spark.sparkContext.defaultParallelism, 80)] * 3
