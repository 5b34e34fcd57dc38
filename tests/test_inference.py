import hashlib
from datetime import date

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelmill.operators import bootstrap, horizons, monitoring, ranking, ridge, trees
from panelmill.operators.splits import fold_bounds, holdout

PREDICTED = "product_id string, model_name string, feature_set string, producto string, provincia string, fecha date, y_true double, y_pred double"


def months(n, start="2016-01-01"):
    return [d.date() for d in pd.date_range(start, periods=n, freq="MS")]


def draw(seed, rep, product, entity, slot, choices):
    return int(hashlib.md5(f"{seed}|{rep}|{product}|{entity}|{slot}".encode()).hexdigest()[:8], 16) % choices


@pytest.fixture(scope="module")
def errors(spark):
    rng = np.random.default_rng(5)
    rows = []
    for entity, n in (("a", 11), ("b", 3), ("c", 4), ("d", 1)):
        for d in months(n):
            y = float(rng.normal(5, 1))
            for model, noise in (("m1", 0.2), ("m2", 0.5), ("m3", 0.5)):
                for fs in ("base", "full"):
                    rows.append(("p", model, fs, "P", entity, d, y, y + float(rng.normal(0, noise))))
    return spark.createDataFrame(rows, PREDICTED).repartition(5)


def replicas(pdf, product, n_rep, block=4, seed=42):
    entities = {e: g.sort_values("fecha") for e, g in pdf.groupby("provincia")}
    out = []
    for rep in range(1, n_rep + 1):
        picked = []
        for e, g in entities.items():
            err, n = (g.y_true - g.y_pred).to_numpy(), len(g)
            size = 1 if n <= block else block
            idx = []
            for slot in range(-(-n // size)):
                start = draw(seed, rep, product, e, slot, n - size + 1)
                idx += range(start, start + size)
            picked.append(err[idx[:n]])
        out.append(np.sqrt(np.mean(np.concatenate(picked) ** 2)))
    return np.array(out)


def test_block_bootstrap(errors):
    full = errors.where("feature_set = 'full'")
    pdf = full.toPandas()
    got = {r.model_name: r for r in bootstrap.rmse_intervals(full, 50).collect()}
    reps = {}
    for model, part in pdf.groupby("model_name"):
        reps[model] = replicas(part, "p", 50)
        point = np.sqrt(np.mean((part.y_true - part.y_pred) ** 2))
        low, high = np.percentile(reps[model], [2.5, 97.5])
        assert got[model].rmse_bootstrap_mean == pytest.approx(point)
        assert got[model].rmse_ci_lower == pytest.approx(max(0, 2 * point - high))
        assert got[model].rmse_ci_upper == pytest.approx(2 * point - low)
        assert got[model].n == 19
    pairs = {(r.model_a, r.model_b): r for r in bootstrap.pairwise_significance(full, 50).collect()}
    assert set(pairs) == {("m1", "m2"), ("m1", "m3"), ("m2", "m3")}
    delta = got["m1"].rmse_bootstrap_mean - got["m2"].rmse_bootstrap_mean
    mirror = 2 * delta - (reps["m1"] - reps["m2"])
    assert pairs["m1", "m2"].p_value_bootstrap == pytest.approx(min(1, 2 * min((mirror <= 0).mean(), (mirror >= 0).mean())))
    assert pairs["m1", "m2"].significant_95 == (not np.percentile(mirror, 2.5) <= 0 <= np.percentile(mirror, 97.5))


def test_ablation_significance(errors):
    got = bootstrap.ablation_significance(errors, 40).collect()
    assert {r.model_name for r in got} == {"m1", "m2", "m3"} and all(r.product_id == "p" and r.n == 19 for r in got)


def test_replicas_do_not_depend_on_partitioning(errors):
    full = errors.where("feature_set = 'full'")
    a = bootstrap.replica_rmse(full, "model_name", 20).toPandas().sort_values(["series", "replica"]).reset_index(drop=True)
    b = bootstrap.replica_rmse(full.coalesce(1), "model_name", 20).toPandas().sort_values(["series", "replica"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b)


def holm(p, alpha):
    order = sorted(range(len(p)), key=lambda i: p[i])
    verdict = [False] * len(p)
    for rank, i in enumerate(order):
        if p[i] > alpha / (len(p) - rank):
            break
        verdict[i] = True
    return verdict


@pytest.mark.parametrize("p", [[0.001, 0.04, 0.01, 0.02, 0.02], [0.0, 0.03, 0.0, 0.5], [0.9], [0.05, 0.025]])
def test_holm(spark, p):
    df = spark.createDataFrame(list(enumerate(p)), "i int, p double")
    got = bootstrap.holm_bonferroni(df, "p", "ok").orderBy("i").collect()
    assert [r.ok for r in got] == holm(p, 1 - 0.95)


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(8)
    rows = []
    for e, n in (("a", 30), ("b", 26)):
        level = 10.0
        for i, d in enumerate(months(n)):
            level = 0.7 * level + 3 + float(rng.normal(0, 0.3))
            if not (e == "b" and i in (20, 21)):
                rows.append(("p", e, e.upper(), "P", d, level, float(i)))
    return spark.createDataFrame(rows, "product_key string, provincia_key string, provincia string, producto string, fecha date, target_precio_mercado_usdkg double, precio_productor_usdkg_filled double")


def test_recursive_horizons(panel):
    split = holdout(panel)
    predictors = {
        "mean3": lambda f: f["target_rolling_mean_3"],
        "exog": lambda f: f["productor_lag_3"] + f["mes_num"],
        "std": lambda f: f["target_rolling_std_6"] + f["target_momentum_1_3"],
    }
    got = horizons.rolling_origin_forecasts(split, predictors).toPandas()
    pdf = split.toPandas().sort_values("fecha")
    want = []
    for e, g in pdf.groupby("provincia_key"):
        actual = dict(zip(g.fecha, g.target_precio_mercado_usdkg))
        for origin in g[g.split == "test"].fecha:
            past = g[g.fecha < origin]
            last = past.iloc[-1]
            histories = {m: list(past.target_precio_mercado_usdkg) for m in predictors}
            for h in (1, 2, 3):
                when = (pd.Timestamp(last.fecha) + pd.DateOffset(months=h)).date()
                for m, hist in histories.items():
                    tail = pd.Series(hist)
                    p = {"mean3": tail.iloc[-3:].mean(), "exog": last.precio_productor_usdkg_filled + when.month,
                         "std": tail.iloc[-6:].std() + tail.iloc[-1] - tail.iloc[-3]}[m]
                    hist.append(p)
                    if when in actual:
                        want.append((e, origin, m, h, when, actual[when], p))
    key = ["provincia_key", "fecha_origen", "model", "horizonte", "fecha_objetivo"]
    want = pd.DataFrame(want, columns=[*key, "y_true", "y_pred"]).sort_values(key).reset_index(drop=True)
    got = got[want.columns].sort_values(key).reset_index(drop=True)
    got["horizonte"] = got.horizonte.astype("int64")
    pd.testing.assert_frame_equal(got, want)


def test_short_history_features(spark):
    df = spark.createDataFrame([([3.0],), ([1.0, 2.0],)], "h array<double>")
    f = horizons.history_features(F.col("h"))
    rows = df.select(*[f[n].alias(n) for n in ("target_lag_1", "target_lag_2", "target_rolling_mean_3", "target_rolling_std_3")]).collect()
    assert tuple(rows[0]) == (3.0, None, 3.0, 0.0) and tuple(rows[1]) == (2.0, 1.0, 1.5, pytest.approx(0.5**0.5))


def test_future_exogenous(panel):
    rows = horizons.future_exogenous(panel, 3).where("provincia_key = 'a'").orderBy("paso").collect()
    assert [r.fecha for r in rows] == [date(2018, 7, 1), date(2018, 8, 1), date(2018, 9, 1)]
    assert {r.precio_productor_usdkg_filled for r in rows} == {29.0} and [r.mes_num for r in rows] == [7, 8, 9]


def test_ridge_from_sums(spark):
    rng = np.random.default_rng(4)
    x = rng.uniform(50, 60, (120, 3))
    y = x @ [1.0, -2.0, 0.5] + 3 + rng.normal(0, 0.1, 120)
    chunk = np.repeat([1, 2, 3], 40)
    rows = [("p", int(c), [float(v) for v in r], float(t)) for c, r, t in zip(chunk, x, y)]
    df = spark.createDataFrame(rows, "k string, chunk int, x array<double>, y double").repartition(7)
    sums = ridge.cross_sums(df, ["k", "chunk"], "x", "y")
    states = ridge.expanding_sums(sums, ["k"])
    low, spread = x.min(axis=0), x.max(axis=0) - x.min(axis=0)
    ready = states.withColumns({"low": F.array(*[F.lit(float(v)) for v in low]), "spread": F.array(*[F.lit(float(v)) for v in spread])})
    got = {(r.chunk, r.penalty): np.array(r.beta) for r in ridge.solve(ready, ["k", "chunk"], [0.0, 1.0]).collect()}
    for c in (1, 2, 3):
        for penalty in (0.0, 1.0):
            z = np.column_stack([np.ones((chunk <= c).sum()), (x[chunk <= c] - low) / spread])
            beta = np.linalg.solve(z.T @ z + np.diag([0.0, *[penalty] * 3]), z.T @ y[chunk <= c])
            want = np.concatenate([[beta[0] - (beta[1:] * low / spread).sum()], beta[1:] / spread])
            np.testing.assert_allclose(got[c, penalty], want, rtol=1e-5)


def test_trees(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [("p", d, "A", "P", float(x), float(x > 0) + 5.0) for d in months(24) for x in rng.normal(size=6)]
    df = spark.createDataFrame(rows, "product_key string, fecha date, provincia string, producto string, target_lag_1 double, target_precio_mercado_usdkg double")
    params = {"trees": 3, "depth": 2, "step": 0.5}
    bounds = fold_bounds(df)
    scores = trees.grid_scores(df, bounds, ["target_lag_1"], ["product_key"], [params], [0.0, 0.3])
    assert scores.count() == 2
    best = trees.best_candidate(scores, ["product_key"]).collect()[0]
    assert best.blend_weight == 0.0 and best.validation_rmse_mean < 0.3
    model = trees.fit_trees(df, ["target_lag_1"], params)
    assert trees.score(model, df).where("abs(y_pred - target_precio_mercado_usdkg) > 0.5").count() < 5  # binned split points
    trees.save_model(model, str(tmp_path / "m"))
    assert trees.predict_stored(str(tmp_path / "m"), df, 0.0, "a").count() == df.count()
    assert trees.importances(model, spark, ["target_lag_1"], "p", "base").collect()[0].importance == pytest.approx(1.0)


def test_drift(spark):
    rng = np.random.default_rng(9)
    a, b = rng.normal(0, 1, 400).round(2), rng.normal(0.4, 1, 300).round(2)
    left = spark.createDataFrame([(float(v), 1.0) for v in a], "x double, c double")
    right = spark.createDataFrame([(float(v), 1.0) for v in b], "x double, c double")
    got = {r.column: r for r in monitoring.drift_report(left, right, ["x", "c"]).collect()}
    grid = np.unique(np.concatenate([a, b]))
    ks = max(abs((a <= v).mean() - (b <= v).mean()) for v in grid)
    assert got["x"].ks == pytest.approx(ks) and got["x"].drifted and not got["c"].drifted and got["c"].ks == 0
    edges = np.quantile(a, np.arange(1, 10) / 10)
    r = np.bincount([(edges < v).sum() for v in a], minlength=10) / len(a)
    c = np.bincount([(edges < v).sum() for v in b], minlength=10) / len(b)
    r, c = np.maximum(r, 1e-4), np.maximum(c, 1e-4)
    assert got["x"].psi == pytest.approx(((c - r) * np.log(c / r)).sum()) and got["x"].drifted_share == 0.5


def test_performance_report_skips_small(spark):
    rows = [("p", "m", "full", "P", "a", d, 1.0, 1.1) for d in months(9)] + [("q", "m", "full", "P", "a", d, 1.0, 1.1) for d in months(9)]
    df = spark.createDataFrame(rows, PREDICTED)
    now = df.where("product_id = 'p' or fecha < date '2016-04-01'")
    got = monitoring.performance_report(df, now, ["product_id"]).collect()
    assert sorted((r.product_id, r.which) for r in got) == [("p", "current"), ("p", "reference")]


def test_rankings(spark):
    producer = [("Maíz", "loja")] * 3 + [("maiz ", "Azuay")] + [("Papa", "Azuay")] * 2 + [("", "Loja"), (None, "x")]
    market = [("MAIZ", "Loja")] * 2 + [("Papa", "AZUAY")] + [("Café", "Loja")] * 5
    frames = [spark.createDataFrame(rows, "producto string, provincia string") for rows in (producer, market)]
    counts = [ranking.product_province_counts(ranking.source_counts(f, n), n) for f, n in zip(frames, ("productor", "mercados"))]
    merged = ranking.joined_counts(*counts)
    products = ranking.shared_products(merged).collect()
    assert [(r.producto_key, r.score_modelado) for r in products] == [("maiz", 6 + 4 + 25), ("papa", 3 + 2 + 25)]
    assert products[0].producto_productor == "Maíz" and products[0].provincias_union == 2
    provinces = ranking.influential_provinces(merged, ranking.shared_products(merged)).collect()
    assert {r.provincia: r.top_5_productos for r in provinces} == {"Loja": "Maíz", "Azuay": "Papa | maiz"}
