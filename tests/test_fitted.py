"""Grouped trees and entity regressions against plain numpy, and the future rows against the feature builder."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelmill.constants import CALENDAR_FEATURES, FULL_FEATURES, TARGET, TARGET_LAG_FEATURES
from panelmill.operators import contracts, forest, seasonal
from panelmill.operators.forest import TreeParams
from panelmill.operators.horizons import latest_state, recursive_forecast
from panelmill.operators.windows import add_lag_features
from panelmill.plans.runner import Runner
from panelmill.sources import store

PARAMS = TreeParams(rounds=5, depth=3, step=0.4, penalty=1.0, min_rows=3, bins=8)


def _grow(x, y, p):
    """Trees of one model by loops: (tree, node) to (feature, threshold) or a leaf's value."""
    low, width = x.min(axis=0), np.ptp(x, axis=0) + 1
    bins = (x - low) * p.bins // width
    start = int(y.sum() // len(y))
    nodes, g = {(0, 0): start}, y - start
    for tree in range(1, p.rounds + 1):
        where, out = {0: np.arange(len(y))}, np.zeros(len(y), np.int64)
        for level in range(p.depth + 1):
            below = {}
            for node, rows in where.items():
                best = None
                for f in range(x.shape[1]):
                    for b in np.unique(bins[rows, f]):
                        left = bins[rows, f] <= b
                        n, m, s, t = left.sum(), (~left).sum(), g[rows][left].sum(), g[rows].sum()
                        if n >= p.min_rows and m >= p.min_rows:
                            gain = float(s) ** 2 / (n + p.penalty) + float(t - s) ** 2 / (m + p.penalty) - float(t) ** 2 / (n + m + p.penalty)
                            if gain > 0 and (best is None or gain > best[0]):
                                best = (gain, f, b)
                if best is None or level == p.depth:
                    out[rows] = nodes[tree, node] = int(np.floor(p.step * (g[rows].sum() / (len(rows) + p.penalty))))
                else:
                    _, f, b = best
                    nodes[tree, node] = (f, int(low[f] + np.ceil((b + 1) * width[f] / p.bins)))
                    below[2 * node + 1], below[2 * node + 2] = rows[bins[rows, f] <= b], rows[bins[rows, f] > b]
            where = below
        g = g - out
    return nodes, y - g


@pytest.fixture(scope="module")
def models():
    draw = np.random.default_rng(4)
    out = {}
    for name, n, width in (("large", 300, 4), ("small", 25, 4), ("one", 1, 2), ("flat", 30, 2)):
        x = draw.integers(0, 1000, (n, width)) * (name != "flat")
        out[name] = x, (x[:, 0] * 3 + (x[:, -1] > 500) * 900 + draw.integers(0, 50, n)).astype(np.int64)
    return out


def test_forests_equal_plain_loops(spark, models):
    rows = [(k, [int(v) for v in a], int(b)) for k, (x, y) in models.items() for a, b in zip(x, y)]
    df = spark.createDataFrame(rows, "model string, x array<bigint>, y bigint")
    found = forest.fit_forests(df, ["model"], PARAMS)
    again = forest.fit_forests(df.repartition(7), ["model"], PARAMS)
    assert sorted(map(str, found.collect())) == sorted(map(str, again.collect()))
    packed = forest.packed(found, ["model"])
    scored = df.join(packed, "model").withColumn("p", forest.forest_prediction(F.col("forest"), F.col("x"), PARAMS.depth)).collect()
    for name, (x, y) in models.items():
        nodes, fitted = _grow(x, y, PARAMS)
        got = {(r.tree, r.node): r.value if r.feature is None else (r.feature, r.threshold) for r in found.collect() if r.model == name}
        assert got == nodes
        want = {tuple(a): v for a, v in zip(x.tolist(), fitted.tolist())}
        for r in scored:
            if r.model == name:
                assert round(r.p * forest.GRID) == want[tuple(r.x)]


def test_importance_shares(spark, models):
    x, y = models["large"]
    df = spark.createDataFrame([("large", [int(v) for v in a], int(b)) for a, b in zip(x, y)], "model string, x array<bigint>, y bigint")
    shares = forest.gain_shares(forest.fit_forests(df, ["model"], PARAMS), ["model"], F.array(*[F.lit(c) for c in "abcd"])).collect()
    assert [r.feature for r in sorted(shares, key=lambda r: -r.importance)][0] == "a"
    assert sum(r.importance for r in shares) == pytest.approx(1.0) and len(shares) == 4


def _months(n):
    return [dt.date(2015 + i // 12, i % 12 + 1, 1) for i in range(n)]


def test_entity_coefficients(spark):
    draw = np.random.default_rng(3)
    rows, want = [], {}
    for entity in ("a", "b"):
        values = draw.normal(50, 5, (60, 3)).round(3)
        y = (2 + 0.5 * values[:, 0] + 0.3 * values[:, 1] + draw.normal(0, 1, 60)).round(3)
        rows += [("p", entity, d, float(t), *map(float, v)) for d, t, v in zip(_months(60), y, values)]
        for k, used in enumerate([(), (0,), (1,), (0, 1), (0, 2), (1, 2)]):
            z = np.column_stack([np.ones(60), values[:, used]]) if used else None
            beta = np.linalg.lstsq(z, y, rcond=None)[0] if used else None
            want[entity, k] = np.array([0.0, 1, 0, 0]) if beta is None else np.insert(np.zeros(3), 0, beta[0])
            for i, u in enumerate(used):
                want[entity, k][1 + u] = beta[1 + i]
    schema = f"product_key string, provincia_key string, fecha date, {TARGET} double, target_lag_1 double, target_lag_12 double, {seasonal.PRODUCER} double"
    bounds = spark.createDataFrame([("p", 1, dt.date(2017, 1, 1))], "product_key string, fold int, train_end date")
    found = seasonal.fit_candidates(spark.createDataFrame(rows, schema).repartition(5), bounds).collect()
    for r in found:
        if r.fold == 0:
            np.testing.assert_allclose([r[c] for c in seasonal.COEFFICIENTS], want[r.provincia_key, r.candidate], rtol=1e-3, atol=1e-3)
    assert len(found) == 2 * 2 * 10
    few = spark.createDataFrame(rows[:5], schema)
    assert {r.candidate for r in seasonal.fit_candidates(few, bounds).collect()} == {0}
    same = spark.createDataFrame([(*r[:3], 7.0, 7.0, 7.0, 7.0) for r in rows[:60]], schema)
    assert {r.candidate for r in seasonal.fit_candidates(same, bounds).collect()} == {0}
    assert seasonal.fit_candidates(spark.createDataFrame([], schema), bounds).count() == 0


def test_future_rows_equal_the_feature_builder(spark):
    """Features of future months are those of a panel to which the forecasts were appended."""
    draw = np.random.default_rng(8)
    names = [c for c in FULL_FEATURES if c not in (*CALENDAR_FEATURES, *TARGET_LAG_FEATURES) and "_lag_" not in c]
    rows = [("p", e, d, float(draw.uniform(1, 9)), *[float(draw.uniform(1, 5)) for _ in names]) for e in "ab" for d in _months(20)]
    schema = ", ".join(["product_key string, provincia_key string, fecha date", f"{TARGET} double", *[f"{c} double" for c in names]])
    panel = spark.createDataFrame(rows, schema)
    made = recursive_forecast(latest_state(panel), {"m": lambda f: f["target_lag_1"] * 0.5 + f["target_lag_12"] * 0.5}, keep=FULL_FEATURES)
    ahead = made.select("product_key", "provincia_key", F.inline_outer("forecasts")).collect()
    last = {r[1]: r for r in rows if r[2] == _months(20)[-1]}
    more = [("p", r.provincia_key, r.fecha_objetivo, r.y_pred, *last[r.provincia_key][4:]) for r in ahead]
    built = {(r.provincia_key, r.fecha): r for r in add_lag_features(spark.createDataFrame(rows + more, schema)).collect()}
    assert len(ahead) == 6
    for r in ahead:
        want = built[r.provincia_key, r.fecha_objetivo]
        for c in TARGET_LAG_FEATURES:
            assert r[c] == pytest.approx(want[c]), (c, r.horizonte)
        assert r.mes_num == r.fecha_objetivo.month and r.trimestre == (r.fecha_objetivo.month + 2) // 3
        assert all(r[c] == last[r.provincia_key][4 + i] for i, c in enumerate(names))


def test_contract_in_the_plan(spark):
    rows = [(dt.date(2020, 1, 1), "A", 0, 1.0), (None, "A", 0, 1.0)]
    df = spark.createDataFrame(rows, f"fecha date, provincia string, provincia_id int, {TARGET} double")
    checked = contracts.enforce_dataset(df, ["provincia_id"])
    with pytest.raises(Exception, match="missing values: fecha"):
        checked.count()
    assert contracts.enforce_dataset(df.where("fecha is not null"), ["provincia_id"]).count() == 1
    assert contracts.enforce_dataset(df.limit(0), ["provincia_id"]).count() == 0
    with pytest.raises(ValueError):
        contracts.enforce_dataset(df.drop("provincia"), ["provincia_id"])
    assert contracts.select_or_fail(df, F.lower("provincia") == "a", "none").count() == 2
    with pytest.raises(Exception, match="no such province"):
        contracts.select_or_fail(df, F.col("provincia") == "B", "no such province").count()


def test_runner_records_every_stage(spark, tmp_path):
    run = Runner(spark, str(tmp_path))
    run.run("p", "m", "base", lambda: spark.range(7))
    run.run("p", "m", "full", lambda: contracts.select_or_fail(spark.range(7), F.col("id") > 9, "nothing left"))
    run.run("p", "n", "base", lambda: spark.table("absent"))
    rows = run.status().collect()
    assert [(r.status, r.rows) for r in rows] == [("ok", 7), ("error", None), ("error", None)]
    assert rows[1].error == "nothing left" and "absent" in rows[2].error


def test_ordered_files(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k"), F.lit("x").alias("v")).repartition(5)
    store.write_ordered(df, str(tmp_path / "t"), ["k"])
    back = store.read_ordered(spark, str(tmp_path / "t")).collect()
    assert len(back) == 1000 and all(r.position == r.k + 1 for r in back)
