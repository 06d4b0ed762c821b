"""Prediction: elastic-net objective equals a coordinate-descent reference; splits and metrics."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from panelcraft.functions.quantile import exact_medians
from panelcraft.operators.predict import (elastic_net, fit_preprocess, join_vectors, model_ladder, quantile_split, regression_metrics,
                                          split_with_fallback)


def _cd_enet(X, y, alpha, l1, iters=20000):
    """scikit-learn objective: 1/(2n)|y - Xw - b|^2 + alpha*l1*|w|_1 + alpha*(1-l1)/2*|w|^2."""
    n, p = X.shape
    Xc, yc = X - X.mean(0), y - y.mean()
    w = np.zeros(p)
    for _ in range(iters):
        w_old = w.copy()
        for j in range(p):
            r = yc - Xc @ w + Xc[:, j] * w[j]
            rho = Xc[:, j] @ r / n
            z = Xc[:, j] @ Xc[:, j] / n + alpha * (1 - l1)
            w[j] = np.sign(rho) * max(abs(rho) - alpha * l1, 0) / z
        if np.abs(w - w_old).max() < 1e-13:
            break
    return w, y.mean() - X.mean(0) @ w


def test_elastic_net_matches_sklearn_objective(spark):
    rng = np.random.default_rng(0)
    X = rng.normal(size=(300, 4))
    X = (X - X.mean(0)) / X.std(0)
    y = X @ np.array([2.0, -1.0, 0.05, 0.0]) + 3 + rng.normal(size=300) * 2
    sigma = y.std()
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(X, y)], "a double, b double, c double, d double, y double")
    df = VectorAssembler(inputCols=["a", "b", "c", "d"], outputCol="f").transform(df).withColumn("ys", F.col("y") / sigma)
    m = elastic_net("f", "ys", 0.1, 0.5, sigma_y=sigma).fit(df)
    w_ref, b_ref = _cd_enet(X, y, 0.1, 0.5)
    assert np.allclose(np.array(m.coefficients) * sigma, w_ref, atol=1e-4)
    assert abs(m.intercept * sigma - b_ref) < 1e-4


def test_split_fallback_and_metrics(spark):
    df = spark.createDataFrame([(y, float(y)) for y in range(2010, 2020)], "year int, v double")
    s = split_with_fallback(df, "year", (2003, 2016), (2017, 2019), (2020, 2023))  # test window empty -> cuts
    got = {r["year"]: r["split"] for r in s.collect()}
    assert got[2016] == "train" and got[2017] == "val" and got[2018] == "val" and got[2019] == "test"
    q = {r["year"]: r["split"] for r in quantile_split(df, "year").collect()}
    assert q == got
    pred = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (3.0, 2.0)], "y double, p double")
    m = regression_metrics(pred, "y", "p").first()
    e = np.array([-0.5, 0, 1.0])
    assert abs(m["mae"] - np.abs(e).mean()) < 1e-12 and abs(m["rmse"] - np.sqrt((e ** 2).mean())) < 1e-12
    assert abs(m["r2"] - (1 - (e ** 2).sum() / 2.0)) < 1e-12


def test_factorisation_rung_beats_the_mean_far_from_zero(spark):
    rng = np.random.default_rng(5)
    X = rng.normal(size=(600, 3))
    y = 250_000 + 18_000 * (X[:, 0] - 0.5 * X[:, 1] + 0.4 * X[:, 0] * X[:, 2]) + rng.normal(size=600) * 1_000
    rows = [(i, *map(float, x), float(t), "train" if i < 400 else "val" if i < 500 else "test")
            for i, (x, t) in enumerate(zip(X, y))]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, y double, split string")
    ev, pred = model_ladder(df, ["a", "b", "c"], "y", ["id"], "planted", models={"FM": {"scale": True, "kind": "fm"}})
    got = ev.first()
    assert got["val_r2"] > 0.8 and got["test_r2"] > 0.8
    assert pred.count() == 100


def test_ladder_fits_the_reference_sizes(spark, monkeypatch):
    from pyspark.ml import regression

    from conftest import SF_SMALL
    from panelcraft.plans.queries import QUERIES

    class Stop(Exception):
        pass

    built = {}

    class Forest:
        def __init__(self, **kw):
            built["forest"] = kw

        def fit(self, train):  # what is fitted is known now; the others are not reached
            from panelcraft.operators import predict
            built["rounds"] = predict.default_models()["GBTRegressor"]["max_iter"]
            raise Stop

    monkeypatch.setattr(regression, "RandomForestRegressor", Forest)
    try:
        QUERIES["model_ladder"](spark, SF_SMALL)
    except Stop:
        pass
    assert (built["forest"]["numTrees"], built["forest"]["maxDepth"], built["rounds"]) == (400, 30, 100)


def _ridge(X, y, alpha):
    n, p = X.shape
    Xc = X - X.mean(0)
    w = np.linalg.solve(Xc.T @ Xc / n + alpha * np.eye(p), Xc.T @ (y - y.mean()) / n)
    return w, y.mean() - X.mean(0) @ w


def test_vectors_are_features_beside_scalars(spark):
    rng = np.random.default_rng(3)
    n = 240
    a, E = rng.normal(size=n) * 5 + 2, rng.normal(size=(n, 4)) * 3
    y = 1000 + 7 * a + E @ np.array([1.0, -2.0, 0.0, 4.0]) + rng.normal(size=n)
    missing_vec, missing_a, bad = rng.random(n) < 0.1, rng.random(n) < 0.1, rng.random(n) < 0.05
    split = np.where(np.arange(n) < 160, "train", np.where(np.arange(n) < 200, "val", "test"))
    panel = spark.createDataFrame(
        [(i, None if missing_a[i] else float(a[i]), None, float(y[i]), str(split[i])) for i in range(n)],
        "id int, a double, hole double, y double, split string")
    # entry 2 of the vectors is missing everywhere; some entries are NaN
    vectors = spark.createDataFrame(
        [(i, [float(E[i, 0]), float("nan") if bad[i] else float(E[i, 1]), None, float(E[i, 3])]) for i in range(n) if not missing_vec[i]],
        "id int, emb array<double>")
    df = join_vectors(panel, vectors, ["id"])
    pp = fit_preprocess(df.where("split = 'train'"), ["a", "hole"], vectors=["emb"])
    assert pp.columns == ["a", "emb_000", "emb_001", "emb_003"]

    X = np.column_stack([np.where(missing_a, np.nan, a), *(np.where(missing_vec | (bad & (k == 1)), np.nan, E[:, k]) for k in (0, 1, 3))])
    tr = split == "train"
    med = np.nanmedian(X[tr], axis=0)
    assert np.allclose([pp.medians[c] for c in pp.columns], med)
    X = np.where(np.isnan(X), med, X)
    Z = (X - X[tr].mean(0)) / X[tr].std(0)
    w, b = _ridge(Z[tr], y[tr], 0.5)
    ev, pred = model_ladder(df, ["a", "hole"], "y", ["id"], "planted", models={"Ridge": {"scale": True, "kind": "ridge", "alpha": 0.5}},
                            vectors=["emb"])
    got = {r["id"]: r["y_pred"] for r in pred.collect()}
    assert set(got) == set(range(200, 240))
    assert np.allclose([got[i] for i in range(200, 240)], Z[200:] @ w + b, atol=1e-6)
    assert ev.first()["test_r2"] > 0.7
    # the other rungs take the same vectors
    small = {"ElasticNet": {"scale": True, "kind": "enet"}, "RF": {"scale": False, "kind": "rf", "n_trees": 5, "max_depth": 4},
             "GBT": {"scale": False, "kind": "gbt", "max_iter": 3}, "FM": {"scale": True, "kind": "fm", "max_iter": 5}}
    ev, pred = model_ladder(df, ["a", "hole"], "y", ["id"], "planted", models=small, vectors=["emb"])
    assert ev.count() == 4 and pred.count() == 160


def test_vectors_of_unequal_length_raise(spark):
    df = spark.createDataFrame([(1.0, [1.0]), (2.0, [1.0, 2.0])], "y double, emb array<double>")
    with pytest.raises(ValueError, match="between 1 and 2"):
        fit_preprocess(df, [], vectors=["emb"])
    none = spark.createDataFrame([(1.0, None)], "a double, emb array<double>")
    assert fit_preprocess(none, ["a"], vectors=["emb"]).columns == ["a"]


def test_exact_medians(spark):
    rng = np.random.default_rng(8)
    columns = {0: rng.normal(size=5001), 1: np.round(rng.normal(size=5000), 1), 2: np.array([3.0]), 3: np.array([1.0, 2.0]),
               4: np.r_[np.zeros(3000), np.arange(2000)], 5: np.arange(20_000) % 7 * 1.0, 6: np.arange(1, 11) * 1.0}
    df = spark.createDataFrame(pd.DataFrame({"k": np.concatenate([[k] * len(v) for k, v in columns.items()] + [[0, 9]]),
                                             "v": [*np.concatenate(list(columns.values())), None, None]}))
    for accuracy in (10_000, 20, 3):
        got = {r["k"]: (r["n"], r["median"]) for r in exact_medians(df.withColumn("v", F.expr("nullif(v, 'NaN')")), "k", "v", accuracy).collect()}
        assert got == {k: (len(v), float(np.median(v))) for k, v in columns.items()}


def test_metrics_do_not_cancel_far_from_zero(spark):
    y = 1e9 + np.arange(10.0)
    df = spark.createDataFrame([(float(v), float(v) + 0.5) for v in y], "y double, p double")
    assert abs(regression_metrics(df, "y", "p").first()["r2"] - (1 - 10 * 0.25 / 82.5)) < 1e-9
