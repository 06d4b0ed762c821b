"""Distributed fixed-effects regression, cluster-robust covariance, placebo and SVD vs numpy brute force."""

import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelcraft.functions.stats import f_sf
from panelcraft.operators.regression import (connected_parts, demean_by_unit, event_study, fit_twfe, gram, hash_assignments,
                                             numpy_rng_assignments, placebo_coefficients, sparse_svd_project, svd_project)
from panelcraft.operators.text import tfidf_vectors


def _panel(seed=0, units=12, years=range(2000, 2012), drop=0.1):
    rng = np.random.default_rng(seed)
    rows = []
    for u in range(units):
        g = rng.choice([2004, 2006, 2008, None, None])
        a = rng.normal()
        for t in years:
            if rng.random() < drop:
                continue  # unbalanced
            x1, x2 = rng.normal(), rng.normal() * 100 + 1000
            et = (t - g) if g is not None else None
            eff = 0.5 * (et >= 0) if et is not None else 0.0
            y = a + 0.1 * (t - 2000) + 0.3 * x1 + 0.002 * x2 + eff + rng.normal() * 0.5
            rows.append((u, t, float(x1), float(x2), float(y), g))
    return pd.DataFrame(rows, columns=["unit", "year", "x1", "x2", "y", "g"])


def _ols_dummies(pdf, y, xcols):
    """Brute force: OLS with unit and year dummies, CR1 cluster covariance by unit (small-sample factor G/(G-1) (n-1)/(n-k))."""
    units = sorted(pdf.unit.unique())
    years = sorted(pdf.year.unique())
    X = [np.ones(len(pdf))] + [pdf[c].to_numpy(float) for c in xcols]
    X += [(pdf.unit == u).to_numpy(float) for u in units[1:]]
    X += [(pdf.year == t).to_numpy(float) for t in years[1:]]
    X = np.column_stack(X)
    Y = pdf[y].to_numpy(float)
    b, *_ = np.linalg.lstsq(X, Y, rcond=None)
    u = Y - X @ b
    n, k = X.shape
    k = np.linalg.matrix_rank(X)
    inv = np.linalg.pinv(X.T @ X)
    meat = np.zeros((X.shape[1], X.shape[1]))
    for g in units:
        m = (pdf.unit == g).to_numpy()
        s = X[m].T @ u[m]
        meat += np.outer(s, s)
    G = len(units)
    V = G / (G - 1) * (n - 1) / (n - k) * inv @ meat @ inv
    r2 = 1 - (u @ u) / ((Y - Y.mean()) @ (Y - Y.mean()))
    idx = list(range(1, 1 + len(xcols)))
    return b[idx], V[np.ix_(idx, idx)], r2


def test_twfe_matches_dummy_ols_unbalanced(spark):
    pdf = _panel()
    df = spark.createDataFrame(pdf[["unit", "year", "x1", "x2", "y"]])
    fit = fit_twfe(df, "y", ["x1", "x2"], ["unit"], "year")
    b, V, r2 = _ols_dummies(pdf, "y", ["x1", "x2"])
    assert np.allclose(fit.coef, b, rtol=1e-8, atol=1e-10)
    assert np.allclose(fit.cov, V, rtol=1e-6, atol=1e-14)
    assert abs(fit.r2 - r2) < 1e-9
    assert fit.nobs == len(pdf)


def test_twfe_with_ten_thousand_periods(spark):
    rng = np.random.default_rng(9)
    periods, units = 10_000, 3
    u, t = np.divmod(np.arange(units * periods), periods)
    keep = rng.random(len(u)) < 0.8
    u, t = u[keep], t[keep]
    x = rng.normal(size=(len(u), 2)) + u[:, None] + np.sin(t)[:, None]
    y = x @ np.array([0.7, -1.2]) + u + np.cos(t) + rng.normal(size=len(u))
    df = spark.createDataFrame(pd.DataFrame({"u": u, "t": t, "a": x[:, 0], "b": x[:, 1], "y": y}))
    fit = fit_twfe(df, "y", ["a", "b"], ["u"], "t")

    def within_period(v):
        return v - (np.bincount(t, v, periods) / np.maximum(np.bincount(t, minlength=periods), 1))[t]

    Z = np.column_stack([within_period(v) for v in (x[:, 0], x[:, 1], *(1.0 * (u == k) for k in (1, 2)))])
    want = np.linalg.lstsq(Z, within_period(y), rcond=None)[0]
    assert np.allclose(fit.coef, want[:2], atol=1e-8)
    assert fit.k == 2 + units + len(np.unique(t)) - 1 and fit.nobs == len(u)
    # neither dummies nor the list of periods are in the plan of a sweep
    plan = demean_by_unit(df, ["t"], ["y"])._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 5_000


def test_twfe_of_parts_that_share_no_period_and_of_explained_columns(spark):
    pdf = _panel(seed=11, units=6, years=range(2000, 2010), drop=0.2)
    pdf["year"] += (pdf.unit % 2) * 100  # two parts that share no year
    pdf["const_in_unit"] = pdf.unit * 1.5
    df = spark.createDataFrame(pdf[["unit", "year", "x1", "const_in_unit", "y"]])
    assert connected_parts(df, ["unit"], "year") == 2
    fit = fit_twfe(df, "y", ["x1", "const_in_unit"], ["unit"], "year")
    b, V, r2 = _ols_dummies(pdf, "y", ["x1"])
    assert abs(fit.coef[0] - b[0]) < 1e-8 and abs(fit.cov[0, 0] - V[0, 0]) < 1e-10 and abs(fit.r2 - r2) < 1e-9
    assert fit.coef[1] == 0 and fit.k == 1 + 6 + pdf.year.nunique() - 2


def test_gram_leaves_out_rows_with_a_missing_value(spark):
    rng = np.random.default_rng(2)
    for p in (2, 12):  # the same rule for narrow and wide designs
        X = rng.normal(size=(40, p))
        rows = [[None if (i, j) in {(3, 0), (7, 1)} else float("nan") if (i, j) == (9, 0) else float(X[i, j]) for j in range(p)] for i in range(40)]
        names = [f"x.{j}" if j == 0 else f"x{j}" for j in range(p)]
        df = spark.createDataFrame(rows, ", ".join(f"`{n}` double" for n in names)).toDF(*[f"x{j}" for j in range(p)])
        keep = np.delete(np.arange(40), [3, 7, 9])
        assert np.allclose(gram(df, df.columns), X[keep].T @ X[keep])


def test_event_study_pretrend_f(spark):
    pdf = _panel(seed=3, units=15)
    df = spark.createDataFrame(pdf.rename(columns={"g": "treatment_time"}).assign(
        event_time=lambda d: d.year - d.treatment_time)[["unit", "year", "x1", "y", "treatment_time", "event_time"]]
        .astype({"treatment_time": "float64", "event_time": "float64"}))
    df = df.selectExpr("unit", "year", "x1", "y", "cast(treatment_time as int) treatment_time",
                       "cast(event_time as int) event_time")
    table, s = event_study(df, "y", ["x1"], ["unit"], "year")
    rows = table.collect()
    assert [r["event_time"] for r in rows] == [-5, -4, -3, -2, 0, 1, 2, 3, 4, 5]
    # brute force with the same dummies
    p = pdf.copy()
    terms = []
    for k in [-5, -4, -3, -2, 0, 1, 2, 3, 4, 5]:
        name = f"e{k}"
        p[name] = [(1.0 if (g is not None and not pd.isna(g) and t - g == k) else 0.0) for t, g in zip(p.year, p.g)]
        terms.append(name)
    b, V, _ = _ols_dummies(p, "y", terms + ["x1"])
    assert np.allclose([r["coef"] for r in rows], b[:10], atol=1e-8)
    assert np.allclose([r["se"] for r in rows], np.sqrt(np.diag(V))[:10], rtol=1e-6)
    lb, lV = b[:4], V[:4, :4]
    F = lb @ np.linalg.pinv(lV) @ lb / 4
    assert abs(s["pretrend_f"] - F) < 1e-6 * max(1, F)
    assert abs(s["pretrend_pvalue"] - f_sf(F, 4, 14)) < 1e-9
    assert all(r["pretrend_pvalue"] == s["pretrend_pvalue"] for r in rows)


def test_placebo_matches_per_draw_regression(spark):
    pdf = _panel(seed=5, units=10)
    df = spark.createDataFrame(pdf[["unit", "year", "x1", "y"]].assign(g=pdf.g.astype("float")))
    df = df.selectExpr("unit", "year", "x1", "y", "cast(g as int) g")
    treated = df.where("g is not null").select("unit")
    a = hash_assignments(treated, "unit", df.select("year"), "year", 7, seed=42)
    got = {r["draw"]: r["coef"] for r in placebo_coefficients(df, "y", ["x1"], "unit", "year", a).collect()}
    amap = {(r["draw"], r["unit"]): r["placebo_time"] for r in a.collect()}
    for draw in range(7):
        p = pdf.copy()
        p["post"] = [1.0 if (draw, u) in amap and t >= amap[(draw, u)] else 0.0 for u, t in zip(p.unit, p.year)]
        if p.groupby("unit").post.std().fillna(0).sum() == 0:
            continue
        b, _, _ = _ols_dummies(p, "y", ["post", "x1"])
        assert abs(got[draw] - b[0]) < 1e-8 * max(1, abs(b[0]))


def test_numpy_rng_assignments_reproduce_choice(spark):
    a = numpy_rng_assignments(spark, ["NE", "IL"], [2003, 2004, 2005], 2, seed=42, unit="unit").collect()
    rng = np.random.default_rng(42)
    first = rng.choice([2003, 2004, 2005], size=2, replace=True)
    assert [r["placebo_time"] for r in a if r["draw"] == 0] == [int(first[0]), int(first[1])]


def test_svd_projection_matches_numpy(spark):
    rng = np.random.default_rng(1)
    X = rng.normal(size=(60, 6))
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(X)], "id long, v array<double>")
    proj, sv = svd_project(df, "v", 6, 4)
    s_np = np.linalg.svd(X, compute_uv=False)[:4]
    assert np.allclose(sv, s_np, rtol=1e-10)
    P = np.array([r["svd"] for r in proj.orderBy("id").collect()])
    U, S, Vt = np.linalg.svd(X, full_matrices=False)
    ref = U[:, :4] * S[:4]
    for j in range(4):  # signs are arbitrary
        assert min(np.abs(P[:, j] - ref[:, j]).max(), np.abs(P[:, j] + ref[:, j]).max()) < 1e-8


def test_tfidf_vectors_and_their_sparse_svd(spark):
    texts = ["Beer tax raised again, beer tax", "sunday sales allowed", "Sunday SALES of beer", "", None, "tax on wine and beer", "a b c", "wine tax wine"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumn("tfidf_", F.lit("clash"))
    rows, vocab = tfidf_vectors(df, "text", max_features=9)
    got = {r["id"]: r["tfidf"].toArray() for r in rows.collect()}
    grams = []
    for t in texts:
        w = re.findall(r"\w{2,}", (t or "").lower())
        grams.append(w + [f"{a} {b}" for a, b in zip(w, w[1:])])
    tf = Counter(g for doc in grams for g in doc)
    terms = sorted(sorted(tf, key=lambda g: (-tf[g], g))[:9])
    assert [r["term"] for r in vocab.orderBy("term_index").collect()] == terms
    X = np.array([[doc.count(t) * (np.log((1 + len(texts)) / (1 + sum(t in d for d in grams))) + 1) for t in terms] for doc in grams])
    norm = np.linalg.norm(X, axis=1, keepdims=True)
    X = X / np.where(norm == 0, 1, norm)
    assert np.allclose(np.array([got[i] for i in range(len(texts))]), X)
    proj, sv = sparse_svd_project(rows, "tfidf", 9, 3)
    assert proj.columns == ["id", "text", "tfidf_", "embedding"]
    U, S, _ = np.linalg.svd(X, full_matrices=False)
    assert np.allclose(sv, S[:3])
    P = np.array([r["embedding"] for r in proj.orderBy("id").collect()])
    for j in range(3):
        ref = U[:, j] * S[j]
        assert min(np.abs(P[:, j] - ref).max(), np.abs(P[:, j] + ref).max()) < 1e-8
    # no shuffle between the text and its vector
    assert "Exchange hashpartitioning" not in rows._jdf.queryExecution().executedPlan().toString()


def test_tfidf_without_a_known_term(spark):
    rows, vocab = tfidf_vectors(spark.createDataFrame([(1, ""), (2, None)], "id int, text string"), "text", 5)
    assert vocab.count() == 0
    proj, _ = sparse_svd_project(rows, "tfidf", 1, 2)
    assert sorted(r["id"] for r in proj.collect()) == [1, 2]
