"""Edge cases of SURVEY section 5: no treated unit, a single unit, all-missing columns, empty groups."""

import math

import numpy as np

from panelcraft.operators.did import att_dynamic_dr, att_gt, att_gt_dr
from panelcraft.operators.panel import missing_rates
from panelcraft.operators.predict import fit_preprocess
from panelcraft.operators.regression import event_study, fit_twfe, hash_assignments, histogram, placebo_coefficients


def _untreated(spark):
    rng = np.random.default_rng(0)
    rows = [(u, t, float(rng.normal()), float(rng.normal())) for u in range(5) for t in range(2000, 2008)]
    return spark.createDataFrame(rows, "unit int, year int, y double, x double").selectExpr(
        "*", "cast(null as int) treatment_time", "cast(null as int) event_time")


def test_no_treated_unit(spark):
    df = _untreated(spark)
    table, s = event_study(df, "y", ["x"], ["unit"], "year")
    rows = table.collect()
    assert len(rows) == 10 and all(r["coef"] == 0.0 and r["p_value"] is None for r in rows)  # min-norm convention
    a = hash_assignments(df.where("treatment_time is not null").select("unit"), "unit", df.select("year"), "year", 3)
    assert placebo_coefficients(df, "y", ["x"], "unit", "year", a).count() == 0
    assert att_gt(df, ["unit"], "year", "y", "treatment_time").count() == 0
    assert att_gt_dr(df, "unit", "year", "y", "treatment_time", ["x"]).count() == 0
    assert att_dynamic_dr(df, "unit", "year", "y", "treatment_time", ["x"], n_boot=9).count() == 0


def test_single_unit_has_no_cluster_se(spark):
    f = fit_twfe(_untreated(spark).where("unit = 0"), "y", ["x"], ["unit"], "year")
    assert f.n_clusters == 1 and math.isnan(f.se()[0]) and np.isfinite(f.coef[0])


def test_all_missing_column(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None)], "a double, b double")
    pp = fit_preprocess(df, ["a", "b"])
    assert pp.columns == ["a"]
    m = {r["column"]: r["missing_rate"] for r in missing_rates(df).collect()}
    assert m == {"a": 0.0, "b": 1.0}


def test_histogram_constant_and_empty(spark):
    df = spark.createDataFrame([(1.0,), (1.0,)], "v double")
    assert [(r["bin"], r["n"]) for r in histogram(df, "v").collect()] == [(1, 2)]
    assert histogram(df.where("v > 5"), "v").count() == 0
