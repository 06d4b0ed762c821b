"""Null/NaN/ANSI semantics N1-N13, cleaning and statistics helpers."""

import math

from pyspark.sql import functions as F

from panelcraft.functions.clean import clean_numeric, indicator, nan_to_null, parse_mdy, rate_per
from panelcraft.functions.stats import f_sf, normal_two_sided_p
from panelcraft.operators.predict import fit_preprocess


def test_clean_numeric_tokens(spark):
    vals = ["$1,234.50", " 12% ", "-", "", "nan", "None", "abc", "-5", " 7"]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [r[0] for r in df.select(clean_numeric("s")).collect()]
    assert got == [1234.5, 12.0, None, None, None, None, None, -5.0, 7.0]
    got2 = [r[0] for r in df.select(clean_numeric("s", strip_all_dashes=True)).collect()]
    assert got2[7] == 5.0  # the reference's variant removes every dash (N11)


def test_nan_is_not_an_increase(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (1.0,), (-1.0,)], "d double")
    got = [r[0] for r in df.select(indicator(nan_to_null(F.col("d")) > 0)).collect()]
    assert got == [0, 0, 1, 0]


def test_rate_zero_denominator_and_dates(spark):
    df = spark.createDataFrame([(5, 0.0, "1/2/2020"), (5, 2.0, "13/40/2020"), (1, None, "2020-01-01")],
                               "n int, pop double, d string")
    rows = df.select(rate_per("n", "pop", 100000.0, 1000.0).alias("r"), parse_mdy("d").alias("dt")).collect()
    assert rows[0]["r"] is None and rows[1]["r"] == 250.0 and rows[2]["r"] is None
    assert str(rows[0]["dt"]) == "2020-01-02" and rows[1]["dt"] is None and rows[2]["dt"] is None


def test_exact_median_and_population_sd(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 11)] + [(None,)], "x double")
    pp = fit_preprocess(df, ["x"])
    assert pp.medians["x"] == 5.5                # N7: exact, not the approximate 5.0
    import numpy as np
    assert abs(pp.sds["x"] - np.std([*range(1, 11), 5.5])) < 1e-12   # imputed train, ddof 0 (N6)


def test_distribution_tails():
    assert abs(normal_two_sided_p(1.959963984540054) - 0.05) < 1e-12
    assert abs(f_sf(1.902547, 4, 50) - 0.12459) < 1e-5
    assert abs(f_sf(1.546796, 4, 50) - 0.20309) < 1e-5
