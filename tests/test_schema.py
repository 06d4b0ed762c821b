"""Column contracts of the panels built by the pipelines (the reference fixes them as explicit lists)."""

from pyspark.sql import functions as F

from panelcraft.plans.pipeline import build_panel


def test_panel_columns_and_grid(spark):
    units = spark.createDataFrame([("01", "AA"), ("02", "BB"), ("03", "CC")], "fips string, unit string")
    src_a = spark.createDataFrame([("AA", 2001, 5), ("BB", 2002, 7)], "unit string, year int, deaths int")
    src_b = spark.createDataFrame([("AA", 2001, 100.0), ("CC", 2003, 50.0)], "unit string, year int, pop double")
    panel, miss = build_panel(units, ["fips", "unit"], "year", 2001, 2003,
                              [src_a.join(units, "unit"), src_b.join(units, "unit")], zero_fill=["deaths"],
                              rates={"rate": ("deaths", "pop", 100000.0, 1000.0)})
    assert set(panel.columns) == {"fips", "unit", "year", "deaths", "pop", "rate"}
    rows = {(r["unit"], r["year"]): r for r in panel.collect()}
    assert len(rows) == 9
    assert rows[("CC", 2001)]["deaths"] == 0          # zero fill for counts
    assert rows[("CC", 2001)]["pop"] is None          # covariates stay missing (N10)
    assert rows[("AA", 2001)]["rate"] == 5 / 100000.0 * 100000.0
    assert rows[("BB", 2002)]["rate"] is None         # no denominator -> NULL (N2)
    m = {r["column"]: r["missing_rate"] for r in miss.collect()}
    assert abs(m["pop"] - 7 / 9) < 1e-12 and m["deaths"] == 0.0


def test_panel_rejects_duplicate_source_keys(spark):
    import pytest
    units = spark.createDataFrame([("AA",)], "unit string")
    dup = spark.createDataFrame([("AA", 2001, 1), ("AA", 2001, 2)], "unit string, year int, v int")
    with pytest.raises(ValueError):
        build_panel(units, ["unit"], "year", 2001, 2001, [dup])
