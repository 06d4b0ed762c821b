"""Report tables, dimension lookup, P10/P12 helpers, run status, encoder fallback."""

from pyspark.sql import functions as F

from panelcraft.functions.clean import not_contains_ci
from panelcraft.operators.cases import flags_by_period, thresholds_by_period
from panelcraft.operators.dedupe import consolidate_sources, inverse_lookup
from panelcraft.operators.panel import coverage_flags
from panelcraft.operators.panel import dimension_lookup
from panelcraft.operators.report import (coverage_long, model_comparison, run_status, scenarios, top_and_bottom,
                                         unit_change)


def test_dimension_lookup_with_alias(spark):
    dim = spark.createDataFrame([("District of Columbia", "DC", "11"), ("Texas", "TX", "48")],
                                "name string, abbrev string, fips string")
    al = spark.createDataFrame([("District Of Columbia", "District of Columbia")], "alias string, name string")
    df = spark.createDataFrame([("District Of Columbia",), ("Texas",), ("Atlantis",)], "raw string")
    got = {r["raw"]: r["abbrev"] for r in dimension_lookup(df, "raw", dim, "name", ["abbrev", "fips"], al).collect()}
    assert got == {"District Of Columbia": "DC", "Texas": "TX", "Atlantis": None}


def test_not_contains_and_period_thresholds(spark):
    df = spark.createDataFrame([("Total VMT",), ("rural",), (None,)], "s string")
    assert [r[0] for r in df.select(not_contains_ci("s", "TOTAL")).collect()] == [False, True, True]
    person = spark.createDataFrame([(1, 2010, 96), (2, 2010, 85), (3, 2016, 96), (4, 2016, 85), (4, 2016, 2), (5, 1999, 50),
                                    (6, 2016, None)], "case_id int, year int, alc int")
    thr = spark.createDataFrame([(2000, 2016, 8, 94), (2015, 2030, 90, 940)], "period_from int, period_to int, lo int, hi int")
    per = thresholds_by_period(thr, "year")  # the rule that begins last holds where two overlap
    assert {r["year"]: (r["lo"], r["hi"]) for r in per.where("year IN (2014, 2015)").collect()} == {2014: (8, 94), 2015: (90, 940)}
    got = flags_by_period(person, ["case_id"], "alc", "year", per, "impaired")
    assert sorted(map(tuple, got.collect())) == [(2, True), (3, True)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_inverse_lookup_takes_the_shortest_code_of_a_name(spark):
    dim = spark.createDataFrame([("AL", "Alabama"), ("DC", "District of Columbia"), ("NV", "Nevada"), ("UT", "Utah")], "abbrev string, name string")
    entries = spark.createDataFrame([
        ("Alabama", "ALB"), ("Alabama", "XL"), (" Alabama ", "AL"), ("District Of Columbia", "DC2"), ("Washington  DC", "D"),
        ("Nevada", None), ("nevada", "NV"), (None, "Q"), ("Alabama", "AL")], "d string, code string")
    al = spark.createDataFrame([("District Of Columbia", "District of Columbia"), ("Washington DC", "District of Columbia")], "a string, n string")
    got = inverse_lookup(dim, "name", entries, "d", "code", al, out="loc", count="k")
    assert got.columns == ["abbrev", "name", "loc", "k"]
    assert {r["abbrev"]: (r["loc"], r["k"]) for r in got.collect()} == {"AL": ("AL", 4), "DC": ("D", 2), "NV": (None, 0), "UT": (None, 0)}
    without = {r["abbrev"]: r["loc"] for r in inverse_lookup(dim, "name", entries, "d", "code", out="loc").collect()}
    assert without == {"AL": "AL", "DC": None, "NV": None, "UT": None}


def test_priority_by_source_and_flag(spark):
    rows = [("A", 2019, "S", "observed", 1), ("A", 2019, "E", "observed", 2), ("B", 2019, "S", "observed", 3), ("B", 2019, "E", "missing", 4),
            ("C", 2019, "E", "missing", 5), ("D", 2019, "E", None, 6), ("D", 2019, "S", None, 7)]
    df = spark.createDataFrame(rows, "u string, y int, source string, flag string, v int")
    rules = [(3, {"source": "E", "flag": "observed"}), (2, {"source": "S"})]
    got = {r["u"]: (r["v"], r["priority"]) for r in consolidate_sources(df, ["u", "y"], None, rules, ["v"], default=1).collect()}
    assert got == {"A": (2, 3), "B": (3, 2), "C": (5, 1), "D": (7, 2)}


def test_coverage_flags(spark):
    grid = spark.createDataFrame([(u, y) for u in "ABC" for y in (1, 2)], "u string, y int")
    values = spark.createDataFrame([("A", 1, 5.0, None), ("A", 2, None, None), ("B", 1, None, 2.0)], "u string, y int, v double, w double")
    known = spark.createDataFrame([("A",), ("B",), ("B",)], "u string")
    got = {(r["u"], r["y"]): r["coverage_flag"] for r in coverage_flags(grid, ["u"], "y", values, ["v", "w"], known).collect()}
    assert got == {("A", 1): "observed", ("A", 2): "missing_no_unit_data", ("B", 1): "observed", ("B", 2): "missing_no_unit_data",
                   ("C", 1): "missing_no_code", ("C", 2): "missing_no_code"}


def test_scenarios_without_an_effect_keep_the_level(spark):
    latest = spark.createDataFrame([("A", 1.0), ("B", -1.0), ("C", None)], "u string, v double")
    for none in (None, float("nan")):
        got = {(r["u"], r["scenario"]): r["projected"] for r in scenarios(latest, "v", none, [("raise", 1)]).collect()}
        assert got == {("A", "raise"): 1.0, ("B", "raise"): 0.0, ("C", "raise"): None}


def test_report_tables(spark):
    p = spark.createDataFrame([("A", 2000, 5.0), ("A", 2001, None), ("A", 2002, 3.0), ("B", 2000, 1.0),
                               ("B", 2002, 4.0), ("C", 2001, 2.0)], "u string, t int, v double")
    ch = {r["u"]: r["delta"] for r in unit_change(p, ["u"], "t", "v").collect()}
    assert ch == {"A": -2.0, "B": 3.0, "C": 0.0}
    tb = top_and_bottom(unit_change(p, ["u"], "t", "v"), "delta", ["u"], k=1).collect()
    assert {(r["grp"], r["u"]) for r in tb} == {("largest_decrease", "A"), ("largest_increase", "B")}
    cov = {r["metric"]: r["value"] for r in coverage_long(p, ["u"], "t", ["v"]).collect()}
    assert cov == {"n_rows": 6, "n_units": 3, "first_period": 2000, "last_period": 2002, "n_observed_v": 5}
    ev = spark.createDataFrame([("crash", "RF", 0.8), ("crash", "EN", 1.4), ("teen", "EN", 5.6)],
                               "task string, model string, test_rmse double")
    assert [r["label"] for r in model_comparison(ev).collect()] == ["crash | RF", "crash | EN", "teen | EN"]
    sc = {(r["u"], r["scenario"]): r["projected"] for r in
          scenarios(spark.createDataFrame([("A", 1.0)], "u string, v double"), "v", -2.0,
                    [("raise", 0.5), ("cut", -0.5)]).collect()}
    assert sc == {("A", "raise"): 0.0, ("A", "cut"): 3.0}


def test_run_status(spark):
    res, st = run_status(spark, "ok_step", lambda: 3)
    assert res == 3 and st.first()["status"] == "ok"
    res, st = run_status(spark, "bad_step", lambda: 1 / 0)
    assert res is None and st.first()["status"] == "failed" and "ZeroDivisionError" in st.first()["message"]


def test_encoder_fallback(spark):
    from panelcraft.plans.pipeline import text_embeddings
    grid = spark.createDataFrame([(u, 2001) for u in "ABC"], "unit string, year int")
    ev = spark.createDataFrame([("A", 2001, "tax up"), ("B", 2001, "sales ban")], "unit string, year int, txt string")

    def broken(texts):
        raise RuntimeError("no model")

    meta = {}
    out = text_embeddings(grid, ev, ["unit", "year"], F.col("txt"), ["txt"], "none", dims=2, encoder=broken, meta=meta)
    assert meta["encoder"] == "tfidf_svd_fallback" and out.count() == 3

    def fake(texts):
        return [[float(len(t)), 1.0] for t in texts]

    meta = {}
    out = text_embeddings(grid, ev, ["unit", "year"], F.col("txt"), ["txt"], "none", dims=2, encoder=fake, meta=meta)
    assert meta["encoder"] == "fake"
    assert {r["unit"]: r["embedding"][0] for r in out.collect()}["A"] == 6.0
